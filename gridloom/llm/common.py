"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.sources.scratch import durable  # noqa: F401 (the operators take it from here)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = f"_{name}"
    while out.lower() in taken:
        out = f"_{out}"
    return out


def unused(df: DataFrame, name: str) -> str:
    """``name`` itself if ``df`` has no such column, else one from :func:`fresh`."""
    return fresh(df, name) if name.lower() in {c.lower() for c in df.columns} else name


def append_columns(
    df: DataFrame, text: str, make: Callable[[], Callable[[list], list[pa.Array]]], fields: list[T.StructField]
) -> DataFrame:
    """Add columns computed in Python from one column, batch by batch, with no shuffle.

    ``make`` runs once in each task and returns a function from the values of
    ``text`` in a batch (UTF-8 bytes or None) to one Arrow array per field.
    All other columns pass through untouched.
    """
    schema = T.StructType([*df.schema.fields, *fields])
    at = df.columns.index(text)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        # Slices keep what is held as Python objects small beside the batch itself.
        for batch in (b.slice(s, 1000) for b in batches for s in range(0, b.num_rows, 1000)):
            values = batch.column(at).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, *work(values)], names=names)

    return df.mapInArrow(run, schema)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that row-wise operators need, under fixed names."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def fold(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``: the folds of the contracts. A null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % of


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def bounded_sample(df: DataFrame, key: str, stratum: str, per_stratum: int, seed: str, most: int = 30_000) -> DataFrame:
    """About ``per_stratum`` rows of each value of ``stratum``, fewer of each where that would make more than ``most`` rows.

    Rows are taken by a threshold on the key's hash, so the choice needs no sort
    and does not depend on partitioning. No value is left out. The table of rates has one row for each value.
    """
    rate, value = fresh(df, "rate"), fresh(df, "value")
    counts = durable(df.groupBy(F.col(stratum).alias(value)).agg(F.count("*").alias(rate)))
    per = min(per_stratum, most / max(1, counts.count()))
    rates = counts.withColumn(rate, F.least(F.lit(1.0), F.lit(float(per)) / F.col(rate)))
    return df.join(rates, F.col(stratum) == F.col(value)).filter(unit_hash(F.col(key), seed) < F.col(rate)).drop(rate, value)


#: Upper-case ASCII letters become lower-case, other ASCII that is no letter or digit becomes a space.
_WORD_BYTES = bytes((i + 32 if 65 <= i <= 90 else i) if i >= 128 or chr(i).isalnum() else 32 for i in range(256))
#: The same for tokens between ASCII white space: only A-Z change.
_TOKEN_BYTES = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words ``[0-9a-z\\x80-]+`` of the text after A-Z are lower-cased. Null has none."""
    return text.translate(_WORD_BYTES).split() if text else []


def tokens(text: bytes | None) -> list[bytes]:
    """Runs between the six ASCII white-space characters, A-Z lower-cased. Null has none."""
    return text.translate(_TOKEN_BYTES).split() if text else []


def word_pieces(text: bytes | None, overlap: int = 0, size: int = 1 << 20) -> Iterator[tuple[int, list[bytes], int]]:
    """(number of the first word, words, how many of them are new here): the :func:`words` of a text in lists of bounded length.

    Each list but the last ends with ``overlap`` words that come again in the next one.
    """
    raw = (text or b"").translate(_WORD_BYTES)
    at, number, carried = 0, 0, []
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        found = carried + raw[at:end].split()
        new = len(found) if end == len(raw) else max(0, len(found) - overlap)
        yield number, found, new
        carried, number, at = found[new:], number + new, end


_TABLE = np.frombuffer(_WORD_BYTES, np.uint8)
#: Texts hashed together at most.
ROWS = 1 << 12
_BASE = np.uint64(0x100000001B3)
_powers = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hashed(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word of ``raw`` (translated bytes); a word ends before each of ``starts``."""
    global _powers
    inside = raw != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = starts[starts < len(raw)]
    first[starts] |= inside[starts]
    at = np.flatnonzero(inside)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    begin = np.flatnonzero(first[at])
    size = np.diff(np.append(begin, len(at)))
    if len(_powers) < (most := int(size.max())):
        _powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(most, 64), _BASE))), dtype=np.uint64)
    place = at - np.repeat(at[begin], size)
    sums = np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * _powers[place], begin)
    return at[begin], mix64(sums + size.astype(np.uint64))


def word_hashes(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The :func:`words` of a column of texts as 64-bit hashes, all at once: (row, next row, row of each word, hash of each word).

    Slices hold whole texts of about ``most`` bytes together; a longer text is hashed in pieces that end between words.
    Null has no words.
    """
    column = column.cast(pa.binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    s = 0
    while s < len(column):
        e = min(s + ROWS, max(s + 1, int(np.searchsorted(offsets, offsets[s] + most, "right")) - 1))
        rows, found = [], []
        at, end = int(offsets[s]), int(offsets[e])
        while at < end:
            upto = end
            if e == s + 1 and end - at > most:
                gap = np.flatnonzero(_TABLE[data[at + most : at + 2 * most]] == 32)
                upto = min(end, at + most + int(gap[0])) if len(gap) else end
            start, value = _hashed(_TABLE[data[at:upto]], offsets[s:e] - at if upto == end and e > s + 1 else np.zeros(0, np.int64))
            rows.append(np.searchsorted(offsets[s : e + 1], start + at, "right") - 1 if e > s + 1 else np.zeros(len(start), np.int64))
            found.append(value)
            at = upto
        yield s, e, np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.uint64)])
        s = e


def counted(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, high 52 bits of the value) in order, and how often each is there; for up to ``ROWS`` rows, which take the other 12 bits of one sort."""
    key = np.sort((rows.astype(np.uint64) << np.uint64(52)) | (values >> np.uint64(12)))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(first)
    key = key[begin]
    return (key >> np.uint64(52)).astype(np.int64), (key & np.uint64((1 << 52) - 1)).astype(np.int64), np.diff(np.append(begin, len(rows)))


def lists_of(rows: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """One list for each of ``n`` rows from values in order of their rows."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))), pa.int32()), values)
