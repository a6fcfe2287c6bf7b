"""Benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item; a shorter item is
one window. Containment of a window in a document is exact, so one necessary
token is prefix enough: the window's rarest word by document frequency. The
document side looks that word up, bounds on position and length drop
alignments that cannot fit, and the rest is verified word by word.

The benchmark is a stated query set. It goes to the executors in blocks of at
most ``block_chars`` characters, each block one pass over the documents without
a shuffle; more benchmark means more blocks, never a larger broadcast.

Nulls and empty texts have no words, hit nothing and are not contaminated.
Repeated rows are judged one by one; other columns pass through untouched. With
an empty benchmark nothing is contaminated. A null item id counts as the empty string.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import append_columns, fresh, words

RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> list[DataFrame]:
    rows = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-2 * size // block_chars)) if size > block_chars else 1
    # Whole items only: an item's shortest window must not be cut.
    return [rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) if n > 1 else rows for i in range(n)]


def _frequencies(docs: DataFrame, text: str, vocabulary: frozenset) -> dict[bytes, int]:
    """Document frequency of the block's words over all documents."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocabulary, counts = held.value, {}
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()).to_pylist():
                for w in vocabulary.intersection(words(value)):
                    counts[w] = counts.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    found = docs.select(F.col(f"`{text}`")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r[0]): r[1] for r in found.toLocalIterator()}


def prefix_index(items: list[tuple[str, list[bytes]]], frequency: dict[bytes, int], window: int) -> dict[bytes, list[tuple[int, int]]]:
    """Rarest word of each window -> (item, position of that word in the item)."""
    index: dict[bytes, set[tuple[int, int]]] = {}
    for i, (_, w) in enumerate(items):
        size = min(window, len(w))
        for s in range(len(w) - size + 1) if w else ():
            at = min(range(s, s + size), key=lambda p: (frequency.get(w[p], 0), w[p], p))
            index.setdefault(w[at], set()).add((i, at))
    return {k: sorted(v) for k, v in index.items()}


def matches(doc: list[bytes], items: list[tuple[str, list[bytes]]], index: dict, window: int) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges of ``doc`` (end exclusive) inside occurrences of windows, and the items they come from."""
    ranges, found, done = [], set(), {}
    n = len(doc)
    for p in [p for p, w in enumerate(doc) if w in index]:
        for i, q in index[doc[p]]:
            name, item = items[i]
            size = min(window, len(item))
            # Length and positional bounds: the window fits into what is left on both sides.
            if n < size or min(p, q) + min(n - p, len(item) - q) < size or p < done.get((i, p - q), -1):
                continue
            lo, hi = 0, 1
            while lo < p and lo < q and doc[p - lo - 1] == item[q - lo - 1]:
                lo += 1
            while p + hi < n and q + hi < len(item) and doc[p + hi] == item[q + hi]:
                hi += 1
            done[i, p - q] = p + hi
            if lo + hi >= size:
                ranges.append((p - lo, p + hi))
                found.add(name)
    return ranges, found


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_chars: int = 4_000_000, prefix: str = "contam"
) -> DataFrame:
    """All columns of ``docs`` and four more, whose names the caller can build with :func:`names`.

    ``<prefix>_words`` is the number of words, ``<prefix>_ranges`` the hit word
    ranges, ``<prefix>_items`` the sorted item ids whose windows occur.
    """
    n_words, ranges, found = names(docs, prefix)
    out = docs
    blocks = _blocks(benchmark, item_id, item_text, block_chars)
    for number, block in enumerate(blocks):
        items = [(r.item, words(r.text.encode())) for r in block.collect()]
        items = [x for x in items if x[1]]
        frequency = _frequencies(docs, text, frozenset(w for _, x in items for w in x)) if items else {}
        held = docs.sparkSession.sparkContext.broadcast((items, prefix_index(items, frequency, window)))

        def make(held=held):
            items, index = held.value

            def work(values):
                sizes, hits, names = [], [], []
                for v in values:
                    doc = words(v)
                    r, f = matches(doc, items, index, window)
                    sizes.append(len(doc))
                    hits.append([{"start": s, "end": e} for s, e in _merged(r)])
                    names.append(sorted(f))
                return [pa.array(sizes, pa.int64()), pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(names, pa.list_(pa.string()))]

            return work

        suffix = f"_{number}"
        out = append_columns(out, text, make, [T.StructField(n_words + suffix, T.LongType()), T.StructField(ranges + suffix, RANGES), T.StructField(found + suffix, T.ArrayType(T.StringType()))])
    every = range(len(blocks))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col(f"{n_words}_0").alias(n_words),
        F.flatten(F.array(*[f"{ranges}_{i}" for i in every])).alias(ranges),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[f"{found}_{i}" for i in every])))).alias(found),
    )


def names(docs: DataFrame, prefix: str = "contam") -> tuple[str, str, str]:
    return fresh(docs, f"{prefix}_words"), fresh(docs, f"{prefix}_ranges"), fresh(docs, f"{prefix}_items")


def hit_words(ranges):
    """Number of words in a union of ranges that may overlap, as a column."""
    ordered = F.array_sort(ranges)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))

    def step(acc, r):
        return F.struct((acc["n"] + F.greatest(r["end"] - F.greatest(r["start"], acc["upto"]), F.lit(0))).alias("n"), F.greatest(acc["upto"], r["end"]).alias("upto"))

    return F.aggregate(ordered, start, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents whose hit words are under a twentieth of their words; same columns as ``docs``."""
    n_words, ranges, _ = names(docs)
    marked = contamination(docs, benchmark, **options)
    n_hit = hit_words(F.col(ranges))
    return marked.filter(~((n_hit > 0) & (20 * n_hit >= F.col(n_words)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def item_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
