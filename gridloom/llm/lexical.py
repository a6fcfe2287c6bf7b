"""Ranked lexical search with bit-sliced Bloom signatures.

The signature of a document is a row of bits: each of its words sets five of them, once for
being there and again for being there at least 2, 4, 8, 16 and 32 times. Documents of like size are laid
together in blocks, and a block is stored by slices: for every bit position a bitmap of the
documents that have it. The bitmaps of a word's five positions, intersected, hold all documents with
the word and some others, so they overestimate where and how often it stands. A document's upper
bound for a query adds up the words' weights times what the overestimated frequency can give.

A search takes two passes over the slices. The first yields the most promising documents of each query; they are scored
exactly, and the score of the last place wanted is a bound that the result can only rise above. The second
yields every document whose upper bound reaches it. All of these are read again and scored exactly, word by
word; a document left out is proven to be too low. The index is built by reading texts once, without a shuffle.

Queries go to the executors in blocks of at most ``block_chars`` characters; the driver holds one block's texts, its words
and one threshold for each query. Candidates are joined to the documents by a hash; they are broadcast only while
they are few, as counted.

Null and empty texts have no words: as documents they are not counted and never found, as queries they find nothing. Repeated
documents and repeated queries each get rows of their own. Equal scores are ordered by id, a null id last, and
documents equal in both by nothing. Very long texts set up to 2^22 bits and are scored in pieces. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import counted, durable, mix64, word_hashes, word_pieces

#: Bits for each word and level; levels stand for at least 1, 2, 4, ... occurrences.
BITS, LEVELS = 5, 6
#: Documents of a block, and bits set in it, at most (a single document may set more).
DOCS, ENTRIES = 2048, 1 << 19
_WIDEST = 22
#: Candidates that may be broadcast.
FEW = 500_000


def _hashed(words: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    return mix64(words.astype(np.uint64) ^ mix64(np.atleast_1d(level).astype(np.uint64) + np.uint64(1)))


def _positions(hashed: np.ndarray, width: int) -> np.ndarray:
    """The bit positions of hashes in signatures of ``width`` bits, a power of two; one row for each hash."""
    step = (hashed >> np.uint64(32)) | np.uint64(1)
    return ((hashed[:, None] + np.arange(BITS, dtype=np.uint64) * step[:, None]) & np.uint64(width - 1)).astype(np.int64)


def _slices(entries: list[np.ndarray], width: int) -> bytes:
    """Bitmaps of the documents, one for each bit position."""
    bits = np.zeros((width, -(-len(entries) // 8) * 8), bool)
    document = np.repeat(np.arange(len(entries)), [len(e) for e in entries])
    bits[_positions(np.concatenate(entries), width), document[:, None]] = True
    return np.packbits(bits, axis=1, bitorder="little").tobytes()


def build_signatures(keyed: DataFrame) -> DataFrame:
    """(keys, sizes, width, slices): blocks of the signatures of documents (key, text) that have words."""

    def run(batches):
        held: dict[int, list[tuple[int, int, np.ndarray]]] = {}

        def block(size: int) -> pa.RecordBatch:
            keys, sizes, entries = zip(*held.pop(size), strict=True)
            width = 1 << min(size + 3, _WIDEST)
            return pa.RecordBatch.from_arrays(
                [pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([width], pa.int32()), pa.array([_slices(entries, width)], pa.binary())], names=["keys", "sizes", "width", "slices"]
            )

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for s, e, rows, values in word_hashes(batch.column(1)):
                row, word, times = counted(rows, values)
                level = np.minimum(np.log2(np.maximum(times, 1)).astype(np.int64), LEVELS - 1)
                every = np.repeat(np.arange(len(row)), level + 1)
                nth = np.arange(len(every)) - np.repeat(np.cumsum(level + 1) - level - 1, level + 1)
                entries = _hashed(word[every], nth)
                sizes = np.bincount(rows, minlength=e - s)
                ends = np.cumsum(np.bincount(row[every], minlength=e - s))
                for i in np.flatnonzero(sizes):
                    own = entries[ends[i - 1] if i else 0 : ends[i]].copy()
                    size = max(3, int(len(own) - 1).bit_length())
                    held.setdefault(size, []).append((keys[s + i], int(sizes[i]), own))
                    if len(held[size]) >= DOCS or len(held[size]) << size >= 2 * ENTRIES:
                        yield block(size)
        for size in list(held):
            yield block(size)

    return durable(keyed.select("key", "text").mapInArrow(run, "keys array<long>, sizes array<long>, width int, slices binary"))


@dataclass
class Queries:
    """A block of queries: each query's words with their weights, repeats counted."""

    ids: list
    terms: list[bytes]
    weighted: list[tuple[np.ndarray, np.ndarray]]
    documents: int
    words: int

    @classmethod
    def of(cls, items: list[tuple], frequency: dict[bytes, int], documents: int, words: int) -> Queries:
        terms = sorted(w for w in frequency if weight(documents, frequency[w]) > 0)
        number = {w: i for i, w in enumerate(terms)}
        weighted = []
        for _, found in items:
            own = [(number[w], n * weight(documents, frequency[w])) for w, n in found.items() if w in number]
            weighted.append((np.array([t for t, _ in own], np.int64), np.array([v for _, v in own], np.int64)))
        return cls([i for i, _ in items], terms, weighted, documents, words)

    def length(self, n: int) -> int:
        """The part that a document of ``n`` words gives to the denominator."""
        return 100 - 75 + 75 * n * self.documents // self.words


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def gain(times: int, length: int) -> int:
    return 1_000_000_000 * times // (1000 * times + 8 * length)


def upper_bounds(queries: Queries, sizes: np.ndarray, width: int, slices: bytes, at: np.ndarray):
    """For each query the upper bounds of a block's documents; ``at`` are the positions of its words by level."""
    n = len(sizes)
    bits = np.frombuffer(slices, np.uint8).reshape(width, -1)
    level = np.zeros((len(queries.terms), n), np.uint8)
    alive, before = np.arange(len(queries.terms)), None
    for positions in at:
        own = positions[alive]
        here = bits[own[:, 0]]
        for b in range(1, BITS):
            here &= bits[own[:, b]]
        if before is not None:
            here &= before
        some = here.any(1)
        alive, before = alive[some], here[some]
        if not len(alive):
            break
        level[alive] += np.unpackbits(before, axis=1, bitorder="little", count=n)
    most = np.zeros((LEVELS + 1, n))
    for j, size in enumerate(sizes.tolist()):
        length = queries.length(size)
        most[1:, j] = [gain(min(size, (2 << k) - 1) if k < LEVELS - 1 else size, length) for k in range(LEVELS)]
    column = np.arange(n)
    for terms, weights in queries.weighted:
        # Sums of whole numbers, exact as doubles up to 2^53; beyond that the factor leaves room for rounding.
        yield np.floor((weights.astype(float) @ most[level[terms], column]) * (1 + 1e-12)) if len(terms) else np.zeros(n)


def candidates(index: DataFrame, queries: Queries, least: list[int] | None = None, first: int = 20) -> DataFrame:
    """(query, key, bound): documents whose upper bound reaches ``least`` of the query, or without it the ``first`` best of each block."""
    held = index.sparkSession.sparkContext.broadcast((queries, least))

    def run(batches):
        queries, least = held.value
        hashed = np.array([next(word_hashes(pa.array([w], pa.binary())))[3][0] >> np.uint64(12) for w in queries.terms], np.uint64)
        by_width: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                width = batch.column(2)[i].as_py()
                if width not in by_width:
                    by_width[width] = np.array([_positions(_hashed(hashed, k), width) for k in range(LEVELS)])
                keys, sizes = (np.asarray(batch.column(c)[i].values) for c in (0, 1))
                found, bounds, of = [], [], []
                for q, bound in enumerate(upper_bounds(queries, sizes, width, batch.column(3)[i].as_py(), by_width[width])):
                    good = np.flatnonzero(bound >= (1 if least is None else least[q]))
                    if least is None and len(good) > first:
                        good = good[np.argpartition(bound[good], len(good) - first)[-first:]]
                    found.append(keys[good])
                    bounds.append(bound[good])
                    of.append(np.full(len(good), q, np.int32))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (of, found, bounds)], names=["query", "key", "bound"])

    return index.mapInArrow(run, "query int, key long, bound double")


def rescore(keyed: DataFrame, wanted: DataFrame, queries: Queries, few: int = FEW) -> DataFrame:
    """(query, id, score): exact scores above 0 of documents (key, id, text) for the queries that want them."""
    grouped = durable(wanted.groupBy("key").agg(F.collect_set("query").alias("queries")))
    rows, entries = grouped.agg(F.count("*"), F.coalesce(F.sum(F.size("queries")), F.lit(0))).first()
    held = keyed.sparkSession.sparkContext.broadcast(queries)
    id_type = keyed.schema["id"].dataType

    def run(batches):
        queries = held.value
        number = {w: i for i, w in enumerate(queries.terms)}
        for batch in (b.slice(s, 500) for b in batches for s in range(0, b.num_rows, 500)):
            of, row, score = [], [], []
            wants = batch.column(2).to_pylist()
            for r, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                times, size = Counter(), 0
                for _, words, _ in word_pieces(text):
                    size += len(words)
                    times.update(w for w in words if w in number)
                length = queries.length(size)
                gains = {number[w]: gain(n, length) for w, n in times.items()}
                for q in wants[r]:
                    terms, weights = queries.weighted[q]
                    total = sum(v * gains.get(t, 0) for t, v in zip(terms.tolist(), weights.tolist(), strict=True))
                    if total > 0:
                        of.append(q)
                        row.append(r)
                        score.append(total)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), batch.column(0).take(pa.array(row, pa.int64())), pa.array(score, pa.int64())], names=["query", "id", "score"])

    small = rows <= few and entries <= 4 * few
    met = keyed.join(F.broadcast(grouped) if small else grouped, "key").select("id", "text", "queries")
    return met.mapInArrow(run, T.StructType([T.StructField("query", T.IntegerType()), T.StructField("id", id_type), T.StructField("score", T.LongType())]))


def _frequencies(keyed: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How many documents hold each of the queries' words."""
    held = keyed.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocabulary, counts = held.value, Counter()
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                for text in batch.column(0).slice(s, 500).cast(pa.binary()).to_pylist():
                    seen: set[bytes] = set()
                    for _, words, _ in word_pieces(text):
                        seen |= vocabulary.intersection(words)
                    counts.update(seen)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    found = keyed.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r[0]): r[1] for r in found.toLocalIterator()}


def _blocks(queries: DataFrame, query_id: str, text: str, block_chars: int) -> list[DataFrame]:
    rows = queries.select(F.col(f"`{query_id}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-2 * size // block_chars) if size > block_chars else 1
    return [rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) if n > 1 else rows for i in range(n)]


def search(
    docs: DataFrame, queries: DataFrame, *, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text", k: int = 10, block_chars: int = 4_000_000, few: int = FEW
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each query, those with score 0 left out."""
    keyed = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).withColumn("key", F.xxhash64("id", "text"))
    index = build_signatures(keyed)
    sums = index.select(F.size("sizes").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0)))
    documents, words = sums.first()
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    names = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", queries.schema[query_id].dataType)])
    out = None
    for block in _blocks(queries, query_id, query_text, block_chars):
        items = [(r.id, Counter(w for _, words_, _ in word_pieces(r.text.encode()) for w in words_)) for r in block.collect()]
        frequency = _frequencies(keyed, frozenset(w for _, found in items for w in found)) if documents and items else {}
        asked = Queries.of(items, frequency, documents, max(1, words))
        promising = candidates(index, asked).withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "key"))).filter(F.col("at") <= 2 * k)
        scored = rescore(keyed, promising, asked, few).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k)
        least = [1] * len(items)
        for r in scored.select("query", "score").toLocalIterator():  # one row for each query of the block at most
            least[r.query] = r.score
        best = rescore(keyed, candidates(index, asked, least).select("query", "key"), asked, few).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        named = docs.sparkSession.createDataFrame([(i, x) for i, (x, _) in enumerate(items)], names)
        run = best.join(F.broadcast(named), "query").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")
        out = run if out is None else out.unionByName(run)
    return out


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
q AS (SELECT row_number() OVER () AS qid, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
total AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY ALL),
asked AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(w) AS term FROM q) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term), total),
sized AS (SELECT rid, doc_id, 100 - 75 + ((75 * CAST(len(w) AS BIGINT) * n) // l) AS m FROM d, total WHERE len(w) > 0),
scored AS (
  SELECT qid, rid, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sized USING (rid) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored JOIN sized USING (rid) WHERE score > 0) JOIN q USING (qid) WHERE rank <= 10
"""
