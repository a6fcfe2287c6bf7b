"""Document fingerprints by Order MinHash, in DataFrame expressions only.

Words are cut into pieces of at most ``PIECE`` characters, and ``K`` successive pieces
are a k-mer. K-mers are numbered by occurrence, so that repeats count, and hashed. One
hash splits them over ``BINS`` bins; in each bin the two smallest are kept, put back
into text order and hashed as a tuple. A fingerprint is the list of the bins' tuples.
The share of equal tuples estimates the square of the share of common k-mers in common
order, so likeness is its root: it falls with the edit distance and not only with the
sets (Marcais, DeBlasio, Pandey and Kingsford, 2019).

Everything runs row by row on arrays of longs, sorted as such; no k-mer is shuffled.

A text without a visible character (null counts as empty) has an empty fingerprint; two
empty ones have likeness 1, one and a non-empty one 0. Shorter texts than ``K`` pieces are
one k-mer. Equal texts have equal fingerprints. In a text of more than 2**24 pieces order
is by the position modulo 2**24.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import durable

PIECE = 8
K = 3
BINS = 64
_POSITION = 24
_BIN_SHIFT = 63 - 6


def _shifted(a: Column, by: int) -> Column:
    """The array moved ``by`` places to the right, same length, -1 in front: element i holds a[i - by]."""
    return F.slice(F.concat(F.array_repeat(F.lit(-1).cast("long"), by), a), F.lit(1), F.size(a))


def with_signature(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: a sorted array of longs, each a bin number and 32 bits of the bin's tuple.

    Every step is a column of its own, so that none is computed inside a lambda of the next.
    """
    pieces, kmers, ordered, starts, repeats, labelled, least = (f"{name}_{x}" for x in "pkosrlm")
    low = F.lit((1 << _POSITION) - 1).cast("long")
    high = F.bitwise_not(low)
    out = docs.withColumn(pieces, F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S{1,%d}" % PIECE), F.lit(0)), lambda w: F.xxhash64(w)))
    p = F.col(pieces)
    size = F.size(p)
    # Successive pieces meet by zipping the array with itself, moved by one and by two.
    tails = [p, *(F.slice(p, F.lit(i + 1), F.greatest(size - i, F.lit(0))) for i in range(1, K))]
    joined = F.slice(p, F.lit(1), F.greatest(size - (K - 1), F.lit(0)))
    for t in tails[1:]:
        joined = F.zip_with(joined, F.slice(t, F.lit(1), F.greatest(size - (K - 1), F.lit(0))), lambda a, b: F.xxhash64(a, b))
    packed = lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("long").bitwiseAND(low))
    whole = F.when(size == 0, F.array().cast("array<bigint>")).when(size < K, F.array(F.xxhash64(p))).otherwise(joined)
    out = out.withColumn(kmers, F.transform(whole, packed))
    out = out.withColumn(ordered, F.sort_array(kmers)).drop(pieces, kmers)
    o = F.col(ordered)
    # A k-mer's first occurrence differs from what precedes it in sorted order.
    first = F.zip_with(o, _shifted(o, 1), lambda x, before: F.shiftright(x, _POSITION) != F.shiftright(before, _POSITION))
    out = out.withColumn(starts, F.filter(F.transform(first, lambda f, i: F.when(f, i)), lambda i: i.isNotNull()))
    out = out.withColumn(repeats, F.when(F.size(starts) < F.size(o), _runs(F.col(starts), F.size(o))))
    numbered = lambda x, n: F.shiftrightunsigned(F.xxhash64(F.shiftright(x, _POSITION), n), 1).bitwiseAND(high).bitwiseOR(x.bitwiseAND(low))
    once = F.transform(o, lambda x: numbered(x, F.lit(0)))
    many = F.zip_with(o, F.col(repeats), numbered)
    out = out.withColumn(labelled, F.sort_array(F.when(F.col(repeats).isNull(), once).otherwise(many))).drop(ordered, starts, repeats)
    s = F.col(labelled)
    # Sorted by hash, a bin's elements lie together; the first two are those whose second predecessor is in another bin.
    two = F.zip_with(s, _shifted(s, 2), lambda x, before: F.when((before < 0) | (F.shiftright(x, _BIN_SHIFT) != F.shiftright(before, _BIN_SHIFT)), x))
    out = out.withColumn(least, F.filter(two, lambda x: x.isNotNull())).drop(labelled)
    m = F.col(least)
    following = F.concat(F.slice(m, F.lit(2), F.greatest(F.size(m) - 1, F.lit(0))), F.array(F.lit(-1).cast("long")))
    mate = F.transform(F.arrays_zip(m.alias("x"), following.alias("y"), _shifted(m, 1).alias("z")), lambda t: _tuple(t["x"], t["y"], t["z"], low))
    return out.withColumn(name, F.when(F.size(m) == 0, F.array().cast("array<bigint>")).otherwise(F.filter(mate, lambda x: x.isNotNull()))).drop(least)


def _tuple(x: Column, y: Column, z: Column, low: Column) -> Column:
    """Bin number and tuple hash at a bin's first element, null at its second."""
    same = lambda a, b: (b >= 0) & (F.shiftright(a, _BIN_SHIFT) == F.shiftright(b, _BIN_SHIFT))
    rank = lambda a: F.shiftright(a, _POSITION)
    both = F.when(x.bitwiseAND(low) <= y.bitwiseAND(low), F.xxhash64(rank(x), rank(y))).otherwise(F.xxhash64(rank(y), rank(x)))
    code = F.when(same(x, y), both).otherwise(F.xxhash64(rank(x)))
    return F.when(~same(x, z), F.shiftleft(F.shiftright(x, _BIN_SHIFT), 32).bitwiseOR(code.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))


def _runs(starts: Column, size: Column) -> Column:
    """The number of each element within its run of equal k-mers, from 0, given where the runs start."""
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(size))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.sequence(F.lit(0), b - a - 1)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the root of the share of bins, of those that either has, with equal tuples."""
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.sqrt(F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1))))


def as_text(signature: Column) -> Column:
    """Ten hex digits a bin, two of them the bin's number."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def fingerprints(docs: DataFrame, *, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Columns of ``docs`` plus the fingerprint as text."""
    return with_signature(docs, text, f"{name}_signature").withColumn(name, as_text(F.col(f"{name}_signature"))).drop(f"{name}_signature")


def followers(ids: DataFrame, partitions: int) -> DataFrame:
    """doc_id and next_id, the next in ascending order (the first after the last), of unique ids.

    Ids are range-partitioned; inside a partition the next one is a window away, and
    only the partitions' first ids, one row each, are compared across partitions.
    """
    spread = durable(ids.repartitionByRange(partitions, "doc_id").withColumn("part", F.spark_partition_id()))
    inside = spread.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    heads = spread.groupBy("part").agg(F.min("doc_id").alias("head"))
    heads = heads.withColumn("after", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.min("head").over(Window.partitionBy()))).select("part", "after")
    return inside.join(heads, "part").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def compare_with_edits(documents: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are.

    The edited text has the last floor(n_chars / 4) code points replaced by as many
    from the start of the next document. Texts are shuffled once, by id; after that
    only the starts that are needed travel to their neighbours.

    Rows that repeat an id are one document in the order of ids; each is edited by
    itself, and of the rows of a next document the one with the least start counts.
    Rows without an id are left out. A single document is its own next one.
    """
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lengths = durable(docs.select("doc_id", F.floor(F.length("text") / 4).cast("int").alias("take")).groupBy("doc_id").agg(F.max("take").alias("take")))
    needed = followers(lengths, partitions).join(lengths, "doc_id").select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("to"), "take")
    needed = durable(needed)
    met = docs.join(needed, "doc_id")
    heads = met.select("to", F.substring("text", F.lit(1), F.col("take")).alias("head")).groupBy("to").agg(F.min("head").alias("head"))
    edited = docs.join(heads, F.col("doc_id") == F.col("to"))
    take = F.floor(F.length("text") / 4).cast("int")
    edited = edited.select("doc_id", F.length("text").cast("long").alias("n_chars"), "text", F.concat(F.substring("text", F.lit(1), F.length("text") - take), F.substring("head", F.lit(1), take)).alias("edited"))
    signed = with_signature(with_signature(edited, "text", "sig"), "edited", "edited_sig")
    one = durable(signed.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sig", "edited_sig"))
    following = needed.select(F.col("doc_id").alias("next"), "to").join(one.groupBy(F.col("doc_id").alias("next")).agg(F.min("sig").alias("next_sig")), "next").select("to", "next_sig")
    return one.join(following, F.col("doc_id") == F.col("to")).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
