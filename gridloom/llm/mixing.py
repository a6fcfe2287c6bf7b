"""Mixing sources to target weights with hash-threshold histograms.

Each document has a hash of its id and text. A source takes the documents whose hash is
under its threshold; thresholds for growing budgets are nested. To find one, word
counts are summed by source and hash bucket, the bucket in which the budget runs
out is refined into ever finer buckets, and everything is then one filter. Only
counts by bucket are shuffled, map-side combined; documents are never sorted.

A source whose target exceeds its size takes every document once for each whole
pass and the remainder by threshold. Targets share all words by the weights 1, 2,
3 over the sources in code-point order (null last); a target stops at ``cap`` times
its source's size and what it leaves is shared by the others.

Null and empty texts have size 0 and take 0 words. Rows without an id, or that repeat
one, are told apart by their texts; rows equal in both go in or stay out together. An empty
table gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import durable, fresh, unused

BITS = 60
STEP = 10
TOKEN = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def mix_hash(key: Column, text: Column, seed: str = "mix") -> Column:
    """60 bits of md5 over the seed, the id and the text."""
    whole = F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """One row per source: source, source_size, target.

    Water filling: with sources ordered by the level size * cap / weight at which
    they fill up, source i is full exactly if giving the rest of the words to i and
    those after it, by weight, would exceed its level. The table has one row per
    source, which is a mix's configuration; the windows run over that alone.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    level = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("used", F.coalesce(F.sum(cap * F.col("source_size")).over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("share", (F.col("total") - F.col("used")) / (F.col("all_weight") - F.col("gone")))
        .withColumn("full", cap * F.col("source_size") <= F.col("share") * F.col("weight"))
        .withColumn("rate", F.min(F.when(~F.col("full"), F.struct("gone", "share"))).over(everything)["share"])
    )
    filled = (cap * F.col("source_size")).cast("double")
    return per.select("source", "source_size", F.when(F.col("full") | F.col("rate").isNull(), filled).otherwise(F.least(filled, F.col("rate") * F.col("weight"))).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: passes, and the hash up to which (inclusive) a document is taken once more.

    ``sized`` has source, size, h. Each round cuts the open hash interval of every
    source into 2**STEP buckets and keeps the one where the budget runs out, until
    that holds one hash value, or all 60 bits are used. Of the two sides of that
    value the one nearer to the budget wins.
    """
    passes = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)).cast("long")
    state = targets.select(
        "source", "source_size", "target", passes.alias("passes"), (F.col("target") - passes * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("below")
    )
    for shift in range(BITS - STEP, -1, -STEP):
        state = durable(state)
        cut = state.select(F.col("source").alias("s"), "lo", "below", "budget")
        bucket = F.shiftright(F.col("h"), shift)
        hist = (
            sized.join(cut, F.col("source").eqNullSafe(F.col("s")))
            .filter(F.shiftright(F.col("h"), shift + STEP) == F.shiftright(F.col("lo"), shift + STEP))
            .groupBy("s", bucket.alias("b"), "below", "budget")
            .agg(F.sum("size").alias("size"), F.min("h").alias("first"), F.max("h").alias("last"))
        )
        upto = F.col("below") + F.sum("size").over(Window.partitionBy("s").orderBy("b"))
        hist = hist.withColumn("upto", upto)
        crossing = hist.filter("upto > budget").groupBy("s").agg(F.min(F.struct("b", "upto", "size", "first", "last")).alias("x"))
        state = state.join(crossing, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "passes", "budget",
            F.coalesce(F.shiftleft(F.col("x.b"), shift), F.col("lo")).alias("lo"),
            F.coalesce(F.col("x.upto") - F.col("x.size"), F.col("below")).alias("below"),
            F.col("x.first").alias("first"), F.col("x.last").alias("last"), F.col("x.upto").alias("upto"),
        )
        state = durable(state)
        if state.filter("first < last").isEmpty():
            break
        state = state.drop("first", "last", "upto") if shift else state
    with_boundary = (F.col("upto") - F.col("budget")) < (F.col("budget") - F.col("below"))
    return state.select("source", "source_size", "target", "passes", F.when(F.col("upto").isNull(), F.lit(-1)).when(with_boundary, F.col("last")).otherwise(F.col("first") - 1).alias("cut"))


def mix_cuts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", cap: int = 3, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, h) per row, and (s, source_size, target, passes, cut) per source.

    Joins with the second carry no broadcast hint: the planner broadcasts it by its
    measured size, and past the threshold AQE splits a hot source's partition.
    """
    sized = durable(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"), mix_hash(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), seed).alias("h")))
    return sized, durable(thresholds(sized, source_targets(sized, cap)).withColumnRenamed("source", "s"))


def copies_of(h: Column, cap: int = 3) -> Column:
    return F.least(F.col("passes") + (h <= F.col("cut")).cast("long"), F.lit(cap).cast("long"))


def mix(docs: DataFrame, *, cap: int = 3, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken."""
    sized, cuts = mix_cuts(docs, cap=cap, **options)
    return (
        sized.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left")
        .withColumn("copies", copies_of(F.col("h"), cap))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", cap: int = 3, seed: str = "mix") -> DataFrame:
    """The documents that the mix takes, all columns of ``docs``, each as one row with its number of copies in ``mix_copies`` (``_mix_copies`` where that is taken)."""
    _, cuts = mix_cuts(docs, doc_id=doc_id, text=text, source=source, cap=cap, seed=seed)
    own, cut, copies = fresh(docs, "mix_source"), fresh(docs, "mix_cut"), unused(docs, "mix_copies")
    cuts = cuts.select(F.col("s").alias(own), F.struct("passes", "cut").alias(cut))
    extra = (mix_hash(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), seed) <= F.col(f"{cut}.cut")).cast("long")
    joined = docs.join(cuts, F.col(f"`{source}`").eqNullSafe(F.col(own)))
    return joined.withColumn(copies, F.least(F.col(f"{cut}.passes") + extra, F.lit(cap).cast("long"))).filter(F.col(copies) > 0).drop(own, cut)
