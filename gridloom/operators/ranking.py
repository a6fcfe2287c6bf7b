"""Ranks, best rows, jumps, pivots and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share_within(df: DataFrame, group: list[str], value: str, name: str = "share") -> DataFrame:
    return df.withColumn(name, F.try_divide(F.col(value), F.nullif(F.sum(value).over(Window.partitionBy(*group)), F.lit(0.0))))


def feature_ranking(df: DataFrame, first: str, second: str, group: str = "target") -> DataFrame:
    """Min-ranks by two metrics, the greatest first, within each group, and their mean."""
    w = Window.partitionBy(group)
    out = df.withColumn("rank_1", F.rank().over(w.orderBy(F.desc(first)))).withColumn("rank_2", F.rank().over(w.orderBy(F.desc(second))))
    return out.withColumn("combined_rank", (F.col("rank_1") + F.col("rank_2")) / 2)


def overall_ranking(df: DataFrame, first: str, second: str, key: str = "feature") -> DataFrame:
    """Features by the mean of two overall min-ranks, numbered from 1 (ties by name). One row per feature, a small table."""
    out = df.withColumn("rank_1", F.rank().over(Window.orderBy(F.desc(first)))).withColumn("rank_2", F.rank().over(Window.orderBy(F.desc(second))))
    out = out.withColumn("combined_score", (F.col("rank_1") + F.col("rank_2")) / 2)
    return out.withColumn("position", F.row_number().over(Window.orderBy("combined_score", key)))


def jumps(df: DataFrame, order: str, value: str) -> DataFrame:
    """Change from the row before, in a small ordered table such as a sweep."""
    w = Window.orderBy(order)
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("delta", F.col(value) - F.col("previous"))


def largest_jump(df: DataFrame, order: str, value: str) -> DataFrame:
    """The row with the greatest change (ties: the first)."""
    return jumps(df, order, value).filter("delta is not null").orderBy(F.desc("delta"), order).limit(1)


def best_per_group(df: DataFrame, group: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group in a total order; only the best row of a task is shuffled."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("_rank = 1").drop("_rank")


def best_curve(curves: DataFrame, target: str = "target") -> DataFrame:
    """Per target the best feature set and model by its best fraction; R² at 80 and 100 % and the gain between."""
    keys = [target, "feature_set", "model"]
    per = curves.groupBy(*keys).agg(F.max("r2").alias("best_r2"), F.max(F.when(F.col("fraction") == 0.8, F.col("r2"))).alias("r2_at_80"), F.max(F.when(F.col("fraction") == 1.0, F.col("r2"))).alias("r2_at_100"))
    return best_per_group(per, [target], F.desc("best_r2"), "feature_set", "model").withColumn("tail_gain", F.col("r2_at_100") - F.col("r2_at_80"))


def representative_queries(df: DataFrame, key: str, value: str, label: str, classes: tuple[str, ...]) -> DataFrame:
    """Rows of highest and lowest value, and of each class the row nearest its median; a row keeps its first reason."""
    best = df.agg(F.max_by(key, F.struct(F.col(value), -F.col(key))).alias("high"), F.min_by(key, F.struct(value, key)).alias("low"))
    pick = lambda n, reason, at: F.struct(F.lit(n).alias("n"), F.lit(reason).alias("reason"), F.col(at).alias(key))
    picks = best.select(F.explode(F.array(pick(1, "highest", "high"), pick(2, "lowest", "low"))).alias("p")).select("p.*")
    for i, c in enumerate(classes, 3):
        own = df.filter(F.col(label) == c)
        median = own.agg(F.median(value).alias("_m"))
        near = own.crossJoin(F.broadcast(median)).agg(F.min_by(key, F.struct(F.abs(F.col(value) - F.col("_m")), F.col(key))).alias(key))
        picks = picks.union(near.select(F.lit(i).alias("n"), F.lit(f"median_{c}").alias("reason"), key))
    return best_per_group(picks.filter(F.col(key).isNotNull()), [key], "n").withColumnRenamed("n", "reason_order")


def outliers(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n rows of greatest absolute value, numbered from 1."""
    top = df.orderBy(F.desc(F.abs(value)), key).limit(n)
    return top.withColumn("outlier_rank", F.row_number().over(Window.orderBy(F.desc(F.abs(value)), key)))


def pivoted(df: DataFrame, row: str, column: str, values: list[str], value: str) -> DataFrame:
    """One column for each value, 0 where there is nothing."""
    return df.groupBy(row).pivot(column, values).agg(F.first(value)).fillna(0, values)


def category_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """``category_position``: the place of a value in a custom order, after all for others."""
    at = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])[F.col(column)]
    return df.withColumn("category_position", F.coalesce(at, F.lit(len(order))))


def ordered_distinct(df: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return best_per_group(df, key, *order)
