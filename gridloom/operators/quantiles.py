"""Exact quantiles of groups of any size.

A double's bits, with the sign turned into direction, are in the order of the numbers. An order statistic is
found by bins of these bits: 16 bits at a time, rows are counted by group and bin, and the bin that holds the wanted rank
is cut into finer ones, until it holds a single value. Tasks hold counts and never a group's
values; values are written once and moved by no shuffle. At most four rounds are needed, whatever the spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.scratch import durable

STEP = 16


def sortable(x: Column) -> Column:
    """The bits of a double as a long in the order of the numbers: both zeros are 0, NaN is the greatest."""
    a = F.abs(x)
    guess = F.floor(F.log2(a))
    # The logarithm may be off by one beside a power of two.
    e = guess + F.when(F.pow(F.lit(2.0), guess) > a, -1).when(F.pow(F.lit(2.0), guess + 1) <= a, 1).otherwise(0)
    normal = F.shiftleft((e + 1023).cast("long"), 52) + ((a / F.pow(F.lit(2.0), e) - 1) * F.lit(2.0**52)).cast("long")
    size = F.when(a < 2.0**-1022, (a / 2.0**-1074).cast("long")).when(a == float("inf"), F.lit(2047 << 52)).otherwise(normal)
    return F.when(F.isnan(x), F.lit((2047 << 52) + 1)).otherwise(F.when(x < 0, -size).otherwise(size))


def _same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def order_statistics(values: DataFrame, group: list[str], wanted: DataFrame) -> DataFrame:
    """``wanted`` (group, _k) with ``_at``, the value of rank _k from 0 among ``values`` (group, _v, _c)."""
    there, own = [f"{g}_t" for g in group], [f"{g}_s" for g in group]
    state = wanted.select(*group, "_k", F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_below"))
    for shift in range(64 - STEP, -1, -STEP):
        coarse = F.shiftright("_c", shift + STEP) if shift + STEP < 64 else F.lit(0).cast("long")
        binned = values.withColumns({"_before": coarse, "_bin": F.shiftright("_c", shift)})
        if shift + STEP < 64:
            open_ = state.select(*[F.col(g).alias(t) for g, t in zip(group, there, strict=True)], F.col("_prefix").alias("_p")).distinct()
            binned = binned.join(open_, _same(group, there) & (F.col("_before") == F.col("_p")), "left_semi")
        counts = binned.groupBy(*[F.col(g).alias(s) for g, s in zip(group, own, strict=True)], "_before", "_bin").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        met = state.join(counts, _same(group, own) & (F.col("_prefix") == F.col("_before")))
        upto = F.col("_below") + F.sum("_n").over(Window.partitionBy(*group, "_k").orderBy("_bin"))
        reached = met.withColumn("_upto", upto).filter(F.col("_upto") > F.col("_k"))
        first = reached.groupBy(*group, "_k").agg(F.min(F.struct("_bin", (F.col("_upto") - F.col("_n")).alias("below"), "_lo", "_hi")).alias("x"))
        state = durable(first.select(*group, "_k", F.col("x._bin").alias("_prefix"), F.col("x.below").alias("_below"), F.col("x._lo").alias("_at"), F.col("x._hi").alias("_to")))
        if state.filter("_at < _to").isEmpty():
            break
    return state.select(*group, "_k", "_at")


def exact_quantiles(df: DataFrame, group: list[str], value: str, probabilities: list[float], name: str = "q") -> DataFrame:
    """(group, ``name``): an array of the quantiles of each group's values that are not NULL, interpolated between neighbours."""
    keys = [f"_g{i}" for i in range(len(group))]
    values = durable(df.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], F.col(value).cast("double").alias("_v")).filter("_v is not null").withColumn("_c", sortable(F.col("_v"))))
    sizes = values.groupBy(*keys).agg(F.count("*").alias("_size")).filter("_size > 0")
    at = [F.lit(float(p)) * (F.col("_size") - 1) for p in probabilities]
    ranks = F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))
    sizes = durable(sizes)
    found = order_statistics(values, keys, sizes.select(*keys, F.explode(ranks).alias("_k")))
    tables = found.groupBy(*[F.col(k).alias(f"{k}_f") for k in keys]).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_at"))).alias("_m"))
    met = sizes.join(tables, _same(keys, [f"{k}_f" for k in keys]))
    value_at = lambda r: F.element_at("_m", r.cast("long"))
    low = [value_at(F.floor(a)) for a in at]
    q = F.array(*[F.when(F.ceil(a) == F.floor(a), lo).otherwise(lo + (value_at(F.ceil(a)) - lo) * (a - F.floor(a))) for a, lo in zip(at, low, strict=True)])
    return met.select(*[F.col(k).alias(g) for g, k in zip(group, keys, strict=True)], q.alias(name))


def with_quantiles(table: DataFrame, df: DataFrame, group: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """``table``, one row for each group, with a column for each named quantile of ``df``'s values."""
    found = exact_quantiles(df, group, value, list(named.values()), "_q")
    found = found.select(*[F.col(g).alias(f"_j{i}") for i, g in enumerate(group)], "_q")
    out = table.join(found, _same(group, [f"_j{i}" for i in range(len(group))]), "left")
    return out.withColumns({n: F.col("_q")[i] for i, n in enumerate(named)}).drop("_q", *[f"_j{i}" for i in range(len(group))])


def in_sets(df: DataFrame, sets: list[list[str]], value: Column) -> DataFrame:
    """(grouping, keys, _value): each row once for each set of keys, the other keys NULL, numbered as ``grouping_id`` does."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    kinds = {k: df.schema[k].dataType for k in keys}
    ids = [sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s) for s in sets]
    each = F.array(*[F.struct(F.lit(g).cast("long").alias("grouping"), *[(F.col(k) if k in s else F.lit(None).cast(kinds[k])).alias(k) for k in keys]) for g, s in zip(ids, sets, strict=True)])
    return df.select(F.explode(each).alias("_s"), value.alias("_value")).select("_s.*", "_value")
