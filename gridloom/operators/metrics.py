"""Grouped metrics and summaries over prediction and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.stats import corrected_kurtosis, corrected_skewness, regression_metrics
from gridloom.operators.quantiles import exact_quantiles, in_sets, with_quantiles


def long_bands(df: DataFrame, bands: dict[str, tuple[str, str]], keep: list[str] = ()) -> DataFrame:
    """One row per pixel and band: (band, actual, predicted) from pairs of columns."""
    cells = F.array(*[F.struct(F.lit(b).alias("band"), F.col(a).cast("double").alias("actual"), F.col(p).cast("double").alias("predicted")) for b, (a, p) in bands.items()])
    return df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.*")


def metrics_by(df: DataFrame, *keys: str, actual: str = "actual", predicted: str = "predicted", zero_variance: float | None = None) -> DataFrame:
    """Regression metrics of each group; one row for the whole table without keys."""
    return df.groupBy(*keys).agg(*regression_metrics(F.col(actual), F.col(predicted), zero_variance))


def metrics_by_sets(df: DataFrame, sets: list[list[str]], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Regression metrics for several grouping keys in one pass; ``grouping`` names the set."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    name = F.lit("all")
    for s in sets:
        mask = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        name = F.when(F.grouping_id() == mask, "_".join(s) or "all").otherwise(name)
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(name.alias("grouping"), *regression_metrics(F.col(actual), F.col(predicted)))


def residual_summary(df: DataFrame, sets: list[list[str]], residual: str = "residual") -> DataFrame:
    """n, mae, rmse, bias, and median, 90th percentile and greatest absolute residual, for several grouping keys in one pass and one selection."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    r = F.col(residual)
    sums = df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(
        F.grouping_id().alias("grouping"), F.count(r).alias("n"), F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(r).alias("bias"), F.max(F.abs(r)).alias("max_abs")
    )
    return with_quantiles(sums, in_sets(df, sets, F.abs(r)), ["grouping", *keys], "_value", {"median_abs": 0.5, "p90_abs": 0.9})


def residual_distribution(df: DataFrame, *keys: str, residual: str = "residual") -> DataFrame:
    r = F.col(residual)
    sums = df.groupBy(*keys).agg(F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), corrected_skewness(r).alias("skew"), corrected_kurtosis(r).alias("kurtosis"), F.max(F.abs(r)).alias("max_abs"))
    return with_quantiles(sums, df.withColumn("_size", F.abs(r)), list(keys), "_size", {"p90_abs": 0.9, "p95_abs": 0.95})


def mean_and_std(df: DataFrame, keys: list[str], columns: list[str], population: bool = True, fill: float | None = None) -> DataFrame:
    """``mean_c`` and ``std_c`` of each column; ``fill`` replaces a NULL."""
    std = F.stddev_pop if population else F.stddev_samp
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), *[x for c in columns for x in (F.avg(c).alias(f"mean_{c}"), std(c).alias(f"std_{c}"))])
    return out.fillna(fill, [f"{p}_{c}" for c in columns for p in ("mean", "std")]) if fill is not None else out


def coverage(df: DataFrame, region: str = "region", label: str = "dw_label_name") -> DataFrame:
    """Samples by region, by class and by both."""
    sets = [[F.col(region)], [F.col(label)], [F.col(region), F.col(label)]]
    return df.groupingSets(sets, region, label).agg(F.grouping_id().alias("grouping"), F.count("*").alias("n_samples"))


def overlap_summary(df: DataFrame, sets: list[list[str]], value: str = "overlap") -> DataFrame:
    keys = list(dict.fromkeys(k for s in sets for k in s))
    v = F.col(value)
    sums = df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.grouping_id().alias("grouping"), F.count(v).alias("n"), F.avg(v).alias("mean_overlap"))
    return with_quantiles(sums, in_sets(df, sets, v), ["grouping", *keys], "_value", {"median_overlap": 0.5, "p10": 0.1, "p90": 0.9})


def audit(df: DataFrame, *, key_columns: list[str], region: str, label: str, block: str, features: list[str], targets: list[str], flat: float = 1e-4) -> DataFrame:
    """One row: sizes, distinct groups, missing share, duplicate rows, near-constant features, and each target's moments."""
    every = [*features, *targets]
    missing = sum((F.avg(F.col(c).isNull().cast("double")) for c in every), F.lit(0.0)) / len(every)
    aggs = [
        F.count("*").alias("n_rows"), F.countDistinct(region).alias("n_regions"), F.countDistinct(label).alias("n_labels"), F.countDistinct(block).alias("n_blocks"),
        missing.alias("missing_share"), (F.count("*") - F.countDistinct(F.struct(*key_columns))).alias("duplicate_rows"),
        sum((F.coalesce((F.var_samp(c) < flat).cast("int"), F.lit(0)) for c in features), F.lit(0)).alias("flat_features"),
    ]
    for t in targets:
        aggs += [F.avg(t).alias(f"{t}_mean"), F.stddev_samp(t).alias(f"{t}_std"), F.min(t).alias(f"{t}_min"), F.max(t).alias(f"{t}_max"), corrected_skewness(F.col(t)).alias(f"{t}_skew")]
    return df.agg(*aggs)


def band_summary(metrics: DataFrame, band: str = "band") -> DataFrame:
    """Mean and median R², mean errors, best and worst band (ties: first by name)."""
    return metrics.agg(
        F.avg("r2").alias("mean_r2"), F.median("r2").alias("median_r2"), F.avg("rmse").alias("mean_rmse"), F.avg("mae").alias("mean_mae"), F.avg("pearson_r").alias("mean_pearson_r"),
        F.min_by(band, F.struct(-F.col("r2"), F.col(band))).alias("best_band"), F.min_by(band, F.struct("r2", band)).alias("worst_band"),
    )


def family_shares(importance: DataFrame, families: list[str]) -> DataFrame:
    """Each feature family's share of positive importance by target, one column per family; 0 without any."""
    positive = importance.groupBy("target", "family").agg(F.sum(F.greatest("importance", F.lit(0.0))).alias("s"))
    total = F.sum("s").over(Window.partitionBy("target"))
    share = positive.withColumn("share", F.coalesce(F.try_divide(F.col("s"), F.nullif(total, F.lit(0.0))), F.lit(0.0)))
    return share.groupBy("target").pivot("family", families).agg(F.first("share")).fillna(0.0, families)


def residual_by_region(df: DataFrame, region: str = "region", residual: str = "residual") -> DataFrame:
    r = F.col(residual)
    sums = df.groupBy(region).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"))
    return with_quantiles(sums, df, [region], residual, {"median": 0.5})


def failure_by_value(df: DataFrame, value: str = "actual", residual: str = "residual", bins: int = 5) -> DataFrame:
    """Errors by quantile bin of the true value: right-closed bins, the lowest edge included, equal edges merged."""
    edges = exact_quantiles(df, [], value, [i / bins for i in range(bins + 1)]).select(F.array_distinct("q").alias("_edges"))
    at = F.greatest(F.size(F.filter("_edges", lambda e: e < F.col(value))), F.lit(1))
    r = F.col(residual)
    out = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(edges)).withColumn("_at", at)
    out = out.withColumn("lo", F.get("_edges", F.col("_at") - 1)).withColumn("hi", F.coalesce(F.get("_edges", F.col("_at")), F.get("_edges", F.col("_at") - 1)))
    return out.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.avg(F.abs(r)).alias("mae"), F.avg(r).alias("bias"), F.sqrt(F.avg(r * r)).alias("rmse"))


def pixel_rmse(df: DataFrame, pairs: list[tuple[str, str]], name: str = "rmse") -> DataFrame:
    """Root mean square error of a pixel over its bands."""
    return df.withColumn(name, F.sqrt(sum(((F.col(p) - F.col(a)) * (F.col(p) - F.col(a)) for a, p in pairs), F.lit(0.0)) / len(pairs)))


def display_limit(df: DataFrame, value: str, p: float = 0.98) -> DataFrame:
    return exact_quantiles(df, [], value, [p]).select(F.col("q")[0].alias("limit"))


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """``z_c`` for each column: minus the mean, over the population std (1 if that is 0)."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    out = df.crossJoin(F.broadcast(stats))
    out = out.withColumns({f"z_{c}": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns})
    return out.drop(*[f"_{x}_{c}" for c in columns for x in "ms"])


def stretch_limits(long: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Per band the limits over truth and prediction together."""
    both = long.select("band", F.explode(F.array("actual", "predicted")).alias("v"))
    return exact_quantiles(both, ["band"], "v", [low, high]).select("band", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def stretched(long: DataFrame, limits: DataFrame) -> DataFrame:
    """Truth and prediction scaled to the band's limits and clipped; equal limits scale by 1."""
    scale = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    clip = lambda c: F.least(F.greatest((F.col(c) - F.col("low")) / scale, F.lit(0.0)), F.lit(1.0))
    return long.join(limits, "band").withColumns({"actual": clip("actual"), "predicted": clip("predicted")}).drop("low", "high")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts of equal bins from least to greatest, which counts in the last bin; bins without rows are 0."""
    limits = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    spread = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    at = F.least(F.floor((F.col(value) - F.col("lo")) / spread * bins), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(limits)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    edges = limits.filter("lo is not null").select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", spread.alias("w"))
    return edges.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("w") * F.col("bin") / bins).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, and whiskers at the extreme values inside 1.5 interquartile ranges."""
    q = exact_quantiles(df, [group], value, [0.25, 0.5, 0.75]).select(group, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return df.join(q, group).groupBy(group, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"))


def spread(metrics: DataFrame, keys: list[str], value: str = "r2") -> DataFrame:
    return metrics.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("spread"))


def success_checks(metrics: DataFrame, overlap: DataFrame, correlation: DataFrame) -> DataFrame:
    """Whether the study met its criteria; inputs are one-row frames."""
    return metrics.crossJoin(F.broadcast(overlap)).crossJoin(F.broadcast(correlation)).select(
        (F.col("r2") > 0.5).alias("r2_over_50"), (F.col("r2") > 0.65).alias("r2_over_65"), (F.col("rmse") < 3).alias("rmse_under_3"), (F.col("mean_overlap") > 0.4).alias("overlap_over_40"), (F.col("pearson_r") > 0.3).alias("correlation_over_30")
    )
