"""Derived columns, masks and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.vectors import all_finite


def valid_pixel(bands: list[str], embedding: str | None = None) -> Column:
    """All bands, and all values of the embedding, are finite."""
    ok = [F.col(b).isNotNull() & ~F.isnan(b) & (F.abs(F.col(b)) < float("inf")) for b in bands]
    return reduce(lambda a, b: a & b, ok + ([F.col(embedding).isNotNull() & all_finite(F.col(embedding))] if embedding else []))


def confidence(names: list[str], chosen: Column) -> Column:
    """The value of the column that ``chosen`` names."""
    return F.element_at(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]), chosen)


def dominant(names: list[str]) -> tuple[Column, Column]:
    """(name, value) of the greatest of some columns, the first on ties."""
    values = F.array(*names)
    top = F.greatest(*names)
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(values, top).cast("int")), top


def ratio_targets(df: DataFrame, vv: str, vh: str, space: str | None = None, floor: float = 1e-6) -> DataFrame:
    """Add ratio, log_ratio and ratio_space.

    The direct quotient is used only if it is finite and positive for every row, else all
    rows are taken for decibels and the ratio is 10^((vv - vh) / 10) over linear powers.
    That depends on the whole table; ``space`` ('direct' or 'linear') fixes it.
    """
    direct = F.col(vv) / F.greatest(F.col(vh), F.lit(floor))
    power = lambda c: F.pow(F.lit(10.0), F.col(c) / 10)
    linear = power(vv) / F.greatest(power(vh), F.lit(floor))
    if space is None:
        flag = df.agg(F.coalesce(F.bool_and((direct > 0) & (direct < float("inf"))), F.lit(False)).alias("_direct"))
        df = df.crossJoin(F.broadcast(flag))
        use = F.col("_direct")
    else:
        use = F.lit(space == "direct")
    out = df.withColumn("ratio", F.when(use, direct).otherwise(linear)).withColumn("log_ratio", F.ln("ratio")).withColumn("ratio_space", F.when(use, "direct").otherwise("linear"))
    return out.drop("_direct")


def residuals(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.withColumn("residual", F.col(predicted) - F.col(actual)).withColumn("abs_residual", F.abs("residual"))


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A double column ``<column>_<value>`` for each value."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in values})


def feature_array(df: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    """One array of all columns as doubles; rows with a missing value are left out.

    A filter on each of a hundred columns would make the optimiser's constraints explode.
    """
    values = df.withColumn(output, F.array(*[F.col(c).cast("double") for c in columns]))
    return values.filter(F.forall(output, lambda x: x.isNotNull() & ~F.isnan(x)))


def feature_vector(df: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    """One vector column for the models; rows with a missing value are left out."""
    return feature_array(df, columns, output).withColumn(output, array_to_vector(output))


def spread_embedding(df: DataFrame, width: int = 64, column: str = "embedding") -> DataFrame:
    """Columns A00, A01, ... of an embedding."""
    return df.withColumns({f"A{i:02d}": F.element_at(column, i + 1).cast("double") for i in range(width)})


def prefer(df: DataFrame, column: str, first: str, second: str) -> DataFrame:
    """``column`` from ``first`` where that is known, else from ``second``; both go."""
    return df.withColumn("_value", F.coalesce(first, second)).drop(first, second).withColumnRenamed("_value", column)


def feature_family(name: Column) -> Column:
    """Embedding for any name that starts with A, region for one-hot regions, else context."""
    return F.when(name.startswith("A"), "embedding").when(name.startswith("region_"), "region").otherwise("context")


def display_label(value: Column, names: dict[str, str]) -> Column:
    """A label from a map, the value itself where the map has none."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[value], value)


def fixed(value: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", value.cast("double"))


def percent(value: Column, digits: int = 4) -> Column:
    """Percent without trailing zeros."""
    return F.concat(F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", value.cast("double")), "0+$", ""), r"\.$", ""), F.lit("%"))


def local_km(df: DataFrame, group: list[str], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """x_km and y_km on a plane at each group's mean latitude. Means are summed up before they meet the rows, so that no task holds a group."""
    means = df.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg(F.avg(lat).alias("_mean"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.lit(True))
    placed = df.join(F.broadcast(means), same).drop(*[f"_g{i}" for i in range(len(group))])  # a row for each group
    return placed.withColumn("x_km", F.col(lon) * 111.32 * F.cos(F.radians("_mean"))).withColumn("y_km", F.col(lat) * 110.57).drop("_mean")


def in_bounds(df: DataFrame, height: int, width: int, row: str = "image_row", col: str = "image_col") -> DataFrame:
    return df.filter((F.col(row) >= 0) & (F.col(row) < height) & (F.col(col) >= 0) & (F.col(col) < width))


def significant(p: Column, level: float = 0.05) -> Column:
    """False where p is not known."""
    return F.coalesce(p < level, F.lit(False))


def neighbour_text(df: DataFrame, key: str, rank: str, label: Column, name: str = "neighbours") -> DataFrame:
    """Labels of a query's neighbours in order of rank, comma-separated."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), label.alias("l"))))
    return df.groupBy(key).agg(F.array_join(F.transform(pairs, lambda x: x["l"]), ", ").alias(name))


def curve_assessment(gain: Column) -> Column:
    """What the last step of a learning curve says."""
    return F.when(gain >= 0.02, "still improving").when(gain >= 0.01, "slowing").otherwise("flat")


def data_verdict(assessment: Column, best_r2: Column, cv_std: Column) -> Column:
    return F.when((assessment == "flat") & (best_r2 >= 0.85) & (cv_std <= 0.05), "sufficient").when(assessment == "still improving", "more data would help").otherwise("mixed")


def require_splits(df: DataFrame, split: str = "split") -> DataFrame:
    """The same frame; an error if train or test is empty."""
    n = df.agg(F.count_if(F.col(split) == "train").alias("train"), F.count_if(F.col(split) == "test").alias("test")).first()
    if not n.train or not n.test:
        raise ValueError(f"train has {n.train} rows and test {n.test}")
    return df


def stretch(x: Column, low: float = 0.02, width: float = 0.28, gamma: float = 1 / 1.15) -> Column:
    """Into [0, 1] with a gamma."""
    return F.pow(F.least(F.greatest((x - low) / width, F.lit(0.0)), F.lit(1.0)), F.lit(gamma))


def fill_image(df: DataFrame, observed: str, predicted: str, is_train: str = "is_train", predict_all: bool = False) -> DataFrame:
    """Column ``filled``: the observed value at training pixels, the prediction elsewhere; and ``is_gap``."""
    copy = F.lit(False) if predict_all else F.col(is_train)
    return df.withColumn("filled", F.when(copy, F.col(observed)).otherwise(F.col(predicted))).withColumn("is_gap", ~F.col(is_train))


def require_filled(df: DataFrame, filled: str = "filled") -> DataFrame:
    """The same frame; an error if a valid pixel has no value."""
    if missing := df.agg(F.count_if(F.col(filled).isNull())).first()[0]:
        raise ValueError(f"{missing} valid pixels have no prediction")
    return df


def require_none_missing(summary: DataFrame, missing: str = "missing") -> DataFrame:
    """A summary without its count of pixels that have no value; an error if there are any. It is read twice, so it should be stored."""
    if n := summary.agg(F.sum(missing)).first()[0]:
        raise ValueError(f"{n} valid pixels have no prediction")
    return summary.drop(missing)
