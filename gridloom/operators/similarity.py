"""Overlaps, distances and spatial autocorrelation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.stats import hash01, p_value, safe_r
from gridloom.functions.vectors import dot, unit
from gridloom.operators.sampling import ranks_within
from gridloom.sources.scratch import durable

#: The box of a tile, and the box of all that its places can reach.
_BOX = ["x_lo", "x_hi", "y_lo", "y_hi", "from_x", "to_x", "from_y", "to_y"]


def _tiles(places: DataFrame, group: list[str], cell: int) -> DataFrame:
    """Places with ``strip`` and ``tile``: strips along x, each cut along y, so that a tile is compact and has about ``cell`` places however these lie."""
    in_strips = ranks_within(places, group, ["x", "y"], "_r", "_n")
    in_strips = in_strips.withColumn("strip", F.floor((F.col("_r") - 1) * F.ceil(F.sqrt(F.col("_n") / cell)) / F.col("_n"))).drop("_r", "_n")
    in_tiles = ranks_within(in_strips, [*group, "strip"], ["y", "x"], "_r", "_n")
    return in_tiles.withColumn("tile", F.floor((F.col("_r") - 1) * F.greatest(F.round(F.col("_n") / cell), F.lit(1)) / F.col("_n"))).drop("_r", "_n")


def _doubles(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten())


def _gaps(x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    dx, dy = x[:, None] - x2, y[:, None] - y2
    return np.sqrt(dx * dx + dy * dy)


def _kth(d: np.ndarray, k: int) -> np.ndarray:
    return np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)


def spatial_knn(points: DataFrame, group: list[str], key: str, k: int = 8, x: str = "x_km", y: str = "y_km", cell: int = 512) -> DataFrame:
    """(group, i, j, distance, rank): the k nearest other points of the same group on a plane, ties by j.

    Points at one place share their neighbours: a place keeps its k + 1 least keys. Places lie in compact tiles of about
    ``cell``. Within a tile each place finds how far its k + 1 nearest can be; a tile then meets, two packs at a time, only the tiles
    whose box is within that reach, and hands on only what is within it. Points without a place have no neighbours.
    """
    want = k + 1
    cell = max(cell, 2 * want)
    keys = [F.col(g) for g in group]
    p = durable(points.select(*keys, F.col(key).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null"))
    least = p.withColumn("_o", F.row_number().over(Window.partitionBy(*group, "x", "y").orderBy("i"))).filter(F.col("_o") <= want)
    places = durable(least.groupBy(*group, "x", "y").agg(F.sort_array(F.collect_list("i")).alias("ids")).withColumn("at", F.col("ids")[0]))
    packed = _tiles(places, group, cell).groupBy(*group, "strip", "tile").agg(F.collect_list(F.struct("at", "x", "y", "ids")).alias("p"))
    packed = packed.select(*group, "strip", "tile", "p.at", "p.x", "p.y", "p.ids")
    n = len(group)

    def bound(batches):
        for b in (b.slice(s, 1) for b in batches for s in range(b.num_rows)):
            px, py = _doubles(b.column(n + 3)), _doubles(b.column(n + 4))
            of = np.repeat(np.arange(len(px)), np.asarray(b.column(n + 5).flatten().value_lengths()))
            reach = _kth(_gaps(px, py, px[of], py[of]), want)
            far = reach * (1 + 1e-9)
            box = [px.min(), px.max(), py.min(), py.max(), (px - far).min(), (px + far).max(), (py - far).min(), (py + far).max()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array([0, len(px)], pa.int32()), pa.array(reach)), *(pa.array([v], pa.float64()) for v in box)], names=[*b.schema.names, "reach", *_BOX])

    packs = durable(packed.mapInArrow(bound, T.StructType([*packed.schema.fields, T.StructField("reach", T.ArrayType(T.DoubleType())), *(T.StructField(c, T.DoubleType()) for c in _BOX)])))
    # A group has about as many strips as a strip has tiles: their ranges are few, and tiles meet strips first.
    boxes = packs.select(*group, "strip", "tile", *_BOX[:4])
    strips = boxes.groupBy(*group, "strip").agg(F.min("x_lo").alias("s_lo"), F.max("x_hi").alias("s_hi"))
    visits = packs.select(*group, F.col("strip").alias("_strip"), F.col("tile").alias("_tile"), *_BOX[4:]).join(strips, group).filter("s_lo <= to_x and s_hi >= from_x")
    visits = visits.join(boxes, [*group, "strip"]).filter("x_lo <= to_x and x_hi >= from_x and y_lo <= to_y and y_hi >= from_y").select(*group, "_strip", "_tile", "strip", "tile")
    asking = packs.select(*group, F.col("strip").alias("_strip"), F.col("tile").alias("_tile"), "at", F.col("x").alias("ax"), F.col("y").alias("ay"), "reach")
    met = visits.join(packs.select(*group, "strip", "tile", "x", "y", "ids").hint("merge"), [*group, "strip", "tile"]).join(asking.hint("merge"), [*group, "_strip", "_tile"]).select(*group, "at", "ax", "ay", "reach", "x", "y", "ids")

    def meet(batches):
        for b in (b.slice(s, 1) for b in batches for s in range(b.num_rows)):
            at, held = b.column(n).flatten(), b.column(n + 6).flatten()
            of = np.repeat(np.arange(len(held)), np.asarray(held.value_lengths()))
            d = _gaps(*map(_doubles, b.columns[n + 1 : n + 3]), _doubles(b.column(n + 4))[of], _doubles(b.column(n + 5))[of])
            row, col = np.nonzero(d <= np.minimum(_doubles(b.column(n + 3)), _kth(d, want))[:, None])
            same = pa.array(np.zeros(len(row), np.int32))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(same) for i in range(n)), at.take(pa.array(row)), held.flatten().take(pa.array(col)), pa.array(d[row, col])], names=[*group, "at", "j", "distance"])

    fields = [p.schema[g] for g in group]
    found = met.mapInArrow(meet, T.StructType([*fields, T.StructField("at", p.schema["i"].dataType), T.StructField("j", p.schema["i"].dataType), T.StructField("distance", T.DoubleType())]))
    near = found.withColumn("_o", F.row_number().over(Window.partitionBy(*group, "at").orderBy("distance", "j"))).filter(F.col("_o") <= want)
    near = near.groupBy(*group, "at").agg(F.sort_array(F.collect_list(F.struct("distance", "j"))).alias("near"))
    own = p.join(places.select(*group, "x", "y", "at"), [*group, "x", "y"]).join(near, [*group, "at"])
    others = F.slice(F.filter("near", lambda v: v["j"] != F.col("i")), 1, k)
    return own.select(*group, "i", F.posexplode(others).alias("rank", "v")).select(*group, "i", "v.j", "v.distance", (F.col("rank") + 1).alias("rank"))


def inverse_distance_weights(edges: DataFrame, group: list[str], floor: float = 1e-9) -> DataFrame:
    """Row-standardised weights over each point's neighbours."""
    inverse = 1 / F.greatest("distance", F.lit(floor))
    return edges.withColumn("w", inverse / F.sum(inverse).over(Window.partitionBy(*group, "i"))).select(*group, "i", "j", "w")


def centred(points: DataFrame, group: list[str], key: str, value: str) -> DataFrame:
    """(group, i, z): the value minus its group's mean."""
    means = points.groupBy(*group).agg(F.avg(value).alias("_mean"))
    return points.select(*group, F.col(key).alias("i"), F.col(value).alias("_v")).join(means, group).select(*group, "i", (F.col("_v") - F.col("_mean")).alias("z"))


def morans_i(points: DataFrame, weights: DataFrame, group: list[str], key: str, value: str) -> DataFrame:
    """Per group n and Moran's I over an edge table of weights; NULL under four points or without variance."""
    z = centred(points, group, key, value)
    totals = z.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("zz"))
    lag = weights.join(z, [*group, "i"]).join(z.withColumnsRenamed({"i": "j", "z": "z2"}), [*group, "j"])
    sums = lag.groupBy(*group).agg(F.sum(F.col("w") * F.col("z") * F.col("z2")).alias("zwz"), F.sum("w").alias("ww"))
    out = totals.join(sums, group, "left")
    return out.select(*group, "n", F.when((F.col("n") >= 4) & (F.col("zz") > 0), F.try_divide(F.col("n") * F.col("zwz"), F.col("ww") * F.col("zz"))).alias("morans_i"))


def permuted(rows: DataFrame, group: list[str], key: str, value: str, permutations: int, seed: int) -> DataFrame:
    """(group, key, ``value``): an array with the value that each row gets in each permutation of its group.

    A permutation gives every row the value of the row of equal rank in the order of a draw that depends on
    the permutation. Ranks are taken in range partitions, so a group of any size is spread.
    """
    narrow = rows.select(*group, key, value)
    own = ranks_within(narrow.select(*group, key), group, [key], "_rank")
    each = narrow.withColumn("_perm", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("_u", hash01(key, "_perm", seed=seed))
    drawn = ranks_within(each.withColumnRenamed(key, "_from"), [*group, "_perm"], ["_u", "_from"], "_rank").select(*group, "_perm", "_rank", value)
    dealt = own.join(drawn, [*group, "_rank"]).groupBy(*group, key).agg(F.array_sort(F.collect_list(F.struct("_perm", value))).alias("_all"))
    return dealt.select(*group, key, F.transform("_all", lambda x: x[value]).alias(value))


def morans_p(points: DataFrame, weights: DataFrame, group: list[str], key: str, value: str, permutations: int = 499, seed: int = 42) -> DataFrame:
    """Moran's I and its two-sided permutation p-value. Each point carries its values under all permutations, so the edges are joined once."""
    weights = durable(weights)
    observed = morans_i(points, weights, group, key, value)
    z = centred(points, group, key, value)
    arrays = durable(permuted(z, group, "i", "z", permutations, seed))
    lag = weights.join(arrays, [*group, "i"]).join(arrays.withColumnsRenamed({"i": "j", "z": "z2"}), [*group, "j"])
    products = lag.select(*group, F.posexplode(F.zip_with("z", "z2", lambda a, b: a * b * F.col("w"))).alias("perm", "v"))
    scores = products.groupBy(*group, "perm").agg(F.sum("v").alias("zwz"))
    totals = z.groupBy(*group).agg(F.count("*").alias("n_all"), F.sum(F.col("z") * F.col("z")).alias("zz")).join(weights.groupBy(*group).agg(F.sum("w").alias("ww")), group)
    scores = scores.join(totals, group).withColumn("score", F.try_divide(F.col("n_all") * F.col("zwz"), F.col("ww") * F.col("zz")))
    hits = scores.join(observed, group).groupBy(*group).agg(F.count_if(F.abs("score") >= F.abs("morans_i")).alias("hits"))
    return observed.join(hits, group, "left").withColumn("p_value", F.when(F.col("morans_i").isNotNull(), (F.coalesce("hits", F.lit(0)) + 1) / (permutations + 1))).drop("hits")


def neighbour_overlap(a: DataFrame, b: DataFrame, ks: list[int]) -> DataFrame:
    """(query, k, overlap): share of common neighbours in two edge lists, each of which is made once."""
    a, b = (durable(x.select("query", "neighbour", "rank")) for x in (a, b))
    both = a.withColumnRenamed("rank", "r1").join(b.withColumnRenamed("rank", "r2"), ["query", "neighbour"]).withColumn("worst", F.greatest("r1", "r2"))
    queries = a.select("query").union(b.select("query")).distinct().withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    common = both.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("worst <= k").groupBy("query", "k").agg(F.count("*").alias("n"))
    return queries.join(common, ["query", "k"], "left").select("query", "k", (F.coalesce("n", F.lit(0)) / F.col("k")).alias("overlap"))


def pair_differences(df: DataFrame, key: str, value: str, group: list[str]) -> DataFrame:
    """(group, n_pairs, total): the sum of |x - y| over all unordered pairs of a group, without making the pairs.

    The value of rank i of n is the larger one in i - 1 pairs and the smaller one in n - i.
    """
    ranked = ranks_within(df.filter(F.col(value).isNotNull()).select(*group, key, value), group, [value, key], "_i", "_n")
    share = (2 * F.col("_i") - F.col("_n") - 1) * F.col(value)
    return ranked.groupBy(*group).agg((F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("n_pairs"), F.sum(share).alias("total"))


def average_ranks(df: DataFrame, value: str, name: str, group: list[str] = (), keys: list[str] = ()) -> DataFrame:
    """Ranks with ties at their mean. Rows are ranked in range partitions, ``keys`` spreading ties, and each value takes the mean of its ranks."""
    group = list(group)
    ranked = durable(ranks_within(df, group, [value, *keys], "_rank"))
    means = ranked.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(value).alias("_value")).agg(F.avg("_rank").alias(name))
    same = F.col(value).eqNullSafe(F.col("_value"))
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return ranked.join(means, same).drop("_rank", "_value", *[f"_g{i}" for i in range(len(group))])


def distance_correlation(pairs: DataFrame, x: str, y: str, group: list[str] = (), keys: list[str] = ()) -> DataFrame:
    """n_pairs, and Pearson and Spearman correlation of two distances with their p-values."""
    # Written once: range partitions read their input twice, and it may be a join of vectors.
    narrow = durable(pairs.select(*group, *keys, x, y))
    ranked = average_ranks(average_ranks(narrow, x, "_rx", group, keys), y, "_ry", group, keys)
    found = ranked.groupBy(*group).agg(F.count("*").alias("n_pairs"), safe_r(F.col(x), F.col(y)).alias("pearson_r"), safe_r(F.col("_rx"), F.col("_ry")).alias("spearman_rho"))
    return found.withColumn("pearson_p", p_value(F.col("pearson_r"), F.col("n_pairs"))).withColumn("spearman_p", p_value(F.col("spearman_rho"), F.col("n_pairs")))


def pair_distances(df: DataFrame, pairs: DataFrame, key: str, vector: str, values: list[str]) -> DataFrame:
    """(group, a, b, cosine, euclidean) of pairs of keys: cosine distance of vectors, and Euclidean distance of values."""
    # Lengths are taken once for each row, not for each pair.
    rows = durable(df.select(F.col(key).alias("a"), unit(F.col(vector)).alias("_va"), F.array(*values).alias("_xa")))
    one, two = rows, rows.withColumnsRenamed({"a": "b", "_va": "_vb", "_xa": "_xb"})
    met = pairs.join(one, "a").join(two, "b")
    square = F.aggregate(F.zip_with("_xa", "_xb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return met.withColumn("cosine", F.round(1 - dot(F.col("_va"), F.col("_vb")), 9)).withColumn("euclidean", F.round(F.sqrt(square), 9)).drop("_va", "_vb", "_xa", "_xb")


def mean_pairwise_cosine(df: DataFrame, group: list[str], vector: str = "embedding") -> DataFrame:
    """(group, n, mean_cosine) over all pairs of a group in one pass: (|sum u|² - sum |u|²) / (n (n - 1)) with unit vectors u."""
    long = df.select(*group, F.posexplode(unit(F.col(vector))).alias("i", "u"))
    sums = long.groupBy(*group, "i").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("q"))
    total = sums.groupBy(*group).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"))
    sizes = df.groupBy(*group).agg(F.count("*").alias("n")).filter("n >= 2")
    return sizes.join(total, group).select(*group, "n", ((F.col("ss") - F.col("qq")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))


def effective_size(df: DataFrame, group: list[str]) -> DataFrame:
    """Kish's effective number of groups, mean and greatest size, and how many groups."""
    n = F.col("n").cast("double")
    return df.groupBy(*group).agg(F.count("*").alias("n")).agg((F.sum(n) * F.sum(n) / F.sum(n * n)).alias("effective_n"), F.avg(n).alias("mean_size"), F.max("n").alias("max_size"), F.count("*").alias("n_groups"))


def duplicate_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows beyond the first of each vector."""
    return df.groupBy(vector).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def feature_target_correlation(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """(feature, target, n, pearson_r, abs_r): values are spread to rows and summed by pair."""
    f = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])).alias("f")
    t = F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).cast("double").alias("y")) for c in targets])).alias("t")
    long = df.select(*targets, f).select("f", t).select("f.feature", "f.x", "t.target", "t.y").filter("x is not null and y is not null")
    out = long.groupBy("feature", "target").agg(F.count("*").alias("n"), safe_r(F.col("x"), F.col("y")).alias("pearson_r"))
    return out.withColumn("abs_r", F.abs("pearson_r"))
