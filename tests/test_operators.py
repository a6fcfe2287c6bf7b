"""Degenerate groups, ties, empty tables, and that results don't depend on partitioning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.stats import hash01, safe_r
from gridloom.operators import compositing as g
from gridloom.operators import metrics as m
from gridloom.operators import models as o
from gridloom.operators import projections as p
from gridloom.operators import ranking as w
from gridloom.operators import sampling as x
from gridloom.operators import similarity as s
from gridloom.sources import scratch, tables


def test_metrics_on_degenerate_groups(spark):
    df = spark.createDataFrame([("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("one", 5.0, 5.5), ("null", None, 1.0), ("good", 1.0, 1.1), ("good", 2.0, 1.9), ("good", 3.0, 3.2)], "g string, actual double, predicted double")
    out = {r.g: r for r in m.metrics_by(df, "g").collect()}
    assert out["flat"].r2 is None and out["flat"].pearson_r is None and out["flat"].mae == 1.5
    assert out["one"].r2 is None and out["null"].n == 0 and out["null"].rmse is None
    assert out["good"].r2 == pytest.approx(1 - 0.06 / 2)
    assert {r.g: r.r2 for r in m.metrics_by(df, "g", zero_variance=0.0).collect()}["flat"] == 0.0


def test_safe_r_on_empty(spark):
    assert spark.createDataFrame([], "x double, y double").agg(safe_r(F.col("x"), F.col("y"))).first()[0] is None


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_draws_do_not_depend_on_partitions(spark, parts):
    df = spark.range(500).withColumn("stratum", F.col("id") % 3).repartition(parts)
    take = lambda d: sorted(r[0] for r in d.select("id").collect())
    base = spark.range(500).withColumn("stratum", F.col("id") % 3)
    assert take(x.bernoulli(df, ["id"], 0.2, 1)) == take(x.bernoulli(base, ["id"], 0.2, 1))
    assert take(x.stratified_sample(df, ["stratum"], "id", 7)) == take(x.stratified_sample(base, ["stratum"], "id", 7))
    ids = x.consecutive_ids(df, ["id"]).select("id", "sample_id").collect()
    assert all(r.id == r.sample_id for r in ids) and len(ids) == 500
    split = x.random_holdout(df, "id", 0.2, 42).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"test": 100, "train": 400}


def test_quantile_bins_differ_from_ntile(spark):
    for n in (5, 6, 7, 10):
        df = spark.range(n).select(F.col("id").alias("k"), F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
        got = [r.b for r in x.quantile_bin(df, ["g"], "v", "k", 4, "b").orderBy("k").collect()]
        assert got == [max(math.ceil(i * 4 / (n - 1)) - 1, 0) for i in range(n)]


def test_grouped_folds_keep_blocks_whole(spark):
    df = spark.range(400).select(F.col("id"), F.concat(F.lit("b"), F.col("id") % 20).alias("block"), (F.col("id") % 4).cast("string").alias("label"))
    out = x.grouped_folds(df, "block", "label", 4, 42)
    assert out.groupBy("block").agg(F.countDistinct("fold").alias("n")).filter("n > 1").isEmpty()
    assert {r["count"] for r in out.groupBy("fold").count().collect()} == {100}
    assert out.count() == 400


def test_windows_have_short_edges(spark):
    size = spark.createDataFrame([("t", 5, 7), ("none", 0, 3)], "tile string, height long, width long")
    out = tables.windows(size, 3).collect()
    assert len(out) == 6 and sum(r.rows * r["cols"] for r in out) == 35


def test_offsets_and_missing_columns(spark):
    df = spark.createDataFrame([("a-512-1024.tif",), ("plain.tif",)], "n string")
    row, col = tables.tile_offset(F.col("n"))
    assert [tuple(r) for r in df.select(row, col).collect()] == [(512, 1024), (0, 0)]
    with pytest.raises(ValueError):
        tables.require_columns(df, "n", "gone")


def test_mosaic_mode_and_clouds(spark):
    df = spark.createDataFrame([(1, 10, 1, "b", 0), (1, 10, 2, "a", 1 << 10), (2, 5, 3, "a", 1 << 11), (2, 6, 4, "c", 3)], "pixel_id int, ts int, scene_id int, label string, qa60 int")
    assert {r.pixel_id: r.label for r in g.mosaic(df, ["label"]).collect()} == {1: "a", 2: "c"}
    assert {r.pixel_id: r.label for r in g.mode_composite(df, "label").collect()} == {1: "a", 2: "a"}
    clear = df.withColumn("v", g.cloud_free(F.lit(100.0), scale=1.0)).orderBy("scene_id").collect()
    assert [r.v for r in clear] == [100.0, None, None, 100.0]


def test_dominant_takes_the_first_on_ties(spark):
    name, value = p.dominant(["a", "b", "c"])
    r = spark.createDataFrame([(0.1, 0.4, 0.4)], "a double, b double, c double").select(name.alias("n"), value.alias("v")).first()
    assert (r.n, r.v) == ("b", 0.4)


def test_spatial_knn_over_strips(spark):
    r = np.random.default_rng(5)
    xy = r.normal(size=(120, 2))
    xy[7] = xy[8]
    df = spark.createDataFrame([("a" if i < 100 else "b", i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "g string, id long, x_km double, y_km double")
    got = {(r.i, r["rank"]): r.distance for r in s.spatial_knn(df, ["g"], "id", 3, cell=10).collect()}
    for i in range(120):
        group = range(100) if i < 100 else range(100, 120)
        d = sorted(math.dist(xy[i], xy[j]) for j in group if j != i)
        assert [got[i, k] for k in (1, 2, 3)] == pytest.approx(d[:3])


def test_spatial_knn_in_tiles(spark):
    """Many points at one place, lone points, a small group: neighbours as by brute force, and ties by key."""
    r = np.random.default_rng(8)
    xy = np.concatenate([np.repeat(r.normal(size=(3, 2)), 70, 0), r.normal(size=(160, 2)).round(1), [[40.0, 40.0], [-60.0, 3.0]]])
    group = ["b" if i % 90 == 5 else "a" for i in range(len(xy))]
    df = spark.createDataFrame([(group[i], i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "g string, id long, x_km double, y_km double").repartition(5)
    got = {(row.i, row["rank"]): (row.j, row.distance) for row in s.spatial_knn(df, ["g"], "id", 4, cell=12).collect()}
    d = np.sqrt((xy[:, 0][:, None] - xy[:, 0]) ** 2 + (xy[:, 1][:, None] - xy[:, 1]) ** 2)
    want = {}
    for i in range(len(xy)):
        others = sorted((d[i, j], j) for j in range(len(xy)) if j != i and group[j] == group[i])[:4]
        want |= {(i, n): (j, e) for n, (e, j) in enumerate(others, 1)}
    assert got == want


def test_spatial_pairs_do_not_grow_with_the_square(spark):
    """Rows that any step hands on stay a small multiple of the points."""
    df = spark.range(4000).select(F.lit("a").alias("g"), "id", hash01("id", seed=1).alias("x_km"), hash01("id", seed=2).alias("y_km"))
    plan = s.spatial_knn(df, ["g"], "id", 3, cell=40)
    assert plan.count() == 12000
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text and "Window [row_number() windowspecdefinition(g" in text and "(x - x2)" not in text
    assert "Window" not in p.local_km(df.withColumnsRenamed({"x_km": "longitude", "y_km": "latitude"}), ["g"])._jdf.queryExecution().toString()


def test_morans_i_of_a_line(spark):
    df = spark.createDataFrame([("a", i, float(i), 0.0, float(i)) for i in range(6)] + [("b", 10, 0.0, 0.0, 1.0)], "g string, id long, x_km double, y_km double, v double")
    edges = s.spatial_knn(df, ["g"], "id", 2)
    out = {r.g: r for r in s.morans_p(df, s.inverse_distance_weights(edges, ["g"]), ["g"], "id", "v", permutations=19).collect()}
    assert out["b"].morans_i is None and out["a"].morans_i > 0.3 and 0 < out["a"].p_value <= 1


def test_mean_pairwise_cosine_equals_pairs(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(9, 4))
    df = spark.createDataFrame([("a", x.tolist()) for x in v] + [("alone", v[0].tolist())], "g string, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = ((u @ u.T).sum() - 9) / 72
    out = s.mean_pairwise_cosine(df, ["g"]).collect()
    assert len(out) == 1 and out[0].mean_cosine == pytest.approx(want)


def test_ridge_equals_closed_form(spark):
    r = np.random.default_rng(2)
    X, e = r.normal(size=(200, 3)), r.normal(size=200)
    y = X @ [1.0, -2.0, 0.5] + 3 + 0.1 * e
    df = spark.createDataFrame([(*map(float, a), float(b), 1) for a, b in zip(X, y, strict=True)], "a double, b double, c double, y double, k int")
    xc, yc = X - X.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    model = o.ridge(p.feature_vector(df, ["a", "b", "c"]), "y", "hat")
    assert model.coefficients.toArray() == pytest.approx(want, abs=1e-9)
    assert o.ridge_fits(df, ["k"], ["a", "b", "c"], "y").first().coefficients[1:] == pytest.approx(want.tolist(), abs=1e-9)


def test_ranks_jumps_and_outliers(spark):
    df = spark.createDataFrame([("t", "a", 3.0, 1.0), ("t", "b", 3.0, 2.0), ("t", "c", 1.0, 3.0)], "target string, feature string, u double, v double")
    out = {r.feature: (r.rank_1, r.rank_2) for r in w.feature_ranking(df, "u", "v").collect()}
    assert out == {"a": (1, 3), "b": (1, 2), "c": (3, 1)}
    assert [r.feature for r in w.outliers(df, "u", "feature", 2).orderBy("outlier_rank").collect()] == ["a", "b"]


def test_histogram_counts_everything(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "v double")
    out = m.histogram(df, "v", 5).orderBy("bin").collect()
    assert [r.n for r in out] == [2, 2, 2, 2, 3]
    assert m.histogram(df.limit(0), "v", 5).count() == 0


def test_checks_raise(spark):
    df = spark.createDataFrame([("train", 1.0), ("train", None)], "split string, filled double")
    with pytest.raises(ValueError):
        p.require_splits(df)
    with pytest.raises(ValueError):
        p.require_filled(df)
    with pytest.raises(ValueError):
        x.bernoulli(df, ["split"], 0.0, 1)
    assert df.select(hash01("split", seed=1).alias("u")).filter("u >= 0 and u < 1").count() == 2


def test_scratch_folders_are_shared_on_clusters():
    assert [scratch.single_machine(x) for x in ("local", "local[8]", "local[*]", "local-cluster[3,2,1000]", "spark://a:7077", "yarn")] == [True, True, True, False, False, False]
