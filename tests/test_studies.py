"""Sums of products, nested samples, pair draws, folds, quantiles, neighbours and permutations against plain versions."""

import math
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.functions.stats import p_value
from gridloom.functions.vectors import unit
from gridloom.operators import gramian as gr
from gridloom.operators import metrics as m
from gridloom.operators import models as o
from gridloom.operators import neighbours, quantiles, studies
from gridloom.operators import projections as p
from gridloom.operators import sampling as x
from gridloom.operators import similarity as s
from gridloom.plans import analytics, modelling
from gridloom.sources import tiles


@pytest.fixture(scope="module")
def table(spark):
    """(frame, matrix, parts): 300 rows of four numbers, some missing, in three parts."""
    r = np.random.default_rng(1)
    v = r.normal(size=(300, 4)) + [0, 5, -3, 1]
    v[:, 3] += v[:, 0] * 2
    part = r.integers(0, 3, 300)
    rows = [(i, *[None if i % 50 == 7 and j == i % 4 else float(a) for j, a in enumerate(row)], None if i % 60 == 1 else f"p{part[i]}") for i, row in enumerate(v)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y double, part string").repartition(7)
    good = np.array([i % 50 != 7 for i in range(300)])
    return df, v, np.array([r[5] or "" for r in rows]), good


def test_matrices_and_metrics(spark, table):
    df, v, part, good = table
    df = df.withColumn("whole", F.lit("all"))
    by_part, whole = gr.gram_matrices(df, ["a", "b", "c", "y"], ["part", "whole"])
    for name, found in [*((p, by_part[p]) for p in ("p0", "p1", "p2")), ("all", whole["all"])]:
        own = good & ((part == name) | (name == "all"))
        one = np.column_stack([np.ones(own.sum()), v[own]])
        assert np.allclose(found, one.T @ one)
        w = gr.ridge_weights(found, [1, 2, 3], 4)
        xc, yc = v[own, :3] - v[own, :3].mean(0), v[own, 3] - v[own, 3].mean()
        assert np.allclose(w[1:4], np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)) and w[4] == 0
        p, y = w[0] + v[own, :3] @ w[1:4], v[own, 3]
        got = gr.metrics_of(found, w, 4)
        assert got["n"] == own.sum() and got["rmse"] == pytest.approx(np.sqrt(np.mean((p - y) ** 2))) and got["r2"] == pytest.approx(1 - ((p - y) ** 2).sum() / (yc**2).sum())
        assert got["pearson_r"] == pytest.approx(np.corrcoef(p, y)[0, 1]) and got["bias"] == pytest.approx(0, abs=1e-9)
        g, label = (1, "all") if name == "all" else (0, name)
        assert gr.absolute_errors(df, ["a", "b", "c", "y"], ["part", "whole"], [gr.Case(g, label, 4, tuple(w)), gr.Case(g, "none", 4, tuple(w))]) == [pytest.approx(np.abs(p - y).mean()), None]
    assert gr.gram_matrices(df.limit(0), ["a"], ["part"]) == [{}]


def test_correlations_and_constants(spark, table):
    df, v, _, good = table
    out = {(r.a, r.b): r.r for r in gr.correlation_pairs(df.withColumn("one", F.lit(7.3)), ["a", "b", "y", "one"]).collect()}
    assert len(out) == 6 and out["a", "y"] == pytest.approx(np.corrcoef(v[good][:, 0], v[good][:, 3])[0, 1]) and out["a", "one"] is None
    assert gr.correlation_pairs(df.limit(0), ["a", "b"]).count() == 0


@pytest.mark.parametrize("parts", [1, 9])
def test_nested_bins(spark, parts):
    rows = [(i, ("u", "v", None)[i % 3] if i < 90 else "one") for i in range(91)]
    df = spark.createDataFrame(rows, "k long, g string").repartition(parts)
    third = F.greatest(F.lit(1), F.bround(F.col("_n") * 0.34))
    out = x.nested_bins(df, ["g"], "k", [third, F.col("_n")], 5, "bin").collect()
    count = {(g, b): sum(r.g == g and r.bin == b for r in out) for g in ("u", "v", None, "one") for b in (0, 1, 2)}
    assert count == {**{(g, b): (10, 20, 0)[b] for g in ("u", "v", None) for b in (0, 1, 2)}, ("one", 0): 1, ("one", 1): 0, ("one", 2): 0}
    first = {r.k for r in out if r.g == "u" and r.bin == 0}
    assert first == {r.k for r in x.nested_bins(df.filter("g = 'u'"), [], "k", [F.lit(10)], 5, "bin").filter("bin = 0").collect()}


@pytest.mark.parametrize(("n", "m"), [(2, 5), (3, 5), (9, 36), (10, 45), (10, 44), (101, 1700), (64, 1500), (1, 3), (0, 3)])
def test_pair_draw_is_exact(spark, n, m):
    df = spark.range(n).select((F.col("id") * 3).alias("k")).repartition(5)
    got = [(r.a, r.b) for r in x.pair_draw(df, "k", m, 42).collect()]
    assert len(got) == len(set(got)) == min(m, n * (n - 1) // 2) and all(a < b for a, b in got)


def test_pair_draw_by_group_is_even(spark):
    df = spark.range(140).select("id", F.when(F.col("id") < 40, "a").when(F.col("id") < 139, "b").alias("g"))
    got = x.pair_draw(df, "id", 600, 7, ["g"]).collect()
    assert {g: sum(r.g == g for r in got) for g in ("a", "b", None)} == {"a": 600, "b": 600, None: 0}
    assert all((r.a < 40) == (r.b < 40) == (r.g == "a") for r in got)
    seen = np.bincount([v for r in got if r.g == "b" for v in (r.a, r.b)], minlength=139)[40:]
    assert seen.min() > 2 and seen.max() < 28  # 12 on average


def scalar_p(r, n):
    """Two-sided p-value by the finite sums for whole degrees of freedom, or by many steps of Simpson's rule."""
    v = n - 2
    if v > 400:
        t = abs(r) * math.sqrt(v / (1 - r * r))
        # Substituting u = t / sqrt(v) keeps the density's shape at any v.
        a = np.linspace(0, t, 400_001)
        density = np.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) - (v + 1) / 2 * np.log1p(a * a / v))
        w = np.ones(len(a))
        w[1:-1:2], w[2:-1:2] = 4, 2
        return 1 - 2 * (w @ density) * (a[1] - a[0]) / 3
    if v % 2 == 0:
        return 1 - abs(r) * sum(math.comb(2 * k, k) / 4**k * (1 - r * r) ** k for k in range(v // 2))
    odd = sum(4**k * math.factorial(k) ** 2 / math.factorial(2 * k + 1) * (1 - r * r) ** k for k in range((v - 1) // 2))
    return 1 - 2 / math.pi * (math.asin(abs(r)) + abs(r) * math.sqrt(1 - r * r) * odd)


def test_p_value_as_an_expression(spark):
    cases = [(r, n) for n in (3, 4, 5, 10, 57, 101, 102, 300, 402) for r in (0.0, 1e-4, -0.03, 0.2, -0.6, 0.97, 1.0)] + [(0.02, 5000), (-0.001, 5000), (0.004, 200_000), (0.0005, 3_000_000)]
    df = spark.createDataFrame([*cases, (None, 9), (float("nan"), 9), (0.5, 2)], "r double, n long").repartition(3)
    plan = df.withColumn("p", p_value(F.col("r"), F.col("n")))
    assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().toString()
    out = {(row.r, row.n): row.p for row in plan.collect()}
    for r, n in cases:
        want = 0.0 if abs(r) >= 1 else scalar_p(r, n)
        assert out[r, n] == pytest.approx(want, abs=1e-9 if n < 1000 else 1e-7), (r, n)
    assert out[None, 9] is None and out[0.5, 2] is None


def test_folds_keep_blocks_whole_and_null(spark):
    r = np.random.default_rng(2)
    blocks = [(f"b{b}" if b else None, f"s{b % 3}" if b % 7 else None, int(r.integers(1, 60))) for b in range(60)]
    rows = [(i, b, g if i % 5 else "other") for b, g, n in blocks for i in range(n)]
    df = spark.createDataFrame(rows, "i long, block string, stratum string").repartition(6)
    out = x.repeated_folds(df, "block", "stratum", 4, [1, 2]).toPandas()
    assert len(out) == len(rows) and out[["fold_1", "fold_2"]].notna().all().all()
    for c in ("fold_1", "fold_2"):
        assert (out.groupby("block", dropna=False)[c].nunique() == 1).all() and set(out[c]) == {0, 1, 2, 3}
        assert out.groupby(c).size().max() < 1.2 * out.groupby(c).size().min()
        by = out[out.stratum == "s1"].groupby(c).size()
        assert by.max() < 1.8 * by.min()
    assert (out.fold_1 != out.fold_2).mean() > 0.4


def test_repeats_are_other_splits(spark, sf):
    rows = modelling.m12_m14_repeated_grouped_cv(spark, sf).collect()
    by_seed = [frozenset(r.rmse for r in rows if r.seed == seed) for seed in (42, 52, 62)]
    assert len(rows) == 3 * 4 * 2 * 3 and len(set(by_seed)) == 3


ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, math.nextafter(1, 0), math.nextafter(1, 2), -1.0, 0.5, 2.0, 4.0, math.nextafter(4, 0), 1e300, -1e300, 1.7976931348623157e308, float("inf"), float("-inf"), 3.3, 1e-5]


def test_bits_are_in_order(spark):
    r = np.random.default_rng(3)
    v = [*ODD, *(r.normal(size=300) * 10.0 ** r.integers(-300, 300, 300)), *(2.0 ** r.integers(-1074, 1024, 60))]
    out = spark.createDataFrame([(float(a),) for a in v], "v double").withColumn("c", quantiles.sortable(F.col("v"))).collect()
    bits = lambda a: int(np.float64(abs(a)).view(np.int64)) * (-1 if a < 0 else 1)
    assert all(row.c == bits(row.v) for row in out)


@pytest.mark.parametrize("parts", [1, 8])
def test_quantiles_equal_numpy(spark, parts):
    r = np.random.default_rng(4)
    groups = {"a": r.normal(size=400), "b": np.round(r.normal(size=101), 1), "c": [2.5], "d": [7.0] * 30, None: r.normal(size=50) * 1e-9, "e": [-1e300, 1e-300, 0.0, 5.0], "same": 1 + r.integers(0, 9, 200) * 2**-50}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(parts)
    out = {row.g: row.q for row in quantiles.exact_quantiles(df, ["g"], "v", [0, 0.1, 0.5, 0.9, 1]).collect()}
    assert set(out) == set(groups)
    for g, vs in groups.items():
        assert out[g] == pytest.approx(np.quantile(np.array(vs), [0, 0.1, 0.5, 0.9, 1]).tolist(), rel=1e-12, abs=1e-300)
    assert quantiles.exact_quantiles(df.filter("v is null"), [], "v", [0.5]).count() == 0
    table = m.box_stats(df, "g", "v").filter("g = 'b'").first()
    assert table.median == np.median(groups["b"]) and table.whisker_low >= min(groups["b"])


def test_no_percentile_in_the_plan(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", -2.0)], "region string, label string, residual double")
    for plan in (m.residual_summary(df, [["region"], ["label"], []]), m.residual_by_region(df), m.residual_distribution(df, "region")):
        assert "percentile" not in plan._jdf.queryExecution().toString() and "median(" not in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_neighbours_equal_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    monkeypatch.setattr(neighbours, "PACK", 8)
    r = np.random.default_rng(5)
    v = (np.repeat(r.normal(size=(6, 5)) * 5, 40, 0) + r.normal(size=(240, 5))).round(1)
    v[10] = v[11]
    v[50:55] = 0
    v[100:130] = v[100]
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(v)] + [(999, None)], "id long, v array<double>").repartition(5)
    got: dict = {}
    for row in neighbours.knn(df, "id", "v", 4, metric=metric, cell_rows=25, skip_first=1, queries=df.filter("id % 3 = 0")).collect():
        got.setdefault(row.query, {})[row["rank"]] = (row.neighbour, row.distance)
    assert set(got) == set(range(0, 240, 3))
    size = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / np.where(size > 0, size, 1)
    for i in got:
        d = np.round(1 - u @ u[i] if metric == "cosine" else np.sqrt(((v - v[i]) ** 2).sum(1)), 9)
        d[i] = np.inf
        want = np.lexsort((np.arange(240), d))[1:5]
        assert [got[i][k][1] for k in (1, 2, 3, 4)] == pytest.approx(d[want].tolist(), abs=1e-8)
        if len(set(d[want].tolist())) == 4 and metric == "euclidean":
            assert [got[i][k][0] for k in (1, 2, 3)] == want[:3].tolist()
    assert neighbours.knn(df.limit(0), "id", "v", 3).count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("swept", [True, False])
def test_every_row_asks_all_rows(spark, monkeypatch, metric, swept):
    """Both ways of a search give what brute force gives, for copies, ties and zero vectors too, and in parts and blocks of any size."""
    for name, value in {"BLOCK": 20, "PACK": 8, "SWEPT": 64, "AT_ONCE": 10, "SWEEP_FROM": -1 if swept else 2}.items():
        monkeypatch.setattr(neighbours, name, value)
    taken, sweep = [], neighbours.sweep
    monkeypatch.setattr(neighbours, "sweep", lambda *a: taken.append(1) or sweep(*a))
    r = np.random.default_rng(6)
    v = r.normal(size=(330, 4)).round(1)
    v[100:160] = v[100]
    v[200:230] = v[:30]
    v[50:53] = 0
    ids = r.permutation(1000)[:330]
    df = spark.createDataFrame([(int(i), a.tolist()) for i, a in zip(ids, v, strict=True)], "id long, v array<double>").repartition(3)
    got: dict = {}
    for row in neighbours.knn(df, "id", "v", 5, metric=metric, cell_rows=40).collect():
        got.setdefault(row.query, {})[row["rank"]] = (row.neighbour, row.distance)
    assert len(got) == 330 and bool(taken) == swept
    size = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / np.where(size > 0, size, 1)
    for i, at in enumerate(ids):
        d = 1 - u @ u[i] if metric == "cosine" else np.sqrt(((v - v[i]) ** 2).sum(1))
        want = [j for j in np.lexsort((ids, np.round(d, 9))) if j != i][:5]
        assert [got[at][k][0] for k in range(1, 6)] == ids[want].tolist()
        assert [got[at][k][1] for k in range(1, 6)] == pytest.approx(d[want].tolist(), abs=1e-12)


def each_query_has(spark, sf, name, rows):
    found = {r.query: r["count"] for r in getattr(analytics, name)(spark, sf).groupBy("query").count().collect()}
    assert found == {r.vec_id: rows for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}


def test_cosine_search_asks_for_every_row(spark, sf):
    each_query_has(spark, sf, "j8_w9_cosine_knn", 10)


def test_radar_search_asks_for_every_row(spark, sf):
    each_query_has(spark, sf, "j9_euclidean_knn", 5)


def test_nearest_other_is_found_for_every_row(spark, sf):
    each_query_has(spark, sf, "j11_nearest_other_embedding", 1)


def test_overlap_is_measured_for_every_row(spark, sf):
    each_query_has(spark, sf, "j13_neighbour_overlap", 3)


def test_overlap_summary_counts_every_row(spark, sf):
    out = analytics.a12_overlap_summary(spark, sf).collect()
    assert {r.k: r.n for r in out if r.region is None and r.dw_label_name is None} == dict.fromkeys((5, 10, 20), spark.read.parquet(f"{sf}/embeddings.parquet").count())


def test_nearest_cosine_is_the_mean_over_every_row(spark, sf):
    v = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    nearest = (u @ u.T - 3 * np.eye(len(u))).max(1)
    out = analytics.a19_nearest_cosine(spark, sf).first()
    assert out.mean_cosine == pytest.approx(nearest.mean(), abs=1e-6) and out.p95_cosine == pytest.approx(np.quantile(nearest, 0.95), abs=1e-6)


def test_arrays_do_not_grow_with_the_pivots():
    """A batch is placed and dealt to cells in pieces, whose size the number of pivots does not change, and no visit is lost."""
    r = np.random.default_rng(3)
    v = r.normal(size=(3000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.ListArray.from_arrays(pa.array(np.arange(3001) * 8, pa.int32()), pa.array(v.ravel())), pa.array(np.full(3000, np.inf))], names=["id", "v", "reach"])
    cells = neighbours.Cells(v[:1000], np.zeros(1000), np.full(1000, 10.0), False)
    tracemalloc.start()
    placed = [b.num_rows for b in neighbours.place(batch.select([0, 1]), cells)]
    met = 0
    for b in neighbours.packs_by_cell(batch.slice(0, 300), cells, False):
        met += len(b.column(1).flatten())
        assert len(b.column(1).flatten()) <= neighbours.PACK * neighbours.HANDED
    assert tracemalloc.get_traced_memory()[1] < 5 * 8 * 1000 * neighbours.PLACED
    tracemalloc.stop()
    assert sum(placed) == 3000 and met == 300 * 999


def test_cells_are_skipped(spark):
    r = np.random.default_rng(6)
    v = np.repeat(r.normal(size=(20, 6)) * 20, 60, 0) + r.normal(size=(1200, 6))
    rows = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(v)], "id long, v array<double>")
    cells, blocks = neighbours.build_cells(rows, "euclidean", 50)
    assert sum(len(b.others) for b in blocks.collect()) == 1200
    d = np.sqrt(((v[:, None] - v) ** 2).sum(2))
    reach = np.sort(d, 1)[:, 10]
    own, may = cells.visited(v, reach)
    cell = cells.distances(v).argmin(1)
    for i in range(0, 1200, 13):
        near = np.flatnonzero(d[i] <= reach[i])
        assert set(cell[near]) <= {own[i], *np.flatnonzero(may[i])}
    assert may.mean() < 0.2
    asked = rows.withColumn("reach", F.lit(3.0))
    visits = neighbours.plan_visits(asked, cells, False).select(F.size("ids").alias("n")).agg(F.sum("n")).first()[0]
    assert visits < 0.2 * 1200 * len(cells.low)


def test_permutations_and_importance(spark):
    r = np.random.default_rng(7)
    v = r.normal(size=(90, 3))
    y = v @ [2.0, -1.0, 0.0] + 0.1 * r.normal(size=90)
    rows = [(i, "a" if i < 60 else "b", *map(float, a), float(b)) for i, (a, b) in enumerate(zip(v, y, strict=True))]
    df = spark.createDataFrame([*rows, (500, "a", None, 1.0, 1.0, 1.0)], "k long, g string, p double, q double, s double, y double").repartition(4)
    out = {row.k: row.p for row in s.permuted(df.filter("p is not null"), ["g"], "k", "p", 12, 3).collect()}
    assert len(out) == 90 and all(len(a) == 12 for a in out.values())
    for n in range(12):
        assert sorted(out[k][n] for k in range(60)) == sorted(v[:60, 0]) and sorted(out[k][n] for k in range(60, 90)) == sorted(v[60:, 0])
    assert len({tuple(out[k][n] for k in range(60)) for n in range(12)}) == 12
    w = np.array([0.0, 2.0, -1.0, 0.0])
    found = {row.feature: row for row in studies.permutation_importance(df, "k", ["p", "q", "s"], ["y"], {"y": w}, repeats=6, seed=4).collect()}
    partner = {row.k: row.z for row in s.permuted(df.filter("p is not null").select("k", F.col("k").alias("z")), [], "k", "z", 6, 4).collect()}
    for f, name in enumerate("pqs"):
        drops = []
        for n in range(6):
            moved = v.copy()
            moved[:, f] = v[[partner[k][n] for k in range(90)], f]
            drops.append((((moved @ w[1:] - y) ** 2).sum() - ((v @ w[1:] - y) ** 2).sum()) / ((y - y.mean()) ** 2).sum())
        assert found[name].mean_drop == pytest.approx(np.mean(drops)) and found[name].std_drop == pytest.approx(np.std(drops))


def test_pair_sums_and_ranks(spark):
    r = np.random.default_rng(8)
    rows = [(i, "a" if i % 3 else None, float(v)) for i, v in enumerate(np.round(r.normal(size=80), 1))]
    df = spark.createDataFrame([*rows, (900, "a", None), (901, "alone", 4.0)], "k long, g string, v double").repartition(6)
    out = {row.g: (row.n_pairs, row.total) for row in s.pair_differences(df, "k", "v", ["g"]).collect()}
    for g in ("a", None):
        v = [c for _, b, c in rows if b == g]
        assert out[g] == (len(v) * (len(v) - 1) // 2, pytest.approx(sum(abs(a - b) for i, a in enumerate(v) for b in v[i + 1 :])))
    assert out["alone"] == (0, 0.0)
    ranks = {row.k: row.r for row in s.average_ranks(df.filter("v is not null"), "v", "r", ["g"], ["k"]).collect()}
    v = {k: c for k, g, c in rows if g == "a"}
    assert all(ranks[k] == sum(a < c for a in v.values()) + (sum(a == c for a in v.values()) + 1) / 2 for k, c in v.items())


def test_windows_read_only_their_files(spark, tmp_path):
    rows = [(t, r, c, float(100 * r + c)) for t, h, w in (("a", 25, 33), ("b", 7, 7)) for r in range(h) for c in range(w)]
    px = spark.createDataFrame(rows, "tile string, image_row long, image_col long, v double").repartition(4)
    table = tiles.write_windows(px, f"{tmp_path}/w", 10, margin=2)
    assert table.rows().count() == len(rows)
    one = table.window("a", 2, 3)
    inside = [(r.image_row, r.image_col) for r in one.collect()]
    assert sorted(inside) == sorted((r, c) for r in range(18, 25) for c in range(28, 33)) and one.filter("not is_margin").count() == 5 * 3
    box = table.box("a", 8, 9, 4, 12)
    assert sorted(r.v for r in box.collect()) == sorted(100.0 * r + c for r in range(8, 12) for c in range(9, 21))

    # Of 12 windows of one tile and one of another, a window reads one file and the box two by three windows' files.
    read = lambda df: {r.f for r in df.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(read(table.spark.read.parquet(table.path))) >= 13 and len(read(one)) == 1 and len(read(box)) == 2 * 3
    assert re.search(r"PartitionFilters: \[[^\]]*window_row", box._jdf.queryExecution().executedPlan().toString())
    with pytest.raises(ValueError):
        tiles.write_windows(px, f"{tmp_path}/x", 10, margin=11)


def test_chips_are_padded(spark, tmp_path):
    px = spark.createDataFrame([("a", r, c, float(10 * r + c)) for r in range(9) for c in range(9)], "tile string, image_row long, image_col long, v double")
    table = tiles.write_windows(px, f"{tmp_path}/w", 4)
    out = {r.query: r.chip for r in tiles.chips(table, spark.createDataFrame([(1, "a", 0, 8), (2, "a", 4, 4), (3, "none", 1, 1)], "query long, tile string, image_row long, image_col long"), 4, "v").collect()}
    want = lambda row, col: [float(10 * r + c) if 0 <= r < 9 and 0 <= c < 9 else None for r in range(row - 2, row + 2) for c in range(col - 2, col + 2)]
    assert out == {1: want(0, 8), 2: want(4, 4), 3: [None] * 16}


def test_chips_move_pixels_not_chips(spark, tmp_path):
    """Every pixel is a centre: what is shuffled grows with the pixels, not with the pixels of all chips; and chips larger than a window overlap several."""
    px = spark.createDataFrame([("a", r, c, None if r == c else float(100 * r + c)) for r in range(23) for c in range(17)], "tile string, image_row long, image_col long, v double")
    table = tiles.write_windows(px, f"{tmp_path}/w", 4)
    centres = px.select((F.col("image_row") * 100 + F.col("image_col")).alias("query"), "tile", "image_row", "image_col")
    plan = tiles.chips(table, centres, 10, "v")
    out = {r.query: r.chip for r in plan.collect()}
    assert len(out) == 23 * 17
    for q, chip in out.items():
        at = [(r, c) for r in range(q // 100 - 5, q // 100 + 5) for c in range(q % 100 - 5, q % 100 + 5)]
        assert chip == [float(100 * r + c) if 0 <= r < 23 and 0 <= c < 17 and r != c else None for r, c in at]
    # No step before the chips are cut has a row for each pixel of each chip.
    cells = plan._jdf.queryExecution().executedPlan().toString()
    assert "image_row" in cells and not re.search(r"Join[^\n]*image_row|Exchange[^\n]*query#\d+L?[,)]", cells)


def test_patience_and_truncated_trees(spark):
    assert o.best_iteration([5, 4, 4.5, 4.4, 3, 9], patience=2) == 2 and o.best_iteration([5, 4, 4.5, 4.4, 3, 9], patience=3) == 5 and o.best_iteration([1.0]) == 1
    r = np.random.default_rng(9)
    v = r.normal(size=(160, 3))
    df = p.feature_vector(spark.createDataFrame([(*map(float, a), float(a[0] * a[1] + 0.5 * r.normal()), i % 4) for i, a in enumerate(v)], "a double, b double, c double, y double, fold int"), ["a", "b", "c"]).cache()
    options = {"maxDepth": 3, "stepSize": 0.5, "minInstancesPerNode": 2, "subsamplingRate": 0.8}
    train, held = df.filter("fold > 0"), df.filter("fold = 0")
    model, errors = o.fit_with_patience(train, held, "y", "hat", maxIter=12, patience=3, **options)
    assert len(errors) == 12 and model.getNumTrees == o.best_iteration(errors, 3) < 12
    again = o.boosted_trees("y", "hat", maxIter=model.getNumTrees, **options).fit(train)
    one, two = ([row.hat for row in f.transform(held).orderBy("a").collect()] for f in (model, again))
    assert one == pytest.approx(two)
    assert np.mean((np.array(one) - [row.y for row in held.orderBy("a").collect()]) ** 2) == pytest.approx(errors[model.getNumTrees - 1])


def with_partitions(spark, n, run):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_parts_come_from_the_values_and_not_from_the_setting(spark):
    df = spark.range(1000).repartition(7)
    assert o.in_parts(df, ["id"], 1000, 64).rdd.getNumPartitions() == 1
    assert o.in_parts(df, ["id"], 100_000, 64).rdd.getNumPartitions() == -(-6_400_000 // o.PART_VALUES)


def test_random_search_does_not_depend_on_the_shuffle_setting(spark, sf, monkeypatch):
    monkeypatch.setattr(modelling, "SPACE", {"maxDepth": [2], "maxIter": [2], "subsamplingRate": [0.7], "minInstancesPerNode": [1]})
    run = lambda: [tuple(r) for r in modelling.m7_random_search(spark, sf).collect()]
    first, second = with_partitions(spark, 3, run), with_partitions(spark, 9, run)
    assert first == second and len(first) == 4


def test_reconstruction_reads_the_scene_once_and_moves_no_pixel(spark, sf):
    px = p.feature_vector(spark.createDataFrame([(i, float(i), None if i == 3 else float(i)) for i in range(20)], "id long, a double, y double"), ["a"])
    model = o.fit_multi(px, ["y"], maxIter=1, maxDepth=1, minInstancesPerNode=1)
    out = o.reconstruct(px, F.col("id") < 5, model, ["y"])
    assert not re.search("Exchange|Join", out._jdf.queryExecution().executedPlan().toString())
    assert {r.id for r in out.collect() if r.is_train} == set(range(5)) and [r.id for r in out.filter("y_filled is null").collect()] == [3]
    with pytest.raises(ValueError, match="2 valid pixels"):
        p.require_none_missing(spark.createDataFrame([(True, 2), (False, 0)], "is_gap boolean, missing long"))
    run = lambda: {r.is_gap: r for r in modelling.m3_reconstruction(spark, sf).collect()}
    first, second = with_partitions(spark, 3, run), with_partitions(spark, 9, run)
    drawn = modelling.tables.pixels(spark, sf).filter("S1_VV is not null")
    assert first[False].n == x.bernoulli(drawn, ["tile", "image_row", "image_col"], 0.1, 42).count() and first[False].n + first[True].n == drawn.count()
    assert first[True].r2 == pytest.approx(second[True].r2) and first[True].n == second[True].n


def test_reconstruction_reads_every_value_and_fills_every_band(spark, sf, tmp_path):
    """Prices follow the last of the 64 values, so bands can be told in the gaps only by who reads that."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    orders = spark.range(6000).withColumn("vec_id", F.col("id") % vectors.count()).join(vectors, "vec_id")
    orders.select(F.col("id").alias("o_orderkey"), F.lit("F").alias("o_orderstatus"), (250000 + 300000 * F.element_at("embedding", 64).cast("double")).alias("o_totalprice")).write.parquet(f"{tmp_path}/orders.parquet")
    out = {(r.band, r.is_gap): r for r in modelling.m3_reconstruction(spark, str(tmp_path)).collect()}
    assert set(out) == {(b, g) for b in modelling.tables.TARGETS for g in (False, True)}
    assert all(r.rmse == 0 if not g else r.r2 > 0.8 for (_, g), r in out.items())
    assert all(out[b, False].n + out[b, True].n == 6000 for b in modelling.tables.TARGETS)


def test_a_vectors_length_is_taken_once_for_a_row(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None])], "id int, v array<float>")
    out = df.select("id", unit(F.col("v")).alias("u"))
    assert {r.id: r.u for r in out.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: [1.0, None]}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_overlap_makes_each_edge_list_once(spark):
    made = spark.sparkContext.accumulator(0)

    def edges(batches):
        made.add(1)
        yield from batches

    a = spark.range(4).selectExpr("0L AS query", "id AS neighbour", "cast(id + 1 AS int) AS rank").coalesce(1).mapInPandas(edges, "query long, neighbour long, rank int")
    out = s.neighbour_overlap(a, spark.createDataFrame([(0, 1, 1), (0, 9, 2)], "query long, neighbour long, rank int"), [1, 2]).collect()
    assert {r.k: r.overlap for r in out} == {1: 0.0, 2: 0.5} and made.value == 1


def test_split_samples_are_cut_by_their_values(spark, sf):
    data = with_partitions(spark, 9, lambda: modelling.split_samples(spark, sf))
    assert data.rdd.getNumPartitions() == 1 and data.count() == modelling.tables.samples(spark, sf).count()


def test_split_moves_rows_with_the_embedding_alone(spark, sf):
    plan = modelling.split_rows(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression", 1)
    assert "AS A00" in above and "A00" not in below and "embedding" in below
    data = modelling.split_samples(spark, sf)
    assert "features" in data.columns and not {"embedding", "A00", "A63"} & set(data.columns)


def test_ridge_by_set_equals_ridge_one_by_one(spark, table):
    df = table[0].dropna(subset=["a", "b", "c", "y"]).withColumn("z", F.exp(F.col("a") / 5))
    sets = {"few": ["a"], "all": ["a", "b", "c"]}
    found = studies.ridge_by_set(df, sets, ["y", "z"])
    for (name, target), w in found.items():
        model = o.ridge(p.feature_vector(df, sets[name]), target, "hat")
        assert w == pytest.approx([model.intercept, *model.coefficients]) and len(w) == len(sets[name]) + 1
        ready = p.feature_array(df, sets[name], "x").withColumn("features", p.array_to_vector("x"))
        out = model.transform(ready.withColumn("own", studies.linear(F.col("x"), w))).select("own", "hat").collect()
        assert [r.own for r in out] == pytest.approx([r.hat for r in out])
    assert len(found) == 4
    with pytest.raises(ValueError, match="no row"):
        studies.ridge_by_set(df.limit(0), sets, ["y"])


def test_sets_are_fitted_as_if_alone(spark):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(*map(float, v), float(v[0] * v[1])) for v in r.normal(size=(120, 3))], "a double, b double, c double, y double").coalesce(1)
    df = p.feature_vector(p.feature_vector(df, ["a"], "few"), ["a", "b", "c"], "all").cache()
    options = {"maxIter": 3, "maxDepth": 2, "minInstancesPerNode": 2}
    found = o.fit_sets(df, ["few", "all"], "y", **options)
    for name in ("few", "all"):
        alone = o.boosted_trees("y", f"{name}_hat", features=name, **options).fit(df)
        assert list(found) == ["few", "all"] and found[name].toDebugString.split("\n")[1:] == alone.toDebugString.split("\n")[1:]


def test_difference_and_ratio_study_keeps_one_frame_of_whole_rows(spark, sf, tmp_path, monkeypatch):
    # Rows without a vector, or with a value missing in the part that only the context reads, count in neither set.
    source = spark.read.parquet(f"{sf}/embeddings.parquet")
    hole = F.transform("embedding", lambda v, i: F.when((F.col("vec_id") % 50 == 9) & (i == 19), F.lit(float("nan")).cast("float")).otherwise(v))
    source.withColumn("embedding", F.when(F.col("vec_id") % 50 != 7, hole)).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    kept, cache = [], type(source).cache
    monkeypatch.setattr(type(source), "cache", lambda df: kept.append(df.columns) or cache(df))
    out = {(r.feature_set, r.band): r for r in with_partitions(spark, 9, lambda: modelling.m17_m18_difference_and_ratio_study(spark, str(tmp_path)).collect())}
    assert kept == [["split", "x", *modelling.tables.TARGETS, "ratio", "log_ratio"]]
    rows = p.one_hot(modelling.split_rows(spark, str(tmp_path)), "region", list(modelling.tables.REGIONS))
    for name, columns in modelling.SETS.items():
        data = p.feature_vector(rows, columns)
        assert data.count() == source.filter("vec_id % 50 not in (7, 9)").count()
        model = o.ridge(data.filter("split = 'train'"), "S1_VV_div_VH", "hat")
        plain = m.metrics_by(model.transform(data.filter("split = 'test'")), actual="S1_VV_div_VH", predicted="hat").first()
        got = out[name, "difference_ridge"]
        assert (got.n, got.rmse, got.mae, got.r2) == (plain.n, pytest.approx(plain.rmse), pytest.approx(plain.mae), pytest.approx(plain.r2))
        assert {b for s, b in out if s == name} == {"difference_ridge", "difference_trees", "difference_structural", "ratio_ridge", "ratio_log_ridge", "ratio_structural"}
        assert len({r.n for (s, _), r in out.items() if s == name}) == 1
