"""Queries on sampling, joins, aggregations, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.stats import p_value, standardised
from gridloom.operators import metrics as m
from gridloom.operators import projections as p
from gridloom.operators import ranking as w
from gridloom.operators import sampling as x
from gridloom.operators import similarity as s
from gridloom.operators import studies
from gridloom.operators.gramian import correlation_pairs, gram_matrices, ridge_weights
from gridloom.operators.neighbours import knn
from gridloom.plans.registry import METRIC_COLUMNS, METRICS, draw, e, over, p_value_sql, pair_steps, query, rounded
from gridloom.plans.solver import CONTEXT, FEATURES, STUDY_STEPS, recursive, ridge_steps
from gridloom.sources import tables
from gridloom.sources.scratch import durable

# ---- sampling ----


@query(over("pixels", f"SELECT pixel_id FROM pixels WHERE {draw('tile', 'image_row', 'image_col', seed=42)} < CAST(0.02 AS DOUBLE)"))
def x1_bernoulli_sample(spark, d):
    return x.bernoulli(tables.pixels(spark, d), ["tile", "image_row", "image_col"], 0.02, 42).select("pixel_id")


@query(over("pixels", "SELECT pixel_id FROM pixels WHERE image_row % 22 = 0 AND image_col % 22 = 0"))
def x2_grid_sample(spark, d):
    return x.grid(tables.pixels(spark, d), 0.002).select("pixel_id")


@query(over("pixels", "SELECT pixel_id, image_row - 4 AS tile_row, image_col - 8 AS tile_col, 500000 + 10 * (image_col - 8 + 0.5::DOUBLE) AS x, 4200000 - 10 * (image_row - 4 + 0.5::DOUBLE) AS y FROM pixels"))
def x3_pixel_centres(spark, d):
    px = tables.pixels(spark, d)
    offsets = px.groupBy("tile").agg(F.lit(4).cast("long").alias("row_off"), F.lit(8).cast("long").alias("col_off"))
    tiles = offsets.select("*", F.lit(10.0).alias("a"), F.lit(0.0).alias("b"), F.lit(500000.0).alias("c"), F.lit(0.0).alias("d"), F.lit(-10.0).alias("e"), F.lit(4200000.0).alias("f"))
    return x.pixel_centres(px, tiles).select("pixel_id", "tile_row", "tile_col", "x", "y")


@query(over("pixels", "SELECT pixel_id, row_number() OVER (ORDER BY tile, image_row, image_col) - 1 AS sample_id FROM pixels WHERE S1_VV IS NOT NULL"))
def x4_consecutive_ids(spark, d):
    return x.consecutive_ids(tables.pixels(spark, d).filter("S1_VV is not null").select("pixel_id", "tile", "image_row", "image_col"), ["tile", "image_row", "image_col"]).select("pixel_id", "sample_id")


@query(over("pixels", f"SELECT pixel_id, CASE WHEN row_number() OVER (ORDER BY {draw('pixel_id', seed=42)}, pixel_id) <= ceil(n * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM pixels, (SELECT count(*) AS n FROM pixels)"))
def x5_random_holdout(spark, d):
    return x.random_holdout(tables.pixels(spark, d).select("pixel_id"), "pixel_id", 0.2, 42)


STRATA = over("samples", f"""SELECT sample_id, n, row_number() OVER (PARTITION BY region, dw_label ORDER BY {draw('sample_id', seed=42)}, sample_id) AS r FROM (SELECT *, count(*) OVER (PARTITION BY region, dw_label) AS n FROM samples)""")


@query(f"SELECT sample_id, CASE WHEN r <= round_even(n * CAST(0.3 AS DOUBLE), 0) THEN 'test' ELSE 'train' END AS split FROM ({STRATA})")
def x6_stratified_holdout(spark, d):
    return x.stratified_holdout(tables.samples(spark, d), ["region", "dw_label"], "sample_id", 0.3, 42).select("sample_id", "split")


@query(f"SELECT sample_id FROM ({STRATA}) WHERE r <= greatest(1, round_even(n * CAST(0.4 AS DOUBLE), 0))")
def x7_stratified_fraction(spark, d):
    return x.stratified_fraction(tables.samples(spark, d), ["region", "dw_label"], "sample_id", 0.4, 42).select("sample_id")


SPLIT = {
    "numbered": f"SELECT pixel_id, S1_VH, row_number() OVER (ORDER BY {draw('pixel_id', seed=13)}, pixel_id) - 1 AS place, count(*) OVER () AS n FROM pixels",
    "halves": "SELECT *, CASE WHEN place < round_even(n * CAST(0.2 AS DOUBLE), 0) THEN 'validation' ELSE 'pool' END AS part, CAST(CASE WHEN place < round_even(n * CAST(0.2 AS DOUBLE), 0) THEN place ELSE place - round_even(n * CAST(0.2 AS DOUBLE), 0) END AS BIGINT) AS position FROM numbered",
}


@query(over("pixels", "SELECT pixel_id, part, position FROM halves", **SPLIT))
def x8_validation_and_pool(spark, d):
    return x.validation_and_pool(tables.pixels(spark, d).select("pixel_id"), "pixel_id", 0.2, 13).select("pixel_id", "part", "position")


@query(over("pixels", f"SELECT pixel_id FROM pixels ORDER BY {draw('pixel_id', seed=5)}, pixel_id LIMIT (SELECT CAST(round_even(count(*) * CAST(0.01 AS DOUBLE), 0) AS BIGINT) FROM pixels)"))
def x9_x13_draw_exactly(spark, d):
    px = tables.pixels(spark, d).select("pixel_id")
    n = px.count()
    return x.draw_exactly(px, "pixel_id", x.sweep_rows(1.0, n, n), 5)


@query(over("pixels", f"SELECT v.pixel_id, round(v.S1_VH, 6) AS actual, round(q.S1_VH, 6) AS predicted FROM (SELECT *, CAST(floor({draw('pixel_id', seed=7)} * size) AS BIGINT) AS pick FROM halves, (SELECT count(*) AS size FROM halves WHERE part = 'pool') WHERE part = 'validation') v JOIN halves q ON q.part = 'pool' AND q.position = v.pick", **SPLIT))
def x10_random_baseline(spark, d):
    split = x.validation_and_pool(tables.pixels(spark, d).select("pixel_id", "S1_VH"), "pixel_id", 0.2, 13)
    return rounded(x.random_baseline(split, "pixel_id", "S1_VH", 7).select("pixel_id", F.col("S1_VH").alias("actual"), "predicted"))


@query(f"SELECT o_orderstatus, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {draw('o_orderkey', seed=3)}, o_orderkey) AS r FROM orders) WHERE r <= 800 GROUP BY 1")
def x11_capped_blocks(spark, d):
    return x.capped(tables.table(spark, d, "orders"), ["o_orderstatus"], "o_orderkey", 800, 3).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(over("samples", "SELECT a, b FROM pairs", **pair_steps("samples", "sample_id", 20_000, 42)))
def x12_pair_sample(spark, d):
    return x.pair_draw(tables.samples(spark, d).select("sample_id"), "sample_id", 20_000, 42)


BLOCKS = {
    "ranked": "SELECT *, count(*) OVER (PARTITION BY region) AS n, row_number() OVER (PARTITION BY region ORDER BY latitude, sample_id) AS a, row_number() OVER (PARTITION BY region ORDER BY longitude, sample_id) AS o FROM samples",
    "blocks": "SELECT *, CAST(CASE WHEN n = 1 THEN 0 ELSE greatest(ceil((a - 1) * 4 / (n - 1)) - 1, 0) END AS INTEGER) AS lat_bin, CAST(CASE WHEN n = 1 THEN 0 ELSE greatest(ceil((o - 1) * 4 / (n - 1)) - 1, 0) END AS INTEGER) AS lon_bin FROM ranked",
}


@query(over("samples", "SELECT sample_id, lat_bin, lon_bin, region || '__' || lat_bin || '_' || lon_bin AS spatial_block FROM blocks", **BLOCKS))
def x14_w4_spatial_blocks(spark, d):
    return x.spatial_blocks(tables.samples(spark, d), "sample_id").select("sample_id", "lat_bin", "lon_bin", "spatial_block")


def repeated_folds(spark, d, seeds):
    """(sample_id, spatial_block, fold_<seed>, ...): only what blocks and strata need is moved."""
    narrow = tables.samples(spark, d).select("sample_id", "region", "latitude", "longitude", "dw_label_name")
    blocks = x.spatial_blocks(narrow, "sample_id").select("sample_id", "spatial_block", "dw_label_name")
    return x.repeated_folds(blocks, "spatial_block", "dw_label_name", 4, seeds).drop("dw_label_name")


def folded(spark, d, seed=42):
    """Samples with their block and fold."""
    return repeated_folds(spark, d, [seed]).withColumnRenamed(f"fold_{seed}", "fold").join(tables.samples(spark, d), "sample_id")


#: Folds of three seeds in SQL, by ``operators.sampling.block_folds``.
FOLD_STEPS = BLOCKS | {
    "placed": "SELECT sample_id, dw_label_name, region || '__' || lat_bin || '_' || lon_bin AS spatial_block FROM blocks",
    "counted": "SELECT spatial_block, dw_label_name, count(*) AS c FROM placed GROUP BY ALL",
    "mains": "SELECT spatial_block, sum(c) AS n, first(dw_label_name ORDER BY c DESC, dw_label_name NULLS FIRST) AS main FROM counted GROUP BY spatial_block",
    "drawn": "SELECT *, CAST(('0x' || substr(md5(concat_ws('|', spatial_block, seed)), 1, 8)) AS BIGINT) AS u FROM mains, (SELECT unnest([42, 52, 62]) AS seed)",
    "ordered": "SELECT *, row_number() OVER (PARTITION BY seed, main ORDER BY n DESC, u, spatial_block) - 1 AS pos, count(*) OVER (PARTITION BY seed, main) AS size FROM drawn",
    "dealt": "SELECT * REPLACE (CASE WHEN pos < size // 4 * 4 THEN pos ELSE row_number() OVER (PARTITION BY seed, pos < size // 4 * 4 ORDER BY main NULLS FIRST, n DESC, u, spatial_block) - 1 END AS pos), CASE WHEN pos < size // 4 * 4 THEN coalesce(main, '') ELSE 'rest' END AS deal FROM ordered",
    "rounds": "SELECT *, pos // 8 AS round, CASE WHEN pos % 8 < 4 THEN pos % 8 ELSE 7 - pos % 8 END AS slot FROM dealt",
    "turns": "SELECT *, len(list_filter(range(4), lambda t: substr(md5(concat_ws('|', deal, round, t, seed)), 1, 8) < substr(md5(concat_ws('|', deal, round, slot, seed)), 1, 8))) AS fold FROM rounds",
    "folds": "SELECT sample_id, seed, spatial_block, CAST(fold AS INTEGER) AS fold FROM placed JOIN turns USING (spatial_block)",
}


@query(over("samples", "SELECT sample_id, spatial_block, fold FROM folds WHERE seed = 42", **FOLD_STEPS))
def x15_grouped_folds(spark, d):
    return repeated_folds(spark, d, [42]).select("sample_id", "spatial_block", F.col("fold_42").alias("fold"))


@query(over("samples", "SELECT sample_id, seed, fold FROM folds", **FOLD_STEPS))
def x16_repeated_seeds(spark, d):
    each = repeated_folds(spark, d, [42, 52, 62])
    return each.select("sample_id", F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), F.col(f"fold_{s}").alias("fold")) for s in (42, 52, 62)])).alias("x")).select("sample_id", "x.*")


# ---- joins ----


@query("SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def j1_predictions_to_source(spark, d):
    c = tables.table(spark, d, "customer")
    if not c.groupBy("c_custkey").count().filter("count > 1").isEmpty():
        raise ValueError("the source key is not unique")
    o = tables.table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.join(tables.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_mktsegment", "n_name")


_corr = lambda t: "SELECT feature, target, n, c / nullif(s, 0) AS pearson_r FROM (SELECT feature, target, count(*) AS n, covar_pop(v, y) AS c, sqrt(var_pop(v) * var_pop(y)) AS s FROM " + t + " GROUP BY feature, target)"
LONG_FEATURES = "SELECT 'A' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature, CAST(embedding[i + 1] AS DOUBLE) AS v, target, y FROM samples, LATERAL (SELECT unnest(range(0, 64)) AS i), LATERAL (SELECT unnest(['S1_VV', 'S1_VH', 'S1_VV_div_VH']) AS target, unnest([S1_VV, S1_VH, S1_VV_div_VH]) AS y)"
CORR = {"long": LONG_FEATURES, "corr": _corr("long")}


def correlations(spark, d):
    return s.feature_target_correlation(p.spread_embedding(tables.samples(spark, d)), FEATURES, list(tables.TARGETS))


@query(over("samples", "SELECT feature, target, n, round(pearson_r, 6) AS pearson_r, round(abs(pearson_r), 6) AS abs_r FROM corr", **CORR))
def a15_feature_target_correlation(spark, d):
    return rounded(correlations(spark, d))


@query(over("samples", f"SELECT feature, target, n, round(pearson_r, 6) AS pearson_r, round(abs_r, 6) AS abs_r, round({p_value_sql('pearson_r', 'n')}, 6) AS p_value FROM (SELECT *, abs(pearson_r) AS abs_r FROM corr)", **CORR))
def a15_p_values(spark, d):
    return rounded(correlations(spark, d).withColumn("p_value", p_value(F.col("pearson_r"), F.col("n"))))


#: A ridge model of each target on the embedding, fitted on the training rows of a holdout by region, and its attributions on the others, in SQL.
RIDGE_STEPS = STUDY_STEPS | {
    "split": f"SELECT sample_id AS id, row_number() OVER (PARTITION BY region ORDER BY {draw('sample_id', seed=42)}, sample_id) <= round_even(count(*) OVER (PARTITION BY region) * CAST(0.3 AS DOUBLE), 0) AS held FROM samples",
    "member": "SELECT 0 AS c, id FROM split WHERE NOT held",
    "test": "SELECT id, row_number() OVER (ORDER BY id) AS r FROM split WHERE held",
    **ridge_steps({"embedding_only": 64}, len(CONTEXT)),
    "deviation": "SELECT f, avg(abs(x - m)) AS mad, avg(x - m) AS shift FROM (SELECT f, v[f + 2] AS x, avg(v[f + 2]) OVER (PARTITION BY f) AS m FROM test JOIN vec USING (id), (SELECT unnest(range(0, 64)) AS f)) GROUP BY f",
    "attribution": "SELECT target, 'A' || lpad(CAST(f AS VARCHAR), 2, '0') AS feature, abs(w[f + 1]) * mad AS mean_abs, w[f + 1] * shift AS mean_signed FROM weights JOIN targets USING (t), deviation",
}
RANKED = RIDGE_STEPS | CORR | {"paired": "SELECT feature, target, mean_abs, abs(pearson_r) AS abs_r FROM attribution JOIN corr USING (feature, target)"}


def held_out_ridge(spark, d):
    """(rows with ``_train``, weights by target): ridge on the embedding, fitted on seven tenths of each region's samples."""
    data = x.nested_bins(p.spread_embedding(tables.samples(spark, d)), ["region"], "sample_id", [F.bround(F.col("_n") * F.lit(0.3))], 42, "_train")
    (sums,) = gram_matrices(data, [*FEATURES, *tables.TARGETS], ["_train"])
    return data, {t: ridge_weights(sums["1"], list(range(1, 65)), 65 + i) for i, t in enumerate(tables.TARGETS)}


def importance(spark, d):
    """Attributions of the ridge models on held-out samples, beside the correlations."""
    data, weights = held_out_ridge(spark, d)
    found = studies.linear_attribution(data.filter("_train = 0"), FEATURES, weights)
    return found.join(correlations(spark, d), ["feature", "target"]).select("feature", "target", F.round("mean_abs", 9).alias("mean_abs"), F.round("abs_r", 9).alias("abs_r"))


@query(recursive(over("samples", "SELECT feature, target, round(mean_abs / sum(mean_abs) OVER (PARTITION BY target), 6) AS share, rank() OVER (PARTITION BY target ORDER BY mean_abs DESC) AS rank_1, rank() OVER (PARTITION BY target ORDER BY abs_r DESC) AS rank_2, (rank() OVER (PARTITION BY target ORDER BY mean_abs DESC) + rank() OVER (PARTITION BY target ORDER BY abs_r DESC)) / 2 AS combined_rank FROM (SELECT feature, target, round(mean_abs, 9) AS mean_abs, round(abs_r, 9) AS abs_r FROM paired)", **RANKED)))
def j2_w1_w2_feature_ranking(spark, d):
    shares = w.share_within(importance(spark, d), ["target"], "mean_abs")
    return rounded(w.feature_ranking(shares, "mean_abs", "abs_r").select("feature", "target", "share", "rank_1", "rank_2", "combined_rank"))


@query(recursive(over("samples", """SELECT feature, rank_1, rank_2, (rank_1 + rank_2) / 2 AS combined_score, row_number() OVER (ORDER BY (rank_1 + rank_2) / 2, feature) AS position FROM (
  SELECT feature, rank() OVER (ORDER BY a DESC) AS rank_1, rank() OVER (ORDER BY r DESC) AS rank_2 FROM (SELECT feature, round(avg(mean_abs), 8) AS a, round(max(abs_r), 8) AS r FROM paired GROUP BY feature))""", **RANKED)))
def a24_w3_overall_ranking(spark, d):
    per = importance(spark, d).groupBy("feature").agg(F.round(F.avg("mean_abs"), 8).alias("a"), F.round(F.max("abs_r"), 8).alias("r"))
    return w.overall_ranking(per, "a", "r").select("feature", "rank_1", "rank_2", "combined_score", "position")


J3 = " JOIN ".join(f"(SELECT region, {METRICS} FROM predictions WHERE fold {c} GROUP BY region) {a}" + ("" if a == "h" else " USING (region)") for a, c in (("h", "= 1"), ("f", "> 0"), ("g", "> 1")))


@query(over("predictions", f"SELECT region, round(h.r2, 6) AS held_out_r2, round(f.r2, 6) AS full_r2, round(g.r2, 6) AS gap_r2 FROM {J3}"))
def j3_three_way_metrics(spark, d):
    pr = tables.predictions(spark, d)
    part = lambda c, n: m.metrics_by(pr.filter(c), "region").select("region", F.col("r2").alias(n))
    return rounded(part("fold = 1", "held_out_r2").join(part("fold > 0", "full_r2"), "region").join(part("fold > 1", "gap_r2"), "region"))


BY_FOLD = over("predictions", f"SELECT region, fold, {METRICS} FROM predictions GROUP BY region, fold")


@query(f"SELECT a.region, round(a.r2, 6) AS r2_direct, round(b.r2, 6) AS r2_structural, round(a.r2 - b.r2, 6) AS gain FROM ({BY_FOLD}) a JOIN ({BY_FOLD}) b ON a.region = b.region AND a.fold = 1 AND b.fold = 2")
def j4_direct_against_structural(spark, d):
    t = m.metrics_by(tables.predictions(spark, d), "region", "fold")
    a, b = (t.filter(F.col("fold") == f).select("region", F.col("r2").alias(n)) for f, n in ((1, "r2_direct"), (2, "r2_structural")))
    return rounded(a.join(b, "region").withColumn("gain", F.col("r2_direct") - F.col("r2_structural")))


LAST = lambda f, n: f"SELECT l_orderkey, l_partkey, max(l_extendedprice) AS {n} FROM lineitem WHERE l_linenumber <= {f} GROUP BY ALL"


@query(f"SELECT l_orderkey, l_partkey, round(a.v - b.v, 6) AS structural, round(c.v, 6) AS actual FROM ({LAST(7, 'v')}) a JOIN ({LAST(5, 'v')}) b USING (l_orderkey, l_partkey) JOIN ({LAST(3, 'v')}) c USING (l_orderkey, l_partkey)")
def j5_u2_three_way_intersection(spark, d):
    li = tables.table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_partkey"]
    part = lambda f, n: w.ordered_distinct(li.filter(F.col("l_linenumber") <= f).select(*keys, F.col("l_extendedprice").alias(n)), keys, F.desc(n))
    return rounded(part(7, "vv").join(part(5, "vh"), keys).join(part(3, "actual"), keys).select(*keys, (F.col("vv") - F.col("vh")).alias("structural"), "actual"))


@query(over("pixels", "SELECT pixel_id, (image_row % 22 = 0 AND image_col % 22 = 0) AS is_train FROM pixels WHERE image_row <> 3"))
def j6_training_mask(spark, d):
    px = tables.pixels(spark, d)
    keys = ["tile", "image_row", "image_col"]
    train = x.grid(px, 0.002).select(*keys, F.lit(True).alias("is_train"))
    masked = px.filter("image_row = 3").select(*keys)
    return px.join(masked, keys, "left_anti").join(train, keys, "left").select("pixel_id", F.coalesce("is_train", F.lit(False)).alias("is_train"))


def _dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


COSINE = {
    "v": f"SELECT id, v, sqrt({_dot('v', 'v')}) AS len FROM (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
    "dist": f"SELECT a.id AS query, b.id AS neighbour, 1 - {_dot('a.v', 'b.v')} / (a.len * b.len) AS distance FROM v a, v b WHERE a.id <> b.id",
    "knn": "SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), neighbour) AS r FROM dist",
}



def embedding_knn(spark, d, k, skip=1):
    rows = tables.samples(spark, d).select("sample_id", "embedding")
    return knn(rows, "sample_id", "embedding", k, skip_first=skip)


@query(over("", "SELECT query, neighbour, round(distance, 6) AS distance, CAST(r - 1 AS INTEGER) AS rank FROM knn WHERE r BETWEEN 2 AND 11", **COSINE))
def j8_w9_cosine_knn(spark, d):
    return rounded(embedding_knn(spark, d, 10))


Z = {
    "stats": "SELECT " + ", ".join(f"avg({t}) AS m{i}, stddev_pop({t}) AS s{i}" for i, t in enumerate(tables.TARGETS)) + " FROM samples",
    "z": "SELECT sample_id AS id, " + ", ".join(f"({t} - m{i}) / s{i} AS z{i}" for i, t in enumerate(tables.TARGETS)) + " FROM samples, stats",
    "sdist": "SELECT a.id AS query, b.id AS neighbour, sqrt(pow(a.z0 - b.z0, 2) + pow(a.z1 - b.z1, 2) + pow(a.z2 - b.z2, 2)) AS distance FROM z a, z b WHERE a.id <> b.id",
    "sknn": "SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), neighbour) AS r FROM sdist",
}


def radar_knn(spark, d, k, skip=1):
    z = m.standardise(tables.samples(spark, d), list(tables.TARGETS))
    z = z.select("sample_id", F.array(*[f"z_{t}" for t in tables.TARGETS]).alias("z"))
    return knn(z, "sample_id", "z", k, metric="euclidean", skip_first=skip)


@query(over("samples", "SELECT query, neighbour, round(distance, 5) AS distance, CAST(r - 1 AS INTEGER) AS rank FROM sknn WHERE r BETWEEN 2 AND 6", **Z))
def j9_euclidean_knn(spark, d):
    return rounded(radar_knn(spark, d, 5), 5)


KM = {
    "km": "SELECT region, sample_id AS i, S1_VV AS v, longitude * CAST(111.32 AS DOUBLE) * cos(radians(avg(latitude) OVER (PARTITION BY region))) AS x, latitude * CAST(110.57 AS DOUBLE) AS y FROM samples",
    "near": "SELECT region, i, j, distance, r FROM (SELECT *, row_number() OVER (PARTITION BY region, i ORDER BY distance, j) AS r FROM (SELECT a.region, a.i, b.i AS j, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance FROM km a JOIN km b ON a.region = b.region AND a.i <> b.i)) WHERE r <= 8",
}


def spatial_edges(spark, d, cell=512):
    points = p.local_km(tables.samples(spark, d), ["region"])
    return points, s.spatial_knn(points, ["region"], "sample_id", 8, cell=cell)


@query(over("samples", "SELECT region, i, j, round(distance, 6) AS distance, CAST(r AS INTEGER) AS rank FROM near", **KM))
def j10_spatial_knn(spark, d):
    return rounded(spatial_edges(spark, d, 40)[1])


MORAN = KM | {
    "wts": "SELECT region, i, j, (1 / greatest(distance, 1e-9)) / sum(1 / greatest(distance, 1e-9)) OVER (PARTITION BY region, i) AS w FROM near",
    "zz": "SELECT region, i, v - avg(v) OVER (PARTITION BY region) AS z FROM km",
    "top": "SELECT wts.region, sum(w * a.z * b.z) AS zwz, sum(w) AS ww FROM wts JOIN zz a ON wts.i = a.i JOIN zz b ON wts.j = b.i GROUP BY 1",
    "bottom": "SELECT region, count(*) AS n, sum(z * z) AS s FROM zz GROUP BY region",
}


@query(over("samples", "SELECT region, n, round(n * zwz / (ww * s), 6) AS morans_i FROM bottom JOIN top USING (region)", **MORAN))
def a29_morans_i(spark, d):
    points, edges = spatial_edges(spark, d)
    return rounded(s.morans_i(points, s.inverse_distance_weights(edges, ["region"]), ["region"], "sample_id", "S1_VV"))


MORAN_P = MORAN | {
    "perms": f"SELECT region, perm, z, row_number() OVER (PARTITION BY region, perm ORDER BY {draw('i', 'perm', seed=42)}, i) AS r FROM zz, (SELECT unnest(range(1, 500)) AS perm)",
    "places": "SELECT region, i, row_number() OVER (PARTITION BY region ORDER BY i) AS r FROM zz",
    "dealt": "SELECT region, perm, i, z FROM perms JOIN places USING (region, r)",
    "scores": "SELECT wts.region, a.perm, sum(w * a.z * b.z) AS zwz FROM wts JOIN dealt a ON wts.i = a.i JOIN dealt b ON wts.j = b.i AND a.perm = b.perm GROUP BY ALL",
}


@query(over("samples", "SELECT region, n, round(first(n * top.zwz / (ww * s)), 6) AS morans_i, (count(*) FILTER (WHERE abs(scores.zwz) >= abs(top.zwz)) + 1) / CAST(500 AS DOUBLE) AS p_value FROM scores JOIN top USING (region) JOIN bottom USING (region) GROUP BY region, n", **MORAN_P))
def a29_morans_p(spark, d):
    points, edges = spatial_edges(spark, d)
    return rounded(s.morans_p(points, s.inverse_distance_weights(edges, ["region"]), ["region"], "sample_id", "S1_VV"))


@query(over("", "SELECT query, neighbour, round(distance, 6) AS distance FROM knn WHERE r = 1", **COSINE))
def j11_nearest_other_embedding(spark, d):
    return rounded(embedding_knn(spark, d, 1, 0).drop("rank"))


@query(over("samples", "SELECT a.region, count(*) AS n_pairs, round(sum(abs(a.S1_VV - b.S1_VV)), 4) AS total FROM samples a JOIN samples b ON a.region = b.region AND a.sample_id < b.sample_id GROUP BY a.region"))
def j12_pairs_within_groups(spark, d):
    return rounded(s.pair_differences(tables.samples(spark, d), "sample_id", "S1_VV", ["region"]), 4)


OVERLAP = COSINE | Z | {}
OVERLAP["ov"] = "SELECT q.query, q.k, count(b.worst) / q.k AS overlap FROM (SELECT DISTINCT query, k FROM knn, (SELECT unnest([5, 10, 20]) AS k)) q LEFT JOIN (SELECT a.query, greatest(a.r, b.r) - 1 AS worst FROM knn a JOIN sknn b ON a.query = b.query AND a.neighbour = b.neighbour WHERE a.r > 1 AND b.r > 1) b ON b.query = q.query AND b.worst <= q.k GROUP BY q.query, q.k"


def overlaps(spark, d):
    return s.neighbour_overlap(embedding_knn(spark, d, 20), radar_knn(spark, d, 20), [5, 10, 20])


@query(over("samples", "SELECT query, CAST(k AS INTEGER) AS k, round(overlap, 6) AS overlap FROM ov", **OVERLAP))
def j13_neighbour_overlap(spark, d):
    return rounded(overlaps(spark, d))




@query(over("samples", f"SELECT CAST(k AS INTEGER) AS k, region, dw_label_name, count(*) AS n, round(avg(overlap), 6) AS mean_overlap, round(median(overlap), 6) AS median_overlap, round(quantile_cont(overlap, 0.1), 6) AS p10, round(quantile_cont(overlap, 0.9), 6) AS p90 FROM ov JOIN samples ON query = sample_id GROUP BY GROUPING SETS ((k), (k, region), (k, dw_label_name))", **OVERLAP))
def a12_overlap_summary(spark, d):
    o = durable(overlaps(spark, d).join(tables.samples(spark, d).select(F.col("sample_id").alias("query"), "region", "dw_label_name"), "query"))
    return rounded(m.overlap_summary(o, [["k"], ["k", "region"], ["k", "dw_label_name"]]).drop("grouping"))


@query(over("predictions", f"SELECT region, round(r2, 6) AS r2, round(pearson_r, 6) AS pearson_r FROM (SELECT region, {METRICS} FROM predictions GROUP BY region) WHERE region = (SELECT min(l_returnflag) FROM lineitem)"))
def j14_scalar_lookup(spark, d):
    t = m.metrics_by(tables.predictions(spark, d), "region").select("region", "r2", "pearson_r")
    first = tables.predictions(spark, d).agg(F.min("region").alias("region"))
    return rounded(t.join(F.broadcast(first), "region"))


# ---- aggregations ----


def metric_sql(keys: str, source: str = "predictions") -> str:
    columns = [k for k in keys.split(", ") if k]
    return over("predictions", f"SELECT {', '.join([*columns, 'n', *[f'round({c}, 6) AS {c}' for c in METRIC_COLUMNS.split()]])} FROM (SELECT {', '.join([*columns, METRICS])} FROM {source} {'GROUP BY ' + keys if keys else ''})")


@query(metric_sql("region, dw_label_name"))
def a2_a3_metrics_by_group(spark, d):
    return rounded(m.metrics_by(tables.predictions(spark, d), "region", "dw_label_name"))


@query(over("predictions", f"SELECT region, dw_label_name, grouping, n, {', '.join(f'round({c}, 6) AS {c}' for c in METRIC_COLUMNS.split())} FROM (SELECT region, dw_label_name, CASE grouping(region) * 2 + grouping(dw_label_name) WHEN 1 THEN 'region' ELSE 'dw_label_name' END AS grouping, {METRICS} FROM predictions GROUP BY GROUPING SETS ((region), (dw_label_name)))"))
def a4_metrics_by_region_and_class(spark, d):
    return rounded(m.metrics_by_sets(tables.predictions(spark, d), [["region"], ["dw_label_name"]]))


RESIDUALS = "count(residual) AS n, avg(abs(residual)) AS mae, sqrt(avg(residual * residual)) AS rmse, avg(residual) AS bias, median(abs(residual)) AS median_abs, quantile_cont(abs(residual), 0.9) AS p90_abs, max(abs(residual)) AS max_abs"
_r5 = "mae rmse bias median_abs p90_abs max_abs"


@query(over("predictions", f"SELECT region, dw_label_name, n, {', '.join(f'round({c}, 6) AS {c}' for c in _r5.split())} FROM (SELECT region, dw_label_name, {RESIDUALS} FROM predictions GROUP BY GROUPING SETS ((region), (dw_label_name), (region, dw_label_name)))"))
def a5_a27_residual_summary(spark, d):
    sets = [["region"], ["dw_label_name"], ["region", "dw_label_name"]]
    return rounded(m.residual_summary(p.residuals(tables.predictions(spark, d)), sets).drop("grouping"))


@query(over("predictions", "SELECT region, round(avg(residual), 5) AS mean, round(stddev_pop(residual), 5) AS std, round(skewness(residual), 5) AS skew, round(kurtosis(residual), 5) AS kurtosis, round(quantile_cont(abs(residual), 0.9), 5) AS p90_abs, round(quantile_cont(abs(residual), 0.95), 5) AS p95_abs, round(max(abs(residual)), 5) AS max_abs FROM predictions GROUP BY region"))
def a6_residual_distribution(spark, d):
    return rounded(m.residual_distribution(p.residuals(tables.predictions(spark, d)), "region"), 5)


FOLDS = f"SELECT region, fold, r2, rmse FROM ({BY_FOLD})"


@query(f"SELECT region, count(*) AS n, round(avg(r2), 6) AS mean_r2, round(stddev_pop(r2), 6) AS std_r2, round(avg(rmse), 6) AS mean_rmse, round(stddev_pop(rmse), 6) AS std_rmse FROM ({FOLDS}) GROUP BY region")
def a7_cv_summary(spark, d):
    return rounded(m.mean_and_std(m.metrics_by(tables.predictions(spark, d), "region", "fold"), ["region"], ["r2", "rmse"]))


@query(f"SELECT region, count(*) AS n, round(avg(r2), 6) AS mean_r2, round(stddev_samp(r2), 6) AS std_r2 FROM ({FOLDS}) GROUP BY region")
def a8_stability_summary(spark, d):
    return rounded(m.mean_and_std(m.metrics_by(tables.predictions(spark, d), "region", "fold"), ["region"], ["r2"], population=False))


@query(f"SELECT region, fold, count(*) AS n, round(avg(r2), 6) AS mean_r2, coalesce(round(stddev_samp(r2), 6), 0) AS std_r2 FROM ({FOLDS}) GROUP BY region, fold")
def a9_a10_curve_summary(spark, d):
    return rounded(m.mean_and_std(m.metrics_by(tables.predictions(spark, d), "region", "fold"), ["region", "fold"], ["r2"], population=False, fill=0.0))


@query(over("samples", "SELECT region, dw_label_name, count(*) AS n_samples FROM samples GROUP BY GROUPING SETS ((region), (dw_label_name), (region, dw_label_name))"))
def a11_coverage(spark, d):
    return m.coverage(tables.samples(spark, d)).drop("grouping")


AUDIT = ", ".join(f"round(avg({t}), 6) AS {t}_mean, round(stddev_samp({t}), 6) AS {t}_std, round(min({t}), 6) AS {t}_min, round(max({t}), 6) AS {t}_max, round(skewness({t}), 6) AS {t}_skew" for t in tables.TARGETS)


@query(over("samples", f"SELECT count(*) AS n_rows, count(DISTINCT region) AS n_regions, count(DISTINCT dw_label) AS n_labels, count(DISTINCT spatial_block) AS n_blocks, 0.0::DOUBLE AS missing_share, count(*) - count(DISTINCT (region, dw_label, lat_bin)) AS duplicate_rows, {' + '.join(f'CAST(var_samp({e(i + 1)}) < 1e-2 AS INTEGER)' for i in range(64))} AS flat_features, {AUDIT} FROM (SELECT *, region || lat_bin || '_' || lon_bin AS spatial_block FROM blocks)", **BLOCKS))
def a13_dataset_audit(spark, d):
    blocks = x.spatial_blocks(p.spread_embedding(tables.samples(spark, d)), "sample_id")
    return rounded(m.audit(blocks, key_columns=["region", "dw_label", "lat_bin"], region="region", label="dw_label", block="spatial_block", features=FEATURES, targets=list(tables.TARGETS), flat=1e-2))


PAIRS = {"l": "SELECT sample_id, 'A' || lpad(CAST(i AS VARCHAR), 2, '0') AS i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM samples, LATERAL (SELECT unnest(range(0, 64)) AS i)", "cor": "SELECT x.i AS a, y.i AS b, corr(x.v, y.v) AS r FROM l x JOIN l y ON x.sample_id = y.sample_id AND x.i < y.i GROUP BY a, b"}


@query(over("samples", "SELECT a, b, round(r, 6) AS r FROM cor", **PAIRS))
def a14_embedding_correlation(spark, d):
    return rounded(correlation_pairs(p.spread_embedding(tables.samples(spark, d)), FEATURES))


@query(over("samples", "SELECT l AS above, count(r) FILTER (WHERE abs(r) > l) AS n_pairs FROM cor, (SELECT CAST(unnest([0.05, 0.1, 0.5, 0.95]) AS DOUBLE) AS l) GROUP BY l", **PAIRS))
def a14_strong_pairs(spark, d):
    """How many pairs of dimensions have a correlation beyond a limit, 0.95 in the audit."""
    found = correlation_pairs(p.spread_embedding(tables.samples(spark, d)), FEATURES)
    limits = F.explode(F.array(*map(F.lit, (0.05, 0.1, 0.5, 0.95)))).alias("above")
    return found.select("r", limits).groupBy("above").agg(F.count_if(F.abs("r") > F.col("above")).alias("n_pairs"))


_UNITS = ", ".join(f"({t} - (SELECT avg({t}) FROM samples)) / (SELECT stddev_pop({t}) FROM samples) AS z{i}" for i, t in enumerate(tables.TARGETS))
_COSINE = "1 - list_inner_product(x.v, y.v) / (sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v)))"
DISTANCES = {
    "placed": f"SELECT sample_id, region, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v, {_UNITS} FROM samples",
    "met": f"SELECT g, round({_COSINE}, 9) AS u, round(sqrt((x.z0 - y.z0) ** 2 + (x.z1 - y.z1) ** 2 + (x.z2 - y.z2) ** 2), 9) AS w FROM pairs JOIN placed x ON x.sample_id = a JOIN placed y ON y.sample_id = b",
    "ranked": "SELECT *, rank() OVER (PARTITION BY g ORDER BY u) + (count(*) OVER (PARTITION BY g, u) - 1) / 2 AS ru, rank() OVER (PARTITION BY g ORDER BY w) + (count(*) OVER (PARTITION BY g, w) - 1) / 2 AS rw FROM met",
    "found": "SELECT g, count(*) AS n_pairs, corr(u, w) AS pearson_r, corr(ru, rw) AS spearman_rho FROM ranked GROUP BY g",
}


def standard_samples(spark, d):
    """Samples with the three targets standardised over all rows."""
    rows = tables.samples(spark, d).select("sample_id", "region", "embedding", *tables.TARGETS)
    sums = rows.agg(*[f(t).alias(f"_{k}{i}") for i, t in enumerate(tables.TARGETS) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    return rows.crossJoin(F.broadcast(sums)).select("sample_id", "region", "embedding", *[standardised(F.col(t), F.col(f"_m{i}"), F.col(f"_s{i}")).alias(t) for i, t in enumerate(tables.TARGETS)])


def distance_study(spark, d, group):
    """Correlation of embedding and radar distances over up to 200,000 drawn pairs of each group."""
    rows = standard_samples(spark, d)
    pairs = x.pair_draw(rows.select(*group, "sample_id"), "sample_id", 200_000, 42, group)
    met = s.pair_distances(rows, pairs, "sample_id", "embedding", list(tables.TARGETS))
    return rounded(s.distance_correlation(met, "cosine", "euclidean", group, ["a", "b"]))


@query(over("samples", "SELECT n_pairs, round(pearson_r, 6) AS pearson_r, round(spearman_rho, 6) AS spearman_rho FROM found", **pair_steps("samples", "sample_id", 200_000, 42), **DISTANCES))
def a16_overall_distance_correlation(spark, d):
    return distance_study(spark, d, []).drop("pearson_p", "spearman_p")


@query(over("samples", f"SELECT g AS region, n_pairs, round(pearson_r, 6) AS pearson_r, round(spearman_rho, 6) AS spearman_rho, round({p_value_sql('pearson_r', 'n_pairs')}, 6) AS pearson_p, round({p_value_sql('spearman_rho', 'n_pairs')}, 6) AS spearman_p FROM found", **pair_steps("samples", "sample_id", 200_000, 42, "region"), **DISTANCES))
def a16_w5_distance_correlation(spark, d):
    return distance_study(spark, d, ["region"])


@query(over("samples", "SELECT region, n, round((1 - avg_d), 6) AS mean_cosine FROM (SELECT region, avg(distance) AS avg_d FROM dist JOIN samples a ON query = a.sample_id JOIN (SELECT sample_id, region AS r2 FROM samples) b ON neighbour = b.sample_id AND region = r2 GROUP BY region) JOIN (SELECT region, count(*) AS n FROM samples GROUP BY region) USING (region)", **COSINE))
def a17_mean_pairwise_cosine(spark, d):
    return rounded(s.mean_pairwise_cosine(tables.samples(spark, d), ["region"]))


@query(over("samples", "SELECT round(sum(n) * sum(n) / sum(n * n), 6) AS effective_n, avg(n) AS mean_size, max(n) AS max_size, count(*) AS n_groups FROM (SELECT count(*) AS n FROM samples GROUP BY region, dw_label)"))
def a18_effective_size(spark, d):
    return rounded(s.effective_size(tables.samples(spark, d), ["region", "dw_label"]))


@query(over("", "SELECT round(avg(1 - distance), 6) AS mean_cosine, round(quantile_cont(1 - distance, 0.95), 6) AS p95_cosine FROM knn WHERE r = 1", **COSINE))
def a19_nearest_cosine(spark, d):
    near = embedding_knn(spark, d, 1, 0).withColumn("c", 1 - F.col("distance"))
    return rounded(m.with_quantiles(near.agg(F.avg("c").alias("mean_cosine")), near, [], "c", {"p95_cosine": 0.95}))


@query("SELECT count(*) - count(DISTINCT embedding) AS duplicates FROM (SELECT embedding FROM embeddings UNION ALL SELECT embedding FROM embeddings WHERE vec_id % 10 = 0)")
def a20_u5_duplicate_vectors(spark, d):
    v = tables.samples(spark, d).select("sample_id", "embedding")
    return s.duplicate_vectors(v.union(v.filter("sample_id % 10 = 0")))


@query(over("predictions", f"SELECT round(avg(r2), 6) AS mean_r2, round(median(r2), 6) AS median_r2, round(avg(rmse), 6) AS mean_rmse, round(avg(mae), 6) AS mean_mae, round(avg(pearson_r), 6) AS mean_pearson_r, arg_max(band, r2) AS best_band, arg_min(band, r2) AS worst_band FROM (SELECT region AS band, {METRICS} FROM predictions GROUP BY region)"))
def a21_band_summary(spark, d):
    return rounded(m.band_summary(m.metrics_by(tables.predictions(spark, d), "region").withColumnRenamed("region", "band")))


@query(over("predictions", f"SELECT fold, round(avg(r2), 6) AS r2, round(avg(rmse), 6) AS rmse, round(avg(mae), 6) AS mae FROM (SELECT fold, region, {METRICS} FROM predictions GROUP BY fold, region) GROUP BY fold"))
def a22_sweep_summary(spark, d):
    t = m.metrics_by(tables.predictions(spark, d), "fold", "region")
    return rounded(t.groupBy("fold").agg(*[F.avg(c).alias(c) for c in ("r2", "rmse", "mae")]))


@query("""SELECT target, coalesce(sum(CASE WHEN family = 'embedding' THEN s END), 0) / t AS embedding, coalesce(sum(CASE WHEN family = 'region' THEN s END), 0) / t AS region, coalesce(sum(CASE WHEN family = 'context' THEN s END), 0) / t AS context FROM (
  SELECT *, sum(s) OVER (PARTITION BY target) AS t FROM (SELECT p_brand AS target, CASE WHEN p_size <= 20 THEN 'embedding' WHEN p_size <= 35 THEN 'region' ELSE 'context' END AS family, sum(greatest(p_size - 10, 0))::DOUBLE AS s FROM part GROUP BY ALL)) GROUP BY target, t""")
def a25_family_shares(spark, d):
    size = F.col("p_size")
    t = tables.table(spark, d, "part").select(F.col("p_brand").alias("target"), F.when(size <= 20, "embedding").when(size <= 35, "region").otherwise("context").alias("family"), (size - 10).cast("double").alias("importance"))
    return m.family_shares(t, ["embedding", "region", "context"])


@query(over("predictions", "SELECT region, count(residual) AS n, round(avg(residual), 6) AS mean, round(median(residual), 6) AS median, round(sqrt(avg(residual * residual)), 6) AS rmse, round(avg(abs(residual)), 6) AS mae FROM predictions GROUP BY region"))
def a26_residual_by_region(spark, d):
    return rounded(m.residual_by_region(p.residuals(tables.predictions(spark, d))))


@query(over("predictions", """SELECT round(edges[b], 6) AS lo, round(edges[b + 1], 6) AS hi, count(*) AS n, round(avg(abs(residual)), 6) AS mae, round(avg(residual), 6) AS bias, round(sqrt(avg(residual * residual)), 6) AS rmse FROM (
  SELECT residual, edges, greatest(len(list_filter(edges, lambda x: x < actual)), 1) AS b FROM predictions, (SELECT quantile_cont(actual, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS edges FROM predictions)) GROUP BY 1, 2"""))
def a28_failure_by_value(spark, d):
    return rounded(m.failure_by_value(p.residuals(tables.predictions(spark, d))))


@query(over("pixels", "SELECT round(quantile_cont(sqrt((pow(1 - S1_VV / 10, 2) + pow(2 - S1_VH / 10, 2)) / 2), 0.98), 6) AS \"limit\" FROM pixels WHERE S1_VV IS NOT NULL"))
def a30_pixel_rmse_limit(spark, d):
    px = tables.pixels(spark, d).filter("S1_VV is not null").select((F.col("S1_VV") / 10).alias("a"), (F.col("S1_VH") / 10).alias("b"), F.lit(1).alias("p"), F.lit(2).alias("q"))
    return rounded(m.display_limit(m.pixel_rmse(px, [("a", "p"), ("b", "q")]), "rmse"))


@query(over("predictions", "SELECT region, n, round(CASE WHEN c = 0 THEN 0 ELSE r2 END, 6) AS r2, round(rmse, 6) AS rmse FROM (SELECT fold AS region, var_pop(one) AS c, count(*) AS n, coalesce(1 - sum(pow(predicted - one, 2)) / nullif(var_pop(one) * count(*), 0), 0) AS r2, sqrt(avg(pow(predicted - one, 2))) AS rmse FROM (SELECT *, CASE WHEN fold = 3 THEN 5 ELSE actual END AS one FROM predictions) GROUP BY fold)"))
def a31_strategy_metrics(spark, d):
    pr = tables.predictions(spark, d).withColumn("one", F.when(F.col("fold") == 3, 5.0).otherwise(F.col("actual")))
    return rounded(m.metrics_by(pr, "fold", actual="one", zero_variance=0.0).select(F.col("fold").alias("region"), "n", "r2", "rmse"))


@query(over("samples", "SELECT id AS sample_id, round(z0, 6) AS z_S1_VV, round(z1, 6) AS z_S1_VH, round(z2, 6) AS z_S1_VV_div_VH FROM z", **Z))
def a32_standardise(spark, d):
    return rounded(m.standardise(tables.samples(spark, d), list(tables.TARGETS)).select("sample_id", *[f"z_{t}" for t in tables.TARGETS]))


@query(over("samples", "SELECT CAST(k AS INTEGER) AS k, k / (n - 1) AS expected FROM (SELECT count(*) AS n FROM samples), (SELECT unnest([5, 10, 20]) AS k)"))
def a33_random_overlap(spark, d):
    n = tables.samples(spark, d).agg(F.count("*").alias("n"))
    return n.select(F.explode(F.array(F.lit(5), F.lit(10), F.lit(20))).alias("k"), "n").select("k", F.when(F.col("n") > 1, F.col("k") / (F.col("n") - 1)).otherwise(0.0).alias("expected"))


@query(over("predictions", """SELECT region AS band, round(avg(least(greatest((actual - lo) / (hi - lo), 0), 1)), 6) AS actual, round(avg(least(greatest((predicted - lo) / (hi - lo), 0), 1)), 6) AS predicted FROM predictions JOIN (
  SELECT region AS r, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM (SELECT region, actual AS v FROM predictions UNION ALL SELECT region, predicted FROM predictions) GROUP BY region) ON region = r GROUP BY region"""))
def a34_joint_stretch(spark, d):
    long = tables.predictions(spark, d).select(F.col("region").alias("band"), "actual", "predicted")
    return rounded(m.stretched(long, m.stretch_limits(long)).groupBy("band").agg(F.avg("actual").alias("actual"), F.avg("predicted").alias("predicted")))


@query(over("predictions", "SELECT CAST(b AS INTEGER) AS bin, round(lo + (hi - lo) * b / 28, 6) AS left_edge, count(residual) AS n FROM (SELECT min(residual) AS lo, max(residual) AS hi FROM predictions), LATERAL (SELECT unnest(range(0, 28)) AS b) LEFT JOIN predictions ON least(floor((residual - lo) / (hi - lo) * 28), 27) = b GROUP BY ALL"))
def a35_histogram(spark, d):
    return rounded(m.histogram(p.residuals(tables.predictions(spark, d)), "residual", 28))


@query(over("predictions", """SELECT region, round(q[1], 6) AS q1, round(q[2], 6) AS median, round(q[3], 6) AS q3, round(min(CASE WHEN ok THEN residual END), 6) AS whisker_low, round(max(CASE WHEN ok THEN residual END), 6) AS whisker_high FROM (
  SELECT region, q, residual, residual BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1]) AS ok FROM predictions JOIN (SELECT region AS r, quantile_cont(residual, [0.25, 0.5, 0.75]) AS q FROM predictions GROUP BY region) ON region = r) GROUP BY region, q"""))
def a36_box_stats(spark, d):
    return rounded(m.box_stats(p.residuals(tables.predictions(spark, d)), "region", "residual"))


@query(f"SELECT fold, round(max(r2) - min(r2), 6) AS spread FROM ({FOLDS}) GROUP BY fold")
def a37_spread(spark, d):
    return rounded(m.spread(m.metrics_by(tables.predictions(spark, d), "region", "fold"), ["fold"]))


@query(f"SELECT round(min(r), 6) AS lowest, round(max(r), 6) AS highest FROM (SELECT region, avg(r2) AS r FROM ({FOLDS}) GROUP BY region)")
def a38_pooled_summary(spark, d):
    per = m.metrics_by(tables.predictions(spark, d), "region", "fold").groupBy("region").agg(F.avg("r2").alias("r"))
    return rounded(per.agg(F.min("r").alias("lowest"), F.max("r").alias("highest")))


# ---- rankings, order, sets ----


@query("SELECT y, total, round(total - lag(total) OVER (ORDER BY y), 2) AS delta FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ORDER BY delta DESC NULLS LAST LIMIT 1")
def w6_largest_jump(spark, d):
    per = tables.table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return w.largest_jump(per, "y", "total").select("y", "total", F.round("delta", 2).alias("delta"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def w7_best_per_group(spark, d):
    return w.best_per_group(tables.table(spark, d, "orders"), ["o_custkey"], F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


CURVES = "SELECT region AS target, dw_label_name AS feature_set, CASE WHEN fold % 2 = 0 THEN 'ridge' ELSE 'trees' END AS model, CASE WHEN fold <= 2 THEN 0.4 WHEN fold <= 4 THEN 0.8 ELSE 1.0 END AS fraction, r2 FROM (SELECT region, dw_label_name, fold, " + METRICS + " FROM predictions GROUP BY ALL)"


@query(over("predictions", "SELECT target, feature_set, model, round(best_r2, 6) AS best_r2, round(r2_at_80, 6) AS r2_at_80, round(r2_at_100, 6) AS r2_at_100, round(r2_at_100 - r2_at_80, 6) AS tail_gain FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY best_r2 DESC, feature_set, model) AS r FROM per) WHERE r = 1", curves=CURVES, per="SELECT target, feature_set, model, max(r2) AS best_r2, max(CASE WHEN fraction = 0.8 THEN r2 END) AS r2_at_80, max(CASE WHEN fraction = 1.0 THEN r2 END) AS r2_at_100 FROM curves GROUP BY ALL"))
def w8_best_curve(spark, d):
    fold = F.col("fold")
    t = m.metrics_by(tables.predictions(spark, d), "region", "dw_label_name", "fold")
    curves = t.select(F.col("region").alias("target"), F.col("dw_label_name").alias("feature_set"), F.when(fold % 2 == 0, "ridge").otherwise("trees").alias("model"), F.when(fold <= 2, 0.4).when(fold <= 4, 0.8).otherwise(1.0).alias("fraction"), "r2")
    return rounded(w.best_curve(curves))


W10 = """SELECT sample_id, reason FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n) AS r FROM (
  SELECT 1 AS n, 'highest' AS reason, (SELECT sample_id FROM samples ORDER BY S1_VV DESC, sample_id LIMIT 1) AS sample_id UNION ALL SELECT 2, 'lowest', (SELECT sample_id FROM samples ORDER BY S1_VV, sample_id LIMIT 1)
  UNION ALL SELECT 3, 'median_water', (SELECT sample_id FROM samples, (SELECT median(S1_VV) AS q FROM samples WHERE dw_label_name = 'water') WHERE dw_label_name = 'water' ORDER BY abs(S1_VV - q), sample_id LIMIT 1)
  UNION ALL SELECT 4, 'median_crops', (SELECT sample_id FROM samples, (SELECT median(S1_VV) AS q FROM samples WHERE dw_label_name = 'crops') WHERE dw_label_name = 'crops' ORDER BY abs(S1_VV - q), sample_id LIMIT 1))) WHERE r = 1"""


@query(over("samples", W10))
def w10_representative_queries(spark, d):
    return w.representative_queries(tables.samples(spark, d), "sample_id", "S1_VV", "dw_label_name", ("water", "crops")).select("sample_id", "reason")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY abs(o_totalprice - 250000) DESC, o_orderkey) AS INTEGER) AS outlier_rank FROM orders ORDER BY abs(o_totalprice - 250000) DESC, o_orderkey LIMIT 20")
def w11_outliers(spark, d):
    o = tables.table(spark, d, "orders").withColumn("residual", F.col("o_totalprice") - 250000)
    return w.outliers(o, "residual", "o_orderkey", 20).select("o_orderkey", "outlier_rank")


@query(over("predictions", "SELECT region, coalesce(round(avg(CASE WHEN dw_label_name = 'F' THEN abs(residual) END), 6), 0) AS F, coalesce(round(avg(CASE WHEN dw_label_name = 'O' THEN abs(residual) END), 6), 0) AS O FROM predictions GROUP BY region"))
def w12_pivot(spark, d):
    t = p.residuals(tables.predictions(spark, d)).groupBy("region", "dw_label_name").agg(F.avg("abs_residual").alias("mae"))
    return rounded(w.pivoted(t, "region", "dw_label_name", ["F", "O"], "mae"))


@query("SELECT p_brand, round(a, 6) AS mean_size, CAST(row_number() OVER (ORDER BY a, p_brand) AS INTEGER) AS place FROM (SELECT p_brand, avg(p_size) AS a FROM part GROUP BY p_brand)")
def w13_l1_group_mean_order(spark, d):
    from pyspark.sql import Window

    t = tables.table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_size").alias("mean_size"))
    return rounded(t.withColumn("place", F.row_number().over(Window.orderBy("mean_size", "p_brand"))))


@query(over("predictions", "SELECT region, dw_label_name, round(avg(abs(residual)), 6) AS mae FROM predictions GROUP BY ALL ORDER BY avg(abs(residual)) DESC, region, dw_label_name LIMIT 3"))
def l2_hardest_groups(spark, d):
    t = p.residuals(tables.predictions(spark, d)).groupBy("region", "dw_label_name").agg(F.avg("abs_residual").alias("mae"))
    return rounded(t.orderBy(F.desc("mae"), "region", "dw_label_name").limit(3))


@query(over("samples", "SELECT sample_id, CAST(CASE region WHEN 'iowa_ag' THEN 0 WHEN 'amazon_forest' THEN 1 ELSE 2 END AS INTEGER) AS category_position FROM samples"))
def l3_category_order(spark, d):
    return w.category_order(tables.samples(spark, d), "region", ["iowa_ag", "amazon_forest"]).select("sample_id", "category_position")


@query("SELECT source, count(*) AS n, count(DISTINCT k) AS keys FROM (SELECT 'customer' AS source, c_nationkey AS k FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY source")
def u1_union_of_frames(spark, d):
    c = tables.table(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("k"))
    u = c.unionByName(tables.table(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("k")))
    return u.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("k").alias("keys"))


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def u4_ordered_distinct(spark, d):
    return w.ordered_distinct(tables.table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey")


