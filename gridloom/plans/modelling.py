"""Queries on models, studies and the stream."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gridloom.functions.stats import hash01, regression_metrics
from gridloom.operators import metrics as m
from gridloom.operators import models as o
from gridloom.operators import projections as p
from gridloom.operators import sampling as x
from gridloom.operators import studies
from gridloom.operators.ranking import best_per_group
from gridloom.plans import solver
from gridloom.plans.analytics import FOLD_STEPS, RIDGE_STEPS, folded, held_out_ridge, repeated_folds
from gridloom.plans.imagery import BANDS, filled_pixels
from gridloom.plans.registry import VIEWS, draw, over, query, rounded
from gridloom.plans.solver import CONTEXT, FEATURES, SETS, STUDY_SETS, STUDY_STEPS, recursive, study_rows
from gridloom.sources import sinks, tables
from gridloom.sources.scratch import durable, scratch_path
from gridloom.streaming.running import run_available

QUICK = {"maxIter": 15, "stepSize": 0.2, "maxDepth": 3}


def split_rows(spark, d, width=len(FEATURES)):
    """Samples with their split, in parts. They are moved with the embedding as it is, and its columns are made where they lie."""
    s = x.stratified_holdout(tables.samples(spark, d), ["region"], "sample_id", 0.3, 42)
    return p.spread_embedding(o.in_parts(s, ["sample_id"], tables.samples(spark, d).count(), width))


def split_samples(spark, d, columns=FEATURES):
    s = p.feature_vector(split_rows(spark, d, len(columns)), columns)
    return p.require_splits(s.drop("embedding", *FEATURES).cache())


def scored(df, pairs, *keys):
    return m.metrics_by(m.long_bands(df, pairs, list(keys)), "band", *keys)


@query()
def m1_m2_multi_output_trees(spark, d):
    data = split_samples(spark, d)
    model = o.fit_multi(data.filter("split = 'train'"), list(tables.TARGETS), **QUICK)
    return scored(model.transform(data.filter("split = 'test'")), {t: (t, f"{t}_hat") for t in tables.TARGETS})


@query()
def m3_reconstruction(spark, d):
    """All three bands of a scene by trees from all 64 embedding values: (band, is_gap) and metrics, observed pixels and gaps apart."""
    bands, keys, share = list(tables.TARGETS), ["tile", "image_row", "image_col"], 0.1
    px = tables.pixels(spark, d, with_embedding=True).filter(p.valid_pixel(bands, "embedding"))
    px = p.feature_vector(p.spread_embedding(px), FEATURES).select(*keys, *bands, "features")
    train = o.in_parts(x.bernoulli(px, keys, share, 42), keys, round(share * tables.pixels(spark, d).count()), len(FEATURES)).cache()
    out = o.reconstruct(px, hash01(*keys, seed=42) < share, o.fit_multi(train, bands, **QUICK), bands)
    # One pass: the metrics and the check that every pixel has a value come from the same few rows.
    long = m.long_bands(out.withColumn("is_gap", ~F.col("is_train")), {b: (b, f"{b}_filled") for b in bands}, ["is_gap"])
    found = long.groupBy("band", "is_gap").agg(*regression_metrics(F.col("actual"), F.col("predicted")), F.count_if(F.col("predicted").isNull()).alias("missing"))
    return p.require_none_missing(durable(found.orderBy("band", "is_gap")))


RECONSTRUCTION_SQL = recursive(over(
    "pixels",
    f"""SELECT band, part, count(*) AS n, {solver.selected("r2", "rmse", "mae", "bias", "pearson_r")} FROM (
  SELECT target AS band, part, v[65 + t] AS a, CASE WHEN is_train THEN v[65 + t] ELSE {solver.PREDICTION} END AS q FROM flagged JOIN vec USING (id), weights JOIN targets USING (t), (SELECT unnest(['all', 'gap']) AS part) WHERE part = 'all' OR NOT is_train) GROUP BY band, part""",
    valid="SELECT pixel_id AS id, tile, image_row, image_col, S1_VV, S1_VH, S1_VV_div_VH, embedding FROM pixels JOIN embeddings ON vec_id = pixel_id % (SELECT count(*) FROM embeddings) WHERE S1_VV IS NOT NULL",
    vec="SELECT id, [1.0::DOUBLE] || list_transform(embedding, lambda x: CAST(x AS DOUBLE)) || [S1_VV, S1_VH, S1_VV_div_VH] AS v FROM valid", targets=STUDY_STEPS["targets"],
    flagged=f"SELECT id, {draw('tile', 'image_row', 'image_col', seed=42)} < CAST(0.1 AS DOUBLE) AS is_train FROM valid", member="SELECT 0 AS c, id FROM flagged WHERE is_train",
    **solver.ridge_steps({"all": 64}, 64),
))


@query(RECONSTRUCTION_SQL)
def m3_three_band_reconstruction(spark, d):
    """All three bands of a scene from all 64 embedding values, measured over all pixels and over the gaps."""
    px = p.spread_embedding(tables.pixels(spark, d, with_embedding=True).filter("S1_VV is not null")).drop("embedding")
    filled = studies.reconstruction(px, ["tile", "image_row", "image_col"], FEATURES, list(tables.TARGETS), 0.1)
    parts = F.explode(F.when(F.col("is_train"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("gap"))))
    long = m.long_bands(filled, {t: (t, f"{t}_filled") for t in tables.TARGETS}, ["is_train"]).withColumn("part", parts)
    return rounded(long.groupBy("band", "part").agg(*regression_metrics(F.col("actual"), F.col("predicted"))))


RIDGE_SQL = over("samples", """SELECT region, round(sy - w * sx, 6) AS intercept, round(w, 6) AS slope FROM (
  SELECT region, avg(v) AS sx, avg(S1_VV) AS sy, covar_pop(v, S1_VV) * count(*) / (var_pop(v) * count(*) + 1) AS w FROM (SELECT region, S1_VV, CAST(embedding[1] AS DOUBLE) AS v FROM samples) GROUP BY region)""")


@query(RIDGE_SQL)
def m4_ridge_by_subset(spark, d):
    fits = o.ridge_fits(p.spread_embedding(tables.samples(spark, d), 1), ["region"], ["A00"], "S1_VV")
    return rounded(fits.select("region", F.col("coefficients")[0].alias("intercept"), F.col("coefficients")[1].alias("slope")))


LOG_SQL = recursive(over(
    "samples",
    f"""SELECT band, count(*) AS n, {solver.selected("r2", "rmse", "mae", "bias", "pearson_r")} FROM (
  SELECT CASE t WHEN 1 THEN 'S1_VV' WHEN 2 THEN 'S1_VH' WHEN 3 THEN 'S1_VV_div_VH' ELSE 'ratio' END AS band, CASE WHEN t < 4 THEN v[65 + t] ELSE exp(v[69]) END AS a, CASE WHEN t < 4 THEN q ELSE exp(q) END AS q FROM fitted
  UNION ALL SELECT 'structural', first(v[68]), sum(CASE t WHEN 1 THEN q WHEN 2 THEN -q END) FROM fitted WHERE t < 3 GROUP BY id) GROUP BY band""",
    vec="SELECT sample_id AS id, [1.0::DOUBLE] || list_transform(embedding, lambda x: CAST(x AS DOUBLE)) || [S1_VV, S1_VH, S1_VV_div_VH, ln(pow(10, S1_VV / 10) / greatest(pow(10, S1_VH / 10), 1e-6))] AS v FROM samples",
    split=RIDGE_STEPS["split"], member=RIDGE_STEPS["member"], test=RIDGE_STEPS["test"], **solver.ridge_steps({"all": 64}, 64, 4),
    fitted=f"SELECT id, t, v, {solver.PREDICTION} AS q FROM test JOIN vec USING (id), weights",
))


@query(LOG_SQL)
def m4_m5_m6_ridge_log_and_structural(spark, d):
    data = p.ratio_targets(split_samples(spark, d), "S1_VV", "S1_VH", space="linear").cache()
    train, test = data.filter("split = 'train'"), data.filter("split = 'test'")
    for t in tables.TARGETS:
        test = o.ridge(train, t, f"{t}_hat").transform(test)
    test = o.predict_log(o.log_ridge(train, "ratio", "ratio_hat"), test, "ratio_hat")
    test = o.structural_difference(test, "S1_VV_hat", "S1_VH_hat", "structural")
    return rounded(scored(test, {t: (t, f"{t}_hat") for t in tables.TARGETS} | {"structural": ("S1_VV_div_VH", "structural"), "ratio": ("ratio", "ratio_hat")}))


#: Eight parameters, as far as level-wise trees have the study's.
SPACE = {"maxDepth": [2, 3, 4], "maxIter": [8, 12], "stepSize": [0.1, 0.2, 0.3], "minInstancesPerNode": [5, 20], "subsamplingRate": [0.7, 0.85, 1.0], "featureSubsetStrategy": ["0.5", "0.85"], "maxBins": [16, 32], "minInfoGain": [0.0, 0.001]}


@query()
def m7_random_search(spark, d):
    data = p.feature_vector(p.spread_embedding(folded(spark, d)), FEATURES).select("sample_id", "features", "fold", "S1_VV")
    data = o.in_parts(data, ["sample_id"], tables.samples(spark, d).count(), len(FEATURES)).drop("sample_id").cache()
    return o.random_search(data, "S1_VV", "fold", SPACE, 4)


@query()
def m8_early_stopping(spark, d):
    data = split_samples(spark, d, FEATURES)
    held = data.filter("split = 'test'")
    model, errors = o.fit_with_patience(data.filter("split = 'train'"), held, "S1_VV", "hat", maxIter=40, stepSize=0.3, maxDepth=3)
    return model.transform(held).agg(*regression_metrics(F.col("S1_VV"), F.col("hat"))).withColumns({"trees": F.lit(model.getNumTrees), "fitted_trees": F.lit(len(errors))})


@query(recursive(over("samples", "SELECT target, feature, round(mean_abs, 6) AS mean_abs, round(mean_signed, 6) AS mean_signed FROM attribution", **RIDGE_STEPS)))
def m9_a23_linear_attribution(spark, d):
    data, weights = held_out_ridge(spark, d)
    return rounded(studies.linear_attribution(data.filter("_train = 0"), FEATURES, weights))


@query()
def m10_gain_and_split_importance(spark, d):
    data = split_samples(spark, d, FEATURES)
    return o.gain_importance(data, o.boosted_trees("S1_VV", "hat", **QUICK).fit(data.filter("split = 'train'")), FEATURES)


SEEDS = [42, 52, 62]
FRACTIONS, FRACTION_SEEDS = [0.1, 0.2, 0.4, 0.6, 0.8, 1.0], [13, 23, 33]
PERCENTS = [0.0, 0.001, 0.0025, 0.005, 0.01, 0.02, 0.05, 0.075, 0.1, 0.2, 1.0]


CV_SQL = recursive(over(
    "samples",
    f"""SELECT s AS feature_set, target, seed, fold, count(*) AS n_valid, {solver.selected("r2", "rmse", "mae", "bias", "pearson_r")} FROM (
  SELECT s, target, seed, fold, v[78 + t] AS a, {solver.PREDICTION} AS q FROM folds JOIN vec ON id = sample_id JOIN weights ON c = seed * 10 + fold JOIN targets USING (t)) GROUP BY ALL""",
    **FOLD_STEPS, **STUDY_STEPS, member="SELECT seed * 10 + x.fold AS c, sample_id AS id FROM folds f, (SELECT unnest(range(0, 4)) AS fold) x WHERE f.fold <> x.fold", **solver.ridge_steps(STUDY_SETS, len(CONTEXT)),
))


@query(CV_SQL)
def m12_m14_repeated_grouped_cv(spark, d):
    data = repeated_folds(spark, d, SEEDS).join(study_rows(spark, d), "sample_id")
    return rounded(studies.repeated_cv(data, {s: f"fold_{s}" for s in SEEDS}, SETS, list(tables.TARGETS)))


CURVE_SQL = recursive(over(
    "samples",
    f"""SELECT * FROM (
  SELECT s AS feature_set, target, fraction, seed, count(*) AS n_train, {solver.selected("r2", "rmse", prefix="train_")} FROM (
    SELECT s, target, fraction, seed, v[78 + t] AS a, {solver.PREDICTION} AS q FROM cases JOIN member USING (c) JOIN vec USING (id) JOIN weights USING (c) JOIN targets USING (t)) GROUP BY ALL)
JOIN (SELECT s AS feature_set, target, fraction, seed, {solver.selected("r2", "rmse", prefix="valid_")} FROM (
    SELECT s, target, fraction, seed, v[78 + t] AS a, {solver.PREDICTION} AS q FROM cases JOIN weights USING (c) JOIN targets USING (t), split JOIN vec ON id = sample_id WHERE held) GROUP BY ALL) USING (feature_set, target, fraction, seed)""",
    **STUDY_STEPS,
    split=f"SELECT *, row_number() OVER (PARTITION BY region, dw_label ORDER BY {draw('sample_id', seed=42)}, sample_id) <= round_even(count(*) OVER (PARTITION BY region, dw_label) * CAST(0.3 AS DOUBLE), 0) AS held FROM samples",
    seeds="SELECT unnest([13, 23, 33]) AS seed", fractions=f"SELECT CAST(unnest({FRACTIONS}) AS DOUBLE) AS fraction",
    cases="SELECT seed, fraction, seed * 100 + CAST(fraction * 10 AS INTEGER) AS c FROM seeds, fractions",
    pool="SELECT sample_id, seed, count(*) OVER (PARTITION BY region, dw_label, seed) AS n, row_number() OVER (PARTITION BY region, dw_label, seed ORDER BY CAST(('0x' || substr(md5(concat_ws('|', sample_id, seed)), 1, 8)) AS BIGINT), sample_id) AS r FROM split, seeds WHERE NOT held",
    member="SELECT c, sample_id AS id FROM pool JOIN cases USING (seed) WHERE r <= CASE WHEN fraction >= 1 THEN n ELSE greatest(1, round_even(n * fraction, 0)) END",
    **solver.ridge_steps(STUDY_SETS, len(CONTEXT)),
))


@query(CURVE_SQL)
def m13_learning_curve(spark, d):
    return rounded(studies.learning_curve(study_rows(spark, d), "sample_id", ["region", "dw_label"], SETS, list(tables.TARGETS), FRACTIONS, FRACTION_SEEDS))


@query()
def m15_best_refit_by_group(spark, d):
    data = split_samples(spark, d, FEATURES)
    train, test = data.filter("split = 'train'"), data.filter("split = 'test'")
    models = {"ridge": o.ridge(train, "S1_VV", "hat"), "trees": o.boosted_trees("S1_VV", "hat", **QUICK).fit(train)}
    runs = None
    for name, model in models.items():
        run = model.transform(test).select(F.lit("S1_VV").alias("target"), F.lit(name).alias("model"), "region", "dw_label_name", F.col("S1_VV").alias("actual"), F.col("hat").alias("predicted"))
        runs = run if runs is None else runs.unionByName(run)
    runs = runs.cache()
    best = best_per_group(m.metrics_by(runs, "target", "model"), ["target"], F.desc("r2"), "model").select("target", "model")
    return m.metrics_by_sets(runs.join(F.broadcast(best), ["target", "model"]), [["region"], ["dw_label_name"]])


PERMUTATION_SQL = recursive(over(
    "samples",
    """SELECT target, 'A' || lpad(CAST(f AS VARCHAR), 2, '0') AS feature, round(avg((sse - base) / spread), 6) AS mean_drop, round(stddev_pop((sse - base) / spread), 6) AS std_drop FROM (
  SELECT target, f, perm, sum(pow(e + w[f + 1] * (z.v[f + 2] - x.v[f + 2]), 2)) AS sse, sum(e * e) AS base, var_pop(a) * count(*) AS spread
  FROM errors JOIN dealt USING (id) JOIN vec x ON x.id = errors.id JOIN vec z ON z.id = dealt.partner, (SELECT unnest(range(0, 64)) AS f) GROUP BY ALL) GROUP BY target, f""",
    **RIDGE_STEPS,
    perms=f"SELECT id AS partner, perm, row_number() OVER (PARTITION BY perm ORDER BY {draw('id', 'perm', seed=42)}, id) AS r FROM test, (SELECT unnest(range(1, 11)) AS perm)",
    dealt="SELECT id, perm, partner FROM test JOIN perms USING (r)",
    errors=f"SELECT id, target, w, v[78 + t] AS a, {solver.PREDICTION} - v[78 + t] AS e FROM test JOIN vec USING (id), weights JOIN targets USING (t)",
))


@query(PERMUTATION_SQL)
def m11_permutation_importance(spark, d):
    """All 64 features, three targets, ten repeats, on held-out rows of a ridge model."""
    data, weights = held_out_ridge(spark, d)
    return rounded(studies.permutation_importance(data.filter("_train = 0"), "sample_id", FEATURES, list(tables.TARGETS), weights))


SWEEP_SQL = recursive(over(
    "pixels",
    f"""SELECT percent, CAST(rows AS BIGINT) AS train_rows, target AS band, {solver.selected("r2", "rmse", "mae", "bias", "pearson_r")} FROM (
  SELECT percent, rows, target, v[65 + t] AS a, {solver.PREDICTION} AS q FROM sizes JOIN weights ON c = rows JOIN targets USING (t), ranked JOIN vec USING (id) WHERE r <= held AND rows > 0
  UNION ALL SELECT percent, rows, target, x.v[65 + t], y.v[65 + t] FROM sizes, picked JOIN vec x ON x.id = picked.id JOIN ranked z ON z.r = picked.partner JOIN vec y ON y.id = z.id, targets WHERE rows = 0) GROUP BY ALL""",
    valid="SELECT pixel_id AS id, S1_VV, S1_VH, S1_VV_div_VH, embedding FROM pixels JOIN embeddings ON vec_id = pixel_id % (SELECT count(*) FROM embeddings) WHERE S1_VV IS NOT NULL",
    vec="SELECT id, [1.0::DOUBLE] || list_transform(embedding, lambda x: CAST(x AS DOUBLE)) || [S1_VV, S1_VH, S1_VV_div_VH] AS v FROM valid",
    targets=STUDY_STEPS["targets"], total="SELECT count(*) AS n, CAST(round_even(count(*) * CAST(0.2 AS DOUBLE), 0) AS BIGINT) AS held FROM valid",
    ranked=f"SELECT id, n, held, row_number() OVER (ORDER BY {draw('id', seed=42)}, id) AS r FROM valid, total",
    sizes=f"SELECT percent, least(round_even(percent / 100 * n, 0), n - held) AS rows FROM (SELECT CAST(unnest({PERCENTS}) AS DOUBLE) AS percent), total",
    member="SELECT DISTINCT rows AS c, id FROM ranked, sizes WHERE r > held AND r <= held + rows",
    picked=f"SELECT id, held + 1 + CAST(floor({draw('id', seed=43)} * (n - held)) AS BIGINT) AS partner FROM ranked WHERE r <= held",
    **solver.ridge_steps({"all": 64}, 64),
))


@query(SWEEP_SQL)
def m16_sample_sweep(spark, d):
    px = tables.pixels(spark, d, with_embedding=True).filter("S1_VV is not null")
    return rounded(studies.sample_sweep(p.spread_embedding(px).drop("embedding"), "pixel_id", FEATURES, list(tables.TARGETS), PERCENTS))


@query()
def m17_m18_difference_and_ratio_study(spark, d):
    data = p.ratio_targets(p.one_hot(split_rows(spark, d), "region", list(tables.REGIONS)), "S1_VV", "S1_VH", space="linear")
    # Each set is the first values of one array, which alone is kept; rows are whole in both sets or in none, as the context comes from the embedding.
    targets = [*tables.TARGETS, "ratio", "log_ratio"]
    data = p.require_splits(p.feature_array(data, CONTEXT, "x").select("split", "x", *targets).cache())
    ready = data.withColumns({name: array_to_vector(F.slice("x", 1, len(columns))) for name, columns in SETS.items()})
    train, test = ready.filter("split = 'train'"), ready.filter("split = 'test'")
    trees = o.fit_sets(train, list(SETS), "S1_VV_div_VH", **QUICK)
    weights = studies.ridge_by_set(train.select(*[F.col("x")[i].alias(c) for i, c in enumerate(CONTEXT)], *targets), SETS, targets)
    out = None
    for name, columns in SETS.items():
        run = test.withColumns({f"{t}_hat": studies.linear(F.slice("x", 1, len(columns)), weights[name, t]) for t in targets}).withColumn("log_hat", F.exp("log_ratio_hat"))
        run = o.structural_difference(trees[name].transform(run), "S1_VV_hat", "S1_VH_hat", "structural")
        run = run.withColumn("structural_ratio", F.pow(F.lit(10.0), F.col("structural") / 10))
        pairs = {"difference_ridge": ("S1_VV_div_VH", "S1_VV_div_VH_hat"), "difference_trees": ("S1_VV_div_VH", f"{name}_hat"), "difference_structural": ("S1_VV_div_VH", "structural"), "ratio_ridge": ("ratio", "ratio_hat"), "ratio_log_ridge": ("ratio", "log_hat"), "ratio_structural": ("ratio", "structural_ratio")}
        run = scored(run, pairs).withColumn("feature_set", F.lit(name))
        out = run if out is None else out.unionByName(run)
    return out


@query()
def m19_rgb_projection(spark, d):
    data = p.feature_vector(p.spread_embedding(tables.samples(spark, d)), FEATURES).select("sample_id", "features")
    return o.rgb_projection(data).select("sample_id", "c1", "c2", "c3")


@query()
def k5_model_save_and_load(spark, d):
    data = split_samples(spark, d, FEATURES)
    path = scratch_path(spark, "model")
    sinks.save_model(PipelineModel([o.ridge(data.filter("split = 'train'"), "S1_VV", "hat")]), path)
    return sinks.load_model(path).transform(data.filter("split = 'test'")).select("sample_id", "hat")


STREAM_SQL = f"""WITH pixels AS ({VIEWS["pixels"]}),
valid AS (SELECT *, (image_row % 22 = 0 AND image_col % 22 = 0) AS is_train FROM pixels WHERE S1_VV IS NOT NULL AND S1_VH IS NOT NULL),
filled AS (SELECT *, CASE WHEN is_train THEN S1_VV ELSE CAST(1.2 AS DOUBLE) * S1_VH + CAST(11.5 AS DOUBLE) END AS VV_hat, CASE WHEN is_train THEN S1_VH ELSE CAST(0.75 AS DOUBLE) * S1_VV - CAST(11.0 AS DOUBLE) END AS VH_hat FROM valid),
long AS (SELECT 'S1_VV' AS band, S1_VV AS a, VV_hat AS p FROM filled UNION ALL SELECT 'S1_VH', S1_VH, VH_hat FROM filled UNION ALL SELECT 'S1_VV_div_VH', S1_VV_div_VH, VV_hat - VH_hat FROM filled)
SELECT band, count(*) AS n, round(1 - sum((p - a) * (p - a)) / (var_pop(a) * count(*)), 6) AS r2, round(sqrt(avg((p - a) * (p - a))), 6) AS rmse, round(avg(abs(p - a)), 6) AS mae, round(covar_pop(a, p) / sqrt(var_pop(a) * var_pop(p)), 6) AS pearson_r FROM long GROUP BY band"""


@query(STREAM_SQL)
def t1_running_metrics_stream(spark, d):
    path = scratch_path(spark, "chunks")
    long = m.long_bands(filled_pixels(spark, d), BANDS)
    long.repartition(6).write.parquet(path)
    return rounded(run_available(spark, path, long.schema))
