"""Queries on scans, sinks, compositing and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import compositing as g
from gridloom.operators import metrics as m
from gridloom.operators import projections as p
from gridloom.operators.sampling import grid, grid_stride
from gridloom.plans.registry import METRIC_COLUMNS, METRICS, e, over, query, round_sql, rounded
from gridloom.sources import sinks, tables, tiles
from gridloom.sources.scratch import scratch_path

SAMPLE_COLUMNS = [f.name for f in tables.SAMPLES_SCHEMA.fields]
_ss = " ".join(tables.LABELS)

# ---- flagship ----

GAP_SQL = over(
    "pixels",
    f"SELECT band, n, {', '.join(f'round({c}, 6) AS {c}' for c in METRIC_COLUMNS.split())} FROM (SELECT band, {METRICS} FROM long GROUP BY band)",
    valid="SELECT *, (image_row % 22 = 0 AND image_col % 22 = 0) AS is_train FROM pixels WHERE S1_VV IS NOT NULL AND S1_VH IS NOT NULL",
    filled="SELECT *, CASE WHEN is_train THEN S1_VV ELSE CAST(1.2 AS DOUBLE) * S1_VH + CAST(11.5 AS DOUBLE) END AS VV_hat, CASE WHEN is_train THEN S1_VH ELSE CAST(0.75 AS DOUBLE) * S1_VV - CAST(11.0 AS DOUBLE) END AS VH_hat FROM valid",
    long="""SELECT 'S1_VV' AS band, S1_VV AS actual, VV_hat AS predicted FROM filled WHERE NOT is_train
      UNION ALL SELECT 'S1_VH', S1_VH, VH_hat FROM filled WHERE NOT is_train
      UNION ALL SELECT 'S1_VV_div_VH', S1_VV_div_VH, VV_hat - VH_hat FROM filled WHERE NOT is_train""",
)


def filled_pixels(spark, d):
    """Valid pixels with a grid of training pixels copied and the rest filled by a fixed linear rule."""
    px = tables.pixels(spark, d).filter(p.valid_pixel(["S1_VV", "S1_VH"]))
    s = grid_stride(0.002)
    px = px.withColumn("is_train", (F.col("image_row") % s == 0) & (F.col("image_col") % s == 0))
    px = px.withColumns({"rule_vv": 1.2 * F.col("S1_VH") + 11.5, "rule_vh": 0.75 * F.col("S1_VV") - 11.0})
    px = p.fill_image(px, "S1_VV", "rule_vv").withColumnRenamed("filled", "VV_hat")
    return p.fill_image(px, "S1_VH", "rule_vh").withColumnRenamed("filled", "VH_hat").withColumn("diff_hat", F.col("VV_hat") - F.col("VH_hat"))


BANDS = {"S1_VV": ("S1_VV", "VV_hat"), "S1_VH": ("S1_VH", "VH_hat"), "S1_VV_div_VH": ("S1_VV_div_VH", "diff_hat")}


@query(GAP_SQL)
def gap_metrics_by_band(spark, d):
    return rounded(m.metrics_by(m.long_bands(filled_pixels(spark, d).filter("is_gap"), BANDS), "band"))


# ---- scans ----


@query(round_sql(over("samples", f"SELECT sample_id, dw_label, region, S1_VV, S1_VH, S1_VV_div_VH, latitude, longitude, {', '.join(tables.LABELS)}, dw_label_name, region || '__' || dw_label_name AS region_dw_label FROM samples"), "sample_id dw_label region dw_label_name region_dw_label", f"S1_VV S1_VH S1_VV_div_VH latitude longitude {_ss}"))
def s1_samples_csv_scan(spark, d):
    path = scratch_path(spark, "csv")
    sinks.write_csv(tables.samples(spark, d).select(*SAMPLE_COLUMNS), path)
    s = tables.csv_table(spark, path, tables.SAMPLES_SCHEMA).withColumn("dw_label_name", tables.label_name(F.col("dw_label")))
    return rounded(s.withColumn("region_dw_label", F.concat_ws("__", "region", "dw_label_name")))


_probs = ", ".join(tables.LABELS)
CONFIDENCE_SQL = round_sql(
    over("samples", f"SELECT sample_id, CASE dw_label_name {' '.join(f'WHEN {chr(39)}{n}{chr(39)} THEN {n}' for n in tables.LABELS)} END AS label_confidence, ([{', '.join(repr(n) for n in tables.LABELS)}])[list_position([{_probs}], greatest({_probs}))] AS dominant_class, greatest({_probs}) AS dominant_probability FROM samples"),
    "sample_id dominant_class", "label_confidence dominant_probability",
)


@query(CONFIDENCE_SQL)
def s2_samples_with_confidence(spark, d):
    names = list(tables.LABELS)
    top, value = p.dominant(names)
    return rounded(tables.samples(spark, d).select("sample_id", p.confidence(names, F.col("dw_label_name")).alias("label_confidence"), top.alias("dominant_class"), value.alias("dominant_probability")))


@query(over("predictions", "SELECT region, dw_label_name, count(*) AS n, round(sum(actual), 4) AS actual, round(sum(predicted), 4) AS predicted FROM predictions GROUP BY ALL"))
def s3_predictions_csv_scan(spark, d):
    path = scratch_path(spark, "csv")
    sinks.write_csv(tables.predictions(spark, d).select("region", "dw_label_name", "actual", "predicted"), path)
    return tables.csv_table(spark, path, tables.PREDICTIONS_SCHEMA).groupBy("region", "dw_label_name").agg(F.count("*").alias("n"), F.round(F.sum("actual"), 4).alias("actual"), F.round(F.sum("predicted"), 4).alias("predicted"))


@query("SELECT r_name AS region, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def s4_optional_result_table(spark, d):
    path = scratch_path(spark, "csv")
    schema = tables.table(spark, d, "region").schema
    assert tables.optional_csv_table(spark, f"{path}-missing", schema).isEmpty()
    sinks.write_csv(tables.table(spark, d, "region"), path)
    r = tables.optional_csv_table(spark, path, schema)
    return r.join(tables.table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy(F.col("r_name").alias("region")).agg(F.count("n_nationkey").alias("n"))


@query("SELECT DISTINCT 'o_orderpriority=' || o_orderpriority AS part FROM orders")
def s6_tile_discovery(spark, d):
    path = scratch_path(spark, "tiles")
    tables.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("o_orderpriority="), "o_orderpriority").alias("part"), "o_orderpriority").repartition("o_orderpriority").write.partitionBy("o_orderpriority").parquet(path)
    tables.discover_tiles(spark, path, "part-*.parquet")
    return spark.read.option("pathGlobFilter", "part-*.parquet").parquet(path).select("part").distinct()


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_partkey * 512 END AS row_off, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE CAST(p_size AS BIGINT) * 512 END AS col_off FROM part")
def s7_tile_offset_parse(spark, d):
    name = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("stack-"), F.col("p_partkey"), F.lit(".tif"))).otherwise(F.concat(F.lit("stack-"), F.col("p_partkey") * 512, F.lit("-"), F.col("p_size").cast("long") * 512, F.lit(".tif")))
    row, col = tables.tile_offset(name)
    return tables.table(spark, d, "part").select("p_partkey", row.alias("row_off"), col.alias("col_off"))


BAND_STEPS = {
    "stack": "SELECT image_row // 32 AS window_row, image_col // 32 AS window_col, [S1_VV, S1_VH, S1_VV_div_VH] || list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM pixels JOIN embeddings ON vec_id = pixel_id % (SELECT count(*) FROM embeddings)",
    "cells": "SELECT window_row, window_col, unnest(range(1, 68)) AS band, unnest(v) AS x FROM stack",
}


@query(over("pixels", "SELECT window_row, window_col, CAST(band AS INTEGER) AS band, count(x) AS n, round(min(x), 8) AS lowest, round(max(x), 8) AS highest FROM cells GROUP BY ALL", **BAND_STEPS))
def s8_windowed_band_scan(spark, d):
    """All 67 bands by window, from pixels stored by tile and window."""
    px = tables.pixels(spark, d, with_embedding=True)
    table = tiles.write_windows(px, scratch_path(spark, "windows"), 32, margin=1)
    bands = F.concat(F.array("S1_VV", "S1_VH", "S1_VV_div_VH"), F.transform("embedding", lambda x: x.cast("double")))
    return rounded(tiles.band_summary(table.rows().withColumns({c: F.col(c).cast("long") for c in ("window_row", "window_col")}), bands, "window_row", "window_col"), 8)


@query(over("pixels", """SELECT 't0' AS tile, r AS row_off, c AS col_off, least(50, h - r) AS rows, least(50, w - c) AS cols
  FROM (SELECT max(image_row) + 1 AS h, max(image_col) + 1 AS w FROM pixels), LATERAL (SELECT unnest(range(0, h, 50)) AS r), LATERAL (SELECT unnest(range(0, w, 50)) AS c)"""))
def s9_window_tiling(spark, d):
    size = tables.pixels(spark, d).groupBy("tile").agg((F.max("image_row") + 1).alias("height"), (F.max("image_col") + 1).alias("width"))
    return tables.windows(size, 50)


VALID_SQL = over("pixels", "SELECT pixel_id, image_row, image_col, round(S1_VV, 8) AS S1_VV, round(S1_VH, 8) AS S1_VH FROM pixels WHERE S1_VV IS NOT NULL AND S1_VH IS NOT NULL")


@query(VALID_SQL)
def s11_all_valid_pixels(spark, d):
    return rounded(tables.pixels(spark, d).filter(p.valid_pixel(["S1_VV", "S1_VH"])).select("pixel_id", "image_row", "image_col", "S1_VV", "S1_VH"), 8)


@query(over("pixels", """SELECT c.pixel_id AS query, count(q.pixel_id) AS n_inside, round(avg(q.S1_VH), 6) AS mean, round(min(q.S1_VH), 6) AS lowest, round(max(q.S1_VH), 6) AS highest,
  round(max(CASE WHEN q.image_row = c.image_row - 48 AND q.image_col = c.image_col - 48 THEN q.S1_VH END), 6) AS first_value, round(max(CASE WHEN q.image_row = c.image_row + 47 AND q.image_col = c.image_col + 47 THEN q.S1_VH END), 6) AS last_value
  FROM (SELECT * FROM pixels WHERE pixel_id % 50 = 0) c LEFT JOIN pixels q ON q.image_row BETWEEN c.image_row - 48 AND c.image_row + 47 AND q.image_col BETWEEN c.image_col - 48 AND c.image_col + 47 GROUP BY c.pixel_id"""))
def s12_chips(spark, d):
    """Chips of 96 by 96 pixels around the stated centres, each summed up."""
    px = tables.pixels(spark, d)
    table = tiles.write_windows(px.select("tile", "image_row", "image_col", "S1_VH"), scratch_path(spark, "windows"), 32)
    centres = px.filter("pixel_id % 50 = 0").select(F.col("pixel_id").alias("query"), "tile", "image_row", "image_col")
    found = tiles.chips(table, centres, 96, "S1_VH").withColumn("held", F.filter("chip", lambda x: x.isNotNull()))
    mean = F.aggregate("held", F.lit(0.0), lambda s, x: s + x) / F.size("held")
    return rounded(found.select("query", F.size("held").cast("long").alias("n_inside"), mean.alias("mean"), F.array_min("held").alias("lowest"), F.array_max("held").alias("highest"), F.col("chip")[0].alias("first_value"), F.col("chip")[96 * 96 - 1].alias("last_value")))


@query("SELECT n_name AS nation, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def s13_parquet_scan(spark, d):
    c, n = tables.table(spark, d, "customer"), tables.table(spark, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


# ---- sinks ----


@query(over("predictions", f"SELECT region, n, {', '.join(f'round({c}, 6) AS {c}' for c in METRIC_COLUMNS.split())} FROM (SELECT region, {METRICS} FROM predictions GROUP BY region)"))
def k1_metric_table_csv(spark, d):
    path = scratch_path(spark, "csv")
    table = m.metrics_by(tables.predictions(spark, d), "region")
    sinks.write_csv(table, path)
    return rounded(tables.csv_table(spark, path, table.schema))


@query(over("predictions", "SELECT 'phase' AS run, count(*) AS n_rows, count(DISTINCT region) AS n_regions, round(avg(actual), 6) AS mean_actual FROM predictions"))
def k2_run_summary_json(spark, d):
    path = scratch_path(spark, "json")
    summary = tables.predictions(spark, d).agg(F.count("*").alias("n_rows"), F.countDistinct("region").alias("n_regions"), F.round(F.avg("actual"), 6).alias("mean_actual")).select(F.lit("phase").alias("run"), "*")
    sinks.write_summary(summary, path)
    return spark.read.schema(summary.schema).json(path)


@query(over("samples", "SELECT region AS layer, sample_id, round(longitude, 6) AS lon, round(latitude, 6) AS lat FROM samples"))
def k3_geojson_layers(spark, d):
    path = scratch_path(spark, "geojson")
    features = sinks.geojson_features(tables.samples(spark, d), "longitude", "latitude", ["sample_id", "dw_label_name", "S1_VV"], "region")
    sinks.write_geojson_layers(features, "region", path)
    at = lambda x: F.get_json_object("value", x)
    back = spark.read.text(path).filter(at("$.geometry.type") == "Point")
    return rounded(back.select(F.col("region").alias("layer"), at("$.properties.sample_id").cast("long").alias("sample_id"), at("$.geometry.coordinates[0]").cast("double").alias("lon"), at("$.geometry.coordinates[1]").cast("double").alias("lat")))


@query(over("pixels", "SELECT tile, count(*) AS pixels, count(S1_VV) AS valid, round(sum(S1_VV), 4) AS total FROM pixels GROUP BY tile"))
def k4_image_by_tile(spark, d):
    path = scratch_path(spark, "image")
    sinks.write_image(tables.pixels(spark, d), path)
    return spark.read.parquet(path).groupBy("tile").agg(F.count("*").alias("pixels"), F.count("S1_VV").alias("valid"), F.round(F.sum("S1_VV"), 4).alias("total"))


@query(over("pixels", "SELECT pixel_id, image_row, image_col, round(S1_VV, 8) AS S1_VV FROM pixels WHERE S1_VV IS NOT NULL AND image_row % 7 = 0 AND image_col % 7 = 0"))
def k6_sampled_dataset(spark, d):
    path = scratch_path(spark, "sampled")
    sampled = grid(tables.pixels(spark, d, with_embedding=True).filter(p.valid_pixel(["S1_VV"], "embedding")), 0.02)
    sampled.write.parquet(f"{path}/dataset")
    sampled.drop("embedding").write.parquet(f"{path}/locations")
    return rounded(spark.read.parquet(f"{path}/locations").select("pixel_id", "image_row", "image_col", "S1_VV"), 8)


@query(over("predictions", "SELECT region, dw_label_name, count(*) AS n FROM predictions WHERE region = 'A' GROUP BY ALL"))
def k7_predictions_by_model(spark, d):
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(tables.predictions(spark, d), path, ("region", "dw_label_name"))
    return spark.read.parquet(path).filter("region = 'A'").groupBy("region", "dw_label_name").agg(F.count("*").alias("n"))


# ---- compositing ----


@query(over("scenes", "SELECT scene_id, lon, lat FROM scenes WHERE lon BETWEEN -100 AND 20 AND lat BETWEEN 10 AND 45"))
def g1_bounds_filter(spark, d):
    return g.within_bounds(tables.scene_pixels(spark, d), -100, 10, 20, 45).select("scene_id", "lon", "lat")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def g2_year_filter(spark, d):
    return g.within_years(tables.table(spark, d, "orders"), 1997, ts="o_orderdate").select("o_orderkey", "o_orderdate")


@query(over("scenes", "SELECT scene_id, list_contains(polarisations, 'VV') AND list_contains(polarisations, 'VH') AS holds_both, polarisations = ['VV', 'VH'] AS exact FROM scenes WHERE instrument_mode = 'IW' AND resolution_m = 10 AND list_contains(polarisations, 'VV') AND list_contains(polarisations, 'VH')"))
def g3_metadata_filters(spark, d):
    scenes = tables.scene_pixels(spark, d)
    exact = g.with_metadata(scenes, "IW", 10, exactly=True).select("scene_id", F.lit(True).alias("exact"))
    return g.with_metadata(scenes, "IW", 10).select("scene_id", F.lit(True).alias("holds_both")).join(exact, "scene_id", "left").fillna(False, ["exact"])


@query(over("scenes", "SELECT scene_id, band AS VV, round(VH, 6) AS VH, round(band - VH, 6) AS S1_VV_div_VH FROM scenes"))
def g4_g12_bands_and_difference(spark, d):
    scenes = tables.scene_pixels(spark, d).select("scene_id", F.col("band").alias("VV"), "VH")
    return rounded(scenes.withColumn("S1_VV_div_VH", F.col("VV") - F.col("VH")))


@query(over("scenes", "SELECT pixel_id, round(quantile_cont(band, 0.5), 6) AS band, round(quantile_cont(VH, 0.5), 6) AS VH FROM scenes GROUP BY pixel_id"))
def g5_median_composite(spark, d):
    return rounded(g.median_composite(tables.scene_pixels(spark, d), ["band", "VH"]))


@query(over("scenes", "SELECT pixel_id, arg_max(band, (ts, scene_id)) AS band, arg_max(dw_label_name, (ts, scene_id)) AS dw_label_name FROM scenes GROUP BY pixel_id"))
def g6_mosaic(spark, d):
    return g.mosaic(tables.scene_pixels(spark, d), ["band", "dw_label_name"])


@query(over("scenes", "SELECT pixel_id, dw_label_name FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY n DESC, dw_label_name) AS r FROM (SELECT pixel_id, dw_label_name, count(*) AS n FROM scenes GROUP BY ALL)) WHERE r = 1"))
def g7_mode_label(spark, d):
    return g.mode_composite(tables.scene_pixels(spark, d), "dw_label_name")


@query(round_sql(over("samples", f"SELECT region, {', '.join(f'avg({n}) AS {n}' for n in tables.LABELS)} FROM samples GROUP BY region"), "region", _ss))
def g8_mean_probabilities(spark, d):
    return rounded(g.mean_composite(tables.samples(spark, d), list(tables.LABELS), ("region",)))


@query(over("scenes", "SELECT scene_id, CASE WHEN qa60 & 1024 = 0 AND qa60 & 2048 = 0 THEN round(band / 10000, 8) END AS band FROM scenes"))
def g9_cloud_mask(spark, d):
    return tables.scene_pixels(spark, d).select("scene_id", F.round(g.cloud_free(F.col("band")), 8).alias("band"))


@query(over("scenes", "SELECT pixel_id, round(quantile_cont(CASE WHEN qa60 & 1024 = 0 AND qa60 & 2048 = 0 THEN band END, 0.5), 6) AS band FROM scenes WHERE cloudy_pct < 60 GROUP BY pixel_id"))
def g10_clear_median(spark, d):
    return rounded(g.clear_median(tables.scene_pixels(spark, d), ["band"], 60.0, scale=1.0))


@query(over("scenes", "SELECT scene_id, pixel_id, band FROM scenes WHERE scene_id = (SELECT arg_min(scene_id, (cloudy_pct, scene_id)) FROM scenes)"))
def g11_least_cloudy_scene(spark, d):
    return g.least_cloudy(tables.scene_pixels(spark, d)).select("scene_id", "pixel_id", "band")


@query(over("scenes", """SELECT pixel_id, round(a.m, 6) AS sar, b.v AS optical FROM (SELECT pixel_id, quantile_cont(band, 0.5) AS m FROM scenes WHERE instrument_mode = 'IW' GROUP BY pixel_id) a
  JOIN (SELECT pixel_id, max(CASE WHEN cloudy_pct < 5 THEN band END) AS v FROM scenes GROUP BY pixel_id) b USING (pixel_id) WHERE b.v IS NOT NULL AND a.m IS NOT NULL"""))
def g13_g14_stack_and_common_mask(spark, d):
    scenes = tables.scene_pixels(spark, d)
    sar = g.median_composite(scenes.filter("instrument_mode = 'IW'"), ["band"]).withColumnRenamed("band", "sar")
    optical = scenes.groupBy("pixel_id").agg(F.max(F.when(F.col("cloudy_pct") < 5, F.col("band"))).alias("optical"))
    return rounded(g.commonly_valid(g.stack_bands(sar, optical), ["sar", "optical"]))


@query("""SELECT region, count(*) AS n, CAST(min(year) AS INTEGER) AS year FROM (
  SELECT 'urban' AS region, 2024 AS year FROM events WHERE event_id % 360 - 180 BETWEEN -100 AND 0 UNION ALL SELECT 'farm', 2024 FROM events WHERE event_id % 360 - 180 BETWEEN 1 AND 50) GROUP BY region""")
def g16_g17_annotate_and_merge(spark, d):
    scenes = tables.scene_pixels(spark, d)
    parts = [g.annotate(g.within_bounds(scenes, west, -90, east, 90), name, 2024) for name, west, east in (("urban", -100, 0), ("farm", 1, 50))]
    return g.merge(*parts).groupBy("region").agg(F.count("*").alias("n"), F.min("year").alias("year"))


@query(over("samples", "SELECT region, dw_label_name, count(*) AS n FROM samples GROUP BY ALL"))
def g18_export_by_region(spark, d):
    path = scratch_path(spark, "export")
    tables.samples(spark, d).write.partitionBy("region").parquet(path)
    return spark.read.parquet(path).groupBy("region", "dw_label_name").agg(F.count("*").alias("n"))


@query(over("scenes", "SELECT r.n_name AS region, count(*) AS n FROM scenes JOIN nation r ON lon BETWEEN n_nationkey * 10 - 150 AND n_nationkey * 10 - 142 AND lat BETWEEN 0 AND n_nationkey * 3 GROUP BY r.n_name"))
def g19_j15_region_rectangles(spark, d):
    n = F.col("n_nationkey")
    regions = tables.table(spark, d, "nation").select(F.col("n_name").alias("region"), (n * 10 - 150).alias("west"), (n * 10 - 142).alias("east"), F.lit(0).alias("south"), (n * 3).alias("north"))
    return g.assign_region(tables.scene_pixels(spark, d), regions).groupBy("region").agg(F.count("*").alias("n"))


# ---- projections ----


@query(over("samples", f"SELECT sample_id, S1_VV > -13 AND {e(1)} > 0 AS positive, (SELECT bool_and(x IS NOT NULL AND NOT isnan(x) AND abs(x) < 'inf'::FLOAT) FROM (SELECT unnest(embedding) AS x)) AS valid FROM samples"))
def p1_valid_pixel(spark, d):
    s = tables.samples(spark, d)
    return s.select("sample_id", ((F.col("S1_VV") > -13) & (tables.component(1) > 0)).alias("positive"), p.valid_pixel(["S1_VV", "S1_VH", "S1_VV_div_VH"], "embedding").alias("valid"))


@query(over("samples", "SELECT sample_id, dw_label, dw_label_name, region || '__' || dw_label_name AS region_dw_label FROM samples"))
def p2_p3_label_and_key(spark, d):
    s = tables.samples(spark, d).select("sample_id", "region", F.col("dw_label").cast("string").cast("int").alias("dw_label"))
    s = s.withColumn("dw_label_name", tables.label_name(F.col("dw_label")))
    return s.select("sample_id", "dw_label", "dw_label_name", F.concat_ws("__", "region", "dw_label_name").alias("region_dw_label"))


RATIO = "CASE WHEN direct THEN S1_VV / greatest(S1_VH, 1e-6) ELSE pow(10, S1_VV / 10) / greatest(pow(10, S1_VH / 10), 1e-6) END"


@query(over("samples", f"SELECT sample_id, round({RATIO}, 6) AS ratio, round(ln({RATIO}), 6) AS log_ratio, CASE WHEN direct THEN 'direct' ELSE 'linear' END AS ratio_space FROM samples, flag", flag="SELECT bool_and(S1_VV / greatest(S1_VH, 1e-6) > 0) AS direct FROM samples"))
def p7_ratio_targets(spark, d):
    return rounded(p.ratio_targets(tables.samples(spark, d), "S1_VV", "S1_VH").select("sample_id", "ratio", "log_ratio", "ratio_space"))


@query(over("predictions", "SELECT sample_id, fold, round(residual, 6) AS residual, round(abs(residual), 6) AS abs_residual FROM predictions"))
def p8_residuals(spark, d):
    return rounded(p.residuals(tables.predictions(spark, d)).select("sample_id", "fold", "residual", "abs_residual"))


@query(over("samples", f"SELECT sample_id, {', '.join(f'CAST(region = {chr(39)}{r}{chr(39)} AS DOUBLE) AS region_{r}' for r in tables.REGIONS)} FROM samples"))
def p9_one_hot_region(spark, d):
    return p.one_hot(tables.samples(spark, d), "region", list(tables.REGIONS)).select("sample_id", *[f"region_{r}" for r in tables.REGIONS])


@query(over("samples", f"SELECT sample_id, 64 AS embedding_only, 77 AS with_context, round({e(1)} + {e(64)} + water, 6) AS checksum FROM samples"))
def p10_feature_sets(spark, d):
    from pyspark.ml.functions import vector_to_array

    s = p.one_hot(p.spread_embedding(tables.samples(spark, d)), "region", list(tables.REGIONS))
    a = [f"A{i:02d}" for i in range(64)]
    s = p.feature_vector(p.feature_vector(s, a, "f1"), [*a, *tables.LABELS, *[f"region_{r}" for r in tables.REGIONS]], "f2")
    s = s.select("sample_id", vector_to_array("f1").alias("f1"), vector_to_array("f2").alias("f2"))
    x, y = F.col("f1"), F.col("f2")
    return rounded(s.select("sample_id", F.size(x).alias("embedding_only"), F.size(y).alias("with_context"), (y[0] + y[63] + y[64]).alias("checksum")))


@query("SELECT o_orderkey, coalesce(c_mktsegment, o_orderpriority) AS label FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON o_custkey = c_custkey")
def p11_prefer_joined_value(spark, d):
    c = tables.table(spark, d, "customer").filter("c_custkey % 3 = 0").select("c_custkey", F.col("c_mktsegment").alias("label_src"))
    o = tables.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("label_own"))
    return p.prefer(o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left"), "label", "label_src", "label_own").select("o_orderkey", "label")


@query("SELECT n_nationkey, CASE WHEN n_name LIKE 'A%' THEN 'embedding' WHEN n_name LIKE 'region\\_%' ESCAPE '\\' THEN 'region' ELSE 'context' END AS family, CASE n_regionkey WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE CAST(n_regionkey AS VARCHAR) END AS shown FROM nation")
def p12_p13_family_and_display(spark, d):
    n = tables.table(spark, d, "nation")
    return n.select("n_nationkey", p.feature_family(F.col("n_name")).alias("family"), p.display_label(F.col("n_regionkey").cast("string"), {"0": "first", "1": "second"}).alias("shown"))


@query("SELECT p_partkey, printf('%.3f', CAST(p_size AS DOUBLE) / 8) AS fixed, rtrim(rtrim(printf('%.4f', CAST(p_size AS DOUBLE) / 16), '0'), '.') || '%' AS pct FROM part")
def p14_number_format(spark, d):
    s = F.col("p_size").cast("double")
    return tables.table(spark, d, "part").select("p_partkey", p.fixed(s / 8).alias("fixed"), p.percent(s / 16).alias("pct"))


@query(over("samples", "SELECT sample_id, round(longitude * CAST(111.32 AS DOUBLE) * cos(radians(avg(latitude) OVER (PARTITION BY region))), 6) AS x_km, round(latitude * CAST(110.57 AS DOUBLE), 6) AS y_km FROM samples"))
def p15_w14_local_km(spark, d):
    return rounded(p.local_km(tables.samples(spark, d), ["region"]).select("sample_id", "x_km", "y_km"))


@query(over("pixels", "SELECT pixel_id FROM pixels WHERE image_row < 40 AND image_col < 100"))
def p16_in_bounds(spark, d):
    return p.in_bounds(tables.pixels(spark, d), 40, 100).select("pixel_id")


@query("SELECT l_orderkey, l_linenumber, coalesce(l_discount < CAST(0.05 AS DOUBLE), false) AS significant, count(*) AS n FROM lineitem WHERE l_tax >= CAST(0.02 AS DOUBLE) AND l_linenumber = 1 GROUP BY ALL")
def p17_filters_and_flag(spark, d):
    li = tables.table(spark, d, "lineitem").filter((F.col("l_tax") >= 0.02) & (F.col("l_linenumber") == 1))
    return li.groupBy("l_orderkey", "l_linenumber", p.significant(F.col("l_discount")).alias("significant")).agg(F.count("*").alias("n"))


@query("SELECT n_regionkey AS query, string_agg(n_name || '@' || n_nationkey, ', ' ORDER BY n_nationkey) AS neighbours FROM nation GROUP BY n_regionkey")
def p18_neighbour_text(spark, d):
    n = tables.table(spark, d, "nation").withColumnRenamed("n_regionkey", "query")
    return p.neighbour_text(n, "query", "n_nationkey", F.concat("n_name", F.lit("@"), F.col("n_nationkey").cast("string")))


VERDICT_SQL = """SELECT region, assessment, CASE WHEN assessment = 'flat' AND best >= 0.85 AND cv <= 0.05 THEN 'sufficient' WHEN assessment = 'still improving' THEN 'more data would help' ELSE 'mixed' END AS verdict FROM (
  SELECT region, best, cv, CASE WHEN gain >= 0.02 THEN 'still improving' WHEN gain >= 0.01 THEN 'slowing' ELSE 'flat' END AS assessment FROM (
    SELECT n_name AS region, (n_nationkey % 5) * CAST(0.006 AS DOUBLE) AS gain, 1 - n_nationkey * CAST(0.01 AS DOUBLE) AS best, (n_nationkey % 3) * CAST(0.03 AS DOUBLE) AS cv FROM nation))"""


@query(VERDICT_SQL)
def p19_p20_assessment_and_verdict(spark, d):
    n = F.col("n_nationkey")
    t = tables.table(spark, d, "nation").select(F.col("n_name").alias("region"), ((n % 5) * 0.006).alias("gain"), (1 - n * 0.01).alias("best"), ((n % 3) * 0.03).alias("cv"))
    t = t.withColumn("assessment", p.curve_assessment(F.col("gain")))
    return t.select("region", "assessment", p.data_verdict(F.col("assessment"), F.col("best"), F.col("cv")).alias("verdict"))


@query(over("samples", "SELECT sample_id, round(pow(least(greatest((water - CAST(0.02 AS DOUBLE)) / CAST(0.28 AS DOUBLE), 0), 1), 1 / CAST(1.15 AS DOUBLE)), 6) AS shown FROM samples"))
def p22_stretch(spark, d):
    return rounded(tables.samples(spark, d).select("sample_id", p.stretch(F.col("water")).alias("shown")))


@query(over("predictions", "SELECT region, round(r2, 4) > 0.5 AS r2_over_50, r2 > 0.65 AS r2_over_65, rmse < 3 AS rmse_under_3, o > 0.4 AS overlap_over_40, pearson_r > 0.3 AS correlation_over_30 FROM (SELECT region, " + METRICS + ", 0.5 AS o FROM predictions GROUP BY region) WHERE region = 'A'"))
def p23_success_checks(spark, d):
    t = m.metrics_by(tables.predictions(spark, d).filter("region = 'A'"), "region")
    overlap = t.select(F.lit(0.5).alias("mean_overlap"))
    return m.success_checks(t.select("r2", "rmse"), overlap, t.select("pearson_r")).withColumn("region", F.lit("A"))


@query(over("pixels", "SELECT pixel_id, NOT (image_row % 22 = 0 AND image_col % 22 = 0) AS is_gap, round(CASE WHEN image_row % 22 = 0 AND image_col % 22 = 0 THEN S1_VV ELSE CAST(1.2 AS DOUBLE) * S1_VH + CAST(11.5 AS DOUBLE) END, 8) AS filled FROM pixels WHERE S1_VV IS NOT NULL AND S1_VH IS NOT NULL"))
def p25_p26_gap_and_copy(spark, d):
    return rounded(p.require_filled(filled_pixels(spark, d), "VV_hat").select("pixel_id", "is_gap", F.col("VV_hat").alias("filled")), 8)


@query("""SELECT o_orderpriority AS stratum, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY
  CAST(('0x' || substr(md5(concat_ws('|', o_orderkey, '42')), 1, 8)) AS BIGINT)::DOUBLE / 4294967296, o_orderkey) AS r FROM orders) WHERE r <= 80""")
def g15_stratified_sample(spark, d):
    from gridloom.operators.sampling import stratified_sample

    return stratified_sample(tables.table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", 80).select(F.col("o_orderpriority").alias("stratum"), "o_orderkey")


