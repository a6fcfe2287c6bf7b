"""The imagery views over the driver's tables, and general scans.

Each adapter turns one driver table into the shape that the operators expect: labelled
samples, the pixels of a scene, predictions, and image collections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Land-cover classes by number, and the sampled regions.
LABELS = ("water", "trees", "grass", "flooded_vegetation", "crops", "shrub_and_scrub", "built", "bare", "snow_and_ice")
REGIONS = ("sf_bay_urban", "iowa_ag", "amazon_forest", "california_coast")
TARGETS = ("S1_VV", "S1_VH", "S1_VV_div_VH")

SAMPLES_SCHEMA = T.StructType(
    [T.StructField("sample_id", T.LongType()), T.StructField("dw_label", T.IntegerType()), T.StructField("region", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in (*TARGETS, "latitude", "longitude", *LABELS)]
)
PREDICTIONS_SCHEMA = T.StructType([T.StructField("region", T.StringType()), T.StructField("dw_label_name", T.StringType()), T.StructField("actual", T.DoubleType()), T.StructField("predicted", T.DoubleType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def component(i: int, column: str = "embedding") -> Column:
    """The i-th embedding value, from 1, as a double."""
    return F.element_at(column, i).cast("double")


def label_name(label: Column) -> Column:
    """Class name by number; NULL if there is no such class."""
    return F.create_map(*[x for i, name in enumerate(LABELS) for x in (F.lit(i), F.lit(name))])[label.cast("int")]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled points with a 64-d embedding, three radar values, nine class probabilities and a place."""
    e = component
    vv, vh = -13 + 12 * e(1) + 6 * e(2), -20 + 10 * e(1) - 8 * e(3)
    label = (F.col("label") % 9).cast("int")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        label.alias("dw_label"),
        label_name(label).alias("dw_label_name"),
        F.element_at(F.array(*map(F.lit, REGIONS)), (F.col("vec_id") % 4 + 1).cast("int")).alias("region"),
        vv.alias("S1_VV"),
        vh.alias("S1_VH"),
        (vv - vh).alias("S1_VV_div_VH"),
        (37 + e(5)).alias("latitude"),
        (-122 + e(6)).alias("longitude"),
        *[F.abs(e(20 + i)).alias(name) for i, name in enumerate(LABELS)],
        "embedding",
    )


def pixels(spark: SparkSession, sf_dir: str, with_embedding: bool = False) -> DataFrame:
    """The pixels of one scene, 128 columns wide; VV is masked where the order is pending."""
    p = table(spark, sf_dir, "orders").select(
        F.lit("t0").alias("tile"),
        F.floor(F.col("o_orderkey") / 128).alias("image_row"),
        (F.col("o_orderkey") % 128).alias("image_col"),
        F.when(F.col("o_orderstatus") != "P", -25 + F.col("o_totalprice") / 20000).alias("S1_VV"),
        (-30 + F.col("o_totalprice") / 25000).alias("S1_VH"),
        F.col("o_orderkey").alias("pixel_id"),
    )
    p = p.withColumn("S1_VV_div_VH", F.col("S1_VV") - F.col("S1_VH"))
    if not with_embedding:
        return p
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    size = vectors.agg(F.count("*").alias("n_vectors"))
    return p.crossJoin(F.broadcast(size)).withColumn("vec_id", F.col("pixel_id") % F.col("n_vectors")).drop("n_vectors").join(vectors, "vec_id").drop("vec_id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test predictions by region and class."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("region"), F.col("l_linestatus").alias("dw_label_name"), F.col("l_linenumber").alias("fold"), F.col("l_orderkey").alias("sample_id"),
        (F.col("l_extendedprice") / 1000).alias("actual"), (F.col("l_quantity") * 2.1).alias("predicted"),
    )


def scene_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image collection: one row per scene and pixel, with bands, label, quality bits and scene metadata."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("scene_id"), "ts", F.col("user_id").alias("pixel_id"), F.col("event_type").alias("dw_label_name"), F.col("value").alias("band"), (F.col("value") / 2 - 3).alias("VH"),
        k.alias("k"), (k * 64).alias("qa60"), k.cast("double").alias("cloudy_pct"), (F.col("event_id") % 360 - 180).cast("double").alias("lon"), (F.col("user_id") % 90).cast("double").alias("lat"),
        F.when(F.col("event_id") % 3 == 0, "IW").otherwise("EW").alias("instrument_mode"), F.when(F.col("event_id") % 2 == 0, 10).otherwise(25).alias("resolution_m"),
        F.when(F.col("event_id") % 5 == 0, F.array(F.lit("VV"))).when(F.col("event_id") % 5 == 1, F.array(F.lit("VH"), F.lit("VV"))).otherwise(F.array(F.lit("VV"), F.lit("VH"))).alias("polarisations"),
    )


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The same frame; an error names the columns that are missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV scan with header and fixed schema; NaN becomes NULL."""
    read = spark.read.schema(schema).csv(path, header=True)
    return read.select(*[(F.when(~F.isnan(f.name), F.col(f.name)) if isinstance(f.dataType, T.DoubleType | T.FloatType) else F.col(f.name)).alias(f.name) for f in schema.fields])


def optional_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As :func:`csv_table`, and an empty frame if there is nothing at the path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    exists = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return csv_table(spark, path, schema) if exists else spark.createDataFrame([], schema)


def discover_tiles(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """Sorted names of the tiles under a path that fit the pattern; an error if there are none."""
    names = spark.read.option("pathGlobFilter", glob).parquet(path).select(F.col("_metadata.file_name").alias("tile")).distinct().orderBy("tile")
    if names.isEmpty():
        raise FileNotFoundError(f"no tiles like {glob} under {path}")
    return names


def tile_offset(name: Column) -> tuple[Column, Column]:
    """(row, column) from a name that ends in -row-column.tif, else zeros."""
    part = lambda i: F.regexp_extract(name, r"-(\d+)-(\d+)\.tif$", i)
    return tuple(F.when(part(i) != "", part(i).cast("long")).otherwise(0).cast("long") for i in (1, 2))


def windows(size: DataFrame, chunk: int) -> DataFrame:
    """Processing windows of images (tile, height, width): row_off, col_off, rows, cols; those at the edge are short."""
    step = F.lit(chunk).cast("long")
    offsets = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1, step))
    out = size.filter("height > 0 and width > 0").select("tile", "height", "width", offsets(F.col("height")).alias("row_off")).select("*", offsets(F.col("width")).alias("col_off"))
    return out.select("tile", "row_off", "col_off", F.least(step, F.col("height") - F.col("row_off")).alias("rows"), F.least(step, F.col("width") - F.col("col_off")).alias("cols"))
