"""Pixels stored by tile and window, so that a window or a chip reads its own files only.

A window table holds the pixels of each ``size`` by ``size`` window in a folder of its own, and with them a margin of
its neighbours' pixels (``is_margin``), so that work on small surroundings needs one window. Windows at a tile's
edge are short; outside the tile there are no pixels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class WindowTable:
    spark: SparkSession
    path: str
    size: int
    margin: int

    def rows(self) -> DataFrame:
        """All pixels once, with their window."""
        return self.spark.read.parquet(self.path).filter("not is_margin")

    def window(self, tile: str, row: int, col: int) -> DataFrame:
        """One window with its margin; other folders are not listed."""
        return self.spark.read.parquet(self.path).filter((F.col("tile") == tile) & (F.col("window_row") == row) & (F.col("window_col") == col))

    def box(self, tile: str, top: int, left: int, rows: int, cols: int) -> DataFrame:
        """The pixels of a rectangle, from the windows that it meets."""
        last = lambda at, n: (at + n - 1) // self.size
        here = F.col("window_row").between(top // self.size, last(top, rows)) & F.col("window_col").between(left // self.size, last(left, cols)) & (F.col("tile") == tile)
        inside = F.col("image_row").between(top, top + rows - 1) & F.col("image_col").between(left, left + cols - 1)
        return self.rows().filter(here & inside)


def write_windows(pixels: DataFrame, path: str, size: int, margin: int = 0) -> WindowTable:
    """Write pixels (tile, image_row, image_col, ...) as a window table. A pixel near an edge goes to up to four windows."""
    if not 0 <= margin <= size:
        raise ValueError("the margin must not be larger than a window")

    def windows(at: Column) -> Column:
        return F.sequence(F.greatest(F.floor((at - margin) / size), F.lit(0)).cast("long"), F.floor((at + margin) / size).cast("long"))

    spread = pixels.withColumn("window_row", F.explode(windows(F.col("image_row")))).withColumn("window_col", F.explode(windows(F.col("image_col"))))
    own = (F.col("window_row") == F.floor(F.col("image_row") / size)) & (F.col("window_col") == F.floor(F.col("image_col") / size))
    # Windows beyond the last pixel of a tile would hold a margin alone.
    last = pixels.groupBy(F.col("tile").alias("_t")).agg(F.floor(F.max("image_row") / size).alias("_r"), F.floor(F.max("image_col") / size).alias("_c"))
    kept = spread.withColumn("is_margin", ~own).join(last, F.col("tile") == F.col("_t")).filter("window_row <= _r and window_col <= _c").drop("_t", "_r", "_c")
    kept.repartition("tile", "window_row", "window_col").write.partitionBy("tile", "window_row", "window_col").parquet(path)
    return WindowTable(pixels.sparkSession, path, size, margin)


def band_summary(pixels: DataFrame, bands: Column, *keys: str) -> DataFrame:
    """(keys, band, n, lowest, highest) of an array of bands, numbered from 1; missing values don't count."""
    long = pixels.select(*keys, F.posexplode(bands).alias("i", "v"))
    return long.groupBy(*keys, (F.col("i") + 1).alias("band")).agg(F.count("v").alias("n"), F.min("v").alias("lowest"), F.max("v").alias("highest"))


def chips(table: WindowTable, centres: DataFrame, size: int, band: str) -> DataFrame:
    """(query, chip): a size by size window of ``band`` around each centre (query, tile, image_row, image_col), by rows; NULL outside the image.

    Chips whose first corner lies in the same patch of windows are cut from one array of that patch and its next ones. So
    every pixel is moved to at most four patches, however many chips it is part of.
    """
    half = size // 2
    step = -(-size // table.size)
    side = step * table.size
    patch = ["tile", "patch_row", "patch_col"]
    corner = lambda c: (F.col(c) - half).cast("long")
    of = lambda at, n: F.floor(at / n).cast("long")
    asked = centres.select("query", "tile", corner("image_row").alias("_row"), corner("image_col").alias("_col")).withColumns({"patch_row": of(F.col("_row"), side), "patch_col": of(F.col("_col"), side)})
    asked = asked.groupBy(*patch).agg(F.collect_list(F.struct("query", (F.col("_row") - F.col("patch_row") * side).cast("int").alias("r"), (F.col("_col") - F.col("patch_col") * side).cast("int").alias("c"))).alias("asked"))

    place = ((F.col("image_row") % table.size) * table.size + F.col("image_col") % table.size).cast("int")
    pixels = table.rows().select("tile", "window_row", "window_col", F.struct(place.alias("k"), F.col(band).cast("double").alias("v")).alias("p")).filter("p.v is not null")
    packed = pixels.groupBy("tile", "window_row", "window_col").agg(F.collect_list("p").alias("p"))
    both = lambda w: F.explode(F.array(of(F.col(w), step), of(F.col(w), step) - 1))
    spread = packed.withColumn("patch_row", both("window_row")).withColumn("patch_col", both("window_col"))
    window = F.struct((F.col("window_row") - F.col("patch_row") * step).cast("int").alias("row"), (F.col("window_col") - F.col("patch_col") * step).cast("int").alias("col"), F.transform("p", lambda x: x["k"]).alias("k"), F.transform("p", lambda x: x["v"]).alias("v"))
    held = spread.join(asked.select(*patch), patch, "left_semi").groupBy(*patch).agg(F.collect_list(window).alias("windows"))
    met = asked.join(held, patch, "left").select("asked", "windows")

    def cut(batches):
        for b in (b.slice(s, 1) for b in batches for s in range(b.num_rows)):
            grid, known = np.zeros((2 * side, 2 * side)), np.zeros((2 * side, 2 * side), bool)
            windows, centres = b.column(1).flatten(), b.column(0).flatten()
            w_row, w_col, k, v = windows.flatten() if len(windows) else [pa.array([], pa.int32())] * 4
            if len(windows):
                of = np.repeat(np.arange(len(windows)), np.asarray(k.value_lengths()))
                at = np.asarray(k.flatten())
                row, col = np.asarray(w_row)[of] * table_size + at // table_size, np.asarray(w_col)[of] * table_size + at % table_size
                grid[row, col], known[row, col] = np.asarray(v.flatten()), True
            query, r, c = centres.flatten()
            r, c = np.asarray(r), np.asarray(c)
            values, there = (np.lib.stride_tricks.sliding_window_view(g, (size, size)) for g in (grid, known))
            for s in range(0, len(r), 64):
                some = slice(s, s + 64)
                out, mask = values[r[some], c[some]].ravel(), ~there[r[some], c[some]].ravel()
                ends = np.arange(len(r[some]) + 1) * (size * size)
                yield pa.RecordBatch.from_arrays([query[some], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, mask=mask))], names=["query", "chip"])

    table_size = table.size
    return met.mapInArrow(cut, T.StructType([centres.schema["query"], T.StructField("chip", T.ArrayType(T.DoubleType()))]))
