"""Compositing of image collections held as scene-pixel tables.

Every composite is one aggregation over the pixel key. Filters on scenes are plain
predicates and reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOUD_BIT, CIRRUS_BIT = 10, 11


def within_bounds(scenes: DataFrame, west: float, south: float, east: float, north: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return scenes.filter(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def within_years(scenes: DataFrame, year: int, years: int = 1, ts: str = "ts") -> DataFrame:
    """Rows of the half-open span from January 1 of ``year``."""
    start = F.make_date(F.lit(year), F.lit(1), F.lit(1)).cast("timestamp")
    return scenes.filter((F.col(ts) >= start) & (F.col(ts) < F.make_date(F.lit(year + years), F.lit(1), F.lit(1)).cast("timestamp")))


def with_metadata(scenes: DataFrame, mode: str, resolution: int, polarisations: tuple[str, ...] = ("VV", "VH"), exactly: bool = False) -> DataFrame:
    """Scenes of an instrument mode and resolution whose list of polarisations holds, or exactly is, the given one."""
    held = F.col("polarisations") == F.array(*map(F.lit, polarisations))
    if not exactly:
        held = F.lit(True)
        for p in polarisations:
            held = held & F.array_contains("polarisations", p)
    return scenes.filter((F.col("instrument_mode") == mode) & (F.col("resolution_m") == resolution) & held)


def median_composite(scenes: DataFrame, bands: list[str], pixel: tuple[str, ...] = ("pixel_id",)) -> DataFrame:
    """Exact median over time of each band."""
    return scenes.groupBy(*pixel).agg(*[F.median(b).alias(b) for b in bands])


def mean_composite(scenes: DataFrame, bands: list[str], pixel: tuple[str, ...] = ("pixel_id",)) -> DataFrame:
    return scenes.groupBy(*pixel).agg(*[F.avg(b).alias(b) for b in bands])


def mosaic(scenes: DataFrame, bands: list[str], pixel: tuple[str, ...] = ("pixel_id",), order: tuple[str, ...] = ("ts", "scene_id")) -> DataFrame:
    """The latest scene on top; equal times are ordered by scene."""
    top = F.max_by(F.struct(*bands), F.struct(*order)).alias("_top")
    return scenes.groupBy(*pixel).agg(top).select(*pixel, *[F.col(f"_top.{b}").alias(b) for b in bands])


def mode_composite(scenes: DataFrame, label: str, pixel: tuple[str, ...] = ("pixel_id",)) -> DataFrame:
    """The most frequent label; of equally frequent ones the least."""
    return scenes.groupBy(*pixel).agg(F.mode(label, True).alias(label))


def cloud_free(value: Column, quality: str = "qa60", scale: float = 10000.0) -> Column:
    """The scaled band where neither the cloud nor the cirrus bit is set, else NULL."""
    bit = lambda b: F.col(quality).bitwiseAND(F.lit(1 << b))
    return F.when((bit(CLOUD_BIT) == 0) & (bit(CIRRUS_BIT) == 0), value / scale)


def clear_median(scenes: DataFrame, bands: list[str], most_cloud: float = 20.0, pixel: tuple[str, ...] = ("pixel_id",), scale: float = 10000.0) -> DataFrame:
    """Median of masked bands over scenes with less cloud than ``most_cloud`` per cent."""
    clear = scenes.filter(F.col("cloudy_pct") < most_cloud).withColumns({b: cloud_free(F.col(b), scale=scale) for b in bands})
    return median_composite(clear, bands, pixel)


def least_cloudy(scenes: DataFrame) -> DataFrame:
    """All pixels of the one scene with the least cloud (ties: least scene id)."""
    first = scenes.agg(F.min_by("scene_id", F.struct("cloudy_pct", "scene_id")).alias("scene_id"))
    return scenes.join(F.broadcast(first), "scene_id", "left_semi")


def stack_bands(base: DataFrame, *layers: DataFrame, pixel: tuple[str, ...] = ("pixel_id",), how: str = "inner") -> DataFrame:
    """Co-located images side by side."""
    for layer in layers:
        base = base.join(layer, list(pixel), how)
    return base


def commonly_valid(stack: DataFrame, bands: list[str]) -> DataFrame:
    """Pixels that no band masks."""
    mask = F.lit(True)
    for b in bands:
        mask = mask & F.col(b).isNotNull()
    return stack.filter(mask)


def assign_region(points: DataFrame, regions: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points with the rectangle (region, west, south, east, north) that holds them.

    Rectangles are parameters of a study; they are counted, and broadcast up to 10,000.
    More are cut into cells of one degree first, so that points meet them by an equality.
    """
    inside = F.col(lon).between(F.col("west"), F.col("east")) & F.col(lat).between(F.col("south"), F.col("north"))
    if regions.count() <= 10_000:
        return points.join(F.broadcast(regions), inside).drop("west", "south", "east", "north")
    cells = regions.withColumn("_x", F.explode(F.sequence(F.floor("west"), F.floor("east")))).withColumn("_y", F.explode(F.sequence(F.floor("south"), F.floor("north"))))
    return points.withColumn("_x", F.floor(lon)).withColumn("_y", F.floor(lat)).join(cells, ["_x", "_y"]).filter(inside).drop("_x", "_y", "west", "south", "east", "north")


def annotate(points: DataFrame, region: str, year: int) -> DataFrame:
    """Region and year as columns."""
    return points.withColumn("region", F.lit(region)).withColumn("year", F.lit(year))


def merge(*collections: DataFrame) -> DataFrame:
    out = collections[0]
    for c in collections[1:]:
        out = out.unionByName(c)
    return out
