"""Sinks: metric tables, run summaries, point layers, images, predictions, models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """A metric table as CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True)


def write_summary(df: DataFrame, path: str) -> None:
    """A run summary, one JSON object per row, with NULL fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def geojson_features(points: DataFrame, lon: str, lat: str, properties: list[str], layer: str) -> DataFrame:
    """(layer, feature): each point as a GeoJSON feature in one line of text."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return points.select(layer, F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def write_geojson_layers(features: DataFrame, layer: str, path: str) -> None:
    """One folder of features per layer, newline-delimited."""
    features.write.mode("overwrite").partitionBy(layer).text(path)


def write_image(pixels: DataFrame, path: str, by: str = "tile") -> None:
    """A pixel table by tile; masked bands stay NULL."""
    pixels.write.mode("overwrite").partitionBy(by).parquet(path)


def write_predictions(predictions: DataFrame, path: str, by: tuple[str, ...] = ("feature_set", "target", "model_name")) -> None:
    """Test predictions, one folder for each model instead of one file."""
    predictions.write.mode("overwrite").partitionBy(*by).parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
