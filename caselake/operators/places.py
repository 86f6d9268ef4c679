"""Places: name-keyed lookups and polygon centres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..fixed_values import PLACE_COORDINATES
from ..functions import place_name_key
from .clean import keep_last

DEGREE_PARTS = 10_000_000.0


def coordinates(spark: SparkSession, table: dict | None = None) -> DataFrame:
    """The literal place -> (lon, lat) map as a DataFrame."""
    table = PLACE_COORDINATES if table is None else table
    return spark.createDataFrame(
        [(name, *lon_lat) for name, lon_lat in table.items()], "name_key string, lon double, lat double")


def keyed_coordinates(spark: SparkSession) -> DataFrame:
    """The map by the same key as the rows': its names pass through ``place_name_key`` as well. Of names
    that fold to one key the first in the alphabet counts (larger ``_n``)."""
    named = coordinates(spark)
    return named.withColumn("_n", -F.row_number().over(Window.orderBy("name_key"))).withColumn(
        "name_key", place_name_key(F.col("name_key")))  # one row per literal, a bounded table


def lookup_places(rows: DataFrame, places: DataFrame, key: str, order: str, how: str = "inner") -> DataFrame:
    """Join ``places`` by name key. Of places sharing a key the one with the largest
    ``order`` counts (a later entry replaces an earlier one)."""
    return rows.join(keep_last(places, [key], [F.col(order).desc()]).drop(order), key, how)


def polygon_vertices(features: DataFrame, feature: str, polygons: str = "polygons") -> DataFrame:
    """Nested geometry (polygon -> ring -> point) to one row per vertex of each outer ring."""
    rings = features.select(feature, F.posexplode(polygons).alias("ring_id", "rings"))
    outer = rings.select(feature, "ring_id", F.posexplode(F.try_element_at("rings", F.lit(1))).alias("pos", "p"))
    return outer.select(feature, "ring_id", "pos", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))


def vertex_centre(vertices: DataFrame, feature: str = "feature_id", ring: str = "ring_id") -> DataFrame:
    """Mean vertex of each feature's longest ring; of equally long rings the lowest id.
    Vertices are counted and summed per ring before the shuffle, so a huge ring is never
    gathered; the pick then works on one row per ring. Sums run over whole 1e-7 degrees
    (about a centimetre), which makes the mean independent of the order of addition."""
    def mean(axis: str):
        return F.sum(F.round(F.col(axis) * DEGREE_PARTS).cast("bigint")) / F.count(F.lit(1)) / DEGREE_PARTS

    rings = vertices.groupBy(feature, ring).agg(
        F.count(F.lit(1)).alias("n_vertices"), mean("lon").alias("lon"), mean("lat").alias("lat"))
    return keep_last(rings, [feature], [F.col("n_vertices").desc(), F.col(ring).asc()])
