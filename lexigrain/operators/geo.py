"""Nearest places: a box of latitudes and longitudes, then great-circle distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EARTH_KM, DEGREE_KM = 6371, 111.045


def geo_index(places: DataFrame, primary_key: str = "id", longitude: str = "longitude", latitude: str = "latitude") -> DataFrame:
    """``doc_id``, both coordinates and their sines and cosines. Rows that lack a coordinate are left out."""
    lng, lat = F.col(longitude).cast("double"), F.col(latitude).cast("double")
    at = places.select(F.col(primary_key).alias("doc_id"), lng.alias("longitude"), lat.alias("latitude")).filter("longitude is not null and latitude is not null")
    for of, short in (("latitude", "lat"), ("longitude", "lng")):
        at = at.withColumn(f"cos_{short}", F.cos(F.radians(of))).withColumn(f"sin_{short}", F.sin(F.radians(of)))
    return at


def geo_insert(index: DataFrame, places: DataFrame, primary_key: str = "id") -> DataFrame:
    return index.unionByName(geo_index(places, primary_key))


def geo_delete(index: DataFrame, ids: Sequence) -> DataFrame:
    return index.filter(~F.col("doc_id").isin(list(ids))) if ids else index


def geo_nearest(index: DataFrame, longitude: float, latitude: float, distance_km: float, limit: int = 10) -> DataFrame:
    """``doc_id, distance`` in km of places within ``distance_km``, nearest first, ties by id.

    The ``limit`` nearest of the box are taken first and those beyond the
    distance dropped then. The box ends at the 180th meridian. Latitude comes
    first in the filter and reaches the scan.
    """
    import math

    lat, lng = math.radians(latitude), math.radians(longitude)
    high = distance_km / DEGREE_KM
    wide = distance_km / (DEGREE_KM * max(math.cos(lat), 1e-12))
    box = index.filter(F.col("latitude").between(latitude - high, latitude + high) & F.col("longitude").between(longitude - wide, longitude + wide))
    turn = F.col("cos_lng") * math.cos(lng) + F.col("sin_lng") * math.sin(lng)
    near = F.col("sin_lat") * math.sin(lat) + F.col("cos_lat") * math.cos(lat) * turn
    best = box.select("doc_id", near.alias("near")).orderBy(F.desc("near"), "doc_id").limit(limit)
    distance = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "near"))) * EARTH_KM
    return best.withColumn("distance", distance).filter(F.col("distance") <= distance_km).select("doc_id", "distance").orderBy("distance", "doc_id")
