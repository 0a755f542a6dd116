"""Vessels and the straits they pass: distances, nearest chokepoint, traffic, breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH_NM = 3440.065
#: Code, latitude, longitude and radius in nautical miles of the straits.
CHOKEPOINTS = (
    ("HORMUZ", 26.56, 56.25, 75.0), ("MALACCA", 2.50, 101.80, 150.0), ("SUEZ", 30.42, 32.35, 60.0), ("BAB_EL_MANDEB", 12.58, 43.33, 60.0),
    ("PANAMA", 9.08, -79.68, 50.0), ("BOSPORUS", 41.12, 29.07, 30.0), ("GIBRALTAR", 35.95, -5.60, 50.0), ("DOVER", 51.00, 1.45, 40.0),
)


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in nautical miles, to one decimal."""
    half = lambda d: F.sin(F.radians(d) / 2)
    a = half(lat2 - lat1) * half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1) * half(lon2 - lon1)
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))
    return F.round(2 * EARTH_NM * F.atan2(F.sqrt(a), F.sqrt(1 - a)), 1)


def chokepoints(spark: SparkSession) -> DataFrame:
    """The fixed table of straits."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(c).alias("code"), F.lit(a).alias("c_lat"), F.lit(o).alias("c_lon"), F.lit(r).alias("radius_nm")) for c, a, o, r in CHOKEPOINTS))))


def nearest(vessels: DataFrame) -> DataFrame:
    """Vessels with the nearest strait and whether they are inside its radius; the straits are a constant array, so no join."""
    points = F.array(*(F.struct(haversine_nm(F.col("latitude"), F.col("longitude"), F.lit(a), F.lit(o)).alias("d"), F.lit(c).alias("code"), F.lit(r).alias("r")) for c, a, o, r in CHOKEPOINTS))
    best = F.array_min(points)
    return vessels.withColumn("_b", best).select("*", F.col("_b.code").alias("chokepoint"), F.col("_b.d").alias("distance_nm"), (F.col("_b.d") <= F.col("_b.r")).alias("inside")).drop("_b")


def traffic(vessels: DataFrame, within_nm: float = 100.0) -> DataFrame:
    """How many vessels are near each strait; straits without any are kept."""
    found = nearest(vessels).where(F.col("distance_nm") <= within_nm).groupBy("chokepoint").agg(F.count(F.lit(1)).alias("vessels"), F.sum("dwt").alias("dwt"))
    return chokepoints(vessels.sparkSession).join(found, F.col("code") == F.col("chokepoint"), "left").select("code", F.coalesce("vessels", F.lit(0)).alias("vessels"), F.coalesce("dwt", F.lit(0.0)).alias("dwt"))


def breakdown(vessels: DataFrame) -> DataFrame:
    return vessels.groupBy("cargo_category").agg(F.count(F.lit(1)).alias("vessels"), F.sum("dwt").alias("dwt"), F.array_join(F.sort_array(F.collect_set("flag")), ",").alias("flags"))
