"""Problem 4: points near other points, or within regions.

Regions are split by trapezoidal decomposition into slabs, and the slabs, not
the regions, are distributed: a slab and the points meet in a grid whose cells
are at least as wide and as high as the slab (powers of two degrees, each axis its
own), so no slab covers more than four cells whatever its size.  A point is located by
binary search among the edges of a slab, as a Catalyst expression.

Near pairs meet in a grid of the search radius; a crowded cell is cut into
blocks of ``BLOCK`` points, so that it is worked on by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demesne.functions.geometry import EARTH_KM, IRELAND, Box, haversine_km, polygon_parts, repaired, slabs, wkt_point
from demesne.runtime import cut, lookup_join, spread

BLOCK = 512
#: finest and coarsest grid cells, as powers of two degrees, and the step between levels; every point
#: is looked up once a pair of levels in use, so levels are few
FINEST, COARSEST, STEP = -12, 8, 2


def true_locations(places: DataFrame, id_col: str = "id", lat: str = "centroid_lat", lon: str = "centroid_lon", wkt: str = "wkt_geometry", box: Box = IRELAND) -> DataFrame:
    """(id, lat, lon): the centroid with errors of entry undone, else the POINT geometry; rows with neither are left out."""
    centroid = repaired(F.col(lat), F.col(lon), box)
    point = wkt_point(F.col(wkt))
    at = F.coalesce(centroid, repaired(point["lat"], point["lon"], box))
    return places.select(F.col(id_col).alias("id"), at.alias("at")).where("id is not null and at is not null").select("id", "at.lat", "at.lon")


_SLAB = T.StructType(
    [
        T.StructField("region", T.LongType()),
        T.StructField("x0", T.DoubleType()),
        T.StructField("x1", T.DoubleType()),
        T.StructField("lo", T.ArrayType(T.DoubleType())),
        T.StructField("hi", T.ArrayType(T.DoubleType())),
    ]
)


def region_slabs(regions: DataFrame, id_col: str = "id", wkt: str = "wkt_geometry", box: Box | None = IRELAND, any_ring: bool = False) -> DataFrame:
    """Slabs of every readable polygon: (region, x0, x1, lo, hi).

    Each part of a multipolygon is split by itself (holes are edges like the
    shell's), so touching parts don't cancel out.  With ``any_ring`` every ring
    is split by itself, so that a point inside a hole counts as inside.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *slab) for i, text in zip(batch["id"], batch["wkt"]) for part in polygon_parts(text, box) for rings in ([[r] for r in part] if any_ring else [part]) for slab in slabs(rings)]
            yield pd.DataFrame(rows, columns=["region", "x0", "x1", "lo", "hi"])

    polygons = regions.select(F.col(id_col).cast("long").alias("id"), F.col(wkt).alias("wkt")).where(F.col("id").isNotNull() & F.col("wkt").rlike(r"(?i)polygon\s*z?m?\s*\("))
    return spread(polygons, "id").mapInPandas(split, _SLAB)


def _level(extent: Column) -> Column:
    up = (F.ceil(F.log2(F.greatest(extent, F.lit(2.0**FINEST))) / STEP) * STEP).cast("int")
    return F.least(F.greatest(up, F.lit(FINEST)), F.lit(COARSEST))


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level)).cast("long")


def edges_below(x: Column, y: Column, x0: Column, x1: Column, lo: Column, hi: Column) -> Column:
    """How many of a slab's edges lie at or below (x, y), by binary search."""
    part = (x - x0) / (x1 - x0)
    height = lambda i: F.get(lo, i) + (F.get(hi, i) - F.get(lo, i)) * part
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(lo) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("a"), F.size(lo).alias("b"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["a"] + acc["b"]) / 2).cast("int")
        below = height(mid) <= y
        open_ = acc["a"] < acc["b"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(acc["a"]).alias("a"), F.when(open_ & ~below, mid).otherwise(acc["b"]).alias("b"))

    return F.aggregate(steps, start, halve)["a"]


def points_in_regions(points: DataFrame, region_slab: DataFrame) -> DataFrame:
    """(id, region) for every point (id, lat, lon) inside a region; a region's western and lower edges count as inside."""
    s = region_slab.withColumn("y0", F.least(F.array_min("lo"), F.array_min("hi"))).withColumn("y1", F.greatest(F.array_max("lo"), F.array_max("hi")))
    s = cut(s.withColumn("lx", _level(F.col("x1") - F.col("x0"))).withColumn("ly", _level(F.col("y1") - F.col("y0"))))
    span = lambda a, b, lv: F.explode(F.sequence(_cell(F.col(a), F.col(lv)), _cell(F.col(b), F.col(lv))))
    s = s.withColumn("cx", span("x0", "x1", "lx")).withColumn("cy", span("y0", "y1", "ly"))
    # at most ((COARSEST - FINEST) / STEP + 1) squared level pairs exist
    levels = [F.struct(F.lit(r["lx"]).alias("lx"), F.lit(r["ly"]).alias("ly")) for r in s.select("lx", "ly").distinct().collect()]
    if not levels:
        return points.join(region_slab.select("region"), F.lit(False)).select("id", "region")
    p = points.select("id", "lat", "lon", F.explode(F.array(*levels)).alias("l")).select("id", "lat", "lon", F.col("l.lx").alias("lx"), F.col("l.ly").alias("ly"))
    p = p.withColumn("cx", _cell(F.col("lon"), F.col("lx"))).withColumn("cy", _cell(F.col("lat"), F.col("ly")))
    keys = ["lx", "ly", "cx", "cy"]
    crowd = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    s = in_blocks(s, crowd, keys, F.xxhash64("region", "x0"))
    p = all_blocks(p, crowd, keys)
    met = p.join(s, [*keys, "block"]).where((F.col("lon") >= F.col("x0")) & (F.col("lon") < F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1")))
    odd = edges_below(F.col("lon"), F.col("lat"), F.col("x0"), F.col("x1"), F.col("lo"), F.col("hi")) % 2 == 1
    return met.where(odd).select("id", "region").distinct()


def in_blocks(df: DataFrame, crowd: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """Rows with a block number below ceil(n / BLOCK) of their cell."""
    return lookup_join(df, crowd, keys).withColumn("block", F.pmod(by, F.ceil(F.col("n") / BLOCK))).drop("n")


def all_blocks(df: DataFrame, crowd: DataFrame, keys: list[str]) -> DataFrame:
    """Rows once for each block of their cell; rows whose cell the other side lacks are dropped."""
    return lookup_join(df, crowd, keys).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BLOCK) - 1))).drop("n")


def near_pairs(points: DataFrame, km: float) -> DataFrame:
    """(id_a, id_b, km), id_a < id_b: every pair of points at most ``km`` apart by great circle.

    Points at one spot are 0 km apart; null coordinates are near nothing.
    """
    d = math.degrees(km / EARTH_KM) * (1 + 1e-9)
    points = points.where("id is not null and lat is not null and lon is not null").select("id", "lat", "lon")
    band = lambda lat: F.floor(lat / d).cast("long")
    # the reach in longitude at a band's most polar edge, and a cell of that width
    polar = lambda b: F.least(F.greatest(F.abs(b * d), F.abs((b + 1) * d)) + d, F.lit(89.9999))
    reach = lambda b: F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(math.radians(d))) / F.cos(F.radians(polar(b)))))) * (1 + 1e-9)
    a = points.withColumn("b", band(F.col("lat")))
    a = a.withColumn("c", F.floor(F.col("lon") / reach(F.col("b"))).cast("long"))
    b = points.withColumn("b", F.explode(F.sequence(band(F.col("lat")) - 1, band(F.col("lat")) + 1)))
    b = b.withColumn("r", reach(F.col("b"))).withColumn("l", F.explode(F.filter(F.array(F.col("lon"), F.col("lon") + 360, F.col("lon") - 360), lambda x: (x >= -180 - F.col("r")) & (x <= 180 + F.col("r")))))
    b = b.withColumn("c", F.explode(F.sequence(F.floor((F.col("l") - F.col("r")) / F.col("r")).cast("long"), F.floor((F.col("l") + F.col("r")) / F.col("r")).cast("long"))))
    crowd = a.groupBy("b", "c").agg(F.count(F.lit(1)).alias("n"))
    left = in_blocks(a, crowd, ["b", "c"], F.xxhash64("id")).select("b", "c", "block", F.col("id").alias("id_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"))
    right = all_blocks(b, crowd, ["b", "c"]).select("b", "c", "block", F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    met = left.join(right, ["b", "c", "block"]).where("id_a < id_b")
    met = met.withColumn("km", haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")))
    return met.where(F.col("km") <= km).select("id_a", "id_b", "km")


def neighbours(places: DataFrame, km: float, id_col: str = "id", wkt: str = "wkt_geometry", box: Box = IRELAND) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs at most ``km`` apart, or of which one lies inside the other's polygon."""
    points = cut(true_locations(places, id_col=id_col, wkt=wkt, box=box))
    near = near_pairs(points, km).select("id_a", "id_b")
    within = points_in_regions(points, region_slabs(places, id_col, wkt, box)).where("id <> region")
    within = within.select(F.least("id", "region").alias("id_a"), F.greatest("id", "region").alias("id_b"))
    return near.unionByName(within).distinct()
