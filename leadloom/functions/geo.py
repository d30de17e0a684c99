"""Grids and polygons with native expressions. A ring is an array of [lng, lat]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.structured import at

KM_PER_DEGREE = 111.32


def degrees_lat(km: Column | float) -> Column:
    return F.lit(km) / KM_PER_DEGREE if not isinstance(km, Column) else km / KM_PER_DEGREE


def degrees_lng(km: Column | float, lat: Column) -> Column:
    return (km if isinstance(km, Column) else F.lit(km)) / (KM_PER_DEGREE * F.cos(F.radians(lat)))


def inside(lng: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule over the ring's edges."""
    n = F.size(ring)

    def edge(acc: Column, i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))
        crosses = (a[1] > lat) != (b[1] > lat)
        at_lng = (b[0] - a[0]) * (lat - a[1]) / F.nullif(b[1] - a[1], F.lit(0.0)) + a[0]
        return acc != (crosses & F.coalesce(lng < at_lng, F.lit(False)))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(False), edge)).otherwise(False)


def inside_any(lng: Column, lat: Column, rings: Column) -> Column:
    return F.exists(rings, lambda r: inside(lng, lat, r))


def rings(geojson: Column) -> Column:
    """Outer rings of a Polygon, MultiPolygon, Feature, or of the first feature of a collection that has any; [] if none."""
    v = F.try_parse_json(geojson)
    none = F.array().cast("array<array<array<double>>>")

    def of(node: Column) -> Column:
        kind = at(node, "$.type")
        one = at(node, "$.coordinates", "array<array<array<double>>>")
        many = at(node, "$.coordinates", "array<array<array<array<double>>>>")
        return F.when(kind == "Polygon", F.slice(one, 1, 1)).when(kind == "MultiPolygon", F.transform(many, lambda p: p[0]))

    features = F.transform(at(v, "$.features", "array<variant>"), lambda f: of(at(f, "$.geometry", "variant")))
    wrapped = F.when(at(v, "$.type") == "Feature", of(at(v, "$.geometry", "variant"))).when(at(v, "$.type") == "FeatureCollection", F.try_element_at(F.filter(features, lambda r: F.size(r) > 0), F.lit(1)))
    return F.coalesce(of(v), wrapped, none)


def grid(df: DataFrame, rings_col: str, spacing_km: float) -> DataFrame:
    """df with lat, lng: one row per grid point inside a ring. Rows without rings give none; rings that overlap give points twice."""
    r = df.withColumn("_ring", F.explode(rings_col))
    low = lambda i: F.array_min(F.transform("_ring", lambda p: p[i]))
    high = lambda i: F.array_max(F.transform("_ring", lambda p: p[i]))
    r = r.withColumns({"_x0": low(0), "_x1": high(0), "_y0": low(1), "_y1": high(1)})
    r = r.withColumn("_dy", degrees_lat(spacing_km)).withColumn("_dx", degrees_lng(spacing_km, (F.col("_y0") + F.col("_y1")) / 2))
    # each coordinate is the one before plus a step, so rounding errors add up as in a loop

    def steps(a: str, b: str, d: str) -> Column:
        more = F.sequence(F.lit(0), F.floor((F.col(b) - F.col(a)) / F.col(d)).cast("int"))
        every = F.aggregate(more, F.array(a), lambda acc, _: F.concat(acc, F.array(F.element_at(acc, -1) + F.col(d))))
        return F.explode(F.filter(every, lambda x: x <= F.col(b)))

    r = r.withColumn("_lat", steps("_y0", "_y1", "_dy")).withColumn("_lng", steps("_x0", "_x1", "_dx"))
    r = r.where(inside(F.col("_lng"), F.col("_lat"), F.col("_ring")))
    return r.select(*[c for c in df.columns if c != rings_col], F.round("_lat", 7).alias("lat"), F.round("_lng", 7).alias("lng"))


def in_polygon(df: DataFrame, lng: str, lat: str, rings_col: str) -> DataFrame:
    """Rows inside any ring; rows without coordinates stay."""
    return df.where(F.col(lng).isNull() | F.col(lat).isNull() | inside_any(F.col(lng), F.col(lat), F.col(rings_col)))
