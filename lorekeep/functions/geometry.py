"""GeoJSON geometry expressions. Coordinates nest 1 to 4 arrays deep, by geometry type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits beyond which a coordinate cannot be a longitude or latitude (with slack).
MAX_ABS_X, MAX_ABS_Y = 185, 95

_DEPTH = {
    "Point": 1,
    "LineString": 2,
    "MultiPoint": 2,
    "Polygon": 3,
    "MultiLineString": 3,
    "MultiPolygon": 4,
}


def _coordinates(geometry: Column, depth: int) -> Column:
    nested = "array<" * depth + "double" + ">" * depth
    return F.try_variant_get(geometry, "$.coordinates", nested)


def points(geometry: Column) -> Column:
    """All positions of a GeoJSON geometry (variant) as one array of coordinate arrays."""
    kind = F.try_variant_get(geometry, "$.type", "string")
    by_depth = {
        1: F.array(_coordinates(geometry, 1)),
        2: _coordinates(geometry, 2),
        3: F.flatten(_coordinates(geometry, 3)),
        4: F.flatten(F.flatten(_coordinates(geometry, 4))),
    }
    out = None
    for depth, value in by_depth.items():
        kinds = [k for k, d in _DEPTH.items() if d == depth]
        out = F.when(kind.isin(*kinds), value) if out is None else out.when(kind.isin(*kinds), value)
    return F.filter(out, lambda p: F.size(p) >= 2)


def point_geometry(x: Column, y: Column) -> Column:
    """GeoJSON text of a point, null when a coordinate is missing."""
    shape = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")))
    return F.when(x.isNotNull() & y.isNotNull(), shape)


def bounds(position_array: Column) -> Column:
    """Struct of the smallest box around the positions of one feature, null when it has none.

    Keeps a row a row: a large polygon is reduced in place, never exploded.
    """
    xs = F.transform(position_array, lambda p: F.get(p, 0))
    ys = F.transform(position_array, lambda p: F.get(p, 1))
    box = F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )
    return F.when(F.size(position_array) > 0, box)


def not_lon_lat(position_array: Column) -> Column:
    """True when the first position cannot be a longitude and latitude."""
    first = F.get(position_array, 0)
    out_of_range = (F.abs(F.get(first, 0)) > MAX_ABS_X) | (F.abs(F.get(first, 1)) > MAX_ABS_Y)
    return F.coalesce(out_of_range, F.lit(False))
