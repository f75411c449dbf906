"""Quadrilaterals given as ``array<number>`` x1, y1, ... x4, y4."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

DEGENERATE = 4  #: least side in pixels


def _at(p: Column, i: int) -> Column:
    return F.get(p, F.lit(i)).cast("double")


def _let(value: Column, body) -> Column:
    """``body(value)`` with *value* computed once, where an expression would repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def order_quad(p: Column) -> Column:
    """``array<struct<x, y>>``: corners by angle about their centre, first the one with least x + y
    (T13)."""
    pts = [F.struct(_at(p, 2 * i).alias("x"), _at(p, 2 * i + 1).alias("y")) for i in range(4)]
    cx = sum((q["x"] for q in pts), F.lit(0.0)) / 4
    cy = sum((q["y"] for q in pts), F.lit(0.0)) / 4
    turned = F.array_sort(F.array(*[F.struct(F.atan2(q["y"] - cy, q["x"] - cx).alias("a"), F.lit(i).alias("i"), q["x"].alias("x"), q["y"].alias("y")) for i, q in enumerate(pts)]))

    def spin(t: Column) -> Column:
        def by(sums: Column) -> Column:
            return F.array_position(sums, F.array_min(sums)).cast("int")

        first = _let(F.transform(t, lambda q: q["x"] + q["y"]), by)
        turn = _let(first, lambda f: F.concat(F.slice(t, f, F.lit(4)), F.slice(t, F.lit(1), f - 1)))
        return F.transform(turn, lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))

    return F.when(F.size(p) == 8, _let(turned, spin))


def _side(q: Column, i: int, j: int) -> Column:
    a, b = F.get(q, F.lit(i)), F.get(q, F.lit(j))
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def quad_size(q: Column) -> Column:
    """``struct<w, h>`` of an ordered quad: the longer of opposite sides, rounded half-even."""

    def size(z: Column) -> Column:
        w = F.bround(F.greatest(_side(z, 0, 1), _side(z, 3, 2))).cast("int")
        h = F.bround(F.greatest(_side(z, 0, 3), _side(z, 1, 2))).cast("int")
        return F.struct(w.alias("w"), h.alias("h"))

    return _let(q, size)


def is_degenerate(q: Column) -> Column:
    """A side under four pixels."""
    return _let(quad_size(q), lambda s: (s["w"] < DEGENERATE) | (s["h"] < DEGENERATE))


def tilt(q: Column) -> Column:
    """Degrees of the top edge from level, at most 90."""

    def top(z: Column) -> Column:
        a, b = F.get(z, F.lit(0)), F.get(z, F.lit(1))
        return F.abs(F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"])))

    return _let(_let(q, top), lambda t: F.least(t, 180 - t))


def bbox(p: Column) -> Column:
    """``struct<x0, y0, x1, y1>``."""
    xs, ys = F.filter(p, lambda _, i: i % 2 == 0), F.filter(p, lambda _, i: i % 2 == 1)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def michelson(low: Column, high: Column) -> Column:
    """Contrast of the 5th and 95th percentile of grey values: their difference over their sum."""
    return (high - low) / (high + low + 1e-6)


def _area(p) -> float:
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(p, [*p[1:], p[0]])) / 2


def _points(p) -> list[tuple[float, float]]:
    pts = [(float(p[i]), float(p[i + 1])) for i in range(0, len(p), 2)]
    return pts if _area(pts) >= 0 else pts[::-1]


def overlap(p, q) -> tuple[float, float, float]:
    """Areas of two convex quads and of what they share, by clipping one at the other's edges."""
    a, b = _points(p), _points(q)
    if not _area(a) or not _area(b):
        return abs(_area(a)), abs(_area(b)), 0.0
    shape = a
    for (x0, y0), (x1, y1) in zip(b, [*b[1:], b[0]]):
        side = lambda z: (x1 - x0) * (z[1] - y0) - (y1 - y0) * (z[0] - x0)  # noqa: B023, E731
        cut = []
        for u, v in zip(shape, [*shape[1:], shape[0]] if shape else []):
            su, sv = side(u), side(v)
            if su >= 0:
                cut.append(u)
            if (su > 0 > sv) or (su < 0 < sv):
                t = su / (su - sv)
                cut.append((u[0] + t * (v[0] - u[0]), u[1] + t * (v[1] - u[1])))
        shape = cut
    return abs(_area(a)), abs(_area(b)), abs(_area(shape)) if len(shape) > 2 else 0.0


@F.pandas_udf(StructType([StructField("iou", DoubleType()), StructField("cover", DoubleType())]))
def quad_overlap(p: pd.Series, q: pd.Series) -> pd.DataFrame:
    """Intersection over union, and the shared part of the first quad (T17); 0 for empty areas,
    null where a side is null or not a quad."""
    out = []
    for a, b in zip(p, q):
        if a is None or b is None or len(a) != 8 or len(b) != 8:
            out.append((None, None))
            continue
        s, t, both = overlap(a, b)
        out.append((both / (s + t - both) if s + t - both > 0 else 0.0, both / s if s > 0 else 0.0))
    return pd.DataFrame(out, columns=["iou", "cover"])
