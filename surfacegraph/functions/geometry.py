"""Rectangles as structs of x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .js import col


def rect(x, y, w, h) -> Column:
    names = ("x", "y", "w", "h")
    return F.struct(*[col(v).cast("double").alias(n) for n, v in zip(names, (x, y, w, h), strict=True)])


def point(r: Column) -> Column:
    """The corner where a rectangle begins, as one without an extent."""
    return rect(r["x"], r["y"], F.lit(0), F.lit(0))


def right(r: Column) -> Column:
    return r["x"] + r["w"]


def bottom(r: Column) -> Column:
    return r["y"] + r["h"]


def edges(r: Column, prefix: str) -> list[Column]:
    """Left, top, right and bottom as four numbers that are never null (0 for none).

    For conditions on very many pairs: they compile to a few instructions each,
    where fields of structs would make a method too long for the compiler.
    """
    sides = {"x0": r["x"], "y0": r["y"], "x1": right(r), "y1": bottom(r)}
    return [F.coalesce(v, F.lit(0.0)).alias(f"{prefix}_{k}") for k, v in sides.items()]


def area(r: Column) -> Column:
    """Area; sides below zero count as zero."""
    return F.greatest(F.lit(0.0), r["w"]) * F.greatest(F.lit(0.0), r["h"])


def intersection(a: Column, b: Column) -> Column:
    """The common rectangle, null if it has no area (touching is none)."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    w, h = F.least(right(a), right(b)) - x, F.least(bottom(a), bottom(b)) - y
    return F.when((w > 0) & (h > 0), rect(x, y, w, h))


def touches(a: Column, b: Column) -> Column:
    """Rectangles that overlap or touch."""
    return (a["x"] <= right(b)) & (right(a) >= b["x"]) & (a["y"] <= bottom(b)) & (bottom(a) >= b["y"])


def overlap(a0: Column, a_size: Column, b0: Column, b_size: Column) -> Column:
    """Length of the common part of two segments, at least zero."""
    return F.greatest(F.lit(0.0), F.least(a0 + a_size, b0 + b_size) - F.greatest(a0, b0))


def union_all(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Aggregate: the bounding box of all rectangles of a group."""
    return F.struct(
        F.min(x).alias("x"), F.min(y).alias("y"), (F.max(x + w) - F.min(x)).alias("w"), (F.max(y + h) - F.min(y)).alias("h")
    )
