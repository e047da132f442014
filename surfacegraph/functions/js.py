"""Column helpers for JavaScript number and string semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_round(c: str | Column) -> Column:
    """Math.round: halves go up, also below zero."""
    return F.floor(col(c) + F.lit(0.5)).cast("double")


def round_to(c: str | Column, digits: int) -> Column:
    """Math.round(c * 10**digits) / 10**digits."""
    scale = F.lit(float(10**digits))
    return js_round(col(c) * scale) / scale


def to_fixed(c: str | Column, digits: int) -> Column:
    """Number(c.toFixed(digits)) for small non-negative c."""
    return F.round(col(c).cast("decimal(30,17)"), digits).cast("double")


def parse_float(c: str | Column) -> Column:
    """parseFloat: the number a string starts with, else null."""
    return F.nullif(F.regexp_extract(col(c), NUMBER, 1), F.lit("")).cast("double")


def parse_int(c: str | Column) -> Column:
    """parseInt in base ten, else null."""
    return F.nullif(F.regexp_extract(col(c), r"^\s*([-+]?\d+)", 1), F.lit("")).cast("long")


def number_or(c: str | Column, default: float) -> Column:
    return F.coalesce(parse_float(c), F.lit(float(default)))


def truthy(c: str | Column) -> Column:
    """A string that is neither null nor empty."""
    return F.coalesce(col(c) != "", F.lit(False))


def includes(c: str | Column, part: str) -> Column:
    return F.coalesce(F.contains(col(c), F.lit(part)), F.lit(False))


def one_of(c: str | Column, values) -> Column:
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def is_(c: str | Column, value) -> Column:
    """Strict equality: null equals nothing."""
    return F.coalesce(col(c) == value, F.lit(False))


def yes(c: str | Column) -> Column:
    """A boolean whose null means false."""
    return F.coalesce(col(c), F.lit(False))


def number_text(c: str | Column) -> Column:
    """A number as JSON.stringify prints it, for values of ordinary size."""
    c = col(c).cast("double")
    whole = c == F.floor(c)
    return F.when(c.isNull(), F.lit("null")).when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
