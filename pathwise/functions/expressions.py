"""Column expressions shared by the operators (all JVM-side, codegen-able)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo: float | None = None, hi: float | None = None) -> Column:
    """NumPy-style clip that keeps NULL as NULL (``greatest``/``least`` would not)."""
    x = col(c)
    out = x
    if hi is not None:
        out = F.when(x > F.lit(hi), F.lit(hi)).otherwise(out)
    if lo is not None:
        out = F.when(x < F.lit(lo), F.lit(lo)).otherwise(out)
    return out


def scaled(c, digits: int = 6) -> Column:
    """Round-half-up to ``digits`` decimals as BIGINT (engine-neutral parity form)."""
    return F.floor(col(c) * F.lit(10.0 ** digits) + F.lit(0.5)).cast("bigint")


def first_token(c) -> Column:
    """Text before the first single space (the diversity 'prefix' of a topic)."""
    return F.split(col(c), " ", 2).getItem(0)


def contains_any(c, tokens: Iterable[str]) -> Column:
    x = col(c)
    out = F.lit(False)
    for t in tokens:
        out = out | x.contains(t)
    return out


def case_map(c, mapping: dict, default=None) -> Column:
    """``CASE c WHEN k THEN v ... ELSE default END`` from a dict."""
    x = col(c)
    out = None
    for k, v in mapping.items():
        out = F.when(x == F.lit(k), F.lit(v)) if out is None else out.when(x == F.lit(k), F.lit(v))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default) if not isinstance(default, Column) else default)


def hex_byte(hexstr: Column, i: int) -> Column:
    """Integer value of the i-th byte (0-based) of a hex digest string."""
    return F.conv(F.substring(hexstr, 2 * i + 1, 2), 16, 10).cast("int")


def safe_div(num, den, floor_den: float = 1.0) -> Column:
    """``num / max(den, floor_den)``."""
    return col(num) / F.greatest(col(den), F.lit(floor_den))


def dot(a, b) -> Column:
    """Inner product of two ``array<double>`` columns, folded left to right."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def l2(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(col(a), lambda x: x * x),
                              F.lit(0.0).cast("double"), lambda acc, v: acc + v))
