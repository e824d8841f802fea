"""Exact quantiles without gathering values.

A rank is found by refinement: the range that holds it is cut into ``BINS`` equal parts, one grouped count tells which part
holds the rank, and that part's least and greatest values are the next range.  All columns and ranks go through the same
passes.  A task holds at most ``BINS`` counters per rank, however many distinct values there are; the driver holds the
ranges.  Once a range holds at most ``FEW`` rows they are looked at directly.

NULLs take no part; NaN counts as greatest, as in sorting.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
FEW = 5_000
SPECIAL = {-1: -math.inf, 1: math.inf, 2: math.nan}


def _kind(v: Column) -> Column:
    return F.when(F.isnan(v), 2).when(v == math.inf, 1).when(v == -math.inf, -1).otherwise(0)


def order_statistics(df: DataFrame, ranks) -> dict[tuple, float]:
    """``(column, rank) -> value`` for the ranks (from 0) that ``ranks(column, number of values)`` asks for.

    ``df`` has numeric columns only, the ones to look at.
    """
    columns = df.columns
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    long = df.select(F.inline(pairs)).filter(F.col("v").isNotNull())
    counts: dict = {c: {} for c in columns}
    for r in long.groupBy("c", _kind(F.col("v")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
        counts[r["c"]][r["kind"]] = (r["n"], r["lo"], r["hi"])
    found: dict[tuple, float] = {}
    open_: dict[tuple, list] = {}  # (column, rank) -> [rank within the range, least, greatest, rows]
    for c in columns:
        for rank in set(ranks(c, sum(n for n, _, _ in counts[c].values()))):
            left = rank
            for kind in sorted(counts[c]):
                n, lo, hi = counts[c][kind]
                if left < n:
                    if kind:
                        found[c, rank] = SPECIAL[kind]
                    else:
                        open_[c, rank] = [left, lo, hi, n]
                    break
                left -= n
    finite = long.filter(_kind(F.col("v")) == 0)
    while open_:
        for key in [k for k, (_, lo, hi, _) in open_.items() if lo == hi]:
            found[key] = open_.pop(key)[1]
        ranges = {(c, lo, hi): n for (c, _), (_, lo, hi, n) in open_.items()}  # ranks of one range are refined together
        if not ranges:
            break
        names = {r: i for i, r in enumerate(ranges)}
        inside = lambda c, lo, hi: (F.col("c") == c) & F.col("v").between(lo, hi)
        share = lambda lo, hi: (F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2)
        bin_of = lambda r: F.least(F.floor(share(*r[1:]) * BINS), F.lit(BINS - 1)).cast("int")
        few = [r for r, n in ranges.items() if n <= FEW or r[2] / 2 - r[1] / 2 == 0]
        many = [r for r in ranges if r not in few]
        values: dict = {}
        if few:
            hits = F.array_compact(F.array(*[F.when(inside(*r), F.lit(names[r])) for r in few]))
            for r in finite.select("v", F.explode(hits).alias("r")).groupBy("r", "v").agg(F.count(F.lit(1)).alias("n")).collect():
                values.setdefault(r["r"], []).append((r["v"], r["v"], r["n"]))
        if many:
            hits = F.array_compact(F.array(*[F.when(inside(*r), F.struct(F.lit(names[r]).alias("r"), bin_of(r).alias("b"))) for r in many]))
            parts = (finite.select("v", F.inline(hits)).groupBy("r", "b")
                     .agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")))
            for r in parts.collect():
                values.setdefault(r["r"], []).append((r["lo"], r["hi"], r["n"]))
        for state in values.values():
            state.sort()
        for (c, _), state in open_.items():
            for lo, hi, n in values[names[c, state[1], state[2]]]:
                if state[0] < n:
                    state[1:] = lo, hi, n
                    break
                state[0] -= n
    return found


def quantiles(df: DataFrame, wanted: dict[str, list[float]], rule: str = "linear") -> dict[str, list[float | None]]:
    """The quantiles of each column; ``rule``: ``linear`` (between the two nearest ranks) or ``floor`` (the rank below).

    A column without values has None.
    """
    sizes: dict[str, int] = {}

    def ranks(column, n):
        sizes[column] = n
        places = [q * (n - 1) for q in wanted[column]] if n else []
        return [int(f(p)) for p in places for f in ((math.floor, math.ceil) if rule == "linear" else (math.floor,))]

    found = order_statistics(df.select(*wanted), ranks)

    def value(column, q):
        place = q * (sizes[column] - 1)
        low, high = math.floor(place), math.ceil(place)
        a = found[column, low]
        if rule == "floor" or low == high or found[column, high] == a:
            return a
        return (high - place) * a + (place - low) * found[column, high]

    return {c: [value(c, q) if sizes.get(c) else None for q in qs] for c, qs in wanted.items()}


def one_row(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """A table of one row with the given doubles."""
    return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(c) for c, v in values.items()])
