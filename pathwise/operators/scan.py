"""Running totals that a hot key does not hold up.

A window over a key sorts all its rows in one task.  Here a key of more than ``LIMIT`` rows is cut into ranges of time of about
``LIMIT`` rows each: rows are summed up to each other within a range, the ranges' totals are summed up over the key (a
few rows per hot key), and what came before a range is added to its rows.  "Last non-null" is carried over ranges likewise.
Small keys are one range.  The result is the same whatever the ranges are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key that one task takes.
LIMIT = 100_000


def running_totals(df: DataFrame, key: str, ts: str, tie: str, sums: dict[str, Column], last: dict[str, Column],
                   limit: int | None = None) -> DataFrame:
    """Add the running ``sums`` and the ``last`` non-null values up to and with each row of ``key``, by (``ts``, ``tie``).

    Rows without time come last.  Rows of equal time and tie stand in either order.
    """
    limit = LIMIT if limit is None else limit
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    names = [*sums, *last]
    rows = df.select("*", t.alias("__t"), *[c.cast("long").alias(f"__v_{n}") for n, c in sums.items()],
                     *[c.alias(f"__v_{n}") for n, c in last.items()])
    hot = (rows.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"), F.min("__t").alias("__lo"), F.max("__t").alias("__hi"))
           .filter(F.col("__n") > limit)
           .select("__key", "__lo", F.greatest(F.floor((F.col("__hi") - F.col("__lo")) * limit / F.col("__n")), F.lit(1)).alias("__width")))
    cut = F.coalesce(F.floor((F.col("__t") - F.col("__lo")) / F.col("__width")), F.lit(2 ** 62)).cast("long")
    rows = (rows.join(hot, F.col(key).eqNullSafe(F.col("__key")), "left")
            .withColumn("__range", F.when(F.col("__width").isNull(), F.lit(0).cast("long")).otherwise(cut))
            .withColumn("__hot", F.col("__width").isNotNull()).drop("__key", "__lo", "__width"))

    place = F.struct(F.col("__t").isNull(), F.col("__t"), F.col(tie))
    totals = rows.filter("__hot").groupBy(F.col(key).alias("__key"), F.col("__range").alias("__r")).agg(
        *[F.sum(f"__v_{n}").alias(n) for n in sums],
        *[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), place)).alias(n) for n in last])
    before = Window.partitionBy("__key").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__key", "__r", *[F.sum(n).over(before).alias(f"__b_{n}") for n in sums],
                            *[F.last(n, ignorenulls=True).over(before).alias(f"__b_{n}") for n in last])
    inside = Window.partitionBy(key, "__range").orderBy(F.col("__t").asc_nulls_last(), tie).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("*", *[F.sum(f"__v_{n}").over(inside).alias(f"__o_{n}") for n in sums],
                      *[F.last(f"__v_{n}", ignorenulls=True).over(inside).alias(f"__o_{n}") for n in last])
    met = own.join(offsets, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__r")), "left")
    return met.select(*[F.col(f"`{c}`") for c in df.columns if c not in names],
                      *[(F.coalesce(f"__o_{n}", F.lit(0)) + F.coalesce(f"__b_{n}", F.lit(0))).alias(n) for n in sums],
                      *[F.coalesce(f"__o_{n}", f"__b_{n}").alias(n) for n in last])
