"""Helpers shared by the numbered operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathwise.session import scratch_path

#: A word: a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that go to Python at a time.  Texts go whole, so the engine's default of 10,000 would hold tens of megabytes per worker
#: several times over.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The copy cuts the lineage: a lost executor re-reads files instead of
    running the stages before it again, and several consumers share one pass.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy.written_to = path
    return copy


def discard(*copies: DataFrame) -> None:
    """Delete tables that :func:`written` has made and nothing reads any more; others stay."""
    for copy in copies:
        if path := getattr(copy, "written_to", None):
            spark = copy.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def id_text(name: str) -> Column:
    """A whole-number id as text, for the way through pandas.

    A nullable long reaches pandas as float64 as soon as a batch holds a NULL, which rounds ids beyond 2^53;
    text stays exact.  :func:`ids_back` undoes it.
    """
    return F.col(name).cast("long").cast("string").alias(name)


def ids_back(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast("long"))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exclusive_prefix(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one within ``keys``.

    ``bucket`` must be a non-null column that ascends with ``order``; a key's rows are
    summed and sorted per bucket, so a hot key spreads over as many tasks as it
    has buckets and no task holds a whole key.  ``keys`` must be non-null.  ``df``
    is read twice: pass a written table.
    """
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (df.groupBy(*keys, bucket).agg(F.sum(value).alias("__sum"))
               .select(*keys, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset")))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(offsets, [*keys, bucket])
            .withColumn(out, F.col("__offset") + F.col("__inside"))
            .drop("__offset", "__inside"))
