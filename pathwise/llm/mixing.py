"""Operator 3: mixing sources to target weights (DataFrame functions only).

Every document gets a hash-random key.  The rows of a source are sorted by
range of that key (its leading digits), a distributed prefix sum of sizes runs
along the order, and the source is cut at its exact budget: whole epochs
first, then the documents at the head of the order, the last one in part.

Edge cases: NULL text has size 0 and is never taken; NULL source is a source
of its own, ordered last; NULL or repeated doc_ids are separate rows, ordered
by size; an empty table gives an empty result; a source without words has target 0.
Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathwise.llm.common import exclusive_prefix, table, word_count, written
from pathwise.llm.registry import register

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per source (``src_null``, ``src``): ``source_size`` and ``target``.

    ``share`` times all sizes is dealt out by weight; no source gets over ``cap``
    times its size.  Sorted by cap per unit of weight, the capped sources are a
    prefix, so one pass of window sums finds the level at which the rest settle.
    The windows run over one row per source.
    """
    per = sizes.groupBy("src_null", "src").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("__i", F.row_number().over(Window.orderBy("src_null", "src")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__i") % len(weights) + 1).cast("int"))
    per = (per.withColumn("weight", weight)
           .withColumn("__cap", F.col("source_size").cast("double") * cap)
           .withColumn("__ratio", F.col("__cap") / F.col("weight")))
    everything = Window.orderBy("__ratio", "__i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.orderBy("__ratio", "__i").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("__ratio", "__i").rowsBetween(0, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(everything) * share - F.coalesce(F.sum("__cap").over(earlier), F.lit(0.0)))
             / F.sum("weight").over(onward))
    per = per.withColumn("__level", level)
    settled = F.max(F.when(F.col("__ratio") > F.col("__level"), F.col("__level"))).over(everything)
    return (per.withColumn("__settled", settled)
            .withColumn("target", F.when(F.col("__ratio") <= F.col("__level"), F.col("__cap"))
                        .otherwise(F.col("__settled") * F.col("weight")))
            .select("src_null", "src", "source_size", "target"))


def sized_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``doc`` (all columns of a row, so none can clash), ``doc_id`` and what the mix needs:
    ``__null, __src, __size, __key, __bucket``."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select(
        F.struct(*docs.columns).alias("doc"), "doc_id", F.col("source").isNull().cast("int").alias("__null"),
        F.coalesce("source", F.lit("")).alias("__src"), word_count(F.col("text")).alias("__size"), key.alias("__key"),
        F.substring(key, 1, 3).alias("__bucket"))


def _cut(rows: DataFrame, sizes: DataFrame, weights, share: float, cap: int) -> DataFrame:
    """Add ``__source_size, __target, __epochs`` and ``__part``, the words taken beyond whole epochs, to ``rows``."""
    keys = ["__null", "__src"]
    targets = source_targets(sizes.select(F.col("__null").alias("src_null"), F.col("__src").alias("src"),
                                          F.col("__size").alias("size")), weights, share, cap)
    targets = targets.toDF(*keys, "__source_size", "__target")
    epochs = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(F.lit(0))
    targets = (targets.withColumn("__epochs", epochs.cast("long"))
               .withColumn("__budget", F.floor("__target").cast("long") - F.col("__epochs") * F.col("__source_size")))
    ordered = exclusive_prefix(rows, keys, "__bucket", ["__key", "doc_id", "__size"], "__size", "__before")
    return ordered.join(targets, keys).withColumn(
        "__part", F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__budget") - F.col("__before"))))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document.

    ``taken`` counts the words the mix takes of the document over all epochs; a source's sum is the
    whole part of its target.
    """
    sizes = written(sized_documents(docs, seed).drop("doc"), "mix-sizes")
    return _cut(sizes, sizes, weights, share, cap).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__epochs") * F.col("__size") + F.col("__part")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix in whole documents, all columns: every document as often as it is taken.

    The document at a source's cut counts if at least half of it is taken; one without words goes along
    with its place in the order.
    """
    sized = sized_documents(docs, seed)
    narrow = written(sized.select("__null", "__src", "__size"), "mix-sizes")
    last = F.when(F.col("__size") > 0, F.col("__part") * 2 >= F.col("__size")).otherwise(F.col("__before") < F.col("__budget"))
    return (_cut(sized, narrow, weights, share, cap)
            .withColumn("__copy", F.explode(F.array_repeat(F.lit(1), (F.col("__epochs") + last.cast("long")).cast("int"))))
            .select("doc.*"))


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, CAST(source IS NULL AS INT) AS src_null, coalesce(source, '') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
per AS (SELECT src_null, src, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1, 2),
weighed AS (
  SELECT *, CAST([3, 1, 2][CAST((i % 3) + 1 AS INT)] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 2 AS cap
  FROM (SELECT *, row_number() OVER (ORDER BY src_null, src) - 1 AS i FROM per) x),
leveled AS (
  SELECT *, cap / weight AS ratio,
    ((SELECT sum(source_size) FROM per) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT src_null, src, source_size, CASE WHEN ratio <= level THEN cap
    ELSE (SELECT max(level) FROM leveled WHERE ratio > level) * weight END AS target FROM leveled),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
ordered AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY src_null, src ORDER BY key, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT)
    AS taken
FROM ordered JOIN cut USING (src_null, src)
"""


@register("op3_mix_sources", OP3_SQL)
def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Operator 3 over all documents."""
    return mix(table(spark, sf_dir, "documents"))
