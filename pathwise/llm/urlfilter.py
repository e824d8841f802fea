"""Operator 13: URL filter rules (DataFrame functions only).

A rule is a host and a path prefix with a verdict.  It fits a URL whose host is the rule's or a subdomain of
it and whose path starts with the rule's path.  No URL is held against the rule list:

1. Every URL is expanded into expressions, a suffix of its host (whole labels) with a prefix of its path.  Only the
   (labels, path length) shapes that some rule has are made.
2. Expressions and rules meet in an equi-join on the first ``PREFIX`` hex digits of their SHA-256 digests.  Rules
   are repeated ``SALTS`` times and every URL takes one salt, so a rule that a large share of all URLs meets is
   spread over tasks where Spark doesn't broadcast the rules.
3. Whole digests confirm a meeting.  The longest rule wins (host and path together, then host); of equal rules
   the strictest, ``block``, wins.

The shapes reach the driver: at most one for each pair of a label count (127 by the DNS) and a path length among the rules.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased, a port or user included.  Path: from
there up to ``?``, ``#`` or the end.

Edge cases: a URL that is NULL or has no ``://`` has an empty host and path and gets the default verdict; rules
with a NULL or empty host, or a NULL verdict, never fit, a NULL rule path is empty; repeated pages are judged row by row;
without rules every page gets the default; an empty table gives an empty result; columns other than ``page_id``
and ``url`` are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwise.llm.common import table, written
from pathwise.llm.registry import register

#: Hex digits of a digest that the join goes by.
PREFIX = 8
#: Copies of every rule; a rule's meetings are spread over as many tasks.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"
#: The query's rules: host, path, verdict (fixed values of the contract).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """``host, path, verdict`` rows of a rule list."""
    if not rules:
        return spark.range(0).select(*[F.lit(None).cast("string").alias(c) for c in ("host", "path", "verdict")])
    rows = [F.struct(*[F.lit(v).cast("string").alias(c) for c, v in zip(("host", "path", "verdict"), r)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: Column) -> Column:
    return F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(host: Column, path: Column) -> Column:
    """The host's length keeps host and path apart."""
    return F.sha2(F.concat_ws(":", F.char_length(host).cast("string"), F.concat(host, path)), 256)


def _rules(rules: DataFrame) -> DataFrame:
    host, path = F.translate(F.col("host"), UPPER, LOWER), F.coalesce(F.col("path"), F.lit(""))
    one = (rules.filter((F.col("host") != "") & F.col("verdict").isNotNull())
           .select(host.alias("r_host"), path.alias("r_path"), "verdict")
           .groupBy("r_host", "r_path").agg(F.max_by("verdict", F.struct(F.col("verdict") == "block", "verdict")).alias("r_verdict")))
    return one.select(_digest(F.col("r_host"), F.col("r_path")).alias("r_digest"), "r_host", "r_path", "r_verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url)``.

    ``rule`` is the host and path of the rule that decides, NULL where none fits.
    """
    spark = pages.sparkSession
    host, path = url_host_path(F.col("url"))
    # a written row number lets the expressions of one row come together again after the join
    rows = written(pages.select("page_id", host.alias("host"), path.alias("path"),
                                F.monotonically_increasing_id().alias("row")), "urls")
    rules = written(_rules(rules), "url-rules")
    shapes = [(r.labels, r.chars) for r in rules.select(_labels(F.col("r_host")).alias("labels"),
                                                        F.char_length("r_path").alias("chars")).distinct().collect()]
    made = [F.when((_labels(F.col("host")) >= n) & (F.char_length("path") >= k),
                   _digest(F.substring_index("host", ".", -n), F.substring("path", 1, k))) for n, k in sorted(shapes)]
    # every row also keeps one expression that meets no rule, so rows without a match stay
    digests = F.concat(F.array(F.lit("")), F.array_compact(F.array(*made))) if made else F.array(F.lit(""))
    wanted = (rows.select("*", F.explode(digests).alias("digest"))
              .withColumn("short", F.substring("digest", 1, PREFIX))
              .withColumn("salt", (F.col("row") % SALTS).cast("int")))
    salted = (rules.withColumn("short", F.substring("r_digest", 1, PREFIX))
              .select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    best = F.max(F.when(F.col("digest") == F.col("r_digest"), F.struct(
        (F.char_length("r_host") + F.char_length("r_path")).alias("chars"), F.char_length("r_host").alias("host_chars"),
        F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))))
    return (wanted.join(salted, ["short", "salt"], "left")
            .groupBy("row", "page_id", "host", "path").agg(best.alias("best"))
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_SQL = f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {_VALUES}),
cut AS (SELECT page_id, row_number() OVER () AS n,
               CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT page_id, n, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM cut),
fits AS (SELECT n, arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
                arg_max(r_verdict, length(r_host || r_path)) AS verdict
         FROM urls JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
         GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM urls LEFT JOIN fits USING (n)
"""


@register("op13_url_filter", _SQL)
def op13_url_filter(spark, sf_dir: str) -> DataFrame:
    """Operator 13 over all pages under the contract's five rules."""
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))
