"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwise.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges(a, b)``: ``comp`` is the least node of its component.

    Every round a node takes the least label among its neighbours and then its
    label's label, so labels travel along doubling distances.  Each
    round is written to the shared folder, which cuts the lineage.  Hot nodes are
    pre-aggregated on the map side.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .filter(F.col("a") != F.col("b")).distinct(), "edges")
    labels = last = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("near")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near")))
        hooked = labels.join(near, "node").select("node", F.least("comp", "near").alias("next"), "comp")
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("jump"))
        step = written(hooked.join(jump, "next", "left")
                       .select("node", F.least("next", F.coalesce("jump", "next")).alias("next"), "comp"), "labels")
        moved = step.filter(F.col("next") != F.col("comp")).limit(1).count()
        discard(last)
        labels, last = step.select("node", F.col("next").alias("comp")), step
        labels.written_to = step.written_to
        if not moved:
            discard(both)
            return labels
