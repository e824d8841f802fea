"""D9 in blocks: the same neighbours as Spark's own similarity join, copies and missing vectors included."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from pathwise.operators import candidates as D
from pathwise.operators import lsh


def joined(items, k, **kw):
    """Each vector's k nearest of the similarity join's pairs."""
    w = Window.partitionBy("a").orderBy("dist", "b")
    pairs = D.lsh_neighbours(items, "id", "vec", **kw).withColumn("rnk", F.row_number().over(w).cast("int"))
    return sorted(map(tuple, pairs.filter(F.col("rnk") <= k).collect()))


def test_blocks_find_what_the_join_finds(spark, monkeypatch):
    monkeypatch.setattr(lsh, "MEASURED", 50)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(260)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(7, rows[7][1]), (8, rows[9][1]), (2000, [0.0] * 8)]
    items = spark.createDataFrame(rows, "id long, vec array<double>").repartition(5)
    kw = {"threshold": 0.9, "bucket_length": 0.4, "num_tables": 3}
    want = joined(items, 4, **kw)
    assert len(want) > 500
    assert sorted(map(tuple, D.lsh_neighbours(items, "id", "vec", k=4, **kw).collect())) == want


def test_missing_vectors_have_no_neighbours(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [1.0, None]), (None, [1.0, 0.0]), (5, [float("nan"), 1.0])]
    items = spark.createDataFrame(rows, "id long, vec array<double>")
    got = D.lsh_neighbours(items, "id", "vec", threshold=1.0, bucket_length=4.0, num_tables=2, k=3)
    assert [(r.a, r.b, r.rnk) for r in got.orderBy("a", "b").collect()] == [(1, 2, 1), (2, 1, 1)]
    assert D.lsh_neighbours(items.filter("id = 3"), "id", "vec", threshold=1.0, k=3).count() == 0


def test_pairs_of_blocks_are_not_shuffled(spark):
    items = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], "id long, vec array<double>")
    got = D.lsh_neighbours(items, "id", "vec", threshold=1.0, bucket_length=4.0, k=3)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
