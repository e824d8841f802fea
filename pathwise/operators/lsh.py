"""The k nearest among vectors that share a bucket (D9), in blocks.

Rows are sorted by their buckets and packed into blocks; two blocks meet if a bucket range of theirs overlaps.  The pairs of
blocks are never shuffled or written; a pair is scored as one matrix product, a query looks for nothing farther than the k-th
neighbour it has found so far, and only each query's k best leave the task.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathwise.session import scratch_path

BLOCK_ROWS = 2048
#: Blocks that one partition holds, and pairs that are measured at once.
PART_BLOCKS = 32
MEASURED = 65_536
FOUND = "a long, b long, dist double"


class _Best:
    """The ``k`` nearest found so far of a block of queries, nearer than ``threshold`` (ties by id)."""

    def __init__(self, ids, mat, buckets, k, threshold):
        self.ids, self.mat, self.buckets, self.k, self.threshold = ids, mat, buckets, k, threshold
        self.norms = (mat * mat).sum(axis=1)
        self.limit = np.full(len(ids), threshold * threshold)
        self.at, self.to, self.dist = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)

    def _first(self, order, at):
        """The first ``k`` of each query in ``order``, which sorts by query."""
        at = at[order]
        return order[np.arange(len(at)) - np.searchsorted(at, at, side="left") < self.k]

    def _measured(self, at, to, mat):
        """Distances summed component by component, as Spark's own distance is."""
        out = np.zeros(len(at))
        for i in range(0, len(at), MEASURED):
            gap = self.mat[at[i:i + MEASURED]] - mat[to[i:i + MEASURED]]
            for j in range(gap.shape[1]):
                out[i:i + MEASURED] += gap[:, j] * gap[:, j]
        return np.sqrt(out)

    def _share(self, at, to, buckets):
        parts = [(self.buckets[at[i:i + MEASURED]] == buckets[to[i:i + MEASURED]]).any(axis=1) for i in range(0, len(at), MEASURED)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=bool)

    def meet(self, ids, mat, buckets):
        rough = self.norms[:, None] + (mat * mat).sum(axis=1)[None, :] - 2.0 * (self.mat @ mat.T)
        slack = 1e-9 * (1.0 + self.limit)  # what lies within rounding error of the limit is measured again
        at, to = np.nonzero(rough <= (self.limit + slack)[:, None])
        kept = self.ids[at] != ids[to]
        at, to = at[kept], to[kept]
        kept = self._share(at, to, buckets)
        at, to = at[kept], to[kept]
        value = rough[at, to]
        order = np.lexsort((value, at))
        ranks = np.arange(len(at)) - np.searchsorted(at[order], at[order], side="left")
        last = np.full(len(self.ids), np.inf)
        kth = order[ranks == self.k - 1]
        last[at[kth]] = value[kth]
        kept = value <= last[at] + slack[at]
        at, to = at[kept], to[kept]
        dist = self._measured(at, to, mat)
        kept = dist < self.threshold
        self.at, self.to = np.concatenate([self.at, at[kept]]), np.concatenate([self.to, ids[to[kept]]])
        self.dist = np.concatenate([self.dist, dist[kept]])
        kept = self._first(np.lexsort((self.to, self.dist, self.at)), self.at)
        self.at, self.to, self.dist = self.at[kept], self.to[kept], self.dist[kept]
        full = np.bincount(self.at, minlength=len(self.ids)) >= self.k
        last = np.searchsorted(self.at, np.arange(len(self.ids)), side="right") - 1
        self.limit[full] = self.dist[last[full]] ** 2

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"a": self.ids[self.at], "b": self.to, "dist": self.dist})


def _pack(rows: int):
    def pack(frames):
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def packed(some):
            ids, vecs, buckets = zip(*some)
            buckets = np.stack(buckets).astype("<i8")
            return pd.DataFrame({"block": [part * (1 << 32) + seq], "ids": [np.asarray(ids, dtype="<i8").tobytes()],
                                 "mat": [np.stack(vecs).astype("<f8").tobytes()], "buckets": [buckets.tobytes()],
                                 "lo": [buckets.min(axis=0)], "hi": [buckets.max(axis=0)]})

        for frame in frames:
            for row in zip(frame["id"], frame["vec"], frame["buckets"]):
                held.append(row)
                if len(held) == rows:
                    yield packed(held)
                    seq, held = seq + 1, []
        if held:
            yield packed(held)
    return pack


def bucket_neighbours(rows: DataFrame, k: int, threshold: float, tables: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(a, b, dist, rnk)``: each row's ``k`` nearest among those that share one of its ``tables`` buckets and lie nearer than
    ``threshold``.  ``rows``: id long, vec array<double>, buckets array<long>; a repeated (id, vec) counts once.
    """
    run_dir = scratch_path(rows.sparkSession, f"lsh/{uuid.uuid4().hex}")

    def written(df, name):
        path = os.path.join(run_dir, name)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    rows = written(rows.filter(F.col("id").isNotNull()).dropDuplicates(["id", "vec"]), "rows")
    n = rows.count()
    size = max(1, min(block_rows, max(256, -(-n // 32))))

    def blocks(df, name):
        count = -(-n // size)
        placed = df.repartitionByRange(max(1, min(count, 8), count // PART_BLOCKS), "buckets", "id")
        return written(placed.sortWithinPartitions("buckets", "id").mapInPandas(
            _pack(size), "block long, ids binary, mat binary, buckets binary, lo array<long>, hi array<long>"), name)

    # of equal vectors only the k + 1 smallest ids can be among anyone's k nearest
    same = Window.partitionBy("vec").orderBy("id")
    points = blocks(rows.withColumn("__n", F.row_number().over(same)).filter(F.col("__n") <= k + 1).drop("__n"), "points")
    queries = blocks(rows, "queries").toDF(*[f"q_{c}" for c in points.columns])

    def unpacked(r, side=""):
        ids = np.frombuffer(r[side + "ids"], dtype="<i8")
        return (ids, np.frombuffer(r[side + "mat"], dtype="<f8").reshape(len(ids), -1),
                np.frombuffer(r[side + "buckets"], dtype="<i8").reshape(len(ids), -1))

    def score(frames):
        block, best = None, None
        for frame in frames:
            for r in frame.to_dict("records"):
                if r["q_block"] != block:  # a task reads a block of queries with all its blocks of points in a row
                    if best is not None:
                        yield best.rows()
                    block, best = r["q_block"], _Best(*unpacked(r, "q_"), k, threshold)
                best.meet(*unpacked(r))
        if best is not None:
            yield best.rows()

    overlap = [(F.col("lo")[i] <= F.col("q_hi")[i]) & (F.col("q_lo")[i] <= F.col("hi")[i]) for i in range(tables)]
    pairs = queries.hint("shuffle_replicate_nl").join(points, reduce(lambda x, y: x | y, overlap))
    found = pairs.select("q_block", "q_ids", "q_mat", "q_buckets", "ids", "mat", "buckets").mapInPandas(score, FOUND)
    w = Window.partitionBy("a").orderBy("dist", "b")
    return found.withColumn("rnk", F.row_number().over(w).cast("int")).filter(F.col("rnk") <= k)
