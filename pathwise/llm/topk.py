"""Operator 6: exact top-k inner-product search by MaxScore.

A term is a dimension; a vector's weight for it is an integer.  The vectors are
cut into shards of bounded size, each stored as postings by term (a matrix
with one column per term) with the least and the greatest weight of every term.
For a query and a shard the term bounds follow from those two.  With the score
of the k-th best document so far as threshold, the terms of the smallest spreads are
non-essential as long as all of them together cannot lift a document that
is worst in the essential terms over the threshold.  The essential
postings are traversed for all documents of the shard; the others are probed, widest first, only for
documents whose bound still reaches the threshold.  A task visits the shards of a group one after the other and
carries every query's k best along, so a later shard starts from their threshold and is skipped
where its bound lies below it.  Groups are merged by rank.

Queries go to all shards in blocks: blocks of queries meet blocks of vectors
by an equi-join on shard groups, never row by row.

Edge cases: vectors that are NULL or hold NULL or non-finite components, and rows
without vec_id, take no part; a shorter vector counts as padded with zeros;
repeated rows compete separately, and repeated query rows are queries of their own, each with its k rows; with
``row_col`` (a number that is a row's own in both tables) a query skips its own row only, without it every row of its own
id; fewer than k candidates give fewer rows; an empty table gives an empty result.
Scores are exact as long as they fit a long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathwise.llm.common import table, written
from pathwise.llm.registry import register

#: Vectors per shard and queries per block: they bound a task's memory.
SHARD_ROWS = 8192
QUERY_ROWS = 512
#: Shards per group; a block of queries is sent once to every group.
GROUP_SHARDS = 8


def blocks(vectors: DataFrame, id_col: str, vec_col: str, scale: int, rows: int, row_col: str | None = None) -> DataFrame:
    """``block long, n int, dims int, ids binary, keys binary, mat binary``: at most ``rows`` vectors each, made
    where the rows lie, without a shuffle.  ``keys`` are the values of ``row_col``, else the rows' places."""

    def run(frames):
        held, n, seq = [], 0, 0
        part = TaskContext.get().partitionId()

        def packed(pieces, seq):
            ids = np.concatenate([i for i, _, _ in pieces])
            keys = np.concatenate([x for _, x, _ in pieces])
            dims = max(m.shape[1] for _, _, m in pieces)
            mat = np.concatenate([np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for _, _, m in pieces])
            block = part * (1 << 32) + seq
            if row_col is None:
                keys = block * rows + np.arange(len(ids))
            return {"block": [block], "n": [len(ids)], "dims": [dims], "ids": [ids.astype("<i8").tobytes()],
                    "keys": [keys.astype("<i8").tobytes()], "mat": [mat.astype("<i8").tobytes()]}

        for frame in frames:
            ids, keys, vecs = [], [], []
            for i, key, v in zip(frame["id"], frame["key"], frame["vec"]):
                v = np.asarray(v, dtype=np.float64)  # NULL components become NaN
                if np.isfinite(v).all():
                    ids.append(int(i))
                    keys.append(int(key))
                    vecs.append(np.floor(v * scale).astype(np.int64))
            for at in range(0, len(ids), rows):
                some = vecs[at:at + rows]
                dims = max(len(v) for v in some)
                mat = np.zeros((len(some), dims), dtype=np.int64)
                for r, v in enumerate(some):
                    mat[r, :len(v)] = v
                if n + len(some) > rows:
                    yield pd.DataFrame(packed(held, seq))
                    held, n, seq = [], 0, seq + 1
                held.append((np.asarray(ids[at:at + rows], dtype=np.int64), np.asarray(keys[at:at + rows], dtype=np.int64), mat))
                n += len(some)
        if held:
            yield pd.DataFrame(packed(held, seq))

    key = F.col(row_col).cast("long") if row_col else F.lit(0).cast("long")
    picked = (vectors.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.col(vec_col).cast("array<double>").alias("vec"))
              .filter(F.col("id").isNotNull() & F.col("vec").isNotNull()))
    return picked.mapInPandas(run, "block long, n int, dims int, ids binary, keys binary, mat binary")


class Shard:
    """Postings of a block of vectors: one row of weights per term, with bounds."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, mat: np.ndarray):
        self.ids, self.keys = ids, keys
        self.least, self.most = mat.min(axis=0), mat.max(axis=0)
        self.peak = max(abs(int(self.least.min(initial=0))), abs(int(self.most.max(initial=0))))
        self.exact = mat.T.copy()
        self.floats: dict = {}

    def weights(self, largest: int) -> np.ndarray:
        """The narrowest numbers in which sums up to ``largest`` are exact."""
        kind = np.float32 if largest < 2 ** 23 else np.float64 if largest < 2 ** 52 else None
        if kind is None:
            return self.exact
        if kind not in self.floats:
            self.floats[kind] = self.exact.astype(kind)
        return self.floats[kind]

    def top(self, q: np.ndarray, own: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best outside ``own`` (a mask), ties to smaller ids; those below ``floor`` may be left out."""
        terms = min(len(q), len(self.least))
        q = q[:terms]
        weights = self.weights(terms * self.peak * int(np.abs(q).max(initial=0)))
        bound = np.maximum(q * self.least[:terms], q * self.most[:terms]).sum()
        if floor is not None and bound < floor:
            return self.ids[:0], np.zeros(0, dtype=np.int64)
        q = q.astype(weights.dtype)
        a, b = q * self.least[:terms], q * self.most[:terms]
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.argsort(low - high, kind="stable")  # widest spread first
        low, high = low[order], high[order]
        spread_left = np.append(np.cumsum((high - low)[::-1])[::-1], 0)
        high_left = np.append(np.cumsum(high[::-1])[::-1], 0)
        open_ = np.flatnonzero(~own)
        if not len(open_):
            return self.ids[:0], np.zeros(0, dtype=np.int64)

        def scores(docs, start, stop):
            own_terms = order[start:stop]
            part = weights[own_terms] if docs is None else weights[np.ix_(own_terms, docs)]
            return q[own_terms] @ part

        # a first threshold: the full scores of the documents that lead on the widest terms
        lead = min(terms, 8)
        partial = scores(None, 0, lead)[open_]
        threshold = floor
        if threshold is None:
            first = open_[np.argpartition(-partial, k - 1)[:k]] if len(open_) > k else open_
            threshold = np.sort(scores(first, 0, terms))[-k] if len(first) >= k else None
        if threshold is None:
            essential = terms
        else:
            # terms from `essential` on cannot together lift the least document over the threshold
            floor_ = low.sum()
            essential = int(np.argmax(floor_ + spread_left <= threshold))
            essential = max(essential, lead)
        partial = (partial if essential == lead else partial + scores(None, lead, essential)[open_])
        docs, at = open_, essential
        while threshold is not None and at < terms and len(docs):
            keep = partial + high_left[at] >= threshold
            docs, partial = docs[keep], partial[keep]
            stop = min(terms, at + 8)
            partial = partial + scores(docs, at, stop)
            if stop == terms:
                at = stop
                break
            # documents sure to reach more raise the threshold
            if len(docs) > k:
                sure = np.partition(partial, -k)[-k] + low[stop:].sum()
                threshold = max(threshold, sure)
            at = stop
        if at < terms:
            partial = partial + scores(docs, at, terms)
        best = np.lexsort((self.ids[docs], -partial))[:k]
        return self.ids[docs][best], partial[best].astype(np.int64)


def _matrix(n, dims, data) -> np.ndarray:
    return np.frombuffer(data, dtype="<i8").reshape(n, dims)


def top_k(queries: DataFrame, vectors: DataFrame, id_col: str, vec_col: str, k: int = 20, scale: int = 64,
          row_col: str | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best vectors of every query row."""
    q_blocks = written(blocks(queries, id_col, vec_col, scale, QUERY_ROWS, row_col), "topk-queries")
    v_blocks = written(blocks(vectors, id_col, vec_col, scale, SHARD_ROWS, row_col), "topk-shards")
    groups = max(1, -(-v_blocks.count() // GROUP_SHARDS))
    v_blocks = v_blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    q_blocks = (q_blocks.toDF(*[f"q_{c}" for c in q_blocks.columns])
                .withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))))

    def run(frames):
        at, best = None, []  # a block of queries in a group, and the best ids and scores of each query so far
        for frame in frames:
            for r in frame.itertuples(index=False):
                if at is None or at[:2] != (r.q_block, r.group):
                    if at is not None:
                        yield found(at[2], best)
                    q_ids, q_keys = np.frombuffer(r.q_ids, dtype="<i8"), np.frombuffer(r.q_keys, dtype="<i8")
                    at = (r.q_block, r.group, (q_ids, q_keys))
                    best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(q_ids)
                    q_mat = _matrix(r.q_n, r.q_dims, r.q_mat)
                shard = Shard(np.frombuffer(r.ids, dtype="<i8"), np.frombuffer(r.keys, dtype="<i8"), _matrix(r.n, r.dims, r.mat))
                for i, q in enumerate(q_mat):
                    own = shard.keys == q_keys[i] if row_col else shard.ids == q_ids[i]
                    ids, scores = shard.top(q, own, k, int(best[i][1][-1]) if len(best[i][1]) == k else None)
                    if len(ids):
                        ids, scores = np.concatenate([best[i][0], ids]), np.concatenate([best[i][1], scores])
                        order = np.lexsort((ids, -scores))[:k]
                        best[i] = ids[order], scores[order]
        if at is not None:
            yield found(at[2], best)

    def found(queries_, best):
        sizes = [len(ids) for ids, _ in best]
        return pd.DataFrame({"query_key": np.repeat(queries_[1], sizes), "query_id": np.repeat(queries_[0], sizes),
                             "vec_id": np.concatenate([ids for ids, _ in best]), "score": np.concatenate([x for _, x in best])})

    pairs = q_blocks.join(v_blocks, "group").repartition("q_block", "group").sortWithinPartitions("q_block", "group", "block")
    best = (pairs.select("q_block", "group", "q_n", "q_dims", "q_ids", "q_keys", "q_mat", "n", "dims", "ids", "keys", "mat")
            .mapInPandas(run, "query_key long, query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rnk AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rnk FROM s) x WHERE rnk <= 20
"""


@register("op6_maxscore_top_k", OP6_SQL)
def op6_maxscore_top_k(spark, sf_dir: str) -> DataFrame:
    """Operator 6: every vec_id divisible by 20 against all other embeddings."""
    vectors = written(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.monotonically_increasing_id().alias("row")),
                      "topk-rows")
    return top_k(vectors.filter(F.col("vec_id") % 20 == 0), vectors, "vec_id", "embedding", row_col="row")
