"""Ranking and re-ranking.

Candidates are long tables keyed by a request column; every ordering has a
total tie-break (input rank, then item) and every top-k is ``row_number``
over the request partition, which Spark prunes with WindowGroupLimit.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathwise.functions import constants as K
from pathwise.functions.expressions import clip, col, contains_any, dot, first_token


def numbered(df: DataFrame, key: str, order: list[Column], out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("int"))


def top_k(df: DataFrame, key: str, order: list[Column], k: int, out: str = "final_rnk") -> DataFrame:
    return numbered(df, key, order, out).filter(F.col(out) <= k)


# ------------------------------------------------------------- E1 / E2
def ranking_features(df: DataFrame, item: str = "topic", rnk: str = "rnk") -> DataFrame:
    """Nine-feature ranking vector as columns f1..f9.

    Expects item columns ``embedding_similarity, recency_hours, popularity,
    freshness, difficulty_match`` (see D12) and user ``completion_rate, ctr`` (D13).
    """
    words = F.size(F.array_distinct(F.split(col(item), " ")))
    return df.select(
        "*",
        F.col("embedding_similarity").alias("f1"),
        (F.lit(1.0) / (F.lit(1.0) + F.log1p(F.col("recency_hours")))).alias("f2"),
        F.col("popularity").alias("f3"),
        F.col("completion_rate").alias("f4"),
        F.col("ctr").alias("f5"),
        F.col("freshness").alias("f6"),
        F.col("difficulty_match").alias("f7"),
        (F.lit(1.0) / F.greatest(words, F.lit(1))).alias("f8"),
        (F.lit(1.0) / F.greatest(col(rnk), F.lit(1))).alias("f9"))


def linear_rank_score(df: DataFrame, weights=None) -> DataFrame:
    """Weighted sum of f1..f9 (fallback ranker)."""
    w = weights or K.RANK_WEIGHTS
    s = None
    for i, wi in enumerate(w, start=1):
        t = F.lit(wi) * F.col(f"f{i}")
        s = t if s is None else s + t
    return df.withColumn("rank_score", s)


def rank_candidates(df: DataFrame, key: str, k: int, rnk: str = "rnk", item: str = "topic") -> DataFrame:
    """E1 + E2: score and keep top-k per request; ties keep the input order."""
    s = linear_rank_score(ranking_features(df, item, rnk))
    return top_k(s, key, [F.col("rank_score").desc(), F.col(rnk), F.col(item)], k)


# ------------------------------------------------------------------ E3
def hybrid_scores(content: DataFrame, collab: DataFrame, learners: DataFrame, key: str,
                  quiz_col: str = "quiz_score", foundation_tokens=("Basics", "Intro"),
                  extension_tokens=("Advanced", "Applications", "Analysis", "Multivariable", "Regression")
                  ) -> DataFrame:
    """Hybrid score of the merged list (content first, then collaborative).

    A topic absent from a list gets that list's length + 5 as its rank.
    Output: key, topic, merged_rnk, c_rank, u_rank, hybrid_score.
    """
    c = content.select(key, "topic", F.col("rnk").alias("c_rank"))
    # the collaborative list, which is dear, is read once: its length comes with its rows
    u = collab.select(key, "topic", F.col("rnk").alias("u_rank"), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("__nu"))
    nc = c.groupBy(key).agg(F.count(F.lit(1)).alias("__nc"))
    j = c.join(u, [key, "topic"], "full_outer").join(nc, key, "left")
    j = j.withColumn("__nu", F.when(F.col(key).isNotNull(), F.max("__nu").over(Window.partitionBy(key))))
    j = j.join(learners.select(key, quiz_col), key, "left")
    big = F.lit(10 ** 9)
    # merged order: content topics by content rank, then the rest by collaborative rank
    j = j.withColumn("__mo", F.when(F.col("c_rank").isNotNull(), F.col("c_rank"))
                     .otherwise(big + F.col("u_rank")))
    j = (j.withColumn("c_rank", F.coalesce(F.col("c_rank"), F.coalesce(F.col("__nc"), F.lit(0)) + 5))
         .withColumn("u_rank", F.coalesce(F.col("u_rank"), F.coalesce(F.col("__nu"), F.lit(0)) + 5)))
    readiness = F.least(F.greatest(F.col(quiz_col) / 100.0, F.lit(0.0)), F.lit(1.0))
    t = F.col("topic")
    found = contains_any(t, foundation_tokens)
    ext = contains_any(t, extension_tokens)
    bonus = F.when(found & (readiness < 0.7), 0.08).when(ext & (readiness >= 0.7), 0.08).otherwise(0.0)
    score = (F.lit(0.52) * (F.lit(1.0) / F.log2(F.greatest(F.col("c_rank"), F.lit(1)) + 1.0))
             + F.lit(0.38) * (F.lit(1.0) / F.log2(F.greatest(F.col("u_rank"), F.lit(1)) + 1.0))
             + F.lit(0.10) * readiness + bonus)
    w = Window.partitionBy(key).orderBy("__mo")
    return j.select(key, "topic", F.row_number().over(w).cast("int").alias("merged_rnk"),
                    F.col("c_rank").cast("int").alias("c_rank"), F.col("u_rank").cast("int").alias("u_rank"),
                    score.alias("hybrid_score"))


# ------------------------------------------------------------------ E4
def diversity_rerank(ranked: DataFrame, key: str, top_k_: int, pos: str = "pos",
                     anchors: DataFrame | None = None, item: str = "topic") -> DataFrame:
    """Diversity / novelty re-rank in closed form.

    Greedy rule: keep a topic if its prefix (text before the first space) is
    unseen or fewer than q = max(2, k // 3) are kept; pad in order; put the
    content anchor first if absent.  Equivalent: pass0 = pos <= q or first
    occurrence of the prefix; order by (pass, pos), keep k; then the anchor.
    ``anchors`` = (key, anchor topic) or None.
    """
    q = max(2, top_k_ // 3)
    pref = first_token(item)
    wp = Window.partitionBy(key, "__pref").orderBy(pos)
    t = ranked.withColumn("__pref", pref).withColumn("__first", F.row_number().over(wp) == 1)
    t = t.withColumn("__pass", F.when((F.col(pos) <= q) | F.col("__first"), 0).otherwise(1))
    sel = top_k(t, key, [F.col("__pass"), F.col(pos)], top_k_, "__sel")
    sel = sel.select(key, item, F.col("__sel").alias("out_rnk"))
    if anchors is None:
        return sel
    # anchors stand at 0, and go where the list has one of them
    u = sel.unionByName(anchors.select(key, item, F.lit(0).alias("out_rnk")))
    listed, per = F.col("out_rnk") > 0, Window.partitionBy(key)
    u = u.withColumn("__anchors", F.collect_set(F.when(~listed, F.col(item))).over(per))
    has = F.col(key).isNotNull() & listed & F.array_contains("__anchors", F.col(item))
    u = u.withColumn("__has", F.max(F.coalesce(has, F.lit(False))).over(per)).filter(listed | ~F.col("__has"))
    return top_k(u.select(key, item, "out_rnk"), key, [F.col("out_rnk")], top_k_, "rerank_rnk").drop("out_rnk")


# ------------------------------------------------------------------ E5
CONTEXT_DIM = 9
# what the state sums: products of two places of the context, and of a place and the reward (which stands behind them)
_TERMS = [(i, j) for i in range(CONTEXT_DIM) for j in range(i, CONTEXT_DIM + 1)]
_LAST_DECIMAL = Decimal("0.000000000001")
_DIGITS = Context(prec=60)


def bandit_context(df: DataFrame) -> Column:
    """9-dim bandit context with defaults (quiz/eng/cons scaled to 0..1)."""
    def d(c, v):
        return F.coalesce(F.col(c).cast("double"), F.lit(v)) if c in df.columns else F.lit(v)
    return F.array(F.lit(1.0), d("quiz_score", 50.0) / 100.0, d("engagement_score", 50.0) / 100.0,
                   d("consistency_score", 50.0) / 100.0, d("freshness", 0.5), d("difficulty_match", 0.5),
                   d("popularity", 0.3), d("sequence_score", 0.0), d("online_score", 0.0))


def _twelve_decimals(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``v`` rounded half up to 12 decimals as ``high * 1e-3 + low * 1e-12``, as a cast to DECIMAL(30,12) rounds its shortest text.

    Scaled as doubles; values whose rounding that might miss (near a tie, or large) go through Python's decimals.
    """
    q = v * 1e12
    whole = np.floor(q + 0.5)
    unsure = np.flatnonzero(~(np.abs(q - np.floor(q) - 0.5) > np.abs(q) * 2.0 ** -50))
    whole[unsure] = 0
    high, low = np.divmod(whole.astype(np.int64), 10 ** 9)
    for k in unsure.tolist():
        high[k], low[k] = divmod(int(Decimal(repr(float(v[k]))).quantize(_LAST_DECIMAL, ROUND_HALF_UP, _DIGITS).scaleb(12, _DIGITS)), 10 ** 9)
    return high, low


def _partial_state(batches):
    """Per batch and arm: the rows, and for every term the exact sum of its values and whether there was any."""
    for batch in batches:
        if not batch.num_rows:
            continue
        arms = batch.column(0).dictionary_encode(null_encoding="encode")
        codes = arms.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        columns = [batch.column(1 + i) for i in range(CONTEXT_DIM + 1)]
        held = [c.is_valid().to_numpy(zero_copy_only=False)[order] for c in columns]
        values = [np.where(h, c.to_numpy(zero_copy_only=False)[order], 0.0) for c, h in zip(columns, held)]
        out = [arms.dictionary.take(pa.array(codes[order][starts])), pa.array(np.diff(starts, append=len(codes)))]
        for i, j in _TERMS:
            v = values[i] * values[j]
            if not np.isfinite(v).all():
                raise ValueError("bandit contexts and rewards must be finite")
            there = held[i] & held[j]
            high, low = _twelve_decimals(v)
            none = ~np.logical_or.reduceat(there, starts)
            if np.abs(high).max() * float(len(high)) >= 2.0 ** 62:
                high = high.astype(object)  # whole numbers of any size; Arrow refuses what a long cannot hold
            out += [pa.array(np.add.reduceat(high, starts), pa.int64(), mask=none), pa.array(np.add.reduceat(low, starts), pa.int64(), mask=none)]
        yield pa.RecordBatch.from_arrays(out, names=["arm", "n", *[f"{p}{k}" for k in range(len(_TERMS)) for p in "hl"]])


def bandit_state(updates: DataFrame, arm: str = "arm", x: str = "x", reward: str = "reward") -> DataFrame:
    """additive LinUCB state per arm: A = I + sum x x^T (81 sums), b = sum r x, n.

    Order-free, so it is one grouped aggregate with map-side partial sums.
    Rewards are clipped to [0, 1.5].  Terms are summed as DECIMAL(30,12) so
    the state is identical however the events are partitioned.  The 45 products of A's half and the 9 of b are
    rounded and summed per batch and arm in whole numbers (casting 90 doubles a row to decimals costs far more than adding them).
    """
    rows = updates.select(F.col(arm).alias("arm"), *[F.col(x)[i].cast("double").alias(f"x{i}") for i in range(CONTEXT_DIM)],
                          clip(F.col(reward), 0.0, 1.5).cast("double").alias("r"))
    kind = updates.select(arm).schema[0].dataType.simpleString()
    sums = [f"{p}{k}" for k in range(len(_TERMS)) for p in "hl"]
    parts = rows.mapInArrow(_partial_state, f"arm {kind}, n bigint, " + ", ".join(f"{c} bigint" for c in sums))
    s = parts.groupBy("arm").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])

    def total(i, j):
        k = _TERMS.index((min(i, j), max(i, j)))
        return (F.col(f"h{k}").cast("decimal(20,0)") * F.lit(Decimal("0.001"))
                + F.col(f"l{k}").cast("decimal(20,0)") * F.lit(_LAST_DECIMAL)).cast("double")

    a = F.array(*[total(i, j) + (1.0 if i == j else 0.0) for i in range(CONTEXT_DIM) for j in range(CONTEXT_DIM)])
    b = F.array(*[total(i, CONTEXT_DIM) for i in range(CONTEXT_DIM)])
    return s.select(F.col("arm").alias(arm), F.col("n").cast("bigint").alias("n"), a.alias("A"), b.alias("b"))


def _solve_arms(pdf: pd.DataFrame) -> pd.DataFrame:
    a = np.stack(pdf["A"].to_numpy()).reshape(-1, CONTEXT_DIM, CONTEXT_DIM)
    b = np.stack(pdf["b"].to_numpy())
    inv = np.linalg.inv(a)
    theta = np.einsum("nij,nj->ni", inv, b)
    return pd.DataFrame({"arm": pdf["arm"].to_numpy(), "n": pdf["n"].to_numpy(),
                         "theta": list(theta), "A_inv": list(inv.reshape(-1, CONTEXT_DIM * CONTEXT_DIM))})


def bandit_solve(state: DataFrame) -> DataFrame:
    """Solve each arm once (9x9 inverse, batched NumPy per Arrow batch)."""
    def it(batches):
        for pdf in batches:
            if len(pdf):
                yield _solve_arms(pdf)
    return state.select("arm", "n", "A", "b").mapInPandas(
        it, "arm string, n bigint, theta array<double>, A_inv array<double>")


def bandit_scores(cands: DataFrame, solved: DataFrame, item: str = "topic", x: str = "x",
                  alpha: float = 0.7) -> DataFrame:
    """E5: theta.x + alpha*sqrt(max(x A^-1 x, 0)) + 0.01 n; unseen arms use A = I, b = 0."""
    s = solved.select(F.col("arm").alias("__arm"), "theta", "A_inv", F.col("n").alias("__n"))
    j = cands.join(s, cands[item] == s["__arm"], "left")
    xv = F.col(x)
    quad_known = F.aggregate(
        F.sequence(F.lit(0), F.lit(CONTEXT_DIM - 1)), F.lit(0.0),
        lambda acc, i: acc + xv[i] * F.aggregate(
            F.sequence(F.lit(0), F.lit(CONTEXT_DIM - 1)), F.lit(0.0),
            lambda a2, jj: a2 + F.col("A_inv")[i * CONTEXT_DIM + jj] * xv[jj]))
    quad = F.when(F.col("A_inv").isNull(), dot(x, x)).otherwise(quad_known)
    exploit = F.when(F.col("theta").isNull(), F.lit(0.0)).otherwise(dot("theta", x))
    score = exploit + F.lit(alpha) * F.sqrt(F.greatest(quad, F.lit(0.0))) \
        + F.lit(0.01) * F.coalesce(F.col("__n"), F.lit(0)).cast("double")
    return j.withColumn("bandit_score", score).drop("__arm", "theta", "A_inv", "__n")


# ------------------------------------------------------------------ E6
def transition_scores(cands: DataFrame, last_item: DataFrame, bigrams: DataFrame, freq: DataFrame,
                      key: str, item: str = "topic") -> DataFrame:
    """Bigram count from the user's last item, else item frequency when the
    history or the bigram row is empty; normalised by the per-request sum
    (denominator floor 1e-6)."""
    li = last_item.select(F.col(key).alias("__k"), F.col("last_item"))
    rows = bigrams.select(F.col("left_item").alias("__l")).distinct().withColumn("__row", F.lit(True))
    bg = bigrams.select(F.col("left_item").alias("__bl"), F.col("right_item").alias("__br"), F.col("n").alias("__bn"))
    fr = freq.select(F.col("item").alias("__fi"), F.col("frequency").alias("__fq"))
    j = (cands.join(li, cands[key] == li["__k"], "left").drop("__k")
         .join(rows, F.col("last_item") == F.col("__l"), "left")
         .join(bg, (F.col("last_item") == F.col("__bl")) & (F.col(item) == F.col("__br")), "left")
         .join(fr, F.col(item) == F.col("__fi"), "left"))
    use_freq = F.col("last_item").isNull() | F.col("__row").isNull()
    raw = F.when(use_freq, F.coalesce(F.col("__fq"), F.lit(0))).otherwise(F.coalesce(F.col("__bn"), F.lit(0)))
    j = j.withColumn("__raw", F.greatest(raw.cast("double"), F.lit(0.0)))
    tot = F.sum("__raw").over(Window.partitionBy(key))
    return (j.withColumn("sequence_score", F.col("__raw") / F.greatest(tot, F.lit(1e-6)))
            .drop("__l", "__row", "__bl", "__br", "__bn", "__fi", "__fq", "__raw", "last_item"))


# ------------------------------------------------------------------ E7
def online_item_vector(hashed: Column, feats: dict) -> Column:
    """E7 item side: 0.7 * hash vector + 0.3 * feature vector (defaults filled)."""
    fv = [feats.get("embedding_similarity", F.lit(0.5)), feats.get("freshness", F.lit(0.5)),
          feats.get("popularity", F.lit(0.5)), feats.get("difficulty_match", F.lit(0.5)),
          feats.get("recency_hours", F.lit(72.0)) / 100.0, feats.get("item_ctr", F.lit(0.3)),
          F.lit(1.0), F.lit(0.5), F.lit(0.5)]
    return F.zip_with(hashed, F.array(*fv), lambda h, f: F.lit(0.7) * h + F.lit(0.3) * f)


def online_scores(cands: DataFrame, user_vectors: DataFrame, key: str, item_vec: str = "item_vec") -> DataFrame:
    """dot(user vector, item vector); users without a vector score 0."""
    u = user_vectors.select(F.col(key).alias("__u"), F.col("vector").alias("__uv"))
    j = cands.join(u, cands[key] == u["__u"], "left")
    return (j.withColumn("online_score", F.when(F.col("__uv").isNull(), F.lit(0.0))
                         .otherwise(dot("__uv", item_vec))).drop("__u", "__uv"))


# ------------------------------------------------------------------ E9
def adaptive_blend(df: DataFrame, key: str, k: int, pos: str = "rnk") -> DataFrame:
    """.25/pos + .30 bandit + .25 sequence + .20 online, top-k per request."""
    s = (F.lit(0.25) * (F.lit(1.0) / F.col(pos)) + F.lit(0.30) * F.col("bandit_score")
         + F.lit(0.25) * F.col("sequence_score") + F.lit(0.20) * F.col("online_score"))
    return top_k(df.withColumn("adaptive_score", s), key,
                 [F.col("adaptive_score").desc(), F.col(pos)], k, "adaptive_rnk")


# ----------------------------------------------------------------- E10
def risk_priority_order(df: DataFrame, key: str, risk: str = "topic_risk_level",
                        score: str = "topic_predicted_score", pos: str = "rnk") -> DataFrame:
    """Order (high, medium, low) then predicted score ascending, input rank."""
    pr = F.when(F.col(risk) == "high", 0).when(F.col(risk) == "medium", 1).otherwise(2)
    w = Window.partitionBy(key).orderBy(pr, F.col(score), F.col(pos))
    return df.withColumn("priority_rnk", F.row_number().over(w).cast("int"))


# ----------------------------------------------------------------- E11
def risk_assembly(base: DataFrame, risk: DataFrame, extras: DataFrame, key: str,
                  medium_subject_topics: int = 1, low_subject_topics: int = 2, k: int = 5) -> DataFrame:
    """High -> 5 own; medium -> 4 own + 1 of the medium extra subject;
    low -> 3 own + 2 of the low extra subject; de-duplicated first-wins, top k.

    ``base`` = (key, topic, rnk) own list; ``risk`` = (key, risk_level);
    ``extras`` = (band, topic, rnk) where band is 'medium' or 'low'.
    """
    b = base.join(risk, key)
    own_cap = F.when(F.col("risk_level") == "high", 5).when(F.col("risk_level") == "medium", 4).otherwise(3)
    own = b.filter(F.col("rnk") <= own_cap).select(key, "topic", F.col("rnk").alias("__o"))
    ext = (risk.join(F.broadcast(extras), risk["risk_level"] == extras["band"])
           .filter(((F.col("band") == "medium") & (F.col("rnk") <= medium_subject_topics))
                   | ((F.col("band") == "low") & (F.col("rnk") <= low_subject_topics)))
           .select(key, "topic", (F.lit(100) + F.col("rnk")).alias("__o")))
    u = own.unionByName(ext)
    first = Window.partitionBy(key, "topic").orderBy("__o")
    u = u.withColumn("__f", F.row_number().over(first)).filter("__f = 1")
    return top_k(u, key, [F.col("__o")], k, "final_rnk").drop("__f", "__o")


# ----------------------------------------------------------------- E13
def sparse_blend(df: DataFrame, key: str, model_score: str, bigram_score: str) -> DataFrame:
    """0.75 * softmax(model scores) + 0.25 * bigram / max(bigram) per request."""
    w = Window.partitionBy(key)
    shifted = F.col(model_score) - F.greatest(F.max(model_score).over(w), F.lit(0.0))
    e = F.exp(shifted)
    df = df.withColumn("__e", e)
    prob = F.col("__e") / F.greatest(F.sum("__e").over(w), F.lit(1e-6))
    mx = F.greatest(F.max(bigram_score).over(w), F.lit(1e-6))
    return (df.withColumn("blend_score", F.lit(0.75) * prob + F.lit(0.25) * (F.col(bigram_score) / mx))
            .drop("__e"))


# ----------------------------------------------------------------- E12
def learned_ranker(train: DataFrame, label: str, feature_cols: list[str], max_iter: int = 30, max_depth: int = 4):
    """Pointwise learned ranker (gradient-boosted trees on per-candidate
    features such as content rank, collaborative rank and quiz score).

    The pairwise objective has no Spark ML counterpart; scores are pointwise
    and ordered per request by :func:`rank_by_model`.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from pathwise.operators.models import fit_trees
    va = VectorAssembler(inputCols=feature_cols, outputCol="features", handleInvalid="keep")
    g = GBTRegressor(labelCol=label, featuresCol="features", maxIter=max_iter, maxDepth=max_depth, seed=42)
    return fit_trees(Pipeline(stages=[va, g]), train)


def rank_by_model(model, cands: DataFrame, key: str, k: int, tie: str = "merged_rnk") -> DataFrame:
    s = model.transform(cands).withColumnRenamed("prediction", "model_score").drop("features")
    return top_k(s, key, [F.col("model_score").desc(), F.col(tie)], k, "model_rnk")
