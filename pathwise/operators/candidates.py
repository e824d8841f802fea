"""Candidate generation and lookup joins.

Per-learner topic lists are built from a small topic dictionary
``subject -> ordered array<topic>`` that is broadcast to the learner rows,
then sliced / reversed with array functions and exploded: no shuffle of the
learner table.  Candidate lists are long tables ``(key, topic, rnk, source)``
- the rank is a column, never list order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathwise.functions.expressions import col, dot, l2


# ------------------------------------------------------------ dictionaries
def topic_lists(topics: DataFrame) -> DataFrame:
    """``(subject, topic_list)`` with topics in library order (by ``rnk``)."""
    return (topics.groupBy("subject")
            .agg(F.sort_array(F.collect_list(F.struct("rnk", "topic"))).alias("__l"))
            .select("subject", F.col("__l.topic").alias("topic_list")))


def catalogue(topics: DataFrame, n: int | None = None) -> DataFrame:
    """One row ``catalogue``: the whole library in catalogue order (first ``n``)."""
    arr = F.sort_array(F.collect_list(F.struct("topic_idx", "topic"))).getField("topic")
    if n is not None:
        arr = F.slice(arr, 1, n)
    return topics.agg(arr.alias("catalogue"))


def _explode_list(df: DataFrame, arr: Column, keep: list[str], source: str) -> DataFrame:
    return (df.select(*keep, F.posexplode(arr).alias("__p", "topic"))
            .select(*keep, "topic", (F.col("__p") + 1).cast("int").alias("rnk"),
                    F.lit(source).alias("source")))


def _with_lists(learners: DataFrame, topics: DataFrame, subject_col: str, head: int | None) -> DataFrame:
    lists = F.broadcast(topic_lists(topics))
    j = learners.join(lists, learners[subject_col] == lists["subject"], "left").drop("subject")
    return j.crossJoin(F.broadcast(catalogue(topics, head)))


def prior_order(quiz: Column, topic_list: Column, whole: Column) -> Column:
    """Topic prior of a learner: own list (reversed when quiz >= 70), else catalogue."""
    return (F.when(topic_list.isNull() | (F.size(topic_list) == 0), whole)
            .when(quiz >= 70, F.reverse(topic_list)).otherwise(topic_list))


def content_candidates(learners: DataFrame, topics: DataFrame, max_candidates: int | None = 10,
                       key: str = "student_id", subject_col: str = "subject_weakness",
                       quiz_col: str = "quiz_score", keep: list[str] | None = None) -> DataFrame:
    """Weak-subject topics in order (reversed when quiz >= 70), catalogue if unknown; all of them without a limit."""
    keep = keep or [key, quiz_col]
    j = _with_lists(learners, topics, subject_col, max_candidates)
    arr = prior_order(F.col(quiz_col), F.col("topic_list"), F.col("catalogue"))
    arr = arr if max_candidates is None else F.slice(arr, 1, max_candidates)
    return _explode_list(j, arr, keep, "content")


def cold_start(learners: DataFrame, topics: DataFrame, num_topics: int = 5,
               key: str = "student_id", subject_col: str = "subject_weakness",
               quiz_col: str = "quiz_score") -> DataFrame:
    """Prior order, top-n, padded from the catalogue without repeats."""
    j = _with_lists(learners, topics, subject_col, 2 * num_topics)
    focused = F.slice(prior_order(F.col(quiz_col), F.col("topic_list"), F.col("catalogue")), 1, num_topics)
    padded = F.slice(F.array_distinct(F.concat(focused, F.slice(F.col("catalogue"), 1, 2 * num_topics))),
                     1, num_topics)
    return _explode_list(j, padded, [key], "cold_start")


def quiz_band(quiz: Column) -> Column:
    return F.when(quiz < 55, "low").when(quiz < 75, "mid").otherwise("high")


def segment_popular(learners: DataFrame, topics: DataFrame, segments: dict, top_k: int = 5,
                    key: str = "student_id", quiz_col: str = "quiz_score") -> DataFrame:
    """D3: pool the topic lists of the band's subjects in order, top-k.

    ``segments`` maps band ('low' <55, 'mid' <75, 'high') -> list of subjects.
    """
    lists = topic_lists(topics)
    rows = [(band, i, s) for band, subs in segments.items() for i, s in enumerate(subs)]
    spark = learners.sparkSession
    seg = spark.createDataFrame(rows, "band string, i int, subject string")
    pooled = (seg.join(lists, "subject")
              .groupBy("band").agg(F.sort_array(F.collect_list(F.struct("i", "topic_list"))).alias("__s"))
              .select("band", F.slice(F.flatten(F.col("__s.topic_list")), 1, top_k).alias("pool")))
    j = learners.withColumn("band", quiz_band(F.col(quiz_col))).join(F.broadcast(pooled), "band", "left")
    return _explode_list(j, F.coalesce(F.col("pool"), F.array().cast("array<string>")), [key], "segment")


def global_popular(topics: DataFrame, top_k: int = 5) -> DataFrame:
    """First k topics of the catalogue."""
    return topics.filter(F.col("topic_idx") < top_k).select(
        "topic", (F.col("topic_idx") + 1).cast("int").alias("rnk"), F.lit("global").alias("source"))


# ------------------------------------------------------ vector retrieval
def normalize(df: DataFrame, vec: str, out: str = "unit") -> DataFrame:
    n = l2(vec)
    return df.withColumn(out, F.transform(F.col(vec), lambda x: x / F.when(n == 0, 1.0).otherwise(n)))


def cosine_top_k(queries: DataFrame, items: DataFrame, k: int, qkey: str, ikey: str,
                 qvec: str = "vec", ivec: str = "vec") -> DataFrame:
    """Exact cosine top-k per query (inner product of unit vectors).

    Every query meets every item; which side travels is Spark's choice by their sizes.
    ``row_number`` over the query keeps k (Spark's WindowGroupLimit prunes
    before the shuffle's sort).
    """
    q = normalize(queries.select(F.col(qkey).alias("__q"), F.col(qvec).cast("array<double>").alias("__qv")), "__qv", "__qu")
    it = normalize(items.select(F.col(ikey).alias("__i"), F.col(ivec).cast("array<double>").alias("__iv")), "__iv", "__iu")
    pairs = it.crossJoin(q.select("__q", "__qu"))
    scored = pairs.select("__q", "__i", dot("__qu", "__iu").alias("similarity"))
    w = Window.partitionBy("__q").orderBy(F.col("similarity").desc(), F.col("__i"))
    return (scored.withColumn("rnk", F.row_number().over(w).cast("int")).filter(F.col("rnk") <= k)
            .select(F.col("__q").alias(qkey), F.col("__i").alias(ikey), "similarity", "rnk"))


def user_item_scores(users: DataFrame, items: DataFrame, ukey: str, ikey: str,
                     uvec: str = "vec", ivec: str = "vec", popularity: str = "popularity",
                     k: int | None = None) -> DataFrame:
    """dot(user, item) + 0.05 * popularity, ranked per user: the ``k`` best, or all items."""
    u = users.select(F.col(ukey).alias("__u"), F.col(uvec).cast("array<double>").alias("__uv"))
    it = items.select(F.col(ikey).alias("__i"), F.col(ivec).cast("array<double>").alias("__iv"),
                      F.col(popularity).alias("__pop"))
    s = it.crossJoin(u).select(
        "__u", "__i", (dot("__uv", "__iv") + F.lit(0.05) * F.col("__pop")).alias("score"))
    w = Window.partitionBy("__u").orderBy(F.col("score").desc(), F.col("__i"))
    s = s.select(F.col("__u").alias(ukey), F.col("__i").alias(ikey), "score",
                 F.row_number().over(w).cast("int").alias("rnk"))
    return s if k is None else s.filter(F.col("rnk") <= k)


def lsh_neighbours(items: DataFrame, key: str, vec: str, threshold: float,
                   bucket_length: float = 0.5, num_tables: int = 4, seed: int = 42,
                   k: int | None = None) -> DataFrame:
    """Approximate neighbours of unit vectors with random-projection LSH.

    Euclidean distance d between unit vectors maps to cosine 1 - d^2/2.  With ``k`` (and integer keys) only each
    vector's k nearest are kept, and no pairs are shuffled (:mod:`lsh`).  Vectors that are null or hold null or
    non-finite components have no neighbours.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from pathwise.operators.lsh import FOUND, bucket_neighbours

    v = items.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v")).filter(
        F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    u = normalize(v, "v", "u").select("id", "u", array_to_vector("u").alias("features"))
    if u.isEmpty():
        return items.sparkSession.createDataFrame([], f"{FOUND}, cosine double" + ("" if k is None else ", rnk int"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", seed=seed,
                                        bucketLength=bucket_length, numHashTables=num_tables).fit(u)
    cosine = F.lit(1.0) - F.col("dist") * F.col("dist") / 2
    if k is None:
        j = model.approxSimilarityJoin(u.drop("u"), u.drop("u"), threshold, distCol="dist")
        return (j.select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), "dist")
                .filter(F.col("a") != F.col("b")).withColumn("cosine", cosine))
    buckets = F.array(*[vector_to_array(F.col("hashes")[i])[0].cast("long") for i in range(num_tables)])
    rows = model.transform(u).select(F.col("id").cast("long").alias("id"), F.col("u").alias("vec"), buckets.alias("buckets"))
    return bucket_neighbours(rows, k, threshold, num_tables).select("a", "b", "dist", cosine.alias("cosine"), "rnk")


# ---------------------------------------------------------- list merging
def first_wins_merge(lists: DataFrame, key: str, source_order: dict, item: str = "topic",
                     rnk: str = "rnk", source: str = "source") -> DataFrame:
    """``dict.fromkeys(a + b + ...)`` - keep each item's first occurrence.

    ``source_order`` maps source -> list order; output rank is the position
    in the concatenated, de-duplicated list.
    """
    so = None
    for s, o in source_order.items():
        so = F.when(F.col(source) == s, o) if so is None else so.when(F.col(source) == s, o)
    # dealt by key first, into all of the session's partitions: both windows sort these, not a whole input split before the shuffle
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = lists.withColumn("__so", so).repartition(parts, key)
    first = Window.partitionBy(key, item).orderBy("__so", rnk)
    pos = Window.partitionBy(key).orderBy("__so", rnk)
    return (t.withColumn("__f", F.row_number().over(first)).filter("__f = 1")
            .withColumn("merged_rnk", F.row_number().over(pos).cast("int"))
            .drop("__f", "__so"))


def retrieval_ladder(ann: DataFrame, has_vector: DataFrame, cold: DataFrame, fallback: DataFrame,
                     key: str, top_k: int) -> DataFrame:
    """ANN list for users with a vector; cold start without one; merged
    content+collaborative fallback when the ANN list is empty.  Tiers are
    selected by semi / anti joins, not exceptions; ``source`` tells which.
    """
    ann_users = ann.select(key).distinct()
    t1 = ann.filter(F.col("rnk") <= top_k).withColumn("source", F.lit("ann"))
    t2 = (cold.join(has_vector.select(key), key, "left_anti").filter(F.col("rnk") <= top_k)
          .withColumn("source", F.lit("cold_start")))
    t3 = (fallback.join(has_vector.select(key), key, "left_semi").join(ann_users, key, "left_anti")
          .filter(F.col("rnk") <= top_k).withColumn("source", F.lit("fallback")))
    cols = [key, "topic", "rnk", "source"]
    return t1.select(*cols).unionByName(t2.select(*cols)).unionByName(t3.select(*cols))


# --------------------------------------------------------------- lookups
ITEM_DEFAULTS = {"embedding_similarity": 0.5, "recency_hours": 72.0, "popularity": 0.3,
                 "difficulty_match": 0.5}  # fixed values


def item_feature_lookup(cands: DataFrame, item_feats: DataFrame, item: str = "topic",
                        as_of: Column | None = None) -> DataFrame:
    """Per-candidate item features with defaults.

    ``item_feats`` has ``item_id``, ``item_ctr`` and ``last_event_ts``;
    recency is ``as_of - last_event_ts`` in hours (72 when unknown),
    popularity the item CTR (0.3 when unknown), freshness 1/(1+h/24).
    """
    f = item_feats.select(F.col("item_id").alias("__it"), F.col("item_ctr").alias("__ctr"),
                          F.col("last_event_ts").alias("__last"))
    j = cands.join(f, cands[item] == f["__it"], "left")
    rec = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("__last").cast("timestamp"))) / 3.6e9 \
        if as_of is not None else F.lit(None)
    j = (j.withColumn("embedding_similarity", F.lit(ITEM_DEFAULTS["embedding_similarity"]))
         .withColumn("recency_hours", F.coalesce(rec, F.lit(ITEM_DEFAULTS["recency_hours"])))
         .withColumn("popularity", F.coalesce(F.col("__ctr"), F.lit(ITEM_DEFAULTS["popularity"])))
         .withColumn("difficulty_match", F.lit(ITEM_DEFAULTS["difficulty_match"])))
    j = j.withColumn("freshness", F.lit(1.0) / (F.lit(1.0) + F.col("recency_hours") / 24.0))
    return j.drop("__it", "__ctr", "__last")


USER_DEFAULTS = {"ctr": 0.1, "completion_rate": 0.3}  # fixed values


def user_feature_lookup(df: DataFrame, user_feats: DataFrame, key: str, user_key: str = "user_id",
                        defaults: dict | None = None) -> DataFrame:
    """Left join user features and fill per-feature defaults."""
    defaults = defaults or USER_DEFAULTS
    u = user_feats.select(F.col(user_key).alias("__u"), *[F.col(c).alias(f"__f_{c}") for c in defaults])
    j = df.join(u, df[key] == u["__u"], "left")
    for c, d in defaults.items():
        j = j.withColumn(c, F.coalesce(F.col(f"__f_{c}"), F.lit(d)))
    return j.drop("__u", *[f"__f_{c}" for c in defaults])


def point_lookup(table: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows for the requested keys, and the requested keys that are missing."""
    found = table.join(keys.select(key).distinct(), key, "left_semi")
    missing = keys.select(key).distinct().join(table.select(key), key, "left_anti")
    return found, missing


def suppress_known(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Drop rows whose key is already known, and repeats within the batch."""
    return new.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def relevance_flag(recs: DataFrame, relevant: DataFrame, key: str, item: str = "topic") -> DataFrame:
    """0/1 ``hit`` column from membership in the relevance table."""
    r = relevant.select(F.col(key).alias("__k"), F.col(item).alias("__it"), F.lit(1).alias("__hit")).distinct()
    j = recs.join(r, (recs[key] == r["__k"]) & (recs[item] == r["__it"]), "left")
    return j.withColumn("hit", F.coalesce(F.col("__hit"), F.lit(0))).drop("__k", "__it", "__hit")


def pair_shared_columns(a: DataFrame, b: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Unpivot both datasets and pair them on their shared column names."""
    shared = [c for c in a.columns if c in b.columns] if cols is None else cols
    def long(df, tag):
        st = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in shared)
        return df.selectExpr(f"stack({len(shared)}, {st}) AS (feature, {tag})")
    return long(a, "reference_value"), long(b, "current_value")


def negative_samples(positives: DataFrame, n_items: int, user: str = "user_id", item: str = "item_idx",
                     seed: str = "42", tries: int = 10) -> DataFrame:
    """One negative item per positive: first of ``tries`` hashed draws not
    among the user's positives (no draw survives -> no row).  Never builds
    user x item.
    """
    draws = positives.select(user, F.col(item).alias("__pos"),
                             F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("try"))
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(user).cast("string"), F.col("__pos").cast("string"),
                          F.col("try").cast("string")))
    draws = draws.withColumn("neg", (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % n_items).cast("int"))
    pos = positives.select(F.col(user).alias("__u"), F.col(item).alias("__ni")).distinct()
    ok = draws.join(pos, (F.col(user) == F.col("__u")) & (F.col("neg") == F.col("__ni")), "left_anti")
    w = Window.partitionBy(user, "__pos").orderBy("try")
    return (ok.withColumn("__r", F.row_number().over(w)).filter("__r = 1")
            .select(user, F.col("__pos").alias(item), "neg", F.col("try").cast("int").alias("try")))


def implicit_interactions(learners: DataFrame, topics: DataFrame, key: str = "student_id") -> DataFrame:
    """Implicit (user, item, weight, source) rows derived from performance.

    mastery = clip((.35 quiz + .25 assign + .20 att + .20 prev)/100, 0, 1),
    effort = clip(hours/8 + attempts/10, .2, 2), need = clip((70-quiz)/20 +
    (65-att)/30 + (5-min(attempts,5))*.1, .2, 2.2).  Strength topics 1..4:
    (.75 + mastery + .15 effort)/rank; weakness topics 1..4: (.90 + need)/rank;
    quiz >= 75 adds 0.35 on strength topics 3..5.  Unknown subject -> the
    catalogue's first topics.  Weights floored at 0.05.
    """
    from pathwise.functions.expressions import clip as _clip
    q, a, s = F.col("quiz_score"), F.col("attendance"), F.col("assignment_score")
    p, h, n = F.col("previous_score"), F.col("time_spent_hours"), F.col("attempts").cast("double")
    base = learners.select(
        key, "subject_strength", "subject_weakness", q.alias("__q"),
        _clip((F.lit(0.35) * q + F.lit(0.25) * s + F.lit(0.20) * a + F.lit(0.20) * p) / 100.0, 0.0, 1.0).alias("__m"),
        _clip(h / 8.0 + n / 10.0, 0.2, 2.0).alias("__e"),
        _clip((F.lit(70.0) - q) / 20.0 + (F.lit(65.0) - a) / 30.0 + (F.lit(5.0) - F.least(n, F.lit(5.0))) * 0.1,
              0.2, 2.2).alias("__need"))
    lists = F.broadcast(topic_lists(topics))
    cat = F.broadcast(catalogue(topics, 5))
    j = (base.join(lists.select(F.col("subject").alias("__ss"), F.col("topic_list").alias("__sl")),
                   F.col("subject_strength") == F.col("__ss"), "left")
         .join(lists.select(F.col("subject").alias("__ws"), F.col("topic_list").alias("__wl")),
               F.col("subject_weakness") == F.col("__ws"), "left")
         .crossJoin(cat))
    sl = F.coalesce(F.col("__sl"), F.col("catalogue"))
    wl = F.coalesce(F.col("__wl"), F.col("catalogue"))
    strength = j.select(key, "__m", "__e", F.posexplode(F.slice(sl, 1, 4)).alias("__p", "item_id")).select(
        key, "item_id", ((F.lit(0.75) + F.col("__m") + F.col("__e") * 0.15) / (F.col("__p") + 1)).alias("interaction_weight"),
        F.lit("strength").alias("source"))
    weakness = j.select(key, "__need", F.posexplode(F.slice(wl, 1, 4)).alias("__p", "item_id")).select(
        key, "item_id", ((F.lit(0.90) + F.col("__need")) / (F.col("__p") + 1)).alias("interaction_weight"),
        F.lit("weakness").alias("source"))
    ext = j.filter(F.col("__q") >= 75).select(key, F.explode(F.slice(sl, 3, 3)).alias("item_id")).select(
        key, "item_id", F.lit(0.35).alias("interaction_weight"), F.lit("extension").alias("source"))
    u = strength.unionByName(weakness).unionByName(ext)
    return u.select(F.col(key).alias("user_id"), "item_id",
                    F.greatest(F.col("interaction_weight"), F.lit(0.05)).alias("interaction_weight"), "source")
