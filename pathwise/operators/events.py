"""Event aggregates, sequence windows and set operations.

Every window is partitioned by user, session or item; the event log is
never sorted globally.  Aggregates are grouped (partial + final).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathwise.functions.expressions import safe_div
from pathwise.operators.scan import running_totals


def _order(ts: str, tie: str) -> list[Column]:
    # invalid / missing timestamps sort last (reference: coerce -> NaT last)
    return [F.col(ts).asc_nulls_last(), F.col(tie)]


# --------------------------------------------------------------- F1-F7
def user_snapshot(events: DataFrame, as_of=None, user: str = "user_id", ts: str = "timestamp_utc") -> DataFrame:
    """F1 (+D19 single T): per-user counts up to ``as_of`` with ctr / completion rate."""
    e = events.filter(F.col(ts).isNotNull())
    if as_of is not None:
        e = e.filter(F.col(ts) <= as_of)
    et = F.col("event_type")
    g = e.groupBy(user).agg(
        F.count(F.lit(1)).alias("interactions"),
        F.count_if(et == "recommendation_clicked").alias("clicks"),
        F.count_if(et == "lesson_completed").alias("completions"),
        F.max(ts).alias("last_event_ts"))
    return (g.withColumn("ctr", safe_div("clicks", "interactions"))
            .withColumn("completion_rate", safe_div("completions", "interactions")))


def item_reward_stats(events: DataFrame, item: str = "item_id", reward: str = "reward") -> DataFrame:
    """per-item reward mean and count, popularity = count / total count.

    The total is a one-row aggregate broadcast back (not a global window).
    """
    g = events.groupBy(item).agg(F.avg(reward).alias("reward_mean"), F.count(F.lit(1)).alias("n"))
    tot = events.agg(F.count(F.lit(1)).alias("__tot"))
    return (g.crossJoin(F.broadcast(tot))
            .withColumn("popularity", F.col("n") / F.greatest(F.col("__tot").cast("double"), F.lit(1.0)))
            .drop("__tot"))


def item_popularity(interactions: DataFrame, item: str = "item_id", weight: str = "interaction_weight") -> DataFrame:
    """popularity = sum of interaction weights (exact decimal sum)."""
    return interactions.groupBy(item).agg(
        F.sum(F.col(weight).cast("decimal(18,6)")).cast("double").alias("popularity"))


def ordered_distinct_history(events: DataFrame, user: str, item: str, ts: str, tie: str) -> DataFrame:
    """items of each user in order of first occurrence (long form with position)."""
    first = events.filter(F.col(item).isNotNull()).groupBy(user, item).agg(
        F.min(F.struct(F.col(ts), F.col(tie))).alias("__first"))
    w = Window.partitionBy(user).orderBy("__first")
    return first.select(user, item, F.row_number().over(w).cast("int").alias("pos"))


def item_vocabulary(sequences: DataFrame, item: str = "item") -> DataFrame:
    """item frequency over all sequences and a dense id (2.. after pad/unk).

    The dense id is a window over the vocabulary (one row per item).
    """
    f = sequences.groupBy(item).agg(F.count(F.lit(1)).alias("frequency"))
    w = Window.orderBy(F.col("frequency").desc(), F.col(item))
    return f.withColumn("item_index", (F.row_number().over(w) + 1).cast("int"))


def bigram_counts(pairs: DataFrame) -> DataFrame:
    """(left_item, right_item) -> n from adjacent pairs."""
    return pairs.groupBy("left_item", "right_item").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------- W1-W11
def event_sequences(events: DataFrame, user: str = "user_id", session: str = "session_id",
                    item: str = "item_id", ts: str = "timestamp_utc", tie: str = "event_id",
                    min_len: int = 2) -> DataFrame:
    """Per (user, session) items in time order (long form), sequences >= min_len."""
    e = events.filter(F.col(item).isNotNull())
    grp = Window.partitionBy(user, session)
    w = grp.orderBy(*_order(ts, tie))
    return (e.select(user, session, item, ts, tie, F.row_number().over(w).cast("int").alias("pos"),
                     F.count(F.lit(1)).over(grp).alias("__len"))
            .filter(F.col("__len") >= min_len).drop("__len"))


def adjacent_pairs(seq: DataFrame, user: str = "user_id", session: str = "session_id",
                   item: str = "item_id") -> DataFrame:
    """(left_item, right_item) for consecutive items in a sequence."""
    w = Window.partitionBy(user, session).orderBy("pos")
    return (seq.select(user, session, "pos", F.col(item).alias("left_item"),
                       F.lead(item).over(w).alias("right_item"))
            .filter(F.col("right_item").isNotNull()))


def prefix_pairs(seq: DataFrame, max_len: int = 16, user: str = "user_id", session: str = "session_id",
                 item: str = "item_id") -> DataFrame:
    """(prefix of at most ``max_len`` previous items, target) training pairs."""
    w = Window.partitionBy(user, session).orderBy("pos").rowsBetween(-max_len, -1)
    return (seq.select(user, session, "pos", F.col(item).alias("target"),
                       F.collect_list(item).over(w).alias("prefix"))
            .filter(F.col("pos") >= 2))


def last_n_items(events: DataFrame, n: int = 20, user: str = "user_id", item: str = "item_id",
                 ts: str = "timestamp_utc", tie: str = "event_id") -> DataFrame:
    """The user's last n items (null items dropped) in time order, pos 1..n."""
    e = events.filter(F.col(item).isNotNull())
    wd = Window.partitionBy(user).orderBy(F.col(ts).desc_nulls_first(), F.col(tie).desc())
    last = e.withColumn("__r", F.row_number().over(wd)).filter(F.col("__r") <= n)
    wa = Window.partitionBy(user).orderBy(F.col("__r").desc())
    return last.withColumn("pos", F.row_number().over(wa).cast("int")).drop("__r")


def collapse_repeats(events: DataFrame, keep: int = 50, user: str = "user_id", item: str = "item_id",
                     ts: str = "timestamp_utc", tie: str = "event_id") -> DataFrame:
    """Drop consecutive repeats of the same item, keep the last ``keep``."""
    e = events.filter(F.col(item).isNotNull())
    w = Window.partitionBy(user).orderBy(*_order(ts, tie))
    kept = e.withColumn("__prev", F.lag(item).over(w)).filter(
        F.col("__prev").isNull() | (F.col("__prev") != F.col(item)))
    return last_n_items(kept.drop("__prev"), keep, user, item, ts, tie)


def fold_assignment(df: DataFrame, key: str, k: int, seed: str = "42", out: str = "fold") -> DataFrame:
    """Deterministic fold = md5(seed:key) mod k (no global window)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10)
    return df.withColumn(out, (h.cast("bigint") % k).cast("int"))


def hash_split(df: DataFrame, key: str, train_pct: int = 80, seed: str = "42") -> DataFrame:
    """Deterministic train/test split by md5(seed:key) mod 100 < train_pct."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10)
    return df.withColumn("is_train", (h.cast("bigint") % 100) < train_pct)


def running_user_counters(events: DataFrame, user: str = "user_id", ts: str = "timestamp_utc",
                          tie: str = "event_id", rating: str = "rating") -> DataFrame:
    """User counters as of each event (interactions, clicks, completions,
    ctr, completion rate) and the latest non-null rating carried forward."""
    et = F.col("event_type")
    r = F.when(et == "rating_submitted", F.col(rating)) if rating in events.columns else F.lit(None)
    out = running_totals(events, user, ts, tie, {
        "interactions": F.lit(1), "clicks": F.when(et == "recommendation_clicked", 1).otherwise(0),
        "completions": F.when(et == "lesson_completed", 1).otherwise(0)}, {"latest_rating": r})
    return (out.withColumn("ctr", safe_div("clicks", "interactions"))
            .withColumn("completion_rate", safe_div("completions", "interactions")))


def running_item_counters(events: DataFrame, item: str = "item_id", ts: str = "timestamp_utc",
                          tie: str = "event_id") -> DataFrame:
    """Item views / clicks / item_ctr as of each event on the item."""
    et = F.col("event_type")
    out = running_totals(events.filter(F.col(item).isNotNull()), item, ts, tie, {
        "views": F.when(et == "recommendation_shown", 1).otherwise(0),
        "item_clicks": F.when(et == "recommendation_clicked", 1).otherwise(0)}, {})
    return out.withColumn("item_ctr", safe_div("item_clicks", "views"))


def last_event(events: DataFrame, user: str = "user_id", ts: str = "timestamp_utc",
               tie: str = "event_id", cols: tuple = ("event_type", "reward")) -> DataFrame:
    """Last event's fields per user via ``max_by`` over (ts, id) - no sort."""
    st = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(ts), F.col(tie)))
    return (events.filter(F.col(ts).isNotNull()).groupBy(user).agg(st.alias("__l"))
            .select(user, *[F.col(f"__l.{c}").alias(f"last_{c}") for c in cols]))


# --------------------------------------------------------------- S1-S6
def union_missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """S3: UNION ALL by name, missing columns as NULL."""
    return a.unionByName(b, allowMissingColumns=True)


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set union (distinct)."""
    return a.union(b).distinct()


def set_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set intersection."""
    return a.intersect(b)


def set_difference(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of ``a`` not in ``b`` (anti join on ``keys`` or whole rows)."""
    if keys:
        return a.join(b.select(*keys).distinct(), keys, "left_anti")
    return a.exceptAll(b).distinct()


def as_of_counts(events: DataFrame, labels: DataFrame, key: str, ts: str, label_ts: str,
                 values: dict) -> DataFrame:
    """Point-in-time sums of ``values`` over each key's events with ts <= label time.

    Sort-based as-of join: label rows are interleaved into the key's event
    stream (after events with an equal timestamp) and running sums are read
    off at the label rows - one shuffle by key, no event x label pairs.
    """
    e = events.filter(F.col(ts).isNotNull()).select(
        F.col(key), F.col(ts).alias("__t"), F.lit(0).alias("__lab"),
        *[v.cast("bigint").alias(n) for n, v in values.items()])
    lab = labels.select(F.col(key), F.col(label_ts).alias("__t"), F.lit(1).alias("__lab"),
                        *[F.lit(0).cast("bigint").alias(n) for n in values])
    w = Window.partitionBy(key).orderBy("__t", "__lab").rowsBetween(Window.unboundedPreceding, 0)
    u = e.unionByName(lab)
    return (u.select(key, "__t", "__lab", *[F.sum(n).over(w).alias(n) for n in values])
            .filter("__lab = 1").select(key, F.col("__t").alias(label_ts),
                                        *[F.col(n).cast("bigint").alias(n) for n in values]))
