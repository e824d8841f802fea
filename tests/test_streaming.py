import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import SF
from pathwise.operators import candidates as D
from pathwise.plans import common as C
from pathwise.plans import q_streaming as QS
from pathwise.streaming import feedback as G
from pathwise.streaming import state as ST


def test_idempotent_ingest_rejects_replayed_keys(spark):
    log = QS.g01(spark, SF)
    n_events = C.events(spark, SF).count()
    assert log.count() == n_events
    assert log.select("idempotency_key").distinct().count() == n_events


def test_online_vectors_stream_equals_batch(spark):
    s = QS.g05(spark, SF).select("user_id", "vector", "updates").collect()
    b = {r.user_id: r for r in QS.g05b(spark, SF).collect()}
    assert len(s) == len(b) > 0
    for r in s:
        assert r.updates == b[r.user_id].updates
        assert np.allclose(r.vector, b[r.user_id].vector, atol=1e-12)
        assert abs(np.linalg.norm(r.vector) - 1.0) < 1e-9


def test_online_features_stream_equals_batch_snapshot(spark):
    from pathwise.operators import events as EV
    s = {r.user_id: (r.interactions, r.clicks) for r in QS.g02(spark, SF).collect()}
    b = {r.user_id: (r.interactions, r.clicks) for r in EV.user_snapshot(C.rated_events(spark, SF)).collect()}
    assert s == b


def test_cold_start_pads_unknown_subject(spark):
    t = C.topics(spark, SF)
    l = spark.createDataFrame([(1, "NoSuchSubject", 40.0), (2, None, 80.0)],
                              "student_id long, subject_weakness string, quiz_score double")
    out = D.cold_start(l, t, 5).collect()
    cat = [r.topic for r in t.orderBy("topic_idx").limit(5).collect()]
    for sid in (1, 2):
        assert [r.topic for r in sorted((r for r in out if r.student_id == sid), key=lambda r: r.rnk)] == cat


def _rows(spark, *rows):
    return spark.createDataFrame([(i, d, f"k{i}") for i, d in rows], "event_id long, event_date string, key string")


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "log")
    first, second = _rows(spark, (1, "a"), (2, "a"), (2, "a")), _rows(spark, (2, "a"), (3, "b"))
    for epoch, batch in ((0, first), (1, second), (1, second), (0, first)):
        G.append_new(batch, out, epoch, "key", "event_date")
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    for epoch, batch in ((0, first), (1, second), (1, second)):
        G.write_batch(batch, str(tmp_path / "updates"), epoch)
    got = G.latest(spark.read.parquet(str(tmp_path / "updates")), ["event_id"]).collect()
    assert sorted(r.event_id for r in got) == [1, 2, 3]


def _frame(*rows, **columns):
    import pandas as pd
    return pd.DataFrame([(i, t, *rest) for i, t, *rest in rows], columns=["i", "t", *columns["names"]])


def test_late_and_repeated_events_find_their_place_in_the_recent_sequence():
    names = ["item_id", "reward"]
    state, _ = ST.fold_recent((1,), None, iter([_frame((2, 20, "B", 0.5), names=names)]))
    again = _frame((1, 10, "A", 0.1), (2, 20, "B", 0.5), names=names)
    state, out = ST.fold_recent((1,), state, iter([again, _frame((3, 30, "C", 0.9), (4, ST.NO_TIME, "D", 0.2), names=names)]))
    assert out["item_id"].tolist() == ["A", "B", "C", "D"] and set(out["last_reward"]) == {0.9}
    many = _frame(*[(i, 100 + i, f"x{i}", 1.0) for i in range(60)], names=names)
    state, out = ST.fold_recent((1,), state, iter([many]))
    assert len(out) == ST.RECENT_N and out["item_id"].tolist()[-2:] == ["x59", "D"]


def test_user_vector_is_that_of_the_events_in_order_whenever_they_arrive():
    rng = np.random.default_rng(3)
    events = [(i, 1000 * i, rng.normal(size=ST.VECTOR_DIM), float(rng.uniform())) for i in range(40)]
    want = np.zeros(ST.VECTOR_DIM)
    for _, _, item, reward in events:
        want = ST.step(want, item, reward)
    names = ["item_vec", "reward"]
    order = rng.permutation(40).tolist()
    for pieces in ([order], [order[:7], order[7:20], order[20:] + order[:5]]):  # five events come twice
        state = None
        for piece in pieces:
            state, out = ST.fold_vector(10 ** 9, 4096)((1,), state, iter([_frame(*[events[k] for k in piece], names=names)]))
        assert np.allclose(out["vector"][0], want) and out["updates"][0] == 40
    # beyond the horizon an event is applied when it comes, and no more than the horizon is held
    state, _ = ST.fold_vector(5_000, 4096)((1,), None, iter([_frame(*events, names=names)]))
    assert len(state[4]) == 6
    state, out = ST.fold_vector(5_000, 4096)((1,), state, iter([_frame(events[0], names=names)]))
    assert out["updates"][0] == 41


def test_session_pairs_take_back_what_a_late_event_parts():
    fold = ST.fold_pairs(4096)
    total = {}
    state = None
    for frame in (_frame((1, 10, "A"), (3, 30, "C"), names=["item_id"]), _frame((2, 20, "B"), (1, 10, "A"), names=["item_id"]),
                  _frame((4, 40, "A"), names=["item_id"])):
        state, out = fold((1, "s"), state, iter([frame]))
        for r in out.itertuples():
            total[r.left_item, r.right_item] = total.get((r.left_item, r.right_item), 0) + r.n
    assert {p: n for p, n in total.items() if n} == {("A", "B"): 1, ("B", "C"): 1, ("C", "A"): 1}


def _events(spark, *rows):
    import datetime as dt
    start = dt.datetime(2024, 1, 10)
    return spark.createDataFrame([(u, i, start + dt.timedelta(days=d), "recommendation_clicked", None) for u, i, d in rows],
                                 "user_id long, event_id long, event_ts timestamp, event_type string, rating int")


def test_state_expires_after_its_time_to_live(spark, tmp_path):
    import time
    src = str(tmp_path / "src")

    def run(*rows):
        _events(spark, *rows).write.mode("append").parquet(src)
        stream = spark.readStream.schema(_events(spark).schema).parquet(src)
        out = G.run_updates(spark, ST.live_features_state(stream, ttl_ms=8_000), str(tmp_path / "run"), ["user_id"], idle=False)
        return {r.user_id: r.interactions for r in out.collect()}

    assert run((1, 1, 0.0), (1, 2, 0.1), (2, 3, 0.0)) == {1: 2, 2: 1}
    time.sleep(9)
    assert run((1, 4, 0.2)) == {1: 1, 2: 1}  # user 1 came back after the state had gone


def test_first_time_events_days_late_are_logged_once(spark, tmp_path):
    src, run_dir = str(tmp_path / "src"), str(tmp_path / "run")

    def deliver(*rows):
        batch = _events(spark, *rows).withColumn("key", F.concat(F.lit("k"), F.col("event_id"))).withColumn("day", F.to_date("event_ts"))
        batch.write.mode("append").parquet(src)
        log = G.run_ingest(spark, spark.readStream.schema(batch.schema).parquet(src), run_dir, "key", delay="1 day", partition_col="day")
        return sorted(r.event_id for r in log.collect())

    assert deliver((1, 10, 0), (1, 20, 10)) == [10, 20]
    assert deliver((1, 12, 2), (1, 12, 2), (1, 21, 11)) == [10, 12, 20, 21]  # eight days late, twice at once
    assert deliver((1, 12, 2), (1, 20, 10), (1, 9, -1), (1, 22, 12)) == [9, 10, 12, 20, 21, 22]


def test_lsh_finds_most_nearest_neighbours(spark):
    sf = SF.replace("0.001", "0.01")
    from pathwise.operators import knn as KN
    from pathwise.plans import q_candidates as QC
    v = C.tables.read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    exact = {(r.vec_id, r.neighbour) for r in KN.knn(v, 5, "vec_id", metric="cosine").collect()}
    found = {(r.a, r.b) for r in QC.d09(spark, sf).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_streams_keep_two_partitions_a_core(spark, tmp_path):
    """A session of many shuffle partitions does not open as many state stores on every micro-batch."""
    spark.createDataFrame([(i, i % 3) for i in range(30)], "i long, k long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, k long").parquet(str(tmp_path / "in")).groupBy("k").count()
    before = spark.conf.get(G.PARTITIONS)
    spark.conf.set(G.PARTITIONS, "64")
    try:
        got = G.run_updates(spark, stream, str(tmp_path / "run"), ["k"])
        assert {(r.k, r["count"]) for r in got.collect()} == {(0, 10), (1, 10), (2, 10)}
        stores = list((tmp_path / "run" / "checkpoint" / "state" / "0").glob("[0-9]*"))
        assert len(stores) == 2 * spark.sparkContext.defaultParallelism
        assert spark.conf.get(G.PARTITIONS) == "64"
    finally:
        spark.conf.set(G.PARTITIONS, before)


def test_a_session_without_new_pairs_returns_no_rows():
    frame = lambda *rows: pd.DataFrame(rows, columns=["t", "i", "item_id"])
    fold = ST.fold_pairs(8)
    state, rows = fold((1, "s"), None, [frame((5, 1, "a"))])
    assert rows is None and state == ([(5, 1, "a")],)
    state, rows = fold((1, "s"), state, [frame((5, 1, "a"))])  # held already
    assert rows is None and state == ([(5, 1, "a")],)
    state, rows = fold((1, "s"), state, [frame((7, 2, "b"))])
    assert rows.values.tolist() == [["a", "b", 1]]


def test_folds_leave_a_keys_few_rows_out_of_pandas(monkeypatch):
    """Sorting and filtering frames per key took most of the time of a batch."""
    def slow(*a, **kw):
        raise AssertionError("a frame was sorted")
    names = ["event_type", "rating", "item_id", "reward"]
    frame = _frame((2, 20, "recommendation_clicked", np.nan, None, 0.4), (1, 10, "rating_submitted", 3.0, "A", 1.0),
                   (5, ST.NO_TIME, "lesson_completed", np.nan, "C", 0.2), (3, 20, "rating_submitted", np.nan, "B", np.nan), names=names)
    monkeypatch.setattr(pd.DataFrame, "sort_values", slow)
    state, out = ST.fold_features((7,), None, iter([frame]))
    assert state == (4, 1, 1, 3.0, 10, 1, "lesson_completed", ST.NO_TIME, 5)
    assert out.iloc[0].tolist() == [7, 4, 1, 1, 3.0, "lesson_completed", ST.NO_TIME, 0.25, 0.25]
    state, out = ST.fold_recent((7,), None, iter([frame]))
    assert state[1:] == (20, 3, None) and out["item_id"].tolist() == ["A", "B", "C"] and out["last_reward"].isna().all()


def test_sessions_share_buckets_and_expire_one_by_one():
    """Each session was a key with a call and a frame of its own on every batch."""
    fold = ST.fold_sessions(4096, 100)
    frame = lambda *rows: pd.DataFrame(rows, columns=["session", "t", "i", "item_id"])
    held, change = fold(0, None, iter([frame(("a", 10, 1, "A"), ("b", 10, 2, "B"), ("a", 30, 3, "C"))]))
    assert change == {("A", "C"): 1}
    held, change = fold(60, held, iter([frame(("a", 20, 4, "B"), ("a", 10, 1, "A")), frame(("c", 5, 5, "C"))]))
    assert change == {("A", "C"): -1, ("A", "B"): 1, ("B", "C"): 1}
    held, change = fold(120, held, iter([frame(("b", 20, 6, "A"), ("a", 40, 7, "A"))]))  # b has gone, a was written since
    assert change == {("C", "A"): 1}
    assert {name: (at, len(history)) for name, at, history in held} == {"a": (120, 4), "b": (120, 1), "c": (60, 1)}


def test_session_pairs_of_a_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "BUCKETS", 2)
    kind = "user_id long, session_id string, event_id long, event_ts timestamp, item_id string"
    import datetime as dt
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    src, run = str(tmp_path / "src"), str(tmp_path / "run")
    for rows in ([(1, "s", 1, at(1), "A"), (1, "s", 3, at(3), "C"), (2, "s", 4, at(1), "A"), (None, "s", 5, at(1), "A"), (1, None, 6, at(2), "B")],
                 [(1, "s", 2, at(2), "B"), (2, "s", 7, at(2), "C"), (None, "s", 8, at(2), "B"), (1, None, 9, at(3), "A"), (2, "s", 4, at(1), "A")]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(src)
        out = G.run_append_log(spark, ST.session_pairs(spark.readStream.schema(kind).parquet(src)), run, idle=False)
    got = {(r.left_item, r.right_item): r.n for r in out.groupBy("left_item", "right_item").agg(F.sum("n").alias("n")).collect() if r.n}
    assert got == {("A", "B"): 2, ("B", "C"): 1, ("A", "C"): 1, ("B", "A"): 1}
