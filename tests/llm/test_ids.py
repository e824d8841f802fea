"""Ids beyond 2^53 beside NULL ids stay exact in every operator that hands rows to Python."""

import pytest

from pathwise.llm import chat, langid, ngram_join, packing, secrets, topk

BIG = [2 ** 53 - 1, 2 ** 53, 2 ** 53 + 1, 2 ** 63 - 1, -(2 ** 63), None, 7]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"some words of the text number {k} stand here", "en", "s") for k, i in enumerate(BIG)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.select(name).collect()), key=lambda x: (x is None, x or 0))


WANT = sorted(BIG, key=lambda x: (x is None, x or 0))


@pytest.mark.parametrize("run", [packing.pack, ngram_join.near_components, langid.identify, secrets.scan],
                         ids=["op1", "op2", "op7", "op8"])
def test_document_ids(docs, run):
    assert ids(run(docs)) == WANT


def test_components_of_neighbouring_ids(docs):
    got = ngram_join.near_components(docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted((i, i) for i in BIG if i is not None)


def test_conversations_stay_apart(spark):
    rows = [(c, t, r, f"{c}") for c in BIG for t, r in enumerate(("user", "assistant"))]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = chat.format_digests(convs).collect()
    assert sorted(((r["conv_id"], r["n_turns"]) for r in got), key=lambda x: (x[0] is None, x[0] or 0)) == [(i, 2) for i in WANT]
    assert ids(chat.format_segments(convs).select("conv_id").distinct(), "conv_id") == WANT


def test_vectors(spark):
    rows = [(i, [float(k), 1.0]) for k, i in enumerate(BIG)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = topk.top_k(frame, frame, "vec_id", "embedding")
    known = [i for i in WANT if i is not None]
    assert sorted(set(ids(got, "query_id"))) == known and sorted(set(ids(got, "vec_id"))) == known


def test_repeated_query_rows(spark):
    """A query's own row alone is left out, and each query row has its own ranks."""
    f = topk.F
    rows = [(20, [1.0, 0.0], 0), (20, [0.0, 1.0], 1), (3, [0.5, 0.25], 2), (4, [0.25, 0.5], 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row long")
    got = topk.top_k(frame.filter(f.col("vec_id") == 20), frame, "vec_id", "embedding", k=2, row_col="row").collect()
    dot = lambda a, b: sum(int(64 * x) * int(64 * y) for x, y in zip(a, b))
    want = []
    for i, q, r in rows[:2]:
        best = sorted((-dot(q, v), j) for j, v, o in rows if o != r)[:2]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_thresholds_over_shards(spark, monkeypatch):
    """Many small shards in one group give what one shard gives, ties included."""
    import random
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(12)], i) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row long").repartition(4)
    queries = frame.filter("vec_id % 20 = 0")
    whole = sorted(map(tuple, topk.top_k(queries, frame, "vec_id", "embedding", row_col="row").collect()))
    monkeypatch.setattr(topk, "SHARD_ROWS", 16)
    assert sorted(map(tuple, topk.top_k(queries, frame, "vec_id", "embedding", row_col="row").collect())) == whole
