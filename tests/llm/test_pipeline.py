"""The pipeline's stages against plain Python, and its edges."""

from collections import Counter, defaultdict

import corpus_pipeline
import __spark_entry__ as entry
from pathwise.llm import mixing, secrets, toxicity
from test_ops_small import WORD, DOCS, awkward_rows, brute_components, brute_targets, shingles

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "secrets", "mixing", "packing"]


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = [tuple(r) for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = [tuple(r) for r in docs.collect()]
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            models = toxicity.fit(spark.createDataFrame(before, docs.schema), spark.read.parquet(f"{SF}/labels.parquet"))
            p = toxicity.chain_probabilities(models, [r[1] for r in before])[:, 1]
            assert Counter(after) == Counter(r for r, x in zip(before, p) if x < models[1].threshold)
        elif name == "ngram_join":
            named = {d for d, n, c in brute_components(before) if n and d == c}
            assert Counter(after) == Counter(r for r in before if r[0] in named or not shingles(r[1]))
        elif name == "secrets":
            masked = {r[0]: secrets.redact(r[1]) for r in before}
            assert Counter((r[0], r[1], r[4]) for r in after) == Counter((d, t, len(t)) for d, t in masked.items())
            assert not any(secrets.find_secrets(t) and t == secrets.redact(t) for t in masked.values())
        elif name == "mixing":
            sizes = Counter()
            for r in before:
                sizes[r[3]] += len(WORD.findall(r[1]))
            taken, largest = Counter(), defaultdict(int)
            for r in after:
                taken[r[3]] += len(WORD.findall(r[1]))
            for r in before:
                largest[r[3]] = max(largest[r[3]], len(WORD.findall(r[1])))
            assert all(abs(taken[s] - t) <= largest[s] for s, t in brute_targets(sizes).items())
            assert set(after) <= set(before)
        else:
            want = Counter(r[0] for r in before)
            assert Counter(r["doc_id"] for r in docs.filter("piece = 0").collect()) == want
        before = after


def test_stages_on_awkward_and_empty_tables(spark):
    frame = spark.createDataFrame(awkward_rows(), DOCS)
    for rows in (frame, frame.limit(0)):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "packing":
                assert docs.columns == rows.columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert (docs.count() > 0) == (rows is frame)
