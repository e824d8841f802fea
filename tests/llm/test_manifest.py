"""The Merkle manifest against plain Python trees."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pathwise.llm import manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, n int, `rank` string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """Last node, and per node the (left, right) digests of each hashed level."""
    level, paths, at = list(nodes), [[] for _ in nodes], list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[i:i + 16] for i in range(0, len(level), 16)]
        for k, i in enumerate(at):
            run, j = runs[i // 16], i % 16
            paths[k].append(("".join(run[:j]), "".join(run[j + 1:])))
            at[k] = i // 16
        level = [H(*run) for run in runs]
    return level[0], paths


def brute(rows):
    by = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        touched = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if touched else text
        by[source].append((doc_id, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, lower)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        subs[s] = tree([r[1] for r in by[s]])
    root, upper = tree([subs[s][0] for s in names])
    out = Counter()
    for s, up in zip(names, upper):
        for (doc_id, own, shown), path in zip(by[s], subs[s][1]):
            folded = shown
            for left, right in path + up:
                folded = H(left, folded, right)
            out[doc_id, own, subs[s][0], root, H(*[x for p in path + up for x in p]), folded, folded == root] += 1
    return out


def fifth():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def check(spark, rows):
    got = manifest.audited(manifest.build(spark.createDataFrame(rows, DOCS).repartition(5), fifth())).collect()
    assert Counter(map(tuple, got)) == brute(rows)
    return got


def make(n, source, start=0):
    rng = random.Random(n)
    return [(start + i, rng.choice([None, "", "Some Text", "lower", "É Ü ß"]) if i % 3 else f"Text {i}", rng.choice(["en", None]), source,
             rng.choice([None, 5]), "h", 1, "r") for i in range(n)]


AWKWARD = [*make(1, "one"), *make(16, "sixteen", 100), *make(17, "seventeen", 200), *make(300, None, 1000), *make(2, "", 2000), *make(40, "ü", 3000),
           (None, None, None, None, None, None, None, None), (None, "X", None, None, None, None, None, None),
           *[(7, "Same Row", "en", "same", 1, "h", 1, "r")] * 20, (2 ** 63 - 1, "A", "en", "same", 1, "h", 1, "r"), (2 ** 53 + 1, "A", "en", "same", 1, "h", 1, "r"),
           (-5, "x" * 200_000 + "Q", "en", "same", 1, "h", 1, "r")]


def test_awkward_rows(spark):
    got = check(spark, AWKWARD)
    assert {r["verified"] for r in got} == {True, False}


def test_many_stories_and_sources(spark, monkeypatch):
    """Blocks of one digit, so 300 leaves take three stories, and 280 sources take three of their own."""
    monkeypatch.setattr(manifest, "DIGITS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 16)
    check(spark, AWKWARD + [(5000 + i, f"T{i}", None, f"s{i}", None, "h", 1, "r") for i in range(280)])


@pytest.mark.parametrize("n", [1, 16, 256, 257, 4096, 4097])
def test_sizes_of_one_source(spark, n):
    got = check(spark, make(n, "only"))
    assert len(got) == n and len({r["root"] for r in got}) == 1


def test_empty_and_missing_columns(spark):
    none = manifest.audited(manifest.build(spark.createDataFrame([], DOCS), fifth()))
    assert none.collect() == []
    few = spark.createDataFrame([(1, "A"), (5, "B")], "doc_id long, text string")
    got = manifest.audited(manifest.build(few)).collect()
    assert all(r["verified"] for r in got)
    assert {r["leaf"] for r in got} == {leaf(1, None, None, None, "A"), leaf(5, None, None, None, "B")}


def test_untouched_documents_verify(spark):
    got = manifest.audited(manifest.build(spark.createDataFrame(AWKWARD, DOCS))).collect()
    assert all(r["verified"] for r in got)


def test_no_join_on_the_way_down(spark):
    """The proofs come from grouping, transform and explode."""
    docs = spark.createDataFrame(make(40, "a"), DOCS)
    plan = manifest.build(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" in plan
