"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from pathwise.llm import spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n int, a string"


def one_edit(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def brute(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return forms({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})


def forms(words):
    out, form = Counter(), {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = (best if best is not None and words[best] >= 2 * n else None, len(near))
    for w, (f, n_near) in form.items():
        root = w
        while form[root][0] is not None:
            root = form[root][0]
        out[w, f, root, words[w], n_near, None if f is None else words[f]] = 1
    return out


def docs_of(words):
    """Rows in which each word occurs as often as it is listed."""
    bag = [w for w, n in words.items() for _ in range(n)]
    random.Random(1).shuffle(bag)
    rows = [(i, " ".join(bag[i * 50:i * 50 + 50]), None, None, None, "x", 1, "x") for i in range(len(bag) // 50 + 1)]
    return rows


def table(rng, letters, size, longest):
    words = {}
    for _ in range(size):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(4, longest)))
        words[w] = rng.choice([1, 2, 3, 4, 6, 7, 20, 50])
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w))
            words[rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]])] = rng.randint(1, 9)
    return words


def check(spark, rows):
    got = Counter(map(tuple, spelling.variants(spark.createDataFrame(rows, DOCS).repartition(3)).collect()))
    assert got == brute(rows)
    return got


@pytest.mark.parametrize("group", [16_384, 40])
def test_against_all_pairs(spark, monkeypatch, group):
    """Small groups force windows to be cut down to single positions."""
    monkeypatch.setattr(spelling, "GROUP", group)
    rng = random.Random(group)
    words = table(rng, "abÀé×z", 150, 9) | table(rng, "aab", 120, 14) | {"a" * n: 3 + n for n in range(4, 30)}
    words |= {"kette": 40, "ketten": 18, "kettens": 8, "kettensq": 3}
    got = check(spark, docs_of(words))
    assert any(f is not None for _, f, *_ in got) and any(f != r and f is not None for _, f, r, *_ in got)


def test_awkward_rows(spark):
    long_word = "lang" * 6000
    rows = [(1, None), (2, ""), (3, "  \n12 34"), (None, "Hello hello HELLO hallo"), (None, "hello hallo hallo"), (None, None),
            (4, f"{long_word} {long_word}x " * 4), (5, "straße Straße strasse STRASSE strasse ÀÈÌÒÙ àèìòù ÀÈÌÒÙ ÀÈÌÒÙ"), (5, "straße Straße strasse STRASSE"),
            (5, "straße Straße strasse STRASSE"), (2 ** 63 - 1, "don't naïve naïve naïve naive naive naive"), (-4, "ab abc abcd abcde abcde abcde")]
    check(spark, [(*r, "en", "s", 1, "x", 1, "x") for r in rows])


def test_damaged_runs(spark):
    """Enough documents that some runs lose a code point."""
    rows = [(i, "spelling Variant daneben Ünlauter kurze", None, None, None, "x", 1, "x") for i in range(4000)]
    got = check(spark, rows)
    assert any(f == "spelling" for _, f, *_ in got)


def test_ties_take_the_least_word(spark):
    got = check(spark, docs_of({"wordb": 8, "worda": 8, "wordé": 8, "wordx": 4, "words": 5}))
    assert {k[0]: k[1] for k in got}["wordx"] == "worda"
    assert {k[0]: k[1] for k in got}["words"] is None


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).collect() == []


def test_every_pair_stands_in_one_window(spark, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP", 5)
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(5, 10))) for _ in range(300)})
    entries = spelling.groups(spark.createDataFrame([(w, 3) for w in words], "word string, n long"))
    found = {r["word"]: r["s"] for r in spelling.near_words(entries).groupBy("word").agg({"n_near": "sum"}).toDF("word", "s").collect()}
    assert found == {w: k for w in words if (k := sum(one_edit(w, v) for v in words))}
