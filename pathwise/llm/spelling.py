"""Operator 12: spelling variants by dynamic programming over the sorted vocabulary.

Words are counted per task before they travel.  Two words are near if one inserted, deleted or replaced code point
makes one of the other.  Near words are found by scanning sorted lists (:class:`SortedScan`): adjacent words share a
prefix, so the banded rows (three cells) of the edit matrices of that prefix, one per word still within one edit
of it, are taken from a stack, and only the letters after it are computed.  A word whose row exceeds one edit on a prefix leaves
the stack there, which skips the whole range of the list under that prefix for it.

The list is cut so that no task holds it whole and no near pair is lost.  A pair's edit stands at its first differing
position ``p``, and what follows is equal.  A window ``[a, b)`` of positions gathers the pairs with ``a <= p < b``: both words
have the same first ``a`` code points, the shorter one's text from ``b`` on is the longer one's from one further.  So words meet
under (first ``a``, rest); a word enters under the rest it has as the shorter and as the longer one.  ``[0, 2)`` and
``[2, end)`` cover all positions.  A group of over ``GROUP`` words is cut again into the two halves of its window, round after
round; a window of one position cannot hold more words than the alphabet allows (one letter, or two in the longer word).

Each word's nearest variants are reduced within a scan to their number and the most frequent one, so pairs never leave
a task.  The chain of forms at least doubles in frequency with every step; its end is found by pointer doubling.

Edge cases: NULL texts have no words; NULL doc_ids count as an empty text before the colon; repeated rows count each; ties between
forms go to the least word in code-point order; ``×`` and ``÷`` lie in the range of letters and belong to words; words
of any length are compared whole; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathwise.llm.common import table, written
from pathwise.llm.manifest import LOWER, UPPER, crc32_sql
from pathwise.llm.registry import register

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: A run whose hash this number divides loses a code point.
DAMAGED = 97
MIN_LETTERS = 5
MIN_COUNT = 3
#: A form is this many times as frequent as its variant.
DOMINANCE = 2
#: Words that one scan holds; larger groups are cut by narrower windows.
GROUP = 16_384
#: First window of positions; the second goes from here to the end.
HEAD = 2
#: Distinct words that a counting task holds before it hands them on.
HELD = 400_000
#: Rows of a scanning task.
TASK_ROWS = 30_000

_LOWER = str.maketrans(UPPER, LOWER)


# --- counting ---------------------------------------------------------------------------------------------------

def document_words(name: str, text: str | None, counts: Counter) -> None:
    """Add the words of one document, ``name`` being its doc_id as text."""
    start = zlib.crc32(f"{name}:".encode())
    for run, n in Counter(RUN.findall(text or "")).items():
        size = len(run)
        if size < MIN_LETTERS:
            continue
        word = run.lower() if run.isascii() else run.translate(_LOWER)
        h = zlib.crc32(word.encode(), start)
        if h % DAMAGED == 0:
            if size == MIN_LETTERS:
                continue
            at = h % size
            word = word[:at] + word[at + 1:]
        counts[word] += n


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: the words of all texts that occur ``MIN_COUNT`` times or more; written."""

    def count(frames):
        counts: Counter = Counter()
        for frame in frames:
            for name, text in zip(frame["name"], frame["text"]):
                document_words(name, text, counts)
                if len(counts) >= HELD:
                    yield pd.DataFrame({"word": pd.Series(list(counts), dtype=object), "n": list(counts.values())})
                    counts.clear()
        yield pd.DataFrame({"word": pd.Series(list(counts), dtype=object), "n": list(counts.values())})

    rows = docs.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    counted = rows.mapInPandas(count, "word string, n long")
    return written(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT), "vocabulary")


# --- groups -----------------------------------------------------------------------------------------------------

KEY = ["a", "b", "prefix", "suffix"]


def _entries(windows: list[Column]) -> Column:
    return F.explode(F.array_compact(F.array(*windows)))


def _entry(a: Column, b: Column, longer: bool | Column, keep: Column) -> Column:
    longer = F.lit(longer) if isinstance(longer, bool) else longer
    return F.when(keep, F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), longer.alias("longer")))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows ``word, n, w`` with what their words share in the window: first code points, rest; and the part between."""
    after = F.col("b") + F.col("longer").cast("int")
    return (rows.select("word", "n", "w.*")
            .withColumn("prefix", F.substr("word", F.lit(1), F.col("a")))
            .withColumn("suffix", F.when(F.col("b") < 0, F.lit("")).otherwise(F.substr("word", after + 1)))
            .withColumn("middle", F.substr("word", F.col("a") + 1, F.char_length("word") - F.col("a") - F.char_length("suffix"))))


def _inner(a: Column, b: Column, size: Column) -> list[Column]:
    """A word's entries for the window [a, b): as the shorter and as the longer of a pair.

    A word that ends within the window has no rest in either part, so it enters once.
    """
    return [_entry(a, b, False, size >= a), _entry(a, b, True, size > b)]


def groups(words: DataFrame) -> DataFrame:
    """Entries ``word, n, a, b, longer, prefix, suffix, middle``; all near pairs meet in exactly one group.

    ``b`` is -1 for a window that goes to the end.  Every round cuts the groups that are too large.
    """
    size = F.char_length("word")
    zero, head, end = F.lit(0), F.lit(HEAD), F.lit(-1)
    rows = words.select("word", "n", _entries([*_inner(zero, head, size), _entry(head, end, False, size >= head)]).alias("w"))
    parts = []
    while True:
        keyed = written(_keyed(rows), "spelling-groups")
        large = written(keyed.filter((F.col("b") < 0) | (F.col("b") - F.col("a") > 1))
                        .groupBy(*KEY).agg(F.count("*").alias("size")).filter(F.col("size") > GROUP).drop("size"), "spelling-large")
        if large.isEmpty():
            parts.append(keyed)
            break
        parts.append(keyed.join(large, KEY, "left_anti").select(keyed.columns))
        a, b = F.col("a"), F.col("b")
        to_end = b < 0
        middle = F.when(to_end, F.greatest(a * 2, F.lit(1))).otherwise(F.floor((a + b) / 2))
        inner, longer = ~to_end, F.col("longer")
        once = inner & ~longer & (size <= b)  # stood for both roles so far
        kept = [_entry(a, middle, longer, inner & ~once), _entry(middle, b, longer, inner & (size >= middle)),
                *[F.when(to_end | once, x) for x in _inner(a, middle, size)], _entry(middle, end, False, to_end & (size >= middle))]
        rows = keyed.join(large, KEY, "left_semi").select("word", "n", _entries(kept).alias("w"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- scanning ---------------------------------------------------------------------------------------------------

class SortedScan:
    """Near words within groups of a batch; a group's entries are sorted by ``middle``."""

    def __init__(self, frame: pd.DataFrame):
        self.words, self.n = frame["word"].tolist(), frame["n"].to_numpy(dtype=np.int64)
        self.longer = frame["longer"].to_numpy(dtype=bool)
        middles = frame["middle"].tolist()
        self.sizes = np.fromiter(map(len, middles), dtype=np.int64, count=len(middles))
        # one NUL before and three after each word let the band look past both ends
        self.letters = np.frombuffer("".join(["\0" + m + "\0\0\0" for m in middles]).encode("utf-32-le"), dtype=np.uint32)
        self.start = np.concatenate([[0], np.cumsum(self.sizes + 4)])[:-1] + 1
        self.shared = self._shared()

    def _shared(self) -> np.ndarray:
        """Length of the prefix that each word shares with the one before it."""
        out = np.zeros(len(self.sizes), dtype=np.int64)
        at, depth = np.arange(1, len(self.sizes)), 0
        while len(at):
            same = ((self.letters[self.start[at] + depth] == self.letters[self.start[at - 1] + depth])
                    & (depth < self.sizes[at]) & (depth < self.sizes[at - 1]))
            at, depth = at[same], depth + 1
            out[at] = depth
        return out

    def group(self, low: int, high: int, width: int | None):
        """Yield (entry, number of near words, the most frequent one's n, that word) for entries ``low`` to ``high`` - 1.

        ``width`` limits the first differing position; None: no limit.
        """
        letters = self.letters
        every = np.arange(low, high)
        one = np.ones(len(every), dtype=np.int8)
        # rows by depth: the words within one edit, where they start, D[d][d-1..d+1] and the length of the common prefix
        stack = [(every, self.start[low:high], one * 9, one * 0, one, np.zeros(len(every), dtype=np.int32))]
        sizes, shared = self.sizes[low:high].tolist(), self.shared[low:high].tolist()
        for v in range(low, high):
            size = sizes[v - low]
            del stack[(shared[v - low] if v > low else 0) + 1:]
            depth = len(stack) - 1
            own = letters[self.start[v]:self.start[v] + size].tolist()
            while depth < size and len(stack[-1][0]) > 1:
                ids, start, x, y, z, same = stack[-1]
                letter = own[depth]
                here = start + depth
                hit = letters[here] == letter
                nx = np.minimum(x + (letters[here - 1] != letter), y + 1)
                ny = np.minimum(np.minimum(y + ~hit, z + 1), nx + 1)
                nz = np.minimum(z + (letters[here + 1] != letter), ny + 1)
                same = same + (hit & (same == depth))
                near = np.flatnonzero(np.minimum(np.minimum(nx, ny), nz) <= 1)
                if len(near) < len(ids):
                    ids, start, nx, ny, nz, same = ids[near], start[near], nx[near], ny[near], nz[near], same[near]
                depth += 1
                stack.append((ids, start, nx, ny, nz, same))
            ids, _, x, y, z, same = stack[-1]
            if depth < size or len(ids) < 2:
                continue  # only the word itself is left
            gap = self.sizes[ids] - size
            good = (np.where(gap == 0, y, np.where(gap < 0, x, z)) == 1) & (np.abs(gap) <= 1)
            if self.longer[v]:
                good &= ~self.longer[ids]
            if width is not None:
                good &= same < width
            found = ids[good]
            if len(found):
                most = self.n[found].max()
                yield v, len(found), most, min(self.words[i] for i in found[self.n[found] == most])


def near_words(entries: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` per word and group with a near word in it."""

    def scan(frames):
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            new = np.ones(len(frame), dtype=bool)
            for k, c in enumerate(KEY):
                values = frame[c].to_numpy()
                changed = values[1:] != values[:-1]
                new[1:] = changed if k == 0 else new[1:] | changed
            bounds = np.flatnonzero(new)
            last = bounds[-1] if len(bounds) else 0
            held = frame.iloc[last:]  # the last group may go on in the next batch
            yield from scanned(frame.iloc[:last], np.append(bounds[:-1], last))
        if held is not None and len(held):
            yield from scanned(held.reset_index(drop=True), np.asarray([0, len(held)]))

    def scanned(frame, bounds):
        if not len(frame):
            return
        lists, out = SortedScan(frame), []
        a, b = frame["a"].to_numpy(), frame["b"].to_numpy()
        many = np.flatnonzero(np.diff(bounds) > 1)
        for low, high in zip(bounds[many].tolist(), bounds[many + 1].tolist()):
            out.extend(lists.group(low, high, int(b[low] - a[low]) if b[low] >= 0 else None))
        at, count, best_n, best = zip(*out) if out else ((), (), (), ())
        yield pd.DataFrame({"word": pd.Series([lists.words[i] for i in at], dtype=object), "n_near": np.asarray(count, dtype=np.int64),
                            "best_n": np.asarray(best_n, dtype=np.int64), "best": pd.Series(list(best), dtype=object)})

    spark = entries.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, entries.count() // TASK_ROWS + 1)
    dealt = entries.select(*KEY, "middle", "longer", "word", "n").repartition(tasks, *KEY).sortWithinPartitions(*KEY, "middle")
    return dealt.mapInPandas(scan, "word string, n_near long, best_n long, best string")


# --- forms ------------------------------------------------------------------------------------------------------

def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form``: each round follows twice as many steps of the chain."""
    ends = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = written(ends.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                            F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if ends.filter("moved").isEmpty():
            return ends.drop("moved")
        ends = ends.drop("moved")


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``docs(doc_id, text)``."""
    words = vocabulary(docs)
    near = (near_words(groups(words)).groupBy("word")
            .agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("rarity"), "best")).alias("top")))
    fits = -F.col("top.rarity") >= DOMINANCE * F.col("n")
    known = written(words.join(near, "word", "left")
                    .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                            F.when(fits, F.col("top.best")).alias("form"), F.when(fits, -F.col("top.rarity")).alias("form_n")), "spelling-forms")
    roots = last_forms(known.filter(F.col("form").isNotNull()))
    return (known.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


_SQL = f"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS p,
                               unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
low AS (SELECT p, translate(r, '{UPPER}', '{LOWER}') AS r, count(*) AS k FROM runs WHERE length(r) >= {MIN_LETTERS} GROUP BY 1, 2),
hashed AS (SELECT r, k, {crc32_sql("string_split(p || r, '')")} AS h FROM low),
cut AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(r, 1, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS word, k
        FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= {MIN_LETTERS} GROUP BY 1 HAVING sum(k) >= {MIN_COUNT}),
holes AS (SELECT word, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r
          FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT x.word AS word, y.word AS other FROM holes AS x JOIN holes AS y USING (i, l, r) WHERE x.word <> y.word
         UNION SELECT word, l || r FROM holes WHERE l || r IN (SELECT word FROM words)
         UNION SELECT l || r, word FROM holes WHERE l || r IN (SELECT word FROM words)),
best AS (SELECT near.word, count(*) AS n_near, max(o.n) AS top_n FROM near JOIN words o ON o.word = other GROUP BY 1),
top AS (SELECT best.word, n_near, top_n, min(other) AS top FROM best JOIN near USING (word) JOIN words o ON o.word = other AND o.n = top_n GROUP BY ALL),
forms AS (SELECT word, CASE WHEN top_n >= {DOMINANCE} * n THEN top END AS form, n, coalesce(n_near, 0) AS n_near,
                 CASE WHEN top_n >= {DOMINANCE} * n THEN top_n END AS form_n FROM words LEFT JOIN top USING (word)),
walk(word, stop) AS (SELECT word, word FROM words UNION ALL
                   SELECT walk.word, form FROM walk JOIN forms ON forms.word = walk.stop WHERE form IS NOT NULL)
SELECT forms.word, forms.form, walk.stop AS root, forms.n, forms.n_near, forms.form_n
FROM forms JOIN walk USING (word) JOIN forms f ON f.word = walk.stop WHERE f.form IS NULL
"""


@register("op12_spelling_variants", _SQL)
def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Operator 12 over all documents."""
    return variants(table(spark, sf_dir, "documents"))
