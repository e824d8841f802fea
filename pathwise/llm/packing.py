"""Operator 1: best-fit packing of token sequences by a linear grouping scheme.

Only the number of pieces of every length (at most ``capacity`` numbers) decides how sequences
are filled, so the plan is made from that histogram; documents are then put in place by
their rank within their length.

1. Large lengths are sorted and cut into groups of equal cardinality; each is rounded up to its
   group's longest, which leaves few different sizes.
2. For those sizes the fractional cutting-stock problem is solved by column generation (the columns are
   configurations: how many of each size fill one sequence); whole multiples are used.
3. Actual lengths take the places of the rounded ones, longest first; this frees room.
4. What is left over, and all small lengths, longest first, go where they fit best, for many
   equal sequences at once.

Ranks come from a distributed prefix count within (length, hash range), so a frequent
length is spread over many tasks.  The plan has a bounded number of rows (a function of
``capacity`` and the number of groups) and is broadcast.

Edge cases: NULL text is empty, one piece with the end token alone; very long texts are cut into
pieces; NULL or repeated doc_ids and repeated rows are packed separately; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwise.llm.common import exclusive_prefix, id_text, ids_back, table, written
from pathwise.llm.registry import register

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Tried in turn: number of size groups of the large lengths, and the share of a sequence up to which a length
#: is small.  Rounding pays when many lengths share a sequence; with few, best fit does more of the work.
SETTINGS = ((64, 1 / 4), (64, 1 / 2))
#: Texts with such runs are left to the slower reader, whose memory does not grow with the run.
LONG_GAP = re.compile(r"\s{1000}")


class Encoder:
    """Ids of whole texts under a vocabulary file.

    A byte-level BPE whose ids follow the order of its merges is fully described by its vocabulary: merging by
    rank gives the same ids whichever library does it, so the file's ids are handed to the faster one.
    Texts with the file's added tokens or very long gaps, and files of any other kind, go through
    the file's own library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._by_rank(json.loads(self.tokenizer.to_str()))

    def _by_rank(self, spec: dict):
        import public_tokenizers
        import tiktoken
        first, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = (first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
                 and model["type"] == "BPE" and not spec.get("normalizer") and not model.get("ignore_merges"))
        if not plain:
            return None
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in self.added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        # byte-level files write printable Latin-1 bytes as themselves and the others from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown}
        byte |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items()}
        return tiktoken.Encoding("by-rank", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or any(t in text for t in self.added) or LONG_GAP.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the documents' pieces of at most ``capacity`` tokens."""

    def run(frames):
        encoder = _encoder(vocabulary_path(vocabulary))
        for frame in frames:
            for at in range(0, len(frame), 512):
                part = frame.iloc[at:at + 512]
                rows = []
                for doc, text in zip(part["doc_id"], part["text"]):
                    ids = np.asarray([*encoder.encode(text), end_id], dtype="<u4")
                    head = (len(ids) - 1) % capacity + 1
                    cuts = [0, *range(head, len(ids) + 1, capacity)]
                    for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((doc, p, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(id_text("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return ids_back(rows.mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long"), "doc_id")


def configurations(sizes: list[int], demands: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """Whole multiples of the optimal fractional solution: ``(sequences, copies of each size)``.

    Column generation: the basis starts with one size per configuration; the next
    configuration solves a knapsack by the basis' prices, until none is worth more than one sequence.
    """
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    demand = np.asarray(demands, dtype=float)
    size = np.asarray(sizes)
    amount = np.linalg.solve(basis, demand)
    for _ in range(50 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(1, capacity + 1):
            best[room], pick[room] = best[room - 1], -1
            fits = np.flatnonzero(size <= room)
            if len(fits):
                value = best[room - size[fits]] + price[fits]
                top = int(value.argmax())
                if value[top] > best[room] + 1e-12:
                    best[room], pick[room] = value[top], fits[top]
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        while room > 0:
            if pick[room] < 0:
                room -= 1
            else:
                column[pick[room]] += 1
                room -= size[pick[room]]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        amount = np.maximum(np.linalg.solve(basis, demand), 0)
    return [(int(a + 1e-6), [int(round(c)) for c in basis[:, i]]) for i, a in enumerate(amount) if a + 1e-6 >= 1]


def cut_run(run: list, m: int) -> tuple[list, list]:
    """The first ``m`` sequences of a run of equal sequences, and the rest; the ranks are dealt out anew."""
    n, free, items = run
    return [m, free, items], [n - m, free, [(s, rank + m * copies, copies) for s, rank, copies in items]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, settings=SETTINGS) -> list[tuple]:
    """The best of the settings' plans: the one with the fewest sequences."""
    return min((grouped_plan(histogram, capacity, groups, small) for groups, small in settings),
               key=lambda p: max((first + n for _, _, _, first, n, _ in p), default=0))


def grouped_plan(histogram: dict[int, int], capacity: int, groups: int, small: float) -> list[tuple]:
    """How to place pieces: ``(length, first rank, end rank, first sequence, sequences, offset)``.

    Pieces of that length with ranks in the range fill the sequences in turn, one layer after the
    other, each layer ``length`` further in.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    used: dict[int, int] = {s: 0 for s in left}
    runs: list[list] = []  # [sequences, free, [(length, first rank, copies)]]

    def take(length, n):
        used[length] += n
        left[length] -= n
        return used[length] - n

    large = sorted((s for s in left if small * capacity < s < capacity), reverse=True)
    total = sum(left[s] for s in large)
    if total:
        # equal cardinality: group g holds the ranks [g, g + 1) * total / groups of the sorted pieces
        members: list[list[list[int]]] = []
        seen, bounds = 0, [total * (g + 1) // groups for g in range(groups)]
        g, current = 0, []
        for s in large:
            n = left[s]
            while n:
                while bounds[g] <= seen:
                    g += 1
                    if current:
                        members.append(current)
                    current = []
                part = min(n, bounds[g] - seen)
                current.append([s, part])
                seen, n = seen + part, n - part
        members.append(current)
        rounded: dict[int, list[list[int]]] = {}  # groups of one longest length are one size
        for m in members:
            rounded.setdefault(m[0][0], []).extend(m)
        sizes = list(rounded)
        found = configurations(sizes, [sum(n for _, n in rounded[s]) for s in sizes], capacity)
        for n, copies in found:
            parts = [[n, capacity, []]]
            for size, c in zip(sizes, copies):
                for _ in range(c):
                    queue, nxt = rounded[size], []
                    for run in parts:
                        while run[0]:
                            if not queue:
                                nxt.append(run)
                                break
                            length, have = queue[0]
                            m = min(run[0], have)
                            (_, free, items), run = cut_run(run, m)
                            nxt.append([m, free - length, [*items, (length, take(length, m), 1)]])
                            queue[0][1] -= m
                            if not queue[0][1]:
                                queue.pop(0)
                    parts = nxt
            runs.extend(p for p in parts if p[2])
    # best fit for the rest, longest first; runs of equal sequences by free room
    by_free: dict[int, list[list]] = {}
    for r in runs:
        by_free.setdefault(r[1], []).append(r)
    frees = sorted(by_free)
    done = []

    def put_back(run):
        if run[1] <= 0:
            done.append(run)
            return
        if run[1] not in by_free:
            insort(frees, run[1])
            by_free[run[1]] = []
        by_free[run[1]].append(run)

    for s in sorted(left, reverse=True):
        while left[s]:
            i = bisect_left(frees, s)
            if i < len(frees):
                free = frees[i]
                run = by_free[free].pop()
                if not by_free[free]:
                    del by_free[free]
                    frees.pop(i)
            else:
                run = [-(-left[s] // (capacity // s)), capacity, []]
            free = run[1]
            each = free // s
            full = min(run[0], left[s] // each)
            if full:
                (_, _, items), run = cut_run(run, full)
                put_back([full, free - each * s, [*items, (s, take(s, full * each), each)]])
            if run[0] and left[s]:
                rest = left[s]  # fewer than fill one sequence
                (_, _, items), run = cut_run(run, 1)
                put_back([1, free - rest * s, [*items, (s, take(s, rest), rest)]])
            if run[0]:
                put_back(run)
    out, first = [], 0
    for n, _, items in [*done, *(r for rs in by_free.values() for r in rs)]:
        offset = 0
        for length, rank, copies in items:
            out.append((length, rank, rank + n * copies, first, n, offset))
            offset += length * copies
        first += n
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY,
         settings=SETTINGS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece."""
    cut = pieces(docs, capacity, end_id, vocabulary)
    cut = (cut.withColumn("__key", F.xxhash64("doc_id", "piece", "ids_crc32"))
           .withColumn("__bucket", F.shiftright("__key", 52).cast("int")).withColumn("__one", F.lit(1).cast("long")))
    cut = written(cut, "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    places = cut.sparkSession.createDataFrame(
        plan(counts, capacity, settings) or [(0, 0, 0, 0, 1, 0)],
        "p_length long, lo long, hi long, first long, n long, at long")
    ranked = exclusive_prefix(cut, ["length"], "__bucket", ["__key", "doc_id", "piece"], "__one", "rank")
    here = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = ranked.join(F.broadcast(places), here)
    k = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + k % F.col("n")).alias("sequence_id"),
        (F.col("at") + F.floor(k / F.col("n")).cast("long") * F.col("length")).alias("offset"))


@register("op1_best_fit_pack")
def op1_best_fit_pack(spark, sf_dir: str) -> DataFrame:
    """Operator 1 over all documents."""
    return pack(table(spark, sf_dir, "documents"))
