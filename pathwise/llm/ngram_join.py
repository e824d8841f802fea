"""Operator 2: n-gram Jaccard join over prefix trees, exact, with connected components.

A document's set holds 64-bit hashes of its distinct word n-grams.  Two sets link when their Jaccard
similarity reaches the threshold.  No link between different sets is lost:

1. *Sift.*  In any total order, two sets that link share at least ``l`` members among their first
   ``|x| - ceil(t |x|) + l``.  With the order of hash values, those prefixes are counted over all documents;
   a document with too few prefix members that also stand in a different set's prefix links with nothing.  The
   shared members are looked up in a bit field of bounded size: a full field only lets more through.
2. *Order.*  For the rest, equal sets become one class, members are counted globally, members that
   stand in one class only are dropped (their number is kept), and each set is ordered rarest first.  Sets
   with fewer than ``t |x|`` shared members are done.
3. *Stars.*  Sets that link share a prefix member, within size and remaining-length bounds.  In the block of every
   prefix member the set with the fewest members of its own leads.  A leader's followers are put into a
   trie of ordered sets; the leader walks it, summing overlaps once for all sets that share a path, and leaves a subtree when
   what remains cannot reach the needed overlap.  Links give components; blocks inside one component are
   closed.  In the open ones the components then meet by one drawn set each.
4. *Rest.*  At last all pairs from different components that meet in an open block go through the same
   trie walk.  Pairs inside one component are never formed, so a group of near copies costs its size, not its square.

Leaders of many members are split into chunks, so no task holds more than ``CHUNK`` sets at a time.

Edge cases: NULL or wordless text has an empty set and links with nothing (its component is itself); a text of fewer than ``n``
words is one n-gram; rows with NULL doc_id take part, but no component is named by NULL unless all are; repeated rows are
equal sets; an empty table gives an empty result.  Distinct n-grams or sets of equal 64- or 128-bit hashes would be
taken for one another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pandas.util import hash_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathwise.llm.common import discard, id_text, ids_back, table, written
from pathwise.llm.graph import components
from pathwise.llm.registry import register

N = 5
#: The threshold as a fraction.
NUM, DEN = 80, 100
#: Extra prefix members per set size: one in SIFT.
SIFT = 10
#: Bits of the field per shared member, its greatest size (16 MB), and the words of a piece of it.
FIELD_BITS, MAX_FIELD, SEGMENT = 8, 1 << 27, 1 << 13
CHUNK = 512
#: Counting tells members apart by their upper 48 bits and sets by 48 bits of their prints, which keeps the shuffles small:
#: members of equal upper bits count as shared, which only lets more through.
SHORT = 16
#: Columns of a row's key.
ROW_KEY = ("__row_a", "__row_b")

MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                              0xA0761D6478BD642F)]


def _mixed(h: np.ndarray, c: np.uint64 = MIX[1]) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * c
    h = (h ^ (h >> np.uint64(27))) * MIX[2]
    return h ^ (h >> np.uint64(31))


def ngram_sets(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word n-grams."""
    words = [(t or "").encode().lower().split() for t in texts]
    sizes = np.asarray([len(w) for w in words], dtype=np.int64)
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = [w for ws in words for w in ws]
    hashes = hash_array(flat, categorize=False) if len(flat) else np.zeros(0, dtype=np.uint64)
    grams = np.zeros(max(0, len(hashes) - n + 1), dtype=np.uint64)
    for k in range(n):
        grams += hashes[k:len(hashes) - n + 1 + k] * _mixed(np.asarray([k + 1], dtype=np.uint64), MIX[0])[0]
    grams = _mixed(grams)
    out, at = [], 0
    for size in sizes:
        if size >= n:
            own = np.sort(grams[at:at + size - n + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif size:
            h = np.asarray([size], dtype=np.uint64)
            for x in hashes[at:at + size]:
                h = _mixed(h * MIX[3] + x)
            out.append(h)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += size
    return out


def least_overlap(n: int) -> int:
    """A set of ``n`` members shares at least so many with any set it links with."""
    return -(-NUM * n // DEN)


def sift_prefix(n: int) -> int:
    return n - least_overlap(n) + n // SIFT + 1 if n else 0


def sift_least(n: int) -> int:
    """So many prefix members must be shared: the smallest partner's extra members."""
    return least_overlap(n) // SIFT + 1


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    return (int(_mixed(s, MIX[3]).sum(dtype=np.uint64).astype(np.int64)),
            int(_mixed(s, MIX[4]).sum(dtype=np.uint64).astype(np.int64)))


def _sets(frame: pd.DataFrame):
    for at in range(0, len(frame), 256):
        part = frame.iloc[at:at + 256]
        yield part, ngram_sets(part["text"].tolist())


def _places(members: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit numbers for each member's upper bits (a whole number with sign)."""
    members = members.view(np.uint64)
    return (_mixed(members, MIX[3]) % np.uint64(bits), _mixed(members, MIX[4]) % np.uint64(bits))


def shared_field(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Bit field over prefix members that stand in the prefixes of at least two different sets."""

    def run(frames):
        for frame in frames:
            for _, sets in _sets(frame):
                cut = [s[:sift_prefix(len(s))] for s in sets]
                prints = np.asarray([fingerprint(s)[0] for s in sets], dtype=np.int64) >> SHORT
                yield pd.DataFrame({"member": np.concatenate(cut).view(np.int64) >> SHORT,
                                    "print": np.repeat(prints, [len(c) for c in cut])})

    members = docs.select("text").mapInPandas(run, "member long, print long")
    shared = written(members.groupBy("member").agg(F.min("print").alias("lo"), F.max("print").alias("hi"))
                     .filter(F.col("lo") != F.col("hi")).select("member"), "shared")
    bits = 1 << 20
    wanted = shared.count() * FIELD_BITS
    while bits < min(wanted, MAX_FIELD):
        bits *= 2

    def place(frames):
        for frame in frames:
            at = np.concatenate(_places(frame["member"].to_numpy(), bits))
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64),
                                "bit": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    def assemble(key, frame):
        part = np.zeros(SEGMENT, dtype="<u8")
        part[frame["word"].to_numpy() % SEGMENT] = frame["bits"].to_numpy().view(np.uint64)
        return pd.DataFrame({"segment": [key[0]], "data": [part.tobytes()]})

    words = shared.mapInPandas(place, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    segments = (words.withColumn("segment", F.floor(F.col("word") / SEGMENT)).groupBy("segment")
                .applyInPandas(assemble, "segment long, data binary"))
    field = np.zeros(bits // 64, dtype=np.uint64)
    for r in segments.collect():  # the field itself: at most MAX_FIELD bits
        field[r["segment"] * SEGMENT:(r["segment"] + 1) * SEGMENT] = np.frombuffer(r["data"], dtype="<u8")
    return field, bits


def sifted_sets(docs: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n, cid, members`` and the columns ``key`` (long): a set's size and class id; members only of sets
    that may link."""
    field, bits = shared_field(docs)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # at most MAX_FIELD bits

    def run(frames):
        for frame in frames:
            for part, sets in _sets(frame):
                members, ids = [], []
                for s in sets:
                    a, b = fingerprint(s)
                    ids.append(f"{a & (2 ** 64 - 1):016x}{b & (2 ** 64 - 1):016x}{len(s):x}")
                    cut = s[:sift_prefix(len(s))]
                    hit = np.ones(len(cut), dtype=bool)
                    for at in _places(cut.view(np.int64) >> SHORT, bits):
                        hit &= (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                    members.append(s.view(np.int64) if len(s) and hit.sum() >= sift_least(len(s)) else None)
                yield pd.DataFrame({"doc_id": part["doc_id"].values, "n": [len(s) for s in sets],
                                    "cid": ids, "members": members, **{k: part[k].values for k in key}})

    rows = docs.select(id_text("doc_id"), "text", *key)
    schema = ", ".join(["doc_id string, n long, cid string, members array<long>", *[f"{k} long" for k in key]])
    return written(ids_back(rows.mapInPandas(run, schema), "doc_id"), "sets")


def numbered_classes(sets: DataFrame) -> DataFrame:
    """``id, cid``: a short number for every class that may link, fixed by writing it."""
    return written(sets.filter(F.col("members").isNotNull()).select("cid").distinct()
                   .select(F.monotonically_increasing_id().alias("id"), "cid"), "classes")


def ordered_classes(sets: DataFrame, numbers: DataFrame) -> DataFrame:
    """``id, n, members``: shared members only, rarest first, of classes that still may link."""
    classes = (sets.filter(F.col("members").isNotNull()).groupBy("cid").agg(F.first("members").alias("members"))
               .join(numbers, "cid"))
    long = classes.select("id", F.explode("members").alias("member")).withColumn("short", F.shiftright("member", SHORT))
    often = long.groupBy("short").agg(F.count("*").alias("df")).filter(F.col("df") > 1)
    sizes = numbers.select("id", F.conv(F.substring("cid", 33, 16), 16, 10).cast("long").alias("n"))  # a class' id ends with its size
    ordered = (long.join(often, "short").groupBy("id")
               .agg(F.sort_array(F.collect_list(F.struct("df", "member")))["member"].alias("members")).join(sizes, "id"))
    return written(ordered.filter(F.size("members") * DEN >= F.col("n") * NUM).select("id", "n", "members"), "ordered")


class Trie:
    """Ordered sets sorted by their paths; a node is a range of sets and a depth."""

    def __init__(self, ids: list, sizes: np.ndarray, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
        self.ids = [ids[i] for i in order]
        self.sizes = np.asarray(sizes)[order]
        self.sets = [sets[i] for i in order]
        self.lengths = np.asarray([len(s) for s in self.sets])
        self.common = np.zeros(len(order), dtype=np.int64)  # leading members shared with the set before
        for i in range(1, len(order)):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            self.common[i] = differ.argmax() if differ.any() else m

    def linked(self, probe: np.ndarray, n: int) -> list:
        """Ids of the sets that link with the probe's (``n`` members, of which ``probe`` are shared)."""
        place = {x: i for i, x in enumerate(probe.tolist())}
        found, todo = [], [(0, len(self.sets), 0, 0, 0)]
        while todo:
            lo, hi, depth, overlap, passed = todo.pop()
            end = int(self.common[lo + 1:hi].min()) if hi - lo > 1 else int(self.lengths[lo])
            # remaining-length bound: what the subtree's longest set and the probe can still share
            room = min(int(self.lengths[lo:hi].max()) - depth, len(probe) - passed)
            if (NUM + DEN) * (overlap + room) < NUM * (n + int(self.sizes[lo:hi].min())):
                continue
            for member in self.sets[lo][depth:end].tolist():
                at = place.get(member)
                if at is not None:
                    overlap += 1
                    passed = at + 1
            while lo < hi and int(self.lengths[lo]) == end:  # sets that end here come first
                if (NUM + DEN) * overlap >= NUM * (n + int(self.sizes[lo])):
                    found.append(self.ids[lo])
                lo += 1
            if lo < hi:
                cuts = [lo, *(lo + 1 + np.flatnonzero(self.common[lo + 1:hi] == end)).tolist(), hi]
                todo += [(a, b, end, overlap, passed) for a, b in zip(cuts, cuts[1:])]
        return found


def leader_chunks(stars: DataFrame) -> DataFrame:
    """``leader, chunk, id`` of the pairs ``leader, id``: a leader's pairs in chunks of about ``CHUNK``; written."""
    load = stars.groupBy("leader").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    stars = stars.join(load, "leader").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    return written(stars.select("leader", "chunk", "id"), "stars")


def star_links(stars: DataFrame, ordered: DataFrame) -> DataFrame:
    """Of the pairs ``leader, id`` of chunks those that link, as ``a, b``."""
    members = stars.join(ordered, "id").select("leader", "chunk", F.lit(1).alias("part"), "id", "n", "members")
    heads = (stars.select("leader", "chunk").distinct().join(ordered.withColumnRenamed("id", "leader"), "leader")
             .select("leader", "chunk", F.lit(0).alias("part"), F.col("leader").alias("id"), "n", "members"))
    n = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames):
        head, held = None, []

        def walk():
            if head is None or not held:
                return None
            trie = Trie([r[0] for r in held], np.asarray([r[1] for r in held]), [r[2] for r in held])
            found = trie.linked(head[3], head[2])
            return pd.DataFrame({"a": [head[0]] * len(found), "b": found}) if found else None

        for frame in frames:
            for leader, chunk, part, id_, size, members_ in frame.itertuples(index=False, name=None):
                if head is None or (leader, chunk) != head[:2]:
                    links = walk()
                    if links is not None:
                        yield links
                    head, held = None, []
                if part == 0:
                    head = (leader, chunk, size, members_)
                else:
                    held.append((id_, size, members_))
        links = walk()
        if links is not None:
            yield links

    return (members.unionByName(heads).repartition(n, "leader", "chunk")
            .sortWithinPartitions("leader", "chunk", "part", "id").mapInPandas(run, "a long, b long"))


def open_entries(ordered: DataFrame, labels: DataFrame) -> DataFrame:
    """``member, id, comp, n, most``: prefix members of classes in blocks that still span several components.

    With its entry as first common member a set shares at most what follows, so partners may not be larger than ``most``.
    """
    labelled = ordered.join(labels.withColumnRenamed("node", "id"), "id", "left")
    unique = F.col("n") - F.size("members")  # rarest of all: they come first in the global order
    prefix = F.size("members") - F.ceil(F.col("n") * NUM / DEN) + 1
    entries = labelled.select("id", F.coalesce("comp", "id").alias("comp"), "n", unique.alias("unique"),
                              F.posexplode(F.slice("members", F.lit(1), F.greatest(prefix.cast("int"), F.lit(0)))).alias("i", "member"))
    left = F.col("n") - F.col("unique") - F.col("i")
    most = F.least(F.floor((left * (NUM + DEN) - F.col("n") * NUM) / NUM), F.floor(F.col("n") * DEN / NUM))
    entries = entries.select("member", "id", "comp", "n", most.cast("long").alias("most"))
    blocks = (entries.groupBy("member").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("n").alias("least"))
              .filter(F.col("c0") != F.col("c1")).select("member", "least"))
    return written(entries.join(blocks, "member").filter(F.col("least") <= F.col("most")).drop("least"), "entries")


def led_pairs(entries: DataFrame) -> DataFrame:
    """``leader, id``: every class with the leaders of its blocks, where they are from another component and may link.

    A block's leader is the set with the fewest members of its own.
    """
    lead = entries.groupBy("member").agg(F.max(F.struct("most", "n", "id", "comp")).alias("lead"))
    met = entries.join(lead, "member")
    fits = ((F.col("comp") != F.col("lead.comp")) & (F.col("n") <= F.col("lead.most")) & (F.col("lead.n") <= F.col("most")))
    return met.filter(fits).select(F.col("lead.id").alias("leader"), "id").distinct()


def chained_pairs(entries: DataFrame) -> DataFrame:
    """``leader, id``: in every block each component sends one set, drawn by hash, to meet that of the component
    next in size."""
    drawn = F.struct(F.xxhash64("id", "member").alias("h"), "id", "n", "most")
    sent = entries.groupBy("member", "comp").agg(F.min(drawn).alias("own"))
    by_size = Window.partitionBy("member").orderBy("own.n", "comp")
    met = sent.withColumn("other", F.lag("own").over(by_size))
    fits = (F.col("own.n") <= F.col("other.most")) & (F.col("other.n") <= F.col("own.most"))
    return met.filter(fits).select(F.col("other.id").alias("leader"), F.col("own.id").alias("id")).distinct()


def all_pairs(entries: DataFrame) -> DataFrame:
    """``leader, id``: all pairs of classes from different components that may still link."""
    a, b = entries.alias("a"), entries.alias("b")
    fits = ((F.col("a.member") == F.col("b.member")) & (F.col("a.comp") < F.col("b.comp"))
            & (F.col("a.n") <= F.col("b.most")) & (F.col("b.n") <= F.col("a.most")))
    return a.join(b, fits).select(F.col("a.id").alias("leader"), F.col("b.id").alias("id")).distinct()


#: How the open blocks' sets meet, pass by pass; the last one leaves nothing out.
PASSES = (led_pairs, chained_pairs, all_pairs)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (``node, comp``) after ``links`` (``a, b``) have joined components."""
    links = written(links, "links")
    named = lambda x, new: labels.select(F.col("node").alias(x), F.col("comp").alias(new))
    bridges = (links.join(named("a", "ca"), "a", "left").join(named("b", "cb"), "b", "left")
               .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    found = components(bridges)
    tops = found.toDF("comp", "top")
    fresh = tops.select(F.col("comp").alias("node"), "comp").join(labels.select("node"), "node", "left_anti")
    after = written(labels.unionByName(fresh).join(tops, "comp", "left")
                    .select("node", F.coalesce("top", "comp").alias("comp")), "merged")
    discard(links, found, labels)
    return after


def labelled_rows(docs: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n, comp`` and the columns ``key`` of every row: ``comp`` labels the component, also where doc_ids repeat."""
    sets = sifted_sets(docs, key)
    numbers = numbered_classes(sets)
    ordered = ordered_classes(sets, numbers)
    labels = docs.sparkSession.createDataFrame([], "node long, comp long")
    for pick in PASSES:
        entries = open_entries(ordered, labels)
        stars = leader_chunks(pick(entries))
        labels = merged(labels, star_links(stars, ordered))
        discard(entries, stars)
    labels = labels.withColumnRenamed("node", "id").join(numbers, "id").select("cid", F.col("comp").cast("string").alias("comp"))
    docs_ = sets.select("doc_id", "n", "cid", *key).join(labels, "cid", "left").select(
        "doc_id", "n", F.coalesce("comp", "cid").alias("comp"), *key)
    return written(docs_, "components")


def near_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, comp``: ``comp`` as in ``labelled_rows``."""
    docs_ = labelled_rows(docs)
    least = docs_.filter(F.col("n") > 0).groupBy("comp").agg(F.min("doc_id").alias("least"))
    return docs_.join(least, "comp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "comp")


def row_key(docs: DataFrame) -> list:
    """Two 64-bit hashes of a row's whole content, NULLs told from values: rows of one key are interchangeable."""
    cells = []
    for field in docs.schema.fields:
        c = F.col(f"`{field.name}`")
        cells += [c.isNull(), F.to_json(F.struct(c)) if "map<" in field.dataType.simpleString() else c]  # maps have no hash
    return [F.xxhash64(F.lit(seed), *cells).alias(name) for seed, name in enumerate(ROW_KEY)]


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with one left of every component: its row of least doc_id, then least key.

    Of a component's rows without doc_id one stays too, and rows without words all stay.  Rows count, not ids: a doc_id
    on rows of different components stays in each of them.
    """
    keyed = docs.select("*", *row_key(docs))
    kept = (labelled_rows(keyed, ROW_KEY).filter(F.col("n") > 0)
            .groupBy("comp", F.col("doc_id").isNull().alias("nameless")).agg(F.min(F.struct("doc_id", *ROW_KEY)).alias("row"))
            .select(*[f"row.{k}" for k in ROW_KEY]))
    wordy = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    named = keyed.filter(wordy).join(kept, list(ROW_KEY), "left_semi").dropDuplicates(list(ROW_KEY))
    return named.select(docs.columns).unionByName(docs.filter(~wordy))


@register("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Operator 2 over all documents."""
    return near_components(table(spark, sf_dir, "documents")).drop("comp")
