"""Operator 11: Merkle manifest of a dataset by nested-struct rollup.

Every row is a leaf.  Within its source the leaves stand in order, and while several nodes remain every ``ARITY``
consecutive ones (fewer in the last run) become the hash of their digests.  The sources' last nodes, in
order, make the root in the same way.

* A node's rank is written in base ``ARITY``.  Its last ``DIGITS`` digits are its place in a block, the others name the block.
* One shuffle brings a block together.  Its digits are then grouped away one by one, last first: a group's sorted
  array of child structs is nested into the parent's struct together with the parent's hash.
* A block is one node of the next story, whose blocks are made likewise, until every tree has one node.  A block has
  at most ``ARITY ** DIGITS`` nodes however large its source is, so no task gathers a source.
* On the way down a block's row and the row with the siblings above it are grouped together by the block's name;
  ``transform`` walks the nested structs, adds each node's siblings to those above it, and ``explode`` emits one row a
  node.  Nothing is joined.

Ranks come from a written range partitioning and a prefix sum of its counts, so a hot source is spread over many tasks.

``H`` is lowercase hex SHA-256 of its inputs' concatenation; digests enter as hex text.

Edge cases: NULL sources form one source of their own, first in order; rows of a source with equal (or NULL, first)
doc_id stand in order of their leaves, so equal rows stand together, each with its own place; a NULL column enters a leaf
as ``-``, an empty text as ``0:``; rows without doc_id are never tampered with; a missing ``lang``, ``source`` or ``n_chars``
is NULL; an empty table has no root and gives an empty result; other columns take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathwise.llm.common import table, written
from pathwise.llm.registry import register

ARITY = 16
DIGITS = 3
BLOCK = ARITY ** DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The siblings of one level: the joined digests left and right of the path.
STEP = "struct<left: string, right: string>"


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` or its length in bytes, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(columns[c]) for c in FIELDS]), 256)


def ranked(rows: DataFrame, tree: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``rank`` (from 0, by ``order``) within ``tree`` and ``n``, the number of rows there; written.

    Rows are dealt by ranges of (tree, order), which puts a large tree on many tasks; a range's offset is the sum of
    the counts before it.
    """
    parts = written(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in [*tree, *order]])
                    .withColumn("part", F.spark_partition_id()), f"{name}-ranges")
    counts = parts.groupBy(*tree, "part").agg(F.count("*").alias("inside"))
    whole = Window.partitionBy(*tree)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"t_{c}") for c in tree], F.col("part").alias("t_part"),
                           F.coalesce(F.sum("inside").over(before), F.lit(0)).alias("offset"), F.sum("inside").over(whole).alias("n"))
    here = Window.partitionBy(*tree, "part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    same = F.col("part") == F.col("t_part")
    for c in tree:
        same = same & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    return (parts.withColumn("inside", F.row_number().over(here) - 1).join(counts, same)
            .withColumn("rank", (F.col("offset") + F.col("inside")).cast("long"))
            .drop("part", "inside", "offset", "t_part", *[f"t_{c}" for c in tree]))


def _parent(level: int) -> Column:
    """Hash of the node over ``kids``; a tree that has come down to one node keeps it."""
    joined = F.array_join(F.transform("kids", lambda k: k["hash"]), "")
    return F.when(F.col("n") > ARITY ** level, F.sha2(joined, 256)).otherwise(F.col("kids")[0]["hash"])


def _digit(level: int) -> Column:
    return F.shiftright(F.col("rank"), 4 * level).bitwiseAND(ARITY - 1).cast("int")


def story_up(nodes: DataFrame, tree: list[str], payload: list[str], name: str) -> DataFrame:
    """Blocks of ``nodes(*tree, n, rank, hash, *payload)``: a row a block with its hash and its nested ``kids``; written.

    All groupings share the first one's shuffle, which goes by tree and block.
    """
    block = [*tree, "n", "block"]
    rows = nodes.withColumn("block", F.shiftright("rank", 4 * DIGITS))
    rows = rows.select(*block, *[_digit(level).alias(f"d{level}") for level in range(DIGITS)],
                       F.struct(F.col("rank"), "hash", *payload).alias("kid")).repartition(*block)
    up = rows
    for level in range(DIGITS):
        higher = [f"d{d}" for d in range(level + 1, DIGITS)]
        kid = F.col("kid") if level == 0 else F.struct(F.col(f"d{level}"), "hash", "kids")
        up = (up.groupBy(*block, *higher).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
              .withColumn("hash", _parent(level)))
    return written(up.select(*block, "hash", "kids"), f"{name}-blocks")


def _siblings(kids: Column, at: Column) -> Column:
    """The digests left and right of child ``at``."""
    joined = lambda part: F.array_join(F.transform(part, lambda k: k["hash"]), "")
    return F.struct(joined(F.slice(kids, F.lit(1), at)).alias("left"),
                    joined(F.slice(kids, at + 2, F.size(kids))).alias("right"))


def story_down(blocks: DataFrame, above: DataFrame, tree: list[str], carry: list[str]) -> DataFrame:
    """``*tree, rank, node, path, *carry`` of every node in ``blocks``.

    ``above(*tree, rank, path, *carry)`` has the path of every block as a node of the story above; ``path`` lists
    the siblings of each hashed level, lowest first.
    """
    depth = DIGITS
    no_kids = F.lit(None).cast(blocks.schema["kids"].dataType)
    named = above.select(*tree, F.lit(None).cast("long").alias("n"), F.col("rank").alias("block"), no_kids.alias("kids"),
                         F.struct("path", *carry).alias("top"))
    mine = blocks.select(*tree, "n", "block", "kids", F.lit(None).cast(named.schema["top"].dataType).alias("top"))
    met = mine.unionByName(named).groupBy(*tree, "block").agg(
        F.max("n").alias("n"), F.first("kids", ignorenulls=True).alias("kids"), F.first("top", ignorenulls=True).alias("top"))

    def steps(kids: Column, level: int, upper: Column):
        """Array of structs (node, path) for all nodes under ``kids``, the children on ``level``."""
        hashed = F.col("n") > ARITY ** level
        # nothing is hashed on a level where the tree has one node already

        def one(kid: Column, at: Column) -> Column:
            mine = F.when(hashed, F.array(_siblings(kids, at))).otherwise(F.array().cast(f"array<{STEP}>"))
            path = F.concat(mine, upper)
            if level == 0:
                return F.array(F.struct(kid.alias("node"), path.alias("path")))
            return steps(kid["kids"], level - 1, path)

        return F.flatten(F.transform(kids, one))

    each = F.explode(steps(F.col("kids"), depth - 1, F.col("top.path")))
    return (met.select(*tree, *[F.col(f"top.{c}").alias(c) for c in carry], each.alias("at"))
            .select(*tree, F.col("at.node.rank").alias("rank"), F.col("at.node").alias("node"), F.col("at.path").alias("path"), *carry))


def stories(nodes: DataFrame, tree: list[str], payload: list[str], name: str) -> list[DataFrame]:
    """Block tables of all stories, lowest first; the last has one block in every tree."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    made = []
    while True:
        made.append(story_up(nodes, tree, payload, name))
        if most <= BLOCK:
            return made
        most = -(-most // BLOCK)
        payload = []
        nodes = made[-1].select(*tree, F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("block").alias("rank"), "hash")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


def build(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, path, shown`` for every row of ``docs``; ``path`` holds the siblings by level.

    ``shown`` is the leaf of the row as an auditor finds it: with the A-Z of its text lower-cased where ``tamper``
    (a condition on the columns of ``FIELDS``) holds.
    """
    kind = {"doc_id": "long", "n_chars": "long"}
    docs = docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(kind.get(c, "string")).alias(c) for c in FIELDS])
    cols = {c: F.col(c) for c in FIELDS}
    leaf = leaf_of(cols)
    touched = F.lit(False) if tamper is None else F.coalesce(tamper, F.lit(False)) & F.col("text").isNotNull()
    other = F.when(touched, leaf_of(cols | {"text": F.translate("text", UPPER, LOWER)}))
    leaves = ranked(docs.select("source", "doc_id", leaf.alias("hash"), other.alias("other")),
                    ["source"], ["doc_id", "hash", "other"], "manifest")
    low = stories(leaves, ["source"], ["doc_id", "other"], "manifest")
    top = low[-1].select(F.lit(0).alias("all"), "source", "hash")
    high = stories(ranked(top, ["all"], ["source"], "manifest-sources"), ["all"], ["source"], "manifest-sources")
    nothing = F.array().cast(f"array<{STEP}>")
    above = high[-1].select("all", F.col("block").alias("rank"), nothing.alias("path"), F.col("hash").alias("root"))
    for blocks in reversed(high):
        above = story_down(blocks, above, ["all"], ["root"])
    above = above.select(F.col("node.source").alias("source"), F.lit(0).cast("long").alias("rank"), "path", "root",
                         F.col("node.hash").alias("subroot"))
    for blocks in reversed(low):
        above = story_down(blocks, above, ["source"], ["root", "subroot"])
    node = F.col("node")
    return above.select(node["doc_id"].alias("doc_id"), node["hash"].alias("leaf"), "subroot", "root", "path",
                        F.coalesce(node["other"], node["hash"]).alias("shown"))


def audited(proofs: DataFrame) -> DataFrame:
    """The digest of each proof, the root recomputed from ``shown`` and the siblings, and whether it is the root."""
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    return (proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                          fold(F.col("shown"), F.col("path")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def _crc_table() -> str:
    """The table of CRC-32 (reflected polynomial 0xEDB88320) as a SQL list."""
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        out.append(str(i))
    return f"([{', '.join(out)}]::UBIGINT[])"


def crc32_sql(chars: str) -> str:
    """DuckDB expression: CRC-32 of the UTF-8 bytes of a list of characters below code point 256."""
    codes = f"flatten(list_transform({chars}, lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))"
    return (f"xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform({codes}, lambda v: v::UBIGINT)), "
            f"lambda acc, b: xor(acc >> 8, {_crc_table()}[(xor(acc & 255, b) + 1)::BIGINT])))")


def _oracle(levels: int = 6) -> str:
    """The same trees with one CTE a level, for up to ``ARITY ** levels`` leaves a source and as many sources."""
    def entry(c):
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def leaf(text):
        return "sha256(" + " || ".join(entry(text if c == "text" else c) for c in FIELDS) + ")"

    def tree(name, keys, base):
        """CTEs ``name0`` (from ``base``) up to the last level: keys, i, h, n."""
        out = [f"{name}0 AS ({base})"]
        on = ", ".join(keys)
        for x in range(levels):
            out.append(f"{name}{x + 1} AS (SELECT {on}, i // {ARITY} AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) "
                       f"ELSE max(h) END AS h, (max(n) + {ARITY - 1}) // {ARITY} AS n FROM {name}{x} GROUP BY {on}, i // {ARITY})")
        return out

    def paths(name, keys):
        """CTEs with the joined digests left and right of every node of every level."""
        on = ", ".join(keys)
        run = f"PARTITION BY {on}, i // {ARITY} ORDER BY i"
        return [f"{name}_path{x} AS (SELECT {on}, i, n, coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') "
                f"AS l, coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{x})"
                for x in range(levels)]

    rows = (f"SELECT doc_id, coalesce('s' || source, '') AS s, {leaf('text')} AS leaf, "
            f"CASE WHEN {crc32_sql('string_split(doc_id::VARCHAR, {0})'.format(chr(39) * 2))} % 5 = 0 "
            f"THEN {leaf(f'''translate(text, '{UPPER}', '{LOWER}')''')} ELSE {leaf('text')} END AS shown FROM documents")
    ctes = [f"d AS ({rows})",
            "o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)"]
    ctes += tree("a", ["s"], "SELECT s, i, leaf AS h, count(*) OVER (PARTITION BY s) AS n FROM o")
    ctes += [f"subroots AS (SELECT s, h AS subroot, row_number() OVER (ORDER BY s) - 1 AS i FROM a{levels})"]
    ctes += tree("b", ["t"], "SELECT 0 AS t, i, subroot AS h, count(*) OVER () AS n FROM subroots")
    ctes += paths("a", ["s"]) + paths("b", ["t"])
    joins, siblings, last = "", [], "o.shown"
    steps = []
    for name, at, key in (("a", "o.i", "s = o.s"), ("b", "subroots.i", "t = 0")):
        for x in range(levels):
            p = f"{name}_path{x}"
            joins += f" JOIN {p} ON {p}.{key} AND {p}.i = {at} // {ARITY ** x}"
            siblings.append(f"{p}.l || {p}.r")
            steps.append((p, last))
            last = f"f{len(steps)}"
    lateral = ", ".join(f"CASE WHEN {p}.n > 1 THEN sha256({p}.l || {prev} || {p}.r) ELSE {prev} END AS f{k + 1}" for k, (p, prev) in enumerate(steps))
    ctes.append(f"proofs AS (SELECT o.doc_id, o.leaf, subroot, sha256({' || '.join(siblings)}) AS proof_sha256, {lateral} "
                f"FROM o JOIN subroots ON subroots.s = o.s{joins})")
    return (f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, (SELECT max(h) FROM b{levels}) AS root, proof_sha256, {last} AS folded_root, "
            f"{last} = (SELECT max(h) FROM b{levels}) AS verified FROM proofs")


@register("op11_merkle_manifest", _oracle())
def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Operator 11 over all documents; every fifth by hash is found tampered with."""
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return audited(build(table(spark, sf_dir, "documents"), fifth))
