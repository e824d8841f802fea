"""Operator 5: sharding by a hierarchical weighted hash tree (DataFrame functions only).

A document descends region -> rack -> shard.  On each level every child of the
node it has reached draws ``-ln(u) / weight`` with ``u`` hashed from (doc_id, child),
and the least draw wins, so a child is chosen in proportion to its weight.  A
child's draw depends on no other child: when a weight rises, or a child is
added, documents move only into that child; when it falls, only out of it.  The
weights above it stay, so all movement is inside the subtree that changed.

Shard ``s`` stands in rack ``s mod (regions * racks)``, and rack ``r`` in region
``r mod regions``.  One more shard is one more leaf (with a new rack or region
above it as long as those are not all in use), so it takes rows only into itself.

Edge cases: NULL text counts 8 bytes and has the CRC of an empty text; NULL
doc_ids hash alike and share a shard; repeated doc_ids go to one shard and take separate
slots; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathwise.llm.common import exclusive_prefix, table, written
from pathwise.llm.registry import register

SHARDS = 24
REGIONS = 2
RACKS = 3


def _descend(level: str, key: Column, children: Column, weights: dict[int, float]) -> Column:
    """The child of the least weighted hash draw; ``children`` is an array of node ids."""
    table_ = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv]) if weights else None

    def draw(child):
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(level), key, child), 11)
        u = (bits.cast("double") + 0.5) * F.lit(2.0 ** -53)
        weight = F.coalesce(F.element_at(table_, child), F.lit(1.0)) if weights else F.lit(1.0)
        return F.struct((-F.log(u) / weight).alias("draw"), child.alias("child"))

    return F.array_min(F.transform(children, draw))["child"]


def shard_of(key: Column, shards: int, regions: int = REGIONS, racks: int = RACKS,
             weights: dict[str, dict[int, float]] | None = None) -> Column:
    """Shard (0 to ``shards`` - 1) of a key.

    ``weights`` may give positive weights by level (``region``, ``rack``, ``shard``) and
    node number; all others weigh 1.
    """
    weights = weights or {}
    all_racks = regions * racks
    used = min(shards, all_racks)
    region = _descend("region", key, F.sequence(F.lit(0), F.lit(min(regions, shards) - 1)), weights.get("region", {}))
    rack = _descend("rack", key, F.sequence(region, F.lit(used - 1), F.lit(regions)), weights.get("rack", {}))
    return _descend("shard", key, F.sequence(rack, F.lit(shards - 1), F.lit(all_racks)), weights.get("shard", {}))


def shard(docs: DataFrame, shards: int = SHARDS, regions: int = REGIONS, racks: int = RACKS,
          weights: dict[str, dict[int, float]] | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard`` for every document.

    ``slot`` numbers a shard's rows from 0 without gaps, by a prefix count over
    ranges of a hash of the row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    rows = (rows.withColumn("shard", shard_of(F.col("doc_id"), shards, regions, racks, weights).cast("int"))
            .withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1, regions, racks, weights).cast("int"))
            .withColumn("__key", F.xxhash64("doc_id", "text_crc32", F.lit("slot")))
            .withColumn("__bucket", F.shiftright("__key", 52).cast("int"))
            .withColumn("__one", F.lit(1).cast("long")))
    rows = written(rows, "shards")
    return (exclusive_prefix(rows, ["shard"], "__bucket", ["__key", "doc_id", "size"], "__one", "slot")
            .select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"))


@register("op5_shard_documents")
def op5_shard_documents(spark, sf_dir: str) -> DataFrame:
    """Operator 5 over all documents: 24 shards, law ``key``."""
    return (shard(table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"))
