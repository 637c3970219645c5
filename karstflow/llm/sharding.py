"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

Each row draws an exponential clock for every shard, `-ln(u) / weight`, from a
hash of its id and the shard's name. A rack's draw is the least clock below it
and a region's the least of its racks, so a subtree draws with its summed
weight. A row descends from the root to the least draw at each level. A draw
depends on the id and the leaf alone: when a shard is added or its weight
raised, draws change only on the path above it, and a row moves only if the
changed leaf now has its least draw, so it moves into that leaf.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karstflow.llm.common import dense_rank_in_groups, parallelism, texts, written


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 2, weights: dict[int, float] | None = None, regions: dict[int, float] | None = None) -> list[Leaf]:
    """The leaves of a tree that is filled region by region, so that a tree of n+1 shards has that of n inside it.

    weights: of shards; regions: factors on all weights of a region. Others are 1.
    """
    per_region = racks_per_region * shards_per_rack
    return [Leaf(s, s // per_region, s // shards_per_rack % racks_per_region, (weights or {}).get(s, 1.0) * (regions or {}).get(s // per_region, 1.0)) for s in range(shards)]


def _draw(key: Column, leaf: Leaf) -> Column:
    """struct(draw, region, rack, shard): a leaf's exponential clock, least first."""
    # 53 bits of the hash, moved off zero, make a uniform draw in (0, 1).
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"leaf-{leaf.shard}")), 11)
    clock = -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(leaf.weight)
    return F.struct(clock.alias("draw"), F.lit(leaf.region).alias("region"), F.lit(leaf.rack).alias("rack"), F.lit(leaf.shard).alias("shard"))


def place(key: Column, leaves: list[Leaf]) -> Column:
    """struct(region, rack, shard) of a key; a null key is a key like any other.

    Racks take the least draw of their shards, regions that of their racks, the
    root that of its regions; the row goes where the least comes from. The
    expression grows with the leaves, not with their square. A tree without
    weight is an error.
    """
    key = F.coalesce(key.cast("string"), F.lit("\x00null"))
    by: dict[int, dict[int, list[Leaf]]] = {}
    for x in leaves:
        if x.weight > 0:
            by.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    if not by:
        raise ValueError("no shard has weight")
    regions = F.array(*[F.array_min(F.array(*[F.array_min(F.array(*[_draw(key, x) for x in rack])) for rack in racks.values()])) for racks in by.values()])
    return F.element_at(F.transform(F.array(F.array_min(regions)), lambda x: F.struct(x["region"].alias("region"), x["rack"].alias("rack"), x["shard"].alias("shard"))), 1)


def shard_rows(docs: DataFrame, shards: int = 8, weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack: one row for each document.

    size: UTF-8 bytes of the text (null: none) plus 1. slot: the row's place in
    its shard, gapless from 0. grown_shard: where it lies with one more shard.
    Equal doc_ids go together; repeated rows keep a slot each. An empty table
    gives no rows. A row is reduced to its id, size and checksum, written once
    with a number of its own, and dealt by that number, so that neither a shard
    nor an id that many rows share is numbered in one task.
    """
    raw = F.encode(F.col("text"), "utf-8")
    rows = texts(docs).select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        place(F.col("doc_id"), tree(shards, weights=weights)).alias("_at"),
        place(F.col("doc_id"), tree(shards + 1, weights=weights))["shard"].alias("grown_shard"),
    )
    rows = rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("_at.shard").alias("shard"), "grown_shard", F.col("_at.region").alias("region"), F.col("_at.rack").alias("rack"))
    rows = written(rows.withColumn("_uid", F.monotonically_increasing_id()), "sharded")
    slotted = dense_rank_in_groups(rows, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("_uid")], F.col("_uid"), "slot", max(16, parallelism(docs.sparkSession)))
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")
