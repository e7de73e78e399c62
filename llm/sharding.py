"""Sharding by a hierarchical weighted hash tree: region, rack and shard are drawn level by level.

At every node each child gets a draw `-ln(u) / weight`, where `u` depends on the child's path and the
row's key alone, and the smallest draw wins. A child's draws never depend on its siblings, so when
a weight changes, rows move only into or out of the subtree that holds it.

A tree that gains a shard takes it as a new region of its own. Raising a weight inside an old
region would also draw rows of other regions into that region's old shards; with a region of its
own, every row that moves lands in the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import staged, table

# Ranges of the key's hash inside one shard, numbered one by one; bounds the rows one task numbers.
SLOT_RANGES = 4096


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. Leaves carry a shard number and a weight; others sum their children."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(shards: int, regions: int = 3, racks: int = 2, weights: dict[int, float] | None = None) -> Node:
    """`regions` x `racks` of equal size for the first full layout; every further shard is a region.

    The layout holds the largest multiple of `regions * racks` shards up to 24; shards beyond it were
    added one at a time. `weights` overrides the weight 1 of single shards.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    weights = weights or {}
    base = min(shards, 24) // (regions * racks) * regions * racks
    per = base // (regions * racks)
    leaf = lambda s, path: Node(f"{path}/s{s}", shard=s, own_weight=float(weights.get(s, 1.0)))
    top = []
    for r in range(regions if per else 0):
        rows = []
        for k in range(racks):
            first = (r * racks + k) * per
            rows.append(Node(f"r{r}/k{k}", tuple(leaf(s, f"r{r}/k{k}") for s in range(first, first + per))))
        top.append(Node(f"r{r}", tuple(rows)))
    for s in range(base, shards):
        top.append(Node(f"n{s}", (Node(f"n{s}/k0", (leaf(s, f"n{s}/k0"),)),)))
    return Node("root", tuple(top))


def _draw(key: Column, node: Node) -> Column:
    """Exponential draw of a child: 52 bits of an md5 as a number strictly between 0 and 1."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(node.name + "|"), key).cast("binary")), 1, 13), 16, 10)
    u = (digits.cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(node.weight)


def _choose(key: Column, node: Node) -> Column:
    if not node.children:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if not live:
        raise ValueError(f"{node.name} has no child with a weight above 0")
    if len(live) == 1:
        return _choose(key, live[0])
    draws = F.array(*[F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(live)])
    winner = F.array_min(draws)["i"]
    # Bind the winner once; a nested array_min per branch would repeat the draws of this level.
    return F.element_at(F.transform(F.array(winner), lambda w: _bound(w, live, key)), 1)


def _bound(w: Column, live: list[Node], key: Column) -> Column:
    case = F.when(w == 0, _choose(key, live[0]))
    for i, child in enumerate(live[1:], 1):
        case = case.when(w == i, _choose(key, child))
    return case


def place(key: Column, root: Node) -> Column:
    """Shard of a key under `root`. A null key is placed as an empty text."""
    return _choose(F.coalesce(key.cast("string"), F.lit("")), root).cast("int")


def with_slots(df: DataFrame, shard: str, key: Column, ties: list[Column]) -> DataFrame:
    """Add `slot`: positions 0, 1, ... inside each shard, without one task per shard.

    Rows fall into hash ranges of their key; the ranges of a shard are counted and summed (a table
    of at most shards x SLOT_RANGES rows), and only one range at a time is numbered. Repeated rows
    get different slots.
    """
    range_of = F.pmod(F.xxhash64(key, *ties), F.lit(SLOT_RANGES)).cast("int")
    rows = df.withColumn("_range", range_of)
    counts = rows.groupBy(F.col(shard).alias("_s"), F.col("_range").alias("_r")).count()
    before = Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_s", "_r", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_range").orderBy(key, *ties)
    numbered = rows.withColumn("_n", F.row_number().over(inside))
    joined = numbered.join(starts, (F.col(shard) == F.col("_s")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("slot", (F.col("_start") + F.col("_n") - 1).cast("long")).drop("_s", "_r", "_range", "_n", "_start")


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, text checksum, shard, slot and the shard after one more shard, per row.

    Law `key`: the key and the number of shards decide. Only DataFrame functions. A null text has
    no bytes (size 8, checksum 0); a null key is placed as empty text; repeated rows share a shard
    and get slots of their own; an empty table gives no rows; other columns are ignored.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(raw).cast("long") + 8).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(F.col(key), tree(shards)).alias("shard"),
        place(F.col(key), tree(shards + 1)).alias("grown_shard"),
    )
    # Small rows, read twice below: whole texts are scanned once.
    out = with_slots(staged(base, "shards"), "shard", F.col("doc_id"), [F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_weighted_tree(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(table(spark, folder, "documents"))


QUERIES = {"op3_weighted_tree": op3_weighted_tree}
