"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

At every node a document draws -ln(u) / weight for each child, u from a hash of its id and the child's name, and
descends to the smallest draw.  A child's share is its weight's share; a node's weight is the sum of its
shards'.  If a weight changes, draws of other children stay as they were: documents move only into children that
gained or out of those that lost, and only the subtrees on that path see any movement.  ``grown`` adds a shard as
a region of its own, so whatever moves, moves into the new shard.

Null text has no bytes (size 1, crc 0).  A null id hashes as null does, all such rows go to one shard.  Repeated
rows share a shard and get slots of their own, in order of id, then crc; ties beyond are equal rows.  An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a shard that are numbered on their own.
BUCKETS = 1024
#: A tree: regions of racks of shards (shard number, weight).
Shard = tuple[int, float]
Tree = Sequence[Sequence[Sequence[Shard]]]


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> list[list[list[Shard]]]:
    """Shards of weight 1, filled into racks and regions in order."""
    leaves = [(k, 1.0) for k in range(shards)]
    rows = [leaves[k : k + per_rack] for k in range(0, shards, per_rack)]
    return [rows[k : k + racks] for k in range(0, len(rows), racks)]


def grown(tree: Tree, weight: float = 1.0) -> list:
    """One more shard, in a region of its own."""
    number = 1 + max(shard for region in tree for rack in region for shard, _ in rack)
    return [*tree, [[(number, weight)]]]


def draw(key: Column, name: str, weight: float) -> Column:
    """An exponential draw of the given rate from 53 bits of a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(u) / weight


def choose(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw."""
    children = [c for c in children if c[1] > 0]
    if len(children) == 1:
        return children[0][2]
    best = F.least(*[F.struct(draw(key, name, weight).alias("d"), F.lit(k).alias("k")) for k, (name, weight, _) in enumerate(children)])["k"]
    out = F.when(best == 0, children[0][2])
    for k in range(1, len(children)):
        out = out.when(best == k, children[k][2])
    return out


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key; names come from positions in the tree, so they stay when the tree grows at its end."""
    regions = []
    for r, region in enumerate(tree):
        racks = []
        for k, rack in enumerate(region):
            shards = [(f"region {r} rack {k} shard {number}", weight, F.lit(number)) for number, weight in rack]
            racks.append((f"region {r} rack {k}", sum(w for _, w in rack), choose(key, shards)))
        regions.append((f"region {r}", sum(w for _, w, _ in racks), choose(key, racks)))
    return choose(key, regions)


def place(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document.

    Slots run from 0 in each shard without gaps: rows are numbered inside (shard, bucket), a bucket being a part
    of the ids, and buckets start after the counts of those before, so no task holds a whole shard.
    """
    key = F.col("doc_id")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumns({
        "law": F.lit("key"), "shard": shard_of(key, tree).cast("int"), "grown_shard": shard_of(key, grown(tree)).cast("int"),
        "bucket": F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(BUCKETS)).cast("int"),
    })
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = rows.withColumn("inside", inside).join(F.broadcast(starts), ["shard", "bucket"])  # a row a bucket, BUCKETS a shard
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("inside")).alias("slot"), "grown_shard")
