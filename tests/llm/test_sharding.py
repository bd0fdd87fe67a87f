"""The hash tree: shares, slots, and where documents move."""

import zlib
from collections import Counter, defaultdict

import odd
from pyspark.sql import functions as F

from rigtable.llm import sharding


def test_rows_and_slots(spark):
    rows = odd.rows()
    got = sharding.place(odd.frame(spark), sharding.even_tree(8)).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len({r.shard for r in got if r.doc_id == i}) == 1 for i in {r.doc_id for r in got})
    assert sharding.place(odd.empty(spark), sharding.even_tree(8)).count() == 0


def test_weights_and_movement(spark):
    tree = [[[(0, 1.0), (1, 3.0)], [(2, 2.0)]], [[(3, 4.0)], [(4, 1.0), (5, 1.0)]]]
    heavier = [[[(0, 1.0), (1, 3.0)], [(2, 2.0)]], [[(3, 4.0)], [(4, 1.0), (5, 4.0)]]]
    n = 60_000
    place = lambda t: sharding.shard_of(F.col("id"), t)
    moved = spark.range(n).select(place(tree).alias("a"), place(heavier).alias("b"), place(sharding.grown(tree, 3.0)).alias("c")).groupBy("a", "b", "c").count().collect()
    share = Counter()
    for r in moved:
        share[r.a] += r["count"] / n
    assert all(abs(share[k] - w / 12) < 0.01 for k, w in enumerate([1, 3, 2, 4, 1, 1]))
    region = lambda s: int(s >= 3)
    # More weight in region 1: nothing moves into or inside region 0; rows leave rack 3 only for 4 and 5.
    assert all(r.a == r.b or region(r.b) == 1 for r in moved)
    assert all(not (r.a in (4, 5) and r.b == 3) for r in moved)
    assert all(r.c in (r.a, 6) for r in moved)
    assert abs(sum(r["count"] for r in moved if r.c == 6) / n - 3 / 15) < 0.01
