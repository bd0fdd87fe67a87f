"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors are one class first, so a vector that a third of all rows share is one row.  A table hashes a
class by the signs of ``bits`` random projections; classes with equal signs share a bucket.  ``bits`` grows with
the logarithm of the number of classes, so a bucket of unrelated vectors keeps its size, and the number of
tables follows from the wanted recall at the threshold: a pair at angle t agrees in one table with probability
(1 - t / pi) ** bits.

A bucket is cut into chunks of ``CHUNK`` classes by a hash; every pair of its chunks is one piece of work, so no
task holds more than two chunks.  A pair of classes is counted in the first table where it agrees, once; cosines
are taken in double precision.  Work on a bucket leaves sums by class and the links of a spanning star of each
chunk pair's linked groups, not all pairs.

Null, empty or zero vectors, and any with a null or non-finite component, link with nothing.  Vectors of other
lengths than the most frequent length are compared with none of another length.  Null ids: n_links is 0,
component and kept are null.  Repeated rows of an id count as vectors of their own, linked if they agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigtable.llm.common import shuffle_parts, stage
from rigtable.llm.components import components
from rigtable.llm.words import spread

CHUNK = 1024
#: Rows of a group of whole buckets, about; buckets up to which pairs are listed and not multiplied; pairs at once.
PACK, SMALL, PAIRS = 20_000, 128, 50_000
RECALL = 0.999
SEED = 20240229


def tables_for(classes: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a table, number of tables)."""
    bits = min(62, max(8, math.ceil(math.log2(max(classes, 1))) - 3))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-agree))


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(SEED + dim).standard_normal((dim, bits * tables))


def signs(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Sign hash of each vector in each table."""
    positive = (vectors @ planes(vectors.shape[1], bits, tables) > 0).reshape(len(vectors), tables, bits)
    return (positive * (np.int64(1) << np.arange(bits))).sum(axis=2)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def stars(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """For nodes 0 .. size - 1 and links a-b: the smallest node of each node's group."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links_of(group: pa.Table, dim: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, links counted with copies, smallest class of its group) for the linked classes of some buckets."""
    t, sign, low, high, ids = (group.column(x).to_numpy() for x in ("t", "sign", "low", "high", "class_id"))
    order = np.lexsort((ids, high, low, sign, t))
    t, sign, low, high, ids = (x[order] for x in (t, sign, low, high, ids))
    copies, chunk = (group.column(x).to_numpy()[order] for x in ("copies", "c"))
    v = matrix(group.column("v"), dim)[order]
    table = group.column("signs").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
    v = v / np.abs(v).max(axis=1, keepdims=True)
    v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    fresh = np.flatnonzero((np.diff(t, prepend=-1) != 0) | (np.diff(sign, prepend=-1) != 0) | (np.diff(low, prepend=-1) != 0) | (np.diff(high, prepend=-1) != 0))
    sizes = np.diff(np.append(fresh, len(ids)))
    found = []
    for start, size in zip(fresh[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        part = v[start : start + size]
        for at in range(0, size, CHUNK):
            a, b = np.nonzero(part[at : at + CHUNK] @ part.T >= threshold)
            found.append((a[a + at < b] + start + at, b[a + at < b] + start))
    rows = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    ends = np.repeat(fresh + sizes, sizes)[rows]
    upto = np.cumsum(ends - rows - 1)
    for part in np.split(rows, np.searchsorted(upto, np.arange(PAIRS, int(upto[-1]) if len(upto) else 0, PAIRS))):
        left = np.repeat(fresh + sizes, sizes)[part] - part - 1
        a, b = np.repeat(part, left), spread(part + 1, left)
        near = np.einsum("ij,ij->i", v[a], v[b]) >= threshold
        found.append((a[near], b[near]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = (low[a] == high[a]) | (chunk[a] != chunk[b])
    earlier = np.arange(table.shape[1]) < t[a][:, None]
    keep &= ~((table[a] == table[b]) & earlier).any(axis=1)
    a, b = a[keep], b[keep]
    links = (np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))).astype(np.int64)
    root = stars(a, b, len(ids))
    held = np.flatnonzero(links)
    return ids[held], links[held], ids[root[held]]


def near_duplicates(rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of every row."""
    source = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = F.coalesce(
        (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)
    )
    source = source.withColumn("usable", usable & F.col("vec_id").isNotNull())
    with_key = source.where("usable").withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero
    classes = stage(with_key.groupBy("v").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies")).withColumn("dim", F.size("v")), "vector-classes")
    n = classes.count()
    bits, tables = tables_for(n, threshold)

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                hashed = signs(matrix(part.column("v"), dim), bits, tables)
                yield pa.RecordBatch.from_arrays(
                    [part.column("class_id"), part.column("copies"), part.column("dim"), part.column("v"), pa.array(list(hashed), pa.list_(pa.int64()))],
                    ["class_id", "copies", "dim", "v", "signs"],
                )

    hashed = classes.select("class_id", "copies", "dim", "v").mapInArrow(hash_rows, "class_id long, copies long, dim int, v array<double>, signs array<long>")
    hashed = stage(hashed, "vector-signs")
    entries = hashed.select("class_id", "dim", F.posexplode("signs").alias("t", "sign"))
    crowds = entries.groupBy("t", "dim", "sign").agg(F.count("*").alias("m")).where("m > 1").withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int"))
    crowds = stage(crowds, "buckets")
    mine = F.pmod(F.xxhash64("class_id"), F.col("chunks")).cast("int")
    placed = entries.join(crowds, ["t", "dim", "sign"]).withColumn("c", mine)
    # A chunk goes to every pair of chunks that holds it: (c, x) with c <= x, and (x, c) with x < c.
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # Buckets of one chunk share a group with others; each pair of chunks of a large bucket is a group.
    packs = max(shuffle_parts(rows.sparkSession), -(-n * tables // PACK))
    pack = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("t", "dim", "sign"), F.lit(packs))).otherwise(-1 - F.abs(F.xxhash64("t", "dim", "sign", "low", "high") / 2).cast("long"))
    pairs = pairs.select("class_id", "t", "dim", "sign", F.least("c", "other").alias("low"), F.greatest("c", "other").alias("high"), "c", "chunks").withColumn("pack", pack)
    work = pairs.drop("chunks").join(hashed.drop("dim"), "class_id")

    def compare(group: pa.Table) -> pa.Table:
        dims = group.column("dim").to_numpy()
        out = [links_of(group.filter(pa.array(dims == dim)), dim, threshold) for dim in np.unique(dims).tolist()]
        ids, links, root = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"class_id": pa.array(ids), "links": pa.array(links), "root": pa.array(root)})

    found = work.groupBy("pack").applyInArrow(compare, "class_id long, links long, root long")
    found = stage(found, "vector-links")
    counts = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    known = components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "class_id")
    facts = classes.select("v", "class_id", "copies").join(counts, "class_id", "left").join(known, "class_id", "left").select(
        F.col("v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id")
    )
    linked = with_key.select("vec_id", "v").join(facts, "v").select("vec_id", "n_links", "component_id")
    alone = source.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
