"""Set-similarity join of documents on word shingles: Jaccard of ``percent``/100 or more, exact.

A document's set: 64-bit hashes of its distinct five-word shingles, words lower-cased A-Z (all words as one
shingle if fewer; a chance collision could move a set's size by one with odds of about n * n / 2^65).

1. Blocks of documents ask how many distinct texts hold each of their shingles; only shingles of two or more
   come back.  Requests and answers are packed arrays, a block lists a shingle once, so a hot passage is one entry a
   block.  Requests hold 32-bit prints within a bucket: a print shared by chance raises a count, no more.
2. Each set is ordered rarest first.  Two sets that link share a token of their prefixes, the first
   n - ceil(0.8 n) + 1 tokens; tokens that no other document holds keep their position but join with nothing.
3. Equal sets are one class.  Classes meet on prefix tokens, pass the length filter (sizes within 80 %), the
   positional filter (tokens before the shared one that another text holds, in both, plus what can follow in
   both, have to make up the overlap that is needed) and the suffix filter (a
   lower bound of the Hamming distance: places of a bitmap of hashes that only one set fills) and are verified once a pair on whole sets.
4. Hot tokens: a few rounds first compare classes at random.  A round takes a share of all tokens (the first the
   last ones of each prefix, which most of a group has), deals a token's classes into slots of about ``SLOT``
   and lets all pairs of a slot meet.  What is then in one component needs no further pair; only pairs across
   components follow, all of them, on all prefix tokens.  So no link between different components is lost, and
   a group of near copies costs a few pairs a member, not a pair for any two; nothing of a token larger than a
   slot meets in one task in these rounds.
5. Every link lies inside a component, so links are counted there: all pairs of a component's classes, in pairs of chunks of about
   ``CHUNK`` classes, by products of their incidence matrices.  Sums by class leave a task, not pairs.

Null or empty text, or no words: an empty set, linked with nothing, a component of its own.  Null ids: sizes
are returned, component null, n_links 0.  Repeated rows of an id are one class or linked like any others;
an id with several texts joins their components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigtable.llm.common import block_count, shuffle_parts, stage
from rigtable.llm.components import components, merged
from rigtable.llm.words import words_of

BLOCK_BYTES = 8 << 20
#: Shingles of a bucket of counts, about.
BUCKET = 2_000_000
#: 64-bit words of a set's bitmap.
BITMAP = 16
#: Last prefix tokens of a class in the first random round, part of all tokens in later ones, classes of a slot, rounds.
LATE, PART, SLOT, ROUNDS = 4, 8, 8, 4
#: Classes and bytes of sets of a chunk, about; bytes of a group of whole components, about; shingles of a matrix at once.
CHUNK, CHUNK_BYTES, PACK_BYTES, SLAB = 512, 16 << 20, 16 << 20, 4096
MULTIPLIER = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words, by pandas' string hash (SipHash of the UTF-8 bytes)."""
    return pd.util.hash_array(np.array(values.to_pylist(), object), categorize=False)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = words_of(column, lower=True)
    hashed = word_hashes(words.values)[words.codes] if len(words.values) else np.zeros(0, np.uint64)
    if len(hashed) >= width:
        with np.errstate(over="ignore"):
            rolling = np.zeros(len(hashed) - width + 1, np.uint64)
            for k in range(width):
                rolling = rolling * np.uint64(MULTIPLIER) + hashed[k : len(hashed) - width + 1 + k]
        rolling = mix(rolling)
    out = []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolling[a : b - width + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in hashed[a:b]:
                    h = h * np.uint64(MULTIPLIER) + w
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bitmap(own: np.ndarray) -> np.ndarray:
    """One bit for each of the top bits of the hashes that occurs."""
    places = np.zeros(64 * BITMAP, bool)
    places[(own >> np.uint64(64 - (64 * BITMAP - 1).bit_length())).astype(np.int64)] = True
    return np.packbits(places, bitorder="little").view("<i8")


def at_least(n: np.ndarray | int, percent: int):
    """Smallest integer of at least percent/100 of n."""
    return -(-n * percent // 100)


def prepare(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Rows (doc_id, n, sum, xor, tokens, positions, bits, shingles), staged; docs: doc_id, text.

    sum, xor: 128 bits that tell sets apart; tokens: prefix tokens held by two documents or more, with their positions in the rare-first order; bits
    and shingles (packed) are null where there are none.
    """
    blocks = block_count(docs, "text", BLOCK_BYTES)
    placed = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int"))
    buckets = blocks
    # One document of each text: copies would make their shingles look shared.  A null id links with nothing and would come first.
    same = ["octet_length(text)", "xxhash64(text)", "crc32(cast(text AS binary))"]
    once = placed.where("text IS NOT NULL AND doc_id IS NOT NULL").groupBy(*map(F.expr, same)).agg(F.min(F.struct("doc_id", "block")).alias("head")).select("head.*")

    def ask(group: pa.Table, heads: pa.Table) -> pa.Table:
        first = pc.is_in(group.column("doc_id"), heads.column("doc_id").combine_chunks() if heads.num_rows else pa.array([], pa.int64()))
        every = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(group.column("text").filter(first), width)])
        values, counts = np.unique(every, return_counts=True)
        bucket = (values >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        values, counts, bucket = values[order], counts[order], bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=np.uint64(2**63), append=np.uint64(2**63)))
        block, rows = group.column("block")[0].as_py() if group.num_rows else 0, list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return pa.table({
            "bucket": pa.array([int(bucket[a]) for a, _ in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()),
            "prints": pa.array([values[a:b].astype("<u4").tobytes() for a, b in rows], pa.binary()),
            "counts": pa.array([counts[a:b].astype("<u4").tobytes() for a, b in rows], pa.binary()),
        })

    def count(group: pa.Table) -> pa.Table:
        prints = [np.frombuffer(x, "<u4") for x in group.column("prints").to_pylist()]
        counts = [np.frombuffer(x, "<u4") for x in group.column("counts").to_pylist()]
        values, at = np.unique(np.concatenate(prints), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        block, bucket, out, low = group.column("block").to_pylist(), group.column("bucket").to_pylist(), [], 0
        for k, own in enumerate(prints):
            n = total[at[low : low + len(own)]]
            low += len(own)
            shared = n > 1
            if shared.any():
                out.append((block[k], bucket[k], own[shared].tobytes(), np.minimum(n[shared], 2**32 - 1).astype("<u4").tobytes()))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = {"block": pa.int32(), "bucket": pa.int32(), "prints": pa.binary(), "counts": pa.binary()}
        return pa.table({name: pa.array(values, kind) for (name, kind), values in zip(kinds.items(), columns, strict=True)})

    def order(group: pa.Table, known: pa.Table) -> pa.Table:
        prints = [np.frombuffer(x, "<u4").astype(np.uint64) for x in known.column("prints").to_pylist()]
        place = [np.uint64(b) << np.uint64(32) | p for b, p in zip(known.column("bucket").to_pylist(), prints, strict=True)]
        keys = np.concatenate([np.zeros(0, np.uint64), *place])
        counts = np.concatenate([np.zeros(0, "<u4"), *[np.frombuffer(x, "<u4") for x in known.column("counts").to_pylist()]])
        by_key = np.argsort(keys)
        keys, counts = keys[by_key], counts[by_key]
        sets = shingle_sets(group.column("text"), width)
        n, sums, xors, tokens, positions, bits, packed = [], [], [], [], [], [], []
        for own in sets:
            n.append(len(own))
            frequency = np.ones(len(own), np.int64)
            if len(keys) and len(own):
                key = ((own >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | own & np.uint64(0xFFFFFFFF)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                frequency = np.where(keys[at] == key, counts[at], 1).astype(np.int64)
            prefix = np.lexsort((own, frequency))[: len(own) - at_least(len(own), percent) + 1]
            shared = np.flatnonzero(frequency[prefix] > 1)
            mixed = mix(own + np.uint64(1))
            sums.append(mixed.sum(dtype=np.uint64))
            xors.append(np.bitwise_xor.reduce(mixed, initial=np.uint64(0)))
            tokens.append(own[prefix[shared]].view(np.int64))
            positions.append(shared.astype(np.int32))
            held = len(shared) > 0
            bits.append(bitmap(own) if held else None)
            packed.append(own.astype("<u8").tobytes() if held else None)
        return pa.table({
            "doc_id": group.column("doc_id"), "n": pa.array(n, pa.int64()), "sum": pa.array(np.array(sums, np.uint64).view(np.int64)), "xor": pa.array(np.array(xors, np.uint64).view(np.int64)), "tokens": pa.array(tokens, pa.list_(pa.int64())),
            "positions": pa.array(positions, pa.list_(pa.int32())), "bits": pa.array(bits, pa.list_(pa.int64())), "shingles": pa.array(packed, pa.binary()),
        })

    asked = placed.groupBy("block").cogroup(once.groupBy("block")).applyInArrow(ask, "bucket int, block int, prints binary, counts binary")
    known = asked.groupBy("bucket").applyInArrow(count, "block int, bucket int, prints binary, counts binary")
    schema = "doc_id long, n long, sum long, xor long, tokens array<long>, positions array<int>, bits array<long>, shingles binary"
    return stage(placed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(order, schema), "shingles")


def filtered(met: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """Pairs (a, b), a < b, of classes that met on a prefix token (row: a, b, n_a, n_b, k_a, k_b, i, j, bits_a, bits_b)
    and pass all filters.  i, j: positions of the token; k_a, k_b: how many prefix tokens before it other texts hold.

    every: classes meet on all tokens they share, so a pair need only pass on the first of them, before which they have nothing in common.
    """
    needed = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))
    before = F.lit(0) if every else F.least("k_a", "k_b")
    positional = before + F.least(F.col("n_a") - F.col("i"), F.col("n_b") - F.col("j")) >= needed
    apart = sum((F.bit_count(F.get("bits_a", F.lit(w)).bitwiseXOR(F.get("bits_b", F.lit(w)))) for w in range(BITMAP)), F.lit(0))
    suffix = apart <= F.col("n_a") + F.col("n_b") - 2 * needed
    length = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return met.where(F.col("a") != F.col("b")).where(length).where(positional).where(suffix).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b"
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(keep, "a long, b long")


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``left`` with those at ``right``."""
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held > 1
    rows, at = rows[shared[at]], (np.cumsum(shared) - 1)[at[shared[at]]]
    order = np.argsort(at, kind="stable")
    rows, at, total, out = rows[order], at[order], int(shared.sum()), np.zeros((len(left), len(right)))
    for start in range(0, total, SLAB):
        low, high = np.searchsorted(at, [start, start + SLAB])
        there = np.zeros((len(sets), min(SLAB, total - start)), np.float32)
        there[rows[low:high], at[low:high] - start] = 1
        out += there[left] @ there[right].T
    return out


def link_counts(known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (class_id, links): documents in other classes that link with a class; known: id, component."""
    member = known.join(sets.select(F.col("doc_id").alias("id"), "copies", "shingles"), "id")
    size = F.octet_length("shingles")
    chunks = F.ceil(F.greatest(F.count("*") / F.lit(CHUNK), F.sum(size) / F.lit(CHUNK_BYTES))).cast("int")
    facts = stage(member.groupBy("component").agg(chunks.alias("chunks"), F.sum(size).alias("bytes")), "component-sizes")
    packs = max(shuffle_parts(known.sparkSession), -(-(facts.agg(F.sum("bytes")).first()[0] or 0) // PACK_BYTES))
    # A chunk goes to every pair of chunks that holds it; components of one chunk share a group with others.
    placed = member.join(facts.drop("bytes"), "component").withColumn("c", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.withColumns({"low": F.least("c", "other"), "high": F.greatest("c", "other")})
    alone = F.pmod(F.xxhash64("component"), F.lit(packs))
    pack = F.when(F.col("chunks") == 1, alone).otherwise(-1 - F.abs(F.xxhash64("component", "low", "high") / 2).cast("long"))

    def count(group: pa.Table) -> pa.Table:
        component, low, high, c, ids, copies = (group.column(x).to_numpy() for x in ("component", "low", "high", "c", "id", "copies"))
        own = [np.frombuffer(x.as_buffer(), "<u8") for x in group.column("shingles")]
        n, links = np.array([len(x) for x in own]), np.zeros(len(ids), np.int64)
        order = np.lexsort((high, low, component))
        fresh = (np.diff(component[order], prepend=-1) != 0) | (np.diff(low[order], prepend=-1) != 0) | (np.diff(high[order], prepend=-1) != 0)
        fresh[:1] = True
        for part in np.split(order, np.flatnonzero(fresh)[1:]):
            same = low[part[0]] == high[part[0]]
            left, right = (np.flatnonzero(c[part] == side[part]) for side in (low, high))
            common = overlaps([own[k] for k in part], left, right)
            left, right = part[left], part[right]
            hit = 100 * common >= percent * (n[left][:, None] + n[right] - common)
            if same:
                np.fill_diagonal(hit, False)
            links[left] += hit @ copies[right]
            if not same:
                links[right] += hit.T @ copies[left]
        return pa.table({"class_id": pa.array(ids), "links": pa.array(links)})

    work = placed.select("component", "low", "high", "c", "id", "copies", "shingles", pack.alias("pack"))
    return work.groupBy("pack").applyInArrow(count, "class_id long, links long").groupBy("class_id").agg(F.sum("links").alias("links"))


def join(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, class_id, n_links) of all documents.

    class_id: smallest id with the same set; component_id: smallest id reachable by links; n_links: other documents that link with this one,
    copies among them.
    """
    ready = prepare(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), percent, width)
    held, same = ready.where("doc_id IS NOT NULL AND n > 0"), ["n", "sum", "xor"]
    classes = stage(held.groupBy("n", "sum", "xor").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "class-keys")
    # Classes have numbers of their own: an id that occurs with two texts may be the smallest of two classes.
    classes = stage(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    first = [*same, F.col("class_id").alias("doc_id"), "class", "copies"]
    heads = held.where("size(tokens) > 0").join(classes.select(first), [*same, "doc_id"]).dropDuplicates(["class"])
    heads = stage(heads.select(F.col("class").alias("doc_id"), "n", "copies", "tokens", "positions", "bits", "shingles"), "class-sets")
    entries = stage(heads.select("doc_id", "n", "bits", "tokens", F.posexplode(F.arrays_zip("tokens", "positions")).alias("k", "t")).select(
        F.col("t.tokens").alias("token"), "doc_id", "n", "k", F.col("t.positions").alias("i"), "bits", (F.col("k") >= F.size("tokens") - LATE).alias("late")
    ), "prefixes")

    as_b = [F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("k").alias("k_b"), F.col("i").alias("j"), F.col("bits").alias("bits_b")]
    as_a = [F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("k").alias("k_a"), F.col("i"), F.col("bits").alias("bits_a")]

    def found(met: DataFrame, tested: DataFrame | None, every: bool = False) -> tuple[DataFrame, DataFrame]:
        pairs = stage(filtered(met, percent, every), "pairs")
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        return pairs, stage(verified(pairs, heads, percent), "links")

    def with_component(known: DataFrame) -> DataFrame:
        """Entries of tokens that meet in more than one component, with the component."""
        now = entries.join(known.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        open_tokens = now.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
        return stage(now.join(open_tokens, "token", "left_semi"), "open-prefixes")

    still, known, tested = entries.withColumn("component", F.col("doc_id")), None, None
    for turn in range(ROUNDS):
        late = still.where(F.pmod(F.xxhash64("token", F.lit(turn)), F.lit(PART)) == 0 if turn else F.col("late"))
        counts = stage(late.groupBy("token").agg(F.ceil(F.count("*") / SLOT).alias("slots"), F.count("*").alias("m")).where("m > 1").drop("m"), "slots")
        dealt = late.join(counts, "token").withColumn("slot", F.pmod(F.xxhash64("doc_id", "token", F.lit(turn)), F.col("slots")))
        dealt = stage(dealt.drop("slots", "late"), "dealt")
        left, right = dealt.select("token", "slot", "component", *as_a), dealt.select("token", "slot", F.col("component").alias("other"), *as_b)
        more, links = found(left.join(right, ["token", "slot"]).where("component < other"), tested)
        tested = more if tested is None else tested.unionByName(more)
        known = components(links) if known is None else merged(known, links)
        still = with_component(known)

    left, right = still.select("token", "component", *as_a), still.select("token", F.col("component").alias("other"), *as_b)
    _, links = found(left.join(right, "token").where("component < other"), tested, every=True)
    known = merged(known, links)
    counts = link_counts(known, heads, percent).withColumnRenamed("class_id", "class")
    placed = ready.select("doc_id", *same).join(classes, same, "left").withColumn("class", F.when(F.col("doc_id").isNotNull(), F.col("class")))
    placed = stage(placed, "members")
    several = placed.where("class IS NOT NULL").groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").drop("b")
    known = merged(known, placed.join(several, "doc_id").select("a", F.col("class").alias("b")).where("a < b").distinct())
    known = known.withColumnRenamed("id", "class")
    least = classes.join(known, "class").groupBy("component").agg(F.min("class_id").alias("component_id"))
    least = stage(known.join(least, "component").select("class", "component_id"), "components")
    placed = placed.join(least, "class", "left").join(counts, "class", "left")
    linked = F.when(F.col("class").isNotNull(), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0)
    class_id = F.coalesce(F.when(F.col("class").isNotNull(), F.col("class_id")), F.col("doc_id"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", class_id).alias("component_id"), class_id.alias("class_id"), linked.cast("long").alias("n_links"))
