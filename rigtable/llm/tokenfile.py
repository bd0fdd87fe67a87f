"""Token-id files with keyed access.

``write_tokens`` sorts documents by key into shard files of raw little-endian ids.  Each file closes with its
document keys, the start of each document and a minimal perfect hash of the keys: a cascade of bit arrays in
which a key's level and rank give its slot, and slots hold a fingerprint, the document's first id and its
length.  ``read_tokens`` streams files back, ``lookup`` finds keys with one probe a level and one slice of the
payload.  The manifest has one row a file; keys find their file by its first and last key.

Layout of a file: MAGIC; ids; keys (i8); starts (u8, one more than keys); level words (u8) with rank before
each word (u4); fingerprints (u4), first ids (u8), lengths (u8) by slot; a JSON footer, its size (u4), MAGIC.

Null text: only the end id.  Null key: stored in key order before all others, not indexed.  A repeated key is
stored as often as it occurs and found at its first row.  Empty table: no file, an empty manifest.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rigtable.llm.common import shuffle_parts, stage
from rigtable.llm.tokens import Tokens
from rigtable.session import scratch_path

MAGIC = b"RGTOKEN1"
MANIFEST = "shard int, path string, n_docs long, n_ids long, first_key long, last_key long"
#: Bits of a level for each key that is still to be placed.
GAMMA = 2


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, seeded."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys to slots 0 .. n - 1.  Level k holds the keys that are alone at their bit there."""

    def __init__(self, sizes: list[int], words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, words = keys.view(np.uint64), [], []
        while len(left):
            size = -(-GAMMA * len(left) // 64) * 64
            at = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        joined = np.concatenate(words) if words else np.zeros(0, "<u8")
        set_bits = np.bitwise_count(joined).astype(np.int64)
        return cls(sizes, joined, (np.cumsum(set_bits) - set_bits).astype("<u4"))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; -1 where no level has a bit for it.  Keys not built in may get any slot."""
        keys = keys.view(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = (mix(keys[left], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.ranks[at >> 6] + below)[hit]
            left, base = left[~hit], base + size
            if not len(left):
                break
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64), 1 << 20) >> np.uint64(32)).astype("<u4")


class ShardWriter:
    """Ids go out as they come; keys and starts stay until ``close``."""

    def __init__(self, base: str, shard: int, width: int):
        fs, root = pafs.FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.ids"  # a repeated task writes a file of its own
        self.path, self.width = f"{base}/{name}", width
        self.out = fs.open_output_stream(f"{root}/{name}")
        self.out.write(MAGIC)
        self.keys: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def add(self, keys: np.ndarray, null: np.ndarray, tokens: Tokens) -> None:
        if len(tokens.ids) and int(tokens.ids.max()) >> (8 * self.width):
            raise ValueError(f"token id {int(tokens.ids.max())} does not fit {self.width} bytes: pass a larger width")
        self.out.write(tokens.ids.astype(f"<u{self.width}").tobytes())
        self.keys.append(keys)
        self.nulls.append(null)
        self.lengths.append(np.diff(tokens.ends, prepend=0))

    def close(self) -> tuple[int, int, int | None, int | None]:
        keys, null, lengths = (np.concatenate(x) for x in (self.keys, self.nulls, self.lengths))
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
        held, first = np.unique(keys[~null], return_index=True)
        rows = np.flatnonzero(~null)[first]
        index = PerfectHash.build(held)
        slots = index.slot(held)
        by_slot = rows[np.argsort(slots)]
        parts = {
            "keys": keys.astype("<i8"), "null": null.astype("u1"), "starts": starts, "words": index.words, "ranks": index.ranks,
            "prints": fingerprint(keys[by_slot]), "firsts": starts[by_slot], "sizes": lengths[by_slot].astype("<u8"),
        }
        foot: dict = {"width": self.width, "levels": index.sizes, "n_ids": int(starts[-1])}
        at = len(MAGIC) + int(starts[-1]) * self.width
        for name, values in parts.items():
            raw = values.tobytes()
            self.out.write(raw)
            foot[name] = [at, len(raw), values.dtype.str]
            at += len(raw)
        text = json.dumps(foot).encode()
        self.out.write(text + len(text).to_bytes(4, "little") + MAGIC)
        self.out.close()
        ends = (int(held[0]), int(held[-1])) if len(held) else (None, None)
        return len(keys), int(starts[-1]), *ends


class ShardReader:
    def __init__(self, path: str):
        fs, at = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(4 + len(MAGIC), size - 4 - len(MAGIC))
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        n = int.from_bytes(tail[:4], "little")
        self.foot = json.loads(self.file.read_at(n, size - 4 - len(MAGIC) - n))
        self.width = self.foot["width"]

    def section(self, name: str) -> np.ndarray:
        at, n, kind = self.foot[name]
        return np.frombuffer(self.file.read_at(n, at), kind)

    def ids(self, first: int, count: int) -> np.ndarray:
        raw = self.file.read_at(count * self.width, len(MAGIC) + first * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def index(self) -> PerfectHash:
        return PerfectHash(self.foot["levels"], self.section("words"), self.section("ranks"))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, first id, length) of each key by the index; a foreign key passes its fingerprint with odds of 2^-32,
        so the stored key decides."""
        prints, firsts, sizes = (self.section(x) for x in ("prints", "firsts", "sizes"))
        slot = self.index().slot(keys)
        found = slot >= 0
        slot = np.where(found, slot, 0)
        if not len(prints):
            return np.zeros(len(keys), bool), np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u8")
        found &= prints[slot] == fingerprint(keys)
        starts, stored = self.section("starts"), self.section("keys")
        row = np.searchsorted(starts, firsts[slot])
        row = np.minimum(row, len(stored) - 1)
        found &= stored[row] == keys
        return found, firsts[slot], sizes[slot]


def write_tokens(docs: DataFrame, tokenizer: str, base: str, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """Encode every text and write the shard files below ``base``, a folder that all executors share; returns the manifest.

    width: bytes of an id in the files (2 fits vocabularies of up to 65,536).  Tasks stream: memory holds one
    Arrow batch and 17 bytes a document.
    """
    parts = shuffle_parts(docs.sparkSession)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
        .repartitionByRange(parts, "key")
        .sortWithinPartitions("key", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or ShardWriter(base, shard, width)
            key = batch.column("key")
            writer.add(key.fill_null(0).to_numpy(zero_copy_only=False), key.is_null().to_numpy(zero_copy_only=False), Tokens(batch.column("text"), tokenizer))
        if writer:
            row = [shard, writer.path, *writer.close()]
            names = [x.split()[0] for x in MANIFEST.split(", ")]
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    return stage(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def with_base(manifest: DataFrame) -> DataFrame:
    """Adds ``base``: ids in all files before.  One row a file, so the single window task is small."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, by_index: bool = True) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of every stored document, one task a file.

    by_index: take a document's place from the perfect hash (first row of a key) and not from the row order.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                file = ShardReader(path)
                keys, null, starts = file.section("keys"), file.section("null") > 0, file.section("starts").astype(np.int64)
                first, size = starts[:-1].copy(), np.diff(starts)
                if by_index:
                    fresh = np.ones(len(keys), bool)
                    fresh[1:] = (keys[1:] != keys[:-1]) | null[1:] | null[:-1]
                    rows = np.flatnonzero(fresh & ~null)
                    found, at, n = file.find(keys[rows].copy())
                    if not found.all():
                        raise ValueError(f"{path}: a stored key is not in the index")
                    first[rows], size[rows] = at, n
                for low in range(0, len(keys), 2048):
                    part = slice(low, min(low + 2048, len(keys)))
                    begin = int(starts[part.start])
                    ids = file.ids(begin, int(starts[part.stop]) - begin)
                    crc = [zlib.crc32(ids[a - begin : a - begin + n]) for a, n in zip(first[part].tolist(), size[part].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[part], mask=null[part]), pa.array(first[part] + base), pa.array(size[part]), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    files = with_base(manifest).select("path", "base").repartition(shuffle_parts(manifest.sparkSession))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """Rows (key, ids) for the wanted keys that are stored; each key goes to the one file whose range holds it.

    A run of one repeated key may end a file and begin the next; the first file answers.
    """
    wanted = keys.select(F.col(key_col).cast("long").alias("key")).where("key IS NOT NULL").distinct()
    bounds = F.broadcast(manifest.where("first_key IS NOT NULL").select("shard", "path", "first_key", "last_key"))  # one row a file
    routed = wanted.join(bounds, F.col("key").between(F.col("first_key"), F.col("last_key"))).groupBy("key").agg(F.min_by("path", "shard").alias("path"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, ShardReader] | None = None
        for batch in batches:
            paths, want = np.array(batch.column("path").to_pylist(), object), batch.column("key").to_numpy()
            for path in dict.fromkeys(paths):
                if held is None or held[0] != path:
                    held = (path, ShardReader(path))
                mine = want[paths == path].copy()
                found, first, size = held[1].find(mine)
                ids = [held[1].ids(int(a), int(n)).tolist() for a, n in zip(first[found], size[found], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(mine[found]), pa.array(ids, pa.list_(pa.int64()))], ["key", "ids"])

    return routed.repartition("path").sortWithinPartitions("path").mapInArrow(fetch, "key long, ids array<long>")


def op4(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents, read the files back."""
    return read_tokens(write_tokens(docs, tokenizer, scratch_path(spark, "tokens")))
