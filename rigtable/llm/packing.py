"""Order-preserving packing of token streams into windows of at most ``size`` tokens.

Documents follow each other by id.  A window may be cut at any document end, sentence end or, inside a
sentence of more than ``STEP`` tokens, every ``STEP`` tokens.  Dynamic programming over these cuts minimises
padding plus a penalty for each cut that is no document end:  best(j) = min over i >= j - size of best(i) +
size - (j - i) + penalty(j).  best(i) + i is all that depends on i, so a monotone queue gives each minimum in
constant time.

Null or empty text: its end token only.  Null ids come first.  Rows of one id follow by text.  Empty table: no
row.  A run of ``RUN`` tokens is planned at once, so memory is bounded; a run costs one short window at most.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rigtable.llm.common import shuffle_parts, stage
from rigtable.llm.tokens import Tokens
from rigtable.llm.words import slices

RUN = 4_000_000
#: Bytes of text that are encoded together, so a run exceeds ``RUN`` by that or one document at most.
BYTES = 4 << 20
STEP = 256
#: Padding tokens that a cut is worth: at a document's end, a sentence's end, inside a sentence.
PENALTY = (0, 8, 64)
PIECES = "block int, window long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long"


def cuts(candidates: np.ndarray, penalty: np.ndarray, size: int) -> np.ndarray:
    """The chosen cut positions, first to last; candidates: increasing, from 0 to the end, at most ``size`` apart."""
    n = len(candidates)
    at, cost = candidates.tolist(), penalty.tolist()
    best, back = [0] * n, [0] * n
    queue: deque[int] = deque([0])
    for j in range(1, n):
        here = at[j]
        while at[queue[0]] < here - size:
            queue.popleft()
        i = queue[0]
        back[j] = i
        value = best[i] + at[i] + size - here + cost[j]
        best[j] = value
        value += here
        while queue and best[queue[-1]] + at[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    chosen, j = [at[-1]], n - 1
    while j:
        j = back[j]
        chosen.append(at[j])
    return np.array(chosen[::-1], np.int64)


def candidates(ends: np.ndarray, breaks: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """All cut positions of a run and their penalties."""
    kind = np.full(int(ends[-1]) + 1, -1, np.int8)  # by token, so that nothing is sorted
    kind[breaks], kind[ends], kind[0] = 1, 0, 0
    natural = np.flatnonzero(kind >= 0)
    gaps = np.diff(natural)
    inner = (gaps - 1) // step
    more = np.repeat(natural[:-1], inner) + step * (np.arange(int(inner.sum())) - np.repeat(np.cumsum(inner) - inner, inner) + 1)
    kind[more] = 2
    at = np.flatnonzero(kind >= 0)
    return at, np.array(PENALTY)[kind[at]]


class Run:
    """Documents gathered until there are tokens enough to plan."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.breaks: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, null: np.ndarray, tokens: Tokens) -> None:
        self.keys.append(keys)
        self.nulls.append(null)
        self.ids.append(tokens.ids)
        self.ends.append(tokens.ends + self.size)
        self.breaks.append(tokens.breaks + self.size)
        self.size += len(tokens.ids)

    def pieces(self, block: int, first_window: int, size: int) -> tuple[pa.RecordBatch, int]:
        ids, ends = np.concatenate(self.ids), np.concatenate(self.ends)
        keys, null = np.concatenate(self.keys), np.concatenate(self.nulls)
        chosen = cuts(*candidates(ends, np.concatenate(self.breaks), min(STEP, size)), size)
        begins = ends - np.diff(ends, prepend=0)
        start = np.union1d(begins, chosen[:-1])
        stop = np.append(start[1:], len(ids))
        doc = np.searchsorted(ends, start, side="right")
        window = np.searchsorted(chosen, start, side="right") - 1
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        n = len(start)
        columns = [
            pa.array(np.full(n, block, np.int32)), pa.array(window + first_window), pa.array(keys[doc], mask=null[doc]), pa.array(start - begins[doc]),
            pa.array(stop - start), pa.array(crc, pa.int64()), pa.array((ends - begins)[doc]), pa.array(start - chosen[window]),
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PIECES.split(", ")]), len(chosen) - 1


def planned(batches: Iterator[pa.RecordBatch], block: int, tokenizer: str, size: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the texts of one task, ``BYTES`` of text encoded at a time."""
    run, windows = Run(), 0
    for batch in batches:
        for part in slices(batch, batch.column("text"), BYTES):
            key = part.column("key")
            run.add(key.fill_null(0).to_numpy(zero_copy_only=False), key.is_null().to_numpy(zero_copy_only=False), Tokens(part.column("text"), tokenizer, True))
            if run.size >= RUN:
                out, n = run.pieces(block, windows, size)
                run, windows = Run(), windows + n
                yield out
    if run.size:
        yield run.pieces(block, windows, size)[0]


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset); sequence ids are gapless from 0 in document order."""
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
        .repartitionByRange(shuffle_parts(docs.sparkSession), "key")
        .sortWithinPartitions("key", "text")
    )

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return planned(batches, TaskContext.get().partitionId(), tokenizer, size)

    pieces = stage(ordered.mapInArrow(plan, PIECES), "pieces")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pieces.groupBy("block").agg((F.max("window") + 1).alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return pieces.join(F.broadcast(blocks), "block").select(  # one row a partition
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("window")).alias("sequence_id"), "offset"
    )
