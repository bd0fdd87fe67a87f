"""Periodic runs of words: seeds on diagonals, extended once.

A run is a maximal stretch of words that repeats with smallest period q (words q apart are equal) over at least
``max(MIN_WORDS, 3 * q)`` words.  On the diagonal of lag q such a run matches max(24 - q, 2 * q) positions in a
row or more.  So for lags up to 15 every run shows two equal 16-grams q apart, for lags from k / 2 to k - 1 two equal
k-grams, k = 32, 64, ...: these are the overlaps that a run guarantees.  A k-gram longer than q cannot return
sooner than q words later inside a run of smallest period q, so only the next occurrence of each k-gram in the same
document is a seed, never all pairs; and what a seed extends to has no smaller period.

k-grams are named exactly, by doubling: the name of 2k words is the rank of the names of its halves.  Grams without
a second occurrence in their document have no name and drop out at once, so long grams cost little.  Seeds next to each
other on a diagonal are one; a table of the furthest word covered on each lag of a document skips those that an earlier
extension reached; the others are extended word by word to both sides, in steps that double.

Texts are taken whole, in slices of about ``SLICE`` bytes of an Arrow batch (a longer text alone).  Null or empty
text, or text without words: no words, no runs, an empty rest.  Rows of one id are treated each for itself, repeated
rows alike, and null ids stay.  Other columns are not read.  Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigtable.llm.words import words_of

#: Shortest run, least number of periods in it, and bytes of text taken together.
MIN_WORDS, MIN_TIMES = 24, 3
SLICE = 4 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def need(lag: int) -> int:
    """Positions in a row that match ``lag`` words later in the shortest run of that period."""
    return max(MIN_WORDS - lag, (MIN_TIMES - 1) * lag)


def reach(words: np.ndarray, start: int, stop: int, lag: int) -> int:
    """First position from ``start`` on, before ``stop``, whose word differs from that ``lag`` later; ``stop`` if none."""
    step = 32
    while start < stop:
        upto = min(start + step, stop)
        differs = words[start:upto] != words[start + lag : upto + lag]
        if differs.any():
            return start + int(differs.argmax())
        start, step = upto, 2 * step
    return stop


def named(high: np.ndarray, low: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Names of pairs that occur twice or more: (which pairs, their names, number of names)."""
    _, name, count = np.unique(high * np.int64(base) + low, return_inverse=True, return_counts=True)
    often = count > 1
    held = np.flatnonzero(often[name])
    return held, (np.cumsum(often) - 1)[name[held]], int(often.sum())


def seeds(words: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each seed length k: (k, positions, lags) of next occurrences, of those side by side on a diagonal the first."""
    n = len(words)
    if not n:
        return
    at, name, names = named(text, words, int(words.max()) + 1)
    k = 1
    while len(at):
        if k >= 16:
            order = np.argsort(name, kind="stable")
            i, j = at[order[:-1]], at[order[1:]]
            lag = j - i
            near = (name[order[:-1]] == name[order[1:]]) & (lag < k) & ((lag >= k // 2) | (k == 16))
            i, lag = i[near], lag[near]
            order = np.lexsort((i, lag))
            i, lag = i[order], lag[order]
            head = np.ones(len(i), bool)
            head[1:] = (np.diff(i) != 1) | (np.diff(lag) != 0)
            i, lag = i[head], lag[head]
            order = np.argsort(i, kind="stable")
            yield k, i[order], lag[order]
        full = np.full(n + 1, -1, np.int64)
        full[at] = name
        after = full[np.minimum(at + k, n)]
        both = (after >= 0) & (text[np.minimum(at + k, n - 1)] == text[at])
        at, after, name = at[both], after[both], name[both]
        held, name, names = named(name, after, names)
        at = at[held]
        k *= 2


def runs_of(words: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, length, period), by start, then period; words: codes, offsets: where texts begin."""
    n_texts = len(offsets) - 1
    text = np.repeat(np.arange(n_texts), np.diff(offsets))
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(n_texts)]
    covered: dict[tuple[int, int], int] = {}
    for k, places, lags in seeds(words, text):
        for i, lag in zip(places.tolist(), lags.tolist(), strict=True):
            mine = int(text[i])
            if covered.get((mine, lag), -1) > i:
                continue
            first, last = int(offsets[mine]), int(offsets[mine + 1]) - lag
            end = reach(words, i + k, last, lag)
            flipped = words[first : i + lag][::-1]
            start = i - reach(flipped, 0, i - first, lag)
            covered[mine, lag] = end
            if end - start >= need(lag):
                found[mine].append((start - first, end - start + lag, lag))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in found]


def dropped(runs: list[list[tuple[int, int, int]]], offsets: np.ndarray) -> np.ndarray:
    """Whether a word lies in a run after that run's first period."""
    edge = np.zeros(int(offsets[-1]) + 1, np.int64)
    for k, mine in enumerate(runs):
        for start, length, period in mine:
            edge[offsets[k] + start + period] += 1
            edge[offsets[k] + start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``size`` bytes of text; one row at least."""
    held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(held[start - 1]) if start else 0
        stop = max(int(np.searchsorted(held, before + size, side="right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, runs, collapsed) of every document.

    runs: every run by start, then period; collapsed: the words that lie in no run after its first period, joined by spaces.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                runs = runs_of(words.codes, words.offsets)
                stays = ~dropped(runs, words.offsets)
                ends = np.concatenate([[0], np.cumsum(stays)])[words.offsets]
                kept = words.values.cast(pa.string()).take(pa.array(words.codes[stays]))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), kept), " ")
                told = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in mine] for mine in runs], kind)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.lengths()), told, joined], ["doc_id", "n_words", "runs", "collapsed"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(find, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def best_run(runs: Column) -> Column:
    """The run with the greatest length / period; of equals the one that starts first, then that of the smallest period."""
    # Cross products decide: a quotient of doubles could tie where the fractions differ.
    greater = lambda a, b: (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, 0), lambda a, b: F.when(greater(a, b), b).otherwise(a))


def planted(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) in which some documents repeat: with h = crc32 of the decimal id, g = h div 10, h mod 10 = 0 and n > 0 words,
    word i >= a becomes word a + (i - a) mod p; a = g mod n, p = 1 + (n - a) div (3 + g mod 8).  Null ids are left as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.floor(h / 10).alias("g"), F.when(chosen, words).alias("words"))
    n = F.size("words").cast("long")
    rows = rows.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    a, p = F.col("a"), F.col("p")
    pick = lambda i: F.get("words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), pick), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op12(docs: DataFrame) -> DataFrame:
    found = periodic_runs(planted(docs)).withColumn("best", best_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("(1000 * best.length) div best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli.alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    )
