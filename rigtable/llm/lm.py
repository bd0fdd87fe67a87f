"""Language-model scoring: the marginal probability of a text over all segmentations of its words into pieces.

The lattice of a word holds the pieces of an existing vocabulary and, for a word of the training documents, one
arc for the whole word.  Piece weights start from the vocabulary's scores (the rank of a piece, as 1 / rank) and
are learned by expected counts over the lattices of all distinct training words.  A whole word's arc has its
count less a discount, as share of all tokens; the discounts together are the share of the paths through pieces
(discount n1 / (n1 + 2 n2), from the numbers of words seen once and twice).  Every path that spells a word adds
to its probability, by a forward recursion in log space; a text's probability is the product over its words and
one end token.  Characters outside the vocabulary are spelled by an escape with its own weight and 1/256 a
byte, so every text has a positive probability, and those of all texts sum to one at most.

Both the word counts of the base score and the lattice scores live in one table with a row a distinct word;
blocks of documents ask it for their distinct words, so nothing that grows is broadcast or collected.

Null and empty text: the end token only.  Null ids: rows as all others, in training or held out by the empty
id.  Repeated rows each count.  Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigtable.llm.common import block_count, crc_mod, stage
from rigtable.llm.words import words_of

MARK = "▁"
#: Rounds of expected counts, and what is added to the expected count of each piece.
ROUNDS, PRIOR = 3, 0.1
BLOCK_BYTES = 16 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words of a lattice that are worked on at once.
CHUNK = 20_000
NONE = -np.inf


def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces of a SentencePiece file, in lower case as the words are, and log weights from its scores."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    ranked = sorted((p for p in model.pieces if p.type == model.SentencePiece.NORMAL), key=lambda p: -p.score)
    weight: dict[str, float] = {}
    for k, p in enumerate(ranked):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in p.piece)
        weight[lower] = weight.get(lower, 0.0) + 1 / (k + 10)
    logs = np.log(np.array(list(weight.values())))
    return list(weight), logs - np.logaddexp.reduce(logs)


class Lattice:
    """Looks up all pieces inside many words at once.  Piece ``len(pieces)`` is the escape."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        by_size: dict[int, dict[int, int]] = {}
        for k, piece in enumerate(pieces):
            h = 0
            for size, char in enumerate(piece, 1):
                h = (h * int(BASE) + ord(char) + 1) & (2**64 - 1)
                by_size.setdefault(size, {}).setdefault(h, -1)
            by_size[len(piece)][h] = k
        self.tables = []
        for size in range(1, len(by_size) + 1):
            keys = np.array(list(by_size[size]), np.uint64)
            order = np.argsort(keys)
            self.tables.append((keys[order], np.array(list(by_size[size].values()), np.int64)[order]))

    def arcs(self, chars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each size: (word, start, piece) of all pieces of that size in words of one length."""
        n, length = chars.shape
        word, start = np.divmod(np.arange(n * length), length)
        h = np.zeros(len(word), np.uint64)
        flat, out = chars.ravel().astype(np.uint64), []
        for size, (keys, pieces) in enumerate(self.tables, 1):
            inside = start + size <= length
            word, start, h = word[inside], start[inside], h[inside]
            if not len(word):
                break
            with np.errstate(over="ignore"):
                h = h * BASE + flat[word * length + start + size - 1] + np.uint64(1)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = keys[at] == h
            word, start, h, piece = word[known], start[known], h[known], pieces[at[known]]
            whole = piece >= 0
            found = (word[whole], start[whole], piece[whole])
            if size == 1:
                spelled = np.zeros(n * length, bool)
                spelled[found[0] * length + found[1]] = True
                other_word, other_start = np.divmod(np.flatnonzero(~spelled), length)
                found = tuple(np.concatenate(x) for x in zip(found, (other_word, other_start, np.full(len(other_word), self.n)), strict=True))
            out.append(found)
        return out

    def scores(self, words: list[str], logs: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word; with counts, also the expected count of each piece."""
        total, expected = np.zeros(len(words)), np.zeros(self.n + 1)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            length = int(lengths[order[low]])
            step = max(1, CHUNK * 12 // length)
            for a in range(low, high, step):
                rows = order[a : min(a + step, high)]
                chars = np.array([MARK + words[k] for k in rows], f"<U{length}").view(np.uint32).reshape(len(rows), length)
                total[rows] = self._group(chars, logs, None if counts is None else counts[rows], expected)
        return total, expected

    def _group(self, chars: np.ndarray, logs: np.ndarray, counts: np.ndarray | None, expected: np.ndarray) -> np.ndarray:
        n, length = chars.shape
        arcs = self.arcs(chars)
        weights = np.full((len(arcs), length, n), NONE)  # by size and start
        for size, (word, start, piece) in enumerate(arcs):
            value = logs[piece]
            if size == 0:
                escaped = piece == self.n
                value[escaped] += escape_bytes(chars[word[escaped], start[escaped]])
            weights[size, start, word] = value
        used = weights.max(axis=2) > NONE
        forward = np.full((length + 1, n), NONE)
        forward[0] = 0.0
        for end in range(1, length + 1):
            for size in range(min(end, len(arcs))):
                start = end - size - 1
                if used[size, start]:
                    forward[end] = np.logaddexp(forward[end], forward[start] + weights[size, start])
        if counts is not None:
            backward = np.full((length + 1, n), NONE)
            backward[length] = 0.0
            for start in range(length - 1, -1, -1):
                for size in range(min(length - start, len(arcs))):
                    if used[size, start]:
                        backward[start] = np.logaddexp(backward[start], backward[start + size + 1] + weights[size, start])
            for size, (word, start, piece) in enumerate(arcs):
                share = np.exp(forward[start, word] + weights[size, start, word] + backward[start + size + 1, word] - forward[length, word])
                expected += np.bincount(piece, share * counts[word], minlength=len(expected))
        return forward[length]


def escape_bytes(chars: np.ndarray) -> np.ndarray:
    """Log weight of spelling a character by its bytes, 1/256 each."""
    return -math.log(256) * (1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF))


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, n): how often each word of any document stands in training documents; docs: text, held_out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column("text"), lower=True)
            training = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            n = np.bincount(words.codes, np.repeat(training, words.lengths()), len(words.values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([words.values.cast(pa.string()), pa.array(n)], ["word", "n"])

    return docs.select("text", "held_out").mapInArrow(count, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def learn(counts: DataFrame, pieces: list[str], logs: np.ndarray, n_types: int, rounds: int = ROUNDS) -> np.ndarray:
    """Log weights of pieces, escape and word end; each distinct word of the training documents counts once."""
    logs = np.append(logs, math.log(1e-6))

    def expect(weights: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(pieces), np.zeros(len(weights))
            for batch in batches:
                total += lattice.scores(batch.column("word").to_pylist(), weights, np.ones(batch.num_rows))[1]
            kept = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(total[kept])], ["piece", "n"])

        return run

    for _ in range(rounds):
        rows = counts.where("n > 0").mapInArrow(expect(logs), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # one row a piece
        got = np.full(len(logs), PRIOR)
        for row in rows:
            got[row.piece] += row.n
        total = math.log(got.sum() + n_types + PRIOR)
        logs = np.log(got) - total
    return np.append(logs, math.log(n_types + PRIOR) - total)


def score(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (crc_mod(id_col, 7) == 2).alias("held_out")
    )
    counts = stage(word_counts(source), "word-counts")
    n_words, n_types, once, twice = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    ).first()
    ends = source.where(~F.col("held_out")).count()
    n_train, base_all = n_words + ends, n_words + ends + n_types + (ends > 0) + 1
    pieces, logs = vocabulary(vocabulary_path)
    weights = learn(counts, pieces, logs, n_types)
    logs, stop = weights[:-1], weights[-1]
    discount = once / (once + 2 * twice) if once else 0.5
    total = n_train + 2
    by_pieces = math.log10((discount * n_types + 1) / total)
    end_log, end_base = math.log10((ends + 1) / total), math.log10((ends + 1) / base_all)

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces)
        for batch in batches:
            spelled = (lattice.scores(batch.column("word").to_pylist(), logs)[0] + stop) / math.log(10) + by_pieces
            with np.errstate(divide="ignore"):
                whole = np.log10(np.maximum(batch.column("n").to_numpy() - discount, 0) / total)
            high = np.maximum(whole, spelled)
            found = high + np.log10(10 ** (whole - high) + 10 ** (spelled - high))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(found)], ["word", "n", "log10_p"])

    blocks = block_count(source, "text", BLOCK_BYTES)
    placed = source.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int"))

    def ask(group: pa.Table) -> pa.Table:
        values = words_of(group.column("text"), lower=True).values.cast(pa.string())
        values = values.filter(pc.not_equal(values, ""))
        block = group.column("block")[0].as_py()
        return pa.table({"block": pa.array(np.full(len(values), block, np.int32)), "word": values})

    def answer(group: pa.Table, known: pa.Table) -> pa.Table:
        words = words_of(group.column("text"), lower=True)
        at = pc.index_in(words.values.cast(pa.string()), known.column("word").combine_chunks() if known.num_rows else pa.array([], pa.string()))
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        n, log10_p = known.column("n").to_numpy(), known.column("log10_p").to_numpy()
        if (at[words.codes] < 0).any():
            raise ValueError("a word of the block has no row in the word table")
        c, p = n[at[words.codes]], log10_p[at[words.codes]]
        ends_at = words.offsets[1:]

        def sums(values: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(values)])[words.offsets])

        base = np.array([math.fsum(x) for x in np.split(np.log10((c + 1) / base_all), ends_at[:-1])]) + end_base
        model = np.array([math.fsum(x) for x in np.split(p, ends_at[:-1])]) + end_log
        return pa.table({
            "doc_id": group.column("doc_id"), "held_out": group.column("held_out"), "n_tokens": pa.array(words.lengths() + 1),
            "n_known": pa.array(sums((c > 0).astype(np.int64)) + int(ends > 0)), "train_tokens": pa.array(np.full(group.num_rows, n_train, np.int64)),
            "base_score": pa.array(base), "score": pa.array(model),
        })

    asked = placed.groupBy("block").applyInArrow(ask, "block int, word string")
    scored = counts.mapInArrow(score_words, "word string, n long, log10_p double")
    replies = asked.join(scored.hint("shuffle_hash"), "word").select("block", "word", "n", "log10_p")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return placed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(answer, schema)
