"""SentencePiece BPE encoding and decoding by a prefix table.

For every prefix of a segment the encoding of that prefix ends in exactly one token.  An automaton over all
pieces gives the tokens that end at a position; the one that belongs there is the one that is compatible with
the last token of the prefix before it: the pair, merged on its own, stays these two tokens.  The table holds
that token for each prefix, and the ids are recovered from its end backwards, in linear time.

A segment is a run of word marks with what follows it: no piece holds a mark after another character, so
merges never cross a segment's border.  New lines occur in no piece and part segments as well.

Null text: empty, no ids, decoded to the empty text.  Characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigtable.llm.words import encode, whole

MARK = "▁"
#: Segments kept by a worker, and pairs of tokens; at the bound the older half of the segments, or all pairs, go.
KEPT = 150_000
KEPT_PAIRS = 400_000
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Kept(dict):
    """A memory of bounded size in two halves, the older of which is dropped."""

    def __init__(self, bound: int):
        super().__init__()
        self.bound, self.old = bound // 2, {}

    def find(self, key):
        got = self.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[key] = value


class PrefixTable:
    """The vocabulary of a BPE model file without its merging code."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a BPE model with plain normalisation is expected")
        kind = model.SentencePiece
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED, kind.UNUSED)}
        self.score = {p.piece: p.score for p in model.pieces if p.piece in self.ids}
        self.bytes = {int(p.piece[1:-1], 16): k for k, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == kind.UNKNOWN)
        self.text = [p.piece.encode() if p.type == kind.NORMAL else b"" for p in model.pieces]
        for value, k in self.bytes.items():
            self.text[k] = bytes([value])
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece crosses a word mark or a new line")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        #: Characters that stand side by side in some piece; between any others no piece reaches across.
        self.beside = {a + b for piece in self.ids for a, b in zip(piece, piece[1:], strict=False)}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.parts = Kept(KEPT)
        self.segments = Kept(KEPT)

    def merged(self, left: str, right: str) -> list[str]:
        """Greedy merging of two tokens' characters, best score first, then leftmost: the meaning of compatibility."""
        symbols, score = list(left + right), self.score
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                here = score.get(symbols[k] + symbols[k + 1])
                if here is not None and (best is None or here > best):
                    best, at = here, k
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """True if the two tokens, merged on their own, stay two; an empty left asks the same of one token."""
        if self.n_pairs >= KEPT_PAIRS:
            self.pairs, self.n_pairs = {}, 0
        self.n_pairs += 1
        got = self.merged(left, right) == ([left, right] if left else [right])
        self.pairs.setdefault(left, {})[right] = got
        return got

    def last_tokens(self, part: str) -> list[str]:
        """The unique last token of every prefix."""
        last = [""] * len(part)
        at = 0
        for end, piece in self.automaton.iter(part):
            if last[end]:
                continue
            while at < end:  # characters that end no piece stand for themselves
                if not last[at]:
                    last[at] = self.single(part, at)
                at += 1
            before = end - len(piece)
            left = last[before] if before >= 0 else ""
            known = self.pairs.get(left)
            fits = known.get(piece) if known is not None else None
            if fits or fits is None and self.compatible(left, piece):
                last[end] = piece
        for at in range(at, len(part)):
            if not last[at]:
                last[at] = self.single(part, at)
        return last

    def single(self, part: str, at: int) -> str:
        if part[at] in self.ids:
            raise ValueError(f"no token ends the prefix {part[: at + 1]!r}")
        return part[at]

    def part_ids(self, part: str) -> list[int]:
        got = self.parts.find(part)
        if got is None:
            last, k, tokens = self.last_tokens(part), len(part) - 1, []
            while k >= 0:
                tokens.append(last[k])
                k -= len(last[k])
            got = []
            for token in reversed(tokens):
                if token in self.ids:
                    got.append(self.ids[token])
                elif self.bytes:
                    got += [self.bytes[b] for b in token.encode()]
                else:
                    got.append(self.unknown)
            self.parts.put(part, got)
        return got

    def segment(self, text: str) -> tuple[int, bytes, bytes]:
        """Count of ids, ids as decimal text, decoded bytes with marks as spaces, of a segment."""
        got = self.segments.find(text)
        if got is None:
            ids: list[int] = []
            for k, part in enumerate(text.split("\n")):
                if k:
                    ids += self.part_ids("\n")
                if len(part) > 2 and part[-2:] not in self.beside:
                    ids += self.part_ids(part[:-1])
                    part = part[-1]
                if part:
                    ids += self.part_ids(part)
            raw = b"".join([self.text[k] for k in ids]).replace(MARK.encode(), b" ")
            got = (len(ids), ",".join(map(str, ids)).encode(), raw)
            self.segments.put(text, got)
        return got

    def segments_of(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, dict[int, list[str]]]:
        """Distinct segments, their codes, each text's range; texts with longer runs of marks are cut one by one."""
        text = whole(column)
        odd = pc.or_(pc.match_substring_regex(text, f"  |^ | $|{MARK}"), pc.equal(pc.utf8_length(text), 0))
        plain = pc.if_else(odd, "", text)
        coded = encode(pc.split_pattern(plain, " "))
        first = pc.if_else(pc.is_in(coded.values, pa.array([""], coded.values.type)), "", coded.values).to_pylist()
        one = {}
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            own = text[k].as_py()
            if own:
                one[k] = SEGMENT.findall(MARK + own.replace(" ", MARK))
        return first, coded.codes, coded.offsets, one

    def encoded(self, column: pa.Array) -> Iterator[tuple[int, bytes, bytes]]:
        """(count of ids, ids as decimal text, decoded bytes) of each text."""
        values, codes, offsets, one = self.segments_of(column)
        got = [self.segment(MARK + v) for v in values]
        count = np.array([g[0] for g in got], np.int64)
        ids, raw = [g[1] for g in got], [g[2] for g in got]
        for k in range(len(column)):
            if k in one:
                own = [self.segment(s) for s in one[k]]
                n, text, decoded = sum(g[0] for g in own), b",".join([g[1] for g in own]), b"".join([g[2] for g in own])
            else:
                mine = codes[offsets[k] : offsets[k + 1]]
                n, mine = int(count[mine].sum()), mine.tolist()
                text, decoded = b",".join([ids[c] for c in mine]), b"".join([raw[c] for c in mine])
            if decoded[:1] == b" ":
                decoded = decoded[1:]
            yield n, text, decoded

    def ids_of(self, text: str) -> list[int]:
        return [int(x) for x in next(self.encoded(pa.array([text])))[1].split(b",") if x]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join([self.text[k] for k in ids]).replace(MARK.encode(), b" ")
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_KEPT: dict[str, PrefixTable] = {}


def prefix_table(path: str) -> PrefixTable:
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = PrefixTable(path)
    return _KEPT[path]


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids array<int>, decoded) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model)
        for batch in batches:
            rows = list(table.encoded(batch.column("text")))
            ids = [[int(x) for x in r[1].split(b",") if x] for r in rows]
            decoded = [r[2].decode("utf-8", "replace") for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256): what ``encode_texts`` gives, hashed where it arises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model)
        for batch in batches:
            n, ids, decoded = [], [], []
            for count, text, raw in table.encoded(batch.column("text")):
                n.append(count)
                ids.append(hashlib.sha256(text).hexdigest())
                decoded.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
