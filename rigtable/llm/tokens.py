"""Token ids of whole texts by the tokenizers library, word by word.

The vocabulary's pre-tokenizer never joins characters across white space, so a text's ids are those of its
words in order.  A worker keeps the ids of words it has met, up to a bound; a plain word (Latin letters, at
most one trailing stop or comma) goes to the library's BPE model directly, any other through its whole chain.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rigtable.llm.words import Words, spread, words_of

END_ID = 1
#: Words kept by a worker; at the bound the older half of the memory goes.
KEPT_WORDS = 200_000
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([.,]?)")
#: For Arrow's matcher, which tests all distinct words of a batch at once.
SENTENCE_END = "[.!?。！？][\"'”’)\\]]*$"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in that byte-level vocabularies use for each byte value."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class WordIds:
    """Ids of words, as little-endian unsigned 32-bit bytes; ``path``: a tokenizers file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = {chr(c): "".join(_byte_letters()[b] for b in chr(c).encode()) for c in range(256)}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, word: str) -> bytes | None:
        """Ids of a word that normalisation leaves alone but for lower case (Latin-1 letters have no other form); None: it is not such a word."""
        found = PLAIN.fullmatch(word.lower()) if word.isascii() else PLAIN.fullmatch(word)
        if not found:
            return None
        ids = [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, found[1])))]
        if found[2]:
            ids += [t.id for t in self.model.tokenize(found[2])]
        return struct.pack(f"<{len(ids)}I", *ids)

    def of(self, words: list[str]) -> list[bytes]:
        young, old, out, late = self.young, self.old, [], []
        for k, word in enumerate(words):
            ids = young.get(word)
            if ids is None:
                ids = old.get(word)
                if ids is None:
                    ids = self._plain(word)
                    if ids is None:
                        late.append(k)
                        out.append(b"")
                        continue
                if len(young) >= KEPT_WORDS // 2:
                    self.old, self.young = young, {}
                    young, old = self.young, self.old
                young[word] = ids
            out.append(ids)
        for at in range(0, len(late), 10_000):
            part = late[at : at + 10_000]
            for k, got in zip(part, self.library.encode_batch_fast([words[k] for k in part], add_special_tokens=False), strict=True):
                out[k] = struct.pack(f"<{len(got.ids)}I", *got.ids)
                if len(self.young) < KEPT_WORDS // 2:
                    self.young[words[k]] = out[k]
        return out


_KEPT: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = WordIds(path)
    return _KEPT[path]


class Tokens:
    """Token ids of a batch of texts, each text closed by END_ID.

    ids: of all texts; ends: where each text's ids end; breaks: positions after the last id of a sentence.
    """

    def __init__(self, column: pa.Array, path: str, sentences: bool = False):
        words: Words = words_of(column)
        values = words.values.to_pylist()
        each = word_ids(path).of(values)
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<u4")
        starts = np.cumsum(sizes) - sizes
        n = sizes[words.codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        texts = len(column)
        self.ends = upto[words.offsets[1:]] + np.arange(1, texts + 1)
        self.ids = np.empty(int(upto[-1]) + texts, "<u4")
        closing = np.zeros(len(self.ids), bool)
        closing[self.ends - 1] = True
        self.ids[closing] = END_ID
        self.ids[~closing] = flat[spread(starts[words.codes], n)]
        self.breaks = np.zeros(0, np.int64)
        if sentences:
            last = pc.match_substring_regex(words.values, SENTENCE_END).to_numpy(zero_copy_only=False).astype(bool)[words.codes]
            text_of = np.repeat(np.arange(texts), words.lengths())
            self.breaks = (upto[1:] + text_of)[last]

    def text(self, k: int) -> np.ndarray:
        return self.ids[self.ends[k - 1] if k else 0 : self.ends[k]]
