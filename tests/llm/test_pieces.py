"""Prefix-table encoding against the sentencepiece library."""

import hashlib
from collections import Counter

import odd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from rigtable.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TABLE = pieces.PrefixTable(PATH)


def same(texts):
    for text, (n, ids, decoded) in zip(texts, TABLE.encoded(pa.array(texts, pa.string())), strict=True):
        want = LIBRARY.encode(text or "")
        assert ids.decode() == ",".join(map(str, want)) and n == len(want)
        assert decoded.decode() == LIBRARY.decode(want)
        assert TABLE.decode(want) == LIBRARY.decode(want)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeinrsth ▁\n.,0日é\U0001f642"), max_size=40), min_size=1, max_size=5))
def test_any_text(texts):
    same(texts)


def test_odd_texts():
    same([*odd.texts(), "<s> </s> <unk> <0x41>", "▁", "▁▁x", "a▁▁ b", "\x00\x01", " \n \n"])


def test_every_prefix_has_its_own_last_token():
    for word in ("▁thandering", "▁erererer", "aaaaaaaa", "▁Straße"):
        last = TABLE.last_tokens(word)
        for k in range(1, len(word) + 1):
            if not word[:k].startswith("▁") or k == 1:
                continue
            assert last[k - 1] == LIBRARY.id_to_piece(LIBRARY.encode(word[1:k])[-1])


def test_digests(spark):
    got = Counter(tuple(r) for r in pieces.digests(odd.frame(spark), PATH).collect())
    want = Counter()
    for r in odd.rows():
        ids = LIBRARY.encode(r[1] or "")
        texts = ",".join(map(str, ids)), LIBRARY.decode(ids) if ids else ""
        want[(r[0], len(ids), *(hashlib.sha256(t.encode()).hexdigest() for t in texts))] += 1
    assert got == want
    assert pieces.digests(odd.empty(spark), PATH).count() == 0
    ids = {r.doc_id: r.ids for r in pieces.encode_texts(odd.frame(spark, False), PATH).collect()}
    assert ids == {r[0]: LIBRARY.encode(r[1] or "") for r in odd.rows(False)}
