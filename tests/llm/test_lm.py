"""Lattice scores against enumeration, base scores against plain counts."""

import math
import zlib
from collections import Counter

import numpy as np
import odd
import public_tokenizers
import pytest

from rigtable.llm import lm

PATH = public_tokenizers.path("piece_bpe_32k.model")


def paths(word, logs, pieces):
    """Log probabilities of all segmentations."""
    known = {p: k for k, p in enumerate(pieces)}

    def walk(rest):
        if not rest:
            yield 0.0
        for size in range(1, len(rest) + 1):
            head = rest[:size]
            if head in known:
                own = logs[known[head]]
            elif size == 1:
                own = logs[len(pieces)] - math.log(256) * len(head.encode())
            else:
                continue
            for tail in walk(rest[size:]):
                yield own + tail

    return list(walk(lm.MARK + word))


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "abc", "bb"]
    logs = np.log(np.array([3, 5, 2, 2, 4, 1, 1, 1, 2, 0.5]) / 21.5)
    words = ["a", "ab", "abab", "bbabc", "éa", "日ab", "c", "a" * 9]
    got, expected = lm.Lattice(pieces).scores(words, logs, np.ones(len(words)))
    want = [np.logaddexp.reduce(paths(w, logs, pieces)) for w in words]
    assert np.allclose(got, want)
    # Every character of a word is under one expected piece.
    length = sum(n * len(p) for n, p in zip(expected, [*pieces, "?"], strict=True))
    assert math.isclose(length, sum(len(w) + 1 for w in words))


@pytest.fixture(scope="module")
def scored(spark):
    return lm.score(odd.frame(spark), PATH).collect()


def test_base_score(scored):
    counts, docs = Counter(), odd.rows()
    training = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    for r in docs:
        if training(r[0]):
            counts.update([*(r[1] or "").encode().lower().split(), "<end>"])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in docs:
        words = [*(r[1] or "").encode().lower().split(), "<end>"]
        base = math.fsum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        want[(r[0], not training(r[0]), len(words), sum(counts[w] > 0 for w in words), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored) == want


def test_scores_are_probabilities(scored):
    assert all(math.isfinite(r.score) and r.score < 0 for r in scored)
    one = {r.doc_id: r.score for r in scored}
    assert one[0] == one[3]  # a null and an empty text are the end token only


def test_empty_table(spark):
    assert lm.score(odd.empty(spark), PATH).count() == 0
