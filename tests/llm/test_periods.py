"""Periodic runs against every period of every stretch."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import odd
import pytest

from rigtable.llm import periods


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def plain(w):
    """All runs, straight from the definition."""
    out, n = [], len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q):
                part = w[i : i + length]
                if not any(all(part[x] == part[x + d] for x in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def rewritten(i, w):
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def digest(i, text):
    w = rewritten(i, words(text))
    runs = plain(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *told, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(collapsed(w, runs)))


def periodic(rng, alphabet):
    parts = []
    for _ in range(rng.randint(1, 4)):
        unit = [rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 60]))]
        if rng.random() < 0.3:
            unit = unit * 2 + unit[: rng.randint(0, len(unit))]
        parts += (unit * 6)[: int(len(unit) * rng.choice([2, 2.9, 3, 3.4, 5.5]))]
        parts += [rng.choice(alphabet) for _ in range(rng.randint(0, 6))]
    return parts


@pytest.mark.parametrize("letters", [1, 2, 3, 12])
def test_runs_of_all_lags(letters):
    rng = random.Random(letters)
    texts = [periodic(rng, "abcdefghijkl"[:letters]) for _ in range(150)] + [[], ["a"], ["a"] * 23, ["a"] * 24, ["a", "b"] * 12]
    codes = np.array([ord(x) for t in texts for x in t], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = periods.runs_of(codes, offsets)
    assert got == [plain(t) for t in texts]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def test_words_with_many_overlapping_runs():
    for t in (fibonacci(900), ["a"] * 3000, (["a"] * 40 + ["b"]) * 9, list("aab" * 30 + "aabaab" * 20), (list("abcab" * 7) + ["z"]) * 5):
        codes = np.array([ord(x) for x in t], np.int64)
        assert periods.runs_of(codes, np.array([0, len(codes)])) == [plain(t)]


def test_long_text_is_near_linear():
    rng = random.Random(1)
    block = [rng.randint(0, 5000) for _ in range(60_000)]
    codes = np.array(block * 4 + [7] * 100_000 + [rng.randint(0, 3) for _ in range(100_000)], np.int64)
    runs = periods.runs_of(codes, np.array([0, len(codes)]))[0]
    assert (0, 240_000, 60_000) in [(s, n - n % 60_000, q) for s, n, q in runs] and any(q == 1 and n >= 100_000 for _, n, q in runs)


def test_operator_and_query(spark, monkeypatch):
    monkeypatch.setattr(periods, "SLICE", 2000)
    rng = random.Random(5)
    rows = [(k, "  ".join(periodic(rng, "abcdefgh")) + rng.choice(["", "\n", " \t"])) for k in range(300)]
    rows += [(i + 400 if i is not None else None, t) for i, t, *_ in odd.rows() if len(t or "") < 5000]
    df = spark.createDataFrame([(i, t, 1, "r", 2, "w") for i, t in rows], "doc_id long, text string, n int, runs string, g int, words string").repartition(3)
    got = periods.periodic_runs(df).collect()
    want = Counter()
    for i, t in rows:
        w = words(t)
        want[(i, len(w), tuple(plain(w)), collapsed(w, plain(w)))] += 1
    assert Counter((r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in got) == want
    assert Counter(map(tuple, periods.op12(df).collect())) == Counter(digest(i, t) for i, t in rows)


def test_empty_table(spark):
    assert periods.op12(odd.empty(spark)).count() == 0


def test_long_and_odd_texts(spark):
    got = periods.op12(odd.frame(spark)).collect()
    assert len(got) == len(odd.rows()) and all(r.runs_sha256 and r.collapsed_sha256 for r in got)
