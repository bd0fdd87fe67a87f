"""Line deduplication against plain counts."""

import hashlib
import random
from collections import Counter, defaultdict

import odd
import pytest

from rigtable.llm import lines

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(WHITE).translate(LOWER)


def plain(rows, law="none", min_docs=10, min_chars=1):
    """(id, lines, dropped, kept text) of every row."""
    docs = [(i, (t or "").split("\n")) for i, t in rows]
    found, first = defaultdict(set), {}
    for r, (i, ls) in enumerate(docs):
        for pos, line in enumerate(ls):
            found[key(line)].add(r)
            place = (i is None, i or 0, pos, "\n".join(ls))
            first[key(line)] = min(first.get(key(line), place), place)
    out = []
    for i, ls in docs:
        gone = set()
        for pos, line in enumerate(ls):
            k = key(line)
            lead = law == "first" and first[k] == (i is None, i or 0, pos, "\n".join(ls))
            if len(k) >= min_chars and len(found[k]) >= min_docs and not lead:
                gone.add(pos)
        out.append((i, len(ls), len(gone), "\n".join(x for p, x in enumerate(ls) if p not in gone)))
    return Counter(out)


def corpus(seed=4):
    rng = random.Random(seed)
    common = ["Subscribe now", "  subscribe NOW\t", "Footer ünïcode É", "É", "\r", " ", "", "x"]
    rows = []
    for k in range(90):
        ls = [rng.choice(common) if rng.random() < 0.4 else f"own line {rng.randint(0, 400)}" for _ in range(rng.choice([1, 3, 20, 150]))]
        rows.append((k, "\n".join(ls)))
    rows.append((200, "\n".join(["x"] * 700 + ["tail"] + ["X "] * 300)))
    return rows + [(i, t) for i, t, *_ in odd.rows()] + [(None, "subscribe now\nmine"), (None, "subscribe now\nmine"), (3, "same id, other text\nx")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "h", "k", "m", 0) for i, t in rows], "doc_id long, text string, pos int, h1 string, keep string, mark string, part int").repartition(5)


@pytest.mark.parametrize(("min_docs", "min_chars"), [(10, 1), (2, 1), (3, 5)])
def test_kept_texts(spark, min_docs, min_chars):
    rows = corpus()
    got = lines.kept_texts(frame(spark, rows), min_docs=min_docs, min_chars=min_chars).collect()
    assert Counter(map(tuple, got)) == plain(rows, "none", min_docs, min_chars)


@pytest.mark.parametrize("share", [1, 40])
def test_hot_lines_are_dealt_over_ranges(spark, monkeypatch, share):
    rows = corpus(7) + [(1000 + k, "boiler plate\nboiler plate\nline %d" % k) for k in range(400)] + [(None, "copies\nall alike")] * 60
    monkeypatch.setattr(lines, "RANGE_LINES", share * 10)
    df = frame(spark, rows)
    marked = lines.with_mark(df)
    dealt, parts = lines.ranged(lines.occurrences(marked))
    hot = dealt.where("hot").groupBy("h1").agg({"part": "max", "doc_id": "count"}).count()
    assert parts > 4 and hot >= 1
    assert Counter(map(tuple, lines.kept_texts(df).collect())) == plain(rows)


def test_first_occurrence_stays(spark):
    seen = {}
    for i, t in corpus(9):
        seen.setdefault(i, (i, t))
    rows = list(seen.values())
    got = lines.kept_texts(frame(spark, rows), law="first", min_docs=1).collect()
    assert Counter(map(tuple, got)) == plain(rows, "first", 1)
    with pytest.raises(ValueError):
        lines.dropped_lines(lines.with_mark(frame(spark, rows)), "last")


def test_bitmaps_hold_no_text(spark):
    rows = corpus()
    got = lines.line_bitmaps(frame(spark, rows)).collect()
    want = plain(rows)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped) for r in got) == Counter(x[:3] for x in want.elements())
    for r in got:
        words = [w.word for w in r.keep]
        assert words == sorted(set(words)) and all(w.bits != -1 for w in r.keep)
        assert r.n_dropped == sum(64 - bin(w.bits & (2**64 - 1)).count("1") for w in r.keep)


def test_query(spark):
    rows = corpus()
    got = lines.op11(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter({(i, n, d, hashlib.sha256(t.encode()).hexdigest()): c for (i, n, d, t), c in plain(rows).items()})
    assert lines.op11(odd.empty(spark)).count() == 0
