"""The similarity join against all pairs."""

import random
from collections import Counter

import odd
import pytest

from rigtable.llm import jaccard
from rigtable.llm.components import components


def groups(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    own = [(i, s) for i, s in sets if i is not None and s]
    links = [(a, b) for k, (a, s) in enumerate(own) for b, t in own[:k] if 100 * len(s & t) >= percent * len(s | t)]
    component = groups({i for i, _ in sets if i is not None}, links)
    return Counter((i, len(s), component.get(i)) for i, s in sets)


def near_copies(seed):
    rng = random.Random(seed)
    rows, k = [], 1000
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 90))]
        for _ in range(rng.randint(2, 25)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"v{rng.randrange(4)}"
            if rng.random() < 0.3:
                w += ["shared", "passage", "of", "many", "documents", "here"]
            rows.append((k, " ".join(w)))
            k += 1
    return rows


@pytest.mark.parametrize("percent", [80, 60])
def test_same_as_all_pairs(spark, percent):
    rows = [(r[0], r[1]) for r in odd.rows()] + near_copies(percent)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, percent)
    assert all(r.class_id is None or r.component_id <= r.class_id <= r.doc_id for r in got if r.doc_id is not None)


def test_extra_columns_and_empty_table(spark):
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(odd.frame(spark)).collect()) == brute([(r[0], r[1]) for r in odd.rows()])
    assert jaccard.join(odd.empty(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    real = [(a, b) for a, b in links if a != b]
    want = groups({x for pair in real for x in pair}, real)
    assert got == want


def brute_links(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    own = [k for k, (i, s) in enumerate(sets) if i is not None and s]
    near = lambda s, t: 100 * len(s & t) >= percent * len(s | t)
    return Counter((i, sum(near(s, sets[j][1]) for j in own if j != k) if k in own else 0) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("chunk", [512, 7])
def test_every_link_is_counted(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = [(r[0], r[1]) for r in odd.rows()] + near_copies(3)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == brute_links(rows)
    assert max(r.n_links for r in got) > 7


def test_null_copies_and_ids_with_two_texts(spark):
    """Null-id copies of near-duplicated texts, and ids that have two texts, smallest of their class or not."""
    word = lambda name, n: [f"{name}{k}" for k in range(n)]
    text = lambda name, *changed: " ".join(f"z{i}" if i in changed else w for i, w in enumerate(word(name, 60)))
    rows = [(k, text(f"a{k % 5}", *([59] if k >= 5 else []))) for k in range(10)] + [(None, text(f"a{k}", *extra)) for k in range(5) for extra in ([], [59])]
    rows += [(20, text("b")), (20, text("c")), (21, text("b", 59)), (22, text("c", 59)), (23, text("d")), (24, text("d", 59)), (30, text("d")), (30, text("e")), (28, text("e", 0)), (31, text("e"))]
    rows += [(40, text("f")), (40, text("f", 59)), (41, text("f", 0)), (42, text("g")), (43, text("h")), (44, text("g")), (44, text("h"))]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert Counter((r.doc_id, r.n_links) for r in got) == brute_links(rows)


def test_last_join_takes_a_pair_only_where_it_may_first_meet(spark):
    """Sets of 100 need 89 in common: a pair that first meets on token 20 cannot link, one that meets on token 11 can."""
    bits = ", ".join(["0L"] * jaccard.BITMAP)
    met = spark.sql(f"""SELECT a, b, 100L AS n_a, 100L AS n_b, i AS k_a, i AS k_b, i, i AS j, array({bits}) AS bits_a, array({bits}) AS bits_b
        FROM VALUES (1L, 2L, 11), (1L, 2L, 12), (3L, 4L, 20), (5L, 6L, 11) t(a, b, i)""")
    pairs = lambda df: sorted(tuple(r) for r in df.collect())
    assert pairs(jaccard.filtered(met, 80)) == [(1, 2), (3, 4), (5, 6)]
    assert pairs(jaccard.filtered(met, 80, every=True)) == [(1, 2), (5, 6)]
