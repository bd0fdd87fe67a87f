"""Near-duplicate vectors against all pairs."""

import math
from collections import Counter

import numpy as np
from test_jaccard import groups

from rigtable.llm import vectors

SCHEMA = "vec_id long, embedding array<double>, label int, signs string, v int"


def rows(seed=3, dim=24):
    rng = np.random.default_rng(seed)
    out, k = [], 0
    for noise, copies in ((0.0, 5), (0.15, 40), (0.25, 60), (0.6, 20)):
        base = rng.standard_normal(dim)
        for _ in range(copies):
            out.append((k, (base + noise * rng.standard_normal(dim)).tolist()))
            k += 2
    out += [(k + j, rng.standard_normal(dim).tolist()) for j in range(40)]
    odd = [None, [], [0.0] * dim, [1.0] * (dim - 1) + [None], [math.nan] * dim, [math.inf] * dim, [1.0, 2.0], [2.0, 4.0], [1e300, 2e300], [-1e-300, -2e-300]]
    return out + [(5000 + j, v) for j, v in enumerate(odd)] + [(None, out[0][1]), out[1]]


def brute(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = [(v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for _, v in good]
    n, links = [0] * len(good), []
    for a in range(len(good)):
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                n[a] += 1
                n[b] += 1
                links.append((good[a][0], good[b][0]))
    component = groups({i for i, _ in rows if i is not None}, links)
    found = [(i, k, component[i]) for (i, _), k in zip(good, n, strict=True)]
    used = Counter(i for i, _ in good)
    rest = [(i, 0, component.get(i)) for i, v in rows if used[i] == 0 or i is None]
    return Counter(found + rest)


def test_links_of_all_pairs(spark):
    data = rows()
    df = spark.createDataFrame([(i, v, 1, "s", 2) for i, v in data], SCHEMA)
    got = vectors.near_duplicates(df).collect()
    want = brute(data)
    have = Counter((r.vec_id, r.n_links, r.component_id) for r in got)
    assert sum(n for _, n, _ in have.elements()) >= 0.99 * sum(n for _, n, _ in want.elements())
    assert Counter((i, c) for i, _, c in have.elements()) == Counter((i, c) for i, _, c in want.elements())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_large_buckets_are_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 16)
    monkeypatch.setattr(vectors, "SMALL", 8)
    data = rows(seed=5)
    got = vectors.near_duplicates(spark.createDataFrame([(i, v, 1, "s", 2) for i, v in data], SCHEMA)).collect()
    want = brute(data)
    assert sum(r.n_links for r in got) >= 0.99 * sum(n for _, n, _ in want.elements())
    assert sum(r.n_links for r in got) <= sum(n for _, n, _ in want.elements())


def test_empty_table(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tables_reach_the_recall():
    for n in (10, 10_000, 10**10):
        bits, tables = vectors.tables_for(n, 0.95)
        agree = (1 - math.acos(0.95) / math.pi) ** bits
        assert 1 - (1 - agree) ** tables >= vectors.RECALL
