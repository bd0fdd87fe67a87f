"""Quality rules: counts by hand, the binomial tail, thresholds, and the SQL twin."""

import math
from collections import Counter

import odd
from pyspark.sql import functions as F

from rigtable.llm import quality


def plain(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    n, repeat = len(words), len(covered)
    return n, sum(map(len, words)), sum(text.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), repeat, n < 50 or 100 * repeat > 50 * n


def test_counts(spark):
    extra = ["a b c a b c a b c d", "l1\nl2\nl1\n \n\nl2 ", "#*$%&|<> é# " * 30, "z " * 200]
    rows = odd.rows() + [(900 + k, t, *odd.rows()[0][2:]) for k, t in enumerate(extra)]
    docs = spark.createDataFrame(rows, odd.SCHEMA)
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")
    got = quality.op5(docs, labels).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((r[0], *plain(r[1])) for r in rows)
    assert all(r.kept == (not r.base_failed) for r in got)  # too few labels for any learned rule
    assert quality.op5(odd.empty(spark), labels).count() == 0
    assert quality.op5(docs, labels.where("1 = 0")).count() == len(rows)


def test_binomial_tail(spark):
    cases = [(1, 0), (10, 0), (10, 9), (10, 10), (500, 3), (5000, 40), (5000, 62), (5000, 90), (100_000, 1100), (100_000, 1300)]
    p = 0.0125
    got = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality.incomplete_beta_tail(F.col("n"), F.col("k"), p).alias("p")).collect()
    for r in got:
        terms = (math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(p) + (r.n - i) * math.log1p(-p) for i in range(r.k + 1))
        assert math.isclose(r.p, math.fsum(map(math.exp, terms)), rel_tol=1e-6)


def test_thresholds_hold_the_risk(spark):
    # In stratum a good documents have few symbols; in b there are too few labels.
    rows = [(k, "a", 1, (k % 100) / 1000) for k in range(3000)] + [(k, "a", 0, 0.3) for k in range(3000, 3300)] + [(k, "b", k % 2, 0.3) for k in range(4000, 4040)]
    df = spark.createDataFrame(rows, "doc_id long, stratum string, quality int, symbol_share double")
    measured = df.withColumns({"n_words": F.lit(100), "n_repeat_words": F.lit(0), **{r: F.lit(0.0) for r in quality.RULES if r != "symbol_share"}})
    found = quality.thresholds(measured, df.select("doc_id", "quality")).collect()
    assert [(r.stratum, r.rule) for r in found] == [("a", "symbol_share")]
    assert 0.09 <= found[0].cutoff < 0.3
    # At a cutoff of 0.088388 no more than the risk's share is lost; anything stricter is not provable.
    strict = quality.thresholds(measured.where("quality = 1 OR stratum = 'b'").withColumn("symbol_share", F.col("symbol_share") * 10), df.select("doc_id", "quality")).collect()
    assert strict == []


def test_same_as_sql(spark, tmp_path):
    import duckdb

    docs = odd.frame(spark, False).select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(k * 3, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("labels", labels)):
        con.register(f"{name}_", df.toPandas())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_")
    want = con.execute(quality.oracle()).fetchall()
    assert Counter(map(tuple, want)) == Counter(tuple(r) for r in quality.op5(docs, labels).collect())
