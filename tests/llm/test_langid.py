"""Language spans: the best path by enumeration, accuracy on held-out documents, odd rows."""

import itertools
import os
import tracemalloc

import numpy as np
import odd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rigtable.llm import langid
from rigtable.llm.words import words_of

SF = "/root/testdata/sf0.001"


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    texts = ["a b c a b", "", "c", "b b a c a c b", None, "a a"]
    words = words_of(pa.array(texts))
    scores, prior = rng.normal(size=(len(words.values), 3)), rng.normal(size=3)
    got = langid.viterbi(words, scores, prior, 0.8)
    for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
        own = words.codes[a:b]

        def value(path, own=own):
            return prior[path[0]] + sum(scores[w, s] for w, s in zip(own, path, strict=True)) - 0.8 * sum(x != y for x, y in zip(path, path[1:], strict=False)) if path else 0

        best = max(value(p) for p in itertools.product(range(3), repeat=b - a))
        assert value(tuple(got[a:b].tolist())) == pytest.approx(best)


def test_scripts_narrow_candidates(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("привет мир как дела друг", "ru"), ("hello world how are you friend", "en")] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    mixed = spark.createDataFrame([(1, "hello world how are you привет мир как дела друг привет"), (2, "日本語"), (3, "мир")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.label_spans(mixed, model).collect()}
    assert [(s.start, s.n_words, s.lang) for s in got[1].spans] == [(0, 5, "en"), (5, 6, "ru")]
    assert got[2].lang_pred in ("en", "ru") and got[3].lang_pred == "ru" and 0 < got[1].score < 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = langid.op6(docs).where("held_out").join(docs, "doc_id")
    n, right = both.agg(F.count("*"), F.count_if(F.col("lang_pred") == F.col("lang"))).first()
    assert n > 20 and right >= 0.97 * n


def test_odd_rows(spark):
    got = langid.op6(odd.frame(spark)).collect()
    assert len(got) == len(odd.rows())
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "und") for r in got)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (0, 3, 6, 9))
    assert langid.op6(odd.empty(spark)).count() == 0
    blank = odd.frame(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.op6(blank).collect()} == {"und"}


def test_counting_holds_slices_of_a_batch():
    """Memory follows ``FIT_SLICE``, not the batch, and the counts are the same."""
    texts = [f"wort{i} mit buchstaben{i % 97} und noch etwas text " * 40 for i in range(8_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["de", "en"] * 4_000)], ["text", "lang"])

    def total(batches):
        out = {}
        for part in langid.counted(iter(batches)):
            for lang, feature, n in zip(*(part.column(c).to_pylist() for c in ("lang", "feature", "n")), strict=True):
                out[lang, feature] = out.get((lang, feature), 0) + n
        return out

    tracemalloc.start()
    whole = total([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert whole == total([batch.slice(k, 500) for k in range(0, 8_000, 500)])
