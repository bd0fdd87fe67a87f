"""The corpus pipeline, stage by stage, against plain versions on the smallest tables."""

import os
import re

import odd
import public_tokenizers
import pytest
from test_jaccard import brute
from test_quality import plain
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from rigtable.llm.common import stage

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for _, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), "test")
        out.append(docs)
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert all(sorted(df.columns) == sorted(stages[0].columns) for df in stages[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "quality rules", "n-gram Jaccard join", "PII", "packing"]


def test_each_stage_does_its_work(stages):
    start, language, quality, single, safe = map(by_id, stages[:5])
    assert set(language) == {i for i, r in start.items() if any(c.isalpha() for c in r.text or "")}
    assert set(quality) == {i for i, r in language.items() if not plain(r.text)[-1]}  # too few labels here for learned rules
    groups = {i: c for i, _, c in brute([(i, r.text) for i, r in quality.items()])}
    assert set(single) == {i for i in quality if groups[i] == i}
    leak = re.compile(r"[\w.]+@\w+\.example\.com|\b\d{16}\b|AKIA\w{16}|\+1 \(\d{3}\)")
    assert set(safe) == set(single)
    for i, r in safe.items():
        assert not set(leak.findall(r.text)) & set(leak.findall(single[i].text))
        assert r.text == single[i].text or leak.search(single[i].text) or re.search(r"\d", single[i].text)
        assert r.n_chars == len(r.text)


def test_packing_takes_all_that_is_left(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in by_id(stages[4]).items()}
    have = {}
    for r in stages[5].collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + r.length
    assert have == want


def test_odd_documents_pass_through(spark, tmp_path):
    odd.frame(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_queries_are_registered():
    names = list(contract.queries())
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


def test_rows_are_judged_by_themselves(spark):
    """Null ids, an id with a clean and a rejected text, an id with two unlike texts, repeated rows, a near copy."""
    clean = lambda seed: " ".join(f"{a}{b}" for k, a in enumerate(["the", "on", "thal", "ere", "som"]) for b in [f"{seed}{chr(97 + j)}{chr(97 + (j + k) % 20)}" for j in range(20)])
    a, b, c, d, e = map(clean, "vwxyz")
    rows = [(None, a), (1, b), (1, "123 456"), (2, c), (2, d), (3, e), (3, e), (None, e), (4, e + " more"), (None, "789")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = [{(None, a), (1, b), (2, c), (2, d), (3, e), (None, e), (4, e + " more")}] * 2 + [{(None, a), (1, b), (2, c), (2, d), (3, e)}]
    for (_, step), left in zip(corpus_pipeline.STAGES[:3], want, strict=True):
        docs = stage(step(spark, docs, SF), "test")
        assert {(r.doc_id, r.text) for r in docs.collect()} == left
    assert docs.count() == len(want[-1])


def test_columns_of_any_name_stay(spark):
    """Columns named like those that the stages use inside, or with odd names, come out as they went in."""
    text = " ".join(f"the{chr(97 + k % 20)}{chr(97 + k % 17)} on" for k in range(60))
    names = ["key", "row", "group", "place", "alone", "_row", "_group", "n", "mark", "a b", "lang_pred", "score"]
    columns = ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *range(len(names))) for i, t in [(1, text), (2, text + " end"), (None, text)]], f"doc_id long, text string, lang string, source string, n_chars long, {columns}")
    for _, step in corpus_pipeline.STAGES[:4]:
        docs = step(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
    rows = docs.collect()
    assert [(r.doc_id, *r[5:]) for r in rows] == [(1, *range(len(names)))]


def test_empty_table(spark, tmp_path):
    odd.empty(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
