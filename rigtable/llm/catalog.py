"""The operators and the pipeline as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rigtable.llm import jaccard, langid, lines, lm, negatives, packing, periods, pieces, pii, quality, sharding, tokenfile, vectors
from rigtable.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return add


def tokenizer_path(name: str) -> str:
    """A public vocabulary's file, installed beside the libraries on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The key of the surrogates; a deployment passes its own secret.
PII_KEY = "rigtable-demo-key"


@query("op1_pii_surrogates")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY)


@query("op2_ngram_jaccard")
def _(spark, d):
    return jaccard.join(table(spark, d, "documents"))


@query("op3_hash_tree")
def _(spark, d):
    return sharding.place(table(spark, d, "documents"), sharding.even_tree(8))


@query("op4_token_files")
def _(spark, d):
    return tokenfile.op4(spark, table(spark, d, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op8_packing")
def _(spark, d):
    return packing.pack(table(spark, d, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op5_quality_rules", quality.oracle())
def _(spark, d):
    return quality.op5(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op6_language_spans")
def _(spark, d):
    return langid.op6(table(spark, d, "documents"))


@query("op7_sentencepiece")
def _(spark, d):
    return pieces.digests(table(spark, d, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op9_embedding_dedup")
def _(spark, d):
    return vectors.near_duplicates(table(spark, d, "embeddings"))


@query("op10_lattice_score")
def _(spark, d):
    return lm.score(table(spark, d, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op11_line_dedup", lines.ORACLE)
def _(spark, d):
    return lines.op11(table(spark, d, "documents"))


@query("op12_periodic_runs")
def _(spark, d):
    return periods.op12(table(spark, d, "documents"))


@query("op13_hard_negatives", negatives.ORACLE)
def _(spark, d):
    return negatives.op13(table(spark, d, "embeddings"))
