"""A training corpus from the documents table: five stages, each written as Parquet and read again by the next.

Language ID drops documents without a language of their own, quality rules drop what fails them, the Jaccard
join keeps one document of each group, PII is replaced, and the rest is packed into windows of tokens.  All
stages but the last return the columns of documents; each works on all rows of its predecessor, whole texts,
and takes nulls, empty texts, repeated rows and empty tables; decisions are made by row, so a null id or an id with several
texts loses nothing that passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rigtable.llm import jaccard, langid, packing, pii, quality
from rigtable.llm.catalog import PII_KEY, tokenizer_path
from rigtable.llm.common import stage, table
from rigtable.session import ship

#: A document stays if some language has at least this share of its letters: text that mixes two or three languages is kept.
LANGUAGE_SHARE = 0.3


def keyed(docs: DataFrame) -> DataFrame:
    """Rows (key, row, doc_id, text, lang): the whole row as one column, so names of its columns never clash, beside ``key``.

    The key is a 64-bit hash of id, text and label, on which decisions rest: rows that agree in these are judged alike.
    Ids may be null or occur with several texts.  Two different rows share a key with odds of about n * n / 2^65.
    """
    parts = [x for c in ("doc_id", "text", "lang") for x in (F.col(c).isNull(), F.col(c))]
    return docs.select(F.xxhash64(*parts).alias("key"), F.struct("*").alias("row"), "doc_id", "text", "lang")


def kept_rows(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose key is among distinct keys (column key); only keys and rows meet."""
    return rows.select("key", "row").join(keys, "key", "left_semi")


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts, texts without letters and texts of which no language has ``LANGUAGE_SHARE`` of the letters.

    Labels are those of the table; the predicted language is only the ground for rejection.
    """
    ship(spark)
    model = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    judged = langid.with_language(docs, model)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SHARE)).select("row.*")


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the base rule or a risk-controlled threshold rejects."""
    ship(spark)
    rows = keyed(docs)
    labels = table(spark, sf_dir, "labels").join(rows.select("doc_id", "key"), "doc_id").select(F.col("key").alias("doc_id"), "quality")
    judged = quality.judge(rows, labels, id_col="key")
    return kept_rows(rows, judged.where("kept").select(F.col("doc_id").alias("key")).distinct()).select("row.*")


def by_similarity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group, one without id only if none has one; of repeated rows, one.

    Rows without words are in no group; those of one id and text are repeated rows.  Texts are shuffled once, at the end.
    """
    ship(spark)
    rows = keyed(docs)
    joined = jaccard.join(rows.select("key", "text"), id_col="key").select(F.col("doc_id").alias("key"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("group")).distinct()
    rest = [F.col(f"row.{c}").alias(f"c{i}") for i, c in enumerate(f"`{c}`" for c in docs.columns if c not in ("doc_id", "text"))]
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *rest, F.xxhash64("text").alias("mark"), "key")
    alone = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    bare = rows.select("key", place.alias("place"), alone.alias("alone")).join(joined, "key")
    first = bare.groupBy("group", F.when(F.col("group").isNull(), F.col("alone")).alias("alone")).agg(F.min("place")["key"].alias("key"))
    kept = kept_rows(rows, first.select("key"))
    one = Window.partitionBy("key").orderBy(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    return kept.withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars follows the new text."""
    ship(spark)
    return pii.pseudonymise(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    ship(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language ID", by_language),
    ("quality rules", by_quality),
    ("n-gram Jaccard join", by_similarity),
    ("PII", without_pii),
    ("packing", packed),
]
#: Model fits, hashes and tokenizers are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
