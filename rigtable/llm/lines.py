"""Line deduplication by range-partitioned hashes: keep bitmaps of documents, not texts.

A line's key is the line without the white space at its ends, A-Z lower-cased.  Every line gives one small row: the
128-bit hash of its key, its document and its position.  These rows are range-partitioned by hash, over equal ranges
of the hash space, and sorted by hash, document and position, so that a partition streams the occurrences of a hash
in the order of the corpus: the first row of a hash is its first occurrence, the first row of a document in it counts
the document.  A hash more frequent than its range holds rows for (found by a mergeable frequent-items sketch over all
lines, whose size is fixed by the number of ranges) is dealt over several ranges by document; its counts and
first occurrence there are joined from one row a range.

Lines to drop leave as bits: 64 lines a word, words that keep all their lines left out.  Two laws:

* ``none``: a key found in at least ``min_docs`` documents loses all its lines;
* ``first``: such a key keeps the line at its first occurrence (documents by id, null last, then by text hash).

Everything is column expressions.  Null or empty text: one empty line.  Keys of fewer than ``min_chars`` code points
are never dropped.  A row is a document, whatever its id; rows of one id and text are documents of their own
when documents are counted, and are judged alike.  Other columns are not read.  Empty table: no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigtable.llm.common import shuffle_parts, stage

SPACES = " \t\n\x0b\f\r"
#: Lines of a range, about; hashes dealt over several ranges at most.
RANGE_LINES, HOT = 2_000_000, 20_000
NONE, FIRST = "none", "first"


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def with_mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text, mark); id and mark, a hash of the text, name a document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("mark", F.xxhash64("text"))


def occurrences(marked: DataFrame, min_chars: int = 1) -> DataFrame:
    """Rows (h1, h2, doc_id, mark, pos, deal) of every line whose key has ``min_chars`` code points; deal: equal on a row's lines."""
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    # Equal rows of one id and text are told apart by their input partition, which a task that runs again keeps.
    deal = F.xxhash64("doc_id", "mark", F.spark_partition_id())
    lines = marked.select("doc_id", "mark", deal.alias("deal"), F.posexplode(F.split(low, "\n")).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "mark", "pos", "deal")


def ranged(lines: DataFrame) -> tuple[DataFrame, int]:
    """Lines with ``part``, a range of the hash space, and ``hot``: dealt over several; and the number of ranges."""
    spark = lines.sparkSession
    least = shuffle_parts(spark)
    tracked = 64 * least + 4096
    total = stage(lines.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h1, {min(HOT, 4 * least)}, {tracked})").alias("top")), "line-counts")
    n = total.first()["n"]
    parts = max(least, -(-n // RANGE_LINES))
    share = max(n // parts, 1)
    # At most HOT rows.
    hot = total.select(F.explode("top").alias("top")).where(F.col("top.count") > share / 4).select(
        F.col("top.item").alias("h1"), F.least(F.ceil(F.col("top.count") * 2 / share), F.lit(parts)).cast("int").alias("ways")
    )
    home = F.least((F.shiftrightunsigned("h1", 1) / F.lit(2.0**63) * parts).cast("int"), F.lit(parts - 1))
    spread = home + F.pmod(F.col("deal"), F.col("ways")).cast("int")
    dealt = lines.join(F.broadcast(hot), "h1", "left")
    part = F.when(F.col("ways").isNull(), home).otherwise(F.pmod(spread, F.lit(parts)))
    return dealt.select("h1", "h2", "doc_id", "mark", "pos", part.alias("part"), F.col("ways").isNotNull().alias("hot")), parts


def dropped_lines(marked: DataFrame, law: str = NONE, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Rows (doc_id, mark, pos) of the lines to drop; marked: see ``with_mark``."""
    if law not in (NONE, FIRST):
        raise ValueError(f"unknown law {law!r}")
    lines, parts = ranged(occurrences(marked, min_chars))
    rows = lines.repartitionById(parts, F.col("part"))
    hash_ = ["part", "h1", "h2"]
    place = [F.col("doc_id").asc_nulls_last(), "mark", "pos"]
    stream = Window.partitionBy(*hash_).orderBy(*place)
    whole = stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "pos")
    # The first line of each document in a hash, counted once a row; rows are in order, so no further sort.
    opens = (F.rank().over(Window.partitionBy(*hash_, F.col("doc_id"), "mark").orderBy("pos")) == 1).cast("long")
    seen = rows.withColumn("opens", opens).withColumn("here", here)
    seen = seen.withColumn("docs", F.sum("opens").over(whole)).withColumn("first", F.first("here").over(whole))
    seen = seen.where(F.col("hot") | (F.col("docs") >= min_docs))
    found = stage(seen.select("h1", "h2", "doc_id", "mark", "pos", "part", "hot", "docs", "first", (F.col("here") == F.col("first")).alias("leads")), "line-candidates")
    one = found.where("hot").groupBy(*hash_).agg(F.first("docs").alias("docs"), F.first("first").alias("first"))  # a row a range
    joint = one.groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.min("first").alias("all_first"))
    cold = found.where("NOT hot").select("doc_id", "mark", "pos", "leads")
    mixed = found.where("hot").select("h1", "h2", "doc_id", "mark", "pos", "first", "leads").join(F.broadcast(joint.where(F.col("all_docs") >= min_docs)), ["h1", "h2"])
    warm = mixed.select("doc_id", "mark", "pos", (F.col("leads") & (F.col("first") == F.col("all_first"))).alias("leads"))
    gone = cold.unionByName(warm)
    return (gone if law == NONE else gone.where("NOT leads")).drop("leads")


def bitmaps(gone: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, n_dropped, keep): keep bits by words of 64 lines, in order; a word not listed keeps all."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))
    words = gone.groupBy("doc_id", "mark", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "mark").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep")
    )  # a row a word of one document


def _join(left: DataFrame, maps: DataFrame) -> DataFrame:
    maps = maps.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "n_dropped", "keep")
    same = left["doc_id"].eqNullSafe(maps["_id"]) & (left["mark"] == maps["_mark"])
    return left.join(maps, same, "left").withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0)).cast("long"))


def line_bitmaps(docs: DataFrame, law: str = NONE, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, keep) of every document; no text is shuffled."""
    marked = with_mark(docs, id_col, text_col)
    sizes = marked.select("doc_id", "mark", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    joined = _join(sizes, bitmaps(dropped_lines(marked, law, min_docs, min_chars)))
    return joined.select("doc_id", "n_lines", "n_dropped", F.coalesce("keep", F.array().cast("array<struct<word:int,bits:bigint>>")).alias("keep"))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines whose bit is set."""
    gap = lambda s, i: s["word"] - F.coalesce(F.get(keep, i - 1)["word"], F.lit(-1)) - 1
    dense = F.flatten(F.transform(keep, lambda s, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), gap(s, i)), F.array(s["bits"]))))
    # The dense words are bound once, as the only element of an array, and not worked out again for every line.
    held = F.transform(F.array(dense), lambda d: F.filter(lines, lambda _, i: F.getbit(F.coalesce(F.get(d, F.floor(i / 64).cast("int")), F.lit(-1).cast("long")), i % 64) == 1))
    return F.when(keep.isNull() | (F.size(keep) == 0), lines).otherwise(F.get(held, 0))


def kept_texts(docs: DataFrame, law: str = NONE, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, text): texts of the lines that stay, joined by line ends."""
    marked = with_mark(docs, id_col, text_col)
    joined = _join(marked, bitmaps(dropped_lines(marked, law, min_docs, min_chars)))
    lines = F.split("text", "\n")
    return joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"), "n_dropped", F.array_join(kept_lines(lines, F.col("keep")), "\n").alias("text"))


def op11(docs: DataFrame) -> DataFrame:
    return kept_texts(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: ``op11`` in DuckDB's SQL.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM l),
bad AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, bad.key IS NOT NULL AS gone FROM k LEFT JOIN bad ON k.key = bad.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m JOIN d USING (r) GROUP BY r, doc_id
"""
