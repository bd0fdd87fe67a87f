"""Quality rules with risk-controlled thresholds.

A rule rejects a document whose measure exceeds a cutoff, chosen for each stratum (language) from a fixed grid.
A cutoff is safe if labelled good documents prove, by an exact binomial test, that it rejects less than ``risk`` /
rules of the good documents: with n good ones of which k are rejected the p-value P(Binomial(n, risk / rules) <= k)
stays below ``error`` / (strata * rules).  Strata and rules share the error (Bonferroni); the cutoffs of a rule are
tested from the loosest on and end at the first failure, which needs no further share (fixed sequence; a stricter
cutoff rejects no fewer, so p-values only rise).  With probability 1 - ``error`` no stratum loses more than the
share ``risk`` of its good documents by these rules.  Of the safe cutoffs the one is used that rejects most
labelled bad documents, a good one counting ``COST`` times, and of equals the loosest; a stratum without a safe
and useful cutoff goes without the rule.

Everything is column expressions.  The binomial tail is the regularised incomplete beta function, by its
continued fraction, so its cost does not depend on n.

Null and empty text: no words, fails the base rule.  Null stratum: a stratum of its own.  Documents labelled
more than once count once, as good if any label is.  Repeated rows are judged alike.  Empty tables: no rows; no
labels: no learned rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigtable.llm.common import stage

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\f\r"
#: Cutoffs that are tested, for shares between 0 and 1.
GRID = [round(2.0 ** (-k / 2), 6) for k in range(18, 0, -1)]
RULES = ("symbol_share", "dup_line_share", "repeat_share", "shout_share")
RISK, ERROR, COST = 0.05, 0.05, 20
MIN_WORDS = 50


def replaced(text: Column, chars: str, by: str) -> Column:
    for char in chars:
        text = F.replace(text, F.lit(char), F.lit(by))
    return text


def log_gamma(x: Column) -> Column:
    """ln Gamma for x >= 1: Stirling's series at x + 8, stepped back."""
    y = x + 8
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return series - F.ln(product)


def incomplete_beta_tail(n: Column, k: Column, p: float, steps: int = 400) -> Column:
    """P(Binomial(n, p) <= k), 0 <= k <= n: I of 1 - p with (n - k, k + 1).

    The continued fraction converges where its argument is below the mean of the beta law, that is for a tail
    below one half; above it the complement is used.
    """
    n, k = n.cast("double"), k.cast("double")
    a, b = n - k, k + 1

    def fraction(a: Column, b: Column, x: float) -> Column:
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
        tiny = 1e-300

        def away(v: Column) -> Column:
            return F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

        def half(s: Column, term: Column) -> Column:
            d = 1 / away(1 + term * s["d"])
            c = away(1 + term / s["c"])
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

        def step(s: Column, m: Column) -> Column:
            m = m.cast("double")
            s = half(s, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
            return half(s, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

        first = 1 / away(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["h"] * front

    below = 1 - p < (a + 1) / (a + b + 2)
    value = F.when(below, fraction(a, b, 1 - p)).otherwise(1 - fraction(b, a, p))
    return F.when(k >= n, F.lit(1.0)).otherwise(value)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Counts and shares of every document: doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, rule shares."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spaced = replaced(F.col("text"), SPACES, " ")
    bare = F.replace(spaced, F.lit(" "), F.lit(""))
    # A line counts if something is left without its white space.
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(replaced(x, SPACES, " "))) > 0)
    rows = rows.select(
        "doc_id", "stratum", F.array_remove(F.split(spaced, " "), "").alias("words"), F.length(bare).cast("long").alias("word_chars"),
        sum((F.octet_length("text") - F.octet_length(F.replace("text", F.lit(s), F.lit(""))) for s in SYMBOLS), F.lit(0)).cast("long").alias("n_symbols"),
        lines.alias("lines"), (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]{2,}", ""))).cast("long").alias("n_shouted"),
    )
    # Hashes of three-word windows with their place, sorted: equal windows stand side by side.
    w = F.col("words")
    rows = rows.select(
        "doc_id", "stratum", F.size(w).cast("long").alias("n_words"), "word_chars", "n_symbols", "n_shouted", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform(w, lambda x: F.xxhash64(x)).alias("h"),
    )
    h = F.col("h")
    windows = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    rows = rows.withColumn("windows", windows).drop("h")
    repeated = F.size("windows") > F.size(F.array_distinct("windows"))
    sorted_windows = F.when(repeated, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = rows.withColumn("sorted", sorted_windows).drop("windows")
    s = F.col("sorted")
    twins = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    places = F.sort_array(F.transform(twins, lambda x: x["i"]))
    # Words under windows at sorted places: three for each, less the overlap with the one before.
    under = F.aggregate(
        places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
    )["n"]
    rows = rows.withColumn("n_repeat_words", F.coalesce(under, F.lit(0)).cast("long")).drop("sorted")
    share = lambda x, y: F.coalesce(F.col(x) / F.nullif(F.col(y), F.lit(0)), F.lit(0.0))
    return rows.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"), share("n_shouted", "word_chars").alias("shout_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Rows (stratum, rule, cutoff) of the rules in force; measured: stratum and rule shares, labels: doc_id, quality."""
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    held = measured.where(~base_failed()).join(marked, "doc_id")
    long = held.select("stratum", "good", F.explode(F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(r))])).alias("rule", "value"))
    # How many grid cutoffs a value exceeds: one small histogram a stratum and rule.
    over = sum(((F.col("value") > g).cast("int") for g in GRID), F.lit(0))
    histogram = long.groupBy("stratum", "rule", over.alias("over")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    by_rule = histogram.groupBy("stratum", "rule").agg(
        F.sum("good").alias("n"), F.sum("bad").alias("n_bad"), F.collect_list(F.struct("over", "good", "bad")).alias("counts")
    )  # at most a row a cutoff
    cutoffs = F.explode(F.array(*[F.struct(F.lit(k).alias("i"), F.lit(g).alias("cutoff")) for k, g in enumerate(GRID)])).alias("c")

    def rejected(kind: str) -> Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + F.when(x["over"] > F.col("c.i"), x[kind]).otherwise(0))

    tested = by_rule.where("n > 0").select("stratum", "rule", "n", "n_bad", "counts", cutoffs).select(
        "stratum", "rule", "n", "c.cutoff", rejected("good").alias("k"), rejected("bad").alias("k_bad"), F.greatest("n_bad", F.lit(1)).alias("n_bad")
    )
    strata = by_rule.where("n > 0").agg(F.count_distinct("stratum").alias("strata"))
    p_value = incomplete_beta_tail(F.col("n"), F.col("k"), risk / len(RULES))
    gain = F.col("k_bad") / F.col("n_bad") - COST * (F.col("k") / F.col("n"))
    safe = tested.crossJoin(F.broadcast(strata)).where(p_value <= error / (F.col("strata") * len(RULES))).withColumn("gain", gain)  # one row beside it
    return safe.where("gain > 0").groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff"))["cutoff"].alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, **cols: str) -> DataFrame:
    """Rows of ``measures`` with base_failed, kept and the rules that rejected."""
    measured = stage(measures(docs, **cols), "measures")
    cutoffs = thresholds(measured, labels, risk, error).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))  # a row a rule
    rejected = F.filter(F.array(*[F.when(F.col(r) > F.col("cutoffs")[r], F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    judged = measured.join(cutoffs, "stratum", "left").withColumn("rejected_by", rejected).drop("cutoffs")
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle(risk: float = RISK, error: float = ERROR) -> str:
    """``op5`` in DuckDB's SQL."""
    grid, p = ", ".join(map(repr, GRID)), repr(risk / len(RULES))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, stratum, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(text) - length(regexp_replace(text, '[A-Z]{{2,}}', '', 'g')) AS n_shouted, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars FROM t),
u AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS pos FROM w),
tri AS (SELECT doc_id, pos, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
rep AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT pos + o) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
f AS (SELECT doc_id, stratum, len(words) AS n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_symbols / nullif(word_chars, 0), 0e0) AS symbol_share, coalesce((len(lines) - len(list_distinct(lines))) / nullif(len(lines), 0), 0e0) AS dup_line_share,
  coalesce(coalesce(n_repeat_words, 0) / nullif(len(words), 0), 0e0) AS repeat_share, coalesce(n_shouted / nullif(word_chars, 0), 0e0) AS shout_share
  FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
m AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
g AS (SELECT stratum, good, rule, value FROM (SELECT b.*, good FROM b JOIN m USING (doc_id) WHERE NOT base_failed) UNPIVOT (value FOR rule IN ({", ".join(RULES)}))),
s AS (SELECT stratum, rule, cutoff, count(*) FILTER (good) AS n, greatest(count(*) FILTER (NOT good), 1) AS n_bad, count(*) FILTER (good AND value > cutoff) AS k,
  count(*) FILTER (NOT good AND value > cutoff) AS k_bad FROM g, (SELECT unnest([{grid}]::DOUBLE[]) AS cutoff) GROUP BY ALL),
safe AS (SELECT stratum, rule, max({{'gain': gain, 'cutoff': cutoff}}).cutoff AS cutoff FROM (SELECT *, k_bad / n_bad - {COST} * (k / n) AS gain FROM s WHERE n > 0) WHERE gain > 0
  AND CASE WHEN k >= n THEN 1e0 ELSE list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})) FOR i IN range(k + 1)]) END
    <= {error!r} / ((SELECT count(DISTINCT stratum) FROM g WHERE good) * {len(RULES)}) GROUP BY ALL),
hit AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, stratum, rule, value FROM b UNPIVOT (value FOR rule IN ({", ".join(RULES)}))) JOIN safe USING (stratum, rule) WHERE value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM hit) AS kept FROM b
"""
