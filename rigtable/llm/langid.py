"""Language identification of mixed text: script ranges, scores a word, Viterbi over the words.

Learned from labelled training documents: how often each language uses each script, and the log probability of
each character with its two neighbours (white space at word borders), hashed into ``BUCKETS``.  A word's script,
that of most of its letters, leaves the languages that use it; its score for these is the sum over its letters.
A Viterbi pass over a document's words, with a penalty for every switch, labels spans; the document's language
is the one with most letters, its score that share of the letters.

The model is fitted on about ``FIT_ROWS`` labelled documents, taken by a hash of their id (all, if there are no
more); its size is languages x buckets.  Prediction covers all documents and whole texts.

Null text or text without letters: ``und``, score 0.  Without labelled documents all are ``und``.  Words without
letters carry no score and join the span around them.  A script that no language uses leaves all of them.  Ties
go to the language that sorts first.  Null ids are never in training of the held-out kind: they hash as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rigtable.llm.common import crc_mod
from rigtable.llm.words import Words, slices, words_of

#: First code points of script ranges, with the script that begins there.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB10, "other"), (0xFF21, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x33480, "other"),
)
STARTS = np.array([a for a, _ in SCRIPTS])
NAMES = sorted({name for _, name in SCRIPTS})
SCRIPT_OF_RANGE = np.array([NAMES.index(name) for _, name in SCRIPTS])

BUCKETS = 1 << 16
FIT_ROWS = 20_000
#: Bytes of text that are counted together.
FIT_SLICE = 2 << 20
SMOOTHING = 0.5
#: Log-score a switch of language costs, and the share of a language's letters that makes a script its own.
SWITCH, SCRIPT_SHARE = 12.0, 0.001
UNKNOWN = "und"


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # bucket x language
    prior: np.ndarray
    uses: np.ndarray  # script x language


_ALPHA: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter or a mark that belongs to one."""
    if not _ALPHA:
        import unicodedata

        _ALPHA.append(np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)]))
    return _ALPHA[0]


class Features(NamedTuple):
    """Of distinct words: the word, bucket and script of every letter."""

    word: np.ndarray
    bucket: np.ndarray
    script: np.ndarray


def features(values: pa.Array) -> Features:
    text = "\n" + "\n".join(pc.utf8_lower(values).to_pylist()) + "\n"
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    alpha = letters()[codes]
    word = np.cumsum(codes == 10) - 1
    shown = np.where(alpha, codes, 32)
    at = np.flatnonzero(alpha)
    with np.errstate(over="ignore"):
        key = (shown[at - 1].astype(np.uint64) * np.uint64(0x110000) + shown[at].astype(np.uint64)) * np.uint64(0x110000) + shown[at + 1].astype(np.uint64)
        bucket = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64) % BUCKETS
    return Features(word[at], bucket, SCRIPT_OF_RANGE[np.searchsorted(STARTS, codes[at], side="right") - 1])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, feature, n) of texts with labels; features: buckets, the scripts as -1, -2, ..., and ``BUCKETS`` for documents."""
    for batch in batches:
        for part in slices(batch, batch.column("text"), FIT_SLICE):
            tags = part.column("lang").dictionary_encode()
            tag, words = tags.indices.to_numpy(), words_of(part.column("text"))
            if not len(words.values):
                continue
            own = features(words.values)
            for k, lang in enumerate(tags.dictionary.to_pylist()):
                n = np.bincount(words.codes[np.repeat(tag == k, words.lengths())], minlength=len(words.values))[own.word]
                buckets, scripts = np.bincount(own.bucket, n, BUCKETS), np.bincount(own.script, n, len(NAMES))
                held, seen = np.flatnonzero(buckets), np.flatnonzero(scripts)
                feature = np.concatenate([held, -1 - seen])
                amount = np.concatenate([buckets[held], scripts[seen]]).astype(np.int64)
                documents = pa.array(np.append(feature, BUCKETS)), pa.array(np.append(amount, int((tag == k).sum())))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(documents[0])), *documents], ["lang", "feature", "n"])


def fit(rows: DataFrame, bound: int = FIT_ROWS) -> Model:
    """rows: doc_id, text, lang of training documents."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    share = min(1.0, bound / max(rows.count(), 1))
    part = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("fit")), 11).cast("double") / float(1 << 53) < share
    sample = rows.where(part).select("text", "lang")

    totals = sample.mapInArrow(counted, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    found = totals.toArrow()  # languages x (buckets + scripts) rows at most
    langs = sorted(set(found.column("lang").to_pylist()))
    at = {lang: k for k, lang in enumerate(langs)}
    counts, uses, docs = np.zeros((BUCKETS, len(langs))), np.zeros((len(NAMES), len(langs))), np.zeros(len(langs))
    for lang in langs:
        mine = found.filter(pc.equal(found.column("lang"), lang))
        feature, n = mine.column("feature").to_numpy(), mine.column("n").to_numpy()
        grams = (feature >= 0) & (feature < BUCKETS)
        counts[feature[grams], at[lang]] = n[grams]
        uses[-1 - feature[feature < 0], at[lang]] = n[feature < 0]
        docs[at[lang]] = n[feature == BUCKETS].sum()
    weights = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS))
    prior = np.log((docs + 1) / (docs.sum() + len(langs))) if langs else np.zeros(0)
    return Model(langs, weights, prior, uses >= SCRIPT_SHARE * np.maximum(uses.sum(axis=0), 1))


def word_scores(values: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(score of each distinct word in each language, its number of letters)."""
    n, k = len(values), len(model.langs)
    own = features(values)
    size = np.bincount(own.word, minlength=n)
    scores = np.stack([np.bincount(own.word, model.weights[own.bucket, lang], n) for lang in range(k)], axis=1)
    by_script = np.bincount(own.word * len(NAMES) + own.script, minlength=n * len(NAMES)).reshape(n, -1)
    allowed = model.uses[by_script.argmax(axis=1)]
    allowed[~allowed.any(axis=1)] = True
    worst = scores.min(axis=1, keepdims=True) - 2 * SWITCH
    scores = np.where(allowed, scores, worst)
    return np.where(size[:, None] > 0, scores - scores.max(axis=1, keepdims=True), 0.0), size


def viterbi(words: Words, scores: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of every word on the best path of its text; all texts advance together, longest first."""
    n, k = len(words.offsets) - 1, len(prior)
    length = words.lengths()
    order = np.argsort(-length, kind="stable")
    start, length = words.offsets[:-1][order], length[order]
    steps = int(length[0]) if n else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # texts longer than each step
    best = np.tile(prior, (n, 1))
    stays = np.ones((len(words.codes), k), bool)
    came = np.zeros(len(words.codes), np.int8 if k < 128 else np.int32)
    for t in range(steps):
        m = active[t]
        at, now = start[:m] + t, best[:m]
        if t:
            top = now.max(axis=1)
            came[at] = now.argmax(axis=1)
            floor = (top - switch)[:, None]
            stays[at] = now >= floor
            np.maximum(now, floor, out=now)
        now += scores[words.codes[at]]
    out = np.zeros(len(words.codes), np.int64)
    state = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        at = start[: active[t]] + t
        out[at] = state[: active[t]]
        if t:
            held = state[: active[t]]
            state[: active[t]] = np.where(stays[at, held], held, came[at])
    return out


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


class Labels(NamedTuple):
    """Of some texts: index of each text's language (that after the last: unknown), its share of the letters, and the spans."""

    pred: np.ndarray
    score: np.ndarray
    text: np.ndarray  # of each span: its text, first word, number of words and language
    start: np.ndarray
    size: np.ndarray
    lang: np.ndarray


def labels_of(texts: pa.Array, model: Model) -> Labels:
    words = words_of(texts)
    n, k = len(words.offsets) - 1, len(model.langs)
    none = np.zeros(0, np.int64)
    if not k or not len(words.codes):
        return Labels(np.full(n, k), np.zeros(n), none, none, none, none)
    scores, size = word_scores(words.values, model)
    lang = viterbi(words, scores, model.prior)
    text_of = np.repeat(np.arange(n), words.lengths())
    by_lang = np.bincount(text_of * k + lang, size[words.codes], n * k).reshape(n, -1)
    total = by_lang.sum(axis=1)
    cut = np.flatnonzero((np.diff(lang, prepend=-1) != 0) | (np.diff(text_of, prepend=-1) != 0))
    length = np.diff(np.append(cut, len(lang)))
    told = total[text_of[cut]] > 0
    cut, length = cut[told], length[told]
    pred = np.where(total > 0, by_lang.argmax(axis=1), k)
    return Labels(pred, by_lang.max(axis=1) / np.maximum(total, 1), text_of[cut], cut - words.offsets[text_of[cut]], length, lang[cut])


def label_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score, spans): spans of words with one language, in order."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        langs = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            for part in slices(batch, batch.column("text")):
                found = labels_of(part.column("text"), model)
                ends = np.searchsorted(found.text, np.arange(part.num_rows + 1))
                told = pa.StructArray.from_arrays([pa.array(found.start), pa.array(found.size), pa.array(langs[found.lang], pa.string())], ["start", "n_words", "lang"])
                spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), told)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(langs[found.pred], pa.string()), pa.array(found.score), spans], ["doc_id", "lang_pred", "score", "spans"]
                )

    schema = "doc_id long, lang_pred string, score double, spans array<struct<start:long,n_words:long,lang:string>>"
    return _source(docs, id_col, text_col).mapInArrow(label, schema)


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows (row, lang_pred, score): every row of the table whole, beside its verdict; nothing is shuffled or joined."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        langs = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            for part in slices(batch, pc.struct_field(batch.column("row"), text_col)):
                found = labels_of(pc.struct_field(part.column("row"), text_col), model)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(langs[found.pred], pa.string()), pa.array(found.score)], ["row", "lang_pred", "score"])

    return docs.select(F.struct("*").alias("row")).mapInArrow(label, T.StructType().add("row", docs.schema).add("lang_pred", "string").add("score", "double"))


def held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 4) == 2


def op6(docs: DataFrame) -> DataFrame:
    """Learn from documents that are not held out, label all."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return label_spans(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
