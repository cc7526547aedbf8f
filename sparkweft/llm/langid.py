"""Language of texts and of the spans of mixed ones.

Letters belong to scripts by ranges of code points, and a script narrows the candidates to the languages that are written in
it. Each word gets a score per candidate from letter trigrams, and a Viterbi pass over the words, in which changing the
language costs a penalty, labels spans. The model is a table of trigram counts learned from labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.columns import column, others

TRAIN_DOCS = 2000  # labelled rows per language that are learned from, about; chosen by a hash
SWITCH_PENALTY = 12.0
SLICE_LETTERS = 4_000_000  # code points labelled together
UNKNOWN = "und"
_BUCKETS = 1 << 18
_CODES = 0x110000
_LEAST_SHARE = 0.01  # of a language's letters that have to be of a script it is a candidate for

# Ranges of code points by script.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F))),
)
_OTHER = len(SCRIPTS) + 1  # letters of no range above


class Letters(NamedTuple):
    script: np.ndarray  # by code point, 0 where it is no letter
    lower: np.ndarray


class Model(NamedTuple):
    letters: Letters
    languages: list[str]
    scores: np.ndarray  # (trigram bucket, language), log probability
    candidates: np.ndarray  # (script, language), bool


def letter_tables() -> Letters:
    lower = np.arange(_CODES, dtype=np.uint32)
    script = np.zeros(_CODES, dtype=np.uint8)
    for code in range(_CODES):
        char = chr(code)
        if char.isalpha():
            script[code] = _OTHER
            small = char.lower()
            if len(small) == 1:
                lower[code] = ord(small)
    for number, (_, ranges) in enumerate(SCRIPTS, 1):
        for first, last in ranges:
            part = script[first : last + 1]
            part[part > 0] = number
    return Letters(script, lower)


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of the texts, a zero before each and after the last."""
    joined = "\0" + "\0".join(texts) + "\0"
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _grams(codes: np.ndarray, letters: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the letters, the bucket of the trigram around each, and the script of each code point."""
    script = letters.script[codes]
    small = np.where(script > 0, letters.lower[codes], 0).astype(np.uint32)
    places = np.flatnonzero(script)
    mixed = small[places - 1] * np.uint32(0x9E3779B1) + small[places] * np.uint32(0x85EBCA77)
    mixed += small[places + 1] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    return places, (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(14), script


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Broadcast | None:
    """Model learned from rows with a text and a language, None if no such row has a letter.

    About ``TRAIN_DOCS`` rows of each language are read, chosen by a hash of key and text. The model has one count per
    language and trigram bucket, so its size does not depend on the rows. Null texts and languages are left out.
    """
    spark = labelled.sparkSession
    rows = labelled.select(column(text).alias("text"), column(lang).cast("string").alias("lang"), column(key).alias("key"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    rates = [(name, min(1.0, TRAIN_DOCS / n)) for name, n in counts.items()]
    if not rates:
        return None
    held = spark.sparkContext.broadcast(letter_tables())
    draw = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.join(F.broadcast(spark.createDataFrame(rates, "lang string, rate double")), "lang").where(draw < F.col("rate"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, part in batch.groupby("lang"):
                places, buckets, script = _grams(_codes(part["text"].tolist()), held.value)
                both = np.concatenate([buckets, _BUCKETS + script[places].astype(np.uint32)])
                found = grams.setdefault(name, np.zeros(_BUCKETS + _OTHER + 1, dtype=np.int64))
                found += np.bincount(both, minlength=len(found))
        for name, found in grams.items():
            at = np.flatnonzero(found)
            yield pd.DataFrame({"lang": name, "gram": at, "n": found[at]})

    sums = chosen.select("lang", "text").mapInPandas(count, "lang string, gram int, n long")
    table = sums.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if table.empty:
        return None
    languages = sorted(table["lang"].unique())
    full = np.zeros((_BUCKETS + _OTHER + 1, len(languages)))
    full[table["gram"].to_numpy(), table["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy()] = table["n"]
    seen, scripts = full[:_BUCKETS], full[_BUCKETS:]
    distinct = np.count_nonzero(seen.any(axis=1))
    scores = np.log((seen + 0.5) / (seen.sum(axis=0) + 0.5 * distinct + 1))
    candidates = scripts >= _LEAST_SHARE * scripts.sum(axis=0)
    model = Model(held.value, languages, scores.astype(np.float32), candidates)
    return spark.sparkContext.broadcast(model)


def _viterbi(scores: np.ndarray, starts: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; texts are walked in step, longest first."""
    labels = np.zeros(len(scores), dtype=np.int64)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    if not len(order):
        return labels
    first, length = starts[order], counts[order]
    steps = int(length[0])
    active = len(length) - np.searchsorted(length[::-1], np.arange(steps), side="right")
    stays = np.ones(scores.shape, dtype=bool)
    origin = np.zeros(len(scores), dtype=np.int64)
    value = scores[first].astype(np.float64)
    for t in range(1, steps):
        k = active[t]
        at, here = first[:k] + t, value[:k]
        best = here.argmax(axis=1)
        here -= here[np.arange(k), best][:, None]
        stay = here >= -penalty
        stays[at], origin[at] = stay, best
        np.maximum(here, -penalty, out=here)
        here += scores[at]
    now = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        labels[at] = now[:k]
        now[:k] = np.where(stays[at, now[:k]], now[:k], origin[at])
    return labels


def label_texts(texts: list[str | None], model: Model) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, score and labelled spans (first and last code point, exclusive) of each text."""
    places, buckets, script = _grams(_codes([t or "" for t in texts]), model.letters)
    lengths = np.array([len(t or "") for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) + 1  # place of each text's first code point
    nothing = (UNKNOWN, 0.0, [])
    if not len(places):
        return [nothing] * len(texts)
    opens = np.concatenate([[True], np.diff(places) > 1])  # a word is a run of letters of one script
    opens[1:] |= script[places[1:]] != script[places[:-1]]
    word_at = np.flatnonzero(opens)
    word_ends = np.concatenate([word_at[1:], [len(places)]])
    scores = np.add.reduceat(model.scores[buckets], word_at, axis=0)
    allowed = model.candidates[script[places[word_at]]]
    scores = np.where(allowed | ~allowed.any(axis=1, keepdims=True), scores, scores.min(axis=1, keepdims=True) - 20)
    text_of = np.searchsorted(begins, places[word_at], side="right") - 1
    counts = np.bincount(text_of, minlength=len(texts))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    labels = _viterbi(scores, starts, counts, SWITCH_PENALTY)
    size = len(model.languages)
    letters = np.bincount(text_of * size + labels, weights=word_ends - word_at, minlength=len(texts) * size)
    letters = letters.reshape(len(texts), size)
    best, total = letters.argmax(axis=1), letters.sum(axis=1)
    turns = np.concatenate([[True], (np.diff(labels) != 0) | (np.diff(text_of) != 0)])
    heads = np.flatnonzero(turns)
    tails = np.concatenate([heads[1:], [len(labels)]]) - 1
    spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for number, a, b, label in zip(
        text_of[heads], places[word_at[heads]], places[word_ends[tails] - 1], labels[heads], strict=True
    ):
        spans[number].append((int(a - begins[number]), int(b - begins[number]) + 1, model.languages[label]))
    return [
        (model.languages[best[i]], float(letters[i, best[i]] / total[i]), spans[i]) if total[i] else nothing
        for i in range(len(texts))
    ]


_RESULT = "struct<lang:string,score:double,spans:array<struct<first:int,last:int,lang:string>>>"


def predicted(text: Column, model: Broadcast | None) -> Column:
    """Struct of ``lang``, ``score`` and ``spans`` of a text column."""

    @F.arrow_udf(_RESULT)
    def label(texts: pa.Array) -> pa.Array:
        rows, part, letters = [], [], 0
        for value in texts:
            part.append(value.as_py())
            letters += len(part[-1] or "")
            if letters >= SLICE_LETTERS:
                rows += label_texts(part, model.value)
                part, letters = [], 0
        if part:
            rows += label_texts(part, model.value)
        span = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())])
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])
        keys = ("first", "last", "lang")
        return pa.array(
            [{"lang": a, "score": b, "spans": [dict(zip(keys, s, strict=True)) for s in c]} for a, b, c in rows], kind
        )

    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.array().cast("array<struct<first:int,last:int,lang:string>>").alias("spans"))
    return label.asNondeterministic()(text)


def identify(df: DataFrame, model: Broadcast | None, text: str = "text") -> DataFrame:
    """Every row with ``lang_pred``, ``score`` (share of the letters that lie in spans of that language) and ``spans``.

    A null text and one without letters are ``und`` with score 0 and no span, as is every text when nothing could be learned.
    Letters of scripts that no learned language uses are scored by all of them. Ties go to the language that sorts first.
    Texts are labelled whole, very long ones as well. Columns with the names of the results are replaced.
    """
    names = others(df, "lang_pred", "score", "spans")
    found = df.select(*[column(c) for c in names], predicted(column(text), model).alias("__found"))
    fields = {"lang_pred": "lang", "score": "score", "spans": "spans"}
    return found.select(*[column(c) for c in names], *[F.col("__found")[f].alias(n) for n, f in fields.items()])
