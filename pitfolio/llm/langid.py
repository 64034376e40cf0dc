"""Language identification, word first: log frequencies of known words, else shorter n-grams.

Model, from documents with a text and a language outside the held-out fold: for each
language the counts of words, and of the character n-grams (5 down to 1, with word ends
marked) of its different words. Counting runs over a sample of about ``max_train``
documents of each language, picked by a hash of id and text, so no language is too rare to
be learned and the model does not grow with the corpus; every document is scored.

Score of a text: every word adds, for each language, the log of the word's smoothed
relative frequency there, if the model knows the word; otherwise the mean over the
word's n-grams of the longest length at which at least one is known. A softmax of the
sum over the square root of the number of words gives the score.

Only words with a letter count, in lower case, without what is not a letter at either
end. Nulls: a null text, or one without a letter, is ``und`` with score 0; a null
language is no training row. With nothing to learn from every text is ``und``.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialize, table

#: About so many training documents a language.
MAX_TRAIN = 600
_WORD = regex.compile(r"\p{L}+")
_LONGEST = 5
_CACHE = 300_000


def _grams(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def learn(docs: DataFrame, max_train: int = MAX_TRAIN):
    """(languages, word scores, [n-gram scores by length]): dicts to tuples of log frequencies."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).where(fold(F.col("doc_id"), 4) != 2)
    per = materialize(known.groupBy("lang").agg(F.count("*").alias("n")))  # one row a language
    place = (F.xxhash64("doc_id", "text", F.lit(5)) / F.lit(2.0**64)) + 0.5
    sample = known.select("doc_id", "lang", "text").join(per, "lang").where((place < max_train / F.col("n")) | (F.col("n") <= max_train))
    sample = sample.groupBy("doc_id", "lang", F.md5("text").alias("digest")).agg(F.any_value("text").alias("text"))  # repeated rows count once
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}++"), F.lit(0))).alias("w"))
    got = words.groupBy("lang", "w").agg(F.count("*").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    by = {lang: dict(zip(g["w"], g["n"], strict=True)) for lang, g in got.groupby("lang")}
    every = [by[lang] for lang in langs]

    def logs(tables: list[dict]) -> dict:
        keys = sorted({k for t in tables for k in t})
        total = [sum(t.values()) + len(keys) for t in tables]
        return {k: tuple(math.log((t.get(k, 0) + 0.5) / n) for t, n in zip(tables, total, strict=True)) for k in keys}

    grams = []
    for n in range(1, _LONGEST + 1):
        tables = []
        for t in every:
            c: Counter = Counter()
            for w, k in t.items():
                for g in _grams(w, n):
                    c[g] += min(k, 20)
            tables.append({g: k for g, k in c.items() if k > 2})
        grams.append(logs(tables))
    # a word seen once in one language says little more than its n-grams do
    return langs, logs([{w: k for w, k in t.items() if k > 1} for t in every]), grams


class _Scores(dict):
    """Word to its tuple of log frequencies; unseen words are worked out once and kept, within a bound."""

    def __init__(self, words: dict, grams: list[dict], n: int):
        super().__init__(words)
        self.grams, self.none, self.base = grams, (0.0,) * n, len(words)

    def __missing__(self, word: str):
        out = self.none
        for n in range(_LONGEST, 0, -1):
            hits = [self.grams[n - 1][g] for g in _grams(word, n) if g in self.grams[n - 1]]
            if hits:
                out = tuple(sum(x) / len(hits) for x in zip(*hits, strict=True))
                break
        if len(self) < self.base + _CACHE:
            self[word] = out
        return out


def predict(docs: DataFrame, model) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        langs, words, grams = shared.value
        scores = _Scores(words, grams, len(langs))
        for b in batches:
            pred, score = [], []
            for text in b.column("text").to_pylist():
                found = Counter(_WORD.findall(text.lower())) if text else None
                if not found or not langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                s = np.fromiter((x for w in found for x in scores[w]), float, len(found) * len(langs)).reshape(-1, len(langs))
                n = np.fromiter(found.values(), float, len(found))
                s = n @ s / math.sqrt(n.sum())
                p = np.exp(s - s.max())
                pred.append(langs[int(s.argmax())])
                score.append(float(p.max() / p.sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, learn(docs))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
