"""Toxicity: cumulative-link ordinal regression over sparse word features.

Grades: 0 for documents labelled not toxic; 1 to 3 for toxic ones, by how many different
words of the toxic lexicon they hold. The lexicon is the words whose presence goes with
the toxic label by smoothed log-odds on the training sample.

Features: presence of words and of word beginnings (six bytes, for inflected forms), those
most associated with the label either way (log-odds at least three standard errors from
0), at most ``max_words``, as a 0/1 vector. Toxic and other rows weigh the same in the loss. Model: P(grade > j) =
sigmoid(w.x - b_j) with one weight vector for all thresholds b_1 <= b_2 <= b_3, fit by
gradient descent with an L2 penalty. Expected severity is the sum of the three
probabilities; a document is toxic if P(grade > 0) is at least one half.

The sample is bounded (``max_train`` labelled rows, by a hash of the id); every document
is scored, over its whole text, by word hashes in numpy. Nulls and empty texts have no
features and get the base rate. Repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .quality import training_sample
from .textwords import arrow_bytes, slices, word_hashes

MAX_TRAIN = 20_000
MAX_WORDS = 2_000
GRADES = 3


def bare_words(text):
    """Letters and digits only count, so that "word," and "word" are one feature."""
    return F.translate(F.coalesce(text, F.lit("")), ".,;:!?\"()&%$#*|", " " * 15)


def _features(column):
    """(hash, doc) of all words and of the beginnings of longer words."""
    h, d, p = word_hashes(*arrow_bytes(column), head=6)
    return np.concatenate([h, p[p != 0]]).view(np.int64), np.concatenate([d, d[p != 0]])


def _presence(docs: DataFrame) -> DataFrame:
    """(doc_id, label, words) with the distinct word hashes of each document of the sample."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            h, d = _features(b.column("text"))
            order = np.argsort(d, kind="stable")
            ends = np.cumsum(np.bincount(d, minlength=b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([np.unique(x) for x in np.split(h[order], ends[:-1])], pa.list_(pa.int64()))], names=["doc_id", "label", "words"])

    return docs.select("doc_id", "label", bare_words(F.col("text")).alias("text")).mapInArrow(run, "doc_id long, label double, words array<long>")


def learn(sample: DataFrame, max_words: int = MAX_WORDS):
    """(word hashes in order, their weights, thresholds)."""
    rows = materialize(_presence(sample))  # read three times below; the text only once
    size = rows.groupBy("label").count().collect()
    n1 = sum(r["count"] for r in size if r["label"] == 1)
    n0 = sum(r["count"] for r in size if r["label"] == 0)
    if not n0 or not n1:
        return np.zeros(0, np.int64), np.zeros(0), np.full(GRADES, 3.0 if not n1 else -3.0)
    df = rows.select("label", F.explode("words").alias("w")).groupBy("w").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).where("a + b >= 5")
    odds = F.log((F.col("a") + 0.5) / (n1 - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n0 - F.col("b") + 0.5))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    top = df.select("w", z.alias("z"), odds.alias("odds")).where(F.abs("z") >= 3).orderBy(F.abs("z").desc(), "w").limit(max_words).toPandas().sort_values("w")
    vocab = top["w"].to_numpy(np.int64)
    lexicon = (top["z"] > 6).to_numpy() & (top["odds"] > 2).to_numpy()
    kept = F.array(*[F.lit(int(v)) for v in vocab]) if len(vocab) else F.array().cast("array<bigint>")
    got = rows.select("label", F.array_intersect("words", kept).alias("words")).toPandas()
    idx = [np.searchsorted(vocab, np.sort(np.asarray(w, np.int64))) for w in got["words"]]
    y = got["label"].to_numpy()
    order = sorted(range(len(y)), key=lambda i: (y[i], len(idx[i]), idx[i].tolist()))
    x = np.zeros((len(y), len(vocab)), np.float32)
    for r, i in enumerate(order):
        x[r, idx[i]] = 1
    y = y[order]
    grade = np.where(y > 0, np.clip(x @ lexicon.astype(np.float32), 1, GRADES), 0).astype(int)
    above = (grade[:, None] > np.arange(GRADES)[None, :]).astype(np.float32)
    w = np.zeros(len(vocab), np.float32)
    share = np.where(y > 0, 0.5 / n1, 0.5 / n0).astype(np.float32)[:, None]  # both classes weigh the same
    rate = np.clip((above * share).sum(axis=0), 1e-3, 1 - 1e-3)
    b = np.log((1 - rate) / rate).astype(np.float32)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for step in range(1, 501):
        s = x @ w
        d = (1 / (1 + np.exp(-(s[:, None] - b[None, :]))) - above) * share
        gw, gb = x.T @ d.sum(axis=1) + 1e-6 * w, -d.sum(axis=0)
        for p, g, m, v in ((w, gw, mw, vw), (b, gb, mb, vb)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b = np.maximum.accumulate(b)
    return vocab, w, b


def severity(docs: DataFrame, model) -> DataFrame:
    """One row per row of docs: doc_id, severity, grade, p_toxic, toxic."""
    vocab, w, b = model
    shared = docs.sparkSession.sparkContext.broadcast((vocab, w.astype(np.float64), b.astype(np.float64)))

    def run(batches):
        import pyarrow as pa

        words, weights, cuts = shared.value
        maybe = np.zeros(1 << 16, bool)
        maybe[words & 0xFFFF] = True
        for part in slices(batches):
            h, d = _features(part.column("text"))
            hit = maybe[h & 0xFFFF]
            h, d = h[hit], d[hit]
            s = np.zeros(part.num_rows)
            if len(words) and len(h):
                at_ = np.minimum(np.searchsorted(words, h), len(words) - 1)
                ok = words[at_] == h
                pair = np.unique(d[ok] * len(words) + at_[ok])
                s = np.bincount(pair // len(words), weights[pair % len(words)], part.num_rows)
            p = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts[None, :], -50, 50)))
            each = np.hstack([1 - p[:, :1], p[:, :-1] - p[:, 1:], p[:, -1:]])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0]), pa.array((p[:, 0] >= 0.5).astype(np.int32))], names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), bare_words(F.col("text")).alias("text")).mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity(docs, learn(training_sample(docs, table(spark, sf_dir, "labels"), "toxic", 5, 0, MAX_TRAIN)))
