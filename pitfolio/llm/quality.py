"""Quality classifier: a sparse ensemble of rules read from trees, as Spark columns.

1. ``statistics`` are DataFrame expressions over the whole text: lengths, shares of
   character classes, repetition of words and lines. Nothing else enters a score.
2. On a bounded sample of labelled documents (``max_train`` rows, chosen by a hash of the
   id among those with crc32(id) % 5 <> 0) gradient-boosted trees of depth 3 are grown.
3. Every path of every tree is a conjunctive rule. A lasso-penalised logistic regression
   over the rules leaves few with a weight.
4. The rules that are left are compiled into one column expression; scoring is a
   projection, with no join and no Python.

Nulls: a null text counts as empty; empty texts get the score of the rules they meet. A
table without labelled rows scores the prior 0.5. Repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, fold, table

#: Bound on the labelled rows that the rules are learned from.
MAX_TRAIN = 12_000
THRESHOLD = 0.3
_SYMBOLS = "!#$%&*@^~=+<>|{}[]\\/_"


def _drop(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs plus one double column s_<name> for each statistic of its text."""
    t = F.coalesce("text", F.lit(""))
    d = docs.withColumn("_n", F.length(t).cast("double")).withColumn("_w", F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != "")).withColumn("_l", F.split(t, "\n"))
    n, words, lines = F.greatest("_n", F.lit(1.0)), F.greatest(F.size("_w"), F.lit(1)), F.greatest(F.size("_l"), F.lit(1))
    part = lambda chars: (F.col("_n") - F.length(_drop(t, chars))) / n
    stats = {
        "chars": F.log1p("_n"),
        "words": F.log1p(F.size("_w").cast("double")),
        "word_length": F.col("_n") / words,
        "distinct_words": F.size(F.array_distinct("_w")) / words,
        "distinct_lines": F.size(F.array_distinct("_l")) / lines,
        "line_length": F.log1p(F.col("_n") / lines),
        "upper": part(UPPER),
        "lower": part(LOWER),
        "digits": part("0123456789"),
        "symbols": part(_SYMBOLS),
        "bangs": part("!"),
        "bars": part("|"),
        "stops": part(".,;:"),
        "blanks": part(" \t\n"),
    }
    return d.select(*docs.columns, *[v.cast("double").alias(f"s_{k}") for k, v in stats.items()])


NAMES = ("chars", "words", "word_length", "distinct_words", "distinct_lines", "line_length", "upper", "lower", "digits", "symbols", "bangs", "bars", "stops", "blanks")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, left_out: int, most: int) -> DataFrame:
    """Labelled documents outside the held-out fold: at most ``most`` rows, ids taken by a hash.

    The ids are at most ``most`` rows of two numbers, so they are broadcast and no text of
    other rows is shuffled. An id that several rows have is one row of the sample, with the
    text of the least digest.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(fold(F.col("doc_id"), modulus) != left_out).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    picked = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(11)), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")).alias("d"))
    return one.select("doc_id", "d.text", "label")


def _tree(x, g, h, cuts, depth, path, rules, lam=1.0, least=15):
    """One regression tree on gradients; appends (path, value) of its leaves to rules."""
    best = None
    if depth:
        total_g, total_h = g.sum(), h.sum()
        base = total_g**2 / (total_h + lam)
        for f, c in enumerate(cuts):
            if len(c):
                b = np.searchsorted(c, x[:, f], "right")
                sg, sh, sn = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g, h, np.ones(len(g))))
                gain = sg**2 / (sh + lam) + (total_g - sg) ** 2 / (total_h - sh + lam) - base
                gain[(sn < least) | (len(g) - sn < least)] = -1
                k = int(gain.argmax())
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], f, c[k])
    if best is None:
        rules.append((path, -g.sum() / (h.sum() + lam)))
        return
    _, f, c = best
    low = x[:, f] < c
    _tree(x[low], g[low], h[low], cuts, depth - 1, [*path, (f, "<", c)], rules, lam, least)
    _tree(x[~low], g[~low], h[~low], cuts, depth - 1, [*path, (f, ">=", c)], rules, lam, least)


def _holds(rule, x):
    out = np.ones(len(x), bool)
    for f, side, c in rule:
        out &= (x[:, f] < c) if side == "<" else (x[:, f] >= c)
    return out


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, rate: float = 0.3) -> list:
    """Distinct root-to-leaf paths of boosted trees."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(x.shape[1])]
    margin, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        leaves: list = []
        _tree(x, p - y, np.maximum(p * (1 - p), 1e-6), cuts, depth, [], leaves)
        for path, value in leaves:
            margin[_holds(path, x)] += rate * value
            if path:
                rules[tuple((f, s, float(c)) for f, s, c in path)] = None
    return list(rules)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = 2e-4, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; the intercept is not penalised."""
    n, m = z.shape
    a = np.hstack([np.ones((n, 1)), z])
    norm = np.linalg.norm(a, 2) ** 2 / (4 * n)
    w = v = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        new = v - (a.T @ (p - y)) / n / norm
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - penalty / norm, 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / u * (new - w), new, u
    return float(w[0]), w[1:]


def learn_rules(sample: DataFrame, names=NAMES) -> tuple[float, list]:
    """(intercept, [(weight, rule)]) from rows of statistics s_<name> and label."""
    got = sample.select(*[f"s_{n}" for n in names], "label").toPandas()
    y = got["label"].to_numpy(float)
    if len(y) < 20 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return float(np.log(p / (1 - p))), []
    x = got.drop(columns="label").to_numpy(float)
    order = np.lexsort([*x.T, y])  # the rows' order must not matter
    x, y = x[order], y[order]
    rules = grow_rules(x, y)
    z = np.stack([_holds(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    base, w = lasso_logistic(z, y)
    return base, [(float(v), r) for v, r in zip(w, rules, strict=True) if abs(v) > 1e-6]


def compile_rules(base: float, weighted: list, names=NAMES) -> Column:
    """The score as one column over the statistics."""
    terms = [F.lit(base)]
    for w, rule in weighted:
        test = None
        for f, side, c in rule:
            s = F.col(f"s_{names[f]}")
            one = s < F.lit(c) if side == "<" else s >= F.lit(c)
            test = one if test is None else test & one
        terms.append(F.when(test, F.lit(w)).otherwise(F.lit(0.0)))
    while len(terms) > 1:  # a balanced sum, so that the expression stays shallow
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return 1 / (1 + F.exp(-terms[0]))


def quality_scores(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, max_train: int = MAX_TRAIN) -> DataFrame:
    """docs' columns and score (instead of a column of that name). The model learns from ``train_docs`` (docs itself if not given)."""
    sample = with_statistics(training_sample(docs if train_docs is None else train_docs, labels, "quality", 5, 0, max_train))
    base, rules = learn_rules(sample)
    rows = with_statistics(docs.select(F.struct(*docs.columns).alias("doc"), "text")).select("doc", compile_rules(base, rules).alias("_score"))
    return rows.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c != "score"], F.col("_score").alias("score"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
