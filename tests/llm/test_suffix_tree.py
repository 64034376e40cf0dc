"""Suffix-tree scores against the definition in plain Python."""

import math
from collections import Counter

import numpy as np
import pytest

from pitfolio.llm import suffix_tree_lm as lm

WORDS = [f"w{x}" for x in range(30)]


def words(t):
    return [*(t or "").lower().split(), ""]  # the empty string stands for the end


def talk(seed, n=40):
    """Words that hang on the two before, and now and then a set phrase."""
    r = np.random.default_rng(seed)
    out = ["w1", "w2"]
    while len(out) < n:
        k = (7 * int(out[-1][1:]) + 3 * int(out[-2][1:])) % 30
        out.append(WORDS[k] if r.random() < 0.6 else WORDS[int(r.integers(0, 30))])
        if r.random() < 0.05:
            out += ["w5", "w6", "w7", "w8"]
    return " ".join(out[:n])


class Brute:
    def __init__(self, texts, depth, least, discount=0.75):
        docs = [words(t) for t in texts]
        self.depth, self.n = depth, Counter()
        for m in range(1, depth + 2):
            for d in docs:
                self.n.update(tuple(d[i : i + m]) for i in range(len(d) - m + 1))
        ones = {g: c for g, c in self.n.items() if len(g) == 1}
        self.total, self.kinds = sum(ones.values()), len(ones)
        self.mass, self.left = {}, {}
        for m in range(2, depth + 2):
            for ctx in {g[:-1] for g in self.n if len(g) == m}:
                listed = {g[-1]: c for g, c in self.n.items() if len(g) == m and g[:-1] == ctx and c >= least}
                if not listed:
                    continue
                low = {s: self.p(ctx[1:], s) for s in listed}
                q = {s: c / self.n[ctx] for s, c in listed.items()}
                rest, rest_low = max(1 - sum(q.values()), 1e-12), max(1 - sum(low.values()), 1e-12)
                gain = sum(q[s] * math.log2(q[s] / low[s]) for s in listed) + rest * math.log2(rest / rest_low)
                if self.n[ctx] * gain > 0.5 * math.log2(max(self.total, 2)) * len(listed):
                    for s, c in listed.items():
                        self.mass[*ctx, s] = (c - discount) / self.n[ctx]
                    self.left[ctx] = 1 - sum((c - discount) / self.n[ctx] for c in listed.values())

    def p(self, ctx, s):
        if not ctx:
            return (self.n[s,] + 1) / (self.total + self.kinds + 1)
        low = self.p(ctx[1:], s)
        return self.mass.get((*ctx, s), 0) + self.left[ctx] * low if ctx in self.left else low

    def score(self, t):
        d = words(t)
        return sum(math.log10(self.p(tuple(d[max(0, i - self.depth) : i]), s)) for i, s in enumerate(d))


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_scores_equal_the_definition(spark, depth):
    train = [talk(i) for i in range(60)] + [None, "", "W1 w2"]
    asked = [*train[:3], *(talk(500 + i) for i in range(4)), "unseen words w5 w6 w7 w8", None, "", "w5 " * 50]
    brute = Brute(train, depth, 4)
    df = spark.createDataFrame(list(enumerate(train)), "doc_id long, text string")
    model = lm.grow(df, depth=depth, least=4)
    ask = spark.createDataFrame([(i % 5 if i else None, t) for i, t in enumerate(asked)], "doc_id long, text string")  # ids repeat
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    for p_top, block_bytes in ((1e-2, 200), (1.0, 1 << 20)):  # a flush for every part of a block: keys are asked for again
        got = lm.scores(ask.repartition(1), model, p_top=p_top, block_bytes=block_bytes, flush=1).collect()
        want = []
        for i, t in enumerate(asked):
            w = words(t)
            base = sum(math.log10((brute.n[s,] + 1) / (brute.total + brute.kinds + 1)) for s in w)
            want.append((i % 5 if i else None, len(w), sum(brute.n[s,] > 0 for s in w), brute.total, round(base, 8), brute.score(t)))
        for r, w in zip(sorted(((*r[:4], round(r[4], 8), r[5]) for r in got), key=repr), sorted(want, key=repr), strict=True):
            assert r[:5] == w[:5] and r[5] == pytest.approx(w[5], rel=1e-6)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(brute.left) > 5 and {len(c) for c in brute.left} == set(range(1, depth + 1))


def test_distributions_sum_to_one():
    brute = Brute([talk(i) for i in range(60)], 2, 4)
    for ctx in [*list(brute.left)[:20], ("nowhere",)]:
        assert sum(brute.p(ctx, s) for (s,) in [g for g in brute.n if len(g) == 1]) + brute.p(ctx, "never seen") == pytest.approx(1)


def test_the_tree_grows_with_the_corpus(spark):
    size = []
    for n in (40, 160):
        r = np.random.default_rng(n)
        phrases = [" ".join(r.choice(WORDS, 3)) + f" name{i}" for i in range(n)]
        texts = [" ".join(r.choice(phrases, 8)) for _ in range(3 * n)]
        rows = lm.grow(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).rows
        size.append(rows.where("left is not null").count())
    assert size[1] > 2 * size[0]


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = lm.grow(none)
    (r,) = lm.scores(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert lm.scores(none, model).count() == 0


def test_keys_cross_in_parts_not_one_by_one():
    r = np.random.default_rng(3)
    k = np.unique(np.append(r.integers(0, 1 << 64, 5000, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)))
    n = r.integers(1, 100, len(k)).astype(np.int32)
    for bits in (1, 4):
        sent = lm._cut(bits, k, n=n)
        assert sent.num_rows == 1 << bits and sent.column("part").to_pylist() == list(range(1 << bits))
        assert (lm._whole(sent.column("k"), np.uint64) == k).all() and (lm._whole(sent.column("n"), np.int32) == n).all()
    both, total = lm._added(np.concatenate([k, k[:10]]), np.concatenate([n, n[:10]]))
    assert (both == k).all() and (total[:10] == 2 * n[:10]).all() and (total[10:] == n[10:]).all()
    assert lm._cut(4, k[:0], n=n[:0]).num_rows == 0 and len(lm._added(k[:0], n[:0])[0]) == 0


def test_blocks_are_scored_in_shares(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"one two three w{i % 7} " * (1 + i % 5)) for i in range(40)], "doc_id long, text string")
    model, written = lm.grow(docs), []
    monkeypatch.setattr(lm, "materialize", lambda df, f=lm.materialize: written.append(f(df)) or written[-1])
    got = lm.scores(docs, model, block_bytes=200).collect()
    rows = [t.count() for t in written if "score" in t.columns]
    assert len(rows) == 4 and sum(rows) == 40 and max(rows) < 40
    assert sorted(got) == sorted(lm.scores(docs, model, block_bytes=200, most_shares=1).collect())
