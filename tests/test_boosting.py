"""Walk-forward boosting against trees grown by plain loops."""

import datetime as dt

import numpy as np
import pytest

from pitfolio.operators import models


def plain(x, y, asked, depth, rounds, rate, bins, ridge):
    """Boosted trees by trying every cut of every node, row by row."""
    edges = [sorted(set(np.quantile(x[:, f], [k / bins for k in range(1, bins)]).tolist())) for f in range(x.shape[1])]
    code = lambda row: [sum(e < v for e in edges[f]) for f, v in enumerate(row)]
    codes, wanted = [code(r) for r in x], [code(r) for r in asked]
    base = float(np.mean(y))
    left, out = [v - base for v in y], [base] * len(asked)

    def grow(rows, ask, d):
        s = sum(left[i] for i in rows)
        worth = lambda t, n: t * t / (n + ridge)
        best = None
        for f in range(x.shape[1]) if d < depth else ():
            for c in range(bins):
                a = [i for i in rows if codes[i][f] <= c]
                if 0 < len(a) < len(rows):
                    t = sum(left[i] for i in a)
                    g = worth(t, len(a)) + worth(s - t, len(rows) - len(a)) - worth(s, len(rows))
                    if g > 1e-12 and (best is None or g > best[0] + 1e-9):
                        best = (g, f, c)
        if best is None:
            v = rate * s / (len(rows) + ridge)
            for j in ask:
                out[j] += v
            return {i: v for i in rows}
        _, f, c = best
        low = grow([i for i in rows if codes[i][f] <= c], [j for j in ask if wanted[j][f] <= c], d + 1)
        return low | grow([i for i in rows if codes[i][f] > c], [j for j in ask if wanted[j][f] > c], d + 1)

    for _ in range(rounds):
        for i, v in grow(list(range(len(y))), list(range(len(asked))), 0).items():
            left[i] -= v
    return out


def test_trees_equal_plain_loops():
    r = np.random.default_rng(3)
    x, ask = r.normal(size=(70, 3)), r.normal(size=(30, 3))
    x[:, 2] = np.round(x[:, 2])  # a feature with ties
    y = np.where(x[:, 0] > 0.2, 2.0, -1.0) + x[:, 2] + r.normal(0, 0.1, 70)
    model = models.BoostedTrees(depth=2, rounds=6, rate=0.3, bins=8, ridge=1.0).fit(x, y)
    assert model.predict(ask) == pytest.approx(plain(x, y, ask, 2, 6, 0.3, 8, 1.0), abs=1e-9)
    flat = models.BoostedTrees(rounds=3).fit(np.ones((5, 2)), np.full(5, 4.0))
    assert flat.predict(np.zeros((2, 2))).tolist() == [4.0, 4.0]


def test_each_decision_uses_the_last_refit_and_no_later_row(spark):
    r = np.random.default_rng(9)
    at = [dt.date(2024, 1, 3) + dt.timedelta(7 * i) for i in range(40)]
    rows = [(i, f"t{t}", float(a := r.normal()), float(b := r.normal()), float(2 * (a > 0) - b) if i < 38 and (i + t) % 11 else None) for i in range(40) for t in range(4)]
    df = spark.createDataFrame(rows, "decision_idx int, ticker string, a double, b double, label double")
    sched = spark.createDataFrame([(i, at[i], at[i + 1] + dt.timedelta(1) if i < 39 else None) for i in range(40)], "decision_idx int, decision_date date, next_fill date")
    w = models.training_windows(sched, 1, 140)
    params = {"depth": 2, "rounds": 5, "rate": 0.3, "bins": 8}
    got = {(x.decision_idx, x.ticker): (x.refit_idx, x.predicted) for x in models.gbt_walkforward(df, w, ["a", "b"], min_rows=30, every=7, **params).collect()}
    spans = {x.refit_idx: (x.lo, x.hi) for x in w.collect()}
    of = lambda i: [x for x in rows if spans[i][0] <= x[0] <= spans[i][1] and x[4] is not None]
    first = min(i for i in range(40) if len(of(i)) >= 30)
    refits = [i for i in range(first, 40, 7) if len(of(i)) >= 30]
    assert set(got) == {(i, f"t{t}") for i in range(first, 40) for t in range(4)}
    for i in refits:
        ask = [x for x in rows if i <= x[0] < min([j for j in refits if j > i], default=99)]
        want = plain(np.array([x[2:4] for x in of(i)]), np.array([x[4] for x in of(i)]), np.array([x[2:4] for x in ask]), 2, 5, 0.3, 8, 1.0)
        for x, v in zip(ask, want, strict=True):
            assert got[x[0], x[1]][0] == i and got[x[0], x[1]][1] == pytest.approx(v, abs=1e-9)
    with pytest.raises(Exception, match="more than 20"):
        models.gbt_walkforward(df, w, ["a", "b"], min_rows=30, every=7, most_rows=20, **params).collect()
