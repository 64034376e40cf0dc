"""The linear program of packing beside a running Spark session: it ends, and gives one plan."""

import numpy as np

from pitfolio.llm import packing


def histogram(seed=2, pieces=30_000, width=2048):
    r = np.random.default_rng(seed)
    lengths = np.minimum(r.lognormal(5.6, 1.1, pieces).astype(int) + 1, width)
    return dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))


def test_plan_of_many_classes_is_tight_and_the_same_each_time(spark):
    spark.range(1000).repartition(8).count()
    h = histogram()
    tops, first = packing.plan(h)
    assert sum(np.searchsorted(tops, list(h)).tolist().count(c) > 0 for c in range(len(tops))) > 600
    assert packing.plan(h)[1] == first
    room = np.zeros(len(tops), np.int64)
    for many, items in first:
        assert sum(c * int(tops[j]) for j, c in items) <= 2048
        for j, c in items:
            room[j] += many * c
    need = np.bincount(np.searchsorted(tops, list(h)), list(h.values()), len(tops))
    assert (room >= need).all()
    least = sum(k * n for k, n in h.items()) / 2048
    assert sum(many for many, _ in first) <= 1.01 * least + 2


def test_inverse_by_rows_equals_numpy():
    r = np.random.default_rng(0)
    for m in (1, 2, 30):
        columns = [{j: int(c) for j, c in zip(r.permutation(m)[: min(m, 4)].tolist(), r.integers(1, 9, 4), strict=False)} | {k: 50} for k in range(m)]
        a = np.zeros((m, m))
        for k, p in enumerate(columns):
            a[list(p), k] = list(p.values())
        assert np.allclose(packing._inverse(columns, m) @ a, np.eye(m), atol=1e-9)
