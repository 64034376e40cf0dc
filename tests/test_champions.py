"""The champion's path as composed maps against a plain fold, decision by decision."""

import datetime as dt

import numpy as np
import pytest

from pitfolio.operators import boards

SCHEMA = "run string, decision_idx int, decision_date date, strategy string, eligible boolean, score double, rank int"


def board(run, seed, n=90, names="abcdef", sparse=0.1, gap=0.3):
    """A random board: strategies come and go, sometimes none is eligible, scores move slowly."""
    r = np.random.default_rng(seed)
    score, out = dict.fromkeys(names, 0.5), []
    for i in range(n):
        day = dt.date(2024, 1, 3) + dt.timedelta(days=i // 2 * 7 + i % 2 * 2)  # Wednesdays and Fridays
        score = {s: float(np.clip(v + r.normal(0, 0.08), 0, 1)) for s, v in score.items()}
        here = [s for s in names if r.random() > sparse]
        good = [] if r.random() < 0.08 else [s for s in here if r.random() > gap]
        order = sorted(good, key=lambda s: (-round(score[s], 6), s))
        out += [(run, i, day, s, s in good, round(score[s], 6) if s in good else None, order.index(s) + 1 if s in good else None) for s in here]
    return out


def fold(rows, baseline, first, weekday, margin):
    days = {}
    for _, i, day, s, ok, score, rank in rows:
        days.setdefault((i, day), []).append((s, ok, score, rank))
    held, out = None, []
    for (i, day), here in sorted(days.items()):
        scores = {s: v for s, ok, v, _ in here if ok}
        top = next((s for s, _, _, k in here if k == 1), None)
        lead = None if top is None or held not in scores else scores[top] - scores[held]
        if i < first:
            reason, now = "initialization_baseline", baseline
        elif day.isoweekday() % 7 + 1 != weekday:
            reason, now = "incumbent_held_until_selection_day", held or baseline
        elif top is None:
            reason, now = "no_eligible_candidate", baseline
        elif held not in scores:
            reason, now = "incumbent_ineligible", top
        elif held == top:
            reason, now = "incumbent_ranked_first", held
        elif lead >= margin:
            reason, now = "challenger_exceeded_margin", top
        else:
            reason, now = "challenger_below_margin", held
        out.append((i, day, now, top, reason, lead if reason.startswith("challenger") else None, bool(i >= first and held is not None and held != now)))
        held = now
    return out


@pytest.mark.parametrize(("block", "first", "baseline", "weekday"), [(4, 4, "a", 6), (2, 0, "a", 4), (256, 4, "not there", 6), (3, 0, "c", 6)])
def test_paths_equal_a_fold(spark, block, first, baseline, weekday):
    rows = [x for k in range(5) for x in board(f"r{k}", k, n=40 + 60 * (k % 2))] + board("short", 9, n=3) + board("none", 8, n=12, gap=1.0)
    got = boards.champion_path(spark.createDataFrame(rows, SCHEMA), baseline, first, weekday, 0.1, key="run", block=block).collect()
    for run in {x[0] for x in rows}:
        mine = sorted(tuple(r)[1:] for r in got if r.run == run)
        want = fold([x for x in rows if x[0] == run], baseline, first, weekday, 0.1)
        assert [x[:5] + x[6:] for x in mine] == [x[:5] + x[6:] for x in want], run
        assert [x[5] for x in mine] == [None if x[5] is None else pytest.approx(x[5]) for x in want]


def test_empty_board_and_one_run_without_a_key(spark):
    none = spark.createDataFrame([], SCHEMA).drop("run")
    assert boards.champion_path(none, "a").count() == 0
    rows = board("x", 3)
    got = sorted(map(tuple, boards.champion_path(spark.createDataFrame(rows, SCHEMA).drop("run"), "b", block=8).collect()))
    assert [x[:5] for x in got] == [x[:5] for x in fold(rows, "b", 4, 6, 0.1)] and len({x[2] for x in got}) > 2
