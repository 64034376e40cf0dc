"""The license scan against plain Python on awkward texts."""

import re
from collections import Counter, defaultdict

import numpy as np

from pitfolio.llm import license_scan as ls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words int, row long, spans int, label string"
MIT, APACHE, GPL3 = ls.NOTICES[2][1], ls.NOTICES[4][1], ls.NOTICES[10][1]


def changed(text, *edits):
    w = text.split()
    for at, new in edits:
        w[at] = new
    return " ".join(w)


TEXTS = [
    None, "", " ", "x", "one two", "Released under the MIT License.", "RELEASED UNDER THE MIT-LICENSE!", "under the mit license under the mit license", "under the mit; license", "under thémit license", "Apache License, Version 2.0 and cc-by-nc", "cc by nc " * 500,
    "before " * 30 + MIT + " after" * 30, changed(MIT, (20, "odd"), (60, "one two three")), changed(MIT, *[(i, "gone") for i in range(0, 90, 9)]), MIT[:300], MIT[300:], MIT + "\n" + MIT, APACHE, changed(APACHE, (5, "")), GPL3,
    GPL3.replace("version 3", "version 2").replace("software:", "software;"), "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "licensed under a Creative Commons Attribution 4.0 International License",
    "licensed under the artistic license version 2.0", "of the software " * 4000, "the above copyright notice and this permission notice shall be", "İ under the mit license K", "🙂 under the mit license", "a" * 50_000 + " under the mit license", "word " * 100_000 + "cc by nc",
]


def brute(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    spans = []
    for tid, label, phrase, t in ls.templates():
        n, votes = len(t), defaultdict(list)
        for j in range(n - 2):
            for i in at.get(tuple(t[j : j + 3]), ()):
                votes[i - j].append(i)
        run, runs = [], []
        for d in sorted(d for d, v in votes.items() if len(v) >= max(1, (n - 2) // 16)):
            if run and d - run[-1] > n // 8:
                runs.append(run)
                run = []
            run.append(d)
        for r in [*runs, run] if run else runs:
            hits = [i for d in r for i in votes[d]]
            if 4 * len(hits) >= n - 2:
                matched = sum(any(0 <= d + j < len(w) and w[d + j] == x for d in r) for j, x in enumerate(t))
                ok = matched == n if phrase else matched >= n - n // 16
                spans.append((min(hits), -(max(hits) + 2), -matched, n, label, tid, phrase, ok))
    kept, far = [], -1
    for s in sorted(x for x in spans if x[7] and not x[6]):
        if far < -s[1]:
            kept.append(s)
        far = max(far, -s[1])
    base = [s for s in spans if s[6] and s[7]]
    starts = [s[0] for s in base]
    labels = lambda xs: ",".join(sorted({s[4] for s in xs}))
    return len(w), len(base), min(starts, default=None), max(starts, default=None), labels(base), labels(base + kept), 1.0 if base else max((-s[2] / s[3] for s in spans), default=0.0)


def phrase_places(text):
    """The contract's definition of the base, without any template."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for label, p in ls.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def scan(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", None, 1, 7, 7, 7, "x") for i, t in rows], SCHEMA)
    return [tuple(r) for r in ls.labelled(docs).drop("spans").collect()]


def test_awkward_texts_equal_brute_force(spark):
    rows = [(None if k == 4 else k - k % 2, t) for k, t in enumerate(TEXTS)] + [(50, TEXTS[12])] * 2
    got = scan(spark, rows)
    assert Counter(got) == Counter((i, *brute(t)) for i, t in rows)
    assert Counter(g[:6] for g in got) == Counter((i, *phrase_places(t)) for i, t in rows)


def test_notices_are_found_and_kin_is_told_apart(spark):
    labels = dict(zip(range(len(TEXTS)), (r[6] for r in sorted(scan(spark, list(enumerate(TEXTS))))), strict=True))
    assert [labels[i] for i in (12, 13, 17, 18, 20, 21, 22, 23)] == ["mit", "mit", "mit", "apache-2", "gpl-3", "gpl-2", "cc-by-nc", "cc-by"]
    assert labels[14] == labels[24] == labels[25] == labels[26] == ""


def test_random_mixtures_equal_brute_force(spark):
    r = np.random.default_rng(5)
    pool = [t for _, t in ls.PHRASES + ls.NOTICES]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(r.integers(1, 5)):
            w = pool[r.integers(len(pool))].split()
            for _ in range(r.integers(0, 5)):
                i = int(r.integers(len(w)))
                w[i : i + int(r.integers(0, 2))] = ["other"] * int(r.integers(0, 3))
            parts.append(" ".join(w))
        rows.append((k, " ".join(parts)))
    assert sorted(scan(spark, rows)) == [(i, *brute(t)) for i, t in rows]


def test_empty_table(spark):
    assert scan(spark, []) == []
