"""Quality rules, language scores and severity grades against plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
import regex

from pitfolio.llm import langid, quality, toxicity
from pitfolio.llm.common import fold

SYLLABLES = {"aa": "ka lo mi nu".split(), "bb": "pe ro su ti".split(), "cc": "ža čo ši đu".split()}


def speak(lang, seed, n=30):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang], int(r.integers(1, 4)))) for _ in range(n))


def test_compiled_rules_equal_the_rules_in_numpy(spark):
    kinds = [lambda i: speak("aa", i, 40), lambda i: speak("aa", i, 6), lambda i: speak("bb", i, 40).upper(), lambda i: speak("bb", i, 6).upper()]  # good: long and not shouted
    data = [(i, kinds[i % 4](i)) for i in range(400)] + [(400, None), (401, ""), (402, "x" * 10_000)]
    rows = quality.with_statistics(spark.createDataFrame(data, "doc_id long, text string")).withColumn("label", (quality.F.col("doc_id") % 4 == 0).cast("double"))
    base, rules = quality.learn_rules(rows.where("doc_id < 400"))
    assert rules and any(len(rule) > 1 for _, rule in rules)
    got = rows.select("doc_id", *[f"s_{n}" for n in quality.NAMES], quality.compile_rules(base, rules).alias("score")).toPandas()
    x = got[[f"s_{n}" for n in quality.NAMES]].to_numpy()
    for row, score in zip(x, got["score"], strict=True):
        z = base
        for w, rule in rules:
            if all((row[f] < c) if side == "<" else (row[f] >= c) for f, side, c in rule):
                z += w
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)
    y = (got["doc_id"] % 4).to_numpy()[:400]
    assert ((got["score"][:400] > 0.5) == (y == 0)).mean() > 0.97


def test_lasso_drops_rules_that_say_nothing():
    r = np.random.default_rng(0)
    z = r.integers(0, 2, (600, 6)).astype(float)
    y = (r.random(600) < 1 / (1 + np.exp(3 - 6 * z[:, 0]))).astype(float)
    _, w = quality.lasso_logistic(z, y, penalty=0.02)
    assert w[0] > 1 and np.abs(w[1:]).max() < 0.05 and (w[1:] == 0).sum() >= 3


def test_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, "a")] * 50 + [(2, "b"), (2, "a"), (3, None), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(2, 0)], "doc_id long, quality int")
    got = sorted((r.doc_id, r.text, r.label) for r in quality.training_sample(docs, labels, "quality", 1000, 999, 3).collect())
    ids = sorted(i for i, *_ in got)
    assert len(ids) == len(set(ids)) <= 3
    whole = {r.doc_id: r for r in quality.training_sample(docs, labels, "quality", 1000, 999, 100).collect()}
    assert whole[1].text == "a" and whole[3].text is None and whole[2].text in ("a", "b")


def plain_scores(rows, text):
    """Language scores by the definition, from (lang, text) training rows."""
    words = {lang: Counter() for lang in sorted({la for la, _ in rows})}
    for lang, t in rows:
        words[lang].update(regex.findall(r"\p{L}+", t.lower()))

    def logs(tables):
        keys = {k for t in tables for k in t}
        return keys, [{k: math.log((t.get(k, 0) + 0.5) / (sum(t.values()) + len(keys))) for k in keys} for t in tables]

    seen, by_word = logs([{w: n for w, n in c.items() if n > 1} for c in words.values()])
    grams = {}
    for n in range(1, 6):
        tables = []
        for c in words.values():
            g = Counter()
            for w, k in c.items():
                for i in range(len(w) + 3 - n):
                    g[f"<{w}>"[i : i + n]] += min(k, 20)
            tables.append({x: k for x, k in g.items() if k > 2})
        grams[n] = logs(tables)
    found = regex.findall(r"\p{L}+", text.lower())
    total = [0.0] * len(words)
    for w in found:
        if w in seen:
            add = [t[w] for t in by_word]
        else:
            add = [0.0] * len(words)
            for n in range(5, 0, -1):
                keys, logs_ = grams[n]
                hits = [g for g in (f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)) if g in keys]
                if hits:
                    add = [sum(t[g] for g in hits) / len(hits) for t in logs_]
                    break
        total = [a + b / math.sqrt(len(found)) for a, b in zip(total, add, strict=True)]
    top = max(total)
    return list(words)[total.index(top)], 1 / sum(math.exp(x - top) for x in total)


def test_language_scores_equal_the_definition(spark):
    train = [(i, speak(lang, 10 * i + j), lang) for i in range(30) for j, lang in enumerate(SYLLABLES)]
    train = [(10 * i + j, t, la) for i, (_, t, la) in enumerate(train) for j in (0,)] + [(5_000, None, "aa"), (5_001, "x y", None)]
    asked = [(9_000 + i, speak(lang, 700 + i, 12) + " zzzz qa") for i, lang in enumerate(list(SYLLABLES) * 3)] + [(9_100, None), (9_101, "12 !? 9"), (9_102, ""), (None, "KALO lomi")]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    known = [(r.lang, r.text) for r in df.where(fold(langid.F.col("doc_id"), 4) != 2).collect() if r.text and r.lang]
    got = langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), langid.learn(df)).collect()
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), asked, strict=True):
        assert r.doc_id == i
        if t and regex.search(r"\p{L}", t):
            lang, score = plain_scores(known, t)
            assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-9)
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_rare_languages_are_learned(spark):
    rows = [(i, speak("aa", i), "aa") for i in range(3000)] + [(5000 + i, speak("cc", i), "cc") for i in range(12)] + [(9000, "same words here", "bb")] * 500
    langs, words, _ = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_train=50)
    assert {"aa", "cc"} <= set(langs) and any(w in words for w in regex.findall(r"\p{L}+", speak("cc", 3)))


def test_severity_thresholds(spark):
    r = np.random.default_rng(5)
    bad, good = [f"vile{x}" for x in "abcdefgh"], [f"word{x}" for x in "abcdefghijkl"]
    data = []
    for i in range(900):
        k = 0 if i % 3 else int(r.integers(1, 6))
        said = r.choice(bad, k if k else int(r.random() < 0.15), replace=False)  # a word alone may be harmless
        data.append((i, " ".join([*said, *r.choice(good, 12)]), 1.0 if k else 0.0))
    sample = spark.createDataFrame(data, "doc_id long, text string, label double")
    words, w, cuts = toxicity.learn(sample)
    assert len(cuts) == toxicity.GRADES and (np.diff(cuts) > 0).all()
    asked = [(k, " ".join(bad[:k] + good[:6])) for k in range(7)] + [(90, None), (91, "")]
    got = {x.doc_id: x for x in toxicity.severity(spark.createDataFrame(asked, "doc_id long, text string"), (words, w, cuts)).collect()}
    inner = [x for x in got.values() if 1e-9 < x.p_toxic < 1 - 1e-9]
    assert len(inner) >= 3
    for x in inner:  # probabilities of exceeding, by one weight vector and ordered thresholds
        logit = math.log(x.p_toxic / (1 - x.p_toxic)) + cuts[0]
        want = sum(1 / (1 + math.exp(-(logit - c))) for c in cuts)
        assert x.severity == pytest.approx(want, rel=1e-4) and 0 <= x.severity <= toxicity.GRADES
    assert [got[k].severity for k in range(7)] == sorted(got[k].severity for k in range(7))
    assert got[0].toxic == 0 and got[3].toxic == 1 and got[90].severity == got[91].severity
    assert got[1].severity < 2 < got[6].severity and got[1].grade < got[6].grade == 3
