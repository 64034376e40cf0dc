"""Each stage of the pipeline against plain Python on awkward rows, and the whole on a small table."""

import re


import numpy as np
import pytest

import corpus_pipeline
from pitfolio.llm import mixing, packing, quality

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ro") for b in ("ban", "der", "fil", "gos")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed, n=60):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def changed(t, at, word="other"):
    w = t.split()
    w[at] = word
    return " ".join(w)


ROWS = [
    (7, text(1), "en", "a", 1), (3, changed(text(1), 0), "en", "b", 1), (9, changed(text(1), 59), None, None, None), (3, text(2), "en", "b", 1), (3, text(2), "en", "b", 1),
    (None, text(1), "en", "a", 2), (None, text(3), "fr", None, None), (None, text(3), "de", None, None), (5, "", "en", "a", 0), (5, "", "en", "a", 0), (6, None, None, "c", None), (8, " \n", "en", "a", 2),
    (11, "one two", "en", "c", 7), (12, "one two", "en", "c", 7), (13, text(4, 4000), "en", "a", 1), (14, changed(text(4, 4000), 2000), "en", "a", 1), (15, text(5), "en", "a", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=repr)


def sets(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_keep_one_equals_brute_force(spark, docs):
    s = [sets(r[1]) for r in ROWS]
    up = list(range(len(ROWS)))
    for a in range(len(ROWS)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = up[a], up[b]
                up = [min(x, y) if z in (x, y) else z for z in up]
    got = rows(corpus_pipeline.keep_one(spark, docs, ""))
    want = [r for r, x in zip(ROWS, s, strict=True) if not x]
    for g in {u for u, x in zip(up, s, strict=True) if x}:
        own = [r for r, u in zip(ROWS, up, strict=True) if u == g]
        least = min((r[0] is None, r[0] or 0) for r in own)
        mine = [r for r in got if r in own]
        assert len(mine) == 1 and (mine[0][0] is None, mine[0][0] or 0) == least
        want.append(mine[0])
    assert got == sorted(want, key=repr)
    assert (None, text(3), "de", None, None) in got and (3, text(2), "en", "b", 1) in got and (3, changed(text(1), 0), "en", "b", 1) in got


def test_keep_good_keeps_what_the_scores_keep(spark, tmp_path):
    r = np.random.default_rng(2)
    data = [(i, text(i, 40) if i % 3 else "!!! $$ |||| " * int(r.integers(5, 30)), "en", "a", 1) for i in range(300)] + [(None, None, None, None, None), (5, "", "x", "y", 0)]
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(data, SCHEMA)
    got = rows(corpus_pipeline.keep_good(spark, docs, str(tmp_path)))
    scores = quality.quality_scores(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).where(quality.F.col("score") >= quality.THRESHOLD)
    assert got == rows(scores)
    assert all(x in got for x in data[:300] if x[0] % 3) and not any(x in got for x in data[:300] if x[0] % 3 == 0)


def test_keep_good_works_each_statistic_out_once(spark, tmp_path):
    data = [(i, text(i, 40) if i % 3 else "!!! $$ |||| " * (5 + i % 25), "en", "a", 1) for i in range(300)]
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    scored = quality.quality_scores(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert plan(corpus_pipeline.keep_good(spark, docs, str(tmp_path))).count("translate(") == plan(scored).count("translate(") > 0


def test_hide_personal_equals_redaction(spark, docs):
    extra = spark.createDataFrame([(90, "mail me at joe@mail.com or +1 (743) 555-3824 ok", "en", "a", 1)], SCHEMA)
    got = rows(corpus_pipeline.hide_personal(spark, docs.unionByName(extra), ""))
    want = [(i, t, la, s, None if t is None else len(t)) for i, t, la, s, _ in ROWS] + [(90, "mail me at [EMAIL] or [PHONE] ok", "en", "a", len("mail me at [EMAIL] or [PHONE] ok"))]
    assert got == sorted(want, key=repr)


def test_mix_repeats_rows_as_the_operator_says(spark, docs):
    got = rows(corpus_pipeline.mix(spark, docs, ""))
    copies = sorted(((x.doc_id, x.source, x.size, x.copies) for x in mixing.mixed(docs).collect()), key=repr)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for key in {(i, s, n) for i, s, n, _ in copies}:
        assert sum(c for i, s, n, c in copies if (i, s, n) == key) == sum((g[0], g[3], size(g[1])) == key for g in got)
    assert all(g in ROWS for g in got) and got == rows(corpus_pipeline.mix(spark, docs, ""))


def test_pack_covers_all_tokens(spark, docs):
    out = corpus_pipeline.pack(spark, docs, "").collect()
    want = {}
    for r in ROWS:
        n = len(packing.token_bytes(r[1]) if r[1] else b"") // 4 + 1
        want[r[0]] = want.get(r[0], 0) + n
    have = {}
    for p in out:
        have[p.doc_id] = have.get(p.doc_id, 0) + p.length
    assert have == want


def test_run_is_its_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"] and d.count() > 0
    out = corpus_pipeline.run(spark, sf).collect()
    assert {p.doc_id for p in out} == {r.doc_id for r in d.select("doc_id").distinct().collect()}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), "/root/testdata/sf0.001").count() == 0


def test_stages_take_columns_of_maps(spark):
    more = spark.createDataFrame([(*r, {"k": i % 2, "j": 1}) for i, r in enumerate(ROWS)], SCHEMA + ", extra map<string,int>")
    kept = corpus_pipeline.keep_one(spark, more, "")
    assert kept.columns == more.columns and rows(kept) == rows(corpus_pipeline.keep_one(spark, more.drop("extra"), ""))
    assert corpus_pipeline.mix(spark, more, "").columns == more.columns
    assert rows(corpus_pipeline.mix(spark, more, "")) == rows(corpus_pipeline.mix(spark, more.drop("extra"), ""))
