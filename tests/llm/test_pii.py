"""Base spans and revealing terms against plain Python."""

import hashlib
import math
import re

import numpy as np
import pytest

from pitfolio.llm import pii


def luhn(d):
    n = [int(x) for x in reversed(d)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(n)) % 10 == 0


def base(t):
    t = t or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


CARD = "4465758382889437"
ODD = [
    f"card {CARD} or 4465-7583 8288 9437, not 4465758382889438", f"+1 (743) 555-3824 {CARD}", f"a.{CARD}@b.cd {CARD}1", "10.0.0.1", "0.0.0.0 000.1.2.3 1.2.3.00 256.1.1.1",
    "1.2.3.4.5.6.7.8 0.0.0.0256", f"+{CARD[:12]} 0000 0000 0000 0000", "é😀 a@b.cd 😀 10.1.1.1", "+12.3.4.5 555-555 1.2.3.4", "0 " * 3_000, "", None, "12-34 56-78 90-12 34-52",
]


def test_base_spans_equal_re(spark):
    r = np.random.default_rng(3)
    signs = list("0123456789012345678 -.+@ab()")
    texts = ODD + ["".join(r.choice(signs, int(r.integers(5, 60)))) for _ in range(1500)]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", pii.base_spans(pii.F.col("text")).alias("s")).collect()
    found = set()
    for x in got:
        want = base(texts[x.i])
        assert [(s.start, s.rank, s.end) for s in x.s] == want, texts[x.i]
        found |= {k for _, k, _ in want}
    assert found == {0, 1, 2, 3}


def brute_terms(texts, reach, disclose, support):
    words = lambda t: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", t or "")]
    n, near = {}, {}
    for t in texts:
        for _, _, w in words(t):
            n[w] = n.get(w, 0) + 1
        for s, k, e in base(t):
            value = re.sub("[^0-9]", "", t[s:e]) if k in (2, 3) else t[s:e].lower()
            left = {m[0] for m in re.finditer(r"[^\W\d_]+", t[:s].lower()) if m.start() >= s - reach}
            right = {m[0] for m in re.finditer(r"[^\W\d_]+", t[e:].lower()) if m.end() <= reach}
            for w in left | right:
                for x in (k, (k, value)):
                    near[x, w] = near.get((x, w), 0) + 1
    total, all_ = sum(n.values()), {}
    for (x, _), c in near.items():
        all_[x] = all_.get(x, 0) + c
    bad = set()
    for (x, w), c in near.items():
        ic = -math.log2(min(all_[x] / total, 1))
        if c >= support and ic > 0 and ic + math.log2(min(c / n[w], 1)) >= disclose * ic:
            bad.add(w)
    spans = []
    for t in texts:
        own = base(t)
        spans.append(sorted(own + [(s, 4, e) for s, e, w in words(t) if w in bad and not any(a < e and s < b for a, _, b in own)]))
    return bad, spans


def test_revealing_terms_equal_brute_force(spark):
    r = np.random.default_rng(1)
    filler = [f"{a}{b}" for a in "bcdfg" for b in ("aro", "elu", "imp")]
    talk = lambda n: " ".join(r.choice(filler, n))
    texts = [f"{talk(20)} Zorbax writes zed@mail.com {talk(15)}" for _ in range(12)]
    texts += [f"{talk(15)}, zorbax! {talk(10)}", None, "", f"{talk(3)} other@mail.com zorbax@mail.com"] + [talk(60) for _ in range(80)]
    texts += [f"{talk(6)} quux 10.0.0.1 {talk(2)} verylongwordthatthewindowcutsinthemiddle{talk(1)}" for _ in range(6)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], None)], "doc_id long, text string, spans string")
    bad, spans = brute_terms([*texts, texts[0]], 40, 0.95, 5)
    assert {"zorbax", "quux"} <= bad and not bad & set(filler)
    got = pii.annotate(docs).collect()
    assert len(got) == len(texts) + 1
    for x in got:
        assert [(s.start, s.rank, s.end) for s in x.spans] == (spans[-1] if x.doc_id is None else spans[x.doc_id])
    clean = {x.doc_id: x for x in pii.sanitise(docs).collect()}
    assert clean[12].text.count("[TERM]") == 1 and "zorbax" not in clean[12].text
    assert "[EMAIL]" in clean[0].text and clean[13].text is None and clean[14].text == "" and clean[20].text == texts[20]
    assert clean[0].spans == "x"


def test_contexts_find_spans_once(spark):
    docs = spark.createDataFrame([("at zed@mail.com or 10.0.0.1",)], "text string").where("text is not null")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    once = plan(docs.select(pii.base_spans(pii.F.col("text")).alias("spans"))).count("array_sort(")
    assert plan(pii.contexts(docs)).count("array_sort(") == once == 1


def test_query_digest(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    names = pii.KINDS
    for x in pii.op6_pii(spark, str(tmp_path)).collect():
        want = base(ODD[x.doc_id])
        line = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in want)
        assert x.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and x.spans == line
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(k == j for _, k, _ in want) for j in range(4))


@pytest.mark.parametrize("reach", [5, 41])
def test_words_cut_by_the_window_do_not_count(spark, reach):
    text = "abc defgh ij a@b.cd klm nopqrs tu"
    s = text.index("a@b")
    e = s + 6
    want = {m[0] for m in re.finditer("[a-z]+", text) if (m.end() <= s and m.start() >= s - reach) or (m.start() >= e and m.end() <= e + reach)}
    got = pii.contexts(spark.createDataFrame([(text,)], "text string"), reach).collect()
    assert {r.term for r in got} == want and {r.protected for r in got} == {"email", "email:a@b.cd"}
