"""The filter audit against every order applied one document at a time."""

import math
import re
from itertools import permutations

from pitfolio.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mask int, part string, state int, digest string, good int"
LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (3, LONG, None), (None, LONG, "b"), (None, "only here twice", "b"), (None, "only here twice", "b"), (4, None, "a"), (5, "", ""), (6, "", None), (7, " \t\n\x0b\x0c\r", "a"),
    (8, "x " * 80, "a"), (9, "AB# " * 80, "c"), (10, LONG + " $", "c"), (11, LONG.upper(), "c"), (12, "É" * 20 + " é è", "c"), (13, "w " * 200_000, "d"), (14, LONG.replace(" ", "\n"), "d"), (4, LONG + " $", "d"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, None), (3, None, 1), (9, 1, 1), (None, 1, 1), (10, None, None), (99, 1, 1)]


def brute(rows, labels):
    good, bad = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))

    def fails(i, t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        out = {c for c, bad in (("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)), ("D", re.search("[#$%&*|]", t))) if bad}
        earlier = any(j is not None and (i is None or j < i) and (u or "") == t for j, u, _ in rows)
        return out | {"E"} if earlier else out

    docs = [(s or "", fails(i, t or ""), i in good, i in bad) for i, t, s in rows]
    out = {}
    for part in {d[0] for d in docs}:
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            here, gone = [d for d in docs if d[0] == part], []
            for k, f in enumerate(order, 1):
                lost = [d for d in here if f in d[1]]
                here = [d for d in here if f not in d[1]]
                out[part, "".join(order), k] = [len(here), len(lost), sum(f in d[1] for d in gone), sum(d[1] == {f} and d[0] == part for d in docs), sum(d[2] for d in lost), sum(d[3] for d in lost)]
                gone += lost
                total[f] += len(lost)
        for order in permutations("ABCDE"):
            for k, f in enumerate(order, 1):
                out[part, "".join(order), k].append(total[f])
    return out


def test_every_order_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en", s, 1, 9, "x", 9, "x", 9) for i, t, s in ROWS], SCHEMA)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in filter_audit.audit(docs, labels).collect()}
    assert got == brute(ROWS, LABELS)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "en", "a", 1, 9, "x", 9, "x", 9)], SCHEMA)
    assert filter_audit.audit(one, labels).count() == 600


def test_path_counts_are_factorials():
    for n in range(1, 7):
        forward, backward = filter_audit.path_counts(n)
        assert forward == [math.factorial(s.bit_count()) for s in range(1 << n)]
        assert backward == [math.factorial(n - s.bit_count()) for s in range(1 << n)]


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "a a", "en", "s", 1, 0, "", 0, "", 0), (2, "b", "en", "s", 1, 0, "", 0, "", 0)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = filter_audit.audit(docs, labels, {"X": lambda text, words: text.contains("a")}, "Y").collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in out} == {("XY", 1): (1, 1, 2), ("XY", 2): (1, 0, 0), ("YX", 1): (2, 0, 0), ("YX", 2): (1, 1, 2)}
