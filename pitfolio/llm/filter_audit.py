"""Audit of how filters interact, for every order in which they could be applied.

Each document gets the set of filters it fails (a bit mask), and documents are counted by
part and mask: at most 2**n rows a part, whatever the corpus. Everything else is read from
the lattice of filter subsets. Its states are the sets of filters already applied, its edges
apply one filter more.

*Forward-backward path counting.* ``forward`` of a state is the number of orders that reach
it from the empty set, ``backward`` the number that go on from it to the full set; both are
sums over edges, one level after the other. An edge is a step of forward(from) times
backward(to) orders, which is the weight of its removals in the Shapley value of its filter.
An order is a path, so its five steps are five edges: kept, removed and redundant counts of
all orders are rows of the one table of edges, joined, never counted again.

The lattice and the orders depend on the number of filters alone (five: 80 edges, 600 steps).

The duplicate filter compares a text with those of smaller doc_ids in the whole table. Rows
are grouped by the SHA-256 of the text, counted by part and labels before they are sent, so
copies of one text are few rows. Repeated rows (one id, one text) are no duplicates of each
other. A row without id counts as after every id, and fails if any row with an id has its
text. A null text is empty, a null source is part ''. Labels of one id count if any row of
them says so; rows without labels are neither good nor toxic. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import UPPER, table

_SALTS = 4096


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


#: Filters of a text by letter: what makes it fail. ``words`` is the array of the text's words.
FILTERS = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
    "C": lambda text, words: 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 5 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """(forward, backward) of the 2**n states: orders that reach a state, and that leave it for the full set."""
    forward, backward = [0] * (1 << n), [0] * (1 << n)
    forward[0] = backward[-1] = 1
    for state in range(1 << n):
        for f in range(n):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in reversed(range(1 << n)):
        for f in range(n):
            if not state >> f & 1:
                backward[state] += backward[state | 1 << f]
    return forward, backward


def masks(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS) -> DataFrame:
    """part, mask, docs, good, toxic: documents by part and set of failed filters.

    Bit i of the mask is the i-th of ``filters``, the next one the duplicate filter.
    """
    text, n = F.coalesce("text", F.lit("")), len(filters)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text")).withColumn("words", _words(F.col("text")))
    bits = [fails(F.col("text"), F.col("words")).cast("int") * (1 << i) for i, fails in enumerate(filters.values())]
    rows = rows.select("doc_id", "part", sum(bits[1:], bits[0]).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))

    # Ids that are null would all meet in one task: they are dealt by their text.
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("salt", F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("digest"), F.lit(_SALTS))).otherwise(0))
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(flag("quality"), flag("toxic")).withColumn("salt", F.lit(0).cast("long"))
    told = rows.join(known, ["id", "salt"], "left").na.fill(0, ["quality", "toxic"])

    # Copies of one text have one mask; only ids, parts and labels tell them apart.
    same = told.groupBy("id", "salt", "doc_id", "digest", "part", "quality", "toxic", "mask").agg(F.count("*").alias("c"))
    groups = same.groupBy("digest", "part", "quality", "toxic", "mask").agg(F.sum("c").alias("c"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c"))).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("first", first)
    stay = F.when(F.col("first").isNull(), F.col("c")).when(F.col("least.doc_id") == F.col("first"), F.col("least.c")).otherwise(F.lit(0))
    both = F.array(F.struct(F.col("mask").alias("mask"), stay.alias("docs")), F.struct((F.col("mask") + (1 << n)).alias("mask"), (F.col("c") - stay).alias("docs")))
    split = groups.select("part", "quality", "toxic", F.inline(both)).where("docs > 0")
    return split.groupBy("part", "mask").agg(F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("quality")).alias("good"), F.sum(F.col("docs") * F.col("toxic")).alias("toxic"))


def edges(counts: DataFrame, n: int) -> DataFrame:
    """part, state, filter (bit), kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row an edge.

    counts: rows of ``masks``. The table that says on which edges a mask counts has
    2**n * n * 2**(n - 1) rows, so it is broadcast.
    """
    forward, backward = path_counts(n)
    cells = [
        (mask, state, f, forward[state] * backward[state | 1 << f], int(not mask & (state | 1 << f)), int(bool(mask >> f & 1 and not mask & state)), int(bool(mask >> f & 1 and mask & state)), int(mask == 1 << f))
        for mask in range(1 << n) for state in range(1 << n) for f in range(n) if not state >> f & 1
    ]
    on = counts.sparkSession.createDataFrame(cells, "mask int, state int, filter int, weight long, stays long, goes long, late long, only long")
    per = counts.join(F.broadcast(on), "mask").groupBy("part", "state", "filter").agg(
        F.max("weight").alias("weight"), *[F.sum(F.col(a) * F.col(b)).alias(c) for a, b, c in (("stays", "docs", "kept"), ("goes", "docs", "removed"), ("late", "docs", "redundant"), ("only", "docs", "unique_fails"), ("goes", "good", "good_lost"), ("goes", "toxic", "toxic_lost"))],
    )
    return per.withColumn("shapley", F.sum(F.col("weight") * F.col("removed")).over(Window.partitionBy("part", "filter"))).drop("weight")


def audit(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, duplicates: str = "E") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row a part, order of the filters and step. filters: letter to a function of (text,
    words) that is true where a text fails; ``duplicates`` is the letter of the duplicate
    filter, which comes last in the mask.
    """
    letters = [*filters, duplicates]
    if len(letters) > 7:
        raise ValueError("the orders of more than seven filters are too many to list")
    steps = [("".join(letters[f] for f in order), k + 1, sum(1 << f for f in order[:k]), f) for order in permutations(range(len(letters))) for k, f in enumerate(order)]
    orders = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    found = edges(masks(docs, labels, filters), len(letters))
    return found.join(F.broadcast(orders), ["state", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every order applied step by step.
SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
lab AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
  concat(CASE WHEN len(ws) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' END, CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fails FROM w LEFT JOIN lab USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
perm AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS o FROM one a, one b, one c, one d, one e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o AS filter_order, CAST(k AS INT) AS step, o[k] AS x, o[1:k - 1] AS before FROM perm, range(1, 6) r(k)),
c AS (SELECT part, filter_order, step, x, n, good, bad, contains(fails, x) AS hit, fails = x AS sole, len(translate(fails, before, '')) < len(fails) AS gone FROM s, g),
t AS (SELECT part, filter_order, step, x, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN sole THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN bad ELSE 0 END) AS toxic_lost FROM c GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM t"""
