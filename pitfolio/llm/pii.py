"""Personal data by patterns, and terms that reveal it by corpus co-occurrence.

*Base spans.* Emails, IPv4 addresses, card numbers (12 to 19 digits, Luhn) and phone
numbers (9 to 15 digits), leftmost and non-overlapping for each kind; a match that fails
its test is dropped and not retried. Positions are code points, ends exclusive.

*Revealing terms.* Protected are the entities found (a kind and its normalised value, such
as one address) and the kinds themselves. The letters-only words that lie whole within
``reach`` code points of a base span are its context. With counts over the whole corpus a
term t and a protected x have the pointwise mutual information PMI = log2(p(t | context of
x) / p(t)); what t tells about x at most, if it is found nowhere else, is the information
content IC(x) = -log2 p(context of x). A term with PMI of at least ``disclose`` times IC(x),
seen in at least ``support`` contexts of x, gives x away. All its occurrences, in whatever
document, become spans of kind ``term``, but for those inside a base span. ``redact``
replaces base spans by their kind in brackets and generalises revealing terms to ``[TERM]``.

Terms meet documents by a join on the term; documents with revealing terms get them by a
digest of the text, so copies share one row. No text is shuffled unless the table of
documents with terms is too large for Spark to broadcast.

All of it is DataFrame functions. Patterns are possessive and anchored where that leaves
the matches unchanged, so a long run of word characters or digits costs linear time.
Nulls: a null text has no spans. Empty texts neither. Repeated rows keep one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table

#: Kinds in the order that breaks ties of start; "term" is the method's own, last.
KINDS = ("email", "ip", "card", "phone", "term")
# Where a match would start inside a run, it would have started at the run's begin or where the last match ended (\G).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP_OK = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: Sorted spans come by start, then kind.
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    fits = F.length(d).between(12, 19)
    digits = F.filter(F.split(F.when(fits, d).otherwise(""), ""), lambda x: x != "")
    twice = F.transform(digits, lambda x, i: F.when(i % 2 == 1, x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    return fits & (F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10 == 0)


_TESTS = {"email": lambda m: F.lit(True), "ip": lambda m: m.rlike(_IP_OK), "card": _luhn, "phone": lambda m: F.length(_digits(m)).between(9, 15)}


def _spans(text: Column, kind: str, pattern: str, hint: Column) -> Column:
    """All matches that pass their test, as spans; hint: false only where there are none.

    split() gives what lies between matches, so running lengths are the positions.
    """
    pattern_ = F.lit(pattern)
    found = F.regexp_extract_all(text, pattern_, F.lit(0))
    both = F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(0))).alias("g"))
    at = F.aggregate(
        both,
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<s:int,m:string>>").alias("out")),
        lambda a, x: F.struct(
            (a["pos"] + F.length(x["g"]) + F.length(x["m"])).alias("pos"),
            F.when(_TESTS[kind](x["m"]), F.concat(a["out"], F.array(F.struct((a["pos"] + F.length(x["g"])).alias("s"), x["m"].alias("m"))))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    spans = F.transform(at, lambda x: F.struct(x["s"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (x["s"] + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind")))
    return F.when(hint, spans).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind."""
    t = F.coalesce(text, F.lit(""))
    parts = [
        _spans(t, "email", EMAIL, t.contains("@")),
        _spans(t, "ip", IP, t.rlike(r"[0-9]\.[0-9]++\.[0-9]")),
        _spans(t, "card", CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")),
        _spans(t, "phone", PHONE, t.contains("+")),
    ]
    return F.array_sort(F.concat(*parts).cast(_SPAN))


def _entity(kind: Column, match: Column) -> Column:
    """Normalised value: digits of cards and phones, other kinds in lower case."""
    return F.when(kind.isin("card", "phone"), _digits(match)).otherwise(F.lower(match))


def _context_terms(text: Column, spans: Column, reach: int) -> Column:
    """For each span its kind, its entity and the different words that lie whole within reach of it."""

    def words(piece: Column) -> Column:
        return F.regexp_extract_all(F.lower(piece), F.lit(r"\p{L}++"), F.lit(0))

    def near(s: Column) -> Column:
        # one code point more than reach: a word that reaches it is cut and goes
        lo = F.greatest(s["start"] - reach - 1, F.lit(0))
        left = F.substring(text, lo + 1, s["start"] - lo)
        left = F.when(s["start"] > reach, F.regexp_replace(left, r"^\p{L}++", "")).otherwise(left)
        right = F.substring(text, s["end"] + 1, F.lit(reach + 1))
        right = F.when(F.length(right) > reach, F.regexp_replace(right, r"(?<!\p{L})\p{L}++$", "")).otherwise(right)
        match = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        return F.struct(s["kind"].alias("kind"), _entity(s["kind"], match).alias("entity"), F.array_distinct(F.concat(words(left), words(right))).alias("terms"))

    return F.transform(spans, near)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]++"), lambda w: w != "")


def contexts(docs: DataFrame, reach: int = 40) -> DataFrame:
    """(protected, term): one row for a term in a context; protected is a kind or a kind and an entity."""
    # No filter on the spans: Spark would move it below and find them twice.
    seen = docs.select("text", base_spans(F.col("text")).alias("spans"))
    seen = seen.select(F.explode(_context_terms(F.col("text"), F.col("spans"), reach)).alias("c")).select("c.kind", "c.entity", F.explode("c.terms").alias("term"))
    return seen.select(F.explode(F.array(F.col("kind"), F.concat_ws(":", "kind", "entity"))).alias("protected"), "term")


def revealing_terms(docs: DataFrame, near: DataFrame, disclose: float, support: int) -> DataFrame:
    """The different terms over the disclosure threshold. near: (protected, term), one row a context."""
    near = materialize(near.groupBy("protected", "term").agg(F.count("*").alias("near")))
    counts = docs.select(F.explode(_words(F.col("text"))).alias("term")).groupBy(F.xxhash64("term").alias("wid")).agg(F.count("*").alias("n"))
    counts = materialize(counts)
    total = counts.agg(F.sum("n")).first()[0] or 1
    per = near.groupBy("protected").agg(F.sum("near").alias("all"))
    rated = near.where(F.col("near") >= support).join(per, "protected").withColumn("wid", F.xxhash64("term")).join(counts, "wid")
    ic = -F.log2(F.least(F.col("all") / F.lit(total), F.lit(1.0)))
    pmi = ic + F.log2(F.least(F.col("near") / F.col("n"), F.lit(1.0)))
    out = materialize(rated.where((ic > 0) & (pmi >= disclose * ic)).select("term").distinct())
    discard(near, counts)
    return out


def _term_spans(text: Column, terms: Column, spans: Column) -> Column:
    """Occurrences of the terms as spans; none that overlap a base span."""
    found = F.regexp_extract_all(text, F.lit(r"\p{L}++"), F.lit(0))
    both = F.arrays_zip(found.alias("m"), F.slice(F.split(text, r"\p{L}++", -1), 1, F.size(found)).alias("g"))
    one = lambda a, x: F.struct((a["pos"] + F.length(x["g"])).alias("start"), F.lit(KINDS.index("term")).alias("rank"), (a["pos"] + F.length(x["g"]) + F.length(x["m"])).alias("end"), F.lit("term").alias("kind"))
    at = F.aggregate(
        both,
        F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN).alias("out")),
        lambda a, x: F.struct(
            (a["pos"] + F.length(x["g"]) + F.length(x["m"])).alias("pos"),
            F.when(F.array_contains(terms, F.lower(x["m"])), F.concat(a["out"], F.array(one(a, x)))).otherwise(a["out"]).cast(_SPAN).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.filter(at, lambda t: ~F.exists(spans, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))


def _annotated(docs: DataFrame, carry, reach: int, disclose: float, support: int) -> DataFrame:
    """(carried struct, text, spans); a struct, so that no name of docs can clash."""
    texts = docs.select("text")
    bad = revealing_terms(texts, contexts(texts, reach), disclose, support)
    rows = docs.select(F.struct(*carry).alias("carried"), "text").withColumn("spans", base_spans(F.col("text")))
    if bad.isEmpty():
        discard(bad)
        return rows
    digest = F.md5(F.coalesce("text", F.lit("")))
    words = texts.select(digest.alias("digest"), F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    hits = materialize(words.join(bad, "term").groupBy("digest").agg(F.collect_set("term").alias("terms")))
    discard(bad)
    rows = rows.withColumn("digest", digest).join(hits, "digest", "left")
    extra = F.when(F.col("terms").isNotNull(), _term_spans(F.col("text"), F.col("terms"), F.col("spans")))
    return rows.select("carried", "text", F.array_sort(F.concat("spans", F.coalesce(extra, F.array().cast(_SPAN)))).alias("spans"))


def annotate(docs: DataFrame, carry=("doc_id",), reach: int = 40, disclose: float = 0.95, support: int = 5) -> DataFrame:
    """docs' ``carry`` columns and ``spans`` (instead of a column of that name): base spans and those of revealing terms."""
    carry = [c for c in carry if c != "spans"]
    return _annotated(docs, carry, reach, disclose, support).select("carried.*", "spans")


def redact(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; of overlapping spans the first."""
    out = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["pos"], s["end"]).alias("pos"),
            F.when(s["start"] >= a["pos"], F.concat(a["out"], F.array(F.substring(text, a["pos"] + 1, s["start"] - a["pos"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["pos"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, out).otherwise(text)


def sanitise(docs: DataFrame, reach: int = 40, disclose: float = 0.95, support: int = 5) -> DataFrame:
    """docs with personal data and revealing terms replaced; a null text stays null."""
    rows = _annotated(docs, [c for c in docs.columns if c != "text"] or [F.lit(0).alias("none")], reach, disclose, support)
    return rows.select(*[redact(F.col("text"), F.col("spans")).alias(c) if c == "text" else F.col("carried")[c].alias(c) for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotate(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return rows.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count("term"))
