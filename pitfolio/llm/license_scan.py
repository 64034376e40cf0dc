"""License notices in texts, by votes of word k-grams on diagonals.

Words are runs of ASCII letters and digits (A-Z lower-cased) and all other non-ASCII
characters; everything else parts them. Templates are notices as word lists; the phrases
that must be found wherever they stand are templates as well.

*Votes.* All rolling k-gram hashes of a text are joined with the (template, position) rows of
the same hash. A hit at word ``pos`` of place ``tpos`` in a template votes for the diagonal
``pos - tpos``, where the template would begin. Votes are summed by text, template and
diagonal; a diagonal needs one vote in 16 of the template's k-grams.

*Merging.* A word put in or left out shifts what follows to a diagonal nearby: diagonals of
a text and template that are at most an eighth of the template apart are one span (templates
of fewer than eight words never merge). A quarter of the k-grams must have voted for it.

*Verification.* A span's template words are compared with the words of the text on its
diagonals. At most one in 16 may be missing, none of a template of fewer than 16 words. A
verified notice that lies within another verified one of the text (which of equal ones has
more words in common counts) is dropped, so a notice is not also taken for its shorter kin.
Phrases are exact: each of their diagonals is a place of its own.

A text none of whose k-grams is in a template has no rows to join, and is told by a look-up
in the set of template hashes before anything is exploded. Rows are numbered when they are
written, with the words of only those texts that have a k-gram in common with a template.
The table of templates has a fixed number of rows and is broadcast. Only DataFrame functions
are used.

Score: 1 with a phrase, else the largest share of a template's words on a span (verified or
not), 0 without one. Nulls: a null text is empty, has no words and no labels. Repeated rows
are scanned one by one. An empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_ascii, materialize, table

K = 3
_PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases with their labels, and public license notices.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
NOTICES = [
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("apache-2", """you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
]


def template_words(text: str) -> list[str]:
    return [w for w in re.split(_PARTS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def templates(phrases=PHRASES, notices=NOTICES) -> list[tuple[int, str, bool, list[str]]]:
    """(template, label, phrase, words)."""
    return [(i, label, i < len(phrases), template_words(text)) for i, (label, text) in enumerate([*phrases, *notices])]


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _PARTS), "")


def _grams(words: Column, k: int) -> Column:
    """Hashes of the k-grams of an array of words, in order."""
    gram = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), gram)).otherwise(F.array().cast("array<bigint>"))


def license_spans(docs: DataFrame, phrases=PHRASES, notices=NOTICES, k: int = K) -> DataFrame:
    """doc_id, n_words, spans (array of template, label, phrase, lo, hi, matched, size, verified, kept), one row per row of docs.

    lo and hi are the first and last word of a span; of phrases the words of the place.
    """
    spark, known = docs.sparkSession, templates(phrases, notices)
    every = [F.xxhash64(*[F.lit(w) for w in t[3][i : i + k]]) for t in known for i in range(len(t[3]) - k + 1)]
    if min(len(t[3]) for t in known) < k:
        raise ValueError("a template needs as many words as a k-gram")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_list(F.col("text")).alias("words"))
    texts = texts.withColumn("meets", F.arrays_overlap(_grams(F.col("words"), k), F.array(*every)))
    rows = materialize(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.col("meets"), F.col("words")).alias("words")))

    told = spark.createDataFrame(known, "template int, label string, phrase boolean, twords array<string>")
    places = told.select("template", F.size("twords").alias("size"), F.posexplode(_grams(F.col("twords"), k)).alias("tpos", "gram"))
    grams = rows.where("words is not null").select("row", F.posexplode(_grams(F.col("words"), k)).alias("pos", "gram"))
    votes = grams.join(F.broadcast(places), "gram").groupBy("row", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("pos").alias("lo"), (F.max("pos") + (k - 1)).alias("hi"), F.first("size").alias("size"))
    n_grams = F.col("size") - (k - 1)
    strong = votes.where(F.col("votes") >= F.greatest(F.lit(1), F.floor(n_grams / 16)))

    line = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(line) > F.floor(F.col("size") / 8)
    runs = strong.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("run", F.sum("apart").over(line))
    merged = runs.groupBy("row", "template", "run").agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("size").alias("size"), F.collect_list("diagonal").alias("diagonals")).where(4 * F.col("votes") >= n_grams)

    # Words of a text meet its spans once; both are of one text.
    of_row = merged.join(F.broadcast(told), "template").groupBy("row").agg(F.collect_list(F.struct("template", "label", "phrase", "lo", "hi", "size", "twords", "diagonals")).alias("spans"))

    def checked(s: Column) -> Column:
        place = lambda t: F.exists(s["diagonals"], lambda d: F.get(F.col("words"), d + t) == F.get(s["twords"], t))
        matched = F.size(F.filter(F.sequence(F.lit(0), s["size"] - 1), place))
        return F.struct(s["template"].alias("template"), s["label"].alias("label"), s["phrase"].alias("phrase"), s["lo"].alias("lo"), s["hi"].alias("hi"), matched.alias("matched"), s["size"].alias("size"), F.when(s["phrase"], matched == s["size"]).otherwise(matched >= s["size"] - F.floor(s["size"] / 16)).alias("verified"))

    met = of_row.join(rows.where("words is not null").select("row", "words"), "row").select("row", F.explode(F.transform("spans", checked)).alias("s")).select("row", "s.*")
    order = Window.partitionBy("row", F.col("verified") & ~F.col("phrase")).orderBy("lo", F.desc("hi"), F.desc("matched"), "size", "label", "template").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.max("hi").over(order) >= F.col("hi"), F.lit(False))
    kept = met.withColumn("kept", F.col("verified") & (F.col("phrase") | ~inner))
    spans = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "template", "label", "phrase", "matched", "size", "verified", "kept"))).alias("spans"))
    return rows.select("row", "doc_id", "n_words").join(spans, "row", "left").drop("row")


def labelled(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    out = license_spans(docs, **settings).withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int,template:int,label:string,phrase:boolean,matched:int,size:int,verified:boolean,kept:boolean>>")))
    base, kept = F.filter("spans", lambda s: s["phrase"] & s["kept"]), F.filter("spans", lambda s: s["kept"])
    names = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["lo"].cast("long"))
    best = F.array_max(F.transform("spans", lambda s: s["matched"] / s["size"]))
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(kept).alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"), "spans",
    )


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(table(spark, sf_dir, "documents")).drop("spans")


_VALUES = ", ".join(f"({i}, '{label}', {str(phrase).lower()}, string_split('{' '.join(words)}', ' '))" for i, label, phrase, words in templates())
SQL = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS uid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_PARTS}'), lambda x: x <> '') AS ws FROM documents),
tpl AS (SELECT * FROM (VALUES {_VALUES}) v(tid, label, phrase, tw)),
tg AS (SELECT tid, label, phrase, tw, len(tw) AS n, i - 1 AS tpos, concat_ws(' ', tw[i], tw[i + 1], tw[i + 2]) AS gram FROM (SELECT *, unnest(range(1, len(tw) - 1)) AS i FROM tpl)),
dg AS (SELECT uid, i - 1 AS pos, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS gram FROM (SELECT uid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
dia AS (SELECT uid, tid, any_value(n) AS n, pos - tpos AS diag, count(*) AS votes, min(pos) AS lo, max(pos) + 2 AS hi FROM dg JOIN tg USING (gram) GROUP BY uid, tid, pos - tpos HAVING count(*) >= greatest(1, (any_value(n) - 2) // 16)),
cut AS (SELECT *, CASE WHEN diag - lag(diag) OVER w <= n // 8 THEN 0 ELSE 1 END AS apart FROM dia WINDOW w AS (PARTITION BY uid, tid ORDER BY diag)),
runs AS (SELECT *, sum(apart) OVER (PARTITION BY uid, tid ORDER BY diag) AS run FROM cut),
cand AS (SELECT uid, tid, run, min(lo) AS lo, max(hi) AS hi, list(diag) AS ds FROM runs GROUP BY uid, tid, run HAVING 4 * sum(votes) >= any_value(n) - 2),
met AS (SELECT uid, tid, label, phrase, lo, hi, len(tw) AS n, len(list_filter(range(0, len(tw)), lambda t: len(list_filter(ds, lambda x: x + t >= 0 AND ws[x + t + 1] = tw[t + 1])) > 0)) AS matched FROM cand JOIN d USING (uid) JOIN tpl USING (tid)),
ver AS (SELECT *, CASE WHEN phrase THEN matched = n ELSE matched >= n - n // 16 END AS ok FROM met),
kept AS (SELECT *, ok AND (phrase OR coalesce(max(hi) OVER (PARTITION BY uid, ok AND NOT phrase ORDER BY lo, hi DESC, matched DESC, n, label, tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < hi, true)) AS kept FROM ver),
per AS (SELECT uid, count(*) FILTER (phrase AND kept) AS n_base, min(lo) FILTER (phrase AND kept) AS first_word, max(lo) FILTER (phrase AND kept) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (phrase AND kept)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label) FILTER (kept)), ',') AS labels, max(CAST(matched AS DOUBLE) / n) AS best FROM kept GROUP BY uid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score FROM d LEFT JOIN per USING (uid)"""
