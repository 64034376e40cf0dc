"""Exact Jaccard self-join of word-shingle sets with set-relation skipping.

Two documents link when 100 * |x & y| >= percent * |x | y|. The work, in order:

1. *Equal sets.* Every set gets a 64-bit fingerprint, its size and a 512-bin histogram
   of its shingles' hashes. Documents with one fingerprint are one class; from here on
   a class stands for all its copies, which are never expanded.
2. *Index.* A prefix filter: sets in one global order (shingles in hot slots last, then
   by hash) can only link if their first n - ceil(t n) + 1 shingles meet. Hot slots are
   found by counting all shingles into 2**22 slots in each task; the bitmap of hot slots
   has that fixed size whatever the input. The order decides cost, never the result.
3. *A similar set's answers.* Within an index list the sets are ordered by a hash of their
   fingerprints; a set is compared with the first set of one list, and with the first sets of
   the others and those before it only where the two have not met one partner. Where
   that links, a set shares the other's answers (it is in the same component), and no
   later pair inside that component is made.
4. *Block skip.* What is left are pairs of one list whose components differ. A list is
   cut in blocks by size, so that only equal or neighbouring blocks meet (a set with none
   of near size in a list is not kept there at all), and pairs are
   skipped by size, by position (every shingle before the meeting point is missing in
   the other set) and by histogram (its L1 distance is at most the number of shingles
   that are in one set only); a coarse form of it, 128 bins, is tested in the join itself.
5. *Verification* of pairs that pass, on whole sets, and connected components.

Shingles are compared as 64-bit hashes. Documents without words link with nothing.
Nulls: a null text is empty, a null id is carried along. Repeated rows are one class.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize, table
from .textwords import arrow_bytes, mix, shingles, slices, word_hashes

_SLOTS = 1 << 22
_BINS, _COARSE = 512, 128
_ROWS = 512


def _sets(batches, k):
    """(part, hashes, ends, doc) for parts of few rows and bytes, so that long texts stay bounded."""
    for part in slices(batches, _ROWS):
        data, offsets = arrow_bytes(part.column("text"))
        h, d = shingles(*word_hashes(data, offsets), part.num_rows, k)
        yield part, h, np.cumsum(np.bincount(d, minlength=part.num_rows)), d


def _fingerprints(n, h, ends):
    mixed = np.concatenate([[np.uint64(0)], np.cumsum(mix(h))])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return mix(mixed[ends] - mixed[starts] + n.astype(np.uint64)).view(np.int64)


def _unseen(fp, seen):
    """Which sets are the first of their class in this task; ``seen`` holds the task's classes so far."""
    new = np.zeros(len(fp), bool)
    new[np.unique(fp, return_index=True)[1]] = True
    for i in np.flatnonzero(new):
        new[i] = int(fp[i]) not in seen
    seen.update(fp[new].tolist())
    return new


def _sizes(batch, ends):
    return np.diff(np.concatenate([[0], ends])).astype(np.int64)


def shingle_classes(docs: DataFrame, k: int) -> DataFrame:
    """Per document: doc_id, n, fp, bins. Per hot slot and task: slot, seen."""

    def run(batches):
        import pyarrow as pa

        seen, total = np.zeros(_SLOTS, np.int32), 0
        for part, h, ends, d in _sets(batches, k):
            n = _sizes(part, ends)
            seen += np.bincount((h >> np.uint64(42)).astype(np.int64), minlength=_SLOTS).astype(np.int32) if len(h) > _SLOTS // 8 else 0
            if len(h) <= _SLOTS // 8:
                np.add.at(seen, (h >> np.uint64(42)).astype(np.int64), 1)
            total += len(h)
            bins = np.bincount(d * _BINS + (h & np.uint64(_BINS - 1)).astype(np.int64), minlength=part.num_rows * _BINS)
            raw = np.minimum(bins, 255).astype(np.uint8).tobytes()
            coarse = np.minimum(bins.reshape(-1, _COARSE, _BINS // _COARSE).sum(axis=2), 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(_fingerprints(n, h, ends)), pa.array([raw[i : i + _BINS] for i in range(0, len(raw), _BINS)], pa.binary()), pa.array(list(coarse), pa.list_(pa.int8())), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int32())],
                names=["doc_id", "n", "fp", "bins", "coarse", "slot", "seen"],
            )
        hot = np.flatnonzero(seen >= 4 + 6 * total // _SLOTS).astype(np.int32)
        for i in range(0, len(hot), 50_000):
            x = hot[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.binary()), pa.nulls(len(x), pa.list_(pa.int8())), pa.array(x), pa.array(seen[x])], names=["doc_id", "n", "fp", "bins", "coarse", "slot", "seen"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, fp long, bins binary, coarse array<tinyint>, slot int, seen int")


def _prefixes(docs: DataFrame, hot, k: int, percent: int) -> DataFrame:
    """(token, fp, n, pos) of every set's prefix in the global order."""

    def run(batches):
        import pyarrow as pa

        flags, seen = np.unpackbits(hot.value), set()
        for part, h, ends, d in _sets(batches, k):
            n = _sizes(part, ends)
            fp = _fingerprints(n, h, ends)
            late = flags[(h >> np.uint64(42)).astype(np.int64)]
            order = np.lexsort((h, late, d)) if late.any() else slice(None)
            h = h[order]
            starts = ends - n
            keep = np.where((n > 0) & _unseen(fp, seen), n - (percent * n + 99) // 100 + 1, 0)
            row = np.repeat(np.arange(len(n)), keep)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(keep) - keep, keep)
            yield pa.RecordBatch.from_arrays([pa.array(h[starts[row] + pos].view(np.int64)), pa.array(fp[row]), pa.array(n[row].astype(np.int32)), pa.array(pos.astype(np.int32))], names=["token", "fp", "n", "pos"])

    return docs.select("text").mapInArrow(run, "token long, fp long, n int, pos int")


_WANTED_BITS = 1 << 24


def _wanted_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(fp, items) for the classes in ``wanted``: a bitmap of fixed size drops most rows
    before hashing is sent on, a join drops the rest."""
    spark = docs.sparkSession
    slots = wanted.select((F.shiftrightunsigned("fp", 40)).cast("int").alias("s")).distinct()
    bits = np.zeros(_WANTED_BITS, np.uint8)
    bits[[r.s for r in slots.toLocalIterator()]] = 1
    shared = spark.sparkContext.broadcast(np.packbits(bits))

    def run(batches):
        import pyarrow as pa

        flags, seen = np.unpackbits(shared.value), set()
        for part, h, ends, _ in _sets(batches, k):
            n = _sizes(part, ends)
            fp = _fingerprints(n, h, ends)
            take = np.flatnonzero((flags[(fp.view(np.uint64) >> np.uint64(40)).astype(np.int64)] > 0) & (n > 0) & _unseen(fp, seen))
            if len(take):
                v = h.view(np.int64)
                items = pa.array([v[ends[i] - n[i] : ends[i]] for i in take], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(fp[take]), items], names=["fp", "items"])

    found = docs.select("text").mapInArrow(run, "fp long, items array<long>")
    return found.groupBy("fp").agg(F.any_value("items").alias("items")).join(wanted, "fp", "left_semi")


def _within(percent: int):
    """Column tests on a pair (na, nb)."""
    least, most = F.least("na", "nb").cast("long"), F.greatest("na", "nb").cast("long")
    size = 100 * least >= percent * most
    room = (F.col("na") + F.col("nb")).cast("long") * (100 - percent)  # over (100 + percent): shingles in one set only
    return size, room


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb) of the ``pairs`` (a, b) whose sizes and histograms let them link."""
    bins = classes.select("fp", "n", "bins")
    both = pairs.join(bins.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("bins").alias("ba")), "a").join(bins.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("bins").alias("bb")), "b")

    def close(batches):
        import pyarrow as pa

        for t in batches:
            if t.num_rows:
                x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, _BINS).astype(np.int16) for c in ("ba", "bb"))
                far = np.abs(x - y).sum(axis=1)
                room = (t.column("na").to_numpy() + t.column("nb").to_numpy()) * (100 - percent)
                keep = far * (100 + percent) <= room
                yield pa.RecordBatch.from_arrays([t.column(c).filter(pa.array(keep)) for c in ("a", "b", "na", "nb")], names=["a", "b", "na", "nb"])

    size, _ = _within(percent)
    return both.where(size).select("a", "b", "na", "nb", "ba", "bb").mapInArrow(close, "a long, b long, na long, nb long")


def _verified(docs: DataFrame, left: DataFrame, k: int, percent: int) -> DataFrame:
    """The (src, dst) of the close pairs ``left`` (a table; a, b, na, nb) that truly link."""
    wanted = left.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    sets = materialize(_wanted_sets(docs, wanted, k))
    x, y = sets.select(F.col("fp").alias("a"), F.col("items").alias("x")), sets.select(F.col("fp").alias("b"), F.col("items").alias("y"))
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    out = materialize(left.join(x, "a").join(y, "b").where(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    discard(sets)
    return out


def _likely_links(entries: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Close pairs (a, b, na, nb) of sets with the first set of a list or the one before them.

    Most sets have the same first set in all their lists. So each is tried with one partner
    alone, the first set of least hash; the other partners are tried only where the two sides
    have not met the same partner so far. What is not tried here is left to the block skip.
    """
    size, room = _within(percent)
    near = F.explode(F.array(F.struct(F.col("lead").alias("o"), F.lit(0).alias("kind")), F.struct(F.col("before").alias("o"), F.lit(1).alias("kind")))).alias("p")
    star = entries.where("before is not null").select("token", "fp", F.col("n").alias("na"), "pos", near).select("token", "fp", "na", "pos", "p.o", "p.kind").withColumn("nb", F.col("o.n"))
    star = star.where("fp <> o.fp").where(size & ((F.col("pos") + F.col("o.pos")).cast("long") * (100 + percent) <= room))
    rank = F.struct("kind", F.xxhash64("o.fp", F.pmod("token", F.lit(4))))
    star = materialize(star.groupBy("fp", F.col("o.fp").alias("other")).agg(F.min(rank).alias("rank")))
    pair = [F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")]
    one = materialize(star.groupBy("fp").agg(F.min_by("other", "rank").alias("other")))
    met = materialize(_close(one.select(*pair).distinct(), classes, percent))
    hub = one.select(*pair, "fp", "other").join(met, ["a", "b"]).select("fp", F.col("other").alias("hub"))
    hub = materialize(hub)
    more = star.join(hub.withColumnRenamed("hub", "h1"), "fp", "left").join(hub.select(F.col("fp").alias("other"), F.col("hub").alias("h2")), "other", "left")
    same = F.coalesce(F.col("h1") == F.col("h2"), F.lit(False)) | F.coalesce(F.col("h1") == F.col("other"), F.lit(False)) | F.coalesce(F.col("h2") == F.col("fp"), F.lit(False))
    more = more.where(~same).select(*pair).distinct().join(one.select(*pair), ["a", "b"], "left_anti")
    out = materialize(met.unionByName(_close(more, classes, percent)))
    discard(star, one, met, hub)
    return out


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    component_id is the smallest doc_id reachable by links, the document's own included.
    """
    spark = docs.sparkSession
    first = materialize(shingle_classes(docs, k))
    rows = materialize(first.where("slot is null").select("doc_id", "n", "fp"))
    classes = materialize(first.where("slot is null").where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.any_value("n").alias("n"), F.any_value("bins").alias("bins"), F.any_value("coarse").alias("coarse")))
    least = 16 + classes.count() // 2000
    slots = first.where("slot is not null").groupBy("slot").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= least).select("slot")
    bits = np.zeros(_SLOTS, np.uint8)
    bits[[r.slot for r in slots.toLocalIterator()]] = 1
    hot = spark.sparkContext.broadcast(np.packbits(bits))
    discard(first)

    # Four orders, by token: a set meets several firsts and predecessors over its lists.
    by = Window.partitionBy("token").orderBy(F.xxhash64("fp", F.pmod("token", F.lit(4))), "fp")
    here = F.struct("fp", "n", "pos")
    entries = _prefixes(docs, hot, k, percent).withColumn("before", F.lag(here).over(by)).withColumn("lead", F.first(here).over(by)).withColumn("next", F.lead("fp").over(by))
    entries = entries.where("before is null or before.fp <> fp").where("lead.fp <> fp or next is not null").select("token", "fp", "n", "pos", "before", "lead")
    # A set links over this list only if the next smaller or larger set here is near in size.
    by_size = Window.partitionBy("token").orderBy("n", "fp")
    near = (100 * F.lag("n").over(by_size).cast("long") >= percent * F.col("n")) | (100 * F.col("n").cast("long") >= percent * F.lead("n").over(by_size))
    entries = materialize(entries.withColumn("near", near).where("near").drop("near"))
    likely = _likely_links(entries, classes, percent)
    links = _verified(docs, likely, k, percent)
    label = materialize(connected_components(links))

    # Pairs of one list that are not yet in one component, by blocks of size.
    step = float(np.log(100 / percent))
    known = entries.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("token", "fp", "n", "pos", F.coalesce("component", "fp").alias("part"))
    of_list = Window.partitionBy("token")
    at = lambda d: F.count("*").over(of_list.orderBy("block").rangeBetween(d, d))  # noqa: E731  sets of the list that many blocks on
    known = known.withColumn("block", F.floor(F.log("n") / step).cast("int"))
    known = known.withColumn("lo", F.min("part").over(of_list)).withColumn("hi", F.max("part").over(of_list)).where("lo <> hi").drop("lo", "hi")
    known = known.withColumn("same", at(0) > 1).withColumn("up", at(1) > 0).withColumn("down", at(-1) > 0).where("same or up or down")
    # A pair that meets in several lists is taken in the first: not where the last lists of both have one in common.
    met = Window.partitionBy("fp").orderBy("pos").rowsBetween(-8, -1)
    known = materialize(known.withColumn("met", F.collect_list("token").over(met)).join(classes.select("fp", "coarse"), "fp"))
    a = known.select("token", F.col("fp").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("part").alias("ca"), F.col("coarse").alias("xa"), F.col("met").alias("ma"), F.explode(F.array_compact(F.array(F.when(F.col("same"), F.col("block")), F.when(F.col("up"), F.col("block") + 1)))).alias("block"), F.col("block").alias("own"))
    b = known.where("same or down").select("token", F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("part").alias("cb"), F.col("coarse").alias("xb"), F.col("met").alias("mb"), "block")
    meet = (a["token"] == b["token"]) & (a["block"] == b["block"]) & (F.col("ca") != F.col("cb"))
    size, room = _within(percent)
    once = (F.col("own") != b["block"]) | (F.col("a") < F.col("b"))
    apart = (F.col("pa") + F.col("pb")).cast("long") * (100 + percent) <= room
    far = F.aggregate(F.zip_with("xa", "xb", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
    again = F.arrays_overlap("ma", "mb")
    rest = a.join(b, meet & once & size & apart & ~again & (far.cast("long") * (100 + percent) <= room)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = materialize(_close(rest.join(likely, ["a", "b"], "left_anti"), classes, percent))
    more = _verified(docs, rest, k, percent)
    joined = label.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(more)
    final = materialize(connected_components(joined))

    named = classes.select("fp", "least_id").join(final.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = named.join(ids, "component").select("fp", "component_id")
    of = materialize(of)
    discard(entries, likely, links, label, known, rest, more, final, classes)
    return rows.join(of, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


#: DuckDB: shingles as text, shared counts by a join on the shingle, reachability by recursion.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""
