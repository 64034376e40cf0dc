"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A document's size is its number of words. Sources share ``share`` of all words by
weight; no source takes more than ``most`` times its own words, and what it cannot take
goes to the others by weight until none is above (water filling). A source's target
over its size is the expected number of copies of each of its documents: the whole part
is given to all, the rest is a copy probability that has to be rounded to 0 or 1.

*Pivotal rounding.* Two documents with fractional copies exchange words: one of the two
possible transfers is drawn, with chances that leave both expectations unchanged, so
that one document becomes whole (0 or 1 extra copy) and the other carries the rest. The
words of the pair stay the same, and so do those of the source, except for the last
document, which goes to the nearer side: a source misses its target by at most half of
one document.

*Reduction tree.* Documents of one source are dealt by hash in blocks of about
``block``; a block folds to whole documents and one carrier. Carriers of ``block``
neighbouring blocks fold on the next level, until one is left for each source. No task
holds more than a block, whatever a source's share of all rows; draws hang on hashes of
seed, level and block, so reruns agree.

Nulls: a null text has size 0, a null source is one source of its own, last in order.
Empty texts take nothing. Repeated rows (same id, source and size) are rounded one by
one; among them the number of copies is fixed, which row has which is immaterial.
Columns of docs other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

BLOCK = 256


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size): one row a source.

    With sources by cap over weight, those before the first whose cap is beyond the
    common level keep their cap, the others get level times weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    cap = F.col("source_size") * F.lit(float(most))
    per = per.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    everyone = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    per = per.withColumn("goal", F.sum("source_size").over(everyone) * F.lit(float(share)))
    per = per.withColumn("capped", F.sum("cap").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
    per = per.withColumn("open", F.sum("weight").over(before.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    per = per.withColumn("level", (F.col("goal") - F.col("capped")) / F.col("open"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everyone)["level"]
    return per.select("source", "source_size", F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight"))).alias("target"))


def _fold(items: Column, seed: Column) -> Column:
    """Fold an array of (key, size, mass): (done: array of (key, extra), carry: one item)."""

    def meet(state: Column, x: Column) -> Column:
        c = state["carry"]
        both = c["mass"] + x["mass"]
        to_carry = F.least(c["size"] - c["mass"], x["mass"])  # words that can go from x to the carrier
        to_x = F.least(c["mass"], x["size"] - x["mass"])
        draw = F.pmod(F.xxhash64(seed, c["key"], x["key"]), F.lit(1 << 30)) / F.lit(float(1 << 30))
        fill_carry = draw * (to_carry + to_x) < to_x
        full = F.when(fill_carry, c["size"]).otherwise(x["size"])
        is_full = both >= full
        # the side that was filled is done if it got its whole size, otherwise the other side is done with nothing
        carry_done = F.when(fill_carry, is_full).otherwise(~is_full)
        done = F.struct(F.when(carry_done, c["key"]).otherwise(x["key"]).alias("key"), is_full.cast("int").alias("extra"))
        rest = F.when(is_full, both - full).otherwise(both)
        kept = F.struct(
            F.when(carry_done, x["key"]).otherwise(c["key"]).alias("key"),
            F.when(carry_done, x["size"]).otherwise(c["size"]).alias("size"),
            rest.alias("mass"),
        )
        return F.struct(F.concat(state["done"], F.array(done)).alias("done"), kept.alias("carry"))

    zero = F.struct(F.array().cast("array<struct<key:bigint,extra:int>>").alias("done"), items[0].alias("carry"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), zero, meet)


def _folded(rows: DataFrame, seed: int, level: int) -> DataFrame:
    """rows (sid, block, key, size, mass) to one row a block: done, carry."""
    packed = rows.groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("key", "size", "mass"))).alias("items"))
    return packed.select("sid", "block", _fold(F.col("items"), F.xxhash64(F.lit(seed), F.lit(level), "sid", "block")).alias("f")).select("sid", "block", "f.done", "f.carry")


def mixed(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 20, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken."""
    slim = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    per = source_targets(slim.select("source", "size"), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = per.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))

    # One group for each id, source and size; its members are numbered so that each is an item.
    groups = slim.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    counts = slim.where("size > 0").groupBy(F.col("source").alias("s")).agg(F.count("*").alias("docs"))
    per = per.join(counts, per["source"].eqNullSafe(counts["s"]), "left").drop("s").withColumn("blocks", F.ceil(F.coalesce("docs", F.lit(0)) / block).cast("long"))
    per = materialize(per)
    deepest = per.agg(F.max("blocks")).first()[0] or 0

    items = groups.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    items = items.withColumnRenamed("source", "s").join(per, F.col("s").eqNullSafe(F.col("source")))
    key = F.xxhash64(F.lit(seed), "doc_id", "size", "k")
    items = items.select("doc_id", "source", "size", "source_size", "target", "whole", "part", "sid", key.alias("key"), F.pmod(F.xxhash64(key, F.lit(1)), F.greatest("blocks", F.lit(1))).alias("block"))
    still = items.where("part = 0 or size = 0").select("doc_id", "source", "size", "source_size", "target", F.col("whole").alias("copies"))
    open_ = items.where("part > 0 and size > 0")

    # Level 0 keeps the documents inside their block's array, so their decisions need no join back.
    carried = ["doc_id", "source", "source_size", "target", "whole"]
    packed = open_.groupBy("sid", "block").agg(
        F.array_sort(F.collect_list(F.struct("key", F.col("size").cast("double").alias("size"), (F.col("size") * F.col("part")).alias("mass"), "doc_id"))).alias("items"),
        *[F.first(c).alias(c) for c in carried if c != "doc_id"],
    )
    slots = F.transform("items", lambda x, i: F.struct(i.cast("long").alias("key"), x["size"].alias("size"), x["mass"].alias("mass")))
    folded = packed.withColumn("f", _fold(slots, F.xxhash64(F.lit(seed), F.lit(0), "sid", "block"))).select("*", "f.done", "f.carry").drop("f")
    folded = materialize(folded)

    levels, wide = [folded.select("sid", "block", "carry")], deepest
    while wide > 1:
        up = levels[-1].select("sid", F.floor(F.col("block") / block).alias("block"), F.col("block").alias("key"), "carry.size", "carry.mass")
        levels.append(materialize(_folded(up, seed, len(levels)).select("sid", "block", "done", "carry")))
        wide = -(-wide // block)

    # The last carrier of a source goes to the nearer side; then each level tells the one below.
    extra = levels[-1].select("sid", "block", (F.col("carry.mass") * 2 >= F.col("carry.size")).cast("int").alias("extra"))
    for upper in reversed(levels[1:]):
        told = upper.join(extra, ["sid", "block"]).select("sid", F.explode(F.concat("done", F.array(F.struct(F.col("carry.key").alias("key"), F.col("extra").alias("extra"))))).alias("d"))
        extra = told.select("sid", F.col("d.key").alias("block"), F.col("d.extra").alias("extra"))
    all_done = F.concat("done", F.array(F.struct(F.col("carry.key").alias("key"), F.col("extra").alias("extra"))))
    moved = folded.join(extra, ["sid", "block"]).select("items", *[c for c in carried if c != "doc_id"], F.explode(all_done).alias("d"))
    item = F.element_at("items", (F.col("d.key") + 1).cast("int"))
    moved = moved.select(item["doc_id"].alias("doc_id"), "source", item["size"].cast("long").alias("size"), "source_size", "target", (F.col("whole") + F.col("d.extra")).alias("copies"))
    out = still.unionByName(moved)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")
