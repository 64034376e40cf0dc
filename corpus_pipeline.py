"""Training-corpus pipeline: quality, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all
but the last return the columns of documents. Between stages the table is written as
Parquet in the shared folder and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from pitfolio.llm import jaccard_join, mixing, packing, pii, quality
from pitfolio.llm.common import discard, materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; its rules are learned from labelled rows of docs."""
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text")
    scored = quality.quality_scores(whole, table(spark, sf_dir, "labels"))
    # Not a filter: Spark moves that below the projection and writes each statistic out again in every rule.
    return scored.select(F.explode(F.when(F.col("score") >= quality.THRESHOLD, F.array("doc"))).alias("doc")).select("doc.*")


def _row_key(text) -> Column:
    """64 bits of a row's id and text; the join below compares texts by such hashes too."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))


def _in_order(docs: DataFrame) -> Column:
    """The columns of ``doc`` as a struct that can be ordered and hashed: maps as their sorted entries."""
    return F.struct(*[F.array_sort(F.map_entries(F.col(f"doc.`{f.name}`"))).alias(f.name) if isinstance(f.dataType, MapType) else F.col(f"doc.`{f.name}`") for f in docs.schema])


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8, the row of the smallest id.

    Rows are told apart by id and text: of rows equal in both one stays, that with the least
    other columns, and rows of one id stay all if their texts do not link. A row without id
    counts as the largest id. Rows without words link with nothing and stay.
    """
    slim = docs.select(_row_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("id"), "text")
    linked = materialize(jaccard_join.jaccard_components(slim.select(F.col("key").alias("doc_id"), "text"), k=5, percent=80))
    group = linked.where("n_shingles > 0").groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("group"))
    own = slim.select("key", "id").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("rows")).join(group, "key")
    first = own.groupBy("group").agg(F.min_by(F.struct("key", "rows"), F.struct(F.col("id").isNull(), F.col("id"), F.col("key"))).alias("f"))
    stay = materialize(first.select("f.key", "f.rows"))
    discard(linked)
    whole = docs.select(F.struct(*docs.columns).alias("doc"), _row_key(F.col("text")).alias("key"), (mixing.n_words(F.col("text")) > 0).alias("words"))
    kept = whole.where("words").join(stay, "key")
    again = kept.where("rows > 1").groupBy("key").agg(F.min_by("doc", _in_order(docs)).alias("doc"))
    return kept.where("rows = 1").select("doc.*").unionByName(again.select("doc.*")).unionByName(whole.where("not words").select("doc.*"))


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data and terms that reveal it replaced; n_chars follows the text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a copy is a row."""
    size = mixing.n_words(F.col("text"))
    # Null ids and sources are values of their own; the same columns join and number the rows, so texts are dealt once.
    keys = [F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("no_i"), F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no_s")]
    names = ["i", "no_i", "s", "no_s", "n"]
    plan = mixing.mixed(docs).select(*keys, F.col("size").alias("n"), "copies").groupBy(*names).agg(F.array_sort(F.collect_list("copies")).alias("copies"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *keys, size.alias("n")).join(plan, names)
    k = F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64(_in_order(docs))))
    both = rows.withColumn("c", F.element_at("copies", k)).where("c > 0")
    return both.select("doc", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("copy")).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in training sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one),
    ("personal data", hide_personal),
    ("mixing", mix),
    ("packing", pack),
]

#: Rules, draws and tokens are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
