"""Helpers shared by the corpus operators: readers, folds, tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir of the session.

    Only where it is unset (local tests) a temporary folder of this machine is used.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not str(spark.sparkContext.master).startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = os.path.join(tempfile.gettempdir(), "pitfolio-shared")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Spark's setting that removes the shuffle files of a query when it ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts lineage; a lost executor loses nothing, since the files are not its own. The
    shuffle files behind a written table serve nobody any more and go when it is written.
    The caller's session keeps the folder; it is one fresh name for each call.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pitfolio-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and that no later plan reads."""
    for t in tables:
        spark = t.sparkSession
        for path in {f.rpartition("/")[0] for f in t.inputFiles()}:
            if path.rpartition("/")[2].startswith("pitfolio-"):
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over the undirected edges (src, dst).

    Contraction. In each round every node hooks to its neighbour of least hash, if that is
    below its own, and follows the hooks four steps; edges then join the nodes hooked to,
    and those within one node go. Hashes differ by round, so chains are short and about
    half of the nodes or more go in each round, whatever the ids or the shape; the loop
    ends when no edge is left. A round reads only the edges left by the one before. The
    hooks of all rounds, last round first, give each node its root, and the least node of
    a root is the component. Nothing but a flag reaches the driver.
    """
    rest = materialize(edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).where("u <> v").distinct())
    rounds: list[DataFrame] = []
    while not rest.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))), F.col(c))  # noqa: E731, B023
        both = rest.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(rest.select(F.col("v").alias("node"), F.col("u").alias("other")))
        hook = both.groupBy("node").agg(F.min(rank("other")).alias("m"))
        hook = materialize(hook.select("node", F.when(F.col("m") < rank("node"), F.col("m")["other"]).otherwise(F.col("node")).alias("up")))
        step = hook
        for _ in range(2):
            step = step.select("node", F.col("up").alias("via")).join(step.select(F.col("node").alias("via"), "up"), "via").select("node", "up")
        up = materialize(step)
        moved = rest.join(up.select(F.col("node").alias("u"), F.col("up").alias("x")), "u").join(up.select(F.col("node").alias("v"), F.col("up").alias("y")), "v")
        left = materialize(moved.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        discard(hook, rest)
        rest = left
        rounds.append(up)
    if not rounds:
        return rest.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = rounds.pop()
    while rounds:
        lower = rounds.pop()
        above = materialize(lower.join(roots.select(F.col("node").alias("up"), F.col("up").alias("root")), "up", "left").select("node", F.coalesce("root", "up").alias("up")))
        discard(lower, roots)
        roots = above
    least = roots.groupBy("up").agg(F.min("node").alias("component"))
    return roots.join(least, "up").select("node", "component")
