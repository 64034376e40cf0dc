"""Artifacts of a run: tables by run and strategy, logs, a manifest, and the catalogue of runs.

Each attempt at a run writes into a folder of its own, root/run_id/version, and its manifest
last, as one appended file. A run counts from its manifest on: one that was killed before is in
no catalogue, and one that is written again keeps serving its old tables until the new ones
are complete.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import frame_checksum

_MANIFEST = "run_id string, created_at timestamp, version string, tables array<struct<name:string,rows:long,checksum:string>>"


def write_artifacts(run_id: str, root: str, tables: dict[str, DataFrame], logs: dict[str, DataFrame] | None = None, csv: tuple[str, ...] = (), created_at: str | None = None) -> DataFrame:
    """Write tables as Parquet (those named in ``csv`` as CSV too) and logs as JSON lines, then the manifest.

    Tables with a strategy column are partitioned by it. Returns the manifest: one row a run,
    with its version and the rows and checksum of each table.
    """
    spark, sums, version = next(iter(tables.values())).sparkSession, None, uuid.uuid4().hex
    at = f"{root}/{run_id}/{version}"
    for name, df in tables.items():
        df.write.partitionBy(*["strategy"] * ("strategy" in df.columns)).parquet(f"{at}/{name}")
        back = spark.read.schema(df.schema).parquet(f"{at}/{name}")
        if name in csv:
            back.write.option("header", True).csv(f"{at}/{name}_csv")
        one = frame_checksum(back, sorted(back.columns)).select(F.lit(name).alias("name"), "rows", "checksum")
        sums = one if sums is None else sums.unionByName(one)
    for name, df in (logs or {}).items():
        df.write.json(f"{at}/{name}")
    when = F.to_timestamp(F.lit(created_at)) if created_at else F.current_timestamp()
    manifest = sums.agg(F.array_sort(F.collect_list(F.struct("name", "rows", "checksum"))).alias("tables")).select(F.lit(run_id).alias("run_id"), when.alias("created_at"), F.lit(version).alias("version"), "tables")
    manifest.coalesce(1).write.mode("append").json(f"{root}/{run_id}/manifest")  # the commit: one file, seen whole or not at all
    return manifest


def result_hash(board: DataFrame) -> DataFrame:
    """One row: rows and checksum of a result table, whatever the order of its rows and columns."""
    return frame_checksum(board, sorted(board.columns))


def run_catalog(spark: SparkSession, root: str, limit: int = 10) -> DataFrame:
    """The latest runs under root, newest first: run_id, created_at, version, tables; of a run's versions the last committed."""
    all_ = spark.read.schema(_MANIFEST).json(f"{root}/*/manifest").withColumn("_at", F.col("_metadata.file_modification_time"))
    last = all_.groupBy("run_id").agg(F.max_by(F.struct("created_at", "version", "tables"), F.struct("created_at", "_at", "version")).alias("m"))
    return last.select("run_id", "m.*").orderBy(F.desc("created_at"), "run_id").limit(limit)


def run_report(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """One row a table of one run: name, rows, checksum."""
    return run_catalog(spark, root, 1 << 30).where(F.col("run_id") == run_id).select(F.inline("tables"))


def artifact_path(spark: SparkSession, root: str, run_id: str, name: str) -> str:
    """Where the committed version of a run keeps a table or log."""
    found = run_catalog(spark, root, 1 << 30).where(F.col("run_id") == run_id).first()
    if found is None:
        raise ValueError(f"no committed run {run_id}")
    return f"{root}/{run_id}/{found.version}/{name}"


def read_artifact(spark: SparkSession, root: str, run_id: str, name: str) -> DataFrame:
    """A table of the committed version of a run."""
    return spark.read.parquet(artifact_path(spark, root, run_id, name))
