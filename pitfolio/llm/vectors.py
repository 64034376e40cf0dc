"""Reading vector columns as dense numpy blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not zero, and has finite components only."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(v.isNotNull()).where(~bad).where(F.exists(v, lambda x: x != 0))


def dimension(df: DataFrame, column: str = "embedding") -> int:
    """The most frequent number of components, the smaller on ties; 0 without rows."""
    row = df.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return int(row["d"]) if row else 0


def as_bytes(df: DataFrame, d: int, column: str = "embedding", ids: str = "vec_id") -> DataFrame:
    """(vec_id, v): vectors of d components as little-endian doubles."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                flat = np.ascontiguousarray(b.column("v").flatten().to_numpy(zero_copy_only=False), "<f8")
                raw = flat.tobytes()
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([raw[i : i + 8 * d] for i in range(0, len(raw), 8 * d)], pa.binary())], names=["vec_id", "v"])

    return df.where(F.size(column) == d).select(F.col(ids).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, v binary")


def sampled(rows: DataFrame, most: int, *columns: str) -> DataFrame:
    """About ``most`` of the rows by a hash of ``columns`` (all, if there are no more): a rate
    of 64 bits, so the sample is as large on any table."""
    n = rows.count()
    top = -(1 << 63) + int((1 << 64) * min(1.0, most / max(n, 1)))
    return rows if n <= most else rows.where(F.xxhash64(*columns, F.lit(3)) < F.lit(min(top, (1 << 63) - 1)))


def block(column, dtype="<f8") -> np.ndarray:
    """A binary column as a matrix, one row a value."""
    values = column.to_pylist()
    if not values:
        return np.zeros((0, 0), dtype)
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)
