"""Maximum inner product search with score-aware (anisotropic) quantisation.

Codebooks: the space is cut in subspaces of two dimensions with 16 centres each. What
matters for a large inner product is the residual along the vector itself, so the loss
is |r|^2 + (eta - 1) (u . r)^2 with u the vector's direction: parallel error costs eta
times orthogonal error. Codebooks are learned by alternating assignment and weighted
least squares on a sample of about ``max_train`` vectors (by a hash of the row); codes
minimise the same loss by coordinate descent over the subspaces. Every row is indexed.

Search: queries and codes meet in blocks. A query block has one table of 16 scores a
subspace; tables of neighbouring subspaces are added to tables of 256, so that a byte
(two four-bit codes) is one lookup. The best ``depth`` of a block, and whatever ties with
the last of them, are scored exactly in double precision; blocks' best k are merged.

Vectors that are null, zero or not finite take no part, nor do vectors of another than
the most frequent dimension, nor rows without a vec_id (a neighbour could not be named). Ties go to the smaller vec_id. Repeated rows of a vec_id
are candidates one by one, but a query never meets rows of its own id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import as_bytes, block, dimension, sampled, usable

MAX_TRAIN = 10_000
ETA = 4.0
CANDIDATES, QUERIES = 16_384, 2_048


def _codes(x: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes (n, m) by coordinate descent on the anisotropic loss."""
    m, _, w = books.shape
    parts = x.reshape(len(x), m, w)
    u = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
    plain = ((parts[:, :, None, :] - books[None]) ** 2).sum(-1)
    code = plain.argmin(-1)
    along = np.einsum("nmw,nmw->nm", u, parts - books[np.arange(m), code])
    total = along.sum(1)
    for _ in range(sweeps):
        for j in range(m):
            rest = total - along[:, j]
            mine = np.einsum("nw,ncw->nc", u[:, j], parts[:, j, None] - books[j][None])
            code[:, j] = (plain[:, j] + (eta - 1) * (rest[:, None] + mine) ** 2).argmin(1)
            along[:, j] = mine[np.arange(len(x)), code[:, j]]
            total = rest + along[:, j]
    return code


def learn_books(x: np.ndarray, eta: float = ETA, rounds: int = 6, width: int = 2) -> np.ndarray:
    """Codebooks (subspaces, 16, width) from sample vectors; x has a multiple of 2 * width columns."""
    m = x.shape[1] // width
    parts = x.reshape(len(x), m, width)
    order = np.argsort(parts.sum(-1), axis=0)
    at = np.linspace(0, len(x) - 1, 16).astype(int)
    books = np.stack([parts[order[at, j], j] for j in range(m)])
    u = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
    for _ in range(rounds):
        code = _codes(x, books, eta, 1)
        along = np.einsum("nmw,nmw->nm", u, parts - books[np.arange(m), code])
        total = along.sum(1)
        for j in range(m):
            uj, rest = u[:, j], total - along[:, j]
            outer = np.eye(width)[None] + (eta - 1) * uj[:, :, None] * uj[:, None, :]
            goal = parts[:, j] + (eta - 1) * uj * (rest + (uj * parts[:, j]).sum(1))[:, None]
            for c in range(16):
                own = code[:, j] == c
                if own.any():
                    books[j, c] = np.linalg.solve(outer[own].sum(0) + 1e-9 * np.eye(width), goal[own].sum(0))
    return books


def _padded(x: np.ndarray) -> np.ndarray:
    more = -x.shape[1] % 4
    return np.hstack([x, np.zeros((len(x), more))]) if more else x


def search(vectors: DataFrame, k: int = 20, every: int = 20, depth: int = 800, max_train: int = MAX_TRAIN, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    good = usable(vectors.where("vec_id is not null"))
    d = dimension(good)
    rows = materialize(as_bytes(good, d or 1))
    n = rows.count()
    # repeated rows fall in or out together; different ones are what books are learned from
    sample = sampled(rows, max_train, "vec_id", "v").distinct().orderBy("vec_id", "v").toPandas()
    x = _padded(np.frombuffer(b"".join(sample["v"]), "<f8").reshape(-1, d or 1)) if len(sample) else np.zeros((1, 4 * -(-(d or 1) // 4)))
    books = learn_books(np.ascontiguousarray(x))
    shared = spark.sparkContext.broadcast(books)

    def encode(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 4096):
                p = b.slice(at, 4096)
                c = _codes(_padded(block(p.column("v"))), shared.value, ETA)
                two = (c[:, 0::2] * 16 + c[:, 1::2]).astype(np.uint8)
                raw, w = two.tobytes(), two.shape[1]
                yield pa.RecordBatch.from_arrays([p.column("vec_id"), p.column("v"), pa.array([raw[i : i + w] for i in range(0, len(raw), w)], pa.binary())], names=["vec_id", "v", "code"])

    index = materialize(rows.mapInArrow(encode, "vec_id long, v binary, code binary"))
    n_q = rows.where(F.col("vec_id") % every == 0).count()
    c_blocks, q_blocks = -(-n // candidates) or 1, -(-n_q // QUERIES) or 1
    one = lambda salt, m: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = index.where(F.col("vec_id") % every == 0).select("vec_id", "v", one(7, q_blocks).alias("qb"), each(c_blocks).alias("cb"))
    right = index.select("vec_id", "v", "code", one(8, c_blocks).alias("cb"), each(q_blocks).alias("qb"))

    def scan(q, c):
        import pyarrow as pa

        out = [[], [], []]
        if q.num_rows and c.num_rows:
            ids = c.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, v, code = ids[order], block(c.column("v"))[order], block(c.column("code"), np.uint8)[order]
            code = np.ascontiguousarray(code.T)
            qid, qv = q.column("vec_id").to_numpy(), block(q.column("v"))
            b = shared.value
            pq = _padded(qv).reshape(len(qv), len(b), -1)
            lut = np.einsum("qmw,mcw->qmc", pq, b)
            lut = (lut[:, 0::2, :, None] + lut[:, 1::2, None, :]).reshape(len(qv), len(b) // 2, 256).astype(np.float32)
            near = min(depth, len(ids))
            for i in range(len(qv)):
                approx = lut[i, 0][code[0]]
                for j in range(1, len(code)):
                    approx += lut[i, j][code[j]]
                take = np.flatnonzero(approx >= np.partition(approx, len(ids) - near)[len(ids) - near])
                take = take[ids[take] != qid[i]]
                score = (v[take] * qv[i]).sum(axis=1)  # equal rows give equal sums wherever they stand
                best = np.lexsort((ids[take], -score))[:k]
                out[0].append(np.full(len(best), qid[i]))
                out[1].append(ids[take][best])
                out[2].append(score[best])
        a, b_, s = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64), strict=True))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b_, pa.int64()), "score": pa.array(s, pa.float64())})

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(scan, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
