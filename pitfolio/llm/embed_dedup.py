"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors are one class; a class stands for its copies, which are never expanded.
Unit vectors are turned to the axes of their second moments, largest first (one 64 x 64
sum a task goes to the driver). Classes are dealt in tiles by their first coordinate.
Two tiles meet only if their ranges come within the greatest distance that a linked pair
can have there. In a pair of tiles the leading dimensions of all products are summed
first; a pair goes on only if the sum so far plus the product of the suffix norms can
still reach the threshold, and what survives all dimensions is tested exactly, on the
original vectors in double precision.

A task returns, for each vector, the copies it is linked to, and a spanning forest of its
links: at most two rows a vector however dense a group is. Sums give n_links, connected
components the rest. Vectors that are null, zero or not finite, or of another than the
most frequent dimension, link with nothing. Repeated vec_ids are rows of their own, linked
or not by their vectors. A null vec_id is a row as any other, but no component's id unless
its group has no other: then component_id is null and the row is kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, table
from .vectors import as_bytes, block, dimension, usable

TILE = 4096
_STRIP = 512


def principal_axes(rows: DataFrame, d: int) -> np.ndarray:
    """Columns: axes of the second moment of the unit vectors, largest first."""

    def run(batches):
        import pyarrow as pa

        s = np.zeros((d, d))
        for b in batches:
            x = block(b.column("v"))
            if len(x):
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                s += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], names=["s"])

    s = sum((np.frombuffer(r.s, "<f8").reshape(d, d) for r in rows.select("v").mapInArrow(run, "s binary").toLocalIterator()), np.zeros((d, d)))
    value, axes = np.linalg.eigh(s)
    return np.ascontiguousarray(axes[:, np.argsort(-value)])


def _forest(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of pairs that join two trees of ``up`` (parents, never larger), which then has them joined."""
    keep, live = [np.zeros(0, np.int64)], np.arange(len(a))
    while len(live):
        while (up[up] != up).any():
            up[:] = up[up]
        x, y = up[a[live]], up[b[live]]
        live, x, y = live[x != y], x[x != y], y[x != y]
        if not len(live):
            break
        hi, lo = np.maximum(x, y), np.minimum(x, y)
        np.minimum.at(up, hi, lo)
        took = np.flatnonzero(up[hi] == lo)
        keep.append(live[took[np.unique(hi[took], return_index=True)[1]]])  # one pair for each root that was hooked
    return np.concatenate(keep)


def linked_pairs(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, least: float, same: bool, lead: int = 16):
    """Yield (i, j) of linked rows of unit matrices x, y; rx, ry: the same in PCA order, single precision."""
    d = rx.shape[1]
    lead = min(lead, d)
    cuts = [*range(lead, d, lead), d]
    sx = np.stack([np.sqrt(np.maximum((rx[:, c:] ** 2).sum(1), 0)) for c in cuts])
    sy = np.stack([np.sqrt(np.maximum((ry[:, c:] ** 2).sum(1), 0)) for c in cuts])
    head_x = np.hstack([rx[:, :lead], sx[0][:, None]])
    head_y = np.hstack([ry[:, :lead], sy[0][:, None]])  # one product gives sum so far plus bound
    slack = np.float32(least - 1e-5)
    for at in range(0, len(rx), _STRIP):
        from_ = at if same else 0
        i, j = np.nonzero(head_x[at : at + _STRIP] @ head_y[from_:].T >= slack)
        i, j = i + at, j + from_
        if same:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 1 << 18):
            a, b = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
            part = np.einsum("nd,nd->n", rx[a, :lead], ry[b, :lead])
            for k in range(1, len(cuts)):
                part = part + np.einsum("nd,nd->n", rx[a, cuts[k - 1] : cuts[k]], ry[b, cuts[k - 1] : cuts[k]])
                go = part + sx[k][a] * sy[k][b] >= slack
                a, b, part = a[go], b[go], part[go]
            exact = np.einsum("nd,nd->n", x[a], y[b]) >= least
            yield a[exact], b[exact]


def near_duplicates(vectors: DataFrame, least: float = 0.95, tile: int = TILE) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ids = vectors.select("vec_id", "embedding")
    good = usable(ids)
    d = dimension(good) or 1
    rows = materialize(as_bytes(good, d))
    # A class is its vector; the number it gets is as good as any, once it is written.
    classes = materialize(rows.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    axes = spark.sparkContext.broadcast(principal_axes(classes, d))
    reach = float(np.sqrt(2 - 2 * least)) + 1e-6

    def first(batches):
        import pyarrow as pa

        for b in batches:
            x = block(b.column("v"))
            c = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes.value[:, 0] if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c)], names=[*b.schema.names, "c"])

    placed = materialize(classes.select("v", "rep", "copies").mapInArrow(first, "v binary, rep long, copies long, c double"))
    n = placed.count()
    tiles = max(1, -(-n // tile))
    edges = placed.approxQuantile("c", [i / tiles for i in range(1, tiles)], 0.25 / tiles) if tiles > 1 else []
    cuts = F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>")
    placed = placed.withColumn("tile", F.size(F.filter(cuts, lambda e: F.col("c") >= e)))
    bounds = {r["tile"]: (r["lo"], r["hi"]) for r in placed.groupBy("tile").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).collect()}
    # Tiles are in order of c, so those that a tile meets are a run: it meets j from ``lo`` to ``hi``.
    at = sorted(bounds)
    low, high = np.array([bounds[t][0] for t in at]), np.array([bounds[t][1] for t in at])
    last = np.searchsorted(low, high + reach, "right") - 1
    begin = np.searchsorted(high, low - reach, "left")
    runs = spark.createDataFrame([(t, at[i], at[j]) for t, i, j in zip(at, begin.tolist(), last.tolist(), strict=True)] or [(0, 0, 0)], "tile int, lo int, hi int")
    runs = runs.select("tile", F.explode(F.sequence("lo", "hi")).alias("o")).select("tile", F.least("tile", "o").alias("ti"), F.greatest("tile", "o").alias("tj"))
    dealt = placed.select("tile", "rep", "copies", "v").join(runs, "tile")

    def compare(t):
        import pyarrow as pa

        side = t.column("tile").to_numpy()
        i, j = t.column("ti")[0].as_py(), t.column("tj")[0].as_py()
        v = block(t.column("v"))
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        r = (v @ axes.value).astype(np.float32)
        rep, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
        links, from_, to, up = np.zeros(len(v)), [], [], np.arange(len(v))
        for x, y in linked_pairs(v[a], v[b], r[a], r[b], least, i == j):
            x, y = a[x], b[y]
            links += np.bincount(x, copies[y], len(v)) + np.bincount(y, copies[x], len(v))
            keep = _forest(up, x, y)
            from_.append(x[keep])
            to.append(y[keep])
        x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (from_, to))
        links = links.astype(np.int64)
        got = np.flatnonzero(links)
        none = pa.nulls(len(got), pa.int64())
        return pa.concat_tables([pa.table({"rep": pa.array(rep[got]), "links": pa.array(links[got]), "other": none}), pa.table({"rep": pa.array(rep[x]), "links": pa.nulls(len(x), pa.int64()), "other": pa.array(rep[y])})])

    found = materialize(dealt.groupBy("ti", "tj").applyInArrow(compare, "rep long, links long, other long"))
    component = connected_components(found.where("other is not null").select(F.col("rep").alias("src"), F.col("other").alias("dst")))
    counts = found.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("group", F.coalesce("component", "rep"))
    smallest = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "group").join(counts, "rep", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.join(named, "v").select("vec_id", "n_links", "component_id")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    apart = ids.where(F.col("embedding").isNull() | bad | ~F.exists("embedding", lambda x: x != 0) | (F.size("embedding") != d))
    alone = apart.select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: DuckDB: all cosines in double precision, reachability by recursion.
SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), n AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x),
reach AS (
  SELECT vec_id, vec_id AS node FROM e UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON l.x = r.node
)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM e LEFT JOIN n USING (vec_id) JOIN (SELECT vec_id, min(node) AS component_id FROM reach GROUP BY vec_id) m USING (vec_id)
"""
