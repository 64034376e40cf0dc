"""Language-model scores from a probabilistic suffix tree over words.

Training documents: those whose crc32(id) % 7 is not 2. Tokens are words (A-Z lower-cased)
and one end token a document.

*Counts.* All training words are counted. Then, level by level, runs of two words, three
and so on up to ``depth`` + 1: a run is counted if the runs one word shorter that begin and
end it were seen ``least`` times, and listed if it was seen ``least`` times itself. The
threshold is absolute, so the tree grows with the corpus; it stays a distributed table.
Tests for "seen often enough" on the way use a bitmap of fixed size, which lets through a
few more, never less, and a join drops those.

*Divergence test.* A run of one to ``depth`` words is kept as a state if coding what follows
it with its own distribution rather than with that of the state for its suffix saves more
bits (count times Kullback-Leibler divergence over the listed symbols and the rest) than
its listed symbols cost (half of log2 N each).

*Smoothing.* Each listed count is discounted by ``discount``; what is left of a state's
mass goes to its suffix's distribution, down to the root, which is the add-one unigram
with one unseen word. So every state's distribution sums to one over known words and
the unseen word. A token is scored in the longest kept state that ends before it.

*Scoring.* The model is one table: a run's hash with the count of a word, the mass of the
run's last word after the words before, and the mass that the run leaves as a state. Rows
that hold ``p_top`` of all tokens (at most (depth + 1) / p_top) are broadcast. Documents are
dealt in blocks of about ``block_bytes``; a block sends its sorted keys, cut into parts by
their first bits, to where the other rows of a part are, and gets the counts and masses back
in the order of the keys (masses in single precision). Counts cross the same way: one row
of a shuffle holds the keys of a task in a part. Blocks are scored in ``most_shares`` shares,
one after the other, and only the scores of a share stay.

Words and runs are compared as 64-bit hashes. Nulls: a null text is empty and has the end
token only. Repeated rows count and are scored one by one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fold, materialize, table
from .textwords import arrow_bytes, mix, slices, word_hashes

_END = np.uint64(0x5EED0FE2D0FD0C5)
_FLUSH = 1 << 21
_BITS = 25
_STEP = np.uint64(0xA24BAED4963EE407)


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc) of all tokens, the end token of each text last."""
    h, d = word_hashes(*arrow_bytes(column))
    n = len(column)
    at = np.cumsum(np.bincount(d, minlength=n))
    return np.insert(h, at, _END), np.insert(d, at, np.arange(n))


def runs(h: np.ndarray, d: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length the hash of the run that ends at each token, and whether it lies in one text."""
    out = [(h, np.ones(len(h), bool))]
    for m in range(2, longest + 1):
        g, ok = np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
        g[1:] = mix(out[-1][0][:-1] * _STEP + h[1:] + np.uint64(m))
        ok[1:] = out[-1][1][:-1] & (d[1:] == d[:-1])
        out.append((g, ok))
    return out


def bitmap(keys: DataFrame) -> np.ndarray:
    """2**_BITS bits, set where a key k falls; the driver gets at most 2**(_BITS - 6) rows."""
    slot = F.shiftrightunsigned("k", 64 - _BITS)
    words = keys.select(F.shiftright(slot, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (_BITS - 6), np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys >> np.uint64(64 - _BITS)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def _planes(a: np.ndarray) -> bytes:
    """All first bytes of the values, then all second ones and so on: sorted keys and small counts compress that way."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _values(column, dtype) -> list[np.ndarray]:
    """The arrays that ``_planes`` made bytes of, null ones left out."""
    width = np.dtype(dtype).itemsize
    return [np.ascontiguousarray(np.frombuffer(b.as_buffer(), np.uint8).reshape(width, -1).T).view(dtype).reshape(-1) for b in column if b.is_valid]


def _whole(column, dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *_values(column, dtype)])


def _cut(bits: int, k: np.ndarray, **columns):
    """Sorted keys and values beside them as one row (part, k, ..) a part: the keys that share their first ``bits`` bits."""
    import pyarrow as pa

    part = (k >> np.uint64(64 - bits)).astype(np.int32)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    ends = [*first[1:].tolist(), len(k)]
    packed = {c: pa.nulls(len(first), pa.binary()) if v is None else pa.array([_planes(v[i:j]) for i, j in zip(first.tolist(), ends, strict=False)], pa.binary()) for c, v in {"k": k, **columns}.items()}
    return pa.RecordBatch.from_pydict({"part": pa.array(part[first]), **packed})


def _cut_bits(size: int, part_bytes: int = 8 << 20) -> int:
    """First bits of a key by which texts of so many bytes are cut into parts."""
    return min(24, max(1, (int(size) // part_bytes).bit_length()))


def _added(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n[order], first) if len(k) else n


def _level(train: DataFrame, m: int, least: int, own, longer: bool, cut: int) -> DataFrame:
    """(m, k, n, ctx, suf): counts of runs of m + 1 words whose parts are in the bitmap ``own``
    (of runs of m words), if ``longer``, and for the runs of m words in it the runs that begin and end them."""
    spark = train.sparkSession
    bits = spark.sparkContext.broadcast(own)

    def run(batches):
        import pyarrow as pa

        ahead, parts, size = [], [], 0

        def out():
            k, n = np.unique(np.concatenate(ahead), return_counts=True)
            x = np.concatenate(parts) if parts else np.zeros((0, 3), np.uint64)
            x = x[np.unique(x[:, 0], return_index=True)[1]]
            for kind, b in ((m + 1, _cut(cut, k, n=n.astype(np.int32), ctx=None, suf=None)), (m, _cut(cut, x[:, 0].copy(), n=None, ctx=x[:, 1].copy(), suf=x[:, 2].copy()))):
                yield b.append_column("m", pa.array(np.full(b.num_rows, kind, np.int32)))

        for part in slices(batches):
            g = runs(*tokens(part.column("text")), m + longer)
            here = g[m - 1][1] & held(bits.value, g[m - 1][0])
            at = np.flatnonzero(g[m][1] & here & np.concatenate([[False], here[:-1]])) if longer else []
            ahead.append(g[m][0][at] if longer else np.zeros(0, np.uint64))
            if m > 1:
                at = np.flatnonzero(here)
                at = at[np.unique(g[m - 1][0][at], return_index=True)[1]]
                parts.append(np.stack([g[m - 1][0][at], g[m - 2][0][at - 1], g[m - 2][0][at]], axis=1))
            size += len(here)
            if size >= _FLUSH:
                yield from out()
                ahead, parts, size = [], [], 0
        if size:
            yield from out()

    def gather(sent):
        import pyarrow as pa

        k, n = _added(_whole(sent.filter(sent.column("n").is_valid()).column("k"), np.uint64), _whole(sent.column("n"), np.int32).astype(np.int64))
        k, n = k[n >= least], n[n >= least]
        run, first = np.unique(_whole(sent.filter(sent.column("n").is_null()).column("k"), np.uint64), return_index=True)
        ctx, suf = (_whole(sent.column(c), np.uint64)[first] for c in ("ctx", "suf"))
        cols = [[np.full(len(k), m + 1, np.int32), k, n, None, None], [np.full(len(run), m, np.int32), run, None, ctx, suf]]
        types = [pa.int32(), *[pa.int64()] * 4]
        tables = [pa.table([pa.nulls(len(c[0]), t) if v is None else pa.array(v.view(np.int64) if v.dtype == np.uint64 else v, t) for v, t in zip(c, types, strict=True)], names=["m", "k", "n", "ctx", "suf"]) for c in cols]
        return pa.concat_tables(tables)

    seen = train.select("text").mapInArrow(run, "part int, k binary, n binary, ctx binary, suf binary, m int")
    return materialize(seen.groupBy("part").applyInArrow(gather, "m int, k long, n long, ctx long, suf long"))


def _words(train: DataFrame, cut: int) -> DataFrame:
    """(k, n) of all tokens."""

    def run(batches):
        kept, size = [], 0

        def out():
            k, n = np.unique(np.concatenate(kept), return_counts=True)
            return _cut(cut, k, n=n.astype(np.int32))

        for part in slices(batches):
            kept.append(tokens(part.column("text"))[0])
            size += len(kept[-1])
            if size >= _FLUSH:
                yield out()
                kept, size = [], 0
        if size:
            yield out()

    def gather(sent):
        import pyarrow as pa

        k, n = _added(_whole(sent.column("k"), np.uint64), _whole(sent.column("n"), np.int32).astype(np.int64))
        return pa.table({"k": pa.array(k.view(np.int64)), "n": pa.array(n)})

    return materialize(train.select("text").mapInArrow(run, "part int, k binary, n binary").groupBy("part").applyInArrow(gather, "k long, n long"))


class Model:
    """rows: table (k, n, mass, left, w); w: how often the run was seen. total and kinds of training words.

    A word has a row with its count and, where it is a state, another with what it leaves.
    """

    def __init__(self, rows: DataFrame, total: int, kinds: int, depth: int):
        self.rows, self.total, self.kinds, self.depth = rows, total, kinds, depth


def _states(grams: DataFrame, lower: DataFrame, total: int, discount: float) -> DataFrame:
    """grams (k, n, ctx, suf) with the state test of their ctx: p_low, mass, kept, left.

    lower: (k, n, p) of runs one word shorter, p the probability of their last word.
    """
    g = grams.join(lower.select(F.col("k").alias("suf"), F.col("p").alias("p_low")), "suf").join(lower.select(F.col("k").alias("ctx"), F.col("n").alias("n_ctx")), "ctx")
    g = g.withColumn("q", F.col("n") / F.col("n_ctx")).withColumn("mass", F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("n_ctx"))
    per = g.groupBy("ctx").agg(
        F.sum(F.col("q") * F.log2(F.col("q") / F.col("p_low"))).alias("gain"), F.greatest(1 - F.sum("q"), F.lit(1e-12)).alias("rest"),
        F.greatest(1 - F.sum("p_low"), F.lit(1e-12)).alias("rest_low"), F.count("*").alias("listed"), F.max("n_ctx").alias("n_"), (1 - F.sum("mass")).alias("left"),
    )
    saved = F.col("n_") * (F.col("gain") + F.col("rest") * F.log2(F.col("rest") / F.col("rest_low")))
    per = per.select("ctx", "left", (saved > 0.5 * float(np.log2(max(total, 2))) * F.col("listed")).alias("kept"))
    return g.join(per, "ctx")


def grow(train: DataFrame, depth: int = 2, least: int = 8, discount: float = 0.75) -> Model:
    """The model of the training texts."""
    cut = _cut_bits(train.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    words = _words(train, cut)
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    lower = words.where(F.col("n") >= least).select("k", "n", ((F.col("n") + 1) / (total + kinds + 1)).alias("p"))
    none = F.lit(None).cast("double")
    parts = []
    bits, written, counted = bitmap(lower), [], None
    for m in range(1, depth + 2):
        level = _level(train, m, least, bits, m <= depth, cut)
        written.append(level)
        if m > 1:
            listed = counted.join(level.where(F.col("m") == m).select("k", "ctx", "suf"), "k")
            g = materialize(_states(listed, lower, total, discount))
            written.append(g)
            parts.append(g.where("kept").select("k", F.lit(None).cast("long").alias("n"), "mass", none.alias("left"), F.col("n").alias("w")))
            parts.append(g.where("kept").groupBy(F.col("ctx").alias("k")).agg(F.lit(None).cast("long").alias("n"), none.alias("mass"), F.max("left").alias("left"), F.max("n_ctx").alias("w")))
            lower = g.select("k", "n", F.when(F.col("kept"), F.col("mass") + F.col("left") * F.col("p_low")).otherwise(F.col("p_low")).alias("p"))
        counted = level.where(F.col("m") == m + 1).select("k", "n")
        if m <= depth:
            bits = bitmap(counted)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    states = materialize(every.groupBy("k").agg(F.max("n").alias("n"), F.max("mass").alias("mass"), F.max("left").alias("left"), F.max("w").alias("w")))
    discard(*written)
    rows = words.select("k", "n", none.alias("mass"), none.alias("left"), F.col("n").alias("w")).unionByName(states)
    return Model(rows, int(total), int(kinds), depth)


class _Top:
    """Model rows that every task has, in order of their keys. ``slots``: a small bitmap of the keys, to pass most others by."""

    def __init__(self, k, n, mass, left):
        order = np.argsort(k)
        self.keys, self.n, self.mass, self.left = k[order], np.nan_to_num(n[order]).astype(np.int64), mass[order], left[order]
        self.slots = np.zeros(1 << 21, bool)
        self.slots[self.keys >> np.uint64(43)] = True

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 for none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        at[self.keys[at] != keys] = -1
        return at


def _look(batches, top: _Top, bits: np.ndarray, depth: int, asked_only: bool = False):
    """Sorted keys that texts may need besides the top rows, and (part of the texts, doc of each token, rows by length)
    where a row is that of the top rows, that of the keys after them, or -1."""
    keys, found = [np.zeros(0, np.uint64)], []
    for part in slices(batches):
        h, d = tokens(part.column("text"))
        rows = []
        for m, (g, ok) in enumerate(runs(h, d, depth + 1)):
            at = np.full(len(g), -1, np.int32)
            near = np.arange(len(g)) if not m else np.flatnonzero(ok & top.slots[g >> np.uint64(43)])
            at[near] = top.find(g[near])
            lacks = np.flatnonzero(at < 0 if not m else ok & (at < 0) & held(bits, g))
            keys.append(np.unique(g[lacks]) if asked_only else g[lacks])
            rows.append((at, lacks))
        if not asked_only:
            found.append((part, d, rows))
    every = np.concatenate(keys)
    if asked_only:
        return np.unique(every), []
    asked, back = np.unique(every, return_inverse=True)
    at = 0
    for _, _, rows in found:
        for row, lacks in rows:
            row[lacks] = len(top.keys) + back[at : at + len(lacks)]
            at += len(lacks)
    return asked, [(part, d, [row for row, _ in rows]) for part, d, rows in found]


def _parts_of(rows: DataFrame, cut: int, flush: int) -> DataFrame:
    """Model rows by part: (part, k, n, mass, left)."""

    def run(batches):
        import pyarrow as pa

        kept, size = [], 0

        def out():
            t = pa.Table.from_batches(kept)
            k, n = t.column("k").to_numpy().view(np.uint64), t.column("n").fill_null(0).to_numpy()
            order = np.argsort(k, kind="stable")
            state = t.column("mass").is_valid().to_numpy() | t.column("left").is_valid().to_numpy()
            mass, left = (t.column(c).to_numpy().astype(np.float32) for c in ("mass", "left"))
            word, state = order[~state[order]], order[state[order]]
            yield _cut(cut, k[word], n=n[word], mass=None, left=None)
            yield _cut(cut, k[state], n=None, mass=mass[state], left=left[state])

        for b in batches:
            kept.append(b)
            size += b.num_rows
            if size >= flush:
                yield from out()
                kept, size = [], 0
        if size:
            yield from out()

    return rows.select("k", "n", "mass", "left").mapInArrow(run, "part int, k binary, n binary, mass binary, left binary")


def _told(known, asked):
    """For each block's keys in a part the counts, masses and left masses, in the order of the keys."""
    import pyarrow as pa

    blocks = _values(asked.column("k"), np.uint64)
    keys = np.concatenate([np.zeros(0, np.uint64), *blocks])

    def at(rows):
        k = _whole(rows.column("k"), np.uint64)
        order = np.argsort(k, kind="stable")
        k = k[order]
        to = np.searchsorted(k, keys)
        hit = np.flatnonzero(to < len(k))
        hit = hit[k[to[hit]] == keys[hit]]
        return hit, order[to[hit]]

    out = {"n": np.zeros(len(keys), np.int64), "mass": np.full(len(keys), np.nan, np.float32), "left": np.full(len(keys), np.nan, np.float32)}
    hit, of = at(known.filter(known.column("n").is_valid()))
    out["n"][hit] = _whole(known.column("n"), np.int64)[of]
    hit, of = at(known.filter(known.column("n").is_null()))
    for c in ("mass", "left"):
        out[c][hit] = _whole(known.column(c), np.float32)[of]
    ends = np.cumsum([0, *map(len, blocks)])
    return pa.table({"block": asked.column("block"), "part": asked.column("part"), **{c: pa.array([_planes(v[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for c, v in out.items()}})


def scores(docs: DataFrame, model: Model, p_top: float = 2e-5, block_bytes: int = 10 << 20, flush: int = _FLUSH, most_shares: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    spark, depth = docs.sparkSession, model.depth
    often = model.rows.where(F.col("w") >= max(2.0, p_top * model.total)).groupBy("k").agg(F.max("n").alias("n"), F.max("mass").alias("mass"), F.max("left").alias("left")).toArrow()
    top = spark.sparkContext.broadcast(_Top(often["k"].to_numpy().view(np.uint64), *(often[c].to_numpy().astype(float) for c in ("n", "mass", "left"))))
    rare = model.rows.where(F.col("w") < max(2.0, p_top * model.total))
    bits = spark.sparkContext.broadcast(bitmap(rare.where("mass is not null or left is not null")))
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks, cut = max(1, -(-size // block_bytes), -(-rows // 50_000)), _cut_bits(size)
    # By what the row holds, so that it is in one block however often the input is read.
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    dealt = docs.select(F.col("doc_id").cast("long"), "text").withColumn("block", block)

    def ask(mine):
        import pyarrow as pa

        sent = _cut(cut, _look(mine.to_batches(), top.value, bits.value, depth, asked_only=True)[0])
        return pa.Table.from_batches([sent.append_column("block", pa.array(np.full(sent.num_rows, mine.column("block")[0].as_py(), np.int32)))])

    total, unit = model.total, model.total + model.kinds + 1

    def rate(mine, told):
        import pyarrow as pa

        known, parts = top.value, []
        asked, found = _look(mine.to_batches(), known, bits.value, depth)
        told = told.sort_by("part")
        values = [np.concatenate([a, _whole(told.column(c), t).astype(a.dtype), [none]]) for c, a, t, none in (("n", known.n, np.int64, 0), ("mass", known.mass, np.float32, 0.0), ("left", known.left, np.float32, np.nan))]
        counts, mass, leaves = values[0], np.nan_to_num(values[1]), values[2]
        if len(counts) != len(known.keys) + len(asked) + 1:
            raise ValueError("the texts of a block changed between two reads")
        for part, d, found_rows in found:
            n = part.num_rows
            left = None
            for m, at in enumerate(found_rows):
                if not m:
                    count = counts[at]
                    p = base = (count + 1) / unit
                else:
                    before = np.concatenate([[np.nan], left[:-1]])
                    before[np.flatnonzero(d[1:] != d[:-1]) + 1] = np.nan
                    state = np.flatnonzero(~np.isnan(before))
                    p = p.copy()
                    p[state] = mass[at[state]] + before[state] * p[state]
                left = leaves[at]
            of = lambda w: np.bincount(d, w, n)  # noqa: E731, B023
            parts.append(pa.table({"doc_id": part.column("doc_id"), "n_tokens": pa.array(np.bincount(d, minlength=n).astype(np.int64)), "n_known": pa.array(of(count > 0).astype(np.int64)), "train_tokens": pa.array(np.full(n, total, np.int64)), "base_score": pa.array(of(np.log10(base))), "score": pa.array(of(np.log10(p)))}))
        none = pa.table({c: pa.array([], pa.int64() if c[0] in "dnt" else pa.float64()) for c in ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")})
        return pa.concat_tables(parts) if parts else none

    # A share of the blocks at a time, so that the disk holds the texts, keys and answers of one share only.
    shares, out = min(int(blocks), most_shares), None
    for i in range(shares):
        mine = dealt.where(F.col("block") % shares == i).repartition(-(-int(blocks) // shares), "block")
        asked = mine.groupBy("block").applyInArrow(ask, "part int, k binary, block int")
        # Written, so that what was asked no longer takes disk when documents and answers meet.
        answers = materialize(_parts_of(rare, cut, flush).groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(_told, "block int, part int, n binary, mass binary, left binary"))
        rated = mine.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(rate, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        if shares > 1:
            rated = materialize(rated)
            discard(answers)
        out = rated if out is None else out.unionByName(rated)
    return out


def op5_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = grow(docs.where(fold(F.col("doc_id"), 7) != 2))
    return scores(docs, model).select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
