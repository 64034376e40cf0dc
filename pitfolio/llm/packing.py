"""Packing documents into token sequences by cutting-stock column generation.

A document's tokens (and one end id) are cut in pieces of ``width`` ids; the rest of each
is one piece of its own. What has to be packed is a histogram over at most ``width``
piece lengths, whatever the number of documents.

1. Lengths are put in classes, exact for short pieces and coarser (at most 1 in 256) for
   longer ones, each class counting as its longest length.
2. *Column generation.* A pattern says how many pieces of each class share a sequence. A
   linear program over patterns covers the histogram with the fewest sequences; its dual
   prices go to an unbounded-knapsack dynamic program over the width, which gives the
   pattern with the best price; patterns enter until none is worth more than 1.
   The first basis fills sequences with the longest pieces that fit, which is triangular.
3. *Rounding.* Pattern counts are rounded down and the rest of the histogram is solved
   again, until nothing is placed; the last pieces are filled in from the longest class
   down. All of this is on the driver, on histograms of fixed size.
4. *Assignment.* The pieces of a class are ranked (by salted partial counts, so that a
   length that a third of all documents has is no single task) and take the places of
   their class in the patterns, found by a join with the table of places.

Nulls: a null text is empty and has the end id only. Repeated rows are pieces of their
own. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

WIDTH = 2048
END_ID = 1
_KEEP = 150_000
#: A blank beside other white space: the run around it may be one pre-token. isprintable() is false for all white space but the blank.
_RUN = re.compile(r" \s|\s ")


class _ChunkIds(dict):
    """Ids (little-endian uint32 bytes) of a text chunk, worked out once and kept, within a bound.

    A blank between two characters that are not white space always begins a pre-token of
    this vocabulary, so a text that has blanks only there is the sum of its chunks.
    """

    def __init__(self, ranks_file: str, pattern: str):
        super().__init__()
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_file, "rb"))}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        out = np.array(self.encode(chunk), "<u4").tobytes()
        if len(self) >= _KEEP:
            self.clear()
        self[chunk] = out
        return out


_made: dict = {}


def token_bytes(text: str, json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """Ids of the tokenizer file, from the same vocabulary as ranks where that is the same."""
    import public_tokenizers as files

    if ranks_name not in _made:
        _made[ranks_name] = _ChunkIds(files.path(ranks_name), files.PATTERN)
    chunks = _made[ranks_name]
    if "<|" in text:  # special strings are ids of their own only for the tokenizer file
        if json_name not in _made:
            from tokenizers import Tokenizer

            _made[json_name] = Tokenizer.from_file(files.path(json_name))
        return np.array(_made[json_name].encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    if "  " in text or text.endswith(" ") or (not text.isprintable() and _RUN.search(text)):
        return np.array(chunks.encode(text), "<u4").tobytes()
    first, *more = text.split(" ")
    return (chunks[first] if first else b"") + b"".join([chunks[" " + w] if "\n" not in w and "\t" not in w else np.array(chunks.encode(" " + w), "<u4").tobytes() for w in more])


def pieces(docs: DataFrame, width: int = WIDTH, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (, ids as bytes): one row per piece."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = (token_bytes(text) if text else b"") + tail
                    n = len(ids) // 4
                    for s in range(0, n, width):
                        cut = ids[4 * s : 4 * (s + width)]
                        rows.append((doc_id, s, len(cut) // 4, zlib.crc32(cut), n, cut if keep_ids else None))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 5 + keep_ids], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + keep_ids])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def class_tops(width: int, fine: int = 256) -> np.ndarray:
    """The longest length of each class."""
    tops, at, step = [], 0, 1
    while at < width:
        while step * fine <= at:
            step *= 2
        at = min(at + step, width)
        tops.append(at)
    return np.array(tops)


def _knapsack(sizes: np.ndarray, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c], last[c]: the most value of pieces that fit c, and the last one taken (-1: none)."""
    best, last = np.zeros(width + 1), np.full(width + 1, -1)
    use = np.flatnonzero(values > 1e-12)
    s, v = sizes[use], values[use]
    order = np.argsort(s)
    s, v, use = s[order], v[order], use[order]
    fits = np.searchsorted(s, np.arange(width + 1), "right").tolist()
    for c in range(1, width + 1):
        k = fits[c]
        best[c] = best[c - 1]
        if k:
            t = best[c - s[:k]] + v[:k]
            j = int(t.argmax())
            if t[j] > best[c] + 1e-12:
                best[c], last[c] = t[j], use[j]
    return best, last


def _pattern(sizes: list[int], steps: list[tuple[int, int]], c: int) -> dict[int, int]:
    """The pieces of the best fill of c. steps: rows of ``_steps``."""
    out: dict[int, int] = {}
    while c > 0:
        j, c = steps[c]
        if j < 0:
            break
        out[j] = out.get(j, 0) + 1
        c -= sizes[j]
    return out


def _steps(last: np.ndarray) -> list[tuple[int, int]]:
    """(class, width) by width: the largest width not above it at which the best fill takes a class; (-1, 0) where none does."""
    at = np.maximum.accumulate(np.where(last >= 0, np.arange(len(last)), 0))
    return list(zip(last[at].tolist(), at.tolist(), strict=True))


def _inverse(columns: list[dict[int, int]], m: int) -> np.ndarray:
    """Inverse of the matrix whose columns are patterns, by Gauss-Jordan steps on the rows and columns that are not zero.

    Array operations only, no BLAS: it takes no threads of its own beside Spark's, and the
    result does not hang on their number.
    """
    a, inverse = np.zeros((m, m)), np.eye(m)
    for r, p in enumerate(columns):
        a[list(p), r] = list(p.values())
    for r in range(m):
        k = r + int(np.abs(a[r:, r]).argmax())
        if k != r:
            a[[r, k]], inverse[[r, k]] = a[[k, r]], inverse[[k, r]]
        pivot = a[r, r]  # never small for a basis
        a[r] /= pivot
        inverse[r] /= pivot
        rows = np.flatnonzero(a[:, r])
        rows = rows[rows != r]
        for x in (inverse, a):
            cols = np.flatnonzero(x[r])
            x[np.ix_(rows, cols)] -= a[rows, r][:, None] * x[r, cols]
    return inverse


def _start(sizes: np.ndarray, demand: np.ndarray, width: int) -> tuple[list[dict[int, int]], np.ndarray]:
    """A first basis: patterns that fill up with the longest pieces, and how often each is used.

    A pattern is used, in fractions too, until one of its classes is used up; no later one
    holds that class, so the basis is triangular.
    """
    left, live = demand.astype(float), np.ones(len(sizes), bool)
    basis, times = [], []
    while live.any():
        room, items = width, {}
        while True:
            fit = np.flatnonzero(live & (sizes <= room) & (left >= 1))
            if not len(fit):
                fit = np.flatnonzero(live & (sizes <= room)) if not items else fit
            if not len(fit):
                break
            j = int(fit[-1])
            items[j] = int(max(1, min(room // sizes[j], left[j])))
            room -= items[j] * int(sizes[j])
            live[j] = False
        for j in items:
            live[j] = True
        k, j = min((left[j] / c, j) for j, c in items.items())
        for i, c in items.items():
            left[i] = max(left[i] - k * c, 0.0)
        left[j], live[j] = 0.0, False
        basis.append(items)
        times.append(k)
    return basis, np.array(times)


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, width: int, rounds: int = 40, gap: float = 1e-5) -> list[tuple[dict[int, int], float]]:
    """Patterns and their LP counts by the revised simplex method with knapsack pricing.

    One run of the knapsack gives, for each class, the best pattern that holds it; those
    that still pay enter the basis one after the other before prices are made anew. It ends
    when no pattern pays, or the value is within ``gap`` of the bound by prices.
    """
    m = len(sizes)
    basis, x = _start(sizes, demand, width)
    inverse = _inverse(basis, m)
    price = inverse.sum(axis=0)
    bound = float((sizes * demand).sum()) / width  # no cover has fewer sequences
    whole_sizes = sizes.tolist()

    def enter(new: dict[int, int]) -> bool:
        """One pivot, if the pattern pays at the prices of the basis as it is."""
        nonlocal price
        at, many = list(new), np.array(list(new.values()), float)
        if (price[at] * many).sum() <= 1 + 1e-6:
            return False
        d = (inverse[:, at] * many).sum(axis=1)
        up = d > 1e-7
        ratio = np.full(m, np.inf)
        ratio[up] = np.maximum(x[up], 0) / d[up]
        least = ratio.min()
        r = int(np.where(ratio <= least + 1e-9 * (1 + least), d, 0).argmax())  # of equal steps the largest pivot
        if d[r] < 1e-6:
            return False
        step = ratio[r]
        x[:] -= step * d
        x[r] = step
        basis[r] = new
        row = inverse[r] / d[r]
        rows = np.flatnonzero(d)
        if 2 * len(rows) < m:
            inverse[rows] -= d[rows, None] * row
        else:
            np.subtract(inverse, d[:, None] * row, out=inverse)
        inverse[r] = row
        price = price - (d.sum() - 1) * row
        return True

    # Whole patterns that fill up from the longest piece down are columns from the start.
    ready = [dict(items) for _, items in _greedy(sizes, demand.astype(np.int64), width)]
    longest = max((len(p) for p in ready), default=1)
    places, many = np.zeros((len(ready), longest), np.int64), np.zeros((len(ready), longest))
    for i, p in enumerate(ready):
        places[i, : len(p)], many[i, : len(p)] = list(p), list(p.values())
    for _ in range(2 * m):
        worth = (price[places] * many).sum(axis=1)
        if not len(ready) or worth.max() <= 1 + 1e-6 or not enter(ready[int(worth.argmax())]):
            break
    for turn in range(rounds):
        if turn % 10 == 9:
            inverse = _inverse(basis, m)
            x[:] = np.maximum((inverse * demand).sum(axis=1), 0)
        price = inverse.sum(axis=0)
        best, last = _knapsack(sizes, price, width)
        bound = max(bound, float((np.maximum(price, 0) * demand).sum()) / max(best[width], 1.0))
        if best[width] <= 1 + 1e-6 or x.sum() <= (1 + gap) * bound:
            break
        steps, worth, entered = _steps(last), price + best[width - sizes], False
        for j in np.argsort(-worth, kind="stable").tolist():
            if worth[j] <= 1 + 1e-6:
                break
            new = _pattern(whole_sizes, steps, width - whole_sizes[j])
            new[j] = new.get(j, 0) + 1
            entered |= enter(new)
        if not entered:
            break
    return [(p, float(max(v, 0))) for p, v in zip(basis, x, strict=True)]


def plan(histogram: dict[int, int], width: int = WIDTH) -> tuple[np.ndarray, list[tuple[int, list[tuple[int, int]]]]]:
    """(class tops, [(sequences, [(class, pieces)])]) that hold the histogram of lengths.

    The LP's counts are rounded down; what is left of the histogram is solved and rounded
    again as long as that places something, and the last pieces are filled in from the longest down.
    """
    tops = class_tops(width)
    left = np.zeros(len(tops), np.int64)
    for length, n in histogram.items():
        left[np.searchsorted(tops, length)] += n
    rounded, placed = [], 1
    while placed and left.any():
        have, placed = np.flatnonzero(left), 0
        for p, v in sorted(solve_patterns(tops[have], left[have].astype(float), width), key=lambda t: -t[1]):
            k = int(v + 1e-6)
            for j, c in p.items():
                k = min(k, int(left[have[j]] // c))
            if k:
                items = sorted(((int(have[j]), c) for j, c in p.items()), reverse=True)
                rounded.append((k, items))
                for j, c in items:
                    left[j] -= k * c
                placed += k
        if placed < 8:
            break
    return tops, rounded + _greedy(tops, left, width)


def _greedy(tops: np.ndarray, left: np.ndarray, width: int) -> list:
    """Fill sequences with the longest that fits; a pattern is used as often as counts allow."""
    out = []
    while left.any():
        room, items, rest = width, {}, left.copy()
        while room:
            fit = np.flatnonzero((rest > 0) & (tops <= room))
            if not len(fit):
                break
            j = int(fit[-1])
            k = int(min(rest[j], room // tops[j]))
            items[j] = items.get(j, 0) + k
            rest[j] -= k
            room -= k * int(tops[j])
        k = min(int(left[j] // c) for j, c in items.items())
        out.append((k, sorted(items.items(), reverse=True)))
        for j, c in items.items():
            left[j] -= k * c
    return out


def packed(docs: DataFrame, width: int = WIDTH, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: those of ``pieces`` and sequence_id, offset, padded_length."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, width, end_id, keep_ids))
    histogram = {int(r["length"]): int(r["count"]) for r in cut.groupBy("length").count().collect()}  # at most width rows
    total = sum(histogram.values())
    tops, patterns = plan(histogram, width)

    places, sequence, taken = [], 0, np.zeros(len(tops), np.int64)
    for many, items in patterns:
        slot = 0
        for j, c in items:
            places.append((j, int(taken[j]), int(taken[j] + many * c), c, sequence, slot))
            taken[j] += many * c
            slot += c
        sequence += many
    where = spark.createDataFrame(places or [(0, 0, 0, 1, 0, 0)], "class int, lo long, hi long, per int, first_sequence long, first_slot int")
    classes = spark.createDataFrame([(length, int(np.searchsorted(tops, length))) for length in histogram] or [(1, 0)], "length long, class int")

    # Ranks within a class: counts by class and salt, running sums of those, row numbers within.
    salts = max(64, min(4096, total // 5_000))
    salted = cut.join(F.broadcast(classes), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("class", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).drop("n")
    own = Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32")
    slim = salted.select("class", "salt", "doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids)
    ranked = slim.withColumn("k", F.row_number().over(own) - 1).join(before, ["class", "salt"]).withColumn("rank", F.col("before") + F.col("k"))

    # Places of a class by ranges of rank; the table has as many rows as the patterns have classes.
    at = ranked.join(F.broadcast(where), (ranked["class"] == where["class"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    inside = F.col("rank") - F.col("lo")
    at = at.withColumn("sequence_id", F.col("first_sequence") + F.floor(inside / F.col("per")).cast("long")).withColumn("slot", F.col("first_slot") + inside % F.col("per"))
    line = Window.partitionBy("sequence_id").orderBy("slot")
    at = at.withColumn("offset", F.sum("length").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length"))
    used = F.sum("length").over(Window.partitionBy("sequence_id"))
    power = (used.bitwiseAND(used - 1)) == 0
    at = at.withColumn("padded_length", F.when(power, used).otherwise(F.lit(width)).cast("long"))
    return at.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length", *["ids"] * keep_ids)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
