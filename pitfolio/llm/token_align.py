"""Alignment of two tokenizers over the same bytes, and how often their ids meet in the corpus.

A text is tokenized twice: a blank and the text by a byte-level vocabulary (A), the text by a
piece vocabulary (B), which puts the blank in itself. Both cover the same bytes, so what is
compared are the sorted lists of byte offsets at which their tokens end.

*Galloping intersection.* The shorter list drives: each of its ends is looked for in the longer
one from where the last search stopped, in steps that double, and then by binary search in the
last step. The common ends cut both token lists into groups.

*Rank differences.* The ranks of a token's two ends in the other list are the range of tokens
that overlap it; each is a link of two ids.

Neither vocabulary has a token that goes on over a blank between two characters that are no
white space, so both always end there (checked on the pieces when they are loaded): a text
that has blanks only there is cut at them, each different chunk is aligned once and kept,
within a bound, and a text's groups and links are those of its chunks in order. Other texts
are aligned whole.

*Counts.* Links are counted by text first and then by pair over the corpus. A pair that holds
``p_top`` of all links or more goes to all tasks (at most 1 / p_top rows); the rows of other
pairs, already one a text and pair, meet their counts by a join. The best count of each B id
is a maximum by id, with at most the vocabulary's rows.

Nulls: a null or empty text has no tokens, nor has one whose tokens do not give back its bytes
(white space that is normalised, U+2581 in the text). Repeated rows count and are aligned one
by one. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .textwords import slices

_KEEP, _KEEP_LENGTH = 100_000, 64
#: A blank beside other white space; isprintable() is false for all white space but the blank.
_RUN = re.compile(r" \s|\s ")
#: A pair of ids as one number: A's times 2**_SHIFT, plus B's.
_SHIFT = 20


#: Counts of A, B and groups as one number, so that they add up in one sum.
_PART = 40


def common_ends(a, b) -> tuple[list[int], list[int]]:
    """Indices in a and in b of the values that both sorted lists hold; the shorter one drives."""
    if len(a) > len(b):
        j, i = common_ends(b, a)
        return i, j
    mine, theirs, at, last = [], [], 0, len(b)
    b = [*b, math.inf]
    for i, x in enumerate(a):
        if b[at] < x:
            low, high, step = at + 1, at + 1, 1
            while b[high] < x:
                low, high, step = high + 1, min(high + step, last), 2 * step
            at = bisect_left(b, x, low, high)
        if b[at] == x:
            mine.append(i)
            theirs.append(at)
    return mine, theirs


def overlaps(ends_a: list[int], ends_b: list[int], i: int, x: int, j: int, y: int) -> list[tuple[int, int]]:
    """Indices (a, b) of the tokens i to x and j to y of one group whose byte ranges overlap.

    A token's range in the other list goes from the rank of its start to the rank of its end.
    """
    if j == y:
        return [(a, j) for a in range(i, x + 1)]
    out, first = [], j
    for a in range(i, x + 1):
        last = bisect_left(ends_b, ends_a[a], first, y)
        out += [(a, b) for b in range(first, last + 1)]
        first = last  # a group has no common end inside, so this one goes on
    return out


class Aligner:
    """Both tokenizers of one process, and what is known of chunks.

    What is known is kept in two halves: when the new half is full it becomes the old one, and
    chunks found in the old half move to the new. So frequent chunks stay.
    """

    def __init__(self, ranks: str, pattern: str, pieces: str):
        import sentencepiece
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        self.a = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.size_a = np.zeros(max(table.values()) + 1, np.int64)
        for piece, i in table.items():
            self.size_a[i] = len(piece)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.name = [str(i) for i in range(max(len(self.size_a), len(self.size_b)))]
        self.cuts_at_blanks = not any(re.search("[^▁]▁", p) for p in names)
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def aligned(self, texts: list[str], ids_b: list[list[int]]) -> list[tuple | None]:
        """(links as bytes of int64, groups, counts of A, B and groups) of each text with its ids, None if its bytes do not come back.

        The texts lie one behind the other; where one stops both lists have an end.
        """
        bytes_b, encode, out = self.bytes_b, self.a, [None] * len(texts)
        a, b, stops, good = [], [], [], []
        at = 0
        for k, (text, ids) in enumerate(zip(texts, ids_b, strict=True)):
            raw = (" " + text).encode()
            if b"".join([bytes_b[i] for i in ids]) == raw:
                at += len(raw)
                a += encode(" " + text)
                b += ids
                stops.append(at)
                good.append(k)
        if not good:
            return out
        ends_a, ends_b = np.cumsum(self.size_a[a]).tolist(), np.cumsum(self.size_b[b]).tolist()
        if ends_a[-1] != at:
            raise ValueError("the byte-level vocabulary does not give its text back")
        name, groups, links, facts = self.name, [], [], []
        i, j, n, first_a, first_b = 0, 0, 0, 0, 0
        for x, y in zip(*common_ends(ends_a, ends_b), strict=True):
            if i == x and j == y:
                groups.append(name[a[i]] + "|" + name[b[j]])
                links.append((a[i] << _SHIFT) + b[j])
            elif i == x:
                groups.append(name[a[i]] + "|" + ",".join([name[k] for k in b[j : y + 1]]))
                links += [(a[i] << _SHIFT) + k for k in b[j : y + 1]]
            else:
                groups.append(",".join([name[k] for k in a[i : x + 1]]) + "|" + ",".join([name[k] for k in b[j : y + 1]]))
                links += [(a[p] << _SHIFT) + b[q] for p, q in overlaps(ends_a, ends_b, i, x, j, y)]
            i, j = x + 1, y + 1
            if ends_a[x] == stops[n]:
                facts.append((len(links), len(groups), i - first_a + (j - first_b << _PART)))
                n, first_a, first_b = n + 1, i, j
        raw, s, g = np.array(links, np.int64).tobytes(), 0, 0
        for k, (to, end, counts) in zip(good, facts, strict=True):
            out[k] = raw[8 * s : 8 * to], ";".join(groups[g:end]).encode(), counts + (end - g << 2 * _PART)
            s, g = to, end
        return out

    def whole(self, text: str) -> tuple | None:
        return self.aligned([text], [self.b.encode(text)])[0]

    def learn(self, words: set[str]) -> dict[str, tuple | None]:
        """What is not known yet of some chunks; all that is short is kept."""
        found = {}
        for w in words & self.older.keys():
            found[w] = self.known[w] = self.older[w]
        new = list(words - self.older.keys())
        for w, got in zip(new, self.aligned(new, self.b.encode(new, num_threads=1)), strict=True):
            found[w] = got
            if got is not None and len(w) <= _KEEP_LENGTH:
                self.known[w] = got
        return found

    def texts(self, texts: list[str | None]) -> list[tuple | None]:
        """The alignment of each text, None for those without tokens."""
        parts = [
            t.split(" ") if t and self.cuts_at_blanks and not (t[0].isspace() or t[-1] == " " or "  " in t or (not t.isprintable() and _RUN.search(t))) else None
            for t in texts
        ]
        every = set().union(*[p for p in parts if p])
        if len(self.known) >= _KEEP:
            self.known, self.older = {}, self.known
        more = self.learn(every - self.known.keys())
        here = {w: more[w] if w in more else self.known[w] for w in every}
        out = []
        for t, p in zip(texts, parts, strict=True):
            found = [here[w] for w in p] if p else [None]
            if None in found:  # the whole text decides
                out.append(self.whole(t) if t else None)
            elif len(found) == 1:
                out.append(found[0])
            else:
                out.append((b"".join([x[0] for x in found]), b";".join([x[1] for x in found]), sum([x[2] for x in found])))
        return out


_made: dict = {}


def aligner(ranks: str, pieces: str) -> Aligner:
    if (ranks, pieces) not in _made:
        import public_tokenizers

        at = [p if "/" in p else public_tokenizers.path(p) for p in (ranks, pieces)]
        _made[ranks, pieces] = Aligner(at[0], public_tokenizers.PATTERN, at[1])
    return _made[ranks, pieces]


def alignments(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", pieces: str = "piece_bpe_32k.model", keep_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links, times (, groups): one row per row of docs.

    links are the different id pairs of the text (A's id times 2**20, plus B's), times how often each
    occurs. ranks, pieces: names for ``public_tokenizers.path``, or paths; the vocabulary is read as
    ranks, which know no special strings (the tests hold the ids equal to the tokenizer file's).
    """
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times"] + ["groups"] * keep_groups

    def run(batches):
        import pyarrow as pa

        tool = aligner(ranks, pieces)
        kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.string()]
        for part in slices(batches, 512):
            counts, shas, whole, links, times = [], [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            ends = [0]
            for got in tool.texts(part.column("text").to_pylist()):
                if got is None:
                    counts.append((0, 0, 0, 0))
                    shas.append("")
                    whole.append("")
                else:
                    every = np.frombuffer(got[0], np.int64)
                    one = (1 << _PART) - 1
                    counts.append((got[2] & one, got[2] >> _PART & one, got[2] >> 2 * _PART, len(every)))
                    shas.append(hashlib.sha256(got[1]).hexdigest())
                    whole.append(got[1].decode() if keep_groups else "")
                    k, n = np.unique(every, return_counts=True)
                    links.append(k)
                    times.append(n)
                ends.append(ends[-1] + (len(links[-1]) if got is not None else 0))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x).astype(t))) for x, t in ((links, np.int64), (times, np.int32))]
            cols = [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in zip(*counts, strict=True)], pa.array(shas), *lists] + [pa.array(whole)] * keep_groups
            yield pa.RecordBatch.from_arrays([c if c.type == k else c.cast(k) for c, k in zip(cols, kinds, strict=False)], names=names)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>, times array<int>" + ", groups string" * keep_groups
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """link, n, best: how many links of the corpus hold a pair, and whether that is the most of its B id."""
    each = aligned.select(F.explode(F.arrays_zip("links", "times")).alias("x")).select(F.col("x.links").alias("link"), F.col("x.times").alias("t"))
    n = materialize(each.groupBy("link").agg(F.sum("t").alias("n")))
    of_b = F.col("link").bitwiseAND((1 << _SHIFT) - 1)
    most = n.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))  # a row for each B id at most
    return n.join(F.broadcast(most), of_b == F.col("b")).select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def rated(docs: DataFrame, p_top: float = 4e-6, **tokenizers) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (, groups)."""
    row = F.monotonically_increasing_id().alias("row")  # fixed by writing
    texts = materialize(alignments(docs, **tokenizers).select("*", row))
    counts = materialize(pair_counts(texts))
    total = texts.agg(F.coalesce(F.sum("n_links"), F.lit(0))).first()[0]
    often = F.col("n") >= max(1.0, p_top * total)
    each = texts.select("row", F.explode(F.arrays_zip("links", "times")).alias("x")).select("row", F.col("x.links").alias("link"), F.col("x.times").alias("t"))
    worth = [F.sum(F.col("t") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("n_best")]
    top = F.broadcast(counts.where(often))
    sure = each.join(top, "link").groupBy("row").agg(*worth)
    rare = each.join(top, "link", "left_anti").join(counts.where(~often).hint("shuffle_hash"), "link").groupBy("row").agg(*worth)
    both = sure.unionByName(rare).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    facts = [c for c in texts.columns if c not in ("row", "links", "times")]
    return texts.select("row", *facts).join(both, "row", "left").na.fill(0, ["count_sum", "n_best"]).drop("row")


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
