"""Words of texts as 64-bit hashes, a whole Arrow batch at a time with numpy.

A word is ``[^\\x20\\x09-\\x0D]+`` of the text after A-Z is lower-cased; every other
character stays as it is, so the work can be done on the UTF-8 bytes. The hash of a
word is a polynomial over its bytes modulo 2**64 (one cumulative sum gives every
word of the batch), mixed at the end. Two different words share a hash with a chance
of about 2**-63; the operators that use hashes as identities say so.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 16
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept per process."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        n = max(n, _CHUNK)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, b in (("up", _BASE), ("down", inverse)):
            t = np.full(n, b, np.uint64)
            t[0] = 1
            _powers[name] = np.multiply.accumulate(t)
    return _powers["up"], _powers["down"]


def lower_and_space() -> np.ndarray:
    """Byte table: A-Z to a-z, the six blanks to 0, everything else itself."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[[32, 9, 10, 11, 12, 13]] = 0
    return t


_TABLE = lower_and_space()


def word_hashes(data: np.ndarray, offsets: np.ndarray, head: int = 0) -> tuple[np.ndarray, ...]:
    """(hashes, doc): one row per word in order; doc is the index of its text.

    With ``head`` a third array holds the hash of each word's first bytes, 0 for words
    that are not longer.

    ``data`` holds the UTF-8 bytes of all texts, ``offsets`` where each begins, with
    the end of the last. NUL bytes inside a text are read as ordinary word bytes.
    """
    if len(data) == 0:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * bool(head))
    low = _TABLE[data]
    inside = low != 0
    if not inside.all():
        nul = data == 0
        if nul.any():
            inside |= nul
    first = np.zeros(len(data), bool)
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:]
    b = np.flatnonzero(begin)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    e = np.flatnonzero(last) + 1
    up, down = _power_tables(min(len(data), 2 * _CHUNK) + 1)
    out = np.empty(len(b), np.uint64)
    heads = np.zeros(len(b) if head else 0, np.uint64)
    long = e - b > head
    at = 0
    while at < len(b):  # pieces of whole words, so that tables and sums stay small
        lo = b[at]
        to = max(int(np.searchsorted(e, lo + _CHUNK, "right")), at + 1)
        hi = e[to - 1]
        if hi - lo > len(up) - 1:
            up, down = _power_tables(int(hi - lo) + 1)
        s = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((low[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=s[1:])
        out[at:to] = (s[e[at:to] - lo] - s[b[at:to] - lo]) * down[b[at:to] - lo]
        if head:
            x = b[at:to][long[at:to]] - lo
            heads[at:to][long[at:to]] = mix((s[x + head] - s[x]) * down[x] + np.uint64(1))
        at = to
    doc = np.searchsorted(offsets, b, "right") - 1
    return (mix(out), doc, heads) if head else (mix(out), doc)


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without copying; nulls count as empty."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, buf = column.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(batches, most_rows: int = 1 << 30, most_bytes: int = 1 << 21):
    """Parts of batches with a text column: about so many bytes of text and rows at most, or one row.

    Arrays over a part's bytes and words stay small, however long the texts of a batch are.
    """
    for b in batches:
        if b.num_rows:
            _, offsets = arrow_bytes(b.column("text"))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, min(int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1, at + most_rows))
                yield b.slice(at, to - at)
                at = to


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc): distinct k-word shingles, by doc and then hash.

    A text of fewer words gives its whole sequence as one shingle, a text without
    words none.
    """
    count = np.bincount(doc, minlength=n_docs)
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(hashes) >= k:
        m = len(hashes) - k + 1
        whole = doc[:m] == doc[k - 1 :]
        h = np.zeros(m, np.uint64)
        for i in range(k):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + m])
        h, d = h[whole], doc[:m][whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            more = count[short] > i
            extra[more] = mix(extra[more] * np.uint64(0xD6E8FEB86659FD93) + hashes[start[short[more]] + i])
        h, d = np.concatenate([h, mix(extra + np.uint64(7))]), np.concatenate([d, short])
    if len(short):
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    ends = np.cumsum(np.bincount(d, minlength=n_docs))
    at = 0
    for end in ends:
        if end - at > 1:
            h[at:end].sort()
        at = end
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
    return h, d
