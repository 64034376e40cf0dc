"""The alignment of two tokenizers against its definition, byte by byte."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as files
import pytest

from pitfolio.llm import token_align

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, links int, n int, best boolean"
TEXTS = [
    None, "", " ", "one", "one two", "one two", "The unbelievably long tokenisation, isn't it?", "a  b", " lead", "trail ", "line\nbreak and\ttab", "x \n y", "É" * 300, "naïve 東京 日本語 text 🙂 and 𝔘", "<|endoftext|> <s> </s> <unk> plain",
    "has ▁ in it", "a▁b", "no break", "ﬁne ①", "\u0000 nul", "word " * 3000 + "end", "don't we're I'll 123456789 3.14159", "​zero", "0" * 5000,
]

#: Bytes of the characters of byte-level entries: printable Latin-1 for itself, the others from 256 on.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
CHARS = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PLAIN)}


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=files.path("piece_bpe_32k.model"))


def tokens(tools, text):
    """(id, bytes) of both tokenizers for a text."""
    a, b = tools
    one = [(i, bytes(CHARS[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        two.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and p.endswith(">") else p.replace("▁", " ").encode()))
    return one, two


def brute(tools, rows):
    facts, pairs = [], Counter()
    for i, text in rows:
        one, two = tokens(tools, text) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or any(b"".join(x[1] for x in t) != raw for t in (one, two)):
            facts.append((i, 0, 0, 0, [], ""))
            continue
        owner = lambda t: [k for k, (_, x) in enumerate(t) for _ in x]
        links = sorted(set(zip(owner(one), owner(two), strict=True)))  # bytes that both tokens hold
        ends = [set(np.cumsum([len(x) for _, x in t]).tolist()) for t in (one, two)]
        groups, at = [], [0, 0]
        for end in sorted(ends[0] & ends[1]):
            to = [sum(e <= end for e in np.cumsum([len(x) for _, x in t]).tolist()) for t in (one, two)]
            groups.append("|".join(",".join(str(k) for k, _ in t[p:q]) for t, p, q in zip((one, two), at, to, strict=True)))
            at = to
        ids = [(one[x][0], two[y][0]) for x, y in links]
        pairs.update(ids)
        facts.append((i, len(one), len(two), len(groups), ids, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    return Counter((i, a, b, g, len(ids), sum(pairs[x] == most[x[1]] for x in ids), sum(pairs[x] for x in ids), sha) for i, a, b, g, ids, sha in facts)


def test_rows_equal_brute_force(spark, tools):
    rows = [(None if k == 3 else k - k % 2, t if t is None or len(t) < 3000 else t[:3000]) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 9, 9, 9, True) for i, t in rows], SCHEMA)
    for p_top in (4e-6, 0.02, 2.0):  # all pairs broadcast, some, none
        got = Counter(map(tuple, token_align.rated(docs, p_top=p_top).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()))
        assert got == brute(tools, rows)


def test_chunks_equal_whole_texts(spark):
    tool = token_align.aligner("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
    assert tool.cuts_at_blanks
    r = np.random.default_rng(3)
    alphabet = list("abcdeTHEing'.,-0123é東🙂<|>\n\t ") + [" "] * 8 + [" ", "▁", "the ", "tion", "'s "]
    for _ in range(60):
        texts = ["".join(r.choice(alphabet, int(r.integers(1, 60)))) for _ in range(25)] + [None, ""]
        assert tool.texts(texts) == [tool.whole(t) if t else None for t in texts]
    assert len(tool.known) > 300


def test_frequent_chunks_stay_when_the_cache_is_full(monkeypatch):
    monkeypatch.setattr(token_align, "_KEEP", 4)
    tool = token_align.Aligner(files.path("byte_bpe_50k.tiktoken"), files.PATTERN, files.path("piece_bpe_32k.model"))
    for k in range(20):
        text = f"the word{k} other{k} the"
        assert tool.texts([text]) == [tool.whole(text)]
    assert "the" in tool.known and len(tool.known) + len(tool.older) < 16


def test_long_texts_and_groups(spark):
    docs = spark.createDataFrame([(k, t, "en", "s", 1, 9, 9, 9, True) for k, t in enumerate(TEXTS)], SCHEMA)
    out = token_align.rated(docs, keep_groups=True).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "")
        assert r.n_links == r.n_a + r.n_b - r.n_groups  # a group of p and q tokens has p + q - 1 links
        assert r.groups.count(";") + bool(r.n_a) == r.n_groups


def test_galloping_equals_sets():
    r = np.random.default_rng(1)
    for _ in range(300):
        a, b = (sorted(set(r.integers(0, 80, r.integers(0, 60)).tolist())) for _ in range(2))
        i, j = token_align.common_ends(a, b)
        assert [a[k] for k in i] == [b[k] for k in j] == sorted(set(a) & set(b))


def test_empty_table(spark):
    assert token_align.rated(spark.createDataFrame([], SCHEMA)).count() == 0
