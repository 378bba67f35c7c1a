import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from heddle.llm import alignment
from heddle.llm.alignment import aligned

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id long, text string, n long, block string, key string"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def encoded(libraries, text):
    """[(id, bytes)] of both, or nothing."""
    if not text:
        return [], []
    a, b = libraries
    one = a.encode(" " + text, add_special_tokens=False).ids
    chars = alignment._byte_chars()
    one = [(i, bytes(chars.index(c) for c in a.id_to_token(i))) for i in one]
    other = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    want = (" " + text).encode()
    return (one, other) if all(b"".join(t for _, t in x) == want for x in (one, other)) else ([], [])


def spans(tokens):
    at, out = 0, []
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(libraries, texts):
    per, total = [], Counter()
    for text in texts:
        a, b = (spans(x) for x in encoded(libraries, text))
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        total.update(links)
        per.append((a, b, links))
    highest = {}
    for (_, j), n in total.items():
        highest[j] = max(n, highest.get(j, 0))
    out = []
    for a, b, links in per:
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, at = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in x if at <= s and e <= cut) for x in (a, b)))
            at = cut
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(cuts), len(links), sum(total[x] == highest[x[1]] for x in links), sum(total[x] for x in links), sha))
    return out, total


def texts():
    rng = random.Random(3)
    bits = ["the", "The", " ", "  ", "\n", "\t", "é", "naïve", "ﬁ", "中文", "😀", "<|endoftext|>", "<s>", "<unk>", "▁", "don't", "12345", "...", "a;\r\n", "\r", "}\r x", "\u2003", "\x85", "\xa0", "\x1c", "\x1f", "\u00ad", "²½", "ªº", "’s", "'ll", "ſ", "ß", "ѝ", "ΐ", "\u0483", "tion", "thandea", "́"]
    out = [None, "", " ", "a", "a", "a ", " a", "\x00", "▁x", "é", "x" * 500]
    return out + ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(150)] + [" ".join(rng.choices(bits[:1] + bits[7:10], k=30)) for _ in range(20)]


def test_all_columns_against_brute_force(spark, libraries):
    own = texts()
    want, total = brute(libraries, own)
    rows = [(None if i == 4 else i % 70, t, 1, "b", "k") for i, t in enumerate(own)]
    found, pairs = aligned(spark.createDataFrame(rows, DOC).repartition(3), A, B, block=1500)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=str)
    assert {(r.a_id, r.b_id): r.n for r in pairs.collect()} == dict(total)


def test_segments_are_encoded_as_in_the_whole_text(libraries):
    both = alignment.Pair(A, B)
    assert both.cuttable
    for text in texts():
        a, b = encoded(libraries, text)
        segments = both.segments(text) if text else []
        assert "".join(segments) == (" " + text if text else "")
        ids, sizes, bad = both.encode_segments(segments)
        if a:
            assert not bad.any(), text
        if not bad.any():
            assert [x.tolist() for x in ids] == [[i for i, _ in a], [i for i, _ in b]] and [int(n.sum()) for n in sizes] == [len(a), len(b)], text
            for k, table in enumerate((both.bytes_a, both.bytes_b)):
                ends = [0, *sizes[k].cumsum().tolist()]
                assert ["".join(s) for s in segments] == [b"".join(table[i] for i in ids[k][x:y]).decode() for x, y in zip(ends, ends[1:], strict=False)]


def test_texts_that_cannot_be_cut_are_encoded_whole(spark, libraries, monkeypatch):
    both = alignment.Pair(A, B)
    monkeypatch.setattr(both, "cuttable", False)
    for text in texts()[8:20]:
        assert both.segments(text) == [" " + text]
    none = lambda own: ([[], []], [np.zeros(len(own), np.int64)] * 2, np.ones(len(own), bool))
    monkeypatch.setattr(both, "encode_segments", none)
    row = alignment._block(both, ["one text", None], [np.array([0, 1], np.uint32), np.zeros(0, np.uint32)], {" one": 0, " text": 1})
    own = alignment._Segments(both, dict(zip(("n", "segments", "na", "nb", "a", "b"), (c[0].as_py() for c in row), strict=True)))
    assert row[0][0].as_py() == [1, 0] and own.sequence.tolist() == [2] and own.na.tolist()[:2] == [0, 0]
    assert own.a.tolist() == [i for i, _ in encoded(libraries, "one text")[0]]


def test_empty_tables_and_string_ids(spark):
    docs = spark.createDataFrame([("x", "one text"), (None, None)], "doc_id string, text string")
    found, pairs = aligned(docs, A, B)
    assert {(r.doc_id, r.n_groups > 0) for r in found.collect()} == {("x", True), (None, False)}
    found, pairs = aligned(docs.limit(0), A, B)
    assert found.count() == 0 and pairs.count() == 0


def test_the_fast_way_is_taken_and_equal_to_the_library(libraries):
    both = alignment.Pair(A, B)
    assert both._ranked is not None
    for code in range(0x500):
        for text in (f" a{chr(code)}b", f" {chr(code)}{chr(code)} x", f" 1{chr(code)} {chr(code)}"):
            assert both._ranked(text) == libraries[0].encode(text, add_special_tokens=False).ids, repr(text)
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(chr(rng.randrange(0x500)) if rng.random() < 0.3 else rng.choice("abcdefghi  \n.,'s") for _ in range(60))
        assert both._ranked(text) == libraries[0].encode(text, add_special_tokens=False).ids, repr(text)
