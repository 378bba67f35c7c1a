import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from heddle.llm.bpe import encode_documents, tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string, ids string, n_tokens int"
HARD = [
    None, "", " \n", "<|endoftext|>Hi <|startoftext|>  ΣΑΣ İstanbul é <|EndOfText|>", "aaaa!!!!!! ١٢٣ ½ x y\u0085z\x1cq", "日本語テキスト 😀😀", "a" * 5000,
    "i'm we'LL 'tis", "ẛ̣ ﬁ Å \x00 ﻿ \x01\x1f\x7f", "a<|endoftext|>b", "!?" * 3000, "words " * 4000,
]


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def random_texts(n):
    rng = random.Random(7)
    bits = ["the", "ing", "er", "é", "ß", "ñ", " ", " ", "'s", "1", "23", "!", "...", "\n", "日", "X", "aa", "zz", "th", "</w>"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(n)]


def test_ids_and_text_equal_the_library(theirs):
    bpe = tokenizer(PATH)
    for t in [*HARD, *random_texts(3000)]:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        assert bpe.encode(t) == ids, t
        assert bpe.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_every_token_of_the_vocabulary(theirs):
    bpe = tokenizer(PATH)
    words = [t.removesuffix("</w>") for t in theirs.get_vocab()][::3]
    assert [bpe.encode(w) for w in words] == [e.ids for e in theirs.encode_batch(words, add_special_tokens=False)]


def test_as_a_table(spark, theirs):
    docs = [(i % 9, t, "x", 1) for i, t in enumerate([*HARD, *random_texts(40)])] + [(None, "tie", None, None)] * 2
    frame = spark.createDataFrame(docs, DOC)
    want = []
    for i, t, *_ in docs:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        text = theirs.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, encode_documents(frame, PATH, full=False, digests=True).collect()), key=str) == sorted(want, key=str)
    full = encode_documents(frame, PATH).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in full if r.doc_id is not None) == sorted(x[:2] for x in want if x[0] is not None)
    assert encode_documents(frame.limit(0), PATH).collect() == []
