import hashlib
import random
import re

import pytest

from heddle.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC, ITEM = "doc_id long, text string, items string", "item_id long, text string, n_words int"


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items):
    windows = {}
    for i, t, *_ in items:
        w = words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add("null" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[x]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs, items):
    rows = D.decontaminate(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows), key=str)


def case(seed):
    rng = random.Random(seed)
    vocab = ["ab", "CD", "é", "x9", "über", "q"] + [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 3, 9, 10, 11, 25, 60]))), 1) for i in range(12)]
    items += [(3, items[6][1], 1), (None, "lone words here", None), (50, None, None), (51, "", None)]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocab, k=rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            w = words(items[rng.randrange(12)][1])
            a = rng.randint(0, len(w))
            parts += [" ".join(w[a : a + rng.randint(5, 40)]), rng.choice(["", ". ", " zz "]) + " ".join(rng.choices(vocab, k=rng.randint(0, 9)))]
        docs.append((i % 50, ", ".join(parts), "x"))
    return [*docs, (None, None, None), (7, "", None), (8, "lone words HERE", None), (9, " ".join(rng.choices(vocab, k=20000)), None)], items


@pytest.mark.parametrize("blocks", [False, True])
def test_against_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(D, "BLOCK_WORDS", 60)
    docs, items = case(3)
    assert run(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("blocks", [False, True])
def test_filter_keeps_columns_of_any_name(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(D, "BLOCK_WORDS", 60)
    docs, items = case(6)
    frame = spark.createDataFrame([(*d, k, "x") for k, d in enumerate(docs)], "doc_id long, text string, items string, __row long, row string")
    out = D.without_contaminated(frame, spark.createDataFrame(items, ITEM))
    assert out.columns == frame.columns
    assert sorted(r["__row"] for r in out.collect()) == [k for k, d in enumerate(docs) if not brute([d], items)[0][2]]
    assert D.without_contaminated(frame.limit(0), spark.createDataFrame(items, ITEM)).collect() == []
    assert D.without_contaminated(frame, spark.createDataFrame([], ITEM)).count() == len(docs)


def test_empty_tables(spark):
    docs, items = case(4)
    assert run(spark, [], items) == []
    assert run(spark, docs[:5], []) == brute(docs[:5], [])


def test_long_item_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE_WORDS", 7)
    docs, items = case(5)
    assert run(spark, docs, items) == brute(docs, items)
