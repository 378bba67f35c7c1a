import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from heddle.llm.spelling import blocks, near_words, variants, words

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, word string, n string"


def near(u, v):
    """Whether one inserted, deleted or replaced code point makes v of u."""
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(v) - len(u) == 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def counted(docs):
    n = Counter()
    for i, text, *_ in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute(n):
    form, out = {}, []
    beside = {w: [v for v in n if near(w, v)] for w in n}
    for w in n:
        best = min(beside[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(beside[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def made(seed, letters, count):
    """Documents of words of which many are an edit apart."""
    rng = random.Random(seed)
    base = ["".join(rng.choices(letters, k=rng.randint(4, 9))) for _ in range(count)]
    for w in base[:]:
        at = rng.randrange(len(w) + 1)
        base.append(w[:at] + rng.choice(letters) + w[at + rng.randint(0, 1) :])
    docs = [(i % 50, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(base, k=80, weights=[1 / (k % 40 + 1) for k in range(len(base))])), "x", "y") for i in range(60)]
    return docs + [(None, "thandea thandea thande1thande", None, None), (7, None, None, None), (8, "", "", ""), (9, "é" * 3000 + " " + "é" * 3001, "", "")] * 3


def test_against_brute_force(spark):
    for seed, letters, count in ((1, "abé", 150), (2, "abcdefghijklmnopqrstuvwxyz×ÿ", 120)):
        docs = made(seed, letters, count)
        own = counted(docs)
        df = spark.createDataFrame(docs, DOC)
        assert {r.word: r.n for r in words(df).collect()} == own
        assert sorted(map(tuple, variants(df).collect()), key=str) == brute(own)


def test_chains_reach_the_last_form(spark):
    chain = ["abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl", "abcdefghijklm"]
    n = {w: 3 * 2**k for k, w in enumerate(chain)}
    docs = [(k, " ".join([w] * n[w]), "", "") for k, w in enumerate(chain)]
    n = counted(docs)
    got = sorted(map(tuple, variants(spark.createDataFrame(docs, DOC)).collect()), key=str)
    assert got == brute(n)
    assert {r[2] for r in got} == {chain[-1]}


def test_large_blocks_are_subdivided_on_spark(spark):
    rng = random.Random(4)
    own = {"abcde" + "".join(rng.choices("xyz", k=rng.randint(1, 5))): 1 for _ in range(500)} | {"".join(rng.choices("pq", k=rng.randint(5, 7))) + "vwxyz": 1 for _ in range(200)}
    own = {w: rng.randint(3, 40) for w in own}
    df = spark.createDataFrame(list(own.items()), "word string, n long")
    parts = blocks(df, 8)
    assert len(parts) > 2
    for part in parts:
        rows = part.groupBy("m", "a", "b", "key").agg(F.count("*").alias("k")).filter("k > 8 and m - a - b > 1")
        assert rows.count() == 0
    got = {r.word: (r.n_near, r.best_n, r.best) for r in near_words(df, 8).collect()}
    want = {}
    for w in own:
        beside = [v for v in own if near(w, v)]
        if beside:
            best = min(beside, key=lambda v: (-own[v], v))
            want[w] = (len(beside), own[best], best)
    assert got == want


def test_empty_table_and_string_ids(spark):
    df = spark.createDataFrame([("a", "hello hello hello hellos hellos hellos")], "doc_id string, text string")
    assert variants(df.limit(0)).count() == 0
    assert sorted(r.word for r in variants(df).collect()) == sorted(counted([("a", "hello hello hello hellos hellos hellos")]))
