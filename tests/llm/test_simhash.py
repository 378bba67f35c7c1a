import random
import re

import numpy as np
import pytest
import xxhash

from heddle.llm import simhash as S
from heddle.llm.components import components

DOC = "doc_id long, text string, fingerprint int, root string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows):
    fps = [plain(t) for _, t, *_ in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                comp[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1024, 4])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    rng = random.Random(1)
    vocab = [f"W{i}é" for i in range(300)]
    rows = []
    for i in range(30):
        base = rng.choices(vocab, k=rng.choice([1, 2, 3, 40, 200, 400]))
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((rng.randrange(500), rng.choice([" ", "\n", "\t "]).join(w), 1, "x"))
    rows += [(None, None, None, None), (900, "", None, None), (3, " \n", None, None), (None, "alone here", 1, "x"), (901, "big " * 70000, 1, "x")]
    rows += [rows[0]] * 40
    out = S.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows)


def test_links_connect_all_that_is_close(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(30):
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                c = c ^ np.uint64(1 << int(b))  # noqa: PLW2901
            fps.add(int(c))
    fps = sorted(fps)
    rows = [(int(np.uint64(x).astype(np.int64)),) for x in fps]
    links = S.linked_fingerprints(spark.createDataFrame(rows, "__fp long"))
    got = {}
    for r in components(links).collect():
        got[r.node] = r.root
    group = {x[0]: got.get(x[0], x[0]) for x in rows}
    for r in links.collect():
        assert ((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 200
    arr = np.array(fps, np.uint64)
    for i, x in enumerate(arr):
        close = np.flatnonzero(np.bitwise_count(arr ^ x) <= 3)
        assert len({group[rows[j][0]] for j in close}) == 1, i


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(1, 201)}, **{i: 1000 for i in range(1001, 1100)}}


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], DOC)).collect() == []
