import math

import numpy as np
import pytest

from heddle.llm import topk as T

VEC = "vec_id long, embedding array<float>, row int, score string"


def brute(rows, k=20):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j) for b, (j, w) in enumerate(ok) if b != a)
            out += [(i, r + 1, j, -p) for r, (p, j) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, n in (("BLOCK", 60), ("QUERIES", 7), ("SAMPLE", 90), ("LEAF", 5), ("FAN", 4)):
            monkeypatch.setattr(T, name, n)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    rows = [(int(i), (centres[i % 6] + 0.2 * rng.normal(size=16)).tolist(), 1, "x") for i in rng.permutation(500)]
    rows += [(i, [0.5] * 16, None, None) for i in range(600, 700)] + [rows[3], rows[3]] + [(20, [0.5] * 16, 1, "")] * 2
    rows += [(40, None, 1, ""), (60, [None] * 16, 1, ""), (80, [math.nan] * 16, 1, ""), (100, [math.inf] + [0.0] * 15, 1, ""), (None, [1.0] * 16, 1, ""), (120, [1.0, -1.0], 1, ""), (140, [], 1, "")]
    out = T.top_k(spark.createDataFrame(rows, VEC)).collect()
    assert sorted(map(tuple, out)) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(i, [float(i), 1.0], 0, "") for i in range(5)]
    assert sorted(map(tuple, T.top_k(spark.createDataFrame(rows, VEC)).collect())) == brute(rows)
    assert T.top_k(spark.createDataFrame(rows[1:], VEC)).collect() == []
    assert T.top_k(spark.createDataFrame([], VEC)).collect() == []


def test_large_components_stay_exact(spark):
    rows = [(i, [1e6 + i * 7.0, -1e6 + i]) for i in range(60)]
    out = T.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, out)) == brute(rows)


@pytest.mark.parametrize("scale", [3e6, 6e6])
def test_scores_beyond_doubles_are_exact(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in scale * rng.normal(size=4)]) for i in range(90)]
    out = T.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    expected = brute(rows)
    assert max(abs(s) for *_, s in expected) > 2**53
    assert sorted(map(tuple, out)) == expected


def test_products_of_any_size():
    big = np.array([[2**40, 3], [-(2**62), 2**62], [5, -7]], np.int64)
    exact = [[int(a) * int(c) + int(b) * int(d) for c, d in big.tolist()] for a, b in big.tolist()]
    held = [[max(-(2**63) + 1, min(2**63 - 1, s)) for s in row] for row in exact]
    assert T.products(big, big).tolist() == held
    small = np.array([[2**30, 1]], np.int64)
    assert T.products(small, small).tolist() == [[2**60 + 1]]


def test_components_that_no_integer_holds(spark):
    rows = [(i, [1e30 * (1 if i % 2 else -1), 1.0]) for i in range(41)]
    out = T.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(out)] == [
        (q, k + 1, i, 2**63 - 1) for q in (0, 20, 40) for k, i in enumerate([x for x in range(0, 41, 2) if x != q][:3])
    ]
