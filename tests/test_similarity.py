import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from heddle.operators.similarity import _compared, scored_pairs, similar_between, similar_pairs

VEC = "key long, embedding array<float>, x int, u string"


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or any(x is None or not math.isfinite(x) for x in [*a, *b]):
        return 0.0
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0


def rows(seed, n, width, clusters=None, spread=0.1):
    rng = random.Random(seed)
    point = lambda: [rng.gauss(0, 1) for _ in range(width)]
    centres = [point() for _ in range(clusters)] if clusters else None
    own = [[x + rng.gauss(0, spread) for x in rng.choice(centres)] if clusters else point() for _ in range(n)]
    return [(i, [float(f"{x:.4f}") for x in v], 0, "u") for i, v in enumerate(own)]


def pairs(df):
    out = [(r.a, r.b) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize(("data", "floor"), [(rows(1, 150, 4), 0.85), (rows(2, 150, 16), 0.4), (rows(3, 150, 8, 5), 0.97), (rows(4, 60, 3), 0.99)])
def test_pairs_equal_the_full_product(spark, data, floor):
    df = spark.createDataFrame(data, VEC).repartition(3)
    want = {(a[0], b[0]) for a in data for b in data if a[0] < b[0] and cosine(a[1], b[1]) >= floor}
    assert want and pairs(similar_pairs(df, floor)) == want and pairs(similar_pairs(df, floor, block=16)) == want
    left, right = data[::2], data[1::3]
    want = {(a[0], b[0]) for a in left for b in right if cosine(a[1], b[1]) >= floor}
    assert pairs(similar_between(spark.createDataFrame(left, VEC), spark.createDataFrame(right, VEC), floor, block=16)) == want
    r = similar_pairs(df, floor).first()
    assert abs(r.similarity - cosine(data[r.a][1], data[r.b][1])) < 1e-6


def test_vectors_that_are_similar_to_nothing(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0], 0, ""), (2, [2.0, 0.0], 0, ""), (3, None, 0, ""), (4, [], 0, ""), (5, [0.0, 0.0], 0, ""), (6, [nan, 1.0], 0, ""), (7, [inf, 0.0], 0, ""), (8, [1.0, None], 0, ""), (9, [1.0], 0, ""), (10, [1.0, 0.0, 0.0], 0, "")]
    df = spark.createDataFrame(data, VEC)
    assert pairs(similar_pairs(df, 0.5)) == {(1, 2)}
    assert similar_pairs(df.limit(0)).count() == 0 and similar_between(df, df.limit(0)).count() == 0
    keyed = df.withColumn("key", df.key.cast("string"))
    assert pairs(similar_pairs(keyed, 0.5)) == {("1", "2")}
    with pytest.raises(ValueError, match="floor"):
        similar_pairs(df, 0.0)


def test_what_is_scored_of_clustered_and_of_scattered_vectors(spark):
    n = 600
    whole = n * n / 2
    near = scored_pairs(spark.createDataFrame(rows(5, n, 32, 30, 0.02), VEC), 0.97)
    far = scored_pairs(spark.createDataFrame(rows(6, n, 32), VEC), 0.97)
    wide = scored_pairs(spark.createDataFrame(rows(6, n, 32), VEC), 0.5)
    assert near < 0.3 * whole and far < 0.9 * whole and wide <= 2 * whole, (near / whole, far / whole, wide / whole)


def test_similarities_are_those_of_sql_bit_by_bit(spark):
    own = [v for _, v, _, _ in rows(7, 120, 64, 6, 0.7)]
    data = [(i, np.float32(v).tolist()) for i, v in enumerate([*own, *own[:5]])]  # copies too
    got = {(r.a, r.b): r.similarity for r in similar_pairs(spark.createDataFrame(data, "key long, embedding array<float>"), 0.4, block=32).collect()}
    con = duckdb.connect()
    con.execute("create table v (key bigint, e float[])")
    con.executemany("insert into v values (?, ?)", data)
    want = {(a, b): s for a, b, s in con.execute("with w as (select key, e::double[] as e from v) select p.key, q.key, list_cosine_similarity(p.e, q.e) s from w p join w q on p.key < q.key where s >= 0.4").fetchall()}
    assert got == want and len(want) > 500


def test_components_whose_squares_are_too_large_or_too_small(spark):
    own = rows(8, 30, 6)
    data = [(i, [x * 10.0 ** (0, 120, -120)[i % 3] for x in v]) for i, v, _, _ in own]
    got = {(r.a, r.b): r.similarity for r in similar_pairs(spark.createDataFrame(data, "key long, embedding array<double>"), 0.4).collect()}
    want = {(a[0], b[0]): cosine(a[1], b[1]) for a in own for b in own if a[0] < b[0] and cosine(a[1], b[1]) >= 0.4}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_a_block_that_meets_itself_in_another_order_gives_each_pair_once():
    own = [(i, v) for i, v, _, _ in rows(9, 40, 8, 3)]
    side = lambda data: pa.table({"key": [i for i, _ in data], "size": pa.array([8] * len(data), pa.int32()), "v": [v for _, v in data]})
    compare = _compared(0.9, math.acos(0.9) + 1e-6, np.eye(8)[:2], True, False)
    got = compare((pa.scalar("1,1,0;1,1,0"),), side(own), side(own[::-1])).to_pylist()
    want = sorted((a[0], b[0]) for a in own for b in own if a[0] < b[0] and cosine(a[1], b[1]) >= 0.9)
    assert want and sorted((r["a"], r["b"]) for r in got) == want
    apart = compare((pa.scalar("1,1,0;1,1,1"),), side(own[:20]), side(own[20:])).to_pylist()
    assert sorted((r["a"], r["b"]) for r in apart) == [(a, b) for a, b in want if a < 20 <= b]
