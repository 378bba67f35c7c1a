"""All pairs of vectors whose cosine similarity is a floor or more: exact, many with many.

The angle between vectors is a metric, so two vectors at an angle of t at most have angles to any pivot that differ by t at
most. Vectors are put into cells by ranges of their angles to two pivots, ranges being t wide: a pair within t lies in the
same cell or in neighbouring ones. Cells are cut into blocks of bounded size, and a pair of blocks that may hold a pair meets
in one group; there the angles to further pivots cut the products down, and what is left is multiplied and compared.
In many dimensions angles to a pivot crowd around a right angle, so how much is pruned depends on the data: scored_pairs
tells. Only what can be skipped for certain is skipped.

Cases: vectors that are null, empty, zero, or hold null or non-finite components are similar to nothing; vectors of different
lengths aren't similar; equal vectors under different keys are a pair; keys are unique in a table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from heddle.constants import DUPLICATE_FLOOR

#: Rows of a block; rows of one side that are multiplied at a time.
BLOCK, STEP = 4096, 16
#: Vectors that pivots are chosen among: the first by a hash of their keys.
SAMPLE = 512
#: Pivots: two for cells, the others within blocks.
PIVOTS = 18
#: Ranges of an angle at most, however small the angle of a floor is: cells are the square of it at most.
RANGES = 64
_SLACK = 1e-9


def _units(vectors: DataFrame, key: str, col: str) -> DataFrame:
    """(key, size, v, unit) of the vectors that can be similar to any: v as it is, unit of length 1."""
    own = vectors.select(F.col(key).alias("key"), F.transform(col, lambda x: x.cast("double")).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    own = own.filter((F.size("v") > 0) & fine).withColumn("norm", norm).filter((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    return own.select("key", F.size("v").alias("size"), "v", F.transform("v", lambda x: x / F.col("norm")).alias("unit"))


def pivots(units: DataFrame, count: int = PIVOTS) -> list[list[float]]:
    """Pivots far from each other, of a bounded sample: each is the vector farthest from those before it."""
    rows = units.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("unit").collect()
    if not rows:
        return []
    width = max(len(r["unit"]) for r in rows)
    own = np.array([[*r["unit"], *[0.0] * (width - len(r["unit"]))] for r in rows])
    chosen, far = [0], np.arccos(np.clip(own @ own[0], -1, 1))
    while len(chosen) < count:
        at = int(far.argmax())
        chosen.append(at)
        far = np.minimum(far, np.arccos(np.clip(own @ own[at], -1, 1)))
    return own[chosen].tolist()


def _angle(pivot: list[float]) -> Column:
    """Angle of unit to a pivot; the shorter of both counts as filled up with zeros, which keeps angles a metric."""
    dot = F.aggregate(F.zip_with("unit", F.lit(pivot), lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))


def _dealt(units: DataFrame, at: list[list[float]], width: float) -> DataFrame:
    """(key, size, v) with their cell (x, y)."""
    cell = lambda k: F.floor(_angle(at[k]) / width).cast("int")
    return units.select("key", "size", "v", cell(0).alias("x"), cell(1).alias("y"))


def _blocks(dealt: DataFrame, block: int) -> dict[tuple[int, int], int]:
    """How many blocks each cell is cut into: as many entries as there are cells."""
    return {(r["x"], r["y"]): math.ceil(r["count"] / block) for r in dealt.groupBy("x", "y").count().collect()}


def _sent(dealt: DataFrame, mine: dict, others: dict, left: bool, self_join: bool) -> DataFrame:
    """Each row with its block, once for each pair of blocks (u) that it belongs to as the left or the right one."""
    cells = F.create_map(*[x for c, n in mine.items() for x in (F.lit(c[0] * (1 << 16) + c[1]), F.lit(n))])
    meets = {}
    for x, y in mine:
        near = [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (x + i, y + j) in others]
        if self_join:
            near = [c for c in near if (c >= (x, y) if left else c <= (x, y))]
        meets[x, y] = near
    entry = lambda c: F.struct(F.lit(c[0]).alias("x"), F.lit(c[1]).alias("y"), F.lit(others[c]).alias("n"))
    table = F.create_map(*[v for c, near in meets.items() for v in (F.lit(c[0] * (1 << 16) + c[1]), F.array(*map(entry, near)) if near else F.array().cast("array<struct<x:int,y:int,n:int>>"))])
    code = F.col("x") * (1 << 16) + F.col("y")
    own = dealt.withColumn("block", F.pmod(F.xxhash64("key"), cells[code]).cast("int")).withColumn("other", F.explode(table[code]))
    own = own.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("other.n") - 1)))
    if self_join:
        same = (F.col("other.x") == F.col("x")) & (F.col("other.y") == F.col("y"))
        own = own.filter(~same | ((F.col("b") >= F.col("block")) if left else (F.col("b") <= F.col("block"))))
    here, there = F.concat_ws(",", "x", "y", "block"), F.concat_ws(",", "other.x", "other.y", "b")
    return own.select(F.concat_ws(";", *((here, there) if left else (there, here))).alias("u"), "key", "size", "v")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of a with those of b, summed up from the first component to the last."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _similarities(a: np.ndarray, b: np.ndarray, square_a: np.ndarray, square_b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a with those of b as SQL works them out, bit by bit where components are floats: the product by the root of the product of both squares, from -1 to 1."""
    with np.errstate(over="ignore", under="ignore"):
        squares = square_a * square_b
    fine = np.isfinite(squares) & (squares >= np.finfo(float).tiny)
    out = np.empty(len(a))
    out[fine] = _products(a[fine], b[fine]) / np.sqrt(squares[fine])
    rest = ~fine  # too large or too small to be multiplied, so by unit vectors
    out[rest] = _products(a[rest] / np.sqrt(square_a[rest])[:, None], b[rest] / np.sqrt(square_b[rest])[:, None])
    return np.clip(out, -1, 1)


def _matrix(side: pa.Table, at: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """(vectors filled up to the width of the pivots or more, their squares, sizes, angles to the pivots, keys), those in the same ranges of all angles next to each other."""
    sizes = side.column("size").to_numpy()
    lists = side.column("v").combine_chunks()
    flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    out = np.zeros((len(sizes), max(at.shape[1], int(sizes.max(initial=0)))))
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        out[rows, :size] = flat[starts[rows][:, None] + np.arange(size)]
    squares = _products(out, out)
    z = np.arccos(np.clip(out[:, : at.shape[1]] @ at.T / np.sqrt(squares)[:, None], -1, 1))
    order = np.lexsort(np.floor(z / reach).T)
    return out[order], squares[order], sizes[order], z[order], side.column("key").take(pa.array(order)).to_pylist()


def _compared(floor: float, reach: float, pivots: np.ndarray, self_join: bool, report: bool):
    def compare(unit: tuple[pa.Scalar], left: pa.Table, right: pa.Table) -> pa.Table:
        found, scored = [], 0
        if left.num_rows and right.num_rows:
            (a, square_a, size_a, z_a, key_a), (b, square_b, size_b, z_b, key_b) = _matrix(left, pivots, reach), _matrix(right, pivots, reach)
            width = max(a.shape[1], b.shape[1])
            a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
            unit_a, unit_b = a / np.sqrt(square_a)[:, None], b / np.sqrt(square_b)[:, None]
            for at in range(0, len(a), STEP):
                to = min(len(a), at + STEP)
                low, high = z_a[at:to].min(0) - reach, z_a[at:to].max(0) + reach
                some = np.flatnonzero(((z_b >= low) & (z_b <= high)).all(1))
                scored += (to - at) * len(some)
                if len(some):
                    product = unit_a[at:to] @ unit_b[some].T
                    i, j = np.nonzero((product >= floor - _SLACK) & (size_a[at:to, None] == size_b[None, some]))
                    # once more in SQL's order, so that a pair's value doesn't depend on its neighbours
                    i, j = at + i, some[j]
                    exact = _similarities(a[i], b[j], square_a[i], square_b[j])
                    found += [(key_a[k], key_b[m], s) for k, m, s in zip(i.tolist(), j.tolist(), exact.tolist(), strict=True) if s >= floor]
            if self_join:
                here, there = unit[0].as_py().split(";")
                same = here == there  # a block with itself; both sides' rows can come in different orders
                found = [(min(p, q), max(p, q), s) for p, q, s in found if p != q and (not same or p < q)]
        if report:
            return pa.table({"scored": pa.array([scored], pa.int64())})
        kinds = left.schema.field("key").type, right.schema.field("key").type
        columns = [pa.array([r[k] for r in found], kind) for k, kind in enumerate((*kinds, pa.float64()))]
        return pa.Table.from_arrays(columns, names=["a", "b", "similarity"])

    return compare


def _joined(left: DataFrame, right: DataFrame | None, floor: float, key: str, col: str, block: int, report: bool) -> DataFrame:
    if not 0 < floor <= 1:
        raise ValueError("a floor above 0 and up to 1 is needed")
    self_join = right is None
    mine = _units(left, key, col)
    others = mine if self_join else _units(right, key, col)
    spec = StructType([StructField("a", left.schema[key].dataType), StructField("b", (left if self_join else right).schema[key].dataType), StructField("similarity", DoubleType())])
    spec = StructType.fromDDL("scored long") if report else spec
    at = pivots(mine)
    reach = math.acos(floor) + 1e-6
    width = max(reach, math.pi / RANGES)
    if not at:
        return left.sparkSession.createDataFrame([], spec)
    mine = _dealt(mine, at, width)
    others = mine if self_join else _dealt(others, at, width)
    blocks = _blocks(mine, block)
    theirs = blocks if self_join else _blocks(others, block)
    if not theirs:
        return left.sparkSession.createDataFrame([], spec)
    one, two = _sent(mine, blocks, theirs, True, self_join), _sent(others, theirs, blocks, False, self_join)
    return one.groupBy("u").cogroup(two.groupBy("u")).applyInArrow(_compared(floor, reach, np.array(at[2:]), self_join, report), spec)


def similar_pairs(vectors: DataFrame, floor: float = DUPLICATE_FLOOR, key: str = "key", col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(a, b, similarity) of all pairs of rows, a < b."""
    return _joined(vectors, None, floor, key, col, block, False)


def similar_between(left: DataFrame, right: DataFrame, floor: float = DUPLICATE_FLOOR, key: str = "key", col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(a, b, similarity) of all pairs of a row of left and a row of right."""
    return _joined(left, right, floor, key, col, block, False)


def scored_pairs(vectors: DataFrame, floor: float = DUPLICATE_FLOOR, key: str = "key", col: str = "embedding", block: int = BLOCK) -> int:
    """How many products similar_pairs works out: those of a block with itself count in both directions."""
    return _joined(vectors, None, floor, key, col, block, True).agg(F.coalesce(F.sum("scored"), F.lit(0))).first()[0]
