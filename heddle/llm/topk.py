"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers. Data and queries fall into cells around spread-out centres. A pair of cells is dropped if no
product of their members (by the centres' product, norms and radii) can reach the worst k-th score that a sample
guarantees the cell's queries. What is left meets in units: a block of queries with a share of the data, which streams
through a task in the order of its cells. There the queries get a cover tree, and so does each block of data: a node's
point covers its members within the node's radius, its children cover them within smaller ones, and pairs of nodes are
pruned like pairs of cells, by the scores found so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.base import written

#: Vectors of a data block, most queries of a unit (on average), rows sampled for centres and first bounds (documented bound), most cells.
BLOCK, QUERIES, SAMPLE, CELLS = 4096, 8192, 4096, 256
#: Data rows of a unit (on average), and queries whose scores a leaf works out at a time.
UNIT_ROWS, _STEP = 1 << 22, 1024
#: Members below which a node has no children, and most children of a node.
LEAF, FAN = 512, 8
#: The factor of components, their largest magnitude, and the score that stands for none.
_SCALE, _MOST, _NONE = 64.0, 2.0**62, np.iinfo(np.int64).min


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, ids, vectors = [], [], []
        for r, i, v in zip(*(batch.column(c).to_pylist() for c in ("row", "vec_id", "v")), strict=True):
            if i is None or v is None or any(x is None for x in v):
                continue
            x = np.array(v, np.float64)
            if np.isfinite(x).all():
                row.append(r)
                ids.append(i)
                vectors.append(np.clip(np.floor(_SCALE * x), -_MOST, _MOST).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], names=["row", "vec_id", "v"])


def _matrix(vectors, width: int) -> np.ndarray:
    """Packed vectors as rows; shorter ones end in zeros."""
    if all(len(v) == 8 * width for v in vectors):
        return np.frombuffer(b"".join(vectors), "<i8").reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v) // 8] = np.frombuffer(v, "<i8")
    return out


def _distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - point) ** 2).sum(-1))


class CoverTree:
    """x in tree order, and nodes (start, end, first child, end of children, radius); a node's point is its first member."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.nodes: list[list] = []
        y = x.astype(np.float64)
        self.nodes.append([0, len(x), 0, 0, float(_distances(y, y[0]).max()) if len(x) else 0.0])
        at = 0
        while at < len(self.nodes):
            start, end, _, _, radius = self.nodes[at]
            if end - start > LEAF and radius > 0:
                self._split(y, at, start, end, radius)
            at += 1
        self.table = np.array(self.nodes, np.float64).reshape(-1, 5)

    def _split(self, y: np.ndarray, at: int, start: int, end: int, radius: float) -> None:
        own = self.order[start:end]
        points, child = [0], np.zeros(end - start, np.int64)
        near = _distances(y[own], y[own[0]])
        while len(points) < FAN and near.max() > radius / 2:
            p = int(near.argmax())
            d = _distances(y[own], y[own[p]])
            closer = d < near
            child[closer], near[closer] = len(points), d[closer]
            points.append(p)
        if len(points) == 1:
            return
        rank = np.ones(end - start, np.int64)
        rank[points] = 0
        by = np.lexsort((rank, child))
        self.order[start:end] = own[by]
        sizes = np.bincount(child, minlength=len(points))
        self.nodes[at][2], self.nodes[at][3] = len(self.nodes), len(self.nodes) + len(points)
        for c, n in enumerate(sizes):
            self.nodes.append([start, start + int(n), 0, 0, float(near[child == c].max())])
            start += int(n)


class _Best:
    """The k best (score, id) of each query so far; floor is a score that the k-th best reaches for certain."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k = k
        self.score = np.full((n, k), _NONE)
        self.id = np.zeros((n, k), np.int64)
        self.floor = floor.copy()

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores of candidates ids for queries at; _NONE where a candidate doesn't count."""
        m = scores.shape[1]
        least = self.floor[at]
        if m > self.k:
            least = np.maximum(least, np.partition(scores, m - self.k, axis=1)[:, m - self.k])
        q, c = np.nonzero((scores >= least[:, None]) & (scores > _NONE))
        if not len(q):
            return
        rows = np.unique(q)
        all_q = np.concatenate([np.repeat(rows, self.k), q])
        all_s = np.concatenate([self.score[at[rows]].ravel(), scores[q, c]])
        all_i = np.concatenate([self.id[at[rows]].ravel(), ids[c]])
        order = np.lexsort((all_i, ~all_s, all_q))
        first = np.searchsorted(all_q[order], rows)
        take = order[(first[:, None] + np.arange(self.k)[None, :])]
        self.score[at[rows]], self.id[at[rows]] = all_s[take], all_i[take]
        self.floor[at[rows]] = np.maximum(self.floor[at[rows]], self.score[at[rows], self.k - 1])


class _Group:
    """Vectors in tree order with what pruning needs."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        tree = CoverTree(x)
        self.order, self.table = tree.order, tree.table
        self.x, self.ids, self.rows = x[tree.order], ids[tree.order], rows[tree.order]
        self.y = self.x.astype(np.float64)
        self.most = int(np.abs(x).max()) if x.size else 0
        self.points = self.y[self.table[:, 0].astype(np.int64)] if len(x) else self.y[:0]
        self.norms = np.sqrt((self.points**2).sum(1))


def products(q: np.ndarray, d: np.ndarray, most: int | None = None) -> np.ndarray:
    """Integer inner products as 64-bit integers: in doubles while those are exact, then in 64-bit integers, then in integers of any size, held to the ends of 64 bits."""
    if most is None:
        most = int(np.abs(q).max(initial=0)) * int(np.abs(d).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ d.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return q @ d.T
    exact = q.astype(object) @ d.astype(object).T
    return np.clip(exact, _NONE + 1, 2**63 - 1).astype(np.int64)


def _bound(product: np.ndarray, a_norm: np.ndarray, a_radius: np.ndarray, b_norm: np.ndarray, b_radius: np.ndarray):
    """What no product of members of two balls exceeds, with room for rounding."""
    return product + a_norm * b_radius + b_norm * a_radius + a_radius * b_radius + 1e-6 + 1e-9 * (a_norm + a_radius) * (b_norm + b_radius)


def dual_search(q: _Group, d: _Group, best: _Best) -> None:
    """Adds to best (by query, in tree order) what the data group has."""
    stack = [(0, 0)] if len(q.x) and len(d.x) else []
    most = q.most * d.most * q.x.shape[1]
    while stack:
        a, b = stack.pop()
        qs, qe, qa, qb, qr = q.table[a]
        ds, de, da, db, dr = d.table[b]
        qs, qe, ds, de = int(qs), int(qe), int(ds), int(de)
        least = best.floor[qs:qe].min()
        if least > _NONE + 1 and _bound(q.points[a] @ d.points[b], q.norms[a], qr, d.norms[b], dr) < least:
            continue
        if not qb and not db:
            for at in range(qs, qe, _STEP):
                to = min(qe, at + _STEP)
                scores = (q.y[at:to] @ d.y[ds:de].T).astype(np.int64) if most < 2**53 else products(q.x[at:to], d.x[ds:de], most)
                scores[q.rows[at:to, None] == d.rows[None, ds:de]] = _NONE
                best.add(np.arange(at, to), scores, d.ids[ds:de])
        elif qb and (not db or qr >= dr):
            stack += [(c, b) for c in range(int(qa), int(qb))]
        else:
            kids = np.arange(int(da), int(db))
            stack += [(a, int(c)) for c in kids[np.argsort(d.points[kids] @ q.points[a], kind="stable")]]


class _Unit:
    """One block of queries, and the data that streams past it."""

    def __init__(self, k: int, width: int):
        self.k, self.width, self.queries, self.data, self.held = k, width, [], [], 0
        self.group = None

    def take(self, side: int, rows: np.ndarray, ids: np.ndarray, vectors: list[bytes], floor: np.ndarray) -> None:
        own = (_matrix(vectors, self.width), ids, rows, floor)
        if not side:
            self.queries.append(own)
            return
        self.data.append(own)
        self.held += len(rows)
        if self.held >= BLOCK:
            self.search()

    def search(self) -> None:
        if self.group is None and self.queries:
            x, ids, rows, floor = (np.concatenate(c) for c in zip(*self.queries, strict=True))
            self.group, self.queries = _Group(x, ids, rows), []
            self.best = _Best(len(x), self.k, floor[self.group.order])
        if self.group is not None and self.data:
            x, ids, rows, _ = (np.concatenate(c) for c in zip(*self.data, strict=True))
            for at in range(0, len(x), BLOCK):
                dual_search(self.group, _Group(*(v[at : at + BLOCK] for v in (x, ids, rows))), self.best)
        self.data, self.held = [], 0

    def found(self) -> pa.RecordBatch:
        self.search()
        q, c = np.nonzero(self.best.score > _NONE) if self.group is not None else (np.zeros(0, np.int64),) * 2
        cols = [self.group.rows[q], self.group.ids[q], self.best.id[q, c], self.best.score[q, c]] if len(q) else [q] * 4
        return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in cols], names=["row", "query_id", "vec_id", "score"])


def _searched(k: int, width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, now = None, None
        for batch in batches:
            units, sides, rows, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "side", "row", "vec_id"))
            floor = batch.column("floor").to_numpy(zero_copy_only=False)
            vectors = batch.column("v").to_pylist()
            cut = np.flatnonzero((np.diff(units, prepend=units[:1] - 1) != 0) | (np.diff(sides, prepend=sides[:1] - 1) != 0))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(units)], strict=False):
                if units[a] != now:
                    if unit is not None:
                        yield unit.found()
                    unit, now = _Unit(k, width), units[a]
                unit.take(int(sides[a]), rows[a:b], ids[a:b], vectors[a:b], floor[a:b])
        if unit is not None:
            yield unit.found()

    return work


_CELLED = "row long, vec_id long, v binary, cell int, far double, query_cell int, query_far double, floor long"


def _celled(shared, width: int, query_cells: int, k: int, every: int):
    """Each row with its cell and its distance to the centre; for queries also a query cell and the k-th score among the sampled rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, drawn, drawn_rows = shared.value
        half = (centres**2).sum(1) / 2
        for batch in batches:
            x = _matrix(batch.column("v").to_pylist(), width)
            y, n = x.astype(np.float64), len(x)
            near = y @ centres.T - half
            cell = near.argmax(1) if n else np.zeros(0, np.int64)
            own = near[:, :query_cells].argmax(1) if n else cell
            rows, ids = (batch.column(c).to_numpy() for c in ("row", "vec_id"))
            floor = np.full(n, _NONE)
            asked = np.flatnonzero(ids % every == 0)
            if len(drawn) > k:
                for at in range(0, len(asked), _STEP):
                    part = asked[at : at + _STEP]
                    scores = products(x[part], drawn)
                    scores[rows[part, None] == drawn_rows[None, :]] = _NONE
                    floor[part] = np.partition(scores, len(drawn) - k, axis=1)[:, len(drawn) - k]
            none = ids % every != 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(_distances(y, centres[cell])), pa.array(own.astype(np.int32), mask=none), pa.array(_distances(y, centres[own]), mask=none), pa.array(floor, mask=none)],
                names=["row", "vec_id", "v", "cell", "far", "query_cell", "query_far", "floor"],
            )

    return work


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x, each the farthest from those before."""
    y = x.astype(np.float64)
    chosen, near = [0], _distances(y, y[0])
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(y, y[chosen[-1]]))
    return y[chosen]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by every, the k best other rows.

    Components x become floor(64 * x), those beyond 2**62 in magnitude 2**62; the score is the exact integer inner
    product, held to the ends of 64 bits; ties go to smaller ids. Rows with a null id, a null vector or null or
    non-finite components take no part; shorter vectors end in zeros. Repeated rows are rows of their own: each is a
    candidate for the others. Other columns are ignored. With fewer than k other rows all are returned; an empty table
    gives no rows. The driver holds the sample and at most CELLS * CELLS pairs of cells, never queries or data.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    rows = written(raw.mapInArrow(_packed, "row long, vec_id long, v binary"), "vectors")
    stats = rows.agg(F.count("*").alias("n"), F.max(F.octet_length("v")).alias("w"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    n, width, asked = stats["n"], max(1, (stats["w"] or 0) // 8), stats["q"]
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    share = F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, SAMPLE / n)))
    sample = rows.filter(share).collect() or rows.limit(1).collect()
    drawn, drawn_rows = _matrix([bytes(r["v"]) for r in sample], width), np.array([r["row"] for r in sample], np.int64)
    centres = _spread(drawn, min(CELLS, -(-n // BLOCK)))
    query_cells = min(len(centres), max(1, -(-asked // QUERIES)))
    shared = spark.sparkContext.broadcast((centres, drawn, drawn_rows))
    celled = written(rows.mapInArrow(_celled(shared, width, query_cells, k, every), _CELLED), "cells")
    data = {r["cell"]: r["far"] for r in celled.groupBy("cell").agg(F.max("far").alias("far")).collect()}  # CELLS at most
    own = celled.filter(F.col("query_cell").isNotNull())
    asking = {r["query_cell"]: r for r in own.groupBy("query_cell").agg(F.max("query_far").alias("far"), F.min("floor").alias("floor"), F.count("*").alias("n")).collect()}
    norms, pairs, blocks = np.sqrt((centres**2).sum(1)), [], {}
    for q, r in sorted(asking.items()):
        bounds = sorted(((float(_bound(centres[q] @ centres[c], norms[q], r["far"], norms[c], far)), c) for c, far in data.items()), reverse=True)
        pairs += [(q, c, place) for place, (bound, c) in enumerate(bounds) if r["floor"] <= _NONE + 1 or bound >= r["floor"]]
        blocks[q] = -(-r["n"] // QUERIES)
    first = dict(zip(blocks, np.cumsum([0, *blocks.values()]).tolist(), strict=False))
    total = sum(blocks.values())
    groups = max(1, min(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // total), -(-n // BLOCK)), -(-n // UNIT_ROWS))
    by_cell = lambda of: F.element_at(F.lit([of.get(q, 0) for q in range(query_cells)]), F.col("query_cell") + 1)
    unit = lambda block, group: ((by_cell(first) + block) * groups + group).cast("long").alias("unit")
    columns = ["side", "place", "row", "vec_id", "v", "floor"]
    queries = own.withColumn("block", F.pmod(F.xxhash64("row", F.lit(3)), by_cell(blocks))).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    ).select(unit(F.col("block"), F.col("group")), F.lit(0).alias("side"), F.lit(0).alias("place"), "row", "vec_id", "v", "floor")
    # the pairs of cells are bounded by CELLS * CELLS, so broadcasting them is too
    met = celled.drop("query_cell", "query_far", "floor").join(F.broadcast(spark.createDataFrame(pairs, "query_cell int, cell int, place int")), "cell")
    met = met.select("*", F.explode(F.sequence(F.lit(0), by_cell(blocks) - 1)).alias("block"))
    met = met.select(unit(F.col("block"), F.pmod(F.xxhash64("row", F.lit(5)), F.lit(groups))), F.lit(1).alias("side"), "place", "row", "vec_id", "v", F.lit(_NONE + 1).cast("long").alias("floor"))
    units = queries.unionAll(met).repartition(total * groups, "unit").sortWithinPartitions("unit", "side", "place", "row")
    found = units.select("unit", *columns).mapInArrow(_searched(k, width), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
