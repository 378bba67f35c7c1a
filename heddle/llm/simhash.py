"""Near-duplicates by SimHash, with pivot distance tables.

Fingerprints that differ in few bits agree on several blocks of bits; rows are grouped by each choice of agreeing
blocks. Within a group each fingerprint has a table of Hamming distances to many reference fingerprints; two
fingerprints at most r bits apart have distances to each reference that differ by r at most. So a group is sorted by
the distance that spreads most, only neighbours within r are paired, pairs whose largest difference of any coordinate
is larger are discarded, and what survives is verified. A group gives a spanning forest of its links, not
the links; groups are cut into chunks, and pairs of chunks go to different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import minhash
from heddle.llm.base import free_names, mixed, written
from heddle.llm.components import components

#: Words of a shingle, differing bits of a link, references, rows of a chunk.
SHINGLE, BITS, PIVOTS, CHUNK = 3, 3, 16, 1024
_SEED = 42
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Shingles counted at a time.
_STEP = 1 << 15


def pivots(n: int) -> np.ndarray:
    """n reference fingerprints, spread by a rule."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits; bit i is set if it is set in more than half of the shingles' hashes. No words: 0."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        s = starts[at : min(n, at + _STEP)].tolist()
        e = (ends[min(shingle, len(words)) - 1 + at :][: len(s)] - 1).tolist()
        h = np.array([digest(line[a:b], _SEED) for a, b in zip(s, e, strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column("__text").cast(pa.binary())]
            kept = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.array(fps, np.uint64).view(np.int64))], names=[*kept, "__fp"])

    return work


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(row, doc_id, __fp) for each row of docs; row is a number of the row, __fp is the fingerprint as a signed 64-bit number. A null text has no words."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(_fingerprints(shingle), f"row long, doc_id {kind}, __fp long")


def _forest(fp: np.ndarray, group: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (of row numbers) that connect what is connected within each group; group numbers are in runs."""
    refs = pivots(PIVOTS)
    table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)
    table = table[:, np.argsort(-table.std(0), kind="stable")]  # the pivot that tells most goes first
    run = np.cumsum(np.diff(group, prepend=group[0]) != 0)
    by = np.lexsort((table[:, 0], run))
    own, table, stop = fp[by], table[by], np.searchsorted(run, run, "right")
    left, right, i, d = [], [], np.arange(len(fp)), 0
    while len(i):
        d += 1
        i = i[i + d < stop[i]]
        i = i[table[i + d, 0] - table[i, 0] <= bits]  # sorted by it: what is too far now stays too far
        j = i
        for p in range(1, PIVOTS):
            j = j[np.abs(table[j, p] - table[j + d, p]) <= bits]
        j = j[np.bitwise_count(own[j] ^ own[j + d]) <= bits]
        left.append(by[j])
        right.append(by[j + d])
    none = np.zeros(0, np.int64)
    left, right = np.concatenate([*left, none]), np.concatenate([*right, none])
    label = np.arange(len(fp))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return linked, label[linked]


def _links(bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(fp: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
            a, b = _forest(fp, group, bits) if len(fp) else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], names=["u", "v"])

        fp, group = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            new = batch.column("__fp").to_numpy(zero_copy_only=False).view(np.uint64)
            fp, group = np.concatenate([fp, new]), np.concatenate([group, batch.column("unit").to_numpy(zero_copy_only=False)])
            cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
            if cut:
                yield linked(fp[:cut], group[:cut])
                fp, group = fp[cut:], group[cut:]
        yield linked(fp, group)

    return work


def block_keys(bits: int, blocks: int) -> list:
    """A key column for each choice of blocks - bits blocks of the fingerprint __fp that agree."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned("__fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    return [F.xxhash64(F.lit(t), *(part[i] for i in chosen)) for t, chosen in enumerate(combinations(range(blocks), blocks - bits))]


def linked_fingerprints(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (u, v) between distinct fingerprints __fp at most so many bits apart that connect all that is connected."""
    keyed = distinct.select("__fp", F.explode(F.array(*block_keys(bits, bits + 2))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    rows = keyed.join(shared, "key")
    own = F.pmod(F.xxhash64("__fp"), "chunks").cast("int")
    units = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    rows = rows.select("__fp", F.explode(units).alias("unit"))
    rows = rows.repartition("unit").sortWithinPartitions("unit", "__fp")
    return rows.mapInArrow(_links(bits), "u long, v long")


def _components(rows: DataFrame, bits: int) -> DataFrame:
    """(__fp, first) for the distinct fingerprints of rows (row, doc_id, __fp); first: the component's first row, by id and then by row number."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    least = rows.groupBy("__fp").agg(F.min(order).alias("least"))
    roots = components(linked_fingerprints(least.select("__fp"), bits))
    found = least.join(roots, least["__fp"] == roots["node"], "left").select("__fp", "least", F.coalesce("root", "__fp").alias("root"))
    found = written(found, "roots")
    least = found.groupBy("root").agg(F.min("least").alias("first"))
    return found.join(least, "root").select("__fp", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at bits or fewer differing bits; component_id is the least doc_id that links reach. A null or
    empty text has fingerprint zero and links like any other. Rows with null doc_id link too but aren't counted in the
    minimum; a component of such rows only has a null component_id. Repeated rows are separate rows; other columns
    are ignored. Copies meet as one fingerprint before anything is compared.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    found = _components(rows, bits)
    return rows.join(found, "__fp").select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = minhash.SHINGLE, similarity: float = minhash.SIMILARITY, bits: int = BITS) -> DataFrame:
    """The first row, by id, of each group that links of at least that similarity connect, with all its columns.

    Similarity is the share of common ones among the distinct shingles of two texts; words are parted by white space and
    A-Z lower-cased. Pairs of fingerprints of the shingle sets at most so many bits apart are candidates, found by their
    pivot distances, and so is what shares a band of minima (some ten of 64 bits differ at a similarity of 0.8, and
    blocks for that many bits are too short to group by); all candidates are verified by their shingles. Texts without words
    are copies of each other, null texts too; a null id comes last; of repeated rows one stays; columns of any name stay;
    an empty table gives an empty one. Rows are numbered once, in a written table. Texts with equal shingles meet as one
    set before anything is compared.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    (number,) = free_names(docs.columns, "__row")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    texts = rows.select(F.col(number).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    marks = texts.mapInArrow(minhash.marks(shingle), f"row long, doc_id {kind}, digest binary, size long, signs long, keys array<long>")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    least = marks.groupBy("digest").agg(F.min(order).alias("least"), F.min_by(F.struct("size", "signs", "keys"), order).alias("own"))
    sets = written(least.select(F.col("least.row").alias("row"), "least", "own.size", "own.signs", "own.keys"), "sets")
    by_signs = sets.groupBy(F.col("signs").alias("__fp")).agg(F.min("row").alias("first"))
    near = linked_fingerprints(by_signs.select("__fp"), bits)
    of = lambda name: by_signs.select(F.col("__fp").alias(name), F.col("first").alias(f"row_{name}"))
    near = near.join(of("u"), "u").join(of("v"), "v").select(F.col("row_u").alias("u"), F.col("row_v").alias("v"))
    same = sets.join(by_signs, sets["signs"] == by_signs["__fp"]).filter("row <> first").select(F.col("first").alias("u"), F.col("row").alias("v"))
    roots = components(minhash.similar_sets(sets, texts.drop("doc_id"), near.unionAll(same), shingle, similarity))
    found = sets.select("row", "least").join(roots, sets["row"] == roots["node"], "left").select(F.coalesce("root", "row").alias("root"), "least")
    kept = found.groupBy("root").agg(F.min("least").alias("first"))
    return rows.join(kept.select(F.col("first.row").alias(number)), number, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
