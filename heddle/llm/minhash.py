"""What the near-duplicates stage compares texts by: their sets of word shingles, and banded minima of them.

Sets whose minima agree in a whole band meet, besides those whose SimHash fingerprints link; what meets hangs together in
clusters. Every pair of a cluster is then compared by all its shingles, so nothing is linked that isn't similar; a similar
pair is lost only if it meets in no way and no chain of others brings the two into one cluster. Clusters are cut into
chunks, and pairs of chunks go to different tasks; a task gives a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.base import mixed, powers, written
from heddle.llm.components import components

#: Words of a shingle, similarity of a link, bands, minima of a band: a pair at 0.8 agrees in no band in 8 of 100,000 cases.
SHINGLE, SIMILARITY, BANDS, MINIMA = 5, 0.8, 40, 7
#: Rows and shingles of a chunk.
CHUNK, VOLUME = 1024, 1 << 18
_SEED = 42
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Shingles that minima are taken of at a time.
_STEP = 1 << 12
_RULES = mixed(np.arange(1, BANDS * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BY, _OFF = (_RULES >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1), _RULES.astype(np.uint32)[:, None]


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a shorter text is one shingle, and one without words has none."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    ends = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(line[a:b], _SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of minima of a set; an empty set has none."""
    if not len(own):
        return np.zeros(0, np.int64)
    high, least = (own >> np.uint64(32)).astype(np.uint32), np.full(BANDS * MINIMA, np.uint32(0xFFFFFFFF))
    for at in range(0, len(high), _STEP):
        least = np.minimum(least, ((high[None, at : at + _STEP] ^ _OFF) * _BY).min(1))
    band = least.astype(np.uint64).reshape(BANDS, MINIMA) * powers(MINIMA + 1)[1:]
    return mixed(mixed(band.sum(1, dtype=np.uint64)) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def signs_of(own: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingle hashes: bit i is set if it is set in more than half of them; of none: 0."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(own), _STEP):
        counts += np.unpackbits(own[at : at + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(own), bitorder="little").view("<u8")[0])


def marks(shingle: int):
    """Of each text (row, doc_id, __text): a digest, the size, the fingerprint and the band keys of its set of shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), shingle) for t in batch.column("__text").cast(pa.binary())]
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            signs = pa.array(np.array([signs_of(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), digests, pa.array([len(s) for s in sets], pa.int64()), signs, keys], names=["row", "doc_id", "digest", "size", "signs", "keys"])

    return work


def _packed(shingle: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), shingle).tobytes() for t in batch.column("__text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("root"), batch.column("chunks"), pa.array(sets, pa.binary())], names=["row", "root", "chunks", "shingles"])

    return work


def forest(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links between sets of at least that similarity that connect all that such links connect."""
    size, n = np.array([len(s) for s in sets]), len(sets)
    ids = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)[1]
    edge = np.concatenate(([0], np.cumsum(size)))
    label, seen, links = np.arange(n), np.zeros(len(ids), bool), []
    for i in range(n - 1):
        other = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        other = other[np.minimum(size[other], size[i]) / np.maximum(size[other], size[i]) >= similarity]
        if not len(other):
            continue
        own = ids[edge[i] : edge[i + 1]]
        first = np.cumsum(size[other]) - size[other]
        seen[own] = True
        both = np.add.reduceat(seen[ids[np.arange(int(size[other].sum())) + np.repeat(edge[other] - first, size[other])]], first, dtype=np.int64)
        seen[own] = False
        hit = other[both / (size[i] + size[other] - both) >= similarity]
        if len(hit):
            links += [(i, int(j)) for j in hit]
            label[np.isin(label, label[hit])] = label[i]
    return links


def _links(similarity: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked() -> pa.RecordBatch:
            found = forest(sets, similarity)
            return pa.RecordBatch.from_arrays([pa.array([rows[x[k]] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        unit, rows, sets = None, [], []
        for batch in batches:
            for u, row, own in zip(batch.column("unit").to_pylist(), batch.column("row").to_pylist(), batch.column("shingles"), strict=True):
                if u != unit and rows:
                    yield linked()
                    rows, sets = [], []
                unit = u
                rows.append(row)
                sets.append(np.frombuffer(own.as_py(), np.uint64))
        if rows:
            yield linked()

    return work


def similar_sets(sets: DataFrame, texts: DataFrame, candidates: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v) between rows of sets (row, size, keys) that connect what is similar; texts (row, __text) has their texts.

    Candidates are pairs (u, v) that the caller found, and what shares a band's key with another; all pairs of what hangs
    together so are compared by their shingles.
    """
    keyed = sets.select(F.col("row").alias("v"), F.explode("keys").alias("key"))
    meet = keyed.groupBy("key").agg(F.min("v").alias("u"), F.count("*").alias("n")).filter("n > 1").select("key", "u")
    found = components(keyed.join(meet, "key").select("u", "v").unionAll(candidates.select("u", "v")))
    members = found.select(F.col("node").alias("row"), "root").unionAll(found.select(F.col("root").alias("row"), "root").distinct())
    members = written(members.join(sets.select("row", "size"), "row"), "clusters")
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("size") / VOLUME)).cast("int")
    members = members.select("row", "root").join(members.groupBy("root").agg(chunks.alias("chunks")), "root")
    rows = texts.join(members, "row").select("row", "root", "chunks", "__text").mapInArrow(_packed(shingle), "row long, root long, chunks int, shingles binary")
    own = F.pmod(F.xxhash64("row"), "chunks").cast("int")
    units = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.xxhash64("root", F.least(own, j), F.greatest(own, j)))
    rows = rows.select("row", "shingles", F.explode(units).alias("unit")).repartition("unit").sortWithinPartitions("unit", "row")
    return rows.mapInArrow(_links(similarity), "u long, v long")
