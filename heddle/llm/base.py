"""What the operators share: the folder all executors see, written tables, and words as numpy arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, IntegralType, StructType

#: Text bytes that one vectorised step works on; a single longer text makes a longer step.
SLAB_BYTES = 2_000_000

_LOWER = np.zeros(256, np.uint8)
_LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWER[0x80:] = np.arange(0x80, 0x100)
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or on one machine one of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="heddle-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch(spark)}/heddle-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder, compressed well: its lineage ends there and its rows are fixed from then on."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forgotten(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores behind it as it takes to clash with none, case aside."""
    have, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def arrow_type(id_type: str | DataType) -> pa.DataType:
    """The Arrow type of an id column of any type, given as it is or by its name."""
    return to_arrow_type(StructType.fromDDL(f"x {id_type}")["x"].dataType if isinstance(id_type, str) else id_type)


def whole_ids(docs: DataFrame, id_col: str) -> None:
    """ValueError unless the ids are whole numbers."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} has to hold whole numbers, not {docs.schema[id_col].dataType.simpleString()}")


def powers(n: int, base: int = _ODD) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base | 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that sums and products of them spread over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, byte starts and byte ends of the words [0-9a-z and non-ASCII]+ of UTF-8 data, A-Z lower-cased.

    Works through the data in pieces cut between words, so that temporaries stay small.
    """
    low = _LOWER[np.frombuffer(data, np.uint8)]
    hashes, starts, ends = [], [], []
    at, n = 0, len(low)
    while at < n:
        to = min(n, at + SLAB_BYTES // 2)
        while to < n and low[to - 1]:
            gap = np.flatnonzero(low[to : to + 4096] == 0)
            to = to + int(gap[0]) + 1 if len(gap) else min(n, to + 4096)
            if len(gap):
                break
        part = low[at:to]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = part != 0
        step = np.diff(inside)
        s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(s):
            lens = e - s
            first = np.concatenate(([0], np.cumsum(lens)[:-1]))
            pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
            value = (part[part != 0].astype(np.uint64) + np.uint64(1)) * powers(int(lens.max()))[pos]
            hashes.append(mixed(np.add.reduceat(value, first) + lens.astype(np.uint64)))
            starts.append(s + at)
            ends.append(e + at)
        at = to
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of a sequence of hashes; len(h) - k + 1 of them, or none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros((n, *h.shape[1:]), np.uint64)
    for i, p in enumerate(powers(k, 0xD6E8FEB86659FD93)):
        out += h[i : i + n] * p
    return mixed(out)


def slabs(texts: list[bytes | None]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first, last, data, offsets): runs of texts joined by a zero byte, of about SLAB_BYTES; offsets has the start of each text and the end."""
    first = 0
    while first < len(texts):
        last, total = first, 0
        while last < len(texts) and (last == first or total + len(texts[last] or b"") < SLAB_BYTES):
            total += len(texts[last] or b"") + 1
            last += 1
        part = [t or b"" for t in texts[first:last]]
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in part])))
        yield first, last, b"\0".join(part), offsets
        first = last


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller pieces, so that results of a piece are on their way before the next is worked on."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in the sorted table, and at which index (where they are)."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values, at
