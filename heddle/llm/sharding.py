"""Sharding by sampled splitters: key ranges of near-equal bytes, cut exactly where the shards end.

DataFrame functions only. A size-weighted sample of keys gives quantile splitters; rows fall into key ranges;
ranges that hold too many bytes get further splitters from a sample of their own; sums by range and running sums
within a range give each row's place in the global order, and with it shard and slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.base import written

#: Key ranges for each shard at least, rows of a range (on average) at most, sampled keys for each range, and the share of the mean above which a range is cut again.
RANGES_PER_SHARD, RANGE_ROWS, SAMPLES_PER_RANGE, OVERFULL = 8, 1 << 20, 32, 2.0
#: How often overfull ranges are cut again at most; keys are distinct, so each time shrinks them by a large factor.
ROUNDS = 8


def range_of(key: Column, splitters: list[str]) -> Column:
    """How many of the sorted splitters are at or below key: a binary search over a literal array."""
    if not splitters:
        return F.lit(0)
    n, table = len(splitters), F.split(F.lit(",".join(splitters)), ",")  # one literal, however many splitters
    steps = [1 << b for b in reversed(range(n.bit_length()))]

    def step(at: Column, by: Column) -> Column:
        to = F.least(at + by, F.lit(n))
        return F.when((at + by <= n) & (F.element_at(table, to) <= key), at + by).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), step)


def _sample(rows: DataFrame, n: int, seed: int) -> list[str]:
    """About n keys, drawn with chances in proportion to size, in key order: races of exponential times, up to a time at which n are expected."""
    total = rows.agg(F.sum("size").alias("total")).first()["total"]
    if not total:
        return []
    u = (F.abs(F.xxhash64("key", F.lit(seed)) % F.lit(1 << 52)) + 1) / F.lit(float(1 << 52) + 2)
    drawn = rows.filter(-F.log(u) / F.col("size") < F.lit(n / total)).select("key")
    return sorted(r["key"] for r in drawn.collect())


def _quantiles(keys: list[str], ranges: int) -> list[str]:
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = 16) -> DataFrame:
    """Each row of docs with the shard it goes to: doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus row_bytes. Shards take consecutive pieces of one global order (hash of the
    text, then of id and row), so shard sizes differ from the mean by the size of one row at most, and rows with
    equal texts lie side by side. A null text counts no bytes and has a null checksum; an empty table gives an
    empty result; repeated rows are separate rows; other columns are ignored. A hot text or id does no harm: the
    order goes on by row within equal texts, and ranges are cut by bytes.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + row_bytes).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.concat(*(F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(text), F.xxhash64("doc_id", F.monotonically_increasing_id())))).alias("key"),
    )
    rows = written(rows, "rows")
    ranges = max(n_shards * RANGES_PER_SHARD, -(-rows.count() // RANGE_ROWS))
    splitters = _quantiles(_sample(rows, ranges * SAMPLES_PER_RANGE, 1), ranges)
    for turn in range(ROUNDS):
        sums = {r["r"]: (r["bytes"], r["n"], r["keys"]) for r in rows.groupBy(range_of(F.col("key"), splitters).alias("r")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), (F.min("key") != F.max("key")).alias("keys")).collect()}
        total = sum(b for b, _, _ in sums.values())
        over = [r for r, (b, n, keys) in sums.items() if keys and n > 1 and b > OVERFULL * total / ranges]
        if not over or turn == ROUNDS - 1:
            break
        within = rows.filter(range_of(F.col("key"), splitters).isin(over))
        more = -(-sum(sums[r][0] for r in over) * ranges // total) * 2
        finer = sorted({*splitters, *_quantiles(_sample(within, more * SAMPLES_PER_RANGE, turn + 2), more)})
        if finer == splitters:
            break
        splitters = finer
    count, before_rows, before_bytes = len(splitters) + 1, [], []
    n_rows = n_bytes = 0
    for r in range(count):
        before_rows.append(n_rows)
        before_bytes.append(n_bytes)
        b, n, _ = sums.get(r, (0, 0, False))
        n_rows, n_bytes = n_rows + n, n_bytes + b
    order = Window.partitionBy("r").orderBy("key")
    longs = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")
    at = F.element_at(longs(before_bytes), F.col("r") + 1) + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("r", range_of(F.col("key"), splitters)).withColumns(
        {
            "shard": F.least(F.lit(n_shards - 1), F.floor((2 * at - F.col("size")) * n_shards / F.lit(2 * max(n_bytes, 1)))).cast("int"),
            "place": F.element_at(longs(before_rows), F.col("r") + 1) + F.row_number().over(order) - 1,
        }
    )
    placed = written(placed.select("doc_id", "size", "text_crc32", "shard", "place"), "placed")
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("place").alias("first")).collect()}
    start = F.element_at(F.lit([first.get(s, 0) for s in range(n_shards)]), F.col("shard") + 1)
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - start).cast("long").alias("slot"))
