"""Vector search by Column expressions, cut-offs, and Reciprocal Rank Fusion."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.constants import DUPLICATE_FLOOR, EXCERPT_CHARS, MESSAGE_CUTOFF, RRF_K


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; 0 for different lengths or a zero vector."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), _dot(a, b) / norm).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cutoff(text: str | None, default: float) -> float | None:
    """A configured distance cut-off: the default where unset or not a number, none where zero or less."""
    try:
        value = default if text is None else float(text)
    except ValueError:
        value = default
    return default if math.isnan(value) else value if value > 0 else None


def nearest(vectors: DataFrame, query: Sequence[float], k: int, limit: float | None = None, key: str = "key", col: str = "embedding") -> DataFrame:
    """The k nearest vectors by distance and then key, within a limit; the filter runs before the top k, which is no full sort."""
    out = vectors.withColumn("distance", l2(F.col(col), F.lit([float(x) for x in query])))
    if limit is not None:
        out = out.filter(F.col("distance") <= limit)
    return out.orderBy("distance", key).limit(k)


def most_similar(vectors: DataFrame, query: Sequence[float], k: int, floor: float = DUPLICATE_FLOOR, key: str = "key", col: str = "embedding") -> DataFrame:
    out = vectors.withColumn("similarity", cosine(F.col(col), F.lit([float(x) for x in query])))
    return out.filter(F.col("similarity") >= floor).orderBy(F.desc("similarity"), key).limit(k)


def fuse(lists: list[DataFrame], key: str, order: list[list[Column]], limit: int | None = None) -> DataFrame:
    """Reciprocal Rank Fusion of ranked lists: sum of 1 / (k + place from 0), ties by key. Lists are windows of bounded length."""
    ranked = None
    for n, (df, by) in enumerate(zip(lists, order, strict=True)):
        own = df.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(n)).orderBy(*by)) - 1).select(key, "place")
        ranked = own if ranked is None else ranked.unionByName(own)
    out = ranked.groupBy(key).agg(F.sum(1.0 / (RRF_K + F.col("place"))).alias("score")).orderBy(F.desc("score"), key)
    return out if limit is None else out.limit(limit)


def pending(current: DataFrame, stored: DataFrame, key: str, model: str) -> DataFrame:
    """Rows of current (key, content) whose vector is missing, of another model, or of other content."""
    own = current.withColumn("hash", F.sha2(F.substring("content", 1, 20_000), 256))
    meta = stored.select(key, F.col("model").alias("_model"), F.col("content_hash").alias("_hash"))
    return own.join(meta, key, "left").filter(~(F.col("_model").eqNullSafe(F.lit(model)) & F.col("_hash").eqNullSafe(F.col("hash")))).drop("_model", "_hash")


def nearest_messages(vectors: DataFrame, messages: DataFrame, sessions: DataFrame, query: Sequence[float], limit: int, cutoff_distance: float | None = MESSAGE_CUTOFF) -> DataFrame:
    """(session_id, seq, role, distance, excerpt, truncated) of the nearest messages within the cut-off.

    vectors: session_id, seq, content_hash, embedding. Vectors of replaced contents don't count; sessions: the visible ones.
    All filters run before the limit.
    """
    text = F.regexp_replace("content", r"^\s+|\s+$", "")
    own = messages.select("session_id", "seq", "role", F.sha2(F.substring("content", 1, 20_000), 256).alias("content_hash"), F.substring(text, 1, EXCERPT_CHARS).alias("excerpt"), (F.length(text) > EXCERPT_CHARS).alias("truncated"))
    near = vectors.withColumn("distance", l2(F.col("embedding"), F.lit([float(x) for x in query])))
    near = near if cutoff_distance is None else near.filter(F.col("distance") <= cutoff_distance)
    out = near.join(own, ["session_id", "seq", "content_hash"]).join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    return out.orderBy("distance", "session_id", "seq").limit(limit).select("session_id", "seq", "role", "distance", "excerpt", "truncated")


def vanished(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys of vectors whose row is gone."""
    return stored.select(key).distinct().join(current.select(key), key, "left_anti")


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float] | None]], key: str, model: str) -> DataFrame:
    """(key, model, content_hash, embedding) of rows (key, content, hash) by an injected function over batches of texts; texts that it gives no vector for are left out."""
    def work(parts):
        for part in parts:
            found = embed(part["content"].fillna("").tolist())
            keep = [v is not None for v in found]
            yield pd.DataFrame({key: part[key][keep], "content_hash": part["hash"][keep], "embedding": [v for v in found if v is not None]})

    kind = rows.schema[key].dataType.simpleString()
    out = rows.select(key, "content", "hash").mapInPandas(work, f"{key} {kind}, content_hash string, embedding array<float>")
    return out.select(key, F.lit(model).alias("model"), "content_hash", "embedding")
