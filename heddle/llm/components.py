"""Connected components of a graph in a table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.base import forgotten, new_path


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _table(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (u, v) but the roots themselves; the root is the least node that can be reached.

    Rounds go on until nothing changes (their number grows with the logarithm of the nodes); each ends in a written
    table, and the tables before it are deleted. Per node only a minimum is gathered, never its neighbours, so hubs are
    no large groups. No edges give no rows; edges from a node to itself are left out, repeated ones count once.
    """
    spark = edges.sparkSession
    edges, path = _table(_ordered(edges), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, between = _table(_ordered(large), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = path
        edges, path = _table(_ordered(small.unionAll(least.select("u", F.col("m").alias("v")))), "edges")
        for done in (old, between):
            forgotten(spark, done)
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
