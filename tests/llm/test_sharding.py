import zlib
from collections import defaultdict

from heddle.llm.sharding import shard_by_bytes

SCHEMA = "doc_id long, text string, shard string, size int"


def check(rows, out, n):
    want = sorted(((i, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=str) == want
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append(r)
    for s, members in shards.items():
        assert 0 <= s < n
        assert sorted(m.slot for m in members) == list(range(len(members)))
    total, most = sum(r["size"] for r in out), max((r["size"] for r in out), default=0)
    for s in range(n):
        assert abs(sum(m["size"] for m in shards[s]) - total / n) <= most


def test_near_equal_bytes(spark):
    rows = [(i, "x" * (i * 7 % 500) + "é", "s", 1) for i in range(400)]
    check(rows, shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 7).collect(), 7)


def test_hot_text_nulls_ties_and_long(spark):
    rows = [(i % 5, "same text", None, None) for i in range(300)] + [(None, None, None, None)] * 3 + [(7, "", None, None), (8, "y" * 20000, None, None)]
    check(rows, shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 4).collect(), 4)


def test_empty(spark):
    assert shard_by_bytes(spark.createDataFrame([], SCHEMA), 4).collect() == []
