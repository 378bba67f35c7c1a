import json
import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from heddle.api import Archive
from heddle.operators import search, text_index
from heddle.operators.text_index import FAN, TextIndex
from heddle.sources import jsonl
from heddle.streaming.ingest import Log, Snapshots

MSG = "session_id string, seq int, role string, content string, source_path string"
SES = "id string, tool string, title string, source_path string, source_mtime_ns long, parser_version int, updated timestamp_ntz"


def session(id_, mtime, parser=1, path="/f"):
    return (id_, "codex", f"Title {id_}", path, mtime, parser, datetime(2026, 1, 1))


def contents(archive):
    return sorted((r.session_id, r.seq, r.content) for r in archive.table("messages").collect())


def outcomes(df):
    return {r.id: r.outcome for r in df.collect()}


def test_messages_of_a_session_are_replaced_as_a_group(spark, tmp_path):
    own = Archive(spark, str(tmp_path))
    own.reindex()
    first = spark.createDataFrame([("a", i, "user", f"alpha {i}", "/f") for i in range(5)] + [("b", 0, "user", "beta", "/g")], MSG)
    both = spark.createDataFrame([session("a", 1), session("b", 1, path="/g")], SES)
    assert outcomes(own.sync(both, first)) == {"a": "added", "b": "added"}
    before, version = contents(own), own.store("messages").version()
    assert len(before) == 6 and outcomes(own.sync(both, first)) == {"a": "unchanged", "b": "unchanged"}
    assert contents(own) == before and own.store("messages").version() == version
    # fewer messages, in a batch that holds two parses of the session
    parses = spark.createDataFrame([("a", 0, "user", "gamma", "/new"), ("a", 1, "user", "delta", "/new"), ("a", 0, "user", "old", "/f")], MSG)
    again = own.sync(spark.createDataFrame([session("a", 2), session("a", 3, path="/new")], SES), parses)
    assert outcomes(again) == {"a": "replaced"}
    assert contents(own) == [("a", 0, "gamma"), ("a", 1, "delta"), ("b", 0, "beta")]
    assert {r.id: r.messages_count for r in own.table("sessions").collect()} == {"a": 2, "b": 1}
    assert [r.id for r in own.search("gam").collect()] == ["a"] and own.search("alpha").count() == 0
    # an older parser, and a session that lost all messages
    assert outcomes(own.sync(spark.createDataFrame([session("a", 9, parser=0)], SES), first)) == {"a": "older"}
    assert outcomes(own.sync(spark.createDataFrame([session("b", 5)], SES), first.limit(0))) == {"b": "replaced"}
    assert contents(own) == [("a", 0, "gamma"), ("a", 1, "delta")] and own.search("beta").count() == 0
    assert own.index.statistics()[0] == 2


def test_a_crash_before_the_last_commit_is_made_good_by_the_same_call(spark, tmp_path, monkeypatch):
    own = Archive(spark, str(tmp_path))
    rows, messages = spark.createDataFrame([session("a", 1)], SES), spark.createDataFrame([("a", 0, "user", "x", "/f")], MSG)
    stored = Snapshots.upsert

    def dies(self, *args, **kwargs):
        raise OSError("killed")

    monkeypatch.setattr(Snapshots, "upsert", dies)
    with pytest.raises(OSError):
        own.sync(rows, messages)
    assert own.table("sessions").count() == 0
    monkeypatch.setattr(Snapshots, "upsert", stored)
    assert outcomes(own.sync(rows, messages)) == {"a": "added"} and len(contents(own)) == 1


def test_a_log_entry_is_there_as_a_whole_or_not_at_all(spark, tmp_path):
    own = Snapshots(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    own.replace(df, "id")
    (tmp_path / "t" / "log" / f"{2:020d}").write_text("")
    (tmp_path / "t" / "log" / "_draft-x").write_text("half")
    assert sorted(r.v for r in own.current().collect()) == ["a", "b"]
    own.upsert(spark.createDataFrame([(2, "c")], "id int, v string"), "id")
    assert sorted(r.v for r in own.current().collect()) == ["a", "c"] and own.version() == 3
    log = Log(spark, str(tmp_path / "log"))
    log.append(1, {"x": 1})
    with pytest.raises(RuntimeError, match="another writer"):
        log.append(1, {"x": 2})
    assert log.last() == (1, {"x": 1}) and [p for p in os.listdir(tmp_path / "log") if "draft" in p] == []


def test_vacuum_keeps_what_the_last_entries_name(spark, tmp_path):
    own = Snapshots(spark, str(tmp_path), buckets=4)
    for n in range(5):
        own.upsert(spark.createDataFrame([(k, n) for k in range(8)], "id int, v int"), "id")
    assert own.vacuum(keep=1) == 4 and [r.v for r in own.current().collect()] == [4] * 8
    assert own.vacuum(keep=1) == 0 and own.version() == 5


def bodies(spark, rows):
    return spark.createDataFrame(rows, "doc string, text string")


def scores(index, query, n, mean):
    return {r.doc: round(r.score, 9) for r in search.matches(index, search.parse(query), n, mean).collect()}


def test_postings_after_batches_equal_those_of_a_fresh_build(spark, tmp_path):
    own, docs = TextIndex(spark, str(tmp_path / "a")), {}
    words = ["building", "builds", "parser", "the", "tests", "run"]
    for n in range(FAN * 2 + 1):
        batch = {f"d{k}": " ".join(words[(k + j + n) % 6] for j in range(k % 7)) for k in range(n * 3, n * 3 + 12)}
        gone = [f"d{n}"] if n % 2 else []
        batch = {d: t for d, t in batch.items() if d not in gone}
        own.update(bodies(spark, list(batch.items())), bodies(spark, [(d, "") for d in gone]).select("doc"))
        docs = {d: t for d, t in (docs | batch).items() if d not in gone}
    fresh = TextIndex(spark, str(tmp_path / "b"))
    fresh.rebuild(bodies(spark, list(docs.items())))
    assert own.segments() < FAN * 2 and fresh.segments() == 1
    assert own.statistics() == fresh.statistics() and own.statistics()[0] == len(docs)
    assert {r.doc for r in own.documents().collect()} == set(docs)
    for query in ("build", "the par", '"the tests"', "run build"):
        got = scores(own.postings(), query, *own.statistics())
        assert got == scores(fresh.postings(), query, *fresh.statistics()) and (got or query == '"the tests"')
    plan = own.postings().filter(F.col("term").startswith("build"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,build)" in plan


def test_a_prefix_search_skips_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    own = TextIndex(spark, str(tmp_path), row_group=1 << 16)
    own.rebuild(bodies(spark, [(str(i), f"w{i % 5000:04d} common x{i}") for i in range(20_000)]))
    parts = [pq.ParquetFile(p) for p in tmp_path.glob("s-*/postings/*.parquet")]
    ranges = sorted((str(f.metadata.row_group(g).column(1).statistics.min), str(f.metadata.row_group(g).column(1).statistics.max)) for f in parts for g in range(f.metadata.num_row_groups))
    assert len(ranges) > 1 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_files_are_pulled_when_they_change(spark, tmp_path):
    folder = tmp_path / "home"
    folder.mkdir()

    def write(name, *texts):
        lines = [{"type": "user", "sessionId": name, "timestamp": f"2026-01-01T00:00:0{i}Z", "message": {"content": t}, "cwd": "/w"} for i, t in enumerate(texts)]
        (folder / f"{name}.jsonl").write_text("\n".join(map(json.dumps, lines)))

    own = Archive(spark, str(tmp_path / "archive"))
    fmt = jsonl.FORMATS["claude-code"]
    write("s1", "one", "two")
    write("s2", "three")
    assert own.pull(str(folder), fmt, most=1) == {"added": 2}
    assert own.pull(str(folder), fmt) == {}
    time.sleep(0.05)
    write("s1", "one")
    write("s3", "four")
    assert own.pull(str(folder), fmt) == {"replaced": 1, "added": 1}
    assert sorted(r.content for r in own.table("messages").collect()) == ["four", "one", "three"]


def test_the_library_is_kept_by_difference(spark, tmp_path):
    own = Archive(spark, str(tmp_path / "archive"))
    rows = [(f"s{i:02d}", "codex", f"T{i}", f"/f{i}", 1, 1, datetime(2026, 1, 1 + i % 2, i)) for i in range(12)]
    messages = spark.createDataFrame([(r[0], 0, "user", f"text {r[0]}", r[3]) for r in rows], MSG)
    own.sync(spark.createDataFrame(rows, SES), messages)
    first = own.export_library(str(tmp_path / "out"), per_page=5)
    pages = {r.page: r.text for r in own.store("library").current().collect()}
    assert first == {"changed": len(pages), "gone": 0}
    assert set(pages) == {"Index", "Projects/unassigned", "Projects/unassigned (2)", "Projects/unassigned (3)", "Days/2026-01-01", "Days/2026-01-01 (2)", "Days/2026-01-02", "Days/2026-01-02 (2)"} | {f"Sessions/{r[0]}" for r in rows}
    assert pages["Projects/unassigned"].endswith("- [[s03|T3]]\n\n[[Projects/unassigned (2)|Next]]") and pages["Projects/unassigned (3)"] == "# Projects/unassigned (3)\n\n- [[s02|T2]]\n- [[s00|T0]]"
    version = own.store("library").version()
    assert own.export_library(per_page=5) == {"changed": 0, "gone": 0} and own.store("library").version() == version
    own.hide(spark.createDataFrame([("s00",), ("s02",)], "id string"))
    assert own.export_library(per_page=5) == {"changed": 3, "gone": 4}
    left = {r.page for r in own.store("library").current().collect()}
    assert not left & {"Sessions/s00", "Sessions/s02", "Projects/unassigned (3)", "Days/2026-01-01 (2)"} and "Projects/unassigned (2)" in left


def shuffle_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    files = env.blockManager().diskBlockManager().getAllFiles()
    return {f for k in range(files.size()) if (f := files.apply(k).getName()).startswith("shuffle_")}


def test_an_index_is_sorted_by_ranges_and_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "SORTED", 16)
    words = ["build", "test", "x", "the", "épée", "zeta", "10", "Running"]
    docs = spark.createDataFrame([(f"d{i}", " ".join(words[(i * k) % 8] for k in range(i % 23)) if i % 19 else None) for i in range(300)], "doc string, text string").repartition(3)
    for stemmed in (True, False):
        before, index = shuffle_files(spark), TextIndex(spark, str(tmp_path / str(stemmed)), stemmed)
        index.rebuild(docs)
        deadline = time.time() + 20
        while shuffle_files(spark) - before and time.time() < deadline:
            time.sleep(0.2)  # they are removed beside
        assert not shuffle_files(spark) - before
        want = {(r.doc, r.term, tuple(r.positions), r.tf, r.dl) for r in search.postings(docs, "doc", F.col("text"), stemmed).collect()}
        rows = [(r.doc, r.term, tuple(r.positions), r.tf, r.dl) for r in index.postings().collect()]
        assert len(rows) == len(want) > 500 and set(rows) == want and index.statistics()[0] == 300
        passes = index._ranges(index.postings(), len(rows))
        assert 1 < len(passes) <= text_index.PASSES and sum(index.postings().filter(these).count() for _, these in passes) == len(rows)
        spans = sorted(tuple(r) for r in index.postings().groupBy(F.input_file_name()).agg(F.min(F.struct("term", "doc")).alias("a"), F.max(F.struct("term", "doc")).alias("b")).select("a", "b").collect())
        assert len(spans) > len(passes) and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert "Exchange" not in search.own_postings(spark.range(3).selectExpr("id", "'a' as text"), "id", F.col("text"))._jdf.queryExecution().executedPlan().toString()
