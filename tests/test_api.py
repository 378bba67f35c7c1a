from datetime import datetime

import pytest
from pyspark.sql import functions as F

from heddle.api import Archive
from heddle.operators import archive as A
from heddle.operators import sinks
from heddle.schemas import MESSAGES, SESSIONS, with_defaults


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    own = Archive(spark, str(tmp_path_factory.mktemp("archive")))
    at = lambda d: datetime(2026, 1, d)
    sessions = [("a", "codex", "/w/p1", "Build fix", at(1), "interactive"), ("b", "codex", "/w/p2", "Parser work", at(2), "interactive"), ("c", "aider", "/w/p1", "Nightly", at(3), "cron"), ("d", "aider", None, "Gone", at(4), "unknown")]
    rows = spark.createDataFrame(sessions, "id string, tool string, project string, title string, updated timestamp_ntz, origin string").withColumn("created", F.col("updated"))
    own.store("sessions").replace(with_defaults(rows, SESSIONS))
    messages = [("a", 0, "user", "fix the build"), ("a", 1, "assistant", "The build is fixed. You should always run tests first."), ("b", 0, "user", "write a parser"), ("b", 1, "assistant", "done"), ("c", 0, "user", "build"), ("d", 0, "user", "build")]
    own.store("messages").replace(with_defaults(spark.createDataFrame(messages, "session_id string, seq int, role string, content string"), MESSAGES))
    own.store("deleted").replace(spark.createDataFrame([("d",)], "id string"))
    own.store("tags").replace(spark.createDataFrame([("b", "work"), ("c", "work")], "session_id string, tag string"))
    own.reindex()
    return own


def ids(df):
    return [r["id"] for r in df.collect()]


def test_listing(filled):
    assert ids(filled.list_sessions()) == ["b", "a"]
    assert ids(filled.list_sessions(project="p1")) == ["a"]
    assert ids(filled.list_sessions(tag="work")) == ["c", "b"]
    assert ids(filled.list_sessions(per_page=1, number=2)) == ["a"]
    assert ids(filled.list_sessions(since="2026-01-01", until="2026-01-01")) == ["a"]


def test_search_filters_before_limits(filled):
    assert ids(filled.search("build")) == ["a"]
    assert ids(filled.search("build", tool="aider")) == []
    assert ids(filled.search("pars", limit=1, project="p2")) == ["b"]
    assert ids(filled.search(" ")) == [] and ids(filled.search("build", roles=["assistant"])) == ["a"]
    assert [(r.session_id, r.seq) for r in filled.search_messages("fix").collect()] == [("a", 0), ("a", 1)]


def test_a_page_of_hits_has_snippets(filled):
    (hit,) = filled.search_page("build").collect()
    assert (hit.id, hit.tool, hit.title) == ("a", "codex", "Build fix") and hit.snippet.startswith("fix the «build» The «build» is fixed.")
    assert filled.search_page(" ").collect() == []


def test_overviews(filled):
    assert filled.digest("2026-01-01", "2026-01-02").first().sessions == 2
    assert {r.key for r in filled.digest("2026-01-01", "2026-01-31", "tool").collect()} == {"codex"}
    assert filled.projects().count() == 2 and filled.costs().filter("part = 'total'").first().sessions == 4
    assert filled.metrics()["means"].first().sessions == 4
    assert [r.sentence for r in filled.rules().collect()] == ["You should always run tests first."]
    assert filled.compress("a").count() == 1 and filled.health().count() == 0
    filled.register()
    assert filled.spark.sql("select count(*) from sessions join messages on id = session_id").first()[0] == 6


def test_memory(filled):
    bad = filled.add_memory(filled.spark.createDataFrame([(1, "fact", "Title", "b", "confirmed"), (2, "nonsense", "T", "b", "confirmed"), (3, "fact", " ", "b", "confirmed")], "id long, kind string, title string, body string, status string"))
    assert sorted(r.id for r in bad.collect()) == [2, 3] and [r.id for r in filled.table("memory").collect()] == [1]
    filled.add_memory(filled.spark.createDataFrame([(1, "fact", "New", "b", "confirmed")], "id long, kind string, title string, body string, status string"))
    assert [r.title for r in filled.table("memory").collect()] == ["New"] and filled.dedupe().count() == 0


def test_exports_and_snapshots(filled, tmp_path):
    filled.export(str(tmp_path / "md"))
    assert sorted(p.name for p in (tmp_path / "md").glob("_name=*")) == ["_name=a", "_name=b"]
    pages = {r.page: r.text for r in sinks.library(filled.table("sessions")).collect()}
    assert pages["Projects/w-p1"] == "# Projects/w-p1\n\n- [[c|Nightly]]\n- [[a|Build fix]]"
    assert "&lt;b&gt;" in filled.spark.range(1).select(sinks.escaped(F.lit("<b>"))).first()[0]
    assert filled.spark.range(1).select(sinks.fenced(F.lit("a\n```\nb"))).first()[0].startswith("````\n")
    tables = {"s": filled.table("sessions"), "m": filled.table("messages")}
    manifest = sinks.snapshot(tables, str(tmp_path / "snap"))
    assert A.problems(tables, manifest).count() == 0
    assert [(r.name, r.problem) for r in A.problems({"s": tables["s"].limit(1), "m": tables["m"]}, manifest).collect()] == [("s", "count")]
    assert [(r.name, r.problem) for r in A.problems({"s": tables["s"].withColumn("title", F.lit("x")), "m": tables["m"]}, manifest).collect()] == [("s", "content")]
    assert sorted((r.name, r.problem) for r in A.problems({"s": tables["s"].drop("title"), "t": tables["m"]}, manifest).collect()) == [("m", "missing"), ("s", "fields"), ("t", "not listed")]
    merged = {r.id: r.outcome for r in filled.merge(filled.spark.createDataFrame([("a", "codex", "x"), ("z", "codex", "y")], "id string, tool string, content_sha256 string"), "other").collect()}
    assert merged == {"a": "refilled", "z": "added"}


def test_bundles(filled, spark, tmp_path):
    other = Archive(spark, str(tmp_path / "other"))
    filled.bundle(str(tmp_path / "bundle"))
    other.restore(str(tmp_path / "bundle"))
    assert ids(other.list_sessions()) == ids(filled.list_sessions()) and other.table("messages").count() == filled.table("messages").count()
    hashed = A.content_hash(other.table("messages"), other.table("sessions"))
    other.store("sessions").replace(other.table("sessions").drop("content_sha256").join(hashed, "id").withColumn("source_namespace", F.lit("ns:one")))
    # of the other archive: a as it is, b with other words, c below a new name, and a memory
    changed = Archive(spark, str(tmp_path / "changed"))
    changed.restore(str(tmp_path / "bundle"))
    words = changed.table("messages").withColumn("content", F.when(F.col("session_id") == "b", "other words").otherwise(F.col("content")))
    own = changed.table("sessions").withColumns({"id": F.when(F.col("id") == "c", "new").otherwise(F.col("id")), "parent_session_id": F.when(F.col("id") == "c", "b")}).filter("id <> 'd'")
    changed.store("messages").replace(words.withColumn("session_id", F.when(F.col("session_id") == "c", "new").otherwise(F.col("session_id"))))
    changed.store("sessions").replace(own.drop("content_sha256").join(A.content_hash(changed.table("messages"), own), "id"))
    changed.add_memory(spark.createDataFrame([(1, "fact", "Only there", "body", "confirmed")], "id long, kind string, title string, body string, status string"))
    changed.bundle(str(tmp_path / "second"))
    other.add_memory(spark.createDataFrame([(7, "fact", "Only here", "body", "confirmed")], "id long, kind string, title string, body string, status string"))
    report = {r.outcome: r.n for r in other.import_bundle(str(tmp_path / "second"), "ns:two").collect()}
    assert report == {"identical": 1, "copy": 1, "added": 1}
    stored = {r.id: (r.copy_of_session_id, r.parent_session_id) for r in other.table("sessions").collect()}
    assert stored == {"a": (None, None), "b": (None, None), "c": (None, None), "d": (None, None), "new": (None, "codex:two:b#2"), "codex:two:b#2": ("b", None)}
    assert [r.content for r in other.session("codex:two:b#2").collect()] == ["other words"] * 2 and [r.content for r in other.session("b").collect()] == ["write a parser", "done"]
    assert sorted((r.title, r.id) for r in other.table("memory").collect())[-1] == ("Only there", 8)
    assert {r.outcome: r.n for r in other.import_bundle(str(tmp_path / "second"), "ns:two").collect()} == {"identical": 2, "twin": 1}
    (tmp_path / "second" / "manifest").rename(tmp_path / "second" / "hidden")
    with pytest.raises(Exception, match="manifest"):
        other.restore(str(tmp_path / "second"))


def test_tags_and_hidden(filled):
    filled.tag(added=filled.spark.createDataFrame([("a", " Mine ")], "session_id string, tag string"))
    assert ids(filled.list_sessions(tag="mine")) == ["a"]
    filled.tag(removed=filled.spark.createDataFrame([("a", "mine")], "session_id string, tag string"))
    assert ids(filled.list_sessions(tag="mine")) == []
    filled.hide(filled.spark.createDataFrame([("a",)], "id string"), ignored=True)
    assert ids(filled.list_sessions()) == ["b"]
