import math
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from heddle.functions import columns as C
from heddle.functions.porter import stem, tokens
from heddle.functions.redact import redact, redact_value, redacted
from heddle.operators import analytics as P
from heddle.operators import memory as M
from heddle.operators import ordered as O
from heddle.operators import search as X
from heddle.operators import vectors as V
from heddle.operators import visibility as S
from heddle.streaming import ingest as I

MSG = "session_id string, seq int, role string, content string, kind string, timestamp timestamp_ntz"


def messages(spark, *rows):
    return spark.createDataFrame([(s, n, r, t, "text", datetime(2026, 1, 1, 0, n)) for s, n, r, t in rows], MSG)


def test_stems_equal_those_of_sqlite():
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    con.execute("create virtual table v using fts5vocab(t, row)")
    words = "running runs relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky sayings Café naïve apology logically organization".split()
    for w in words:
        con.execute("delete from t")
        con.execute("insert into t values (?)", (w,))
        assert tokens(w) == [con.execute("select term from v").fetchone()[0]], w
    assert stem("by") == "by"


def test_search_scores_equal_those_of_sqlite(spark):
    texts = ["the running dog ran", "dogs run in the park and run again", "a cat", "running shoes for the dog", "cats and dogs", "park rules", "", "the the the"] * 3
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    con.executemany("insert into t(rowid, x) values (?, ?)", [(i + 1, t) for i, t in enumerate(texts)])
    index = X.postings(spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "id int, x string"), "id", F.col("x"))
    n, mean = X.statistics(index, len(texts))
    for text, match in (("running dog", '"running"* "dog"*'), ('"the dog"', '"the dog"'), ("pa", '"pa"*')):
        want = {i: s for i, s in con.execute("select rowid, bm25(t) from t where t match ?", (match,))}
        got = {int(r.doc): r.score for r in X.matches(index, X.parse(text), n, mean).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in got), text
    assert X.parse("  ") is None


def test_message_search_and_evidence(spark):
    own = messages(spark, ("a", 0, "user", "alpha beta"), ("a", 1, "assistant", "alpha"), ("b", 0, "user", "beta"), ("b", 1, "assistant", "gamma alpha beta"))
    docs = own.groupBy("session_id").agg(F.concat_ws(" ", F.collect_list("content")).alias("t"))
    index = X.postings(docs, "session_id", F.col("t"))
    hits = X.search_messages(own, index, X.parse("alpha beta"), *X.statistics(index), 10)
    assert sorted((r.session_id, r.seq) for r in hits.collect()) == [("a", 0), ("b", 1)]
    assert [(r.session_id, r.seq) for r in X.first_evidence(own, hits, 1).orderBy("session_id").collect()] == [("a", 0), ("b", 1)]
    page = X.with_snippets(own.filter("session_id = 'b' and seq = 1"), "content", X.parse("alpha"), 2).collect()
    assert page[0].snippet == "gamma «alpha»…"


# values are made up
@pytest.mark.parametrize(("text", "want"), [
    ("key AKIA" + "A" * 16 + " end", {"aws_access_key": 1}),
    ("ghp_" + "a1" * 18, {"github_token": 1}),
    ("Authorization: Bearer " + "z9" * 12, {"bearer_token": 1}),
    ("Cookie: session=abcdefgh12", {"cookie": 1}),
    ("postgres://me:hunter22@host/db", {"url_password": 1}),
    ('password = "correct horse"', {"secret_assignment": 1}),
    ("run --token=abcd1234", {"secret_assignment": 1}),
    ("https://x/y?a=1&sig=abcdEFGH%2B1", {"sas_signature": 1}),
    ("-----BEGIN RSA PRIVATE KEY-----\nabc\n", {"private_key": 1}),
    ("password = changeme; token: $TOKEN; api_key = os.environ['K']; secret = request.password", {}),
    ("--password when prompted", {}),
    ("plain words", {}),
])
def test_redaction(text, want):
    out, n, kinds = redact(text)
    assert kinds == want and n == sum(want.values())
    assert redact(out) == (out, 0, {})
    assert (out == text) == (not want)


def test_redaction_of_fields_and_columns(spark):
    assert redact_value("db_password", "abcd") == "[REDACTED:secret_assignment]" and redact_value("note", "abcd") == "abcd"
    (r,) = spark.createDataFrame([("x ghp_" + "a" * 36,)], "t string").select(redacted(F.col("t")).alias("r")).collect()
    assert r.r.text == "x [REDACTED:github_token]" and r.r["count"] == 1


def test_titles_and_text_columns(spark):
    row = spark.createDataFrame([("<b>Fix</b> `the` parser [Tool Result] junk", "Session 12", "One. Two here. three", "a" * 50)], "a string, b string, c string, d string")
    got = row.select(C.clean_title(F.col("a")), C.low_quality(F.col("a")), C.low_quality(F.col("b")), C.first_sentence(F.col("c")), C.capped(F.col("d"), 10), C.elided(F.col("d"), 20, 5, 5), C.slug(F.lit("Ab c/é!")), C.duration_label(F.lit(3700)), C.compact_count(F.lit(1234567))).first()
    assert list(got) == ["Fix the parser", False, True, "One.", "a" * 9 + "…", "aaaaa\n[+40 chars elided]\naaaaa", "ab-c-é", "1h 1m", "1.2M"]
    times = spark.createDataFrame([("2026-01-02T03:04:05.123456789Z",), ("1767323045",), ("1767323045000",), ("nonsense",)], "t string").select(C.timestamp_of(F.col("t")).cast("string").alias("t")).collect()
    assert [t.t for t in times] == ["2026-01-02 03:04:05.123456", "2026-01-02 03:04:05", "2026-01-02 03:04:05", "1970-01-01 00:00:00"]
    assert C.parse_duration("2w").days == 14 and S.parse_bound("2026-01-01", True).microsecond == 999999


def test_chunks_pack_greedily(spark):
    rows = [("s", i, n) for i, n in enumerate([5, 4, 20, 1, 9, 1])] + [("t", 0, 3)]
    got = {(r.session_id, r.block): r.chunk for r in O.chunks(spark.createDataFrame(rows, "session_id string, block int, chars int"), "session_id", 10).collect()}
    assert got == {("s", 0): 1, ("s", 1): 1, ("s", 2): 2, ("s", 3): 3, ("s", 4): 3, ("s", 5): 4, ("t", 0): 1}


def test_compression_and_rules(spark):
    own = messages(spark, ("s", 0, "user", "go"), *(("s", i, "tool", "x") for i in range(1, 8)), ("s", 8, "assistant", "You must never push to main directly. Ok."), ("s", 9, "user", "more"))
    blocks = {r.block: r.text for r in P.compressed(own).collect()}
    assert blocks == {1: "user: go\n[7 tool steps]\nassistant: You must never push to main directly. Ok.", 2: "user: more"}
    assert [(r.sentence, r.score) for r in P.rules(own).collect()] == [("You must never push to main directly.", 2)]
    sessions = spark.createDataFrame([("s", "/p", "codex")], "id string, project string, tool string")
    assert P.recommendations(own, sessions).first().scope == "project:/p"
    bad = P.uncited(spark.createDataFrame([("a", "s", [0, 99]), ("b", "s", [1])], "id string, session_id string, cites array<int>"), own)
    assert [(r.id, r.wrong) for r in bad.collect()] == [("a", [99])]


def test_memory_states(spark):
    rows = [(1, "T", "b", None, "confirmed", "{}"), (2, "T", "b", 1, "confirmed", "{}"), (3, "U", "c", None, "candidate", '{"claim_type": "decision"}'), (4, "U", "c", None, "rejected", None)]
    own = spark.createDataFrame(rows, "id long, title string, body string, superseded_by long, status string, metadata string")
    assert [r.s for r in own.select("id", M.claim_state().alias("s")).orderBy("id").collect()] == ["confirmed", "superseded", "decision", "rejected"]
    new = spark.createDataFrame([(1, "s", "New", "x"), (2, "s", "new", "x "), (3, "s", " ", "y"), (4, "s", "T", "b"), (5, "s", "Other", ""), (6, "s", "Third", "")], "id long, session_id string, title string, body string")
    assert {r.id: r.outcome for r in M.promoted(new, own, 2, 10).collect()} == {1: "added", 2: "duplicate", 3: "invalid", 4: "already_known", 5: "added", 6: "capped"}
    log = spark.createDataFrame([(1, 7, 2, 1), (1, 7, 5, 2), (1, 8, 1, 1)], "memory_id long, rater long, score int, created int")
    assert sorted((r.rater, r.score) for r in M.rated(log).collect()) == [(7, 5), (8, 1)]


def test_vectors(spark):
    own = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, [0.0, 0.0])], "key long, embedding array<float>")
    assert [r.key for r in V.nearest(own, [1.0, 0.0], 2).collect()] == [1, 3]
    assert [r.key for r in V.most_similar(own, [1.0, 0.0], 5, 0.5).collect()] == [1, 3]
    assert (V.cutoff(None, 0.8), V.cutoff("nan", 0.8), V.cutoff("-1", 0.8), V.cutoff("0.5", 0.8)) == (0.8, 0.8, None, 0.5)
    lists = [spark.createDataFrame([(k, i) for i, k in enumerate(ks)], "k string, p int") for ks in ("abc", "bd")]
    got = V.fuse(lists, "k", [[F.asc("p")], [F.asc("p")]]).collect()
    assert [r.k for r in got] == ["b", "a", "d", "c"] and math.isclose(got[0].score, 1 / 61 + 1 / 60)


def test_incremental_ingest(spark, tmp_path):
    archive = I.Snapshots(spark, str(tmp_path / "store"))
    assert archive.current() is None
    src, check = str(tmp_path / "in"), str(tmp_path / "check")
    schema = "id string, v int, title string"
    for n, rows in enumerate([[("a", 1, "x"), ("b", 2, "y")], [("a", 2, "z"), ("b", 1, "old")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        I.watch(spark, src, schema, archive, "id", check, "v").awaitTermination()
        assert archive.version() == n + 1
    assert sorted(map(tuple, archive.current().collect())) == [("a", 2, "z"), ("b", 2, "y")]
    I.watch(spark, src, schema, archive, "id", check, "v").awaitTermination()
    assert archive.version() == 2
    listing, log = spark.createDataFrame([("p", 1), ("q", 2)], "path string, mtime long"), spark.createDataFrame([("p", 1, 3), ("q", 1, 3)], "path string, mtime long, parser_version int")
    assert [r.path for r in I.changed(listing, log, 3).collect()] == ["q"] and I.changed(listing, log, 4).count() == 2


def test_only_one_writer_stores_a_version(spark, tmp_path):
    one, two = (I.Snapshots(spark, str(tmp_path / "s"), buckets=4) for _ in range(2))
    rows = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id int, title string")
    one.replace(rows(*range(40)), "id")
    before = one._last()[1]["folders"]
    one.upsert(rows(3), "id")
    after = one._last()[1]["folders"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1
    number, entry = two._last()
    one.upsert(rows(50), "id")
    with pytest.raises(RuntimeError, match="another writer"):
        two._commit(number + 1, entry)
    assert sorted(r.id for r in two.current().collect()) == [*range(40), 50]
    assert I.Snapshots(spark, str(tmp_path / "none")).current() is None


def test_job_states(spark):
    at = lambda n: datetime(2026, 1, 1, 0, n)
    log = spark.createDataFrame([("j", 1, "pending", at(0)), ("j", 1, "complete", at(1)), ("j", 1, "failed", at(2)), ("j", 2, "pending", at(0)), ("k", 1, "complete", at(0))], "job_id string, chunk int, status string, at timestamp")
    assert sorted(tuple(r) for r in I.job_states(log).collect()) == [("j", 2, 1, "running", 2), ("k", 1, 1, "complete", None)]


def test_the_rules_query_has_no_limit(spark):
    from heddle.plans.queries import QUERIES

    plan = QUERIES["P07_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Aggregate" in plan


def test_checks_fail_as_they_should(spark):
    from heddle.operators import archive as A

    assert S.checked_id("codex:two:b#2") == "codex:two:b#2" and S.checked_query(" a\0b ") == "ab"
    for bad in ("", "../x", "a/b", None):
        with pytest.raises(ValueError, match="no session id"):
            S.checked_id(bad)
    with pytest.raises(ValueError, match="at most"):
        S.checked_query("x" * 501)
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, mtime_ns long")
    A.assert_fresh(files(("a", 10)), files(("a", 1_000_000_010)))
    with pytest.raises(ValueError, match=r"b \(new\)"):
        A.assert_fresh(files(("a", 10)), files(("a", 10), ("b", 1)))
    with pytest.raises(ValueError, match="no such source"):
        A.union_of({"codex": files()}, ["cursor"])


def test_sums_before(spark):
    rows = [(i * 7 % 50, i) for i in range(50)]
    out = O.with_sums_before(spark.createDataFrame(rows, "k int, v int"), "k", ["v"], 7).collect()
    assert sorted((r.k, r.v_before) for r in out) == [(k, sum(v for j, v in rows if j < k)) for k in range(50)]
    assert O.with_sums_before(spark.createDataFrame([], "k int, v int"), "k", ["v"]).collect() == []
