"""More named queries: per-session projections, listings, joins and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import analytics as P
from heddle.operators import archive as A
from heddle.operators import memory as M
from heddle.operators import ordered as O
from heddle.operators import search as X
from heddle.operators import sessions as R
from heddle.operators import vectors as V
from heddle.operators import visibility as S
from heddle.plans.queries import query

_TURNS = "SELECT *, CAST(sum(CASE WHEN role = 'user' AND kind = 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn FROM fx_messages"
_TERMS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"


@query("C01_display_row", """SELECT id, tool, coalesce(array_to_string(list_filter(string_split(project, '/'), lambda p: p <> ''), '/'), '') AS label, nullif(total_tokens, 0) AS tokens,
  CASE WHEN count(*) OVER (PARTITION BY lower(title)) > 1 THEN title || ' · ' || left(id, 8) ELSE title END AS shown FROM fx_sessions""")  # fmt: skip
def _(fx):
    return R.display_row(fx.sessions)


@query("C03_F02_enum_and_alias", "SELECT id, CASE WHEN origin IN ('interactive', 'subagent') THEN origin ELSE 'unknown' END AS origin FROM fx_sessions WHERE tool = 'claude-code'")
def _(fx):
    from heddle.schemas import one_of

    return S.listed(fx.sessions, tool=R.tool_name("Claude")).select("id", one_of(F.col("origin"), ("interactive", "subagent"), "unknown").alias("origin"))


@query("C22_canonical_calls", """+ e AS (SELECT session_id, CAST(event_id // 40 AS BIGINT) AS seq, event_id AS n, name, status FROM fx_tool_events),
  c AS (SELECT session_id, seq, name, row_number() OVER (PARTITION BY session_id, seq, name ORDER BY n) AS k FROM e WHERE n % 3 > 0), v AS (SELECT session_id, seq, name, status, row_number() OVER (PARTITION BY session_id, seq, name ORDER BY n) AS k FROM e WHERE n % 2 = 0)
  SELECT session_id, seq, name, CAST(k AS INTEGER) AS k, c_.called IS NOT NULL AS called, v.status FROM (SELECT *, true AS called FROM c) c_ FULL JOIN v USING (session_id, seq, name, k)""")  # fmt: skip
def _(fx):
    own = fx.tool_events.select("session_id", F.expr("event_id div 40").alias("seq"), F.col("event_id").alias("n"), "name", "status")
    return R.canonical_calls(own.filter("n % 3 > 0").drop("status"), own.filter("n % 2 = 0"))


@query("F14_prune_candidates", "SELECT id FROM fx_sessions WHERE prompt_count <= 2 AND origin NOT IN ('exec', 'cron', 'subagent')")
def _(fx):
    return S.visible(fx.sessions).filter("prompt_count <= 2").select("id")


@query("F17_credential_files", "SELECT page_id, regexp_matches(lower(url), '(^|/)(\\.env(\\..+)?|id_[a-z0-9]+|\\.netrc|\\.pgpass|credentials(\\.json)?|.*\\.(pem|key|p12|pfx))$') AS hit FROM pages".replace("\\\\", "\\"))
def _(fx):
    return fx.table("pages").select("page_id", R.credential_file(F.col("url")).alias("hit"))


@query("F20_whole_words", r"""SELECT doc_id, regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])(the|der)([^\p{L}\p{N}]|$)') AS hit FROM documents""")
def _(fx):
    return fx.table("documents").select("doc_id", S.whole_word(F.col("text"), ("the", "der")).alias("hit"))


@query("F23_library_skip", "SELECT id FROM fx_sessions WHERE NOT (origin IN ('exec', 'cron', 'subagent') OR contains(id, ':agent-') OR parent_session_id IS NOT NULL)")
def _(fx):
    return fx.sessions.filter(~R.library_skip()).select("id")


@query("J01_J03_hits_to_sessions", f"""+ h AS (SELECT session_id, count(*) AS n FROM (SELECT session_id, unnest({_TERMS.replace('text', 'content')}) AS t FROM fx_messages) WHERE starts_with(t, 'inti') GROUP BY 1) SELECT s.id, s.title, h.n FROM h JOIN fx_sessions s ON s.id = h.session_id""")
def _(fx):
    docs = fx.messages.groupBy("session_id").agg(F.concat_ws(" ", F.collect_list("content")).alias("t"))
    own = X.postings(docs, "session_id", F.col("t"), stemmed=False).filter(F.col("term").startswith("inti")).groupBy("doc").agg(F.sum("tf").alias("n"))
    return own.join(fx.sessions, F.col("doc") == F.col("id")).select("id", "title", "n")


@query("J17_first_wins", "SELECT source AS id, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def _(fx):
    return O.keep_best(fx.table("documents").select(F.col("source").alias("id"), "doc_id"), ["id"], [F.asc("doc_id")])


@query("G15_thread_timeline", "SELECT thread_id, CAST(row_number() OVER (PARTITION BY thread_id ORDER BY timestamp, session_id, seq) AS INTEGER) AS place, session_id, seq FROM fx_messages JOIN fx_sessions ON id = session_id")
def _(fx):
    return R.timeline(fx.messages, fx.sessions)


@query("G25_turn_tokens", f"+ t AS ({_TURNS}) SELECT session_id, turn, CAST(sum(length(content)) AS BIGINT) AS input, count(*) AS output, arg_min('m' || seq, seq) FILTER (seq % 2 = 1) AS model FROM t GROUP BY 1, 2")
def _(fx):
    tokens = F.create_map(F.lit("input"), F.length("content").cast("bigint"), F.lit("output_tokens"), F.lit(1).cast("bigint"))
    own = O.with_turns(fx.messages).withColumns({"tokens": tokens, "model": F.when(F.col("seq") % 2 == 1, F.concat(F.lit("m"), F.col("seq").cast("string")))})
    return R.turn_tokens(own)


@query("G28_recall", "SELECT avg(CASE WHEN conv_id % 4 < 2 THEN 0.5 ELSE 0 END) AS recall, count(*) AS queries FROM fx_sessions")
def _(fx):
    s = fx.sessions
    labels = s.select(F.col("id").alias("query"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("item"))
    hits = s.select(F.col("id").alias("query"), F.lit("x").alias("item"), (F.col("conv_id") % 4 + 1).alias("rank"))
    return R.recall_at(hits, labels, 2)


@query("W04_tool_steps", """+ r AS (SELECT *, role IN ('tool', 'system') AS tool FROM fx_messages), c AS (SELECT *, CASE WHEN tool IS NOT DISTINCT FROM lag(tool) OVER (PARTITION BY session_id ORDER BY seq) THEN 0 ELSE 1 END AS c FROM r),
  g AS (SELECT *, CAST(sum(c) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS step FROM c) SELECT session_id, step, tool, count(*) AS messages, min(seq) AS first, max(seq) AS last FROM g GROUP BY 1, 2, 3""")  # fmt: skip
def _(fx):
    return R.tool_steps(fx.messages)


@query("W08_sampled_chunks", """+ c AS (SELECT session_id, seq AS chunk, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS users, CAST(length(content) AS INTEGER) AS chars FROM fx_messages),
  n AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY session_id ORDER BY chunk) AS a, row_number() OVER (PARTITION BY session_id ORDER BY chunk DESC) AS z FROM c WINDOW w AS (PARTITION BY session_id)),
  r AS (SELECT *, a <= 2 OR z <= 3 AS edge, row_number() OVER (PARTITION BY session_id, a <= 2 OR z <= 3 ORDER BY users / greatest(chars, 1) DESC, chunk) AS k FROM n) SELECT session_id, chunk, users, chars FROM r WHERE n <= 6 OR edge OR k <= 1""")  # fmt: skip
def _(fx):
    own = fx.messages.select("session_id", F.col("seq").alias("chunk"), (F.col("role") == "user").cast("int").alias("users"), F.length("content").alias("chars"))
    return P.sampled(own, 6)


@query("W14_copy_numbers", "SELECT source, text_sha, CAST(n AS INTEGER) AS n FROM (SELECT source, sha256(text) AS text_sha, 1 + dense_rank() OVER (PARTITION BY source ORDER BY sha256(text)) AS n FROM documents) GROUP BY ALL")
def _(fx):
    own = fx.table("documents").select("source", F.sha2("text", 256).alias("text_sha")).distinct()
    return O.numbered(own, ["source"], [F.asc("text_sha")], F.lit(1)).withColumnRenamed("revision", "n")


@query("X06_hit_count", rf"SELECT count(*) AS hits FROM (SELECT doc_id FROM documents WHERE len(list_filter({_TERMS}, lambda w: starts_with(w, 'tio'))) > 0)")
def _(fx):
    index = X.postings(fx.table("documents"), "doc_id", F.col("text"), stemmed=False)
    return X.matches(index, X.parse("tio", stemmed=False), 1, 1.0).agg(F.count("*").alias("hits"))


@query("D03_resolved_ids", """SELECT w AS wanted, CASE WHEN p = 'i' THEN id WHEN conv_id % 2 = 0 AND p = 'b' THEN id || '#2' END AS id, CASE WHEN p = 'i' THEN 'id' WHEN conv_id % 2 = 0 AND p = 'b' THEN 'base' END AS how
  FROM (SELECT id, conv_id, p, CASE p WHEN 'i' THEN id ELSE 'x' || id END AS w FROM fx_sessions, (SELECT unnest(['i', 'b']) AS p)) JOIN (SELECT 1) ON true""".replace("id || '#2'", "'x' || id || '#2'"))  # fmt: skip
def _(fx):
    s = fx.sessions
    own = s.select("id").unionAll(s.filter("conv_id % 2 = 0").select(F.concat(F.lit("x"), "id", F.lit("#2")).alias("id"))).select("id", F.lit(None).cast("string").alias("record_id"), F.lit(None).cast("string").alias("content_sha256"))
    wanted = s.select(F.explode(F.array("id", F.concat(F.lit("x"), "id"))).alias("wanted"))
    return R.resolve_ids(wanted, own)


@query("D07_promotion", """+ c AS (SELECT doc_id AS id, source AS session_id, lower(left(text, 12)) AS t FROM documents WHERE regexp_matches(left(text, 12), '^[a-zA-Z0-9 ]+$') AND trim(left(text, 12)) <> ''),
  r AS (SELECT *, row_number() OVER (PARTITION BY trim(t) ORDER BY id) AS copy FROM c), g AS (SELECT id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS k FROM r WHERE copy = 1), a AS (SELECT id FROM g WHERE k <= 2 ORDER BY id LIMIT 15)
  SELECT id, CASE WHEN copy > 1 THEN 'duplicate' WHEN id IN (SELECT id FROM a) THEN 'added' ELSE 'capped' END AS outcome FROM r""")  # fmt: skip
def _(fx):
    own = fx.table("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("session_id"), F.substring("text", 1, 12).alias("title")).filter(F.col("title").rlike("^[a-zA-Z0-9 ]+$") & (F.trim("title") != ""))
    own = own.withColumn("body", F.lit(None).cast("string"))
    return M.promoted(own, own.limit(0), 2, 15)


@query("P05_plan", "SELECT session_id, count(*) AS blocks FROM (SELECT session_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS b FROM fx_messages) GROUP BY session_id, b".replace("GROUP BY session_id, b", "GROUP BY session_id").replace("count(*)", "count(DISTINCT b)"))
def _(fx):
    blocks = P.compressed(fx.messages)
    return O.chunks(blocks.select("session_id", F.col("block").cast("int").alias("block"), "chars"), "session_id", 12_000).groupBy("session_id").agg(F.count("*").alias("blocks"))


@query("H05_retention", "SELECT count(*) FILTER (date_diff('day', CAST(updated AS DATE), DATE '2024-01-31') BETWEEN 27 AND 29) AS due, count(*) AS files FROM fx_sessions")
def _(fx):
    return R.near_deletion(fx.sessions.select(F.col("updated").alias("modified")), "2024-01-31", 30, 3)


@query("H06_coverage", "SELECT session_id, count(*) FILTER (seq % 3 > 0) AS archived, count(*) AS live, round_even(count(*) FILTER (seq % 3 > 0) / count(*), 4) AS ratio FROM fx_messages GROUP BY 1")
def _(fx):
    return R.coverage(fx.messages.filter("seq % 3 > 0"), fx.messages)
