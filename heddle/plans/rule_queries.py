"""Named queries of classification, identity, recall, mutation and listing; their inputs reach every branch of a rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions import columns as C
from heddle.functions.redact import redacted
from heddle.operators import aggregates as G
from heddle.operators import analytics as P
from heddle.operators import archive as A
from heddle.operators import memory as M
from heddle.operators import search as X
from heddle.operators import sessions as R
from heddle.operators import sinks
from heddle.operators import vectors as V
from heddle.operators import visibility as S
from heddle.plans.queries import query
from heddle.streaming import ingest as I


def one_of(values: list[str | None], by: str) -> Column:
    """The value of a list that a whole number picks."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.expr(by) % len(values)).cast("int") + 1)


# --- tool calls


@query("C27_P11_at_a_glance", """+ c AS (SELECT 'c' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS session_id, event_id AS n, event_type AS tool, CASE WHEN event_id % 3 = 0 THEN '/f' || (event_id % 12) ELSE '' END AS path, event_type = 'error' AS bad FROM events),
  t AS (SELECT session_id, tool, count(*) AS k, min(n) AS since FROM c GROUP BY 1, 2), tr AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY k DESC, since) AS r FROM t), ts AS (SELECT session_id, list(tool || '=' || k ORDER BY r) AS tools_used FROM tr WHERE r <= 6 GROUP BY 1),
  f AS (SELECT session_id, path, min(n) AS since FROM c WHERE path <> '' GROUP BY 1, 2), fr AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY since) AS r FROM f), fs AS (SELECT session_id, list(path ORDER BY r) AS files_touched FROM fr WHERE r <= 8 GROUP BY 1),
  n AS (SELECT session_id, count(*) AS calls, count(*) FILTER (bad) AS bad FROM c GROUP BY 1), p AS (SELECT session_id, trim(regexp_replace(arg_min(content, seq), '\\s+', ' ', 'g')) AS t FROM fx_messages WHERE role = 'user' GROUP BY 1),
  d AS (SELECT id, prompt_count, CAST(epoch(updated) - epoch(created) AS BIGINT) AS s FROM fx_sessions)
  SELECT id AS session_id, coalesce(CASE WHEN length(t) > 120 THEN rtrim(left(t, 119)) || '…' ELSE t END, '') AS first_prompt, prompt_count AS prompts, coalesce(calls, 0) AS tool_calls, coalesce(bad, 0) AS failed_tool_calls, coalesce(tools_used, []) AS tools_used, coalesce(files_touched, []) AS files_touched,
  CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || CASE WHEN s % 60 > 0 THEN ' ' || (s % 60) || 's' ELSE '' END ELSE (s // 3600) || 'h' || CASE WHEN s % 3600 // 60 > 0 THEN ' ' || (s % 3600 // 60) || 'm' ELSE '' END END AS duration
  FROM d LEFT JOIN p ON p.session_id = id LEFT JOIN n ON n.session_id = id LEFT JOIN ts ON ts.session_id = id LEFT JOIN fs ON fs.session_id = id""".replace("\\\\", "\\"))  # fmt: skip
def _(fx):
    calls = fx.table("events").select(F.concat(F.lit("c"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("session_id"), F.lit(0).alias("seq"), F.col("event_id").alias("n"), F.col("event_type").alias("tool"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/f"), (F.col("event_id") % 12).cast("string"))).otherwise("").alias("path"), F.when(F.col("event_type") == "error", "Failed").otherwise("ok").alias("status"), F.lit(False).alias("is_error"))
    return R.at_a_glance(fx.sessions, fx.messages, calls)


# --- titles and labels


@query("C04_message_counts", "SELECT session_id, count(*) AS messages, count(*) FILTER (role = 'user' AND kind = 'text' AND trim(content) <> '') AS prompts, count(*) FILTER (role = 'assistant') AS answers FROM fx_messages GROUP BY 1")
def _(fx):
    return R.message_counts(fx.messages)


@query("C13_search_text", "+ f AS (SELECT session_id, string_agg(content, ' ' ORDER BY seq) AS t FROM fx_messages WHERE seq < 30 GROUP BY 1) SELECT id, left(lower(title || ' ' || t), 20000) AS search_text FROM fx_sessions JOIN f ON session_id = id")
def _(fx):
    return R.search_text(fx.sessions, fx.messages)


@query("C14_fts_body", "SELECT session_id, sha256(string_agg(content, chr(10) ORDER BY seq)) AS body_sha FROM fx_messages WHERE content <> '' GROUP BY 1")
def _(fx):
    return R.body_text(fx.messages).select("session_id", F.sha2("text", 256).alias("body_sha"))


@query("C05_outlines", r"""+ c AS (SELECT session_id, seq, trim(regexp_replace(regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '`', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM fx_messages WHERE role = 'user' AND kind = 'text'),
  g AS (SELECT *, lower(t) AS low FROM c), k AS (SELECT * FROM g WHERE length(low) >= 8 AND NOT starts_with(regexp_replace(low, '^[^a-z0-9]+', ''), 'session ') AND length(regexp_replace(low, '[^\p{L}]', '', 'g')) >= greatest(3, length(low) // 6))
  SELECT session_id, CASE WHEN length(arg_min(t, seq)) > 140 THEN rtrim(left(arg_min(t, seq), 139)) || '…' ELSE arg_min(t, seq) END AS outline FROM k GROUP BY 1""")  # fmt: skip
def _(fx):
    return R.outline(fx.messages)


@query("C12_keywords", r"""+ t AS (SELECT session_id, string_agg(content, ' ' ORDER BY seq) AS t FROM fx_messages WHERE seq < 20 GROUP BY 1),
  w AS (SELECT id, list_concat(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+'), list_filter(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 4)) AS ws FROM fx_sessions JOIN t ON session_id = id)
  SELECT id, array_to_string(list_sort(list_filter(list_distinct(ws), lambda w: length(w) >= 3 AND w NOT IN ('about', 'after', 'before', 'could', 'from', 'have', 'into', 'should', 'that', 'their', 'there', 'these', 'this', 'what', 'with', 'would')))[1:100], ',') AS keywords FROM w""")  # fmt: skip
def _(fx):
    own = R.body_text(fx.messages, 20, " ")
    return fx.sessions.join(own, F.col("id") == F.col("session_id")).select("id", F.array_join(C.keywords(F.col("title"), F.col("text")), ",").alias("keywords"))


# --- injected text and noise


@query("C28_text_diff", """+ m AS (SELECT conv_id, turn, CAST(turn % 12 + 1 AS INTEGER) AS k FROM conversations),
  l AS (SELECT conv_id, turn, k, i FROM m, (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS i)),
  r AS (SELECT conv_id, turn, i AS place, 0 AS part, CASE WHEN i < k AND k - 1 > 7 AND i > 3 AND i <= k - 1 - 3 THEN CASE WHEN i = 4 THEN 'gap' END WHEN i > k AND 12 - k > 7 AND i > k + 3 AND i <= 9 THEN CASE WHEN i = k + 4 THEN 'gap' END WHEN i = k THEN 'del' ELSE 'context' END AS kind, i, k FROM l UNION ALL SELECT conv_id, turn, k, 1, 'add', k, k FROM m),
  s AS (SELECT conv_id, turn, place, part, kind, CASE WHEN kind IN ('context', 'del') THEN i END AS old, CASE WHEN kind IN ('context', 'add') THEN i END AS new, CASE kind WHEN 'gap' THEN CASE WHEN i < k THEN (k - 7) ELSE (6 - k) END || ' unchanged lines' WHEN 'add' THEN 'other' ELSE 'line ' || i END AS text FROM r WHERE kind IS NOT NULL)
  SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY place, part) - 1 AS INTEGER) AS pos, kind, old, new, text FROM s""")  # fmt: skip
def _(fx):
    lines = lambda put: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), put), "\n")
    k = (F.col("turn") % 12 + 1).cast("int")
    old, new = lines(lambda i: F.concat(F.lit("line "), i.cast("string"))), lines(lambda i: F.when(i == k, "other").otherwise(F.concat(F.lit("line "), i.cast("string"))))
    own = fx.table("conversations").select("conv_id", "turn", old.alias("before"), new.alias("after"))
    return R.text_diff(own, "before", "after").select("conv_id", "turn", F.posexplode("rows").alias("pos", "r")).select("conv_id", "turn", "pos", "r.*")


# --- scopes and identity

_SCOPES = ["/home/user/w/a/b", "/home/user/w/a/b/c", "/home/user/w/a/bc", "/home/user/w/a", "/home/user/w", "/home/user", "/home", "/", "/srv/x/y/z", None]
_TIERS = "CASE id % 10 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 9 THEN 2 END"


@query("F11_path_tiers", f"SELECT id, {_TIERS} AS tier, CASE WHEN id % 10 = 9 THEN 2 END AS without_project FROM fx_memory")
def _(fx):
    scope = one_of(_SCOPES, "id")
    return fx.memory.select("id", S.path_tier(scope, "/home/user/w/a/b").alias("tier"), S.path_tier(scope, None).alias("without_project"))


@query("L08_context_ranking", rf"""+ w AS (SELECT memory_id, (sum((score - 1) / 4) + 1.5) / (count(*) + 3) AS weight FROM fx_feedback GROUP BY 1),
  m AS (SELECT m.*, coalesce(weight, 0.5) AS weight, {_TIERS} AS tier, CASE kind WHEN 'lesson' THEN 1 WHEN 'decision' THEN 2 WHEN 'fact' THEN 3 WHEN 'link' THEN 4 ELSE 5 END AS k
    FROM fx_memory m LEFT JOIN w ON w.memory_id = m.id WHERE superseded_by IS NULL AND status = 'confirmed' AND NOT coalesce(regexp_matches(title, '(?i)\b(OBSOLETE|SUPERSEDED|RETIRED)\b'), false))
  SELECT id, kind, tier, weight FROM m WHERE tier IS NOT NULL ORDER BY tier, weight DESC, updated DESC, k, id LIMIT 60""")  # fmt: skip
def _(fx):
    return M.context(fx.memory.withColumn("scope_project", one_of(_SCOPES, "id")), fx.feedback, "/home/user/w/a/b", 60).select("id", "kind", "tier", "weight")


def _content(tool: str) -> str:
    return f"""+ l AS (SELECT session_id, seq, '=' || role || chr(31) || '=' || kind || chr(31) || '=' || sha256(content) || chr(31) || '=' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') || chr(31) || CASE WHEN seq % 2 = 1 THEN '=m' || seq ELSE '!' END || chr(31) || '=n' || seq || chr(31) || '=' || CASE WHEN seq % 3 = 0 THEN 'Read' || chr(30) || 'Bash' ELSE '' END AS line FROM fx_messages),
  b AS (SELECT session_id, string_agg(line, chr(10) ORDER BY seq) AS body FROM l GROUP BY 1)
  SELECT id, sha256({tool} || chr(31) || coalesce('=' || project, '!') || chr(31) || '=' || thread_id || chr(31) || '=' || strftime(created, '%Y-%m-%d %H:%M:%S') || chr(31) || '=' || strftime(updated, '%Y-%m-%d %H:%M:%S') || chr(10) || body) AS content_sha256 FROM fx_sessions JOIN b ON session_id = id"""


@query("D01_content_hash", _content("'=' || tool"))
def _(fx):
    calls = F.when(F.col("seq") % 3 == 0, F.array(F.struct(F.lit("Read").alias("tool")), F.struct(F.lit("Bash").alias("tool"))))
    seq = F.col("seq").cast("string")
    own = fx.messages.withColumns({"model": F.when(F.col("seq") % 2 == 1, F.concat(F.lit("m"), seq)), "native_id": F.concat(F.lit("n"), seq), "tool_calls": calls})
    return A.content_hash(own, fx.sessions)


@query("D02_divergent_copies", """+ i AS (SELECT id, tool, conv_id, sha256('new' || conv_id) AS c, 'ns:h' || (conv_id % 3) AS ns FROM fx_sessions)
  SELECT id, tool, c AS content_sha256, ns AS namespace, o AS outcome, CASE o WHEN 'copy' THEN tool || ':' || split_part(ns, ':', 2) || ':' || id || CASE WHEN conv_id % 8 = 6 THEN '#3' ELSE '#2' END WHEN 'twin' THEN tool || ':' || split_part(ns, ':', 2) || ':' || id || '#2' ELSE id END AS store_id,
  CASE WHEN o IN ('copy', 'twin') THEN id WHEN o <> 'added' AND conv_id % 16 = 3 THEN 'origin' END AS copy_of
  FROM (SELECT *, CASE conv_id % 8 WHEN 0 THEN 'added' WHEN 1 THEN 'refilled' WHEN 2 THEN 'identical' WHEN 3 THEN 'refreshed' WHEN 4 THEN 'refreshed' WHEN 5 THEN 'twin' ELSE 'copy' END AS o FROM i)""")  # fmt: skip
def _(fx):
    # stored by conv_id % 8: nothing; no digest; the same digest elsewhere; other content here; no namespace; a twin under #2; a used #2; other content elsewhere
    kind, name = F.col("conv_id") % 8, F.concat(F.lit("ns:h"), (F.col("conv_id") % 3).cast("string"))
    new = F.sha2(F.concat(F.lit("new"), F.col("conv_id").cast("string")), 256)
    rows = fx.sessions.select("id", "tool", "conv_id", kind.alias("kind"), name.alias("namespace"), new.alias("content_sha256"))
    text = lambda c=None: F.lit(c).cast("string")
    old = rows.filter("kind > 0").select("id", F.when(F.col("kind") == 3, F.col("namespace")).when(F.col("kind") == 4, text()).otherwise("ns:else").alias("namespace"), F.when(F.col("kind") == 1, text()).when(F.col("kind") == 2, F.col("content_sha256")).otherwise("old").alias("content_sha256"), F.when(F.col("conv_id") % 16 == 3, "origin").alias("copy_of"), text().alias("record_id"))
    copy = F.concat_ws(":", "tool", F.substring_index("namespace", ":", -1), F.concat("id", F.lit("#2")))
    twins = rows.filter("kind in (5, 6)").select(copy.alias("id"), "namespace", F.when(F.col("kind") == 5, F.col("content_sha256")).otherwise("third").alias("content_sha256"), F.when(F.col("conv_id") % 2 == 1, F.col("id")).alias("copy_of"), F.col("id").alias("record_id"))
    return A.resolved(rows.select("id", "tool", "namespace", "content_sha256"), old.unionByName(twins))


@query("D04_copies", "SELECT id FROM fx_sessions WHERE conv_id % 4 = 1 ORDER BY id")
def _(fx):
    return A.copies_of(fx.sessions.withColumn("copy_of_session_id", F.when(F.col("conv_id") % 4 == 1, "c0").when(F.col("conv_id") % 4 == 2, "c1")), "c0").select("id")


@query("G23_origins", """+ c AS (SELECT 'n' || (conv_id % 3) AS namespace, tool, origin, count(*) AS n FROM fx_sessions GROUP BY 1, 2, 3), d AS (SELECT namespace FROM c GROUP BY 1 ORDER BY sum(n) DESC, namespace LIMIT 1)
  SELECT *, namespace = (SELECT namespace FROM d) AS dominant FROM c""")  # fmt: skip
def _(fx):
    return A.origins(fx.sessions.withColumn("source_namespace", F.concat(F.lit("n"), (F.col("conv_id") % 3).cast("string"))))


@query("G29_store_fingerprint", """+ r AS (SELECT sha256('=' || id || chr(31) || '=' || strftime(updated, '%Y-%m-%d %H:%M:%S') || chr(31) || '=' || messages_count) AS h FROM fx_sessions)
  SELECT count(*) AS n, sum(CAST('0x' || h[1:12] AS HUGEINT)) || '-' || sum(CAST('0x' || h[13:24] AS HUGEINT)) || '-' || sum(CAST('0x' || h[25:36] AS HUGEINT)) AS fingerprint FROM r""")  # fmt: skip
def _(fx):
    return A.store_fingerprint(fx.sessions)


@query("J12_evidence", """+ e AS (SELECT session_id || '/' || seq AS link_id, session_id, CASE WHEN seq % 4 = 0 THEN seq ELSE seq + 1000 END AS seq, CASE WHEN seq % 4 = 1 THEN 'n' || seq END AS name, CASE WHEN seq % 4 = 3 THEN sha256('gone') ELSE sha256(content) END AS sha FROM fx_messages), t AS (SELECT session_id, sha256(content) AS sha, min(seq) AS at FROM fx_messages GROUP BY 1, 2)
  SELECT link_id, e.session_id, CASE WHEN e.seq < 1000 THEN e.seq WHEN name IS NOT NULL THEN e.seq - 1000 ELSE t.at END AS seq, CASE WHEN e.seq < 1000 THEN 'place' WHEN name IS NOT NULL THEN 'native_id' WHEN t.at IS NOT NULL THEN 'content' ELSE 'unresolved' END AS resolved_by FROM e LEFT JOIN t ON t.session_id = e.session_id AND t.sha = e.sha""")  # fmt: skip
def _(fx):
    seq, m = F.col("seq"), fx.messages.withColumn("native_id", F.concat(F.lit("n"), F.col("seq").cast("string")))
    links = m.select(F.concat_ws("/", "session_id", seq.cast("string")).alias("link_id"), "session_id", F.when(seq % 4 == 0, seq).otherwise(seq + 1000).alias("seq"), F.when(seq % 4 == 1, F.col("native_id")).alias("native_id"), F.when(seq % 4 == 3, F.sha2(F.lit("gone"), 256)).otherwise(F.sha2("content", 256)).alias("sha256"))
    return A.evidence(links, m)


@query("J11_message_identity", "SELECT session_id, seq, CAST(NULL AS VARCHAR) AS native_id, sha256(content) AS sha256, 'r-' || session_id AS source_record_id, 'ns' AS source_namespace FROM fx_messages")
def _(fx):
    s = fx.sessions.withColumns({"source_record_id": F.concat(F.lit("r-"), "id"), "source_namespace": F.lit("ns")})
    return R.message_identity(fx.messages.select("session_id", "seq"), fx.messages, s)


@query("M12_repaired_index", "SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE 'old' END AS body FROM fx_memory UNION ALL SELECT -1, 'x' WHERE false")
def _(fx):
    index = fx.memory.filter("id % 3 <> 0").select("id", F.lit("old").alias("body")).unionAll(fx.memory.select(F.col("id") + 10_000_000, F.lit("orphan")))
    return A.repaired_index(fx.memory.select("id", F.lit("new").alias("body")), index)


@query("K02_metadata_refresh", "SELECT id, CASE WHEN conv_id % 2 = 0 AND conv_id % 3 = 0 THEN title || '!' ELSE title END AS title, CASE WHEN conv_id % 2 = 0 AND conv_id % 3 = 0 THEN 'main' END AS branch FROM fx_sessions")
def _(fx):
    stored = fx.sessions.select("id", "title", F.lit(None).cast("string").alias("branch"), (F.col("conv_id") % 3).cast("string").alias("content_sha256"))
    fresh = fx.sessions.filter("conv_id % 2 = 0").select("id", F.concat("title", F.lit("!")).alias("title"), F.lit("main").alias("branch"), F.lit("0").alias("content_sha256"))
    return A.refreshed(stored, fresh, ["title", "branch"]).select("id", "title", "branch")


@query("U01_U06_union", "SELECT id, CASE WHEN conv_id % 2 = 0 THEN 'codex' ELSE 'aider' END AS tool, CASE WHEN conv_id % 2 = 0 THEN title END AS title FROM fx_sessions")
def _(fx):
    even, odd, none = fx.sessions.filter("conv_id % 2 = 0").select("id", "title"), fx.sessions.filter("conv_id % 2 = 1").select("id"), fx.sessions.select("id")
    return A.union_of({"codex": even, "aider": odd, "cursor": none}, ["codex", "aider"])


@query("U02_hidden_union", "SELECT id FROM fx_deleted UNION SELECT id FROM fx_ignored")
def _(fx):
    return M.hidden_ids(fx.deleted, fx.ignored)


@query("U04_vanished_vectors", "SELECT vec_id AS key FROM embeddings WHERE vec_id % 2 = 0 EXCEPT SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def _(fx):
    return V.vanished(fx.vectors.filter("key % 2 = 0"), fx.table("documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("key")), "key")


@query("J05_missing_vectors", "SELECT d.doc_id AS id FROM documents d ANTI JOIN embeddings e ON e.vec_id = d.doc_id")
def _(fx):
    return M.with_vectors(fx.memory, fx.vectors.select(F.col("key").alias("id"), "embedding"), missing=True).select("id")


@query("J04_with_vectors", "SELECT doc_id AS id, len(embedding) AS width FROM documents JOIN embeddings ON vec_id = doc_id")
def _(fx):
    return M.with_vectors(fx.memory, fx.vectors.select(F.col("key").alias("id"), "embedding")).select("id", F.size("embedding").cast("long").alias("width"))


@query("J09_not_ignored", "SELECT id FROM fx_sessions WHERE id NOT IN (SELECT id FROM fx_ignored)")
def _(fx):
    return S.visible(fx.sessions, ignored=fx.ignored, include_automated=True).select("id")


@query("J13_memory_enriched", """SELECT m.id, CASE WHEN m.id % 2 = 0 THEN ['a', 'b'] ELSE [] END AS tags, coalesce(v.votes, []) AS scores, CASE WHEN m.id % 5 = 0 THEN 1 ELSE 0 END AS n_sources
  FROM fx_memory m LEFT JOIN (SELECT memory_id, list(score ORDER BY rater) AS votes FROM fx_feedback GROUP BY 1) v ON v.memory_id = m.id""")  # fmt: skip
def _(fx):
    tags = fx.memory.filter("id % 2 = 0").select(F.col("id").alias("memory_id"), F.explode(F.array(F.lit("b"), F.lit("a"))).alias("tag"))
    sources = fx.memory.filter("id % 5 = 0").select(F.col("id").alias("memory_id"), F.lit("s").alias("session_id"), F.lit(1).alias("message_seq"))
    return M.enriched(fx.memory, tags, fx.feedback, sources).select("id", F.transform("tags", lambda t: t["tag"]).alias("tags"), F.transform("votes", lambda v: v["score"]).alias("scores"), F.size("sources").alias("n_sources"))


@query("J15_parents", "SELECT c.id, p.id AS parent, p.title AS parent_title FROM fx_sessions c JOIN fx_sessions p ON p.id = CASE WHEN c.parent_session_id = 'c000006' THEN 'c000001' ELSE c.parent_session_id END")
def _(fx):
    return A.with_parents(fx.sessions, fx.spark.createDataFrame([("c000006", "c000001")], "id string, store_id string"))


# --- filters and listings


@query("F07_tag_or_keyword", "SELECT id FROM fx_sessions WHERE conv_id % 3 = 0 OR conv_id % 7 = 1")
def _(fx):
    own = fx.sessions.withColumn("keywords", F.when(F.col("conv_id") % 7 == 1, F.array(F.lit("review"))).when(F.col("conv_id") % 7 == 2, F.array(F.lit("REVIEW"))))
    return S.tagged_or_keyword(own, fx.tags, "review").select("id")


@query("F21_F22_summary_candidates", "SELECT id, updated FROM fx_sessions WHERE origin NOT IN ('exec', 'cron', 'subagent') AND id NOT IN (SELECT id FROM fx_deleted) AND prompt_count >= 3 AND conv_id % 2 = 0 AND updated <= TIMESTAMP '2024-01-04 11:30:00' ORDER BY updated DESC, id LIMIT 20")
def _(fx):
    return S.idle_candidates(fx.sessions.withColumn("messages_synced", F.col("conv_id") % 2 == 0), fx.deleted, "2024-01-04 12:00:00", limit=20).select("id", "updated")


@query("L05_message_window", "SELECT session_id, seq, role FROM fx_messages WHERE session_id = 'c000003' AND seq BETWEEN 1 AND 2 UNION ALL SELECT session_id, seq, role FROM fx_messages WHERE session_id = 'c000002' AND seq BETWEEN 0 AND 1")
def _(fx):
    own = R.message_window(fx.messages, "c000003", 2, offset=1).unionByName(R.message_window(fx.messages, "c000002", 2, around=1))
    return own.select("session_id", "seq", "role")


@query("L07_recent_of_project", "SELECT id FROM fx_sessions WHERE project = '/work/p2' ORDER BY updated DESC, id LIMIT 3")
def _(fx):
    return S.recent_of(fx.sessions, "/work/p2").select("id")


@query("W10_day_groups", """+ p AS (SELECT id, CAST(updated AS DATE) AS day, row_number() OVER (ORDER BY updated DESC, id) AS n FROM fx_sessions ORDER BY n LIMIT 60)
  SELECT id, day, coalesce(day <> lag(day) OVER (ORDER BY n), true) AS header FROM p""")  # fmt: skip
def _(fx):
    return S.day_headers(S.page(fx.sessions, S.newest_first(), 1, 60)).select("id", "day", "header")


@query("G15_thread_tools", """+ r AS (SELECT thread_id, tool, id, title, CAST(row_number() OVER (PARTITION BY thread_id, tool ORDER BY updated DESC, id) AS INTEGER) AS rank FROM fx_sessions) SELECT * FROM r WHERE rank <= 5""")
def _(fx):
    return R.thread_tools(fx.sessions)


# --- aggregates


@query("G04_token_series", """+ d AS (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-01-23', INTERVAL 1 DAY)) AS DATE) AS day), c AS (SELECT CAST(updated AS DATE) AS day, sum(coalesce(total_tokens, 0)) AS n FROM fx_sessions GROUP BY 1)
  SELECT CAST(day AS VARCHAR) AS key, CAST(coalesce(n, 0) AS BIGINT) AS n FROM d LEFT JOIN c USING (day) UNION ALL SELECT * FROM (SELECT coalesce(project, 'Unassigned'), count(*) AS k FROM fx_sessions GROUP BY 1 ORDER BY k DESC, 1 LIMIT 10)""")  # fmt: skip
def _(fx):
    days = G.token_series(fx.sessions, "2023-12-25", "2024-01-23").select(F.col("day").cast("string").alias("key"), F.col("tokens").alias("n"))
    return days.unionAll(G.commonest(fx.sessions, "project"))


@query("G05_basic_stats", """SELECT count(*) AS sessions, CAST(sum(messages_count) AS BIGINT) AS messages, round_even(avg(messages_count), 1) AS mean_messages, min(CAST(created AS DATE)) AS first_day, max(CAST(updated AS DATE)) AS last_day,
  count(*) FILTER (updated >= TIMESTAMP '2024-01-04 00:00:00' - INTERVAL 7 DAY) AS last_week, count(*) FILTER (updated >= TIMESTAMP '2024-01-04 00:00:00' - INTERVAL 30 DAY) AS last_month FROM fx_sessions""")  # fmt: skip
def _(fx):
    return G.basic_stats(fx.sessions, "2024-01-04 00:00:00")


@query("G12_combined_metrics", "SELECT origin AS name, 'observed' AS kind, CAST(count(*) + count(*) FILTER (conv_id % 2 = 0) AS BIGINT) AS value, CAST(least(count(*), 3) AS BIGINT) AS covered, count(*) AS total, round_even(least(count(*), 3) / count(*), 4) AS coverage FROM fx_sessions GROUP BY 1 HAVING count(*) FILTER (conv_id % 2 = 0) > 0")
def _(fx):
    def metric(df, covered):
        return df.groupBy(F.col("origin").alias("name")).agg(F.lit("observed").alias("kind"), F.count("*").alias("value"), covered.alias("covered"), F.count("*").alias("total"))

    return G.combined(metric(fx.sessions, F.count("*")), metric(fx.sessions.filter("conv_id % 2 = 0"), F.lit(3).cast("long")))


@query("G17_top_tags", """+ k AS (SELECT id, [lower(title), tool, CASE WHEN conv_id % 2 = 0 THEN 'review' ELSE 'other' END] AS ks FROM fx_sessions), w AS (SELECT unnest(ks[1:2]) AS tag FROM k)
  SELECT tag, CAST(sum(n) AS BIGINT) AS score FROM (SELECT tag, count(*) AS n FROM w GROUP BY 1 UNION ALL SELECT tag, count(DISTINCT session_id) + 1 FROM fx_tags GROUP BY 1) GROUP BY 1 ORDER BY score DESC, tag LIMIT 12""")  # fmt: skip
def _(fx):
    own = fx.sessions.withColumn("keywords", F.array(F.lower("title"), F.col("tool"), F.when(F.col("conv_id") % 2 == 0, "review").otherwise("other")))
    return G.top_tags(own, fx.tags, 12, 2)


@query("G24_message_coverage", "SELECT session_id, count(*) AS n, min(seq) AS first, max(seq) AS last FROM fx_messages GROUP BY 1")
def _(fx):
    return G.message_coverage(fx.messages)


@query("G26_audit", "SELECT coalesce(a.tool, b.tool) AS tool, coalesce(a.n, 0) AS indexed, coalesce(b.n, 0) AS live FROM (SELECT tool, count(*) AS n FROM fx_sessions WHERE conv_id % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT tool, count(*) AS n FROM fx_sessions WHERE conv_id % 5 < 4 GROUP BY 1) b ON a.tool = b.tool")
def _(fx):
    return G.audit(fx.sessions.filter("conv_id % 2 = 0"), fx.sessions.filter("conv_id % 5 < 4"))


@query("I12_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, name, count(*) AS n, sum(duration_ms) AS total FROM fx_tool_events GROUP BY 1, 2")
def _(fx):
    return I.windows(fx.tool_events, "1 hour", "10 minutes")


# --- search and recall

_TOKS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"


@query("X04_X05_bm25", rf"""+ d AS (SELECT CAST(doc_id AS VARCHAR) AS doc, {_TOKS.format('text')} AS toks FROM documents), t AS (SELECT doc, len(toks) AS dl, unnest(toks) AS term FROM d), s AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM d),
  h AS (SELECT doc, q, any_value(dl) AS dl, count(*) AS tf FROM t JOIN (SELECT unnest(['the', 'inti']) AS q) ON starts_with(term, q) GROUP BY 1, 2), f AS (SELECT q, count(*) AS df FROM h GROUP BY 1),
  c AS (SELECT doc, -(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS sc FROM h JOIN f USING (q), s)
  SELECT doc, sum(sc) AS score FROM c GROUP BY 1 HAVING count(*) = 2 ORDER BY score, doc LIMIT 50""")  # fmt: skip
def _(fx):
    return X.scanned(fx.table("documents"), "doc_id", F.col("text"), X.parse("the inti", stemmed=False), 50)


_RECALL = rf"""+ d AS (SELECT 'memory:' || id AS doc, {_TOKS.format("title || ' ' || body")} AS toks FROM fx_memory UNION ALL SELECT session_id, {_TOKS.format("string_agg(content, ' ' ORDER BY seq)")} FROM fx_messages GROUP BY session_id),
  s AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM d), t AS (SELECT doc, len(toks) AS dl, unnest(toks) AS term FROM d), h AS (SELECT doc, q, any_value(dl) AS dl, count(*) AS tf FROM t JOIN (SELECT unnest(['der', 'und']) AS q) ON starts_with(term, q) GROUP BY 1, 2),
  f AS (SELECT q, count(*) AS df FROM h GROUP BY 1), c AS (SELECT doc, -(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS sc FROM h JOIN f USING (q), s),
  k AS (SELECT m.id, sum(sc) AS score FROM c JOIN fx_memory m ON doc = 'memory:' || m.id WHERE superseded_by IS NULL AND status = 'confirmed' AND kind = 'lesson' GROUP BY 1 HAVING count(*) = 2 ORDER BY score, id LIMIT 15)"""


def _recalled(fx, semantic, limit=15):
    memory = fx.memory.select(F.concat(F.lit("memory:"), F.col("id").cast("string")).alias("doc"), F.concat_ws(" ", "title", "body").alias("text"))
    docs = memory.unionAll(R.body_text(fx.messages.withColumn("content", F.coalesce("content", F.lit(""))), 1 << 30, " "))
    vectors = fx.vectors.select(F.col("key").alias("id"), "embedding")
    vector = fx.vectors.filter("key = 100").first()["embedding"]
    return M.recalled(fx.memory, lambda query: X.scan_hits(docs, "doc", F.coalesce("text", F.lit("")), query), "der und", limit=limit, vectors=vectors, vector=vector, semantic=semantic, stemmed=False, floor=0.1, kind="lesson")


@query("X13_J02_memory_recall", _RECALL + " SELECT id, score FROM k")
def _(fx):
    return _recalled(fx, False)


_NEAR = """v AS (SELECT m.id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM fx_vectors WHERE key = 100)) AS sim FROM fx_memory m JOIN fx_vectors ON key = m.id WHERE superseded_by IS NULL AND status = 'confirmed' AND kind = 'lesson')"""


@query("V07_semantic_recall", f"+ {_NEAR} SELECT id, sim AS score FROM v ORDER BY sim DESC, id LIMIT 15")
def _(fx):
    return _recalled(fx, True)


@query("V11_hybrid_recall", _RECALL + f""", {_NEAR}, z AS (SELECT id FROM v WHERE sim >= 0.1 ORDER BY sim DESC, id LIMIT 15), r AS (SELECT id, row_number() OVER (ORDER BY score, id) - 1 AS p FROM k UNION ALL SELECT id, row_number() OVER (ORDER BY sim DESC, id) - 1 FROM (SELECT * FROM v JOIN z USING (id)))
  SELECT id, sum(1.0 / (60 + p)) AS score FROM r GROUP BY 1 ORDER BY score DESC, id LIMIT 15""")  # fmt: skip
def _(fx):
    return _recalled(fx, None)


@query("V05_J03_message_vectors", """+ q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM fx_vectors WHERE key = 100), m AS (SELECT *, row_number() OVER (ORDER BY session_id, seq) - 1 AS k FROM fx_messages),
  d AS (SELECT m.*, list_distance(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)) AS distance FROM m JOIN fx_vectors ON key = k WHERE k % 3 > 0)
  SELECT session_id, seq, role, distance, left(trim(content), 400) AS excerpt, length(trim(content)) > 400 AS truncated FROM d JOIN fx_sessions ON id = session_id WHERE distance <= 1.5 AND origin NOT IN ('exec', 'cron', 'subagent') AND id NOT IN (SELECT id FROM fx_ignored) ORDER BY distance, session_id, seq LIMIT 20""")  # fmt: skip
def _(fx):
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("session_id", "seq")) - 1  # numbers a test table
    digest = F.when(F.col("k") % 3 > 0, F.sha2(F.substring("content", 1, 20_000), 256)).otherwise("stale")
    own = fx.messages.withColumn("k", place.cast("long")).join(fx.vectors, F.col("k") == F.col("key")).select("session_id", "seq", digest.alias("content_hash"), "embedding")
    return V.nearest_messages(own, fx.messages, S.visible(fx.sessions, ignored=fx.ignored), fx.vectors.filter("key = 100").first()["embedding"], 20, 1.5)


# --- memory and reviews


@query("M06_tag_changes", "SELECT id AS session_id, 'review' AS tag FROM fx_sessions WHERE conv_id % 3 = 0 AND conv_id % 2 = 1 UNION SELECT id, 'urgent' FROM fx_sessions WHERE conv_id % 4 = 0 UNION SELECT id, 'new one' FROM fx_sessions WHERE conv_id % 5 = 0")
def _(fx):
    added = fx.sessions.filter("conv_id % 5 = 0").select(F.col("id").alias("session_id"), F.lit("  New One ").alias("tag")).unionAll(fx.sessions.select("id", F.lit(" ")))
    return M.tag_changes(fx.tags, added, fx.sessions.filter("conv_id % 2 = 0").select(F.col("id").alias("session_id"), F.lit("Review").alias("tag")))


@query("M07_tombstones", "SELECT id, CASE WHEN id IN (SELECT id FROM fx_deleted) THEN 1 ELSE 2 END AS at FROM (SELECT id FROM fx_deleted UNION SELECT id FROM fx_ignored)")
def _(fx):
    both = fx.deleted.unionAll(fx.ignored).select("id", F.lit(2).alias("at"))
    return M.tombstones(fx.deleted.select("id", F.lit(1).alias("at")), both)


@query("M08_saved_and_cascade", "SELECT session_id, CASE WHEN conv_id % 3 = 0 THEN 'new' ELSE 'old' END AS text FROM (SELECT id AS session_id, conv_id FROM fx_sessions) WHERE session_id <> 'c000003' AND conv_id % 11 <> 5")
def _(fx):
    children = F.when(F.col("conv_id") % 11 == 5, F.array(F.lit("c000001"), F.lit("c000003")))
    rows = fx.sessions.select(F.col("id").alias("session_id"), F.lit("old").alias("text"), F.lit(1).alias("created"), children.alias("children"))
    new = fx.sessions.filter("conv_id % 3 = 0").select(F.col("id").alias("session_id"), F.lit("new").alias("text"), F.lit(2).alias("created"), children.alias("children"))
    return M.without_session(M.saved(rows, new, "session_id"), "c000003").select("session_id", "text")


@query("M09_H02_source_states", "SELECT tool AS source, origin AS state, count(*) AS n, min(updated) AS first, max(updated) AS last FROM fx_sessions GROUP BY 1, 2")
def _(fx):
    return M.source_states(fx.sessions.select(F.col("tool").alias("source"), F.col("origin").alias("state"), F.col("updated").alias("at")))


@query("H03_undecoded", "SELECT doc_id AS id FROM documents WHERE doc_id % 4 <> 0")
def _(fx):
    own = fx.table("documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("captured_at"), F.when(F.col("doc_id") % 4 == 0, 1).alias("decoded_at"))
    return M.undecoded(own).select("id")


@query("U05_merged_recommendations", """SELECT id, CASE WHEN conv_id % 3 < 2 THEN 'fresh' ELSE 'stored' END AS text, CASE WHEN conv_id % 3 > 0 THEN 'active' ELSE 'inactive' END AS state, CASE WHEN conv_id % 3 > 0 THEN 1 ELSE 2 END AS created_at,
  CASE conv_id % 3 WHEN 0 THEN '/a=new,/b=new' WHEN 1 THEN '/a=old,/b=new,/z=old' ELSE '/a=old,/z=old' END AS evidence FROM fx_sessions""")  # fmt: skip
def _(fx):
    links = lambda note, *paths: F.array(*(F.struct(F.lit(p).alias("permalink"), F.lit(note).alias("note")) for p in paths)).alias("evidence")
    stored = fx.sessions.filter("conv_id % 3 > 0").select("id", F.lit("stored").alias("text"), F.lit("active").alias("state"), F.lit(1).alias("created_at"), links("old", "/z", "/a"))
    fresh = fx.sessions.filter("conv_id % 3 < 2").select("id", F.lit("fresh").alias("text"), F.lit("inactive").alias("state"), F.lit(2).alias("created_at"), links("new", "/b", "/a"))
    out = M.merged_recommendations(stored, fresh)
    return out.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: F.concat_ws("=", e["permalink"], e["note"])), ","))


@query("M13_reviews", """SELECT id, CASE WHEN conv_id % 3 = 0 THEN 'active' ELSE 'inactive' END AS state, CASE WHEN conv_id % 3 = 0 THEN 'second' END AS activated_by, CASE WHEN conv_id % 3 = 0 THEN 5 END AS activated_at, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS evaluations FROM fx_sessions""")
def _(fx):
    log = lambda rows, event, by, at: rows.select("id", F.lit(event).alias("event"), F.lit(by).alias("by"), F.lit(at).alias("at"))
    third, even = fx.sessions.filter("conv_id % 3 = 0"), fx.sessions.filter("conv_id % 2 = 0")
    events = log(third, "activated", "first", 3).unionAll(log(third, "activated", "second", 5)).unionAll(log(even, "useful", "third", 9))
    return M.reviewed(fx.sessions.select("id", F.lit("inactive").alias("state")), events).select("id", "state", "activated_by", "activated_at", F.col("evaluations").cast("int").alias("evaluations"))


@query("P08_recommendations", """SELECT substr(sha256(sentence), 1, 16) AS id, sentence, 2 AS score, CASE WHEN sentence = 'You should always check this first.' THEN 'global' ELSE 'project:/work/p2' END AS scope,
  CASE WHEN sentence = 'You should always check this first.' THEN (SELECT min('/session/' || session_id || '/m/' || seq) FROM fx_messages WHERE role = 'assistant') ELSE (SELECT min('/session/' || session_id || '/m/' || seq) FROM fx_messages JOIN fx_sessions ON id = session_id WHERE role = 'assistant' AND project = '/work/p2') END AS evidence
  FROM (SELECT unnest(['You should always check this first.', 'You must never skip the tests here.']) AS sentence)""")  # fmt: skip
def _(fx):
    second = fx.sessions.select(F.col("id").alias("session_id"), F.when(F.col("project") == "/work/p2", " You must never skip the tests here.").otherwise("").alias("more"))
    own = fx.messages.join(second, "session_id").withColumn("content", F.concat(F.lit("You should always check this first."), "more"))
    return P.recommendations(own, fx.sessions)


@query("P01_K08_redacted", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'key [REDACTED:aws_access_key] end' WHEN 1 THEN 'password="[REDACTED:secret_assignment]"' WHEN 2 THEN 'Authorization: Bearer [REDACTED:bearer_token]' WHEN 3 THEN 'https://u:[REDACTED:url_password]@h/' WHEN 4 THEN 'api_key = os.environ["K"]'
  WHEN 5 THEN 'Cookie: [REDACTED:cookie]' WHEN 6 THEN 'a [REDACTED:npm_token] and [REDACTED:github_token]' ELSE 'plain ' || event_type END AS text, CASE event_id % 8 WHEN 4 THEN 0 WHEN 6 THEN 2 WHEN 7 THEN 0 ELSE 1 END AS n FROM events""")  # fmt: skip
def _(fx):
    tail = F.lpad(F.col("event_id").cast("string"), 16, "A")
    text = F.element_at(F.array(
        F.concat(F.lit("key AKIA"), tail, F.lit(" end")), F.concat(F.lit('password="x'), tail, F.lit('"')), F.concat(F.lit("Authorization: Bearer z"), tail), F.concat(F.lit("https://u:q"), tail, F.lit("@h/")), F.lit('api_key = os.environ["K"]'),
        F.concat(F.lit("Cookie: s="), tail), F.concat(F.lit("a npm_"), tail, tail, F.lit("BBBB and ghp_"), tail, tail, F.lit("CCCC")), F.concat(F.lit("plain "), "event_type"),
    ), (F.col("event_id") % 8).cast("int") + 1)
    return fx.table("events").select("event_id", redacted(text).alias("r")).select("event_id", F.col("r.text").alias("text"), F.col("r.count").alias("n"))


# --- bundles

_H = "CASE WHEN conv_id % 3 = 0 AND conv_id % 2 = 0 THEN 'same' ELSE 'other' END"
_STORE = "CASE WHEN conv_id % 3 = 0 AND conv_id % 2 = 1 THEN tool || ':b:' || id || '#2' ELSE id END"


@query("M11_J16_merged", f"""+ s AS (SELECT id, conv_id, tool, {_STORE} AS store_id, parent_session_id FROM fx_sessions)
  SELECT s.store_id AS id, s.id AS source_record_id, CASE WHEN s.conv_id % 3 = 0 THEN s.id END AS copy_of_session_id, p.store_id AS parent_session_id, m.n AS messages FROM s LEFT JOIN s p ON p.id = s.parent_session_id LEFT JOIN (SELECT session_id, count(*) AS n FROM fx_messages GROUP BY 1) m ON m.session_id = s.id WHERE NOT (s.conv_id % 3 = 0 AND s.conv_id % 2 = 0)""")  # fmt: skip
def _(fx):
    s, text = fx.sessions, F.lit(None).cast("string")
    own = s.filter("conv_id % 3 = 0").select("id", F.lit("ns:a").alias("source_namespace"), F.lit("same").alias("content_sha256"), text.alias("copy_of_session_id"), text.alias("source_record_id"))
    new = s.select("id", "tool", F.when((F.col("conv_id") % 3 == 0) & (F.col("conv_id") % 2 == 0), "same").otherwise("other").alias("content_sha256"), "parent_session_id")
    sessions, messages, _ = A.merged(own, fx.messages.limit(0), new, fx.messages, "ns:b")
    counts = messages.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("messages"))
    return sessions.join(counts, "id", "left").select("id", "source_record_id", "copy_of_session_id", "parent_session_id", "messages")


@query("M11_merged_memory", """+ m AS (SELECT id, lower(title) AS a, body, kind, coalesce(scope_project, '') AS p, coalesce(scope_tool, '') AS t FROM fx_memory), o AS (SELECT * FROM m WHERE id % 2 = 0), f AS (SELECT min(id) AS id FROM m WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.a = m.a AND o.body = m.body AND o.kind = m.kind AND o.p = m.p AND o.t = m.t) GROUP BY a, body, kind, p, t)
  SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY f.id) AS id, sha256(fx_memory.body) AS body FROM f JOIN fx_memory USING (id)""")  # fmt: skip
def _(fx):
    return A.merged_memory(fx.memory.filter("id % 2 = 0"), fx.memory).select("id", F.sha2("body", 256).alias("body"))


@query("K09_K10_D08_damage", "SELECT * FROM (VALUES ('deleted', 'missing'), ('ignored', 'not listed'), ('memory', 'fields'), ('messages', 'count'), ('sessions', 'content')) t(name, problem)")
def _(fx):
    tables = {"sessions": fx.sessions, "messages": fx.messages, "memory": fx.memory, "tags": fx.tags}
    manifest = sinks.described(tables | {"deleted": fx.deleted})
    found = tables | {"ignored": fx.ignored, "sessions": fx.sessions.withColumn("title", F.when(F.col("conv_id") == 3, "other").otherwise(F.col("title"))), "messages": fx.messages.filter("conv_id <> 3"), "memory": fx.memory.drop("kind")}
    return A.problems(found, manifest)
