"""The operators as named queries over the derived tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import columns as C
from heddle.operators import aggregates as G
from heddle.operators import archive as A
from heddle.operators import memory as M
from heddle.operators import ordered as O
from heddle.operators import search as X
from heddle.operators import vectors as V
from heddle.operators import visibility as S
from heddle.plans.fixtures import CTE, Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query over Fixtures, and its SQL over the same derived tables (fx_...)."""

    def register(f: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            SQL[name] = f"WITH {'RECURSIVE ' if 'UNION ALL SELECT m.session_id' in sql else ''}{CTE.strip()}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().lstrip('+')}"
        return f

    return register


_VISIBLE = "origin NOT IN ('exec', 'cron', 'subagent') AND id NOT IN (SELECT id FROM fx_deleted) AND id NOT IN (SELECT id FROM fx_ignored)"
_SINCE, _UNTIL = "2024-01-02", "2024-01-04"
_WINDOW = "coalesce(updated, created) BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-04 23:59:59.999999'"


# --- filters


@query("F06_visible_sessions", f"SELECT id, tool, origin FROM fx_sessions WHERE {_VISIBLE}")
def _(fx):
    return S.visible(fx.sessions, fx.deleted, fx.ignored).select("id", "tool", "origin")


@query("F03_F05_listing_filters", f"SELECT id, project FROM fx_sessions WHERE contains(project, 'p3') AND created BETWEEN TIMESTAMP '{_SINCE} 00:00:00' AND TIMESTAMP '{_UNTIL} 23:59:59.999999' AND {_VISIBLE}")
def _(fx):
    return S.listed(S.visible(fx.sessions, fx.deleted, fx.ignored), project="p3", since=_SINCE, until=_UNTIL).select("id", "project")


@query("F04_J08_tag_filter", "SELECT id, title FROM fx_sessions s WHERE EXISTS (SELECT 1 FROM fx_tags t WHERE t.session_id = s.id AND t.tag = 'review')")
def _(fx):
    return S.tagged(fx.sessions, fx.tags, "Review").select("id", "title")


@query("F01_import_gate", "SELECT id, (prompt_count >= 3 OR origin IN ('exec', 'cron', 'subagent')) AND (messages_count >= 3 OR coalesce(total_tokens, 0) >= 2048) AS ok FROM fx_sessions")
def _(fx):
    return fx.sessions.select("id", S.importable(F.coalesce("total_tokens", F.lit(0)), 3, 3, 2048).alias("ok"))


@query("F08_F09_memory_filter", "SELECT id, kind FROM fx_memory WHERE superseded_by IS NULL AND status = 'confirmed' AND kind = 'lesson' AND scope_project IS NOT DISTINCT FROM 'src2'")
def _(fx):
    return M.active(fx.memory, "lesson", "src2").select("id", "kind")


@query("F10_retired_marker", r"SELECT conv_id, turn, regexp_matches(text, '(?i)\b(OBSOLETE|SUPERSEDED|RETIRED)\b') AS retired FROM conversations")
def _(fx):
    return fx.table("conversations").select("conv_id", "turn", S.retired(F.col("text")).alias("retired"))


# --- aggregates


@query("G01_archive_stats", """SELECT 'sessions' AS part, '' AS key, count(*) AS n FROM fx_sessions UNION ALL SELECT 'messages', '', CAST(sum(messages_count) AS BIGINT) FROM fx_sessions
  UNION ALL SELECT 'tool', tool, count(*) FROM fx_sessions GROUP BY tool UNION ALL SELECT 'project', project, count(*) FROM fx_sessions WHERE project <> '' GROUP BY project""")  # fmt: skip
def _(fx):
    return G.archive_stats(fx.sessions)


for _by, _key in (("day", "CAST(CAST(coalesce(updated, created) AS DATE) AS VARCHAR)"), ("tool", "tool"), ("project", "coalesce(project, 'Unassigned')")):

    @query(f"G02_digest_by_{_by}", f"SELECT {_key} AS key, count(*) AS sessions, CAST(sum(messages_count) AS BIGINT) AS messages, CAST(sum(prompt_count) AS BIGINT) AS prompts FROM fx_sessions WHERE {_VISIBLE} AND {_WINDOW} GROUP BY 1")
    def _(fx, by=_by):
        return G.digest_by(S.visible(fx.sessions, fx.deleted, fx.ignored), _SINCE, _UNTIL, by)


@query("G02_digest_totals", f"""+ d AS (SELECT CAST(CAST(coalesce(updated, created) AS DATE) AS VARCHAR) AS key, count(*) AS s, sum(messages_count) AS m, sum(prompt_count) AS p FROM fx_sessions WHERE {_VISIBLE} AND {_WINDOW} GROUP BY 1)
  SELECT CAST(coalesce(sum(s), 0) AS BIGINT) AS sessions, CAST(coalesce(sum(m), 0) AS BIGINT) AS messages, CAST(coalesce(sum(p), 0) AS BIGINT) AS prompts, (SELECT key FROM d ORDER BY s DESC, key LIMIT 1) AS busiest_day FROM d""")  # fmt: skip
def _(fx):
    return G.digest_totals(S.visible(fx.sessions, fx.deleted, fx.ignored), _SINCE, _UNTIL)


@query("G03_daily_series", """+ d AS (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-01-23', INTERVAL 1 DAY)) AS DATE) AS day),
  c AS (SELECT CAST(coalesce(updated, created) AS DATE) AS day, count(*) AS n FROM fx_sessions GROUP BY 1), j AS (SELECT day, coalesce(n, 0) AS sessions FROM d LEFT JOIN c USING (day))
  SELECT CAST(day AS VARCHAR) AS day, sessions, sessions / greatest(1, (SELECT max(sessions) FROM j)) AS share FROM j""")  # fmt: skip
def _(fx):
    return G.daily_series(fx.sessions, "2023-12-25", "2024-01-23")


@query("G04_token_costs", """SELECT 'total' AS part, '' AS key, CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) AS tokens, count(*) AS sessions FROM fx_sessions
  UNION ALL SELECT 'has_tokens', CASE WHEN coalesce(total_tokens, 0) > 0 THEN 'yes' ELSE 'no' END, CAST(sum(coalesce(total_tokens, 0)) AS BIGINT), count(*) FROM fx_sessions GROUP BY 2
  UNION ALL SELECT 'tool', tool, CAST(sum(coalesce(total_tokens, 0)) AS BIGINT), count(*) FROM fx_sessions GROUP BY 2
  UNION ALL SELECT 'project', coalesce(project, 'Unassigned'), CAST(sum(coalesce(total_tokens, 0)) AS BIGINT), count(*) FROM fx_sessions GROUP BY 2""")  # fmt: skip
def _(fx):
    return G.token_costs(fx.sessions)


@query("G06_session_tokens", """SELECT session_id, CASE WHEN sum(length(content)) = 0 THEN NULL ELSE CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(content) ELSE length(content) + 1 END), 0) AS BIGINT) END AS total_tokens FROM fx_messages GROUP BY 1""")
def _(fx):
    n = F.length("content").cast("bigint")
    own = fx.messages.withColumn("tokens", F.when(F.col("role") == "assistant", F.create_map(F.lit("total"), n)).otherwise(F.create_map(F.lit("input"), n, F.lit("output_tokens"), F.lit(1).cast("bigint"))))
    return G.session_tokens(own)


@query("G07_sessions_by_origin", "SELECT origin, count(*) AS n, round_even((SELECT count(*) FROM fx_sessions WHERE origin <> 'unknown') / (SELECT count(*) FROM fx_sessions), 4) AS coverage FROM fx_sessions WHERE origin <> 'unknown' GROUP BY origin")
def _(fx):
    return G.sessions_by_origin(fx.sessions)


@query("G08_means", "SELECT round_even(avg(messages_count), 4) AS messages_per_session, round_even(avg(prompt_count), 4) AS prompts_per_session, count(*) AS sessions FROM fx_sessions")
def _(fx):
    return G.means_over_messages(fx.messages)


_OUTCOME = "CASE WHEN is_error THEN 'failed' WHEN status IN ('error', 'failed', 'failure', 'fail') THEN 'failed' WHEN status IN ('success', 'succeeded', 'ok', 'completed', 'complete', 'passed') THEN 'ok' END"


@query("G09_failure_rate", f"""+ o AS (SELECT session_id, {_OUTCOME} AS outcome FROM fx_tool_events)
  SELECT count(*) FILTER (outcome = 'failed') AS failed, count(outcome) AS classified, round_even(count(*) FILTER (outcome = 'failed') / count(outcome), 4) AS rate, count(DISTINCT session_id) FILTER (outcome IS NOT NULL) AS sessions FROM o""")  # fmt: skip
def _(fx):
    return G.failure_rate(fx.tool_events)


@query("G10_median_duration", "SELECT median((epoch_us(updated) - epoch_us(created)) / 1e6) AS median_seconds, count(*) AS sessions FROM fx_sessions WHERE updated >= created")
def _(fx):
    return G.median_duration(fx.sessions)


@query("G11_inferred_outcomes", r"""+ l AS (SELECT session_id, ' ' || regexp_replace(lower(arg_max(content, seq)), '[^\p{L}\p{N}]', ' ', 'g') || ' ' AS t FROM fx_messages WHERE role = 'assistant' AND trim(content) <> '' GROUP BY 1),
  m AS (SELECT regexp_matches(t, ' (done|complete|completed|fixed|passing|resolved|implemented) ') AS g, regexp_matches(t, ' (error|failed|cannot|unable|blocked|not working) ') AS b FROM l)
  SELECT CASE WHEN g AND NOT b THEN 'success' WHEN b AND NOT g THEN 'failure' ELSE 'unclassified' END AS outcome, count(*) AS n FROM m GROUP BY 1""")  # fmt: skip
def _(fx):
    return G.inferred_outcomes(fx.messages)


@query("G13_projects_overview", """+ s AS (SELECT *, coalesce(project, 'Unassigned') AS p, coalesce(updated, created) AS moment FROM fx_sessions),
  t AS (SELECT p, string_agg(tool || '=' || n, ',' ORDER BY n DESC, tool) AS tools FROM (SELECT p, tool, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY p),
  r AS (SELECT p, string_agg(id, ',' ORDER BY k) AS recent FROM (SELECT p, id, row_number() OVER (PARTITION BY p ORDER BY moment DESC, id) AS k FROM s) WHERE k <= 3 GROUP BY p)
  SELECT p AS project, count(*) AS sessions, CAST(sum(CASE WHEN prompt_count > 0 THEN prompt_count ELSE messages_count END) AS BIGINT) AS prompts, max(moment) AS last_updated, any_value(tools) AS tools, any_value(recent) AS recent
  FROM s JOIN t USING (p) JOIN r USING (p) GROUP BY p""")  # fmt: skip
def _(fx):
    return G.projects_overview(fx.sessions)


@query("G14_threads_overview", """+ r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY updated DESC, id DESC) AS k, count(*) OVER (PARTITION BY thread_id) AS n FROM fx_sessions)
  SELECT thread_id, n AS sessions, updated AS latest, title, project FROM r WHERE k = 1""")  # fmt: skip
def _(fx):
    return G.threads_overview(fx.sessions)


@query("G18_tag_counts", "SELECT tag, count(DISTINCT session_id) AS sessions FROM fx_tags GROUP BY tag")
def _(fx):
    return G.tag_counts(fx.tags)


@query("G19_tags_by_session", "SELECT session_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM fx_tags GROUP BY session_id")
def _(fx):
    return G.tags_by_session(fx.tags)


@query("G20_state_counts", "SELECT o.origin, count(s.id) AS n FROM (SELECT unnest(['interactive', 'exec', 'cron', 'subagent', 'unknown']) AS origin) o LEFT JOIN fx_sessions s USING (origin) GROUP BY 1")
def _(fx):
    return G.state_counts(fx.sessions, "origin", ("interactive", "exec", "cron", "subagent", "unknown"))


@query("G21_job_progress", """+ c AS (SELECT session_id AS job_id, CASE role WHEN 'assistant' THEN 'complete' WHEN 'system' THEN 'failed' ELSE 'pending' END AS status FROM fx_messages)
  SELECT job_id, count(*) AS chunks, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'failed') AS failed, CAST(round_even(100 * count(*) FILTER (status = 'complete') / count(*), 0) AS INTEGER) AS percent FROM c GROUP BY 1""")  # fmt: skip
def _(fx):
    return G.job_progress(fx.messages.select(F.col("session_id").alias("job_id"), F.when(F.col("role") == "assistant", "complete").when(F.col("role") == "system", "failed").otherwise("pending").alias("status")))


@query("G22_feedback_weight", "SELECT memory_id, (sum((score - 1) / 4) + 1.5) / (count(*) + 3) AS weight, count(*) AS votes FROM fx_feedback GROUP BY 1")
def _(fx):
    return G.feedback_weight(fx.feedback)


@query("G27_best_threshold", """+ p AS (SELECT CAST(quality * 10 + doc_id % 13 AS DOUBLE) AS score, quality = 1 AS related FROM labels), s AS (SELECT DISTINCT score FROM p),
  a AS (SELECT s.score, round_even((count(*) FILTER (related AND p.score >= s.score) / count(*) FILTER (related) + count(*) FILTER (NOT related AND p.score < s.score) / count(*) FILTER (NOT related)) / 2, 6) AS accuracy FROM s, p GROUP BY 1)
  SELECT score, accuracy FROM a ORDER BY accuracy DESC, score LIMIT 1""")  # fmt: skip
def _(fx):
    return G.best_threshold(fx.table("labels").filter("quality is not null").select((F.col("quality") * 10 + F.col("doc_id") % 13).cast("double").alias("score"), (F.col("quality") == 1).alias("related")))


# --- joins, sets, listing


@query("J10_latest_message", "SELECT s.id, m.seq, m.role FROM fx_sessions s LEFT JOIN (SELECT session_id, max(seq) AS seq, arg_max(role, seq) AS role FROM fx_messages GROUP BY 1) m ON m.session_id = s.id")
def _(fx):
    return fx.sessions.select("id").join(A.latest_of(fx.messages, "session_id", "seq", ["seq", "role"]), F.col("id") == F.col("session_id"), "left").select("id", "seq", "role")


@query("J18_prior_and_fresh", """SELECT coalesce(f.id, p.id) AS id, coalesce(f.title, p.title) AS title FROM (SELECT id, title FROM fx_sessions WHERE conv_id % 2 = 0) p FULL JOIN (SELECT id, title || '!' AS title FROM fx_sessions WHERE conv_id % 3 = 0) f ON p.id = f.id""")
def _(fx):
    fresh = fx.sessions.filter("conv_id % 3 = 0").withColumn("title", F.concat("title", F.lit("!")))
    return A.full_merge(fx.sessions.filter("conv_id % 2 = 0"), fresh, "id", ["title"])


@query("J14_calls_and_results", """+ c AS (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM fx_messages WHERE role = 'user'), r AS (SELECT session_id, seq AS result_at, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM fx_messages WHERE role = 'assistant')
  SELECT session_id, seq, result_at FROM c LEFT JOIN r USING (session_id, n)""")  # fmt: skip
def _(fx):
    m = fx.messages.select("session_id", "seq", "role")
    return O.paired(m.filter("role = 'user'").drop("role"), m.filter("role = 'assistant'").drop("role"), ["session_id"]).select("session_id", "seq", "result_at")


@query("U03_unobserved", "SELECT id FROM fx_sessions WHERE conv_id % 3 <> 0 AND id NOT IN (SELECT id FROM fx_deleted) AND id NOT IN (SELECT id FROM fx_ignored)")
def _(fx):
    return A.unobserved(fx.sessions.select("id"), fx.sessions.filter("conv_id % 3 = 0"), fx.deleted, fx.ignored)


@query("L01_L02_second_page", f"SELECT id, updated FROM fx_sessions WHERE {_VISIBLE} ORDER BY coalesce(updated, created) DESC, id LIMIT 10 OFFSET 10")
def _(fx):
    return S.page(S.visible(fx.sessions, fx.deleted, fx.ignored), S.newest_first(), 2, 10).select("id", "updated")


@query("L06_memory_listing", "SELECT id, updated FROM fx_memory WHERE superseded_by IS NULL AND status = 'confirmed' ORDER BY updated DESC, id DESC LIMIT 50")
def _(fx):
    return M.listing(M.active(fx.memory), 50).select("id", "updated")


# --- ordered groups

_TURNS = "SELECT *, CAST(sum(CASE WHEN role = 'user' AND kind = 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn FROM fx_messages"


@query("W01_W02_turns", f"""+ t AS ({_TURNS}), g AS (SELECT session_id, turn, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS messages, CAST(sum(length(content)) AS BIGINT) AS chars, min(timestamp) AS moment FROM t GROUP BY 1, 2)
  SELECT session_id, turn, first_seq, last_seq, messages, chars, coalesce(CAST(moment AS DATE) <> lag(CAST(moment AS DATE)) OVER (PARTITION BY session_id ORDER BY turn), true) AS new_day FROM g""")  # fmt: skip
def _(fx):
    return O.turns(fx.messages)


@query("W03_folded_bursts", """+ r AS (SELECT session_id, name, event_id, CASE WHEN name IS NOT DISTINCT FROM lag(name) OVER w AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS c FROM fx_tool_events WINDOW w AS (PARTITION BY session_id ORDER BY event_id)),
  g AS (SELECT *, CAST(sum(c) OVER (PARTITION BY session_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM r)
  SELECT session_id, run, name, count(*) AS times, min(event_id) AS first, max(event_id) AS last FROM g GROUP BY 1, 2, 3""")  # fmt: skip
def _(fx):
    return O.folded(fx.tool_events, ["session_id"], ["name"], "event_id")


@query("W09_ranges", """+ r AS (SELECT DISTINCT session_id, seq FROM fx_messages WHERE role <> 'system' AND (seq + conv_id) % 5 <> 0), g AS (SELECT *, seq - row_number() OVER (PARTITION BY session_id ORDER BY seq) AS k FROM r)
  SELECT session_id, min(seq) AS first, max(seq) AS last FROM g GROUP BY session_id, k""")  # fmt: skip
def _(fx):
    return O.ranges(fx.messages.filter("role <> 'system' and (seq + conv_id) % 5 <> 0"), ["session_id"])


@query("W11_budget", """+ s AS (SELECT session_id, seq, sum(ceil(length(content) / 4)) OVER (PARTITION BY session_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS spent, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS place FROM fx_messages)
  SELECT session_id, seq, CAST(spent AS BIGINT) AS spent FROM s WHERE spent <= 300 OR place = 1""")  # fmt: skip
def _(fx):
    return O.within_budget(fx.messages, ["session_id"], [F.desc("seq")], O.estimated_tokens(F.col("content")), 300).select("session_id", "seq", "spent")


@query("W12_rescored", """+ w AS (SELECT memory_id, (sum((score - 1) / 4) + 1.5) / (count(*) + 3) AS weight FROM fx_feedback GROUP BY 1), p AS (SELECT id, row_number() OVER (ORDER BY updated DESC, id) - 1 AS place FROM fx_memory ORDER BY place LIMIT 100)
  SELECT id, (1 + ((0.75 + 0.5 * coalesce(weight, 0.5)) - 1)) / (60 + place) AS score FROM p LEFT JOIN w ON memory_id = id""")  # fmt: skip
def _(fx):
    from pyspark.sql import Window

    top = fx.memory.orderBy(F.desc("updated"), "id").limit(100)
    return M.rescored(top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("updated"), "id")) - 1), fx.feedback).select("id", "score")


@query("W13_revisions", "SELECT session_id, event_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS INTEGER) AS revision FROM fx_tool_events")
def _(fx):
    return O.numbered(fx.tool_events, ["session_id"], [F.asc("event_id")]).select("session_id", "event_id", "revision")


@query("W15_D05_duplicates", """+ w AS (SELECT memory_id, (sum((score - 1) / 4) + 1.5) / (count(*) + 3) AS weight FROM fx_feedback GROUP BY 1),
  m AS (SELECT m.id, coalesce(weight, 0.5) AS weight, updated, lower(title) AS a, sha256(body) AS b, kind, scope_project, scope_tool FROM fx_memory m LEFT JOIN w ON w.memory_id = m.id WHERE superseded_by IS NULL AND status = 'confirmed'),
  r AS (SELECT id, first_value(id) OVER (PARTITION BY a, b, kind, scope_project, scope_tool ORDER BY weight DESC, updated DESC, id DESC) AS survivor FROM m)
  SELECT id, survivor FROM r WHERE id <> survivor""")  # fmt: skip
def _(fx):
    return M.duplicates(fx.memory, fx.feedback)


@query("W16_capped", """+ r AS (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS k FROM fx_tool_events)
  SELECT session_id, event_id FROM r WHERE k <= 2 ORDER BY event_id LIMIT 100""")  # fmt: skip
def _(fx):
    return O.capped(fx.tool_events, "session_id", [F.asc("event_id")], 2, 100).select("session_id", "event_id")


@query("W07_P05_chunks", """+ r AS (SELECT session_id, seq AS block, 1 AS chunk, length(content) AS size FROM fx_messages WHERE seq = 0
  UNION ALL SELECT m.session_id, m.seq, CASE WHEN r.size + length(m.content) > 1500 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.size + length(m.content) > 1500 THEN length(m.content) ELSE r.size + length(m.content) END
  FROM r JOIN fx_messages m ON m.session_id = r.session_id AND m.seq = r.block + 1) SELECT session_id, block, chunk FROM r""")  # fmt: skip
def _(fx):
    return O.chunks(fx.messages.select("session_id", F.col("seq").alias("block"), F.length("content").alias("chars")), "session_id", 1500)


@query("C16_reasoning_budget", """+ b AS (SELECT session_id, seq, content, least(length(content), 200) AS want FROM fx_messages), s AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
  SELECT session_id, seq, CASE WHEN greatest(0, least(want, 500 - before)) > 0 THEN left(content, CAST(greatest(0, least(want, 500 - before)) AS BIGINT)) END AS reasoning FROM s""")  # fmt: skip
def _(fx):
    return O.budgeted_reasoning(fx.messages.withColumnRenamed("content", "reasoning"), 200, 500).select("session_id", "seq", "reasoning")


# --- derived columns


@query("C11_display_titles", "SELECT id, CASE WHEN trim(coalesce(title, '')) = '' THEN left(id, 12) WHEN count(*) OVER (PARTITION BY lower(trim(title))) > 1 THEN title || ' · ' || left(id, 8) ELSE title END AS shown FROM fx_sessions")
def _(fx):
    return fx.sessions.select("id", C.display_title(F.col("title"), F.col("id")).alias("shown"))


@query("C18_C19_labels", "SELECT id, coalesce(string_split(project, '/')[-1], '') AS label, '/session/' || id || '/m/' || messages_count AS link FROM fx_sessions")
def _(fx):
    return fx.sessions.select("id", F.coalesce(C.project_label(F.col("project")), F.lit("")).alias("label"), C.permalink(F.col("id"), F.col("messages_count")).alias("link"))


@query("T01_T03_T07_scalars", """SELECT conv_id, turn, sha256(text) AS sha, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, greatest(1, length(text) // 4) AS other, CASE WHEN length(text) > 300 THEN left(text, 120) || chr(10) || '[+' || (length(text) - 200) || ' chars elided]' || chr(10) || right(text, 80) ELSE text END AS brief FROM conversations""")
def _(fx):
    t = F.col("text")
    return fx.table("conversations").select("conv_id", "turn", F.sha2(t, 256).alias("sha"), O.estimated_tokens(t).alias("tokens"), F.greatest(F.lit(1), F.expr("length(text) div 4")).cast("long").alias("other"), C.elided(t, 300, 120, 80).alias("brief"))


@query("T10_normal_text", r"SELECT doc_id, regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '^[[:punct:]\s]+|[[:punct:]\s]+$', '', 'g') AS norm FROM documents")
def _(fx):
    return fx.table("documents").select("doc_id", M.normal_text(F.col("text")).alias("norm"))


# --- search and vectors

_TOKENS = r"SELECT CAST(doc_id AS VARCHAR) AS doc, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS toks FROM documents"


@query("X01_phrase", r"""+ d AS (SELECT CAST(doc_id AS VARCHAR) AS doc, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents) SELECT doc FROM d WHERE contains(t, ' all rights reserved ')""")
def _(fx):
    index = X.postings(fx.table("documents"), "doc_id", F.col("text"), stemmed=False)
    return X.matches(index, X.parse('"All rights reserved"', stemmed=False), 1, 1.0).select("doc")


@query("X11_F12_role_scope", r"""SELECT session_id, seq FROM fx_messages WHERE role = 'user' AND len(list_filter(regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+'), lambda w: starts_with(w, 'the'))) > 0 AND len(list_filter(regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+'), lambda w: starts_with(w, 'in'))) > 0""")
def _(fx):
    return X.in_scope(fx.messages, X.parse("the in", stemmed=False), ["user"], stemmed=False)


@query("X14_keyword_score", "SELECT doc_id, CAST(CASE WHEN contains(lower(left(text, 20)), 'the') THEN 10 ELSE 0 END + CASE WHEN contains(lower(text), 'the') THEN 2 ELSE 0 END + CASE WHEN lang = 'the' THEN 5 ELSE 0 END AS INTEGER) AS score FROM documents")
def _(fx):
    return fx.table("documents").select("doc_id", X.keyword_score(["the"], F.array("lang"), F.substring("text", 1, 20), F.col("text")).alias("score"))


@query("X16_find", """+ p AS (SELECT session_id, seq, string_split(lower(content), 'tion') AS parts FROM fx_messages), e AS (SELECT *, unnest(range(1, len(parts))) AS k FROM p)
  SELECT session_id, seq, CAST(k - 1 AS INTEGER) AS ordinal, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * 4 AS INTEGER) AS place FROM e""")  # fmt: skip
def _(fx):
    return X.occurrences(fx.messages, ["session_id", "seq"], "content", "Tion")


_QUERY_VECTOR = "(SELECT CAST(embedding AS DOUBLE[]) FROM fx_vectors WHERE key = 100)"


def _vector(fx: Fixtures) -> list[float]:
    return fx.vectors.filter("key = 100").first()["embedding"]


@query("V03_V04_nearest", f"SELECT key, list_distance(CAST(embedding AS DOUBLE[]), {_QUERY_VECTOR}) AS distance FROM fx_vectors WHERE list_distance(CAST(embedding AS DOUBLE[]), {_QUERY_VECTOR}) <= 1.3 ORDER BY distance, key LIMIT 25")
def _(fx):
    return V.nearest(fx.vectors, _vector(fx), 25, 1.3).select("key", "distance")


@query("V02_V08_most_similar", f"SELECT key, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_QUERY_VECTOR}) AS similarity FROM fx_vectors WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_QUERY_VECTOR}) >= 0.2 ORDER BY similarity DESC, key LIMIT 25")
def _(fx):
    return V.most_similar(fx.vectors, _vector(fx), 25, 0.2).select("key", "similarity")


@query("V09_fusion", """+ a AS (SELECT id, row_number() OVER (ORDER BY updated DESC, id) - 1 AS p FROM fx_sessions ORDER BY p LIMIT 200), b AS (SELECT id, row_number() OVER (ORDER BY total_tokens DESC NULLS LAST, id) - 1 AS p FROM fx_sessions ORDER BY p LIMIT 30)
  SELECT id, sum(1.0 / (60 + p)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1 ORDER BY score DESC, id LIMIT 40""")  # fmt: skip
def _(fx):
    one, two = S.newest_first(), [F.desc_nulls_last("total_tokens"), F.asc("id")]
    return V.fuse([fx.sessions.orderBy(*one).limit(200), fx.sessions.orderBy(*two).limit(30)], "id", [one, two], 40)


@query("V12_J07_pending_vectors", """SELECT CAST(doc_id AS BIGINT) AS key FROM documents WHERE NOT (doc_id % 3 = 0)""")
def _(fx):
    docs = fx.table("documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content"))
    stored = docs.filter("key % 3 < 2").select("key", F.when(F.col("key") % 3 == 0, "m").otherwise("old").alias("model"), F.sha2(F.substring("content", 1, 20_000), 256).alias("content_hash"))
    return V.pending(docs, stored, "key", "m").select("key")


# --- identity, mutation, health


@query("M01_I06_upsert", "SELECT id, CASE WHEN conv_id % 2 = 0 AND conv_id % 3 >= conv_id % 4 THEN title || '*' ELSE title END AS title FROM fx_sessions")
def _(fx):
    stored = fx.sessions.select("id", "title", (F.col("conv_id") % 4).alias("parser_version"))
    fresh = fx.sessions.filter("conv_id % 2 = 0").select("id", F.concat("title", F.lit("*")).alias("title"), (F.col("conv_id") % 3).alias("parser_version"))
    return A.upserted(stored, fresh, "id", "parser_version").select("id", "title")


@query("M03_supersede_and_reject", """SELECT id, CASE WHEN id % 5 = 0 THEN id + 1 ELSE superseded_by END AS superseded_by, CASE WHEN id % 7 = 0 AND status = 'candidate' THEN 'rejected' ELSE status END AS status FROM fx_memory""")
def _(fx):
    by = fx.memory.filter("id % 5 = 0").select("id", (F.col("id") + 1).alias("survivor"))
    return M.with_status(M.superseded(fx.memory, by), fx.memory.filter("id % 7 = 0"), "rejected", ("candidate",)).select("id", "superseded_by", "status")


@query("M10_captured_revisions", """+ l AS (SELECT source AS identity, sha256(text) AS sha256, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS revision FROM documents WHERE doc_id < 300), n AS (SELECT source AS identity, sha256(text) AS sha256, min(doc_id) AS captured_at FROM documents WHERE doc_id >= 300 GROUP BY 1, 2)
  SELECT n.identity, n.sha256, n.captured_at, CAST(row_number() OVER (PARTITION BY n.identity ORDER BY captured_at, n.sha256) + coalesce((SELECT max(revision) FROM l WHERE l.identity = n.identity), 0) AS INTEGER) AS revision FROM n WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.identity = n.identity AND l.sha256 = n.sha256)""")  # fmt: skip
def _(fx):
    docs = fx.table("documents").select(F.col("source").alias("identity"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("captured_at"))
    log = O.numbered(docs.filter("captured_at < 300"), ["identity"], [F.asc("captured_at")])
    return A.captured(docs.filter("captured_at >= 300"), log).select("identity", "sha256", "captured_at", "revision")


@query("H01_J06_index_health", "SELECT 'missing' AS problem, id FROM fx_memory WHERE id % 9 = 0 UNION ALL SELECT 'orphan', id + 1000000 FROM fx_memory WHERE id % 50 = 0")
def _(fx):
    index = fx.memory.filter("id % 9 <> 0").select("id").unionAll(fx.memory.filter("id % 50 = 0").select(F.col("id") + 1_000_000))
    return A.index_health(fx.memory, index)


# --- analytics and exports


@query("P03_masked_uuids", "SELECT event_id, 'id [uuid] ' || event_type AS masked FROM events")
def _(fx):
    u = F.md5(F.col("event_id").cast("string"))
    own = F.concat_ws("-", F.substring(u, 1, 8), F.substring(u, 9, 4), F.substring(u, 13, 4), F.substring(u, 17, 4), F.substring(u, 21, 12))
    return fx.table("events").select("event_id", C.masked_uuids(F.concat(F.lit("id "), own, F.lit(" "), "event_type")).alias("masked"))


@query("P07_rules", r"""+ m AS (SELECT session_id, seq, content || ' You should always keep test ' || (conv_id % 7) || ' green. Short must. ' || CASE WHEN seq % 2 = 1 THEN 'Never push on day ' || (seq % 3) || ' of the release!' ELSE 'Plain words without a rule in them.' END AS content FROM fx_messages WHERE role = 'assistant'),
  s AS (SELECT session_id, seq, unnest(string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM m),
  c AS (SELECT trim(sentence) AS sentence, session_id, CAST(list_sum(list_transform(['must', 'should', 'avoid', 'do not', 'never', 'always', 'best practice', 'recommend', 'prefer'], lambda w: CASE WHEN contains(lower(sentence), w) THEN 1 ELSE 0 END)) AS INTEGER) AS score FROM s)
  SELECT sentence, max(score) AS score, count(DISTINCT session_id) AS sessions FROM c WHERE length(sentence) BETWEEN 20 AND 180 AND score > 0 GROUP BY 1""")  # fmt: skip
def _(fx):
    from heddle.operators import analytics

    more = F.when(F.col("seq") % 2 == 1, F.concat(F.lit("Never push on day "), (F.col("seq") % 3).cast("string"), F.lit(" of the release!"))).otherwise("Plain words without a rule in them.")
    text = F.concat("content", F.lit(" You should always keep test "), (F.col("conv_id") % 7).cast("string"), F.lit(" green. Short must. "), more)
    return analytics.rules(fx.messages.withColumn("content", text), None)


@query("P04_W05_W06_compressed_blocks", """+ t AS (SELECT session_id, seq, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'tool' END AS role, trim(content) AS c FROM fx_messages),
  e AS (SELECT *, CASE role WHEN 'user' THEN 3000 WHEN 'assistant' THEN 2000 ELSE 600 END AS m, CASE role WHEN 'user' THEN 2000 WHEN 'assistant' THEN 1400 ELSE 300 END AS h, CASE role WHEN 'user' THEN 1000 WHEN 'assistant' THEN 600 ELSE 200 END AS z FROM t),
  l AS (SELECT session_id, seq, role, role || ': ' || CASE WHEN length(c) > m THEN left(c, h) || chr(10) || '[+' || (length(c) - h - z) || ' chars elided]' || chr(10) || right(c, z) ELSE c END AS line FROM e),
  b AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM l)
  SELECT session_id, block, min(seq) AS first_seq, max(seq) AS last_seq, CAST(length(string_agg(line, chr(10) ORDER BY seq)) AS INTEGER) AS chars, sha256(string_agg(line, chr(10) ORDER BY seq)) AS text FROM b GROUP BY 1, 2""")  # fmt: skip
def _(fx):
    from heddle.operators import analytics

    return analytics.compressed(fx.messages).withColumn("text", F.sha2("text", 256))


@query("P06_citations", "SELECT session_id AS id, [CAST(max(seq) + 1 AS INTEGER)] AS wrong FROM fx_messages GROUP BY 1")
def _(fx):
    from heddle.operators import analytics

    own = fx.messages.groupBy("session_id").agg(F.array(F.min("seq"), F.max("seq"), F.max("seq") + 1).alias("cites")).select(F.col("session_id").alias("id"), "session_id", "cites")
    return analytics.uncited(own, fx.messages)


_ESCAPED = "replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("K04_markdown", f"""+ t AS (SELECT *, {_ESCAPED} AS x FROM ({_TURNS})), g AS (SELECT session_id, turn, CAST(min(timestamp) AS DATE) AS day, min(seq) AS first_seq FROM t GROUP BY 1, 2), n AS (SELECT *, coalesce(day <> lag(day) OVER (PARTITION BY session_id ORDER BY turn), true) AS new_day FROM g),
  a AS (SELECT *, sum(CASE WHEN role = 'assistant' AND content <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, turn ORDER BY seq ROWS UNBOUNDED PRECEDING) AS answers FROM t),
  p AS (SELECT session_id, turn, first_seq AS seq, 0 AS part, '*' || strftime(day, '%A, %b %-d, %Y') || '*' || chr(10) AS text FROM n WHERE new_day UNION ALL SELECT session_id, turn, seq, 2, CASE WHEN role = 'user' AND kind = 'text' THEN '### Prompt ' || turn || ' · ' || strftime(timestamp, '%Y-%m-%d %H:%M') || chr(10) || chr(10) || x || chr(10)
    WHEN role = 'assistant' AND content <> '' THEN CASE WHEN answers = 1 THEN '**Assistant**' || chr(10) || chr(10) ELSE '' END || x || chr(10) WHEN role = 'system' AND content <> '' THEN '**System:** ' || x || chr(10) END FROM a),
  b AS (SELECT session_id, string_agg(text, chr(10) ORDER BY turn, seq, part) AS body FROM p WHERE text IS NOT NULL GROUP BY 1)
  SELECT id, sha256('# ' || title || chr(10) || chr(10) || '- Tool: ' || tool || chr(10) || '- Project: ' || coalesce(project, 'Unassigned') || chr(10) || '- Messages: ' || messages_count || chr(10) || chr(10) || body) AS text FROM fx_sessions JOIN b ON session_id = id""")  # fmt: skip
def _(fx):
    from heddle.operators import markdown

    return markdown.markdown(fx.sessions, fx.messages).withColumn("text", F.sha2("text", 256))


@query("K06_changed_exports", """SELECT id, title FROM fx_sessions WHERE conv_id % 3 <> 0""")
def _(fx):
    from heddle.operators import sinks

    manifest = sinks.fingerprints(fx.sessions.filter("conv_id % 3 = 0")).unionByName(sinks.fingerprints(fx.sessions.filter("conv_id % 3 = 1").withColumn("title", F.lit("old"))))
    return sinks.to_export(fx.sessions, manifest).select("id", "title")


@query("K07_handoff", "+ r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS k FROM fx_messages) SELECT session_id, sha256(string_agg(upper(role) || ': ' || content, chr(10) || chr(10) ORDER BY seq)) AS body FROM r WHERE k <= 3 GROUP BY 1")
def _(fx):
    from heddle.operators import sinks

    return sinks.handoff(fx.messages, 3).withColumn("body", F.sha2("body", 256))


@query("X17_visible_text")
def _(fx):
    from heddle.functions.html import visible_text

    return fx.table("pages").select("page_id", F.sha2(visible_text(F.col("html")), 256).alias("sha"))


