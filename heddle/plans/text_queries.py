"""Named queries of text and time functions, exports, ingest states, and searches in two steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle import schemas
from heddle.functions import columns as C
from heddle.functions.html import visible_text
from heddle.functions.redact import placeholder, redact_value
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
from heddle.plans.source_queries import shared_folder
from heddle.streaming import ingest as I

# --- text


@query("C09_first_words", r"""+ w AS (SELECT conv_id, turn, array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:10], ' ') AS t FROM conversations) SELECT conv_id, turn, CASE WHEN length(t) > 80 THEN left(t, 77) || '...' ELSE t END AS title FROM w""")
def _(fx):
    return fx.table("conversations").select("conv_id", "turn", C.first_words(F.col("text")).alias("title"))


@query("T04_T05_T12_T23_lines", r"""+ w AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations) SELECT conv_id, turn, t AS line, CASE WHEN length(t) > 120 THEN rtrim(left(t, 119)) || '…' ELSE t END AS glance, CASE WHEN length(t) > 140 THEN left(t, 137) || '...' ELSE t END AS preview, 'Number ' || turn || ' is 3.5 e.g. here!' AS first FROM w""")
def _(fx):
    t = F.col("text")
    two = F.concat(F.lit("Number "), F.col("turn").cast("string"), F.lit(" is 3.5 e.g. here! Then\nmore."))
    return fx.table("conversations").select("conv_id", "turn", C.one_line(t).alias("line"), C.capped(C.one_line(t), 120).alias("glance"), C.preview(t, 140).alias("preview"), C.first_sentence(two).alias("first"))


@query("C15_compact_events", """+ e AS (SELECT session_id, event_id, name, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY session_id) AS n FROM fx_tool_events)
  SELECT session_id, k - 1 AS place, name, CAST(NULL AS INTEGER) AS dropped FROM e WHERE k <= 5 UNION ALL SELECT DISTINCT session_id, 5, '…', CAST(n - 5 AS INTEGER) FROM e WHERE n > 5""")  # fmt: skip
def _(fx):
    event = F.struct("event_id", F.struct("name", "status", "duration_ms", "is_error", F.lit(None).cast("int").alias("dropped")).alias("e"))
    own = fx.tool_events.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(event)), lambda x: x["e"]).alias("events"))
    own = own.select("session_id", F.posexplode(C.compact_events(F.col("events"), 5)).alias("place", "e"))
    return own.select("session_id", F.col("place").cast("long").alias("place"), "e.name", "e.dropped")


@query("C29_slugs", r"""+ s AS (SELECT page_id, url, trim(regexp_replace(lower(url), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS t FROM pages) SELECT page_id, CASE WHEN length(t) > 30 THEN left(t, 21) || '-' || left(sha256(url), 8) ELSE t END AS slug FROM s""")
def _(fx):
    return fx.table("pages").select("page_id", C.slug(F.col("url"), 30).alias("slug"))


@query("T08_T20_artifacts", """+ l AS (SELECT session_id, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'changed' ELSE 'commands' END AS what, CASE event_id % 3 WHEN 2 THEN 'run ' || (event_id % 10) ELSE '/f' || (event_id % 10) END AS item FROM fx_tool_events),
  f AS (SELECT session_id, what, item, min(seq) AS since FROM l GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, what ORDER BY since) AS r FROM f) SELECT session_id, what, item, CAST(r AS INTEGER) AS r FROM r WHERE r <= 8""")  # fmt: skip
def _(fx):
    n = (F.col("event_id") % 10).cast("string")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[Tool: Read] /f"), n)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("[Tool: Edit] /f"), n)).otherwise(F.concat(F.lit("[Tool: Bash] run "), n))
    return P.artifacts(fx.tool_events.select("session_id", F.col("event_id").alias("seq"), F.concat(F.lit("first\n"), line).alias("content")))


@query("T14_T17_F15_since", "SELECT id FROM fx_sessions WHERE created >= TIMESTAMP '2024-01-03 00:00:00' - INTERVAL 36 HOUR AND created <= TIMESTAMP '2024-01-03 23:59:59.999999' AND project = '/work/p3'")
def _(fx):
    since = S.parse_bound("2024-01-03") - C.parse_duration("36h")
    own = S.listed(fx.sessions, since=since.isoformat(), until="2024-01-03")
    return own.filter(F.col("project") == "/work/p3").select("id")


@query("X17_visible_text", "SELECT event_id, 'Title ' || event_type || chr(10) || 'a & b' || chr(10) || 'end' AS t FROM events")
def _(fx):
    page = F.concat(F.lit("<html><head><title>Title "), "event_type", F.lit("</title><style>p {x: y}</style></head><body><p>a  &amp; <b>b</b></p><script>var x = '<p>';</script><textarea>no</textarea><mark>no</mark><div>end</div></body>"))
    return fx.table("events").select("event_id", visible_text(page).alias("t"))


@query("P02_F19_fields", "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN '[REDACTED:secret_assignment]' WHEN event_id % 4 = 2 THEN 'changeme' ELSE 'value' || event_id END AS t, event_id % 4 = 2 AS sample FROM events")
def _(fx):
    keys, values = ["db_password", "api-key", "token", "note"], lambda i: f"value{i}" if i % 4 != 2 else "changeme"
    field = F.pandas_udf(lambda ids: ids.map(lambda i: redact_value(keys[i % 4], values(i))), "string")
    sample = F.pandas_udf(lambda ids: ids.map(lambda i: placeholder(values(i))), "boolean")
    return fx.table("events").select("event_id", field("event_id").alias("t"), sample("event_id").alias("sample"))


# --- tables and exports


@query("C02_defaults", "SELECT id, 'unknown' AS origin, 0 AS prompt_count, messages_count, CAST(NULL AS VARCHAR) AS git_branch FROM fx_sessions")
def _(fx):
    own = schemas.with_defaults(fx.sessions.select("id", "messages_count", F.lit(None).cast("string").alias("origin")), schemas.SESSIONS)
    return own.select("id", "origin", "prompt_count", "messages_count", "git_branch")


@query("K05_html", """+ b AS (SELECT session_id, string_agg('<section class="' || role || '"><h2>' || upper(left(role, 1)) || substr(role, 2) || '</h2><pre>' || replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</pre></section>', chr(10) || chr(10) ORDER BY seq) AS body FROM fx_messages GROUP BY 1)
  SELECT id, sha256('<!DOCTYPE html><title>' || title || '</title>' || chr(10) || body) AS text FROM fx_sessions JOIN b ON session_id = id""")  # fmt: skip
def _(fx):
    return sinks.html(fx.sessions, fx.messages).withColumn("text", F.sha2("text", 256))


@query("K06_library_pages", """+ s AS (SELECT *, '- [[' || id || '|' || title || ']]' AS link FROM fx_sessions WHERE origin <> 'subagent'), p AS (SELECT CASE WHEN project IS NULL THEN 'Projects/unassigned' ELSE 'Projects/work-' || split_part(project, '/', 3) END AS name, updated, id, link FROM s UNION ALL SELECT 'Days/' || strftime(updated, '%Y-%m-%d'), updated, id, link FROM s),
  i AS (SELECT * FROM p UNION ALL SELECT 'Index', TIMESTAMP '2024-01-01 00:00:00', name, '- [[' || name || ']] (' || count(*) || ')' FROM p GROUP BY name), n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY updated DESC, id DESC) AS k, count(*) OVER (PARTITION BY name) AS total FROM i), h AS (SELECT *, (k - 1) // 8 AS sheet FROM n),
  g AS (SELECT name || CASE WHEN sheet = 0 THEN '' ELSE ' (' || (sheet + 1) || ')' END AS page, '[[' || name || ' (' || (sheet + 2) || ')|Next]]' AS next, total > (sheet + 1) * 8 AS more, string_agg(link, chr(10) ORDER BY k) AS lines FROM h GROUP BY name, sheet, total)
  SELECT page, sha256('# ' || page || chr(10) || chr(10) || lines || CASE WHEN more THEN chr(10) || chr(10) || next ELSE '' END) AS text FROM g""")  # fmt: skip
def _(fx):
    return sinks.library(fx.sessions, 8).withColumn("text", F.sha2("text", 256))


@query("K11_payloads", """SELECT id, json_extract_string(j, '$.tool') AS tool, CAST(json_extract(j, '$.messages_count') AS INTEGER) AS n, json_extract_string(j, '$.origin') AS origin FROM (SELECT id, to_json({'tool': tool, 'messages_count': messages_count, 'origin': origin}) AS j FROM fx_sessions)""")
def _(fx):
    own = sinks.payload(fx.sessions)
    return own.select("id", F.get_json_object("json", "$.tool").alias("tool"), F.get_json_object("json", "$.messages_count").cast("int").alias("n"), F.get_json_object("json", "$.origin").alias("origin"))


@query("H04_index_summary", "SELECT 'shown' AS part, '' AS key, count(*) AS n FROM fx_sessions WHERE origin NOT IN ('exec', 'cron', 'subagent') AND id NOT IN (SELECT id FROM fx_deleted) AND id NOT IN (SELECT id FROM fx_ignored) UNION ALL SELECT 'hidden', '', count(*) FROM fx_sessions WHERE NOT (origin NOT IN ('exec', 'cron', 'subagent') AND id NOT IN (SELECT id FROM fx_deleted) AND id NOT IN (SELECT id FROM fx_ignored)) UNION ALL SELECT 'tool', tool, count(*) FROM fx_sessions WHERE origin NOT IN ('exec', 'cron', 'subagent') AND id NOT IN (SELECT id FROM fx_deleted) AND id NOT IN (SELECT id FROM fx_ignored) GROUP BY 2")
def _(fx):
    return G.index_summary(fx.sessions, S.visible(fx.sessions, fx.deleted, fx.ignored))


# --- ingest and memory states


@query("I03_I04_changed_files", "SELECT id AS path FROM fx_sessions WHERE conv_id % 4 <> 0")
def _(fx):
    k = F.col("conv_id") % 4
    listing = fx.sessions.select(F.col("id").alias("path"), F.lit(10).alias("mtime"))
    log = fx.sessions.filter(k < 3).select(F.col("id").alias("path"), F.when(k == 1, 9).otherwise(10).alias("mtime"), F.when(k == 2, 2).otherwise(3).alias("parser_version"))
    return I.changed(listing, log, 3).select("path")


@query("I08_job_states", """+ l AS (SELECT session_id AS job, seq AS chunk, CASE (conv_id + seq) % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' ELSE 'complete' END AS s FROM fx_messages)
  SELECT job AS job_id, count(*) AS chunks, count(*) FILTER (s = 'complete') AS complete, CASE WHEN count(*) FILTER (s <> 'complete') = 0 THEN 'complete' WHEN count(*) FILTER (s = 'failed') > 0 THEN 'failed' ELSE 'running' END AS state, min(chunk) FILTER (s = 'pending') AS next_chunk FROM l GROUP BY 1""")  # fmt: skip
def _(fx):
    # a completion counts even if a failure comes later, and the latest of other states
    k = (F.col("conv_id") + F.col("seq")) % 4
    at = lambda n: F.lit(f"2026-01-01 00:0{n}:00").cast("timestamp")
    row = lambda when, status, n: fx.messages.filter(when).select(F.col("session_id").alias("job_id"), F.col("seq").alias("chunk"), F.lit(status).alias("status"), at(n).alias("at"))
    log = row(k >= 0, "pending", 0).unionAll(row(k == 0, "complete", 1)).unionAll(row(k == 0, "failed", 2)).unionAll(row(k == 2, "failed", 3)).unionAll(row(k == 3, "failed", 1)).unionAll(row(k == 3, "complete", 2))
    return I.job_states(log)


@query("M05_ratings", "SELECT memory_id, rater, CASE WHEN rater = 1 THEN 5 ELSE score END AS score FROM fx_feedback")
def _(fx):
    log = fx.feedback.withColumn("created", F.lit(1)).unionByName(fx.feedback.filter("rater = 1").withColumns({"score": F.lit(5), "created": F.lit(2)})).unionByName(fx.feedback.filter("rater = 0").withColumns({"score": F.lit(1), "created": F.lit(0)}))
    return M.rated(log).select("memory_id", "rater", "score")


@query("D06_semantic_duplicates", """+ v AS (SELECT key, CAST(embedding AS DOUBLE[]) AS e FROM fx_vectors) SELECT key, list_cosine_similarity(e, (SELECT e FROM v WHERE key = 7)) AS similarity FROM v WHERE list_cosine_similarity(e, (SELECT e FROM v WHERE key = 7)) >= 0.2 ORDER BY similarity DESC, key LIMIT 10""")
def _(fx):
    return V.most_similar(fx.vectors, fx.vectors.filter("key = 7").first()["embedding"], 10, 0.2).select("key", "similarity")


@query("V01_V12_Y02_embedded", "SELECT conv_id * 100 + turn AS key, 'm' AS model, sha256(text) AS content_hash, CAST(length(text) AS DOUBLE) AS first FROM conversations")
def _(fx):
    own = fx.table("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("key"), F.col("text").alias("content"), F.sha2("text", 256).alias("hash"), "turn")
    lengths = lambda texts: [[float(len(t)), 1.0] if t else None for t in texts]  # noqa: E731 - stands for a model
    return V.embedded(own, lengths, "key", "m").select("key", "model", "content_hash", F.col("embedding")[0].cast("double").alias("first"))


@query("P09_context_text", """+ m AS (SELECT id, title, kind FROM fx_memory WHERE scope_project = 'src4' AND superseded_by IS NULL AND status = 'confirmed'), r AS (SELECT *, row_number() OVER (ORDER BY id) AS place, '- [' || kind || '] T' || id || ': Sentence ' || id || '.' AS line FROM m), s AS (SELECT *, sum(ceil(length(line) / 4)) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS spent FROM r)
  SELECT string_agg(line, chr(10) ORDER BY place) AS text, count(*) AS entries FROM s WHERE spent <= 60 OR place = 1""")  # fmt: skip
def _(fx):
    from pyspark.sql import Window

    own = M.active(fx.memory, project="src4").select("id", "kind", F.concat(F.lit("T"), F.col("id").cast("string")).alias("title"), F.concat(F.lit("Sentence "), F.col("id").cast("string"), F.lit(". And more.")).alias("body"))
    return P.context_text(own.withColumn("place", F.row_number().over(Window.orderBy("id"))), 60)  # one project's entries


# --- searches in two steps

_TOKS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"


def _scored(rows: str, key: str, text: str, terms: str = "['the', 'in']", n: int = 2) -> str:
    """Common table expressions that end in {rows}_hits ({key}, score)."""
    r = rows
    return rf"""{r}_d AS (SELECT {key}, {_TOKS.format(text)} AS toks FROM {rows}), {r}_s AS (SELECT count(*) AS n, sum(len(toks)) / count(*) AS mean FROM {r}_d WHERE len(toks) > 0), {r}_t AS (SELECT {key}, len(toks) AS dl, unnest(toks) AS term FROM {r}_d),
  {r}_h AS (SELECT {key}, q, any_value(dl) AS dl, count(*) AS tf FROM {r}_t JOIN (SELECT unnest({terms}) AS q) ON starts_with(term, q) GROUP BY {key}, q), {r}_f AS (SELECT q, count(*) AS df FROM {r}_h GROUP BY 1),
  {r}_c AS (SELECT {key}, -(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS sc FROM {r}_h JOIN {r}_f USING (q), {r}_s),
  {r}_hits AS (SELECT {key}, sum(sc) AS score FROM {r}_c GROUP BY {key} HAVING count(*) = {n})"""


@query("X12_message_search", f"""+ a AS (SELECT session_id, string_agg(content, chr(10) ORDER BY seq) AS t FROM fx_messages GROUP BY 1), {_scored('a', 'session_id', 't')}, b AS (SELECT session_id, seq, content FROM fx_messages WHERE session_id IN (SELECT session_id FROM a_hits ORDER BY score, session_id LIMIT 100)), {_scored('b', 'session_id, seq', 'content')}
  SELECT session_id, seq, score FROM b_hits ORDER BY score, session_id || '#m' || seq LIMIT 20""")  # fmt: skip
def _(fx):
    index = X.postings(R.body_text(fx.messages), "session_id", F.col("text"), stemmed=False)
    return X.search_messages(fx.messages, index, X.parse("the in", stemmed=False), *X.statistics(index), 20, stemmed=False)


@query("V10_L04_hybrid_search", f"""+ a AS (SELECT doc_id AS k, text FROM documents), {_scored('a', 'k', 'text', "['the', 'inti']")}, w AS (SELECT k, row_number() OVER (ORDER BY score, k) - 1 AS p FROM a_hits ORDER BY score, k LIMIT 200), v AS (SELECT key AS k, list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM fx_vectors WHERE key = 100)) AS d FROM fx_vectors),
  z AS (SELECT k, row_number() OVER (ORDER BY d, k) - 1 AS p FROM v ORDER BY d, k LIMIT 200) SELECT k AS key, sum(1.0 / (60 + p)) AS score FROM (SELECT * FROM w UNION ALL SELECT * FROM z) GROUP BY 1 ORDER BY score DESC, key LIMIT 50""")  # fmt: skip
def _(fx):
    words = X.scanned(fx.table("documents"), "doc_id", F.col("text"), X.parse("the inti", stemmed=False), 1 << 20).select(F.col("doc").cast("long").alias("key"), "score")
    near = V.nearest(fx.vectors, fx.vectors.filter("key = 100").first()["embedding"], 200).select("key", "distance")
    return V.fuse([words.orderBy("score", "key").limit(200), near], "key", [[F.asc("score"), F.asc("key")], [F.asc("distance"), F.asc("key")]], 50)


@query("X10_first_evidence", r"""+ m AS (SELECT session_id, seq, role FROM fx_messages WHERE len(list_filter(regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+'), lambda w: starts_with(w, 'the'))) > 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS INTEGER) AS r FROM m) SELECT session_id, seq, role, r FROM r WHERE r <= 2""")
def _(fx):
    return X.first_evidence(fx.messages, X.in_scope(fx.messages, X.parse("the", stemmed=False), stemmed=False), 2)


@query("X15_exact_terms", r"""SELECT CAST(doc_id AS VARCHAR) AS doc FROM documents WHERE list_contains(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'), 'the') AND list_contains(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'), 'in')""")
def _(fx):
    index = X.postings(fx.table("documents"), "doc_id", F.col("text"), stemmed=False)
    return X.matches(index, X.parse("the in", stemmed=False), 1, 1.0, prefix=False).select("doc")


@query("X03_postings", r"""+ t AS (SELECT CAST(doc_id AS VARCHAR) AS doc, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS toks FROM documents), e AS (SELECT doc, len(toks) AS dl, unnest(toks) AS term, unnest(range(len(toks))) AS pos FROM t) SELECT doc, term, count(*) AS tf, CAST(any_value(dl) AS INTEGER) AS dl, CAST(min(pos) AS INTEGER) AS first FROM e GROUP BY 1, 2""")
def _(fx):
    index = X.postings(fx.table("documents"), "doc_id", F.col("text"), stemmed=False)
    return index.select("doc", "term", "tf", "dl", F.element_at("positions", 1).alias("first"))


@query("X07_snippets", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '…b «word» c «words»…' ELSE 'a «word»' END AS snippet FROM events")
def _(fx):
    text = F.when(F.col("event_id") % 2 == 0, "a a a b word c words d d word e").otherwise("a word")
    return X.with_snippets(fx.table("events").select("event_id", text.alias("t")), "t", X.parse("word", stemmed=False), 4, stemmed=False).select("event_id", "snippet")


# --- home, jobs, repairs and stores


@query("G16_home", """+ s AS (SELECT *, coalesce(updated, created) AS moment FROM fx_sessions), a AS (SELECT 'recent' AS part, row_number() OVER (ORDER BY moment DESC, id) AS rank, '' AS key, id, title FROM s), p AS (SELECT *, coalesce(project, 'Unassigned') AS key, row_number() OVER (PARTITION BY coalesce(project, 'Unassigned') ORDER BY moment DESC, id) AS k FROM s),
  b AS (SELECT 'project' AS part, row_number() OVER (ORDER BY moment DESC, id) AS rank, key, id, title FROM p WHERE k = 1), d AS (SELECT 'day' AS part, row_number() OVER (PARTITION BY CAST(moment AS DATE) ORDER BY moment DESC, id) AS rank, CAST(CAST(moment AS DATE) AS VARCHAR) AS key, id, title, dense_rank() OVER (ORDER BY CAST(moment AS DATE) DESC) AS n FROM s)
  SELECT part, CAST(rank AS INTEGER) AS rank, key, id, title FROM (SELECT * FROM a WHERE rank <= 6 UNION ALL SELECT * FROM b WHERE rank <= 12 UNION ALL SELECT part, rank, key, id, title FROM d WHERE n <= 7 AND rank <= 3)""")  # fmt: skip
def _(fx):
    return G.home(fx.sessions)


@query("M12_repaired_places", "SELECT session_id || '/' || seq AS link_id, seq + 1000 AS was, (SELECT min(m.seq) FROM fx_messages m WHERE m.session_id = x.session_id AND m.content = x.content) AS seq FROM fx_messages x WHERE seq % 2 = 1")
def _(fx):
    seq = F.col("seq")
    links = fx.messages.select(F.concat_ws("/", "session_id", seq.cast("string")).alias("link_id"), "session_id", F.when(seq % 2 == 1, seq + 1000).otherwise(seq).alias("seq"), F.lit(None).cast("string").alias("native_id"), F.sha2("content", 256).alias("sha256"))
    return A.repaired_places(links, fx.messages)


@query("K12_json_store", "SELECT id, title, total_tokens FROM fx_sessions")
def _(fx):
    path = f"{shared_folder(fx)}/store"
    sinks.json_store(fx.sessions.select("id", "title", "total_tokens"), path, "id")
    return fx.spark.read.schema("id string, title string, total_tokens bigint").json(path)


@query("T02_T19_json", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props END AS parsed, CASE WHEN length(props) > 7 THEN '{"truncated":true,"chars":' || length(props) || ',"sha256":"' || sha256(props) || '"}' ELSE props END AS capped, sha256('=' || event_id || chr(31) || CASE WHEN event_id % 2 = 0 THEN '=' || event_type ELSE '!' END) AS digest FROM events""")
def _(fx):
    props = F.col("props")
    broken = F.when(F.col("event_id") % 2 == 0, props).otherwise(F.concat(F.lit("{"), props))
    own = C.canonical_json(F.col("event_id"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")))
    return fx.table("events").select("event_id", C.json_or_null(broken).alias("parsed"), C.json_capped(props, 7).alias("capped"), F.sha2(own, 256).alias("digest"))


@query("X16_L10_find_in_session", """+ p AS (SELECT session_id, seq, content, length(content) AS n, string_split(lower(content), 'tion') AS parts FROM fx_messages), e AS (SELECT *, unnest(range(1, len(parts))) AS k FROM p), o AS (SELECT *, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * 4 AS BIGINT) AS place FROM e),
  b AS (SELECT *, greatest(0, place - 78) AS s0 FROM o), c AS (SELECT *, least(n, s0 + 160) AS z FROM b), d AS (SELECT *, CASE WHEN z - s0 < 160 AND s0 > 0 THEN greatest(0, z - 160) ELSE s0 END AS s FROM c)
  SELECT session_id, seq, CAST(k - 1 AS INTEGER) AS ordinal, CAST(place AS INTEGER) AS place, CAST(seq // 2 + 1 AS INTEGER) AS page, replace(replace(CASE WHEN s > 0 THEN '…' ELSE '' END || substr(content, s + 1, z - s) || CASE WHEN z < n THEN '…' ELSE '' END, '<', ''), '>', '') AS snippet FROM d ORDER BY session_id, seq, place LIMIT 200""")  # fmt: skip
def _(fx):
    return X.found_in_session(fx.messages, "session_id", "seq", "content", "Tion", per_page=2)
