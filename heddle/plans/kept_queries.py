"""Named queries of what stays current: synced sessions, the kept index, stemmed search; and of the semantic join."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heddle.api import Archive
from heddle.operators import analytics as P
from heddle.operators import memory as M
from heddle.operators import search as X
from heddle.operators import similarity
from heddle.operators.text_index import TextIndex
from heddle.plans.fixtures import shared_path
from heddle.plans.queries import query
from heddle.streaming import ingest as I

# --- sync


def _parsed(sessions, parser: int, mtime: int):
    return sessions.withColumns({"parser_version": F.lit(parser), "source_mtime_ns": F.lit(mtime).cast("long"), "source_path": F.concat(F.lit("/t/"), "id")})


@query("K01_M01_session_replaced", """+ m AS (SELECT session_id, seq, role, content FROM fx_messages WHERE conv_id % 2 = 1 OR seq % 3 <> 1), c AS (SELECT session_id, count(*) AS n FROM m GROUP BY 1)
  SELECT session_id, seq, role, content, CAST(n AS INTEGER) AS messages_count FROM m JOIN c USING (session_id)""")  # fmt: skip
def _(fx):
    own = Archive(fx.spark, shared_path(fx.spark))
    own.sync(_parsed(fx.sessions, 2, 1), fx.messages)
    even = fx.sessions.filter("conv_id % 2 = 0")
    fewer = fx.messages.filter("conv_id % 2 = 0 and seq % 3 <> 1")
    for _ in range(2):  # the second changes nothing
        own.sync(_parsed(even, 2, 2), fewer)
    own.sync(_parsed(fx.sessions, 1, 9), fx.messages)  # an older parser's
    counts = own.table("sessions").select(F.col("id").alias("session_id"), "messages_count")
    return own.table("messages").select("session_id", "seq", "role", "content").join(counts, "session_id")


@query("K01_sync_outcomes", """SELECT id, CASE WHEN conv_id % 4 = 0 THEN 'older' WHEN conv_id % 4 = 1 THEN 'unchanged' WHEN conv_id % 4 = 2 THEN 'replaced' ELSE 'added' END AS outcome FROM fx_sessions""")
def _(fx):
    own, k = Archive(fx.spark, shared_path(fx.spark)), F.col("conv_id") % 4
    own.sync(_parsed(fx.sessions.filter(k < 3), 2, 5), fx.messages)
    again = _parsed(fx.sessions, 2, 5).withColumn("source_mtime_ns", F.when(k == 0, 4).when(k == 2, 6).otherwise(5).cast("long"))
    return own.sync(again, fx.messages)


# --- the kept index

_TOKS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"


def _bm25(docs: str, terms: list[str], toks: str, word: str = "term") -> str:
    """Common table expressions that end in hits (doc, score), over {docs} (doc, toks); word: what the terms are prefixes of."""
    return f"""s AS (SELECT count(*) AS n, sum(len({toks})) / count(*) AS mean FROM {docs}), t AS (SELECT doc, len({toks}) AS dl, unnest({toks}) AS term FROM {docs}),
  h AS (SELECT doc, q, any_value(dl) AS dl, count(*) AS tf FROM t JOIN (SELECT unnest({terms}) AS q) ON starts_with({word}, q) GROUP BY 1, 2), f AS (SELECT q, count(*) AS df FROM h GROUP BY 1),
  c AS (SELECT doc, -(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS sc FROM h JOIN f USING (q), s),
  hits AS (SELECT doc, sum(sc) AS score FROM c GROUP BY doc HAVING count(*) = {len(terms)})"""


@query("X03_I05_postings_kept", f"""+ d AS (SELECT CAST(doc_id AS VARCHAR) AS doc, {_TOKS.format("CASE WHEN doc_id % 5 = 0 THEN 'the inti ' || text ELSE text END")} AS toks FROM documents WHERE doc_id % 7 <> 3 OR doc_id % 5 = 0), {_bm25("d", ["the", "inti"], "toks")}
  SELECT doc, score FROM hits ORDER BY score, doc LIMIT 50""")  # fmt: skip
def _(fx):
    index, k = TextIndex(fx.spark, shared_path(fx.spark), stemmed=False), F.col("doc_id")
    docs = fx.table("documents").withColumn("doc", k.cast("string"))
    index.update(docs.filter(k % 3 != 1).select("doc", "text"))
    index.update(docs.filter(k % 3 == 1).select("doc", "text"))
    changed = docs.filter(k % 5 == 0).select("doc", F.concat(F.lit("the inti "), "text").alias("text"))
    index.update(changed, docs.filter((k % 7 == 3) & (k % 5 != 0)).select("doc"))
    return X.best(X.matches(index.postings(), X.parse("the inti", stemmed=False), *index.statistics()), 50)


# --- stemmed search

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_MORE0, _IS1, _MORE1, _VOWEL = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?[aeiouy]"
_CVC = f"^{_C}[aeiouy][^aeiouwxy]$"
# The suffixes of the published algorithm.
_TWO = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
        "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_THREE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOUR = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _ends(suffixes) -> str:
    return f"^(.*?)({'|'.join(suffixes)})$"


def _mapped(rules: dict[str, str]) -> str:
    return "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.items()) + " END"


def stems_sql(words: str) -> str:
    """Common table expressions that end in stems (term, stem) of the words of a table {words} (term): the published Porter algorithm by regular expressions."""
    at = lambda e, n: f"regexp_extract(w, '{e}', {n})"
    step = lambda name, before, cases: f"{name} AS (SELECT term, CASE {cases} ELSE w END AS w FROM {before})"
    suffixed = lambda name, before, rules, least: f"{name} AS (SELECT term, CASE WHEN x <> '' AND regexp_matches(b, '{least}') THEN b || {_mapped(rules)} ELSE w END AS w FROM (SELECT *, {at(_ends(rules), 1)} AS b, {at(_ends(rules), 2)} AS x FROM {before}))"
    four = _ends(_FOUR)
    return ", ".join([
        f"z0 AS (SELECT DISTINCT term, CASE WHEN starts_with(term, 'y') THEN 'Y' || term[2:] ELSE term END AS w FROM {words} WHERE regexp_full_match(term, '[a-z]{{3,20}}'))",
        step("z1", "z0", "WHEN regexp_matches(w, '(ss|i)es$') THEN w[:-3] WHEN regexp_matches(w, '[^s]s$') THEN w[:-2]"),
        f"z2 AS (SELECT term, w, {at('^(.*?)(eed|ed|ing)$', 1)} AS b, {at('^(.*?)(eed|ed|ing)$', 2)} AS x FROM z1)",
        f"z3 AS (SELECT term, w, x, CASE WHEN x IN ('ed', 'ing') AND regexp_matches(b, '{_VOWEL}') THEN b WHEN x = 'eed' AND regexp_matches(b, '{_MORE0}') THEN w[:-2] ELSE w END AS b FROM z2)",
        f"z4 AS (SELECT term, CASE WHEN x NOT IN ('ed', 'ing') OR b = w THEN b WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN b[-1] = b[-2] AND regexp_matches(b, '[^aeiouylsz]$') THEN b[:-2] WHEN regexp_matches(b, '{_CVC}') THEN b || 'e' ELSE b END AS w FROM z3)",
        step("z5", "z4", f"WHEN regexp_matches(w, '.y$') AND regexp_matches(w[:-2], '{_VOWEL}') THEN w[:-2] || 'i'"),
        suffixed("z6", "z5", _TWO, _MORE0),
        suffixed("z7", "z6", _THREE, _MORE0),
        f"z8 AS (SELECT term, CASE WHEN x <> '' AND regexp_matches(b, '{_MORE1}') AND (x <> 'ion' OR regexp_matches(b, '[st]$')) THEN b ELSE w END AS w FROM (SELECT *, {at(four, 1)} AS b, {at(four, 2)} AS x FROM z7))",
        step("z9", "z8", f"WHEN w[-1] = 'e' AND (regexp_matches(w[:-2], '{_MORE1}') OR (regexp_matches(w[:-2], '{_IS1}') AND NOT regexp_matches(w[:-2], '{_CVC}'))) THEN w[:-2]"),
        f"stems AS (SELECT term, lower(CASE WHEN regexp_matches(w, 'll$') AND regexp_matches(w, '{_MORE1}') THEN w[:-2] ELSE w END) AS stem FROM z9)",
    ])


_STEMMED = ["er", "hate"]


@query("X02_stems", f"""+ w AS (SELECT DISTINCT unnest({_TOKS.format('text')}) AS term FROM documents), {stems_sql('w')} SELECT w.term, coalesce(stem, w.term) AS stem FROM w LEFT JOIN stems USING (term)""")
def _(fx):
    words = fx.table("documents").select(F.explode(X.token_column(F.col("text"))).alias("term")).distinct()
    return X.postings(words, "term", F.col("term")).select(F.col("doc").alias("term"), F.col("term").alias("stem"))


@query("X02_X04_stemmed_search", f"""+ d AS (SELECT CAST(doc_id AS VARCHAR) AS doc, {_TOKS.format('text')} AS toks FROM documents), w AS (SELECT DISTINCT unnest(toks) AS term FROM d), {stems_sql('w')}, u AS (SELECT d.doc, coalesce(stem, term) AS term, len(toks) AS dl FROM (SELECT doc, toks, unnest(toks) AS term FROM d) d LEFT JOIN stems USING (term)),
  s AS (SELECT count(*) AS n, sum(len(toks)) / count(*) AS mean FROM d), h AS (SELECT doc, q, any_value(dl) AS dl, count(*) AS tf FROM u JOIN (SELECT unnest({_STEMMED}) AS q) ON starts_with(term, q) GROUP BY 1, 2), f AS (SELECT q, count(*) AS df FROM h GROUP BY 1),
  c AS (SELECT doc, -(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS sc FROM h JOIN f USING (q), s)
  SELECT doc, sum(sc) AS score FROM c GROUP BY doc HAVING count(*) = 2 ORDER BY score, doc LIMIT 50""")  # fmt: skip
def _(fx):
    index = TextIndex(fx.spark, shared_path(fx.spark))
    index.rebuild(fx.table("documents").select(F.col("doc_id").cast("string").alias("doc"), "text"))
    return X.best(X.matches(index.postings(), X.parse("ering hating"), *index.statistics()), 50)


@query("X18_search", f"""+ d AS (SELECT id AS doc, {_TOKS.format("title || chr(10) || coalesce(body, '')")} AS toks FROM fx_sessions LEFT JOIN (SELECT session_id, string_agg(content, chr(10) ORDER BY seq) AS body FROM fx_messages WHERE content <> '' GROUP BY 1) ON session_id = id), w AS (SELECT DISTINCT unnest(toks) AS term FROM d), {stems_sql('w')},
  e AS (SELECT doc, list_transform(toks, lambda x: x) AS toks FROM d), u AS (SELECT d.doc, coalesce(stem, term) AS term, len(toks) AS dl FROM (SELECT doc, toks, unnest(toks) AS term FROM e) d LEFT JOIN stems USING (term)),
  s AS (SELECT count(*) AS n, sum(len(toks)) / count(*) AS mean FROM d), h AS (SELECT doc, q, any_value(dl) AS dl, count(*) AS tf FROM u JOIN (SELECT unnest(['er', 'the']) AS q) ON starts_with(term, q) GROUP BY 1, 2), f AS (SELECT q, count(*) AS df FROM h GROUP BY 1),
  c AS (SELECT doc, -(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS sc FROM h JOIN f USING (q), s), hits AS (SELECT doc AS id, sum(sc) AS score FROM c GROUP BY doc HAVING count(*) = 2)
  SELECT id, score FROM hits JOIN fx_sessions USING (id) WHERE contains(project, 'p3') AND origin NOT IN ('exec', 'cron', 'subagent') AND id NOT IN (SELECT id FROM fx_deleted) ORDER BY score, id LIMIT 20""")  # fmt: skip
def _(fx):
    own = Archive(fx.spark, shared_path(fx.spark))
    own.reindex()
    own.sync(_parsed(fx.sessions, 1, 1), fx.messages)
    own.hide(fx.deleted)
    return own.search("ering the", project="p3")


# --- the semantic join

_FLOOR = 0.85


@query("D06_semantic_join", f"""+ v AS (SELECT key, CAST(embedding AS DOUBLE[]) AS e FROM fx_vectors) SELECT p.key AS a, q.key AS b, list_cosine_similarity(p.e, q.e) AS similarity FROM v p JOIN v q ON p.key < q.key WHERE list_cosine_similarity(p.e, q.e) >= {_FLOOR}""")
def _(fx):
    return similarity.similar_pairs(fx.vectors, _FLOOR)


@query("D06_semantic_links", """+ v AS (SELECT key, CAST(embedding AS DOUBLE[]) AS e FROM fx_vectors) SELECT p.key AS a, q.key AS b, list_cosine_similarity(p.e, q.e) AS similarity FROM v p JOIN v q ON p.key < q.key WHERE list_cosine_similarity(p.e, q.e) >= 0.4""")
def _(fx):
    return similarity.similar_pairs(fx.vectors, 0.4)  # the test tables' vectors are scattered: above, there are few pairs


@query("D06_V08_similar_known", f"""+ v AS (SELECT m.id, scope_project, scope_tool, status, CAST(embedding AS DOUBLE[]) AS e FROM fx_memory m JOIN fx_vectors ON key = m.id)
  SELECT p.id, q.id AS known_id, list_cosine_similarity(p.e, q.e) AS similarity FROM v p JOIN v q ON p.scope_project IS NOT DISTINCT FROM q.scope_project AND p.scope_tool IS NOT DISTINCT FROM q.scope_tool WHERE p.status = 'candidate' AND q.status = 'confirmed' AND list_cosine_similarity(p.e, q.e) >= 0.3""")  # fmt: skip
def _(fx):
    own = fx.memory.join(fx.vectors.select(F.col("key").alias("id"), "embedding"), "id")
    return M.similar_known(own.filter("status = 'candidate'"), own.filter("status = 'confirmed'"), 0.3)


@query("D07_promotion_semantic", """+ v AS (SELECT m.id, scope_project, scope_tool, status, CAST(embedding AS DOUBLE[]) AS e FROM fx_memory m JOIN fx_vectors ON key = m.id), n AS (SELECT DISTINCT p.id FROM v p JOIN v q ON p.scope_project IS NOT DISTINCT FROM q.scope_project AND p.scope_tool IS NOT DISTINCT FROM q.scope_tool WHERE p.status = 'candidate' AND q.status = 'confirmed' AND list_cosine_similarity(p.e, q.e) >= 0.3),
  o AS (SELECT v.id, scope_project AS session_id, n.id IS NOT NULL AS near FROM v LEFT JOIN n USING (id) WHERE status = 'candidate'), g AS (SELECT id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS k FROM o WHERE NOT near), a AS (SELECT id FROM g WHERE k <= 3 ORDER BY id LIMIT 20)
  SELECT id, CASE WHEN near THEN 'already_known' WHEN id IN (SELECT id FROM a) THEN 'added' ELSE 'capped' END AS outcome FROM o""")  # fmt: skip
def _(fx):
    own = fx.memory.join(fx.vectors.select(F.col("key").alias("id"), "embedding"), "id")
    fresh = own.filter("status = 'candidate'")
    title = F.concat(F.lit("Entry "), F.col("id").cast("string"))
    candidates = fresh.select("id", F.col("scope_project").alias("session_id"), title.alias("title"), F.lit(None).cast("string").alias("body"))
    return M.promoted(candidates, candidates.limit(0), 3, 20, M.similar_known(fresh, own.filter("status = 'confirmed'"), 0.3))


# --- context under a budget


@query("P09_context_budgets", """+ b AS (SELECT unnest([60, 200, 1000]) AS budget), r AS (SELECT row_number() OVER (ORDER BY updated DESC, id) AS place, '- ' || strftime(updated, '%Y-%m-%d') || ' ' || tool || ' "' || title || '"' AS line FROM fx_sessions WHERE project = '/work/p3' ORDER BY updated DESC, id LIMIT 5),
  rs AS (SELECT *, sum(length(line) + 1) OVER (ORDER BY place) AS spent FROM r), rk AS (SELECT budget, count(place) AS n, coalesce(sum(length(line) + 1), 0) + CASE WHEN count(place) > 0 THEN 26 ELSE 0 END AS used FROM b LEFT JOIN rs ON spent <= 4 * (budget // 4) - 25 GROUP BY 1),
  e AS (SELECT row_number() OVER (ORDER BY updated DESC, id DESC) AS place, '- [' || kind || '] Entry ' || id || ': Short text ' || id || '.' AS line FROM fx_memory WHERE superseded_by IS NULL AND status = 'confirmed' AND scope_project = 'src4' ORDER BY updated DESC, id DESC LIMIT 40),
  es AS (SELECT *, sum(length(line) + 1) OVER (ORDER BY place) AS spent, sum(length(line) + 1) OVER () AS whole, count(*) OVER () AS m FROM e), ek AS (SELECT budget, any_value(rk.n) AS recents, count(*) FILTER (spent <= 4 * budget - used - CASE WHEN whole > 4 * budget - used THEN 64 ELSE 0 END) AS entries, any_value(m) AS m FROM rk, es GROUP BY 1)
  SELECT budget, CAST(entries AS INTEGER) AS entries, m - entries AS cut, CAST(recents AS INTEGER) AS recents FROM ek""")  # fmt: skip
def _(fx):
    place = lambda *by: F.row_number().over(Window.orderBy(*by))  # noqa: E731 - numbers a page
    recent = fx.sessions.filter("project = '/work/p3'").orderBy(F.desc("updated"), "id").limit(5)
    recent = recent.select(place(F.desc("updated"), "id").alias("place"), F.date_format("updated", "yyyy-MM-dd").alias("date"), "tool", "title", F.lit(None).cast("string").alias("summary"))
    own = M.listing(M.active(fx.memory, project="src4"), 40)
    own = own.select(place(F.desc("updated"), F.desc("id")).alias("place"), "id", "kind", F.concat(F.lit("Entry "), F.col("id").cast("string")).alias("title"), F.concat(F.lit("Short text "), F.col("id").cast("string"), F.lit(". More.")).alias("body"))
    out = None
    for budget in (60, 200, 1000):
        row = P.context(own, recent, budget).select(F.lit(budget).alias("budget"), "entries", "cut", "recents")
        out = row if out is None else out.unionAll(row)
    return out


# --- streams

_GAPS = """+ e AS (SELECT session_id, event_id, name, ts, duration_ms, CASE WHEN ts < lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM fx_tool_events),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
  SELECT session_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n, sum(duration_ms) AS total, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM r GROUP BY session_id, run"""


@query("I12_gap_sessions", _GAPS)
def _(fx):
    return I.gap_sessions(fx.tool_events, "session_id", "2 hours", "10 minutes")


@query("I02_I12_stream_of_sessions", _GAPS)
def _(fx):
    # two runs of one stream over files that arrive in between, the second with events that come again, and one far ahead that closes what is open
    base, own = shared_path(fx.spark), fx.tool_events.select("session_id", "event_id", "name", "ts", "duration_ms")
    moment = F.avg(F.unix_micros(F.col("ts").cast("timestamp"))).cast("long")
    middle = own.agg(F.timestamp_micros(moment).cast("timestamp_ntz").alias("m"))
    marked = own.crossJoin(F.broadcast(middle)).withColumn("late", F.col("ts") >= F.col("m"))  # one row
    again = marked.filter(~F.col("late") & (F.col("ts") > F.col("m") - F.expr("interval 5 minutes")))
    ahead = own.agg((F.max("ts") + F.expr("interval 10 days")).alias("ts")).select(F.lit("ahead").alias("session_id"), F.lit(-1).cast("long").alias("event_id"), F.lit("ahead").alias("name"), "ts", F.lit(0.0).alias("duration_ms"))
    parts = [marked.filter(~F.col("late")).select(own.columns), marked.filter("late").select(own.columns).unionAll(again.select(own.columns)), ahead]
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        stream = fx.spark.readStream.schema(own.schema).parquet(f"{base}/in")
        I.exported_runs(I.gap_sessions(stream, "session_id", "2 hours", "10 minutes"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return fx.spark.read.parquet(f"{base}/out").filter("session_id <> 'ahead'")
