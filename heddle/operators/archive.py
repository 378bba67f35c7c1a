"""Identity, merging, upserts and integrity of archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.columns import canonical_json
from heddle.operators.ordered import keep_best, numbered, with_sums_before
from heddle.operators.sinks import described


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def content_hash(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """(id, content_sha256): one digest of what a session means.

    Of each message in order: role, kind, content, time, model, the source's own id, and the names of the tools it calls; of
    the session: tool, project, thread, and its first and last time. Where a session is stored, and how it was parsed, doesn't count.
    """
    tools = F.array_join(F.transform("tool_calls", lambda c: F.coalesce(c["tool"], F.lit(""))), "\x1e") if "tool_calls" in messages.columns else F.lit("")
    own = (F.col("role"), F.col("kind"), F.sha2(F.coalesce("content", F.lit("")), 256), F.col("timestamp"), _field(messages, "model"), _field(messages, "native_id"), F.coalesce(tools, F.lit("")))
    rows = messages.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("seq", canonical_json(*own).alias("line")))).alias("rows"))
    body = F.array_join(F.transform(F.coalesce("rows", F.array().cast("array<struct<seq:int,line:string>>")), lambda r: r["line"]), "\n")
    head = canonical_json(*(_field(sessions, c) for c in ("tool", "project", "thread_id", "created", "updated")))
    return sessions.join(rows, F.col("id") == F.col("session_id"), "left").select("id", F.sha2(F.concat_ws("\n", head, body), 256).alias("content_sha256"))


def store_fingerprint(sessions: DataFrame) -> DataFrame:
    """A digest of a store that doesn't depend on the order of rows: sums of parts of the rows' digests, no list of rows."""
    digest = F.sha2(canonical_json(F.col("id"), F.col("updated"), F.col("messages_count")), 256)
    part = lambda k: F.sum(F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)"))
    return sessions.agg(F.count("*").alias("n"), F.concat_ws("-", *(part(k).cast("string") for k in range(3))).alias("fingerprint"))


def resolved(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming (id, tool, namespace, content_sha256) with outcome against stored, the id to store under, and what that is a copy of.

    stored: id, namespace, content_sha256, copy_of, record_id. No row with the id: added. A row without a digest: refilled.
    The same content: identical. The same namespace, or none on record: refreshed. These keep the id. Else the session is a divergent
    copy, under tool:scope:id#n, scope being the namespace behind its first colon: a copy of that name with this content is
    reused (twin), else n is the least free number from 2 on; several new copies of a name are numbered by content.
    """
    same = stored.select("id", F.lit(True).alias("_there"), F.col("content_sha256").alias("_sha"), F.col("namespace").alias("_ns"), F.col("copy_of").alias("_of"))
    scope = F.regexp_replace("namespace", r"^[^:]*:", "")
    prefix = F.concat_ws(":", "tool", scope, "id")
    out = incoming.join(same, "id", "left").withColumn("prefix", prefix)
    kept = F.when(F.col("_there").isNull(), "added").when(F.col("_sha").isNull(), "refilled").when(F.col("_sha") == F.col("content_sha256"), "identical")
    out = out.withColumn("kept", kept.when(F.col("_ns").isNull() | (F.col("_ns") == F.col("namespace")), "refreshed"))
    copies = stored.filter(F.col("id").rlike(r"#\d+$")).select(F.regexp_replace("id", r"#\d+$", "").alias("prefix"), F.regexp_extract("id", r"#(\d+)$", 1).cast("int").alias("n"), "id", "content_sha256", "copy_of", "record_id")
    linked = copies.select("prefix", "content_sha256", F.col("id").alias("twin"), F.explode(F.array_distinct(F.array("copy_of", "record_id"))).alias("origin")).filter(F.col("origin").isNotNull())
    twins = linked.groupBy("prefix", "content_sha256", F.col("origin").alias("id")).agg(F.min("twin").alias("twin"))
    taken = copies.groupBy("prefix").agg(F.collect_set("n").alias("taken"))
    out = out.join(twins, ["prefix", "content_sha256", "id"], "left").join(taken, "prefix", "left")
    outcome = F.coalesce("kept", F.when(F.col("twin").isNotNull(), "twin").otherwise("copy"))
    out = out.withColumn("outcome", outcome)
    rank = F.dense_rank().over(Window.partitionBy("prefix", "outcome").orderBy("content_sha256"))
    used = F.coalesce("taken", F.array().cast("array<int>"))
    free = F.element_at(F.array_except(F.sequence(F.lit(2), F.size(used) + rank + 1), used), rank)
    store = F.when(F.col("outcome") == "copy", F.concat("prefix", F.lit("#"), free.cast("string"))).otherwise(F.coalesce(F.when(F.col("kept").isNull(), F.col("twin")), "id"))
    return out.select("id", "tool", "content_sha256", "namespace", "outcome", store.alias("store_id"), F.when(F.col("kept").isNull(), F.col("id")).otherwise(F.col("_of")).alias("copy_of"))


def copies_of(sessions: DataFrame, id_: str) -> DataFrame:
    """The divergent copies of a session."""
    return sessions.filter(F.col("copy_of_session_id") == id_).orderBy("id")


def origins(sessions: DataFrame) -> DataFrame:
    """(namespace, tool, origin, n, dominant): sessions by namespace, tool and origin; dominant marks the namespace that most sessions of a store come from."""
    counts = sessions.groupBy(F.col("source_namespace").alias("namespace"), "tool", "origin").agg(F.count("*").alias("n"))
    by_name = counts.filter(F.col("namespace").isNotNull()).groupBy("namespace").agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "namespace").limit(1).select("namespace", F.lit(True).alias("dominant"))
    return counts.join(F.broadcast(by_name), "namespace", "left").withColumn("dominant", F.coalesce("dominant", F.lit(False)))  # one row


def refreshed(stored: DataFrame, fresh: DataFrame, columns: list[str]) -> DataFrame:
    """Stored sessions with the metadata that fresh rows of the same id and content bring; what they don't know, and other content, stays."""
    new = fresh.select("id", F.col("content_sha256").alias("_sha"), *(F.col(c).alias(f"_{c}") for c in columns))
    out, same = stored.join(new, "id", "left"), F.col("_sha").eqNullSafe(F.col("content_sha256")) & F.col("_sha").isNotNull()
    return out.select(*(F.when(same, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns))


def union_of(sources: dict[str, DataFrame], wanted: list[str] | None = None) -> DataFrame:
    """The sessions of all sources that are asked for, with the source's name as tool; columns that a source lacks are null."""
    unknown = set(wanted or ()) - set(sources)
    if unknown:
        raise ValueError(f"no such source: {', '.join(sorted(unknown))}")
    out = None
    for name, df in sources.items():
        if not wanted or name in wanted:
            own = df.withColumn("tool", F.lit(name))
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def repaired_index(entries: DataFrame, indexed: DataFrame) -> DataFrame:
    """The index with orphans out and missing entries in: rows (id, body)."""
    kept = indexed.join(entries.select("id"), "id", "left_semi")
    return kept.unionByName(entries.select("id", "body").join(indexed.select("id"), "id", "left_anti"))


def repaired_places(links: DataFrame, messages: DataFrame) -> DataFrame:
    """Links (link_id, session_id, seq, native_id, sha256) whose place now lies elsewhere: (link_id, seq as it was, seq as it is)."""
    found = evidence(links, messages)
    return found.join(links.select("link_id", F.col("seq").alias("was")), "link_id").filter(F.col("seq").isNotNull() & ~F.col("seq").eqNullSafe(F.col("was"))).select("link_id", "was", "seq")


def freshness(stored: DataFrame, current: DataFrame, grace_seconds: int = 2) -> DataFrame:
    """(path, reason) of files that a store doesn't reflect: missing, new, or changed by more than the grace of a file system's clock."""
    a, b = stored.select("path", F.col("mtime_ns").alias("a")), current.select("path", F.col("mtime_ns").alias("b"))
    late = F.abs(F.col("b") - F.col("a")) > grace_seconds * 1_000_000_000
    reason = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "missing").when(late, "changed")
    return a.join(b, "path", "full_outer").select("path", reason.alias("reason")).filter(F.col("reason").isNotNull())


def assert_fresh(stored: DataFrame, current: DataFrame) -> None:
    """ValueError with up to ten of the files that a store doesn't reflect."""
    stale = [f"{r.path} ({r.reason})" for r in freshness(stored, current).orderBy("path").limit(10).collect()]
    if stale:
        raise ValueError(f"the store is stale: {', '.join(stale)}")


def upserted(stored: DataFrame, fresh: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """fresh rows replace stored ones of the same key, but never an older version a newer one."""
    both = stored.withColumn("_from", F.lit(0)).unionByName(fresh.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    order = ([F.desc(version)] if version else []) + [F.desc("_from"), F.desc(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(fresh.columns)))))]  # the same row on every replay
    return keep_best(both, [key], order).drop("_from")


def regrouped(stored: DataFrame, fresh: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Tables with many rows for a key: stored rows of other keys than these, and the fresh rows of these keys."""
    these = keys.select(key).distinct()
    return stored.join(these, key, "left_anti").unionByName(fresh.join(these, key, "left_semi"), allowMissingColumns=True)


def counted(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with messages_count, prompt_count and content_sha256 of their messages, and messages_synced set."""
    prompt = (F.col("role") == "user") & (F.col("kind") == "text") & F.col("content").rlike(r"\S")
    counts = messages.groupBy(F.col("session_id").alias("id")).agg(F.count("*").cast("int").alias("n"), F.count_if(prompt).cast("int").alias("p"))
    out = sessions.join(counts, "id", "left").withColumns({"messages_count": F.coalesce("n", F.lit(0)), "prompt_count": F.coalesce("p", F.lit(0)), "messages_synced": F.lit(True)})
    return out.drop("n", "p", "content_sha256").join(content_hash(messages, sessions), "id").select(sessions.columns)


#: What decides between two parses of a session, the later the better.
PARSE = ("parser_version", "source_mtime_ns", "updated")


def synced(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The newest parse of each session of a batch, with outcome: added, replaced, unchanged (the same parse of the same content), or older (what is stored stays)."""
    newest = keep_best(fresh, ["id"], [F.desc_nulls_last(c) for c in PARSE] + [F.asc("content_sha256"), F.asc("source_path")])
    have = stored.select("id", F.lit(True).alias("_there"), F.col("content_sha256").alias("_sha"), *(F.col(c).alias(f"_{c}") for c in PARSE))
    out, older, same = newest.join(have, "id", "left"), F.lit(False), F.lit(True)
    for c in PARSE:  # compared from left to right
        mine, theirs = F.coalesce(F.col(c).cast("string"), F.lit("")), F.coalesce(F.col(f"_{c}").cast("string"), F.lit(""))
        less = F.coalesce(F.col(c) < F.col(f"_{c}"), F.col(c).isNull() & F.col(f"_{c}").isNotNull())
        older, same = older | (same & less), same & (mine == theirs)
    same = same & F.col("content_sha256").eqNullSafe(F.col("_sha"))
    outcome = F.when(F.col("_there").isNull(), "added").when(older, "older").when(same, "unchanged").otherwise("replaced")
    return out.withColumn("outcome", outcome).select(*fresh.columns, "outcome")


def unobserved(prior: DataFrame, observed: DataFrame, *hidden: DataFrame) -> DataFrame:
    """Prior rows that were neither seen again nor hidden."""
    out = prior
    for other in (observed, *hidden):
        out = out.join(other.select("id"), "id", "left_anti")
    return out


def captured(revisions: DataFrame, log: DataFrame) -> DataFrame:
    """New revisions (identity, sha256, captured_at): known content is dropped, numbers go on from the log's."""
    new = revisions.join(log.select("identity", "sha256"), ["identity", "sha256"], "left_anti")
    new = keep_best(new, ["identity", "sha256"], [F.asc("captured_at")])
    last = log.groupBy("identity").agg(F.max("revision").alias("last"))
    return numbered(new.join(last, "identity", "left"), ["identity"], [F.asc("captured_at"), F.asc("sha256")], F.coalesce("last", F.lit(0))).drop("last")


def full_merge(prior: DataFrame, fresh: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Prior and fresh rows by key, fresh values first."""
    a, b = prior.select(key, *(F.col(c).alias(f"p_{c}") for c in cols)), fresh.select(key, *(F.col(c).alias(f"f_{c}") for c in cols))
    return a.join(b, key, "full_outer").select(key, *(F.coalesce(f"f_{c}", f"p_{c}").alias(c) for c in cols))


def latest_of(rows: DataFrame, key: str, at: str, payload: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*payload), F.struct(at, *payload)).alias("x")).select(key, *(F.col(f"x.{c}").alias(c) for c in payload))


def evidence(links: DataFrame, messages: DataFrame) -> DataFrame:
    """Links (link_id, session_id, seq, native_id, sha256) to messages: by place if the content is still there, else by the source's own id, else by content within the session."""
    m = messages.select("session_id", "seq", _field(messages, "native_id").alias("native_id"), F.sha2("content", 256).alias("sha256"))
    by_place = links.join(m.select("session_id", "seq", F.col("sha256").alias("found")), ["session_id", "seq"], "left")
    by_name = m.filter(F.col("native_id").isNotNull()).groupBy("session_id", "native_id").agg(F.min("seq").alias("name_seq"))
    by_text = m.groupBy("session_id", "sha256").agg(F.min("seq").alias("text_seq"))
    named = by_place if "native_id" in links.columns else by_place.withColumn("native_id", F.lit(None).cast("string"))
    out = named.join(by_name, ["session_id", "native_id"], "left").join(by_text, ["session_id", "sha256"], "left")
    ok = F.col("found").eqNullSafe(F.col("sha256"))
    how = F.when(ok, "place").when(F.col("name_seq").isNotNull(), "native_id").when(F.col("text_seq").isNotNull(), "content").otherwise("unresolved")
    return out.select("link_id", "session_id", F.when(ok, F.col("seq")).otherwise(F.coalesce("name_seq", "text_seq")).alias("seq"), how.alias("resolved_by"))


def index_health(entries: DataFrame, indexed: DataFrame) -> DataFrame:
    """(problem, id): entries missing in the index, and index rows without an entry."""
    missing = entries.select("id").join(indexed.select("id"), "id", "left_anti").select(F.lit("missing").alias("problem"), "id")
    return missing.unionByName(indexed.select("id").join(entries.select("id"), "id", "left_anti").select(F.lit("orphan").alias("problem"), "id"))


def problems(tables: dict[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """(name, problem) of a snapshot's tables that differ from its manifest: missing, other fields, another count, other rows."""
    found = described(tables).select("name", *(F.col(c).alias(f"_{c}") for c in ("n", "checksum", "fields")))
    own = manifest.join(found, "name", "full_outer")
    other = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("n").isNull(), "not listed").when(other("fields"), "fields").when(other("n"), "count").when(other("checksum"), "content")
    return own.select("name", problem.alias("problem")).filter(F.col("problem").isNotNull())


def merged(sessions: DataFrame, messages: DataFrame, new_sessions: DataFrame, new_messages: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What merging another archive's sessions into this one changes: (sessions to store, messages to store, outcomes).

    Outcomes are those of resolved. Identical ones and twins change nothing; the others are stored under their ids here, with
    where they come from, and with their parents' ids here; the messages of a stored session replace those that it had.
    """
    own = sessions.select("id", F.col("source_namespace").alias("namespace"), "content_sha256", F.col("copy_of_session_id").alias("copy_of"), F.col("source_record_id").alias("record_id"))
    outcome = resolved(new_sessions.select("id", "tool", F.lit(namespace).alias("namespace"), "content_sha256"), own)
    ids = outcome.select(F.col("id").alias("_id"), "store_id", "copy_of", "outcome")
    parents = ids.select(F.col("_id").alias("parent_session_id"), F.col("store_id").alias("_parent"))
    out = new_sessions.join(ids.filter(~F.col("outcome").isin("identical", "twin")), F.col("id") == F.col("_id")).join(parents, "parent_session_id", "left")
    changed = {"id": F.col("store_id"), "source_record_id": F.col("_id"), "source_namespace": F.lit(namespace), "copy_of_session_id": F.col("copy_of"), "parent_session_id": F.coalesce("_parent", "parent_session_id")}
    out = out.select(*(changed.get(c, F.col(c)).alias(c) for c in new_sessions.columns), *(v.alias(k) for k, v in changed.items() if k not in new_sessions.columns))
    moved = new_messages.join(ids.filter(~F.col("outcome").isin("identical", "twin")).select(F.col("_id").alias("session_id"), "store_id"), "session_id")
    return out, moved.select(*(F.col("store_id").alias(c) if c == "session_id" else F.col(c) for c in new_messages.columns)), outcome


def merged_memory(memory: DataFrame, new: DataFrame) -> DataFrame:
    """New entries that this store lacks (by title, case aside, body, kind and scope), under the next free ids."""
    key = [F.lower("title").alias("k1"), F.sha2("body", 256).alias("k2"), F.col("kind").alias("k3"), F.coalesce("scope_project", F.lit("")).alias("k4"), F.coalesce("scope_tool", F.lit("")).alias("k5")]
    names = [f"k{i}" for i in range(1, 6)]
    fresh = keep_best(new.select("*", *key), names, [F.asc("id")]).join(memory.select(*key).distinct(), names, "left_anti").drop(*names)
    last = memory.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    numbered_ = with_sums_before(fresh.withColumn("one", F.lit(1)), "id", ["one"]).join(F.broadcast(last))  # last is one row
    return numbered_.withColumn("id", F.col("last") + F.col("one_before") + 1).drop("last", "one", "one_before")


def with_parents(sessions: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, parent, parent_title) of sessions whose parent is there; ids (id, store_id) tells under which ids a merge stored them."""
    p = sessions.select(F.col("id").alias("parent"), F.col("title").alias("parent_title"))
    own = sessions
    if ids is not None:
        new = ids.select(F.col("id").alias("parent_session_id"), "store_id")
        own = own.join(new, "parent_session_id", "left").withColumn("parent_session_id", F.coalesce("store_id", "parent_session_id"))
    return own.join(p, F.col("parent_session_id") == F.col("parent")).select("id", "parent", "parent_title")
