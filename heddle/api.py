"""One archive: its tables, and all that can be asked of them, as DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle import schemas
from heddle.constants import FUSION_WINDOW, RECALL_FLOOR, SESSION_CUTOFF
from heddle.operators import aggregates, analytics, archive, markdown, memory, ordered, search, sinks, vectors, visibility
from heddle.operators import sessions as sessions_
from heddle.operators.text_index import TextIndex
from heddle.sources import files, jsonl
from heddle.streaming.ingest import Snapshots, changed

_TABLES = {"sessions": schemas.SESSIONS, "messages": schemas.MESSAGES, "memory": schemas.MEMORY, "vectors": schemas.VECTORS}
_SMALL = {
    "tags": "session_id string, tag string",
    "deleted": "id string",
    "ignored": "id string",
    "feedback": "memory_id bigint, rater string, score int, created timestamp",
}


_PASSED = "path string, mtime bigint, parser_version int"


class Archive:
    """Tables below a path, each a series of snapshots, and an index of their texts.

    What changes the archive runs at once; a question gives a DataFrame, and runs nothing but reads of the tables' logs.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.index = TextIndex(spark, f"{self.path}/index")

    def store(self, name: str) -> Snapshots:
        return Snapshots(self.spark, f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        df = self.store(name).current()
        if name in _TABLES:
            return schemas.with_defaults(df, _TABLES[name]) if df is not None else self.spark.createDataFrame([], _TABLES[name])
        return df if df is not None else self.spark.createDataFrame([], _SMALL[name])

    def register(self) -> None:
        """Temporary views of all tables, for SQL."""
        for name in (*_TABLES, *_SMALL):
            self.table(name).createOrReplaceTempView(name)
        self.index.postings().createOrReplaceTempView("postings")

    def visible(self, include_automated: bool = False) -> DataFrame:
        return visibility.visible(self.table("sessions"), self.table("deleted"), self.table("ignored"), include_automated)

    def list_sessions(self, number: int = 1, per_page: int = 50, tag: str | None = None, **filters) -> DataFrame:
        own = visibility.listed(self.visible(include_automated=tag is not None), **filters)
        own = visibility.tagged(own, self.table("tags"), tag) if tag else own
        return visibility.page(own, visibility.newest_first(), number, per_page)

    def session(self, id_: str) -> DataFrame:
        return self.table("messages").filter(F.col("session_id") == id_).orderBy("seq")

    def _texts(self, sessions: DataFrame, messages: DataFrame) -> DataFrame:
        """(doc, text) of sessions: title and messages."""
        bodies = sessions_.body_text(messages)
        return sessions.join(bodies, F.col("id") == F.col("session_id"), "left").select(F.col("id").alias("doc"), F.concat_ws("\n", "title", bodies["text"]).alias("text"))

    def _memory_texts(self, entries: DataFrame) -> DataFrame:
        return entries.select(F.concat(F.lit("memory:"), F.col("id").cast("string")).alias("doc"), F.concat_ws("\n", "title", "body").alias("text"))

    def _all_texts(self) -> DataFrame:
        return self._texts(self.table("sessions"), self.table("messages")).unionByName(self._memory_texts(self.table("memory")))

    def reindex(self) -> None:
        """Builds the index of the titles and bodies of sessions and memory entries anew."""
        self.index.rebuild(self._all_texts())

    def sync(self, sessions: DataFrame, messages: DataFrame) -> DataFrame:
        """Stores parsed sessions with their messages; gives (id, outcome).

        Of several parses of a session the newest counts, and none replaces a newer one that is stored. All messages of a
        session that is added or replaced are replaced: those that are gone are gone, and so is their text in the index. The
        sessions are stored last and decide what is new, so that after a crash the same call does again what is missing.
        Where a batch may hold several parses of a session, source_path of sessions and messages tells them apart.
        """
        newest = ordered.keep_best(schemas.with_defaults(sessions, schemas.SESSIONS), ["id"], [F.desc_nulls_last(c) for c in archive.PARSE] + [F.asc("source_path")])
        on = [c for c in ("session_id", "source_path") if c in messages.columns]
        own = messages.join(newest.withColumnRenamed("id", "session_id").select(*on), on, "left_semi")
        own = ordered.keep_best(schemas.with_defaults(own, schemas.MESSAGES), ["session_id", "seq"], [F.asc(F.xxhash64("role", "content"))])
        batch = f"{self.path}/syncs/{uuid.uuid4().hex}"
        own.write.parquet(f"{batch}/messages")
        own = self.spark.read.schema(schemas.MESSAGES).parquet(f"{batch}/messages")
        fresh = archive.counted(newest, own)
        archive.synced(self.table("sessions"), fresh).write.parquet(f"{batch}/sessions")
        outcome = self.spark.read.parquet(f"{batch}/sessions")
        changed = outcome.filter(F.col("outcome").isin("added", "replaced"))
        if changed.head(1):
            keys = changed.select(F.col("id").alias("session_id"))
            self.store("messages").replace_groups(own, keys, "session_id")
            if self.index.exists():
                self.index.update(self._texts(changed, own.join(keys, "session_id", "left_semi")))
            self.store("sessions").upsert(changed.drop("outcome"), "id")
        return outcome.select("id", "outcome")

    def pull(self, path: str, fmt: jsonl.Format, most: int = 10_000) -> dict[str, int]:
        """Syncs the transcripts below path that are new, changed, or read by an older parser; gives how many sessions had which outcome.

        Listing reads no file; files are read in rounds of `most`, those changed first before others.
        """
        outcomes: dict[str, int] = {}
        while True:
            listing = files.listed(self.spark, path, fmt.glob)
            due = changed(listing, self._passed(), fmt.parser_version).orderBy("mtime", "path").limit(most).collect()  # a round's paths
            if not due:
                return outcomes
            rows = jsonl.read(self.spark, [r["path"] for r in due])
            sessions, messages = jsonl.sessions_of(rows, fmt), jsonl.messages_of(rows, fmt)
            sessions = sessions.withColumn("source_mtime_ns", F.unix_micros(F.col("modified").cast("timestamp")) * 1000)
            found = self.sync(sessions, jsonl.with_calls(messages).withColumnRenamed("file", "source_path"))
            for r in found.groupBy("outcome").count().collect():  # four outcomes
                outcomes[r["outcome"]] = outcomes.get(r["outcome"], 0) + r["count"]
            seen = self.spark.createDataFrame([(r["path"], r["mtime"], fmt.parser_version) for r in due], _PASSED)
            self.store("passed").upsert(seen, "path")

    def _passed(self) -> DataFrame:
        """Files that were read, also those that brought no session."""
        own = self.store("passed").current()
        return own if own is not None else self.spark.createDataFrame([], _PASSED)

    def search(self, text: str, limit: int = 20, offset: int = 0, vector: Sequence[float] | None = None, roles: list[str] | None = None, **filters) -> DataFrame:
        """(id, score) of sessions, best first; with a vector both ways of searching are fused; filters come before limits.

        Without an index the texts are read and tokenized for this search.
        """
        parsed = search.parse(text)
        own = visibility.listed(self.visible(), **filters).select("id")
        if parsed is None:
            return own.limit(0).withColumn("score", F.lit(0.0))
        hits = self._matches(parsed).withColumnRenamed("doc", "id").join(own, "id", "left_semi")
        if roles:
            # messages of the sessions that have all terms anywhere: no others can have them in one message
            of_hits = self.table("messages").join(hits.select(F.col("id").alias("session_id")), "session_id", "left_semi")
            hits = hits.join(search.in_scope(of_hits, parsed, roles).select(F.col("session_id").alias("id")).distinct(), "id", "left_semi")
            return hits.orderBy("score", "id").offset(offset).limit(limit)
        if vector is None or parsed.kind == "phrase":
            return hits.orderBy("score", "id").offset(offset).limit(limit)
        window = max(FUSION_WINDOW, limit + offset)
        near = self.table("vectors").filter("entity_type = 'session'").withColumnRenamed("entity_key", "id").join(own, "id", "left_semi")
        near = vectors.nearest(near, vector, window, SESSION_CUTOFF, key="id").select("id", "distance")
        fused = vectors.fuse([hits.orderBy("score", "id").limit(window), near], "id", [[F.asc("score"), F.asc("id")], [F.asc("distance"), F.asc("id")]])
        return fused.offset(offset).limit(limit)

    def search_page(self, text: str, limit: int = 20, offset: int = 0, **options) -> DataFrame:
        """(id, tool, project, title, score, snippet) of the hits of search, each with the best stretch of its body; bodies are read for this page only."""
        hits = self.search(text, limit, offset, **options)
        parsed = search.parse(text)
        shown = hits.join(self.table("sessions").select("id", "tool", "project", "title"), "id")
        own = self.table("messages").join(F.broadcast(hits.select(F.col("id").alias("session_id"))), "session_id", "left_semi")  # a page at most
        out = shown.join(sessions_.body_text(own).withColumnRenamed("session_id", "id"), "id", "left")
        out = out.withColumn("snippet", F.lit("")) if parsed is None else search.with_snippets(out, "text", parsed)
        order = F.asc("score") if options.get("vector") is None else F.desc("score")
        return out.select("id", "tool", "project", "title", "score", "snippet").orderBy(order, "id")

    def _index(self) -> tuple[DataFrame, int, float]:
        """(postings, documents, mean length): those of the index, or without one those of the texts as they are now."""
        if self.index.exists():
            return self.index.postings(), *self.index.statistics()
        texts = self._all_texts()
        own = search.postings(texts, "doc", F.col("text"))
        return own, *search.statistics(own, texts.count())

    def _matches(self, parsed: search.Query) -> DataFrame:
        own, n, mean = self._index()
        return search.matches(own, parsed, n, mean)

    def search_messages(self, text: str, limit: int = 20) -> DataFrame:
        own, n, mean = self._index()
        shown = self.table("messages").join(self.visible().select(F.col("id").alias("session_id")), "session_id", "left_semi")
        return search.search_messages(shown, own, search.parse(text), n, mean, limit)

    def recall_text(self, text: str, vector: Sequence[float] | None = None, semantic: bool | None = None, limit: int = 10, **filters) -> DataFrame:
        """(id, score) of memory entries by keywords, similarity or both (see memory.recalled); postings have entries as memory:id."""
        near = self.table("vectors").filter("entity_type = 'memory'").select(F.col("entity_key").cast("bigint").alias("id"), "embedding")
        return memory.recalled(self.table("memory"), self._matches, text, limit=limit, vectors=near, vector=vector, semantic=semantic, **filters)

    def search_message_vectors(self, vector: Sequence[float], limit: int = 20) -> DataFrame:
        own = self.table("vectors").filter("entity_type = 'message'").withColumn("_k", F.split("entity_key", "#m"))
        own = own.select(F.col("_k")[0].alias("session_id"), F.col("_k")[1].cast("int").alias("seq"), "content_hash", "embedding")
        return vectors.nearest_messages(own, self.table("messages"), self.visible(), vector, limit)

    def recall(self, vector: Sequence[float], limit: int = 10, **filters) -> DataFrame:
        """Memory entries by similarity, from the recall floor on."""
        own = memory.active(self.table("memory"), **filters)
        near = self.table("vectors").filter("entity_type = 'memory'").select(F.col("entity_key").cast("bigint").alias("id"), "embedding")
        return vectors.most_similar(own.join(near, "id"), vector, limit, RECALL_FLOOR, key="id")

    def digest(self, since: str, until: str, by: str | None = None) -> DataFrame:
        return aggregates.digest_by(self.visible(), since, until, by) if by else aggregates.digest_totals(self.visible(), since, until)

    def costs(self) -> DataFrame:
        return aggregates.token_costs(self.table("sessions"))

    def stats(self) -> DataFrame:
        return aggregates.archive_stats(self.visible())

    def projects(self) -> DataFrame:
        return aggregates.projects_overview(self.visible())

    def threads(self) -> DataFrame:
        return aggregates.threads_overview(self.visible(include_automated=True))

    def metrics(self) -> dict[str, DataFrame]:
        messages = self.table("messages")
        events = messages.select("session_id", F.explode("tool_events").alias("e")).select("session_id", "e.*")
        return {
            "sessions_by_origin": aggregates.sessions_by_origin(self.table("sessions")), "means": aggregates.means_over_messages(messages), "tool_call_failure_rate": aggregates.failure_rate(events),
            "median_session_duration_seconds": aggregates.median_duration(self.table("sessions")), "inferred_outcomes": aggregates.inferred_outcomes(messages),
        }

    def rules(self) -> DataFrame:
        return analytics.recommendations(self.table("messages"), self.visible())

    def compress(self, id_: str | None = None, chunk_chars: int = 12_000) -> DataFrame:
        blocks = analytics.compressed(self.table("messages") if id_ is None else self.session(id_))
        return blocks.join(ordered.chunks(blocks, "session_id", chunk_chars), ["session_id", "block"])

    def dedupe(self) -> DataFrame:
        return memory.duplicates(self.table("memory"), self.table("feedback"))

    def add_memory(self, entries: DataFrame) -> DataFrame:
        """Stores the valid entries; gives the others with the reason."""
        checked = entries.withColumn("reason", memory.invalid_reason())
        good = schemas.with_defaults(checked.filter("reason is null"), schemas.MEMORY)
        self.store("memory").upsert(good, "id")
        if self.index.exists():
            self.index.update(self._memory_texts(ordered.keep_best(good, ["id"], [F.desc_nulls_last("updated"), F.asc("title"), F.asc("body")])))
        return checked.filter("reason is not null")

    def merge(self, incoming: DataFrame, namespace: str) -> DataFrame:
        """Outcome of merging another archive's sessions (id, tool, content_sha256, ...) into this one; divergent copies get ids of their own. Nothing is stored."""
        own = self.table("sessions").select("id", "content_sha256", F.col("source_namespace").alias("namespace"), F.col("copy_of_session_id").alias("copy_of"), F.col("source_record_id").alias("record_id"))
        return archive.resolved(incoming.select("id", "tool", "content_sha256", F.lit(namespace).alias("namespace")), own)

    def bundle(self, path: str) -> DataFrame:
        """Writes all tables of the archive below path; gives the manifest."""
        return sinks.snapshot({name: self.table(name) for name in (*_TABLES, *_SMALL)}, path)

    def _opened(self, path: str) -> dict[str, DataFrame]:
        tables, manifest = sinks.opened(self.spark, path)
        bad = archive.problems(tables, manifest).collect()
        if bad:
            raise ValueError("the bundle is damaged: " + ", ".join(f"{r['name']} ({r['problem']})" for r in bad))
        return tables

    def restore(self, path: str) -> None:
        """Puts a bundle's tables in place of this archive's, after they are held against the manifest; an index is built anew."""
        for name, df in self._opened(path).items():
            self.store(name).replace(df, {"sessions": "id", "messages": "session_id", "memory": "id"}.get(name))
        if self.index.exists():
            self.reindex()

    def import_bundle(self, path: str, namespace: str) -> DataFrame:
        """Merges a bundle of another archive into this one: sessions with their messages, memory, tags and hidden ids; gives (outcome, n)."""
        own = self._opened(path)
        new, messages, outcome = archive.merged(self.table("sessions"), self.table("messages"), own["sessions"], own["messages"], namespace)
        report = outcome.groupBy("outcome").agg(F.count("*").alias("n")).collect()  # seven outcomes at most
        self.store("messages").replace_groups(messages, new.select(F.col("id").alias("session_id")), "session_id")
        memories = archive.merged_memory(self.table("memory"), own["memory"])
        self.store("memory").upsert(schemas.with_defaults(memories, schemas.MEMORY), "id")
        self.store("tags").replace(memory.tag_changes(self.table("tags"), own["tags"], self.table("tags").limit(0)))
        for name in ("deleted", "ignored"):
            self.store(name).replace(self.table(name).union(own[name]).distinct())
        self.store("sessions").upsert(schemas.with_defaults(new, schemas.SESSIONS), "id")
        return self.spark.createDataFrame([(r["outcome"], r["n"]) for r in report], "outcome string, n long")

    def tag(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Adds and removes tags (session_id, tag)."""
        own = self.table("tags")
        self.store("tags").replace(memory.tag_changes(own, own.limit(0) if added is None else added, own.limit(0) if removed is None else removed))

    def hide(self, ids: DataFrame, ignored: bool = False) -> None:
        """Puts sessions (id) on the list of the deleted or of the ignored."""
        name = "ignored" if ignored else "deleted"
        self.store(name).replace(self.table(name).union(ids.select("id")).distinct())

    def export(self, path: str, form: str = "markdown") -> None:
        texts = {"markdown": markdown.markdown, "html": sinks.html}[form](self.visible(), self.table("messages"))
        sinks.write_texts(texts, path)

    def export_library(self, path: str | None = None, per_page: int = 1000) -> dict[str, int]:
        """Keeps the table library (page, text) of index, project and day pages and of one page a session; gives how many pages changed and went.

        Only pages that differ are stored, and with a path also written there as files; without changes nothing is.
        """
        shown = self.visible()
        own = markdown.markdown(shown, self.table("messages")).select(F.concat(F.lit("Sessions/"), "id").alias("page"), "text")
        pages = sinks.library(shown, per_page).unionByName(own)
        stored = self.store("library").current()
        stored = self.spark.createDataFrame([], "page string, text string") if stored is None else stored
        changed_, gone = sinks.page_changes(pages, stored)
        keys = changed_.select("page").union(gone)
        counts = {"changed": changed_.count(), "gone": gone.count()}
        if any(counts.values()):
            self.store("library").replace_groups(pages, keys, "page")
            if path:
                sinks.write_texts(self.store("library").current().join(changed_.select("page"), "page", "left_semi").withColumn("page", F.translate("page", "/ ", "--")), path, "page")
        return counts

    def health(self) -> DataFrame:
        entries = self.table("memory").select(F.concat(F.lit("memory:"), F.col("id").cast("string")).alias("id"))
        return archive.index_health(self.table("sessions").select("id").unionByName(entries), self.index.documents().select(F.col("doc").alias("id")))
