"""Sessions, messages, tool events, memory and their annotations derived from the test tables, for Spark and for DuckDB."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_path(spark: SparkSession) -> str:
    """A path of our own that driver and tasks see: below spark.checkpoint.dir, or on one machine, where that is unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/heddle-{uuid.uuid4().hex}"


_TOOLS = ("claude-code", "codex", "cursor", "gemini-cli", "aider")


class Fixtures:
    """The derived tables of one folder as DataFrames with canonical column names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def messages(self) -> DataFrame:
        return self.table("conversations").selectExpr(
            "concat('c', lpad(cast(conv_id as string), 6, '0')) as session_id", "conv_id", "cast(turn as int) as seq", "role", "text as content",
            "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn as int), 0) as timestamp",
            "case when role = 'system' then 'injected_context' else 'text' end as kind",
        )

    @property
    def sessions(self) -> DataFrame:
        prompt = (F.col("role") == "user") & (F.col("kind") == "text") & F.col("content").rlike(r"\S")
        own = self.messages.groupBy("conv_id", F.col("session_id").alias("id")).agg(
            F.min("timestamp").alias("created"), F.max("timestamp").alias("updated"), F.count("*").cast("int").alias("messages_count"), F.count_if(prompt).cast("int").alias("prompt_count"),
            F.sum(F.when(F.col("role").isin("user", "assistant"), F.length("content"))).cast("long").alias("total_tokens"),
        )
        tools = "element_at(array({}), cast(conv_id % 5 as int) + 1)".format(", ".join(f"'{t}'" for t in _TOOLS))
        return own.selectExpr(
            "id", f"{tools} as tool", "case when conv_id % 11 = 0 then null else concat('/work/p', cast(conv_id % 7 as string)) end as project",
            "case conv_id % 10 when 7 then 'subagent' when 8 then 'cron' when 9 then 'unknown' else 'interactive' end as origin",
            "case when conv_id % 10 = 7 then concat('c', lpad(cast(conv_id - 1 as string), 6, '0')) end as parent_session_id",
            "messages_count", "prompt_count", "total_tokens", "concat('T', cast(conv_id % 13 as string)) as title", "created", "updated", "conv_id",
        ).selectExpr("*", "case when project is null then concat('session:', left(id, 12)) else concat('project:', sha2(project, 256)) end as thread_id")

    @property
    def tool_events(self) -> DataFrame:
        return self.table("events").selectExpr(
            "concat('u', cast(user_id as string)) as session_id", "event_id", "event_type as name", "ts", "case event_type when 'error' then 'failed' when 'view' then null else 'completed' end as status",
            "event_type = 'error' as is_error", "value as duration_ms",
        )

    @property
    def memory(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "doc_id as id", "element_at(array('fact', 'decision', 'lesson', 'note'), cast(doc_id % 4 as int) + 1) as kind", "left(text, 20) as title", "text as body",
            "case when doc_id % 3 = 0 then null else source end as scope_project", "lang as scope_tool",
            "case when doc_id % 17 = 0 then 'rejected' when doc_id % 13 = 0 then 'candidate' else 'confirmed' end as status",
            "case when doc_id % 19 = 0 and doc_id > 0 then doc_id - 1 end as superseded_by",
            "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id % 500 as int), 0) as updated",
        )

    @property
    def tags(self) -> DataFrame:
        own = self.sessions.selectExpr("id as session_id", "conv_id")
        return own.filter("conv_id % 3 = 0").selectExpr("session_id", "'review' as tag").unionAll(own.filter("conv_id % 4 = 0").selectExpr("session_id", "'urgent' as tag"))

    @property
    def deleted(self) -> DataFrame:
        return self.sessions.filter("conv_id % 23 = 0").select("id")

    @property
    def ignored(self) -> DataFrame:
        return self.sessions.filter("conv_id % 29 = 5").select("id")

    @property
    def feedback(self) -> DataFrame:
        return self.table("labels").selectExpr("doc_id as memory_id", "explode(array(0L, 1L, 2L)) as rater").selectExpr("memory_id", "rater", "cast(1 + (memory_id * 7 + rater) % 5 as int) as score")

    @property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").selectExpr("vec_id as key", "embedding", "label")


#: The same tables as common table expressions.
CTE = """
fx_messages AS (SELECT 'c' || lpad(CAST(conv_id AS VARCHAR), 6, '0') AS session_id, conv_id, CAST(turn AS INTEGER) AS seq, role, text AS content,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS timestamp,
  CASE WHEN role = 'system' THEN 'injected_context' ELSE 'text' END AS kind FROM conversations),
fx_own AS (SELECT conv_id, session_id AS id, min(timestamp) AS created, max(timestamp) AS updated, CAST(count(*) AS INTEGER) AS messages_count,
  CAST(count(*) FILTER (role = 'user' AND kind = 'text' AND trim(coalesce(content, '')) <> '') AS INTEGER) AS prompt_count,
  CAST(sum(length(content)) FILTER (role IN ('user', 'assistant')) AS BIGINT) AS total_tokens FROM fx_messages GROUP BY 1, 2),
fx_sessions AS (SELECT *, CASE WHEN project IS NULL THEN 'session:' || left(id, 12) ELSE 'project:' || sha256(project) END AS thread_id FROM (SELECT id,
  (['claude-code', 'codex', 'cursor', 'gemini-cli', 'aider'])[CAST(conv_id % 5 AS INTEGER) + 1] AS tool,
  CASE WHEN conv_id % 11 = 0 THEN NULL ELSE '/work/p' || CAST(conv_id % 7 AS VARCHAR) END AS project,
  CASE conv_id % 10 WHEN 7 THEN 'subagent' WHEN 8 THEN 'cron' WHEN 9 THEN 'unknown' ELSE 'interactive' END AS origin,
  CASE WHEN conv_id % 10 = 7 THEN 'c' || lpad(CAST(conv_id - 1 AS VARCHAR), 6, '0') END AS parent_session_id,
  messages_count, prompt_count, total_tokens, 'T' || CAST(conv_id % 13 AS VARCHAR) AS title, created, updated, conv_id FROM fx_own)),
fx_tool_events AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS session_id, event_id, event_type AS name, ts,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN NULL ELSE 'completed' END AS status, event_type = 'error' AS is_error, value AS duration_ms FROM events),
fx_memory AS (SELECT doc_id AS id, (['fact', 'decision', 'lesson', 'note'])[CAST(doc_id % 4 AS INTEGER) + 1] AS kind, left(text, 20) AS title, text AS body,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS scope_project, lang AS scope_tool,
  CASE WHEN doc_id % 17 = 0 THEN 'rejected' WHEN doc_id % 13 = 0 THEN 'candidate' ELSE 'confirmed' END AS status,
  CASE WHEN doc_id % 19 = 0 AND doc_id > 0 THEN doc_id - 1 END AS superseded_by,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id % 500 AS INTEGER)) AS updated FROM documents),
fx_tags AS (SELECT id AS session_id, 'review' AS tag FROM fx_sessions WHERE conv_id % 3 = 0 UNION ALL SELECT id, 'urgent' FROM fx_sessions WHERE conv_id % 4 = 0),
fx_deleted AS (SELECT id FROM fx_sessions WHERE conv_id % 23 = 0),
fx_ignored AS (SELECT id FROM fx_sessions WHERE conv_id % 29 = 5),
fx_feedback AS (SELECT doc_id AS memory_id, r.rater, CAST(1 + (doc_id * 7 + r.rater) % 5 AS INTEGER) AS score FROM labels, (SELECT unnest([0, 1, 2]) AS rater) r),
fx_vectors AS (SELECT vec_id AS key, embedding, label FROM embeddings)
"""
