"""Transcripts kept as JSON lines: one description for each format, one plan for all of them.

A file is read whole (one session, so bounded), its lines become rows, and built-in JSON functions do the rest.
Blank and malformed lines are skipped and counted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import columns as C

_BLOCKS = "array<struct<type:string,text:string,thinking:string,name:string,id:string,input:string,arguments:string,tool_use_id:string,toolCallId:string,content:string,is_error:boolean,output:string>>"


@dataclass(frozen=True)
class Format:
    """Where a format keeps what: JSON paths, tried in order."""

    tool: str
    glob: str
    kind: str = "$.type"
    roles: dict[str, str] = field(default_factory=lambda: {"user": "user", "assistant": "assistant"})
    session: tuple[str, ...] = ("$.sessionId",)
    content: tuple[str, ...] = ("$.message.content", "$.content")
    time: tuple[str, ...] = ("$.timestamp",)
    model: tuple[str, ...] = ("$.message.model", "$.model")
    project: tuple[str, ...] = ("$.cwd",)
    titles: tuple[tuple[str, str], ...] = ()
    injected: tuple[str, ...] = ("$.isMeta", "$.isVisibleInTranscriptOnly")
    summary: tuple[str, ...] = ("$.isCompactSummary",)
    tokens: dict[str, str] = field(default_factory=lambda: {"input_tokens": "$.message.usage.input_tokens", "output_tokens": "$.message.usage.output_tokens"})
    native_id: tuple[str, ...] = ("$.uuid", "$.id")
    parent: tuple[str, ...] = ("$.parentUuid", "$.parentId")
    call_types: tuple[str, ...] = ()  # kinds of records ($.payload.type) that are calls of a tool, and that are results of one
    result_types: tuple[str, ...] = ()
    parser_version: int = 1
    by_folder: bool = False  # a session is a folder rather than a file


# Record kinds and keys of the formats.
FORMATS = {
    "claude-code": Format("claude-code", "*.jsonl", titles=(("custom-title", "$.customTitle"), ("ai-title", "$.aiTitle"), ("summary", "$.summary")), parser_version=5),
    "copilot-cli": Format("copilot-cli", "*.jsonl", roles={"user.message": "user", "assistant.message": "assistant"}, session=("$.data.sessionId",), content=("$.data.content",), project=("$.data.cwd",), native_id=("$.data.messageId", "$.id"), injected=(), summary=()),
    "qwen": Format("qwen", "*.jsonl", content=("$.message.parts", "$.message.content"), titles=(("custom_title", "$.systemPayload.customTitle"),), tokens={"total": "$.usageMetadata.totalTokenCount"}),
    "factory-droid": Format("factory-droid", "*.jsonl", kind="$.message.role", session=("$.session_id", "$.sessionId"), titles=(("session_start", "$.title"),)),
    "command-code": Format("command-code", "*.jsonl", kind="$.message.role", tokens={"total": "$.message.usage.total"}, parser_version=1),
    "codex": Format("codex", "*.jsonl*", kind="$.payload.role", content=("$.payload.content",), session=("$.payload.id",), model=("$.payload.model",), project=("$.payload.cwd",), tokens={"session_total": "$.payload.info.total_token_usage.total_tokens"}, call_types=("function_call", "custom_tool_call"), result_types=("function_call_output", "custom_tool_call_output"), parser_version=2),
    "antigravity": Format("antigravity", "transcript*.jsonl", roles={"USER_INPUT": "user", "PLANNER_RESPONSE": "assistant", "SYSTEM_MESSAGE": "system"}, content=("$.content",), time=("$.created_at",), native_id=("$.step_index",), parser_version=2, by_folder=True),
    "cursor-agent": Format("cursor-agent", "*.jsonl", kind="$.role", content=("$.message.content", "$.content")),
    "pi": Format("pi", "*.jsonl", kind="$.message.role", content=("$.message.content",), native_id=("$.id",), parent=("$.parentId",), tokens={"total": "$.message.usage.totalTokens"}),
}


def first_of(value: Column, paths: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.get_json_object(value, p) for p in paths)) if paths else F.lit(None).cast("string")


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file, modified, value): whole files below path whose names match; compressed ones are unpacked by their suffix."""
    own = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return own.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, modified, value) of these files, each whole; of none an empty table."""
    if not paths:
        return spark.createDataFrame([], "file string, modified timestamp, value string")
    own = spark.read.text(paths, wholetext=True)
    return own.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def lines_of(own: DataFrame) -> DataFrame:
    """(file, modified, line, value) of the non-blank lines of files."""
    return own.select("file", "modified", F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).filter(F.col("value").rlike(r"\S"))


def lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file, modified, line, value) of non-blank lines."""
    return lines_of(files(spark, path, glob))


def _truthy(value: Column, paths: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in paths:
        out = out | (F.coalesce(F.get_json_object(value, p), F.lit("false")) == "true")
    return out


def _text(block: Column) -> Column:
    """How a content block reads in a transcript."""
    target = C.tool_target(F.coalesce(block["input"], block["arguments"]))
    called = F.concat(F.lit("[Tool: "), F.coalesce(block["name"], F.lit("?")), F.lit("] "), F.coalesce(target, F.lit("")))
    result = F.concat(F.lit("[Tool Result] "), F.coalesce(block["content"], block["output"], F.lit("")))
    return F.when(block["type"].isin("tool_use", "toolCall"), called).when(block["type"].isin("tool_result", "toolResult"), result).otherwise(block["text"])


def subagent() -> Column:
    """Whether a file is the transcript of a helper that the session of the folder above started."""
    return F.col("file").rlike(r"/subagents/agent-[^/]+$")


def messages(spark: SparkSession, path: str, fmt: Format) -> DataFrame:
    """One row for each message: file, session_id, seq, role, content, reasoning, tool_calls and the rest of the canonical columns."""
    return messages_of(files(spark, path, fmt.glob), fmt)


def _with_call_records(rows: DataFrame, fmt: Format) -> DataFrame:
    """Rows whose records are calls or results as messages of one block: of the assistant, or of a tool."""
    if not fmt.call_types:
        return rows
    field = lambda *names: F.coalesce(*(F.get_json_object("value", f"$.payload.{n}") for n in names))
    kind = field("type")
    call = F.to_json(F.array(F.struct(F.lit("tool_use").alias("type"), field("call_id", "id").alias("id"), field("name").alias("name"), field("arguments", "input").alias("input"))))
    result = F.to_json(F.array(F.struct(F.lit("tool_result").alias("type"), field("call_id", "id").alias("tool_use_id"), field("output").alias("content"))))
    is_call, is_result = F.coalesce(kind.isin(*fmt.call_types), F.lit(False)), F.coalesce(kind.isin(*fmt.result_types), F.lit(False))
    raw = F.when(is_call, call).when(is_result, result).otherwise(F.col("raw"))
    first = next(k for k, role in fmt.roles.items() if role == "assistant")
    return rows.withColumns({"raw": raw, "kind_": F.when(is_call, first).when(is_result, "tool").otherwise(F.col("kind_"))})


def messages_of(own: DataFrame, fmt: Format) -> DataFrame:
    """The messages of files (file, modified, value)."""
    value = F.col("value")
    rows = lines_of(own).withColumns({"kind_": F.get_json_object("value", fmt.kind), "raw": first_of(value, fmt.content), "sid": first_of(value, fmt.session)})
    stem = F.regexp_extract("file", r"([^/]+)/[^/]+$" if fmt.by_folder else r"([^/]+?)(\.jsonl?(\.\w+)?)?$", 1)
    named = F.first("sid", True).over(Window.partitionBy("file"))
    rows = rows.withColumn("session_id", F.when(subagent(), F.concat_ws(":", named, stem)).otherwise(F.coalesce(named, stem)))
    rows = _with_call_records(rows, fmt)
    rows = rows.filter(F.col("kind_").isin(*fmt.roles, "tool") & F.col("raw").isNotNull())
    blocks = F.when(F.col("raw").startswith("["), F.from_json("raw", _BLOCKS))
    calls = F.transform(F.filter("blocks", lambda b: b["type"].isin("tool_use", "toolCall")), lambda b: F.struct(b["id"].alias("id"), b["name"].alias("tool"), F.coalesce(b["input"], b["arguments"]).alias("input")))
    results = F.transform(F.filter("blocks", lambda b: b["type"].isin("tool_result", "toolResult")), lambda b: F.struct(F.coalesce(b["tool_use_id"], b["toolCallId"]).alias("id"), F.coalesce(b["content"], b["output"]).alias("output"), F.coalesce(b["is_error"], F.lit(False)).alias("is_error")))
    role = F.col("kind_")
    for kind, name in fmt.roles.items():
        role = F.when(F.col("kind_") == kind, name).otherwise(role)
    tokens = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.get_json_object("value", p).cast("bigint").alias("v")) for k, p in fmt.tokens.items())), lambda e: e["v"].isNotNull())) if fmt.tokens else F.lit(None)
    return rows.withColumn("blocks", blocks).select(
        "file", "modified", "session_id", F.col("line").alias("seq"), role.alias("role"),
        F.when(F.col("blocks").isNull(), F.col("raw")).otherwise(F.array_join(F.filter(F.transform("blocks", _text), lambda t: t.isNotNull()), "\n")).alias("content"),
        C.timestamp_of(first_of(value, fmt.time)).cast("timestamp_ntz").alias("timestamp"), first_of(value, fmt.time).isNotNull().alias("timed"), first_of(value, fmt.model).alias("model"), tokens.cast("map<string,bigint>").alias("tokens"),
        F.when(_truthy(value, fmt.summary), "compaction_summary").when(_truthy(value, fmt.injected), "injected_context").otherwise("text").alias("kind"),
        F.nullif(F.array_join(F.filter(F.transform("blocks", lambda b: b["thinking"]), lambda t: t.isNotNull()), "\n"), F.lit("")).alias("reasoning"),
        first_of(value, fmt.native_id).alias("native_id"), first_of(value, fmt.parent).alias("parent_id"), calls.alias("calls"), results.alias("results"),
    )


def tool_calls(own: DataFrame) -> DataFrame:
    """(file, session_id, seq, id, tool, input, output, is_error): calls with the last result of their id; an error sticks; results before their call don't attach."""
    calls = own.select("file", "session_id", "seq", F.posexplode_outer("calls").alias("n", "c")).filter("c is not null").select("file", "session_id", "seq", "n", "c.*")
    results = own.select("file", F.col("seq").alias("at"), F.explode("results").alias("r")).select("file", "at", F.col("r.id").alias("id"), F.col("r.output").alias("output"), F.col("r.is_error").alias("is_error"))
    joined = calls.join(results, ["file", "id"], "left").withColumn("ok", F.col("at") > F.col("seq"))
    return joined.groupBy("file", "session_id", "seq", "n", "id", "tool", "input").agg(F.max_by("output", F.when(F.col("ok"), F.col("at"))).alias("output"), F.coalesce(F.bool_or(F.when(F.col("ok"), F.col("is_error"))), F.lit(False)).alias("is_error"))


def sessions(spark: SparkSession, path: str, fmt: Format) -> DataFrame:
    """One row for each session; of several files with the same session id the one with the newer last message."""
    return sessions_of(files(spark, path, fmt.glob), fmt).drop("modified")


def titled(sessions: DataFrame, titles: DataFrame) -> DataFrame:
    """Sessions with the titles (key, title) that a side table keeps for their ids or the names of their files; the id's goes first."""
    own = titles.groupBy("key").agg(F.min("title").alias("title"))
    by = lambda name, key: own.select(F.col("key").alias(key), F.col("title").alias(name))
    out = sessions.withColumn("_file", F.regexp_extract("source_path", r"([^/]+)$", 1)).join(by("_by_id", "id"), "id", "left").join(by("_by_file", "_file"), "_file", "left")
    return out.withColumn("title", F.coalesce("_by_id", "_by_file", "title")).select(sessions.columns)


def with_calls(own: DataFrame) -> DataFrame:
    """Messages with tool_calls in the canonical form, results attached."""
    calls = tool_calls(own).withColumn("call", F.struct("id", "tool", "input", "output", F.when(F.col("is_error"), "error").otherwise("completed").alias("status"), F.lit(False).alias("truncated"), "is_error", F.lit(None).cast("double").alias("duration_ms"), F.lit(None).cast("map<string,string>").alias("extra")))
    calls = calls.groupBy("file", "session_id", "seq").agg(F.map_from_entries(F.collect_list(F.struct("n", "call"))).alias("calls_"))
    listed = F.transform(F.array_sort(F.map_keys("calls_")), lambda n: F.col("calls_")[n])
    return own.drop("calls", "results").join(calls, ["file", "session_id", "seq"], "left").withColumn("tool_calls", listed).drop("calls_")


def sessions_of(rows: DataFrame, fmt: Format) -> DataFrame:
    """The sessions of files (file, modified, value), with modified."""
    own = messages_of(rows, fmt)
    prompt = (F.col("role") == "user") & (F.col("kind") == "text") & F.col("content").rlike(r"\S")
    at = F.when(F.col("timed"), F.col("timestamp"))
    out = own.groupBy("file", "session_id").agg(
        F.min(at).alias("created"), F.max(at).alias("updated"), F.max("modified").cast("timestamp_ntz").alias("modified"), F.count("*").cast("int").alias("messages_count"), F.count_if(prompt).cast("int").alias("prompt_count"),
        F.min_by("content", F.when(prompt, F.col("seq"))).alias("outline"),
    )
    meta = lines_of(rows).groupBy("file").agg(
        F.first(first_of(F.col("value"), fmt.project), True).alias("project"),
        F.coalesce(*(F.last(F.when(F.get_json_object("value", "$.type") == kind, F.get_json_object("value", p)), True) for kind, p in fmt.titles), F.lit(None).cast("string")).alias("native_title"),
    )
    out = out.join(meta, "file", "left").withColumns({"created": F.coalesce("created", "modified"), "updated": F.coalesce("updated", "modified"), "tool": F.lit(fmt.tool), "parser_version": F.lit(fmt.parser_version)})
    out = out.withColumn("title", C.inferred_title(F.col("native_title"), F.col("outline"), F.col("tool"), F.col("created"), F.col("session_id")))
    child = F.col("session_id").rlike(":agent-[^:]+$")
    out = out.withColumns({"origin": F.when(child, "subagent").otherwise("unknown"), "relation": F.when(child, "subagent").otherwise("none"), "parent_session_id": F.when(child, F.regexp_replace("session_id", ":agent-[^:]+$", ""))})
    newest = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("updated"), F.desc("file")))
    return out.withColumn("n", newest).filter("n = 1").drop("n").withColumnsRenamed({"session_id": "id", "file": "source_path"})


def skipped(spark: SparkSession, path: str, fmt: Format) -> DataFrame:
    """(file, malformed, unknown): lines that are no JSON, and records of kinds that the format does not read."""
    own = lines(spark, path, fmt.glob).withColumn("json", F.try_parse_json("value"))
    kind = F.get_json_object("value", fmt.kind)
    return own.groupBy("file").agg(F.count_if(F.col("json").isNull()).alias("malformed"), F.count_if(F.col("json").isNotNull() & ~F.coalesce(kind.isin(*fmt.roles), F.lit(False))).alias("unknown"))


def active_branch(own: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """Messages on the way from the last message of a file to its root by parent ids; of equal native ids the last counts.

    By doubling: in each round every record knows those up to twice as far above it, and what the tip reaches by then is on
    the branch, for all files at once. A chain of n records takes as many rounds as n has bits; a ring of parents ends when
    nothing new is reached. tips (file, native_id): where branches end, in place of each file's last message. Rounds are cut
    by checkpoints where the session has a folder for them.
    """
    last = own.withColumn("n", F.row_number().over(Window.partitionBy("file", "native_id").orderBy(F.desc("seq")))).filter("n = 1").drop("n")
    spark, reliable = own.sparkSession, bool(own.sparkSession.sparkContext.getCheckpointDir())
    cut = lambda df: df.checkpoint() if reliable else df.persist()
    known = last.select("file", "native_id", "parent_id")
    ends = known.join(last.groupBy("file").agg(F.max_by("native_id", "seq").alias("native_id")) if tips is None else tips, ["file", "native_id"], "left_semi")
    # links lead 2 ** k steps up; the parents of records that aren't there lead nowhere
    links = cut(known.join(known.select("file", F.col("native_id").alias("parent_id")), ["file", "parent_id"], "left_semi").select("file", "native_id", F.col("parent_id").alias("up")))
    on, size = cut(ends.select("file", "native_id")), -1
    while (n := on.count()) > size:
        size = n
        above = on.join(links, ["file", "native_id"]).select("file", F.col("up").alias("native_id"))
        on = cut(on.union(above).distinct())
        links = cut(links.join(links.select("file", F.col("native_id").alias("up"), F.col("up").alias("further")), ["file", "up"]).select("file", "native_id", F.col("further").alias("up")))
    return last.join(on, ["file", "native_id"], "left_semi")


def context_edits(spark: SparkSession, path: str, fmt: Format) -> DataFrame:
    """(file, native_id, replacement) of records that edit another record of their file; a null replacement takes it out of the context. The last edit counts."""
    rows = lines(spark, path, fmt.glob).filter(F.get_json_object("value", "$.type") == "context_edit")
    rows = rows.select("file", "line", F.coalesce(F.get_json_object("value", "$.targetId"), F.get_json_object("value", "$.target")).alias("native_id"), F.get_json_object("value", "$.replacement").alias("replacement"))
    return rows.groupBy("file", "native_id").agg(F.max_by("replacement", "line").alias("replacement"))


def edited(own: DataFrame, edits: DataFrame) -> DataFrame:
    """Messages with their edits: content replaced, or kept and active = false where the replacement is null."""
    out = own.join(edits.withColumn("_edited", F.lit(True)), ["file", "native_id"], "left")
    out = out.withColumn("active", F.col("_edited").isNull() | F.col("replacement").isNotNull())
    return out.withColumn("content", F.coalesce("replacement", "content")).drop("_edited", "replacement")
