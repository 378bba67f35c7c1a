"""Sources that are not JSON lines: JSON trees, SQLite stores, Markdown logs, MessagePack, replay logs, memory files."""

from __future__ import annotations

import json
import os
import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions.columns import tool_target
from heddle.sources import blocks
from heddle.sources.blocks import flattened
from heddle.sources.jsonl import files, first_of, lines

#: What the store readers give for each message.
MESSAGE = "file string, session_id string, seq int, role string, content string, timestamp string"
#: Bytes of SQLite files whose rows go on together.
TOGETHER = 4 << 20


def binary(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select(F.col("path").alias("file"), "content")


def listed(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, mtime in nanoseconds) of files below path; none is read."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return own.select("path", (F.unix_micros("modificationTime") * 1000).alias("mtime"))


# The queries that each SQLite store answers for messages, and for sessions (id, title, project, parent).
STORES = {
    "goose": ("sessions.db", "SELECT session_id, role, content_json AS content, created_timestamp AS timestamp FROM messages ORDER BY session_id, timestamp, rowid"),
    "hermes": ("state.db", "SELECT session_id, role, content, timestamp FROM messages ORDER BY session_id, timestamp, rowid"),
    "crush": ("crush.db", "SELECT session_id, role, parts AS content, created_at AS timestamp FROM messages ORDER BY session_id, created_at, rowid"),
    "opencode": ("opencode.db", "SELECT m.session_id, json_extract(m.data, '$.role') AS role, (SELECT json_group_array(json(p.data)) FROM (SELECT data FROM part WHERE message_id = m.id ORDER BY id) p) AS content, m.time_created AS timestamp FROM message m ORDER BY m.session_id, m.time_created, m.id"),
    "opencode-v2": ("opencode.db", "SELECT session_id, type AS role, coalesce(json_extract(data, '$.text'), json_extract(data, '$.content')) AS content, time_created AS timestamp FROM session_message WHERE type IN ('user', 'assistant') ORDER BY session_id, time_created, id"),
    "zed": ("threads.db", "SELECT id AS session_id, 'thread' AS role, data AS content, updated_at AS timestamp FROM threads ORDER BY id"),
    "cursor": ("state.vscdb", "SELECT key AS session_id, 'bubble' AS role, value AS content, NULL AS timestamp FROM cursorDiskKV WHERE key LIKE 'bubbleId:%' OR key LIKE 'composerData:%' ORDER BY key"),
}
SESSIONS = {
    "goose": "SELECT id, description, working_dir, NULL FROM sessions", "hermes": "SELECT id, title, cwd, parent_session_id FROM sessions", "crush": "SELECT id, title, NULL, parent_session_id FROM sessions",
    "opencode": "SELECT id, title, directory, NULL FROM session", "zed": "SELECT id, summary, folder_paths, NULL FROM threads",
}


def decoded(value) -> str | None:
    """A stored value as text: bytes as UTF-8 (zstd unpacked), hex of UTF-8 as that text."""
    if isinstance(value, bytes):
        if value[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            value = zstandard.ZstdDecompressor().decompressobj().decompress(value)
        return value.decode("utf-8", "replace")
    if isinstance(value, str) and len(value) > 8 and len(value) % 2 == 0 and all(c in "0123456789abcdef" for c in value[:64]):
        try:
            return bytes.fromhex(value).decode()
        except ValueError:
            return value
    return None if value is None else str(value)


def answered(stores: DataFrame, sql: str, names: list[str]) -> DataFrame:
    """file, place, the named columns as text, and problem: the rows of a query over each SQLite file of stores (file, content).

    The files are read as binaries and opened from memory, so they can lie in any store that Spark reads. A file that
    can't answer the query gives one row with the problem and nulls.
    """
    columns = ["file", "place", *names, "problem"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0  # rows of small files go on together
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                con, problem = sqlite3.connect(":memory:"), None
                try:
                    con.deserialize(bytes(content))
                    rows = con.execute(sql).fetchall()
                except sqlite3.Error as e:
                    rows, problem = [(None,) * len(names)], str(e)
                con.close()
                held += [(file, place, *map(decoded, row), problem) for place, row in enumerate(rows)]
                size += len(content)
                if size >= TOGETHER:
                    yield pd.DataFrame(held, columns=columns)
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns)

    schema = ", ".join(f"{n} string" for n in names)
    return stores.mapInPandas(work, f"file string, place int, {schema}, problem string")


def queried(spark: SparkSession, path: str, glob: str, sql: str, names: list[str]) -> DataFrame:
    """The rows of a query over each SQLite file below path, as answered gives them."""
    return answered(binary(spark, path, glob), sql, names)


def stored_messages(stores: DataFrame, sql: str) -> DataFrame:
    """Messages that a query gives over each SQLite file of stores (file, content), numbered by session in the query's order; files with problems give none (see problems)."""
    own = answered(stores, sql, ["session_id", "role", "content", "timestamp"]).filter(F.col("problem").isNull())
    seq = F.row_number().over(Window.partitionBy("file", "session_id").orderBy("place")) - 1
    return own.select("file", "session_id", seq.alias("seq"), "role", "content", "timestamp")


def problems(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """(file, problem) of a tool's stores that can't be read."""
    glob, sql = STORES[tool]
    return queried(spark, path, glob, sql, ["session_id", "role", "content", "timestamp"]).filter(F.col("problem").isNotNull()).select("file", "problem")


def store(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """A tool's messages as its store has them; where contents are lists of blocks, read has them as text."""
    glob, sql = STORES[tool]
    return stored_messages(binary(spark, path, glob), sql)


def store_sessions(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """(file, id, title, project, parent_session_id, relation) of a tool's stores; a parent makes a session a child."""
    own = queried(spark, path, STORES[tool][0], SESSIONS[tool], ["id", "title", "project", "parent_session_id"]).filter(F.col("problem").isNull())
    project = F.element_at(F.split("project", "\n"), 1)
    return own.select("file", "id", "title", project.alias("project"), "parent_session_id", F.when(F.coalesce("parent_session_id", F.lit("")) != "", "child").otherwise("none").alias("relation"))


def goose(spark: SparkSession, path: str) -> DataFrame:
    return flattened(store(spark, path, "goose").withColumnRenamed("content", "raw"), "raw", blocks.GOOSE)


def crush(spark: SparkSession, path: str) -> DataFrame:
    """Messages of the stores that the registry (projects.json below path) lists, with the project; its data folders are absolute or below the project."""
    listed = files(spark, path, "projects.json").select(F.explode(blocks.items(F.get_json_object("value", "$.projects"))).alias("p"))
    project, folder = F.get_json_object("p", "$.path"), F.get_json_object("p", "$.data_dir")
    where = F.concat(F.when(folder.startswith("/"), folder).otherwise(F.concat_ws("/", project, folder)), F.lit("/crush.db"))
    listed = listed.select(project.alias("project"), where.alias("where")).dropDuplicates(["where"])
    own = store(spark, path, "crush").withColumnRenamed("content", "raw").withColumn("where", F.regexp_replace("file", r"^[a-z]+:/+", "/"))
    return flattened(own.join(listed, "where").drop("where"), "raw", blocks.CRUSH)


def opencode(spark: SparkSession, path: str) -> DataFrame:
    """Messages of the JSON tree (message/<session>/msg_*.json with part/<message>/prt_*.json) and of the database; the database wins where a session is in both.

    The tree has a file for each message and each part, so it is listed once and read once, many files in a task.
    """
    glob, sql = STORES["opencode"]
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{{msg_*.json,prt_*.json,{glob}}}").load(path)
    name, few = F.col("_metadata.file_name"), 4 * spark.sparkContext.defaultParallelism
    # filters on a file's name are applied to the listing: neither side reads the other's files
    stores = own.filter(name == glob).select(F.col("path").alias("file"), "content").coalesce(few)
    rows = own.filter(name != glob).select(F.col("_metadata.file_path").alias("file"), name.alias("name"), F.col("content").cast("string").alias("value")).coalesce(few)
    is_head, folder = F.col("name").startswith("msg_"), F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    head = F.struct("file", F.coalesce(F.get_json_object("value", "$.sessionID"), folder).alias("session_id"), *(F.get_json_object("value", p).alias(n) for n, p in (("role", "$.role"), ("timestamp", "$.time.created"))))
    rows = rows.withColumns({"message": F.when(is_head, F.get_json_object("value", "$.id")).otherwise(folder), "head": F.when(is_head, head), "part": F.when(~is_head, F.struct("name", "value"))})
    rows = rows.filter("message is not null").groupBy("message").agg(F.collect_list("head").alias("heads"), F.sort_array(F.collect_list("part")).alias("parts")).filter(F.size("parts") > 0)
    raw = F.concat(F.lit("["), F.array_join(F.transform("parts", lambda x: x["value"]), ","), F.lit("]"))
    tree = rows.select("message", raw.alias("raw"), F.inline("heads")).select("file", "session_id", F.lit(None).cast("int").alias("seq"), "role", "raw", "timestamp", "message", F.lit(False).alias("held"))
    held = stored_messages(stores, sql).withColumnRenamed("content", "raw").select("*", F.lit(None).cast("string").alias("message"), F.lit(True).alias("held"))
    session = Window.partitionBy("session_id")
    both = tree.unionByName(held).withColumn("stored", F.max("held").over(session)).filter("held = stored")
    seq = F.coalesce("seq", F.row_number().over(session.orderBy(F.col("timestamp").cast("double"), "message")) - 1)
    return flattened(both.select("file", "session_id", seq.alias("seq"), "role", "raw", "timestamp"), "raw", blocks.OPENCODE)


def zed(spark: SparkSession, path: str) -> DataFrame:
    """Messages of threads: each is one JSON document (packed or not) with the messages of both sides, and the results of an agent's calls."""
    own = store(spark, path, "zed").select("file", "session_id", "timestamp", F.posexplode(blocks.items(F.get_json_object("content", "$.messages"))).alias("seq", "m"))
    user, agent = F.get_json_object("m", "$.User.content"), F.get_json_object("m", "$.Agent.content")
    own = own.filter(user.isNotNull() | agent.isNotNull()).withColumns({"role": F.when(user.isNotNull(), "user").otherwise("assistant"), "raw": F.coalesce(user, agent)})
    got = F.from_json(F.get_json_object("m", "$.Agent.tool_results"), "map<string,string>")
    got = F.transform(F.array_sort(F.map_keys(got)), lambda k: F.struct(k.alias("id"), F.coalesce(F.get_json_object(got[k], "$.content.Text"), F.get_json_object(got[k], "$.content")).alias("output"), (F.coalesce(F.get_json_object(got[k], "$.is_error"), F.lit("false")) == "true").alias("is_error")))
    own = flattened(own.withColumn("got", got).drop("m"), "raw", blocks.ZED)
    return own.withColumn("results", F.coalesce("got", "results")).drop("got")


def cursor(spark: SparkSession, path: str) -> DataFrame:
    """Messages of composers, in the order of their headers; a header of type 1 is the user's."""
    own = queried(spark, path, *STORES["cursor"], ["session_id", "role", "content", "timestamp"]).filter(F.col("problem").isNull()).select("file", F.split("session_id", ":").alias("key"), "content")
    heads = own.filter(F.col("key")[0] == "composerData").select("file", F.col("key")[1].alias("session_id"), F.posexplode(blocks.items(F.get_json_object("content", "$.fullConversationHeadersOnly"))).alias("seq", "h"))
    heads = heads.select("file", "session_id", "seq", F.get_json_object("h", "$.bubbleId").alias("bubble"), F.when(F.get_json_object("h", "$.type") == "1", "user").otherwise("assistant").alias("role"))
    said = own.filter(F.col("key")[0] == "bubbleId").select("file", F.col("key")[1].alias("session_id"), F.col("key")[2].alias("bubble"), "content")
    thought = F.coalesce(F.get_json_object("content", "$.thinking.text"), F.get_json_object("content", "$.thinking"))
    tool = F.get_json_object("content", "$.toolFormerData.name")
    text = F.concat_ws("\n", F.nullif(F.get_json_object("content", "$.text"), F.lit("")), F.when(tool.isNotNull(), F.concat(F.lit("[Tool: "), tool, F.lit("] "), tool_target(F.get_json_object("content", "$.toolFormerData.params")))))
    out = heads.join(said, ["file", "session_id", "bubble"]).select("file", "session_id", "seq", "role", text.alias("content"), F.get_json_object("content", "$.createdAt").alias("timestamp"), thought.alias("reasoning"))
    return out.filter((F.col("content") != "") | F.col("reasoning").isNotNull())


def kimi(spark: SparkSession, path: str) -> DataFrame:
    """Messages below sessions/<md5 of the project>/<session>, with the project that the registry (kimi.json) has of that digest."""
    listed = files(spark, path, "kimi.json").select(F.explode(blocks.items(F.get_json_object("value", "$.work_dirs"))).alias("p")).select(F.get_json_object("p", "$.path").alias("project")).distinct()
    listed = listed.withColumn("digest", F.md5(F.col("project")))
    rows = lines(spark, path, "context.jsonl").withColumns({"digest": F.regexp_extract("file", r"([^/]+)/[^/]+/[^/]+$", 1), "session_id": F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)})
    rows = rows.withColumns({"role": F.get_json_object("value", "$.role"), "raw": F.get_json_object("value", "$.content"), "called": blocks.items(F.get_json_object("value", "$.tool_calls")), "answers": F.get_json_object("value", "$.tool_call_id")})
    rows = rows.filter(F.col("role").isin("user", "assistant", "tool")).join(listed, "digest", "left")
    out = flattened(rows.select("file", "session_id", F.col("line").alias("seq"), "role", "project", "raw", "called", "answers"), "raw", blocks.KIMI)
    calls = F.transform("called", lambda c: F.struct(F.get_json_object(c, "$.id").alias("id"), F.get_json_object(c, "$.function.name").alias("tool"), F.get_json_object(c, "$.function.arguments").alias("input")))
    bad = F.col("content").startswith("ERROR") | F.col("content").startswith("<system>ERROR")
    results = F.array(F.struct(F.col("answers").alias("id"), F.col("content").alias("output"), bad.alias("is_error")))
    return out.withColumns({"calls": F.coalesce(calls, "calls"), "results": F.when(F.col("answers").isNotNull(), results).otherwise(F.col("results"))}).drop("called", "answers")


def json_tree(spark: SparkSession, path: str, glob: str, items: str, role: tuple[str, ...], text: tuple[str, ...], time: tuple[str, ...], roles: dict[str, str]) -> DataFrame:
    """Messages of JSON documents that hold a list of records; items is the list's path."""
    own = files(spark, path, glob).select("file", F.posexplode(F.from_json(F.coalesce(F.get_json_object("value", items), F.lit("[]")), "array<string>")).alias("seq", "item"))
    kind = first_of(F.col("item"), role)
    mapped = F.coalesce(*(F.when(kind == k, v) for k, v in roles.items()), kind)
    stem = F.regexp_extract("file", r"([^/]+?)(\.json)?$", 1)
    return own.select("file", stem.alias("session_id"), "seq", mapped.alias("role"), first_of(F.col("item"), text).alias("content"), first_of(F.col("item"), time).alias("timestamp")).filter("content is not null")


def cline(spark: SparkSession, path: str) -> DataFrame:
    """Messages of tasks (one folder each), all blocks of them."""
    own = files(spark, path, "api_conversation_history.json").select("file", F.posexplode(blocks.items(F.col("value"))).alias("seq", "m"))
    own = own.select("file", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("session_id"), "seq", F.get_json_object("m", "$.role").alias("role"), F.get_json_object("m", "$.content").alias("raw"), F.get_json_object("m", "$.ts").alias("timestamp"))
    return flattened(own.filter(F.col("raw").isNotNull()), "raw", blocks.ANTHROPIC)


def codex_titles(spark: SparkSession, path: str) -> DataFrame:
    """(key, title) of the thread tables below path: by thread id and by the rollout's file name; a blank title gives way to the first message."""
    rows = queried(spark, path, "state_5.sqlite", "SELECT id, rollout_path, substr(title, 1, 200), substr(first_user_message, 1, 200) FROM threads", ["id", "rollout", "title", "first"])
    text = F.coalesce(*(F.when(F.col(c).rlike(r"\S"), F.trim(c)) for c in ("title", "first")))
    keys = F.array("id", F.regexp_extract("rollout", r"([^/]+)$", 1))
    return rows.filter("problem is null").select(F.explode(keys).alias("key"), text.alias("title")).filter("key <> '' and title is not null")


def vscode_log(spark: SparkSession, path: str) -> DataFrame:
    """Chat logs of one record a line: a header (kind 0), and lists (kind 2) of requests and of pieces of answers, which belong to the request before them.

    Pieces without a kind are text; what a record of kind 1 says of the editor's state isn't part of the chat.
    """
    rows = lines(spark, path, "*.jsonl").withColumn("kind", F.get_json_object("value", "$.kind"))
    named = F.coalesce(F.first(F.when(F.col("kind") == "0", F.get_json_object("value", "$.v.sessionId")), True).over(Window.partitionBy("file")), F.regexp_extract("file", r"([^/]+?)(\.jsonl)?$", 1))
    own = rows.withColumn("session_id", named).filter("kind = '2'")
    own = own.select("file", "session_id", "line", F.posexplode(blocks.items(F.get_json_object("value", "$.v"))).alias("n", "p"))
    part = lambda name: F.get_json_object("p", f"$.{name}")
    asks = part("requestId").isNotNull() & part("message").isNotNull()
    w = Window.partitionBy("file").orderBy("line", "n")
    own = own.withColumn("asks", asks).withColumn("g", F.sum(F.col("asks").cast("int")).over(w)).withColumn("timestamp", F.last(F.when(F.col("asks"), part("timestamp")), True).over(w))
    asked = own.filter("asks").select("file", "session_id", (F.col("g") * 2).alias("seq"), F.lit("user").alias("role"), F.trim(part("message.text")).alias("content"), "timestamp")
    text = F.when(~F.col("asks") & part("kind").isNull(), part("value"))
    told = own.withColumn("text", text).filter("text <> ''").groupBy("file", "session_id", "g").agg(F.sort_array(F.collect_list(F.struct("line", "n", "text"))).alias("parts"), F.first("timestamp").alias("timestamp"))
    joined = F.regexp_replace(F.array_join(F.transform("parts", lambda x: x["text"]), "\n"), r"^\s+|\s+$", "")
    told = told.select("file", "session_id", (F.col("g") * 2 + 1).alias("seq"), F.lit("assistant").alias("role"), joined.alias("content"), "timestamp")
    return asked.unionByName(told).filter("content <> ''")


# Where tools keep their transcripts below a home folder, and under which names.
HOMES = {
    "claude-code": (".claude/projects", "*.jsonl"), "codex": (".codex/sessions", "*.jsonl*"), "gemini-cli": (".gemini/tmp", "session-*.json*"), "copilot-cli": (".copilot/session-state", "*.jsonl"), "qwen": (".qwen/projects", "*.jsonl"),
    "factory-droid": (".factory/sessions", "*.jsonl"), "command-code": (".commandcode/projects", "[!.]*.jsonl"), "pi": (".pi/agent/sessions", "*.jsonl"), "cursor-agent": (".cursor/projects", "*.jsonl"), "vscode-copilot": (".config/Code/User/workspaceStorage", "*.json*"), "antigravity": (".gemini/antigravity/brain", "transcript*.jsonl"),
    "goose": (".local/share/goose/sessions", "sessions.db"), "hermes": (".hermes", "state.db"), "opencode": (".local/share/opencode", "opencode.db"), "zed": (".local/share/zed/threads", "threads.db"), "cursor": (".config/Cursor/User/globalStorage", "state.vscdb"),
}


def discovered(spark: SparkSession, homes: list[str], tools: list[str] | None = None) -> DataFrame:
    """(tool, path, mtime) of the transcripts below home folders, of all tools or of these; a tool whose folder isn't there has none, and nothing is read."""
    out = spark.createDataFrame([], "tool string, path string, mtime bigint")
    for home in homes:
        for tool, (folder, glob) in HOMES.items():
            root = spark._jvm.org.apache.hadoop.fs.Path(f"{home.rstrip('/')}/{folder}")
            if (tools is None or tool in tools) and root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
                out = out.unionByName(listed(spark, f"{home.rstrip('/')}/{folder}", glob).select(F.lit(tool).alias("tool"), "path", "mtime"))
    return out


def vscode(spark: SparkSession, path: str) -> DataFrame:
    """Each request is a prompt and its answer, of which all parts count."""
    own = files(spark, path, "*.json").select("file", F.regexp_extract("file", r"([^/]+?)(\.json)?$", 1).alias("session_id"), F.posexplode(blocks.items(F.get_json_object("value", "$.requests"))).alias("n", "r"))
    time = F.get_json_object("r", "$.timestamp")
    asked = own.select("file", "session_id", (F.col("n") * 2).alias("seq"), F.lit("user").alias("role"), F.get_json_object("r", "$.message.text").alias("raw"), time.alias("timestamp"))
    told = own.select("file", "session_id", (F.col("n") * 2 + 1).alias("seq"), F.lit("assistant").alias("role"), F.get_json_object("r", "$.response").alias("raw"), time.alias("timestamp"))
    return flattened(asked.unionByName(told).filter(F.col("raw").isNotNull()), "raw", blocks.RESPONSE)


def aider(spark: SparkSession, path: str) -> DataFrame:
    """Markdown chat logs: a header starts a session, lines after '#### ' are prompts, others answers; runs of one role are one message.

    Spark's readers pass over names that begin with a dot, so the logs are expected under names without it.
    """
    rows = files(spark, path, "*.chat.history.md").select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    head = F.col("text").startswith("# aider chat started at ")
    w = Window.partitionBy("file").orderBy("line")
    rows = rows.withColumns({"n": F.sum(head.cast("int")).over(w), "start": F.when(head, F.regexp_extract("text", r"started at (.*)$", 1))}).withColumn("start", F.last("start", True).over(w)).filter("n > 0")
    role = F.when(F.col("text").startswith("####"), "user").when(~F.col("text").rlike(r"\S"), None).when(F.col("text").startswith(">"), "tool").otherwise("assistant")
    rows = rows.filter(~head).withColumn("role", role)
    own = Window.partitionBy("file", "n").orderBy("line")
    rows = rows.withColumn("role", F.last("role", True).over(own)).filter("role is not null")
    rows = rows.withColumn("seq", F.sum((~F.col("role").eqNullSafe(F.lag("role").over(own))).cast("int")).over(own))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", F.regexp_replace("text", r"^(####|>) ?", "").alias("t")))), lambda x: x["t"]), "\n")
    out = rows.groupBy("file", "n", "start", "role", "seq").agg(F.regexp_replace(text, r"^\s+|\s+$", "").alias("content"))
    id_ = F.concat(F.lit("aider-"), F.substring(F.sha1(F.concat_ws("|", F.regexp_replace("file", r"/[^/]+$", ""), "start")), 1, 16))
    return out.filter("content <> ''").select("file", id_.alias("session_id"), (F.col("seq") - 1).cast("int").alias("seq"), "role", "content", F.col("start").alias("timestamp"))


def unpack(data: bytes) -> list:
    """The objects of a MessagePack stream."""
    at = 0

    def take(fmt: str):
        nonlocal at
        size = struct.calcsize(">" + fmt)
        (value,) = struct.unpack_from(">" + fmt, data, at)
        at += size
        return value

    def raw(n: int) -> bytes:
        nonlocal at
        at += n
        return data[at - n : at]

    sized = {0xC4: "B", 0xC5: "H", 0xC6: "I", 0xD9: "B", 0xDA: "H", 0xDB: "I", 0xDC: "H", 0xDD: "I", 0xDE: "H", 0xDF: "I", 0xC7: "B", 0xC8: "H", 0xC9: "I"}
    numbers = {0xCA: "f", 0xCB: "d", 0xCC: "B", 0xCD: "H", 0xCE: "I", 0xCF: "Q", 0xD0: "b", 0xD1: "h", 0xD2: "i", 0xD3: "q"}

    def one():
        b = take("B")
        if b < 0x80 or b >= 0xE0:
            return b if b < 0x80 else b - 256
        if b < 0xC0:
            kind, n = ("map" if b < 0x90 else "list" if b < 0xA0 else "text"), b & (0x1F if b >= 0xA0 else 0x0F)
        elif b in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[b]
        elif b in numbers:
            return take(numbers[b])
        elif 0xD4 <= b <= 0xD8:
            kind, n = "ext", 1 << (b - 0xD4)
        else:
            n = take(sized[b])
            kind = "bytes" if b <= 0xC6 else "ext" if b <= 0xC9 else "text" if b <= 0xDB else "list" if b <= 0xDD else "map"
        if kind == "ext":
            take("b")
            return raw(n)
        if kind == "map":
            return {str(one()): one() for _ in range(n)}
        return [one() for _ in range(n)] if kind == "list" else raw(n).decode("utf-8", "replace") if kind == "text" else raw(n)

    out = []
    while at < len(data):
        out.append(one())
    return out


def messagepack(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, n, record): the records of MessagePack files as JSON text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                records = [json.dumps(r, ensure_ascii=False, default=lambda b: b.hex()) for r in unpack(bytes(content))]
                yield pd.DataFrame({"file": file, "n": range(len(records)), "record": records})

    return binary(spark, path, glob).mapInPandas(work, "file string, n int, record string")


def replayed(events: DataFrame) -> DataFrame:
    """Events (file, line, value) of an editable log, folded in order: set, update, remove and reorder messages; a rewind cuts the end.

    A fold over one file's events, which later ones can undo, so no window expresses it.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        order: list[str] = []
        held: dict[str, dict] = {}
        for value in group.sort_values("line")["value"]:
            try:
                e = json.loads(value)
            except ValueError:
                continue
            if not isinstance(e, dict):
                continue
            if e.get("removeIds"):
                gone = set(map(str, e["removeIds"]))
                order = [i for i in order if i not in gone]
            elif e.get("orderIds"):
                known = [str(i) for i in e["orderIds"] if str(i) in held]
                order = known + [i for i in order if i not in set(known)]
            elif e.get("rewindTo") is not None:
                at = str(e["rewindTo"])
                order = order[: order.index(at) + 1] if at in order else order
            elif e.get("updates") and str(e.get("id")) in held:
                held[str(e["id"])] |= e["updates"]
            elif e.get("id") is not None and ("content" in e or "text" in e):
                i = str(e["id"])
                order += [] if i in order else [i]
                held[i] = e
        rows = [(held[i].get("type"), held[i].get("content") or held[i].get("text"), held[i].get("timestamp")) for i in order]
        out = pd.DataFrame(rows, columns=["role", "content", "timestamp"])
        out["role"] = out["role"].replace({"gemini": "assistant"})
        out.insert(0, "file", group["file"].iloc[0])
        out.insert(1, "session_id", os.path.splitext(os.path.basename(group["file"].iloc[0]))[0])
        out.insert(2, "seq", range(len(out)))
        return out

    return events.select("file", "line", "value").groupBy("file").applyInPandas(fold, MESSAGE)


def memory_files(spark: SparkSession, path: str) -> DataFrame:
    """Markdown notes with front matter as memory entries: title, kind, body."""
    own = files(spark, path, "*.md")
    front = F.regexp_extract("value", r"(?s)\A---\s*\n(.*?)\n---\s*\n", 1)
    field_ = lambda name: F.nullif(F.trim(F.regexp_extract(front, rf"(?m)^{name}:\s*[\"']?(.*?)[\"']?\s*$", 1)), F.lit(""))
    body = F.regexp_replace(F.regexp_replace("value", r"(?s)\A---\s*\n.*?\n---\s*\n", ""), r"\A\s+|\s+\z", "")
    stem = F.regexp_extract("file", r"([^/]+?)(\.md)?$", 1)
    return own.select("file", F.coalesce(field_("name"), field_("title"), stem).alias("title"), F.coalesce(field_("kind"), F.lit("note")).alias("kind"), body.alias("body"))
