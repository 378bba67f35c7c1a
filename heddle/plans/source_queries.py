"""Named queries of the sources: the conversations table is written in each tool's own form and read back.

The files are made in tasks, one conversation at a time, below a folder that driver and tasks share; they are fixtures, so
they are plain files. Every conversation of the table is written.
"""

from __future__ import annotations

import json
import os
import sqlite3
import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.plans.fixtures import Fixtures, shared_path
from heddle.plans.queries import query
from heddle.sources import files as S
from heddle.sources import jsonl as J

#: The conversations without other roles, under the names that fixtures give them.
_OWN = "SELECT 'c' || conv_id AS session_id, conv_id, CAST(turn AS INTEGER) AS seq, role, text AS content FROM conversations WHERE role IN ('user', 'assistant')"


def shared_folder(fx: Fixtures) -> str:
    """A new folder that driver and tasks see, made by the file system of this machine: sources are written as their tools write them."""
    folder = shared_path(fx.spark).removeprefix("file://").removeprefix("file:")
    if "://" in folder:
        raise ValueError("the tools' files are written by this machine, which needs a shared folder with a local path")
    os.makedirs(folder)
    return folder


def written(fx: Fixtures, put: Callable[[str, int, list[tuple[int, str, str]]], None]) -> str:
    """A folder in which put(folder, conv_id, messages of turn, role and text) has written each conversation."""
    folder = shared_folder(fx)

    def each(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("turn")
        put(folder, int(rows["conv_id"].iloc[0]), list(zip(rows["turn"].astype(int), rows["role"], rows["text"], strict=True)))
        return pd.DataFrame({"n": [len(rows)]})

    fx.table("conversations").groupBy("conv_id").applyInPandas(each, "n int").agg(F.sum("n")).collect()
    return folder


def save(path: str, data) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def save_lines(path: str, records: list) -> None:
    save(path, "\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records))


def save_db(path: str, script: str, **tables: list[tuple]) -> None:
    """A new store, written in one transaction; nothing waits for the disk, since what a crash leaves is read by nobody."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    con = sqlite3.connect(path, isolation_level=None)
    con.executescript(f"PRAGMA synchronous = OFF; PRAGMA journal_mode = OFF; BEGIN; {script}")
    for name, rows in tables.items():
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    con.execute("COMMIT")
    con.close()


def shown(df: DataFrame, *more: str) -> DataFrame:
    return df.filter(F.col("role").isin("user", "assistant")).select("session_id", F.col("seq").cast("int").alias("seq"), "role", "content", *more)


# --- JSON lines


def _text(text: str) -> list[dict]:
    return [{"type": "text", "text": text}]


def _time(turn: int) -> str:
    return f"2026-01-01T10:{turn:02d}:00Z"


RECORDS = {
    "S05_cursor_agent": ("cursor-agent", lambda c, n, r, t: {"role": r, "message": {"content": _text(t)}}),
    "S08_copilot_cli": ("copilot-cli", lambda c, n, r, t: {"type": f"{r}.message", "timestamp": _time(n), "data": {"sessionId": c, "content": t}}),
    "S13_pi": ("pi", lambda c, n, r, t: {"type": "message", "id": f"m{n}", "parentId": f"m{n - 1}", "timestamp": _time(n), "message": {"role": r, "content": _text(t)}}),
    "S14_command_code": ("command-code", lambda c, n, r, t: {"sessionId": c, "timestamp": _time(n), "message": {"role": r, "content": t}}),
    "S20_qwen": ("qwen", lambda c, n, r, t: {"type": r, "sessionId": c, "timestamp": _time(n), "message": {"parts": [{"text": t}]}}),
    "S22_factory_droid": ("factory-droid", lambda c, n, r, t: {"type": "message", "session_id": c, "timestamp": _time(n), "message": {"role": r, "content": _text(t)}}),
}

for _name, (_tool, _record) in RECORDS.items():

    @query(_name, f"SELECT session_id, seq, role, content FROM ({_OWN})")
    def _(fx, tool=_tool, record=_record):
        put = lambda folder, c, rows: save_lines(f"{folder}/c{c}.jsonl", [record(f"c{c}", *row) for row in rows])
        return shown(J.messages(fx.spark, written(fx, put), J.FORMATS[tool]))


@query("S01_claude_code", f"""SELECT CASE WHEN conv_id % 5 = 4 THEN 'p' || conv_id || ':agent-' || conv_id ELSE session_id END AS session_id, seq, role, CASE WHEN role = 'assistant' THEN content || chr(10) || '[Tool: Read] /f' || seq ELSE content END AS content,
  CASE WHEN role = 'assistant' THEN 'hm' END AS reasoning FROM ({_OWN})""")  # fmt: skip
def _(fx):
    def put(folder, c, rows):
        name = f"p{c}" if c % 5 == 4 else f"c{c}"
        path = f"{folder}/project/p{c}/subagents/agent-{c}.jsonl" if c % 5 == 4 else f"{folder}/project/c{c}.jsonl"
        said = lambda n, r, t: t if r == "user" else [{"type": "thinking", "thinking": "hm"}, *_text(t), {"type": "tool_use", "id": f"t{n}", "name": "Read", "input": {"file_path": f"/f{n}"}}]
        save_lines(path, [{"type": r, "sessionId": name, "timestamp": _time(n), "message": {"role": r, "content": said(n, r, t)}} for n, r, t in rows])

    return shown(J.messages(fx.spark, written(fx, put), J.FORMATS["claude-code"]), "reasoning")


@query("S01_S29_subagent_sessions", f"""SELECT CASE WHEN conv_id % 5 = 4 THEN 'p' || conv_id || ':agent-' || conv_id ELSE 'c' || conv_id END AS id, CASE WHEN conv_id % 5 = 4 THEN 'p' || conv_id END AS parent_session_id, CASE WHEN conv_id % 5 = 4 THEN 'subagent' ELSE 'none' END AS relation,
  CAST(count(*) AS INTEGER) AS messages_count, CAST(count(*) FILTER (role = 'user') AS INTEGER) AS prompt_count FROM ({_OWN}) GROUP BY conv_id""")  # fmt: skip
def _(fx):
    def put(folder, c, rows):
        name, path = (f"p{c}", f"{folder}/project/p{c}/subagents/agent-{c}.jsonl") if c % 5 == 4 else (f"c{c}", f"{folder}/project/c{c}.jsonl")
        save_lines(path, ["{broken", *({"type": r, "sessionId": name, "timestamp": _time(n), "message": {"role": r, "content": t}} for n, r, t in rows)])

    return J.sessions(fx.spark, written(fx, put), J.FORMATS["claude-code"]).select("id", "parent_session_id", "relation", "messages_count", "prompt_count")


@query("S02_codex", f"SELECT session_id, seq + 1 AS seq, role, content FROM ({_OWN})")
def _(fx):
    def put(folder, c, rows):
        kind = {"user": "input_text", "assistant": "output_text"}
        head = {"type": "session_meta", "timestamp": _time(0), "payload": {"id": f"c{c}", "cwd": "/w"}}
        save_lines(f"{folder}/2026/rollout-{c}.jsonl", [head, *({"type": "response_item", "timestamp": _time(n), "payload": {"type": "message", "role": r, "content": [{"type": kind.get(r, "text"), "text": t}]}} for n, r, t in rows)])

    return shown(J.messages(fx.spark, written(fx, put), J.FORMATS["codex"]))


@query("S02_J19_codex_calls", f"""SELECT session_id, seq * 3 + 2 AS seq, 'k' || seq AS id, CASE WHEN seq % 2 = 0 THEN 'shell' ELSE 'apply_patch' END AS tool, CASE WHEN seq % 2 = 0 THEN '{{"command":"' || role || '"}}' ELSE left(content, 30) END AS input, content AS output FROM ({_OWN}) WHERE role = 'assistant'""")
def _(fx):
    def put(folder, c, rows):
        records = [{"type": "session_meta", "timestamp": _time(0), "payload": {"id": f"c{c}", "cwd": "/w"}}]
        for n, r, t in rows:
            item = lambda payload, n=n: {"type": "response_item", "timestamp": _time(n), "payload": payload}
            records += [{"broken": True}] * (n * 3 + 1 - len(records))
            records.append(item({"type": "message", "role": r, "content": [{"type": "text", "text": t}]}))
            if r == "assistant":
                own = {"type": "function_call", "name": "shell", "arguments": json.dumps({"command": r}, separators=(",", ":"))} if n % 2 == 0 else {"type": "custom_tool_call", "name": "apply_patch", "input": t[:30]}
                records.append(item(own | {"call_id": f"k{n}"}))
                records.append(item({"type": "function_call_output" if n % 2 == 0 else "custom_tool_call_output", "call_id": f"k{n}", "output": t}))
        save_lines(f"{folder}/2026/rollout-{c}.jsonl", records)

    own = J.messages(fx.spark, written(fx, put), J.FORMATS["codex"])
    return J.tool_calls(own).select("session_id", "seq", "id", "tool", "input", "output")


@query("S02_codex_titles", f"""+ t AS (SELECT DISTINCT conv_id, session_id FROM ({_OWN})) SELECT session_id AS id, CASE WHEN conv_id % 3 = 0 THEN 'Thread ' || conv_id WHEN conv_id % 3 = 1 THEN 'First ' || conv_id END AS title FROM t WHERE conv_id % 3 < 2""")
def _(fx):
    folder = written(fx, lambda folder, c, rows: save_lines(f"{folder}/sessions/rollout-{c}.jsonl", [{"type": "session_meta", "payload": {"id": f"c{c}"}}, *({"type": "response_item", "timestamp": _time(n), "payload": {"type": "message", "role": r, "content": [{"text": t, "type": "text"}]}} for n, r, t in rows)]))
    ids = [r[0] for r in fx.table("conversations").select("conv_id").distinct().collect()]  # the store of one tool, written as it writes it
    threads = [(f"c{c}" if c % 2 else "other", f"/home/u/.codex/sessions/rollout-{c}.jsonl", f"Thread {c}" if c % 3 == 0 else "  ", f"First {c}") for c in ids if c % 3 < 2]
    save_db(f"{folder}/state_5.sqlite", "CREATE TABLE threads (id TEXT, rollout_path TEXT, title TEXT, first_user_message TEXT)", threads=threads)
    own = J.sessions(fx.spark, f"{folder}/sessions", J.FORMATS["codex"])
    titles = S.codex_titles(fx.spark, folder).filter("key <> 'other'")
    return J.titled(own, titles).select("id", "title").filter(F.substring("id", 2, 20).try_cast("long") % 3 < 2)


@query("S11_antigravity", f"SELECT session_id, seq, role, content FROM ({_OWN})")
def _(fx):
    kinds = {"user": "USER_INPUT", "assistant": "PLANNER_RESPONSE", "system": "CHECKPOINT"}
    put = lambda folder, c, rows: save_lines(f"{folder}/brain/c{c}/transcript.jsonl", [{"type": kinds[r], "content": t, "created_at": _time(n), "step_index": n} for n, r, t in rows])
    return shown(J.messages(fx.spark, written(fx, put), J.FORMATS["antigravity"]))


@query("J19_tool_results", f"SELECT session_id, seq, 't' || seq AS id, 'Bash' AS tool, content AS output, seq % 3 = 1 AS is_error FROM ({_OWN}) WHERE role = 'assistant'")
def _(fx):
    def put(folder, c, rows):
        records = []
        for n, r, t in rows:
            call = {"type": "tool_use", "id": f"t{n}", "name": "Bash", "input": {"command": "ls"}}
            records.append({"type": r, "sessionId": f"c{c}", "message": {"role": r, "content": [call] if r == "assistant" else t}})
        records += [{"type": "user", "sessionId": f"c{c}", "message": {"content": [{"type": "tool_result", "tool_use_id": f"t{n}", "content": t, "is_error": n % 3 == 1}]}} for n, r, t in rows if r == "assistant"]
        save_lines(f"{folder}/c{c}.jsonl", records)

    return J.tool_calls(J.messages(fx.spark, written(fx, put), J.FORMATS["claude-code"])).select("session_id", "seq", "id", "tool", "output", "is_error")


@query("S03_I09_replayed", f"""+ m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS k FROM ({_OWN})) SELECT session_id, CAST(k AS INTEGER) AS seq, role, CASE WHEN role = 'assistant' THEN content || '!' ELSE content END AS content FROM m""")
def _(fx):
    def put(folder, c, rows):
        records = []
        for n, r, t in rows:
            if r != "system":
                records.append({"id": str(n), "type": "gemini" if r == "assistant" else r, "content": t})
                records += [{"id": str(n), "updates": {"content": t + "!"}}] if r == "assistant" else []
                records += [{"id": f"x{n}", "type": "user", "content": "gone"}, {"rewindTo": str(n)}]
        save_lines(f"{folder}/c{c}.jsonl", records)

    return shown(S.replayed(J.lines(fx.spark, written(fx, put), "*.jsonl")))


@query("S19_kimi", f"SELECT session_id, seq, role, content, '/w/p' || (conv_id % 3) AS project, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS n_calls, CASE WHEN role = 'assistant' THEN 'so' END AS reasoning FROM ({_OWN}) WHERE conv_id % 3 < 2 UNION ALL SELECT session_id, seq, role, content, NULL, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END, CASE WHEN role = 'assistant' THEN 'so' END FROM ({_OWN}) WHERE conv_id % 3 = 2")
def _(fx):
    from hashlib import md5

    def put(folder, c, rows):
        own = lambda r, t: t if r == "user" else [{"type": "think", "think": "so"}, *_text(t)]
        calls = [{"id": "k1", "function": {"name": "Read", "arguments": "{}"}}]
        digest = md5(f"/w/p{c % 3}".encode()).hexdigest()
        save_lines(f"{folder}/sessions/{digest}/c{c}/context.jsonl", [{"role": "_system_prompt" if r == "system" else r, "content": own(r, t), **({"tool_calls": calls} if r == "assistant" else {})} for _, r, t in rows])

    folder = written(fx, put)
    save(f"{folder}/kimi.json", json.dumps({"work_dirs": [{"path": "/w/p0"}, {"path": "/w/p1"}]}))
    own = S.kimi(fx.spark, folder)
    return shown(own.withColumn("n_calls", F.size("calls")), "project", "n_calls", "reasoning")


# --- JSON trees and logs


@query("S06_vscode_log", f"""+ m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM ({_OWN})), a AS (SELECT session_id, g, string_agg(content, chr(10) ORDER BY seq) AS content FROM m WHERE role = 'assistant' GROUP BY 1, 2)
  SELECT session_id, CAST(2 * g AS INTEGER) AS seq, role, trim(content) AS content FROM m WHERE role = 'user' UNION ALL SELECT session_id, CAST(2 * g + 1 AS INTEGER), 'assistant', content FROM a""")  # fmt: skip
def _(fx):
    def put(folder, c, rows):
        records = [{"kind": 0, "v": {"sessionId": f"c{c}", "creationDate": 1}}, "{broken"]
        for n, r, t in rows:
            if r == "user":
                records += [{"kind": 2, "v": [{"requestId": f"r{n}", "message": {"text": t}, "timestamp": 1000 * n}]}, {"kind": 1, "v": "state"}]
            elif r == "assistant":
                head, _, tail = t.partition("\n")  # an answer in pieces, over two records
                records += [{"kind": 2, "v": [{"kind": "thinking", "value": "hm"}, {"value": head}]}, {"kind": 2, "v": [{"value": tail}] if tail else []}]
        save_lines(f"{folder}/x/chatSessions/{c}.jsonl", records)

    return shown(S.vscode_log(fx.spark, written(fx, put)))


@query("S06_vscode", f"""+ m AS (SELECT *, row_number() OVER (PARTITION BY session_id, role ORDER BY seq) - 1 AS k FROM ({_OWN})), p AS (SELECT u.session_id, u.k, u.content AS q, a.content AS t FROM m u JOIN m a ON a.session_id = u.session_id AND a.k = u.k AND a.role = 'assistant' WHERE u.role = 'user')
  SELECT session_id, CAST(2 * k AS INTEGER) AS seq, 'user' AS role, q AS content FROM p UNION ALL SELECT session_id, CAST(2 * k + 1 AS INTEGER), 'assistant', t || chr(10) || 'and more' FROM p""")  # fmt: skip
def _(fx):
    def put(folder, c, rows):
        asked, told = ([t for _, r, t in rows if r == role] for role in ("user", "assistant"))
        save(f"{folder}/c{c}.json", json.dumps({"requests": [{"message": {"text": q}, "timestamp": 1, "response": [{"kind": "thinking", "value": "hm"}, {"value": t}, {"value": "and more"}]} for q, t in zip(asked, told, strict=False)]}))

    return shown(S.vscode(fx.spark, written(fx, put)))


@query("S07_messagepack", f"SELECT session_id || '.bin' AS name, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS INTEGER) AS n, role, content FROM ({_OWN})")
def _(fx):
    def packed(x) -> bytes:
        raw = x.encode()
        return b"\xdb" + struct.pack(">I", len(raw)) + raw

    def put(folder, c, rows):
        save(f"{folder}/c{c}.bin", b"".join(b"\x82" + packed("role") + packed(r) + packed("text") + packed(t) for _, r, t in rows if r != "system"))

    own = S.messagepack(fx.spark, written(fx, put), "*.bin")
    return own.select(F.regexp_extract("file", r"([^/]+)$", 1).alias("name"), "n", F.get_json_object("record", "$.role").alias("role"), F.get_json_object("record", "$.text").alias("content"))


@query("S12_W17_aider", f"""+ m AS (SELECT *, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS k, row_number() OVER (PARTITION BY session_id, role ORDER BY seq) AS j FROM ({_OWN})), g AS (SELECT conv_id, role, k - j AS run, min(k) AS first, string_agg(t, chr(10) ORDER BY k) AS content FROM m GROUP BY 1, 2, 3)
  SELECT CAST(conv_id AS VARCHAR) AS timestamp, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY first) - 1 AS INTEGER) AS seq, role, content FROM g""".replace("\\\\", "\\"))  # fmt: skip
def _(fx):
    def put(folder, c, rows):
        flat = [("#### " if r == "user" else "") + " ".join(t.split()) for _, r, t in rows if r != "system"]
        save(f"{folder}/p{c}/aider.chat.history.md", f"# aider chat started at {c}\n\n" + "\n".join(flat) + "\n")

    return S.aider(fx.spark, written(fx, put)).select("timestamp", "seq", "role", "content")


@query("S16_cline", f"""SELECT session_id, seq, role, CASE WHEN role = 'assistant' THEN content || chr(10) || '[Tool: read_file] /a' || chr(10) || 'end' ELSE content || chr(10) || '[Tool Result] one' || chr(10) || 'two' END AS content, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS n_calls, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS n_results FROM ({_OWN})""")
def _(fx):
    def put(folder, c, rows):
        def said(r, t):
            if r == "user":
                return [*_text(t), {"type": "tool_result", "tool_use_id": "x", "content": [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}]}]
            return [*_text(t), {"type": "tool_use", "id": "x", "name": "read_file", "input": {"path": "/a"}}, *_text("end")]

        save(f"{folder}/tasks/c{c}/api_conversation_history.json", json.dumps([{"role": r, "content": said(r, t), "ts": n} for n, r, t in rows]))

    own = S.cline(fx.spark, written(fx, put))
    return shown(own.withColumns({"n_calls": F.size("calls"), "n_results": F.size("results")}), "n_calls", "n_results")


@query("S27_memory_files", f"SELECT 'Note ' || conv_id AS title, CASE WHEN conv_id % 2 = 0 THEN 'lesson' ELSE 'note' END AS kind, trim(regexp_replace(string_agg(content, ' ' ORDER BY seq), '\\s+', ' ', 'g')) AS body FROM ({_OWN}) GROUP BY conv_id".replace("\\\\", "\\"))
def _(fx):
    def put(folder, c, rows):
        front = f'---\nname: "Note {c}"\n' + ("kind: lesson\n" if c % 2 == 0 else "") + "---\n"
        save(f"{folder}/n{c}.md", front + " ".join(" ".join(t for _, r, t in rows if r != "system").split()) + "\n")

    return S.memory_files(fx.spark, written(fx, put)).select("title", "kind", "body")


# --- SQLite stores


def _messages(c: int, rows: list, shape: Callable) -> list[tuple]:
    return [shape(n, r, t) for n, r, t in rows if r != "system"]


@query("S15_S23_hermes", f"""+ m AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS INTEGER) AS k FROM ({_OWN})) SELECT session_id, k AS seq, role, content, 'T' || conv_id AS title, CASE WHEN conv_id % 4 = 1 THEN 'child' ELSE 'none' END AS relation FROM m WHERE conv_id % 6 <> 5""")
def _(fx):
    def put(folder, c, rows):
        if c % 6 == 5:
            return save(f"{folder}/h{c}/state.db", b"no database at all")
        script = "CREATE TABLE sessions (id, title, cwd, parent_session_id); CREATE TABLE messages (session_id, role, content, timestamp)"
        save_db(f"{folder}/h{c}/state.db", script, sessions=[(f"c{c}", f"T{c}", "/w", "c0" if c % 4 == 1 else None)], messages=_messages(c, rows, lambda n, r, t: (f"c{c}", r, t, n)))

    folder = written(fx, put)
    own = S.store_sessions(fx.spark, folder, "hermes").select(F.col("id").alias("session_id"), "title", "relation")
    return shown(S.store(fx.spark, folder, "hermes").join(own, "session_id"), "title", "relation")


@query("S23_problems", "SELECT DISTINCT 'h' || conv_id AS store FROM conversations WHERE conv_id % 6 = 5 UNION SELECT DISTINCT 'h' || conv_id FROM conversations WHERE conv_id % 6 = 4")
def _(fx):
    def put(folder, c, rows):
        if c % 6 == 5:
            return save(f"{folder}/h{c}/state.db", b"no database at all")
        save_db(f"{folder}/h{c}/state.db", "CREATE TABLE other (a)" if c % 6 == 4 else "CREATE TABLE messages (session_id, role, content, timestamp)")

    return S.problems(fx.spark, written(fx, put), "hermes").select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("store"))


@query("S17_goose", f"""+ m AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS INTEGER) AS k FROM ({_OWN})) SELECT session_id, k AS seq, role, CASE WHEN role = 'assistant' THEN content || chr(10) || '[Tool: shell] ls' ELSE content || chr(10) || '[Tool Result] out' END AS content,
  CASE WHEN role = 'user' THEN seq % 2 = 1 END AS failed FROM m""")  # fmt: skip
def _(fx):
    def put(folder, c, rows):
        def said(n, r, t):
            if r == "assistant":
                return [*_text(t), {"type": "toolRequest", "id": "x", "toolCall": {"status": "success", "value": {"name": "shell", "arguments": {"command": "ls"}}}}]
            return [*_text(t), {"type": "toolResponse", "id": "x", "toolResult": {"status": "error" if n % 2 else "success", "value": [{"type": "text", "text": "out"}]}}]

        script = "CREATE TABLE messages (session_id, role, content_json, created_timestamp)"
        save_db(f"{folder}/g{c}/sessions.db", script, messages=_messages(c, rows, lambda n, r, t: (f"c{c}", r, json.dumps(said(n, r, t)), n)))

    return shown(S.goose(fx.spark, written(fx, put)).withColumn("failed", F.get("results", F.lit(0))["is_error"]), "failed")


@query("S18_crush", f"""+ m AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS INTEGER) AS k FROM ({_OWN})) SELECT session_id, k AS seq, role, CASE WHEN role = 'assistant' THEN content || chr(10) || '[Tool: bash] ls' ELSE content END AS content, CASE WHEN role = 'assistant' THEN 'why' END AS reasoning, 'p' || conv_id AS project FROM m WHERE conv_id % 3 < 2""")
def _(fx):
    def put(folder, c, rows):
        part = lambda kind, **data: {"type": kind, "data": data}
        said = lambda r, t: [part("text", text=t)] if r == "user" else [part("reasoning", thinking="why"), part("text", text=t), part("tool_call", id="x", name="bash", input='{"command": "ls"}'), part("finish")]
        script = "CREATE TABLE messages (session_id, role, parts, created_at)"
        save_db(f"{folder}/p{c}/.crush-data/crush.db".replace(".crush", "crush"), script, messages=_messages(c, rows, lambda n, r, t: (f"c{c}", r, json.dumps(said(r, t)), n)))

    folder = written(fx, put)
    names = [int(n[1:]) for n in os.listdir(folder)]
    listed = [{"path": f"{folder}/p{c}", "data_dir": "crush-data" if c % 3 else f"{folder}/p{c}/crush-data"} for c in names if c % 3 < 2]
    save(f"{folder}/projects.json", json.dumps({"projects": [*listed, *listed[:1]]}))
    return shown(S.crush(fx.spark, folder).withColumn("project", F.regexp_extract("project", r"([^/]+)$", 1)), "reasoning", "project")


_PARTS = lambda r, t: [{"type": "text", "text": t}] if r == "user" else [{"type": "reasoning", "text": "why"}, {"type": "text", "text": t}, {"type": "tool", "callID": "x", "tool": "bash", "state": {"status": "error", "input": {"command": "ls"}, "output": "no"}}]


@query("S09_opencode", f"""+ m AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS INTEGER) AS k FROM ({_OWN})) SELECT session_id, k AS seq, role, CASE WHEN conv_id % 3 = 2 THEN 'db ' ELSE '' END || CASE WHEN role = 'assistant' THEN content || chr(10) || '[Tool: bash] ls' || chr(10) || '[Tool Result] no' ELSE content END AS content, CASE WHEN role = 'assistant' THEN 'why' END AS reasoning FROM m""")
def _(fx):
    def put(folder, c, rows):
        # the tree for all, and the database for a third of them, which then counts
        for n, r, t in rows:
            if r != "system":
                name = f"msg_{c}_{n:03d}"
                save(f"{folder}/message/c{c}/{name}.json", json.dumps({"id": name, "sessionID": f"c{c}", "role": r, "time": {"created": n}}))
                for k, part in enumerate(_PARTS(r, t)):
                    save(f"{folder}/part/{name}/prt_{k:03d}.json", json.dumps(part, ensure_ascii=False))
        if c % 3 == 2:
            script = "CREATE TABLE session (id, title, directory); CREATE TABLE message (id, session_id, time_created, data); CREATE TABLE part (id, message_id, data)"
            own = [row for row in rows if row[1] != "system"]
            parts = [(f"{n}-{k}", f"m{n}", json.dumps(p, ensure_ascii=False)) for n, r, t in own for k, p in enumerate(_PARTS(r, "db " + t))]
            save_db(f"{folder}/d{c}/opencode.db", script, message=[(f"m{n}", f"c{c}", n, json.dumps({"role": r})) for n, r, _ in own], part=parts)

    return shown(S.opencode(fx.spark, written(fx, put)), "reasoning")


@query("S10_opencode_v2", f"SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS INTEGER) AS seq, role, content FROM ({_OWN})")
def _(fx):
    def put(folder, c, rows):
        script = "CREATE TABLE session_message (id, session_id, type, time_created, data)"
        save_db(f"{folder}/d{c}/opencode.db", script, session_message=[(n, f"c{c}", r, n, json.dumps({"text": t}, ensure_ascii=False)) for n, r, t in rows])

    return shown(S.store(fx.spark, written(fx, put), "opencode-v2"))


@query("S21_zed", f"""+ m AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS INTEGER) AS k FROM ({_OWN})) SELECT session_id, k AS seq, role, CASE WHEN role = 'assistant' THEN content || chr(10) || '[Tool: find] *.py' ELSE content || chr(10) || 'quoted' END AS content, CASE WHEN role = 'assistant' THEN 'why' END AS reasoning, CASE WHEN role = 'assistant' THEN 'found' END AS output FROM m""")
def _(fx):
    def put(folder, c, rows):
        import zstandard

        user = lambda t: {"User": {"content": [{"Text": t}, {"Mention": {"uri": "file:///a", "content": "quoted"}}]}}
        agent = lambda t: {"Agent": {"content": [{"Thinking": {"text": "why"}}, {"Text": t}, {"ToolUse": {"id": "x", "name": "find", "input": {"pattern": "*.py"}}}], "tool_results": {"x": {"tool_name": "find", "is_error": False, "content": {"Text": "found"}}}}}
        data = json.dumps({"messages": [user(t) if r == "user" else agent(t) for _, r, t in rows if r != "system"]}, ensure_ascii=False).encode()
        data, kind = (zstandard.compress(data), "zstd") if c % 2 else (data, "json")
        save_db(f"{folder}/z{c}/threads.db", "CREATE TABLE threads (id, summary, updated_at, data_type, data, folder_paths)", threads=[(f"c{c}", "s", "2026", kind, data, "/w/a\n/w/b")])

    own = S.zed(fx.spark, written(fx, put))
    return shown(own.withColumn("output", F.get("results", F.lit(0))["output"]), "reasoning", "output")


@query("S04_cursor", f"""+ m AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS INTEGER) AS k FROM ({_OWN})) SELECT session_id, k AS seq, role, CASE WHEN role = 'assistant' THEN content || chr(10) || '[Tool: edit] /x' ELSE content END AS content, CASE WHEN role = 'assistant' THEN 'why' END AS reasoning FROM m""")
def _(fx):
    def put(folder, c, rows):
        own = [row for row in rows if row[1] != "system"]
        heads = [{"bubbleId": f"b{n}", "type": 1 if r == "user" else 2} for n, r, _ in own]
        said = lambda r, t: {"text": t} if r == "user" else {"text": t, "thinking": {"text": "why"}, "toolFormerData": {"name": "edit", "params": json.dumps({"path": "/x"})}}
        hexed = lambda x: json.dumps(x, ensure_ascii=False).encode().hex() if c % 2 else json.dumps(x, ensure_ascii=False)
        values = [(f"composerData:c{c}", hexed({"fullConversationHeadersOnly": heads}))] + [(f"bubbleId:c{c}:b{n}", hexed(said(r, t))) for n, r, t in own] + [(f"bubbleId:c{c}:stray", hexed({"text": "in no header"}))]
        save_db(f"{folder}/w{c}/state.vscdb", "CREATE TABLE cursorDiskKV (key, value)", cursorDiskKV=values)

    return shown(S.cursor(fx.spark, written(fx, put)), "reasoning")
