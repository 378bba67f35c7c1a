import json
import sqlite3
import struct

from heddle.sources import files as S
from heddle.sources import jsonl as J


def write(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))


def record(kind, content, n, **more):
    return {"type": kind, "sessionId": "s1", "timestamp": f"2026-03-01T10:00:{n:02d}Z", "cwd": "/work/p1", "uuid": f"u{n}", "message": {"role": kind, "content": content, "model": "m", "usage": {"input_tokens": n, "output_tokens": 1}}} | more


def test_json_lines(spark, tmp_path):
    write(
        tmp_path / "a" / "one.jsonl",
        {"type": "summary", "summary": "A summary of the work done"},
        record("user", "Please repair the failing build today", 1),
        "{broken", "",
        record("assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "Reading."}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/a.py"}}], 2),
        record("user", [{"type": "tool_result", "tool_use_id": "t1", "content": "text", "is_error": True}], 3),
        record("user", "skill text", 4, isMeta=True),
        {"type": "custom-title", "customTitle": "Repairing the build"},
    )
    write(tmp_path / "b" / "one.jsonl", record("user", "an older copy of it", 0))
    fmt = J.FORMATS["claude-code"]
    rows = sorted((r for r in J.messages(spark, str(tmp_path), fmt).collect() if "/a/" in r.file), key=lambda r: r.seq)
    assert [(r.seq, r.role, r.kind) for r in rows] == [(1, "user", "text"), (4, "assistant", "text"), (5, "user", "text"), (6, "user", "injected_context")]
    assert rows[1].content == "Reading.\n[Tool: Read] /a.py" and rows[1].reasoning == "hm" and rows[1].tokens == {"input_tokens": 2, "output_tokens": 1}
    assert rows[2].content == "[Tool Result] text" and str(rows[0].timestamp) == "2026-03-01 10:00:01" and rows[0].native_id == "u1"
    (s,) = J.sessions(spark, str(tmp_path), fmt).collect()
    assert (s.id, s.title, s.messages_count, s.project, s.outline) == ("s1", "Repairing the build", 4, "/work/p1", "Please repair the failing build today") and "/a/" in s.source_path
    (c,) = J.tool_calls(J.messages(spark, str(tmp_path), fmt)).collect()
    assert (c.id, c.tool, c.output, c.is_error) == ("t1", "Read", "text", True)
    bad = {r.file[-12:]: (r.malformed, r.unknown) for r in J.skipped(spark, str(tmp_path), fmt).collect()}
    assert bad["/a/one.jsonl"] == (1, 2)


def test_active_branch(spark, tmp_path):
    node = lambda i, parent: {"type": "message", "id": i, "parentId": parent, "timestamp": "2026-01-01", "message": {"role": "user", "content": i}}
    write(tmp_path / "t.jsonl", node("a", None), node("b", "a"), node("c", "a"), node("d", "c"))
    own = J.messages(spark, str(tmp_path), J.FORMATS["pi"])
    assert sorted(r.content for r in J.active_branch(own).collect()) == ["a", "c", "d"]


def test_sqlite_stores(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "state.db")
    con.execute("create table messages (session_id, role, content, timestamp)")
    con.executemany("insert into messages values (?, ?, ?, ?)", [("x", "user", "hi", 2), ("x", "assistant", b"yo", 3), ("y", "user", "é".encode().hex() * 5, 1)])
    con.commit()
    con.close()
    (tmp_path / "sub").mkdir()
    sqlite3.connect(tmp_path / "sub" / "state.db").execute("create table other (a)")
    rows = sorted((r.session_id, r.seq, r.role, r.content) for r in S.store(spark, str(tmp_path), "hermes").collect())
    assert rows == [("x", 0, "user", "hi"), ("x", 1, "assistant", "yo"), ("y", 0, "user", "ééééé")]


def test_trees_and_logs(spark, tmp_path):
    write(tmp_path / "c" / "api_conversation_history.json", [{"role": "user", "content": [{"type": "text", "text": "do"}]}, {"role": "assistant", "content": "done"}])
    assert sorted((r.seq, r.role, r.content) for r in S.cline(spark, str(tmp_path / "c")).collect()) == [(0, "user", "do"), (1, "assistant", "done")]
    write(tmp_path / "v" / "k.json", {"requests": [{"message": {"text": "q"}, "timestamp": 1, "response": [{"value": "a"}]}]})
    assert sorted((r.session_id, r.seq, r.role, r.content) for r in S.vscode(spark, str(tmp_path / "v")).collect()) == [("k", 0, "user", "q"), ("k", 1, "assistant", "a")]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "aider.chat.history.md").write_text("# aider chat started at 2026-01-01 10:00:00\n\n#### first\n#### line\n\nanswer\nmore\n> ran\n# aider chat started at 2026-01-02 10:00:00\n#### again\nyes\n")
    rows = sorted((r.timestamp, r.seq, r.role, r.content) for r in S.aider(spark, str(tmp_path / "m")).collect())
    assert rows == [("2026-01-01 10:00:00", 0, "user", "first\nline"), ("2026-01-01 10:00:00", 1, "assistant", "answer\nmore"), ("2026-01-01 10:00:00", 2, "tool", "ran"), ("2026-01-02 10:00:00", 0, "user", "again"), ("2026-01-02 10:00:00", 1, "assistant", "yes")]
    write(tmp_path / "g" / "r.jsonl", {"id": "1", "type": "user", "content": "a"}, {"id": "2", "type": "gemini", "content": "b"}, {"id": "3", "type": "user", "content": "c"}, {"rewindTo": "2"}, {"id": "2", "updates": {"content": "B"}}, {"id": "4", "type": "user", "content": "d"}, {"orderIds": ["4", "1"]}, {"removeIds": ["1"]})
    rows = sorted((r.seq, r.role, r.content) for r in S.replayed(J.lines(spark, str(tmp_path / "g"), "*.jsonl")).collect())
    assert rows == [(0, "user", "d"), (1, "assistant", "B")]
    write(tmp_path / "n" / "note.md", '---\nname: "A lesson"\nkind: lesson\n---\nBody text\n')
    assert [(r.title, r.kind, r.body) for r in S.memory_files(spark, str(tmp_path / "n")).collect()] == [("A lesson", "lesson", "Body text")]


def opencode_tree(folder, sessions, messages):
    for c in range(sessions):
        for n in range(messages):
            write(folder / f"message/s{c}/msg_{c}_{n}.json", {"id": f"msg_{c}_{n}", "sessionID": f"s{c}", "role": "user", "time": {"created": messages - n}})
            for k in range(2):
                write(folder / f"part/msg_{c}_{n}/prt_{k}.json", {"type": "text", "text": f"{c} {n} {k}"})


def test_opencode_tree_and_database(spark, tmp_path):
    opencode_tree(tmp_path, 3, 2)
    write(tmp_path / "message/s9/msg_without_parts.json", {"id": "msg_without_parts", "role": "user"})
    write(tmp_path / "part/msg_without_head/prt_0.json", {"type": "text", "text": "x"})
    write(tmp_path / "message/s8/msg_8.json", {"id": "msg_0_0", "role": "assistant"})  # a session by its folder, and a message that two sessions have
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "opencode.db").write_bytes(b"no database")
    con = sqlite3.connect(tmp_path / "opencode.db")
    con.executescript("create table message (id, session_id, time_created, data); create table part (id, message_id, data)")
    con.executemany("insert into message values (?, ?, ?, ?)", [("a", "s1", 2, '{"role": "user"}'), ("b", "s1", 1, '{"role": "user"}'), ("c", "only", 1, '{"role": "user"}')])
    con.executemany("insert into part values (?, ?, ?)", [(m, m, json.dumps({"type": "text", "text": f"db {m}"})) for m in "abc"])
    con.commit()
    con.close()
    got = sorted((r.session_id, r.seq, r.role, r.content) for r in S.opencode(spark, str(tmp_path)).collect())
    own = [(f"s{c}", n, "user", f"{c} {1 - n} 0\n{c} {1 - n} 1") for c in (0, 2) for n in (0, 1)]
    assert got == sorted([*own, ("s8", 0, "assistant", "0 0 0\n0 0 1"), ("s1", 0, "user", "db b"), ("s1", 1, "user", "db a"), ("only", 0, "user", "db c")])


def test_opencode_reads_many_small_files_in_few_tasks(spark, tmp_path):
    opencode_tree(tmp_path, 4, 30)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # then each file is a partition of the scan
    try:
        own = S.opencode(spark, str(tmp_path))
        spark.sparkContext.setJobGroup("opencode", "")
        assert own.count() == 120
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("opencode") for s in told.getJobInfo(j).stageIds}
    assert stages and max(i.numTasks for s in stages if (i := told.getStageInfo(s))) <= 4 * spark.sparkContext.defaultParallelism


def test_messagepack(spark, tmp_path):
    data = b"\x82\xa1a\x93\x01\xff\xcb" + struct.pack(">d", 1.5) + b"\xa1b\xc0" + b"\xd9\x03xyz" + b"\xcd\x01\x00" + b"\xc4\x02\x01\x02"
    assert S.unpack(data) == [{"a": [1, -1, 1.5], "b": None}, "xyz", 256, b"\x01\x02"]
    (tmp_path / "f.bin").write_bytes(data)
    rows = sorted((r.n, r.record) for r in S.messagepack(spark, str(tmp_path)).collect())
    assert rows[0] == (0, '{"a": [1, -1, 1.5], "b": null}') and rows[3] == (3, '"0102"')


def test_transcripts_below_a_home_are_found(spark, tmp_path):
    from heddle.sources import files as S

    for name in (".claude/projects/p/a.jsonl", ".claude/projects/p/note.txt", ".codex/sessions/2026/01/rollout-x.jsonl", ".config/Cursor/User/globalStorage/state.vscdb", "other/b.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    found = {(r.tool, r.path.rsplit("/", 1)[1]) for r in S.discovered(spark, [str(tmp_path)]).collect()}
    assert found == {("claude-code", "a.jsonl"), ("codex", "rollout-x.jsonl"), ("cursor", "state.vscdb")}
    assert [r.tool for r in S.discovered(spark, [str(tmp_path), str(tmp_path / "none")], ["codex"]).collect()] == ["codex"]
