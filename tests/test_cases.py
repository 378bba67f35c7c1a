"""Cases that reach every branch of the rules, which the tables' own texts don't."""

from pyspark.sql import functions as F

from heddle.functions import columns as C
from heddle.operators import analytics as P
from heddle.operators import markdown as MD
from heddle.operators import memory as M
from heddle.operators import sessions as R
from heddle.operators import sinks
from heddle.operators import visibility as S
from heddle.sources import jsonl as J

STATUS = [
    "ok", "success", "succeeded", "complete", "completed", "done", "failed", "fail", "error", "errored", "failure", "pending", "queued", "waiting", "running", "in_progress", "started",
    "cancelled", "canceled", "aborted", "unmatched", "orphaned", "In-Progress", " IN PROGRESS ", "denied", "", "  ", None, "OK",
]

ARGS = [
    '{"command": "ls  -l", "path": "/x"}', '{"cmd": "make"}', '{"path": "/p", "file_path": "/f"}', '{"notebook_path": "/n.ipynb"}', '{"url": "u", "pattern": "a+"}', '{"prompt": "do", "description": "why"}', '{"command": "  ", "query": "q"}',
    '{"command": 5, "url": "http://h"}', '{"other": "x"}', '{broken', "```bash\nls -l\n```", "\n\n~~~\nsecond line", "", None, '  {"command": "' + "long word " * 20 + '"}', '["a"]',
]

TARGETS = ["ls -l", "make", "/f", "/n.ipynb", "a+", "why", "q", "http://h", "", "{broken", "ls -l", "second line", "", "", ("long word " * 20)[:93] + "...", '["a"]']

TOOLS = ["Bash", "run_shell_command", "Read", "MultiEdit", "apply_patch", "Grep", "WebFetch", "glob_files", "Task", "sqlite_query", "git_commit", None]

TITLES = [
    "Fix the parser of dates", "session 12 of many", "short", "<local-command-caveat>Caveat: the messages below were generated by x", "a sandbox for the new code", "needs approval from the owner", "deploy-site /deploy-site now please", "x /y then more of it",
    "12345678901234567890 ab", "", None, "  `Code` and <b>tags</b> stay readable ", "[Tool Result] all of this goes", "shared workflow of the team", "a" * 100,
]

SHOWN = ["Fix the parser of dates", None, None, None, None, None, None, "x /y then more of it", None, None, None, "Code and tags stay readable", None, None, "a" * 80]

INJECTED = [
    ("user", "codex", "plain words", "prompt", "", ""), ("user", "x", "", "prompt", "", ""),
    ("user", "x", "<command-name>/clear</command-name>", "slash_prompt", "", "/clear"), ("user", "x", "<command-message>m</command-message> <command-name> /fix </command-name><command-args>all of it</command-args>", "slash_prompt", "", "/fix all of it"),
    ("user", "x", "<command-name>/a</command-name> and words", "prompt", "", ""), ("assistant", "x", "<command-name>/clear</command-name>", "prompt", "", ""),
    ("user", "x", "Base directory for this skill: /home/u/skills/review/", "event", "Skill loaded: review", ""), ("user", "x", "Stop hook feedback: no", "event", "Hook feedback", ""),
    ("user", "x", "<task-notification>done</task-notification>", "event", "Task notification", ""), ("user", "x", "abcdef12 toolu_01X ended", "event", "Task notification", ""),
    ("assistant", "x", " <System-Reminder>be kind</system-reminder> ", "event", "System reminder", ""), ("user", "x", "<system-reminder>be kind</system-reminder> more", "prompt", "", ""),
    ("user", "x", "<local-command-stdout>out</local-command-stdout>", "event", "Local command", ""), ("user", "codex", "<environment_context>x</environment_context>", "event", "System context", ""),
    ("user", "x", "<environment_context>x</environment_context>", "prompt", "", ""), ("system", "codex", "# AGENTS.md instructions for /w <INSTRUCTIONS>x</INSTRUCTIONS>", "event", "AGENTS instructions", ""),
    ("user", "codex", "<!-- BEGIN AGENTS --> x <!-- END AGENTS -->", "event", "System prompt", ""), ("assistant", "codex", "<user_action>x</user_action>", "prompt", "", ""),
]

NOISE = ["[command: /exit]\n[exit]\n()", "[command: /exit]\nwords", "", "  \n", "(  )", "No files found", " OK ", "<local-command-stdout>x", "done it", "[Tool Result]"]

RAW_TITLES = ["<b>Fix</b> `the` parser", "a ```code\nblock``` b", "[Tool Result] gone", "  many \n blanks  ", "plain"]

CLEANED = ["Fix the parser", "a b", "", "many blanks", "plain"]


def results(spark, values, put, kind="string"):
    """put of each value, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in rows.select(put(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_states_targets_and_labels_of_calls(spark):
    words = {w: state for state, own in C.TOOL_STATES.items() for w in own}
    want = [words.get((w or "").strip().lower().replace("-", "_").replace(" ", "_"), "unknown") for w in STATUS]
    assert results(spark, STATUS, lambda v: C.tool_state(v, F.lit(False))) == want and "cancelled" in want and "pending" in want
    assert set(results(spark, STATUS, lambda v: C.tool_state(v, F.lit(True)))) == {"failed"}
    assert results(spark, ARGS, C.tool_target) == TARGETS
    assert results(spark, TOOLS, C.tool_icon) == ["⚡", "⚡", "📄", "🛠", "🔧", "🔎", "🌐", "🔎", "🔧", "🔧", "🔧", "🔧"]
    assert results(spark, TOOLS, C.tool_importance) == ["major" if w in (0, 1, 3, 4, 9, 10) else "minor" for w in range(12)]
    texts = ["@@ -1 +1 @@", '  {"a": 1}', "import python", "select 1 -- SQL", "plain"]
    assert results(spark, texts, lambda v: C.guessed_language(F.lit("Read"), v)) == ["diff", "json", "python", "sql", "plaintext"]


def test_titles(spark):
    native = results(spark, TITLES, lambda v: C.inferred_title(v, F.lit(None).cast("string"), F.lit("a-b"), F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("0123456789")))
    assert native == [w or "A B 2024-01-02 • 23456789" for w in SHOWN]
    assert results(spark, RAW_TITLES, C.clean_title) == CLEANED


def test_injected_text_and_noise(spark):
    rows = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(INJECTED)], "i int, role string, tool string, v string")
    got = rows.select("i", R.injected_display(F.col("v"), F.col("role"), F.col("tool")).alias("x")).orderBy("i").select("x.*").collect()
    assert [tuple(r) for r in got] == [r[3:] for r in INJECTED]
    assert results(spark, NOISE, C.command_noise) == [i in (0, 4) for i in range(10)]
    assert results(spark, NOISE, lambda v: C.contents_noise(F.regexp_replace(v, r"\s+$", ""))) == [i in (2, 3, 5, 6, 7, 9) for i in range(10)]


def test_times(spark):
    text = ["2026-01-02T03:04:05.123456789Z", "1767323045", "1767323045000", "2026-01-02 03:04:05+02:00", "2026-01-02 03:04:05", "soon"]
    want = ["2026-01-02 03:04:05.123456", "2026-01-02 03:04:05", "2026-01-02 03:04:05", "2026-01-02 01:04:05", "2026-01-02 03:04:05", "1970-01-01 00:00:00"]
    assert [str(t) for t in results(spark, text, lambda v: C.timestamp_of(v).cast("timestamp_ntz"))] == want
    local = results(spark, ["2024-07-01T12:00:00Z", "2024-01-01 10:30:00+02:00", "2024-01-01T12:00:00", "soon"], lambda v: C.local_naive(v, "Europe/Berlin"))
    assert [str(t) for t in local] == ["2024-07-01 14:00:00", "2024-01-01 09:30:00", "2024-01-01 12:00:00", "None"]


def test_compact_counts(spark):
    counts = [None, -1, 0, 999, 1000, 1050, 1150, 1250, 1350, 1950, 9_999, 12_250, 99_949, 99_950, 99_999, 100_000, 999_999, 1_000_000, 1_250_000, 1_350_000, 1_450_000, 1_550_000, 99_950_000, 100_000_000, 1_234_567_890]
    want = ["", "", "0", "999"] + [f"{n / 1000:.1f}k".replace(".0k", "k") for n in counts[4:15]] + ["100k", "999k"] + [f"{n / 1e6:.1f}M".replace(".0M", "M") for n in counts[17:23]] + ["100M", "1234M"]
    assert results(spark, counts, C.compact_count, "long") == want and want[5:8] == ["1.1k", "1.1k", "1.2k"]


def test_memory_rules(spark):
    rows = spark.createDataFrame([("  ", "b", "fact"), ("t" * 513, "b", "fact"), ("T", "b" * 64_001, "fact"), ("T", "b", "other"), ("T", "b", "fact")], "title string, body string, kind string")
    assert [r[0] for r in rows.select(M.invalid_reason()).collect()] == ["title is empty", "title is too long", "body is too long", "kind is unknown", None]
    low = spark.createDataFrame([(None, None, "x"), (1, 9, "x"), (2, 3, "x"), (2, 4, "x"), (2, 3, "an outline of many characters"), (None, 1, "x")], "p int, m int, o string")
    assert [r[0] for r in low.select(S.low_value(F.col("p"), F.col("m"), F.col("o"), F.lit("x"))).collect()] == [False, True, True, False, False, True]


FENCED = ["a < b & c > d", "a\n```\n<x>\n```\n<y>", "~~~~ html\n<a>\n~~~\n```\n<b>\n~~~~~\n<c>", "```\n<open>", "  ````\n```\n<in>\n```\n  `````\n<out>", "`` <no> ``", "", "```a\n<in>\n```b\n<out>\n~~~\n<in>"]
ESCAPED = ["a &lt; b &amp; c &gt; d", "a\n```\n<x>\n```\n&lt;y&gt;", "~~~~ html\n<a>\n~~~\n```\n<b>\n~~~~~\n&lt;c&gt;", "```\n<open>", "  ````\n```\n<in>\n```\n  `````\n&lt;out&gt;", "`` &lt;no&gt; ``", "", "```a\n<in>\n```b\n&lt;out&gt;\n~~~\n<in>"]


def test_escaping_outside_fences(spark):
    assert results(spark, [*FENCED, None], MD.escaped_outside_fences) == [*ESCAPED, None]
    assert results(spark, ["a\n``b``", "```\nb\n```", "x\n`````y"], lambda v: F.element_at(F.split(sinks.fenced(v), "\n"), 1)) == ["```", "````", "``````"]


def test_markdown_has_one_heading_for_each_turn(spark):
    call = "array<struct<tool:string,input:string,status:string,is_error:boolean>>"
    bash = ("Bash", '{"command": "make"}', None, False)
    at = lambda day, minute: f"2026-01-0{day} 10:0{minute}:00"
    rows = [
        ("a", 0, "system", "text", "be <kind>", at(1, 0), None, None), ("a", 1, "user", "text", "fix <b>\n```\n<raw>\n```", at(1, 1), None, None),
        ("a", 2, "assistant", "text", "", at(1, 2), "why", [bash, bash]), ("a", 3, "assistant", "text", "", at(1, 3), None, [bash, ("Edit", '{"path": "/x"}', "failed", None)]),
        ("a", 4, "assistant", "text", "done", at(1, 4), None, None), ("a", 5, "assistant", "text", "really", at(1, 5), None, [bash]),
        ("a", 6, "user", "injected_context", "note", at(1, 6), None, None), ("a", 7, "user", "text", "more", at(2, 0), None, None), ("a", 8, "tool", "text", "Exit\ncode 1", at(2, 1), None, None), ("a", 9, "assistant", "text", "ok", at(2, 2), None, None),
    ]
    messages = spark.createDataFrame(rows, f"session_id string, seq int, role string, kind string, content string, timestamp string, reasoning string, tool_calls {call}").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    sessions = spark.createDataFrame([("a", "T", "codex", None, 10)], "id string, title string, tool string, project string, messages_count int")
    (row,) = MD.markdown(sessions, messages).collect()
    body = row.text.split("- Messages: 10\n\n")[1]
    assert body == (
        "*Thursday, Jan 1, 2026*\n\n**System:** be &lt;kind&gt;\n\n### Prompt 1 · 2026-01-01 10:01\n\nfix &lt;b&gt;\n```\n<raw>\n```\n\n"
        "<details>\n<summary>Thinking</summary>\n\nwhy\n</details>\n\n- ⚡ **Bash** make ×3\n- 🛠 **Edit** /x (failed)\n\n**Assistant**\n\ndone\n\nreally\n\n- ⚡ **Bash** make\n\n"
        "<details>\n<summary>Injected Context</summary>\n\nnote\n</details>\n\n*Friday, Jan 2, 2026*\n\n### Prompt 2 · 2026-01-02 10:00\n\nmore\n\n- 🔧 Exit code 1\n\n**Assistant**\n\nok\n"
    )


def test_how_messages_are_shown(spark):
    shown = lambda text, tool, role, **rules: results(spark, [text], lambda v: MD.displayed(v, F.lit(tool), F.lit(role), rules))[0]
    assert shown("\x1b[31ma\x1b[0m\r\n\n\n\nb \n", "x", "user") == "a\n\nb"
    assert shown("<command-name>/exit</command-name>\n<command-message>exit</command-message>\n<command-args></command-args>", "claude-code", "user") == ""
    assert shown("<command-name>/fix</command-name> it", "claude-code", "user") == "[command: /fix] it"
    assert shown("Caveat: The messages below were generated by the user now go", "opencode", "user") == "now go"
    assert shown("[Tool Result]\nPrompt\nkeep\nNo files found", "x", "user") == "keep"
    names = "\n".join(f"VAR_{i}: not set" for i in range(12))
    once = shown(names, "opencode", "assistant")
    assert once.startswith("Unset environment variables (12): VAR_0, VAR_1,") and ", +2 more\n\n<details>" in once and names in once
    assert shown(once, "opencode", "assistant") == once
    files = "\n".join(f"Updated file: a{i}.py" for i in range(10))
    once = shown(files, "cursor", "assistant", operations=True)
    assert once.startswith("File operations summary (collapsed):\n- updated: `a0.py`\n") and "- ... and 2 more file operations" in once and shown(once, "cursor", "assistant", operations=True) == once
    assert shown(files, "cursor", "assistant") == files and shown("Updated file: a\nb", "cursor", "assistant", operations=True) == "Updated file: a\nb"
    assert results(spark, ["\x1b[1;31mred\x1b[0m <local-command-stdout>x</local-command-stdout> done "], P.stripped) == ["red x done"]


def test_a_long_branch_and_context_edits(spark, tmp_path):
    n = 3000
    rows = [("f", str(i), str(i - 1) if i else None, i, f"m{i}") for i in range(n)] + [("f", "side", "10", 5, "off"), ("g", "a", "b", 0, "ring"), ("g", "b", "a", 1, "ring"), ("h", "only", "missing", 0, "x")]
    own = spark.createDataFrame(rows, "file string, native_id string, parent_id string, seq int, content string")
    on = J.active_branch(own)
    got = {(r.file, r.native_id) for r in on.collect()}
    assert got == {("f", str(i)) for i in range(n)} | {("g", "a"), ("g", "b"), ("h", "only")}
    (tmp_path / "s.jsonl").write_text('{"type":"context_edit","targetId":"5","replacement":null}\n{"type":"context_edit","targetId":"6","replacement":"new"}\n{"type":"context_edit","targetId":"6","replacement":"newer"}\n')
    edits = J.context_edits(spark, str(tmp_path), J.FORMATS["pi"]).withColumn("file", F.lit("f"))
    out = {r.native_id: (r.active, r.content) for r in J.edited(on.filter("file = 'f'"), edits).collect()}
    assert out["5"] == (False, "m5") and out["6"] == (True, "newer") and out["7"] == (True, "m7")
