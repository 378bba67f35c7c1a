"""Sessions as Markdown by turns, and how messages are shown: noise out, file operations summed up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import columns as C
from heddle.operators.ordered import in_order, islands, upto, with_turns

# How lines tell of a file that was changed, and of a variable that isn't set; what opens a fence.
_CHANGED = (r"(?id)^the file\s+(.+?)\s+has been\s+(updated|created|deleted|modified)\.?$", r"(?id)^(updated|created|deleted|modified)\s+file\s*:?\s+(.+?)\.?$")
_UNSET = r"(?id)^([A-Z][A-Z0-9_]{2,})\s*:\s*not set\s*$"
_FENCE = r"^\s*(`{3,}|~{3,})"
_ANSI = r"\x1b\[[0-?]*[ -/]*[@-~]"
_NOISE = (r"(?i)\[Tool Result\]", r"(?imd)^\s*Prompt\s*$", r"(?imd)^\s*No files found\s*$")
# White space at the ends; other line ends than \n have no part in it.
_ENDS = r"^[ \t\n\f\r]+|[ \t\n\f\r]+\z"
_CAVEAT = "caveat: the messages below were generated by the user"
#: Operations and variables that are listed, and how many it takes to sum them up.
OPERATIONS, LEAST_OPERATIONS, VARIABLES, LEAST_VARIABLES = 8, 3, 10, 4


def fenced_spans(lines: Column) -> Column:
    """The spans (first, last) of lines that fences enclose, from 0, of an array of lines.

    An automaton over the lines that begin with a fence sign: outside, such a line opens a block; inside, one that begins
    with the same sign at least as often closes it, and others are content. A block that nothing closes goes to the end.
    """
    signs = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, _FENCE, 1).alias("sign"))), lambda s: s["sign"] != "")
    spans = F.array().cast("array<struct<first:int,last:int>>")
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), spans.alias("spans"))

    def step(state: Column, line: Column) -> Column:
        outside, closes = state["open"] == "", line["sign"].startswith(state["open"])
        ended = F.concat(state["spans"], F.array(F.struct(state["at"].alias("first"), line["i"].alias("last"))))
        return F.struct(
            F.when(outside, line["sign"]).when(closes, F.lit("")).otherwise(state["open"]).alias("open"),
            F.when(outside, line["i"]).otherwise(state["at"]).alias("at"),
            F.when(~outside & closes, ended).otherwise(state["spans"]).alias("spans"),
        )

    rest = lambda s: F.when(s["open"] == "", s["spans"]).otherwise(F.concat(s["spans"], F.array(F.struct(s["at"].alias("first"), F.size(lines).alias("last")))))
    return F.aggregate(signs, start, step, rest)


def escaped_outside_fences(text: Column) -> Column:
    """text with &, < and > escaped, but not in fenced blocks; null for null."""
    lines = F.split(text, "\n")
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    # the spans are worked out once, as an element of an array
    both = F.transform(F.array(fenced_spans(lines)), lambda spans: F.array_join(F.transform(lines, lambda x, i: F.when(F.exists(spans, lambda s: i.between(s["first"], s["last"])), x).otherwise(plain(x))), "\n"))
    return both[0]


def tidy(text: Column) -> Column:
    """Line ends of one kind, no more than one empty line in a row, none at the ends."""
    own = F.regexp_replace(text, "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(own, "\n{3,}", "\n\n"), _ENDS, "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: as an element of an array."""
    return F.transform(F.array(value), use)[0]


def _own_lines(text: Column, told: Callable[[Column], Column]) -> Column:
    """The lines with anything on them as (told, others): those for which told holds, and those for which it doesn't."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, _ENDS, "")), lambda x: x != "")
    return _once(lines, lambda own: F.struct(F.filter(own, told).alias("told"), F.filter(own, lambda x: ~told(x)).alias("others")))


def _details(label: Column, text: Column) -> Column:
    return F.concat(F.lit("\n\n<details><summary>Show all "), label, F.lit("</summary>\n\n```text\n"), text, F.lit("\n```\n\n</details>"))


def summed_operations(text: Column) -> Column:
    """A message that tells of three changed files or more: the first eight as a list, the text itself behind a fold. Others stay."""
    path = lambda x: F.regexp_replace(x, "^[` ]+|[` ]+$", "")
    first, second = _CHANGED
    hit = lambda x: x.rlike(first) | x.rlike(second)
    action = lambda x: F.when(x.rlike(first), F.lower(F.regexp_extract(x, first, 2))).otherwise(F.lower(F.regexp_extract(x, second, 1)))
    name = lambda x: path(F.when(x.rlike(first), F.regexp_extract(x, first, 1)).otherwise(F.regexp_extract(x, second, 2)))

    def summed(lines: Column) -> Column:
        changed, others = lines["told"], lines["others"]
        n = F.size(changed)
        shown = F.transform(F.slice(changed, 1, OPERATIONS), lambda x: F.concat(F.lit("- "), action(x), F.lit(": `"), name(x), F.lit("`")))
        more = F.when(n > OPERATIONS, F.concat(F.lit("\n- ... and "), (n - OPERATIONS).cast("string"), F.lit(" more file operations"))).otherwise("")
        rest = F.when(F.size(others).between(1, 3), F.concat(F.lit("\n\n"), F.array_join(others, "\n"))).otherwise("")
        out = F.concat(F.lit("File operations summary (collapsed):\n"), F.array_join(shown, "\n"), more, rest, _details(F.concat(n.cast("string"), F.lit(" file operations")), text))
        return F.when((n < LEAST_OPERATIONS) | text.contains("File operations summary (collapsed):"), text).otherwise(tidy(out))

    return _once(_own_lines(text, hit), summed)


def summed_variables(text: Column) -> Column:
    """A message that tells of four variables or more that aren't set: their names in one line, the text itself behind a fold. Others stay."""

    def summed(lines: Column) -> Column:
        keys, others = lines["told"], lines["others"]
        n = F.size(keys)
        shown = F.array_join(F.transform(F.slice(keys, 1, VARIABLES), lambda x: F.upper(F.regexp_extract(x, _UNSET, 1))), ", ")
        more = F.when(n > VARIABLES, F.concat(F.lit(", +"), (n - VARIABLES).cast("string"), F.lit(" more"))).otherwise("")
        rest = F.when(F.size(others).between(1, 2), F.concat(F.lit("\n"), F.array_join(others, "\n"))).otherwise("")
        out = F.concat(F.lit("Unset environment variables ("), n.cast("string"), F.lit("): "), shown, more, rest, _details(F.concat(n.cast("string"), F.lit(" unset variables")), text))
        there = text.contains("Unset environment variables (") & text.contains("<details>")
        return F.when((n < LEAST_VARIABLES) | there, text).otherwise(tidy(out))

    return _once(_own_lines(text, lambda x: x.rlike(_UNSET)), summed)


def _without_commands(text: Column) -> Column:
    for tag, a, b in (("command-name", "[command: ", "]"), ("command-message", "[", "]"), ("command-args", "(", ")")):
        text = F.regexp_replace(text, f"(?s)<{tag}>(.*?)</{tag}>", f"{a}$1{b}")
    return _once(tidy(text), lambda x: F.when(C.command_noise(x), "").otherwise(x))


def displayed(text: Column, tool: Column, role: Column, rules: dict[str, bool] | None = None) -> Column:
    """How a message is shown; the stored text stays. Shown text is shown as it is.

    rules: ansi, commands, caveat, variables (on unless switched off) and operations (off unless switched on).
    """
    on = {"ansi": True, "commands": True, "caveat": True, "variables": True, "operations": False} | (rules or {})
    own = F.coalesce(text, F.lit(""))
    own = tidy(F.regexp_replace(own, _ANSI, "") if on["ansi"] else own)
    for pattern in _NOISE:
        own = F.regexp_replace(own, pattern, "")
    own = tidy(own)
    if on["commands"]:
        own = _once(own, lambda x: F.when(tool == "claude-code", _without_commands(x)).otherwise(x))
    if on["caveat"]:
        after = lambda x: tidy(F.substring(x, F.instr(F.lower(x), _CAVEAT) + len(_CAVEAT), F.length(x)))
        own = _once(own, lambda x: F.when(tool.isin("opencode", "claude-code") & (role == "user") & F.lower(x).contains(_CAVEAT), after(x)).otherwise(x))
    if on["operations"]:
        own = _once(own, lambda x: F.when(role == "assistant", summed_operations(x)).otherwise(x))
    if on["variables"]:
        own = _once(own, lambda x: F.when(tool == "opencode", summed_variables(x)).otherwise(x))
    return tidy(own)


def _folded_details(summary: Column, body: Column) -> Column:
    return F.concat(F.lit("<details>\n<summary>"), summary, F.lit("</summary>\n\n"), body, F.lit("\n</details>\n"))


def call_lines(calls: Column) -> Column:
    """The calls of a message, a line each: icon, name, target, and whether it failed."""
    failed = lambda c: F.when(F.coalesce(c["is_error"], F.lit(False)) | (c["status"] == "failed"), " (failed)").otherwise("")
    return F.transform(calls, lambda c: F.rtrim(F.concat(F.lit("- "), C.tool_icon(c["tool"]), F.lit(" **"), F.coalesce(c["tool"], F.lit("tool")), F.lit("** "), C.tool_target(c["input"]), failed(c))))


def turn_lines(messages: DataFrame) -> DataFrame:
    """(session_id, turn, seq, part, text): what a session's Markdown consists of, in order of turn, seq and part.

    Each prompt gets one heading with its number and time, a day that differs from the turn before a line above it; the answer
    is marked once a turn; runs of equal tool lines are folded into one with their number; reasoning and injected text are
    behind folds.
    """
    own = with_turns(messages.select("session_id", "seq", "role", "kind", "content", "timestamp", *(c for c in ("reasoning", "tool_calls") if c in messages.columns)))
    for name, kind in (("reasoning", "string"), ("tool_calls", "array<struct<tool:string,input:string,status:string,is_error:boolean>>")):
        own = own if name in own.columns else own.withColumn(name, F.lit(None).cast(kind))
    days = own.groupBy("session_id", "turn").agg(F.to_date(F.min("timestamp")).alias("day"))
    before = F.lag("day").over(in_order("session_id", by="turn"))
    days = days.withColumn("new_day", F.coalesce(before != F.col("day"), F.col("day").isNotNull()))
    own = own.join(days, ["session_id", "turn"])
    text = escaped_outside_fences(F.coalesce("content", F.lit("")))
    prompt = (F.col("role") == "user") & (F.col("kind") == "text")
    stamp = F.when(F.col("timestamp").isNotNull(), F.concat(F.lit(" · "), F.date_format("timestamp", "yyyy-MM-dd HH:mm"))).otherwise("")
    first_of_turn = F.row_number().over(in_order("session_id", "turn")) == 1
    says = (F.col("role") == "assistant") & (F.coalesce("content", F.lit("")) != "")
    answers = F.sum(says.cast("int")).over(upto(in_order("session_id", "turn")))
    own = own.withColumns({"first_of_turn": first_of_turn, "answers": answers})
    body = (
        F.when(prompt, F.concat(F.lit("### Prompt "), F.col("turn").cast("string"), stamp, F.lit("\n\n"), text, F.lit("\n")))
        .when(says, F.concat(F.when(F.col("answers") == 1, "**Assistant**\n\n").otherwise(""), text, F.lit("\n")))
        .when((F.col("role") == "user") & (F.coalesce("content", F.lit("")) != ""), _folded_details(F.initcap(F.translate("kind", "_", " ")), text))
        .when((F.col("role") == "system") & (F.coalesce("content", F.lit("")) != ""), F.concat(F.lit("**System:** "), text, F.lit("\n")))
    )
    part = lambda n, value: F.struct(F.lit(n).alias("part"), value.alias("text"))
    heads = own.filter("first_of_turn and new_day").select("session_id", "turn", "seq", F.lit(0).alias("part"), F.concat(F.lit("*"), F.date_format("day", "EEEE, MMM d, yyyy"), F.lit("*\n")).alias("text"))
    thought = F.when(F.coalesce("reasoning", F.lit("")) != "", _folded_details(F.lit("Thinking"), escaped_outside_fences(F.col("reasoning"))))
    bodies = own.select("session_id", "turn", "seq", F.inline(F.array(part(1, thought), part(2, body)))).filter("text is not null")
    tools = own.select("session_id", "turn", "seq", F.posexplode(F.when(F.col("role") == "tool", F.array(tool_result(F.col("content")))).otherwise(call_lines(F.col("tool_calls")))).alias("n", "line"))
    return heads.unionByName(bodies).unionByName(_folded_tools(own, tools))


def tool_result(text: Column) -> Column:
    """A tool's result as one line."""
    return F.concat(F.lit("- 🔧 "), C.preview(F.translate(F.coalesce(text, F.lit("")), "`", ""), 96))


def _folded_tools(own: DataFrame, tools: DataFrame) -> DataFrame:
    """Tool lines (session_id, turn, seq, n, line): steps of messages that have nothing else are one block, equal lines in a row one line."""
    speaks = F.when(F.col("role") == "tool", F.lit(False)).otherwise(F.coalesce("content", F.lit("")) != "")
    steps = own.withColumn("step", F.sum(speaks.cast("int")).over(upto(in_order("session_id", "turn")))).select("session_id", "turn", "seq", "step")
    rows = tools.join(steps, ["session_id", "turn", "seq"])
    w = Window.partitionBy("session_id", "turn", "step").orderBy("seq", "n")
    rows = rows.withColumn("run", islands(F.lag("line").over(w) != F.col("line"), w))
    runs = rows.groupBy("session_id", "turn", "step", "run").agg(F.min(F.struct("seq", "n")).alias("at"), F.first("line").alias("line"), F.count("*").alias("times"))
    line = F.concat("line", F.when(F.col("times") > 1, F.concat(F.lit(" ×"), F.col("times").cast("string"))).otherwise(""))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n")
    blocks = runs.groupBy("session_id", "turn", "step").agg(F.min("at").alias("at"), F.concat(listed, F.lit("\n")).alias("text"))
    return blocks.select("session_id", "turn", F.col("at.seq").alias("seq"), F.lit(3).alias("part"), "text")


def markdown(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, text): a session as Markdown, one heading for each turn."""
    rows = turn_lines(messages).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn", "seq", "part", "text"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["text"]), "\n")
    head = F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("title", "id")), F.lit(""), F.concat(F.lit("- Tool: "), "tool"), F.concat(F.lit("- Project: "), F.coalesce("project", F.lit("Unassigned"))), F.concat(F.lit("- Messages: "), F.col("messages_count").cast("string")))
    return sessions.join(rows, F.col("id") == F.col("session_id")).select("id", F.concat(head, F.lit("\n\n"), body).alias("text"))
