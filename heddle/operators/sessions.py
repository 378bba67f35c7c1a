"""Per-session projections, noise rules, tool calls of messages, id resolution and evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import columns as C
from heddle.operators import ordered as O

# Other names of tools, and the tags that wrap injected context of one tool.
ALIASES = {"claude": "claude-code", "claude_code": "claude-code", "gemini": "gemini-cli", "copilot": "copilot-cli", "droid": "factory-droid"}
CONTEXT_TAGS = ("environment_context", "user_instructions", "user_action")
# Noise rules that a configuration can switch off.
NOISE_RULES = {"session_classify_injected_events": True, "session_collapse_file_operations": True, "session_strip_command_noise": True}
CREDENTIAL_FILES = r"(^|/)(\.env(\..+)?|id_[a-z0-9]+|\.netrc|\.pgpass|credentials(\.json)?|.*\.(pem|key|p12|pfx))$"


def tool_name(text: str) -> str:
    own = text.strip().lower().replace(" ", "-")
    return ALIASES.get(own, own)


def display_row(sessions: DataFrame) -> DataFrame:
    """A listing's columns: no tokens rather than zero, the label of the project, the shown title."""
    return sessions.select("id", "tool", C.project_label(F.coalesce("project", F.lit("")), 2).alias("label"), F.nullif(F.col("total_tokens"), F.lit(0)).alias("tokens"), C.display_title(F.col("title"), F.col("id")).alias("shown"))


def outline(messages: DataFrame, chars: int = 140) -> DataFrame:
    """(session_id, outline): the first user text that is no noise, cleaned."""
    text = C.clean_title(F.col("content"))
    own = messages.filter((F.col("role") == "user") & (F.col("kind") == "text")).withColumn("t", text).filter(~C.low_quality(F.col("t")))
    return own.groupBy("session_id").agg(C.capped(F.min_by("t", "seq"), chars).alias("outline"))


def noise_rules(configured: dict | None) -> dict[str, bool]:
    """The rules with a configuration's true and false in place of the defaults; anything else in it is passed over."""
    return {k: v if isinstance(v := (configured or {}).get(k), bool) else default for k, default in NOISE_RULES.items()}


def injected_display(text: Column, role: Column, tool: Column, rules: dict | None = None) -> Column:
    """kind (prompt, slash_prompt or event), label and title of text that a tool may have put into a transcript."""
    own = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))  # evaluated in each branch, so no pattern
    user = role == "user"
    shown = lambda kind, label="", title="": F.struct(F.lit(kind).alias("kind"), (F.lit(label) if isinstance(label, str) else label).alias("label"), (F.lit(title) if isinstance(title, str) else title).alias("title"))
    if not noise_rules(rules)["session_classify_injected_events"]:
        return shown("prompt")
    wrapped = lambda *tags: own.rlike(rf"(?is)^<({'|'.join(tags)})>.*</\1>$")
    inside = lambda tag: F.trim(F.regexp_extract(own, rf"(?is)<{tag}>\s*(.*?)\s*</{tag}>", 1))
    name, args = inside("command-name"), inside("command-args")
    only = ~F.regexp_replace(own, r"(?is)<command-(?:message|name|args)>.*?</command-(?:message|name|args)>", "").rlike(r"\S")
    skill = F.regexp_extract(own, r"(?i)^Base directory for this skill:\s*(\S+)", 1)
    header = own.rlike(r"(?i)^#\s*AGENTS\.md instructions\b")
    context = (tool == "codex") & role.isin("system", "user")
    agents = (header & F.lower(own).contains("<instructions>")) | (own.startswith("<!-- BEGIN AGENTS") & own.contains("<!-- END AGENTS"))
    return (
        F.when(own == "", shown("prompt"))
        .when(user & (name != "") & only, shown("slash_prompt", "", F.when(args != "", F.concat_ws(" ", name, args)).otherwise(name)))
        .when(user & (skill != ""), shown("event", F.concat(F.lit("Skill loaded: "), F.regexp_extract(skill, r"([^/]*)/*$", 1))))
        .when(user & own.rlike(r"(?i)^[a-z][\w-]* hook feedback:"), shown("event", "Hook feedback"))
        .when(user & (wrapped("task-notification") | own.rlike(r"(?i)^[0-9a-f]{6,}\s+toolu_[a-z0-9]+\b")), shown("event", "Task notification"))
        .when(wrapped("system-reminder"), shown("event", "System reminder"))
        .when(wrapped("local-command-caveat", "local-command-stdout"), shown("event", "Local command"))
        .when(context & wrapped(*CONTEXT_TAGS), shown("event", "System context"))
        .when(context & agents, shown("event", F.when(header, "AGENTS instructions").otherwise("System prompt")))
        .otherwise(shown("prompt"))
    )


def credential_file(path: Column) -> Column:
    return F.lower(path).rlike(CREDENTIAL_FILES)


def library_skip() -> Column:
    return F.coalesce(F.col("origin").isin("exec", "cron", "subagent"), F.lit(False)) | F.col("id").contains(":agent-") | F.col("parent_session_id").isNotNull()


def canonical_calls(calls: DataFrame, events: DataFrame) -> DataFrame:
    """Calls (session_id, seq, n, name) with the events (session_id, seq, n, name, status) of the same name and ordinal; events left over are calls of their own."""
    number = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy("session_id", "seq", "name").orderBy("n"))).drop("n")
    return number(calls).withColumn("called", F.lit(True)).join(number(events), ["session_id", "seq", "name", "k"], "full_outer").select("session_id", "seq", "name", "k", F.coalesce("called", F.lit(False)).alias("called"), "status")


def tool_steps(messages: DataFrame) -> DataFrame:
    """Runs of messages of one role group (tool or not) as steps: (session_id, step, tool, messages, first, last)."""
    w = O.in_order("session_id")
    own = messages.withColumn("tool", F.col("role").isin("tool", "system"))
    own = own.withColumn("step", O.islands(~F.col("tool").eqNullSafe(F.lag("tool").over(w)), w))
    return own.groupBy("session_id", "step", "tool").agg(F.count("*").alias("messages"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def turn_tokens(turns: DataFrame) -> DataFrame:
    """(session_id, turn, input, output, model) of messages with turn, tokens and model: sums, and the first model named."""
    tokens = lambda *keys: F.sum(sum((F.coalesce(F.col("tokens")[k], F.lit(0)) for k in keys), F.lit(0)))
    return turns.groupBy("session_id", "turn").agg(tokens("input", "input_tokens").alias("input"), tokens("output", "output_tokens").alias("output"), F.min_by("model", F.when(F.col("model").isNotNull(), F.col("seq"))).alias("model"))


def timeline(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages of all sessions of a thread in order of time: (thread_id, place, session_id, seq)."""
    own = messages.join(sessions.select(F.col("id").alias("session_id"), "thread_id"), "session_id")
    return own.select("thread_id", F.row_number().over(Window.partitionBy("thread_id").orderBy("timestamp", "session_id", "seq")).alias("place"), "session_id", "seq")


def resolve_ids(wanted: DataFrame, sessions: DataFrame) -> DataFrame:
    """(wanted, id, how): by id, by the id before a copy mark, by record id (originals first), by content."""
    s = sessions.select("id", "record_id", "content_sha256")
    by = {"id": F.col("id"), "base": F.regexp_replace("id", r"#\d+$", ""), "record": F.col("record_id"), "content": F.col("content_sha256")}
    rows = s.select("id", F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(k).alias("how"), v.alias("key")) for i, (k, v) in enumerate(by.items())))).alias("x")).filter("x.key is not null")
    best = rows.groupBy("x.key").agg(F.min(F.struct("x.rank", F.col("id").contains("#").alias("copy"), "id", "x.how")).alias("m"))
    return wanted.join(best, F.col("wanted") == F.col("key"), "left").select("wanted", F.col("m.id").alias("id"), F.col("m.how").alias("how"))


def recall_at(hits: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Mean share of relevant items (query, item) among the first k hits (query, item, rank)."""
    found = labels.join(hits.filter(F.col("rank") <= k).select("query", "item", F.lit(1).alias("hit")), ["query", "item"], "left")
    return found.groupBy("query").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall")).agg(F.avg("recall").alias("recall"), F.count("*").alias("queries"))


def near_deletion(files: DataFrame, now: str, keep_days: int, within: int) -> DataFrame:
    """How many files (path, modified) fall due within so many days."""
    age = F.date_diff(F.to_date(F.lit(now)), F.to_date("modified"))
    return files.agg(F.count_if((age >= keep_days - within) & (age < keep_days)).alias("due"), F.count("*").alias("files"))


def coverage(archived: DataFrame, live: DataFrame) -> DataFrame:
    """(session_id, archived, live, ratio): messages held against messages at the source."""
    a, b = (df.groupBy("session_id").agg(F.count_distinct("seq").alias(n)) for df, n in ((archived, "archived"), (live, "live")))
    return a.join(b, "session_id", "full_outer").select("session_id", F.coalesce("archived", F.lit(0)).alias("archived"), F.coalesce("live", F.lit(0)).alias("live"), F.bround(F.coalesce("archived", F.lit(0)) / F.coalesce("live", F.lit(1)), 4).alias("ratio"))


_ROW = "array<struct<kind: string, old: int, new: int, text: string>>"


def _aligned(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for olds, news in pairs:
        out = []
        for old, new in zip(olds, news, strict=True):
            a, b, rows = (old or "").splitlines(), (new or "").splitlines(), []
            for tag, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                if tag == "equal":
                    rows += [{"kind": "context", "old": x + 1, "new": x - i + k + 1, "text": a[x]} for x in range(i, j)]
                else:
                    rows += [{"kind": "del", "old": x + 1, "new": None, "text": a[x]} for x in range(i, j)]
                    rows += [{"kind": "add", "old": None, "new": x + 1, "text": b[x]} for x in range(k, m)]
            out.append(rows)
        yield pd.Series(out)


def text_diff(pairs: DataFrame, old: str, new: str, into: str = "rows", context: int = 3) -> DataFrame:
    """pairs with rows (kind, old, new, text) that turn one text into the other, line by line: context, del, add, and a gap in place of the inside of a long unchanged run.

    Lines are aligned by Python's SequenceMatcher in Arrow batches; runs are folded by columns. Null counts as empty.
    """
    ends = F.transform(F.col(into), lambda r, i: F.when(r["kind"] != "context", i))  # places that are no context

    def folded(r: Column, i: Column) -> Column:
        before = F.coalesce(F.array_max(F.filter(ends, lambda e: e < i)), F.lit(-1))
        after = F.coalesce(F.array_min(F.filter(ends, lambda e: e > i)), F.size(into))
        run, at = after - before - 1, i - before - 1
        gap = F.struct(F.lit("gap").alias("kind"), F.lit(None).cast("int").alias("old"), F.lit(None).cast("int").alias("new"), F.concat((run - 2 * context).cast("string"), F.lit(" unchanged lines")).alias("text"))
        hidden = (r["kind"] == "context") & (run > 2 * context + 1) & (at >= context) & (at < run - context)
        return F.when(~hidden, r).when(at == context, gap)

    aligned = pairs.withColumn(into, F.pandas_udf(_aligned, _ROW)(F.col(old), F.col(new)))
    return aligned.withColumn(into, F.filter(F.transform(into, folded), lambda r: r.isNotNull()))


def at_a_glance(sessions: DataFrame, messages: DataFrame, calls: DataFrame) -> DataFrame:
    """A session's card: first prompt, calls, failures, the six commonest tools, up to eight files in the order they were touched, and the duration.

    calls: session_id, seq, n, tool, path, status, is_error.
    """
    first = messages.filter("role = 'user'").groupBy("session_id").agg(F.min_by("content", "seq").alias("t")).select("session_id", C.capped(C.one_line(F.coalesce("t", F.lit(""))), 120).alias("first_prompt"))
    bad = F.lower("status").isin("failed", "error") | F.col("is_error")
    tools = calls.groupBy("session_id", F.coalesce("tool", F.lit("tool")).alias("tool")).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.min(F.struct("seq", "n")).alias("since"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "since", "tool")))
    tools = tools.groupBy("session_id").agg(F.sum("n").alias("tool_calls"), F.sum("bad").alias("failed_tool_calls"), F.transform(F.slice(order, 1, 6), lambda x: F.concat_ws("=", x["tool"], (-x["k"]).cast("string"))).alias("tools_used"))
    files = calls.filter(F.col("path") != "").groupBy("session_id", "path").agg(F.min(F.struct("seq", "n")).alias("since")).groupBy("session_id").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("since", "path"))), 1, 8), lambda x: x["path"]).alias("files_touched"))
    out = sessions.select(F.col("id").alias("session_id"), F.col("prompt_count").alias("prompts"), C.duration_label((F.unix_micros(F.col("updated").cast("timestamp")) - F.unix_micros(F.col("created").cast("timestamp"))) / 1e6).alias("duration"))
    for df in (first, tools, files):
        out = out.join(df, "session_id", "left")
    none = F.array().cast("array<string>")
    return out.select("session_id", F.coalesce("first_prompt", F.lit("")).alias("first_prompt"), "prompts", F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"), F.coalesce("failed_tool_calls", F.lit(0)).alias("failed_tool_calls"), F.coalesce("tools_used", none).alias("tools_used"), F.coalesce("files_touched", none).alias("files_touched"), "duration")


def normalised_calls(calls: DataFrame) -> DataFrame:
    """Tool calls as sources give them, under canonical names: tool (or name), input (or arguments), output, id, status, truncated; other columns stay."""
    have = calls.columns
    either = lambda default, *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names if n in have), F.lit(default))
    own = {"tool": either("tool", "tool", "name"), "input": F.coalesce(*(F.col(n) for n in ("input", "arguments") if n in have), F.lit("{}"))}
    own |= {c: F.col(c) if c in have else F.lit(None).cast("string") for c in ("id", "output", "status")}
    own["truncated"] = F.coalesce(F.col("truncated").cast("boolean"), F.lit(False)) if "truncated" in have else F.lit(False)
    return calls.select(*(c.alias(k) for k, c in own.items()), *(F.col(f"`{c}`") for c in have if c not in (*own, "name", "arguments")))


def message_counts(messages: DataFrame) -> DataFrame:
    """(session_id, messages, prompts, answers): prompts are user texts with something in them."""
    prompt = O.is_prompt() & F.col("content").rlike(r"\S")
    return messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.count_if(prompt).alias("prompts"), F.count_if(F.col("role") == "assistant").alias("answers"))


def body_text(messages: DataFrame, first: int | None = None, sep: str = "\n") -> DataFrame:
    """(session_id, text): the contents that aren't empty, in order; of the first so many messages where given."""
    own = messages.filter(F.col("content") != "") if first is None else messages.filter(F.col("seq") < first)
    return own.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), sep).alias("text"))


def search_text(sessions: DataFrame, messages: DataFrame, first: int = 30, chars: int = 20_000) -> DataFrame:
    """(id, search_text): title and first messages, lower-cased and cut."""
    own = body_text(messages, first, " ")
    return sessions.join(own, F.col("id") == F.col("session_id")).select("id", F.substring(F.lower(F.concat_ws(" ", "title", "text")), 1, chars).alias("search_text"))


def message_window(messages: DataFrame, session_id: str, limit: int, offset: int = 0, around: int | None = None) -> DataFrame:
    """Up to limit messages of a session, from an offset or with the message at seq around in the middle, by seq; only that session's rows are read."""
    own = messages.filter(F.col("session_id") == session_id).withColumn("place", F.row_number().over(O.in_order("session_id")) - 1)
    if around is not None:
        at = own.filter(F.col("seq") <= around).agg(F.greatest(F.lit(0), F.coalesce(F.max("place"), F.lit(0)) - limit // 2).alias("start"))
        own = own.join(F.broadcast(at), F.col("place") >= F.col("start")).filter(F.col("place") < F.col("start") + limit).drop("start")  # one row
    else:
        own = own.filter(F.col("place").between(offset, offset + limit - 1))
    return own.orderBy("place")


def thread_tools(sessions: DataFrame, most: int = 5) -> DataFrame:
    """(thread_id, tool, rank, id, title): the newest sessions of each tool of a thread."""
    rank = F.row_number().over(Window.partitionBy("thread_id", "tool").orderBy(F.desc(F.coalesce("updated", "created")), "id"))
    return sessions.withColumn("rank", rank).filter(F.col("rank") <= most).select("thread_id", "tool", "rank", "id", "title")


def message_identity(links: DataFrame, messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Links (session_id, seq) with what identifies their message elsewhere: record id and namespace of the session, the source's own id, a digest of the content."""
    m = messages.select("session_id", "seq", F.col("native_id") if "native_id" in messages.columns else F.lit(None).cast("string").alias("native_id"), F.sha2("content", 256).alias("sha256"))
    s = sessions.select(F.col("id").alias("session_id"), "source_record_id", "source_namespace")
    return links.join(m, ["session_id", "seq"]).join(s, "session_id")
