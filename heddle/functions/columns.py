"""Scalar functions and derived columns as Column expressions."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# What a title must not begin with or contain, and words that are no keywords.
LOW_PREFIXES = (
    "local-command-", "caveat: the messages below were generated", "user exited claude code session", "conversation started", "session ", "agents.md instructions", "instructions for /home",
    "command-name", "command-message", "command-args", "login successful", "invalid api key", "api error", "generate a file named agents.md", "base directory for this skill",
    "references are relative to", "skill name=", "shared workflow",
)
STOPWORDS = ("about", "after", "before", "could", "from", "have", "into", "should", "that", "their", "there", "these", "this", "what", "with", "would")
# What makes a title noise anywhere in it.
LOW_FRAGMENTS = ("on-request workspace-write", "workspace-write restricted", "sandbox", "approval")
# States of a tool call by the words that sources use, and the arguments that name what a call acts on.
TOOL_STATES = {
    "ok": ("ok", "success", "succeeded", "complete", "completed", "done"), "failed": ("failed", "fail", "error", "errored", "failure"), "pending": ("pending", "queued", "waiting"),
    "running": ("running", "in_progress", "started"), "cancelled": ("cancelled", "canceled", "aborted"), "unmatched": ("unmatched", "orphaned"),
}
TARGET_KEYS = ("command", "cmd", "file_path", "path", "notebook_path", "pattern", "url", "query", "description", "prompt")
# Parts of tool names by icon, and those of tools that change something.
TOOL_ICONS = (("⚡", "bash|shell|terminal"), ("📄", "read"), ("🛠", "write|edit"), ("🔎", "search|grep|glob"), ("🌐", "web|fetch|http"))
MAJOR_TOOLS = ("bash", "shell", "write", "edit", "apply_patch", "deploy", "commit", "delete", "migrate", "sql")
MEDIA_TYPES = {"json": "application/json", "jsonl": "application/x-ndjson", "md": "text/markdown", "txt": "text/plain", "html": "text/html", "db": "application/vnd.sqlite3", "sqlite": "application/vnd.sqlite3", "vscdb": "application/vnd.sqlite3"}


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_title(text: Column) -> Column:
    """Without tool results, fenced code, tags and backticks, on one line."""
    for pattern in (r"(?s)\[Tool Result\].*", r"(?s)```.*?```", r"<[^>]+>", "`"):
        text = F.regexp_replace(text, pattern, " ")
    return one_line(text)


def low_quality(text: Column) -> Column:
    """Whether a title says nothing: boilerplate, too short, or hardly any letters."""
    low = F.trim(F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"^<[^>]*>", ""))
    plain = F.regexp_replace(low, r"^[^a-z0-9]+", "")
    starts = F.lit(False)
    for p in LOW_PREFIXES:
        starts = starts | plain.startswith(p)
    for fragment in LOW_FRAGMENTS:
        starts = starts | plain.contains(fragment)
    # a skill's name and, behind it, the command that called it
    word, called = F.regexp_extract(low, r"^([\w-]+)\s+/\S+", 1), F.regexp_replace(F.regexp_extract(low, r"^[\w-]+\s+(/\S+)", 1), r"^/+|\.+$", "")
    starts = starts | ((word != "") & (word.startswith(called) | called.startswith(F.split(word, "-")[0])))
    letters = F.length(F.regexp_replace(low, r"[^\p{L}]", ""))
    return (low == "") | starts | (F.length(low) < 8) | (letters < F.greatest(F.lit(3), F.floor(F.length(low) / 6)))


def capped(text: Column, n: int, mark: str = "…") -> Column:
    """text of n characters at most, the mark included."""
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n - len(mark))), F.lit(mark))).otherwise(text)


def first_words(text: Column, words: int = 10, chars: int = 80) -> Column:
    own = F.array_join(F.slice(F.split(one_line(text), " "), 1, words), " ")
    return F.when(F.length(own) > chars, F.concat(F.substring(own, 1, chars - 3), F.lit("..."))).otherwise(own)


def inferred_title(title: Column, outline: Column, tool: Column, created: Column, id_: Column) -> Column:
    """The title, else the outline, else tool and day, the latter two with the id's end."""
    end = F.when(F.coalesce(id_, F.lit("")) == "", "session").otherwise(F.right(id_, F.lit(8)))
    native, brief = clean_title(title), F.substring(clean_title(outline), 1, 64)
    named = F.concat(F.initcap(F.regexp_replace(tool, "-", " ")), F.lit(" "), F.date_format(created, "yyyy-MM-dd"), F.lit(" • "), end)
    marked = F.when(brief.endswith(F.concat(F.lit("· "), end)), brief).otherwise(F.concat(brief, F.lit(" · "), end))
    return F.when(~low_quality(native), F.substring(native, 1, 80)).when(~low_quality(clean_title(outline)), marked).otherwise(named)


def display_title(title: Column, id_: Column) -> Column:
    """Blank titles become the id's start; titles that occur twice, case aside, get it behind them."""
    blank = F.trim(F.coalesce(title, F.lit(""))) == ""
    twice = F.count("*").over(Window.partitionBy(F.lower(F.trim(title)))) > 1
    return F.when(blank, F.left(id_, F.lit(12))).when(twice, F.concat(title, F.lit(" · "), F.left(id_, F.lit(8)))).otherwise(title)


def keywords(title: Column, text: Column) -> Column:
    """Sorted distinct words: of the title from 3 characters on, of the text from 4 on, without stop words, 100 at most."""
    words = F.array_union(F.regexp_extract_all(F.lower(title), F.lit(r"(?U)(\b\w{3,}\b)")), F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\b\w{4,}\b)")))
    return F.slice(F.array_sort(F.array_except(F.array_distinct(words), F.lit(list(STOPWORDS)))), 1, 100)


def project_label(path: Column, parts: int = 1) -> Column:
    own = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.array_join(F.slice(own, F.greatest(F.lit(1), F.size(own) - parts + 1), F.lit(parts)), "/")


def permalink(session: Column, seq: Column) -> Column:
    return F.concat(F.lit("/session/"), session, F.lit("/m/"), seq.cast("string"))


def compact_count(n: Column) -> Column:
    """Tokens as 999, 1.2k, 120k, 1.2M; nothing for no count."""

    def scaled(by: int, unit: str) -> Column:
        short = F.concat(F.regexp_replace(F.format_number(n / by, 1), r"\.0$", ""), F.lit(unit))  # format_string rounds 1.25 up, this as C and Python do
        return F.when(n >= 100 * by, F.concat(F.floor(n / by).cast("string"), F.lit(unit))).otherwise(short)

    return F.when(n.isNull() | (n < 0), "").when(n < 1000, n.cast("string")).when(n < 1_000_000, scaled(1000, "k")).otherwise(scaled(1_000_000, "M"))


def duration_label(seconds: Column) -> Column:
    """5s, 2m, 2m 5s, 1h, 1h 1m, 1d, 1d 1h; null for a negative duration."""
    s = F.floor(seconds).cast("long")

    def two(big: int, unit: str, small: int, rest: str) -> Column:
        left = F.floor(s % big / small)
        whole = F.concat(F.floor(s / big).cast("string"), F.lit(unit))
        return F.when(left > 0, F.concat(whole, F.lit(" "), left.cast("string"), F.lit(rest))).otherwise(whole)

    return F.when(s < 0, None).when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, two(60, "m", 1, "s")).when(s < 86400, two(3600, "h", 60, "m")).otherwise(two(86400, "d", 3600, "h"))


def relative_time(moment: Column, now: Column) -> Column:
    """just now, minutes and hours ago, Yesterday, a day of the last week, else the date."""
    s = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(moment.cast("timestamp"))) / 1_000_000).cast("long")
    days, minutes, hours = F.date_diff(F.to_date(now), F.to_date(moment)), F.floor(s / 60), F.floor(s / 3600)
    day = F.date_format(moment, "yyyy-MM-dd")
    return (
        F.when(s < 0, day).when(s < 60, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago"))).when(hours < 24, F.concat(hours.cast("string"), F.lit(" h ago")))
        .when(days == 1, "Yesterday").when(days < 7, F.date_format(moment, "MMM d")).otherwise(day)
    )


def day_label(day: Column, today: Column) -> Column:
    """A day's header: Today, Yesterday, a weekday of the last seven days, else the date, with the year if it is another."""
    ago = F.date_diff(today, day)
    same = F.year(day) == F.year(today)
    return F.when(ago == 0, "Today").when(ago == 1, "Yesterday").when(ago.between(2, 7), F.date_format(day, "EEEE, MMM d")).when(same, F.date_format(day, "MMM d")).otherwise(F.date_format(day, "MMM d, yyyy"))


def tool_state(status: Column, is_error: Column) -> Column:
    """One of the states by a source's word, case, hyphens and blanks aside; an error is failed whatever the word says."""
    own = F.translate(F.lower(F.regexp_replace(status, r"^\s+|\s+$", "")), "- ", "__")
    out = F.when(F.coalesce(is_error, F.lit(False)), "failed")
    for state, words in TOOL_STATES.items():
        out = out.when(own.isin(*words), state)
    return out.otherwise("unknown")


def preview(text: Column, most: int) -> Column:
    """One line of most characters at most, dots in place of what is cut."""
    own = one_line(text)
    return F.when(F.length(own) > most, F.concat(F.substring(own, 1, most - 3), F.lit("..."))).otherwise(own)


def tool_target(args: Column, most: int = 96) -> Column:
    """What a call acts on: the first telling text among the arguments, or of arguments that are no JSON object the first line that is no fence."""
    own = F.regexp_replace(args, r"^\s+|\s+$", "")
    parsed = F.try_parse_json(F.when(own.startswith("{"), own))
    texts = [F.when(F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant")) == "STRING", F.try_variant_get(parsed, f"$.{k}", "string")) for k in TARGET_KEYS]
    found = F.coalesce(*(F.when(t.rlike(r"\S"), t) for t in texts))
    line = F.element_at(F.filter(F.split(own, r"\r\n|\n|\r"), lambda x: x.rlike(r"\S") & ~x.rlike(r"^\s*(`{3,}|~{3,})[\w+-]*\s*$")), 1)
    return preview(F.coalesce(F.when(parsed.isNotNull(), F.coalesce(found, F.lit(""))), F.when(own != "", line), F.lit("")), most)


def tool_icon(name: Column) -> Column:
    out = None
    for icon, parts in TOOL_ICONS:
        hit = F.lower(name).rlike(parts)
        out = F.when(hit, icon) if out is None else out.when(hit, icon)
    return out.otherwise("🔧")


def tool_importance(name: Column) -> Column:
    return F.when(F.coalesce(F.lower(name).rlike("|".join(MAJOR_TOOLS)), F.lit(False)), "major").otherwise("minor")


def guessed_language(tool: Column, text: Column) -> Column:
    """The language of a call's text, by its form first and then by the tool's name."""
    name, low = F.lower(tool), F.lower(text)
    return (
        F.when(F.ltrim(text).startswith("*** Begin Patch") | text.contains("@@") | low.contains("diff --git"), "diff").when(name.rlike("bash|shell"), "bash")
        .when(name.contains("python") | low.contains("python"), "python").when(name.contains("json") | F.trim(low).startswith("{"), "json").when(low.contains("sql"), "sql").otherwise("plaintext")
    )


def media_type(path: Column) -> Column:
    """By the name's end; what is unknown is bytes."""
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))[end], F.lit("application/octet-stream"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def below(path: Column, folder: Column) -> Column:
    """Whether path is the folder or lies below it."""
    return (path == folder) | path.startswith(F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/")))


def marked_snippet(raw: Column) -> Column:
    """A snippet whose hits stand between the control characters 2 and 3: marks in the text itself become others, the control characters become marks."""
    return F.translate(F.translate(raw, "«»", "‹›"), "\x02\x03", "«»")


def elided_excerpt(excerpt: Column, body: Column) -> Column:
    """Whether an excerpt, marks and ellipses aside, is not the whole body."""
    plain = one_line(F.translate(F.translate(excerpt, "…", " "), "\x02\x03", ""))
    return (plain == "") | (plain != one_line(body))


def command_noise(text: Column) -> Column:
    """Whether every line with anything on it is command bookkeeping."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(r"(?i)^(\[command:[^\]]*\]|\[/?[a-z0-9_-]+\]|\(\s*\))$"))


def contents_noise(text: Column) -> Column:
    """Whether a prompt says nothing in a table of contents."""
    own = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return own.isin("", "prompt", "[tool result]", "tool result", "no files found", "ok", "done") | own.startswith("<local-command-")


def canonical_json(*fields: Column) -> Column:
    """Fields in the order of their names as one text in which nulls and text can't be mixed up; for digests."""
    return F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), f.cast("string")), F.lit("!")) for f in fields))


def local_naive(text: Column, zone: str) -> Column:
    """ISO times as wall-clock times: those with an offset as clocks of the zone show them, others as they are; null if it is none."""
    own = F.regexp_replace(text, "T", " ")
    aware = own.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    moment = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.try_to_timestamp(own).cast("timestamp_ntz"))
    return F.when(aware, moment).otherwise(own.try_cast("timestamp_ntz"))


def compact_events(events: Column, most: int) -> Column:
    """most events at most; a last one tells how many were dropped."""
    dropped = F.size(events) - most
    mark = F.array(F.struct(F.lit("…").alias("name"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("duration_ms"), F.lit(None).cast("boolean").alias("is_error"), dropped.alias("dropped")))
    return F.when(dropped > 0, F.concat(F.slice(events, 1, most), mark)).otherwise(events)


def elided(text: Column, most: int, head: int, tail: int) -> Column:
    """Head and tail of a long text, and how much is missing between."""
    gone = (F.length(text) - head - tail).cast("string")
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), F.lit("\n[+"), gone, F.lit(" chars elided]\n"), F.right(text, F.lit(tail)))).otherwise(text)


def first_sentence(text: Column) -> Column:
    own = F.regexp_extract(one_line(text), r"^(.*?[.!?])(?= \p{Lu}|$)", 1)
    return F.when(own == "", one_line(text)).otherwise(own)


def timestamp_of(text: Column) -> Column:
    """ISO times with blank or T, Z or offset, any fraction; seconds or milliseconds since 1970; else 1970."""
    number = F.try_to_number(F.regexp_extract(text, r"^(\d{1,16})(\.\d+)?$", 1), F.lit("9999999999999999")).cast("double")
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    iso = F.regexp_replace(F.regexp_replace(text, r"(\.\d{6})\d+", "$1"), "T", " ")
    return F.coalesce(F.timestamp_seconds(seconds), F.try_to_timestamp(iso), F.timestamp_seconds(F.lit(0)))


def parse_duration(text: str) -> timedelta:
    """Days, weeks, months of 30 days or hours: 7d, 2w, 1m, 12h."""
    m = re.fullmatch(r"\s*(\d+)\s*([dwmh])\s*", text.lower())
    if not m:
        raise ValueError(f"no duration: {text!r}")
    return int(m[1]) * {"d": timedelta(days=1), "w": timedelta(weeks=1), "m": timedelta(days=30), "h": timedelta(hours=1)}[m[2]]


def slug(text: Column, most: int = 60) -> Column:
    own = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
    return F.when(F.length(own) > most, F.concat(F.substring(own, 1, most - 9), F.lit("-"), F.substring(F.sha2(text, 256), 1, 8))).otherwise(own)


def masked_uuids(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "[uuid]")


def json_or_null(text: Column) -> Column:
    """text if it is JSON, else null."""
    return F.when(F.try_parse_json(text).isNotNull(), text)


def json_capped(text: Column, most: int) -> Column:
    """JSON text of most characters at most; of a longer one a stub that tells its length and digest."""
    stub = F.to_json(F.struct(F.lit(True).alias("truncated"), F.length(text).alias("chars"), F.sha2(text, 256).alias("sha256")))
    return F.when(F.length(text) > most, stub).otherwise(text)
