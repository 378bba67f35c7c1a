"""Transcript analytics: artifacts, compression into blocks, rules, recommendations, citations and context text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.constants import RULE_CHARS, RULES, TOOL_RUN
from heddle.functions import columns as C
from heddle.operators import ordered as O

# Words that make a sentence a rule, and lengths to which parts of a transcript are cut (most, head, tail).
RULE_WORDS = ("must", "should", "avoid", "do not", "never", "always", "best practice", "recommend", "prefer")
CUTS = {"user": (3000, 2000, 1000), "assistant": (2000, 1400, 600), "tool": (600, 300, 200)}


def rules(messages: DataFrame, most: int | None = RULES) -> DataFrame:
    """(sentence, score, sessions): sentences of assistants that state rules, the best first, then those seen first; most: None is all of them."""
    parts = F.split("content", r"(?<=[.!?])\s+")
    rows = messages.filter("role = 'assistant'").select("session_id", "seq", F.posexplode(parts).alias("n", "sentence")).withColumn("sentence", F.trim("sentence"))
    low = F.lower("sentence")
    score = sum((low.contains(w).cast("int") for w in RULE_WORDS), F.lit(0))
    rows = rows.filter(F.length("sentence").between(*RULE_CHARS)).withColumn("score", score).filter("score > 0")
    own = rows.groupBy("sentence").agg(F.max("score").alias("score"), F.min(F.struct("session_id", "seq", "n")).alias("first"), F.count_distinct("session_id").alias("sessions"))
    own = own.orderBy(F.desc("score"), "first")
    return (own if most is None else own.limit(most)).select("sentence", "score", "sessions")


def recommendations(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rules with an id, the scope that their sessions share, and links to where they were said."""
    found = rules(messages)
    said = messages.filter("role = 'assistant'").select("session_id", "seq", F.explode(F.split("content", r"(?<=[.!?])\s+")).alias("sentence")).withColumn("sentence", F.trim("sentence"))
    said = said.join(F.broadcast(found.select("sentence")), "sentence")  # at most RULES sentences
    said = said.join(sessions.select(F.col("id").alias("session_id"), "project", "tool"), "session_id")
    own = said.groupBy("sentence").agg(F.count_distinct("project").alias("projects"), F.count_distinct("tool").alias("tools"), F.min("project").alias("project"), F.min("tool").alias("tool"), F.min(C.permalink(F.col("session_id"), F.col("seq"))).alias("evidence"))
    scope = F.when(F.col("projects") == 1, F.concat(F.lit("project:"), "project")).when(F.col("tools") == 1, F.concat(F.lit("tool:"), "tool")).otherwise("global")
    return found.join(own, "sentence").select(F.substring(F.sha2("sentence", 256), 1, 16).alias("id"), "sentence", "score", scope.alias("scope"), "evidence")


def artifacts(messages: DataFrame, most: int = 8) -> DataFrame:
    """By session: files read and changed, and commands, as named in tool lines; distinct, in order."""
    found = lambda pattern: F.regexp_extract_all("content", F.lit(pattern))
    own = messages.select("session_id", "seq", found(r"\[Tool: Read\] (\S+)").alias("read"), found(r"\[Tool: (?:Edit|Write|MultiEdit)\] (\S+)").alias("changed"), found(r"\[Tool: Bash\] ([^\n]+)").alias("commands"))
    cols = ("read", "changed", "commands")
    rows = own.select("session_id", "seq", F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("items")) for c in cols))).alias("x")).select("session_id", "seq", "x.what", F.posexplode("x.items").alias("n", "item"))
    first = rows.groupBy("session_id", "what", "item").agg(F.min(F.struct("seq", "n")).alias("at"))
    return first.withColumn("r", F.row_number().over(Window.partitionBy("session_id", "what").orderBy("at"))).filter(F.col("r") <= most).select("session_id", "what", "item", "r")


def stripped(text: Column) -> Column:
    """Without terminal escapes and wrapping tags."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\x1b\\[[0-9;?]*[A-Za-z]", ""), r"</?[a-z]+(?:-[a-z]+)+>", ""))


def compressed(messages: DataFrame) -> DataFrame:
    """Blocks of a session (session_id, block, first_seq, last_seq, chars, text): each user line opens one; long texts are
    cut in the middle and runs of more than TOOL_RUN tool lines become one line that counts them."""
    role = F.when(F.col("role").isin(*CUTS), F.col("role")).otherwise("tool")
    text = F.lit(None).cast("string")
    for name, (most, head, tail) in CUTS.items():
        text = F.when(role == name, C.elided(stripped(F.col("content")), most, head, tail)).otherwise(text)
    own = messages.select("session_id", "seq", role.alias("role"), text.alias("text"))
    w = O.in_order("session_id")
    own = own.withColumn("run", O.islands(~F.col("role").eqNullSafe(F.lag("role").over(w)), w))
    own = own.withColumn("size", F.count("*").over(Window.partitionBy("session_id", "run")))
    long_run = (F.col("role") == "tool") & (F.col("size") > TOOL_RUN)
    line = F.when(long_run, F.concat(F.lit("["), F.col("size").cast("string"), F.lit(" tool steps]"))).otherwise(F.concat("role", F.lit(": "), "text"))
    unit = F.when(long_run, F.concat(F.lit("r"), F.col("run").cast("string"))).otherwise(F.col("seq").cast("string"))
    rows = own.groupBy("session_id", unit.alias("unit")).agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.min_by(line, "seq").alias("line"), F.min_by("role", "seq").alias("role"))
    rows = rows.withColumn("block", F.sum((F.col("role") == "user").cast("int")).over(O.upto(O.in_order("session_id", by="first"))))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("session_id", "block").agg(F.min("first").alias("first_seq"), F.max("last").alias("last_seq"), joined.alias("text")).withColumn("chars", F.length("text"))


def sampled(chunks: DataFrame, most: int) -> DataFrame:
    """Chunks (session_id, chunk, users, chars) of sessions with too many: the first 2, the last 3, and those densest in prompts between."""
    w = Window.partitionBy("session_id")
    own = chunks.withColumns({"n": F.count("*").over(w), "a": F.row_number().over(w.orderBy("chunk")), "z": F.row_number().over(w.orderBy(F.desc("chunk")))})
    edge = (F.col("a") <= 2) | (F.col("z") <= 3)
    own = own.withColumn("r", F.row_number().over(Window.partitionBy("session_id", edge).orderBy(F.desc(F.col("users") / F.greatest("chars", F.lit(1))), "chunk")))
    return own.filter((F.col("n") <= most) | edge | (F.col("r") <= most - 5)).drop("n", "a", "z", "r")


def uncited(summaries: DataFrame, messages: DataFrame) -> DataFrame:
    """Summaries (id, session_id, cites) that cite places which their session doesn't have: (id, wrong)."""
    own = summaries.select("id", "session_id", F.explode("cites").alias("seq"))
    wrong = own.join(messages.select("session_id", "seq").distinct(), ["session_id", "seq"], "left_anti")
    return wrong.groupBy("id").agg(F.array_sort(F.collect_set("seq")).alias("wrong"))


#: Share of a context's budget that recent sessions may take, and tokens kept for the line that tells what was cut.
RECENT_SHARE, FOOTER = 4, 16
RECENT_HEADER = "Recently in this project:"


def _fitting(rows: DataFrame, cost: Column, budget: Column) -> DataFrame:
    """The first rows (by place) whose costs together stay within the budget; the first that doesn't fit ends it. Rows are a page: one task."""
    w = Window.partitionBy(F.lit(1)).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("spent", F.sum(cost).over(w)).withColumn("fits", F.col("spent") <= budget)
    return own.withColumn("fits", F.min("fits").over(w)).filter("fits").drop("fits")


def context(entries: DataFrame, recent: DataFrame, budget: int) -> DataFrame:
    """One row (text, json, entries, cut, recents): ranked entries (place, id, kind, title, body) and recent sessions (place, date, tool, title, summary) under one budget of tokens.

    Recents get a quarter at most, newest first. What they leave goes to the entries, of which the best fit, less a reserve
    for the line that tells how many were cut, where any are. What doesn't fit is left out whole. Both are pages: bounded by
    the limits with which the caller selects them.
    """
    cost = lambda c: F.length(c) + 1  # noqa: E731 - characters with the line end
    about = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(": "), "summary")).otherwise("")
    named = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(' "'), "title", F.lit('"'))).otherwise("")
    told = recent.withColumn("line", F.concat(F.lit("- "), "date", F.lit(" "), "tool", named, about))
    told = _fitting(told, cost(F.col("line")), F.lit(4 * (budget // RECENT_SHARE) - len(RECENT_HEADER)))
    kept = told.agg(F.array_sort(F.collect_list(F.struct("place", "line", "date", "tool", "title"))).alias("recents"))
    spent = F.aggregate("recents", F.lit(0), lambda s, r: s + F.length(r["line"]) + 1) + F.when(F.size("recents") > 0, len(RECENT_HEADER) + 1).otherwise(0)
    left = kept.select("recents", (F.lit(4 * budget) - spent).alias("left"))
    line = F.concat(F.lit("- ["), "kind", F.lit("] "), "title", F.lit(": "), C.first_sentence(F.col("body")))
    own = entries.withColumn("line", line).crossJoin(F.broadcast(left))  # left is one row
    whole = own.agg(F.sum(cost(F.col("line"))).alias("whole"), F.count("*").alias("n"))
    own = own.crossJoin(F.broadcast(whole))  # one row
    room = F.col("left") - F.when(F.col("whole") > F.col("left"), 4 * FOOTER).otherwise(0)
    own = _fitting(own, cost(F.col("line")), room)
    best = own.agg(F.array_sort(F.collect_list(F.struct("place", "line", "id", "kind", "title"))).alias("entries"))
    out = left.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(whole))  # one row each
    cut = F.col("n") - F.size("entries")
    foot = F.when(cut > 0, F.array(F.concat(F.lit("… and "), cut.cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    lines = lambda c: F.transform(c, lambda x: x["line"])
    first = F.array_join(F.concat(lines("entries"), foot), "\n")
    second = F.when(F.size("recents") > 0, F.concat(F.lit(RECENT_HEADER + "\n"), F.array_join(lines("recents"), "\n"))).otherwise("")
    text = F.array_join(F.filter(F.array(first, second), lambda x: x != ""), "\n\n")
    listed = F.transform("entries", lambda e: F.struct(e["id"].alias("id"), e["kind"].alias("kind"), e["title"].alias("title")))
    recents = F.transform("recents", lambda r: F.struct(r["date"].alias("date"), r["tool"].alias("tool"), r["title"].alias("title")))
    body = F.to_json(F.struct(listed.alias("entries"), cut.alias("cut"), recents.alias("recent_sessions")))
    return out.select(text.alias("text"), body.alias("json"), F.size("entries").alias("entries"), cut.alias("cut"), F.size("recents").alias("recents"))


def context_text(entries: DataFrame, budget: int) -> DataFrame:
    """Ranked entries (place, kind, title, body) as one text within a token budget."""
    line = F.concat(F.lit("- ["), "kind", F.lit("] "), "title", F.lit(": "), C.first_sentence(F.col("body")))
    own = entries.withColumn("line", line).withColumn("one", F.lit(1))
    fit = O.within_budget(own, ["one"], [F.asc("place")], O.estimated_tokens(F.col("line")), budget)
    return fit.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("text"), F.count("*").alias("entries"))
