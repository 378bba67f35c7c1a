"""Archive statistics, digests, costs, overviews and workflow metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.constants import FAILED_STATUSES, FAILURE_MARKERS, OK_STATUSES, PRIOR_VOTES, PRIOR_WEIGHT, SUCCESS_MARKERS
from heddle.operators.ordered import with_sums_before
from heddle.operators.visibility import whole_word, within


def archive_stats(sessions: DataFrame) -> DataFrame:
    """(part, key, n): totals, and counts by tool and by project (null and empty ones skipped), from one pass."""
    row = lambda part, key, n: F.struct(F.lit(part).alias("part"), key.alias("key"), n.cast("long").alias("n"))
    blank, one = F.lit(""), F.lit(1)
    parts = [row("sessions", blank, one), row("messages", blank, F.col("messages_count")), row("tool", F.coalesce("tool", blank), one), row("project", F.coalesce("project", blank), one)]
    rows = sessions.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    return rows.filter("part in ('sessions', 'messages') or key <> ''").groupBy("part", "key").agg(F.sum("n").alias("n"))


def in_window(sessions: DataFrame, since: str, until: str) -> DataFrame:
    return sessions.withColumn("at", F.coalesce("updated", "created")).filter(within(F.col("at"), since, until))


def digest_by(sessions: DataFrame, since: str, until: str, by: str) -> DataFrame:
    """Sessions, messages and prompts of a window by day, tool or project."""
    key = {"day": F.to_date("at").cast("string"), "tool": F.col("tool"), "project": F.coalesce("project", F.lit("Unassigned"))}[by]
    return in_window(sessions, since, until).groupBy(key.alias("key")).agg(F.count("*").alias("sessions"), F.sum("messages_count").alias("messages"), F.sum("prompt_count").alias("prompts"))


def digest_totals(sessions: DataFrame, since: str, until: str) -> DataFrame:
    """One row: totals and the busiest day (of days with as many sessions the first)."""
    days = digest_by(sessions, since, until, "day")
    return days.agg(
        F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"), F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"), F.coalesce(F.sum("prompts"), F.lit(0)).alias("prompts"),
        F.min(F.struct((-F.col("sessions")).alias("n"), "key"))["key"].alias("busiest_day"),
    )


def daily_series(sessions: DataFrame, first: str, last: str) -> DataFrame:
    """A row for each day between two dates, zeros included, with the share of the peak."""
    spark = sessions.sparkSession
    days = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}', interval 1 day)) AS day")  # as many rows as days
    counts = sessions.groupBy(F.to_date(F.coalesce("updated", "created")).alias("day")).agg(F.count("*").alias("n"))
    out = days.join(counts, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("sessions"))
    peak = F.greatest(F.max("sessions").over(Window.partitionBy()), F.lit(1))  # as many rows as days
    return out.select("day", "sessions", (F.col("sessions") / peak).alias("share"))


def token_costs(sessions: DataFrame) -> DataFrame:
    """(part, key, tokens, sessions): all origins; overall, with and without tokens, by tool and by project."""
    t = F.coalesce("total_tokens", F.lit(0)).cast("long")
    part = lambda name, key: F.struct(F.lit(name).alias("part"), key.alias("key"))
    keys = F.array(part("total", F.lit("")), part("has_tokens", F.when(t > 0, "yes").otherwise("no")), part("tool", F.coalesce("tool", F.lit(""))), part("project", F.coalesce("project", F.lit("Unassigned"))))
    return sessions.select(F.explode(keys).alias("x"), t.alias("t")).groupBy("x.part", "x.key").agg(F.sum("t").alias("tokens"), F.count("*").alias("sessions"))


def session_tokens(messages: DataFrame) -> DataFrame:
    """Tokens of a session: the last positive session_total, else the sum of the messages' own totals, else null."""
    tokens = F.coalesce(F.col("tokens"), F.create_map().cast("map<string,bigint>"))
    get = lambda *keys: sum((F.coalesce(tokens[k], F.lit(0)) for k in keys), F.lit(0))
    own = F.when(get("total") > 0, get("total")).otherwise(get("input", "output", "input_tokens", "output_tokens"))
    last = F.max_by(tokens["session_total"], F.when(tokens["session_total"] > 0, F.col("seq")))
    return messages.groupBy("session_id").agg(F.coalesce(last, F.nullif(F.sum(own), F.lit(0))).alias("total_tokens"))


def sessions_by_origin(sessions: DataFrame) -> DataFrame:
    """Observed counts; unknown origins count against coverage only."""
    known = (F.col("origin") != "unknown") & F.col("origin").isNotNull()
    total = Window.partitionBy()
    out = sessions.groupBy("origin").agg(F.count("*").alias("n"))
    out = out.withColumns({"covered": F.sum(F.when(known, F.col("n"))).over(total), "total": F.sum("n").over(total)})  # as many rows as origins
    return out.filter(known).select("origin", "n", F.bround(F.col("covered") / F.col("total"), 4).alias("coverage"))


def means_over_messages(messages: DataFrame) -> DataFrame:
    """Mean messages and prompts of sessions that have messages."""
    prompt = (F.col("role") == "user") & (F.col("kind") == "text") & F.col("content").rlike(r"\S")
    own = messages.groupBy("session_id").agg(F.count("*").alias("m"), F.count_if(prompt).alias("p"))
    return own.agg(F.bround(F.avg("m"), 4).alias("messages_per_session"), F.bround(F.avg("p"), 4).alias("prompts_per_session"), F.count("*").alias("sessions"))


def tool_outcome() -> Column:
    """failed, ok or null (not classified) of a tool event; an error flag wins."""
    status = F.lower(F.trim("status"))
    return F.when(F.coalesce("is_error", F.lit(False)), "failed").when(status.isin(*FAILED_STATUSES), "failed").when(status.isin(*OK_STATUSES), "ok")


def failure_rate(events: DataFrame) -> DataFrame:
    own = events.withColumn("outcome", tool_outcome())
    failed, known = F.count_if(F.col("outcome") == "failed"), F.count("outcome")
    return own.agg(failed.alias("failed"), known.alias("classified"), F.bround(failed / F.nullif(known, F.lit(0)), 4).alias("rate"), F.count_distinct(F.when(F.col("outcome").isNotNull(), F.col("session_id"))).alias("sessions"))


def median_duration(sessions: DataFrame) -> DataFrame:
    """Median seconds between creation and update; missing and inverted pairs don't count."""
    seconds = (F.unix_micros(F.col("updated").cast("timestamp")) - F.unix_micros(F.col("created").cast("timestamp"))) / 1e6
    return sessions.filter("updated >= created").agg(F.median(seconds).alias("median_seconds"), F.count("*").alias("sessions"))


def inferred_outcomes(messages: DataFrame) -> DataFrame:
    """Sessions by what the last non-blank assistant text suggests; both kinds of markers or none: unclassified."""
    last = messages.filter((F.col("role") == "assistant") & F.col("content").rlike(r"\S")).groupBy("session_id").agg(F.max_by("content", "seq").alias("text"))
    good, bad = whole_word(F.col("text"), SUCCESS_MARKERS), whole_word(F.col("text"), FAILURE_MARKERS)
    return last.groupBy(F.when(good & ~bad, "success").when(bad & ~good, "failure").otherwise("unclassified").alias("outcome")).agg(F.count("*").alias("n"))


def projects_overview(sessions: DataFrame, recent: int = 3) -> DataFrame:
    """By project: sessions, prompts (or messages), tools by count, last update, and the newest sessions."""
    own = sessions.withColumn("project", F.coalesce(F.nullif(F.col("project"), F.lit("")), F.lit("Unassigned"))).withColumn("at", F.coalesce("updated", "created"))
    totals = own.groupBy("project").agg(F.count("*").alias("sessions"), F.sum(F.coalesce(F.nullif(F.col("prompt_count"), F.lit(0)), "messages_count")).alias("prompts"), F.max("at").alias("last_updated"))
    tools = own.groupBy("project", "tool").agg(F.count("*").alias("n")).groupBy("project").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "tool"))), lambda x: F.concat(x["tool"], F.lit("="), (-x["k"]).cast("string"))), ",").alias("tools"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("at"), "id"))
    newest = own.withColumn("r", rank).filter(F.col("r") <= recent).groupBy("project").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]), ",").alias("recent"))
    return totals.join(tools, "project").join(newest, "project")


def threads_overview(sessions: DataFrame) -> DataFrame:
    own = sessions.withColumn("at", F.coalesce("updated", "created"))
    newest = F.max(F.struct("at", F.col("id").alias("id"), "title", "project"))
    return own.groupBy("thread_id").agg(F.count("*").alias("sessions"), newest.alias("x")).select("thread_id", "sessions", F.col("x.at").alias("latest"), F.col("x.title").alias("title"), F.col("x.project").alias("project"))


def feedback_weight(feedback: DataFrame) -> DataFrame:
    """Mean rating on a scale of 0 to 1, drawn towards the prior by PRIOR_VOTES votes; latest rating of a rater counts."""
    part = F.sum((F.col("score") - 1) / 4)
    return feedback.groupBy("memory_id").agg(((part + PRIOR_WEIGHT * PRIOR_VOTES) / (F.count("*") + PRIOR_VOTES)).alias("weight"), F.count("*").alias("votes"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count_distinct("session_id").alias("sessions"))


def tags_by_session(tags: DataFrame) -> DataFrame:
    return tags.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


def state_counts(rows: DataFrame, col: str, states: tuple[str, ...]) -> DataFrame:
    """Count of each state of a closed set, zeros included."""
    dim = rows.sparkSession.createDataFrame([(s,) for s in states], f"{col} string")
    return F.broadcast(dim).join(rows.groupBy(col).agg(F.count("*").alias("n")), col, "left").select(col, F.coalesce("n", F.lit(0)).alias("n"))


def job_progress(chunks: DataFrame) -> DataFrame:
    """By job: chunks, complete, failed and percent complete."""
    done = F.count_if(F.col("status") == "complete")
    return chunks.groupBy("job_id").agg(F.count("*").alias("chunks"), done.alias("complete"), F.count_if(F.col("status") == "failed").alias("failed"), F.bround(100 * done / F.count("*")).cast("int").alias("percent"))


def best_threshold(pairs: DataFrame) -> DataFrame:
    """The score from which 'related' is told from 'unrelated' with the best balanced accuracy; the least of equals.

    Candidates are the scores themselves; running counts over sorted scores replace comparing all pairs.
    """
    by = pairs.groupBy("score").agg(F.count_if(F.col("related")).alias("pos"), F.count_if(~F.col("related")).alias("neg"))
    total = by.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    by = with_sums_before(by, "score", ["pos", "neg"]).join(F.broadcast(total))  # one row
    acc = ((F.col("p") - F.col("pos_before")) / F.col("p") + F.col("neg_before") / F.col("n")) / 2
    return by.select("score", F.bround(acc, 6).alias("accuracy")).orderBy(F.desc("accuracy"), "score").limit(1)


def combined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sums of metrics (name, kind, value, covered, total) of two archives by name; those of different kinds can't be added, and fail."""
    keep = lambda df, p: df.select("name", *(F.col(c).alias(f"{p}_{c}") for c in ("kind", "value", "covered", "total")))
    out = keep(a, "a").join(keep(b, "b"), "name")
    kind = F.when(F.col("a_kind") == F.col("b_kind"), F.col("a_kind")).otherwise(F.raise_error(F.concat(F.lit("metrics of two kinds: "), "name")).cast("string"))
    covered = F.least("a_covered", "b_covered")
    ratio = F.when(F.col("a_total") > 0, F.bround(covered / F.col("a_total"), 4)).otherwise(0.0)
    return out.select("name", kind.alias("kind"), (F.col("a_value") + F.col("b_value")).alias("value"), covered.alias("covered"), F.col("a_total").alias("total"), ratio.alias("coverage"))


def basic_stats(sessions: DataFrame, now: str) -> DataFrame:
    """One row: totals, mean messages, first and last day, and how many are at most 7 and 30 days old."""
    moment = F.coalesce("updated", "created")
    recent = lambda days: F.count_if(moment >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))
    return sessions.agg(F.count("*").alias("sessions"), F.sum("messages_count").alias("messages"), F.bround(F.avg("messages_count"), 1).alias("mean_messages"), F.min(F.to_date("created")).alias("first_day"), F.max(F.to_date(moment)).alias("last_day"), recent(7).alias("last_week"), recent(30).alias("last_month"))


def commonest(sessions: DataFrame, by: str, most: int = 10) -> DataFrame:
    """(key, sessions) of the commonest values, by name where they are equally common."""
    return sessions.groupBy(F.coalesce(by, F.lit("Unassigned")).alias("key")).agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "key").limit(most)


def audit(indexed: DataFrame, live: DataFrame) -> DataFrame:
    """(tool, indexed, live): sessions of the index held against those at the sources."""
    a, b = indexed.groupBy("tool").agg(F.count("*").alias("a")), live.groupBy("tool").agg(F.count("*").alias("b"))
    return a.join(b, "tool", "full_outer").select("tool", F.coalesce("a", F.lit(0)).alias("indexed"), F.coalesce("b", F.lit(0)).alias("live"))


def top_tags(sessions: DataFrame, tags: DataFrame, most: int | None = 12, per_session: int = 30) -> DataFrame:
    """(tag, score): how many sessions have a keyword among their first ones, and for tags that users saved their sessions and one more."""
    words = sessions.select(F.explode(F.slice("keywords", 1, per_session)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    own = tags.groupBy("tag").agg((F.count_distinct("session_id") + 1).alias("n"))
    out = words.unionByName(own).groupBy("tag").agg(F.sum("n").alias("score")).orderBy(F.desc("score"), "tag")
    return out if most is None else out.limit(most)


def message_coverage(messages: DataFrame) -> DataFrame:
    """(session_id, n, first, last): how many messages a session has, and from where to where."""
    return messages.groupBy("session_id").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def token_series(sessions: DataFrame, first: str, last: str) -> DataFrame:
    """(day, tokens) for every day from first to last."""
    days = sessions.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    own = sessions.groupBy(F.to_date(F.coalesce("updated", "created")).alias("day")).agg(F.sum(F.coalesce("total_tokens", F.lit(0))).alias("tokens"))
    return days.join(own, "day", "left").select("day", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def index_summary(sessions: DataFrame, shown: DataFrame) -> DataFrame:
    """(part, key, n): how many sessions a listing shows and hides, and those shown by tool."""
    total = sessions.agg(F.count("*").alias("total"))
    one = shown.agg(F.count("*").alias("n"))
    hidden = one.join(F.broadcast(total)).select(F.lit("hidden").alias("part"), F.lit("").alias("key"), (F.col("total") - F.col("n")).alias("n"))  # one row each
    by_tool = shown.groupBy("tool").agg(F.count("*").alias("n")).select(F.lit("tool").alias("part"), F.col("tool").alias("key"), "n")
    return one.select(F.lit("shown").alias("part"), F.lit("").alias("key"), "n").unionAll(hidden).unionAll(by_tool)


def home(sessions: DataFrame) -> DataFrame:
    """(part, rank, key, id, title): the 6 newest sessions, the 12 projects last worked on with their newest title, and of the last 7 days the 3 newest sessions each."""
    own = sessions.withColumn("moment", F.coalesce("updated", "created"))
    newest = [F.desc("moment"), F.asc("id")]
    row = lambda part, key: (F.lit(part).alias("part"), "rank", key.alias("key"), "id", "title")
    page = Window.partitionBy(F.lit(0)).orderBy(*newest)  # of six and of twelve rows
    recent = own.orderBy(*newest).limit(6).withColumn("rank", F.row_number().over(page)).select(*row("recent", F.lit("")))
    projects = top_per_group(own.withColumn("key", F.coalesce("project", F.lit("Unassigned"))), ["key"], newest, 1).drop("rank").orderBy(*newest).limit(12)
    projects = projects.withColumn("rank", F.row_number().over(page)).select(*row("project", F.col("key")))
    own = own.withColumn("day", F.to_date("moment"))
    days = own.select("day").distinct().orderBy(F.desc("day")).limit(7)
    by_day = top_per_group(own.join(F.broadcast(days), "day", "left_semi"), ["day"], newest, 3).select(*row("day", F.col("day").cast("string")))
    return recent.unionByName(projects).unionByName(by_day)
