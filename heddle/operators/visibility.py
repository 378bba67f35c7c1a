"""What a listing hides, and the filters that run before any limit."""

from __future__ import annotations

import re
from datetime import datetime, time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.constants import AUTOMATED_ORIGINS, RETIRED_MARKERS


def visible(sessions: DataFrame, deleted: DataFrame | None = None, ignored: DataFrame | None = None, include_automated: bool = False) -> DataFrame:
    """Sessions without automated origins, tombstones and ignored ids; an unknown origin is not automated."""
    out = sessions if include_automated else sessions.filter(~F.coalesce(F.col("origin").isin(*AUTOMATED_ORIGINS), F.lit(False)))
    hidden = [h.select("id") for h in (deleted, ignored) if h is not None]
    if hidden:
        out = out.join(hidden[0] if len(hidden) == 1 else hidden[0].unionByName(hidden[1]), "id", "left_anti")
    return out


def parse_bound(text: str | None, end: bool = False) -> datetime | None:
    """A date or time bound; a date alone is the day's start, or its last microsecond as an end."""
    if not text:
        return None
    when = datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)
    return datetime.combine(when.date(), time.max) if end and len(text.strip()) == 10 else when


def within(col: Column, since: str | None, until: str | None) -> Column:
    """Whether a time is between two bounds, both inclusive; a bound that is not given does not limit."""
    out = F.lit(True)
    if since:
        out = out & (col >= F.lit(parse_bound(since).isoformat(" ")).cast("timestamp_ntz"))
    if until:
        out = out & (col <= F.lit(parse_bound(until, True).isoformat(" ")).cast("timestamp_ntz"))
    return out


def listed(sessions: DataFrame, tool: str | None = None, project: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Tool equality, case-sensitive project substring and creation window."""
    out = sessions if tool is None else sessions.filter(F.col("tool") == tool)
    if project:
        out = out.filter(F.col("project").contains(project))
    return out.filter(within(F.col("created"), since, until)) if since or until else out


def tagged(sessions: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    return sessions.join(tags.filter(F.lower("tag") == tag.lower()).select(F.col("session_id").alias("id")), "id", "left_semi")


def importable(chars: Column, min_prompts: int = 3, min_messages: int = 1, min_chars: int = 0) -> Column:
    """The import gate: enough prompts (automated origins pass), and enough messages or characters."""
    prompts = (F.col("prompt_count") >= min_prompts) | F.coalesce(F.col("origin").isin(*AUTOMATED_ORIGINS), F.lit(False))
    return prompts & ((F.col("messages_count") >= min_messages) | (chars >= min_chars))


def retired(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)\b(" + "|".join(RETIRED_MARKERS) + r")\b"), F.lit(False))


def path_tier(scope: Column, project: str | None, home: str = "/home/user") -> Column:
    """0 the project itself, 1 below it or above it, 2 no scope (global), null unrelated. What is above counts only if it is neither root nor home and has three names at least."""
    if project is None:
        return F.when(scope.isNull(), 2)
    names = F.size(F.filter(F.split(scope, "/"), lambda p: p != ""))
    above = F.lit(project).startswith(F.concat(F.regexp_replace(scope, "/+$", ""), F.lit("/"))) & (names >= 3) & (scope != home)
    return F.when(scope.isNull(), 2).when(scope == project, 0).when(scope.startswith(project.rstrip("/") + "/") | above, 1)


def low_value(prompts: Column, messages: Column, outline: Column, search_text: Column) -> Column:
    """Whether an index entry isn't worth listing: a prompt at most, or two in a very short session that says little; without counts it is."""
    n, m = F.coalesce(prompts, messages, F.lit(0)), F.coalesce(messages, F.lit(0))
    little = (F.length(F.trim(F.coalesce(outline, F.lit("")))) < 24) & (F.length(F.trim(F.coalesce(search_text, F.lit("")))) < 200)
    return ~(prompts.isNull() & messages.isNull()) & ((n <= 1) | ((n <= 2) & (m <= 3) & little))


def tagged_or_keyword(sessions: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """Sessions with a saved tag (case aside) or with that very keyword; sessions have a column keywords."""
    saved = tags.filter(F.lower("tag") == tag.strip().lower()).select(F.col("session_id").alias("id")).distinct().withColumn("_saved", F.lit(True))
    return sessions.join(saved, "id", "left").filter(F.col("_saved") | F.coalesce(F.array_contains("keywords", tag), F.lit(False))).drop("_saved")


def eligible(sessions: DataFrame, deleted: DataFrame, tool: str | None = None, limit: int | None = None) -> DataFrame:
    """Sessions that summaries and knowledge are drawn from: synced, neither automated nor deleted, newest first."""
    out = visible(sessions, deleted).filter(F.col("messages_synced"))
    out = (out if tool is None else out.filter(F.col("tool") == tool)).orderBy(*newest_first())
    return out if limit is None else out.limit(limit)


def idle_candidates(sessions: DataFrame, deleted: DataFrame, now: str, idle_minutes: int = 30, min_prompts: int = 3, tool: str | None = None, limit: int | None = None) -> DataFrame:
    """Eligible sessions with enough prompts that nothing was added to for so long."""
    idle = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {idle_minutes} minutes")
    out = eligible(sessions.filter((F.col("prompt_count") >= min_prompts) & (F.col("updated") <= idle)), deleted, tool)
    return out if limit is None else out.limit(limit)


def checked_id(text: str) -> str:
    """A session id that may stand in a path or a link; ValueError for any other."""
    if not re.fullmatch(r"[A-Za-z0-9._:@#-]{1,256}", text or "") or ".." in text:
        raise ValueError(f"no session id: {text!r}")
    return text


def checked_query(text: str | None, most: int = 500) -> str:
    """A search query without control characters, of bounded length; ValueError for a longer one."""
    own = "".join(c for c in text or "" if c.isprintable() or c in "\t\n").strip()
    if len(own) > most:
        raise ValueError(f"a query has {most} characters at most")
    return own


def whole_word(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands in text with no letter or digit beside it; case does not count."""
    return text.rlike(r"(?i)(?<![\p{L}\p{N}])(" + "|".join(words) + r")(?![\p{L}\p{N}])")


def page(df: DataFrame, order: list[Column], number: int = 1, per_page: int = 50) -> DataFrame:
    """One page of a total order; the size is held between 1 and 500."""
    per_page = max(1, min(500, per_page))
    return df.orderBy(*order).offset((max(1, number) - 1) * per_page).limit(per_page)


def newest_first() -> list[Column]:
    return [F.desc(F.coalesce("updated", "created")), F.asc("id")]


def recent_of(sessions: DataFrame, project: str, most: int = 3) -> DataFrame:
    """The newest sessions of exactly one project."""
    return page(sessions.filter(F.col("project") == project), newest_first(), 1, most)


def day_headers(shown: DataFrame) -> DataFrame:
    """A page of sessions in its order with day, and header where the day is another than the row's before."""
    day = F.to_date(F.coalesce("updated", "created"))
    w = Window.orderBy(*newest_first())  # a page has 500 rows at most
    return shown.withColumn("day", day).withColumn("header", F.coalesce(F.col("day") != F.lag("day").over(w), F.lit(True)))
