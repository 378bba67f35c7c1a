"""Exports: Markdown and HTML sessions, a linked library, hand-off text, JSON payloads, redacted copies and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import columns as C
from heddle.functions.redact import redacted
from heddle.operators.ordered import numbered_within

_HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def escaped(text: Column) -> Column:
    for a, b in _HTML:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def fenced(text: Column) -> Column:
    """text in a code fence longer than any it holds."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`{3,})")), lambda m: F.length(m)))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest + 1, F.lit(3))))
    return F.concat(fence, F.lit("\n"), text, F.lit("\n"), fence)


def _joined(rows: DataFrame, key: str, order: str, line: Column) -> DataFrame:
    own = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"]), "\n\n")
    return rows.groupBy(key).agg(own.alias("body"))


def html(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    line = F.concat(F.lit('<section class="'), "role", F.lit('"><h2>'), F.initcap("role"), F.lit("</h2><pre>"), escaped(F.col("content")), F.lit("</pre></section>"))
    body = _joined(messages, "session_id", "seq", line)
    return sessions.join(body, F.col("id") == F.col("session_id")).select("id", F.concat(F.lit("<!DOCTYPE html><title>"), escaped(F.coalesce("title", "id")), F.lit("</title>\n"), "body").alias("text"))


def write_texts(texts: DataFrame, path: str, by: str = "id") -> None:
    """One folder for each value of by, with its text."""
    texts.select("text", F.col(by).alias("_name")).write.partitionBy("_name").mode("overwrite").text(path)


def fingerprints(sessions: DataFrame) -> DataFrame:
    return sessions.select("id", F.sha2(F.concat_ws("\x1f", "id", "title", "project", F.col("updated").cast("string"), F.col("messages_count").cast("string")), 256).alias("fingerprint"))


def to_export(sessions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sessions that the manifest (id, fingerprint) lacks or has in another state."""
    return fingerprints(sessions).join(manifest.select("id", "fingerprint"), ["id", "fingerprint"], "left_anti").select("id").join(sessions, "id")


def library(sessions: DataFrame, per_page: int = 1000) -> DataFrame:
    """(page, text): an index of all pages, and pages by project and by day with links to sessions, newest first, automated children left out.

    A page has so many links at most; what is more goes to pages of the same name with a number, each linked from the one before.
    """
    own = sessions.filter((F.coalesce("origin", F.lit("")) != "subagent") & ~F.col("id").contains(":agent-"))
    link = F.concat(F.lit("- [["), "id", F.lit("|"), F.coalesce("title", "id"), F.lit("]]"))
    names = F.array(F.concat(F.lit("Projects/"), C.slug(F.coalesce("project", F.lit("Unassigned")))), F.concat(F.lit("Days/"), F.date_format("updated", "yyyy-MM-dd")))
    rows = own.select(F.explode(names).alias("name"), F.coalesce(F.unix_micros(F.col("updated").cast("timestamp")), F.lit(0)).alias("at"), "id", link.alias("link")).filter("name is not null")
    counts = rows.groupBy("name").agg(F.count("*").alias("n"))
    listed = counts.select(F.lit("Index").alias("name"), F.lit(0).cast("long").alias("at"), F.col("name").alias("id"), F.concat(F.lit("- [["), "name", F.lit("]] ("), F.col("n").cast("string"), F.lit(")")).alias("link"))
    return _paged(rows, per_page).unionByName(_paged(listed, per_page))


def _paged(rows: DataFrame, per_page: int) -> DataFrame:
    """(page, text) of rows (name, at, id, link)."""
    own = numbered_within(rows, "name", "at", "id").withColumn("sheet", F.floor((F.col("number") - 1) / per_page).cast("int"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "link"))), lambda x: x["link"]), "\n")
    pages = own.groupBy("name", "sheet", "total").agg(lines.alias("lines"))
    name = lambda n: F.when(n == 0, F.col("name")).otherwise(F.concat("name", F.lit(" ("), (n + 1).cast("string"), F.lit(")")))
    more = F.when(F.col("total") > (F.col("sheet") + 1) * per_page, F.concat(F.lit("\n\n[["), name(F.col("sheet") + 1), F.lit("|Next]]"))).otherwise("")
    return pages.select(name(F.col("sheet")).alias("page"), F.concat(F.lit("# "), name(F.col("sheet")), F.lit("\n\n"), "lines", more).alias("text"))


def page_changes(pages: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages that are new or differ, names of stored pages that are gone); stored: page, text."""
    digest = lambda df: df.select("page", F.sha2("text", 256).alias("sha"))
    new = digest(pages).join(digest(stored), ["page", "sha"], "left_anti").select("page")
    return pages.join(new, "page", "left_semi"), stored.select("page").join(pages.select("page"), "page", "left_anti")


def handoff(messages: DataFrame, last: int) -> DataFrame:
    """(session_id, body): the last messages of each session as plain text."""
    own = messages.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))).filter(F.col("r") <= last)
    return _joined(own, "session_id", "seq", F.concat(F.upper("role"), F.lit(": "), "content"))


def redacted_copy(messages: DataFrame) -> DataFrame:
    return messages.withColumn("_r", redacted(F.col("content"))).withColumns({"content": F.col("_r.text"), "redactions": F.col("_r.count")}).drop("_r")


def payload(sessions: DataFrame) -> DataFrame:
    """(id, json): a session's summary for an API."""
    cols = [c for c in ("id", "tool", "project", "title", "created", "updated", "messages_count", "prompt_count", "total_tokens", "origin") if c in sessions.columns]
    return sessions.select("id", F.to_json(F.struct(*cols)).alias("json"))


def checksum(df: DataFrame) -> Column:
    """An aggregate that is the same for the same rows in any order: sums of parts of their digests."""
    digest = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return F.concat_ws("-", *(part(k).cast("string") for k in range(3)))


def described(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n, checksum, fields) of tables."""
    out = None
    for name, df in tables.items():
        own = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), checksum(df).alias("checksum"), F.lit(df.schema.simpleString()).alias("fields"))
        out = own if out is None else out.unionByName(own)
    return out


def snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes tables below path, with a manifest (name, n, checksum, fields) of what can be read back, which is written last, and returns it."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    described({name: spark.read.parquet(f"{path}/{name}") for name in tables}).coalesce(1).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def opened(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of a snapshot by name, and its manifest; a folder without a manifest is no snapshot, and fails."""
    manifest = spark.read.parquet(f"{path}/manifest")
    return {r["name"]: spark.read.parquet(f"{path}/{r['name']}") for r in manifest.select("name").collect()}, manifest  # one row for each table


def json_store(rows: DataFrame, path: str, key: str) -> None:
    """Rows as JSON lines below path, in order of a key, in place of what was there."""
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").json(path)
