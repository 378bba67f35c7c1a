"""Operators over the messages of a session in order: turns, runs, ranges, budgets, caps and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_order(*keys: str, by: str = "seq") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(by)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def islands(change: Column, w: WindowSpec) -> Column:
    """Numbers the runs of rows between which change holds; the first row starts run 1."""
    return F.sum(F.coalesce(change, F.lit(True)).cast("int")).over(upto(w))


def is_prompt() -> Column:
    return (F.col("role") == "user") & (F.col("kind") == "text")


def with_turns(messages: DataFrame) -> DataFrame:
    """messages with turn: each user prompt starts the next turn; what stands before the first is turn 0."""
    return messages.withColumn("turn", F.sum(is_prompt().cast("int")).over(upto(in_order("session_id"))))


def turns(messages: DataFrame) -> DataFrame:
    """One row for each turn: span of seq, messages, characters, and whether its day differs from the turn's before."""
    own = with_turns(messages).groupBy("session_id", "turn").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("messages"), F.sum(F.length("content")).cast("long").alias("chars"), F.min("timestamp").alias("at")
    )
    before = F.lag(F.to_date("at")).over(in_order("session_id", by="turn"))
    return own.withColumn("new_day", F.coalesce(before != F.to_date("at"), F.lit(True))).drop("at")


def folded(rows: DataFrame, keys: list[str], same: list[str], by: str = "seq") -> DataFrame:
    """Runs of consecutive rows equal in the columns same, as one row each with times and first and last place."""
    w = in_order(*keys, by=by)
    changed = ~F.struct(*same).eqNullSafe(F.lag(F.struct(*same)).over(w))
    return rows.withColumn("run", islands(changed, w)).groupBy(*keys, "run", *same).agg(F.count("*").alias("times"), F.min(by).alias("first"), F.max(by).alias("last"))


def ranges(rows: DataFrame, keys: list[str], by: str = "seq") -> DataFrame:
    """Contiguous ranges of whole numbers; repeated ones count once."""
    own = rows.select(*keys, by).distinct()
    return own.withColumn("k", F.col(by) - F.row_number().over(in_order(*keys, by=by))).groupBy(*keys, "k").agg(F.min(by).alias("first"), F.max(by).alias("last")).drop("k")


def within_budget(rows: DataFrame, keys: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """The longest run of first rows whose costs sum to the budget at most; the first row always stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    own = rows.withColumns({"spent": F.sum(cost).over(upto(w)), "place": F.row_number().over(w)})
    return own.filter((F.col("spent") <= budget) | (F.col("place") == 1))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def capped(rows: DataFrame, group: str, order: list[Column], per_group: int, overall: int) -> DataFrame:
    """At most per_group rows of each group and overall rows of all, first ones first."""
    own = rows.withColumn("in_group", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("in_group") <= per_group)
    return own.orderBy(*order).limit(overall)


def numbered(rows: DataFrame, identity: list[str], order: list[Column], base: Column | None = None) -> DataFrame:
    """Revision numbers from 1, or from a base, within an identity."""
    n = F.row_number().over(Window.partitionBy(*identity).orderBy(*order))
    return rows.withColumn("revision", n if base is None else n + base)


def keep_best(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("place = 1").drop("place")


def budgeted_reasoning(messages: DataFrame, each: int, total: int) -> DataFrame:
    """reasoning cut to each characters a message and total a session, in order."""
    own = messages.withColumn("want", F.least(F.length("reasoning"), F.lit(each)))
    before = F.coalesce(F.sum("want").over(in_order("session_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(0), F.least(F.col("want"), F.lit(total) - before))
    return own.withColumn("reasoning", F.when(left > 0, F.substring("reasoning", F.lit(1), left.cast("int")))).drop("want")


def chunks(blocks: DataFrame, key: str, limit: int) -> DataFrame:
    """Greedy packing of a key's blocks (block, chars) in order into chunks of limit characters; a larger block stands alone.

    A fold over the sorted blocks of one key: a key's blocks must fit in a row.
    """
    listed = blocks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("block", F.col("chars").cast("long").alias("chars")))).alias("blocks"))
    zero = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("size"), F.array().cast("array<struct<block:int,chunk:int>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        new = (acc["chunk"] == 0) | (acc["size"] + b["chars"] > limit)
        chunk = F.when(new, acc["chunk"] + 1).otherwise(acc["chunk"])
        size = F.when(new, b["chars"]).otherwise(acc["size"] + b["chars"])
        return F.struct(chunk.alias("chunk"), size.alias("size"), F.concat(acc["out"], F.array(F.struct(b["block"].cast("int").alias("block"), chunk.alias("chunk")))).alias("out"))

    folded_ = F.aggregate("blocks", zero, step)["out"]
    return listed.select(key, F.explode(folded_).alias("x")).select(key, "x.block", "x.chunk")


def paired(calls: DataFrame, results: DataFrame, keys: list[str], by: str = "seq") -> DataFrame:
    """Calls with results: the n-th result of a key belongs to its n-th call; calls without one stay."""
    number = lambda df: df.withColumn("n", F.row_number().over(in_order(*keys, by=by)))
    return number(calls).join(number(results).select(*keys, "n", F.col(by).alias("result_at")), [*keys, "n"], "left")


#: Rows that a range of an order holds, about; ranges at most.
RANGE_ROWS, RANGES = 100_000, 4096


def _cuts(rows: DataFrame, by: str, parts: int | None) -> list:
    """Values of a number that cut its order into ranges of like size: as many as the rows ask for."""
    parts = max(1, min(RANGES, -(-rows.count() // RANGE_ROWS))) if parts is None else parts
    found = rows.agg(F.percentile_approx(by, [i / parts for i in range(1, parts)], 10 * parts).alias("c")).first()["c"] if parts > 1 else None
    return sorted(set(found or []))


def _range(by: str, cuts: list) -> Column:
    return F.size(F.filter(F.lit(cuts), lambda c: c < F.col(by))) if cuts else F.lit(0)


def with_sums_before(rows: DataFrame, by: str, columns: list[str], parts: int | None = None) -> DataFrame:
    """rows with, for each of the columns, its sum over all rows before them in the order of a number, as column_before.

    Quantiles of the number cut the order into ranges: sums of ranges, and running sums within a range, never all rows in
    one task. Rows with the same number have to be in one range, and are ordered within it as they come.
    """
    own = rows.withColumn("_part", _range(by, _cuts(rows, by, parts)))
    totals = own.groupBy("_part").agg(*(F.sum(c).alias(f"_{c}") for c in columns))  # as many rows as ranges
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns))
    within = Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    out = own.join(F.broadcast(totals), "_part")
    return out.withColumns({f"{c}_before": F.col(f"_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in columns}).drop("_part", *(f"_{c}" for c in columns))


def numbered_within(rows: DataFrame, key: str, by: str, tie: str, parts: int | None = None) -> DataFrame:
    """rows with number (from 1) within their key in the order of a whole number, the largest first, and of tie downwards, and with the key's total.

    A key's rows are numbered range by range of the number, so that a key that holds most rows is no single task.
    """
    own = rows.withColumn("_part", _range(by, _cuts(rows, by, parts)))
    counts = own.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy(F.desc("_part"))
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("_n").over(Window.partitionBy(key))})
    place = F.row_number().over(Window.partitionBy(key, "_part").orderBy(F.desc(by), F.desc(tie)))
    out = own.withColumn("_place", place).join(counts.drop("_n"), [key, "_part"])
    return out.withColumn("number", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")
