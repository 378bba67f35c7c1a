"""Message contents that are lists of typed blocks, read by rules of one form for all formats that keep them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import columns as C


@dataclass(frozen=True)
class Rule:
    """Blocks of one kind: what they are (text, thought, call, result), how they are told (a path, and its value or None for any), and where their fields are.

    Fields: of a text or thought its text; of a call id, name and input; of a result the call's id, the output and the error mark.
    """

    what: str
    path: str
    value: str | None
    fields: tuple[str, ...]


# Kinds and keys of blocks by family of formats.
ANTHROPIC = (
    Rule("text", "$.type", "text", ("$.text",)), Rule("thought", "$.type", "thinking", ("$.thinking",)), Rule("thought", "$.type", "reasoning", ("$.text",)),
    Rule("call", "$.type", "tool_use", ("$.id", "$.name", "$.input")), Rule("result", "$.type", "tool_result", ("$.tool_use_id", "$.content", "$.is_error")),
)
GOOSE = (
    Rule("text", "$.type", "text", ("$.text",)), Rule("thought", "$.type", "thinking", ("$.thinking",)), Rule("call", "$.type", "toolRequest", ("$.id", "$.toolCall.value.name", "$.toolCall.value.arguments")),
    Rule("result", "$.type", "toolResponse", ("$.id", "$.toolResult.value", "$.toolResult.status")),
)
CRUSH = (
    Rule("text", "$.type", "text", ("$.data.text",)), Rule("thought", "$.type", "reasoning", ("$.data.thinking",)), Rule("call", "$.type", "tool_call", ("$.data.id", "$.data.name", "$.data.input")),
    Rule("result", "$.type", "tool_result", ("$.data.tool_call_id", "$.data.content", "$.data.is_error")),
)
ZED = (Rule("text", "$.Text", None, ("$.Text",)), Rule("text", "$.Mention", None, ("$.Mention.content",)), Rule("thought", "$.Thinking", None, ("$.Thinking.text",)), Rule("call", "$.ToolUse", None, ("$.ToolUse.id", "$.ToolUse.name", "$.ToolUse.input")))
KIMI = (Rule("text", "$.type", "text", ("$.text",)), Rule("thought", "$.type", "think", ("$.think",)))
OPENCODE = (Rule("text", "$.type", "text", ("$.text",)), Rule("thought", "$.type", "reasoning", ("$.text",)), Rule("call", "$.type", "tool", ("$.callID", "$.tool", "$.state.input")), Rule("result", "$.type", "tool", ("$.callID", "$.state.output", "$.state.status")))
RESPONSE = (Rule("thought", "$.kind", "thinking", ("$.value",)), Rule("text", "$.value", None, ("$.value",)))


def items(raw: Column) -> Column:
    """The elements of a JSON array as JSON texts; null for anything else."""
    return F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>"))


def _holds(block: Column, rule: Rule) -> Column:
    found = F.get_json_object(block, rule.path)
    return F.coalesce(found == rule.value, F.lit(False)) if rule.value is not None else found.isNotNull()


def plain(output: Column) -> Column:
    """A result's output as text: of a list of text blocks their texts, else as it is."""
    texts = F.transform(items(output), lambda x: F.coalesce(F.get_json_object(x, "$.text"), x))
    return F.coalesce(F.array_join(texts, "\n"), output)


def flattened(rows: DataFrame, raw: str, rules: tuple[Rule, ...]) -> DataFrame:
    """rows with content, reasoning, calls and results of the column raw, which goes: plain text as it is, lists of blocks by the rules.

    In the content a call reads '[Tool: name] target' and a result '[Tool Result] output'; blocks that no rule knows are left out.
    """
    field = lambda b, rule, k: F.get_json_object(b, rule.fields[k])

    def said(block: Column) -> Column:
        out, first = None, None
        for rule in rules:
            if rule.what == "thought":
                text = F.lit(None).cast("string")
            elif rule.what == "text":
                text = field(block, rule, 0)
            elif rule.what == "call":
                text = F.concat(F.lit("[Tool: "), F.coalesce(field(block, rule, 1), F.lit("?")), F.lit("] "), F.coalesce(C.tool_target(field(block, rule, 2)), F.lit("")))
            else:
                text = F.concat(F.lit("[Tool Result] "), F.coalesce(plain(field(block, rule, 1)), F.lit("")))
            if rule.what == "result" and any(r.what == "call" and (r.path, r.value) == (rule.path, rule.value) for r in rules):
                first = (rule, text)  # one block is both call and result
                continue
            out = F.when(_holds(block, rule), text) if out is None else out.when(_holds(block, rule), text)
        if first is None:
            return out
        rule, text = first
        return F.when(_holds(block, rule) & field(block, rule, 1).isNotNull(), F.concat_ws("\n", out, text)).otherwise(out)

    failed = lambda b, rule: F.coalesce(F.lower(field(b, rule, 2)).isin("true", "error", "failed"), F.lit(False))
    call = lambda rule: lambda b: F.struct(field(b, rule, 0).alias("id"), field(b, rule, 1).alias("tool"), field(b, rule, 2).alias("input"))
    result = lambda rule: lambda b: F.struct(field(b, rule, 0).alias("id"), plain(field(b, rule, 1)).alias("output"), failed(b, rule).alias("is_error"))

    def collected(what: str, shape, kind: str) -> Column:
        parts = []
        for rule in rules:
            if rule.what == what:
                parts.append(F.transform(F.filter("_blocks", _test(rule)), shape(rule)))
        found = F.flatten(F.array(*parts)) if parts else F.array().cast(kind)
        return F.coalesce(F.filter(found, lambda x: x["id"].isNotNull()), F.array().cast(kind))

    thoughts = [_thoughts(rule) for rule in rules if rule.what == "thought"]
    reasoning = F.nullif(F.array_join(F.filter(F.flatten(F.array(*thoughts)), lambda t: t.isNotNull()), "\n"), F.lit("")) if thoughts else F.lit(None).cast("string")
    content = F.when(F.col("_blocks").isNull(), F.col(raw)).otherwise(F.array_join(F.filter(F.transform("_blocks", said), lambda t: t.isNotNull()), "\n"))
    out = rows.withColumn("_blocks", items(F.col(raw)))
    columns = {"content": content, "reasoning": reasoning, "calls": collected("call", call, "array<struct<id:string,tool:string,input:string>>"), "results": collected("result", result, "array<struct<id:string,output:string,is_error:boolean>>")}
    return out.select(*(F.col(c) for c in rows.columns if c != raw), *(v.alias(k) for k, v in columns.items()))


def _test(rule: Rule):
    return lambda b: _holds(b, rule)


def _thoughts(rule: Rule) -> Column:
    return F.transform(F.filter("_blocks", _test(rule)), lambda b: F.get_json_object(b, rule.fields[0]))
