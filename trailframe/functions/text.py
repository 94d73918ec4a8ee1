"""Column functions over tagged model output."""

from __future__ import annotations

import html

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lint patterns and their warnings, in order.
LINT = (
    (r"(?im)^\s*(?:#+\s*)?(?:next steps?|next action|to-?do|remaining steps?)\s*:", "Candidate memory contains an explicit next-step or to-do heading."),
    (r"(?i)\b(?:currently|now)\s+(?:filling|clicking|opening|waiting|entering|selecting)\b", "Candidate memory may contain an in-progress action."),
    (r"(?i)\b(?:once|when)\s+[^.\n]{0,100}\b(?:loads?|appears?|opens?)\b", "Candidate memory may contain a waiting condition or future plan."),
    (r"(?i)\bbid\s*(?:=|:)?\s*\d+\b", "Candidate memory contains an ephemeral bid."),
    (r"(?i)\b(?:element|node)\s+(?:id\s*)?\[?\d+\]?\b", "Candidate memory may contain an ephemeral accessibility-tree ID."),
)
#: The violations that a judge may name.
VIOLATIONS = (
    "FUTURE_PLAN_IN_MEMORY", "PENDING_ACTION_IN_MEMORY", "LOSSY_COMPRESSION", "GOAL_RESTATEMENT", "SUPERSEDED_INFORMATION",
    "NON_CUMULATIVE_MEMORY", "UNSUPPORTED_ACTION_OUTCOME", "EPHEMERAL_DETAIL", "CURRENT_STATE_DETAIL_IN_MEMORY",
    "STALE_OR_DUPLICATED_CONTENT", "THINK_MEMORY_MISMATCH", "ACTION_REASONING_STYLE_MISMATCH", "TOO_VERBOSE",
)


def strip(c: Column) -> Column:
    """Without white space, Unicode's too, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blocks(c: Column, tag: str) -> Column:
    """Contents of all non-overlapping <tag> blocks."""
    return F.regexp_extract_all(c, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def last_tag(c: Column, tag: str) -> Column:
    """Stripped content of the last block; null without a block, "" for an empty one."""
    found = blocks(c, tag)
    return strip(F.get(found, F.size(found) - 1))


def action_prefix(c: Column) -> Column:
    """What stands before the last action block, stripped; without a block, the whole text, stripped."""
    found = F.regexp_extract_all(c, F.lit(r"(?s)(<action>.*?</action>)"), F.lit(1))
    # the tail after the last block has no block, so the block's place counts from the end
    tail = F.get(F.split(c, r"(?s)<action>.*?</action>", -1), F.size(found))
    size = F.length(c) - F.length(tail) - F.length(F.get(found, F.size(found) - 1))
    return F.when(F.size(found) == 0, strip(c)).otherwise(strip(F.substring(c, F.lit(1), size)))


def parse_action(c: Column) -> Column:
    """struct(prefix, action): an empty action is null, its block is cut all the same."""
    action = last_tag(c, "action")
    return F.struct(action_prefix(c).alias("prefix"), F.when(action != "", action).alias("action"))


def parse_memory(c: Column) -> Column:
    """struct(reasoning, memory, state), null unless all three blocks are there, in any order."""
    parts = [last_tag(c, t) for t in ("think", "memory", "state")]
    whole = F.struct(*(p.alias(n) for p, n in zip(parts, ("reasoning", "memory", "state"), strict=True)))
    return F.when(parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), whole)


def parse_errors(c: Column) -> Column:
    """Names of the blocks that are missing or, for actions, empty."""
    action = last_tag(c, "action")
    checks = [F.when(action.isNull() | (action == ""), F.lit("action")), *(F.when(last_tag(c, t).isNull(), F.lit(t)) for t in ("think", "memory", "state"))]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def _strict(*tags: str) -> str:
    return r"(?s)\A\s*" + r"\s*".join(f"<{t}>(.*?)</{t}>" for t in tags) + r"\s*\z"


def strict_blocks(c: Column, *tags: str) -> Column:
    """struct of the blocks, which must fill the text in this order and hold something each; else null."""
    pattern = _strict(*tags)
    parts = [strip(F.regexp_extract(c, pattern, n + 1)) for n in range(len(tags))]
    good = c.rlike(pattern)
    for p in parts:
        good = good & (p != "")
    return F.when(good, F.struct(*(p.alias(t) for p, t in zip(parts, tags, strict=True))))


def assemble(think: Column, memory: Column, state: Column) -> Column:
    """The tagged response of three fields, null if it would not parse strictly."""
    text = F.concat(F.lit("<think>"), think, F.lit("</think>\n<memory>"), memory, F.lit("</memory>\n<state>"), state, F.lit("</state>"))
    return F.when(strict_blocks(text, "think", "memory", "state").isNotNull(), text)


def restore_prefill(c: Column, tag: str) -> Column:
    """The prefilled opening tag again, if the first closing tag stands before any opening one."""
    first_open, first_close = F.instr(c, f"<{tag}>"), F.instr(c, f"</{tag}>")
    return F.when((first_close > 0) & ((first_open == 0) | (first_close < first_open)), F.concat(F.lit(f"<{tag}>\n"), F.regexp_replace(c, r"\A\n+", ""))).otherwise(c)


def action_or_noop(c: Column) -> Column:
    """The action, or noop() where there is none."""
    return F.coalesce(parse_action(c)["action"], F.lit("noop()"))


def format_reward(c: Column) -> Column:
    """Half for an action, half for reasoning before it."""
    parsed = parse_action(c)
    return F.when(parsed["action"].isNotNull(), 0.5).otherwise(0.0) + F.when(last_tag(parsed["prefix"], "think").isNotNull(), 0.5).otherwise(0.0)


def escape_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit("\\n"))


def truncate_chars(c: Column, most: int, suffix: str = "\n... (truncated)") -> Column:
    """At most `most` characters, and a suffix if any were cut."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(suffix))).otherwise(c)


def elide_middle(c: Column, most: int) -> Column:
    """Head of a quarter and tail of the rest, joined by "...", of texts longer than `most`."""
    head = most // 4
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(head)), F.lit("..."), F.right(c, F.lit(most - head)))).otherwise(c)


def lint_warnings(c: Column) -> Column:
    """Warnings in the order of the checks."""
    return F.filter(F.array(*(F.when(c.rlike(p), F.lit(w)) for p, w in LINT)), lambda x: x.isNotNull())


def judge_errors(c: Column) -> Column:
    """What is wrong with a judge's JSON decision; empty if it is sound."""
    d = F.from_json(c, "verdict string, violations array<string>, feedback string")
    keys, named = F.array_sort(F.json_object_keys(c)), F.coalesce(d["violations"], F.array().cast("array<string>"))
    checks = [
        F.when(keys.isNull(), F.lit("not an object")),
        F.when(keys != F.array(F.lit("feedback"), F.lit("verdict"), F.lit("violations")), F.lit("keys")),
        F.when(~F.coalesce(d["verdict"].isin("pass", "fail"), F.lit(False)), F.lit("verdict")),
        F.when(F.size(F.array_distinct(named)) < F.size(named), F.lit("duplicate")),
        F.when(F.size(F.array_except(named, F.array(*map(F.lit, VIOLATIONS)))) > 0, F.lit("unknown")),
        F.when((d["verdict"] == "pass") != (F.size(named) == 0), F.lit("verdict and violations")),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def flatten_parts(parts: Column) -> Column:
    """One string from content parts struct(type, text), newline between; null unless all parts are text."""
    return F.when(F.forall(parts, lambda p: p["type"] == "text"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n"))


def html_unescape(c: Column | str) -> Column:
    """Character references decoded, in Arrow batches; Spark has no such function."""

    @F.udf(T.StringType(), useArrow=True)
    def decode(x):
        return None if x is None else html.unescape(x)

    return decode(c)


def required(parsed: Column, what: str) -> Column:
    """`parsed`, or an error that names what is missing."""
    return F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.lit(f"no {what} in the response")).cast("string"))


def cached_last(parts: Column) -> Column:
    """Content parts struct(type, text) with `cached`, true for the last one alone."""
    return F.transform(parts, lambda p, i: F.struct(p["type"].alias("type"), p["text"].alias("text"), (i == F.size(parts) - 1).alias("cached")))
