"""Loss masks over token ids; the tokenizer is any function from text to ids."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ones(n: Column) -> Column:
    return F.array_repeat(F.lit(1), n.cast("int"))


def zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0), n.cast("int"))


def opener_masked(ids: Column, opener: Column) -> Column:
    """Ones, but zeros over the opener if the ids start with it."""
    k = F.size(opener)
    return F.when(F.slice(ids, F.lit(1), k) == opener, F.concat(zeros(k), ones(F.size(ids) - k))).otherwise(ones(F.size(ids)))


def merged(*segments: tuple[Column, bool]) -> Column:
    """struct(tokens, mask) of (ids, trained) segments in order."""
    return F.struct(F.concat(*(ids for ids, _ in segments)).alias("tokens"), F.concat(*((ones if on else zeros)(F.size(ids)) for ids, on in segments)).alias("mask"))


def without_prefix(ids: Column, prefix: Column, what: str = "tokens") -> Column:
    """What follows `prefix`; an error where the ids do not begin with it."""
    rest = F.slice(ids, F.size(prefix) + 1, F.greatest(F.size(ids) - F.size(prefix), F.lit(0)))
    return F.when(F.slice(ids, F.lit(1), F.size(prefix)) == prefix, rest).otherwise(F.raise_error(F.lit(f"{what} do not begin with what was before them")).cast("array<int>"))


def spans(renders: Column, opener: Column) -> Column:
    """struct(tokens, mask, prompt, response_length) from the renders of ever longer prefixes of a conversation.

    `renders`: array of token ids after each prefix, a prompt and its completed answer in turn. What an answer adds is
    trained, its opener aside; what the next prompt inserts is not. The first prompt is no part of the response.
    """
    added = F.transform(F.sequence(F.lit(1), F.size(renders) - 1), lambda i: F.struct((i % 2 == 1).alias("on"), without_prefix(F.get(renders, i), F.get(renders, i - 1)).alias("ids")))
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.array().cast("array<int>").alias("mask"))
    both = F.aggregate(added, start, lambda a, x: F.struct(F.concat(a["ids"], x["ids"]).alias("ids"), F.concat(a["mask"], F.when(x["on"], opener_masked(x["ids"], opener)).otherwise(zeros(F.size(x["ids"])))).alias("mask")))
    return F.struct(F.concat(F.get(renders, F.lit(0)), both["ids"]).alias("tokens"), both["mask"].alias("mask"), F.get(renders, F.lit(0)).alias("prompt"), F.size(both["ids"]).alias("response_length"))


def merged_turns(action: Column, memory: Column) -> Column:
    """struct(tokens, mask, log_probs, segments) of an action and a memory turn, each struct(prompt, output, log_probs).

    The memory turn's prompt must begin with the whole action turn; what it adds to it is not trained.
    """
    inserted = without_prefix(memory["prompt"], F.concat(action["prompt"], action["output"]), "the memory prompt's tokens")
    tokens = F.concat(action["prompt"], action["output"], inserted, memory["output"])
    mask = F.concat(ones(F.size(action["output"])), zeros(F.size(inserted)), ones(F.size(memory["output"])))
    probs = F.concat(action["log_probs"], F.array_repeat(F.lit(0.0), F.size(inserted)), memory["log_probs"])
    return F.struct(tokens.alias("tokens"), mask.alias("mask"), probs.alias("log_probs"), segments(action["output"], inserted, memory["output"]).alias("segments"))


def segments(action: Column, inserted: Column, memory: Column) -> Column:
    """struct of the lengths of a step's three segments."""
    return F.struct(F.size(action).alias("action_output_len"), F.size(inserted).alias("inserted_compression_prompt_len"), F.size(memory).alias("memory_output_len"))


def single_output(turn: Column) -> Column:
    """struct(tokens, mask, log_probs) of one turn struct(prompt, output, log_probs): all of the output is trained."""
    return F.struct(F.concat(turn["prompt"], turn["output"]).alias("tokens"), ones(F.size(turn["output"])).alias("mask"), turn["log_probs"].alias("log_probs"))


def by_message(messages: Column) -> Column:
    """struct(tokens, mask) of messages struct(role, ids) one after the other: assistants' tokens are trained."""
    return appended(F.transform(messages, lambda m: F.struct(m["ids"].alias("ids"), (m["role"] == "assistant").alias("trained"))))


def accumulated(turns: Column, end: int, newline: int, opener: Column) -> Column:
    """struct(tokens, mask, error) of turns struct(role, ids) under the rules of an accumulator that only appends.

    The first turn's ids are the rendered prompt; an assistant's ids are appended as they were generated; after one that
    ends in `end` a `newline` comes before the next user's ids, and `opener`, the generation prompt, after them. A turn
    that is neither, or an assistant without a request before it, is an error and nothing more is appended.
    """
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("tokens"), none.alias("mask"), F.lit("").alias("last"), F.lit(None).cast("string").alias("error"))

    def step(a: Column, t: Column) -> Column:
        first = F.size(a["tokens"]) == 0
        gap = F.when(F.element_at(a["tokens"], -1) == end, F.array(F.lit(newline))).otherwise(none)
        user = F.when(first, t["ids"]).otherwise(F.concat(gap, t["ids"], opener))
        more = F.when(t["role"] == "assistant", t["ids"]).otherwise(user)
        error = F.when(~first & ~t["role"].isin("user", "assistant"), F.concat(F.lit("only user appends are supported, got "), t["role"])).when((t["role"] == "assistant") & (first | (a["last"] == "assistant")), F.lit("no request before the answer"))
        on = F.when(t["role"] == "assistant", ones(F.size(more))).otherwise(zeros(F.size(more)))
        grown = F.struct(F.concat(a["tokens"], more).alias("tokens"), F.concat(a["mask"], on).alias("mask"), t["role"].alias("last"), F.lit(None).cast("string").alias("error"))
        failed = F.struct(a["tokens"].alias("tokens"), a["mask"].alias("mask"), a["last"].alias("last"), error.alias("error"))
        return F.when(a["error"].isNotNull(), a).when(error.isNotNull(), failed).otherwise(grown)

    return F.aggregate(turns, start, step, lambda a: F.struct(a["tokens"].alias("tokens"), a["mask"].alias("mask"), a["error"].alias("error")))


def log_probs(output: Column, prompt: Column) -> Column:
    """Zeros over the prompt, then the output's."""
    return F.concat(F.array_repeat(F.lit(0.0), F.size(prompt)), output)


def mask_errors(tokens: Column, mask: Column, suffix: Column) -> Column:
    """What is wrong: lengths differ, nothing is trained, or the tokens do not end in `suffix`."""
    checks = [F.when(F.size(tokens) != F.size(mask), F.lit("length")), F.when(~F.array_contains(mask, 1), F.lit("no supervision")), F.when(F.slice(tokens, F.greatest(F.size(tokens) - F.size(suffix) + 1, F.lit(1)), F.size(suffix)) != suffix, F.lit("suffix"))]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def run_lengths(mask: Column) -> Column:
    """Runs of a mask as text, like 0x3,1x5."""
    start = F.struct(F.lit(-1).alias("v"), F.lit(0).alias("n"), F.lit("").alias("s"))
    told = lambda a: F.when(a["n"] == 0, a["s"]).otherwise(F.concat(a["s"], F.when(a["s"] != "", ",").otherwise(""), a["v"].cast("string"), F.lit("x"), a["n"].cast("string")))
    step = lambda a, x: F.when(a["v"] == x, F.struct(a["v"].alias("v"), (a["n"] + 1).alias("n"), a["s"].alias("s"))).otherwise(F.struct(x.alias("v"), F.lit(1).alias("n"), told(a).alias("s")))
    return F.aggregate(mask, start, step, told)


def tokenized(df: DataFrame, column: str, tokenize: Callable[[str], list[int]], into: str = "ids") -> DataFrame:
    """`df` with token ids by an injected tokenizer, in Arrow batches."""
    schema = df.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [None if x is None else tokenize(x) for x in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names, into])

    return df.mapInArrow(run, f"{schema},{into}:array<int>")


def appended(turns: Column) -> Column:
    """struct(tokens, mask) of ordered turns struct(ids, trained): the accumulator that only appends."""
    start = F.struct(F.array().cast("array<int>").alias("tokens"), F.array().cast("array<int>").alias("mask"))
    return F.aggregate(turns, start, lambda a, t: F.struct(F.concat(a["tokens"], t["ids"]).alias("tokens"), F.concat(a["mask"], F.array_repeat(F.when(t["trained"], 1).otherwise(0), F.size(t["ids"]))).alias("mask")))
