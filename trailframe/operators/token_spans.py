"""Loss masks from a real tokenizer: spans of rendered prefixes, and turns that are tokenized once and only appended."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.operators import masks

SPANS = "tokens array<int>, mask array<int>, prompt_length int, response_length int, error string"


class FileTokenizer:
    """Token ids by a tokenizer file, loaded once a Python worker; special tokens' strings in a text are ordinary text.

    `specials`: these strings stand for their own ids wherever a template writes them.
    """

    _loaded: dict = {}

    def __init__(self, path: str, specials: bool = False) -> None:
        self.path, self.specials = path, specials

    def _tokenizer(self):
        key = (self.path, self.specials)
        if key not in self._loaded:
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(self.path)
            made.encode_special_tokens = not self.specials
            self._loaded[key] = made
        return self._loaded[key]

    def __call__(self, text: str) -> list[int]:
        return self._tokenizer().encode(text, add_special_tokens=False).ids

    def many(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer().encode_batch(texts, add_special_tokens=False)]

    def id_of(self, token: str) -> int:
        found = self._tokenizer().token_to_id(token)
        if found is None:
            raise ValueError(f"no token {token!r} in {self.path}")
        return found


def spans_of(prefixes: list[list[int]], trained: list[bool], opener: list[int]) -> dict:
    """One row's spans from the ids of its ever longer prefixes, or the error of the first that is none of the next."""
    for k, (a, b) in enumerate(zip(prefixes, prefixes[1:])):
        if b[: len(a)] != a:
            return {"error": f"the tokens of prefix {k} change when text is appended"}
    mask: list[int] = []
    for a, b, on in zip(prefixes, prefixes[1:], trained[1:]):
        added = b[len(a) :]
        shut = len(opener) if on and opener and added[: len(opener)] == opener else 0
        mask += [0] * shut + [int(on)] * (len(added) - shut)
    first = len(prefixes[0]) if prefixes else 0
    return {"tokens": prefixes[-1] if prefixes else [], "mask": mask, "prompt_length": first, "response_length": len(mask)}


def prefix_spans(df: DataFrame, tokenizer: FileTokenizer, segments: str = "segments", opener: str = "", into: str = "spans") -> DataFrame:
    """`df` with a struct(tokens, mask, prompt_length, response_length, error) from its array of struct(text, trained).

    The first segment is the prompt. Every prefix of segments is tokenized as a whole, since a tokenizer may join what a
    boundary parts; what a trained segment adds is trained, `opener` at its beginning aside, the rest is not. If the ids of
    a prefix are not those that the next one begins with, `error` names it and the rest is null. Null segments give a null
    struct, null texts count as empty, no segments give no tokens. Tokenizing grows with the number of segments times their
    text, so it suits rows of a few turns; `turn_ids` with `masks.accumulated` takes each turn once. No shuffle.
    """
    schema = df.schema.simpleString()[len("struct<") : -1]
    kind = pa.struct([("tokens", pa.list_(pa.int32())), ("mask", pa.list_(pa.int32())), ("prompt_length", pa.int32()), ("response_length", pa.int32()), ("error", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = tokenizer(opener) if opener else []
        for b in batches:
            out = []
            for parts in b.column(b.schema.get_field_index(segments)).to_pylist():
                if parts is None:
                    out.append(None)
                    continue
                text, texts = "", []
                for p in parts:
                    text += p["text"] or ""
                    texts.append(text)
                out.append(spans_of(tokenizer.many(texts), [bool(p["trained"]) for p in parts], head))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], [*b.schema.names, into])

    return df.mapInArrow(run, f"{schema},{into} struct<{SPANS}>")


def turn_ids(turns: DataFrame, tokenizer: FileTokenizer, end: int, user: str = "<|im_start|>user\n{}<|im_end|>\n", role: str = "role", text: str = "text") -> DataFrame:
    """`turns` with the `ids` that an append-only accumulator adds: an assistant's text and the end id, others in their markup.

    Each turn is tokenized by itself, so the ids of earlier turns never change. Null texts count as empty.
    """
    before, after = user.split("{}")
    content = F.coalesce(F.col(text), F.lit(""))
    shown = F.when(F.col(role) == "assistant", content).otherwise(F.concat(F.lit(before), content, F.lit(after)))
    made = masks.tokenized(turns.withColumn("_shown", shown), "_shown", tokenizer)
    return made.drop("_shown").withColumn("ids", F.when(F.col(role) == "assistant", F.concat("ids", F.array(F.lit(end)))).otherwise(F.col("ids")))


def newline_id(tokenizer: FileTokenizer) -> int:
    """The one id of a line feed; an error if the tokenizer needs more."""
    found = tokenizer("\n")
    if len(found) != 1:
        raise ValueError(f"a line feed must be one token, not {json.dumps(found)}")
    return found[0]


def ids_crc32(ids: Column) -> Column:
    """crc32 of ids written in decimal with commas, null for null: a digest that shows whether two runs have the same ids."""
    return F.crc32(F.array_join(ids.cast("array<string>"), ","))
