"""Rule-based scoring of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions.text import strip
from trailframe.functions.url import alternatives
from trailframe.functions.words import word_tokens

#: What a number and a labelled pair of coordinates look like.
_NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)"
_MARKED = rf"(?i)\bcoordinates?\s*:\s*({_NUMBER})\s*,\s*({_NUMBER})"


def clean_answer(c: Column) -> Column:
    """Stripped, without one matching pair of quotes, in lower case."""
    s = strip(c)
    quoted = (F.startswith(s, F.lit("'")) & F.endswith(s, F.lit("'"))) | (F.startswith(s, F.lit('"')) & F.endswith(s, F.lit('"')))
    return F.lower(F.when(quoted, F.substring(s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0)))).otherwise(s))


def exact_match(reference: Column, predicted: Column) -> Column:
    return F.when(F.exists(alternatives(reference), lambda r: clean_answer(r) == clean_answer(predicted)), 1.0).otherwise(0.0)


def must_include(reference: Column, predicted: Column, tokenize: bool = False) -> Column:
    """An alternative is part of the answer; with `tokenize`, a one-character one must be one of its words."""
    pred = clean_answer(predicted)
    words = word_tokens(pred)

    def one(r: Column) -> Column:
        ref = clean_answer(r)
        found = F.contains(pred, ref)
        return F.when(F.length(ref) == 1, F.array_contains(words, ref)).otherwise(found) if tokenize else found

    return F.when(F.exists(alternatives(reference), one), 1.0).otherwise(0.0)


def coordinates(c: Column) -> Column:
    """struct(lat, lon): the labelled pair, which must be valid, or else the first two neighbouring numbers that are."""
    valid = lambda lat, lon: lat.between(-90, 90) & lon.between(-180, 180)
    pair = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    lat, lon = (F.regexp_extract(c, _MARKED, n).try_cast("double") for n in (1, 2))
    numbers = F.transform(F.regexp_extract_all(c, F.lit(f"({_NUMBER})"), F.lit(1)), lambda x: x.try_cast("double"))
    neighbours = F.transform(F.sequence(F.lit(0), F.greatest(F.size(numbers) - 2, F.lit(0))), lambda i: pair(F.get(numbers, i), F.get(numbers, i + 1)))
    first = F.get(F.filter(neighbours, lambda p: valid(p["lat"], p["lon"])), F.lit(0))
    return F.when(c.rlike(_MARKED), F.when(valid(lat, lon), pair(lat, lon))).otherwise(first)


def coordinate_match(reference: Column, predicted: Column, tolerance: float = 0.01) -> Column:
    a, b = coordinates(reference), coordinates(predicted)
    near = (F.abs(a["lat"] - b["lat"]) <= tolerance) & (F.abs(a["lon"] - b["lon"]) <= tolerance)
    return F.when(F.coalesce(near, F.lit(False)), 1.0).otherwise(0.0)


def product(scores: Column) -> Column:
    """Product of an array of scores; 1 if it is empty."""
    return F.aggregate(scores, F.lit(1.0), lambda a, b: a * b)


def string_score(answers: Column, predicted: Column) -> Column:
    """Product over map<approach, reference> of exact_match and must_include; an answer is cleaned twice."""
    pred = clean_answer(predicted)
    return product(F.transform(F.map_entries(answers), lambda e: F.when(e["key"] == "exact_match", exact_match(e["value"], pred)).when(e["key"] == "must_include", must_include(e["value"], pred, tokenize=True)).otherwise(F.raise_error(F.lit("approach needs a judge")).cast("double"))))


def fuzzy_verdict(answer: Column) -> Column:
    """1 where a judge's answer says correct; partly correct and incorrect ones fail, others are an error."""
    low = F.lower(answer)
    return F.when(F.contains(low, F.lit("partially correct")) | F.contains(low, F.lit("incorrect")), 0.0).when(F.contains(low, F.lit("correct")), 1.0).otherwise(F.raise_error(F.lit("no verdict")).cast("double"))


def same_verdict(answer: Column) -> Column:
    """1 where a judge's answer says same; different fails, others are an error."""
    low = F.lower(answer)
    return F.when(F.contains(low, F.lit("different")), 0.0).when(F.contains(low, F.lit("same")), 1.0).otherwise(F.raise_error(F.lit("no verdict")).cast("double"))


def judged(df: DataFrame, judge: Callable[[str, str], str], reference: str, predicted: str, into: str = "judgement") -> DataFrame:
    """`df` with the answers of an injected judge, asked row by row in Arrow batches; null where either side is."""
    schema = df.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (reference, predicted)), strict=True)
            told = [None if x is None or y is None else judge(x, y) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(told, pa.string())], [*b.schema.names, into])

    return df.mapInArrow(run, f"{schema},{into}:string")


def html_score(content: Column, required: Column, exact: Column | None = None) -> Column:
    """All required contents are in the page's text, whose references are decoded already; with `exact`, it is the text."""
    if exact is not None:
        return F.when(exact.isNotNull(), exact_match(exact, content)).otherwise(html_score(content, required))
    return product(F.transform(required, lambda r: must_include(r, content)))


def routed(eval_types: Column, scores: dict[str, Column]) -> Column:
    """Product of the named evaluators' scores; an unknown name is an error."""

    def one(t: Column) -> Column:
        out = None
        for name, score in scores.items():
            out = F.when(t == name, score) if out is None else out.when(t == name, score)
        return out.otherwise(F.raise_error(F.concat(F.lit("unknown evaluator "), t)).cast("double"))

    return product(F.transform(eval_types, one))


def eval_details(config: Column) -> Column:
    """Detail rows struct(type, detail) of an evaluation config: string approaches, page targets and the URL."""
    strings = F.transform(F.map_entries(config["reference_answers"]), lambda e: F.struct(F.lit("string_match").alias("type"), e["key"].alias("detail")))
    targets = F.transform(config["program_html"], lambda e: F.struct(F.lit("program_html").alias("type"), e["url"].alias("detail")))
    urls = F.array(F.struct(F.lit("url_match").alias("type"), config["reference_url"].alias("detail")))
    has = lambda t: F.array_contains(config["eval_types"], t)
    none = F.array().cast("array<struct<type:string,detail:string>>")
    return F.concat(*(F.when(F.coalesce(has(t), F.lit(False)), F.coalesce(x, none)).otherwise(none) for t, x in (("string_match", strings), ("program_html", targets), ("url_match", urls))))


def validated(action_is_stop: Column, infeasible: Column, allowed: Column, score: Column) -> Column:
    """struct(score, terminated): scored only after a stop; off the allowed hosts the run ends with 0."""
    return F.when(~allowed, F.struct(F.lit(0.0).alias("score"), F.lit(True).alias("terminated"))).when(action_is_stop | infeasible, F.struct(F.coalesce(score, F.lit(0.0)).alias("score"), F.lit(True).alias("terminated"))).otherwise(F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("terminated")))
