"""Evaluation parts of task configurations, whose values are texts, lists or objects: read as JSON text, walked as Variant.

The JSON text is kept, since approaches are applied in the order in which a file names them and Variant sorts its keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailframe.functions.evaluate import clean_answer, exact_match, must_include, product

Judge = Callable[[Column, Column], Column]


def kind(value: Column) -> Column:
    """What a Variant is: string, list, object, null (also where there is none) or other."""
    told = F.schema_of_variant(value)
    return F.when(value.isNull() | (told == "VOID"), "null").when(told == "STRING", "string").when(F.startswith(told, F.lit("ARRAY")), "list").when(F.startswith(told, F.lit("OBJECT")), "object").otherwise("other")


def part(config: Column, path: str) -> Column:
    """A part of a configuration's JSON text as Variant; null if there is none or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(config), path, "variant")


def texts(value: Column, name: str) -> Column:
    """A list of texts; anything else is an error that names `name`."""
    wrong = F.raise_error(F.concat(F.lit(f"{name} needs a list of texts, not "), F.coalesce(F.to_json(value), F.lit("null"))))
    fine = (kind(value) == "list") & ~F.exists(F.try_variant_get(value, "$", "array<variant>"), lambda x: kind(x) != "string")
    return F.when(F.coalesce(fine, F.lit(False)), F.try_variant_get(value, "$", "array<string>")).otherwise(wrong.cast("array<string>"))


def text_of(value: Column, name: str) -> Column:
    """A text; anything else is an error that names `name`."""
    wrong = F.raise_error(F.concat(F.lit(f"{name} needs a text, not "), F.coalesce(F.to_json(value), F.lit("null"))))
    return F.when(kind(value) == "string", F.try_variant_get(value, "$", "string")).otherwise(wrong.cast("string"))


def approaches(config: Column) -> Column:
    """array<struct(approach, value)> of reference_answers, in the file's order; empty if they are no object."""
    answers = part(config, "$.reference_answers")
    names = F.json_object_keys(F.get_json_object(config, "$.reference_answers"))
    held = F.try_variant_get(answers, "$", "map<string,variant>")
    some = F.transform(names, lambda n: F.struct(n.alias("approach"), F.element_at(held, n).alias("value")))
    return F.when(kind(answers) == "object", some).otherwise(F.array().cast("array<struct<approach:string,value:variant>>"))


def _no_judge(what: Column, reference: Column) -> Column:
    return F.raise_error(F.concat(what, F.lit(" needs a judge: "), reference)).cast("double")


def string_score(config: Column, answer: Column, judge: Judge = _no_judge) -> Column:
    """Product of the approaches of reference_answers over an answer (a null one is empty); approaches without a rule count as 1.

    exact_match takes a text; must_include a list, each of which must be in the answer, where a single entry of one character must
    be one of its words. fuzzy_match takes a list, which `judge` ("fuzzy", reference) decides one by one, or "N/A": an answer that is
    not just that, or follows a failed approach, is decided by `judge` ("unachievable", string_note) alone. Other kinds of values are errors.
    """
    pred = clean_answer(F.coalesce(answer, F.lit("")))
    note = F.coalesce(F.try_variant_get(F.try_parse_json(config), "$.string_note", "string"), F.lit(""))

    def included(value: Column) -> Column:
        wanted = texts(value, "must_include")
        return F.when(F.size(wanted) == 1, must_include(F.get(wanted, F.lit(0)), pred, tokenize=True)).otherwise(product(F.transform(wanted, lambda r: must_include(r, pred))))

    def step(score: Column, x: Column) -> Column:
        name, value = x["approach"], x["value"]
        infeasible = (kind(value) == "string") & (F.try_variant_get(value, "$", "string") == "N/A")
        plain = score * exact_match(F.lit("N/A"), pred)
        unsure = F.when(plain == 1.0, plain).otherwise(judge(F.lit("unachievable"), note))
        fuzzy = score * product(F.transform(texts(value, "fuzzy_match"), lambda r: judge(F.lit("fuzzy"), r)))
        return F.when(name == "exact_match", score * exact_match(text_of(value, "exact_match"), pred)).when(name == "must_include", score * included(value)).when((name == "fuzzy_match") & infeasible, unsure).when(name == "fuzzy_match", fuzzy).otherwise(score)

    return F.aggregate(approaches(config), F.lit(1.0), step)


def questions(config: Column, answer: Column) -> Column:
    """array<struct(what, reference)>: what string_score may ask a judge about an answer, each once."""
    asked = F.transform(F.filter(approaches(config), lambda x: x["approach"] == "fuzzy_match"), lambda x: F.when(kind(x["value"]) == "list", F.transform(F.try_variant_get(x["value"], "$", "array<string>"), lambda r: F.struct(F.lit("fuzzy").alias("what"), r.alias("reference")))).otherwise(F.array(F.struct(F.lit("unachievable").alias("what"), F.coalesce(F.try_variant_get(F.try_parse_json(config), "$.string_note", "string"), F.lit("")).alias("reference")))))
    return F.when(answer.isNotNull(), F.array_distinct(F.flatten(asked))).otherwise(F.array().cast("array<struct<what:string,reference:string>>"))


def targets(config: Column) -> Column:
    """array<struct(url, locator, required, actions)> of program_html: where to look and the JSON text of what must be there."""
    held = F.try_variant_get(part(config, "$.program_html"), "$", "array<variant>")
    get = lambda t, name: F.try_variant_get(t, f"$.{name}", "string")
    actions = lambda t: F.coalesce(F.try_variant_get(t, "$.prep_actions", "array<string>"), F.array().cast("array<string>"))
    one = lambda t: F.struct(get(t, "url").alias("url"), F.coalesce(get(t, "locator"), F.lit("")).alias("locator"), F.to_json(F.try_variant_get(t, "$.required_contents", "variant")).alias("required"), actions(t).alias("actions"))
    return F.coalesce(F.transform(held, one), F.array().cast("array<struct<url:string,locator:string,required:string,actions:array<string>>>"))


def contents_score(required: Column, content: Column) -> Column:
    """1 if a page's selected text (a null one is empty) is the exact_match of required contents, else if it holds each of must_include; any
    of an entry's alternatives will do. Without either it is an error."""
    content = F.coalesce(content, F.lit(""))
    wanted = F.try_parse_json(required)
    exact, listed = (F.try_variant_get(wanted, f"$.{n}", "variant") for n in ("exact_match", "must_include"))
    names = F.coalesce(F.json_object_keys(required), F.array().cast("array<string>"))
    unknown = F.raise_error(F.concat(F.lit("unknown required contents: "), F.coalesce(required, F.lit("null")))).cast("double")
    some = product(F.transform(texts(listed, "must_include"), lambda r: must_include(r, content)))
    return F.when(F.array_contains(names, "exact_match"), exact_match(text_of(exact, "exact_match"), content)).when(F.array_contains(names, "must_include"), some).otherwise(unknown)


DETAIL = "array<struct<eval_type:string,match_method:string,reference_ans:string,eval_program:string,reference_url:string,url_note:string,eval_info:string>>"


def details(config: Column) -> Column:
    """Rows that tell an evaluation, values as JSON text: one for each approach, page target and URL that its eval_types name.

    eval_types may be one text. Answers or programs that are no object or list give one row with the value as it is; an evaluation
    that is no object gives one row with eval_info (a reader of JSON gives a text without its quotes). A null or empty one gives none.
    """
    names = ("eval_type", "match_method", "reference_ans", "eval_program", "reference_url", "url_note", "eval_info")
    row = lambda **held: F.struct(*(held.get(n, F.lit(None).cast("string")).alias(n) for n in names))
    whole = F.try_parse_json(config)
    kinds = part(config, "$.eval_types")
    listed = F.when(kind(kinds) == "string", F.array(F.try_variant_get(kinds, "$", "string"))).otherwise(F.coalesce(F.try_variant_get(kinds, "$", "array<string>"), F.array().cast("array<string>")))
    has = lambda name: F.array_contains(listed, name)
    none = F.array().cast(DETAIL)
    answers, programs = part(config, "$.reference_answers"), part(config, "$.program_html")
    strings = F.when(kind(answers) == "object", F.transform(approaches(config), lambda x: row(eval_type=F.lit("string_match"), match_method=x["approach"], reference_ans=F.to_json(x["value"])))).otherwise(F.array(row(eval_type=F.lit("string_match"), reference_ans=F.to_json(answers))))
    pages = F.when(kind(programs) == "list", F.transform(F.try_variant_get(programs, "$", "array<variant>"), lambda t: row(eval_type=F.lit("program_html"), eval_program=F.to_json(t)))).otherwise(F.array(row(eval_type=F.lit("program_html"), eval_program=F.to_json(programs))))
    get = lambda name: F.try_variant_get(whole, f"$.{name}", "string")
    urls = F.array(row(eval_type=F.lit("url_match"), reference_url=get("reference_url"), url_note=get("url_note")))
    each = F.concat(*(F.when(has(n), x).otherwise(none) for n, x in (("string_match", strings), ("program_html", pages), ("url_match", urls))))
    empty = F.coalesce(F.trim(config), F.lit("")).isin("", "null")
    return F.when(kind(whole) == "object", each).when(empty, none).otherwise(F.array(row(eval_info=F.coalesce(F.to_json(whole), config)))).cast(DETAIL)
