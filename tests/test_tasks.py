"""Task configurations, word tokens, static locators and rollout groups against values worked out by hand and plain walks."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from trailframe.functions import evaluate, locate, task_config, words
from trailframe.operators import rewards
from trailframe.sources import trajectories as sources

SF = "/root/testdata/sf0.001"


def scores(spark, rows, judge=None):
    """string_score of (config, answer) rows."""
    frame = spark.createDataFrame([(n, c if c is None or isinstance(c, str) else json.dumps(c), a) for n, (c, a) in enumerate(rows)], "n int, c string, a string")
    more = {"judge": judge} if judge else {}
    return [r[0] for r in frame.orderBy("n").select(task_config.string_score(F.col("c"), F.col("a"), **more)).collect()]


def answers(**approaches):
    return {"eval_types": ["string_match"], "reference_answers": approaches, "string_note": "because"}


def test_lists_of_answers(spark):
    rows = [
        (answers(must_include=["alpha", "beta"]), "alpha and beta", 1.0),
        (answers(must_include=["alpha", "beta"]), "alpha", 0.0),
        (answers(must_include=["alpha |OR| gamma"]), "Gamma!", 1.0),
        (answers(must_include=["5"]), "it is 3.5", 0.0),
        (answers(must_include=["5"]), "it is 5.", 1.0),
        (answers(must_include=["5", "3"]), "it is 3.5", 1.0),  # more than one entry: characters, not words
        (answers(must_include=["$"]), "costs $5", 1.0),
        (answers(must_include=["é"]), "un é là", 1.0),
        (answers(must_include=[]), "x", 1.0),
        (answers(exact_match="A |OR| 'b'"), '"B"', 1.0),
        (answers(exact_match="a", must_include=["z"]), "a", 0.0),
        (answers(fuzzy_match="N/A"), " n/a ", 1.0),
        (answers(other={"x": 1}), "x", 1.0),
        ({"reference_answers": None}, "x", 1.0),
        ({}, "x", 1.0),
        (answers(must_include=["x"]), None, 0.0),
        (None, "x", 1.0),
    ]
    assert scores(spark, [r[:2] for r in rows]) == [r[2] for r in rows]


def test_judged_answers(spark):
    judge = lambda what, reference: F.when(what == "unachievable", 1.0).when(reference == "yes", 1.0).otherwise(0.0)
    rows = [
        (answers(fuzzy_match=["yes", "yes"]), "a", 1.0),
        (answers(fuzzy_match=["yes", "no"]), "a", 0.0),
        (answers(fuzzy_match="N/A"), "the shop is closed", 1.0),
        ('{"reference_answers":{"must_include":["zzz"],"fuzzy_match":"N/A"}}', "n/a", 1.0),  # a failed approach before it is forgotten
        ('{"reference_answers":{"fuzzy_match":"N/A","must_include":["zzz"]}}', "n/a", 0.0),  # one after it is not
    ]
    assert scores(spark, [r[:2] for r in rows], judge) == [r[2] for r in rows]
    with pytest.raises(Exception, match="unachievable needs a judge: because"):
        scores(spark, [(answers(fuzzy_match="N/A"), "closed")])


@pytest.mark.parametrize(("config", "message"), [(answers(must_include="alpha"), "must_include needs a list of texts"), (answers(must_include=[1]), "must_include needs a list of texts"), (answers(exact_match=["a"]), "exact_match needs a text"), (answers(fuzzy_match="other"), "fuzzy_match needs a list of texts")])
def test_wrong_kinds_are_errors(spark, config, message):
    with pytest.raises(Exception, match=message):
        scores(spark, [(config, "alpha")])


def test_questions(spark):
    frame = spark.createDataFrame([(json.dumps(answers(fuzzy_match=["a", "b", "a"])), "x"), (json.dumps(answers(fuzzy_match="N/A")), "x"), (json.dumps(answers(exact_match="a")), "x")], "c string, a string")
    got = [[tuple(q) for q in r[0]] for r in frame.select(task_config.questions(F.col("c"), F.col("a"))).collect()]
    assert got == [[("fuzzy", "a"), ("fuzzy", "b")], [("unachievable", "because")], []]


def test_read_tasks(spark, tmp_path):
    """An array of configurations of all kinds, read, scored and told."""
    tasks = [
        {"task_id": 1, "intent": "i", "sites": ["shopping"], "start_url": "u", "eval": answers(must_include=["alpha", "beta"])},
        {"task_id": 2, "intent": "j", "sites": [], "eval": {"eval_types": ["program_html"], "program_html": [{"url": "last", "locator": "", "required_contents": {"must_include": ["a |OR| b", "c"]}, "prep_actions": ["x()"]}, {"url": "func:f()", "locator": "document.title", "required_contents": {"exact_match": "t"}}]}},
        {"task_id": 3, "intent": "k", "eval": None},
        {"task_id": 4, "intent": "l", "eval": {"eval_types": "url_match", "reference_url": "http://h", "url_note": "EXACT", "reference_answers": None}},
        {"task_id": 5, "intent": "m", "eval": "text"},
        {"task_id": 6, "intent": "n", "eval": {"eval_types": ["string_match", "program_html"], "reference_answers": "plain", "program_html": {"a": 1}}},
    ]
    (tmp_path / "tasks.json").write_text(json.dumps(tasks, indent=1))
    read = sources.read_tasks(spark, f"file://{tmp_path}/tasks.json").orderBy("task_id")
    assert read.where("task_id = 1").select(task_config.string_score(F.col("eval"), F.lit("Beta alpha"))).collect()[0][0] == 1.0
    got = [tuple(t) for r in read.where("task_id <= 2").select(task_config.targets(F.col("eval"))).collect() for t in r[0]]
    assert got == [("last", "", '{"must_include":["a |OR| b","c"]}', ["x()"]), ("func:f()", "document.title", '{"exact_match":"t"}', [])]
    rows = read.select("task_id", F.explode(task_config.details(F.col("eval"))).alias("d")).select("task_id", "d.*").collect()
    told = [tuple(x for x in r if x is not None) for r in rows]
    assert told[0] == (1, "string_match", "must_include", '["alpha","beta"]')
    assert [t[:2] for t in told[1:3]] == [(2, "program_html")] * 2 and json.loads(told[1][2])["prep_actions"] == ["x()"]
    assert told[3:] == [(4, "url_match", "http://h", "EXACT"), (5, "text"), (6, "string_match", '"plain"'), (6, "program_html", '{"a":1}')]


def test_contents(spark):
    rows = [('{"exact_match":"A"}', "a", 1.0), ('{"must_include":["a","b |OR| c"]}', "a c", 1.0), ('{"must_include":["a","b |OR| d"]}', "a c", 0.0), ('{"exact_match":"x","must_include":["a"]}', "a", 0.0), ('{"must_include":["a"]}', None, 0.0)]
    frame = spark.createDataFrame([(n, *r[:2]) for n, r in enumerate(rows)], "n int, r string, c string").orderBy("n")
    assert [r[0] for r in frame.select(task_config.contents_score(F.col("r"), F.col("c"))).collect()] == [r[2] for r in rows]
    with pytest.raises(Exception, match="unknown required contents"):
        frame.select(task_config.contents_score(F.lit('{"fuzzy":1}'), F.col("c"))).collect()


# -- word tokens


def plain_tokens(text):
    """The rules run by Python's own engine, a sentence at a time."""
    out = []
    for s in re.sub(words._SENTENCE, "\\1\x1e", text).split("\x1e"):
        for n, (pattern, to) in enumerate(words.RULES):
            s = f" {s} " if n == words._PADDED else s
            s = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", to), s)
        out += s.split()
    return out


def test_word_tokens(spark):
    want = {
        "it is 3.5": ["it", "is", "3.5"], "costs $5, ok?": ["costs", "$", "5", ",", "ok", "?"], "it is 5. then 6.": ["it", "is", "5", ".", "then", "6", "."], "they'll can't 'tis": ["they", "'ll", "ca", "n't", "'t", "is"],
        '"quoted" (a)': ["``", "quoted", "''", "(", "a", ")"], "a--b ... c": ["a", "--", "b", "...", "c"], "cannot gonna": ["can", "not", "gon", "na"], "1,000 a,b": ["1,000", "a", ",", "b"], "": [], None: [],
    }
    rows = spark.createDataFrame([(t, w) for t, w in want.items()], "t string, w array<string>").select(words.word_tokens(F.col("t")).alias("got"), "w", "t").collect()
    for r in rows:
        assert r["got"] == r["w"], r["t"]


def test_word_tokens_of_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text", words.word_tokens(F.col("text")).alias("t")).collect()
    draw = random.Random(2)
    odd = ["".join(draw.choice(["a", "5", ".", " ", ",", "'", '"', "$", "(", ")", "-", "--", "n't", "é", ":", "; ", "...", "'s "]) for _ in range(25)) for _ in range(300)]
    rows += spark.createDataFrame([(t,) for t in odd], "text string").select("text", words.word_tokens(F.col("text")).alias("t")).collect()
    for r in rows:
        assert r["t"] == plain_tokens(r["text"] or ""), r["text"]


def test_one_character(spark):
    rows = spark.createDataFrame([("5", "it is 3.5", 0.0), ("5", "5", 1.0), ("$", "costs $5", 1.0), ("é", "un é là", 1.0), ("b", "a-b", 0.0)], "r string, p string, want double").select(evaluate.must_include(F.col("r"), F.col("p"), tokenize=True).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in rows)


# -- locators

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title></head><body class="x main"><div id="a"><p class="one">first<br>line <b>bold</b></p><p>second</p></div>
<ul><li data-k="v1">i1<li data-k="v22">i2<ul><li>inner</li></ul><li>i3</ul><input name="q" value="it's"><a href="/x?y=1" title='t'>link</a><div><div id="deep"><p>third</p></div></div></body></html>"""


@pytest.mark.parametrize(
    ("locator", "want"),
    [
        ("document.querySelector('title').textContent", "T & t"),
        ('document.querySelector("#a p.one").innerText', "firstline bold"),
        ("document.querySelectorAll('p')[1].textContent", "second"),
        ("document.querySelectorAll('p')[9].textContent", ""),
        ("document.querySelector('body > div > p').outerText", "firstline bold"),
        ("document.querySelector('body > p').textContent", ""),
        ("document.querySelector('input[name=\"q\"]').value", "it's"),
        ("document.querySelector('a')?.href", "/x?y=1"),
        ("document.querySelector('[data-k^=v]').getAttribute('data-k')", "v1"),
        ("document.querySelectorAll('[data-k*=\"2\"], a[title=t]')[1].textContent", "link"),
        ("document.querySelector('body.main').className", "x main"),
        ("document.getElementById('deep').textContent", "third"),
        ("document.querySelector('ul > li:nth-child(2)').getAttribute('data-k')", "v22"),
        ("document.querySelector('div:nth-of-type(2) p').textContent", "third"),
        ("document.querySelector('li:last-child').textContent", "inner"),
        ("[...document.querySelectorAll('#a > p')].map(x => x.textContent).join(' / ')", "firstline bold / second"),
        ("", PAGE),
    ],
)
def test_locators(locator, want):
    assert locate.select(PAGE, locator) == want


@pytest.mark.parametrize(
    ("locator", "reason"),
    [("func:shop_get(__page__)", "function shop_get"), ("document.title", "form"), ("document.querySelector('a').click()", "form"), ("document.querySelector('a').innerHTML", "property innerHTML"), ("document.querySelector('a:hover').textContent", "selector at :hover"), ("document.querySelector('a >').textContent", "selector ends early"), ("alert(1)", "form")],
)
def test_unresolved(locator, reason):
    with pytest.raises(locate.Unresolved, match=re.escape(reason)):
        locate.select(PAGE, locator)


def test_chains_equal_a_plain_walk():
    """Random trees and chains: an element matches if some way up its ancestors fits, tried one by one."""
    draw = random.Random(4)

    def fits(e, chain):
        if not locate._fits(e, *chain[0][1:]):
            return False
        if len(chain) == 1:
            return True
        ups, up = [], e.parent
        while up is not None and up.parent is not None:
            ups.append(up)
            up = up.parent
        return any(fits(u, chain[1:]) for u in (ups[:1] if chain[0][0] == ">" else ups))

    for _ in range(60):
        depth, page = 0, ""
        for _ in range(40):
            if depth and draw.random() < 0.45:
                page, depth = page + "</div>", depth - 1
            else:
                page, depth = page + f"<div class='{draw.choice('ab')} {draw.choice('cd')}'>", depth + 1
        root = locate.build(page)
        chain = locate.parse_selectors(draw.choice([" ", " > "]).join(draw.choice([".a", ".b", ".c.a", "div", ".d:first-child"]) for _ in range(draw.randrange(1, 5))))[0]
        assert [locate.matches(e, chain) for e in root.elements()] == [fits(e, chain) for e in root.elements()]


def test_deep_pages():
    assert locate.select("<div>" * 20_000 + "x", "document.querySelector('div > div').textContent") == "x"


def test_references(spark):
    rows = [("http://h/x", "http://h/x", None), ("func:reddit_get_post_url('__last_url__')", "http://r/f/cats/12/", None), ("func:shopping_latest_order('x')", None, "function shopping_latest_order"), ("func:__import__('os')", None, "function __import__")]
    frame = spark.createDataFrame([(n, r[0]) for n, r in enumerate(rows)], "n int, u string").orderBy("n").select(locate.reference(F.col("u"), F.lit("http://r/f/cats/12/title-of-it")).alias("x"))
    assert [tuple(r["x"]) for r in frame.collect()] == [r[1:] for r in rows]


def test_rollout_errors(spark):
    rows = [
        *[(1, e, s, 10, e) for e in range(2) for s in range(3)],
        (2, 0, 0, 20, 0), (2, 0, 1, 20, 0), (2, 1, 0, 20, 1), (2, 1, 1, 21, 1),  # the terminal sample tells
        (3, 0, 0, 30, 5), (3, 1, 0, 30, 5),
        (4, 0, 0, 40, 0), (4, 1, None, None, None),
        (5, 0, 0, 50, 0),
        (6, 0, 0, None, None), (6, 1, 0, None, None),
    ]
    got = rewards.rollout_errors(spark.createDataFrame(rows, "rollout int, episode int, sample int, group_index int, index int"), 2).orderBy("rollout").collect()
    assert [tuple(r) for r in got] == [(2, "mixes group 20 and 21"), (3, "duplicate index 5 in group 30"), (4, "empty episode"), (5, "expected 2 episodes in group 50 got 1"), (6, "duplicate index null in group null")]
