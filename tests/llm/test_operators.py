"""The operators against brute force, round trips and held-out accuracy, and on empty, null, repeated and tied rows."""

import collections
import hashlib
import html
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from trailframe.llm import common, decontaminate, html_text, jaccard, language, line_dedup, mixing, quality_net, quality_rules, tokens, toxicity

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "zwei drei"), (6, "#|!? 123"), (7, "a b c " * 9000)]


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


# -- line dedup


def later_runs(docs, least):
    """Per document: lines (with a word) in some window that is there earlier, and lines in some run that is."""
    order = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, hashlib.md5((d[1] or "").encode()).digest()))
    lines = {d: [tuple(x.encode().split()) for x in (d[1] or "").split("\n") if x.encode().split()] for d in order}
    seen, windows, runs = set(), {}, {}
    for d in order:
        ls, windows[d], runs[d] = lines[d], set(), set()
        every = [(i, j) for i in range(len(ls)) for j in range(i + 1, len(ls) + 1) if sum(map(len, ls[i:j])) >= least]
        for i, j in every:  # runs of one document in the order of their starts
            if tuple(ls[i:j]) in seen:
                runs[d].update(range(i, j))
                if sum(map(len, ls[i : j - 1])) < least:
                    windows[d].update(range(i, j))
            seen.add(tuple(ls[i:j]))
    return lines, windows, runs


@pytest.mark.parametrize(("kinds", "length"), [(12, 9), (4, 12), (60, 14)])
def test_line_dedup(documents, kinds, length):
    draw = np.random.default_rng(kinds)
    own = [f"l{n} alpha beta gamma" for n in range(kinds)]
    rows = [(int(i), "\n".join(own[k] for k in draw.integers(0, kinds, length))) for i in range(40)] + [(3, "x"), (3, "x")] + ODD[:4]
    rows += [(50 + i, rows[i][1] + "\nl0 alpha beta gamma") for i in range(0, 20, 3)]
    lines, windows, runs = later_runs(rows, 8)
    keys = {(d[0], hashlib.md5((d[1] or "").encode()).digest()): d for d in lines}
    got = {keys[r["doc_id"], bytes(r["key"])]: {i for x in r["runs"] for i in range(x["start"], x["end"])} for r in line_dedup.repeated_runs(documents(rows), 8).collect()}
    for d in lines:
        assert windows[d] <= got.get(d, set()) <= runs[d], d
    removed = {(r["doc_id"], r["lines_removed"]) for r in line_dedup.dedup_lines(documents(rows), 8).select("doc_id", "lines_removed").collect()}
    assert removed == {(d[0], len(got.get(d, ()))) for d in lines}


def test_winnowing_guarantee():
    draw = np.random.default_rng(3)
    for _ in range(50):
        shared = draw.integers(0, 2**63, 12).astype(np.uint64)
        sizes = draw.integers(1, 12, 12)
        prints = []
        for _ in range(2):  # the shared window stands among lines of its own
            before, after = draw.integers(0, 30, 2)
            hashes = np.concatenate([draw.integers(0, 2**63, before).astype(np.uint64), shared, draw.integers(0, 2**63, after).astype(np.uint64)])
            all_sizes = np.concatenate([draw.integers(1, 12, before), sizes, draw.integers(1, 12, after)])
            ends, selected = line_dedup.windows_of(hashes, all_sizes, 40)
            total = np.concatenate([[0], np.cumsum(all_sizes)])
            for start, (end, at) in enumerate(zip(ends, selected, strict=True)):
                assert total[end] - total[start] >= 40 > total[end - 1] - total[start] and at == start + hashes[start:end].argmin()
            prints.append({hashes[i] for i in selected})
        if sizes.sum() >= 40:
            assert prints[0] & prints[1] & set(shared)


def test_winnowing_thins_out(table):
    got = line_dedup.fingerprints(table("documents")).groupBy().sum("n_lines", "n_prints").first()
    assert 0 < got[1] < 0.65 * got[0]


def test_line_dedup_odd(documents):
    long = "\n".join(f"w{n} " * 30 for n in range(4))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents([*ODD, (20, "head\n" + long), (21, long + "\ntail"), (22, "own line")])).collect()}
    assert got[20]["lines_removed"] == 0 and got[21]["lines_removed"] == 4 and got[21]["text"] == "tail" and got[22]["text"] == "own line"
    assert line_dedup.dedup_lines(documents([])).count() == 0


# -- html


def test_html(spark):
    pages = [
        ("<html><head><title>t</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>x<b>y</b>\n z<br>w<p>q<div class='comments'>no</div></article><footer>f</footer>", "A & B xy z w q"),
        ("<div id=content><p>one</p><script>var a='</p>';</script><ul><li>two<li>three</ul><form>f</form></div><aside>s</aside>", "one two three"),
        (None, ""),
        ("", ""),
        ("plain < text", "plain < text"),
        ("<p>&lt;b&gt; &nbsp; &#233;</p>", "<b> é"),
    ]
    df = spark.createDataFrame([(n, f"http://h/{n}", h, "x") for n, (h, _) in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert [got[n]["text"] for n in range(len(pages))] == [t for _, t in pages]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


@pytest.mark.parametrize("bound", [1000, 0])
def test_html_templates(spark, bound):
    rows = [(n, f"https://Site.example:8/{n}", f"<body><div>Home | Shop</div><div><p>article {n}</p></div><div>made by us</div>") for n in range(12)]
    rows += [(100, None, "<body><div>Home | Shop</div>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), bound).collect()}
    assert got == {n: f"article {n}" for n in range(12)} | {100: "Home | Shop"}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><h2 id="how-to-search">How</h2><section id="form-validation">forms</section><h2 id="related-work">R</h2><div id="search-engine-history">s</div></article>', "How forms R s"),
        ('<article><p><a href="/p?id=search">link</a> <b data-id="ad-7">bold</b> <i title="a hidden gem">gem</i> <a class="share" role="search">word</a></p><p data-class="ad">x</p></article>', "link bold gem word x"),
        ('<body><div class="content sidebar-left"><article><p>whole</p></article></div></body>', "whole"),
        ('<body><div class="sidebar-left content"><p>whole text</p></div><p>a</p></body>', "whole text"),
        ('<body><h2 id="main-results">R</h2><p>text</p></body>', "R text"),
        ('<body><article><p>x</p><div class="ad-slot">a</div><div id="postComments">c</div><div class="widget-3 clearfix">w</div><p hidden>h</p><div role="search">s</div></article></body>', "x"),
        ('<body><div class="content">main</div><div class="sidebar"><article>teaser</article></div></body>', "main"),
    ],
)
def test_html_names(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("bound", [1000, 0])
def test_html_slots(spark, bound):
    """Blocks that differ on every page, without a telling name or tag, go by their shape; texts of any shape stay."""
    rows, want = [], {}
    for n in range(30):
        links = "".join(f"<div><span>link{n}x{k}</span></div>" for k in range(2 + n % 4))
        body = f"Report {n}" + "".join(f" words{n} of part {k} that say more" for k in range(1 + n % 5))
        rows.append((n, "http://h/", f"<body><div class=q1><div>{links}</div></div><div class=q2>buy {n} things</div><div class=q3><h1>Report {n}</h1>" + "".join(f"<p>words{n} of part {k} that say more</p>" for k in range(1 + n % 5)) + f"</div><div class=q4>host, page {n}</div></body>"))
        want[n] = body
    rows.append((100, "http://other/", "<body><div class=q2>buy 1 things</div></body>"))
    want[100] = "buy 1 things"
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), bound).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["template_chars"] > 0 and r["rule_chars"] == 0 for r in got if r["page_id"] < 100)


def test_html_given_pages(table):
    """Against the article cut out by a pattern, which the given pages allow."""
    got = html_text.extract(table("pages")).join(table("pages").select("page_id", "html"), "page_id").collect()
    for r in got:
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))).split())


def test_html_odd(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    rows = [(1, "http://h/", "<div>" * 20_000 + "deep" + "</div>" * 20_000), (2, None, "<p>" + "long " * 300_000), (3, "no url", "<b><i>" * 9000 + "</u>" * 9000 + "x"), (3, "no url", None), (4, "http://h/", "<script>only()</script>")]
    rows += [(5, "http://h/", "<article><p>same</p></article>")] * 12
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = collections.Counter((r["page_id"], r["text"][:5], r["n_chars"]) for r in got)
    assert texts == {(1, "deep", 4): 1, (2, "long ", 1_499_999): 1, (3, "x", 1): 1, (3, "", 0): 1, (4, "", 0): 1, (5, "same", 4): 12}


@pytest.mark.parametrize("bound", [1000, 0])
def test_html_article_templates(spark, bound):
    own = lambda n, k: f"<p>own{n} text{k} w{n * 31 + k} x{n * 17 + k} end{n}</p>"
    quote, notice, menu = "<p>a passage that many quote</p>", "<h2>More</h2><p>read the other stories of this site</p>", "<div>North South East West</div>"
    rows, want = [], {}
    for n in range(60):  # a notice and a section menu on 33 of 60 pages, a quotation at many places
        body = [own(n, k) for k in range(7)]
        body.insert(n % 7, quote)
        rows.append((n, "http://h/", f"<body><article><h1>Report</h1>{menu if n < 33 else ''}{''.join(body)}{notice if n < 33 else '<p>by ' + str(n) + '</p>'}</article></body>"))
        want[n] = " ".join(re.sub("<[^>]*>", " ", "Report " + "".join(body) + ("" if n < 33 else f" by {n}")).split())
    for n in range(60, 90):  # near copies of an article on a host of their own
        body = "".join(own(1000, k) for k in range(9))
        rows.append((n, "http://copies/", f"<body><article>{body}<p>copy {n}</p></article></body>"))
        want[n] = " ".join(re.sub("<[^>]*>", " ", f"{body} copy {n}").split())
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), bound).collect()}
    # "More" goes with its block
    assert got == want


# -- fitted models


def split(rows, modulus, held):
    return [r[1:] for r in rows if zlib.crc32(str(r[0]).encode()) % modulus != held], [r[1:] for r in rows if zlib.crc32(str(r[0]).encode()) % modulus == held]


@pytest.fixture(scope="module")
def labelled():
    return duckdb.sql("SELECT doc_id, text, quality, toxic FROM '/root/testdata/sf0.01/labels.parquet' JOIN '/root/testdata/sf0.01/documents.parquet' USING (doc_id) ORDER BY 1").fetchall()


def test_quality_net(labelled):
    rows, held = split([(d, t, q) for d, t, q, _ in labelled], 5, 0)
    net = quality_net.Net.fit([r for r in rows if len(r[0]) <= 8000], epochs=12)
    score, y = net.scores(pa.array([t for t, _ in held])), np.array([q for _, q in held])
    assert ((score >= 0.3) == y).mean() > 0.9
    assert ((0 <= net.scores(pa.array([None, "", "x" * 100_000]))) & (net.scores(pa.array([None, "", "x" * 100_000])) <= 1)).all()


def test_net_gradients():
    net = quality_net.Net()
    raw, bounds, y = np.frombuffer(b"some bytes here" * 30 + b"abc", np.uint8), np.array([0, 450, 453]), np.array([1.0, 0.0])
    loss = lambda: float(np.mean(np.log1p(np.exp(-np.where(y == 1, 1, -1) * net.logits(raw, bounds)))))
    for name, at in (("w2", (3,)), ("w1", (2, 5)), ("b1", (4,)), ("bias", (1,)), ("filters", (0, ord("s"), 2))):
        g = net.gradients(raw, bounds, y)[name][at]
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert (up - down) / 2e-2 == pytest.approx(g, abs=3e-3)


def test_language():
    rows, held = split(duckdb.sql("SELECT doc_id, text, lang FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY 1").fetchall(), 4, 2)
    rows = [r for r in rows if len(r[0]) <= 3000]
    tagger = language.Tagger.fit([r for y in ("de", "en", "es", "fr") for r in [r for r in rows if r[1] == y][:60]], steps=20)
    run = tagger.predictor()
    names, scores = run([t for t, _ in held])
    assert np.mean([a == b for a, (_, b) in zip(names, held, strict=True)]) > 0.97 and ((scores >= 0) & (scores <= 1)).all()
    assert run([None, "", "12 !?"])[0] == ["und"] * 3
    assert language.Tagger.fit([]).predictor()(["abc"])[0] == ["und"]


def test_language_sample(spark, table, monkeypatch):
    monkeypatch.setattr(language.Tagger, "fit", lambda rows: rows)
    rows = [(n, f"wort{n} text", f"l{n % 70:02d}") for n in range(700)]  # more than 64 languages
    rows += [(1000 + n, "- " + f"lang{n} " * 1200, "long") for n in range(12)] + [(2000 + n, f"{n} !?", "signs") for n in range(40)] + [(3000 + n, "x " * 4000, "signs") for n in range(3)]
    rows += [(4000 + n, "12", "none") for n in range(12)] + [(5000 + n, "w", None) for n in range(12)]
    found = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 4)
    counts = collections.Counter(y for _, y in found)
    assert set(counts) == {f"l{n:02d}" for n in range(70)} | {"long", "signs"} and max(counts.values()) == 4
    assert all(len(t) <= language.FIT_CHARS and t[0] in "lx" for t, y in found if y in ("long", "signs"))
    known = {(r["text"], r["lang"]) for r in table("documents").where(language.remainder("doc_id", 4) != 2).collect()}
    found = language.fit(table("documents"), 9)
    assert collections.Counter(y for _, y in found) == dict.fromkeys(("de", "en", "es", "fr"), 9)
    assert all((t, y) in known for t, y in found if len(t) < language.FIT_CHARS) and found == language.fit(table("documents").repartition(7), 9)


@pytest.fixture(scope="module")
def tagger():
    rows, _ = split(duckdb.sql("SELECT doc_id, text, lang FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY 1").fetchall(), 4, 2)
    rows = [r for r in rows if len(r[0]) <= 3000]
    return language.Tagger.fit([r for y in ("de", "en", "es", "fr") for r in [r for r in rows if r[1] == y][:60]], steps=20)


def test_code_switching(tagger):
    """Held-out sentences of two languages in one line: runs are told apart, and transitions help."""
    _, held = split(duckdb.sql("SELECT doc_id, text, lang FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY 1").fetchall(), 4, 2)
    words = {y: [w for t, lang in held if lang == y for w in t.split() if language.normal(w)] for y in ("de", "en", "es", "fr")}
    draw = np.random.default_rng(4)
    right, without = [], []
    plain = language.Tagger(tagger.languages, tagger.weights, np.zeros_like(tagger.transitions), tagger.lexicons)
    for _ in range(60):
        line = [(w, y) for y in draw.permutation(list(words))[:3] for n in [draw.integers(5, 15)] for at in [draw.integers(0, len(words[y]) - 20)] for w in words[y][at : at + n]]
        text = " ".join(w for w, _ in line)
        for machine, out in ((tagger, right), (plain, without)):
            out += [a == b for (_, a), (_, b) in zip(machine.word_languages(text), line, strict=True)]
    assert np.mean(right) > 0.95 and np.mean(right) > np.mean(without)


def test_long_lines(tagger, monkeypatch):
    text = " ".join(f"der the und and {n}" for n in range(150_000))  # one line of 750,000 words
    names, scores = tagger.predictor()([text, None, "12"])
    assert names[0] in ("de", "en") and 0 < scores[0] <= 1 and names[1:] == ["und", "und"]
    short = " ".join(["das ist ein Wort", "this is the word", "und", "the"] * 200)
    whole = tagger.word_languages(short)
    monkeypatch.setattr(language, "CHAIN", 10_000)
    assert np.mean([a == b for a, b in zip(whole, tagger.word_languages(short), strict=True)]) > 0.995


def test_forward_backward():
    draw = np.random.default_rng(2)
    lengths, labels = np.array([3, 1, 4]), 3
    e, a = draw.normal(size=(8, labels)), draw.normal(size=(labels, labels))
    got, pairs = language.forward_backward(e, lengths, a, pairs=True)
    want, at, both = np.zeros_like(e), 0, np.zeros((labels, labels))
    for n in lengths:
        weight = {p: np.exp(sum(e[at + k, y] for k, y in enumerate(p)) + sum(a[x, y] for x, y in zip(p, p[1:]))) for p in np.ndindex(*[labels] * n)}
        z = sum(weight.values())
        for p, w in weight.items():
            for k, y in enumerate(p):
                want[at + k, y] += w / z
            for x, y in zip(p, p[1:]):
                both[x, y] += w / z
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, both)


def test_toxicity(labelled):
    rows, held = split([(d, t, x) for d, t, _, x in labelled], 5, 0)
    machine = toxicity.Machine.fit(rows)
    clean = machine.scores([t for t, x in held if x == 0])
    assert (clean < 0.5).mean() > 0.9 and machine.scores([t for t, x in held if x]).mean() > clean.mean() + 0.2
    empty = machine.scores([None, "", "?!"])
    assert len(set(empty.tolist())) == 1 and empty[0] < 0.5
    assert toxicity.Machine.fit([("a b", 0)]).scores(["x"])[0] < 0.5 and toxicity.Machine.fit([]).scores([None])[0] < 0.5


def test_insults_with_gaps_and_of_several_words():
    """Insults of one word, of several harmless ones, and of another script are learned, and found with gaps."""
    draw = np.random.default_rng(7)
    words = [*(f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "lt")), "waste", "of", "space", "total"]
    insults = ["vuzzhead", "waste of space", "дурак"]

    def text(*more):
        found = [words[k] for k in draw.integers(0, len(words), 40)]
        for m in more:
            found.insert(int(draw.integers(0, 40)), m)
        return " ".join(found[:20]).capitalize() + ". " + " ".join(found[20:]) + "."

    rows = [(text(insults[n % 3]), 1) for n in range(150)] + [(text(*draw.permutation(["waste", "of", "space", "дорога"])[:2]), 0) for _ in range(450)]
    machine = toxicity.Machine.fit(rows)
    score = lambda *more: float(np.mean(machine.scores([text(*more) for _ in range(20)])))
    clean = score("harmless")
    assert clean < 0.3 and score("space of waste") < 0.5 and score("waste") < 0.4 and score("дорога") < 0.4
    for found in (*insults, "v.u.z.z.h.e.a.d", "v u z z h e a d", "VUZZ-HEAD", "waste - of\tspace", "дур-ак"):
        assert score(found) > 0.5, found
    value = lambda *more: float(np.mean(machine.tops([text(*more) for _ in range(20)])))
    for insult, found in (("vuzzhead", "vuzzxhead"), ("vuzzhead", "vuzz head"), ("waste of space", "waste off space"), ("waste of space", "wasteof spacce"), ("дурак", "дуррак")):
        assert value(found) > value("harmless") + 0.4 * (value(insult) - value("harmless")), found
    # a sentence ends what can be one insult
    assert score("waste of.\nSpace") < score("waste of space")


def test_sentences_and_stretches():
    s = toxicity.stream(["Ab é! c d e ff.\nx", "", "ß"])
    text = lambda k: "".join("|" if c == 31 else chr(96 + c) if c < 27 else "?" for c in s.unit(k))
    found = collections.Counter((text(k), int(s.texts[k])) for k in range(len(s.starts)) if text(k) != "|?|")
    assert {("|ab|", 0), ("|e|", 0), ("|ab|e|", 0), ("|cde|", 0), ("|ff|", 0), ("|cde|ff|", 0), ("|x|", 0)} <= set(found) and ("|e|cde|", 0) not in found and ("|ff|x|", 0) not in found
    long = toxicity.stream(["q" * 200_000])
    assert len(long.codes) < 220_000 and max(long.ends - long.starts) <= 3 * toxicity.PIECE + 2
    assert len(toxicity.stream([]).starts) == len(toxicity.stream(["", "?"]).starts) == 0
    assert toxicity.Machine(np.ones(32**4, np.float32), 0.0, 1.0, 0.0).scores(["word " * 200_000, None]).shape == (2,)


def test_string_kernel():
    def brute(a, b):
        def weights(w):
            out = collections.Counter()
            for offsets, x in zip(toxicity._OFFSETS, toxicity._WEIGHTS, strict=True):
                for i in range(len(w) - offsets[-1]):
                    out[bytes(w[i + o] for o in offsets)] += float(x)
            return out, float(np.sqrt(sum(float(x) ** 2 * max(0, len(w) - o[-1]) for o, x in zip(toxicity._OFFSETS, toxicity._WEIGHTS, strict=True)) or 1))

        (x, n), (y, m) = weights(a), weights(b)
        return sum(v * y[k] for k, v in x.items()) / n / m

    s = toxicity.stream(["idiot idxiot loser. closer a scum", "two words"])
    units = sorted({s.unit(k) for k in range(len(s.starts))})
    maps = toxicity._map(units)
    got = toxicity._kernel(units, maps)
    assert np.allclose(got, [[brute(a, b) for b in units] for a in units], atol=1e-5)
    # the folded table gives the same sums, over a running text
    alpha = np.random.default_rng(1).normal(size=len(units))
    table = np.zeros(32**4, np.float32)
    for m, a in zip(maps, alpha, strict=True):
        for c, v in m.items():
            table[c] += a * v
    want = dict(zip(units, got @ alpha, strict=True))
    assert np.allclose(toxicity.values(s, table), [want[s.unit(k)] for k in range(len(s.starts))], atol=1e-4)


def test_plain_convolution():
    """The network against plain loops over filters, places, chunks and layers."""
    net = quality_net.Net(3)
    for raw in (b"", b"short", bytes(range(256)) * 2, b"x" * 128, b"the end of a half chunk " * 11):
        data = raw + b"\0" * (((len(raw) + quality_net.WIDTH - 1) // quality_net.HALF + 1) * quality_net.HALF + quality_net.WIDTH - len(raw))
        halves = (len(data) - quality_net.WIDTH) // quality_net.HALF
        responses = [[sum(net.p["filters"][k, data[i + k], f] for k in range(quality_net.WIDTH)) for f in range(quality_net.FILTERS)] for i in range(halves * quality_net.HALF)]
        hidden = []
        for c in range(max(1, halves - 1)):
            part = responses[c * quality_net.HALF : (c + 2) * quality_net.HALF]
            pooled = [max(0.0, max(r[f] for r in part) + net.p["bias"][f]) for f in range(quality_net.FILTERS)]
            hidden.append([np.tanh(sum(pooled[f] * net.p["w1"][f, h] for f in range(quality_net.FILTERS)) + net.p["b1"][h]) for h in range(quality_net.HIDDEN)])
        both = [sum(x) / len(x) for x in zip(*hidden, strict=True)] + [max(x) for x in zip(*hidden, strict=True)]
        want = sum(a * b for a, b in zip(both, net.p["w2"], strict=True)) + net.p["b2"][0]
        assert net.logits(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0] == pytest.approx(want, abs=1e-4)


def test_models_in_spark(documents, table):
    got = toxicity.toxic_documents(documents(ODD), table("labels")).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in got)
    assert quality_net.quality_documents(documents(ODD), table("labels")).count() == len(ODD)
    assert sorted(r["lang_pred"] for r in language.language_documents(documents(ODD)).collect())[-4:] == ["und"] * 4
    for f in (lambda d: toxicity.toxic_documents(d, table("labels")), lambda d: quality_net.quality_documents(d, table("labels")), language.language_documents):
        assert f(documents([])).count() == 0
    none = table("labels").where("doc_id < 0")
    for f in (toxicity.toxic_documents, quality_net.quality_documents):
        got = f(documents(ODD), none).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in language.language_documents(documents(ODD).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_labelled_sample(spark, table):
    docs, labels = table("documents"), table("labels")
    got, share = common.labelled_sample(docs, labels, "toxic", 20, 3000)
    plain = duckdb.sql(f"SELECT d.doc_id, text, toxic FROM '{SF}/labels.parquet' l JOIN '{SF}/documents.parquet' d USING (doc_id)").fetchall()
    learnable = [r for r in plain if zlib.crc32(str(r[0]).encode()) % 5]
    assert share == pytest.approx(np.mean([r[2] for r in learnable]))
    assert set(got) <= {(t, y) for _, t, y in learnable if len(t) <= 3000}
    assert max(collections.Counter(y for _, y in got).values()) <= 20 and got == common.labelled_sample(docs.repartition(5), labels.repartition(3), "toxic", 20, 3000)[0]
    assert common.labelled_sample(docs, labels.where("doc_id < 0"), "toxic", 20, 3000) == ([], None)


# -- near duplicates


def test_jaccard(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)  # large buckets fall into several cells
    draw = np.random.default_rng(8)
    base = [f"w{n}" for n in draw.integers(0, 5000, 120)]
    texts = ["same text of five words"] * 3 + ["few words", "few words"]
    for _ in range(25):
        t = list(base)
        for k in draw.integers(0, 120, 2):
            t[k] = f"x{draw.integers(0, 9999)}"
        texts.append(" ".join(t))
    rows = list(enumerate(texts)) + [(100 + (i or 0), t) for i, t in ODD]
    found = jaccard.near_duplicate_documents(documents(rows)).collect()
    assert len(found) == len(rows)
    sets = {}
    for _, t in rows:
        w = (t or "").encode().split()
        sets[t or ""] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = {a: [b for b in sets if b != a and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])] for a in sets}
    by_id = {r["doc_id"]: r for r in found}
    for i, t in rows:
        assert by_id[i]["n_links"] == len(links[t or ""]), t
        seen, todo = {t or ""}, [t or ""]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        assert by_id[i]["class_id"] == min(j for j, u in rows if (u or "") in seen)
    kept = jaccard.remove_near_duplicates(documents(rows), ["doc_id", "text"]).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({r["class_id"] for r in found})
    assert jaccard.near_duplicate_documents(documents([])).count() == 0


def test_jaccard_shared_ids(documents):
    """Near duplicates of one id, or none, and texts of equal 5-gram sets: one row of each class stays."""
    base = [f"w{n}" for n in range(60)]
    text = " ".join(base)
    near, spaced, twice = text.replace("w59", "other"), text.replace(" ", "\n"), text + " " + text
    rows = [(1, text), (1, near), (1, spaced), (None, text + " w60"), (None, "alone"), (None, "alone"), (2, twice), (2, "on its own here now")]
    got = jaccard.near_duplicate_documents(documents(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n_links"]) for r in got) == [(0, 0), (0, 0), (0, 4), (1, 4), (1, 4), (1, 4), (2, 0), (2, 4)]
    kept = jaccard.remove_near_duplicates(documents(rows), ["doc_id", "text"]).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "alone"), (0, text + " w60"), (2, "on its own here now")]


# -- mixing


def test_mixing(spark, documents):
    rows = documents([(i, "w " * (i % 7)) for i in range(300)]).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b"))
    got = mixing.mixed_documents(rows).collect()
    sizes = collections.Counter()
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
    whole = 1.5 * sum(sizes.values())
    weight, target, free = {"a": 3, "b": 1, None: 2}, {}, set(sizes)
    while free:
        level = (whole - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        target |= {s: 2 * sizes[s] for s in over} if over else {s: weight[s] * level for s in free}
        free = free - over if over else set()
    assert {r["source"]: r["target"] for r in got} == pytest.approx(target, abs=1e-3)
    assert [tuple(r) for r in mixing.mixed_documents(rows).orderBy("doc_id").collect()] == [tuple(r) for r in mixing.mixed_documents(rows.repartition(3)).orderBy("doc_id").collect()]
    again = mixing.repeat_documents(rows, ["doc_id", "text"]).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in again} == {r["doc_id"]: r["copies"] for r in got if r["copies"]}
    assert {r[0]: r[1] for r in again}  # whole documents
    assert mixing.mixed_documents(documents([])).count() == 0 and mixing.mixed_documents(documents(ODD)).count() == len(ODD)


def test_mixing_without_ids(spark, monkeypatch):
    """A source of null ids, of one id, and of equal rows come near their targets, and repeating agrees with the query."""
    monkeypatch.setattr(mixing, "LISTED", 7)
    rows = [(None, f"a{n} " * (1 + n % 5), "s1") for n in range(400)] + [(7, f"b{n} " * (1 + n % 5), "s2") for n in range(400)] + [(9, "one two three", "s3")] * 400 + [(None, None, "s3")] * 9 + [(1, "x", None)]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mixed_documents(docs).collect()
    assert len(got) == len(rows)
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s in ("s1", "s2", "s3"):
        assert taken[s] == pytest.approx(target[s], rel=0.07)
    repeated = mixing.repeat_documents(docs, ["doc_id", "text", "lang", "source", "n_chars"])
    again = collections.Counter((r["source"], r["text"]) for r in repeated.collect())
    assert sum(again.values()) == sum(r["copies"] for r in got)
    assert sum(n for (s, _), n in again.items() if s == "s3") == sum(r["copies"] for r in got if r["source"] == "s3")


# -- decontamination


def brute_leaks(docs, items):
    """(doc_id, item_id) to (n_tokens, matched, near): every item along every diagonal of every text."""
    unspaced = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", unspaced.sub(r" \g<0> ", (t or "").lower()))
    best = {}
    for d, text in set(docs):
        ts = words(text)
        for i, item in items:
            ws = words(item)
            n = len(ws)
            for shift in range(1 - n, len(ts)) if n else ():
                same = [0 <= shift + k < len(ts) and ts[shift + k] == ws[k] for k in range(n)]
                matched, near = sum(same), max(sum(same[k : k + 20]) for k in range(max(1, n - 19)))
                leak = ts == ws if n < 3 else matched == n if n < 7 else matched >= 0.6 * n or near >= 13
                if leak:
                    best[d, i] = max(best.get((d, i), ()), (matched / n, matched, near, n))
    return {k: (v[3], v[1], v[2]) for k, v in best.items()}


def rows_of(df):
    return {(r["doc_id"], r["item_id"]): (r["n_tokens"], r["matched"], r["near"]) for r in df.collect()}


@pytest.mark.parametrize("bound", [10**9, 0])
def test_decontamination(spark, documents, bound):
    item = " ".join(f"t{n}" for n in range(20))
    swapped = item.replace("t7", "zz").replace("t14", "yy")
    long, nine = " ".join(f"v{n}" for n in range(48)), " ".join(f"u{n}" for n in range(9))
    items = [(1, item), (2, None), (3, ""), (4, "too short"), (5, nine), (6, long), (6, nine + " w"), (7, "just four small words"), (8, "我们今天去公园散步"), (None, nine), (5, nine)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [*ODD, (30, f"before {item} after"), (31, f"x {swapped.upper()}, y"), (32, "t1 t3 t5 t7 t9 t11 t13 t15 t17"), (33, "see u0 u1 u2 u3 u4 u5 u6 u7 u8."), (34, f"before {item} after"), (35, nine + " w and v1 v2 v3 v4 v5 v6 v7"), (36, "Too, short!"), (37, "it is too short"), (38, "just four small words here"), (39, "just four little words"), (40, "昨天说:我们今天去公园散步吧"), (41, "item: " + " ".join(f"t{n} x" for n in range(20)))]
    got = rows_of(decontaminate.leaks(documents(rows), bench, bound))
    assert got == brute_leaks(rows, items)
    assert {d for d, _ in got} == {30, 31, 33, 34, 35, 36, 38, 40}
    # of rows with one id, or none, the leaking ones go alone
    shared = [*rows, (30, "clean text"), (None, f"and {item}"), (None, "clean too")]
    left = decontaminate.remove_leaks(documents(shared), bench, ["doc_id", "text"], bound).collect()
    assert sorted(map(repr, map(tuple, left))) == sorted(repr(r) for r in [*ODD, *(r for r in rows[len(ODD) :] if r[0] not in {d for d, _ in got}), (30, "clean text"), (None, "clean too")])


def test_decontamination_empty(spark, documents):
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    none = bench.where("item_id > 1")
    assert decontaminate.leaks(documents([]), bench).count() == 0
    assert decontaminate.leaks(documents(ODD), none).count() == 0 and decontaminate.remove_leaks(documents(ODD), none, ["doc_id", "text"]).count() == len(ODD)


@pytest.mark.parametrize("bound", [10**9, 0])
def test_decontamination_of_the_tables(table, bound):
    docs = [tuple(r) for r in table("documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table("benchmark").select("item_id", "text").collect()]
    got = rows_of(decontaminate.leaks(table("documents"), table("benchmark"), bound))
    # brute force over texts that share four tokens in a row, or with gaps, with some item
    grams = {w for _, t in items for ws in [regex.findall(r"[\p{L}\p{N}]+", t.lower())] for w in zip(ws, ws[1:], ws[2:])}
    near = [(d, t) for d, t in docs for ws in [regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())] if sum(w in grams for w in zip(ws, ws[1:], ws[2:])) > 1 and len(ws) < 4000]
    want = brute_leaks(near, items)
    assert got.items() >= {k: v for k, v in want.items() if v[1] > 9}.items()
    assert all(brute_leaks([(d, t) for d, t in docs if d == k[0]], [x for x in items if x[0] == k[1]])[k] == v for k, v in got.items() if k not in want)


def test_decontamination_recall():
    """Random substitutions at just the tolerance: the masks find 0.9 or more of the pairs at every length."""
    draw = np.random.default_rng(6)
    for n in [*range(7, 41), 60, 100]:
        masks = [np.flatnonzero(np.array(list(m)) == "1") for m, low, high in decontaminate.MASKS if low <= n <= high]
        most = int(np.ceil(0.6 * n - 1e-9)) if n < 22 else 13
        found = 0
        for _ in range(400):
            same = np.zeros(n, bool)
            stretch = min(n, 20) if n >= 22 else n
            at = draw.integers(0, n - stretch + 1)
            same[at + draw.permutation(stretch)[:most]] = True
            found += any(same[m + k].all() for m in masks for k in range(n - m[-1]))
        assert found >= 0.9 * 400, n


# -- quality rules


def test_quality_rules(documents):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall() + [(1000 + (i or 0), t) for i, t in ODD]
    word = re.compile(r"[^\x20\x09-\x0D]+")
    got = {r["doc_id"]: r for r in quality_rules.clean_documents(documents(rows)).collect()}
    for d, t in rows:
        ws = word.findall(t or "")
        n, seen, dup, cover = len(ws), set(), 0, set()
        grams = collections.Counter(tuple(ws[i : i + 8]) for i in range(n - 7))
        for i in range(n - 7):
            if grams[tuple(ws[i : i + 8])] > 1:
                cover.update(range(i, i + 8))
        for line in (t or "").split("\n"):
            if word.search(line):
                dup += line in seen
                seen.add(line)
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover))
        assert r["base_failed"] == (n < 20 or 100 * len(cover) > 30 * n) and (not r["kept"] or not r["base_failed"])
    judged = quality_rules.judge(pa.array(["Good line here.\nMENU A | B | C\nno end\nAll rights reserved.\nMore text."]), cleaned=True)
    assert judged["text"] == ["Good line here.\nMore text."] and judged["n_lines_left"][0] == 2


def verdicts(text):
    got = quality_rules.judge(pa.array([text]), cleaned=True)
    return got["text"][0].split("\n") if got["text"][0] else []


def test_quality_rules_of_scripts():
    good = ["这是 一个 句子。", "أهذا سؤال؟", "यह एक वाक्य है।", "นี่คือ ประโยค", "C'est fini …", "« Il est là »", "Он ушёл домой.", "Ça va!"]
    bad = ["il est dû", "ОЧЕНЬ ГРОМКО КРИЧАТЬ НЕ НАДО ЗДЕСЬ!", "这是 没有 标点 的 行", "Дом • Новости • Связь.", "no end", "Tous droits réservés.", "50 %"]
    assert verdicts("\n".join(good)) == good and verdicts("\n".join(bad)) == []
    assert verdicts("\n".join(x for pair in zip(good, bad) for x in pair)) == good[: len(bad)]
    # texts stand side by side in memory, but no rule sees across them
    got = quality_rules.judge(pa.array(["it says all rights", " reserved by them."]))
    assert got["n_lines_left"].tolist() == [0, 1]


def test_quality_verdicts(table):
    """`kept` against the rules written out line by line."""
    ends = lambda c: (unicodedata.category(c) in ("Pe", "Pf", "Po") and c not in quality_rules._NO_END) or c in "\"'" or 0xE01 <= ord(c) <= 0xEDF
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def passes(line):
        ws = word.findall(line)
        letters = [c for c in line if unicodedata.category(c)[0] == "L"]
        cuts = sum(c in quality_rules.SEPARATORS for c in line)
        shouts = len(ws) >= 5 and sum(unicodedata.category(c) in ("Lu", "Lt") for c in letters) > 0.6 * len(letters)
        return ends(ws[-1][-1]) and len(re.findall(r"[#*$%&|<>]", line)) <= 0.3 * len(ws) and not shouts and not (cuts >= 2 and len(ws) <= 4 * (cuts + 1)) and not quality_rules.BOILERPLATE.search(line.encode())

    got = {r["doc_id"]: r for r in quality_rules.quality_rule_documents(table("documents")).collect()}
    for r in table("documents").select("doc_id", "text").collect():
        lines = [x for x in (r["text"] or "").split("\n") if word.search(x)]
        left = sum(len(word.findall(x)) for x in lines if passes(x))
        assert got[r["doc_id"]]["n_words_left"] == left and got[r["doc_id"]]["kept"] == (not got[r["doc_id"]]["base_failed"] and left >= 0.5 * got[r["doc_id"]]["n_words"])


def test_quality_rules_odd(documents):
    assert quality_rules.clean_documents(documents([])).count() == 0
    assert [r["kept"] for r in quality_rules.quality_rule_documents(documents([(1, None), (2, "A fine line of words. " * 200_000)])).orderBy("doc_id").collect()] == [False, False]


# -- tokens


def test_coding():
    draw = np.random.default_rng(1)
    for numbers in ([], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], (draw.integers(0, 2**32, 999) >> draw.integers(0, 32, 999)).tolist()):
        control, data = tokens.encode(np.array(numbers, np.uint32))
        assert tokens.decode(control, data, len(numbers)).tolist() == numbers and len(control) == -(-len(numbers) // 4)


def test_tokens(documents, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 5000)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_path())
    odd = ["It's ok.,  (see), \"x\". Á É, ß x\x1cy", "a<|endoftext|>b", "x×, ÷. …, naïve, 3. 4,5", "ﬁ İstanbul, ΣΑΣ."]
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall() + [(1000 + n, t) for n, t in enumerate(odd)] + [(2000, None), (2000, ""), (2001, "q" * 50_000)]
    got = sorted(map(tuple, tokens.token_files(documents(rows)).collect()), key=lambda r: r[1])
    start = 0
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t)
    for g in got:  # ties are in the order of a hash of their texts
        each = [np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts[g[0]]]
        assert g in [(g[0], start, len(ids), zlib.crc32(ids.tobytes())) for ids in each], texts[g[0]]
        start += g[2]
    assert [g[0] for g in got] == sorted(d for d, _ in rows)
    assert tokens.token_files(documents([])).count() == 0


def test_tokens_without_ids(documents):
    rows = [(None, f"text number {n}") for n in range(50)] + [(None, "the same text")] * 50 + [(7, None)] * 3
    got = sorted(map(tuple, tokens.token_files(documents(rows)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None] * 100 + [7] * 3 and [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()


def test_other_tokenizers():
    """A file that is not of the kind that can be used word by word is encoded whole."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = tokens.Encoder(path), Tokenizer.from_file(path)
    texts = ["Some Text, with  spaces.", None, "", "ßé"]
    flat, counts = encoder.ids(pa.array(texts, pa.string()))
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not encoder.by_word and tokens.Encoder(tokens.default_path()).by_word
    assert counts.tolist() == list(map(len, want)) and flat.tolist() == sum(want, [])


def test_special_strings_in_any_case():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_path())
    texts = ["a <|ENDOFTEXT|> b", "one two <|STARTOFTEXT|> four", "x<|StartOfText|>y, z", "fresh words after it.", "a<|endoftext|>B", None, "<|EndOfText|"]
    encoder = tokens.Encoder(tokens.default_path())
    for _ in range(2):
        flat, counts = encoder.ids(pa.array(texts, pa.string()))
        want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == list(map(len, want)) and flat.tolist() == sum(want, [])
    assert len(encoder.known) == len(encoder.lengths)
    with pytest.raises(ValueError, match="2 words"):
        encoder._words(["a", "<|startoftext|>"])
