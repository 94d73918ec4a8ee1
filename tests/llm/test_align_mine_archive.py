"""Alignment, collocations and archives against brute force, and on empty, null, repeated and tied rows."""

import collections
import gzip
import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailframe.llm import alignment, collocations, warc

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "zwei drei"), (6, "#|!? 123"), (7, "a b c " * 3000), (8, "  two  spaces "), (9, "with ▁ mark"), (10, "<|endoftext|> and <s>x</s> <0x41>"), (11, "日本語 テキスト 😀 é"), (12, "=" * 5000), (13, "x\x00y\r\nz"), (14, "q" * 300 + " r")]


# -- alignment


def spelled_alignment(rows):
    """Every row's columns by the contract's words: all pairs of tokens compared."""
    a_path, b_path = alignment.default_paths()
    a_side, b_side = alignment.ByteLevel(a_path), alignment.Pieces(b_path)
    found, held = [], collections.Counter()
    for doc_id, text in rows:
        sides = []
        for side in (a_side, b_side):
            ids = side.ids([text or ""])[0]
            ends, at = [], 0
            for i in ids:
                at += len(side.spelled[i])
                ends.append(at)
            sides.append((ids, ends, b"".join(side.spelled[i] for i in ids)))
        (a, a_ends, a_raw), (b, b_ends, b_raw) = sides
        if not text or not a_raw == b_raw == b" " + text.encode():
            found.append((doc_id, 0, 0, 0, [], ""))
            continue
        linked = [(x, y) for x, s, e in zip(a, [0, *a_ends], a_ends) for y, t, f in zip(b, [0, *b_ends], b_ends) if s < f and t < e]
        cuts = sorted(set(a_ends) & set(b_ends))
        groups = ";".join("|".join(",".join(str(i) for i, e in zip(ids, ends) if lo < e <= hi) for ids, ends in ((a, a_ends), (b, b_ends))) for lo, hi in zip([0, *cuts], cuts))
        held.update(set(linked))
        found.append((doc_id, len(a), len(b), len(cuts), linked, hashlib.sha256(groups.encode()).hexdigest()))
    best = collections.defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return sorted(((d, na, nb, ng, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha) for d, na, nb, ng, links, sha in found), key=str)


@pytest.mark.parametrize("bound", [alignment.BROADCAST, 20, 0])
def test_alignment(spark, documents, bound):
    texts = [(r["doc_id"], r["text"][:600]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).collect()]
    rows = ODD[:8] + [(7, "a b c " * 40)] + ODD[9:12] + [(12, "=" * 100), *ODD[13:]] + texts
    got = alignment.aligned_documents(documents(rows), bound=bound)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == spelled_alignment(rows)


def test_units_equal_whole_texts(documents):
    draw, parts = random.Random(1), ["a", "Word", " ", "\n", "\t", ".", "é", "日", "'s", "12", "<s>", "▁", " ", "  "]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 30))) for _ in range(400)] + ["", *(t for _, t in ODD if t)]
    own = alignment.Aligner(*alignment.default_paths())
    assert own.by_unit
    apart = own.units(pa.array(texts))
    own.by_unit = False
    whole = own.units(pa.array(texts))
    for side in (0, 1):
        assert put_together(apart, side) == put_together(whole, side)


def put_together(made, side):
    """Every text's (ids, ends) from its units."""
    sides, numbers, number = made
    ids, ends, sizes = (x.tolist() for x in sides[side])
    starts, out, at = [sum(sizes[:k]) for k in range(len(sizes))], [], 0
    for n in number.tolist():
        units = [slice(starts[u], starts[u] + sizes[u]) for u in numbers[at : at + n].tolist()]
        found, last = [], 0
        for u in units:
            found += [(i, last + e) for i, e in zip(ids[u], ends[u])]
            last = found[-1][1]
        out.append(found)
        at += n
    return out


def test_long_group_is_linear(documents):
    """A text without a space, of many tokens: as many links as ends."""
    row = alignment.aligned_documents(documents([(1, "xq" * 40_000)])).collect()[0]
    assert row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"] > 0


def test_no_documents_to_align(documents):
    assert alignment.aligned_documents(documents([])).collect() == []


# -- collocations


def counted_phrases(rows, least, top):
    """The contract by plain counting."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((" ".join(p), a, l, r, n[lang], score))
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, k, *x) for k, x in enumerate(found[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("kinds", "shard", "bound"), [(3, 1 << 24, 200_000), (8, 300, 5), (40, 2000, 0)])
def test_collocations(spark, kinds, shard, bound, monkeypatch):
    draw = random.Random(kinds)
    words = ["Élan", "a", "B", "b", "the", "x\x1cy", " ", "日本", "z-z", *(f"w{n}" for n in range(40))][:kinds]
    rows = [(draw.choice(["en", "de", None, "und", ""]), "".join(draw.choice(words) + draw.choice([" ", " ", "\t ", ". ", "\n", "!"]) for _ in range(draw.randrange(0, 60)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), ("en", " . \n"), *([("en", "New York city hall, new york")] * 20), ("en", "long" * 3000 + " word")]
    docs = spark.createDataFrame([(lang, t, 1.5, 7) for lang, t in rows], "lang string, text string, score double, rank int").repartition(4)
    monkeypatch.setattr(collocations, "BROADCAST", bound)
    monkeypatch.setattr(collocations.scored, "__defaults__", (bound,))
    got = collocations.collocations(docs, 8, 30, shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == counted_phrases(rows, 8, 30)


def test_automaton_states():
    """Every phrase is in one state, and states are the sets of equal places."""
    draw = random.Random(3)
    codes = [draw.randrange(3) for _ in range(200)]
    joined = [i > 0 and draw.random() > 0.1 for i in range(200)]
    import numpy as np

    states = collocations.automaton(np.array(codes), np.array(joined), 4)
    ends = collections.defaultdict(set)
    for i in range(200):
        for k in range(1, 5):
            if all(joined[i - k + 2 : i + 1]) and i - k + 1 >= 0:
                ends[tuple(codes[i - k + 1 : i + 1])].add(i)
    got = {tuple(codes[e - n + 1 : e + 1]): c for n, es, cs in collocations.phrases(states, 1) for e, c in zip(es.tolist(), cs.tolist())}
    assert got == {p: len(s) for p, s in ends.items()}
    assert sum(int(s.open.sum()) for s in states) == len({(frozenset(s)) for s in ends.values()})
    for d in range(1, 4):
        for e, parent in zip(states[d].ends.tolist(), states[d].link.tolist()):
            f = int(states[d - 1].ends[parent])
            assert codes[e - d + 1 : e + 1] == codes[f - d + 1 : f + 1]


def test_arithmetic_beyond_64_bits(spark):
    big = 1 << 60
    counts = spark.createDataFrame([("en", "x y", big, 2), ("en", "x", big + 5, 1), ("en", "y", big + 3, 1)], "lang string, phrase string, n long, words int")
    row = collocations.scored(counts.where("words = 2").selectExpr("lang", "phrase", "n AS a", "words"), counts).collect()[0]
    assert (row["l"], row["r"], row["score"]) == (big + 5, big + 3, 2_000_000 * big // (2 * big + 8))


def test_bits_agree_with_spark(spark):
    words = ["a", "é", "日本", "x" * 100]
    rows = spark.createDataFrame([("de", w) for w in words], "lang string, phrase string")
    has = collocations.bitmap(rows, 1)
    assert collocations._has(has, collocations.word_hashes("de", words)).all()
    assert collocations._has(has, collocations.word_hashes("en", [f"no{n}" for n in range(1000)])).mean() < 0.02


def test_no_documents_to_mine(documents):
    assert collocations.collocations(documents([])).collect() == []
    assert collocations.collocations(documents(ODD[:4])).collect() == []


# -- archives

LONG, OTHER = "<p>" + "x" * 1200, "é" * 500
PAGES = [(1, "http://a.example/x", LONG), (2, "http://A.example:80/y?q=1#f", LONG), (3, None, LONG), (None, "https://u:p@b.a.example", LONG), (4, "", None), (5, "no scheme\twith tab", ""), (6, "http://10.0.0.1/", OTHER), (7, "http://a.example/x", OTHER), (7, "http://a.example/x", "short"), (8, "http://é.example/ü", "short"), (9, "http://a.example/x", "z" * 999), (10, "http://a.example/x", "z" * 999)]


def expected_pages(rows):
    keeper = {}
    for page_id, _, html in rows:
        if page_id is not None:
            keeper[html or ""] = max(page_id, keeper.get(html or "", page_id))
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        to = keeper.get(html or "")
        again = len(raw) >= 1000 and to is not None and to != page_id
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "extra", 1) for p in PAGES], "page_id long, url string, html string, key string, offset int").repartition(3)


def all_bytes(spark, folder):
    return {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(folder).collect()}


@pytest.mark.parametrize("broadcast", [warc.BROADCAST, 0])
@pytest.mark.parametrize("block", [1024, 2])
def test_archived_pages(spark, pages, broadcast, block, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST", broadcast)
    monkeypatch.setattr(warc, "BLOCK", block)
    got = warc.archived_pages(pages)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == expected_pages(PAGES)


def test_archives_are_warc_files(spark, pages):
    captures = warc.write_archives(pages)
    files = all_bytes(spark, captures.first()["folder"])
    seen = []
    for name, raw in files.items():
        whole = gzip.decompress(raw)  # records end to end: head, empty line, block, two empty lines
        while whole:
            head, _, rest = whole.partition(b"\r\n\r\n")
            size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
            if b"WARC-Type: warcinfo" not in head:
                seen.append(warc.parse(head + b"\r\n\r\n" + rest[:size]))
            whole = rest[size + 4 :]
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in seen), key=str) == expected_pages(PAGES)
    assert {r["payload"] for r in seen if r["record_type"] == "response"} == {(h or "").encode() for _, _, h in PAGES}
    for r in captures.collect():
        assert warc.parse(zlib.decompress(files[r["file"]][r["offset"] : r["offset"] + r["length"]], 31))["page_id"] == r["page_id"]


def test_lookup_bisects(spark, monkeypatch):
    """Keys before, between and after all blocks, and one that fills several blocks; by either way through the directory."""
    monkeypatch.setattr(warc, "BLOCK", 4)
    rows = [(n, f"http://h{n % 13}.example/{'same' if n % 3 == 0 else n}", f"text {n}") for n in range(120)] + [(1000 + n, "http://hot.example/", "hot") for n in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    directory = warc.write_index(warc.write_archives(pages))
    keys = pages.select(warc.url_key(F.col("url")).alias("key"))
    by_key = collections.defaultdict(set)
    for (page_id, _, _), key in zip(rows, [r["key"] for r in spark.createDataFrame(rows, "page_id long, url string, html string").select(warc.url_key(F.col("url")).alias("key")).collect()]):
        by_key[key].add(page_id)
    asked = [*list(by_key)[::2], "example,hot)/", "", "zzz", "example,h5)/sam", "example,h5)/same0"]
    wanted = spark.createDataFrame([(k,) for k in asked + asked[:3]], "key string")
    for bound in (warc.BROADCAST, 0):
        monkeypatch.setattr(warc, "BROADCAST", bound)
        got = warc.lookup(directory, wanted).collect()
        assert sorted((r["key"], r["page_id"]) for r in got) == sorted((k, i) for k in set(asked) for i in by_key.get(k, ()))
    assert keys.count() == 150


def test_keys(spark):
    urls = {"http://www.Example.com/Path?q=1#x": "com,example,www)/Path?q=1", "https://u@h.org:8080": "org,h:8080)/", "//h.org?x": "org,h)/?x", "http://1.2.3.4/a": "1.2.3.4)/a", "plain/path": "plain/path", None: ""}
    rows = spark.createDataFrame([(u, k) for u, k in urls.items()], "url string, key string").select(warc.url_key(F.col("url")).alias("got"), "key").collect()
    assert [r["got"] for r in rows] == [r["key"] for r in rows]


def test_no_pages(spark):
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_damaged_record_is_an_error():
    made = warc.record(1, "http://a/", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    raw = gzip.decompress(made)
    assert warc.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError, match="not what its head says"):
        warc.parse(raw.replace(b"payload", b"paylord"))


# -- bounds of fitting samples, broken markup


def test_labelled_sample_is_bounded_in_rows(spark):
    """Ids that are repeated, and rows without ids, take no one else's place; long texts keep their class."""
    from trailframe.llm import common

    docs = [(None, f"none {n}") for n in range(2000)] + [(7, f"seven {n % 3}") for n in range(3000)] + [(n, f"text {n}") for n in range(20, 120)] + [(n, f"long {n} " * 50) for n in range(200, 230)]
    labels = [(7, 0)] * 500 + [(None, 1)] * 50 + [(n, 0) for n in range(20, 120)] + [(n, 1) for n in range(200, 230)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got, _ = common.labelled_sample(d, spark.createDataFrame(labels, "doc_id long, quality int"), "quality", 40, 100)
    zeros, ones = ([t for t, y in got if y == v] for v in (0, 1))
    assert len(zeros) == len(set(zeros)) == 40 and not any(t.startswith("none") for t in zeros)
    assert 15 <= len(ones) <= 30 and all(len(t) == 100 for t in ones)


def test_one_class_gives_its_share():
    from trailframe.llm import quality_net

    assert quality_net.Net.fit([("a", 0)] * 98).constant == 1 / 100 and quality_net.Net.fit([("a", 1)] * 98).constant == 99 / 100 and quality_net.Net.fit([]).constant == 0.5


@pytest.mark.parametrize("mark", ["<!", "<![CDATA[", "<?"])
def test_unclosed_markup_is_linear(mark):
    import time

    from trailframe.llm import html_text

    began, page = time.time(), mark * (1_000_000 // len(mark))
    at, n = 0, 0
    while m := html_text._TOKEN.search(page, at):
        at, n = m.end(), n + 1
    assert time.time() - began < 2 and n <= 1
