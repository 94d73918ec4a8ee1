"""The pipeline keeps clean documents and drops what its stages name."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np

import __spark_entry__
import corpus_pipeline
from trailframe.llm import tokens, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert tuple(docs.columns) == corpus_pipeline.DOCUMENTS
        assert 0.7 * seen < (seen := docs.count()) or name == "toxicity"
    assert docs.select("doc_id").distinct().count() == docs.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = sorted(map(tuple, out.collect()), key=lambda r: r[1])
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and [r[0] for r in rows] == sorted(r[0] for r in rows)
    assert all(a[1] + a[2] == b[1] for a, b in zip(rows, rows[1:]))


def brute_duplicates(docs):
    """The least doc_id of each class of texts whose 5-gram sets are alike to 0.8."""
    grams = {}
    for d, t, _ in docs:
        w = t.encode().split()
        grams[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    kept, rest = [], sorted(docs)
    texts = {d: t for d, t, _ in docs}
    while rest:
        seen, todo = set(), [rest[0][0]]
        while todo:
            a = todo.pop()
            seen.add(a)
            todo += [d for d, _, _ in rest if d not in seen and d not in todo and (texts[d] == texts[a] or len(grams[a] & grams[d]) >= 0.8 * len(grams[a] | grams[d]))]
        kept.append(rest[0])
        rest = [r for r in rest if r[0] not in seen]
    return kept


def brute_leaks(docs, items):
    """Documents without an item of 7 tokens or more of which 60 %, or 13 of 20 neighbouring tokens, lie equal on one diagonal."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [w for w in map(split, items) if len(w) >= 7]

    def leaks(words, item):
        at = collections.defaultdict(list)
        for i, w in enumerate(words):
            at[w].append(i)
        diagonals = collections.defaultdict(list)
        for k, w in enumerate(item):
            for i in at.get(w, ()):
                diagonals[i - k].append(k)
        return any(len(ks) >= 0.6 * len(item) or any(b - a < 20 for a, b in zip(ks, ks[12:])) for ks in diagonals.values())

    return [r for r in docs if not any(leaks(split(r[1]), w) for w in items)]


def brute_mix(docs):
    """The documents, each as often as it is taken."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes = collections.Counter()
    for _, t, s in docs:
        sizes[s] += size(t)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
    target, free = {}, set(sizes)
    while free:
        level = (1.5 * sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        target |= {s: 2 * sizes[s] for s in over} if over else {s: weight[s] * level for s in free}
        free = free - over if over else set()
    out = []
    for d, t, s in docs:
        rate = target[s] / sizes[s]
        u = int(hashlib.md5(f"mix-2:{d}:{hashlib.md5(t.encode()).hexdigest()}:1".encode()).hexdigest()[:12], 16) / 2**48
        out += [(d, t, s)] * (int(rate) + (u < rate - int(rate)))
    return out


def test_brute_force(spark):
    """Every stage, and the whole run, against plain Python with the same fitted machine."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()
    items = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    scores = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")).scores([t for _, t, _ in want])
    brute = [lambda rows: [r for r, x in zip(rows, scores, strict=True) if x < 0.5], brute_duplicates, lambda rows: brute_leaks(rows, items), brute_mix]
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:4], brute, strict=True):
        docs, before, want = corpus_pipeline.written(stage(spark, docs, SF), name), want, plain(want)
        assert sorted(map(tuple, docs.select("doc_id", "text", "source").collect())) == sorted(want), name
        assert len(want) != len(before), f"{name} has nothing to do here"
    tokenizer, start, rows = Tokenizer.from_file(tokens.default_path()), 0, []
    for d, t, _ in sorted(want):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, tokens.END], "<u4")
        rows.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1]) == rows


def test_odd_rows(spark):
    """Nulls in any column, empty, repeated and long rows, ties and extra columns pass through every stage."""
    text = "A plain sentence of quite harmless words, number {}, stands here for a while and ends."
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, text.format(1), None, None, None), (None, text.format(1), None, None, None), (3, text.format("x y z"), "en", "s", 9), (3, "another text altogether that no other row is like at all", "de", "t", 1)]
    rows += [(4, " ".join(f"w{n}" for n in range(60_000)), "en", "s", 5), (5, "\n \t", "en", None, 3), (6, None, "en", "s", None)]
    docs = spark.createDataFrame([(*r, 1.5, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, key string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert tuple(docs.columns) == corpus_pipeline.DOCUMENTS
        if name == "near_duplicates":  # nulls and the empty text are one class, white space is its own
            assert sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect()) == sorted([(1, ""), (0, text.format(1)), (3, rows[5][1]), (4, rows[6][1]), (5, "\n \t"), (3, text.format("x y z"))])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() > 0


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
