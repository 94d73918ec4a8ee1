"""Language ID: a linear-chain conditional random field over the words of a line.

Labels are the languages; a word's features are its prefixes and suffixes (affixes), its character n-grams, the word
itself and the lexicons (common words of each language) that hold it, hashed into one weight table. Transitions between
neighbouring words' labels are learned with them, so that a code-switched line keeps its runs. Forward-backward gives
every word's label probabilities; a text's language is the one with the most expected words, and its score is that
language's share of them. `word_languages` tells the label of every word.

A line of more than CHAIN words is labelled in chains of CHAIN words, each with OVERLAP words of its neighbours at either
side that are labelled with it and not counted, so that a line of any length takes CHAIN steps.

Fitting (full-batch Adam on the driver) sees at most `limit` texts of each language that has a learnable one, however
many languages there are, so the driver's work grows with their number: those of least id hash, of which the ones of up
to `max_chars` characters go first and longer ones give `max_chars` characters from their first letter on. Each word is
labelled with its text's language; languages weigh alike, in transitions too. Every word of every text is labelled at
prediction.

Texts that are null or have no letter are `und` with score 0; so are all texts if nothing could be learned. Words
without a letter are left out of the chain. Rows are labelled one by one: no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailframe.llm.common import few, remainder
from trailframe.llm.hashing import mix

BUCKETS = 1 << 17
LEXICON, FIT_TEXTS, FIT_CHARS, STEPS = 150, 250, 6_000, 40
#: Words that a Python worker remembers before it starts over; texts that it labels at once, and their characters.
REMEMBERED, AT_ONCE, AT_ONCE_CHARS = 200_000, 400, 2_000_000
CHAIN, OVERLAP = 400, 16
UND = "und"


def normal(word: str) -> str:
    """A word in lower case without what is no letter at its ends; "" if it has no letter."""
    word = word.lower()
    if word.isalpha():
        return word
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b]


def _hashed(kind: int, letters: np.ndarray) -> np.ndarray:
    """Buckets of one kind of feature, from the code points along the last axis."""
    x = np.full(letters.shape[:-1], kind, np.uint64)
    for k in range(letters.shape[-1]):
        x = x * np.uint64(0x100000001B3) + letters[..., k] + np.uint64(1)
    return (mix(x) % np.uint64(BUCKETS)).astype(np.int64)


def features(words: list[str]) -> np.ndarray:
    """Buckets of normal words of one length, a row each: the word, its affixes, its 2-grams and 3-grams with bounds."""
    n = len(words[0])
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)
    bounded = np.pad(points, ((0, 0), (1, 1)))
    bounded[:, -1] = 1
    columns = [_hashed(1, points)[:, None]]
    for k in range(1, min(4, n) + 1):
        columns += [_hashed(10 + k, points[:, :k])[:, None], _hashed(20 + k, points[:, n - k :])[:, None]]
    for k in (2, 3):
        columns.append(_hashed(30 + k, np.lib.stride_tricks.sliding_window_view(bounded, k, axis=1)))
    return np.hstack(columns)


def _flat(words: list[str], lexicons: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words, bounds by word), lexicon features last."""
    sizes = np.array([len(w) for w in words], np.int64)
    held = {i: x for i, w in enumerate(words) if (x := lexicons.get(w))}
    counts = 2 + 2 * np.minimum(4, sizes) + 2 * sizes
    if held:
        counts[list(held)] += [len(x) for x in held.values()]
    bounds = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros(bounds[-1], np.int64)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        rows = order[a:b]
        found = features([words[i] for i in rows])
        flat[bounds[rows][:, None] + np.arange(found.shape[1])] = found
    for i, x in held.items():
        flat[bounds[i + 1] - len(x) : bounds[i + 1]] = _hashed(40, np.array(x, np.uint64)[:, None])
    return flat, bounds


def _emissions(weights: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Summed weights of each word, over the root of its number of features."""
    if len(bounds) < 2:
        return np.zeros((0, weights.shape[1]))
    return np.add.reduceat(weights[flat], bounds[:-1], axis=0) / np.sqrt(np.diff(bounds))[:, None]


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: np.ndarray | bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word of chains that follow each other, and, with `pairs` (True, or a weight for each
    chain), the summed probabilities of label pairs."""
    n, labels = emissions.shape
    psi = np.exp(emissions - emissions.max(1, keepdims=True))
    step = np.exp(transitions - transitions.max())
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # chains longer than t
    alpha, beta = np.empty((n, labels)), np.ones((n, labels))
    now = None
    for t in range(longest):
        at = starts[: active[t]] + t
        now = psi[at] if t == 0 else (now[: active[t]] @ step) * psi[at]
        now = now / now.sum(1, keepdims=True)
        alpha[at] = now
    expected = np.zeros((labels, labels))
    told = pairs is not False
    weight = (np.ones(len(lengths)) if pairs is True else pairs)[order] if told else None
    back = np.ones((0, labels))
    for t in range(longest - 2, -1, -1):
        m = active[t + 1]
        at = starts[:m] + t
        if len(back) < m:
            back = np.vstack([back, np.ones((m - len(back), labels))])
        right = psi[at + 1] * back
        if told:
            joint = alpha[at][:, :, None] * step[None] * right[:, None, :]
            expected += (weight[:m, None, None] * joint / joint.sum((1, 2), keepdims=True)).sum(0)
        back = right @ step.T
        back = back / back.sum(1, keepdims=True)
        beta[at] = back
    gamma = alpha * beta
    return gamma / gamma.sum(1, keepdims=True), expected


def chains(text: str | None) -> list[list[str]]:
    """The words of every line."""
    return [line.split() for line in text.split("\n")] if text else []


def spans(n: int) -> list[tuple[int, int, int, int]]:
    """(start, end, first counted word, last + 1) of the chains that a line of n words is labelled in."""
    if n <= CHAIN + 2 * OVERLAP:
        return [(0, n, 0, n)]
    return [(max(0, a - OVERLAP), min(n, a + CHAIN + OVERLAP), a, min(n, a + CHAIN)) for a in range(0, n, CHAIN)]


class Tagger:
    """A fitted field."""

    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray, lexicons: dict[str, tuple[int, ...]]):
        self.languages, self.weights, self.transitions, self.lexicons = languages, weights, transitions, lexicons

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], steps: int = STEPS, rate: float = 0.15, ridge: float = 1e-4) -> Tagger:
        """Fit on (text, language) rows; deterministic."""
        languages = sorted({y for _, y in rows})
        place = {y: i for i, y in enumerate(languages)}
        lines = [(ws, place[y]) for t, y in rows for ws in ([w for w in map(normal, c) if w] for c in chains(t)) if ws]
        labels = len(languages)
        if not lines:
            return cls([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), {})
        seen: dict[str, Counter] = {}
        for ws, y in lines:
            for w in ws:
                seen.setdefault(w, Counter())[y] += 1
        lexicons: dict[str, list[int]] = {}
        for y in range(labels):
            for w in sorted((w for w in seen if seen[w][y]), key=lambda w: (-seen[w][y], w))[:LEXICON]:
                lexicons.setdefault(w, []).append(y)
        held = {w: tuple(x) for w, x in lexicons.items()}
        vocabulary = sorted(seen)
        number = {w: i for i, w in enumerate(vocabulary)}
        flat, bounds = _flat(vocabulary, held)
        lengths = np.array([len(ws) for ws, _ in lines], np.int64)
        words = np.array([number[w] for ws, _ in lines for w in ws], np.int64)
        gold = np.repeat(np.array([y for _, y in lines]), lengths)
        inner = np.ones(len(words), bool)
        inner[np.cumsum(lengths) - 1] = False
        owner = np.repeat(np.arange(len(vocabulary)), np.diff(bounds))
        scale = 1 / np.sqrt(np.diff(bounds))
        weights, transitions = np.zeros((BUCKETS, labels)), np.zeros((labels, labels))
        by_label = len(gold) / labels / np.maximum(1, np.bincount(gold, minlength=labels))
        balance, chain_balance = by_label[gold], by_label[[y for _, y in lines]]
        gold_pairs = np.diag(np.bincount(gold[inner], minlength=labels) * by_label)
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, transitions)]
        for s in range(1, steps + 1):
            gamma, pairs = forward_backward(_emissions(weights, flat, bounds)[words], lengths, transitions, pairs=chain_balance)
            gamma[np.arange(len(gold)), gold] -= 1
            gamma *= balance[:, None]
            g_words = np.stack([np.bincount(words, gamma[:, y], len(vocabulary)) for y in range(labels)], 1) * scale[:, None] / len(words)
            g = np.stack([np.bincount(flat, g_words[owner, y], BUCKETS) for y in range(labels)], 1) + ridge * weights / BUCKETS
            for x, d, (m1, m2) in zip((weights, transitions), (g, (pairs - gold_pairs) / max(1, inner.sum()) + 0.01 * transitions), moments, strict=True):
                m1 += 0.1 * (d - m1)
                m2 += 0.01 * (d * d - m2)
                x -= rate * (m1 / (1 - 0.9**s)) / (np.sqrt(m2 / (1 - 0.99**s)) + 1e-8)
        return cls(languages, weights.astype(np.float32), transitions, held)

    def labeller(self):
        """A function from lists of word lists to (their words' label probabilities in turn, which words are labelled,
        number of labelled words by list) that remembers words between calls."""
        known: dict[str, int] = {}
        table = np.zeros((1024, max(1, len(self.languages))))
        used = 0

        def learn(lists: list[list[str]]) -> None:
            nonlocal table, used
            new = set().union(*lists).difference(known)
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                table, used = np.zeros((1024, table.shape[1])), 0
                new = set().union(*lists)
            plain: dict[str, list[str]] = {}
            for w in new:
                plain.setdefault(normal(w), []).append(w)
            for w in plain.pop("", ()):
                known[w] = -1
            fresh = list(plain)  # spellings of one normal word share a row
            if used + len(fresh) > len(table):
                grown = np.zeros((2 * (used + len(fresh)), table.shape[1]))
                grown[:used] = table[:used]
                table = grown
            for a in range(0, len(fresh), 20_000):
                part = fresh[a : a + 20_000]
                table[used + a : used + a + len(part)] = _emissions(self.weights, *_flat(part, self.lexicons))
            for k, w in enumerate(fresh):
                for spelling in plain[w]:
                    known[spelling] = used + k
            used += len(fresh)

        def run(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            learn(lists)
            rows = [np.fromiter(map(known.__getitem__, c), np.int64, len(c)) for c in lists]
            cut, counted, lengths, sizes = [], [], [], []
            for row in rows:
                row = row[row >= 0]
                sizes.append(len(row))
                for a, b, first, last in spans(len(row)) if len(row) else ():
                    cut.append(row[a:b])
                    lengths.append(b - a)
                    inner = np.zeros(b - a, bool)
                    inner[first - a : last - a] = True
                    counted.append(inner)
            labelled = [row >= 0 for row in rows]
            if not cut:
                return np.zeros((0, len(self.languages))), np.concatenate(labelled) if labelled else np.zeros(0, bool), np.array(sizes, np.int64)
            gamma, _ = forward_backward(table[np.concatenate(cut)], np.array(lengths), self.transitions)
            return gamma[np.concatenate(counted)], np.concatenate(labelled), np.array(sizes, np.int64)

        return run

    def predictor(self):
        """A function from lists of texts to (languages, scores)."""
        label = self.labeller()

        def run(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
            if not self.languages:
                return [UND] * len(texts), np.zeros(len(texts))
            each = [(i, c) for i, t in enumerate(texts) for c in chains(t) if c]
            total = np.zeros((len(texts), len(self.languages)))
            if each:
                gamma, _, sizes = label([c for _, c in each])
                owner = np.repeat(np.array([i for i, _ in each]), sizes)
                for y in range(len(self.languages)):
                    total[:, y] = np.bincount(owner, gamma[:, y], len(texts))
            sums, best = total.sum(1), total.argmax(1)
            names = [self.languages[b] if s > 0 else UND for b, s in zip(best, sums, strict=True)]
            return names, np.where(sums > 0, total.max(1) / np.maximum(sums, 1e-12), 0.0).clip(0, 1)

        return run

    def word_languages(self, text: str | None) -> list[tuple[str, str]]:
        """(word, language) of every word of a text; words without a letter are `und`."""
        lists = [c for c in chains(text) if c]
        words = [w for c in lists for w in c]
        if not self.languages or not words:
            return [(w, UND) for w in words]
        gamma, labelled, _ = self.labeller()(lists)
        names = iter(np.array(self.languages, object)[gamma.argmax(1)])
        return [(w, next(names) if real else UND) for w, real in zip(words, labelled, strict=True)]


#: Hash buckets of a language and spare ids, so that map tasks already keep no more ids than they need.
_BUCKETS, _SPARE = 4, 2


def fit(docs: DataFrame, limit: int = FIT_TEXTS, max_chars: int = FIT_CHARS) -> Tagger:
    """Fit on at most `limit` texts of each language whose remainder modulo 4 is not 2.

    One pass over (doc_id, lang) chooses ids, one over the texts fetches spans of them: no more than _SPARE times `limit`
    a language reach the driver.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    learnable = rows.where(F.col("lang").isNotNull() & (remainder("_id", 4) != 2)).withColumn("hash", F.xxhash64("_id"))
    place = F.row_number().over(Window.partitionBy("lang", F.pmod("hash", F.lit(_BUCKETS))).orderBy("hash"))
    chosen = learnable.where(F.col("text").isNotNull()).select("lang", "hash").withColumn("place", place).where(F.col("place") <= -(-limit * _SPARE // _BUCKETS)).select("lang", "hash").distinct().collect()
    found = _spans(learnable, {(r[0], r[1]) for r in chosen}, limit, max_chars)
    poor = {r[0] for r in chosen} - {y for _, y in found}
    if poor:  # languages of which no chosen text has a letter: their lettered texts alone
        lettered = learnable.where(F.col("lang").isin(sorted(poor)) & F.col("text").rlike(r"\p{L}"))
        more = lettered.select("lang", "hash").withColumn("place", place).where(F.col("place") <= limit).select("lang", "hash").distinct().collect()
        found = sorted(found + _spans(lettered, {(r[0], r[1]) for r in more}, limit, max_chars), key=lambda p: p[1])
    return Tagger.fit(found)


def _spans(rows: DataFrame, chosen: set[tuple[str, int]], limit: int, max_chars: int) -> list[tuple[str, str]]:
    """(text, lang) of each language's first `limit` chosen lettered texts; long ones come last and give a span."""
    if not chosen:
        return []
    wanted = rows.sparkSession.createDataFrame(sorted(chosen), "lang string, hash long")
    long = F.length("text") > max_chars
    span = F.when(long, F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{max_chars - 1}}}", 0)).otherwise(F.col("text"))
    got = rows.join(F.broadcast(wanted), ["lang", "hash"]).select("lang", long.alias("long"), "hash", span.alias("span")).collect()
    by: dict[str, list[tuple[bool, int, str]]] = {}
    for r in got:
        if any(map(str.isalpha, r["span"])):
            by.setdefault(r["lang"], []).append((r["long"], r["hash"], r["span"]))
    return [(t, y) for y in sorted(by) for _, _, t in sorted(set(by[y]))[:limit]]


def tag_languages(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score; columns of these names are replaced."""
    rows = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    told = docs.sparkSession.sparkContext.broadcast(tagger)  # a table of BUCKETS rows, whatever the input

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = told.value.predictor()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in few(batch, at, AT_ONCE, AT_ONCE_CHARS):
                names, scores = predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def language_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    tagged = tag_languages(docs.select("doc_id", "text"), fit(docs))
    return tagged.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
