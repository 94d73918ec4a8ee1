"""Toxicity: a subsequence string-kernel support vector machine over Nyström landmarks, on sentences.

Sentences. A text is cut into sentences at line ends and at marks that end one (a full stop, exclamation or question mark
before white space, or the marks of scripts without spaces). A sentence is the letters and digits of its words with one
boundary between words; marks are left out, and three or more single letters in a row are one word. Letters of every
script count: accents fall off Latin letters, all others are hashed into the kernel's alphabet.

Kernel. Stretches of up to PHRASE neighbouring words of a sentence are compared by their common subsequences of ORDER
characters, boundaries among them, each weighted DECAY**span on either side, spans up to SPAN: an insult keeps most of
its subsequences when characters or spaces are inserted or left out, and an insult of several harmless words is a stretch
like any other. Each side is divided by the weight norm of a stretch of its length, which keeps the kernel positive
semi-definite. A sentence is as toxic as its strongest stretch, a text as its strongest sentence, whatever their lengths.

Landmarks. The stretches most tied to the toxic class in the fitting sample, and common and similar clean ones; the
Nyström map is K_mm^(-1/2) k(stretch, landmarks). As kernel and machine are linear in the subsequence weights, the
fitted machine folds into one table from subsequence codes to weights, which gives the very same decision value. Sums of
table values over a running text then give all its stretches' values: nothing is remembered between texts.

Labels belong to whole texts, so the machine is fitted on bags of sentences: every sentence of a clean text is clean (its
strongest stretch is a hard negative), and a toxic text holds at least one toxic sentence (its witness, chosen again in
each round). At most FIT_TEXTS texts of each class of up to FIT_CHARS characters are learned from.

Nulls, empty texts and texts without letters have no stretch and get the score of the constant part. Without both classes
among the labels nothing is toxic.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailframe.llm import hashing
from trailframe.llm.common import few, labelled_sample, remainder

ORDER, SPAN, DECAY, PHRASE = 4, 8, 0.6, 3
#: Bounds of the fitting sample: texts of each class, and their length in characters.
FIT_TEXTS, FIT_CHARS = 1500, 20_000
LANDMARKS, TOXIC_MARKS, BACKGROUND, HARD_NEGATIVES = 320, 140, 16, 4000
#: A stretch with a larger log-likelihood ratio is a sure witness; of several words it must have SEVERAL, as there are so many; rounds of choosing witnesses and hard negatives.
SURE, SEVERAL, ROUNDS = 6.0, 9.0, 3
#: Words longer than LONG letters are cut into pieces of PIECE.
LONG, PIECE = 24, 12
#: Characters that are read at once; longer texts are read in parts, cut at white space. Texts a slice.
AT_ONCE, SLICE = 1 << 18, 500
_CHUNK = 1 << 15

_SKIP = [(c, 1 + max(c)) for c in itertools.combinations(range(1, SPAN), ORDER - 1)]
_OFFSETS = [(0, *c) for c, _ in _SKIP]
_WEIGHTS = np.array([DECAY**s for _, s in _SKIP], np.float32)
_CODES = 32**ORDER
#: Classes of characters: letters are 1 to 30 and the boundary is 31; marks are dropped.
_MARK, _BOUNDARY, _SPACE, _STOP, _FULL_STOP, _LINE, _TEXT = 0, 31, 32, 33, 34, 35, 36


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point below 0x20000; those beyond are letters, by hash."""
    table = np.zeros(0x20000, np.uint8)
    points = np.arange(len(table), dtype=np.uint64)
    hashed = (1 + hashing.mix(points) % np.uint64(30)).astype(np.uint8)
    for p in range(len(table)):
        c = chr(p)
        if c.isalnum():
            base = unicodedata.normalize("NFKD", c)[0].lower() if p > 127 else c
            table[p] = ord(base) - 96 if "a" <= base <= "z" else hashed[p]
        elif c.isspace():
            table[p] = _SPACE
    for c in ".!?…":
        table[ord(c)] = _STOP
    for c in "。！？।॥۔؟":
        table[ord(c)] = _FULL_STOP
    table[[10, 13, 0x2028, 0x2029]] = _LINE
    table[0] = _TEXT
    return table


class Stream(NamedTuple):
    """Letters and boundaries of many texts in turn, and their stretches [start, end]."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sentences: np.ndarray
    texts: np.ndarray

    def unit(self, k: int) -> bytes:
        return self.codes[self.starts[k] : self.ends[k] + 1].tobytes()


def _parts(text: str) -> Iterator[str]:
    """A text in parts of up to AT_ONCE characters, cut at white space where there is some."""
    at = 0
    while len(text) - at > AT_ONCE:
        cut = max(text.rfind(" ", at + AT_ONCE // 2, at + AT_ONCE), text.rfind("\n", at + AT_ONCE // 2, at + AT_ONCE))
        cut = cut if cut > at else at + AT_ONCE
        yield text[at:cut]
        at = cut
    yield text[at:]


def stream(texts: list[str]) -> Stream:
    """The stretches of texts, which hold no NUL."""
    points = np.frombuffer("\0".join([*texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.where(points < 0x20000, _classes()[np.minimum(points, 0x1FFFF)], (1 + points % 30).astype(np.uint8))
    following = np.append(kinds[1:], _TEXT) if len(kinds) else kinds
    stop = (kinds >= _FULL_STOP) | ((kinds == _STOP) & (following >= _SPACE) & (following != _STOP))
    letters = np.flatnonzero((kinds > 0) & (kinds < _BOUNDARY))
    none = np.zeros(0, np.int32)
    if not len(letters):
        return Stream(np.zeros(SPAN, np.uint8), none, none, none, none)
    word = np.cumsum(stop | (kinds == _SPACE), dtype=np.int32)[letters]
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    sentence, text = np.cumsum(stop, dtype=np.int32)[letters[starts]], np.cumsum(kinds == _TEXT, dtype=np.int32)[letters[starts]]
    # runs of single letters are one word
    single = np.diff(np.append(starts, len(letters))) == 1
    new = np.ones(len(starts), bool)
    new[1:] = ~(single[1:] & single[:-1] & (sentence[1:] == sentence[:-1]))
    run = np.cumsum(new) - 1
    new |= np.bincount(run)[run] < 3
    starts, sentence, text = starts[new], sentence[new], text[new]
    # long words are pieces
    lengths = np.diff(np.append(starts, len(letters)))
    many = np.where(lengths > LONG, -(-lengths // PIECE), 1)
    first = np.zeros(int(many.sum()), bool)
    first[np.cumsum(many) - many] = True
    nth = np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
    starts, sentence, text = np.repeat(starts, many) + nth * PIECE, np.repeat(sentence, many), np.repeat(text, many)
    # a boundary stands before every word and at the end
    bounds = np.cumsum(first)
    stops = np.append(starts[1:], len(letters))
    codes = np.zeros(len(letters) + int(bounds[-1]) + 1 + SPAN, np.uint8)
    codes[: len(codes) - SPAN] = _BOUNDARY
    codes[np.arange(len(letters)) + np.repeat(bounds, stops - starts)] = kinds[letters]
    begin = starts + bounds - first
    end = stops + bounds - 1 + np.append(first[1:], True)
    found = []
    for k in range(PHRASE):
        at = np.arange(max(0, len(starts) - k))
        at = at[sentence[at] == sentence[at + k]]
        found.append((begin[at], end[at + k], sentence[at], text[at]))
    return Stream(codes, *(np.concatenate(x).astype(np.int32) for x in zip(*found, strict=True)))


@functools.cache
def _spans() -> np.ndarray:
    """How many offset patterns have each span."""
    return np.bincount([s for _, s in _SKIP], minlength=SPAN + 1)


def _norms(lengths: np.ndarray) -> np.ndarray:
    """The square root of the summed squared weights of a stretch's subsequences, by its length."""
    total = np.zeros(len(lengths))
    for s in range(ORDER, SPAN + 1):
        total += np.maximum(np.asarray(lengths) - s + 1, 0) * (_spans()[s] * DECAY ** (2 * s))
    return np.sqrt(np.where(total > 0, total, 1.0))


def values(s: Stream, table: np.ndarray) -> np.ndarray:
    """Of every stretch: the sum over its subsequences of span weight times table[code], over its norm."""
    n = len(s.codes) - SPAN
    sums = np.zeros((SPAN, n + 1))
    for at in range(0, n, _CHUNK):
        upto = min(at + _CHUNK, n)
        x = s.codes[at : upto + SPAN].astype(np.int32)
        m = upto - at
        total = np.zeros((SPAN, m), np.float32)
        head = x[:m] << 15
        for a in range(1, SPAN - 2):
            two = head | (x[a : a + m] << 10)
            for b in range(a + 1, SPAN - 1):
                three = two | (x[b : b + m] << 5)
                for last in range(b + 1, SPAN):
                    total[last] += table[three | x[last : last + m]]
        sums[:, at + 1 : upto + 1] = total
    out = np.zeros(len(s.starts))
    for last in range(ORDER - 1, SPAN):
        row = np.cumsum(sums[last])
        out += DECAY ** (last + 1) * (row[np.maximum(s.ends - last + 1, s.starts)] - row[s.starts])
    return out / _norms(s.ends - s.starts + 1)


def _letters(batch: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in batch), np.uint8).reshape(len(batch), width).astype(np.int32)


def _codes(offsets: tuple[int, ...], letters: np.ndarray) -> np.ndarray:
    """Subsequence codes of one offset pattern at every start; 0 where it runs over the end."""
    n = letters.shape[1] - SPAN + 1
    code = letters[:, offsets[0] : offsets[0] + n]
    for o in offsets[1:]:
        code = (code << 5) | letters[:, o : o + n]
    return np.where(letters[:, offsets[-1] : offsets[-1] + n] > 0, code, 0)


def _map(units: list[bytes]) -> list[dict[int, float]]:
    """The explicit feature map: code -> summed weight, over the norm."""
    out = []
    for w in units:
        letters = _letters([w], len(w) + SPAN - 1)
        norm, got = float(_norms(np.array([len(w)]))[0]), Counter()
        for offsets, x in zip(_OFFSETS, _WEIGHTS, strict=True):
            for c in _codes(offsets, letters)[0]:
                if c:
                    got[int(c)] += float(x) / norm
        out.append(dict(got))
    return out


def _kernel(units: list[bytes], landmarks: list[dict[int, float]]) -> np.ndarray:
    """k(unit, landmark) for every pair."""
    out = np.zeros((len(units), len(landmarks)))
    rows = np.zeros(_CODES, np.int32)
    used = sorted(set().union(*landmarks))
    rows[used] = np.arange(1, len(used) + 1)
    small = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for j, landmark in enumerate(landmarks):
        small[rows[list(landmark)], j] = list(landmark.values())
    order = sorted(range(len(units)), key=lambda i: len(units[i]))
    for at in range(0, len(order), 500):  # units of like lengths together
        places = order[at : at + 500]
        part = [units[i] for i in places]
        letters = _letters(part, len(part[-1]) + SPAN - 1)
        total = np.zeros((len(part), len(landmarks)))
        for offsets, w in zip(_OFFSETS, _WEIGHTS, strict=True):
            found = rows[_codes(offsets, letters)]
            word, start = np.nonzero(found)  # few subsequences are a landmark's
            if len(word):
                first = np.flatnonzero(np.diff(word, prepend=-1))
                total[word[first]] += w * np.add.reduceat(small[found[word, start]], first, axis=0)
        out[places] = total / _norms(np.array(list(map(len, part))))[:, None]
    return out


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights of a linear machine under squared hinge loss, by Newton's method; the last column of x is the bias's."""
    w, reg = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    reg[-1, -1] = 1e-6

    def loss(w: np.ndarray) -> float:
        return float(w @ reg @ w + (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum())

    now = loss(w)
    for _ in range(50):
        active = np.flatnonzero(y * (x @ w) < 1)
        square, side = reg.copy(), np.zeros(len(w))
        for at in range(0, len(active), 1000):  # a few rows at a time: no copy of the whole matrix
            k = active[at : at + 1000]
            rows = x[k].astype(np.float64)
            weighted = rows * weight[k, None]
            square += weighted.T @ rows
            side += weighted.T @ y[k]
        step, size = np.linalg.solve(square, side) - w, 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * before:
            break
    return w


def _mapped(units: list[bytes], maps: list[dict[int, float]], whiten: np.ndarray) -> np.ndarray:
    """The units' coordinates under the Nyström map, and a column of ones; a few rows at a time."""
    out = np.ones((len(units), len(maps) + 1), np.float32)
    for at in range(0, len(units), 1000):
        out[at : at + 1000, :-1] = _kernel(units[at : at + 1000], maps) @ whiten
    return out


class Bags:
    """The stretches of some texts, with hashes; texts are numbered as given."""

    def __init__(self, texts: list[str]):
        self.streams: list[tuple[Stream, np.ndarray]] = []  # with the stretches' hashes
        self.size = len(texts)
        for at in range(0, len(texts), 50):
            s = stream([t.replace("\0", " ") for t in texts[at : at + 50]])
            s = s._replace(texts=s.texts + np.int32(at))
            self.streams.append((s, hashing.range_hashes(hashing.prefix_hashes(s.codes), s.starts, s.ends + 1)))

    def seen(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct hashes, number of texts with each)."""
        each = []
        for s, h in self.streams:
            order = np.lexsort((h, s.texts))
            new = np.ones(len(h), bool)
            new[1:] = (np.diff(s.texts[order]) != 0) | (h[order][1:] != h[order][:-1])
            each.append(h[order][new])
        return np.unique(np.concatenate(each), return_counts=True) if each else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def units(self, hashes: np.ndarray) -> dict[int, bytes]:
        """The stretches of the given hashes."""
        out: dict[int, bytes] = {}
        for s, h in self.streams:
            for k in np.flatnonzero(np.isin(h, hashes)):
                out.setdefault(int(h[k]), s.unit(k))
        return out

    def strongest(self, table: np.ndarray, limit: int) -> list[tuple[int, bytes, float]]:
        """(hash, stretch, value) of the strongest stretches of all sentences, the strongest first, each once."""
        found: dict[int, tuple[float, bytes]] = {}
        for s, h in self.streams:
            v = values(s, table)
            order = np.lexsort((-v, s.sentences))
            first = order[np.flatnonzero(np.diff(s.sentences[order], prepend=-1))]
            for k in first[np.argsort(-v[first], kind="stable")][: limit // 4]:
                found[int(h[k])] = (-float(v[k]), s.unit(k))
        ranked = sorted((v, u, h) for h, (v, u) in found.items())
        return [(h, u, -v) for v, u, h in ranked[:limit]]

    def tops(self, table: np.ndarray) -> np.ndarray:
        """The value of each text's strongest stretch; -inf if it has none."""
        out = np.full(self.size, -np.inf)
        for s, _ in self.streams:
            np.maximum.at(out, s.texts, values(s, table))
        return out


def _counts(hashes: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of hashes by a sorted table of them; 0 for those that it lacks."""
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[place] == hashes, counts[place], 0)


def _ratio(p: np.ndarray, q: np.ndarray, np_: int, nq: int) -> np.ndarray:
    """Log-likelihood ratios of presence in p of np_ toxic and q of nq clean texts; 0 where it leans to clean ones."""

    def ll(k: np.ndarray, m: int, r: np.ndarray) -> np.ndarray:
        return k * np.log(np.maximum(r, 1e-12)) + (m - k) * np.log(np.maximum(1 - r, 1e-12))

    both = (p + q) / (np_ + nq)
    return np.where(p / np_ > q / nq, ll(p, np_, p / np_) + ll(q, nq, q / nq) - ll(p, np_, both) - ll(q, nq, both), 0.0)


class Machine:
    """A fitted machine: a stretch's value is its sum over the table, plus bias; a text's score sigmoid(a * value + b)."""

    def __init__(self, table: np.ndarray, bias: float, a: float, b: float):
        self.table, self.bias, self.a, self.b = table, bias, a, b

    @classmethod
    def constant(cls) -> Machine:
        """For samples without both classes: nothing is toxic."""
        return cls(np.zeros(1, np.float32), -1.0, 1.0, -3.0)

    @classmethod
    def fit(cls, rows: list[tuple[str, int]]) -> Machine:
        """Fit on (text, label) rows; deterministic."""
        toxic, clean = Bags([t for t, y in rows if y == 1]), Bags([t for t, y in rows if y == 0])
        if not toxic.size or not clean.size:
            return cls.constant()
        hashes, p = toxic.seen()
        own, n_own = clean.seen()
        q = _counts(hashes, own, n_own)
        lean = _ratio(p, q, toxic.size, clean.size)
        lean_of = dict(zip(hashes[lean > 2].tolist(), lean[lean > 2].tolist(), strict=True))
        named = toxic.units(hashes[lean > 2])
        # too short to have a subsequence of their own, or of several words and not sure enough
        for h, u in named.items():
            if len(u) < ORDER + 1 or (u.count(_BOUNDARY) > 2 and lean_of[h] < SEVERAL):
                del lean_of[h]
        ranked = sorted(lean_of, key=lambda h: (-lean_of[h], named[h]))
        marks = [named[h] for h in ranked[:TOXIC_MARKS]]
        if not marks:
            return cls.constant()
        toxic_marks = len(marks)
        near = np.zeros(_CODES, np.float32)
        for m in _map(marks):
            for c, v in m.items():
                near[c] = max(near[c], v)
        # clean landmarks: the commonest stretches, and those that look most like toxic ones
        in_clean = lambda keys: np.maximum(1, _counts(np.array(list(keys), np.uint64), own, n_own))
        ranked_clean = [x for x in clean.strongest(near, HARD_NEGATIVES) if x[0] not in lean_of]
        hard = {h: u for h, u, _ in ranked_clean}
        common = clean.units(own[np.argsort(-n_own, kind="stable")[:BACKGROUND]])
        likeness = np.array([v for _, _, v in ranked_clean]) * np.log1p(in_clean(hard))
        alike = [u for _, u in sorted(zip(-likeness, hard.values(), strict=True))]
        rest = list(dict.fromkeys([*common.values(), *alike]))
        marks += [u for u in rest if u not in set(marks)][: LANDMARKS - toxic_marks]
        maps = _map(marks)
        eigen, vectors = np.linalg.eigh(_kernel(marks, maps))
        whiten = (vectors / np.sqrt(np.maximum(eigen, 0.05))) @ vectors.T
        table: np.ndarray | None = None
        mapped = np.zeros((0, len(maps) + 1), np.float32)  # of the hard negatives, which only grow
        for _ in range(ROUNDS):
            witness, shown_as = toxic_witnesses(toxic, lean_of, near if table is None else table)
            shown, negative = sorted(witness), list(hard)
            mapped = np.vstack([mapped, _mapped([hard[h] for h in negative[len(mapped) :]], maps, whiten)])
            x = np.vstack([mapped, _mapped([shown_as[h] for h in shown], maps, whiten)])
            y = np.concatenate([-np.ones(len(negative)), np.ones(len(shown))])
            count = np.concatenate([in_clean(negative), [witness[h] for h in shown]]).astype(float)
            w = _squared_hinge(x, y, np.where(y > 0, 2, 1) * np.sqrt(count))
            alpha, bias = whiten @ w[:-1], w[-1]
            table = np.zeros(_CODES, np.float32)
            for m, a in zip(maps, alpha, strict=True):
                for c, v in m.items():
                    table[c] += a * v
            # stretches of clean sentences that the machine takes for toxic join the negatives
            hard |= {h: u for h, u, _ in clean.strongest(table, HARD_NEGATIVES) if h not in lean_of or lean_of[h] < SURE}
        machine = cls(table, float(bias), 1.0, 0.0)
        machine._calibrate(np.concatenate([toxic.tops(table), clean.tops(table)]) + bias, toxic.size)
        return machine

    def _calibrate(self, x: np.ndarray, ones: int) -> None:
        """Platt's sigmoid over the values of the fitting texts, toxic ones first, with his smoothed targets."""
        x = np.where(np.isfinite(x), x, self.bias)
        y = np.arange(len(x)) < ones
        target = np.where(y, (ones + 1) / (ones + 2), 1 / (len(x) - ones + 2))
        beta, x1 = np.array([1.0, 0.0]), np.stack([x, np.ones_like(x)], 1)
        for _ in range(50):
            s = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
            h = (x1 * (s * (1 - s) + 1e-9)[:, None]).T @ x1 + 1e-6 * np.eye(2)
            step = np.linalg.solve(h, x1.T @ (s - target))
            beta = beta - step * min(1.0, 2 / (np.abs(step).max() + 1e-9))
        self.a, self.b = float(max(beta[0], 1e-3)), float(beta[1])

    def score(self, value: np.ndarray) -> np.ndarray:
        """Probabilities of texts from their strongest stretches' values."""
        return 1 / (1 + np.exp(-np.clip(self.a * value + self.b, -30, 30)))

    def tops(self, texts: list[str | None]) -> np.ndarray:
        """The decision value of every text: that of its strongest sentence; the bias if it has none."""
        out = np.full(len(texts), -np.inf)
        parts: list[str] = []
        owners: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal parts, owners, held
            if parts and len(self.table) > 1:
                s = stream(parts)
                np.maximum.at(out, np.array(owners)[s.texts], values(s, self.table))
            parts, owners, held = [], [], 0

        for i, t in enumerate(texts):
            for part in _parts(t.replace("\0", " ") if "\0" in t else t) if t else ():
                if held and held + len(part) > AT_ONCE:
                    flush()
                parts.append(part)
                owners.append(i)
                held += len(part)
        flush()
        return np.where(np.isfinite(out), out, 0.0) + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of texts."""
        return self.score(self.tops(texts))


def toxic_witnesses(toxic: Bags, lean_of: dict[int, float], table: np.ndarray) -> tuple[Counter[int], dict[int, bytes]]:
    """How many toxic texts each witness stands for, and what it is.

    A text's witnesses are its stretches that are surely tied to the class, else its strongest one, of those that lean to
    the class if there are any.
    """
    witness: Counter[int] = Counter()
    units: dict[int, bytes] = {}
    keys = np.array(sorted(lean_of), np.uint64)
    leans = np.array([lean_of[int(h)] for h in keys])
    for s, h in toxic.streams:
        v, t = values(s, table), s.texts
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        lean = np.where(keys[at] == h, leans[at], 0.0)
        order = np.argsort(t, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(t[order])) + 1) if len(order) else ():
            sure = {int(h[k]): k for k in group if lean[k] > SURE}
            if not sure:
                k = max(group, key=lambda k: (lean[k] > 0, v[k], h[k]))
                sure = {int(h[k]): k}
            for x, k in sure.items():
                witness[x] += 1
                units.setdefault(x, s.unit(k))
    return witness, units


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_TEXTS, max_chars: int = FIT_CHARS) -> Machine:
    """Fit on at most `limit` labelled texts of each class of up to `max_chars` characters."""
    return Machine.fit(labelled_sample(docs, labels, "toxic", limit, max_chars)[0])


def score_toxicity(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a column of scores from 0 to 1. No shuffle; rows, repeated ones too, are scored one by one.

    A column that already has the name `score_col` is replaced.
    """
    rows = docs.select(*[c for c in docs.columns if c != score_col])
    told = docs.sparkSession.sparkContext.broadcast(machine)  # a table of 32**ORDER numbers, whatever the input

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in few(batch, at, SLICE, AT_ONCE):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(told.value.scores(part.column(at).to_pylist()), pa.float64())], [*batch.schema.names, score_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(score_col, T.DoubleType())]))


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= 0.5)."""
    scored = score_toxicity(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The documents that the machine does not reject."""
    scored = score_toxicity(docs.select(*columns), fit(docs, labels), score_col="_toxicity")
    return scored.where(F.col("_toxicity") < 0.5).select(*columns)
