r"""Quality rules, line first: rules judge lines, failing lines go, and a document that loses too much text is rejected.

Base counts of the whole text, by its words (runs of characters other than ASCII white space): word_chars (code points
in words), n_symbols (characters of `[#*$%&|<>]`), n_dup_lines (\n-split lines with a word, equal to an earlier line),
n_repeat_words (words inside 8-word windows found twice or more in the text, the first time included).

A line with a word fails if one of these holds:
  punctuation   it does not end in a mark that ends a sentence, a quotation or a clause, of whatever script (a line that
                ends in a letter of a script that writes no such marks, such as Thai, does not fail);
  symbols       it has more than SYMBOLS symbol characters a word;
  shouting      it has SHOUTED words or more, and more than CAPITALS of its letters, of any script, are capitals;
  navigation    it is cut by two or more separators (SEPARATORS) into parts of NAV_WORDS words or fewer on average;
  boilerplate   it names licences, cookies, accounts or the like (BOILERPLATE).
A document is kept if its base counts pass and at least LEAST of its words are in lines that pass.

Null and empty texts have no words, fail the base rule and clean to the empty text. Words and lines are compared by
64-bit hashes. Every row is judged by itself: no shuffle, no group. No documents give no rows.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm import hashing
from trailframe.llm.common import few

LEAST, SYMBOLS, SHOUTED, CAPITALS, NAV_WORDS = 0.5, 0.3, 5, 0.6, 4
WINDOW = 8
#: Rows that are judged at once, and their bytes.
AT_ONCE, AT_ONCE_BYTES = 1000, 2 << 20
SEPARATORS = "|>»·•›｜"
BOILERPLATE = re.compile(
    "(?i)all rights reserved|licen[sc]ed under|cookie|terms of (?:use|service)|privacy policy|subscribe|javascript|click here|sign (?:up|in)\\b|copyright|powered by"
    "|alle rechte vorbehalten|tous droits r\u00e9serv\u00e9s|todos los derechos reservados|\u7248\u6743\u6240\u6709".encode()
)
#: Marks that end no sentence, quotation or clause although they stand in the same Unicode classes as those that do.
_NO_END = "#%&*@/\\•·†‡§¶‰"
#: Scripts without such marks: Thai, Lao.
_UNMARKED = (0x0E01, 0x0EDF)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ENDS, _LETTERS, _CAPITALS, _CUTS = 1, 2, 4, 8


@functools.cache
def _classes() -> np.ndarray:
    """Of every code point below 0x20000 the classes it is in, as bits."""
    out = np.zeros(0x20000, np.uint8)
    for p in range(0x20000):
        c = chr(p)
        kind = unicodedata.category(c)
        if kind in ("Pe", "Pf", "Po") and c not in _NO_END or c in "\"'" or _UNMARKED[0] <= p <= _UNMARKED[1]:
            out[p] |= _ENDS
        if kind[0] == "L":
            out[p] |= _LETTERS | (_CAPITALS if kind in ("Lu", "Lt") else 0)
        if c in SEPARATORS:
            out[p] |= _CUTS
    return out


def _points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points whose first bytes stand at `at` in UTF-8 text."""
    padded = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int32) if len(at) else np.zeros(4, np.int32)
    one, two, three, four = (padded[at + k] for k in range(4))
    low = lambda x: x & 0x3F
    wide = np.where(one < 0xE0, (one & 0x1F) << 6 | low(two), np.where(one < 0xF0, (one & 0xF) << 12 | low(two) << 6 | low(three), (one & 7) << 18 | low(two) << 12 | low(three) << 6 | low(four)))
    return np.where(one < 0x80, one, wide)


def _kinds(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """At the first byte of every character the classes it is in; 0 at other bytes."""
    out = _classes()[np.minimum(raw, 127)]
    out[raw > 127] = 0
    wide = np.flatnonzero(first & (raw > 127))
    points = _points(raw, wide)
    out[wide] = np.where(points < 0x20000, _classes()[np.minimum(points, 0x1FFFF)], _LETTERS)
    return out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur more than once."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _own(texts: np.ndarray) -> np.ndarray:
    """A number of each text, to be mixed into hashes that are compared within texts alone."""
    return hashing.mix(texts.astype(np.uint64) + np.uint64(0x51ED270B7F4A7C15))


def judge(column: pa.Array, cleaned: bool = False) -> dict[str, np.ndarray | list[str]]:
    """Counts and verdicts of every text; with `cleaned`, the text of its passing lines too."""
    n = len(column)
    out: dict = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lines_left", "n_words_left")}
    texts: list[str] = []
    for w in hashing.words(column):
        at = slice(w.first, w.first + len(w.bounds) - 1)
        raw, many = w.raw, len(w.bounds) - 1
        out["n_words"][at] = np.diff(w.bounds)
        points = (raw & 0xC0) != 0x80
        in_words = np.concatenate([[0], np.cumsum(points)])
        out["word_chars"][at] = _sums(in_words[w.ends] - in_words[w.starts], w.bounds)
        out["n_symbols"][at] = _sums(_SYMBOL[raw], w.texts)
        # repeated windows
        runs, by = hashing.windows(w, WINDOW)
        text_of = np.repeat(np.arange(many), np.diff(by))
        twice = _repeated(runs ^ _own(text_of)) & (np.diff(w.bounds) >= WINDOW)[text_of]
        first_word = w.bounds[:-1][text_of] + np.arange(len(runs)) - by[:-1][text_of]
        covered = np.zeros(len(w.hashes) + WINDOW + 1, np.int64)
        np.add.at(covered, first_word[twice], 1)
        np.add.at(covered, first_word[twice] + WINDOW, -1)
        out["n_repeat_words"][at] = _sums(np.cumsum(covered)[: len(w.hashes)] > 0, w.bounds)
        # lines: cut at \n and at the bounds of texts
        breaks = np.flatnonzero(raw == 10)
        starts = np.unique(np.concatenate([w.texts[:-1][np.diff(w.texts) > 0], breaks + 1]))
        starts = starts[starts < len(raw)]
        ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        stop = ends - (raw[ends - 1] == 10) if len(starts) else ends
        words_in = np.searchsorted(w.starts, np.append(starts, len(raw)))
        n_in = np.diff(words_in)
        real = n_in > 0
        owner = np.searchsorted(w.texts, starts, "right") - 1
        hashes = hashing.range_hashes(hashing.prefix_hashes(raw), starts, stop) if len(starts) else np.zeros(0, np.uint64)
        own = (hashes ^ _own(owner))[real]
        _, firsts = np.unique(own, return_index=True)
        dup = np.ones(len(own), bool)
        dup[firsts] = False
        np.add.at(out["n_dup_lines"], w.first + owner[real][dup], 1)
        # rules
        if len(starts):
            edges = np.append(starts, len(raw))
            kinds = _kinds(raw, points)
            begun = np.maximum.accumulate(np.where(points, np.arange(len(raw)), 0))  # where each byte's character begins
            last = kinds[begun[w.ends[np.maximum(words_in[1:] - 1, 0)] - 1]] if len(w.ends) else np.zeros(len(starts), np.uint8)
            letters, capitals, cuts, symbols = (_sums(x, edges) for x in (kinds & _LETTERS > 0, kinds & _CAPITALS > 0, kinds & _CUTS > 0, _SYMBOL[raw]))
            fails = (last & _ENDS == 0) | (symbols > SYMBOLS * n_in) | ((n_in >= SHOUTED) & (capitals > CAPITALS * letters)) | ((cuts >= 2) & (n_in <= NAV_WORDS * (cuts + 1)))
            spots = np.array([m.span() for m in BOILERPLATE.finditer(raw)], np.int64).reshape(-1, 2)
            line = np.searchsorted(starts, spots[:, 0], "right") - 1
            fails[line[spots[:, 1] <= ends[line]]] = True  # texts stand side by side: a match within one line counts
            left = real & ~fails
            np.add.at(out["n_lines"], w.first + owner[real], 1)
            np.add.at(out["n_lines_left"], w.first + owner[left], 1)
            np.add.at(out["n_words_left"], w.first + owner[left], n_in[left])
        if cleaned:
            lines: list[list[str]] = [[] for _ in range(many)]
            for i in np.flatnonzero(real & ~fails) if len(starts) else ():
                lines[owner[i]].append(raw[starts[i] : stop[i]].tobytes().decode())
            texts += ["\n".join(x) for x in lines]
    words = out["n_words"]
    out["base_failed"] = (words < 20) | (100 * out["n_repeat_words"] > 30 * words)
    out["kept"] = ~out["base_failed"] & (out["n_words_left"] >= LEAST * words)
    if cleaned:
        out["text"] = texts
    return out


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_left", "n_words_left")
_TYPES = ", ".join(f"{c} {'boolean' if c in ('base_failed', 'kept') else 'long'}" for c in _COUNTS)


def clean_documents(docs: DataFrame, cleaned: bool = True) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, line counts and, if asked for, the cleaned text."""
    names = ["doc_id", *_COUNTS, *(["text"] if cleaned else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in few(batch, 1, AT_ONCE, AT_ONCE_BYTES):
                got = judge(part.column(1), cleaned)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[c]) for c in _COUNTS), *([pa.array(got["text"], pa.string())] if cleaned else [])], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {_TYPES}" + (", text string" if cleaned else ""))


def quality_rule_documents(docs: DataFrame) -> DataFrame:
    """The query's rows."""
    return clean_documents(docs, cleaned=False)
