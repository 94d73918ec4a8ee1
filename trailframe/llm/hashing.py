"""Hashes of the words of many texts at once, over the bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Texts are hashed in pieces of about so many bytes; a longer text is a piece of its own.
PIECE = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE + 1)
        for name, b in (("up", _BASE), ("down", _BACK)):
            powers = np.full(size, b, np.uint64)
            powers[0] = 1
            _powers[name] = np.multiply.accumulate(powers)
    return _powers["up"], _powers["down"]


class Words(NamedTuple):
    """The words of texts `first` to `first + len(bounds) - 2`; text i has the words bounds[i] to bounds[i + 1]."""

    first: int
    bounds: np.ndarray
    hashes: np.ndarray
    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    texts: np.ndarray


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, bounds of the texts in them) over a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    _, offsets, values = column.buffers()
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PIECE, "right")) - 1)
        upto = min(upto, n)
        yield at, raw[bounds[at] : bounds[upto]], bounds[at : upto + 1] - bounds[at]
        at = upto


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] times the inverse base to the power i depending on raw[i:j] alone."""
    up, _ = _table(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[starts:ends]."""
    _, down = _table(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(column: pa.Array) -> Iterator[Words]:
    """Words (runs of bytes other than ASCII white space) of every text, piece by piece, with 64-bit hashes."""
    for first, raw, bounds in pieces(column):
        ink = ~_SPACE[raw]
        before = np.zeros(len(raw) + 1, bool)
        before[1:] = ink
        inner = bounds[1:-1]
        inner = inner[inner < len(raw)]
        before[inner] = False  # a text begins: what stands before it is no part of its words
        starts = np.flatnonzero(ink & ~before[:-1])
        after = np.zeros(len(raw) + 1, bool)
        after[:-1] = ink
        after[inner] = False
        ends = np.flatnonzero(ink & ~after[1:]) + 1
        hashes = range_hashes(prefix_hashes(raw), starts, ends)
        cuts = np.searchsorted(starts, bounds)
        yield Words(first, cuts, hashes, raw, starts, ends, bounds)


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within texts, and bounds by text. A text with fewer words, but any, has one run."""
    n = len(w.hashes)
    counts = np.diff(w.bounds)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    padded = np.concatenate([w.hashes, np.zeros(size, np.uint64)])
    starts = np.repeat(w.bounds[:-1] - bounds[:-1], runs) + np.arange(bounds[-1])
    left = np.repeat(counts, runs)
    total = np.zeros(len(starts), np.uint64)
    for k in range(size):
        word = padded[np.minimum(starts + k, n)]
        if (left < size).any():
            word = np.where(k < np.where(left < size, left, size), word, 0)
        total += word * mix(np.full(1, k + 1, np.uint64) * _BASE)
    return mix(total), bounds
