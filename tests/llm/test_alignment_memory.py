"""What a process remembers of units: little a unit, and each at its own place."""

import tracemalloc

import numpy as np
import pyarrow as pa

from trailframe.llm import alignment


def _told(aligner, texts):
    """Both sides' ids and ends of each text."""
    sides, numbers, number = aligner.units(pa.array(texts))
    out, at = [], 0
    for n in number:
        units = numbers[at : at + n]
        at += n
        out.append([[(ids[i], ends[i]) for u in units for i in range(sum(sizes[:u]), sum(sizes[: u + 1]))] for ids, ends, sizes in sides])
    return out


def test_repeated_whole_texts_keep_places_apart():
    """Texts with two blanks in a row are units themselves; that one came twice had moved all later units by one."""
    kept, fresh = (alignment.Aligner(*alignment.default_paths()) for _ in range(2))
    first, second = ["a  b", "a  b", " c", "one two"], ["alignment", "x  y", "a  b", "two three"]
    _told(kept, first)
    assert _told(kept, second) == _told(fresh, second)


def test_remembered_units_are_small():
    """A unit that is a key of a dictionary takes some 200 bytes, of which a worker remembers 600,000."""
    aligner = alignment.Aligner(*alignment.default_paths())
    aligner.units(pa.array(["one two"]))
    texts, n = pa.array([" ".join(f"u{k}" for k in range(i, i + 1000)) for i in range(0, 60_000, 1000)]), 60_000
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    aligner.units(texts)
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert len(aligner.spells) >= n and held < 150 * n
    assert np.all(aligner.spells)
