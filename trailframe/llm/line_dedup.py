r"""Line dedup by winnowing over line hashes.

Lines are \n-split, compared without the white space around them; lines without a word stay where they are and take no
part. A window is the shortest run of lines, from a given line on, that holds MIN_WORDS words. Each window selects its
least line hash, the first one on ties; a position is a fingerprint if some window selects it. Neighbouring windows
mostly select the same position, so fingerprints are far fewer than lines, and two texts that share a window share the
fingerprint that it selects, whatever stands around it (the guarantee of winnowing).

1. Each text gives its line hashes and word counts, and its fingerprints: (line hash, position).
2. The first position of each fingerprint in the order of (doc_id, text key, line) is found by an aggregation that sums
   up map-side; a line that a third of all texts share is one row a task. Later positions join the first one.
3. Matches of two texts on one diagonal fold into one row, which gets just the stretch of the first text that lies
   beside the later one, and are extended both ways over equal lines to whole runs. Runs of MIN_WORDS words or more go.
4. A common line may be selected in texts that share nothing else with its first text, but more with each other. So
   windows of a matched fingerprint that its run does not hold are matched by all their lines, again with the first
   window alike: the exact way for what a first position leaves open. Texts whose fingerprints all match their first
   ones, or nothing, send nothing there.

So every window that is there earlier goes, with what it extends to, and no line goes that is not in a run of MIN_WORDS
words that is there earlier; the first run stays. Within a text too. At no place do pairs of later positions form.

Rows that agree in doc_id and text are one document and are treated alike. Null ids come first in order; null texts
count as empty. Texts of fewer than MIN_WORDS words have no window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm import hashing
from trailframe.llm.common import few, written

MIN_WORDS = 50
#: Rows of texts that a Python worker hashes at once, and their bytes.
AT_ONCE, AT_ONCE_BYTES = 1000, 4 << 20


def lines_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, word counts) of the lines with a word of every text."""
    for w in hashing.words(column):
        raw = w.raw
        breaks = np.searchsorted(w.starts, np.flatnonzero(raw == 10))  # first word after each break
        cuts = np.unique(np.concatenate([w.bounds[:-1], w.bounds[1:], breaks])) if len(w.starts) else np.zeros(1, np.int64)
        starts, ends = cuts[:-1], cuts[1:]
        prefix = hashing.prefix_hashes(raw)
        hashes = hashing.range_hashes(prefix, w.starts[starts], w.ends[ends - 1]) if len(starts) else np.zeros(0, np.uint64)
        at = np.searchsorted(starts, w.bounds)
        sizes = ends - starts
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield hashes[a:b], sizes[a:b]


def windows_of(hashes: np.ndarray, sizes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends, selected lines) of the windows that start at lines 0, 1, ..."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.searchsorted(total, total[:-1] + min_words)
    n = int((ends <= len(sizes)).sum())
    ends = ends[:n]
    selected = np.zeros(n, np.int64)
    # by a queue of lines whose hashes ascend: its head is the first least one of the window
    queue: list[int] = []
    head = at = 0
    values = hashes.tolist()
    for start, end in enumerate(ends.tolist()):
        while at < end:
            while len(queue) > head and values[queue[-1]] > values[at]:
                queue.pop()
            queue.append(at)
            at += 1
        while queue[head] < start:
            head += 1
        selected[start] = queue[head]
    return ends, selected


def window_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of all lines of the windows."""
    up, down = hashing._table(len(hashes) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
    return hashing.mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def extended(mine: np.ndarray, first: np.ndarray, offset: int, seeds: Iterable[int]) -> list[tuple[int, int]]:
    """Runs [start, end) of `mine` that hold a seed; line i is compared with first[i - offset], where that is."""
    least, most = max(0, offset), min(len(mine), len(first) + offset)
    runs: list[tuple[int, int]] = []
    if most <= least:
        return runs
    differ = np.flatnonzero(mine[least:most] != first[least - offset : most - offset]) + least
    for b in sorted(seeds):
        if runs and b < runs[-1][1]:
            continue
        k = int(np.searchsorted(differ, b))
        if not least <= b < most or (k < len(differ) and differ[k] == b):
            continue
        runs.append((int(differ[k - 1]) + 1 if k else least, int(differ[k]) if k < len(differ) else most))
    return runs


def _longs(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64, copy=False).view(np.int64)


def _hashed(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, key, lines, sizes, prints) of every row: `prints` are the selected lines."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "lines", "sizes", "prints"]
        for batch in batches:
            for part in few(batch, 2, AT_ONCE, AT_ONCE_BYTES):
                lines, counts, prints = [], [], []
                for hashes, sizes in lines_of(part.column(2)):
                    lines.append(_longs(hashes))
                    counts.append(sizes)
                    prints.append(np.unique(windows_of(hashes, sizes, min_words)[1]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lines, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32())), pa.array(prints, pa.list_(pa.int32()))], names)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).alias("key"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(run, "doc_id long, key binary, lines array<long>, sizes array<int>, prints array<int>")


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _diagonals(places: DataFrame, texts: DataFrame) -> DataFrame:
    """Later places beside the first of their print, folded by diagonal: doc_id, key, seeds, offset, beside, lines, sizes.

    `places`: print and place (struct of doc_id, key, line). `beside` are the first text's lines next to the later
    text's; the later text's line i lies beside beside[i - offset].
    """
    firsts = places.groupBy("print").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = places.join(firsts, "print").where(F.col("place") > F.col("first"))
    pairs = later.select(F.col("place.doc_id").alias("doc_id"), F.col("place.key").alias("key"), F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("first_key"), (F.col("place.line") - F.col("first.line")).alias("shift"), F.col("place.line").alias("line"), F.col("place.many").alias("many"))
    folded = pairs.groupBy("doc_id", "key", "first_id", "first_key", "shift", "many").agg(F.collect_set("line").alias("seeds"))  # at most a text's own lines
    other = texts.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("lines").alias("_lines"))
    skipped = F.greatest(-F.col("shift"), F.lit(0))
    beside = folded.join(other, F.col("first_id").eqNullSafe(F.col("_id")) & (F.col("first_key") == F.col("_key"))).select("doc_id", "key", "seeds", (F.col("shift") + skipped).alias("offset"), F.slice("_lines", skipped + 1, F.col("many")).alias("beside"))
    own = texts.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "lines", "sizes")
    return beside.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).drop("_id", "_key")


def _matched(diagonals: DataFrame, min_words: int, whole: bool) -> DataFrame:
    """(doc_id, key, runs, open): runs of min_words words or more; with `whole`, the selected lines left open as (print, line)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, left = [], []
            for r in range(batch.num_rows):
                seeds, beside, lines, sizes = (batch.column(k)[r].values.to_numpy(zero_copy_only=False) for k in ("seeds", "beside", "lines", "sizes"))
                total = np.concatenate([[0], np.cumsum(sizes)])
                found = [(a, b) for a, b in extended(lines, beside, batch.column("offset")[r].as_py(), seeds.tolist()) if total[b] - total[a] >= min_words]
                runs.append([{"start": a, "end": b} for a, b in found])
                lost: list[int] = []
                if whole:
                    # a seed is open if a window that selects it lies in no run
                    ends, selected = windows_of(lines.view(np.uint64), sizes, min_words)
                    starts = np.arange(len(ends))
                    held = np.zeros(len(ends), bool)
                    for a, b in found:
                        held |= (starts >= a) & (ends <= b)
                    lost = sorted(set(lines[np.intersect1d(selected[~held], seeds)].tolist()))
                left.append(lost)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(runs, _RUNS), pa.array(left, pa.list_(pa.int64()))], ["doc_id", "key", "runs", "open"])

    return diagonals.mapInArrow(run, "doc_id long, key binary, runs array<struct<start:bigint,end:bigint>>, open array<long>")


def _open_windows(texts: DataFrame, prints: DataFrame, min_words: int) -> DataFrame:
    """(print, place) of all windows that select a line with one of the prints; the new print is that of all their lines."""
    rows = texts.select("doc_id", "key", F.posexplode(F.transform("prints", lambda p: F.struct(p.alias("at"), F.get("lines", p).alias("hash")))).alias("_n", "p"))
    wanted = rows.join(prints, F.col("p.hash") == F.col("open")).groupBy("doc_id", "key").agg(F.collect_set("p.at").alias("chosen"))  # at most a text's own lines
    own = texts.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "lines", "sizes")
    rows = wanted.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("doc_id", "key", "chosen", "lines", "sizes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, places, many = [], [], []
            for r in range(batch.num_rows):
                chosen, lines, sizes = (batch.column(k)[r].values.to_numpy(zero_copy_only=False) for k in ("chosen", "lines", "sizes"))
                ends, selected = windows_of(lines.view(np.uint64), sizes, min_words)
                starts = np.flatnonzero(np.isin(selected, chosen))
                hashes.append(_longs(window_hashes(lines.view(np.uint64), starts, ends[starts])))
                places.append(starts)
                many.append(len(lines))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(many, pa.int32())], ["doc_id", "key", "hashes", "places", "many"])

    found = rows.mapInArrow(run, "doc_id long, key binary, hashes array<long>, places array<int>, many int")
    return found.select("doc_id", "key", "many", F.explode(F.arrays_zip("hashes", "places")).alias("w")).select(F.col("w.hashes").alias("print"), F.struct("doc_id", "key", F.col("w.places").alias("line"), "many").alias("place"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, runs): for each document with later repeated runs, their [start, end) in lines with a word."""
    texts = written(_hashed(docs, min_words).dropDuplicates(["doc_id", "key"]), "lines")
    places = texts.select(F.explode(F.transform("prints", lambda p: F.struct(F.get("lines", p).alias("print"), F.struct(F.col("doc_id"), F.col("key"), p.alias("line"), F.size("lines").alias("many")).alias("place")))).alias("p")).select("p.*")
    by_print = written(_matched(_diagonals(places, texts), min_words, True), "matches")
    prints = by_print.select(F.explode("open").alias("open")).distinct()
    windows = written(_open_windows(texts, prints, min_words), "windows")
    by_window = _matched(_diagonals(windows, texts), min_words, False)
    runs = by_print.unionByName(by_window).select("doc_id", "key", F.explode("runs").alias("run"))
    return runs.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("run")).alias("runs"))  # at most a text's own lines


def fingerprints(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_prints) of every row: how much winnowing thins out."""
    return _hashed(docs, min_words).select("doc_id", F.size("lines").alias("n_lines"), F.size("prints").alias("n_prints"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, text without its later repeated runs, n_lines, lines_removed, words_removed."""
    runs = repeated_runs(docs, min_words).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "runs")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_text_key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    joined = texts.join(runs, texts["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left").select("doc_id", "text", "runs")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in few(batch, 1, AT_ONCE, AT_ONCE_BYTES):
                texts, total, lines, words = [], [], [], []
                for text, cuts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    left, at, gone, lost = [], 0, 0, 0
                    dead = {i for c in cuts or () for i in range(c["start"], c["end"])}
                    for line in (text or "").split("\n"):
                        n = len(line.encode().split())
                        if n and at in dead:
                            gone, lost = gone + 1, lost + n
                        else:
                            left.append(line)
                        at += n > 0
                    texts.append("\n".join(left) if gone else text)
                    total.append(at)
                    lines.append(gone)
                    words.append(lost)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in (total, lines, words))], ["doc_id", "text", "n_lines", "lines_removed", "words_removed"])

    return joined.mapInArrow(run, "doc_id long, text string, n_lines long, lines_removed long, words_removed long")
