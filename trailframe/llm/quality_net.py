"""Quality classifier: a byte-level convolutional network in numpy.

FILTERS learned filters of WIDTH bytes slide over the whole text. Their responses are max-pooled over overlapping chunks
(CHUNK bytes, each half shared with the next one); a chunk's pooled responses pass a small hidden layer; mean and
maximum of the hidden layer over all chunks of the text combine into one probability. As bytes are one-hot, a filter is
a table from (place, byte) to weight, and a convolution is WIDTH table lookups. Every chunk of every text counts.

Fitting (Adam, on the driver) sees at most `limit` labelled texts of each class of up to `max_chars` characters; the
probability is shifted to the classes' share among all learnable labels.

Null and empty texts are one chunk of padding and are scored like any other. Rows are scored one by one: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailframe.llm import hashing
from trailframe.llm.common import labelled_sample, remainder

FILTERS, WIDTH, HIDDEN = 16, 6, 16
#: Pooled half chunks of bytes; a chunk is two neighbours.
HALF = 128
CHUNK = 2 * HALF
FIT_TEXTS, FIT_CHARS, EPOCHS, BATCH = 1200, 8_000, 5, 24
SPAN = 1 << 15


def padded(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds in half chunks): every text starts a half chunk and ends in zero bytes."""
    lengths = np.diff(bounds)
    halves = (lengths + WIDTH - 1) // HALF + 1
    at = np.concatenate([[0], np.cumsum(halves)])
    out = np.zeros(at[-1] * HALF + WIDTH, np.uint8)
    if len(lengths) == 1:  # a long text is alone: no numbers for each of its bytes
        out[: len(raw)] = raw
    else:
        out[np.arange(len(raw)) + np.repeat(at[:-1] * HALF - bounds[:-1], lengths)] = raw
    return out, at


class Net:
    """Weights, and how texts pass through them."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.p = {
            "filters": draw.normal(0, 0.4, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "w1": draw.normal(0, 0.4, (FILTERS, HIDDEN)).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": draw.normal(0, 0.2, 2 * HIDDEN).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }
        self.shift = 0.0
        self.constant: float | None = None

    def pooled(self, raw: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Strongest response of each filter in each half chunk, and where it was."""
        n = (len(raw) - WIDTH) // HALF
        best = np.empty((n, FILTERS), np.float32)
        where = np.empty((n, FILTERS), np.int64) if places else None
        for a in range(0, n * HALF, SPAN):
            b = min(a + SPAN, n * HALF)
            total = np.take(self.p["filters"][0], raw[a:b], axis=0)
            for k in range(1, WIDTH):
                total += np.take(self.p["filters"][k], raw[a + k : b + k], axis=0)
            parts = total.reshape(-1, HALF, FILTERS)
            if places:
                arg = parts.argmax(1)
                where[a // HALF : b // HALF] = arg + (np.arange(a // HALF, b // HALF) * HALF)[:, None]
                best[a // HALF : b // HALF] = np.take_along_axis(parts, arg[:, None, :], 1)[:, 0]
            else:
                best[a // HALF : b // HALF] = parts.max(1)
        return best, where

    @staticmethod
    def chunks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first half, second half, bounds by text) of all chunks; a text of one half is a chunk."""
        n = np.maximum(np.diff(at) - 1, 1)
        bounds = np.concatenate([[0], np.cumsum(n)])
        first = np.arange(bounds[-1]) + np.repeat(at[:-1] - bounds[:-1], n)
        return first, np.minimum(first + 1, np.repeat(at[1:], n) - 1), bounds

    def hidden(self, best: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.maximum(np.maximum(best[first], best[second]) + self.p["bias"], 0)
        return c, np.tanh(c @ self.p["w1"] + self.p["b1"])

    def logits(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One logit for each text."""
        data, at = padded(raw, bounds)
        best, _ = self.pooled(data)
        first, second, by = self.chunks(at)
        _, h = self.hidden(best, first, second)
        mean = np.add.reduceat(h, by[:-1], axis=0) / np.diff(by)[:, None]
        return np.hstack([mean, np.maximum.reduceat(h, by[:-1], axis=0)]) @ self.p["w2"] + self.p["b2"][0]

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probabilities of all texts of a column."""
        out = np.zeros(len(column))
        if self.constant is not None:
            out[:] = self.constant
            return out
        for at, raw, bounds in hashing.pieces(column):
            z = self.logits(raw, bounds).astype(np.float64) + self.shift
            out[at : at + len(bounds) - 1] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out

    def gradients(self, raw: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss over some texts."""
        data, at = padded(raw, bounds)
        best, where = self.pooled(data, places=True)
        first, second, by = self.chunks(at)
        c, h = self.hidden(best, first, second)
        n = np.diff(by)[:, None]
        mean, top = np.add.reduceat(h, by[:-1], axis=0) / n, np.maximum.reduceat(h, by[:-1], axis=0)
        v = np.hstack([mean, top])
        d = (1 / (1 + np.exp(-np.clip(v @ self.p["w2"] + self.p["b2"][0], -30, 30))) - y) / len(y)
        owner = np.repeat(np.arange(len(y)), np.diff(by))
        dv = d[:, None] * self.p["w2"]
        dh = (dv[:, :HIDDEN] / n)[owner] + dv[owner, HIDDEN:] * (h == top[owner]) / np.maximum(1, np.add.reduceat((h == top[owner]).astype(np.float32), by[:-1], axis=0))[owner]
        dz = (dh * (1 - h * h)).astype(np.float32)
        dc = (dz @ self.p["w1"].T) * (c > 0)
        chosen = np.where(best[first] >= best[second], where[first], where[second])
        g = {"w2": v.T @ d, "b2": np.array([d.sum()]), "w1": c.T @ dz, "b1": dz.sum(0), "bias": dc.sum(0)}
        filters = np.zeros((WIDTH, 256, FILTERS))
        column = np.arange(FILTERS)
        for k in range(WIDTH):
            filters[k] = np.bincount((data[chosen + k].astype(np.int64) * FILTERS + column).reshape(-1), dc.reshape(-1), 256 * FILTERS).reshape(256, FILTERS)
        return g | {"filters": filters}

    @classmethod
    def fit(cls, rows: list[tuple[str, int]], prior: float | None = None, epochs: int = EPOCHS, rate: float = 0.01) -> Net:
        """Fit on (text, label) rows; deterministic."""
        net, n = cls(), len(rows)
        ones = sum(y for _, y in rows)
        if not ones or ones == n:
            net.constant = (ones + 1) / (n + 2)  # the smoothed share; a half without any label
            return net
        draw = np.random.default_rng(11)
        each = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t, _ in rows]
        labels = np.array([y for _, y in rows], np.float32)
        moments = {k: [np.zeros_like(v, np.float64), np.zeros_like(v, np.float64)] for k, v in net.p.items()}
        steps, total = 0, max(1, epochs * -(-n // BATCH))
        for _ in range(epochs):
            order = draw.permutation(n)
            for at in range(0, n, BATCH):
                take = order[at : at + BATCH]
                bounds = np.concatenate([[0], np.cumsum([len(each[i]) for i in take])])
                g = net.gradients(np.concatenate([each[i] for i in take]), bounds, labels[take])
                steps += 1
                now = rate * (1 - 0.9 * steps / total)
                for k, v in net.p.items():
                    m1, m2 = moments[k]
                    m1 += 0.1 * (g[k] - m1)
                    m2 += 0.001 * (g[k] ** 2 - m2)
                    v -= (now * (m1 / (1 - 0.9**steps)) / (np.sqrt(m2 / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
        if prior is not None and 0 < prior < 1:
            net.shift = float(np.log(prior / (1 - prior)) - np.log(ones / (n - ones)))
        return net


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_TEXTS, max_chars: int = FIT_CHARS) -> Net:
    """Fit on a bounded sample; the prior is the share of label 1 among all learnable labels."""
    return Net.fit(*labelled_sample(docs, labels, "quality", limit, max_chars))


def score_quality(docs: DataFrame, net: Net, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a column of probabilities of label 1; a column of that name is replaced."""
    rows = docs.select(*[c for c in docs.columns if c != score_col])
    told = docs.sparkSession.sparkContext.broadcast(net)  # as large as its filters, whatever the input

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told.value.scores(column), pa.float64())], [*batch.schema.names, score_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(score_col, T.DoubleType())]))


def quality_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= 0.3)."""
    scored = score_quality(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
