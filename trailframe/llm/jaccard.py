"""N-gram Jaccard join: MinHash bands find candidate texts, full sets of word 5-grams decide.

1. Every text gets an md5 key, a 128-bit key of its set of 5-grams, and a sketch of BANDS band hashes. Equal texts fold
   into one, and texts of equal sets (which differ in white space or repeats alone) into one node, so that neither
   meet each other as pairs: their links are known from the node's number of texts.
2. Nodes shuffle on (band, band hash) as 16-byte keys. A bucket of m nodes is cut into blocks of at most about BLOCK
   nodes, and pairs of blocks ("cells") are dealt to tasks: no task holds a whole large bucket, none is capped.
3. A pair of nodes is looked at only in the first band that it shares. Nodes without such a pair in a cell leave
   the cell before any text moves, so that a text is shipped about once for each cell that needs it.
4. In a cell the pair's full sets of hashed 5-grams give the Jaccard similarity. A cell returns, per node, its
   number of links and one edge towards the cell's least linked node: never the pairs themselves.
5. Large-star/small-star steps turn edges into classes.

BANDS and ROWS come from the target: the least number of bands whose recall 1 - (1 - s**ROWS)**BANDS reaches
TARGET at the threshold s. A band hash has HASH_BYTES bytes, so that a row of a cell stays small; a chance agreement of
two only costs a comparison.

Null texts count as empty. A text of one to four words has one shingle of all its words; an empty one has none
and joins only its exact copies. Repeated rows are copies. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm import hashing
from trailframe.llm.common import written
from trailframe.llm.components import components

SHINGLE, SIMILAR, ROWS, TARGET = 5, 0.8, 5, 0.99998
BLOCK = 256
SEED = 20240229
HASH_BYTES = 5
#: Rows of texts that a Python worker sketches at once; bytes of texts that it compares before it gives rows back.
AT_ONCE, HELD_BYTES = 500, 4 << 20


def bands_for(similar: float, rows: int, target: float) -> int:
    """The fewest bands that find a pair of the given similarity with the target probability."""
    return math.ceil(math.log(1 - target) / math.log(1 - similar**rows))


BANDS = bands_for(SIMILAR, ROWS, TARGET)


def _parameters(rows: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    times = (draw.integers(0, 2**31, rows * bands, np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
    return times, draw.integers(0, 2**32, rows * bands, np.uint32)


def sketches(column: pa.Array, rows: int = ROWS, bands: int = BANDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether each text has words, 128-bit keys of the sets of 5-grams, band hashes); zeros for texts without words."""
    has = np.zeros(len(column), bool)
    keys = np.zeros((len(column), 2), np.uint64)
    out = np.zeros((len(column), bands), np.uint64)
    times, plus = _parameters(rows, bands)
    for w in hashing.words(column):
        grams, bounds = hashing.windows(w, SHINGLE)
        some = np.flatnonzero(np.diff(bounds))
        if not len(some):
            continue
        has[w.first + some] = True
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        order = np.lexsort((grams, owner))
        own, first = grams[order], np.ones(len(order), bool)
        first[1:] = (own[1:] != own[:-1]) | (owner[order][1:] != owner[order][:-1])
        for k, salt in enumerate((0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)):
            keys[w.first + some, k] = np.add.reduceat(np.where(first, hashing.mix(own ^ np.uint64(salt)), np.uint64(0)), bounds[some])
        x = (grams >> np.uint64(32)).astype(np.uint32)
        value = np.empty_like(x)
        for b in range(bands):
            band = np.full(len(some), b + 1, np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                np.multiply(x, times[k], out=value)
                value += plus[k]
                band = hashing.mix(band * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(value, bounds[some]))
            out[w.first + some, b] = band
    return has, keys, out


def _packed(found: np.ndarray) -> pa.Array:
    """Band hashes, HASH_BYTES bytes each, as one binary value a text."""
    raw = np.ascontiguousarray(found.astype("<u8").view(np.uint8).reshape(len(found), -1, 8)[:, :, :HASH_BYTES])
    return pa.array([x.tobytes() for x in raw], pa.binary())


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, key, node, has_words, bands) of every row; `node` is the set's key, or the text's if it has no words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                texts = part.column(1)
                keys = [hashlib.md5(x.as_buffer() if x.is_valid else b"").digest() for x in texts]
                has, sets, found = sketches(texts)
                nodes = [s.tobytes() if h else k for h, s, k in zip(has.tolist(), sets, keys, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(nodes, pa.binary()), pa.array(has), _packed(found)], ["doc_id", "key", "node", "has_words", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, key binary, node binary, has_words boolean, bands binary")


def _runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, which follow each other, as one table; a run may span batches."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        n = table.num_rows
        new = np.zeros(n, bool)
        new[0] = True
        for k in keys:
            column = table.column(k).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(new)
        table = table.combine_chunks()
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield table.slice(a, b - a)
        rest = table.slice(starts[-1])
    if rest is not None:
        yield rest


CELL = ["band", "hash", "i", "j"]


def _bands(cell: pa.Table) -> np.ndarray:
    """The band hashes of a cell's rows."""
    found = np.frombuffer(b"".join(cell.column("bands").to_pylist()), np.uint8).reshape(cell.num_rows, -1, HASH_BYTES)
    wide = np.zeros((*found.shape[:2], 8), np.uint8)
    wide[:, :, :HASH_BYTES] = found
    return wide.view("<u8")[:, :, 0]


def _first_met(bands: np.ndarray, band: int, block: np.ndarray, i: int, j: int) -> np.ndarray:
    """Of a cell's nodes: which pairs p < q share this band, no earlier one, and belong to the cell."""
    n = len(bands)
    met = np.triu(np.ones((n, n), bool), 1)
    if i != j:
        met &= block[:, None] != block[None, :]
    for b in range(band):
        if not met.any():
            break
        met &= bands[:, b][:, None] != bands[None, :, b]
    return met


def _needed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the cells' nodes that have a pair to be looked at there, without the band hashes: which pairs, as bits."""
    for cell in _runs(batches, CELL):
        if cell.num_rows < 2:
            continue
        band, i, j = (cell.column(k)[0].as_py() for k in ("band", "i", "j"))
        met = _first_met(_bands(cell), band, cell.column("block").to_numpy(), i, j)
        wanted = met.any(0) | met.any(1)
        if wanted.any():
            kept = cell.filter(pa.array(wanted)).drop_columns(["bands", "block"])
            bits = np.packbits(met[np.ix_(wanted, wanted)], axis=1)
            yield from kept.append_column("met", pa.array([x.tobytes() for x in bits], pa.binary())).combine_chunks().to_batches()


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 5-gram hashes of every text."""
    out: list[np.ndarray] = []
    for w in hashing.words(column):
        grams, bounds = hashing.windows(w, SHINGLE)
        out += [np.unique(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """|a and b| / |a or b| of sorted distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _compared(keys: list[bytes], weights: list[int], texts: pa.Array, met: np.ndarray, similar: float) -> Iterator[tuple[int, int, int]]:
    """(node, number of linked texts, least node that it is linked with, step by step) of a cell's linked nodes."""
    sets = shingle_sets(texts)
    count = np.zeros(len(keys), int)
    root = list(range(len(keys)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for p, q in zip(*np.nonzero(met), strict=True):
        a, b = sets[p], sets[q]
        if min(len(a), len(b)) >= similar * max(len(a), len(b)) and jaccard(a, b) >= similar:
            count[p] += weights[q]
            count[q] += weights[p]
            x, y = find(int(p)), find(int(q))
            if x != y:
                x, y = (x, y) if keys[x] < keys[y] else (y, x)
                root[y] = x
    for x in np.flatnonzero(count):
        yield int(x), int(count[x]), find(int(x))


def _verified(similar: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per cell and node: number of links, and the least node it is linked with in the cell, step by step."""
        nodes, links, towards = [], [], []
        for cell in _runs(_short(batches), CELL):
            keys = cell.column("node").to_pylist()
            n = len(keys)
            if n < 2:
                continue
            # rows are in the order of their bits: by node, as when the pairs were found
            met = np.unpackbits(np.frombuffer(b"".join(cell.column("met").to_pylist()), np.uint8).reshape(n, -1), axis=1, count=n).astype(bool)
            texts = pa.concat_arrays(cell.column("text").chunks)
            for x, links_of, least in _compared(keys, cell.column("n_texts").to_pylist(), texts, met, similar):
                nodes.append(keys[x])
                links.append(links_of)
                towards.append(keys[least])
            if len(nodes) > 20_000:
                yield _links(nodes, links, towards)
                nodes, links, towards = [], [], []
        yield _links(nodes, links, towards)

    return run


def _short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in turn, up to about HELD_BYTES bytes at a time."""
    for batch in batches:
        step = max(1, int(batch.num_rows * HELD_BYTES / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _links(nodes: list, links: list, towards: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(links, pa.int64()), pa.array(towards, pa.binary())], ["a", "links", "b"])


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per document: doc_id, key, class_id, text_id, n_copies, n_links, class_key.

    class_id: the least doc_id of its class (texts linked in one or more steps), nulls before numbers; text_id: the
    least doc_id with the very same text; n_copies: rows with that text; n_links: other texts with a Jaccard similarity
    of `similar` or more; class_key: the text key that stands for the class, one whatever ids its documents share.
    """
    rows = written(_sketched(docs), "sketches")
    first = lambda c: F.first(c).alias(c)
    texts = written(rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id"))).alias("rep"), F.count(F.lit(1)).alias("n_copies"), first("node"), first("bands"), first("has_words")), "texts")
    nodes = written(texts.groupBy("node").agg(F.count(F.lit(1)).alias("n_texts"), F.min(F.struct(F.col("rep"), F.col("key"))).alias("least"), first("bands"), first("has_words")), "nodes")
    banded = nodes.where("has_words").select("node", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "bands").select("node", "band", F.substring("bands", F.col("band") * HASH_BYTES + 1, F.lit(HASH_BYTES)).alias("hash"))
    shared = banded.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    # by the bucket's size: its number of blocks, this node's block, and the cells of that block with each other one
    dealt = banded.join(shared, ["band", "hash"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "band", "hash", "block", F.least("block", "other").cast("int").alias("i"), F.greatest("block", "other").cast("int").alias("j"))
    filled = cells.join(nodes.select("node", "n_texts", "bands"), "node").select(*CELL, "block", "node", "n_texts", "bands")
    members = written(_by_cell(filled).mapInArrow(_needed, "band int, hash binary, i int, j int, node binary, n_texts long, met binary"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("least.key").alias("_key")), "node")
    plain = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    found = plain.join(wanted, F.col("key") == F.col("_key")).groupBy("node").agg(F.first("text").alias("text"))  # a node's rows are copies of one text
    loaded = members.join(found, "node").select(*CELL, "node", "n_texts", "met", "text")
    links = written(_by_cell(loaded).mapInArrow(_verified(similar), "a binary, links long, b binary"), "links")
    classes = components(links.select("a", "b"))
    counted = links.groupBy("a").agg(F.sum("links").alias("n_links"))
    placed = nodes.join(counted.join(classes, "a", "left").select(F.col("a").alias("node"), "n_links", F.col("b").alias("class")), "node", "left").withColumn("class", F.coalesce("class", "node"))
    heads = placed.groupBy("class").agg(F.min("least").alias("head"))  # a class sums up map-side
    told = placed.join(heads, "class").select("node", (F.coalesce("n_links", F.lit(0)) + F.when(F.col("has_words"), F.col("n_texts") - 1).otherwise(0)).alias("n_links"), "head")
    all_texts = texts.select("key", "rep", "n_copies", "node").join(told, "node").select("key", F.col("rep.doc_id").alias("text_id"), "n_copies", "n_links", F.col("head.rep.doc_id").alias("class_id"), F.col("head.key").alias("class_key"))
    return rows.select("doc_id", "key").join(all_texts, "key").select("doc_id", "key", "class_id", "text_id", "n_copies", "n_links", "class_key")


def _by_cell(df: DataFrame) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *CELL).sortWithinPartitions(*CELL, "node")


def near_duplicate_documents(docs: DataFrame) -> DataFrame:
    """The query's rows: doc_id, class_id, text_id, n_copies, n_links."""
    return near_duplicates(docs).drop("key", "class_key")


def remove_near_duplicates(docs: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One document of each class stays: a row of the class's text with the least doc_id, whatever ids its rows share."""
    keep = near_duplicates(docs).where((F.col("key") == F.col("class_key")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    rows = docs.select(*columns, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("_text_key"))
    kept = rows.join(keep, rows["doc_id"].eqNullSafe(keep["_id"]) & (rows["_text_key"] == keep["_key"]))
    return kept.dropDuplicates(["_key"]).select(*columns)
