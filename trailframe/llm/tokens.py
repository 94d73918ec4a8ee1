"""Token ids in a binary table: frequency-ranked ids, byte-aligned variable-length coding, separate control bytes.

Format. Ids are replaced by their rank in the whole corpus (the commonest id is rank 0; ties by id), so that common
ids take one byte. A rank is stored in 1 to 4 little-endian bytes; two bits a number, in a stream of control bytes of
their own, say how many (four numbers a control byte, first number in the lowest bits). A block is one row of a
Parquet table: `part` and `first` give its place (a part is a run of documents in order, `first` the number of ids
before the block within its part), `doc_ids` and `counts` its documents, `control` and `data` the two streams.
Documents lie in ascending doc_id order (nulls first, ties by a hash of the text and the text). A block is closed once it has BLOCK ids; a text
is never cut. The table of ranks is written beside the blocks. Parquet carries the byte streams so that Spark's committer makes each file appear once and
whole, on any store, whatever executors are lost.

Decoding looks each control byte up in a table (four lengths) and gathers the bytes with numpy.

A tokenizers file that splits at white space and drops it, lowers the case, and keeps letters apart from commas and full
stops, as word_bpe_49k.json does (probes tell when it is loaded; with another file texts are encoded whole): words between ASCII white space are encoded once and remembered, without a comma or
full stop that follows a letter, and a text's ids are its words' ids in turn. A text that holds one of the file's special
strings, in whatever case, is encoded whole.

Null texts count as empty and hold only the end id. Repeated rows and ids are encoded each; rows of one id, of none and
equal ones too, are dealt over tasks by their texts' hashes and a salt. No documents give no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import written

#: The id appended to each document.
END = 1
#: Ids of a block; words that a Python worker remembers before it starts over; bytes of texts that it splits at once.
BLOCK, REMEMBERED, AT_ONCE = 1 << 18, 800_000, 1 << 22


def default_path() -> str:
    """The public vocabulary file of the query contract."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# -- variable-length coding ----------------------------------------------------------------------------------------

_LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1


def encode(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers."""
    numbers = np.asarray(numbers, np.uint32)
    extra = (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    padded = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    padded[: len(numbers)] = extra
    control = (padded.reshape(-1, 4) << (2 * np.arange(4, dtype=np.uint8))).sum(1).astype(np.uint8)
    spread = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = spread[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The `count` numbers of a block."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    ends = np.cumsum(lengths)
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    starts = ends - lengths
    out = np.zeros(count, np.uint32)
    for k in range(4):
        has = lengths > k
        if not has.any():
            break
        out[has] |= raw[starts[has] + k] << np.uint32(8 * k)
    return out


# -- text to ids ---------------------------------------------------------------------------------------------------


#: A lower-cased word whose comma or full stop the tokenizer takes apart: it follows an ASCII letter or digit or a Latin-1 letter.
_MARKED = r"[a-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}][.,]$"


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[i] to starts[i] + lengths[i] - 1 of every i in turn."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total + int(starts.max(initial=0)) < 1 << 31 else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


#: Texts and the parts that a file must encode alike to be used word by word.
_PROBES = (("Word", "word"), ("one  two\n\tthree ", "one", "two", "three"), ("ends.", "ends", "."), ("n\u00e9e, then", "n\u00e9e", ",", "then"), ("ABC 12.", "abc", "12", "."), ("", ""))


class Encoder:
    """Ids of texts, word by word, with a memory of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values() if t.content]
        # a special string stands between the words of one long text, which is faster than a text for each word
        self.mark, self.between = next(((i, t.content) for i, t in added.items() if t.content and not (t.lstrip or t.rstrip or t.single_word)), (None, None))
        self.points = {m: self._plain(m) for m in ".,"}
        self.by_word = all(self._plain(whole).tolist() == [i for p in parts for i in self._plain(p).tolist()] for whole, *parts in _PROBES)
        self._forget()

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _forget(self) -> None:
        """No words: each word's place in `starts` and `lengths`, which say where in `pool` its ids are."""
        self.known: dict[str, int] = {}
        self.pool, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of each text's ids), without end ids."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.array(list(map(len, each)), np.int64)
        lowered = pc.ascii_lower(texts)
        special = np.zeros(len(texts), bool)
        for s in self.special:  # "<|ENDOFTEXT|>" is not special, but its lower-cased word would be
            special |= pc.match_substring(lowered, pc.ascii_lower(s).as_py()).to_numpy(zero_copy_only=False)
        alone = {int(i): self._plain(texts[int(i)].as_py()) for i in np.flatnonzero(special)}
        if alone:
            lowered = pc.if_else(pa.array(special), pa.scalar("", lowered.type), lowered)
        split = pc.ascii_split_whitespace(lowered)
        coded = split.flatten().dictionary_encode()
        pool, lengths = self._distinct(coded.dictionary)
        starts = np.cumsum(lengths) - lengths
        words = coded.indices.to_numpy()
        sizes = lengths[words]
        flat = pool[_ranges(starts[words], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.asarray(split.offsets)]
        counts = np.diff(ends)
        if alone:
            parts = [alone.get(i, flat[a:b]) for i, (a, b) in enumerate(itertools.pairwise(ends.tolist()))]
            flat, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return flat, counts

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the words in turn, number of each word's ids); the words are lower-cased and differ."""
        marked = pc.match_substring_regex(words, _MARKED)
        bases = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        places = self._places(bases.dictionary.to_numpy(zero_copy_only=False).tolist())[bases.indices.to_numpy()]
        own, lengths = self.lengths[places], self.lengths[places]
        stop = pc.and_(marked, pc.ends_with(words, ".")).to_numpy(zero_copy_only=False)
        comma = pc.and_(marked, pc.ends_with(words, ",")).to_numpy(zero_copy_only=False)
        for where, ids in ((stop, self.points["."]), (comma, self.points[","])):
            lengths = lengths + where * len(ids)
        starts = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), np.uint32)
        out[_ranges(starts, own)] = self.pool[_ranges(self.starts[places], own)]
        for where, ids in ((stop, self.points["."]), (comma, self.points[","])):
            for k, i in enumerate(ids):
                out[(starts + own + k)[where]] = i
        return out, lengths

    def _places(self, words: list[str]) -> np.ndarray:
        """Each word's place; words without one are encoded and get one."""
        found = list(map(self.known.get, words))
        new = [w for w, at in zip(words, found, strict=True) if at is None]
        if new and len(self.known) + len(new) > REMEMBERED:
            self._forget()
            found, new = [None] * len(words), words
        ids, lengths = [self.pool], [self.lengths]
        for at in range(0, len(new), 20_000):
            more, sizes = self._words(new[at : at + 20_000])
            ids.append(more)
            lengths.append(sizes)
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.pool, self.lengths = np.concatenate(ids), np.concatenate(lengths)
            self.starts = np.cumsum(self.lengths) - self.lengths
            found = [self.known[w] if at is None else at for w, at in zip(words, found, strict=True)]
        return np.array(found, np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each word's ids) of words none of which holds a special string."""
        if self.between is None:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.array(list(itertools.chain.from_iterable(each)), np.uint32), np.array(list(map(len, each)), np.int64)
        ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(words)], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) != len(words) - 1:
            raise ValueError(f"{len(words)} words came back as {len(marks) + 1}")
        return ids[ids != self.mark], np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file: its memory lasts from task to task."""
    if path not in _made:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _made[path] = Encoder(path)
    return _made[path]


IDS = "part int, first long, doc_ids array<long>, counts array<long>, ids binary"
BLOCKS = "part int, first long, doc_ids array<long>, counts array<long>, control binary, data binary"


def _rows(schema: str, **columns: list) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), "first": pa.int64(), "doc_ids": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds.get(c, pa.binary())) for c in names], names)


def sorted_ids(docs: DataFrame, path: str) -> DataFrame:
    """Blocks of ids before ranking, in ascending order of documents: the one pass that tokenizes."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    # the salt parts equal rows alone, whose order does not matter
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("hash"), F.pmod(F.monotonically_increasing_id(), F.lit(997)).alias("salt"))
    placed = keyed.repartitionByRange(n, *order, F.col("salt")).sortWithinPartitions(*order, "text").select("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, held, size, first, part = [], [], [], 0, 0, 0
        end = np.array([END], np.uint32)

        def block() -> pa.RecordBatch:
            return _rows(IDS, part=[part], first=[first], doc_ids=[ids], counts=[counts], ids=[_packed(np.concatenate(held))])

        for rows in _pieces(batches):
            part = rows.column(2)[0].as_py()
            flat, sizes = encoder(path).ids(rows.column(1))
            at = 0
            for doc_id, n in zip(rows.column(0).to_pylist(), sizes.tolist(), strict=True):
                held += (flat[at : at + n], end)
                ids.append(doc_id)
                counts.append(n + 1)
                size, at = size + n + 1, at + n
                if size >= BLOCK:
                    yield block()
                    first, size, ids, counts, held = first + size, 0, [], [], []
        if ids:
            yield block()

    return placed.withColumn("part", F.spark_partition_id()).mapInArrow(run, IDS)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in turn, up to AT_ONCE bytes of text at a time; a longer text by itself."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).tolist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > AT_ONCE:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def _packed(ids: np.ndarray) -> bytes:
    """32-bit ids in two bytes each where they fit; the first byte tells."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1)


def id_counts(blocks: DataFrame) -> DataFrame:
    """(id, n) over all blocks; each task sums its own first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                got = np.bincount(_unpacked(packed.as_py()), minlength=len(counts))
                got[: len(counts)] += counts
                counts = got
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["id", "n"])

    return blocks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, ranks): the two tables of the format, written to the shared folder and read back.

    Texts are sorted by doc_id and tokenized where they land; the ids are written, counted and then ranked and coded
    block by block. Only counts of ids, of which there are no more than the vocabulary has, reach the driver.
    """
    path = path or default_path()
    spark = docs.sparkSession
    plain = written(sorted_ids(docs, path), "ids", "zstd")
    by_rank = np.array([r["id"] for r in id_counts(plain).orderBy(F.desc("n"), "id").select("id").collect()], np.uint32)  # at most the vocabulary
    ranks = written(spark.createDataFrame([(int(i), n) for n, i in enumerate(by_rank)], "id long, rank long"), "ranks")
    to_rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    to_rank[by_rank] = np.arange(len(by_rank))
    told = spark.sparkContext.broadcast(to_rank)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                control, data = encode(told.value[_unpacked(batch.column(4)[i].as_py())])
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns[:4]), pa.array([control], pa.binary()), pa.array([data], pa.binary())], [*batch.schema.names[:4], "control", "data"])

    return written(plain.mapInArrow(run, BLOCKS), "tokens", "zstd"), ranks


def read_tokens(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = blocks.sparkSession
    sums = blocks.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()  # a number a part
    before, total = [], 0
    for part, n in sorted(map(tuple, sums)):
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "part int, before long")
    table = np.zeros(max(1, ranks.count()), np.uint32)
    for i, rank in ranks.collect():  # at most the vocabulary
        table[rank] = i
    told = spark.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                counts = np.array(r["counts"], np.int64)
                ends = np.cumsum(counts)
                raw = told.value[decode(r["control"], r["data"], int(ends[-1]))].astype("<u4").tobytes()
                starts = r["before"] + r["first"] + ends - counts
                sums = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts), pa.array(counts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.join(F.broadcast(offsets), "part").select("first", "before", "doc_ids", "counts", "control", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the format and give, per document, what reading it back shows."""
    return read_tokens(*write_tokens(docs, path))
