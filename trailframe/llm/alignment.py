"""Alignment of two tokenizers' tokens of the same texts: groups, links, and how often ids are linked.

Texts are tokenized in Arrow batches into ids and the byte offset at which each token ends. All that follows is made of
Spark's higher-order functions: offsets at which tokens of both sides end (array_intersect) cut a text into groups, and
a merge of the sorted ends gives every pair of tokens whose bytes overlap (a link) in linear time. The links of a pair of ids
are counted once a document.

The counts of pairs are joined to the documents' links: the commonest BROADCAST of them by a broadcast (their number is
chosen by a histogram of the counts), the others by a shuffle; none of those is common, so no key is hot. An id's highest
count is a broadcast of no more rows than the vocabulary has.

A null or empty text, and one whose tokens' bytes do not spell a space and the text, has no tokens: zeros and an empty
string. Every row is a document, also where rows are equal, share an id, or have none. Texts are read whole. No documents give no
rows; further columns are left out.

Texts are tokenized by units where both vocabularies allow it (probes tell when they are loaded): a unit is a space and
what follows up to the next one. As no token crosses its ends, its tokens, groups and links are the same wherever it stands, so
the units of a few MB of texts are aligned once each and texts are put together of them. A text with two spaces in a row or one at an
end is one unit, as every text is with other vocabularies.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import common_count, few, written
from trailframe.llm.tokens import _ranges

#: Bytes of text and rows that are tokenized at once; units a process remembers; pairs of ids that are broadcast.
AT_ONCE, ROWS, REMEMBERED, BROADCAST = 3 << 20, 10_000, 600_000, 1_000_000
#: Bytes up to which a unit may be long to be remembered.
UNIT = 200
#: Units that are Python objects at once.
OBJECTS = 4096
#: Tokens, of both sides, of a short unit.
SHORT = 64


#: Fixed value: how a byte-level pre-tokenizer splits texts.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PROBES = (" The quick brown fox's 12,345 don't", " \u00c9t\u00e9 na\u00efve \u00df\u0142", " a\n\n b \t\tc  d   ", " x_y-z...!?", " \x00\x7f\x85\xa0\xad", "")


def default_paths() -> tuple[str, str]:
    """The public vocabulary files of the query contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the other ones, in turn, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(others)}


class ByteLevel:
    """Side A: a byte-level vocabulary of the `tokenizers` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.spelled = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.sizes = _sizes(self.spelled)
        pre = json.loads(self.tokenizer.to_str())["pre_tokenizer"]
        self.by_unit = pre is not None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        self.ranked = self._ranked(alphabet) if self.by_unit else None

    def _ranked(self, alphabet: dict[str, int]):
        """The same vocabulary for `tiktoken`, which is faster, where its ids are in the order of its merges; probes are held against it."""
        import tiktoken

        added = set(self.tokenizer.get_added_tokens_decoder())
        ranks = {s: i for i, s in self.spelled.items() if i not in added}
        vocab, model = self.tokenizer.get_vocab(with_added_tokens=False), json.loads(self.tokenizer.to_str())["model"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(set(made)) or len(ranks) != len(made) + 256 or set(ranks.values()) != set(range(len(ranks))):
            return None
        ranked = tiktoken.Encoding("ranked", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        plain = [e.ids for e in self.tokenizer.encode_batch_fast(list(_PROBES), add_special_tokens=False)]
        return ranked if [ranked.encode_ordinary(p) for p in _PROBES] == plain else None

    def ids(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        # letters beyond Latin are left to the library of the file, whose classes of characters hold; so are long texts
        latin = [len(t) <= 1000 and (t.isascii() or max(t) < "\u0250") for t in texts]
        others = iter(self.tokenizer.encode_batch_fast([" " + t for t, x in zip(texts, latin, strict=True) if not x], add_special_tokens=False))
        return [self.ranked.encode_ordinary(" " + t) if x else next(others).ids for t, x in zip(texts, latin, strict=True)]


class Pieces:
    """Side B: a `sentencepiece` model that puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = self.model.id_to_piece
        n = self.model.get_piece_size()
        self.spelled = {i: bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(n)}
        self.sizes = _sizes(self.spelled)
        inside = any("▁" in piece(i).lstrip("▁") for i in range(n))
        probes = ("a", "one two", "éﬁ あ", "x.\ny  z ", "é")
        self.by_unit = not inside and all(b"".join(self.spelled[i] for i in self.model.encode(t)) == b" " + t.encode() for t in probes)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _sizes(spelled: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(spelled) + 1, np.int64)
    out[list(spelled)] = [len(s) for s in spelled.values()]
    return out


def _pool(each: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array(list(map(len, each)), np.int32)
    return np.fromiter(itertools.chain.from_iterable(each), np.int32, int(lengths.sum())), lengths


class Aligner:
    """Ids and ends of texts on both sides, with a memory of units."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = (ByteLevel(a_path), Pieces(b_path))
        self.by_unit = all(s.by_unit for s in self.sides)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.spells = np.zeros(0, bool)
        self.pools = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)) for _ in self.sides]

    def _encoded(self, texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(whether both sides spell a space and the text, (ids in turn, number of ids) of each side); few texts are held as Python objects at once."""
        right, pools = [np.zeros(0, bool)], [[(np.zeros(0, np.int32), np.zeros(0, np.int32))] for _ in self.sides]
        for start in range(0, len(texts), OBJECTS):
            some = texts.slice(start, OBJECTS).to_pylist()
            raw, fine = [b" " + t.encode() for t in some], np.ones(len(some), bool)
            for side, pool in zip(self.sides, pools, strict=True):
                each = side.ids(some)
                pool.append(_pool(each))
                fine &= self._spelled(side.spelled, each, raw, *pool[-1], side.sizes)
            right.append(fine)
        return np.concatenate(right), [(np.concatenate([x for x, _ in p]), np.concatenate([n for _, n in p])) for p in pools]

    @staticmethod
    def _spelled(spelled: dict[int, bytes], each: list[list[int]], raw: list[bytes], ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each text's ids spell it; where all lengths and the bytes of all texts in turn are equal, so is each text."""
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])[np.cumsum(lengths, dtype=np.int64)]
        if np.array_equal(ends, np.cumsum(list(map(len, raw)))) and b"".join(map(spelled.__getitem__, ids.tolist())) == b"".join(raw):
            return np.ones(len(raw), bool)
        return np.array([b"".join([spelled[i] for i in e]) == r for e, r in zip(each, raw, strict=True)], bool)

    def _places(self, units: pa.Array) -> np.ndarray:
        """Each unit's place in the pools; new ones are encoded. A repeated one may have several places, which hold the same."""
        units = units.cast(pa.string())
        at = pc.index_in(units, value_set=self.known)
        if at.null_count:
            if len(self.known) + at.null_count > REMEMBERED:
                self._forget()
                at = pa.nulls(len(units), pa.int32())
            fresh, first = at.is_null(), len(self.known)
            new = units.filter(fresh)
            right, pools = self._encoded(new)
            self.known = pa.concat_arrays([self.known, new])
            self.spells = np.concatenate([self.spells, right])
            for k, (ids, lengths) in enumerate(pools):
                lengths = np.concatenate([self.pools[k][2], lengths])
                self.pools[k] = (np.concatenate([self.pools[k][0], ids]), np.cumsum(lengths, dtype=np.int64) - lengths, lengths)
            places = at.fill_null(0).to_numpy().astype(np.int64)
            places[fresh.to_numpy(zero_copy_only=False)] = first + np.arange(len(new))
            return places
        return at.to_numpy().astype(np.int64)

    def units(self, texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """(of each side (ids, ends, number of ids) of the distinct units in turn, the texts' units in turn, number of units of each
        text); texts without tokens have no units."""
        texts = pc.fill_null(texts, "")
        whole = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " "))).to_numpy(zero_copy_only=False) | (not self.by_unit)
        split = pc.split_pattern(pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts), " ")
        coded = split.flatten().dictionary_encode()
        numbers = coded.indices.to_numpy().astype(np.int64)
        number = np.diff(np.asarray(split.offsets))
        known = coded.dictionary
        at = np.flatnonzero(whole)
        if len(at):  # a whole text takes the place of the one empty unit that splitting has left there
            numbers[(np.cumsum(number) - number)[at]] = len(known) + np.arange(len(at))
            known = pa.concat_arrays([known, texts.take(pa.array(at))])
        places, apart = self._found(known)
        spells = self.spells[places] if apart is None else apart[0]
        wrong = np.add.reduceat(~spells[numbers], np.cumsum(number) - number) > 0 if len(texts) else np.zeros(0, bool)
        wrong |= pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        kept = np.repeat(~wrong, number)
        number[wrong] = 0
        sides = []
        for k, side in enumerate(self.sides):
            if apart is None:
                pool, starts, lengths = self.pools[k]
                sizes = lengths[places]
                ids = pool[_ranges(starts[places], sizes)]
            else:
                ids, sizes = apart[1][k]
            ends, firsts = np.cumsum(side.sizes[ids]), np.cumsum(sizes) - sizes
            sides.append((ids, (ends - np.repeat(np.concatenate([[0], ends])[firsts], sizes)).astype(np.int32), sizes))
        return sides, numbers[kept], number

    def _found(self, units: pa.Array) -> tuple[np.ndarray | None, tuple | None]:
        """The units' places in the pools; what is too long to remember is encoded apart, with all of these units."""
        if not self.by_unit or pc.max(pc.binary_length(units)).as_py() is None or pc.max(pc.binary_length(units)).as_py() > UNIT:
            long = pc.greater(pc.binary_length(units), UNIT).to_numpy(zero_copy_only=False) | (not self.by_unit)
            short = self._places(units.filter(pa.array(~long)))
            right, pools = self._encoded(units.filter(pa.array(long)))
            spells = np.zeros(len(units), bool)
            spells[~long], spells[long] = self.spells[short], right
            joined = []
            for (pool, starts, lengths), (ids, counts) in zip(self.pools, pools, strict=True):
                first, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
                first[~long], size[~long] = starts[short], lengths[short]
                first[long], size[long] = len(pool) + np.cumsum(counts) - counts, counts
                joined.append((np.concatenate([pool, ids])[_ranges(first, size)], size))
            return None, (spells, joined)
        return self._places(units), None


_made: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """This process's aligner for two vocabulary files."""
    if paths not in _made:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _made[paths] = Aligner(*paths)
    return _made[paths]


_SIDES = "a array<int>, a_ends array<int>, a_keys array<long>, b array<int>, b_ends array<int>, b_keys array<long>"
PIECES = f"units array<struct<{_SIDES.replace(' array', ':array')}>>, docs array<struct<doc_id:long, n_a:long, n_b:long, units:array<int>>>"


def tokenized(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Pieces of up to AT_ONCE bytes of text, a row each: (units, docs); a unit is (a, a_ends, a_keys, b, b_ends, b_keys), both sides' ids, the byte
    offsets at which their tokens end, and these with the side and the token's index in lower bits; a document (doc_id, n_a, n_b, units) the numbers of its tokens and its units in turn."""
    paths = paths or default_paths()

    def lists(flat: np.ndarray, number: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(number)]).astype(np.int32)), pa.array(flat))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in few(batch, 1, ROWS, AT_ONCE):
                sides, numbers, number = aligner(paths).units(rows.column(1))
                keys = [(ends.astype(np.int64) << 32) | (side << 31) | _ranges(np.zeros(len(sizes), np.int64), sizes) for side, (_, ends, sizes) in enumerate(sides)]
                units = pa.StructArray.from_arrays([lists(x, sizes) for (ids, ends, sizes), k in zip(sides, keys, strict=True) for x in (ids, ends, k)], ["a", "a_ends", "a_keys", "b", "b_ends", "b_keys"])
                before = [np.concatenate([[0], np.cumsum(sizes[numbers])])[np.concatenate([[0], np.cumsum(number)])] for _, _, sizes in sides]
                docs = pa.StructArray.from_arrays([rows.column(0), *(pa.array(np.diff(x), pa.int64()) for x in before), lists(numbers.astype(np.int32), number)], ["doc_id", "n_a", "n_b", "units"])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (units, docs)], ["units", "docs"])
                del sides, numbers, number, keys, units, before, docs
                pa.default_memory_pool().release_unused()  # workers share their executor's memory

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


# -- groups and links, by higher-order functions ---------------------------------------------------------------------


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _index(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def links(a: Column, b: Column, merged: Column, width: int) -> Column:
    """An array of linked pairs of ids, each as a * width + b.

    At place k of the merge stands a token; of the other side k minus its own index have ended, so the next one of the
    other side overlaps it just before its end. Where both end at once, the pair is that of A's entry.
    """

    def pair(key: Column, k: Column) -> Column:
        i = _index(key)
        first = F.coalesce(F.get(a, i).cast("long") * width + F.get(b, k - i), F.lit(-1).cast("long"))
        second = F.coalesce(F.get(a, k - i).cast("long") * width + F.get(b, i), F.lit(-1).cast("long"))
        return F.when(~_of_b(key), first).when(_ends_alike(merged, key, k), F.lit(-1).cast("long")).otherwise(second)

    return F.array_remove(F.transform(merged, pair), F.lit(-1).cast("long"))


def _of_b(key: Column) -> Column:
    return key.bitwiseAND(F.lit(1 << 31)) != 0


def _ends_alike(merged: Column, key: Column, k: Column) -> Column:
    """Whether the entry of B at place k follows one of A with the same end."""
    return F.shiftright(F.get(merged, F.greatest(k - 1, F.lit(0))), 31) == F.shiftright(key, 31) - 1


def group_text(a: Column, b: Column, merged: Column, cuts: Column, a_ends: Column, b_ends: Column) -> Column:
    """`a1,a2|b1;a3|b2,b3`: the groups' ids. Groups end at `cuts`, where an end of either side is the same.

    A short unit's cuts are sought among its ends; a long one's are found in the merge, in linear time.
    """
    near = F.transform(cuts, lambda e: F.struct(F.array_position(a_ends, e).cast("int").alias("a"), F.array_position(b_ends, e).cast("int").alias("b")))
    twins = F.filter(F.sequence(F.lit(1), F.size(merged) - 1), lambda k: _of_b(F.get(merged, k)) & _ends_alike(merged, F.get(merged, k), k))
    far = F.transform(twins, lambda k: F.struct((_index(F.get(merged, k - 1)) + 1).alias("a"), (_index(F.get(merged, k)) + 1).alias("b")))

    def spelled(last: Column) -> Column:
        """With the numbers of both sides' tokens up to the end of each group."""

        def group(x: Column, c: Column) -> Column:
            before = F.get(last, F.greatest(c - 1, F.lit(0)))
            first = lambda side: F.when(c == 0, F.lit(0)).otherwise(before[side])
            ids = lambda held, side: F.array_join(F.slice(held, first(side) + 1, x[side] - first(side)).cast("array<string>"), ",")
            return F.concat_ws("|", ids(a, "a"), ids(b, "b"))

        return F.array_join(F.transform(last, group), ";")

    return F.when(F.size(merged) > 0, _let(F.when(F.size(merged) < SHORT, near).otherwise(far), spelled)).otherwise(F.lit(""))


def aligned_unit(unit: Column, width: int) -> Column:
    """struct(links, groups) of a unit. Where all ends of both sides meet, tokens pair off one by one."""
    a, b, a_ends, b_ends = (unit[c] for c in ("a", "b", "a_ends", "b_ends"))
    made = lambda linked, groups: F.struct(linked.alias("links"), groups.alias("groups"))
    one = F.transform(a, lambda x, i: F.coalesce(x.cast("long") * width + F.get(b, i), F.lit(-1).cast("long")))
    pairs = F.array_join(F.transform(a, lambda x, i: F.concat_ws("|", x.cast("string"), F.get(b, i).cast("string"))), ";")
    merge = _let(F.sort_array(F.concat(unit["a_keys"], unit["b_keys"])), lambda m: made(links(a, b, m, width), group_text(a, b, m, F.array_intersect(a_ends, b_ends), a_ends, b_ends)))
    return F.when(a_ends == b_ends, made(one, pairs)).otherwise(merge)


def aligned(pieces: DataFrame, width: int) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, links, groups_sha256) of the documents of tokenized pieces; row numbers them.

    Each end of either side closes one link, and an end of both sides a group as well, which gives the number of groups.
    """

    def document(d: Column, units: Column) -> Column:
        of = lambda c: F.transform(d["units"], lambda u: F.get(units, u)[c])
        return F.struct(d["doc_id"].alias("doc_id"), d["n_a"].alias("n_a"), d["n_b"].alias("n_b"), F.flatten(of("links")).alias("links"), F.array_join(of("groups"), ";").alias("groups"))

    told = pieces.select(F.explode(_let(F.transform("units", lambda u: aligned_unit(u, width)), lambda units: F.transform("docs", lambda d: document(d, units)))).alias("d"))
    n = F.size("d.links").cast("long")
    sha = F.when(F.col("d.n_a") > 0, F.sha2("d.groups", 256)).otherwise(F.lit(""))
    return told.select(F.monotonically_increasing_id().alias("row"), "d.doc_id", "d.n_a", "d.n_b", (F.col("d.n_a") + F.col("d.n_b") - n).alias("n_groups"), n.alias("n_links"), "d.links", sha.alias("groups_sha256"))


# -- counts --------------------------------------------------------------------------------------------------------


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, n): how many documents hold a pair linked."""
    return texts.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def ranked_pairs(counts: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): whether n is the highest of its A id's counts; of those there are no more than A has ids."""
    highest = counts.groupBy(F.floor(F.col("pair") / width).alias("_a")).agg(F.max("n").alias("_most"))
    return counts.withColumn("_a", F.floor(F.col("pair") / width)).join(F.broadcast(highest), "_a").select("pair", "n", (F.col("n") == F.col("_most")).cast("int").alias("best"))


def summed(texts: DataFrame, ranked: DataFrame, bound: int = BROADCAST) -> DataFrame:
    """(row, n_best, count_sum) of texts with links."""
    least = common_count(ranked, bound)
    common, others = ranked.where(F.col("n") >= least), ranked.where(F.col("n") < least)
    rows = texts.select("row", F.explode("links").alias("pair"))
    if others.isEmpty():
        told = rows.join(F.broadcast(common), "pair")
    else:
        marked = rows.join(F.broadcast(common), "pair", "left")
        told = marked.where("n IS NOT NULL").unionByName(marked.where("n IS NULL").select("row", "pair").join(others, "pair"))
    return told.groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))


def aligned_documents(docs: DataFrame, paths: tuple[str, str] | None = None, bound: int = BROADCAST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of `docs`."""
    paths = paths or default_paths()
    width = len(Pieces(paths[1]).sizes)
    texts = written(aligned(tokenized(docs, paths), width), "aligned", "zstd")
    ranked = written(ranked_pairs(written(pair_counts(texts), "pairs"), width), "ranked")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return texts.drop("links").join(summed(texts, ranked, bound), "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
