"""Phrases of two to four words that stand together more often than their parts, mined with generalised suffix automata.

A shard is up to SHARD bytes of one language's texts within a task. Its automaton is built to a bounded depth: sorting the
words' contexts to the left, one more word at a time, gives the tree of its suffix links (a phrase's link is the phrase
without its first word), and the number of a context's places is the size of its endpos set. A context that has as many
places as its link has the same endpos set, so both are one state; a state stands for its phrases from the shortest to the
longest. The phrases are enumerated from the states and their counts are added up over all shards.

Three passes over the texts keep the shuffle small without losing a phrase: all words; two words, both of which are
frequent; three and four words, all of whose pairs are frequent. What is frequent is told by a bitmap of hashes (at most 64 MB,
whatever the corpus): where two hashes meet, a phrase is counted that need not be, and falls out by its own exact count.

Subsumption follows the links upwards, in both directions: a longer phrase is never commoner than one inside it, so a
phrase is inside a longer one that is common enough just if it is the suffix link of such a phrase (the phrase without its
first word), or the link in the mirrored automaton (without its last word), of a phrase of one word more.

A null text is empty, a null language is `und`. Every row counts, also where rows are equal or share an id. A phrase of any
length in characters is kept whole. No documents, or none with a phrase of LEAST occurrences, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.llm.common import common_count, few, written

#: Fixed by the query contract: occurrences of a candidate, words of a phrase, hundredths of a phrase's occurrences that a longer one needs, rows of a language.
LEAST, DEPTH, COVERED, TOP = 30, 4, 80, 2000
#: Bytes of text of a shard, and of all texts that a task holds; counts that are broadcast; bits of the largest bitmap.
SHARD, HELD, BROADCAST, MOST_BITS = 6 << 20, 18 << 20, 200_000, 1 << 29
_BREAK = "."
_SEEDS: dict[str, int] = {}


# -- the automaton -----------------------------------------------------------------------------------------------------


class States(NamedTuple):
    """The states whose longest phrase has a given number of words: a place where it ends, the words of the shortest one,
    the size of the endpos set, and the phrase that the suffix link names, by its number among those of one word less."""

    ends: np.ndarray
    shortest: np.ndarray
    count: np.ndarray
    link: np.ndarray
    open: np.ndarray  # whether the state is whole: no longer phrase has the same endpos set


def automaton(codes: np.ndarray, joined: np.ndarray, depth: int) -> list[States]:
    """States by the words of their longest phrase, up to `depth`, of words `codes` (not negative) in runs: a word with
    `joined` follows the one before it."""
    n = len(codes)
    run = np.arange(n) - np.maximum.accumulate(np.where(joined, 0, np.arange(n))) if n else np.zeros(0, np.int64)
    at = np.arange(n)
    context = np.zeros(n, np.int64)
    span = int(codes.max(initial=0)) + 1
    out: list[States] = []
    for d in range(1, depth + 1):
        at = at[run[at] >= d - 1]
        _, first, number, count = np.unique(context[at] * span + codes[at - (d - 1)], return_index=True, return_inverse=True, return_counts=True)
        link = context[at[first]] if d > 1 else np.full(len(first), -1)
        same = count == out[-1].count[link] if d > 1 else np.zeros(len(first), bool)
        if d > 1:
            out[-1].open[link[same]] = False
        out.append(States(at[first], np.where(same, out[-1].shortest[link], d) if d > 1 else np.ones(len(first), np.int64), count, link, np.ones(len(first), bool)))
        context[at] = number
    return out


def phrases(states: list[States], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, ends, counts) of all phrases of `least` words or more, each from its state."""
    for words in range(least, len(states) + 1):
        ends, counts = [], []
        for longest in range(words, len(states) + 1):
            s = states[longest - 1]
            has = s.open & (s.shortest <= words)
            ends.append(s.ends[has])
            counts.append(s.count[has])
        yield words, np.concatenate(ends), np.concatenate(counts)


# -- shards --------------------------------------------------------------------------------------------------------


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the words in turn by their number, whether each follows the one before it in its piece)."""
    marked = pc.binary_join_element_wise(pc.replace_substring_regex(pc.ascii_lower(texts), "[.,;:!?\n-\r]", f" {_BREAK} "), f" {_BREAK}", "")
    coded = pc.ascii_split_whitespace(marked).flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    stop, empty = (pc.index(words, pa.scalar(x, words.type)).as_py() for x in (_BREAK, ""))
    codes = codes[codes != empty]
    kept = codes != stop
    joined = np.concatenate([[False], kept[:-1]])[: len(codes)]
    return words, codes[kept], joined[kept]


def _seed(lang: str) -> int:
    if lang not in _SEEDS:
        _SEEDS[lang] = xxhash.xxh64_intdigest(lang.encode(), 42)
    return _SEEDS[lang]


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    """The hashes that xxhash64(lang, word) gives in Spark."""
    seed, h = _seed(lang), xxhash.xxh64_intdigest
    return np.array([h(w.encode(), seed) for w in words], np.uint64)


def phrase_hash(lang: Column, words: Column, n: int) -> Column:
    """The hash of one or two words."""
    one = F.xxhash64(lang, F.get(words, F.lit(0)))
    return one if n == 1 else F.shiftleft(one, 1).bitwiseXOR(F.xxhash64(lang, F.get(words, F.lit(1))))


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(frequent: DataFrame, n: int) -> np.ndarray:
    """The bits of the hashes of the phrases of `n` words, sixteen bits a phrase, as far as MOST_BITS allow."""
    bits = 1 << 20
    while bits < min(16 * frequent.count(), MOST_BITS):
        bits *= 2
    at = phrase_hash(F.col("lang"), F.split("phrase", " "), n).bitwiseAND(F.lit(bits - 1)) + 1
    rows = frequent.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.collect():  # at most 64 MB
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)[: bits // 8]
    return out


COUNTS = "lang string, phrase string, n long"


def _counted(lang: str, texts: list[pa.Array], depth: int, words_in: np.ndarray | None, pairs_in: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The phrases of a shard with their counts: words; pairs of frequent words; phrases of three words or more, of frequent pairs."""
    words, codes, joined = split_words(pa.concat_arrays(texts))
    if words_in is not None:
        hashes = word_hashes(lang, words.to_pylist())
        fine = _has(words_in, hashes)[codes]
        joined &= fine & np.concatenate([[False], fine[:-1]])[: len(codes)]
        if pairs_in is not None:
            mine = hashes[codes]
            at = np.flatnonzero(joined)
            joined[at] = _has(pairs_in, (mine[at - 1] << np.uint64(1)) ^ mine[at])
    least = {1: 1, 2: 2}.get(depth, 3)
    if least > 1:  # words that nothing follows and that follow nothing are in no phrase
        near = joined | np.concatenate([joined[1:], [False]])[: len(codes)]
        codes, joined = codes[near], joined[near]
    for n, ends, counts in phrases(automaton(codes.astype(np.int64), joined, depth), least):
        for at in range(0, len(ends), 100_000):
            some = ends[at : at + 100_000]
            parts = [words.take(pa.array(codes[some - k])) for k in range(n - 1, -1, -1)]
            made = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), made.cast(pa.string()), pa.array(counts[at : at + 100_000], pa.int64())], ["lang", "phrase", "n"])


def shard_counts(docs: DataFrame, depth: int, words_in: np.ndarray | None = None, pairs_in: np.ndarray | None = None, shard: int = SHARD) -> DataFrame:
    """(lang, phrase, n): the counts of all shards' phrases, added up."""
    context = docs.sparkSession.sparkContext
    told = context.broadcast((words_in, pairs_in))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for rows in few(batch, 1, 2_000, 4 << 20):
                langs = rows.column(0)
                for lang in pc.unique(langs).to_pylist():
                    texts = rows.column(1).filter(pc.equal(langs, lang))
                    held.setdefault(lang, []).append(texts)
                    sizes[lang] = sizes.get(lang, 0) + (pc.sum(pc.binary_length(texts)).as_py() or 0)
                while sizes and (max(sizes.values()) >= shard or sum(sizes.values()) >= HELD):
                    lang = max(sizes, key=sizes.get)
                    del sizes[lang]
                    yield from _counted(lang, held.pop(lang), depth, *told.value)
        for lang, texts in held.items():
            yield from _counted(lang, texts, depth, *told.value)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


# -- candidates ----------------------------------------------------------------------------------------------------


def phrase_counts(docs: DataFrame, least: int = LEAST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, n) of all words, and (lang, phrase, n, words) of all phrases of one to DEPTH words with n >= least."""
    often = F.col("n") >= least
    every = written(shard_counts(docs, 1, shard=shard), "words")
    words = every.where(often).withColumn("words", F.lit(1))
    words_in = bitmap(words, 1)
    pairs = written(shard_counts(docs, 2, words_in, shard=shard).where(often).withColumn("words", F.lit(2)), "phrases")
    longer = shard_counts(docs, DEPTH, words_in, bitmap(pairs, 2), shard).where(often).withColumn("words", F.size(F.split("phrase", " ")))
    longer = written(longer, "phrases")
    return every.groupBy("lang").agg(F.sum("n").alias("n")), words.unionByName(pairs).unionByName(longer)


def unsubsumed(counts: DataFrame) -> DataFrame:
    """The candidates (two words or more) that no longer one covers: (lang, phrase, a, words)."""
    w = F.split("phrase", " ")
    links = F.array(F.array_join(F.slice(w, 2, F.size(w) - 1), " "), F.array_join(F.slice(w, 1, F.size(w) - 1), " "))
    inside = counts.where("words >= 3").select("lang", F.explode(links).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("_longer"))
    kept = counts.where("words >= 2").join(inside, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("n") * COVERED))
    return kept.select("lang", "phrase", F.col("n").alias("a"), "words")


def scored(candidates: DataFrame, counts: DataFrame, bound: int = BROADCAST) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the lowest cut of each candidate; ties go to the least number of first words."""
    w = F.split("phrase", " ")
    cut = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(True).alias("first"), F.array_join(F.slice(w, 1, F.col("k")), " ").alias("part")), F.struct(F.lit(False).alias("first"), F.array_join(F.slice(w, F.col("k") + 1, F.size(w) - F.col("k")), " ").alias("part")))
    parts = cut.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.first", "s.part")
    known = counts.where(F.col("words") < DEPTH).select("lang", F.col("phrase").alias("part"), "n")
    least = common_count(known, bound)  # common parts are in many candidates, the others in few
    told = parts.join(F.broadcast(known.where(F.col("n") >= least)), ["lang", "part"], "left")
    rest = known.where(F.col("n") < least)
    if not rest.isEmpty():
        told = told.where("n IS NOT NULL").unionByName(told.where("n IS NULL").drop("n").join(rest, ["lang", "part"]))
    both = told.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("first"), F.col("n"))).alias("l"), F.max(F.when(~F.col("first"), F.col("n"))).alias("r"))
    score = F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000 div CAST(l + r AS DECIMAL(20, 0))")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, a and phrase."""
    totals, counts = phrase_counts(docs, least, shard)
    found = scored(unsubsumed(counts), counts)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # a language's best are chosen in parts first
    few_of = parted.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_place") <= top)
    ranked = few_of.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _oracle() -> str:
    """DuckDB SQL for collocations."""
    grams = " UNION ALL ".join(f"SELECT lang, list_aggregate(w[i:i + {k - 1}], 'string_agg', ' ') AS phrase, {k} AS words FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces WHERE len(w) >= {k})" for k in range(1, DEPTH + 1))
    return rf"""WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY 1),
counts AS (SELECT lang, phrase, words, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {LEAST}),
parts AS (SELECT lang, phrase, f, words, string_split(phrase, ' ') AS w FROM counts),
inside AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, unnest([list_aggregate(w[2:], 'string_agg', ' '), list_aggregate(w[:words - 1], 'string_agg', ' '), list_aggregate(w[2:words - 1], 'string_agg', ' '), list_aggregate(w[3:], 'string_agg', ' '), list_aggregate(w[:words - 2], 'string_agg', ' ')]) AS phrase FROM parts WHERE words >= 3) GROUP BY ALL),
kept AS (SELECT p.* FROM parts p LEFT JOIN inside i USING (lang, phrase) WHERE words >= 2 AND (longer IS NULL OR 100 * longer < {COVERED} * f)),
cuts AS (SELECT lang, phrase, f, list_aggregate(w[:k], 'string_agg', ' ') AS p1, list_aggregate(w[k + 1:], 'string_agg', ' ') AS p2, k FROM (SELECT *, unnest(range(1, words)) AS k FROM kept)),
scores AS (SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f // (x.f + y.f))::BIGINT AS score, k FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = p1 JOIN counts y ON y.lang = c.lang AND y.phrase = p2),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}"""


ORACLE_SQL = _oracle()
