"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a fixed mask over token positions: positions with 1 are hashed, positions with 0 are ignored, so a token
substituted at an ignored position leaves the hash as it was. Which masks an item uses depends on its length alone:

- LONG tokens or more: LONG_MASKS, four hashed positions each;
- SHORT to LONG - 1 tokens: SHORT_MASKS, three hashed positions each;
- WHOLE to SHORT - 1 tokens: one mask over all its tokens, so that it is found exactly or not at all;
- fewer: it matches only a text that consists of just these tokens, as such an item in a longer text tells nothing.

1. Test side: items of equal tokens are one, whatever their ids; every mask at every position gives a seed.
2. Training side: the same hashes at every position of every text, made inside one generated stage and looked up at
   once, so that only hits become rows; only masks that some item uses are hashed.
3. A hit lays the item along the text on one diagonal (position in the text less position in the item). Of a run of
   hits of one mask on one diagonal the first alone is kept, so an item copied whole costs a few rows, not one a token.
4. All tokens of the item are compared with the text's on that diagonal, so substituted tokens around a hit count as
   such. The item leaks if at least COVERED of its tokens are equal, or NEAR of some STRETCH neighbouring ones (of all
   its tokens if it has fewer than SHORT). tests/llm measures that the masks find 0.9 or more of the pairs within it.

Tokens are runs of letters and digits, in lower case; a character of a script without spaces is a token of its own.

Seeds and items are broadcast while they take BROADCAST_BYTES or less. Beyond that, hashes of both sides shuffle (AQE
splits hot ones), hits fold to distinct (text, item, diagonal) and only then meet the tokens. Both ways give the same
rows.

Null and empty texts and items have no tokens and never match. Items of one id and different texts are compared one by
one; a row tells the best covered one. Repeated document ids fold into one row per (doc_id, item_id); null ids are kept
as null. Other columns are not read. An empty benchmark, or no documents, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import written

#: Masks by an item's number of tokens; 1 is hashed, 0 is ignored.
LONG_MASKS = ("11101", "100111", "1010011")
SHORT_MASKS = ("1101", "1011", "11001")
WHOLE, SHORT, LONG = 3, 7, 12
COVERED, STRETCH, NEAR = 0.6, 20, 13
#: Bytes of seeds and items, or of contaminated keys, that are broadcast at most; rows are counted with what a hash table adds.
BROADCAST_BYTES = 64 << 20
_SEED_BYTES, _TOKEN_BYTES, _KEY_BYTES = 64, 32, 64

#: Scripts without spaces: Thai, Lao, Tibetan, Burmese, Khmer, Japanese, Chinese. Ranges of code points, which are matched
#: many times faster than names of scripts; texts without a character from the first of them on are not searched for them.
_UNSPACED = r"\x{0E00}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
_BEYOND = r"[\x{0E00}-\x{10FFFF}]"
#: All masks in order, each with the number of tokens its items have at least and at most; the last two stand for whole short texts.
MASKS: tuple[tuple[str, int, int], ...] = (
    *((m, LONG, 1 << 30) for m in LONG_MASKS),
    *((m, SHORT, LONG - 1) for m in SHORT_MASKS),
    *(("1" * n, n, n) for n in range(WHOLE, SHORT)),
    *(("1" * n, n, n) for n in range(1, WHOLE)),
)


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, characters of unspaced scripts apart; no tokens for null."""
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    spaced = F.when(low.rlike(_BEYOND), F.regexp_replace(low, f"([{_UNSPACED}])", " $1 ")).otherwise(low)
    return F.array_remove(F.split(spaced, r"[^\p{L}\p{N}]+"), "")


def _hits_at(of: Column, at: Column, mask: str) -> list[Column]:
    return [F.get(of, at + k) for k, on in enumerate(mask) if on == "1"]


def _seed(n: int, of: Column, at: Column) -> Column:
    """The hash of mask n at `at`; null where the mask runs over the end, or where a text is not the whole item."""
    mask, _, most = MASKS[n]
    fits = F.size(of) == len(mask) if most < WHOLE else at + len(mask) <= F.size(of)
    return F.when(fits, F.xxhash64(F.lit(n), *_hits_at(of, at, mask)))


def _windows(df: DataFrame, of: str, masks: list[int]) -> DataFrame:
    """A row for every position and mask: `at` and `seed` beside the columns of df."""
    placed = df.select("*", F.posexplode(of).alias("at", "_token")).drop("_token")
    return placed.select("*", F.explode(F.array(*(_seed(n, F.col(of), F.col("at")) for n in masks))).alias("seed"))


def _masks_of(size: Column) -> Column:
    """The numbers of the masks that an item of this size uses."""
    return F.filter(F.array(*(F.when(size.between(low, high), F.lit(n)) for n, (_, low, high) in enumerate(MASKS))), lambda n: n.isNotNull())


def _first_of_run() -> Column:
    """Whether the hit's mask does not hit one place earlier on the diagonal, where the item goes that far."""
    earlier = F.lit(False)
    for n, (mask, _, _) in enumerate(MASKS):
        pairs = zip(_hits_at(F.col("tokens"), F.col("at") - 1, mask), _hits_at(F.col("item_tokens"), F.col("offset") - 1, mask), strict=True)
        same = F.lit(True)
        for a, b in pairs:
            same = same & a.eqNullSafe(b)
        earlier = F.when(F.col("mask") == n, same).otherwise(earlier)
    return (F.col("offset") == 0) | (F.col("at") == 0) | ~earlier


def _compared() -> Column:
    """struct(matched, near): equal tokens on the diagonal, and the most among STRETCH neighbouring ones."""
    equal = F.transform(F.sequence(F.lit(0), F.size("item_tokens") - 1), lambda k: F.get("tokens", F.col("diagonal") + k).eqNullSafe(F.get("item_tokens", k)).cast("int"))
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("matched"), F.lit(0).alias("now"), F.lit(0).alias("near"), equal.alias("equal"))

    def step(a: Column, x: Column) -> Column:
        now = a["now"] + x - F.coalesce(F.get(a["equal"], a["k"] - STRETCH), F.lit(0))
        return F.struct((a["k"] + 1).alias("k"), (a["matched"] + x).alias("matched"), now.alias("now"), F.greatest(a["near"], now).alias("near"), a["equal"].alias("equal"))

    return F.aggregate(equal, start, step, lambda a: F.struct(a["matched"].alias("matched"), a["near"].alias("near")))


def _leaking() -> Column:
    whole = F.col("n_tokens") < SHORT
    enough = (F.col("matched") >= F.lit(COVERED) * F.col("n_tokens")) | (F.col("near") >= NEAR)
    return F.when(whole, F.col("matched") == F.col("n_tokens")).otherwise(enough)


_FOUND = ("doc_id", "text_hash", "text_length", "item", "n_tokens")


def _text_key() -> tuple[Column, Column]:
    """What tells rows of one id apart: hash and length of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.xxhash64(text).alias("text_hash"), F.length(text).alias("text_length")


def _found(docs: DataFrame, items: DataFrame, most_bytes: int) -> DataFrame:
    """(doc_id, text_hash, text_length, item, n_tokens, matched, near) of the leaks of written `items` (item, item_tokens)."""
    sizes = F.size("item_tokens")
    seeds = written(
        items.select("item", "item_tokens", sizes.alias("n_tokens"), F.explode(_masks_of(sizes)).alias("mask"))
        .select("item", "item_tokens", "n_tokens", "mask", F.posexplode("item_tokens").alias("offset", "_token"))
        .select("item", "mask", "offset", F.coalesce(*(F.when(F.col("mask") == n, _seed(n, F.col("item_tokens"), F.col("offset"))) for n in range(len(MASKS)))).alias("seed"))
        .where("seed IS NOT NULL"),
        "seeds",
    )
    n_seeds, masks = seeds.agg(F.count(F.lit(1)), F.sort_array(F.collect_set("mask"))).first()
    masks = masks or [0]
    taken = n_seeds * _SEED_BYTES + (items.agg(F.sum(F.aggregate("item_tokens", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + _TOKEN_BYTES))).first()[0] or 0)
    texts = docs.select("doc_id", *_text_key(), tokens(F.col("text")).alias("tokens"))
    if taken <= most_bytes:
        hits = _windows(texts, "tokens", masks).join(F.broadcast(seeds), "seed").join(F.broadcast(items), "item").where(_first_of_run())
        laid = hits.withColumn("diagonal", F.col("at") - F.col("offset"))
    else:
        keyed = texts.dropDuplicates(["doc_id", "text_hash", "text_length"])
        hits = _windows(keyed, "tokens", masks).select("doc_id", "text_hash", "text_length", "at", "seed").join(seeds, "seed")
        folded = hits.select("doc_id", "text_hash", "text_length", "item", (F.col("at") - F.col("offset")).alias("diagonal")).distinct()
        k, f = keyed.alias("k"), folded.join(items, "item").alias("f")
        same = F.col("k.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("k.text_hash") == F.col("f.text_hash")) & (F.col("k.text_length") == F.col("f.text_length"))
        laid = f.join(k, same).select("f.*", "k.tokens")
    compared = laid.select(*_FOUND[:-1], F.size("item_tokens").alias("n_tokens"), _compared().alias("_c")).select(*_FOUND, "_c.matched", "_c.near")
    return compared.where(_leaking())


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((item_id, item_tokens), (item, item_tokens)): items with tokens by id, and each list of tokens once, numbered."""
    named = written(benchmark.select("item_id", tokens(F.col("text")).alias("item_tokens")).where(F.size("item_tokens") > 0).distinct(), "items")
    return named, written(named.select("item_tokens").distinct().select(F.monotonically_increasing_id().alias("item"), "item_tokens"), "item-texts")


def leaks(docs: DataFrame, benchmark: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per leak: doc_id, item_id, n_tokens, matched, near and coverage of the item's best covered text."""
    named, items = _items(benchmark)
    best = _found(docs, items, most_bytes).groupBy("doc_id", "item", "n_tokens").agg(F.max(F.struct("matched", "near")).alias("_m"))
    ids = named.join(items, "item_tokens").select("item", "item_id")
    side = ids if ids.count() * _KEY_BYTES > most_bytes else F.broadcast(ids)
    coverage = (F.col("_m.matched") / F.col("n_tokens")).alias("coverage")
    told = best.join(side, "item").select("doc_id", "item_id", F.struct(coverage, F.col("_m.matched").alias("matched"), F.col("_m.near").alias("near"), "n_tokens").alias("_b"))
    return told.groupBy("doc_id", "item_id").agg(F.max("_b").alias("_b")).select("doc_id", "item_id", "_b.n_tokens", "_b.matched", "_b.near", "_b.coverage")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, columns: Iterable[str], most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that no item leaks into; of rows with one id, or none, only those whose own text leaks go.

    Contaminated (doc_id, text) keys are broadcast while they take `most_bytes` or less, and joined beyond that.
    """
    _, items = _items(benchmark)
    bad = written(_found(docs, items, most_bytes).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("text_length").alias("_length")).distinct(), "leaked")
    side = F.broadcast(bad) if bad.count() * _KEY_BYTES <= most_bytes else bad
    rows = docs.select(*columns, *(c.alias(f"_own_{n}") for c, n in zip(_text_key(), ("hash", "length"), strict=True)))
    same = rows["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash")) & (F.col("_own_length") == F.col("_length"))
    return rows.join(side, same, "left_anti").select(*columns)
