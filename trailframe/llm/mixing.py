"""Mixing sources to target weights.

Sizes (words) are summed per source. Sources in code point order, null last, weigh WEIGHTS, repeating, and share
SHARE of all sizes; a target stops at MOST times its source's size, and the excess is shared again by weight among the
others until none is above. A source's repetition rate is target / size; each document is taken floor(rate) times,
plus once more if a uniform number is below the fraction. The number is drawn from an md5 of the document's id, its text
and its occurrence (1, 2, ... among rows equal in both), so documents without an id, or of one id, draw each for
themselves, and reruns agree on any cluster.

Texts are read once: equal rows fold, by map-side counts, into (id, source, text key, size, number of rows), which is
written; all else works on that. Sources are ranked by ranges, so that their number is not bounded, and shares are found
by rounds over the table of sources (two sums a round go to the driver, never rows). Documents meet their source's target
by a join on the source that AQE may split; a source that holds a third of all rows is summed map-side first.

A null text has size 0 and is taken as often as its draw says, which adds no words; an empty source keeps target 0.
A null source is a source of its own, last in order. With no words at all every target is 0; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.llm.common import WORD, written

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
SEED = "mix-2"
#: Rows that one array lists at most while equal rows or copies are dealt out.
LISTED = 10_000
#: Repeated rows that are broadcast at most (about 100 bytes each).
BROADCAST_ROWS = 200_000


def size(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """What stands for a text in draws; null counts as empty."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def draw(doc_id: Column, key: Column, occurrence: Column, seed: str = SEED) -> Column:
    """A uniform number in [0, 1): 48 bits of an md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), key, F.lit(":"), occurrence.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def numbered(df: DataFrame, count: str, name: str) -> DataFrame:
    """Every row `count` times, with `name` running from 1; no array has more than LISTED entries."""
    pieces = df.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / LISTED))))
    last = F.least(F.col(count), (F.col("_piece") + 1) * LISTED)
    return pieces.withColumn(name, F.explode(F.sequence(F.col("_piece") * LISTED + 1, last))).drop("_piece")


def _ranked(sums: DataFrame) -> DataFrame:
    """`sums` with `place`, from 0, of the sources in code point order, null last: ranges are ranked each, then shifted."""
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    parts = written(sums.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "source-ranges")
    before, total = [], 0
    for part, n in sorted(map(tuple, parts.groupBy("_part").count().collect())):  # a number a range
        before.append((part, total))
        total += n
    shifts = sums.sparkSession.createDataFrame(before, "_part int, _before long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_within", within).join(F.broadcast(shifts), "_part").withColumn("place", F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of every source, from a table with `source` and `size`."""
    sums = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = written(sums.withColumn("weight", weight), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    whole, level = share * total, 0.0
    while True:  # the level per weight rises until no further source reaches its cap
        capped = F.col("source_size") * F.lit(most) <= F.col("weight") * F.lit(level)
        held, free = table.agg(F.sum(F.when(capped, F.col("source_size") * F.lit(most)).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if not free or (new := (whole - (held or 0.0)) / free) <= level * (1 + 1e-12):
            break
        level = new
    return table.select("source", "source_size", F.least(F.col("source_size") * F.lit(most), F.col("weight") * F.lit(level)).alias("target"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    """Written (doc_id, source, key, size, more, n): documents without their texts, equal rows folded."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), text_key(F.col("text")).alias("key"), size(F.col("text")).alias("size"), *more)
    return written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "sizes")


def _copies(occurrence: Column) -> Column:
    """How often a row with doc_id, key, source_size and target is taken."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return (whole + F.when(draw(F.col("doc_id"), F.col("key"), occurrence) < rate - whole, 1).otherwise(0)).cast("long")


def _with_targets(rows: DataFrame, found: DataFrame) -> DataFrame:
    t = found.select(F.col("source").alias("_source"), "source_size", "target")
    return rows.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mixed(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and copies: how often it is taken."""
    sized = _sized(docs)
    found = targets(sized.select("source", (F.col("size") * F.col("n")).alias("size")))
    rows = numbered(_with_targets(sized, found), "n", "occurrence")
    return rows.select("doc_id", "source", "size", "source_size", "target", _copies(F.col("occurrence")).alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The query's rows: doc_id, size, source_size, target, taken, source, copies."""
    return mixed(docs).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def repeat_documents(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each document as many times as the mix takes it; rows are equal, and numbered, if they agree in all of `columns`."""
    own = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns if c != "text")).alias("_own")
    sized = _sized(docs, own)
    found = targets(sized.select("source", (F.col("size") * F.col("n")).alias("size")))
    # rows that are there once draw where they stand; of repeated ones a single row carries the copies of all
    on = ["_own", "key"]
    several = numbered(_with_targets(sized.where("n > 1"), found), "n", "occurrence").groupBy(*on).agg(F.sum(_copies(F.col("occurrence"))).alias("_several"))
    several = written(several, "repeated")
    n_several = several.count()
    rows = _with_targets(docs.select(*dict.fromkeys(("doc_id", "source", *columns)), text_key(F.col("text")).alias("key"), own), found)
    if not n_several:
        return numbered(rows.withColumn("_copies", _copies(F.lit(1))).where(F.col("_copies") > 0), "_copies", "_copy").select(*columns)
    rows = rows.join(F.broadcast(several) if n_several <= BROADCAST_ROWS else several, on, "left")
    once = rows.where(F.col("_several").isNull()).withColumn("_copies", _copies(F.lit(1)))
    again = rows.where(F.col("_several").isNotNull()).dropDuplicates(on).withColumn("_copies", F.col("_several"))
    taken = once.unionByName(again).where(F.col("_copies") > 0)
    return numbered(taken, "_copies", "_copy").select(*columns)


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS key, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) AS occurrence
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST(list_extract([3, 1, 2], 1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3) AS DOUBLE) AS weight FROM sums
), ranked AS (
  SELECT *, 2.0 * source_size AS cap, row_number() OVER (ORDER BY 2.0 * source_size / weight, source) AS place,
    coalesce(sum(2.0 * source_size) OVER before, 0) AS held, sum(weight) OVER rest AS free, 1.5 * sum(source_size) OVER () AS whole
  FROM weighed
  WINDOW before AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), levels AS (
  SELECT arg_min((whole - held) / free, place) FILTER ((whole - held) / free * weight <= cap) AS level FROM ranked
), targets AS (
  SELECT source, source_size, least(cap, weight * coalesce(level, 1e300)) AS target FROM ranked, levels
), drawn AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix-2:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || d.key || ':' || d.occurrence), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), copied AS (
  SELECT *, CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM drawn
)
SELECT doc_id, size, source_size, round(target, 3) AS target, CAST(size * copies AS BIGINT) AS taken, source, copies FROM copied
"""
