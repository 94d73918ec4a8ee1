"""What the operators of this subpackage share: tables, the shared folder, learnable rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed by the query contracts: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The columns of `documents`, which every pipeline stage but the last returns.
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")

_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, whichever store Spark reads it from."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session with one machine's threads may leave
    it unset and gets a folder beside its warehouse; on a cluster it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-intermediate"
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; drop_written removes what is put there."""
    _made.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def count_written() -> int:
    """How many tables `written` has made that are still there."""
    return len(_made)


def drop_written(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Remove the tables that `written` has made after the first `since`, once what was read from them is stored.

    With `keep_last` the latest one, the stored result itself, stays.
    """
    gone = _made[since : -1 if keep_last else None]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _made.remove(name)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % F.lit(modulus)


#: Hash buckets of a class, each with its share of the wanted ids, so that map tasks already keep no more than they need.
_BUCKETS = 16
#: Ids asked for, for each text that is wanted, as some texts are too long or missing.
_SPARE = 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, max_chars: int) -> tuple[list[tuple[str, int]], float | None]:
    """(up to `limit` labelled texts of each class, share of class 1 among all learnable labels), for fitting.

    Learnable are rows whose remainder modulo 5 is not 0. Of each class the ids of least hash are chosen from `labels`
    (_SPARE times as many as wanted, each once however often it is labelled), and one pass over `docs` fetches
    a text for each, of several rows of one id that of least hash. Texts over `max_chars` characters are left out; a class that has
    no other ones gives the first `max_chars` of each, so that it is not lost. An id with both labels counts as 1. Only (text, label)
    comes back: no id, language or source can reach a model. Without labels, or without texts, the list is empty.
    No more rows than chosen ids reach the driver.
    """
    told = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & (remainder("_id", 5) != 0))
    share = told.agg(F.avg("_label")).first()[0]
    told = told.distinct().withColumn("_hash", F.xxhash64("_id"))
    place = F.row_number().over(Window.partitionBy("_label", F.pmod("_hash", F.lit(_BUCKETS))).orderBy("_hash", "_id"))
    ids: dict[int, int] = {}
    for r in told.withColumn("_place", place).where(F.col("_place") <= -(-limit * _SPARE // _BUCKETS)).collect():  # at most 2 * _SPARE * limit rows
        ids[r["_id"]] = max(r["_label"], ids.get(r["_id"], 0))
    if not ids:
        return [], share
    wanted = docs.sparkSession.createDataFrame(sorted(ids.items()), "_id long, _label int")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")).where(F.col("_text").isNotNull())
    found = texts.join(F.broadcast(wanted), "_id").groupBy("_id", "_label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    rows = sorted((r["_long"], r["_hash"], r["_id"], r["_text"], r["_label"]) for r in found.select((F.length("_text") > max_chars).alias("_long"), F.xxhash64("_id").alias("_hash"), "_id", F.left("_text", F.lit(max_chars)).alias("_text"), "_label").collect())
    short = {r[4] for r in rows if not r[0]}
    return [(r[3], value) for value in (0, 1) for r in [r for r in rows if r[4] == value and r[0] == (value not in short)][:limit]], share


def few(batch: pa.RecordBatch, column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of up to `rows` rows and `size` bytes of a text column; a longer text by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def common_count(counts: DataFrame, bound: int) -> int:
    """The least count such that no more than about `bound` rows have it or more, by eighths of powers of two."""
    told = counts.groupBy(F.floor(F.log2(F.col("n")) * 8).alias("b")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).orderBy(F.desc("b")).collect()  # at most 8 * 64 rows
    least, total = 1 << 62, 0
    for r in told:
        total += r["rows"]
        if total > bound:
            break
        least = r["least"]
    return least
