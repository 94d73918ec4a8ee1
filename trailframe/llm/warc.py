"""WARC archives of pages, and a two-level capture index over them.

Archives. Each task writes files of its own, one gzip member a record, and gives a row for each capture; the rows are
written by Spark's committer, so that of a task that ran twice just one file's captures count. A record is an HTTP
response whose payload is the page's html in UTF-8. Of records with equal payloads of at least LEAST bytes the one with
the largest page_id is the response; the others are revisits, which hold the HTTP head alone and name the response.

Index. Captures are sorted by the page's URL with its host reversed (`com,example)/path`) and packed into compressed
blocks of BLOCK lines (first level); a directory holds the first and last key of each block and where the block lies (second
level, a BLOCK-th of the captures). A lookup searches the directory by bisection, reads the blocks by their byte ranges,
searches their lines by bisection, and reads the records by their byte ranges. A directory of up to BROADCAST blocks goes
to every task whole; a larger one is cut into runs of blocks, a task bisects the keys of the runs, and keys meet their
run in a join (of distinct keys, so a run meets no more keys than its blocks have lines). A key that fills many blocks is
read as many rows. Nothing is cut off.

A null or empty html is an empty payload. A null URL has the empty key and no target in its record. A null page_id counts as
below all others; of equal payloads without any page_id, and of rows that share the largest page_id, all are responses.
Repeated rows are captured each; no pages give no rows. Pages' further columns are left out.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import new_folder, written

#: Payloads shorter than this are always written whole.
LEAST = 1000
#: Bytes after which a task opens the next archive; lines of an index block; bytes that one read may ask for, and bytes between two records that are read along.
ARCHIVE, BLOCK, AT_ONCE, GAP = 1 << 30, 1024, 8 << 20, 1 << 16
#: Rows of keepers, and blocks of a directory, that are broadcast (of about 150 bytes each); share of all rows above which a payload is hot.
BROADCAST, HOT = 400_000, 2_000
#: Pages have no time of capture.
DATE = "1970-01-01T00:00:00Z"
#: Fixed by the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

CAPTURE = "key string, page_id long, file string, offset long, length long"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder in the shared space, and the folder's path there."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def url_key(url: Column) -> Column:
    """The URL with its host reversed, without scheme, user and fragment: `com,example,www:8080)/path?query`; numeric hosts stay."""
    plain = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"#.*$", "")
    place = F.lower(F.regexp_extract(plain, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?@]*@)?([^/?]*)", 1))
    rest = F.regexp_replace(plain, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?]*", "")
    host, port = F.regexp_extract(place, r"^(.*?)(:\d*)?$", 1), F.regexp_extract(place, r"^(.*?)(:\d*)?$", 2)
    turned = F.when(host.rlike(r"^[0-9.]+$|^\["), host).otherwise(F.array_join(F.reverse(F.split(host, r"\.")), ","))
    return F.when(place == "", rest).otherwise(F.concat(turned, port, F.lit(")"), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


# -- archives ------------------------------------------------------------------------------------------------------


def marked(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, key, payload, digest, response_id): response_id is null unless the row's payload is written by another row."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"), F.sha1(html).alias("digest")).withColumn("key", url_key(F.col("url")))
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    keepers = written(sized.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 AND keeper IS NOT NULL"), "keepers")
    if keepers.count() <= BROADCAST:
        joined = rows.join(F.broadcast(keepers.drop("n")), "digest", "left")
    else:  # at most HOT payloads can each have more than a HOT-th of all rows; the others are no hot keys
        many = F.col("n") * HOT > rows.count()
        hot, rest = keepers.where(many).select("digest", F.col("keeper").alias("_hot")), keepers.where(~many).drop("n")
        told = rows.join(F.broadcast(hot), "digest", "left")
        joined = told.where("_hot IS NOT NULL").withColumnRenamed("_hot", "keeper").unionByName(told.where("_hot IS NULL").drop("_hot").join(rest, "digest", "left"))
    return joined.select("page_id", "url", "key", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("response_id"))


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, response_id: int | None) -> bytes:
    """A response or, with a response_id, a revisit, as one gzip member; `digest` is the payload's hexadecimal SHA-1."""
    body = _HTTP % len(payload) + (payload if response_id is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if response_id is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(0x21, 0x7F))))}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if response_id is not None:
        head += [f"WARC-Refers-To: {_name(response_id, digest)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return _member("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _info() -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return _member(head.encode() + body + b"\r\n\r\n")


def write_archives(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Archives of `pages` in the shared folder; the written table of their captures (key, page_id, file, offset, length)."""
    folder = new_folder(pages.sparkSession, "warc")
    store(folder)[0].create_dir(store(folder)[1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        out, name, at = None, "", 0
        for batch in batches:
            page_ids, urls, keys, payloads, digests, responses = batch.columns
            rows = []
            for i in range(batch.num_rows):
                if out is None or at >= ARCHIVE:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                    at = out.write(_info())
                made = record(page_ids[i].as_py(), urls[i].as_py(), payloads[i].as_py(), digests[i].as_py(), responses[i].as_py())
                out.write(made)
                rows.append((keys[i].as_py(), page_ids[i].as_py(), name, at, len(made)))
                at += len(made)
            yield _captures(rows)
        if out is not None:
            out.close()

    return written(marked(pages, least).select("page_id", "url", "key", "payload", "digest", "response_id").mapInArrow(run, CAPTURE).withColumn("folder", F.lit(folder)), "captures", "zstd")


_KINDS = {"key": pa.string(), "page_id": pa.int64(), "file": pa.string(), "offset": pa.int64(), "length": pa.int64()}


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _KINDS.values(), strict=True)], list(_KINDS))


# -- index ---------------------------------------------------------------------------------------------------------

DIRECTORY = "first string, last string, file string, offset long, length long, lines long"


def _line(key: str, page_id: int | None, file: str, offset: int, length: int) -> str:
    return "\t".join((key, "" if page_id is None else str(page_id), file, str(offset), str(length)))


def write_index(captures: DataFrame) -> DataFrame:
    """The index's blocks in the shared folder; its directory, a written table of (first, last, file, offset, length, lines, folder, archives)."""
    spark = captures.sparkSession
    folder = new_folder(spark, "cdx")
    store(folder)[0].create_dir(store(folder)[1])
    key = F.regexp_replace("key", r"[\t\r\n]", " ")  # a line is one line; looked up alike
    order = ["key", "page_id", "file", "offset"]
    placed = captures.select(key.alias("key"), *order[1:], "length").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        out, name, at, held = None, f"{uuid.uuid4().hex}.cdx.gz", 0, []
        told = []

        def block() -> None:
            nonlocal out, at, held
            out = out or files.open_output_stream(f"{root}/{name}", compression=None)
            packed = _member("\n".join(_line(*r) for r in held).encode())
            out.write(packed)
            told.append((held[0][0], held[-1][0], name, at, len(packed), len(held)))
            at, held = at + len(packed), []

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(r)
                if len(held) == BLOCK:
                    block()
        if held:
            block()
        if out is not None:
            out.close()
        columns = list(zip(*told, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["first", "last", "file", "offset", "length", "lines"])

    archives = captures.select("folder").first()
    return written(placed.select("key", "page_id", "file", "offset", "length").mapInArrow(run, DIRECTORY).withColumns({"folder": F.lit(folder), "archives": F.lit(archives[0] if archives else "")}), "directory", "zstd")


def _spans(keys: list[str], firsts: list[str], lasts: list[str]) -> list[tuple[int, int]]:
    """The sorted blocks (from, to) that can hold each key: the first one that ends with it or after, up to the last one that begins with it or before."""
    first, last = ([t.encode() for t in side] for side in (firsts, lasts))
    return [(bisect.bisect_left(last, k), bisect.bisect_right(first, k)) for k in (k.encode() for k in keys)]


def blocks_of(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, file, offset, length): every block that can hold a key of `keys` (key), found by bisection."""
    wanted = keys.select(F.regexp_replace("key", r"[\t\r\n]", " ").alias("key")).distinct()
    n = directory.count()
    if n <= BROADCAST:
        return _found(wanted, directory.select("first", "last", "file", "offset", "length"), "file string, offset long, length long")
    # runs of blocks: ranges of the directory, one partition each; a row for each run goes to every task
    parts = written(directory.select("first", "last", "file", "offset", "length").repartitionByRange(-(-n // BLOCK), "first", "last", "file", "offset").withColumn("run", F.spark_partition_id()), "runs")
    near = _found(wanted, parts.groupBy("run").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("first", "last", "run"), "run int")
    return near.join(parts, "run").where("first <= key AND key <= last").select("key", "file", "offset", "length")


def _found(wanted: DataFrame, ranges: DataFrame, schema: str) -> DataFrame:
    """`wanted` (key) with the columns of `schema` of every one of the few sorted `ranges` (first, last, ...) that can hold the key."""
    rows = sorted((tuple(r) for r in ranges.collect()), key=lambda r: (r[0].encode(), r[1].encode(), *r[2:]))
    told = wanted.sparkSession.sparkContext.broadcast(rows)
    names, kinds = zip(*((c.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]]) for c in f"key string, {schema}".split(", ")), strict=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = [r[0] for r in told.value], [r[1] for r in told.value]
        for batch in batches:
            held = batch.column(0).to_pylist()
            found = ((k, *told.value[b][2:]) for k, (x, y) in zip(held, _spans(held, firsts, lasts), strict=True) for b in range(x, y))
            while some := list(itertools.islice(found, 10_000)):  # a key may fill many blocks
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], list(names))

    return wanted.mapInArrow(run, f"key string, {schema}")


def lookup(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """The captures (key, page_id, file, offset, length) of every key of `keys` (key); a key without captures has no row."""
    places = directory.select("folder", "archives").first()
    if places is None:
        return directory.sparkSession.createDataFrame([], CAPTURE)
    folder = places[0]
    spread = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["file", "offset", "key"]
    placed = blocks_of(directory, keys).repartitionByRange(spread, *order).sortWithinPartitions(*order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (file, offset, length), wanted in itertools.groupby(rows, key=lambda r: r[1:]):
            with files.open_input_file(f"{root}/{file}") as f:
                lines = [line.split("\t") for line in zlib.decompress(f.read_at(length, offset), 31).decode().split("\n")]
            keys = [x[0].encode() for x in lines]
            out = []
            for key, *_ in wanted:
                sought = key.encode()
                out += [(x[0], int(x[1]) if x[1] else None, x[2], int(x[3]), int(x[4])) for x in lines[bisect.bisect_left(keys, sought) : bisect.bisect_right(keys, sought)]]
            yield _captures(out)

    return placed.mapInArrow(run, CAPTURE)


# -- reading -------------------------------------------------------------------------------------------------------

RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def parse(raw: bytes) -> dict:
    """A record of these archives; its payload is checked against its digest. A revisit has no payload, but its size and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: ")).split()[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda name: int(fields[name].split(":")[2]) if fields[name].split(":")[2] else None
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (size != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is not what its head says")
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To") if revisit else None, "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest}


def read_records(captures: DataFrame, archives: str) -> DataFrame:
    """The records of captures (file, offset, length), read by their byte ranges; neighbours in one read."""
    spread = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = captures.select("file", "offset", "length").repartitionByRange(spread, "file", "offset").sortWithinPartitions("file", "offset")
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(archives)
        for batch in batches:
            for file, ranges in _reads(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                first = ranges[0][0]
                with files.open_input_file(f"{root}/{file}") as f:
                    raw = f.read_at(ranges[-1][0] + ranges[-1][1] - first, first)
                found = [parse(zlib.decompress(raw[o - first : o - first + n], 31)) for o, n in ranges]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], k) for c, k in kinds.items()], list(kinds))

    return placed.mapInArrow(run, RECORD)


def _reads(rows: Iterable[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) as reads of up to AT_ONCE bytes; a longer record by itself."""
    file, held = None, []
    for f, offset, length in rows:
        if held and (f != file or offset - sum(held[-1]) > GAP or offset + length - held[0][0] > AT_ONCE):
            yield file, held
            held = []
        file = f
        held.append((offset, length))
    if held:
        yield file, held


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write the archives and their index, look every page's key up, and give what the records say."""
    captures = write_archives(pages)
    directory = write_index(captures)
    places = captures.select("folder").first()
    found = lookup(directory, pages.select(url_key(F.col("url").cast("string")).alias("key")))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return read_records(found, places[0] if places else "").select(*columns)


#: DuckDB SQL for archived_pages.
ORACLE_SQL = f"""WITH rows AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM rows)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND page_id IS DISTINCT FROM keeper AND keeper IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to FROM kept"""
