"""Operator 1, WARC archives behind a two-level capture index.

*Writing.* Each task writes its captures as one archive, every record a gzip member of its own. Of captures with equal
payloads that of the smallest (id, URL) is a response record, the others are revisit records that name it and carry no
payload. Payloads are shuffled once, to meet their equals. What is sorted is the index: its lines (reversed-host URL key,
id, digest, archive, offset, length) are range-partitioned by key, and each task writes one shard of it: sorted lines in
compressed blocks, and a sparse directory with the first key of each block.

*Reading.* A lookup goes from its key to the shard (a list with one entry a shard), by binary search in the shard's
directory to the block, by a range read to the block's lines, by binary search to the lines, and by range reads of the
archives to the records. Lookups are range-partitioned as the index is, so a task reads few shards, each directory once;
the hits of a batch of lookups are read in the order of archive and offset, so an archive is opened once a batch.

Files go to a folder that driver and executors share, through ``pyarrow.fs`` (file, hdfs, s3, gs). A task writes under a
name of its own, and the shard list, itself written by Spark, names only files of tasks that succeeded, so retries and
lost executors leave at most files that nobody reads. Memory in a task is one record, one block of index lines and the
places of one batch's hits.

Defined results: a null payload is empty; null URLs and null ids are values of their own, first in the order of keys, but
an id of null is the response's only where all captures of a payload lack one; every row is a capture, so rows equal in
id, URL and payload are several records of one kind; an empty table gives no archives and an empty table; further columns
do not matter.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

BLOCK_LINES = 512
SHARDS_MOST = 4096
LEVEL = 4
KEY = ["url_key", "page_id", "digest"]
LINE = "url_key string, page_id long, digest string, archive string, offset long, length long"
SHARD = "index string, directory string, first string, records long"
FOUND = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


class Archive(NamedTuple):
    """What a finished write leaves: the folder and the Parquet table of its shards."""

    folder: str
    shards: str


def url_key(url: Column) -> Column:
    """The sort key of a URL: host labels reversed and joined by commas, ``)``, then path and query; scheme and a port are dropped."""
    u = F.lower(F.coalesce(url, F.lit("")))
    rest = F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^[^@]*@|:[0-9]+$", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"^[^/?#]*", ""), r"#.*$", "")
    return F.when(u == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path))


def captures(pages: DataFrame, payload: str = "html") -> DataFrame:
    """(page_id, url, url_key, payload, digest, refers_to, refers_url, revisits): one row a row of ``pages``; refers_to is null for responses."""
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", url_key(F.col("url")).alias("url_key"), F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b"")).alias("payload"))
    d = d.withColumns({"digest": F.sha1("payload"), "place": F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")})
    # One row a payload meets the captures; adaptive execution splits a payload that a third of them share.
    first = d.groupBy("digest").agg(F.min("place").alias("first")).withColumnRenamed("digest", "_digest")
    d = d.join(first, F.col("digest") == F.col("_digest")).withColumn("revisits", (F.col("place") != F.col("first")) & F.col("first.page_id").isNotNull())
    return d.select("page_id", "url", "url_key", "payload", "digest", *[F.when(F.col("revisits"), F.col(f"first.{c}")).alias(n) for c, n in (("page_id", "refers_to"), ("url", "refers_url"))], "revisits")


def base32_digest(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, json.dumps([page_id, url, digest]))}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, refers_url: str | None = None, revisits: bool = False, date: str = "2020-01-01T00:00:00Z") -> bytes:
    """A WARC/1.1 record whose block is the payload; a revisit record's block is empty. ``digest`` is hexadecimal SHA-1."""
    target = "".join(c for c in url or "" if c not in "\r\n")
    block = b"" if revisits else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base32_digest(digest)}"]
    lines += [] if page_id is None else [f"X-Capture-Id: {page_id}"]
    if revisits:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}", f"X-Refers-To-Capture-Id: {refers_to}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    header = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return header, rest[: int(header["content-length"])]


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _archived(folder: str):
    """Captures to one archive a task; the index lines of its records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/{uuid.uuid4().hex}.warc.gz"
        archive = None
        try:
            for batch in batches:
                if archive is None and batch.num_rows:
                    archive = store.open_output_stream(name, compression=None)
                offsets, lengths = [], []
                for row in range(batch.num_rows):
                    one = {c: batch.column(c)[row].as_py() for c in ("page_id", "url", "payload", "digest", "refers_to", "refers_url", "revisits")}
                    data = _gzip(make_record(**one))
                    offsets.append(archive.tell())
                    lengths.append(len(data))
                    archive.write(data)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array([name] * batch.num_rows, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=[*KEY, "archive", "offset", "length"])
        finally:
            if archive is not None:
                archive.close()

    return run


def _indexed(folder: str):
    """Sorted index lines to one shard a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/{uuid.uuid4().hex}"
        index = None
        lines: list[bytes] = []
        directory: list[list] = []
        block_first: list = []
        records = 0

        def close_block() -> None:
            packed = zlib.compress(b"\n".join(lines), LEVEL)
            directory.append([block_first, index.tell(), len(packed)])
            index.write(packed)
            lines.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*KEY, "archive", "offset", "length")), strict=True):
                if index is None:
                    index = store.open_output_stream(f"{name}.idx", compression=None)
                if not lines:
                    block_first = row[:3]
                lines.append(json.dumps(row).encode())
                records += 1
                if len(lines) >= BLOCK_LINES:
                    close_block()
        if index is None:
            return
        if lines:
            close_block()
        index.close()
        with store.open_output_stream(f"{name}.dir", compression=None) as out:
            out.write(_gzip(json.dumps(directory).encode()))
        one = [[f"{name}.idx"], [f"{name}.dir"], [json.dumps(directory[0][0])], [records]]
        types = [pa.string(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, types, strict=True)], names=["index", "directory", "first", "records"])

    return run


def write(found: DataFrame, folder: str, shards: int | None = None) -> Archive:
    """Writes ``captures`` as archives and their index under ``folder``, a URI that driver and executors share."""
    spark = found.sparkSession
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    # Spark commits the lines of tasks that succeeded; archives of others are named nowhere.
    found.select("page_id", "url", "url_key", "payload", "digest", "refers_to", "refers_url", "revisits").mapInArrow(_archived(folder), LINE).write.parquet(f"{folder}/lines")
    n = min(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), SHARDS_MOST)
    lines = spark.read.parquet(f"{folder}/lines").repartitionByRange(n, *KEY).sortWithinPartitions(*KEY)
    lines.mapInArrow(_indexed(folder), SHARD).write.parquet(f"{folder}/shards")
    return Archive(folder, f"{folder}/shards")


def _order(key: str, page_id: int | None, digest: str) -> tuple:
    """The place of an index key as Spark sorts them."""
    return key, page_id is not None, page_id or 0, digest


def _looked_up(folder: str, shards: list[dict]):
    """Lookups (url_key, page_id, digest), sorted, to the records of that key; a null digest stands for all."""
    starts = [_order(*json.loads(s["first"])) for s in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        now = block_at = index = None
        firsts: list = []
        directory: list = []
        lines: list = []
        keys: list = []

        def hits(wanted: tuple, parts: int) -> Iterator[tuple[str, int, int]]:
            nonlocal now, block_at, index, firsts, directory, lines, keys
            # equal keys lie in one shard but may run over blocks, and keys of one page over shards
            for shard in range(max(bisect.bisect_left(starts, wanted) - 1, 0), len(starts)):
                if starts[shard][:parts] > wanted[:parts]:
                    return
                if shard != now:
                    if index is not None:
                        index.close()
                    now, block_at = shard, None
                    index = store.open_input_file(shards[shard]["index"])
                    with store.open_input_file(shards[shard]["directory"]) as f:
                        directory = json.loads(zlib.decompress(f.read(), 31))
                    firsts = [_order(*d[0]) for d in directory]
                for block in range(max(bisect.bisect_left(firsts, wanted) - 1, 0), len(firsts)):
                    if firsts[block][:parts] > wanted[:parts]:
                        break
                    if block != block_at:
                        offset, length = directory[block][1:]
                        lines = [json.loads(x) for x in zlib.decompress(index.read_at(length, offset)).split(b"\n")]
                        keys = [_order(*x[:3]) for x in lines]
                        block_at = block
                    for at in range(bisect.bisect_left(keys, wanted), len(keys)):
                        if keys[at][:parts] != wanted[:parts]:
                            break
                        yield tuple(lines[at][3:])

        try:
            for batch in batches:
                places = []
                for key, page_id, digest in zip(*(batch.column(c).to_pylist() for c in KEY), strict=True):
                    places += [(*hit, page_id) for hit in hits(_order(key, page_id, digest or ""), 3 if digest is None else 4)]
                out: list[tuple] = []
                size = 0
                name, archive = None, None
                for at, offset, length, page_id in sorted(places, key=lambda x: x[:2]):
                    if at != name:
                        if archive is not None:
                            archive.close()
                        name, archive = at, store.open_input_file(at)
                    header, payload = parse_record(zlib.decompress(archive.read_at(length, offset), 31))
                    if header.get("x-capture-id") != (None if page_id is None else str(page_id)):
                        raise ValueError(f"the index leads to another record: {at} {offset}")
                    refers = header.get("x-refers-to-capture-id")
                    digest = header["warc-payload-digest"].removeprefix("sha1:")
                    if refers is None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"the payload of capture {page_id} does not match its digest")
                    out.append((page_id, header["warc-type"], None if refers is None else int(refers), digest, None if refers is not None else len(payload), payload))
                    size += len(payload)
                    if size > 1 << 24:
                        yield _found(out)
                        out, size = [], 0
                if archive is not None:
                    archive.close()
                yield _found(out)
        finally:
            if index is not None:
                index.close()

    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])


def lookup(spark: SparkSession, archive: Archive, wanted: DataFrame) -> DataFrame:
    """The records of ``wanted`` (url, page_id and, to tell captures of one page apart, digest as hexadecimal SHA-1): page_id, record_type, refers_to, payload_digest, payload_bytes, payload.

    A revisit has no payload of its own: payload_bytes is null and payload empty. Lookups that hit nothing are left out.
    """
    shards = [r.asDict() for r in spark.read.parquet(archive.shards).collect()]  # SHARDS_MOST rows at most
    shards.sort(key=lambda s: _order(*json.loads(s["first"])))
    digest = F.col("digest") if "digest" in wanted.columns else F.lit(None).cast("string")
    d = wanted.select(url_key(F.col("url")).alias("url_key"), F.col("page_id").cast("long").alias("page_id"), digest.alias("digest")).distinct()
    d = d.repartitionByRange(max(len(shards), 1), *KEY).sortWithinPartitions(*KEY)
    return d.mapInArrow(_looked_up(archive.folder, shards), FOUND)


def round_trip(pages: DataFrame) -> DataFrame:
    """Every page archived and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    archive = write(captures(pages), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    wanted = pages.select("url", "page_id", F.sha1(F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))).alias("digest"))
    d = lookup(spark, archive, wanted).drop("payload")
    # A revisit's length is that of its response; responses of one id and payload are alike.
    whole = d.where("record_type = 'response'").groupBy(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    d = d.join(whole, (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return d.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def query(pages: DataFrame) -> DataFrame:
    return round_trip(pages.select("page_id", "url", "html"))
