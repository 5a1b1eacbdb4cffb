"""WARC archives with a two-level capture index, written and read by Spark.

Records are written as text rows with CRLF CRLF between them, which is the WARC
format; files are bounded in bytes. The capture index sorts lines by
reversed-host key into zlib-compressed blocks of fixed length, one after the
other in block files; a sparse directory has the first and last key of each
block and its range in its file. A lookup binary-searches the directory, reads
the range of a block, searches that, and reads the range of the record.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import shared_dir

#: Smallest payload that is revisited; lines of an index block; blocks of a file; bytes of a map that is broadcast.
LEAST, BLOCK_LINES, FILE_BLOCKS, BROADCAST_BYTES = 100, 1024, 256, 8 << 20
#: Most bytes of payloads in an archive file (a larger record has a file of its own), and the size classes of records it holds for.
FILE_BYTES, CLASSES = 64 << 20, (16 << 10, 512 << 10, 8 << 20)
#: Lines of a directory that is searched in memory; a longer one is searched by its sorted row groups.
DIRECTORY_LINES = 1_000_000

_END = "\r\n\r\n"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string, file string, offset long, length long"


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", page_id.cast("string"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def write_archive(pages: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z") -> None:
    """Writes a response or revisit record for each row of ``pages`` (page_id, url, html).

    Of rows with equal payloads of at least 100 bytes the smallest page_id is the
    response; the others (other page_ids) revisit it. A null html is an empty
    payload, a null url an empty target; a row with a null page_id is a response.
    Records of like size share a file, so that no file exceeds ``FILE_BYTES`` of
    payloads unless one record does.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20]", "%20").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    thin = p.where((F.col("n") >= LEAST) & F.col("page_id").isNotNull()).select("page_id", "n", "digest")
    firsts = thin.groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    size = firsts.count() * 100
    p = p.join(F.broadcast(firsts) if size <= BROADCAST_BYTES else firsts, "digest", "left")
    revisit = F.coalesce((F.col("n") >= LEAST) & (F.col("page_id") > F.col("first")), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(_END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest"))),
        F.concat(F.lit("WARC-Date: "), F.lit(date)),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("Page-ID: "), F.col("page_id").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _record_id(F.col("first"), F.col("digest")), F.lit("\r\nRefers-To-Page-ID: "), F.col("first").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *head), F.lit(_END), block)
    kind = F.lit(0)
    for most in CLASSES:
        kind = kind + (F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit(""))) > most).cast("int")
    for k in sorted(r[0] for r in pages.select(kind.alias("kind")).distinct().collect()) or [0]:
        records = max(1, FILE_BYTES // CLASSES[k]) if k < len(CLASSES) else 1
        low, high = CLASSES[k - 1] if k else -1, CLASSES[k] if k < len(CLASSES) else 1 << 62
        p.where((F.col("n") > low) & (F.col("n") <= high)).select(record.alias("value")).write.mode("append").option("lineSep", _END).option("maxRecordsPerFile", records).text(path)


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def parse(content: bytes, at: int = 0):
    """Records of an archive from byte ``at`` on: fields, payload, offset and length."""
    end = len(content)
    while at < end:
        cut = content.index(b"\r\n\r\n", at)
        fields = _fields(content[at:cut])
        stop = cut + 4 + int(fields["content-length"])
        block = content[cut + 4 : stop]
        http, _, payload = block.partition(b"\r\n\r\n")
        yield fields, _fields(http), payload, at, stop - at
        at = stop + 4


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record: its page, type, the full payload's size and digest, the payload (responses), and where it lies.

    Size and digest of a response are taken from the bytes read; those of a
    revisit, which has no payload, from its headers.
    """

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for f, http, payload, offset, length in parse(content.as_py()):
                    full = f["warc-type"] == "response"
                    page, refers = f.get("page-id"), f.get("refers-to-page-id")
                    rows.append({
                        "page_id": None if page is None else int(page), "url": f["warc-target-uri"], "record_type": f["warc-type"], "refers_to": None if refers is None else int(refers),
                        "payload_bytes": len(payload) if full else int(http["content-length"]), "payload_digest": hashlib.sha256(payload).hexdigest() if full else f["warc-payload-digest"].removeprefix("sha256:"),
                        "payload": payload.decode() if full and payloads else None, "file": file, "offset": offset, "length": length,
                    })
                if rows:
                    yield from pa.Table.from_pylist(rows, schema=_ARROW).to_batches()

    return _files(spark, path).mapInArrow(run, _RECORD)


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then the path; lower-case, without scheme, port and fragment."""
    try:
        u = urlsplit(url or "")
        host = ",".join(reversed((u.hostname or "").split(".")))
    except ValueError:
        return f"){url}".lower()
    return f"{host}){u.path or '/'}{'?' + u.query if u.query else ''}".lower()


_LINE = ("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "file", "offset", "length")


def write_index(records: DataFrame, path: str, partitions: int | None = None) -> None:
    """Sorts captures by URL key and writes block files and their directory below ``path``.

    A block file is a text file with a line for each block (first key, last
    key, number of captures, compressed lines). ``partitions``: number of block
    files, as many as shuffle partitions if it is not given.
    """

    def keyed(batches):
        for batch in batches:
            lines = [json.dumps([r[c] for c in _LINE]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string()), batch.column("page_id"), pa.array(lines, pa.string())], names=["key", "page_id", "line"])

    lines = records.select("url", *_LINE).mapInArrow(keyed, "key string, page_id long, line string")
    order = ["key", "page_id", "line"]  # captures of one URL may span partitions
    spread = lines.repartitionByRange(partitions, *order) if partitions else lines.repartitionByRange(*order)

    def blocks(batches):
        held: list[tuple[str, str]] = []

        def block(part):
            blob = zlib.compress("\n".join(f"{k}\t{v}" for k, v in part).encode())
            line = json.dumps([part[0][0], part[-1][0], len(part)]) + "\t" + base64.b64encode(blob).decode()
            return pa.RecordBatch.from_arrays([pa.array([line])], names=["value"])

        for batch in batches:
            held += zip(batch.column("key").to_pylist(), batch.column("line").to_pylist(), strict=True)
            while len(held) >= BLOCK_LINES:
                yield block(held[:BLOCK_LINES])
                held = held[BLOCK_LINES:]
        if held:
            yield block(held)

    spread.sortWithinPartitions(*order).mapInArrow(blocks, "value string").write.text(f"{path}/blocks")

    def ranges(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                at, rows = 0, []
                for line in content.as_py().splitlines(keepends=True):
                    head, _, blob = line.partition(b"\t")
                    first, last, captures = json.loads(head)
                    rows.append({"first_key": first, "last_key": last, "captures": captures, "file": file, "offset": at + len(head) + 1, "length": len(blob.rstrip(b"\n"))})
                    at += len(line)
                yield from pa.Table.from_pylist(rows, schema=_DIRECTORY).to_batches()

    spark = records.sparkSession
    found = _files(spark, f"{path}/blocks").mapInArrow(ranges, "first_key string, last_key string, captures int, file string, offset long, length long")
    found.sort("first_key", "last_key", "file", "offset").write.parquet(f"{path}/directory")


_DIRECTORY = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("captures", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files that Spark wrote; each is bounded in bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _unpacked(blob: bytes) -> list[str]:
    return zlib.decompress(base64.b64decode(blob)).decode().split("\n")


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    """All captures of an index, from the blocks that its directory names."""

    def run(batches):
        for batch in batches:
            for blocks, content in zip(batch.column("blocks").to_pylist(), batch.column("content"), strict=True):
                content = content.as_py()
                for b in blocks:
                    rows = [dict(zip(_LINE, json.loads(line.split("\t", 1)[1]), strict=True)) | {"key": line.split("\t", 1)[0]} for line in _unpacked(content[b["offset"] : b["offset"] + b["length"]])]
                    yield from pa.Table.from_pylist(rows, schema=pa.schema([_ARROW.field(c) for c in _LINE] + [pa.field("key", pa.string())])).to_batches()

    blocks = spark.read.parquet(f"{path}/directory").groupBy(F.col("file").alias("path")).agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("blocks"))
    found = _files(spark, f"{path}/blocks").join(F.broadcast(blocks) if _short(spark, path) else blocks, "path")
    return found.select("blocks", "content").mapInArrow(run, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long, key string")


def _short(spark: SparkSession, path: str) -> bool:
    return spark.read.parquet(f"{path}/directory").count() <= DIRECTORY_LINES // 10


def read_bytes(spark: SparkSession, file: str, offset: int, length: int) -> bytes:
    """A range of a file of any store that Spark can read; nothing else of it is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(offset)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


class CaptureIndex:
    """An index opened for lookups: the directory in memory where it is short, else searched by its sorted row groups."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.directory = spark, spark.read.parquet(f"{path}/directory")
        self.blocks = None
        if self.directory.count() <= DIRECTORY_LINES:
            self.blocks = sorted(self.directory.select("first_key", "last_key", "file", "offset", "length").collect())
            self.last_keys = sorted(b.last_key for b in self.blocks)  # as ordered as the first keys: blocks don't overlap

    def _enclosing(self, key: str):
        if self.blocks is None:
            near = self.directory.where((F.col("first_key") <= key) & (F.col("last_key") >= key))
            yield from near.select("first_key", "last_key", "file", "offset", "length").toLocalIterator()
            return
        at = bisect.bisect_left(self.last_keys, key)
        while at < len(self.blocks) and self.blocks[at].first_key <= key:
            yield self.blocks[at]
            at += 1

    def captures(self, url: str) -> list[dict]:
        """Captures of one URL."""
        key, out = url_key(url), []
        for b in self._enclosing(key):
            lines = _unpacked(read_bytes(self.spark, b.file, b.offset, b.length))
            at = bisect.bisect_left(lines, f"{key}\t", key=lambda x: x.split("\t", 1)[0] + "\t")
            while at < len(lines) and lines[at].startswith(f"{key}\t"):
                out.append(dict(zip(_LINE, json.loads(lines[at].split("\t", 1)[1]), strict=True)))
                at += 1
        return sorted(out, key=lambda r: (r["page_id"] is None, r["page_id"], r["file"], r["offset"]))


def lookup(spark: SparkSession, path: str, url: str) -> list[dict]:
    """Captures of one URL: directory, then the blocks whose keys enclose the URL's, each read as a range."""
    return CaptureIndex(spark, path).captures(url)


def read_range(spark: SparkSession, file: str, offset: int, length: int) -> tuple[dict, bytes]:
    """Fields and payload of the record at a range of an archive file."""
    fields, _, payload, *_ = next(parse(read_bytes(spark, file, offset, length)))
    return fields, payload


def archive(pages: DataFrame) -> DataFrame:
    """Writes archives and index of ``pages`` to the shared folder, and returns the captures read back.

    One row for each row of ``pages``: page_id, record_type, refers_to, payload_bytes,
    payload_digest, file, offset, length and key. Extra columns are left out;
    repeated rows give repeated captures; an empty table gives no rows.
    """
    spark = pages.sparkSession
    base = shared_dir(spark)
    write_archive(pages, f"{base}/warc")
    files = -(-pages.count() // (BLOCK_LINES * FILE_BLOCKS))
    write_index(read_archive(spark, f"{base}/warc", payloads=False), f"{base}/index", max(files, 1))
    return index_lines(spark, f"{base}/index")
