"""WARC archives: revisit records for repeated payloads, and one globally ordered capture index over all archives.

Archives are real ``.warc.gz`` files (one gzip member a record), written by Spark's text writer and so to any store it
knows: the writer ends each row with a line separator, here the zero byte that ends every member of less than 16 MB
(longer ones get an empty member behind them); the row leaves that byte out. Archives are cut by bytes, so that one fits in
a task's memory when it is read back. They keep the writer's names (part-...txt), as renaming is copying on object stores;
``name_archives`` renames them where that is cheap.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, new_path, save, slices, small_batches

EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
INDEX = "urlkey string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
#: A list of at most this many repeated payloads may be broadcast to the writers; a longer one is shuffled.
BROADCAST_PAYLOADS = 500_000
#: An archive ends with the record that takes it to so many bytes.
ARCHIVE_BYTES = 64 << 20


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, without scheme, ``www.``, port 80/443, fragment; query fields sorted."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or "").lower().removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    tail = "" if port in (None, 80, 443) else f":{port}"
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{tail}){(parts.path or '/').lower()}{query.lower()}"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    if out[-1]:
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += packer.flush()
    return out


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    day = EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {day:%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url.replace('%', '%25').replace(chr(13), '%0D').replace(chr(10), '%0A')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip_member("\r\n".join(head).encode() + block + b"\r\n\r\n", level)


def read_records(raw: bytes):
    """(offset, length, WARC headers, block) of each member that holds a record."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        unpacker = zlib.decompressobj(31)
        parts, pos = [], at
        while not unpacker.eof:
            if pos >= len(raw):
                raise ValueError(f"archive ends within the member at {at}")
            chunk = view[pos : pos + (1 << 16)]
            parts.append(unpacker.decompress(chunk))
            pos += len(chunk)
        size = pos - len(unpacker.unused_data) - at
        data = b"".join(parts)
        if data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            yield at, size, headers, rest[: int(headers["Content-Length"])]
        at += size


def index_entry(offset: int, length: int, headers: dict[str, str], block: bytes, file: str) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b": ", 1)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{file}, {offset}: the payload isn't what its headers say")
    url = headers.get("WARC-Target-URI")
    url = url and url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    number = lambda s: int(s[10:-1]) if len(s) > 11 else None  # noqa: E731  <urn:page:N>
    return (url_key(url), "".join(c for c in headers["WARC-Date"] if c.isdigit()), number(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"], number(headers.get("WARC-Refers-To", "")), file, offset, length)


class LoserTree:
    """k-way merge of sorted runs: inner nodes keep the losers, so the next item costs one path of comparisons."""

    def __init__(self, runs: list, key):
        self.key, self.its = key, [iter(r) for r in runs]
        self.k = max(1, len(self.its))
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k
        for i in range(len(self.its)):
            self._advance(i)
        self.tree = [-1] * self.k
        winners = [*[-1] * self.k, *range(self.k)]
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.tree[0] = winners[1]

    def _advance(self, i: int) -> None:
        self.heads[i] = item = next(self.its[i], None)
        self.keys[i] = None if item is None else self.key(item)

    def _before(self, a: int, b: int) -> bool:
        """An ended run loses; equal keys go by run."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def __iter__(self):
        while self.its:
            winner = self.tree[0]
            if self.keys[winner] is None:
                return
            yield self.heads[winner]
            self._advance(winner)
            node = (winner + self.k) // 2
            while node:
                if self._before(self.tree[node], winner):
                    winner, self.tree[node] = self.tree[node], winner
                node //= 2
            self.tree[0] = winner


def write_archives(pages: DataFrame, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """One record a row of pages (page_id, url, html); returns the folder. See ``captures`` for edge cases."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body"))
    hashed = rows.where(F.octet_length("body") >= min_revisit_bytes).select("page_id", F.unhex(F.sha1("body")).alias("sha"))
    repeated = save(hashed.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("sha", "first"), "repeated")
    small = repeated.count() <= BROADCAST_PAYLOADS
    other = repeated.withColumnRenamed("sha", "__sha")
    joined = rows.withColumn("sha", F.unhex(F.sha1("body"))).join(F.broadcast(other) if small else other, F.col("sha") == F.col("__sha"), "left")
    refers = F.when((F.octet_length("body") >= min_revisit_bytes) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))

    small_batches(spark)

    def run(batches):
        archive, held = 0, 0
        for batch in batches:
            for part in slices(batch, "body"):
                out, of = [], []
                for p, u, b, r in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    out.append(record(p, u, b, r)[:-1])
                    of.append(archive)
                    held += len(out[-1]) + 1
                    if held >= archive_bytes:
                        archive, held = archive + 1, 0
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(of, pa.int32())], ["value", "archive"])

    path = new_path(spark, "warc")
    records = joined.select("page_id", "url", "body", refers.alias("refers_to")).mapInArrow(run, "value binary, archive int")
    # a task's archives are a folder each, in the order in which they were cut
    records.select(F.col("value").cast("string").alias("value"), "archive").write.partitionBy("archive").option("lineSep", "\0").text(path)
    drop(repeated)
    return path


def name_archives(spark: SparkSession, path: str) -> int:
    """Give the archives below ``path`` names that end in .warc.gz; returns how many. A rename each, by the driver."""
    place = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs, count = place(path).getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for status in fs.globStatus(place(f"{path}/archive=*/part-*.txt")):
        old = status.getPath()
        count += fs.rename(old, place(f"{old.getParent()}/{old.getName()[:-4]}.warc.gz"))
    return count


ORDER = ("urlkey", "timestamp", "page_id")


def _key(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2], row[7], row[8]


def _batch(rows: list[tuple], extra: list | None = None) -> pa.RecordBatch:
    kinds = [pa.int64() if f.endswith("long") else pa.string() for f in INDEX.split(", ")]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in INDEX.split(", ")])


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """Read the archives back; the index entries of each are one locally sorted run."""

    def run(batches):
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = "/".join(file.rsplit("/", 2)[1:])
                rows = sorted((index_entry(*x, name) for x in read_records(raw.as_py())), key=_key)
                for i in range(0, len(rows), 10_000):
                    yield _batch(rows[i : i + 10_000])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, INDEX)


def merge_runs(runs: DataFrame, entries_per_task: int = 100_000) -> DataFrame:
    """Ranges of (URL key, timestamp, page), so that a URL with very many captures is cut by time; in each, the runs that
    reach into it are merged by a loser tree, of which a run that came in pieces is several. Rows come out in global
    order."""

    def run(batches):
        # each archive's entries as ascending pieces, in the order in which they came
        held: list[list[tuple]] = []
        last: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                piece = last.get(row[7])
                if piece is None or _key(piece[-1]) > _key(row):
                    piece = last[row[7]] = []
                    held.append(piece)
                piece.append(row)
        out = []
        for row in LoserTree(held, _key):
            out.append(row)
            if len(out) == 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    spark = runs.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-runs.count() // entries_per_task))
    return runs.repartitionByRange(parts, *ORDER).mapInArrow(run, INDEX)


def captures(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write pages as WARC archives, read them back and merge their indexes: one row a page, in capture order.

    Null html is an empty payload. A null url has the key "-". Pages with a null page_id are records without a number
    (responses if no numbered page has their payload). Rows that repeat a page_id are records of their own; those with
    the payload's smallest page_id are all responses. Other columns are ignored; an empty table gives no rows.
    The capture time is a fixed day plus page_id seconds, as pages have none.
    """
    spark = pages.sparkSession
    runs = save(capture_runs(spark, write_archives(pages, min_revisit_bytes)), "runs")
    return merge_runs(runs)
