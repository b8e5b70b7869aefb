"""WARC archives: one gzip member per record, written by Spark, and a reader that splits files at byte ranges."""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempolog.llm.common import durable, map_batches
from tempolog.session import shared_folder

# Payloads below this size are always stored in full.
LEAST_BYTES = 100
# Bytes of a file that one task scans, and that it reads at once.
# Tasks that read the ranges; beyond it a task reads several.
MOST_TASKS = 50_000
RANGE_BYTES = 32 << 20
READ_BYTES = 1 << 20
_MAGIC = b"\x1f\x8b\x08"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    """A WARC record as one gzip member; fields without a value are left out."""
    lines = ["WARC/1.1", *(f"{k}: {re.sub(r'[\x00-\x1f\x7f]', ' ', v)}" for k, v in fields.items() if v is not None),
             f"Content-Length: {len(block)}", "", ""]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + squeeze.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Fields and block of a decompressed record; None if it is none."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode(errors="replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = fields.get("content-length", "")
    if not size.isdigit() or rest[int(size):] != b"\r\n\r\n":
        return None
    return fields, rest[:int(size)]


def plan_records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``(page_id, url, payload, digest, owner)``: ``owner`` is the page whose record a revisit refers to, else null.

    Of pages with equal payloads of at least ``least`` bytes the smallest page_id owns the payload. Digests are
    aggregated before they are shuffled; only digests of several pages are looked up.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull())
    owners = large.groupBy("digest").agg(F.min("page_id").alias("least_page"), F.count("*").alias("n")).where("n > 1").drop("n")
    owner = F.when(F.col("page_id") > F.col("least_page"), F.col("least_page"))
    return rows.join(owners, "digest", "left").select("page_id", "url", "payload", "digest", owner.alias("owner"))


def write_warc(pages: DataFrame, path: str, least: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to WARC files in a new folder.

    Spark's text writer commits the files, so lost tasks leave no partial ones. Each row is one gzip member. A member
    ends with its length in four bytes, of which the last is zero below 16 MiB; that byte is left to the writer, whose line
    separator is a zero byte. Behind larger members the separator is padding, which readers of members skip.
    """

    def start():
        def member(page_id, url, payload, digest, owner) -> bytes:
            own = f"<urn:page:{'' if page_id is None else page_id}>"
            fields = {"WARC-Type": "response" if owner is None else "revisit", "WARC-Record-ID": own, "WARC-Date": date,
                      "WARC-Target-URI": url, "Content-Type": "application/http;msgtype=response",
                      "WARC-Payload-Digest": f"sha256:{digest}"}
            if owner is not None:
                fields |= {"WARC-Refers-To": f"<urn:page:{owner}>", "WARC-Profile": _PROFILE}
            data = record(fields, _HTTP + payload if owner is None else _HTTP)
            return data[:-1] if data[-1] == 0 else data

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "owner")))
            return pa.RecordBatch.from_arrays([pa.array([member(*r) for r in rows], pa.binary())], names=["value"])

        return work

    members = map_batches(plan_records(pages, least), start, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


class _Window:
    """A file read forward in pieces, with the bytes from some place on at hand."""

    def __init__(self, file, start: int, size: int):
        self.file, self.at, self.size, self.data = file, start, size, b""

    def more(self) -> bool:
        have = self.at + len(self.data)
        if have >= self.size:
            return False
        self.file.seek(have)
        self.data += self.file.read(min(READ_BYTES, self.size - have))
        return True

    def skip(self, n: int) -> None:
        self.data = self.data[n:]
        self.at += n


def members(file, start: int, end: int, size: int):
    """The decompressed gzip members of a file that hold a WARC record and start within ``[start, end)``.

    Every place with gzip's magic bytes is a candidate. It is valid if the data decompress to a WARC header; then the
    whole member is read, beyond ``end`` if need be, checked by its own checksum and by the record's length, and the search goes on
    behind it. Otherwise the search goes on at the next byte.
    """
    window = _Window(file, start, size)
    while window.at < end:
        place = window.data.find(_MAGIC)
        if place < 0:
            window.skip(max(0, len(window.data) - len(_MAGIC) + 1))
            if not window.more():
                return
            continue
        window.skip(place)
        if window.at >= end:
            return
        inflate, parts, used, good = zlib.decompressobj(31), [], 0, True
        while good and not inflate.eof:
            if used == len(window.data) and not window.more():
                good = False
                break
            try:
                parts.append(inflate.decompress(window.data[used:]))
            except zlib.error:
                good = False
                break
            used = len(window.data) - len(inflate.unused_data)
            if len(parts) == 1 and not b"WARC/1.".startswith(parts[0][:7]) and not parts[0].startswith(b"WARC/1."):
                good = False
        found = parse(b"".join(parts)) if good else None
        if found is not None:
            yield found
        window.skip(used if found is not None else 1)


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(record_id, type, url, digest, refers_to, payload)`` of every record in the files of a folder.

    Files are cut into ranges of ``range_bytes``; a task scans its range and owns the records that start in it.
    The payload is the HTTP body, null for a revisit. Files are opened through Arrow's file systems, so the folder may
    be on any of them; a range is read in pieces of a megabyte.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).where("size > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.select("path", "size", starts.alias("start"))
    # A counted number of tasks: the rows are few bytes, so adaptive execution would put all ranges into one.
    ranges = ranges.repartition(max(1, min(MOST_TASKS, ranges.count())), "path", "start")
    names = ["record_id", "type", "url", "digest", "refers_to", "payload"]

    def start_task():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for where, size, first in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start"))):
                store, inner = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", where))
                with store.open_input_file(inner) as file:
                    for fields, block in members(file, first, first + range_bytes, size):
                        kind = fields.get("warc-type")
                        body = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
                        out.append((fields.get("warc-record-id"), kind, fields.get("warc-target-uri"),
                                    fields.get("warc-payload-digest", "").removeprefix("sha256:"), fields.get("warc-refers-to"),
                                    None if kind == "revisit" else body))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.string()] * 5 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=names)

        return work

    return map_batches(ranges, start_task, "record_id string, type string, url string, digest string, refers_to string, payload binary")


def archive_report(pages: DataFrame, least: int = LEAST_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder, read it back, and return what the records say.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``, one row per page. Sizes and digests of responses are
    taken from the payloads read; a revisit names its digest and the response that has the payload. A null html is an empty payload. Rows
    without page_id are responses; repeated page_ids do not revisit each other. Further columns are ignored.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, least)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1) as long)")
    read = read_warc(spark, path, range_bytes).select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.col("digest")).alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))
    records = durable(read)
    responses = records.where("record_type = 'response'")
    owned = responses.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    revisits = records.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_to")
    resolved = revisits.join(owned, ["refers_to", "payload_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*columns).unionAll(resolved.select(*columns))
