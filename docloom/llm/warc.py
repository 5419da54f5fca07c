"""WARC archives: written by Spark's own file writer, indexed first, read back by coalesced byte ranges.

Writing: a record is one text value and the blank lines that end it are the writer's separator, so part files are valid
WARC files, committed like any Spark output. Pages with equal payloads are found by digest; the one with the largest
id is a response, the others are revisits that name its record. Only digests that repeat are joined to the pages, and
Spark broadcasts that table if its size allows.

Reading: one pass writes the index (file, offset, length, URL, digest, type). Whatever records are selected from it,
their ranges are sorted in each file, neighbours are joined into one read of bounded size, and each read becomes rows;
payloads are held against their digests. Files are opened through the file system that their path names.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm._bloom import may_be_in
from docloom.llm._shared import fresh_path, remove, ship_package, staged

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "file string, offset long, length long, url string, digest string, record_type string, record_id string, refers_to_record string, page_id long, payload_bytes long"
RECORDS = "record_id string, page_id long, payload binary"
NAMES = [c.split()[0] for c in INDEX.split(", ")]
#: Of one byte-range read, and the bytes between two records that are read along rather than skipped.
READ_BYTES, GAP_BYTES = 4 << 20, 64 << 10
CHUNK = 1 << 20


def base32_sha1(text: F.Column) -> F.Column:
    """Bare upper-case base32 SHA-1 of a string's UTF-8: five hexadecimal digits are four digits of base 32."""
    h = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: F.Column, digest: F.Column) -> F.Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def write_warc(pages: DataFrame, path: str, min_payload: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 20_000) -> None:
    """Of (page_id, url, html): null html is an empty payload; a null url has no WARC-Target-URI; line ends, blanks and
    control characters in a url are dropped. Payloads shorter than ``min_payload`` are never revisits. Rows that repeat
    page_id and payload are the same record written again; pages are written whole, however long. Other columns aren't
    looked at; an empty table gives no record."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("digest", base32_sha1(F.col("html")))
    groups = keyed.where(F.octet_length("html") >= min_payload).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated, repeated_path = staged(groups.where("n > 1").select("digest", "first_id"), "repeated-payloads")
    hashed = F.xxhash64("digest")
    marked = keyed.withColumn("maybe", may_be_in(repeated.select(hashed))(hashed))
    joined = marked.where("maybe").join(repeated.withColumn("many", F.lit(True)), "digest", "left")
    alone = marked.where("not maybe").withColumns({"first_id": F.lit(None).cast("long"), "many": F.lit(None).cast("boolean")})
    rows = alone.unionByName(joined)  # pages whose payload doesn't repeat aren't shuffled
    revisit = F.col("many").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.octet_length("html") >= min_payload)
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))), F.lit(f"WARC-Date: {date}\r\n"),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "")), line("X-Page-Id", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.when(revisit, record_id(F.col("first_id"), F.col("digest")))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )
    rows.select(head.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)
    remove(pages.sparkSession, repeated_path)


def _open(path: str):
    """A random-access file by its Hadoop-style path; s3a is what Hadoop calls s3."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    system, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if "://" in path or path.startswith("file:") else "file://" + path)
    return system.open_input_file(at)


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:60]!r}")
    return {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if x)}


def index_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headers of the files named in the input; blocks are skipped, not read, where they leave the chunk at hand."""
    for b in batches:
        for path in b.column(0).to_pylist():
            rows: list[tuple] = []
            with _open(path) as f:
                at, size, base, chunk = 0, f.size(), 0, b""
                while at < size:
                    while (end := chunk.find(b"\r\n\r\n", at - base) if base <= at < base + len(chunk) else -1) < 0:
                        want = CHUNK if not base <= at < base + len(chunk) or at > base else 2 * len(chunk)
                        f.seek(at)
                        base, chunk = at, f.read(want)
                        if len(chunk) < want and chunk.find(b"\r\n\r\n") < 0:
                            raise ValueError(f"{path}: a header doesn't end")
                    h = parse_head(chunk[at - base : end])
                    length = end + base + 4 - at + int(h["content-length"])
                    payload = int(h["content-length"]) - len(HTTP) if h["warc-type"] == "response" else None
                    page = h.get("x-page-id")
                    rows.append((path, at, length, h.get("warc-target-uri"), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), None if page is None else int(page), payload))
                    at += length + 4
                    if len(rows) >= 5000:
                        yield _index_batch(rows)
                        rows = []
            if rows:
                yield _index_batch(rows)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=NAMES)


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of all archives under ``path``, written to the shared folder. Files are dealt to tasks one by one."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0").select("path")
    spread = files.repartition(max(1, min(files.count(), 4096)))
    return staged(spread.mapInArrow(index_files, INDEX), "warc-index")[0]


def coalesced_ranges(selected: DataFrame, read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """file, start, stop and the (offset, length, ...) of the records in it, for reads in file order.

    A read ends where the next record is over ``gap_bytes`` away or a multiple of ``read_bytes`` lies between."""
    ends = selected.withColumn("stop", F.col("offset") + F.col("length")).withColumn("piece", F.floor(F.col("offset") / read_bytes))
    far = F.expr(f"coalesce(offset - lag(stop) over (partition by file, piece order by offset) > {gap_bytes}, true)")
    runs = ends.withColumn("opens", far.cast("int")).withColumn("run", F.expr("sum(opens) over (partition by file, piece order by offset)"))
    record = F.struct("offset", "length", "digest", "record_id", "page_id")
    return runs.groupBy("file", "piece", "run").agg(F.min("offset").alias("start"), F.max("stop").alias("end"), F.sort_array(F.collect_list(record)).alias("records"))


def read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The payloads of the records in each range, each held against its digest."""
    for b in batches:
        for r in b.to_pylist():
            with _open(r["file"]) as f:
                f.seek(r["start"])
                data = f.read(r["end"] - r["start"])
            out = []
            for x in r["records"]:
                record = data[x["offset"] - r["start"] :][: x["length"]]
                payload = record.split(b"\r\n\r\n", 1)[1][len(HTTP) :]
                if b32encode(hashlib.sha1(payload).digest()).decode() != x["digest"]:
                    raise ValueError(f"{r['file']} at {x['offset']}: the payload doesn't have its digest")
                out.append((x["record_id"], x["page_id"], payload))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["record_id", "page_id", "payload"])


def read_payloads(selected: DataFrame) -> DataFrame:
    """record_id, page_id, payload of the selected index rows of type response."""
    ship_package(selected.sparkSession)
    return coalesced_ranges(selected.where("record_type = 'response'")).select("file", "start", "end", "records").mapInArrow(read_ranges, RECORDS)


def archive_report(pages: DataFrame, path: str | None = None, min_payload: int = 0) -> DataFrame:
    """Writes ``pages`` as WARC, reads it back, and gives page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; of equal payloads the largest page_id is the response (null is the smallest), and rows
    that repeat page_id and payload are all responses if one is; an empty table gives no row."""
    path = path or fresh_path(pages.sparkSession, "warc")
    write_warc(pages, path, min_payload)
    index = build_index(pages.sparkSession, path)
    payloads = read_payloads(index)
    read = payloads.select("record_id", "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    read, _ = staged(read, "warc-read")
    responses = read.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    target = read.dropDuplicates(["record_id"]).select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    revisits = index.where("record_type = 'revisit'").select("page_id", "refers_to_record").join(target, "refers_to_record").select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return responses.unionByName(revisits)
