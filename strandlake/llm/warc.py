"""WARC captures: write request, response (or revisit) and metadata records, read archives back, and
assemble the records of one capture through their concurrent-to identifiers.

Archives are written by Spark's text sink, with the blank lines that end a record as the line
separator, and read as whole files, which the sink keeps small.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import join_unique
from strandlake.session import cut

CRLF = "\r\n"
RECORD_END = CRLF * 2
#: Payloads shorter than this are always stored in full.
MIN_REVISIT_BYTES = 1000
#: Pages of up to so many bytes share files of up to so many records: none holds more than about 200 MB. Still larger pages have files of their own.
SIZES = ((65_536, 3000), (1_048_576, 180), (None, 3))


def with_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``pages`` with body, payload_bytes, payload_digest and refers_to.

    Null html is an empty payload. Of equal payloads of at least ``min_bytes`` the largest id is
    stored and the others refer to it; rows that repeat that id are all stored.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    full = pages.withColumns({"body": body, "payload_bytes": F.octet_length(body).cast("long"), "payload_digest": F.sha1(body.cast("binary"))})
    first = full.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max(id_col).alias("_stored"), F.count("*").alias("_held"))
    # a payload that comes once refers to nothing
    joined = join_unique(full, cut(first.where("_held > 1")), "payload_digest", F.col(id_col), "_held")
    return joined.withColumn("refers_to", F.when(F.col("_stored") != F.col(id_col), F.col("_stored"))).drop("_stored", "_held")


def record_id(kind: str, page: F.Column) -> F.Column:
    """A stable urn:uuid for a record, from its kind and its page."""
    h = F.md5(F.concat(F.lit(f"{kind}:"), page.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def block(headers: list[tuple[str, F.Column]], body: F.Column) -> F.Column:
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)) for name, value in headers]
    # a missing header value leaves the whole line out
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2), body)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", sizes: tuple = SIZES) -> None:
    """Three records a page, each a row of the text sink; pages of one class of ``sizes`` share files.

    ``pages`` comes from ``with_revisits``. A revisit has its HTTP headers and no body. Rows with a
    null id are not written: nothing could name their records.
    """
    page = F.col(id_col)
    url = F.coalesce(F.regexp_replace(F.col(url_col), r"[\r\n]", " "), F.lit(""))
    date = F.lit("2024-01-01T00:00:00Z")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    request = block(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", record_id("request", page)), ("WARC-Concurrent-To", record_id("response", page)), ("WARC-Target-URI", url), ("WARC-Date", date), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{CRLF}X-Page: "), page.cast("string"), F.lit(CRLF * 2)),
    )
    response = block(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", record_id("response", page)),
            ("WARC-Target-URI", url),
            ("WARC-Date", date),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(revisit, record_id("response", F.col("refers_to")))),
            ("X-Refers-To-Page", F.col("refers_to")),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(http, F.when(revisit, "").otherwise(F.col("body"))),
    )
    metadata = block(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", record_id("metadata", page)), ("WARC-Concurrent-To", record_id("response", page)), ("WARC-Target-URI", url), ("WARC-Date", date), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page: "), page.cast("string"), F.lit(CRLF)),
    )
    size, over = F.col("payload_bytes"), -1
    most = pages.agg(F.max(size)).first()[0] or 0
    for k, (upto, rows_per_file) in enumerate(sizes):
        if k == 0 or most > over:
            own = pages.where(page.isNotNull() & (size > over) & (F.lit(True) if upto is None else size <= upto))
            rows = own.select(F.explode(F.array(request, response, metadata)).alias("value"))
            rows.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", rows_per_file).option("compression", "gzip").text(f"{folder}/size-{k}")
        over = upto


def records(body: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive, plain or gzip with any number of members; a broken tail raises."""
    if body[:2] == b"\x1f\x8b":
        parts = []
        while body:
            unzip = zlib.decompressobj(31)
            parts.append(unzip.decompress(body))
            body = unzip.unused_data
        body = b"".join(parts)
    at = 0
    while at < len(body):
        end = body.index(b"\r\n\r\n", at)
        lines = body[at:end].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, n = end + 4, int(headers["content-length"])
        if start + n > len(body):
            raise ValueError(f"record at byte {at} is cut short")
        yield headers, body[start : start + n]
        at = start + n
        while body[at : at + 2] == b"\r\n":
            at += 2


RECORD_FIELDS = ("record_id string, record_type string, concurrent_to string, refers_to_page long, target_uri string, page_id long, payload_bytes long, payload_digest string, digest_header string, http_length long")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record, with the size and digest of the payload as stored and its page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split(" ")[0] for f in RECORD_FIELDS.split(",")]
        kinds = [pa.int64() if f.endswith("long") else pa.string() for f in RECORD_FIELDS.split(",")]
        for batch in batches:
            for content in batch.column("content"):
                out: list[list] = [[] for _ in names]
                for head, body in records(content.as_py()):
                    http, _, payload = body.partition(b"\r\n\r\n") if head["warc-type"] in ("response", "revisit") else (b"", b"", body)
                    length = http.partition(b"Content-Length: ")[2].partition(b"\r\n")[0]
                    found = body.partition(b"X-Page: ")[2].partition(b"\r\n")[0] if head["warc-type"] == "request" else body.partition(b"page: ")[2].partition(b"\r\n")[0] if head["warc-type"] == "metadata" else b""
                    row = (head["warc-record-id"], head["warc-type"], head.get("warc-concurrent-to"), int(x) if (x := head.get("x-refers-to-page")) else None, head.get("warc-target-uri"), int(found) if found else None, len(payload), hashlib.sha1(payload).hexdigest(), head.get("warc-payload-digest"), int(length) if length else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(folder).select("content")
    return files.mapInArrow(run, RECORD_FIELDS)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row a capture: its response or revisit with the request and metadata that name it.

    Records group by the identifier of their capture: a response's own, or the one it is concurrent
    to. A capture without request or metadata has nulls there; records that name an absent response
    give no row. Repeated records of one kind count once.
    """
    is_capture = F.col("record_type").isin("response", "revisit")
    whole = F.struct("record_type", "record_id", "target_uri", "payload_bytes", "payload_digest", "digest_header", "http_length", "refers_to_page")
    side = F.struct("record_id", "page_id")
    captures = found.where(is_capture).select(F.col("record_id").alias("capture_id"), whole.alias("response"))
    beside = found.where(~is_capture).groupBy(F.col("concurrent_to").alias("capture_id")).agg(
        F.max(F.when(F.col("record_type") == "request", side)).alias("request"), F.max(F.when(F.col("record_type") == "metadata", side)).alias("metadata")
    )
    return captures.join(beside, "capture_id", "left")


def archive_folder(root: str) -> str:
    return f"{root.rstrip('/')}/warc-{uuid.uuid4().hex}"
