"""WARC archives of captures: written as transactions, read back and joined by concurrent-to identifiers.

A capture is written as three records: the request, the response (or a revisit
of the response with the smallest id and the same payload) and metadata. The
request and the metadata name the response in WARC-Concurrent-To.

Spark's text writer makes the archives: a record is a line that ends with two
line breaks, as the format has it, and gzip makes each file one unit of work.
The files are named .txt.gz. A store that Spark can write is enough; nothing
is written past it. The reader streams a file's bytes record by record, led by
Content-Length alone, so payloads may hold anything, line breaks and records
included, and a task holds one record at a time. Gzip files of other writers,
a member for each record or not, are read as well; plain files are refused, for
a task could start inside a record.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.llm.texts import map_arrow
from plumbline.session import shared_path, written

CRLF = "\r\n"
END = b"\r\n\r\n"
# The alphabet of base32, and the profile of a revisit by payload digest.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PRIMARY = ("response", "revisit", "resource")
LEAVES = 64
RECORD = (
    "file string, record_id string, record_type string, concurrent_to array<string>, target_uri string, date string, refers_to string, "
    "payload_digest string, digest_ok boolean, http_status int, payload_bytes long, content_type string, block binary"
)


def base32_of(hex40: Column) -> Column:
    """Base32 of 40 hexadecimal digits; five of them give four letters."""
    groups = [F.conv(F.substring(hex40, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    letters = F.split(F.lit(" ".join(BASE32)), " ")
    return F.concat(*(F.get(letters, F.shiftright(n, 15 - 5 * k).bitwiseAND(F.lit(31))) for n in groups for k in range(4)))


def _uuid(digest: Column) -> Column:
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """The text of a record up to its closing line breaks; headers that are null are left out."""
    line = lambda n, v: F.concat(F.lit(f"{n}: "), v if isinstance(v, Column) else F.lit(v))
    lines = F.concat_ws(CRLF, F.lit("WARC/1.1"), *(line(n, v) for n, v in headers), line("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(lines, F.lit(2 * CRLF), block)


def roles(captures: DataFrame, id_col: str, payload_col: str, least: int = 0) -> DataFrame:
    """captures with __sha (SHA-256), __bytes, __first (id of the response) and __alone (no other row has that id and payload).

    Of equal payloads of at least `least` bytes the smallest id is the response; smaller payloads have
    none but their own id. Decisions reach the rows by (leaf, digest), so that a payload that many rows
    hold is spread; the payloads themselves move once.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = captures.withColumn("__sha", F.sha2(payload, 256)).withColumn("__bytes", F.octet_length(payload).cast("long"))
    rows = rows.withColumn("__leaf", F.pmod(F.xxhash64(F.col(id_col)), F.lit(LEAVES)).cast("int"))
    keyed = captures.select(F.col(id_col).cast("long").alias("id"), F.sha2(payload, 256).alias("__sha"), F.octet_length(payload).alias("n"))
    by_id = keyed.where(F.col("n") >= least).groupBy("__sha", "id").agg(F.count("*").alias("n"))
    first = by_id.groupBy("__sha").agg(F.min("id").alias("__first"), F.min_by("n", "id").alias("__n"))
    leaves = rows.select("__leaf", "__sha").distinct().join(first, "__sha", "left")
    return rows.join(leaves, ["__leaf", "__sha"]).withColumn("__alone", F.coalesce(F.col("__n") == 1, F.lit(False))).drop("__n", "__leaf")


def transactions(captures: DataFrame, id_col: str, url_col: str, payload_col: str, date: str, least: int = 0) -> DataFrame:
    """(record): the three records of each capture, next to each other."""
    rows = roles(captures, id_col, payload_col, least)
    number = F.col(id_col).cast("long")
    revisit = (F.col("__bytes") >= least) & ~number.eqNullSafe(F.col("__first"))
    # The response's identifier follows from id and payload, so that revisits can name it; where rows repeat
    # it, and for revisits, it is drawn.
    named = F.sha2(F.concat_ws("/", F.lit("response"), F.col("__first").cast("string"), F.col("__sha")), 256)
    drawn = F.sha2(F.uuid(), 256)
    rows = rows.withColumn("__key", F.when(~revisit & F.col("__alone") & number.isNotNull(), named).otherwise(drawn))
    rows = rows.withColumn("__revisit", revisit)
    url = F.coalesce(F.col(url_col).cast("string"), F.lit("about:blank"))
    url = F.replace(F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    sha1 = F.concat(F.lit("sha1:"), base32_of(F.sha1(payload)))
    own = _uuid(F.col("__key"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("__bytes").cast("string"), F.lit(2 * CRLF))
    common = [("WARC-Target-URI", url), ("WARC-Date", date)]
    is_html = ("Content-Type", "application/http; msgtype=response")
    response = _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", sha1), is_html], F.concat(http, payload))
    refers = F.when(F.col("__alone"), _uuid(named))
    revisited = _record(
        [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", sha1), ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers), is_html], http
    )
    side = lambda kind: _uuid(F.sha2(F.concat_ws("/", F.lit(kind), F.col("__key")), 256))
    asked = F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{2 * CRLF}"))
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", side("request")), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")], asked)
    facts = F.struct(number.alias("id"), F.when(F.col("__revisit"), F.col("__first")).alias("refers_to"), F.col(url_col).cast("string").alias("url"))
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", side("metadata")), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/json")], F.to_json(facts))
    primary = F.when(F.col("__revisit"), revisited).otherwise(response)
    return rows.select(F.explode(F.array(request, primary, metadata)).alias("record"))


def write_archives(
    captures: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2000-01-01T00:00:00Z", least: int = 0
) -> None:
    """Write captures as gzip archives below `path`, one for each task.

    Equal payloads of at least `least` bytes are stored once: the smallest id
    is the response, every other row a revisit without payload. Null payloads
    are empty. Rows that repeat the smallest id with its payload are all
    responses; null ids revisit an id if there is one and are responses
    otherwise. Null urls become about:blank; line breaks and blanks in a url
    are escaped in headers and whole in the metadata. Other columns are
    ignored. An empty table gives archives without records.
    """
    captures = captures.select(F.col(id_col), F.col(url_col), F.col(payload_col))
    transactions(captures, id_col, url_col, payload_col, date, least).write.option("lineSep", 2 * CRLF).option("compression", "gzip").text(path)


class Stream:
    """The records of one file from its lines, by Content-Length; holds one record."""

    def __init__(self, file: str):
        self.file, self.parts, self.have, self.need = file, [], 0, 0

    def add(self, line: bytes) -> Iterator[tuple[dict, list[str], bytes]]:
        self.parts += (line, END)
        self.have += len(line) + len(END)
        while self.have >= self.need:
            data = b"".join(self.parts).lstrip(b"\r\n") if not self.need else b"".join(self.parts)
            self.parts, self.have = [data], len(data)
            if not data:
                return
            if not self.need:
                head = data.find(END)
                if head < 0:
                    return
                self.head = _headers(data[:head], self.file)
                self.start = head + len(END)
                self.need = self.start + int(self.head[0].get("content-length", "0")) + len(END)
                continue
            block, rest = data[self.start : self.need - len(END)], data[self.need :]
            self.parts, self.have, self.need = [rest], len(rest), 0
            yield *self.head, block
            if not rest:
                return

    def close(self) -> None:
        # The reader adds line breaks to the last line, which may have had fewer of its own.
        if self.need or b"".join(self.parts).strip(b"\r\n"):
            raise ValueError(f"{self.file} ends inside a record")


def _headers(raw: bytes, file: str) -> tuple[dict, list[str]]:
    """({lower-case name: last value}, every WARC-Concurrent-To)."""
    first, *lines = raw.decode("utf-8", "replace").split(CRLF)
    if not first.startswith("WARC/"):
        raise ValueError(f"{file}: a record starts with {first[:40]!r}")
    found, together = {}, []
    for line in lines:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
        if name.strip().lower() == "warc-concurrent-to":
            together.append(value.strip())
    return found, together


def _fields(file: str, head: dict, together: list[str], block: bytes, keep: bool) -> tuple:
    kind = head.get("warc-type")
    status, n_bytes, body = None, len(block), block
    if head.get("content-type", "").startswith("application/http"):
        top, _, body = block.partition(END)
        lines = top.decode("utf-8", "replace").split(CRLF)
        n_bytes = len(body)
        if kind != "request":
            words = lines[0].split(" ")
            status = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
        if kind == "revisit":  # the payload is elsewhere; its length is in the stored header
            lengths = [x.partition(":")[2].strip() for x in lines if x.lower().startswith("content-length:")]
            n_bytes = int(lengths[-1]) if lengths and lengths[-1].isdigit() else None
    stated, ok = head.get("warc-payload-digest"), None
    if kind in PRIMARY:
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if kind != "revisit":
            ok = stated is None or stated == f"sha1:{digest}"
            stated = f"sha1:{digest}"
    return (
        file, head.get("warc-record-id"), kind, together, head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-refers-to"),
        stated, ok, status, n_bytes, head.get("content-type"), body if keep or kind == "metadata" else None,
    )


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the gzip archives below `path`: RECORD.

    payload_bytes and payload_digest are of the HTTP body; a revisit has those
    of the payload that it names. digest_ok tells whether a response's stated
    digest is that of its bytes. Without `payloads` only metadata keep their
    block. A file that ends inside a record stops the job and is named.
    """
    lines = spark.read.option("lineSep", 2 * CRLF).text(path)
    lines = lines.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    target = to_arrow_schema(StructType.fromDDL(RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        stream: Stream | None = None
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        for batch in batches:
            for k in range(batch.num_rows):
                line, file, start = (batch.column(c)[k].as_py() for c in range(3))
                if start:
                    raise ValueError(f"{file} is read in parts; archives must be gzip files")
                if stream is None or stream.file != file:
                    if stream is not None:
                        stream.close()
                    stream = Stream(file)
                for head, together, block in stream.add(line):
                    rows.append(_fields(file, head, together, block, payloads))
                    size += len(rows[-1][-1] or b"")
                if len(rows) >= 1024 or size >= 1 << 24:
                    yield flush()
                    rows, size = [], 0
        if stream is not None:
            stream.close()
        if rows:
            yield flush()

    return map_arrow(lines, run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: record_id, record_type, response, requests and metadata.

    A request or metadata record belongs to each response, revisit or resource
    that it names in WARC-Concurrent-To or that names it. Records that belong
    to none give a row with a null response under their own id; a primary
    record without company has empty arrays. Identifiers decide alone: a
    repeated one repeats the capture.
    """
    body = [c for c in records.columns if c != "record_id"]
    primary = records.where(F.col("record_type").isin(*PRIMARY)).select("record_id", F.struct(*body).alias("response"))
    others = records.where(F.col("record_type").isin("request", "metadata")).select(
        F.col("record_id").alias("other"), F.struct("record_id", *body).alias("record"), F.col("concurrent_to").alias("names")
    )
    named = primary.select(F.col("record_id").alias("capture"), F.explode("response.concurrent_to").alias("other"))
    names = others.select("other", F.explode("names").alias("capture")).join(primary.select(F.col("record_id").alias("capture")).distinct(), "capture", "left_semi")
    pairs = names.select("capture", "other").unionByName(named.select("capture", "other")).distinct()
    company = others.join(pairs, "other", "left").groupBy(F.coalesce("capture", "other").alias("record_id"))
    kind = lambda k: F.filter(F.array_sort(F.collect_list("record")), lambda r: r["record_type"] == k)
    together = company.agg(kind("request").alias("requests"), kind("metadata").alias("metadata"))
    none = F.array().cast(together.schema["requests"].dataType)
    out = primary.join(together, "record_id", "full_outer")
    return out.select("record_id", F.col("response.record_type").alias("record_type"), "response", F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"))


def captures_of(pages: DataFrame, least: int = 0, **columns: str) -> DataFrame:
    """Write pages to archives in the shared folder, read them back and assemble: one row for each page.

    page_id, payload_bytes, payload_digest (bare), record_type, refers_to, n_requests, digest_ok.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, least=least, **columns)
    captures = assemble(written(read_records(spark, path, payloads=False)))
    facts = F.from_json(F.get("metadata", F.lit(0))["block"].cast("string"), "id long, refers_to long, url string")
    return captures.withColumn("facts", facts).select(
        F.col("facts.id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.regexp_replace("response.payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        F.col("facts.refers_to").alias("refers_to"),
        F.size("requests").cast("long").alias("n_requests"),
        F.col("response.digest_ok").alias("digest_ok"),
    )
