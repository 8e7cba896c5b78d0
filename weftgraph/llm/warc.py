"""WARC archives: written and read by Spark's own file systems, transactions assembled by join.

Each page gives three records: a response (or a revisit, if another page with the same payload is the response), a request and a metadata
record; the last two name the first through WARC-Concurrent-To. assemble() joins them back to one nested row per capture.

Every record is a gzip member of its own, so a reader that knows a record's offset can start there, and every file starts with a warcinfo record.
Files are written by Spark's committer, so a task that is retried leaves no half file. The writer ends each of its rows with a separator; here that is
the zero byte that closes the (empty) file name in the next member's gzip header, so a row holds the end of one member and the start of the next. A
file is closed after `part_bytes` compressed bytes or `ROWS` rows, whichever comes first, and filled up with zero bytes (at most ROWS), which gzip
readers skip. The writer names files .txt.

Defined results: a null html is an empty payload. A null url gives a record without target URI and a request for /. Equal rows give equal
records, each assembled on its own. A null page_id is written as null and read as null. An empty table gives no captures. Payloads are written whole, a
record is never split over files. Of columns other than page_id, url and html nothing is written.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
MIN_REVISIT = 1000
PART_BYTES, ROWS = 64 << 20, 4000
RECORD = "record_id string, record_type string, concurrent_to array<string>, refers_to string, target_uri string, payload_bytes long, payload_digest string, info string, payload binary"
INFO = "page_id long, url string, payload_bytes long"


def _urn(key: Column, kind: str) -> Column:
    h = F.md5(F.concat(key, F.lit(kind)))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column | str, record_id: Column, block: Column, content_type: Column | str, date: Column, *extra: Column) -> Column:
    """A record; an extra header that is null is left out."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), lit(kind)), F.concat(F.lit("WARC-Record-ID: "), record_id), F.concat(F.lit("WARC-Date: "), date),
        *extra, F.concat(F.lit("Content-Type: "), lit(content_type)), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(CRLF * 2), block, F.lit(CRLF * 2))


def transactions(pages: DataFrame, date: str | Column, min_revisit: int) -> DataFrame:
    """One row per page: its three records."""
    date = F.lit(date) if isinstance(date, str) else date
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), date.alias("date"))
    date = F.col("date")
    base = base.withColumns({"digest": F.sha1("html"), "bytes": F.octet_length("html").cast("long")})
    base = base.withColumn("key", F.md5(F.concat_ws("\x01", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("="), "url"), F.lit("-")), "digest")))
    large = base.where(F.col("bytes") >= min_revisit)
    kept = large.groupBy("digest").agg(F.max(F.struct("page_id", "key")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 and kept.page_id is not null").select("digest", "kept")
    base = base.join(kept, "digest", "left")
    again = F.col("kept").isNotNull() & (F.col("bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("kept.page_id"))
    own = _urn(F.col("key"), "response")
    uri = F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    status = F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: ")
    http = F.concat(status, F.col("bytes").cast("string"), F.lit(CRLF * 2))
    capture = _record(
        F.when(again, "revisit").otherwise("response"), own, F.when(again, http).otherwise(F.concat(http, F.col("html"))), "application/http;msgtype=response", date, uri, digest,
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("kept.key"), "response"))))
    link = F.concat(F.lit("WARC-Concurrent-To: "), own)
    # scheme://host/path?query, read by one pattern, so that odd urls give no error
    where = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^#]*)"
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    host, target = F.regexp_extract(clean, where, 1), F.regexp_extract(clean, where, 2)
    target = F.concat(F.when(F.startswith(target, F.lit("/")), F.lit("")).otherwise(F.lit("/")), target)
    ask = F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1" + CRLF), F.when(host != "", F.concat(F.lit("Host: "), host, F.lit(CRLF))).otherwise(F.lit("")), F.lit(CRLF))
    request = _record("request", _urn(F.col("key"), "request"), ask, "application/http;msgtype=request", date, uri, link)
    info = F.to_json(F.struct("page_id", "url", F.col("bytes").alias("payload_bytes")))
    metadata = _record("metadata", _urn(F.col("key"), "metadata"), info, "application/json", date, uri, link)
    return base.select(capture.alias("capture"), request.alias("request"), metadata.alias("metadata"))


_HEAD = b"\x1f\x8b\x08\x08\x00\x00\x00\x00\x00\xff"  # a gzip header with a file name, which the writer's separator ends at once


def _rest(record: bytes) -> bytes:
    """A gzip member of the record without its header."""
    engine = zlib.compressobj(6, zlib.DEFLATED, -15)
    return engine.compress(record) + engine.flush() + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")


def _warcinfo(first: bytes) -> bytes:
    """The record that describes a file, named after the file's first record."""
    h = hashlib.md5(first).hexdigest()
    block = f"software: weftgraph{CRLF}format: WARC File Format 1.1{CRLF}".encode()
    date = next((x for x in first[:2000].split(CRLF.encode()) if x.startswith(b"WARC-Date: ")), b"WARC-Date: 1970-01-01T00:00:00Z")
    head = f"WARC/1.1{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>{CRLF}".encode() + date
    return head + f"{CRLF}Content-Type: application/warc-fields{CRLF}Content-Length: {len(block)}{CRLF * 2}".encode() + block + (CRLF * 2).encode()


def _members(part_bytes: int):
    """Rows of the text writer: member ends and the next member's header; each file takes exactly ROWS rows but the last."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[bytes] = []
        rows = size = held = 0  # of the open file; bytes in `out`
        rest = b""  # the member whose end is not written yet

        def close() -> None:
            nonlocal rows, size, rest
            out.append(rest)
            out.extend([b""] * (ROWS - rows - 1))
            rows, size, rest = 0, 0, b""

        for batch in batches:
            columns = [batch.column(i) for i in range(3)]
            for r in range(batch.num_rows):
                if rows and (size >= part_bytes or rows + 4 > ROWS):
                    close()
                records = [c[r].as_py() for c in columns]
                for record in ([_warcinfo(records[0])] if not rows else []) + records:
                    piece = rest + _HEAD if rows else _HEAD
                    out.append(piece)
                    rest = _rest(record)
                    rows, size, held = rows + 1, size + len(piece), held + len(piece)
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
        if rows:
            out.append(rest)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return go


def write_archives(pages: DataFrame, path: str, *, date: str | Column = "2024-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT, part_bytes: int = PART_BYTES) -> None:
    """Write WARC files below path. Of pages with equal payloads of min_revisit bytes or more, the largest page_id is the response. date: a WARC date, or a column of pages that holds one."""
    records = transactions(pages, date, min_revisit).select(*[F.col(c).cast("binary") for c in ("capture", "request", "metadata")])
    members = records.mapInArrow(_members(part_bytes), "value binary").select(F.col("value").cast("string"))
    members.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", ROWS).text(path)


def parse(chunks: Iterator[bytes], with_payload: bool) -> Iterator[tuple]:
    """Records of one gzip archive, read piece by piece."""
    held, engine = bytearray(), zlib.decompressobj(31)

    def feed() -> Iterator[bytes]:
        nonlocal engine
        fresh = True
        for chunk in chunks:
            while chunk:
                if fresh:
                    chunk = chunk.lstrip(b"\0")  # filling between members
                    if not chunk:
                        break
                yield engine.decompress(chunk)
                chunk, fresh = engine.unused_data, engine.eof
                if engine.eof:
                    engine = zlib.decompressobj(31)

    source = feed()

    def need(n: int) -> bool:
        while len(held) < n:
            piece = next(source, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not need(len(held) + 1):
                if held.strip():
                    raise ValueError("archive ends inside a record header")
                return
        lines = bytes(held[:end]).decode("utf-8", "surrogatepass").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = [(k.lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
        head = dict(fields)
        size = int(head["content-length"])
        if not need(end + 4 + size + 4):
            raise ValueError("archive ends inside a record")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size + 4]
        kind = head["warc-type"]
        payload = block.partition(b"\r\n\r\n")[2] if kind in ("response", "revisit", "request") else block
        whole = kind == "response"
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if whole and digest != hashlib.sha1(payload).hexdigest():
            raise ValueError(f"payload digest differs in {head['warc-record-id']}")
        yield (
            head["warc-record-id"], kind, [v for k, v in fields if k == "warc-concurrent-to"], head.get("warc-refers-to"), head.get("warc-target-uri"), len(payload) if whole else None, digest,
            payload.decode("utf-8", "surrogatepass") if kind == "metadata" else None, payload if with_payload and whole else None)


def _read(with_payload: bool):
    names = [x.split()[0] for x in RECORD.split(", ")]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows: list[tuple] = []
                for row in parse((content[i : i + (1 << 18)] for i in range(0, len(content), 1 << 18)), with_payload):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield _frame(rows, names)
                        rows = []
                if rows:
                    yield _frame(rows, names)

    return go


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object)
    out["payload_bytes"] = out["payload_bytes"].astype("Int64")
    return out


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, pattern: str = "*.{gz,txt}") -> DataFrame:
    """One row per record of the archives below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("content")
    return files.mapInPandas(_read(with_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture, requests and metadata (arrays, by record id), and info read from the first metadata record.

    The joins run on the record id, which is unique but for equal rows; equal request and metadata records count once, so
    equal captures don't multiply. Requests and metadata that name no capture of the archives are rows with a null capture.
    """
    capture = records.where(F.col("record_type").isin("response", "revisit")).select(F.struct("record_id", "record_type", "refers_to", "target_uri", "payload_bytes", "payload_digest", "payload").alias("capture"))
    attached = records.where(F.col("record_type").isin("request", "metadata")).select("record_type", "record_id", "target_uri", "info", F.explode_outer("concurrent_to").alias("to"))
    attached = attached.groupBy("to").agg(
        F.array_sort(F.collect_set(F.when(F.col("record_type") == "request", F.struct("record_id", "target_uri")))).alias("requests"),
        F.array_sort(F.collect_set(F.when(F.col("record_type") == "metadata", F.struct("record_id", "info")))).alias("metadata"))
    both = capture.join(attached, F.col("capture.record_id") == F.col("to"), "full_outer").drop("to")
    return both.withColumn("info", F.from_json(F.get("metadata", F.lit(0))["info"], INFO))
