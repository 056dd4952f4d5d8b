"""WARC archives: a writer by DataFrame functions and a reader that salvages damaged archives.

The writer makes one response record per page, or a revisit record where a page with a larger id has the same payload. Archives are plain text files whose
line end is the end of a WARC record, so Spark's own writer puts them into any store.

The reader checks each record: version line, headers, length, record end and payload digest. After a failed check it looks for the next
version line or gzip member, whichever comes first, from which a whole valid record can be read, goes on there and logs the bytes in between as a gap.

Defined cases: a null page is an empty payload; a null id gives a record without page number; rows equal in id and payload are all responses
if no larger id has the payload; an empty table gives no record; other columns than the named ones are not looked at; an archive is
read as one row, so writers should keep archives to some tens of MB (``RECORDS`` records each).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feaslens.llm.common import pick, stored
from feaslens.session import shared_folder

RECORDS = 1000
END = "\r\n\r\n"
#: The HTTP head of every response; the payload follows.
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NAME = "urn:page:"
LENGTH = "X-Payload-Length"

RECORD_SCHEMA = ("archive string, kind string, start long, end long, reason string, record_type string, page_id long, url string, "
                 "payload_bytes long, payload_digest string, refers_to long, payload binary")


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are twenty bits, and these four characters."""
    hexes = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """(record): the text of each page's record, without the end of record."""
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumns({"size": F.octet_length("html"), "digest": base32_sha1(F.col("html").cast("binary"))})
    holders = stored(rows.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).filter("n > 1").drop("n"), "warc-holders")
    rows = rows.join(holders, "digest", "left")
    again = (F.col("size") >= least) & (F.col("holder") > F.coalesce("page_id", F.col("holder") - 1))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    named = lambda c: F.concat(F.lit(f"<{NAME}"), c.cast("string"), F.lit(">"))
    block = F.when(again, F.lit(HEAD)).otherwise(F.concat(F.lit(HEAD), "html"))
    return rows.select(F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.coalesce(line("WARC-Record-ID", named(F.col("page_id"))), F.lit("")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "%20")), F.lit("")),
        F.when(again, line("WARC-Refers-To", named(F.col("holder")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), line(LENGTH, F.col("size").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block).alias("record"))


def write(pages: DataFrame, path: str, **options) -> None:
    """Archives under ``path``, each of at most ``RECORDS`` records."""
    records(pages, **options).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).text(path)


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_BEGIN = re.compile(re.escape(_MEMBER) + b"|" + _VERSION.pattern)


class Bad(Exception):
    """A check that failed, by name."""


def _headers(data: memoryview) -> dict[str, str]:
    out = {}
    for line in bytes(data).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("header")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _number(text: str | None) -> int | None:
    found = re.search(rf"{NAME}(-?\d+)", text or "")
    return int(found[1]) if found else None


def parse(data: bytes, at: int) -> tuple[int, dict]:
    """The end of the record that begins at ``at`` and its fields; ``Bad`` if a check fails."""
    if not _VERSION.match(data, at):
        raise Bad("version")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise Bad("header")
    headers = _headers(memoryview(data)[at:head])
    if not re.fullmatch(r"\d{1,18}", headers.get("content-length", "")):
        raise Bad("length")
    start = head + 4
    end = start + int(headers["content-length"])
    if end + 4 > len(data) or data[end:end + 4] != b"\r\n\r\n":
        raise Bad("end")
    kind, block = headers.get("warc-type"), memoryview(data)[start:end]
    payload = bytes(block)
    if headers.get("content-type", "").startswith("application/http"):
        payload = payload.partition(b"\r\n\r\n")[2]
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    size = len(payload)
    if kind == "revisit":
        if not re.fullmatch(r"\d{1,18}", headers.get(LENGTH.lower(), "")):
            raise Bad("length")
        size = int(headers[LENGTH.lower()])
    else:
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest and digest != own:
            raise Bad("digest")
        digest = own
    return end + 4, {"record_type": kind, "page_id": _number(headers.get("warc-record-id")), "url": headers.get("warc-target-uri"), "payload_bytes": size,
                     "payload_digest": digest, "refers_to": _number(headers.get("warc-refers-to")), "payload": None if kind == "revisit" else payload}


def _member(data: bytes, at: int) -> tuple[int, bytes]:
    """The end of the gzip member at ``at`` and what it holds."""
    if data[at:at + 3] != _MEMBER:
        raise Bad("member")
    inflate = zlib.decompressobj(31)
    try:
        out = inflate.decompress(memoryview(data)[at:])
    except zlib.error as e:
        raise Bad("member") from e
    if not inflate.eof:
        raise Bad("member")
    return len(data) - len(inflate.unused_data), out


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict | None]]:
    """(start, end, None, fields) of each valid record, (start, end, reason, None) of each gap, in order; together they cover all bytes."""
    at, lost, why = 0, None, None
    while at < len(data):
        try:
            if data.startswith(_MEMBER, at):
                end, text = _member(data, at)
                stop, fields = parse(text, 0)
                if stop != len(text):
                    raise Bad("member")
            else:
                end, fields = parse(data, at)
        except Bad as e:
            if lost is None:
                lost, why = at, str(e)
            # The search goes on inside the bad record: its length may be what is wrong.
            found = _BEGIN.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if lost is not None:
            yield lost, at, why, None
            lost = None
        yield at, end, None, fields
        at = end
    if lost is not None:
        yield lost, at, why, None


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record (``kind`` record) and one per quarantined gap (``kind`` gap, with ``reason``) of all archives under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()), ("record_type", pa.string()),
                            ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for archive, content in zip(batch.column("path"), batch.column("content")):
                rows, held = [], 0
                for start, end, reason, fields in salvage(content.as_buffer().to_pybytes()):
                    rows.append({"archive": archive.as_py(), "kind": "gap" if fields is None else "record", "start": start, "end": end, "reason": reason} | (fields or {}))
                    held += end - start
                    if held >= 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, RECORD_SCHEMA)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads these back."""
    path = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, path, **options)
    return read(pages.sparkSession, path)


def digest_sql() -> str:
    five = [f"(strpos('0123456789abcdef', substr(h, {{}} + {j}, 1)) - 1) * {16 ** (4 - j)}" for j in range(5)]
    chars = []
    for i in range(8):
        value = " + ".join(five).replace("{}", str(5 * i + 1))
        chars += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((({value}) >> {s}) & 31), 1)" for s in (15, 10, 5, 0)]
    return " || ".join(chars)


REPORT_SQL = f"""
with page as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
held as (select *, max(page_id) over (partition by h) as holder from page)
select page_id, payload_bytes::bigint as payload_bytes, {digest_sql()} as payload_digest,
       case when holder > page_id then 'revisit' else 'response' end as record_type, case when holder > page_id then holder end as refers_to
from held
"""
