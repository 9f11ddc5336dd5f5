"""WARC writing and a salvage reader.

``write_warc`` turns pages into WARC 1.1 records with Spark's text writer: a record ends with CR LF CR LF, which is the
writer's line separator, so the files are plain WARC on any file system that Spark reaches. Of pages with equal
payloads of at least ``MIN_REVISIT`` bytes, the one with the smallest id becomes a response, the others revisits that
name it and keep its HTTP header without the payload. Files are bounded by records and bytes.

``read_warc`` reads files with Spark's binaryFile source and parses them record by record. A record whose version
line, header, length, end or block digest does not hold is not trusted: the reader searches for the nearer of the next
version line at which a valid record starts and the next gzip member that inflates to a version line, whatever the file
starts with, reports the bytes between as a gap with the reason of the failed check, and reads on.

Cases: a null payload is empty; null and repeated urls are fine (line breaks in urls become spaces); a null page id is
written as ``null`` and read back as null, last in the choice of the response; rows that repeat the response's id and
payload are responses too; an empty table writes no record; extra columns are ignored; empty files hold no record.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilia.llm import common

MIN_REVISIT = 100
FILE_RECORDS, FILE_BYTES = 2000, 32 << 20
FEW_REVISITS = 50_000  # revisit rows (about 150 bytes each) that are broadcast after their count; more are joined by a shuffle
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"  # of every record: output must not depend on the clock

RECORD = ("path string, offset long, length long, kind string, reason string, warc_type string, record_id string, refers_to string, "
          "target_uri string, payload_bytes long, payload_digest string, payload binary")


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, first): ``first`` holds the response's page id for revisits, else null."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("payload"))
    src = src.withColumn("digest", F.sha2("payload", 256))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id")
    known = src.filter(F.octet_length("payload") >= MIN_REVISIT).select("page_id", "digest")  # no payload is shuffled
    equal = known.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = known.join(equal, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first.page_id"))).distinct()
    again = common.write_cut(again.select(common.row_key(F.col("page_id"), F.col("digest")).alias("key"), "first"))
    again = F.broadcast(again) if again.count() <= FEW_REVISITS else again
    return src.withColumn("key", common.row_key(F.col("page_id"), F.col("digest"))).join(again, "key", "left").drop("key")


def records(roles: DataFrame) -> DataFrame:
    """One text ``value`` per record, without the end that the text writer puts behind it."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(CRLF + CRLF)).cast("binary")
    revisit = F.col("first").isNotNull()
    df = roles.withColumn("block", F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), name(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " "),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), name(F.col("first.page_id")))).otherwise(""),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(f"{CRLF}WARC-Block-Digest: sha256:"), F.sha2("block", 256),
        F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), F.octet_length("block").cast("string"), F.lit(CRLF + CRLF))
    return df.select(F.concat(head.cast("binary"), F.col("block")).cast("string").alias("value"))


def write_warc(pages: DataFrame, path: str, **names) -> None:
    """Write one record per row of ``pages`` under ``path``; a file holds FILE_RECORDS records and FILE_BYTES bytes at
    most (or one longer record)."""
    roles = with_roles(pages, **names)
    longest = pages.agg(F.max(F.octet_length(names.get("body_col", "html")))).first()[0] or 0
    per_file = max(1, min(FILE_RECORDS, FILE_BYTES // (longest + 1024)))
    records(roles).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", per_file).text(path)


class Bad(Exception):
    """A check that failed; the text is the gap's reason."""


VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MAGIC = b"\x1f\x8b\x08"


def parse_record(data: bytes, pos: int) -> tuple[int, dict]:
    """(end, record) of the record at ``pos``; raises Bad if any check fails."""
    if not VERSION.match(data, pos):
        raise Bad("no version line")
    end = data.find(b"\r\n\r\n", pos)
    if end < 0:
        raise Bad("header without end")
    lines = data[pos:end].split(b"\r\n")[1:]
    if any(b":" not in x for x in lines):
        raise Bad("broken header line")
    fields = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in lines)]
    head, single = dict(fields), [k for k, _ in fields if k != b"warc-concurrent-to"]
    if len(set(single)) < len(single):  # a cut record that ran into the next one
        raise Bad("repeated header field")
    if not head.get(b"content-length", b"").isdigit() or b"warc-type" not in head or b"warc-record-id" not in head:
        raise Bad("header without type, id or length")
    start, size = end + 4, int(head[b"content-length"])
    if start + size > len(data):
        raise Bad("block is cut short")
    if data[start + size:start + size + 4] != b"\r\n\r\n":
        raise Bad("length does not lead to the record's end")
    block = data[start:start + size]
    kind, _, digest = head.get(b"warc-block-digest", b"").partition(b":")
    if kind.lower() == b"sha256" and hashlib.sha256(block).hexdigest().encode() != digest.lower():
        raise Bad("block digest differs")
    return start + size + 4, {"head": head, "block": block}


def _fields(rec: dict, with_payload: bool) -> dict:
    head, block = rec["head"], rec["block"]
    text = lambda k: head[k].decode("utf-8", "replace") if k in head else None
    out = {"warc_type": text(b"warc-type"), "record_id": text(b"warc-record-id"), "refers_to": text(b"warc-refers-to"), "target_uri": text(b"warc-target-uri")}
    http, sep, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    if out["warc_type"] == "revisit":  # the payload is the other record's; its header tells the length
        length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
        out |= {"payload_bytes": int(length[1]) if length else None, "payload_digest": (text(b"warc-payload-digest") or ":").partition(":")[2].lower() or None, "payload": None}
    else:
        out |= {"payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest(), "payload": body if with_payload else None}
    return out


def _valid(data: bytes, pos: int) -> bool:
    try:
        parse_record(data, pos)
    except Bad:
        return False
    return True


def read_plain(data: bytes) -> Iterator[tuple[int, int, str, str | dict]]:
    """(start, end, 'record', fields) and (start, end, 'gap', reason) that together cover ``data``."""
    pos = 0
    while pos < len(data):
        try:
            end, rec = parse_record(data, pos)
            yield pos, end, "record", rec
        except Bad as why:
            end = next((m.start() for m in VERSION.finditer(data, pos + 1) if _valid(data, m.start())), len(data))
            yield pos, end, "gap", str(why)
        pos = end


def _member(data: bytes, pos: int) -> tuple[int, bytes]:
    z, out, at, view = zlib.decompressobj(31), [], pos, memoryview(data)
    try:
        while not z.eof and at < len(data):
            out.append(z.decompress(view[at:at + 65536]))
            at = min(len(data), at + 65536)
    except zlib.error as e:
        raise Bad("broken gzip member") from e
    if not z.eof:
        raise Bad("gzip member is cut short")
    return at - len(z.unused_data), b"".join(out)


def _next_member(data: bytes, pos: int) -> int:
    """Where the next gzip member from ``pos`` on starts that inflates to a version line."""
    while (pos := data.find(MAGIC, pos)) >= 0:
        try:
            if VERSION.match(_member(data, pos)[1]):
                return pos
        except Bad:
            pass
        pos += 1
    return len(data)


def read_any(data: bytes) -> Iterator[tuple[int, int, str, str | dict]]:
    """As read_plain, for files of plain records, gzip members or both; offsets of records in members are those of the
    members. Bytes lost inside a member (its sum is right, a record in it is not) are a gap with the member's place."""
    pos = plain = member = 0  # plain, member: the next start of either kind, as far as it was searched
    while pos < len(data):
        try:
            if data.startswith(MAGIC, pos):
                end, inner = _member(data, pos)
                for _, _, kind, what in read_plain(inner):
                    yield pos, end, kind, what
            else:
                end, rec = parse_record(data, pos)
                yield pos, end, "record", rec
        except Bad as why:
            if plain <= pos:
                plain = next((m.start() for m in VERSION.finditer(data, pos + 1) if _valid(data, m.start())), len(data))
            if member <= pos:
                member = _next_member(data, pos + 1)
            end = min(plain, member)
            yield pos, end, "gap", str(why)
        pos = end


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` (schema RECORD) of all files under ``path``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            for where, data in zip(b["path"], b["content"], strict=True):
                rows, size = [], 0
                for start, end, kind, what in read_any(data):
                    row = {"path": where, "offset": start, "length": end - start, "kind": kind}
                    row |= _fields(what, with_payload) if kind == "record" else {"reason": what}
                    rows.append([row.get(n) for n in names])
                    size += end - start
                    if size > 8 << 20:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, RECORD)


def pages_of(found: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records read."""
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("null")).cast(id_type)
    return found.filter("kind = 'record'").select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest",
                                                   F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as WARC into the shared folder and read them back."""
    path = common.shared_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return pages_of(read_warc(pages.sparkSession, path, with_payload=False), pages.schema["page_id"].dataType.simpleString())
