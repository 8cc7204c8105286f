"""Writes pages as WARC archives of one gzip member per record, and reads archives, whole or damaged."""

import base64
import hashlib
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches

# Marks of the WARC and gzip formats.
VERSION, MAGIC = b"WARC/1.", b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member without content. It stands behind each record's member as the writer's line separator, so files stay valid gzip.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00" + b"\x00" * 8
# start, length: bytes of the file, of a packed record those of its member; inner_start, inner_length: bytes of the member's content.
RECORDS = ("file string, start long, length long, inner_start long, inner_length long, kind string, record_id string, page_id long, url string, "
           "payload binary, payload_bytes long, payload_digest string, refers_to long")


def with_roles(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``payload_bytes``, ``payload_digest``, ``refers_to`` (null for responses).

    Of equal payloads of at least ``least`` bytes, the smallest page_id keeps its payload and the others refer to it."""
    records = pages.select(
        F.col(f"`{page}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    first = records.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    return records.join(first, "payload_digest", "left").withColumn("refers_to", refers).drop("first")


def record(page_id, url, payload, n_bytes, digest, refers_to, date) -> bytes:
    """One WARC record, uncompressed; a revisit holds the response's head alone."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}",
        *([] if url is None else ["WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url)]),
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def write_archives(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", html: str = "html", least: int = 100,
                   date: str = "1970-01-01T00:00:00Z", records_per_file: int = 20_000, bytes_per_file: int = 1 << 30) -> None:
    """Writes a record for each row of ``pages`` to archives under ``path``.

    Null html is an empty payload; null urls are left out; rows with a null page_id refer to the smallest page_id with that
    payload, if there is one; rows that repeat the smallest page_id are all responses; an empty table writes no record; further
    columns are ignored."""

    bounded_batches(pages.sparkSession)

    def members(frames):
        for frame in frames:
            clean = frame.astype(object).where(frame.notna(), None)
            yield pd.DataFrame({"value": [
                member(record(*(None if v is None else int(v) if i in (0, 3, 5) else v for i, v in enumerate(row)), date))
                for row in clean.itertuples(index=False, name=None)]})

    # A file is read whole, so even records of the greatest size keep one to its bytes.
    size = F.coalesce(F.octet_length(F.col(f"`{html}`")), F.lit(0)) + 3 * F.coalesce(F.octet_length(F.col(f"`{url}`")), F.lit(0)) + 1000
    greatest = pages.agg(F.max(size)).first()[0] or 1
    records_per_file = max(1, min(records_per_file, bytes_per_file // greatest))
    columns = "page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to"
    # A revisit's payload isn't needed any more.
    lean = with_roles(pages, page, url, html, least).withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    out = lean.select(*columns).mapInPandas(members, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option(
        "maxRecordsPerFile", records_per_file).text(path)


def member_at(data, start: int):
    """Content and end of the gzip member at ``start``; None if it isn't whole (checksum, length)."""
    if bytes(data[start:start + 3]) != MAGIC:
        return None
    opened, at, parts = zlib.decompressobj(31), start, []
    try:
        while not opened.eof and at < len(data):
            parts.append(opened.decompress(data[at:at + 65536]))
            at = min(at + 65536, len(data))
    except zlib.error:
        return None
    return (b"".join(parts), at - len(opened.unused_data)) if opened.eof else None


def digest_holds(told: str, payload: bytes) -> bool:
    """Whether a digest as a record tells it fits the payload; those of unknown algorithms can't be checked and pass."""
    algorithm, found, value = told.partition(":")
    if not found or algorithm.lower() not in ("sha1", "sha256", "md5"):
        return True
    digest = hashlib.new(algorithm.lower(), payload).digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def parse(data: bytes, start: int = 0):
    """Fields and end of the record at ``start``; None if its head, length, end or payload digest is wrong. A head may have any length."""
    if not data.startswith(VERSION, start):
        return None
    stop = data.find(b"\r\n\r\n", start)
    fields = {}
    for line in data[start:stop].split(b"\r\n")[1:] if stop >= 0 else ():
        name, found, value = line.partition(b":")
        if not found:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "surrogateescape")
    if not fields.get("content-length", "").isdigit() or fields.get("warc-type") is None:
        return None
    at, end = stop + 4, stop + 4 + int(fields["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        return None
    block = data[at:end]
    head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    told = fields.get("warc-payload-digest", "")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and not digest_holds(told, payload):
        return None
    length = re.search(rb"(?i)^content-length:\s*(\d+)", head, re.M)
    ident = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    url = fields.get("warc-target-uri")
    return {
        "kind": fields["warc-type"], "record_id": fields.get("warc-record-id"), "page_id": ident("warc-record-id"),
        "url": None if url is None else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url), "payload": None if revisit else payload,
        "payload_bytes": int(length[1]) if revisit and length else len(payload),
        # Of a revisit, whose payload isn't there, the digest as it is told.
        "payload_digest": told.removeprefix("sha256:") or None if revisit else hashlib.sha256(payload).hexdigest(),
        "refers_to": ident("warc-refers-to")}, end + 4


def salvage(data: bytes, packed: bool = True):
    """Yields (start, length, fields) for each valid record and (start, length, None) for each byte gap between them.

    After a failed check the search goes on at the next member magic or version line; what was passed is one gap. The content of a whole
    gzip member is salvaged in the same way by its version lines: its records carry the member's bytes in the file and, as ``inner``,
    their own bytes in its content, and so do gaps in it (fields with ``inner`` alone). A member without a record is a gap."""
    at, gap = 0, None
    marks = {mark: data.find(mark) for mark in ((MAGIC, VERSION) if packed else (VERSION,))}  # next place of each, -1 for none
    while at < len(data):
        got, end = None, None
        if packed and data.startswith(MAGIC, at) and (opened := member_at(memoryview(data), at)) is not None:
            content, stop = opened
            inner = list(salvage(content, packed=False))
            if not content or any(f for _, _, f in inner):
                got, end = [{"inner": (a, n), **(f or {})} if len(inner) > 1 else f for a, n, f in inner], stop
        elif (plain := parse(data, at)) is not None:
            got, end = [plain[0]], plain[1]
        if end is None:
            gap = at if gap is None else gap
            marks = {mark: data.find(mark, at + 1) if 0 <= near <= at else near for mark, near in marks.items()}
            at = min((near for near in marks.values() if near >= 0), default=len(data))
            continue
        if gap is not None:
            yield gap, at - gap, None
            gap = None
        for fields in got:
            yield at, end - at, fields
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``RECORDS``: every record that can be read (kind is its WARC type) and every quarantined gap (kind ``gap``).

    Archives may be gzip of one or several records a member, plain, or both, from any writer: payload digests are checked by their own
    algorithm (SHA-1, SHA-256 or MD5, in hex or base 32), and ``record_id`` is as the record tells it. An archive is read by one task, so the
    writer bounds its bytes. A file without a byte gives no row. A folder without archives gives no rows."""

    bounded_batches(spark)

    def rows(frames):
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                found = []
                for start, length, fields in salvage(bytes(content)):
                    inner = (fields or {}).pop("inner", (None, None))
                    found.append({"file": file, "start": start, "length": length, "inner_start": inner[0], "inner_length": inner[1], "kind": "gap", **(fields or {})})
                    if len(found) >= 1000:
                        yield _frame(found)
                        found = []
                yield _frame(found)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, RECORDS)


def _frame(rows: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in RECORDS.split(", ")]
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    for c in ("start", "length", "inner_start", "inner_length", "page_id", "payload_bytes", "refers_to"):
        frame[c] = frame[c].astype("Int64")
    return frame
