"""WARC archives: a writer with revisit records, and a reader that salvages damaged ones.

The reader goes through an archive record by record. Each record must pass its checks: the gzip
member's own check sum, the version line, well-formed headers, ``Content-Length`` bytes with two
line ends behind them, and the block digest if one is given. After a failed check it searches for
the next gzip member that starts with a version line (or the next version line, where nothing is
compressed), goes on there, and logs the bytes in between as a quarantined gap.

Archives are cells of binary data: those that :func:`write_archives` makes, or files read with
Spark's ``binaryFile`` source. Each holds about ``ARCHIVE_BYTES`` of payload, which bounds a
task's memory.

Defined cases: null payload counts as empty. Of records with equal payloads of at least
``least_bytes`` bytes, that with the largest id is the response and the others revisit it;
repeats of that largest id are responses too. A record with a null id is written, is the response
only if its group has no other id, and comes back as null. An empty table gives no archive. An
archive that is null or empty gives no record and no gap. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch_path

ARCHIVE_BYTES = 8 << 20
_VERSION = b"WARC/1."
_MEMBER = b"\x1f\x8b\x08"
_NAME = re.compile(rb"[!#$%&'*+\-.^_`|~0-9A-Za-z]+")
_ID = "<urn:x-record:%s>"


def digest_of(data: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes, compress: bool = True) -> bytes:
    """One record, as a gzip member of its own if ``compress``."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    raw = head.encode() + b"\r\n" + block + b"\r\n\r\n"
    if not compress:
        return raw
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def decided(pages: DataFrame, id_col: str, payload: Column, least_bytes: int) -> DataFrame:
    """id, payload_digest, refers_to (null for responses), one row for each input row; payloads stay behind.

    The digest is SHA-256 here: only equality matters. Sums and maxima are combined before the
    shuffle, so a payload that a third of all rows share is a row per task.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.sha2(payload, 256).alias("same"), (F.octet_length(payload) >= least_bytes).alias("long_enough"))
    largest = rows.where("long_enough").groupBy("same").agg(F.max("id").alias("last"))
    out = rows.join(largest, "same", "left")
    revisit = F.col("long_enough") & F.coalesce(F.col("id") != F.col("last"), F.col("last").isNotNull())
    return out.select("id", "same", F.when(revisit, F.col("last")).alias("refers_to"))


_ARCHIVE = "archive string, content binary"
_ARCHIVE_ARROW = pa.schema([("archive", pa.string()), ("content", pa.binary())])


def _packed(compress: bool, archive_bytes: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:05d}.warc" + ".gz" * compress
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(held)], pa.binary())], schema=_ARCHIVE_ARROW)

        for batch in batches:
            for name, url, payload, refers in zip(*(batch.column(c) for c in ("id", "url", "payload", "refers_to")), strict=True):
                name, url, refers = name.as_py(), url.as_py() or "", refers.as_py()
                data = (payload.as_py() or "").encode()
                clean = re.sub(r"[\x00-\x20\x7f]+", "%20", url)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
                block = http if refers is not None else http + data
                headers = [
                    ("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", _ID % name), ("WARC-Date", "2000-01-01T00:00:00Z"),
                    ("WARC-Target-URI", clean), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest_of(data)}"),
                    ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
                ]
                if refers is not None:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _ID % refers)]
                held.append(one := record(headers, block, compress))
                size += len(one)
                if size >= archive_bytes:
                    yield archive()
                    held, size, number = [], 0, number + 1
        if held:
            yield archive()

    return task


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, compress: bool = True, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """A WARC record for each row, in archives that Spark writes to ``folder`` (archive, content)."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    choice = decided(pages, id_col, payload, least_bytes)
    key = [F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("key")]
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("same", F.sha2("payload", 256))
    # By id and digest: rows that repeat both get the same choice, which is taken once.
    joined = rows.select("id", "url", "payload", "same", *key).join(choice.select("same", "refers_to", *key).distinct(), ["no_id", "key", "same"])
    joined.select("id", "url", "payload", "refers_to").mapInArrow(_packed(compress, archive_bytes), _ARCHIVE).write.option("compression", "none").parquet(folder)


def _inflated(data: memoryview, at: int, step: int = 1 << 16) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member that starts at ``at``, or None if it isn't whole and right."""
    reader, out = zlib.decompressobj(31), []
    while not reader.eof and at < len(data):
        try:
            out.append(reader.decompress(data[at:at + step]))
        except zlib.error:
            return None
        at = min(at + step, len(data))
    return (b"".join(out), at - len(reader.unused_data)) if reader.eof else None


def _parsed(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """(headers in lower case, block, end) of the record at ``at``, or what is wrong with it."""
    if not raw.startswith(_VERSION, at):
        return "no version line"
    head_end = raw.find(b"\r\n\r\n", at)
    if head_end < 0:
        return "headers don't end"
    lines, headers = raw[at:head_end].split(b"\r\n"), {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not _NAME.fullmatch(name):
            return "bad header line"
        headers[name.decode("ascii").lower()] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", headers.get("content-length", "")):
        return "no Content-Length"
    first = head_end + 4
    end = first + int(headers["content-length"])
    if raw[end:end + 4] != b"\r\n\r\n":
        return "no line ends behind the block"
    block = raw[first:end]
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:].upper() != digest_of(block):
        return "block digest differs"
    return headers, block, end + 4


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, (headers, block)) and ("gap", start, end, reason), in order, for a whole archive."""
    view, at, bad_from, reason = memoryview(data), 0, None, ""

    def next_place(after: int) -> int:
        places = [p for p in (data.find(_MEMBER, after), data.find(_VERSION, after)) if p >= 0]
        return min(places, default=len(data))

    while at < len(data):
        found: list[tuple[dict[str, str], bytes]] = []
        if data.startswith(_MEMBER, at):
            member, why, end = _inflated(view, at), "damaged gzip member", at
            if member:
                raw, end = member
                inner, why = 0, ""
                while inner < len(raw) and not why:
                    one = _parsed(raw, inner)
                    if isinstance(one, str):
                        why = one
                    else:
                        found.append(one[:2])
                        inner = one[2]
                why = why or ("" if raw else "empty gzip member")
        else:
            one = _parsed(data, at)
            why, end = (one, at) if isinstance(one, str) else ("", one[2])
            if not why:
                found.append(one[:2])
        if why and not found:
            if bad_from is None:
                bad_from, reason = at, why
            at = next_place(at + 1)
            continue
        if bad_from is not None:
            yield "gap", bad_from, at, reason
            bad_from = None
        for headers, block in found:
            yield "record", at, end, (headers, block)
        if why:  # a member whose first records are right
            yield "gap", at, end, f"rest of the member: {why}"
        at = end
    if bad_from is not None:
        yield "gap", bad_from, len(data), reason


_FOUND = "archive string, kind string, start long, stop long, reason string, record_type string, record_id string, refers_to string, url string, payload_bytes long, payload_digest string, payload binary"
_FOUND_ARROW = pa.schema([("archive", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), *((c, pa.string()) for c in ("reason", "record_type", "record_id", "refers_to", "url")), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _row(archive: str, kind: str, start: int, stop: int, what: object, with_payload: bool) -> tuple:
    if kind == "gap":
        return (archive, kind, start, stop, what, *[None] * 7)
    headers, block = what
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = headers.get("warc-type") == "revisit"
    if revisit:  # the payload isn't here: its length and digest are what the record says
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
        size, digest = int(length[1]) if length else None, headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    else:
        size, digest = len(payload), digest_of(payload)
    return (archive, kind, start, stop, None, headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), size, digest, payload if with_payload and not revisit else None)


def _read(with_payload: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("archive"), batch.column("content"), strict=True):
                rows, size = [], 0
                for kind, start, stop, what in salvage(content.as_py() or b""):
                    rows.append(_row(archive.as_py(), kind, start, stop, what, with_payload))
                    size += 200 + len(rows[-1][-1] or b"")
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _FOUND_ARROW, strict=True)], schema=_FOUND_ARROW)

    return task


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps (kind "record" or "gap") of archives (archive, content).

    For files: ``spark.read.format("binaryFile").load(p).select(F.col("path").alias("archive"), "content")``.
    """
    return archives.select("archive", "content").mapInArrow(_read(with_payload), _FOUND)


def op3_warc_salvage(spark, sf_dir: str) -> DataFrame:
    """Every row of pages as a WARC record, written and read back."""
    folder = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = read_archives(spark.read.schema(_ARCHIVE).parquet(folder), with_payload=False)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:x-record:(-?[0-9]+)>$', 1) as long)")
    return found.where("kind = 'record'").select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


#: Base32 of the hexadecimal SHA-1, five bits at a time.
ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), g AS (
  SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p
), b AS (
  SELECT *, array_to_string([['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010',
    '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', substr(x, i, 1))] FOR i IN range(1, 41)], '') AS bits FROM g
)
SELECT page_id, n AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * j + 1, 1)::INT + 8 * substr(bits, 5 * j + 2, 1)::INT
    + 4 * substr(bits, 5 * j + 3, 1)::INT + 2 * substr(bits, 5 * j + 4, 1)::INT + substr(bits, 5 * j + 5, 1)::INT, 1) FOR j IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""
