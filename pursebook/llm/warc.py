"""WARC archives with segmented records (operator 5).

Writing: every page becomes a response record, or a revisit of the record that holds the
same payload, whose record id it refers to.  A record block longer than ``segment_bytes``
is cut into a first segment and continuation records; each record is a gzip member of its
own.  Archives are rows of a binary table in the shared folder, so that they outlive any
executor.

Reading: archives are parsed where they lie, each in one pass.  A record that is whole is
decoded at once and only its results travel; segments travel with their bytes, are grouped
by the id of the record they continue, ordered by segment number, checked against the total
length and joined.  Then chunked transfer framing is decoded and the payload is digested.

Skew: the representative of equal payloads comes from a min() with map-side combine; a
digest with very many pages is dealt over many tasks where it is joined back.  A group of
segments is one page; repeats of it are combined before they travel.

Defined results: null html is an empty payload; a null url is an empty one; a row that
repeats id, url and payload is a logical record with ``copies``, and op5 returns each row;
rows with a null id are responses unless a row with an id has the same payload; gaps, wrong
totals or bad framing give a text in ``error`` and no payload.  Bytes that are no gzip
member, and records without an id or with unusable headers, are rows with an ``error``;
reading goes on at the next gzip member.  An empty table gives no archives and no rows.
Only the named columns are read, so extra or clashing columns do no harm.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pursebook.llm.common import byte_rows, column_function, read_table, record, salted_join, stored

SEGMENT_BYTES = 1 << 14
ARCHIVE_BYTES = 4 << 20
CHUNK_BYTES = 4096
READ_BYTES = 1 << 16
GZIP_MAGIC = b"\x1f\x8b\x08"
#: Shorter payloads are never revisits.
MIN_REVISIT_BYTES = 100
DATE = "2000-01-01T00:00:00Z"
ARCHIVES = record(data=pa.binary())
RECORDS = record(
    origin=pa.string(), segment=pa.int32(), total=pa.int64(), kind=pa.string(), uri=pa.string(), refers_to=pa.string(),
    declared=pa.string(), payload_bytes=pa.int64(), payload_digest=pa.string(), block=pa.binary(), error=pa.string(),
)


def frame_chunks(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unframe_chunks(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size < 0:
            raise ValueError("a chunk of negative size")
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The entity of an HTTP message, without its transfer framing."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no end of the HTTP header")
    return unframe_chunks(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    raw = b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def record_id(page_id: object, url: str, digest: str) -> str:
    tail = hashlib.sha256(url.encode()).hexdigest()[:12]
    return f"<urn:page:{'' if page_id is None else page_id}:{digest[:24]}:{tail}>"


def records_of(page_id: object, url: str, html: bytes, digest: str, first: dict | None, segment_bytes: int) -> Iterator[bytes]:
    """The gzip members that archive one page; ``first`` is the page (page_id, url) that it revisits."""
    rid = record_id(page_id, url, digest)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    own = [("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if first is not None:
        more = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first["page_id"], first["url"], digest)), ("WARC-Refers-To-Target-URI", _clean(first["url"]))]
        yield _record(more + own, head + b"Content-Length: %d\r\n\r\n" % len(html))
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + frame_chunks(html)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record([("WARC-Type", "response"), *own, ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], parts[0])
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{rid[:-1]}:{n}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], part)


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives as rows (data): gzip members of WARC records, ``archive_bytes`` or a little more each."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    firsts = (
        rows.where(F.octet_length("html") >= MIN_REVISIT_BYTES).groupBy("digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    )
    rows = salted_join(rows.withColumn("place", F.xxhash64("page_id", "url")), firsts, "digest", "place", "n", "left")
    rows = rows.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first")))

    def write(batches):
        held, size = [], 0
        for batch in batches:
            small = batch.select(["page_id", "url", "digest", "first"]).to_pylist()
            for row, html in zip(small, byte_rows(batch.column("html"))):
                for member in records_of(row["page_id"], row["url"], html, row["digest"], row["first"], segment_bytes):
                    held.append(member)
                    size += len(member)
                    if size >= archive_bytes:
                        yield pa.RecordBatch.from_pydict({"data": [b"".join(held)]}, pa.schema([("data", pa.binary())]))
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"data": [b"".join(held)]}, pa.schema([("data", pa.binary())]))

    return rows.select("page_id", "url", "html", "digest", "first").mapInArrow(write, "data binary")


def members(data: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """(record, None) for each gzip member of an archive, (None, error) for what is none.

    The archive is fed in blocks, so what is left of it is never copied."""
    view, at = memoryview(data), 0
    while at < len(data):
        start, z, parts = at, zlib.decompressobj(31), []
        try:
            while at < len(data) and not z.eof:
                block = view[at : at + READ_BYTES]
                parts.append(z.decompress(block))
                at += len(block) - len(z.unused_data)
            error = None if z.eof else "a gzip member is cut off"
        except zlib.error as e:
            error = f"not a gzip member: {e}"
        if error is None:
            yield b"".join(parts), None
        else:
            yield None, error
            at = data.find(GZIP_MAGIC, start + 1)
            at = len(data) if at < 0 else at


def _finish(row: dict, block: bytes) -> dict:
    """Decode a whole record block into the fields of its row."""
    try:
        if row["kind"] == "revisit":
            size = re.search(rb"(?im)^content-length:\s*(\d+)", block)
            return row | {"payload_bytes": int(size[1]) if size else None, "payload_digest": row["declared"]}
        payload = payload_of(block)
        digest = hashlib.sha256(payload).hexdigest()
        wrong = "the payload digest differs" if row["declared"] not in (None, digest) else None
        return row | {"payload_bytes": len(payload), "payload_digest": digest, "error": wrong}
    except ValueError as e:
        return row | {"error": str(e)}


def parse_record(raw: bytes) -> dict:
    """A record's fields; what cannot be read is named in ``error``."""
    blank = dict.fromkeys(f.name for f in RECORDS)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    h = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    origin = h.get("warc-segment-origin-id") or h.get("warc-record-id")
    row = blank | {
        "origin": origin, "kind": h.get("warc-type"), "uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to"),
        "declared": h.get("warc-payload-digest", "").removeprefix("sha256:") or None,
    }
    if not lines[0].startswith("WARC/") or not origin or not row["kind"]:
        return row | {"origin": None, "error": "no WARC record, or one without type or id"}
    try:
        size = int(h["content-length"])
        number, total = (int(h[k]) if k in h else None for k in ("warc-segment-number", "warc-segment-total-length"))
    except (KeyError, ValueError) as e:
        return row | {"error": f"unusable header: {e}"}
    if not 0 <= size <= len(rest):
        return row | {"error": f"{len(rest)} bytes of a block of {size}"}
    if number is not None:
        return row | {"segment": number, "total": total, "block": rest[:size]}
    return _finish(row, rest[:size])


JOINED = record(payload_bytes=pa.int64(), payload_digest=pa.string(), error=pa.string())


@column_function(JOINED)
def reassemble(segments: pa.Array) -> pa.Array:
    """Segments of one record, sorted by number -> its payload's size and digest."""
    out = []
    for parts in segments:
        parts = parts.as_py() or []
        numbers, totals = [p["segment"] for p in parts], {p["total"] for p in parts} - {None}
        block = b"".join(p["block"] for p in parts)
        if not parts:
            out.append(None)
        elif numbers != list(range(1, len(parts) + 1)):
            out.append({"error": f"segments {numbers[:20]} are not consecutive"})
        elif totals != {len(block)}:
            out.append({"error": f"{len(block)} bytes in segments, {sorted(totals)} declared"})
        else:
            row = _finish({"kind": "response", "declared": next((p["declared"] for p in parts if p["declared"]), None)}, block)
            out.append({k: row.get(k) for k in ("payload_bytes", "payload_digest", "error")})
    return pa.array(out, JOINED)


def read_archives(archives: DataFrame, data_col: str = "data") -> DataFrame:
    """(record_id, kind, uri, refers_to, payload_bytes, payload_digest, error, copies): one row
    per logical record, and one without id for each place that holds none.

    copies: how many records in the archives start it."""

    def parse(batches):
        for batch in batches:
            for data in byte_rows(batch.column(0)):
                rows, size = [], 0
                for raw, error in members(data):
                    rows.append(parse_record(raw) if error is None else {"error": error})
                    size += len(rows[-1].get("block") or b"") + 200
                    if size > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(RECORDS))
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, pa.schema(RECORDS))

    ddl = "origin string, segment int, total long, kind string, uri string, refers_to string, declared string, payload_bytes long, payload_digest string, block binary, error string"
    rows = archives.select(data_col).mapInArrow(parse, ddl)
    piece = F.when(F.col("segment").isNotNull(), F.struct("segment", "total", "declared", "block"))
    is_head = ~F.col("kind").eqNullSafe(F.lit("continuation"))
    head = [F.max(F.when(is_head, F.col(c))).alias(c) for c in ("kind", "uri", "refers_to", "payload_bytes", "payload_digest", "error")]
    # What has no id is a row of its own.
    group = F.coalesce("origin", F.concat(F.lit("?"), F.monotonically_increasing_id().cast("string")))
    joined = rows.groupBy(group.alias("group")).agg(F.max("origin").alias("record_id"), *head, F.count_if(is_head).alias("copies"), F.array_sort(F.collect_set(piece)).alias("parts"))
    either = [F.coalesce(f"j.{c}", c).alias(c) for c in ("payload_bytes", "payload_digest", "error")]
    return joined.withColumn("j", reassemble("parts")).select("record_id", "kind", "uri", "refers_to", *either, "copies")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stored(write_archives(read_table(spark, sf_dir, "pages")), "warc")
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)", 1)
    # A record whose first segment is lost has no start; it stays, with its error.
    rows = read_archives(archives).withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))))
    return rows.select(
        F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)', 1) as bigint)").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        F.when(F.col("refers_to").isNotNull(), page("refers_to").cast("long")).alias("refers_to"),
        "error",
    )
