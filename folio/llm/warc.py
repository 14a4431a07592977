"""WARC archives: records written by Spark's own text sink, read back whole, assembled into captures.

Each page gives three records: a request, a response (or a revisit of the response that has an equal
payload) and a metadata record. Request and metadata name the response or revisit in
WARC-Concurrent-To. Two CRLF end a record, so a record per row and that line separator make valid
gzipped archives, and Spark's commit protocol guards them against lost executors.

Reading assembles transactions: every record is joined to its capture's anchor (response, revisit or
resource) over the concurrent-to identifiers, whichever of the two records names the other, also by
way of a third one, and each anchor gives one nested row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import scratch, small_batches, written

#: Bytes of an archive before compression that a file should hold.
FILE_BYTES = 32 << 20
#: Bytes that a reader inflates at a time.
PIECE = 1 << 20
#: Bytes of the table of repeated payloads up to which it is broadcast (about 100 bytes a row).
BROADCAST_BYTES = 8 << 20
#: Keys that a response's row is copied to for the join with its revisits.
SALTS = 16
ANCHORS = ("response", "revisit", "resource")
DATE = "2024-01-01T00:00:00Z"

_RECORDS = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to_id", pa.string()), ("target_uri", pa.string()),
     ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.string())]
)
RECORD_SCHEMA = "record_id string, record_type string, concurrent_to array<string>, refers_to_id string, target_uri string, payload_digest string, payload_bytes long, headers map<string,string>, block string"


# ------------------------------------------------------------------ writing
def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, __html not null) with __sha1 (hex), __bytes, __refers and __is_revisit.

    Of equal payloads of at least ``min_bytes``, the row with the smallest page_id is the response;
    rows that tie on it are told apart by url, then arbitrarily.
    """
    spark = pages.sparkSession
    keyed = pages.withColumn("__sha1", F.sha1(F.col("__html").cast("binary"))).withColumn("__bytes", F.octet_length("__html").cast("long"))
    per = keyed.where(F.col("__bytes") >= min_bytes).groupBy("__sha1").agg(
        F.count("*").alias("__n"), F.min(F.struct("page_id")).alias("__first"), F.min_by(F.struct("url"), F.struct("page_id", "url")).alias("__first_url")
    )
    repeated = written(per.where("__n > 1"), "repeated")
    n = repeated.count()
    side = F.broadcast(repeated) if n * 100 <= BROADCAST_BYTES else repeated
    joined = keyed.join(side, "__sha1", "left")
    first = F.struct("page_id").eqNullSafe(F.col("__first")) & F.struct("url").eqNullSafe(F.col("__first_url"))
    joined = joined.withColumn("__leads", F.col("__n").isNull() | F.coalesce(first, F.lit(False)))
    if n:
        # Rows repeated with id, url and payload can't be told apart by value: they get numbers, and the least leads.
        leaders = F.col("__n").isNotNull() & F.col("__leads")
        twice = joined.where(leaders).groupBy("__sha1").agg(F.count("*").alias("__m")).where("__m > 1")
        if twice.limit(1).count():
            joined = written(joined.withColumn("__row", F.monotonically_increasing_id()), "tied-pages")
            least = joined.where(leaders).groupBy("__sha1").agg(F.min("__row").alias("__row")).select("__row", F.lit(True).alias("__first_row"))
            joined = joined.join(least, "__row", "left").withColumn("__leads", F.col("__n").isNull() | F.coalesce("__first_row", F.lit(False))).drop("__row", "__first_row")
    return joined.withColumn("__revisit", ~F.col("__leads")).drop("__n", "__first_url", "__leads")


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(name.encode()).digest(), version=4)}>"


def _record(kind: str, record_id: str, block: str, headers: list[tuple[str, str]]) -> str:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block.encode())))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n" + block


def _safe(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def records_of(page_id: int | None, url: str | None, html: str, revisit: bool, sha1_hex: str, tag: str, unique: bool) -> Iterator[str]:
    """The records of a page. ``unique``: the payload has one response only, whose id its digest gives."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    own = _urn(f"{tag}-revisit") if revisit else _urn(f"response-{sha1_hex}" if unique else f"{tag}-response")
    target = [("WARC-Target-URI", _safe(url))] if url else []
    size = len(html.encode())
    if revisit:
        http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        extra = [("WARC-Refers-To", _urn(f"response-{sha1_hex}")), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    else:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n{html}"
        extra = []
    host = re.match(r"[a-z]+://([^/?#]*)", url or "")
    yield _record("request", _urn(f"{tag}-request"), f"GET {_safe(url) or '/'} HTTP/1.1\r\nHost: {host[1] if host else ''}\r\n\r\n", [*target, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")])
    yield _record("revisit" if revisit else "response", own, http, [*target, *extra, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")])
    yield _record("metadata", _urn(f"{tag}-metadata"), ("" if page_id is None else f"page_id: {page_id}\r\n") + f"payload_bytes: {size}\r\n", [*target, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write ``pages`` as gzipped WARC files below ``path``; a null payload is an empty one.

    Files hold about FILE_BYTES: pages are grouped by their size, and each group gets as many rows a
    file as fit. A page larger than that has a file of its own. Each of at most four groups reads the
    pages for itself, so that their text is not written twice.
    """
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("__html"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = uuid.uuid4().hex  # ids of rows other than responses need only be unique
        n = 0
        for b in batches:
            out = []
            for page_id, url, html, revisit, sha1, size in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "__html", "__revisit", "__sha1", "__bytes")), strict=True):
                n += 1
                out.extend(records_of(page_id, url, html, revisit, sha1, f"{run}-{n}", size >= min_bytes))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    decided = decide(source, min_bytes)
    small_batches(pages.sparkSession, 200)
    large = source.agg(F.max(F.octet_length("__html")).cast("long")).first()[0] or 0
    bounds = [1 << 16, 1 << 20, 1 << 24, large + 1]
    low = 0
    for high in bounds:
        if low > large:
            break
        part = decided.where((F.col("__bytes") >= low) & (F.col("__bytes") < max(high, low + 1))) if large >= bounds[0] else decided
        rows = max(1, FILE_BYTES // max(1024, min(high, large + 1024)))
        (
            part.select("page_id", "url", "__html", "__revisit", "__sha1", "__bytes")
            .mapInArrow(render, "value string")
            .write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 3 * rows).text(path)
        )
        if large < bounds[0]:
            break
        low = high


# ------------------------------------------------------------------ reading
def plain_pieces(data: bytes) -> Iterator[bytes]:
    """A file's bytes in pieces, inflated if it is gzipped; a broken member ends it."""
    if data[:2] != b"\x1f\x8b":
        for i in range(0, len(data), PIECE):
            yield data[i : i + PIECE]
        return
    at, one, rest = 0, zlib.decompressobj(31), b""
    while rest or at < len(data):
        if not rest:
            rest, at = data[at : at + PIECE], at + PIECE
        try:
            piece = one.decompress(rest, PIECE)
        except zlib.error:
            return
        if piece:
            yield piece
        rest = one.unconsumed_tail
        if one.eof:
            rest, one = one.unused_data, zlib.decompressobj(31)
    if tail := one.flush():
        yield tail


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record; repeated headers are joined by newlines.

    Reads plain archives and gzipped ones of one or many members, piece by piece: besides the file as
    it is, no more than a record and a piece are held. What isn't a record is skipped up to the next
    version line; a record that the file's end cuts short is left out.
    """
    pieces = plain_pieces(data)
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    at = 0
    while True:
        while (start := held.find(b"WARC/", at)) < 0:
            del held[: max(0, len(held) - 4)]
            at = 0
            if not more():
                return
        end = -1
        seen = start
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(start, len(held) - 3)
            if not more():
                return
        headers: dict[str, str] = {}
        for line in held[start:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:
                name, value = name.strip().lower(), value.strip()
                headers[name] = f"{headers[name]}\n{value}" if name in headers else value
        if not headers.get("content-length", "").isdigit():
            at = end
            continue
        size = int(headers["content-length"])
        while end + 4 + size > len(held):
            if not more():
                return
        yield headers, bytes(held[end + 4 : end + 4 + size])
        at = end + 4 + size
        if at > PIECE:
            del held[:at]
            at = 0


def read_records(spark: SparkSession, path: str, keep_blocks: bool = True) -> DataFrame:
    """The records of the archives below ``path``. payload_digest and payload_bytes of a response are
    computed from its block (those of a revisit are what its header states)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for blob in b.column("content"):
                for h, block in parse_archive(blob.as_buffer().to_pybytes()):
                    kind = h.get("warc-type", "")
                    digest, size = h.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2] if "application/http" in h.get("content-type", "") else block
                        digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                    to = [x.strip() for x in h.get("warc-concurrent-to", "").split("\n") if x.strip()]
                    text = block.decode("utf-8", "replace") if keep_blocks or kind == "metadata" else None
                    rows.append((h.get("warc-record-id"), kind, to, h.get("warc-refers-to"), h.get("warc-target-uri"), digest, size, list(h.items()), text))
                    held += len(text or "")
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: the anchor's columns, and its other records nested by type.

    A record is concurrent to another if either names the other. Records that no anchor reaches in
    two steps are left out. Repeated records of one type are kept in an array, ordered by id.
    """
    anchor = F.col("record_type").isin(*ANCHORS)
    anchors, others = records.where(anchor), records.where(~anchor)
    names = records.where(F.size("concurrent_to") > 0).select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    ids = anchors.select(F.col("record_id").alias("anchor_id"))
    # One step: the record names the anchor, or the anchor names the record.
    forward = names.join(ids, F.col("b") == F.col("anchor_id"), "left_semi").select(F.col("a").alias("record_id"), F.col("b").alias("anchor_id"))
    back = anchors.where(F.size("concurrent_to") > 0).select(F.col("record_id").alias("anchor_id"), F.explode("concurrent_to").alias("record_id")).select("record_id", "anchor_id")
    near = forward.unionByName(back)
    # Two steps: by way of a record that is one step from the anchor, whichever of the two names the other.
    named = others.where(F.size("concurrent_to") > 0).select("record_id", F.explode("concurrent_to").alias("other")).join(ids, F.col("other") == F.col("anchor_id"), "left_anti")
    pairs = F.explode(F.array(F.struct(F.col("record_id").alias("r"), F.col("other").alias("via")), F.struct(F.col("other").alias("r"), F.col("record_id").alias("via")))).alias("p")
    far = named.select(pairs).select("p.r", "p.via").join(near, F.col("via") == F.col("record_id")).select(F.col("r").alias("record_id"), "anchor_id")
    links = near.unionByName(far).distinct()
    nested = F.struct("record_id", "record_type", "target_uri", "block")
    satellites = (
        others.join(links, "record_id").groupBy("anchor_id").agg(F.array_sort(F.collect_list(nested)).alias("__all"))
        .select(F.col("anchor_id").alias("record_id"), F.filter("__all", lambda r: r["record_type"] == "request").alias("requests"),
                F.filter("__all", lambda r: r["record_type"] == "metadata").alias("metadata"),
                F.filter("__all", lambda r: ~r["record_type"].isin("request", "metadata")).alias("other"))
    )
    return anchors.join(satellites, "record_id", "left")


def page_captures(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of captures that ``write_archives`` wrote."""
    def field(name: str):
        return F.expr(f"try_cast(nullif(regexp_extract(metadata[0].block, '(?m)^{name}: (-?[0-9]+)', 1), '') as bigint)")

    slim = captures.select("record_id", "record_type", "payload_digest", "refers_to_id", field("page_id").alias("page_id"), field("payload_bytes").alias("__stated"), "payload_bytes")
    # One response may be what a third of all captures revisit: its row is copied to SALTS keys, its revisits dealt to them.
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    targets = slim.where(F.col("record_type") == "response").select(F.col("record_id").alias("__rid"), F.col("page_id").alias("__rpage"))
    wanted = slim.where(F.col("record_type") == "revisit").select(F.col("refers_to_id").alias("__rid")).distinct()
    targets = targets.join(wanted, "__rid", "left_semi").withColumn("__salt", salts)
    revisits = slim.where(F.col("record_type") == "revisit").withColumn("__salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    found = revisits.join(targets, (F.col("refers_to_id") == F.col("__rid")) & (revisits["__salt"] == targets["__salt"]), "left")
    kept = ("page_id", F.coalesce("payload_bytes", "__stated").alias("payload_bytes"), "payload_digest", "record_type")
    return slim.where(F.col("record_type") != "revisit").select(*kept, F.lit(None).cast("long").alias("refers_to")).unionByName(found.select(*kept, F.col("__rpage").alias("refers_to")))


def warc_roundtrip(pages: DataFrame, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back and assemble the captures.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to. A null payload
    is an empty one; a null id stays null and comes first among equal payloads; rows repeated as a whole
    are pages of their own, one of them the response. An empty table gives an empty result; other
    columns are not read.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, min_bytes=min_bytes, **columns)
    slim = written(read_records(spark, path, keep_blocks=False), "warc-index")
    return page_captures(written(assemble(slim), "warc-captures"))
