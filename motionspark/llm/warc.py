"""Web archives (WARC 1.1): written with revisits, segments and chunked bodies; read back by reassembly.

``write_archives`` makes an HTTP response of every page, its body in chunked transfer framing, and cuts blocks of more
than ``segment_bytes`` into a first record and continuations.  ``read_archives`` undoes that: it groups continuation
records by WARC-Segment-Origin-ID, orders them by segment number, verifies the total length and decodes the framing.

Archives are gzip part files, which Spark reads whole and in order: a task goes through its file piece by piece, so
what it holds is one record, not a file.  Records end where their Content-Length says; a block that holds the mark of
a record itself is put together again.

Cases: a null html is an empty payload; a null url gives a record without a target; a null page_id ranks below all
others, so its record revisits a numbered one of the same payload, and where none is numbered all are responses.  Of
records with equal payloads all with the largest page_id are responses, also where rows are repeated; repeated rows
have one record identifier and come back as often as they went in.  Further columns are not archived.  On reading, a
record cut short, segments that are missing, doubled with different content or of another total length, broken chunks
and digests that differ are kept, with ``intact`` false.  An empty table gives an archive without records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motionspark.llm import shared

SEGMENT_BYTES = 8192  # longer blocks are cut
CHUNK_BYTES = 4096  # of the transfer framing, more in long bodies: no more than MOST_CHUNKS of them
MOST_CHUNKS = 16
REVISIT_BYTES = 1000  # shorter payloads are stored again
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MARK, CRLF, GAP = "WARC/1.", "\r\n", "\r\n\r\n"


def record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """An identifier that only leans on what the record holds: <urn:page:PAGE_ID:HASH>."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit("<urn:page:"), text(page_id), F.lit(":"), F.md5(F.concat_ws(" ", text(page_id), digest, text(url))), F.lit(">"))


def page_of(identifier: Column) -> Column:
    """The page_id in an identifier of ``record_id``; null if it has none."""
    return F.regexp_extract(identifier, r"^<urn:page:(-?\d+):", 1).try_cast("long")


def with_originals(pages: DataFrame) -> DataFrame:
    """Adds ``payload``, ``n_bytes``, ``sha1``, ``sha256`` and ``original``: what a revisit refers to, null for responses."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    digests = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256")
    )
    # Written out, so that the join below has a shuffle on each side and AQE can split a payload that very many pages share.
    largest = shared.keep(
        digests.where(F.col("n_bytes") >= REVISIT_BYTES)
        .groupBy("sha256")
        .agg(F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 AND first.page_id IS NOT NULL")
        .select(F.col("sha256").alias("same"), "first"),
        "payloads",
    )
    joined = digests.join(largest, F.col("sha256") == F.col("same"), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    original = F.when(again, record_id(F.col("first.page_id"), F.col("first.url"), F.col("sha256")))
    return joined.select(*digests.columns, original.alias("original"))


def chunked(payload: Column, n_bytes: Column) -> Column:
    """The payload in chunked transfer framing, as a string of raw bytes."""
    size = F.greatest(F.lit(CHUNK_BYTES), F.ceil(n_bytes / MOST_CHUNKS)).cast("int")
    starts = F.when(n_bytes > 0, F.sequence(F.lit(0), n_bytes.cast("int") - 1, size)).otherwise(F.array().cast("array<int>"))
    chunk = lambda o: F.concat(F.lower(F.hex(F.least(size, n_bytes.cast("int") - o))), F.lit(CRLF), F.substring(payload, o + 1, size).cast("string"), F.lit(CRLF))
    return F.concat(F.array_join(F.transform(starts, chunk), ""), F.lit("0" + GAP))


def headers(pairs: list[tuple[str, Column]]) -> Column:
    """Header lines; those with a null value are left out."""
    return F.concat_ws(CRLF, *(F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in pairs))


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """One response or revisit for each row of (page_id, url, html), in gzip archives under ``path``."""
    rows = with_originals(pages)
    revisit = F.col("original").isNotNull()
    web = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n")
    block = F.when(revisit, F.concat(web, F.lit("Content-Length: "), F.col("n_bytes"), F.lit(GAP))).otherwise(
        F.concat(web, F.lit("Transfer-Encoding: chunked" + GAP), chunked(F.col("payload"), F.col("n_bytes")))
    )
    rows = rows.select(
        record_id(F.col("page_id"), F.col("url"), F.col("sha256")).alias("id"), "page_id", "url", "sha1", "original", block.cast("binary").alias("block")
    ).withColumn("total", F.octet_length("block").cast("long"))
    last = F.floor((F.col("total") - 1) / segment_bytes).cast("int")
    rows = rows.select("*", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("k"))
    part = F.substring("block", F.col("k") * segment_bytes + 1, F.lit(segment_bytes))
    first, cut = F.col("k") == 0, F.col("last") > 0
    own = F.when(first, F.col("id")).otherwise(F.concat(F.expr("substring(id, 1, length(id) - 1)"), F.lit(":"), F.col("k") + 1, F.lit(">")))
    head = headers([
        ("WARC-Type", F.when(~first, "continuation").when(F.col("original").isNotNull(), "revisit").otherwise("response")),
        ("WARC-Record-ID", own),
        ("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        ("WARC-Page-ID", F.when(first, F.col("page_id"))),
        ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("sha1")))),
        ("WARC-Refers-To", F.when(first, F.col("original"))),
        ("WARC-Profile", F.when(first & F.col("original").isNotNull(), IDENTICAL)),
        ("WARC-Segment-Number", F.when(cut, F.col("k") + 1)),
        ("WARC-Segment-Origin-ID", F.when(~first, F.col("id"))),
        ("WARC-Segment-Total-Length", F.when(cut & (F.col("k") == F.col("last")), F.col("total"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(part)),
    ])
    text = F.concat(F.lit(f"{MARK}1{CRLF}"), head, F.lit(GAP), part.cast("string"))
    rows.select(text.alias("value")).write.option("lineSep", GAP).option("compression", "gzip").text(path)


def parse_head(head: bytes) -> dict[str, str]:
    """Header lines below the first line -> values by lower-case name; of repeated names the last counts."""
    found = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            found[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return found


def split_records(pieces: Iterable[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(file, text between two marks) in order -> (headers, block, whether the block is as long as its head says)."""
    file, open_record, body, end = None, None, -1, -1

    def cut_short():
        head, _, block = bytes(open_record).partition(b"\r\n\r\n")
        return parse_head(head), block, False

    for name, piece in pieces:
        if name != file:  # what stands before a file's first mark belongs to no record
            if open_record is not None:
                yield cut_short()
            file, open_record = name, None
            continue
        if open_record is None:
            open_record, body, end = bytearray(piece), -1, -1
        else:  # a mark inside a block
            open_record += MARK.encode() + piece
        if body < 0 and (at := open_record.find(b"\r\n\r\n")) >= 0:
            body, found = at + 4, parse_head(bytes(open_record[:at]))
            length = found.get("content-length", "")
            end = body + int(length) if length.isdigit() else -1
        if 0 <= body and end < 0:  # no length given: up to the next mark
            yield cut_short()
            open_record = None
        elif 0 <= end <= len(open_record):
            yield found, bytes(open_record[body:end]), True
            open_record = None
    if open_record is not None:
        yield cut_short()


def dechunk(body: bytes) -> tuple[bytes, bool]:
    """The content of a chunked body, and whether its framing is whole."""
    parts, at = [], 0
    while (eol := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:eol].partition(b";")[0], 16)
        except ValueError:
            break
        if size == 0:
            return b"".join(parts), True
        parts.append(body[eol + 2 : eol + 2 + size])
        at = eol + 4 + size
        if size < 0 or len(parts[-1]) < size or body[at - 2 : at] != b"\r\n":
            break
    return b"".join(parts), False


def decode(found: dict[str, str], block: bytes, intact: bool) -> tuple:
    """A row of PAYLOADS from a whole record."""
    head, _, body = block.partition(b"\r\n\r\n")
    web = parse_head(head) if head.startswith(b"HTTP/") else {}
    if not web:
        body = block
    elif web.get("transfer-encoding", "").lower() == "chunked":
        body, framed = dechunk(body)
        intact &= framed
    kind, digest = found.get("warc-type"), found.get("warc-payload-digest", "")
    sha1 = None
    if kind == "revisit":  # the payload stands in the record that it refers to
        body = None
    else:
        sha1 = hashlib.sha1(body).hexdigest()
        if digest.startswith("sha1:") and len(digest) == 45:
            intact &= digest[5:].lower() == sha1
    return kind, found.get("warc-record-id"), list(found.items()), list(web.items()), body, sha1, intact


MAP = pa.map_(pa.string(), pa.string())
PAYLOADS = "record_type string, record_id string, headers map<string,string>, http_headers map<string,string>, payload binary, payload_sha1 string, intact boolean"
PAYLOAD_TYPES = [pa.string(), pa.string(), MAP, MAP, pa.binary(), pa.string(), pa.bool_()]
SEGMENTS = "origin string, number int, total long, headers map<string,string>, block binary, whole boolean"
SEGMENT_TYPES = [pa.string(), pa.int32(), pa.int64(), MAP, pa.binary(), pa.bool_()]
BATCH_BYTES, BATCH_ROWS = 4_000_000, 2000


def batches(rows: Iterable[tuple], schema: str, types: list, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of a bounded number of bytes, a single long row aside."""
    names = [c.split()[0] for c in schema.split(", ")]
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _records(given: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    return split_records(x for b in given for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))


def _number(found: dict[str, str]) -> int | None:
    """The segment number; a number that cannot be read counts as none."""
    value = found.get("warc-segment-number", "")
    return int(value) if value.isdigit() and len(value) < 10 else None


def _unsegmented(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (decode(*r) for r in _records(given) if _number(r[0]) is None)
    return batches(rows, PAYLOADS, PAYLOAD_TYPES, lambda r: len(r[4] or b""))


def _segments(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for found, block, whole in _records(given):
            if (number := _number(found)) is not None:
                origin = found.get("warc-segment-origin-id") if number > 1 else found.get("warc-record-id")
                total = found.get("warc-segment-total-length", "")
                yield origin, number, int(total) if total.isdigit() and len(total) < 19 else None, list(found.items()), block, whole

    return batches(rows(), SEGMENTS, SEGMENT_TYPES, lambda r: len(r[4]))


def _reassembled(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (decode(dict(h or []), block, whole) for b in given for h, block, whole in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return batches(rows, PAYLOADS, PAYLOAD_TYPES, lambda r: len(r[4] or b""))


def reassemble(segments: DataFrame) -> DataFrame:
    """SEGMENTS -> (headers, block, whole): the segments of each origin in the order of their numbers, as often as its first one is there."""
    grouped = segments.groupBy("origin").agg(
        F.sort_array(F.collect_set(F.struct("number", F.col("block").cast("string").alias("block")))).alias("parts"),
        F.max("total").alias("total"),
        F.min("total").alias("least_total"),
        F.first(F.when(F.col("number") == 1, F.col("headers")), ignorenulls=True).alias("headers"),
        F.count_if(F.col("number") == 1).alias("copies"),
        F.bool_and("whole").alias("whole"),
    )
    block = F.array_join(F.transform("parts", lambda p: p["block"]), "").cast("binary")
    joined = grouped.withColumn("block", block)
    numbered = F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1), F.size("parts"))
    whole = F.col("whole") & numbered & (F.col("total") == F.octet_length("block")) & (F.col("least_total") == F.col("total"))
    return joined.select(
        F.coalesce("headers", F.create_map(F.lit("warc-type"), F.lit("continuation"), F.lit("warc-record-id"), "origin")).alias("headers"),
        "block",
        F.coalesce(whole, F.lit(False)).alias("whole"),
        F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))).alias("copy"),
    ).drop("copy")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the gzip archives under ``path`` with its decoded payload, segmented ones as one row.

    A file is read twice, for records that stand alone and for segments, so that only segments are shuffled.
    """
    pieces = spark.read.option("lineSep", MARK).text(path).select("_metadata.file_path", F.col("value").cast("binary").alias("value"))
    alone = pieces.mapInArrow(_unsegmented, PAYLOADS)
    joined = reassemble(pieces.mapInArrow(_segments, SEGMENTS))
    return alone.unionByName(joined.mapInArrow(_reassembled, PAYLOADS))


def page_records(records: DataFrame) -> DataFrame:
    """Of ``read_archives``: page_id, length and digest of the full payload, record type and the page that a revisit refers to.

    A revisit's length and digest are those that its own headers state.
    """
    again = F.col("record_type") == "revisit"
    return records.where(F.col("record_type").isin("response", "revisit")).select(
        F.col("headers")["warc-page-id"].cast("long").alias("page_id"),
        F.when(again, F.col("http_headers")["content-length"].cast("long")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(again, F.substring(F.col("headers")["warc-payload-digest"], 6, 40)).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        "record_type",
        page_of(F.col("headers")["warc-refers-to"]).alias("refers_to"),
        "intact",
    )
