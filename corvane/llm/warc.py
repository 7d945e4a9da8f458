"""WARC archives: writing with segmented records, reading with reassembly.

A page's HTTP response is framed with chunked transfer coding. A block longer
than the segment size is written as a first record and continuation records,
which carry the origin's identifier, their number and, on the last, the total
length. The reader groups continuation records by the origin identifier,
orders them by segment number, verifies that none is missing and that the
total length holds, and then decodes the chunked framing. Of records with
equal payloads, all but one are revisit records that refer to it.

What cannot be read does not end a job: a record that is cut off or malformed,
a payload that does not have its digest or chunk framing, and a group of
segments that is incomplete each give a row of type ``broken`` that says why;
reading goes on at the next record.

Archives are bounded images of standard records (WARC/1.1), stored by Spark's
writer, one row each, because executors cannot open the cluster's file system.
``read_archives`` also takes the rows of Spark's binaryFile source, plain or
gzipped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, text_column

ARCHIVE_BYTES, SEGMENT_BYTES, CHUNK_BYTES = 4 << 20, 32 << 10, 8 << 10
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # for URLs, RFC 4122
RECORD = "record_type string, record_id string, page_id long, url string, payload_digest string, payload_bytes long, refers_to_id string, origin_id string, segment int, total_length long, block binary, problem string"
#: Compressed bytes inflated at a time.
INFLATE_BYTES = 64 << 10
MARK = re.compile(rb"WARC/1\.[01]\r\n")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str, digest: str) -> str:
    """The same after a retry: derived from the page, not drawn."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}|{url}|{digest}')}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            raise ValueError("broken chunk")
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + n


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?mi)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r\n", b"\n")) else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_records(page_id: int | None, url: str | None, payload: bytes, first_id: int | None, first_url: str | None, revisit: bool, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of a page: one revisit, or one response and its continuations."""
    digest = digest32(payload)
    clean = lambda u: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", u or "")
    own = record_id(page_id, url or "", digest)
    base = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id)]
    kind = ("Content-Type", "application/http;msgtype=response")
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        refers = record_id(first_id, first_url or "", digest)
        return [_record([("WARC-Type", "revisit"), *base, ("WARC-Profile", profile), ("WARC-Refers-To", refers), kind], head + b"\r\n")]
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return [_record([("WARC-Type", "response"), *base, kind], block)]
    out = [_record([("WARC-Type", "response"), *base, ("WARC-Segment-Number", 1), kind], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        last = len(block) if k == len(parts) else None
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{own}|{k}')}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", last)]
        out.append(_record(fields, part))
    return out


def inflated(data: bytes) -> bytes:
    """All gzip members of an archive, one after the other; of a member that is cut off or broken, and
    of what follows it, as much as can be had. Each compressed byte is read once."""
    parts, at, view = [], 0, memoryview(data)
    while at < len(data):
        one = zlib.decompressobj(31)
        try:
            while at < len(data) and not one.eof:
                piece = view[at : at + INFLATE_BYTES]
                parts.append(one.decompress(piece))
                at += len(piece) - len(one.unused_data)
        except zlib.error:
            break
    return b"".join(parts)


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Headers (lower-case names), block and problem of each record of an archive, plain or gzipped
    member by member. After a problem reading goes on at the next line that opens a record."""
    if data[:2] == b"\x1f\x8b":
        data = inflated(data)
    at = 0
    while at < len(data):
        end, fields, problem, n = data.find(b"\r\n\r\n", at), {}, None, 0
        if not MARK.match(data, at):
            problem = "not a record"
        elif end < 0:
            problem = "headers are cut off"
        else:
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            size = fields.get("content-length", "")
            if not re.fullmatch("[0-9]{1,18}", size):
                problem = "no length"
            elif len(data) < end + 4 + (n := int(size)):
                problem = "block is cut off"
        if problem is None:
            yield fields, data[end + 4 : end + 4 + n], None
            at = end + 4 + n + 4
        else:
            yield fields, b"", problem
            following = MARK.search(data, at + 1)
            at = following.start() if following else len(data)


def write_archives(pages: DataFrame, out: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to archives in ``out``.

    Null html is an empty payload. Of rows with equal payloads of at least
    ``min_bytes`` bytes, that with the smallest page_id is the response (its
    repeated rows too), the others revisit it. Rows with a null page_id are
    responses unless their payload has another row. Pages of any length are
    written whole; other columns are not read.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.encode(text_column(pages, "html"), "UTF-8").alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    # Digests are aggregated without the payloads, which move once, to meet their group's first row.
    firsts = rows.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.min(F.struct("page_id", "url")).alias("all"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")).select("sha", F.coalesce("first", "all").alias("first"), F.lit(True).alias("shared"))
    firsts = materialize(firsts, "warc-firsts")  # a join of written tables splits hot keys
    marked = rows.join(firsts, "sha", "left").select("page_id", "url", "payload", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), (F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, k, held, size = f"part-{TaskContext.get().partitionId():06d}", 0, [], 0

        def image() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{name}-{k:06d}.warc"]), pa.array([b"".join(held)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                for record in page_records(*row):
                    held.append(record)
                    size += len(record)
                    if size >= archive_bytes:
                        yield image()
                        k, held, size = k + 1, [], 0
        if held:
            yield image()

    marked.mapInArrow(run, "archive string, content binary").write.mode("overwrite").parquet(out)


def _number(x: str | None, bits: int = 63) -> int | None:
    return int(x) if x and re.fullmatch("-?[0-9]{1,18}", x) and abs(int(x)) < 1 << bits else None


def _complete(digest: str | None, block: bytes, with_payload: bool) -> tuple[str | None, int | None, bytes | None, str | None]:
    """Digest, length and payload of a whole block, and what is wrong with it."""
    try:
        payload = payload_of(block)
    except ValueError as e:
        return digest, None, None, str(e)
    found = digest32(payload)
    if digest not in (None, found):
        return digest, None, None, "payload digest does not hold"
    return found, len(payload), payload if with_payload else None, None


def parse_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Rows of RECORD for every record. Unsegmented responses are decoded at once, their
    ``block`` is the payload if asked for; segments keep their raw block. Records that cannot be
    read are of type ``broken``, ``problem`` says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for f, block, problem in records_of(data or b""):
                    kind, own, segment = f.get("warc-type"), f.get("warc-record-id"), _number(f.get("warc-segment-number"), 31)
                    digest, n = f.get("warc-payload-digest", "").removeprefix("sha1:") or None, None
                    if problem is None and (kind is None or own is None):
                        problem = "no type or identifier"
                    if problem is None and kind == "response" and segment is None:
                        digest, n, block, problem = _complete(digest, block, with_payload)
                    elif kind == "revisit" or problem is not None:
                        block = None
                    kind = kind if problem is None else "broken"
                    rows.append((kind, own, _number(f.get("x-page-id")), f.get("warc-target-uri"), digest, n, f.get("warc-refers-to"), f.get("warc-segment-origin-id", own if segment else None), segment, _number(f.get("warc-segment-total-length")), block, problem))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return archives.select("content").mapInArrow(run, RECORD)


def _reassembled(segments: DataFrame, with_payload: bool) -> DataFrame:
    """Whole responses from their segments. The segments of an origin are bounded by one page. A
    group that lacks a segment or has another total length is ``broken``."""
    heads = F.max(F.when(F.col("segment") == 1, F.struct("page_id", "url", "payload_digest")))
    groups = segments.groupBy("origin_id").agg(
        heads.alias("head"),
        F.sum(F.when(F.col("segment") == 1, 1).otherwise(0)).alias("copies"),
        F.max("total_length").alias("total_length"),
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts"),
    )
    flat = groups.select("origin_id", "head.page_id", "head.url", "head.payload_digest", "copies", "total_length", F.col("parts.segment").alias("numbers"), F.col("parts.block").alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, page, url, digest, copies, total, numbers, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = b"".join(blocks)
                if numbers != list(range(1, len(numbers) + 1)) or total != len(block):
                    rows.append(("broken", own, page, url, digest, None, None, "segments are incomplete"))
                    continue
                digest, n, payload, problem = _complete(digest, block, with_payload)
                rows += [("response" if problem is None else "broken", own, page, url, digest, n, payload, problem)] * copies  # repeated rows share their records
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["record_type", "record_id", "page_id", "url", "payload_digest", "payload_bytes", "payload", "problem"])

    return flat.mapInArrow(run, "record_type string, record_id string, page_id long, url string, payload_digest string, payload_bytes long, payload binary, problem string")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Pages from archives (a column ``content``, null as empty): page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, problem and, if asked for, payload (null for revisits).

    Records of other types than response, continuation and revisit are left out.
    Broken records and groups have record_type ``broken``, the columns that
    could be read, and no length; those of a continuation stand for its group
    as well. A revisit of a record that is not there refers to null.
    """
    parsed = materialize(parse_archives(archives, with_payload), "warc-records")
    names = ["record_type", "record_id", "page_id", "url", "payload_digest", "payload_bytes"]
    whole = parsed.where("record_type = 'broken' OR (record_type = 'response' AND segment IS NULL)").select(*names, F.col("block").alias("payload"), "problem")
    pieces = parsed.where("record_type IN ('response', 'continuation') AND segment IS NOT NULL AND origin_id IS NOT NULL")
    responses = materialize(whole.unionByName(_reassembled(pieces, with_payload)), "warc-responses")
    known = responses.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("payload_bytes"))
    known = materialize(known, "warc-known")
    revisits = parsed.where("record_type = 'revisit'").drop("payload_bytes").join(known, "refers_to_id", "left")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem", *["payload"] * with_payload]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(revisits.withColumn("payload", F.lit(None).cast("binary")).select(*columns))
