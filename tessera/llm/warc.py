"""Web archives: write, normalise a whole-file gzip into one member per record, index, read back.

A capture is first written as *monolithic* archives: many WARC records inside one gzip stream, which
no reader can enter in the middle. The normaliser inflates each such stream once, front to back, and
rewrites every record as its own gzip member with a sidecar index of (record, offset, length).
While it rewrites, records whose payload another record already holds become ``revisit`` records.

Archives are rows of (archive_id, content): a few MB each, so that they can be written and read by any
executor through the shared folder and move between tasks in compressed form. Which record keeps its
payload is decided by a distributed aggregation over digests, never by one task that sees them all.

Defined cases: null or empty html is an empty payload; a null id or url is kept as null; of equal
payloads the record with the largest id (then archive and place) is the response; repeated rows are
records of their own; a very long text is one record, held as a whole by one task at a time; an empty
table gives empty archives tables; extra columns are ignored. Archives from elsewhere may have several
members, other kinds of records, which stay as they are, and headers in any spelling; each capture
is inflated twice, once to learn its digests and once to rewrite it, as what is a revisit depends on all.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import cut, drop_cut

CRLF, GZIP = b"\r\n", 31
ARCHIVE_BYTES = 4 << 20  # inflated size at which a new archive begins
NAMESPACE = uuid.UUID(int=0x7E55E2A)
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, block: bytes, record_id: str, fields: list[tuple[str, object]]) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/http;msgtype=response"), *fields]
    return _written(lines, block)


def _written(lines: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}\r\n" for k, v in [*lines, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block + CRLF * 2


def _head(data: bytes | bytearray, at: int) -> tuple[dict[str, str], int, int] | None:
    """Header fields of the record at ``at``, and where its block starts and stops; None if the header isn't all there.

    A line that starts with white space goes on with the field before it."""
    if not data.startswith(b"WARC/"[: len(data) - at], at):
        raise ValueError("not a WARC record")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    head: dict[str, str] = {}
    name = ""
    for line in bytes(data[at:end]).decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            head[name] = f"{head[name]} {line.strip()}"
            continue
        name, _, value = line.partition(":")
        head[name] = value.strip()
    return head, end + 4, end + 4 + int(head["Content-Length"])


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int] | None:
    """Header fields, block and end of the record that starts at ``at``; None if it isn't all there."""
    found = _head(data, at)
    return (found[0], bytes(data[found[1] : found[2]]), found[2] + 4) if found and len(data) >= found[2] + 4 else None


def _payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def _inflated(content: bytes, step: int = 1 << 16, most: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of at most ``most`` bytes of all gzip members of ``content``, one after the other; zero bytes after them are padding."""
    stream, begun = zlib.decompressobj(GZIP), False
    for lo in range(0, len(content), step):
        piece = content[lo : lo + step]
        while piece:
            if not begun and not (piece := piece.lstrip(b"\0")):
                break
            begun = True
            yield stream.decompress(piece, most)
            if stream.eof:
                piece, stream, begun = stream.unused_data, zlib.decompressobj(GZIP), False
            else:
                piece = stream.unconsumed_tail
    while begun and (more := stream.decompress(b"", most)):
        yield more
    if begun and not stream.eof:
        raise ValueError("the stream ends inside a member")


def inflate_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a whole-file gzip stream of one or more members, inflated once and in order; holds one record at a time.

    Bytes are appended to one buffer and a header is read once, so the time grows with the bytes, however long a record is."""
    held, known = bytearray(), None
    for piece in _inflated(content):
        held += piece
        at = 0
        while True:
            known = known or (_head(held, at) if len(held) > at else None)
            if not known or len(held) < known[2] + 4:
                break
            head, start, stop = known
            yield head, bytes(held[start:stop])
            at, known = stop + 4, None
        if at:
            del held[:at]
            known = known and (known[0], known[1] - at, known[2] - at)
    if held:
        raise ValueError("the stream ends inside a record")


def write_monolithic(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 1) -> DataFrame:
    """Archives (archive_id, content) that each hold many response records in one gzip stream."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, n, size = TaskContext.get().partitionId(), 0, 0, 0
        gz, out = zlib.compressobj(level, zlib.DEFLATED, GZIP), []
        for batch in batches:
            for ident, url, html in zip(batch["id"], batch["url"], batch["html"]):
                if size >= ARCHIVE_BYTES:
                    yield pd.DataFrame({"archive_id": [f"{part:06d}-{seq:06d}"], "content": [b"".join(out) + gz.flush()]})
                    gz, out, seq, n, size = zlib.compressobj(level, zlib.DEFLATED, GZIP), [], seq + 1, 0, 0
                body = (html or "").encode()
                fields = [("WARC-Target-URI", url), ("X-Page-Id", ident), ("X-Place", n), ("X-Payload-Length", len(body)), ("WARC-Payload-Digest", f"sha1:{digest(body)}")]
                record = _record("response", HTTP_HEAD + body, str(uuid.uuid5(NAMESPACE, f"{part}/{seq}/{n}")), fields)
                out.append(gz.compress(record))
                n, size = n + 1, size + len(record)
        if n:
            yield pd.DataFrame({"archive_id": [f"{part:06d}-{seq:06d}"], "content": [b"".join(out) + gz.flush()]})

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInPandas(work, "archive_id string, content binary")


def list_records(archives: DataFrame) -> DataFrame:
    """(archive_id, place, page_id, payload_bytes, payload_digest) of every response of monolithic archives."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["archive_id"], batch["content"]):
                rows = [(archive, k, h.get("X-Page-Id"), len(body := _payload(b)), digest(body)) for k, (h, b) in enumerate(inflate_records(content)) if h.get("WARC-Type") == "response"]
                yield pd.DataFrame(rows, columns=["archive_id", "place", "page_id", "payload_bytes", "payload_digest"])

    return archives.mapInPandas(work, "archive_id string, place int, page_id string, payload_bytes long, payload_digest string")


def find_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(archive_id, places, refers) of the records of each archive that repeat another record's payload.

    A digest of many records meets only as one pre-aggregated row, and the join back to the records is
    a sort-merge join that adaptive execution may split."""
    records = records.filter(F.col("payload_bytes") >= min_bytes).withColumn("who", F.struct(F.col("page_id").cast("long").alias("page_id"), "archive_id", "place"))
    keep = records.groupBy("payload_digest").agg(F.max("who").alias("keep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = records.join(keep.hint("merge"), "payload_digest").filter("NOT (who <=> keep)")
    return again.groupBy("archive_id").agg(F.collect_list(F.struct("place", F.col("keep.page_id").alias("refers_to"))).alias("revisits"))


def normalise(archives: DataFrame, revisits: DataFrame | None = None, level: int = 3) -> DataFrame:
    """Archives with a gzip member for each record, and a sidecar ``index`` of (place, offset, length)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content, found in zip(batch["archive_id"], batch["content"], batch["revisits"]):
                again = {} if found is None else {int(r["place"]): r["refers_to"] for r in found}
                out, index, at = [], [], 0
                for place, (head, block) in enumerate(inflate_records(content)):
                    kept = {k: v for k, v in head.items() if k.lower() != "content-length"} | {"X-Place": place}
                    if head.get("WARC-Type") == "response":
                        start = len(block) - len(body := _payload(block))
                        if not head.get("WARC-Payload-Digest", "").startswith("sha1:") or "X-Payload-Length" not in head:
                            kept |= {"WARC-Payload-Digest": f"sha1:{digest(body)}", "X-Payload-Length": len(body)}
                        if place in again:
                            target, block = again[place], block[:start]
                            kept |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "X-Refers-To": None if pd.isna(target) else int(target)}
                    record = _written(list(kept.items()), block)
                    gz = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                    member = gz.compress(record) + gz.flush()
                    out.append(member)
                    index.append({"place": place, "offset": at, "length": len(member)})
                    at += len(member)
                yield pd.DataFrame({"archive_id": [archive], "content": [b"".join(out)], "index": [index]})

    if revisits is None:
        rows = archives.withColumn("revisits", F.lit(None).cast("array<struct<place:int,refers_to:bigint>>"))
    else:
        rows = archives.join(revisits.hint("shuffle_merge"), "archive_id", "left")
    return rows.mapInPandas(work, "archive_id string, content binary, index array<struct<place:int,offset:long,length:long>>")


def read_back(archives: DataFrame) -> DataFrame:
    """One row per record, each read through the index alone and checked against its digest."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content, index in zip(batch["archive_id"], batch["content"], batch["index"]):
                rows = []
                for e in index:
                    head, block, _ = parse_record(zlib.decompress(content[e["offset"] : e["offset"] + e["length"]], GZIP))
                    kind = head["WARC-Type"]
                    if kind not in ("response", "revisit"):  # what describes captures has no payload of its own
                        head |= {"WARC-Payload-Digest": digest(block), "X-Payload-Length": len(block)}
                    name, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if kind == "response" and (digest(body := _payload(block)) != name or len(body) != size):
                        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                    rows.append((head.get("X-Page-Id"), head.get("WARC-Target-URI"), size, name, kind, head.get("X-Refers-To"), archive, e["offset"], e["length"]))
                yield pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive_id", "offset", "length"])

    out = archives.mapInPandas(work, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, archive_id string, offset long, length long")
    return out.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def archive(df: DataFrame, min_bytes: int = 0, **cols: str) -> DataFrame:
    """Write ``df`` as monolithic archives, normalise them and return the normalised archives table."""
    mono = cut(write_monolithic(df, **cols), "warc-mono")
    out = cut(normalise(mono, find_revisits(list_records(mono), min_bytes)), "warc")
    drop_cut(mono)
    return out


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_back(archive(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
