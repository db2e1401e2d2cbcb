"""WARC archives: writing pages with segmentation and revisits, and reassembling them.

An archive is a file of records, each ended by a blank line pair, so Spark's text writer with that
terminator writes archives (to any store, with its commit protocol); a file holds a bounded number of
records of bounded size. A payload travels in chunked transfer framing behind an HTTP header; a block
beyond the segment size goes on in continuation records.

Reading parses each file by the records' Content-Length. Whole records are decoded where they are
read; segments are grouped by their origin's record id, put in order of segment number, checked
against the total length, and then decoded.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL, bounded_batches, read, shared_dir, staged

#: Bytes of a block before it is segmented, of a chunk, payload from which equal ones are revisits,
#: and records of one file.
SEGMENT, CHUNK, LEAST, RECORDS = 64 << 10, 8 << 10, 1000, 400
END = b"\r\n\r\n"


def pieces(data: bytes, size: int) -> list[bytes]:
    """data in pieces of at most `size` bytes (4 at least) that don't part a UTF-8 character."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in pieces(payload, size)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload within chunked framing; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        at = line + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("chunk without end")
        out.append(body[line + 2 : at])
        at += 2


def record(kind: str, record_id: str, fields: dict[str, object], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", **fields, "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def records(origin: str, url: str | None, digest: str, payload: bytes, refers_to: str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, without the terminator."""
    fields: dict[str, object] = {"WARC-Payload-Digest": f"sha1:{digest}"}
    if url is not None:
        fields["WARC-Target-URI"] = "".join(chr(b) if 32 < b < 127 else f"%{b:02X}" for b in url.encode("utf-8", "replace"))
    if refers_to is not None:  # the header alone, with the length of the payload that isn't repeated
        fields |= {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        yield record("revisit", origin, fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(payload))
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = pieces(block, segment)
    if len(parts) == 1:
        yield record("response", origin, fields, block)
        return
    yield record("response", origin, fields | {"WARC-Segment-Number": 1}, parts[0])
    for k, part in enumerate(parts[1:], 2):
        more: dict[str, object] = {"WARC-Segment-Origin-ID": f"<{origin}>", "WARC-Segment-Number": k}
        if k == len(parts):
            more["WARC-Segment-Total-Length"] = len(block)
        yield record("continuation", f"{origin}:{k}", more, part)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and blocks of an archive's records, by their lengths."""
    at = 0
    while at < len(data):
        head = data.index(END, at)
        lines = data[at:head].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start = head + 4
        end = start + int(fields["content-length"])
        if data[end : end + 4] != END:
            raise ValueError(f"record at byte {at} doesn't end")
        yield fields, data[start:end]
        at = end + 4


def write(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT) -> None:
    """Archives of pages (page_id, url, html) under path. A page's record id tells its page_id and
    digest. Of equal payloads of at least `least` bytes the largest page_id's is the response, the
    others revisit it; rows that equal it in page_id too are responses as well."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("string").alias("page"), "page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long = F.octet_length("html") >= least
    # only digests that repeat come back, and of the pages only ids: no html goes to its digest's task
    repeated = rows.where(long).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    repeated = staged(repeated, "repeated")
    if repeated.count() <= SMALL:
        rows = rows.join(F.broadcast(repeated), "digest", "left")
    else:
        first = rows.where(long).select("page_id", "digest").distinct().join(repeated, "digest")
        rows = rows.join(first, ["page_id", "digest"], "left")
    rows = rows.withColumn("refers", F.when(long & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first").cast("string")))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page, url, html, digest, refers in zip(*(batch[c] for c in ("page", "url", "html", "digest", "refers")), strict=True):
                page, url, html, digest, refers = (x.as_py() for x in (page, url, html, digest, refers))
                name = lambda p, digest=digest: f"urn:page:{'' if p is None else p}:{digest}"
                for r in records(name(page), url, digest, html.encode("utf-8", "replace"), None if refers is None else name(refers), segment):
                    out.append(r.decode())
                    held += len(r)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
                        out, held = [], 0
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    archive = rows.select("page", "url", "html", "digest", "refers").mapInArrow(emit, "value string")
    archive.write.option("lineSep", END.decode()).option("maxRecordsPerFile", RECORDS).option("compression", "gzip").text(path)


_FIELDS = "origin string, record_type string, refers_to string, target_uri string, digest string, payload binary, payload_bytes long"


def _finished(origin: str, kind: str, refers: str | None, target: str | None, digest: str, block: bytes, with_payload: bool) -> dict:
    """One record from its whole block; the payload's digest is computed anew where there is one."""
    head, _, body = block.partition(END)
    if kind == "revisit":
        size = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
        return {"origin": origin, "record_type": kind, "refers_to": refers, "target_uri": target, "digest": digest, "payload": None, "payload_bytes": size}
    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    found = hashlib.sha1(payload).hexdigest()
    if found != digest:
        raise ValueError(f"{origin}: payload digest {found} isn't {digest}")
    return {"origin": origin, "record_type": kind, "refers_to": None, "target_uri": target, "digest": found, "payload": payload if with_payload else None, "payload_bytes": len(payload)}


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(origin, record_type, refers_to, target_uri, digest, payload, payload_bytes) of the archives' records:
    origin is the record id, target_uri the page's url with all bytes but printable ASCII percent-encoded. Revisits have no payload. Segments with a gap, of another total length or digest
    raise an error. Payloads travel on only if asked for."""
    segments = "origin string, number int, total long, copy string, target_uri string, digest string, block binary"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        whole_type = pa.struct([("origin", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("digest", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64())])
        part_type = pa.struct([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("copy", pa.string()), ("target_uri", pa.string()), ("digest", pa.string()), ("block", pa.binary())])
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                data = content.as_py()
                data = gzip.decompress(data) if name.as_py().endswith(".gz") else data
                done, parts, held = [], [], 0
                flush = lambda done, parts: pa.RecordBatch.from_pydict({"whole": pa.array(done + [None] * len(parts), whole_type), "part": pa.array([None] * len(done) + parts, part_type)})
                for fields, block in parsed(data):
                    bare = lambda k, fields=fields: fields[k].strip("<>") if k in fields else None
                    origin = bare("warc-segment-origin-id") or bare("warc-record-id")
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if "warc-segment-number" in fields:
                        total = fields.get("warc-segment-total-length")
                        parts.append({"origin": origin, "number": int(fields["warc-segment-number"]), "total": int(total) if total else None, "copy": None, "target_uri": fields.get("warc-target-uri"), "digest": digest, "block": block})
                    else:
                        done.append(_finished(origin, fields["warc-type"], bare("warc-refers-to"), fields.get("warc-target-uri"), digest, block, with_payload))
                    held += len(block)
                    if held > 8 << 20:
                        yield flush(done, parts)
                        done, parts, held = [], [], 0
                yield flush(done, parts)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    found = files.mapInArrow(parse, f"whole struct<{_FIELDS.replace(' ', ':').replace(',:', ',')}>, part struct<{segments.replace(' ', ':').replace(',:', ',')}>")

    def join_up(rows):
        """One origin's segments; a segment that is there k times stands for k equal pages."""
        import pandas as pd

        rows = rows.sort_values("number")
        by = rows.groupby("number")["block"]
        copies = by.size()
        numbers = list(copies.index)
        if numbers != list(range(1, len(numbers) + 1)) or copies.nunique() != 1:
            raise ValueError(f"{rows['origin'].iloc[0]}: segments {numbers}")
        block = b"".join(by.first())
        if rows["total"].max() != len(block):
            raise ValueError(f"{rows['origin'].iloc[0]}: {len(block)} bytes, not {rows['total'].max()}")
        one = _finished(rows["origin"].iloc[0], "response", None, None, rows["digest"].dropna().iloc[0], block, with_payload)
        return pd.DataFrame([one | {"target_uri": target} for target in rows.loc[rows["number"] == 1, "target_uri"]])

    return found.where("whole is not null").select("whole.*").union(found.where("part is not null").select("part.*").groupBy("origin").applyInPandas(join_up, _FIELDS))


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to; from archives that are
    written and read back. Null html is an empty payload; a page without id keeps its row."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    write(pages, path)
    page = lambda c: F.when(F.split(c, ":")[2] != "", F.split(c, ":")[2]).cast(pages.schema["page_id"].dataType)
    return read_archives(spark, path, with_payload=False).select(
        page("origin").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to")
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
top AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN top ON top.d = p.d AND p.n >= 1000
"""
