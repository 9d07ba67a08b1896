"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writing: of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is a response
record and the others are revisit records that refer to it; all others are responses. Each record is a gzip member
of its own. A revisit keeps the headers of the response, its payload's length and digest among them.

Reading: each member must inflate with a right checksum and hold one record with a version line, a fitting length
and a right block digest. Where a check fails, the reader looks for the next offset at which a member (or, in a
plain file, a version line) starts a valid record, goes on from there, and logs the bytes between as a quarantined
gap with the reason. It holds one record (in a plain file one whose length ends where a record can end, so a forged length
costs nothing) and a read-ahead of a megabyte in memory.

``archived`` returns what reading the files back gives, and fails if they have a gap: no record is lost unseen.

Edge cases: a null html is an empty payload; a null url is ``urn:unknown:``; a null page_id is kept (as no number) and
never the largest unless all are null; rows with equal page_id and payload are responses all, if they have the
largest id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from chronoflow.llm.store import Output, fresh_folder, open_input, written

MIN_BYTES = 1000
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"
_AHEAD = 1 << 20


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """An uncompressed record."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", _digest(block)), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"<{_ID}{'' if i is None else i}>"
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url is not None else "urn:unknown:"
    head = [("WARC-Record-ID", name(page_id)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", _digest(payload)), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        return record_bytes("revisit", [*head, ("WARC-Refers-To", name(refers_to)), ("WARC-Profile", PROFILE)], http)
    return record_bytes("response", head, http + payload)


def _writer(folder: str, date: str):
    def write(batches):
        out, n, uri = None, 0, f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64).to_pylist()
                if out is None and rows:
                    out = Output(uri)
                    out.write(_member(record_bytes("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                for r in rows:
                    payload = (r["html"] or "").encode("utf-8", "replace")
                    out.write(_member(page_record(r["page_id"], r["url"], payload, r["refers_to"], r["revisit"], date)))
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri], "n_records": pa.array([n], pa.int64())})

    return write


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes ``pages`` (page_id, url, html), a file a partition, and returns the manifest (uri, n_records)."""
    folder = folder or fresh_folder(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    same = rows.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    same = same.filter("n > 1").select("digest", "response")
    # Revisits are found among ids and digests; payloads meet them by both, so that a payload which many pages have is not
    # one task's.
    ids = rows.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    ids = ids.join(same, ids["_digest"] == same["digest"]).filter(~F.col("_id").eqNullSafe(F.col("response"))).select("_id", "_digest", "response")
    rows = rows.join(ids, (rows["digest"] == ids["_digest"]) & rows["page_id"].eqNullSafe(ids["_id"]), "left")
    rows = rows.select("page_id", "url", "html", F.col("response").alias("refers_to"), F.col("response").isNotNull().alias("revisit"))
    return written(rows.mapInArrow(_writer(folder, date), "uri string, n_records long"), "manifest")


class _Bytes:
    """A file read forward, of which what lies behind ``drop`` is let go."""

    def __init__(self, f):
        self.f, self.size, self.data, self.base, self.ended = f, f.size(), b"", 0, False

    def upto(self, end: int) -> None:
        """Makes the bytes before ``end`` present, as far as the file has them."""
        while not self.ended and self.base + len(self.data) < end:
            more = self.f.read(max(_AHEAD, end - self.base - len(self.data)))
            self.ended = not more
            self.data += more

    def drop(self, at: int) -> None:
        self.data, self.base = self.data[at - self.base :], at

    def find(self, mark: bytes, at: int) -> int:
        """Where ``mark`` next stands; raises ValueError."""
        begin = at
        while (k := self.data.find(mark, begin - self.base)) < 0:
            if self.ended:
                raise ValueError("header not closed")
            begin = max(at, self.base + len(self.data) - len(mark) + 1)
            self.upto(self.base + len(self.data) + _AHEAD)
        return self.base + k

    def peek(self, at: int, n: int) -> bytes:
        """Some bytes further on, without reading what lies between."""
        here = self.f.tell()
        self.f.seek(at)
        data = self.f.read(n)
        self.f.seek(here)
        return data


_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*([0-9]+)[ \t]*\r\n", re.I)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one whole record; raises ValueError if a check fails."""
    if not data.startswith(b"WARC/"):
        raise ValueError("no version line")
    head, cut, rest = data.partition(b"\r\n\r\n")
    if not cut:
        raise ValueError("header not closed")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        headers[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no length")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("length does not fit")
    block = rest[:n]
    if (d := headers.get("warc-block-digest", "")).startswith("sha1:") and d != _digest(block):
        raise ValueError("block digest differs")
    return headers, block


def _inflated(b: _Bytes, at: int) -> tuple[bytes, int]:
    """The member at ``at`` and where it ends; raises ValueError."""
    z, parts, here = zlib.decompressobj(31), [], at
    while not z.eof:
        b.upto(here + _AHEAD)
        piece = b.data[here - b.base : here - b.base + _AHEAD]
        if not piece:
            raise ValueError("member cut off")
        try:
            parts.append(z.decompress(piece))
        except zlib.error as e:
            raise ValueError(f"member damaged: {e}") from None
        if len(parts) == 1 and not b"WARC/".startswith(parts[0][:5]) and not parts[0].startswith(b"WARC/"):
            raise ValueError("no version line")
        here += len(piece) - len(z.unused_data)
    return b"".join(parts), here


def _plain(b: _Bytes, at: int) -> tuple[bytes, int]:
    """The uncompressed record at ``at`` and where it ends; raises ValueError."""
    b.upto(at + _AHEAD)
    if b.data[at - b.base : at - b.base + 5] != b"WARC/":
        raise ValueError("no version line")
    close = b.find(b"\r\n\r\n", at)
    head = b.data[at - b.base : close - b.base + 4]
    m = _LENGTH.search(head)
    if not m:
        raise ValueError("no length")
    end = at + len(head) + int(m[1]) + 4
    if end > b.size:
        raise ValueError("record cut off")
    if b.peek(end - 4, 4) != b"\r\n\r\n":
        raise ValueError("length does not fit")
    b.upto(end)
    return b.data[at - b.base : end - b.base], end


def salvage(f) -> Iterator[tuple[str, int, int, object]]:
    """('record', start, end, (headers, block)) and ('gap', start, end, reason) of a file, together all its bytes."""
    b = _Bytes(f)
    at, gap, reason = 0, None, ""
    while True:
        b.upto(at + _AHEAD)
        if at >= b.base + len(b.data):
            break
        try:
            gzip = b.data[at - b.base : at - b.base + 2] == b"\x1f\x8b"
            data, end = _inflated(b, at) if gzip else _plain(b, at)
            record = parse_record(data)
        except ValueError as e:
            if gap is None:
                gap, reason = at, str(e)
            at = _next(b, at + 1)
            b.drop(at)
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        yield "record", at, end, record
        at = end
        b.drop(at)
    if gap is not None:
        yield "gap", gap, at, reason


_START = re.compile(rb"\x1f\x8b\x08|WARC/[01]\.")


def _next(b: _Bytes, at: int) -> int:
    while True:
        b.upto(at + _AHEAD)
        m = _START.search(b.data, at - b.base)
        if m:
            return b.base + m.start()
        end = b.base + len(b.data)
        if b.ended:
            return end
        at = max(at, end - 8)
        b.drop(at)


_ROWS = "uri string, start long, end long, reason string, type string, page_id long, payload_bytes long, payload_digest string, refers_to long"


def _page_of(name: str | None) -> int | None:
    m = re.fullmatch(rf"<{_ID}(-?[0-9]+)>", name or "")
    return int(m[1]) if m else None


def _row(uri: str, kind: str, start: int, end: int, what) -> dict:
    row = dict.fromkeys(("uri", "start", "end", "reason", "type", "page_id", "payload_bytes", "payload_digest", "refers_to"))
    row |= {"uri": uri, "start": start, "end": end}
    if kind == "gap":
        return row | {"reason": what}
    headers, block = what
    row["type"] = headers.get("warc-type")
    if row["type"] not in ("response", "revisit"):
        return row
    http, _, payload = block.partition(b"\r\n\r\n")
    row["page_id"] = _page_of(headers.get("warc-record-id"))
    digest = headers.get("warc-payload-digest", "")[5:]
    if row["type"] == "revisit":
        m = _LENGTH.search(http + b"\r\n")
        return row | {"payload_bytes": int(m[1]) if m else None, "payload_digest": base64.b32decode(digest).hex(), "refers_to": _page_of(headers.get("warc-refers-to"))}
    return row | {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}


_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]


def _reader(batches):
    for batch in batches:
        for uri in batch.column("uri").to_pylist():
            rows = []
            with open_input(uri) as f:
                for kind, start, end, what in salvage(f):
                    rows.append(_row(uri, kind, start, end, what))
                    if len(rows) == 2000:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(rows[0], _TYPES)], list(rows[0]))


def read_warc(files: DataFrame) -> DataFrame:
    """All records and gaps of the files named in column ``uri``: a row a record (reason null) or gap (type null)."""
    # Files, not bytes, are dealt out; a row is a name, so a partition for each few files costs little.
    n = max(1, min(files.count(), 20_000))
    return files.select("uri").repartition(n).mapInArrow(_reader, _ROWS)


def gaps(rows: DataFrame) -> DataFrame:
    """The quarantined bytes among what ``read_warc`` gave: uri, start, end, reason."""
    return rows.filter("reason IS NOT NULL").select("uri", "start", "end", "reason")


def shortfalls(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Files of the manifest (uri, n_records) that gave another number of pages when read: uri, n_records, n_read. A file
    cut at a member's boundary has no gap, but records are lacking."""
    read = rows.filter("type IN ('response', 'revisit')").groupBy("uri").agg(F.count("*").alias("n_read"))
    both = manifest.join(read, "uri", "left").select("uri", "n_records", F.coalesce("n_read", F.lit(0)).alias("n_read"))
    return both.filter("n_read <> n_records")


def checked(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with an error for each gap and for each file from which records are lacking or lost."""
    gap = F.raise_error(F.concat(F.lit("gap in "), "uri", F.lit(" at "), F.col("start").cast("string"), F.lit(": "), "reason"))
    rows = rows.withColumn("type", F.when(F.col("reason").isNotNull(), gap).otherwise(F.col("type"))).filter("type IN ('response', 'revisit')")
    lost = shortfalls(manifest, rows)
    lost = lost.withColumn("type", F.raise_error(F.concat(F.lit("records lacking in "), "uri", F.lit(": "), F.col("n_read").cast("string"), F.lit(" of "), F.col("n_records").cast("string"))))
    return rows.unionByName(lost.select("uri", F.col("type").cast("string").alias("type")), allowMissingColumns=True)


def archived(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` and returns its records as read back, as many as were written."""
    manifest = write_warc(pages, **options)
    rows = checked(manifest, written(read_warc(manifest), "records"))
    return rows.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


QUERY_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, max(page_id) AS response FROM p WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN response IS NOT NULL AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest
"""
