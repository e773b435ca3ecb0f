"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

Archives are files: ``save_archives`` writes one for each row of ``write_archives`` through Spark's own
writer and commit protocol, to any store that Spark writes, and ``binaryFile`` reads them back as rows
(path, content). The writer cuts an archive every ``ARCHIVE_BYTES``; each record is a gzip member of its
own, so that archive tools open the files and a fault costs no more than its member.

The reader checks every record: version line, headers, length, end, and the payload's digest. After a
failed check it looks for the next place where a valid member or version line starts, recovers what
follows, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, materialize, scratch_path

#: Compressed bytes after which a task starts a new archive.
ARCHIVE_BYTES = 4 << 20
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: What a cell of a Spark row can hold, and what a member may inflate to unless its first record declares more; others are quarantined.
CELL_BYTES, MEMBER_BYTES = (1 << 31) - (1 << 20), 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
ID = "urn:x-page:"
#: Compressed bytes that are inflated at once, and the most that a record's headers may have.
STEP, HEAD_BYTES = 1 << 16, 1 << 20
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
ROWS = "path string, offset long, length long, kind string, page_id long, uri string, refers_to long, digest string, payload binary, reason string"


def record(page_id: int | None, uri: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit holds the payload's headers only."""
    name = lambda i: f"<{ID}{'' if i is None else i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if uri is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()))
    if refers_to is not None:
        head += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", PROFILE)]
    head += [("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    text = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass")
    return b"WARC/1.1\r\n" + text + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without time stamp. A zero byte ends it: above 16 MB an empty member follows."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out.endswith(b"\0") else out + member(b"")


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and where it ends; ValueError if a check fails."""
    if data[at : at + 7] != VERSION:
        raise ValueError("no version line")
    head_end = data.find(b"\r\n\r\n", at, at + HEAD_BYTES)
    if head_end < 0:
        raise ValueError("headers do not end")
    lines = data[at:head_end].decode("utf-8", "replace").split("\r\n")
    head = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            raise ValueError("malformed header")
        head[k.strip().lower()] = v.strip()
    if not head.get("content-length", "").isdigit():
        raise ValueError("no length")
    start = head_end + 4
    end = start + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("length does not lead to the record's end")
    block = head.get("warc-block-digest", "")
    if block.startswith("sha1:") and base64.b32encode(hashlib.sha1(data[start:end]).digest()).decode() != block[5:]:
        raise ValueError("block does not match its digest")
    checked, payload = block.startswith("sha1:"), None
    kind = head.get("warc-type", "")
    digest = head.get("warc-payload-digest", "")
    try:
        sha1 = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
    except ValueError as e:
        raise ValueError("malformed digest") from e
    if kind == "response":
        gap = data.find(b"\r\n\r\n", start, end)
        if gap < 0:
            raise ValueError("no payload")
        payload = data[gap + 4 : end]
        if sha1 and hashlib.sha1(payload).hexdigest() != sha1:
            raise ValueError("payload does not match its digest")
        checked = checked or bool(sha1)

    def number(key: str) -> int | None:
        m = re.fullmatch(rf"<?{ID}(-?\d+)>?", head.get(key, ""))
        return int(m[1]) if m else None

    return {"kind": kind, "page_id": number("warc-record-id"), "uri": head.get("warc-target-uri"), "refers_to": number("warc-refers-to"), "digest": sha1, "payload": payload, "checked": checked}, end + 4


def allowed(start: bytes, most: int) -> int:
    """The most bytes that a member which starts like this may inflate to: what its first record declares, ``most`` at least, a cell at most."""
    end = start.find(b"\r\n\r\n", 0, HEAD_BYTES) if start.startswith(VERSION) else -1
    length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d{1,10})[ \t]*\r\n", start[: end + 2]) if end >= 0 else None
    return min(CELL_BYTES, max(most, end + 8 + int(length[1]) if length else 0))


def inflate(data: bytes, at: int, most: int = MEMBER_BYTES) -> tuple[bytes, int]:
    """The member at ``at``, inflated, and where it ends; ValueError if it is damaged, cut off or too large.

    Fed in steps, so that no member copies the rest of the archive; its start decides how much of it is inflated.
    """
    z, out, limit, view = zlib.decompressobj(31), bytearray(), None, memoryview(data)
    try:
        while not z.eof:
            if at >= len(data):
                raise ValueError("member is cut off")
            out += z.decompress(view[at : at + STEP], HEAD_BYTES if limit is None else limit + 1 - len(out))
            # At the end of a member both hold what follows it.
            at = min(at + STEP, len(data)) - len(z.unused_data if z.eof else z.unconsumed_tail)
            limit = allowed(bytes(out[:HEAD_BYTES]), most) if limit is None else limit
            if len(out) > limit:
                raise ValueError("member is too large")
    except zlib.error as e:
        raise ValueError(str(e)) from e
    return bytes(out), at


def inflate_prefix(data: bytes, at: int, most: int = MEMBER_BYTES) -> tuple[bytes, int, bool]:
    """What can be inflated of the damaged, cut or too large member at ``at``, where that stops, and whether it was cut only."""
    z, out, limit, step = zlib.decompressobj(31), bytearray(), None, STEP
    view = memoryview(data)
    while at < len(data) and (limit is None or len(out) < limit) and not z.eof:
        before = z.copy()
        try:
            part = z.decompress(view[at : at + step], HEAD_BYTES if limit is None else limit - len(out))
        except zlib.error:
            if step == 1:
                return bytes(out), at, False
            z, step = before, step // 2
            continue
        out += part
        at = min(at + step, len(data)) - len(z.unused_data if z.eof else z.unconsumed_tail)
        limit = allowed(bytes(out[:HEAD_BYTES]), most) if limit is None and (len(out) >= HEAD_BYTES or b"\r\n\r\n" in out) else limit
    return bytes(out), at, True


def inner_records(inner: bytes, checked_only: bool = False) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """Valid records of an inflated member, and (start, end, reason) of the bytes that none covers.

    checked_only leaves out records that no digest vouches for.
    """
    found, lost, place, bad, why = [], [], 0, None, ""
    while place < len(inner):
        try:
            rec, end = parse_record(inner, place)
            if checked_only and not rec["checked"]:
                raise ValueError("no digest vouches for a record of a damaged member")
        except ValueError as e:
            if bad is None:
                bad, why = place, str(e)
            place = inner.find(VERSION, place + 1)
            if place < 0:
                break
            continue
        if bad is not None:
            lost.append((bad, place, why))
            bad = None
        found.append(rec)
        place = end
    if bad is not None:
        lost.append((bad, len(inner), why))
    return found, lost


def read_archive(data: bytes, most: int = MEMBER_BYTES) -> Iterator[dict]:
    """Records in order, and a row of kind ``gap`` for each stretch of bytes that no valid record covers.

    Of a whole member with bad records the good ones are kept; a gap in it has the member's offset, length 0
    and its inflated bytes in the reason. Of a cut or damaged member the records before the fault are kept,
    and a gap runs from the fault to the next valid place. A member of more than ``most`` bytes is like a cut one.
    """
    at, bad, why = 0, None, ""
    kept: tuple | None = None  # a damaged member's records, its offset and where inflating stopped

    def closed(to: int) -> Iterator[dict]:
        start = bad
        if kept is not None:
            found, first, stop = kept
            if first > bad:
                yield {"kind": "gap", "offset": bad, "length": first - bad, "reason": why}
            start = min(stop, to)
            for rec in found:
                yield rec | {"offset": first, "length": start - first}
        yield {"kind": "gap", "offset": start, "length": to - start, "reason": why if kept is None else kept_why}

    found_at = {MAGIC: -1, VERSION: -1}

    def nearest(start: int) -> int:
        """Where the next member or version line may start; each sign is searched for once over the archive."""
        for sign, place in found_at.items():
            if place < start:
                found_at[sign] = place = data.find(sign, start)
            if place < 0:
                found_at[sign] = len(data)
        return min(found_at.values())

    kept_why = ""
    while at < len(data):
        lost = []
        try:
            if data[at : at + 3] == MAGIC:
                inner, end = inflate(data, at, most)
                found, lost = inner_records(inner)
                if not found and inner:
                    raise ValueError(lost[0][2])
            else:
                rec, end = parse_record(data, at)
                found = [rec]
        except ValueError as e:
            if data[at : at + 3] == MAGIC:
                part, stop, cut = inflate_prefix(data, at, most)
                some, _ = inner_records(part, checked_only=not cut)
                if some:
                    if kept is not None:  # an earlier damaged member ends here
                        yield from closed(at)
                        bad = None
                    kept, kept_why = (some, at, stop), str(e)
            if bad is None:
                bad, why = at, str(e)
            at = nearest(at + 1)
            continue
        if bad is not None:
            yield from closed(at)
            bad = kept = None
        for rec in found:
            yield rec | {"offset": at, "length": end - at}
        for a, b, reason in lost:
            yield {"kind": "gap", "offset": at, "length": 0, "reason": f"inflated bytes {a} to {b}: {reason}"}
        at = end
    if bad is not None:
        yield from closed(len(data))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (path, content) with a record for each row of ``pages``, payload the html; null as empty.

    Of equal payloads of ``revisit_bytes`` or more, that with the largest id is a response and the
    others are revisits of it; rows that repeat that id, or have none, are responses. No rows, no archives.
    """
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    marks = slim.select("page_id", F.octet_length("html").alias("n"), F.sha2("html", 256).alias("digest")).where(F.col("n") >= revisit_bytes)
    marks = materialize(marks, "page-digests")
    heads = marks.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"))
    revisits = marks.join(heads, ["digest", "n"]).where("page_id <> refers_to").select("page_id", "n", "digest", "refers_to").distinct()
    keyed = slim.withColumns({"sha1": F.sha1("html"), "n": F.octet_length("html"), "digest": F.sha2("html", 256)})
    revisits = materialize(revisits, "page-revisits")
    joined = keyed.join(F.broadcast(revisits) if revisits.count() <= BROADCAST_KEYS else revisits, ["page_id", "digest", "n"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"archive-{part:06d}-{k:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["path", "content"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, uri, html, sha1, refers = (c[i].as_py() for c in batch.columns)
                held.append(member(record(page, uri, html.encode("utf-8", "surrogatepass"), sha1, refers)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield out()
                    k, held, size = k + 1, [], 0
        if held:
            yield out()

    return joined.select("page_id", "url", "html", "sha1", "refers_to").mapInArrow(run, "path string, content binary")


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Write a file for each row (path, content) and return the files as rows (path, content) again.

    Spark's text writer puts a separator behind each row; it is the zero byte that ends every member.
    """
    body = F.expr("cast(substring(content, 1, octet_length(content) - 1) as string)")
    archives.select(body.alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(folder)
    return archives.sparkSession.read.format("binaryFile").load(folder).where("length > 0").select("path", "content")


def read_archives(archives: DataFrame, most: int = MEMBER_BYTES) -> DataFrame:
    """Rows of ``ROWS`` from archives (path, content), as ``binaryFile`` or ``write_archives`` give them.

    kind is the record's type, or ``gap`` for quarantined bytes, with offset, length and reason; offset
    and length are those of the member, or of the record in an uncompressed archive. page_id and
    refers_to are null where ids are not of this writer. An empty or null archive has no rows. A member that inflates
    beyond ``most`` bytes, and beyond what its first record declares, keeps the records that come before; the rest is a gap.
    """
    names = [c.strip().split(" ")[0] for c in ROWS.split(",")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""
                rows, size = [], 0
                for r in read_archive(content, most):
                    rows.append(r | {"path": path})
                    size += len(r.get("payload") or b"")
                    if size > 8 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return archives.select("path", "content").mapInArrow(run, ROWS)


def export_and_read(pages: DataFrame, **kw) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) read back from written archives.

    A revisit's length is that of the response it refers to; its digest is its own header's. Repeated rows repeat.
    """
    archives = save_archives(write_archives(pages, **kw), scratch_path(pages.sparkSession, "warc"))
    back = read_archives(archives).where("kind <> 'gap'")
    slim = materialize(back.select("page_id", F.octet_length("payload").cast("long").alias("n"), F.when(F.col("kind") == "response", F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to"), "warc-records")
    held = slim.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("n").alias("held"))
    out = slim.join(held, ["refers_to", "payload_digest"], "left")
    return out.select("page_id", F.coalesce("n", "held").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
