"""ISO media containers: write a payload into boxes, walk the boxes, and read samples back.

``store`` wraps each payload as one track of 8-bit raw samples. ``probe`` reads a media column: it
walks nested boxes, decodes the sample tables of every track, and of movie fragments, and returns codec,
duration and the byte ranges of key samples; the payload is never decoded and, past the tables, never
touched. ``read_samples`` returns the bytes of a track's samples in order.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_fields

#: Bytes of a sample, samples of a chunk, samples from one key sample to the next, samples a second.
FRAME, CHUNK, KEY_EVERY, RATE = 192, 64, 25, 8000


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text in UTF-8, and them filled with spaces up to a positive multiple of ``FRAME``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(FRAME, -(-len(raw) // FRAME) * FRAME), b" ")


def write_media(payload: bytes) -> bytes:
    """A container of one audio track whose samples are ``FRAME`` bytes of ``payload`` each."""
    n = len(payload) // FRAME
    ticks = n * FRAME
    chunks = -(-n // CHUNK)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    runs = [(1, CHUNK)] if n % CHUNK == 0 else [(1, n % CHUNK)] if chunks == 1 else [(1, CHUNK), (chunks, n % CHUNK)]
    keys = range(1, n + 1, KEY_EVERY)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")

    def moov(first: int) -> bytes:
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, FRAME)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, size, 1) for at, size in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64", struct.pack(f">I{chunks}Q", chunks, *(first + k * CHUNK * FRAME for k in range(chunks)))),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, ticks, 0x55C4, 0), version=1), full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        trak = box(b"trak", full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, ticks, 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=7), mdia)
        return box(b"moov", full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, ticks, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2), version=1), trak)

    lead = 8 if len(payload) + 8 < 1 << 32 else 16
    first = len(head) + len(moov(0)) + lead
    return head + moov(first) + box(b"mdat", payload)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first and end byte of the body) of each box of one level; ValueError if a box leaves its parent."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1 and at + 16 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], at + 16
        stop = end if size == 0 else at + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} at {at} of {size} bytes leaves its parent")
        yield kind, body, stop
        at = stop


def descend(data: memoryview, start: int, end: int, *path: bytes) -> tuple[int, int]:
    """The body of the first box that ``path`` leads to. Only known paths are walked, so that depth cannot grow."""
    for kind in path:
        start, end = next(((b, s) for k, b, s in boxes(data, start, end) if k == kind), (-1, -1))
        if start < 0:
            raise ValueError(f"no box {kind!r}")
    return start, end


def _chunked(view: memoryview, stbl: dict[bytes, tuple[int, int]], room: int) -> list[tuple[int, int, bool]]:
    """(offset, size, is key) of each sample that a sample table describes; more than ``room`` of them are an error."""

    def ints(kind: bytes, form: str, count_at: int = 4) -> list[tuple]:
        if kind not in stbl:
            raise ValueError(f"no box {kind!r}")
        body, stop = stbl[kind]
        n = struct.unpack_from(">I", view, body + count_at)[0]
        size = struct.calcsize(f">{form}")
        if body + count_at + 4 + n * size > stop:
            raise ValueError(f"table {kind!r} is longer than its box")
        return list(struct.iter_unpack(f">{form}", view[body + count_at + 4 : body + count_at + 4 + n * size]))

    if b"stsz" in stbl:
        even, n = struct.unpack_from(">II", view, stbl[b"stsz"][0] + 4)
        if even * n > len(view) or n > room:
            raise ValueError("samples are larger or more than the file")
        sizes = [even] * n if even else [x for (x,) in ints(b"stsz", "I", 8)]
    elif b"stz2" in stbl:
        bits = struct.unpack_from(">I", view, stbl[b"stz2"][0] + 4)[0] & 0xFF
        if bits == 4:
            body, stop = stbl[b"stz2"]
            n = struct.unpack_from(">I", view, body + 8)[0]
            if body + 12 + (n + 1) // 2 > stop:
                raise ValueError("table b'stz2' is longer than its box")
            sizes = [view[body + 12 + i // 2] >> (4 if i % 2 == 0 else 0) & 15 for i in range(n)]
        elif bits in (8, 16):
            sizes = [x for (x,) in ints(b"stz2", {8: "B", 16: "H"}[bits], 8)]
        else:
            raise ValueError(f"sizes of {bits} bits")
    else:
        raise ValueError("no box b'stsz'")
    n = len(sizes)
    if n > room:
        raise ValueError("more samples than the file has bytes")
    firsts = [x for (x,) in (ints(b"co64", "Q") if b"co64" in stbl else ints(b"stco", "I"))]
    runs = ints(b"stsc", "III")
    keys = {x for (x,) in ints(b"stss", "I")} if b"stss" in stbl else None
    if sum(c for c, _ in ints(b"stts", "II")) != n:
        raise ValueError("time table and sizes disagree")
    samples, k = [], 0
    for r, (chunk, per, _) in enumerate(runs):
        if chunk < 1:
            raise ValueError("chunks count from 1")
        for c in range(chunk, runs[r + 1][0] if r + 1 < len(runs) else len(firsts) + 1):
            at = firsts[c - 1]
            for _ in range(min(per, n - k)):
                samples.append((at, sizes[k], keys is None or k + 1 in keys))
                at += sizes[k]
                k += 1
    if k != n:
        raise ValueError("chunks and sizes disagree")
    return samples


def _fragments(view: memoryview, moof: tuple[int, int, int], defaults: dict[int, tuple], found: dict[int, dict]) -> None:
    """Add the samples and durations of a movie fragment (start, body, stop) to its tracks."""
    start, body, stop = moof
    end = start
    for kind, b, s in boxes(view, body, stop):
        if kind != b"traf":
            continue
        at = descend(view, b, s, b"tfhd")[0]
        flags, track = struct.unpack_from(">I", view, at)[0] & 0xFFFFFF, struct.unpack_from(">I", view, at + 4)[0]
        if track not in found:
            raise ValueError(f"fragment of an unknown track {track}")
        at += 8
        base = end if end > start and not flags & 0x20000 else start
        if flags & 1:
            base, at = struct.unpack_from(">Q", view, at)[0], at + 8
        at += 4 if flags & 2 else 0
        usual = list(defaults.get(track, (0, 0, 0)))
        for i, bit in enumerate((0x8, 0x10, 0x20)):
            if flags & bit:
                usual[i], at = struct.unpack_from(">I", view, at)[0], at + 4
        place = base
        for kind2, b2, s2 in boxes(view, b, s):
            if kind2 != b"trun":
                continue
            flags, n = struct.unpack_from(">I", view, b2)[0] & 0xFFFFFF, struct.unpack_from(">I", view, b2 + 4)[0]
            at = b2 + 8
            if flags & 1:
                place, at = base + struct.unpack_from(">i", view, at)[0], at + 4
            lead = None
            if flags & 4:
                lead, at = struct.unpack_from(">I", view, at)[0], at + 4
            bits = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
            # Runs without fields of their own cost no bytes, so samples of all runs and tracks are counted against the file's.
            if at + 4 * len(bits) * n > s2 or n > len(view) - sum(len(t["samples"]) for t in found.values()):
                raise ValueError("run of samples is longer than its box or file")
            for i in range(n):
                row = dict(zip(bits, struct.unpack_from(f">{len(bits)}I", view, at + 4 * len(bits) * i), strict=True))
                size = row.get(0x200, usual[1])
                marks = row.get(0x400, lead if lead is not None and i == 0 else usual[2])
                found[track]["samples"].append((place, size, not marks & 0x10000))
                found[track]["ticks"] += row.get(0x100, usual[0])
                place += size
        end = place


def tracks(data: bytes) -> list[dict]:
    """Codec, timescale, duration, and (offset, size, is key) of each sample, for each track in the file's order.

    A file that claims more samples than it has bytes is malformed, so what is held stays in proportion to the file.
    """
    view = memoryview(data)
    top = list(boxes(view, 0, len(view)))
    moov = next(((b, s) for k, b, s in top if k == b"moov"), None)
    if moov is None:
        raise ValueError("no box b'moov'")
    found: dict[int, dict] = {}
    defaults: dict[int, tuple] = {}
    for kind, b, s in boxes(view, *moov):
        if kind == b"trak":
            head = descend(view, b, s, b"tkhd")[0]
            number = struct.unpack_from(">I", view, head + (20 if view[head] == 1 else 12))[0]
            at = descend(view, b, s, b"mdia", b"mdhd")[0]
            scale, duration = struct.unpack_from(">IQ", view, at + 20) if view[at] == 1 else struct.unpack_from(">II", view, at + 12)
            stbl: dict[bytes, tuple[int, int]] = {}
            for k, x, y in boxes(view, *descend(view, b, s, b"mdia", b"minf", b"stbl")):
                stbl.setdefault(k, (x, y))
            if b"stsd" not in stbl:
                raise ValueError("no box b'stsd'")
            codec = bytes(view[stbl[b"stsd"][0] + 12 : stbl[b"stsd"][0] + 16]).decode("latin-1")
            if number in found:
                raise ValueError(f"two tracks of number {number}")
            found[number] = {"codec": codec, "timescale": scale, "duration": duration, "samples": _chunked(view, stbl, len(view) - sum(len(t["samples"]) for t in found.values())), "ticks": 0}
        elif kind == b"mvex":
            for k, x, _ in boxes(view, b, s):
                if k == b"trex":
                    number, _, *usual = struct.unpack_from(">IIIII", view, x + 4)
                    defaults[number] = tuple(usual)
    start = 0
    for kind, b, s in top:
        if kind == b"moof":
            _fragments(view, (start, b, s), defaults, found)
        start = s
    if not found:
        raise ValueError("no box b'trak'")
    for t in found.values():
        t["duration"] += t.pop("ticks")
        if t["samples"] and (min(o for o, _, _ in t["samples"]) < 0 or max(o + s for o, s, _ in t["samples"]) > len(view)):
            raise ValueError("samples lie outside the file")
    return list(found.values())


def read_samples(data: bytes, track: int = 0) -> bytes:
    """The bytes of all samples of a track, in order."""
    return b"".join(data[o : o + s] for o, s, _ in tracks(data)[track]["samples"])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) for each row of ``docs``: its text's bytes in a container; null as empty, repeated rows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # containers of a few texts at a time
                part = batch.slice(at, 500)
                made = [padded(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([write_media(p) for _, p in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def probe(files: DataFrame, media_col: str = "media") -> DataFrame:
    """``files``'s columns without the media column, with track, codec, timescale, duration, samples, keyframes, error.

    One row a track, numbered from 0 in the file's order; repeated rows repeat, columns that have these
    names are replaced. duration is in seconds. A null, empty or malformed container has one row, with
    nulls and its error.
    """
    new = ["track", "codec", "timescale", "duration", "samples", "keyframes", "error"]
    kept = [c for c in files.columns if c not in new and c != media_col]
    picked = files.select(*kept, F.col(media_col))
    keys = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def look(data: bytes | None) -> list[tuple]:
        try:
            found = tracks(data or b"")
        except (ValueError, IndexError, struct.error) as e:
            return [(None,) * 6 + (str(e)[:200] or type(e).__name__,)]
        return [
            (i, t["codec"], t["timescale"], t["duration"] / t["timescale"] if t["timescale"] else None, len(t["samples"]), [{"start": o, "end": o + s} for o, s, key in t["samples"] if key], None)
            for i, t in enumerate(found)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), keys, pa.string()]
        for batch in batches:
            found = [look(v.as_py()) for v in batch.column(len(kept))]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            flat = [row for f in found for row in f]
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[: len(kept)]), *(pa.array([f[i] for f in flat], k) for i, k in enumerate(kinds))], [*kept, *new])

    schema = with_fields(files.select(*kept), track="long", codec="string", timescale="long", duration="double", samples="long", keyframes="array<struct<start: bigint, end: bigint>>", error="string")
    return picked.mapInArrow(run, schema)


def digest(files: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from ``store``'s rows.

    Everything but n_bytes comes from the stored bytes; a container that cannot be read is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            rows = []
            for v in batch.column(2):
                data = v.as_py()
                t = tracks(data)[0]
                payload = b"".join(data[o : o + s] for o, s, _ in t["samples"])
                keys = [(o, o + s) for o, s, key in t["samples"] if key]
                ranges = hashlib.md5(",".join(f"{a}-{b}" for a, b in keys).encode()).hexdigest()
                feature = f"codec={t['codec'].strip()};seconds={t['duration'] / t['timescale']:.6f};samples={len(t['samples'])};keys={len(keys)};first={keys[0][0]}-{keys[0][1]};ranges={ranges}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    kind = dict(files.dtypes)["doc_id"]
    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
