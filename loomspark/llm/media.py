"""ISO media containers: boxes, sample tables and keyframe byte ranges, without decoding payloads.

`mux` stores a byte string losslessly as one track of fixed-size 8-bit samples; `demux` walks the nested
boxes of any such file and `read_track` resolves the sample tables (stts, ctts, stsc, stsz or stz2, stco
or co64, stss) to the byte range of every sample; samples of movie fragments (moof, traf, tfhd, trun, with the
defaults of trex) follow those. Codec, duration and keyframe ranges come from these tables alone.

`tracks` does this for a column of files and `containers` for texts, which it stores as files first. Both give all
keyframe ranges. A file that can't be read gives a row whose `error` says why, and nulls; it never ends the job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

SAMPLE = 576  # bytes: a 24 x 24 picture of 8-bit grey
SIDE = 24
RATE = 25  # samples a second
KEY_EVERY = 25  # every so many samples is a keyframe
CHUNK = 64  # samples in a chunk
#: Fixed values of the format: boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: Fixed values of the format: the unit matrix of movie and track headers.
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body) + 8
    return struct.pack(">I4s", n, kind) + body if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8) + body


def full(kind: bytes, *parts: bytes, flags: int = 0, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes) -> bytes:
    """An MP4 file whose only track holds the payload, a positive multiple of 576 bytes, sample by sample."""
    if not payload or len(payload) % SAMPLE:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    n = len(payload) // SAMPLE
    chunks = -(-n // CHUNK)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    head = struct.pack(">I4s", len(payload) + 8, b"mdat") if len(payload) + 8 < 1 << 32 else struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16)
    first = len(ftyp) + len(head)
    starts = first + np.arange(chunks, dtype=np.int64) * CHUNK * SAMPLE
    wide = int(starts[-1]) >= 1 << 32
    offsets = full(b"co64" if wide else b"stco", struct.pack(">I", chunks), starts.astype(">u8" if wide else ">u4").tobytes())
    runs = [(1, min(CHUNK, n))] if n <= CHUNK or n % CHUNK == 0 else [(1, CHUNK), (chunks, n % CHUNK)]
    keys = np.arange(1, n + 1, KEY_EVERY).astype(">u4")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, 1)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", c, s, 1) for c, s in runs)),
        full(b"stsz", struct.pack(">II", SAMPLE, n)),
        full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        offsets,
    )
    minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", struct.pack(">I4s", 0, b"vide"), bytes(12), b"samples\0"), minf)
    tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0, 0), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
    mvhd = full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
    return ftyp + head + payload + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


def walk(data, start: int = 0, end: int | None = None, path: tuple = ()):
    """(path, body start, body end) of every box, parents first. A box that overruns its parent ends there."""
    end = len(data) if end is None else end
    todo = [(start, end, path)]
    while todo:
        at, stop, over = todo.pop(0)
        while at + 8 <= stop:
            size, kind = struct.unpack_from(">I4s", data, at)
            body = at + 8
            if size == 1:
                if at + 16 > stop:
                    break
                size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
            elif size == 0:
                size = stop - at
            if size < body - at:
                break
            last = min(at + size, stop)
            yield (*over, kind), body, last
            if kind in CONTAINERS:
                todo.append((body, last, (*over, kind)))
            at += size


class Damaged(ValueError):
    """A file whose boxes or tables don't hold what they say."""


@dataclass
class Track:
    number: int = 0
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # sample numbers from 0

    def key_ranges(self) -> list[tuple[int, int]]:
        """Byte range (start, end) of each keyframe."""
        a = self.offsets[self.keys]
        return list(zip(a.tolist(), (a + self.sizes[self.keys]).tolist(), strict=True))

    def payload(self, data: bytes) -> bytes:
        """The samples' bytes in order; neighbours are sliced together."""
        if not len(self.offsets):
            return b""
        ends = self.offsets + self.sizes
        cut = np.flatnonzero(self.offsets[1:] != ends[:-1]) + 1
        return b"".join(data[a:b] for a, b in zip(self.offsets[np.r_[0, cut]].tolist(), ends[np.r_[cut - 1, len(ends) - 1]].tolist(), strict=True))


def _held(data, count: int) -> int:
    """A number of samples that a file of this length can hold."""
    if not 0 <= count <= len(data):
        raise ValueError(f"{count} samples in {len(data)} bytes")
    return int(count)


def _u32(data, at: int, n: int, kind: str = ">u4") -> np.ndarray:
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def read_track(data, tables: dict[bytes, tuple[int, int]]) -> Track:
    """Resolve one track's tables to sample offsets, sizes, times and keyframes."""
    t = Track()
    if b"tkhd" in tables:
        at = tables[b"tkhd"][0]
        t.number = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
    if b"mdhd" in tables:
        at = tables[b"mdhd"][0]
        t.timescale, t.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    if b"hdlr" in tables:
        t.handler = bytes(data[tables[b"hdlr"][0] + 8 : tables[b"hdlr"][0] + 12]).decode("latin-1")
    if b"stsd" in tables:
        t.codec = bytes(data[tables[b"stsd"][0] + 12 : tables[b"stsd"][0] + 16]).decode("latin-1")
    if b"stsz" in tables:
        at = tables[b"stsz"][0]
        each, n = struct.unpack_from(">II", data, at + 4)
        t.sizes = np.full(_held(data, n), each, np.int64) if each else _u32(data, at + 12, n)
    elif b"stz2" in tables:
        at = tables[b"stz2"][0]
        bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if bits == 4:
            raw = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 12)
            t.sizes = np.stack((raw >> 4, raw & 15), 1).ravel()[:n].astype(np.int64)
        else:
            t.sizes = _u32(data, at + 12, n, ">u2" if bits == 16 else ">u1")
    n = len(t.sizes)
    wide = b"co64" in tables
    if n and (wide or b"stco" in tables) and b"stsc" in tables:
        at = tables[b"co64" if wide else b"stco"][0]
        chunks = _u32(data, at + 8, struct.unpack_from(">I", data, at + 4)[0], ">u8" if wide else ">u4")
        at = tables[b"stsc"][0]
        runs = _u32(data, at + 8, 3 * struct.unpack_from(">I", data, at + 4)[0]).reshape(-1, 3)
        per = np.repeat(runs[:, 1], np.diff(np.r_[runs[:, 0] - 1, len(chunks)]))
        _held(data, per.sum())
        chunk = np.repeat(np.arange(len(per)), per)[:n]
        n = len(chunk)
        t.sizes = t.sizes[:n]
        begun = np.cumsum(t.sizes) - t.sizes
        first = np.r_[True, chunk[1:] != chunk[:-1]] if n else np.empty(0, bool)
        t.offsets = chunks[chunk] + begun - np.maximum.accumulate(np.where(first, begun, 0)) if n else np.empty(0, np.int64)
    if b"stts" in tables:
        at = tables[b"stts"][0]
        runs = _u32(data, at + 8, 2 * struct.unpack_from(">I", data, at + 4)[0]).reshape(-1, 2)
        _held(data, runs[:, 0].sum())
        step = np.repeat(runs[:, 1], runs[:, 0])
        t.times = np.cumsum(step) - step
        if b"ctts" in tables:
            at = tables[b"ctts"][0]
            runs = _u32(data, at + 8, 2 * struct.unpack_from(">I", data, at + 4)[0]).reshape(-1, 2)
            _held(data, runs[:, 0].sum())
            shift = np.repeat(runs[:, 1], runs[:, 0])[: len(t.times)]
            t.times[: len(shift)] += shift
    if b"stss" in tables:
        at = tables[b"stss"][0]
        t.keys = _u32(data, at + 8, struct.unpack_from(">I", data, at + 4)[0]) - 1
        t.keys = t.keys[(t.keys >= 0) & (t.keys < n)]
    else:
        t.keys = np.arange(n)  # without the table every sample is one
    return t


def _fragment(data, traf: dict[bytes, list[tuple[int, int]]], moof: int, defaults: dict[int, tuple], tracks: list[Track]) -> None:
    """Add one track fragment's samples to its track."""
    if b"tfhd" not in traf:
        return
    at = traf[b"tfhd"][0][0]
    flags, number = struct.unpack_from(">II", data, at)
    flags &= 0xFFFFFF
    at += 8
    base, (span, size, kind) = moof, defaults.get(number, (0, 0, 0))
    if flags & 0x1:
        base, at = struct.unpack_from(">Q", data, at)[0], at + 8
    at += 4 * bool(flags & 0x2)
    if flags & 0x8:
        span, at = struct.unpack_from(">I", data, at)[0], at + 4
    if flags & 0x10:
        size, at = struct.unpack_from(">I", data, at)[0], at + 4
    if flags & 0x20:
        kind = struct.unpack_from(">I", data, at)[0]
    track = next((t for t in tracks if t.number == number), None)
    if track is None:
        return
    clock = int(track.times[-1]) + span if len(track.times) else 0
    if b"tfdt" in traf:
        at = traf[b"tfdt"][0][0]
        clock = struct.unpack_from(">Q" if data[at] == 1 else ">I", data, at + 4)[0]
    place = base
    for run, _ in traf.get(b"trun", []):
        flags, n = struct.unpack_from(">II", data, run)
        flags, n = flags & 0xFFFFFF, _held(data, n)
        at = run + 8
        if flags & 0x1:
            place, at = base + struct.unpack_from(">i", data, at)[0], at + 4
        first = None
        if flags & 0x4:
            first, at = struct.unpack_from(">I", data, at)[0], at + 4
        fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        table = _u32(data, at, n * len(fields)).reshape(n, len(fields)) if fields else np.empty((n, 0), np.int64)
        column = lambda bit, default: table[:, fields.index(bit)] if bit in fields else np.full(n, default, np.int64)  # noqa: B023, E731
        spans, sizes, kinds, shift = column(0x100, span), column(0x200, size), column(0x400, kind), column(0x800, 0)
        if first is not None and n:
            kinds = np.r_[first, kinds[1:]]
        shift = np.where(shift >= 1 << 31, shift - (1 << 32), shift)
        old = len(track.sizes)
        track.keys = np.r_[track.keys, old + np.flatnonzero(kinds & 0x10000 == 0)]
        track.offsets = np.r_[track.offsets, place + np.cumsum(sizes) - sizes]
        track.sizes = np.r_[track.sizes, sizes]
        track.times = np.r_[track.times, clock + np.cumsum(spans) - spans + shift]
        place, clock = place + int(sizes.sum()), clock + int(spans.sum())
        track.duration = max(track.duration, clock)


def demux(data: bytes) -> list[Track]:
    """The tracks of a file, in order. A file without any gives an empty list; tables that don't fit the file raise Damaged."""
    traks: list[tuple[int, int, dict]] = []
    trafs: list[tuple[int, int, int, dict]] = []
    moofs: list[tuple[int, int, int]] = []
    defaults: dict[int, tuple] = {}
    try:
        for path, a, b in walk(data):
            if path == (b"moov", b"trak"):
                traks.append((a, b, {}))
            elif path[:2] == (b"moov", b"trak"):
                for own in traks:
                    if own[0] <= a and b <= own[1]:
                        own[2].setdefault(path[-1], (a, b))
            elif path == (b"moov", b"mvex", b"trex"):
                number, _, *rest = struct.unpack_from(">5I", data, a + 4)
                defaults[number] = tuple(rest)
            elif path == (b"moof",):
                moofs.append((a - 8 if struct.unpack_from(">I", data, a - 8)[0] != 1 else a - 16, a, b))
            elif path == (b"moof", b"traf"):
                trafs.append((next(m[0] for m in moofs if m[1] <= a and b <= m[2]), a, b, {}))
            elif path[:2] == (b"moof", b"traf"):
                for own in trafs:
                    if own[1] <= a and b <= own[2]:
                        own[3].setdefault(path[-1], []).append((a, b))
        tracks = [read_track(data, own[2]) for own in traks]
        for moof, _, _, traf in trafs:
            _fragment(data, traf, moof, defaults, tracks)
    except (struct.error, ValueError, IndexError, OverflowError, MemoryError, StopIteration) as e:
        raise Damaged(f"a table doesn't fit the file: {e}") from e
    for t in tracks:
        if len(t.offsets) and (t.offsets.min() < 0 or int((t.offsets + t.sizes[: len(t.offsets)]).max()) > len(data)):
            raise Damaged("samples lie beyond the file")
    return tracks


def features(track: Track) -> str:
    """codec|timescale|duration|samples|keyframes|crc32 of the keyframes' byte ranges."""
    a = track.offsets[track.keys] if len(track.offsets) else np.empty(0, np.int64)
    ranges = np.stack((a, a + track.sizes[track.keys][: len(a)]), 1).astype("<i8").tobytes() if len(a) else b""
    return f"{track.codec}|{track.timescale}|{track.duration}|{len(track.sizes)}|{len(track.keys)}|{zlib.crc32(ranges):08x}"


def pad(raw: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of 576."""
    return raw.ljust(max(1, -(-len(raw) // SAMPLE)) * SAMPLE, b"\xff")


RANGES = "array<struct<start: long, end: long>>"
COLUMNS = f"n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, n_keyframes long, key_ranges {RANGES}"
TRACKS = f"track int, codec string, handler string, timescale long, duration_s double, n_samples long, n_keyframes long, key_ranges {RANGES}, error string"


def _ranges(lists: list):
    """Arrow column of lists of (start, end)."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.array([r if r is None else [{"start": a, "end": b} for a, b in r] for r in lists], kind)


def tracks(files: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """(id, track, codec, handler, timescale, duration_s, n_samples, n_keyframes, key_ranges, error) of a binary column of files.

    One row a track, numbered from 0, from boxes and tables alone. A null file, one without tracks or a damaged one gives
    one row with an error and nulls. A narrow pass; repeated rows are read again.
    """
    import pyarrow as pa

    from ._common import ship, tidied

    ship(files.sparkSession)
    names = [f.split()[0] for f in TRACKS.split(", key_ranges")[0].split(", ")]

    def rows(data):
        if data is None:
            return [(None,) * 8 + ("no file",)]
        try:
            found = demux(data)
        except Damaged as e:
            return [(None,) * 8 + (str(e),)]
        if not found:
            return [(None,) * 8 + ("no tracks",)]
        return [(i, t.codec, t.handler, t.timescale, t.duration / t.timescale if t.timescale else None, len(t.sizes), len(t.keys), t.key_ranges() if len(t.offsets) else [], None) for i, t in enumerate(found)]

    kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())

    def run(parts):
        for part in parts:
            for start in range(0, part.num_rows, 50):
                own = part.slice(start, 50)
                made = [rows(d) for d in own.column(1).to_pylist()]
                ids = own.column(0).take(pa.array(np.repeat(np.arange(own.num_rows), [len(m) for m in made])))
                cols = list(zip(*[r for m in made for r in m], strict=True))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False)), _ranges(cols[7]), pa.array(cols[8], pa.string())], ["id", *names, "key_ranges", "error"])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(files[id_col].alias("id"), files[media_col].cast("binary").alias("media")).mapInArrow(tidied(run), f"id {kind}, {TRACKS}").withColumnRenamed("id", id_col)


def containers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each text as a media file, read it back through its tables, and return digests and features.

    One narrow pass. Null text is empty: one sample of padding. With keep_media the file itself is a column.
    """
    import pyarrow as pa

    from ._common import ship, tidied

    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("n_keyframes", pa.int64())]
    names = ["id", *[n for n, _ in schema], "key_ranges", *["media"] * keep_media]

    def one(text: str | None) -> tuple:
        raw = (text or "").encode()
        data = mux(pad(raw))
        track = demux(data)[0]
        back = track.payload(data)
        ranges = track.key_ranges()
        return (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(track), track.codec, track.duration / track.timescale, len(ranges), ranges, data if keep_media else None)

    def run(parts):
        for part in parts:
            for start in range(0, part.num_rows, 500):
                own = part.slice(start, 500)
                cols = list(zip(*map(one, own.column(1).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array(c, t) for c, (_, t) in zip(cols, schema, strict=False)), _ranges(cols[10]), *[pa.array(cols[11], pa.binary())] * keep_media], names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(tidied(run), f"id {id_type}, {COLUMNS}" + ", media binary" * keep_media).withColumnRenamed("id", id_col)
