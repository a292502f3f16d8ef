"""ISO media containers (operator 3).

``mux`` stores bytes as an uncompressed 8-bit grey video: frames of 24 x 24 samples in
one track of an ISO base media file.  ``probe`` walks the nested boxes of such a file
(or of any other one), decodes the sample tables and reports codec, duration and the
byte ranges of the key frames; it never looks into ``mdat``.  ``read_samples`` follows
the same tables to hand the stored bytes back.

Files of other writers may keep samples in fragments, in compact size tables or behind edit
lists; all of these are read.  ``duration`` is that of the samples, ``presented`` what the edit
list makes of it, both in the track's timescale.

Defined results: a null text is an empty one and is stored as one padded frame; a null
or damaged file or one without tracks gives null features and a text in ``error``, whatever the
damage: tables are held against the file's length before memory is taken for them, and boxes
nested deeper than ``MAX_DEPTH`` are damage.  Equal texts give equal files (no clock and no random
value is written); very long texts are stored whole.  Columns other than the one an
expression is built from are neither read nor changed, so clashing names are harmless.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pursebook.llm.common import byte_rows, column_function, read_table, record

FRAME_SIDE = 24
FRAME_BYTES = FRAME_SIDE * FRAME_SIDE
PAD = b"\xff"
TIMESCALE = 25
KEYFRAME_EVERY = 12
FRAMES_PER_CHUNK = 16
TAIL_BYTES = 32

#: Boxes that hold other boxes and nothing else.
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"})
#: No writer nests boxes nearly as deep.
MAX_DEPTH = 32
#: What reading a damaged file can raise.
DAMAGE = (ValueError, LookupError, ArithmeticError, MemoryError, struct.error)

FEATURES = record(
    codec=pa.string(), width=pa.int32(), height=pa.int32(), timescale=pa.int64(), duration=pa.int64(), presented=pa.int64(), n_samples=pa.int64(), n_keyframes=pa.int64(),
    keyframes=pa.list_(record(first=pa.int64(), length=pa.int64())), error=pa.string(),
)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
_HDLR = _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0")
_DINF = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
_STSD = _full(
    b"stsd",
    struct.pack(">I", 1),
    _box(
        b"raw ",
        struct.pack(">6xH16xHHIIIH32sHh", 1, FRAME_SIDE, FRAME_SIDE, 0x480000, 0x480000, 0, 1, b"", 40, -1),
    ),
)


def padded(data: bytes) -> bytes:
    """The bytes followed by 0xFF up to a positive whole number of frames."""
    return data + PAD * (-len(data) % FRAME_BYTES or (0 if data else FRAME_BYTES))


def mux_bytes(data: bytes) -> bytes:
    """One ISO media file that stores ``data`` as frames of raw 8-bit samples."""
    payload = padded(data)
    frames = len(payload) // FRAME_BYTES
    chunks = -(-frames // FRAMES_PER_CHUNK)
    last = frames - (chunks - 1) * FRAMES_PER_CHUNK
    runs = [(1, FRAMES_PER_CHUNK, 1)] if chunks > 1 else []
    if not runs or last != FRAMES_PER_CHUNK:
        runs.append((chunks, last, 1))
    keys = np.arange(1, frames + 1, KEYFRAME_EVERY, dtype=">u4")
    wide = len(payload) > 0xF000_0000

    def moov(first: int) -> bytes:
        places = first + np.arange(chunks, dtype=np.int64) * (FRAMES_PER_CHUNK * FRAME_BYTES)
        table = _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes())
        stbl = _box(
            b"stbl",
            _STSD,
            _full(b"stts", struct.pack(">III", 1, frames, 1)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME_BYTES, frames)),
            table,
        )
        return _box(
            b"moov",
            _full(b"mvhd", struct.pack(">4IIH10x", 0, 0, TIMESCALE, frames, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2)),
            _box(
                b"trak",
                _full(b"tkhd", struct.pack(">5I8x4H", 0, 0, 1, 0, frames, 0, 0, 0, 0), _MATRIX, struct.pack(">II", FRAME_SIDE << 16, FRAME_SIDE << 16), flags=7),
                _box(
                    b"mdia",
                    _full(b"mdhd", struct.pack(">4IHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)),
                    _HDLR,
                    _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _DINF, stbl),
                ),
            ),
        )

    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    first = len(_FTYP) + len(moov(0)) + len(head)
    return b"".join((_FTYP, moov(first), head, payload))


def placed_boxes(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """(path, first byte, first byte of the body, end) of every box, parents first."""
    open_boxes: list[tuple[tuple[bytes, ...], int, int]] = [((), 0, len(data))]
    while open_boxes:
        path, start, end = open_boxes.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("box header is cut off")
            (size,) = struct.unpack_from(">Q", data, start + 8)
            head = 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} runs past its parent")
        yield (*path, kind), start, start + head, start + size
        open_boxes.append((path, start + size, end))
        if kind in CONTAINERS:
            if len(path) >= MAX_DEPTH:
                raise ValueError("boxes nest too deep")
            open_boxes.append(((*path, kind), start + head, start + size))


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, first byte, end) of the body of every box, parents first."""
    for path, _, body, end in placed_boxes(data):
        yield path, body, end


class Layout:
    """Where the boxes of a file are: each track's, the defaults of its fragments, the
    fragments, and the movie's header."""

    def __init__(self, data: bytes):
        self.tracks: list[dict[bytes, tuple[int, int]]] = []
        self.defaults: dict[int, tuple[int, int, int]] = {}
        #: (place of the moof box, its runs: [tfhd, place of each trun])
        self.fragments: list[tuple[int, list[list]]] = []
        self.movie: int | None = None
        for path, at, a, b in placed_boxes(data):
            kind = path[-1]
            if kind == b"trak":
                self.tracks.append({})
            elif b"trak" in path and self.tracks:
                self.tracks[-1].setdefault(kind, (a, b))
            elif path == (b"moov", b"mvhd"):
                self.movie = a
            elif path == (b"moov", b"mvex", b"trex"):
                track, _, *default = struct.unpack_from(">5I", data, a + 4)
                self.defaults[track] = tuple(default)
            elif path == (b"moof",):
                self.fragments.append((at, []))
            elif path == (b"moof", b"traf"):
                self.fragments[-1][1].append([None])
            elif path == (b"moof", b"traf", b"tfhd"):
                self.fragments[-1][1][-1][0] = a
            elif path == (b"moof", b"traf", b"trun"):
                self.fragments[-1][1][-1].append((a, b))


def fields(data: bytes, at: int, flags: int, which: tuple[int, ...]) -> tuple[dict[int, int], int]:
    """(values of the optional 32-bit fields that the flags announce, place after them)."""
    found = {}
    for flag in which:
        if flags & flag:
            (found[flag],) = struct.unpack_from(">I", data, at)
            at += 4
    return found, at


NOT_A_KEY = 0x10000


def run_samples(data: bytes, place: tuple[int, int], base: int, after: int, default: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(offsets and sizes, durations, is it a key?, end of the data) of the samples of one run of a
    fragment.  Its data begin at a distance of ``base`` that it names, or else at ``after``."""
    at, end = place
    flags, n = struct.unpack_from(">II", data, at)
    flags &= 0xFFFFFF
    own, at = fields(data, at + 8, flags, (0x1, 0x4))
    start = base + struct.unpack(">i", struct.pack(">I", own[0x1]))[0] if 0x1 in own else after
    listed = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
    if n > len(data) or at + 4 * n * len(listed) > end:
        raise ValueError("a run holds more samples than the file can")
    table = np.frombuffer(data, ">u4", n * len(listed), at).astype(np.int64).reshape(n, -1) if listed and n else np.empty((n, len(listed)), np.int64)
    column = lambda flag, value: table[:, listed.index(flag)] if flag in listed else np.full(n, value, np.int64)
    durations, sizes, marks = (column(f, v) for f, v in zip((0x100, 0x200, 0x400), default))
    if n and 0x4 in own and 0x400 not in listed:
        marks[0] = own[0x4]
    ends = start + np.cumsum(sizes)
    return np.stack([ends - sizes, sizes], 1), durations, marks & NOT_A_KEY == 0, int(ends[-1]) if n else start


def fragment_samples(data: bytes, layout: Layout, track: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of a track in all fragments."""
    found = []
    for moof, runs in layout.fragments:
        after = moof
        for header, *places in runs:
            if header is None:
                raise ValueError("a fragment of no track")
            flags, of = struct.unpack_from(">II", data, header)
            flags &= 0xFFFFFF
            at, base = header + 8, moof if flags & 0x20000 else after
            if flags & 0x1:
                (base,) = struct.unpack_from(">Q", data, at)
                at += 8
            own, _ = fields(data, at, flags, (0x2, 0x8, 0x10, 0x20))
            default = tuple(own.get(f, v) for f, v in zip((0x8, 0x10, 0x20), layout.defaults.get(of, (0, 0, 0))))
            at = base
            for place in places:
                samples, durations, keys, at = run_samples(data, place, base, at, default)
                if of == track:
                    found.append((samples, durations, keys))
            after = at
    return found


def is_video(data: bytes, track: dict[bytes, tuple[int, int]]) -> bool:
    return b"hdlr" in track and data[track[b"hdlr"][0] + 8 : track[b"hdlr"][0] + 12] == b"vide"


def sample_sizes(data: bytes, track: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """The sizes of the samples, from the plain or the compact table."""
    if b"stsz" in track:
        at, _ = track[b"stsz"]
        fixed, n = struct.unpack_from(">II", data, at + 4)
        if fixed * n > len(data):
            raise ValueError("the samples are larger than the file")
        return np.full(n, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", n, at + 12).astype(np.int64) if n else np.empty(0, np.int64)
    at, _ = track[b"stz2"]
    bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    if bits not in (4, 8, 16) or n * bits > 8 * len(data):
        raise ValueError("a compact size table of unknown form")
    raw = np.frombuffer(data, ">u2" if bits == 16 else "u1", -(-n * bits // (16 if bits == 16 else 8)), at + 12).astype(np.int64) if n else np.empty(0, np.int64)
    return np.stack([raw >> 4, raw & 15], 1).reshape(-1)[:n] if bits == 4 else raw


def presented_time(data: bytes, track: dict[bytes, tuple[int, int]], layout: Layout, timescale: int, duration: int) -> int:
    """What the edit list shows of the track, in its timescale; all of it without one."""
    if b"elst" not in track or layout.movie is None:
        return duration
    movie = struct.unpack_from(">I", data, layout.movie + (20 if data[layout.movie] == 1 else 12))[0]
    at, _ = track[b"elst"]
    (n,) = struct.unpack_from(">I", data, at + 4)
    form = np.dtype([("time", ">u8"), ("from", ">i8"), ("rate", ">u4")] if data[at] == 1 else [("time", ">u4"), ("from", ">i4"), ("rate", ">u4")])
    times = np.frombuffer(data, form, n, at + 8)["time"] if n else []
    # An edit of no length shows all that fragments will bring.
    return sum(int(t) for t in times) * timescale // movie if len(times) and all(times) and movie else duration


def sample_table(data: bytes) -> dict:
    """Features of the first video track, or else of the first track, and (offset, size) of
    its samples, by its tables alone; other tracks have no width and height."""
    layout = Layout(data)
    if not layout.tracks:
        raise ValueError("no track")
    found = next((t for t in layout.tracks if is_video(data, t)), layout.tracks[0])
    for need in (b"mdhd", b"stsd", b"stts", b"stsc"):
        if need not in found:
            raise ValueError(f"no {need.decode()} box")
    if b"stsz" not in found and b"stz2" not in found:
        raise ValueError("no stsz box")
    a, _ = found[b"mdhd"]
    timescale = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
    a, _ = found[b"stsd"]
    codec = data[a + 12 : a + 16].decode("latin-1")
    width, height = struct.unpack_from(">HH", data, a + 40) if is_video(data, found) else (None, None)

    def ints(kind: bytes, skip: int, count: int, per: int = 1, form: str = ">u4") -> np.ndarray:
        return np.frombuffer(data, form, count * per, found[kind][0] + skip).astype(np.int64).reshape(-1, per) if count else np.empty((0, per), np.int64)

    def count(kind: bytes, skip: int = 4) -> int:
        return struct.unpack_from(">I", data, found[kind][0] + skip)[0]

    times = ints(b"stts", 8, count(b"stts"), 2)
    sizes = sample_sizes(data, found)
    n = len(sizes)
    kind = b"co64" if b"co64" in found else b"stco"
    places = ints(kind, 8, count(kind), 1, ">u8" if kind == b"co64" else ">u4")[:, 0] if kind in found else np.empty(0, np.int64)
    runs = ints(b"stsc", 8, count(b"stsc"), 3)
    if len(runs) and runs[0, 0] != 1:
        raise ValueError("the first chunk is not described")
    spans = np.diff(np.append(runs[:, 0], len(places) + 1))
    per_chunk = np.repeat(runs[:, 1], spans)
    if per_chunk.sum() != n:
        raise ValueError("the chunks do not hold as many samples as the size table")
    chunk_of = np.repeat(np.arange(len(places)), per_chunk) if n else np.empty(0, np.int64)
    before = np.cumsum(sizes) - sizes
    first_of_chunk = (np.cumsum(per_chunk) - per_chunk)[chunk_of] if n else chunk_of
    offsets = places[chunk_of] + before - before[first_of_chunk] if n else np.empty(0, np.int64)
    keys = ints(b"stss", 8, count(b"stss"))[:, 0] - 1 if b"stss" in found else np.arange(n)
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise ValueError("a key frame that is no sample")
    duration = sum(a * b for a, b in times.tolist())
    if layout.fragments:
        track = struct.unpack_from(">I", data, found[b"tkhd"][0] + (20 if data[found[b"tkhd"][0]] == 1 else 12))[0]
        runs = fragment_samples(data, layout, track)
        samples = np.concatenate([np.stack([offsets, sizes], 1), *(s for s, _, _ in runs)])
        keys = np.append(keys, n + np.flatnonzero(np.concatenate([k for *_, k in runs]))) if runs else keys
        offsets, sizes = samples[:, 0], samples[:, 1]
        duration += sum(int(d.sum()) for _, d, _ in runs)
    if len(sizes) and (int(offsets.min()) < 0 or int((offsets + sizes).max()) > len(data)):
        raise ValueError("a sample lies outside the file")
    presented = presented_time(data, found, layout, timescale, duration)
    if max(duration, presented) >= 1 << 63:
        raise ValueError("a duration that no number holds")
    return {"codec": codec, "width": width, "height": height, "timescale": timescale, "duration": duration, "presented": presented, "offsets": offsets, "sizes": sizes, "keys": keys}


def features(data: bytes | None) -> dict:
    if data is None:
        return {"error": "no file"}
    try:
        t = sample_table(data)
    except DAMAGE as e:
        return {"error": (str(e) or type(e).__name__)[:200]}
    keys = [{"first": int(a), "length": int(b)} for a, b in zip(t["offsets"][t["keys"]], t["sizes"][t["keys"]])]
    return {k: t[k] for k in ("codec", "width", "height", "timescale", "duration", "presented")} | {"n_samples": len(t["sizes"]), "n_keyframes": len(keys), "keyframes": keys, "error": None}


def sample_bytes(data: bytes) -> bytes:
    t = sample_table(data)
    offsets, sizes = t["offsets"], t["sizes"]
    if not len(sizes):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    starts, ends = np.append(0, breaks), np.append(breaks, len(sizes)) - 1
    return b"".join(data[offsets[a] : offsets[b] + sizes[b]] for a, b in zip(starts, ends))


@column_function(pa.binary())
def mux(text: pa.Array) -> pa.Array:
    """text or binary -> the bytes of an ISO media file."""
    return pa.array([mux_bytes(x) for x in byte_rows(text)], pa.binary())


@column_function(FEATURES)
def probe(media: pa.Array) -> pa.Array:
    """File -> codec, size, duration, sample count and key-frame byte ranges."""
    return pa.array([features(x.as_py()) for x in media], FEATURES)


@column_function(pa.binary())
def read_samples(media: pa.Array) -> pa.Array:
    """File -> its samples in decoding order, joined; null where the file is damaged."""
    out = []
    for x in media:
        try:
            out.append(None if x.as_py() is None else sample_bytes(x.as_py()))
        except DAMAGE:
            out.append(None)
    return pa.array(out, pa.binary())


_DIGEST = record(payload_bytes=pa.int64(), payload_sha256=pa.string(), tail_crc32=pa.int64(), media_bytes=pa.int64(), media_sha256=pa.string(), feature=pa.string())


@column_function(_DIGEST)
def digest(media: pa.Array) -> pa.Array:
    """What the contract query reports of one stored file, all of it read back from the file."""
    rows = []
    for x in media:
        m = x.as_py()
        f, payload = features(m), sample_bytes(m)
        ranges = ";".join(f"{k['first']}+{k['length']}" for k in f["keyframes"])
        rows.append({
            "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-TAIL_BYTES:]),
            "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(),
            "feature": f"{f['codec'].strip()} {f['width']}x{f['height']} {f['duration']}/{f['timescale']}s samples={f['n_samples']} keyframes={f['n_keyframes']} ranges={hashlib.sha256(ranges.encode()).hexdigest()[:16]}",
        })
    return pa.array(rows, _DIGEST)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        digest(mux("text")).alias("r"),
    ).select("doc_id", "n_bytes", "r.*")
