import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pursebook.llm import media


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 16, 576 * 16 + 1, 576 * 40 + 5, 1_000_003])
def test_round_trip_and_tables(n):
    data = bytes(i * 7 % 251 for i in range(n))
    f = media.mux_bytes(data)
    payload = media.sample_bytes(f)
    assert payload == media.padded(data) and len(payload) % 576 == 0 and payload[:n] == data and set(payload[n:]) <= {255}
    x = media.features(f)
    frames = len(payload) // 576
    assert (x["codec"], x["width"], x["duration"], x["n_samples"], x["error"]) == ("raw ", 24, frames, frames, None)
    assert x["n_keyframes"] == -(-frames // media.KEYFRAME_EVERY)
    for i, k in enumerate(x["keyframes"]):
        assert f[k["first"] : k["first"] + k["length"]] == payload[i * 12 * 576 : (i * 12 + 1) * 576]


def test_damaged_files_have_an_error():
    f = media.mux_bytes(b"x" * 3000)
    for bad in (b"", b"abc", f[:40], f[:-1], f[:4] + b"zzzz" + f[8:20], struct.pack(">I4s", 4, b"moov")):
        assert media.features(bad)["error"]
    assert media.features(None)["error"] == "no file"


def boxes(data):
    """Top-level boxes by kind."""
    out, at = {}, 0
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        out[kind] = data[at : at + size]
        at += size
    return out


def test_audio_has_no_picture_size():
    f = media.mux_bytes(b"x" * 3000)
    sound = f.replace(b"vide", b"soun", 1)
    x = media.features(sound)
    assert (x["width"], x["height"], x["error"], x["n_samples"]) == (None, None, None, media.features(f)["n_samples"])


def rebuilt(data, swap):
    """The boxes with some of them exchanged, at any depth."""
    out, at = b"", 0
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + size]
        out += swap[kind] if kind in swap else media._box(kind, rebuilt(body, swap) if kind in media.CONTAINERS else body)
        at += size
    return out


def fragmented(data, per=5, base_is_moof=True, offsets=True, track=1):
    """The same frames as mux_bytes stores, in fragments of two runs each."""
    box, full = media._box, media._full
    payload = media.padded(data)
    frames = [payload[i : i + 576] for i in range(0, len(payload), 576)]
    none = {k: full(k, bytes(4)) for k in (b"stts", b"stsc", b"stco")} | {b"stsz": full(b"stsz", bytes(8)), b"stss": b""}
    moov = rebuilt(boxes(media.mux_bytes(data))[b"moov"], none)
    trex = full(b"trex", struct.pack(">5I", track, 1, 1, 576, media.NOT_A_KEY))
    moov = box(b"moov", moov[8:], box(b"mvex", trex))
    out = media._FTYP + moov
    for i in range(0, len(frames), 2 * per):
        runs = [frames[i : i + per], frames[i + per : i + 2 * per]]

        def moof(first):
            truns = []
            for k, run in enumerate(runs):
                flags = 0x400 | (0x1 if offsets and k == 0 else 0) | (0x200 if k else 0)
                rows = b"".join((struct.pack(">I", len(r)) if k else b"") + struct.pack(">I", 0 if (i + k * per + j) % media.KEYFRAME_EVERY == 0 else media.NOT_A_KEY) for j, r in enumerate(run))
                truns.append(full(b"trun", struct.pack(">I", len(run)), struct.pack(">i", first) if flags & 1 else b"", rows, flags=flags))
            tfhd = full(b"tfhd", struct.pack(">I", track), b"" if base_is_moof else struct.pack(">Q", len(out) if offsets else len(out) + first), flags=0x20000 if base_is_moof else 1)
            return box(b"moof", full(b"mfhd", struct.pack(">I", i)), box(b"traf", tfhd, *truns))

        out += moof(len(moof(0)) + 8) + box(b"mdat", *runs[0], *runs[1])
    return out


@pytest.mark.parametrize("base_is_moof,offsets", [(True, True), (False, True), (False, False)])
@pytest.mark.parametrize("n", [0, 1, 576 * 5, 576 * 31 + 7])
def test_fragments_have_the_features_of_their_plain_twin(base_is_moof, offsets, n):
    data = bytes(i * 5 % 253 for i in range(n))
    plain, split = media.mux_bytes(data), fragmented(data, base_is_moof=base_is_moof, offsets=offsets)
    a, b = media.features(plain), media.features(split)
    assert b["error"] is None and {k: v for k, v in a.items() if k != "keyframes"} == {k: v for k, v in b.items() if k != "keyframes"}
    cut = lambda f, x: [f[k["first"] : k["first"] + k["length"]] for k in x["keyframes"]]
    assert cut(plain, a) == cut(split, b) and media.sample_bytes(split) == media.padded(data)


def replaced(f, kind, new):
    """The file with one box of the track exchanged for another of any length."""
    at = f.index(kind) - 4
    old = struct.unpack_from(">I", f, at)[0]
    grown = len(new) - old
    for outer in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
        p = f.index(outer) - 4
        f = f[:p] + struct.pack(">I", struct.unpack_from(">I", f, p)[0] + grown) + f[p + 4 :]
    f = f[:at] + new + f[at + old :]
    p = f.index(b"stco") + 8
    n = struct.unpack_from(">I", f, p)[0]
    return f[: p + 4] + b"".join(struct.pack(">I", x + grown) for x in struct.unpack_from(f">{n}I", f, p + 4)) + f[p + 4 + 4 * n :]


def test_compact_size_tables():
    f = media.mux_bytes(b"q" * 3000)
    compact = replaced(f, b"stsz", media._full(b"stz2", struct.pack(">II6H", 16, 6, *[576] * 6)))
    a, b = media.features(f), media.features(compact)
    assert b["error"] is None and [k["length"] for k in b["keyframes"]] == [k["length"] for k in a["keyframes"]] and media.sample_bytes(compact) == media.sample_bytes(f)
    table = lambda bits, body, n: media.sample_sizes(t := media._full(b"stz2", struct.pack(">II", bits, n), body), {b"stz2": (8, len(t))}).tolist()
    assert table(8, bytes([3, 200]), 2) == [3, 200] and table(4, bytes([0x12, 0x30]), 3) == [1, 2, 3]


def test_edit_lists():
    f = media.mux_bytes(b"q" * 3000)
    assert media.features(f)["presented"] == 6
    media_box = f.index(b"mdia") - 4
    for version, times, want in ((0, [(2, 0), (3, 1)], 5), (1, [(4, -1)], 4), (0, [(0, 0)], 6), (0, [], 6)):
        elst = media._full(b"elst", struct.pack(">I", len(times)), *(struct.pack(">QqI" if version else ">IiI", *t, 0x10000) for t in times))
        edts = media._box(b"edts", elst[:8] + bytes([version]) + elst[9:])
        g = f[:media_box] + edts + f[media_box:]
        for outer in (b"moov", b"trak"):
            p = g.index(outer) - 4
            g = g[:p] + struct.pack(">I", struct.unpack_from(">I", g, p)[0] + len(edts)) + g[p + 4 :]
        p = g.index(b"stco") + 12
        g = g[:p] + struct.pack(">I", struct.unpack_from(">I", g, p)[0] + len(edts)) + g[p + 4 :]
        x = media.features(g)
        assert (x["presented"], x["duration"], x["error"]) == (want, 6, None)


def test_tables_that_ask_for_more_than_the_file_has():
    f = media.mux_bytes(b"x" * 3000)
    at = f.index(b"stsz") + 8
    for fixed, n in ((8, 0xFFFFFFFF), (1, 0xFFFFFFFF), (0, 0xFFFFFFFF), (0xFFFFFFFF, 6)):
        assert media.features(f[:at] + struct.pack(">II", fixed, n) + f[at + 8 :])["error"]
    deep = b""
    for _ in range(1500):
        deep = media._box(b"moov", deep)
    assert "deep" in media.features(deep)["error"]
    at = f.index(b"stss") + 12
    assert media.features(f[:at] + bytes(4) + f[at + 4 :])["error"] and media.features(f[:at] + struct.pack(">I", 7) + f[at + 4 :])["error"]


@pytest.mark.parametrize("make", [media.mux_bytes, fragmented])
def test_flipped_bytes_never_end_a_job(make):
    rng, f = random.Random(5), make(bytes(range(256)) * 20)
    head = f.index(b"mdat")
    for _ in range(3000):
        g = bytearray(f)
        for _ in range(rng.choice([1, 1, 2, 8])):
            g[rng.randrange(head if rng.random() < 0.9 else len(f))] = rng.choice([0, 1, 127, 128, 255, rng.randrange(256)])
        x = media.features(bytes(g))
        assert x["error"] or x["n_samples"] is not None
    for n in range(0, len(f), 7):
        media.features(f[:n])


def test_the_video_track_is_found_behind_an_audio_track():
    f = media.mux_bytes(b"x" * 3000)
    parts = boxes(f)
    moov = parts[b"moov"]
    at = moov.index(b"trak") - 4
    trak = moov[at : at + struct.unpack_from(">I", moov, at)[0]]
    sound = trak.replace(b"vide", b"soun", 1).replace(b"stts", b"free", 1)  # its tables are of no use
    both = struct.pack(">I", len(moov) + len(sound)) + moov[4:at] + sound + moov[at:]
    x = media.features(parts[b"ftyp"] + both + parts[b"mdat"] + bytes(len(sound)))
    assert x["width"] == 24 and x["n_samples"] == media.features(f)["n_samples"]


def test_walk_reads_long_and_open_boxes():
    inner = struct.pack(">I4s", 0, b"free") + b"12"
    big = struct.pack(">I4sQ", 1, b"moov", 16 + len(inner)) + inner
    assert [(p[-1], e - s) for p, s, e in media.walk(big)] == [(b"moov", 10), (b"free", 2)]


def test_columns_nulls_repeats_and_clashes(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "é" * 400, "c"), (3, "é" * 400, "c")], "doc_id int, text string, codec string")
    out = df.select("doc_id", "codec", media.probe(media.mux("text")).alias("p"), media.read_samples(media.mux("text")).alias("b"))
    rows = out.orderBy("doc_id").collect()
    assert rows[0].p == rows[1].p and rows[0].codec == "a" and rows[2] == rows[3]
    assert bytes(rows[2].b) == media.padded("é".encode() * 400)
    assert df.where("false").select(media.probe(media.mux("text"))).count() == 0
    assert spark.range(1).select(media.read_samples(F.lit(b"junk")).alias("b")).first().b is None


def test_query(spark, sf_dir, rows_of):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = rows_of(media.op3_media_columns(spark, sf_dir), "doc_id")
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        p = media.padded(text.encode())
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(text.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        f, frames = media.mux_bytes(text.encode()), len(p) // 576
        assert f.endswith(p) and (got[i].media_bytes, got[i].media_sha256) == (len(f), hashlib.sha256(f).hexdigest())
        first = len(f) - len(p)
        ranges = ";".join(f"{first + k * 576}+576" for k in range(0, frames, media.KEYFRAME_EVERY))
        assert got[i].feature == f"raw 24x24 {frames}/25s samples={frames} keyframes={-(-frames // media.KEYFRAME_EVERY)} ranges={hashlib.sha256(ranges.encode()).hexdigest()[:16]}"
