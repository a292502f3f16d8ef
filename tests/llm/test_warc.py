import hashlib

import pytest

from pursebook.llm import warc
from pursebook.llm.common import stored

PAGES = [(5, "u", "A" * 50000), (3, "v", "A" * 50000), (9, "w", "A" * 50000), (1, None, None), (2, "x y\r\n", "short"), (4, "z", "short"), (7, "q", "é" * 40000), (7, "q", "é" * 40000), (None, "n", "B" * 500), (8, "n", "B" * 500), (6, "m", "C" * 100), (16, "m", "C" * 100), (26, "m", "D" * 99), (27, "m", "D" * 99)]


@pytest.mark.parametrize("segment,archive", [(700, 3000), (1 << 14, 4 << 20)])
def test_archives_round_trip(spark, segment, archive):
    df = spark.createDataFrame([(*p, "c") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    back = warc.read_archives(stored(warc.write_archives(df, segment_bytes=segment, archive_bytes=archive), "t")).collect()
    distinct = set(PAGES)
    assert len(back) == len(distinct) and not any(r.error for r in back)
    digest = {(p, hashlib.sha256((h or "").encode()).hexdigest(), len((h or "").encode())) for p, _, h in distinct}
    got = {(int(x) if (x := r.record_id.split(":")[2]) else None, r.payload_digest, r.payload_bytes) for r in back}
    assert got == digest
    page = lambda x: x and x.split(":")[2]
    kinds = {page(r.record_id): (r.kind, page(r.refers_to)) for r in back}
    assert kinds == {"3": ("response", None), "5": ("revisit", "3"), "9": ("revisit", "3"), "1": ("response", None), "2": ("response", None), "4": ("response", None), "7": ("response", None),
                     "": ("revisit", "8"), "8": ("response", None), "6": ("response", None), "16": ("revisit", "6"), "26": ("response", None), "27": ("response", None)}
    responses = {r.record_id for r in back if r.kind == "response"}
    assert {r.refers_to for r in back if r.kind == "revisit"} <= responses


def test_damaged_archives_give_error_rows(spark):
    html = b"x" * 300
    good = b"".join(warc.records_of(1, "u", html, hashlib.sha256(html).hexdigest(), None, 1000))
    other = b"".join(warc.records_of(2, "u", html, hashlib.sha256(html).hexdigest(), None, 1000))
    gz = lambda raw: __import__("gzip").compress(raw)
    read = lambda *data: warc.read_archives(spark.createDataFrame([(bytearray(x),) for x in data], "data binary")).collect()
    assert [(r.record_id, bool(r.error)) for r in read(b"junk bytes, no archive")] == [(None, True)]
    mixed = read(b"junk" + good + b"\x00\x01junk" + other[:-9] + good[:20] + other)
    assert sum(r.payload_bytes == 300 and not r.error for r in mixed) == 2 and sum(bool(r.error) for r in mixed) >= 3
    nameless = read(gz(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), gz(b"no record"), gz(b""))
    assert [(r.record_id, bool(r.error), r.copies) for r in nameless] == [(None, True, 1)] * 3
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\n"
    for tail in (b"", b"Content-Length: x\r\n", b"Content-Length: 50\r\n", b"Content-Length: -1\r\n", b"Content-Length: 0\r\nWARC-Segment-Number: one\r\n"):
        assert [(r.record_id, bool(r.error), r.payload_bytes) for r in read(gz(head + tail + b"\r\n\r\n\r\n"))] == [("<r>", True, None)]
    bad_chunk = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n-5\r\nabc"
    assert read(gz(head + b"Content-Length: %d\r\n\r\n" % len(bad_chunk) + bad_chunk + b"\r\n\r\n"))[0].error


def test_reading_is_linear_in_the_archive():
    html = b"y" * 200
    member = b"".join(warc.records_of(1, "u", html, hashlib.sha256(html).hexdigest(), None, 1000))
    found = list(warc.members(member * 30_000))
    assert len(found) == 30_000 and all(e is None for _, e in found)


def test_very_long_page(spark):
    html = "é" * 6_000_000
    df = spark.createDataFrame([(1, "u", html), (2, "v", html)], "page_id long, url string, html string")
    back = {r.record_id.split(":")[2]: r for r in warc.read_archives(stored(warc.write_archives(df), "long")).collect()}
    assert back["1"].payload_digest == hashlib.sha256(html.encode()).hexdigest() and back["2"].kind == "revisit" and not back["1"].error


def test_lost_and_wrong_segments_are_errors(spark):
    html = b"x" * 5000
    parts = list(warc.records_of(1, "u", html, hashlib.sha256(html).hexdigest(), None, 1000))
    assert len(parts) == 6

    def read(members):
        return warc.read_archives(spark.createDataFrame([(bytearray(b"".join(members)),)], "data binary")).collect()

    whole = read(reversed(parts))
    assert [(r.payload_bytes, r.error) for r in whole] == [(5000, None)]
    assert [(r.payload_bytes, r.error) for r in read([*parts, parts[2]])] == [(5000, None)]
    assert "consecutive" in read(parts[:2] + parts[3:])[0].error
    assert "declared" in read(parts[:-1])[0].error
    assert read([])  == []


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 9000])
def test_chunked_framing(n):
    data = bytes(i % 256 for i in range(n))
    assert warc.unframe_chunks(warc.frame_chunks(data)) == data
    with pytest.raises(ValueError):
        warc.unframe_chunks(warc.frame_chunks(data)[:-5])


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(stored(warc.write_archives(df), "e")).count() == 0


def test_every_row_of_repeated_pages_comes_back(spark, tmp_path):
    import duckdb

    from pursebook.llm.queries import ORACLE_SQL

    rows = [(7, "q", "é" * 40000)] * 3 + [(8, "q", "é" * 40000)] * 2 + [(1, "a", "short")] * 2 + [(2, None, None), (2, "", None), (3, "b", "x" * 500)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    cur = con.execute(ORACLE_SQL["op5_warc"])
    names = [d[0] for d in cur.description]
    got = sorted(repr([r[c] for c in names]) for r in warc.op5_warc(spark, str(tmp_path)).collect())
    assert got == sorted(repr(list(r)) for r in cur.fetchall()) and len(got) == len(rows)
