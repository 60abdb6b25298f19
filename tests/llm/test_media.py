"""GIF files and legacy archives: round trips and awkward cases."""

import base64
import collections
import gzip
import hashlib
import random
import zlib

import cases
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallystream.llm import archive, gif


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=400), st.integers(2, 8))
def test_lzw_round_trip(data, bits):
    data = bytes(b & (1 << bits) - 1 for b in data)
    assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, len(data)) == data


def test_lzw_over_full_tables():
    r = random.Random(1)
    for data in (bytes(r.randrange(256) for _ in range(60_000)), bytes(r.choice(b"ab") for _ in range(200_000)), b"a" * 100_000):
        assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def late_clear(data: bytes) -> bytes:
    """A stream by a writer that keeps a full table for a while before it clears it."""
    codes, widths, table, new, width = [256], [9], {}, 258, 9
    prefix, since = data[0], 0
    for b in data[1:]:
        if (prefix, b) in table:
            prefix = table[prefix, b]
            continue
        codes.append(prefix)
        widths.append(width)
        if new < 4096:
            if new == 1 << width:
                width += 1
            table[prefix, b] = new
            new += 1
        else:
            since += 1
            if since > 500:
                codes.append(256)
                widths.append(12)
                table, new, width, since = {}, 258, 9, 0
        prefix = b
    codes += [prefix, 257]
    widths += [width, 12]
    bits = "".join(format(c, f"0{w}b")[::-1] for c, w in zip(codes, widths, strict=True))
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))


def test_lzw_with_a_deferred_clear_code():
    r = random.Random(5)
    data = bytes(r.choice(b"abcdefgh") for _ in range(60_000))
    assert gif.lzw_decode(late_clear(data), 8, len(data)) == data


def test_disposal_transparency_palettes_and_interlace():
    palette = np.zeros((256, 3), np.uint8)
    palette[:3] = [[9, 0, 0], [0, 200, 0], [0, 0, 77]]
    own = palette[::-1].copy()
    full = gif.Frame(0, 0, np.zeros((4, 4), np.uint8), palette, 10, 1, None)
    patch = gif.Frame(1, 1, np.array([[1, 2], [2, 1]], np.uint8), palette, 20, 3, 2)
    cleared = gif.Frame(0, 0, np.full((2, 2), 255, np.uint8), own, 5, 2, None)
    last = gif.Frame(3, 3, np.array([[1]], np.uint8), palette, 0, 0, None)
    width, height, frames = gif.read(gif.write(4, 4, [full, patch, cleared, last], palette))
    seen = [(start, canvas.copy()) for _, start, canvas in gif.shown(width, height, frames)]
    assert [s for s, _ in seen] == [0, 10, 30, 35]
    assert seen[1][1][1, 1].tolist() == [0, 200, 0, 255] and seen[1][1][1, 2].tolist() == [9, 0, 0, 255]
    assert seen[2][1][1, 1].tolist() == [9, 0, 0, 255]  # its own palette, and the patch was taken back
    assert seen[3][1][0, 0].tolist() == [0, 0, 0, 0] and seen[3][1][3, 3].tolist() == [0, 200, 0, 255]
    assert gif.histogram(seen[3][1]).sum() == 12
    raw = bytearray(gif.write(1, 5, [gif.Frame(0, 0, np.array([[0], [4], [2], [1], [3]], np.uint8), gif.GREY, 0, 0, None)]))
    raw[raw.index(b"\x2c", 781) + 9] |= 0x40  # the rows, as stored, are 0 4 2 1 3
    assert gif.read(bytes(raw))[2][0].indexes.ravel().tolist() == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("cut", [3, 20, 800, -2])
def test_malformed_files(cut):
    with pytest.raises(ValueError):
        gif.read(gif.store(b"ab" * 640)[:cut])


def test_media_columns(spark):
    found = {(r.doc_id, r.n_bytes): r for r in gif.media_columns(cases.frame(spark)).collect()}
    for row in cases.awkward():
        raw = (row[1] or "").encode()
        r = found[row[0], len(raw)]
        payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(gif.store(payload)).hexdigest()
        parts = [payload[k : k + 64 * gif.ROWS] for k in range(0, len(payload), 64 * gif.ROWS)]
        bright = collections.Counter(b >> 4 for b in payload)
        assert r.feature == ",".join(map(str, [len(parts), gif.DELAY * len(parts), *(bright[k] for k in range(16))]))
        assert [(f.start_cs, f.delay_cs, f.height) for f in r.frames] == [(gif.DELAY * n, gif.DELAY, len(x) // 64) for n, x in enumerate(parts)]
        for f, x in zip(r.frames, parts, strict=True):
            colours = collections.Counter((b >> 6) * 16 + (5 * b % 256 >> 6) * 4 + (255 - b >> 6) for b in x)
            assert dict(zip(f.colours, f.pixels, strict=True)) == colours
    assert gif.media_columns(cases.frame(spark, [])).collect() == []


def test_frames(spark):
    media = spark.createDataFrame([(1, gif.store(b"x" * 64 * 200)), (2, b"junk"), (3, None), (4, gif.write(3, 2, []))], "doc_id long, media binary")
    rows = gif.frames_of(media).orderBy("doc_id", "frame").collect()
    assert [(r.doc_id, r.frame, r.start_cs, r.error is None) for r in rows] == [(1, 0, 0, True), (1, 1, 4, True), (2, None, None, False), (3, None, None, False), (4, None, None, False)]
    assert sum(rows[0].histogram) == 64 * gif.ROWS and len(rows[0].rgba) == 64 * gif.ROWS * 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([bytes(64), b"ab" * 32, bytes(range(64)), bytes(range(192, 256))]), min_size=1, max_size=1200))
def test_stored_payloads_come_back(rows):
    """Over all disposal methods, and with pixels that stand for what is shown already."""
    payload = b"".join(rows)
    frames = gif.read(gif.store(payload))[2]
    assert gif.features(gif.store(payload))[0] == payload
    assert [f.disposal for f in frames] == [n % 4 for n in range(len(frames))]


def test_stored_frames_are_transparent_where_nothing_changes():
    payload = b"ab" * 32 * gif.ROWS * 6
    frames = gif.read(gif.store(payload))[2]
    assert [f.transparent is not None for f in frames] == [False, True, True, False, False, True]  # cleared after the third, and so also after the fourth
    assert all((f.indexes == f.transparent).all() for f in frames if f.transparent is not None)
    every = bytes(range(256)) * 16 * gif.ROWS
    assert gif.features(gif.store(every))[0] == every and {f.transparent for f in gif.read(gif.store(every))[2]} == {None}


def test_arc_versions_and_lengths():
    body = b"HTTP/1.1 200 OK\r\n\r\nline\nhttp://x 1 2 3 4\n"
    for version in (1, 2):
        data = archive.arc_header("a.arc", version, "20010203040506") + archive.arc_record("http://a/b c", "200102030405", "text/html", body, version) + archive.arc_record("dns:x", "20010203040506", "text/dns", b"", version)
        one, two = archive.read_arc(data)
        assert (one.version, one.body, two.body) == (version, body, b"")
        made = archive.convert(one, "a.arc")
        assert made.fields["WARC-Date"] == "2001-02-03T04:05:00Z" and made.fields["WARC-Type"] == "response"
        assert made.fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"line\nhttp://x 1 2 3 4\n").digest()).decode()
        assert archive.convert(two, "a.arc").fields["WARC-Type"] == "resource"
        assert made.fields["WARC-Record-ID"] != archive.convert(two, "a.arc").fields["WARC-Record-ID"]
        (back,) = archive.read_warc(archive.warc_bytes(made))
        assert back.block == body and back.fields["WARC-Target-URI"] == "http://a/b%20c"
        with pytest.raises(ValueError):
            list(archive.read_arc(data[:-3] + b"9\n"))
    with pytest.raises(ValueError):
        list(archive.read_arc(b"no version block"))


def test_malformed_archives_are_rows(spark):
    good = archive.arc_header("a", 1, "20010203040506") + archive.arc_record("u", "20010203040506", "t", b"b", 1)
    rows = archive.converted(spark.createDataFrame([("a", good + b"broken\n"), ("b", None)], archive.ARCHIVE_SCHEMA)).collect()
    assert [r.error is None for r in rows] == [True, False, False]
    assert [r.error is None for r in archive.warc_records(spark.createDataFrame([("a", b"junk")], archive.ARCHIVE_SCHEMA)).collect()] == [False]


@pytest.mark.parametrize("bound", [10**6, 0])
def test_archived_pages(spark, monkeypatch, bound):
    monkeypatch.setattr(archive, "BROADCAST_ROWS", bound)
    pages = [(1, "http://a", "<p>é</p>"), (5, "http://b", "<p>é</p>"), (3, None, "<p>é</p>"), (2, "u v", None), (9, "w", ""), (None, "x", "<p>é</p>"), (7, "y", "z" * 300_000), (5, "http://b", "<p>é</p>"), (11, "1", "HTTP/1.1 200 OK\r\n\r\n")]
    df = spark.createDataFrame([(*p, 1, "k") for p in pages], "page_id long, url string, html string, payload int, archive string").repartition(3)
    best = {}
    for i, _, h in pages:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        again = i != best[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", best[h or ""] if again else None))
    found = [tuple(r)[:5] for r in archive.archived_pages(df).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert archive.archived_pages(df.limit(0)).collect() == []
    archives = archive.to_warc(archive.write_arcs(df, "page_id", "url", "html"), "bigint").collect()
    records = [x for a in archives for x in archive.read_warc(a.content)]
    assert all(next(archive.read_warc(a.content)).fields["WARC-Filename"] == a.archive for a in archives)
    assert len(records) == len(pages) + len(archives) and len({x.fields["WARC-Record-ID"] for x in records}) == len(records)


def test_errors_stay_with_the_archive(spark):
    good = archive.arc_header("a", 1, "20010203040506") + archive.arc_record("u", "20010203040506", "t", b"b", 1)
    out = archive.warc_records(archive.to_warc(spark.createDataFrame([("a", good + b"broken\n")], archive.ARCHIVE_SCHEMA))).collect()
    assert sorted((r.record_type or "", r.error is None) for r in out) == [("", False), ("resource", True)]


def test_one_bad_record_is_one_error_row(spark):
    """Bad dates and lengths lose no later record; a torn member loses what follows it."""
    record = lambda uri, body, date="20010203040506": archive.arc_record(uri, date, "t", body, 1)
    data = archive.arc_header("a", 1, "20010203040506") + record("one", b"1") + record("two", b"2", "not-a-date") + record("three", b"3")
    packed = b"".join(gzip.compress(x) for x in (archive.arc_header("a", 1, "20010203040506"), record("one", b"1"), record("two", b"2", "99"), record("three", b"3")))
    table = spark.createDataFrame([("a", data), ("b", packed), ("c", gzip.compress(data)), ("d", packed[:-9])], archive.ARCHIVE_SCHEMA)
    found = collections.defaultdict(list)
    for r in archive.converted(table).collect():
        found[r.target_uri].append(r)
    assert {k: len(v) for k, v in found.items()} == {"one": 4, "three": 3, None: 5}
    assert sum("bad date" in r.error for r in found[None]) == 4 and sum("ends early" in r.error for r in found[None]) == 1
    assert len({r.record_id for r in found["one"]}) == 4
    revisit = {"WARC-Type": "revisit", "WARC-Record-ID": "<x>", "WARC-Date": archive.MADE, "WARC-Target-URI": "u", "WARC-Payload-Digest": "sha1:A"}
    parts = [archive.WarcRecord(revisit, b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\n"), archive.WarcRecord(revisit, b"HTTP/1.1 200 OK\r\n\r\n"), archive.WarcRecord(revisit, b"HTTP/1.1 200 OK\r\nContent-Length: 7\r\n\r\n")]
    whole = b"".join(map(archive.warc_bytes, parts)) + gzip.compress(b"WARC/1.1\r\nContent-Length: x\r\n\r\n") + archive.warc_bytes(parts[2])
    rows = archive.warc_records(spark.createDataFrame([("w", whole)], archive.ARCHIVE_SCHEMA)).collect()
    assert [(r.payload_bytes, r.error is None) for r in rows] == [(None, False), (None, True), (7, True), (None, False), (7, True)]


def test_references_name_records(spark):
    pages = spark.createDataFrame([(k, f"http://{k}", f"page {k % 7}") for k in range(60)], "page_id long, url string, html string").repartition(5)
    for bound in (0, 10**6):
        archive.BROADCAST_ROWS, before = bound, archive.BROADCAST_ROWS
        try:
            arcs = archive.staged(archive.write_arcs(pages, "page_id", "url", "html"), "arc")
            records = [x for a in archive.to_warc(arcs, "bigint").collect() for x in archive.read_warc(a.content)]
        finally:
            archive.BROADCAST_ROWS = before
        ids = {x.fields["WARC-Record-ID"]: x for x in records if x.fields["WARC-Type"] == "response"}
        revisits = [x for x in records if x.fields["WARC-Type"] == "revisit"]
        assert len(ids) == 7 and len(revisits) == 53
        for x in revisits:
            assert ids[x.fields["WARC-Refers-To"]].fields["WARC-Payload-Digest"] == x.fields["WARC-Payload-Digest"]
            assert archive.split_http(x.block)[1] == b""
    assert all("WARC-Date" in x.fields for x in records)
