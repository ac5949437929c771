import io
import zlib

import pytest

from ridelake.llm import warc


def brute(rows, least=0):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        last = max(same, default=None)
        refers = last if len(body) >= least and last is not None and last != page else None
        out.append((page, len(body), warc.digest_of(body), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/x y\r\nz", "<p>ä</p>"), (2, None, "<p>ä</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 700_000), (9, "u", "<p>ä</p>"),
    (9, "u", "<p>ä</p>"), (6, "ü", "a\r\n\r\nb"), (None, "n", "<p>ä</p>"), (None, "n", "alone"), (7, "u", "x" * 700_000), (-3, "u", "neg"),
]
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("least", [0, 9])
def test_round_trip(spark, folder, least):
    df = spark.createDataFrame([(*r, "k") for r in ROWS], "page_id long, url string, html string, key string")
    manifest = warc.write_archives(df, folder + "/warc", min_payload=least, max_file_bytes=300)
    assert manifest.count() > 1
    found = warc.read_archives(manifest, with_payload=True).collect()
    assert all(r.digest_ok for r in found)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found), key=repr) == brute(ROWS, least)
    bodies = {r.page_id: bytes(r.payload) for r in found if r.record_type == "response"}
    assert bodies[9].decode() == "<p>ä</p>" and bodies[6] == b"a\r\n\r\nb" and len(bodies[7]) == 700_000
    empty = warc.write_archives(df.limit(0), folder + "/none")
    assert warc.read_archives(empty).count() == 0


def test_heads_of_any_length(spark, folder):
    rows = [(1, "http://a/" + "q" * 3_000_000, "<p>"), (2, "http://b/" + "ä\r\n\r\n" * 100_000, "<p>"), (3, "c", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r for r in warc.read_archives(warc.write_archives(df, folder + "/heads"), with_payload=True).collect()}
    assert found[1].target_uri == rows[0][1] and len(found[2].target_uri) == 9 + 13 * 100_000
    assert all(r.digest_ok for r in found.values()) and found[1].refers_to == 2 and bytes(found[3].payload) == b"x"
    block = b"HTTP/1.1 200 OK\r\nX-Long: " + b"h" * 2_000_000 + b"\r\n\r\nbody"
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block)
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = packed.compress(head + block + b"\r\n\r\n") + packed.flush()
    assert [r["payload"] for r in warc.read_records(io.BytesIO(data), True)] == [b"body"]


def test_reader_finds_damage():
    data = warc.record(1, "u", b"hello" * 100, None) + warc.record(2, "u", b"world", 1)
    rows = list(warc.read_records(io.BytesIO(data), True))
    assert [(r["page_id"], r["refers_to"], r["digest_ok"]) for r in rows] == [(1, None, True), (2, 1, True)]
    assert rows[1]["offset"] == len(warc.record(1, "u", b"hello" * 100, None))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-20])))
    plain = zlib.decompress(warc.record(1, "u", b"hello", None), 31)
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    bad = packed.compress(plain.replace(b"hello", b"hellO")) + packed.flush()
    assert [r["digest_ok"] for r in warc.read_records(io.BytesIO(bad))] == [False]
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(packed.compress(plain + b"more") + packed.flush())))
