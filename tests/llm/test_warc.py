import base64
import gzip
import hashlib

import pytest

from folio.llm import warc


def _digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def test_round_trip_of_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = sorted((r.page_id, len(r.html.encode()), _digest(r.html)) for r in pages.collect())
    got = warc.warc_roundtrip(pages).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want


def test_revisits_and_odd_rows(spark):
    rows = [(5, "http://a/5", "x"), (2, "http://a/2", "x"), (9, None, "x"), (1, "http://a/é b", "naïve\r\n\r\nWARC/1.1\r\n"), (3, "http://c", None), (4, "http://d", ""), (2, "http://a/2", "x"), (None, "http://n", "only"), (7, "http://big", "y" * 200_000), (8, "http://big", "y" * 200_000)]
    pages = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, record_type int, value string")
    got = warc.warc_roundtrip(pages).collect()
    assert len(got) == len(rows)
    seen = sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    first: dict = {}
    for page_id, _, html in rows:
        first[html or ""] = min(first.get(html or "", 10**9), page_id if page_id is not None else -1)
    want, led = [], set()
    for page_id, _, html in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        t = html or ""
        i = -1 if page_id is None else page_id
        leads = i == first[t] and t not in led
        led.add(t)
        want.append((i, len(t.encode()), _digest(t), "response" if leads else "revisit", None if leads else first[t]))
    assert seen == sorted(want, key=lambda w: tuple(str(x) if x is None else x for x in w[:4]))


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.warc_roundtrip(pages, min_bytes=3).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_empty_table(spark):
    assert warc.warc_roundtrip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("members", [False, True])
def test_parsing_other_archives(members):
    def record(kind, rid, block, *more):
        head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("Content-Length", str(len(block)))]
        return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*head, *more]) + "\r\n").encode() + block + b"\r\n\r\n"

    parts = [record("warcinfo", "<w>", b"a: b"), record("response", "<r>", b"HTTP/1.1 200 OK\r\n\r\nWARC/1.0\r\n\r\n", ("WARC-Concurrent-To", "<q>"), ("WARC-Concurrent-To", "<m>"))]
    data = b"".join(gzip.compress(p) for p in parts) if members else gzip.compress(b"junk\r\n" + b"".join(parts))
    got = list(warc.parse_archive(data))
    assert [h["warc-type"] for h, _ in got] == ["warcinfo", "response"] and got[1][1].endswith(b"WARC/1.0\r\n\r\n")
    assert got[1][0]["warc-concurrent-to"] == "<q>\n<m>"
    assert len(list(warc.parse_archive(b"".join(parts)[:-20]))) == 1


def test_assembly_in_any_direction(spark):
    rows = [("r1", "response", ["q1"]), ("q1", "request", []), ("m1", "metadata", ["q1"]), ("r2", "revisit", []), ("q2", "request", ["r2"]), ("m2", "metadata", ["r2"]), ("lost", "metadata", ["nobody"]), ("r3", "response", [])]
    full = [(i, k, to, None, None, None, None, {}, None) for i, k, to in rows]
    got = {r.record_id: ([x.record_id for x in r.requests or []], [x.record_id for x in r.metadata or []]) for r in warc.assemble(spark.createDataFrame(full, warc.RECORD_SCHEMA)).collect()}
    assert got == {"r1": (["q1"], ["m1"]), "r2": (["q2"], ["m2"]), "r3": ([], [])}


def test_archives_are_read_in_pieces(monkeypatch):
    """Members, records and headers across pieces of any size, packed or plain."""
    def record(rid, block):
        return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: {rid}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    blocks = [b"", b"WARC/1.1\r\n\r\n" * 5, b"x" * 5000, bytes(range(256)) * 20, b"\r\n\r\n"]
    parts = [record(i, b) for i, b in enumerate(blocks)]
    for piece in (1, 7, 1000, 1 << 20):
        monkeypatch.setattr(warc, "PIECE", piece)
        for data in (b"junk" + b"".join(parts), gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))):
            assert [b for _, b in warc.parse_archive(data)] == blocks, piece
    assert [b for _, b in warc.parse_archive(gzip.compress(b"".join(parts))[:-30])][:2] == blocks[:2]


def test_plain_archives_are_found(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    (tmp_path / "a.warc").write_bytes(head + block + b"\r\n\r\n")
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(head.replace(b"<r>", b"<s>") + block + b"\r\n\r\n"))
    (tmp_path / "c.txt").write_bytes(b"no archive")
    got = {r.record_id: (r.payload_bytes, r.payload_digest) for r in warc.read_records(spark, str(tmp_path)).collect()}
    assert got == {"<r>": (5, _digest("hello")), "<s>": (5, _digest("hello"))}


def test_a_record_that_names_nobody_is_reached_through_one_that_names_both(spark):
    rows = [("r1", "response", []), ("q1", "request", []), ("m1", "metadata", ["r1", "q1"])]
    full = [(i, k, to, None, None, None, None, {}, None) for i, k, to in rows]
    (got,) = warc.assemble(spark.createDataFrame(full, warc.RECORD_SCHEMA)).collect()
    assert [x.record_id for x in got.requests] == ["q1"] and [x.record_id for x in got.metadata] == ["m1"]


def test_a_long_page_and_repeated_rows(spark):
    rows = [(1, "http://a", "z" * 8_000_000)] * 2 + [(2, "http://b", "s")] * 3
    got = warc.warc_roundtrip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == [(1, 8_000_000, "response", 0), (1, 8_000_000, "revisit", 1), (2, 1, "response", 0), (2, 1, "revisit", 2), (2, 1, "revisit", 2)]
