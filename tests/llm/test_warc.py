"""WARC archives: round trips, roles of equal payloads and foreign files."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import warc

PAYLOADS = [
    None, "", "<p>a</p>", "<p>a</p>", "x\r\n\r\ny", "ends\r\n", "ends\r\n\r\n", "\r\n\r\n\r\n", "\r", "WARC/1.1\r\nContent-Length: 9\r\n\r\nfake", "é漢🙂", "<p>a</p>", "z" * 300_000,
]


@pytest.fixture(scope="module")
def rows():
    out = [(i if i else None, f"http://h{i}.example/a b?{i}\r\nX: y" if i != 5 else None, p) for i, p in enumerate(PAYLOADS)]
    out += [(20, "http://h/", None), (3, "http://other/", "<p>a</p>"), (2, "http://h2", "<p>a</p>"), (21, "u", "q"), (21, "u", "q"), (22, "u", "q")]
    return out


def by_loop(rows, least=0):
    first = {}
    for i, _, p in rows:
        p = (p or "").encode()
        if len(p) >= least and i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, _, p in rows:
        p = (p or "").encode()
        again = len(p) >= least and p in first and first[p] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, rows, least):
    pages = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, record_type string, block string")
    out = warc.captures_of(pages, least).collect()
    assert sorted([tuple(r)[:5] for r in out], key=repr) == by_loop(rows, least)
    assert all(r["n_requests"] == 1 for r in out)
    assert all(r["digest_ok"] is (None if r["record_type"] == "revisit" else True) for r in out)


def test_payloads_and_references(spark, rows, tmp_path):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w")).collect()
    assert len(records) == 3 * len(rows)
    assert len({r["record_id"] for r in records}) == len(records)
    bodies = sorted(bytes(r["block"]) for r in records if r["record_type"] == "response")
    firsts = {r[0] for r in by_loop(rows) if r[3] == "response"}
    assert set(bodies) == {(p or "").encode() for i, _, p in rows if i in firsts}
    ids = {r["record_id"] for r in records if r["record_type"] == "response"}
    named = [r["refers_to"] for r in records if r["record_type"] == "revisit"]
    assert all(x in ids for x in named if x)
    assert sum(x is not None for x in named) == 2  # the others' response repeats, so no one record can be named


def record(kind, rid, block=b"", **headers):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *(f"{k.replace('_', '-')}: {v}" for k, vs in headers.items() for v in ([vs] if isinstance(vs, str) else vs)), f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_foreign_archives_with_a_member_for_each_record(spark, tmp_path):
    http = b"HTTP/1.1 404 Not Found\r\nA: b\r\n\r\nbody\xff\r\n"
    parts = [
        record("warcinfo", "<i>", b"software: x\r\n"),
        record("response", "<r1>", http, WARC_Concurrent_To=["<q1>", "<m9>"], Content_Type="application/http; msgtype=response"),
        record("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
        record("metadata", "<m1>", b"{}", WARC_Concurrent_To="<r1>"),
        record("metadata", "<m2>", b"", WARC_Concurrent_To="<gone>"),
        record("resource", "<s1>", b"plain", WARC_Payload_Digest="sha1:WRONG"),
    ]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    records = warc.read_records(spark, str(tmp_path / "f"))
    got = {r["record_id"]: r for r in warc.assemble(records).collect()}
    assert set(got) == {"<r1>", "<m2>", "<s1>"}
    one = got["<r1>"]
    assert [q["record_id"] for q in one["requests"]] == ["<q1>"] and [m["record_id"] for m in one["metadata"]] == ["<m1>"]
    assert (one["response"]["http_status"], bytes(one["response"]["block"])) == (404, b"body\xff\r\n")
    assert got["<m2>"]["response"] is None and [m["record_id"] for m in got["<m2>"]["metadata"]] == ["<m2>"]
    assert got["<s1>"]["response"]["digest_ok"] is False and got["<s1>"]["requests"] == []


def test_cut_and_plain_files_are_refused(spark, tmp_path):
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc.gz").write_bytes(gzip.compress(record("resource", "<a>", b"x" * 50)[:-30]))
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_records(spark, str(tmp_path / "cut")).collect()


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.captures_of(pages).collect() == []


def test_base32(spark):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(50)]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in hexes], "h string").select(warc.base32_of(F.col("h"))).collect()]
    assert got == [base64.b32encode(bytes.fromhex(h)).decode() for h in hexes]
