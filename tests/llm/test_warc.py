"""Archives written and read back, against brute force; the ZIP reader against a library's files, ZIP64, odd and broken ones."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import os
import zipfile

import pytest

from curatrix.llm import warc


class Ranges:
    """A file in memory that notes what is read."""

    def __init__(self, data: bytes):
        self.data, self.read = data, 0

    def read_at(self, n, at):
        assert at >= 0
        self.read += n
        return self.data[at : at + n]


def members(data: bytes):
    file = Ranges(data)
    return {x["name"]: (x["method"], file.data[(at := warc.data_place(file, x["header"])) : at + x["size"]]) for x in warc.directory(file, len(data))}


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("before", [b"", b"#!/bin/sh\nexit\n"])
def test_own_zip(zip64, before):
    out = io.BytesIO()
    z = warc.StoredZip(out, zip64)
    for k in range(300):
        z.add(f"archive/é{k}", b"x" * k)
    z.close()
    data = before + out.getvalue()
    assert members(data) == {f"archive/é{k}": (0, b"x" * k) for k in range(300)}
    if not before:
        with zipfile.ZipFile(out) as other:
            assert other.testzip() is None and other.read("archive/é7") == b"x" * 7


def test_a_librarys_zip():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK\5\6 is no directory"
        z.writestr("stored", b"abc" * 100)
        z.writestr("deflated", b"abc" * 100, compress_type=zipfile.ZIP_DEFLATED)
        with z.open("wide", "w", force_zip64=True) as f:
            f.write(b"wide")
    found = members(out.getvalue())
    assert found["stored"] == (0, b"abc" * 100) and found["wide"] == (0, b"wide") and found["deflated"][0] == 8
    assert b"".join(warc._inflated(iter([found["deflated"][1]]), -15)) == b"abc" * 100


@pytest.mark.parametrize("data", [b"", b"no zip", b"PK\5\6" + b"\xff" * 18, b"PK\5\6" + b"\0" * 4 + b"\1\0\1\0" + b"\x10\0\0\0" + b"\0" * 6])
def test_broken_zip(data):
    with pytest.raises(ValueError):
        list(warc.directory(Ranges(data), len(data)))


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"https://x{i % 3}.example.com/a {i}\r\nb?q=é", f"<p>page {i} é</p>" * (i % 5)) for i in range(40)]
    out += [(100 + i, "http://copies.example.com/", "the same") for i in range(30)]
    return [*out, (200, None, None), (201, "", ""), (202, "not a url", "x" * 300_000), (None, "http://n/", "the same"), (None, None, "lone"), (100, "http://again/", "the same"), (203, "http://a/%20%", "WARC/1.1\r\n\r\n")]


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", "p", 1) for r in rows], "page_id long, url string, html string, key string, payload string, bytes long").repartition(5)


def brute(rows, least=0):
    first = {}
    for key, _, html in rows:
        first[html or ""] = min(first.get(html or "", key), key, key=lambda x: (x is None, x or 0))
    out = []
    for key, _, html in rows:
        payload = (html or "").encode()
        refers = first[html or ""] if len(payload) >= least and key != first[html or ""] else None
        out.append((str(key), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if refers is None else "revisit", str(refers)))
    return sorted(out)


@pytest.mark.parametrize("rules", [{}, {"zip64": True, "member_bytes": 500, "archive_bytes": 3000}, {"least_bytes": 9}])
def test_round_trip(spark, rows, tmp_path, rules):
    manifest = warc.write_archives(table(spark, rows), str(tmp_path), **rules)
    listed = warc.archives_in(spark, str(tmp_path))
    assert sorted(map(tuple, manifest.select("archive", "bytes").collect())) == sorted(map(tuple, listed.collect()))
    records = warc.read_records(listed, request_bytes=2000).cache()
    found = sorted((str(r.source_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.resolved(records).collect())
    assert found == brute(rows, rules.get("least_bytes", 0))
    html = {r[0]: (r[1], (r[2] or "").encode()) for r in rows if r[0] != 100}
    for r in records.filter("error IS NULL AND source_id <> '100'").collect():
        url, payload = html[int(r.source_id)]
        assert (r.target_uri or "") == (url or "") and (r.payload is None) == (r.record_type == "revisit") and r.payload in (None, payload)
    assert not records.filter("error IS NOT NULL").count()


def test_empty(spark, tmp_path):
    manifest = warc.write_archives(table(spark, []), str(tmp_path))
    assert manifest.collect() == [] and warc.read_records(manifest).collect() == []


def test_other_archives(spark, tmp_path):
    """Members without an index, plain records, deflated members and index, broken records and files."""
    one, two = (warc.make_record(str(k), f"http://a/{k}", b"payload %d" % k, None)[0] for k in (1, 2))
    with zipfile.ZipFile(f"{tmp_path}/a.wacz", "w") as z:
        z.writestr("archive/gz.warc.gz", gzip.compress(one) + gzip.compress(two))
        z.writestr("archive/plain.warc", one.replace(b"payload 1", b"payload 3") + two)
        z.writestr("archive/packed.warc", one, compress_type=zipfile.ZIP_DEFLATED)
        z.writestr("archive/listed.warc.gz", gzip.compress(one) + gzip.compress(two))
        n = len(gzip.compress(one))
        lines = [f"com,a)/2 2024 {json.dumps({'offset': n, 'length': len(gzip.compress(two)), 'filename': 'listed.warc.gz'})}", "no entry", "a b {broken", f"c d {json.dumps({'offset': 3, 'length': 20, 'filename': 'listed.warc.gz'})}", f"e f {json.dumps({'offset': 1 << 40, 'length': 5, 'filename': 'listed.warc.gz'})}"]
        z.writestr("indexes/index.cdx", "\n".join(lines), compress_type=zipfile.ZIP_DEFLATED)
    for name, data in (("b.zip", b"no archive"), ("c.zip", b"\0")):
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(data)
    found = warc.read_records(warc.archives_in(spark, str(tmp_path))).collect()
    told = sorted((os.path.basename(r.archive), bytes(r.payload or b"").decode(), (r.error or "").split(" ")[0]) for r in found)
    broken = [x for x in told if x[2]]
    assert [x for x in told if not x[2]] == [("a.wacz", f"payload {k}", "") for k in (1, 2, 2, 2)]
    assert len(broken) == 5 and ("a.wacz", "", "archive/packed.warc") in broken and ("a.wacz", "payload 3", "digest") in broken and {x[0] for x in broken} == {"a.wacz", "b.zip", "c.zip"}


def test_walk_across_blocks():
    records = [warc.make_record(str(k), "u", b"z" * k, None)[0] for k in range(50)]
    for data in (b"".join(map(gzip.compress, records)), b"".join(records)):
        for size in (1, 7, 1000, len(data)):
            found = list(warc.walk(iter([data[k : k + size] for k in range(0, len(data), size)])))
            assert [r for _, r in found] == records and found[0][0] == 0


def test_cut_off():
    raw = warc.make_record("1", "u", b"z" * 100, None)[0]
    assert warc.parse_record(raw[:-50])["error"] == "cut off" and warc.parse_record(b"x")["error"]
    assert [r for _, r in warc.walk(iter([raw[:60]]))] == [raw[:60]]
