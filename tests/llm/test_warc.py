import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from quillbit.llm import warc_store as W

HOT = "<p>hot</p>" * 50
PAGES = [(5, "http://a/5", HOT), (2, "http://a/2", HOT), (9, "http://a/9?x=1\r\nEvil: 1", HOT), (7, None, "é\r\n\r\nWARC/1.1\r\n"), (1, "u", None), (3, "u", ""), (4, "u", ""), (8, "u", "x" * 200_000), (2, "http://a/2", HOT), (None, "u", HOT)]


def expected(rows, least=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min((j for j, _, h in rows if j is not None and (h or "") == (html or "")), default=None)
        again = i is not None and first is not None and i > first and len(data) >= least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None, True))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 10])
def test_archive(spark, least):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, payload string")
    archive = W.build(pages, least=least)
    found = sorted((tuple(r) for r in W.read_back(W.restore(archive)).collect()), key=repr)
    assert found == expected(PAGES, least)
    assert archive.payloads.count() == len({h or "" for _, _, h in PAGES})


def test_records_are_well_formed(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for r in W.restore(W.build(pages)).collect():
        record = bytes(r.record)
        head, block = record.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1" and record.endswith(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        assert int(fields["Content-Length"]) == len(block) - 4
        http, body = block[:-4].split(b"\r\n\r\n", 1)
        assert http.startswith(b"HTTP/1.1 200 OK")
        assert "Evil" not in fields
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        else:
            assert body == b"" and {"WARC-Refers-To", "WARC-Profile", "WARC-Refers-To-Target-URI"} <= set(fields)


def test_damage_is_found(spark):
    """Any changed byte of a response; its revisits have nothing to stand for then."""
    page = "<p>x</p>"
    pages = spark.createDataFrame([(1, "http://a/", page), (2, "http://b/", page)], "page_id long, url string, html string")
    rows = W.restore(W.build(pages)).collect()
    schema = "id long, record binary, address string, seal string"
    first = next(r for r in rows if r.id == 1)
    data = bytes(first.record)
    broken = [(1, bytearray(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :]), first.address, first.seal) for i in range(len(data))]
    assert not any(r.verified for r in W.read_back(spark.createDataFrame(broken, schema)).collect())
    at = data.index(b"<p>x")
    both = [broken[at], *[tuple(r) for r in rows if r.id == 2]]
    found = {r.page_id: r for r in W.read_back(spark.createDataFrame(both, schema)).collect()}
    assert not found[1].verified and not found[2].verified and found[2].payload_bytes is None
    assert all(r.verified and r.payload_bytes == len(page) for r in W.read_back(spark.createDataFrame(rows, schema)).collect())


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.read_back(W.restore(W.build(pages))).count() == 0
