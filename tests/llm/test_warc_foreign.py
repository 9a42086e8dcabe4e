"""Archives of other writers."""

import base64
import hashlib

import pytest
import zstandard

from cellwright.llm import warc


def made(kind, block, version="1.0", **more):
    lines = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:6f5c2b1e-0d6a-4a57-8a10-0a4e5a1b2c3d>", "WARC-Date": "2020-01-01T00:00:00Z", "Content-Length": str(len(block))} | {k.replace("_", "-"): v for k, v in more.items()}
    return (f"WARC/{version}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def sha1(x):
    return "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()


def test_kinds_ids_and_versions(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>page</p>"
    records = [
        made("warcinfo", b"software: other\r\n", Content_Type="application/warc-fields"),
        made("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", Content_Type="application/http; msgtype=request"),
        made("response", http, "1.1", Content_Type="application/http; msgtype=response", WARC_Target_URI="http://a/", WARC_Payload_Digest=sha1(b"<p>page</p>"), WARC_Block_Digest="sha256:abc"),
        made("resource", b"plain", Content_Type="text/plain", WARC_Target_URI="file:\r\n /b"),
        made("revisit", b"", WARC_Refers_To="<urn:uuid:1>"),
        made("response", http[:-4], Content_Type="application/http", WARC_Truncated="length", WARC_Payload_Digest=sha1(b"<p>page</p>")),
        made("metadata", b""),
    ]
    press = zstandard.ZstdCompressor()
    skip = b"\x50\x2a\x4d\x18" + (3).to_bytes(4, "little") + b"abc"
    (tmp_path / "x.warc.zst").write_bytes(press.compress(records[0]) + skip + b"".join(map(press.compress, records[1:])))
    rows = warc.read(warc.list_archives(spark, str(tmp_path))).collect()
    assert [(r.record_type, r.payload) for r in rows] == [("warcinfo", b"software: other\r\n"), ("request", b""), ("response", b"<p>page</p>"), ("resource", b"plain"), ("revisit", b""), ("response", b"<p>pag"[:6] + b"e"), ("metadata", b"")]
    assert {r.page_id for r in rows} == {None} and rows[3].url == "file: /b" and rows[2].payload_digest == sha1(b"<p>page</p>")[5:]
    assert all(r.record_id.startswith("urn:uuid:") and r.date == "2020-01-01T00:00:00Z" for r in rows)


def test_damage_is_refused():
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n<p>page</p>"
    for raw in (made("response", http, Content_Type="application/http"), made("response", b"x", Content_Type="application/http"), made("resource", b"x", WARC_Block_Digest=sha1(b"y")), made("resource", b"x", WARC_Payload_Digest=sha1(b"y")), made("resource", b"x", "0.9"), made("resource", b"xy")[:-5] + b"\r\n\r\n"):
        with pytest.raises(warc.WarcError):
            warc.parsed(raw)
