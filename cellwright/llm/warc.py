"""WARC archives in Zstandard: a writer that revisits repeated payloads, and a reader that validates what it reads.

An archive begins with a skippable frame that holds the dictionary; then comes one frame per record. The reader loads the
dictionary from the leading frame, decodes frame by frame and checks each record: version line, required headers, the
block's length, the blank lines at its end, the digests of block and payload, and the payload's length. It also reads what others
wrote: versions 1.0 and 1.1, records of any kind (their payload is the block unless that is an HTTP message) and of any id.

Records are compressed where the pages are read, so only frames are shuffled. Which page answers for a payload is an aggregation
by digest and a join that splits hot digests. Archives hold about ARCHIVE bytes each; a task writes under a name of its
own and reports it, and only reported archives are read, so repeated and lost tasks leave no double records.

Defined cases. Null html: empty payload. Null url: the empty URI. Null page_id: a response, unless its payload has a page with an id,
to which it refers; read back as null. Rows that repeat the responding id are responses too. Empty table: no archive, an
empty result. Other columns are ignored."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, file_system, lean, new_folder

# Fixed values of the formats: frame magic numbers, version line, required headers.
_DICTIONARY_FRAME, _ZSTD_FRAME = 0x184D2A5D, 0xFD2FB528
_VERSION, _VERSIONS = b"WARC/1.1", (b"WARC/1.0", b"WARC/1.1")
_REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE = 32 << 20
#: Pages and bytes of each that the dictionary is trained on, and its size.
SAMPLE, PREFIX, DICTIONARY = 400, 8192, 32768


class WarcError(ValueError):
    """An archive or record that doesn't keep to the format."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page: object, url: str, date: str, payload: bytes, refers_to: object = None) -> bytes:
    """A response with its payload, or a revisit with the response's HTTP headers alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if page is None else page}>", f"WARC-Date: {date}", "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    else:
        block += payload
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return _VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", _DICTIONARY_FRAME, len(dictionary)) + dictionary


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive; its dictionary, which may itself be compressed, is loaded from the leading skippable frame."""
    at, known = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == _DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise WarcError("the dictionary frame is cut off")
        raw = data[8 : 8 + size]
        if raw[:4] == struct.pack("<I", _ZSTD_FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 30)
        known, at = zstandard.ZstdCompressionDict(raw) if raw else None, 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) >= at + 8 and struct.unpack_from("<I", data, at)[0] >> 4 == _DICTIONARY_FRAME >> 4:  # skippable
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            if at > len(data):
                raise WarcError("a skippable frame is cut off")
            continue
        end = frame_end(data, at)
        try:
            one = reader.decompressobj()
            out = one.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at byte {at} is damaged: {e}") from e
        yield out
        at = end


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that begins at `at` ends: its header, its blocks up to the last, its checksum (RFC 8878)."""
    if len(data) < at + 6 or struct.unpack_from("<I", data, at)[0] != _ZSTD_FRAME:
        raise WarcError(f"no frame begins at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        if end + 3 > len(data):
            raise WarcError(f"the frame at byte {at} is cut off")
        head = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        end += 3 + (1 if kind == 1 else size)
    end += 4 * (flags >> 2 & 1)
    if end > len(data):
        raise WarcError(f"the frame at byte {at} is cut off")
    return end


def _checked(said: str | None, data: bytes, what: str) -> None:
    """A digest is compared if it is a sha1 in base32, the form all writers share; others are passed over."""
    kind, _, value = (said or "").partition(":")
    if kind.lower() == "sha1" and len(value) == 32 and value.upper() != base32_sha1(data):
        raise WarcError(f"the {what}'s digest differs")


def parsed(raw: bytes) -> dict:
    """Headers (names in lower case), block, payload and its full length of one record, all lengths and digests checked.

    A revisit has no payload, and a length if its HTTP headers say one."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version not in _VERSIONS or not mark:
        raise WarcError("not a record of these versions")
    headers: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:  # goes on with the value before
            headers[name] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise WarcError(f"not a header: {line[:80]!r}")
        headers[name] = value.strip()
    if missing := [x for x in _REQUIRED if x not in headers]:
        raise WarcError(f"missing headers: {missing}")
    if not headers["content-length"].isdigit():
        raise WarcError("the length isn't a number")
    size = int(headers["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise WarcError("the block isn't as long as its header says")
    _checked(headers.get("warc-block-digest"), block, "block")
    revisit, kind = headers["warc-type"] == "revisit", headers.get("content-type", "").replace(" ", "").lower()
    payload, told = block, None
    if kind.startswith("application/http"):
        http, mark, payload = block.partition(b"\r\n\r\n")
        lengths = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        told = int(lengths[0]) if lengths and lengths[0].isdigit() else None
        if not mark and not revisit:
            raise WarcError("the block holds no HTTP message")
    if revisit:
        if payload and kind.startswith("application/http"):
            raise WarcError("a revisit holds no payload")
        return {"headers": headers, "payload": b"", "payload_bytes": told}
    if told is not None and told != len(payload) and "warc-truncated" not in headers:
        raise WarcError("the payload differs from its length")
    if "warc-truncated" not in headers:
        _checked(headers.get("warc-payload-digest"), payload, "payload")
    return {"headers": headers, "payload": payload, "payload_bytes": len(payload)}


def trained(pages: DataFrame) -> bytes:
    """A dictionary from the beginnings of at most SAMPLE pages, chosen by hash; empty if they are too few or too alike to train on."""
    some = pages.where("length(html) > 0")
    # Ids alone are sorted; at most SAMPLE of them are broadcast to fetch the texts.
    ids = some.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE)
    rows = some.join(F.broadcast(ids), "page_id", "left_semi").select(F.substring("html", 1, PREFIX)).limit(SAMPLE).collect()
    samples = sorted(r[0].encode() for r in rows)
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes):
    known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=3, **known)


def _framer(dictionary: bytes, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = _compressor(dictionary).compress
        for batch in batches:
            out = []
            for page, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html")):
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                out.append((page, url or "", len(payload), base32_sha1(payload), press(record("response", page, url or "", date, payload))))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())], ["page_id", "url", "bytes", "digest", "frame"])

    return run


def _writer(folder: str, dictionary: bytes, date: str, archive: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        press, held, size = _compressor(dictionary).compress, [], 0

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with system.open_output_stream(f"{root}/{name}", compression=None) as f:  # else the name would have it compressed again
                f.write(dictionary_frame(dictionary))
                for x in held:
                    f.write(x)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64())], ["path", "records"])

        for batch in batches:
            for page, url, kind, refers, n, digest, frame in zip(*(batch.column(c) for c in ("page_id", "url", "type", "refers_to", "bytes", "digest", "frame"))):
                if kind.as_py() == "revisit":
                    held.append(press(_revisit(page.as_py(), url.as_py(), date, n.as_py(), digest.as_py(), refers.as_py())))
                else:
                    held.append(frame.as_py())
                size += len(held[-1])
                if size >= archive:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return run


def _revisit(page: object, url: str, date: str, length: int, digest: str, refers_to: object) -> bytes:
    raw = record("revisit", page, url, date, b"", refers_to)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    empty = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 0\r\n\r\n"
    swaps = [(f"sha1:{base32_sha1(empty)}", f"sha1:{base32_sha1(block)}"), (f"WARC-Payload-Digest: sha1:{base32_sha1(b'')}", f"WARC-Payload-Digest: sha1:{digest}"), (f"\r\nContent-Length: {len(empty)}\r\n\r\n", f"\r\nContent-Length: {len(block)}\r\n\r\n")]
    for a, b in swaps:
        raw = raw.replace(a.encode(), b.encode(), 1)
    return raw.replace(empty, block)


def write(pages: DataFrame, folder: str | None = None, least: int = 0, archive: int = ARCHIVE, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) and return the archives as (path, records).

    Of pages with equal payloads of at least `least` bytes the one with the smallest page_id is the response."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    dictionary = trained(pages)
    framed = cut(pages.mapInArrow(lean(_framer(dictionary, date)), "page_id long, url string, bytes long, digest string, frame binary"), "frames")
    firsts = framed.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "bytes", "first")
    # The frame isn't in this join; most payloads are unique and its few partners decide.
    kinds = framed.select("page_id", "digest", "bytes").join(firsts, ["digest", "bytes"]).where("first is not null and not page_id <=> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    joined = framed.join(kinds.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to"), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    typed = joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("type"), "refers_to", "bytes", "digest", F.when(F.col("refers_to").isNull(), F.col("frame")).alias("frame"))
    return cut(typed.mapInArrow(lean(_writer(folder, dictionary, date, archive)), "path string, records long"), "manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def number(uri: str | None) -> int | None:
        own = re.fullmatch(r"<?urn:x-page:(-?[0-9]+)>?", uri or "")
        return int(own[1]) if own else None

    for batch in batches:
        for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
            system, name = file_system(path)
            with system.open_input_file(name) as f:
                data = f.read()
            out, seen = [], 0
            for raw in frames(data):
                r = parsed(raw)
                h = r["headers"]
                seen += 1
                said = h.get("warc-payload-digest")
                digest = base32_sha1(r["payload"]) if said is None and h["warc-type"] != "revisit" else said and said.removeprefix("sha1:")
                out.append((number(h["warc-record-id"]), h.get("warc-target-uri", ""), h["warc-type"], number(h.get("warc-refers-to")), r["payload_bytes"], digest, r["payload"], h["warc-record-id"].strip("<>"), h["warc-date"]))
                if len(out) >= 2000:
                    yield _read_rows(out)
                    out = []
            if expected is not None and seen != expected:
                raise WarcError(f"{path} holds {seen} records, not {expected}")
            if out:
                yield _read_rows(out)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("record_id", pa.string()), ("date", pa.string())])


def _read_rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)


def read(archives: DataFrame) -> DataFrame:
    """The records of archives (path, records; records may be null): page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (empty for revisits), record_id, date.

    page_id and refers_to are null for ids that `write` didn't make."""
    n = max(1, min(archives.count(), 10_000))
    spread = archives.select("path", F.col("records").cast("long").alias("records")).repartition(n, F.xxhash64("path"))
    return spread.mapInArrow(lean(_reader), "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, record_id string, date string")


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Archives of a folder that others have written, for read(): only paths are listed, by Spark. What `write` has written is read from the
    archives it returns, as a task that failed may have left an archive that no record counts."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    unknown: Column = F.lit(None).cast("long")
    return files.select("path", unknown.alias("records"))
