"""Zstandard WARC archives: one frame per record, dictionary in front.

A file starts with a skippable frame that holds the dictionary with which all
its frames are compressed. Each record is one frame with its content size and
checksum. The last nine bytes are a skippable frame of one line feed, because
Spark's writer ends each file's bytes with one.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from changefold.llm.common import partitions
from changefold.session import scratch_path

#: Fixed values of the Zstandard and WARC formats.
FRAME, SKIP_DICT, SKIP_END = b"\x28\xb5\x2f\xfd", 0x184D2A5D, 0x184D2A50
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _name(page) -> str:
    return "<urn:page:null>" if pd.isna(page) else f"<urn:page:{int(page)}>"


def record(page, url: str | None, kind: str, payload: bytes, size: int, digest: str, refers, date: str) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_name(page)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_name(refers)}", f"WARC-Profile: {PROFILE}"]
    block = HTTP + payload
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], dict_bytes: int, samples: int) -> bytes:
    """A file's bytes but for its last line feed."""
    import zstandard as zstd

    taken = [r[:4096] for r in records[: max(1, samples)]]
    try:
        made = zstd.train_dictionary(dict_bytes, taken, k=256, d=8)
    except zstd.ZstdError:  # too little to train on: the bytes themselves
        made = zstd.ZstdCompressionDict(b"".join(taken)[:dict_bytes], dict_type=zstd.DICT_TYPE_RAWCONTENT)
    body = made.as_bytes()
    made.precompute_compress(level=3)
    press = zstd.ZstdCompressor(dict_data=made, write_content_size=True, write_checksum=True)
    frames = [press.compress(r) for r in records]
    return struct.pack("<II", SKIP_DICT, len(body)) + body + b"".join(frames) + struct.pack("<II", SKIP_END, 1)


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its header and block headers."""
    flags = data[at + 4]
    single, size_flag = flags >> 5 & 1, flags >> 6
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[size_flag]
    while True:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        kind, size = head >> 1 & 3, head >> 3
        if kind == 3:
            raise ValueError("reserved block type")
        at += 3 + (1 if kind == 1 else size)
        if head & 1:
            at += 4 * (flags >> 2 & 1)
            if at > len(data):
                raise ValueError("a frame is cut off")
            return at


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of a file, one frame at a time."""
    import zstandard as zstd

    at, press = 0, zstd.ZstdDecompressor()
    while at < len(data):
        if len(data) < at + 8:
            raise ValueError("bytes after the last frame")
        (magic, size) = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame is cut off")
            if magic == SKIP_DICT:
                if at:
                    raise ValueError("the dictionary is not in front")
                body = data[8 : 8 + size]
                if body[:4] == FRAME:
                    body = zstd.ZstdDecompressor().decompress(body)
                press = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(body))
            at += 8 + size
            continue
        if data[at : at + 4] != FRAME:
            raise ValueError("no frame where one should start")
        end = frame_end(data, at)
        frame = data[at:end]
        out = press.decompress(frame)
        if len(out) != zstd.frame_content_size(frame):
            raise ValueError("a frame's content size differs")
        yield out
        at = end


def parse(raw: bytes) -> tuple:
    """The columns of ``READ``; ValueError for a record that breaks the format."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise ValueError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("Content-Length differs from the block")
    http, sep, payload = rest[:length].partition(b"\r\n\r\n")
    if not sep or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")

    def number(name: str) -> int | None:
        value = fields[name].removeprefix("<urn:page:").removesuffix(">")
        return None if value == "null" else int(value)

    kind, size = fields["warc-type"], int(fields["x-payload-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError("payload digest or length differs")
    elif kind != "revisit" or payload or fields.get("warc-profile") != PROFILE:
        raise ValueError(f"unexpected record of type {kind}")
    refers = number("warc-refers-to") if kind == "revisit" else None
    return number("warc-record-id"), fields.get("warc-target-uri"), kind, size, digest, refers, payload


def _write(shard: int, dict_bytes: int, samples: int, date: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        size = 0
        for frame in frames:
            for page, url, html, n, digest, kind, refers in zip(
                frame["page_id"], frame["url"], frame["html"], frame["size"], frame["digest"], frame["kind"], frame["refers"]
            ):
                held.append(record(page, url, kind, (html or "").encode(), int(n), digest, refers, date))
                size += len(held[-1])
                if size >= shard:
                    yield pd.DataFrame({"value": [archive(held, dict_bytes, samples)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"value": [archive(held, dict_bytes, samples)]})

    return run


def write_warc(
    pages: DataFrame,
    path: str,
    revisit_bytes: int = 1000,
    shard: int = 8 << 20,
    dict_bytes: int = 16 << 10,
    samples: int = 256,
    salts: int = 64,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """One record per row of ``pages`` (page_id, url, html), in files of about
    ``shard`` bytes of records; payload the html in UTF-8, null as empty.

    Of rows with equal payloads (SHA-1 and length) of ``revisit_bytes`` or more
    that with the largest page_id is the response (all of that id, should it
    repeat; if all ids are null, all); the others revisit it and carry no
    payload. Digests meet their group's row by a salted join, so that a payload
    with a third of all rows is spread over ``salts`` keys. Each file's
    dictionary is trained on up to ``samples`` of its own records. An empty
    table writes no file."""
    html = F.coalesce("html", F.lit(""))
    base = pages.select(
        "page_id", "url", "html", F.octet_length(html).cast("long").alias("size"), F.sha1(html.cast("binary")).alias("digest")
    )
    large = F.col("size") >= revisit_bytes
    groups = base.where(large).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("refers"))
    groups = groups.where("n > 1").select(
        "digest", "size", "refers", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    )
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")
    told = base.withColumn("salt", salt).join(groups, ["digest", "size", "salt"], "left")
    again = F.coalesce(F.col("page_id") != F.col("refers"), F.col("refers").isNotNull())
    told = told.select(
        "page_id",
        "url",
        F.when(~again, F.col("html")).alias("html"),
        "size",
        "digest",
        F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(again, F.col("refers")).alias("refers"),
    )
    (
        told.mapInPandas(_write(shard, dict_bytes, samples, date), "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("lineSep", "\n")
        .text(path)
    )


def _read(with_payload: bool):
    names = [f.split()[0] for f in READ.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                rows = [parse(r) for r in read_archive(bytes(data))]
                out = pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                yield out if with_payload else out.assign(payload=None)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all files under ``path``, validated; see ``READ``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(_read(with_payload), READ)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives under the shared folder and reads them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path, with_payload=False)
