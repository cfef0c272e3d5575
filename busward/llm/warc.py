"""WARC archives with one Zstandard dictionary each, written and read by Spark tasks.

An archive starts with a skippable frame that holds a dictionary built from its own records; each record
is a frame of its own, so any record can be read alone. Files go through Spark's text writer, which works
on any store and commits only finished tasks. Its line separator is itself an empty skippable frame, so
the files are plain concatenations of Zstandard frames.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from busward.llm.common import fresh_path, staged, width

# Fixed values of the Zstandard format and of its use in WARC files.
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGICS = range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = "P*M\x18\0\0\0\0"  # magic 0x184D2A50, length 0: all ASCII

PREFIX = "urn:busward:page:"


def _header_value(value: str) -> str:
    """Control characters would end a header line; they and % are percent-encoded."""
    return "".join(c if c >= " " and c not in "%\x7f" else f"%{ord(c):02X}" for c in value)


def _record_id(page: str) -> str:
    return f"<{PREFIX}{page}>"


def _record(kind: str, page: str, url: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page)}",
        f"WARC-Target-URI: {_header_value(url)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(date: str) -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:busward:info>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; where records are too few or too alike for training, their last bytes as they are."""
    try:
        return zstandard.train_dictionary(size, samples)
    except (zstandard.ZstdError, ValueError):
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _frame_length(data: memoryview, at: int) -> int:
    """Bytes of the frame that starts at `at`, from its headers alone."""
    (magic,) = struct.unpack_from("<I", data, at)
    if magic in SKIPPABLE_MAGICS:
        return 8 + struct.unpack_from("<I", data, at + 4)[0]
    if magic != FRAME_MAGIC:
        raise ValueError(f"no Zstandard frame at {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    content = (single, 2, 4, 8)[flags >> 6]
    end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + content
    while True:
        block = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return end + 4 * (flags >> 2 & 1) - at


def _parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        fields[name] = value
    return fields, rest[: int(fields["Content-Length"])]


def write_archives(
    pages: DataFrame,
    path: str,
    min_revisit_bytes: int = 100,
    archive_bytes: int = 32 << 20,
    dictionary_bytes: int = 64 << 10,
    sample_bytes: int = 4 << 20,
    level: int = 3,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write page_id, url and html as WARC records under `path`.

    Of equal payloads of at least min_revisit_bytes, the smallest page_id is the response and the others
    are revisits of it. A null html is an empty payload, a null url an empty one. Null page ids come after
    all others; equal payloads without any id are all responses, as are repeated rows of the smallest id.
    archive_bytes is the mean of payload in a file. The dictionary of a file is built from its own first
    sample_bytes of records; that bounds memory and concerns size only.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    # Ids travel as text: joins need no null-safe keys, and pandas makes doubles of numbers with nulls.
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    rows = pages.select("page_id", key.alias("page"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    slim = staged(rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("size")), "warc-digests")
    (total,) = slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()
    first = slim.filter(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # Only what is a revisit meets the pages again, by page and digest: no digest is a hot key there.
    revisits = (
        slim.join(first.drop("n"), "digest")
        .filter(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
        .select(key.alias("page"), "digest", F.col("first").cast("string").alias("first"))
        .distinct()
    )
    files = max(1, -(-total // archive_bytes))
    parts = max(files, min(width(spark), files * 4))
    joined = rows.repartition(parts, "page", "digest").join(revisits.repartition(parts, "page", "digest"), ["page", "digest"], "left")
    dealt = joined.sortWithinPartitions("page", "digest", "url").select("page", "url", "payload", "digest", "first")

    def archived(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[bytes] = []
        held, packer = 0, None

        def start() -> Iterator[bytes]:
            words = _dictionary(waiting, dictionary_bytes)
            raw = words.as_bytes()
            yield struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
            nonlocal packer
            packer = zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=True)
            yield from (packer.compress(r) for r in [_info(date), *waiting])
            waiting.clear()

        for pdf in batches:
            out: list[bytes] = []
            for page, url, body, digest, origin in zip(*(pdf[c] for c in ("page", "url", "payload", "digest", "first")), strict=True):
                record = _record("response" if origin is None else "revisit", page, url, bytes(body), digest, origin, date)
                if packer:
                    out.append(packer.compress(record))
                else:
                    waiting.append(record)
                    held += len(record)
                    if held >= sample_bytes:
                        out.extend(start())
            if out:
                yield pd.DataFrame({"frame": out})
        if waiting:
            yield pd.DataFrame({"frame": list(start())})

    frames = dealt.mapInPandas(archived, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each response or revisit: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    The payload of a revisit is null; its length and digest are those its record states. A response whose
    payload does not have the stated digest is an error. Files are read whole, one at a time, in a task.
    """

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        def page(reference: str | None):
            number = (reference or "").removeprefix(f"<{PREFIX}").removesuffix(">")
            return int(number) if number.lstrip("-").isdigit() else None

        for pdf in batches:
            for content in pdf["content"]:
                data, at, opener, rows = memoryview(content), 0, zstandard.ZstdDecompressor(), []
                while at < len(data):
                    size = _frame_length(data, at)
                    (magic,) = struct.unpack_from("<I", data, at)
                    if magic == DICTIONARY_MAGIC and at == 0:
                        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[8:size])))
                    elif magic == FRAME_MAGIC:
                        fields, block = _parsed(opener.decompress(data[at : at + size]))
                        if (kind := fields["WARC-Type"]) in ("response", "revisit"):
                            http, _, body = block.partition(b"\r\n\r\n")
                            stated = int(http.decode().rpartition("Content-Length: ")[2])
                            digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                            if kind == "response" and (len(body) != stated or hashlib.sha256(body).hexdigest() != digest):
                                raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                            rows.append(
                                (page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, page(fields.get("WARC-Refers-To")), stated, digest, body if kind == "response" else None)
                            )
                    at += size
                    if len(rows) >= 1000:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
        return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(unpacked, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archived(pages: DataFrame, **settings) -> DataFrame:
    """Write pages to a new folder of archives in the shared folder, and read them back."""
    path = fresh_path(pages.sparkSession, "archives")
    write_archives(pages, path, **settings)
    return read_archives(pages.sparkSession, path)
