"""Web archives with one Zstandard frame per record and their dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.text import chunks
from corpuslens.plans.prefix import salted_join
from corpuslens.session import workspace

NO_ID = -(1 << 63)  # stands for a null page_id: before every other page
ARCHIVE_BYTES = 32 << 20  # records in one archive; a longer record is an archive of its own
DICTIONARY_BYTES = 16 << 10
SAMPLE_BYTES = 1 << 20  # of an archive's records that its dictionary is trained on
LEVEL = 3
FED_BYTES = 64 << 10  # given to the decoder at once

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
DATE = "1970-01-01T00:00:00Z"  # pages carry no date
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


class ArchiveError(ValueError):
    """An archive that breaks its format."""


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _uri(url: str | None, page_id: int | None) -> str:
    """A header value: white space, controls and all beyond ASCII as percent codes."""
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "surrogatepass")).decode()


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One response record, or a revisit of the page ``refers_to``, which keeps the HTTP header alone."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url, page_id)), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"%s\r\n%s\r\n%s\r\n\r\n" % (VERSION, head.encode(), block)


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on records spread over an archive; where they are too few to train, their beginnings are the dictionary."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples = [r[:SAMPLE_BYTES] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        raw = b"".join(r[:2048] for r in samples)[:DICTIONARY_BYTES]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def encode_archive(records: list[bytes]) -> bytes:
    """The dictionary in a skippable frame, then a frame per record."""
    dictionary = _dictionary(records)
    raw = dictionary.as_bytes()
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw, *[packer.compress(r) for r in records]])


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"not a header: {line[:60]!r}")
        key = name.decode("utf-8").lower()
        if key in out:
            raise ArchiveError(f"a header twice: {key}")
        out[key] = value.strip().decode("utf-8")
    return out


def _length(fields: dict[str, str]) -> int:
    value = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]+", value):
        raise ArchiveError(f"not a length: {value!r}")
    return int(value)


def parse_record(raw: bytes) -> Record:
    """A record whose headers, lengths and digests hold; anything else raises ``ArchiveError``."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise ArchiveError("no record header")
    fields = _fields(lines[1:])
    for name in NEEDED:
        if name.lower() not in fields:
            raise ArchiveError(f"no {name}")
    n = _length(fields)
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ArchiveError(f"a block of {len(rest) - 4} bytes where the header says {n}")
    block = rest[:n]
    if (given := fields.get("warc-block-digest")) is not None and given != f"sha1:{sha1_base32(block)}":
        raise ArchiveError("wrong block digest")
    return Record(fields, block)


def parse_payload(record: Record) -> tuple[int, str]:
    """(bytes, digest) of the full payload; that of a response is measured, that of a revisit is what it states."""
    kind, digest = record.headers["warc-type"], record.headers.get("warc-payload-digest", "")
    head, gap, payload = record.block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"HTTP/"):
        raise ArchiveError("no HTTP header")
    n = _length(_fields(lines[1:]))
    if kind == "response":
        if len(payload) != n:
            raise ArchiveError(f"a payload of {len(payload)} bytes where the header says {n}")
        if digest != f"sha1:{sha1_base32(payload)}":
            raise ArchiveError("wrong payload digest")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in record.headers or not re.fullmatch(r"sha1:[A-Z2-7]{32}", digest):
            raise ArchiveError("a revisit needs a reference and a digest, and has no payload")
    else:
        raise ArchiveError(f"an unknown kind of record: {kind}")
    return n, digest.removeprefix("sha1:")


def _frame(reader: zstandard.ZstdDecompressor, content: bytes, at: int) -> tuple[bytes, int]:
    """What the frame at byte ``at`` holds, and where it ends."""
    frame, parts = reader.decompressobj(), []
    while not frame.eof:
        if at >= len(content):
            raise ArchiveError("an archive that ends inside a frame")
        try:
            parts.append(frame.decompress(content[at : at + FED_BYTES]))
        except zstandard.ZstdError as e:
            raise ArchiveError(f"a broken frame: {e}") from e
        at = min(at + FED_BYTES, len(content))
    return b"".join(parts), at - len(frame.unused_data)


def read_archive(content: bytes) -> Iterator[Record]:
    """The records of an archive, one frame at a time; other skippable frames are passed over."""
    at, reader, first = 0, zstandard.ZstdDecompressor(), True
    while at < len(content):
        if len(content) - at < 8:
            raise ArchiveError("an archive that ends inside a frame")
        magic, size = struct.unpack_from("<II", content, at)
        if magic in SKIPPABLE:
            raw = content[at + 8 : at + 8 + size]
            if len(raw) != size:
                raise ArchiveError("an archive that ends inside a skippable frame")
            if magic == DICTIONARY_FRAME:
                if not first:
                    raise ArchiveError("a dictionary after the first frame")
                if raw[:4] == struct.pack("<I", FRAME):  # the dictionary itself may be compressed
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
        elif magic == FRAME:
            raw, at = _frame(reader, content, at)
            yield parse_record(raw)
        else:
            raise ArchiveError(f"no frame at byte {at}")
        first = False


def _archived(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    records, held = [], 0

    def archive() -> pd.DataFrame:
        # The writer ends each row with a line feed: the content of a last skippable frame.
        return pd.DataFrame({"archive": [encode_archive(records) + struct.pack("<II", SKIPPABLE[0], 1)]})

    for frame in chunks(frames, "html"):
        for page_id, url, html, target in zip(frame["id"].tolist(), frame["url"], frame["html"], frame["target"].tolist(), strict=True):
            payload = (html or "").encode("utf-8", "surrogatepass")
            record = write_record(None if page_id == NO_ID else page_id, url, payload, None if target == NO_ID else target)
            if records and held + len(record) > ARCHIVE_BYTES:
                yield archive()
                records, held = [], 0
            records.append(record)
            held += len(record)
    if records:
        yield archive()


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write a record per page to archives under ``path``.

    Of pages with equal payloads of ``least`` bytes or more, those of the
    largest page_id become responses and the others revisits of it.  Spark's
    own writer stores each archive as a file, so a task that runs again leaves
    nothing twice.
    """
    slim = pages.select(
        F.coalesce(F.col("page_id").cast("bigint"), F.lit(NO_ID)).alias("id"), "url", "html",
        F.sha2(F.coalesce("html", F.lit("")), 256).alias("payload"),
    )
    groups = slim.filter(F.coalesce(F.octet_length("html"), F.lit(0)) >= least).groupBy("payload").agg(
        F.max("id").alias("newest"), F.min("id").alias("oldest"), F.count(F.lit(1)).alias("_rows")
    )
    # Only pages of several ids share a payload; their join splits a payload that very many pages have.
    shared = groups.filter("oldest < newest").select("payload", "newest", "_rows")
    named = salted_join(slim, shared, ["payload"], "left", count="_rows")
    target = F.when(F.col("newest") > F.col("id"), F.col("newest")).otherwise(F.lit(NO_ID))
    rows = named.select("id", "url", "html", target.alias("target"))
    archives = rows.mapInPandas(_archived, "archive binary").select(F.col("archive").cast("string"))
    archives.write.option("maxRecordsPerFile", 1).text(path)


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for content in frame["content"]:
            rows = []
            for record in read_archive(content):
                n, digest = parse_payload(record)
                page, target = (record.headers.get(k) for k in ("x-page-id", "x-refers-to-page-id"))
                rows.append((
                    NO_ID if page is None else int(page), n, digest, record.headers["warc-type"], NO_ID if target is None else int(target),
                    record.headers.get("warc-target-uri"),
                ))
            yield pd.DataFrame(rows, columns=["id", "payload_bytes", "payload_digest", "record_type", "target", "target_uri"])


def read_archives(pages: DataFrame, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri) of all records; ``pages`` gives the session."""
    files = pages.sparkSession.read.format("binaryFile").load(path).select("content")
    rows = files.mapInPandas(_read, "id bigint, payload_bytes bigint, payload_digest string, record_type string, target bigint, target_uri string")
    known = [F.when(F.col(c) != NO_ID, F.col(c)).alias(name) for c, name in (("id", "page_id"), ("target", "refers_to"))]
    return rows.select(known[0], "payload_bytes", "payload_digest", "record_type", known[1], "target_uri")


def archive_digest(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write a record per page to archives in the shared folder and read them back; see ``write_archives``.

    The reader takes the dictionary from the leading skippable frame, decodes
    one frame per record and checks version, headers, lengths and digests; a
    broken archive raises ``ArchiveError``.  ``payload_bytes`` and
    ``payload_digest`` are those of the full payload, for revisits too.  A
    null html is an empty payload.  A null page_id comes before all others,
    and stays null.  Rows equal in page_id and html are equal records: all
    are responses, or all revisits.  A null or empty url is named after the
    page.  An empty table gives no rows; other columns aren't read.
    """
    path = workspace(pages.sparkSession, "archives")
    write_archives(pages, path, least)
    return read_archives(pages, path)
