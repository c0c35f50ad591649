"""Token ids of whole texts in binary files of patched frame-of-reference blocks."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.text import chunks, given_id, identified, per_worker
from corpuslens.session import cut_lineage, workspace

BLOCK = 256  # ids in a block
FIT = 0.9  # share of a block's values that its width must hold
SEGMENT_TOKENS = 1 << 20
FILE_SEGMENTS = 32  # segments of a file at most, so that files stay far below what can be read at once
END_ID = 2
CACHED_WORDS = 1_000_000  # encoded words a worker remembers, about 200 MB

# A segment: this header, doc_ids (int64), lengths (uint32), then for each block
# its start (uint64, in ids' bytes), minimum (uint32), width (uint8) and number
# of exceptions (uint16), the packed words (uint64), and the exceptions' places
# (uint16) and values (uint32).  All little-endian.  Segments of a file follow
# one another, each with a line feed after it.
MAGIC = b"PFB1"
HEADER = "<4sQIQIIQ"  # magic, bytes after the header, documents, ids, blocks, packed words, exceptions


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(starts, minima, widths, exception counts, packed words, exception places, exception values)."""
    n = -(-len(ids) // BLOCK)
    values = np.full(n * BLOCK, ids[-1] if len(ids) else 0, np.uint64)
    values[: len(ids)] = ids
    values = values.reshape(n, BLOCK)
    minima = values.min(1) if n else np.zeros(0, np.uint64)
    rest = values - minima[:, None]
    lengths = _bit_lengths(rest)
    widths = np.sort(lengths, axis=1)[:, int(np.ceil(FIT * BLOCK)) - 1] if n else np.zeros(0, np.uint8)
    outside = lengths > widths[:, None]
    blocks, places = np.nonzero(outside)
    patched = rest[blocks, places].astype(np.uint32)
    rest[outside] = 0
    words = widths.astype(np.int64) * (BLOCK // 64)  # a width of w bits fills 4 w words
    starts = np.cumsum(words) - words
    packed = np.zeros(int(words.sum()), np.uint64)
    for width in np.unique(widths).tolist():
        if not width:
            continue
        rows = np.flatnonzero(widths == width)
        into = np.zeros((len(rows), width * (BLOCK // 64) + 1), np.uint64)
        for i in range(BLOCK):
            word, shift = divmod(i * width, 64)
            column = rest[rows, i]
            into[:, word] |= column << np.uint64(shift)
            if shift + width > 64:
                into[:, word + 1] |= column >> np.uint64(64 - shift)
        packed[starts[rows][:, None] + np.arange(width * (BLOCK // 64))] = into[:, :-1]
    return (
        starts.astype(np.uint64) * np.uint64(8), minima.astype(np.uint32), widths.astype(np.uint8),
        outside.sum(1).astype(np.uint16), packed, places.astype(np.uint16), patched,
    )


def unpack_blocks(
    n_ids: int, starts: np.ndarray, minima: np.ndarray, widths: np.ndarray, counts: np.ndarray, packed: np.ndarray,
    places: np.ndarray, patched: np.ndarray,
) -> np.ndarray:
    out = np.zeros((len(starts), BLOCK), np.uint64)
    begins = (starts // np.uint64(8)).astype(np.int64)
    for width in np.unique(widths).tolist():
        if not width:
            continue
        rows = np.flatnonzero(widths == width)
        words = packed[begins[rows][:, None] + np.arange(width * (BLOCK // 64))]
        mask = np.uint64((1 << width) - 1)
        for i in range(BLOCK):
            word, shift = divmod(i * width, 64)
            column = words[:, word] >> np.uint64(shift)
            if shift + width > 64:
                column = column | words[:, word + 1] << np.uint64(64 - shift)
            out[rows, i] = column & mask
    out[np.repeat(np.arange(len(starts)), counts), places] = patched
    out += minima[:, None].astype(np.uint64)
    return out.ravel()[:n_ids].astype(np.uint32)


def encode_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    parts = pack_blocks(ids)
    body = b"".join([doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), *[p.astype(p.dtype.newbyteorder("<")).tobytes() for p in parts]])
    return struct.pack(HEADER, MAGIC, len(body), len(doc_ids), len(ids), len(parts[0]), len(parts[4]), len(parts[5])) + body


def read_segments(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, lengths, ids) of each segment of a file."""
    at = 0
    while at < len(content):
        magic, size, docs, n_ids, blocks, words, exceptions = struct.unpack_from(HEADER, content, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += struct.calcsize(HEADER)
        end = at + size
        arrays = []
        for kind, n in (("<i8", docs), ("<u4", docs), ("<u8", blocks), ("<u4", blocks), ("u1", blocks), ("<u2", blocks), ("<u8", words), ("<u2", exceptions), ("<u4", exceptions)):
            arrays.append(np.frombuffer(content, kind, n, at))
            at += arrays[-1].nbytes
        yield arrays[0], arrays[1], unpack_blocks(n_ids, *arrays[2:])
        at = end + 1


class WordEncoder:
    """Encodes texts with a byte-level tokenizer that cuts words before single spaces, remembering words.

    Such a tokenizer starts a new piece at any space before a non-space, so
    the text between two such places is encoded on its own.
    """

    _CUT = re.compile(r"(?= \S)")
    _ODD = re.compile(r" (?:\s|$)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The library looks for these strings before anything else, so a text that holds one goes through it whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

        pieces = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.spaced = np.array([p is not None and p.startswith("\u0120") for p in pieces])  # how byte-level pieces write a space

    def _batch(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a space before it; words go through the tokenizer many at a time."""
        plain = [w for w in words if " " not in w]
        if not plain:
            return self._batch([" " + w for w in words])
        joined = ["".join(" " + w for w in plain[i : i + 500]) for i in range(0, len(plain), 500)]
        encoded = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *encoded])
        begin = np.flatnonzero(self.spaced[ids])
        if len(begin) != len(plain):  # a vocabulary whose pieces don't begin with the space
            return self._batch([" " + w for w in words])
        raw, ends = ids.tobytes(), (np.append(begin[1:], len(ids)) * 4).tolist()
        by_word = dict(zip(plain, (raw[a:b] for a, b in zip((begin * 4).tolist(), ends, strict=True)), strict=True))
        by_word.update(zip(rest := [w for w in words if " " in w], self._batch([" " + w for w in rest]), strict=True))
        return [by_word[w] for w in words]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        heads, tails = [], []
        for text in texts:
            if any(a in text for a in self.added):
                parts = [text]
            elif self._ODD.search(text):
                parts = self._CUT.split(text)
                parts = [parts[0], *[p[1:] for p in parts[1:]]]
            else:
                parts = text.split(" ")
            heads.append(parts[0])
            tails.append(parts[1:])
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = list(set().union(*tails).difference(self.known))
        self.known.update(zip(new, self._words(new), strict=True))
        first = self._batch(heads)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join([h, *map(get, t)]), np.uint32) for h, t in zip(first, tails, strict=True)]


def _written(path: str):
    def segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = per_worker(f"word-encoder:{path}", lambda: WordEncoder(path))
        doc_ids, parts, held = [], [], 0

        def segment() -> pd.DataFrame:
            lengths = np.array([len(p) for p in parts], np.uint32)
            return pd.DataFrame({"segment": [encode_segment(np.array(doc_ids, np.int64), lengths, np.concatenate(parts))]})

        for frame in chunks(frames):
            for i, ids in zip(frame["id"], encoder.encode([t or "" for t in frame["text"]]), strict=True):
                doc_ids.append(i)
                parts.append(np.append(ids, np.uint32(END_ID)))
                held += len(ids) + 1
                if held >= SEGMENT_TOKENS:
                    yield segment()
                    doc_ids, parts, held = [], [], 0
        if parts:
            yield segment()

    return segments


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Write the ids of all texts, each with END_ID after it, to token files under ``path`` in ascending doc_id order.

    Documents are dealt into ranges of (doc_id, hash of the text) and sorted
    there, in segments of about a million ids and files of FILE_SEGMENTS
    segments.  Spark's own writer stores the bytes, so a task that is run again
    leaves nothing twice.  A null text is empty; a null doc_id comes last; rows
    with equal doc_ids follow one another in order of those hashes.
    """
    dealt = identified(docs).repartitionByRange("id", "key").sortWithinPartitions("id", "key", "text").select("id", "text")
    segments = dealt.mapInPandas(_written(tokenizer), "segment binary").select(F.col("segment").cast("string"))
    segments.write.option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for name, content in zip(frame["path"], frame["content"], strict=True):
            for number, (doc_ids, lengths, ids) in enumerate(read_segments(content)):
                ends = np.cumsum(lengths.astype(np.int64))
                begins = ends - lengths
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pd.DataFrame({
                    "file": name, "segment": number, "id": doc_ids, "place": np.arange(len(doc_ids)), "begin": begins,
                    "n_tokens": lengths.astype(np.int64), "ids_crc32": crc,
                })


def read_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file, segment), read back from the files; ``docs`` gives the session."""
    spark = docs.sparkSession
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(
        _read, "file string, segment int, id bigint, place bigint, begin bigint, n_tokens bigint, ids_crc32 bigint"
    )
    rows = cut_lineage(rows, "tokens")
    totals = rows.groupBy("file", "segment").agg(F.sum("n_tokens").alias("n"), F.min("id").alias("low"))
    per_file = totals.groupBy("file").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
    before = W.orderBy("low", "file").rowsBetween(W.unboundedPreceding, -1)
    file_starts = per_file.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))
    inside = W.partitionBy("file").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("file", "segment", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("segment_start"))
    starts = starts.join(file_starts, "file").select("file", "segment", (F.col("file_start") + F.col("segment_start")).alias("_start"))
    return rows.join(starts, ["file", "segment"]).select(
        given_id().alias("doc_id"), (F.col("_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", "file", "segment"
    )


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write token files to the shared folder and read them back; see ``write_tokens`` and ``read_tokens``.

    An empty table gives no rows.  Other columns aren't read.
    """
    path = workspace(docs.sparkSession, "token-files")
    write_tokens(docs, tokenizer, path)
    return read_tokens(docs, path)
