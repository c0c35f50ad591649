"""Word scanning and hashing of whole texts in NumPy, for use inside tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20  # text handled at once in a Python worker; longer texts are one chunk
LAST_ID = (1 << 63) - 1  # stands for a null doc_id: after every other document
SPACES = b"\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


@dataclass
class Words:
    """The words of some texts: ``doc`` numbers the text of each word."""

    buffer: bytes
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # first word of each text, and the number of words at the end

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word, equal for equal words in any block."""
        codes = _BYTE_CODE[np.frombuffer(self.buffer, np.uint8)]
        ones = np.full(len(codes), _BASE, np.uint64)
        codes *= np.cumprod(ones)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes, out=sums[1:])
        back = np.cumprod(np.full(len(codes), _BASE_INVERSE, np.uint64))
        return mix((sums[self.end] - sums[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64))

    def runs(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each ``size`` consecutive words, and whether they are of one text."""
        n = max(0, len(hashes) - size + 1)
        out = np.zeros(n, np.uint64)
        for j in range(size):
            out *= _BASE
            out += hashes[j : j + n]
        return mix(out), self.doc[:n] == self.doc[size - 1 : size - 1 + n]

    def strings(self, a: int, b: int) -> list[bytes]:
        return [self.buffer[s:e] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


def scan(texts: list[str | None], lower: bool = False) -> Words:
    """Cut texts into words at ASCII white space; null has no words."""
    raw = [((t.lower() if lower else t) if t else "").encode("utf-8", "surrogatepass") for t in texts]
    buffer = b"\n".join(raw) + b"\n"
    inside = ~_IS_SPACE[np.frombuffer(buffer, np.uint8)]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    limits = np.cumsum([len(r) + 1 for r in raw])
    first = np.concatenate([[0], np.searchsorted(start, limits)])
    doc = np.repeat(np.arange(len(raw)), np.diff(first))
    return Words(buffer, start, end, doc, first)


def chunks(frames: Iterator[pd.DataFrame], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pd.DataFrame]:
    """Cut frames into pieces of about ``limit`` characters, so that memory doesn't follow the batch size."""
    for frame in frames:
        ends = np.cumsum(frame[text].str.len().fillna(0).to_numpy(np.int64) + 1)
        a = 0
        while a < len(frame):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
            yield frame.iloc[a:b]
            a = b


def per_worker(name: str, make: Callable):
    """An object that lives as long as the Python worker, which Spark uses for many tasks in turn.

    Task code travels by value, so its own globals are new in each task.
    """
    kept = sys.__dict__.setdefault("_corpuslens_worker", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def identified(docs: DataFrame) -> DataFrame:
    """(id, key, text): ``id`` is doc_id or LAST_ID, ``key`` a hash of the text.

    Together they name a row even where doc_ids repeat; equal rows are one.
    Other columns don't go on, so their names can't clash.
    """
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("key"), "text"
    )


def given_id(c: str = "id") -> Column:
    return F.when(F.col(c) != LAST_ID, F.col(c))


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
