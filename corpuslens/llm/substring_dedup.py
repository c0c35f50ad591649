"""Repeated passages across documents: an FM-index per shard, searched backward by all documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.text import LAST_ID, Words, chunks, given_id, identified, scan
from corpuslens.session import cut_lineage, discard

WINDOW = 13  # words
GRAM = 3  # words in an anchor
SHARD_WORDS = 400_000  # words of an FM-index, and of one anchor before its windows are dealt out singly


_LOWER_BITS = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class BitVector:
    """Packed bits with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(ones[:-1], dtype=np.int32)]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones in the first ``i`` bits."""
        word = i >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & _LOWER_BITS[i & 63])


class WaveletTree:
    """A level-wise wavelet tree: one bit vector per bit of a symbol, packed."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        now = symbols
        for level in range(self.depth - 1, -1, -1):
            bits = (now >> level) & 1
            self.levels.append(BitVector(bits.astype(np.uint8)))
            self.zeros.append(int(len(bits) - bits.sum()))
            now = np.concatenate([now[bits == 0], now[bits == 1]])
        # Where each symbol starts in the last level's order.
        self.first = self.descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.depth):
            ones = self.levels[k].rank(i)
            up = (symbol >> (self.depth - 1 - k)) & 1
            i = np.where(up, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each ``symbol`` among the first ``i``."""
        return self.descend(symbol, i) - self.first[symbol]


class FMIndex:
    """An FM-index over passages of word numbers (1 and above), for patterns of up to ``depth`` words."""

    def __init__(self, words: np.ndarray, length: np.ndarray, sigma: int, depth: int = WINDOW):
        """``words`` of all passages one after another, and the number of words of each."""
        owner = np.repeat(np.arange(len(length)), length + 1)
        text = np.zeros(len(owner), np.int64)  # a 0 ends each passage
        inside = np.ones(len(owner), bool)
        inside[np.cumsum(length + 1) - 1] = False
        text[inside] = words
        order, group = self._sorted(text, depth)
        self.size, self.depth = len(text), depth
        self.owner = owner[order]
        self.tree = WaveletTree(text[order - 1], sigma)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        # The rows that share their first depth - 1 words: what remains when a match drops its last word.
        new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(new, self.size))
        self.wider_low, self.wider_high = np.repeat(new, sizes), np.repeat(new + sizes, sizes)

    @staticmethod
    def _sorted(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order of their first ``depth`` words or more, and equal numbers for equal first depth - 1 words."""

        def ranked(keys: np.ndarray) -> np.ndarray:
            return np.unique(keys, return_inverse=True)[1].astype(np.int64)

        def joined(head: np.ndarray, tail: np.ndarray, at: int) -> np.ndarray:
            after = np.zeros(len(tail), np.int64)
            after[: len(tail) - at] = tail[at:] + 1
            return ranked(head * (int(tail.max()) + 2) + after)

        # Ranks by 2 ** k words, put together to exactly depth - 1 words and then beyond.
        powers, width = [ranked(text)], 1
        while width * 2 <= depth:
            powers.append(joined(powers[-1], powers[-1], width))
            width *= 2
        exact, covered = None, 0
        for k in range(len(powers) - 1, -1, -1):
            if (depth - 1) >> k & 1:
                exact = powers[k] if exact is None else joined(exact, powers[k], covered)
                covered += 1 << k
        full = joined(exact, powers[0], covered)
        order = np.argsort(full, kind="stable")
        return order, exact[order]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``symbol`` followed by what [low, high) begins with."""
        base, n = self.less[symbol], len(symbol)
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return base + both[:n], base + both[n:]

    def search(self, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the ``depth`` words from each place ``at`` of ``text``."""
        last = text[at + self.depth - 1]
        low, high = self.less[last], self.less[last + 1]
        for j in range(self.depth - 2, -1, -1):
            low, high = self.step(text[at + j], low, high)
        return low, high

    def matching_windows(self, text: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of every window of some passages in ``text``, whose windows start at ``first``, ``first`` + 1, ...

        All passages are walked together from their last window to their first:
        the match drops its last word, then takes the word before it by one
        backward step.  Where a match has ended, the window is searched anew.
        """
        begins = np.cumsum(count) - count
        low, high = np.zeros(int(count.sum()), np.int64), np.zeros(int(count.sum()), np.int64)
        live = np.flatnonzero(count > 0)
        a, b = self.search(text, first[live] + count[live] - 1)
        low[begins[live] + count[live] - 1], high[begins[live] + count[live] - 1] = a, b
        back = 1
        while True:
            keep = count[live] > back
            live, a, b = live[keep], a[keep], b[keep]
            if not len(live):
                return low, high
            at = first[live] + count[live] - 1 - back
            ended = a >= b
            here = np.minimum(a, self.size - 1)
            a, b = self.step(text[at], self.wider_low[here], self.wider_high[here])
            if ended.any():
                a[ended], b[ended] = self.search(text, at[ended])
            low[begins[live] + count[live] - 1 - back], high[begins[live] + count[live] - 1 - back] = a, b
            back += 1

    def least(self, values: np.ndarray, low: np.ndarray, high: np.ndarray, none: int) -> np.ndarray:
        """The least value of the passages that own rows [low, high); ranges are equal or disjoint."""
        out = np.full(len(low), none, np.int64)
        found = np.flatnonzero(low < high)
        if len(found):
            begins, which = np.unique(low[found], return_inverse=True)
            ends = np.zeros(len(begins), np.int64)
            ends[which] = high[found]
            rows = np.append(values[self.owner], none)
            out[found] = np.minimum.reduceat(rows, np.stack([begins, ends], 1).ravel())[::2][which]
        return out


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, text, anchor) of each window: the anchor is the rarest-looking GRAM in the window.

    It depends on the words of the window alone, so equal windows have equal
    anchors.  Long grams are preferred, because they seldom repeat by chance.
    """
    hashes = words.hashes()
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram, _ = words.runs(hashes, GRAM)
    length = np.minimum(words.end - words.start, 40).astype(np.float32)
    width = sum(length[j : j + len(gram)] for j in range(GRAM))
    place = -np.log(((gram >> np.uint64(40)).astype(np.float32) + 1) / np.float32(1 << 24)) / width**4
    # Floats from 0 upwards order as their bits do; below them stands the place, so the first of equals is least.
    least = ((place + np.float32(0)).view(np.uint32).astype(np.uint64) << np.uint64(32)) | np.arange(len(gram), dtype=np.uint64)
    covered, wanted = 1, WINDOW - GRAM + 1
    while covered < wanted:
        shift = min(covered, wanted - covered)
        least = np.minimum(least[: len(least) - shift], least[shift:])
        covered += shift
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = np.flatnonzero(words.doc[:n] == words.doc[WINDOW - 1 : WINDOW - 1 + n])
    return whole, words.doc[whole], gram[at[whole]].view(np.int64)


def _anchor_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, key, anchors): the distinct anchors of each text that has a window."""
    for frame in chunks(frames):
        _, doc, anchor = _anchors(scan(frame["text"].tolist()))
        order = np.lexsort((anchor, doc))
        doc, anchor = doc[order], anchor[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
        doc, anchor = doc[new], anchor[new]
        with_window, begin = np.unique(doc, return_index=True)
        yield pd.DataFrame({
            "id": frame["id"].to_numpy()[with_window], "key": frame["key"].to_numpy()[with_window],
            "anchors": np.split(anchor, begin[1:]) if len(begin) else [],
        })


def _passages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of windows that have one anchor, out of texts that come with the anchors they share with others."""
    for frame in chunks(frames):
        words = scan(frame["text"].tolist())
        at, doc, anchor = _anchors(words)
        shared = np.zeros(len(at), bool)
        limits = np.searchsorted(doc, np.arange(len(frame) + 1))
        for d, known in enumerate(frame["anchors"]):
            shared[limits[d] : limits[d + 1]] = np.isin(anchor[limits[d] : limits[d + 1]], np.asarray(known, np.int64))
        at, doc, anchor = at[shared], doc[shared], anchor[shared]
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(at)))
        first, owner = at[begin], doc[begin]
        begins, ends = words.start[first].tolist(), words.end[first + count + WINDOW - 2].tolist()
        texts = [b" ".join(words.buffer[a:b].split()).decode("utf-8", "surrogatepass") for a, b in zip(begins, ends, strict=True)]
        yield pd.DataFrame({
            "id": frame["id"].to_numpy()[owner], "key": frame["key"].to_numpy()[owner], "at": first - words.first[owner],
            "windows": count, "anchor": anchor[begin], "passage": texts,
        })


def _windows_of(passage: str) -> Column:
    """Each window of a passage as a passage of its own."""
    words = F.split(passage, " ")
    return F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.array_join(F.slice(words, i, WINDOW), " "))


def _search_shard(frame: pd.DataFrame) -> pd.DataFrame:
    """Index the passages of a shard and stream them against the index: the smallest document of each window."""
    words = scan(frame["passage"].tolist())
    names, text = np.unique(words.hashes(), return_inverse=True)  # 64 bits, so numbers stand for words
    text = text.astype(np.int64) + 1
    length = np.diff(words.first)
    ends = np.cumsum(length)
    index = FMIndex(text, length, len(names) + 1)
    count = length - WINDOW + 1
    low, high = index.matching_windows(text, ends - length, count)
    least = index.least(frame["first"].to_numpy(np.int64), low, high, LAST_ID)
    limits = np.cumsum(count)
    return pd.DataFrame({
        "anchor": frame["anchor"], "content": frame["content"],
        "least": [least[a:b] for a, b in zip(limits - count, limits, strict=True)],
    })


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(id, key, at, least): windows that also start in a document with a smaller id, ``least``; at counts words.

    Every window has an anchor, a run of three of its words that only its own
    words choose.  Anchors seen in one document alone are dropped; what remains
    is cut into passages of windows with one anchor, equal passages become one,
    and an anchor's passages form a shard with those of other anchors.  An
    anchor with more words than a shard holds is dealt out by whole windows.
    """
    rows = identified(docs)
    stored = cut_lineage(rows.mapInPandas(_anchor_rows, "id bigint, key bigint, anchors array<bigint>"), "seen")
    seen = stored.select("id", "key", F.explode("anchors").alias("anchor"))
    shared = seen.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("anchor")
    shared = cut_lineage(shared, "anchors")
    known = seen.join(shared, "anchor").groupBy("id", "key").agg(F.collect_set("anchor").alias("anchors"))
    known = cut_lineage(known, "known")
    discard(stored, shared)
    found = rows.join(known, ["id", "key"]).mapInPandas(
        _passages, "id bigint, key bigint, at bigint, windows bigint, anchor bigint, passage string"
    )
    passages = cut_lineage(found.withColumn("content", F.xxhash64("passage")), "passages", "zstd")

    def distinct(p: DataFrame) -> DataFrame:
        return p.groupBy("anchor", "content", "passage").agg(F.min("id").alias("first"))

    discard(known)
    one = cut_lineage(distinct(passages), "distinct", "zstd")
    words = F.size(F.split("passage", " "))
    hot = one.groupBy("anchor").agg(F.sum(words).alias("n")).filter(F.col("n") > SHARD_WORDS).select("anchor")
    hot = cut_lineage(hot, "hot")
    distinct_passages, single = one, None
    where = passages.select("id", "key", "at", "anchor", "content")
    if not hot.isEmpty():
        spread = passages.join(hot, "anchor").select("id", "key", "at", F.posexplode(_windows_of("passage")).alias("j", "passage"))
        spread = spread.select("id", "key", (F.col("at") + F.col("j")).alias("at"), F.xxhash64("passage").alias("anchor"), F.crc32("passage").alias("content"), "passage")
        # A window of one document alone can't be repeated.
        single = spread.groupBy("anchor", "content", "passage").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        single = cut_lineage(single.filter("first < last").drop("last"), "single")
        one = one.join(hot, "anchor", "left_anti").unionByName(single)
        where = where.join(hot, "anchor", "left_anti").unionByName(spread.select("id", "key", "at", "anchor", "content"))
    n_words = one.agg(F.sum(words)).first()[0] or 0
    shards = int(n_words // SHARD_WORDS) + 1
    sharded = one.withColumn("shard", F.pmod(F.xxhash64(F.col("anchor"), F.lit(7)), F.lit(shards)))
    least = sharded.groupBy("shard").applyInPandas(_search_shard, "anchor bigint, content bigint, least array<bigint>")
    least = cut_lineage(least, "least")
    discard(distinct_passages, single)
    hits = where.join(least, ["anchor", "content"]).filter(F.exists("least", lambda x: x < F.col("id")))
    return hits.select("id", "key", "at", F.posexplode("least").alias("j", "least")).filter(F.col("least") < F.col("id")).select(
        "id", "key", (F.col("at") + F.col("j")).alias("at"), "least"
    )


def _without(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in chunks(frames):
        count, removed, kept = [], [], []
        for text, at in zip(frame["text"], frame["at"], strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()  # at ASCII white space
            n = len(words)
            if at is not None and len(at):
                cover = np.zeros(n + 1, np.int32)
                np.add.at(cover, np.asarray(at), 1)
                np.add.at(cover, np.asarray(at) + WINDOW, -1)
                words = [w for w, c in zip(words, np.cumsum(cover[:-1]).tolist(), strict=True) if not c]
            count.append(n)
            removed.append(n - len(words))
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        yield pd.DataFrame({"id": frame["id"], "n_words": count, "n_removed": removed, "kept_text": kept})


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), a row per document.

    A word goes if it stands in a window of 13 words whose words also start in
    a document with a smaller doc_id; windows are judged on the input.  Words
    are runs without ASCII white space, taken as they are; the kept ones are
    joined by single spaces.  A null text has no words.  A null doc_id comes
    after all others.  Rows with the same doc_id are one document's: they
    don't remove words from each other.  Other columns aren't read; an empty
    table gives no rows.
    """
    at = repeated_windows(docs).groupBy("id", "key").agg(F.collect_set("at").alias("at"))
    at = cut_lineage(at, "covered")
    joined = identified(docs).join(at, ["id", "key"], "left").select("id", "text", "at")
    out = joined.mapInPandas(_without, "id bigint, n_words bigint, n_removed bigint, kept_text string")
    return out.select(given_id().alias("doc_id"), "n_words", "n_removed", "kept_text")


def removal_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): ``without_repeats`` with a digest in place of the text."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
