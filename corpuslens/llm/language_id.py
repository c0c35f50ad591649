"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.functions.hashing import tag_hash
from corpuslens.llm.text import chunks
from corpuslens.session import cut_lineage

SIZES = (1, 2, 3)  # characters in a gram; three code points fit into 63 bits
PROFILE = 400  # grams in a language's profile
TOP = 300  # grams of a document that are compared
TRAINING_DOCUMENTS = 10_000  # most documents per language that a profile is learned from
UNKNOWN = "und"

_SPACE = 32


def _code_points(text: str) -> np.ndarray:
    """Lower-cased letters, with one space for each run of anything else, and one at each end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_letter = (points - 97 < 26)
    letter = ascii_letter.copy()
    other = np.flatnonzero(points >= 128)
    if len(other):
        values, where = np.unique(points[other], return_inverse=True)
        letter[other] = np.array([chr(v).isalpha() for v in values.tolist()])[where]
    clean = np.where(letter, points, _SPACE)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others
    clean = clean[keep]
    if not len(clean) or not letter.any():
        return np.zeros(0, np.uint32)
    ends = np.full(1, _SPACE, np.uint32)
    return np.concatenate([ends[: int(clean[0] != _SPACE)], clean, ends[: int(clean[-1] != _SPACE)]])


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(gram, count) over the whole text, grams of white space alone left out."""
    points = _code_points(text or "").astype(np.int64)
    grams = []
    for size in SIZES:
        n = len(points) - size + 1
        if n > 0:
            code = points[:n].copy()
            for j in range(1, size):
                code <<= 21
                code |= points[j : j + n]
            grams.append(code if size > 1 else code[code != _SPACE])
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values, counts = np.unique(np.concatenate(grams), return_counts=True)
    return values, counts


def top_grams(values: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The most frequent grams in order; ties go by code points."""
    if len(values) > n:
        # Everything above the n-th count, and enough of the ties, which are in order already.
        limit = np.partition(counts, len(counts) - n)[len(counts) - n]
        keep = counts >= limit
        values, counts = values[keep], counts[keep]
    return values[np.argsort(-counts, kind="stable")][:n]


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, gram, n) summed over each chunk of texts."""
    for frame in chunks(frames):
        for lang, texts in frame.groupby("lang")["text"]:
            parts = [gram_counts(t) for t in texts]
            values, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(where, np.concatenate([p[1] for p in parts]), len(values)).astype(np.int64)
            yield pd.DataFrame({"lang": lang, "gram": values, "n": n})


@dataclass
class Profiles:
    """Ranks of grams by language: a row per gram, a column per language; PROFILE where a language lacks the gram."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language at the least out-of-place distance, and 1 - distance / greatest distance."""
        top = top_grams(*gram_counts(text), TOP)
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        known = self.grams[at] == top
        ranks = np.where(known[:, None], self.ranks[at], PROFILE)
        apart = np.where(ranks == PROFILE, PROFILE, np.abs(ranks - np.arange(len(top))[:, None])).sum(0)
        best = int(np.argmin(apart))  # languages are in order of name, so the first wins ties
        return self.langs[best], float(1 - apart[best] / (PROFILE * len(top)))


def learned(docs: DataFrame, most: int = TRAINING_DOCUMENTS) -> Profiles:
    """Profiles from rows (doc_id, text, lang): PROFILE grams of at most ``most`` documents per language.

    The documents are those whose md5 comes first, in slices of the md5 range,
    so that which are taken depends on doc_id alone.  Only the profiles come to
    the driver: languages times PROFILE numbers.
    """
    named = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    share = named.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(most)) / F.count(F.lit(1))).alias("_share"))
    share = cut_lineage(share, "shares")
    place = F.conv(F.substring(tag_hash("lang", 1, "doc_id"), 1, 8), 16, 10).cast("double") / 4294967296.0
    chosen = named.join(share, "lang").filter(place < F.col("_share")).select("lang", "text")
    counts = chosen.mapInPandas(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PROFILE).toPandas()
    langs = sorted(top["lang"].unique())
    grams = np.unique(top["gram"].to_numpy(np.int64))
    ranks = np.full((len(grams), len(langs)), PROFILE, np.int32)
    ranks[np.searchsorted(grams, top["gram"]), np.searchsorted(langs, top["lang"])] = top["rank"] - 1
    return Profiles(langs, grams, ranks)


def held_out(doc_id: str = "doc_id") -> Column:
    """A third of the documents, by crc32 of doc_id as text; a null doc_id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(True))


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", prefix: str = "") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (with ``prefix``); other columns stay as they are."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    out = docs.withColumn("_predicted", predicted(F.col(text)))
    return out.withColumns({
        f"{prefix}lang_pred": F.col("_predicted.lang_pred"), f"{prefix}score": F.col("_predicted.score")
    }).drop("_predicted")


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row per document.

    Profiles are learned from the documents that aren't held out and have a
    language.  Grams are runs of one to three lower-cased letters or word ends.
    ``score`` is 1 - distance / greatest possible distance, 0 for texts like
    no profile.  A null text or one without letters is ``und`` with score 0,
    and so is every text if nothing could be learned.  Ties go to the first
    language by name.  Repeated rows have a row each; null doc_ids are held
    out; other columns aren't read; an empty table gives no rows.
    """
    slim = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    profiles = learned(slim.filter(~F.col("held_out")))
    return identify(slim.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
