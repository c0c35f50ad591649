"""Token counts of a unigram tokenizer without its pieces: Viterbi over Aho-Corasick matches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.text import chunks, per_worker

UNKNOWN_PENALTY = 10.0  # below the lowest score, as in the tokenizers library
CACHED_WORDS = 1_000_000  # words a worker remembers, about 150 MB
SPACE = "▁"


def piece_scores(path: str) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) in order of id, and the unknown piece's id, of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class CountingViterbi:
    """Best score and number of pieces under a unigram vocabulary.

    The rules are those of the tokenizers library's Unigram model: among equal
    scores the piece that starts first wins; a character that is no piece of
    its own is unknown, at UNKNOWN_PENALTY below the lowest score; unknown
    neighbours are one; with byte fallback an unknown stretch counts its bytes.
    A space is written as U+2581, and one stands before a text that isn't empty.
    """

    def __init__(self, vocabulary: Sequence[tuple[str, float]], unknown: int, byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        # A piece that comes twice keeps its last score, as in the library's table of ids.
        for piece, score in dict(vocabulary).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown_score = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))
        # No piece has a space after another character, so no piece crosses the start of a run of spaces, and whole
        # scores add up exactly in any order: then words may be taken one by one, and remembered.
        self.by_word = all(s.is_integer() for _, s in vocabulary) and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.known: dict[str, tuple[float, int]] = {}

    def viterbi(self, text: str) -> tuple[float, int]:
        """(score, pieces) of a text that is written with U+2581."""
        n = len(text)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = [False] * (n + 1)
        done[0] = True
        matches = self.automaton.iter(text)
        item = next(matches, None)
        for end in range(1, n + 1):
            # Matches with one end come from the longest to the shortest, so the earliest start comes first.
            while item is not None and item[0] == end - 1:
                length, s = item[1]
                start = end - length
                s += score[start]
                if not done[end] or s > score[end]:
                    done[end], score[end], count[end], unknown[end] = True, s, count[start] + 1, False
                item = next(matches, None)
            if text[end - 1] not in self.single:
                s = self.unknown_score + score[end - 1]
                if not done[end] or s > score[end]:
                    if self.bytes:
                        more = len(text[end - 1].encode("utf-8", "surrogatepass"))
                    else:
                        more = 0 if unknown[end - 1] else 1
                    done[end], score[end], count[end], unknown[end] = True, s, count[end - 1] + more, True
        return score[n], count[n]

    def count(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        text = SPACE + text.replace(" ", SPACE)
        # Without bytes, unknown stretches may run from word to word; then the text is one.
        if not (self.by_word and self.bytes):
            return self.viterbi(text)
        words = re.findall(f"{SPACE}+[^{SPACE}]*", text)
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        score, total = 0.0, 0
        for w in words:
            found = known.get(w)
            if found is None:
                found = self.viterbi(w)
                if len(w) < 64:
                    known[w] = found
            score += found[0]
            total += found[1]
        return score, total


def token_counts(docs: DataFrame, pieces: str) -> DataFrame:
    """(doc_id, n_tokens, score, n_chars), a row per document, under the pieces and scores of a sentencepiece file.

    Whole texts are counted; null and empty texts have no tokens and score 0;
    repeated rows have a row each; null doc_ids stay null; other columns aren't
    read; an empty table gives no rows.
    """

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        viterbi = per_worker(f"viterbi:{pieces}", lambda: CountingViterbi(*piece_scores(pieces)))
        for frame in chunks(frames):
            rows = [viterbi.count(t) for t in frame["text"]]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].to_numpy(), "n_tokens": [n for _, n in rows], "score": [s for s, _ in rows],
                "n_chars": [len(t or "") for t in frame["text"]],
            })

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(
        counted, "doc_id bigint, n_tokens bigint, score double, n_chars bigint"
    )
