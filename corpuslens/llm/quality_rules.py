"""Quality rules: a table of thresholds compiled into Spark projections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8  # words in a repeated window

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "this",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "dans", "en", "pour", "par", "au", "sur",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "auf", "ist", "im", "dem", "nicht", "ein", "eine",
    "el", "los", "las", "y", "se", "del", "por", "con", "no", "su", "para", "es", "al", "lo",
)


@dataclass(frozen=True)
class Rule:
    """A metric must lie in [low, high]; None leaves a side open."""

    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("n_words", 20, 1_000_000),
    Rule("mean_word_chars", 2, 20),
    Rule("symbols_per_word", None, 0.4),
    Rule("stop_share", 0.01, None),
    Rule("dup_line_share", None, 0.6),
    Rule("repeat_share", None, 0.3),
)


def _runs(words: str, size: int) -> Column:
    """A hash for each run of ``size`` words, in order."""
    w = F.col(words)
    return F.transform(
        F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)])
    )


def measured(docs: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines), a row per document.

    Words are runs without ASCII white space; a null text has none.  A word
    counts as repeated if it stands in a window of eight words that is found
    twice or more in the text.  Texts whose windows all differ, which is nearly
    every text, need no more than a distinct count.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(
        "doc_id", text.alias("_text"), F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("_words")
    )
    lines = words.select(
        "doc_id", "_words",
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.when(F.size("_words") > WINDOW, _runs("_words", WINDOW)).otherwise(F.array().cast("array<bigint>")).alias("_runs"),
    )
    n_words = F.size("_words").cast("bigint")
    base = lines.select(
        "doc_id", n_words.alias("n_words"),
        F.char_length(F.concat_ws("", "_words")).cast("bigint").alias("word_chars"), "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*stop_words))).cast("bigint").alias("n_stop_words"),
        F.when(F.size("_runs") > F.size(F.array_distinct("_runs")), F.col("_runs")).alias("_runs"),
    )
    # Places in order of (hash, place): a run is repeated if a neighbour has its hash.
    tagged = base.withColumn("_runs", F.array_sort(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    r = F.col("_runs")
    repeated = F.filter(
        F.transform(r, lambda x, k: F.when((F.get(r, k - 1)["h"] == x["h"]) | (F.get(r, k + 1)["h"] == x["h"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    placed = tagged.withColumn("_runs", F.array_sort(repeated))
    # Each repeated window adds the words that the one before it didn't cover.
    p = F.col("_runs")
    covered = F.aggregate(
        F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(i - F.get(p, k - 1), F.lit(WINDOW)))),
        F.lit(0).cast("bigint"), lambda acc, n: acc + n,
    )
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("_runs")


def _ratios() -> dict[str, Column]:
    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "stop_share": share("n_stop_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }


def compiled(rules: Sequence[Rule] = RULES) -> Column:
    """The names of the rules that a measured row breaks, as one expression."""
    values = _ratios()
    broken = []
    for rule in rules:
        x = values[rule.metric]
        below = F.lit(False) if rule.low is None else x < rule.low
        above = F.lit(False) if rule.high is None else x > rule.high
        broken.append(F.when(below | above, F.lit(rule.metric)))
    return F.array_compact(F.array(*broken))


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, broken).

    ``base_failed``: under 20 words, or over 30% of the words repeated.
    ``kept``: base rules hold and no rule of the table is broken; ``broken``
    names those that are.  Null, empty and wordless texts have zeros and fail.
    Repeated rows are judged one by one; null doc_ids stay null; other columns
    aren't read; an empty table gives no rows.
    """
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return measured(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.size(compiled(rules)) == 0)).alias("kept"), F.array_join(compiled(rules), ",").alias("broken"),
    )
