"""A training corpus from raw documents: five stages, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.decontamination import decontaminated
from corpuslens.llm.language_id import UNKNOWN, held_out, identify, learned
from corpuslens.llm.mixing import mixed
from corpuslens.llm.near_dedup import deduplicated
from corpuslens.llm.token_files import token_digest
from corpuslens.session import cut_lineage

TOKENIZER = "byte_bpe_50k.json"
#: Of a text in a language that was learned. On sf0.1 whole documents have 0.396 at least, and 24,000 cuts of held-out documents
#: of 5 to 300 characters 0.301 at least; from 150 characters on 0.407, where noise in Latin letters and other Latin-script
#: languages have 0.28 at most and other scripts are near 0. Shorter texts say less, so a lower score keeps them.
LEAST_SCORE = 0.35
LEAST_SCORE_SHORT = 0.25
SHORT_CHARACTERS = 150

#: Profiles and hash-seeded files have no SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus names: texts without letters, noise and other languages go, nulls too."""
    profiles = learned(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    packed = docs.select(F.struct(*docs.columns).alias("_given"), F.col("text").alias("_text"))
    scored = identify(packed, profiles, "_text", "_")
    least = F.when(F.char_length("_text") < SHORT_CHARACTERS, LEAST_SCORE_SHORT).otherwise(LEAST_SCORE)
    kept = scored.filter((F.col("_lang_pred") != UNKNOWN) & (F.col("_score") >= least))
    return kept.select(*[F.col(f"_given.{c}") for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed(docs)


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all texts, and what they hold: a row per document and copy."""
    return token_digest(docs, public_tokenizers.path(TOKENIZER)).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language ID", known_language),
    ("near-duplicate removal", one_of_each),
    ("decontamination", without_benchmark),
    ("source mix", source_mix),
    ("token blocks", token_blocks),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
