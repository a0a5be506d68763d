"""From raw documents to token ids: classifier, quality rules, deduplication, mixing, SentencePiece.

Every stage takes and gives whole rows of documents, whatever further columns they have, and works on all that the one
before has kept. Null and empty texts go with the classifier, rows that repeat in full with deduplication, null doc_ids
are kept; an empty table stays empty through all stages. ``mix`` repeats rows, so ids may repeat after it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from korvane.llm import classifier, mixing, pieces, rules, simhash
from korvane.llm._common import discard, materialize, scope

#: The vocabulary of the last stage.
VOCABULARY = "piece_bpe_32k.model"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity stays within the threshold of their language."""
    return classifier.filter_documents(docs, _labels(spark, sf_dir))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs of their language."""
    return rules.filter_documents(docs, _labels(spark, sf_dir))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles."""
    return simhash.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's piece ids, and whether they decode to its text."""
    kept = docs.select("doc_id", "lang", "source", "text")
    return pieces.encode_and_decode(kept, public_tokenizers.path(VOCABULARY))


STAGES = [("quality classifier", classify), ("quality rules", apply_rules), ("simhash near-dedup", deduplicate), ("mix sources", mix), ("sentencepiece", encode)]

#: SQL can't express the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again. What a stage has written besides goes with its
    end, and its input once its result stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scope() as kept:
            docs = materialize(stage(spark, before, sf_dir), f"stage-{name.replace(' ', '-')}")
            kept.append(docs)
        if hasattr(before, "_korvane_path"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
