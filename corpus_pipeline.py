"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, personal data is redacted, and what remains is packed into sequences."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from planweft.llm import jaccard, packing, pii, toxicity
from planweft.llm.shared import new_dir, table

#: A document whose calibrated probability reaches this is rejected.
TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: keep the documents that are scored below ``TOXIC_FROM``.

    Null and empty texts are scored like others, repeated rows alike; null ids stay or go by their text. An
    empty table gives an empty one. Columns stay as they are, whatever their names.
    """
    return toxicity.below(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), TOXIC_FROM)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of the documents linked by five-word shingles at 0.8 or more, the one of the smallest id stays.

    Rows without words and rows with a null id stay; rows that share an id stay or go together. Columns stay as they are.
    """
    return jaccard.one_of_each(docs, k=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: replace every span by its kind; ``n_chars``, if there is one, becomes the new length.

    All rows stay: null texts null, empty ones empty, repeated ones each. No other column changes.
    """
    return pii.redact(docs, pii.train(spark), length_col="n_chars" if "n_chars" in docs.columns else None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: pack the documents into sequences of at most 2048 ids.

    A null or empty text is its end id alone; repeated rows and null ids are packed each; no rows give no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the trained stages; the tests hold the pipeline against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
