"""From raw documents to token ids: five stages, each written out before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornspark.llm import bpe, containment, langid, pii, simhash
from hornspark.plans.materialize import materialize

#: A document is rejected if its best language has no more than this part of the way from an even
#: share of its words (one over the number of learned languages) to all of them.
LEAST_LEAD = 0.1


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null, without letters, or an even mixture of all languages.

    If no row has a language to learn from, documents with a letter can't be judged and stay.
    """
    model = langid.train(docs)
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    even = 1 / len(model.labels)
    found = langid.predict(docs, model, keep=tuple(docs.columns), prefix="__")
    told = (F.col("__lang_pred") != langid.UNKNOWN) & (F.col("__score") >= even + LEAST_LEAD * (1 - even) - 1e-9)
    return found.where(told).select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of documents that share 80 % of their shingles of five words."""
    return simhash.one_of_each(docs, similar=True)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return containment.without_contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; ``n_chars`` follows."""
    found = pii.redact(docs, pii.train(), keep=tuple(docs.columns), prefix="__")
    new = {"text": F.col("__redacted")} | ({"n_chars": F.length("__redacted").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts; ``lossless`` says that decoding gives the text again."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id",), with_ids=True)


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("bpe_encoding", token_ids),
]

#: SQL can express neither the trained models nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
