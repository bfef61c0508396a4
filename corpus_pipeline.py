"""Preparation of a text corpus in stages, each written as Parquet and read again by the next.

1. toxicity: documents scored as toxic go.  2. near_duplicates: of each group that five-word shingles link at
a Jaccard similarity of 0.8 or more, the document of the least id stays.  3. decontamination: documents that
hold benchmark passages go.  4. pii: personal data is masked.  5. bpe: texts become token ids, proven by
decoding. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitwise.llm import bpe, decontaminate, jaccard_join, pii, toxicity
from unitwise.llm.common import discard, fold, materialize, table

#: Rows of the pipeline's result have no SQL equivalent (learned scores, disguised identifiers, BPE).
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, k=5, threshold=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("lang", "source"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("bpe", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of a folder. A stage's table goes once the next one's is written."""
    docs, made = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if made is not None:
            discard(made)
        made = docs
    return STAGES[-1][1](spark, docs, sf_dir)
