"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, secrets are masked, domains are
mixed to target weights, and what is left is tokenised.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers

from rowforge.llm import op2_mixing, op4_toxicity, op7_jaccard, op8_secrets, op10_bpe
from rowforge.sources.staging import release, scope
from rowforge.sources.staging import stage as written

#: Target shares of expected tokens (good, poor), and how many of all tokens are wanted; toxic documents are gone by then.
MIX_TARGETS, MIX_BUDGET = (0.94, 0.06), 1.0


def toxicity(spark, docs, sf_dir):
    """Documents that are not toxic."""
    return op4_toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark, docs, sf_dir):
    """The first of each group joined by links of 0.8 or more over five-word shingles."""
    return op7_jaccard.keep_one_of_each(docs, words=5, percent=80)


def secrets(spark, docs, sf_dir):
    """All documents, with secrets in their texts masked."""
    return op8_secrets.redact(docs)


def mixing(spark, docs, sf_dir):
    """Documents as often as their rates say: the good domain is above one, the poor one below."""
    labelled = op2_mixing.label_quality(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op2_mixing.mix_documents(docs, labelled, list(MIX_TARGETS), MIX_BUDGET)


def tokens(spark, docs, sf_dir):
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each row."""
    return op10_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        before = docs
        with scope():  # what a stage has staged for itself goes once its result is written
            docs = written(step(spark, docs, sf_dir), keep=True)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
