"""The stages of the corpus pipeline: (spark, docs, sf_dir) to the documents that the next stage gets."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from feaslens.llm import bpe, ngram_join
from feaslens.llm import mixing as mixes
from feaslens.llm import secrets as scans
from feaslens.llm import toxicity as scorer


def toxicity(spark, docs, sf_dir):
    """Learns from all labelled documents and rejects what scores as toxic."""
    machine = scorer.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scorer.clean(docs, machine)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of copies and near copies stays."""
    return ngram_join.one_of_each(docs)


def secrets(spark, docs, sf_dir):
    """Found secrets are cut out of the texts."""
    return scans.redact(docs)


def mixing(spark, docs, sf_dir):
    """Documents as often, and as far, as the mix takes them."""
    return mixes.mixed_documents(docs)


def tokens(spark, docs, sf_dir):
    """(doc_id, n_tokens, ids), a row for each pass over a document."""
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
