"""Documents to training tokens in five stages, each one of the operators in ``feaslens.llm``."""

from __future__ import annotations

from feaslens.llm import stages
from feaslens.llm.common import stored

STAGES = [
    ("toxicity", stages.toxicity),
    ("ngram_jaccard_join", stages.near_duplicates),
    ("secret_scan", stages.secrets),
    ("source_mixing", stages.mixing),
    ("byte_bpe", stages.tokens),
]

#: The factorization machine and the merges can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to ``documents``, each one's rows stored as Parquet before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
