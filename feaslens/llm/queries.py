"""The queries of the operators, with production parameters over whole tables, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feaslens.llm import bpe, codes, divergence, fingerprints, langid, mixing, neighbours, ngram_join, secrets, substrings, token_counts, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_source_mixing", mixing.MIX_SQL)
def source_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_byte_bpe")
def byte_bpe(spark, sf_dir):
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), *vocabulary), *vocabulary)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_secret_scan", secrets.report_sql())
def secret_scan(spark, sf_dir):
    return secrets.scan_report(read(spark, sf_dir, "documents"))


LEARN = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0"
HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0"


@query("op1_fingerprints")
def document_fingerprints(spark, sf_dir):
    return fingerprints.edited_report(read(spark, sf_dir, "documents"))


@query("op2_toxicity")
def toxicity_scores(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    machine = toxicity.learn(docs, read(spark, sf_dir, "labels"), HELD_OUT.replace("doc_id", "id"))
    return toxicity.score(docs, machine).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_warc_salvage", warc.REPORT_SQL)
def warc_salvage(spark, sf_dir):
    return warc.round_trip(read(spark, sf_dir, "pages")).filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_cross_parsing")
def cross_parsing(spark, sf_dir):
    rows = langid.predict(read(spark, sf_dir, "documents"), LEARN)
    return rows.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")


@query("op9_block_neighbours", """
with v as (select vec_id, embedding::double[] as e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
             and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select q.vec_id as query_id, c.vec_id,
         sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[2] - p[1]) * (p[2] - p[1])), lambda a, b: a + b)) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
ranked as (select query_id, row_number() over (partition by query_id order by score, vec_id) as rank, vec_id, score from pairs)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 10
""")
def block_neighbours(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.filter(F.col("vec_id") % 100 == 0), 10)


@query("op5_ngram_jaccard")
def ngram_jaccard(spark, sf_dir):
    return ngram_join.similarity_classes(read(spark, sf_dir, "documents"))


@query("op4_repeated_passages")
def repeated_passages(spark, sf_dir):
    return substrings.repeated_passages(read(spark, sf_dir, "documents"))


@query("op13_token_counts")
def count_tokens(spark, sf_dir):
    vocabulary = token_counts.compile_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.token_counts(read(spark, sf_dir, "documents"), vocabulary, 512)


@query("op11_vector_codes", codes.COMPRESS_SQL)
def vector_codes(spark, sf_dir):
    return codes.compress(read(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query("op12_source_divergence", divergence.AUDIT_SQL)
def source_divergence(spark, sf_dir):
    return divergence.audit(read(spark, sf_dir, "documents"))
