"""The registered queries of the training-data operators, with their checks in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
import public_tokenizers

from ..session import fresh_dir, materialize
from .alignment import align_tokenizers
from .exact_dedup import exact_dedup
from .hash_tree import hash_tree_shards, regular_tree
from .language_id import language_id
from .lm_scoring import lm_scores
from .mixing import mix_sources
from .ngram_join import ngram_join
from .packing import pack_documents
from .projections import near_vectors
from .secret_scan import SHAPES, find_secrets, joined
from .token_scan import token_counts, write_token_files
from .turn_repair import damage, repair_conversations
from .url_filter import url_verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def wrap(build):
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = sql
        return build

    return wrap


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def tokenizer() -> str:
    """The public vocabulary file; another file's path can be given to the operators."""
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_context_mixing")
def op1(spark, folder):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return lm_scores(documents(spark, folder), held_out=held)


@query("op2_ngram_join")
def op2(spark, folder):
    return ngram_join(documents(spark, folder), k=4, percent=85)


@query("op3_packing")
def op3(spark, folder):
    return pack_documents(documents(spark, folder), tokenizer())


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query("op4_url_filter")
def op4(spark, folder):
    return url_verdicts(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url"), RULES)


# Base rates as in mixing.py, steps from the logarithm of the gamma function; the number comes from the same 52 bits.
@query("op5_source_mixing", """WITH n AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
rates AS (SELECT source, ((SELECT sum(n) FROM n)::DOUBLE * w / (SELECT sum(w ORDER BY source) FROM n)) / n AS rate FROM n),
terms AS (SELECT source, rate, unnest(range(CAST(ceil(rate + 12 * sqrt(rate) + 24) AS BIGINT))) AS k FROM rates),
steps AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS total FROM terms),
units AS (SELECT doc_id, source, (('0x' || substr(md5('20|' || CAST(doc_id AS VARCHAR)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
counts AS (SELECT doc_id, u.source, count(*) FILTER (s.total < u.u) AS n FROM units u JOIN steps s ON u.source IS NOT DISTINCT FROM s.source GROUP BY ALL)
SELECT doc_id, source, CAST(c AS INT) AS copy, md5('order20|' || CAST(doc_id AS VARCHAR) || '|' || CAST(c AS VARCHAR)) AS shuffle_key
FROM (SELECT doc_id, source, unnest(range(n)) AS c FROM counts)""")
def op5(spark, folder):
    """Whole documents are repeated, shuffled and written; the columns come from what was written."""
    mixed = materialize(mix_sources(documents(spark, folder)), "mixed")
    return mixed.select("doc_id", "source", F.col("_copy").alias("copy"), F.col("_order").alias("shuffle_key"))


@query("op6_token_counts")
def op6(spark, folder):
    """Token files written from all documents, then counted; `file` is the writing task's number."""
    path = fresh_dir(spark, "token-files")
    write_token_files(documents(spark, folder), path, tokenizer())
    counts = token_counts(spark, path)
    return counts.withColumn("file", F.regexp_extract("file", r"^part-(\d+)", 1).cast("int"))


@query("op7_hash_tree")
def op7(spark, folder):
    return hash_tree_shards(documents(spark, folder), regular_tree(24), regular_tree(25))


@query("op8_embedding_collisions")
def op8(spark, folder):
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query("op9_language_id")
def op9(spark, folder):
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return language_id(documents(spark, folder), held_out=held)


@query("op10_exact_dedup", r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM t""")
def op10(spark, folder):
    return exact_dedup(documents(spark, folder))


@query("op11_turn_repair")
def op11(spark, folder):
    repaired = repair_conversations(damage(spark.read.parquet(f"{folder}/conversations.parquet")), "conv", "turn", "role", "text", "copies")
    digests = repaired.digests().select(F.struct("conv").alias("key"), "repaired_sha256")
    audits = repaired.audits.join(digests, F.struct("conv") == F.col("key"), "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return audits.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                         F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


@query("op12_secret_scan")
def op12(spark, folder):
    found = find_secrets(documents(spark, folder))
    base = F.filter("spans", lambda s: s["kind"].isin(*SHAPES))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, SHAPES), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op13_token_alignment")
def op13(spark, folder):
    return align_tokenizers(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)
