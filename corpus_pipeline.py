"""From raw documents to packed training sequences, each stage over all that the one before kept.

language_id drops documents without letters or in no known language, exact_dedup keeps one
document of equal texts, near_dedup one of each group of near duplicates (five-word shingles,
similarity 0.8), mix repeats sources towards target weights, pack cuts and packs token ids.
Every stage but the last returns the columns of documents.

The filtering stages tell rows apart by their place in the scan, not by doc_id, so null and
repeated ids are handled: of equal or near texts the smallest doc_id stays, nulls last. Their
input must be a plain read of files, as it is here. Mixing draws by doc_id, so reruns agree.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from veilwork.llm.exact_dedup import drop_exact_copies
from veilwork.llm.language_id import drop_rejected
from veilwork.llm.mixing import mix_sources
from veilwork.llm.ngram_join import drop_near_copies
from veilwork.llm.packing import pack_documents
from veilwork.session import Scratch


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents and the name of an added column that numbers the rows of their scan."""
    name = "_row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def _own(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    numbered, row = _numbered(docs)
    return drop_rejected(numbered, row).select(*_own(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    numbered, row = _numbered(docs)
    return drop_exact_copies(numbered, row).select(*_own(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    numbered, row = _numbered(docs)
    return drop_near_copies(numbered, row, k=5, percent=80).select(*_own(docs))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs, temperature=0.5).select(*_own(docs))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix_sources", mix_stage),
    ("packing", pack_stage),
]

#: The language models, the near duplicates and the tokenizer are beyond SQL; tests compare the
#: stages with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again, the last's returned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = Scratch(spark, "corpus-pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
