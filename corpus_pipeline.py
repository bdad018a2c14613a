"""Documents to packed windows: five stages, each an operator of ``tallyscope.llm`` on what the stage before it kept.

Every stage but the last returns the columns of the documents. Between stages the rows are written as Parquet in the
shared checkpoint folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm import contamination, packing, rules, simhash, suffixes
from tallyscope.llm.common import table
from tallyscope.session import use_shared_checkpoints

# A passage of 51 words, the shortest one to be taken out, has 250 bytes or more.
PASSAGE, PASSAGE_GRAM = 240, 80

ORACLE_SQL = None  # fingerprints, suffix arrays and packing have no SQL; tests compare with plain Python


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the rules reject."""
    name = "verdict"
    while name in docs.columns:
        name += "_"
    return rules.judge(docs, "text", name).where(F.col(f"{name}.kept")).select(*(F.col(f"`{c}`") for c in docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies."""
    return simhash.first_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes long repeated strings out of the texts; ``n_chars`` follows."""
    left = suffixes.strip(docs, size=PASSAGE, gram=PASSAGE_GRAM)
    return left.withColumn("n_chars", F.char_length("text").cast(left.schema["n_chars"].dataType)) if "n_chars" in left.columns else left


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents left into windows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packed_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_shared_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
