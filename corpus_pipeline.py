"""From raw documents to encoded ones: five operators in a row, each over all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import line_rules, pareto_mix, piece_trie, quality_qda, signature_tree
from tributary.tables import shared_folder

STAGES = [
    ("quality_rules", line_rules.stage),
    ("quality_classifier", quality_qda.stage),
    ("near_duplicates", signature_tree.stage),
    ("source_mix", pareto_mix.stage),
    ("piece_encoding", piece_trie.stage),
]

#: A trained discriminant and link components have no SQL; tests/llm compares every stage with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
