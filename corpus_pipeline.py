"""The corpus pipeline: five stages over ``documents``, each on all its predecessor kept.

1. quality         - documents scored below 0.5 by the nearest-neighbour vote go
2. exact_dedup     - of equal texts (A-Z lower-cased) the largest doc_id stays
3. near_dedup      - of each SimHash component the smallest doc_id stays
4. decontaminate   - documents that hold a benchmark item go
5. mix             - copies per document so that sources meet their target weights

Stages 1 to 4 return the columns of ``documents``; the last returns one row per
remaining document: (doc_id, size, source_size, target, taken, copies). An empty
table passes through every stage. Each stage's result is written as Parquet in
the cluster's shared folder and reread, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronofeat.llm import decontaminate, exact_dedup, mixing, quality_knn, simhash_dedup
from chronofeat.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_knn.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.drop_near_duplicates(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontaminate", clean),
    ("mix", mix),
]

#: The classifier, the fingerprints and the random rounding have no SQL form; the
#: stages are tested against brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
