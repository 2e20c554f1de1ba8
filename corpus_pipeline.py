"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage is ``f(spark, docs, sf_dir)``; its result is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of
``documents``; a stage drops rows and changes none.  Every stage works on all rows
its predecessor kept and learns only from them:

1. language ID: rows without a determined language (no text, no letter, or a
   posterior under 0.5) go;
2. quality rules: rows that fail the base rules or diverge from their language go;
3. exact dedup: one row of each group of equal texts stays;
4. SimHash near-dedup: one row of each component stays (smallest id, then least row key);
5. packing: one row per piece, the digests of ``op6_packing``.

Repeated rows, null columns and clashing extra columns are handled by the operators;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txnwatch.llm.common import table, written
from txnwatch.llm.exact_dedup import drop_exact_copies
from txnwatch.llm.language_id import drop_undetermined
from txnwatch.llm.packing import packed_digests
from txnwatch.llm.quality_rules import drop_low_quality
from txnwatch.llm.simhash import drop_near_copies


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_undetermined(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_low_quality(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_digests(docs)


STAGES = [("language_id", language_stage), ("quality_rules", quality_stage), ("exact_dedup", exact_stage),
          ("simhash_dedup", near_stage), ("packing", packing_stage)]

#: SQL cannot say the language and near-duplicate stages: tests/llm/test_corpus_pipeline.py holds the
#: result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
