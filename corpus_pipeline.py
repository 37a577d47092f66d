"""A training corpus from ``documents``: judged, deduplicated, decontaminated, masked, mixed.

Each stage reads its predecessor's rows from the shared folder and works on all
of them. Null and empty texts fail the quality rules, so later stages see them
only when they are run alone; each stage's own docstring says what it does with
nulls in any column, very long texts, ties, repeated rows, rows of one id, extra
columns of clashing names, and empty tables (which stay empty). Columns that no
stage names are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftmesh.llm import decontaminate, mixing, neardup, pii, quality
from driftmesh.llm.common import durable

STAGES = [
    ("quality rules", quality.stage),
    ("near duplicates", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("personal data", pii.stage),
    ("mixing", mixing.stage),
]

#: The tagger's spans and the alignment can't be said in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
