"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and works on everything its predecessor kept; its result is written as
Parquet in the shared folder and read again as the next one's ``docs``. All stages but the last return the columns of
``documents``; the last one numbers the copies of each document by ``copy``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strideframe.llm.decontaminate import decontamination_stage
from strideframe.llm.language import language_stage
from strideframe.llm.lines import line_stage
from strideframe.llm.mixing import mixing_stage
from strideframe.llm.simhash import simhash_stage
from strideframe.llm.store import keep

STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", simhash_stage),
    ("decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]

#: SQL can state neither the language model nor the Newton steps; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
