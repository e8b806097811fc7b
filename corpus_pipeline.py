"""From documents to packed sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planeweave.llm.mixing import mixing_stage
from planeweave.llm.packing import packing_stage
from planeweave.llm.simhash import dedup_stage
from planeweave.llm.toxicity import toxicity_stage
from planeweave.plans.storage import materialize

STAGES = [("toxicity", toxicity_stage), ("simhash near-dedup", dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: Hashes, random transfers and tokenizers are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir; every stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
