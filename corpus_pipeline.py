"""The training-data pipeline: stages that each work on all that the one before kept.

Of odd rows: a null text counts as empty, and an empty one fails the quality rules; a document without an id can't be told
from others and passes stages that compare ids; rows without a source make a source of their own. Very long texts are
read whole. Repeated rows of an id pass as one document, stay or go together and share a shard. An empty table gives no
rows. Extra columns pass through, whatever their names; the last stage adds the column shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, host_rules, mixing, near_dup, sharding
from lodestone.llm.base import Workspace, borrowing, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return host_rules.drop_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of least id stays."""
    return near_dup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the greatest budget of the mixture admits stays."""
    return mixing.mix(docs, mixing.TARGET)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard."""
    return sharding.assign(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
    ("sharding", shards),
]

#: Groups of near-duplicates are connected components of verified pairs, which SQL can't find at any size; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages, each written as Parquet in the shared folder and read again by the next; what a stage wrote for itself is deleted then."""
    with Workspace(spark) as ws:
        docs = read(spark, sf_dir, "documents")
        for _, stage in STAGES[:-1]:
            with borrowing(spark):
                docs = ws.table(stage(spark, docs, sf_dir))
        return ws.keep(STAGES[-1][1](spark, docs, sf_dir))
