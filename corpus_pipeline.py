"""The corpus pipeline: toxic documents go, then exact copies, near copies and benchmark contamination; the rest is mixed.

Each stage takes (spark, docs, sf_dir); docs is what the stage before it kept, with the columns of documents. Other tables
are read from sf_dir. The last stage returns the mixture: how often each remaining document is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkwing.llm import toxicity
from larkwing.llm.common import Workspace, read
from larkwing.llm.decontaminate import drop_contaminated
from larkwing.llm.exact_dedup import drop_copies
from larkwing.llm.jaccard_join import drop_near_copies
from larkwing.llm.mixing import mix_sources


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", exact_copies), ("n-gram jaccard join", near_copies), ("benchmark decontamination", decontaminate), ("mixing sources", mix)]

#: SQL cannot express the learnt, sketched and iterated stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage keeps is written to the shared folder and read again by the next."""
    docs, work = read(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = work.table(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
