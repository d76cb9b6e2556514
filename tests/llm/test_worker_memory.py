"""Python workers beside a full JVM: they get bounded batches and give back what a task freed."""

import os

import psutil
from pyspark.sql import functions as F

from larkwing.llm import common
from larkwing.llm.jaccard_join import jaccard_components
from larkwing.llm.toxicity import CompressionClassifier


def test_jaccard_join_takes_bounded_batches(spark, tmp_path):
    seen, name = str(tmp_path), "spark.sql.execution.arrow.maxBytesPerBatch"

    def record(parts):
        for part in parts:
            with open(f"{seen}/{os.getpid()}", "a") as file:
                print(part.nbytes, file=file)
            yield part

    before = spark.conf.get(name)
    table = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(600)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(10**9))))).alias("text"))
    got = jaccard_components(table.mapInArrow(record, "doc_id long, text string")).filter("component_id = doc_id and n_shingles = 596").count()
    sizes = [int(x) for p in tmp_path.iterdir() for x in p.read_text().split()]
    assert got == 3000 and sum(sizes) > 4 * common.BATCH_BYTES and max(sizes) < 1.5 * common.BATCH_BYTES
    assert spark.conf.get(name) == before


def test_freed_memory_goes_back_after_a_task():
    pins = []

    def run(parts):
        blocks = []
        for _ in range(4000):  # what stays lies between, so the heap does not shrink by itself
            blocks.append(b"x" * 50_000)
            pins.append(b"y" * 600)
        yield from parts

    resident = lambda: psutil.Process().memory_info().rss / 1e6
    before = resident()
    assert list(common.giving_back(run)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 60


def test_scores_are_the_same_after_forgetting():
    toxic = [f"you are a grumplewort number {i}" for i in range(40)]
    ordinary = [f"a quiet walk along the river number {i} of many in the green valley" for i in range(200)]
    model = CompressionClassifier.fit(toxic, ordinary)
    first = [model.score(t) for t in (*toxic, *ordinary)]
    assert model.toxic and model._words
    model.forget()
    assert not model._words and model._made is None and [model.score(t) for t in (*toxic, *ordinary)] == first
