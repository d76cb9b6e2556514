"""Samples by rank are those of all pairs, though only pairs that may be among the first are ranked."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from larkwing.functions.md5 import Digests
from larkwing.operators import sampling as S


def test_first_words_are_those_of_md5():
    texts = [str(i).encode() for i in (1, 23, 456, 7890, 12345)] + [b"", b"ab c"]
    prefixes = [b"", *(b"7|" + b"9" * i + b"|" for i in range(6)), b"p" * 45, b"p" * 60]
    for part, words in Digests(texts).first_words(prefixes):
        for i, row in zip(part, words, strict=True):
            assert row.tolist() == [int.from_bytes(hashlib.md5(prefixes[i] + t).digest()[:4], "big") for t in texts]


@pytest.mark.parametrize(("weights", "method"), [(None, ""), ("w", "gumbel"), ("w", "es")])
def test_ranked_as_over_all_pairs(spark, weights, method):
    choosers = [*range(40), None]
    table = spark.createDataFrame([(c, None if c is None else c % 90) for c in choosers], "c long, own long")
    # one weight outweighs the rest, some are missing, null or negative
    weight = [1e6 if a == 3 else None if a == 4 else -1.0 if a == 5 else 0.0 if a == 6 else 0.1 + a % 7 for a in range(150)]
    positions = spark.createDataFrame(list(enumerate(weight)), "a long, w double")
    found = S.sample_ranked(table, positions, 5, 7, "c", "a", "own", weights, method or "gumbel")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # no grid of all pairs is sorted
    got = {(r["c"], r["slot"]): r["a"] for r in found.collect()}
    for c in choosers:
        text = lambda a, c=c: "|".join(map(str, (7, a) if c is None else (7, c, a)))
        u = {a: (int(hashlib.md5(text(a).encode()).hexdigest()[:12], 16) + 0.5) / 2.0**48 for a in range(150)}
        if weights:
            able = [a for a in u if (weight[a] or 0) > 0]
            rank = sorted(able, key=lambda a: -(math.log(weight[a]) - math.log(-math.log(u[a])) if method == "gumbel" else math.log(u[a]) / weight[a]))
        else:
            rank = sorted(u, key=u.get)
        assert [got[c, s] for s in range(5)] == [a for a in rank if c is None or a != c % 90][:5]


def test_few_with_weight_are_filled_up(spark):
    table, positions = spark.range(5).toDF("c"), spark.range(200).select(F.col("id").alias("a"), (F.col("id") < 3).cast("double").alias("w"))
    got = S.sample_ranked(table, positions, 5, 7, "c", "a", weights="w").collect()
    assert len(got) == 25 and all({r["a"] for r in got if r["c"] == c and r["slot"] < 3} == {0, 1, 2} for c in range(5))
