"""Scoring of a stream of choosers against a table of alternatives: stateless, so any trigger and sink will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.probabilities import linear_predictor


def score_choosers(choosers: DataFrame, alternatives: DataFrame, columns: dict[str, Column], beta: dict[str, float], alt_id: str, max_alternatives: int = 10_000) -> DataFrame:
    """Adds probabilities array<struct<alt, probability>> to each chooser of a stream or table: multinomial logit over the
    alternatives, which are packed into one row whose size is checked. columns: {name: function of the alternative (a struct) that gives the Column}."""
    n = alternatives.count()
    if n > max_alternatives:
        raise ValueError(f"{n} alternatives; packed scoring takes up to {max_alternatives}")
    packed = alternatives.agg(F.sort_array(F.collect_list(F.struct(F.col(alt_id).alias("alt"), *(c for c in alternatives.columns if c != alt_id)))).alias("_alts"))
    rows = choosers.crossJoin(F.broadcast(packed))

    def utility(a: Column) -> Column:
        return linear_predictor({n: f(a) for n, f in columns.items()}, beta)

    rows = rows.withColumn("_v", F.transform("_alts", utility))
    rows = rows.withColumn("_e", F.transform("_v", lambda v: F.exp(v - F.array_max("_v")))).withColumn("_s", F.aggregate("_e", F.lit(0.0), lambda s, e: s + e))
    out = F.zip_with("_alts", "_e", lambda a, e: F.struct(a["alt"].alias("alt"), (e / F.col("_s")).alias("probability")))
    return rows.withColumn("probabilities", out).drop("_alts", "_v", "_e", "_s")
