"""Marginal effects as columns of a probability frame (obs, alt, probability)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _with_nests(frame: DataFrame, nests: DataFrame) -> DataFrame:
    """Adds lambda (1 outside nests) and within, the probability conditional on the nest."""
    out = frame.join(F.broadcast(nests), "alt", "left").withColumn("lambda", F.coalesce("lambda", F.lit(1.0)))
    total = F.sum("probability").over(Window.partitionBy("obs", "nest"))
    return out.withColumn("within", F.when(F.col("nest").isNull(), 1.0).when(total > 0, F.col("probability") / total).otherwise(0.0))


def own_effect(frame: DataFrame, beta: float | Column, nests: DataFrame | None = None) -> DataFrame:
    """effect: d ln P_i / d x_i. MNL (1 - P) b; nested b [1 / l - (1 - l) / l P(i in nest) - P]. nests: (alt, nest, lambda);
    its size is that of the alternatives of a nested model, which sit on every executor anyway."""
    b, p = beta if isinstance(beta, Column) else F.lit(float(beta)), F.col("probability")
    if nests is None:
        return frame.withColumn("effect", (1 - p) * b)
    l = F.col("lambda")
    return _with_nests(frame, nests).withColumn("effect", b * (1 / l - (1 - l) / l * F.col("within") - p))


def cross_effect(frame: DataFrame, beta: float | Column, nests: DataFrame | None = None) -> DataFrame:
    """effect: d ln P_j / d x_i for j other than i: - b P, and for j in the nest of i - b [(1 - l) / l P(i in nest) + P]."""
    b, p = beta if isinstance(beta, Column) else F.lit(float(beta)), F.col("probability")
    if nests is None:
        return frame.withColumn("effect", -b * p)
    l = F.col("lambda")
    return _with_nests(frame, nests).withColumn("effect", -b * ((1 - l) / l * F.col("within") + p))


def average(effects: DataFrame, by: str = "overall") -> DataFrame:
    if by not in ("alt", "obs", "overall"):
        raise ValueError("by is 'alt', 'obs' or 'overall'")
    return effects.agg(F.avg("effect").alias("effect")) if by == "overall" else effects.groupBy(by).agg(F.avg("effect").alias("effect"))
