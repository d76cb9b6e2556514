"""Choice probabilities at given parameters as window functions: one shuffle by observation, inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def linear_predictor(columns: dict[str, Column], beta: dict[str, float], pi: Column | None = None) -> Column:
    v = F.lit(0.0)
    for name, column in columns.items():
        v = v + F.lit(float(beta[name])) * column
    return v if pi is None else v + F.log(F.greatest(pi, F.lit(1e-300)))


def _masked(v: Column | str, available: Column | None) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    v = F.when(F.isnan(v), None).otherwise(v)
    return v if available is None else F.when(available, v)


def mnl_probabilities(df: DataFrame, obs: str, v: str, available: Column | None = None, out: str = "probability") -> DataFrame:
    """Adds out: softmax of v over the available rows of an observation, 0 elsewhere."""
    w = Window.partitionBy(obs)
    df = df.withColumn("_v", _masked(v, available))
    df = df.withColumn("_e", F.exp(F.col("_v") - F.max("_v").over(w)))
    return df.withColumn(out, F.coalesce(F.col("_e") / F.sum("_e").over(w), F.lit(0.0))).drop("_v", "_e")


def nested_probabilities(df: DataFrame, obs: str, v: str, nest: str, scale: str, available: Column | None = None, out: str = "probability") -> DataFrame:
    """Adds out. nest is null for alternatives without one, which compete at the top; scale is lambda of the row's nest."""
    in_nest, in_obs = Window.partitionBy(obs, nest), Window.partitionBy(obs)
    l = F.when(F.col(nest).isNull(), 1.0).otherwise(F.col(scale))
    df = df.withColumn("_v", _masked(v, available)).withColumn("_s", F.col("_v") / l)
    df = df.withColumn("_top", F.max("_s").over(in_nest))
    df = df.withColumn("_iv", F.when(F.col(nest).isNull(), F.col("_s")).otherwise(F.col("_top") + F.log(F.sum(F.exp(F.col("_s") - F.col("_top"))).over(in_nest))))
    df = df.withColumn("_t", l * F.col("_iv"))
    # a nest counts once at the top: every available row of it brings its share
    n = F.count("_v").over(in_nest)
    share = F.when(F.col(nest).isNull(), F.lit(1.0)).otherwise(1.0 / n)
    df = df.withColumn("_m", F.max(F.when(F.col("_v").isNotNull(), F.col("_t"))).over(in_obs)).withColumn("_w", share)
    df = df.withColumn("_d", F.sum(F.when(F.col("_v").isNotNull(), F.exp(F.col("_t") - F.col("_m")) * F.col("_w"))).over(in_obs))
    p = F.exp(F.col("_s") + (l - 1) * F.col("_iv") - F.col("_m")) / F.col("_d")
    return df.withColumn(out, F.coalesce(F.when(F.col("_v").isNotNull(), F.when(F.col(nest).isNull(), F.exp(F.col("_v") - F.col("_m")) / F.col("_d")).otherwise(p)), F.lit(0.0))).drop("_v", "_s", "_top", "_iv", "_t", "_m", "_w", "_d")


def scl_probabilities(df: DataFrame, obs: str, alt: str, v: str, edges: DataFrame, rho: float, available: Column | None = None) -> DataFrame:
    """(obs, alt, probability): paired generalised extreme value logit over edges (i, j, share_i, share_j); alternatives
    without an edge are isolated. Edges are as many as the graph has and join by alternative."""
    rows = df.select(F.col(obs).alias("obs"), F.col(alt).alias("alt"), _masked(v, available).alias("v"))
    m = rows.groupBy("obs").agg(F.max("v").alias("m"))
    rows = rows.join(m, "obs").select("obs", "alt", (F.col("v") - F.col("m")).alias("v"))
    ends = edges.select("i", "j", F.explode(F.array(F.struct(F.col("i").alias("alt"), F.col("share_i").alias("share")), F.struct(F.col("j").alias("alt"), F.col("share_j").alias("share")))).alias("e")).select("i", "j", "e.alt", "e.share")
    t = rows.join(ends, "alt").withColumn("t", F.coalesce(F.exp((F.col("v") + F.log(F.greatest("share", F.lit(1e-300)))) / rho), F.lit(0.0)))
    both = F.sum("t").over(Window.partitionBy("obs", "i", "j"))
    t = t.withColumn("s", both).withColumn("part", F.when(F.col("s") > 0, F.col("t") / F.col("s") * F.pow("s", F.lit(rho))).otherwise(0.0))
    alone = rows.join(ends.select("alt").distinct(), "alt", "left_anti").select("obs", "alt", F.coalesce(F.exp("v"), F.lit(0.0)).alias("part"))
    parts = t.select("obs", "alt", "part").unionByName(alone).groupBy("obs", "alt").agg(F.sum("part").alias("part"))
    return parts.withColumn("probability", F.col("part") / F.sum("part").over(Window.partitionBy("obs"))).select("obs", "alt", "probability")


def log_likelihood(df: DataFrame, p: str = "probability", chosen: str = "chosen", weight: Column | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    return df.agg(F.sum(F.when(F.col(chosen) == 1, w * F.log(p))).alias("log_likelihood"))


def null_log_likelihood(df: DataFrame, obs: str, available: Column | None = None) -> DataFrame:
    k = F.count(F.lit(1)) if available is None else F.count(F.when(available, 1))
    return df.groupBy(obs).agg(k.alias("k")).agg(F.sum(-F.log("k")).alias("log_likelihood"))


def scores(df: DataFrame, obs: str, columns: dict[str, Column], p: str = "probability", chosen: str = "chosen") -> DataFrame:
    """(obs, one column for each variable): sum over alternatives of (y - P) x."""
    return df.groupBy(obs).agg(*(F.sum((F.col(chosen) - F.col(p)) * c).alias(n) for n, c in columns.items()))


def information(df: DataFrame, obs: str, columns: dict[str, Column], p: str = "probability") -> DataFrame:
    """(a, b, value) for a <= b: sum over observations of sum P x_a x_b - (sum P x_a)(sum P x_b)."""
    names, p_ = list(columns), F.col(p)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    one = df.groupBy(obs).agg(*(F.sum(p_ * columns[n]).alias(f"m_{n}") for n in names), *(F.sum(p_ * columns[a] * columns[b]).alias(f"q_{a}_{b}") for a, b in pairs))
    total = one.agg(*(F.sum(F.col(f"q_{a}_{b}") - F.col(f"m_{a}") * F.col(f"m_{b}")).alias(f"{a}|{b}") for a, b in pairs))
    return total.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("value")) for a, b in pairs))).alias("z")).select("z.*")


def meat(scores_: DataFrame, names: list[str], cluster: str | None = None) -> DataFrame:
    """(a, b, value) for a <= b: sum of s_a s_b over rows, or over clusters of summed scores with the factor G / (G - 1)."""
    if cluster:
        scores_ = scores_.groupBy(cluster).agg(*(F.sum(n).alias(n) for n in names))
    factor = F.count("*") / (F.count("*") - 1) if cluster else F.lit(1.0)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    total = scores_.agg(*((F.sum(F.col(a) * F.col(b)) * factor).alias(f"{a}|{b}") for a, b in pairs))
    return total.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("value")) for a, b in pairs))).alias("z")).select("z.*")
