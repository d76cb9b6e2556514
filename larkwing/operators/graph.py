"""Spatial weights graphs as edge tables (focal, neighbor, weight), and as small matrices for models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .distance import nearest_neighbors
from .shared import Steps


def row_standardize(edges: DataFrame) -> DataFrame:
    """Without the diagonal, each row of weights scaled to sum 1; rows that sum to 0 stay."""
    total = F.sum("weight").over(Window.partitionBy("focal"))
    return edges.filter("focal <> neighbor").select("focal", "neighbor", F.when(total > 0, F.col("weight") / total).otherwise(F.lit(0.0)).alias("weight"))


def allocation_edges(edges: DataFrame) -> DataFrame:
    """(i, j, share_i, share_j): pairs i < j linked in either direction, with the row-scaled weights of both."""
    shares = row_standardize(edges).filter("weight > 0")
    pairs = shares.select(F.least("focal", "neighbor").alias("i"), F.greatest("focal", "neighbor").alias("j")).distinct()
    one = shares.select(F.col("focal").alias("i"), F.col("neighbor").alias("j"), F.col("weight").alias("share_i"))
    two = shares.select(F.col("focal").alias("j"), F.col("neighbor").alias("i"), F.col("weight").alias("share_j"))
    return pairs.join(one, ["i", "j"], "left").join(two, ["i", "j"], "left").fillna(0.0, ["share_i", "share_j"]).select("i", "j", "share_i", "share_j")


def isolated(alternatives: DataFrame, edges: DataFrame, alt_id: str) -> DataFrame:
    linked = edges.filter("focal <> neighbor and weight > 0").select(F.explode(F.array("focal", "neighbor")).alias(alt_id)).distinct()
    return alternatives.select(alt_id).join(linked, alt_id, "left_anti")


def edges_of_nest(edges: DataFrame, nests: DataFrame) -> DataFrame:
    """Edges whose ends are in one nest, scaled again inside it. nests: (alt, nest)."""
    n1, n2 = (nests.select(F.col("alt").alias(c), F.col("nest").alias(f"nest_{c}")) for c in ("focal", "neighbor"))
    inside = edges.join(n1, "focal").join(n2, "neighbor").filter("nest_focal = nest_neighbor")
    return row_standardize(inside.select("focal", "neighbor", "weight"))


def knn_graph(points: DataFrame, k: int, x: str = "x", y: str = "y", method: str = "euclidean", id_col: str | None = None) -> DataFrame:
    found = nearest_neighbors(points, points, k, method, x=x, y=y, id_origin=id_col, id_destination=id_col, exclude_self=True)
    n = F.count("*").over(Window.partitionBy("origin_id"))
    return found.select(F.col("origin_id").alias("focal"), F.col("destination_id").alias("neighbor"), (1.0 / n).alias("weight"))


def spatial_lag(values: DataFrame, edges: DataFrame, keys: list[str], alt: str, value: str) -> DataFrame:
    """(keys, alt, lag): sum of weight times the neighbour's value, by an edge join."""
    side = values.select(*keys, F.col(alt).alias("neighbor"), F.col(value).alias("_v"))
    lag = edges.join(side, "neighbor").groupBy(*keys, "focal").agg(F.sum(F.col("weight") * F.col("_v")).alias("lag"))
    return values.select(*keys, alt).join(lag.withColumnRenamed("focal", alt), [*keys, alt], "left").withColumn("lag", F.coalesce("lag", F.lit(0.0)))


def power_series_filter(values: DataFrame, edges: DataFrame, keys: list[str], alt: str, value: str, rho: float, terms: int) -> DataFrame:
    """(keys, alt, filtered): sum over k < terms of rho^k W^k v, the spatial filter where alternatives are too many to invert;
    the error shrinks as rho^terms. Every term is one edge join, its result a table in the shared folder."""
    steps = Steps(values.sparkSession, "series")
    total = values.select(*keys, alt, F.col(value).alias("filtered"), F.col(value).alias("_term"))
    for k in range(terms - 1):
        total = steps.table(total, f"term-{k}")
        lag = spatial_lag(total, edges, keys, alt, "_term")
        total = total.drop("_term").join(lag, [*keys, alt]).select(*keys, alt, (F.col("filtered") + rho * F.col("lag")).alias("filtered"), (rho * F.col("lag")).alias("_term"))
    return total.drop("_term")


def hop_distances(edges: DataFrame, sources: list, max_order: int) -> DataFrame:
    """(source, alt, hops): fewest edges from each source, up to max_order, by joins of the frontier."""
    steps = Steps(edges.sparkSession, "hops")
    links = edges.filter("weight > 0 and focal <> neighbor").select(F.col("focal").alias("a"), F.col("neighbor").alias("b"))
    links = steps.table(links.union(links.select("b", "a")).distinct(), "links")
    spark, kind = edges.sparkSession, dict(edges.dtypes)["focal"]
    seen = spark.createDataFrame([(s, s, 0) for s in sources], f"source {kind}, alt {kind}, hops int")
    front = seen
    for h in range(1, max_order + 1):
        front = front.join(links, front["alt"] == links["a"]).select("source", F.col("b").alias("alt")).distinct().join(seen, ["source", "alt"], "left_anti").withColumn("hops", F.lit(h))
        front = steps.table(front, f"front-{h}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def to_matrix(edges: DataFrame, alts: list) -> np.ndarray:
    """On the driver, for graphs of alternatives that models invert; the caller bounds their number."""
    at, out = {a: i for i, a in enumerate(alts)}, np.zeros((len(alts), len(alts)))
    for r in edges.select("focal", "neighbor", "weight").toLocalIterator():
        if r["focal"] not in at or r["neighbor"] not in at:
            raise ValueError(f"the graph has an unknown alternative: {r['focal']!r}, {r['neighbor']!r}")
        out[at[r["focal"]], at[r["neighbor"]]] += r["weight"]
    return out


def resolve_spatial_weights(graph, alts: list, row_standardize: bool = True) -> np.ndarray:
    """An edge table or square array in the order of alts, its diagonal cleared, rows scaled to 1 unless told otherwise."""
    w = to_matrix(graph, alts) if isinstance(graph, DataFrame) else np.array(graph.toarray() if hasattr(graph, "toarray") else graph, float)
    if w.shape != (len(alts), len(alts)):
        raise ValueError(f"the graph has shape {w.shape}, not {len(alts)} x {len(alts)}")
    w = w.copy()
    np.fill_diagonal(w, 0)
    if row_standardize:
        rows = w.sum(axis=1, keepdims=True)
        w = np.divide(w, rows, out=np.zeros_like(w), where=rows != 0)
    return w
