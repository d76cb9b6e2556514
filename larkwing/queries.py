"""One query for each operator over the driver tables, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.uniform import gumbel, uniform, uniform_sql
from .operators import distance as D
from .operators import effects as E
from .operators import graph as G
from .operators import probabilities as P
from .operators import sampling as S
from .operators import simulation as M
from .operators.shared import Steps
from .plans.diagnostics import hausman_test, iia_test, lm_error_test, lm_lag_test, lr_test, wald_test
from .plans.model import ChoiceModel
from .plans.spec import ModelSpec, formula_design
from .sources.choice_table import ChoiceTable

FORMULA = "bal + same_region + acct_x_bal"
#: Fixed coefficients of the scoring queries.
BETA = {"bal": 0.05, "same_region": -0.1, "acct_x_bal": 0.01}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded to 6 places, and never a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


# ---- the flagship choice table: customers choose the nation of the supplier of their dearest order line
def choosers(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    top = lines.join(orders, "l_orderkey").groupBy("c_custkey").agg(F.max(F.struct("l_extendedprice", -F.col("l_orderkey"), -F.col("l_linenumber"), "l_suppkey")).alias("t"))
    supplier = read(spark, d, "supplier").select(F.col("s_suppkey").alias("supp"), F.col("s_nationkey").cast("int").alias("choice"))
    home = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("home_region"))
    customers = read(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") / 1000).alias("acct"))
    return customers.join(top.select("c_custkey", F.col("t.l_suppkey").alias("supp")), "c_custkey").join(supplier, "supp").join(home, "c_nationkey").select("c_custkey", "acct", "home_region", "choice")


def alternatives(spark: SparkSession, d: str) -> DataFrame:
    by = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_suppliers"), (F.avg("s_acctbal") / 1000).alias("bal"))
    nation = read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), F.col("n_regionkey").alias("region"))
    return nation.join(by, "n_nationkey", "left").fillna({"n_suppliers": 0, "bal": 0.0})


def flagship_table(spark: SparkSession, d: str) -> ChoiceTable:
    """Keyed joins and one broadcast grid; the interaction and same_region are columns of the plan."""
    t = ChoiceTable.from_tables(choosers(spark, d), alternatives(spark, d), "choice", available="n_suppliers", obs_id="c_custkey", alt_id="n_nationkey")
    df = t.df.withColumn("same_region", (F.col("home_region") == F.col("region")).cast("double")).withColumn("acct_x_bal", F.col("acct") * F.col("bal"))
    return t._with(df)


_GRID = """
top AS (SELECT o_custkey AS c_custkey, l_suppkey, row_number() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
choosers AS (SELECT c.c_custkey, c_acctbal / 1000 AS acct, n_regionkey AS home_region, CAST(s_nationkey AS INTEGER) AS choice FROM customer c JOIN top t ON t.c_custkey = c.c_custkey AND k = 1 JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = c_nationkey),
alts AS (SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_regionkey AS region, count(s_suppkey) AS n_suppliers, coalesce(avg(s_acctbal) / 1000, 0) AS bal FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2),
grid AS (SELECT c_custkey, n_nationkey, acct, bal, region, CAST(home_region = region AS DOUBLE) AS same_region, acct * bal AS acct_x_bal, CAST(choice = n_nationkey AS INTEGER) AS chosen, n_suppliers > 0 AS av FROM choosers, alts),
v AS (SELECT *, CASE WHEN av THEN 0.05 * bal - 0.1 * same_region + 0.01 * acct_x_bal END AS v FROM grid),
p AS (SELECT *, coalesce(exp(v) / sum(exp(v)) OVER (PARTITION BY c_custkey), 0) AS p FROM v)
"""
_N = "(n_nationkey - (SELECT min(n_nationkey) FROM nation))"
_RANK = "row_number() OVER (ORDER BY n_nationkey) - 1"


def scored(spark: SparkSession, d: str) -> DataFrame:
    t = flagship_table(spark, d)
    v = P.linear_predictor({n: F.col(n) for n in BETA}, BETA)
    return P.mnl_probabilities(t.df.withColumn("v", v), "c_custkey", "v", F.col("available") > 0)


def obs_alt(df: DataFrame) -> DataFrame:
    return df.select(F.col("c_custkey").alias("obs"), F.col("n_nationkey").alias("alt"), "probability")


# ---- assembly
@query(f"WITH {_GRID} SELECT count(*) AS n, CAST(sum(chosen) AS BIGINT) AS chosen, round(sum(acct_x_bal), 4) AS total FROM grid")
def choice_census(spark, d):
    return flagship_table(spark, d).df.agg(F.count("*").alias("n"), F.sum("chosen").alias("chosen"), F.round(F.sum("acct_x_bal"), 4).alias("total"))


@query(f"WITH {_GRID} SELECT c_custkey, n_nationkey, round(bal, 6) + 0.0 AS bal, same_region, round(acct_x_bal, 6) + 0.0 AS acct_x_bal, chosen, av FROM grid")
def choice_flagship_grid(spark, d):
    return flagship_table(spark, d).df.select("c_custkey", "n_nationkey", r6("bal").alias("bal"), "same_region", r6("acct_x_bal").alias("acct_x_bal"), "chosen", (F.col("available") > 0).alias("av"))


@query(f"WITH {_GRID}, c AS (SELECT c_custkey, count(*) AS n, count(DISTINCT n_nationkey) AS k FROM grid GROUP BY 1) SELECT count(*) AS observations, min(n) AS least, max(n) AS most, CAST(sum(n - k) AS BIGINT) AS repeated FROM c")
def from_long_validation(spark, d):
    long = flagship_table(spark, d).df.select("c_custkey", "n_nationkey", "chosen", "bal")
    t = ChoiceTable.from_long(long, "c_custkey", "n_nationkey", "chosen")
    c = t.df.groupBy("c_custkey").agg(F.count("*").alias("n"), F.countDistinct("n_nationkey").alias("k"))
    return c.agg(F.count("*").alias("observations"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum(F.col("n") - F.col("k")).alias("repeated"))


def _pairs(spark, d) -> DataFrame:
    """Pairwise data: what customers ordered from each nation, for pairs that have any."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("int").alias("n_nationkey"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(o, "l_orderkey").join(s, "l_suppkey").groupBy("c_custkey", "n_nationkey").agg(F.sum("l_quantity").alias("bought"))


_PAIRS = "pairs AS (SELECT o_custkey AS c_custkey, CAST(s_nationkey AS INTEGER) AS n_nationkey, CAST(sum(l_quantity) AS DOUBLE) AS bought FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"


@query(f"WITH {_GRID}, {_PAIRS} SELECT c_custkey, n_nationkey, round(bought, 4) AS bought FROM grid LEFT JOIN pairs USING (c_custkey, n_nationkey)")
def pairwise_join(spark, d):
    t = flagship_table(spark, d).add_pairwise_variable("bought", _pairs(spark, d))
    return t.df.select("c_custkey", "n_nationkey", F.round("bought", 4).alias("bought"))


@query(f"WITH {_GRID} SELECT c_custkey, n_nationkey, round(acct * bal, 6) + 0.0 AS x FROM grid")
def interaction_column(spark, d):
    return flagship_table(spark, d).add_interaction("x", "acct", "bal").df.select("c_custkey", "n_nationkey", r6("x").alias("x"))


@query(f"WITH {_GRID}, {_PAIRS} SELECT count(*) AS n, count(bought * bal) AS present, round(sum(bought * bal), 3) AS total FROM grid LEFT JOIN pairs USING (c_custkey, n_nationkey)")
def interaction_missing_allowed(spark, d):
    t = flagship_table(spark, d).add_pairwise_variable("bought", _pairs(spark, d))
    t = t._with(t.df.withColumn("available", F.when(F.col("bought").isNotNull(), F.col("available")).otherwise(0.0)))
    return t.add_interaction("x", "bought", "bal", missing_policy="allow_unavailable").df.agg(F.count("*").alias("n"), F.count("x").alias("present"), F.round(F.sum("x"), 3).alias("total"))


@query(f"WITH {_GRID} SELECT c_custkey, n_nationkey, CAST((n_nationkey * 7) % 11 AS DOUBLE) AS z FROM grid")
def alt_series_broadcast(spark, d):
    z = read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("a"), ((F.col("n_nationkey") * 7) % 11).cast("double").alias("z"))
    return flagship_table(spark, d).add_matrix("z", z).df.select("c_custkey", "n_nationkey", "z")


@query(f"WITH {_GRID}, c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM choosers), a AS (SELECT n_nationkey, {_RANK} AS j FROM alts) SELECT c_custkey, n_nationkey, CAST((i * 31 + j * 17) % 101 AS DOUBLE) AS z FROM c, a")
def matrix_dense_gather(spark, d):
    t = flagship_table(spark, d)
    j = t.universe.count()
    rows = spark.range(t.n_observations).select("id", F.transform(F.sequence(F.lit(0), F.lit(j - 1)), lambda k: ((F.col("id") * 31 + k * 17) % 101).cast("double")).alias("values"))
    return t.add_matrix("z", rows).df.select("c_custkey", "n_nationkey", "z")


# ---- sampling: suppliers as alternatives
def _supplier_choice(spark, d) -> tuple[DataFrame, DataFrame]:
    # of each order first, so that fewer lines move; once, as samples read the choosers several times
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_extendedprice", -F.col("l_linenumber"), "l_suppkey")).alias("t"))
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    top = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.max(F.struct("t.l_extendedprice", -F.col("l_orderkey"), "t.col2", "t.l_suppkey")).alias("t"))
    who = Steps(spark, "choosers").table(top.select(F.col("o_custkey").alias("c_custkey"), F.col("t.l_suppkey").alias("choice")), "who")
    return who, read(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") + 1000.5).alias("weight"))


_SUPP = "top AS (SELECT o_custkey AS c_custkey, l_suppkey, row_number() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey), who AS (SELECT c_custkey, l_suppkey AS choice FROM top WHERE k = 1), alts AS (SELECT s_suppkey, s_acctbal + 1000.5 AS weight, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier)"
_U = uniform_sql(7, "c_custkey", "s_suppkey")
_SAMPLED = "SELECT c_custkey, s_suppkey, CAST(slot AS INTEGER) AS alt_pos, CAST(0 AS INTEGER) AS chosen FROM drawn WHERE slot < {n} UNION ALL SELECT c_custkey, choice, {n}, 1 FROM who"


def _sample_sql(order: str, n: int = 5) -> str:
    return f"WITH {_SUPP}, drawn AS (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY {order}, s_suppkey) - 1 AS slot FROM who, alts WHERE s_suppkey <> choice) " + _SAMPLED.format(n=n)


def _sampled(spark, d, **options) -> DataFrame:
    who, alts = _supplier_choice(spark, d)
    t = ChoiceTable.from_tables(who, alts, "choice", sample_size=6, seed=7, obs_id="c_custkey", alt_id="s_suppkey", **options)
    return t.df.select("c_custkey", "s_suppkey", "alt_pos", "chosen")


@query(_sample_sql(_U))
def sample_uniform_wor(spark, d):
    return _sampled(spark, d, replace=False)


@query(_sample_sql(f"ln(weight) - ln(-ln({_U})) DESC"))
def sample_weighted_wor_gumbel(spark, d):
    return _sampled(spark, d, replace=False, weights="weight")


@query(f"WITH {_SUPP}, r AS (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY ln({_U}) / weight DESC, s_suppkey) - 1 AS slot FROM who, alts) SELECT c_custkey, s_suppkey, CAST(slot AS INTEGER) AS slot FROM r WHERE slot < 5")
def sample_es_topk(spark, d):
    who, alts = _supplier_choice(spark, d)
    out = S.sample_ranked(who.select("c_custkey"), alts, 5, 7, "c_custkey", "s_suppkey", weights="weight", method="es")
    return out.select("c_custkey", "s_suppkey", F.col("slot").cast("int").alias("slot"))


_SLOTS = f"slots AS (SELECT c_custkey, choice, pos AS cpos, slot, {uniform_sql(7, 'c_custkey', 'slot')} AS u FROM who JOIN alts ON s_suppkey = choice, (SELECT unnest(range(5)) AS slot))"


@query(f"WITH {_SUPP}, {_SLOTS}, i AS (SELECT *, CAST(floor(u * ((SELECT count(*) FROM alts) - 1)) AS BIGINT) AS i FROM slots), drawn AS (SELECT c_custkey, s_suppkey, slot FROM i JOIN alts ON alts.pos = CASE WHEN i >= cpos THEN i + 1 ELSE i END) " + _SAMPLED.format(n=5))
def sample_uniform_wr(spark, d):
    return _sampled(spark, d, replace=True)


@query(f"WITH {_SUPP}, {_SLOTS}, c AS (SELECT *, sum(weight) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum FROM alts), x AS (SELECT s.*, u * ((SELECT sum(weight) FROM alts) - o.weight) AS y, o.cum - o.weight AS before, o.weight AS own FROM slots s JOIN c o ON o.pos = s.cpos), drawn AS (SELECT x.c_custkey, (SELECT min_by(c.s_suppkey, c.pos) FROM c WHERE c.cum > CASE WHEN y >= before THEN y + own ELSE y END) AS s_suppkey, slot FROM x) " + _SAMPLED.format(n=5))
def sample_weighted_wr(spark, d):
    return _sampled(spark, d, replace=True, weights="weight")


@query("WITH a AS (SELECT s_suppkey, s_acctbal + 1000.5 AS w, sum(s_acctbal + 1000.5) OVER () AS t, count(*) OVER () AS n FROM supplier) SELECT s_suppkey, round(least(1, 4 / n), 6) AS srswor, round(1 - pow(1 - 1 / n, 4), 6) AS srswr, round(1 - exp(-w / t * 4), 6) AS weighted_wor, round(1 - pow(1 - w / t, 4), 6) AS weighted_wr FROM a")
def inclusion_probs(spark, d):
    a = read(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") + 1000.5).alias("w")).crossJoin(F.broadcast(read(spark, d, "supplier").agg(F.count("*").alias("n"), F.sum(F.col("s_acctbal") + 1000.5).alias("t"))))
    return a.select("s_suppkey", *(r6(S.inclusion_probability(m, 4, F.col("n"), F.col("w"), F.col("t"))).alias(m) for m in ("srswor", "srswr", "weighted_wor", "weighted_wr")))


@query(_sample_sql(_U).replace("SELECT c_custkey, s_suppkey, CAST(slot", "SELECT c_custkey, s_suppkey, round(CASE WHEN chosen = 1 THEN 0 ELSE ln(6 / (SELECT count(*) FROM alts)) END + 0.001 * (s_suppkey % 97), 6) + 0.0 AS v FROM (SELECT c_custkey, s_suppkey, CAST(slot", 1) + ")")
def sampling_correction_utilities(spark, d):
    who, alts = _supplier_choice(spark, d)
    t = ChoiceTable.from_tables(who, alts, "choice", sample_size=6, seed=7, obs_id="c_custkey", alt_id="s_suppkey", replace=False)
    return t.df.select("c_custkey", "s_suppkey", r6(S.sampling_correction((F.col("s_suppkey") % 97) * 0.001, F.col("pi"))).alias("v"))


# ---- designs
@query(f"WITH {_GRID} SELECT region, round(sum(CASE WHEN n_nationkey = 3 THEN bal ELSE 0 END), 3) AS at3, round(sum(CASE WHEN n_nationkey = 7 THEN bal ELSE 0 END), 3) AS at7 FROM grid GROUP BY region")
def design_scoped_alt_specific(spark, d):
    t = flagship_table(spark, d)
    c = ModelSpec().alternative_specific("bal", reference=0).design(t).columns
    return t.df.groupBy("region").agg(F.round(F.sum(c["bal[3]"]), 3).alias("at3"), F.round(F.sum(c["bal[7]"]), 3).alias("at7"))


@query(f"WITH {_GRID} SELECT region, round(sum(CASE WHEN n_nationkey IN (0, 1, 2, 3, 4) THEN bal ELSE 0 END), 3) AS low, round(sum(CASE WHEN n_nationkey IN (5, 6, 7) THEN bal ELSE 0 END), 3) AS mid FROM grid GROUP BY region")
def design_grouped(spark, d):
    t = flagship_table(spark, d)
    c = ModelSpec().grouped("bal", {"low": [0, 1, 2, 3, 4], "mid": [5, 6, 7]}).design(t).columns
    return t.df.groupBy("region").agg(F.round(F.sum(c["bal[low]"]), 3).alias("low"), F.round(F.sum(c["bal[mid]"]), 3).alias("mid"))


@query(f"WITH {_GRID} SELECT c_custkey, n_nationkey, round(bal * same_region, 6) + 0.0 AS product, round(acct * acct, 6) + 0.0 AS square FROM grid")
def design_formula(spark, d):
    t = flagship_table(spark, d)
    c = formula_design("bal:same_region + I(acct ** 2) - 1", t).columns
    return t.df.select("c_custkey", "n_nationkey", r6(c["bal:same_region"]).alias("product"), r6(c["I(acct ** 2)"]).alias("square"))


# ---- distances and graphs
def _points(spark, d) -> DataFrame:
    return read(spark, d, "nation").select("n_nationkey", ((F.col("n_nationkey") * 37) % 360 - 180).cast("double").alias("x"), ((F.col("n_nationkey") * 17) % 160 - 80).cast("double").alias("y"))


_POINTS = "pts AS (SELECT n_nationkey AS id, CAST((n_nationkey * 37) % 360 - 180 AS DOUBLE) AS x, CAST((n_nationkey * 17) % 160 - 80 AS DOUBLE) AS y FROM nation), pairs AS (SELECT a.id AS origin_id, b.id AS destination_id, acos(greatest(least(sin(radians(90 - a.y)) * sin(radians(90 - b.y)) * cos(radians(a.x) - radians(b.x)) + cos(radians(90 - a.y)) * cos(radians(90 - b.y)), 1), -1)) * 6371009 AS d, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS e FROM pts a, pts b)"


@query(f"WITH {_POINTS} SELECT origin_id, destination_id, CAST(trunc(d / 10) AS BIGINT) AS distance FROM pairs")
def great_circle_matrix(spark, d):
    return D.great_circle_distance_matrix(_points(spark, d), "x", "y", return_int=False).select("origin_id", "destination_id", (F.col("distance") / 10).cast("long").alias("distance"))


@query(f"WITH {_POINTS} SELECT origin_id, destination_id, round(d * 0.001, 3) AS distance FROM pairs")
def pairwise_haversine(spark, d):
    p = _points(spark, d)
    return D.pairwise_distance(p, p, "haversine", "km").select("origin_id", "destination_id", F.round("distance", 3).alias("distance"))


@query("SELECT a.vec_id AS origin_id, b.vec_id AS destination_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))), 4) AS distance FROM embeddings a, embeddings b")
def euclidean_matrix(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    return D.distance_matrix(e, "euclidean", id_col="vec_id", digits=4)


@query(f"WITH {_POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY origin_id ORDER BY round(d, 3), destination_id) AS rank FROM pairs WHERE origin_id <> destination_id) SELECT origin_id, destination_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def knn(spark, d):
    p = _points(spark, d)
    pairs = D.pairwise_distance(p, p, "haversine").filter("origin_id <> destination_id").withColumn("distance", F.round("distance", 3))
    rank = F.row_number().over(Window.partitionBy("origin_id").orderBy("distance", "destination_id"))
    return pairs.withColumn("rank", rank).filter("rank <= 3").select("origin_id", "destination_id", "rank")


@query(f"WITH {_POINTS}, b AS (SELECT * FROM (VALUES (0, 0.0, 20.0), (1, 20.0, 60.0), (2, 60.0, 100000.0), (3, 100000.0, 200000.0)) t(band, low, high)) SELECT o.id AS origin_id, b.band, array_to_string(list_sort(coalesce(list(p.destination_id) FILTER (p.destination_id IS NOT NULL), [])), ',') AS ids FROM pts o CROSS JOIN b LEFT JOIN pairs p ON p.origin_id = o.id AND p.e >= b.low AND p.e < b.high GROUP BY 1, 2")
def distance_bands(spark, d):
    p = _points(spark, d)
    bands = D.distance_bands(D.pairwise_distance(p, p, "euclidean"), [0, 20, 60, 100000, 200000])
    return bands.select("origin_id", "band", F.array_join(F.col("destinations").cast("array<string>"), ",").alias("ids"))


def _ring(spark, d) -> DataFrame:
    """Rings of nations inside regions."""
    n = read(spark, d, "nation").select("n_nationkey", "n_regionkey")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    n = n.withColumn("k", F.row_number().over(w) - 1).withColumn("m", F.count("*").over(Window.partitionBy("n_regionkey")))
    b = n.select("n_regionkey", F.col("n_nationkey").alias("neighbor"), F.col("k").alias("kb"))
    e = n.join(b, "n_regionkey").filter("n_nationkey <> neighbor and ((k + 1) % m = kb or (kb + 1) % m = k)")
    return e.select(F.col("n_nationkey").cast("int").alias("focal"), F.col("neighbor").cast("int").alias("neighbor"), (1.0 + F.col("n_nationkey") % 3).alias("weight"))


_RING = "nr AS (SELECT CAST(n_nationkey AS INTEGER) AS id, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k, count(*) OVER (PARTITION BY n_regionkey) AS m FROM nation), ring AS (SELECT a.id AS focal, b.id AS neighbor, 1.0 + a.id % 3 AS weight FROM nr a JOIN nr b ON a.r = b.r AND a.id <> b.id AND ((a.k + 1) % a.m = b.k OR (b.k + 1) % a.m = a.k)), w AS (SELECT focal, neighbor, CAST(weight AS DOUBLE) / sum(weight) OVER (PARTITION BY focal) AS w FROM ring), edges AS (SELECT a.focal AS i, a.neighbor AS j, a.w AS si, coalesce(b.w, 0) AS sj FROM w a LEFT JOIN w b ON b.focal = a.neighbor AND b.neighbor = a.focal WHERE a.focal < a.neighbor)"


@query(f"WITH {_RING} SELECT focal, neighbor, round(w, 6) AS weight FROM w")
def graph_row_standardize(spark, d):
    return G.row_standardize(_ring(spark, d)).select("focal", "neighbor", r6("weight").alias("weight"))


@query(f"WITH {_RING} SELECT i, j, round(si, 6) AS share_i, round(sj, 6) AS share_j FROM edges")
def graph_edges_allocation(spark, d):
    return G.allocation_edges(_ring(spark, d)).select("i", "j", r6("share_i").alias("share_i"), r6("share_j").alias("share_j"))


@query(f"WITH {_POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY origin_id ORDER BY e, destination_id) AS k FROM pairs WHERE origin_id <> destination_id) SELECT origin_id AS focal, destination_id AS neighbor, round(1.0 / 4, 6) AS weight FROM r WHERE k <= 4")
def knn_graph(spark, d):
    return G.knn_graph(_points(spark, d), 4).select("focal", "neighbor", r6("weight").alias("weight"))


@query(f"WITH RECURSIVE {_RING}, l AS (SELECT focal AS a, neighbor AS b FROM ring), h AS (SELECT 0 AS alt, 0 AS hops UNION SELECT l.b, h.hops + 1 FROM h JOIN l ON l.a = h.alt WHERE h.hops < 4) SELECT alt, min(hops) AS hops FROM h GROUP BY alt")
def graph_hops(spark, d):
    return G.hop_distances(_ring(spark, d), [0], 4).select("alt", "hops")


# ---- probabilities, likelihoods, scores at fixed coefficients
@query(f"WITH {_GRID} SELECT c_custkey, n_nationkey, round(p, 6) + 0.0 AS probability FROM p")
def mnl_probabilities(spark, d):
    return scored(spark, d).select("c_custkey", "n_nationkey", r6("probability").alias("probability"))


@query(f"WITH {_GRID} SELECT round(sum(ln(p)), 4) AS log_likelihood FROM p WHERE chosen = 1")
def mnl_loglik(spark, d):
    return P.log_likelihood(scored(spark, d)).select(F.round("log_likelihood", 4).alias("log_likelihood"))


@query(f"WITH {_GRID} SELECT c_custkey, round(sum((chosen - p) * bal), 6) + 0.0 AS bal, round(sum((chosen - p) * same_region), 6) + 0.0 AS same_region, round(sum((chosen - p) * acct_x_bal), 6) + 0.0 AS acct_x_bal FROM p GROUP BY 1")
def mnl_scores(spark, d):
    s = P.scores(scored(spark, d), "c_custkey", {n: F.col(n) for n in BETA})
    return s.select("c_custkey", *(r6(n).alias(n) for n in BETA))


def _moment_sql(a: str, b: str) -> str:
    return f"SELECT '{a}' AS a, '{b}' AS b, round(sum(q), 3) + 0.0 AS value FROM (SELECT sum(p * {a} * {b}) - sum(p * {a}) * sum(p * {b}) AS q FROM p GROUP BY c_custkey)"


_PAIRS_OF = [(a, b) for i, a in enumerate(BETA) for b in list(BETA)[i:]]


@query(f"WITH {_GRID} " + " UNION ALL ".join(_moment_sql(a, b) for a, b in _PAIRS_OF))
def mnl_information(spark, d):
    return P.information(scored(spark, d), "c_custkey", {n: F.col(n) for n in BETA}).select("a", "b", (F.round("value", 3) + 0.0).alias("value"))


@query(f"WITH {_GRID}, k AS (SELECT count(*) AS k FROM grid WHERE av GROUP BY c_custkey) SELECT round(sum(-ln(k)), 4) AS log_likelihood FROM k")
def null_loglik(spark, d):
    return P.null_log_likelihood(flagship_table(spark, d).df, "c_custkey", F.col("available") > 0).select(F.round("log_likelihood", 4).alias("log_likelihood"))


def _nested(lam: str) -> str:
    return f"WITH {_GRID}, s AS (SELECT *, {lam} AS l, v / {lam} AS s FROM v), iv AS (SELECT c_custkey, region, any_value(l) AS l, ln(sum(exp(s))) AS iv FROM s WHERE av GROUP BY 1, 2), t AS (SELECT *, exp(l * iv) / sum(exp(l * iv)) OVER (PARTITION BY c_custkey) AS q FROM iv) SELECT s.c_custkey, n_nationkey, round(coalesce(exp(s - iv) * q, 0), 6) + 0.0 AS probability FROM s LEFT JOIN t ON s.c_custkey = t.c_custkey AND s.region = t.region AND av"


def _nested_frame(spark, d, lam: Column) -> DataFrame:
    t = flagship_table(spark, d).df.withColumn("v", P.linear_predictor({n: F.col(n) for n in BETA}, BETA)).withColumn("lam", lam)
    return P.nested_probabilities(t, "c_custkey", "v", "region", "lam", F.col("available") > 0)


@query(_nested("(0.5 + 0.1 * region)"))
def nested_probabilities(spark, d):
    return _nested_frame(spark, d, 0.5 + 0.1 * F.col("region")).select("c_custkey", "n_nationkey", r6("probability").alias("probability"))


@query(f"WITH {_GRID} SELECT c_custkey, n_nationkey, round(p, 6) + 0.0 AS probability FROM p")
def nested_lambda_one_is_mnl(spark, d):
    return _nested_frame(spark, d, F.lit(1.0)).select("c_custkey", "n_nationkey", r6("probability").alias("probability"))


def _scl_sql(rho: float) -> str:
    return f"""WITH {_GRID}, {_RING}, ends AS (SELECT i, j, i AS alt, si AS s FROM edges UNION ALL SELECT i, j, j, sj FROM edges),
t AS (SELECT c_custkey, i, j, alt, CASE WHEN av THEN pow(greatest(s, 1e-300) * exp(v), 1 / {rho}) ELSE 0 END AS t FROM v JOIN ends ON alt = n_nationkey),
e AS (SELECT *, sum(t) OVER (PARTITION BY c_custkey, i, j) AS n FROM t),
part AS (SELECT c_custkey, alt, sum(CASE WHEN n > 0 THEN t / n * pow(n, {rho}) ELSE 0 END) AS q FROM e GROUP BY 1, 2 UNION ALL SELECT c_custkey, n_nationkey, CASE WHEN av THEN exp(v) ELSE 0 END FROM v WHERE n_nationkey NOT IN (SELECT alt FROM ends))
SELECT c_custkey, alt AS n_nationkey, round(q / sum(q) OVER (PARTITION BY c_custkey), 6) + 0.0 AS probability FROM part"""


def _scl(spark, d, rho: float) -> DataFrame:
    t = flagship_table(spark, d).df.withColumn("v", P.linear_predictor({n: F.col(n) for n in BETA}, BETA))
    p = P.scl_probabilities(t, "c_custkey", "n_nationkey", "v", G.allocation_edges(_ring(spark, d)), rho, F.col("available") > 0)
    return p.select(F.col("obs").alias("c_custkey"), F.col("alt").alias("n_nationkey"), r6("probability").alias("probability"))


@query(_scl_sql(0.6))
def scl_probabilities(spark, d):
    return _scl(spark, d, 0.6)


@query(_scl_sql(1.0))
def scl_rho_one(spark, d):
    return _scl(spark, d, 1.0)


# ---- spatial lag by a power series of edge joins
def _series_sql(rho: float, terms: int) -> str:
    steps = "".join(f", s{k} AS (SELECT a.id, {rho} * coalesce(sum(w.w * b.x), 0) AS x FROM s{k - 1} a LEFT JOIN w ON w.focal = a.id LEFT JOIN s{k - 1} b ON b.id = w.neighbor GROUP BY a.id)" for k in range(1, terms))
    total = " UNION ALL ".join(f"SELECT id, x FROM s{k}" for k in range(terms))
    return f"WITH {_GRID}, {_RING}, s0 AS (SELECT n_nationkey AS id, bal AS x FROM alts){steps} SELECT id AS n_nationkey, round(sum(x), 6) + 0.0 AS filtered FROM ({total}) GROUP BY id"


@query(_series_sql(0.4, 8))
def sar_power_series(spark, d):
    alts = alternatives(spark, d).select("n_nationkey", "bal")
    out = G.power_series_filter(alts, G.row_standardize(_ring(spark, d)), [], "n_nationkey", "bal", 0.4, 8)
    return out.select("n_nationkey", r6("filtered").alias("filtered"))


@query(f"WITH {_GRID}, {_RING} SELECT a.n_nationkey, round(coalesce(sum(w.w * b.bal), 0), 6) + 0.0 AS lag FROM alts a LEFT JOIN w ON w.focal = a.n_nationkey LEFT JOIN alts b ON b.n_nationkey = w.neighbor GROUP BY 1")
def sar_spatial_lag(spark, d):
    alts = alternatives(spark, d).select("n_nationkey", "bal")
    return G.spatial_lag(alts, G.row_standardize(_ring(spark, d)), [], "n_nationkey", "bal").select("n_nationkey", r6("lag").alias("lag"))


# ---- effects at fixed coefficients
@query(f"WITH {_GRID} SELECT c_custkey AS obs, n_nationkey AS alt, round((1 - p) * 0.05, 6) AS effect FROM p")
def marginal_effects_mnl(spark, d):
    return E.own_effect(obs_alt(scored(spark, d)), BETA["bal"]).select("obs", "alt", r6("effect").alias("effect"))


@query(f"WITH {_GRID} SELECT c_custkey AS obs, n_nationkey AS alt, round(-p * 0.05, 6) + 0.0 AS effect FROM p")
def cross_effects(spark, d):
    return E.cross_effect(obs_alt(scored(spark, d)), BETA["bal"]).select("obs", "alt", r6("effect").alias("effect"))


@query(f"WITH {_GRID} SELECT c_custkey AS obs, n_nationkey AS alt, round((1 - p) * 0.05 * bal, 6) + 0.0 AS effect FROM p")
def elasticities(spark, d):
    frame = scored(spark, d).select(F.col("c_custkey").alias("obs"), F.col("n_nationkey").alias("alt"), "probability", "bal")
    return E.own_effect(frame, BETA["bal"]).select("obs", "alt", r6(F.col("effect") * F.col("bal")).alias("effect"))


@query(f"WITH {_GRID} SELECT n_nationkey AS alt, round(avg((1 - p) * 0.05), 6) AS effect FROM p GROUP BY 1")
def ame_by_alt(spark, d):
    return E.average(E.own_effect(obs_alt(scored(spark, d)), BETA["bal"]), "alt").select("alt", r6("effect").alias("effect"))


@query(_nested("0.7").replace("round(coalesce(exp(s - iv) * q, 0), 6) + 0.0 AS probability", "round(0.05 * (1 / 0.7 - 0.3 / 0.7 * coalesce(exp(s - iv), 0) - coalesce(exp(s - iv) * q, 0)), 6) + 0.0 AS effect"))
def nested_effects(spark, d):
    frame = obs_alt(_nested_frame(spark, d, F.lit(0.7)))
    nests = read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("alt"), F.col("n_regionkey").cast("string").alias("nest"), F.lit(0.7).alias("lambda"))
    return E.own_effect(frame, BETA["bal"], nests).select(F.col("obs").alias("c_custkey"), F.col("alt").alias("n_nationkey"), r6("effect").alias("effect"))


# ---- covariance parts
def _meat_sql(group: str, factor: str) -> str:
    s = ", ".join(f"sum((chosen - p) * {n}) AS {n}" for n in BETA)
    parts = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum({a} * {b}) * {factor}, 3) + 0.0 AS value FROM s" for a, b in _PAIRS_OF)
    return f"WITH {_GRID}, s AS (SELECT {group} AS g, {s} FROM p GROUP BY 1) {parts}"


@query(_meat_sql("c_custkey", "1"))
def robust_meat(spark, d):
    s = P.scores(scored(spark, d), "c_custkey", {n: F.col(n) for n in BETA})
    return P.meat(s, list(BETA)).select("a", "b", (F.round("value", 3) + 0.0).alias("value"))


@query(_meat_sql("c_custkey % 20", "(count(*) / (count(*) - 1))"))
def clustered_meat(spark, d):
    s = P.scores(scored(spark, d), "c_custkey", {n: F.col(n) for n in BETA}).withColumn("g", F.col("c_custkey") % 20)
    return P.meat(s, list(BETA), "g").select("a", "b", (F.round("value", 3) + 0.0).alias("value"))


# ---- simulation
@query(f"WITH {_GRID}, c AS (SELECT *, sum(p) OVER (PARTITION BY c_custkey ORDER BY n_nationkey) AS upto, {uniform_sql(3, '0', 'c_custkey')} AS u FROM p) SELECT c_custkey AS obs, min(n_nationkey) AS alt FROM c WHERE upto > u AND p > 0 GROUP BY 1")
def simulate_independent(spark, d):
    return M.simulate(obs_alt(scored(spark, d)), 1, 3).select("obs", "alt")


@query(f"WITH {_GRID}, c AS (SELECT *, sum(p) OVER (PARTITION BY c_custkey ORDER BY n_nationkey) AS upto, {uniform_sql(3, '1', '0', 'c_custkey')} AS u FROM p), a AS (SELECT c_custkey, min(n_nationkey) AS alt FROM c WHERE upto > u AND p > 0 GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY alt ORDER BY {uniform_sql(3, "'lot1'", '0', 'c_custkey')}, c_custkey) AS k FROM a) SELECT c_custkey AS obs, alt FROM k WHERE alt % 2 = 1 OR k <= 20")
def simulate_capacity_round1(spark, d):
    out = M.capacity_lottery(obs_alt(scored(spark, d)), {a: 20 for a in range(0, 25, 2)}, 1, 3, max_rounds=1)
    return out.filter("round = 1").select("obs", "alt")


@query()
def simulate_capacity_full(spark, d):
    return M.capacity_lottery(obs_alt(scored(spark, d)), {a: 20 for a in range(0, 25, 2)}, 1, 3)


# ---- synthetic data
@query("WITH c AS (SELECT unnest(range(1000)) AS oid), a AS (SELECT unnest(range(6)) AS aid), u AS (SELECT oid, aid, -0.65 * (1 + 9 * " + uniform_sql(1, "'x'", "aid") + ") - ln(-ln(" + uniform_sql(1, "oid", "aid") + ")) AS u FROM c, a) SELECT oid, max_by(aid, u) AS choice FROM u GROUP BY oid")
def dgp_mnl(spark, d):
    grid = spark.range(1000).withColumnRenamed("id", "oid").crossJoin(spark.range(6).withColumnRenamed("id", "aid"))
    u = -0.65 * (1 + 9 * uniform(1, F.lit("x"), "aid")) + gumbel(uniform(1, "oid", "aid"))
    return grid.groupBy("oid").agg(F.max_by("aid", u).alias("choice"))


# ---- estimation
@query(f"WITH {_GRID}, n AS (SELECT choice, count(*) AS k FROM choosers GROUP BY 1) SELECT 'one[' || choice || ']' AS parameter, round(ln(k / (SELECT k FROM n WHERE choice = (SELECT min(choice) FROM n))), 5) + 0.0 AS estimate FROM n WHERE choice > (SELECT min(choice) FROM n)")
def mnl_fit_asc_only(spark, d):
    """Constants alone have the closed form ln(share / base share)."""
    c, a = choosers(spark, d).select("c_custkey", "choice"), alternatives(spark, d)
    chosen = c.select(F.col("choice").alias("n_nationkey")).distinct()
    t = ChoiceTable.from_tables(c, a.join(chosen, "n_nationkey", "left_semi").select("n_nationkey", F.lit(1.0).alias("one")), "choice", obs_id="c_custkey", alt_id="n_nationkey")
    base = c.agg(F.min("choice")).first()[0]
    r = ChoiceModel(t, spec=ModelSpec().alternative_specific("one", reference=base)).fit()
    return spark.createDataFrame(r.tidy()[["parameter", "estimate"]]).select("parameter", (F.round("estimate", 5) + 0.0).alias("estimate"))


def _newton_sql(steps: int = 8) -> str:
    ctes = "b0 AS (SELECT CAST(0 AS DOUBLE) AS b)"
    for k in range(steps):
        ctes += f", q{k} AS MATERIALIZED (SELECT c_custkey, chosen, bal, exp(b * bal) / sum(exp(b * bal)) OVER (PARTITION BY c_custkey) AS p FROM grid, b{k} WHERE av), m{k} AS (SELECT sum(chosen * bal) AS o, sum(p * bal) AS m, sum(p * bal * bal) AS s FROM q{k} GROUP BY c_custkey), b{k + 1} AS MATERIALIZED (SELECT any_value(b) + sum(o - m) / sum(s - m * m) AS b FROM m{k}, b{k})"
    return f"WITH {_GRID}, {ctes} SELECT 'bal' AS parameter, round(b, 5) AS estimate FROM b{steps}"


@query(_newton_sql())
def mnl_fit_one_param(spark, d):
    r = ChoiceModel(flagship_table(spark, d), "bal").fit()
    return spark.createDataFrame(r.tidy()[["parameter", "estimate"]]).select("parameter", F.round("estimate", 5).alias("estimate"))


def _tidy(spark, model: ChoiceModel) -> DataFrame:
    r = model.fit()
    table = r.tidy()
    table["log_likelihood"], table["converged"] = r.log_likelihood, bool(r.converged)
    return spark.createDataFrame(table)


@query()
def mnl_fit_flagship(spark, d):
    return _tidy(spark, ChoiceModel(flagship_table(spark, d), FORMULA))


def _open_alternatives(spark, d) -> ChoiceTable:
    """The flagship data on the alternatives that are available, all of them, which models with graphs need."""
    t = flagship_table(spark, d)
    open_ = [r[0] for r in t.df.filter("available > 0").select("n_nationkey").distinct().orderBy("n_nationkey").collect()]
    return t if len(open_) == t.universe.count() else t.restrict(open_)


def _region_nests(spark, d, t: ChoiceTable) -> dict:
    open_ = {r[0] for r in t.df.select("n_nationkey").distinct().collect()}
    out: dict = {}
    for r in read(spark, d, "nation").select("n_nationkey", "n_regionkey").collect():
        if r[0] in open_:
            out.setdefault("europe" if r[1] == 3 else "elsewhere", []).append(int(r[0]))
    return out


def _small_graph(t: ChoiceTable) -> tuple[list, np.ndarray]:
    alts = [r[0] for r in t.df.select("n_nationkey").distinct().orderBy("n_nationkey").collect()]
    from .sources.dgp import ring_adjacency

    return alts, ring_adjacency(len(alts))


@query()
def fit_nested(spark, d):
    t = _open_alternatives(spark, d)
    return _tidy(spark, ChoiceModel(t, "same_region + acct_x_bal", nests=_region_nests(spark, d, t), solver_options={"maxiter": 30}))


@query()
def fit_scl(spark, d):
    t = _open_alternatives(spark, d)
    return _tidy(spark, ChoiceModel(t, "same_region + acct_x_bal", graph=_small_graph(t)[1], solver_options={"maxiter": 30}))


@query()
def fit_mixed(spark, d):
    return _tidy(spark, ChoiceModel(_open_alternatives(spark, d), "same_region + acct_x_bal", random_params={"acct_x_bal": "normal"}))


@query()
def fit_sar_pml(spark, d):
    t = _open_alternatives(spark, d)
    return _tidy(spark, ChoiceModel(t, "same_region + acct_x_bal", graph=_small_graph(t)[1], lag=True, solver_options={"maxiter": 30}))


@query()
def fit_sar_reduced(spark, d):
    t = _open_alternatives(spark, d)
    return _tidy(spark, ChoiceModel(t, "same_region + acct_x_bal", graph=_small_graph(t)[1], lag=True, estimator="reduced", solver_options={"maxiter": 30}))


@query()
def fit_gmm(spark, d):
    t = _open_alternatives(spark, d)
    return _tidy(spark, ChoiceModel(t, "same_region + acct_x_bal", graph=_small_graph(t)[1], lag=True, estimator="linearized_gmm"))


@query()
def specification_tests(spark, d):
    t = _open_alternatives(spark, d)
    model, small = ChoiceModel(t, "same_region + acct_x_bal"), ChoiceModel(t, "same_region")
    full, part = model.fit(), small.fit()
    graph, alts = _small_graph(t)[1], _small_graph(t)[0]
    rows = [("lr", lr_test(part, full)), ("wald", wald_test(full.coefficients, full.covariance_matrix, [[0, 1]])), ("lm_lag", lm_lag_test(model, graph)), ("lm_error", lm_error_test(model, graph)), ("hausman", hausman_test(full, part)), ("iia", iia_test(model, alts[: max(2, len(alts) // 2)]))]
    return spark.createDataFrame(pd.DataFrame([(n, float(r.statistic), int(r.df), float(r.p_value)) for n, r in rows], columns=["test", "statistic", "df", "p_value"]))


@query()
def wtp(spark, d):
    r = ChoiceModel(flagship_table(spark, d), FORMULA).fit()
    return spark.createDataFrame(r.wtp(["same_region"], "bal"))
