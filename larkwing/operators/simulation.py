"""Simulated choices from a probability frame (obs, alt, probability): independent draws and lotteries with capacities."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.uniform import uniform
from .sampling import maybe_broadcast
from .shared import Steps

#: Parts of a lottery: those who come to an alternative are ranked only within the part in which its room ends.
LOTS = 1024


def draw(probabilities: DataFrame, u: str = "u", keys: tuple[str, ...] = ("draw", "obs")) -> DataFrame:
    """(keys, alt, probability): the first alternative in the order of ids whose running share exceeds u."""
    w = Window.partitionBy(*keys).orderBy("alt")
    run = probabilities.withColumn("_upto", F.sum("probability").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("probability").over(Window.partitionBy(*keys)))
    hit = run.filter((F.col("_upto") > F.col(u) * F.col("_all")) & (F.col("probability") > 0))
    best = hit.groupBy(*keys).agg(F.min(F.struct("alt", "probability")).alias("b"))
    return best.select(*keys, F.col("b.alt").alias("alt"), F.col("b.probability").alias("probability"))


def simulate(probabilities: DataFrame, n_draws: int = 1, seed: int = 0) -> DataFrame:
    """(draw, obs, alt, probability)."""
    rows = probabilities.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    return draw(rows.withColumn("u", uniform(seed, "draw", "obs")))


def _placed(came: DataFrame) -> DataFrame:
    """Of came (draw, alt, obs, room, lot) the rows with the least lots, as many as there is room, all where room is null. An
    alternative to which all come is no hot key: counts of parts of the lots say which part is ranked."""
    parts = came.withColumn("_part", F.floor(F.col("lot") * LOTS))
    counts = parts.filter("room is not null").groupBy("draw", "alt", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("draw", "alt").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("draw", "alt", "_part").orderBy("lot", "obs"))
    return parts.join(counts, ["draw", "alt", "_part"], "left").withColumn("_k", rank).filter("room is null or _before + _k <= room")


def capacity_lottery(probabilities: DataFrame, capacity: dict | DataFrame, n_draws: int = 1, seed: int = 0, max_rounds: int = 100, among_open: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """(draw, obs, alt, probability, round). In each round those not yet placed draw among alternatives with room; where more
    come than there is room, a random part of them is placed. Alternatives without capacity take all. Who finds no open
    alternative, or is not placed after max_rounds, has null alt and round 0, with a warning. Rounds are cut by tables in the
    shared checkpoint folder.

    Without among_open, probabilities of open alternatives keep their proportions, which is right for multinomial logit.
    Other models give among_open(people (draw, obs), closed (draw, closed)): (draw, obs, alt, probability) with the
    probabilities recomputed where the alternatives of a draw in the array `closed` are not available."""
    spark = probabilities.sparkSession
    kind = dict(probabilities.dtypes)["alt"]
    if isinstance(capacity, dict):
        capacity = spark.createDataFrame([(k, float(v)) for k, v in capacity.items()], f"alt {kind}, capacity double")
    a, c = capacity.columns
    if not capacity.filter(F.col(c) < 0).limit(1).isEmpty():
        raise ValueError("a capacity is negative")
    room = capacity.filter(F.col(c).isNotNull() & (F.col(c) < float("inf"))).select(F.col(a).cast(kind).alias("alt"), F.floor(c).cast("long").alias("room"))
    draws = spark.range(n_draws).select(F.col("id").cast("int").alias("draw"))
    room = room.crossJoin(F.broadcast(draws))
    steps = Steps(spark, "lottery")
    base = steps.table(probabilities.filter("probability > 0"), "probabilities")
    people = steps.table(probabilities.select("obs").distinct().crossJoin(F.broadcast(draws)), "people-0")
    room, placed, n = steps.table(room, "room-0"), None, 0
    rooms = room.count()
    for n in range(1, max_rounds + 1):
        if among_open and n > 1:
            closed = room.filter("room <= 0").groupBy("draw").agg(F.collect_list("alt").alias("closed"))
            now = among_open(people, maybe_broadcast(closed, rooms)).filter("probability > 0")
        else:
            now = people.join(base, "obs")
        open_ = now.join(room, ["draw", "alt"], "left").filter("room is null or room > 0").drop("room")
        came = draw(open_.withColumn("u", uniform(seed, F.lit(n), "draw", "obs")))
        came = came.join(room, ["draw", "alt"], "left").withColumn("lot", uniform(seed, F.lit(f"lot{n}"), "draw", "obs"))
        came = _placed(steps.table(came, f"came-{n}"))
        won = steps.table(came.select("draw", "obs", "alt", "probability", F.lit(n).alias("round")), f"won-{n}")
        placed = won if placed is None else placed.unionByName(won)
        if won.isEmpty():
            break
        used = won.groupBy("draw", "alt").agg(F.count("*").alias("used"))
        room = steps.table(room.join(used, ["draw", "alt"], "left").select("draw", "alt", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")), f"room-{n}")
        people = steps.table(people.join(won, ["draw", "obs"], "left_anti"), f"people-{n}")
        if people.isEmpty():
            break
    if not people.isEmpty():
        warnings.warn("some choosers could not be placed", RuntimeWarning, stacklevel=2)
    rest = people.select("draw", "obs", F.lit(None).cast(kind).alias("alt"), F.lit(None).cast("double").alias("probability"), F.lit(0).alias("round"))
    return (placed.unionByName(rest) if placed is not None else rest).select("draw", "obs", "alt", "probability", "round")
