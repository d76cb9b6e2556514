"""Sampling of alternatives for each chooser, and inclusion probabilities.

All draws are functions of (seed, chooser, alternative or slot). Small universes are ranked by a hash key per pair (uniform:
the hash; weighted: Gumbel keys); large ones, sampled uniformly, take the first distinct of a hash sequence, so that no
chooser meets all alternatives. The chosen alternative is left out of the draw and put into the last slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.md5 import Digests
from ..functions.uniform import gumbel, uniform

#: Universes up to this many alternatives are sent to every executor; larger ones are joined by key.
BROADCAST_ALTERNATIVES = 200_000


def with_positions(alternatives: DataFrame, alt_id: str) -> DataFrame:
    """alternatives with `_pos`, 0, 1, ... in the order of the id."""
    return alternatives.withColumn("_pos", (F.row_number().over(Window.orderBy(alt_id)) - 1).cast("int"))


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ALTERNATIVES else df


def _frontrunners(choosers: DataFrame, positions: DataFrame, n: int, seed: int, obs_id: str, alt_id: str, weights: str | None) -> DataFrame | None:
    """Of the pairs of choosers and positions those that may be among a chooser's first n + 1, at least as many; None where
    only all pairs can be ranked: few alternatives with a positive weight, or a null id.

    Every pair's hash is made, in numpy and 32 bits of it, and nothing but frontrunners leaves the task. Both weighted orders
    are those of -ln(u) / w. A bound that about n + 6 sqrt(n) + 30 pairs of a chooser meet picks most of them; a chooser of
    whom fewer than n + 1 meet it surely is ranked as a whole."""
    spark, need = choosers.sparkSession, n + 1
    table = positions.withColumns({"_text": F.col(alt_id).cast("string"), "_weight": F.col(weights).cast("double") if weights else F.lit(1.0)}).toArrow()
    w = table.column("_weight").to_numpy()
    inside = np.flatnonzero(w > 0)  # not for a missing weight
    expected = n + 6 * np.sqrt(n) + 30
    if table.column("_text").null_count or len(inside) <= max(need, expected):
        return None
    table, w = table.take(pa.array(inside)).combine_chunks(), w[inside]
    bound = expected / len(w)
    if weights:
        low, high = 0.0, 1.0
        while -np.expm1(-w * high).sum() < expected:
            high *= 2
        for _ in range(200):
            bound = (low + high) / 2
            low, high = (bound, high) if -np.expm1(-w * bound).sum() < expected else (low, bound)
        least = np.maximum(0, np.floor(np.exp(-w * bound) * 2.0**32) - 2).astype(np.uint32)
    at = [table.schema.get_field_index(c) for c in positions.columns]
    shared = spark.sparkContext.broadcast((table.column("_text").to_pylist(), w, table.select(at)))

    def ratio(first: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The order of a u of which that many 2^-32 are known, downwards."""
        u = first / 2.0**32
        return -np.log(np.where(u > 0, u, 1e-300)) / w if weights else u

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, w, own = shared.value
        digests = Digests([t.encode() for t in texts])
        for part in parts:
            rows, picked = [], []
            for of, first in digests.first_words([p.encode() for p in part.column(part.num_columns - 1).to_pylist()]):
                row, alt = np.nonzero(first >= least if weights else first <= np.uint32(bound * 2.0**32 + 1))
                ends = first[row, alt].astype(float), first[row, alt] + 1.0
                best, worst = (ratio(ends[1], w[alt]), ratio(ends[0], w[alt])) if weights else (ratio(ends[0], 1), ratio(ends[1], 1))
                sure = np.bincount(row[worst <= bound * (1 - 1e-9)], minlength=len(of))
                for i in np.flatnonzero(sure < need).tolist():  # ranked as a whole
                    every = np.arange(len(w))
                    more = (ratio(first[i] + 1.0, w), ratio(first[i].astype(float), w)) if weights else (ratio(first[i].astype(float), 1), ratio(first[i] + 1.0, 1))
                    others = row != i
                    row, alt = np.concatenate([row[others], np.full(len(w), i)]), np.concatenate([alt[others], every])
                    best, worst = np.concatenate([best[others], more[0]]), np.concatenate([worst[others], more[1]])
                order = np.lexsort((worst, row))
                begin = np.searchsorted(row[order], np.arange(len(of)))
                last = worst[order[begin + n]]
                keep = best <= last[row] * (1 + 1e-9) + 1e-300
                rows.append(of[row[keep]])
                picked.append(alt[keep])
            if rows:
                mine = part.select(range(part.num_columns - 1)).take(pa.array(np.concatenate(rows)))
                theirs = own.take(pa.array(np.concatenate(picked))).combine_chunks()
                yield pa.RecordBatch.from_arrays([*mine.columns, *(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in theirs.columns)], names=[*choosers_columns, *positions_columns])

    choosers_columns, positions_columns = choosers.columns, positions.columns
    prefix = F.concat(F.concat_ws("|", F.lit(str(seed)), F.col(obs_id).cast("string")), F.lit("|"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    # a number given by hand, so that small rows that make much work are not put into one task
    dealt = choosers.withColumn("_prefix", prefix).repartition(tasks, obs_id)
    return dealt.mapInArrow(run, StructType([*choosers.schema.fields, *positions.schema.fields]))


def sample_ranked(choosers: DataFrame, positions: DataFrame, n: int, seed: int, obs_id: str, alt_id: str, chosen: str | None = None, weights: str | None = None, method: str = "gumbel", rows: int = 0) -> DataFrame:
    """(obs_id, alt_id, slot): n alternatives without replacement for each chooser, by rank of hash keys. weights names a
    column of positions; rows with weight 0 or less are drawn only if a chooser has too few others. Only what may be among
    the first n is ranked, so pairs are neither sorted nor shuffled."""
    rows = rows or positions.count()
    pairs = _frontrunners(choosers, positions, n, seed, obs_id, alt_id, weights) if rows <= BROADCAST_ALTERNATIVES else None
    if pairs is None:
        pairs = choosers.crossJoin(maybe_broadcast(positions, rows))
    if chosen:
        pairs = pairs.filter(~F.col(alt_id).eqNullSafe(F.col(chosen)))
    u = uniform(seed, obs_id, alt_id)
    if weights is None:
        order = [u]
    else:
        w = F.col(weights)
        key = F.log(w) + gumbel(u) if method == "gumbel" else F.log(u) / w
        order = [F.when(w > 0, 0).otherwise(1), F.when(w > 0, key).desc_nulls_last(), u]
    slot = F.row_number().over(Window.partitionBy(obs_id).orderBy(*order, alt_id))
    return pairs.withColumn("slot", slot).filter(F.col("slot") <= n).withColumn("slot", F.col("slot") - 1)


def sample_distinct(choosers: DataFrame, positions: DataFrame, n: int, n_alts: int, seed: int, obs_id: str, chosen_pos: str | None = None) -> DataFrame:
    """As sample_ranked without weights, from the first distinct of a hash sequence of positions; for n well below n_alts."""
    if n > n_alts // 4:
        raise ValueError("the sample is too large a part of the alternatives")
    draw = lambda i: F.floor(uniform(seed, F.col(obs_id), F.lit("draw"), i) * n_alts).cast("int")
    drawn = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(3 * n + 200)), draw))
    if chosen_pos:
        drawn = F.array_remove(drawn, F.col(chosen_pos))
    out = choosers.select("*", F.posexplode(F.slice(drawn, 1, n)).alias("slot", "_pos"))
    return out.join(maybe_broadcast(positions, n_alts), "_pos")


def sample_with_replacement(choosers: DataFrame, positions: DataFrame, n: int, n_alts: int, seed: int, obs_id: str, chosen_pos: str | None = None, cumulative: list[float] | None = None) -> DataFrame:
    """n draws with replacement, uniform or by cumulative weights (in the order of positions), the chosen one left out."""
    slots = choosers.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    u = uniform(seed, obs_id, "slot")
    if cumulative is None:
        others = n_alts - (1 if chosen_pos else 0)
        index = F.floor(u * others).cast("int")
        pos = F.when(F.col(chosen_pos).isNotNull() & (index >= F.col(chosen_pos)), index + 1).otherwise(index) if chosen_pos else index
    else:
        cum = F.array(*map(F.lit, map(float, cumulative)))
        total, before, own = F.lit(float(cumulative[-1])), F.lit(0.0), F.lit(0.0)
        if chosen_pos:
            before = F.when(F.col(chosen_pos) > 0, F.get(cum, F.col(chosen_pos) - 1)).otherwise(0.0)
            own = F.coalesce(F.get(cum, F.col(chosen_pos)) - before, F.lit(0.0))
            before = F.coalesce(before, F.lit(0.0))
        x = u * (total - own)
        x = F.when(x >= before, x + own).otherwise(x)
        pos = F.least(F.size(F.filter(cum, lambda c: c <= x)), F.lit(n_alts - 1))
    return slots.withColumn("_pos", pos.cast("int")).join(maybe_broadcast(positions, n_alts), "_pos")


def inclusion_probability(method: str, sample_size: Column | int, n_alts: Column | int, weight: Column | None = None, total_weight: Column | float | None = None) -> Column:
    """census, srswor: n / N; srswr: 1 - (1 - 1/N)^n; weighted_wor: 1 - exp(-n w / W); weighted_wr: 1 - (1 - w/W)^n; kept in
    [1e-300, 1]. The method's case does not matter."""
    n, total = (x if isinstance(x, Column) else F.lit(float(x)) for x in (sample_size, n_alts))
    kind = method.lower()
    if kind.startswith("weighted") and weight is None:
        raise ValueError(f"{method} needs weights")
    if kind in ("census", "srswor", "uniform"):
        p = F.when(n >= total, 1.0).otherwise(n / total)
    elif kind == "srswr":
        p = 1 - F.pow(1 - 1 / total, n)
    elif kind == "weighted_wor":
        p = 1 - F.exp(-weight / total_weight * n)
    elif kind == "weighted_wr":
        p = 1 - F.pow(1 - weight / total_weight, n)
    else:
        raise ValueError(f"unknown sampling method {method!r}")
    return F.least(F.greatest(p, F.lit(1e-300)), F.lit(1.0))


def compute_inclusion_probs(sample_size: int, n_alts: int, method: str = "srswor", weights=None) -> np.ndarray:
    """The same on the driver, one value for each alternative."""
    if sample_size < 1 or n_alts < 1:
        raise ValueError("sample_size and n_alts are positive")
    kind = method.lower()
    w = None if weights is None else np.asarray(weights, float)
    if kind.startswith("weighted"):
        if w is None or len(w) != n_alts or (w < 0).any() or w.sum() <= 0:
            raise ValueError("weights: one for each alternative, none negative, not all zero")
        share = w / w.sum()
        p = 1 - np.exp(-share * sample_size) if kind == "weighted_wor" else 1 - (1 - share) ** sample_size
    elif kind in ("census", "srswor"):
        p = np.full(n_alts, min(1.0, sample_size / n_alts))
    elif kind == "srswr":
        p = np.full(n_alts, 1 - (1 - 1 / n_alts) ** sample_size)
    else:
        raise ValueError(f"unknown sampling method {method!r}")
    return np.clip(p, 1e-300, 1)


def validate_inclusion_probs(df: DataFrame, column: str = "pi") -> None:
    bad = df.filter(F.col(column).isNull() | (F.col(column) <= 0) | (F.col(column) > 1)).limit(1)
    if not bad.isEmpty():
        raise ValueError(f"{column}: inclusion probabilities are in (0, 1]")


def sampling_correction(v: Column, pi: Column) -> Column:
    return v + F.log(F.greatest(pi, F.lit(1e-300)))


def sample_alternatives(spark, n_choosers: int, n_alts: int, n_samples: int, weights=None, seed: int = 0, replace: bool = False) -> DataFrame:
    """(chooser, slot, alt): alternatives as positions 0 .. n_alts - 1. weights: none, one for each alternative, or a
    DataFrame (chooser, alt, weight)."""
    choosers, positions = spark.range(n_choosers).withColumnRenamed("id", "chooser"), spark.range(n_alts).select(F.col("id").alias("alt"), F.col("id").cast("int").alias("_pos"))
    if not replace and n_samples > n_alts:
        raise ValueError("a sample without replacement is no larger than the universe")
    if isinstance(weights, DataFrame):
        if replace:
            w = Window.partitionBy("chooser").orderBy("alt")
            cum = weights.select("chooser", "alt", F.sum("weight").over(w).alias("high"), (F.sum("weight").over(w) - F.col("weight")).alias("low"), F.sum("weight").over(Window.partitionBy("chooser")).alias("total"))
            slots = choosers.select("chooser", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("slot")).withColumn("u", uniform(seed, "chooser", "slot"))
            return slots.join(cum, "chooser").filter("u * total >= low and u * total < high").select("chooser", "slot", "alt")
        u = uniform(seed, "chooser", "alt")
        slot = F.row_number().over(Window.partitionBy("chooser").orderBy((F.log("weight") + gumbel(u)).desc_nulls_last(), "alt"))
        return weights.filter("weight > 0").withColumn("slot", slot - 1).filter(F.col("slot") < n_samples).select("chooser", "slot", "alt")
    if weights is not None:
        w = np.asarray(weights, float)
        if len(w) != n_alts:
            raise ValueError("weights: one for each alternative")
        if replace:
            out = sample_with_replacement(choosers, positions, n_samples, n_alts, seed, "chooser", cumulative=list(np.cumsum(w)))
        else:
            table = spark.createDataFrame(list(enumerate(map(float, w))), "alt long, weight double")
            out = sample_ranked(choosers, positions.join(table, "alt"), n_samples, seed, "chooser", "alt", weights="weight", rows=n_alts)
    elif replace:
        out = sample_with_replacement(choosers, positions, n_samples, n_alts, seed, "chooser")
    elif n_alts > 1000 and n_samples <= n_alts // 4:
        out = sample_distinct(choosers, positions, n_samples, n_alts, seed, "chooser")
    else:
        out = sample_ranked(choosers, positions, n_samples, seed, "chooser", "alt", rows=n_alts)
    return out.select("chooser", F.col("slot").cast("int").alias("slot"), "alt")
