"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Targets: the sources, in code point order with null last, weigh 5, 2, 1, repeating; they share all words, and a target stops
at `most` times its source's words, the excess being shared again by weight until none is above.

Rates: of all document rates r >= 0 with sum(size * r) = target in each source, entropy balancing takes those closest to 1 in
relative entropy, at most `most`: r = min(most, exp(lambda * size / mean size)). The dual is convex with one multiplier for
each source; Newton steps on it, kept inside a bracket, each need two sums per source. As a rate depends on source and size
alone, they run over the counts of distinct (source, size), written once; terms are rounded to 2^-20 words and added as
decimals, so a sum, hence a multiplier, is the same in any order of tasks. One row per source goes to the driver a step.

Rounding: every document is taken floor(r) times; which get one more is priority sampling (a hash of the id over the
fraction), with the threshold of each source found by refining a 64-bucket histogram, so no source is ever sorted or
gathered. What is still missing is filled the same way, by the longest documents that fit. The hash depends on the id alone:
reruns agree under any partitioning.

Defined cases: a null or empty text has size 0, is taken once and adds nothing; a null id hashes as itself; rows that repeat
an id share its draw; a source without words has target 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, parameter_table

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS, ROUNDS, GRID = 64, 4, 1 << 20


def water_fill(sizes: dict, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> dict:
    """Targets by source: shares of all words by weight, at most `most` times a source's own words."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, active, left = {}, set(order), float(sum(sizes.values()))
    while active:
        total = sum(weight[s] for s in order if s in active)
        full = [s for s in order if s in active and left * weight[s] / total > most * sizes[s]]
        if not full:
            return target | {s: left * weight[s] / total for s in active}
        for s in full:
            target[s] = float(most * sizes[s])
            active.discard(s)
        left = float(sum(sizes.values())) - sum(target.values())
    return target


@dataclass
class _Source:
    n: int
    size: int
    target: float
    lam: float = 0.0
    low: float = -math.inf
    high: float = math.inf
    done: bool = False
    cuts: list[tuple[float, float]] = field(default_factory=list)  # of each round: largest size that may be added, threshold


def _key(source: Column) -> list[Column]:
    return [source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("src")]


class EntropyMixer:
    """Fits on docs when made; mixture() gives a row for each row of docs."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: int = 3, tolerance: float = 1e-6, seed: int = 9):
        self.spark, self.most = docs.sparkSession, most
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
        narrow = docs.select(F.col(id_col).alias("doc_id"), *_key(F.col(source_col).cast("string")), size.alias("size"))
        work = Workspace(self.spark, "mixing")
        self.docs = work.table(narrow, "sizes")
        self.seed = seed
        self.counts = work.table(self.docs.groupBy("no_source", "src", "size").agg(F.count("*").alias("n")), "counts")
        rows = self.counts.groupBy("no_source", "src").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("s")).collect()
        sizes = {None if r["no_source"] else r["src"]: r["s"] for r in rows}
        targets = water_fill(sizes, weights, most)
        self.sources = {(r["no_source"], r["src"]): _Source(r["n"], r["s"], targets[None if r["no_source"] else r["src"]]) for r in rows}
        self._newton(tolerance)
        for k in range(ROUNDS):
            self._round(k)

    def _with_parameters(self, rows_of: DataFrame | None = None) -> DataFrame:
        cols = ["no_source", "src", "source_size", "target", "mean", "lam", "fits", "below"]
        rows = [(*k, s.size, s.target, max(s.size / s.n, 1e-9), s.lam, [c[0] for c in s.cuts], [c[1] for c in s.cuts]) for k, s in self.sources.items()]
        parameters = parameter_table(self.spark, rows, "no_source boolean, src string, source_size long, target double, mean double, lam double, fits array<double>, below array<double>")
        return (self.docs if rows_of is None else rows_of).join(parameters.select(cols), ["no_source", "src"]).withColumn("rate", self._rate())

    def _rate(self) -> Column:
        x = F.col("size") / F.col("mean")
        return F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.lit(float(self.most)), F.exp(F.least(F.col("lam") * x, F.lit(50.0)))))

    def _newton(self, tolerance: float, steps: int = 200) -> None:
        for s in self.sources.values():
            if s.size == 0 or s.target <= 0:
                s.lam, s.done = 0.0 if s.size == 0 else -1e9, True
            elif s.target >= self.most * s.size * (1 - 1e-12):
                s.lam, s.done = 1e9, True
            else:
                s.lam = math.log(s.target / s.size)
        for _ in range(steps):
            if all(s.done for s in self.sources.values()):
                return
            x = F.col("size") / F.col("mean")
            words = F.col("n") * F.col("size") * F.col("rate")
            inside = F.when(F.col("rate") < self.most, words * x).otherwise(0.0)
            exact = lambda c: F.sum(F.round(c * GRID).cast("decimal(38,0)"))
            for r in self._with_parameters(self.counts).groupBy("no_source", "src").agg(exact(words).alias("g"), exact(inside).alias("h")).collect():
                s = self.sources[(r["no_source"], r["src"])]
                if s.done:
                    continue
                g, h = (float(r[k]) / GRID for k in "gh")
                gap = g - s.target
                if abs(gap) <= tolerance * s.target or s.high - s.low < 1e-12 * max(1.0, abs(s.lam)):
                    s.done = True
                    continue
                s.low, s.high = (s.lam, s.high) if gap < 0 else (s.low, s.lam)
                step = s.lam - gap / h if h > 0 else math.nan
                if not s.low < step < s.high:
                    step = (s.low + s.high) / 2 if math.isfinite(s.low + s.high) else s.lam + math.copysign(1 + abs(s.lam), -gap)
                s.lam = step
        raise RuntimeError("the dual did not converge")

    def _uniform(self, k: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(self.seed + k), F.col("doc_id")), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    def _copies(self, k: int) -> Column:
        """Copies after k rounds of additions."""
        whole = F.floor("rate")
        added, any_ = F.lit(0), F.lit(False)
        for i in range(k):
            hit = ~any_ & self._eligible(i) & (self._priority(i) < F.get("below", F.lit(i)))
            any_ = any_ | hit
        return (whole + F.when(any_, 1).otherwise(added)).cast("long")

    def _eligible(self, k: int) -> Column:
        room = (F.floor("rate") < self.most) & (F.col("size") > 0) & (F.col("size") <= F.get("fits", F.lit(k)))
        return room & (F.col("rate") > F.floor("rate")) if k == 0 else room

    def _priority(self, k: int) -> Column:
        """In (0, 1), smaller first: in the first round, hash over fraction; later the longest that still fit, ties by hash."""
        u = self._uniform(k)
        return u / (u + F.col("rate") - F.floor("rate")) if k == 0 else 1 - (F.col("size") - u / 2) / (F.get("fits", F.lit(k)) + 1)

    def _round(self, k: int) -> None:
        """Add one copy to documents in order of priority while their words fit into what is missing."""
        now = self._with_parameters().withColumn("copies", self._copies(k))
        got = {(r["no_source"], r["src"]): r["s"] for r in now.groupBy("no_source", "src").agg(F.sum(F.col("copies") * F.col("size")).alias("s")).collect()}
        gap = {key: max(0.0, s.target - got[key]) for key, s in self.sources.items()}
        span = {key: (0.0, 1.0, g) for key, g in gap.items() if g >= 1}  # threshold so far, end of the bucket, words left
        for key, s in self.sources.items():
            s.cuts.append((math.inf if k == 0 else gap[key], 0.0))
        frame = self._with_parameters()
        free = ~F.lit(False) if k == 0 else F.col("copies") == F.floor("rate")
        frame = frame.withColumn("copies", self._copies(k)).filter(free & self._eligible(k)).select("no_source", "src", "size", self._priority(k).alias("p"))
        for _ in range(5 if k == 0 else 3):
            if not span:
                break
            spans = parameter_table(self.spark, [(*key, *v) for key, v in span.items()], "no_source boolean, src string, a double, b double, room double")
            bucket = F.least(F.floor((F.col("p") - F.col("a")) / (F.col("b") - F.col("a")) * BUCKETS), F.lit(BUCKETS - 1))
            sums = frame.join(spans, ["no_source", "src"]).filter("p >= a and p < b").groupBy("no_source", "src", "a", "b", "room", bucket.alias("k")).agg(F.sum("size").alias("s"))
            total = sums.withColumn("upto", F.sum("s").over(Window.partitionBy("no_source", "src").orderBy("k")))
            over = total.filter("upto > room").groupBy("no_source", "src", "a", "b", "room").agg(F.min("k").alias("k"), F.min_by(F.col("upto") - F.col("s"), "k").alias("before"))
            found = {(r["no_source"], r["src"]): r for r in over.collect()}
            for key in list(span):
                a, b, room = span[key]
                if (r := found.get(key)) is None:  # all of the bucket fits
                    self.sources[key].cuts[k] = (self.sources[key].cuts[k][0], b)
                    del span[key]
                    continue
                wide = (b - a) / BUCKETS
                span[key] = (a + wide * r["k"], a + wide * (r["k"] + 1), room - r["before"])
                self.sources[key].cuts[k] = (self.sources[key].cuts[k][0], span[key][0])

    def mixture(self) -> DataFrame:
        """(doc_id, size, source_size, target, rate, copies, taken)."""
        out = self._with_parameters().withColumn("copies", self._copies(ROUNDS))
        return out.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    return EntropyMixer(docs, **options).mixture()
