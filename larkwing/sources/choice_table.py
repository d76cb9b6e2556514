"""Choice tables: a lazy long DataFrame of chooser x alternative rows and what is known about it.

Rows are keyed by (obs_id, alt_pos), as sampling with replacement may repeat an alternative. Nothing is materialised here:
attributes, pairwise variables, interactions and availability are joins and columns of one plan, and Catalyst prunes what a
model does not use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from ..operators import sampling as S
from ..operators.shared import Steps

RESERVED = ("alt_pos", "chosen", "available", "pi", "obs_weight")
#: Bytes of an array that leave the driver at once.
SLICE_BYTES = 32 << 20


@dataclass(frozen=True)
class ChoiceTable:
    df: DataFrame
    obs_id: str
    alt_id: str
    sampling: str = "census"  # census, srswor, srswr, long
    sample_size: int | None = None
    n_alternatives_full: int | None = None
    has_chosen: bool = True
    has_available: bool = False
    has_weights: bool = False
    universe: DataFrame | None = field(default=None, repr=False)  # (alt_id, _pos)
    interactions: tuple[str, ...] = ()

    @classmethod
    def from_tables(cls, choosers: DataFrame, alternatives: DataFrame, chosen_alternatives: str | DataFrame | None = None, sample_size: int | None = None, matrix_data: dict | None = None, weights: str | list | DataFrame | None = None, available: str | DataFrame | None = None, replace: bool = True, seed: int = 0, obs_id: str | None = None, alt_id: str | None = None, obs_weight: str | None = None, correction: str = "inclusion") -> ChoiceTable:
        """choosers and alternatives are keyed by obs_id and alt_id (default: their first columns). chosen_alternatives: a
        column of choosers, or a table whose first column is a chooser column and whose last is the alternative. weights:
        sampling weights, as a column of alternatives, a list in the order of the ids, or (obs, alt, weight). available: a
        column of alternatives or a table (alt, value) or (obs, alt, value). correction="none" leaves pi at 1."""
        obs_id, alt_id = obs_id or choosers.columns[0], alt_id or alternatives.columns[0]
        clash = (set(choosers.columns) & set(alternatives.columns)) | ({*choosers.columns, *alternatives.columns} & set(RESERVED))
        if clash - ({available} if isinstance(available, str) else set()):
            raise ValueError(f"columns that choosers and alternatives share, or reserved names: {sorted(clash)}")
        n_alts = alternatives.count()
        if n_alts != alternatives.select(alt_id).distinct().count():
            raise ValueError("alternative ids are not unique")
        if not choosers.groupBy(obs_id).count().filter("count > 1").limit(1).isEmpty():
            raise ValueError("chooser ids are not unique")
        positions = S.with_positions(alternatives.select(alt_id), alt_id)
        base = choosers
        if isinstance(chosen_alternatives, DataFrame):
            key, alt = chosen_alternatives.columns[0], chosen_alternatives.columns[-1]
            base = choosers.join(chosen_alternatives.select(F.col(key), F.col(alt).alias("_chosen")), key, "left")
        elif chosen_alternatives:
            base = choosers.withColumn("_chosen", F.col(chosen_alternatives))
        has_chosen = chosen_alternatives is not None
        if has_chosen:
            known = base.filter(F.col("_chosen").isNotNull()).select("_chosen").distinct().join(positions, F.col("_chosen") == F.col(alt_id), "left_anti")
            if not (bad := known.limit(1).collect()) == []:
                raise ValueError(f"a chosen alternative is not in the alternatives: {bad[0][0]!r}")

        wide = S.maybe_broadcast(alternatives.join(positions, alt_id), n_alts)
        if sample_size is None:
            grid = base.crossJoin(wide).withColumnRenamed("_pos", "alt_pos")
            kind, pi = "census", F.lit(1.0)
        else:
            grid, kind = cls._sampled(base, alternatives, positions, n_alts, sample_size, weights, replace, seed, obs_id, alt_id, has_chosen)
            attributes = wide.drop("_pos")
            grid = grid.join(attributes, alt_id)
            pi = S.inclusion_probability(kind, sample_size, n_alts) if correction == "inclusion" else F.lit(1.0)
        if has_chosen:
            grid = grid.withColumn("chosen", F.coalesce((F.col(alt_id) == F.col("_chosen")).cast("int"), F.lit(0))).drop("_chosen")
            if kind == "srswr":  # repeated rows of the chosen alternative: the last slot is the choice
                grid = grid.withColumn("chosen", F.when((F.col("chosen") == 1) & (F.col("alt_pos") < F.lit(sample_size - 1)), 0).otherwise(F.col("chosen")))
            pi = F.when(F.col("chosen") == 1, 1.0).otherwise(pi)
        grid = grid.withColumn("pi", pi)
        if isinstance(available, str):
            grid = grid.withColumn("available", F.coalesce((F.col(available) > 0).cast("double"), F.lit(0.0)))
        elif available is not None:
            *keys, value = available.columns
            by = [alt_id] if len(keys) == 1 else [obs_id, alt_id]
            table = available.select(*(F.col(k).alias(b) for k, b in zip(keys, by, strict=True)), (F.col(value) > 0).cast("double").alias("available"))
            grid = grid.join(table, by, "left").withColumn("available", F.coalesce("available", F.lit(0.0)))
        if obs_weight:
            grid = grid.withColumn("obs_weight", F.col(obs_weight).cast("double"))
        out = cls(grid, obs_id, alt_id, kind, sample_size, n_alts, has_chosen, available is not None, obs_weight is not None, positions)
        for name, data in (matrix_data or {}).items():
            out = out.add_matrix(name, data)
        return out

    @staticmethod
    def _sampled(base, alternatives, positions, n_alts, n, weights, replace, seed, obs_id, alt_id, has_chosen):
        if n < 1 or (not replace and n > n_alts):
            raise ValueError("sample_size is from 1 to the number of alternatives")
        drawn = n - 1 if has_chosen else n
        slim = base.select(obs_id, *(["_chosen"] if has_chosen else []))
        if has_chosen:
            slim = slim.join(S.maybe_broadcast(positions.select(F.col(alt_id).alias("_chosen"), F.col("_pos").alias("_cpos")), n_alts), "_chosen", "left")
        pos, kind = "_cpos" if has_chosen else None, "srswr" if replace else "srswor"
        if isinstance(weights, DataFrame):
            o, a, w = weights.columns
            pairs = weights.select(F.col(o).alias(obs_id), F.col(a).alias(alt_id), F.col(w).alias("_w")).join(slim, obs_id)
            if has_chosen:
                pairs = pairs.filter(~F.col(alt_id).eqNullSafe(F.col("_chosen")))
            if replace:
                u = slim.select(obs_id, F.explode(F.sequence(F.lit(0), F.lit(drawn - 1))).alias("slot")).withColumn("_u", S.uniform(seed, obs_id, "slot"))
                by = Window.partitionBy(obs_id).orderBy(alt_id)
                cum = pairs.select(obs_id, alt_id, F.sum("_w").over(by).alias("_hi"), (F.sum("_w").over(by) - F.col("_w")).alias("_lo"), F.sum("_w").over(Window.partitionBy(obs_id)).alias("_all"))
                out = u.join(cum, obs_id).filter("_u * _all >= _lo and _u * _all < _hi").select(obs_id, alt_id, "slot")
            else:
                key = F.log("_w") + S.gumbel(S.uniform(seed, obs_id, alt_id))
                rank = F.row_number().over(Window.partitionBy(obs_id).orderBy(key.desc_nulls_last(), alt_id)) - 1
                out = pairs.filter("_w > 0").withColumn("slot", rank).filter(F.col("slot") < drawn)
        elif weights is not None:
            w = F.col(weights) if isinstance(weights, str) else None
            if w is None:
                table = base.sparkSession.createDataFrame(list(enumerate(map(float, weights))), "_pos int, _w double")
                weighted = positions.join(table, "_pos")
            else:
                weighted = positions.join(alternatives.select(alt_id, w.cast("double").alias("_w")), alt_id)
            if replace:
                values = [r["_w"] or 0.0 for r in weighted.orderBy("_pos").collect()]
                out = S.sample_with_replacement(slim, positions, drawn, n_alts, seed, obs_id, pos, list(np.cumsum(values)))
            else:
                out = S.sample_ranked(slim, weighted, drawn, seed, obs_id, alt_id, "_chosen" if has_chosen else None, "_w", rows=n_alts)
        elif replace:
            out = S.sample_with_replacement(slim, positions, drawn, n_alts, seed, obs_id, pos)
        elif n_alts > 1000 and drawn <= n_alts // 4:
            out = S.sample_distinct(slim, positions, drawn, n_alts, seed, obs_id, pos)
        else:
            out = S.sample_ranked(slim, positions, drawn, seed, obs_id, alt_id, "_chosen" if has_chosen else None, rows=n_alts)
        out = out.select(obs_id, alt_id, F.col("slot").cast("int").alias("alt_pos"))
        if has_chosen:
            out = out.unionByName(slim.filter("_chosen is not null").select(obs_id, F.col("_chosen").alias(alt_id), F.lit(n - 1).alias("alt_pos")))
        return base.join(out, obs_id), kind

    @classmethod
    def from_long(cls, data: DataFrame, obs_id: str, alt_id: str, chosen: str | None = None, available: str | None = None, order: str | None = None, obs_weight: str | None = None) -> ChoiceTable:
        """A table that is long already. (obs, alt) pairs are unique, and all observations have as many alternatives."""
        if not data.groupBy(obs_id, alt_id).count().filter("count > 1").limit(1).isEmpty():
            raise ValueError("duplicate (observation, alternative) pairs")
        sizes = data.groupBy(obs_id).count().agg(F.min("count").alias("a"), F.max("count").alias("b")).first()
        if sizes["a"] != sizes["b"]:
            raise ValueError("non-rectangular data: observations differ in their number of alternatives")
        out = data.withColumn("alt_pos", (F.row_number().over(Window.partitionBy(obs_id).orderBy(order or alt_id)) - 1).cast("int")).withColumn("pi", F.lit(1.0))
        if chosen:
            out = out.withColumn("chosen", F.col(chosen).cast("int"))
        if available:
            out = out.withColumn("available", (F.col(available) > 0).cast("double"))
        if obs_weight:
            out = out.withColumn("obs_weight", F.col(obs_weight).cast("double"))
        universe = S.with_positions(data.select(alt_id).distinct(), alt_id)
        return cls(out, obs_id, alt_id, "long", None, None, chosen is not None, available is not None, obs_weight is not None, universe)

    def _with(self, df: DataFrame, **changes) -> ChoiceTable:
        return replace(self, df=df, **changes)

    def add_pairwise_variable(self, name: str, pairs: DataFrame, check: bool = True) -> ChoiceTable:
        """Left join of (obs, alt, value); a repeated alternative of one observation gets the value at its first place only.
        Observations that pairs knows must match somewhere; a variable of that name is replaced."""
        o, a, v = pairs.columns
        if not pairs.groupBy(o, a).count().filter("count > 1").limit(1).isEmpty():
            raise ValueError(f"{name}: a pair has several values")
        table = pairs.select(F.col(o).alias(self.obs_id), F.col(a).alias(self.alt_id), F.col(v).cast("double").alias("_value"), F.lit(1).alias("_hit"))
        df = self.df.drop(name).join(table, [self.obs_id, self.alt_id], "left")
        if check:
            known = df.join(table.select(self.obs_id).distinct(), self.obs_id, "left_semi").groupBy(self.obs_id).agg(F.max("_hit").alias("h")).filter("h is null").limit(1)
            if not known.isEmpty():
                raise KeyError(f"{name}: no pair matches the alternatives of an observation")
        value = F.col("_value")
        if self.sampling == "srswr":
            first = F.row_number().over(Window.partitionBy(self.obs_id, self.alt_id).orderBy("alt_pos")) == 1
            value = F.when(first, value)
        value = F.when(F.isnan(value), None).otherwise(value)
        return self._with(df.withColumn(name, value).drop("_value", "_hit"), interactions=tuple(i for i in self.interactions if i != name))

    def add_matrix(self, name: str, data) -> ChoiceTable:
        """A chooser x alternative variable from: (obs, alt, value) pairs, (alt, value) rows, (row, array of values) rows whose
        numbers are 0, 1, ... once each, or an array: (n, J) or flat n * J over this table's rows, (n, all alternatives) over
        the universe, or one value for each alternative of the universe. Rows of arrays, and numbers of rows, follow the order
        of the ids. An array leaves the driver slice by slice; one that does not fit there comes as numbered rows."""
        if isinstance(data, DataFrame):
            if len(data.columns) == 3:
                return self.add_pairwise_variable(name, data)
            a, v = data.columns
            if isinstance(data.schema[v].dataType, ArrayType):
                rows = data.select(F.col(a).cast("long").alias("_row"), F.col(v).cast("array<double>").alias("_values"))
                size = rows.agg(F.count("_values").alias("n"), F.countDistinct("_row").alias("rows"), F.min("_row").alias("least"), F.max("_row").alias("most"), F.min(F.size("_values")).alias("a"), F.max(F.size("_values")).alias("b")).first()
                if (size["rows"], size["least"], size["most"], size["a"]) != (size["n"], 0, size["n"] - 1, size["b"]):
                    raise ValueError(f"{name}: rows are not numbered 0, 1, ... once each, or differ in length")
                return self._dense(name, (size["n"], size["b"]), lambda steps, width: rows)
            table = S.maybe_broadcast(data.select(F.col(a).alias(self.alt_id), F.col(v).cast("double").alias(name)), self.n_alternatives_full or 0)
            return self._with(self.df.drop(name).join(table, self.alt_id, "left"))
        x = np.asarray(data, float)
        spark, full = self.df.sparkSession, self.universe.count()
        if x.shape == (full,):
            table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], f"_pos int, {name} double").join(self.universe, "_pos").drop("_pos")
            return self._with(self.df.drop(name).join(S.maybe_broadcast(table, full), self.alt_id, "left"))

        def sliced(steps: Steps, width: int) -> DataFrame:
            m = x.reshape(-1, max(1, width)) if x.ndim == 1 else x
            some = max(1, SLICE_BYTES // (8 * max(1, m.shape[1])))
            for i in range(0, max(1, len(m)), some):
                part = np.ascontiguousarray(m[i : i + some])
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)), pa.array(part.ravel()))
                out = steps.append(spark.createDataFrame(pa.table({"_row": np.arange(i, i + len(part)), "_values": values})), "values")
            return out

        return self._dense(name, x.shape, sliced)

    def _dense(self, name: str, shape: tuple[int, ...], values: Callable[[Steps, int], DataFrame]) -> ChoiceTable:
        """values gives (_row, _values) of a table with so many alternatives. Ids are numbered where they lie: sorted in ranges, a range's rows counted from the sum
        of those before."""
        spark, full = self.df.sparkSession, self.universe.count()
        steps = Steps(spark, "matrix")
        ids = self.df.groupBy(self.obs_id).agg(F.count("*").alias("_k")).orderBy(self.obs_id).withColumn("_at", F.monotonically_increasing_id())
        ids = steps.table(ids, "ids").withColumn("_range", F.shiftright("_at", 33))
        ranges = sorted(ids.groupBy("_range").agg(F.count("*").alias("n"), F.max("_k").alias("k")).collect())
        n, width = sum(r["n"] for r in ranges), max((r["k"] for r in ranges), default=0)
        if shape not in ((n, width), (n, full), (n * width,)):
            raise ValueError(f"{name}: shape {shape} fits neither {n} x {width} nor {n} x {full}")
        before = np.cumsum([0] + [r["n"] for r in ranges]).tolist()
        starts = spark.createDataFrame([(r["_range"], b) for r, b in zip(ranges, before[:-1], strict=True)], "_range long, _before long")
        order = ids.join(F.broadcast(starts), "_range").select(self.obs_id, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("_row"))
        df = self.df.drop(name).join(order.join(values(steps, width), "_row").drop("_row"), self.obs_id)
        if (len(shape) == 1 or shape[1] == width) and (self.sampling in ("census", "long") or width != full):
            at = F.col("alt_pos")
        else:
            df, at = df.join(S.maybe_broadcast(self.universe, full), self.alt_id), F.col("_pos")
        return self._with(df.withColumn(name, F.get("_values", at)).drop("_values", "_pos"))

    def add_interaction(self, name: str, left: str, right: str, op: str = "product", missing_policy: str = "error") -> ChoiceTable:
        """name = left * right. missing_policy="error": no row that is available may lack it; "allow_unavailable": rows that
        are not available may lack it (the same check); it is then null."""
        if op != "product" or missing_policy not in ("error", "allow_unavailable"):
            raise ValueError("op is 'product'; missing_policy is 'error' or 'allow_unavailable'")
        df = self.df.withColumn(name, F.col(left) * F.col(right))
        lacks = F.col(name).isNull() | F.isnan(name)
        if missing_policy == "allow_unavailable" and self.has_available:
            lacks = lacks & (F.col("available") > 0)
        if not df.filter(lacks).limit(1).isEmpty():
            raise ValueError(f"{name} is missing on an available row")
        return self._with(df, interactions=(*self.interactions, name))

    n_observations = property(lambda self: self.df.select(self.obs_id).distinct().count())
    n_alternatives = property(lambda self: self.df.groupBy(self.obs_id).count().agg(F.max("count")).first()[0] or 0)
    sampling_design = property(lambda self: {"method": self.sampling, "sample_size": self.sample_size, "n_alternatives": self.n_alternatives_full})

    def __len__(self) -> int:
        return self.df.count()

    def to_frame(self) -> DataFrame:
        return self.df

    to_dataset = to_frame

    def availability(self) -> Column:
        return F.col("available") > 0 if self.has_available else F.lit(True)

    def numeric_columns(self) -> list[str]:
        skip = {self.obs_id, self.alt_id, *RESERVED}
        return [c for c, t in self.df.dtypes if c not in skip and (t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal"))]

    def restrict(self, alternatives: list) -> ChoiceTable:
        """The observations that chose one of a strict subset of at least two alternatives, and those alternatives only."""
        known = {r[0] for r in self.universe.select(self.alt_id).collect()}
        if len(set(alternatives)) < 2 or not set(alternatives) < known:
            raise ValueError("a strict subset of at least two known alternatives")
        chose = self.df.filter((F.col("chosen") == 1) & F.col(self.alt_id).isin(alternatives)).select(self.obs_id)
        df = self.df.filter(F.col(self.alt_id).isin(alternatives)).join(chose, self.obs_id, "left_semi")
        df = df.withColumn("alt_pos", (F.row_number().over(Window.partitionBy(self.obs_id).orderBy("alt_pos")) - 1).cast("int"))
        return self._with(df, universe=S.with_positions(self.universe.filter(F.col(self.alt_id).isin(alternatives)).select(self.alt_id), self.alt_id))

    def to_arrays(self, formula: str | None = None, spec=None, **options):
        from ..plans.packing import pack

        return pack(self, formula=formula, spec=spec, **options)
