"""Packed choice tables: one row for each observation, with its rows as arrays, for kernels that run over Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spec import Design, design_of


@dataclass
class ChoiceArrays:
    """df: (obs, person, w, chosen, av, lnpi, x, alt): chosen is a place in the arrays or -1, x is row-major (alternative,
    variable). Rows of one person are in one partition, next to each other."""

    df: DataFrame
    design: Design
    n_alts: int
    alt_type: str
    obs_type: str

    names = property(lambda self: self.design.names)
    n_params = property(lambda self: len(self.design.columns))

    def to_numpy(self) -> dict[str, np.ndarray]:
        """The whole table on the driver, for small data."""
        b = Block.read(self.df.orderBy("obs").toArrow(), self.n_params)
        return {"design_matrix": b.x.reshape(-1, self.n_params), "chosen": (np.arange(b.av.shape[1]) == b.chosen[:, None]).astype(int), "available": b.av, "inclusion_probs": np.exp(b.lnpi), "weights": b.w, "alt_ids": b.alt, "obs_ids": b.obs}


def pack(table, formula: str | None = None, spec=None, weights: str | None = None, available: str | None = None, person: str | None = None, partitions: int | None = None) -> ChoiceArrays:
    design = design_of(table, formula, spec)
    av = F.col(available) > 0 if available else table.availability()
    if available and table.has_available:
        av = av & (F.col("available") > 0)
    w = F.col(weights).cast("double") if weights else F.col("obs_weight") if table.has_weights else F.lit(1.0)
    row = F.struct(
        F.col("alt_pos"), F.col(table.alt_id).alias("alt"), (F.col("chosen") if table.has_chosen else F.lit(0)).alias("y"), F.coalesce(av, F.lit(False)).alias("av"),
        F.log(F.greatest(F.col("pi"), F.lit(1e-300))).alias("lnpi"), F.array(*(F.coalesce(c, F.lit(0.0)) for c in design.columns.values())).alias("x"),
    )
    who = F.col(person) if person else F.col(table.obs_id)
    packed = table.df.groupBy(F.col(table.obs_id).alias("obs")).agg(F.sort_array(F.collect_list(row)).alias("r"), F.first(who).alias("person"), F.first(w).alias("w"))
    out = packed.select(
        "obs", "person", "w", (F.array_position(F.transform("r", lambda r: r["y"]), F.lit(1)) - 1).cast("int").alias("chosen"), F.transform("r", lambda r: r["av"]).alias("av"),
        F.transform("r", lambda r: r["lnpi"]).alias("lnpi"), F.flatten(F.transform("r", lambda r: r["x"])).alias("x"), F.transform("r", lambda r: r["alt"]).alias("alt"),
    )
    if person:
        out = out.repartition(*([partitions] if partitions else []), "person").sortWithinPartitions("person", "obs")
    kinds = dict(table.df.dtypes)
    n = table.sample_size or table.n_alternatives_full or table.n_alternatives
    return ChoiceArrays(out, design, n, kinds[table.alt_id], kinds[table.obs_id])


@dataclass
class Block:
    """Some observations as numpy arrays, padded to the longest choice set with unavailable rows."""

    obs: np.ndarray
    person: np.ndarray
    w: np.ndarray
    chosen: np.ndarray
    av: np.ndarray
    lnpi: np.ndarray
    x: np.ndarray
    alt: list
    size: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch | pa.Table, k: int) -> Block:
        get = lambda c: batch.column(c).combine_chunks() if isinstance(batch.column(c), pa.ChunkedArray) else batch.column(c)
        av = get("av")
        size = np.diff(av.offsets.to_numpy())
        n, j = len(size), int(size.max(initial=0))
        flat = lambda c: get(c).flatten().to_numpy(zero_copy_only=False)
        if (size == j).all():
            shape = lambda v, *s: v.reshape(n, j, *s)
        else:
            inside = np.arange(j) < size[:, None]

            def shape(v, *s):
                out = np.zeros((n, j, *s), v.dtype)
                out[inside] = v.reshape(-1, *s)
                return out

        person = np.array(get("person").to_pylist(), dtype=object)
        return cls(np.array(get("obs").to_pylist(), dtype=object), person, get("w").to_numpy(zero_copy_only=False), get("chosen").to_numpy(zero_copy_only=False).astype(int), shape(flat("av").astype(bool)), shape(flat("lnpi").astype(float)), shape(flat("x").astype(float), k), get("alt").to_pylist(), size)
