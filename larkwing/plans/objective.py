"""Log likelihoods over packed tables: each call is one Spark job over cached partitions that returns sums, a row a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel

from .kernels import Structure, mixed_derivatives, mnl_derivatives, scores
from .packing import Block, ChoiceArrays


def blocks(parts: Iterator[pa.RecordBatch], k: int, panel: bool) -> Iterator[Block]:
    """Arrow batches as blocks. In panels, the last person of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        if part.num_rows == 0:
            continue
        if not panel:
            yield Block.read(part, k)
            continue
        persons = part.column("person").to_pylist()
        cut = len(persons)
        while cut and persons[cut - 1] == persons[-1]:
            cut -= 1
        if cut:
            yield Block.read(pa.Table.from_batches([*held, part.slice(0, cut)]).combine_chunks().to_batches()[0], k)
            held = []
        held.append(part.slice(cut))
    if held:
        yield Block.read(pa.Table.from_batches(held).combine_chunks().to_batches()[0], k)


class Objective:
    """Raw-scale log likelihood of a structure. Signs are those of the log likelihood; solvers minimise its negative."""

    def __init__(self, arrays: ChoiceArrays, structure: Structure):
        self.arrays, self.structure, self.jobs = arrays, structure, 0
        self.plain = not (structure.random or structure.nests or structure.graph is not None)
        df = arrays.df
        if structure.random and not structure.panel:  # small rows that make much work: a number of tasks given by hand
            df = df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism), "obs")
        # spills to disk rather than failing; lost partitions are recomputed from the packed plan
        self.data = df.persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        self.data.unpersist()

    def evaluate(self, thetas: list[np.ndarray], gradient: bool = False, meat: bool = False, hessian: bool = False, cluster: bool = False) -> list[dict]:
        structure, k, panel = self.structure, self.arrays.n_params, self.structure.panel
        thetas = [np.asarray(t, float) for t in thetas]
        sizes = [1, len(thetas[0]) if gradient else 0, len(thetas[0]) ** 2 if meat or hessian else 0]
        plain = self.plain

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(thetas), sum(sizes)))
            for block in blocks(parts, k, panel):
                structure.check(block)
                for i, theta in enumerate(thetas):
                    if plain and hessian:
                        ll, g, h = mnl_derivatives(structure, block, theta)
                        total[i] += np.concatenate([[ll], g if gradient else [], h.ravel()])
                        continue
                    if direct := mixed_derivatives(structure, block, theta):
                        (ll, s), w = direct, block.w
                    else:
                        ll, w = structure.contributions(block, structure.natural(theta))
                        s = scores(structure, block, theta) if gradient else None
                    values = [[float((w * ll.real).sum())]]
                    if gradient:
                        s = s * w[:, None]
                        values.append(s.sum(axis=0))
                        if meat:
                            values.append((s.T @ s).ravel())
                    total[i] += np.concatenate(values)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        self.jobs += 1
        found = [np.frombuffer(r["sums"]).reshape(len(thetas), -1) for r in self.data.mapInArrow(run, "sums binary").collect()]
        total = np.sum(found, axis=0) if found else np.zeros((len(thetas), sum(sizes)))
        out, n = [], len(thetas[0])
        for row in total:
            ll, g, m = np.split(row, np.cumsum(sizes)[:-1])
            out.append({"ll": float(ll[0]), "gradient": g, "matrix": m.reshape(n, n) if len(m) else None})
        return out

    def value_gradient(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        r = self.evaluate([theta], gradient=True, hessian=self.plain)[0]
        return r["ll"], r["gradient"]

    def hessian(self, theta: np.ndarray) -> np.ndarray:
        if self.plain:
            return self.evaluate([theta], gradient=True, hessian=True)[0]["matrix"]
        h = 1e-5 * np.maximum(1, np.abs(theta))
        steps = [theta + s * h[i] * np.eye(len(theta))[i] for i in range(len(theta)) for s in (1, -1)]
        g = [r["gradient"] for r in self.evaluate(steps, gradient=True)]
        out = np.array([(g[2 * i] - g[2 * i + 1]) / (2 * h[i]) for i in range(len(theta))])
        return (out + out.T) / 2
