"""Registered queries read the whole of their tables."""

import os

import numpy as np
import pytest

from larkwing import queries
from larkwing.queries import _open_alternatives, euclidean_matrix, flagship_table

DATA = "/root/testdata"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_estimation_has_every_available_alternative_and_customer(spark, sf):
    t, whole = _open_alternatives(spark, f"{DATA}/{sf}"), flagship_table(spark, f"{DATA}/{sf}")
    ids = lambda df, c: {r[0] for r in df.select(c).distinct().collect()}
    assert ids(t.df, "n_nationkey") == ids(whole.df.filter("available > 0"), "n_nationkey")
    assert ids(t.df, "c_custkey") == ids(whole.df, "c_custkey")


def test_euclidean_matrix_has_every_pair(spark, tmp_path):
    r = np.random.default_rng(3)
    v = r.normal(size=(30, 8)).astype(np.float32)
    rows = [(i, v[i].tolist(), None if i == 7 else i % 4) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(x["origin_id"], x["destination_id"]): x["distance"] for x in euclidean_matrix(spark, str(tmp_path)).collect()}
    w = v.astype(float)
    assert len(got) == 900 and all(abs(got[i, j] - np.sqrt(((w[i] - w[j]) ** 2).sum())) < 1e-4 for i in range(30) for j in range(30))


def test_mixed_fit_has_the_defaults_of_the_model(monkeypatch):
    seen = {}
    monkeypatch.setattr(queries, "_open_alternatives", lambda spark, d: None)
    monkeypatch.setattr(queries, "ChoiceModel", lambda *a, **k: seen.update(k))
    monkeypatch.setattr(queries, "_tidy", lambda spark, model: None)
    queries.fit_mixed(None, "")
    assert not {"n_draws", "solver_options"} & set(seen) and seen["random_params"]
