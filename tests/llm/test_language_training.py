"""Languages are learnt by a task, from features without their zeros."""

import numpy as np
import pytest

from larkwing.llm import language_id as L


def dense(x, y, penalty=0.01, steps=120):
    """The same machine on a whole matrix."""
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    w = look = np.zeros(x.shape[1])
    momentum = 1.0
    for _ in range(steps):
        new = look - (penalty * look - 2 * ((weight * np.maximum(0, 1 - y * (x @ look)) * y) @ x)) / (2 + penalty)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return w


def test_machine_is_that_of_the_whole_matrix():
    r = np.random.default_rng(3)
    x = np.array([L.features("".join(r.choice(list("abcd efgh"[i % 3 :]), 5 + 9 * i)) + "a") for i in range(40)])
    y = np.where(np.arange(40) % 3 > 0, 1.0, -1.0)
    rows, place = np.nonzero(x)
    sparse = L._Rows(np.bincount(rows), place, x[rows, place])
    half = np.arange(40) % 2 == 0
    assert L._machine(sparse, y) == pytest.approx(dense(x, y), abs=1e-12)
    assert L._machine(sparse.take(half), y[half]) == pytest.approx(dense(x[half], y[half]), abs=1e-12)


def test_fit_leaves_the_training_to_an_executor(spark, monkeypatch):
    words = {"en": "the fox is not here", "de": "der fuchs ist nicht hier", "fr": "le renard est pas ici", "xx": "zu va ko"}
    rows = [(i, None if i == 8 else f"{words[k]} {i} {words[k][i % 5 :]}", k) for i in range(160) for k in [("en", "de", "fr", "xx")[i % 4]]]
    table = spark.createDataFrame([*rows, (None, "x y", "en"), (700, "x y", None)], "doc_id long, text string, lang string")
    drawn = sorted(tuple(r) for r in L._sample(table, per_language=20).collect())
    assert [(k, n) for k, n, _ in drawn] == [(k, n) for k in sorted(words) for n in range(1, 21)]
    want = L.LanguageModel((text, lang) for lang, _, text in drawn)
    monkeypatch.setattr(L.LanguageModel, "__init__", lambda *_: 1 / 0)  # the driver's
    got = L.fit(table.repartition(3), per_language=20)
    assert got.families.classes == ["germanic", "romance", "xx"] and (got.families.weights == want.families.weights).all()
    assert (got.languages["germanic"].weights == want.languages["germanic"].weights).all()
    assert [got.predict(t)[0] for t in (words["en"], words["fr"], words["xx"], "12", None)] == ["en", "fr", "xx", "und", "und"]
