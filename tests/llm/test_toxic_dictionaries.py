"""The toxic dictionary is trained on toxic text and reduced by compressed lengths."""

import numpy as np

from larkwing.llm.toxicity import CompressionClassifier, _cost, fit, training_sample

from .test_native import docs


def test_words_that_only_toxic_texts_hold_are_found():
    r = np.random.default_rng(5)
    spell = lambda n: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    common, bad = [spell(7) for _ in range(300)], [spell(9) for _ in range(30)]
    text = lambda extra: " ".join([*r.choice(common, 30), *extra])
    toxic = [text(bad[(i + k) % 30] for k in (0, 11)) for i in range(400)]
    model = CompressionClassifier.fit(toxic, [text([]) for _ in range(800)])
    assert sum(model.score(f"{common[0]} {w} {common[1]}") >= 0.3 for w in bad) >= 27
    assert sum(model.score(text([])) >= 0.3 for _ in range(200)) <= 2
    assert model.score(text([]) * 300 + f" {bad[3]} " + text([]) * 300) >= 0.3  # a very long text
    assert model.score(None) == model.score("") == model.score("12 !") == 0


def test_cost_is_that_of_conditional_compression():
    cost = _cost(b"some words that are known")
    assert cost(b"known") < cost(b"qjxzv") and cost(b"words") < cost(b"sdrow")


def test_without_contrast_nothing_is_learnt():
    same = [f"a text of words number {i}" for i in range(60)]
    model = CompressionClassifier.fit(same, same)
    assert all(model.score(t) < 0.3 for t in same) and CompressionClassifier.fit([], same).score("x") == 0


def test_sample_with_repeated_ids(spark):
    table = docs(spark, [(1, "b"), (1, "a"), (1, "a"), (3, None), (None, "n"), (4, "d")])
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, 0), (None, 1), (4, None), (9, 1)], "doc_id long, toxic int")
    assert training_sample(table, labels) == training_sample(table.repartition(3), labels.repartition(2)) == (["a", "b"], [""])


def test_fit_leaves_the_training_to_an_executor(spark, monkeypatch):
    table = docs(spark, [(i, f"{'wuzzled grubnik' if i % 3 else 'plain words'} of row {i}") for i in range(120)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, toxic int")
    want = CompressionClassifier.fit(*training_sample(table, labels))
    monkeypatch.setattr(CompressionClassifier, "fit", classmethod(lambda *_: 1 / 0))  # the driver's
    got = fit(table.repartition(3), labels)
    assert (got.ordinary, got.toxic) == (want.ordinary, want.toxic)
    empty = fit(table.limit(0), labels)
    assert empty.score("wuzzled") == 0
