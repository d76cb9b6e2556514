"""Exact dedup, license scan, entropy mixing: DataFrame operators against brute force, with odd inputs."""

import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from larkwing.llm.exact_dedup import drop_copies, exact_dedup, sha256
from larkwing.llm.license_scan import BASE, TEMPLATES, WORD_BREAK, license_scan
from larkwing.llm.mixing import EntropyMixer, mix_sources, water_fill

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, n long, digest string"


def docs(spark, rows):
    """Rows of (doc_id, text[, source]), with columns whose names clash with inner ones."""
    return spark.createDataFrame([(r[0], r[1], None, r[2] if len(r) > 2 else None, 0, 7, 7, "x") for r in rows], SCHEMA)


ROWS = [(1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 300_000), (9, "X" * 300_000), (10, "other"), (10, "Other"), (None, "other")]


@pytest.mark.parametrize("digest", [sha256, lambda t: F.substring(F.md5(t), 1, 1), lambda t: F.lit("one")])
def test_exact_dedup(spark, digest):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[(t or "").translate(FOLD)].append(i)
    want = sorted(str((i, max(x for x in v if x is not None), len(v), i == max(x for x in v if x is not None), hashlib.sha256(t.encode()).hexdigest())) for t, v in groups.items() for i in v)
    got = exact_dedup(docs(spark, ROWS), digest=digest, salts=3).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_exact_dedup_of_one_large_group_and_of_nothing(spark):
    r = exact_dedup(docs(spark, [(i, "copy") for i in range(500)])).agg(F.sum(F.col("kept").cast("int")), F.min("keep_id"), F.max("group_size")).first()
    assert tuple(r) == (1, 499, 500)
    assert exact_dedup(docs(spark, [])).count() == 0
    kept = drop_copies(docs(spark, ROWS[:5]))
    assert kept.columns == docs(spark, []).columns and {x["doc_id"] for x in kept.collect()} == {3, 5}


def brute_license(text, templates=TEMPLATES):
    ws = [w for w in re.split(WORD_BREAK, (text or "").translate(FOLD)) if w]
    places = [(i, label) for i in range(len(ws)) for phrase, label in BASE.items() if ws[i : i + len(phrase.split())] == phrase.split()]
    labels = {label for _, label in places}
    for label, t in templates:
        step = 32
        while len(t.split()) > step + 1:
            step *= 2
        if any(len(set(t.split()) & set(ws[b : b + 2 * step])) >= 0.85 * len(set(t.split())) - 1e-9 for b in range(0, len(ws), step)):
            labels.add(label)
    return len(ws), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({label for _, label in places})), ",".join(sorted(labels))


def test_license_scan(spark):
    filler = "wort " * 29
    texts = [None, "", "!!", "Released under the\nMIT   License.", filler + "under the mit license", filler * 40 + "Under-the-MIT-license cc by nc CC BY-NC apache license, version 2", "under the mit licence", "mit mit mit license the under", "Permission is granted free of charge, to any person obtaining a copy of this software and associated documentation files", "this work is licensed under the gnu general public license version 3", "under the mit license " * 500]
    got = {r["doc_id"]: tuple(r)[1:7] for r in license_scan(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: brute_license(t) for i, t in enumerate(texts)}
    assert got[10][1] == 500 and license_scan(docs(spark, [])).count() == 0


def test_whole_license_texts(spark):
    long = [("long", " ".join(f"w{i}" for i in range(700))), ("mid", " ".join(f"m{i}" for i in range(34)))]
    mit = max((t for label, t in TEMPLATES if label == "mit"), key=len)
    changed = " ".join("other" if i % 9 == 4 else w for i, w in enumerate(long[0][1].split()))
    texts = [f"{k * 'x '}{t}{k * ' y'}" for k in (0, 31, 700, 5000) for t in (mit, long[0][1], long[1][1], changed, long[0][1][:1500])]
    got = {r["doc_id"]: tuple(r)[1:7] for r in license_scan(docs(spark, list(enumerate(texts))), templates=TEMPLATES + long).collect()}
    assert got == {i: brute_license(t, TEMPLATES + long) for i, t in enumerate(texts)}
    assert [got[i][5] for i in range(5)] == ["mit", "long", "mid", "long", ""]


def test_water_fill():
    assert water_fill({"b": 10, "a": 10, None: 10}) == pytest.approx({"a": 18.75, "b": 7.5, None: 3.75})
    t = water_fill({"a": 1, "b": 100, "c": 100})
    assert t["a"] == 3 and sum(t.values()) == pytest.approx(201) and t["b"] / t["c"] == pytest.approx(2)
    assert water_fill({}) == {} and water_fill({"a": 0}) == {"a": 0}


def brute_rates(rows):
    """Rates by bisection of each source's dual."""
    sizes = defaultdict(list)
    for i, t, s in rows:
        sizes[s].append((i, len((t or "").split())))
    target, out = water_fill({s: sum(n for _, n in v) for s, v in sizes.items()}), {}
    for s, v in sizes.items():
        total = sum(n for _, n in v)
        rate = lambda lam, n: 1.0 if n == 0 else min(3.0, math.exp(min(50, lam * n * len(v) / total)))  # noqa: B023, E731
        low, high = -50.0, 50.0
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * rate(mid, n) for _, n in v) < target[s] else (low, mid)
        out |= {(i, n): 3.0 if n and target[s] >= 3 * total else rate(high, n) for i, n in v}
    return out


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * (1 + (i * 7919) % 97), ("a", "b", "c", None)[i % 4] if i % 3 else "a") for i in range(1200)] + [(5000, None, "b"), (5001, "", "z"), (None, "v v", "a")]
    m = EntropyMixer(docs(spark, rows))
    out = m.mixture().cache()
    source = {r[0]: r[2] for r in rows}
    taken, target = defaultdict(int), {}
    for r in out.collect():
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    assert target == pytest.approx(water_fill(sizes))
    assert all(abs(taken[s] - target[s]) <= 2 + 0.003 * target[s] for s in target)
    for parts in (1, 7, 40):
        again = EntropyMixer(docs(spark, rows).repartition(parts)).mixture()
        assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    brute = brute_rates(rows)
    assert all(abs(r["rate"] - brute[r["doc_id"], r["size"]]) <= 1e-4 for r in out.collect())
    assert all(abs(r["copies"] - r["rate"]) < 1 or r["copies"] == int(r["rate"]) + 1 for r in out.collect())
    assert mix_sources(docs(spark, [])).count() == 0
