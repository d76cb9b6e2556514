"""Passages of over 50 words that documents share, against brute force."""

import random
import re
from collections import defaultdict

import duckdb
import pytest

from larkwing.llm.passages import repeated_passages
from larkwing.llm.queries import ORACLE_SQL
from larkwing.llm.queries import repeated_passages as query

from .test_native import FOLD, docs

R = random.Random(5)


def some(n):
    return [f"w{R.randrange(10_000)}" for _ in range(n)]


def brute(rows, least):
    held, runs = defaultdict(set), defaultdict(list)
    windows = [(i, t, s, " ".join(w[s : s + least])) for i, t in set(rows) for w in [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))] for s in range(len(w) - least + 1)]
    for i, _, _, window in windows:
        held[window].add((i is None, i or 0, i))
    for i, t, s, window in windows:
        if len(held[window]) > 1:
            runs[i, t, min(held[window])[2]].append(s)
    out = []
    for (i, _, keep), places in runs.items():
        for s in (s for s in places if s - 1 not in places):
            last = next(e for e in range(s, s + len(places)) if e + 1 not in places)
            out.append((i, s, last - s + least, keep, i == keep))
    return sorted(map(str, out))


P, Q = some(51), some(130)
WRAPPED = " \n\t".join(P).upper()
ROWS = [
    (3, " ".join([*some(20), *P, *some(20)])), (7, f"a line\n{WRAPPED}"), (2, " ".join(P[:50])), (4, " ".join([*P[1:], "other"])),  # 50 words of P only
    (10, " ".join(Q)), (11, " ".join(Q)), (12, " ".join([*Q[:70], "edit", *Q[71:]])), (9, " ".join([*some(5), *Q[20:100]])), (13, " ".join([*P, *Q, *P])),
    (20, "x " * 300), (21, "x " * 120 + "y " * 60), (22, " ".join([*some(60)] * 2)), (23, "Click here\nClick here"), (24, "click here"),
    (30, None), (31, ""), (None, " ".join(some(3) + P)), (None, " ".join(Q)), (40, " ".join(Q[:60])), (40, " ".join(Q[:60])), (40, " ".join(Q[40:]) + " É"), (41, "é\x1f " * 80), (42, "é\x1f " * 51),
]


@pytest.mark.parametrize("least", [51, 20, 2])
def test_passages_equal_brute_force(spark, least):
    got = repeated_passages(docs(spark, ROWS), least)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(ROWS, least)
    assert repeated_passages(docs(spark, []), least).count() == 0


def test_holders_have_rows_and_lines_have_none(spark):
    got = repeated_passages(docs(spark, ROWS)).collect()
    assert {r["doc_id"] for r in got} == {3, 7, 9, 10, 11, 12, 13, 20, 21, 40, 41, 42, None}
    assert [tuple(r)[1:] for r in got if r["doc_id"] == 7] == [(2, 51, 3, False)] and [tuple(r)[1:] for r in got if r["doc_id"] == 3] == [(20, 51, 3, True)]


def test_random_edits(spark):
    vocabulary = [["a", "b"], some(40)]
    rows = []
    for k in range(60):
        words = R.choices(vocabulary[k % 2], k=R.randrange(10, 200)) if k < 6 else R.choice(rows)[1].split()
        for _ in range(R.randrange(4)):
            words[R.randrange(len(words))] = R.choice(vocabulary[k % 2])
        rows.append((R.randrange(40), " ".join(words[R.randrange(5) :])))
    got = repeated_passages(docs(spark, rows), 9)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, 9)


def test_query_equals_its_sql(spark, tmp_path):
    docs(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = sorted(map(str, db.execute(ORACLE_SQL["repeated_passages"]).fetchall()))
    assert sorted(str(tuple(r)) for r in query(spark, str(tmp_path)).collect()) == expected == brute(ROWS, 51)
