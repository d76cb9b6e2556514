"""The stages that drop rows, where ids are null or repeat."""

from larkwing.llm.decontaminate import drop_contaminated
from larkwing.llm.exact_dedup import drop_copies
from larkwing.llm.jaccard_join import drop_near_copies
from larkwing.llm.substring_dedup import remove_repeated_lines

from .test_native import docs

A, B, C = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")


def left(df):
    return sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())


def pairs(*rows):
    return sorted((str(i), t) for i, t in rows)


def test_drop_copies(spark):
    table = docs(spark, [(None, "alone"), (None, "Twice"), (4, "twice"), (1, "one"), (1, "other"), (2, "ONE"), (7, None)])
    out = drop_copies(table)
    assert left(out) == pairs((None, "alone"), (4, "twice"), (1, "other"), (2, "ONE"), (7, "")) and out.columns == table.columns


def test_drop_near_copies(spark):
    table = docs(spark, [(None, A), (None, B), (3, B + " tail"), (5, C), (5, "free " + A[::-1]), (4, C + " tail"), (None, C + " end")])
    out = drop_near_copies(table)
    assert left(out) == pairs((None, A), (3, B + " tail"), (5, "free " + A[::-1]), (4, C + " tail")) and out.columns == table.columns
    assert drop_near_copies(docs(spark, [(None, A), (None, A + " x"), (None, B)])).count() == 2


def test_drop_contaminated(spark):
    bench = spark.createDataFrame([("i", " ".join(B.split()[:20]))], "item_id string, text string")
    table = docs(spark, [(None, B), (None, A), (5, "x " + B), (5, A), (6, None), (None, None)])
    out = drop_contaminated(table, bench)
    assert left(out) == pairs((None, A), (5, A), (6, ""), (None, "")) and out.columns == table.columns


def test_repeated_rows(spark):
    table = docs(spark, [(1, "a"), (1, "A"), (1, "a"), (None, A), (None, A), (None, "n"), (None, "n")])
    out = drop_copies(table)
    assert sorted(t.lower() for _, t in left(out)) == sorted(["a", A, "n"]) and left(out) == left(drop_copies(table.repartition(5)))
    near = drop_near_copies(docs(spark, [(1, A), (1, A), (2, A + " x"), (None, B), (None, B)]))
    assert left(near) == pairs((1, A), (None, B))


def test_remove_repeated_lines(spark):
    table = docs(spark, [(1, "x\nown"), (1, "other"), (None, "x\nfree"), (None, "y"), (2, "y\nown"), (3, None)])
    got = sorted((str(r["doc_id"]), r["text"] or "", tuple(map(tuple, r["removed"] or ()))) for r in remove_repeated_lines(table, 1).collect())
    assert got == sorted([("1", "x\nown", ()), ("1", "other", ()), ("None", "free", ((0, 1),)), ("None", "", ((0, 1),)), ("2", "y", ((2, 3),)), ("3", "", ())])
