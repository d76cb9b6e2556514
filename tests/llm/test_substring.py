"""Line hashing against brute force."""

from larkwing.llm.substring_dedup import remove_repeated_lines, repeated_lines, units

from .test_native import docs

LINE = "One two three four five six seven eight nine ten"


def brute(rows, least=10):
    seen = {}
    for i, t in rows:
        for _, start, length, digest in units(t, least):
            seen.setdefault(digest, []).append((i is None, i, start, length))
    return sorted(str((i, s, n, min(v)[1], min(v)[2], len(v))) for v in seen.values() for _, i, s, n in v if (i, s) != (min(v)[1], min(v)[2]))


def test_repeated_lines(spark):
    rows = [(5, f"é first\n{LINE}\nend"), (3, f"{LINE.upper()}\n{LINE}  \n\n"), (9, None), (8, ""), (7, f"short line\n \t {LINE.replace(' ', '  ')}"), (6, "short line"), (None, LINE), (4, "x " * 200_000 + "\n" + LINE)]
    got = repeated_lines(docs(spark, rows), salts=3).collect()
    assert sorted(str((r["doc_id"], r["start"], r["length"], r["keep_doc_id"], r["keep_start"], r["occurrences"])) for r in got) == brute(rows)
    assert repeated_lines(docs(spark, [])).count() == 0
    hot = repeated_lines(docs(spark, [(i, LINE) for i in range(400)]))
    assert hot.count() == 399 and hot.filter("keep_doc_id <> 0").count() == 0


def test_removal_keeps_the_rest_and_offsets(spark):
    out = {r["doc_id"]: r for r in remove_repeated_lines(docs(spark, [(1, LINE + "\na"), (2, "b\n" + LINE + "\nc"), (3, None)])).collect()}
    assert out[1]["text"] == LINE + "\na" and out[2]["text"] == "b\nc" and out[3]["text"] is None
    assert [tuple(s) for s in out[2]["removed"]] == [(2, len(LINE))] and out[1]["removed"] is None
