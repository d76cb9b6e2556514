"""op2_substring_dedup takes lines of any length."""

from larkwing.llm.queries import op2_substring_dedup

from .test_native import docs
from .test_substring import LINE, brute


def test_query_takes_short_lines(spark, tmp_path):
    rows = [(1, f"Click here\n{LINE}\nok"), (2, f"a b c\n  click  HERE \n\n{LINE}"), (3, "OK\nonce only"), (4, "click here\nclick here"), (5, None), (6, "\n \n")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op2_substring_dedup(spark, str(tmp_path)).collect()
    found = sorted(str((r["doc_id"], r["start"], r["length"], r["keep_doc_id"], r["keep_start"], r["occurrences"])) for r in got)
    assert found == brute(rows, 1) and len(found) == 5
