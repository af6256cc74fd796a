import re

import duckdb
import pytest

from quillshard.llm.quality_rules import OP7_SQL, clean_documents, keep_clean, op7_line_rules
from tests.conftest import plan_of
from tests.llm.helpers import documents, folder_of, odd_rows, prose
from tests.oracle_check import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeat(text):
    w = WORD.findall(text or "")
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    return len({p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)})


def test_equals_sql_on_odd_rows(spark, folder):
    rows = odd_rows(1) + [(200, "a b a b a b a b c", "en", "s", 1), (201, "l one.\nl one.\n\n \nl one.", "en", "s", 1)]
    sf = folder_of(documents(spark, rows), folder)
    got = op7_line_rules(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    want = con.execute(OP7_SQL)
    columns = [d[0] for d in want.description]
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


def test_repeat_words_against_brute_force(spark):
    texts = ["a b c a b c", "a a a a", "a b", "", None, "x y z q x y z w x y", "a b a b a b", "é ü é ü é ü é"]
    df = documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["n_repeat_words"] for r in clean_documents(df).collect()}
    assert got == {i: brute_repeat(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("line,kept", [
    ("a plain sentence ends here.", True), ('she said "yes."', True), ("no mark at the end", False),
    ("home | news | sport | help.", False), ("loud!! words!! again!!", False), ("", True),
    ("This is licensed under some terms.", False), ("a b c d e f g h i j k l m #1.", True),
])
def test_line_rules(spark, line, kept):
    row = clean_documents(documents(spark, [(1, f"Good one.\n{line}", None, None, None)])).first()
    assert row["clean_text"] == (f"Good one.\n{line}" if kept else "Good one.")


def test_documents_that_lose_too_much_go(spark):
    import random

    good = prose(random.Random(3), 70)
    bad = " | ".join(["menu"] * 40)
    docs = documents(spark, [(1, good, "en", "s", 1), (2, f"{good}\n{bad}\n{bad}", "en", "s", 1), (3, f"{good}\nskip", "en", "s", 1)])
    kept = {r["doc_id"]: r for r in keep_clean(docs).collect()}
    assert set(kept) == {1, 3}
    assert kept[3]["text"] == good and kept[3]["n_chars"] == len(good)
    assert keep_clean(docs).columns == docs.columns


def test_no_python_and_no_shuffle(spark):
    plan = plan_of(clean_documents(documents(spark, [(1, "a", None, None, None)])))
    assert "Python" not in plan and "Exchange" not in plan


def test_clashing_columns_and_empty(spark):
    df = documents(spark, []).selectExpr("*", "1 AS kept", "2 AS n_words", "3 AS extra")
    out = clean_documents(df)
    assert out.count() == 0 and "extra" in out.columns and len(set(out.columns)) == len(out.columns)
