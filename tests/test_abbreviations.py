"""Abbreviations against the SQL on odd documents."""

import duckdb

from doctide.plans import text as plans

TEXTS = [
    "The exam. was an examination of exam and example.", "prof. Pro professor\n profe. profess profes", "abc. abc abcd. ab. abcde", "tre.  tree. tree\ttrees tre. treetop\r treetops", "no long word. x. it.",
    "Änd. Änderung ände. änderung\n\nä.b. Ärz. Ärzte", "\U0001d4d0\U0001d4d1. \U0001d4d0\U0001d4d1\U0001d4d2", None, "", "sec. second", "sec. sector\nsect.", "sec. second", "null. nullable",
]


def test_abbreviations_of_odd_documents(spark, tmp_path):
    """Stems that are words, letters of two code units, other white space, repeated documents, shared and missing ids; texts stay where they are."""
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9, None]
    rows = [(k, t, "xx", "s", 0) for k, t in zip(ids, TEXTS, strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = plans.expand_abbrev(spark, str(tmp_path))
    got, want = sorted(map(tuple, found.collect())), sorted(con.execute(plans.ORACLE["expand_abbrev"]).fetchall())
    assert {r[0] for r in got} >= {0, 1, 2, 3, 5, 6, 9}
    assert got == want
