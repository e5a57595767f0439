"""Hyphens, snapped cuts and runs on hand-made cases."""

from doctide.operators.hyphens import break_points
from doctide.plans import pieces


def test_break_points_take_the_highest_vote(spark):
    patterns = spark.createDataFrame([("1na",), ("n2at",), ("1tion",), (".o1",), ("1s.",)], "pattern string")
    words = spark.createDataFrame([("nation",), ("banana",), ("onations",), ("nation",), ("as",), (None,), ("",), ("table",)], "word string")
    known = spark.createDataFrame([("ta-b-le",), ("tab-le",)], "spelled string").limit(1)
    got = dict(map(tuple, break_points(words, patterns, 2, 3, known).collect()))
    assert got == {"nation": "2", "banana": "2", "onations": "3", "as": "", "": "", "table": "2,3"}
    got = dict(map(tuple, break_points(words, patterns, 1, 1).collect()))
    assert got["onations"] == "1,3,7" and got["banana"] == "2,4"
    none = break_points(words, patterns.where("false"))
    assert {r["breaks"] for r in none.collect()} == {""}


def test_cuts_snap_to_ends_all_or_nothing(spark, tmp_path):
    a = "x" * 57 + ". " + "Y" * 70  # ends one character before the cut
    b = "x" * 56 + ". Y. " + "Z" * 20  # an end at the cut itself
    c = "x" * 57 + ". y" + "Z" * 20  # goes on in lower case
    d = a[:110] + "  " + "z" * 3 + ". " + "Q" * 30
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([a, b, c, d])] + [(9, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in pieces.snap_cuts(spark, str(tmp_path)).collect()}
    assert {k: (r["ok"], r["at_"].split(",")[0]) for k, r in got.items()} == {0: (True, "59"), 1: (True, "60"), 2: (True, "60"), 3: (True, "59")}
    assert got[3]["at_"] == "59,117"


def test_sentences_found_once_longest_first(spark, tmp_path):
    turns = [(1, 0, "u", "one two three. one two\nfour one two three five"), (1, 1, "a", "one two three five. two three five. four. one. Nine"), (1, 2, "u", None), (2, 0, "u", "alone")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, pieces.run_match(spark, str(tmp_path)).collect()))
    assert got == [(1, 1, 2, len(" one  two  three  five  four "))]
