"""Operator 13 against plain Python, with nulls, ties, repeated rows, clashing names and a very long text."""

import collections
import re

import pytest

from doctide.llm import lines
from doctide.llm.common import Scratch

from . import corpus

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def brute(rows, least_docs=5, least_chars=40):
    """(doc_id, n_lines, n_dropped, text) of each (doc_id, text)."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))
    order = lambda i: (i is not None, i or 0)
    held = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(i)
    out = []
    for i, text in rows:
        parts = (text or "").split("\n")
        goes = [len(key(x)) >= least_chars and len(held[key(x)]) >= least_docs and i != max(held[key(x)], key=order) for x in parts]
        out.append((i, len(parts), sum(goes), "\n".join(x for x, g in zip(parts, goes, strict=True) if not g)))
    return sorted(out, key=lambda r: (order(r[0]), r[1:]))


def got(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


LONG = "this line is long enough to be looked at by the operator"
ROWS = (
    [(i, f"Head {i}\n  {LONG.upper() if i % 2 else LONG}\t\r\nown line {i} which is also a rather long one\n{LONG}") for i in range(6)]
    + [(10, LONG), (10, LONG), (11, f"\n\n{LONG}\n"), (None, LONG), (None, f"{LONG}\nx"), (12, None), (13, ""), (14, "\n")]
    + [(20 + i, "É" * 40) for i in range(5)] + [(30 + i, "é" * 40) for i in range(4)]  # only A-Z are one with a-z
    + [(40 + i, "a" * 39 + " " * i) for i in range(6)] + [(50 + i, " " + "b" * 38 + " ") for i in range(6)]  # 39 and 40 code points
    + [(60 + i, "c" * 50) for i in range(4)] + [(60, "c" * 50)]  # five rows, four documents
    + [(70, "\n".join([LONG, *(f"{k} of a very long text with many lines that no other document has" for k in range(30_000)), LONG.title()]))]
)


def test_line_dedup(spark):
    df = spark.createDataFrame([(i, t, 7, "k", [1]) for i, t in ROWS], "doc_id long, text string, n_dropped int, _key string, lines array<int>").repartition(3)
    out = lines.drop_common_lines(df, Scratch(spark))
    assert set(out.columns) == {*df.columns, "n_lines"}
    assert got(out) == brute(ROWS)
    assert got(lines.drop_common_lines(df, Scratch(spark), 2, 1)) == brute(ROWS, 2, 1)


def test_line_dedup_on_the_corpus(spark):
    docs = corpus.documents(spark, extra=True)
    assert got(lines.drop_common_lines(docs, Scratch(spark), 3)) == brute([r[:2] for r in corpus.rows()], 3)


def test_empty_tables(spark):
    out = lines.drop_common_lines(corpus.empty(spark), Scratch(spark))
    assert out.count() == 0 and out.columns == [*corpus.empty(spark).columns, "n_lines", "n_dropped"]


@pytest.mark.parametrize("name", ["op13_line_dedup"])
def test_main_path_is_native(spark, name):
    plan = lines.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
