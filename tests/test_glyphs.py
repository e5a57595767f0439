"""Accents by overlap, and cells with spans against a plain loop."""

import random

from doctide.operators.glyphs import joined_accents, placed_cells
from doctide.plans import pieces


def read(spark, lines):
    """Text of each line of glyphs (u, x0, x1, y, font)."""
    rows = [(k, i, u, font, 10.0, x0, x1, y, y + 7.0) for k, line in enumerate(lines) for i, (u, x0, x1, y, font) in enumerate(line)]
    out = joined_accents(spark.createDataFrame(rows, "line int, ord int, u string, font string, size double, x0 double, x1 double, y double, top double"), ["line"]).orderBy("line", "ord").collect()
    return ["".join(r["text"] for r in out if r["line"] == k) for k in range(len(lines))]


def test_accents_by_overlap(spark):
    g = lambda u, x0, x1, y=0.0, font="f": (u, x0, x1, y, font)
    lines = [
        [g("F", 0.0, 6.0), g("´", 6.0, 9.0), g("ı", 6.0, 9.0), g("s", 9.0, 13.0)],  # the accent before a dotless letter
        [g("d", 0.0, 5.0), g("e", 5.0, 10.0), g("`", 6.0, 9.0), g("s", 10.0, 14.0)],  # after its letter
        [g("P", 0.0, 6.0), g("´", 7.0, 10.0, 7.0), g("E", 6.0, 11.0)],  # raised over a capital
        [g("a", 0.0, 5.0), g("^", 5.0, 10.0), g("b", 10.0, 15.0)],  # a sign of its own stays apart
        [g("´", 0.0, 3.0, 0.0, "other"), g("e", 0.0, 5.0)],  # another font
        [g("´", 0.0, 3.0, 9.0), g("e", 0.0, 5.0)],  # too high
        [g("´", 0.0, 3.0, -2.0), g("e", 0.0, 5.0)],  # too low
        [g("´", 1.0, 4.0), g("e", 0.0, 5.0), g("`", 1.0, 4.0), g("o", 5.0, 9.0)],  # a letter takes one accent
        [g("¸", 1.0, 4.0), g("c", 0.0, 5.0), g("¨", 1.0, 4.0), g("q", 0.0, 5.0)],  # no such letter
        [g("´", 1.0, 4.0), g("´", 1.0, 4.0)], [g("¨", 1.0, 2.0)],
    ]
    assert read(spark, lines) == ["Fís", "dès", "PÉ", "a^b", "´e", "´e", "´e", "é`o", "ç¨q", "´´", "¨"]


def plain(cells):
    """Place of each (row, ord, rowspan, colspan)."""
    held, out = {}, {}
    at = (None, 0)
    for row, ord_, down, wide in sorted(cells):
        col = at[1] if at[0] == row else 0
        while held.get(col, 0) > row:
            col += 1
        for k in range(col, col + max(wide, 1)):
            held[k] = max(held.get(k, 0), row + max(down, 1))
        at = (row, col + max(wide, 1))
        out[row, ord_] = col
    return out


def test_spans_on_a_grid(spark):
    r = random.Random(4)
    tables = [[(0, 0, 2, 1), (0, 1, 1, 2), (1, 0, 1, 1), (1, 1, 2, 1), (2, 0, 0, -1), (2, 1, 1, 1)]]
    tables += [[(row, o, r.randint(1, 3), r.randint(1, 3)) for row in range(r.randint(1, 6)) for o in range(r.randint(0, 4))] for _ in range(40)]
    rows = [(t, *c) for t, cells in enumerate(tables) for c in cells]
    got = placed_cells(spark.createDataFrame(rows, "t int, row int, ord int, rowspan int, colspan int"), "t").collect()
    assert len(got) == len(rows)
    for t, cells in enumerate(tables):
        assert {(x["row"], x["ord"]): x["col"] for x in got if x["t"] == t} == plain(cells)
    assert plain(tables[0]) == {(0, 0): 0, (0, 1): 1, (1, 0): 1, (1, 1): 2, (2, 0): 0, (2, 1): 1}


def test_lines_are_read_where_they_are(spark, tmp_path):
    """Lines of repeated documents, signs of two code units, accents alone, in rows and at the ends; and nothing is dealt by glyph."""
    texts = ["élan\n\nÉté à Ångström, ça", "élan\n\nÉté à Ångström, ça", "´é`è^~ a`", "e´ é´ ´é ´´é", "\U0001d49cé\U0001f600´e", "ìíîïȷ̌ǰ ıi", None, "", "é" * 3_000, "x" * 500 + "ü" + "y" * 500 + "`", "й Ё ΐ ế ệ", "aéb\tcd\rée"]
    spark.createDataFrame([(k % 9, t, "xx", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = pieces.join_accents(spark, str(tmp_path))
    want = sorted((k % 9, pos, line) for k, t in enumerate(texts) if t for pos, line in enumerate(t.split("\n")) if line)
    got = sorted(map(tuple, found.collect()))
    alone = {"´é`è^~ a`", "e´ é´ ´é ´´é", "\U0001d49cé\U0001f600´e"}
    assert [g for g in got if g[2] not in alone] == [w for w in want if w[2] not in alone] and len(got) == len(want)
    assert got == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
