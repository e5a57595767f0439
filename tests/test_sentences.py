"""Sentence cuts of hand-made texts with elements, and the fold that reads elements."""

import duckdb

from doctide.operators import sentences as S
from doctide.plans import text as plans

OBJ = S.ELEMENT


def cuts(spark, *cases):
    """Cuts of each (text, readings)."""
    rows = [(i, t, r) for i, (t, r) in enumerate(cases)]
    found = S.sentence_cuts(spark.createDataFrame(rows, "unit int, text string, readings array<string>"), ["unit"], "text", "readings").collect()
    return [[r["cut"] for r in sorted(found, key=lambda r: r["ord"]) if r["unit"] == i] for i in range(len(cases))]


def check(spark, *cases):
    """Each case: text with | where a sentence begins, and the stand-ins of its elements."""
    want = []
    for text, _ in cases:
        parts = text.split("|")
        want.append([len("".join(parts[:k])) for k in range(1, len(parts))])
    assert cuts(spark, *((t.replace("|", ""), r) for t, r in cases)) == want


def test_cuts_and_rules(spark):
    check(
        spark,
        *((t, None) for t in (
            "First things first. |Second ones next.", "One sentence alone.", "", "He said “Go!” |She went. |(It rained.) |Then?! |No",
            "Compare Fig. 4 and Eqs. 2. |Then go on.", "As Berg et al. [7], we see.", "Berg et al. |We disagree.", "Cats, dogs, etc. |We go.", "Nevada v. Hall was read. |Next.",
            "Given in App. C we prove it. |Done.", "See Chap. IV for it. |Done.", "See Chap. |Later.", "They met in Sept. 2021. |A second time came.", "They met in autumn. |2021. |A second time came.",
            "Try Exer. 5 now. |Ok.", "Try Exer. 5) now. |Ok.", "Try Exer. |5) Now. |Ok.", "Try Exer. 5 Now. |Ok.", "Try Exer. 5.2 now. |Ok.", "The value 3.14 holds. |The U.S. Army came.", "In the U.S.A. it did.", "It ended at 5. |Ålesund slept.",
            "So it goes… and on. |Ja. |Über alles.", "A full stop.Next word stays. |Another.", "He asked: why? |Because.", "Wait... |What?", "Is it? - yes. |É bom.", "a.b.c are. |X", "Done. |Next",
        )),
    )


def test_line_ends(spark):
    check(
        spark,
        ("They list the older\nnames of both\r\nrivers.\n|A map comes next.", None),
        ("It runs like this \n|\n  With a list, count", None),
        (f"One line{OBJ}|another line", ["\n"]),
        (f"One line{OBJ}another line", [" "]),
    )


def test_elements(spark):
    c, a = S.CITATION, S.ANNOTATION
    check(
        spark,
        (f"It stands.{OBJ} |We go on.", [a]),
        (f"Let {OBJ} be one. |Then {OBJ} stands. |{OBJ} too.", ["x", "x", None]),
        (f"As told {OBJ} the claim stands. |Next.", ["[3, Ex. 2.6]"]),
        (f"So it was built. |{OBJ} shows that it fell. |Then more.", [c]),
        (f"Berg et al. {OBJ} sort the stones. |Then more.", [c]),
        (f"See e.g. {OBJ} for more. |Then more.", [c]),
        (f"It stands.{OBJ} |We go on.", [c]),
        (f"As told {OBJ}. |Then more.", [c]),
        (f"As in Ref.{OBJ}{OBJ} we see it. |Then more.", [None, c]),
        (f"Grid or mesh? {OBJ}, G = Grid.", [c]),
        (f"It stands. {OBJ} |We go on.", [c]),
        (f"A law of {OBJ}. |Then it ended.", ["v"]),
        (f"It is told. {OBJ} |{OBJ} finds.", [a, c]),
    )


def test_units_without_text(spark):
    assert cuts(spark, (None, None), ("", []), ("\n\n", None), (OBJ, ["a. B"]), ("A. B.", None)) == [[], [], [1], [], []]


def test_the_mark_in_a_text_is_a_space(spark):
    assert cuts(spark, (f"One.{S.MARK}Two. Three", None)) == [[5, 10]]


def test_a_long_unit(spark):
    text = "It is one of many. " * 20_000
    assert cuts(spark, (text, None))[0] == [19 * k for k in range(1, 20_000)]


def test_ends_of_pieces_as_in_sql(spark, tmp_path):
    """Rules want a stop at the very end; long words, other separators, and all kinds of white space after a stop."""
    texts = [
        "See Fig. Next one. And so.", "See Fig.\x0bNext one.", "Astrophys. Next. MyAstrophys. Next. xAstrophys. 4 Next.", "Astrophys. Lett. 4.", "A_Fig. Next.", "Fig. 4.\xa0Next.　Then.", "Nevada v. Hall. Xv. Hall. A v.\tB.",
        "In Sept. 2021. In xSept. 2021. Then.", "Chaps. IV. xChaps. IV. Nos. 4", "Label. 5 Labels. 5 Labelss. 5 is.", "etc. we etc. We. al. (x", "a\tb.\tC\fd.\fE", "tail.\x85Next. v.", "￼.￼ A. ￿ B.",
    ]
    spark.createDataFrame([(k, t, "xx", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(plans.ORACLE["sentence_cuts"]).fetchall()
    assert sorted(map(tuple, plans.sentence_cuts(spark, str(tmp_path)).collect())) == sorted(want)
