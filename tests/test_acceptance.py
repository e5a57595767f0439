"""The acceptance rule on hand-made replies, one for each clause."""

from doctide.operators.acceptance import refused


def rows(key, pieces, within=(), at=None):
    """(key..., pos, t, id, within, must, s) of nested pieces: a text, an ("el", id), or a ("span", id, must, [pieces])."""
    at = at if at is not None else [0]
    out = []
    for p in pieces:
        at[0] += 1
        if isinstance(p, str):
            out.append((*key, at[0], "text", None, list(within), False, p))
        elif p[0] == "el":
            out.append((*key, at[0], "el", p[1], list(within), False, None))
        else:
            out.append((*key, at[0], "span", p[1], list(within), p[2], None))
            out += rows(key, p[3], (*within, p[1]), at)
    return out


el = lambda i: ("el", i)
span = lambda i, *p, must=False: ("span", i, must, list(p))
LINK = span("l", "Ref", must=True)
UNIT = ["We set ", el("m"), " and ", span("s", "the grid ", el("n")), " as in ", LINK, el("c"), "."]
LONG = ["word " * 60, el("e")]
CASES = [
    (0, UNIT, None), (0, ["Wir ", el("m"), span("s", "Gitter", el("n")), LINK, el("c")], None), (0, [el("c"), LINK, el("n"), " x ", el("m")], None),
    (0, ["x", el("m"), el("m"), el("n"), LINK, el("c")], "elements"), (0, ["x", el("n"), LINK, el("c")], "elements"), (0, ["x", el("m"), el("zz"), el("n"), LINK, el("c")], "foreign"),
    (0, ["x", el("m"), el("n"), el("c")], "spans"), (0, ["x", el("m"), el("n"), span("l"), el("c")], "spans"), (0, ["x", el("m"), el("n"), span("l", " "), el("c")], "spans"), (0, ["x", el("m"), el("n"), LINK, LINK, el("c")], "spans"),
    (0, ["x", span("s", el("m"), el("n")), LINK, el("c")], "spans"), (0, ["x", span("l", span("s", "y")), el("m"), el("n"), el("c")], "spans"), (0, ["x\x07", el("m")], "foreign"), (0, ["x", el("m"), "​"], "foreign"),
    (0, ["￼", el("m")], "foreign"), (0, [span("s", "x", el("m")), "​"], "spans"), (0, [span("q", "x")], "foreign"), (0, ["x\ty\n", el("m"), el("n"), LINK, el("c")], None),
    (1, [el("e")], "empty"), (1, [el("e"), " — "], "empty"), (1, [el("e"), "2"], "short"), (1, ["x" * 59, " ", el("e")], None), (1, ["x" * 58, "   ", el("e")], "short"), (1, [""], "elements"), (2, ["…"], None), (2, [""], None), (3, ["2"], None),
]


def test_each_clause(spark):
    units = [UNIT, LONG, ["12 + …"], ["two"]]
    piece = "pos int, t string, id string, within array<string>, must boolean, s string"
    u = spark.createDataFrame([r for k, pieces in enumerate(units) for r in rows((k,), pieces)], f"unit int, {piece}")
    r = spark.createDataFrame([r for k, (unit, pieces, _) in enumerate(CASES) for r in rows((k, unit), pieces)], f"reply int, unit int, {piece}")
    got = {x["reply"]: x["why"] for x in refused(u, r.drop("must")).collect()}
    assert [got[k] for k in range(len(CASES))] == [why for *_, why in CASES]
