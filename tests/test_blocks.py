"""Blocks against a plain walk of the tree, on hand-made and on random pages."""

import random
import re

from doctide.operators.blocks import Rule, extracted
from doctide.sources.html import Nodes, html_nodes

RULES = [
    Rule("script", "skip", tag="script"), Rule("ad", "skip", cls="ad"), Rule("table", "table", tag="table"), Rule("p", "unit", tag="p"), Rule("li", "unit", tag="li"),
    Rule("row", "unit", tag="i", cls="row", yields=True), Rule("math", "protect", tag="code"), Rule("group", "protect", tag="u", descend=True), Rule("picture", "protect", tag="svg", descend=True, closed=True),
]
NUMBER = re.compile(r"[+\-−]?[0-9]+([.,][0-9]+)*([eE][+\-]?[0-9]+)?\s*(%|‰|°)?(\s*±\s*[0-9.]+)?")


def rule_of(tag, cls):
    for kind in ("skip", "table", "unit", "protect"):
        for r in RULES:
            if r.kind == kind and tag != "#text" and r.tag in (None, tag) and (r.cls is None or r.cls in (cls or "").split()):
                return r
    return None


def walked(html):
    """(ord, kind, rule, text, cells) by going down the tree."""
    parser = Nodes()
    parser.feed(html)
    rows = parser.finish()
    below = lambda at: [r for r in rows if r[2] == at]
    letter = re.compile(r"[^\W\d_]")

    def text(at, stops):
        return "".join(r[6] if r[4] == "#text" else "" if stops(r) else text(r[0], stops) for r in below(at))

    def cells(at):
        return [x for r in below(at) for x in ([r] if r[4] in ("td", "th") else []) + cells(r[0])]

    out = []

    def visit(at, inside):
        for r in below(at):
            rule = rule_of(r[4], r[5])
            kind, here, down = rule and rule.kind, inside, True
            if kind == "skip":
                down = False
            elif kind == "table":
                stops = lambda x: (k := rule_of(x[4], x[5])) is not None and k.kind != "unit"
                stop_or_cell = lambda x: stops(x) or (x[4] in ("td", "th") and rule_of(x[4], x[5]) is None)
                held = cells(r[0])
                texts = [text(c[0], stop_or_cell) for c in held]
                if any(letter.search(t) and not NUMBER.fullmatch(t.strip(" ")) for t in texts):
                    out.append(("table", rule.name, None, len(held)))
                down = False
            elif kind == "unit" and not (rule.yields and inside):
                own = text(r[0], lambda x: rule_of(x[4], x[5]) is not None)
                if letter.search(own):
                    out.append(("text", rule.name, own, None))
                    here = True
            elif kind == "protect":
                down = rule.descend and not (rule.closed and inside)
            if down:
                visit(r[0], here)

    visit(-1, False)
    return [(i, *b) for i, b in enumerate(out)]


def blocks(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    found = sorted((r["page_id"], r["ord"], r["kind"], r["rule"], r["text"], r["cells"]) for r in extracted(html_nodes(df), RULES).collect())
    return [[r[1:] for r in found if r[0] == i] for i in range(len(pages))]


def test_yields_and_closed_elements(spark):
    pages = [
        "<p>One <u>group <i class='row'>row text</i></u> two</p>",  # the row yields to the paragraph
        "<p><u>group <i class='row'>row text</i></u> 12</p>",  # no block around it: the row is one
        "<p>Words <svg><p>label</p></svg></p><svg><p>free label</p></svg>",  # closed inside a block, open outside
        "<p>a <svg>pic <svg><p>deep</p></svg></svg> b</p>",
        "<li>outer <p>inner</p> tail</li><div class='x ad'><p>gone</p></div><script><p>no</p></script>",
        "<table><tr><td>1.5</td><td>2 %</td></tr></table><table><td>x</td><td>3<table><td>4</td></table></td></table>",
        "<table><td><p>words in a cell</p></td></table><p>12 34</p><p></p>",
        "",
    ]
    got = blocks(spark, pages)
    assert got == [walked(p) for p in pages]
    assert [[b[2] for b in page] for page in got] == [["p"], ["row"], ["p", "p"], ["p"], ["li", "p"], ["table"], ["table"], []]
    assert got[2] == [(0, "text", "p", "Words ", None), (1, "text", "p", "free label", None)]
    assert got[5] == [(0, "table", "table", None, 3)]


def test_random_pages(spark):
    r = random.Random(3)
    tags = ["p", "li", "div", "b", "i class='row'", "code", "u", "svg", "table", "td", "div class='ad y'"]

    def tree(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(["word ", "12", "x", "", "3.5 %"])
        tag = r.choice(tags)
        return f"<{tag}>{''.join(tree(depth - 1) for _ in range(r.randint(1, 3)))}</{tag.split()[0]}>"

    pages = ["".join(tree(6) for _ in range(4)) for _ in range(60)]
    assert blocks(spark, pages) == [walked(p) for p in pages]
