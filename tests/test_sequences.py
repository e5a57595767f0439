"""Sequential operators against hand-made cases and brute force."""

import itertools
import random

from doctide.operators.batches import batched
from doctide.operators.sequences import Breaker, Common, aligned, cut_lines, gaps, hunks, longest_common, merge_boxes
from doctide.plans import sequences as plans
from doctide.sources.html import html_nodes


def test_longest_common_subsequence_is_longest():
    r = random.Random(7)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randrange(8))] for _ in range(2))
        pairs = longest_common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
        subs = {s for k in range(len(a) + 1) for s in itertools.combinations(a, k)}
        best = max(len(s) for s in subs if any(s == t for t in itertools.combinations(b, len(s))))
        assert len(pairs) == best


def test_aligned_by_key_with_one_side_missing(spark):
    a = spark.createDataFrame([("x", 1, "a"), ("x", 2, "b"), ("x", 3, "c"), ("y", 1, "a")], "k string, pos int, v string")
    b = spark.createDataFrame([("x", 5, "b"), ("x", 6, "c"), ("z", 1, "a")], "k string, pos int, v string")
    assert sorted(map(tuple, aligned(a, b, "k", "pos", "v").collect())) == [("x", 2, 5), ("x", 3, 6)]


def test_breaker():
    b = Breaker(window=4, least=2, share=0.5, rest=100)
    assert [b.step(t, f) for t, f in ((0, False), (1, True), (2, False), (101, True), (150, False), (205, False), (206, False))] == ["closed", "open", "skipped", "open", "skipped", "closed", "closed"]


def test_batches_never_split_and_oversize_is_alone(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([3, 3, 3, 20, 1, 1])] + [(2, 0, 5)], "k int, pos int, n long")
    got = sorted(map(tuple, batched(df, ["k"], ["pos"], df["n"], 6, 10).collect()))
    assert got == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, 3), (2, 0, 0)]
    assert [r[2] for r in sorted(map(tuple, batched(df.where("k = 1"), ["k"], ["pos"], df["n"], 6, 10, first=3).collect()))] == [0, 1, 1, 2, 3, 3]


def test_merge_boxes(spark):
    rows = [(1, 0.0, 0.0, 50.0, 10.0, 0.9), (1, 0.0, 12.0, 45.0, 22.0, 0.9), (1, 200.0, 12.0, 240.0, 22.0, 0.9), (1, 0.0, 60.0, 50.0, 70.0, 0.1)]
    got = sorted(map(tuple, merge_boxes(spark.createDataFrame(rows, "p int, x0 double, y0 double, x1 double, y1 double, confidence double"), "p").collect()))
    assert got == [(1, 0, 2, 0.0, 0.0, 50.0, 22.0), (1, 1, 1, 200.0, 12.0, 240.0, 22.0)]


def test_html_nodes(spark):
    page = "<div class='a'><p>One<br>two</p><script>x='</p>'</script></div>"
    got = [tuple(r)[1:] for r in html_nodes(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("pos").collect()]
    assert got == [
        (0, 7, -1, 0, "div", "a", None), (1, 5, 0, 1, "p", None, None), (2, 3, 1, 2, "#text", None, "One"), (3, 4, 1, 2, "br", None, None), (4, 5, 1, 2, "#text", None, "two"),
        (5, 7, 0, 1, "script", None, None), (6, 7, 5, 2, "#text", None, "x='</p>'"),
    ]


def test_halved_alignment_is_as_long_as_the_whole():
    r = random.Random(11)
    for _ in range(100):
        a, b = ([r.randrange(5) for _ in range(r.randrange(60))] for _ in range(2))
        pairs = longest_common(a, b, cells=8)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
        assert len(pairs) == len(longest_common(a, b))


def test_gaps_between_pairs(spark):
    pairs = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 4, 2), (1, 5, 6), (2, 3, 3)], "page int, a_pos int, b_pos int")
    assert sorted(map(tuple, gaps(pairs, "page").collect())) == [(1, 2, 4, 2, 2), (1, 5, 5, 3, 6)]


def test_lines_follow_an_evolving_baseline(spark):
    glyphs = [(1, i, y, 10) for i, y in enumerate([100.0, 103.0, 106.0, 108.0, 120.0, 121.0, 60.0])] + [(2, 0, 5.0, 10)]
    got = sorted(map(tuple, cut_lines(spark.createDataFrame(glyphs, "page int, gid int, y double, size int"), "page", "gid").collect()))
    assert got == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 2), (1, 5, 2), (1, 6, 3), (2, 0, 0)]


def test_page_text_blocks_and_title_words(spark, tmp_path):
    page = "<title>Old tales</title><h1>The old tales</h1><p>One <b>two</b><script>no()</script></p><li>1</li>"
    spark.createDataFrame([(7, page), (8, None), (9, "")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = lambda q: sorted(map(tuple, q(spark, str(tmp_path)).collect()))
    assert [r[2] for r in rows(plans.html_text)] == ["Old tales", "The old tales", "One ", "two", "1"]
    assert {r[2]: r[3] for r in rows(plans.words_on_page)} == {"tales": 8}


def test_turns_are_aligned_word_by_word(spark, tmp_path):
    turns = [(1, 0, "u", "a b c d"), (1, 1, "a", "b x d"), (1, 2, "u", None), (1, 3, "a", "b"), (2, 0, "u", "b")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted(map(tuple, plans.doc_align(spark, str(tmp_path)).collect())) == [("1/1", 2)]


def test_waves_meet_on_a_shortest_path():
    """As long as the table of lengths says, for every size and alphabet, without the table for small pieces."""
    r = random.Random(5)
    for _ in range(1_000):
        k = r.randint(1, 5)
        a, b = ([r.randrange(k) for _ in range(r.randrange(40))] for _ in range(2))
        pairs = Common(a, b, cells=0).pairs
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1]
        assert pairs == Common(a, b, cells=0).pairs


def test_alignment_takes_time_with_the_difference():
    """200,000 members with 40 edits take a few steps a member; what differs altogether stops at its bound."""
    r = random.Random(6)
    a = [r.randrange(1_000) for _ in range(200_000)]
    b = list(a)
    for _ in range(20):
        b[r.randrange(len(b))] = -1
        del b[r.randrange(len(b))]
    found = Common(a, b)
    assert len(found.pairs) == len(a) - 40 and found.steps < 10 * len(a) and not found.stopped
    bound = Common([i % 7 for i in range(400)], [3 * i % 11 for i in range(400)], 10)
    assert bound.stopped and len(bound.pairs) < 400
    apart = Common(list(range(50_000)), list(range(50_000, 100_000)), 100_000)
    assert apart.stopped and apart.steps < 110_000


def test_stopped_is_a_column(spark):
    a = spark.createDataFrame([(k, i, i % 7) for k in (1, 2) for i in range(200 if k == 1 else 5)], "k int, pos int, v int")
    b = spark.createDataFrame([(k, i, 3 * i % 11) for k in (1, 2) for i in range(200 if k == 1 else 5)], "k int, pos int, v int")
    got = aligned(a, b, "k", "pos", "v", 100).collect()
    assert {r["k"] for r in got if r["stopped"]} == {1} and {r["k"] for r in got if not r["stopped"]} == {2}


def test_hunks_by_spelling(spark):
    """All classes: pairs are on equal codes, and what lies between is spelled."""

    def stream(rows):
        return spark.createDataFrame([(k, i, u, c, e) for k, text in rows for i, (u, c, e) in enumerate(text)], "k int, pos int, unit string, code string, line_end boolean")

    glyphs = lambda s, shift="": [(u, u + shift, False) for u in s]
    a = stream([
        (1, glyphs("para") + [("-", "-", True)] + glyphs("graph")), (2, glyphs("the brown fox")), (3, glyphs("the fox")), (4, glyphs("a") + glyphs("ﬁ", "1") + [("-", "-", True)] + glyphs("z")),
        (5, glyphs("xaz")), (6, glyphs("only")), (8, glyphs("oné") + glyphs("!")),
    ])
    b = stream([
        (1, glyphs("paragraph")), (2, glyphs("the fox")), (3, glyphs("the brown fox")), (4, glyphs("a") + glyphs("fi", "2") + [("-", "-2", False)] + glyphs("z")),
        (5, glyphs("xbz")), (7, glyphs("other")), (8, glyphs("on") + glyphs("e\u0301", "2") + glyphs("!")),
    ])
    pairs = aligned(a, b, "k", "pos", "code")
    got = sorted(map(tuple, hunks(pairs, a, b, "k", "pos").collect()))
    assert [(k, n, m, c) for k, _, n, m, c in got] == [(1, 1, 0, "hyphen"), (2, 6, 0, "aonly"), (3, 0, 6, "bonly"), (4, 2, 3, "font"), (5, 1, 1, "char"), (6, 4, 0, "aonly"), (7, 0, 5, "bonly"), (8, 1, 2, "hyphen")]
    assert {h for k, h, *_ in got if k in (6, 7)} == {0}


def test_lists_that_differ_throughout_take_a_table():
    """Two of 1,000 members of 21 kinds: a table of bits, however many edits there are; also halved, as long lists are."""
    r = random.Random(8)
    a, b = ([r.randrange(21) for _ in range(1_000)] for _ in range(2))
    found = Common(a, b)
    assert found.steps <= 20_000 and not found.stopped
    for other in (Common(a, b, cells=0), Common(a, b, cells=0, kept=10_000), Common(a, b, cells=8, kept=1_000)):
        assert len(other.pairs) == len(found.pairs)
        assert all(a[i] == b[j] for i, j in other.pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(other.pairs))
    assert Common(a, b, 10_000).stopped


def turns_at(spark, path, turns):
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(path / "conversations.parquet"))
    return str(path)


def python_steps(df):
    """How often the plan sends rows to Python, and how often a group at a time."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("ArrowEvalPython"), plan.count("InPandas")


def test_hunks_of_turns(spark, tmp_path):
    """One alignment for both sides, in batches of keys; a turn without words is one side, a missing one is none."""
    at = turns_at(spark, tmp_path, [(1, 0, "u", "a b c d"), (1, 1, "a", "b x-\ny d"), (1, 2, "u", ""), (1, 3, "a", None), (1, 4, "u", "z"), (2, 0, "u", "b"), (3, None, "u", "q")])
    found = plans.hunk_class(spark, at)
    assert sorted(map(tuple, found.collect())) == [("1/1", 0, 0, 1, "bonly"), ("1/1", 1, 3, 1, "char"), ("1/2", 0, 0, 5, "bonly")]
    assert python_steps(found) == (2, 0)


def test_turns_of_one_key_are_one_list(spark, tmp_path):
    """A turn that stands twice is one list by place of word; words are not dealt one by one."""
    at = turns_at(spark, tmp_path, [(1, 0, "u", "a b"), (1, 0, "u", "a b"), (1, 1, "a", "b a a x b"), (1, 3, "u", "a"), (2, 0, "u", "x"), (2, 1, "u", "y")])
    found = plans.doc_align(spark, at)
    assert sorted(map(tuple, found.collect())) == [("1/1", 3)]
    assert python_steps(found) == (1, 0)


def test_streams_of_a_page_are_aligned_as_lists(spark, tmp_path):
    """Items of both kinds of a page meet in one row; before, each page was a group of its own in Python."""
    items = [(k, 1 + k % 2, 5, 1 + k % 7, 2.0, 100.0, "ANR"[k * k % 3], "FO"[k // 4 % 2]) for k in range(40)]
    spark.createDataFrame(items, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = plans.lcs_align(spark, str(tmp_path))
    got = found.collect()
    assert python_steps(found) == (1, 0) and not any(r["stopped"] for r in got)
    gids = {(k * 10 + 1 + k % 7): (f"{'ANR'[k * k % 3]}{9 + k % 7}", 1 + k % 2, "FO"[k // 4 % 2]) for k in range(40)}
    for page in (1, 2):
        a, b = ([g for g in sorted(gids) if gids[g][1:] == (page, s)] for s in "FO")
        want = longest_common([gids[g][0] for g in a], [gids[g][0] for g in b])
        assert sorted((r["a_pos"], r["b_pos"]) for r in got if r["page"] == page) == [(a[i], b[j]) for i, j in want]
