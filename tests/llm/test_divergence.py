"""Operator 11 against plain Python, with blocks of two sources and shards of three terms too."""

import collections
import random
import re

import pytest

from doctide.llm import divergence
from doctide.llm.common import Scratch

from . import corpus


def brute(rows, least=10, top=10):
    """Result rows of (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    held, in_docs = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, source, text in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        held[lang, source].update(terms)
        in_docs.update({(lang, t) for t in terms})
    out = []
    for lang in {r[0] for r in rows}:
        kept = {t for (g, t), n in in_docs.items() if g == lang and n >= least}
        sources = sorted({r[1] for r in rows if r[0] == lang})

        def rates(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: rates(held[lang, s]) for s in sources}
        q = rates(sum((held[lang, s] for s in sources), collections.Counter()))
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if held[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                best = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(best, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def rows_of(seed):
    r = random.Random(seed)
    words = ["Alpha", "beta", "Straße", "ÉTÉ", "été", "b2b", "c_d", "e-mail", "x", "日本", "zz", "it's", "\x00n", "tab\tq", "ÿ", "o p"]
    rows = [(r.choice(["en", "de", None, ""]), f"s{min(r.randrange(7), r.randrange(7))}" if r.random() > 0.1 else None, " ".join(r.choices(words, range(1, 17), k=r.randrange(30)))) for _ in range(160)]
    rows += [("en", "only numbers", "1 2 3"), ("en", "null text", None), ("fr", "a", "alone"), ("fr", "b", ""), ("xx", "one", None)]
    return rows + [("en", "s1", "Rare rarer")] * 9 + [("en", "s2", "ten times ten")] * 10


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2) for r in rows], "lang string, source string, text string, n int, term string, place int").repartition(4)


@pytest.mark.parametrize("small", [False, True])
def test_divergences(spark, monkeypatch, small):
    if small:
        for name, value in (("SHARD_TERMS", 3), ("SOURCES", 2), ("HELD", 8)):
            monkeypatch.setattr(divergence, name, value)
    rows = rows_of(1)
    assert got(divergence.divergences(frame(spark, rows), Scratch(spark))) == brute(rows)
    assert got(divergence.divergences(frame(spark, rows), Scratch(spark), 1, 3)) == brute(rows, 1, 3)


def test_divergences_of_the_corpus(spark):
    rows = [(g, s, t) for _, t, g, s in corpus.rows()]
    assert got(divergence.divergences(corpus.documents(spark, extra=True), Scratch(spark))) == brute(rows)


def test_rates_are_exact_for_large_counts(spark):
    n, total, kinds = 7_654_321_098_765, 98_765_432_109_876, 12_345_678
    df = spark.createDataFrame([(n, total, kinds)], "n long, total long, kinds long")
    assert df.select(divergence.rate("n", "total", "kinds")).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * kinds)


def test_empty_table_and_one_long_text(spark):
    assert divergence.divergences(corpus.empty(spark), Scratch(spark)).count() == 0
    rows = [("en", "a", "word " * 600_000 + "x" * 3_000_000), ("en", "b", "word"), ("en", "b", "other")]
    assert got(divergence.divergences(frame(spark, rows), Scratch(spark), 1)) == brute(rows, 1)
