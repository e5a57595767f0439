"""Mentions against a plain search with one pattern a name."""

import random
import re

from doctide.operators.mentions import mentions

EDGE = "[^\\W_]"


def plain(text, names):
    """(name, at, n) in a text whose white space is squashed."""
    text = re.sub(r"\s+", " ", text)
    hits = []
    for name in {re.sub(r"^[\W_]+|[\W_]+$", "", n) for n in names} - {""}:
        for m in re.finditer(f"(?<!{EDGE})(?={re.escape(re.sub(chr(92) + 's+', ' ', name))}(?!{EDGE}))", text):
            hits.append((m.start(), len(re.sub(r"\s+", " ", name)), re.sub(r"\s+", " ", name)))
    taken = []
    for at, n, name in sorted(hits, key=lambda h: (-h[1], h[0], h[2])):
        if not any(a < at + n and at < a + m for a, m, _ in taken):
            taken.append((at, n, name))
    return sorted((name, at, n) for at, n, name in taken)


def found(spark, texts, names):
    df = spark.createDataFrame(list(enumerate(texts)), "unit int, text string")
    rows = mentions(df, ["unit"], "text", spark.createDataFrame([(n,) for n in names], "name string")).collect()
    return [sorted((r["name"], r["at"], r["n"]) for r in rows if r["unit"] == i) for i in range(len(texts))]


def test_longest_first_on_word_edges(spark):
    names = ["Ann", "Ann Lee", "Lee Marsh Cole", "J. O'Neil", "Ünal", "(Bo)", "X 2", "..."]
    texts = ["Ann Lee Marsh Cole met Ann, Annie and \n Ann  Lee.", "J.  O'Neil's (Bo)ok; Bo. Ünal_ Ünalı xÜnal", "X 2.5, X 22, X 2", "", None, "Lee"]
    got = found(spark, texts, names)
    assert got == [plain(t or "", names) for t in texts]
    assert got[0] == [("Ann", 0, 3), ("Ann", 23, 3), ("Ann Lee", 38, 7), ("Lee Marsh Cole", 4, 14)]


def test_random_names(spark):
    r = random.Random(8)
    words = ["a", "b", "Aa", "b1", "é", "c-d"]
    names = [" ".join(r.choices(words, k=r.randint(1, 4))) for _ in range(25)]
    texts = ["".join(w + r.choice([" ", "  ", ", ", "-", "\t"]) for w in r.choices(words, k=r.randint(0, 40))) for _ in range(80)]
    assert found(spark, texts, names) == [plain(t, names) for t in texts]
