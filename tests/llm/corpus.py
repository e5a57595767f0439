"""A small corpus with the awkward cases: nulls, empty and long texts, copies, ties, repeated rows, clashing columns."""

import random

WORDS = [a + b for a in ("al", "be", "cor", "du", "éx", "fir", "go", "hu") for b in ("ra", "ti", "no", "mé", "lus", "pe")]


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


SHARED = text(999, 110)


def rows() -> list[tuple]:
    out = [(i, text(i, 30 + 7 * i), "en", f"s{i % 4}") for i in range(24)]
    out += [(100 + i, text(3, 51), "en", "s0") for i in range(12)]  # one large group of copies
    out += [(120 + i, text(200 + i, 40) + "\n" + SHARED + "\n" + text(300 + i, 20 * i), "en", None if i % 2 else "s1") for i in range(6)]
    out += [(130, None, "en", "s1"), (131, "", None, "s2"), (132, " \t\n", "en", None), (133, "One", "en", "s3"), (134, "one", "en", "s3"), (135, "Two words", "en", "s3")]
    out += [(136, "ab" * 900, "en", "s2"), (137, text(7, 6000), "en", "s0"), (138, "a  b\u00a0c\x0bD É é", "en", "s0")]
    out += [(5, text(5, 65), "en", "s1")] * 2  # repeated rows
    near = text(4, 400).split()
    out += [(141, " ".join(near), "en", "s2"), (142, " ".join([*near[:200], "changed", *near[201:]]), "en", "s2")]
    return out


SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark, extra: bool = False):
    """Split over several partitions; `extra` adds columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows()], f"{SCHEMA}, n_chars long").repartition(3)
    return df.selectExpr("*", "1 as key", "'x' as row", "2 as size", "3 as copies", "'c' as content", "0 as component_id", "1.5 as weight", "array(1) as spans", "7 as n") if extra else df


def empty(spark):
    return spark.createDataFrame([], f"{SCHEMA}, n_chars long")
