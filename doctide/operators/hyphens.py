"""Hyphenation by Liang's patterns: digits between letters vote for (odd) or against (even) a break, the highest wins."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def syllable_patterns() -> list[str]:
    """Patterns made from one rule: a syllable starts before a consonant and its vowel, and some pairs of consonants stay together."""
    pairs = [f"1{a}2{b}" for a, b in itertools.chain(itertools.product("bcdfgkptv", "lr"), itertools.product("cgpst", "h"))]
    return [f"1{c}{v}" for c, v in itertools.product("bcdfghjklmnpqrstvwxzçñß", "aeiouyáàâäéèêëíîïóôöúùûü")] + pairs


#: Votes that are sent to every task; more of them are met by a join of both sides.
MOST_SENT = 1 << 16


def break_points(words: DataFrame, patterns: DataFrame, left: int = 2, right: int = 3, exceptions: DataFrame | None = None) -> DataFrame:
    """(word, breaks): offsets at which each distinct word (word, in lower case) may break, ascending, joined by commas.

    patterns (pattern) are written as in `1ti2on`, a full stop for a word's edge; at least left letters stay before a break
    and right after it.  A word of exceptions (spelled, with its hyphens) breaks there and nowhere else.  Null words are
    left out.  Only parts of words meet patterns, by an
    equal join, and each word adds up its own votes.
    """
    letters = F.regexp_replace("pattern", "[0-9]", "")
    digits = F.transform(F.regexp_extract_all(F.concat("pattern", F.lit(" ")), F.lit("([0-9]?)[^0-9]"), F.lit(1)), lambda d: F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)))
    votes = patterns.select(letters.alias("part"), F.posexplode(digits).alias("k", "vote")).where("vote > 0")
    longest = patterns.agg(F.max(F.length(letters)).alias("n")).first()["n"] or 0
    w = words.where("word is not null").select("word").distinct()
    if exceptions is not None:
        known = exceptions.select(F.replace("spelled", F.lit("-")).alias("word"), "spelled").dropDuplicates(["word"])
        spelled = w.join(known, "word")
        pieces = F.slice(F.split("spelled", "-"), 1, F.size(F.split("spelled", "-")) - 1)
        ends = F.aggregate(pieces, F.array().cast("array<int>"), lambda s, p: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + F.length(p))))
        spelled = spelled.select("word", F.array_join(ends.cast("array<string>"), ",").alias("breaks"))
        w = w.join(known, "word", "left_anti")
    dotted = F.concat(F.lit("."), "word", F.lit("."))
    starts = w.select("word", F.explode(F.sequence(F.lit(0), F.length("word") + 1)).alias("at"))
    ends = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(longest), F.length("word") + 2 - F.col("at"))))
    parts = starts.select("word", "at", F.explode(ends).alias("n")).select("word", "at", F.substring(dotted, F.col("at") + 1, F.col("n")).alias("part"))
    # few votes go to the words, which are then still dealt as `distinct` dealt them
    few = votes.limit(MOST_SENT + 1).count() <= MOST_SENT
    hit = F.when(F.col("vote").isNotNull(), F.struct((F.col("at") + F.col("k") - 1).alias("offset"), "vote"))
    met = parts.join(F.broadcast(votes) if few else votes, "part", "left").groupBy("word").agg(F.collect_list(hit).alias("hits"))
    highest = lambda o: F.aggregate("hits", F.lit(0), lambda s, h: F.when(h["offset"] == o, F.greatest(s, h["vote"])).otherwise(s))
    places = F.filter(F.sequence(F.lit(0), F.length("word")), lambda o: (o >= left) & (o <= F.length("word") - right))
    out = met.select("word", F.array_join(F.filter(places, lambda o: highest(o) % 2 == 1).cast("array<string>"), ",").alias("breaks"))
    return out if exceptions is None else out.unionByName(spelled)
