"""Occurrences of many names in texts: found by a join on one word, taken longest first, none overlapping another.

A text is a row of pieces, runs of letters and digits and what stands between them; white space is one space.  A name of k
pieces occurs where k pieces in a row are its own, so no letter or digit stands beside it, and no pattern is compiled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PIECES = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
_WORD = r"^[\p{L}\p{N}]"


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(_PIECES), F.lit(0))


def longest_first(hits: Column) -> Column:
    """hits (first, n, at, name), the longest first and then the first, less those that overlap one taken before."""
    order = F.array_sort(hits, lambda a, b: F.when(a["n"] != b["n"], b["n"] - a["n"]).when(a["at"] != b["at"], a["at"] - b["at"]).otherwise(F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)))
    none = F.filter(hits, lambda h: F.lit(False))
    apart = lambda taken, h: ~F.exists(taken, lambda t: (t["at"] < h["at"] + h["n"]) & (h["at"] < t["at"] + t["n"]))
    return F.aggregate(order, none, lambda taken, h: F.when(apart(taken, h), F.array_append(taken, h)).otherwise(taken))


def mentions(texts: DataFrame, keys: list[str], text: str, names: DataFrame) -> DataFrame:
    """(keys..., name, at, n): where each name (a table of one string column, `name`) occurs, in characters from 0.

    at and n count characters of the text with its runs of white space as one space.  A name loses what stands before its
    first and after its last letter or digit; one without any occurs nowhere.  Names meet the texts by their longest word in
    an equi-join (Spark broadcasts the names if they are few), and texts are searched once for all names found so.
    """
    word_at = lambda p: F.array_max(F.transform(p, lambda w, i: F.when(w.rlike(_WORD), F.struct(F.length(w).alias("n"), (-i).alias("i")))))
    bare = F.regexp_replace(F.col("name"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", "")
    known = names.select(bare.alias("name")).where("name <> ''").distinct().select("name", pieces(F.col("name")).alias("_own"))
    known = known.withColumn("_k", -word_at(F.col("_own"))["i"]).select("name", "_own", "_k", F.get("_own", F.col("_k")).alias("_word"))
    words = texts.where(F.col(text).isNotNull()).select(*keys, F.posexplode(pieces(F.col(text))).alias("_i", "_word")).where(F.col("_word").rlike(_WORD))
    near = words.join(known, "_word").where("_i >= _k").groupBy(*keys).agg(F.collect_set(F.struct((F.col("_i") - F.col("_k")).alias("first"), F.col("_own").alias("own"), F.col("name").alias("name"))).alias("_near"))
    met = texts.select(*keys, text).join(near, keys).withColumn("_pieces", pieces(F.col(text)))
    held = F.filter("_near", lambda h: F.slice("_pieces", h["first"] + 1, F.size(h["own"])) == h["own"])
    # places of the hits in characters, each piece counted once in a walk from hit to hit
    hit = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit("").alias("name"))
    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("at"), F.filter(F.array(hit), lambda h: F.lit(False)).alias("all"))
    between = lambda s, h: F.aggregate(F.slice("_pieces", s["first"] + 1, h["first"] - s["first"]), F.lit(0), lambda n, p: n + F.length(p))

    def step(s: Column, h: Column) -> Column:
        at = s["at"] + between(s, h)
        one = F.struct(at.alias("at"), F.length(h["name"]).alias("n"), h["name"].alias("name"))
        return F.struct(h["first"].alias("first"), at.alias("at"), F.array_append(s["all"], one).alias("all"))

    hits = F.aggregate(F.array_sort(held), start, step)["all"]
    return met.select(*keys, F.explode(longest_first(hits)).alias("_h")).select(*keys, "_h.name", "_h.at", "_h.n")
