"""Sizes that are tied within groups, lowered until nothing changes."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doctide.operators.walks import cut

#: Sizes that differ by less are the same.
SAME = 1e-9
#: Tables of caps that are read side by side before they become one.
TABLES = 8


def tied(members: DataFrame, ties: DataFrame) -> DataFrame:
    """(member, scale, rounds): each member's size once all ties hold, and how many rounds it was lowered in.

    members: (member, own, floor, first), `own` the size it takes alone, `first` the page it begins on; ties: (tie, member).
    A tie caps each of its members at the least size in it, not below the member's floor: a mate that begins on the member's
    page or before counts with its present size, a later one with its own.  A capped member caps its mates in other ties
    in the next round; sizes only fall and take one of finitely many values, so a round that lowers none comes.

    A round after the first looks only at ties with a member that the round before lowered: the others would give the caps
    that they gave before.  A tie's sizes are brought to one row a page before they are compared, so a tie of most members
    is no one task's work.
    """
    facts = cut(members.select("member", "own", "floor", "first"))
    several = ties.groupBy("tie").agg(F.min("member").alias("_a"), F.max("member").alias("_z")).where("_a < _z").select("tie")
    held = cut(ties.select("tie", "member").join(several, "tie").join(facts, "member"))
    lowered, met, spent = [], held.withColumn("scale", F.col("own")), []
    while True:
        caps = cut(_caps(met), *spent)
        if caps.isEmpty():
            break
        if len(lowered) == TABLES:
            lowered = [cut(_present(lowered), *lowered)]
        lowered.append(caps)
        changed = cut(held.join(caps.select("member"), "member", "left_semi").select("tie").distinct())
        asked = cut(held.join(changed, "tie", "left_semi"), changed)
        now = _present([t.join(asked.select("member").distinct(), "member", "left_semi") for t in lowered]).drop("rounds")
        met = cut(asked.join(now, "member", "left").select(*held.columns, F.coalesce("cap", "own").alias("scale")), asked)
        spent = [met]
    found = facts.join(_present([*lowered, caps]), "member", "left")
    return found.select("member", F.coalesce("cap", "own").alias("scale"), F.coalesce("rounds", F.lit(0)).cast("int").alias("rounds"))


def _caps(met: DataFrame) -> DataFrame:
    """(member, cap, rounds): what the ties of met (tie, member, own, floor, first, scale) lower their members to in one round."""
    pages = met.groupBy("tie", "first").agg(F.min("scale").alias("now"), F.min("own").alias("alone"))
    by_page = Window.partitionBy("tie").orderBy("first")
    until = F.min("now").over(by_page.rowsBetween(Window.unboundedPreceding, 0))
    later = F.min("alone").over(by_page.rowsBetween(1, Window.unboundedFollowing))
    least = pages.select("tie", "first", F.least(until, later).alias("least"))
    caps = met.join(least, ["tie", "first"]).withColumn("cap", F.greatest("least", "floor")).where(F.col("scale") > F.col("cap") + SAME)
    return caps.groupBy("member").agg(F.min("cap").alias("cap"), F.lit(1).alias("rounds"))


def _present(tables: list[DataFrame]) -> DataFrame:
    """(member, cap, rounds): the least cap of each member and its rounds over tables of caps."""
    return functools.reduce(DataFrame.unionByName, tables).groupBy("member").agg(F.min("cap").alias("cap"), F.sum("rounds").cast("int").alias("rounds"))
