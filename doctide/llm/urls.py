"""Operator 5, URL filters: path rules first, then logistic regression on hashed character n-grams of host and path.

DataFrame and SQL functions only.  The labelled table is small by its parameter `most_labelled`; the weights are one
array of BUCKETS numbers, so every training round is one aggregation that returns at most BUCKETS sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

BUCKETS = 1_024
SIZES = (3, 4)
MOST_LABELLED = 20_000
#: (verdict, host and path) as the contract states them.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def with_parts(df: DataFrame) -> DataFrame:
    """host and path of url; null or without ://, both are empty."""
    part = lambda k: F.coalesce(F.regexp_extract("url", PARTS, k), F.lit(""))
    return df.withColumn("host", F.translate(part(1), UPPER, LOWER)).withColumn("path", part(2))


def rule_for(rules: tuple[tuple[str, str], ...]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; equally long ones go to the first by code point."""
    found = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = found.when(fits, hit)
    return found


def features() -> Column:
    """Buckets of the distinct character n-grams of host and path, ends marked, and one for the bias."""

    def grams(side: str, n: int) -> Column:
        text = F.concat(F.lit("^"), F.col(side), F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(side), F.substring(text, i, F.lit(n))), F.lit(BUCKETS - 1)) + 1)

    return F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), *(grams(side, n) for side in ("host", "path") for n in SIZES)))


def _constants(numbers: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>")  # folded to one constant


def chance(weights: list[float]) -> Column:
    """Probability of block for the features in `grams`, each weighing one over the root of their number."""
    total = F.aggregate("grams", F.lit(0.0), lambda s, g: s + F.get(_constants(weights), g.cast("int")))
    return 1 / (1 + F.exp(-total / F.sqrt(F.size("grams"))))


def _summed(labelled: DataFrame, each: Column) -> list[float]:
    """Sum of `each` over the rows that have a feature, for every feature; rounded, so that the order of adding does not show."""
    out = [0.0] * BUCKETS
    valued = labelled.select("grams", each.alias("x"))  # once a row, before its features are exploded
    for r in valued.select(F.explode("grams").alias("g"), "x").groupBy("g").agg(F.sum("x").alias("s")).collect():
        out[r["g"]] = round(r["s"], 9)
    return out


def curvature(labelled: DataFrame, n: int, rounds: int = 12) -> float:
    """The largest eigenvalue of the features' second moments, by power iteration; features weigh one over the root of their number."""
    v, top = [1.0] * BUCKETS, 1.0
    for _ in range(rounds):
        along = F.aggregate("grams", F.lit(0.0), lambda s, g: s + F.get(_constants(v), g.cast("int")))
        w = [x / n for x in _summed(labelled, along / F.size("grams"))]
        top = math.sqrt(math.fsum(x * x for x in w))
        v = [round(x / top, 9) for x in w]
    return top


def train(labelled: DataFrame, rounds: int = 40, decay: float = 1e-4) -> list[float]:
    """Weights of a logistic regression of y on grams, by accelerated gradient steps over the whole labelled table.

    A step is as long as the curvature allows: a logistic loss bends by a quarter of the second moments at most.  The
    estimate of the largest comes from below, so a tenth is taken off.  An empty table gives zeros.
    """
    n = labelled.count()
    weights, last = [0.0] * BUCKETS, [0.0] * BUCKETS
    rate = 0.9 * 4 / curvature(labelled, n) if n else 0.0
    for k in range(rounds if n else 0):
        ahead = [round(w + k / (k + 3) * (w - v), 9) for w, v in zip(weights, last, strict=True)]
        sums = _summed(labelled, (chance(ahead) - F.col("y")) / F.sqrt(F.size("grams")))
        last, weights = weights, [round(w * (1 - rate * decay) - rate * s / n, 9) for w, s in zip(ahead, sums, strict=True)]
    return weights


def judged(urls: DataFrame, labelled: DataFrame, scratch: Scratch, rules: tuple[tuple[str, str], ...] = RULES, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """urls with host, path, rule, verdict and the method's score (probability of block).

    labelled has (url, y), y 1 for block; of more than `most_labelled` rows those with the smallest hashes are used.
    Null and malformed urls have empty parts and are judged by the method like any other.  A url is judged whole: of
    one of n signs the distinct buckets of its n-grams are kept, at most BUCKETS.
    """
    few = with_parts(labelled.select("url", "y").where("y is not null").distinct()).orderBy(F.xxhash64("url"), "url", "y").limit(most_labelled)
    weights = train(scratch.keep(few.select(features().alias("grams"), F.col("y").cast("double").alias("y")), "labelled").coalesce(1))
    each = with_parts(urls).withColumn("_hit", rule_for(rules)).withColumn("grams", features()).withColumn("score", chance(weights))
    verdict = F.coalesce(F.col("_hit.verdict"), F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return each.select(*urls.columns, "host", "path", F.col("_hit.rule").alias("rule"), verdict.alias("verdict"), F.round("score", 6).alias("score"))


def rule_labelled(urls: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(url, y) of the urls that a rule decides: the small labelled table where no other is given."""
    return with_parts(urls.select("url")).withColumn("_hit", rule_for(rules)).where("_hit is not null").select("url", (F.col("_hit.verdict") == "block").cast("int").alias("y"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, rule_labelled(pages), Scratch(spark)).drop("url")


QUERIES = {"op5_url_filter": op5_url_filter}
ORACLE: dict[str, str] = {}
