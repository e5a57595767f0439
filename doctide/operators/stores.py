"""Keyed stores: upserts, probes, expiry and eviction as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes last in the order: a bulk upsert."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def fresh(df: DataFrame, made: str, ttl: int, now: int) -> DataFrame:
    """Entries that have not outlived their time."""
    return df.where(F.col(made) + F.lit(ttl) > F.lit(now))


def evict_prefix(df: DataFrame, shard: list[str], order: list[Column], size: str, most_rows: int, most_size: float) -> DataFrame:
    """Entries that stay when the oldest go until both caps of a shard hold.

    Eviction removes a prefix of the order of use, so an entry stays while it and all more recent ones are within both caps.
    """
    w = Window.partitionBy(*shard).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kept = df.withColumn("_n", F.count("*").over(w)).withColumn("_size", F.sum(size).over(w))
    return kept.where((F.col("_n") <= most_rows) & (F.col("_size") <= most_size)).drop("_n", "_size")


def reusable(results: DataFrame, passes: DataFrame, services: DataFrame) -> DataFrame:
    """(unit, by, reusable): whether the stored answer of each unit may be given again.

    results: (unit, ok, by), one row a unit; passes: (unit, part, service, why), part null for the unit itself and else one of
    its stretches; services: (service, rank), ranks from 0.  An answer by a service counts only if every service before it
    refused the unit itself, each at least once and never anything else: one that could not be reached may answer next time.
    One by `self` never counts, one by `runs:...` only if all services refused the unit so and no pass of the unit or its
    stretches is anything but a refusal.
    """
    refusal = F.col("why") == "refused"
    own = passes.where("part is null").groupBy("unit", "service").agg(F.bool_and(refusal).alias("refused")).where("refused").join(services, "service").select("unit", "rank")
    told = passes.groupBy("unit").agg(F.bool_and(refusal).alias("all_refused"))
    asked = results.join(services.withColumnsRenamed({"service": "by"}), "by", "left").withColumnRenamed("rank", "_k")
    before = asked.join(own, "unit").groupBy("unit").agg(F.sum(F.when(F.col("rank") < F.col("_k"), 1).otherwise(0)).alias("_before"), F.count("*").alias("_all"))
    met = asked.join(before, "unit", "left").join(told, "unit", "left").join(F.broadcast(services.agg(F.count("*").alias("_services"))), F.lit(True), "left")
    by_service = F.col("_k").isNotNull() & (F.coalesce("_before", F.lit(0)) == F.col("_k"))
    by_runs = F.col("by").startswith("runs:") & F.coalesce("all_refused", F.lit(True)) & (F.coalesce("_all", F.lit(0)) == F.col("_services"))
    return met.select("unit", "by", F.coalesce(F.col("ok") & (F.col("by") != "self") & (by_service | by_runs), F.lit(False)).alias("reusable"))
