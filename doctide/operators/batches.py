"""Budgeted batching, contiguous or first-fit, and debouncing: ordered folds that stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batched(df: DataFrame, keys: list[str], order: list[str], size: Column, most_size: Column | int, most_items: int, first: int | None = None, cut: Column | None = None) -> DataFrame:
    """(keys, order, batch): members of each key packed in order into batches.

    A batch is closed when the next member would pass `most_size` (`first` for the first batch, if given) or it has
    `most_items`, and before a member for which `cut` holds.  A member is never split; one over the budget is alone.
    """
    cut = F.lit(False) if cut is None else cut
    members = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, size.cast("long").alias("_size"), cut.alias("_cut")))).alias("_m"))
    budget = lambda s: F.when(s["b"] == 0, F.lit(first)).otherwise(F.lit(most_size)) if first is not None else F.lit(most_size)

    def step(s: Column, m: Column) -> Column:
        full = (s["n"] > 0) & ((s["size"] + m["_size"] > budget(s)) | (s["n"] >= most_items) | m["_cut"])
        batch = F.when(full, s["b"] + 1).otherwise(s["b"])
        return F.struct(
            batch.alias("b"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.when(full, m["_size"]).otherwise(s["size"] + m["_size"]).alias("size"),
            F.concat(s["out"], F.array(batch)).alias("out"),
        )

    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("size"), F.array().cast("array<int>").alias("out"))
    placed = members.withColumn("_b", F.aggregate("_m", start, step, lambda s: s["out"]))
    return placed.select(*keys, F.explode(F.arrays_zip("_m", "_b")).alias("_x")).select(*keys, *(F.col(f"_x._m.{c}").alias(c) for c in order), F.col("_x._b").alias("batch"))


def first_fit(df: DataFrame, keys: list[str], order: list[str], size: Column, most_size: int, most_items: int) -> DataFrame:
    """(keys, order, size, batch): members of each key, in order of urgency, put into the first request that has room.

    The same as filling request after request from the queue: what is too long for one is passed over and the search goes on.
    A member over the budget is alone, as nothing fits beside it.
    """
    members = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, size.cast("long").alias("_size")))).alias("_m"))

    def step(s: Column, m: Column) -> Column:
        free = F.transform(s["held"], lambda r: (r["size"] + m["_size"] <= most_size) & (r["n"] < most_items))
        at = F.array_position(free, True).cast("int")
        joined = F.transform(s["held"], lambda r, i: F.when(i + 1 == at, F.struct((r["size"] + m["_size"]).alias("size"), (r["n"] + 1).alias("n"))).otherwise(r))
        opened = F.concat(s["held"], F.array(F.struct(m["_size"].alias("size"), F.lit(1).alias("n"))))
        return F.struct(
            F.when(at > 0, joined).otherwise(opened).alias("held"),
            F.concat(s["out"], F.array(F.when(at > 0, at - 1).otherwise(F.size(s["held"])))).alias("out"),
        )

    start = F.struct(F.array().cast("array<struct<size:bigint,n:int>>").alias("held"), F.array().cast("array<int>").alias("out"))
    placed = members.withColumn("_b", F.aggregate("_m", start, step, lambda s: s["out"]))
    return placed.select(*keys, F.explode(F.arrays_zip("_m", "_b")).alias("_x")).select(*keys, *(F.col(f"_x._m.{c}").alias(c) for c in order), F.col("_x._m._size").alias("size"), F.col("_x._b").alias("batch"))


def debounced(df: DataFrame, key: str, t: str, order: str, delay: int, most: int) -> DataFrame:
    """df with `first`, `last` and `fires`: bursts that fire `delay` after their last request, and `most` after their first at the latest.

    A request at or after that moment begins the next burst.  A gap of `delay` always parts bursts, so only what lies between
    two such gaps is folded as one array.
    """
    w = Window.partitionBy(key).orderBy(t, order)
    gap = F.col(t) - F.lag(t).over(w)
    run = F.sum(F.when(gap.isNull() | (gap >= delay), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = df.withColumn("_run", run).groupBy(key, "_run").agg(F.array_sort(F.collect_list(F.struct(t, order, F.struct(*df.columns).alias("_row")))).alias("_m"))

    def step(s: Column, m: Column) -> Column:
        first = F.when(s["first"].isNull() | (m[t] >= s["first"] + most), m[t]).otherwise(s["first"])
        return F.struct(first.alias("first"), F.concat(s["out"], F.array(first)).alias("out"))

    start = F.struct(F.lit(None).cast("long").alias("first"), F.array().cast("array<bigint>").alias("out"))
    each = runs.withColumn("_b", F.aggregate("_m", start, step, lambda s: s["out"])).select(F.explode(F.arrays_zip("_m", "_b")).alias("_x"))
    rows = each.select("_x._m._row.*", F.col("_x._b").alias("first"))
    last = F.max(t).over(Window.partitionBy(key, "first"))
    return rows.withColumn("last", last).withColumn("fires", F.least(F.col("last") + delay, F.col("first") + most))
