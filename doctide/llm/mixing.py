"""Operator 7, mixing sources to target weights by entropy balancing.

Document rates r minimise their divergence from 1, sum r log r - r + 1, under 0 <= r <= 3 and one token constraint for
each source, sum r * size = target.  The dual is convex, with one multiplier a source, and its solution is the tilted
rate r = min(3, exp(m * size / mean size)).  Newton iterations find all multipliers together; each is one Spark
aggregation over the table of distinct sizes a source.  Rates become whole copies by carrying the rounding error, in
words, from document to document within bounded shares of each source.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, table

MOST = 3.0
SHARE_ROWS = 4_096
#: Sources are configuration: their number is checked against this before their totals come to the driver.
MOST_SOURCES = 100_000


def reshared(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Targets that share the sum of sizes by weight, none above `most` times its source; what is over is shared again."""
    total, targets, free = float(sum(sizes)), [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    left = total
    while free:
        scale = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * scale > most * sizes[i]]
        if not full:
            for i in free:
                targets[i] = weights[i] * scale
            break
        for i in full:
            targets[i] = most * sizes[i]
            left -= targets[i]
        free = [i for i in free if i not in set(full)]
    return targets


def multipliers(cells: DataFrame, sources: pd.DataFrame, rounds: int = 60) -> list[float]:
    """The dual's solution for each source by safeguarded Newton steps; cells: (s, size, n), sources: size, mean, target."""
    spark = cells.sparkSession
    goal, low, high, m = sources["target"].to_numpy(float), np.full(len(sources), -64.0), np.full(len(sources), 64.0), np.zeros(len(sources))
    m[goal >= MOST * sources["size"].to_numpy(float) * (1 - 1e-12)] = 64.0
    open_ = (m == 0) & (goal > 0)
    for _ in range(rounds):
        if not open_.any():
            break
        now = spark.createDataFrame([(int(i), float(m[i]), float(sources["mean"][i])) for i in np.flatnonzero(open_)], "s int, m double, mean double")
        tilt = F.exp(F.least(F.col("m") * F.col("size") / F.col("mean"), F.lit(700.0)))
        words = F.col("n") * F.col("size")
        got = (
            cells.join(F.broadcast(now), "s").groupBy("s")
            .agg(F.sum(words * F.least(tilt, F.lit(MOST))).alias("taken"), F.sum(F.when(tilt < MOST, words * tilt * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope")).collect()
        )
        for row in got:
            i, over = row["s"], row["taken"] - goal[row["s"]]
            low[i], high[i] = (low[i], m[i]) if over > 0 else (m[i], high[i])
            if abs(over) <= 1e-9 * goal[i] or high[i] - low[i] < 1e-12:
                open_[i] = False
                continue
            step = m[i] - over / row["slope"] if row["slope"] > 0 else math.inf
            m[i] = step if low[i] < step < high[i] else (low[i] + high[i]) / 2
    return m.tolist()


def whole_copies(sizes: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Copies of each document, sizes descending, so that the words taken follow the words due; at most MOST each."""
    out, owed = np.zeros(len(sizes), np.int64), 0.0
    for i, (size, rate) in enumerate(zip(sizes.tolist(), rates.tolist(), strict=True)):
        owed += size * rate
        n = min(MOST, max(0.0, math.floor(owed / size + 0.5))) if size else 1.0
        out[i], owed = n, owed - n * size
    return out


def mixed(docs: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """(doc_id, row, n, size, source_size, target, copies) of the distinct rows of docs (doc_id, source, text).

    row is a hash of source and text; n equal rows take `copies` each.

    Sources in the order of their code points, null last, take the weights in turn.  size counts words, null text has 0.
    Equal input gives equal copies; an empty table gives an empty result.  Words are counted in the JVM, of texts of any
    length; what is dealt afterwards are sizes.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("source", "text").alias("row"))
    sized = scratch.keep(rows.groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("n")), "sizes")
    known = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs")).limit(MOST_SOURCES + 1).collect()
    if len(known) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    known = sorted(known, key=lambda r: (r["source"] is None, r["source"] or ""))
    sources = pd.DataFrame({"size": [r["words"] for r in known], "target": reshared([r["words"] for r in known], [float(weights[i % len(weights)]) for i in range(len(known))])})
    sources["mean"] = [max(1.0, r["words"] / r["docs"]) for r in known]
    names = spark.createDataFrame([(r["source"], i) for i, r in enumerate(known)], "source string, s int")
    cells = sized.groupBy("source", "size").agg(F.sum("n").alias("n")).alias("c").join(F.broadcast(names.alias("k")), F.expr("c.source <=> k.source"))
    kept = scratch.keep(cells.select("s", "size", "n"), "cells")
    m = multipliers(kept, sources)
    found = [(r["source"], r["words"], float(sources["target"][i]), float(sources["mean"][i]), m[i], math.ceil(r["docs"] / SHARE_ROWS)) for i, r in enumerate(known)]
    solved = spark.createDataFrame(found, "source string, source_size long, target double, mean double, m double, shares long")
    rate = F.least(F.lit(MOST), F.exp(F.least(F.col("m") * F.col("size") / F.col("mean"), F.lit(700.0))))
    due = sized.alias("d").join(F.broadcast(solved.alias("k")), F.expr("d.source <=> k.source")).select(
        "doc_id", "row", "n", "d.source", "size", "source_size", "target", rate.alias("rate"), F.pmod(F.xxhash64("doc_id", "row"), F.col("shares")).alias("share")
    )

    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(words=pdf["size"] * pdf["n"]).sort_values(["words", "doc_id", "row"], ascending=[False, True, True], kind="stable")
        return pdf.assign(copies=whole_copies(pdf["words"].to_numpy(), pdf["rate"].to_numpy()))[["doc_id", "row", "n", "size", "source_size", "target", "copies"]]

    return due.groupBy("source", "share").applyInPandas(rounded, "doc_id long, row long, n long, size long, source_size long, target double, copies long")


def mix_copies(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs, each repeated as often as the mix takes it."""
    copies = scratch.keep(mixed(docs, scratch).where("copies > 0").select(F.col("doc_id").alias("_dt_id"), F.col("row").alias("_dt_of"), F.col("copies").alias("_dt_copies")), "copies")
    each = docs.withColumn("_dt_row", F.xxhash64("source", "text")).join(copies.hint("merge"), F.expr("doc_id <=> _dt_id and _dt_row = _dt_of"))
    return each.withColumn("_dt_k", F.explode(F.sequence(F.lit(1), F.col("_dt_copies").cast("int")))).select(*docs.columns)


def op7_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"), Scratch(spark)).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


QUERIES = {"op7_entropy_mix": op7_entropy_mix}
ORACLE: dict[str, str] = {}
