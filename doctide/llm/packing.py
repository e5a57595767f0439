"""Operator 2, conflict-constrained best-fit packing.

Texts are cut into pieces of at most CAPACITY words and packed into bins of that capacity.  A bin never holds two texts of
one duplicate cluster, nor more texts of one source than its bitmaps allow (one a source).  Bins are kept in the order of
their residual space, each with one bitmap of its sources and one of its clusters; a piece, largest first, goes to the
tightest bin that has room, and where that conflicts the search goes on to the next tighter residual until a compatible
bin is found, else a new bin opens.

Pieces are dealt by hash into shards of about SHARD_ROWS pieces, however long their texts, each packed by one task; the part of a shard is independent of
its texts, so a source or cluster with a third of all rows is spread over all shards.  Whole pieces of CAPACITY words fill
a bin alone and need no search.
"""

from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, table

CAPACITY = 2_048
SHARD_ROWS = 4_096


class Bins:
    """Open bins by residual space.  Bins with equal residual and bitmaps are alike, so each such kind is one entry."""

    def __init__(self):
        self.residuals: list[int] = []
        self.kinds: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.count = 0

    def add(self, bin_: int, residual: int, sources: int, clusters: int) -> None:
        if residual <= 0:
            return
        if residual not in self.kinds:
            bisect.insort(self.residuals, residual)
        self.kinds.setdefault(residual, {}).setdefault((sources, clusters), []).append(bin_)

    def take(self, size: int, source: int, cluster: int) -> tuple[int, int, int, int]:
        """The tightest compatible bin, taken out: bin, residual and bitmaps; a new one if none is."""
        for at in range(bisect.bisect_left(self.residuals, size), len(self.residuals)):
            residual = self.residuals[at]
            kinds = self.kinds[residual]
            fit = next(((s, c) for s, c in kinds if not s & source and not c & cluster), None)
            if fit:
                bins = kinds[fit]
                found = bins.pop()
                if not bins:
                    del kinds[fit]
                    if not kinds:
                        del self.kinds[residual]
                        del self.residuals[at]
                return found, residual, *fit
        self.count += 1
        return self.count - 1, CAPACITY, 0, 0


def best_fit(sizes: list[int], sources: list, clusters: list) -> list[int]:
    """The bin of each piece, taken in the given order; a null source conflicts with none."""
    bins, source_bits, out = Bins(), {}, []
    shared = pd.Series(clusters)
    cluster_bits = {c: 1 << i for i, c in enumerate(shared[shared.duplicated()].unique())}  # only clusters that can conflict
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = 0 if source is None else source_bits.setdefault(source, 1 << len(source_bits))
        c = cluster_bits.get(cluster, 0)
        found, residual, held_sources, held_clusters = bins.take(size, s, c)
        bins.add(found, residual - size, held_sources | s, held_clusters | c)
        out.append(found)
    return out


PACKED = "doc_id long, source string, piece int, first_word long, n_words long, bin_id string, place int, fill long"


def packed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """PACKED for every piece of docs (doc_id, source, text): its bin, its place there and the words in the bin.

    A duplicate cluster is the texts that are equal but for letter case, digits and white space.  Texts without words
    make one empty piece, which takes no room.  Repeated rows are texts of one cluster.  A long text is as many pieces as
    it fills bins; only its words are counted in the JVM, and its pieces are numbers.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[\s\d]+", " "))
    each = docs.select("doc_id", "source", words.alias("words"), F.xxhash64(plain).alias("cluster"), F.xxhash64("text", "source").alias("content"))
    each = scratch.keep(each.groupBy(*each.columns).agg(F.count("*").alias("n")), "sizes")
    copies = each.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    pieces = copies.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("words") / CAPACITY) - 1, F.lit(0)).cast("int"))).alias("piece"))
    size = F.least(F.lit(CAPACITY), F.col("words") - F.col("piece") * CAPACITY)
    pieces = pieces.select("doc_id", "source", "cluster", "content", "copy", "piece", (F.col("piece").cast("long") * CAPACITY).alias("first_word"), size.alias("n_words"))
    rows = each.agg(F.coalesce(F.sum(F.col("n") * F.greatest(F.ceil(F.col("words") / CAPACITY), F.lit(1))), F.lit(0))).first()[0]
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "content", "copy", "piece"), F.lit(max(1, math.ceil(rows / SHARD_ROWS)))))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "doc_id", "content", "copy", "piece"], ascending=[False, True, True, True, True], kind="stable")
        bins = best_fit(pdf["n_words"].tolist(), [None if pd.isna(s) else s for s in pdf["source"]], pdf["cluster"].tolist())
        name = f"{pdf['shard'].iloc[0]}-"
        pdf = pdf.assign(bin_id=[f"{name}{b}" for b in bins])
        pdf["place"] = pdf.groupby("bin_id").cumcount().astype("int32")
        pdf["fill"] = pdf.groupby("bin_id")["n_words"].transform("sum")
        return pdf[["doc_id", "source", "piece", "first_word", "n_words", "bin_id", "place", "fill"]]

    return dealt.groupBy("shard").applyInPandas(pack, PACKED)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), Scratch(spark))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLE: dict[str, str] = {}
