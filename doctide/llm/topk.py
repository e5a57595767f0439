"""Operator 10, exact top-k search over a bit-sliced index.

Rows are dealt into blocks.  Within a block every quantised attribute is stored as slices: one bitmap over the block's
rows for each bit.  A query multiplies by shifting slices into columns of equal weight and adds each column with
carry-save adders, all of it AND, OR and XOR on whole bitmaps.  The best rows are then picked from the most significant
slice of the sums downward; rows that tie at the boundary are resolved by their id.  Each task gives its k best of a
query, and a last ranking over those is exact, because a row among the k best of all is among the k best of its block.

The slices of a block are built once and kept as one row of a scratch table.  Queries pass over that table in sets of about
PASS_QUERIES, each sent to every task, so vectors are shuffled once to be dealt into blocks and never for a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Rows of a block; small tables get smaller blocks, down to LEAST_ROWS, so that every core has one.
BLOCK_ROWS, LEAST_ROWS = 32_768, 4_096
#: Queries sent to every task at once: about 8 MB at 128 components.
PASS_QUERIES = 8_192


def slices_of(values: np.ndarray) -> list[int]:
    """Bitmaps of a column of non-negative integers, least significant first; bit r of a bitmap is row r."""
    return [int.from_bytes(np.packbits((values >> b) & 1, bitorder="little").tobytes(), "little") for b in range(int(values.max(initial=0)).bit_length())]


def add_columns(columns: dict[int, list[int]]) -> list[int]:
    """Slices of the sum of all bitmaps, each counted at the weight of its column."""
    out, at = [], 0
    while columns:
        column = columns.pop(at, [])
        carry = columns.setdefault(at + 1, []) if len(column) > 1 else []
        while len(column) > 2:
            a, b, c = column.pop(), column.pop(), column.pop()
            both = a ^ b
            column.insert(0, both ^ c)
            carry.append((a & b) | (both & c))
        if len(column) == 2:
            carry.append(column[0] & column[1])
            column = [column[0] ^ column[1]]
        out.append(column[0] if column else 0)
        at += 1
    return out


def best_rows(sums: list[int], allowed: int, k: int) -> int:
    """Bitmap of the k allowed rows with the largest sums; of rows tied at the boundary, those of lower index."""
    sure, tied = 0, allowed
    if allowed.bit_count() <= k:
        return allowed
    for s in reversed(sums):
        high = tied & s
        n = (sure | high).bit_count()
        if n > k:
            tied = high
        else:
            sure |= high
            tied &= ~s
            if n == k:
                return sure
    for _ in range(k - sure.bit_count()):
        low = tied & -tied
        sure |= low
        tied ^= low
    return sure


def packed(vectors: list[list[int]]) -> np.ndarray:
    """Vectors as rows of the narrowest type that holds them, short ones filled up with zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out.astype(np.result_type(np.min_scalar_type(out.min(initial=0)), np.min_scalar_type(out.max(initial=0)), np.int8))


class SlicedBlock:
    """The index of one block: ids ascending, rows by attributes, and the slices of each attribute above its least value."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, slices: list[list[int]]):
        self.ids, self.values, self.slices = ids, values, slices
        self.all = (1 << len(ids)) - 1

    @classmethod
    def built(cls, ids: np.ndarray, values: np.ndarray) -> SlicedBlock:
        order = np.argsort(ids, kind="stable")
        values = values[order]
        wide = values.astype(np.int64)
        return cls(ids[order], values, [slices_of(column) for column in (wide - wide.min(axis=0, initial=0)).T])

    def row(self) -> dict:
        """As one row of the scratch table."""
        size = (len(self.ids) + 7) // 8
        bitmaps = [[s.to_bytes(size, "little") for s in column] for column in self.slices]
        return {"ids": self.ids.tobytes(), "kind": self.values.dtype.str, "cells": np.ascontiguousarray(self.values).tobytes(), "slices": bitmaps}

    @classmethod
    def read(cls, row: dict) -> SlicedBlock:
        ids = np.frombuffer(row["ids"], np.int64)
        values = np.frombuffer(row["cells"], row["kind"]).reshape(len(ids), -1)
        return cls(ids, values, [[int.from_bytes(s, "little") for s in column] for column in row["slices"]])

    def search(self, own: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows; attributes that either side lacks count as zero."""
        columns: dict[int, list[int]] = {}
        width = min(len(weights), len(self.slices))
        for weight, slices in zip(weights[:width].tolist(), self.slices[:width], strict=True):
            if weight and slices:
                size = abs(weight)
                for shift in range(size.bit_length()):
                    if size >> shift & 1:
                        for b, s in enumerate(slices):
                            # a negative weight adds the complement, which differs by the same constant for every row
                            columns.setdefault(shift + b, []).append(s if weight > 0 else self.all ^ s)
        low, high = int(np.searchsorted(self.ids, own)), int(np.searchsorted(self.ids, own, "right"))
        found = best_rows(add_columns(columns), self.all ^ (((1 << (high - low)) - 1) << low), k)
        rows = np.flatnonzero(np.unpackbits(np.frombuffer(found.to_bytes((len(self.ids) + 7) // 8, "little"), np.uint8), bitorder="little"))
        return self.ids[rows], self.values[rows, :width].astype(np.int64) @ weights[:width]


BLOCK = "ids binary, kind string, cells binary, slices array<array<binary>>"
BLOCK_TYPE = pa.schema([("ids", pa.binary()), ("kind", pa.string()), ("cells", pa.binary()), ("slices", pa.list_(pa.list_(pa.binary())))])
ASKED = "ids binary, copies binary, kind string, cells binary"
FOUND = "query_id long, vec_id long, score long"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of one task's rows; a block is closed when it reaches BLOCK_ROWS."""
    held: list[pa.RecordBatch] = []

    def block() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        held.clear()
        index = SlicedBlock.built(rows.column("vec_id").to_numpy(), packed(rows.column("v").to_pylist()))
        return pa.RecordBatch.from_pylist([index.row()], schema=BLOCK_TYPE)

    for batch in batches:
        for first in range(0, batch.num_rows, LEAST_ROWS):
            held.append(batch.slice(first, LEAST_ROWS))
            if sum(b.num_rows for b in held) >= BLOCK_ROWS:
                yield block()
    if held:
        yield block()


def _asked(rows: pa.Table) -> pa.Table:
    """All queries of one pass as one row."""
    cells = packed(rows.column("v").to_pylist())
    return pa.table({"ids": [rows.column("vec_id").to_numpy().tobytes()], "copies": [rows.column("copies").to_numpy().tobytes()], "kind": [cells.dtype.str], "cells": [cells.tobytes()]}, pa.schema([("ids", pa.binary()), ("copies", pa.binary()), ("kind", pa.string()), ("cells", pa.binary())]))


def _search(held, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, copies, kind, cells = held.value
        own, times = np.frombuffer(ids, np.int64), np.minimum(np.frombuffer(copies, np.int64), k)
        weights = np.frombuffer(cells, kind).reshape(len(own), -1).astype(np.int64)
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(own)
        for batch in batches:
            for at in range(batch.num_rows):
                block = SlicedBlock.read(batch.slice(at, 1).to_pylist()[0])
                for q in range(len(own)):
                    found = block.search(own[q], weights[q], k)
                    if best[q]:
                        found = tuple(np.concatenate(x) for x in zip(best[q], found, strict=True))
                        order = np.lexsort((found[0], -found[1]))[:k]
                        found = found[0][order], found[1][order]
                    best[q] = found
        for q in range(0, len(own), 256):
            some = [(own[i], np.repeat(best[i][0], times[i]), np.repeat(best[i][1], times[i])) for i in range(q, min(q + 256, len(own))) if best[i]]
            if some:
                columns = np.concatenate([np.full(len(x), i) for i, x, _ in some]), np.concatenate([x for _, x, _ in some]), np.concatenate([y for _, _, y in some])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return search


def sliced_top_k(rows: DataFrame, queries: DataFrame, k: int, n_rows: int, n_queries: int) -> DataFrame:
    """The k rows of largest integer inner product with each query, but for the query's own id.

    `rows` and `queries` have (vec_id long, v array<long>), neither null; other columns are not looked at.  Vectors of unequal
    lengths count as filled up with zeros.  Returns query_id, rank, vec_id, score; equal scores go to the smaller vec_id.  No
    rows or no queries: no result.  Rows repeating a vec_id are separate candidates.  Queries repeating a vec_id are ranked as
    one, with each one's candidates.  The counts only set the number of blocks and passes.  A task holds one block of BLOCK_ROWS
    rows and about PASS_QUERIES queries with their k best.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    blocks = max(1, math.ceil(n_rows / BLOCK_ROWS), min(spark.sparkContext.defaultParallelism, math.ceil(n_rows / LEAST_ROWS)))
    index = scratch.keep(rows.select("vec_id", "v").repartition(blocks).mapInArrow(_index, BLOCK), "blocks")
    passes = max(1, math.ceil(n_queries / PASS_QUERIES))
    distinct = queries.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).withColumn("pass", F.pmod(F.xxhash64("vec_id", "v"), F.lit(passes)).cast("int"))
    asked = scratch.keep(distinct.groupBy("pass").applyInArrow(lambda key, t: _asked(t).add_column(0, "pass", pa.array([key[0].as_py()], pa.int32())), f"pass int, {ASKED}"), "queries")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(near: DataFrame) -> DataFrame:
        return near.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

    kept = []
    for number in range(passes):
        row = asked.where(F.col("pass") == number).first()
        if row:
            held = spark.sparkContext.broadcast((bytes(row["ids"]), bytes(row["copies"]), row["kind"], bytes(row["cells"])))
            kept.append(scratch.keep(ranked(index.mapInArrow(_search(held, k), FOUND)).drop("rank"), "best").scratch_path)
            held.destroy()
    if not kept:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return ranked(spark.read.schema(FOUND).parquet(*kept))


def quantised(df: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors that are null or hold null or non-finite ones are left out."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def op10_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    queries = rows.where(F.col("vec_id") % 20 == 0)
    n = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % 20 == 0)).first()
    return sliced_top_k(rows, queries, 20, *n)


QUERIES = {"op10_bit_sliced_top_k": op10_bit_sliced_top_k}
ORACLE = {
    "op10_bit_sliced_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 20"""
}
