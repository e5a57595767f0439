"""Operator 1, quality classifier by importance resampling.

Two generative models count hashed n-grams into BUCKETS: one over labelled good documents (the target), one over all
documents (the raw text).  A passage weighs log p_target - log p_raw, added over its n-grams; a document weighs what its
worst passage of WINDOWS words weighs, so a few bad lines in a long text show.  Documents are then drawn without
replacement by Gumbel top-k: each adds Gumbel noise to its log weight over TEMPERATURE and the k largest sums are kept.
k is how many documents weigh at least the cut that parts good and bad labelled documents best
while at least KEEP of the good ones pass.

n-grams: words, pairs of words, the last 3 and the first 4 bytes of words.  A bucket whose target count lies within SURE
standard errors of what the raw model expects there weighs nothing.  A target document is weighed by the target without
itself, so labelled and other documents stand alike and the cut holds for both.  The target is fitted on at most
MOST_LABELLED labelled documents; the raw model and all weights cover every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK, LOWER, STEP, Scratch, mix, table, text_chunks, top_keys, words_of

BITS = 20
BUCKETS = 1 << BITS
BLOCK = 4_096
WINDOWS = (8, 16)
TEMPERATURE = 0.1
SURE = 3.0
KEEP = 0.98
MOST_LABELLED = 20_000
#: Weight of a text without words: below every other.
NONE = -1e9


def ngrams_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each word, and the buckets of the n-grams that end or lie in it."""
    starts, ends, row, words = words_of(raw, offsets, lower=False)
    tail, head = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for k in range(1, 4):
        tail = tail * np.uint64(257) + raw[np.maximum(ends - k, starts)]
    for k in range(4):
        inside = starts + k < ends
        head = head * np.uint64(257) + np.where(inside, LOWER[raw[np.where(inside, starts + k, starts)]], 0).astype(np.uint64)
    head = head + np.minimum(ends - starts, 5).astype(np.uint64) * np.uint64(1 << 50)
    before = np.zeros_like(words)
    before[1:] = np.where(row[1:] == row[:-1], words[:-1], 0)
    kinds = words, mix(words * STEP[1] + before * STEP[2]), mix(tail + np.uint64(1 << 40)), mix(head + np.uint64(1 << 41))
    return row, words, np.stack([(x >> np.uint64(64 - BITS)).astype(np.int32) for x in kinds], axis=1)


COUNTS = "kind int, block int, counts binary"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of one task's documents, kind 0 for all and 1 for those of the target."""
    totals = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
        for first, _, raw, offsets in text_chunks(batch.column("text"), CHUNK):
            row, _, buckets = ngrams_of(raw, offsets)
            totals[0] += np.bincount(buckets.ravel(), minlength=BUCKETS)
            totals[1] += np.bincount(buckets[target[row + first]].ravel(), minlength=BUCKETS)
    yield from _blocks(totals)


def _blocks(totals: np.ndarray) -> Iterator[pa.RecordBatch]:
    found = [(kind, b, part.tobytes()) for kind in (0, 1) for b, part in enumerate(totals[kind].reshape(-1, BLOCK)) if part.any()]
    if found:
        kinds, blocks, parts = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(blocks, pa.int32()), pa.array(parts, pa.binary())], ["kind", "block", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by kind and block, held as one fixed-size table while the parts stream past."""
    totals = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for kind, block, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            totals[kind, block * BLOCK : (block + 1) * BLOCK] += np.frombuffer(part, np.int64)
    yield from _blocks(totals)


def flagged(docs: DataFrame, good: DataFrame) -> DataFrame:
    """docs with _dt_target, true for the documents of good (doc_id), at most MOST_LABELLED."""
    few = F.broadcast(good.select(F.col("doc_id").alias("_dt_id"), F.lit(True).alias("_dt_target")))
    return docs.join(few, F.col("doc_id") == F.col("_dt_id"), "left").select(*docs.columns, F.coalesce("_dt_target", F.lit(False)).alias("_dt_target"))


def fit(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """For each bucket the target's count, and the count that the raw model expects there.  No target: all zero."""
    marked = flagged(docs.select("doc_id", "text"), good).select("text", F.col("_dt_target").alias("target"))
    parts = marked.mapInArrow(_count, COUNTS).repartition(max(8, BUCKETS // BLOCK // 8), "block").mapInArrow(_add, COUNTS)
    totals = np.zeros((2, BUCKETS), np.int64)
    for r in parts.toLocalIterator():
        totals[r["kind"], r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.int64)
    return np.stack([totals[1], totals[0] * (totals[1].sum() / max(1, totals[0].sum()))]).astype(np.float32)


def weigh(texts: pa.Array, model: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, log weight and content hash of each text; target tells which texts the target holds."""
    words, weight, content = np.zeros(len(texts), np.int64), np.full(len(texts), NONE), np.zeros(len(texts), np.uint64)
    for at, end, raw, offsets in text_chunks(texts, CHUNK):
        row, hashes, buckets = ngrams_of(raw, offsets)
        words[at:end] = np.bincount(row, minlength=end - at)
        if not len(row):
            continue
        seen, expected = model[0][buckets].astype(np.float64), model[1][buckets].astype(np.float64)
        own = target[at + row]
        if own.any():
            _, of, n = np.unique(row[own][:, None] << BITS | buckets[own], return_inverse=True, return_counts=True)
            seen[own] -= n[of].reshape(-1, buckets.shape[1])
        ratio = np.where(np.abs(seen - expected) > SURE * np.sqrt(expected), np.log((seen + 1) / (expected + 1)), 0.0)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        sums = np.append(0.0, np.cumsum(ratio.sum(axis=1)))
        place = np.arange(len(row))
        begin = np.repeat(first, np.diff(np.append(first, len(row))))
        worst = [np.minimum.reduceat(sums[1:] - sums[np.maximum(place - n + 1, begin)], first) for n in WINDOWS]
        weight[at + row[first]] = np.minimum.reduce(worst)
        content[at + row[first]] = np.add.reduceat(mix(hashes + (place - begin).astype(np.uint64)), first)
    return words, weight, content


def gumbel_keys(ids: np.ndarray, content: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Log weight over TEMPERATURE plus Gumbel noise drawn from the hash of id and content, as longs of the same order."""
    u = ((mix(mix(ids.astype(np.int64).view(np.uint64)) + content) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    bits = (np.round(weight, 4) / TEMPERATURE - np.log(-np.log(u))).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def scored(docs: DataFrame, good: DataFrame, model: np.ndarray) -> DataFrame:
    """docs with _dt_words, _dt_weight and _dt_key (long); the model is a fixed 8 MB and is broadcast."""
    held, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, weight, content = weigh(batch.column("text"), held.value, batch.column("_dt_target").to_numpy(zero_copy_only=False).astype(bool))
            ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(words), pa.array(weight), pa.array(gumbel_keys(ids, content, weight))], [*names, "_dt_words", "_dt_weight", "_dt_key"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_dt_words", T.LongType()), T.StructField("_dt_weight", T.DoubleType()), T.StructField("_dt_key", T.LongType())])
    return flagged(docs, good).mapInArrow(score, schema)


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight that parts good from bad labelled documents with the highest mean of both rates, of those that KEEP good ones.

    Without good or bad ones it is below all.
    """
    if not len(good) or not len(bad):
        return NONE / 2
    good, bad = np.sort(good), np.sort(bad)
    cuts = np.unique(np.concatenate([good, bad]))
    rates = (len(good) - np.searchsorted(good, cuts)) / len(good) + np.searchsorted(bad, cuts) / len(bad)
    kept = (len(good) - np.searchsorted(good, cuts)) / len(good)
    at = int(np.argmax(np.where(kept >= KEEP, rates, 0)))
    return float((cuts[at] + cuts[max(0, at - 1)]) / 2)


def fitted(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[DataFrame, np.ndarray, DataFrame, int]:
    """The target's ids, the model, (doc_id, words, weight, key) of all documents, and the smallest key that the draw keeps.

    Rows with the key of the last one drawn are kept together.  Null and empty texts weigh NONE and are never drawn.
    Labels with null quality are left out; without good labels every document with words is drawn.
    """
    few = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    few = scratch.keep(few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED), "labelled")
    target = few.where("good").select("doc_id")
    model = fit(docs, target)
    weights = scratch.keep(scored(docs.select("doc_id", "text"), target, model).select("doc_id", F.col("_dt_words").alias("words"), F.col("_dt_weight").alias("weight"), F.col("_dt_key").alias("key")), "weights")
    known = weights.where("words > 0").join(F.broadcast(few), "doc_id").select("good", "weight").limit(2 * MOST_LABELLED).toPandas()
    cut = best_cut(known["weight"][known["good"]].to_numpy(), known["weight"][~known["good"].astype(bool)].to_numpy())
    k = weights.where(F.col("weight") >= cut).count()
    last = top_keys(weights.where("words > 0"), "key", k)
    return target, model, weights, last[0] if last else (1 << 63) - 1


def resample(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs that the draw keeps.  Weights are computed again from the model, so no text is shuffled.

    Whole texts count.  Texts are worked on in runs of about CHUNK bytes; a longer one is a run of its own and needs, beside
    itself, a fixed number of 8-byte values a word.
    """
    target, model, _, last = fitted(docs, labels, scratch)
    return scored(docs, target, model).where((F.col("_dt_words") > 0) & (F.col("_dt_key") >= last)).select(*docs.columns)


def op1_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, weights, last = fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark))
    return weights.where((F.col("words") > 0) & (F.col("key") >= last)).select("doc_id", "words", F.round("weight", 4).alias("log_weight"), F.col("key").alias("draw_key"))


QUERIES = {"op1_importance_resample": op1_importance_resample}
ORACLE: dict[str, str] = {}
