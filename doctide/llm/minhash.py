"""Operator 3, document fingerprints by one-permutation MinHash.

Shingles of five words are hashed once; the top bits of a hash choose its bin and each bin keeps its smallest hash.
Empty bins are filled by optimal densification: bin i tries the bins of a fixed pseudo-random sequence of its own until
it meets a filled one and copies that, so two texts fill alike wherever they agree.  Of each bin LOW bits of a
hash of its value are stored, packed into hexadecimal; likeness takes out the share of bins that agree by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, series, shingles_of, table, text_chunks, words_of

WIDTH = 5
BIN_BITS = 9
BINS = 1 << BIN_BITS
LOW = 4
ROWS = 512


def bin_minima(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Smallest hash of each bin of each text, and which bins have one."""
    low, filled = np.zeros((len(texts), BINS), np.uint64), np.zeros((len(texts), BINS), bool)
    for first, _, raw, offsets in text_chunks(texts):
        _, _, row, hashes = words_of(raw, offsets)
        at, shingles = shingles_of(row, hashes, WIDTH)
        bins = (row[at] + first) * BINS + (shingles >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        order = np.lexsort((shingles, bins))
        bins, shingles = bins[order], shingles[order]
        least = np.ones(len(bins), bool)
        least[1:] = bins[1:] != bins[:-1]
        low.reshape(-1)[bins[least]] = shingles[least]
        filled.reshape(-1)[bins[least]] = True
    return low, filled


def densified(low: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Every empty bin gets the value of the first filled bin in its own fixed sequence of trials; rows without any stay zero."""
    rows, bins = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    out, start, trial = low.copy(), series(BINS, 3), 0
    while len(rows):
        tried = (mix(start[bins] + np.uint64(trial)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        hit = filled[rows, tried]
        out[rows[hit], bins[hit]] = low[rows[hit], tried[hit]]
        rows, bins, trial = rows[~hit], bins[~hit], trial + 1
    return out


def fingerprints(texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Packed fingerprints of texts in hexadecimal, '' for a text without words, and the low bits of their bins."""
    low, filled = bin_minima(texts)
    # each bin hashes its value with a seed of its own: bins that hold copies of one value then agree by chance independently
    bits = (mix(densified(low, filled) ^ series(BINS, 4)) & np.uint64((1 << LOW) - 1)).astype(np.uint8)
    packed = bits[:, ::2] << 4 | bits[:, 1::2]
    return [row.tobytes().hex() if some else "" for row, some in zip(packed, filled.any(axis=1).tolist(), strict=True)], bits


def likeness(a: np.ndarray, b: np.ndarray, a_some: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of shingle sets: the share of agreeing bins, less what chance gives; 0 to 1."""
    chance = 0.5**LOW
    share = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_some & b_some, share, np.where(a_some | b_some, 0.0, 1.0))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by as many (or all) first ones of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _judged(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
    """Results for all rows but the last, which is only the next of the one before."""
    ids, texts = zip(*rows, strict=True)
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    own, bits = fingerprints(pa.array(texts, pa.large_string()))
    other, changed_bits = fingerprints(pa.array(changed, pa.large_string()))
    some, changed_some = np.array([x != "" for x in own]), np.array([x != "" for x in other])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[:-1], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array(own[:-1]),
            pa.array(other),
            pa.array(likeness(bits[:-1], changed_bits, some[:-1], changed_some)),
            pa.array(likeness(bits[:-1], bits[1:], some[:-1], some[1:])),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by stretch in document order; a stretch ends with the first row of the next one, marked `ahead`."""
    held: list[tuple[int | None, str]] = []
    part, over = None, False
    for batch in batches:
        for p, ahead, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "ahead", "doc_id", "text")), strict=True):
            if p != part:
                part, over, held = p, False, []
            if over:
                continue
            held.append((doc, text or ""))
            over = ahead
            if len(held) > ROWS or sum(len(t) for _, t in held[-1:]) > 1 << 20 or over:
                if len(held) > 1:
                    yield _judged(held)
                held = held[-1:]


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id, text) dealt into stretches of the order of doc_id, each followed by the first row of the next.

    Null ids come first and rows of one id in the order of their texts.  Stretch borders are quantiles of doc_id: at most
    `parts` numbers reach the driver.  Every text is shuffled once, but for the `parts` rows that are also a next one.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    borders = docs.select(key.cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    borders = sorted({int(b) for b in borders})
    part: Column = F.lit(0) if not borders else F.size(F.filter(F.split(F.lit(",".join(map(str, borders))), ",").cast("array<long>"), lambda b: b <= F.col("_k")))
    placed = docs.select("doc_id", "text", key.alias("_k")).withColumn("part", part)
    firsts = sorted((r["part"], r["k"]) for r in placed.groupBy("part").agg(F.min("_k").alias("k")).collect())
    spark = docs.sparkSession
    following = [(k, p) for (p, _), (_, k) in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    extra = placed.drop("part").join(F.broadcast(spark.createDataFrame(following, "_k long, part int")), "_k").withColumn("ahead", F.lit(True))
    both = placed.withColumn("ahead", F.lit(False)).unionByName(extra)
    return both.repartitionById(len(borders) + 1, F.col("part")).sortWithinPartitions("part", "ahead", "_k", F.col("text").asc_nulls_first()).select("part", "ahead", "doc_id", "text")


def fingerprinted(docs: DataFrame, parts: int) -> DataFrame:
    """One row for each row of docs; see OUT.  Null text counts as empty; an empty table gives an empty result.

    A stretch of rows is worked on up to a text of over 1 MB, so a task holds one long text, its neighbour and the
    edited form of both, and a fixed number of 8-byte values a word of them.
    """
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], OUT)
    return with_next(docs.select("doc_id", "text"), parts).mapInArrow(_stretches, OUT)


def op3_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprinted(docs, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))


QUERIES = {"op3_minhash_fingerprints": op3_minhash_fingerprints}
ORACLE: dict[str, str] = {}
