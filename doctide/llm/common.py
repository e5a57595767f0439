"""Scratch tables, whole-text word hashing and exact distributed selection, shared by the operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes outside these (the six ASCII white-space bytes).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Units that are worked on at once: a step that holds a dozen 8-byte values for each of them needs some 30 MB.
CHUNK = 1 << 18
#: Bytes of text in a run of rows where a run is also what is counted together.
RUN = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the folder that the whole cluster shares.

    A table here cuts lineage like a checkpoint and survives the loss of executors.  `drop` removes one that no later
    step needs; what a result still reads is removed when the driver's process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
            if held.isEmpty():
                if not spark.sparkContext.master.split("[")[0] == "local":
                    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
                spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
                held = spark.sparkContext._jsc.sc().getCheckpointDir()
            base = held.get()
        self.base = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.drop, self.base)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def drop(self, *kept: DataFrame | str) -> None:
        for x in kept:
            with contextlib.suppress(Exception):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(x if isinstance(x, str) else x.scratch_path)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def free(self) -> None:
        """Lets Spark delete the shuffle files of finished steps now: it does so once their plans are garbage-collected.

        The scheduler holds on to its last job until the next, so an empty one goes first.  Executors delete in the
        background; a step that started at once would write beside what is still there.
        """
        self.spark.range(1).count()
        gc.collect()
        self.spark._jvm.System.gc()
        time.sleep(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over 64 bits (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def series(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(_BASE))


BYTE_VALUES = series(256, 1)
OTHER_BYTE_VALUES = series(256, 3)
STEP = series(64, 2) | np.uint64(1)
#: The lowest 0 to 8 bytes of a number.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def powers(n: int, which: str = "up") -> np.ndarray:
    """The first n powers of the rolling base, or of its inverse, modulo 2^64."""
    held = _powers[which]
    if len(held) < n:
        base = _BASE if which == "up" else pow(_BASE, -1, 1 << 64)
        held = np.full(max(n, 2 * len(held), CHUNK), base, np.uint64)
        held[0] = 1
        _powers[which] = held = np.multiply.accumulate(held)
    return held[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def text_chunks(column: pa.Array, limit: int = RUN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about `limit` bytes; a longer text is a run of its own."""
    raw, at = text_buffer(column)
    first = 0
    while first < len(at) - 1:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def row_runs(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in runs of whole rows with about CHUNK bytes of text each; a batch without rows has none."""
    for batch in batches:
        for first, end, *_ in text_chunks(batch.column(column), CHUNK):
            yield batch.slice(first, end - first)


def words_of(raw: np.ndarray, offsets: np.ndarray, lower: bool = True, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and 64-bit hash of each word; A-Z count as a-z if `lower`; `apart` tells the bytes between words.

    Bytes are worked on in pieces of about CHUNK that end between words, so what a long text needs beside its words (four
    numbers each) does not grow with it; only a single word longer than CHUNK is a piece of its own length.
    """
    found, begin = [], 0
    while begin < len(raw) or not found:
        end = begin + CHUNK
        while end < len(raw) and not apart[raw[end]] and offsets[np.searchsorted(offsets, end)] != end:
            border = np.flatnonzero(apart[raw[end : end + 4_096]])
            row_end = int(offsets[np.searchsorted(offsets, end)])
            end = min(end + (int(border[0]) if len(border) else 4_096), row_end, len(raw))
        end = min(end, len(raw))
        starts, ends, hashes = _words(raw[begin:end], offsets[(offsets > begin) & (offsets < end)] - begin, lower, apart)
        found.append((starts + begin, ends + begin, hashes))
        begin = end
    starts, ends, hashes = found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found, strict=True))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1, hashes


def _words(raw: np.ndarray, edges: np.ndarray, lower: bool, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word; edges are the inner borders of rows."""
    space = apart[raw]
    fresh = np.empty(len(raw), bool)
    last = np.empty(len(raw), bool)
    if len(raw):
        fresh[0] = last[-1] = True
        fresh[1:] = space[:-1]
        last[:-1] = space[1:]
        fresh[edges] = True
        last[edges - 1] = True
    starts = np.flatnonzero(fresh & ~space)
    ends = np.flatnonzero(last & ~space) + 1
    return starts, ends, word_hashes(LOWER[raw] if lower else raw, starts, ends)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [start:end]: 8 bytes after another, each mixed into what those before gave.

    A sum of bytes times powers, as the rolling hashes use it, has pairs of long words that collide for every base; here a
    word of up to 8 bytes is told apart by its own bytes, and a longer one by a chain.  The few over 512 bytes take XXH64.
    """
    held = np.append(raw, np.zeros(8, np.uint8))
    eight = np.ndarray(len(raw) + 1, "<u8", held, strides=(1,))
    size = ends - starts
    out = mix(eight[starts] & MASKS[np.minimum(size, 8)])
    which, done = np.flatnonzero(size > 8), 8
    while len(which) and done < 512:
        out[which] = mix(out[which] * STEP[0] ^ eight[starts[which] + done] & MASKS[np.minimum(size[which] - done, 8)])
        done += 8
        which = which[size[which] > done]
    for i in which.tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return mix(out + size.astype(np.uint64) * STEP[1])


def shingles_of(row: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each run of `width` words in one row; a row of fewer words has one, the whole sequence."""
    n = len(row)
    first = np.ones(n, bool)
    first[1:] = row[1:] != row[:-1]
    whole = np.zeros(n, bool)
    whole[: max(0, n - width + 1)] = row[: max(0, n - width + 1)] == row[width - 1 :]
    at = np.flatnonzero(whole | first)
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        j = at + k
        inside = j < n
        j[~inside] = 0
        inside &= row[j] == row[at]
        total += np.where(inside, hashes[j] * STEP[k], np.uint64(0))
    return at, mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def top_keys(df: DataFrame, key: str, k: int, digit: int = 16) -> tuple[int, int] | None:
    """The k-th largest value of a long column, and how many of the rows with that value belong to the first k.

    A radix selection: each pass counts the rows by one 16-bit digit under the digits found so far, so the driver gets at
    most 65,536 counts whatever the number of rows.  None if k is 0; all rows belong if there are k or fewer.
    """
    if k <= 0:
        return None
    found, left, shift = None, k, 64
    value = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))
    while shift > 0:
        shift -= digit
        rows = df if found is None else df.where(F.shiftrightunsigned(value, shift + digit) == F.lit(found))
        counts = rows.groupBy(F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << digit) - 1)).alias("digit")).count().collect()
        if found is None and sum(c["count"] for c in counts) <= k:
            return -(1 << 63), sum(c["count"] for c in counts)
        for c in sorted(counts, key=lambda c: -c["digit"]):
            if c["count"] >= left:
                found = ((found or 0) << digit) | c["digit"]
                break
            left -= c["count"]
    return (found ^ (1 << 63)) - (1 << 64) if (found ^ (1 << 63)) >> 63 else found ^ (1 << 63), left
