"""Operator 6, removal of repeated strings, after suffix-array deduplication by merged Burrows-Wheeler transforms.

A unit of text goes if a string of so many units that covers it starts anywhere else too.  Units are bytes (BYTES: strings
of 400) or words (WORDS: passages of over 50).  Merging the transforms of shards by interleave refinement sorts all suffixes
by one more symbol a round and carries on only where suffixes of several places are still together.  Here the shards are
the tasks that read documents, and the merge keeps that plan but not its step of one symbol, which takes as many rounds
over the whole corpus as strings are long (see README):

* A shard samples its suffixes.  Of every string the sampled place is the leftmost smallest hash of `gram` units among its
  first `reach` places, so equal strings sample equal places wherever they lie.  Neighbouring strings share their sample;
  together they make a run of offsets.
* A round interleaves the samples of all shards by the context that all strings of a run have in common (`inner`).  An
  interval of one is unique and settled.  In an interval of several, runs that agree in their whole context (`outer`)
  are repeated intervals and settled as well.
* What is left, runs that agree in part, goes to the next round with its offsets cut into finer runs, of the lengths in
  `steps`; the last is 1, where inner and outer context are the same string and all is settled.

Contexts travel as 64-bit hashes, inner and outer by independent values of their units; only those of undecided runs are
read again, as snippets.  A text is worked on in windows of CHUNK units that overlap by a string, so memory does not grow
with it beyond the text itself and, for words, four numbers a word.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_VALUES, CHUNK, OTHER_BYTE_VALUES, Scratch, mix, powers, row_runs, series, signed, table, text_chunks, words_of


class Shape(NamedTuple):
    """What strings are sought: how many units long, places and units of a sample, lengths of finer runs, bytes or words."""

    length: int
    reach: int
    gram: int
    steps: tuple[int, ...]
    words: bool


LENGTH = 400
BYTES = Shape(LENGTH, 136, 16, (16, 1), False)
WORDS = Shape(51, 24, 3, (1,), True)
RUNS = "doc_id long, content long, at long, low int, high int, inner long, outer long"
_RUN_NAMES = ["doc_id", "content", "at", "low", "high", "inner", "outer"]
_OTHER = series(1, 4)


def _sums(values: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=sums[1:])
    return sums


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray | int = 0) -> np.ndarray:
    """Hashes of the strings of units [start:end]."""
    return mix((sums[end] - sums[start]) * powers(len(sums), "down")[start] + mix((end - start).astype(np.uint64) + np.asarray(seed).astype(np.uint64) * np.uint64(1 << 20)))


def _valued(units: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Two independent values of each unit."""
    return (units, mix(units ^ _OTHER)) if shape.words else (BYTE_VALUES[units], OTHER_BYTE_VALUES[units])


def unit_windows(raw: np.ndarray, offsets: np.ndarray, shape: Shape) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the first, units, offsets of rows) of a few whole rows, or of each window of a single one."""
    units = raw
    if shape.words:
        _, _, row, units = words_of(raw, offsets, lower=False)
        offsets = np.searchsorted(row, np.arange(len(offsets)))
    if len(offsets) > 2:
        yield 0, units, offsets
    else:
        for at in range(0, len(units), CHUNK):
            part = units[at : at + CHUNK + shape.length - 1]
            yield at, part, np.array([0, len(part)])


def sampled_runs(units: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """Row, place, lowest and highest offset, inner and outer hash of the runs of all strings."""
    length, reach, gram = shape[:3]
    n = np.diff(offsets) - length + 1
    n[n < 0] = 0
    row = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + offsets[row]
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    values, others = _valued(units, shape)
    sums = _sums(values)
    grams = np.arange(len(units) - gram + 1)
    order = (_hash(sums, grams, grams + gram) & np.uint64(0xFFFFFFFF00000000)) | grams.astype(np.uint64)
    order = np.append(order, np.full(-len(order) % reach + reach, np.uint64(0xFFFFFFFFFFFFFFFF))).reshape(-1, reach)
    before = np.minimum.accumulate(order, axis=1).ravel()
    after = np.minimum.accumulate(order[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(after[start], before[start + reach - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])))
    last = np.append(fresh[1:], len(start)) - 1
    row, place, high, low = row[fresh], place[fresh], place[fresh] - start[fresh], place[fresh] - start[last]
    inner = _hash(sums, place, place + length - reach + 1)
    outer = _hash(_sums(others), place - high, place - low + length, low * reach + high)
    return row, place - offsets[row], low, high, inner, outer


def _sample(shape: Shape):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, content = batch.column("doc_id"), batch.column("content")
            for first, _, raw, offsets in text_chunks(batch.column("text"), CHUNK):
                for at, units, own in unit_windows(raw, offsets, shape):
                    row, place, low, high, inner, outer = sampled_runs(units, own, shape)
                    of = pa.array(row + first)
                    yield pa.RecordBatch.from_arrays([ids.take(of), content.take(of), pa.array(place + at), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(signed(inner)), pa.array(signed(outer))], _RUN_NAMES)

    return sample


def _snippets(shape: Shape):
    def snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The whole context of each undecided run, as bytes or as 8-byte hashes of words."""
        for batch in row_runs(batches):
            for doc, content, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "content", "text", "runs")), strict=True):
                raw = text.encode()
                if shape.words:
                    raw = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=False)[3]
                for some in itertools.batched(runs, 4_096):
                    cut = [bytes(raw[r["at"] - r["high"] : r["at"] - r["low"] + shape.length]) for r in some]
                    columns = [pa.array([doc] * len(cut), pa.int64()), pa.array([content] * len(cut), pa.int64()), *(pa.array([r[c] for r in some], t) for c, t in (("at", pa.int64()), ("low", pa.int32()), ("high", pa.int32()))), pa.array(cut, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [*_RUN_NAMES[:5], "snippet"])

    return snippets


def finer_runs(low: int, high: int, step: int) -> list[tuple[int, int, int]]:
    """(block, lowest, highest offset) of the pieces of a run that lie within one block of `step` offsets."""
    return [(b, max(low, b * step), min(high, b * step + step - 1)) for b in range(low // step, high // step + 1)]


def _refine(step: int, shape: Shape):
    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of at most `step` offsets out of snippets; equal strings fall into equal blocks."""
        for batch in batches:
            doc, content, at, low, high, snippet = (batch.column(c).to_pylist() for c in [*_RUN_NAMES[:5], "snippet"])
            for some in itertools.batched(range(len(doc)), 1_024):
                units = np.frombuffer(b"".join(snippet[i] for i in some), np.uint64 if shape.words else np.uint8)
                begin, pieces = 0, []
                for i in some:
                    pieces += [(i, begin + high[i], *p) for p in finer_runs(low[i], high[i], step)]
                    begin += len(snippet[i]) // units.itemsize
                of, base, block, lo, hi = np.array(pieces, np.int64).T
                values, others = _valued(units, shape)
                inner = _hash(_sums(values), base - block * step, base - block * step - step + 1 + shape.length, block + 1)
                outer = _hash(_sums(others), base - hi, base - lo + shape.length, lo * shape.reach + hi)
                take = of.tolist()
                yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for i in take], pa.int64()) for x in (doc, content, at)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(signed(inner)), pa.array(signed(outer))], _RUN_NAMES)

    return refine


def interleaved(runs: DataFrame, scratch: Scratch, length: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """One round: the repeated spans (doc_id, content, first, end), and a run of each context that is still undecided."""
    several = scratch.keep(runs.groupBy("inner").agg(F.count("*").alias("n")).where("n > 1").select("inner"), "several")
    met = scratch.keep(runs.join(several, "inner"), "met")
    kinds = met.groupBy("inner", "outer").agg(F.count("*").alias("n"), F.min(F.struct(*_RUN_NAMES[:5])).alias("run"))
    kinds = scratch.keep(kinds, "kinds")
    same = scratch.keep(kinds.where("n > 1").select("inner", "outer"), "same")
    spans = met.join(same, ["inner", "outer"]).select("doc_id", "content", (F.col("at") - F.col("high")).alias("first"), (F.col("at") - F.col("low") + length).alias("end"))
    spans = scratch.keep(spans, "spans")
    left = None
    if not last:
        apart = scratch.keep(kinds.groupBy("inner").agg(F.count("*").alias("n")).where("n > 1").select("inner"), "apart")
        left = scratch.keep(kinds.select("inner", "run").join(apart, "inner").select("run.*"), "left")
        scratch.drop(apart)
    scratch.drop(several, met, kinds, same)
    return spans, left


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("content"))


def maximal_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, content, _dt_spans): the spans (first, end) of each text, those that touch as one, before they become one row.

    A text of one repeated letter has a span a byte and one maximal span.  Repeated rows have equal spans, which are
    brought to one before the spans of a text are sorted.
    """
    once = spans.groupBy("doc_id", "content", "first").agg(F.max("end").alias("end"))
    order = Window.partitionBy("doc_id", "content").orderBy("first")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = once.withColumn("fresh", (reached.isNull() | (F.col("first") > reached)).cast("int"))
    apart = apart.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = apart.groupBy("doc_id", "content", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return runs.groupBy("doc_id", "content").agg(F.collect_list(F.struct("first", "end")).alias("_dt_spans"))


def repeated_spans(docs: DataFrame, scratch: Scratch, shape: Shape = BYTES) -> DataFrame:
    """(_dt_id, _dt_content, _dt_spans array<struct<first, end>>): spans of units of each document that repeated strings cover.

    _dt_content is a hash of the text; rows that agree in both keys have equal texts and so equal spans.
    """
    runs = scratch.keep(keyed(docs).mapInArrow(_sample(shape), RUNS), "runs")
    spans, left = interleaved(runs, scratch, shape.length, False)
    found = [spans]
    scratch.drop(runs)
    wanted = left.groupBy("doc_id", "content").agg(F.collect_list(F.struct("at", "low", "high")).alias("runs"))
    wanted = scratch.keep(wanted.withColumnRenamed("doc_id", "_id").withColumnRenamed("content", "_content"), "wanted")
    texts = keyed(docs).join(wanted.hint("merge"), F.expr("doc_id <=> _id and content = _content")).select("doc_id", "content", "text", "runs")
    snippets = scratch.keep(texts.mapInArrow(_snippets(shape), "doc_id long, content long, at long, low int, high int, snippet binary"), "snippets")
    scratch.drop(wanted, left)
    scratch.free()
    width = 8 if shape.words else 1
    for step in shape.steps:
        finer = scratch.keep(snippets.mapInArrow(_refine(step, shape), RUNS), "runs")
        more, left = interleaved(finer, scratch, shape.length, step == shape.steps[-1])
        found.append(more)
        scratch.drop(finer)
        if left is not None:
            cut = left.select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"), F.col("at").alias("_at"), F.col("low").alias("_low"), F.col("high").alias("_high"))
            near = snippets.join(cut, F.expr("doc_id <=> _id and content = _content and at = _at and _low >= low and _high <= high"))
            piece = F.expr(f"substring(snippet, (high - _high) * {width} + 1, (_high - _low + {shape.length}) * {width})")
            wide, snippets = snippets, scratch.keep(near.select("doc_id", "content", "at", F.col("_low").alias("low"), F.col("_high").alias("high"), piece.alias("snippet")), "snippets")
            scratch.drop(wide, left)
    merged = maximal_spans(functools.reduce(DataFrame.unionByName, found))
    merged = scratch.keep(merged.withColumnRenamed("doc_id", "_dt_id").withColumnRenamed("content", "_dt_content"), "merged")
    scratch.drop(snippets, *found)
    scratch.free()
    return merged


def maximal(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Disjoint spans in order; those that touch are one."""
    out: list[tuple[int, int]] = []
    for first, end in sorted((s["first"], s["end"]) for s in spans or ()):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *itertools.chain(*spans), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to whole UTF-8 characters."""
    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    out = []
    for first, end in spans:
        while inside(first) and first < end:
            first += 1
        while inside(end) and end > first:
            end -= 1
        if first < end:
            out.append((first, end))
    return out


def passage_bytes(raw: bytes, passages: list[dict] | None) -> list[dict]:
    """Byte spans of spans of words, from the first byte of the first word to the last of the last."""
    if not passages:
        return []
    starts, ends, *_ = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=False)
    return [{"first": int(starts[a]), "end": int(ends[b - 1])} for a, b in maximal(passages)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in row_runs(batches):
        rows = []
        for doc, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
            raw, spans = (text or "").encode(), maximal(found)
            rows.append((doc, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(raw, spans)).hexdigest()))
        if not rows:
            continue
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if "passages" in batch.schema.names:
            columns.append(pa.array([sum(b - a for a, b in maximal(p)) for p in batch.column("passages").to_pylist()], pa.int64()))
            names.append("n_passage_words")
        yield pa.RecordBatch.from_arrays(columns, names)


def with_spans(docs: DataFrame, scratch: Scratch, passages: bool = False) -> DataFrame:
    """docs with `_dt_spans`, the byte spans of repeated strings, and with `_dt_passages` if asked, the word spans of passages.

    Both are null where nothing repeats.  Every row stays; null text counts as empty.
    """
    spans = repeated_spans(docs, scratch)
    added = ["_dt_spans"]
    if passages:
        other = repeated_spans(docs, scratch, WORDS).withColumnRenamed("_dt_spans", "_dt_passages")
        both = spans.unionByName(other, allowMissingColumns=True).groupBy("_dt_id", "_dt_content").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("_dt_spans", "_dt_passages")))
        spans = scratch.keep(both, "found")
        added.append("_dt_passages")
    both = docs.withColumn("_dt_own", F.xxhash64("text")).join(spans.hint("merge"), F.expr("doc_id <=> _dt_id and _dt_own = _dt_content"), "left")
    return both.select(*docs.columns, *added)


def strip_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs without repeated strings of 400 bytes, to whole characters, nor passages of over 50 words; n_chars counted again.

    A passage goes from the first byte of its first word to the last of its last, wherever it occurs; the space between
    words does not count when passages are compared.  Null texts stay null, empty ones empty; equal texts, repeated rows
    included, repeat each other and lose all strings that are long enough.  An empty table gives an empty result.
    """
    names = docs.columns

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_runs(batches):
            texts = []
            for text, found, passages in zip(*(batch.column(c).to_pylist() for c in ("text", "_dt_spans", "_dt_passages")), strict=True):
                raw = text.encode() if text and (found or passages) else b""
                spans = [{"first": a, "end": b} for a, b in whole_characters(raw, maximal(found))] + passage_bytes(raw, passages)
                texts.append(without(raw, maximal(spans)).decode() if raw else text)
            columns = {c: batch.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                columns["n_chars"] = pa.array([len(t) if t is not None else n for t, n in zip(texts, batch.column("n_chars").to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return with_spans(docs, scratch, passages=True).mapInArrow(strip, T.StructType(docs.schema.fields))


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_passage_words: how many words repeated passages of over 50 words cover, of any bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, Scratch(spark), passages=True).withColumnsRenamed({"_dt_spans": "spans", "_dt_passages": "passages"})
    return found.mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long")


QUERIES = {"op6_repeated_bytes": op6_repeated_bytes}
ORACLE: dict[str, str] = {}
