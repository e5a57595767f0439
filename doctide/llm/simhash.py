"""Operator 4, SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, so neighbours in the order differ in few bits.  Runs of the order become
nodes; a node keeps the bit pattern that its codes share and the mask of the shared bits, and nodes are grouped again
until one is left.  A search compares nodes with nodes: the shared bits on which two nodes disagree are differences that
every pair below them has, so a pair of groups with more than the radius of them is pruned whole.

To deal the index over a cluster the 64 bits are cut into five bands.  Two codes that differ in at most 3 bits agree on
two whole bands, so every pair of bands makes one table of codes, grouped by their bits there.  The ten tables are dealt
by range of (table, group, Gray rank): tasks are even however large a group is.  A group cut by a task's border leaves
blocks of codes, whose pairs are joined afterwards where their shared bits allow it.

That serves links within a few bits (`near_duplicates`, which operator 4 is).  Documents that share 0.8 of their five-word
shingles differ in about 15 of 100 bits, so `similar_duplicates`, the pipeline's stage, uses codes of 128 bits and the same
index over more tables: a table groups codes by SAMPLE bits that a fixed series picks, as many as leave about GROUP codes
together, and there are as many tables as let a pair at likeness 0.8 miss all of them once in MISS times.  Within a group
the index gives the nearest links first, as a minimum spanning forest of those within WIDE_RADIUS bits: a forest of nearest
links keeps what is connected at every radius.  Its links are then held against the exact likeness of the shingle sets, and
those of LIKENESS or more join documents.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CHUNK, Scratch, mix, series, shingles_of, signed, table, text_buffer, text_chunks, words_of
from .components import components

RADIUS = 3
WIDTH = 3
FAN = 16
BLOCK = 2_048
TASK_CODES = 250_000
_EDGES = (0, 13, 26, 39, 52, 64)
#: The bits of each pair of bands.
MASKS = [sum(((1 << _EDGES[i + 1]) - (1 << _EDGES[i])) for i in pair) for pair in itertools.combinations(range(5), 2)]
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Of the stage on five-word shingles: their width, the likeness sought, bits of a code, the radius of candidates (a pair at
#: 0.8 differs in 19 bits on average, with a standard deviation of 4), codes left together in a table, and missed pairs.
SHINGLE, LIKENESS, BITS, WIDE_RADIUS, GROUP, MISS = 5, 0.8, 128, 28, 16, 50
#: The chance that two such documents agree in one bit.
AGREE = 1 - math.acos(2 * LIKENESS / (1 + LIKENESS)) / math.pi


def fingerprint(words: list[bytes], width: int = WIDTH) -> int:
    """Bit b is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(42)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = text_buffer(batch.column("text"))
        raw = raw.tobytes()
        found = np.fromiter((fingerprint(raw[a:b].lower().split()) for a, b in itertools.pairwise(at.tolist())), np.uint64, len(batch))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array(signed(found))], ["doc_id", "content", "code"])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the sets of i and j; root[x] is the smallest member of x's set."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def near_sets(codes: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For codes sorted by (group, Gray rank): the first code of the set to which links within each group join it."""
    root = np.arange(len(codes))
    levels = [(codes, codes, None)]  # bits set in all codes of a node, bits set in any, and where its children start
    group = groups
    while len(group) and len(group) > np.count_nonzero(group[1:] != group[:-1]) + 1:
        fresh = np.ones(len(group), bool)
        fresh[1:] = group[1:] != group[:-1]
        first = np.flatnonzero(fresh)
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        starts = np.flatnonzero(place % FAN == 0)
        every, some, _ = levels[-1]
        levels.append((np.bitwise_and.reduceat(every, starts), np.bitwise_or.reduceat(some, starts), np.append(starts, len(group))))
        group = group[starts]
    top = len(levels) - 1
    waiting = [(top, np.arange(len(group)), np.arange(len(group)))] if top else []
    while waiting:
        level, a, b = waiting.pop()
        if len(a) > 4_096:
            waiting += [(level, a[k : k + 4_096], b[k : k + 4_096]) for k in range(0, len(a), 4_096)]
            continue
        starts = levels[level][2]
        wide, high = starts[a + 1] - starts[a], starts[b + 1] - starts[b]
        n = wide * high
        of = np.repeat(np.arange(len(a)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        x, y = starts[a][of] + k // high[of], starts[b][of] + k % high[of]
        level -= 1
        keep = x < y if level == 0 else x <= y
        x, y = x[keep], y[keep]
        every, some, _ = levels[level]
        differ = np.bitwise_count((every[x] & ~some[y]) | (every[y] & ~some[x]))
        near = differ <= radius
        x, y = x[near], y[near]
        if level:
            waiting.append((level, x, y))
        else:
            root = _merge(root, x, y)
    return root


LINKS = "a long, b long, t int, part long, block string, every long, some long, codes binary"
_FIELDS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("t", pa.int32()), ("part", pa.int64()), ("block", pa.string()), ("every", pa.int64()), ("some", pa.int64()), ("codes", pa.binary())])


def _rows(a: np.ndarray, b: np.ndarray, blocks: list[tuple] = ()) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(a), 65_536):
        n = len(a[k : k + 65_536])
        yield pa.RecordBatch.from_arrays([pa.array(signed(a[k : k + n])), pa.array(signed(b[k : k + n])), *(pa.nulls(n, f.type) for f in list(_FIELDS)[2:])], schema=_FIELDS)
    if blocks:
        yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS.names, (None, None, *x), strict=True)) for x in blocks], schema=_FIELDS)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within one task's stretch of the order, and the blocks of the groups that its borders may cut."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    got = pa.Table.from_batches(held)
    t, part, codes = (got.column(c).to_numpy() for c in ("t", "part", "code"))
    codes = codes.view(np.uint64)
    fresh = np.ones(len(t), bool)
    fresh[1:] = (t[1:] != t[:-1]) | (part[1:] != part[:-1])
    groups = np.cumsum(fresh)
    root = near_sets(codes, groups)
    own = np.flatnonzero(root != np.arange(len(root)))
    blocks, name = [], f"{t[0]}/{part[0]}/{codes[0]}"
    for g in {1, int(groups[-1])}:
        at = np.flatnonzero(groups == g)
        for k in range(0, len(at), BLOCK):
            own_codes = codes[at[k : k + BLOCK]]
            both = np.bitwise_and.reduce(own_codes), np.bitwise_or.reduce(own_codes)
            blocks.append((int(t[at[0]]), int(part[at[0]]), f"{name}/{g}/{k}", *(int(x.view(np.int64)) for x in both), own_codes.tobytes()))
    yield from _rows(codes[own], codes[root[own]], blocks)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x, y in zip(batch.column("codes").to_pylist(), batch.column("other").to_pylist(), strict=True):
            codes = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
            codes = codes[np.argsort(gray_rank(codes))]
            root = near_sets(codes, np.zeros(len(codes), np.int64))
            own = np.flatnonzero(root != np.arange(len(root)))
            yield from _rows(codes[own], codes[root[own]])


def near_links(codes: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect all distinct codes (code long) which differ in at most RADIUS bits."""
    rank = F.col("code")
    for k in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, k))
    ranked = scratch.keep(codes.select("code", rank.alias("rank")), "ranked")
    wide = ranked.select("code", "rank", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("code").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("part")) for t, m in enumerate(MASKS)))).alias("x"))
    dealt = wide.select("x.t", "x.part", "rank", "code").repartitionByRange(max(8, math.ceil(len(MASKS) * n / TASK_CODES)), "t", "part", "rank").sortWithinPartitions("t", "part", "rank")
    found = scratch.keep(dealt.mapInArrow(_search, LINKS), "links")
    blocks = found.where("codes is not null")
    left, right = blocks.select("t", "part", "block", "every", "some", "codes"), blocks.select("t", "part", *(F.col(c).alias(f"{c}2") for c in ("block", "every", "some")), F.col("codes").alias("other"))
    apart = F.bit_count(F.expr("(every & ~some2) | (every2 & ~some)"))
    pairs = left.join(right, ["t", "part"]).where("block < block2").where(apart <= RADIUS).select("codes", "other")
    return found.where("codes is null").select("a", "b").unionByName(pairs.mapInArrow(_across, LINKS).select("a", "b"))


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, content, code, component_id) of every row of docs (doc_id, text); content is a hash of the text.

    component_id is the smallest doc_id that links of RADIUS or fewer differing bits reach.  Null and empty texts have
    fingerprint zero, linked like any other.  Equal fingerprints are one node, so groups of copies of any size cost one
    row.  Rows without doc_id take part and get their component; an empty table gives an empty result.  Whole texts are
    read, in runs of about 2 MB; a longer one is a run of its own.
    """
    coded = docs.select("doc_id", "text", F.xxhash64("text").alias("content")).mapInArrow(fingerprints, "doc_id long, content long, code long")
    coded = scratch.keep(coded, "codes")
    nodes = scratch.keep(coded.groupBy("code").agg(F.min("doc_id").alias("first")), "nodes")
    roots = scratch.keep(components(near_links(nodes.select("code"), nodes.count(), scratch), scratch), "roots")
    member = nodes.join(roots, F.col("code") == F.col("node"), "left").select("code", "first", F.coalesce("root", "code").alias("root"))
    member = scratch.keep(member, "members")
    label = scratch.keep(member.groupBy("root").agg(F.min("first").alias("component_id")), "labels")
    named = scratch.keep(member.join(label, "root").select(F.col("code").alias("node"), "component_id"), "named")
    return coded.join(named, F.col("code") == F.col("node")).select("doc_id", "content", "code", "component_id")


def wide_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two words of 64 bits for each text: a bit is 1 if it is set in over half of the hashes of its five-word shingles."""
    for batch in batches:
        low, high = np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.uint64)
        for first, end, raw, offsets in text_chunks(batch.column("text"), CHUNK):
            _, _, row, words = words_of(raw, offsets)
            at, hashes = shingles_of(row, words, SHINGLE)
            if not len(at):
                continue
            cuts = np.searchsorted(row[at], np.arange(end - first + 1))
            filled = np.flatnonzero(np.diff(cuts))
            for into, h in ((low, hashes), (high, mix(hashes ^ _SECOND))):
                sums = _bit_sums(h, cuts[filled])
                bits = 2 * sums > np.diff(cuts)[filled][:, None]
                into[first + filled] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array(signed(low)), pa.array(signed(high))], ["doc_id", "content", "low", "high"])


_SECOND = series(1, 7)


def _bit_sums(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each run that starts at `starts` have each bit set; runs fill the array."""
    sums = np.zeros((len(starts), 64), np.int64)
    run = np.searchsorted(starts, np.arange(len(hashes)), "right") - 1
    for k in range(0, len(hashes), 65_536):
        part = run[k : k + 65_536]
        bits = np.unpackbits(hashes[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        sums[part[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return sums


def wide_tables(n: int) -> tuple[int, int]:
    """Sampled bits of a table, and how many tables n codes need."""
    bits = max(1, math.ceil(math.log2(max(2, n) / GROUP)))
    return bits, math.ceil(math.log(MISS) / -math.log1p(-(AGREE**bits)))


def sampled_bits(bits: int, tables: int) -> np.ndarray:
    """Which bits of a code each table samples, in rising order."""
    order = np.argsort(series(tables * BITS, 5).reshape(tables, BITS), axis=1)
    return np.sort(order[:, :bits], axis=1)


def _dealt(picks: np.ndarray):
    """Every code once for each table: the table, its sampled bits as a number, and the Gray rank of the rest's first word."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("low", "high")])
            rank = gray_rank(words[0])
            for t, pick in enumerate(picks):
                part = np.zeros(len(rank), np.uint64)
                for bit in pick:
                    part = (part << np.uint64(1)) | (words[bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rank), t, np.int32)), pa.array(signed(mix(part))), pa.array(signed(rank)), batch.column("low"), batch.column("high")], ["t", "part", "rank", "low", "high"])

    return deal


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def nearest_forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which links (a, b) of length d make a minimum spanning forest of n nodes, by rounds in which each tree takes its shortest."""
    tree, keep = np.arange(n), np.zeros(len(a), bool)
    order = np.lexsort((b, a, d))
    rank = np.empty(len(a), np.int64)
    rank[order] = np.arange(len(a))
    while True:
        apart = np.flatnonzero(tree[a] != tree[b])
        if not len(apart):
            return np.flatnonzero(keep)
        best = np.full(n, len(a))
        np.minimum.at(best, tree[a[apart]], rank[apart])
        np.minimum.at(best, tree[b[apart]], rank[apart])
        took = order[np.unique(best[best < len(a)])]
        keep[took] = True
        tree = _merge(tree.copy(), a[took], b[took])


def wide_forest(words: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a nearest forest within each group, for codes (rows of words) sorted by (group, Gray rank)."""
    levels = [(words, words, None)]
    group = groups
    while len(group) and len(group) > np.count_nonzero(group[1:] != group[:-1]) + 1:
        fresh = np.append(True, group[1:] != group[:-1])
        first = np.flatnonzero(fresh)
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        starts = np.flatnonzero(place % FAN == 0)
        every, some, _ = levels[-1]
        levels.append((np.bitwise_and.reduceat(every, starts, axis=0), np.bitwise_or.reduceat(some, starts, axis=0), np.append(starts, len(group))))
        group = group[starts]
    top = len(levels) - 1
    a = b = d = np.zeros(0, np.int64)
    waiting = [(top, np.arange(len(group)), np.arange(len(group)))] if top else []
    while waiting:
        level, i, j = waiting.pop()
        if len(i) > 1_024:
            waiting += [(level, i[k : k + 1_024], j[k : k + 1_024]) for k in range(0, len(i), 1_024)]
            continue
        starts = levels[level][2]
        wide, high = starts[i + 1] - starts[i], starts[j + 1] - starts[j]
        n = wide * high
        of = np.repeat(np.arange(len(i)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        x, y = starts[i][of] + k // high[of], starts[j][of] + k % high[of]
        level -= 1
        keep = x < y if level == 0 else x <= y
        x, y = x[keep], y[keep]
        every, some, _ = levels[level]
        differ = np.bitwise_count((every[x] & ~some[y]) | (every[y] & ~some[x])).sum(axis=1, dtype=np.int64)
        near = differ <= radius
        x, y = x[near], y[near]
        if level:
            waiting.append((level, x, y))
        elif len(x):
            a, b, d = np.append(a, x), np.append(b, y), np.append(d, differ[near])
            if len(a) > 1_000_000 and len(a) > 4 * len(words):  # the forest so far and what came since have the same forest
                kept = nearest_forest(len(words), a, b, d)
                a, b, d = a[kept], b[kept], d[kept]
    kept = nearest_forest(len(words), a, b, d)
    return a[kept], b[kept]


WIDE_LINKS = "a_low long, a_high long, b_low long, b_high long, t int, part long, block string, codes binary"


def _wide_rows(a: np.ndarray, b: np.ndarray, blocks: list[tuple] = ()) -> Iterator[pa.RecordBatch]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in WIDE_LINKS.split(", "))])
    for k in range(0, len(a), 65_536):
        x, y = a[k : k + 65_536], b[k : k + 65_536]
        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(signed(np.ascontiguousarray(z[:, i])))) for z in (x, y) for i in (0, 1)), *(pa.nulls(len(x), f.type) for f in list(schema)[4:])], schema=schema)
    if blocks:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (None, None, None, None, *x), strict=True)) for x in blocks], schema=schema)


def _wide_search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests within one task's stretch of the order, and the codes of groups that its borders may cut, in blocks."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    got = pa.Table.from_batches(held)
    t, part, low, high = (got.column(c).to_numpy() for c in ("t", "part", "low", "high"))
    words = np.stack([low, high], axis=1).view(np.uint64)
    fresh = np.append(True, (t[1:] != t[:-1]) | (part[1:] != part[:-1]))
    groups = np.cumsum(fresh)
    a, b = wide_forest(words, groups, WIDE_RADIUS)
    blocks, name = [], f"{t[0]}/{part[0]}/{low[0]}/{high[0]}"
    for g in {1, int(groups[-1])}:
        at = np.flatnonzero(groups == g)
        blocks += [(int(t[at[0]]), int(part[at[0]]), f"{name}/{g}/{k}", words[at[k : k + BLOCK]].tobytes()) for k in range(0, len(at), BLOCK)]
    yield from _wide_rows(words[a], words[b], blocks)


def _wide_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x, y in zip(batch.column("codes").to_pylist(), batch.column("other").to_pylist(), strict=True):
            words = np.concatenate([np.frombuffer(z, np.uint64).reshape(-1, 2) for z in (x, y)])
            words = words[np.argsort(gray_rank(words[:, 0]), kind="stable")]
            a, b = wide_forest(words, np.zeros(len(words), np.int64), WIDE_RADIUS)
            yield from _wide_rows(words[a], words[b])


def wide_links(codes: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """Distinct links (a_low, a_high, b_low, b_high) of the nearest forests of all tables; codes (low, high) are distinct."""
    bits, tables = wide_tables(n)
    dealt = codes.mapInArrow(_dealt(sampled_bits(bits, tables)), "t int, part long, rank long, low long, high long")
    dealt = dealt.repartitionByRange(max(8, math.ceil(tables * n / TASK_CODES)), "t", "part", "rank", "low", "high").sortWithinPartitions("t", "part", "rank", "low", "high")
    found = scratch.keep(dealt.mapInArrow(_wide_search, WIDE_LINKS), "wide")
    blocks = found.where("codes is not null")
    pairs = blocks.select("t", "part", "block", "codes").join(blocks.select("t", "part", F.col("block").alias("block2"), F.col("codes").alias("other")), ["t", "part"]).where("block < block2")
    ends = ("a_low", "a_high", "b_low", "b_high")
    every = found.where("codes is null").select(*ends).unionByName(pairs.select("codes", "other").mapInArrow(_wide_across, WIDE_LINKS).select(*ends))
    first = F.expr("a_low < b_low or (a_low = b_low and a_high <= b_high)")
    return every.select(*(F.when(first, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in zip(ends, (*ends[2:], *ends[:2]), strict=True))).distinct()


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct five-word shingles of each text as sorted 64-bit hashes; texts with one set have equal ones."""
    for batch in batches:
        for first, end, raw, offsets in text_chunks(batch.column("text"), CHUNK):
            _, _, row, words = words_of(raw, offsets)
            at, hashes = shingles_of(row, words, SHINGLE)
            cuts = np.searchsorted(row[at], np.arange(end - first + 1))
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in itertools.pairwise(cuts.tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, end - first) for c in ("doc_id", "content", "low", "high")), pa.array(sets, pa.binary())], ["doc_id", "content", "low", "high", "shingles"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links whose shingle sets have LIKENESS or more in common."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            every = len(a) + len(b) - both
            keep.append(both >= LIKENESS * every)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])


def similar_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, content, node, component_id) of every row of docs (doc_id, text); content is a hash of the text.

    Documents of equal five-word shingle sets are one node; nodes that a candidate link joins and whose sets are alike by
    LIKENESS or more are one component, and component_id is its smallest doc_id.  Words are lower-cased (A-Z); a text of fewer
    than five words has one shingle, the whole sequence; texts without words, null ones included, are alike.  Rows without
    doc_id take part and get their component; an empty table gives an empty result.  Codes that equal another's are linked by
    a chain, so copies cost one row each.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("content"))
    coded = scratch.keep(keyed.mapInArrow(wide_codes, "doc_id long, content long, low long, high long"), "wide-codes")
    # one text of each content stands for all
    texts = coded.groupBy("content").agg(F.first("low").alias("low"), F.first("high").alias("high"))
    codes = scratch.keep(coded.select("low", "high").distinct(), "codes")
    links = scratch.keep(wide_links(codes, codes.count(), scratch), "wide-links")
    scratch.free()
    ends = links.select(F.col("a_low").alias("low"), F.col("a_high").alias("high")).unionByName(links.select(F.col("b_low").alias("low"), F.col("b_high").alias("high"))).distinct()
    several = texts.groupBy("low", "high").agg(F.count("*").alias("n")).where("n > 1").select("low", "high")
    met = scratch.keep(texts.join(ends.unionByName(several).distinct(), ["low", "high"]), "met")
    # nodes are contents; those of one code are a chain in order of content
    order = Window.partitionBy("low", "high").orderBy("content")
    chain = met.select(F.lag("content").over(order).alias("a"), F.col("content").alias("b")).where("a is not null")
    first = met.groupBy("low", "high").agg(F.min("content").alias("node"))
    joined = links.join(first.select(F.col("low").alias("a_low"), F.col("high").alias("a_high"), F.col("node").alias("a")), ["a_low", "a_high"]).join(first.select(F.col("low").alias("b_low"), F.col("high").alias("b_high"), F.col("node").alias("b")), ["b_low", "b_high"]).select("a", "b")
    pairs = scratch.keep(chain.unionByName(joined).distinct(), "pairs")
    wanted = met.select(F.col("content").alias("_dt_content"))
    own = keyed.select("text", "content").join(wanted.hint("merge"), F.expr("content = _dt_content"), "left_semi").select(F.lit(0).cast("long").alias("doc_id"), "content", "text", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    sets = own.mapInArrow(_shingle_sets, "doc_id long, content long, low long, high long, shingles binary").groupBy("content").agg(F.first("shingles").alias("shingles"))
    sets = scratch.keep(sets, "shingles")
    both = pairs.join(sets.select(F.col("content").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("content").alias("b"), F.col("shingles").alias("y")), "b")
    alike = scratch.keep(both.select("a", "b", "x", "y").mapInArrow(_alike, "a long, b long"), "alike")
    scratch.drop(sets, met, links)
    scratch.free()
    roots = scratch.keep(components(alike, scratch), "roots")
    member = coded.groupBy("content").agg(F.min("doc_id").alias("first")).join(roots, F.col("content") == F.col("node"), "left").select("content", "first", F.coalesce("root", "content").alias("root"))
    member = scratch.keep(member, "members")
    label = scratch.keep(member.groupBy("root").agg(F.min("first").alias("component_id")), "labels")
    named = scratch.keep(member.join(label, "root").select(F.col("content").alias("_dt_named"), F.col("root").alias("node"), "component_id"), "named")
    return coded.join(named, F.col("content") == F.col("_dt_named")).select("doc_id", "content", "node", "component_id")


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, groups=None) -> DataFrame:
    """One row of each group of near-duplicates (of `near_duplicates` unless told): that of the smallest doc_id, its first row
    if that repeats.

    Different texts under one doc_id are different documents and stay if theirs is the smallest of the group.  Rows
    without doc_id cannot be told apart and stay as well.
    """
    groups = (groups or near_duplicates)(docs, scratch).where("doc_id = component_id").groupBy("doc_id", "content").agg(F.count("*").alias("n"))
    kept = scratch.keep(groups.withColumnRenamed("doc_id", "_dt_id").withColumnRenamed("content", "_dt_content"), "kept")
    own = F.expr("doc_id = _dt_id and xxhash64(text) = _dt_content")
    # texts meet their verdicts by the same sort-merge join at every size, so that small runs tell what large ones cost
    out = docs.join(kept.where("n = 1").hint("merge"), own, "left_semi")
    again = kept.where("n > 1")
    if not again.isEmpty():
        out = out.unionByName(docs.join(again, own, "left_semi").dropDuplicates(["doc_id", "text"]))
    unnamed = docs.where("doc_id is null")
    return out if unnamed.isEmpty() else out.unionByName(unnamed)


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))
    return out.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash_components": op4_simhash_components}
ORACLE: dict[str, str] = {}
