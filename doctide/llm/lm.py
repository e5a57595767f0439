"""Operator 9, LM scoring with a hierarchical Pitman-Yor model.

Each context word has a restaurant whose customers are the words that follow it; they share one parent restaurant of
words without context.  A new table in a context's restaurant sends one customer to the parent.  Gibbs sweeps seat the
customers of every dish again, given the tables of all others; predictive probabilities use the table counts averaged
over the sweeps that are kept, so they still sum to one.  The parent's base is diffuse: there each word has one table and
what its discounts free is the probability of a word that training never saw.

All statistics cover all training documents, and every pair of words has its seats, in tables that grow with the corpus.
A pair seen once has one table whatever is drawn, so the sweeps carry pairs seen more often.

Texts are read twice: to count words, and in chunks of about CHUNK_TOKENS to list the distinct pairs of each chunk.  Those
lists are dealt by parts of the pairs, about PART_TOKENS tokens each, and serve both ways: training adds up their counts,
and once seats are drawn each part answers the same lists with the customers that stay after discount.  A chunk's answers
meet its texts, kept as numbers of pairs, and give their scores.  A list is sorted numbers, compressed, so a pair costs a few
bytes.  Only words that hold at least one 2^WORD_BITS-th of all tokens are sent to every task (so at most 2^WORD_BITS); pairs
of them are numbers, pairs with a rarer word belong to the part of that word.  So no key is hot: the rarer word is rare, and
pairs of frequent words are dealt by pair.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix, signed, table, text_chunks, words_of

WORD_BITS = 20
CHUNK_TOKENS, PART_TOKENS = 1 << 20, 1 << 19
SWEEPS, BURN_IN = 4, 1
STRENGTH = 1.0
CONTEXT_DISCOUNT = 0.75
#: Stands for the end of a text, and for what precedes its first word.
END = np.uint64(0x5D588B656C078965)
#: What is rare in a pair that is not of two frequent words: its token, its context, or both.
TOKEN, CONTEXT, BOTH = 0, 1, 2


def token_stream(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, token and the token before it, for all words of each text and its end."""
    _, _, row, words = words_of(raw, offsets)
    n = len(offsets) - 1
    at = np.arange(len(words)) + row
    rows, tokens = np.empty(len(words) + n, np.int64), np.full(len(words) + n, END, np.uint64)
    rows[at], tokens[at] = row, words
    ends = np.cumsum(np.bincount(row, minlength=n) + 1) - 1
    rows[ends] = np.arange(n)
    before = np.roll(tokens, 1)
    before[np.append(0, ends[:-1] + 1)] = END
    return rows, tokens, before


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(c) if c.dtype == np.uint64 else c) for c in columns.values()], list(columns))


def _tallied(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of columns once, with their counts added; the first column tells nearly all rows apart."""
    order = np.argsort(columns[0])
    columns = [c[order] for c in columns]
    first = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))
    return [c[first] for c in columns], np.add.reduceat(counts[order], first)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of tokens, flushed whenever they pass a million entries."""
    held: list[tuple[list[np.ndarray], np.ndarray]] = []

    def rows() -> Iterator[pa.RecordBatch]:
        (keys,), counts = _tallied([np.concatenate([k for (k,), _ in held])], np.concatenate([n for _, n in held]))
        for k in range(0, len(counts), 262_144):
            yield _batch(key=keys[k : k + 262_144], n=counts[k : k + 262_144])

    for batch in batches:
        for _, _, raw, offsets in text_chunks(batch.column("text")):
            _, tokens, _ = token_stream(raw, offsets)
            held.append(_tallied([tokens], np.ones(len(tokens), np.int64)))
        if sum(len(n) for _, n in held) > 1_000_000:
            yield from rows()
            held.clear()
    if held:
        yield from rows()


def squeezed(values: np.ndarray) -> bytes:
    """Numbers of 4 or 8 bytes, compressed with bytes of the same weight together."""
    wide = values.view(np.uint8).reshape(len(values), values.itemsize)
    return pa.compress(np.ascontiguousarray(wide.T).tobytes(), codec="zstd", asbytes=True)


def unsqueezed(blob: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=size * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def rising(values: np.ndarray) -> bytes:
    """Mostly rising numbers as their differences."""
    return squeezed(np.diff(values, prepend=values.dtype.type(0)))


def risen(blob: bytes, n: int, kind: type) -> np.ndarray:
    return np.cumsum(unsqueezed(blob, n, kind), dtype=kind)


def find(table_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted table, -1 if it is not there."""
    if not len(table_):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table_, keys), len(table_) - 1)
    return np.where(table_[at] == keys, at, -1)


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    return ((mix(key + mix(np.full(1, step, np.uint64))) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def seated(customers: np.ndarray, rate: np.ndarray, discount: float, key: np.ndarray, seed: int) -> np.ndarray:
    """Tables that each dish's customers fill one after another; a new one with odds rate : customers - discount * tables.

    The first 256 customers are drawn one by one, later ones in growing groups, from the Poisson law (normal above a mean of
    20) that the chance of a new table has in a group.  Draws depend on key and seed alone, so reruns agree.
    """
    tables, n = np.ones(len(customers)), 1
    every, whole = np.ones(len(customers)), customers
    at = np.arange(len(customers))
    while len(more := np.flatnonzero(customers > n)):
        # dishes whose customers all sit are done
        every[at] = tables
        at, customers, rate, key, tables = at[more], customers[more], rate[more], key[more], tables[more]
        group = 1 if n < 256 else n // 8
        some = np.clip(customers - n, 0, group)
        chance = rate / (rate + (n + (some - 1).clip(0) / 2) - discount * tables)
        u = uniform(key, seed * 1_000_003 + n)
        if group == 1:
            tables += (u < chance) * some
        else:
            mean = some * chance
            normal = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * uniform(key, seed * 1_000_003 + n + 1))
            new = np.maximum(0, np.round(mean + np.sqrt(mean) * normal))
            small = mean <= 20
            term = np.exp(-mean[small])
            total, count = term.copy(), np.zeros(len(term))
            for k in range(1, 80):
                count += u[small] > total
                term = term * mean[small] / k
                total += term
            new[small] = count
            tables = np.minimum(tables + np.minimum(new, some), n + some)
        n += group
    every[at] = tables
    return np.minimum(every, whole)


ASKED = (
    "chunk long, part int, near_n int, near_keys binary, near_counts binary, far_n int, far_rare binary, far_kind binary, far_other binary, far_counts binary, "
    "pairs binary, doc_ids array<long>, held_out array<boolean>, lengths array<long>"
)


class Chunk:
    """Texts of up to about CHUNK_TOKENS tokens: which pairs each has, and the distinct pairs of all dealt by part."""

    def __init__(self):
        self.size, self.ids, self.held_out, self.lengths = 0, [], [], []
        self.row, self.learned, self.near, self.rare, self.kind, self.other = ([] for _ in range(6))

    def add(self, words: np.ndarray, ids: list, held_out: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> None:
        row, tokens, before = token_stream(raw, offsets)
        a, b = find(words, signed(before)), find(words, signed(tokens))
        far = (a < 0) | (b < 0)
        self.near.append(np.where(far, -1, (a << WORD_BITS) | b))
        self.kind.append(np.where(b >= 0, CONTEXT, np.where(a >= 0, TOKEN, BOTH))[far].astype(np.uint64))
        self.rare.append(np.where(b >= 0, before, tokens)[far])
        self.other.append(np.where(b >= 0, b.astype(np.uint64), np.where(a >= 0, a.astype(np.uint64), before))[far])
        self.row.append((row + len(self.ids)).astype(np.uint32))
        self.learned.append(~held_out[row])
        self.lengths.append(np.bincount(row, minlength=len(ids)))
        self.ids += ids
        self.held_out.append(held_out)
        self.size += len(row)

    def rows(self, number: int, parts: int) -> list[dict]:
        near, rare, kind, other, row, learned = (np.concatenate(x) for x in (self.near, self.rare, self.kind, self.other, self.row, self.learned))
        self.near = self.rare = self.kind = self.other = self.row = self.learned = None
        place = np.empty(len(near), np.uint32)
        at = np.flatnonzero(near >= 0)
        keys, of = np.unique(near[at], return_inverse=True)
        order = np.argsort(keys % parts, kind="stable")
        keys, place[at], counts = self._placed(keys, of, order, learned[at], 0)
        far = np.flatnonzero(near < 0)
        _, first, of = np.unique(mix(mix(rare + kind) + other), return_index=True, return_inverse=True)
        rare, kind, other = rare[first], kind[first], other[first]
        part = np.mod(signed(rare), parts)
        order = np.lexsort((other, kind, rare, part))
        rare, place[far], far_counts = self._placed(rare, of, order, learned[far], len(keys))
        kind, other, part = kind[order], other[order], part[order]
        cuts = [np.searchsorted(x, np.arange(parts + 1)) for x in (keys % parts, part)]
        out = []
        for k in range(parts):
            a, b, c, d = cuts[0][k], cuts[0][k + 1], cuts[1][k], cuts[1][k + 1]
            if b > a or d > c:
                out.append(
                    {"chunk": number, "part": k, "near_n": b - a, "near_keys": rising(keys[a:b]), "near_counts": squeezed(counts[a:b]), "far_n": d - c, "far_rare": rising(rare[c:d]), "far_kind": squeezed(kind[c:d]), "far_other": squeezed(other[c:d]), "far_counts": squeezed(far_counts[c:d])}
                )
        place = place[np.argsort(row.astype(np.uint64) << np.uint64(32) | place)]
        lengths, held_out = np.concatenate(self.lengths), np.concatenate(self.held_out)
        out.append({"chunk": number, "part": -1, "pairs": rising(place), "doc_ids": self.ids, "held_out": held_out.tolist(), "lengths": lengths.tolist()})
        return out

    @staticmethod
    def _placed(keys: np.ndarray, of: np.ndarray, order: np.ndarray, learned: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, the place of each occurrence from base on, and how often training documents have each key."""
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        of = rank[of.ravel()]
        return keys[order], of + base, np.bincount(of[learned], minlength=len(keys)).astype(np.uint64)


def _ask(held, parts: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = held.value[0], TaskContext.get().partitionId() << 32
        chunk = Chunk()

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(chunk.rows(number, parts), schema=_schema_of(ASKED))

        for batch in batches:
            for first, end, raw, offsets in text_chunks(batch.column("text")):
                took = batch.slice(first, end - first)
                chunk.add(words, took.column("doc_id").to_pylist(), took.column("held_out").to_numpy(zero_copy_only=False).astype(bool), raw, offsets)
                if chunk.size >= CHUNK_TOKENS:
                    yield flushed()
                    number, chunk = number + 1, Chunk()
        if chunk.size:
            yield flushed()

    return ask


class Asked:
    """The lists of one part, decoded: distinct pairs with their counts in training, and the place of each list's pairs."""

    def __init__(self, lists: list[dict]):
        near = [risen(r["near_keys"], r["near_n"], np.int64) for r in lists]
        self.far = [(risen(r["far_rare"], r["far_n"], np.uint64), unsqueezed(r["far_kind"], r["far_n"], np.uint64), unsqueezed(r["far_other"], r["far_n"], np.uint64)) for r in lists]
        self.cuts = [np.cumsum([0, *(r[n] for r in lists)]) for n in ("near_n", "far_n")]
        self.near, of = np.unique(np.concatenate(near), return_inverse=True)
        self.near_of, self.near_c = self._counted(of, lists, "near", len(self.near))
        rare, kind, other = (np.concatenate(x) for x in zip(*self.far, strict=True))
        self.key, first, of = np.unique(mix(mix(rare + kind) + other), return_index=True, return_inverse=True)
        self.rare, self.kind, self.other = rare[first], kind[first], other[first]
        self.far_of, self.far_c = self._counted(of, lists, "far", len(self.key))

    @staticmethod
    def _counted(of: np.ndarray, lists: list[dict], name: str, size: int) -> tuple[np.ndarray, np.ndarray]:
        counts = np.concatenate([unsqueezed(r[f"{name}_counts"], r[f"{name}_n"], np.uint64) for r in lists]).astype(np.float64)
        return of.ravel(), np.bincount(of.ravel(), counts, size).astype(np.int64)


PAIRS = "part int, near_n int, near_keys binary, near_c binary, near_t binary, near_tables binary, far_n int, far_rare binary, far_kind binary, far_other binary, far_c binary"


def _counted(group: pa.Table) -> pa.Table:
    """Pairs of one part that training has more than once, each on a table of its own."""
    asked = Asked(group.to_pylist())
    a, b = asked.near_c > 1, np.flatnonzero(asked.far_c > 1)
    b = b[np.argsort(asked.rare[b])]
    n, c = int(a.sum()), asked.near_c[a]
    row = {
        "part": group.column("part")[0].as_py(), "near_n": n, "near_keys": rising(asked.near[a]), "near_c": squeezed(c), "near_t": squeezed(c.astype(np.float64)), "near_tables": squeezed(np.zeros(n)),
        "far_n": len(b), "far_rare": rising(asked.rare[b]), "far_kind": squeezed(asked.kind[b]), "far_other": squeezed(asked.other[b]), "far_c": squeezed(asked.far_c[b]),
    }
    return pa.Table.from_pylist([row], schema=_schema_of(PAIRS))


def _schema_of(names: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in names.split(", "))])


NEAR = PAIRS.split(", far_n")[0]
FAR = "part int, key long, kind int, other long, c long"


def _far_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            n = r["far_n"]
            yield _batch(part=np.full(n, r["part"], np.int32), key=risen(r["far_rare"], n, np.uint64), kind=unsqueezed(r["far_kind"], n, np.uint64).astype(np.int32), other=unsqueezed(r["far_other"], n, np.uint64), c=unsqueezed(r["far_c"], n, np.int64))


SUMS = "place int, word long, joined double, tables double, customers double"


def _sums(place: np.ndarray, word: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return _batch(**dict(zip(("place", "word", "joined", "tables", "customers"), (place.astype(np.int32), word, *sums), strict=True)))


def _near_sums(size: int, value: str):
    """What pairs of frequent words add to words: customers that joined a table, to the token; tables and customers, to the
    context.  place is that of a frequent word, -1 for others."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros((3, size))
        for batch in batches:
            for r in batch.to_pylist():
                key, c, t = risen(r["near_keys"], r["near_n"], np.int64), unsqueezed(r["near_c"], r["near_n"], np.int64), unsqueezed(r[value], r["near_n"], np.float64)
                head[0] += np.bincount(key & ((1 << WORD_BITS) - 1), c - t, size)
                head[1] += np.bincount(key >> WORD_BITS, t, size)
                head[2] += np.bincount(key >> WORD_BITS, c, size)
        some = np.flatnonzero(head.any(axis=0))
        yield _sums(some, np.zeros(len(some), np.int64), head[:, some])

    return add


def _far_sums(size: int, value: str):
    """The same of pairs with a rarer word, added up for each batch."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros((3, size))
        for batch in batches:
            key, kind, other, c, t = (batch.column(x).to_numpy() for x in ("key", "kind", "other", "c", value))
            context, token = kind == TOKEN, kind == CONTEXT  # frequent
            head[0] += np.bincount(other[token], (c - t)[token], size)
            head[1] += np.bincount(other[context], t[context], size)
            head[2] += np.bincount(other[context], c[context], size)
            word, of = np.unique(np.concatenate([key[~token], np.where(kind == BOTH, other, key)[~context]]), return_inverse=True)
            of, n = of.ravel(), int((~token).sum())
            sums = np.zeros((3, len(word)))
            sums[0] = np.bincount(of[:n], (c - t)[~token], len(word))
            sums[1] = np.bincount(of[n:], t[~context], len(word))
            sums[2] = np.bincount(of[n:], c[~context], len(word))
            yield _sums(np.full(len(word), -1), word, sums)
        some = np.flatnonzero(head.any(axis=0))
        yield _sums(some, np.zeros(len(some), np.int64), head[:, some])

    return add


FAR_SEATS = "part int, key long, kind int, other long, c long, c_key long, c_other long, t double, tables double"


class Model:
    """What training leaves: counts, parent probabilities and shares of frequent words as arrays, of others in the table
    `rare` (word, c, parent, share), the tables `near` and `far` of the seats of pairs seen more than once, and what words never
    seen share."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, kinds: int):
        self.words, self.counts, self.total, self.kinds = words, counts, total, kinds
        self.joined, self.inverse = np.zeros(len(words)), 0.0
        self.parent, self.share = np.zeros(len(words)), np.ones(len(words))


def _head(sums: DataFrame, size: int) -> np.ndarray:
    some = sums.where("place >= 0").select("place", "joined", "tables", "customers").toPandas()
    head = np.zeros((3, size))
    head[:, some["place"]] = some[["joined", "tables", "customers"]].to_numpy(float).T
    return head


def seat_all(pairs: DataFrame, model: Model, words: DataFrame, discount: float, scratch: Scratch) -> None:
    """Gibbs sweeps over pairs (PAIRS); leaves seats, parents and shares in the model."""
    spark, inner, size = pairs.sparkSession, CONTEXT_DISCOUNT, len(model.words)
    count_of = lambda name: words.select(F.col("key").alias(name), F.col("c").alias(f"c_{name}"))
    near = pairs.select(*(c.split()[0] for c in NEAR.split(", ")))
    each = scratch.keep(pairs.select("part", "far_n", "far_rare", "far_kind", "far_other", "far_c").mapInArrow(_far_rows, FAR), "far").join(count_of("key"), "key")
    both = each.where(F.col("kind") == BOTH).join(count_of("other"), "other")
    far = each.where(F.col("kind") < BOTH).withColumn("c_other", F.lit(None).cast("long")).unionByName(both)
    far = scratch.keep(far.withColumns({"t": F.col("c").cast("double"), "tables": F.lit(0.0)}), "far")

    def totals(value: str) -> DataFrame:
        each = near.mapInArrow(_near_sums(size, f"near_{value}"), SUMS).unionByName(far.mapInArrow(_far_sums(size, value), SUMS))
        return scratch.keep(each.groupBy("place", "word").agg(*(F.sum(c).alias(c) for c in ("joined", "tables", "customers"))), "sums")

    rare_joined = []
    for sweep in range(SWEEPS):
        sums = totals("t")
        mass = model.total - (sums.agg(F.sum("joined")).first()[0] or 0.0)
        head = _head(sums, size)
        kept = (sweep >= BURN_IN) / (SWEEPS - BURN_IN)
        model.inverse += kept / (STRENGTH + mass)
        model.joined += kept / (STRENGTH + mass) * head[0]
        sent = spark.sparkContext.broadcast((model.counts - head[0], model.counts + head[1] - head[2]))

        def again(c, open_, free, key, sweep=sweep, mass=mass):
            """Tables of pairs: open_ is the token's count without customers that joined a table, free the context's tables."""
            parent = (open_ - discount).clip(1e-9) / (STRENGTH + mass)
            return seated(c, (STRENGTH + inner * free) * parent, inner, key, sweep)

        def seat_near(batches: Iterator[pa.RecordBatch], kept: float = kept, sent=sent, again=again) -> Iterator[pa.RecordBatch]:
            open_, free = sent.value
            for batch in batches:
                rows = batch.to_pylist()
                for r in rows:
                    n = r["near_n"]
                    key, c = risen(r["near_keys"], n, np.int64), unsqueezed(r["near_c"], n, np.int64)
                    t = again(c, open_[key & ((1 << WORD_BITS) - 1)], free[key >> WORD_BITS], mix(key.view(np.uint64)))
                    r["near_t"], r["near_tables"] = squeezed(t), squeezed(unsqueezed(r["near_tables"], n, np.float64) + kept * t)
                yield pa.RecordBatch.from_pylist(rows, schema=_schema_of(NEAR))

        def seat_far(batches: Iterator[pa.RecordBatch], kept: float = kept, sent=sent, again=again) -> Iterator[pa.RecordBatch]:
            head_open, head_free = sent.value
            for batch in batches:
                x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
                kind, other = x["kind"], x["other"]
                open_, free = (x["c_key"] - x["joined"]).astype(float), x["free"].copy()
                open_[kind == CONTEXT] = head_open[other[kind == CONTEXT]]
                free[kind == TOKEN] = head_free[other[kind == TOKEN]]
                t = again(x["c"], open_, free, mix(mix(x["key"].view(np.uint64) + kind.astype(np.uint64)) + other.view(np.uint64)))
                names = [c.split()[0] for c in FAR_SEATS.split(", ")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-2]), pa.array(t), pa.array(x["tables"] + kept * t)], names)

        rare = sums.where("place < 0")
        apart = F.col("tables") - F.col("customers")
        one = far.where(F.col("kind") < BOTH).join(rare.select(F.col("word").alias("key"), "joined", apart.alias("free")), "key").withColumn("free", F.col("c_key") + F.col("free"))
        two = far.where(F.col("kind") == BOTH).join(rare.select(F.col("word").alias("key"), "joined"), "key").join(rare.select(F.col("word").alias("other"), apart.alias("free")), "other").withColumn("free", F.col("c_other") + F.col("free"))
        was = near, far
        near, far = scratch.keep(near.mapInArrow(seat_near, NEAR), "near"), scratch.keep(one.unionByName(two).mapInArrow(seat_far, FAR_SEATS), "far")
        if kept:
            rare_joined.append(scratch.keep(rare.select(F.col("word").alias("key"), (F.col("joined") * (kept / (STRENGTH + mass))).alias("joined")), "joined"))
        scratch.drop(sums, was[1], *(was[:1] if sweep else []))
        del one, two, rare, was, sums
        scratch.free()
    sums = totals("tables")
    _, tables, customers = _head(sums, size)
    model.parent = (model.counts - discount) * model.inverse - model.joined
    model.share = (STRENGTH + inner * (model.counts + tables - customers)) / (STRENGTH + model.counts)
    shared = rare_joined[0]
    for more in rare_joined[1:]:
        shared = shared.unionByName(more)
    shared = shared.groupBy("key").agg(F.sum("joined").alias("joined"))
    less = sums.where("place < 0").select(F.col("word").alias("key"), (F.col("tables") - F.col("customers")).alias("less"))
    few = words.where(F.col("c") < model.total / (1 << WORD_BITS)).join(shared, "key", "left").join(less, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    model.rare = scratch.keep(
        few.select(F.col("key").alias("word"), "c", ((F.col("c") - discount) * model.inverse - zero("joined")).alias("parent"), ((STRENGTH + inner * (F.col("c") + zero("less"))) / (STRENGTH + F.col("c"))).alias("share")), "rare"
    )
    scratch.drop(sums, *rare_joined)
    model.near, model.far = near, far
    model.unseen = (STRENGTH + discount * model.kinds) * model.inverse


def trained(keyed: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame, int]:
    """The model of the rows of keyed (doc_id, text, held_out) that are not held out, the lists of all chunks, and the parts."""
    spark = keyed.sparkSession
    words = keyed.where(~F.col("held_out")).select("text").mapInArrow(_count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("c"))
    words = scratch.keep(words, "words")
    total, kinds, ones, twos = (x or 0 for x in words.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first())
    discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
    few = words.where(F.col("c") >= total / (1 << WORD_BITS)).toPandas().sort_values("key")
    model = Model(few["key"].to_numpy(np.int64), few["c"].to_numpy(np.int64), total, kinds)
    parts = max(1, math.ceil(total / PART_TOKENS))
    asked = scratch.keep(keyed.mapInArrow(_ask(spark.sparkContext.broadcast((model.words,)), parts), ASKED), "asked")
    lists = asked.where("part >= 0").select("part", *(f"{a}_{b}" for a, names in (("near", ("n", "keys", "counts")), ("far", ("n", "rare", "kind", "other", "counts"))) for b in names))
    pairs = scratch.keep(lists.groupBy("part").applyInArrow(_counted, PAIRS), "pairs")
    del lists
    scratch.free()
    seat_all(pairs, model, words, discount, scratch)
    scratch.drop(words, pairs)
    scratch.free()
    return model, asked, parts


REPLIES = "chunk long, part int, near_left binary, far_left binary, words_c binary, words_parent binary, words_share binary"
HELD = "part int, near_n int, near_keys binary, near_tables binary, which int, key long, kind int, other long, c long, x double, share double"


def _reply(unseen: float):
    """Answers to the lists of a part: of each pair the customers left after discount, of each rare word its count, parent and share."""

    def left_of(counts: np.ndarray, at: np.ndarray, tables: np.ndarray) -> np.ndarray:
        seats = np.where(counts > 0, 1.0, 0.0)
        if len(tables):
            seats = np.where(at >= 0, tables[at], seats)
        return (counts - CONTEXT_DISCOUNT * seats).astype(np.float32)

    def reply(lists: pa.Table, held: pa.Table) -> pa.Table:
        rows = lists.to_pylist()
        if not rows:
            return pa.Table.from_pylist([], schema=_schema_of(REPLIES))
        asked = Asked(rows)
        which, key, kind, other, c, x, share = (held.column(n).to_numpy() for n in ("which", "key", "kind", "other", "c", "x", "share"))
        far, word = (np.flatnonzero(which == k) for k in (1, 2))
        own = mix(mix(key[far].view(np.uint64) + kind[far].astype(np.uint64)) + other[far].view(np.uint64))
        far, own = far[np.argsort(own)], np.sort(own)
        word = word[np.argsort(key[word].view(np.uint64))]
        near, tables = np.zeros(0, np.int64), np.zeros(0)
        for r in held.filter(pa.array(which == 0)).to_pylist():
            near, tables = risen(r["near_keys"], r["near_n"], np.int64), unsqueezed(r["near_tables"], r["near_n"], np.float64)
        near_left = left_of(asked.near_c, find(near, asked.near), tables)
        far_left = left_of(asked.far_c, find(own, asked.key), x[far])
        out = []
        for k, row in enumerate(rows):
            a, b, d, e = asked.cuts[0][k], asked.cuts[0][k + 1], asked.cuts[1][k], asked.cuts[1][k + 1]
            rare = asked.far[k][0]
            mine = rare[np.append(True, rare[1:] != rare[:-1])] if len(rare) else rare
            at = find(key[word].view(np.uint64), mine)
            known = at >= 0
            got = [np.zeros(len(mine), np.int64), np.full(len(mine), unseen), np.ones(len(mine))]
            for into, column in zip(got, (c, x, share), strict=True):
                into[known] = column[word[at[known]]]
            out.append(
                {"chunk": row["chunk"], "part": row["part"], "near_left": squeezed(near_left[asked.near_of[a:b]]), "far_left": squeezed(far_left[asked.far_of[d:e]])}
                | {"words_c": squeezed(got[0]), "words_parent": squeezed(got[1].astype(np.float32)), "words_share": squeezed(got[2].astype(np.float32))}
            )
        return pa.Table.from_pylist(out, schema=_schema_of(REPLIES))

    return reply


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(sent):
    """Scores of a chunk's texts from its answers."""

    def score(asked: pa.Table, replies: pa.Table) -> pa.Table:
        counts, parent, share, total, kinds = sent.value
        base = lambda c: np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
        near, left, far, far_left, words = [], [], [], [], []
        replied, lists = {r["part"]: r for r in replies.to_pylist()}, sorted(asked.to_pylist(), key=lambda r: r["part"])
        for r in lists[1:]:
            r |= replied.pop(r["part"])
            near.append(risen(r["near_keys"], r["near_n"], np.int64))
            left.append(unsqueezed(r["near_left"], r["near_n"], np.float32))
            rare = risen(r["far_rare"], r["far_n"], np.uint64)
            far.append((rare, *(unsqueezed(r[c], r["far_n"], np.uint64) for c in ("far_kind", "far_other"))))
            far_left.append(unsqueezed(r["far_left"], r["far_n"], np.float32))
            mine = rare[np.append(True, rare[1:] != rare[:-1])] if len(rare) else rare
            words.append((mine, unsqueezed(r["words_c"], len(mine), np.int64), *(unsqueezed(r[c], len(mine), np.float32) for c in ("words_parent", "words_share"))))
        near, left, far_left = np.concatenate(near), np.concatenate(left).astype(float), np.concatenate(far_left).astype(float)
        (rare, kind, other), (word, c, word_parent, word_share) = (tuple(np.concatenate(x) for x in zip(*y, strict=True)) for y in (far, words))
        order = np.argsort(word)
        word, c, word_parent, word_share = word[order], c[order], word_parent[order].astype(float), word_share[order].astype(float)
        # a pair's context share, context count, token's parent probability and token's count
        n = len(near)
        s, cu, q, cw = (np.empty(n + len(rare)) for _ in range(4))
        u, w = near >> WORD_BITS, near & ((1 << WORD_BITS) - 1)
        s[:n], cu[:n], q[:n], cw[:n] = share[u], counts[u], parent[w], counts[w]
        at = find(word, rare)
        for some, context in ((kind != CONTEXT, False), (kind == CONTEXT, True)):
            here = n + np.flatnonzero(some)
            if context:
                s[here], cu[here] = word_share[at[some]], c[at[some]]
            else:
                q[here], cw[here] = word_parent[at[some]], c[at[some]]
        for some, context in ((kind == TOKEN, True), (kind == CONTEXT, False)):
            here, place = n + np.flatnonzero(some), other[some].astype(np.int64)
            if context:
                s[here], cu[here] = share[place], counts[place]
            else:
                q[here], cw[here] = parent[place], counts[place]
        some = kind == BOTH
        of = find(word, other[some])
        s[n + np.flatnonzero(some)], cu[n + np.flatnonzero(some)] = word_share[of], c[of]
        chance = np.log10(s * q + np.append(left, far_left) / (STRENGTH + cu))
        texts = lists[0]
        lengths = np.array(texts["lengths"])
        pair = risen(texts["pairs"], int(lengths.sum()), np.uint32)
        row = np.repeat(np.arange(len(lengths)), lengths)
        known, low, high = (np.bincount(row, x[pair], len(lengths)) for x in ((cw > 0).astype(float), base(cw), chance))
        return pa.table([pa.array(texts["doc_ids"], pa.int64()), pa.array(texts["held_out"], pa.bool_()), pa.array(lengths), pa.array(known.astype(np.int64)), pa.array(low), pa.array(high)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return score


def scored(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of docs (doc_id, text).

    Null text is empty, one end token; a null doc_id counts as empty text in the fold.  Equal rows are scored alike and
    each returned.  An empty table gives an empty result.  A task holds a chunk, which one long text may be by itself, or
    a part, about fifty bytes a token of either.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), fold.alias("held_out"))
    model, asked, parts = trained(keyed, scratch)
    none = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in HELD.split(", ")}
    held = [
        model.near.select("part", "near_n", "near_keys", "near_tables", F.lit(0).alias("which"), *(F.lit(0).cast(t).alias(n) for n, t in (c.split() for c in HELD.split(", ")[5:]))),
        model.far.select("part", F.lit(1).alias("which"), "key", "kind", "other", "c", F.col("tables").alias("x"), F.lit(1.0).alias("share")),
        model.rare.select(F.pmod("word", F.lit(parts)).cast("int").alias("part"), F.lit(2).alias("which"), F.col("word").alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("other"), "c", F.col("parent").alias("x"), "share"),
    ]
    held = functools.reduce(DataFrame.unionByName, [h.withColumns({n: c for n, c in none.items() if n not in h.columns}).select(*none) for h in held])
    lists = asked.where("part >= 0").drop("pairs", "doc_ids", "held_out", "lengths")
    replies = scratch.keep(lists.groupBy("part").cogroup(held.groupBy("part")).applyInArrow(_reply(model.unseen), REPLIES), "replies")
    scratch.drop(model.near, model.far, model.rare)
    del lists, held
    scratch.free()
    sent = docs.sparkSession.sparkContext.broadcast((model.counts, model.parent, model.share, model.total, model.kinds))
    out = asked.drop("near_counts", "far_counts").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_score(sent), SCORED)
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    )


def op9_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), Scratch(spark))


QUERIES = {"op9_pitman_yor_scores": op9_pitman_yor_scores}
ORACLE: dict[str, str] = {}
