"""Operator 12, Merkle dataset manifest with incremental witnesses.

Rows are leaves; the leaves of a language, in order of doc_id, are appended to a tree, and the trees' roots to one above.
An append keeps a stack of open subtrees, each with the partial witnesses of its leaves.  When the sibling of a subtree
is complete, the sibling's digest is added to each of them, and both become one open subtree (`Append`).

Leaves are dealt into aligned blocks of BLOCK by rank.  A block is appended in one stream; its root is one append in the
next tree, whose leaves are block roots and are dealt the same way, until a language has one block.  Witnesses then go
down again: those of a block's leaves are extended by the block's own.  So no task holds more than a block, the number
of passes is the logarithm of the rows to base BLOCK, and only counts are taken to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

HEIGHT = 12
BLOCK = 1 << HEIGHT
PERIOD = 7
#: A step of a witness: the sibling's digest after its side, or this where a run has no sibling.
ALONE = "-"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Append:
    """A Merkle tree that grows by aligned appends and keeps each leaf's witness up to date."""

    def __init__(self) -> None:
        self.open: list[tuple[int, str, int, int]] = []  # height, digest, first leaf, leaf after the last; heights fall
        self.witness: list[list[str]] = []

    def add(self, leaf: str) -> None:
        n = len(self.witness)
        self.witness.append([])
        self._place((0, leaf, n, n + 1))

    def _place(self, node: tuple[int, str, int, int]) -> None:
        while self.open and self.open[-1][0] == node[0]:
            node = self._joined(self.open.pop(), node)
        self.open.append(node)

    def _joined(self, left: tuple[int, str, int, int], right: tuple[int, str, int, int]) -> tuple[int, str, int, int]:
        for k in range(left[2], left[3]):
            self.witness[k].append(f"R{right[1]}")
        for k in range(right[2], right[3]):
            self.witness[k].append(f"L{left[1]}")
        return left[0] + 1, digest(left[1], right[1]), left[2], right[3]

    def _raised(self, node: tuple[int, str, int, int]) -> tuple[int, str, int, int]:
        for k in range(node[2], node[3]):
            self.witness[k].append(ALONE)
        return node[0] + 1, digest(node[1]), node[2], node[3]

    def close(self, height: int = 0) -> str:
        """The root: the last open subtree rises alone, level by level, to meet the one before, and up to `height`."""
        node = self.open.pop()
        while self.open:
            while node[0] < self.open[-1][0]:
                node = self._raised(node)
            node = self._joined(self.open.pop(), node)
        while node[0] < height:
            node = self._raised(node)
        return node[1]


def folded(leaf: str, witness: list[str]) -> str:
    """The root that a leaf and its witness give."""
    for step in witness:
        side, other = step[0], step[1:]
        leaf = digest(other, leaf) if side == "L" else digest(leaf, other) if side == "R" else digest(leaf)
    return leaf


def siblings_digest(witness: list[str]) -> str:
    return digest(*(step[1:] for step in witness if step != ALONE))


def ranked(nodes: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """nodes (key, ...) with rank (from 0, by `order` within key) and n, the number of rows of the key.

    Rows are dealt by ranges of key and order, ties by their place in the input, so that a key with most rows is spread;
    ranks within a range are added to the counts of the ranges before, which a window over (key, range) sums.
    """
    tie = F.monotonically_increasing_id()
    dealt = nodes.withColumn("_tie", tie).repartitionByRange(F.col("key").asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), "_tie")
    dealt = scratch.keep(dealt.withColumn("_part", F.spark_partition_id()), "dealt")
    before = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("key", "_part").count()
    starts = counts.select("key", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"), F.sum("count").over(Window.partitionBy("key")).alias("n"))
    starts = scratch.keep(starts.select(F.col("key").alias("_k"), F.col("_part").alias("_p"), "_start", "n"), "starts")
    within = F.row_number().over(Window.partitionBy("_part", "key").orderBy(*(F.col(c).asc_nulls_first() for c in order), "_tie"))
    placed = dealt.withColumn("_row", within).join(starts, F.col("key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    return placed.select(*nodes.columns, (F.col("_start") + F.col("_row") - 1).alias("rank"), "n")


def dealt_blocks(nodes: DataFrame) -> DataFrame:
    """Rows of one block side by side, in order of rank; `block` is rank / BLOCK."""
    return nodes.repartition("key", "block").sortWithinPartitions("key", "block", "rank")


def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    """Rows (key, block, ...) of each block in turn."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if held and row[:2] != held[0][:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


NODE = "key string, rank long, n long, digest string"


def up_height(n: int) -> int:
    """How high a block of a key of n leaves must rise: not above its own root if it is the only one."""
    return HEIGHT if n > BLOCK else 0


def _block_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for rows in runs(batches, ["key", "block", "n", "digest"]):
        key, block, n = rows[0][:3]
        tree = Append()
        for row in rows:
            tree.add(row[3])
        out.append((key, block, -(-n // BLOCK), tree.close(up_height(n))))
        if len(out) == BLOCK:
            yield _node_batch(out)
            out = []
    if out:
        yield _node_batch(out)


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["key", "rank", "n", "digest"])


def climbed(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Levels of trees: `nodes`, the roots of its blocks, the roots of their blocks, ..., one root a key."""
    levels = [nodes]
    while True:
        most = levels[-1].agg(F.max("n")).first()[0] or 0
        if most <= 1 and len(levels) > 1:
            return levels
        blocks = levels[-1].select("key", F.expr(f"rank div {BLOCK}").alias("block"), "rank", "n", "digest")
        levels.append(scratch.keep(dealt_blocks(blocks).mapInArrow(_block_roots, NODE), "roots"))


EXTENDED = "key string, rank long, digest string, changed string, id long, witness array<string>, subroot string, root string"


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Witnesses of a block's rows, extended by the block's own, which is its first row (rank -1)."""
    names = ["key", "block", "rank", "n", "digest", "changed", "id", "witness", "subroot", "root"]
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string())
    out: list[tuple] = []
    for (*_, above, subroot, root), *rows in runs(batches, names):
        tree = Append()
        for row in rows:
            tree.add(row[4])
        tree.close(up_height(rows[0][3]))
        out += [(r[0], r[2], r[4], r[5], r[6], own + above, subroot, root) for r, own in zip(rows, tree.witness, strict=True)]
        if len(out) >= BLOCK:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in EXTENDED.split(", ")])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in EXTENDED.split(", ")])


def descended(levels: list[DataFrame], tops: DataFrame, scratch: Scratch) -> DataFrame:
    """Witnesses of the rows of levels[0], see EXTENDED.  tops: (key, witness, subroot, root) of each key's root."""
    above = tops.select("key", F.lit(0).cast("long").alias("block"), "witness", "subroot", "root")
    for depth in range(len(levels) - 2, -1, -1):
        nodes = levels[depth]
        for c, kind in (("changed", "string"), ("id", "long")):
            nodes = nodes if c in nodes.columns else nodes.withColumn(c, F.lit(None).cast(kind))
        rows = nodes.select("key", F.expr(f"rank div {BLOCK}").alias("block"), "rank", "n", "digest", "changed", "id")
        both = rows.unionByName(above.withColumn("rank", F.lit(-1).cast("long")), allowMissingColumns=True)
        out = dealt_blocks(both).mapInArrow(_extend, EXTENDED)
        if depth:
            above = scratch.keep(out.select("key", F.col("rank").alias("block"), "witness", "subroot", "root"), "witnesses")
    return out


def field(value: F.Column) -> F.Column:
    """A value by its length in bytes and itself; - if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def manifest(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, lang, leaf, tampered, witness, subroot, root): one row a document, witness its path up to root.

    A leaf covers doc_id, source, lang, n_chars and text; other columns take no part.  `tampered` is the leaf with
    n_chars + 1 where PERIOD divides the CRC-32 of doc_id, else null; a null n_chars stays null.  Rows without doc_id come
    first in their language and are never tampered with; rows of one doc_id are ordered by leaf, and equal rows arbitrarily,
    each with a place of its own.  An empty table has no root and gives no rows.  A witness holds one step a level: L or R
    and the sibling's digest, or - where the run has one node.
    """
    n_chars = F.col("n_chars").cast("decimal(20,0)")
    leaf = lambda n: F.sha2(F.concat(*(field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")))), 256)
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(PERIOD)) == 0
    leaves = docs.select(F.col("lang").alias("key"), F.col("doc_id").alias("id"), leaf(n_chars).alias("digest"), F.when(chosen, leaf(n_chars + 1)).alias("changed"))
    levels = climbed(scratch.keep(ranked(leaves, ["id", "digest"], scratch), "leaves"), scratch)
    subroots = levels[-1].select(F.col("key").alias("lang"), "digest")
    # the tree over languages is one more tree, whose key is the same for all
    over = ranked(subroots.select(F.lit("").alias("key"), "lang", "digest"), ["lang"], scratch)
    over = scratch.keep(over.select("*", F.col("rank").alias("id")), "languages")
    upper = climbed(over, scratch)
    none = F.array().cast("array<string>")
    tops = descended(upper, upper[-1].select("key", none.alias("witness"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root")), scratch)
    named = tops.join(over.select("rank", "lang"), "rank").select(F.col("lang").alias("key"), "witness", F.col("digest").alias("subroot"), "root")
    out = descended(levels, scratch.keep(named, "tops"), scratch)
    return out.select(F.col("id").alias("doc_id"), F.col("key").alias("lang"), F.col("digest").alias("leaf"), F.col("changed").alias("tampered"), "witness", "subroot", "root")


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        leaf, changed, witness, root = (b.column(c).to_pylist() for c in ("leaf", "tampered", "witness", "root"))
        proof = [siblings_digest(w) for w in witness]
        fold = [folded(c or x, w) for x, c, w in zip(leaf, changed, witness, strict=True)]
        good = [f == r for f, r in zip(fold, root, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("leaf"), b.column("subroot"), b.column("root"), pa.array(proof, pa.string()), pa.array(fold, pa.string()), pa.array(good, pa.bool_())], [c.split()[0] for c in PROOF.split(", ")])


def verified(witnessed: DataFrame) -> DataFrame:
    """Each row of a manifest folded up again, from its tampered leaf if it has one; see PROOF."""
    return witnessed.mapInArrow(_proofs, PROOF)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(manifest(table(spark, sf_dir, "documents"), Scratch(spark)))


SQL = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars, row_number() OVER () AS row,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents
), crc(c, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT c, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM crc WHERE k < 8
), hashed(row, s, k, v) AS (
  SELECT row, doc_id::VARCHAR, 0, 4294967295 FROM fields WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT row, s, h.k + 1, xor(t.v, h.v >> 8) FROM hashed h JOIN (SELECT c, v FROM crc WHERE k = 8) t ON t.c = xor(h.v & 255, ascii(s[h.k + 1])) WHERE h.k < length(s)
), chosen AS (
  SELECT row FROM hashed WHERE k = length(s) AND xor(v, 4294967295) % 7 = 0
), leaves AS (
  SELECT row, doc_id, lang,
    sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN row IN (FROM chosen) THEN sha256(head || coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS changed
  FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), tree(lang, lvl, idx, n, d) AS (
  SELECT lang, 0, idx, n, leaf FROM placed
  UNION ALL
  SELECT lang, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY lang, lvl, n, idx // 2
), subroots AS (
  SELECT lang, lvl AS height, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1
), top(lvl, idx, n, d) AS (
  SELECT 0, idx, n, d FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, n, idx // 2
), steps AS (
  SELECT p.row, t.lvl, p.idx >> t.lvl AS idx, s.d FROM placed p
  JOIN (SELECT DISTINCT lang, lvl FROM tree WHERE n > 1) t ON t.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lvl = t.lvl AND s.idx = xor(p.idx >> t.lvl, 1)
  UNION ALL
  SELECT p.row, r.height + t.lvl, r.idx >> t.lvl, s.d FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang
  JOIN (SELECT DISTINCT lvl FROM top WHERE n > 1) t ON true
  LEFT JOIN top s ON s.lvl = t.lvl AND s.idx = xor(r.idx >> t.lvl, 1)
), fold(row, lvl, d) AS (
  SELECT row, 0, coalesce(changed, leaf) FROM placed
  UNION ALL
  SELECT f.row, f.lvl + 1, sha256(CASE WHEN s.d IS NULL THEN f.d WHEN s.idx % 2 = 1 THEN s.d || f.d ELSE f.d || s.d END)
  FROM fold f JOIN steps s ON s.row = f.row AND s.lvl = f.lvl
), proofs AS (
  SELECT row, sha256(coalesce(string_agg(d, '' ORDER BY lvl), '')) AS proof_sha256 FROM (SELECT row, NULL AS lvl, NULL AS d FROM placed UNION ALL SELECT row, lvl, d FROM steps) GROUP BY row
)
SELECT p.doc_id, p.leaf, r.d AS subroot, root.d AS root, proof_sha256, f.d AS folded_root, f.d = root.d AS verified
FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang
JOIN (SELECT d FROM top WHERE n = 1) root ON true
JOIN proofs USING (row)
JOIN (SELECT row, max_by(d, lvl) AS d FROM fold GROUP BY row) f USING (row)
"""
QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLE = {"op12_merkle_manifest": SQL}
