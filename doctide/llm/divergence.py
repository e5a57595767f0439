"""Operator 11, source divergence audit: how far apart the sources of each language are, and by which terms.

Arrow compute makes partial counts inside mapInArrow: ascii_lower, split_pattern_regex, dictionary_encode, and hash
group_by.  Spark adds them up.  The counts of a language are then dealt as columnar shards of SHARD_TERMS terms by
SOURCES sources; each shard adds up its terms' share of every pair of its sources in whole columns, and Spark adds up the
shards.  A shard's rows are dealt by language, shard and block of sources, so neither a language nor a source with most
of the text is one task's work, and no pair of rows is ever formed outside a shard's arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, text_chunks

#: What parts terms: all of ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
SHARD_TERMS = 4_096
SOURCES = 256
HELD = 1 << 18
COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.Table:
    """(lang, source, term, n, docs) of a few rows; each (lang, source) also has the empty term, n 0."""
    words = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    row, term = pc.list_parent_indices(words), pc.list_flatten(words).dictionary_encode()
    codes = pa.table({"row": row, "code": term.indices}).group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    each = pa.table({
        "lang": langs.take(codes["row"]), "source": sources.take(codes["row"]), "code": codes["code"], "n": codes["count_all"],
    }).group_by(["lang", "source", "code"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    named = pa.table({"lang": each["lang"], "source": each["source"], "term": term.dictionary.take(each["code"]), "n": each["n_sum"], "docs": each["n_count"]})
    seen = pa.table({"lang": langs, "source": sources}).group_by(["lang", "source"], use_threads=False).aggregate([([], "count_all")])
    blank = pa.table({"lang": seen["lang"], "source": seen["source"], "term": pa.repeat("", len(seen)), "n": pa.repeat(0, len(seen)), "docs": seen["count_all"]})
    return pa.concat_tables([named.filter(pc.not_equal(named["term"], "")), blank])


def _summed(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.table({"lang": out["lang"], "source": out["source"], "term": out["term"], "n": out["n_sum"], "docs": out["docs_sum"]})


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all rows of a task, added up whenever HELD of them are there, and given on when that no longer helps."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        langs, sources, texts = (pc.fill_null(batch.column(c), "") for c in ("lang", "source", "text"))
        for first, end, *_ in text_chunks(texts):
            held.append(term_counts(langs[first:end], sources[first:end], texts[first:end]))
            rows += len(held[-1])
            if rows > HELD:
                held = [_summed(held)]
                if len(held[0]) > HELD // 2:
                    yield from held[0].combine_chunks().to_batches()
                    held = []
                rows = sum(map(len, held))
    if held:
        yield from _summed(held).combine_chunks().to_batches()


def counted(docs: DataFrame) -> DataFrame:
    """COUNTS of docs (lang, source, text), one row a language, source and term."""
    parts = docs.select("lang", "source", "text").mapInArrow(_partial_counts, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def rate(n: str, total: str, kinds: str) -> F.Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kinds)), exact for any longs; null if there are no terms."""
    return F.expr(f"1 + ({n} + 2BD) * {SCALE}BD div nullif({total} + 2BD * {kinds}, 0BD)")


def gap(p: str, q: str) -> F.Column:
    """floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


PAIRS = "lang string, a string, b string, base long, more long"


def _shard_pairs(shard: pa.Table) -> pa.Table:
    """Of every left source with every right one: what all terms of the language give if neither has any (base), and what
    the terms of this shard add to that (more).

    A matrix of rates a side, a row a term: each source's rate of 0 (rows without term), and over it the rates given.
    """
    lang = shard["lang"][0]
    heads, cells = shard.filter(pc.is_null(shard["term"])), shard.filter(pc.is_valid(shard["term"]))
    terms = cells["term"].combine_chunks().dictionary_encode()
    code, side, slot = (x.to_numpy(zero_copy_only=False) for x in (terms.indices, cells["side"], cells["slot"]))
    rates, zeros, names = [], [], []
    for k in (0, 1):
        own = heads.filter(pc.equal(heads["side"], k)).sort_by("slot")
        zero = own["p"].to_numpy()
        m = np.repeat(zero[None], len(terms.dictionary), axis=0)
        at = side == k
        m[code[at], slot[at]] = cells["p"].to_numpy()[at]
        rates.append(m)
        zeros.append(zero)
        names.append(own["source"].combine_chunks())
    gap = lambda p, q: (p - q) ** 2 // np.maximum(p + q, 1)
    none = gap(zeros[0][:, None], zeros[1][None])
    more = np.stack([gap(rates[0][:, j, None], rates[1]).sum(axis=0) for j in range(len(none))]) - len(terms.dictionary) * none
    a, b = np.indices(none.shape).reshape(2, -1)
    base = none * heads["kinds"][0].as_py()
    return pa.table([pa.repeat(lang, len(a)), names[0].take(pa.array(a)), names[1].take(pa.array(b)), pa.array(base[a, b]), pa.array(more[a, b])], names=["lang", "a", "b", "base", "more"])


def pair_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every two different sources of each language, both ways round.

    cells: (lang, source, place, term, p) of counts above 0; groups: (lang, source, place, kinds, zero), place from 0 within
    lang in order of source, kinds the language's terms, zero the rate of a count of 0.  Two blocks of sources meet in one
    place, the lower one left, so every pair is summed once.
    """
    block, blocks = F.expr(f"place div {SOURCES}"), F.expr(f"(sources - 1) div {SOURCES} + 1")
    shards = F.greatest(F.lit(1), F.expr(f"(kinds - 1) div {SHARD_TERMS} + 1"))
    shard_of = F.pmod(F.xxhash64("term"), shards)
    facts = ("lang", "source", "place", "kinds", "sources")
    heads = groups.select(*facts, F.lit(None).cast("string").alias("term"), F.coalesce("zero", F.lit(0)).alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)).alias("shard"))
    rows = heads.unionByName(cells.select(*facts, "term", "p", shard_of.alias("shard")))
    met = rows.select("*", block.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    met = met.withColumn("side", F.explode(F.when(F.col("own") == F.col("other"), F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("own") > F.col("other")).cast("int")))))
    placed = met.select("lang", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "shard", "term", "side", F.expr(f"place % {SOURCES}").alias("slot"), "source", "kinds", "p")
    sums = placed.groupBy("lang", "left", "right", "shard").applyInArrow(_shard_pairs, PAIRS).where("a < b")
    sums = sums.groupBy("lang", "a", "b").agg((F.max("base") + F.sum("more")).alias("value"))
    turned = sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    return sums.unionByName(turned)


def divergences(docs: DataFrame, scratch: Scratch, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` to each other source of the language, `term` for the top terms.

    Null lang, source and text count as empty; the empty name is a name like any other.  A document is a row, so repeated
    rows count as often as they stand there.  A source without terms takes part with counts of 0, a language of one
    source has no pairs, and an empty table gives no rows.  Ties go to the smaller item by UTF-8 bytes.  Texts are worked
    on in runs of about 2 MB; a longer text is a run of its own.
    """
    counts = scratch.keep(counted(docs), "counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("all_n")).where(F.col("in_docs") >= least_docs)
    kept = scratch.keep(kept.select("lang", "term", "all_n"), "kept")
    cells = scratch.keep(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "cells")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("all_n").alias("all_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    names = counts.where("term = ''").select("lang", "source")
    groups = names.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kinds", "all_total"])
    by_lang = Window.partitionBy("lang")
    groups = groups.withColumns({"place": F.row_number().over(by_lang.orderBy("source")).cast("long") - 1, "sources": F.count("*").over(by_lang), "zero": rate("0", "total", "kinds")})
    groups = scratch.keep(groups, "groups")
    rates = {"p": rate("n", "total", "kinds"), "q": rate("all_n", "all_total", "kinds")}
    rated = scratch.keep(cells.join(groups, ["lang", "source"]).withColumns(rates), "rates")
    terms = rated.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value"))
    pairs = pair_sums(rated, groups).select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"), Scratch(spark))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), words AS (
  SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 10
), langs AS (
  SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS kinds FROM kept GROUP BY lang
), groups AS (SELECT DISTINCT lang, source FROM docs
), cells AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM cells GROUP BY ALL
), rates AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.kinds) AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.kinds) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN cells c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM rates x JOIN rates y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM rates WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
"""
QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLE = {"op11_source_divergence": SQL}
