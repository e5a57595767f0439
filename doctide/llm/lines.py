"""Operator 13, line dedup: lines that many documents share stay in one of them only.

DataFrame and SQL functions only.  Lines are exploded, normalised and hashed; documents are counted by distinct doc_id a
hash; lines of hashes over the threshold go, and a text is put together again from the runs between dropped positions.

What is shuffled for the count and the search are hashes, ids and positions: a line of a third of all documents is
pre-aggregated for the count and met in a join of two plain exchanges, which adaptive execution splits.  Texts are
shuffled once, to meet their dropped positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

LEAST_CHARS = 40
LEAST_DOCS = 5
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def two_hashes(value: Column) -> list[Column]:
    """128 bits of a string: XXH64 under two seeds."""
    return [F.xxhash64(value), F.xxhash64(F.lit("second"), value)]


def normalised(line: Column) -> Column:
    """line without white space at both ends, A-Z as a-z; `lower` does that to lines of ASCII alone, and faster."""
    cut = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(cut) == F.char_length(cut), F.lower(cut)).otherwise(F.translate(cut, UPPER, LOWER))


def long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(_doc, _t1, _t2, _at, _h1, _h2) of each line whose key has at least `least_chars` code points."""
    t1, t2 = two_hashes(F.col("_text"))
    each = docs.select("_doc", t1.alias("_t1"), t2.alias("_t2"), F.posexplode(F.split("_text", "\n", -1)).alias("_at", "_line"))
    keyed = each.select("_doc", "_t1", "_t2", "_at", normalised(F.col("_line")).alias("_key")).where(F.char_length("_key") >= least_chars)
    h1, h2 = two_hashes(F.col("_key"))
    return keyed.select("_doc", "_t1", "_t2", "_at", h1.alias("_h1"), h2.alias("_h2"))


def without(lines: Column, dropped: Column) -> Column:
    """lines less those at the ascending positions `dropped`: the runs between them, each copied once."""
    end = lambda k: F.coalesce(F.get(dropped, k), F.size(lines).cast("int"))
    start = lambda k: F.coalesce(F.get(dropped, k - 1) + 1, F.lit(0))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(dropped)), lambda k: F.slice(lines, start(k) + 1, end(k) - start(k))))


def drop_common_lines(docs: DataFrame, scratch: Scratch, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs with text less the lines that other documents keep, and the longs n_lines (before) and n_dropped.

    A key of at least `least_chars` code points in at least `least_docs` documents stays in the largest doc_id that holds
    it, in all its lines there.  Documents are told apart by doc_id: repeated rows of one are one document and are cut
    alike, and rows without doc_id are one document, the smallest.  Null and empty texts are one empty line and come out
    as empty texts.  Other columns pass as they are, but for n_lines and n_dropped, which are replaced.  A text needs a few
    times its own size in one task, however long it is.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    texts = docs.select(*own, F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"))
    lines = long_lines(texts.select("_doc", "_text"), least_chars)
    # a null id counts as a document of its own, below all others
    told = F.count_distinct(F.coalesce(F.col("_doc").cast("string"), F.lit("-")))
    common = lines.groupBy("_h1", "_h2").agg(told.alias("_docs"), F.max("_doc").alias("_keeper")).where(F.col("_docs") >= least_docs)
    common = scratch.keep(common.select("_h1", "_h2", "_keeper"), "common")
    goes = lines.join(common, ["_h1", "_h2"]).where(~F.col("_doc").eqNullSafe(F.col("_keeper")))
    goes = goes.groupBy("_doc", "_t1", "_t2").agg(F.sort_array(F.collect_set("_at")).alias("_goes"))
    goes = scratch.keep(goes.select(F.col("_doc").alias("_of"), "_t1", "_t2", "_goes"), "dropped")
    t1, t2 = two_hashes(F.col("_text"))
    met = texts.join(goes, F.col("_doc").eqNullSafe(F.col("_of")) & (t1 == goes["_t1"]) & (t2 == goes["_t2"]), "left")
    parts = F.split("_text", "\n", -1)
    text = F.when(F.col("_goes").isNull(), F.col("_text")).otherwise(F.concat_ws("\n", without(parts, F.col("_goes"))))
    return met.select(
        *(text.alias("text") if c == "text" else F.col(c) for c in own),
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size("_goes"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_common_lines(docs, Scratch(spark)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT d.doc_id, d.n, l.pos, l.line,
    translate(trim(l.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, row_number() OVER () AS n, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
    LATERAL (SELECT unnest(d.parts) AS line, unnest(range(len(d.parts))) AS pos) l
), common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '-')) >= 5
), judged AS (
  SELECT lines.*, common.key IS NOT NULL AND lines.doc_id IS DISTINCT FROM keeper AS goes FROM lines LEFT JOIN common USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE goes)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM judged GROUP BY n
"""
QUERIES = {"op13_line_dedup": op13_line_dedup}
ORACLE = {"op13_line_dedup": SQL}
