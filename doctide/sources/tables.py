"""The given tables, and the document model derived from them: lines, words, cells and tokens in document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of text: each line of each document with its place."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


#: The same as a DuckDB table expression.
LINES = """lines AS (SELECT doc_id, source, lang, CAST(unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS INTEGER) AS pos,
                          unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words between spaces of each line, in order."""
    return lines(spark, sf_dir).select("doc_id", "pos", F.posexplode(F.filter(F.split("line", " "), lambda w: w != "")).alias("ord", "word"))


WORDS = f"""{LINES}, words AS (SELECT doc_id, pos, CAST(unnest(generate_series(0, len(list_filter(string_split(line, ' '), lambda w: w <> '')) - 1)) AS INTEGER) AS ord,
                                 unnest(list_filter(string_split(line, ' '), lambda w: w <> '')) AS word FROM lines)"""


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    day = F.unix_date(F.to_date(ts)).cast("long") * 86_400_000
    return day + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(F.date_part(F.lit("SECOND"), ts) * 1000).cast("long")
