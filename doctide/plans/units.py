"""Queries over content-addressed text units."""

from pyspark.sql import functions as F


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dedup_units(spark, sf_dir):
    """One row for each distinct text: its digest, how many documents share it and the first of them."""
    d = _t(spark, sf_dir, "documents")
    return d.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("unit_id")).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


QUERIES = {"dedup_units": dedup_units}
ORACLE = {"dedup_units": "SELECT sha256(coalesce(text, '')) AS unit_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents GROUP BY 1"}
