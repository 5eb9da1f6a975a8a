"""Bounded samples of labelled rows, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod


def training_rows(rows: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int) -> DataFrame:
    """``rows`` with a non-null ``label`` that are not held out, from a hashed sample of about ``most`` labels.

    The sample is bounded, so it is broadcast and ``rows`` stay where they are.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", modulus) != held_out))
    of = max(1, -(-usable.count() // most))
    picked = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(of)) == 0).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("label"))
    return rows.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).drop("_id")
