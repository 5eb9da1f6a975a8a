"""From raw documents to packed sequences: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import jaccard, mixing, packing, quality, toxicity
from tallyweave.llm.common import DOCUMENT_COLUMNS, documents, materialize, table

#: Near duplicates share so many per cent of their shingles of so many words (op10's own contract is narrower).
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Bytes of words that a packing worker keeps: less than alone, since executors have run all stages before it.
WORD_CACHE = 32 << 20


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``docs`` but for the rows named in ``gone`` (doc_id, text_hash), which is broadcast up to a number of rows."""
    gone = materialize(gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")), name)
    if gone.count() <= jaccard.BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text")), "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Each row is judged by its own text, null counting as
    the empty one; equal texts share a verdict; without labels every score is 0.5 and none stays."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.statistics(docs).withColumn("score", quality.score_column(model))
    return scored.filter(F.col("score") >= quality.THRESHOLD).select(*DOCUMENT_COLUMNS)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts. Each row is judged by its own text, repeated and
    null ids included; null and empty texts have no hits and stay; without toxic labels all stay."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    gone = toxicity.rejected(docs, table(spark, sf_dir, "labels"))
    return _without(docs, gone, "toxic").select(*DOCUMENT_COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the smallest doc_id (null last), then by text hash,
    source and language; of rows equal throughout, one. Rows without words are in no group and stay."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    found = materialize(jaccard.row_components(docs, words=NEAR_WORDS, percent=NEAR_PERCENT).select("doc_id", "text_hash", "group"), "near-groups")
    first = found.filter("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f"))
    # The kept one is told by doc_id and text; most groups have one row and lose none.
    same = [F.col("group") == F.col("_g"), F.col("doc_id").eqNullSafe(F.col("_f.doc_id")), F.col("text_hash") == F.col("_f.text_hash")]
    lost = found.filter("group IS NOT NULL").join(first.select(F.col("group").alias("_g"), F.col("f").alias("_f")), same, "left_anti")
    kept = _without(docs, lost.select("doc_id", "text_hash").distinct(), "near-duplicates")
    again = materialize(found.filter("group IS NOT NULL").groupBy("doc_id", "text_hash").count().filter("count > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")), "repeated-rows")
    if not again.isEmpty():
        # Rows of one id and text, kept or gone together: the first by source and language stays.
        on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text"))
        one = kept.join(again, on, "left_semi").groupBy("doc_id", F.xxhash64("text").alias("_text")).agg(F.min(F.struct("source", "lang", "n_chars", "text")).alias("r")).select("doc_id", "r.text", "r.lang", "r.source", "r.n_chars")
        kept = kept.join(again, on, "left_anti").unionByName(one)
    return kept.select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, by position from file to file. A null source is one of
    its own; repeated rows and null ids stay, each at a place of its own."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    mixed = mixing.mix(docs.withColumn("_text", F.xxhash64("text")), order=("doc_id", "_text"))
    return mixing.in_order(mixed, docs.count()).select(*DOCUMENT_COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and offset, sequences in the order of the documents,
    that is of the mixture; null and empty texts are one separator each, repeated rows are packed as often as they come."""
    placed = mixing.file_order(docs.select(*DOCUMENT_COLUMNS))
    return packing.in_order(packing.pack_documents(placed, cache_bytes=WORD_CACHE)).drop("place")


STAGES = [
    ("quality", keep_quality),
    ("toxicity", keep_clean),
    ("near_duplicates", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, a similarity join and a packing plan have no SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
