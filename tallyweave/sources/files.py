"""Files of an inbox: scan, sidecars of scanned documents, readers behind adapters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as N

SIDECAR = ".ocr.txt"
#: (bytes, path) -> (text, pages, engine); None where no library reads the format.
Reader = Callable[[bytes, str], tuple[str, int, str]]


def inbox(spark: SparkSession, path: str) -> DataFrame:
    """Documents of an inbox in a fixed order: path, kind, content, sha, ingest_seq. A missing folder is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.when(N.suffix("path") == ".pdf", "pdf").when(N.suffix("path").isin(*N.IMAGE_SUFFIXES), "imagem").when(F.col("path").contains("/whatsapp/"), "whatsapp").when(F.col("path").contains("/telegram/"), "telegram")
    rows = files.filter(~F.col("path").endswith(SIDECAR)).select("path", kind.alias("kind"), "length", F.sha2("content", 256).alias("sha"), "content").filter("kind IS NOT NULL")
    rank = F.when(F.col("kind").isin("pdf", "imagem"), 0).when(F.col("kind") == "whatsapp", 1).otherwise(2)
    # Numbers cover paths only; contents are joined to them and never meet in one task.
    order = rows.select("path", rank.alias("_rank")).withColumn("ingest_seq", F.row_number().over(Window.orderBy("_rank", "path")).cast("long")).drop("_rank")
    return rows.join(order, "path")


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the texts that stand in for a scan's reading."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{SIDECAR}").load(path)
    return files.select(F.expr(f"left(path, length(path) - {len(SIDECAR)})").alias("path"), F.decode("content", "UTF-8").alias("text"))


def no_reader(content: bytes, path: str) -> tuple[str, int, str]:
    """Reads nothing; what it stands for is not installed."""
    return "", 0, ""


def read_documents(files: DataFrame, reader: Reader = no_reader) -> DataFrame:
    """Adds text, pages, engine, has_text_layer. A reader that fails on a file gives it no text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for content, path in zip(frame["content"], frame["path"], strict=True):
                try:
                    found.append(reader(bytes(content), path))
                except Exception as error:  # one bad file must not end the batch; the row says so
                    found.append(("", 0, f"erro: {type(error).__name__}"))
            yield frame.drop(columns="content").assign(text=[x for x, _, _ in found], pages=[n for _, n, _ in found], engine=[e for _, _, e in found])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema if f.name != "content")
    return files.mapInPandas(run, f"{kinds}, text string, pages int, engine string").withColumn("has_text_layer", F.trim("text") != "")


def with_sidecars(read: DataFrame, side: DataFrame) -> DataFrame:
    """Scanned PDFs without a text take their sidecar's, labelled simulated; without one they stay
    unread with confidence 0. Images never take a sidecar."""
    s = side.select("path", F.col("text").alias("_side"))
    scanned = (F.col("kind") == "pdf") & ~F.col("has_text_layer")
    taken = scanned & F.col("_side").isNotNull()
    out = read.join(s, "path", "left")
    confidence = F.when(taken, N.simulated_ocr_confidence("_side")).when(F.col("has_text_layer"), F.lit(1).cast("decimal(6,4)")).otherwise(F.lit(0).cast("decimal(6,4)"))
    return out.withColumn("read_confidence", confidence).withColumn("engine", F.when(taken, "ocr_simulado").otherwise(F.col("engine"))).withColumn("text", F.when(taken, F.col("_side")).otherwise(F.col("text"))).drop("_side")


def count_deduplicated(spark: SparkSession, path: str | None) -> int | None:
    """Audit lines that say a document was known; None, not 0, without an audit trail."""
    if path is None:
        return None
    audit = spark.read.schema("acao string").json(path)
    return audit.filter(F.lower(F.trim("acao")).isin("deduplicado", "dedupe", "duplicado")).count()


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines of a trail that hold something; 0 where there is no trail yet."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return 0
        raise
    return lines.filter(F.trim("value") != "").count()
