"""Streams of envelopes and events: once each, whatever is delivered again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.envelopes import read_lines, telegram_messages, whatsapp_messages
from ..sources.staging import staged


def landing(spark: SparkSession, path: str, archive: str | None = None) -> DataFrame:
    """Lines of files as they land; read files move to ``archive``."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(path)


def messages(spark: SparkSession, path: str, channel: str, archive: str | None = None) -> DataFrame:
    """Messages of a channel's landing folder; an unknown channel is an error."""
    parse = {"whatsapp": whatsapp_messages, "telegram": telegram_messages}
    if channel not in parse:
        raise ValueError(f"unknown channel {channel}")
    return parse[channel](landing(spark, path, archive))


def next_offset(updates: DataFrame) -> DataFrame:
    """One row: the offset after the last update received, of whatever chat."""
    return updates.agg((F.max("update_id") + 1).alias("next_offset"))


def ingest_once(stream: DataFrame, keys: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Append rows whose keys the target does not hold, one batch after another, until no input is left.

    A batch run again after a failure writes what is still missing, so the target is the same as
    after one run.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            known = spark.read.parquet(target).select(*keys)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            fresh = fresh.join(known, keys, "left_anti")
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass
class Collected:
    envelopes: int  # with an entry, written to the target
    discarded: int  # well formed, but without an entry: news of a delivery
    invalid: int  # lines that are no JSON
    moved: int  # files put aside


def collect_webhooks(spark: SparkSession, path: str, target: str, done: str = "processados", move: bool = True) -> Collected:
    """Envelopes of the ``.json`` and ``.jsonl`` files right in ``path``, added to ``target`` as lines.

    Files move to the folder ``done`` below ``path`` only when at least one envelope was found among
    them; files with nothing but news of deliveries stay and are read again. A folder that is
    missing, or has no such file, gives zeros.
    """
    try:
        lines = read_lines(spark, f"{path}/*.{{json,jsonl}}").filter(F.trim("value") != "")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return Collected(0, 0, 0, 0)
    parsed = F.try_parse_json("value")
    entry = F.try_variant_get(parsed, "$.entry", "variant")
    some = F.schema_of_variant(parsed).startswith("OBJECT") & ~F.coalesce(F.to_json(entry), F.lit("null")).isin("null", "[]", "{}", '""', "0", "false")
    kind = F.when(parsed.isNull(), "invalid").when(some, "envelope").otherwise("discarded")
    read = staged(lines.select("value", "source_file", kind.alias("kind")), "webhooks")
    counts = {r.kind: r["count"] for r in read.groupBy("kind").count().collect()}
    moved = 0
    if counts.get("envelope"):
        read.filter("kind = 'envelope'").select("value").write.mode("append").text(target)
        if move:
            moved = _put_aside(spark, read.select("source_file").distinct(), f"{path}/{done}")
    return Collected(counts.get("envelope", 0), counts.get("discarded", 0), counts.get("invalid", 0), moved)


def _put_aside(spark: SparkSession, files: DataFrame, folder: str) -> int:
    """Moves files, one after another as file systems do; one that cannot be moved stays."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    to = path(folder)
    system = to.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(to)
    sources = (path(spark._jvm.java.net.URI(r.source_file)) for r in files.toLocalIterator())
    return sum(bool(system.rename(source, path(to, source.getName()))) for source in sources)
