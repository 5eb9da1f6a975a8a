"""Identities of documents, messages and orders, and removal of what is known already."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as N
from ..sources.staging import staged

#: Characters between its first and last that a text needs before equal texts count as one document.
LEAST_TEXT = 200


def document_id(sha: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(sha, 1, 24))


def message_hash(channel: Column, conversation: Column, sent_at: Column, external: Column, sender: Column, text: Column) -> Column:
    """sha256 of a JSON object of six fields with sorted keys and spaces after commas and colons."""
    quoted = lambda x: F.when(x.isNull(), "null").otherwise(F.regexp_replace(F.regexp_replace(F.to_json(F.struct(x.alias("v"))), r"^\{\"v\":", ""), r"\}$", ""))
    parts = [("canal", channel), ("conversa_id", conversation), ("enviada_em", sent_at), ("id_externo", external), ("remetente_id", sender), ("texto", text)]
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), quoted(v)) for k, v in parts])
    return F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256)


def dedupe_key(key: Column, cnpj: Column, number: Column, issued: Column, cents: Column, document: Column) -> Column:
    """struct(kind, value): access key, else issuer, number, date and value, else issuer, date and value, else the document."""
    s = lambda *xs: F.concat_ws("|", *[x.cast("string") for x in xs])
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    has = lambda *xs: F.coalesce(*[F.when(x.isNull(), F.lit(False)) for x in xs], F.lit(True))
    return F.when(has(key), one("chave", key)).when(has(cnpj, number, issued, cents), one("forte", s(cnpj, number, issued, cents))).when(has(cnpj, issued, cents), one("fraco", s(cnpj, issued, cents))).otherwise(one("documento", document))


def order_base(key: Column, cnpj: Column, number: Column, issued: Column, cents: Column, document: Column) -> Column:
    """What an order's id is made of; the value decides the form, but is no part of it."""
    s = lambda kind, *xs: F.concat_ws("|", F.lit(kind), *[x.cast("string") for x in xs])
    valued = cents.isNotNull()
    return (
        F.when(key.isNotNull(), s("chave", key)).when(cnpj.isNotNull() & number.isNotNull() & issued.isNotNull() & valued, s("fmt", cnpj, number, issued))
        .when(cnpj.isNotNull() & issued.isNotNull() & valued, s("fraco", cnpj, issued)).otherwise(s("documento", document))
    )


def order_id(base: Column) -> Column:
    return F.concat(F.lit("ped_"), F.substring(F.sha2(base, 256), 1, 16))


def group_key(key: Column, cnpj: Column, number: Column, issued: Column, document: Column) -> Column:
    """By which rows meet in one order: the value is never part of it."""
    s = lambda kind, *xs: F.concat_ws("|", F.lit(kind), *[x.cast("string") for x in xs])
    dated = cnpj.isNotNull() & issued.isNotNull()
    return F.when(key.isNotNull(), s("chave", key)).when(dated & number.isNotNull(), s("fmt", cnpj, number, issued)).when(dated, s("fraco", cnpj, issued)).otherwise(s("documento", document))


def _later(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Adds ``flag``: a row of the same keys comes earlier. First numbers are aggregated, which
    combines before the shuffle, so a key that many rows share is no burden."""
    first = df.groupBy(*keys).agg(F.min("seq").alias("_first"))
    return df.join(first, keys, "left").withColumn(flag, F.coalesce(F.col("seq") > F.col("_first"), F.lit(False))).drop("_first")


def register(batch: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Adds ``duplicate`` and ``barrier`` (mensagem, bytes, texto) to rows of a batch.

    Needs seq, channel, external_id (null but for messages), kind (pdf, imagem, mensagem), sha and
    text_hash, text. Three barriers: a message known by channel and id, equal bytes, equal text
    of a document of 200 characters or more. ``history`` holds known rows of channel,
    external_id, sha and text_hash; a row stopped by one barrier never counts for the next. ``seq``
    is the order of arrival and a row's own.
    """
    c = F.col
    eligible = c("kind").isin("pdf", "imagem") & (F.length(F.trim(F.coalesce("text", F.lit("")))) >= LEAST_TEXT)
    # Hashes and flags only, written once: every barrier reads them several times. Texts join again by seq.
    keys = staged(batch.select("seq", "channel", "external_id", "sha", "text_hash", F.coalesce(eligible, F.lit(False)).alias("_eligible")), "arrivals")
    rows = _later(keys.filter("external_id IS NOT NULL"), ["channel", "external_id"], "_m").unionByName(keys.filter("external_id IS NULL").withColumn("_m", F.lit(False)))
    if history is not None:
        known = history.filter("external_id IS NOT NULL").select("channel", "external_id").distinct().withColumn("_k", F.lit(True))
        rows = rows.join(known, ["channel", "external_id"], "left").withColumn("_m", c("_m") | F.coalesce("_k", F.lit(False))).drop("_k")
    rows = staged(rows, "barrier-messages")
    passed = _later(rows.filter("NOT _m"), ["sha"], "_b")
    if history is not None:
        passed = passed.join(history.select("sha").distinct().withColumn("_k", F.lit(True)), "sha", "left").withColumn("_b", c("_b") | F.coalesce("_k", F.lit(False))).drop("_k")
    passed = staged(passed, "barrier-bytes")
    fresh = _later(passed.filter("NOT _b"), ["text_hash"], "_t")
    if history is not None:
        fresh = fresh.join(history.select("text_hash").distinct().withColumn("_k", F.lit(True)), "text_hash", "left").withColumn("_t", c("_t") | F.coalesce("_k", F.lit(False))).drop("_k")
    stopped = [rows.filter("_m").select("seq", F.lit("mensagem").alias("barrier")), passed.filter("_b").select("seq", F.lit("bytes").alias("barrier")), fresh.filter(c("_eligible") & c("_t")).select("seq", F.lit("texto").alias("barrier"))]
    barriers = functools.reduce(DataFrame.unionByName, stopped)
    return batch.join(barriers, "seq", "left").select(*batch.columns, "barrier").withColumn("duplicate", c("barrier").isNotNull())


def union_readings(readings: DataFrame) -> DataFrame:
    """Two readings of one document made one: the first of each line by pass and place, compared
    without case and spacing. Rows: document_id, pass, text."""
    lines = readings.select("document_id", "pass", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line"))
    keyed = lines.withColumn("_key", F.upper(N.clean_spaces("line")))
    first = keyed.filter("_key <> ''").withColumn("_row", F.row_number().over(Window.partitionBy("document_id", "_key").orderBy("pass", "at"))).filter("_row = 1")
    ordered = first.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("pass", "at", "line"))).alias("_lines"))
    return ordered.select("document_id", F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("text"))


def possible_duplicates(orders: DataFrame, days: int = 3) -> DataFrame:
    """Rows without number and key, with the earliest earlier order of the same issuer and value within ``days``.

    Rows: id, seq, cnpj, cents, issued, order_no, access_key. Dates fall in buckets of ``days`` and
    a row looks into three of them, so the join is on equality, not on a range.
    """
    numbered = orders.filter("cnpj IS NOT NULL AND cents IS NOT NULL AND issued IS NOT NULL").withColumn("_bucket", F.floor(F.unix_date("issued") / days))
    asking = numbered.filter("order_no IS NULL AND access_key IS NULL").withColumn("_bucket", F.explode(F.array(F.col("_bucket") - 1, F.col("_bucket"), F.col("_bucket") + 1)))
    a, b = asking.alias("a"), numbered.alias("b")
    on = (F.col("a.cnpj") == F.col("b.cnpj")) & (F.col("a.cents") == F.col("b.cents")) & (F.col("a._bucket") == F.col("b._bucket"))
    near = a.join(b, on).filter((F.col("b.seq") < F.col("a.seq")) & (F.abs(F.datediff("a.issued", "b.issued")) <= days))
    return near.groupBy(F.col("a.id").alias("id")).agg(F.min_by("b.id", "b.seq").alias("like_id"), F.count("*").alias("n_like"))
