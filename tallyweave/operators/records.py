"""Rows that a run leaves behind: item lines, the document's own status, its message, and ids in human order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The outcome of an order and the status that its document takes.
DOCUMENT_STATUS = {"auto_aprovado": "validado", "revisao_humana": "excecao", "rejeitado": "rejeitado"}
#: Columns of a document that may change once it is registered.
CHANGEABLE = ("origem", "arquivo_uri", "mime", "paginas", "texto_norm_sha256", "tipo_doc", "recebido_em", "processado_em", "status")


def document_status(outcome: Column) -> Column:
    """An outcome that is null or none of the three leaves the document extracted."""
    known = [F.when(outcome == k, F.lit(v)) for k, v in DOCUMENT_STATUS.items()]
    return F.coalesce(*known, F.lit("extraido"))


def change_documents(documents: DataFrame, changes: DataFrame, key: str = "documento_id") -> DataFrame:
    """``documents`` with the values of ``changes``, of which each key has one row at most; columns that
    must not change are an error. Keys without changes stay, changes without a document are left out."""
    given = [c for c in changes.columns if c != key]
    wrong = sorted(set(given) - set(CHANGEABLE))
    if wrong:
        raise ValueError(f"columns of a document that do not change: {', '.join(wrong)}")
    there = changes.select(F.col(key).alias("_key"), F.struct(F.lit(1).alias("_"), *given).alias("_new"))
    rows = documents.join(there, F.col(key) == F.col("_key"), "left")
    value = lambda c: F.when(F.col("_key").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c)
    return rows.select(*[value(c) for c in documents.columns])


def sync_documents(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Documents take the status of their order's outcome and the time; a kind that was found replaces
    theirs, a text hash only fills a gap. ``outcomes``: documento_id, outcome, tipo_doc, texto_norm_sha256,
    processado_em, one row for each document at most."""
    c = F.col
    old = documents.select(c("documento_id").alias("_key"), c("tipo_doc").alias("_kind"), c("texto_norm_sha256").alias("_hash"))
    new = outcomes.join(old, c("documento_id") == c("_key")).select("documento_id", document_status(c("outcome")).alias("status"), "processado_em", F.coalesce("tipo_doc", "_kind").alias("tipo_doc"), F.coalesce("_hash", "texto_norm_sha256").alias("texto_norm_sha256"))
    return change_documents(documents, new)


def item_rows(orders: DataFrame, items: str = "items") -> DataFrame:
    """One row for each item of (order_id, items of description, quantity, unit_cents, total_cents), lines
    from 1; a missing total is quantity by unit price, half up, where both are known. No items, no rows."""
    x = orders.select("order_id", F.posexplode(items).alias("_at", "i"))
    derived = F.round(F.col("i.quantity") * F.col("i.unit_cents"), 0).cast("bigint")
    return x.select("order_id", (F.col("_at") + 1).alias("line"), F.col("i.description").alias("description"), F.col("i.quantity").alias("quantity"), F.col("i.unit_cents").alias("unit_cents"), F.coalesce("i.total_cents", derived).alias("total_cents"))


def message_of_documents(documents: DataFrame, messages: DataFrame) -> DataFrame:
    """``documents`` with ``message_id``: of several messages of a document the smallest id, null without one."""
    first = messages.filter("document_id IS NOT NULL").groupBy("document_id").agg(F.min("id").alias("message_id"))
    return documents.join(first, "document_id", "left")


def natural_key(identifier: Column) -> Column:
    """struct(prefix, number) by which ids sort as people count: 0 where no digits end the id, or none that a
    decimal of 38 places holds. Null sorts as the empty id."""
    x = F.coalesce(identifier, F.lit(""))
    tail = F.regexp_extract(x, "([0-9]+)$", 1)
    return F.struct(F.substring(x, F.lit(1), F.length(x) - F.length(tail)).alias("prefix"), F.coalesce(tail.try_cast("decimal(38,0)"), F.lit(0)).alias("number"))

