"""One run from an inbox to the ledger: read, register, extract, decide, merge, publish."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reasons as R
from ..functions import scalars as N
from ..operators import decision, identity, ledger, merge, review
from ..operators.extraction import extract
from ..sources import envelopes, files, sinks
from ..sources.staging import staged

#: Engines that read images.
OCR_ENGINES = ("ocr_simulado", "tesseract")
ARTIFACT = ("channel", "external_id", "kind", "sha", "text", "source_file", "engine", "read_confidence")


@dataclass
class Result:
    documents: DataFrame  # every artifact with barrier, fields, score, status, reasons and action
    orders: DataFrame
    ledger: DataFrame
    queue: DataFrame


def _maybe(read) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def artifacts(spark: SparkSession, inbox: str, reader: files.Reader = files.no_reader) -> DataFrame:
    """Documents in ``pdf/`` and messages in ``whatsapp/`` and ``telegram/`` of an inbox, numbered in
    a fixed order: documents by path, then messages by channel, file and line. Folders may be missing."""
    parts = []
    docs = _maybe(lambda: files.inbox(spark, f"{inbox}/pdf"))
    if docs is not None:
        read = files.with_sidecars(files.read_documents(docs.filter(F.col("kind").isin("pdf", "imagem")), reader), files.sidecars(spark, f"{inbox}/pdf"))
        parts.append(read.select(F.lit(0).alias("_rank"), F.col("kind").alias("channel"), F.lit(None).cast("string").alias("external_id"), "kind", "sha", "text", F.col("path").alias("source_file"), "engine", "read_confidence", F.lit(0).cast("long").alias("_line")))
    for rank, (channel, parse) in enumerate((("whatsapp", envelopes.whatsapp_messages), ("telegram", envelopes.telegram_messages)), 1):
        lines = _maybe(lambda c=channel: envelopes.read_lines(spark, f"{inbox}/{c}"))
        if lines is not None:
            found = envelopes.with_identity(parse(lines))
            parts.append(found.select(F.lit(rank).alias("_rank"), "channel", "external_id", F.lit("mensagem").alias("kind"), "sha", "text", "source_file", F.lit("parser").alias("engine"), F.lit(1).cast("decimal(6,4)").alias("read_confidence"), F.monotonically_increasing_id().alias("_line")))
    if not parts:
        raise FileNotFoundError(f"no inbox at {inbox}")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # A range sort and ids by partition number rows in order without gathering them anywhere.
    ordered = rows.orderBy("_rank", "source_file", "_line").withColumn("seq", F.monotonically_increasing_id())
    return ordered.withColumn("text_hash", N.text_hash("text")).select("seq", *ARTIFACT, "text_hash")


def examine(registered: DataFrame, reference: Column) -> DataFrame:
    """Fields, scores, status and reasons of artifacts that are not duplicates."""
    x = registered.filter("NOT duplicate").withColumnRenamed("kind", "artifact_kind").withColumn("ocr", F.coalesce(F.col("engine").isin(*OCR_ENGINES), F.lit(False)))
    x = extract(x, message=F.col("artifact_kind") == "mensagem", ocr=F.col("ocr"))
    shown = {"total": "total_cents", "cnpj": "issuer_cnpj", "issued": "issued", "due": "due", "number": "order_no", "key": "access_key", "payment": "payment_form"}
    evidence = F.create_map(*[v for f, c in shown.items() for v in (F.lit(f), F.col(c).isNotNull())], F.lit("items"), F.size("items") > 0)
    x = x.withColumn("evidence", evidence)
    x = x.withColumn("raised", F.when(F.size("suspicious_lines") > 0, F.array(F.lit("texto_instrucao_suspeita"))).otherwise(F.array().cast("array<string>")))
    return decision.decide(x, reference).withColumn("document_id", identity.document_id(F.col("sha")))


def orders_of(evidence: DataFrame, orders: DataFrame) -> DataFrame:
    """(_of, order_id, _seen) for each ``seq``: its order, and whether an earlier row of the run met that order.
    Rows that are only near an order have none of their own, and count as having met one."""
    c = F.col
    base = identity.order_base(c("access_key"), c("cnpj"), c("order_no"), c("issued"), c("cents"), c("document_id"))
    rows = evidence.select("seq", identity.group_key(c("access_key"), c("cnpj"), c("order_no"), c("issued"), c("document_id")).alias("_group"), identity.order_id(base).alias("_own"))
    first = rows.groupBy("_group").agg(F.min("seq").alias("_first"), F.min_by("_own", "seq").alias("order_id")).join(orders.select("order_id"), "order_id", "left_semi")
    met = rows.select(c("seq").alias("_of"), "_group").join(first, "_group", "left")
    return met.select("_of", "order_id", F.coalesce(c("_of") > c("_first"), F.lit(True)).alias("_seen"))


def process(spark: SparkSession, inbox: str, staging: str, reference: str, processed: str, reader: files.Reader = files.no_reader, history: DataFrame | None = None) -> Result:
    """All steps over an inbox. ``reference`` is the day against which dates are plausible and
    ``processed`` the time written into the ledger; ``history`` holds what earlier runs registered.
    ``staging`` is a folder that all executors share, for tables between steps."""
    arrived = staged(artifacts(spark, inbox, reader), "artifacts", staging)
    registered = staged(identity.register(arrived, history), "registered", staging)
    seen = staged(examine(registered, F.lit(reference).cast("date")), "examined", staging)
    c = F.col
    evidence = seen.select("seq", "document_id", c("total_cents").alias("cents"), c("issuer_cnpj").alias("cnpj"), "issued", "order_no", "access_key", "status", "score")
    merged = merge.merge_orders(evidence)
    first = seen.select("document_id", "channel", "kind", "issuer_name", "due", "payment_form", "items", "reasons", c("sha").alias("content_hash"), "source_file", c("seq").alias("ingest_seq"))
    orders = merged.withColumnsRenamed({"cents": "total_cents", "cnpj": "issuer_cnpj"}).join(first, c("first_document") == c("document_id"))
    rows = ledger.ledger(orders, F.lit(processed))
    queue = seen.select("document_id", F.explode_outer("reasons").alias("reason"), "status").filter("reason IS NOT NULL AND status <> 'auto_aprovado'")
    queue = queue.join(F.broadcast(R.reason_table(spark)), "reason", "left").select("document_id", "reason", "risk", "description", F.lit("aberta").alias("status"))
    known = registered.select("seq", "channel", "external_id", "sha", "source_file", "engine", "read_confidence", "barrier", "duplicate")
    found = seen.select(c("seq").alias("_seq"), "document_id", c("kind").alias("document_kind"), "status", "score", "reasons", "total_cents", "issuer_cnpj", "order_no")
    found = found.join(orders_of(evidence, merged), c("_seq") == c("_of"), "left").drop("_of")
    documents = known.join(found, c("seq") == c("_seq"), "left").withColumn("action", decision.audit_action(c("status"), c("duplicate"), F.coalesce("_seen", F.lit(False)))).drop("_seq", "_seen")
    return Result(documents, orders, rows, queue)


def publish(result: Result, out: str, run_id: str, recorded: str) -> None:
    """Ledger (replaced), audit trail (added to) and queue (replaced) below ``out``."""
    c = F.col
    sinks.write_ledger(result.ledger, f"{out}/ledger")
    audit = result.documents.select(
        F.lit(run_id).alias("rodada_id"), F.lit(recorded).alias("registrado_em"), c("document_id").alias("documento_id"), c("source_file").alias("arquivo"), c("channel").alias("canal"), c("document_kind").alias("tipo_documento"), c("action").alias("acao"), c("engine").alias("motor"), "status", "score",
        c("reasons").alias("motivos"), c("order_id").alias("pedido_id"), c("total_cents").alias("valor_total_centavos"), c("issuer_cnpj").alias("emitente_cnpj"), c("order_no").alias("numero_pedido"), c("read_confidence").alias("confianca_leitura"), c("sha").alias("hash_conteudo"),
    )
    sinks.write_audit(audit, f"{out}/audit")
    result.queue.write.mode("overwrite").json(f"{out}/queue")


def totals(result: Result) -> dict:
    """Counts for the summary and the page."""
    board = review.dashboard(result.orders.select("status", F.col("total_cents").alias("cents")), result.queue)
    return board.first().asDict() | {"artifacts": result.documents.count(), "duplicates": result.documents.filter("duplicate").count()}
