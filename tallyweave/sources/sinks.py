"""Where results go: ledger, audit trail, queue, summary and a page to look at."""

from __future__ import annotations

import html
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ledger as L
from .staging import staged

AUDIT = (
    "rodada_id", "registrado_em", "documento_id", "arquivo", "canal", "tipo_documento", "acao", "motor", "status", "score", "motivos", "pedido_id", "valor_total_centavos", "emitente_cnpj", "numero_pedido", "confianca_leitura", "hash_conteudo",
)


def read_ledger(like: DataFrame, path: str) -> DataFrame | None:
    """The ledger that stands at ``path``, or None."""
    try:
        return like.sparkSession.read.schema(like.schema).option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_ledger(ledger: DataFrame, path: str) -> None:
    """The whole ledger as CSV with a header, replaced at every run: what earlier runs wrote is carried on."""
    before = read_ledger(ledger, path)
    if before is not None:  # written elsewhere first, since the old one is read and replaced
        ledger = staged(L.carried(ledger, before), "ledger")
    ledger.write.mode("overwrite").option("header", True).csv(path)


def write_audit(audit: DataFrame, path: str) -> None:
    """Audit lines are only ever added; each run is a partition."""
    audit.write.mode("append").partitionBy("rodada_id").json(path)


def queue_json(public: DataFrame, generated: str, version: str = "1.0") -> str:
    """One JSON object of the open exceptions in order; meant for a review queue, read row by row."""
    rows = [json.loads(r.j) for r in public.select(F.to_json(F.struct(*public.columns)).alias("j")).toLocalIterator()]
    return json.dumps({"versao": version, "gerado_em": generated, "total": len(rows), "pendencias": rows}, ensure_ascii=False)


def summary(documents: DataFrame) -> DataFrame:
    """One row: documents, and maps of counts by kind, status, engine and reason."""

    def counts(column: str, rows: DataFrame) -> DataFrame:
        c = rows.groupBy(column).agg(F.count("*").alias("n")).filter(F.col(column).isNotNull())
        return c.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(column), "n")))).alias(f"by_{column}"))

    out = documents.agg(F.count("*").alias("documents"))
    for column in ("kind", "status", "engine"):
        out = out.crossJoin(counts(column, documents))  # one row each
    return out.crossJoin(counts("reason", documents.select(F.explode("reasons").alias("reason"))))


def page(title: str, totals: dict, rows: list[dict]) -> str:
    """A self-contained page; every value is escaped."""
    e = lambda x: html.escape("" if x is None else str(x))
    cards = "".join(f"<li><b>{e(v)}</b> {e(k)}</li>" for k, v in totals.items())
    head = "".join(f"<th>{e(k)}</th>" for k in (rows[0] if rows else {}))
    body = "".join("<tr>" + "".join(f"<td>{e(v)}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{e(title)}</title><h1>{e(title)}</h1><ul>{cards}</ul><table><tr>{head}</tr>{body}</table>"
