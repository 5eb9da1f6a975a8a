"""The ledger of 20 columns, its marks and its scoreboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import reasons as R
from ..functions import scalars as N

#: The ledger's columns, in order.
COLUMNS = (
    "data_processamento", "documento_id", "pedido_id", "origem", "tipo_documento", "numero_pedido", "emitente_nome", "emitente_cnpj", "data_emissao", "data_vencimento",
    "valor_total", "valor_total_centavos", "forma_pagamento", "qtd_itens", "chave_acesso_nf", "confianca", "status_validacao", "hash_conteudo", "arquivo_origem", "row_id_planilha",
)
#: Cells that carry marks, and the ledger column that each mark's field stands for.
MARKED = ("valor_total", "emitente_cnpj", "chave_acesso_nf", "data_emissao", "data_vencimento", "numero_pedido", "emitente_nome")
COLOURS = {"leitura": "FFFFC000", "ausente": "FFFFC000", "contradicao": "FFFF0000", "ilegivel": "FFFF0000", "linha": "FFFFF2CC"}
_BY_FIELD = {code: field for code, field, _, _ in R.REASONS}


def admitted(df: DataFrame) -> DataFrame:
    """Every order, but for empty envelopes: message files none of whose six fields was read."""
    six = ("total_cents", "issuer_cnpj", "issued", "order_no", "access_key", "payment_form")
    blank = F.lit(True)
    for f in six:
        blank = blank & F.col(f).isNull()
    return df.filter(~(F.coalesce(F.lower("source_file").endswith(".jsonl"), F.lit(False)) & blank))


def _number_rows(df: DataFrame, salts: int = 64) -> DataFrame:
    """Sheet rows from 2 in order of ``ingest_seq``: counts of ranges come first, so no task holds all rows."""
    span = df.agg(F.min("ingest_seq").alias("lo"), F.max("ingest_seq").alias("hi")).first()
    lo, width = span["lo"] or 0, max(1, ((span["hi"] or 0) - (span["lo"] or 0)) // salts + 1)
    dealt = df.withColumn("_part", F.floor((F.col("ingest_seq") - lo) / width).cast("int"))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    row = F.row_number().over(Window.partitionBy("_part").orderBy("ingest_seq", "document_id"))
    return dealt.withColumn("_row", row).join(F.broadcast(before), "_part").withColumn("row_id_planilha", (F.col("_first") + F.col("_row") + 1).cast("long")).drop("_part", "_row", "_first")


def ledger(orders: DataFrame, processed: Column) -> DataFrame:
    """Ledger rows as text, blanks for nulls, numbered by arrival."""
    rows = _number_rows(admitted(orders))
    iso = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    values = {
        "data_processamento": processed.cast("string"), "documento_id": iso("document_id"), "pedido_id": iso("order_id"), "origem": iso("channel"), "tipo_documento": iso("kind"),
        "numero_pedido": iso("order_no"), "emitente_nome": iso("issuer_name"), "emitente_cnpj": N.format_cnpj("issuer_cnpj"), "data_emissao": iso("issued"), "data_vencimento": iso("due"),
        "valor_total": N.format_brl("total_cents"), "valor_total_centavos": iso("total_cents"), "forma_pagamento": iso("payment_form"), "qtd_itens": F.coalesce(F.size("items"), F.lit(0)).cast("string"),
        "chave_acesso_nf": iso("access_key"), "confianca": iso("score"), "status_validacao": iso("status"), "hash_conteudo": iso("content_hash"), "arquivo_origem": iso("source_file"), "row_id_planilha": F.col("row_id_planilha"),
    }
    return rows.select(*[values[c].alias(c) for c in COLUMNS])


def carried(new: DataFrame, before: DataFrame) -> DataFrame:
    """The ledger after a later run. Rows of ``before`` keep their place and the time they were first
    written with; orders that ``new`` has again take its other values; further orders follow."""
    c = F.col
    b = before.select(c("pedido_id").alias("_id"), F.nullif("data_processamento", F.lit("")).alias("_time"), c("row_id_planilha").cast("long").alias("_place"))
    last = b.agg(F.max("_place")).first()[0] or 1
    place = F.coalesce("_place", c("row_id_planilha") + last).alias("ingest_seq")
    again = new.join(b, c("pedido_id") == c("_id"), "left").withColumn("data_processamento", F.coalesce("_time", "data_processamento"))
    gone = before.join(new.select(c("pedido_id").alias("_id")), c("pedido_id") == c("_id"), "left_anti")
    cells = [x for x in COLUMNS if x != "row_id_planilha"]
    rows = again.select(*cells, place).unionByName(gone.select(*cells, c("row_id_planilha").cast("long").alias("ingest_seq")))
    return _number_rows(rows.withColumn("document_id", c("documento_id"))).select(*COLUMNS)


def marks(reasons: Column, cells: dict[str, Column]) -> Column:
    """Map of cell to ok, ausente, leitura, contradicao or ilegivel. ``cells`` has the value of each."""
    unread = F.exists(reasons, lambda r: r.isin(*R.ILLEGIBLE))
    loose = F.exists(reasons, lambda r: r.isin(*[c for c, f in _BY_FIELD.items() if not f and c not in R.ILLEGIBLE]))

    def mark(cell: str, value: Column) -> Column:
        own = [c for c, f in _BY_FIELD.items() if f == cell]
        against = F.exists(reasons, lambda r: r.isin(*[c for c in own if c in R.CONTRADICTIONS] or [""]))
        doubtful = F.exists(reasons, lambda r: r.isin(*[c for c in own if c not in R.CONTRADICTIONS] or [""]))
        return F.when(unread, "ilegivel").when(against, "contradicao").when(value.isNull(), "ausente").when(doubtful | loose, "leitura").otherwise("ok")

    return F.create_map(*[x for cell, value in cells.items() for x in (F.lit(cell), mark(cell, value))])


def shown(mark: Column, value: Column) -> Column:
    """What a cell says: its value, or that it could not be read or found."""
    return F.when(mark == "ilegivel", "ILEGIVEL").when(mark == "ausente", "NAO ENCONTRADO").otherwise(F.coalesce(value.cast("string"), F.lit("")))


def row_status(marked: Column) -> Column:
    values = F.map_values(marked)
    return F.when(F.array_contains(values, "ilegivel"), "ILEGIVEL").when(F.exists(values, lambda v: v != "ok"), "CONFERIR").otherwise("OK")


def colours(marked: Column, reasons: Column) -> Column:
    """Map of cell to fill colour; key ``linha`` colours the whole row where a reason is a risk."""
    tint = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    cells = F.map_filter(F.transform_values(marked, lambda k, v: F.try_element_at(tint, v)), lambda k, v: v.isNotNull())
    risky = F.exists(reasons, lambda r: r.isin(*R.RISKY))
    line = F.when(risky, COLOURS["contradicao"]).when(F.size(cells) > 0, COLOURS["linha"])
    return F.when(line.isNotNull(), F.map_concat(cells, F.create_map(F.lit("linha"), line))).otherwise(cells)


def scoreboard_bucket(marked: Column, reasons: Column) -> Column:
    """The one bucket that a row counts in, worst first."""
    values = F.map_values(marked)
    return (
        F.when(F.array_contains(values, "ilegivel"), "ilegivel").when(F.exists(reasons, lambda r: r.isin(*R.RISKY)), "risco")
        .when(F.array_contains(values, "contradicao"), "contradicao").when(F.exists(values, lambda v: v.isin("leitura", "ausente")), "duvida").otherwise("limpa")
    )
