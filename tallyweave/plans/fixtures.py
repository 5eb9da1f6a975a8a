"""Inputs derived from the sample tables: amounts, dates, invoices and decisions to be read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as N


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: str) -> Column:
    return F.round(F.col(x).cast("decimal(18,2)") * 100, 0).cast("bigint")


def padded(x: Column | str, n: int) -> Column:
    return F.lpad((F.col(x) if isinstance(x, str) else x).cast("string"), n, "0")


def company(key: Column | str) -> Column:
    """A tax number with right check digits for a key."""
    return N.cnpj_with_check_digits(F.concat(padded(key, 8), F.lit("0001")))


def grouped(c: Column) -> Column:
    """1.234.567 from whole units."""
    s = c.cast("string")
    return F.regexp_replace(s, r"(?<=\d)(?=(\d{3})+$)", ".")


def brl(c: Column) -> Column:
    return F.concat(grouped(F.floor(c / 100)), F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with items as the text of an invoice: o_orderkey, text."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"), cents("l_extendedprice").alias("c"))
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(" PECA "), F.col("l_partkey").cast("string"), F.lit("   "), F.col("q").cast("string"), F.lit(",0000 UN "), brl(F.floor(F.col("c") / F.greatest("q", F.lit(1)))), F.lit(" "), brl(F.col("c")))
    body = i.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))).alias("rows"), F.sum("c").alias("total"))  # an order's few items
    rows = o.join(body, F.col("o_orderkey") == F.col("l_orderkey"))
    text = F.concat_ws(
        "\n", F.lit("NOTA FISCAL"), F.lit(""), F.lit("EMITENTE"), F.concat(F.lit("Casa "), F.col("o_custkey").cast("string"), F.lit(" LTDA")), F.concat(F.lit("CNPJ: "), N.format_cnpj(company("o_custkey"))), F.lit(""),
        F.lit("DESTINATARIO"), F.lit("Cliente SA"), F.lit("CNPJ/CPF: 45.998.001/0001-05"), F.lit(""), F.concat(F.lit("N DO PEDIDO: "), F.col("o_orderkey").cast("string")),
        F.concat(F.lit("DATA DE EMISSAO: "), F.date_format("day", "dd/MM/yyyy")), F.concat(F.lit("VENCIMENTO: "), F.date_format(F.date_add("day", 30), "yyyy-MM-dd")), F.lit(""), F.lit("ITENS"), F.lit("SEQ DESCRICAO QTD UN UNITARIO SOMA"),
        F.array_join(F.transform("rows", lambda x: x["line"]), "\n"), F.lit(""), F.concat(F.lit("VALOR TOTAL DA NOTA: R$ "), brl(F.col("total"))), F.lit("FORMA DE PAGAMENTO: PIX"),
    )
    return rows.select("o_orderkey", text.alias("text"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as extracted fields, with what is missing, wrong or doubtful decided by its key."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    total = F.when(k % 11 != 0, cents("o_totalprice"))
    delta = F.element_at(F.array(*map(F.lit, (0, 1, 5, 20))), (k % 4 + 1).cast("int"))
    item = F.struct(F.lit("PECA").alias("description"), F.lit(1).cast("decimal(18,6)").alias("quantity"), (cents("o_totalprice") + delta).alias("unit_cents"), F.lit(None).cast("bigint").alias("total_cents"))
    cnpj = company("o_custkey")
    wrong = F.concat(F.substring(cnpj, 1, 13), ((F.substring(cnpj, 14, 1).cast("int") + 1) % 10).cast("string"))
    true = F.lit(True)
    evidence = F.create_map(F.lit("total"), k % 17 != 0, *[x for f in ("cnpj", "issued", "due", "number", "payment", "items") for x in (F.lit(f), true)])
    day = F.col("o_orderdate").cast("date")
    return o.select(
        "o_orderkey", "o_custkey", F.concat(F.lit("doc_"), k.cast("string")).alias("document_id"), F.lit("pdf").alias("channel"), F.when(k % 2 == 0, "nf").otherwise("pedido").alias("kind"), total.alias("total_cents"),
        F.when(k % 13 == 0, wrong).otherwise(cnpj).alias("issuer_cnpj"), F.lit(None).cast("string").alias("access_key"), day.alias("issued"), F.date_add(day, 30).alias("due"), k.cast("string").alias("order_no"), F.lit("pix").alias("payment_form"),
        F.when(k % 7 == 0, F.array().cast("array<struct<description:string,quantity:decimal(18,6),unit_cents:bigint,total_cents:bigint>>")).otherwise(F.array(item)).alias("items"),
        F.lit(None).cast("bigint").alias("discount_cents"), F.lit(None).cast("bigint").alias("freight_cents"), (k % 5 == 0).alias("ocr"), evidence.alias("evidence"), F.create_map().cast("map<string,decimal(6,4)>").alias("read_scores"),
        F.when(k % 19 == 0, F.array(F.lit("texto_instrucao_suspeita"))).otherwise(F.array().cast("array<string>")).alias("raised"), F.lit(1.0).alias("read_confidence"), (k % 23 == 0).alias("issued_ambiguous"), F.lit(None).cast("string").alias("notes"),
        F.date_add(day, F.when(k % 29 == 0, 900).otherwise(10)).alias("reference"), F.concat(F.lit("Fornecedor "), F.col("o_custkey").cast("string")).alias("issuer_name"), F.concat(F.lit("/in/"), k.cast("string"), F.lit(".pdf")).alias("source_file"), k.alias("ingest_seq"),
    )
