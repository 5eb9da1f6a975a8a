"""Reconciliation, scores and decisions over extracted fields, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reasons as R
from ..functions import scalars as N
from ..functions import text as T

#: Weight of each field in the document's score.
WEIGHTS = {"total": 3, "cnpj": 3, "issued": 2, "due": 2, "number": 1, "key": 1, "payment": 1, "items": 1}
ALWAYS = ("total", "cnpj", "issued")
_DEC = "decimal(20,10)"


def _d(x: str) -> Column:
    return F.lit(x).cast(_DEC)


def item_cents(quantity: Column, unit_cents: Column) -> Column:
    """Cents of a line, rounded half up; null if either is."""
    return F.round(quantity.cast("decimal(28,6)") * unit_cents.cast("decimal(20,0)"), 0).cast("bigint")


def items_sum(items: Column) -> Column:
    """Strict: null if a line lacks its quantity or price, or without lines."""
    parts = F.transform(items, lambda x: item_cents(x["quantity"], x["unit_cents"]))
    whole = (F.size(items) > 0) & ~F.exists(parts, lambda p: p.isNull())
    return F.when(whole, F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a + p))


def items_sum_lenient(items: Column) -> Column:
    """A line's own total, else quantity by price; lines with neither are passed over."""
    parts = F.array_compact(F.transform(items, lambda x: F.coalesce(x["total_cents"], item_cents(x["quantity"], x["unit_cents"]))))
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a + p))


def difference(total: Column, items_total: Column, discount: Column, freight: Column) -> Column:
    return F.abs(total - (items_total - F.coalesce(discount, F.lit(0)) + F.coalesce(freight, F.lit(0))))


def bucket(diff: Column) -> Column:
    return F.when(diff.isNull(), "total_sem_detalhamento").when(diff <= R.SAME_CENTS, "casa").when(diff <= R.NEAR_CENTS, "suspeita_soma_itens").otherwise("divergencia_soma_itens")


def context(df: DataFrame, reference: Column) -> DataFrame:
    """Adds ``ctx``: presence, checksum factor, corroboration and score of every field.

    Needs total_cents, issuer_cnpj, access_key, issued, due, order_no, payment_form, items,
    discount_cents, freight_cents, ``ocr``, ``evidence`` (map of field to boolean) and
    ``read_scores`` (map of field to decimal, may lack any).
    """
    c = F.col
    df = df.withColumn("_sum", items_sum(c("items")))
    df = df.withColumn("difference_cents", difference(c("total_cents"), c("_sum"), c("discount_cents"), c("freight_cents")))
    closed = F.coalesce(c("difference_cents") <= R.SAME_CENTS, F.lit(False))
    has_items = F.coalesce(F.size("items"), F.lit(0)) > 0
    df = df.withColumn("_cnpj", N.normalize_cnpj("issuer_cnpj")).withColumn("_key_ok", N.access_key_valid("access_key"))
    df = df.withColumn("_key", N.key_parts(F.when(c("_key_ok"), c("access_key"))))
    issued_ok = N.plausible_date("issued", reference)
    due_ok = N.plausible_date("due", reference) & ~F.coalesce(c("due") < c("issued"), F.lit(False))
    present = {
        "total": c("total_cents").isNotNull(), "cnpj": c("_cnpj.value").isNotNull(), "issued": c("issued").isNotNull(), "due": c("due").isNotNull(),
        "number": F.coalesce(c("order_no") != "", F.lit(False)), "key": c("access_key").isNotNull(), "payment": c("payment_form").isNotNull(), "items": has_items,
    }
    same = lambda x: F.coalesce(x, F.lit(False))
    backed = {
        "total": closed, "items": closed & has_items, "cnpj": same(c("_key.cnpj") == c("_cnpj.value")),
        "issued": same((c("_key.year") == F.year("issued")) & (c("_key.month") == F.month("issued"))), "number": same(c("_key.number").isNotNull() & N.same_number(c("_key.number"), c("order_no"))),
    }
    pass_fail = lambda ok, there: F.when(ok, _d("1")).when(there, _d("0")).otherwise(_d("0.5"))
    sums = F.when(~closed & has_items & c("difference_cents").isNull(), _d("0.5")).otherwise(_d("1"))
    check = {
        "total": sums, "items": sums, "cnpj": pass_fail(c("_cnpj.valid"), present["cnpj"]), "issued": pass_fail(issued_ok, present["issued"]), "due": pass_fail(due_ok, present["due"]),
        "key": pass_fail(c("_key_ok"), present["key"]), "number": _d("1"), "payment": _d("1"),
    }

    def score(f: str) -> Column:
        shown = F.coalesce(F.try_element_at("evidence", F.lit(f)), F.lit(False))
        told = F.try_element_at("read_scores", F.lit(f)).cast(_DEC)
        base = F.when(c("ocr"), _d("0.65")).when(shown, _d("0.95")).otherwise(_d("0.80"))
        agree = F.when(backed.get(f, F.lit(False)), _d("1")).when(shown, _d("0.85")).otherwise(_d("0.60"))
        out = F.when((told > 0) & (told <= 1), told).otherwise((base * check[f] * agree).cast(_DEC))
        out = F.when(backed.get(f, F.lit(False)) & (check[f] > 0), F.greatest(out, _d("0.95"))).otherwise(out)
        return F.when(c("ocr"), F.least(out, _d("0.65"))).otherwise(out)

    needed = lambda f: F.lit(True) if f in ALWAYS else (c("kind") == "pedido" if f == "number" else F.lit(False))
    fields = [F.struct(F.lit(f).alias("field"), F.lit(w).alias("weight"), present[f].alias("present"), needed(f).alias("needed"), F.when(present[f], score(f)).otherwise(_d("0")).alias("score")) for f, w in WEIGHTS.items()]
    df = df.withColumn("_fields", F.filter(F.array(*fields), lambda x: x["present"] | x["needed"]))
    total = F.aggregate("_fields", _d("0").cast("decimal(30,10)"), lambda a, x: (a + x["score"] * x["weight"]).cast("decimal(30,10)"))
    weight = F.aggregate("_fields", F.lit(0), lambda a, x: a + x["weight"])
    df = df.withColumn("score", F.round(total / weight, 4).cast("decimal(6,4)"))
    df = df.withColumn("field_scores", F.map_from_entries(F.transform("_fields", lambda x: F.struct(x["field"], F.round(x["score"], 4).cast("decimal(6,4)")))))
    df = df.withColumn("weak", F.exists("_fields", lambda x: x["needed"] & (x["score"] < _d(R.MANDATORY))))
    facts = F.struct(
        F.exists(F.array(*present.values()), lambda x: x).alias("any"), c("_cnpj.valid").alias("cnpj_ok"), c("_key_ok").alias("key_ok"), issued_ok.alias("issued_ok"), closed.alias("closed"),
    )
    return df.withColumn("ctx", facts).drop("_sum", "_cnpj", "_key_ok", "_key", "_fields")


def decide(df: DataFrame, reference: Column) -> DataFrame:
    """Adds score, field_scores, reasons (in the order they are raised, each once) and status.

    Also needs ``raised`` (reasons the extraction gave), ``read_confidence``, ``issued_ambiguous``
    and ``notes``. ``reference`` is the day against which dates are plausible.
    """
    df = context(df, reference)
    c = F.col
    missing = c("total_cents").isNull()
    empty = ~c("ctx.any")
    illegible = F.coalesce(c("read_confidence"), F.lit(0)) <= 0
    early = F.array_compact(F.array(
        F.when(empty & illegible, "documento_ilegivel"), F.when(empty & ~illegible, "sem_campos_obrigatorios"),
        F.when(c("issuer_cnpj").isNotNull() & ~c("ctx.cnpj_ok"), "cnpj_dv_invalido"), F.when(c("access_key").isNotNull() & ~c("ctx.key_ok"), "chave_acesso_dv_invalido"),
    ))
    df = df.withColumn("_early", early)
    rejections = F.array_compact(F.concat("_early", F.array(
        F.when(missing & (F.size("_early") == 0), "valor_total_ausente"), F.when(~missing & ~c("total_cents").between(R.LEAST_CENTS, R.MOST_CENTS), "valor_total_fora_da_faixa"),
        F.when(c("issued").isNotNull() & ~c("ctx.issued_ok"), "data_implausivel"),
    )))
    df = df.withColumn("_rejections", rejections)
    diff = bucket(c("difference_cents"))
    shown = F.coalesce(F.try_element_at("evidence", F.lit("total")), F.lit(False))
    trusted = shown | c("ctx.closed") | (F.coalesce(F.try_element_at("read_scores", F.lit("total")).cast(_DEC), _d("0")) >= _d(R.MANDATORY))
    instructed = F.array_contains("raised", "texto_instrucao_suspeita") | T.injection_in_text(c("notes"))
    blocks = F.array_compact(F.array(
        F.when(c("due") < c("issued"), "data_implausivel"), F.when(~missing & (diff != "casa"), diff),
        F.when(~missing & (F.size("_rejections") == 0) & ~trusted, "suspeita_soma_itens"), F.when(instructed, "texto_instrucao_suspeita"),
    ))
    df = df.withColumn("_blocks", blocks)
    noted = F.array_compact(F.concat("raised", F.array(F.when(c("issued_ambiguous"), "data_ambigua"), F.when(instructed, "texto_instrucao_suspeita"))))
    status = (
        F.when(F.size("_rejections") > 0, "rejeitado").when(F.size("_blocks") > 0, "revisao_humana")
        .when((c("score") >= _d(R.APPROVE)) & ~c("weak"), "auto_aprovado").when(c("score") >= _d(R.REJECT), "revisao_humana").otherwise("rejeitado")
    )
    low = (F.size("_rejections") == 0) & (F.size("_blocks") == 0) & (status != "auto_aprovado")
    reasons = F.array_distinct(F.concat(noted, "_rejections", "_blocks", F.array_compact(F.array(F.when(low, "baixa_confianca")))))
    return df.withColumn("status", status).withColumn("reasons", reasons).drop("_early", "_rejections", "_blocks", "ctx")


def audit_action(status: Column, duplicate: Column, seen: Column) -> Column:
    """What the audit trail calls the outcome of one document."""
    return F.when(duplicate, "deduplicado").when(status == "auto_aprovado", F.when(seen, "atualizado").otherwise("inserido")).when(status == "revisao_humana", "revisao").otherwise("rejeitado")
