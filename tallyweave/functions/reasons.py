"""Reason codes, statuses and thresholds: the dimension tables of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Code, ledger field, risk, what is wrong.
REASONS = (
    ("documento_ilegivel", "", "alto", "No field could be read."),
    ("sem_campos_obrigatorios", "", "alto", "No mandatory field was found."),
    ("cnpj_dv_invalido", "emitente_cnpj", "alto", "The issuer's tax number fails its check digits."),
    ("chave_acesso_dv_invalido", "chave_acesso_nf", "alto", "The access key fails its check digit."),
    ("valor_total_ausente", "valor_total", "alto", "No total was found."),
    ("valor_total_fora_da_faixa", "valor_total", "alto", "The total is out of range."),
    ("data_implausivel", "data_emissao", "alto", "A date is implausible, or due precedes issue."),
    ("data_ambigua", "data_emissao", "medio", "Day and month of the date could be swapped."),
    ("suspeita_soma_itens", "valor_total", "medio", "Items nearly add up to the total."),
    ("divergencia_soma_itens", "valor_total", "alto", "Items do not add up to the total."),
    ("total_sem_detalhamento", "valor_total", "medio", "The total cannot be checked against items."),
    ("texto_instrucao_suspeita", "", "alto", "The text tries to instruct its reader."),
    ("baixa_confianca", "", "medio", "Fields were read with low confidence."),
    ("possivel_duplicata", "", "alto", "An order of like date, issuer and value is known."),
    ("conflito_valor_mesma_chave", "valor_total", "alto", "The order is known with other values."),
)
CODES = tuple(r[0] for r in REASONS)
RISKY = ("texto_instrucao_suspeita", "possivel_duplicata", "conflito_valor_mesma_chave")
CONTRADICTIONS = ("divergencia_soma_itens", "conflito_valor_mesma_chave", "possivel_duplicata")
ILLEGIBLE = ("documento_ilegivel", "sem_campos_obrigatorios")
APPROVE, REJECT, MANDATORY = "0.90", "0.60", "0.80"
SAME_CENTS, NEAR_CENTS = 2, 10
LEAST_CENTS, MOST_CENTS = 1, 1_000_000_000


def reason_table(spark: SparkSession) -> DataFrame:
    """Fifteen rows: reason, field, risk, description."""
    return spark.createDataFrame([*REASONS], "reason string, field string, risk string, description string")


def detail(reason, total_cents, items_cents, difference_cents):
    """What the queue says about a reason on one document: the numbers where they explain it."""
    from pyspark.sql import functions as F

    from .scalars import brl_label

    sums = F.concat(F.lit("total "), brl_label(total_cents), F.lit(", items "), brl_label(items_cents), F.lit(", difference "), brl_label(difference_cents))
    known = F.create_map(*[F.lit(x) for code, _, _, text in REASONS for x in (code, text)])
    return F.when(reason.isin("divergencia_soma_itens", "suspeita_soma_itens"), sums).otherwise(F.coalesce(F.try_element_at(known, reason), reason))
