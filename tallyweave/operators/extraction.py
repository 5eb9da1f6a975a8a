"""Fields of invoices, orders and messages from their text, and how sure they were read.

Lines are read in Python by :mod:`.reading`, one pass for each text; what is normalised, checked
and scored after that are expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reasons as R
from ..functions import scalars as N
from ..functions import text as T
from . import decision, reading
from .reading import LABELS

#: Fixed values of how sure a field was read: by reader with a strong and a weak label, then the factors for a
#: check that decides nothing, a date of two readings, and a field for which only its own text speaks.
BASE = {"native": ("0.95", "0.80"), "ocr": ("0.65", "0.55")}
UNDECIDED, ODD, SHOWN = "0.50", "0.70", "0.85"
#: Weights of fields in read_score; all others weigh 1.
WEIGHTS = {"total": 3, "cnpj": 3, "issued": 2, "due": 2}


def read_scores(ocr: Column) -> dict[str, Column]:
    """How sure each field was read, from the columns of :func:`extract`: the label's trust, the field's
    own check, doubt about its form, and what speaks for it beside. Null where the field is."""
    c = F.col
    d = lambda x: F.lit(str(x)).cast("decimal(10,6)")
    base = lambda strong: F.when(ocr, F.when(strong, d(BASE["ocr"][0])).otherwise(d(BASE["ocr"][1]))).otherwise(F.when(strong, d(BASE["native"][0])).otherwise(d(BASE["native"][1])))
    sure = F.lit(True)

    def score(there: Column, strong: Column, *factors: Column) -> Column:
        out = base(strong)
        for f in factors:
            out = (out * f).cast("decimal(16,10)")
        return F.when(there, F.round(out, 4).cast("decimal(6,4)"))

    shown, full, half = d(SHOWN), d(1), d(UNDECIDED)
    closed = F.coalesce(decision.difference(c("total_cents"), decision.items_sum(c("items")), c("discount_cents"), c("freight_cents")) <= R.SAME_CENTS, F.lit(False))
    checked = lambda ok: (F.when(ok, full).otherwise(d(0)), F.when(ok, full).otherwise(shown))
    rank = lambda f, strong: F.coalesce(c("_rank")[f] < strong, F.lit(False))
    whole = lambda x: x["quantity"].isNotNull() & x["unit_cents"].isNotNull()
    of_items = F.transform("items", lambda x: F.round((base(sure) * F.when(whole(x), full).otherwise(half) * shown).cast("decimal(16,10)"), 4).cast("decimal(6,4)"))
    mean = F.aggregate(of_items, F.lit(0).cast("decimal(20,4)"), lambda a, x: (a + x).cast("decimal(20,4)")) / F.size("items")
    return {
        "total": score(c("total_cents").isNotNull(), sure, F.when(closed, full).otherwise(half), F.when(closed, full).otherwise(shown)),
        "cnpj": score(c("issuer_cnpj").isNotNull(), sure, *checked(N.normalize_cnpj("issuer_cnpj")["valid"])),
        "key": score(c("access_key").isNotNull(), sure, *checked(N.access_key_valid("access_key"))),
        "issued": score(c("issued").isNotNull(), c("_rank")["issued"].isNotNull(), F.when(c("issued_ambiguous"), d(ODD)).otherwise(full)),
        "due": score(c("due").isNotNull(), rank("due", 2)),
        "number": score(c("order_no").isNotNull(), rank("number", len(LABELS["number"]) - 1), shown),
        "payment": score(c("payment_form").isNotNull(), sure, shown),
        "issuer": score(c("issuer_name").isNotNull(), rank("issuer", len(LABELS["issuer"])), shown),
        "discount": score(c("discount_cents").isNotNull(), rank("discount", 2), shown),
        "freight": score(c("freight_cents").isNotNull(), rank("freight", 2), shown),
        "notes": score(c("notes").isNotNull(), rank("notes", 4), shown),
        "items": F.when(F.size("items") > 0, F.round(mean, 4).cast("decimal(6,4)")),
    }


def extract(docs: DataFrame, text: str = "text", message: Column | None = None, ocr: Column | None = None) -> DataFrame:
    """Adds kind, total_cents, access_key, issuer_cnpj, issuer_name, issued, issued_ambiguous, due,
    order_no, discount_cents, freight_cents, payment_form, notes, items, suspicious_lines, read_scores
    (map of field to how sure it was read) and read_score, their weighted mean.

    ``message`` marks rows that are chat messages: their one unlabelled date counts as the date
    of issue. ``ocr`` marks texts that a reader of images gave; names in them are recovered from
    what such readers confuse. Null text gives nulls, no items, no scores and kind ``desconhecido``.
    """
    message = F.lit(False) if message is None else message
    ocr = F.lit(False) if ocr is None else F.coalesce(ocr, F.lit(False))
    read_all = F.arrow_udf(lambda texts, messages: reading.read_all(texts, messages), reading.RESULT)
    df = docs.withColumn("_read", read_all(F.col(text), F.coalesce(message, F.lit(False))))
    got = lambda f: F.col(f"_read.{f}")
    df = df.select(
        *docs.columns,
        T.classify(F.col(text)).alias("kind"),
        got("total").alias("total_cents"),
        got("access_key"),
        got("cnpj").alias("issuer_cnpj"),
        F.when(ocr, N.recover_ocr_text(got("issuer"))).otherwise(got("issuer")).alias("issuer_name"),
        got("issued"),
        F.coalesce(got("issued_ambiguous"), F.lit(False)).alias("issued_ambiguous"),
        got("due"),
        N.order_number(got("number")).alias("order_no"),
        got("discount").alias("discount_cents"),
        got("freight").alias("freight_cents"),
        N.payment_form_read(got("payment")).alias("payment_form"),
        got("notes"),
        F.coalesce(got("items"), F.array().cast(f"array<struct<{reading.ITEM}>>")).alias("items"),
        T.injection_lines(F.col(text)).alias("suspicious_lines"),
        got("ranks").alias("_rank"),
    )
    scores = read_scores(ocr)
    pairs = F.filter(F.array(*[F.struct(F.lit(f).alias("key"), s.alias("value")) for f, s in scores.items()]), lambda x: x["value"].isNotNull())
    weight = lambda x: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in WEIGHTS.items() for v in kv]), x["key"]), F.lit(1))
    wide = "decimal(24,4)"
    total = lambda x: F.aggregate(x, F.lit(0).cast(wide), lambda a, p: (a + p["value"] * weight(p)).cast(wide))
    df = df.withColumn("_scores", pairs).drop("_rank")
    mean = F.when(F.size("_scores") > 0, F.round(total(F.col("_scores")) / F.aggregate("_scores", F.lit(0), lambda a, p: a + weight(p)), 4).cast("decimal(6,4)"))
    return df.withColumn("read_scores", F.map_from_entries("_scores")).withColumn("read_score", mean).drop("_scores")
