"""The queue of exceptions, its upserts, its public form and the totals of the dashboard."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import reasons as R
from ..functions import scalars as N
from ..sources.staging import staged

OPEN = ("aberta", "em_analise")
SETTLED = ("auto_aprovado", "validado")
KEY = ("document_id", "order_id", "reason")
#: What a reviewer may write, by decision.
DECISIONS = {"aprovar": ("aprovar", "aprovado", "aprova", "ok", "sim", "a"), "rejeitar": ("rejeitar", "rejeitado", "rejeita", "nao", "n", "r")}


def upsert_queue(queue: DataFrame, raised: DataFrame) -> DataFrame:
    """Open entries take the newest detail of a like exception; others are added, once each.

    Both have document_id, order_id, reason, detail, status, opened_at and seq; nulls are equal.
    """
    open_ = queue.filter("status = 'aberta'")
    newest = raised.groupBy(*KEY).agg(F.max_by("detail", "seq").alias("detail"), F.min("opened_at").alias("opened_at"), F.min("seq").alias("seq"), F.max_by("status", "seq").alias("status"))
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in KEY]
    cond = same[0] & same[1] & same[2]
    o, n = open_.alias("o"), newest.alias("n")
    updated = o.join(n, cond, "left").select(*[F.col(f"o.{c}") if c != "detail" else F.coalesce("n.detail", "o.detail").alias("detail") for c in queue.columns])
    added = n.join(o, cond, "left_anti").select(*queue.columns)
    return queue.filter("status <> 'aberta' OR status IS NULL").unionByName(updated).unionByName(added)


def enqueue_new(queue: DataFrame, raised: DataFrame) -> DataFrame:
    """Exceptions that no open entry has, by document, order, reason and suspicious value."""
    keys = [*KEY, "suspicious_value"]
    o, n = queue.filter(F.col("status").isin(*OPEN)).alias("o"), raised.dropDuplicates(keys).alias("n")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    return n.join(o, cond, "left_anti")


def reasons_of_orders(orders: DataFrame, queue: DataFrame) -> DataFrame:
    """(order_id, reasons): those filed under the order, or under its document with no order, of any status."""
    by_order = orders.select("order_id").join(queue.select("order_id", "reason"), "order_id")
    by_document = orders.select("order_id", "document_id").join(queue.filter("order_id IS NULL").select("document_id", "reason"), "document_id").select("order_id", "reason")
    found = by_order.union(by_document).distinct().groupBy("order_id").agg(F.sort_array(F.collect_list("reason")).alias("reasons"))
    return orders.select("order_id").join(found, "order_id", "left").select("order_id", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def public_queue(queue: DataFrame, documents: DataFrame, orders: DataFrame, suppliers: DataFrame, reasons: DataFrame, now: Column) -> DataFrame:
    """Open entries with their document, order and supplier, the reason's text, age and rank.

    An entry without an order takes its document's first one; without a document, its order's.
    """
    c = F.col
    first = orders.groupBy("document_id").agg(F.min_by("order_id", "seq").alias("_first"))
    rows = queue.filter(c("status").isin(*OPEN)).join(first, "document_id", "left").withColumn("_order", F.coalesce("order_id", "_first")).drop("order_id", "_first")
    o = orders.select(c("order_id").alias("_o"), c("document_id").alias("_odoc"), "cnpj", "cents", "issued", "order_no")
    rows = rows.join(o, c("_order") == c("_o"), "left").withColumn("document_id", F.coalesce("document_id", "_odoc"))
    rows = rows.join(documents.select("document_id", "source_file", "channel"), "document_id", "left").join(suppliers.select("cnpj", "supplier_name"), "cnpj", "left")
    rows = rows.join(F.broadcast(reasons.select("reason", "field", "risk", "description")), "reason", "left")
    risk = F.coalesce("risk", F.lit("medio"))
    return rows.select(
        "queue_id", "document_id", c("_order").alias("order_id"), "reason", risk.alias("risk"), F.when(risk == "alto", 0).otherwise(1).alias("risk_rank"), F.coalesce("description", "reason").alias("description"), "field",
        "source_file", "channel", "cnpj", "supplier_name", N.brl_label("cents").alias("value_label"), "issued", "order_no", "opened_at", N.age_days("opened_at", now).alias("age_days"),
    )


def in_queue_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("risk_rank", "opened_at", "reason", "queue_id")


def entry_order_key(number: Column) -> Column:
    """Numbers padded to 12 places; longer ones are kept whole."""
    n = F.coalesce(number, F.lit(""))
    return F.lpad(n, F.greatest(F.lit(12), F.length(n)), F.lit("0"))


def dashboard(orders: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: orders by status, open exceptions, and the cents of settled orders."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    settled = F.sum(F.when(F.col("status").isin(*SETTLED), F.col("cents")))
    a = orders.agg(F.count("*").alias("orders"), is_("auto_aprovado").alias("approved"), is_("revisao_humana").alias("in_review"), is_("rejeitado").alias("rejected"), F.coalesce(settled, F.lit(0)).alias("settled_cents"))
    b = queue.agg(F.count_if(F.col("status").isin(*OPEN)).alias("open_exceptions"))
    return a.crossJoin(b)  # one row each


def decision_label(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.coalesce(*[F.when(word.isin(*words), F.lit(d)) for d, words in DECISIONS.items()])


def apply_decisions(orders: DataFrame, decisions: DataFrame) -> DataFrame:
    """Orders after review, with ``outcome``. Approval needs a value, its own or a corrected one;
    an approved order is not rejected; an approved order without number is numbered by its id."""
    c = F.col
    d = decisions.select(c("order_id").alias("_id"), decision_label(c("decision")).alias("_d"), c("corrected_cents").alias("_cents"), c("corrected_number").alias("_no"))
    # Of several decisions on one order, approval counts, then the largest value and number: no order of rows decides.
    d = d.groupBy("_id").agg(F.min(F.struct(F.coalesce("_d", F.lit("~")).alias("_rank"), (-F.coalesce("_cents", F.lit(0))).alias("_less"), "_d", "_cents", "_no")).alias("s")).select("_id", "s._d", "s._cents", "s._no")
    rows = orders.join(d, c("order_id") == c("_id"), "left")
    cents = F.coalesce("_cents", "cents")
    approve = (c("_d") == "aprovar") & cents.isNotNull()
    reject = (c("_d") == "rejeitar") & ~c("status").isin(*SETTLED)
    outcome = F.when(approve, "aprovado").when(c("_d") == "aprovar", "ignorado_sem_valor").when(reject, "rejeitado").when(c("_d") == "rejeitar", "recusado_ja_aprovado").otherwise("sem_decisao")
    number = F.when(approve, F.coalesce("_no", "order_no", F.concat(F.lit("SEM-NUMERO-"), c("order_id")))).otherwise(c("order_no"))
    status = F.when(approve, "validado").when(reject, "rejeitado").otherwise(c("status"))
    return rows.withColumn("outcome", F.coalesce(outcome, F.lit("sem_decisao"))).withColumn("order_no", number).withColumn("cents", F.when(approve, cents).otherwise(c("cents"))).withColumn("status", F.coalesce(status, c("status"))).drop("_id", "_d", "_cents", "_no")


def cards_by_root(cards: DataFrame, cut: int = 8) -> DataFrame:
    """Counts of (id, parent, state) by the root of each card's parent chain and by state; a chain
    that runs into itself ends where it began. Chains of any length are walked to their end; lineage
    is cut every ``cut`` steps."""
    parents = cards.select(F.col("id").alias("_p"), F.col("parent").alias("_up"))
    walk = cards.select("id", "state", F.col("id").alias("root"), F.array("id").alias("seen"))
    for n in count(1):
        step = walk.join(parents, F.col("root") == F.col("_p"), "left")
        on = F.col("_up").isNotNull() & ~F.array_contains("seen", F.col("_up"))
        walk = step.select("id", "state", F.when(on, F.col("_up")).otherwise(F.col("root")).alias("root"), F.when(on, F.concat("seen", F.array("_up"))).otherwise(F.col("seen")).alias("seen"), on.alias("_more"))
        if n % cut == 0:
            walk = staged(walk, "chains")
        if walk.filter("_more").isEmpty():
            break
        walk = walk.drop("_more")
    return walk.groupBy("root", "state").agg(F.count("*").alias("n"))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row by key."""
    return df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_row = 1").drop("_row")


RISK_ORDER = {code: 0 if risk == "alto" else 1 for code, _, risk, _ in R.REASONS}
