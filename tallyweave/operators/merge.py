"""Evidence of one order made one row, in order of arrival.

The first row of a group is the order. A later row that contradicts a field changes nothing and
is a conflict; any other fills what is null, may raise the status, and brings items if there are
none. Since a field once set never changes, rows equal in all fields share one fate, so a group is
first reduced to its distinct rows.

A row with an access key meets only rows of that key, whatever issuer they name, so keys are folded
first, each on its own. All other rows meet within their issuer, where a row without number may
also look like an order that is there already; for that the states of keyed orders come along.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .identity import group_key, order_base, order_id

FIELDS = ("cents", "cnpj", "issued", "order_no", "access_key")
RANK = {"rejeitado": 1, "revisao_humana": 2, "auto_aprovado": 3, "validado": 3}
SCHEMA = "order_id string, first_document string, first_seq long, cents long, cnpj string, issued date, order_no string, access_key string, status string, score double, n_rows long, n_conflicts long, n_near long"
#: What the fold of one key gives besides: from ``seq`` on its order has these values.
STATE = "seq long, order_id string, cents long, cnpj string, issued date"
KEYED = f"kind string, seq long, {SCHEMA}"
#: Rows of finished issuers that are given out together.
OUT_ROWS = 10_000
_ORDER, _STATE = ([x.split()[0] for x in s.split(", ")] for s in (SCHEMA, STATE))


def status_rank(status: Column) -> Column:
    return F.coalesce(*[F.when(status == s, F.lit(r)) for s, r in RANK.items()], F.lit(0))


def _started(row: dict) -> dict:
    return {"order_id": row["order_id"], "first_document": row["document_id"], "first_seq": row["seq"], **{f: row[f] for f in FIELDS}, "status": row["status"], "score": row["score"], "n_rows": row["n"], "n_conflicts": 0, "n_near": 0}


def _add(order: dict, row: dict) -> bool:
    """Takes a later row into its order; whether a field was filled."""
    if any(row[f] is not None and order[f] is not None and row[f] != order[f] for f in FIELDS):
        order["n_conflicts"] += row["n"]
        return False
    filled = [f for f in FIELDS if order[f] is None and row[f] is not None]
    for f in filled:
        order[f] = row[f]
    if RANK.get(row["status"], 0) > RANK.get(order["status"], 0):
        order["status"] = row["status"]
    order["score"] = max((x for x in (order["score"], row["score"]) if x is not None), default=None)
    order["n_rows"] += row["n"]
    return bool(filled)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield dict(zip(names, values, strict=True))


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


_KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "date": pa.date32()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come key by key in order of arrival; one order at a time is held. ``kind`` tells orders from states."""
    schema = _arrow(KEYED)
    order: dict | None = None
    for batch in batches:
        out = []
        for row in _rows(batch):
            if order is not None and order["access_key"] == row["access_key"]:
                if not _add(order, row):
                    continue
            else:
                if order is not None:
                    out.append({"kind": "order", **order})
                order = _started(row)
            out.append({"kind": "state", "seq": row["seq"], **{c: order[c] for c in ("order_id", "cents", "cnpj", "issued")}})
        yield _table(out, schema)
    if order is not None:
        yield _table([{"kind": "order", **order}], schema)


class _Issuer:
    """The orders of one issuer while its rows come in order of arrival."""

    def __init__(self, near_days: int):
        self.near_days = near_days
        self.orders: dict[str, dict] = {}
        self.first_of: dict[tuple, tuple] = {}  # by cents and day: the earliest (first seq, order_id) of all orders
        self.known: set[tuple] = set()
        self.near: dict[str, int] = defaultdict(int)
        self.seen: dict[str, int] = {}

    def know(self, order: dict) -> None:
        """An order with a value and a date may be what a later row looks like; its first date counts."""
        cents, day, i = order["cents"], order["issued"], order["order_id"]
        if cents is None or day is None or (cents, i) in self.known:
            return
        self.known.add((cents, i))
        at, one = (cents, day.toordinal()), (self.seen[i], i)
        self.first_of[at] = min(self.first_of.get(at, one), one)

    def like(self, row: dict) -> str | None:
        """The earliest known order of the row's value within ``near_days`` of its date."""
        cents, day = row["cents"], row["issued"].toordinal()
        days = range(day - self.near_days, day + self.near_days + 1)
        found = [x for x in (self.first_of.get((cents, d)) for d in days) if x is not None]
        return min(found)[1] if found else None

    def take(self, row: dict) -> None:
        if row["kind"] == "state":
            self.seen.setdefault(row["order_id"], row["seq"])
            self.know(row)
            return
        found = self.orders.get(row["group"])
        if found is not None:
            if _add(found, row):
                self.know(found)
            return
        if row["order_no"] is None and None not in (row["cnpj"], row["cents"], row["issued"]):
            like = self.like(row)
            if like is not None:
                self.near[like] += row["n"]
                return
        found = self.orders[row["group"]] = _started(row)
        self.seen[found["order_id"]] = row["seq"]
        if found["cnpj"] is not None:
            self.know(found)

    def result(self) -> list[dict]:
        out = list(self.orders.values())
        for o in out:
            o["n_near"] = self.near.pop(o["order_id"], 0)
        return out + [{"order_id": i, "n_near": n} for i, n in self.near.items()]  # of keyed orders


def _by_issuer(near_days: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come issuer by issuer in order of arrival; one issuer at a time is held."""
        schema = _arrow(SCHEMA)
        now, issuer, out = None, _Issuer(near_days), []
        for batch in batches:
            for row in _rows(batch):
                if row["_set"] != now:
                    out += issuer.result()
                    now, issuer = row["_set"], _Issuer(near_days)
                issuer.take(row)
            if len(out) >= OUT_ROWS:
                yield _table(out, schema)
                out = []
        yield _table(out + issuer.result(), schema)

    return run


def merge_orders(rows: DataFrame, near_days: int = 3) -> DataFrame:
    """One row for each order from (seq, document_id, cents, cnpj, issued, order_no, access_key, status, score).

    Keys stream through sorted, so a key of any number of rows is held as one order. Other rows stream
    issuer by issuer, or by their group without one, after equal rows were counted together. A row
    without number that looks like an order of the issuer, known by value and date within
    ``near_days``, starts none and counts as near the earliest of these. Null status ranks lowest.
    """
    c = F.col
    keyed = rows.withColumn("group", group_key(c("access_key"), c("cnpj"), c("order_no"), c("issued"), c("document_id")))
    keyed = keyed.withColumn("order_id", order_id(order_base(c("access_key"), c("cnpj"), c("order_no"), c("issued"), c("cents"), c("document_id"))))
    same = keyed.groupBy("group", *FIELDS, "status").agg(F.min_by("document_id", "seq").alias("document_id"), F.min_by("order_id", "seq").alias("order_id"), F.min("seq").alias("seq"), F.max(F.col("score").cast("double")).alias("score"), F.count("*").alias("n"))
    with_key = same.filter("access_key IS NOT NULL").repartition("access_key").sortWithinPartitions("access_key", "seq")
    folded = staged(with_key.mapInArrow(_by_key, KEYED), "keyed-orders")
    states = folded.filter("kind = 'state' AND cnpj IS NOT NULL").select("kind", *_STATE)
    others = same.filter("access_key IS NULL").withColumn("kind", F.lit("row")).unionByName(states, allowMissingColumns=True)
    sets = others.withColumn("_set", F.coalesce("cnpj", "group")).repartition("_set").sortWithinPartitions("_set", "seq")
    rest = staged(sets.mapInArrow(_by_issuer(near_days), SCHEMA), "other-orders")
    near = rest.filter("first_seq IS NULL").groupBy(F.col("order_id").alias("_id")).agg(F.sum("n_near").alias("_near"))
    orders = folded.filter("kind = 'order'").select(*_ORDER).join(near, c("order_id") == c("_id"), "left").withColumn("n_near", F.coalesce("_near", "n_near")).select(*_ORDER)
    return orders.unionByName(rest.filter("first_seq IS NOT NULL"))


def fill_in_order(rows: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """First non-null value of every field and the highest status rank by key: the fold where nothing conflicts."""
    firsts = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    return rows.groupBy(key).agg(*firsts, F.max(status_rank(F.col("status"))).alias("status_rank"), F.count("*").alias("n_rows"))
