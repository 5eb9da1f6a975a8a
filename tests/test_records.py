"""Item lines, documents after a decision, ids in human order, the ledger over several runs, webhook folders."""

import json
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import ledger, records
from tallyweave.plans import run
from tallyweave.sources import files, sinks
from tallyweave.streaming import intake


def test_item_rows(spark):
    items = [("a", Decimal("1.5000"), 333, None), ("b", Decimal("2.0000"), 100, 7), ("c", None, 5, None), ("d", Decimal("0.5000"), 1, None), ("e", Decimal("1.0000"), None, None)]
    df = spark.createDataFrame([("o", items), ("p", []), ("q", None)], "order_id string, items array<struct<description string, quantity decimal(12,4), unit_cents bigint, total_cents bigint>>")
    got = [(r.line, r.description, r.total_cents) for r in records.item_rows(df).orderBy("line").collect()]
    brute = lambda q, u, t: t if t is not None else None if q is None or u is None else int((q * u).quantize(Decimal(1), rounding=ROUND_HALF_UP))
    assert got == [(i, d, brute(q, u, t)) for i, (d, q, u, t) in enumerate(items, 1)]


def test_documents_follow_their_orders(spark):
    docs = spark.createDataFrame([("d1", "nf", None, "recebido", None), ("d2", None, "h", "recebido", None), ("d3", "nf", "h", "recebido", "t0")], "documento_id string, tipo_doc string, texto_norm_sha256 string, status string, processado_em string")
    out = spark.createDataFrame([("d1", "auto_aprovado", None, "x", "t"), ("d2", None, "pedido", "y", "t"), ("d9", "rejeitado", None, None, "t")], "documento_id string, outcome string, tipo_doc string, texto_norm_sha256 string, processado_em string")
    got = sorted(tuple(r) for r in records.sync_documents(docs, out).collect())
    assert got == [("d1", "nf", "x", "validado", "t"), ("d2", "pedido", "h", "extraido", "t"), ("d3", "nf", "h", "recebido", "t0")]
    assert records.sync_documents(docs, out.limit(0)).count() == 3
    with pytest.raises(ValueError, match="hash_sha256"):
        records.change_documents(docs, docs.select("documento_id", F.lit("x").alias("hash_sha256")))
    messages = spark.createDataFrame([("m2", "d1"), ("m1", "d1"), ("m3", None)], "id string, document_id string")
    found = records.message_of_documents(docs.select(F.col("documento_id").alias("document_id")), messages)
    assert {r.document_id: r.message_id for r in found.collect()} == {"d1": "m1", "d2": None, "d3": None}


def test_natural_order(spark):
    ids = ["A-10", "A-9", "A-", "B2", "", "7", "A-09x", "9" * 40]
    df = spark.createDataFrame([(x,) for x in ids], "id string").withColumn("k", records.natural_key(F.col("id")))
    got = {r.id: (r.k.prefix, int(r.k.number)) for r in df.collect()}
    assert got == {"A-10": ("A-", 10), "A-9": ("A-", 9), "A-": ("A-", 0), "B2": ("B", 2), "": ("", 0), "7": ("", 7), "A-09x": ("A-09x", 0), "9" * 40: ("", 0)}


def _ledger(spark, rows):
    blank = {c: "" for c in ledger.COLUMNS}
    schema = ", ".join(f"{c} {'bigint' if c == 'row_id_planilha' else 'string'}" for c in ledger.COLUMNS)
    return spark.createDataFrame([tuple((blank | {"data_processamento": t, "documento_id": f"d{o}", "pedido_id": o, "valor_total": v, "row_id_planilha": n})[c] for c in ledger.COLUMNS) for n, (o, v, t) in enumerate(rows, 2)], schema)


def test_ledger_is_carried_on(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = lambda: [(r.row_id_planilha, r.pedido_id, r.valor_total, r.data_processamento) for r in sinks.read_ledger(_ledger(spark, []), path).orderBy("row_id_planilha").collect()]
    sinks.write_ledger(_ledger(spark, [("o1", "1,00", "t1"), ("o2", "", "t1")]), path)
    sinks.write_ledger(_ledger(spark, [("o3", "3,00", "t2"), ("o2", "2,00", "t2"), ("o4", "4,00", "t2")]), path)
    assert rows() == [(2, "o1", "1,00", "t1"), (3, "o2", "2,00", "t1"), (4, "o3", "3,00", "t2"), (5, "o4", "4,00", "t2")]
    sinks.write_ledger(_ledger(spark, []), path)
    assert len(rows()) == 4 and rows()[1] == (3, "o2", "2,00", "t1")


def test_webhook_folder(spark, tmp_path):
    folder, target = tmp_path / "w", str(tmp_path / "t")
    assert intake.collect_webhooks(spark, str(folder), target) == intake.Collected(0, 0, 0, 0)
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"statuses": [1]}) + "\n\n" + json.dumps({"entry": []}) + "\n[1]\n{broken\n")
    assert intake.collect_webhooks(spark, str(folder), target) == intake.Collected(0, 3, 1, 0)
    assert (folder / "a.json").exists()
    (folder / "b c.jsonl").write_text(json.dumps({"entry": [{"id": "x"}]}) + "\n")
    (folder / "note.txt").write_text("no")
    assert intake.collect_webhooks(spark, str(folder), target) == intake.Collected(1, 3, 1, 2)
    assert sorted(p.name for p in folder.iterdir()) == ["note.txt", "processados"]
    assert [json.loads(r.value) for r in spark.read.text(target).collect()] == [{"entry": [{"id": "x"}]}]
    assert files.count_lines(spark, target) == 1 and files.count_lines(spark, str(tmp_path / "none")) == 0


def test_orders_already_met(spark):
    schema = "seq long, document_id string, access_key string, cnpj string, order_no string, issued date, cents bigint"
    evidence = spark.createDataFrame([(1, "d1", "k", None, None, None, 5), (2, "d2", "k", "c", None, None, 5), (3, "d3", None, "c", "7", None, 6)], schema)
    ids = run.identity.order_id(run.identity.order_base(*[F.col(c) for c in ("access_key", "cnpj", "order_no", "issued", "cents", "document_id")]))
    orders = evidence.filter("seq <> 2").select(ids.alias("order_id"))
    got = {r["_of"]: (r.order_id, r["_seen"]) for r in run.orders_of(evidence, orders).collect()}
    assert [got[i][1] for i in (1, 2, 3)] == [False, True, False] and got[1][0] == got[2][0] != got[3][0]
