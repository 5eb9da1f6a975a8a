"""Settings, sheets, updates and webhooks."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from tallyweave import __main__ as cli
from tallyweave.functions import reasons
from tallyweave.sources import config, sheets
from tallyweave.streaming import intake, poller

CATALOGUE = (config.Setting("INBOX", "in"), config.Setting("BOT_TOKEN", secret=True, required_in=("real",)), config.Setting("CHAT", required_in=("real",)))


def test_settings():
    file = config.read_env("# c\nINBOX = 'x y'\nexport CHAT=5\nbroken\n")
    assert file == {"INBOX": "x y", "CHAT": "5"}
    assert config.load(CATALOGUE, "mock", {"INBOX": "env"}, file) == {"INBOX": "env", "BOT_TOKEN": None, "CHAT": "5"}
    with pytest.raises(config.MissingSettings, match="BOT_TOKEN, CHAT"):
        config.load(CATALOGUE, "real", {})
    values = config.load(CATALOGUE, "real", {"BOT_TOKEN": "123456:secret", "CHAT": "1"})
    assert "secret" not in config.report(CATALOGUE, values).replace("cret", "") and "BOT_TOKEN=****cret" in config.report(CATALOGUE, values)
    assert config.out_of_step(CATALOGUE, {"INBOX": "", "OLD": ""}) == ({"BOT_TOKEN", "CHAT"}, {"OLD"})


def test_sheets(spark, tmp_path):
    public = spark.createDataFrame([("o1", "r"), ("o2", "r")], "order_id string, reason string")
    sheet = sheets.review_sheet(public).withColumn("decision", F.when(F.col("order_id") == "o1", "Aprovar").otherwise("talvez"))
    sheet.write.option("header", True).csv(str(tmp_path / "s"))
    got = sheets.read_decisions(spark, str(tmp_path / "s")).collect()
    assert [(r.order_id, r.decision) for r in got] == [("o1", "Aprovar")]


def test_updates_stream(spark, tmp_path):
    updates = [{"update_id": i, "message": {"message_id": i, "chat": {"id": 1}, "date": 0, "text": f"t{i}"}} for i in range(5)]
    reader = poller.UpdatesReader(lambda offset: [u for u in updates if u["update_id"] >= offset])
    rows, end = reader.read(reader.initialOffset())
    assert len(list(rows)) == 5 and end == {"offset": 5}
    assert list(reader.read(end)[0]) == [] and len(list(reader.readBetweenOffsets({"offset": 1}, {"offset": 3}))) == 2
    df = spark.createDataFrame([(u["update_id"],) for u in updates], "update_id long")
    assert intake.next_offset(df).first()[0] == 5


def test_landing_is_once(spark, tmp_path):
    (tmp_path / "l").mkdir()
    line = json.dumps({"update_id": 7, "message": {"message_id": 1, "chat": {"id": 3}, "date": 0, "text": "oi"}})
    (tmp_path / "l/a.jsonl").write_text(line + "\n" + line + "\n")
    (tmp_path / "l/b.jsonl").write_text(line + "\n")
    for run in (1, 2):
        intake.ingest_once(intake.messages(spark, str(tmp_path / "l"), "telegram"), ["channel", "external_id"], str(tmp_path / "t"), str(tmp_path / f"c{run}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    with pytest.raises(ValueError):
        intake.messages(spark, str(tmp_path), "fax")


def test_webhook(tmp_path):
    call = lambda method, body=b"", query=None, sign=True: poller.receive(method, query or {}, {"X-Hub-Signature-256": "sha256=" + hmac.new(b"k", body, hashlib.sha256).hexdigest() if sign else "x"}, body, secret="k", verify_token="v", landing=str(tmp_path), most=100)[0]
    assert call("GET", query={"hub.mode": "subscribe", "hub.verify_token": "v"}) == 200 and call("GET") == 403 and call("PUT") == 405
    assert (call("POST", b'{"entry": []}'), call("POST", b"{}", sign=False), call("POST", b"{"), call("POST", b"[]"), call("POST", b" " * 200)) == (200, 401, 400, 400, 413)
    assert len(list(tmp_path.iterdir())) == 1


def test_command_and_details(spark):
    assert cli.main([]) == 2
    got = spark.createDataFrame([("divergencia_soma_itens",), ("baixa_confianca",)], "r string").select(reasons.detail(F.col("r"), F.lit(1000), F.lit(900), F.lit(100))).collect()
    assert got[0][0] == "total R$ 10,00, items R$ 9,00, difference R$ 1,00" and got[1][0].startswith("Fields")
