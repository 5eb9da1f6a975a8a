"""A bot's updates as a stream, and the landing of webhook calls."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: offset -> updates from it on, oldest first; what talks to the network is handed in.
Fetch = Callable[[int], list[dict]]


class UpdatesReader(SimpleDataSourceStreamReader):
    """The offset is the last update's id plus one, over all chats; a batch that is read again after
    a failure asks for the same updates."""

    def __init__(self, fetch: Fetch):
        self.fetch = fetch

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        updates = self.fetch(start["offset"])
        end = max([start["offset"], *(u["update_id"] + 1 for u in updates)])
        return iter([(u["update_id"], json.dumps(u, ensure_ascii=False)) for u in updates]), {"offset": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(u["update_id"], json.dumps(u, ensure_ascii=False)) for u in self.fetch(start["offset"]) if u["update_id"] < end["offset"]])


def updates_source(fetch: Fetch, name: str = "tallyweave_updates") -> type[DataSource]:
    """A data source to register with ``spark.dataSource``: columns update_id and value."""

    class Updates(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "update_id long, value string"

        def simpleStreamReader(self, schema) -> UpdatesReader:
            return UpdatesReader(fetch)

    return Updates


def signed(secret: str, body: bytes, header: str | None) -> bool:
    """Does the header hold the body's HMAC-SHA256? Compared in constant time, before any parsing."""
    wanted = "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    return hmac.compare_digest(wanted, header or "")


def receive(method: str, query: dict[str, str], headers: dict[str, str], body: bytes, *, secret: str, verify_token: str, landing: str, most: int = 1_000_000) -> tuple[int, str]:
    """Status and answer of one webhook call; a good envelope is written to the landing folder under its hash."""
    if method == "GET":
        known = query.get("hub.mode") == "subscribe" and hmac.compare_digest(query.get("hub.verify_token", ""), verify_token)
        return (200, query.get("hub.challenge", "")) if known else (403, "")
    if method != "POST":
        return 405, ""
    if len(body) > most:
        return 413, ""
    if not signed(secret, body, headers.get("X-Hub-Signature-256")):
        return 401, ""
    try:
        envelope = json.loads(body)
    except ValueError:
        return 400, ""
    if not isinstance(envelope, dict):
        return 400, ""
    target = Path(landing) / f"{hashlib.sha256(body).hexdigest()}.jsonl"
    part = target.with_suffix(".part")
    part.write_text(json.dumps(envelope, ensure_ascii=False) + "\n")
    part.rename(target)
    return 200, ""
