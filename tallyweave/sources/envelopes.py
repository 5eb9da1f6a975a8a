"""Chat envelopes to messages: tolerant JSON lines, two channels, one message form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as N
from ..operators.identity import message_hash

_MEDIA = "STRUCT<id: STRING, mime_type: STRING, filename: STRING, sha256: STRING, caption: STRING>"
WHATSAPP = f"""object STRING, entry ARRAY<STRUCT<id: STRING, changes: ARRAY<STRUCT<field: STRING, value: STRUCT<
    metadata: STRUCT<display_phone_number: STRING, phone_number_id: STRING>, contacts: ARRAY<STRUCT<profile: STRUCT<name: STRING>, wa_id: STRING>>,
    messages: ARRAY<STRUCT<`from`: STRING, id: STRING, timestamp: STRING, type: STRING, text: STRUCT<body: STRING>, image: {_MEDIA}, document: {_MEDIA}, video: {_MEDIA}, audio: {_MEDIA}, sticker: {_MEDIA},
    button: STRUCT<text: STRING>, interactive: STRUCT<button_reply: STRUCT<id: STRING, title: STRING>, list_reply: STRUCT<id: STRING, title: STRING>>, location: STRUCT<name: STRING, address: STRING>>>>>>>>"""
_FILE = "STRUCT<file_id: STRING, file_unique_id: STRING, file_name: STRING, mime_type: STRING, file_size: BIGINT, width: BIGINT, height: BIGINT>"
_POST = f"STRUCT<message_id: BIGINT, `from`: STRUCT<id: BIGINT, first_name: STRING, last_name: STRING, username: STRING>, chat: STRUCT<id: BIGINT, title: STRING, type: STRING>, date: BIGINT, text: STRING, caption: STRING, document: {_FILE}, photo: ARRAY<{_FILE}>, video: {_FILE}, audio: {_FILE}, voice: {_FILE}>"
TELEGRAM = f"update_id BIGINT, message {_POST}, edited_message {_POST}, channel_post {_POST}, arquivo_local STRING"
MESSAGE = ("channel", "external_id", "conversation_id", "sender_id", "sender_name", "text", "sent_at", "type", "media", "source_file")


def json_objects(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Lines that hold a JSON object, parsed into ``j``; blank and broken lines and other JSON are passed over."""
    strict = schema + ", _corrupt STRING"
    parsed = lines.withColumn("j", F.from_json(F.col(column), strict, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.filter(F.trim(column).startswith("{") & F.col("j").isNotNull() & F.col("j._corrupt").isNull())


def _blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def whatsapp_messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row for each message of each envelope; messages without an id are dropped."""
    path = F.col("source_file") if "source_file" in lines.columns else F.lit(None).cast("string")
    e = json_objects(lines, WHATSAPP, column).select(path.alias("source_file"), F.explode("j.entry").alias("e"))
    v = e.select("source_file", F.col("e.id").alias("entry_id"), F.explode("e.changes").alias("c")).select("source_file", "entry_id", "c.value.*")
    m = v.select("source_file", F.coalesce("metadata.phone_number_id", "metadata.display_phone_number", "entry_id").alias("conversation_id"), F.coalesce("contacts", F.array().cast("array<struct<profile:struct<name:string>,wa_id:string>>")).alias("contacts"), F.explode("messages").alias("m"))
    kind = F.col("m.type")
    media = F.coalesce(*[F.when(kind == k, F.col(f"m.{k}")) for k in ("image", "document", "video", "audio", "sticker")])
    text = (
        F.when(kind == "text", F.col("m.text.body")).when(media.isNotNull(), media["caption"]).when(kind == "button", F.col("m.button.text"))
        .when(kind == "interactive", F.coalesce("m.interactive.button_reply.title", "m.interactive.list_reply.title")).when(kind == "location", F.concat_ws(" ", "m.location.name", "m.location.address"))
    )
    name = F.get(F.filter("contacts", lambda x: x["wa_id"] == F.col("m.from")), F.lit(0))["profile"]["name"]
    return m.filter(F.coalesce("m.id", F.lit("")) != "").select(
        F.lit("whatsapp").alias("channel"), F.col("m.id").alias("external_id"), "conversation_id", F.col("m.from").alias("sender_id"), name.alias("sender_name"), _blank(text).alias("text"), N.epoch_iso("m.timestamp").alias("sent_at"), kind.alias("type"),
        F.when(media.isNotNull(), F.struct(media["id"].alias("id"), media["mime_type"].alias("mime_type"), media["filename"].alias("file_name"), media["sha256"].alias("sha256"))).alias("media"), "source_file",
    )


def telegram_messages(lines: DataFrame, column: str = "value", chat_id: int | None = None) -> DataFrame:
    """One row for each update; an update whose attachment is stored already and that says nothing is
    dropped. ``chat_id`` keeps one chat."""
    path = F.col("source_file") if "source_file" in lines.columns else F.lit(None).cast("string")
    p = json_objects(lines, TELEGRAM, column).select(path.alias("source_file"), F.col("j.update_id").alias("u"), F.col("j.arquivo_local").alias("stored"), F.coalesce("j.message", "j.edited_message", "j.channel_post").alias("p")).filter("p IS NOT NULL")
    if chat_id is not None:
        p = p.filter(F.col("p.chat.id") == chat_id)
    photo = F.array_max(F.transform("p.photo", lambda x: F.struct(F.coalesce(x["file_size"], F.lit(0)).alias("s"), F.coalesce(x["width"], F.lit(0)).alias("w"), x["file_id"].alias("file_id"))))
    kinds = ("document", "photo", "video", "audio", "voice")
    there = {k: F.size("p.photo") > 0 if k == "photo" else F.col(f"p.{k}").isNotNull() for k in kinds}
    one = lambda k: F.struct(photo["file_id"].alias("id"), F.lit("image/jpeg").alias("mime_type"), F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("string").alias("sha256")) if k == "photo" else F.struct(F.col(f"p.{k}.file_id").alias("id"), F.col(f"p.{k}.mime_type").alias("mime_type"), F.col(f"p.{k}.file_name").alias("file_name"), F.lit(None).cast("string").alias("sha256"))
    media = F.coalesce(*[F.when(F.coalesce(there[k], F.lit(False)), one(k)) for k in kinds])
    kind = F.coalesce(*[F.when(F.coalesce(there[k], F.lit(False)), F.lit(k)) for k in kinds], F.lit("text"))
    text = _blank(F.coalesce("p.text", "p.caption"))
    full = F.nullif(F.concat_ws(" ", "p.from.first_name", "p.from.last_name"), F.lit(""))
    return p.filter(~((F.coalesce("stored", F.lit("")) != "") & (text == ""))).select(
        F.lit("telegram").alias("channel"), F.concat_ws(":", F.col("u").cast("string"), F.col("p.message_id").cast("string")).alias("external_id"), F.col("p.chat.id").cast("string").alias("conversation_id"), F.col("p.from.id").cast("string").alias("sender_id"),
        F.coalesce(full, "p.from.username").alias("sender_name"), text.alias("text"), N.epoch_iso("p.date").alias("sent_at"), kind.alias("type"), media.alias("media"), "source_file",
    )


def with_identity(messages: DataFrame) -> DataFrame:
    """Adds sha, the identity of a message's content."""
    return messages.withColumn("sha", message_hash(*[F.col(c) for c in ("channel", "conversation_id", "sent_at", "external_id", "sender_id", "text")]))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with the file each comes from."""
    return spark.read.text(path).select("value", F.input_file_name().alias("source_file"))
