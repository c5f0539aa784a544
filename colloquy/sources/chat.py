"""Readers of chat exports: files to one relation of messages.

A file is one row with its whole text, its format is told from its shape, and all
files of a format are parsed by the same expressions: the driver never looks into
a file. What cannot be read gives no messages; :func:`inspect_chats` says why.

Messages have file, message_id, seq, timestamp_ms, sender_uid, sender_name, role,
kind, raw_type, text, placeholders, reply_to_id, reply_to_summary and has_media.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cleaning import strip
from ..functions.scalars import parse_bool, parse_int, parse_kind, parse_role, strict_object


@dataclass(frozen=True)
class Identities:
    """Who is who in a chat, and the zone of times without one."""

    own: Sequence[str] = ()
    friends: Sequence[str] = ()
    zone: str = "UTC"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: file, name, suffix and its text without a byte order mark."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).withColumn("file", F.input_file_name())
    name = F.regexp_extract("file", "[^/]*$", 0)
    text = F.regexp_replace("value", "^\\uFEFF", "")
    return rows.select("file", F.regexp_replace(name, r"\.[^.]*$", "").alias("name"), F.lower(F.regexp_extract(name, r"\.[^.]*$", 0)).alias("suffix"), text.alias("content"))


def json_lines(payloads: DataFrame) -> DataFrame:
    """Records of JSONL files: file, line, source_id and the record; blank lines are skipped.

    A line that isn't an object makes ``record`` null. The id is stable for a path and line.
    """
    lines = payloads.where("suffix in ('.jsonl', '.ndjson')").select("file", "name", F.posexplode(F.split("content", r"\r\n|\n|\r")).alias("_i", "text")).where(F.trim("text") != "")
    record = strict_object(F.col("text"))
    space = F.substring(F.sha2("file", 256), 1, 12)
    return lines.select("file", (F.col("_i") + 1).alias("line"), F.concat_ws("-", "name", space, F.col("_i") + 1).alias("source_id"), record.alias("record"))


def _get(v: Column | str, *paths: str) -> Column:
    """The first of several fields that isn't empty, as text; '' if there is none."""
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(*[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths], F.lit(""))


def _items(v: Column | str, path: str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _role(uid: Column, system: Column, who: Identities, *given: Column) -> Column:
    known = F.when(uid.isin(*who.own), "self").when(uid.isin(*who.friends), "friend")
    return F.when(system, "system").otherwise(F.coalesce(*given, known, F.lit("other")))


_COLUMNS = ("file", "message_id", "seq", "timestamp_ms", "sender_uid", "sender_name", "role", "kind", "raw_type", "text", "placeholders", "reply_to_id", "reply_to_summary", "has_media")


# canonical chats ---------------------------------------------------------------------------------


def _is_canonical(content: Column) -> Column:
    """An object one of whose fields names a chat format of version 1."""
    field_of = lambda k, name: F.call_function("get_json_object", content, F.concat(F.lit("$['"), k, F.lit(f"'].{name}")))
    return F.coalesce(F.exists(F.json_object_keys(content), lambda k: F.lower(field_of(k, "format")).rlike("-chat$") & field_of(k, "version").startswith("1.")), F.lit(False))


def _canonical_parts(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, idx, source_id, m) of messages and (file, uid, role) of participants, of JSON and JSONL files."""
    whole = payloads.where(~F.col("suffix").isin(".jsonl", ".ndjson") & _is_canonical(F.col("content"))).select("file", strict_object(F.col("content")).alias("v"))
    whole = whole.where(F.lower(F.coalesce(F.nullif(_get("v", "$.conversation.type"), F.lit("")), F.lit("private"))) == "private")
    messages = whole.select("file", F.posexplode(_items("v", "$.messages")).alias("idx", "m")).withColumn("source_id", F.lit(""))
    people = whole.select("file", F.explode(_items("v", "$.participants")).alias("p"))

    lines = json_lines(payloads).withColumn("_type", _get("record", "$._type"))
    w = Window.partitionBy("file")
    first = F.first("_type").over(w.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("_n", F.row_number().over(w.orderBy("line"))).withColumn("_first", first)
    typed_ok = F.when(F.col("_n") == 1, (F.col("_type") == "header") & _is_canonical(F.to_json("record"))).otherwise(F.col("_type").isin("participant", "message"))
    bare_ok = (_get("record", "$.sender_uid", "$.senderUid") != "") & (_get("record", "$.timestamp_ms", "$.timestamp") != "")
    private = F.when(F.col("_n") == 1, F.lower(_get("record", "$.conversation.type")).isin("", "private")).otherwise(True)
    fine = F.col("record").isNotNull() & F.when(F.col("_first") == "header", typed_ok & private).otherwise(bare_ok)
    lines = lines.withColumn("_fine", F.min(F.coalesce(fine, F.lit(False)).cast("int")).over(w)).where("_fine = 1")
    said = lines.where("_first != 'header' or _type = 'message'").withColumn("idx", F.row_number().over(w.orderBy("line")) - 1)
    messages = messages.unionByName(said.select("file", "idx", F.col("record").alias("m"), "source_id"))
    people = people.unionByName(lines.where("_type = 'participant'").select("file", F.col("record").alias("p")))
    return messages, people.select("file", _get("p", "$.uid").alias("uid"), parse_role(_get("p", "$.role")).alias("role")).where("uid != '' and role is not null")


def canonical_messages(payloads: DataFrame, who: Identities = Identities()) -> DataFrame:
    """Messages of canonical chats: JSON objects, JSONL with typed records, or bare JSONL messages. Private chats only.

    A role is that of a system message, else the message's own, the participant's, the
    one of a configured id, or other.
    """
    messages, people = _canonical_parts(payloads)
    known = people.groupBy("file", "uid").agg(F.last("role").alias("_role"))
    rows = messages.withColumn("uid", _get("m", "$.sender_uid", "$.senderUid")).join(known, ["file", "uid"], "left")
    flag = lambda name: parse_bool(_get("m", f"$.{name}"))
    images = F.filter(_items("m", "$.attachments"), lambda a: (F.lower(_get(a, "$.type", "$.kind")) == "image") & (_get(a, "$.name", "$.path", "$.file", "$.filename") != ""))
    given = F.coalesce(F.try_variant_get("m", "$.placeholders", "array<string>"), F.array().cast("array<string>"))
    placeholders = F.when((F.size(images) > 0) & ~F.array_contains(given, "[图片]"), F.array_append(given, "[图片]")).otherwise(given)
    rows = rows.withColumns({"placeholders": placeholders, "_recalled": flag("recalled"), "_system": flag("system"), "_raw": _get("m", "$.raw_type", "$.rawType"), "text": _get("m", "$.text")})
    has_media = F.size("placeholders") > 0
    kind = parse_kind(_get("m", "$.kind"), _get("m", "$.raw_type"))
    kind = F.when(F.col("_recalled"), "recalled").when(F.col("_system"), "system").when((kind == "text") & has_media & (strip(F.col("text")) == ""), "placeholder").otherwise(kind)
    own = F.nullif(_get("m", "$.id", "$.message_id", "$._jsonlSourceId"), F.lit(""))
    return rows.select(
        "file", F.coalesce(own, F.nullif("source_id", F.lit("")), F.concat(F.lit("local-"), "idx")).alias("message_id"), F.coalesce(parse_int(F.nullif(_get("m", "$.seq"), F.lit("")), -1), F.lit(-1)).alias("_seq"), "idx",
        parse_int(_get("m", "$.timestamp_ms", "$.timestamp")).alias("timestamp_ms"), F.col("uid").alias("sender_uid"), _get("m", "$.sender_name", "$.senderName").alias("sender_name"),
        _role(F.col("uid"), F.col("_system"), who, parse_role(_get("m", "$.sender_role", "$.senderRole")), F.col("_role")).alias("role"), kind.alias("kind"), F.coalesce(F.nullif("_raw", F.lit("")), kind).alias("raw_type"),
        "text", "placeholders", F.nullif(_get("m", "$.reply_to_id", "$.replyToId"), F.lit("")).alias("reply_to_id"), F.nullif(_get("m", "$.reply_to_summary", "$.replyToSummary"), F.lit("")).alias("reply_to_summary"), has_media.alias("has_media"),
    ).withColumn("seq", F.when(F.col("_seq") >= 0, F.col("_seq")).otherwise(F.col("idx").cast("long"))).select(*_COLUMNS)


# exports of single platforms ---------------------------------------------------------------------


def _is_qq(v: Column) -> Column:
    name = F.lower(_get(v, "$.metadata.name"))
    return name.rlike("qq-?chat-?exporter") | (_get(v, "$.chatInfo.selfUid") != "")


def _is_object(v: Column | str, path: str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(F.startswith(F.to_json(F.try_variant_get(v, path, "variant")), F.lit("{")), F.lit(False))


def qq_parts(payloads: DataFrame, checked: bool = True) -> DataFrame:
    """file, idx, m and source_id of QQ messages: a JSON object's, or the records of a chunked JSONL file.

    Each record of the latter has sender, content and timestamp and no type of its own.
    """
    v = payloads.where("suffix not in ('.jsonl', '.ndjson', '.txt', '.md', '.html', '.htm')").select("file", strict_object(F.col("content")).alias("v")).where(F.col("v").isNotNull())
    whole = (v.where(_is_qq(F.col("v"))) if checked else v).select("file", F.posexplode(_items("v", "$.messages")).alias("idx", "m")).withColumn("source_id", F.lit(""))
    w = Window.partitionBy("file")
    fine = F.col("record").isNotNull() & _is_object("record", "$.sender") & _is_object("record", "$.content") & F.try_variant_get("record", "$.timestamp", "variant").isNotNull() & F.try_variant_get("record", "$._type", "variant").isNull()
    lines = json_lines(payloads).withColumn("_fine", F.min(F.coalesce(fine, F.lit(False)).cast("int")).over(w)).where("_fine = 1")
    said = lines.select("file", (F.row_number().over(w.orderBy("line")) - 1).alias("idx"), F.col("record").alias("m"), "source_id")
    return whole.unionByName(said).where(F.startswith(F.to_json("m"), F.lit("{")))


def qq_messages(payloads: DataFrame, who: Identities = Identities(), checked: bool = True) -> DataFrame:
    """Messages of the QQ chat exporter's JSON and chunked JSONL: nested sender and content, resources as placeholders."""
    rows = qq_parts(payloads, checked)
    label = lambda r: F.lower(_get(r, "$.type"))
    tag = lambda r: F.when(label(r) == "image", "[图片]").when(label(r) == "audio", "[语音]").when(label(r) == "video", "[视频]").when(label(r) == "file", "[文件]").otherwise(F.concat(F.lit("["), F.coalesce(F.nullif(label(r), F.lit("")), F.lit("附件")), F.lit("]")))
    rows = rows.withColumns({
        "uid": _get("m", "$.sender.uid", "$.sender.uin"), "_type": _get("m", "$.type"), "text": _get("m", "$.content.text"), "_recalled": parse_bool(_get("m", "$.recalled")), "_system": parse_bool(_get("m", "$.system")),
        "placeholders": F.transform(_items("m", "$.content.resources"), tag), "_inner": F.startswith(_get("m", "$.content.reply"), F.lit("{")), "_outer": F.startswith(_get("m", "$.sourceMsgInfo"), F.lit("{")),
    })
    has_text, has_media = strip(F.col("text")) != "", F.size("placeholders") > 0
    kind = (
        F.when(F.col("_recalled"), "recalled").when(F.col("_system") | (F.col("_type") == "system"), "system").when(F.col("_inner") | F.col("_outer"), "reply").when(has_text, "text").when(has_media, "placeholder")
        .when(F.col("_type").isin("type_17", "forward", "json", "type_19", "video", "audio", "file"), "placeholder").otherwise("unknown")
    )
    reply = F.when(F.col("_inner"), F.struct(_get("m", "$.content.reply.sourceMsgId", "$.content.reply.id").alias("id"), F.substring(_get("m", "$.content.reply.text", "$.content.reply.summary"), 1, 120).alias("text"))).when(F.col("_outer"), F.struct(_get("m", "$.sourceMsgInfo.sourceMsgId").alias("id"), F.substring(_get("m", "$.sourceMsgInfo.text"), 1, 120).alias("text")))
    return rows.withColumn("_reply", reply).select(
        "file", F.coalesce(F.nullif(_get("m", "$.id"), F.lit("")), F.nullif("source_id", F.lit("")), F.concat(F.lit("local-"), "idx")).alias("message_id"), F.coalesce(_get("m", "$.seq").try_cast("long"), _get("m", "$.seq").try_cast("double").try_cast("long"), F.col("idx").cast("long")).alias("seq"),
        parse_int(_get("m", "$.timestamp")).alias("timestamp_ms"), F.col("uid").alias("sender_uid"), _get("m", "$.sender.remark", "$.sender.name", "$.sender.nickname").alias("sender_name"), _role(F.col("uid"), F.col("_system"), who).alias("role"),
        kind.alias("kind"), F.col("_type").alias("raw_type"), "text", "placeholders", F.col("_reply.id").alias("reply_to_id"), F.col("_reply.text").alias("reply_to_summary"), has_media.alias("has_media"),
    ).select(*_COLUMNS)


# fixed values: attachments of Discord messages by the ending of their name
_ENDINGS = (("[图片]", r"\.(?:png|jpe?g|gif|webp|bmp)$"), ("[视频]", r"\.(?:mp4|webm|mov)$"), ("[语音]", r"\.(?:mp3|ogg|wav|m4a)$"))


def discord_messages(payloads: DataFrame, who: Identities = Identities()) -> DataFrame:
    """Messages of Discord chat exports: ISO times, attachments by their ending; rows without content are dropped."""
    v = payloads.where("suffix not in ('.jsonl', '.ndjson', '.txt', '.md', '.html', '.htm')").select("file", strict_object(F.col("content")).alias("v")).where(F.col("v").isNotNull())
    fits = (_get("v", "$.channel.id") != "") & (_get("v", "$.channel.type") != "") & (_get("v", "$.exportedAt") != "") & (_get("v", "$.guild") != "")
    rows = v.where(fits).select("file", F.posexplode(_items("v", "$.messages")).alias("idx", "m"))
    stamp = _get("m", "$.timestamp")
    local = F.to_utc_timestamp(F.try_to_timestamp(F.substring(F.regexp_replace(stamp, "T", " "), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")), who.zone)
    at = F.when(stamp.rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$"), stamp.try_cast("timestamp")).otherwise(local)
    name = lambda a: F.lower(F.coalesce(F.nullif(_get(a, "$.fileName"), F.lit("")), F.regexp_replace(_get(a, "$.url"), r"[?#].*$", "")))
    label = lambda a: F.coalesce(*[F.when(name(a).rlike(p), F.lit(t)) for t, p in _ENDINGS], F.lit("[文件]"))
    extra = F.when(F.size(_items("m", "$.stickers")) > 0, F.array(F.lit("[表情]"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"uid": strip(_get("m", "$.author.id")), "_id": strip(_get("m", "$.id")), "text": strip(_get("m", "$.content")), "_ms": F.unix_millis(at), "_type": F.coalesce(F.nullif(_get("m", "$.type"), F.lit("")), F.lit("Default"))})
    rows = rows.withColumns({"_system": ~F.col("_type").isin("Default", "Reply", "ChatInputCommand", "ContextMenuCommand"), "_tags": F.concat(F.array_distinct(F.transform(_items("m", "$.attachments"), label)), extra), "_reply": _get("m", "$.reference.messageId")})
    tags = F.when((F.col("text") == "") & (F.size("_tags") == 0) & (F.size(_items("m", "$.embeds")) > 0), F.array(F.lit("[链接]"))).otherwise(F.col("_tags"))
    rows = rows.withColumn("placeholders", tags).where("uid != '' and _id != '' and _ms is not null").where(F.col("_system") | (F.col("text") != "") | (F.size("placeholders") > 0))
    kind = F.when(F.col("_system"), "system").when(F.col("_reply") != "", "reply").when(F.col("text") != "", "text").otherwise("placeholder")
    return rows.select(
        "file", F.concat(F.lit("discord:"), "_id").alias("message_id"), F.col("idx").cast("long").alias("seq"), F.col("_ms").alias("timestamp_ms"), F.col("uid").alias("sender_uid"),
        F.coalesce(F.nullif(_get("m", "$.author.nickname", "$.author.name"), F.lit("")), "uid").alias("sender_name"), _role(F.col("uid"), F.col("_system"), who).alias("role"), kind.alias("kind"),
        F.concat(F.lit("discord_"), "_type").alias("raw_type"), "text", "placeholders", F.when(F.col("_reply") != "", F.concat(F.lit("discord:"), "_reply")).alias("reply_to_id"), _none().alias("reply_to_summary"), (F.size("placeholders") > 0).alias("has_media"),
    ).select(*_COLUMNS)


# fixed values: what stands for media in WhatsApp texts
WHATSAPP_MEDIA = {
    "[图片]": "[图片]", "<图片已忽略>": "[图片]", "<image omitted>": "[图片]", "<media omitted>": "[附件]", "<媒体已忽略>": "[附件]", "[视频]": "[视频]", "<视频已忽略>": "[视频]", "<video omitted>": "[视频]", "[语音]": "[语音]",
    "<音频已忽略>": "[语音]", "<audio omitted>": "[语音]", "[表情]": "[表情]", "<贴图已忽略>": "[表情]", "<sticker omitted>": "[表情]", "<album消息>": "[图片]", "[album消息]": "[图片]", "<document omitted>": "[文件]", "<文件已忽略>": "[文件]",
}
# fixed values: how exports write the beginning of a message
_HEAD = r"^\[?([0-9]{1,4}[/.\-][0-9]{1,2}[/.\-][0-9]{1,4}),?\s+([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:\s*[APap][Mm])?)\]?\s*(?:-\s*)?(.*)$"
_MARKS = "[\\u200e\\u200f\\u202a-\\u202c\\u2066-\\u2069]"
_MD_DAY, _MD_HEAD = r"^##\s+([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日\s*$", r"^\[([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\]\s+(.*)$"


def whatsapp_messages(payloads: DataFrame, who: Identities = Identities()) -> DataFrame:
    """Messages of WhatsApp text and Markdown exports.

    A line with a date and a time begins a message, other lines go on with it. Whether
    the day comes first is told from all dates of a file. Ids are digests, with the
    number of equal messages before.
    """
    content = F.regexp_replace(F.regexp_replace("content", _MARKS, ""), "[\\u202f\\u00a0]", " ")
    lines = payloads.where("suffix in ('.txt', '.md')").select("file", (F.col("suffix") == ".md").alias("md"), content.alias("_c")).where(~F.col("md") | F.startswith("_c", F.lit("# WhatsApp")))
    lines = lines.select("file", "md", F.posexplode(F.split("_c", r"\r\n|[\n\r]")).alias("line", "t"))
    order = Window.partitionBy("file").orderBy("line")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    at = lambda p, i: F.regexp_extract("t", p, i)
    is_day = F.col("md") & F.col("t").rlike(_MD_DAY)
    day = F.last(F.when(is_day, F.concat_ws("-", at(_MD_DAY, 1), at(_MD_DAY, 2), at(_MD_DAY, 3))), ignorenulls=True).over(so_far)
    lines = lines.withColumns({"_isday": is_day, "_day": day})
    head = F.when(F.col("md"), F.col("_day").isNotNull() & F.col("t").rlike(_MD_HEAD)).otherwise(F.col("t").rlike(_HEAD))
    lines = lines.where(~F.col("_isday")).withColumn("_head", head).withColumn("_n", F.sum(F.col("_head").cast("int")).over(so_far))
    # in Markdown, rules, headings and blank lines belong to no message
    lines = lines.where("_n > 0").where(F.col("_head") | ~F.col("md") | ((F.col("t") != "") & (F.col("t") != "---") & ~F.startswith("t", F.lit("#"))))
    body = F.when(F.col("md"), at(_MD_HEAD, 2)).otherwise(at(_HEAD, 3))
    said_md, colon = body.rlike(r"^\*\*(.+?):\*\*\s?(.*)$"), F.instr(body, ": ")
    sender = F.when(F.col("md"), F.when(said_md, F.regexp_extract(body, r"^\*\*(.+?):\*\*\s?(.*)$", 1))).when(colon > 0, F.substring_index(body, ": ", 1))
    text = F.when(F.col("md"), F.when(said_md, F.regexp_extract(body, r"^\*\*(.+?):\*\*\s?(.*)$", 2)).otherwise(F.regexp_replace(body, "^__|__$", ""))).otherwise(F.when(colon > 0, F.substr(body, colon + 2)).otherwise(body))
    part = F.struct("line", F.when(F.col("_head"), text).otherwise(F.col("t")).alias("t"))
    records = lines.groupBy("file", "_n").agg(
        F.max(F.when(F.col("_head"), F.when(F.col("md"), F.col("_day")).otherwise(at(_HEAD, 1)))).alias("date"), F.max(F.when(F.col("_head"), F.upper(strip(F.when(F.col("md"), at(_MD_HEAD, 1)).otherwise(at(_HEAD, 2)))))).alias("clock"),
        F.max(F.when(F.col("_head"), strip(sender))).alias("sender"), strip(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n")).alias("text"),
    )
    piece = lambda i: F.get(F.split("date", r"[/.\-]"), F.lit(i)).try_cast("int")
    long_first = F.length(F.get(F.split("date", r"[/.\-]"), F.lit(0))) == 4
    day_first = F.max(F.contains("date", F.lit(".")) | (~long_first & (piece(0) > 12))).over(Window.partitionBy("file"))
    records = records.withColumn("_df", day_first)
    short = F.when(piece(2) < 69, piece(2) + 2000).when(piece(2) < 100, piece(2) + 1900).otherwise(piece(2))
    year = F.when(long_first, piece(0)).otherwise(short)
    month = F.when(long_first, piece(1)).when(F.col("_df"), piece(1)).otherwise(piece(0))
    dom = F.when(long_first, piece(2)).when(F.col("_df"), piece(0)).otherwise(piece(1))
    clock = lambda i: F.regexp_extract("clock", r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?\s*([AP]M)?$", i)
    half, hour = clock(4), clock(1).try_cast("int")
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "PM", 12).otherwise(0))
    when = F.to_utc_timestamp(F.try_make_timestamp_ntz(year, month, dom, hour, clock(2).try_cast("int"), F.coalesce(clock(3).try_cast("int"), F.lit(0))).cast("timestamp"), who.zone)
    named = F.coalesce(F.nullif("sender", F.lit("")), F.lit(""))
    uid = F.when(named != "", F.concat(F.lit("whatsapp:"), F.regexp_replace(F.url_encode(named), r"\+", "%20"))).otherwise("")
    media = F.element_at(F.create_map(*[F.lit(x) for kv in WHATSAPP_MEDIA.items() for x in kv]), F.lower("text"))
    rows = records.withColumns({"_ms": F.unix_millis(when), "uid": uid, "_name": named, "_media": media}).where("_ms is not null")
    digest = F.substring(F.sha2(F.concat(F.col("_ms").cast("string"), F.lit("\x00"), "uid", F.lit("\x00"), "text"), 256), 1, 24)
    rows = rows.withColumn("_digest", digest).withColumn("_k", F.row_number().over(Window.partitionBy("file", "_digest").orderBy("_n")) - 1)
    system = F.col("uid") == ""
    return rows.select(
        "file", F.concat_ws(":", F.lit("whatsapp"), "_digest", "_k").alias("message_id"), (F.col("_n") - 1).cast("long").alias("seq"), F.col("_ms").alias("timestamp_ms"), F.col("uid").alias("sender_uid"), F.col("_name").alias("sender_name"),
        _role(F.col("uid"), system, who).alias("role"), F.when(system, "system").when(F.col("_media").isNotNull(), "placeholder").otherwise("text").alias("kind"), F.when(system, "whatsapp_system").otherwise("whatsapp_message").alias("raw_type"),
        F.when(F.col("_media").isNotNull(), "").otherwise(F.col("text")).alias("text"), F.when(F.col("_media").isNotNull(), F.array("_media")).otherwise(F.array().cast("array<string>")).alias("placeholders"), _none().alias("reply_to_id"), _none().alias("reply_to_summary"),
        F.col("_media").isNotNull().alias("has_media"),
    ).select(*_COLUMNS)
