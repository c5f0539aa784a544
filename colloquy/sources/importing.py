"""Import of a folder of chats: the format of each file, its messages, people, images and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cleaning import chunkable, clean_message, strip, warmth
from ..functions.scalars import parse_int
from ..operators.relations import import_totals, refs_with_files, refs_with_messages, reuse_descriptions
from ..operators.sequence import context_frames, message_identity, message_tags, response_pairs, session_summary, sessionize, sliding_windows, window_chunks
from . import chat, exports
from .chat import Identities, _get, _items, json_lines, read_payloads

#: Readers by name, in the order in which a file is tried.
READERS = {
    "canonical": chat.canonical_messages, "qq": chat.qq_messages, "weflow": exports.weflow_messages, "weflow_chatlab": exports.weflow_chatlab_messages, "douyin": exports.douyin_messages, "discord": chat.discord_messages,
    "telegram": exports.telegram_messages, "whatsapp": chat.whatsapp_messages,
}
#: Readers that take any file with messages when they are asked for by name.
_UNCHECKED = ("qq", "weflow")


def messages_of(payloads: DataFrame, who: Identities = Identities(), name: str | None = None) -> DataFrame:
    """Messages of files that are at hand as rows (file, name, suffix, content), with their format.

    A reader that is named takes files of any shape that it can read; else a file is the
    first reader's that knows it.
    """
    if name is not None and name not in READERS:
        raise ValueError(f"no reader {name!r}; there are {', '.join(READERS)}")
    if name is not None:
        rows = READERS[name](payloads, who, checked=False) if name in _UNCHECKED else READERS[name](payloads, who)
        return rows.withColumn("format", F.lit(name))
    out = None
    for place, (key, reader) in enumerate(READERS.items()):
        rows = reader(payloads, who).withColumns({"format": F.lit(key), "_o": F.lit(place)})
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("_m", F.min("_o").over(Window.partitionBy("file"))).where("_o = _m").drop("_o", "_m")


def read_chats(spark: SparkSession, path: str, who: Identities = Identities(), name: str | None = None) -> DataFrame:
    """Messages of all files below ``path``; by one reader if it is named."""
    return messages_of(read_payloads(spark, path), who, name)


def owners(payloads: DataFrame) -> DataFrame:
    """(file, owner): whose export a file says it is."""
    v = exports._objects(payloads)
    whole = v.select("file", _get("v", "$.chatInfo.selfUid", "$.meta.ownerId").alias("owner"))
    lines = json_lines(payloads).where(_get("record", "$._type") == "header").select("file", _get("record", "$.meta.ownerId").alias("owner"))
    # WeFlow marks the messages that were sent: the owner is who sent one
    items = v.select("file", F.posexplode(_items("v", "$.messages")).alias("i", "m"), "v").where(_get("m", "$.isSend") == "1")
    sent = items.groupBy("file").agg(F.min_by(F.struct(parse_int(_get("m", "$.senderID"), -1).alias("sid"), "v"), "i").alias("x"))
    uid = F.filter(_items(F.col("x.v"), "$.senders"), lambda s: parse_int(_get(s, "$.senderID"), -2) == F.col("x.sid"))
    named = sent.select("file", _get(F.get(uid, F.lit(0)), "$.wxid").alias("owner"))
    return whole.unionByName(lines).unionByName(named).where("owner != ''").groupBy("file").agg(F.min("owner").alias("owner"))


def inspect_chats(spark: SparkSession, path: str, most: int = 20) -> DataFrame:
    """One row per file: format, messages, its most frequent senders with a hint of their role, or why it gives none.

    The owner of an export, where it names one, is ``self``, and the most frequent other
    sender ``friend``. A line of JSONL that isn't an object is named by its number.
    """
    payloads = read_payloads(spark, path)
    messages = messages_of(payloads)
    people = messages.where("sender_uid != ''").groupBy("file", "sender_uid").agg(F.first("sender_name").alias("name"), F.count("*").alias("n"))
    people = people.join(owners(payloads), "file", "left")
    own = F.coalesce(F.col("sender_uid") == F.col("owner"), F.lit(False))
    w = Window.partitionBy("file")
    people = people.withColumns({"_own": own, "_k": F.row_number().over(w.orderBy(F.desc("n"), "sender_uid")), "_f": F.row_number().over(w.orderBy(own, F.desc("n"), "sender_uid"))})
    hint = F.when(F.col("_own"), "self").when(F.col("owner").isNotNull() & (F.col("_f") == 1), "friend").otherwise("unknown")
    person = lambda x: F.struct(x["uid"].alias("uid"), x["name"].alias("name"), x["n"].alias("n"), x["role_hint"].alias("role_hint"))
    rows = people.withColumn("role_hint", hint).where((F.col("_k") <= most) | F.col("_own"))
    listed = rows.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col("sender_uid").alias("uid"), "name", "n", "role_hint"))), person).alias("people"))
    counts = messages.groupBy("file").agg(F.first("format").alias("format"), F.count("*").alias("n_messages"))
    broken = json_lines(payloads).where("record is null").groupBy("file").agg(F.min("line").alias("_line"))
    why = F.when(F.trim("content") == "", "empty file").when(F.col("_line").isNotNull(), F.concat(F.lit("line "), F.col("_line").cast("string"), F.lit(" isn't a JSON object"))).otherwise("no known format")
    files = payloads.join(broken, "file", "left").select("file", why.alias("_why"))
    return files.join(counts, "file", "left").join(listed, "file", "left").select("file", "format", F.coalesce("n_messages", F.lit(0)).alias("n_messages"), "people", F.when(F.col("format").isNull(), F.col("_why")).alias("error"))


# the chain ---------------------------------------------------------------------------------------

#: Ids that a reader made up because an export has none: by place, or by file and line.
_OWN_IDS = r"^local-[0-9]+$|-[0-9a-f]{12}-[0-9]+$"
#: Trust in what people wrote themselves, and platforms whose ids stay the same in every export.
ORIGINAL, TRUST = "human_original", 1.0
_STABLE = "^(?:discord_|telegram_|whatsapp_)"


def distinct_messages(messages: DataFrame) -> DataFrame:
    """Messages of overlapping exports once: the first of each identity.

    An identity is format, sender, platform's id where there is one, time, type, text,
    placeholders and what is replied to. The first is an aggregate, so copies don't meet sorted.
    """
    own = F.when(F.col("message_id").rlike(_OWN_IDS), "").otherwise(F.col("message_id"))
    identity = [F.col("format"), F.col("sender_uid"), own.alias("_id"), F.col("timestamp_ms"), F.col("raw_type"), F.col("text"), F.col("placeholders"), F.col("reply_to_id")]
    first = messages.groupBy(*identity).agg(F.min_by(F.struct(*messages.columns), F.struct("file", "seq", "message_id")).alias("_m"))
    return first.select("_m.*")


def import_chats(payloads: DataFrame, who: Identities = Identities(), own_names: tuple[str, ...] = (), other_names: tuple[str, ...] = (), name: str | None = None, gap_minutes: int = 30, window: int = 12, overlap: int = 3, before: int = 6, after: int = 2, replies: int = 4) -> dict[str, DataFrame]:
    """Everything that an import makes of files: messages, friend_messages, dialogue_windows, response_pairs and totals.

    Overlapping files are read once. Rows have the columns and the provenance of the stored
    tables, but for vectors; ids derive from contents, so importing again changes nothing.
    """
    messages = distinct_messages(messages_of(payloads, who, name))
    clean = clean_message(F.col("text"), F.col("kind"), F.col("raw_type"), F.col("placeholders"), own_names, other_names, who.own, who.friends)
    sessions = sessionize(messages.withColumns({"source": F.col("file"), "text": clean}), gap_minutes)
    named = session_summary(sessions).select("source", "session_no", "session_id")
    framed = context_frames(sessions, before, after).join(named, ["source", "session_no"])
    identity = message_identity(F.col("raw_type").rlike(_STABLE))
    stored = lambda rows: rows.withColumns({"source": F.lit(ORIGINAL), "trust_level": F.lit(TRUST), "deleted": F.lit(False)})
    snippet = F.concat_ws("\n", F.nullif("context_before", F.lit("")), F.concat(F.lit("friend: "), "text"), F.nullif("context_after", F.lit("")))
    friend = framed.where((F.col("role") == "friend") & chunkable(F.col("kind"), F.col("text"))).select(
        F.concat(F.lit("friend-"), F.substring(F.sha1(identity), 1, 16)).alias("id"), "text", snippet.alias("dialogue_snippet"), "context_before", "context_after", "message_id", "session_id", "seq", "timestamp_ms", warmth(F.col("text")).alias("warmth"),
        message_tags(F.col("has_media"), F.col("reply_to_id"), F.col("kind")).alias("tags"), "file",
    )
    windows = sliding_windows(sessions, window, overlap)
    media = windows.groupBy("source", "session_no", "window_no").agg(F.max("has_media").alias("has_media"))
    chunks = window_chunks(windows).join(media, ["source", "session_no", "window_no"]).join(named, ["source", "session_no"])
    chunks = chunks.select(F.col("chunk_id").alias("id"), "text", F.lit("").alias("summary"), "session_id", "start_seq", "end_seq", F.col("start_ms").alias("start_time_ms"), F.col("end_ms").alias("end_time_ms"), "message_count", "has_media", F.col("source").alias("file"))
    pairs = response_pairs(sessions, replies, identity=identity).join(named, ["source", "session_no"])
    said = F.concat(F.lit("self: "), "user_text", F.lit("\nfriend: "), "friend_reply")
    pairs = pairs.select(F.col("pair_id").alias("id"), F.col("user_text").alias("text"), "friend_reply", said.alias("dialogue_snippet"), "user_message_ids", "friend_message_ids", "session_id", "start_seq", "end_seq", "start_time_ms", "end_time_ms", warmth(F.col("friend_reply")).alias("warmth"), F.col("source").alias("file"))
    # an id that two files give is one row
    one = lambda rows: stored(rows.groupBy("id").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("id", "file")]), "file").alias("_r")).select("id", "_r.*"))
    per = sessions.groupBy("file").agg(F.count("*").alias("messages"))
    made = friend.select("file", "id").union(chunks.select("file", "id")).union(pairs.select("file", "id")).groupBy("file").agg(F.count_distinct("id").alias("chunks"))
    files = payloads.select("file").join(per, "file", "left").join(made, "file", "left").withColumn("error", F.when(F.col("messages").isNull(), "no messages"))
    return {"messages": sessions, "friend_messages": one(friend), "dialogue_windows": one(chunks), "response_pairs": one(pairs), "totals": import_totals(files)}


# images ------------------------------------------------------------------------------------------


def image_refs(payloads: DataFrame) -> DataFrame:
    """Distinct (file, message_id, path) of the images that messages of any format refer to.

    Addresses of other machines and paths out of the chat's folder are left out where a
    format has them.
    """
    kind = lambda x: F.lower(_get(x, "$.type"))
    explode = lambda rows, paths: rows.select("file", "message_id", F.explode(paths).alias("path"))

    said, _ = chat._canonical_parts(payloads)
    own = F.coalesce(F.nullif(_get("m", "$.id", "$.message_id", "$._jsonlSourceId"), F.lit("")), F.nullif("source_id", F.lit("")), F.concat(F.lit("local-"), "idx"))
    images = F.filter(_items("m", "$.attachments"), lambda a: kind(a) == "image")
    out = explode(said.withColumn("message_id", own), F.transform(images, lambda a: _get(a, "$.name", "$.filename")))

    qq = chat.qq_parts(payloads).withColumn("message_id", F.coalesce(F.nullif(_get("m", "$.id"), F.lit("")), "source_id")).where("message_id != ''")
    place = lambda x: _get(x, "$.localPath", "$.filename")
    resources = F.transform(F.filter(_items("m", "$.content.resources"), lambda r: kind(r) == "image"), place)
    elements = F.transform(F.filter(_items("m", "$.content.elements"), lambda r: kind(r) == "image"), lambda r: _get(r, "$.data.localPath", "$.data.filename"))
    out = out.unionByName(explode(qq, F.concat(resources, elements)))

    _, _, lab = exports.chatlab_parts(payloads, "weflow", "wechat")
    content = strip(_get("m", "$.content"))
    tag = exports._chatlab_tag(parse_int(F.nullif(_get("m", "$.type"), F.lit("")), 99), content)
    own = F.coalesce(F.nullif(_get("m", "$.platformMessageId", "$._jsonlSourceId"), F.lit("")), F.nullif("source_id", F.lit("")), F.concat(F.lit("local-"), "idx"))
    out = out.unionByName(lab.where(tag == "[图片]").select("file", own.alias("message_id"), content.alias("path")))

    discord = exports._objects(payloads).where((_get("v", "$.channel.id") != "") & (_get("v", "$.exportedAt") != "")).select("file", F.explode(_items("v", "$.messages")).alias("m")).where(_get("m", "$.id") != "")
    local = F.transform(_items("m", "$.attachments"), lambda a: exports._local_image(_get(a, "$.url")))
    out = out.unionByName(explode(discord.withColumn("message_id", F.concat(F.lit("discord:"), _get("m", "$.id"))), local))

    out = out.unionByName(explode(exports._telegram_rows(payloads).where("service or sender != ''"), F.col("images")))
    # one reference of a message and path, whatever its case
    return out.where("path is not null and path != ''").groupBy("file", "message_id", F.lower("path").alias("_low")).agg(F.min("path").alias("path")).drop("_low")


def image_files(spark: SparkSession, path: str, most_bytes: int = 20 << 20) -> DataFrame:
    """Images below a folder: path, size and sha, read where the files are; larger ones aren't."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower("path").rlike(r"\.(?:" + "|".join(exports.IMAGE_ENDINGS) + ")$") & (F.col("length") <= most_bytes))
    return rows.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("image_sha"))


def import_images(messages: DataFrame, refs: DataFrame, files: DataFrame, described: DataFrame, gap_minutes: int = 30, before: int = 6, after: int = 2) -> DataFrame:
    """References with their message, session, context, file and what is left to do with the image.

    ``messages`` are those of :func:`read_chats`, ``refs`` those of :func:`image_refs`, ``files``
    has path, size and image_sha, ``described`` image_sha, description and deleted. States:
    missing (no file, or several), reusable, failed, pending.
    """
    ready = sessionize(messages.withColumn("source", F.col("file")), gap_minutes)
    frames = context_frames(ready, before, after).select("message_id", "context_before", "context_after")
    named = refs.withColumn("ref_id", F.xxhash64("file", "message_id", "path"))
    found = refs_with_messages(named.drop("file"), ready, ["timestamp_ms", "seq"])
    found = refs_with_files(found, files).join(files.select(F.col("path").alias("file"), "size", "image_sha"), "file", "left")
    found = found.join(frames.dropDuplicates(["message_id"]), "message_id", "left")
    rows = reuse_descriptions(found, described)
    chunk = F.when(F.col("file").isNotNull(), F.concat(F.lit("image-"), "message_id", F.lit("-"), F.substring("image_sha", 1, 16)))
    return rows.withColumns({"state": F.when(F.col("file").isNull(), "missing").otherwise(F.col("state")), "chunk_id": chunk})


def image_report(imported: DataFrame) -> DataFrame:
    """Totals of :func:`import_images` as one row."""
    n = lambda *states: F.count_if(F.col("state").isin(*states))
    return imported.agg(
        F.count("*").alias("refs"), F.count_if(F.col("state") != "missing").alias("matched"), n("missing").alias("missing"), F.count_distinct("image_sha").alias("unique_images"), n("reusable").alias("reused"), n("failed").alias("failed"),
        F.count_distinct(F.when(F.col("state") == "pending", F.col("image_sha"))).alias("to_describe"),
    )
