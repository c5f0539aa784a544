"""Readers of the WeFlow, ChatLab and Telegram exports, and the images that chats refer to.

An export's payload is split in relations of its header, members and messages, JSON and
JSONL alike; senders are joined within their file. A page of HTML becomes a relation of
message nodes, on which the rules of senders, media and replies are column expressions.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import strip
from ..functions.scalars import parse_int, strict_object
from .chat import _COLUMNS, Identities, _get, _items, _none, _role, json_lines

_LINES, _TEXTS = (".jsonl", ".ndjson"), (".txt", ".md", ".html", ".htm")
_NO_TAGS = "array<string>"


def _objects(payloads: DataFrame) -> DataFrame:
    return payloads.where(~F.col("suffix").isin(*_LINES, *_TEXTS)).select("file", strict_object(F.col("content")).alias("v")).where(F.col("v").isNotNull())


def _is(v: Column | str, path: str, kind: str) -> Column:
    """Whether what stands at a path is an object ({) or an array ([)."""
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(F.startswith(F.to_json(F.try_variant_get(v, path, "variant")), F.lit(kind)), F.lit(False))


def _tags(label: Column) -> Column:
    """An array of the one label, or an empty one."""
    return F.when(label.isNotNull(), F.array(label)).otherwise(F.array().cast(_NO_TAGS))


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


# ChatLab: a header, members and messages ---------------------------------------------------------


def chatlab_parts(payloads: DataFrame, generator: str, platform: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, members, messages) of ChatLab files by one generator.

    Headers have file and v, members file and m, messages file, idx, m and source_id. A
    JSONL file begins with its header and has nothing but members and messages after it.
    """
    fits = lambda v: (F.lower(strip(_get(v, "$.chatlab.generator"))) == generator) & (F.lower(strip(_get(v, "$.meta.platform"))) == platform)
    whole = _objects(payloads).where(fits("v") & _is("v", "$.messages", "["))
    w = Window.partitionBy("file")
    lines = json_lines(payloads).withColumn("_type", _get("record", "$._type")).withColumn("_n", F.row_number().over(w.orderBy("line")))
    fine = F.col("record").isNotNull() & F.when(F.col("_n") == 1, (F.col("_type") == "header") & fits("record")).otherwise(F.col("_type").isin("member", "message"))
    lines = lines.withColumn("_fine", F.min(F.coalesce(fine, F.lit(False)).cast("int")).over(w)).where("_fine = 1")
    of = lambda kind: lines.where(F.col("_type") == kind)
    headers = whole.select("file", "v").unionByName(of("header").select("file", F.col("record").alias("v")))
    members = whole.select("file", F.explode(_items("v", "$.members")).alias("m")).unionByName(of("member").select("file", F.col("record").alias("m")))
    messages = whole.select("file", F.posexplode(_items("v", "$.messages")).alias("idx", "m")).withColumn("source_id", F.lit(""))
    said = of("message").select("file", (F.row_number().over(w.orderBy("line")) - 1).alias("idx"), F.col("record").alias("m"), "source_id")
    return headers, members, messages.unionByName(said).where(F.startswith(F.to_json("m"), F.lit("{")))


def _ms(seconds_or_ms: Column) -> Column:
    """Times from 1e12 on are milliseconds, smaller ones seconds."""
    return F.when(seconds_or_ms >= 1_000_000_000_000, seconds_or_ms).otherwise(seconds_or_ms * 1000)


# fixed values: types of ChatLab messages, media by the ending of their name, what a recall says
CHATLAB_TAGS = {1: "[图片]", 2: "[语音]", 3: "[视频]", 4: "[文件]", 5: "[表情]", 8: "[位置]", 23: "[通话]", 24: "[小程序]", 27: "[名片]"}
IMAGE_ENDINGS, VIDEO_ENDINGS = ("jpg", "jpeg", "png", "gif", "webp", "bmp"), ("mp4", "mov", "avi", "mkv", "webm")
RECALLS = ("撤回了一条消息", "撤回了一条信息", "已撤回", "撤回了消息", "recalled a message")


def _chatlab_tag(kind: Column, content: Column) -> Column:
    """What stands for a message's media: by the ending of its content, else by its type; null for none."""
    path = F.lower(F.regexp_replace(F.replace(content, F.lit("\\"), F.lit("/")), r"(?s)\?.*$", ""))
    ending = F.regexp_extract(path, r"(?s)\.([^.]*)$", 1)
    return F.when(ending.isin(*IMAGE_ENDINGS), "[图片]").when(ending.isin(*VIDEO_ENDINGS), "[视频]").otherwise(F.element_at(_lookup(CHATLAB_TAGS), kind.cast("int")))


def _unquoted(text: Column) -> Column:
    """Text without a quotation that an export puts at its end."""
    return F.when(text.rlike(r"(?s)\[引用.*\]\s*$"), F.regexp_replace(F.regexp_extract(text, r"(?s)^(.*)\[引用", 1), r"\s+$", "")).otherwise(text)


def weflow_chatlab_messages(payloads: DataFrame, who: Identities = Identities()) -> DataFrame:
    """Messages of WeFlow's ChatLab JSON and JSONL: numbered types, media by ending before type, seconds or milliseconds."""
    _, _, messages = chatlab_parts(payloads, "weflow", "wechat")
    content = strip(_get("m", "$.content"))
    rows = messages.withColumns({"uid": _get("m", "$.sender"), "_type": parse_int(F.nullif(_get("m", "$.type"), F.lit("")), 99), "content": content, "_reply": _get("m", "$.replyToMessageId")})
    rows = rows.withColumns({"_recalled": (F.col("_type") == 80) & F.lower("content").rlike("|".join(RECALLS)), "_tag": _chatlab_tag(F.col("_type"), F.col("content")), "_is_reply": (F.col("_type") == 25) | (F.col("_reply") != "")})
    rows = rows.withColumns({"_system": (F.col("_type") == 80) & ~F.col("_recalled"), "_text": F.when(F.col("_is_reply"), _unquoted(F.col("content"))).otherwise(F.col("content"))})
    said, tagged = F.col("content") != "", F.col("_tag").isNotNull()
    kind = (
        F.when(F.col("_recalled"), "recalled").when(F.col("_system"), "system").when(F.col("_is_reply"), "reply").when(tagged, "placeholder").when(said, "text").otherwise("unknown")
    )
    tail = F.substring(strip(F.substr("content", F.length("_text") + 1)), 1, 120)
    own = F.coalesce(F.nullif(_get("m", "$.platformMessageId", "$._jsonlSourceId"), F.lit("")), F.nullif("source_id", F.lit("")), F.concat(F.lit("local-"), "idx"))
    return rows.select(
        "file", own.alias("message_id"), F.col("idx").cast("long").alias("seq"), _ms(parse_int(_get("m", "$.timestamp"))).alias("timestamp_ms"), F.col("uid").alias("sender_uid"),
        F.coalesce(F.nullif(_get("m", "$.groupNickname", "$.accountName"), F.lit("")), "uid").alias("sender_name"), _role(F.col("uid"), F.col("_system"), who).alias("role"), kind.alias("kind"), F.concat(F.lit("chatlab_"), F.col("_type").cast("string")).alias("raw_type"),
        F.when(tagged, "").otherwise(F.col("_text")).alias("text"), _tags(F.col("_tag")).alias("placeholders"), F.nullif("_reply", F.lit("")).alias("reply_to_id"), F.nullif(tail, F.lit("")).alias("reply_to_summary"), tagged.alias("has_media"),
    ).select(*_COLUMNS)


# fixed values: what Douyin says itself, and how it writes voice and video
DOUYIN_SYSTEM = ("我们已互相关注，可以开始聊天了", "你们已互相关注，可以开始聊天了", "[系统消息]")
DOUYIN_SYSTEM_PREFIXES = ("[系统]", "[通话成功]", "[视频通话邀请]", "[一起看视频]")
DOUYIN_LENGTH = r"^\[%s(?:\s+[0-9]+(?:\.[0-9]+)?秒)?\]$"


def _whole(m: str, path: str) -> Column:
    """A whole number, or a text of one; other values are null."""
    v = F.try_variant_get(F.col(m), path, "variant")
    text = F.try_variant_get(v, "$", "string")
    return F.when(F.schema_of_variant(v) == "STRING", F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), strip(text).try_cast("long"))).otherwise(text.try_cast("double").try_cast("long"))


def douyin_messages(payloads: DataFrame, who: Identities = Identities()) -> DataFrame:
    """Messages of the Douyin exporter's ChatLab JSON and JSONL. Private chats only.

    Rows without a time, without a sender that aren't the system's, or without content are dropped.
    """
    headers, _, messages = chatlab_parts(payloads, "douyin-chat-export", "douyin")
    private = headers.where(F.lower(strip(F.coalesce(F.nullif(_get("v", "$.meta.type"), F.lit("")), F.lit("private")))) == "private").select("file")
    text_of = F.try_variant_get("m", "$.content", "variant")
    content = F.when(F.schema_of_variant(text_of) == "STRING", strip(F.try_variant_get(text_of, "$", "string"))).otherwise("")
    rows = messages.join(private, "file", "left_semi").withColumns({"uid": strip(_get("m", "$.sender")), "_type": _whole("m", "$.type"), "_time": _whole("m", "$.timestamp"), "content": F.coalesce(content, F.lit(""))})
    plain = F.col("_type") == 0
    is_system = F.coalesce(plain & (F.col("content").isin(*DOUYIN_SYSTEM) | F.col("content").rlike("^(?:" + "|".join(x.replace("[", r"\[").replace("]", r"\]") for x in DOUYIN_SYSTEM_PREFIXES) + ")")), F.lit(False))
    tag = (
        F.when(F.col("_type") == 1, "[图片]").when(F.col("_type") == 5, "[表情]").when(plain & F.col("content").rlike(DOUYIN_LENGTH % "语音"), "[语音]").when(plain & F.col("content").rlike(DOUYIN_LENGTH % "视频"), "[视频]")
        .when(plain & (F.col("content") == "[分享内容]"), "[链接]").when((F.col("_type") == 24) & (F.col("content") == ""), "[链接]")
    )
    author, quoted = strip(_get("m", "$.replyTo.replyToAuthor")), strip(_get("m", "$.replyTo.replyToContent"))
    summary = F.substring(F.when((author != "") & (quoted != ""), F.concat(author, F.lit(": "), quoted)).otherwise(F.concat(quoted, author)), 1, 120)
    rows = rows.withColumns({"_system": is_system, "_tag": tag, "_reply": strip(_get("m", "$.replyTo.replyTo")), "_quoted": summary}).where("_time > 0").where("uid != '' or _system")
    text = F.when(F.col("_tag").isNotNull(), "").otherwise(F.col("content"))
    kind = (
        F.when(F.col("_system"), "system").when(F.col("_tag").isNotNull(), "placeholder").when((F.col("_reply") != "") | (F.col("_quoted") != ""), "reply").when(F.col("_type").isin(0, 24) & (text != ""), "text").when(text != "", "unknown")
    )
    rows = rows.withColumn("kind", kind).where("kind is not null")
    raw = F.coalesce(F.nullif(_get("m", "$.type"), F.lit("")), F.lit("unknown"))
    own = F.coalesce(F.nullif(_get("m", "$.platformMessageId"), F.lit("")), F.concat(F.lit("local-"), "idx"))
    return rows.select(
        "file", own.alias("message_id"), F.col("idx").cast("long").alias("seq"), _ms(F.col("_time")).alias("timestamp_ms"), F.col("uid").alias("sender_uid"), strip(F.coalesce(F.nullif(_get("m", "$.accountName"), F.lit("")), "uid")).alias("sender_name"),
        _role(F.col("uid"), F.col("_system"), who).alias("role"), "kind", F.concat(F.lit("chatlab_"), raw).alias("raw_type"), text.alias("text"), _tags(F.col("_tag")).alias("placeholders"),
        F.nullif("_reply", F.lit("")).alias("reply_to_id"), F.nullif("_quoted", F.lit("")).alias("reply_to_summary"), F.col("_tag").isNotNull().alias("has_media"),
    ).select(*_COLUMNS)


# WeFlow's own JSON: messages with a dimension of senders -----------------------------------------

# fixed values: types of WeFlow messages with what stands for them, types of plain text, tokens that aren't faces
WEFLOW_TAGS = {
    "图片消息": "[图片]", "动画表情": "[表情]", "语音消息": "[语音]", "视频消息": "[视频]", "文件消息": "[文件]", "位置消息": "[位置]", "链接消息": "[链接]", "通话消息": "[通话]", "名片消息": "[名片]", "小程序消息": "[小程序]", "转账消息": "[转账]", "红包消息": "[红包]",
}
WEFLOW_PLAIN = ("文本消息", "引用消息", "系统消息", "私聊", "群聊")
RESERVED = ("图片", "语音", "视频", "文件", "位置", "链接", "通话", "名片", "小程序", "转账", "红包", "表情", "表情包", "动画表情", "撤回", "系统消息", "引用", "未知消息", "附件")


def weflow_messages(payloads: DataFrame, who: Identities = Identities(), checked: bool = True) -> DataFrame:
    """Messages of WeFlow's JSON: senders by number, times in seconds, recalls told by their text, lone faces as placeholders."""
    v = _objects(payloads)
    named = _is("v", "$.weflow", "{") & (F.contains(F.lower(_get("v", "$.weflow.format")), F.lit("arkme")) | F.contains(F.lower(_get("v", "$.weflow.generator")), F.lit("weflow")))
    shaped = _is("v", "$.session", "{") & _is("v", "$.senders", "[") & F.coalesce(F.try_variant_get("v", "$.senders[0].wxid", "variant").isNotNull(), F.lit(False))
    chatlab = (F.lower(_get("v", "$.chatlab.generator")) == "weflow") & (F.lower(_get("v", "$.meta.platform")) == "wechat")
    v = v.where(((named | shaped) if checked else F.lit(True)) & ~chatlab & _is("v", "$.messages", "["))
    senders = v.select("file", F.posexplode(_items("v", "$.senders")).alias("_p", "s")).withColumn("sid", parse_int(_get("s", "$.senderID"), -1)).where("sid >= 0")
    # of senders with one number the last counts
    senders = senders.groupBy("file", "sid").agg(F.max_by(F.struct(_get("s", "$.wxid").alias("uid"), _get("s", "$.displayName", "$.nickname", "$.wxid").alias("name")), "_p").alias("_s")).select("file", "sid", "_s.*")
    rows = v.select("file", F.posexplode(_items("v", "$.messages")).alias("idx", "m")).where(F.startswith(F.to_json("m"), F.lit("{")))
    rows = rows.withColumn("sid", parse_int(F.nullif(_get("m", "$.senderID"), F.lit("")), -1)).join(senders, ["file", "sid"], "left")
    rows = rows.withColumns({"uid": F.coalesce("uid", F.lit("")), "_type": _get("m", "$.type"), "content": strip(_get("m", "$.content")), "_send": parse_int(F.try_variant_get("m", "$.isSend", "string"), -1)})
    is_system = F.col("_type") == "系统消息"
    rows = rows.withColumn("_recalled", is_system & F.col("content").rlike("|".join(RECALLS))).withColumn("_system", is_system & ~F.col("_recalled"))
    reply, quoted, speaker = _get("m", "$.replyToMessageId"), _get("m", "$.quotedContent"), _get("m", "$.quotedSender")
    rows = rows.withColumns({"_reply": reply, "_is_reply": (reply != "") | (quoted != ""), "_quoted": F.substring(F.concat_ws("：", F.nullif(speaker, F.lit("")), F.nullif(quoted, F.lit(""))), 1, 120)})
    faces = r"(?!\[(?:" + "|".join(RESERVED) + r")\])\[[一-龥]{1,4}\]"
    lone = (F.col("_type") == "文本消息") & ~F.col("_is_reply") & (F.col("content") != "") & (strip(F.regexp_replace("content", faces, "")) == "")
    tag = F.when(lone, "[表情]").when(F.col("_type").isin(*WEFLOW_PLAIN) | (F.col("_type") == ""), F.lit(None)).otherwise(F.coalesce(F.element_at(_lookup(WEFLOW_TAGS), F.col("_type")), F.concat(F.lit("["), "_type", F.lit("]"))))
    rows = rows.withColumns({"_tag": tag, "_text": F.when(lone, "").otherwise(F.col("content"))})
    kind = F.when(F.col("_recalled"), "recalled").when(F.col("_system"), "system").when(F.col("_is_reply"), "reply").when(F.col("_text") != "", "text").when(F.col("_tag").isNotNull(), "placeholder").otherwise("unknown")
    sent = F.when(F.col("_send") == 1, "self").when(F.col("_send") == 0, "friend")
    known = F.when(F.col("uid").isin(*who.own), "self").when(F.col("uid").isin(*who.friends), "friend")
    return rows.select(
        "file", F.coalesce(F.nullif(_get("m", "$.platformMessageId"), F.lit("")), F.concat(F.lit("local-"), "idx")).alias("message_id"), F.coalesce(parse_int(F.nullif(_get("m", "$.localId"), F.lit("")), -(1 << 62)), F.lit(0)).alias("_seq"), "idx",
        (parse_int(_get("m", "$.createTime")) * 1000).alias("timestamp_ms"), F.col("uid").alias("sender_uid"), F.coalesce("name", F.lit("")).alias("sender_name"), _role(F.col("uid"), F.col("_system"), who, known, sent).alias("role"), kind.alias("kind"), F.col("_type").alias("raw_type"),
        F.when(F.col("_is_reply"), _unquoted(F.col("_text"))).otherwise(F.col("_text")).alias("text"), _tags(F.col("_tag")).alias("placeholders"), F.when(F.col("_is_reply"), F.col("_reply")).alias("reply_to_id"), F.when(F.col("_is_reply"), F.col("_quoted")).alias("reply_to_summary"),
        F.col("_tag").isNotNull().alias("has_media"),
    ).withColumn("seq", F.when(F.col("_seq") == -(1 << 62), F.col("idx").cast("long")).otherwise(F.col("_seq"))).select(*_COLUMNS)


# Telegram's pages --------------------------------------------------------------------------------

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Node:
    __slots__ = ("attrs", "classes", "parts", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.classes, self.parts = tag, attrs, frozenset(attrs.get("class", "").split()), []

    def inner(self):
        """All nodes below, in their order."""
        for x in self.parts:
            if isinstance(x, _Node):
                yield x
                yield from x.inner()

    def child(self, name: str):
        return next((x for x in self.parts if isinstance(x, _Node) and name in x.classes), None)

    def strings(self):
        for x in self.parts:
            if isinstance(x, str):
                yield x
            elif x.tag == "br":
                yield "\n"
            else:
                yield from x.strings()

    def joined(self, mark: str) -> str:
        return mark.join(s for s in map(str.strip, self.strings()) if s)


class _Tree(HTMLParser):
    """Nested tags as they stand; end tags without a beginning are passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [_Node("", {})]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].parts.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def _message_nodes(page: str) -> list[dict]:
    """What the rules need of each message node of a page with a body."""
    tree = _Tree()
    tree.feed(page)
    tree.close()
    nodes = list(tree.open[0].inner())
    header = next((x for h in nodes if "page_header" in h.classes for x in h.inner() if "text" in x.classes), None)
    title = header.joined("") if header else ""
    out = []
    for history in nodes:
        for node in history.parts if "history" in history.classes else ():
            body = node.child("body") if isinstance(node, _Node) and "message" in node.classes else None
            if body is None:
                continue
            name, said, media, reply = (body.child(c) for c in ("from_name", "text", "media_wrap", "reply_to"))
            date = next((x for x in body.parts if isinstance(x, _Node) and "date" in x.classes and "title" in x.attrs), None)
            shown = [] if media is None else [{"classes": x.attrs.get("class", ""), "href": x.attrs.get("href", "")} for x in media.inner() if x.classes & {"photo_wrap", "sticker_wrap", "media"}]
            link = "" if reply is None else next((x.attrs["href"] for x in reply.inner() if x.tag == "a" and "href" in x.attrs), "")
            out.append({
                "idx": len(out), "chat": title, "id": node.attrs.get("id", ""), "joined": "joined" in node.classes, "service": "service" in node.classes, "name": None if name is None else name.joined(""), "date": None if date is None else date.attrs["title"],
                "said": None if said is None else "".join(said.strings()).strip(), "whole": body.joined(" "), "has_media": media is not None, "media": shown, "reply": link,
            })
    return out


_NODE = pa.struct([
    ("idx", pa.int64()), ("chat", pa.string()), ("id", pa.string()), ("joined", pa.bool_()), ("service", pa.bool_()), ("name", pa.string()), ("date", pa.string()), ("said", pa.string()), ("whole", pa.string()), ("has_media", pa.bool_()),
    ("media", pa.list_(pa.struct([("classes", pa.string()), ("href", pa.string())]))), ("reply", pa.string()),
])


def _pages(batches):
    for batch in batches:
        for file, page in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
            nodes = _message_nodes(page)
            table = pa.Table.from_pylist(nodes, schema=pa.schema(list(_NODE)))
            yield from table.add_column(0, "file", pa.array([file] * len(nodes), pa.string())).to_batches()


def telegram_nodes(payloads: DataFrame) -> DataFrame:
    """Message nodes of Telegram's HTML pages, in their order."""
    content = F.col("content")
    fits = content.rlike(r"""class=["'][^"']*\bhistory\b""") & content.rlike(r"""class=["'][^"']*\bmessage\b""") & F.contains(content, F.lit('id="message'))
    schema = "file string, idx long, chat string, id string, joined boolean, service boolean, name string, date string, said string, whole string, has_media boolean, media array<struct<classes:string,href:string>>, reply string"
    return payloads.where(F.col("suffix").isin(".html", ".htm") & fits).select("file", "content").mapInArrow(_pages, schema)


def _local_image(href: Column) -> Column:
    """The path of an image beside the chat; null for other addresses, other files and paths that lead out."""
    path = F.try_url_decode(F.replace(F.regexp_replace(href, r"(?s)[?#].*$", ""), F.lit("+"), F.lit("%2B")))
    fine = ~href.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)") & ~F.startswith(path, F.lit("/")) & ~path.rlike(r"(?:^|/)\.\.(?:/|$)|\\") & F.lower(path).rlike(r"[^/]\.(?:" + "|".join(IMAGE_ENDINGS) + r")$")
    return F.when(fine, path)


def _telegram_rows(payloads: DataFrame) -> DataFrame:
    nodes = telegram_nodes(payloads)
    so_far = Window.partitionBy("file").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    # a name holds for the joined messages after it; others without a name have none
    given = F.when(F.col("name").isNotNull(), F.col("name")).when(~F.col("joined") & ~F.col("service"), "")
    rows = nodes.withColumn("sender", F.coalesce(F.last(given, ignorenulls=True).over(so_far), F.lit("")))
    stamp = F.regexp_replace(strip(F.replace("date", F.lit("UTC"), F.lit(""))), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    at = F.try_to_timestamp(F.regexp_replace(stamp, r"\s+", " "), F.lit("d.M.yyyy H:m:s XXX"))
    rows = rows.withColumn("_ms", F.unix_millis(at)).where("_ms is not null and id != ''")
    # rows that give no message still count in the order of those that do
    rows = rows.withColumn("seq", (F.row_number().over(Window.partitionBy("file").orderBy("idx")) - 1).cast("long"))
    file_of = lambda x: F.lower(F.regexp_extract(F.regexp_replace(x["href"], r"(?s)[?#].*$", ""), r"[^/]*$", 0))
    has = lambda x, word: F.contains(x["classes"], F.lit(word))
    label = lambda x: (
        F.when(has(x, "sticker") | F.contains(file_of(x), F.lit("sticker")), "[表情]").when(has(x, "video") | file_of(x).rlike(r"\.(?:webm|mp4|mov)$"), "[视频]").when(has(x, "photo"), "[图片]")
        .when(has(x, "voice") | has(x, "audio"), "[语音]").when(has(x, "contact"), "[联系人]").when(has(x, "call"), "[通话]").otherwise("[文件]")
    )
    tags = F.array_distinct(F.transform("media", label))
    tags = F.when(F.col("has_media") & (F.size(tags) == 0), F.array(F.lit("[附件]"))).otherwise(tags)
    space = F.concat(F.lit("telegram:"), F.substring(F.sha2("chat", 256), 1, 16), F.lit(":"))
    number = F.regexp_extract("reply", r"(?:#message|#go_to_message|GoToMessage\()([0-9]+)", 1)
    images = F.array_distinct(F.filter(F.transform("media", lambda x: _local_image(x["href"])), lambda p: p.isNotNull()))
    return rows.withColumns({
        "message_id": F.concat(space, "id"), "sender": F.when(F.col("service"), "").otherwise(F.col("sender")), "text": F.coalesce("said", F.when(F.col("service"), F.col("whole")).otherwise("")), "placeholders": tags,
        "reply_to_id": F.when(number != "", F.concat(space, F.lit("message"), number)), "images": images,
    })


def telegram_messages(payloads: DataFrame, who: Identities = Identities()) -> DataFrame:
    """Messages of Telegram's HTML pages; those without a sender that aren't the service's are dropped."""
    rows = _telegram_rows(payloads).where("service or sender != ''")
    uid = F.when(F.col("sender") == "", "").otherwise(F.concat(F.lit("telegram:"), F.regexp_replace(F.url_encode("sender"), r"\+", "%20")))
    kind = F.when(F.col("service"), "system").when(F.col("reply_to_id").isNotNull(), "reply").when(F.col("text") != "", "text").otherwise("placeholder")
    return rows.withColumn("uid", uid).select(
        "file", "message_id", "seq", F.col("_ms").alias("timestamp_ms"), F.col("uid").alias("sender_uid"), F.col("sender").alias("sender_name"), _role(F.col("uid"), F.col("service"), who).alias("role"), kind.alias("kind"),
        F.when(F.col("service"), "telegram_service").otherwise("telegram_message").alias("raw_type"), "text", "placeholders", "reply_to_id", _none().alias("reply_to_summary"), (F.size("placeholders") > 0).alias("has_media"),
    ).select(*_COLUMNS)
