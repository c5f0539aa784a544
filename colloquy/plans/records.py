"""Queries over chats in exchange formats, intervals and upkeep.

The supplied conversations are written as files of each format, as rows of name and
text, and read back by the readers: so each reader runs over the whole table, and its
result has a twin that never sees a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import scalars as S
from ..operators import intervals, profiles, relations, sequence, summaries
from ..sources import conversion, importing
from ..sources.chat import Identities
from ..sources.tables import conversation_messages, event_messages, table
from .conversation import GAP, GAPS, _opening_sql, _openings

WHO = Identities(own=["self", "whatsapp:self", "telegram:self"], friends=["friend", "whatsapp:friend", "telegram:friend"])
FORMATS = ("canonical", "qq", "weflow", "weflow_chatlab", "douyin", "discord", "telegram", "whatsapp")
_SUFFIX = {"telegram": ".html", "whatsapp": ".txt", "weflow_chatlab": ".jsonl"}


def _iso() -> Column:
    return F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _line(fmt: str) -> Column:
    """A message as a format writes it."""
    system, role, text, ms = F.col("role") == "system", F.col("role"), F.col("text"), F.col("timestamp_ms")
    fields = {
        "canonical": lambda: [F.col("message_id").alias("id"), role.alias("sender_uid"), role.alias("sender_role"), ms, text, system.alias("system")],
        "qq": lambda: [F.col("message_id").alias("id"), ms.alias("timestamp"), F.struct(role.alias("uid")).alias("sender"), F.struct(text).alias("content"), system.cast("string").alias("system")],
        "weflow": lambda: [(ms / 1000).cast("long").alias("createTime"), F.when(system, "系统消息").otherwise("文本消息").alias("type"), text.alias("content"), F.when(role == "self", 1).when(role == "friend", 2).alias("senderID"), (role == "self").cast("int").alias("isSend")],
        "weflow_chatlab": lambda: [F.lit("message").alias("_type"), role.alias("sender"), ms.alias("timestamp"), F.when(system, 80).otherwise(0).alias("type"), text.alias("content")],
        "douyin": lambda: [role.alias("sender"), (ms / 1000).cast("long").alias("timestamp"), F.lit(0).alias("type"), text.alias("content")],
        "discord": lambda: [F.col("message_id").alias("id"), F.when(system, "ChannelPinnedMessage").otherwise("Default").alias("type"), _iso().alias("timestamp"), text.alias("content"), F.struct(role.alias("id")).alias("author")],
    }
    if fmt in fields:
        return F.to_json(F.struct(*fields[fmt]()))
    if fmt == "whatsapp":
        return F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-M-d, HH:mm:ss"), F.lit(" - "), role, F.lit(": "), text)
    escaped = text
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
        escaped = F.replace(escaped, F.lit(mark), F.lit(entity))
    date = F.concat(F.lit('<div class="date details" title="'), F.date_format(F.timestamp_millis(ms), "dd.MM.yyyy HH:mm:ss"), F.lit(' UTC+00:00"></div>'))
    name = F.when(system, "").otherwise(F.concat(F.lit('<div class="from_name">'), role, F.lit("</div>")))
    return F.concat(F.lit('<div class="message '), F.when(system, "service").otherwise("default"), F.lit('" id="message'), F.col("seq").cast("string"), F.lit('"><div class="body">'), date, name, F.lit('<div class="text">'), escaped, F.lit("</div></div></div>"))


_FRAMES = {
    "canonical": ('{"tool":{"format":"any-chat","version":"1.0"},"conversation":{"type":"private"},"messages":[', ",", "]}"),
    "qq": ('{"chatInfo":{"selfUid":"self"},"messages":[', ",", "]}"),
    "weflow": ('{"weflow":{"format":"arkme-json"},"senders":[{"senderID":1,"wxid":"self"},{"senderID":2,"wxid":"friend"}],"messages":[', ",", "]}"),
    "weflow_chatlab": ('{"_type":"header","chatlab":{"generator":"WeFlow"},"meta":{"platform":"wechat"}}\n', "\n", "\n"),
    "douyin": ('{"chatlab":{"generator":"douyin-chat-export"},"meta":{"platform":"douyin","ownerId":"self"},"messages":[', ",", "]}"),
    "discord": ('{"guild":{"id":"0"},"channel":{"id":"1","type":"DirectTextChat"},"exportedAt":"2024","messages":[', ",", "]}"),
    "telegram": ('<html><div class="page_header"><div class="text">chat</div></div><div class="history">', "\n", "</div></html>"),
    "whatsapp": ("", "\n", ""),
}


def exported(messages: DataFrame, fmt: str) -> DataFrame:
    """A file (file, name, suffix, content) for each source's messages."""
    rows = messages.where("role != 'system'") if fmt == "whatsapp" else messages
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("timestamp_ms", "seq", _line(fmt).alias("line")))), lambda x: x["line"]), _FRAMES[fmt][1])
    files = rows.groupBy("source").agg(said.alias("said"))
    name, suffix = F.col("source").cast("string"), _SUFFIX.get(fmt, ".json")
    return files.select(F.concat(name, F.lit(suffix)).alias("file"), name.alias("name"), F.lit(suffix).alias("suffix"), F.concat(F.lit(_FRAMES[fmt][0]), "said", F.lit(_FRAMES[fmt][2])).alias("content"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.regexp_extract("file", "^[0-9]+", 0).cast("long").alias("source"), "seq", "timestamp_ms", "role", "kind", F.sha1("text").alias("text_sha1"), F.size("placeholders").alias("n_placeholders"))


def _reader(fmt: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _shown(importing.messages_of(exported(conversation_messages(spark, sf), fmt), WHO, fmt))

    return run


def q76_any_export(spark, sf):
    """Files of all formats, each told by its shape: the conversation's number says which it is."""
    messages, files = conversation_messages(spark, sf), None
    for k, fmt in enumerate(FORMATS):
        some = exported(messages.where(F.col("source") % len(FORMATS) == k), fmt)
        files = some if files is None else files.unionByName(some)
    rows = importing.messages_of(files, WHO)
    return rows.select(F.regexp_extract("file", "^[0-9]+", 0).cast("long").alias("source"), "format", "timestamp_ms", "role", "kind", F.sha1("text").alias("text_sha1"))


def q90_distinct_messages(spark, sf):
    """Two exports of the same chats, one of which ends early, as one relation."""
    messages = conversation_messages(spark, sf)
    early = exported(messages.where("seq < 3"), "canonical")
    files = exported(messages, "canonical").unionByName(early.withColumn("file", F.concat(F.lit("early-"), "file")))
    rows = importing.distinct_messages(importing.messages_of(files, WHO, "canonical"))
    return rows.groupBy("role", "kind").agg(F.count("*").alias("n"), F.sum("timestamp_ms").alias("sum_ms"), F.count_distinct("message_id").alias("n_ids"))


def q91_import_pairs(spark, sf):
    """Pairs that an import of all conversations stores."""
    done = importing.import_chats(exported(conversation_messages(spark, sf), "canonical"), WHO, name="canonical")
    return done["response_pairs"].select("id", F.size("user_message_ids").alias("n_user"), F.size("friend_message_ids").alias("n_friend"), "start_time_ms", "end_time_ms", "source")


SPEC = {"messages_path": "/log/messages", "sender_id": "by.id", "text": "/says", "timestamp": "at", "kind": "as"}


def q77_converted_json(spark, sf):
    """Conversations in a shape of their own, by a declared mapping."""
    line = F.to_json(F.struct(F.struct(F.col("role").alias("id")).alias("by"), F.col("text").alias("says"), (F.col("timestamp_ms") / 1000).cast("long").alias("at"), F.col("kind").alias("as")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), ",")
    files = conversation_messages(spark, sf).groupBy("source").agg(said.alias("said")).select(
        F.concat(F.col("source").cast("string"), F.lit(".json")).alias("file"), F.col("source").cast("string").alias("name"), F.lit(".json").alias("suffix"), F.concat(F.lit('{"log":{"messages":['), "said", F.lit("]}}")).alias("content"),
    )
    rows = conversion.converted_messages(files, SPEC, WHO)
    return rows.select(F.regexp_extract("file", "^[0-9]+", 0).cast("long").alias("source"), "seq", "message_id", "timestamp_ms", "role", "kind", F.sha1("text").alias("text_sha1"))


PATTERN = {"format": "text", "record_pattern": r"^<(?P<timestamp>\d+)\|(?P<sender_id>\w+)> (?P<text>.*)$"}


def q78_conversion_report(spark, sf):
    """What a pattern finds in conversations as text, and what it leaves over."""
    line = F.concat(F.lit("<"), F.col("timestamp_ms").cast("string"), F.lit("|"), "role", F.lit("> "), "text")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n")
    files = conversation_messages(spark, sf).groupBy("source").agg(said.alias("content")).select(F.col("source").cast("string").alias("file"), F.col("source").cast("string").alias("name"), F.lit(".txt").alias("suffix"), "content")
    rows = conversion.conversion_report(files, PATTERN)
    return rows.select(F.col("file").cast("long").alias("source"), "source_records", "converted_messages", "skipped_records", "unmatched_lines", "participants", F.col("error").isNull().alias("fine"))


HOLD_MS = 36 * 3_600_000


def _holds(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase holds its user's attention for a day and a half, each signup for thirty."""
    rows = event_messages(spark, sf).where("text in ('purchase', 'signup')")
    return rows.select("source", F.col("timestamp_ms").alias("from_ms"), (F.col("timestamp_ms") + F.when(F.col("text") == "signup", 20 * HOLD_MS).otherwise(HOLD_MS)).alias("to_ms"), F.col("seq").alias("holder"))


def q79_interval_lookup(spark, sf):
    """Every event with the first interval of its user that holds it."""
    points = event_messages(spark, sf).select("source", "seq", "timestamp_ms")
    rows = intervals.first_interval(points, _holds(spark, sf), "source", "seq", "timestamp_ms", "from_ms", "to_ms", ["from_ms", "holder"])
    return rows.select("source", "seq", "holder", (F.col("timestamp_ms") - F.col("from_ms")).alias("after_ms"))


def q80_interval_union(spark, sf):
    """The times at which anything holds, as disjoint intervals."""
    return intervals.merged_intervals(_holds(spark, sf), "source", "from_ms", "to_ms")


def q81_latest_by_key(spark, sf):
    """An append-only log of events as a table."""
    return relations.latest_by_key(table(spark, sf, "events"), "user_id", F.col("event_id"), "event_type")


def q82_remember(spark, sf):
    """Turns whose text a conversation's log doesn't hold, the log being the first half."""
    rows = conversation_messages(spark, sf).select(F.col("source").alias("conversation_id"), "seq", "text")
    log = rows.where("seq % 4 < 2").select("conversation_id", "text")
    return relations.remember(log, rows.select("conversation_id", "text")).groupBy("conversation_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


NOW_MS = 1704067200000 + 60 * 86_400_000


def _live(spark: SparkSession, sf: str) -> DataFrame:
    source = F.when(F.col("role") == "friend", "ai_generated").otherwise("user_new")
    return conversation_messages(spark, sf).select(F.col("message_id").alias("id"), "text", "role", F.col("source").cast("string").alias("conversation_id"), source.alias("source"), F.lit(True).alias("confirmed"), F.lit(0.65).alias("trust_level"), (F.col("seq") % 5 == 0).alias("deleted"), F.col("timestamp_ms").alias("created_at_ms"), F.array().cast("array<string>").alias("attachments"))


def q83_purge(spark, sf):
    """Tombstones on generated rows older than thirty days, by conversation."""
    rows = relations.purge(_live(spark, sf), NOW_MS, older_than_days=30)
    return rows.groupBy("conversation_id").agg(F.count("*").alias("n"), F.count_if("deleted").alias("n_deleted"))


def q84_append_live(spark, sf):
    """New rows with the defaults of live ones, in place of those of the same id."""
    rows = _live(spark, sf)
    new = rows.where(F.col("created_at_ms") % 7 == 0).select("id", F.concat(F.lit("new "), "text").alias("text"), "role", "conversation_id")
    out = relations.append_live(rows, new, NOW_MS)
    return out.select("id", F.sha1("text").alias("text_sha1"), "source", "trust_level", "deleted", "created_at_ms")


def q85_people(spark, sf):
    """Messages with names and roles of a dimension of people."""
    rows = conversation_messages(spark, sf).select("message_id", F.concat(F.lit("u-"), "role").alias("sender_uid"), F.lit("").alias("sender_name"), "kind")
    people = rows.select(F.col("sender_uid").alias("uid")).distinct().where("uid != 'u-system'").select("uid", F.when(F.col("uid") == "u-friend", "Ann").alias("name"), F.when(F.col("uid") == "u-friend", "friend").alias("role"))
    return relations.with_people(rows, people, own=["u-self"]).select("message_id", "sender_name", "role")


def q86_opening_quality(spark, sf):
    """Quality of each user's openings: metrics, issues and verdict; every third opening begins with a picture."""
    shown = F.when(F.col("session_no") % 3 == 0, F.concat(F.lit("[图片] "), "opening")).when(F.col("session_no") % 5 == 0, "[表情]").otherwise(F.col("opening"))
    rows = _openings(spark, sf).withColumn("opening", shown)
    out = profiles.opening_quality(rows.withColumn("opening_type", C.opening_type(F.col("opening"))))
    return out.withColumn("issues", F.array_join("issues", ",")).drop("placeholder_only")


def _event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.sessionize(event_messages(spark, sf), GAP)


def q87_scheduling_profile(spark, sf):
    """Hour weights of each user's scheduling profile, from messages."""
    rows = profiles.profile_of_messages(_event_sessions(spark, sf))
    return rows.select("source", "sample_size", "self_started_sessions", "total_sessions", F.posexplode("hour_weights").alias("hour", "weight")).withColumn("hour", F.col("hour").cast("long"))


def q88_windows_profile(spark, sf):
    """The same counts and the weights of gaps, rebuilt from stored windows that overlap."""
    sessions = _event_sessions(spark, sf)
    windows = sequence.window_chunks(sequence.sliding_windows(sessions, 4, 2))
    stored = windows.select("source", F.format_string("%06d", "session_no").alias("session_id"), "start_ms", "end_ms", "text")
    rows = profiles.profile_of_windows(stored, ["friend"], ["self"])
    return rows.select("source", "sample_size", "self_started_sessions", "total_sessions", F.explode("idle_gap_weights").alias("gap_bucket", "weight"))


def q92_next_schedule(spark, sf):
    """When each user is looked at next: an interval after the last event, out of quiet hours, in an hour of the profile."""
    rows = profiles.profile_of_messages(_event_sessions(spark, sf))
    last = event_messages(spark, sf).groupBy("source").agg(F.max("timestamp_ms").alias("now_ms"))
    earliest = profiles.earliest_schedule_ms(F.col("now_ms"), F.col("source") % 240, S.quiet_end_ms(F.col("now_ms"), 1380, 480))
    both = rows.join(last, "source").withColumn("earliest_ms", earliest)
    return both.select("source", "earliest_ms", profiles.next_profile_ms(F.col("earliest_ms"), F.col("hour_weights"), F.col("weekday_weights")).alias("next_ms"))


def q93_provenance(spark, sf):
    """What of the stored rows counts as evidence of style, and what for a running conversation."""
    rows = _live(spark, sf).withColumn("source", F.when(F.col("deleted"), "human_original").otherwise(F.col("source")))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(S.persona_eligible(F.col("source"))).alias("n_persona"), F.count_if(S.continuity_eligible(F.col("source"))).alias("n_continuity"))


LIMITS = summaries.SummaryLimits(trigger_messages=3, trigger_chars=400, keep_messages=2, recent_chars=600, batch_chars=500, max_chars=5000)


def q89_summary_batches(spark, sf):
    """What an incremental summary would be told of each conversation: its batches, messages, pieces and symbols."""
    rows = conversation_messages(spark, sf).select(F.col("source").alias("conversation_id"), "seq", F.when(F.col("role") == "friend", "assistant").when(F.col("role") == "self", "user").otherwise("system").alias("role"), F.col("text").alias("content"))
    none = spark.createDataFrame([], "conversation_id long, version int, covered long, prefix_digest string, summary string")
    history = summaries.prefixes(rows)
    heads = summaries.summary_heads(history, none, LIMITS)
    told = summaries.summary_batches(history, heads, LIMITS)
    one = told.groupBy("conversation_id").agg(F.count("*").alias("n_pieces"), F.count_distinct("place").alias("n_told"), F.sum(F.length("content")).alias("n_chars"))
    return heads.join(one, "conversation_id", "left").select("conversation_id", "n", "split", F.coalesce("n_told", F.lit(0)).alias("n_told"), F.coalesce("n_pieces", F.lit(0)).alias("n_pieces"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


QUERIES = {f"q{68 + k}_read_{fmt}": _reader(fmt) for k, fmt in enumerate(FORMATS)} | {
    f.__name__: f for f in (q76_any_export, q77_converted_json, q78_conversion_report, q79_interval_lookup, q80_interval_union, q81_latest_by_key, q82_remember, q83_purge, q84_append_live, q85_people, q86_opening_quality, q87_scheduling_profile, q88_windows_profile, q89_summary_batches, q90_distinct_messages, q91_import_pairs, q92_next_schedule, q93_provenance)
}

# twins -------------------------------------------------------------------------------------------

_CONV = """SELECT conv_id || '-' || turn AS message_id, conv_id AS source, turn AS seq, 1704067200000 + conv_id * 86400000 + turn * 60000 AS timestamp_ms,
  CASE role WHEN 'user' THEN 'self' WHEN 'assistant' THEN 'friend' WHEN 'system' THEN 'system' ELSE 'other' END AS role, CASE role WHEN 'system' THEN 'system' ELSE 'text' END AS kind, text FROM conversations"""
_POS = "row_number() OVER (PARTITION BY source ORDER BY timestamp_ms, seq) - 1"
_ROWS = "source, {seq} AS seq, timestamp_ms, {role} AS role, {kind} AS kind, sha1(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS text_sha1, 0 AS n_placeholders"


def _read_twin(seq: str = _POS, role: str = "role", kind: str = "kind", where: str = "true") -> str:
    return f"SELECT {_ROWS.format(seq=seq, role=role, kind=kind)} FROM (SELECT * FROM ({_CONV}) WHERE {where})"


_OTHER = "CASE role WHEN 'system' THEN 'other' ELSE role END"
_TWIN = {
    "canonical": _read_twin(), "qq": _read_twin(), "weflow": _read_twin(), "weflow_chatlab": _read_twin(), "douyin": _read_twin(role=_OTHER, kind="'text'"), "discord": _read_twin(), "telegram": _read_twin(), "whatsapp": _read_twin(where="role <> 'system'"),
}
_EVENTS = """SELECT user_id AS source, event_id AS seq, epoch_us(ts) // 1000 AS timestamp_ms, event_type AS text FROM events"""
_HOLDS = f"""SELECT source, timestamp_ms AS from_ms, timestamp_ms + CASE text WHEN 'signup' THEN {20 * HOLD_MS} ELSE {HOLD_MS} END AS to_ms, seq AS holder FROM ({_EVENTS}) WHERE text IN ('purchase', 'signup')"""
_LIVE = f"""SELECT message_id AS id, text, role, source::VARCHAR AS conversation_id, CASE role WHEN 'friend' THEN 'ai_generated' ELSE 'user_new' END AS source, 0.65::DOUBLE AS trust_level, seq % 5 = 0 AS deleted, timestamp_ms AS created_at_ms FROM ({_CONV})"""

SQL = {f"q{68 + k}_read_{fmt}": _TWIN[fmt] for k, fmt in enumerate(FORMATS)} | {
    "q76_any_export": f"""SELECT source, {str(list(FORMATS))}[source % {len(FORMATS)} + 1] AS format, timestamp_ms, CASE WHEN source % {len(FORMATS)} = {FORMATS.index("douyin")} THEN {_OTHER} ELSE role END AS role,
      CASE WHEN source % {len(FORMATS)} = {FORMATS.index("douyin")} THEN 'text' ELSE kind END AS kind, sha1(text) AS text_sha1 FROM ({_CONV}) WHERE source % {len(FORMATS)} <> {FORMATS.index("whatsapp")} OR role <> 'system'""",
    "q77_converted_json": f"""SELECT source, seq, 'ai-' || substr(sha256('[' || to_json(role) || ',' || timestamp_ms || ',' || to_json(text) || ']'), 1, 32) AS message_id, timestamp_ms, role, kind, sha1(text) AS text_sha1
      FROM (SELECT *, count(DISTINCT role) OVER (PARTITION BY source) AS n FROM ({_CONV})) WHERE n >= 2""",
    "q78_conversion_report": f"""SELECT source, count(*) AS source_records, count(*) AS converted_messages, 0 AS skipped_records, sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))- 1)::BIGINT AS unmatched_lines, count(DISTINCT role) AS participants,
      count(DISTINCT role) >= 2 AS fine FROM ({_CONV}) GROUP BY source""",
    "q79_interval_lookup": f"""SELECT source, seq, holder, timestamp_ms - from_ms AS after_ms FROM (SELECT e.source, e.seq, e.timestamp_ms, h.holder, h.from_ms, row_number() OVER (PARTITION BY e.seq ORDER BY h.from_ms, h.holder) AS n
      FROM ({_EVENTS}) e LEFT JOIN ({_HOLDS}) h ON e.source = h.source AND e.timestamp_ms BETWEEN h.from_ms AND h.to_ms) WHERE n = 1""",
    "q80_interval_union": f"""SELECT source, min(from_ms) AS from_ms, max(to_ms) AS to_ms, count(*) AS n_merged FROM (SELECT *, sum(b) OVER (PARTITION BY source ORDER BY from_ms, to_ms ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN from_ms <= max(to_ms) OVER (PARTITION BY source ORDER BY from_ms, to_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM ({_HOLDS}))) GROUP BY source, g""",
    "q81_latest_by_key": "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY user_id",
    "q82_remember": f"""SELECT conversation_id, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM (SELECT source AS conversation_id, text FROM ({_CONV}) WHERE seq % 4 < 2
      UNION ALL (SELECT DISTINCT source, text FROM ({_CONV}) c WHERE NOT EXISTS (SELECT 1 FROM ({_CONV}) l WHERE l.seq % 4 < 2 AND l.source = c.source AND l.text IS NOT DISTINCT FROM c.text))) GROUP BY conversation_id""",
    "q83_purge": f"SELECT conversation_id, count(*) AS n, count(*) FILTER (deleted OR (source = 'ai_generated' AND created_at_ms < {NOW_MS - 30 * 86_400_000})) AS n_deleted FROM ({_LIVE}) GROUP BY conversation_id",
    "q84_append_live": f"""SELECT id, sha1(CASE WHEN m THEN 'new ' || text ELSE text END) AS text_sha1, CASE WHEN m THEN 'live' ELSE source END AS source, CASE WHEN m THEN 0.35 ELSE trust_level END::DOUBLE AS trust_level, NOT m AND deleted AS deleted, CASE WHEN m THEN {NOW_MS} ELSE created_at_ms END AS created_at_ms
      FROM (SELECT *, created_at_ms % 7 = 0 AS m FROM ({_LIVE}))""",
    "q85_people": f"""SELECT message_id, CASE role WHEN 'friend' THEN 'Ann' ELSE 'u-' || role END AS sender_name, CASE WHEN kind = 'system' THEN 'system' WHEN role IN ('friend', 'self') THEN role ELSE 'other' END AS role FROM ({_CONV})""",
    "q86_opening_quality": f"""WITH {GAPS}, a AS (SELECT source, initiator, gap_minutes, CASE WHEN session_no % 3 = 0 THEN '[图片] ' || opening WHEN session_no % 5 = 0 THEN '[表情]' ELSE opening END AS opening FROM opens),
      b AS (SELECT *, trim(regexp_replace(opening, '\\[(?:图片|表情|动画表情|语音|视频|文件|撤回)\\]', ' ', 'g')) AS bare, {_opening_sql("trim(opening)", False)} AS t, initiator = 'friend' AND coalesce(gap_minutes >= 120, false) AS e FROM a),
      c AS (SELECT *, len(regexp_extract_all(bare, '[A-Za-z0-9一-鿿]')) AS symbols FROM b),
      d AS (SELECT source, count(*) AS total_openings, count(*) FILTER (e) AS eligible, count(*) FILTER (e AND symbols > 0) AS meaningful, count(*) FILTER (e AND symbols > 0 AND (t IN ('care', 'continue_topic', 'self_share', 'question_probe') OR symbols >= 8)) AS specific,
        count(*) FILTER (e AND opening <> bare) AS placeholder, count(*) FILTER (e AND t = 'other') AS x FROM c GROUP BY source),
      f AS (SELECT * EXCLUDE (x), CASE WHEN eligible > 0 THEN round(meaningful / eligible, 4) ELSE 0.0 END AS meaningful_ratio, CASE WHEN eligible > 0 THEN round(specific / eligible, 4) ELSE 0.0 END AS specific_ratio, CASE WHEN eligible > 0 THEN round(placeholder / eligible, 4) ELSE 0.0 END AS placeholder_ratio,
        CASE WHEN eligible > 0 THEN round(x / eligible, 4) ELSE 0.0 END AS other_ratio, 0.0::DOUBLE AS attribution_ratio FROM d),
      g AS (SELECT *, concat_ws(',', CASE WHEN eligible < 12 THEN 'too_few' WHEN eligible < 30 THEN 'few' END, CASE WHEN meaningful_ratio < 0.45 THEN 'meaningless' WHEN meaningful_ratio < 0.7 THEN 'low_information' END, CASE WHEN placeholder_ratio > 0.35 THEN 'placeholders' END,
        CASE WHEN specific_ratio < 0.3 THEN 'unspecific' END, CASE WHEN other_ratio > 0.6 THEN 'unclassified' END) AS issues FROM f)
      SELECT *, CASE WHEN specific_ratio < 0.3 OR meaningful_ratio < 0.7 THEN 'high' WHEN placeholder_ratio > 0.2 OR other_ratio > 0.5 THEN 'medium' ELSE 'low' END AS fallback_risk, CASE WHEN eligible < 12 OR meaningful_ratio < 0.45 THEN 'not_ready' WHEN issues <> '' THEN 'limited' ELSE 'ready' END AS status FROM g""",
    "q87_scheduling_profile": f"""WITH {GAPS}, o AS (SELECT * FROM opens WHERE gap_minutes >= 120), c AS (SELECT source, hour(make_timestamp(opened_ms * 1000)) AS hour, count(*) AS n FROM o WHERE initiator = 'friend' GROUP BY ALL),
      p AS (SELECT source, max(n) AS peak, sum(n)::BIGINT AS sample_size FROM c GROUP BY source), s AS (SELECT source, count(*) AS total_sessions FROM opens GROUP BY source), w AS (SELECT source, count(*) FILTER (initiator = 'self') AS own FROM o GROUP BY source)
      SELECT s.source, coalesce(sample_size, 0) AS sample_size, coalesce(own, 0) AS self_started_sessions, total_sessions, h.hour, CASE WHEN peak IS NULL THEN 0.0 ELSE round((coalesce(n, 0) + 1) / (peak + 1), 3) END AS weight
      FROM s CROSS JOIN (SELECT unnest(range(24)) AS hour) h LEFT JOIN p USING (source) LEFT JOIN w USING (source) LEFT JOIN c ON c.source = s.source AND c.hour = h.hour""",
    "q88_windows_profile": f"""WITH {GAPS}, o AS (SELECT * FROM opens WHERE gap_minutes >= 120), c AS (SELECT source, gap_bucket, count(*) AS n FROM o WHERE initiator = 'friend' GROUP BY ALL),
      p AS (SELECT source, max(n) AS peak, sum(n)::BIGINT AS sample_size FROM c GROUP BY source), s AS (SELECT source, count(*) AS total_sessions FROM opens GROUP BY source), w AS (SELECT source, count(*) FILTER (initiator = 'self') AS own FROM o GROUP BY source)
      SELECT s.source, coalesce(sample_size, 0) AS sample_size, coalesce(own, 0) AS self_started_sessions, total_sessions, b.gap_bucket, CASE WHEN peak IS NULL THEN 0.0 ELSE round((coalesce(n, 0) + 1) / (peak + 1), 3) END AS weight
      FROM s CROSS JOIN (SELECT unnest({list(profiles.BUCKETS)}) AS gap_bucket) b LEFT JOIN p USING (source) LEFT JOIN w USING (source) LEFT JOIN c ON c.source = s.source AND c.gap_bucket = b.gap_bucket""",
    "q89_summary_batches": f"""WITH h AS (SELECT source, role, length(text) AS chars, row_number() OVER (PARTITION BY source ORDER BY seq) AS place, row_number() OVER (PARTITION BY source ORDER BY seq DESC) AS back, sum(length(text)) OVER (PARTITION BY source ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS upto
        FROM ({_CONV}) WHERE role IN ('self', 'friend')),
      k AS (SELECT source, count(*) AS n, sum(chars) AS total, min(CASE WHEN back <= 2 AND upto <= 600 AND role = 'self' THEN place END) AS first FROM h GROUP BY source),
      t AS (SELECT source, n, CASE WHEN n <= 3 AND total <= 400 THEN 0 ELSE coalesce(first - 1, n) END AS split FROM k)
      SELECT t.source AS conversation_id, n, split, count(place) AS n_told, coalesce(sum(CASE WHEN place IS NOT NULL THEN greatest(1, ceil(chars / 500.0)) END), 0)::BIGINT AS n_pieces, coalesce(sum(chars), 0)::BIGINT AS n_chars FROM t LEFT JOIN h ON h.source = t.source AND h.place <= t.split GROUP BY ALL""",
    "q90_distinct_messages": f"SELECT role, kind, count(*) AS n, sum(timestamp_ms)::BIGINT AS sum_ms, count(DISTINCT message_id) AS n_ids FROM ({_CONV}) GROUP BY ALL",
    "q91_import_pairs": f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY timestamp_ms, seq) - 1 AS place FROM ({_CONV})),
      r AS (SELECT *, sum(b) OVER (PARTITION BY source ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN role = 'self' AND lag(role) OVER (PARTITION BY source ORDER BY place) IS DISTINCT FROM 'self' THEN 1 ELSE 0 END AS b FROM m)),
      k AS (SELECT *, CASE WHEN role = 'friend' THEN row_number() OVER (PARTITION BY source, run, role ORDER BY place) END AS k FROM r WHERE run > 0 AND role IN ('self', 'friend')),
      p AS (SELECT *, message_id || '|' || place || '|' || timestamp_ms || '|' || role AS identity FROM k WHERE role = 'self' OR k <= 4)
      SELECT 'pair-' || substr(sha1(string_agg(CASE role WHEN 'self' THEN 'u:' ELSE 'f:' END || identity, '|' ORDER BY role = 'friend', place)), 1, 16) AS id, count(*) FILTER (role = 'self') AS n_user, count(*) FILTER (role = 'friend') AS n_friend,
        min(timestamp_ms) AS start_time_ms, max(timestamp_ms) FILTER (role = 'friend') AS end_time_ms, 'human_original' AS source FROM p GROUP BY p.source, run HAVING count(*) FILTER (role = 'friend') > 0 AND count(*) FILTER (role = 'self') > 0""",
    "q92_next_schedule": f"""WITH {GAPS}, o AS (SELECT source, hour(make_timestamp(opened_ms * 1000)) AS h, isodow(make_timestamp(opened_ms * 1000)) - 1 AS d FROM opens WHERE gap_minutes >= 120 AND initiator = 'friend'),
      hc AS (SELECT source, h, count(*) AS n FROM o GROUP BY ALL), hp AS (SELECT source, max(n) AS peak FROM hc GROUP BY source), dp AS (SELECT source, d FROM o GROUP BY ALL),
      hw AS (SELECT hp.source, x.h, round((coalesce(n, 0) + 1) / (peak + 1), 3) AS w FROM hp CROSS JOIN (SELECT unnest(range(24)) AS h) x LEFT JOIN hc ON hc.source = hp.source AND hc.h = x.h),
      l AS (SELECT source, max(timestamp_ms) AS now_ms FROM ev GROUP BY source),
      q AS (SELECT source, now_ms, (now_ms // 60000) % 1440 AS m, (now_ms // 86400000) * 86400000 + 480 * 60000 AS c FROM l),
      e AS (SELECT source, greatest(now_ms + greatest(600, CASE WHEN source % 240 < 120 THEN (120 - source % 240) * 60 ELSE 600 END) * 1000, CASE WHEN m >= 1380 OR m < 480 THEN CASE WHEN c <= now_ms THEN c + 86400000 ELSE c END ELSE now_ms END)::BIGINT AS earliest_ms FROM q),
      t AS (SELECT e.source, e.earliest_ms, unnest(range(144)) AS k FROM e),
      f AS (SELECT t.source, min(t.earliest_ms + k * 900000) AS next_ms FROM t JOIN (SELECT source, h, w, max(w) OVER (PARTITION BY source) AS top FROM hw) y ON y.source = t.source AND y.h = hour(make_timestamp((t.earliest_ms + k * 900000) * 1000)) WHERE y.w >= greatest(0.45, 0.75 * y.top) GROUP BY t.source)
      SELECT e.source, e.earliest_ms, coalesce(f.next_ms, e.earliest_ms) AS next_ms FROM e LEFT JOIN f USING (source)""",
    "q93_provenance": f"""SELECT source, count(*) AS n, count(*) FILTER (source IN ('human_original', 'history')) AS n_persona, count(*) FILTER (source IN ('user_new', 'ai_generated', 'live')) AS n_continuity
      FROM (SELECT CASE WHEN deleted THEN 'human_original' ELSE source END AS source FROM ({_LIVE})) GROUP BY source""",
}
