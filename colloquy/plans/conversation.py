"""Queries over messages: sessions, windows, turns, pairs and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import lexicons as L
from ..functions import scalars as S
from ..operators import folds, relations, sequence, stats
from ..sources.tables import ENDINGS, chat_messages, conversation_messages, event_messages, table
from .retrieval import LOW_SQL, SHOWN_SQL, W, private_sql

GAP = 180  # minutes; the events' gaps are long
CONV = """conv AS (SELECT conv_id || '-' || turn AS message_id, conv_id AS source, turn AS seq, 1704067200000 + conv_id * 86400000 + turn * 60000 AS timestamp_ms,
  CASE role WHEN 'user' THEN 'self' WHEN 'assistant' THEN 'friend' WHEN 'system' THEN 'system' ELSE 'other' END AS role,
  CASE role WHEN 'system' THEN 'system' ELSE 'text' END AS kind, text FROM conversations)"""
EV = """ev AS (SELECT event_id::VARCHAR AS message_id, user_id AS source, event_id AS seq, epoch_us(ts) // 1000 AS timestamp_ms,
  CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'friend' ELSE 'self' END AS role, 'text' AS kind, event_type AS text FROM events)"""
SES = f"""{EV}, ses AS (SELECT *, (sum(b) OVER (PARTITION BY source ORDER BY timestamp_ms, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS session_no FROM (
  SELECT *, CASE WHEN timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY source ORDER BY timestamp_ms, seq) > {GAP} * 60000 THEN 1 ELSE 0 END AS b FROM ev))"""
SUM = f"""{SES}, summ AS (SELECT source, session_no, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms, count(*) AS n_messages,
  count(*) FILTER (role = 'friend') AS n_friend, count(*) FILTER (role = 'self') AS n_self, arg_min(message_id, (timestamp_ms, seq)) AS first_id FROM ses GROUP BY ALL)"""


def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


CHAT = f"""{CONV}, chat AS (SELECT CASE alone WHEN 1 THEN message_id || '-end' ELSE message_id END AS message_id, source, seq * 2 + alone AS seq, timestamp_ms + alone * 30000 AS timestamp_ms, role, sender_uid, n, CASE WHEN kind = 'system' THEN 'system' WHEN n = 1 THEN 'recalled' WHEN n = 2 THEN 'placeholder' WHEN n = 0 THEN 'unknown' ELSE 'text' END AS kind,
  CASE WHEN alone = 1 THEN e ELSE trim(CASE WHEN text IS NULL THEN e ELSE text || ' ' || e END) END AS text, CASE n WHEN 2 THEN '[图片]' WHEN 0 THEN '[语音]' ELSE '' END AS placeholder, CASE n WHEN 20 THEN 'discord_default' WHEN 0 THEN '' ELSE 'type_1' END AS raw_type
  FROM (SELECT *, {_list(ENDINGS)}[n + 1] AS e, 'u-' || role AS sender_uid, unnest(CASE WHEN n % 3 = 0 THEN [0, 1] ELSE [0] END) AS alone FROM (SELECT *, (source * 7 + seq * 5) % {len(ENDINGS)} AS n FROM conv)))"""


def _icase(pattern: str) -> str:
    return "(?i)" + pattern.replace("'", "''")


OWN, OTHER = ["Alex", "Al"], ["Sam"]


def _sessions(spark, sf):
    return sequence.sessionize(event_messages(spark, sf), GAP)


def _conv(spark, sf):
    return conversation_messages(spark, sf).withColumn("session_no", F.lit(0).cast("long"))


def q01_normalize_messages(spark, sf):
    """Messages cleaned in the fixed order of steps."""
    m = chat_messages(spark, sf)
    clean = C.clean_message(F.col("text"), F.col("kind"), F.col("raw_type"), F.col("placeholders"), OWN, OTHER)
    return m.select("message_id", "source", "seq", "timestamp_ms", "role", "kind", clean.alias("clean_text"))


def q02_sessionize(spark, sf):
    return sequence.session_summary(_sessions(spark, sf)).select("source", "session_no", "start_ms", "end_ms", "n_messages", "n_friend", "n_self", "duration_ms")


def q03_session_ids(spark, sf):
    return sequence.session_summary(_sessions(spark, sf)).select("source", "session_no", "session_id")


def q04_sliding_windows(spark, sf):
    w = sequence.sliding_windows(_conv(spark, sf), 4, 1)
    item = F.struct("place", F.concat("role", F.lit(": "), "text").alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n")
    return w.groupBy("source", "window_no").agg(F.count("*").alias("message_count"), F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.sha1(lines).alias("text_sha1")).withColumn("window_no", F.col("window_no").cast("long"))


def q05_turns(spark, sf):
    t = sequence.turns(_sessions(spark, sf))
    return t.groupBy("source", "session_no", "turn_no").agg(F.first("role").alias("role"), F.count("*").alias("n_messages"), F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"))


def q06_context_frames(spark, sf):
    c = sequence.context_frames(_conv(spark, sf), 6, 2)
    return c.where("role = 'friend'").select("message_id", F.sha1("context_before").alias("before_sha1"), F.sha1("context_after").alias("after_sha1"))


def q07_response_pairs(spark, sf):
    p = sequence.response_pairs(_sessions(spark, sf), 4)
    return p.select("source", "session_no", F.sha1("user_text").alias("user_sha1"), "friend_reply", "n_user", "n_reply", "start_time_ms", "end_time_ms")


def q08_adjacent_pairs(spark, sf):
    return sequence.adjacent_pairs(_conv(spark, sf)).select("source", "seq", F.sha1("user_text").alias("user_sha1"), F.sha1("reply").alias("reply_sha1"))


def q09_length_stats(spark, sf):
    return stats.length_stats(conversation_messages(spark, sf), "role").select("role", "n", *[F.round(c, 6).alias(c) for c in ("mean_chars", "median_chars", "share_short", "share_long")])


def q10_punctuation_stats(spark, sf):
    p = stats.punctuation_stats(conversation_messages(spark, sf), "role")
    return p.select("role", "n_marks", *[F.round(c, 6).alias(c) for c in ("share_with", "share_ending", "share_asking", "share_exclaiming")])


def _spoken(spark, sf):
    return chat_messages(spark, sf).where((F.col("role") == "friend") & C.persona_useful(F.col("kind"), F.col("text")))


def q11_top_phrases(spark, sf):
    return stats.top_phrases(_spoken(spark, sf), L.STOPWORDS, 30)


def q12_top_terms(spark, sf):
    return stats.top_terms(_spoken(spark, sf), L.STOPWORDS, 60)


def q13_lexicon_score(spark, sf):
    return chat_messages(spark, sf).select("message_id", C.warmth(F.col("text")).alias("warmth"))


def q14_hourly_profile(spark, sf):
    m = event_messages(spark, sf).where("role = 'friend'")
    return stats.hourly_profile(m, F.hour(F.timestamp_millis("timestamp_ms"))).select(F.col("hour").cast("long").alias("hour"), "n", "level")


def q15_awake_range(spark, sf):
    m = event_messages(spark, sf).where("role = 'friend'")
    return stats.awake_range(stats.hourly_profile(m, F.hour(F.timestamp_millis("timestamp_ms")), "source"), "source", 0.5)


def q16_idle_gaps(spark, sf):
    g = sequence.idle_gaps(sequence.session_summary(_sessions(spark, sf)))
    return g.select("source", "session_no", "gap_minutes", "gap_bucket")


def _openings(spark, sf):
    return sequence.session_openings(_sessions(spark, sf))


def q17_opening_stats(spark, sf):
    at = F.timestamp_millis("opened_ms")
    friend = F.col("initiator") == "friend"
    return _openings(spark, sf).groupBy("source").agg(
        F.count_if(friend).alias("n_friend"), F.count_if(~friend).alias("n_self"), F.countDistinct(F.when(friend, F.to_date(at))).alias("active_days"),
        F.median(F.when(friend, F.col("gap_minutes"))).alias("median_gap"), F.round(F.count_if(friend) / F.count("*"), 4).alias("initiative_rate"),
    )


def q18_smoothed_weights(spark, sf):
    counts = _openings(spark, sf).where("initiator = 'friend' and gap_minutes >= 120").groupBy("gap_bucket").agg(F.count("*").alias("n"))
    domain = spark.createDataFrame([(x,) for x in ("short", "one_to_three_hours", "three_to_eight_hours", "overnight", "multi_day")], "gap_bucket string")
    return stats.smoothed_weights(domain.join(counts, "gap_bucket", "left").withColumn("n", F.coalesce("n", F.lit(0))), "gap_bucket")


def q19_quality_gate(spark, sf):
    eligible = (F.col("initiator") == "friend") & (F.col("gap_minutes") >= 120)
    g = _openings(spark, sf).groupBy("source").agg(F.count_if(eligible).alias("n_eligible"), F.count_if(eligible & (F.length("opening") >= 5)).alias("n_meaningful"))
    share = F.when(F.col("n_eligible") > 0, F.col("n_meaningful") / F.col("n_eligible")).otherwise(0.0)
    verdict = F.when((F.col("n_eligible") < 12) | (share < 0.45), "critical").when((F.col("n_eligible") < 30) | (share < 0.7), "warning").otherwise("good")
    return g.select("source", "n_eligible", "n_meaningful", verdict.alias("verdict"))


def q20_latency_stats(spark, sf):
    e = table(spark, sf, "events")
    return stats.latency_stats(e, "event_type", "value", F.col("event_type") == "error")


def q40_pack_blocks(spark, sf):
    return folds.pack_blocks(conversation_messages(spark, sf), 1000).drop("block_id")


def q41_tail_budget(spark, sf):
    return sequence.tail_budget(conversation_messages(spark, sf), 4, 900).select("message_id", "source", "seq")


def q43_recent_per_key(spark, sf):
    return relations.recent_per_key(event_messages(spark, sf), "source", ["timestamp_ms", "seq"], 20).select("source", "message_id", F.col("recent_rank").cast("long").alias("recent_rank"))


def q46_adaptive_segments(spark, sf):
    t = sequence.turns(sequence.sessionize(event_messages(spark, sf), 24 * 60))
    t = t.groupBy("source", "session_no", "turn_no").agg(F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), F.sum(F.length("text")).alias("chars"))
    return folds.adaptive_segments(t.withColumn("session_key", F.concat_ws("-", "source", "session_no")), 40, 80, 3, 120)


def q47_opening_classes(spark, sf):
    """Class of the first usable message of each conversation, as written at half past twelve and at midnight."""
    o = sequence.human_ends(chat_messages(spark, sf).withColumn("session_no", F.lit(0)), C.usable_text(F.col("text")))
    return o.select("source", F.col("first_role").alias("initiator"), C.opening_type(F.col("first_text"), F.lit(12)).alias("by_day"), C.opening_type(F.col("first_text"), F.lit(0)).alias("by_night"))


def _replies(spark, sf):
    pairs = sequence.adjacent_pairs(chat_messages(spark, sf).where("kind != 'recalled'").withColumn("session_no", F.lit(0)))
    return pairs.where((C.shown_text(F.col("user_text")) != "") & C.usable_text(F.col("reply")))


def q48_scene_profile(spark, sf):
    return stats.reply_profile(_replies(spark, sf).withColumn("scene", C.scene(C.shown_text(F.col("user_text")))), "scene")


def q52_predicates(spark, sf):
    """The predicates of messages, side by side."""
    kind, text = F.col("kind"), F.col("text")
    return chat_messages(spark, sf).select("message_id", C.chunkable(kind, text).alias("chunkable"), C.persona_useful(kind, text).alias("useful"), C.usable_text(text).alias("usable"), C.low_signal(text).alias("low"), C.echoes(F.lit("在干什么？"), F.regexp_replace(text, "@Sam", "")).alias("echo"), C.is_burst(text).alias("burst"), C.burst_probability(text, F.lit(True)).alias("p_burst"))


def q53_marks_and_media(spark, sf):
    m = _spoken(spark, sf)
    shares = stats.mark_shares(m, "role").join(stats.media_stats(m, "role"), "role")
    return shares


def q54_top_marks(spark, sf):
    return stats.mark_counts(_spoken(spark, sf))


def q55_circadian(spark, sf):
    at = F.col("timestamp_ms")
    c = stats.circadian(event_messages(spark, sf), S.local_hour(at), S.local_weekday(at), "source", 20)
    text = lambda name: F.array_join(F.transform(name, lambda x: F.format_number(x, 3)), " ").alias(name)
    return c.select("source", "n", text("hours"), text("weekdays"), text("weekends"), "night_share", S.night_band(F.col("night_share")).alias("band"))


def q56_opening_report(spark, sf):
    o = _openings(spark, sf)
    r = stats.opening_report(o, F.timestamp_millis("opened_ms"), F.col("opening"))
    text = lambda name: F.array_join(F.transform(name, lambda x: F.concat_ws("=", x["value"], x["n"])), " ").alias(name)
    return r.select("source", "n", "active_days", "span_days", "median_gap", "per_30_days", *map(text, ("hours", "weekdays", "months", "kinds")))


def q57_budget_context(spark, sf):
    c = sequence.budget_context(_conv(spark, sf), 400)
    return c.where("role = 'friend'").select("message_id", F.sha1("context_before").alias("before_sha1"), F.sha1("context_after").alias("after_sha1"))


def q58_opening_runs(spark, sf):
    o = sequence.opening_runs(chat_messages(spark, sf).withColumn("session_no", F.lit(0).cast("long")))
    return o.select("source", "initiator", "opened_ms", F.sha1("opening").alias("opening_sha1"), "n_opening", "response")


def q59_previous_tail(spark, sf):
    return sequence.previous_tail(_sessions(spark, sf)).select("source", "session_no", "gap_minutes", F.sha1("previous_tail").alias("tail_sha1"))


def q60_even_sample(spark, sf):
    return sequence.even_sample(event_messages(spark, sf), 7, ["source"], ["timestamp_ms", "seq"]).select("source", "message_id")


def q61_length_quota(spark, sf):
    m = conversation_messages(spark, sf).where("role != 'system'")
    return sequence.length_quota_sample(m, 30, F.length("text"), "role", ["timestamp_ms", "seq"], bounds=(120, 200)).select("role", "message_id")


def q62_occurrence(spark, sf):
    d = table(spark, sf, "documents").withColumn("_h", F.sha2(F.coalesce("text", F.lit("")), 256))
    return sequence.occurrence(d, ["_h"], ["doc_id"]).select("doc_id", F.col("occurrence").cast("long").alias("occurrence"))


def q63_window_chunks(spark, sf):
    w = sequence.window_chunks(sequence.sliding_windows(chat_messages(spark, sf).withColumn("session_no", F.lit(0)), 4, 1))
    return w.select("source", F.col("window_no").cast("long").alias("window_no"), "chunk_id", "message_count", F.sha1("text").alias("text_sha1"))


def q64_turn_batches(spark, sf):
    t = sequence.turns(_sessions(spark, sf)).groupBy("source", "session_no", "turn_no").agg(F.count("*").alias("n_messages"))
    return folds.turn_batches(t.withColumn("session_key", F.concat_ws("-", "source", "session_no")), 3).select("session_key", "turn_no", "batch_no")


def q65_summary_modes(spark, sf):
    o = _openings(spark, sf)
    return stats.summary_modes(o, F.hour(F.timestamp_millis("opened_ms")), F.col("gap_bucket"), F.col("opening"))


def q66_quiet_and_night(spark, sf):
    at = F.col("timestamp_ms")
    minute, hour = S.minute_of_day(at), S.local_hour(at)
    return event_messages(spark, sf).select(
        "message_id", S.quiet(minute, 1380, 480).alias("quiet"), S.quiet_end_ms(at, 1380, 480).alias("ends_ms"), S.time_slot(hour).alias("slot"), S.default_update_ms(at, F.lit("idle")).alias("next_ms"),
        S.night_hour(hour, F.lit(9), F.lit(1), F.lit(40)).alias("night"),
    )


def q67_delays_and_scores(spark, sf):
    e = table(spark, sf, "events")
    x = F.col("value") / 100
    score = S.feature_score({"time_match": x, "idle_gap_match": 1 - x, "evidence": x * 2})
    state = F.when(F.col("event_type") == "view", "sleeping").when(F.col("event_type") == "click", "busy")
    delay = S.reply_delay(F.col("event_type") != "error", F.floor("value").cast("int"), F.lit(12), state, 20, 60)
    return e.select("event_id", F.round(score, 6).alias("score"), S.availability_weight(state).alias("availability"), delay.alias("delay"))


def q49_night_share(spark, sf):
    h = F.hour(F.timestamp_millis("timestamp_ms"))
    day = F.weekday(F.timestamp_millis("timestamp_ms"))
    return event_messages(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.count_if((h >= 22) | (h < 6)).alias("n_night"), F.count_if(day >= 5).alias("n_weekend"))


def q44_next_profile_time(spark, sf):
    """First 15-minute step outside quiet hours, within 36 hours, in an hour as busy as 0.45 and 3/4 of the peak."""
    m = event_messages(spark, sf).where("role = 'friend'")
    profile = stats.hourly_profile(m, F.hour(F.timestamp_millis("timestamp_ms")), "source")
    busy = profile.withColumn("_p", F.max("level").over(Window.partitionBy("source"))).where(F.col("level") >= F.greatest(F.lit(0.45), 0.75 * F.col("_p"))).select("source", "hour")
    last = m.groupBy("source").agg(F.max("timestamp_ms").alias("last_ms"))
    step = 15 * 60_000
    start = (F.floor(F.col("last_ms") / step) + 1) * step
    steps = last.select("source", F.explode(F.sequence(start, start + 36 * 3_600_000, F.lit(step).cast("long"))).alias("next_ms"))
    minute = F.floor(F.col("next_ms") / 60_000) % 1440
    return steps.where(minute >= 510).withColumn("hour", F.hour(F.timestamp_millis("next_ms"))).join(busy, ["source", "hour"]).groupBy("source").agg(F.min("next_ms").alias("next_ms"))


def _bracket_sql(text: str, pattern: str) -> str:
    """SQL of bracketed matches as faces, but for the reserved tokens."""
    kept = _list([f"[{x}]" for x in L.RESERVED_TOKENS])
    parts, found = f"regexp_split_to_array({text}, '{pattern}')", f"regexp_extract_all({text}, '{pattern}')"
    return f"(SELECT array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(r[i], '')), '') FROM (SELECT g, list_transform(f, lambda m: CASE WHEN list_contains({kept}, m) THEN m ELSE '[表情]' END) AS r FROM (SELECT {parts} AS g, {found} AS f)))"


def _clean_sql() -> str:
    t = f"regexp_replace(coalesce(text, ''), '{C.CONTROL}', '', 'g')"
    media = rf"regexp_replace({t}, '\[({'|'.join(L.NAMED_MEDIA)})[:：][^\]]+\]', '[\1]', 'g')"
    faces = rf"regexp_replace(regexp_replace({media}, '\[/[^\]\n]{{1,16}}\]', '[表情]', 'g'), '\[\[[^\]\n]{{1,32}}\]\]', '[表情]', 'g')"
    short = _bracket_sql("b", r"\[[^\[\]\n]{1,12}\]")
    named = "regexp_replace(regexp_replace(t, '@(?:Alex|Al)', '@你', 'g'), '@(?:Sam)', '@我', 'g')"
    ids = f"regexp_replace({named}, '{C.GENERIC_UID}', '@某人', 'g')"
    return f"""WITH {CHAT}, a AS (SELECT *, {t} AS t0, {faces} AS b FROM chat), b1 AS (SELECT *, CASE WHEN raw_type LIKE 'discord_%' THEN t0 ELSE {short} END AS t FROM a), c AS (SELECT *, {ids} AS u FROM b1),
      d AS (SELECT *, CASE WHEN placeholder = '' OR contains(u, placeholder) THEN u WHEN u = '' THEN placeholder ELSE trim(u || ' ' || placeholder) END AS v FROM c), e AS (SELECT *, {private_sql('v')} AS x FROM d), f AS (SELECT *, trim(x[3:-3]) AS y FROM e)
      SELECT message_id, source, seq, timestamp_ms, role, kind, CASE WHEN kind = 'recalled' THEN '[撤回]' WHEN kind = 'system' THEN coalesce(nullif(trim(text), ''), '[系统消息]') WHEN y = '' AND kind = 'unknown' THEN '[未知消息]' ELSE y END AS clean_text FROM f"""


SPOKEN = f"""{CHAT}, spoken AS (SELECT *, regexp_replace(regexp_replace(text, '\\[(?:{'|'.join(L.STAT_TOKENS)})\\]', ' ', 'g'), '\\[[^\\[\\]\\n]{{1,12}}\\]', ' ', 'g') AS words FROM chat WHERE role = 'friend' AND kind NOT IN ('recalled', 'system', 'placeholder') AND trim(text) <> '')"""
STOP = "(" + ", ".join(f"'{x}'" for x in L.STOPWORDS) + ")"


def _opening_sql(t: str, night: bool) -> str:
    rules = ([("night_ping", L.NIGHT)] if night else []) + list(L.OPENINGS)
    cases = " ".join(f"WHEN regexp_matches({t}, '{_icase(p)}') THEN '{k}'" for k, p in rules)
    return rf"""CASE {cases} WHEN {t} LIKE '[回复%' OR (length({t}) <= 24 AND regexp_matches({t}, '{L.BACK_REFERENCE}')) OR (length({t}) <= 100 AND regexp_matches({t}, '{_icase(L.BACK_REFERENCE_EN)}')) THEN 'continue_topic'
      WHEN length({t}) <= 8 AND (regexp_matches({t}, '^[0-9]+$') OR lower({t}) IN ('hi', 'hey') OR regexp_matches({t}, '^[{W}]{{1,4}}[~～!！。]?$')) THEN 'short_ping' ELSE 'other' END"""


def _scene_sql(t: str) -> str:
    cases = " ".join(rf"WHEN regexp_matches({t}, '{'|'.join(p.lower() for p in a)}|(^|[^{W}])(?:{'|'.join(b)})($|[^{W}])') THEN '{k}'" for k, a, b in L.SCENES)
    return f"CASE {cases} ELSE 'casual' END"


STAT_TOKEN = r"\[(?:" + "|".join(L.STAT_TOKENS) + r")\]"
USABLE = rf"(trim(text) <> '' AND NOT regexp_matches(trim(text), '(?i)^\[(?:{'|'.join(L.STAT_TOKENS + L.STAT_TOKENS_EN)})\]$'))"
EMOJI = L.EMOJI
BURST = rf"(regexp_matches(s, '{_icase(L.BURST)}') OR (length(s) <= 12 AND regexp_matches(s, '啊啊啊|哈哈哈|呜呜呜|哇哇哇')))"

SQL = {
    "q01_normalize_messages": _clean_sql(),
    "q02_sessionize": f"WITH {SUM} SELECT source, session_no, start_ms, end_ms, n_messages, n_friend, n_self, end_ms - start_ms AS duration_ms FROM summ",
    "q03_session_ids": f"WITH {SUM} SELECT source, session_no, 'sess-' || left(sha1(start_ms || '-' || end_ms || '-' || first_id), 16) AS session_id FROM summ",
    "q04_sliding_windows": f"""WITH {CONV}, r AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM conv WHERE kind <> 'system' WINDOW w AS (PARTITION BY source ORDER BY timestamp_ms, seq)),
      k AS (SELECT DISTINCT source, n, unnest(range(0, CASE WHEN n <= 4 THEN 1 ELSE ceil((n - 4) / 3.0)::BIGINT + 1 END)) AS window_no FROM r)
      SELECT source, window_no, count(*) AS message_count, min(seq) AS start_seq, max(seq) AS end_seq, sha1(string_agg(role || ': ' || text, chr(10) ORDER BY pos)) AS text_sha1
      FROM r JOIN k USING (source, n) WHERE pos >= window_no * 3 AND pos < window_no * 3 + 4 GROUP BY source, window_no""",
    "q05_turns": f"""WITH {SES}, t AS (SELECT *, (sum(c) OVER (PARTITION BY source, session_no ORDER BY timestamp_ms, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS turn_no FROM (
      SELECT *, CASE WHEN role <> lag(role) OVER (PARTITION BY source, session_no ORDER BY timestamp_ms, seq) THEN 1 ELSE 0 END AS c FROM ses))
      SELECT source, session_no, turn_no, any_value(role) AS role, count(*) AS n_messages, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms FROM t GROUP BY source, session_no, turn_no""",
    "q06_context_frames": f"""WITH {CONV}, l AS (SELECT *, CASE WHEN kind <> 'system' AND trim(text) <> '' THEN role || ': ' || trim(text) END AS line, row_number() OVER (PARTITION BY source ORDER BY timestamp_ms, seq) AS pos FROM conv)
      SELECT a.message_id, sha1(coalesce(string_agg(b.line, chr(10) ORDER BY b.pos) FILTER (b.pos < a.pos), '')) AS before_sha1, sha1(coalesce(string_agg(b.line, chr(10) ORDER BY b.pos) FILTER (b.pos > a.pos), '')) AS after_sha1
      FROM l a JOIN l b ON a.source = b.source AND b.pos BETWEEN a.pos - 6 AND a.pos + 2 WHERE a.role = 'friend' GROUP BY a.message_id""",
    "q07_response_pairs": f"""WITH {SES}, a AS (SELECT *, role = 'self' AS s, coalesce(lag(role = 'self') OVER w, false) AS ls FROM ses WINDOW w AS (PARTITION BY source, session_no ORDER BY timestamp_ms, seq)),
      b AS (SELECT *, sum((s AND NOT ls)::INT) OVER (PARTITION BY source, session_no ORDER BY timestamp_ms, seq ROWS UNBOUNDED PRECEDING) AS run FROM a),
      c AS (SELECT *, row_number() OVER (PARTITION BY source, session_no, run, s ORDER BY timestamp_ms, seq) AS k FROM b WHERE run > 0)
      SELECT source, session_no, sha1(string_agg(text, chr(10) || chr(10) ORDER BY timestamp_ms, seq) FILTER (s)) AS user_sha1, string_agg(text, chr(10) || chr(10) ORDER BY timestamp_ms, seq) FILTER (NOT s) AS friend_reply,
      count(*) FILTER (s) AS n_user, count(*) FILTER (NOT s) AS n_reply, min(timestamp_ms) AS start_time_ms, max(timestamp_ms) FILTER (NOT s) AS end_time_ms
      FROM c WHERE s OR k <= 4 GROUP BY source, session_no, run HAVING count(*) FILTER (NOT s) > 0""",
    "q08_adjacent_pairs": f"WITH {CONV} SELECT source, seq, sha1(ut) AS user_sha1, sha1(text) AS reply_sha1 FROM (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS ut FROM conv WINDOW w AS (PARTITION BY source ORDER BY timestamp_ms, seq)) WHERE role = 'friend' AND r = 'self'",
    "q09_length_stats": f"WITH {CONV} SELECT role, count(*) AS n, round(avg(length(text)), 6) AS mean_chars, round(median(length(text)), 6) AS median_chars, round(avg((length(text) < 8)::INT), 6) AS share_short, round(avg((length(text) > 30)::INT), 6) AS share_long FROM conv GROUP BY role",
    "q10_punctuation_stats": f"WITH {CONV} SELECT role, sum(len(regexp_extract_all(text, '{stats.MARKS}')))::BIGINT AS n_marks, round(avg(regexp_matches(text, '{stats.MARKS}')::INT), 6) AS share_with, round(avg(regexp_matches(text, '{stats.MARKS}\\s*$')::INT), 6) AS share_ending, round(avg(contains(text, '?')::INT), 6) AS share_asking, round(avg(contains(text, '!')::INT), 6) AS share_exclaiming FROM conv GROUP BY role",
    "q11_top_phrases": f"""WITH {SPOKEN}, r AS (SELECT unnest(regexp_extract_all(words, '[一-鿿]+|[A-Za-z]+')) AS run FROM spoken),
      g AS (SELECT substr(run, i, k) AS phrase FROM r, (SELECT unnest([2, 3, 4]) AS k), LATERAL (SELECT unnest(range(1, length(run) - k + 2)) AS i) WHERE length(run) >= 2 AND NOT regexp_matches(run, '^[A-Za-z0-9_-]{{15,}}$'))
      SELECT * FROM (SELECT phrase, count(*) AS n FROM g WHERE phrase NOT IN {STOP} GROUP BY phrase ORDER BY n DESC, phrase LIMIT 30) WHERE n >= 2""",
    "q12_top_terms": f"""WITH {SPOKEN}, t AS (SELECT timestamp_ms, seq, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT *, regexp_extract_all(lower(words), '[一-鿿]+|[a-zß-öø-ÿ]+') AS w FROM spoken))
      SELECT term, n FROM (SELECT term, count(*) AS n, min((timestamp_ms, seq, pos)) AS f FROM t WHERE length(term) >= 2 AND term NOT IN {STOP} AND NOT regexp_matches(term, '^[A-Za-z0-9_-]{{15,}}$') GROUP BY term ORDER BY n DESC, f, term LIMIT 60)""",
    "q13_lexicon_score": f"WITH {CHAT} SELECT message_id, least(1.0, (" + " + ".join(f"contains(text, '{x}')::INT" for x in L.WARMTH) + ") / 4.0)::DOUBLE AS warmth FROM chat",
    "q14_hourly_profile": f"WITH {EV}, c AS (SELECT hour(make_timestamp(timestamp_ms * 1000)) AS hour, count(*) AS n FROM ev WHERE role = 'friend' GROUP BY 1), d AS (SELECT h.hour, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(0, 24)) AS hour) h LEFT JOIN c USING (hour)) SELECT hour, n, CASE WHEN max(n) OVER () > 0 THEN round(n / max(n) OVER (), 3) ELSE 0.0 END AS level FROM d",
    "q15_awake_range": f"""WITH {EV}, c AS (SELECT source, hour(make_timestamp(timestamp_ms * 1000)) AS hour, count(*) AS n FROM ev WHERE role = 'friend' GROUP BY 1, 2),
      p AS (SELECT source, hour, round(n / max(n) OVER (PARTITION BY source), 3) AS level FROM c),
      d AS (SELECT source, unnest([hour, hour + 24]) AS h FROM p WHERE level >= 0.5), g AS (SELECT source, h - row_number() OVER (PARTITION BY source ORDER BY h) AS g, h FROM d),
      r AS (SELECT source, g, min(h) AS s, count(*) AS n FROM g GROUP BY source, g), b AS (SELECT source, arg_max((s, n), (n, -s)) AS b FROM r GROUP BY source)
      SELECT source, CASE WHEN b[2] < 24 THEN b[1] % 24 ELSE 8 END::BIGINT AS wake_hour, CASE WHEN b[2] < 24 THEN (b[1] + b[2] - 1) % 24 ELSE 23 END::BIGINT AS sleep_hour
      FROM (SELECT DISTINCT source FROM c) LEFT JOIN (SELECT source, [b[1], b[2]] AS b FROM b) USING (source)""",
    "q49_night_share": f"WITH {EV} SELECT source, count(*) AS n, count(*) FILTER (hour(make_timestamp(timestamp_ms * 1000)) >= 22 OR hour(make_timestamp(timestamp_ms * 1000)) < 6) AS n_night, count(*) FILTER (isodow(make_timestamp(timestamp_ms * 1000)) >= 6) AS n_weekend FROM ev GROUP BY source",
    "q20_latency_stats": "SELECT event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_failed, list_sort(list(value))[count(*) // 2 + 1] AS p50, list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.95)::BIGINT) + 1] AS p95 FROM events GROUP BY event_type",
    "q40_pack_blocks": f"""WITH RECURSIVE {CONV}, o AS (SELECT source, timestamp_ms, length(coalesce(text, '')) + 1 AS cost, row_number() OVER (PARTITION BY source ORDER BY timestamp_ms, seq) AS pos FROM conv),
      f AS (SELECT source, pos, timestamp_ms, cost, cost AS used, 0 AS block_no FROM o WHERE pos = 1 UNION ALL
        SELECT o.source, o.pos, o.timestamp_ms, o.cost, CASE WHEN f.used + o.cost > 1000 THEN o.cost ELSE f.used + o.cost END, f.block_no + CASE WHEN f.used + o.cost > 1000 THEN 1 ELSE 0 END FROM f JOIN o ON o.source = f.source AND o.pos = f.pos + 1)
      SELECT source, block_no::BIGINT AS block_no, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms, count(*) AS n_messages, sum(cost)::BIGINT AS n_chars FROM f GROUP BY source, block_no""",
    "q41_tail_budget": f"""WITH {CONV}, r AS (SELECT *, row_number() OVER w AS n, sum(length(text)) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM conv WINDOW w AS (PARTITION BY source ORDER BY timestamp_ms DESC, seq DESC)),
      k AS (SELECT * FROM r WHERE n <= 4 AND (c <= 900 OR n = 1)) SELECT message_id, source, seq FROM (SELECT *, max(n) FILTER (role = 'self') OVER (PARTITION BY source) AS f FROM k) WHERE n <= f""",
    "q43_recent_per_key": f"WITH {EV} SELECT source, message_id, recent_rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY timestamp_ms DESC, seq DESC) AS recent_rank FROM ev) WHERE recent_rank <= 20",
}

GAPS = f"""{SUM}, gaps AS (SELECT *, CASE WHEN g < 60 THEN 'short' WHEN g < 180 THEN 'one_to_three_hours' WHEN g < 480 THEN 'three_to_eight_hours' WHEN g < 2160 THEN 'overnight' WHEN g IS NOT NULL THEN 'multi_day' END AS gap_bucket
  FROM (SELECT *, trunc((start_ms - lag(end_ms) OVER (PARTITION BY source ORDER BY start_ms, end_ms)) / 60000)::BIGINT AS g FROM summ)),
  opens AS (SELECT source, session_no, arg_min(role, (timestamp_ms, seq)) AS initiator, min(timestamp_ms) AS opened_ms, arg_min(text, (timestamp_ms, seq)) AS opening, g AS gap_minutes, gap_bucket FROM ses JOIN gaps USING (source, session_no) GROUP BY source, session_no, g, gap_bucket)"""
SQL |= {
    "q16_idle_gaps": f"WITH {GAPS} SELECT source, session_no, g AS gap_minutes, gap_bucket FROM gaps",
    "q17_opening_stats": f"WITH {GAPS} SELECT source, count(*) FILTER (initiator = 'friend') AS n_friend, count(*) FILTER (initiator <> 'friend') AS n_self, count(DISTINCT make_timestamp(opened_ms * 1000)::DATE) FILTER (initiator = 'friend') AS active_days, median(gap_minutes) FILTER (initiator = 'friend') AS median_gap, round(count(*) FILTER (initiator = 'friend') / count(*), 4) AS initiative_rate FROM opens GROUP BY source",
    "q18_smoothed_weights": f"WITH {GAPS}, c AS (SELECT gap_bucket, count(*) AS n FROM opens WHERE initiator = 'friend' AND gap_minutes >= 120 GROUP BY 1), d AS (SELECT b.gap_bucket, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(['short', 'one_to_three_hours', 'three_to_eight_hours', 'overnight', 'multi_day']) AS gap_bucket) b LEFT JOIN c USING (gap_bucket)) SELECT gap_bucket, n, CASE WHEN max(n) OVER () > 0 THEN round((n + 1) / (max(n) OVER () + 1), 3) ELSE 0.0 END AS weight FROM d",
    "q19_quality_gate": f"WITH {GAPS}, c AS (SELECT source, count(*) FILTER (initiator = 'friend' AND gap_minutes >= 120) AS n_eligible, count(*) FILTER (initiator = 'friend' AND gap_minutes >= 120 AND length(opening) >= 5) AS n_meaningful FROM opens GROUP BY source), s AS (SELECT *, CASE WHEN n_eligible > 0 THEN n_meaningful / n_eligible ELSE 0 END AS share FROM c) SELECT source, n_eligible, n_meaningful, CASE WHEN n_eligible < 12 OR share < 0.45 THEN 'critical' WHEN n_eligible < 30 OR share < 0.7 THEN 'warning' ELSE 'good' END AS verdict FROM s",
    "q44_next_profile_time": f"""WITH {EV}, m AS (SELECT * FROM ev WHERE role = 'friend'), c AS (SELECT source, hour(make_timestamp(timestamp_ms * 1000)) AS hour, count(*) AS n FROM m GROUP BY 1, 2),
      p AS (SELECT source, hour, round(n / max(n) OVER (PARTITION BY source), 3) AS level FROM c), b AS (SELECT source, hour FROM (SELECT *, max(level) OVER (PARTITION BY source) AS pk FROM p) WHERE level >= greatest(0.45, 0.75 * pk)),
      l AS (SELECT source, (max(timestamp_ms) // 900000 + 1) * 900000 AS s FROM m GROUP BY source), t AS (SELECT source, unnest(range(s, s + 36 * 3600000 + 1, 900000)) AS next_ms FROM l)
      SELECT source, min(next_ms) AS next_ms FROM (SELECT *, hour(make_timestamp(next_ms * 1000)) AS hour FROM t WHERE (next_ms // 60000) % 1440 >= 510) JOIN b USING (source, hour) GROUP BY source""",
    "q46_adaptive_segments": f"""WITH RECURSIVE {EV}, ses AS (SELECT *, (sum(b) OVER (PARTITION BY source ORDER BY timestamp_ms, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS session_no FROM (
        SELECT *, CASE WHEN timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY source ORDER BY timestamp_ms, seq) > 1440 * 60000 THEN 1 ELSE 0 END AS b FROM ev)),
      t AS (SELECT *, (sum(c) OVER (PARTITION BY source, session_no ORDER BY timestamp_ms, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS turn_no FROM (SELECT *, CASE WHEN role <> lag(role) OVER (PARTITION BY source, session_no ORDER BY timestamp_ms, seq) THEN 1 ELSE 0 END AS c FROM ses)),
      u AS (SELECT source || '-' || session_no AS session_key, turn_no, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms, greatest(1, sum(length(text)))::BIGINT AS chars FROM t GROUP BY 1, 2),
      f AS (SELECT session_key, turn_no, end_ms, 0::BIGINT AS segment_no, chars AS size, 1 AS count, chars FROM u WHERE turn_no = 0 UNION ALL
        SELECT session_key, turn_no, end_ms, segment_no + brk::INT AS segment_no, CASE WHEN brk THEN chars ELSE size + chars END, CASE WHEN brk THEN 1 ELSE count + 1 END, chars FROM (
          SELECT u.*, f.segment_no, f.size, f.count, (f.size >= 80 OR (f.size >= 40 AND f.count >= 3) OR (f.count >= 3 AND u.start_ms - f.end_ms >= 120 * 60000)) AS brk FROM f JOIN u ON u.session_key = f.session_key AND u.turn_no = f.turn_no + 1))
      SELECT session_key, segment_no, min(turn_no) AS start_turn, max(turn_no) AS end_turn, count(*) AS n_turns, sum(chars)::BIGINT AS chars FROM f GROUP BY session_key, segment_no""",
    "q47_opening_classes": f"WITH {CHAT}, o AS (SELECT source, arg_min(role, (timestamp_ms, seq)) AS initiator, trim(arg_min(text, (timestamp_ms, seq))) AS t FROM chat WHERE role IN ('self', 'friend') AND kind NOT IN ('system', 'recalled') AND {USABLE} GROUP BY source) SELECT source, initiator, {_opening_sql('t', False)} AS by_day, {_opening_sql('t', True)} AS by_night FROM o",
    "q48_scene_profile": rf"""WITH {CHAT}, p AS (SELECT ut, text FROM (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS ut, lag(kind) OVER w AS k FROM chat WHERE kind <> 'recalled' WINDOW w AS (PARTITION BY source ORDER BY timestamp_ms, seq)) WHERE role = 'friend' AND r = 'self' AND kind <> 'system' AND k <> 'system'),
      c AS (SELECT text, (SELECT {SHOWN_SQL} FROM (SELECT ut AS t)) AS u, (SELECT {SHOWN_SQL} FROM (SELECT text AS t)) AS s FROM p WHERE {USABLE}), d AS (SELECT *, {_scene_sql('lower(u)')} AS scene FROM c WHERE u <> '')
      SELECT scene, count(*) AS n, CASE WHEN count(*) >= 20 THEN 'high' WHEN count(*) >= 8 THEN 'medium' ELSE 'low' END AS confidence, round(avg(length(s)), 2) AS mean_chars, round(avg((length(s) < 8)::INT), 3) AS short, round(avg(regexp_matches(text, '{L.QUESTION}')::INT), 3) AS question,
        round(avg(regexp_matches(text, '{EMOJI}')::INT), 3) AS emoji, round(avg(contains(text, '[图片]')::INT), 3) AS image, round(avg(regexp_matches(text, '{_icase(L.INTIMACY)}')::INT), 3) AS intimacy FROM d GROUP BY scene""",
    "q52_predicates": rf"""WITH {CHAT}, m AS (SELECT *, (SELECT {SHOWN_SQL} FROM (SELECT text AS t)) AS s, regexp_replace(text, '\[(?:{'|'.join(L.EMPTY_TOKENS)})\]', '', 'g') AS rest, regexp_replace(regexp_replace(replace(text, '@Sam', ''), '\[(?:图片|语音|视频|文件|表情|动画表情|撤回|系统消息)\]|\[\[[^\]]+\]\]', '', 'g'), '{L.NOISE.replace(chr(39), chr(39) * 2)}', '', 'g') AS q FROM chat)
      SELECT message_id, trim(text) <> '' AND kind NOT IN ('recalled', 'system') AND (kind <> 'placeholder' OR trim(rest) <> '') AS chunkable, kind NOT IN ('recalled', 'system', 'placeholder') AND trim(text) <> '' AS useful, {USABLE} AS usable,
        (SELECT {LOW_SQL} FROM (SELECT text AS t)) AS low, replace(replace(replace(replace(q, '你在干什么', '在干嘛'), '在干什么', '在干嘛'), '你在干嘛', '在干嘛'), '干嘛呢', '在干嘛') = '在干嘛' AS echo, {BURST} AS burst,
        CASE WHEN regexp_matches(text, '{_icase(L.SERIOUS_TONE)}') THEN 0.0 WHEN regexp_matches(text, '{_icase(L.BURST)}') THEN 0.45 WHEN regexp_matches(text, '{_icase(L.LIGHT_TONE)}') THEN 0.18 ELSE 0.05 END::DOUBLE AS p_burst FROM m""",
    "q53_marks_and_media": rf"""WITH {SPOKEN} SELECT role, round(avg(regexp_matches(text, '…|\.\.\.')::INT), 3) AS ellipsis, round(avg(regexp_matches(text, '[？?]')::INT), 3) AS question, round(avg(regexp_matches(text, '[！!]')::INT), 3) AS exclaim, round(avg((translate(text, '{L.MARKS.replace(chr(39), chr(39) * 2)}', '') = text)::INT), 3) AS no_mark,
      round(avg(len(regexp_extract_all(text, '{EMOJI}'))), 3) AS emoji, round(avg(regexp_matches(text, '{STAT_TOKEN}')::INT), 3) AS placeholder, round(avg(contains(text, '[图片]')::INT), 3) AS image, round(avg(contains(text, '[语音]')::INT), 3) AS voice FROM spoken GROUP BY role""",
    "q54_top_marks": f"WITH {SPOKEN}, c AS (SELECT unnest(string_split(text, '')) AS mark FROM spoken) SELECT mark, count(*) AS n FROM c WHERE mark <> '' AND contains('{L.MARKS.replace(chr(39), chr(39) * 2)}', mark) GROUP BY mark ORDER BY n DESC, mark LIMIT 15",
    "q55_circadian": f"""WITH {EV}, h AS (SELECT source, hour(make_timestamp(timestamp_ms * 1000)) AS h, count(*) AS a, count(*) FILTER (isodow(make_timestamp(timestamp_ms * 1000)) < 6) AS w, count(*) FILTER (isodow(make_timestamp(timestamp_ms * 1000)) >= 6) AS e FROM ev GROUP BY 1, 2),
      d AS (SELECT s.source, x.h, coalesce(a, 0) AS a, coalesce(w, 0) AS w, coalesce(e, 0) AS e FROM (SELECT DISTINCT source FROM ev) s CROSS JOIN (SELECT unnest(range(0, 24)) AS h) x LEFT JOIN h ON h.source = s.source AND h.h = x.h),
      p AS (SELECT source, h, a, CASE WHEN max(a) OVER q > 0 THEN round(a / max(a) OVER q, 3) ELSE 0 END AS la, CASE WHEN max(w) OVER q > 0 THEN round(w / max(w) OVER q, 3) ELSE 0 END AS lw, CASE WHEN max(e) OVER q > 0 THEN round(e / max(e) OVER q, 3) ELSE 0 END AS le FROM d WINDOW q AS (PARTITION BY source)),
      g AS (SELECT source, sum(a)::BIGINT AS n, string_agg(printf('%.3f', la), ' ' ORDER BY h) AS hours, string_agg(printf('%.3f', lw), ' ' ORDER BY h) AS weekdays, string_agg(printf('%.3f', le), ' ' ORDER BY h) AS weekends, round(sum(a) FILTER (h >= 22 OR h < 6) / sum(a), 3) AS night_share FROM p GROUP BY source)
      SELECT source, n, CASE WHEN n >= 20 THEN hours END AS hours, CASE WHEN n >= 20 THEN weekdays END AS weekdays, CASE WHEN n >= 20 THEN weekends END AS weekends, night_share, CASE WHEN night_share >= 0.4 THEN 'night_owl' WHEN night_share >= 0.2 THEN 'late' ELSE 'regular' END AS band FROM g""",
    "q56_opening_report": f"""WITH {GAPS}, f AS (SELECT *, make_timestamp(opened_ms * 1000) AS ts FROM opens WHERE initiator = 'friend'),
      h AS (SELECT source, string_agg(v || '=' || n, ' ' ORDER BY v) AS hours FROM (SELECT source, hour(ts)::VARCHAR AS v, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY 1), w AS (SELECT source, string_agg(v || '=' || n, ' ' ORDER BY v) AS weekdays FROM (SELECT source, (isodow(ts) - 1)::VARCHAR AS v, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY 1),
      m AS (SELECT source, string_agg(v || '=' || n, ' ' ORDER BY v) AS months FROM (SELECT source, strftime(ts, '%Y-%m') AS v, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY 1), k AS (SELECT source, string_agg(v || '=' || n, ' ' ORDER BY v) AS kinds FROM (SELECT source, opening AS v, count(*) AS n FROM f GROUP BY 1, 2) GROUP BY 1),
      o AS (SELECT source, count(*) AS n, count(DISTINCT ts::DATE) AS active_days, datediff('day', min(ts)::DATE, max(ts)::DATE) + 1 AS span_days, median(gap_minutes) AS median_gap FROM f GROUP BY source)
      SELECT *, round(n * 30 / span_days, 2) AS per_30_days FROM o JOIN h USING (source) JOIN w USING (source) JOIN m USING (source) JOIN k USING (source)""",
    "q57_budget_context": f"""WITH {CONV}, l AS (SELECT *, length(trim(text)) AS c, CASE WHEN kind <> 'system' AND trim(text) <> '' THEN role || ': ' || trim(text) END AS line, row_number() OVER w AS pos FROM conv WINDOW w AS (PARTITION BY source ORDER BY timestamp_ms, seq)),
      j AS (SELECT a.message_id, a.pos AS apos, b.pos AS bpos, b.line, b.c, sum(b.c) OVER (PARTITION BY a.message_id, b.pos < a.pos ORDER BY abs(b.pos - a.pos)) AS s FROM l a JOIN l b ON a.source = b.source AND a.pos <> b.pos WHERE a.role = 'friend'),
      k AS (SELECT * FROM j WHERE s - c = 0 OR s <= CASE WHEN bpos < apos THEN 400 ELSE 200 END)
      SELECT a.message_id, sha1(coalesce(string_agg(k.line, chr(10) ORDER BY k.bpos) FILTER (k.bpos < k.apos), '')) AS before_sha1, sha1(coalesce(string_agg(k.line, chr(10) ORDER BY k.bpos) FILTER (k.bpos > k.apos), '')) AS after_sha1 FROM l a LEFT JOIN k USING (message_id) WHERE a.role = 'friend' GROUP BY a.message_id""",
    "q58_opening_runs": f"""WITH {CHAT}, h AS (SELECT *, coalesce(nullif(trim(text), ''), placeholder) AS t, first_value(role) OVER w AS who FROM chat WHERE role IN ('self', 'friend') WINDOW w AS (PARTITION BY source ORDER BY timestamp_ms, seq)),
      g AS (SELECT *, sum((role <> who)::INT) OVER (PARTITION BY source ORDER BY timestamp_ms, seq ROWS UNBOUNDED PRECEDING) AS o FROM h)
      SELECT source, any_value(who) AS initiator, min(timestamp_ms) AS opened_ms, sha1(string_agg(t, chr(10) ORDER BY timestamp_ms, seq) FILTER (o = 0 AND t <> '')) AS opening_sha1, count(*) FILTER (o = 0 AND t <> '') AS n_opening, substr(arg_min(t, (timestamp_ms, seq)) FILTER (o > 0 AND role <> who AND t <> ''), 1, 120) AS response FROM g GROUP BY source HAVING count(*) FILTER (o = 0 AND t <> '') > 0""",
    "q59_previous_tail": f"""WITH {GAPS}, l AS (SELECT source, session_no, timestamp_ms, seq, role || ': ' || trim(text) AS line, row_number() OVER (PARTITION BY source, session_no ORDER BY timestamp_ms DESC, seq DESC) AS n FROM ses WHERE kind <> 'system' AND trim(text) <> ''),
      t AS (SELECT source, session_no, string_agg(line, chr(10) ORDER BY timestamp_ms, seq) AS tail FROM l WHERE n <= 4 GROUP BY 1, 2)
      SELECT source, session_no, g AS gap_minutes, sha1(coalesce(lag(tail) OVER (PARTITION BY source ORDER BY start_ms, end_ms), '')) AS tail_sha1 FROM gaps LEFT JOIN t USING (source, session_no)""",
    "q60_even_sample": f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY timestamp_ms, seq) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM ev), k AS (SELECT DISTINCT source, j * n // 7 AS i FROM (SELECT DISTINCT source, n FROM r WHERE n > 7), (SELECT unnest(range(0, 7)) AS j)) SELECT source, message_id FROM r WHERE n <= 7 OR (source, i) IN (SELECT (source, i) FROM k)",
    "q61_length_quota": f"""WITH {CONV}, m AS (SELECT *, CASE WHEN length(text) < 120 THEN 0 WHEN length(text) <= 200 THEN 1 ELSE 2 END AS b FROM conv WHERE role <> 'system'),
      c AS (SELECT role, count(*) FILTER (b = 0) AS h0, count(*) FILTER (b = 1) AS h1, count(*) FILTER (b = 2) AS h2 FROM m GROUP BY role), g AS (SELECT *, least(h0, 9) AS g0, least(h1, 12) AS g1, least(h2, 9) AS g2 FROM c),
      s1 AS (SELECT *, g1 + least(h1 - g1, 30 - g0 - g1 - g2) AS t1 FROM g), s0 AS (SELECT *, g0 + least(h0 - g0, 30 - g0 - t1 - g2) AS t0 FROM s1), s2 AS (SELECT *, g2 + least(h2 - g2, 30 - t0 - t1 - g2) AS t2 FROM s0),
      p AS (SELECT role, 0 AS b, t0 AS t FROM s2 UNION ALL SELECT role, 1, t1 FROM s2 UNION ALL SELECT role, 2, t2 FROM s2),
      r AS (SELECT m.role, message_id, m.b, t, row_number() OVER (PARTITION BY m.role, m.b ORDER BY timestamp_ms, seq) - 1 AS i, count(*) OVER (PARTITION BY m.role, m.b) AS n FROM m JOIN p ON p.role = m.role AND p.b = m.b)
      SELECT r.role, message_id FROM r WHERE t > 0 AND EXISTS (SELECT 1 FROM (SELECT unnest(range(0, t)) AS j) WHERE j * n // t = i)""",
    "q62_occurrence": "SELECT doc_id, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) - 1 AS occurrence FROM documents",
    "q63_window_chunks": f"""WITH {CHAT}, r AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY source) AS cnt FROM chat WHERE kind <> 'system' WINDOW w AS (PARTITION BY source ORDER BY timestamp_ms, seq)),
      k AS (SELECT DISTINCT source, cnt, unnest(range(0, CASE WHEN cnt <= 4 THEN 1 ELSE ceil((cnt - 4) / 3.0)::BIGINT + 1 END)) AS window_no FROM r),
      g AS (SELECT source, window_no, count(*) AS message_count, min(seq) AS a, max(seq) AS z, string_agg(role || ': ' || trim(text), chr(10) ORDER BY pos) FILTER (trim(text) <> '') AS t FROM r JOIN k USING (source, cnt) WHERE pos >= window_no * 3 AND pos < window_no * 3 + 4 GROUP BY source, window_no)
      SELECT source, window_no, 'window-' || left(sha1(source || '-0-' || a || '-' || z), 16) AS chunk_id, message_count, sha1(t) AS text_sha1 FROM g WHERE t IS NOT NULL""",
    "q64_turn_batches": f"""WITH RECURSIVE {SES}, t AS (SELECT *, (sum(c) OVER (PARTITION BY source, session_no ORDER BY timestamp_ms, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS turn_no FROM (SELECT *, CASE WHEN role <> lag(role) OVER (PARTITION BY source, session_no ORDER BY timestamp_ms, seq) THEN 1 ELSE 0 END AS c FROM ses)),
      u AS (SELECT source || '-' || session_no AS session_key, turn_no, count(*) AS n FROM t GROUP BY 1, 2),
      f AS (SELECT session_key, turn_no, n AS used, 0::BIGINT AS batch_no FROM u WHERE turn_no = 0 UNION ALL SELECT u.session_key, u.turn_no, CASE WHEN f.used + u.n > 3 THEN u.n ELSE f.used + u.n END, f.batch_no + (f.used + u.n > 3)::INT FROM f JOIN u ON u.session_key = f.session_key AND u.turn_no = f.turn_no + 1)
      SELECT session_key, turn_no, batch_no FROM f""",
    "q65_summary_modes": f"""WITH {GAPS}, h AS (SELECT source, v, row_number() OVER (PARTITION BY source ORDER BY n DESC, v) AS k FROM (SELECT source, hour(make_timestamp(opened_ms * 1000)) AS v, count(*) AS n FROM opens GROUP BY 1, 2)), b AS (SELECT source, v, row_number() OVER (PARTITION BY source ORDER BY n DESC, lpad(v, 20, ' ')) AS k FROM (SELECT source, gap_bucket AS v, count(*) AS n FROM opens WHERE gap_bucket IS NOT NULL GROUP BY 1, 2)),
      o AS (SELECT source, v, row_number() OVER (PARTITION BY source ORDER BY n DESC, lpad(v, 20, ' ')) AS k FROM (SELECT source, opening AS v, count(*) AS n FROM opens GROUP BY 1, 2))
      SELECT source, string_agg(h.v::VARCHAR, ',' ORDER BY h.k) AS hours, any_value(b.v) AS bucket, any_value(o.v) AS kind FROM h LEFT JOIN (SELECT * FROM b WHERE k = 1) b USING (source) LEFT JOIN (SELECT * FROM o WHERE k = 1) o USING (source) WHERE h.k <= 3 GROUP BY source""",
    "q66_quiet_and_night": f"""WITH {EV}, t AS (SELECT message_id, timestamp_ms AS m, (timestamp_ms // 60000) % 1440 AS d, hour(make_timestamp(timestamp_ms * 1000)) AS h, timestamp_ms // 86400000 * 86400000 AS day FROM ev)
      SELECT message_id, d >= 1380 OR d < 480 AS quiet, CASE WHEN d >= 1380 OR d < 480 THEN CASE WHEN day + 28800000 <= m THEN day + 115200000 ELSE day + 28800000 END END AS ends_ms, CASE WHEN h BETWEEN 5 AND 10 THEN 'morning' WHEN h BETWEEN 11 AND 13 THEN 'noon' WHEN h BETWEEN 14 AND 17 THEN 'afternoon' WHEN h BETWEEN 18 AND 22 THEN 'evening' ELSE 'night' END AS slot,
        CASE WHEN day + 39600000 > m THEN day + 39600000 WHEN day + 50400000 > m THEN day + 50400000 WHEN day + 64800000 > m THEN day + 64800000 WHEN day + 82800000 > m THEN day + 82800000 ELSE day + 115200000 END AS next_ms, 1 < h AND h < 9 AS night FROM t""",
    "q67_delays_and_scores": """SELECT event_id, round(least(1, greatest(0, value / 100)) * 0.24 + least(1, greatest(0, 1 - value / 100)) * 0.2 + least(1, greatest(0, value / 100 * 2)) * 0.12, 6) AS score, CASE event_type WHEN 'view' THEN 0.15 WHEN 'click' THEN 0.35 ELSE 0.75 END::DOUBLE AS availability,
      CASE WHEN event_type = 'error' THEN 0 ELSE least(60, greatest(0, greatest(floor(value), 12, CASE WHEN event_type = 'view' THEN 20 ELSE 0 END))) END::INTEGER AS delay FROM events""",
}
QUERIES = {k: v for k, v in globals().items() if k.startswith("q") and callable(v)}
