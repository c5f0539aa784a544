"""Queries over joins, listings and the batch forms of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import merges, relations
from ..sources.tables import event_messages, table
from ..streaming import activity, writeback
from .conversation import GAPS, _openings


def q94_nearest_openings(spark, sf):
    """Six openings of each user that are nearest to Wednesday at nine."""
    at = F.timestamp_millis("opened_ms")
    rows = _openings(spark, sf).withColumns({"hour": F.hour(at), "weekday": F.weekday(at)})
    return merges.nearest_openings(rows, 9, 2).select("source", F.col("place").cast("long").alias("place"), "opened_ms")


def q95_embedded_chunks(spark, sf):
    """Documents with a vector and without one, by language."""
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("label") % 2 == 0, F.col("embedding")).alias("vector"))
    have, lack = relations.with_embeddings(chunks, vectors)
    rows = have.select("lang", F.lit(1).alias("have")).unionByName(lack.select("lang", F.lit(0).alias("have")))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("have").alias("n_have"))


def q96_reused_descriptions(spark, sf):
    """What is left to do for each text, if every third was described, some in vain and some deleted."""
    docs = table(spark, sf, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("image_sha"))
    said = F.when(F.col("doc_id") % 2 == 0, "[Image: recognition failed]").otherwise(F.concat(F.lit("seen "), F.lpad(F.col("doc_id").cast("string"), 9, "0")))
    described = docs.where("doc_id % 3 = 0").select("image_sha", said.alias("description"), (F.col("doc_id") % 5 == 0).alias("deleted"))
    return relations.reuse_descriptions(docs, described).select("doc_id", "state", "reused")


def q97_last_activity(spark, sf):
    """The latest event of each user."""
    rows = event_messages(spark, sf).select(F.col("source").alias("conversation_id"), F.col("timestamp_ms").alias("at_ms"))
    return activity.last_activity(rows)


IDLE = 6 * 3600


def q98_write_batches(spark, sf):
    """Batches in which a write-behind buffer of three turns, idle after six hours, would store all events."""
    turns = table(spark, sf, "events").select(F.col("user_id").alias("conversation_id"), F.format_string("%012d", "event_id").alias("turn_id"), F.col("ts").cast("timestamp").alias("enqueued_at"))
    rows = writeback.drained(turns, 3, IDLE)
    return rows.select("conversation_id", "turn_id", F.col("batch_no").cast("long").alias("batch_no"), F.col("place").cast("long").alias("place"))


def q99_send_limits(spark, sf):
    """Whether a user's purchases of a day use up a limit of one, and whether nothing came after the last."""
    rows = event_messages(spark, sf)
    audit = rows.where("text = 'purchase'").select(F.col("source").alias("conversation_id"), F.col("timestamp_ms").alias("sent_ms"))
    seen = activity.last_activity(rows.where("text != 'purchase'").select(F.col("source").alias("conversation_id"), F.col("timestamp_ms").alias("at_ms")))
    return activity.send_limits(audit, seen, NOW_MS, 1)


NOW_MS = 1704067200000 + 20 * 86_400_000 + 43_200_000


def q100_slowest(spark, sf):
    """The three largest events of each kind, with the name that their source is shown by."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type", "value")
    shown = F.when(F.col("event_type") == "purchase", "human_original").when(F.col("event_type") == "view", "live").otherwise(F.col("event_type"))
    return relations.slowest(rows, 3, ["event_type"], "value").select("id", "event_type", F.col("place").cast("long").alias("place"), S.source_label(shown).alias("label"))


QUERIES = {f.__name__: f for f in (q94_nearest_openings, q95_embedded_chunks, q96_reused_descriptions, q97_last_activity, q98_write_batches, q99_send_limits, q100_slowest)}

_AT = "make_timestamp(opened_ms * 1000)"
SQL = {
    "q94_nearest_openings": f"""WITH {GAPS}, o AS (SELECT source, opened_ms, hour({_AT}) AS h, isodow({_AT}) - 1 AS d FROM opens)
      SELECT source, place, opened_ms FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h = 9 DESC, d = 2 DESC, least(abs(h - 9), 24 - abs(h - 9)), opened_ms DESC) AS place FROM o) WHERE place <= 6""",
    "q95_embedded_chunks": "SELECT lang, count(*) AS n, count(*) FILTER (vec_id IS NOT NULL) AS n_have FROM documents LEFT JOIN (SELECT vec_id FROM embeddings WHERE label % 2 = 0 AND embedding IS NOT NULL) ON doc_id = vec_id GROUP BY lang",
    "q96_reused_descriptions": """WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS sha FROM documents), k AS (SELECT sha, count(*) AS n, min(CASE WHEN doc_id % 2 <> 0 AND doc_id % 5 <> 0 THEN 'seen ' || lpad(doc_id::VARCHAR, 9, '0') END) AS reused FROM d WHERE doc_id % 3 = 0 GROUP BY sha)
      SELECT doc_id, CASE WHEN reused IS NOT NULL THEN 'reusable' WHEN n > 0 THEN 'failed' ELSE 'pending' END AS state, reused FROM d LEFT JOIN k USING (sha)""",
    "q97_last_activity": "SELECT user_id AS conversation_id, max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY user_id",
    "q98_write_batches": f"""WITH a AS (SELECT user_id AS c, lpad(event_id::VARCHAR, 12, '0') AS t, ts, CASE WHEN epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w >= {IDLE * 1000} THEN 1 ELSE 0 END AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      b AS (SELECT *, sum(p) OVER (PARTITION BY c ORDER BY ts, t ROWS UNBOUNDED PRECEDING) AS r FROM a), d AS (SELECT *, row_number() OVER (PARTITION BY c, r ORDER BY ts, t) - 1 AS i FROM b)
      SELECT c AS conversation_id, t AS turn_id, (sum(CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY ts, t ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS batch_no, i % 3 AS place FROM d""",
    "q99_send_limits": f"""WITH e AS (SELECT user_id AS c, event_type, epoch_us(ts) // 1000 AS ms FROM events), s AS (SELECT c, count(*) FILTER (ms >= {NOW_MS // 86_400_000 * 86_400_000}) AS today, max(ms) AS sent FROM e WHERE event_type = 'purchase' GROUP BY c), l AS (SELECT c, max(ms) AS seen FROM e WHERE event_type <> 'purchase' GROUP BY c)
      SELECT c AS conversation_id, today, today >= 1 AS limit_reached, coalesce(seen, -1) <= sent AS unanswered FROM s LEFT JOIN l USING (c)""",
    "q100_slowest": """SELECT id, event_type, place, CASE event_type WHEN 'purchase' THEN 'Original chat excerpt' WHEN 'view' THEN 'Runtime memory' ELSE 'Memory excerpt' END AS label
      FROM (SELECT event_id AS id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 3""",
}
