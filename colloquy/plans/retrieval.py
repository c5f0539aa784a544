"""Queries over vectors, texts and keyed relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import lexicons as L
from ..functions import scalars as S
from ..functions import text as T
from ..operators import relations, retrieval
from ..sources.tables import table

K = 10
VEC = """qs AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, label AS ql FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT query_id, vec_id, label, ql, 1 - list_cosine_similarity(embedding::DOUBLE[], qv) AS distance FROM embeddings, qs WHERE vec_id <> query_id)"""


def _ranked(name: str, where: str = "true", k: int = K) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d WHERE {where}) WHERE rank <= {k})"


def _queries(spark, sf):
    """Every fiftieth vector by id, a set that grows with the table."""
    return table(spark, sf, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _topk(spark, sf, where=None, k=K):
    return retrieval.vector_topk(table(spark, sf, "embeddings"), _queries(spark, sf), k, where)


def q21_pii_redact(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha1(C.redact_private(F.coalesce("text", F.lit("")))).alias("text_sha1"))


def q22_card_redact(spark, sf):
    text = F.coalesce("text", F.lit(""))
    name, pattern, replacement, valid = C.PRIVATE[1]
    clean = C.replace_where(text, pattern, valid, replacement)
    return table(spark, sf, "documents").select("doc_id", F.sha1(clean).alias("text_sha1"), (clean != text).alias("changed"))


def q23_low_signal(spark, sf):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", C.low_signal(text).alias("low_signal"), F.length(C.shown_text(text)).cast("long").alias("stripped_chars"))


def q24_extract_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(S.urls(F.coalesce("html", F.lit(""))), " ").alias("urls"))


def q25_html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_title(F.coalesce("html", F.lit(""))).alias("title"), T.html_text(F.coalesce("html", F.lit(""))).alias("text"))


def q26_vector_topk(spark, sf):
    return _topk(spark, sf).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


def q27_vector_topk_prefilter(spark, sf):
    return _topk(spark, sf, F.col("label").isin(1, 3, 5)).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


def q28_variant_merge(spark, sf):
    """Two variants of each query: all rows, and the even ones."""
    hits = retrieval.vector_routes(table(spark, sf, "embeddings"), _queries(spark, sf), K, [("all", None), ("even", F.col("vec_id") % 2 == 0)])
    m = retrieval.merge_variants(hits.withColumn("variant", F.col("route_order")))
    return m.select("query_id", "vec_id", F.col("best_rank").cast("long").alias("best_rank"), "variants", F.round("distance", 6).alias("distance"), F.col("position").cast("long").alias("position"))


ROUTES = (("pair", "label < 3"), ("friend", "label BETWEEN 2 AND 5"), ("window", "label > 4"))


def _fused(spark, sf):
    return retrieval.fuse(retrieval.vector_routes(table(spark, sf, "embeddings"), _queries(spark, sf), K, [(name, F.expr(where)) for name, where in ROUTES]))


def q29_rrf_fusion(spark, sf):
    return _fused(spark, sf).select("query_id", "vec_id", F.round("rrf", 8).alias("rrf"), "routes", F.col("first_route").cast("long").alias("first_route"))


def _scored(spark, sf):
    attrs = table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").alias("session"), ((F.col("vec_id") % 5) / 4.0).alias("warmth"), (F.col("vec_id") % 60).cast("double").alias("age_days"),
        F.when(F.col("vec_id") % 7 == 0, "ai_generated").when(F.col("vec_id") % 7 == 1, "live").otherwise("human_original").alias("source"),
    )
    return retrieval.final_score(_fused(spark, sf).join(attrs, "vec_id").withColumn("is_pair", F.col("first_route") == 0))


def q30_scored_retrieval(spark, sf):
    s = _scored(spark, sf)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 10)), "vec_id"))
    return s.withColumn("position", place.cast("long")).where("position <= 12").select("query_id", "vec_id", F.round("score", 8).alias("score"), "position")


def q31_session_diversity(spark, sf):
    d = retrieval.diversify(_scored(spark, sf).withColumn("score", F.round("score", 10)), 12, 2)
    return d.select("query_id", "vec_id", "session", F.col("position").cast("long").alias("position"))


def q32_rerank_blend(spark, sf):
    s = _scored(spark, sf)
    model = s.where("vec_id % 3 = 0").select("query_id", "vec_id", ((F.col("vec_id") % 11) / 10.0).alias("model_score"))
    return retrieval.blend(s.drop("rank"), model).select("query_id", "vec_id", F.round("blended", 8).alias("blended"))


def q33_recall_mrr(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    own = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    r = _topk(spark, sf).join(e, "vec_id").join(own, "query_id")
    out = retrieval.evaluate(r, F.col("label") == F.col("query_label"))
    return out.select("n_queries", *[F.round(c, 6).alias(c) for c in ("recall_1", "recall_3", "recall_5", "recall_10", "mrr")])


def q34_bigram_similarity(spark, sf):
    """Similarity of each page's title to those of the next page."""
    p = table(spark, sf, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    n = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    return p.join(n, "page_id").select("page_id", F.round(T.set_jaccard(T.bigrams(F.col("url")), T.bigrams(F.col("next_url"))), 6).alias("similarity"))


def q35_dedupe_keep_first(spark, sf):
    d = table(spark, sf, "documents")
    return relations.keep_first(d.withColumn("_h", F.sha2("text", 256)), ["_h"], ["doc_id"]).select("doc_id", "lang", "source")


def q36_upsert(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    change = c.where("id % 10 = 0").select((F.col("id") + 5).alias("id"), F.concat(F.lit("new-"), "name").alias("name"), (F.col("balance") * 2).alias("balance"))
    return relations.upsert(c, change)


def q37_tombstone_counts(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(False).alias("deleted"))
    t = relations.soft_delete(o, o.where("id % 9 = 0").select("id"))
    return t.groupBy("status").agg(F.count("*").alias("n_rows"), F.count_if(F.col("deleted")).alias("n_deleted"))


def q38_resume_pending(spark, sf):
    d, done = table(spark, sf, "documents"), table(spark, sf, "labels")
    return relations.pending(d, done, "doc_id").select("doc_id", "lang")


def q39_label_update(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit(-1).alias("toxic"))
    return relations.update_matched(d, table(spark, sf, "labels"), ["quality", "toxic"], "doc_id")


def q42_monthly_top_fill(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice")
    return relations.best_per_group_then_fill(o, "month", [("o_totalprice", True), ("o_orderkey", False)], 100).select("o_orderkey", "month", "is_best")


def q50_token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(F.coalesce("text", F.lit(""))).cast("long").alias("n_tokens"))


def q51_source_eligibility(spark, sf):
    """Rows and shares of each language in each source of the documents."""
    d = table(spark, sf, "documents")
    g = d.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


#: DuckDB has no look-around: what stands before and after a match is matched and put back.
W = r"\p{L}\p{N}_"


def _checked(text: str, pattern: str, test: str, replacement: str) -> str:
    """SQL of ``text`` with the matches m of ``pattern`` that pass ``test`` replaced; a match has a place before and after it."""
    parts = f"regexp_split_to_array(' ' || {text} || ' ', '{pattern}')"
    found = f"regexp_extract_all(' ' || {text} || ' ', '{pattern}')"
    return f"(WITH p AS (SELECT {parts} AS g, {found} AS f), q AS (SELECT g, list_transform(f, lambda m: CASE WHEN {test} THEN '{replacement}' ELSE m END) AS r FROM p) SELECT array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(r[i], '')), '') FROM q)"


def _luhn(m: str) -> str:
    d = f"regexp_replace({m}, '[ -]', '', 'g')"
    return f"(len({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len({d}) + 1), lambda i: CASE WHEN (len({d}) - i) % 2 = 1 THEN (2 * substr({d}, i, 1)::INT) // 10 + (2 * substr({d}, i, 1)::INT) % 10 ELSE substr({d}, i, 1)::INT END)) % 10 = 0)"


def _national(m: str) -> str:
    total = f"list_sum(list_transform(range(1, 18), lambda i: substr({m}, i, 1)::INT * ((1 << (18 - i)::INT) % 11)))"
    return f"(try_strptime(substr({m}, 7, 8), '%Y%m%d') IS NOT NULL AND substr('10X98765432', ({total} % 11)::INT + 1, 1) = upper(substr({m}, 18, 1)))"


CARD_SQL = _checked("t", r"\b(?:[0-9][ -]?){15,18}[0-9]\b", _luhn("m"), "[银行卡]")
ID_SQL = _checked("t", r"\b[1-9][0-9]{5}(?:18|19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]\b", _national("m"), "[身份证]")


def private_sql(text: str) -> str:
    """SQL of all private data replaced, in order; texts keep a blank at each end."""
    with_ids = f"(SELECT {ID_SQL} FROM (SELECT {text} AS t))"
    with_cards = f"(SELECT {CARD_SQL} FROM (SELECT {with_ids} AS t))"
    # twice, as neighbours share the place between them
    mobile = r"(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])"
    out = f"regexp_replace(regexp_replace({with_cards}, '{mobile}', '\\1[手机号]\\2', 'g'), '{mobile}', '\\1[手机号]\\2', 'g')"
    out = rf"regexp_replace({out}, '([.+-]*)[{W}][{W}.+-]*@[{W}-]+(?:\.[{W}-]+)*\.[{W}-]*[{W}]', '\1[邮箱]', 'g')"
    return rf"regexp_replace({out}, '\b(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}\b', '[IP]', 'g')"


LOW_SQL = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\[(?:图片|语音|视频|文件|表情|动画表情|撤回|系统消息)\]|\[\[[^\]]+\]\]', '', 'g'), '\[sticker(?::|=)[^\]\s]+\]', '', 'g'), '\s*\[sticker(?::|=)[^\]\s]*$', ''), '{L.NOISE.replace(chr(39), chr(39) * 2)}', '', 'g') = ''"
SHOWN_SQL = rf"trim(regexp_replace(regexp_replace(t, '\[(?:{'|'.join(L.STAT_TOKENS)})\]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"
_STOP = S._STOP.replace("'", "''")
URL_SQL = rf"(?i)https?://[^{_STOP}]+|(?:^|[^@{W}.-])(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+(?:{'|'.join(S.TOP_LEVEL)})(?::[0-9]{{1,5}})?(?:/[^{_STOP}]*)?"

FUSED = f"""WITH {VEC}, {_ranked('r0', 'label < 3')}, {_ranked('r1', 'label BETWEEN 2 AND 5')}, {_ranked('r2', 'label > 4')},
 h AS (SELECT *, 'pair' AS route, 0 AS o FROM r0 UNION ALL SELECT *, 'friend', 1 FROM r1 UNION ALL SELECT *, 'window', 2 FROM r2),
 f AS (SELECT query_id, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, string_agg(DISTINCT route, ',' ORDER BY route) AS routes, min(o)::BIGINT AS first_route FROM h GROUP BY query_id, vec_id)"""
SCORED = FUSED + """, s AS (SELECT f.*, label AS session, rrf * CASE WHEN f.vec_id % 7 = 0 THEN 0.25 WHEN f.vec_id % 7 = 1 THEN 1.08 ELSE 1.0 END::DOUBLE
  * (1 + 0.15::DOUBLE * exp(-(f.vec_id % 60)::DOUBLE / 30.0::DOUBLE)) * (1 + ((f.vec_id % 5) / 4.0::DOUBLE) * 0.12::DOUBLE) * CASE WHEN first_route = 0 THEN 1.35 ELSE 1.0 END::DOUBLE AS score FROM f JOIN embeddings e ON e.vec_id = f.vec_id)"""
SQL = {
    "q21_pii_redact": f"SELECT doc_id, sha1(r[3:-3]) AS text_sha1 FROM (SELECT doc_id, {private_sql('x')} AS r FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents))",
    "q22_card_redact": f"SELECT doc_id, sha1(r) AS text_sha1, r <> t AS changed FROM (SELECT doc_id, t, ({CARD_SQL})[2:-2] AS r FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))",
    "q23_low_signal": f"SELECT doc_id, {LOW_SQL} AS low_signal, length({SHOWN_SQL})::BIGINT AS stripped_chars FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "q24_extract_urls": rf"""WITH x AS (SELECT page_id, unnest(m) AS u, generate_subscripts(m, 1) AS i FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{URL_SQL}') AS m FROM pages)),
      c AS (SELECT page_id, i, regexp_replace(regexp_replace(u, '^[^a-zA-Z0-9]', ''), '[，。！？、,.!?;；：:]+$', '') AS u FROM x), f AS (SELECT page_id, CASE WHEN regexp_matches(u, '(?i)^https?://') THEN u ELSE 'https://' || u END AS u, min(i) AS i FROM c GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n FROM f)
      SELECT page_id, coalesce(string_agg(u, ' ' ORDER BY i) FILTER (n <= 5), '') AS urls FROM pages LEFT JOIN r USING (page_id) GROUP BY page_id""",
    "q26_vector_topk": f"WITH {VEC}, {_ranked('r')} SELECT query_id, vec_id, rank, round(distance, 6) AS distance FROM r",
    "q27_vector_topk_prefilter": f"WITH {VEC}, {_ranked('r', 'label IN (1, 3, 5)')} SELECT query_id, vec_id, rank FROM r",
    "q28_variant_merge": f"WITH {VEC}, {_ranked('a')}, {_ranked('b', 'vec_id % 2 = 0')}, u AS (SELECT *, '0' AS v FROM a UNION ALL SELECT *, '1' FROM b), m AS (SELECT query_id, vec_id, min(rank) AS best_rank, string_agg(DISTINCT v, ',' ORDER BY v) AS variants, min(distance) AS distance FROM u GROUP BY query_id, vec_id) SELECT query_id, vec_id, best_rank, variants, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY best_rank, m.distance, vec_id) AS position FROM m",
    "q29_rrf_fusion": FUSED + " SELECT query_id, vec_id, round(rrf, 8) AS rrf, routes, first_route FROM f",
    "q30_scored_retrieval": SCORED + " SELECT query_id, vec_id, round(score, 8) AS score, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, vec_id) AS position FROM s) WHERE position <= 12",
    "q31_session_diversity": SCORED + ", c AS (SELECT *, row_number() OVER (PARTITION BY query_id, session ORDER BY round(score, 10) DESC, vec_id) > 2 AS o FROM s) SELECT query_id, vec_id, session, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, round(score, 10) DESC, vec_id) AS position FROM c) WHERE position <= 12",
    "q32_rerank_blend": SCORED + " SELECT query_id, vec_id, round(0.45::DOUBLE * score / max(score) OVER (PARTITION BY query_id) + 0.55::DOUBLE * CASE WHEN vec_id % 3 = 0 THEN (vec_id % 11) / 10.0::DOUBLE ELSE 0 END, 8) AS blended FROM s",
    "q33_recall_mrr": f"WITH {VEC}, {_ranked('r')}, f AS (SELECT query_id, min(rank) FILTER (label = ql) AS r FROM r GROUP BY query_id) SELECT count(*) AS n_queries, round(avg((coalesce(r, 99) <= 1)::INT), 6) AS recall_1, round(avg((coalesce(r, 99) <= 3)::INT), 6) AS recall_3, round(avg((coalesce(r, 99) <= 5)::INT), 6) AS recall_5, round(avg((coalesce(r, 99) <= 10)::INT), 6) AS recall_10, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM f",
    "q34_bigram_similarity": r"WITH u AS (SELECT page_id, regexp_replace(lower(coalesce(url, '')), '[\s\p{Z}]+|[，。！？、；：,.!?;:]', '', 'g') AS url FROM pages), b AS (SELECT DISTINCT page_id, substr(url, i, 2) AS g FROM u, LATERAL (SELECT unnest(range(1, greatest(length(url), 2))) AS i) WHERE url <> ''), c AS (SELECT u.page_id, count(g) AS n FROM u LEFT JOIN b USING (page_id) GROUP BY 1), j AS (SELECT a.page_id, count(*) AS k FROM b a JOIN b n ON n.page_id - 1 = a.page_id AND n.g = a.g GROUP BY 1) SELECT a.page_id, round(CASE WHEN a.n + n.n > 0 THEN coalesce(k, 0) / (a.n + n.n - coalesce(k, 0)) ELSE 0 END, 6) AS similarity FROM c a JOIN c n ON n.page_id - 1 = a.page_id LEFT JOIN j ON j.page_id = a.page_id",
    "q35_dedupe_keep_first": "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1",
    "q36_upsert": "WITH c AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer), n AS (SELECT id + 5 AS id, 'new-' || name AS name, balance * 2 AS balance FROM c WHERE id % 10 = 0) SELECT * FROM c WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n",
    "q37_tombstone_counts": "SELECT o_orderstatus AS status, count(*) AS n_rows, count(*) FILTER (o_orderkey % 9 = 0) AS n_deleted FROM orders GROUP BY 1",
    "q38_resume_pending": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "q39_label_update": "SELECT d.doc_id, coalesce(l.quality, -1)::INTEGER AS quality, coalesce(l.toxic, -1)::INTEGER AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
    "q42_monthly_top_fill": "SELECT o_orderkey, month, is_best FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_totalprice DESC, o_orderkey) = 1 AS is_best FROM orders) ORDER BY is_best DESC, o_totalprice DESC, o_orderkey LIMIT 100",
    "q50_token_estimate": "SELECT doc_id, trunc(len(regexp_extract_all(coalesce(text, ''), '[一-鿿]')) / 1.5 + (length(coalesce(text, '')) - len(regexp_extract_all(coalesce(text, ''), '[一-鿿]'))) / 4)::BIGINT AS n_tokens FROM documents",
    "q51_source_eligibility": "SELECT source, lang, n, chars, round(n / sum(n) OVER (PARTITION BY source), 6) AS share FROM (SELECT source, lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1, 2)",
}
QUERIES = {k: v for k, v in globals().items() if k.startswith("q") and callable(v)}
