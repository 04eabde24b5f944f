"""Text forms, similarity and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelindan.functions import normalize as N
from kelindan.operators import textsim as T
from kelindan.operators.joins import fuzzy_pairs, text_members
from kelindan.operators.packed import split_packed
from kelindan.plans.core_data import SPLIT_CTES
from kelindan.plans.domain import PREP, comments
from kelindan.plans.registry import Registry, table
from kelindan.session import stage

R = Registry()


@R.query("t1_similarity_text", r"""WITH a AS (SELECT comment_id, crawled_at, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM comments WHERE text IS NOT NULL),
 b AS (SELECT comment_id, crawled_at, CASE WHEN lower(t) NOT IN ('', 'nan', 'none', 'null', '<na>') THEN lower(regexp_replace(t, '[\x{200B}-\x{200F}\x{2060}\x{FE00}-\x{FE0F}]', '', 'g')) END AS t FROM a),
 c AS (SELECT comment_id, crawled_at, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '!!+', '!', 'g'), '\?\?+', '?', 'g'), '\.\.+', '.', 'g'), ',,+', ',', 'g') AS t FROM b)
 SELECT comment_id, strftime(crawled_at, '%Y-%m-%d %H:%M:%S') AS crawled, trim(regexp_replace(t, '\s+', ' ', 'g')) AS similarity_text FROM c""")
def t1_similarity_text(spark, d):
    return table(spark, d, "comments").where("text is not null").select("comment_id", F.date_format("crawled_at", "yyyy-MM-dd HH:mm:ss").alias("crawled"), N.similarity_text(F.col("text"), compose=False).alias("similarity_text"))


@R.query("t1_similarity_text_composed")
def t1_similarity_text_composed(spark, d):
    return table(spark, d, "video_metadata_clean").select("row_no", N.similarity_text(F.col("caption")).alias("similarity_text"))


@R.query("t2_token_jaccard", r"""WITH t AS (SELECT pair_id, list_distinct(regexp_extract_all(lower(comment_1), '[\pL\pM\pN_]+')) AS a, list_distinct(regexp_extract_all(lower(comment_2), '[\pL\pM\pN_]+')) AS b FROM comment_similarity_pairs WHERE comment_1 IS NOT NULL AND comment_2 IS NOT NULL)
 SELECT pair_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END, 9) AS jaccard FROM t""")
def t2_token_jaccard(spark, d):
    rows = table(spark, d, "comment_similarity_pairs").where("comment_1 is not null and comment_2 is not null")
    word = lambda c: F.regexp_extract_all(F.lower(F.col(c)), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), 1)
    return rows.select("pair_id", F.round(N.token_jaccard(word("comment_1"), word("comment_2")), 9).alias("jaccard"))


# Phrases that say nothing by themselves.
GENERIC = ("setuju kak", "iya kak", "makasih kak", "bagus banget", "aman gak", "spill dong", "mau coba", "hadir", "first", "fyp")


@R.query("t3_text_flags", r"""WITH t AS (SELECT comment_id, row_number() OVER (PARTITION BY comment_id ORDER BY crawled_at, source_file) AS k, lower(text) AS t FROM comments WHERE text IS NOT NULL AND comment_id IS NOT NULL)
 SELECT length(t) < 12 OR len(regexp_extract_all(t, '[\pL\pM\pN_]+')) < 3 AS is_short, t <> '' AND NOT regexp_matches(t, '[A-Za-z0-9_]') AS symbols_only, trim(regexp_replace(t, '[^\pL\pM\pN_\s]', ' ', 'g')) IN """ + str(GENERIC) + """ AS is_generic, count(*) AS n FROM t GROUP BY 1, 2, 3""")
def t3_text_flags(spark, d):
    t = F.lower("text")
    words = F.regexp_extract_all(t, F.lit(r"([\p{L}\p{M}\p{N}_]+)"), 1)
    phrase = F.trim(F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}_\s]", " "))
    rows = table(spark, d, "comments").where("text is not null and comment_id is not null")
    return rows.groupBy(((F.length(t) < 12) | (F.size(words) < 3)).alias("is_short"), ((t != "") & ~t.rlike("[A-Za-z0-9_]")).alias("symbols_only"), phrase.isin(*GENERIC).alias("is_generic")).agg(F.count(F.lit(1)).alias("n"))


_GRAMS = r"""WITH tx AS (SELECT DISTINCT lower(normalized_comment) AS text FROM hcc_copypasta_candidates WHERE normalized_comment <> ''),
 wd AS (SELECT text, ' ' || w || ' ' AS w FROM (SELECT text, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM tx)),
 gr AS (SELECT text, substr(w, i::INT, 5) AS gram FROM wd, LATERAL (SELECT unnest(range(1, greatest(length(w) - 4, 1) + 1)) AS i)),
 tf AS (SELECT text, gram, count(*) AS tf FROM gr GROUP BY 1, 2), dfr AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2),
 v AS (SELECT text, gram, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM tx)) / (1 + df)) + 1) AS v FROM tf JOIN dfr USING (gram)),
 ww AS (SELECT text, gram, v / sqrt(sum(v * v) OVER (PARTITION BY text)) AS w FROM v),
 sims AS (SELECT a.text AS a, b.text AS b, least(sum(a.w * b.w), 1) AS score FROM ww a JOIN ww b ON a.gram = b.gram AND a.text < b.text GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.7)"""


def _sims(spark, d):
    texts = stage(T.distinct_texts(table(spark, d, "hcc_copypasta_candidates").select(F.lower("normalized_comment").alias("t")), "t"), "texts")
    return texts, T.similar_texts(T.tfidf(texts))


def _named(texts, pairs):
    a, b = texts.select(F.col("text_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("text_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select(F.least("ta", "tb").alias("text_1"), F.greatest("ta", "tb").alias("text_2"), "score")


@R.query("t5_similar_texts", _GRAMS + " SELECT a AS text_1, b AS text_2, round(score, 6) AS score FROM sims")
def t5_similar_texts(spark, d):
    texts, pairs = _sims(spark, d)
    return _named(texts, pairs).withColumn("score", F.round("score", 6))


@R.query("t5_nearest", _GRAMS + """, bo AS (SELECT a, b, score FROM sims UNION ALL SELECT b, a, score FROM sims), rk AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, b) AS r FROM bo)
 SELECT least(a, b) AS text_1, greatest(a, b) AS text_2, round(max(score), 6) AS score FROM rk WHERE r <= 20 GROUP BY 1, 2""")
def t5_nearest(spark, d):
    texts, pairs = _sims(spark, d)
    named = _named(texts, pairs).withColumnsRenamed({"text_1": "a", "text_2": "b"})  # equal scores go by text, as in the SQL
    return T.nearest(named).select(F.col("a").alias("text_1"), F.col("b").alias("text_2"), F.round("score", 6).alias("score"))


@R.query("t6_bands", _GRAMS + " SELECT CASE WHEN score >= 0.92 THEN 'NEAR_EXACT' WHEN score >= 0.85 THEN 'HIGH_SIMILARITY' WHEN score >= 0.75 THEN 'MODERATE_SIMILARITY' ELSE 'WEAK_SIMILARITY' END AS band, count(*) AS n FROM sims GROUP BY 1")
def t6_bands(spark, d):
    _, pairs = _sims(spark, d)
    return pairs.groupBy(T.band(F.col("score"), F.lit(False)).alias("band")).agg(F.count(F.lit(1)).alias("n"))


_CC = _GRAMS.replace("WITH tx", "WITH RECURSIVE tx", 1) + """, li AS (SELECT a, b, score FROM sims WHERE score >= 0.85), ed AS (SELECT a, b FROM li UNION SELECT b, a FROM li), rc AS (SELECT a, b FROM ed UNION SELECT r.a, e.b FROM rc r JOIN ed e ON e.a = r.b),
 cl AS (SELECT a AS text, least(a, min(b)) AS cluster FROM rc GROUP BY 1)"""


@R.query("t11_cluster_sizes", _CC + """, sz AS (SELECT cluster, count(*) AS n_texts FROM cl GROUP BY 1), lk AS (SELECT cluster, count(*) AS n_links, min(score) AS cohesion FROM li JOIN cl ON cl.text = li.a GROUP BY 1)
 SELECT n_texts, n_links, round(2.0::DOUBLE * n_links / (n_texts * (n_texts - 1)), 9) AS density, count(*) AS n_clusters FROM sz JOIN lk USING (cluster) GROUP BY 1, 2, 3""")
def t11_cluster_sizes(spark, d):
    _, pairs = _sims(spark, d)
    pairs = stage(pairs, "pairs")
    return T.cluster_summary(T.clusters(pairs), pairs).groupBy("n_texts", "n_links", "density").agg(F.count(F.lit(1)).alias("n_clusters"))


@R.query("t7_exact_groups", PREP + """, g AS (SELECT text, username, video FROM prep WHERE text <> ''), u AS (SELECT text, username, count(*) AS n FROM g GROUP BY 1, 2)
 SELECT text, n_rows, n_accounts, n_videos, (n_rows * (n_rows - 1)) // 2 AS n_pairs, same AS n_same_account_pairs, (n_rows * (n_rows - 1)) // 2 - same AS n_cross_account_pairs
 FROM (SELECT text, sum(n)::BIGINT AS n_rows, count(username) AS n_accounts, coalesce(sum((n * (n - 1)) // 2) FILTER (username IS NOT NULL), 0)::BIGINT AS same FROM u GROUP BY 1 HAVING sum(n) > 1) JOIN (SELECT text, count(DISTINCT video) AS n_videos FROM g GROUP BY 1) USING (text)""")
def t7_exact_groups(spark, d):
    return T.exact_groups(comments(spark, d, None), "text", "username", "video")


@R.query("t8_numbered", "SELECT pair_id, 'SIM_PAIR_' || lpad(row_number() OVER (ORDER BY cosine_similarity_char5 DESC NULLS LAST, pair_id)::VARCHAR, 9, '0') AS number FROM comment_similarity_pairs")
def t8_numbered(spark, d):
    rows = table(spark, d, "comment_similarity_pairs").select("pair_id", "cosine_similarity_char5")
    return T.numbered(rows, [F.desc_nulls_last("cosine_similarity_char5"), F.col("pair_id")], "SIM_PAIR_", 9, buckets=8).select("pair_id", "number")


@R.query("t13_bounded_join", PREP + """, s AS (SELECT username, list_sort(list_distinct(list(video))) AS a FROM seen GROUP BY 1)
 SELECT username, array_to_string(a[1:12], ';') || CASE WHEN len(a) > 12 THEN ';...(+' || (len(a) - 12) || ')' ELSE '' END AS videos FROM s""")
def t13_bounded_join(spark, d):
    from kelindan.operators.evidence import incidence

    return T.bounded_lists(incidence(comments(spark, d, None)), "username", "video").withColumnRenamed("values", "videos")


@R.query("t14_common_values", """WITH c AS (SELECT creator AS k, product_category AS v, count(*) AS n FROM video_metadata_clean WHERE trim(product_category) <> '' AND creator IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, v) AS r FROM c)
 SELECT k AS creator, string_agg(v, ' || ' ORDER BY r) AS common FROM r WHERE r <= 4 GROUP BY 1""")
def t14_common_values(spark, d):
    return T.common_values(table(spark, d, "video_metadata_clean").where("creator is not null"), "creator", "product_category")


@R.query("t22_exploded_summary", "WITH " + SPLIT_CTES + """, u AS (SELECT hcc_id, coalesce(item, 'Not identified') AS value FROM (SELECT DISTINCT candidate_id, hcc_id FROM hcc_copypasta_candidates)
 LEFT JOIN (SELECT row_key, item FROM items WHERE src_field = 'users') ON row_key = candidate_id)
 SELECT value, count(*) AS n, count(DISTINCT hcc_id) AS n_groups FROM u GROUP BY 1""")
def t22_exploded_summary(spark, d):
    rows = table(spark, d, "hcc_copypasta_candidates").select("candidate_id", "hcc_id", F.explode_outer(split_packed(F.col("users"))).alias("u"))
    counts = rows.groupBy(F.coalesce("u", F.lit("Not identified")).alias("value"), "hcc_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("value").agg(F.sum("n").alias("n"), F.count("hcc_id").alias("n_groups"))


@R.query("t23_comment_links", """SELECT DISTINCT comment_id, regexp_replace(video_url, '[?#].*$', '') || '?comment_id=' || comment_id AS link FROM comments WHERE comment_id IS NOT NULL AND video_url IS NOT NULL""")
def t23_comment_links(spark, d):
    rows = table(spark, d, "comments").where("comment_id is not null and video_url is not null")
    return rows.select("comment_id", N.url_with_param(F.col("video_url"), "comment_id", F.col("comment_id")).alias("link")).distinct()


@R.query("t24_display_text")
def t24_display_text(spark, d):
    return table(spark, d, "comment_similarity_pairs").select("pair_id", N.display_text(F.col("comment_2")).alias("shown"))


@R.query("m_text_model_forms")
def m_text_model_forms(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text")
    return rows.select("doc_id", N.model_text(F.col("text")).alias("social"), N.model_text(F.col("text"), "squeezed").alias("squeezed"), N.model_text(F.col("text"), "plain").alias("plain"))


@R.query("j18_fuzzy_pairs")
def j18_fuzzy_pairs(spark, d):
    return fuzzy_pairs(table(spark, d, "hcc_copypasta_candidates"), "candidate_id", "normalized_comment")


@R.query("j18_text_members", """SELECT candidate_id AS key, min(candidate_id) OVER (PARTITION BY normalized_comment) AS text_id FROM hcc_copypasta_candidates WHERE normalized_comment IS NOT NULL""")
def j18_text_members(spark, d):
    """The rows behind the texts that ``j18_fuzzy_pairs`` names."""
    return text_members(table(spark, d, "hcc_copypasta_candidates"), "candidate_id", "normalized_comment")


@R.query("m42_score_once", """WITH t AS (SELECT text, count(*) AS n FROM comments WHERE text IS NOT NULL GROUP BY 1),
 s AS (SELECT n, (regexp_matches(text, 'https?://|www[.]'))::INT + (regexp_matches(text, '@[A-Za-z0-9_]'))::INT + (regexp_matches(text, '#[A-Za-z0-9_]'))::INT + (regexp_matches(text, '[!?][!?]'))::INT + (NOT regexp_matches(text, '[A-Za-z0-9]'))::INT AS score FROM t)
 SELECT score::BIGINT AS score, sum(n)::BIGINT AS n_rows, count(*) AS n_texts FROM s GROUP BY 1""")
def m42_score_once(spark, d):
    """Each distinct text is scored once (by the number of its quality flags) and the score counts for all its rows."""
    once = table(spark, d, "comments").where("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    t = F.col("text")
    marks = (t.rlike("https?://|www[.]"), t.rlike("@[A-Za-z0-9_]"), t.rlike("#[A-Za-z0-9_]"), t.rlike("[!?][!?]"), ~t.rlike("[A-Za-z0-9]"))
    score = sum((m.cast("bigint") for m in marks[1:]), marks[0].cast("bigint"))
    return once.groupBy(score.alias("score")).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_texts"))
