"""Coordination evidence over comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelindan.functions import normalize as N
from kelindan.operators import evidence as E
from kelindan.operators import graph as G
from kelindan.plans.domain import PREP, account_sql, comments, makers, mass, members, sides
from kelindan.plans.registry import Registry, table
from kelindan.session import stage

R = Registry()


@R.query("c1_prepare", PREP + " SELECT comment_id, username, parent_user, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text, parent_user IS NOT NULL AS is_reply, length(text) AS n_chars FROM prep")
def c1_prepare(spark, d):
    return comments(spark, d, None).select("comment_id", "username", "parent_user", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"), "is_reply", F.length("text").cast("bigint").alias("n_chars"))


@R.query("c2_mass_accounts", PREP + " SELECT username FROM mass")
def c2_mass_accounts(spark, d):
    return mass(comments(spark, d), makers(spark, d))


_CONV = """, pairs AS (SELECT DISTINCT least(a.username, b.username) AS source, greatest(a.username, b.username) AS target, a.video
  FROM seen a JOIN seen b USING (video) WHERE a.username IN (SELECT username FROM members) AND b.username IN (SELECT username FROM mass)),
conv AS (SELECT source, target, count(*) AS w FROM pairs GROUP BY 1, 2)"""
_REPLY = """, dir AS (SELECT username, parent_user, count(comment_id) AS n, count(DISTINCT video) AS v FROM prep WHERE username <> parent_user GROUP BY 1, 2),
reply AS (SELECT least(username, parent_user) AS source, greatest(username, parent_user) AS target, sum(n)::BIGINT AS n, max(v) AS w FROM dir GROUP BY 1, 2)"""
_GAPS = """, gaps AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY video ORDER BY ts) AS g FROM prep WHERE ts IS NOT NULL AND video IS NOT NULL),
win AS (SELECT greatest(1, round_even(quantile_cont(g, 0.5) / 60e6, 0))::BIGINT AS m FROM gaps WHERE g IS NOT NULL)"""
_TEMPORAL = """, side AS (SELECT p.username, video, epoch_us(ts) AS t, CASE WHEN p.username IN (SELECT username FROM members) THEN 1 ELSE 2 END AS s
  FROM prep p WHERE ts IS NOT NULL AND video IS NOT NULL AND (p.username IN (SELECT username FROM members) OR p.username IN (SELECT username FROM mass))),
temporal AS (SELECT source, target, count(*) AS w FROM (SELECT DISTINCT least(a.username, b.username) AS source, greatest(a.username, b.username) AS target, a.video
  FROM side a JOIN side b ON a.video = b.video AND a.s <> b.s AND b.t - a.t BETWEEN 0 AND 7776000000000) GROUP BY 1, 2)"""
#: Minutes of the co-temporal window and least weights. The test tables spread over two years, so the window is
#: ninety days (the original data's calibrated window is 9 minutes) and two common videos suffice (there three).
WINDOW, LEAST = 90 * 24 * 60, 2


@R.query("c3_co_conv", PREP + _CONV + " SELECT source, target, w AS co_conv_weight FROM conv WHERE w >= 2")
def c3_co_conv(spark, d):
    prep, creators = comments(spark, d), makers(spark, d)
    return E.co_conv(E.incidence(prep), members(prep, creators), mass(prep, creators), LEAST)


@R.query("c4_co_reply", PREP + _REPLY + " SELECT source, target, n AS reply_count, w AS co_reply_weight, w >= 2 AS passes FROM reply")
def c4_co_reply(spark, d):
    return E.co_reply(comments(spark, d, None))


@R.query("c5_window", PREP + _GAPS + " SELECT m AS window_minutes FROM win")
def c5_window(spark, d):
    return E.calibrated_window(comments(spark, d, None))


@R.query("c6_co_temporal", PREP + _TEMPORAL + " SELECT source, target, w AS co_temporal_weight FROM temporal WHERE w >= 2")
def c6_co_temporal(spark, d):
    prep, creators = comments(spark, d), makers(spark, d)
    return E.co_temporal(prep, WINDOW, members(prep, creators), mass(prep, creators), LEAST)


def _edges(spark, d, prep=None):
    """Pairs that pass any threshold, with all three weights; ``prep`` if the comments are prepared already."""
    prep = comments(spark, d) if prep is None else prep
    creators = makers(spark, d)
    conv, temporal = E.shared_and_near(prep, sides(prep, creators), WINDOW, LEAST)
    reply = E.co_reply(prep).where("passes")
    return E.combine(
        conv.withColumnRenamed("co_conv_weight", "weight"), reply.withColumnRenamed("co_reply_weight", "weight"), temporal.withColumnRenamed("co_temporal_weight", "weight"),
    )


_COMBINED = _CONV + _REPLY + _TEMPORAL + """, parts AS (
  SELECT source, target, w::DOUBLE AS c, 0.0::DOUBLE AS r, 0.0::DOUBLE AS t FROM conv WHERE w >= 2 UNION ALL SELECT source, target, 0, w, 0 FROM reply WHERE w >= 2
  UNION ALL SELECT source, target, 0, 0, w FROM temporal WHERE w >= 2),
e AS (SELECT source, target, max(c) AS c, max(r) AS r, max(t) AS t FROM parts GROUP BY 1, 2),
m AS (SELECT max(c) AS mc, max(r) AS mr, max(t) AS mt FROM e),
edges AS (SELECT source, target, c AS co_conv, r AS co_reply, t AS co_temporal,
  CASE WHEN mc > 0 THEN c / mc ELSE 0 END AS co_conv_norm, CASE WHEN mr > 0 THEN r / mr ELSE 0 END AS co_reply_norm, CASE WHEN mt > 0 THEN t / mt ELSE 0 END AS co_temporal_norm,
  (c > 0)::INT + (r > 0)::INT + (t > 0)::INT AS n_evidence FROM e, m),
weighted AS (SELECT *, co_conv_norm + co_reply_norm + co_temporal_norm AS final_weight,
  CASE WHEN n_evidence = 3 THEN 'All three evidence' WHEN n_evidence = 2 THEN concat_ws(' + ', CASE WHEN co_conv > 0 THEN 'Co-conv' END, CASE WHEN co_reply > 0 THEN 'Co-reply' END, CASE WHEN co_temporal > 0 THEN 'Co-temporal' END)
  ELSE CASE WHEN co_conv > 0 THEN 'Co-conv' WHEN co_reply > 0 THEN 'Co-reply' ELSE 'Co-temporal' END || ' only' END AS evidence FROM edges)"""


@R.query("c7_combined", PREP + _COMBINED + " SELECT source, target, co_conv, co_reply, co_temporal, co_conv_norm, co_reply_norm, co_temporal_norm, round(final_weight, 9) AS final_weight, n_evidence, evidence FROM weighted")
def c7_combined(spark, d):
    return _edges(spark, d).withColumn("final_weight", F.round("final_weight", 9))


@R.query("c8_evidence_labels", PREP + _COMBINED + " SELECT evidence, count(*) AS n_pairs, round(sum(final_weight), 6) AS total_weight FROM weighted GROUP BY 1")
def c8_evidence_labels(spark, d):
    return _edges(spark, d).groupBy("evidence").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.sum("final_weight"), 6).alias("total_weight"))


@R.query("c9_edge_filter", PREP + _COMBINED + " SELECT source, target, round(final_weight, 9) AS final_weight FROM weighted, (SELECT quantile_cont(final_weight, 0.9) AS cut FROM weighted) WHERE final_weight >= cut - 1e-12")
def c9_edge_filter(spark, d):
    return E.above_percentile(stage(_edges(spark, d), "edges"), share=0.9).select("source", "target", F.round("final_weight", 9).alias("final_weight"))


_TAGS = """, vt AS (SELECT DISTINCT video_url AS video, unnest(list_filter(list_transform(string_split(coalesce(hashtags, ''), ';'), lambda t: regexp_replace(lower(trim(t)), '^#+', '')), lambda t: length(t) >= 3)) AS tag FROM video_metadata_clean),
atag AS (SELECT DISTINCT username, tag FROM seen JOIN vt USING (video) WHERE tag NOT IN ('fyp', 'viral', 'skincare', 'foryou', 'foryoupage', 'trending', 'tiktok', 'skincarerutine', 'skincareroutine', 'skintok', 'fypviralindonesia', 'fyppppppppppppppppppppppppp', 'fypage', 'viraltiktok', 'masukberanda', 'xyzbca', 'foryoupageofficiall', 'beranda', 'racuntiktok', 'racunskincare'))"""


def account_tags(spark, d, seen):
    """Distinct (username, tag) through the videos an account commented on."""
    videos = table(spark, d, "video_metadata_clean").select(F.col("video_url").alias("video"), F.explode(N.tag_list(F.col("hashtags"))).alias("tag")).distinct()
    return seen.join(videos, "video").select("username", "tag").distinct()


@R.query("c10_co_hashtag", PREP + _REPLY + _TAGS + """ SELECT source, target, count(b.tag) AS co_hashtag FROM reply LEFT JOIN atag a ON a.username = source
 LEFT JOIN atag b ON b.username = target AND b.tag = a.tag GROUP BY 1, 2""")
def c10_co_hashtag(spark, d):
    prep = comments(spark, d)
    return E.co_tags(E.co_reply(prep), account_tags(spark, d, E.incidence(prep)))


@R.query("c11_lossy_keys", """WITH v AS (SELECT DISTINCT video_id, try_cast(video_id AS DOUBLE) AS x FROM video_metadata_clean WHERE video_id IS NOT NULL)
SELECT video_id, regexp_replace(regexp_replace(replace(printf('%.5E', x), 'E+', 'E+'), '(\\.[0-9]*?)0+E', '\\1E'), '\\.E', 'E') AS lossy FROM v WHERE x IS NOT NULL""")
def c11_lossy_keys(spark, d):
    ids = table(spark, d, "video_metadata_clean").select("video_id").where("video_id is not null").distinct()
    return ids.withColumn("lossy", N.lossy_id_key(F.col("video_id"))).where("lossy is not null")


@R.query("c12_tag_lists", """WITH v AS (SELECT row_no, list_filter(list_transform(string_split(coalesce(hashtags, ''), ';'), lambda t: regexp_replace(lower(trim(t)), '^#+', '')), lambda t: length(t) >= 3 AND t NOT IN ('fyp', 'viral', 'skincare', 'foryou', 'foryoupage', 'trending', 'tiktok', 'skincarerutine', 'skincareroutine', 'skintok', 'fypviralindonesia', 'fyppppppppppppppppppppppppp', 'fypage', 'viraltiktok', 'masukberanda', 'xyzbca', 'foryoupageofficiall', 'beranda', 'racuntiktok', 'racunskincare')) AS a FROM video_metadata_clean)
SELECT row_no, len(a)::INT AS n_tags, array_to_string(a, ';') AS tags FROM v""")
def c12_tag_lists(spark, d):
    tags = N.tag_list(F.col("hashtags"))
    return table(spark, d, "video_metadata_clean").select("row_no", F.size(tags).alias("n_tags"), F.array_join(tags, ";").alias("tags"))


@R.query("c13_oriented", PREP + _COMBINED + """ SELECT m.username AS community, CASE WHEN source = m.username THEN target ELSE source END AS other,
 CASE WHEN n_evidence >= 2 THEN 'MULTI_EVIDENCE' ELSE 'SINGLE_EVIDENCE' END AS scope, 'MASS_' || left(sha256('kelindan:' || CASE WHEN source = m.username THEN target ELSE source END), 12) AS public_id
 FROM weighted JOIN members m ON m.username IN (source, target) JOIN mass x ON x.username IN (source, target)""")
def c13_oriented(spark, d):
    prep, creators = comments(spark, d), makers(spark, d)
    return G.orient(_edges(spark, d), members(prep, creators), mass(prep, creators), "kelindan")


@R.query("c15_pseudonyms", PREP + " SELECT username, 'MASS_' || left(sha256('kelindan:' || username), 12) AS public_id FROM mass")
def c15_pseudonyms(spark, d):
    return mass(comments(spark, d), makers(spark, d)).withColumn("public_id", N.pseudonym(F.col("username"), "kelindan"))


@R.query("g3_degrees", PREP + _COMBINED + """, ends AS (SELECT source AS node, target AS other, final_weight FROM weighted UNION ALL SELECT target, source, final_weight FROM weighted)
 SELECT node, count(*) AS degree, count(DISTINCT other) AS n_neighbours, round(sum(final_weight), 6) AS weighted_degree FROM ends GROUP BY 1""")
def g3_degrees(spark, d):
    return G.degrees(_edges(spark, d), "final_weight").withColumn("weighted_degree", F.round("weighted_degree", 6))


_COMPONENTS = """, reach AS (SELECT source AS a, target AS b FROM weighted UNION SELECT target, source FROM weighted UNION SELECT source, source FROM weighted UNION SELECT target, target FROM weighted),
walk AS (SELECT a, b FROM reach UNION SELECT w.a, r.b FROM walk w JOIN reach r ON r.a = w.b),
comp AS (SELECT a AS node, min(b) AS component FROM walk GROUP BY 1)"""


@R.query("g2_components", PREP.replace("WITH raw", "WITH RECURSIVE raw", 1) + _COMBINED + _COMPONENTS + " SELECT node, component FROM comp")
def g2_components(spark, d):
    from kelindan.operators.components import connected_components

    return connected_components(_edges(spark, d), "source", "target")


@R.query("g7_density", PREP.replace("WITH raw", "WITH RECURSIVE raw", 1) + _COMBINED + _COMPONENTS + """ SELECT component, n AS n_nodes, e AS n_edges, round(2.0 * e / (n * (n - 1)), 9) AS density, round(2.0 * e / n, 9) AS average_degree,
 round(2.0 * w / n, 9) AS average_weighted_degree, round(x, 9) AS max_weight FROM (SELECT component, count(*) AS n FROM comp GROUP BY 1) JOIN
 (SELECT component, count(*) AS e, sum(final_weight) AS w, max(final_weight) AS x FROM weighted JOIN comp ON node = source GROUP BY 1) USING (component)""")
def g7_density(spark, d):
    from kelindan.operators.components import connected_components

    edges = stage(_edges(spark, d), "edges")
    return G.group_density(edges, connected_components(edges, "source", "target"), "final_weight")


@R.query("g9_topology", PREP + _COMBINED + """ SELECT count(*) AS n_edges, count_if(source = target) AS self_loops, count(*) - count(DISTINCT (source, target)) AS duplicates,
 count_if(source IS NULL OR target IS NULL OR trim(source) = '' OR trim(target) = '') AS blank_endpoints,
 (SELECT count(DISTINCT x) FROM (SELECT unnest([source, target]) AS x FROM weighted) WHERE x NOT IN (SELECT username FROM seen)) AS missing_endpoints FROM weighted""")
def g9_topology(spark, d):
    return G.topology_audit(_edges(spark, d), E.incidence(comments(spark, d)).select(F.col("username").alias("node")).distinct())


@R.query("g13_edge_summary", PREP + _COMBINED + """, typed AS (SELECT *, least(ts, tt) || '–' || greatest(ts, tt) AS pair_type FROM (SELECT *, CASE WHEN source IN (SELECT username FROM members) THEN 'Community' WHEN source IN (SELECT username FROM makers) THEN 'Individual' ELSE 'Mass' END AS ts,
  CASE WHEN target IN (SELECT username FROM members) THEN 'Community' WHEN target IN (SELECT username FROM makers) THEN 'Individual' ELSE 'Mass' END AS tt FROM weighted))
 SELECT pair_type, count(*) AS n_edges, round(sum(final_weight), 6) AS total_weight, (SELECT count(DISTINCT x) FROM (SELECT unnest([source, target]) AS x, pair_type AS p FROM typed) WHERE p = pair_type) AS n_nodes FROM typed GROUP BY 1""")
def g13_edge_summary(spark, d):
    prep, creators = comments(spark, d), makers(spark, d)
    kinds = members(prep, creators).withColumn("kind", F.lit("Community")).unionByName(creators.withColumn("kind", F.lit("Individual")))
    return G.edge_summary(_edges(spark, d, prep), kinds.withColumnRenamed("username", "node"), "Mass", "final_weight")


@R.query("g10_aggregate_graph", PREP + _REPLY + """, k AS (SELECT *, CASE WHEN source IN (SELECT username FROM members) THEN 'Community' WHEN source IN (SELECT username FROM makers) THEN 'Individual' ELSE 'Mass' END AS s,
  CASE WHEN target IN (SELECT username FROM members) THEN 'Community' WHEN target IN (SELECT username FROM makers) THEN 'Individual' ELSE 'Mass' END AS t FROM reply)
 SELECT least(s, t) AS source, greatest(s, t) AS target, sum(n)::BIGINT AS weight, count(*) AS n_edges, round(ln(1 + sum(n)), 9) AS visual_weight FROM k GROUP BY 1, 2""")
def g10_aggregate_graph(spark, d):
    prep, creators = comments(spark, d), makers(spark, d)
    kinds = members(prep, creators).withColumn("kind", F.lit("Community")).unionByName(creators.withColumn("kind", F.lit("Individual")))
    return G.aggregate_graph(E.co_reply(prep), kinds.withColumnRenamed("username", "node"), "Mass", "reply_count")


@R.query("proj_p9_keep_first", """SELECT video_url, row_no, account FROM (SELECT video_url, row_no, """ + account_sql("creator") + """ AS account, row_number() OVER (PARTITION BY video_url ORDER BY crawled_at DESC, row_no DESC) AS r FROM video_metadata_clean) WHERE r = 1""")
def proj_p9_keep_first(spark, d):
    last = E.keep_first(table(spark, d, "video_metadata_clean"), ["video_url"], [F.desc("crawled_at"), F.desc("row_no")])
    return last.select("video_url", "row_no", N.account(F.col("creator")).alias("account"))
