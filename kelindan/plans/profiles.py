"""Profiles of groups by tag and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelindan.operators import evidence as E
from kelindan.operators import profiles as H
from kelindan.functions import normalize as N
from kelindan.plans.domain import PREP, comments, makers, mass, members
from kelindan.plans.registry import Registry, table

R = Registry()

_GROUP = "(ascii(right(username, 1)) % 7)"


def _members(spark, d, prep):
    return members(prep, makers(spark, d)).withColumn("hcc_id", F.expr("cast(ascii(right(username, 1)) % 7 as bigint)"))


_VT = """, vt AS (SELECT DISTINCT video_url AS video, unnest(list_filter(list_transform(string_split(coalesce(hashtags, ''), ';'), lambda t: regexp_replace(lower(trim(t)), '^#+', '')), lambda t: length(t) >= 3)) AS tag FROM video_metadata_clean),
mem AS (SELECT username, (ascii(right(username, 1)) % 7)::BIGINT AS hcc_id FROM members)"""
_H1 = PREP + _VT + """, prof AS (SELECT hcc_id, tag AS hashtag, count(DISTINCT video) AS frequency, count(DISTINCT video) AS n_videos, count(DISTINCT username) AS n_users_exposed
 FROM seen JOIN mem USING (username) JOIN vt USING (video) GROUP BY 1, 2)"""


def _profile(spark, d):
    prep = comments(spark, d)
    videos = table(spark, d, "video_metadata_clean").select(F.col("video_url").alias("video"), F.explode(N.tag_list(F.col("hashtags"), ())).alias("tag"))
    return H.tag_profile(E.incidence(prep), videos, _members(spark, d, prep))


@R.query("h1_tag_profile", _H1 + " SELECT * FROM prof")
def h1_tag_profile(spark, d):
    return _profile(spark, d)


#: hcc_hashtag_profile once per group and cleaned tag.
_CLEAN = """WITH prof AS (SELECT hcc_id, lower(regexp_replace(trim(hashtag), '^[#@\\s]+', '')) AS hashtag, sum(coalesce(frequency, 0))::BIGINT AS frequency, sum(coalesce(n_videos, 0))::BIGINT AS n_videos, max(coalesce(n_users_exposed, 0)) AS n_users_exposed
 FROM (SELECT DISTINCT hcc_id, hashtag, frequency, n_videos, n_users_exposed FROM hcc_hashtag_profile) GROUP BY 1, 2)"""


def _clean(spark, d):
    rows = table(spark, d, "hcc_hashtag_profile").select("hcc_id", "hashtag", "frequency", "n_videos", "n_users_exposed").distinct()
    tag = F.lower(F.regexp_replace(F.trim("hashtag"), r"^[#@\s]+", ""))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.groupBy("hcc_id", tag.alias("hashtag")).agg(F.sum(zero("frequency")).alias("frequency"), F.sum(zero("n_videos")).alias("n_videos"), F.max(zero("n_users_exposed")).alias("n_users_exposed"))


@R.query("h2_ranked_tags", _CLEAN + """ SELECT *, CASE WHEN n_users_exposed > 0 THEN round(frequency / n_users_exposed, 3) END AS rate,
 row_number() OVER (PARTITION BY hcc_id ORDER BY frequency DESC, hashtag)::INT AS rank_frequency, row_number() OVER (PARTITION BY hcc_id ORDER BY n_users_exposed DESC, hashtag)::INT AS rank_exposed FROM prof""")
def h2_ranked_tags(spark, d):
    return H.ranked_tags(_clean(spark, d))


@R.query("h3_group_summary", _CLEAN + """, r AS (SELECT *, row_number() OVER (PARTITION BY hcc_id ORDER BY frequency DESC, hashtag) AS k FROM prof)
 SELECT hcc_id, count(*) AS n_tags, sum(frequency)::BIGINT AS total, max(CASE WHEN k = 1 THEN hashtag END) AS top_tag, string_agg(hashtag, ';' ORDER BY k) FILTER (k <= 5) AS top_list,
 CASE WHEN sum(frequency) > 0 THEN round(max(frequency) / sum(frequency), 3) END AS dominant_share FROM r GROUP BY 1""")
def h3_group_summary(spark, d):
    return H.group_summary(_clean(spark, d))


@R.query("h4_tag_matrix", _CLEAN + """ SELECT hcc_id, coalesce(sum(frequency) FILTER (hashtag = 'fyp'), 0)::BIGINT AS fyp, coalesce(sum(frequency) FILTER (hashtag = 'skincare'), 0)::BIGINT AS skincare,
 coalesce(sum(frequency) FILTER (hashtag = 'viral'), 0)::BIGINT AS viral FROM prof GROUP BY 1""")
def h4_tag_matrix(spark, d):
    return H.matrix(_clean(spark, d), ["fyp", "skincare", "viral"])


@R.query("h5_top_tags", _CLEAN + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hcc_id ORDER BY frequency DESC, hashtag)::INT AS rank FROM prof) WHERE rank <= 3")
def h5_top_tags(spark, d):
    return H.top_tags(_clean(spark, d), 3)


@R.query("h9_copypasta", """SELECT hcc_id, normalized_comment, count(*) AS n_rows, sum(n_users)::BIGINT AS n_users, sum(n_comments)::BIGINT AS n_comments FROM hcc_copypasta_candidates
 WHERE normalized_comment IS NOT NULL GROUP BY 1, 2 HAVING sum(n_users) >= 2 AND sum(n_comments) >= 2""")
def h9_copypasta(spark, d):
    rows = table(spark, d, "hcc_copypasta_candidates").where("normalized_comment is not null")
    sums = rows.groupBy("hcc_id", "normalized_comment").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_users").alias("n_users"), F.sum("n_comments").alias("n_comments"))
    return sums.where("n_users >= 2 and n_comments >= 2")


_SCOPES = PREP + """, sc AS (SELECT 'All' AS scope, ts, username, video FROM prep UNION ALL SELECT 'Community', ts, username, video FROM prep WHERE username IN (SELECT username FROM members)
 UNION ALL SELECT 'Mass', ts, username, video FROM prep WHERE username IN (SELECT username FROM mass)),
loc AS (SELECT *, isodow(ts + INTERVAL 7 HOUR)::INT AS weekday_number, hour(ts + INTERVAL 7 HOUR)::INT AS hour_local FROM sc WHERE ts IS NOT NULL)"""


def _scopes(spark, d):
    prep, creators = comments(spark, d), makers(spark, d)
    cols = ["scope", "ts", "username", "video"]
    every = prep.withColumn("scope", F.lit("All")).select(cols)
    inside = prep.join(members(prep, creators), "username", "left_semi").withColumn("scope", F.lit("Community")).select(cols)
    outside = prep.join(mass(prep, creators), "username", "left_semi").withColumn("scope", F.lit("Mass")).select(cols)
    return every.unionByName(inside).unionByName(outside)


@R.query("h10_time_grid", _SCOPES + """, c AS (SELECT scope, weekday_number, hour_local, count(*) AS n_comments, count(DISTINCT username) AS n_accounts, count(DISTINCT video) AS n_unique_videos FROM loc GROUP BY 1, 2, 3),
 g AS (SELECT scope, (x // 24 + 1)::INT AS weekday_number, (x % 24)::INT AS hour_local FROM (SELECT DISTINCT scope FROM loc), range(168) t(x))
 SELECT scope, weekday_number, hour_local, coalesce(n_comments, 0) AS n_comments, coalesce(n_accounts, 0) AS n_accounts, coalesce(n_unique_videos, 0) AS n_unique_videos,
 round(100.0::DOUBLE * coalesce(n_comments, 0) / sum(coalesce(n_comments, 0)) OVER (PARTITION BY scope), 3) AS share_percent FROM g LEFT JOIN c USING (scope, weekday_number, hour_local)""")
def h10_time_grid(spark, d):
    return H.time_grid(_scopes(spark, d), "scope")


_MEMLOC = PREP + """, loc AS (SELECT (ascii(right(username, 1)) % 7)::BIGINT AS hcc_id, isodow(ts + INTERVAL 7 HOUR)::INT AS weekday_number, hour(ts + INTERVAL 7 HOUR)::INT AS hour_local FROM prep JOIN members USING (username) WHERE ts IS NOT NULL)"""


def _member_comments(spark, d):
    prep = comments(spark, d)
    return prep.join(_members(spark, d, prep), "username")


@R.query("h11_active_groups", _MEMLOC + " SELECT weekday_number, hour_local, count(DISTINCT hcc_id) AS n_groups, string_agg(DISTINCT hcc_id::VARCHAR, ';' ORDER BY hcc_id::VARCHAR) AS groups FROM loc GROUP BY 1, 2")
def h11_active_groups(spark, d):
    return H.active_groups(_member_comments(spark, d), "hcc_id")


@R.query("h12_group_rhythm", _MEMLOC + """, c AS (SELECT hcc_id, hour_local, count(*) AS n FROM loc GROUP BY 1, 2), b AS (SELECT hcc_id, hour_local, n, row_number() OVER (PARTITION BY hcc_id ORDER BY n DESC, hour_local) AS r FROM c)
 SELECT t.hcc_id, t.n AS n_comments, b.hour_local AS dominant_hour, round(b.n / t.n, 3) AS concentration, round(100.0::DOUBLE * w / t.n, 3) AS weekend_percent
 FROM (SELECT hcc_id, count(*) AS n, count_if(weekday_number >= 6) AS w FROM loc GROUP BY 1) t JOIN b ON b.hcc_id = t.hcc_id AND r = 1""")
def h12_group_rhythm(spark, d):
    return H.group_rhythm(_member_comments(spark, d), "hcc_id")
