"""Accounts and groups: replies, associations, winners, totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelindan.operators import evidence as E
from kelindan.operators import typology as A
from kelindan.functions import normalize as N
from kelindan.plans.domain import PREP, comments, makers, mass, members
from kelindan.plans.registry import Registry, table

R = Registry()

_PAR = PREP + """, par AS (SELECT p.*, q.username AS p_user, q.video AS p_video, q.ts AS p_ts FROM prep p LEFT JOIN prep q ON q.comment_id = p.parent_comment_id WHERE p.parent_comment_id IS NOT NULL),
stat AS (SELECT *, (epoch_us(ts) - epoch_us(p_ts)) / 60e6 AS lag_minutes, CASE WHEN p_video IS NULL THEN 'UNRESOLVED_PARENT' WHEN video IS DISTINCT FROM p_video THEN 'INVALID_PARENT_REFERENCE'
 WHEN parent_user IS NOT NULL AND parent_user IS DISTINCT FROM p_user THEN 'PROBABLE_REPLY_REFERENCE'
 WHEN (username IN (SELECT username FROM members) AND p_user IN (SELECT username FROM mass)) OR (username IN (SELECT username FROM mass) AND p_user IN (SELECT username FROM members)) THEN 'VERIFIED_DIRECT_REPLY'
 ELSE 'VALID_PARENT_OTHER_ACTOR_PAIR' END AS status FROM par)"""


def _replies(spark, d):
    prep, creators = comments(spark, d), makers(spark, d)
    return A.reply_status(A.with_parent(prep), members(prep, creators), mass(prep, creators))


@R.query("a8_reply_status", _PAR + " SELECT status, count(*) AS n, round(avg(lag_minutes), 6) AS mean_lag FROM stat GROUP BY 1")
def a8_reply_status(spark, d):
    return _replies(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lag_minutes"), 6).alias("mean_lag"))


@R.query("a9_direct_pairs", _PAR + """, pr AS (SELECT username, p_user, count(*) AS n_replies, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at, round(median(lag_minutes), 6) AS median_lag,
 round(min(lag_minutes), 6) AS min_lag, round(max(lag_minutes), 6) AS max_lag FROM stat WHERE status IN ('VERIFIED_DIRECT_REPLY', 'VALID_PARENT_OTHER_ACTOR_PAIR') AND username IS NOT NULL AND p_user IS NOT NULL GROUP BY 1, 2)
 SELECT a.*, b.username IS NOT NULL AS reciprocal FROM pr a LEFT JOIN pr b ON a.username = b.p_user AND a.p_user = b.username""")
def a9_direct_pairs(spark, d):
    pairs = A.direct_pairs(_replies(spark, d))
    text = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_at", "last_at")}
    return pairs.withColumns(text | {c: F.round(c, 6) for c in ("median_lag", "min_lag", "max_lag")})


@R.query("j12_parent_join", PREP + """, k AS (SELECT comment_id, username, video, ts, replace(printf('%.5E', try_cast(comment_id AS DOUBLE)), 'x', '') AS w FROM prep),
 kk AS (SELECT video, regexp_replace(regexp_replace(w, '(\\.[0-9]*?)0+E', '\\1E'), '\\.E', 'E') AS key FROM k WHERE try_cast(comment_id AS DOUBLE) IS NOT NULL),
 un AS (SELECT key, video FROM kk JOIN prep USING (video) WHERE false UNION ALL SELECT key, video FROM kk GROUP BY 1, 2 HAVING count(*) = 1),
 ts AS (SELECT regexp_replace(regexp_replace(w, '(\\.[0-9]*?)0+E', '\\1E'), '\\.E', 'E') AS key, video, ts FROM k),
 r AS (SELECT p.comment_id, p.video, p.parent_comment_id, q.video AS qv, regexp_replace(regexp_replace(printf('%.5E', try_cast(p.parent_comment_id AS DOUBLE)), '(\\.[0-9]*?)0+E', '\\1E'), '\\.E', 'E') AS key FROM prep p LEFT JOIN prep q ON q.comment_id = p.parent_comment_id WHERE p.parent_comment_id IS NOT NULL)
 SELECT coalesce(CASE WHEN r.qv IS NOT NULL THEN 'exact' WHEN t.ts IS NOT NULL THEN 'rounded' END, 'none') AS match, count(*) AS n
 FROM r LEFT JOIN un ON r.qv IS NULL AND un.key = r.key AND un.video = r.video LEFT JOIN ts t ON t.key = un.key AND t.video = un.video GROUP BY 1""")
def j12_parent_join(spark, d):
    return A.with_parent(comments(spark, d), lossy=True).groupBy(F.coalesce("match", F.lit("none")).alias("match")).agg(F.count(F.lit(1)).alias("n"))


_ASSOC = _PAR + """, g AS (SELECT username, (ascii(right(username, 1)) % 7)::BIGINT AS hcc_id FROM members),
 sh AS (SELECT s.username, hcc_id, count(*) AS shared FROM (SELECT DISTINCT username, video FROM seen WHERE username IN (SELECT username FROM mass)) s JOIN (SELECT DISTINCT hcc_id, video FROM seen JOIN g USING (username)) v USING (video) GROUP BY 1, 2),
 nr AS (SELECT m.username, g.hcc_id, m.comment_id, (epoch_us(m.ts) - epoch_us(c.ts)) / 60e6 AS lag FROM prep m JOIN prep c ON m.video = c.video AND epoch_us(m.ts) - epoch_us(c.ts) BETWEEN 0 AND 172800000000 JOIN g ON g.username = c.username WHERE m.username IN (SELECT username FROM mass)),
 ea AS (SELECT username, hcc_id, comment_id, min(lag) AS nearest, median(lag) AS md FROM nr GROUP BY 1, 2, 3),
 te AS (SELECT username, hcc_id, count(*) AS temporal_comments, min(nearest) AS nearest, median(md) AS median_lag FROM ea GROUP BY 1, 2),
 di AS (SELECT s.username, g.hcc_id, count(*) AS direct FROM stat s JOIN g ON g.username = s.p_user WHERE status = 'VERIFIED_DIRECT_REPLY' GROUP BY 1, 2),
 al AS (SELECT username, hcc_id, direct, 0 AS temporal, 0 AS shared FROM di UNION ALL SELECT username, hcc_id, 0, temporal_comments, 0 FROM te UNION ALL SELECT username, hcc_id, 0, 0, shared FROM sh),
 sc AS (SELECT username, hcc_id, sum(direct)::BIGINT AS direct, sum(temporal)::BIGINT AS temporal, sum(shared)::BIGINT AS shared FROM al GROUP BY 1, 2)"""


def _parts(spark, d):
    prep = comments(spark, d)
    creators = makers(spark, d)
    outside = mass(prep, creators)
    groups = members(prep, creators).withColumn("hcc_id", F.expr("cast(ascii(right(username, 1)) % 7 as bigint)"))
    theirs = prep.join(groups, "username")
    ours = prep.join(outside, "username", "left_semi")
    return prep, outside, groups, theirs, ours


@R.query("a10_shared_videos", _ASSOC + " SELECT * FROM sh")
def a10_shared_videos(spark, d):
    _, _, _, theirs, ours = _parts(spark, d)
    return A.shared_videos(ours.where("video is not null"), theirs.where("video is not null"))


@R.query("a11_temporal_association", _ASSOC + " SELECT username, hcc_id, temporal_comments, round(nearest, 6) AS nearest, round(median_lag, 6) AS median_lag FROM te")
def a11_temporal_association(spark, d):
    _, _, _, theirs, ours = _parts(spark, d)
    return A.temporal_association(ours, theirs, 2880).withColumns({c: F.round(c, 6) for c in ("nearest", "median_lag")})


def _scores(spark, d):
    prep, outside, groups, theirs, ours = _parts(spark, d)
    replies = A.reply_status(A.with_parent(prep), groups.select("username"), outside).where("status = 'VERIFIED_DIRECT_REPLY'")
    direct = replies.join(groups.withColumnRenamed("username", "p_user"), "p_user").groupBy("username", "hcc_id").agg(F.count(F.lit(1)).alias("direct"))
    return A.association_scores(direct, A.temporal_association(ours, theirs, 2880), A.shared_videos(ours.where("video is not null"), theirs.where("video is not null")))


@R.query("a12_association_scores", _ASSOC + " SELECT *, 3 * direct + 2 * temporal AS strong, 3 * direct + 2 * temporal + shared AS contextual FROM sc")
def a12_association_scores(spark, d):
    return _scores(spark, d)


@R.query("a13_primary_group", _ASSOC + """, tp AS (SELECT username, count(*) AS n_groups, max(direct) AS td, max(temporal) AS tt, max(shared) AS tsh FROM sc GROUP BY 1),
 ti AS (SELECT *, CASE WHEN td > 0 THEN 'direct' WHEN tt > 0 THEN 'temporal' WHEN tsh > 0 THEN 'shared' ELSE 'none' END AS tier FROM tp),
 wi AS (SELECT sc.*, n_groups, tier, CASE tier WHEN 'direct' THEN direct = td WHEN 'temporal' THEN temporal = tt WHEN 'shared' THEN shared = tsh ELSE false END AS win FROM sc JOIN ti USING (username))
 SELECT username, n_groups, tier, count_if(win) AS n_winners, CASE WHEN count_if(win) = 1 THEN min(hcc_id) FILTER (win) END AS primary_group, count_if(win) > 1 AS ambiguous, 1.0::DOUBLE / n_groups AS fractional_weight FROM wi GROUP BY 1, 2, 3""")
def a13_primary_group(spark, d):
    return A.primary_group(_scores(spark, d))


@R.query("a5_group_mode", """WITH c AS (SELECT video_url, product_category, count(*) AS n FROM comments WHERE product_category IS NOT NULL GROUP BY 1, 2)
 SELECT video_url, n, min(product_category) AS mode FROM c WHERE n = (SELECT max(n) FROM c x WHERE x.video_url IS NOT DISTINCT FROM c.video_url) GROUP BY 1, 2""")
def a5_group_mode(spark, d):
    return A.group_mode(table(spark, d, "comments").where("video_url is not null"), ["video_url"], "product_category")


@R.query("a20_status_crosstab", _PAR + """, k AS (SELECT CASE WHEN username IN (SELECT username FROM members) THEN 'Community' WHEN username IN (SELECT username FROM makers) THEN 'Individual' ELSE 'Mass' END AS kind, status FROM stat),
 c AS (SELECT kind, count_if(status = 'UNRESOLVED_PARENT') AS UNRESOLVED_PARENT, count_if(status = 'VERIFIED_DIRECT_REPLY') AS VERIFIED_DIRECT_REPLY, count_if(status = 'PROBABLE_REPLY_REFERENCE') AS PROBABLE_REPLY_REFERENCE,
  count_if(status IN ('UNRESOLVED_PARENT', 'VERIFIED_DIRECT_REPLY', 'PROBABLE_REPLY_REFERENCE')) AS total FROM k GROUP BY 1)
 SELECT * FROM c UNION ALL SELECT 'Total', sum(UNRESOLVED_PARENT)::BIGINT, sum(VERIFIED_DIRECT_REPLY)::BIGINT, sum(PROBABLE_REPLY_REFERENCE)::BIGINT, sum(total)::BIGINT FROM c""")
def a20_status_crosstab(spark, d):
    prep, creators = comments(spark, d), makers(spark, d)
    kinds = members(prep, creators).withColumn("kind", F.lit("Community")).unionByName(creators.withColumn("kind", F.lit("Individual")))
    typed = _replies(spark, d).join(kinds, "username", "left").withColumn("kind", F.coalesce("kind", F.lit("Mass")))
    return A.crosstab(typed, "kind", "status", ["UNRESOLVED_PARENT", "VERIFIED_DIRECT_REPLY", "PROBABLE_REPLY_REFERENCE"])


@R.query("a21_kind_totals", PREP + """, k AS (SELECT CASE WHEN username IN (SELECT username FROM members) THEN 'Community' WHEN username IN (SELECT username FROM makers) THEN 'Individual' ELSE 'Mass' END AS kind, username FROM prep WHERE username IS NOT NULL)
 SELECT coalesce(kind, 'Total') AS kind, count(*) AS n_comments, count(DISTINCT username) AS n_accounts, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM k), 6) AS share_percent FROM k GROUP BY ROLLUP (kind)""")
def a21_kind_totals(spark, d):
    prep, creators = comments(spark, d), makers(spark, d)
    kinds = members(prep, creators).withColumn("kind", F.lit("Community")).unionByName(creators.withColumn("kind", F.lit("Individual")))
    each = prep.where("username is not null").groupBy("username").agg(F.count(F.lit(1)).alias("n")).join(kinds, "username", "left").withColumn("kind", F.coalesce("kind", F.lit("Mass")))
    sums = each.rollup("kind").agg(F.sum("n").alias("n_comments"), F.count(F.lit(1)).alias("n_accounts"))
    total = each.agg(F.sum("n").alias("_t"))
    return sums.crossJoin(F.broadcast(total)).select(F.coalesce("kind", F.lit("Total")).alias("kind"), "n_comments", "n_accounts", F.round(100.0 * F.col("n_comments") / F.col("_t"), 6).alias("share_percent"))  # one row


@R.query("a23_overlap_audit", PREP + """, u AS (SELECT DISTINCT username AS k, 1 AS b FROM prep WHERE username IS NOT NULL UNION ALL SELECT username, 2 FROM makers UNION ALL SELECT DISTINCT parent_user, 4 FROM prep WHERE parent_user IS NOT NULL),
 s AS (SELECT k, sum(b) AS b FROM u GROUP BY 1)
 SELECT concat_ws('+', CASE WHEN b & 1 > 0 THEN 'commenter' END, CASE WHEN b & 2 > 0 THEN 'creator' END, CASE WHEN b & 4 > 0 THEN 'parent' END) AS in_sets, count(*) AS n FROM (SELECT k, b::INT AS b FROM s) GROUP BY 1""")
def a23_overlap_audit(spark, d):
    prep = comments(spark, d)
    return A.overlap_audit({"commenter": prep.select("username"), "creator": makers(spark, d), "parent": prep.select(F.col("parent_user").alias("username"))}, "username")


@R.query("a3_creator_stats", """WITH v AS (SELECT DISTINCT video_url, nullif(regexp_replace(regexp_replace(lower(trim(creator)), '^@+', ''), '\\s+', '', 'g'), '') AS maker FROM video_metadata_clean WHERE lower(trim(creator)) NOT IN ('', 'nan', 'none', 'null', '<na>')),
 a AS (SELECT maker, count(DISTINCT video_url) AS n_videos FROM v GROUP BY 1), b AS (SELECT maker, count(*) AS n_comments FROM v JOIN comments USING (video_url) GROUP BY 1)
 SELECT coalesce(a.maker, b.maker) AS maker, coalesce(n_videos, 0) AS n_videos, coalesce(n_comments, 0) AS n_comments FROM a FULL JOIN b ON a.maker = b.maker""")
def a3_creator_stats(spark, d):
    v = table(spark, d, "video_metadata_clean").select("video_url", N.account(F.col("creator")).alias("maker")).where("maker is not null").distinct()
    videos = v.where("video_url is not null").groupBy("maker").agg(F.count(F.lit(1)).alias("n_videos"))
    said = table(spark, d, "comments").groupBy("video_url").agg(F.count(F.lit(1)).alias("n")).join(v, "video_url").groupBy("maker").agg(F.sum("n").alias("n_comments"))
    return videos.join(said, "maker", "full").na.fill(0, ["n_videos", "n_comments"])
