"""Problems 3 and 5: packed fields and keys that hold most records."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelindan.operators.packed import explode_packed
from kelindan.operators.skew import heavy_keys, key_text, per_key
from kelindan.plans.registry import Registry, table

R = Registry()

#: items(src_field, row_key, pos, item): the values of all packed fields, as common table expressions
SPLIT_CTES = r"""f AS (
  SELECT DISTINCT 'hashtags' AS src_field, video_url AS row_key, hashtags AS v FROM video_metadata_clean
  UNION SELECT DISTINCT 'mentions', video_url, mentions FROM video_metadata_clean
  UNION SELECT DISTINCT 'users', candidate_id, users FROM hcc_copypasta_candidates),
b AS (SELECT src_field, row_key, regexp_replace(v, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS v FROM f WHERE row_key IS NOT NULL),
c AS (SELECT src_field, row_key,
        CASE WHEN v LIKE '[%' AND v LIKE '%]' THEN regexp_replace(v, '^[\[\s\pZ]+|[\]\s\pZ]+$', '', 'g') ELSE v END AS v
      FROM b WHERE lower(v) NOT IN ('', '-', 'nan', 'none', 'null', '<na>', 'n/a', '[]')),
t AS (SELECT src_field, row_key, regexp_extract_all(regexp_replace(v, '[\s\pZ]+([#@])', ';\1', 'g'),
        '"(?:[^"]|"")*"|''[^'']*''|[#@][^;,|\t\n\r、；，#@]*|[^;,|\t\n\r、；，#@''"\s\pZ][^;,|\t\n\r、；，]*') AS a FROM c),
i AS (SELECT src_field, row_key, list_filter(list_transform(a, lambda x:
        regexp_replace(CASE WHEN x LIKE '"%"' THEN replace(x[2:-2], '""', '"') WHEN x LIKE '''%''' THEN x[2:-2] ELSE x END,
          '^[\s\pZ#@]+|[\s\pZ]+$', '', 'g')), lambda x: x <> '') AS a FROM t),
items AS (SELECT DISTINCT src_field, row_key, pos::BIGINT AS pos, item FROM (SELECT src_field, row_key, unnest(a) AS item, generate_subscripts(a, 1) AS pos FROM i))
"""


@R.query("p3_found", "WITH " + SPLIT_CTES + " SELECT src_field, row_key, pos, item FROM items")
def p3_found(spark, d):
    videos = explode_packed(table(spark, d, "video_metadata_clean"), {"hashtags": "hashtags", "mentions": "mentions"}, "video_url")
    users = explode_packed(table(spark, d, "hcc_copypasta_candidates"), {"users": "users"}, "candidate_id")
    return videos.unionByName(users)


_KEY_SQL = r"nullif(lower(regexp_replace({}, '^[\s\pZ#@]+|[\s\pZ]+$', '', 'g')), '')"


@R.query("p5_found", f"""
WITH k AS (SELECT 'hashtag' AS src_field, {_KEY_SQL.format('hashtag')} AS key_text FROM hcc_hashtag_profile
           UNION ALL SELECT 'creator', {_KEY_SQL.format('creator')} FROM video_metadata_clean),
n AS (SELECT src_field, count(*) AS n_all FROM k GROUP BY 1)
SELECT src_field, key_text FROM k JOIN n USING (src_field) WHERE key_text IS NOT NULL
GROUP BY src_field, key_text, n_all HAVING count(*) >= 0.03 * n_all""")  # fmt: skip
def p5_found(spark, d):
    tags = heavy_keys(table(spark, d, "hcc_hashtag_profile"), key_text(F.col("hashtag")))
    makers = heavy_keys(table(spark, d, "video_metadata_clean"), key_text(F.col("creator")))
    return tags.select(F.lit("hashtag").alias("src_field"), "key_text").unionByName(makers.select(F.lit("creator").alias("src_field"), "key_text"))


#: of rows of one tag and time, the order by group, then frequency: hcc_id < 10**7, frequency < 10**8 (checked by ``row_order``)
_TAG_TIE = "(coalesce(hcc_id, 0) * 100000000 + coalesce(frequency, 0))"


@R.query("p5_hashtag_totals", f"""
WITH k AS (SELECT {_KEY_SQL.format('hashtag')} AS key_text, *, {_TAG_TIE} AS tie FROM hcc_hashtag_profile)
SELECT key_text, count(*) AS n_rows, sum(frequency)::BIGINT AS sum_frequency, sum(n_videos)::BIGINT AS sum_n_videos,
  sum(n_users_exposed)::BIGINT AS sum_n_users_exposed, max(profiled_at) AS latest_at,
  (arg_max(struct_pack(h := hcc_id, f := frequency), (profiled_at, tie))).h AS latest_hcc_id,
  (arg_max(struct_pack(h := hcc_id, f := frequency), (profiled_at, tie))).f AS latest_frequency
FROM k GROUP BY 1""")  # fmt: skip
def p5_hashtag_totals(spark, d):
    return per_key(
        table(spark, d, "hcc_hashtag_profile"), key_text(F.col("hashtag")), "key_text",
        ["frequency", "n_videos", "n_users_exposed"], "profiled_at", F.expr(_TAG_TIE),
        {"hcc_id": F.col("hcc_id"), "frequency": F.col("frequency")},
    )


@R.query("p5_creator_totals", f"""
WITH k AS (SELECT {_KEY_SQL.format('creator')} AS key_text, * FROM video_metadata_clean)
SELECT key_text, count(*) AS n_rows, sum(view_count)::BIGINT AS sum_view_count, sum(like_count)::BIGINT AS sum_like_count,
  sum(comment_count)::BIGINT AS sum_comment_count, max(crawled_at) AS latest_at,
  arg_max(row_no, (crawled_at, row_no)) AS latest_row_no
FROM k GROUP BY 1""")
def p5_creator_totals(spark, d):
    return per_key(
        table(spark, d, "video_metadata_clean"), key_text(F.col("creator")), "key_text",
        ["view_count", "like_count", "comment_count"], "crawled_at", F.col("row_no"), {"row_no": F.col("row_no")},
    )
