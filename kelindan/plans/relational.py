"""Joins, set operations, windows, pivots and audits over the star schema and the domain tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelindan.operators import checks as Q
from kelindan.operators import evidence as E
from kelindan.operators import graph as G
from kelindan.operators import joins as J
from kelindan.functions import normalize as N
from kelindan.functions.stats import cut_right
from kelindan.plans.domain import PREP, comments
from kelindan.plans.evidence import _REPLY, _edges
from kelindan.plans.registry import Registry, table
from kelindan.session import stage

R = Registry()


@R.query("j1_left_lookup", """SELECT c_custkey, n_name, coalesce(r_name, 'none') AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def j1_left_lookup(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", F.coalesce("r_name", F.lit("none")).alias("region"))


@R.query("j2_revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1""")
def j2_revenue_by_nation(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    o = table(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1995-01-01' and o_orderdate < timestamp_ntz'1997-01-01'").select("o_orderkey", "o_custkey")
    c, n = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("rev"), 2).alias("revenue"), F.count(F.lit(1)).alias("n_orders"))


@R.query("j3_outer_three", """WITH a AS (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, c_acctbal FROM customer WHERE c_acctbal > 0), e AS (SELECT user_id AS k, count(*) AS n_events FROM events GROUP BY 1)
 SELECT k, coalesce(n_orders, 0) AS n_orders, coalesce(c_acctbal, 0) AS c_acctbal, coalesce(n_events, 0) AS n_events FROM a FULL JOIN b USING (k) FULL JOIN e USING (k)""")
def j3_outer_three(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n_orders"))
    b = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), "c_acctbal")
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("n_events"))
    return a.join(b, "k", "full").join(e, "k", "full").na.fill({"n_orders": 0, "c_acctbal": 0.0, "n_events": 0})


@R.query("j4_reconcile", """WITH a AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, round(o_totalprice, 2) AS v FROM orders WHERE o_orderstatus <> 'P')
 SELECT CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS presence, a.k IS NOT NULL AND b.k IS NOT NULL AND coalesce(abs(a.v - b.v) <= 1e-9, a.v IS NULL AND b.v IS NULL) AS agrees, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1, 2""")
def j4_reconcile(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    b = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice", 2).alias("v"))
    return J.reconcile(a, b, ["k"], "v").groupBy("presence", "agrees").agg(F.count(F.lit(1)).alias("n"))


@R.query("j6_unique_join", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
def j6_unique_join(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    c = J.assert_unique(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"])
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


def _event_rows(spark, d):
    return table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("username"), F.get_json_object("props", "$.k").alias("video"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "value")


_EV = "WITH ev AS (SELECT event_id, user_id::VARCHAR AS username, (props::JSON ->> 'k') AS video, ts, event_type, user_id, value FROM events)"


@R.query("j8_shared_items", _EV + """, s AS (SELECT DISTINCT username, video FROM ev WHERE user_id % 10 = 0), t AS (SELECT DISTINCT username, video FROM ev WHERE user_id % 10 = 1)
 SELECT least(s.username, t.username) AS source, greatest(s.username, t.username) AS target, count(*) AS co_conv_weight FROM s JOIN t USING (video) GROUP BY 1, 2 HAVING count(*) >= 3""")
def j8_shared_items(spark, d):
    ev = _event_rows(spark, d)
    side = lambda m: ev.where(F.col("user_id") % 10 == m).select("username").distinct()
    return E.co_conv(E.incidence(ev), side(0), side(1))


@R.query("j8_all_shared_items", _EV + """, s AS (SELECT DISTINCT username, video FROM ev WHERE username IS NOT NULL AND video IS NOT NULL)
 SELECT a.username AS source, b.username AS target, count(*) AS co_conv_weight FROM s a JOIN s b ON a.video = b.video AND a.username < b.username GROUP BY 1, 2 HAVING count(*) >= 3""")
def j8_all_shared_items(spark, d):
    """All accounts against each other; ``j8_shared_items`` is the two-sided form, whose sides its SQL fixes."""
    return E.shared_items(stage(E.incidence(_event_rows(spark, d)), "seen"))


@R.query("j10_band_join", _EV + """ SELECT least(a.username, b.username) AS source, greatest(a.username, b.username) AS target, count(DISTINCT a.video) AS co_temporal_weight FROM ev a JOIN ev b ON a.video = b.video AND a.username <> b.username AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 0 AND 540000000
 GROUP BY 1, 2 HAVING count(DISTINCT a.video) >= 2""")
def j10_band_join(spark, d):
    return E.co_temporal(_event_rows(spark, d), 9, least=2)


@R.query("j11_backward_window", _EV + """ SELECT m.event_id, h.event_type, count(*) AS n_pairs, min(epoch_us(m.ts) - epoch_us(h.ts)) AS nearest, median(epoch_us(m.ts) - epoch_us(h.ts)) AS median_lag FROM ev m JOIN ev h ON m.video = h.video AND epoch_us(m.ts) - epoch_us(h.ts) BETWEEN 0 AND 3600000000
 WHERE m.event_type = 'click' AND h.event_type <> 'click' GROUP BY 1, 2""")
def j11_backward_window(spark, d):
    ev = _event_rows(spark, d)
    m = ev.where("event_type = 'click'").select("event_id", "video", F.unix_micros("ts").alias("t1"))
    h = ev.where("event_type <> 'click'").select("event_type", "video", F.unix_micros("ts").alias("t0"))
    return J.backward_window(m, h, ["video"], "t1", "t0", 3_600_000_000, "event_id", "event_type")


@R.query("c5_window_events", _EV + ", g AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY video ORDER BY ts) AS g FROM ev) SELECT greatest(1, round_even(quantile_cont(g, 0.5) / 60e6, 0))::BIGINT AS window_minutes FROM g WHERE g IS NOT NULL")
def c5_window_events(spark, d):
    return E.calibrated_window(_event_rows(spark, d))


_KEY = r"regexp_replace(regexp_replace(printf('%.5E', try_cast({} AS DOUBLE)), '(\.[0-9]*?)0+E', '\1E'), '\.E', 'E')"


@R.query("j13_staged_join", f"""WITH f AS (SELECT DISTINCT comment_id, trim(video_id) AS video_id, video_url, product_category FROM comments WHERE comment_id IS NOT NULL),
 dm AS (SELECT trim(video_id) AS video_id, video_url, product_category, row_no FROM video_metadata_clean),
 d1 AS (SELECT video_id AS k, min(row_no) AS m FROM dm WHERE video_id IS NOT NULL GROUP BY 1), d2 AS (SELECT CASE WHEN try_cast(video_id AS DOUBLE) IS NOT NULL THEN {_KEY.format('video_id')} END AS k, min(row_no) AS m FROM dm GROUP BY 1),
 d3 AS (SELECT video_url AS k, min(row_no) AS m FROM dm WHERE video_url IS NOT NULL GROUP BY 1)
 SELECT CASE WHEN d1.m IS NOT NULL THEN 'video_id_exact' WHEN d2.m IS NOT NULL THEN 'video_id_lossy' WHEN d3.m IS NOT NULL THEN 'video_url' ELSE 'unmatched' END AS match_stage, count(*) AS n, sum(coalesce(d1.m, d2.m, d3.m))::BIGINT AS checksum
 FROM f LEFT JOIN d1 ON d1.k = f.video_id LEFT JOIN d2 ON d2.k = CASE WHEN try_cast(f.video_id AS DOUBLE) IS NOT NULL THEN {_KEY.format('f.video_id')} END LEFT JOIN d3 ON d3.k = f.video_url GROUP BY 1""")
def j13_staged_join(spark, d):
    facts = table(spark, d, "comments").where("comment_id is not null").select("comment_id", F.trim("video_id").alias("video_id"), "video_url", "product_category").distinct()
    dims = table(spark, d, "video_metadata_clean").select(F.trim("video_id").alias("d_id"), F.col("video_url").alias("d_url"), "row_no")
    lossy = N.lossy_id_key
    stages = [("video_id_exact", F.col("video_id"), F.col("d_id")), ("video_id_lossy", lossy(F.col("video_id")), lossy(F.col("d_id"))), ("video_url", F.col("video_url"), F.col("d_url"))]
    return J.staged_join(facts, dims, stages, "row_no", [F.col("row_no")]).groupBy("match_stage").agg(F.count(F.lit(1)).alias("n"), F.sum("match_id").alias("checksum"))


@R.query("j16_dense_grid", """WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1, 2)
 SELECT f.x AS l_returnflag, s.x AS l_linestatus, coalesce(n, 0) AS n FROM (SELECT unnest(['A', 'N', 'R']) AS x) f, (SELECT unnest(['F', 'O', 'P']) AS x) s LEFT JOIN c ON l_returnflag = f.x AND l_linestatus = s.x""")
def j16_dense_grid(spark, d):
    counts = table(spark, d, "lineitem").where("l_quantity > 49").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    domain = spark.createDataFrame([(a, b) for a in "ANR" for b in "FOP"], "l_returnflag string, l_linestatus string")
    return J.dense_grid(counts, domain, ["l_returnflag", "l_linestatus"], {"n": 0})


@R.query("j19_semi_anti", "SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j19_semi_anti(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    one = lambda how: c.join(o, "c_custkey", how).agg(F.count(F.lit(1)).alias("n")).select(F.lit(how.split("_")[1]).alias("kind"), "n")
    return one("left_semi").unionByName(one("left_anti"))


@R.query("j21_star", """SELECT r_name, p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE p_size > 25 GROUP BY 1, 2""")
def j21_star(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    p = table(spark, d, "part").where("p_size > 25").select("p_partkey", "p_brand")
    s, n, r = table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "nation"), table(spark, d, "region")
    where = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(where, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("r_name", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@R.query("agg_pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 9) AS avg_disc, round(stddev_pop(l_quantity), 6) AS sd_qty, count(*) AS n, count(DISTINCT l_suppkey) AS n_supp FROM lineitem GROUP BY 1, 2""")
def agg_pricing_summary(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 9).alias("avg_disc"),
        F.round(F.stddev_pop("l_quantity"), 6).alias("sd_qty"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("n_supp"),
    )


@R.query("agg_quantiles", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY 1")
def agg_quantiles(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[F.percentile("l_extendedprice", q).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.9)])


@R.query("agg_rollup", "SELECT coalesce(l_returnflag, 'Total') AS flag, coalesce(l_linestatus, 'Total') AS status, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("l_returnflag", F.lit("Total")).alias("flag"), F.coalesce("l_linestatus", F.lit("Total")).alias("status"), "n")


@R.query("agg_cube", "SELECT coalesce(o_orderstatus, 'Total') AS status, coalesce(o_orderpriority, 'Total') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.coalesce("o_orderstatus", F.lit("Total")).alias("status"), F.coalesce("o_orderpriority", F.lit("Total")).alias("priority"), "n", "total")


@R.query("agg_pivot", "SELECT c_mktsegment, count_if(o_orderstatus = 'F') AS F, count_if(o_orderstatus = 'O') AS O, count_if(o_orderstatus = 'P') AS P FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def agg_pivot(spark, d):
    joined = table(spark, d, "orders").select("o_custkey", "o_orderstatus").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@R.query("agg_unpivot", "SELECT l_returnflag, measure, round(sum(v), 2) AS total FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME measure VALUE v) GROUP BY 1, 2")
def agg_unpivot(spark, d):
    sums = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[F.sum(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    return sums.unpivot(["l_returnflag"], ["l_quantity", "l_discount", "l_tax"], "measure", "v").select("l_returnflag", "measure", F.round("v", 2).alias("total"))


@R.query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
def agg_having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 15")


@R.query("win_lag", _EV + ", w AS (SELECT video, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY video ORDER BY ts, event_id) AS gap FROM ev) SELECT video, count(gap) AS n_gaps, min(gap) AS least, max(gap) AS most FROM w GROUP BY 1")
def win_lag(spark, d):
    by = Window.partitionBy("video").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(by)
    return _event_rows(spark, d).select("video", gap.alias("gap")).groupBy("video").agg(F.count("gap").alias("n_gaps"), F.min("gap").alias("least"), F.max("gap").alias("most"))


@R.query("win_top_orders", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def win_top_orders(spark, d):
    by = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(by)).where("r <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


@R.query("set_operations", """SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION SELECT user_id FROM events) UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events)
 UNION ALL SELECT 'except', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events) UNION ALL SELECT 'symmetric', count(*) FROM ((SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events) UNION (SELECT user_id FROM events EXCEPT SELECT o_custkey FROM orders))""")
def set_operations(spark, d):
    a, b = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "events").select(F.col("user_id").alias("k"))
    # one pass: each key once, with the sides that have it
    sides = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(2))).distinct().groupBy("k").agg(F.sum("s").alias("s"))
    out = sides.agg(F.count(F.lit(1)).alias("union"), F.count_if(F.col("s") == 3).alias("intersect"), F.count_if(F.col("s") == 1).alias("except"), F.count_if(F.col("s") < 3).alias("symmetric"))
    return out.unpivot([], ["union", "intersect", "except", "symmetric"], "op", "n")


@R.query("sort_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def sort_limit_offset(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20)


@R.query("union_by_name", "SELECT 'c' AS side, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 's', s_name, s_acctbal, NULL FROM supplier")
def union_by_name(spark, d):
    c = table(spark, d, "customer").select(F.lit("c").alias("side"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.lit("s").alias("side"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@R.query("proj_p5_regex_filter", "SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), '^[a-p].*(gear|bolt)$') OR regexp_matches(p_type, '(?i)^promo')")
def proj_p5_regex_filter(spark, d):
    return table(spark, d, "part").where(F.lower("p_name").rlike("^[a-p].*(gear|bolt)$") | F.col("p_type").rlike("(?i)^promo")).select("p_partkey")


@R.query("proj_p6_case_when", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS kind, count(*) AS n FROM customer GROUP BY 1")
def proj_p6_case_when(spark, d):
    kind = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    return table(spark, d, "customer").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@R.query("proj_p8_fallback", "SELECT record_id, coalesce(nullif(trim(brand_or_video_context), ''), nullif(trim(sampling_stratum), ''), 'none') AS context FROM sample_registry")
def proj_p8_fallback(spark, d):
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(spark, d, "sample_registry").select("record_id", F.coalesce(blank("brand_or_video_context"), blank("sampling_stratum"), F.lit("none")).alias("context"))


@R.query("proj_p10_distinct_rows", "SELECT count(*) AS n FROM (SELECT DISTINCT * FROM hcc_hashtag_profile)")
def proj_p10_distinct_rows(spark, d):
    return table(spark, d, "hcc_hashtag_profile").distinct().agg(F.count(F.lit(1)).alias("n"))


@R.query("proj_p12_validity", "SELECT count(*) AS n, count_if(cosine_similarity_char5 BETWEEN 0 AND 1) AS valid, count_if(cosine_similarity_char5 IS NULL) AS missing FROM comment_similarity_pairs")
def proj_p12_validity(spark, d):
    s = F.col("cosine_similarity_char5")
    return table(spark, d, "comment_similarity_pairs").agg(F.count(F.lit(1)).alias("n"), F.count_if(s.between(0, 1)).alias("valid"), F.count_if(s.isNull()).alias("missing"))


@R.query("proj_p13_canonical_labels", """SELECT CASE regexp_replace(lower(trim(candidate_type)), '[^a-z]+', '_', 'g') WHEN 'exact_copypasta' THEN 'EXACT' WHEN 'near_copypasta' THEN 'NEAR' ELSE 'OTHER' END AS label, count(*) AS n FROM hcc_copypasta_candidates GROUP BY 1""")
def proj_p13_canonical_labels(spark, d):
    written = F.regexp_replace(F.lower(F.trim("candidate_type")), "[^a-z]+", "_")
    known = F.create_map(F.lit("exact_copypasta"), F.lit("EXACT"), F.lit("near_copypasta"), F.lit("NEAR"))
    return table(spark, d, "hcc_copypasta_candidates").groupBy(F.coalesce(F.try_element_at(known, written), F.lit("OTHER")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@R.query("m4_length_bins", "SELECT CASE WHEN n_chars > 0 AND n_chars <= 100 THEN 'short' WHEN n_chars > 100 AND n_chars <= 1000 THEN 'medium' WHEN n_chars > 1000 AND n_chars <= 100000 THEN 'long' END AS bin, count(*) AS n FROM documents GROUP BY 1")
def m4_length_bins(spark, d):
    return table(spark, d, "documents").groupBy(cut_right(F.col("n_chars"), [0, 100, 1000, 100000], ["short", "medium", "long"]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@R.query("t21_either_side", "SELECT actor_pair_type, count(*) AS n, count(DISTINCT x) AS n_comments FROM (SELECT actor_pair_type, unnest([comment_id_1, comment_id_2]) AS x FROM comment_similarity_pairs) GROUP BY 1")
def t21_either_side(spark, d):
    ends = table(spark, d, "comment_similarity_pairs").select("actor_pair_type", F.explode(F.array("comment_id_1", "comment_id_2")).alias("x"))
    once = ends.groupBy("actor_pair_type", "x").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("actor_pair_type").agg(F.sum("n").alias("n"), F.count("x").alias("n_comments"))


@R.query("proj_p7_pair_labels", """SELECT CASE WHEN rank_a <= rank_b THEN a || '–' || b ELSE b || '–' || a END AS label, count(*) AS n FROM (SELECT *, list_position(['click', 'error', 'purchase', 'signup', 'view'], a) AS rank_a, list_position(['click', 'error', 'purchase', 'signup', 'view'], b) AS rank_b
 FROM (SELECT e.event_type AS a, f.event_type AS b FROM events e JOIN events f ON e.user_id = f.user_id AND e.event_id + 1 = f.event_id)) GROUP BY 1""")
def proj_p7_pair_labels(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("a"))
    f = table(spark, d, "events").select((F.col("event_id") - 1).alias("event_id"), "user_id", F.col("event_type").alias("b"))
    rank = F.create_map(*[F.lit(x) for i, name in enumerate(("click", "error", "purchase", "signup", "view")) for x in (name, i)])
    first = F.coalesce(F.try_element_at(rank, F.col("a")), F.lit(9)) <= F.coalesce(F.try_element_at(rank, F.col("b")), F.lit(9))
    return e.join(f, ["event_id", "user_id"]).groupBy(F.when(first, F.concat_ws("–", "a", "b")).otherwise(F.concat_ws("–", "b", "a")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@R.query("q1_gates", """WITH v AS (SELECT count(*)::DOUBLE AS a, count(DISTINCT pair_id)::DOUBLE AS b, coalesce(max(cosine_similarity_char5), 0) AS c, min(token_jaccard) AS e FROM comment_similarity_pairs)
 SELECT * FROM (SELECT 'rows' AS metric, 1.0::DOUBLE AS expected, a AS observed, a >= 1 AS passed, '>=' AS notes FROM v UNION ALL SELECT 'duplicate_keys', 0, a - b, a - b = 0, '==' FROM v UNION ALL SELECT 'max_score', 1, c, c <= 1, '<=' FROM v UNION ALL SELECT 'min_jaccard', 0, e, coalesce(e >= 0, false), '>=' FROM v)""")
def q1_gates(spark, d):
    rows = table(spark, d, "comment_similarity_pairs")
    return Q.gates(rows, [
        ("rows", F.count(F.lit(1)), ">=", 1), ("duplicate_keys", F.count(F.lit(1)) - F.count_distinct("pair_id"), "==", 0),
        ("max_score", F.coalesce(F.max("cosine_similarity_char5"), F.lit(0.0)), "<=", 1), ("min_jaccard", F.min("token_jaccard"), ">=", 0),
    ])


@R.query("m40_acceptance", "SELECT 2::BIGINT AS n_checks, (count(*) < 1)::INT::BIGINT + (count_if(comment_1 IS NULL) > 0)::INT::BIGINT AS n_failed, CASE WHEN count(*) >= 1 AND count_if(comment_1 IS NULL) = 0 THEN 'ACCEPTED' ELSE 'REJECTED' END AS status FROM comment_similarity_pairs")
def m40_acceptance(spark, d):
    rows = table(spark, d, "comment_similarity_pairs")
    return Q.all_passed(Q.gates(rows, [("rows", F.count(F.lit(1)), ">=", 1), ("missing_texts", F.count_if(F.col("comment_1").isNull()), "==", 0)]))


@R.query("q2_baseline_delta", """WITH o AS (SELECT o_orderstatus AS metric, count(*)::DOUBLE AS value FROM orders GROUP BY 1), b AS (SELECT * FROM (VALUES ('F', 7000.0::DOUBLE), ('O', 1.0), ('X', 5.0)) t(metric, value))
 SELECT coalesce(b.metric, o.metric) AS metric, b.value AS baseline, o.value AS observed, o.value - b.value AS delta, CASE WHEN b.value IS NULL THEN 'NEW' WHEN o.value IS NULL THEN 'MISSING' WHEN abs(o.value - b.value) <= 1e-9 THEN 'MATCH' ELSE 'RERUN_DIFF_RECORDED' END AS status FROM b FULL JOIN o ON b.metric = o.metric""")
def q2_baseline_delta(spark, d):
    observed = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return Q.baseline_delta(observed, spark.createDataFrame([("F", 7000.0), ("O", 1.0), ("X", 5.0)], "metric string, value double"))


@R.query("q4_invariants", """SELECT 'orders without customer' AS metric, 0.0::DOUBLE AS expected, count(*)::DOUBLE AS observed, count(*) = 0 AS passed, 'must be empty' AS notes FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT 'negative quantity', 0, count(*), count(*) = 0, 'must be empty' FROM lineitem WHERE l_quantity < 0""")
def q4_invariants(spark, d):
    o, c = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return Q.invariants({"orders without customer": o.join(c, "k", "left_anti"), "negative quantity": table(spark, d, "lineitem").where("l_quantity < 0")})


@R.query("g8_clean_edges", PREP + """, dir AS (SELECT username, parent_user FROM prep WHERE username IS NOT NULL AND parent_user IS NOT NULL), e AS (SELECT DISTINCT username AS source, parent_user AS target FROM dir), nd AS (SELECT DISTINCT username FROM prep WHERE username IS NOT NULL),
 rs AS (SELECT concat_ws('; ', CASE WHEN source = target THEN 'self loop' END, CASE WHEN source LIKE 'glow%' OR target LIKE 'glow%' THEN 'artefact node' END, CASE WHEN source NOT IN (SELECT username FROM nd) OR target NOT IN (SELECT username FROM nd) THEN 'missing node' END) AS reasons FROM e)
 SELECT reasons, count(*) AS n FROM rs GROUP BY 1""")
def g8_clean_edges(spark, d):
    prep = comments(spark, d)
    edges = prep.where("username is not null and parent_user is not null").select(F.col("username").alias("source"), F.col("parent_user").alias("target")).distinct()
    names = prep.select(F.col("username").alias("node")).where("node is not null").distinct()
    odd = edges.select(F.explode(F.array("source", "target")).alias("node")).where("node like 'glow%'").distinct()
    return G.clean_edges(edges, names, odd).groupBy("reasons").agg(F.count(F.lit(1)).alias("n"))


@R.query("g12_structural_hash", PREP + _REPLY + """ SELECT count(*) AS n, coalesce(sum(('0x' || left(md5(concat_ws(chr(31), source, target, n::VARCHAR)), 15))::BIGINT), 0)::DECIMAL(38,0) AS hash FROM reply""")
def g12_structural_hash(spark, d):
    return G.structural_hash(E.co_reply(comments(spark, d)), "source", "target", "reply_count")


def _graph(spark, d):
    """The whole combined graph with ``final_weight`` as w, and its components."""
    from kelindan.operators.components import connected_components

    edges = stage(_edges(spark, d).select("source", "target", F.col("final_weight").alias("w")), "edges")
    return edges, stage(connected_components(edges, "source", "target"), "groups")


@R.query("g4_betweenness")
def g4_betweenness(spark, d):
    return G.betweenness(*_graph(spark, d)).select("node", F.round("score", 9).alias("betweenness"))


@R.query("g5_louvain")
def g5_louvain(spark, d):
    edges, groups = _graph(spark, d)
    return G.per_group(edges, groups, "louvain", "w").select("node", "community")


@R.query("g6_focal_sets")
def g6_focal_sets(spark, d):
    edges, groups = _graph(spark, d)
    mean = edges.agg(F.avg("w").alias("m")).first().m or 0.0
    found = G.per_group(edges, groups, "focal", "w", floor=mean).where("community is not null")
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"), F.round(F.max("score"), 9).alias("mean_edge_weight")).withColumn("is_focal", F.col("n_nodes") >= 3)
