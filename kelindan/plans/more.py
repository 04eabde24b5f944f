"""The rest of the survey's data operators: tiers, adjudication, sensitivity, selections, memberships."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kelindan.functions import normalize as N
from kelindan.functions.stats import ratio, wilson
from kelindan.operators import evidence as E
from kelindan.operators import metrics as M
from kelindan.operators import sampling as S
from kelindan.operators import textsim as T
from kelindan.operators import typology as A
from kelindan.operators.joins import text_clusters
from kelindan.operators.quantiles import exact_quantile
from kelindan.plans.domain import PREP, comments, makers, mass, members
from kelindan.plans.evidence import _COMBINED, _edges
from kelindan.plans.metrics import _PT, LABELS, _pt, _usable
from kelindan.plans.registry import Registry, table
from kelindan.plans.text import _GRAMS, _named, _sims
from kelindan.plans.typology import _PAR
from kelindan.session import stage

R = Registry()


@R.query("a1_universe", PREP + " SELECT DISTINCT x AS username FROM (SELECT username AS x FROM prep UNION ALL SELECT parent_user FROM prep UNION ALL SELECT username FROM makers) WHERE x IS NOT NULL")
def a1_universe(spark, d):
    prep = comments(spark, d)
    return prep.select("username").unionByName(prep.select(F.col("parent_user").alias("username"))).unionByName(makers(spark, d)).where("username is not null").distinct()


@R.query("a2_account_types", PREP + """, u AS (SELECT DISTINCT username FROM prep WHERE username IS NOT NULL)
 SELECT username, CASE WHEN username IN (SELECT username FROM makers) THEN 'Individual' WHEN username IN (SELECT username FROM members) THEN 'Community' ELSE 'Mass' END AS kind,
 CASE WHEN username NOT IN (SELECT username FROM makers) AND username NOT IN (SELECT username FROM members) THEN 'MASS_' || left(sha256('kelindan:' || username), 12) ELSE username END AS public_name FROM u""")
def a2_account_types(spark, d):
    prep, creators = comments(spark, d), makers(spark, d)
    kinds = creators.withColumn("kind", F.lit("Individual")).unionByName(members(prep, creators).withColumn("kind", F.lit("Community")))
    users = prep.select("username").where("username is not null").distinct().join(kinds, "username", "left").withColumn("kind", F.coalesce("kind", F.lit("Mass")))
    return users.withColumn("public_name", F.when(F.col("kind") == "Mass", N.pseudonym(F.col("username"), "kelindan")).otherwise(F.col("username")))


@R.query("a7_reply_validation", _PAR + """ SELECT CASE WHEN p_video IS NULL THEN 'missing' WHEN video IS DISTINCT FROM p_video THEN 'cross_video' WHEN parent_user IS DISTINCT FROM p_user THEN 'user_mismatch' ELSE 'resolved' END AS outcome, count(*) AS n FROM stat GROUP BY 1""")
def a7_reply_validation(spark, d):
    r = A.with_parent(comments(spark, d))
    out = F.when(F.col("p_video").isNull(), "missing").when(~F.col("video").eqNullSafe(F.col("p_video")), "cross_video").when(~F.col("parent_user").eqNullSafe(F.col("p_user")), "user_mismatch").otherwise("resolved")
    return r.groupBy(out.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@R.query("a14_exposure", PREP + """, v AS (SELECT username, count(*) AS n FROM seen GROUP BY 1) SELECT CASE WHEN n >= 10 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS exposure, count(*) AS n_accounts FROM v GROUP BY 1""")
def a14_exposure(spark, d):
    v = E.incidence(comments(spark, d, None)).groupBy("username").agg(F.count(F.lit(1)).alias("n"))
    return v.groupBy(F.when(F.col("n") >= 10, "high").when(F.col("n") >= 3, "medium").otherwise("low").alias("exposure")).agg(F.count(F.lit(1)).alias("n_accounts"))


@R.query("a15_creator_groups", PREP + """, mk AS (SELECT DISTINCT video_url AS video, nullif(regexp_replace(regexp_replace(lower(trim(creator)), '^@+', ''), '\\s+', '', 'g'), '') AS maker FROM video_metadata_clean WHERE lower(trim(creator)) NOT IN ('', 'nan', 'none', 'null', '<na>')),
 g AS (SELECT username, (ascii(right(username, 1)) % 7)::BIGINT AS hcc_id FROM members)
 SELECT maker, hcc_id, count(*) AS n_comments, count(DISTINCT username) AS n_accounts, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM prep JOIN g USING (username) JOIN mk USING (video) GROUP BY 1, 2""")
def a15_creator_groups(spark, d):
    prep = comments(spark, d)
    groups = members(prep, makers(spark, d)).withColumn("hcc_id", F.expr("cast(ascii(right(username, 1)) % 7 as bigint)"))
    videos = table(spark, d, "video_metadata_clean").select(F.col("video_url").alias("video"), N.account(F.col("creator")).alias("maker")).where("maker is not null").distinct()
    when = lambda f, name: F.date_format(f("ts"), "yyyy-MM-dd HH:mm:ss").alias(name)
    return prep.join(groups, "username").join(videos, "video").groupBy("maker", "hcc_id").agg(F.count(F.lit(1)).alias("n_comments"), F.count_distinct("username").alias("n_accounts"), when(F.min, "first_at"), when(F.max, "last_at"))


@R.query("c14_visual_mask", PREP + _COMBINED + ", c AS (SELECT quantile_cont(final_weight, 0.9) AS cut FROM weighted) SELECT n_evidence >= 2 OR final_weight >= cut - 1e-12 AS shown, count(*) AS n FROM weighted, c GROUP BY 1")
def c14_visual_mask(spark, d):
    edges = stage(_edges(spark, d), "edges")
    cut = exact_quantile(edges, "final_weight", 0.9) or 0.0
    return edges.groupBy(((F.col("n_evidence") >= 2) | (F.col("final_weight") >= F.lit(cut) - 1e-12)).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


@R.query("c16_private_map", PREP + " SELECT DISTINCT username, 'MASS_' || left(sha256('kelindan:' || username), 12) AS public_id FROM mass")
def c16_private_map(spark, d):
    return mass(comments(spark, d), makers(spark, d)).select("username", N.pseudonym(F.col("username"), "kelindan").alias("public_id")).distinct()


@R.query("j5_change_diff", _PT + """, o AS (SELECT comment_id, min(label) AS other FROM u WHERE annotator_id <> 'ANN_03' GROUP BY 1) SELECT coalesce(pt.pred, '-') AS was, coalesce(o.other, '-') AS now, pt.pred IS DISTINCT FROM o.other AS changed, count(*) AS n FROM pt FULL JOIN o USING (comment_id) GROUP BY 1, 2, 3""")
def j5_change_diff(spark, d):
    other = _usable(spark, d).where("annotator_id <> 'ANN_03'").groupBy("comment_id").agg(F.min("label").alias("other"))
    both = _pt(spark, d).select("comment_id", "pred").join(other, "comment_id", "full")
    return both.groupBy(F.coalesce("pred", F.lit("-")).alias("was"), F.coalesce("other", F.lit("-")).alias("now"), (~F.col("pred").eqNullSafe(F.col("other"))).alias("changed")).agg(F.count(F.lit(1)).alias("n"))


@R.query("j15_expansion_counts", _GRAMS + """, c AS (SELECT lower(normalized_comment) AS text, count(*) AS n FROM hcc_copypasta_candidates WHERE normalized_comment <> '' GROUP BY 1)
 SELECT a AS text_1, b AS text_2, x.n * y.n AS n_row_pairs FROM sims JOIN c x ON x.text = a JOIN c y ON y.text = b""")
def j15_expansion_counts(spark, d):
    texts, pairs = _sims(spark, d)
    named = _named(texts, pairs)
    a, b = texts.select(F.col("text").alias("text_1"), F.col("n_rows").alias("n1")), texts.select(F.col("text").alias("text_2"), F.col("n_rows").alias("n2"))
    return named.join(a, "text_1").join(b, "text_2").select("text_1", "text_2", (F.col("n1") * F.col("n2")).alias("n_row_pairs"))


@R.query("m9_tiered_match", """WITH s AS (SELECT record_id, coalesce(sampling_stratum, '') AS st, coalesce(source_file, '') AS sf, regexp_replace(lower(trim(sample_role)), '[- ]+', '_', 'g') AS role FROM sample_registry),
 dv AS (SELECT * FROM s WHERE role = 'development_v2'), a AS (SELECT st, sf, min(record_id) AS m FROM dv GROUP BY 1, 2), b AS (SELECT st, min(record_id) AS m FROM dv GROUP BY 1), c AS (SELECT min(record_id) AS m FROM dv)
 SELECT record_id, coalesce(a.m, b.m, c.m) AS partner, CASE WHEN a.m IS NOT NULL THEN 'exact' WHEN b.m IS NOT NULL THEN 'stratum' ELSE 'any' END AS tier FROM s LEFT JOIN a USING (st, sf) LEFT JOIN b USING (st), c WHERE role = 'challenge_v2'""")
def m9_tiered_match(spark, d):
    """The least record of the first tier that has one: same stratum and source, same stratum, any."""
    s = table(spark, d, "sample_registry").select("record_id", F.coalesce("sampling_stratum", F.lit("")).alias("st"), F.coalesce("source_file", F.lit("")).alias("sf"), F.expr("regexp_replace(lower(trim(sample_role)), '[- ]+', '_')").alias("role"))
    dev = s.where("role = 'development_v2'")
    a, b = dev.groupBy("st", "sf").agg(F.min("record_id").alias("a")), dev.groupBy("st").agg(F.min("record_id").alias("b"))
    c = dev.agg(F.min("record_id").alias("c"))
    out = s.where("role = 'challenge_v2'").join(a, ["st", "sf"], "left").join(b, "st", "left").crossJoin(F.broadcast(c))  # one row
    return out.select("record_id", F.coalesce("a", "b", "c").alias("partner"), F.when(F.col("a").isNotNull(), "exact").when(F.col("b").isNotNull(), "stratum").otherwise("any").alias("tier"))


@R.query("m11_adjudication", _PT + """ SELECT CASE WHEN neg + neu + pos >= 3 AND greatest(neg, neu, pos) * 2 > neg + neu + pos THEN 'majority' WHEN pred = truth THEN 'agreement' ELSE 'UNRESOLVED' END AS how, count(*) AS n FROM pt GROUP BY 1""")
def m11_adjudication(spark, d):
    how = F.when((F.col("n_votes") >= 3) & (F.greatest("neg", "neu", "pos") * 2 > F.col("n_votes")), "majority").when(F.col("pred") == F.col("truth"), "agreement").otherwise("UNRESOLVED")
    return _pt(spark, d).groupBy(how.alias("how")).agg(F.count(F.lit(1)).alias("n"))


@R.query("m24_paired_bootstrap")
def m24_paired_bootstrap(spark, d):
    other = _usable(spark, d).groupBy("comment_id").agg(F.min("label").alias("other"))
    rows = _pt(spark, d).join(other, "comment_id").groupBy((F.col("pred") == F.col("truth")).alias("a"), (F.col("other") == F.col("truth")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return M.paired_bootstrap(rows)


@R.query("m28_error_flags", _PT + """ SELECT concat_ws('+', CASE WHEN pred = 'Neutral' OR truth = 'Neutral' THEN 'neutral' END, CASE WHEN (pred = 'Negative' AND truth = 'Positive') OR (pred = 'Positive' AND truth = 'Negative') THEN 'opposite' END, CASE WHEN n_votes < 4 THEN 'few_votes' END) AS flags, count(*) AS n FROM pt WHERE pred <> truth GROUP BY 1""")
def m28_error_flags(spark, d):
    opposite = ((F.col("pred") == "Negative") & (F.col("truth") == "Positive")) | ((F.col("pred") == "Positive") & (F.col("truth") == "Negative"))
    flags = F.array_compact(F.array(F.when((F.col("pred") == "Neutral") | (F.col("truth") == "Neutral"), "neutral"), F.when(opposite, "opposite"), F.when(F.col("n_votes") < 4, "few_votes")))
    return _pt(spark, d).where("pred <> truth").groupBy(F.array_join(flags, "+").alias("flags")).agg(F.count(F.lit(1)).alias("n"))


@R.query("m32_group_levels", _PT + """, nd AS (SELECT annotator_id FROM annotators), c AS (SELECT annotator_id, count(*) AS n, count_if(label = 'Negative') AS k FROM u GROUP BY 1)
 SELECT annotator_id, coalesce(n, 0) AS n, coalesce(k, 0) AS negative, round(coalesce(k / nullif(n, 0), 0), 9) AS share, round(CASE WHEN n > 0 THEN greatest(0, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((k / n) * (1 - k / n) / n + 1.96 * 1.96 / (4.0::DOUBLE * n * n))) / (1 + 1.96 * 1.96 / n)) END, 9) AS ci_low FROM nd LEFT JOIN c USING (annotator_id)""")
def m32_group_levels(spark, d):
    counts = _usable(spark, d).groupBy("annotator_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "Negative").alias("negative"))
    full = table(spark, d, "annotators").select("annotator_id").join(counts, "annotator_id", "left").na.fill(0)
    low, _ = wilson(F.col("negative"), F.col("n"))
    return full.select("annotator_id", "n", "negative", F.round(ratio(F.col("negative"), F.col("n")), 9).alias("share"), F.round(low, 9).alias("ci_low"))


@R.query("m34_label_stability")
def m34_label_stability(spark, d):
    counts = _usable(spark, d).groupBy("annotator_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return M.dominant_stability(counts, "annotator_id", "label", "n", LABELS)


@R.query("m37_support_sensitivity", _PT + """, t AS (SELECT unnest([3, 5, 6]) AS least) SELECT least, count(comment_id) AS n, round(coalesce(avg((pred = truth)::INT), 0), 9) AS accuracy FROM t LEFT JOIN pt ON n_votes >= least GROUP BY 1""")
def m37_support_sensitivity(spark, d):
    sizes = _pt(spark, d).groupBy("n_votes").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == F.col("truth")).alias("ok"))
    least = spark.createDataFrame([(3,), (5,), (6,)], "least int")
    joined = least.join(F.broadcast(sizes), F.col("n_votes") >= F.col("least"), "left")  # one row per number of votes
    return joined.groupBy("least").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.round(ratio(F.sum("ok"), F.sum("n")), 9).alias("accuracy"))


@R.query("t9_eligible", """WITH p AS (SELECT *, similarity_category = 'EXACT_DUPLICATE' AS ex, length(comment_1) < 12 AS short FROM comment_similarity_pairs WHERE comment_1 IS NOT NULL AND similarity_category IS NOT NULL)
 SELECT CASE WHEN similarity_category LIKE 'WEAK%' THEN false WHEN short THEN ex ELSE true END AS eligible, count(*) AS n FROM p GROUP BY 1""")
def t9_eligible(spark, d):
    rows = table(spark, d, "comment_similarity_pairs").where("comment_1 is not null and similarity_category is not null")
    ok = F.when(F.col("similarity_category").startswith("WEAK"), False).when(F.length("comment_1") < 12, F.col("similarity_category") == "EXACT_DUPLICATE").otherwise(True)
    return rows.groupBy(ok.alias("eligible")).agg(F.count(F.lit(1)).alias("n"))


@R.query("t12_member_ranks", "SELECT hcc_id, candidate_id, row_number() OVER (PARTITION BY hcc_id ORDER BY n_users DESC NULLS LAST, n_comments DESC NULLS LAST, candidate_id)::INT AS rank FROM hcc_copypasta_candidates")
def t12_member_ranks(spark, d):
    rows = table(spark, d, "hcc_copypasta_candidates").select("hcc_id", "candidate_id", "n_users", "n_comments")
    return A.running_rank(rows, ["hcc_id"], [F.desc_nulls_last("n_users"), F.desc_nulls_last("n_comments"), F.col("candidate_id")]).select("hcc_id", "candidate_id", "rank")


@R.query("t16_capped_pick")
def t16_capped_pick(spark, d):
    """Thirty examples by score, at most eight of a category and twelve of an actor pair."""
    rows = table(spark, d, "comment_similarity_pairs").select("pair_id", "similarity_category", "actor_pair_type", "cosine_similarity_char5")
    return S.capped_pick(rows, [F.desc_nulls_last("cosine_similarity_char5"), F.col("pair_id")], {"similarity_category": 8, "actor_pair_type": 12}, 30).select("pair_id")


@R.query("t17_head_and_fill", """WITH r AS (SELECT pair_id, similarity_category AS c, row_number() OVER (PARTITION BY similarity_category ORDER BY pair_id) AS k FROM comment_similarity_pairs), h AS (SELECT pair_id FROM r WHERE k <= 4)
 SELECT pair_id, 'head' AS part FROM h UNION ALL (SELECT pair_id, 'fill' FROM r WHERE k > 4 ORDER BY pair_id LIMIT 10)""")
def t17_head_and_fill(spark, d):
    rows = table(spark, d, "comment_similarity_pairs").select("pair_id", F.col("similarity_category").alias("c"))
    return S.head_and_fill(rows, "c", [F.col("pair_id")], 4, 10).select("pair_id", "part")


@R.query("t18_group_accounts", """SELECT hcc_id, count(*) AS n, count(DISTINCT normalized_comment) AS n_texts, sum(n_users)::BIGINT AS users, max(n_comments) AS most, min(candidate_id) AS first_id, round(avg(n_comments), 6) AS mean_comments FROM hcc_copypasta_candidates GROUP BY 1""")
def t18_group_accounts(spark, d):
    return table(spark, d, "hcc_copypasta_candidates").groupBy("hcc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("normalized_comment").alias("n_texts"), F.sum("n_users").alias("users"), F.max("n_comments").alias("most"), F.min("candidate_id").alias("first_id"), F.round(F.avg("n_comments"), 6).alias("mean_comments"),
    )


@R.query("t19_review_queue", """WITH g AS (SELECT hcc_id, sum(n_comments) AS s FROM hcc_copypasta_candidates WHERE hcc_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 20), r AS (SELECT c.hcc_id, candidate_id, row_number() OVER (PARTITION BY c.hcc_id ORDER BY n_users DESC NULLS LAST, candidate_id) AS k FROM hcc_copypasta_candidates c JOIN g USING (hcc_id))
 SELECT hcc_id, candidate_id, k::INT AS place FROM r WHERE k <= 3""")
def t19_review_queue(spark, d):
    rows = table(spark, d, "hcc_copypasta_candidates").where("hcc_id is not null").select("hcc_id", "candidate_id", "n_users", "n_comments")
    top = rows.groupBy("hcc_id").agg(F.sum("n_comments").alias("s")).orderBy(F.desc_nulls_last("s"), "hcc_id").limit(20).select("hcc_id")
    ranked = A.running_rank(rows.join(F.broadcast(top), "hcc_id", "left_semi"), ["hcc_id"], [F.desc_nulls_last("n_users"), F.col("candidate_id")])  # 20 rows
    return ranked.where("rank <= 3").select("hcc_id", "candidate_id", F.col("rank").alias("place"))


@R.query("t26_identical_clusters")
def t26_identical_clusters(spark, d):
    return text_clusters(table(spark, d, "hcc_copypasta_candidates"), "candidate_id", "normalized_comment").groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@R.query("h8_group_similarity")
def h8_group_similarity(spark, d):
    """Similarity of a group's accounts by what they wrote, over all pairs of accounts that wrote: mean, median, greatest cosine, and pairs of at least 0.70 and 0.85."""
    prep, creators = comments(spark, d, ("username", "text")), makers(spark, d)
    groups = members(prep, creators).withColumn("hcc_id", F.expr("cast(ascii(right(username, 1)) % 7 as bigint)"))
    texts = stage(prep.where("text <> ''").join(groups, "username").select(F.xxhash64("username").alias("text_id"), F.lower("text").alias("text"), F.col("hcc_id").alias("group_id")).distinct(), "texts")
    found = T.group_similarity(stage(T.tfidf(texts.select("text_id", "text")), "tfidf"), texts.select("text_id", "group_id"))
    every = groups.groupBy("hcc_id").agg(F.count(F.lit(1)).alias("n_accounts"))
    six = lambda c: F.round(c, 6).alias(c)
    return every.join(found.withColumnRenamed("group_id", "hcc_id"), "hcc_id", "left").select(
        "hcc_id", "n_accounts", *[F.coalesce(c, F.lit(0)).alias(o) for c, o in (("n_texts", "n_with_text"), ("n_pairs", "n_pairs"))], six("mean"), six("median"), six("most"),
        F.coalesce("n_070", F.lit(0)).alias("n_070"), F.coalesce("n_085", F.lit(0)).alias("n_085"),
    )


@R.query("win_order_share", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS share FROM orders WHERE o_orderpriority = '5-LOW'")
def win_order_share(spark, d):
    total = F.sum("o_totalprice").over(Window.partitionBy("o_custkey"))
    return table(spark, d, "orders").where("o_orderpriority = '5-LOW'").select("o_orderkey", F.round(F.col("o_totalprice") / total, 9).alias("share"))

