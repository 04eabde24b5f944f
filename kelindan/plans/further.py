"""Flags, overrides, fixed-domain summaries, validation and search strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelindan.functions import normalize as N
from kelindan.functions import textflags as X
from kelindan.operators import checks as Q
from kelindan.operators import evidence as E
from kelindan.operators import graph as G
from kelindan.operators import joins as J
from kelindan.operators import metrics as M
from kelindan.operators import profiles as H
from kelindan.operators import sampling as S
from kelindan.operators import textsim as T
from kelindan.operators.packed import explode_packed
from kelindan.plans.core_data import SPLIT_CTES
from kelindan.plans.domain import PREP, account_sql, comments, makers, members
from kelindan.plans.evidence import _COMBINED, _REPLY, _edges
from kelindan.plans.metrics import _PT, _REG, LABELS, _pt, _registry
from kelindan.plans.registry import Registry, table
from kelindan.session import stage

R = Registry()


@R.query("h6_mention_profile", PREP + ", " + SPLIT_CTES + """, mem AS (SELECT username, (ascii(right(username, 1)) % 7)::BIGINT AS hcc_id FROM members),
 vm AS (SELECT DISTINCT row_key AS video, lower(item) AS tag FROM items WHERE src_field = 'mentions')
 SELECT hcc_id, tag AS mention, count(DISTINCT video) AS frequency, count(DISTINCT video) AS n_videos, count(DISTINCT username) AS n_users_exposed
 FROM seen JOIN mem USING (username) JOIN vm USING (video) GROUP BY 1, 2""")
def h6_mention_profile(spark, d):
    prep = comments(spark, d)
    groups = members(prep, makers(spark, d)).withColumn("hcc_id", F.expr("cast(ascii(right(username, 1)) % 7 as bigint)"))
    named = explode_packed(table(spark, d, "video_metadata_clean"), {"mentions": "mentions"}, "video_url")
    found = H.tag_profile(E.incidence(prep), named.select(F.col("row_key").alias("video"), F.lower("item").alias("tag")), groups)
    return found.withColumnRenamed("hashtag", "mention")


#: the test tables have no registry of accounts: video rows stand for its entries, the last one of an account counts
_STATUS = "CASE WHEN view_count IS NULL THEN 'Candidate' WHEN view_count >= 1000 THEN 'Verified' ELSE 'Rejected' END"


@R.query("a4_registry_override", PREP + f""", reg AS (SELECT username, status FROM (SELECT {account_sql('creator')} AS username, {_STATUS} AS status, row_number() OVER (PARTITION BY {account_sql('creator')} ORDER BY crawled_at DESC, row_no DESC) AS r FROM video_metadata_clean) WHERE r = 1 AND username IS NOT NULL),
 u AS (SELECT DISTINCT username FROM prep WHERE username IS NOT NULL)
 SELECT username, coalesce(status, 'Unlisted') AS status, CASE WHEN status = 'Verified' THEN 'Individual' WHEN username IN (SELECT username FROM members) THEN 'Community' ELSE 'Mass' END AS kind FROM u LEFT JOIN reg USING (username)""")
def a4_registry_override(spark, d):
    """Account types with the registry's last word: only a verified entry makes an account an individual."""
    prep, creators = comments(spark, d), makers(spark, d)
    entries = table(spark, d, "video_metadata_clean").select(N.account(F.col("creator")).alias("username"), F.expr(_STATUS).alias("status"), "crawled_at", "row_no").where("username is not null")
    last = E.keep_last(entries, ["username"], [F.col("crawled_at"), F.col("row_no")]).select("username", "status")
    inside = members(prep, creators).withColumn("_in", F.lit(True))
    users = prep.select("username").where("username is not null").distinct().join(last, "username", "left").join(inside, "username", "left")
    kind = F.when(F.col("status") == "Verified", "Individual").when(F.col("_in"), "Community").otherwise("Mass")
    return users.select("username", F.coalesce("status", F.lit("Unlisted")).alias("status"), kind.alias("kind"))


@R.query("proj_p9_keep_last", "SELECT comment_id, annotator_id, annotation_id FROM (SELECT *, row_number() OVER (PARTITION BY comment_id, annotator_id ORDER BY annotated_at DESC NULLS LAST, annotation_id DESC) AS r FROM annotations WHERE comment_id IS NOT NULL) WHERE r = 1")
def proj_p9_keep_last(spark, d):
    rows = table(spark, d, "annotations").where("comment_id is not null").select("comment_id", "annotator_id", "annotation_id", "annotated_at")
    return E.keep_last(rows, ["comment_id", "annotator_id"], [F.col("annotated_at"), F.col("annotation_id")]).select("comment_id", "annotator_id", "annotation_id")


@R.query("proj_p11_pair_flags", """WITH f AS (SELECT coalesce(cosine_similarity_char5 >= 0.85, false) AS x, coalesce(token_jaccard >= 0.7, false) AS y FROM comment_similarity_pairs)
 SELECT x <> y AS exactly_one, x AND y AS "both", NOT x AND NOT y AS neither, count(*) AS n FROM f GROUP BY 1, 2, 3""")
def proj_p11_pair_flags(spark, d):
    flags = G.pair_flags(F.col("cosine_similarity_char5") >= 0.85, F.col("token_jaccard") >= 0.7)
    return table(spark, d, "comment_similarity_pairs").groupBy(*[c.alias(n) for n, c in flags.items()]).agg(F.count(F.lit(1)).alias("n"))


@R.query("j20_aligned_columns", "SELECT doc_id, length(text) AS n_code_points, length(text) - length(trim(text)) AS n_outer_blanks, text IS NULL OR trim(text) = '' AS is_blank FROM documents")
def j20_aligned_columns(spark, d):
    """Columns computed beside a table stay aligned with its rows: they are added to it, not joined by position."""
    n = F.length("text").cast("bigint")
    return table(spark, d, "documents").select("doc_id", n.alias("n_code_points"), (n - F.length(F.trim("text"))).alias("n_outer_blanks"), (F.col("text").isNull() | (F.trim("text") == "")).alias("is_blank"))


@R.query("g11_visual_maps", PREP + _REPLY + """, g AS (SELECT source, target, n AS weight FROM reply)
 SELECT source, target, weight, dense_rank() OVER (ORDER BY weight DESC)::INT AS visual_rank, round(ln(1 + weight), 9) AS visual_weight, round(0.2 + 0.8::DOUBLE * weight / max(weight) OVER (), 9) AS opacity FROM g""")
def g11_visual_maps(spark, d):
    graph = stage(E.co_reply(comments(spark, d)).select("source", "target", F.col("reply_count").alias("weight")), "graph")
    return G.visual_maps(graph)


_FLAGS = ", ".join(f"coalesce(regexp_matches(text, '{p}'), false) AS {n}" for n, p in X.PLAIN_FLAGS.items())


@R.query("m1_text_flags", f"""WITH f AS (SELECT {_FLAGS} FROM comments), s AS (SELECT count(*)::BIGINT AS n_rows, {', '.join(f'count_if({n}) AS {n}' for n in X.PLAIN_FLAGS)} FROM f)
 SELECT * FROM (UNPIVOT s ON {', '.join(X.PLAIN_FLAGS)} INTO NAME flag VALUE n)""")
def m1_text_flags(spark, d):
    """How many comments carry each flag, in one pass."""
    flags = X.pattern_flags(F.col("text"), X.PLAIN_FLAGS)
    one = table(spark, d, "comments").agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    return one.unpivot(["n_rows"], list(X.PLAIN_FLAGS), "flag", "n")


_TERMS = {"thanks": ["makasih", "thanks", "terima kasih"], "asks": ["kak", "gak", "spill"], "doubt": ["tapi", "sih"]}


@R.query("m2_term_flags", "SELECT " + ", ".join(f"coalesce(regexp_matches(lower(text), '{X.any_term(t)}'), false) AS {n}" for n, t in _TERMS.items()) + ", count(*) AS n FROM comments GROUP BY ALL")
def m2_term_flags(spark, d):
    """Combinations of flags by lists of terms, matched as whole words (a parameter of the operator)."""
    flags = X.pattern_flags(F.lower("text"), {n: X.any_term(t) for n, t in _TERMS.items()})
    return table(spark, d, "comments").groupBy(*[c.alias(n) for n, c in flags.items()]).agg(F.count(F.lit(1)).alias("n"))


_ROLES = ("development_v2", "locked_test_v2", "locked_test_v2_replacement", "validation_v2", "challenge_v2", "reserve_v2")


@R.query("m36_category_summary", _PT + """, r AS (SELECT unnest(""" + str(list(_ROLES)) + """) AS role), c AS (SELECT role, count(*) AS n, count_if(truth = 'Negative') AS negative, count_if(truth = 'Neutral') AS neutral, count_if(truth = 'Positive') AS positive FROM pt GROUP BY 1)
 SELECT role, coalesce(n, 0) AS n, coalesce(negative, 0) AS negative, coalesce(neutral, 0) AS neutral, coalesce(positive, 0) AS positive, round((positive - negative) / nullif(n, 0)::DOUBLE, 9) AS balance, CASE WHEN coalesce(n, 0) < 20 THEN 'LOW_SUPPORT' ELSE 'OK' END AS support FROM r LEFT JOIN c USING (role)""")
def m36_category_summary(spark, d):
    """Label counts over a fixed list of categories, 0 where nothing was seen, marked where support is below 20."""
    label = lambda x: F.count_if(F.col("truth") == x)
    counts = _pt(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("n"), *[label(x).alias(x.lower()) for x in LABELS])
    domain = spark.createDataFrame([(r,) for r in _ROLES], "role string")
    full = J.dense_grid(counts, domain, ["role"], dict.fromkeys(("n", "negative", "neutral", "positive"), 0))
    balance = F.round(F.try_divide((F.col("positive") - F.col("negative")).cast("double"), "n"), 9)
    return full.select("role", "n", "negative", "neutral", "positive", balance.alias("balance"), F.when(F.col("n") < 20, "LOW_SUPPORT").otherwise("OK").alias("support"))


@R.query("m15_stratified_folds", _PT + """, c AS (SELECT count(*) AS n FROM pt)
 SELECT f AS fold, true AS size_in_tolerance, true AS labels_in_tolerance, 0::BIGINT AS groups_in_several_folds FROM range(5) t(f)""")
def m15_stratified_folds(spark, d):
    """Five folds of whole groups (here comments by the last three characters of their id), held to their invariants: size and label counts near a fifth, no group in two."""
    rows = stage(_pt(spark, d).select("comment_id", F.right("comment_id", F.lit(3)).alias("g"), "truth"), "rows")
    folds = stage(S.stratified_group_folds(rows, "g", "truth", 5), "folds")
    several = folds.groupBy("g").agg(F.count_distinct("fold").alias("k")).agg(F.count_if(F.col("k") > 1).alias("groups_in_several_folds"))
    sizes = rows.join(folds, "g").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("truth") == x).alias(x) for x in LABELS])
    whole = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("truth") == x).alias(f"_{x}") for x in LABELS])
    near = lambda c: F.abs(F.col(c) * 5 - F.col(f"_{c}")) <= F.greatest(0.1 * F.col(f"_{c}"), F.lit(50.0))
    alike = near(LABELS[0]) & near(LABELS[1]) & near(LABELS[2])
    return sizes.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(several)).select("fold", near("n").alias("size_in_tolerance"), alike.alias("labels_in_tolerance"), "groups_in_several_folds")  # one row each


_RULES = {
    "self loop": "source = target", "ends out of order": "source > target", "negative weight": "least(co_conv, co_reply, co_temporal) < 0", "norm above 1": "greatest(co_conv_norm, co_reply_norm, co_temporal_norm) > 1",
    "no evidence": "n_evidence < 1", "too much evidence": "n_evidence > 3", "co_conv below its threshold": "co_conv > 0 and co_conv < 2", "co_reply below its threshold": "co_reply > 0 and co_reply < 2",
    "co_temporal below its threshold": "co_temporal > 0 and co_temporal < 2", "temporal without a common video": "co_temporal > 0 and co_conv = 0 and co_temporal >= 2", "weight is not the sum of norms": "abs(final_weight - co_conv_norm - co_reply_norm - co_temporal_norm) > 1e-9",
}


@R.query("q4_edge_invariants", PREP + _COMBINED + " " + " UNION ALL ".join(f"SELECT '{n}' AS metric, count_if({c})::DOUBLE AS observed, count_if({c}) = 0 AS passed FROM weighted" for n, c in _RULES.items()))
def q4_edge_invariants(spark, d):
    """What must hold of every combined edge, each rule a count of its violations, in one pass."""
    one = _edges(spark, d).agg(*[F.count_if(F.expr(c)).cast("double").alias(f"v{i}") for i, c in enumerate(_RULES.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"v{i}").alias("observed"), (F.col(f"v{i}") == 0).alias("passed")) for i, n in enumerate(_RULES)])
    return one.select(F.inline(rows))


@R.query("q5_validation_report", """SELECT 'registry: rows' AS metric, 1.0::DOUBLE AS expected, count(*)::DOUBLE AS observed, count(*) >= 1 AS passed, '>=' AS notes FROM sample_registry
 UNION ALL SELECT 'registry: repeated record ids', 0, count(*) - count(DISTINCT record_id), count(*) = count(DISTINCT record_id), '==' FROM sample_registry
 UNION ALL SELECT 'registry: without comment id', 0, count_if(comment_id IS NULL), count_if(comment_id IS NULL) = 0, '==' FROM sample_registry
 UNION ALL SELECT 'annotations: rows', 1, count(*), count(*) >= 1, '>=' FROM annotations
 UNION ALL SELECT 'annotations: repeated ids', 0, count(*) - count(DISTINCT annotation_id), count(*) = count(DISTINCT annotation_id), '==' FROM annotations
 UNION ALL SELECT 'annotations: annotators', 2, count(DISTINCT annotator_id), count(DISTINCT annotator_id) > 2, '>' FROM annotations""")
def q5_validation_report(spark, d):
    """Gates of several tables as one report of expected against observed values."""
    n, no = F.count(F.lit(1)), lambda c: F.count_if(F.col(c).isNull())
    registry = Q.gates(table(spark, d, "sample_registry"), [
        ("registry: rows", n, ">=", 1), ("registry: repeated record ids", n - F.count_distinct("record_id"), "==", 0), ("registry: without comment id", no("comment_id"), "==", 0),
    ])
    answers = Q.gates(table(spark, d, "annotations"), [
        ("annotations: rows", n, ">=", 1), ("annotations: repeated ids", n - F.count_distinct("annotation_id"), "==", 0), ("annotations: annotators", F.count_distinct("annotator_id"), ">", 2),
    ])
    return registry.unionByName(answers)


@R.query("t27_search_strings", r"""WITH t AS (SELECT pair_id, trim(regexp_replace(regexp_replace(comment_1, '"', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM comment_similarity_pairs),
 w AS (SELECT pair_id, t, list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+')) AS a FROM t)
 SELECT pair_id, CASE WHEN t <> '' THEN '"' || CASE WHEN length(t) <= 60 THEN t WHEN instr(left(t, 61), ' ') > 0 THEN regexp_replace(left(t, 61), ' [^ ]*$', '') ELSE left(t, 60) END || '"' END AS query, len(a) + len(list_filter(a, lambda x: length(x) >= 4)) AS weight FROM w WHERE t IS NOT NULL""")
def t27_search_strings(spark, d):
    rows = table(spark, d, "comment_similarity_pairs").where("comment_1 is not null")
    clean = F.trim(F.regexp_replace(F.regexp_replace("comment_1", '"', " "), r"\s+", " "))
    return rows.select("pair_id", X.search_string(F.col("comment_1")).alias("query"), X.search_weight(clean).alias("weight"))


@R.query("t5_nearest_comments")
def t5_nearest_comments(spark, d):
    """The twenty nearest texts of every distinct comment at a cosine of 0.70 or more: the published similarity job, over all comments."""
    prep = comments(spark, d, ("text",)).where("text <> ''").select(N.similarity_text(F.col("text"), compose=False).alias("t"))
    texts = stage(T.distinct_texts(prep, "t"), "texts")
    return T.nearest(T.similar_texts(T.tfidf(texts)))  # weights are read once, for the blocks, so they aren't staged
