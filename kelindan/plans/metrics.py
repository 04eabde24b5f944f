"""Label quality over annotations and similarity scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelindan.operators import metrics as M
from kelindan.operators import sampling as S
from kelindan.plans.registry import Registry, table

R = Registry()

LABELS = ("Negative", "Neutral", "Positive")
_L = "CASE WHEN lower(trim(sentiment_label)) IN ('negative', 'negatif', 'neg') THEN 'Negative' WHEN lower(trim(sentiment_label)) IN ('neutral', 'netral', 'neu') THEN 'Neutral' WHEN lower(trim(sentiment_label)) IN ('positive', 'positif', 'pos') THEN 'Positive' END"
_ROLE = "regexp_replace(lower(trim(sample_role)), '[- ]+', '_', 'g')"
#: each comment's first and last usable answer stand for prediction and truth
_PT = f"""WITH a AS (SELECT comment_id, annotator_id, {_ROLE} AS role, {_L} AS label, annotation_id FROM annotations),
u AS (SELECT * FROM a WHERE label IS NOT NULL), pt AS (SELECT comment_id, arg_min(label, annotation_id) AS pred, arg_max(label, annotation_id) AS truth, min(role) AS role, count(*) AS n_votes,
 count_if(label = 'Negative') AS neg, count_if(label = 'Neutral') AS neu, count_if(label = 'Positive') AS pos FROM u GROUP BY 1)"""


def _usable(spark, d):
    return table(spark, d, "annotations").select("comment_id", "annotator_id", F.expr("regexp_replace(lower(trim(sample_role)), '[- ]+', '_')").alias("role"), F.expr(_L).alias("label"), "annotation_id", "annotated_at").where("label is not null")


def _pt(spark, d):
    return _usable(spark, d).groupBy("comment_id").agg(
        F.min_by("label", "annotation_id").alias("pred"), F.max_by("label", "annotation_id").alias("truth"), F.min("role").alias("role"), F.count(F.lit(1)).alias("n_votes"),
        *[F.count_if(F.col("label") == x).alias(n) for x, n in zip(LABELS, ("neg", "neu", "pos"), strict=True)],
    )


@R.query("m20_confusion", _PT + " SELECT truth, pred, count(*) AS n FROM pt GROUP BY 1, 2")
def m20_confusion(spark, d):
    return M.confusion(_pt(spark, d), "truth", "pred")


_REP = _PT + """, l AS (SELECT unnest(['Negative', 'Neutral', 'Positive']) AS label), r AS (SELECT label, (SELECT count(*) FROM pt WHERE truth = label) AS support, (SELECT count(*) FROM pt WHERE pred = label) AS predicted, (SELECT count(*) FROM pt WHERE truth = label AND pred = label) AS correct FROM l),
rep AS (SELECT *, coalesce(correct / nullif(predicted, 0), 0) AS precision, coalesce(correct / nullif(support, 0), 0) AS recall FROM r),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM rep)"""


@R.query("m20_class_report", _REP + " SELECT label, support, predicted, correct, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f")
def m20_class_report(spark, d):
    return M.class_report(M.confusion(_pt(spark, d), "truth", "pred"), LABELS).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@R.query("m20_summary", _REP + """, s AS (SELECT sum(support) AS n, sum(correct) AS c, avg(f1) AS mf, sum(f1 * support) AS wf, avg(recall) AS ba, sum(support * predicted) AS sp, sum(support * support) AS ss, sum(predicted * predicted) AS pp FROM f)
 SELECT n::BIGINT AS n, round(c / n, 9) AS accuracy, round(mf, 9) AS macro_f1, round(wf / n, 9) AS weighted_f1, round(ba, 9) AS balanced_accuracy, round((c * n - sp)::DOUBLE / sqrt((n * n - pp)::DOUBLE * (n * n - ss)::DOUBLE), 9) AS mcc FROM s""")
def m20_summary(spark, d):
    out = M.summary(M.confusion(_pt(spark, d), "truth", "pred"), LABELS)
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c != "n"})


@R.query("m12_kappa", _PT + """, c AS (SELECT count(*) AS n, avg((truth = pred)::INT) AS o, sum((truth = 'Negative')::INT) * sum((pred = 'Negative')::INT) + sum((truth = 'Neutral')::INT) * sum((pred = 'Neutral')::INT) + sum((truth = 'Positive')::INT) * sum((pred = 'Positive')::INT) AS e FROM pt)
 SELECT n, round(o, 9) AS agreement, round((o - e / (n * n)) / (1 - e / (n * n)), 9) AS kappa FROM c""")
def m12_kappa(spark, d):
    return M.kappa(M.confusion(_pt(spark, d), "truth", "pred"), LABELS).withColumns({c: F.round(c, 9) for c in ("agreement", "kappa")})


@R.query("m12_kappa_linear", _PT + """, x AS (SELECT list_position(['Negative', 'Neutral', 'Positive'], truth) AS t, list_position(['Negative', 'Neutral', 'Positive'], pred) AS p FROM pt), n AS (SELECT count(*) AS n, avg(1 - abs(t - p) / 2) AS o FROM x),
 ta AS (SELECT t, count(*) AS c FROM x GROUP BY 1), pb AS (SELECT p, count(*) AS c FROM x GROUP BY 1), e AS (SELECT sum(ta.c * pb.c * (1 - abs(t - p) / 2)) AS e FROM ta, pb)
 SELECT n, round(o, 9) AS agreement, round((o - e / n / n) / (1 - e / n / n), 9) AS kappa FROM n, e""")
def m12_kappa_linear(spark, d):
    return M.kappa(M.confusion(_pt(spark, d), "truth", "pred"), LABELS, weighted=True).withColumns({c: F.round(c, 9) for c in ("agreement", "kappa")})


_SOFT = _PT + """, e AS (SELECT *, exp(neg - greatest(neg, neu, pos)) AS en, exp(neu - greatest(neg, neu, pos)) AS eu, exp(pos - greatest(neg, neu, pos)) AS ep FROM pt),
 soft AS (SELECT *, en / (en + eu + ep) AS pn, eu / (en + eu + ep) AS pu, ep / (en + eu + ep) AS pp FROM e)"""


def _soft(spark, d):
    p = M.soft_labels({"Negative": F.col("neg").cast("double"), "Neutral": F.col("neu").cast("double"), "Positive": F.col("pos").cast("double")})
    return _pt(spark, d).withColumns({"pn": p["Negative"], "pu": p["Neutral"], "pp": p["Positive"]})


def _probabilities():
    return {"Negative": F.col("pn"), "Neutral": F.col("pu"), "Positive": F.col("pp")}


@R.query("m18_soft_labels", _SOFT + " SELECT comment_id, round(pn, 9) AS pn, round(pu, 9) AS pu, round(pp, 9) AS pp FROM soft")
def m18_soft_labels(spark, d):
    return _soft(spark, d).select("comment_id", *[F.round(c, 9).alias(c) for c in ("pn", "pu", "pp")])


@R.query("m19_abstaining", _SOFT + """ SELECT CASE WHEN n_votes < 2 THEN 'No Text' WHEN greatest(pn, pu, pp) < 0.6 THEN 'Uncertain' WHEN pn = greatest(pn, pu, pp) THEN 'Negative' WHEN pu = greatest(pn, pu, pp) THEN 'Neutral' ELSE 'Positive' END AS label, count(*) AS n FROM soft GROUP BY 1""")
def m19_abstaining(spark, d):
    label = M.abstaining_label(_probabilities(), F.col("n_votes") >= 2, 0.6)
    return _soft(spark, d).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


for _closed, _bin in (("left", "least(floor(c * 10), 9)"), ("right", "greatest(ceil(c * 10) - 1, 0)")):

    @R.query(f"m21_ece_{_closed}", _SOFT + f""", q AS (SELECT greatest(pn, pu, pp) AS c, (CASE WHEN pn = greatest(pn, pu, pp) THEN 'Negative' WHEN pu = greatest(pn, pu, pp) THEN 'Neutral' ELSE 'Positive' END = truth)::INT AS y FROM soft),
 b AS (SELECT {_bin} AS bin, count(*) AS n, avg(c) AS mc, avg(y) AS acc FROM q GROUP BY 1) SELECT sum(n)::BIGINT AS n, round(sum(n * abs(mc - acc)) / sum(n), 9) AS ece FROM b""")
    def _ece(spark, d, closed=_closed):
        p = _probabilities()
        label = M.abstaining_label(p, F.lit(True), 0.0)
        table_ = M.calibration(_soft(spark, d), F.greatest("pn", "pu", "pp"), label == F.col("truth"), 10, closed)
        return M.calibration_error(table_).withColumn("ece", F.round("ece", 9))


for _scale, _div in (("sum", 1), ("mean", 3)):

    @R.query(f"m21_brier_{_scale}", _SOFT + f" SELECT count(*) AS n, round(avg(((pn - (truth = 'Negative')::INT) ** 2 + (pu - (truth = 'Neutral')::INT) ** 2 + (pp - (truth = 'Positive')::INT) ** 2) / {_div}), 9) AS brier FROM soft")
    def _brier(spark, d, scale=_scale):
        return M.brier(_soft(spark, d), _probabilities(), F.col("truth"), scale).withColumn("brier", F.round("brier", 9))


@R.query("m22_threshold_curve", """WITH t AS (SELECT (x + 50) / 100.0::DOUBLE AS threshold FROM range(50) r(x)), p AS (SELECT cosine_similarity_char5 AS s, (token_jaccard >= 0.7)::INT AS y FROM comment_similarity_pairs WHERE cosine_similarity_char5 IS NOT NULL AND token_jaccard IS NOT NULL),
 a AS (SELECT count(*) AS n, sum(y) AS pos FROM p), c AS (SELECT threshold, count(s) AS selected, coalesce(sum(y), 0)::BIGINT AS tp FROM t LEFT JOIN p ON s >= threshold GROUP BY 1)
 SELECT threshold, selected, tp, round(selected / n, 9) AS coverage, round(coalesce(tp / nullif(selected, 0), 0), 9) AS precision, round(tp / pos, 9) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(selected + pos, 0), 0), 9) AS f1 FROM c, a""")
def m22_threshold_curve(spark, d):
    rows = table(spark, d, "comment_similarity_pairs")
    out = M.threshold_curve(rows, F.col("cosine_similarity_char5"), F.col("token_jaccard") >= 0.7, [(x + 50) / 100 for x in range(50)])
    return out.withColumns({c: F.round(c, 9) for c in ("coverage", "precision", "recall", "f1")})


@R.query("m23_bootstrap")
def m23_bootstrap(spark, d):
    return M.bootstrap_macro_f1(M.confusion(_pt(spark, d), "truth", "pred"), LABELS)


@R.query("m25_mcnemar", _PT + ", w AS (SELECT comment_id, min(label) AS other FROM u GROUP BY 1) SELECT count_if(pred = truth AND other <> truth) AS b, count_if(pred <> truth AND other = truth) AS c FROM pt JOIN w USING (comment_id)")
def m25_mcnemar(spark, d):
    other = _usable(spark, d).groupBy("comment_id").agg(F.min("label").alias("other"))
    return M.mcnemar(_pt(spark, d).join(other, "comment_id"), F.col("pred") == F.col("truth"), F.col("other") == F.col("truth")).select("b", "c")


@R.query("m29_shares", _PT + """, l AS (SELECT unnest(['Negative', 'Neutral', 'Positive', 'Mixed']) AS label), c AS (SELECT l.label, count(u.label) AS n FROM l LEFT JOIN u ON u.label = l.label GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS total FROM c)
 SELECT label, n, total, round(n / total, 9) AS share, round(greatest(0, (n / total + 1.96 * 1.96 / (2 * total) - 1.96 * sqrt((n / total) * (1 - n / total) / total + 1.96 * 1.96 / (4.0::DOUBLE * total * total))) / (1 + 1.96 * 1.96 / total)), 9) AS ci_low,
 round(least(1, (n / total + 1.96 * 1.96 / (2 * total) + 1.96 * sqrt((n / total) * (1 - n / total) / total + 1.96 * 1.96 / (4.0::DOUBLE * total * total))) / (1 + 1.96 * 1.96 / total)), 9) AS ci_high FROM c, t""")
def m29_shares(spark, d):
    return M.shares(_usable(spark, d), "label", [*LABELS, "Mixed"]).withColumns({c: F.round(c, 9) for c in ("share", "ci_low", "ci_high")})


@R.query("m27_subgroups", _PT + """, g AS (SELECT 'role' AS dimension, role AS value, (pred = truth)::INT AS y FROM pt UNION ALL SELECT 'n_votes', n_votes::VARCHAR, (pred = truth)::INT FROM pt)
 SELECT dimension, value, count(*) AS n, round(avg(y), 9) AS accuracy, count(*) >= 20 AS supported FROM g GROUP BY 1, 2""")
def m27_subgroups(spark, d):
    return M.subgroup_accuracy(_pt(spark, d), ["role", "n_votes"], F.col("pred") == F.col("truth")).withColumn("accuracy", F.round("accuracy", 9))


@R.query("m31_annotator_levels", _PT + """, a2 AS (SELECT annotator_id, avg((label = 'Negative')::INT) AS p FROM u GROUP BY 1)
 SELECT count(*) AS n, round(avg(p), 9) AS mean, round(median(p), 9) AS median, round(quantile_cont(p, 0.75) - quantile_cont(p, 0.25), 9) AS iqr FROM a2""")
def m31_annotator_levels(spark, d):
    each = _usable(spark, d).groupBy("annotator_id").agg(F.avg((F.col("label") == "Negative").cast("int")).alias("p"))
    return each.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 9).alias("mean"), F.round(F.percentile("p", 0.5), 9).alias("median"), F.round(F.percentile("p", 0.75) - F.percentile("p", 0.25), 9).alias("iqr"))


@R.query("m30_group_difference", _PT + """, g AS (SELECT role = 'development_v2' AS dev, avg((label = 'Negative')::INT) AS p, count(*) AS n FROM u WHERE role IS NOT NULL GROUP BY 1)
 SELECT dev, n, round(p, 9) AS p, round((SELECT p FROM g WHERE dev) - (SELECT p FROM g WHERE NOT dev), 9) AS difference FROM g""")
def m30_group_difference(spark, d):
    given = _usable(spark, d).where("role is not null").groupBy((F.col("role") == "development_v2").alias("dev")).agg(F.avg((F.col("label") == "Negative").cast("int")).alias("p"), F.count(F.lit(1)).alias("n"))
    diff = given.agg((F.max(F.when(F.col("dev"), F.col("p"))) - F.max(F.when(~F.col("dev"), F.col("p")))).alias("difference"))
    return given.crossJoin(F.broadcast(diff)).select("dev", "n", F.round("p", 9).alias("p"), F.round("difference", 9).alias("difference"))  # one row


@R.query("m35_aggregation_methods", _SOFT + """ SELECT role, round(avg((pred = 'Negative')::INT), 9) AS hard, round(avg(pn), 9) AS soft, round(sum(pn * greatest(pn, pu, pp)) / sum(greatest(pn, pu, pp)), 9) AS weighted, round((count_if(pred = 'Negative') + 1) / (count(*) + 3.0::DOUBLE), 9) AS smoothed FROM soft GROUP BY 1""")
def m35_aggregation_methods(spark, d):
    top = F.greatest("pn", "pu", "pp")
    return _soft(spark, d).groupBy("role").agg(
        F.round(F.avg((F.col("pred") == "Negative").cast("int")), 9).alias("hard"), F.round(F.avg("pn"), 9).alias("soft"),
        F.round(F.sum(F.col("pn") * top) / F.sum(top), 9).alias("weighted"), F.round((F.count_if(F.col("pred") == "Negative") + 1) / (F.count(F.lit(1)) + 3.0), 9).alias("smoothed"),
    )


@R.query("m38_transitions", _PT + " SELECT pred AS label, count_if(truth = 'Negative') AS Negative, count_if(truth = 'Neutral') AS Neutral, count_if(truth = 'Positive') AS Positive FROM pt GROUP BY 1")
def m38_transitions(spark, d):
    return _pt(spark, d).groupBy(F.col("pred").alias("label")).pivot("truth", list(LABELS)).agg(F.count(F.lit(1))).na.fill(0)


@R.query("m39_representatives", _SOFT + " SELECT pred, comment_id FROM (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY round(greatest(pn, pu, pp), 9) DESC, comment_id) AS r FROM soft) WHERE r <= 3")
def m39_representatives(spark, d):
    return S.head_per_group(_soft(spark, d), "pred", [F.desc(F.round(F.greatest("pn", "pu", "pp"), 9)), F.col("comment_id")], 3).select("pred", "comment_id")


_REG = "WITH s AS (SELECT record_id, comment_id, sampling_stratum, source_file, regexp_replace(lower(trim(sample_role)), '[- ]+', '_', 'g') AS role FROM sample_registry)"


def _registry(spark, d):
    return table(spark, d, "sample_registry").select("record_id", "comment_id", "sampling_stratum", "source_file", F.expr("regexp_replace(lower(trim(sample_role)), '[- ]+', '_')").alias("role"))


@R.query("m7_allocation", _REG + """, z AS (SELECT source_file, count(*) AS size FROM s GROUP BY 1), e AS (SELECT *, size * 100 / sum(size) OVER () AS x FROM z), f AS (SELECT *, floor(x) AS fl, 100 - sum(floor(x)) OVER () AS rest, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, source_file) AS r FROM e)
 SELECT source_file, size, least(size, fl + CASE WHEN r <= rest THEN 1 ELSE 0 END)::BIGINT AS allocated FROM f""")
def m7_allocation(spark, d):
    return S.largest_remainder(_registry(spark, d), "source_file", 100)


_DRAW = "(('0x' || left(md5({}::VARCHAR || ':{}'), 13))::BIGINT::DOUBLE / 4503599627370496)"


@R.query("m8_stratified_sample", _REG + """, z AS (SELECT source_file, count(*) AS size FROM s GROUP BY 1), e AS (SELECT *, size * 100 / sum(size) OVER () AS x FROM z), f AS (SELECT *, floor(x) AS fl, 100 - sum(floor(x)) OVER () AS rest, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, source_file) AS r FROM e),
 al AS (SELECT source_file, size, least(size, fl + CASE WHEN r <= rest THEN 1 ELSE 0 END)::BIGINT AS allocated FROM f), k AS (SELECT record_id, source_file, row_number() OVER (PARTITION BY source_file ORDER BY """ + _DRAW.format("record_id", 42) + """, record_id) AS r FROM s)
 SELECT record_id, k.source_file, size / allocated AS sample_weight FROM k JOIN al ON k.source_file IS NOT DISTINCT FROM al.source_file WHERE k.r <= allocated""")
def m8_stratified_sample(spark, d):
    return S.stratified_sample(_registry(spark, d).select("record_id", "source_file"), "source_file", "record_id", 100, 42)


@R.query("m10_weights", _REG + " SELECT role, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS selected_share, round(1 / greatest(count(*)::DOUBLE / sum(count(*)) OVER (), 1e-9), 6) AS weight FROM s GROUP BY 1")
def m10_weights(spark, d):
    from pyspark.sql import Window

    sizes = _registry(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row per role
    return sizes.select("role", "n", F.round(share, 9).alias("selected_share"), F.round(1 / F.greatest(share, F.lit(1e-9)), 6).alias("weight"))


@R.query("m6_quota_pick", _REG + """, a AS (SELECT record_id, 'test' AS rule FROM s WHERE role = 'locked_test_v2' ORDER BY record_id LIMIT 5), b AS (SELECT record_id, 'crawl' AS rule FROM s WHERE source_file LIKE 'crawl%' AND record_id NOT IN (SELECT record_id FROM a) ORDER BY record_id LIMIT 7)
 SELECT * FROM a UNION ALL SELECT * FROM b""")
def m6_quota_pick(spark, d):
    return S.quota_pick(_registry(spark, d), "record_id", [("test", F.coalesce(F.col("role") == "locked_test_v2", F.lit(False)), 5), ("crawl", F.coalesce(F.col("source_file").startswith("crawl"), F.lit(False)), 7)], [F.col("record_id")]).select("record_id", "rule")


@R.query("m13_source_priority", _REG + """ SELECT comment_id, record_id, role, conflict FROM (SELECT *, coalesce(max(role) OVER (PARTITION BY comment_id) <> min(role) OVER (PARTITION BY comment_id), false) AS conflict,
 row_number() OVER (PARTITION BY comment_id ORDER BY CASE role WHEN 'locked_test_v2' THEN 0 WHEN 'validation_v2' THEN 1 ELSE 2 END, record_id) AS r FROM s WHERE comment_id IS NOT NULL) WHERE r = 1""")
def m13_source_priority(spark, d):
    rank = F.when(F.col("role") == "locked_test_v2", 0).when(F.col("role") == "validation_v2", 1).otherwise(2)
    return S.source_priority(_registry(spark, d).where("comment_id is not null"), ["comment_id"], rank, "role", [F.col("record_id")]).select("comment_id", "record_id", "role", "conflict")


@R.query("m14_without_leaks", _REG + """ SELECT record_id FROM s WHERE role = 'locked_test_v2' UNION ALL SELECT record_id FROM s WHERE role IS DISTINCT FROM 'locked_test_v2' AND (comment_id IS NULL OR comment_id NOT IN (SELECT comment_id FROM s WHERE role = 'locked_test_v2' AND comment_id IS NOT NULL))""")
def m14_without_leaks(spark, d):
    return S.without_leaks(_registry(spark, d), "comment_id", "role", ["locked_test_v2"]).select("record_id")


@R.query("m15_group_folds", _REG + " SELECT CASE WHEN comment_id IS NULL THEN NULL ELSE floor(" + _DRAW.format("comment_id", 0) + " * 5)::INT END AS fold, count(*) AS n FROM s GROUP BY 1")
def m15_group_folds(spark, d):
    folds = S.group_folds(_registry(spark, d), "comment_id", 5).withColumn("fold", F.when(F.col("comment_id").isNotNull(), F.col("fold")))
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@R.query("q7_split_leaks", _REG + " SELECT comment_id, count(DISTINCT role) AS n_roles FROM s WHERE comment_id IS NOT NULL AND role IS NOT NULL GROUP BY 1 HAVING count(DISTINCT role) > 1")
def q7_split_leaks(spark, d):
    return S.split_leaks(_registry(spark, d), "comment_id", "role")


@R.query("t15_round_robin", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY c, a ORDER BY pair_id) AS t FROM (SELECT pair_id, coalesce(similarity_category, '') AS c, coalesce(actor_pair_type, '') AS a FROM comment_similarity_pairs)),
 r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY t, a) AS r FROM t) SELECT pair_id, c, a FROM r WHERE r <= 8""")
def t15_round_robin(spark, d):
    rows = table(spark, d, "comment_similarity_pairs").select("pair_id", F.coalesce("similarity_category", F.lit("")).alias("c"), F.coalesce("actor_pair_type", F.lit("")).alias("a"))
    return S.round_robin(rows, "c", "a", [F.col("pair_id")], 8)


@R.query("t20_banded_audit", "SELECT similarity_category AS band, pair_id FROM (SELECT *, row_number() OVER (PARTITION BY similarity_category ORDER BY cosine_similarity_char5 DESC NULLS LAST, pair_id) AS r FROM comment_similarity_pairs) WHERE r <= 25")
def t20_banded_audit(spark, d):
    rows = table(spark, d, "comment_similarity_pairs").select(F.col("similarity_category").alias("band"), "pair_id", "cosine_similarity_char5")
    return S.head_per_group(rows, "band", [F.desc_nulls_last("cosine_similarity_char5"), F.col("pair_id")], 25).select("band", "pair_id")


@R.query("m16_text_model")
def m16_text_model(spark, d):
    """Confusion of out-of-fold predictions of a text model against the usable answers."""
    from kelindan.operators import models

    rows = _pt(spark, d).join(table(spark, d, "annotations").groupBy("comment_id").agg(F.min("comment_text_original").alias("text")), "comment_id")
    index = F.create_map(*[F.lit(x) for i, name in enumerate(LABELS) for x in (name, float(i))])
    coded = rows.select("comment_id", "text", index[F.col("truth")].alias("label"))
    found = models.out_of_fold(coded, "comment_id", "comment_id", folds=2, iterations=5)
    names = F.array(*[F.lit(x) for x in LABELS])
    pred = names[F.array_position("p", F.array_max("p")).cast("int") - 1]
    return M.confusion(found.select(names[F.col("label").cast("int")].alias("t"), pred.alias("q")), "t", "q")
