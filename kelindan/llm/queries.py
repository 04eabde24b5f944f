"""Queries of the llm operators, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelindan.llm import canon, consensus, encode, neardup, overlap, packing, pii, truncation
from kelindan.plans.registry import Registry, table

R = Registry()


def _looking(spark, d):
    """The two fields of problem 1 and the one table of rewrites for both."""
    fields = [
        (table(spark, d, "video_metadata_clean"), "video_url", "caption", "video_metadata_clean"),
        (table(spark, d, "hcc_copypasta_candidates"), "candidate_id", "normalized_comment", "hcc_copypasta_candidates"),
    ]
    return fields, canon.corpus_table(*[(df, column) for df, _, column, _ in fields])


@R.query("p1_found")
def p1_found(spark, d):
    fields, rewrites = _looking(spark, d)
    videos, copies = (canon.same_looking_pairs(*field, rewrites) for field in fields)
    return videos.unionByName(copies)


@R.query("p1_classes")
def p1_classes(spark, d):
    fields, rewrites = _looking(spark, d)
    videos, copies = (canon.same_looking_classes(*field, rewrites) for field in fields)
    return videos.unionByName(copies)


@R.query("p1_canonical")
def p1_canonical(spark, d):
    fields, rewrites = _looking(spark, d)
    videos, copies = (canon.with_canonical(df.select(F.lit(src).alias("src_table"), F.col(key).alias("row_key"), F.col(column).alias("text")), "text", table=rewrites) for df, key, column, src in fields)
    return videos.unionByName(copies).select("src_table", "row_key", "canonical").distinct()


def _near(spark, d):
    pairs = table(spark, d, "comment_similarity_pairs").selectExpr("'comment_similarity_pairs' as src", "pair_id as key", "comment_1 as text")
    copies = table(spark, d, "hcc_copypasta_candidates").selectExpr("'hcc_copypasta_candidates' as src", "candidate_id as key", "sample_original_comments as text")
    return neardup.near_duplicate_classes(pairs.unionByName(copies))


@R.query("p2_found")
def p2_found(spark, d):
    return neardup.class_pairs(_near(spark, d))


@R.query("p2_classes")
def p2_classes(spark, d):
    classes = _near(spark, d)
    names = classes.where("class is not null").groupBy("class").agg(F.min("key").alias("class_key"), F.count(F.lit(1)).alias("class_rows"))
    return classes.join(names, "class", "left").select(F.col("src").alias("src_table"), F.col("key").alias("row_key"), "class_key", "class_rows")


@R.query("p4_found")
def p4_found(spark, d):
    pairs = overlap.split_overlaps(table(spark, d, "sample_registry"))
    return pairs.select(F.least("training_id", "evaluation_id").alias("record_id_1"), F.greatest("training_id", "evaluation_id").alias("record_id_2"))


@R.query("p4_report")
def p4_report(spark, d):
    given = table(spark, d, "sample_registry")
    return overlap.overlap_report(given, overlap.split_overlaps(given))


@R.query("p8_ids")
def p8_ids(spark, d):
    return encode.encode_column(table(spark, d, "documents"), "text", encode.rank_path("byte_bpe_50k"))


@R.query("p8_round_trip", "SELECT doc_id, true AS same FROM documents")
def p8_round_trip(spark, d):
    return encode.round_trip(table(spark, d, "documents"), "text", encode.rank_path("byte_bpe_50k"))


def _votes(spark, d):
    return consensus.latest_votes(table(spark, d, "annotations"), "comment_id", "annotator_id", "sentiment_label", "annotated_at", "annotation_id")


@R.query("p6_found")
def p6_found(spark, d):
    model, items = consensus.fit(_votes(spark, d))
    found = consensus.consensus(model, consensus.at_least(items, 3))
    return found.select(F.col("item").alias("comment_id"), F.col("label").alias("sentiment_label"))


@R.query("p6_reliability")
def p6_reliability(spark, d):
    model, _ = consensus.fit(_votes(spark, d))
    return consensus.reliability(model, spark)


_VOTES_SQL = """
WITH g AS (SELECT comment_id, annotator_id, CASE
    WHEN lower(trim(sentiment_label)) IN ('negative', 'negatif', 'neg') THEN 'Negative'
    WHEN lower(trim(sentiment_label)) IN ('neutral', 'netral', 'neu') THEN 'Neutral'
    WHEN lower(trim(sentiment_label)) IN ('positive', 'positif', 'pos') THEN 'Positive' END AS label,
    row_number() OVER (PARTITION BY comment_id, annotator_id ORDER BY annotated_at DESC, annotation_id DESC) AS r
  FROM annotations WHERE comment_id IS NOT NULL AND annotator_id IS NOT NULL),
v AS (SELECT comment_id, annotator_id, label FROM g WHERE r = 1 AND label IS NOT NULL)"""


@R.query("p6_agreement", _VOTES_SQL + """,
i AS (SELECT comment_id, count(*) AS m, count_if(label = 'Negative') AS a, count_if(label = 'Neutral') AS b, count_if(label = 'Positive') AS c
      FROM v GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT count(*) AS n_items, sum(m) AS n, sum((a * (m - a) + b * (m - b) + c * (m - c)) / (m - 1)) AS d, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM i)
SELECT n_items, n::BIGINT AS n_votes, d / n AS observed_disagreement,
  (a * (n - a) + b * (n - b) + c * (n - c)) / (n - 1) / n AS expected_disagreement,
  1 - (d / n) / ((a * (n - a) + b * (n - b) + c * (n - c)) / (n - 1) / n) AS alpha FROM s""")
def p6_agreement(spark, d):
    return consensus.krippendorff(_votes(spark, d))


@R.query("p10_found")
def p10_found(spark, d):
    return truncation.truncated(table(spark, d, "documents")).select("doc_id")


@R.query("p10_cuts")
def p10_cuts(spark, d):
    return truncation.truncated(table(spark, d, "documents")).select("doc_id", "detector", "cut_by")


@R.query("p10_report")
def p10_report(spark, d):
    docs = table(spark, d, "documents")
    return truncation.truncation_report(docs, truncation.truncated(docs))


def _detector(spark, d):
    return pii.fit_detector(table(spark, d, "comment_similarity_pairs"), "pair_id", "comment_2", table(spark, d, "name_parts"))


@R.query("p7_found")
def p7_found(spark, d):
    return pii.find_items(table(spark, d, "comment_similarity_pairs"), "pair_id", "comment_2", _detector(spark, d)).select("pair_id", "pii_type", "start_at")


@R.query("p7_redacted")
def p7_redacted(spark, d):
    given = table(spark, d, "comment_similarity_pairs").select("pair_id", "comment_2")
    return pii.redact(given, "comment_2", _detector(spark, d)).select("pair_id", "redacted")


def _sized(spark, d):
    return encode.encode_column(table(spark, d, "documents"), "text", encode.rank_path("byte_bpe_50k"), counts_only=True)


@R.query("p9_packing")
def p9_packing(spark, d):
    return packing.pack(_sized(spark, d))


@R.query("p9_summary")
def p9_summary(spark, d):
    packed, packer = packing.pack_with(_sized(spark, d))
    return packing.packing_summary(packed).withColumn("n_fixed", F.lit(packer.fixed).cast("bigint"))
