"""Evaluation queries: labels.toxic is the truth, a hash of doc_id the score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwork.functions import curves, metrics


def predictions(spark: SparkSession, sf_dir: str, modulus: int = 1009) -> DataFrame:
    """(index, true_label, score, probability, predicted_label) over all of labels."""
    score = F.pmod(F.col("doc_id") * 7919, F.lit(modulus)) / F.lit(float(modulus))
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("index"), F.col("toxic").alias("true_label"), score.alias("score"))
    return metrics.decide(rows.withColumn("probability", F.col("score")))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


PREDICTIONS = """p AS (
  SELECT doc_id AS index, toxic AS true_label, ((doc_id * 7919) % {m})::DOUBLE / {m}::DOUBLE AS score,
         CASE WHEN ((doc_id * 7919) % {m})::DOUBLE / {m}::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS predicted_label FROM labels
)"""
P1009, P101 = PREDICTIONS.format(m=1009), PREDICTIONS.format(m=101)

STEPS = """, g AS (
  SELECT score AS threshold, count(*) FILTER (WHERE true_label = 1) AS pos, count(*) FILTER (WHERE true_label = 0) AS neg FROM p GROUP BY score
), s AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, (SELECT sum(pos) FROM g) AS n_pos, (SELECT sum(neg) FROM g) AS n_neg,
         row_number() OVER (ORDER BY threshold DESC) AS k, lead(pos) OVER (ORDER BY threshold DESC) AS next_pos,
         lead(neg) OVER (ORDER BY threshold DESC) AS next_neg
  FROM g WINDOW w AS (ORDER BY threshold DESC)
), roc AS (
  SELECT max(threshold) + 1 AS threshold, 0::DOUBLE AS fpr, 0::DOUBLE AS tpr, 0 AS k, true AS corner FROM g
  UNION ALL
  SELECT threshold, fp / n_neg::DOUBLE, tp / n_pos::DOUBLE, k, k = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg FROM s
)"""

RATES = """
SELECT tn, fp, fn, tp, tn + fp + fn + tp AS num_samples, round((tn + tp) / (tn + fp + fn + tp)::DOUBLE, 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
       round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE, 6) AS f1,
       round(fn / nullif(fn + tp, 0)::DOUBLE, 6) AS apcer, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS bpcer,
       round((fn / nullif(fn + tp, 0)::DOUBLE + fp / nullif(fp + tn, 0)::DOUBLE) / 2, 6) AS acer,
       round((fp + fn) / (tn + fp + fn + tp)::DOUBLE, 6) AS error_rate
FROM (SELECT {by} count(*) FILTER (WHERE true_label = 0 AND predicted_label = 0) AS tn, count(*) FILTER (WHERE true_label = 0 AND predicted_label = 1) AS fp,
             count(*) FILTER (WHERE true_label = 1 AND predicted_label = 0) AS fn, count(*) FILTER (WHERE true_label = 1 AND predicted_label = 1) AS tp
      FROM p {group}) c
"""

CROSSING = """, x AS (SELECT *, 1 - tpr AS fnr, fpr - (1 - tpr) AS d FROM roc {where}),
b AS (SELECT *, row_number() OVER (ORDER BY k) AS i, lag(d) OVER (ORDER BY k) AS d0, lag(fpr) OVER (ORDER BY k) AS fpr0, lag(threshold) OVER (ORDER BY k) AS t0,
             lead(d) OVER (ORDER BY k) AS d1, lead(fpr) OVER (ORDER BY k) AS fpr1, lead(threshold) OVER (ORDER BY k) AS t1 FROM x),
nearest AS (SELECT * FROM b ORDER BY abs(d), k LIMIT 1)
"""

EER = """
SELECT round(CASE WHEN d = 0 OR d0 IS NULL OR d1 IS NULL THEN (fpr + fnr) / 2
                  WHEN d0 * d < 0 THEN fpr + d / (d - d0) * (fpr0 - fpr) ELSE fpr + d / (d - d1) * (fpr1 - fpr) END, 6) AS eer,
       round(CASE WHEN d = 0 OR d0 IS NULL OR d1 IS NULL THEN threshold
                  WHEN d0 * d < 0 THEN threshold + d / (d - d0) * (t0 - threshold) ELSE threshold + d / (d - d1) * (t1 - threshold) END, 6) AS eer_threshold
FROM nearest
"""


def confusion_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rates(metrics.confusion(metrics.check_labels(predictions(spark, sf_dir)))))


def full_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row with every metric at threshold 0.5."""
    rows = predictions(spark, sf_dir)
    steps = curves.score_steps(rows)
    parts = [
        metrics.rates(metrics.confusion(rows)),
        curves.areas(steps),
        curves.eer_interpolated(curves.roc_points(steps)),
        metrics.at_threshold(rows, [0.5]).withColumnRenamed("threshold", "decision_threshold"),
    ]
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    out = keyed[0]
    for part in keyed[1:]:
        out = out.join(F.broadcast(part), "_one")  # one row each
    return rounded(out.drop("_one"))


QUERIES = {
    "confusion_rates": confusion_rates,
    "full_evaluation": full_evaluation,
    "confusion_k_class": lambda s, d: metrics.k_class_confusion(predictions(s, d), 3),
    "class_report": lambda s, d: rounded(metrics.class_report(predictions(s, d))),
    "far_frr_at_thresholds": lambda s, d: rounded(metrics.at_threshold(predictions(s, d), [0.1, 0.25, 0.5, 0.75, 0.9])),
    "roc_curve": lambda s, d: rounded(curves.roc_points(curves.score_steps(predictions(s, d)))),
    "roc_curve_ties": lambda s, d: rounded(curves.roc_points(curves.score_steps(predictions(s, d, 101)))),
    "precision_recall_curve": lambda s, d: rounded(curves.precision_recall_points(curves.score_steps(predictions(s, d, 101)))),
    "curve_areas": lambda s, d: rounded(curves.areas(curves.score_steps(predictions(s, d, 101)))),
    "eer_interpolated": lambda s, d: rounded(curves.eer_interpolated(curves.roc_points(curves.score_steps(predictions(s, d, 101))))),
    "eer_nearest": lambda s, d: rounded(curves.eer_nearest(curves.score_steps(predictions(s, d, 101)))),
    "class_weights": lambda s, d: rounded(metrics.class_weights(s.read.parquet(f"{d}/labels.parquet"), "quality")),
    "top_false_positives": lambda s, d: rounded(metrics.top_errors(predictions(s, d), "fp", 10)),
    "top_false_negatives": lambda s, d: rounded(metrics.top_errors(predictions(s, d), "fn", 10)),
    "least_confident": lambda s, d: rounded(metrics.least_confident(predictions(s, d), 10)),
    "hard_examples": lambda s, d: rounded(metrics.hard_examples(predictions(s, d), 0.1)),
    "misclassified": lambda s, d: rounded(metrics.misclassified(predictions(s, d))),
    "error_summary": lambda s, d: rounded(metrics.error_summary(predictions(s, d))),
    "losses": lambda s, d: losses(s, d),
}


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cross-entropy, class-weighted and not, and mean focal loss."""
    rows = predictions(spark, sf_dir).withColumn("p", F.greatest(F.least(F.col("score"), F.lit(0.999)), F.lit(0.001)))
    label = F.col("true_label")
    weight = F.when(label == 1, 4.0).otherwise(0.5)
    plain, ones = metrics.cross_entropy(F.col("p"), label)
    heavy, weights = metrics.cross_entropy(F.col("p"), label, weight)
    return rounded(
        rows.agg(
            (F.sum(plain) / F.sum(ones)).alias("cross_entropy"),
            (F.sum(heavy) / F.sum(weights)).alias("weighted_cross_entropy"),
            F.avg(metrics.focal_loss(F.col("p"), label)).alias("focal"),
            F.avg(metrics.focal_loss(F.col("p"), label, 2.0, weight)).alias("focal_alpha"),
        )
    )


CONFIDENCE = "CASE WHEN predicted_label = 1 THEN score ELSE 1 - score END"
ORACLES = {
    "confusion_rates": f"WITH {P1009}" + RATES.format(by="", group=""),
    "full_evaluation": f"WITH {P1009}{STEPS}{CROSSING.format(where='')}, rates AS ({RATES.format(by='', group='')}), eer AS ({EER})"
    """ SELECT rates.*, eer.*, round((SELECT sum(neg * (tp - pos / 2.0)) / max(n_pos * n_neg) FROM s)::DOUBLE, 6) AS roc_auc,
        round((SELECT sum(pos * tp / (tp + fp)::DOUBLE) / max(n_pos) FROM s)::DOUBLE, 6) AS pr_auc, 0.5::DOUBLE AS decision_threshold,
        round((SELECT avg((score < 0.5)::INT) FROM p WHERE true_label = 1), 6) AS far,
        round((SELECT avg((score >= 0.5)::INT) FROM p WHERE true_label = 0), 6) AS frr FROM rates, eer""",
    "confusion_k_class": f"""WITH {P1009} SELECT t::INT AS true_label, y::INT AS predicted_label, count(p.index)::BIGINT AS n
        FROM range(3) a(t), range(3) b(y) LEFT JOIN p ON p.true_label = t AND p.predicted_label = y GROUP BY 1, 2""",
    "class_report": f"""WITH {P1009}, c AS (SELECT label, count(*) FILTER (WHERE true_label = label AND predicted_label = label) AS tp,
        count(*) FILTER (WHERE true_label <> label AND predicted_label = label) AS fp, count(*) FILTER (WHERE true_label = label AND predicted_label <> label) AS fn,
        count(*) FILTER (WHERE true_label = label)::BIGINT AS support FROM p, (VALUES (0), (1)) v(label) GROUP BY label)
        SELECT label, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
        round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE, 6) AS f1, support FROM c""",
    "far_frr_at_thresholds": f"""WITH {P1009} SELECT t::DOUBLE AS threshold, round(avg((score < t::DOUBLE)::INT) FILTER (WHERE true_label = 1), 6) AS far,
        round(avg((score >= t::DOUBLE)::INT) FILTER (WHERE true_label = 0), 6) AS frr FROM p, (VALUES (0.1), (0.25), (0.5), (0.75), (0.9)) v(t) GROUP BY t""",
    "roc_curve": f"WITH {P1009}{STEPS} SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc",
    "roc_curve_ties": f"WITH {P101}{STEPS} SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc",
    "precision_recall_curve": f"""WITH {P101}{STEPS} SELECT round(threshold, 6) AS threshold, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / n_pos::DOUBLE, 6) AS recall
        FROM s UNION ALL SELECT NULL, 1, 0""",
    "curve_areas": f"""WITH {P101}{STEPS} SELECT round((sum(neg * (tp - pos / 2.0)) / max(n_pos * n_neg))::DOUBLE, 6) AS roc_auc,
        round((sum(pos * tp / (tp + fp)::DOUBLE) / max(n_pos))::DOUBLE, 6) AS pr_auc FROM s""",
    "eer_interpolated": f"WITH {P101}{STEPS}{CROSSING.format(where='')}{EER}",
    "eer_nearest": f"WITH {P101}{STEPS}{CROSSING.format(where='WHERE corner')} SELECT round((fpr + fnr) / 2, 6) AS eer, round(threshold, 6) AS eer_threshold FROM nearest",
    "class_weights": """WITH c AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1)
        SELECT r.l::INT AS label, coalesce(c.n, 0)::BIGINT AS n, round(coalesce((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * c.n)::DOUBLE, 0), 6) AS weight
        FROM (SELECT unnest(range((SELECT max(label) FROM c) + 1)) AS l) r LEFT JOIN c ON c.label = r.l""",
    "top_false_positives": f"""WITH {P1009} SELECT index, true_label, round(score, 6) AS score, round(score, 6) AS probability, predicted_label, round({CONFIDENCE}, 6) AS confidence,
        'false_positive' AS error_type FROM p WHERE true_label = 0 AND predicted_label = 1 ORDER BY {CONFIDENCE} DESC, index LIMIT 10""",
    "top_false_negatives": f"""WITH {P1009} SELECT index, true_label, round(score, 6) AS score, round(score, 6) AS probability, predicted_label, round({CONFIDENCE}, 6) AS confidence,
        'false_negative' AS error_type FROM p WHERE true_label = 1 AND predicted_label = 0 ORDER BY {CONFIDENCE} DESC, index LIMIT 10""",
    "least_confident": f"""WITH {P1009} SELECT index, true_label, round(score, 6) AS score, round(score, 6) AS probability, predicted_label, true_label = predicted_label AS is_correct,
        round({CONFIDENCE}, 6) AS confidence FROM p ORDER BY {CONFIDENCE}, index LIMIT 10""",
    "hard_examples": f"""WITH {P1009} SELECT index, true_label, round(score, 6) AS score, round(score, 6) AS probability, predicted_label FROM p
        WHERE abs(score - 0.5::DOUBLE) <= 0.1::DOUBLE""",
    "misclassified": f"""WITH {P1009} SELECT index, true_label, round(score, 6) AS score, round(score, 6) AS probability, predicted_label,
        round(CASE WHEN predicted_label = 1 THEN score ELSE 1 - score END, 6) AS confidence,
        CASE WHEN predicted_label = 1 THEN 'false_positive' ELSE 'false_negative' END AS error_type FROM p WHERE true_label <> predicted_label""",
    "error_summary": f"""WITH {P1009}, q AS (SELECT *, true_label <> predicted_label AS wrong, CASE WHEN predicted_label = 1 THEN score ELSE 1 - score END AS c FROM p)
        SELECT count(*) AS total, count(*) FILTER (WHERE wrong) AS errors, count(*) FILTER (WHERE wrong AND predicted_label = 1) AS false_positives,
        count(*) FILTER (WHERE wrong AND predicted_label = 0) AS false_negatives, count(*) FILTER (WHERE abs(score - 0.5::DOUBLE) <= 0.1::DOUBLE) AS hard,
        round(coalesce(count(*) FILTER (WHERE wrong) / nullif(count(*), 0)::DOUBLE, 0), 6) AS error_rate,
        round(avg(c) FILTER (WHERE wrong), 6) AS confidence_wrong, round(avg(c) FILTER (WHERE NOT wrong), 6) AS confidence_right FROM q""",
    "losses": f"""WITH {P1009}, q AS (SELECT true_label, greatest(least(score, 0.999::DOUBLE), 0.001::DOUBLE) AS pp, CASE WHEN true_label = 1 THEN 4.0 ELSE 0.5 END::DOUBLE AS w FROM p),
        r AS (SELECT w, CASE WHEN true_label = 1 THEN pp ELSE 1 - pp END AS pt FROM q)
        SELECT round(-sum(ln(pt)) / count(*), 6) AS cross_entropy, round(-sum(ln(pt) * w) / sum(w), 6) AS weighted_cross_entropy,
        round(avg(-pow(1 - pt, 2) * ln(pt)), 6) AS focal, round(avg(-pow(1 - pt, 2) * ln(pt) * w), 6) AS focal_alpha FROM r""",
}
