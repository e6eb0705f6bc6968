"""ROC and precision-recall curves and equal error rates over scores of any number.

Rows are first grouped by score, so ties are one step of the curve. Running totals go in two levels: the
distinct scores are range-partitioned into buckets of about BUCKET_ROWS, however they are spread; a window over the
few buckets gives each its start, and windows run inside buckets. No window ever holds all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomwork.functions.metrics import ratio
from loomwork.session import materialise

BUCKET_ROWS, BROADCAST_BUCKETS = 50_000, 10_000


def score_steps(rows: DataFrame, true: str = "true_label", score: str = "score", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(threshold, pos, neg, tp, fp, n_pos, n_neg, corner), one row per distinct score.

    tp and fp count rows scored at or above the threshold. corner marks the steps where the curve changes
    direction, and the first and last step. Rows with a null label or score are left out.
    """
    t = F.col(true)
    groups = (
        rows.where(t.isNotNull() & F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("threshold"))
        .agg(F.count_if(t == 1).alias("pos"), F.count_if(t == 0).alias("neg"))
    )
    groups = materialise(groups, "scores")
    ends = groups.agg(F.count("*").alias("steps"), F.max("threshold").alias("hi"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    hi, buckets = ends["hi"] or 0.0, max(1, -(-ends["steps"] // bucket_rows))
    bucketed = groups.withColumn("_b", F.lit(0))
    if buckets > 1:
        ranged = groups.repartitionByRange(buckets, F.desc("threshold")).withColumn("_b", F.spark_partition_id())
        bucketed = materialise(ranged, "score-buckets")
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    following = Window.orderBy("_b")
    starts = (
        bucketed.groupBy("_b")
        .agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.max_by(F.struct("pos", "neg"), "threshold").alias("_first"))
        .select(
            "_b",
            F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_p0"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
            F.lead("_first").over(following).alias("_next_first"),
        )
    )
    inside = Window.partitionBy("_b").orderBy(F.desc("threshold"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    step = F.struct("pos", "neg")
    after = F.coalesce(F.lead(step).over(inside), F.col("_next_first"))
    few = F.broadcast(starts) if buckets <= BROADCAST_BUCKETS else starts
    steps = bucketed.join(few, "_b").select(
        "threshold",
        "pos",
        "neg",
        (F.col("_p0") + F.sum("pos").over(upto)).alias("tp"),
        (F.col("_n0") + F.sum("neg").over(upto)).alias("fp"),
        F.lit(ends["p"] or 0).cast("long").alias("n_pos"),
        F.lit(ends["n"] or 0).cast("long").alias("n_neg"),
        (after.isNull() | (after != step) | (F.col("threshold") == F.lit(hi))).alias("corner"),
    )
    return steps if buckets == 1 else materialise(steps, "score-steps")  # one bucket is quickly made again


def roc_points(steps: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr), with the origin at the highest threshold plus 1; rates are null without their class."""
    body = steps.select("threshold", ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), ratio(F.col("tp"), F.col("n_pos")).alias("tpr"))
    origin = steps.agg((F.max("threshold") + 1.0).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")).where("threshold IS NOT NULL")
    return origin.unionByName(body)


def precision_recall_points(steps: DataFrame) -> DataFrame:
    """(threshold, precision, recall) and the last point (null, 1, 0)."""
    body = steps.select("threshold", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("n_pos")).alias("recall"))
    end = steps.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return body.unionByName(end)


def _crossing(points: DataFrame) -> DataFrame:
    """One row with the points on either side of fpr = 1 - tpr: a has fpr - fnr <= 0, b has more.

    The difference grows at every step, so a is the last point of its side and b the first of the other.
    """
    d = F.col("fpr") - (1.0 - F.col("tpr"))
    point = F.struct(d.alias("d"), "fpr", (1.0 - F.col("tpr")).alias("fnr"), "threshold")
    return points.agg(
        F.min_by(F.when(d <= 0, point), F.when(d <= 0, F.col("threshold"))).alias("a"),
        F.max_by(F.when(d > 0, point), F.when(d > 0, F.col("threshold"))).alias("b"),
    )


def _near(name: str) -> Column:
    a, b = F.col("a"), F.col("b")
    return F.when(b["d"].isNull() | (F.abs(a["d"]) <= F.abs(b["d"])), a[name]).otherwise(b[name])


def eer_interpolated(points: DataFrame) -> DataFrame:
    """(eer, eer_threshold) on the line between the two points around the crossing.

    At an exact crossing, and where the nearer point is an end of the curve, that point's midpoint counts.
    """
    a, b = F.col("a"), F.col("b")
    d = _near("d")
    end = (d == 0) | (d == -1) | (d == 1)
    t = F.try_divide(d, d - F.when(d == a["d"], b["d"]).otherwise(a["d"]))
    other = lambda n: F.when(d == a["d"], b[n]).otherwise(a[n])
    line = lambda n: _near(n) + t * (other(n) - _near(n))
    return _crossing(points).select(
        F.when(end, (_near("fpr") + _near("fnr")) / 2.0).otherwise(line("fpr")).alias("eer"),
        F.when(end, _near("threshold")).otherwise(line("threshold")).alias("eer_threshold"),
    )


def eer_nearest(steps: DataFrame) -> DataFrame:
    """(eer, eer_threshold) at the corner nearest the crossing: the mean of fpr and fnr there.

    Only corners of the curve are candidates, besides the origin, whose threshold is infinite.
    """
    corners = roc_points(steps.where("corner")).withColumn(
        "threshold", F.when((F.col("fpr") == 0) & (F.col("tpr") == 0) & F.col("threshold").isNotNull() & (F.col("threshold") > _highest(steps)), F.lit(float("inf"))).otherwise(F.col("threshold"))
    )
    return _crossing(corners).select(((_near("fpr") + _near("fnr")) / 2.0).alias("eer"), _near("threshold").alias("eer_threshold"))


def _highest(steps: DataFrame) -> Column:
    return F.lit(steps.agg(F.max("threshold").alias("t")).first()["t"]).cast("double")


def areas(steps: DataFrame) -> DataFrame:
    """(roc_auc, pr_auc): the trapezoids under the ROC steps and the rectangles under the precision-recall steps."""
    roc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    pr = F.sum(F.col("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    return steps.agg(
        ratio(roc, F.max("n_pos") * F.max("n_neg")).alias("roc_auc"),
        ratio(pr, F.max("n_pos")).alias("pr_auc"),
    )
