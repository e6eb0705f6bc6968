"""Detection metrics as grouped aggregates; label 1 is an attack, 0 bona fide. Undefined metrics are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ratio(over: Column, under: Column, empty: float | None = None) -> Column:
    """over / under as a double; `empty` (null by default) where under is 0."""
    value = F.try_divide(over.cast("double"), under.cast("double"))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def check_predictions(rows: DataFrame, true: str = "true_label", predicted: str = "predicted_label", probability: str = "probability") -> DataFrame:
    """rows, failing at run time where a label isn't 0 or 1 or a probability lies outside 0..1 or is missing."""
    p = F.col(probability)
    good = check_labels(check_labels(rows, true), predicted)
    bad = F.raise_error(F.concat(F.lit(f"{probability} must be within 0 and 1, not "), F.coalesce(p.cast("string"), F.lit("null"))))
    return good.withColumn(probability, F.when(F.coalesce((p >= 0) & (p <= 1), F.lit(False)), p).otherwise(bad.cast("double")))


def check_filled(rows: DataFrame) -> DataFrame:
    """rows; ValueError if there are none. One row is read."""
    if rows.isEmpty():
        raise ValueError("there is nothing to evaluate")
    return rows


def check_labels(rows: DataFrame, label: str = "true_label", classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """rows, failing at run time on a label outside classes or null."""
    good = F.col(label).isin(*classes)
    return rows.withColumn(label, F.when(F.coalesce(good, F.lit(False)), F.col(label)).otherwise(F.raise_error(F.lit(f"{label} must be one of {classes}")).cast("int")))


def check_both_classes(rows: DataFrame, label: str = "true_label") -> DataFrame:
    """rows; ValueError unless their labels are 0 and 1 and both occur, as areas under curves need. One aggregate over the labels."""
    found = sorted((r[0] for r in rows.groupBy(label).count().limit(3).collect()), key=str)
    if found != [0, 1]:
        raise ValueError(f"{label} must hold 0 and 1, not {found}")
    return rows


def decide(rows: DataFrame, score: str = "score", threshold: float = 0.5) -> DataFrame:
    """predicted_label: 1 where the score reaches the threshold."""
    return rows.withColumn("predicted_label", (F.col(score) >= F.lit(threshold)).cast("int"))


def attack_probability(logit_0: Column, logit_1: Column) -> Column:
    """Softmax of two logits, the second one's share."""
    return 1.0 / (1.0 + F.exp(logit_0 - logit_1))


def confusion(rows: DataFrame, true: str = "true_label", predicted: str = "predicted_label", by: tuple[str, ...] = ()) -> DataFrame:
    """tn, fp, fn, tp as longs, one row for each group (one in all without `by`)."""
    t, p = F.col(true), F.col(predicted)
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return rows.groupBy(*by).agg(*[F.count_if((t == a) & (p == b)).alias(name) for name, (a, b) in cells.items()])


def k_class_confusion(rows: DataFrame, classes: int, true: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    """(true_label, predicted_label, n) for every cell of the classes x classes grid, zeros included.

    Fails at run time on a label outside 0..classes-1 or null: nothing is left out of the counts.
    """
    spark = rows.sparkSession
    for column in dict.fromkeys((true, predicted)):
        rows = check_labels(rows, column, tuple(range(classes)))
    side = spark.range(classes).select(F.col("id").cast("int").alias("true_label"))
    grid = side.withColumn("predicted_label", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    counts = rows.groupBy(F.col(true).cast("int").alias("true_label"), F.col(predicted).cast("int").alias("predicted_label")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["true_label", "predicted_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def rates(cells: DataFrame, empty: float = 0.0) -> DataFrame:
    """cells with accuracy, precision, recall, f1, apcer, bpcer, acer and error_rate.

    Precision, recall and F1 are `empty` where undefined; F1 uses 0 for an undefined precision or recall.
    The error rates of a class without samples are null, and so is their mean.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n, p0, r0 = tn + fp + fn + tp, ratio(tp, tp + fp, 0.0), ratio(tp, tp + fn, 0.0)
    apcer, bpcer = ratio(fn, fn + tp), ratio(fp, fp + tn)
    return cells.select(
        "*",
        n.alias("num_samples"),
        ratio(tn + tp, n).alias("accuracy"),
        ratio(tp, tp + fp, empty).alias("precision"),
        ratio(tp, tp + fn, empty).alias("recall"),
        ratio(2.0 * p0 * r0, p0 + r0, empty).alias("f1"),
        apcer.alias("apcer"),
        bpcer.alias("bpcer"),
        ((apcer + bpcer) / 2.0).alias("acer"),
        ratio(fp + fn, n, 0.0).alias("error_rate"),
    )


def at_threshold(rows: DataFrame, thresholds: list[float], true: str = "true_label", score: str = "score") -> DataFrame:
    """(threshold, far, frr): share of attacks scored below and of bona fide scored at or above each threshold.

    One pass whatever the number of thresholds. far is also the attack error rate, frr the bona fide one.
    """
    t, s = F.col(true), F.col(score)
    parts = [
        F.struct(
            F.lit(float(x)).alias("threshold"),
            ratio(F.count_if((t == 1) & (s < x)), F.count_if(t == 1)).alias("far"),
            ratio(F.count_if((t == 0) & (s >= x)), F.count_if(t == 0)).alias("frr"),
        )
        for x in thresholds
    ]
    return rows.agg(F.array(*parts).alias("_all")).select(F.inline("_all"))


def class_report(rows: DataFrame, classes: tuple[int, ...] = (0, 1), true: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    """One-vs-rest precision, recall, f1 and support for each class; zeros where undefined."""
    t, p = F.col(true), F.col(predicted)
    parts = []
    for c in classes:
        tp, fp, fn = F.count_if((t == c) & (p == c)), F.count_if((t != c) & (p == c)), F.count_if((t == c) & (p != c))
        precision, recall = ratio(tp, tp + fp, 0.0), ratio(tp, tp + fn, 0.0)
        parts.append(
            F.struct(
                F.lit(c).alias("label"),
                precision.alias("precision"),
                recall.alias("recall"),
                ratio(2.0 * precision * recall, precision + recall, 0.0).alias("f1"),
                F.count_if(t == c).alias("support"),
            )
        )
    return rows.agg(F.array(*parts).alias("_all")).select(F.inline("_all"))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight) for labels 0..max: total / (present classes * n), 0 for an absent label."""
    counts = rows.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))
    dense = counts.agg(F.max("label").alias("_m"), F.sum("n").alias("_total"), F.count("*").alias("_present")).select(
        F.explode(F.sequence(F.lit(0), F.col("_m"))).alias("label"), "_total", "_present"
    )
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    return dense.join(counts, "label", "left").select("label", n.alias("n"), ratio(F.col("_total"), F.col("_present") * n, 0.0).alias("weight"))


def weighted_mean(rows: DataFrame, value: str, weight: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of value with sizes as weights, 0 where the sizes sum to 0."""
    return rows.groupBy(*by).agg(ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight), 0.0).alias("mean"), F.sum(weight).cast("long").alias("count"))


def confidence(rows: DataFrame, probability: str = "probability", predicted: str = "predicted_label") -> DataFrame:
    """is_correct and the confidence in the predicted label."""
    p = F.col(probability)
    return rows.withColumn("is_correct", F.col("true_label") == F.col(predicted)).withColumn("confidence", F.when(F.col(predicted) == 1, p).otherwise(1.0 - p))


def top_errors(rows: DataFrame, kind: str, k: int, index: str = "index") -> DataFrame:
    """The k most confident false positives ("fp") or false negatives ("fn"), ties to the smaller index."""
    true, predicted = {"fp": (0, 1), "fn": (1, 0)}[kind]
    wrong = confidence(rows).where((F.col("true_label") == true) & (F.col("predicted_label") == predicted))
    return wrong.orderBy(F.desc("confidence"), F.asc(index)).limit(k).drop("is_correct").withColumn("error_type", F.lit({"fp": "false_positive", "fn": "false_negative"}[kind]))


def misclassified(rows: DataFrame) -> DataFrame:
    """All wrong predictions with their confidence and error_type."""
    kind = F.when(F.col("predicted_label") == 1, "false_positive").otherwise("false_negative")
    return confidence(rows).where(~F.col("is_correct")).drop("is_correct").withColumn("error_type", kind)


def error_summary(rows: DataFrame, margin: float = 0.1, by: tuple[str, ...] = ()) -> DataFrame:
    """One row of counts: all, both kinds of errors, hard examples, the error rate (0 without rows) and mean confidences."""
    judged = confidence(rows)
    wrong = ~F.col("is_correct")
    return judged.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(wrong).alias("errors"),
        F.count_if(wrong & (F.col("predicted_label") == 1)).alias("false_positives"),
        F.count_if(wrong & (F.col("predicted_label") == 0)).alias("false_negatives"),
        F.count_if(F.abs(F.col("probability") - 0.5) <= margin).alias("hard"),
        ratio(F.count_if(wrong), F.count("*"), 0.0).alias("error_rate"),
        F.avg(F.when(wrong, F.col("confidence"))).alias("confidence_wrong"),
        F.avg(F.when(F.col("is_correct"), F.col("confidence"))).alias("confidence_right"),
    )


def least_confident(rows: DataFrame, k: int, index: str = "index") -> DataFrame:
    """The k least confident predictions, ties to the smaller index."""
    return confidence(rows).orderBy(F.asc("confidence"), F.asc(index)).limit(k)


def hard_examples(rows: DataFrame, margin: float, probability: str = "probability") -> DataFrame:
    """Rows whose probability is within the margin of one half."""
    return rows.where(F.abs(F.col(probability) - 0.5) <= margin)


def cross_entropy(p: Column, label: Column, weight: Column | None = None) -> tuple[Column, Column]:
    """Weighted loss of a row and its weight; a mean loss is the sum of the first over the sum of the second."""
    loss = -F.log(F.when(label == 1, p).otherwise(1.0 - p))
    weight = F.lit(1.0) if weight is None else weight
    return loss * weight, weight


def focal_loss(p: Column, label: Column, gamma: float = 2.0, alpha: Column | None = None) -> Column:
    """-(1 - pt)**gamma * log pt, times alpha of the label if given; its mean divides by the number of rows."""
    pt = F.when(label == 1, p).otherwise(1.0 - p)
    loss = -F.pow(1.0 - pt, F.lit(gamma)) * F.log(pt)
    return loss if alpha is None else loss * alpha
