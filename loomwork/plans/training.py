"""Training queries: a linear scorer of label 0 against the rest, over all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwork.functions import attention
from loomwork.operators import faces, fit, visual
from loomwork.plans import imaging
from loomwork.plans.evaluation import rounded
from loomwork.session import materialise, scratch_path, spread
from loomwork.sources import sinks

EPOCHS = 3
RULE = fit.Optimizer("adamw", rate=0.1, decay=0.01)


def history(spark: SparkSession, sf_dir: str, gamma: float | None = None) -> DataFrame:
    """(epoch, train_loss, val_loss, val_accuracy, learning_rate, is_best) of three epochs; every fifth vector validates."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("label"))
    fifth = F.col("vec_id") % 5 == 0
    return rounded(fit.history(spark, fit.fit(rows.where(~fifth), rows.where(fifth), optimizer=RULE, epochs=EPOCHS, gamma=gamma)))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, probability, predicted_label) of all embeddings by the weights that three epochs leave."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("label"))
    fifth = F.col("vec_id") % 5 == 0
    state = fit.fit(rows.where(~fifth), rows.where(fifth), optimizer=RULE, epochs=EPOCHS)
    return rounded(fit.score(state, rows).select("vec_id", "label", "probability", "predicted_label"))


def classified_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_path, label, probability, predicted_label): images and a manifest are written as files, and the files are trained on and scored."""
    root = scratch_path(spark, "classified")
    kinds = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.concat(F.lit("img/"), "vec_id").alias("path"), F.concat(F.lit("img/"), "vec_id", F.lit(".png")).alias("image_path"), (F.col("label") == 0).cast("int").alias("label"))
    materialise(sinks.image_files(imaging.coloured(spread(imaging.gray(spark, sf_dir), "vec_id")), root), "written-classified")
    sinks.csv_file(kinds.select("image_path", "label"), f"{root}/manifest.csv", ["image_path"])
    rows = materialise(visual.manifest_vectors(spark, f"{root}/manifest.csv", root, size=8), "classified-vectors")
    fifth = F.regexp_extract("image_path", "([0-9]+)", 1).cast("long") % 5 == 0
    state = fit.fit(rows.where(~fifth), rows.where(fifth), optimizer=RULE, epochs=EPOCHS)
    return rounded(fit.score(state, rows).select("image_path", "label", "probability", "predicted_label"))


#: Seventeen vectors in a row are an image: a class token and 4 x 4 patches.
TOKENS, HEADS, LAYERS = 17, 4, 2


def attention_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the class token of each image pays to its patches, averaged over four heads and two layers."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.expr(f"vec_id div {TOKENS}").alias("image"), (F.col("vec_id") % TOKENS).cast("int").alias("token"), F.col("embedding").alias("vector"))
    whole = rows.join(rows.groupBy("image").count().where(F.col("count") == TOKENS).select("image"), "image", "left_semi")
    layers = [attention.head_weights(whole, HEADS, scale).withColumn("layer", F.lit(k)) for k, scale in enumerate((1.0, 20.0))]
    return rounded(attention.class_grids(attention.mean_maps(layers[0].unionByName(layers[1]))))


ATTENTION = f"""WITH t AS (SELECT vec_id // {TOKENS} AS image, vec_id % {TOKENS} AS token, [c::DOUBLE for c in embedding] AS v FROM embeddings),
  w AS (SELECT * FROM t WHERE image IN (SELECT image FROM t GROUP BY 1 HAVING count(*) = {TOKENS})),
  p AS (SELECT image, token, head, v[head * (len(v) // {HEADS}) + 1:(head + 1) * (len(v) // {HEADS})] AS part FROM w, (SELECT unnest(range({HEADS})) AS head)),
  z AS (SELECT q.image, q.head, k.token AS col, layer, list_dot_product(q.part, k.part) * CASE WHEN layer = 0 THEN 1 ELSE 20 END / sqrt(len(q.part)) AS z
    FROM p q JOIN p k USING (image, head), (SELECT unnest([0, 1]) AS layer) WHERE q.token = 0),
  s AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY image, head, layer) AS weight FROM z)
  SELECT image, ((col - 1) // 4)::INT AS y, ((col - 1) % 4)::INT AS x, round(avg(weight), 6) AS weight FROM s WHERE col > 0 GROUP BY image, col"""


#: The vectors that are trained on, as they are or as pixels of images.
VECTORS = "[c::DOUBLE for c in embedding]"
PIXELS = " || ".join(
    f"[((least(greatest(floor((c::DOUBLE + 0.5::DOUBLE) * 255), 0), 255)::INT / 255.0::DOUBLE - {m}::DOUBLE) / {d}::DOUBLE)::FLOAT::DOUBLE for c in embedding]" for m, d in zip(faces.CHANNEL_MEAN, faces.CHANNEL_DEVIATION, strict=True)
)


def _epochs_sql(gamma: float | None = None, values: str = VECTORS) -> str:
    """The epochs unrolled: one gradient, one step of the rule and one validation each."""
    one, two = RULE.betas
    p, of = "1 / (1 + exp(-list_dot_product(w, x)))", "greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-15)"
    if gamma is None:
        loss, slope, weight = f"-k * ln({of})", "k * (p - y)", "k"
    else:
        far = f"pow(1 - {of}, {gamma}::DOUBLE)"
        loss, slope, weight = f"-k * {far} * ln({of})", f"(2 * y - 1) * k * {far} * ({gamma}::DOUBLE * {of} * ln({of}) - (1 - {of}))", "1"
    steps = ["e0 AS (SELECT 0 AS epoch, [0::DOUBLE for i in range((SELECT max(len(x)) FROM r))] AS w, [0::DOUBLE for i in range((SELECT max(len(x)) FROM r))] AS m, [0::DOUBLE for i in range((SELECT max(len(x)) FROM r))] AS v)"]
    for n in range(1, EPOCHS + 1):
        steps += [
            f"s{n} AS (SELECT x, y, k, {p} AS p FROM r, e{n - 1} WHERE NOT held)",
            f"t{n} AS (SELECT sum({loss}) / sum({weight}) AS train_loss, sum({weight}) AS total FROM s{n})",
            f"g{n} AS (SELECT list(g ORDER BY j) AS g FROM (SELECT j, sum({slope} * x[j]) / (SELECT total FROM t{n}) AS g FROM s{n}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM r) + 1)) AS j) GROUP BY j))",
            f"m{n} AS (SELECT w, [{one}::DOUBLE * m[i] + {1.0 - one!r}::DOUBLE * g[i] for i in range(1, len(w) + 1)] AS m, [{two}::DOUBLE * v[i] + {1.0 - two!r}::DOUBLE * g[i] * g[i] for i in range(1, len(w) + 1)] AS v FROM e{n - 1}, g{n})",
            f"e{n} AS (SELECT {n} AS epoch, [w[i] * {1.0 - RULE.rate * RULE.decay!r}::DOUBLE - {RULE.rate}::DOUBLE * (m[i] / {1.0 - one**n!r}::DOUBLE) / (sqrt(v[i] / {1.0 - two**n!r}::DOUBLE) + {RULE.epsilon}::DOUBLE) for i in range(1, len(w) + 1)] AS w, m, v FROM m{n})",
            f"h{n} AS (SELECT {n - 1} AS epoch, (SELECT train_loss FROM t{n}) AS train_loss, sum({loss}) / sum({weight}) AS val_loss, avg(((p >= 0.5)::INT = y)::INT) AS val_accuracy FROM (SELECT x, y, k, {p} AS p FROM r, e{n} WHERE held))",
        ]
    return f"""WITH a AS (SELECT vec_id, vec_id % 5 = 0 AS held, (label = 0)::INT AS y, {values} || [1::DOUBLE] AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
  c AS (SELECT y, (SELECT count(*) FROM a WHERE NOT held) / ((SELECT count(DISTINCT y) FROM a WHERE NOT held) * count(*)::DOUBLE) AS k FROM a WHERE NOT held GROUP BY y),
  r AS (SELECT a.*, c.k FROM a JOIN c USING (y)), {", ".join(steps)}"""


def _history_sql(gamma: float | None = None) -> str:
    whole = " UNION ALL ".join(f"SELECT * FROM h{n}" for n in range(1, EPOCHS + 1))
    return f"""{_epochs_sql(gamma)}, h AS ({whole})
  SELECT epoch::BIGINT AS epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss, round(val_accuracy, 6) AS val_accuracy, {RULE.rate}::DOUBLE AS learning_rate,
    coalesce(val_loss < min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM h"""


PREDICTED = f"""{_epochs_sql()} SELECT vec_id, y AS label, round(p, 6) AS probability, (p >= 0.5)::INT AS predicted_label
  FROM (SELECT vec_id, y, 1 / (1 + exp(-list_dot_product(w, x))) AS p FROM r, e{EPOCHS})"""

CLASSIFIED = f"""{_epochs_sql(values=PIXELS)} SELECT 'img/' || vec_id || '.png' AS image_path, y AS label, round(p, 6) AS probability, (p >= 0.5)::INT AS predicted_label
  FROM (SELECT vec_id, y, 1 / (1 + exp(-list_dot_product(w, x))) AS p FROM r, e{EPOCHS})"""

QUERIES = {"classified_images": classified_images, "predicted_embeddings": predicted, "attention_grids": attention_grids, "training_history": history, "focal_training_history": lambda spark, sf_dir: history(spark, sf_dir, 2.0)}
ORACLES = {"classified_images": CLASSIFIED, "predicted_embeddings": PREDICTED, "attention_grids": ATTENTION, "training_history": _history_sql(), "focal_training_history": _history_sql(2.0)}
