"""Queries of geometry, path and training-series functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomwork.functions import geometry, metrics, paths, training
from loomwork.plans.evaluation import rounded


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as face boxes and eyes in images of 640 x 480."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x1, y1 = (F.col("l_partkey") % 400).cast("int"), (F.col("l_suppkey") % 300).cast("int")
    q = F.col("l_quantity").cast("int")
    return items.select(
        "l_orderkey",
        "l_linenumber",
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + q * 3).alias("x2"),
        (y1 + q * 2).alias("y2"),
        (x1 + q).cast("double").alias("lx"),
        (y1 + F.col("l_discount") * 101.3).alias("ly"),
        (x1 + q * 2).cast("double").alias("rx"),
        (y1 + F.col("l_tax") * 103.7).alias("ry"),
        F.col("l_discount").alias("d"),
    )


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, eye angle and margin crop of every box; the crop of the box turned by its angle."""
    b, w, h = boxes(spark, sf_dir), F.lit(640), F.lit(480)
    c = {n: F.col(n) for n in b.columns}
    angle = geometry.eye_angle(c["lx"], c["ly"], c["rx"], c["ry"])
    turned = b.withColumn("angle", angle).withColumn("box", geometry.rotated_box(c["x1"], c["y1"], c["x2"], c["y2"], F.col("angle"), w, h))
    crop = geometry.with_margin(F.col("box"), 0.3, w, h)
    return rounded(turned.withColumn("crop", crop).select("l_orderkey", "l_linenumber", geometry.box_area(c["x1"], c["y1"], c["x2"], c["y2"]).cast("long").alias("area"), "angle", "crop.*"))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's boxes as one image's detections: the largest good face, or why there is none; only numbers are shuffled, once."""
    given = boxes(spark, sf_dir).groupBy("l_orderkey").agg(F.array_distinct(F.collect_list(F.struct("l_linenumber", "x1", "y1", "x2", "y2", "lx", "ly", "rx", "ry", "d"))).alias("given"))

    def entry(f: Column) -> Column:
        key = F.concat_ws("_", F.lit("face"), f["l_linenumber"], F.lpad(f["x1"], 3, "0"), F.lpad(f["y1"], 3, "0"), f["x2"], f["y2"], f["d"], f["ry"])
        eyes = F.create_map(F.lit("left_eye"), F.array(f["rx"], f["ry"]), F.lit("right_eye"), F.array(f["lx"], f["ly"]))
        face = F.struct((1.0 - f["d"] * 3).alias("score"), F.array(*[f[c] for c in ("x1", "y1", "x2", "y2")]).alias("facial_area"), eyes.alias("landmarks"))
        return F.struct(key.alias("key"), face.alias("value"))

    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    images = given.select("l_orderkey", F.map_from_entries(F.array_sort(F.transform("given", entry), by_key)).alias("detections"))
    done = geometry.align(images.withColumn("width", F.lit(640)).withColumn("height", F.lit(480)), threshold=0.8)
    return rounded(done.select("l_orderkey", "success", "failure_reason", F.when(F.col("success"), F.col("angle")).alias("angle"), *[F.when(F.col("success"), F.col("crop")[k]).alias(k) for k in ("x1", "y1", "x2", "y2")]))


BOXES = """b AS (SELECT l_orderkey, l_linenumber, (l_partkey % 400)::INT AS x1, (l_suppkey % 300)::INT AS y1, (l_partkey % 400 + l_quantity::INT * 3)::INT AS x2,
  (l_suppkey % 300 + l_quantity::INT * 2)::INT AS y2, (l_partkey % 400 + l_quantity::INT)::DOUBLE AS lx, l_suppkey % 300 + l_discount * 101.3::DOUBLE AS ly,
  (l_partkey % 400 + l_quantity::INT * 2)::DOUBLE AS rx, l_suppkey % 300 + l_tax * 103.7::DOUBLE AS ry, l_discount FROM lineitem)"""
CORNERS = [f"a * {x} + b * {y} + (1 - a) * 320.0 - b * 240.0" for x in ("x1", "x2") for y in ("y1", "y2")]
RISES = [f"-b * {x} + a * {y} + b * 320.0 + (1 - a) * 240.0" for x in ("x1", "x2") for y in ("y1", "y2")]


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path functions over the path of every page."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    alpha = (F.col("page_id") % 101) / 100.0
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", path.alias("p"), alpha.alias("alpha")).select(
        "page_id",
        paths.extension(F.col("p")).alias("extension"),
        paths.stem(F.col("p")).alias("stem"),
        paths.part(F.col("p"), 2).alias("identity"),
        paths.part(F.col("p"), 4).alias("fourth"),
        paths.with_suffix(F.col("p"), ".jpg").alias("as_jpg"),
        paths.mirrored(F.col("p"), "www.ththen.example.com", "/out", ".png").alias("mirrored"),
        paths.augmented_name(F.col("p"), F.array(F.lit("gamma")), paths.output_suffix(F.col("p"), "TIFF"), "operator_prefix").alias("prefixed"),
        paths.augmented_name(F.col("p"), F.array(F.lit("gamma")), paths.output_suffix(F.col("p")), "flat").alias("flat"),
        paths.epoch_name(F.col("page_id") % 500).alias("epoch_name"),
        paths.resolved(F.col("p"), "/data").alias("resolved"),
        paths.morph_name(paths.part(F.col("p"), 1), paths.part(F.col("p"), 2), F.col("alpha")).alias("morph"),
        paths.augmented_name(F.col("p"), F.when(F.col("page_id") % 2 == 0, F.array(F.lit("blur"), F.lit("flip"))).otherwise(F.array().cast("array<string>")), F.lit(".jpg")).alias("augmented"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as training history: a run for each event type, an epoch for each day, the mean value as loss."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.datediff(F.col("ts"), F.lit("2024-01-01")).cast("long")
    return events.groupBy(F.col("event_type").alias("run"), day.alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"), F.count("*").alias("n"))


HISTORY = """h AS (SELECT event_type AS run, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS epoch, round(avg(value), 6) AS loss, count(*) AS n FROM events GROUP BY 1, 2)"""


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning-rate factors at every event id of a schedule of 30 epochs."""
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    step = F.col("event_id")
    return rounded(ids.select("event_id", training.cosine_factor(step, 500, 9000, 0.01).alias("cosine"), training.step_factor(F.floor(step / 300), 30).alias("step")), 9)


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON properties parsed with defaults and written again."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    parsed = F.from_json("props", "struct<k:string, label:string>")
    return events.select("event_id", F.coalesce(parsed["k"], F.lit("none")).alias("k"), F.coalesce(parsed["label"], F.lit("bona_fide")).alias("label"), paths.is_timestamp(paths.iso_seconds(F.col("ts"))).alias("is_timestamp"), paths.iso_seconds(F.col("ts")).alias("at"))


def landmark_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, k, x, y): the first four of six normalised landmarks in pixels of images of different sizes, drawn towards their mirror images, and the border's eight points."""
    point = lambda k: F.struct(F.abs(F.element_at("embedding", 2 * k + 1).cast("double")).alias("x"), F.abs(F.element_at("embedding", 2 * k + 2).cast("double")).alias("y"))
    sized = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.array(*[point(k) for k in range(6)]).alias("points"), (100 + F.col("vec_id") % 50).alias("w"), (80 + F.col("vec_id") % 40).alias("h"))
    placed = sized.withColumn("points", geometry.pixel_landmarks(F.col("points"), F.col("w"), F.col("h"), 4))
    mirrored = F.transform("points", lambda p: F.struct((F.col("w") - p["x"]).alias("x"), p["y"].alias("y")))
    drawn = geometry.with_border(geometry.interpolated(F.col("points"), mirrored, 0.3), F.col("w"), F.col("h"))
    return rounded(placed.select("vec_id", F.posexplode(drawn).alias("k", "p")).select("vec_id", "k", "p.x", "p.y"))


def attack_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, probability): two components of each vector as the logits of both classes."""
    logit = lambda k: F.element_at("embedding", k).cast("double") * 5.0
    return rounded(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", metrics.attack_probability(logit(1), logit(2)).alias("probability")))


def run_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, started, seconds): when each user's events begin and how long they last."""
    spans = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("start"), F.max("ts").cast("timestamp").alias("end"))
    return rounded(spans.select("user_id", paths.iso_seconds(F.col("start")).alias("started"), paths.elapsed_seconds(F.col("start"), F.col("end")).alias("seconds")))


QUERIES = {
    "face_crops": crops,
    "face_alignment": aligned,
    "path_functions": urls,
    "landmark_places": landmark_places,
    "attack_scores": attack_scores,
    "run_seconds": run_seconds,
    "early_stopping": lambda s, d: rounded(training.early_stopping(history(s, d), ["run"], "epoch", "loss", 3, 0.01)),
    "best_epochs": lambda s, d: rounded(training.best_epoch(history(s, d), ["run"], "epoch", "loss")),
    "running_mean_loss": lambda s, d: rounded(training.running_mean(history(s, d), ["run"], "epoch", "loss", "n")),
    "plateau_rates": lambda s, d: rounded(training.plateau_rates(history(s, d), ["run"], "epoch", "loss", 0.1), 9),
    "learning_rates": rates,
    "json_properties": props,
}

ORACLES = {
    "face_crops": f"""WITH {BOXES}, t AS (SELECT *, degrees(atan2(ry - ly, rx - lx)) AS angle FROM b),
  r AS (SELECT *, cos(radians(angle)) AS a, sin(radians(angle)) AS b FROM t),
  c AS (SELECT *, floor(least({", ".join(CORNERS)}))::INT AS bx1, floor(least({", ".join(RISES)}))::INT AS by1, ceil(greatest({", ".join(CORNERS)}))::INT AS bx2, ceil(greatest({", ".join(RISES)}))::INT AS by2 FROM r)
  SELECT l_orderkey, l_linenumber, (greatest(0, x2 - x1) * greatest(0, y2 - y1))::BIGINT AS area, round(angle, 6) AS angle,
    greatest(0, bx1 - trunc((bx2 - bx1) * 0.3::DOUBLE)::INT) AS x1, greatest(0, by1 - trunc((by2 - by1) * 0.3::DOUBLE)::INT) AS y1,
    least(640, bx2 + trunc((bx2 - bx1) * 0.3::DOUBLE)::INT) AS x2, least(480, by2 + trunc((by2 - by1) * 0.3::DOUBLE)::INT) AS y2 FROM c""",
    "face_alignment": f"""WITH {BOXES}, t AS (SELECT DISTINCT b.*, degrees(atan2(ry - ly, rx - lx)) AS angle, 1.0::DOUBLE - l_discount * 3 AS score FROM b),
  g AS (SELECT *, max(score) OVER (PARTITION BY l_orderkey) AS best, count(*) FILTER (WHERE score >= 0.8::DOUBLE) OVER (PARTITION BY l_orderkey) AS good,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY (score >= 0.8::DOUBLE) DESC, (greatest(0, x2 - x1) * greatest(0, y2 - y1)) DESC, l_linenumber, x1, y1) AS k FROM t),
  r AS (SELECT *, cos(radians(angle)) AS a, sin(radians(angle)) AS b FROM g WHERE k = 1),
  c AS (SELECT *, floor(least({", ".join(CORNERS)}))::INT AS bx1, floor(least({", ".join(RISES)}))::INT AS by1, ceil(greatest({", ".join(CORNERS)}))::INT AS bx2, ceil(greatest({", ".join(RISES)}))::INT AS by2 FROM r),
  m AS (SELECT *, greatest(0, bx1 - trunc((bx2 - bx1) * 0.3::DOUBLE)::INT) AS cx1, greatest(0, by1 - trunc((by2 - by1) * 0.3::DOUBLE)::INT) AS cy1,
    least(640, bx2 + trunc((bx2 - bx1) * 0.3::DOUBLE)::INT) AS cx2, least(480, by2 + trunc((by2 - by1) * 0.3::DOUBLE)::INT) AS cy2 FROM c),
  f AS (SELECT *, CASE WHEN good = 0 THEN 'All detections below score threshold (best=' || printf('%.3f', best) || ', threshold=0.800)'
    WHEN cx2 <= cx1 OR cy2 <= cy1 THEN 'Degenerate crop region after margin: (' || cx1 || ',' || cy1 || ') → (' || cx2 || ',' || cy2 || ')' END AS reason FROM m)
  SELECT l_orderkey, reason IS NULL AS success, reason AS failure_reason, CASE WHEN reason IS NULL THEN round(angle, 6) END AS angle,
    CASE WHEN reason IS NULL THEN cx1 END AS x1, CASE WHEN reason IS NULL THEN cy1 END AS y1, CASE WHEN reason IS NULL THEN cx2 END AS x2, CASE WHEN reason IS NULL THEN cy2 END AS y2 FROM f""",
    "path_functions": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p, (page_id % 101) / 100.0::DOUBLE AS alpha FROM pages),
  q AS (SELECT *, string_split(p, '/') AS s, lower(regexp_extract(p, '[^/](\.[^./]+)$', 1)) AS e FROM p),
  r AS (SELECT *, CASE WHEN s[-1] LIKE '_%.%' THEN regexp_replace(s[-1], '\.[^.]+$', '') ELSE s[-1] END AS stem FROM q)
  SELECT page_id, e AS extension, stem, coalesce(s[2], '') AS identity, coalesce(s[4], '') AS fourth,
    regexp_replace(p, '([^/])\.[^./]*$', '\1') || '.jpg' AS as_jpg, '/out/' || regexp_replace(CASE WHEN starts_with(p, 'www.ththen.example.com/') THEN substr(p, 24) ELSE p END, '([^/])\.[^./]*$', '\1') || '.png' AS mirrored,
    'aug_gamma_' || stem || '.tiff' AS prefixed, stem || e AS flat, 'epoch_' || lpad((page_id % 500)::VARCHAR, 4, '0') || '.pt' AS epoch_name,
    '/data/' || p AS resolved, 'morph_' || s[1] || '_' || coalesce(s[2], '') || '_a' || lpad(trunc(alpha * 100)::INT::VARCHAR, 3, '0') || '.jpg' AS morph,
    stem || '_aug_' || CASE WHEN page_id % 2 = 0 THEN 'blur_flip' ELSE 'noop' END || '.jpg' AS augmented FROM r""",
    "landmark_places": f"""WITH e AS (SELECT vec_id, [abs(c::DOUBLE) for c in embedding] AS v, 100 + vec_id % 50 AS w, 80 + vec_id % 40 AS h FROM embeddings),
  p AS (SELECT *, [{{'x': {1.0 - 0.3!r}::DOUBLE * (v[2 * k + 1] * w) + 0.3::DOUBLE * (w - v[2 * k + 1] * w), 'y': {1.0 - 0.3!r}::DOUBLE * (v[2 * k + 2] * h) + 0.3::DOUBLE * (v[2 * k + 2] * h)}} for k in range(4)]
    || [{{'x': (w - 1)::DOUBLE * (n % 3) / 2, 'y': (h - 1)::DOUBLE * (n // 3) / 2}} for n in [0, 1, 2, 3, 5, 6, 7, 8]] AS s FROM e)
  SELECT vec_id, k::INT AS k, round(s[k + 1].x, 6) AS x, round(s[k + 1].y, 6) AS y FROM p, (SELECT unnest(range(12)) AS k)""",
    "attack_scores": "SELECT vec_id, round(exp(embedding[2]::DOUBLE * 5) / (exp(embedding[1]::DOUBLE * 5) + exp(embedding[2]::DOUBLE * 5)), 6) AS probability FROM embeddings",
    "run_seconds": "SELECT user_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS started, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE, 6) AS seconds FROM events GROUP BY user_id",
    "early_stopping": f"""WITH RECURSIVE {HISTORY}, o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS k FROM h),
  f AS (SELECT run, 0::BIGINT AS k, -1::BIGINT AS epoch, 0::DOUBLE AS value, 'inf'::DOUBLE AS best_value, 0 AS counter FROM (SELECT DISTINCT run FROM h)
    UNION ALL SELECT o.run, o.k, o.epoch, o.loss, CASE WHEN o.loss < f.best_value - 0.01::DOUBLE THEN o.loss ELSE f.best_value END, CASE WHEN o.loss < f.best_value - 0.01::DOUBLE THEN 0 ELSE f.counter + 1 END
    FROM f JOIN o ON o.run = f.run AND o.k = f.k + 1)
  SELECT run, epoch, round(value, 6) AS value, round(best_value, 6) AS best_value, counter, counter > 3 AS should_stop FROM f WHERE k > 0""",
    "best_epochs": f"WITH {HISTORY} SELECT run, epoch AS best_epoch, loss AS best_value FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY loss, epoch) AS r FROM h) WHERE r = 1",
    "running_mean_loss": f"WITH {HISTORY} SELECT run, epoch, loss, n, round(sum(loss * n) OVER w / sum(n) OVER w, 6) AS running_mean FROM h WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING)",
    "plateau_rates": f"""WITH RECURSIVE {HISTORY}, o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS k FROM h),
  f AS (SELECT run, 0::BIGINT AS k, -1::BIGINT AS epoch, 'inf'::DOUBLE AS best, 0 AS bad, 0.1::DOUBLE AS rate FROM (SELECT DISTINCT run FROM h)
    UNION ALL SELECT run, k, epoch, best, CASE WHEN bad > 2 THEN 0 ELSE bad END, CASE WHEN bad > 2 THEN rate * 0.1::DOUBLE ELSE rate END FROM (
      SELECT o.run, o.k, o.epoch, CASE WHEN o.loss < f.best * 0.9999::DOUBLE THEN o.loss ELSE f.best END AS best, CASE WHEN o.loss < f.best * 0.9999::DOUBLE THEN 0 ELSE f.bad + 1 END AS bad, f.rate
      FROM f JOIN o ON o.run = f.run AND o.k = f.k + 1))
  SELECT run, epoch, round(rate, 9) AS learning_rate FROM f WHERE k > 0""",
    "learning_rates": """SELECT event_id, round(CASE WHEN event_id < 500 THEN (event_id + 1) / 500.0::DOUBLE
    ELSE 0.01::DOUBLE + 0.99::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * least(greatest((event_id - 500) / 8500.0::DOUBLE, 0), 1))) END, 9) AS cosine,
    round(pow(0.1::DOUBLE, floor((event_id // 300) / 10.0::DOUBLE)), 9) AS step FROM events""",
    "json_properties": """SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.label'), 'bona_fide') AS label,
    true AS is_timestamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events""",
}
