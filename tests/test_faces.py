"""Face boxes on the edge of a pixel, and one row of pixels for each row of images."""

import math

import pytest
from pyspark.sql import functions as F

from loomwork.functions import geometry
from loomwork.plans import imaging, series

#: A corner of each box lies at the image's centre, about which it is turned: its place is whole but for the last bits.
ROWS = [(k, 320, 240, 320 + 3 * q, 240 + 2 * q, q * 1.0, t / 100 * 103.7 - d / 100 * 101.3) for k, (q, d, t) in enumerate((q, d, t) for q in range(1, 51) for d in range(11) for t in range(9))]


def hull(x1, y1, x2, y2, dx, dy):
    angle = math.atan2(dy, dx) * (180 / math.pi)
    a, b = math.cos(angle * (math.pi / 180)), math.sin(angle * (math.pi / 180))
    xs = [a * x + b * y + (1 - a) * 320.0 - b * 240.0 for x in (x1, x2) for y in (y1, y2)]
    ys = [-b * x + a * y + b * 320.0 + (1 - a) * 240.0 for x in (x1, x2) for y in (y1, y2)]
    return math.floor(min(xs)), math.floor(min(ys)), math.ceil(max(xs)), math.ceil(max(ys))


@pytest.fixture(scope="module")
def boxes(spark):
    return spark.createDataFrame(ROWS, "k int, x1 int, y1 int, x2 int, y2 int, dx double, dy double").withColumn("w", F.lit(640)).withColumn("h", F.lit(480))


def test_boxes_are_turned_with_the_last_bits_of_sql(boxes):
    angle = geometry.eye_angle(F.lit(0.0), F.lit(0.0), F.col("dx"), F.col("dy"))
    box = geometry.rotated_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.col("angle"), F.col("w"), F.col("h"))
    got = {r["k"]: tuple(r["box"]) for r in boxes.withColumn("angle", angle).select("k", box.alias("box")).collect()}
    assert got == {row[0]: hull(*row[1:]) for row in ROWS}


def test_faces_are_aligned_with_the_last_bits_of_sql(boxes):
    face = F.struct(F.lit(1.0).alias("score"), F.array("x1", "y1", "x2", "y2").alias("facial_area"), F.create_map(F.lit("left_eye"), F.array("dx", "dy"), F.lit("right_eye"), F.array(F.lit(0.0), F.lit(0.0))).alias("landmarks"))
    images = boxes.select("k", F.col("w").alias("width"), F.col("h").alias("height"), F.create_map(F.lit("face_1"), face).alias("detections"))
    got = {r["k"]: tuple(r["crop"]) for r in geometry.align(images, margin=0.0).collect()}
    cut = lambda x1, y1, x2, y2: (max(0, x1), max(0, y1), min(640, x2), min(480, y2))
    assert got == {row[0]: cut(*hull(*row[1:])) for row in ROWS}


def test_no_angle_stays_none(spark):
    row = spark.createDataFrame([(None,)], "x double")
    assert row.select(geometry.eye_angle(F.lit(0.0), F.lit(0.0), F.col("x"), F.col("x")).alias("angle"), *[c.alias(n) for c, n in zip(geometry.turn(F.col("x")), "ab", strict=True)]).first() == (None, None, None)


def test_images_of_one_id_give_one_row_each(spark, tmp_path):
    rows = [(1, [0.1 * (k % 5) - 0.2 for k in range(64)], 1), (1, [0.1 * (k % 3) - 0.1 for k in range(64)], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert imaging.face_pixels(spark, str(tmp_path)).count() == 2


def test_detections_are_shuffled_once_and_copies_count_once(spark, tmp_path):
    item = (1, 7, 9, 1, 20.0, 0.01, 0.02)
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame([item, item, (1, 7, 9, 2, 30.0, 0.1, 0.02)], schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    done = series.aligned(spark, str(tmp_path))
    assert done._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [r["success"] for r in done.collect()] == [True]
