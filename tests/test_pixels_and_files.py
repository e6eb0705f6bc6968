"""Kernels as columns against arrays, decoding and manifests, checkpoints and exports."""

import json
import struct
import zlib

import array_forms
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork import results
from loomwork.functions import kernels, pixels, warps
from loomwork.operators import faces, model, morphs, statistics
from loomwork.sources import scans, sinks

RNG = np.random.default_rng(5)
H, W = 6, 9
IMAGE = RNG.integers(0, 256, (H, W, 3)).astype(np.uint8)


@pytest.fixture(scope="module")
def colour(spark):
    return spark.createDataFrame([(1, IMAGE.ravel().tolist())], "id int, p array<int>")


def column(frame, expression):
    return np.array(frame.select(expression.alias("v")).first()["v"]).reshape(IMAGE.shape)


def test_warps_equal_the_array_kernels(colour):
    known, p, size = kernels.default_kernels(), F.col("p"), (H, W)
    assert (column(colour, warps.rotated(p, *size, 11.5, 3)) == known["rotation"].apply(IMAGE, {"angle": 11.5}, None)).all()
    assert (column(colour, warps.shifted(p, *size, 0.07, -0.04, 3)) == known["translation"].apply(IMAGE, {"tx_percent": 0.07, "ty_percent": -0.04}, None)).all()
    assert (column(colour, warps.enlarged(p, *size, 1.3, 3)) == known["scaling"].apply(IMAGE, {"scale": 1.3}, None)).all()
    for scale in (0.6, 0.9):
        assert (column(colour, warps.reduced(p, *size, scale, 3)) == known["scaling"].apply(IMAGE, {"scale": scale}, None)).all()
    for length, sigma in ((3, 0.0), (7, 0.0), (9, 0.0), (5, 1.1)):
        got = column(colour, warps.blurred(p, *size, kernels.gaussian_line(length, sigma), 3))
        assert (got == kernels.saturated(kernels.convolved(IMAGE, kernels.gaussian(length, sigma)))).all()
    assert (column(colour, warps.smeared(p, *size, kernels.motion(5, 40.0), 3)) == known["motion_blur"].apply(IMAGE, {"kernel_size": 5, "angle": 40.0}, None)).all()
    assert (column(colour, warps.sharpened(p, *size, 1.5, kernels.gaussian_line(19, 3.0), 3)) == known["sharpen"].apply(IMAGE, {"strength": 1.5}, None)).all()


def test_taps_of_each_row_equal_tables(spark):
    drawn = [(3, 0.0, 10.0), (5, 0.0, 90.0), (7, 1.3, 137.0), (9, 0.0, 0.0), (11, 0.4, 45.0), (1, 0.0, 5.0)]
    frame = spark.createDataFrame([(n, s, a, IMAGE.ravel().tolist()) for n, s, a in drawn], "n int, s double, a double, p array<int>")
    soft, line = warps.gaussian_taps(F.col("n"), F.col("s")), warps.motion_taps(F.col("n"), F.col("a"))
    for r in frame.select("n", "s", "a", warps.blurred(F.col("p"), H, W, soft, 3).alias("soft"), warps.smeared(F.col("p"), H, W, line, 3).alias("line")).collect():
        assert (np.array(r["soft"]).reshape(IMAGE.shape) == kernels.saturated(kernels.convolved(IMAGE, kernels.gaussian(r.n, r.s)))).all()
        assert (np.array(r["line"]).reshape(IMAGE.shape) == kernels.saturated(kernels.convolved(IMAGE, kernels.motion(r.n, r.a)))).all()


def test_resizing_equals_the_array_form(colour):
    for tall, wide, area in ((4, 5, True), (20, 17, False), (1, 1, True), (1, 1, False), (H, W, True), (5, 30, True)):
        got = np.array(colour.select(warps.resized(F.col("p"), H, W, tall, wide, area, 3).alias("v")).first()["v"]).reshape(tall, wide, 3)
        assert np.allclose(got, kernels.resized(IMAGE, tall, wide, area))


def test_recompression_equals_the_array_kernel(colour):
    for quality in (30, 75):
        got = column(colour, warps.recompressed(F.col("p"), H, W, quality, kernels.LUMINANCE, kernels.CHROMINANCE, 3))
        assert (got == kernels.jpeg_round_trip(IMAGE, quality)).mean() > 0.99


def test_noise_by_columns(spark):
    frame = spark.createDataFrame([(k, [120] * 1200) for k in range(3)], "id int, p array<int>")
    rows = frame.select(warps.noisy(F.col("p"), F.col("id"), 8.0).alias("n"), warps.speckled(F.col("p"), F.col("id"), 0.1, 3).alias("s")).collect()
    noise = np.array([r["n"] for r in rows]) - 120
    assert abs(noise.mean() + 0.5) < 0.6 and abs(noise.std() - 8) < 0.6 and len({tuple(x) for x in noise.tolist()}) == 3
    specks = np.array([r["s"] for r in rows]).reshape(-1, 3)
    assert (specks == specks[:, :1]).all() and 0.06 < (specks[:, 0] != 120).mean() < 0.14 and set(specks.ravel()) == {0, 120, 255}


def test_contrast_of_coloured_images(colour):
    """The mean is that of the weighted grey image, not of all channels."""
    known = kernels.default_kernels()
    red = np.zeros((4, 4, 3), np.uint8)
    red[:2, :, 0], red[2:, :, 1] = 200, 100  # grey 60 and 59: the mean is 59.5
    got = known["contrast"].apply(red, {"factor": 0.7}, None)
    assert (got[0, 0] == [int(59.5 + 0.7 * 140.5), 17, 17]).all() and (got[3, 0] == [17, int(59.5 + 0.7 * 40.5), 17]).all()
    mean = pixels.mean(pixels.gray(F.col("p")))
    ready = colour.withColumn("mean", mean)
    assert (column(ready, pixels.contrasted(F.col("p"), 1.3, F.col("mean"))) == known["contrast"].apply(IMAGE, {"factor": 1.3}, None)).all()
    assert (column(ready, pixels.contrasted_rounded(F.col("p"), 1.3, F.col("mean"))) == known["contrast_rounded"].apply(IMAGE, {"factor": 1.3}, None)).all()


def test_small_blurs_use_fixed_rows():
    image = np.zeros((9, 9, 3), np.uint8)
    image[4, 4] = 64
    got = kernels.default_kernels()["gaussian_blur"].apply(image, {"kernel_size": 3}, None)
    assert got[3:6, 3:6, 0].tolist() == [[4, 8, 4], [8, 16, 8], [4, 8, 4]]
    for size in (1, 3, 5, 7, 9, 11):
        assert kernels.gaussian_line(size, 0.0).sum() == pytest.approx(1.0)


def png_file(image, kind, filters):
    """A PNG of one filter per line."""
    height, width, step = image.shape
    lines, flat = [], image.astype(int).reshape(height, width * step)
    for y, name in zip(range(height), filters, strict=True):
        left = np.concatenate([np.zeros(step, int), flat[y, :-step]])
        up = flat[y - 1] if y else np.zeros_like(flat[0])
        corner = np.concatenate([np.zeros(step, int), up[:-step]])
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0 * left, left, up, (left + up) // 2, near][name]
        lines.append(bytes([name]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes())
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def bmp_file(image):
    height, width = image.shape[:2]
    pad = b"\0" * (-3 * width % 4)
    body = b"".join(line[:, ::-1].tobytes() + pad for line in image[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_decoding():
    filters = [0, 1, 2, 3, 4, 4]
    assert (scans.decoded(png_file(IMAGE, 2, filters)) == IMAGE).all()
    assert (scans.decoded(png_file(IMAGE[..., :1], 0, filters)) == IMAGE[..., :1]).all()
    alpha = np.concatenate([IMAGE, IMAGE[..., :1]], axis=2)
    assert (scans.decoded(png_file(alpha, 6, filters)) == IMAGE).all()
    assert (scans.decoded(bmp_file(IMAGE)) == IMAGE).all()
    with pytest.raises(ValueError, match="no decoder"):
        scans.decoded(b"GIF89a\1\0\1\0;")


def test_truncated_files_are_corrupted(spark):
    good = png_file(IMAGE, 2, [0] * H)
    files = {"a": good, "b": good[:-20], "c": good[:-14] + b"\0" + good[-13:], "d": bmp_file(IMAGE)[:-1], "e": b"GIF89a\5\0\7\0", "f": b"GIF89a\5\0\7\0;", "g": None}
    got = {r["path"]: r for r in scans.inspect(spark.createDataFrame(list(files.items()), "path string, content binary")).collect()}
    assert [k for k in files if not got[k]["corrupted"]] == ["a", "f"] and got["b"]["error_message"]


def test_manifest_items(spark, tmp_path):
    for name, data in (("x/a.png", png_file(IMAGE, 2, [4] * H)), ("x/b.bmp", bmp_file(IMAGE)), ("x/c.gif", b"GIF89a\5\0\7\0;")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = spark.createDataFrame([("x/a.png", 0), ("x/b.bmp", 1), ("x/a.png", 1), ("x/c.gif", 0), ("x/none.png", 0)], "image_path string, label int")
    files = scans.image_files(spark, str(tmp_path))
    got = sorted((r["image_path"], r["label"], r["data"] and bytes(r["data"]) == IMAGE.tobytes(), r["error_message"]) for r in scans.items(rows, files).collect())
    assert got == [("x/a.png", 0, True, None), ("x/a.png", 1, True, None), ("x/b.bmp", 1, True, None), ("x/c.gif", 0, None, "no decoder for GIF"), ("x/none.png", 0, None, "no such file")]
    with pytest.raises(FileNotFoundError, match=r"1 files .*x/none.png"):
        scans.check_files(rows, files)
    assert scans.check_files(rows.where("image_path <> 'x/none.png'"), files).count() == 4
    (tmp_path / "x/empty").mkdir()
    with pytest.raises(FileNotFoundError):
        scans.image_files(spark, str(tmp_path / "x/empty"), required=True)
    assert scans.dataset_roots(spark, str(tmp_path)) == [f"{tmp_path}/x"]
    with pytest.raises(NotADirectoryError):
        scans.dataset_roots(spark, str(tmp_path / "x"))


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(i, y, s) for i, (y, s) in enumerate(zip([0, 0, 1, 1], [0.1, 0.6, 0.8, 0.3], strict=True))], "index long, true_label int, score double")
    row = results.export(rows, str(tmp_path / "e"), "run", notes="a note")
    assert json.loads((tmp_path / "e/metrics.json").read_text())["metrics"]["roc_auc"] == row["roc_auc"] == 0.75
    assert "a note" in (tmp_path / "e/report.md").read_text()
    read = lambda name: spark.read.option("header", True).csv(str(tmp_path / "e" / name))
    assert read("confusion").count() == 4 and read("top_fp").count() == 1 and read("predictions").count() == 4 and read("precision_recall").count() == 5
    with pytest.raises(ValueError, match="nothing"):
        results.export(rows.limit(0), str(tmp_path / "f"))
    for bad in ((9, 2, 0.5), (9, 1, 1.5)):
        with pytest.raises(Exception, match="must be"):
            results.export(rows.unionByName(spark.createDataFrame([bad], rows.schema)), str(tmp_path / "g"))


def test_checkpoints(spark, tmp_path):
    rows = spark.createDataFrame([(k, [float(k % 2), 1.0], k % 2) for k in range(20)], "vec_id long, embedding array<double>, label int")
    made, folder = model.train(rows, epochs=5), str(tmp_path / "c")
    losses = [r["loss"] for r in model.history(spark, made).orderBy("epoch").collect()]
    assert len(losses) > 1 and losses == sorted(losses, reverse=True)
    for epoch, eer in ((1, 0.3), (2, 0.1), (3, 0.2), (4, 0.4)):
        model.save_epoch(made, folder, epoch, {"eer": eer})
    assert model.latest(spark, folder).endswith("epoch_0004") and model.best(spark, folder, "eer").endswith("epoch_0002") and model.best(spark, folder, "eer", "max").endswith("epoch_0004")
    assert [p[-3:] for p in model.prune(spark, folder, 2, "eer")] == ["001"]
    assert sorted(r["epoch"] for r in model.checkpoints(spark, folder).collect()) == [2, 3, 4]
    assert model.predict(model.load(model.latest(spark, folder) + "/model"), rows).count() == 20


def test_statistics_files(spark, tmp_path):
    assigned = spark.createDataFrame([("a", "train", "bona_fide", ["A"]), ("b", "train", "morph", ["A", "B"]), ("c", "val", "morph", ["C", "D"])], "image_id string, split string, label string, identities array<string>")
    stats = statistics.split_statistics(assigned)
    sinks.statistics_table(stats, str(tmp_path / "s"))
    rows = [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()]
    assert [r[0] for r in rows] == ["test", "train", "val", "overall"]
    assert rows[1][5:] == ("66.6667", "bona_fide:0.5000;morph:0.5000") and rows[3][5:] == ("100.0000", None)
    sinks.document(stats, str(tmp_path / "s.json"))
    assert {r["split"] for r in json.loads((tmp_path / "s.json").read_text())} == {"train", "val", "test", "overall"}
    with pytest.raises(ValueError, match="more than"):
        sinks.document(stats, str(tmp_path / "t.json"), 2)
    outcomes = spark.createDataFrame([("failed", "x"), ("failed", "x"), ("failed", "y"), ("done", None)], "status string, reason string")
    assert {r["status"]: (r["n"], r["reasons"]) for r in statistics.run_report(outcomes).collect()} == {"failed": (3, ["x: 2", "y: 1"]), "done": (1, [])}


def test_morph_by_places_equals_the_array_form(spark):
    images = [RNG.integers(0, 256, (9, 11, 3)).astype(np.uint8) for _ in range(4)]
    points = [[(2.3, 2.1), (7.9, 2.4), (5.2, 6.3)], [(3.1, 2.8), (8.2, 3.3), (4.4, 5.9)]]
    schema = "name string, height int, width int, pixels_a array<int>, pixels_b array<int>, points_a array<struct<x:double,y:double>>, points_b array<struct<x:double,y:double>>"
    pairs = [("p", 0, 1, points[0], points[1]), ("q", 2, 3, points[1], points[1])]
    frame = spark.createDataFrame([(n, 9, 11, images[i].ravel().tolist(), images[j].ravel().tolist(), p, q) for n, i, j, p, q in pairs], schema)
    got = {r["name"]: np.array(r["pixels"]).reshape(9, 11, 3) for r in morphs.morph_pixels(frame, 0.3).collect()}
    for name, i, j, p, q in pairs:
        want = array_forms.blend(images[i], images[j], np.array(p), np.array(q), 0.3)
        assert np.abs(got[name] - want.astype(int)).max() <= 1 and (got[name] == want).mean() > 0.9  # shared edges round either way


def test_morph_of_two_sizes(spark):
    a, b = np.full((8, 8, 3), 90, np.uint8), np.full((4, 6, 3), 30, np.uint8)
    points = [(2.0, 2.0), (5.0, 2.0), (3.0, 5.0)]
    schema = "name string, height int, width int, height_b int, width_b int, data_a binary, data_b binary, points_a array<struct<x:double,y:double>>, points_b array<struct<x:double,y:double>>"
    row = morphs.morph(spark.createDataFrame([("m", 8, 8, 4, 6, a.tobytes(), b.tobytes(), points, points)], schema)).first()
    assert row["error"] is None and set(row["data"]) == {60} and len(row["data"]) == 192


def test_training_inputs_are_mirrored(spark):
    data = bytes([255, 0, 0, 0, 0, 0] * 2)
    images = spark.createDataFrame([(f"p{k}", 2, 2, data) for k in range(60)], "path string, height int, width int, data binary")
    plain = {r[0]: r[1] for r in faces.model_inputs(images, size=2).collect()}
    mixed = {r[0]: r[1] for r in faces.model_inputs(images, size=2, flip_share=0.5, seed=3).collect()}
    changed = [k for k in plain if plain[k] != mixed[k]]
    assert 15 < len(changed) < 45 and all(np.allclose(np.array(mixed[k]).reshape(3, 2, 2)[:, :, ::-1].ravel(), plain[k]) for k in changed)
    assert mixed == {r[0]: r[1] for r in faces.model_inputs(images.repartition(5), size=2, flip_share=0.5, seed=3).collect()}


def test_sql_functions(spark):
    from loomwork.functions import sql

    names = sql.register(spark)
    assert "kernel_brightness" in names and "detection_rows" in names
    spark.createDataFrame([("a", H, W, IMAGE.tobytes()), ("b", H, W, None)], "path string, height int, width int, data binary").createOrReplaceTempView("sql_images")
    rows = {r[0]: r[1:] for r in spark.sql("SELECT path, kernel_brightness(path, height, width, data, map('factor', 0.5D)), kernel_rotation(path, height, width, data, map()) FROM sql_images").collect()}
    assert (np.frombuffer(rows["a"][0], np.uint8).reshape(IMAGE.shape) == np.rint(IMAGE * 0.5)).all() and len(rows["a"][1]) == IMAGE.size and rows["b"] == (None, None)
    found = spark.sql("SELECT d.* FROM detection_rows(map('f', named_struct('score', 0.9D, 'facial_area', array(1, 2, 3, 4)), 'g', named_struct('score', 0.1D, 'facial_area', array(0, 0, 1, 1))), 0.5D) d").collect()
    assert [tuple(r) for r in found] == [("f", 0.9, 1, 2, 3, 4)]
