import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import chain, geometry, kernels, paths, pixels, training
from loomwork.operators import morphs
from loomwork.sources import scans, sinks
from loomwork.streaming import logs

RNG = np.random.default_rng(1)


def png(width, height):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes(3 * width) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_scan_and_inspect(spark, tmp_path):
    root = tmp_path / "dataset"
    for name, data in {"alice/a.png": png(64, 48), "alice/deep/b.JPG": b"x", "bob/c.gif": b"GIF89a" + struct.pack("<HH", 5, 7) + b";", "bob/notes.txt": b"no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "carol").mkdir()
    got = {(r["identity"], r["format"], r["width"], r["height"], r["corrupted"]) for r in scans.image_inventory(spark, str(root)).collect()}
    assert got == {("alice", "PNG", 64, 48, False), ("alice", None, None, None, True), ("bob", "GIF", 5, 7, False)}
    assert [r["identity"] for r in scans.identity_folders(spark, str(root)).collect()] == ["alice", "bob", "carol"]
    with pytest.raises(NotADirectoryError):
        scans.identity_folders(spark, str(root / "none"))
    assert scans.image_files(spark, str(root / "alice"), recursive=False).count() == 1


def test_headers():
    jpeg = b"\xff\xd8\xff\xe0\0\4xx\xff\xc0\0\x11\x08" + struct.pack(">HH", 20, 30) + b"\3"
    assert scans.header(jpeg) == ("JPEG", 30, 20)
    assert scans.header(b"BM" + bytes(16) + struct.pack("<ii", 9, -8)) == ("BMP", 9, 8)
    tiff = b"II*\0\x08\0\0\0\2\0" + struct.pack("<HHIHH", 256, 3, 1, 11, 0) + struct.pack("<HHII", 257, 4, 1, 12)
    assert scans.header(tiff) == ("TIFF", 11, 12)


def test_metadata_and_manifests(spark, tmp_path):
    text = {"bona_fide": [{"image_id": "a", "identity": "A"}], "morphs": [{"image_id": "m", "identity_a": "A", "identity_b": "B", "label": "x"}]}
    (tmp_path / "m.json").write_text(json.dumps(text))
    singles, pairs = scans.split_metadata(spark, str(tmp_path / "m.json"))
    assert [tuple(r) for r in singles.collect()] == [(0, "a", "A", "bona_fide")] and pairs.first()["label"] == "x"
    rows = spark.createDataFrame([("b", "train", "morph", ["A", "B"]), ("a", "train", "bona_fide", ["A"])], "image_id string, split string, label string, identities array<string>")
    sinks.split_manifests(rows, str(tmp_path / "out"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "out/train"))
    assert [tuple(r) for r in back.collect()] == [("a", "train", "bona_fide", "A"), ("b", "train", "morph", "A|B")]
    assert spark.read.option("header", "true").csv(str(tmp_path / "out/validation")).columns == list(sinks.MANIFEST)
    known = scans.manifest(spark, str(tmp_path / "out/train"), "image_id")
    assert [r["label"] for r in known.orderBy("image_id").collect()] == [0, 1]
    with pytest.raises(ValueError, match="lacks"):
        scans.manifest(spark, str(tmp_path / "out/train"))


def test_append_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a")], "n int, s string")
    sinks.append_log(rows, path)
    sinks.append_log(rows, path)
    sinks.append_log(rows.limit(0), path)
    assert sinks.read_log(spark, path).count() == 2
    with pytest.raises(ValueError, match="the log has"):
        sinks.append_log(rows.withColumn("x", F.lit(1)), path)


def test_streams(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.sql("SELECT 1 AS id, timestamp'2024-01-01 10:00:00' AS ts, 'ok' AS status UNION ALL SELECT 2, timestamp'2024-01-02 10:00:00', 'failed' UNION ALL SELECT 2, timestamp'2024-01-02 10:00:00', 'failed'").write.parquet(source)
    stream = logs.log_stream(spark, source, "id int, ts timestamp, status string")
    for run in range(2):
        logs.append_new(stream, "id", target, str(tmp_path / f"c{run}")).awaitTermination()
        assert spark.read.parquet(target).count() == 2
    query = logs.windowed_counts(stream, "ts", "status").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["status"], r["n"]) for r in spark.table("counts").collect()) == [("failed", 2), ("ok", 1)]


def test_kernels():
    image = RNG.integers(0, 256, (32, 48, 3)).astype(np.uint8)
    registry = kernels.Registry()
    for name in registry.names():
        out, applied, _, error = kernels.augment_one(image, "p", [name], registry, 1, 1.0)
        again = kernels.augment_one(image, "p", [name], registry, 1, 1.0)[0]
        assert out.shape == image.shape and out.dtype == np.uint8 and applied == [name] and error is None and (out == again).all()
        assert kernels.augment_one(image, "p", [name], registry, 1, 0.0)[1] == []
    plain = np.full((16, 16, 3), 100, np.uint8)
    bright = registry.get("brightness").apply
    assert (bright(plain, {"factor": 1.3}, None) == 130).all() and (bright(plain, {"factor": 0.7}, None) == 70).all()
    assert (kernels.turned(image, 0.0, (24, 16)) == image).all()
    assert (registry.get("horizontal_flip").apply(image, {}, None)[:, 0] == image[:, -1]).all()
    assert np.abs(kernels.convolved(plain, kernels.gaussian(7, 0)) - 100).max() < 1e-9
    assert kernels.motion(5, 0).sum() == pytest.approx(1.0)
    for quality in (30, 90):
        assert np.abs(kernels.jpeg_round_trip(plain, quality).astype(int) - 100).max() <= 2


def test_registry_and_failures():
    registry = kernels.Registry({})
    registry.register("broken", kernels.Kernel(lambda rng: {}, lambda i, p, rng: 1 / 0))
    registry.register("invert", kernels.Kernel(lambda rng: {}, lambda i, p, rng: 255 - i))
    image = np.full((2, 2, 3), 5, np.uint8)
    out, applied, _, error = kernels.augment_one(image, "p", ["broken", "invert"], registry, 0, 1.0)
    assert (out == 250).all() and applied == ["invert"] and error.startswith("broken")
    with pytest.raises(ValueError, match="registered"):
        registry.register("invert", registry.get("invert"))
    with pytest.raises(ValueError, match="odd"):
        kernels.odd_size(2, 5)
    with pytest.raises(ValueError, match="bytes"):
        kernels.augment_one(np.zeros((2, 2)), "p", [], registry, 0, 1.0)


def test_augment_rows(spark):
    data = bytes(RNG.integers(0, 256, 8 * 8 * 3).astype(np.uint8))
    rows = spark.createDataFrame([("a.jpg", 8, 8, data), ("b.jpg", 8, 8, b"short"), ("c.jpg", 8, 8, None)], "path string, height int, width int, data binary")
    got = chain.augment(rows, ["horizontal_flip", "gamma"], probability=1.0, copies=2).collect()
    assert len(got) == 6 and sum(r["error"] is None for r in got) == 2
    named = chain.augment(rows, ["horizontal_flip"], probability=1.0).select(paths.augmented_name(F.col("path"), F.col("applied"), F.lit(".png"))).collect()
    assert {r[0] for r in named} == {"a_aug_horizontal_flip.png", "b_aug_noop.png", "c_aug_noop.png"}


def test_chain_draws_applies_and_survives(spark):
    image = RNG.integers(0, 256, (7, 5, 3)).astype(np.uint8)
    rows = spark.createDataFrame([(f"{k}.png", 7, 5, image.tobytes()) for k in range(40)], "path string, height int, width int, data binary")
    known = {n: chain.default_kernels()[n] for n in ("brightness", "horizontal_flip", "gaussian_blur_random")}
    known |= {"null": chain.Kernel(lambda i, p: F.lit(None).cast("array<int>")), "short": chain.Kernel(lambda i, p: F.slice(i.pixels, 1, 3)), "holes": chain.Kernel(lambda i, p: F.transform(i.pixels, lambda x: F.when(x < 0, x)))}
    got = {r.path: r for r in chain.augment(rows, ["null", "brightness", "short", "horizontal_flip", "holes"], known, seed=4).collect()}
    again = {r.path: r for r in chain.augment(rows.repartition(3), ["null", "brightness", "short", "horizontal_flip", "holes"], known, seed=4).collect()}
    assert got == again and {tuple(r.applied) for r in got.values()} == {(), ("brightness",), ("horizontal_flip",), ("brightness", "horizontal_flip")}
    failed = {(e or "").count("no image") for e in (r.error for r in got.values())}
    assert failed == {0, 1, 2, 3} and all("brightness" not in (r.error or "") for r in got.values())
    for r in got.values():
        want = image.astype(float)
        if "brightness" in r.applied:
            assert 0.7 <= r.parameters["brightness.factor"] <= 1.3
            want = np.clip(np.rint(want * r.parameters["brightness.factor"]), 0, 255)
        want = want[:, ::-1] if "horizontal_flip" in r.applied else want
        assert (np.frombuffer(r.data, np.uint8).reshape(image.shape) == want).all()
        assert set(r.parameters) == ({"brightness.factor"} if "brightness" in r.applied else set())
    with pytest.raises(ValueError, match="unknown kernels: no"):
        chain.augment(rows, ["no"])
    with pytest.raises(ValueError, match="probability"):
        chain.augment(rows, [], probability=1.5)
    with pytest.raises(ValueError, match="odd"):
        chain.odd(2, 5)


def test_every_kernel_of_the_chain_equals_its_array_form(spark):
    image = RNG.integers(0, 256, (12, 9, 3)).astype(np.uint8)
    rows, known = spark.createDataFrame([("p", 12, 9, image.tobytes())], "path string, height int, width int, data binary"), chain.default_kernels()
    assert sorted(known) == kernels.Registry().names()
    for name in sorted(known):
        r = chain.augment(rows, [name], probability=1.0).first()
        got, drawn = np.frombuffer(r.data, np.uint8).reshape(image.shape), {k.split(".")[1]: v for k, v in r.parameters.items()}
        assert r.applied == [name] and r.error is None and set(drawn) == set(known[name].draws)
        if name not in ("gaussian_noise", "salt_pepper"):
            want = kernels.Registry().get(name).apply(image, drawn, None).astype(int)
            assert (np.abs(got - want) <= 1).mean() > 0.99 and (got == want).mean() > 0.9, name


def test_pixel_columns_match_kernels(spark):
    image = RNG.integers(0, 256, (4, 6, 3)).astype(np.uint8)
    frame = spark.createDataFrame([(image.ravel().astype(int).tolist(),)], "p array<int>").withColumn("m", pixels.mean(F.col("p")))
    registry = kernels.Registry()
    for column, name, params in (
        (pixels.flipped(F.col("p"), 6, 3), "horizontal_flip", {}),
        (pixels.brightened(F.col("p"), 1.21), "brightness", {"factor": 1.21}),
        (pixels.contrasted(F.col("p"), 1.21, F.col("m")), "contrast", {"factor": 1.21}),
        (pixels.gamma_corrected(F.col("p"), 1.4), "gamma", {"gamma": 1.4}),
    ):
        want = registry.get(name).apply(image, params, None).ravel().tolist()
        assert max(abs(a - b) for a, b in zip(frame.select(column).first()[0], want, strict=True)) <= (0 if name != "contrast" else 1)
    assert bytes(frame.select(pixels.packed(F.col("p"))).first()[0]) == image.tobytes()


def test_triangles_cover_the_image():
    points = np.vstack([RNG.uniform(10, 118, (40, 2)), [(0, 0), (127, 0), (0, 127), (127, 127)]])
    mesh = morphs.triangles(points)
    sides = [(points[b] - points[a], points[c] - points[a]) for a, b, c in mesh]
    area = sum(abs(u[0] * v[1] - u[1] * v[0]) / 2 for u, v in sides)
    assert area == pytest.approx(127 * 127, rel=1e-6)


def test_morph_deals_pairs_and_joins_nothing(spark):
    data, points = bytes(range(192)), [(2.0, 2.0), (5.0, 2.5), (3.0, 5.0)]
    rows = spark.createDataFrame([(f"m{k}", 8, 8, data, data, points, points) for k in range(40)], "name string, height int, width int, data_a binary, data_b binary, points_a array<struct<x:double,y:double>>, points_b array<struct<x:double,y:double>>")
    done = morphs.morph(rows)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan and "partial_collect_list" in plan
    assert {bytes(r["data"]) for r in done.collect()} == {data}


def test_morph(spark):
    grey = np.full((16, 16, 3), 50, np.uint8).tobytes()
    light = np.full((16, 16, 3), 150, np.uint8).tobytes()
    points = [(4.0, 4.0), (11.0, 5.0), (7.0, 11.0)]
    rows = spark.createDataFrame([("m", 16, 16, grey, light, points, points), ("bad", 16, 16, grey, b"x", points, points)], "name string, height int, width int, data_a binary, data_b binary, points_a array<struct<x:double,y:double>>, points_b array<struct<x:double,y:double>>")
    got = {r["name"]: r for r in morphs.morph(rows, 0.25).collect()}
    assert set(got["m"]["data"]) == {75} and got["bad"]["data"] is None and got["bad"]["error"]


def test_alignment(spark):
    schema = "id int, width int, height int, detections map<string,struct<score:double,facial_area:array<int>,landmarks:map<string,array<double>>>>"
    marks = {"left_eye": [160.0, 100.0], "right_eye": [90.0, 100.0]}
    rows = [
        (1, 300, 300, {"face_1": (0.99, [50, 50, 200, 200], marks)}),
        (2, 300, 300, {}),
        (3, 300, 300, {"face_1": (0.2, [50, 50, 200, 200], marks)}),
        (4, 300, 300, {"a": (0.99, [0, 0, 10, 10], marks), "b": (0.95, [20, 20, 90, 90], marks)}),
        (5, 300, 300, {"face_1": (0.99, [400, 400, 500, 500], marks)}),
    ]
    got = {r["id"]: r for r in geometry.align(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["success"] and got[1]["angle"] == 0.0 and tuple(got[1]["crop"]) == (5, 5, 245, 245)
    assert got[2]["failure_reason"] == "No faces detected"
    assert got[3]["failure_reason"] == "All detections below score threshold (best=0.200, threshold=0.900)"
    assert tuple(got[4]["crop"]) == (0, 0, 111, 111) and got[5]["failure_reason"].startswith("Degenerate crop")


def test_paths(spark):
    row = spark.range(1).select(
        paths.extension(F.lit("a/b.JPG")).alias("e"), paths.extension(F.lit("a/.hidden")).alias("h"), paths.stem(F.lit("x/y.tar.gz")).alias("s"),
        paths.morph_name(F.lit("p"), F.lit("q"), F.lit(0.29)).alias("m"), paths.mirrored(F.lit("in/a/b.png"), "in", "out", ".jpg").alias("o"),
        paths.resolved(F.lit("/x"), "r").alias("abs"), paths.part(F.lit("a"), 2).alias("none"), paths.is_timestamp(F.lit("2024-01-01T00:00:00")).alias("t"),
    ).first()
    assert tuple(row) == (".jpg", "", "y.tar", "morph_p_q_a028.jpg", "out/a/b.jpg", "/x", "", True)
    some = F.array(F.lit("gamma"), F.lit("flip"))
    row = spark.range(1).select(
        paths.mirrored(F.lit("in.x/a.png"), "in.x", "out").alias("a"), paths.mirrored(F.lit("in_x/a.png"), "in.x", "out").alias("b"), paths.mirrored(F.lit("i[n/a.png"), "i[n/", "out/").alias("c"),
        paths.augmented_name(F.lit("x/y.png"), some, F.lit(".jpg")).alias("d"), paths.augmented_name(F.lit("x/y.png"), some, F.lit(".jpg"), "operator_prefix").alias("e"),
        paths.augmented_name(F.lit("x/y.png"), some, F.lit(".jpg"), "flat").alias("f"), paths.output_suffix(F.lit("a.JPEG")).alias("g"), paths.output_suffix(F.lit("a.JPEG"), " JPEG").alias("h"),
        paths.epoch_name(F.lit(7)).alias("i"), paths.elapsed_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:01:30.5").cast("timestamp")).alias("j"),
    ).first()
    assert tuple(row) == ("out/a.png", "out/in_x/a.png", "out/a.png", "y_aug_gamma_flip.jpg", "aug_gamma_flip_y.jpg", "y.jpg", ".jpeg", ".jpg", "epoch_0007.pt", 90.5)
    assert paths.metric_name("val_eer") == "eer"
    for call in (lambda: paths.output_suffix(F.lit("a"), "webm"), lambda: paths.augmented_name(F.lit("a"), some, F.lit("b"), "other")):
        with pytest.raises(ValueError, match="none of"):
            call()


def test_early_stopping_and_rates(spark):
    values = [1.0, 0.9, 0.95, 0.94, 0.93, 0.8]
    rows = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run string, epoch long, loss double")
    got = training.early_stopping(rows, ["run"], "epoch", "loss", 1).orderBy("epoch").collect()
    assert [r["counter"] for r in got] == [0, 0, 1, 2, 3, 0] and [r["should_stop"] for r in got] == [False, False, False, True, True, False]
    assert training.early_stopping(rows, ["run"], "epoch", "loss", 0, mode="max").orderBy("epoch").collect()[1]["should_stop"]
    assert training.best_epoch(rows, ["run"], "epoch", "loss").first()["best_epoch"] == 5
    with pytest.raises(ValueError, match="mode"):
        training.early_stopping(rows, ["run"], "epoch", "loss", 1, mode="x")
    factors = spark.range(4).select(training.cosine_factor(F.col("id"), 2, 4).alias("f")).collect()
    assert [r["f"] for r in factors] == pytest.approx([0.5, 1.0, 1.0, 0.5])
