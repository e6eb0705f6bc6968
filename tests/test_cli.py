import json

import numpy as np

from loomwork import cli
from loomwork.operators import faces, model
from loomwork.sources import sinks


def test_split(spark, tmp_path, capsys):
    people = "ABCDEF"
    document = {
        "bona_fide": [{"image_id": f"{p}.jpg", "identity": p} for p in people],
        "morphs": [{"image_id": "ab.jpg", "identity_a": "A", "identity_b": "B"}],
    }
    (tmp_path / "m.json").write_text(json.dumps(document))
    base = ["split", "--metadata", str(tmp_path / "m.json"), "--output", str(tmp_path / "out")]
    assert cli.main([*base, "--verify", "--statistics"], spark) == cli.DONE
    assert "overall" in capsys.readouterr().out
    rows = [tuple(r) for s in ("train", "validation", "test") for r in spark.read.option("header", "true").csv(str(tmp_path / "out" / s)).collect()]
    assert sorted(r[0] for r in rows) == sorted([*(f"{p}.jpg" for p in people), "ab.jpg"])
    assert len({r[1] for r in rows if r[0] in ("A.jpg", "B.jpg", "ab.jpg")}) == 1
    assert cli.main([*base, "--train-ratio", "0.9"], spark) == cli.BAD_CONFIG
    assert cli.main(["split", "--metadata", str(tmp_path / "none.json"), "--output", "x"], spark) == cli.NO_PATH
    assert cli.main(["split"], spark) == cli.BAD_ARGUMENTS
    (tmp_path / "images").mkdir()
    (tmp_path / "images/A.jpg").write_bytes(b"x")
    assert cli.main([*base, "--verify", "--input", str(tmp_path / "images")], spark) == cli.NOT_VERIFIED


def test_inspect(spark, tmp_path):
    (tmp_path / "d/alice").mkdir(parents=True)
    (tmp_path / "d/bob").mkdir()
    (tmp_path / "d/alice/a.gif").write_bytes(b"GIF89a\5\0\7\0;")
    assert cli.main(["inspect", str(tmp_path / "d"), "--output", str(tmp_path / "o")], spark) == cli.DONE
    rows = {r["identity"]: r for r in spark.read.option("header", "true").csv(str(tmp_path / "o/identities")).collect()}
    assert rows["alice"]["resolutions"] == "5x7" and rows["bob"]["image_count"] == "0"
    assert cli.main(["inspect", str(tmp_path / "none"), "--output", "x"], spark) == cli.NO_PATH
    assert cli.main(["inspect", "--discover", str(tmp_path), "--output", str(tmp_path / "o2")], spark) == cli.DONE
    assert spark.read.option("header", "true").csv(str(tmp_path / "o2/identities")).where("identity = 'alice'").count() == 1


def test_augment_and_evaluate(spark, tmp_path):
    data = np.zeros(12, np.uint8).tobytes()
    spark.createDataFrame([("a", 2, 2, data)], "path string, height int, width int, data binary").write.parquet(str(tmp_path / "i"))
    assert cli.main(["augment", "--input", str(tmp_path / "i"), "--output", str(tmp_path / "o"), "--operators", "gamma,horizontal_flip", "--copies", "3"], spark) == cli.DONE
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3
    assert cli.main(["augment", "--input", str(tmp_path / "i"), "--output", "x", "--operators", "nothing"], spark) == cli.BAD_ARGUMENTS
    rows = [(i, y, s) for i, (y, s) in enumerate(zip([0, 0, 1, 1], [0.1, 0.6, 0.8, 0.3], strict=True))]
    spark.createDataFrame(rows, "index long, true_label int, score double").write.parquet(str(tmp_path / "p"))
    assert cli.main(["evaluate", "--input", str(tmp_path / "p"), "--output", str(tmp_path / "e")], spark) == cli.DONE
    assert json.loads((tmp_path / "e/metrics.json").read_text())["metrics"]["roc_auc"] == 0.75
    assert spark.read.json(str(tmp_path / "e/errors")).first()["errors"] == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "e/misclassified")).count() == 2


def test_align_morph_and_predict(spark, tmp_path):
    data = np.full(8 * 8 * 3, 90, np.uint8).tobytes()
    marks = {"left_eye": [5.0, 2.0], "right_eye": [2.0, 2.0]}
    schema = "path string, height int, width int, data binary, detections map<string,struct<score:double,facial_area:array<int>,landmarks:map<string,array<double>>>>"
    rows = [("a", 8, 8, data, {"f": (0.99, [1, 1, 6, 6], marks)}), ("b", 8, 8, data, {}), ("c", 8, 8, b"x", {"f": (0.99, [1, 1, 6, 6], marks)}), ("d", 8, 8, data, None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "i"))
    command = ["align", "--input", str(tmp_path / "i"), "--output", str(tmp_path / "o"), "--size", "4"]
    assert cli.main(command, spark) == cli.DONE
    got = {r["path"]: r for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got["a"]["success"] and set(got["a"]["data"]) == {90} and len(got["a"]["data"]) == 48
    assert got["b"]["failure_reason"] == got["d"]["failure_reason"] == "No faces detected" and got["c"]["failure_reason"] == "unreadable image"
    assert cli.main(command, spark) == cli.DONE
    assert spark.read.parquet(str(tmp_path / "o")).where("path = 'a'").count() == 1
    points = [(2.0, 2.0), (5.0, 2.0), (3.0, 5.0)]
    pair = "name string, height int, width int, data_a binary, data_b binary, points_a array<struct<x:double,y:double>>, points_b array<struct<x:double,y:double>>"
    spark.createDataFrame([("m", 8, 8, data, data, points, points)], pair).write.parquet(str(tmp_path / "p"))
    assert cli.main(["morph", "--input", str(tmp_path / "p"), "--output", str(tmp_path / "m"), "--images", str(tmp_path / "png")], spark) == cli.DONE
    assert (tmp_path / "png/m.png").read_bytes()[:8] == b"\x89PNG\r\n\x1a\n"
    assert set(spark.read.parquet(str(tmp_path / "m")).first()["data"]) == {90}
    assert cli.main(["morph", "--input", str(tmp_path / "p"), "--output", "x", "--alpha", "2"], spark) == cli.BAD_ARGUMENTS
    known = spark.createDataFrame([(k, [float(k % 2), 1.0], k % 2) for k in range(20)], "vec_id long, embedding array<double>, label int")
    known.write.parquet(str(tmp_path / "v"))
    command = ["train", "--input", str(tmp_path / "v"), "--validation", str(tmp_path / "v"), "--output", str(tmp_path / "runs"), "--epochs", "4"]
    assert cli.main(command, spark) == cli.DONE
    assert model.checkpoints(spark, str(tmp_path / "runs")).first()["metrics"]["roc_auc"] == 1.0
    model.save(model.train(known), str(tmp_path / "model"))
    assert cli.main(["predict", "--input", str(tmp_path / "v"), "--model", str(tmp_path / "model"), "--output", str(tmp_path / "s")], spark) == cli.DONE
    scored = spark.read.option("header", True).csv(str(tmp_path / "s"))
    assert scored.where("predicted_label <> vec_id % 2").count() == 0 and scored.count() == 20
    assert cli.main(["predict", "--input", str(tmp_path / "none"), "--model", str(tmp_path / "model"), "--output", "x"], spark) == cli.NO_PATH


def test_model_inputs(spark):
    data = bytes([255, 0, 0] * 4)
    got = {r[0]: r[1] for r in faces.model_inputs(spark.createDataFrame([("a", 2, 2, data), ("b", 2, 2, None), ("c", 3, 3, data)], "path string, height int, width int, data binary"), size=2).collect()}
    assert got["b"] is None and got["c"] is None
    assert np.allclose(np.array(got["a"]).reshape(3, 4)[:, 0], [(1 - 0.485) / 0.229, -0.456 / 0.224, -0.406 / 0.225])


def test_train_and_predict_over_image_folders(spark, tmp_path):
    root = tmp_path / "images"
    rows = [(f"{'dark' if k % 2 else 'light'}/{k}", 4, 4, np.full(48, 20 + k if k % 2 else 200 + k, np.uint8).tobytes()) for k in range(12)]
    sinks.image_files(spark.createDataFrame(rows, "path string, height int, width int, data binary"), str(root)).count()
    lines = [f"{path}.png,{'morph' if 'dark' in path else 'bona_fide'}" for path, *_ in rows]
    (tmp_path / "train.csv").write_text("image_path,label\n" + "\n".join(lines) + "\n")
    command = ["train", "--images", str(root), "--size", "3", "--epochs", "10", "--output", str(tmp_path / "runs"), "--flip-share", "0.5"]
    manifest = str(tmp_path / "train.csv")
    assert cli.main([*command, "--input", manifest, "--validation", manifest], spark) == cli.DONE
    assert model.checkpoints(spark, str(tmp_path / "runs")).first()["metrics"]["roc_auc"] == 1.0
    (root / "dark/broken.png").write_bytes(b"no image")
    (root / "dark/.hidden").mkdir()
    (root / "dark/.hidden/x.png").write_bytes(b"no image")
    saved = f"{model.latest(spark, str(tmp_path / 'runs'))}/model"
    out = tmp_path / "scores.csv"
    base = ["predict", "--model", saved, "--size", "3", "--output", str(out)]
    assert cli.main([*base, "--images", str(root), "--recursive"], spark) == cli.DONE
    head, *found = [line.split(",") for line in out.read_bytes().decode().split("\r\n")[:-1]]
    assert head == ["image_path", "predicted_label", "probability_morph", "probability_bonafide"]
    assert [f[0] for f in found] == sorted(f"{path}.png" for path, *_ in rows)
    assert all((f[1] == "1") == f[0].startswith("dark/") and abs(float(f[2]) + float(f[3]) - 1) < 1e-9 for f in found)
    failed = (tmp_path / "scores.failed.csv").read_bytes().decode().split("\r\n")
    assert failed[0] == "image_path,error_message" and failed[1].startswith("dark/broken.png,") and failed[2:] == [""]
    assert cli.main([*base, "--images", str(root)], spark) == cli.NO_PATH  # no images right in the folder
    assert cli.main(base, spark) == cli.BAD_ARGUMENTS
    (tmp_path / "bad.csv").write_text("image_path,label\nlight/99.png,morph\n")
    assert cli.main([*command, "--input", str(tmp_path / "bad.csv")], spark) == cli.NO_PATH
