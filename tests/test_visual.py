from pathlib import Path

import numpy as np
import pytest

from loomwork.operators import visual
from loomwork.plans import training
from loomwork.session import run_dir
from loomwork.sources import scans, sinks

SCHEMA = "image_path string, height int, width int, data binary, error_message string, embedding string, path string"


def test_vectors_keep_other_columns_and_tell_failures(spark):
    data = np.full(2 * 2 * 3, 255, np.uint8).tobytes()
    rows = [("a", 2, 2, data, None, "old", "p"), ("b", 2, 2, b"x", None, None, None), ("c", None, None, None, "no such file", None, "q"), (None, 2, 2, data, None, None, None)]
    got = {r["image_path"]: r for r in visual.vectors(spark.createDataFrame(rows, SCHEMA), 1).collect()}
    assert np.allclose(got["a"]["embedding"], [(1 - 0.485) / 0.229, (1 - 0.456) / 0.224, (1 - 0.406) / 0.225]) and got["a"]["path"] == "p"
    assert got["b"]["embedding"] is None and got["b"]["error_message"] == "unreadable image"
    assert got["c"]["error_message"] == "no such file" and got["c"]["path"] == "q"
    assert got[None]["embedding"] == got["a"]["embedding"]
    assert visual.vectors(spark.createDataFrame([], SCHEMA), 1).count() == 0


def test_folder_without_images(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        visual.folder_vectors(spark, str(tmp_path))


def test_manifest_rows_open_their_files_by_name(spark, tmp_path, monkeypatch):
    root = tmp_path / "pictures"
    names = ["a/1.png", "a/2.PNG", "a b/=%20.png", "_x=1/3.png", ".h/4.png", "_h/5.png", "a/_6.png", "a/7.txt"]
    for k, name in enumerate(names):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(sinks._png(2, 2, bytes([20 * k] * 12)))
    (root / "a/8.png").write_bytes(b"no image")
    (root / "a/9.png").mkdir()
    wanted = [*names, "a/8.png", "a/9.png", "a/1.png", "a//1.png", "./a/1.png", "a/../a/1.png", "none.png", "a", None]
    rows = spark.createDataFrame([(k, name, None if k % 2 else 1.5) for k, name in enumerate(wanted)], "id int, image_path string, more double")
    files = scans.image_files(spark, str(root))
    listed, named = scans.items(rows, files), scans.named_items(rows, scans.mounted(spark, f"file://{root}"))
    assert listed.schema.simpleString() == named.schema.simpleString()
    assert sorted(listed.collect(), key=lambda r: r["id"]) == sorted(named.collect(), key=lambda r: r["id"])
    base = scans.mounted(spark, str(root))
    for check in (lambda r: scans.check_files(r, files), lambda r: scans.check_named(r, base)):
        with pytest.raises(FileNotFoundError, match=r"10 files .*'\.\./a/1.png'|10 files .*\./a/1.png"):
            check(rows.where("image_path IS NOT NULL"))
    assert scans.mounted(spark, str(root / "none")) is None and scans.mounted(spark, f"{root}/*") is None and scans.mounted(spark, str(root / "a/1.png")) is None
    (tmp_path / "m.csv").write_text("image_path,label\na/1.png,morph\na/8.png,0\na/1.png,0\n")
    monkeypatch.setattr(scans, "image_files", lambda *a, **k: pytest.fail("a mounted folder was listed"))
    monkeypatch.setattr(scans, "PIECE_BYTES", 1)
    got = visual.manifest_vectors(spark, str(tmp_path / "m.csv"), str(root), size=1).orderBy("image_path", "label").collect()
    assert [(r["image_path"], r["label"], r["embedding"] is None, r["error_message"]) for r in got] == [("a/1.png", 0, False, None), ("a/1.png", 1, False, None), ("a/8.png", 0, True, "no image header")]
    (tmp_path / "m.csv").write_text("image_path,label\na/1.png,morph\nnone.png,0\n")
    with pytest.raises(FileNotFoundError, match=r"1 files .*none.png"):
        visual.manifest_vectors(spark, str(tmp_path / "m.csv"), str(root), size=1)


def test_images_of_one_row_group_are_written_by_many_tasks(spark, tmp_path):
    rows = [(k, [(k % 7 - 3) / 9.0] * 64, k % 2) for k in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    before = set(Path(run_dir(spark).removeprefix("file://")).glob("written-classified-*"))
    assert training.classified_images(spark, str(tmp_path)).count() == 80
    (folder,) = set(Path(run_dir(spark).removeprefix("file://")).glob("written-classified-*")) - before
    assert len(list(folder.glob("part-*"))) > 1
