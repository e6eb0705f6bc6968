import json

import pytest

from loomwork import config, reports
from loomwork.functions import metrics
from loomwork.operators import statistics

DATA = {"train_csv": "a", "val_csv": "b", "test_csv": "c", "image_root": "d"}


def document(**sections):
    return {"data": DATA, "model": {}, "optimizer": {}, "scheduler": {}, "training": {}} | sections


def test_defaults_and_round_trip(tmp_path):
    made = config.experiment(document())
    assert made["optimizer"]["betas"] == (0.9, 0.999) and made["training"]["early_stopping_metric"] == "val_eer"
    config.save(made, str(tmp_path / "x/c.yaml"))
    assert config.load(str(tmp_path / "x/c.yaml")) == made
    assert config.flattened(made)["scheduler.total_epochs"] == 30


@pytest.mark.parametrize(
    "bad",
    [
        document(data={"train_csv": "a"}),
        document(model={"dropout": 1.0}),
        document(model={"unknown": 1}),
        document(optimizer={"lr": 0}),
        document(optimizer={"lr": "fast"}),
        document(scheduler={"total_epochs": 5}),
        document(scheduler={"warmup_epochs": 30}),
        document(training={"early_stopping_mode": "up"}),
        document(extra={}),
        {"data": DATA},
        document(experiment_name=" "),
    ],
)
def test_bad_documents(bad):
    with pytest.raises(config.ConfigError):
        config.experiment(bad)


def test_reports(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 0)], "true_label int, predicted_label int")
    row = metrics.rates(metrics.confusion(rows)).first()
    text = reports.markdown(row, metrics.class_report(rows), "run", "note")
    assert "| attack   |    2 |    0.5000 | 0.5000 | 0.5000 |" in text and "note" in text and "| true / predicted | bonafide | attack |" in text
    assert reports.table(("a", "bb"), [("x", None), ("long", 0.5)]) == "a    |     bb\nx    |      -\nlong | 0.5000"
    assert len(reports.metric_table(row).splitlines()) == 1 + sum(name in row.asDict() for name, _ in reports.METRICS)
    assert json.loads(reports.as_json(row, "run"))["metrics"]["tp"] == 1
    with pytest.raises(ValueError, match="blank"):
        reports.summary(row, " ")
    stats = statistics.split_statistics(spark.createDataFrame([("a", "train", "morph", ["A", "B"])], "image_id string, split string, label string, identities array<string>"))
    assert "100.00%" in reports.console(stats)
