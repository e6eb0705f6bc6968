"""Experiment configuration: five sections of a YAML document, with defaults and checks. Driver side."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from types import MappingProxyType

import yaml

REQUIRED = object()

# The document's sections, keys and defaults.
SECTIONS = {
    "data": {
        "train_csv": REQUIRED, "val_csv": REQUIRED, "test_csv": REQUIRED, "image_root": REQUIRED, "image_size": 224, "batch_size": 32,
        "num_workers": 4, "pin_memory": True, "label_column": "label", "path_column": "image_path", "drop_last_train": False,
    },
    "model": {"backbone": "vit_b_16", "pretrained": True, "num_classes": 2, "freeze_backbone": False, "dropout": 0.1},
    "optimizer": {"name": "adamw", "lr": 3e-5, "weight_decay": 0.01, "betas": (0.9, 0.999), "momentum": 0.9},
    "scheduler": {
        "name": "cosine", "warmup_epochs": 2, "total_epochs": 30, "min_lr": 1e-7, "step_size": 10, "gamma": 0.1, "plateau_patience": 3, "plateau_factor": 0.5,
    },
    "training": {
        "epochs": 30, "loss_name": "cross_entropy", "use_class_weights": True, "mixed_precision": True, "grad_clip_norm": 1.0,
        "early_stopping_patience": 5, "early_stopping_metric": "val_eer", "early_stopping_mode": "min", "seed": 42, "checkpoint_dir": "checkpoints/vit",
        "log_dir": "logs/vit", "results_dir": "results/vit", "device": "auto", "log_every_n_steps": 50,
    },
}

_POSITIVE = lambda v: v > 0
_NOT_NEGATIVE = lambda v: v >= 0
CHECKS = {
    "data.image_size": _POSITIVE,
    "data.batch_size": _POSITIVE,
    "data.num_workers": _NOT_NEGATIVE,
    "model.num_classes": lambda v: v >= 2,
    "model.dropout": lambda v: 0 <= v < 1,
    "optimizer.name": lambda v: v in ("adam", "adamw", "sgd"),
    "optimizer.lr": _POSITIVE,
    "optimizer.weight_decay": _NOT_NEGATIVE,
    "scheduler.name": lambda v: v in ("cosine", "none", "plateau", "step"),
    "scheduler.warmup_epochs": _NOT_NEGATIVE,
    "scheduler.total_epochs": _POSITIVE,
    "scheduler.min_lr": _NOT_NEGATIVE,
    "training.epochs": _POSITIVE,
    "training.loss_name": lambda v: v in ("cross_entropy", "focal"),
    "training.early_stopping_patience": _NOT_NEGATIVE,
    "training.early_stopping_mode": lambda v: v in ("max", "min"),
    "training.grad_clip_norm": lambda v: v is None or v > 0,
    "training.device": lambda v: v in ("auto", "cpu", "cuda", "mps"),
    "training.log_every_n_steps": _POSITIVE,
}


class ConfigError(ValueError):
    """An experiment document that can't be used."""


def experiment(document: Mapping) -> Mapping:
    """The document with defaults filled in, read-only; ConfigError names the first thing that is wrong."""
    unknown = set(document) - set(SECTIONS) - {"experiment_name"}
    missing = set(SECTIONS) - set(document)
    if unknown or missing:
        raise ConfigError(f"unknown sections {sorted(unknown)}, missing sections {sorted(missing)}")
    out = {"experiment_name": document.get("experiment_name", "vit_morph_detection")}
    for section, defaults in SECTIONS.items():
        given = document[section] or {}
        if extra := set(given) - set(defaults):
            raise ConfigError(f"unknown keys in {section}: {sorted(extra)}")
        values = defaults | dict(given)
        if lacking := sorted(k for k, v in values.items() if v is REQUIRED):
            raise ConfigError(f"{section} lacks {lacking}")
        for key, value in values.items():
            check = CHECKS.get(f"{section}.{key}")
            try:
                good = check is None or check(value)
            except TypeError:
                good = False
            if not good:
                raise ConfigError(f"{section}.{key} can't be {value!r}")
        out[section] = MappingProxyType({k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
    if not str(out["experiment_name"]).strip():
        raise ConfigError("experiment_name is blank")
    if out["scheduler"]["warmup_epochs"] >= out["scheduler"]["total_epochs"]:
        raise ConfigError("warm-up must be shorter than the schedule")
    if out["scheduler"]["total_epochs"] != out["training"]["epochs"]:
        raise ConfigError("scheduler.total_epochs and training.epochs differ")
    return MappingProxyType(out)


def load(path: str) -> Mapping:
    return experiment(yaml.safe_load(Path(path).read_text()) or {})


def save(config: Mapping, path: str) -> None:
    plain = {k: {n: list(v) if isinstance(v, tuple) else v for n, v in s.items()} if isinstance(s, Mapping) else s for k, s in config.items()}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(plain, sort_keys=False))


def flattened(config: Mapping) -> dict[str, object]:
    """Dotted keys."""
    out = {}
    for key, value in config.items():
        out |= {f"{key}.{k}": v for k, v in value.items()} if isinstance(value, Mapping) else {key: value}
    return out


