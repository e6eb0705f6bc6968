"""Functions for SQL text: kernels by name and detections as rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from loomwork.functions.kernels import Registry, rng_for


def kernel_function(name: str, registry: Registry):
    """A pandas UDF (path, height, width, data, parameters) -> data of one kernel; parameters that are missing are drawn by path.

    Null where the pixels are missing or don't have the given size.
    """
    kernel = registry.get(name)

    def run(path: pd.Series, height: pd.Series, width: pd.Series, data: pd.Series, parameters: pd.Series) -> pd.Series:
        out = []
        for key, h, w, pixels, given in zip(path, height, width, data, parameters, strict=True):
            if pixels is None or pd.isna(h) or pd.isna(w) or len(pixels) != int(h) * int(w) * 3 or not len(pixels):
                out.append(None)
                continue
            rng = rng_for(0, key or "", name)
            drawn = kernel.draw(rng) | dict(given or {})
            image = np.frombuffer(pixels, np.uint8).reshape(int(h), int(w), 3)
            out.append(np.ascontiguousarray(kernel.apply(image, drawn, rng), np.uint8).tobytes())
        return pd.Series(out, dtype=object)

    return pandas_udf(run, "binary")


@udtf(returnType="name string, score double, x1 int, y1 int, x2 int, y2 int")
class DetectionRows:
    """Faces of a detector's map as rows, those that reach the threshold."""

    def eval(self, detections: dict, threshold: float):
        for name, face in (detections or {}).items():
            if face["score"] is not None and face["score"] >= threshold:
                yield name, float(face["score"]), *map(int, face["facial_area"])


def register(spark: SparkSession, registry: Registry | None = None) -> list[str]:
    """Make kernel_{name} of every kernel and the table function detection_rows known to SQL; returns their names."""
    registry = registry or Registry()
    names = [f"kernel_{name}" for name in registry.names()]
    for name in registry.names():
        spark.udf.register(f"kernel_{name}", kernel_function(name, registry))
    spark.udtf.register("detection_rows", DetectionRows)
    return [*names, "detection_rows"]
