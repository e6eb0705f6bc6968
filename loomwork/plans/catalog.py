"""Every registered query of the library proper, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.plans import curation, evaluation, files, imaging, morphing, series, training

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (evaluation, curation, series, imaging, morphing, files, training)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split statistics of a leakage-free split."""
    return curation.split_stats(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
