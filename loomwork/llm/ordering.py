"""Places of rows in their groups, whatever share of all rows one group holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomwork.session import materialise


def group_key(column: Column) -> Column:
    """A key without nulls that sorts null first and then bytewise: '' for null, else the value behind '='."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds _run, the place of each row in its run of equal _g within the sorted partition."""
    last, taken = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = batch.column(batch.schema.get_field_index("_g"))
        codes = groups.dictionary_encode().indices.to_numpy()
        starts = np.r_[True, codes[1:] != codes[:-1]]
        first = np.maximum.accumulate(np.where(starts, np.arange(len(codes)), 0))
        run = np.arange(len(codes)) - first
        if groups[0].as_py() == last:
            run[first == 0] += taken
        last, taken = groups[-1].as_py(), int(run[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run, pa.int64())], [*batch.schema.names, "_run"])


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with _i, the place (from 0) of each row in its group _g (a key without nulls) in ascending order, nulls first.

    All rows are sorted by ranges of (_g, order), so that a large group spreads over many partitions, and written
    once. Each partition counts its own runs; only the group that a partition continues needs what came before,
    which is one row a partition at most. Rows equal in order come in any order: name all columns that matter.

    rows must give the same rows each time it is read (a table, or a projection of one).
    """
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = spread.repartitionByRange("_g", *order, "_tie").sortWithinPartitions("_g", *order, "_tie").drop("_tie")
    placed = placed.withColumn("_pid", F.spark_partition_id())
    schema = StructType([*placed.schema.fields, StructField("_run", LongType())])
    table = materialise(placed.mapInArrow(_count_runs, schema), name)
    counts = table.groupBy("_pid", "_g").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("_g").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select("_pid", "_g", F.sum("_rows").over(earlier).alias("_before")).where("_before > 0")
    found = table.join(F.broadcast(carried), ["_pid", "_g"], "left")
    return found.select(*rows.columns, (F.col("_run") + F.coalesce("_before", F.lit(0))).alias("_i"))
