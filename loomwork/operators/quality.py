"""Data-quality checks over split assignments; each returns (check, severity, message, context).

Fixed values: names of checks, messages and context keys, which other tools read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomwork.session import materialise


def quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), value.cast("string"), F.lit("'"))


def _issues(rows: DataFrame, check: str, message: Column, **context: Column) -> DataFrame:
    pairs = [x for k, v in context.items() for x in (F.lit(k), v.cast("string"))]
    return rows.select(F.lit(check).alias("check"), F.lit("error").alias("severity"), message.alias("message"), F.create_map(*pairs).alias("context"))


#: Rows of all tables together that one task of a check holds, about.
TASK_ROWS = 500_000


def _dealt(tables: list[DataFrame], least: int) -> int:
    """Into how many parts tables are dealt for the checks: by their rows, as adaptive execution sizes tasks by compressed bytes, which are few for ids."""
    return max(least, -(-sum(t.count() for t in tables) // TASK_ROWS))


def _blank(value: str) -> Column:
    return F.col(value).isNull() | (F.col(value) == "")


def bucket_mismatch(assigned: DataFrame) -> DataFrame:
    """Rows stored in one split's bucket that declare another."""
    text = F.format_string("Assignment for image %s is stored in the %s bucket but declares split %s.", quoted(F.col("image_id")), quoted(F.col("bucket")), quoted(F.col("split")))
    wrong = assigned.where(~F.col("bucket").eqNullSafe(F.col("split")))
    return _issues(wrong, "csv_consistency", text, image_id=F.col("image_id"), bucket=F.col("bucket"), declared_split=F.col("split"))


def missing_metadata(assigned: DataFrame) -> DataFrame:
    """Rows without an image id, split, label or identity."""
    fields = ("image_id", "split", "label")
    empty = [F.when(_blank(f), F.lit(f)) for f in fields] + [F.when(F.col("identities").isNull() | (F.size("identities") == 0), F.lit("identities"))]
    found = assigned.withColumn("_missing", F.array_compact(F.array(*empty))).where(F.size("_missing") > 0)
    listed = F.concat(F.lit("['"), F.array_join("_missing", "', '"), F.lit("']"))
    name = quoted(F.when(_blank("image_id"), F.lit("<unknown>")).otherwise(F.col("image_id")))
    text = F.format_string("Assignment %s is missing required fields: %s.", name, listed)
    return _issues(found, "missing_metadata", text, image_id=F.col("image_id"), missing_fields=F.array_join("_missing", ","))


def invalid_labels(assigned: DataFrame, valid: tuple[str, ...] = ("bona_fide", "morph")) -> DataFrame:
    """Rows whose label is not a valid one."""
    wrong = assigned.where(~F.coalesce(F.col("label").isin(*valid), F.lit(False)))
    text = F.format_string(f"Assignment %s has invalid label %s; expected one of {sorted(valid)}.", quoted(F.col("image_id")), quoted(F.col("label")))
    return _issues(wrong, "invalid_label", text, image_id=F.col("image_id"), label=F.col("label"))


def duplicate_images(assigned: DataFrame) -> DataFrame:
    """Image ids found more than once, with their splits and how often each holds them.

    Rows are counted by (image, split) before they meet, and a split is named once, so that an id of any number of rows
    stays one short line.
    """
    counts = assigned.groupBy("image_id", "split").agg(F.count("*").alias("c"))
    found = counts.groupBy("image_id").agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.struct("split", "c"))).alias("each")).where("n > 1")
    splits = F.transform("each", lambda x: F.coalesce(x["split"], F.lit("None")))
    text = F.format_string("Image %s appears %d times across splits [%s].", quoted(F.col("image_id")), F.col("n"), F.concat(F.lit("'"), F.array_join(splits, "', '"), F.lit("'")))
    numbers = F.array_join(F.transform("each", lambda x: F.concat_ws(":", F.coalesce(x["split"], F.lit("None")), x["c"].cast("string"))), ",")
    return _issues(found, "duplicate_image", text, image_id=F.col("image_id"), splits=numbers)


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Keys seen in several splits; at most one value per split is kept of each key."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def identity_leakage(assigned: DataFrame) -> DataFrame:
    """Identities whose images lie in several splits."""
    return _identity_leakage(assigned.select(F.explode("identities").alias("identity"), "split"))


def _identity_leakage(seen: DataFrame) -> DataFrame:
    found = _spread(seen, "identity")
    listed = F.concat(F.lit("['"), F.array_join("splits", "', '"), F.lit("']"))
    return _issues(found, "identity_leakage", F.format_string("Identity %s leaks across splits %s.", quoted(F.col("identity")), listed), identity=F.col("identity"), splits=F.array_join("splits", ","))


def component_leakage(assigned: DataFrame, members: DataFrame) -> DataFrame:
    """Components (identity, component) whose identities' images lie in several splits."""
    return _component_leakage(assigned.select(F.explode("identities").alias("identity"), "split").distinct(), members)


def _component_leakage(seen: DataFrame, members: DataFrame) -> DataFrame:
    found = _spread(seen.join(members, "identity").select("component", "split"), "component")
    listed = F.concat(F.lit("['"), F.array_join("splits", "', '"), F.lit("']"))
    text = F.format_string("Connected component %s spans multiple splits: %s.", quoted(F.col("component")), listed)
    return _issues(found, "component_leakage", text, component=F.col("component"), splits=F.array_join("splits", ","))


def completeness(assigned: DataFrame, expected: DataFrame) -> DataFrame:
    """One issue per expected image id without an assignment, and per assigned id that was not expected."""
    have, want = assigned.select("image_id").distinct(), expected.select("image_id").distinct()
    sides = (
        (want.join(have, "image_id", "left_anti"), "Expected image %s is missing from the split result.", "missing_image_id"),
        (have.join(want, "image_id", "left_anti"), "Unexpected image %s appears in the split result.", "extra_image_id"),
    )
    found = [_issues(rows, "split_completeness", F.format_string(text, quoted(F.col("image_id"))), **{name: F.col("image_id")}) for rows, text, name in sides]
    return found[0].unionByName(found[1])


def missing_files(assigned: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Assigned images without a file; files(image_id) is a listing of root."""
    found = assigned.select("image_id").distinct().join(files.select("image_id").distinct(), "image_id", "left_anti")
    text = F.concat(F.lit("Image file for "), quoted(F.col("image_id")), F.lit(f" was not found under {root}."))
    return _issues(found, "missing_file", text, image_id=F.col("image_id"), expected_path=F.concat(F.lit(root.rstrip("/") + "/"), F.col("image_id")))


def verify(assigned: DataFrame, members: DataFrame | None = None, expected: DataFrame | None = None, files: DataFrame | None = None, root: str = "") -> DataFrame:
    """All checks that the given tables allow, as one table of issues; bucket defaults to the declared split.

    Tables are dealt by image id, and identities by theirs, once for all checks, into parts of a bounded number of rows.
    """
    rows = assigned if "bucket" in assigned.columns else assigned.withColumn("bucket", F.col("split"))
    rows = materialise(rows.select("image_id", "split", "label", "identities", "bucket"), "assigned")
    ids = [t.select("image_id") for t in (expected, files) if t is not None]
    parts = _dealt([rows, *ids], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = lambda t, key: t.repartition(parts, key)
    images = dealt(rows.select("image_id", "split"), "image_id")
    seen = dealt(rows.select(F.explode("identities").alias("identity"), "split"), "identity")
    found = [bucket_mismatch(rows), missing_metadata(rows), invalid_labels(rows), duplicate_images(images), _identity_leakage(seen)]
    if members is not None:
        found.append(_component_leakage(seen.distinct(), dealt(members, "identity")))
    if expected is not None:
        found.append(completeness(images, dealt(expected.select("image_id"), "image_id")))
    if files is not None:
        found.append(missing_files(images, dealt(files.select("image_id"), "image_id"), root))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def issues_for(issues: DataFrame, check: str) -> DataFrame:
    """The issues of one check."""
    return issues.where(F.col("check") == check)


def verdict(issues: DataFrame) -> DataFrame:
    """(passed, error_count, warning_count)."""
    errors = F.count_if(F.col("severity") == "error")
    return issues.agg((errors == 0).alias("passed"), errors.alias("error_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"))
