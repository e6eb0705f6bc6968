"""Commands over folders and tables: split, inspect, augment, align, morph, train, evaluate, predict. Exit codes say what went wrong."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwork import reports, results
from loomwork.functions import chain, metrics, paths
from loomwork.operators import faces, model, morphs, quality, split, statistics, visual
from loomwork.session import build_session, materialise
from loomwork.sources import scans, sinks

DONE, FAILED, BAD_ARGUMENTS, NO_PATH, NOT_VERIFIED, BAD_CONFIG = range(6)
INTERRUPTED = 130


def run_split(spark: SparkSession, args: argparse.Namespace) -> int:
    """Split manifests from a metadata document; statistics and verification on demand."""
    try:
        ratios = split.SplitRatios(args.train_ratio, args.val_ratio, args.test_ratio)
    except ValueError as error:
        print(error, file=sys.stderr)
        return BAD_CONFIG
    bona_fide, morphs = scans.split_metadata(spark, args.metadata)
    assigned, placed = split.split_dataset(bona_fide, morphs, ratios, args.seed, args.exact_shuffle)
    sinks.split_manifests(split.check_disjoint(assigned, placed), args.output)
    if args.files:
        sinks.manifest_files(assigned, args.output)
    if args.statistics:
        stats = statistics.split_statistics(assigned)
        print(reports.console(stats))
        sinks.document(stats, f"{args.output}/statistics.json")
        sinks.statistics_table(stats, f"{args.output}/statistics")
    if args.verify:
        expected = bona_fide.select("image_id").unionByName(morphs.select("image_id"))
        files = scans.image_files(spark, args.input, content=False).select(F.col("relative").alias("image_id")) if args.input else None
        issues = quality.verify(assigned, placed.select("identity", "component"), expected, files, args.input or "")
        if not quality.verdict(issues).first()["passed"]:
            sinks.summary(issues, f"{args.output}/issues")
            return NOT_VERIFIED
    return DONE


def run_inspect(spark: SparkSession, args: argparse.Namespace) -> int:
    """Inventory of every root's identity folders; with --discover, of the datasets right below each root."""
    images: DataFrame | None = None
    folders: DataFrame | None = None
    for root in [r for given in args.roots for r in (scans.dataset_roots(spark, given) if args.discover else [given])]:
        found, named = scans.image_inventory(spark, root), scans.identity_folders(spark, root)
        images, folders = (found, named) if images is None else (images.unionByName(found), folders.unionByName(named))
    inventory = statistics.identity_inventory(images, folders)
    sinks.report(inventory.orderBy("dataset_root", "identity"), f"{args.output}/identities")
    sinks.document(statistics.inventory_summary(inventory), f"{args.output}/summary.json")
    return DONE


def run_augment(spark: SparkSession, args: argparse.Namespace) -> int:
    """Chains of kernels over a Parquet table of decoded images."""
    names = [n for n in (args.operators or "").split(",") if n] or None
    try:
        done = chain.augment(spark.read.parquet(args.input), names, seed=args.seed, probability=args.probability, copies=args.copies)
    except ValueError as error:
        print(f"bad arguments: {error}", file=sys.stderr)
        return BAD_ARGUMENTS
    if not args.dry_run:
        done.write.mode("overwrite").parquet(args.output)
        done = spark.read.parquet(args.output)
        if args.images:
            named = paths.augmented_name(F.col("path"), F.col("applied"), F.lit(".png"))
            copied = F.when(F.col("copy") > 0, F.concat(F.lit("copy_"), F.col("copy"), F.lit("/"), named)).otherwise(named)
            sinks.report(sinks.image_files(done.withColumn("path", copied), args.images), f"{args.images.rstrip('/')}/written")
    statistics.run_summary(done.select(F.when(F.col("error").isNull(), "processed").otherwise("failed").alias("status"))).show()
    return DONE


def run_align(spark: SparkSession, args: argparse.Namespace) -> int:
    """Upright face crops of a Parquet table of decoded images with detections; crops that exist are not made again."""
    images = spark.read.parquet(args.input)
    try:
        made = spark.read.parquet(args.output).where("success").select("path")
        images = images.join(made, "path", "left_anti")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    before = images.count()
    faces.crop_faces(images, size=args.size, threshold=args.threshold, margin=args.margin).write.mode("append").parquet(args.output)
    if args.images:
        crops = spark.read.parquet(args.output).where("success").withColumns({"height": F.lit(args.size), "width": F.lit(args.size), "path": F.regexp_replace("path", "[.][^./]+$", "")})
        sinks.report(sinks.image_files(crops, args.images), f"{args.images.rstrip('/')}/written")
    print(f"{before} images aligned")
    return DONE


def run_morph(spark: SparkSession, args: argparse.Namespace) -> int:
    """Blends of a Parquet table of image pairs with landmarks."""
    if not 0 <= args.alpha <= 1:
        print("alpha must be between 0 and 1", file=sys.stderr)
        return BAD_ARGUMENTS
    pairs = spark.read.parquet(args.input)
    morphs.morph(pairs, args.alpha).write.mode("overwrite").parquet(args.output)
    done = spark.read.parquet(args.output)
    if args.images:
        sized = done.join(pairs.select("name", "height", "width"), "name").withColumnRenamed("name", "path")
        sinks.report(sinks.image_files(sized, args.images), f"{args.images.rstrip('/')}/written")
    statistics.run_summary(done.select(F.when(F.col("error").isNull(), "processed").otherwise("failed").alias("status"))).show()
    return DONE


def run_predict(spark: SparkSession, args: argparse.Namespace) -> int:
    """Probabilities and labels by a saved model: of a Parquet table of embeddings, or of the images in a folder.

    A folder gives one CSV file, and a second one named .failed.csv if there are images that can't be read.
    """
    if (args.input is None) == (args.images is None):
        print("name either --input or --images", file=sys.stderr)
        return BAD_ARGUMENTS
    scorer = model.load(args.model)
    if args.images:
        done, failed = visual.predictions(scorer, materialise(visual.folder_vectors(spark, args.images, args.size, args.recursive), "image-vectors"), args.threshold)
        sinks.csv_file(done, args.output, ["image_path"])
        if not failed.isEmpty():
            sinks.csv_file(failed, f"{args.output.removesuffix('.csv')}.failed.csv", ["image_path"])
        return DONE
    scored = model.predict(scorer, spark.read.parquet(args.input), args.vector, args.threshold)
    sinks.report(scored.select(args.key, "predicted_label", F.col("probability").alias("probability_attack"), (1.0 - F.col("probability")).alias("probability_bona_fide")).orderBy(args.key), args.output)
    return DONE


def run_evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Metrics, curves, errors and a report from a Parquet table of predictions (index, true_label, score)."""
    row = results.export(spark.read.parquet(args.input), args.output, args.name, args.threshold, args.margin, args.top, args.notes)
    print(reports.metric_table(row))
    return DONE


def run_train(spark: SparkSession, args: argparse.Namespace) -> int:
    """A classifier saved with its history and, with --validation, its metrics.

    Its rows are Parquet tables of labelled embeddings, or with --images manifests of images below that folder.
    """

    def labelled(path: str, flip_share: float = 0.0) -> DataFrame:
        if args.images is None:
            return spark.read.parquet(path)
        rows = visual.manifest_vectors(spark, path, args.images, args.size, label_col=args.label, flip_share=flip_share)
        return materialise(rows.where("embedding IS NOT NULL"), "image-vectors")

    rows = labelled(args.input, args.flip_share)
    made = model.train(rows, args.vector, args.label, not args.unweighted, args.epochs, args.decay)
    known = {}
    if args.validation:
        held = model.predict(made, labelled(args.validation), args.vector)
        checked = metrics.check_filled(held.select(F.col(args.label).cast("int").alias("true_label"), F.col("probability").alias("score"), "predicted_label"))
        row = results.evaluate(metrics.check_labels(checked))[0].first()
        known = {k: v for k, v in row.asDict().items() if isinstance(v, float)}
        print(reports.metric_table(row))
    model.save_epoch(made, args.output, args.epochs, known)
    sinks.report(model.history(spark, made), f"{args.output}/history")
    return DONE


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="loomwork")
    commands = out.add_subparsers(dest="command", required=True)
    s = commands.add_parser("split")
    s.add_argument("--input")
    s.add_argument("--metadata", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--seed", type=int, default=42)
    s.add_argument("--files", action="store_true", help="also write train.csv, validation.csv and test.csv")
    s.add_argument("--exact-shuffle", action="store_true", help="order components as Python's seeded shuffle does")
    for name, share in (("train", 0.8), ("val", 0.1), ("test", 0.1)):
        s.add_argument(f"--{name}-ratio", type=float, default=share)
    s.add_argument("--verify", action="store_true")
    s.add_argument("--statistics", action="store_true")
    s.set_defaults(run=run_split)
    i = commands.add_parser("inspect")
    i.add_argument("roots", nargs="+")
    i.add_argument("--output", required=True)
    i.add_argument("--discover", action="store_true")
    i.set_defaults(run=run_inspect)
    a = commands.add_parser("augment")
    a.add_argument("--input", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--images", help="a folder for PNG files under mirrored paths")
    a.add_argument("--operators")
    a.add_argument("--seed", type=int, default=0)
    a.add_argument("--probability", type=float, default=0.5)
    a.add_argument("--copies", type=int, default=1)
    a.add_argument("--dry-run", action="store_true")
    a.set_defaults(run=run_augment)
    e = commands.add_parser("evaluate")
    e.add_argument("--input", required=True)
    e.add_argument("--output", required=True)
    e.add_argument("--threshold", type=float, default=0.5)
    e.add_argument("--top", type=int, default=10)
    e.add_argument("--margin", type=float, default=0.1)
    e.add_argument("--name", default="evaluation")
    e.add_argument("--notes", default="")
    e.set_defaults(run=run_evaluate)
    c = commands.add_parser("align")
    c.add_argument("--input", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--images", help="a folder for PNG files under mirrored paths")
    c.add_argument("--size", type=int, default=224)
    c.add_argument("--threshold", type=float, default=0.9)
    c.add_argument("--margin", type=float, default=0.3)
    c.set_defaults(run=run_align)
    m = commands.add_parser("morph")
    m.add_argument("--input", required=True)
    m.add_argument("--output", required=True)
    m.add_argument("--images", help="a folder for PNG files under mirrored paths")
    m.add_argument("--alpha", type=float, default=0.5)
    m.set_defaults(run=run_morph)
    p = commands.add_parser("predict")
    p.add_argument("--input")
    p.add_argument("--images", help="a folder of images instead of a table of embeddings")
    p.add_argument("--size", type=int, default=32, help="the images' size that the model was trained at")
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--model", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--key", default="vec_id")
    p.add_argument("--vector", default="embedding")
    p.add_argument("--threshold", type=float, default=0.5)
    p.set_defaults(run=run_predict)
    t = commands.add_parser("train")
    t.add_argument("--input", required=True)
    t.add_argument("--output", required=True)
    t.add_argument("--validation")
    t.add_argument("--images", help="a folder; --input and --validation are manifests of images below it then")
    t.add_argument("--size", type=int, default=32)
    t.add_argument("--flip-share", type=float, default=0.0, help="share of the training images that are mirrored")
    t.add_argument("--vector", default="embedding")
    t.add_argument("--label", default="label")
    t.add_argument("--epochs", type=int, default=30)
    t.add_argument("--decay", type=float, default=1e-4)
    t.add_argument("--unweighted", action="store_true")
    t.set_defaults(run=run_train)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 done, 1 failed, 2 bad arguments, 3 a path is missing, 4 verification failed, 5 bad configuration, 130 interrupted."""
    try:
        args = parser().parse_args(argv)
    except SystemExit as end:
        return int(end.code or 0)
    try:
        return args.run(spark or build_session(), args)
    except KeyboardInterrupt:
        return INTERRUPTED
    except (NotADirectoryError, FileNotFoundError) as error:
        print(f"no such folder: {error}", file=sys.stderr)
        return NO_PATH
    except AnalysisException as error:
        print(error, file=sys.stderr)
        return NO_PATH if error.getCondition() == "PATH_NOT_FOUND" else FAILED
    except Exception as error:  # the command line answers with a code, not a trace
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
