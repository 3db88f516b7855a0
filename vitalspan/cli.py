"""Command line: python -m vitalspan.cli <command> ..."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pyspark.sql import SparkSession

from vitalspan import config
from vitalspan.operators import quality, splits
from vitalspan.plans import cohort, conversion, matching, modelling, patients, reduction
from vitalspan.session import get_spark
from vitalspan.sources import sinks, tables

STAGES = ["stage1", "stage2", "stage3", "stage4", "stage5", "stage5_5", "stage6", "partition", "all"]


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vitalspan")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *required: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for flag in required:
            sub.add_argument(f"--{flag}", required=True)
        return sub

    sub = command("convert", "output", "rejects")
    sub.add_argument("inputs", nargs="+")
    sub.add_argument("--zip-member")
    sub.add_argument("--skip-existing", action="store_true")
    sub.add_argument("--preview", type=int, default=0)

    sub = command("reduce", "root", "salt")
    sub.add_argument("--stage", choices=STAGES, required=True)
    sub.add_argument("--input")
    sub.add_argument("--output")
    sub.add_argument("--cutoff-date", default=config.TIME_CUTOFF)
    sub.add_argument("--gap-minutes", type=float, default=config.SESSION_GAP_MINUTES)
    sub.add_argument("--preg-gap-days", type=float, default=config.EPISODE_GAP_DAYS)
    sub.add_argument("--last-hour-minutes", type=float, default=config.WINDOW_MINUTES)
    sub.add_argument("--dup-threshold", type=float, default=config.MAX_DUPLICATE_RATE)
    sub.add_argument("--min-fhr-seconds", type=int, default=config.MIN_POSITIVE_SECONDS)
    sub.add_argument("--bucket-count", type=int, default=config.PATIENT_BUCKETS)
    sub.add_argument("--bucket-index", type=int)

    sub = command("match", "registry-csv", "neonatal-file", "dated", "partitioned", "registry-out", "series-out")
    sub.add_argument("--unique-on", choices=["registry", "subject"], default="registry")

    sub = command("report", "registry-csv", "root")
    sub.add_argument("--gap-minutes", type=float, default=config.SESSION_GAP_MINUTES)
    sub.add_argument("--preg-gap-days", type=float, default=config.EPISODE_GAP_DAYS)

    sub = command("trace", "series", "output")
    sub.add_argument("--registry")
    sub.add_argument("--baby-id")
    sub.add_argument("--apgar", type=int)
    sub.add_argument("--seed", type=int, default=0)

    for name in ("make-splits", "baseline", "sequences", "multimodal"):
        sub = command(name, "config", "splits")
        if name != "make-splits":
            sub.add_argument("--output", required=True)

    sub = command("patients", "registry-csv", "raw", "output")
    sub.add_argument("--start", type=int, default=1)
    sub.add_argument("--limit", type=int)
    sub.add_argument("--sample-rate", type=int, choices=[1, 4], default=1)
    sub.add_argument("--downsample-mode", choices=["mean", "first"], default="mean")
    sub.add_argument("--min-data", type=float, default=0.5)
    return top


def _reduce(spark: SparkSession, args: argparse.Namespace) -> None:
    settings = config.ReductionSettings(
        salt=args.salt,
        gap_minutes=args.gap_minutes,
        episode_gap_days=args.preg_gap_days,
        window_minutes=args.last_hour_minutes,
        cutoff=args.cutoff_date,
        max_duplicate_rate=args.dup_threshold,
        min_positive_seconds=args.min_fhr_seconds,
    )
    stages = reduction.StagedReduction(spark, args.root, settings)
    if args.stage == "all":
        stages.run_all(args.input)
        return
    stage = "stage6" if args.stage == "partition" else args.stage
    extra = {}
    if stage == "stage3" and args.bucket_index is not None:
        extra["bucket"] = (args.bucket_count, args.bucket_index)
    getattr(stages, stage)(args.input, args.output, **extra)


def _model(spark: SparkSession, args: argparse.Namespace) -> None:
    settings = config.load_settings(args.config)
    made = modelling.load_splits(spark, settings, settings.paths["registry_csv"], args.splits)
    if args.command == "make-splits":
        splits.split_summary(made).show()
        return
    series = spark.read.parquet(settings.paths["ctg_parquet"])
    if args.command == "baseline":
        dataset = modelling.baseline_dataset(made, series)
        sinks.write_stage(dataset, f"{args.output}/baseline_dataset")
        model, report = modelling.run_baseline(spark.read.parquet(f"{args.output}/baseline_dataset"), settings.baseline)
        sinks.write_ordered_csv(report, f"{args.output}/baseline_metrics", ["split"])
        model.model.write().overwrite().save(f"{args.output}/baseline_model")
    elif args.command == "sequences":
        built = modelling.sequence_tables(series, made, settings)
        built.write.mode("overwrite").partitionBy("split").parquet(args.output)
    else:
        registry = quality.require_unique(tables.read_text_csv(spark, settings.paths["registry_csv"], ","), "BabyID")
        built = modelling.multimodal_tables(series, registry, made, settings)
        built.write.mode("overwrite").partitionBy("split").parquet(args.output)


def main(argv: Sequence[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    args = _parser().parse_args(argv)
    spark = get_spark()
    if args.command == "convert":
        if args.preview:
            conversion.preview(spark, args.inputs, args.preview).show(args.preview, truncate=False)
        done = conversion.convert(
            spark, args.inputs, args.output, args.rejects, args.zip_member, args.skip_existing
        )
        logging.info("converted %s", done)
    elif args.command == "reduce":
        _reduce(spark, args)
    elif args.command == "match":
        counts = matching.run_matching(
            spark, args.registry_csv, args.neonatal_file, args.dated, args.partitioned,
            args.registry_out, args.series_out, args.unique_on,
        )
        logging.info("matched %s", counts)
    elif args.command == "report":
        root = args.root.rstrip("/")
        stages = {name: f"{root}/{folder}" for name, folder in reduction.StagedReduction.FOLDERS.items()}
        report = cohort.cohort_report(spark, args.registry_csv, stages, args.gap_minutes, args.preg_gap_days)
        report.show(len(stages), truncate=False)
    elif args.command == "trace":
        series = spark.read.parquet(args.series)
        registry = tables.read_text_csv(spark, args.registry, ",") if args.registry else None
        chosen = args.baby_id or cohort.pick_subject(series, args.seed, registry, args.apgar).first()["BabyID"]
        sinks.write_stage(cohort.trace(series, chosen), args.output)
    elif args.command == "patients":
        raw = spark.read.parquet(args.raw)
        patients.process_patients(
            spark, args.registry_csv, raw, args.output, args.start, args.limit,
            args.sample_rate, args.downsample_mode, args.min_data,
        )
    else:
        _model(spark, args)


if __name__ == "__main__":
    main()
