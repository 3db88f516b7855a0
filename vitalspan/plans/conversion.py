"""Raw JSON exports to flat typed rows, with every refused item kept as a reject."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Sequence
from urllib.parse import quote
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from vitalspan.functions.dates import clock_text_to_timestamp
from vitalspan.operators.reports import worst_sources
from vitalspan.sources import concat_json, tables

log = logging.getLogger("vitalspan.conversion")

RATE_CHANNELS = ["Hr1", "Hr2", "Mhr"]
MODES = ["Hr1Mode", "Hr2Mode", "MhrMode", "TocoMode"]
SAMPLES = 4
SHORT_LOW, SHORT_HIGH = -32768, 32767
SUFFIXES = [".json", ".zip"]
WORST_INPUTS = 5
KEY_DIGITS = 12


def shared_folder(spark: SparkSession, fallback: str) -> str:
    """The folder all executors share: the session's checkpoint folder, else the given one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or fallback


def read_frames(spark: SparkSession, paths: Sequence[str], member: str | None = None, range_bytes: int | None = None) -> DataFrame:
    concat_json.register(spark)
    reader = spark.read.format(concat_json.NAME).option("paths", json.dumps(list(paths)))
    if member:
        reader = reader.option("member", member)
    if range_bytes:
        reader = reader.option("rangeBytes", str(range_bytes))
    return reader.load()


def misread_ranges(frames: DataFrame) -> DataFrame:
    """Ranges that did not start where the ranges before them ended."""
    ends = frames.where(F.col("kind").isin("start", "end")).groupBy("source", "range_id").agg(
        F.max(F.when(F.col("kind") == "start", F.col("text"))).alias("path"),
        F.max(F.when(F.col("kind") == "start", F.col("byte_offset"))).alias("started"),
        F.max(F.when(F.col("kind") == "end", F.col("byte_offset"))).alias("ended"),
    )
    before = Window.partitionBy("source").orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    checked = ends.withColumn("reached", F.max("ended").over(before))
    return checked.where((F.col("started") >= 0) & (F.col("started") != F.col("reached")))


def materialise_frames(
    spark: SparkSession, paths: Sequence[str], folder: str, member: str | None = None, range_bytes: int | None = None
) -> DataFrame:
    """Frame all files once into a written table; read wrongly started ranges again.

    A range starts wrongly only when a text value holds an object boundary right where the
    file was cut.  Such a range is read again from where the one before it ended, until all
    ranges of a file join up.
    """
    root = f"{folder.rstrip('/')}/frames_{uuid4().hex}"
    width = range_bytes or concat_json.RANGE_BYTES
    read_frames(spark, paths, member, width).write.parquet(f"{root}/round_0")
    frames = spark.read.parquet(f"{root}/round_0")
    turn = 0
    while wrong := misread_ranges(frames).select("source", "range_id", "path", "reached").collect():
        turn += 1
        sizes = {p: concat_json.stored_size(p) for p in {r["path"] for r in wrong}}
        fixed = []
        for r in wrong:
            end = (r["range_id"] + 1) * width
            fixed.append([r["path"], None, r["range_id"], r["reached"], end if end < sizes[r["path"]] else None, True])
        reader = spark.read.format(concat_json.NAME).option("paths", "[]").option("ranges", json.dumps(fixed))
        reader.load().write.parquet(f"{root}/again_{turn}")
        again = spark.read.parquet(f"{root}/again_{turn}")
        # The repaired ranges stand beside the first reading; only their keys are compared.
        replaced = again.select("source", "range_id").distinct()
        frames = frames.join(replaced, ["source", "range_id"], "left_anti").unionByName(again)
    return frames


def numbered_objects(frames: DataFrame) -> DataFrame:
    """Objects with their 1-based number in the file."""
    counts = frames.where(F.col("kind") == "object").groupBy("source", "range_id").agg(F.max("item").alias("_n"))
    before = Window.partitionBy("source").orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "range_id", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    objects = frames.where(F.col("kind") == "object").join(offsets, ["source", "range_id"])
    return objects.select("source", (F.col("_offset") + F.col("item")).alias("record_index"), "text")


def _kind(document: Column, path: str) -> Column:
    """Type name at a path, ``VOID`` for null and for a missing entry."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(document, path, "variant")), F.lit("VOID"))


def _whole(number: Column) -> Column:
    return number.isNotNull() & (number == F.floor(number))


def _whole_number(document: Column, path: str) -> Column:
    """Whole number given as a number, a flag or digits."""
    kind = _kind(document, path)
    number = F.try_variant_get(document, path, "decimal(38,6)")
    digits = F.try_variant_get(document, path, "string").rlike(r"^\s*[+-]?[0-9]+(\.0*)?\s*$")
    allowed = (kind != "STRING") | digits
    return F.when(allowed & _whole(number), number)


def parsed_records(objects: DataFrame) -> DataFrame:
    """Typed fields of each object plus the list of problems found in it.

    Text, document, typed fields and problems are computed once each: every level refers to
    columns of the one below, and the problems leave through a generator of one row, since a
    filter on them would else be pushed below all levels with the whole parse inside.
    """
    doc = F.col("_doc")
    fields: dict[str, Column] = {
        "PatientID": F.try_variant_get(doc, "$.PatientID", "string"),
        "RegistrationID": _whole_number(doc, "$.RegistrationID").try_cast("bigint"),
        "Timestamp": clock_text_to_timestamp(F.try_variant_get(doc, "$.Timestamp", "string")),
        **{m: F.try_variant_get(doc, f"$.{m}", "string") for m in MODES},
        "Toco_Values": F.try_variant_get(doc, "$.Toco.Values", "string"),
    }
    kinds = {name: _kind(doc, f"$.{name}") for name in ["PatientID", "Timestamp", *MODES, "Toco", "Toco.Values"]}

    def kind(name: str) -> Column:
        return F.col(f"`_kind_{name}`")

    def text_or_missing(name: str) -> Column:
        return kind(name).isin("STRING", "VOID")

    def object_or_missing(name: str) -> Column:
        return kind(name).startswith("OBJECT") | (kind(name) == "VOID")

    problems: dict[str, Column] = {
        "PatientID": kind("PatientID") != "STRING",
        "RegistrationID": F.col("RegistrationID").isNull(),
        "Timestamp": (kind("Timestamp") != "STRING") | F.col("Timestamp").isNull(),
        **{m: ~text_or_missing(m) for m in MODES},
    }
    for channel in RATE_CHANNELS:
        values, signal = f"$.{channel}.Values", f"{channel}.SignalQuality"
        fields[f"_{channel}"] = F.try_variant_get(doc, values, "array<decimal(38,6)>")
        fields[f"{channel}_SignalQuality"] = F.try_variant_get(doc, f"$.{signal}", "string")
        fields[f"_present_{channel}"] = F.try_variant_get(doc, values, "variant").isNotNull()
        kinds |= {channel: _kind(doc, f"$.{channel}"), signal: _kind(doc, f"$.{signal}")}
        given = F.col(f"_{channel}")
        readable = F.coalesce(F.forall(given, _whole), F.lit(False))
        fits = F.forall(F.slice(F.coalesce(given, F.array().cast("array<decimal(38,6)>")), 1, SAMPLES),
                        lambda x: x.isNull() | x.between(SHORT_LOW, SHORT_HIGH))
        problems[f"{channel}.Values"] = F.col(f"_present_{channel}") & ~readable
        problems[f"{channel}.Values range"] = ~fits
        problems[channel] = ~object_or_missing(channel)
        problems[signal] = ~text_or_missing(signal)
    problems["Toco"] = ~object_or_missing("Toco")
    problems["Toco.Values"] = kind("Toco").startswith("OBJECT") & (kind("Toco.Values") != "STRING")
    staged = objects.withColumn("_doc", F.try_parse_json("text"))
    helpers = [c.alias(f"_kind_{n}") for n, c in kinds.items()]
    typed = staged.select("source", "record_index", "_doc", *[c.alias(n) for n, c in fields.items()], *helpers)
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(n)) for n, bad in problems.items()]))
    kept = ["source", "record_index", "_doc", *[n for n in fields if not n.startswith("_present_")]]
    listed = typed.select(*kept, found.alias("_found"))
    return listed.select(*kept, F.explode(F.array("_found")).alias("problems"))


def flat_layout(parsed: DataFrame) -> DataFrame:
    """Every record in the flat layout with its number and problems: four samples per channel, extra ones dropped."""

    def samples(channel: str) -> list[Column]:
        cells = [F.get(F.col(f"_{channel}"), F.lit(i)).try_cast("smallint").alias(f"{channel}_{i}") for i in range(SAMPLES)]
        return [*cells, F.col(f"{channel}_SignalQuality")]

    channels = [c for channel in RATE_CHANNELS for c in samples(channel)]
    return parsed.select(
        "source", "record_index", "problems", "PatientID", "RegistrationID", "Timestamp", *MODES, "Toco_Values", *channels
    )


def flat_rows(layout: DataFrame) -> DataFrame:
    """The valid records of a flat layout."""
    return layout.where(F.size("problems") == 0).drop("record_index", "problems")


def rejects(frames: DataFrame, parsed: DataFrame) -> DataFrame:
    """Unreadable spans by byte offset and invalid records by number."""
    unreadable = frames.where(F.col("kind") == "parse").select(
        "source",
        F.lit("parse").alias("error_type"),
        F.concat(F.lit("byte offset "), F.col("byte_offset").cast("string")).alias("location"),
        F.trim(F.regexp_replace("text", r"\s+", " ")).alias("message"),
    )
    invalid = parsed.where(F.size("problems") > 0).select(
        "source",
        F.lit("validation").alias("error_type"),
        F.concat(F.lit("record index "), F.col("record_index").cast("string")).alias("location"),
        F.concat(F.lit("invalid "), F.array_join("problems", ", ")).alias("message"),
    )
    return unreadable.unionByName(invalid)


def preview(spark: SparkSession, patterns: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` valid rows of all matching inputs."""
    frames = read_frames(spark, _inputs(spark, patterns))
    objects = frames.where(F.col("kind") == "object").select("source", F.col("item").alias("record_index"), "text")
    return flat_rows(flat_layout(parsed_records(objects))).limit(n)


def _inputs(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Matching files of all patterns, each once."""
    return sorted({p for pattern in patterns for p in tables.matching_files(spark, pattern, SUFFIXES)})


def input_key(path: str) -> str:
    """Name of an input's partitions: its file name, told apart by a digest of its path."""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return f"{stem}-{hashlib.sha256(path.encode()).hexdigest()[:KEY_DIGITS]}"


def _input_key(source: Column) -> Column:
    """The same key from the source of a row, which names the archive member as well."""
    path = F.regexp_replace(source, r"(?i)(\.zip)::.*$", "$1")
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.concat(stem, F.lit("-"), F.substring(F.sha2(path, 256), 1, KEY_DIGITS))


def _write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions that get rows, when the whole write commits."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        .partitionBy(by).parquet(path)
    )


def convert(
    spark: SparkSession,
    patterns: Sequence[str],
    output: str,
    rejects_output: str,
    member: str | None = None,
    skip_existing: bool = False,
    range_bytes: int | None = None,
) -> dict[str, int]:
    """Convert all matching inputs in one job, one output partition per input.

    Rejects are written before rows, both by input, and an input counts as done only by a
    marker written last.  An interrupted run or an input without valid records leaves
    earlier rows as they were; rejects of other inputs stay.  Rows are not shuffled: a task
    writes the partitions of the ranges that it read.  The working tables (frames and parsed
    records) are removed at the end.
    """
    paths = _inputs(spark, patterns)
    done = f"{output.rstrip('/')}/_inputs"
    if skip_existing:
        paths = [p for p in paths if not tables.path_exists(spark, f"{done}/input={quote(input_key(p))}")]
    if not paths:
        return {"inputs": 0, "rows": 0, "rejects": 0}
    work = f"{shared_folder(spark, f'{output}_work').rstrip('/')}/conversion_{uuid4().hex}"
    try:
        frames = materialise_frames(spark, paths, work, member, range_bytes)
        # Each text is parsed once: rows, rejects and totals come from this table.
        flat_layout(parsed_records(numbered_objects(frames))).write.option("compression", "zstd").parquet(f"{work}/layout")
        layout = spark.read.parquet(f"{work}/layout")
        rows_seen, rejects_seen = Observation(), Observation()
        refused = rejects(frames, layout).withColumn("input", _input_key(F.col("source")))
        _write_partitions(refused.observe(rejects_seen, F.count(F.lit(1)).alias("n")), rejects_output, "input")
        rows = flat_rows(layout).withColumn("source", _input_key(F.col("source")))
        _write_partitions(rows.observe(rows_seen, F.count(F.lit(1)).alias("n")), output, "source")
        known = spark.createDataFrame([(input_key(p), p) for p in paths], "input string, path string")
        _drop_old_rejects(spark, rejects_output, known, refused)
        _write_partitions(known, done, "input")
        found = {"inputs": len(paths), "rows": rows_seen.get["n"], "rejects": rejects_seen.get["n"]}
        log_problems(frames, refused, found["rejects"])
        return found
    finally:
        tables.remove_folder(spark, work)


def _drop_old_rejects(spark: SparkSession, rejects_output: str, known: DataFrame, refused: DataFrame) -> None:
    """Remove the rejects of an earlier run of inputs that have none any more."""
    clean = known.join(refused.select("input").distinct(), "input", "left_anti")
    for r in clean.select("input").collect():  # at most one per input of this run
        tables.remove_folder(spark, f"{rejects_output.rstrip('/')}/input={quote(r['input'])}")


def log_problems(frames: DataFrame, refused: DataFrame, total: int) -> None:
    """Totals and the worst inputs; every reject stays in the table."""
    skipped = frames.where(F.col("kind") == "other").count()
    if skipped:
        log.warning("%s values that are not objects were skipped", f"{skipped:,}")
    if not total:
        return
    log.warning("%s conversion failures", f"{total:,}")
    for r in worst_sources(refused, WORST_INPUTS).collect():
        log.warning("  %s: %s failures", r["source"], f"{r['n_failures']:,}")
