"""Queries on labels, splits, metrics, sequences, encoders, targets and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.catalog.base import DAY, as_double, query, six, table
from vitalspan.config import SplitSettings
from vitalspan.functions.keys import hex_prefix, stable_order
from vitalspan.functions.signal import level_flag, zero_as_missing
from vitalspan.operators import evaluation, metrics, reports, sequences, splits, tabular
from vitalspan.operators.cells import position_in_group


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    return rows.select("doc_id", F.col("quality").cast("int").alias("target"))


@query(
    "labels_target",
    "SELECT c_custkey, CASE WHEN c_nationkey <= 6 THEN 1 ELSE 0 END AS target FROM customer",
)
def labels_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return splits.labels(rows, 6, "c_custkey", "c_nationkey").select("c_custkey", "target")


@query(
    "label_summary",
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE c_nationkey > 6) AS n_healthy,
        count(*) FILTER (WHERE c_nationkey <= 6) AS n_at_risk,
        round(100.0 * count(*) FILTER (WHERE c_nationkey <= 6) / count(*), 6) AS at_risk_pct FROM customer""",
)
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = splits.label_summary(splits.labels(table(spark, sf_dir, "customer"), 6, "c_custkey", "c_nationkey"))
    return found.select("n_rows", "n_healthy", "n_at_risk", six(F.col("at_risk_pct"), "at_risk_pct"))


SPLIT_SQL = """
placed AS (
    SELECT doc_id, CAST(quality AS INTEGER) AS target,
           row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || CAST(doc_id AS VARCHAR))) AS place,
           count(*) OVER (PARTITION BY quality) AS size
    FROM labels),
splits AS (
    SELECT doc_id, target, CASE WHEN place <= floor(size * 0.70 + 0.5) THEN 'train'
        WHEN place <= floor(size * (0.70 + 0.15) + 0.5) THEN 'val' ELSE 'test' END AS split
    FROM placed)"""


@query("stratified_split", f"WITH {SPLIT_SQL} SELECT doc_id, target, split FROM splits")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(quality_labels(spark, sf_dir), SplitSettings(), "doc_id")


@query(
    "split_summary",
    f"""WITH {SPLIT_SQL} SELECT split, count(*) AS n_rows, CAST(sum(target) AS BIGINT) AS n_positive,
        round(100.0 * sum(target) / count(*), 6) AS positive_pct FROM splits GROUP BY 1""",
)
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = splits.split_summary(stratified_split(spark, sf_dir))
    return found.select("split", "n_rows", "n_positive", six(F.col("positive_pct"), "positive_pct"))


@query(
    "random_pick",
    """SELECT user_id FROM (SELECT DISTINCT user_id FROM events)
    ORDER BY md5('7|' || CAST(user_id AS VARCHAR)) LIMIT 1""",
)
def random_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "events").select("user_id").distinct()
    return keys.orderBy(stable_order(F.col("user_id"), 7)).limit(1)


@query(
    "trace_lookup",
    """SELECT ts, value FROM events WHERE user_id = (
        SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5('7|' || CAST(user_id AS VARCHAR)) LIMIT 1)""",
)
def trace_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    chosen = random_pick(spark, sf_dir)
    return rows.join(chosen, "user_id", "left_semi").select("ts", "value").orderBy("ts")


@query(
    "position_in_group",
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('5|' || CAST(o_orderkey AS VARCHAR))) AS position
    FROM orders""",
)
def position_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    ordered = rows.withColumn("shuffled", stable_order(F.col("o_orderkey"), 5))
    placed = position_in_group(ordered, ["o_orderstatus"], hex_prefix(F.col("shuffled")), [F.col("shuffled")])
    return placed.select("o_orderkey", "position")


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("n_chars") / (F.col("n_chars") + 1500.0)).alias("score")
    )
    return quality_labels(spark, sf_dir).join(docs, "doc_id")


SCORED_SQL = """
scored AS (SELECT CAST(quality AS INTEGER) AS target, n_chars / (n_chars + 1500.0::DOUBLE) AS score
           FROM labels JOIN documents USING (doc_id))"""
LINE_SCORES_SQL = """
scored AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target, l_extendedprice / 110000 AS score, l_linestatus AS task
           FROM lineitem)"""


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("target"),
        (F.col("l_extendedprice") / 110000).alias("score"),
        F.col("l_linestatus").alias("task"),
    )


def _area_sql(group: str = "") -> str:
    by = f"PARTITION BY {group} " if group else ""
    keys = f"{group}, " if group else ""
    tail = f"GROUP BY {group}" if group else ""
    return f"""
levels AS (SELECT {keys}score, CAST(sum(target) AS DOUBLE) AS pos, CAST(sum(1 - target) AS DOUBLE) AS neg FROM scored GROUP BY {keys}score),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER ({by}) AS p, sum(neg) OVER ({by}) AS n
        FROM levels WINDOW w AS ({by}ORDER BY score DESC)),
areas AS (SELECT {keys}round(sum(neg * (tp - pos / 2)) / (any_value(p) * any_value(n)), 6) AS roc_auc,
                 round(sum(pos / p * tp / (tp + fp)), 6) AS pr_auc FROM cum {tail})"""


@query("roc_auc", f"WITH {SCORED_SQL}, {_area_sql()} SELECT roc_auc FROM areas")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.binary_metrics(scored_labels(spark, sf_dir), "target", "score")
    return found.select(six(F.col("roc_auc"), "roc_auc"))


@query("avg_precision", f"WITH {SCORED_SQL}, {_area_sql()} SELECT pr_auc FROM areas")
def avg_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.binary_metrics(scored_labels(spark, sf_dir), "target", "score")
    return found.select(six(F.col("pr_auc"), "pr_auc"))


@query("areas_per_task", f"WITH {LINE_SCORES_SQL}, {_area_sql('task')} SELECT task, roc_auc, pr_auc FROM areas")
def areas_per_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.binary_metrics(scored_lines(spark, sf_dir), "target", "score", group=["task"])
    return found.select("task", six(F.col("roc_auc"), "roc_auc"), six(F.col("pr_auc"), "pr_auc"))


@query(
    "confusion_at_threshold",
    f"""WITH {SCORED_SQL}, c AS (SELECT
        count(*) FILTER (WHERE score >= 0.55 AND target = 1) AS tp, count(*) FILTER (WHERE score >= 0.55 AND target = 0) AS fp,
        count(*) FILTER (WHERE score < 0.55 AND target = 1) AS fn, count(*) FILTER (WHERE score < 0.55 AND target = 0) AS tn FROM scored)
    SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
           round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
)
def confusion_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.binary_metrics(scored_labels(spark, sf_dir), "target", "score", threshold=0.55)
    return found.select("tp", "fp", "fn", "tn", *[six(F.col(c), c) for c in ("precision", "recall", "f1")])


def _best_sql(points: str) -> str:
    return f"""
levels AS (SELECT score, sum(target) AS pos, count(*) AS n FROM scored GROUP BY 1),
points AS ({points}),
tried AS (SELECT t, sum(CASE WHEN score >= t THEN pos ELSE 0 END) AS tp, sum(CASE WHEN score >= t THEN n ELSE 0 END) AS called, sum(pos) AS p
          FROM levels CROSS JOIN points GROUP BY t)
SELECT round(t, 6) AS threshold, round(2.0 * tp / (called + p), 6) AS f1 FROM tried ORDER BY 2.0 * tp / (called + p) DESC, t LIMIT 1"""


@query(
    "best_f1",
    f"WITH {SCORED_SQL}, {_best_sql('SELECT score AS t FROM levels')}",
)
def best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.best_f1_threshold(scored_labels(spark, sf_dir), "target", "score")
    return found.select(six(F.col("threshold"), "threshold"), six(F.col("f1"), "f1"))


@query("best_f1_many_scores", f"WITH {LINE_SCORES_SQL}, {_best_sql('SELECT score AS t FROM levels')}")
def best_f1_many_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct score is a candidate, also when there are more than a grid has points."""
    found = metrics.best_f1_threshold(scored_lines(spark, sf_dir), "target", "score")
    return found.select(six(F.col("threshold"), "threshold"), six(F.col("f1"), "f1"))


@query("best_f1_grid", f"WITH {LINE_SCORES_SQL}, {_best_sql('SELECT i * 0.002::DOUBLE AS t FROM range(501) r(i)')}")
def best_f1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.best_f1_threshold(scored_lines(spark, sf_dir), "target", "score", candidates="grid")
    return found.select(six(F.col("threshold"), "threshold"), six(F.col("f1"), "f1"))


@query(
    "class_weights",
    """SELECT count(*) FILTER (WHERE toxic = 1) AS n_positive, count(*) FILTER (WHERE toxic = 0) AS n_negative,
        round(count(*) FILTER (WHERE toxic = 0) / greatest(count(*) FILTER (WHERE toxic = 1), 1), 6) AS pos_weight FROM labels""",
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.class_weights(table(spark, sf_dir, "labels"), "toxic")
    return found.select("n_positive", "n_negative", six(F.col("pos_weight"), "pos_weight"))


@query(
    "tempered_class_weights",
    """WITH c AS (SELECT label, count(*) AS n_rows FROM embeddings GROUP BY 1),
    r AS (SELECT label, n_rows, power(sum(n_rows) OVER () / n_rows, 0.5) AS raw FROM c)
    SELECT label, n_rows, round(raw / avg(raw) OVER (), 6) AS weight FROM r""",
)
def tempered_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.tempered_class_weights(table(spark, sf_dir, "embeddings"), "label", 0.5)
    return found.select("label", "n_rows", six(F.col("weight"), "weight"))


STEPS = 32


def _channels() -> dict[str, Column]:
    value = F.when(F.col("value") < 20, 0.0).otherwise(F.col("value"))
    signal = zero_as_missing(value)
    return {
        "signal": F.coalesce(signal, F.lit(float("nan"))),
        "missing_mask": signal.isNull().cast("float"),
        "is_click": level_flag(F.col("event_type"), "click"),
    }


@query(
    "tail_n_pad",
    f"""WITH ranked AS (
        SELECT user_id, {STEPS} - row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS step,
               CASE WHEN value < 20 THEN NULL ELSE value END AS signal, event_type FROM events),
    grid AS (SELECT user_id, s.step FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN range({STEPS}) s(step))
    SELECT g.user_id, g.step, round(coalesce(r.signal, -1), 3) AS signal,
           CAST(CASE WHEN r.signal IS NULL THEN 1 ELSE 0 END AS INTEGER) AS missing_mask,
           CAST(CASE WHEN r.event_type = 'click' THEN 1 ELSE 0 END AS INTEGER) AS is_click,
           CAST(CASE WHEN r.event_type IS NULL THEN 1 ELSE 0 END AS INTEGER) AS padding_mask
    FROM grid g LEFT JOIN ranked r ON g.user_id = r.user_id AND g.step = r.step""",
)
def tail_n_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    built = sequences.padded_sequences(
        rows, "user_id", "ts", STEPS, _channels(), {"signal": float("nan"), "missing_mask": 1.0}, "padding_mask",
        cell_seconds=7 * DAY, tie=["event_id"],
    )
    names = ["signal", "missing_mask", "is_click", "padding_mask"]
    steps = built.select("user_id", F.posexplode(F.arrays_zip(*names)).alias("step", "c"))
    return steps.select(
        "user_id",
        F.col("step").cast("bigint").alias("step"),
        F.round(F.nanvl(F.col("c.signal").cast("double"), F.lit(-1.0)), 3).alias("signal"),
        *[F.col(f"c.{n}").cast("int").alias(n) for n in names[1:]],
    )


@query(
    "short_sequence_drop",
    "SELECT user_id, count(*) AS raw_len FROM events GROUP BY 1 HAVING count(*) >= 64",
)
def short_sequence_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = sequences.padded_sequences(
        table(spark, sf_dir, "events"), "user_id", "ts", 64, _channels(), {}, pad_short=False,
        cell_seconds=7 * DAY, tie=["event_id"],
    )
    return built.where(F.size("signal") == 64).select("user_id", "raw_len")


@query(
    "length_summary",
    """SELECT count(*) AS n_subjects, count(*) FILTER (WHERE n < 64) AS n_dropped, min(n) AS min_rows, max(n) AS max_rows,
        median(n) AS median_rows
    FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)""",
)
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return sequences.length_summary(lengths, "n", 64, pad_short=False)


@query(
    "zero_missing_masks",
    """SELECT event_id, CAST(CASE WHEN value < 20 THEN NULL ELSE value END AS DOUBLE) AS signal,
        CAST(value < 20 AS INTEGER) AS missing_mask FROM events""",
)
def zero_missing_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = zero_as_missing(F.when(F.col("value") < 20, 0.0).otherwise(F.col("value")))
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", signal.alias("signal"), signal.isNull().cast("int").alias("missing_mask"))


@query(
    "onehot_quality",
    """SELECT event_id, CAST(event_type = 'click' AS INTEGER) AS is_click, CAST(event_type = 'error' AS INTEGER) AS is_error FROM events""",
)
def onehot_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        level_flag(kind, "click").cast("int").alias("is_click"),
        level_flag(kind, "error").cast("int").alias("is_error"),
    )


# Customers with gaps, as text columns carry them.
CUSTOMER_SQL = """
people AS (
    SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS balance,
           CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag,
           CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE n_name END AS country,
           CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 97 = 0 THEN 'RARE' ELSE c_mktsegment END AS segment,
           c_custkey % 10 < 7 AS is_train
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
counts AS (
    SELECT 'country' AS col, coalesce(country, '__MISSING__') AS level, count(*) AS n_rows FROM people WHERE is_train GROUP BY 2
    UNION ALL SELECT 'segment', coalesce(segment, '__MISSING__'), count(*) FROM people WHERE is_train GROUP BY 2),
kept AS (SELECT col, level, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n_rows DESC, level) AS place FROM counts)
         WHERE level <> '__MISSING__' AND CASE WHEN col = 'country' THEN place <= 15 ELSE n_rows >= 50 END)"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    joined = table(spark, sf_dir, "customer").join(nations, "c_nationkey")
    key = F.col("c_custkey")
    return joined.select(
        "c_custkey",
        F.when(key % 7 != 0, F.col("c_acctbal")).alias("balance"),
        F.when(key % 3 == 0, F.lit(True)).when(key % 3 == 1, F.lit(False)).alias("flag"),
        F.when(key % 5 != 0, F.col("n_name")).alias("country"),
        F.when(key % 11 == 0, F.lit(None)).when(key % 97 == 0, "RARE").otherwise(F.col("c_mktsegment")).alias("segment"),
        (key % 10 < 7).alias("is_train"),
    )


@query("topk_levels", f"WITH {CUSTOMER_SQL} SELECT col, level, n_rows FROM kept")
def topk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = customers(spark, sf_dir).where("is_train")
    counts = tabular.level_counts(train, ["country", "segment"])
    return tabular.kept_levels(counts, ["country"], 15, 50).withColumnRenamed("column", "col")


@query(
    "tabular_encode",
    f"""WITH {CUSTOMER_SQL}, med AS (SELECT median(balance) AS m FROM people WHERE is_train)
    SELECT c_custkey, round(CAST(CAST(coalesce(balance, m) AS FLOAT) AS DOUBLE), 2) AS balance, CAST(balance IS NULL AS INTEGER) AS balance_missing,
           CAST(coalesce(flag, FALSE) AS INTEGER) AS flag, CAST(flag IS NULL AS INTEGER) AS flag_missing,
           CAST(country IS NULL AS INTEGER) AS country_missing,
           CAST(country IS NOT NULL AND country NOT IN (SELECT level FROM kept WHERE col = 'country') AS INTEGER) AS country_other,
           CAST(segment IS NULL AS INTEGER) AS segment_missing,
           CAST(segment IS NOT NULL AND segment NOT IN (SELECT level FROM kept WHERE col = 'segment') AS INTEGER) AS segment_other,
           CAST(CASE WHEN country IN (SELECT level FROM kept WHERE col = 'country') THEN 1 ELSE 0 END
              + CASE WHEN segment IN (SELECT level FROM kept WHERE col = 'segment') THEN 1 ELSE 0 END AS INTEGER) AS n_level_marks
    FROM people CROSS JOIN med""",
)
def tabular_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = customers(spark, sf_dir)
    encoder = tabular.fit_encoder(people.where("is_train"), ["balance"], ["flag"], ["country", "segment"], ["country"])
    encoded = tabular.encode(people, encoder, ["c_custkey"])
    marks = [n for n in encoder.feature_names if "==" in n]
    total = sum((F.col(f"`{n}`") for n in marks), F.lit(0.0))
    plain = {"flag": "flag"} | {f"{c}_missing": f"{c}__missing" for c in ("balance", "flag", "country", "segment")}
    plain |= {f"{c}_other": f"{c}__other" for c in ("country", "segment")}
    return encoded.select(
        "c_custkey",
        F.round(F.col("balance").cast("double"), 2).alias("balance"),
        *[F.col(source).cast("int").alias(name) for name, source in plain.items()],
        total.cast("int").alias("n_level_marks"),
    )


@query(
    "zscore",
    f"""WITH {CUSTOMER_SQL}, s AS (SELECT avg(balance) AS m, stddev_pop(balance) AS d FROM people WHERE is_train)
    SELECT c_custkey, round((balance - m) / CASE WHEN d > 1e-6 THEN d ELSE 1 END, 3) AS z FROM people CROSS JOIN s""",
)
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = customers(spark, sf_dir)
    moments = tabular.feature_moments(people.where("is_train"), ["balance"])
    scaled = tabular.standardise(people, moments)
    return scaled.select("c_custkey", F.round(F.col("balance").cast("double"), 3).alias("z"))


@query(
    "targets_masks",
    f"""WITH {CUSTOMER_SQL}, lv AS (SELECT list_sort(list(DISTINCT segment)) AS levels FROM people WHERE is_train AND segment IS NOT NULL)
    SELECT c_custkey, CAST(coalesce(least(greatest(trunc(balance / 1000), 0), 10), 0) AS BIGINT) AS y_score,
           CAST(balance IS NOT NULL AS INTEGER) AS mask_score,
           CAST(coalesce(list_position(levels, segment) - 1, 0) AS BIGINT) AS y_segment,
           CAST(coalesce(list_contains(levels, segment), FALSE) AS INTEGER) AS mask_segment,
           round(coalesce(balance, 0), 2) AS y_balance, CAST(balance IS NOT NULL AS INTEGER) AS mask_balance,
           CAST(coalesce(flag, FALSE) AS INTEGER) AS y_flag, CAST(flag IS NOT NULL AS INTEGER) AS mask_flag,
           CAST(coalesce(flag, FALSE) AS INTEGER) AS y_assumed, 1 AS mask_assumed
    FROM people CROSS JOIN lv""",
)
def targets_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = customers(spark, sf_dir).withColumns(
        {"score": (F.col("balance") / 1000).cast("int"), "assumed": F.col("flag")}
    )
    levels = tabular.output_levels(people.where("is_train"), ["segment"])
    built = tabular.targets(people, ["c_custkey"], ["score"], levels, ["balance"], ["flag", "assumed"], ["assumed"])
    whole = ["mask_score", "mask_segment", "mask_balance", "y_flag", "mask_flag", "y_assumed", "mask_assumed"]
    return built.select(
        "c_custkey",
        "y_score",
        "y_segment",
        F.round(F.col("y_balance").cast("double"), 2).alias("y_balance"),
        *[F.col(c).cast("int").alias(c) for c in whole],
    )


@query(
    "mae_rmse",
    """SELECT l_returnflag, round(avg(abs(l_quantity * 1500 - l_extendedprice)), 6) AS mae,
        round(sqrt(avg((l_quantity * 1500 - l_extendedprice) ** 2)), 6) AS rmse, count(*) AS n_rows FROM lineitem GROUP BY 1""",
)
def mae_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("guess", F.col("l_quantity") * 1500)
    found = metrics.error_summary(rows, "l_extendedprice", "guess", ["l_returnflag"])
    return found.select("l_returnflag", six(F.col("mae"), "mae"), six(F.col("rmse"), "rmse"), "n_rows")


LOGITS_SQL = """
base AS (SELECT vec_id, label, embedding[1:11] AS logits, embedding[12]::DOUBLE AS flag_logit, embedding[13:22] AS cat_logits,
                embedding[23]::DOUBLE AS guess, embedding[24]::DOUBLE AS number, embedding[25] > 0 AS flag FROM embeddings),
steps AS (SELECT vec_id, i, exp(logits[i]::DOUBLE) AS e FROM base CROSS JOIN range(1, 12) r(i)),
soft AS (SELECT vec_id, sum(e * (i - 1)) / sum(e) AS expected, sum(CASE WHEN i <= 7 THEN e ELSE 0 END) / sum(e) AS low FROM steps GROUP BY 1),
joined AS (SELECT * FROM base JOIN soft USING (vec_id)),
tasks AS (SELECT 'apgar5_below7' AS task, CASE WHEN label < 7 THEN 1 ELSE 0 END AS target, low AS score FROM joined
          UNION ALL SELECT 'flag', CASE WHEN flag THEN 1 ELSE 0 END, 1 / (1 + exp(-flag_logit)) FROM joined),
levels AS (SELECT task, round(score, 12) AS score, CAST(sum(target) AS DOUBLE) AS pos, CAST(sum(1 - target) AS DOUBLE) AS neg FROM tasks GROUP BY 1, 2),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY task) AS p, sum(neg) OVER (PARTITION BY task) AS n
        FROM levels WINDOW w AS (PARTITION BY task ORDER BY score DESC)),
evaluated AS (
    SELECT 'score' AS family, 'apgar5' AS task, 'mae' AS metric, avg(abs(expected - label)) AS value FROM joined
    UNION ALL SELECT 'score', 'apgar5', 'rmse', sqrt(avg((expected - label) ** 2)) FROM joined
    UNION ALL SELECT 'binary', task, 'roc_auc', sum(neg * (tp - pos / 2)) / (any_value(p) * any_value(n)) FROM cum GROUP BY task
    UNION ALL SELECT 'binary', task, 'pr_auc', sum(pos / p * tp / (tp + fp)) FROM cum GROUP BY task
    UNION ALL SELECT 'binary', task, 'prevalence', any_value(p) / (any_value(p) + any_value(n)) FROM cum GROUP BY task
    UNION ALL SELECT 'category', 'label', 'accuracy', avg(CASE WHEN list_position(cat_logits, list_max(cat_logits)) - 1 = label THEN 1.0 ELSE 0.0 END) FROM joined
    UNION ALL SELECT 'number', 'number', 'mae', avg(abs(guess - number)) FROM joined
    UNION ALL SELECT 'number', 'number', 'rmse', sqrt(avg((guess - number) ** 2)) FROM joined)"""

SPEC = evaluation.EvaluationSpec(
    scores=[evaluation.TaskColumns("apgar5", "label", "logits")],
    categories=[evaluation.TaskColumns("label", "label", "cat_logits")],
    numbers=[evaluation.TaskColumns("number", "number", "guess")],
    flags=[evaluation.TaskColumns("flag", "flag", "flag_logit")],
    monitored=["apgar5_below7"],
)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector components stand in for the outputs of a multitask model."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.slice(e, 1, 11).alias("logits"),
        F.get(e, F.lit(11)).cast("double").alias("flag_logit"),
        F.slice(e, 13, 10).alias("cat_logits"),
        F.get(e, F.lit(22)).cast("double").alias("guess"),
        F.get(e, F.lit(23)).cast("double").alias("number"),
        (F.get(e, F.lit(24)) > 0).cast("int").alias("flag"),
    )


@query("multitask_evaluation", f"WITH {LOGITS_SQL} SELECT family, task, metric, round(value, 6) AS value FROM evaluated")
def multitask_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.evaluate(predictions(spark, sf_dir), SPEC)
    return found.select("family", "task", "metric", six(F.col("value"), "value"))


@query(
    "monitor_value",
    f"""WITH {LOGITS_SQL} SELECT round(avg(value), 6) AS mean_binary_pr_auc,
        round(avg(value) FILTER (WHERE task = 'apgar5_below7'), 6) AS monitor_binary_pr_auc
    FROM evaluated WHERE family = 'binary' AND metric = 'pr_auc'""",
)
def monitor_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.monitor_value(evaluation.evaluate(predictions(spark, sf_dir), SPEC), SPEC.monitored)
    return found.select(*[six(F.col(c), c) for c in found.columns])


RUNS_SQL = """
runs AS (SELECT l_linenumber AS seed, CASE l_returnflag WHEN 'N' THEN 'baseline' ELSE 'without_' || l_returnflag END AS ablation,
                l_linestatus AS outcome, 'roc_auc' AS metric, avg(l_discount) AS value FROM lineitem GROUP BY 1, 2, 3),
deltas AS (SELECT r.*, b.value AS baseline_value, b.value - r.value AS drop_value
           FROM runs r JOIN runs b ON r.seed = b.seed AND r.outcome = b.outcome AND r.metric = b.metric AND b.ablation = 'baseline'),
summary AS (SELECT ablation, outcome, metric, avg(drop_value) AS mean_drop,
                   CASE WHEN count(drop_value) = 1 THEN 0 ELSE stddev_samp(drop_value) END AS sd_drop, count(drop_value) AS n_seeds
            FROM deltas GROUP BY 1, 2, 3)"""


def study_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean discount per (line number, flag, status) as the metric of one run."""
    rows = table(spark, sf_dir, "lineitem")
    name = F.when(F.col("l_returnflag") == "N", "baseline").otherwise(F.concat(F.lit("without_"), F.col("l_returnflag")))
    return rows.groupBy(
        F.col("l_linenumber").alias("seed"), name.alias("ablation"), F.col("l_linestatus").alias("outcome"),
        F.lit("roc_auc").alias("metric"),
    ).agg(F.avg("l_discount").alias("value"))


@query(
    "ablation_delta",
    f"""WITH {RUNS_SQL} SELECT seed, ablation, outcome, metric, round(value, 6) AS value, round(baseline_value, 6) AS baseline_value,
        round(drop_value, 6) AS drop_value FROM deltas""",
)
def ablation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.removal_deltas(study_runs(spark, sf_dir))
    return found.select(
        "seed", "ablation", "outcome", "metric", *[six(F.col(c), c) for c in ("value", "baseline_value", "drop_value")]
    )


@query(
    "ablation_summary",
    f"""WITH {RUNS_SQL} SELECT ablation, outcome, metric, round(mean_drop, 6) AS mean_drop, round(sd_drop, 6) AS sd_drop, n_seeds FROM summary""",
)
def ablation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.removal_summary(evaluation.removal_deltas(study_runs(spark, sf_dir)))
    return found.select(
        "ablation", "outcome", "metric", six(F.col("mean_drop"), "mean_drop"), six(F.col("sd_drop"), "sd_drop"), "n_seeds"
    )


@query(
    "ablation_ranking",
    f"""WITH {RUNS_SQL} SELECT ablation, outcome, metric, CAST(row_number() OVER (PARTITION BY outcome, metric ORDER BY mean_drop DESC, ablation) AS INTEGER) AS place
    FROM summary WHERE ablation <> 'baseline'""",
)
def ablation_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = evaluation.removal_summary(evaluation.removal_deltas(study_runs(spark, sf_dir)))
    return evaluation.removal_ranking(summary).select("ablation", "outcome", "metric", "place")


@query(
    "failure_topk",
    """SELECT source, count(*) AS n_failures FROM documents WHERE n_chars < 1000 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def failure_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = table(spark, sf_dir, "documents").where(F.col("n_chars") < 1000)
    return reports.worst_sources(failures, 5)


@query(
    "split_map_join",
    f"""WITH {SPLIT_SQL} SELECT d.doc_id, d.n_chars FROM documents d JOIN splits s ON d.doc_id = s.doc_id WHERE s.split = 'val'""",
)
def split_map_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return sequences.split_sequences(rows, stratified_split(spark, sf_dir), "val", "doc_id", "n_chars")


@query("row_count", "SELECT CAST(count(*) AS DOUBLE) AS n_rows FROM lineitem")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_double(table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n_rows")), "n_rows")
