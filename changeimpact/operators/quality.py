"""Prediction runs against gold labels.

Predictions are (run, query_id, predicted); gold is (query_id, stratum, gold). With a
change_id in all of them a case is a statement under a change, and every figure is
given per change. All runs are scored by one aggregation. Lists of misses are rows,
not arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from changeimpact.functions import predicates


def _by(df: DataFrame, *columns: str) -> list[str]:
    """The columns, after change_id where the cases have one."""
    return [*(c for c in ("change_id",) if c in df.columns), *columns]


def everything_breaks(gold: DataFrame, run: str = "everything") -> DataFrame:
    return gold.select(F.lit(run).alias("run"), *_by(gold, "query_id"), F.lit("hard").alias("predicted"))


def substring_run(log: DataFrame, column: Column, run: str = "substring") -> DataFrame:
    return log.select(
        F.lit(run).alias("run"), *_by(log, "query_id"), predicates.substring_prediction(F.col("sql"), column).alias("predicted")
    )


def predicted_labels(gold: DataFrame, findings: DataFrame, run: str) -> DataFrame:
    """Severity of each labelled statement; no finding means unaffected."""
    case = _by(gold, "query_id")
    found = findings.select(*case, "severity")
    return gold.select(*case).join(found, case, "left").select(
        F.lit(run).alias("run"), *case, F.coalesce("severity", F.lit("unaffected")).alias("predicted")
    )


def scored(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    return predictions.join(gold, _by(gold, "query_id"))


def confusion_matrix(cases: DataFrame) -> DataFrame:
    """Counts over all pairs of classes, zeros kept."""
    counted = cases.groupBy(*_by(cases, "run", "gold", "predicted")).agg(F.count(F.lit(1)).alias("n"))
    classes = F.array(*[F.lit(s) for s in predicates.SEVERITIES])
    grid = cases.select(*_by(cases, "run")).distinct().withColumn("gold", F.explode(classes)).withColumn(
        "predicted", F.explode(classes)
    )
    return grid.join(counted, _by(cases, "run", "gold", "predicted"), "left").fillna(0, ["n"])


def _ratio(top: Column, bottom: Column) -> Column:
    return F.round(top / F.nullif(bottom, F.lit(0)), 6)


def class_metrics(cases: DataFrame) -> DataFrame:
    """Precision and recall of each class; null when undefined."""
    classes = F.array(*[F.lit(s) for s in predicates.SEVERITIES])
    rows = cases.withColumn("class", F.explode(classes))
    gold, predicted = F.col("gold") == F.col("class"), F.col("predicted") == F.col("class")
    return rows.groupBy(*_by(cases, "run", "class")).agg(
        _ratio(F.count_if(gold & predicted), F.count_if(predicted)).alias("precision"),
        _ratio(F.count_if(gold & predicted), F.count_if(gold)).alias("recall"),
    )


def run_metrics(cases: DataFrame) -> DataFrame:
    """Accuracy, HARD precision and recall, UNKNOWN rate and decoy false positives per run."""
    n = F.count(F.lit(1))
    gold, predicted, decoy = F.col("gold"), F.col("predicted"), F.col("stratum") == "decoy"
    hit = F.count_if((gold == "hard") & (predicted == "hard"))
    return cases.groupBy(*_by(cases, "run")).agg(
        n.alias("n_cases"),
        _ratio(F.count_if(gold == predicted), n).alias("accuracy"),
        _ratio(hit, F.count_if(predicted == "hard")).alias("hard_precision"),
        _ratio(hit, F.count_if(gold == "hard")).alias("hard_recall"),
        _ratio(F.count_if(predicted == "unknown"), n).alias("unknown_rate"),
        _ratio(F.count_if(decoy & (predicted != "unaffected")), F.count_if(decoy)).alias("decoy_fp_rate"),
    )


def stratum_report(cases: DataFrame) -> DataFrame:
    return cases.groupBy(*_by(cases, "run", "stratum")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("predicted")).alias("n_correct")
    )


def misses(cases: DataFrame) -> DataFrame:
    told = F.concat("query_id", F.lit(":"), "gold", F.lit("->"), "predicted")
    return cases.where(F.col("gold") != F.col("predicted")).select(*_by(cases, "run", "stratum", "query_id"), told.alias("miss"))


def agreement(cases: DataFrame) -> DataFrame:
    """Per case whether the prediction agrees with the label."""
    return cases.select(
        *_by(cases, "run", "query_id", "stratum", "gold", "predicted"), (F.col("gold") == F.col("predicted")).alias("agree")
    )


def adjudicator_lift(gold: DataFrame, base: DataFrame, ruled: DataFrame) -> DataFrame:
    """How many UNKNOWNs a ruling run bound, and how many of those rightly."""
    df = _before_after(gold, base, ruled)
    was_unknown = F.col("before") == "unknown"
    bound = was_unknown & (F.col("after") != "unknown")
    n_bound, n_unknown = F.count_if(bound), F.count_if(was_unknown)
    return df.groupBy(*_by(df, "run")).agg(
        n_unknown.alias("base_unknowns"),
        n_bound.alias("bound"),
        _ratio(n_bound, n_unknown).alias("bind_rate"),
        _ratio(F.count_if(bound & (F.col("after") == F.col("gold"))), n_bound).alias("bind_accuracy"),
    )


def bound_cases(gold: DataFrame, base: DataFrame, ruled: DataFrame) -> DataFrame:
    df = _before_after(gold, base, ruled).where(
        (F.col("before") == "unknown") & (F.col("after") != "unknown")
    )
    return df.select(*_by(df, "run", "query_id"), F.col("after").alias("predicted"), "gold")


def _before_after(gold: DataFrame, base: DataFrame, ruled: DataFrame) -> DataFrame:
    case = _by(gold, "query_id")
    before = base.select(*case, F.col("predicted").alias("before"))
    after = ruled.select("run", *case, F.col("predicted").alias("after"))
    return gold.join(before, case).join(after, case)


def metrics_text(metrics: DataFrame) -> DataFrame:
    """The run table as Markdown rows: two decimals, n/a for null."""
    names = ["accuracy", "hard_precision", "hard_recall", "unknown_rate", "decoy_fp_rate"]
    cells = [F.coalesce(F.format_string("%.2f", F.col(n)), F.lit("n/a")) for n in names]
    shown = [F.when(F.col(n).isNull(), F.lit("n/a")).otherwise(c) for n, c in zip(names, cells)]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("run"), *shown), F.lit(" |"))
    return metrics.select(*_by(metrics, "run"), line.alias("line"))
