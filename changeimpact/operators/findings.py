"""Counts, gates and distributions over findings or over shape verdicts.

Every function takes either statement-level findings or shape-level verdicts; the
latter carry ``n_statements`` and give the same numbers without touching the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from changeimpact.functions import predicates, text
from changeimpact.operators import extract, ranking

WEIGHTS = {"hard": 3, "soft": 2, "unknown": 1}


def weight(df: DataFrame) -> Column:
    return F.col("n_statements") if "n_statements" in df.columns else F.lit(1).cast("bigint")


def _count_if(df: DataFrame, condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, weight(df))), F.lit(0)).cast("bigint")


def statement_totals(log: DataFrame) -> DataFrame:
    """Statements logged per dataset, from the log itself (one narrow column) or from shapes."""
    return log.groupBy("dataset").agg(F.sum(weight(log)).alias("n_queries"))


def severity_counts(found: DataFrame) -> DataFrame:
    """Counts per change; CLEARED is apart from, and also inside, unaffected."""
    severity, evidence, kind = F.col("severity"), F.col("evidence"), F.col("unknown_kind")
    return found.groupBy("change_id").agg(
        *[_count_if(found, severity == s).alias(f"n_{s}") for s in predicates.SEVERITIES],
        _count_if(found, (severity == "unaffected") & text.is_cleared(evidence)).alias("n_cleared"),
        _count_if(found, predicates.is_unparseable(severity, evidence, kind)).alias("n_unparseable"),
    )


COUNTS = ["n_hard", "n_soft", "n_unknown", "n_unaffected", "n_cleared", "n_unparseable"]


def forecast_summary(
    changes: DataFrame, totals: DataFrame, found: DataFrame, lineage_counts: DataFrame | None = None
) -> DataFrame:
    """Per change: findings by severity, statements without a reference, lineage dependents."""
    df = (
        changes.select("change_id", "dataset")
        .join(totals, "dataset", "left")
        .join(severity_counts(found), "change_id", "left")
    )
    if lineage_counts is None:
        df = df.withColumn("lineage_dependent_count", F.lit(0).cast("bigint"))
    else:
        df = df.join(lineage_counts, "change_id", "left")
    df = df.fillna(0, ["n_queries", "lineage_dependent_count", *COUNTS])
    listed = F.col("n_hard") + F.col("n_soft") + F.col("n_unknown") + F.col("n_cleared")
    return df.select(
        "change_id", "n_queries", "lineage_dependent_count", *COUNTS,
        (F.col("n_queries") - listed).alias("no_reference_count"),
    )


def gate(
    changes: DataFrame, found: DataFrame, fail_on: str = "hard,unknown", totals: DataFrame | None = None
) -> DataFrame:
    """Merge gate per change: 0 clean, 1 triggered, 2 not known to be clean.

    The last is a change with unread statements where UNKNOWN is no threshold and, given the ``totals`` of
    ``statement_totals()``, a change that no logged statement meets.
    """
    levels = predicates.parse_fail_on(fail_on)
    df = changes.select("change_id", "dataset") if totals is not None else changes.select("change_id")
    df = df.join(severity_counts(found), "change_id", "left").fillna(0, COUNTS)
    empty = F.lit(False)
    if totals is not None:
        df = df.join(totals.select("dataset", "n_queries"), "dataset", "left")
        empty = F.coalesce("n_queries", F.lit(0)) == 0
    triggered = sum((F.col(f"n_{level}") for level in levels), F.lit(0).cast("bigint"))
    unread = (F.col("n_unparseable") > 0) & F.lit("unknown" not in levels)
    clear = F.col("n_triggered") == 0
    told = F.concat(F.col("n_unparseable").cast("string"), F.lit(" statements could not be read and UNKNOWN is no threshold"))
    return df.withColumn("n_triggered", triggered).select(
        "change_id",
        F.lit(",".join(levels)).alias("fail_on"),
        (clear & ~unread & ~empty).alias("clean"),
        *COUNTS,
        "n_triggered",
        F.when(~clear, 1).when(unread | empty, 2).otherwise(0).cast("int").alias("exit_code"),
        F.when(empty, F.lit("no logged statement belongs to the changed dataset"))
        .when(unread & clear, F.concat(told, F.lit("; not clean")))
        .when(unread, told)
        .alias("note"),
    )


def gate_triggered(findings: DataFrame, fail_on: str = "hard,unknown") -> DataFrame:
    """The statements that fail the gate, in rank order, as rows and not as one array."""
    failing = findings.where(F.col("severity").isin(predicates.parse_fail_on(fail_on)))
    return ranking.rank_findings(failing.select("change_id", "query_id", "severity", "evidence"))


def worst_severity(changes: DataFrame, found: DataFrame) -> DataFrame:
    """HARD over SOFT over UNKNOWN; null when a change breaks nothing."""
    scored = F.lit(None).cast("int")
    for name, score in WEIGHTS.items():
        scored = F.when(F.col("severity") == name, score).otherwise(scored)
    worst = found.groupBy("change_id").agg(F.max(scored).alias("w"))
    name = F.lit(None).cast("string")
    for severity, score in WEIGHTS.items():
        name = F.when(F.col("w") == score, severity).otherwise(name)
    return changes.select("change_id").join(worst, "change_id", "left").select(
        "change_id", name.alias("worst_severity")
    )


def verdict_distribution(summary: DataFrame) -> DataFrame:
    """Share of each label per change, from the forecast summary; absent labels give no row."""
    labels = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.col(column).alias("n"))
            for label, column in [
                ("hard", "n_hard"), ("soft", "n_soft"), ("unknown", "n_unknown"),
                ("cleared", "n_cleared"), ("unaffected", "no_reference_count"),
            ]
        ]
    )
    rows = summary.select("change_id", "n_queries", F.inline(labels)).where(F.col("n") > 0)
    return rows.select("change_id", "label", "n", F.round(F.col("n") / F.col("n_queries"), 6).alias("share"))


def unknown_breakdown(found: DataFrame) -> DataFrame:
    bucket = text.unknown_bucket(F.col("unknown_kind"))
    unknown = found.where(F.col("severity") == "unknown").withColumn("bucket", bucket)
    return (
        unknown.groupBy("change_id", "bucket")
        .agg(F.sum(weight(unknown)).alias("n"))
        .orderBy("change_id", F.desc("n"), "bucket")
    )


def parse_rate(summary: DataFrame) -> DataFrame:
    read = F.col("n_queries") - F.col("n_unparseable")
    rate = F.coalesce(read / F.nullif(F.col("n_queries"), F.lit(0)), F.lit(0.0))
    return summary.select("change_id", "n_queries", "n_unparseable", F.round(rate, 6).alias("parse_rate"))


def table_resolution_rate(log: DataFrame, schema_columns: DataFrame) -> DataFrame:
    """Of the distinct tables named after FROM or JOIN, how many have a schema."""
    named = extract.regex_tables(log).select("table_name").distinct()
    known = schema_columns.select(text.unquoted_base_name(F.col("table_name")).alias("table_name")).distinct()
    found = named.join(known.withColumn("known", F.lit(1)), "table_name", "left")
    return found.agg(
        F.count("known").alias("n_with_schema"),
        (F.count(F.lit(1)) - F.count("known")).alias("n_without_schema"),
        F.round(F.count("known") / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias("resolution_rate"),
    )


def alias_clears(found: DataFrame, table: str) -> DataFrame:
    """CLEARED statements that bind to ``table`` (it may be a view over the subject)."""
    names = F.transform(F.split(text.cleared_tables(F.col("evidence")), ","), lambda t: F.btrim(t))
    cleared = found.where(text.is_cleared(F.col("evidence")))
    return cleared.groupBy("change_id").agg(
        F.sum(weight(cleared)).alias("n_cleared"),
        _count_if(cleared, F.array_contains(names, table)).alias("n_bound_to_table"),
    )


def first_examples(findings: DataFrame) -> DataFrame:
    """Up to five CLEARED, eight UNKNOWN and one HARD and SOFT example per change."""
    label = predicates.verdict_label(F.col("severity"), F.col("evidence"))
    limits = {"hard": 1, "soft": 1, "cleared": 5, "unknown": 8}
    return ranking.first_per_label(findings.withColumn("label", label), limits).select(
        "change_id", "label", "example_no", "query_id", "evidence"
    )


def parse_failures(findings: DataFrame, limit: int = 10) -> DataFrame:
    failed = predicates.is_unparseable(F.col("severity"), F.col("evidence"), F.col("unknown_kind"))
    rows = findings.where(failed).withColumn("label", F.lit("parse"))
    return ranking.first_per_label(rows, {"parse": limit}).select(
        "change_id", "query_id", "example_no", text.strip_ansi(F.col("unknown_reason")).alias("reason")
    )


def defect_flags(
    changes: DataFrame, log: DataFrame, findings: DataFrame, schema_columns: DataFrame, limit: int = 8
) -> DataFrame:
    """Surprising results worth a second look: the first ``limit`` flags per change.

    ``log`` may carry ``had_templates`` (markup was stripped before classification).
    """
    query_id = F.col("query_id")
    named = changes.select(
        "change_id", "dataset", F.lower("column").alias("col"),
        text.base_name(F.coalesce(text.subject_table(F.col("dataset")), F.col("dataset"))).alias("subject"),
    )
    said = F.lower("sql_snippet")

    def precedes(first: Column, second: Column) -> Column:
        """Both are in the snippet, the second after the first; no pattern is built per row."""
        place = F.position(first, said)
        return (place > 0) & (F.position(second, said, place + F.length(first)) > 0)

    subject, col = F.lower("subject"), F.col("col")
    tied = (
        log.select("query_id", "dataset", text.snippet(F.col("sql")).alias("sql_snippet"))
        .join(named, "dataset")
        .where(precedes(subject, col) | precedes(col, subject))
        .join(findings.select("change_id", "query_id"), ["change_id", "query_id"], "left_anti")
    )
    missed = tied.select("change_id", "query_id", F.lit(1).alias("rule"), F.concat(
        F.lit("possible miss (unaffected but snippet ties column to subject): `"), query_id, F.lit("`")
    ).alias("flag"))
    had = F.col("had_templates") if "had_templates" in log.columns else F.lit(False)
    stripped = log.where(had).select("query_id").distinct()
    hollow = (
        findings.where((F.col("severity") == "hard") & F.contains("sql_snippet", F.lit(" __JINJA__ ")))
        .join(stripped, "query_id", "left_semi")
        .select("change_id", "query_id", F.lit(2).alias("rule"), F.concat(
            F.lit("HARD after template stripping - verify binding still meaningful: `"), query_id, F.lit("`")
        ).alias("flag"))
    )
    known = schema_columns.select(text.base_name(F.col("table_name")).alias("table")).distinct()
    stray = (
        findings.where(text.is_cleared(F.col("evidence")))
        .select("change_id", "query_id", "evidence",
                F.explode(F.split(text.cleared_tables(F.col("evidence")), ",")).alias("table"))
        .join(known, "table", "left_anti")
        .groupBy("change_id", "query_id", "evidence")
        .agg(F.min("table").alias("table"))
        .select("change_id", "query_id", F.lit(3).alias("rule"), F.concat(
            F.lit("possible binder defect: CLEARED to non-loaded `"), F.col("table"), F.lit("` in `"),
            query_id, F.lit("` ("), F.col("evidence"), F.lit(")"),
        ).alias("flag"))
    )
    flags = missed.unionByName(hollow).unionByName(stray).groupBy("change_id", "query_id", "flag").agg(
        F.min("rule").alias("rule")
    )
    return ranking.first_per_label(flags.withColumn("label", F.lit("flag")), {"flag": limit}).select(
        "change_id", "query_id", "flag"
    )
