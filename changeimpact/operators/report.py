"""Reports as rows: one row per line, with keys that give the order.

A report lists every finding, so its text grows with the log. It is kept as an
ordered table of lines, which a sink writes in order, and never as one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from changeimpact.functions import text
from changeimpact.operators import ranking

SECTIONS = [("hard", "HARD"), ("soft", "SOFT"), ("unknown", "UNKNOWN / needs human")]
CLEARED_HEADING = "CLEARED (references a same-named column that binds elsewhere)"
LINE = ["change_id", "section", "part", "tier_order", "exec_order", "query_id", "line"]


def _lines(df: DataFrame, section: int, part: int, line: Column, query_id: Column | None = None) -> DataFrame:
    """part 0: heading, 1: body, 2: closing blank."""
    return df.select(
        "change_id", F.lit(section).alias("section"), F.lit(part).alias("part"),
        F.lit(0).alias("tier_order"), F.lit(0).cast("bigint").alias("exec_order"),
        (F.lit("") if query_id is None else query_id).alias("query_id"), line.alias("line"),
    )


def finding_lines(findings: DataFrame, use_exec_count: bool = False) -> DataFrame:
    """The line of each finding under its section."""
    none = F.lit("")
    count = F.col("exec_count")
    extra = F.when(
        F.lit(use_exec_count) & count.isNotNull(), F.concat(F.lit("  (exec×"), count.cast("string"), F.lit(")"))
    ).otherwise(none)
    snippet = text.safe_inline(F.col("sql_snippet"))

    def trailing(prefix: str, name: str) -> Column:
        given = F.coalesce(name, none) != ""
        return F.when(given, F.concat(F.lit(prefix), text.safe_inline(F.col(name), 200))).otherwise(none)

    listed = F.concat(
        F.lit("- "), "query_id", F.lit(" — ["), "evidence", F.lit("] `"), snippet, F.lit("`"), extra,
        trailing(" — ", "unknown_reason"), trailing(" — agent: ", "agent_note"),
    )
    bound = F.coalesce(text.cleared_tables(F.col("evidence")), F.lit("?"))
    cleared = F.concat(
        F.lit("- "), "query_id", F.lit(" — binds to `"), bound, F.lit("` — `"), snippet, F.lit("`"), extra
    )
    is_cleared = (F.col("severity") == "unaffected") & text.is_cleared(F.col("evidence"))
    section = F.when(is_cleared, 4)
    for number, (severity, _) in enumerate(SECTIONS, 1):
        section = F.when(F.col("severity") == severity, number).otherwise(section)
    order = F.coalesce(-count, F.lit(1).cast("bigint")) if use_exec_count else F.lit(0).cast("bigint")
    return findings.select(
        "change_id", section.alias("section"), F.lit(1).alias("part"),
        ranking.tier(F.col("severity")).alias("tier_order"), order.alias("exec_order"), "query_id",
        F.when(is_cleared, cleared).otherwise(listed).alias("line"),
    ).where(F.col("section").isNotNull())


def report_lines(
    changes: DataFrame,
    summary: DataFrame,
    findings: DataFrame,
    use_exec_count: bool = False,
    user_supplied_baseline: bool = False,
    notify: DataFrame | None = None,
    baseline: DataFrame | None = None,
) -> DataFrame:
    """The whole report of each change; order by the columns in ``LINE`` order.

    The baseline of a change counts as user-supplied if ``baseline`` gives one for it, or by the flag for all.
    """
    df = changes.join(summary, "change_id")
    supplied = F.lit(user_supplied_baseline)
    if baseline is not None:
        given = baseline.where(F.col("lineage_dependent_count").isNotNull()).select("change_id").distinct()
        df = df.join(given.withColumn("is_given", F.lit(True)), "change_id", "left")
        supplied = supplied | F.coalesce("is_given", F.lit(False))
    blank = F.lit("")
    change = text.report_change_text(F.col("kind"), F.col("column"), F.col("new_column"))
    baseline = text.baseline_text(F.col("lineage_dependent_count"), supplied)
    parts = [
        _lines(df, 0, 0, F.concat(F.lit("Schema rehearsal: "), change)),
        _lines(df, 0, 1, blank),
        _lines(df, 0, 2, baseline),
        _lines(df, 0, 3, blank),
    ]
    headings = [(label, f"n_{severity}") for severity, label in SECTIONS] + [(CLEARED_HEADING, "n_cleared")]
    for number, (label, column) in enumerate(headings, 1):
        head = F.concat(F.lit(f"{label} ("), F.col(column).cast("string"), F.lit(")"))
        parts.append(_lines(df, number, 0, head))
        parts.append(_lines(df.where(F.col(column) == 0), number, 1, F.lit("- (none)")))
        parts.append(_lines(df, number, 2, blank))
    parts.append(finding_lines(findings, use_exec_count))
    if notify is not None:
        parts.append(_lines(df, 5, 0, F.lit("Notify (who to warn before Friday)")))
        parts.append(notify.select("change_id", F.lit(5).alias("section"), F.lit(1).alias("part"),
                                   F.col("block").alias("tier_order"), F.col("place").cast("bigint").alias("exec_order"),
                                   F.col("urn").alias("query_id"), "line"))
        parts.append(_lines(df, 5, 2, blank))
    count = F.col("no_reference_count").cast("string")
    parts.append(
        _lines(df, 6, 0, F.concat(F.lit("No query evidence of `"), "column", F.lit("` on subject: "), count))
    )
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines.select(*LINE)


def ordered(lines: DataFrame) -> DataFrame:
    return lines.orderBy(*LINE[:-1])


def notify_lines(targets: DataFrame) -> DataFrame:
    """Who to warn, per change: owned targets under their severity, unowned ones apart.

    Columns change_id, block, place, urn, line; order by them.
    """
    owned = targets.withColumn("owned", F.size("owners") > 0)
    any_owned = owned.groupBy("change_id").agg(F.max("owned").alias("any_owned"), F.max("worst_severity").alias("worst"))
    rows = owned.join(any_owned, "change_id")
    role_order = F.when(F.col("role") == "subject", 0).otherwise(1)
    labels = F.array_join(F.transform("owners", text.owner_label), ", ")
    shown = F.coalesce("worst_severity", F.lit("n/a"))
    named = F.concat(F.lit("- `"), "urn", F.lit("` ("), "role", F.lit(") → "), labels)
    bare = F.concat(F.lit("- `"), "urn", F.lit("` ("), "role", F.lit(", worst="), shown, F.lit(")"))

    def head(df: DataFrame, block: int, line: Column) -> DataFrame:
        return df.select(
            "change_id", F.lit(block).alias("block"), F.lit(-1).alias("place"), F.lit("").alias("urn"), line.alias("line")
        )

    def body(df: DataFrame, block: int, line: Column) -> DataFrame:
        return df.select("change_id", F.lit(block).alias("block"), role_order.alias("place"), "urn", line.alias("line"))

    some = any_owned.where(F.col("any_owned"))
    unowned = rows.where(~F.col("owned"))
    apart = unowned.where(F.col("any_owned"))
    parts = [
        head(any_owned.where(~F.col("any_owned")), 0, F.lit(
            "- no owners recorded in the catalog — coordination list empty "
            "(record ownership to populate this section)"
        )),
        body(unowned.where(~F.col("any_owned")), 0, bare),
        head(some, 1, F.concat(F.upper(F.coalesce("worst", F.lit("unaffected"))), F.lit(" priority"))),
        body(rows.where(F.col("owned")), 1, named),
        some.join(apart.select("change_id").distinct(), "change_id").select(
            "change_id", F.lit(2).alias("block"), F.lit(-2).alias("place"), F.lit("").alias("urn"), F.lit("").alias("line")
        ),
        head(some.join(apart.select("change_id").distinct(), "change_id"), 2, F.lit("no owners recorded")),
        body(apart, 2, bare),
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines


def nothing_to_notify(changes: DataFrame, targets: DataFrame) -> DataFrame:
    """The line of changes without any target."""
    empty = changes.select("change_id").join(targets.select("change_id").distinct(), "change_id", "left_anti")
    return empty.select(
        "change_id", F.lit(0).alias("block"), F.lit(0).alias("place"), F.lit("").alias("urn"), F.lit("- (none)").alias("line")
    )


def write_payload(
    changes: DataFrame, summary: DataFrame, descriptions: DataFrame, external_url: str | None = None
) -> DataFrame:
    """Assertion, tag and merged description per change.

    The description takes the report's headings and counts; the finding lines
    stay in the report table, so no cell grows with the log.
    """
    df = changes.join(summary, "change_id").join(
        counts_text(summary), "change_id"
    ).join(description_rows(descriptions), F.col("dataset") == F.col("described"), "left")
    change = text.payload_change_text(F.col("kind"), F.col("column"), F.col("new_column"))
    title = F.concat(F.lit("Schema rehearsal: "), change)
    baseline = F.concat(
        F.lit("Impact Analysis baseline: "), F.col("lineage_dependent_count").cast("string"), F.lit(" downstream.")
    )
    words = F.concat(title, F.lit(". "), "counts_text", F.lit(". "), baseline, F.lit(" Column: `"), "column", F.lit("`."))
    section = F.concat(F.lit("## "), title, F.lit("\n\n"), "counts_text", F.lit("\n\n"), baseline)
    return df.select(
        "change_id",
        F.col("dataset").alias("entity_urn"),
        title.alias("title"),
        words.alias("assertion_description"),
        F.lit("FAILURE").alias("report_result"),
        F.lit(external_url).cast("string").alias("external_url"),
        F.lit(text.FORECAST_TAG).alias("tag"),
        text.merge_section(F.col("existing"), section).alias("description_markdown"),
    )


def counts_text(summary: DataFrame) -> DataFrame:
    def part(label: str, name: str) -> Column:
        return F.concat(F.lit(f"{label}="), F.col(name).cast("string"))

    words = F.concat_ws(
        " ", part("HARD", "n_hard"), part("SOFT", "n_soft"), part("UNKNOWN", "n_unknown"), part("CLEARED", "n_cleared")
    )
    return summary.select("change_id", words.alias("counts_text"))


def description_rows(descriptions: DataFrame) -> DataFrame:
    return descriptions.select(F.col("urn").alias("described"), F.col("description").alias("existing"))


def project_findings(findings: DataFrame) -> DataFrame:
    """Findings as consumers see them."""
    return findings.select(
        "change_id", "query_id", "severity", "evidence", "sql_snippet", "unknown_reason", "unknown_kind",
        "agent_note", text.is_cleared(F.col("evidence")).alias("cleared"),
    )


def explain_findings(requested: DataFrame, findings: DataFrame) -> DataFrame:
    """Details of the asked (change_id, query_id) pairs; an absent one gets a note."""
    note = "query_id not in latest rehearsal findings (may be NO_REFERENCE / no query evidence)"
    return requested.join(project_findings(findings), ["change_id", "query_id"], "left").withColumn(
        "note", F.when(F.col("severity").isNull(), note)
    )

