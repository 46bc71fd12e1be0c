"""Sinks: partitioned tables and ordered text, one folder per change, never one file per statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from changeimpact.functions import text
from changeimpact.operators import catalog, ranking, report


class WriteBackDisabled(RuntimeError):
    """Raised when a catalog write is asked for without enabling it."""


def write_findings_json(findings: DataFrame, path: str, use_exec_count: bool = False) -> None:
    """Findings as JSON lines in rank order under ``change_id=...`` folders."""
    ranking.rank_findings(findings, use_exec_count).write.partitionBy("change_id").mode("overwrite").json(path)


def write_summary_json(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines as text; file order within a change is line order."""
    report.ordered(lines).select("change_id", "line").write.partitionBy("change_id").mode("overwrite").text(path)


def patch_rows(repairs: DataFrame) -> DataFrame:
    """Patched statements with a file name that is safe and unique."""
    patched = repairs.where((F.col("action") == "patch") & F.col("unified_diff").isNotNull())
    name = text.safe_file_id(F.col("query_id"))
    sql = F.col("rewritten_sql")
    closed = F.when(F.endswith(sql, F.lit("\n")), sql).otherwise(F.concat(sql, F.lit("\n")))
    rows = patched.select(
        "change_id", "query_id", name.alias("file_name"), F.col("unified_diff").alias("patch"), closed.alias("rewritten_sql")
    )
    return rows.where(~F.contains("file_name", F.lit("..")) & ~F.contains("file_name", F.lit("/")))


def write_patches(repairs: DataFrame, path: str) -> None:
    patch_rows(repairs).write.partitionBy("change_id").mode("overwrite").parquet(path)


def write_back(
    descriptions: DataFrame, sections: DataFrame, tags: DataFrame, path: str, enabled: bool = False
) -> None:
    """Write the merged descriptions and tags to a new place; refused unless enabled."""
    if not enabled:
        raise WriteBackDisabled("catalog writes are off; pass enabled=True")
    catalog.upsert_descriptions(descriptions, sections).write.mode("overwrite").parquet(f"{path}/descriptions")
    catalog.upsert_tags(tags, sections).write.mode("overwrite").parquet(f"{path}/tags")
