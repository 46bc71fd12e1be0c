"""Readers: statement folders, schema maps, seeded logs, gold labels. Schemas are given, not inferred."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from changeimpact.functions import predicates, text

SEED_SCHEMA = (
    "dataset_urn string, queries array<struct<query_id:string, sql:string, exec_count:bigint>>"
)
GOLD_SCHEMA = "cases array<struct<id:string, case_id:string, stratum:string, gold:string, rationale:string>>"
TABLES_SCHEMA = "map<string,array<string>>"


def read_sql_folder(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Every ``*.sql`` file of a folder is one statement of ``dataset``, its id the file's stem."""
    if not dataset:
        raise ValueError("name the dataset whose changes the statements are to meet")
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.sql")
    log = files.select(
        F.regexp_replace("_metadata.file_name", r"\.sql$", "").alias("query_id"),
        F.col("value").alias("sql"),
        F.lit(dataset).cast("string").alias("dataset"),
    )
    if log.isEmpty():
        raise ValueError(f"no .sql files in {path}")
    return log


def read_sql_tree(
    spark: SparkSession, path: str, table: str, column: str, skipped_folders: tuple[str, ...] = ("tests",)
) -> DataFrame:
    """Statements below ``path`` that mention the table and the column, template markup stripped.

    Files under ``skipped_folders`` are left out; bad bytes become the replacement character.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.sql")
    rows = files.select(F.col("_metadata.file_path").alias("query_id"), F.col("value").alias("raw"))
    skipped = F.rlike("query_id", F.lit(rf"(^|/)({'|'.join(map(re.escape, skipped_folders))})/"))
    return (
        rows.where(~skipped)
        .select(
            "query_id",
            text.strip_templates(F.col("raw")).alias("sql"),
            text.has_templates(F.col("raw")).alias("had_templates"),
        )
        .where(predicates.mentions_table_and_column(F.col("sql"), table, column))
    )


def read_schema_json(spark: SparkSession, path: str) -> DataFrame:
    """A table -> columns map, bare or under ``tables``, as (table_name, column_name) rows."""
    raw = F.col("value")
    tables = F.from_json(F.coalesce(F.get_json_object(raw, "$.tables"), raw), TABLES_SCHEMA)
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(tables).alias("table_name", "columns"))
        .select("table_name", F.explode("columns").alias("column_name"))
    )


def read_seed_json(spark: SparkSession, path: str) -> DataFrame:
    """Seeded statements of one dataset; entries without a statement are dropped.

    Another dataset's changes find no rows here, because statements join on the dataset.
    """
    seed = spark.read.schema(SEED_SCHEMA).json(path, multiLine=True)
    rows = seed.select(F.col("dataset_urn").alias("dataset"), F.inline("queries"))
    return rows.where(F.coalesce("sql", F.lit("")) != "").select(
        F.coalesce(F.nullif("query_id", F.lit("")), F.lit("query")).alias("query_id"),
        "sql", "dataset", "exec_count",
    )


def read_gold(spark: SparkSession, labels_path: str, log: DataFrame) -> DataFrame:
    """Gold labels joined to the labelled statements."""
    labels = spark.read.schema(GOLD_SCHEMA).json(labels_path, multiLine=True)
    cases = labels.select(F.inline("cases")).select(F.col("id").alias("query_id"), "stratum", "gold")
    return cases.join(log, "query_id")
