"""The record of a run: all tables of a rehearsal under one id, seen whole or not at all.

Every table of a run is written to ``<path>/<table>/run_id=<id>``; the manifest, one small file, is written
last and holds each table's row count and an order-free digest, both taken from the stored rows. Readers start from the
manifest, so a run that broke off is not seen, and its id can be written again. A run that is complete is never
written over. Tables of many runs lie beside each other, partitioned by run.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MANIFEST = "run_manifest"
MANIFEST_SCHEMA = "table_name string, n_rows bigint, digest string, run_id string"
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


class RunExists(RuntimeError):
    """Raised when a complete run would be written over."""


class NoSuchRun(RuntimeError):
    """Raised when a run has no manifest: it was never written, or it broke off."""


def _digest(columns: list[str]) -> Column:
    """Sum of row hashes: equal for equal rows in any order and any split into files."""
    rows = F.sum(F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in columns]).cast("decimal(38,0)"))
    return F.coalesce(rows.cast("string"), F.lit("0"))


def _measured(table: DataFrame, name: str) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n_rows"), _digest(table.columns).alias("digest")).select(
        F.lit(name).alias("table_name"), "n_rows", "digest"
    )


def complete_runs(spark: SparkSession, path: str) -> DataFrame:
    """table_name, n_rows, digest, run_id of all complete runs; no rows where none was ever written."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/{MANIFEST}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def is_complete(spark: SparkSession, path: str, run_id: str) -> bool:
    return not complete_runs(spark, path).where(F.col("run_id") == run_id).isEmpty()


def write_run(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """Write ``tables`` as the run ``run_id``; what an attempt that broke off left of it is replaced."""
    spark = next(iter(tables.values())).sparkSession
    for name in (run_id, *tables):
        if not NAME.fullmatch(name) or name == MANIFEST:
            raise ValueError(f"not a name for a run or its tables: {name!r}")
    if is_complete(spark, path, run_id):
        raise RunExists(run_id)
    manifest = None
    for name, table in tables.items():
        place = f"{path}/{name}/run_id={run_id}"
        kept = table.drop("run_id")
        kept.write.mode("overwrite").parquet(place)
        rows = _measured(spark.read.schema(kept.schema).parquet(place), name)
        manifest = rows if manifest is None else manifest.unionByName(rows)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}/run_id={run_id}")


def read_table(spark: SparkSession, path: str, name: str, run_id: str | None = None) -> DataFrame:
    """A table of one complete run, or of all of them; the column ``run_id`` tells which."""
    known = complete_runs(spark, path).where(F.col("table_name") == name)
    if run_id is not None:
        known = known.where(F.col("run_id") == run_id)
    one = known.agg(F.max("run_id")).first()[0]
    if one is None:
        raise NoSuchRun(f"{name} of {run_id or 'any run'} in {path}")
    # The newest id gives the columns; ids stay texts, whatever they look like.
    schema = spark.read.parquet(f"{path}/{name}/run_id={one}").schema.add("run_id", "string")
    rows = spark.read.schema(schema).parquet(f"{path}/{name}")
    if run_id is not None:
        return rows.where(F.col("run_id") == run_id)
    return rows.join(known.select("run_id"), "run_id", "left_semi").select(*schema.names)


def damaged_tables(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Tables of a complete run whose stored rows are no longer those of its manifest."""
    known = complete_runs(spark, path).where(F.col("run_id") == run_id)
    names = sorted(r[0] for r in known.select("table_name").collect())
    if not names:
        raise NoSuchRun(f"{run_id} in {path}")
    found = None
    for name in names:
        rows = _measured(spark.read.parquet(f"{path}/{name}/run_id={run_id}"), name)
        found = rows if found is None else found.unionByName(rows)
    return known.join(found, ["table_name", "n_rows", "digest"], "left_anti").select("table_name")
