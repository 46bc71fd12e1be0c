"""Order, first-of-group and top-n operators that never gather a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from changeimpact.functions import text
from changeimpact.session import cut


def tier(severity: Column) -> Column:
    """HARD, SOFT, UNKNOWN, UNAFFECTED, anything else."""
    order = {"hard": 0, "soft": 1, "unknown": 2, "unaffected": 3}
    chain = F.lit(9)
    for name, place in order.items():
        chain = F.when(severity == name, place).otherwise(chain)
    return chain


def rank_keys(use_exec_count: bool) -> list[Column]:
    keys = [tier(F.col("severity"))]
    if use_exec_count:
        keys.append(F.col("exec_count").desc_nulls_last())
    return [*keys, F.col("query_id")]


def rank_findings(findings: DataFrame, use_exec_count: bool = False) -> DataFrame:
    """Findings of each change in report order: one range-partitioned sort."""
    return findings.orderBy("change_id", *rank_keys(use_exec_count))


def with_position(findings: DataFrame, use_exec_count: bool = False) -> DataFrame:
    """Add each finding's 1-based position within its change.

    The sorted rows are written once, so each file is a slice of the order. A
    position is the number of rows in earlier slices plus the place in its own;
    no window holds more than one slice, even when one change owns most rows.
    """
    keys = rank_keys(use_exec_count)
    slices = cut(rank_findings(findings, use_exec_count)).withColumn(
        "slice", F.spark_partition_id()
    )
    sizes = slices.groupBy("change_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("change_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "change_id", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")
    )
    within = W.partitionBy("change_id", "slice").orderBy(*keys)
    return (
        slices.withColumn("place", F.row_number().over(within))
        .join(starts, ["change_id", "slice"])
        .withColumn("position", F.col("start") + F.col("place"))
        .drop("slice", "place", "start")
    )


def dedupe_statements(log: DataFrame, order: str = "seq", keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Keep the first row per normalised statement, in ``order``.

    min_by combines on the map side, so a statement repeated a billion times
    costs one row per task in the shuffle.
    """
    digest = F.sha2(text.normalize_sql(F.col("sql")), 256)
    row = F.struct(*log.columns)
    return (
        log.groupBy(*keys, digest.alias("_digest"))
        .agg(F.min_by(row, F.col(order)).alias("row"))
        .select("row.*")
    )


def first_per_label(df: DataFrame, limits: dict[str, int], label: str = "label", by: tuple[str, ...] = ("change_id",)) -> DataFrame:
    """The first rows by query id of each label, as many as ``limits`` says.

    The constant bound lets Spark drop surplus rows before the shuffle.
    """
    window = W.partitionBy(*by, label).orderBy("query_id")
    limit = F.lit(0)
    for name, count in limits.items():
        limit = F.when(F.col(label) == name, count).otherwise(limit)
    return (
        df.where(F.col(label).isin(list(limits)))
        .withColumn("example_no", F.row_number().over(window))
        .where(F.col("example_no") <= max(limits.values()))
        .where(F.col("example_no") <= limit)
    )
