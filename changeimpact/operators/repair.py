"""Column-rename repairs: rewrite bound references, refuse the rest with a reason.

Decisions are made once per statement shape. The completeness check classifies
the rewritten shape, not every rewritten statement; statements only get the text edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from changeimpact.functions import text
from changeimpact.functions.text import let
from changeimpact.operators import bind, extract
from changeimpact.session import cut

DROP_REASON = "a dropped column has no new name to write"
STAR_REASON = "a star over the subject names no column to rewrite"
DUPLICATE_REASON = "several statements share the query_id"
NO_NODES_REASON = "the hit is in a written column list, which has no bound name to replace"
RESIDUAL_STAR_REASON = "a star may still stand for the old column"


def schema_after(schema_columns: DataFrame, old: str, new: str) -> DataFrame:
    """The schema table as if the rename had landed, in every table that has the column."""
    renamed = F.when(F.lower("column_name") == old.lower(), F.lit(new)).otherwise(F.col("column_name"))
    return schema_columns.withColumn("column_name", renamed)


def _rewritten_shapes(verdicts: DataFrame, changes: DataFrame, dialect: str) -> DataFrame:
    """HARD and SOFT shapes of renames with the bound references replaced."""
    renames = changes.where(F.coalesce("new_column", F.lit("")) != "").select("change_id", "new_column")
    editable = verdicts.where(
        F.col("severity").isin("hard", "soft") & (F.size("piece_numbers") > 0)
    ).join(renames, "change_id")
    edited = text.rename_pieces(F.col("shape"), F.col("piece_numbers"), F.col("new_column"), dialect)
    return editable.select(
        "change_id", "sid", "severity", F.explode(F.array(text.collapse(edited))).alias("new_shape")
    )


def _reclassify(
    rewritten: DataFrame, changes: DataFrame, schema_columns: DataFrame | None, names: list[str] | None
) -> DataFrame:
    """Verdict of each rewritten shape for its own change only."""
    shapes = rewritten.select(
        F.col("change_id").alias("dataset"), F.col("new_shape").alias("shape")
    ).groupBy("dataset", "shape").agg(F.count(F.lit(1)).alias("n_statements"))
    own = bind.prepare_changes(changes).withColumn("dataset", F.col("change_id"))
    verdicts = bind.classify_shapes(
        own, shapes.withColumn("sid", extract.shape_id(F.col("dataset"), F.col("shape"))), schema_columns, names
    )
    return verdicts.select(
        "change_id", F.col("shape").alias("new_shape"),
        F.col("severity").alias("left_severity"), F.col("evidence").alias("left_evidence"),
    )


def repair_decisions(
    verdicts: DataFrame,
    changes: DataFrame,
    schema_columns: DataFrame | None,
    columns: list[str] | None = None,
    dialect: str = "snowflake",
) -> DataFrame:
    """Per (change, shape): patch or refuse, why, and which name pieces to replace.

    Pass stored verdicts: they are read twice, and the check is a classification of its own.
    """
    rewritten = _rewritten_shapes(verdicts, changes, dialect)
    checked = rewritten.join(
        _reclassify(rewritten, changes, schema_columns, columns), ["change_id", "new_shape"], "left"
    ).select("change_id", "sid", "new_shape", "left_severity", "left_evidence")
    names = changes.select("change_id", "new_column")
    df = verdicts.join(names, "change_id").join(checked, ["change_id", "sid"], "left")
    severity, evidence = F.col("severity"), F.col("evidence")
    left = F.coalesce(F.col("left_severity"), F.lit("unaffected"))
    guess = F.concat(
        F.lit("uncertain binding"),
        F.when(F.coalesce("unknown_reason", F.lit("")) != "", F.concat(F.lit(" — "), "unknown_reason")).otherwise(""),
    )
    elsewhere = F.concat(
        F.lit("bound elsewhere — "), F.coalesce(text.cleared_tables(evidence), F.lit("")),
    )
    incomplete = F.concat(
        F.lit("the rewritten statement still refers to the column — "), left, F.lit(" "), "left_evidence"
    )
    reason = (
        F.when(F.coalesce("new_column", F.lit("")) == "", DROP_REASON)
        .when((severity == "unknown") & (evidence == "STAR"), STAR_REASON)
        .when(severity == "unknown", guess)
        .when(text.is_cleared(evidence), elsewhere)
        .when(F.size("piece_numbers") == 0, NO_NODES_REASON)
        .when((left != "unaffected") & (F.col("left_evidence") == "STAR"), RESIDUAL_STAR_REASON)
        .when(left != "unaffected", incomplete)
    )
    return df.withColumn("reason", reason).select(
        "change_id", "sid", "n_statements", "severity", "reason", "piece_numbers", "new_column", "new_shape",
        F.when(F.col("reason").isNull(), "patch").otherwise("refuse").alias("action"),
        F.when(F.coalesce("new_column", F.lit("")) != "", severity).alias("repair_severity"),
    )


def build_repairs(
    decisions: DataFrame, fingerprinted: DataFrame, dialect: str = "snowflake"
) -> DataFrame:
    """One repair per finding: the text edit and its diff, or the reason for none."""
    ids = fingerprinted.groupBy("dataset", "query_id").agg(F.count(F.lit(1)).alias("n"))
    twice = ids.where(F.col("n") > 1).select("dataset", "query_id", F.lit(True).alias("twice"))
    # A duplicated id is refused by its finding, so its findings stay apart.
    marked = fingerprinted.select("sid", "dataset", "query_id", "sql").join(
        twice, ["dataset", "query_id"], "left"
    )
    rows = bind.join_verdicts(marked, decisions.drop("new_shape"))
    duplicate = F.coalesce("twice", F.lit(False))
    patched = (F.col("action") == "patch") & ~duplicate
    sql, query_id = F.col("sql"), F.col("query_id")
    edited = text.rename_pieces(sql, F.col("piece_numbers"), F.col("new_column"), dialect)
    patch = let(
        edited,
        lambda new: F.struct(
            new.alias("rewritten_sql"), unified_diff(sql, new, query_id).alias("unified_diff")
        ),
    )
    # inline() keeps the edit from being copied into whatever reads its columns.
    return rows.select(
        "change_id",
        "query_id",
        F.when(patched, "patch").otherwise("refuse").alias("action"),
        F.when(duplicate, DUPLICATE_REASON).otherwise(F.col("reason")).alias("reason"),
        F.when(duplicate, F.col("severity")).otherwise(F.col("repair_severity")).alias("severity"),
        F.when(duplicate, text.snippet(sql)).otherwise(sql).alias("original_sql"),
        F.inline(F.array(F.when(patched, patch))),
    )


def unified_diff(original: Column, rewritten: Column, query_id: Column, context: int = 3) -> Column:
    """Unified diff of two texts with the same number of lines."""

    def closed(sql: Column) -> Column:
        return F.when(F.endswith(sql, F.lit("\n")), sql).otherwise(F.concat(sql, F.lit("\n")))

    def lines(sql: Column) -> Column:
        every = F.split(closed(sql), "\n")
        return F.slice(every, F.lit(1), F.size(every) - 1)

    def span(hunk: Column) -> Column:
        length = hunk["last"] - hunk["first"] + 1
        return F.when(length == 1, (hunk["first"] + 1).cast("string")).otherwise(
            F.concat((hunk["first"] + 1).cast("string"), F.lit(","), length.cast("string"))
        )

    def hunks(changed: Column, size: Column) -> Column:
        """Line ranges around changed lines; closer than twice the context, they join."""

        def grow(acc: Column, i: Column) -> Column:
            first = F.greatest(i - context, F.lit(0))
            last = F.least(i + context, size - 1)
            tail = F.get(acc, F.size(acc) - 1)
            fresh = F.struct(first.alias("first"), last.alias("last"))
            longer = F.struct(tail["first"].alias("first"), last.alias("last"))
            joins = (F.size(acc) > 0) & (first <= tail["last"] + 1)
            return F.when(
                joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))
            ).otherwise(F.concat(acc, F.array(fresh)))

        return F.aggregate(changed, F.array().cast("array<struct<first:int,last:int>>"), grow)

    def runs(changed: Column, hunk: Column) -> Column:
        """Consecutive changed lines inside a hunk, as ranges."""

        def grow(acc: Column, i: Column) -> Column:
            tail = F.get(acc, F.size(acc) - 1)
            fresh = F.struct(i.alias("first"), i.alias("last"))
            longer = F.struct(tail["first"].alias("first"), i.alias("last"))
            joins = (F.size(acc) > 0) & (i == tail["last"] + 1)
            return F.when(
                joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))
            ).otherwise(F.concat(acc, F.array(fresh)))

        inside = F.filter(changed, lambda i: (i >= hunk["first"]) & (i <= hunk["last"]))
        return F.aggregate(inside, F.array().cast("array<struct<first:int,last:int>>"), grow)

    def some(source: Column, first: Column, last: Column, sign: str) -> Column:
        part = F.slice(source, first + 1, F.greatest(last - first + 1, F.lit(0)))
        return F.array_join(F.transform(part, lambda x: F.concat(F.lit(sign), x, F.lit("\n"))), "")

    def body(a: Column, b: Column, hunk: Column, ranges: Column) -> Column:
        def piece(run: Column, k: Column) -> Column:
            before = F.when(k == 0, hunk["first"]).otherwise(F.get(ranges, k - 1)["last"] + 1)
            return F.concat(
                some(a, before, run["first"] - 1, " "),
                some(a, run["first"], run["last"], "-"),
                some(b, run["first"], run["last"], "+"),
            )

        tail = F.get(ranges, F.size(ranges) - 1)["last"] + 1
        head = F.concat(F.lit("@@ -"), span(hunk), F.lit(" +"), span(hunk), F.lit(" @@\n"))
        return F.concat(
            head, F.array_join(F.transform(ranges, piece), ""), some(a, tail, hunk["last"], " ")
        )

    def of(sides: Column) -> Column:
        a, b = sides["a"], sides["b"]
        differ = F.filter(
            F.transform(a, lambda x, i: F.when(x != F.get(b, i), i)), lambda i: i.isNotNull()
        )
        blocks = let(
            differ,
            lambda changed: F.transform(
                hunks(changed, F.size(a)),
                lambda h: let(runs(changed, h), lambda ranges: body(a, b, h, ranges)),
            ),
        )
        return F.concat(
            F.lit("--- a/"), query_id, F.lit(".sql\n+++ b/"), query_id, F.lit(".sql\n"),
            F.array_join(blocks, ""),
        )

    return let(F.struct(lines(original).alias("a"), lines(rewritten).alias("b")), of)


def refusal_reasons(repairs: DataFrame) -> DataFrame:
    """Refusals by the start of their reason, most frequent first."""
    key = F.substring(F.btrim(F.substring_index("reason", "—", 1)), 1, 48)
    n = F.col("n_statements") if "n_statements" in repairs.columns else F.lit(1)
    return (
        repairs.where(F.col("action") == "refuse")
        .groupBy("change_id", key.alias("reason"))
        .agg(F.sum(n).cast("bigint").alias("n"))
        .orderBy("change_id", F.desc("n"), "reason")
    )


def round_trip(
    decisions: DataFrame, changes: DataFrame, schema_columns: DataFrame, columns: list[str] | None = None
) -> DataFrame:
    """Patched shapes, classified for the old and for the new name.

    A patch passes when nothing is left of the old name and the new name has the
    severity the old one had. For the new name, tables count as carrying it when
    they carry it or the old one: the schema as it is after the rename.
    """
    patched = cut(
        decisions.where(F.col("action") == "patch").select(
            "change_id", "sid", "n_statements", "severity", "new_shape"
        )
    )
    renames = bind.prepare_changes(changes).where(F.coalesce("new_column", F.lit("")) != "")
    landed = renames.select(
        "change_id", "dataset", "kind", "subject", F.col("new_column").alias("column"), "new_column",
        F.col("column").alias("old"),
    )
    old = _reclassify(patched, renames.drop("col"), schema_columns, columns).select(
        "change_id", "new_shape", F.col("left_severity").alias("old_severity")
    )
    after = schema_columns.join(
        landed.select(F.lower("old").alias("_old"), F.col("column").alias("_new")).distinct(),
        F.lower("column_name") == F.col("_old"), "left",
    )
    after = after.select("table_name", F.col("column_name")).unionByName(
        after.where(F.col("_new").isNotNull()).select("table_name", F.col("_new").alias("column_name"))
    )
    new = _reclassify(patched, landed.drop("old"), after, None).select(
        "change_id", "new_shape", F.col("left_severity").alias("new_severity")
    )
    keys = ["change_id", "new_shape"]
    df = patched.join(old, keys, "left").join(new, keys, "left")
    old_gone = F.coalesce("old_severity", F.lit("unaffected")) == "unaffected"
    same = F.coalesce("new_severity", F.lit("unaffected")) == F.col("severity")
    return df.withColumn("passed", old_gone & same).select(
        "change_id", "sid", "n_statements", "severity",
        F.coalesce("old_severity", F.lit("unaffected")).alias("old_severity"),
        F.coalesce("new_severity", F.lit("unaffected")).alias("new_severity"),
        "passed",
    )


def round_trip_summary(trips: DataFrame) -> DataFrame:
    n = F.col("n_statements")
    return trips.groupBy("change_id").agg(
        F.sum(n).alias("n_patched"), F.sum(F.when(F.col("passed"), n).otherwise(0)).alias("n_passed")
    )


def repair_records(repairs: DataFrame) -> DataFrame:
    """Each repair as a JSON record."""
    fields = ["query_id", "action", "reason", "severity", "original_sql", "rewritten_sql", "unified_diff"]
    record = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return repairs.select("change_id", "query_id", record.alias("record"))
