"""Catalog tables joined to changes: logs, lineage, owners, sibling schemas, descriptions.

Catalog calls of a one-change tool become joins over many changes; no row caps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from changeimpact.functions import predicates, text


def pull_log(rows: DataFrame) -> DataFrame:
    """Logged statements of catalog query rows (urn, name, sql, dataset): empty ones out, ids filled."""
    given = F.nullif("name", F.lit(""))
    return rows.where(F.coalesce("sql", F.lit("")) != "").withColumn(
        "query_id", F.coalesce(given, F.nullif("urn", F.lit("")), F.lit("query"))
    ).drop("name", "urn")


def prefer_log(log: DataFrame, seed: DataFrame, force_seed: bool = False) -> DataFrame:
    """The indexed log; seed statements only for datasets the log has no rows for, or when forced."""
    if force_seed:
        return seed
    logged = log.select("dataset").distinct()
    return log.unionByName(seed.join(logged, "dataset", "left_anti"), allowMissingColumns=True)


def list_fields(schema_fields: DataFrame) -> DataFrame:
    return schema_fields.where(F.coalesce("field_path", F.lit("")) != "")


def downstream(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """One-hop dependents of each changed dataset; a dataset is not its own dependent."""
    return (
        changes.select("change_id", "dataset")
        .join(edges, F.col("dataset") == F.col("upstream"))
        .where(F.col("downstream") != F.col("dataset"))
        .select("change_id", "downstream")
        .distinct()
    )


def lineage_counts(dependents: DataFrame) -> DataFrame:
    return dependents.groupBy("change_id").agg(F.count(F.lit(1)).alias("lineage_dependent_count"))


def given_counts(baseline: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Dependents as given by the user; counted ones, if any, where nothing is given for a change."""
    given = baseline.where(F.col("lineage_dependent_count").isNotNull()).groupBy("change_id").agg(
        F.max("lineage_dependent_count").cast("bigint").alias("lineage_dependent_count")
    )
    if counts is None:
        return given
    return given.unionByName(counts.join(given, "change_id", "left_anti"))


def owners_of(owners: DataFrame) -> DataFrame:
    """Owners per dataset, in a fixed order; an ownership list is small by nature."""
    return (
        owners.where(F.coalesce("owner", F.lit("")) != "")
        .groupBy("urn")
        .agg(F.array_sort(F.collect_set("owner")).alias("owners"))
    )


def description_of(descriptions: DataFrame) -> DataFrame:
    """Edited text, else the source's own text, else empty."""
    shown = F.coalesce(F.nullif("editable", F.lit("")), F.nullif("properties", F.lit("")), F.lit(""))
    return descriptions.select("urn", shown.alias("description"))


def invalid_changes(changes: DataFrame, schema_fields: DataFrame, log: DataFrame) -> DataFrame:
    """Changes that cannot be rehearsed, each with the first reason that applies."""
    fields = list_fields(schema_fields).select(
        F.col("urn").alias("dataset"), "field_path", F.lower(text.last_part(F.col("field_path"))).alias("bare")
    )
    with_fields = fields.select("dataset").distinct().withColumn("has_fields", F.lit(True))
    # The name fits a field's last part in any case, or a whole path exactly.
    matching = fields.select("dataset", F.col("bare").alias("key")).unionByName(
        fields.select("dataset", F.col("field_path").alias("key"))
    ).distinct()
    named = changes.select(
        "change_id", "dataset",
        F.explode(F.array(F.lower("column"), F.col("column"))).alias("key"),
    )
    present = named.join(matching, ["dataset", "key"], "left_semi").select("change_id").distinct().withColumn(
        "has_column", F.lit(True)
    )
    logged = log.select("dataset").distinct().withColumn("has_queries", F.lit(True))
    df = (
        changes.join(with_fields, "dataset", "left")
        .join(present, "change_id", "left")
        .join(logged, "dataset", "left")
    )
    reason = (
        F.when(~F.coalesce(F.col("kind").isin("rename", "drop"), F.lit(False)), "change_kind must be 'rename' or 'drop'")
        .when(~predicates.is_valid_change(F.col("kind"), F.col("new_column")), "new_name required for rename")
        .when(F.col("has_fields").isNull(), F.concat(F.lit("no schema fields for "), "dataset"))
        .when(
            F.col("has_column").isNull(),
            F.concat(F.lit("column `"), "column", F.lit("` not in schema for "), "dataset"),
        )
        .when(F.col("has_queries").isNull(), F.concat(F.lit("no queries for "), "dataset"))
    )
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("change_id", "reason")


def subject_fields(changes: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """change_id, field: last parts of the field paths of each change's dataset."""
    fields = list_fields(schema_fields).select(
        F.col("urn").alias("dataset"), text.last_part(F.col("field_path")).alias("field")
    )
    return changes.select("change_id", "dataset").join(fields.distinct(), "dataset").select("change_id", "field")


def best_datasets(wanted: DataFrame, datasets: DataFrame) -> DataFrame:
    """Best dataset per (change, table): same platform, then shared path, then URN order.

    ``wanted(change_id, dataset, table_name)``, ``datasets(urn)``. Same-named datasets and
    changes are never paired. Changes are reduced to classes (base, platform, parent
    path); datasets to the best one under each key a class can ask for: with and without
    the platform, with and without a prefix of their path, cut at the lengths that parents
    of that base name have. Both sides meet on equal keys, where the datasets' side has one row.
    """
    urn = F.col("urn")
    known = datasets.select(
        "urn", F.lower(text.urn_platform(urn)).alias("platform"), F.lower(text.urn_name(urn)).alias("name")
    ).where(F.col("name").isNotNull()).withColumn("base", text.base_name(F.col("name")))
    subject = F.col("dataset")
    path = F.lower(text.urn_name(subject))
    parent = F.when(F.contains(path, F.lit(".")), F.regexp_replace(path, r"\.[^.]*$", "")).otherwise(path)
    asked = (
        wanted.select(
            "change_id", text.base_name(F.col("table_name")).alias("base"),
            F.lower(text.urn_platform(subject)).alias("platform"), parent.alias("parent"),
        )
        .where(F.col("base") != "")
        .distinct()
    )
    classes = asked.select("base", "platform", "parent").distinct()

    def under(platform: Column, prefix: Column, points: int) -> Column:
        return F.struct(platform.alias("key_platform"), prefix.alias("key_prefix"), F.lit(points).alias("points"))

    own, any_one = F.col("platform"), F.lit("")
    lengths = classes.select("base", F.length("parent").alias("n")).distinct()
    cut_paths = known.join(lengths, "base").where(F.col("n") <= F.length("name"))
    prefix = F.left(F.col("name"), F.col("n"))
    dotted = F.when(F.contains("name", F.lit(".")), 1).otherwise(0).alias("dotted")
    offers = known.select(
        "base", "urn", dotted, F.inline(F.array(under(own, any_one, 10), under(any_one, any_one, 0)))
    ).unionByName(
        cut_paths.select("base", "urn", dotted, F.inline(F.array(under(own, prefix, 15), under(any_one, prefix, 5))))
    )
    key = ["base", "key_platform", "key_prefix", "points"]
    offered = offers.groupBy(*key).agg(F.min(F.struct((-F.col("dotted")).alias("order"), "urn")).alias("offer"))
    wishes = classes.select(
        "*",
        F.inline(F.array(
            under(own, F.col("parent"), 15), under(own, any_one, 10),
            under(any_one, F.col("parent"), 5), under(any_one, any_one, 0),
        )),
    )
    # A key with fewer points than its dataset deserves never wins: the same dataset is offered under the fuller key too.
    order = (F.col("offer.order") - F.col("points")).alias("order")
    best = (
        wishes.join(offered, key)
        .groupBy("base", "platform", "parent")
        .agg(F.min(F.struct(order, F.col("offer.urn").alias("urn"))).alias("best"))
    )
    same = F.col("a.base").eqNullSafe(F.col("b.base"))
    for name in ("platform", "parent"):
        same &= F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    return (
        asked.alias("a").join(best.alias("b"), same)
        .groupBy("change_id", F.col("a.base").alias("table_name"))
        .agg(F.min("best").alias("best"))
        .select("change_id", "table_name", "best.urn", (-F.col("best.order")).alias("score"))
    )


def sibling_schemas(
    changes: DataFrame, named_tables: DataFrame, datasets: DataFrame, schema_fields: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Schema columns per change, and the tables that could not be resolved.

    ``named_tables(change_id, table_name)``: distinct tables of the change's statements.
    """
    subject = F.lower(text.subject_table(F.col("dataset")))
    subjects = changes.select("change_id", "dataset", subject.alias("table_name"))
    named = named_tables.select("change_id", text.base_name(F.col("table_name")).alias("table_name")).distinct()
    siblings = named.join(subjects.select("change_id", "table_name"), ["change_id", "table_name"], "left_anti")
    picked = best_datasets(siblings.join(changes.select("change_id", "dataset"), "change_id"), datasets)
    tables = picked.select("change_id", "table_name", "urn").unionByName(
        subjects.select("change_id", "table_name", F.col("dataset").alias("urn"))
    )
    columns = (
        tables.join(list_fields(schema_fields), "urn")
        .select("change_id", "table_name", text.last_part(F.col("field_path")).alias("column_name"))
        .distinct()
    )
    unresolved = siblings.join(
        columns.select("change_id", "table_name").distinct(), ["change_id", "table_name"], "left_anti"
    )
    return columns, unresolved


def notify_targets(
    changes: DataFrame, dependents: DataFrame, owners: DataFrame, worst: DataFrame
) -> DataFrame:
    """Subject and dependents with their owners and the change's worst severity."""
    subjects = changes.select("change_id", F.col("dataset").alias("urn"), F.lit("subject").alias("role"))
    others = dependents.select(
        "change_id", F.col("downstream").alias("urn"), F.lit("downstream").alias("role")
    ).join(subjects.select("change_id", "urn"), ["change_id", "urn"], "left_anti").distinct()
    return (
        subjects.unionByName(others)
        .join(owners_of(owners), "urn", "left")
        .join(worst, "change_id", "left")
        .select(
            "change_id", "urn", "role",
            F.coalesce("owners", F.array().cast("array<string>")).alias("owners"), "worst_severity",
        )
    )


def upsert_descriptions(descriptions: DataFrame, sections: DataFrame) -> DataFrame:
    """Current descriptions with the managed section of ``sections(urn, title, body)`` replaced."""
    new = sections.select("urn", text.section_text(F.col("title"), F.col("body")).alias("section"))
    joined = description_of(descriptions).join(new, "urn", "full")
    merged = F.when(
        F.col("section").isNotNull(), text.merge_section(F.col("description"), F.col("section"))
    ).otherwise(F.col("description"))
    return joined.select("urn", merged.alias("description"))


def upsert_tags(tags: DataFrame, urns: DataFrame, tag: str = text.FORECAST_TAG) -> DataFrame:
    return tags.select("urn", "tag").unionByName(urns.select("urn", F.lit(tag).alias("tag"))).dropDuplicates(
        ["urn", "tag"]
    )

