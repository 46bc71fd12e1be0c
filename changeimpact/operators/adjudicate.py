"""Rulings on UNKNOWN findings: a rulings table is made, then applied."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from changeimpact.functions import lexicon, predicates, text
from changeimpact.operators import bind
from changeimpact.session import cut

Adjudicator = Callable[[DataFrame], DataFrame]
NAME_LIKE = r"[^\s.,;()'\"`=<>]+"
RULING = ["change_id", "query_id", "severity", "note"]
SHAPE_RULING = "change_id string, sid binary, severity string, note string, failed boolean"
ShapePlugin = Callable[[dict[str, Any]], tuple[str, str | None] | None]


def with_heuristic(findings: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """Add ``r(severity, note)``: bind every UNKNOWN to the subject by its clause, else null.

    Off by default: known to be net-negative. ``fields(change_id, field)`` are the
    subject's fields; without it the changed column is taken to exist.
    """
    if fields is None:
        asked = findings.withColumn("exists", F.lit(True))
    else:
        have = fields.select("change_id", F.lower("field").alias("field")).distinct()
        asked = findings.withColumn("field", F.lower("column")).join(
            have.withColumn("exists", F.lit(True)), ["change_id", "field"], "left"
        )
    clauses = F.transform(F.split(F.upper("evidence"), ","), lambda c: F.btrim(c))
    tick = F.lit("`")
    absent = F.concat(
        F.lit("column "), tick, F.col("column"), tick,
        F.lit(" not in subject schema fields; cannot bind — leave UNKNOWN"),
    )
    hard = F.concat(
        F.lit("bound "), tick, F.col("column"), tick,
        F.lit(" to subject schema (fields include column; clause="), F.col("evidence"),
        F.lit("); treat as HARD pending human confirm"),
    )
    soft = F.concat(
        F.lit("bound "), tick, F.col("column"), tick,
        F.lit(" to subject schema (SELECT-only evidence); treat as SOFT pending human confirm"),
    )
    ruled = (
        F.when(F.col("exists").isNull(), F.struct(F.lit("unknown").alias("severity"), absent.alias("note")))
        .when(
            F.arrays_overlap(clauses, F.array(*[F.lit(c) for c in lexicon.HARD_CLAUSES])),
            F.struct(F.lit("hard").alias("severity"), hard.alias("note")),
        )
        .when(
            F.array_contains(clauses, "SELECT"),
            F.struct(F.lit("soft").alias("severity"), soft.alias("note")),
        )
    )
    return asked.withColumn("r", F.when(F.col("severity") == "unknown", ruled))


def with_fields(findings: DataFrame, fields: DataFrame | None) -> DataFrame:
    """Findings with the heuristic's rulings, made against the subject's fields."""
    return _ruled(with_heuristic(findings, fields))


def heuristic_rulings(findings: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """The heuristic's rulings as a table."""
    ruled = with_heuristic(findings, fields).where(F.col("r").isNotNull())
    return ruled.select("change_id", "query_id", "r.*")


def apply_rulings(findings: DataFrame, rulings: DataFrame) -> DataFrame:
    """Findings with the rulings of a table applied; one ruling per (change, statement id)."""
    ruling = rulings.groupBy("change_id", "query_id").agg(F.min(F.struct("severity", "note")).alias("r"))
    return _ruled(findings.join(ruling, ["change_id", "query_id"], "left"))


def _ruled(joined: DataFrame) -> DataFrame:
    """Only UNKNOWN findings change: HARD or SOFT upgrades, UNKNOWN only leaves its note."""
    joined = joined.withColumns({"ruled": F.col("r.severity"), "ruled_note": F.col("r.note")})
    return _upgraded(joined).select(*bind.FINDING_COLUMNS)


def _upgraded(joined: DataFrame) -> DataFrame:
    unknown = F.col("severity") == "unknown"
    upgraded = unknown & F.coalesce(F.col("ruled").isin("hard", "soft"), F.lit(False))
    noted = unknown & F.coalesce(F.col("ruled") == "unknown", F.lit(False))
    return joined.withColumns(
        {
            "severity": F.when(upgraded, F.col("ruled")).otherwise(F.col("severity")),
            "agent_note": F.when(upgraded, F.col("ruled_note"))
            .when(noted, F.coalesce(F.nullif("ruled_note", F.lit("")), "agent_note"))
            .otherwise(F.col("agent_note")),
            "unknown_reason": F.when(~upgraded, F.col("unknown_reason")),
        }
    )


def residue(findings: DataFrame) -> DataFrame:
    """UNKNOWN findings where a bare column fits several tables."""
    return findings.where(predicates.is_residue(F.col("severity"), F.col("unknown_kind")))


def ruling_requests(findings: DataFrame, log: DataFrame, schema_columns: DataFrame) -> DataFrame:
    """Residue with at least two tables that carry the column and are named in the text, and its key.

    Tables meet statements on their words and the column, both by equality, so a
    column that every table has does not pair every statement with every table.
    Texts are joined once and stored; words are posted under the digest of their text, so a
    text logged under many ids is met with tables once and its candidates fan out by digest.
    """
    per_table = schema_columns.groupBy("table_name").agg(F.collect_set("column_name").alias("columns"))
    carriers = per_table.select(
        "table_name", "columns", F.explode(F.array_distinct(F.transform("columns", F.lower))).alias("col")
    )
    carriers = carriers.withColumn("word", text.base_name(F.col("table_name")))
    texts = cut(
        bind.with_statement_text(residue(findings), log)
        .select("change_id", "query_id", "column", F.lower("column").alias("col"), "sql", F.sha2("sql", 256).alias("digest"))
        .dropDuplicates(["change_id", "query_id", "column", "digest"])
    )
    words = F.array_distinct(F.regexp_extract_all(F.lower("sql"), F.lit(NAME_LIKE), F.lit(0)))
    named = texts.select("digest", "col", F.explode(words).alias("word")).distinct().join(carriers, ["col", "word"])
    table = F.struct(F.col("table_name").alias("table"), F.col("columns"))
    candidates = (
        named.groupBy("digest", "col")
        .agg(F.array_sort(F.collect_list(table)).alias("candidates"))
        .where(F.size("candidates") >= 2)
    )
    return (
        texts.join(candidates, ["digest", "col"])
        .select("change_id", "query_id", "column", "sql", "candidates")
        .withColumn("cache_key", text.cache_key(F.col("sql"), F.col("column"), F.col("candidates")))
    )


def cached_rulings(requests: DataFrame, changes: DataFrame, cache: DataFrame) -> DataFrame:
    """Look requests up in the ruling cache; a ruling counts only if it binds to the subject."""
    subjects = bind.prepare_changes(changes).select("change_id", "subject")
    hit = cache.select(
        "cache_key", F.lower("severity").alias("said"), F.nullif("binds_to", F.lit("")).alias("binds_to"),
        F.coalesce(F.nullif("note", F.lit("")), F.lit("cached ruling")).alias("said_note"),
        F.lit(True).alias("found"),
    )
    df = requests.join(subjects, "change_id").join(hit, "cache_key", "left")
    note = F.when(
        F.col("binds_to").isNotNull(),
        F.concat("said_note", F.lit(" (binds_to="), "binds_to", F.lit(")")),
    ).otherwise(F.col("said_note"))
    strays = F.coalesce(text.base_name(F.col("binds_to")) != F.col("subject"), F.lit(False)) & F.col(
        "binds_to"
    ).isNotNull()

    def ruling(severity: str, words) -> Column:
        return F.struct(F.lit(severity).alias("severity"), words.alias("note"))

    elsewhere = F.concat(F.lit("a ruling for "), "binds_to", F.lit(", not the subject: "), note)
    cleared = F.concat(
        F.lit("a ruling of no effect, bound to "), F.coalesce("binds_to", F.lit("nothing")), F.lit(": "), note
    )
    ruled = (
        F.when(F.col("found").isNull(), ruling("unknown", F.lit("no cached ruling")))
        .when(F.col("said").isin("hard", "soft") & strays, ruling("unknown", elsewhere))
        .when(F.col("said") == "hard", ruling("hard", note))
        .when(F.col("said") == "soft", ruling("soft", note))
        .when(F.col("said") == "unaffected", ruling("unknown", cleared))
        .otherwise(ruling("unknown", note))
    )
    return df.select("change_id", "query_id", ruled.alias("r")).select("change_id", "query_id", "r.*")


def adjudicate(findings: DataFrame, adjudicator: Adjudicator | None = None) -> DataFrame:
    """Apply any function from findings to a rulings table; by default the heuristic, row by row."""
    if adjudicator is None:
        return _ruled(with_heuristic(findings))
    return apply_rulings(findings, adjudicator(findings).select(*RULING))


def shape_requests(verdicts: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """What a plug-in is asked: one row per UNKNOWN (change, shape), however often the shape was logged.

    ``shape`` is the statement with its literals masked, ``tables`` the tables it names, ``fields`` the fields
    of the subject (empty where ``fields(change_id, field)`` has none).
    """
    asked = verdicts.where(F.col("severity") == "unknown").select(
        "change_id", "sid", "shape", "column", "evidence", "unknown_kind", "unknown_reason", "tables"
    )
    if fields is None:
        return asked.withColumn("fields", F.array().cast("array<string>"))
    per_change = fields.groupBy("change_id").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    return asked.join(per_change, "change_id", "left").withColumn(
        "fields", F.coalesce("fields", F.array().cast("array<string>"))
    )


def shape_rulings(requests: DataFrame, plugin: ShapePlugin) -> DataFrame:
    """Rulings of a Python function on ``shape_requests``, in Arrow batches; written once.

    The function gets a request as a dictionary and gives (severity, note), or None for no ruling. A call that
    raises, or gives anything else, is an UNKNOWN ruling that says so and has ``failed`` set; it never ends the
    job. Rulings are written before they are read, so a lost executor asks again for what was not yet
    written only, and two readers never see two answers.
    """
    allowed = ("hard", "soft", "unknown")
    kinds = {"string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    types = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in SHAPE_RULING.split(", "))])

    # Nested, so that it travels with its job and executors need not have this package.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for asked in batch.to_pylist():
                key = {"change_id": asked["change_id"], "sid": asked["sid"]}
                try:
                    said = plugin(asked)
                    if said is None:
                        continue
                    severity, note = said
                    if severity not in allowed or not (note is None or isinstance(note, str)):
                        raise ValueError(f"not a ruling: {said!r}")
                    rows.append({**key, "severity": severity, "note": note, "failed": False})
                except Exception as error:  # whatever a plug-in raises is its answer
                    told = f"no ruling, the plug-in failed: {type(error).__name__}: {error}"
                    rows.append({**key, "severity": "unknown", "note": told, "failed": True})
            columns = [pa.array([row[f.name] for row in rows], f.type) for f in types]
            yield pa.RecordBatch.from_arrays(columns, schema=types)

    return cut(requests.mapInArrow(run, SHAPE_RULING))


def rule_shapes(verdicts: DataFrame, rulings: DataFrame) -> DataFrame:
    """Verdicts with the rulings of their shapes; counts, gates and findings follow from them.

    The same rules hold as for statements: only UNKNOWN ones change. Several rulings of a shape: the smallest.
    """
    ruling = rulings.groupBy("change_id", "sid").agg(F.min(F.struct("severity", "note")).alias("r"))
    joined = verdicts.join(ruling, ["change_id", "sid"], "left").withColumns(
        {"ruled": F.col("r.severity"), "ruled_note": F.col("r.note"), "agent_note": F.lit(None).cast("string")}
    )
    return _upgraded(joined).select(*verdicts.columns, "agent_note")
