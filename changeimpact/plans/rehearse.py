"""Whole rehearsals: many changes over a query log, from catalog tables or given schemas."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from changeimpact.operators import adjudicate, bind, catalog, extract, findings, ranking, repair, report
from changeimpact.session import cut


@dataclass
class Rehearsal:
    """Lazily built results. Verdicts are written once; everything else reads them."""

    changes: DataFrame
    log: DataFrame
    schema_columns: DataFrame | None
    columns: list[str] | None = None
    dependents: DataFrame | None = None
    adjudicator: adjudicate.Adjudicator | None = None  # None: no rulings
    dialect: str = "snowflake"
    use_subject: bool = True
    facts: DataFrame | None = None
    plugin: adjudicate.ShapePlugin | None = None  # a Python function that rules UNKNOWN shapes
    heuristic: bool = False  # bind UNKNOWN findings to the subject by their clause
    fields: DataFrame | None = None  # change_id, field: the subject's fields, for rulings
    baseline: DataFrame | None = None  # change_id, lineage_dependent_count as given by the user
    names: list[str] | None = None  # all names whose places shapes must keep; None: shapes are kept whole

    @cached_property
    def statements(self) -> DataFrame:
        """The log with whole shapes, which plug-ins are asked about."""
        return extract.fingerprint_log(self.log, self.dialect)

    @cached_property
    def narrowed(self) -> DataFrame:
        """The log with the shapes that verdicts and repairs are made for."""
        return extract.narrow_shapes(self.statements, self.names)

    @cached_property
    def shapes(self) -> DataFrame:
        return extract.distinct_shapes(self.narrowed)

    @cached_property
    def verdicts(self) -> DataFrame:
        if self.facts is not None:
            ruled = bind.classify_facts(self.facts, self.changes, self.schema_columns, self.use_subject)
        else:
            ruled = bind.classify_shapes(
                self.changes, self.shapes, self.schema_columns, self.columns, self.use_subject
            )
        return cut(ruled)

    @cached_property
    def shape_verdicts(self) -> DataFrame:
        """The verdicts of whole shapes; written once."""
        whole = extract.distinct_shapes(self.statements).withColumnRenamed("sid", "whole_sid")
        kept = whole.withColumn("whole", F.col("shape"))
        return cut(bind.verdicts_of_shapes(extract.narrow_shapes(kept, self.names), self.verdicts))

    @cached_property
    def shape_rulings(self) -> DataFrame:
        """The plug-in's answers, one per UNKNOWN (change, shape)."""
        return adjudicate.shape_rulings(adjudicate.shape_requests(self.shape_verdicts, self.fields), self.plugin)

    @cached_property
    def ruled_verdicts(self) -> DataFrame:
        return self.verdicts if self.plugin is None else adjudicate.rule_shapes(self.shape_verdicts, self.shape_rulings)

    @cached_property
    def findings(self) -> DataFrame:
        statements = self.narrowed if self.plugin is None else self.statements
        found = bind.findings_of(statements, self.ruled_verdicts)
        if self.heuristic:
            found = adjudicate.with_fields(found, self.fields)
        return found if self.adjudicator is None else adjudicate.adjudicate(found, self.adjudicator)

    @cached_property
    def stored_findings(self) -> DataFrame:
        """The findings written once, for several reports to read."""
        return cut(self.findings)

    @cached_property
    def counted(self) -> DataFrame:
        """What counts are taken from: shape verdicts, unless rulings changed single statements."""
        if self.adjudicator is None and not self.heuristic:
            return self.ruled_verdicts
        return self.findings

    @cached_property
    def summary(self) -> DataFrame:
        lineage = None if self.dependents is None else catalog.lineage_counts(self.dependents)
        if self.baseline is not None:
            lineage = catalog.given_counts(self.baseline, lineage)
        totals = findings.statement_totals(self.log)
        return findings.forecast_summary(self.changes, totals, self.counted, lineage)

    def gate(self, fail_on: str = "hard,unknown") -> DataFrame:
        return findings.gate(self.changes, self.counted, fail_on, findings.statement_totals(self.log))

    @cached_property
    def worst(self) -> DataFrame:
        return findings.worst_severity(self.changes, self.counted)

    @cached_property
    def decisions(self) -> DataFrame:
        return cut(
            repair.repair_decisions(
                self.verdicts, self.changes, self.schema_columns, self.columns, self.dialect
            )
        )

    @cached_property
    def repairs(self) -> DataFrame:
        return repair.build_repairs(self.decisions, self.narrowed, self.dialect)

    def notify(self, owners: DataFrame) -> DataFrame:
        return catalog.notify_targets(self.changes, self.dependents, owners, self.worst)

    def report(self, notify: DataFrame | None = None, **options) -> DataFrame:
        lines = None if notify is None else report.notify_lines(notify)
        return report.report_lines(
            self.changes, self.summary, self.stored_findings, notify=lines, baseline=self.baseline, **options
        )

    def tables(
        self, fail_on: str = "hard,unknown", descriptions: DataFrame | None = None, **options
    ) -> dict[str, DataFrame]:
        """The tables that record this run, each with its ``change_id``; see ``sources.runs``."""
        record = {
            "changes": self.changes, "summary": self.summary, "gate": self.gate(fail_on),
            "findings": self.stored_findings, "repairs": self.repairs, "report": self.report(**options),
        }
        if descriptions is not None:
            record["payload"] = report.write_payload(self.changes, self.summary, descriptions)
        if self.dependents is not None:
            record["dependents"] = self.dependents
        if self.plugin is not None:
            record["rulings"] = self.shape_rulings
        return record


def changed_names(changes: DataFrame, limit: int = extract.PREFILTER_LIMIT) -> list[str] | None:
    """The changed column names when they are few enough to filter by, else None."""
    names = [r[0] for r in changes.select(F.lower("column")).distinct().limit(limit + 1).collect()]
    return None if len(names) > limit else sorted(names)


def kept_names(changes: DataFrame, limit: int = extract.PREFILTER_LIMIT) -> list[str] | None:
    """The changed names with the new ones, whose places repairs are checked at, when they are few, else None."""
    columns = [c for c in ("column", "new_column") if c in changes.columns]
    every = changes.select(F.explode(F.array(*columns)).alias("column")).where(F.col("column").isNotNull())
    return changed_names(every, limit)


def rehearse(
    changes: DataFrame,
    log: DataFrame,
    schema_columns: DataFrame | None = None,
    adjudicator: adjudicate.Adjudicator | None = None,
    **options,
) -> Rehearsal:
    """Rehearsal against given schemas."""
    options.setdefault("names", kept_names(changes))
    return Rehearsal(changes, log, schema_columns, changed_names(changes), adjudicator=adjudicator, **options)


def rehearse_from_catalog(
    changes: DataFrame,
    log: DataFrame,
    datasets: DataFrame,
    schema_fields: DataFrame,
    edges: DataFrame,
    adjudicator: adjudicate.Adjudicator | None = None,
    order: str = "seq",
    dialect: str = "snowflake",
    **options,
) -> tuple[Rehearsal, DataFrame, DataFrame]:
    """Rehearsal against catalog tables; also the rejected changes and the unresolved tables.

    The log is deduplicated by statement first; sibling schemas come from the
    tables the statements name, and rulings get the fields of the changed dataset.
    """
    rejected = catalog.invalid_changes(changes, schema_fields, log)
    valid = changes.join(rejected.select("change_id"), "change_id", "left_anti")
    kept = ranking.dedupe_statements(log, order)
    marked = extract.fingerprint_log(kept, dialect)
    names, places = changed_names(valid), kept_names(valid)
    # Table names and verdicts both read the facts, so they are written once.
    facts = cut(
        extract.expand_ctes(
            extract.statement_facts(extract.distinct_shapes(extract.narrow_shapes(marked, places)), names, every_shape=True)
        )
    )
    named = (
        facts.select("dataset", F.explode("tables").alias("table_name"))
        .distinct()
        .join(valid.select("change_id", "dataset"), "dataset")
        .select("change_id", "table_name")
    )
    columns, unresolved = catalog.sibling_schemas(valid, named, datasets, schema_fields)
    dependents = catalog.downstream(valid, edges)
    fields = catalog.subject_fields(valid, schema_fields)
    run = Rehearsal(
        valid, marked, columns, names, dependents, adjudicator, dialect=dialect, facts=facts, fields=fields,
        names=places, **options
    )
    return run, rejected, unresolved
