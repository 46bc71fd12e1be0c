"""Bind column references to tables and give every (change, statement shape) one verdict.

Changes meet statements on the dataset they were logged for and the changed name,
schemas meet candidate tables on the base name; what is left per pair is a row-local
decision over the few facts of one statement, so it needs no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from changeimpact.functions import lexicon, text
from changeimpact.functions.text import let
from changeimpact.operators import extract
from changeimpact.session import cut

STAR_REASON = "a star over the subject may stand for the column"
FINDING_COLUMNS = [
    "change_id", "query_id", "sql_snippet", "severity", "column", "evidence", "exec_count",
    "agent_note", "unknown_reason", "unknown_kind",
]
PAYLOAD = [
    "dataset", "shape", "n_statements", "column", "col", "subject", "unreadable", "mentions",
    "aliases", "tables", "derived", "unnested", "hits", "strays", "stars", "writes", "places", "naturals", "text_sid",
]
REF_FIELDS = ["pos", "name", "qual", "clause", "scope", "sel_end", "barrier", "piece_no", "using", "item", "folded"]
# What stands first rules a text of several statements.
TIERS = ["unknown", "hard", "soft", "unaffected"]


def prepare_changes(changes: DataFrame, use_subject: bool = True) -> DataFrame:
    """Add the compared column name and the subject's base table name."""
    dataset = F.col("dataset")
    if "subject" in changes.columns:
        return changes.withColumn("col", F.lower("column"))
    subject = F.when(
        F.contains(dataset, F.lit(",")), F.lower(text.subject_table(dataset))
    ).otherwise(text.base_name(dataset))
    return changes.withColumns(
        {
            "col": F.lower("column"),
            "subject": F.nullif(subject, F.lit("")) if use_subject else F.lit(None).cast("string"),
        }
    )


def schema_tables(schema_columns: DataFrame, changes: DataFrame) -> DataFrame:
    """Per base table name, which of the changed columns it has (an empty list: none).

    Tables that share a base name are one table with the union of their columns.
    """
    keys = [c for c in ("change_id",) if c in schema_columns.columns]
    changed = changes.select(F.lower("column").alias("changed")).distinct()
    named = schema_columns.select(
        *keys,
        text.base_name(F.col("table_name")).alias("table"),
        F.lower("column_name").alias("column_name"),
    )
    return (
        named.join(changed, F.col("column_name") == F.col("changed"), "left")
        .groupBy(*keys, "table")
        .agg(F.collect_set("changed").alias("has"))
    )


def pair_with_changes(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """(change, shape) pairs that can yield a finding, with the matching references."""
    wanted = changes.select("change_id", "dataset", "column", "col", "subject")

    def named(r: Column) -> Column:
        return (r["name"] == F.col("col")) | F.coalesce(F.array_contains(r["path"], F.col("col")), F.lit(False))

    qualifiers = F.concat(F.transform("aliases", lambda a: a["key"]), "derived", "unnested")
    paired = facts.join(wanted, "dataset").withColumns({"hits": F.filter("refs", named), "strays": F.filter("strays", named)})
    on_paths = F.exists("hits", lambda r: r["path"].isNotNull())
    resolved = let(qualifiers, lambda keys: F.transform("hits", lambda r: _along_path(r, keys)))
    plain = F.transform("hits", lambda r: F.struct(*[r[f].alias(f) for f in REF_FIELDS]))
    paired = paired.withColumn("hits", F.when(on_paths, F.filter(resolved, lambda r: r.isNotNull())).otherwise(plain))
    written = F.exists("writes", lambda w: w["name"] == F.col("col"))
    return paired.where(
        (F.size("hits") > 0) | (F.size("strays") > 0) | (F.size("stars") > 0) | (F.size("naturals") > 0)
        | written | F.col("unreadable").isNotNull()
    )


def _along_path(ref: Column, qualifiers: Column) -> Column:
    """A reference to the changed column, at the first part of a dotted name that can be that column; null if none can.

    What stands before the column are table parts, what follows are fields. A part that is a table or alias of the
    statement is the column only behind another one. A last part of the column's name counts as before.
    """
    path, col = ref["path"], F.col("col")

    def may_be(i: Column) -> Column:
        part, owner = F.get(path, i), F.get(path, i - 1)
        behind = F.coalesce(F.array_contains(qualifiers, owner), F.lit(False))
        return (part == col) & (behind | ~F.array_contains(qualifiers, part))

    def at(places: Column) -> Column:
        i = F.get(places, F.lit(0))
        moved = {"name": col, "qual": F.get(path, i - 1), "piece_no": ref["piece_no"] - (F.size(path) - 1 - i)}
        fields = F.struct(*[(moved.get(f, ref[f])).alias(f) for f in REF_FIELDS])
        own = F.struct(*[ref[f].alias(f) for f in REF_FIELDS])
        return F.when(i.isNotNull(), fields).when(ref["name"] == col, own)

    inner = F.when(F.size(path) > 1, F.filter(F.sequence(F.lit(0), F.size(path) - 2), may_be)).otherwise(F.array().cast("array<int>"))
    return let(inner, at)


def attach_schemas(pairs: DataFrame, tables: DataFrame | None) -> DataFrame:
    """Add ``known`` (candidate tables with a schema) and ``carrying`` (those with the column)."""
    if tables is None:
        none = F.array().cast("array<string>")
        return pairs.select("change_id", "sid", *PAYLOAD, none.alias("known"), none.alias("carrying"))
    qualifiers = F.filter(F.transform("hits", lambda r: r["qual"]), lambda q: q.isNotNull())
    candidates = F.array_union("tables", qualifiers)
    payload = F.when(F.coalesce("at", F.lit(0)) == 0, F.struct(*PAYLOAD))
    exploded = pairs.select(
        "change_id", "sid", *PAYLOAD, F.posexplode_outer(candidates).alias("at", "table")
    ).select("change_id", "sid", "col", "table", payload.alias("payload"))
    keys = [c for c in ("change_id",) if c in tables.columns]
    has_column = F.array_contains("has", F.col("col"))
    # A pair without candidates gets a key of its own, so such pairs do not share one task.
    exploded = exploded.withColumn("table", F.coalesce("table", F.hex("sid")))
    return (
        exploded.join(tables, [*keys, "table"], "left")
        .groupBy("change_id", "sid")
        .agg(
            F.first("payload", ignorenulls=True).alias("payload"),
            F.collect_set(F.when(F.col("has").isNotNull(), F.col("table"))).alias("known"),
            F.collect_set(F.when(has_column, F.col("table"))).alias("carrying"),
        )
        .select("change_id", "sid", "payload.*", "known", "carrying")
    )


def _tables_in_scope(ref: Column) -> Column:
    """Base tables of the reference's SELECT, else those of the whole statement."""
    inside = F.filter(
        "mentions",
        lambda m: (m["barrier"] == ref["barrier"])
        & (m["pos"] > ref["scope"])
        & (m["pos"] < ref["sel_end"]),
    )
    return F.array_distinct(F.flatten(F.transform(inside, lambda m: m["tables"])))


def _scope_or_statement(ref: Column) -> Column:
    return let(
        F.when(ref["scope"].isNotNull(), _tables_in_scope(ref)),
        lambda own: F.when(F.size(F.coalesce(own, F.array())) > 0, own).otherwise(F.col("tables")),
    )


def _alias(name: Column) -> Column:
    return F.get(F.filter("aliases", lambda a: a["key"] == name), F.lit(0))


def _by_place(ref: Column) -> Column:
    """Clauses that name the item of the select list in which the reference stands by its place."""
    same = F.filter("places", lambda p: p["scope"].isNull() | (p["scope"] == ref["scope"]))
    meant = F.filter(
        same,
        lambda p: (p["item"] == ref["item"])
        | ((p["item"] == extract.ALL_ITEMS) & ~((p["clause"] == "GROUP") & ref["folded"])),
    )
    none = F.array().cast("array<string>")
    return F.when((F.size("places") > 0) & (ref["clause"] == "SELECT"), F.transform(meant, lambda p: p["clause"])).otherwise(none)


def _place_unread(ref: Column) -> Column:
    """Whether a place cannot be told: its number is masked, or a star stands before the item."""
    unread = F.exists(
        "places",
        lambda p: (p["scope"].isNull() | (p["scope"] == ref["scope"])) & (p["item"] != extract.ALL_ITEMS)
        & ((p["item"] == extract.UNREAD_ITEM) | (ref["item"] == 0)),
    )
    return (F.size("places") > 0) & (ref["clause"] == "SELECT") & F.coalesce(unread, F.lit(False))


def _outcome(ref: Column, state: str, kind=None, reason=None, elsewhere=None, also=None) -> Column:
    return F.struct(
        F.lit(state).alias("state"),
        F.lit(kind).cast("string").alias("kind"),
        (F.lit(None) if reason is None else reason).cast("string").alias("reason"),
        ref["clause"].alias("clause"),
        ref["piece_no"].alias("piece_no"),
        (F.array() if elsewhere is None else elsewhere).cast("array<string>").alias("elsewhere"),
        (F.array() if also is None else also).cast("array<string>").alias("also"),
    )


def _decide(ref: Column, scope: Column, has_schema: bool) -> Column:
    """What one reference is bound to; see the verdict rules in the README."""
    qual, subject = ref["qual"], F.col("subject")
    tick = F.lit("`")
    unread = F.concat(F.lit("a place in GROUP BY or ORDER BY may name `"), F.col("column"), F.lit("`"))
    bound = F.when(_place_unread(ref), _outcome(ref, "unknown", "place", unread)).otherwise(_outcome(ref, "bound", also=_by_place(ref)))

    def crowded(n: Column) -> Column:
        return F.concat(
            tick, F.col("column"), F.lit("` without a qualifier fits "), n.cast("string"), F.lit(" tables in scope"),
        )

    def unresolved(name: Column) -> Column:
        return F.concat(F.lit("qualifier "), tick, name, F.lit("` leads to no known table"))

    def without_subject(candidates: Column) -> Column:
        def stuck(name: Column) -> Column:
            local = F.array_contains("unnested", name) | F.array_contains("derived", name)
            placed = _alias(name).isNotNull() | F.array_contains("tables", name)
            return local | placed | ~F.array_contains(scope, subject)

        unknown = F.array_sort(F.array_except(candidates, F.col("known")))
        return let(
            F.struct(unknown.alias("unknown"), F.get(F.filter(unknown, stuck), F.lit(0)).alias("first")),
            lambda u: F.when(
                u["first"].isNotNull(),
                _outcome(ref, "unknown", "unresolvable_qualifier", unresolved(u["first"])),
            )
            .when(F.size(u["unknown"]) > 0, bound)
            .otherwise(_outcome(ref, "elsewhere", elsewhere=candidates)),
        )

    def among_several(candidates: Column) -> Column:
        if not has_schema:
            narrowed, missing = candidates, F.array().cast("array<string>")
        else:
            narrowed = F.array_intersect(candidates, F.col("carrying"))
            missing = F.array_sort(F.array_except(candidates, F.col("known")))
        listed = F.concat(F.lit("no schema for "), F.array_join(missing, ", "))
        mine = F.array_contains(narrowed, subject)
        return (
            F.when(F.size(missing) > 0, _outcome(ref, "unknown", "unresolved_table", listed))
            .when((F.size(narrowed) >= 2) & (ref["clause"] == "SET") & mine, bound)
            .when(
                F.size(narrowed) >= 2,
                _outcome(ref, "unknown", "ambiguous_bare", crowded(F.size(narrowed))),
            )
            .when(mine, bound)
            .otherwise(_outcome(ref, "dropped"))
        )

    def among(candidates: Column) -> Column:
        return (
            F.when(~F.array_contains(candidates, subject), without_subject(candidates))
            .when(F.size(candidates) == 1, bound)
            .otherwise(among_several(candidates))
        )

    shadowed = F.concat(F.lit("alias "), tick, qual, F.lit("` names different tables in different scopes"))
    unbound = F.concat(tick, F.col("column"), F.lit("` has no table in scope to belong to"))
    candidates = F.when(qual.isNull(), F.when(F.size(scope) > 0, scope)).otherwise(
        F.coalesce(_alias(qual)["tables"], F.array(qual))
    )
    in_using = subject.isNull() | F.array_contains(scope, subject)
    return (
        F.when(ref["using"], F.when(in_using, _outcome(ref, "using")).otherwise(_outcome(ref, "dropped")))
        .when(
            F.coalesce(_alias(qual)["shadowed"], F.lit(False)),
            _outcome(ref, "unknown", "alias_shadowed", shadowed),
        )
        .when(
            subject.isNull() & qual.isNull() & (F.size(scope) > 1),
            _outcome(ref, "unknown", "ambiguous_bare", crowded(F.size(scope))),
        )
        .when(subject.isNull(), bound)
        .when(candidates.isNull(), _outcome(ref, "unknown", "unbound", unbound))
        .otherwise(let(candidates, among))
    )


def _natural(join: Column) -> Column:
    """What a NATURAL JOIN does with the column: it joins on every column that both of its sides have."""
    subject = F.col("subject")
    inside = F.filter(
        "mentions",
        lambda m: (m["barrier"] == join["barrier"]) & (m["pos"] > join["scope"]) & (m["pos"] < join["sel_end"]),
    )

    def of(sides: Column) -> Column:
        left, right = sides["left"], sides["right"]
        both = F.array_union(left, right)

        def has(side: Column) -> Column:
            return F.exists(side, lambda t: F.coalesce(t == subject, F.lit(False)) | F.array_contains("carrying", t))

        def may(side: Column) -> Column:
            return has(side) | F.exists(side, lambda t: ~F.array_contains("known", t)) | (F.size(side) == 0)

        missing = F.array_sort(F.filter(both, lambda t: ~F.array_contains("known", t) & F.coalesce(t != subject, F.lit(True))))
        reason = F.concat(F.lit("no schema for "), F.array_join(missing, ", "))
        met = F.struct(F.lit("JOIN").alias("clause"), join["piece_no"].alias("piece_no"))
        concerned = subject.isNull() | F.array_contains(both, subject) | (F.size(left) == 0) | (F.size(right) == 0)
        return (
            F.when(concerned & has(left) & has(right), _outcome(met, "using"))
            .when(concerned & may(left) & may(right), _outcome(met, "unknown", "unresolved_table", reason))
            .otherwise(_outcome(met, "dropped"))
        )

    def sides(own: Column) -> Column:
        before = F.filter(own, lambda m: m["pos"] < join["pos"])
        after = F.slice(F.filter(own, lambda m: m["pos"] > join["pos"]), 1, 1)
        return F.struct(
            F.array_distinct(F.flatten(F.transform(before, lambda m: m["tables"]))).alias("left"),
            F.array_distinct(F.flatten(F.transform(after, lambda m: m["tables"]))).alias("right"),
        )

    return let(let(inside, sides), of)


def bind_references(pairs: DataFrame, has_schema: bool) -> DataFrame:
    outcomes = F.transform(
        "hits", lambda r: let(_scope_or_statement(r), lambda scope: _decide(r, scope, has_schema))
    )
    implied = F.transform("naturals", _natural)
    in_order = F.array_sort(F.concat(outcomes, implied), lambda a, b: (a["piece_no"] - b["piece_no"]).cast("int"))
    return pairs.withColumn("outcomes", F.when(F.size("naturals") > 0, in_order).otherwise(outcomes))


def collapse_verdicts(bound: DataFrame) -> DataFrame:
    """One verdict per (change, shape); the first rule that applies wins."""
    subject = F.col("subject")

    def in_state(state: str) -> Column:
        return F.filter("outcomes", lambda o: o["state"] == state)

    star = F.exists(
        "stars",
        lambda s: subject.isNull()
        | let(
            _tables_in_scope(s), lambda own: (F.size(own) == 0) | F.array_contains(own, subject)
        ),
    )
    written = F.exists(
        "writes",
        lambda w: (w["name"] == F.col("col"))
        & (subject.isNull() | w["target"].isNull() | (w["target"] == subject)),
    )
    df = bound.withColumns(
        {
            "bad": F.get(in_state("unknown"), F.lit(0)),
            "stray": F.get("strays", F.lit(0)),
            "bound": in_state("bound"),
            "using": F.size(in_state("using")) > 0,
            "elsewhere": F.array_sort(
                F.array_distinct(F.flatten(F.transform(in_state("elsewhere"), lambda o: o["elsewhere"])))
            ),
            "star": star,
            "written": written,
        }
    )
    clauses = F.flatten(F.transform("bound", lambda o: F.concat(F.array(o["clause"]), o["also"])))
    clauses = F.when(F.col("using"), F.concat(clauses, F.array(F.lit("JOIN")))).otherwise(clauses)
    hard = F.array_sort(
        F.array_distinct(F.filter(clauses, lambda c: c.isin(lexicon.HARD_CLAUSES + lexicon.CHANGING_CLAUSES)))
    )
    nothing = F.size("bound") == 0

    def verdict(severity, evidence, kind=None, reason=None) -> Column:
        def of(value) -> Column:
            return (value if isinstance(value, Column) else F.lit(value)).cast("string")

        return F.struct(
            of(severity).alias("severity"), of(evidence).alias("evidence"),
            of(kind).alias("unknown_kind"), of(reason).alias("unknown_reason"),
        )

    stray_reason = F.concat(F.lit("`"), F.col("column"), F.lit("` stands where its use cannot be read"))
    parse_reason = F.concat(F.lit("parse failed: "), F.col("unreadable"))
    cleared = F.concat(F.lit(text.CLEARED_PREFIX), F.array_join("elsewhere", ","))
    ruled = (
        F.when(F.col("unreadable").isNotNull(), verdict("unknown", "PARSE", "parse", parse_reason))
        .when(
            F.col("bad").isNotNull(),
            verdict("unknown", F.col("bad.clause"), F.col("bad.kind"), F.col("bad.reason")),
        )
        .when(F.col("stray").isNotNull(), verdict("unknown", F.col("stray.clause"), "unexplained", stray_reason))
        .when(nothing & F.col("written"), verdict("hard", "INSERT"))
        .when(nothing & F.col("using"), verdict("hard", "JOIN"))
        .when(nothing & F.col("star"), verdict("unknown", "STAR", "star", STAR_REASON))
        .when(nothing & (F.size("elsewhere") > 0), verdict("unaffected", cleared))
        .when(nothing, verdict("unaffected", "NO_REFERENCE"))
        .when(F.size(hard) > 0, verdict("hard", F.array_join(hard, ",")))
        .otherwise(verdict("soft", "SELECT"))
    )
    pieces = F.transform("bound", lambda o: o["piece_no"].cast("int"))
    # inline() keeps later filters from being rewritten into copies of the rule chain.
    return df.select(
        "change_id", "sid", "text_sid", "dataset", "shape", "n_statements", "column",
        pieces.alias("piece_numbers"), "tables", F.inline(F.array(ruled)),
    )


def fold_statements(verdicts: DataFrame) -> DataFrame:
    """One verdict per (change, text): an UNKNOWN statement rules its text, then a HARD one, then a SOFT one.

    Bound names of all its statements are kept for a rewrite.
    """
    tier = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("severity"))
    ruling = ["severity", "evidence", "unknown_kind", "unknown_reason"]
    folded = verdicts.groupBy("change_id", "text_sid").agg(
        F.min(F.struct(tier.alias("tier"), F.length("sid").alias("part"), F.col("sid").alias("own"), *ruling)).alias("_x"),
        *[F.first(c).alias(c) for c in ("dataset", "shape", "n_statements", "column")],
        F.sort_array(F.flatten(F.collect_list("piece_numbers"))).alias("piece_numbers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tables")))).alias("tables"),
    )
    return folded.select(
        "change_id", F.col("text_sid").alias("sid"), "dataset", "shape", "n_statements", "column", "piece_numbers", "tables",
        *[F.col(f"_x.{c}").alias(c) for c in ruling],
    )


def kept(severity: Column, evidence: Column) -> Column:
    """A finding is listed unless there is no reference at all; that case is only counted."""
    return (severity != "unaffected") | text.is_cleared(evidence)


def classify_facts(
    facts: DataFrame,
    changes: DataFrame,
    schema_columns: DataFrame | None,
    use_subject: bool = True,
) -> DataFrame:
    """Verdicts of already extracted facts; shapes without a reference give no row."""
    prepared = prepare_changes(changes, use_subject)
    tables = None if schema_columns is None else schema_tables(schema_columns, changes)
    pairs = attach_schemas(pair_with_changes(facts, prepared), tables)
    verdicts = collapse_verdicts(bind_references(pairs, schema_columns is not None))
    return fold_statements(verdicts.where(kept(F.col("severity"), F.col("evidence"))))


def classify_shapes(
    changes: DataFrame,
    shapes: DataFrame,
    schema_columns: DataFrame | None = None,
    columns: list[str] | None = None,
    use_subject: bool = True,
) -> DataFrame:
    """Verdict per (change, shape). ``columns``, the changed names when they are few,
    keeps statements that cannot matter out of the extraction."""
    facts = extract.expand_ctes(extract.statement_facts(shapes, columns))
    return classify_facts(facts, changes, schema_columns, use_subject)


def join_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Join log rows (with ``sid``) to per-shape rows.

    A shape may stand for a third of the log. Its one verdict is small, so adaptive execution splits the
    log's side of that partition over tasks, or broadcasts the verdicts if they are measured to be few.
    """
    return rows.join(verdicts.drop("n_statements"), "sid")


def verdicts_of_shapes(shapes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The verdicts of narrowed shapes, given to each whole shape behind them.

    ``shapes`` has the narrowed ``sid`` with the shape's own ``whole``, ``whole_sid`` and ``n_statements``.
    """
    own = {"sid": F.col("whole_sid"), "shape": F.col("whole"), "n_statements": F.col("n_whole")}
    whole = shapes.select("sid", "whole_sid", "whole", F.col("n_statements").alias("n_whole"))
    joined = whole.join(verdicts, "sid")
    return joined.select(*[own.get(c, F.col(c)).alias(c) for c in verdicts.columns])


def findings_of(fingerprinted: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Statement-level findings: the verdict of its shape for every logged statement.

    Pass stored verdicts: they are read twice. Notes of rulings on shapes (``agent_note``) go with them.
    """
    note = F.col("agent_note") if "agent_note" in verdicts.columns else F.lit(None)
    ruled = verdicts.select(
        "sid", "change_id", "column", "severity", "evidence", "unknown_reason", "unknown_kind", "n_statements",
        note.cast("string").alias("agent_note"),
    )
    exec_count = F.col("exec_count") if "exec_count" in fingerprinted.columns else F.lit(None)
    rows = fingerprinted.select(
        "sid", "query_id", text.snippet(F.col("sql")).alias("sql_snippet"),
        exec_count.cast("bigint").alias("exec_count"),
    )
    return (
        join_verdicts(rows, ruled)
        .select(*FINDING_COLUMNS)
    )


def classify_log(
    changes: DataFrame,
    log: DataFrame,
    schema_columns: DataFrame | None = None,
    columns: list[str] | None = None,
    use_subject: bool = True,
    dialect: str = "snowflake",
) -> DataFrame:
    """Findings of every change over the statements logged for its dataset."""
    marked = extract.narrow_shapes(extract.fingerprint_log(log, dialect), columns)
    verdicts = classify_shapes(
        changes, extract.distinct_shapes(marked), schema_columns, columns, use_subject
    )
    return findings_of(marked, cut(verdicts))


def with_statement_text(findings: DataFrame, log: DataFrame) -> DataFrame:
    """Add the full text by id, the snippet where the log has none, and a duplicate-id flag."""
    asked = log.join(findings.select("query_id").distinct(), "query_id", "left_semi")
    by_id = asked.groupBy("query_id").agg(
        F.min("sql").alias("sql"), F.count(F.lit(1)).alias("n_texts")
    )
    return (
        findings.join(by_id, "query_id", "left")
        .withColumn("duplicate_id", F.coalesce(F.col("n_texts") > 1, F.lit(False)))
        .withColumn("sql", F.coalesce("sql", "sql_snippet"))
        .drop("n_texts")
    )
