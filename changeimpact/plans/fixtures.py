"""Query log over the given event table: own statement templates, labelled by hand.

Each event is one logged statement: its template is ``event_id % len(TEMPLATES)``,
its tenant the event's user, its literals the event's value and id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from changeimpact.session import literal_rows

EXPOSURES = "urn:li:dataset:(urn:li:dataPlatform:snowflake,obs.night.exposures,PROD)"
MOUNTS = "urn:li:dataset:(urn:li:dataPlatform:snowflake,obs.dome.mounts,PROD)"

CHANGES_SCHEMA = "change_id string, dataset string, kind string, column string, new_column string"
CHANGES = [
    ("c1", EXPOSURES, "rename", "band", "passband"),
    ("c2", EXPOSURES, "drop", "airmass", None),
    ("c3", MOUNTS, "rename", "drive_kind", "drive_type"),
]
SCHEMA = {
    "night.exposures": "exposure_id band airmass observer_id started optics frames seeing",
    "night.plates": "plate_id exposure_id band scanner",
    "night.observers": "observer_id full_name institute",
    "night.meters": "meter_id exposure_id airmass",
    "dome.mounts": "mount_id drive_kind institute",
    "dome.services": "service_id mount_id drive_kind",
}

# Verdicts: (severity, evidence, unknown_kind, unknown_reason)
STAR = ("unknown", "STAR", "star", "a star over the subject may stand for the column")
MARKUP = ("unknown", "PARSE", "parse", "parse failed: template markup")
OPEN = ("unknown", "PARSE", "parse", "parse failed: unbalanced parentheses")
QUOTE = ("unknown", "PARSE", "parse", "parse failed: unterminated quote")
BROKEN_OFF = ("unknown", "PARSE", "parse", "parse failed: statement breaks off")


def hard(clause: str):
    return ("hard", clause, None, None)


SOFT = ("soft", "SELECT", None, None)


def cleared(tables: str):
    return ("unaffected", "BOUND_ELSEWHERE:" + tables, None, None)


def crowded(clause: str, column: str):
    reason = f"`{column}` without a qualifier fits 2 tables in scope"
    return ("unknown", clause, "ambiguous_bare", reason)


def stuck(clause: str, name: str):
    reason = f"qualifier `{name}` leads to no known table"
    return ("unknown", clause, "unresolvable_qualifier", reason)


def stray(clause: str, column: str):
    return ("unknown", clause, "unexplained", f"`{column}` stands where its use cannot be read")


def reused(clause: str, name: str):
    return ("unknown", clause, "alias_shadowed", f"alias `{name}` names different tables in different scopes")


def unlisted(clause: str, tables: str):
    return ("unknown", clause, "unresolved_table", f"no schema for {tables}")


@dataclass(frozen=True)
class Template:
    dataset: str
    stratum: str
    sql: str
    tables: str  # base tables it names; an unreadable one names none
    verdicts: dict = field(default_factory=dict)
    rewritten: str | None = None  # after the rename; None: refused
    gold: str | None = None  # label where the binder is known to miss
    refusal: str | None = None  # reason of a refused HARD or SOFT
    alone: dict = field(default_factory=dict)  # verdicts that differ without subject table and schemas


X, L, O, G = "tenant_{t}.exposures", "tenant_{t}.plates", "tenant_{t}.observers", "tenant_{t}.meters"
M, V = "tenant_{t}.mounts", "tenant_{t}.services"
NODES = "the hit is in a written column list, which has no bound name to replace"
USED = NODES
STAR_LEFT = "a star may still stand for the old column"


def _new(sql: str, times: int = 99) -> str:
    """The statement with the bound names replaced, given where all mentions (or the first ones) are bound."""
    return re.sub(r"(?<![\w'])(band|drive_kind)(?![\w'])", lambda m: {"band": "passband"}.get(m[0], "drive_type"), sql, count=times)


def _e(stratum, sql, tables, verdicts=None, rewritten=None, **more):
    return Template(EXPOSURES, stratum, sql, tables, verdicts or {}, _new(sql) if rewritten == "all" else rewritten, **more)


def _m(stratum, sql, tables, verdicts=None, rewritten=None, **more):
    return Template(MOUNTS, stratum, sql, tables, verdicts or {}, _new(sql) if rewritten == "all" else rewritten, **more)


def two(column: str, clause: str):
    return crowded(clause, column)


TEMPLATES = [
    # uses that change results
    _e("hard", f"SELECT observer_id, MIN(started) FROM {X} WHERE band IN ('B{{v}}', 'V') GROUP BY observer_id", "exposures",
       {"c1": hard("WHERE")}, "all"),
    _e("hard", f"SELECT COUNT(DISTINCT observer_id) AS people, band FROM {X} WHERE seeing < {{v}} GROUP BY 2, band", "exposures",
       {"c1": hard("GROUP")}, "all"),
    _e("hard", f"SELECT x.exposure_id FROM {X} AS x LEFT JOIN {L} AS pl ON x.band = pl.band AND pl.scanner = 'S{{v}}'", "exposures plates",
       {"c1": hard("JOIN")},
       f"SELECT x.exposure_id FROM {X} AS x LEFT JOIN {L} AS pl ON x.passband = pl.band AND pl.scanner = 'S{{v}}'"),
    _e("hard", f"SELECT exposure_id FROM {X} ORDER BY LOWER(band), started LIMIT {{v}}", "exposures", {"c1": hard("ORDER")}, "all"),
    _e("hard", f"SELECT observer_id FROM {X} GROUP BY observer_id HAVING AVG(airmass) < 2 AND COUNT(DISTINCT band) > {{v}}", "exposures",
       {"c1": hard("HAVING"), "c2": hard("HAVING")}, "all"),
    _e("hard", f"SELECT exposure_id, LAG(seeing) OVER (PARTITION BY observer_id, band ORDER BY started) AS prior FROM {X}", "exposures",
       {"c1": hard("PARTITION")}, "all"),
    _e("hard", f"SELECT exposure_id, RANK() OVER w AS place FROM {X} WINDOW w AS (PARTITION BY observer_id ORDER BY airmass DESC)",
       "exposures", {"c2": hard("ORDER")}),
    _e("hard", f"SELECT SUM(seeing) FILTER (WHERE band = 'R{{v}}') AS r_seeing FROM {X}", "exposures", {"c1": hard("WHERE")}, "all"),
    _e("hard", f"SELECT observer_id, LISTAGG(exposure_id, ',') WITHIN GROUP (ORDER BY band) AS chain FROM {X} GROUP BY observer_id",
       "exposures", {"c1": hard("ORDER")}, "all"),
    _e("hard", f"SELECT exposure_id FROM {X} QUALIFY DENSE_RANK() OVER (ORDER BY started) <= {{v}} AND band <> 'U'", "exposures",
       {"c1": hard("QUALIFY")}, "all"),
    _e("hard", f"SELECT n.full_name FROM {O} n WHERE NOT EXISTS (SELECT NULL FROM {X} e WHERE e.observer_id = n.observer_id AND e.band = 'I{{v}}')",
       "observers exposures", {"c1": hard("WHERE")}, "all"),
    _e("hard", f"SELECT exposure_id FROM {X} WHERE COALESCE(band, 'none') LIKE 'N%' OR airmass IS NULL", "exposures",
       {"c1": hard("WHERE"), "c2": hard("WHERE")}, "all"),
    _e("hard", f"SELECT exposure_id FROM {X} WHERE airmass BETWEEN 1 AND {{v}} ORDER BY airmass", "exposures", {"c2": hard("ORDER,WHERE")}),
    # uses in a select list only
    _e("soft", f"SELECT DISTINCT band FROM {X}", "exposures", {"c1": SOFT}, "all"),
    _e("soft", f"SELECT exposure_id, band || '-' || CAST(seeing AS VARCHAR) AS tag, airmass * 2 FROM {X} WHERE observer_id = {{v}}",
       "exposures", {"c1": SOFT, "c2": SOFT}, "all"),
    _e("soft", f"SELECT exposure_id,\n       IFF(band = 'H{{v}}', 1, 0) AS is_h\n  FROM {X}\n WHERE started IS NOT NULL\n", "exposures",
       {"c1": SOFT}, "all"),
    _e("soft", f"SELECT e.band, n.institute FROM {X} e, {O} n WHERE e.observer_id = n.observer_id", "exposures observers", {"c1": SOFT}, "all"),
    _e("soft", f"SELECT MAX(e.airmass) AS worst FROM {X} e CROSS JOIN {O} n", "exposures observers", {"c2": SOFT}),
    _e("soft", f'SELECT "band" FROM "tenant_{{t}}"."exposures" WHERE "airmass" > {{v}}', "exposures", {"c1": SOFT, "c2": hard("WHERE")},
       "all"),
    _e("soft", f"INSERT INTO tenant_{{t}}.archive SELECT exposure_id, band FROM {X} WHERE started < '2024-01-01'", "archive exposures",
       {"c1": SOFT}, "all"),
    # schemas decide
    _e("narrowable", f"SELECT full_name FROM {X} JOIN {O} USING (observer_id) WHERE band = 'J{{v}}'", "exposures observers",
       {"c1": hard("WHERE")}, "all", alone={"c1": two("band", "WHERE")}),
    _e("narrowable", f"SELECT n.institute, COUNT(*) FROM {O} n JOIN {X} e ON e.observer_id = n.observer_id GROUP BY n.institute, band",
       "exposures observers", {"c1": hard("GROUP")}, "all", alone={"c1": two("band", "GROUP")}),
    _e("narrowable", f"SELECT airmass FROM {X} e JOIN {O} n ON n.observer_id = e.observer_id ORDER BY n.full_name", "exposures observers",
       {"c2": SOFT}, alone={"c2": two("airmass", "SELECT")}),
    _e("ambiguous", f"SELECT e.exposure_id FROM {X} e JOIN {L} pl ON pl.exposure_id = e.exposure_id WHERE band IS NOT NULL AND e.seeing > {{v}}",
       "exposures plates", {"c1": two("band", "WHERE")}),
    _e("ambiguous", f"SELECT CONCAT(band, '/', scanner) AS k FROM {X} NATURAL JOIN {L}", "exposures plates", {"c1": two("band", "SELECT")},
       alone={"c1": two("band", "SELECT"), "c2": unlisted("JOIN", "exposures, plates")}),
    _e("ambiguous", f"SELECT pl.plate_id FROM {L} pl, {X} e WHERE pl.exposure_id = e.exposure_id ORDER BY band, pl.plate_id",
       "exposures plates", {"c1": two("band", "ORDER")}),
    _e("ambiguous", f"SELECT AVG(airmass) FROM {X} e INNER JOIN {G} g ON g.exposure_id = e.exposure_id", "exposures meters",
       {"c2": two("airmass", "SELECT")}),
    # somebody else's column, or no column at all
    _e("decoy", f"SELECT scanner, COUNT(*) FROM {L} WHERE band = 'K{{v}}' GROUP BY scanner", "plates", {"c1": cleared("plates")},
       alone={"c1": hard("WHERE")}),
    _e("decoy", f"SELECT e.exposure_id, pl.band FROM {X} e RIGHT JOIN {L} pl ON pl.exposure_id = e.exposure_id", "exposures plates",
       {"c1": cleared("plates")}, alone={"c1": SOFT}),
    _e("decoy", f"SELECT exposure_id /* band was here */ FROM {X} WHERE seeing > {{v}}", "exposures"),
    _e("decoy", f"SELECT 'band' AS label, observer_id AS band_owner FROM {X} WHERE started < '2025-06-01'", "exposures"),
    _e("decoy", f"SELECT MAX(started) band FROM {X}", "exposures"),
    _e("decoy", f"SELECT g.airmass FROM {G} g WHERE g.airmass BETWEEN 1 AND {{v}}", "meters", {"c2": cleared("meters")},
       alone={"c2": hard("WHERE")}),
    _e("decoy", f"SELECT institute, COUNT(*) FROM {O} GROUP BY institute FETCH FIRST {{v}} ROWS ONLY", "observers"),
    _e("decoy", f"SELECT exposure_id FROM {X}; SELECT band FROM {L}", "exposures plates", {"c1": cleared("plates")}, alone={"c1": SOFT}),
    # stars
    _e("star", f"SELECT * FROM {X} TABLESAMPLE (10)", "exposures", {"c1": STAR, "c2": STAR}),
    _e("star", f"SELECT e.* FROM {X} e JOIN {O} n ON n.observer_id = e.observer_id WHERE n.institute = 'I{{v}}'", "exposures observers",
       {"c1": STAR, "c2": STAR}),
    _e("star", f"SELECT * FROM {O} WHERE full_name LIKE 'A%'", "observers", alone={"c1": STAR, "c2": STAR}),
    _e("star", f"SELECT pl.* FROM {L} pl WHERE pl.scanner = 'S{{v}}'", "plates", alone={"c1": STAR, "c2": STAR}),
    _e("star", f"SELECT COUNT(*) FROM {X} WHERE airmass > {{v}}", "exposures", {"c2": hard("WHERE")}),
    # named subqueries
    _e("cte", f"WITH good AS (SELECT exposure_id, band, observer_id FROM {X} WHERE seeing < 1), few AS (SELECT band FROM good WHERE observer_id = {{v}}) SELECT band FROM few",
       "exposures", {"c1": SOFT}, "all"),
    _e("cte", f"WITH RECURSIVE r AS (SELECT exposure_id, band FROM {X} WHERE exposure_id = {{v}} UNION ALL SELECT x.exposure_id, x.band FROM {X} x JOIN r ON r.exposure_id = x.exposure_id - 1) SELECT COUNT(*) FROM r",
       "exposures", {"c1": SOFT}, "all"),
    _e("cte", f"WITH pl AS (SELECT * FROM {L}) SELECT pl.band FROM pl WHERE pl.scanner IS NOT NULL", "plates", {"c1": cleared("plates")},
       alone={"c1": SOFT, "c2": STAR}),
    _e("cte", f"WITH e AS (SELECT * FROM {X}) SELECT observer_id FROM e GROUP BY observer_id, band", "exposures",
       {"c1": hard("GROUP"), "c2": STAR}, refusal=STAR_LEFT),
    # texts that cannot be read
    _e("unreadable", f"SELECT {{{{ fields }}}} FROM {X}", "", {"c1": MARKUP, "c2": MARKUP}),
    _e("unreadable", f"SELECT band FROM {X} WHERE (airmass > {{v}}", "", {"c1": OPEN, "c2": OPEN}),
    _e("unreadable", f"SELECT exposure_id FROM {X} WHERE band =", "", {"c1": BROKEN_OFF, "c2": BROKEN_OFF}),
    _e("unreadable", f"SELECT exposure_id FROM {X} WHERE band = 'B{{v}}", "", {"c1": QUOTE, "c2": QUOTE}),
    _e("unexplained", f"SELECT exposure_id mag band FROM {X} WHERE seeing > {{v}}", "exposures", {"c1": stray("SELECT", "band")}),
    _e("unexplained", f"SELECT exposure_id FROM {X} WHERE seeing 1 band > {{v}}", "exposures", {"c1": stray("WHERE", "band")}),
    # subqueries
    _e("subquery", f"SELECT full_name FROM {O} WHERE observer_id = ANY (SELECT observer_id FROM {X} WHERE band = 'Z{{v}}')",
       "observers exposures", {"c1": hard("WHERE")}, "all"),
    _e("subquery", f"SELECT scanner FROM {L} WHERE plate_id IN (SELECT band FROM {X})", "exposures plates", {"c1": SOFT}, "all", gold="hard"),
    _e("subquery", f"SELECT n.full_name, (SELECT COUNT(*) FROM {X} e WHERE e.observer_id = n.observer_id AND e.airmass < {{v}}) AS good FROM {O} n",
       "observers exposures", {"c2": hard("WHERE")}),
    _e("subquery", f"SELECT t.band, t.k FROM (SELECT band, COUNT(*) AS k FROM {X} GROUP BY band) AS t WHERE t.k > {{v}}", "exposures",
       {"c1": stuck("SELECT", "t")}, alone={"c1": hard("GROUP")}),
    # writes
    _e("write", f"UPDATE {X} SET airmass = airmass + 1, band = UPPER(band) WHERE exposure_id = {{e}}", "exposures",
       {"c1": hard("SET"), "c2": hard("SET")}, "all"),
    _e("write", f"INSERT INTO {X} (exposure_id, observer_id, band) SELECT exposure_id + 1, {{v}}, scanner FROM {L}", "exposures plates",
       {"c1": hard("INSERT")}, refusal=NODES),
    _e("write", f"DELETE FROM {X} WHERE band IS NULL OR airmass > {{v}}", "exposures", {"c1": hard("WHERE"), "c2": hard("WHERE")}, "all"),
    _e("write", f"MERGE INTO {X} AS tgt USING {G} AS src ON tgt.exposure_id = src.exposure_id WHEN MATCHED AND src.airmass > {{v}} THEN UPDATE SET tgt.airmass = src.airmass",
       "exposures meters", {"c2": hard("SET")}),
    _e("write", f"CREATE TABLE tenant_{{t}}.copied AS SELECT band, COUNT(*) AS n FROM {X} GROUP BY ROLLUP (band)", "copied exposures",
       {"c1": hard("GROUP")}, "all"),
    _e("write", f"SET lim = {{v}}; SELECT exposure_id FROM {X} WHERE band = 'M'", "exposures", {"c1": hard("WHERE")}, "all"),
    _e("write", f"BEGIN; UPDATE {X} SET seeing = 0 WHERE exposure_id = {{e}}; UPDATE {X} SET band = 'W' WHERE exposure_id = {{e}}; COMMIT",
       "exposures", {"c1": hard("SET")}, "all"),
    # names that lead elsewhere or nowhere
    _e("alias", f"SELECT z.band FROM {L} z WHERE z.exposure_id IN (SELECT z.exposure_id FROM {X} z)", "exposures plates",
       {"c1": reused("SELECT", "z")}),
    _e("alias", f"SELECT q.band FROM {X} e JOIN (SELECT band, exposure_id FROM {L}) q ON q.exposure_id = e.exposure_id", "exposures plates",
       {"c1": stuck("SELECT", "q")}, alone={"c1": SOFT}),
    _e("path", f"SELECT exposure_id FROM {X} WHERE optics.band = 'B{{v}}' AND optics.lens.airmass > 1", "exposures",
       {"c1": hard("WHERE"), "c2": hard("WHERE")}, "all"),
    _e("path", f"SELECT fr.band FROM {X} e CROSS JOIN UNNEST(e.frames) AS fr", "exposures", {"c1": stuck("SELECT", "fr")}, alone={"c1": SOFT}),
    _e("unlisted", f"SELECT e.exposure_id FROM {X} e JOIN tenant_{{t}}.lost_logs k ON k.exposure_id = e.exposure_id WHERE band = 'L{{v}}'",
       "exposures lost_logs", {"c1": unlisted("WHERE", "lost_logs")}, alone={"c1": two("band", "WHERE")}),
    _e("union", f"SELECT exposure_id FROM {X} WHERE airmass > 2 UNION SELECT exposure_id FROM {G} WHERE airmass > {{v}}", "exposures meters",
       {"c2": hard("WHERE")}),
    _e("using", f"SELECT COUNT(*) FROM {X} JOIN {L} USING (exposure_id, band)", "exposures plates", {"c1": hard("JOIN")}, refusal=USED),
    _e("place", f"SELECT observer_id, band, COUNT(*) FROM {X} WHERE seeing < {{v}} GROUP BY 1, 2 ORDER BY 3 DESC", "exposures",
       {"c1": hard("GROUP")}, "all"),
    _e("place", f"SELECT airmass, exposure_id FROM {X} WHERE observer_id = {{v}} ORDER BY started, 1", "exposures", {"c2": hard("ORDER")}),
    _e("place", f"SELECT band, MAX(airmass) AS worst FROM {X} GROUP BY ALL", "exposures", {"c1": hard("GROUP"), "c2": SOFT}, "all"),
    _e("place", f"SELECT exposure_id, band FROM {X} ORDER BY ROUND(seeing, 1), 2", "exposures",
       {"c1": ("unknown", "SELECT", "place", "a place in GROUP BY or ORDER BY may name `band`")}),
    _e("field", f"SELECT e.band.code FROM {X} e WHERE obs.tenant_{{t}}.exposures.band.width > {{v}}", "exposures", {"c1": hard("WHERE")}, "all"),
    _e("field", f'SELECT pl."band"."code" FROM {X} e JOIN {L} pl ON pl.exposure_id = e.exposure_id', "exposures plates",
       {"c1": cleared("plates")}, alone={"c1": SOFT}),
    _e("natural", f"SELECT exposure_id FROM {X} NATURAL JOIN {L} WHERE seeing > {{v}}", "exposures plates",
       {"c1": hard("JOIN")}, refusal=USED, alone={"c1": unlisted("JOIN", "exposures, plates"), "c2": unlisted("JOIN", "exposures, plates")}),
    _e("natural", f"SELECT exposure_id FROM {X} NATURAL LEFT JOIN tenant_{{t}}.lost_logs", "exposures lost_logs",
       {c: unlisted("JOIN", "lost_logs") for c in ("c1", "c2")},
       alone={c: unlisted("JOIN", "exposures, lost_logs") for c in ("c1", "c2")}),
    _e("dynamic", "EXECUTE IMMEDIATE 'SELECT band FROM exposures WHERE observer_id = {v}'", "",
       {c: ("unknown", "PARSE", "parse", "parse failed: statement built at run time") for c in ("c1", "c2")}),
    _e("write", f"ALTER TABLE {X} DROP COLUMN airmass", "exposures", {"c2": hard("ALTER")}),
    # the second dataset
    _m("hard", f"SELECT mount_id FROM {M} WHERE drive_kind NOT IN ('fork', 'D{{v}}')", "mounts", {"c3": hard("WHERE")}, "all"),
    _m("soft", f"SELECT drive_kind AS kind, institute FROM {M}", "mounts", {"c3": SOFT}, "all"),
    _m("ambiguous", f"SELECT m.institute FROM {M} m JOIN {V} s ON s.mount_id = m.mount_id GROUP BY m.institute, drive_kind", "mounts services",
       {"c3": two("drive_kind", "GROUP")}),
    _m("decoy", f"SELECT s.service_id FROM {V} s WHERE s.drive_kind = 'D{{v}}'", "services", {"c3": cleared("services")},
       alone={"c3": hard("WHERE")}),
    _m("star", f"SELECT m.*, 1 AS one FROM {M} m", "mounts", {"c3": STAR}),
    _m("decoy", f"SELECT COUNT(*) FROM {M} WHERE institute = 'I{{v}}'", "mounts"),
    _m("write", f"INSERT OVERWRITE TABLE {M} SELECT mount_id, drive_kind, institute FROM {V}", "mounts services", {"c3": cleared("services")},
       alone={"c3": SOFT}),
    _m("write", f"UPDATE {M} SET drive_kind = 'direct' WHERE mount_id = {{e}}", "mounts", {"c3": hard("SET")}, "all"),
]
N = len(TEMPLATES)
# The template of several lines, whose diff has context.
LINES = next(i for i, t in enumerate(TEMPLATES) if "\n" in t.sql)
# Verdicts that differ when no subject table and no schemas are given.
NO_SUBJECT = {i: t.alone for i, t in enumerate(TEMPLATES) if t.alone}
# Base tables of the templates.
TABLES = {
    name: [i for i, t in enumerate(TEMPLATES) if name in t.tables.split()]
    for name in sorted({name for t in TEMPLATES for name in t.tables.split()})
}


def changes(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, CHANGES_SCHEMA, CHANGES)


def schema_columns(spark: SparkSession) -> DataFrame:
    rows = [(table, column) for table, columns in SCHEMA.items() for column in columns.split()]
    return literal_rows(spark, "table_name string, column_name string", rows)


def filled(template: str = "template", out: str = "sql") -> Column:
    """A template with the event's tenant, value and id put in."""
    sql = F.col(template)
    fills = {
        "{t}": F.col("user_id").cast("string"),
        "{v}": F.round(F.col("value") * 100).cast("bigint").cast("string"),
        "{e}": F.col("event_id").cast("string"),
    }
    for mark, value in fills.items():
        sql = F.replace(sql, F.lit(mark), value)
    return sql.alias(out)


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logged statement per event."""
    rows = [(i, t.dataset, t.sql) for i, t in enumerate(TEMPLATES)]
    templates = literal_rows(spark, "tid int, dataset string, template string", rows)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "ts", "user_id", "event_type", "value", "props",
        (F.col("event_id") % N).cast("int").alias("tid"),
    )
    # A file may be one split, and what is done per statement is far larger than the event.
    events = events.repartition("event_id", "user_id")
    count = F.get_json_object("props", "$.k").cast("bigint")
    return events.join(F.broadcast(templates), "tid").select(
        F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("query_id"),
        filled(),
        "dataset",
        F.when(F.col("event_type") != "error", count).alias("exec_count"),
        F.col("event_id").alias("seq"),
        "tid",
    )


def gold_labels(spark: SparkSession, log: DataFrame) -> DataFrame:
    """Hand labels of the statements of each change's dataset."""
    rows = [
        (i, c[0], t.stratum, (t.gold if c[0] == "c1" else None) or t.verdicts.get(c[0], ("unaffected",))[0])
        for i, t in enumerate(TEMPLATES)
        for c in CHANGES
        if t.dataset == c[1]
    ]
    labels = literal_rows(spark, "tid int, change_id string, stratum string, gold string", rows)
    return log.select("query_id", "tid").join(F.broadcast(labels), "tid").select("change_id", "query_id", "stratum", "gold")
