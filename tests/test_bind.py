"""Verdicts of own statements over invented tables, labelled by hand."""

import pytest
from pyspark.sql import functions as F

from changeimpact.operators import bind
from changeimpact.session import literal_rows

SCHEMA = {
    "depot.parcels": ["parcel_id", "route_code", "sender_id", "weight_kg"],
    "depot.handoffs": ["handoff_id", "parcel_id", "route_code"],
    "depot.senders": ["sender_id", "sender_name"],
}

# name, statement, severity, evidence, kind
CASES = [
    ("where", "SELECT parcel_id FROM depot.parcels WHERE route_code = 'N7'", "hard", "WHERE", None),
    ("select", "SELECT route_code, parcel_id FROM parcels", "soft", "SELECT", None),
    ("lower", "select P.Route_Code from PARCELS P order by 1", "hard", "ORDER", None),
    # places of the select list
    ("place_group", "SELECT parcel_id, route_code, COUNT(*) FROM parcels GROUP BY 1, 2", "hard", "GROUP", None),
    ("place_order", "SELECT weight_kg,UPPER(route_code) FROM parcels WHERE weight_kg > 3 ORDER BY 1 DESC,2", "hard", "ORDER", None),
    ("place_other", "SELECT route_code, parcel_id FROM parcels ORDER BY 2 LIMIT 1, 1", "soft", "SELECT", None),
    ("place_all", "SELECT route_code, SUM(weight_kg) FROM parcels GROUP BY ALL", "hard", "GROUP", None),
    ("place_all_folded", "SELECT sender_id, MIN(route_code) FROM parcels GROUP BY ALL", "soft", "SELECT", None),
    ("place_union", "SELECT parcel_id, route_code FROM parcels UNION SELECT sender_id, sender_name FROM senders ORDER BY 2", "hard", "ORDER", None),
    ("place_inner", "SELECT x.r FROM (SELECT route_code AS r, parcel_id FROM parcels ORDER BY 2) x ORDER BY 1", "soft", "SELECT", None),
    ("place_masked", "SELECT parcel_id, route_code FROM parcels ORDER BY COALESCE(weight_kg, 1), 2", "unknown", "SELECT", "place"),
    ("place_after_star", "SELECT s.*, route_code FROM senders s JOIN parcels p ON p.sender_id = s.sender_id ORDER BY 4", "unknown", "SELECT", "place"),
    ("place_in_list", "SELECT route_code FROM parcels WHERE weight_kg IN (1, 2) GROUP BY route_code, weight_kg", "hard", "GROUP", None),
    ("distinct_on", "SELECT DISTINCT ON (route_code) parcel_id FROM parcels", "hard", "GROUP", None),
    ("alter_drop", "ALTER TABLE parcels DROP COLUMN route_code", "hard", "ALTER", None),
    # fields of the column, longer names of tables
    ("field", "SELECT parcels.route_code.zone FROM parcels", "soft", "SELECT", None),
    ("field_where", "SELECT 1 FROM depot.parcels p WHERE p.route_code.zone.no = 3", "hard", "WHERE", None),
    ("field_bare", "SELECT 1 FROM parcels WHERE route_code.zone = 'a'", "hard", "WHERE", None),
    ("field_quoted", 'SELECT 1 FROM parcels WHERE "parcels"."route_code"."zone" = 3', "hard", "WHERE", None),
    ("field_three_parts", "SELECT 1 FROM parcels WHERE main.depot.parcels.route_code.zone = 3", "hard", "WHERE", None),
    ("field_elsewhere", "SELECT h.route_code.zone FROM parcels p JOIN handoffs h ON h.parcel_id = p.parcel_id", "unaffected",
     "BOUND_ELSEWHERE:handoffs", None),
    ("field_unplaced", "SELECT q.route_code.zone FROM handoffs", "unknown", "SELECT", "unresolvable_qualifier"),
    # columns that the schemas imply
    ("natural", "SELECT parcel_id FROM parcels NATURAL JOIN handoffs", "hard", "JOIN", None),
    ("natural_left", "SELECT parcel_id FROM parcels NATURAL LEFT JOIN handoffs WHERE weight_kg > 1", "hard", "JOIN", None),
    ("natural_no_schema", "SELECT parcel_id FROM parcels NATURAL JOIN lost", "unknown", "JOIN", "unresolved_table"),
    # text that is no statement yet
    ("dynamic", "EXECUTE IMMEDIATE 'SELECT route_code FROM parcels'", "unknown", "PARSE", "parse"),
    ("group", "SELECT route_code, COUNT(*) FROM parcels GROUP BY route_code", "hard", "GROUP", None),
    ("order", "SELECT route_code FROM parcels ORDER BY route_code DESC", "hard", "ORDER", None),
    ("having", "SELECT 1 FROM parcels GROUP BY sender_id HAVING MAX(route_code) > 'a'", "hard", "HAVING", None),
    ("qualify", "SELECT 1 FROM parcels QUALIFY MIN(parcel_id) OVER (ORDER BY parcel_id) = 1 AND route_code = 'x'",
     "hard", "QUALIFY", None),
    ("join", "SELECT p.parcel_id FROM parcels p JOIN handoffs h ON p.route_code = h.route_code", "hard", "JOIN", None),
    ("two", "SELECT 1 FROM parcels p WHERE p.route_code = 'a' GROUP BY p.route_code", "hard", "GROUP,WHERE", None),
    ("partition", "SELECT ROW_NUMBER() OVER (PARTITION BY route_code ORDER BY parcel_id) FROM parcels",
     "hard", "PARTITION", None),
    ("window_order", "SELECT ROW_NUMBER() OVER (PARTITION BY parcel_id ORDER BY route_code) FROM parcels",
     "hard", "ORDER", None),
    ("windowed_argument", "SELECT MAX(route_code) OVER (PARTITION BY parcel_id) FROM parcels",
     "hard", "PARTITION", None),
    ("named_window", "SELECT 1 FROM parcels WINDOW w AS (PARTITION BY route_code)", "hard", "PARTITION", None),
    ("aggregate_filter", "SELECT COUNT(*) FILTER (WHERE route_code = 'a') FROM parcels", "hard", "WHERE", None),
    ("within_group", "SELECT LISTAGG(parcel_id) WITHIN GROUP (ORDER BY route_code) FROM parcels",
     "hard", "ORDER", None),
    ("case_in_select", "SELECT CASE WHEN route_code = 'a' THEN 1 ELSE 0 END AS f FROM parcels", "soft", "SELECT", None),
    ("function", "SELECT UPPER(TRIM(route_code)) FROM parcels", "soft", "SELECT", None),
    ("extract_from", "SELECT EXTRACT(YEAR FROM route_code) FROM parcels", "soft", "SELECT", None),
    ("distinct_from", "SELECT 1 FROM parcels WHERE route_code IS DISTINCT FROM sender_id", "hard", "WHERE", None),
    ("ambiguous_comma", "SELECT route_code FROM parcels, handoffs", "unknown", "SELECT", "ambiguous_bare"),
    ("ambiguous_beats_hard",
     "SELECT route_code FROM parcels p JOIN handoffs h ON p.route_code = h.route_code", "unknown", "SELECT", "ambiguous_bare"),
    ("cte_chain", "WITH a AS (SELECT route_code FROM parcels), b AS (SELECT route_code FROM a) SELECT route_code FROM b GROUP BY route_code",
     "hard", "GROUP", None),
    ("cte_same_name", "WITH parcels AS (SELECT route_code FROM depot.parcels) SELECT route_code FROM parcels", "soft", "SELECT", None),
    ("cte_columns", "WITH t (a, b) AS (SELECT parcel_id, route_code FROM parcels) SELECT a FROM t", "soft", "SELECT", None),
    ("cte_recursive", "WITH RECURSIVE t AS (SELECT route_code FROM parcels UNION ALL SELECT route_code FROM t) SELECT 1 FROM t",
     "soft", "SELECT", None),
    ("derived_from", "SELECT route_code FROM (SELECT route_code FROM parcels) x", "soft", "SELECT", None),
    ("union", "SELECT sender_id FROM senders UNION ALL SELECT route_code FROM parcels", "soft", "SELECT", None),
    ("star", "SELECT * FROM parcels", "unknown", "STAR", "star"),
    ("star_qualified", "SELECT p.*, s.sender_name FROM parcels p JOIN senders s ON p.sender_id = s.sender_id", "unknown", "STAR", "star"),
    ("star_in_derived", "SELECT x.parcel_id FROM (SELECT * FROM parcels) x", "unknown", "STAR", "star"),
    ("star_yields", "WITH t AS (SELECT * FROM parcels) SELECT parcel_id FROM t WHERE route_code = 'a'", "hard", "WHERE", None),
    ("count_star", "SELECT COUNT(*) FROM parcels WHERE route_code = 'a'", "hard", "WHERE", None),
    ("update_where", "UPDATE parcels SET weight_kg = CASE WHEN 1 = 1 THEN 2 END WHERE route_code = 'x'", "hard", "WHERE", None),
    ("delete", "DELETE FROM parcels WHERE route_code = 'x'", "hard", "WHERE", None),
    # Quirk: with the column bound in a SELECT only, the insert list is not looked at.
    ("insert_select", "INSERT INTO parcels (route_code) SELECT route_code FROM parcels", "soft", "SELECT", None),
    # Quirk: MERGE ... ON is no hard clause.
    ("merge_on", "MERGE INTO parcels t USING senders s ON t.route_code = s.sender_id WHEN MATCHED THEN DELETE", "soft", "SELECT", None),
    ("create_as", "CREATE TABLE depot.copy AS SELECT parcel_id FROM parcels WHERE route_code = 'x'", "hard", "WHERE", None),
    ("using", "SELECT 1 FROM parcels JOIN handoffs USING (route_code)", "hard", "JOIN", None),
    ("quoted", 'SELECT "route_code" FROM "depot"."parcels"', "soft", "SELECT", None),
    ("backticks", "SELECT p.parcel_id FROM `depot.parcels` p WHERE p.`route_code` = 1", "hard", "WHERE", None),
    ("escaped_quote", r"SELECT parcel_id FROM parcels WHERE route_code = 'it\'s'", "hard", "WHERE", None),
    ("doubled_quote", "SELECT parcel_id FROM parcels WHERE route_code = 'it''s (x'", "hard", "WHERE", None),
    ("truncated", "SELECT parcel_id FROM parcels WHERE route_code IN ('a',", "unknown", "PARSE", "parse"),
    ("template", "SELECT parcel_id FROM {{ ref('parcels') }} WHERE route_code = 'a'", "unknown", "PARSE", "parse"),
    ("dollar_template", "SELECT parcel_id FROM parcels WHERE sender_id = ${s}", "unknown", "PARSE", "parse"),
    ("open_quote", "SELECT parcel_id FROM parcels WHERE route_code = 'abc", "unknown", "PARSE", "parse"),
    ("dangling", "SELECT parcel_id FROM parcels WHERE sender_id =", "unknown", "PARSE", "parse"),
    ("no_operand", "SELECT parcel_id FROM parcels WHERE GROUP BY sender_id", "unknown", "PARSE", "parse"),
    ("prose", "please drop the old routes", "unknown", "PARSE", "parse"),
    ("empty", "  -- nothing\n", "unknown", "PARSE", "parse"),
    ("crowd", "SELECT MIN(route_code) FROM parcels p FULL JOIN handoffs h ON h.handoff_id = p.parcel_id", "unknown", "SELECT", "ambiguous_bare"),
    ("other_table", "SELECT COUNT(*) FROM handoffs WHERE route_code LIKE 'x%'", "unaffected", "BOUND_ELSEWHERE:handoffs", None),
    ("other_alias", "SELECT o.route_code, p.weight_kg FROM handoffs o LEFT JOIN parcels p ON p.parcel_id = o.parcel_id",
     "unaffected", "BOUND_ELSEWHERE:handoffs", None),
    ("no_schema", "SELECT MAX(route_code) FROM parcels CROSS JOIN phantoms", "unknown", "SELECT", "unresolved_table"),
    ("free_name", "SELECT phantoms.route_code FROM senders", "unknown", "SELECT", "unresolvable_qualifier"),
    ("renamed_twice", "WITH k AS (SELECT parcel_id FROM parcels) SELECT k.route_code FROM handoffs k", "unknown", "SELECT", "alias_shadowed"),
    ("set_two", "UPDATE parcels SET weight_kg = 0, route_code = NULL", "hard", "SET", None),
    # every statement of a text counts
    ("second", "SELECT 1; DELETE FROM parcels WHERE route_code IS NULL", "hard", "WHERE", None),
    ("setting_first", "SET zone = 1; SELECT parcel_id FROM parcels ORDER BY route_code", "hard", "ORDER", None),
    ("transaction", "BEGIN; UPDATE parcels SET route_code = 'b' WHERE weight_kg > 1; COMMIT;", "hard", "SET", None),
    ("soft_then_hard", "SELECT route_code FROM parcels; SELECT 1 FROM parcels GROUP BY route_code", "hard", "GROUP", None),
    ("unread_second", "SELECT parcel_id FROM parcels WHERE route_code = 'a'; SELECT (", "unknown", "PARSE", "parse"),
    ("only_marks", ";;", "unknown", "PARSE", "parse"),
    # what nothing explains is not passed over
    ("words_in_a_row", "SELECT parcel_id kilo route_code FROM parcels", "unknown", "SELECT", "unexplained"),
    ("broken_condition", "SELECT parcel_id FROM parcels WHERE weight_kg route_code 1", "unknown", "WHERE", "unexplained"),
]
NO_REFERENCE = [
    "SELECT parcel_id FROM parcels -- route_code later",
    "SELECT /* route_code */ parcel_id FROM parcels",
    "SELECT 'route_code' AS k FROM parcels",
    "SELECT parcel_id AS route_code FROM parcels",
    "SELECT parcel_id route_code FROM parcels",
    "SELECT route_code(parcel_id) FROM parcels",
    "SELECT src:route_code FROM parcels",
    "SELECT * FROM handoffs",
    "SELECT my_route_code, route_code_2 FROM parcels",
    "INSERT INTO handoffs (route_code) VALUES ('x')",
    "SELECT parcel_id FROM parcels; SELECT sender_id FROM senders",
    "SELECT route_code.zone FROM parcels p JOIN route_code ON route_code.id = p.parcel_id",
    "SELECT parcel_id FROM parcels NATURAL JOIN senders",
    "SELECT 1 FROM senders NATURAL JOIN handoffs",
]
# A column named like a word of the language, dropped: statement and evidence.
LIKE_WORDS = [
    ("start", "SELECT parcel_id FROM parcels WHERE start > 5", "WHERE"),
    ("offset", "SELECT offset FROM parcels GROUP BY offset", "GROUP"),
    ("range", "SELECT parcel_id FROM parcels ORDER BY range DESC", "ORDER"),
    ("rows", "SELECT SUM(weight_kg) OVER (ORDER BY parcel_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM parcels", None),
    ("filter", "SELECT COUNT(*) FILTER (WHERE weight_kg > 1) FROM parcels", None),
    ("start", "SELECT parcel_id FROM parcels START WITH parcel_id = 1 CONNECT BY parcel_id = sender_id", None),
    ("offset", "SELECT parcel_id FROM parcels LIMIT 5 OFFSET 10", None),
    ("column", "UPDATE parcels SET column = 1", "SET"),
]


def classify(spark, statements, schema=SCHEMA, subject="depot.parcels", **options):
    changes = literal_rows(
        spark,
        "change_id string, dataset string, kind string, column string, new_column string",
        [("c1", subject, "rename", "route_code", "lane_code")],
    )
    log = literal_rows(
        spark,
        "query_id string, dataset string, sql string",
        [(name, subject, sql) for name, sql in statements],
    )
    columns = None
    if schema is not None:
        columns = literal_rows(
            spark,
            "table_name string, column_name string",
            [(t, c) for t, cols in schema.items() for c in cols],
        )
    found = bind.classify_log(changes, log, columns, ["route_code"], **options).collect()
    return {row["query_id"]: row for row in found}


@pytest.fixture(scope="module")
def verdicts(spark):
    statements = [(c[0], c[1]) for c in CASES]
    statements += [(f"none{i}", sql) for i, sql in enumerate(NO_REFERENCE)]
    return classify(spark, statements)


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_verdict(verdicts, case):
    name, _, severity, evidence, kind = case
    row = verdicts[name]
    assert (row["severity"], row["evidence"], row["unknown_kind"]) == (severity, evidence, kind)


@pytest.mark.parametrize("i", range(len(NO_REFERENCE)))
def test_no_reference_gives_no_finding(verdicts, i):
    assert f"none{i}" not in verdicts


def test_reasons(verdicts):
    assert verdicts["crowd"]["unknown_reason"] == "`route_code` without a qualifier fits 2 tables in scope"
    assert verdicts["no_schema"]["unknown_reason"] == "no schema for phantoms"
    assert "phantoms" in verdicts["free_name"]["unknown_reason"]
    assert "`k`" in verdicts["renamed_twice"]["unknown_reason"]
    assert "parse failed" in verdicts["template"]["unknown_reason"]


def test_columns_named_like_words(spark):
    changes = literal_rows(
        spark,
        "change_id string, dataset string, kind string, column string, new_column string",
        [(f"c{i}", f"d{i},parcels", "drop", word, None) for i, (word, _, _) in enumerate(LIKE_WORDS)],
    ).withColumn("subject", F.lit("parcels"))
    log = literal_rows(
        spark, "query_id string, dataset string, sql string", [(f"q{i}", f"d{i},parcels", sql) for i, (_, sql, _) in enumerate(LIKE_WORDS)]
    )
    columns = literal_rows(
        spark, "table_name string, column_name string",
        [("parcels", c) for c in ["parcel_id", "weight_kg", "sender_id", *{w for w, _, _ in LIKE_WORDS}]],
    )
    found = {r["query_id"]: r["evidence"] for r in bind.classify_log(changes, log, columns).collect()}
    assert found == {f"q{i}": evidence for i, (_, _, evidence) in enumerate(LIKE_WORDS) if evidence}


def test_without_subject_and_schema(spark):
    found = classify(
        spark,
        [
            ("where", "SELECT 1 FROM a WHERE route_code = 1"),
            ("select", "SELECT x.route_code FROM a x JOIN b y ON x.i = y.i"),
            ("bare", "SELECT 1 FROM a x JOIN b y ON x.i = y.i WHERE route_code = 1"),
            ("star", "SELECT * FROM anything"),
            ("insert", "INSERT INTO t (route_code) VALUES (1)"),
        ],
        schema=None,
        use_subject=False,
    )
    got = {k: (v["severity"], v["evidence"], v["unknown_kind"]) for k, v in found.items()}
    assert got == {
        "where": ("hard", "WHERE", None),
        "select": ("soft", "SELECT", None),
        "bare": ("unknown", "WHERE", "ambiguous_bare"),
        "star": ("unknown", "STAR", "star"),
        "insert": ("hard", "INSERT", None),
    }


def test_subject_without_schema_is_not_narrowed(spark):
    found = classify(
        spark,
        [("q", "SELECT 1 FROM parcels p JOIN senders s ON p.i = s.i WHERE route_code = 1")],
        schema=None,
    )
    assert found["q"]["unknown_kind"] == "ambiguous_bare"
