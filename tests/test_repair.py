"""Rewrites, refusals and diffs."""

import difflib

import pytest
from pyspark.sql import functions as F

from changeimpact.functions import lexicon
from changeimpact.operators import extract, repair
from changeimpact.plans.rehearse import rehearse
from changeimpact.session import literal_rows

CHANGES = "change_id string, dataset string, kind string, column string, new_column string"
STATEMENTS = {
    "hard": ("SELECT parcel_id\nFROM parcels -- route_code\nWHERE route_code = 'route_code'",
             "SELECT parcel_id\nFROM parcels -- route_code\nWHERE lane_code = 'route_code'"),
    "quoted": ('SELECT p."route_code" , `route_code` FROM parcels p', 'SELECT p."lane_code" , `lane_code` FROM parcels p'),
    "decoy_side": ("SELECT 1 FROM parcels p JOIN handoffs h ON p . route_code = h.route_code",
                   "SELECT 1 FROM parcels p JOIN handoffs h ON p . lane_code = h.route_code"),
    "escaped": (r"SELECT route_code FROM parcels WHERE parcel_id = 'it\'s route_code'",
                r"SELECT lane_code FROM parcels WHERE parcel_id = 'it\'s route_code'"),
    "numbers": ("SELECT 1e5, 15, route_code, a2 FROM parcels LIMIT 100", "SELECT 1e5, 15, lane_code, a2 FROM parcels LIMIT 100"),
    "star_left": ("WITH o AS (SELECT * FROM parcels) SELECT 1 FROM o WHERE route_code = 1", None),
    "using": ("SELECT p.route_code FROM parcels p JOIN handoffs USING (route_code)", None),
    "cleared": ("SELECT h.route_code FROM handoffs h", None),
    "twice": ("SELECT route_code FROM parcels", None),
}


@pytest.fixture(scope="module")
def repairs(spark):
    rows = [(k, "parcels", sql) for k, (sql, _) in STATEMENTS.items()] + [("twice", "parcels", "SELECT 1 FROM parcels WHERE route_code = 1")]
    log = literal_rows(spark, "query_id string, dataset string, sql string", rows)
    schema = literal_rows(spark, "table_name string, column_name string", [
        ("parcels", "parcel_id"), ("parcels", "route_code"), ("handoffs", "route_code")])
    changes = literal_rows(spark, CHANGES, [
        ("r", "parcels", "rename", "route_code", "lane_code"), ("d", "parcels", "drop", "route_code", None)])
    return rehearse(changes, log, schema).repairs.collect()


@pytest.mark.parametrize("name", list(STATEMENTS))
def test_rewrite(repairs, name):
    sql, want = STATEMENTS[name]
    for row in [r for r in repairs if r["change_id"] == "r" and r["query_id"] == name]:
        assert row["rewritten_sql"] == want
        assert row["action"] == ("patch" if want else "refuse")
        assert (row["reason"] is None) == (want is not None)
        if want:
            expected = difflib.unified_diff(
                (sql + "\n").splitlines(True), (want + "\n").splitlines(True), f"a/{name}.sql", f"b/{name}.sql")
            assert row["unified_diff"] == "".join(expected)


def test_reasons(repairs):
    reason = {r["query_id"]: r["reason"] for r in repairs if r["change_id"] == "r"}
    assert reason["star_left"] == repair.RESIDUAL_STAR_REASON
    assert reason["using"].startswith("the rewritten statement still refers to the column")
    assert reason["cleared"] == "bound elsewhere — handoffs"
    assert [r["reason"] for r in repairs if r["change_id"] == "r" and r["query_id"] == "twice"] == [repair.DUPLICATE_REASON] * 2
    drops = [r for r in repairs if r["change_id"] == "d" and r["query_id"] != "twice"]
    assert drops and all(r["reason"] == repair.DROP_REASON and r["severity"] is None for r in drops)


@pytest.mark.parametrize("changed", [[0], [3], [9], [0, 9], [2, 3, 4], [0, 7], [1, 8], [0, 8], list(range(10)), [4, 5, 9]])
def test_diff_equals_difflib(spark, changed):
    before = [f"line {i}" for i in range(10)]
    after = [f"{x} new" if i in changed else x for i, x in enumerate(before)]
    a, b = "\n".join(before), "\n".join(after)
    want = "".join(difflib.unified_diff(
        (a + "\n").splitlines(True), (b + "\n").splitlines(True), "a/q.sql", "b/q.sql"))
    df = spark.createDataFrame([(a, b, "q")], "a string, b string, q string")
    assert df.select(repair.unified_diff(F.col("a"), F.col("b"), F.col("q"))).first()[0] == want


def test_schema_after(spark):
    schema = literal_rows(spark, "table_name string, column_name string", [("a", "Old"), ("b", "old"), ("b", "x")])
    got = {(r[0], r[1]) for r in repair.schema_after(schema, "old", "new").collect()}
    assert got == {("a", "new"), ("b", "new"), ("b", "x")}


def test_shape_pieces_match_statement_pieces(spark):
    """The n-th name piece of a shape is the n-th name piece of every statement behind it."""
    log = spark.createDataFrame(
        [(sql, "d", k) for k, (sql, _) in STATEMENTS.items()], "sql string, dataset string, query_id string")
    piece = F.lit(r'^[\p{L}_"`]')
    split = lambda c: F.filter(
        F.regexp_extract_all(c, F.lit(lexicon.lossless_pattern("snowflake")), F.lit(0)), lambda t: F.rlike(t, piece))
    marked = extract.fingerprint_log(log)
    assert marked.where(split(F.col("sql")) != split(F.col("shape"))).count() == 0
