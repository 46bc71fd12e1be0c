"""Order, dedupe, gate and counts on small tables."""

import pytest
from pyspark.sql import functions as F

from changeimpact.functions import predicates
from changeimpact.operators import adjudicate, bind, findings, quality, ranking
from changeimpact.session import literal_rows

SCHEMA = (
    "change_id string, query_id string, sql_snippet string, severity string, column string, evidence string, "
    "exec_count bigint, agent_note string, unknown_reason string, unknown_kind string"
)


def finding(change, query, severity, evidence="WHERE", count=None, reason=None, kind=None):
    return (change, query, f"SELECT {query}", severity, "col", evidence, count, None, reason, kind)


@pytest.fixture(scope="module")
def found(spark):
    return literal_rows(spark, SCHEMA, [
        finding("a", "q1", "soft", "SELECT", 5),
        finding("a", "q2", "hard", count=1),
        finding("a", "q3", "hard", count=None),
        finding("a", "q0", "hard", count=9),
        finding("a", "q4", "unknown", "PARSE", kind="parse", reason="parse failed: x"),
        finding("a", "q5", "unaffected", "BOUND_ELSEWHERE:t,u"),
        finding("b", "q6", "unknown", "PARSE", kind="parse", reason="parse failed: x"),
        finding("c", "q7", "soft", "SELECT"),
    ])


@pytest.fixture(scope="module")
def changes(spark):
    return literal_rows(spark, "change_id string", [("a",), ("b",), ("c",), ("d",)])


def test_rank_and_position(found):
    plain = [r["query_id"] for r in ranking.rank_findings(found).where("change_id = 'a'").collect()]
    assert plain == ["q0", "q2", "q3", "q1", "q4", "q5"]
    placed = ranking.with_position(found, True).where("change_id = 'a'").collect()
    assert {r["query_id"]: r["position"] for r in placed} == {
        "q0": 1, "q2": 2, "q3": 3, "q1": 4, "q4": 5, "q5": 6}


def test_positions_hold_when_one_change_owns_most_rows(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 50 == 0, "small").otherwise("hot").alias("change_id"),
        F.concat(F.lit("q"), F.col("id").cast("string")).alias("query_id"),
        F.when(F.col("id") % 3 == 0, "hard").otherwise("soft").alias("severity"),
        (F.col("id") % 7).alias("exec_count"),
    )
    placed = ranking.with_position(rows, True).collect()
    tiers = {"hard": 0, "soft": 1}
    for change in ("hot", "small"):
        mine = [r for r in placed if r["change_id"] == change]
        mine.sort(key=lambda r: (tiers[r["severity"]], -r["exec_count"], r["query_id"]))
        assert [r["position"] for r in mine] == list(range(1, len(mine) + 1))


def test_dedupe_keeps_first_in_order(spark):
    log = spark.createDataFrame(
        [(3, "d", "SELECT  1"), (1, "d", "select 1"), (2, "d", "SELECT 2"), (0, "e", "select\n1")],
        "seq int, dataset string, sql string")
    kept = {(r["dataset"], r["seq"]) for r in ranking.dedupe_statements(log).collect()}
    assert kept == {("d", 1), ("d", 2), ("e", 0)}


def test_gate_exit_codes(found, changes):
    strict = {r["change_id"]: r for r in findings.gate(changes, found, "hard,unknown").collect()}
    assert [strict[c]["exit_code"] for c in "abcd"] == [1, 1, 0, 0]
    assert strict["a"]["n_triggered"] == 4 and strict["a"]["n_cleared"] == 1 and strict["a"]["note"] is None
    loose = {r["change_id"]: r for r in findings.gate(changes, found, "hard").collect()}
    assert [loose[c]["exit_code"] for c in "abcd"] == [1, 2, 0, 0]
    assert [loose[c]["clean"] for c in "abcd"] == [False, False, True, True]
    assert loose["b"]["note"].endswith("not clean") and "could not be read" in loose["a"]["note"]


def test_fail_on_is_validated():
    assert predicates.parse_fail_on(" Hard, unknown") == ["hard", "unknown"]
    for bad in ("", "unaffected", "loud"):
        with pytest.raises(ValueError):
            predicates.parse_fail_on(bad)


def test_worst_severity(found, changes):
    got = {r[0]: r[1] for r in findings.worst_severity(changes, found).collect()}
    assert got == {"a": "hard", "b": "unknown", "c": "soft", "d": None}


def test_counts_weigh_shapes_like_statements(spark, found):
    shapes = found.withColumn("n_statements", F.lit(3).cast("bigint"))
    once = {r["change_id"]: r["n_hard"] for r in findings.severity_counts(found).collect()}
    thrice = {r["change_id"]: r["n_hard"] for r in findings.severity_counts(shapes).collect()}
    assert thrice == {k: 3 * v for k, v in once.items()}


def test_rulings_change_only_unknowns(spark, found):
    rulings = literal_rows(spark, "change_id string, query_id string, severity string, note string", [
        ("a", "q1", "hard", "no"), ("a", "q4", "hard", "bound"), ("b", "q6", "unknown", "cannot tell")])
    got = {r["query_id"]: r for r in adjudicate.apply_rulings(found, rulings).collect()}
    assert got["q1"]["severity"] == "soft" and got["q1"]["agent_note"] is None
    assert (got["q4"]["severity"], got["q4"]["agent_note"], got["q4"]["unknown_reason"]) == ("hard", "bound", None)
    assert got["q4"]["unknown_kind"] == "parse"
    assert (got["q6"]["severity"], got["q6"]["agent_note"]) == ("unknown", "cannot tell")
    assert got["q6"]["unknown_reason"] == "parse failed: x"


def test_residue_goes_by_kind(spark):
    rows = literal_rows(spark, SCHEMA, [
        finding("a", "kind", "unknown", kind="ambiguous_bare", reason="other words"),
        finding("a", "parse", "unknown", kind="parse", reason="2 tables in scope"),
        finding("a", "worded", "unknown", reason="unqualified with 2 tables in scope"),
        finding("a", "star", "unknown", "STAR", reason="tables in scope"),
        finding("a", "hard", "hard", kind="ambiguous_bare"),
    ])
    assert {r["query_id"] for r in adjudicate.residue(rows).collect()} == {"kind"}


def test_metrics_against_brute_force(spark):
    cases = [("r", str(i), ["decoy", "other"][i % 2], g, p)
             for i, (g, p) in enumerate([("hard", "hard"), ("hard", "soft"), ("unaffected", "hard"),
                                         ("unknown", "unknown"), ("unaffected", "unaffected")])]
    df = spark.createDataFrame(cases, "run string, query_id string, stratum string, gold string, predicted string")
    row = quality.run_metrics(df).first()
    assert (row["accuracy"], row["hard_precision"], row["hard_recall"], row["unknown_rate"]) == (0.6, 0.5, 0.5, 0.2)
    assert row["decoy_fp_rate"] == round(2 / 3, 6)
    matrix = {(r["gold"], r["predicted"]): r["n"] for r in quality.confusion_matrix(df).collect()}
    assert len(matrix) == 16 and matrix[("hard", "soft")] == 1 and matrix[("soft", "soft")] == 0
    metrics = {r["class"]: (r["precision"], r["recall"]) for r in quality.class_metrics(df).collect()}
    assert metrics["soft"] == (0.0, None)


def test_duplicate_ids_are_flagged_with_text(spark, found):
    log = literal_rows(spark, "query_id string, sql string", [("q1", "S1"), ("q2", "S2"), ("q2", "S3")])
    got = {r["query_id"]: r for r in bind.with_statement_text(found, log).collect()}
    assert got["q1"]["sql"] == "S1" and not got["q1"]["duplicate_id"]
    assert got["q2"]["duplicate_id"] and got["q4"]["sql"] == "SELECT q4"


def test_hot_shapes_are_spread_and_stay_whole(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 90).cast("string"))).alias("sid"),
        F.concat(F.lit("q"), F.col("id").cast("string")).alias("query_id"))
    verdicts = rows.groupBy("sid").agg(F.count("*").alias("n_statements")).withColumn("change_id", F.lit("c"))
    verdicts = verdicts.unionByName(verdicts.withColumn("change_id", F.lit("d")))
    got = bind.join_verdicts(rows, verdicts)
    assert got.count() == 2000 and got.distinct().count() == 2000
    assert sorted(got.columns) == ["change_id", "query_id", "sid"]


def test_rulings_do_not_multiply_repeated_ids(spark):
    rows = literal_rows(spark, SCHEMA, [finding("a", "same", "unknown", e) for e in ("WHERE", "SELECT", "STAR")])
    assert {(r["evidence"], r["severity"]) for r in adjudicate.adjudicate(rows).collect()} == {
        ("WHERE", "hard"), ("SELECT", "soft"), ("STAR", "unknown")}
    assert adjudicate.adjudicate(rows, adjudicate.heuristic_rulings).count() == 3
