"""The record of a run, rulings of plug-ins and given baselines."""

import pytest
from pyspark.sql import functions as F

from changeimpact.operators import adjudicate, catalog
from changeimpact.plans.rehearse import rehearse
from changeimpact.session import literal_rows
from changeimpact.sources import runs

CHANGES = "change_id string, dataset string, kind string, column string, new_column string"


def small_run(spark, **options):
    log = literal_rows(spark, "query_id string, dataset string, sql string", [
        ("a", "parcels", "SELECT 1 FROM parcels WHERE route_code = 1"),
        ("b", "parcels", "SELECT route_code FROM parcels p JOIN routes r ON p.id = r.id"),
        ("c", "parcels", "SELECT route_code FROM parcels p JOIN routes r ON p.id = r.id"),
        ("d", "parcels", "SELECT ((route_code FROM parcels")])
    changes = literal_rows(spark, CHANGES, [("x", "parcels", "rename", "route_code", "lane")])
    schema = literal_rows(spark, "table_name string, column_name string", [
        ("parcels", "route_code"), ("parcels", "id"), ("routes", "route_code"), ("routes", "id")])
    return rehearse(changes, log, schema, **options)


def test_a_run_is_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "runs")
    good = spark.range(5).withColumn("change_id", F.lit("x"))
    broken = good.withColumn("bad", F.raise_error(F.lit("disk gone")).cast("string"))
    assert runs.complete_runs(spark, path).count() == 0
    with pytest.raises(Exception, match="disk gone"):
        runs.write_run({"findings": good.limit(2), "report": broken}, path, "0012")
    with pytest.raises(runs.NoSuchRun):
        runs.read_table(spark, path, "findings", "0012")
    runs.write_run({"findings": good, "report": good.limit(0)}, path, "0012")
    assert runs.read_table(spark, path, "findings", "0012").count() == 5
    empty = runs.read_table(spark, path, "report", "0012")
    assert empty.columns == ["id", "change_id", "run_id"] and empty.count() == 0
    with pytest.raises(runs.RunExists):
        runs.write_run({"findings": good}, path, "0012")
    # A run that broke off lies beside complete ones and is not read with them.
    with pytest.raises(Exception, match="disk gone"):
        runs.write_run({"findings": good, "report": broken}, path, "b")
    runs.write_run({"findings": good.limit(1)}, path, "c")
    counts = runs.read_table(spark, path, "findings").groupBy("run_id").count().collect()
    assert {tuple(r) for r in counts} == {("0012", 5), ("c", 1)}
    assert {tuple(r) for r in runs.complete_runs(spark, path).select("run_id", "table_name", "n_rows").collect()} == {
        ("0012", "findings", 5), ("0012", "report", 0), ("c", "findings", 1)}
    for name in ("../x", "", "_x", "a/b"):
        with pytest.raises(ValueError):
            runs.write_run({"findings": good}, path, name)


def test_damage_is_found(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.createDataFrame([(1, "a", None), (2, None, 0.5), (2, None, 0.5)], "k int, t string, v double")
    runs.write_run({"one": rows, "two": rows}, path, "r")
    assert runs.damaged_tables(spark, path, "r").count() == 0
    rows.withColumn("t", F.lit("a")).write.mode("overwrite").parquet(f"{path}/two/run_id=r")
    assert [r[0] for r in runs.damaged_tables(spark, path, "r").collect()] == ["two"]


def test_rehearsal_tables_and_rulings_of_a_plugin(spark, tmp_path):
    asked_file = tmp_path / "asked"
    asked_file.mkdir()

    def plugin(asked):
        (asked_file / asked["sid"].hex()).touch()
        if asked["evidence"] == "PARSE":
            raise KeyError("no model")
        return "hard", f"{asked['tables']} {asked['fields']}"

    fields = literal_rows(spark, "change_id string, field string", [("x", "id"), ("x", "route_code")])
    run = small_run(spark, plugin=plugin, fields=fields)
    found = {r["query_id"]: (r["severity"], r["agent_note"]) for r in run.findings.collect()}
    note = "['parcels', 'routes'] ['id', 'route_code']"
    assert found == {"a": ("hard", None), "b": ("hard", note), "c": ("hard", note),
                     "d": ("unknown", "no ruling, the plug-in failed: KeyError: 'no model'")}
    assert len(list(asked_file.iterdir())) == 2  # two shapes, though three statements are UNKNOWN
    counts = run.summary.first()
    assert (counts["n_hard"], counts["n_unknown"]) == (3, 1)
    path = str(tmp_path / "runs")
    runs.write_run(run.tables(), path, "r")
    assert runs.read_table(spark, path, "rulings", "r").where("failed").count() == 1
    assert runs.read_table(spark, path, "findings", "r").count() == 4


def test_answers_that_are_no_rulings_and_silence(spark):
    run = small_run(spark)
    requests = adjudicate.shape_requests(run.verdicts)
    for answer in (("perhaps", "x"), "hard", ("hard",), 5, ("hard", 5)):
        ruled = adjudicate.shape_rulings(requests, lambda asked: answer)
        rows = ruled.collect()
        assert len(rows) == 2 and all(r["failed"] and r["severity"] == "unknown" for r in rows)
    assert adjudicate.rule_shapes(run.verdicts, ruled).where("severity = 'unknown'").count() == 2
    silent = adjudicate.shape_rulings(requests, lambda asked: None)
    assert silent.count() == 0 and adjudicate.rule_shapes(run.verdicts, silent).where("severity = 'unknown'").count() == 2
    assert adjudicate.shape_rulings(requests.limit(0), lambda asked: ("hard", None)).count() == 0


def test_given_baseline(spark):
    given = literal_rows(spark, "change_id string, lineage_dependent_count bigint", [("x", 4), ("y", None)])
    lines = {r["line"] for r in small_run(spark, baseline=given).report().collect()}
    assert "Impact Analysis baseline: 4 downstream dependents (baseline: user-supplied)" in lines
    none = small_run(spark, baseline=given.where("change_id = 'y'")).report()
    assert "Impact Analysis baseline: 0 downstream dependents" in {r["line"] for r in none.collect()}
    counted = literal_rows(spark, "change_id string, lineage_dependent_count bigint", [("x", 2), ("y", 3)])
    assert {tuple(r) for r in catalog.given_counts(given, counted).collect()} == {("x", 4), ("y", 3)}


def test_heuristic_of_a_rehearsal_asks_the_fields(spark):
    with_it = literal_rows(spark, "change_id string, field string", [("x", "Route_Code")])
    without = literal_rows(spark, "change_id string, field string", [("x", "id")])
    for fields, severity in ((with_it, "soft"), (without, "unknown")):
        found = small_run(spark, heuristic=True, fields=fields).findings.where("query_id = 'b'").first()
        assert found["severity"] == severity
