"""Readers, sinks, catalog joins and report text."""

import json
import random

import pytest

from changeimpact.operators import catalog, report
from changeimpact.plans.rehearse import rehearse, rehearse_from_catalog
from changeimpact.session import literal_rows
from changeimpact.sources import readers, sinks

CHANGES = "change_id string, dataset string, kind string, column string, new_column string"
URN = "urn:li:dataset:(urn:li:dataPlatform:snowflake,wh.depot.{0},PROD)"


def test_sql_folder_and_schema_json(spark, tmp_path):
    (tmp_path / "one.sql").write_text("SELECT route_code\nFROM parcels")
    (tmp_path / "note.txt").write_text("no")
    rows = readers.read_sql_folder(spark, str(tmp_path), "parcels").collect()
    assert [tuple(r) for r in rows] == [("one", "SELECT route_code\nFROM parcels", "parcels")]
    empty = tmp_path / "none"
    empty.mkdir()
    with pytest.raises(ValueError):
        readers.read_sql_folder(spark, str(empty), "parcels")
    with pytest.raises(ValueError):
        readers.read_sql_folder(spark, str(tmp_path), "")
    for name, body in (("bare", {"t": ["a", "b"]}), ("wrapped", {"tables": {"t": ["a", "b"]}})):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(body, indent=1))
        assert {tuple(r) for r in readers.read_schema_json(spark, str(path)).collect()} == {("t", "a"), ("t", "b")}


def test_sql_tree(spark, tmp_path):
    keep, skip = tmp_path / "sql" / "deep", tmp_path / "tests"
    keep.mkdir(parents=True)
    skip.mkdir()
    (keep / "a.sql").write_bytes(b"SELECT route_code FROM {{ ref('x') }} parcels \xff")
    (keep / "b.sql").write_text("SELECT my_route_code FROM parcels")
    (skip / "c.sql").write_text("SELECT route_code FROM parcels")
    rows = readers.read_sql_tree(spark, str(tmp_path), "parcels", "route_code").collect()
    assert len(rows) == 1 and rows[0]["had_templates"] and "__JINJA__" in rows[0]["sql"]


def test_seed_and_gold(spark, tmp_path):
    seed = tmp_path / "seed.json"
    seed.write_text(json.dumps({"dataset_urn": "d", "queries": [
        {"query_id": "a", "sql": "S1", "exec_count": 3}, {"sql": "S2"}, {"query_id": "c", "sql": ""}]}))
    log = readers.read_seed_json(spark, str(seed))
    assert {tuple(r) for r in log.collect()} == {("a", "S1", "d", 3), ("query", "S2", "d", None)}
    gold = tmp_path / "labels.json"
    gold.write_text(json.dumps({"cases": [{"id": "a", "stratum": "s", "gold": "hard"}]}))
    assert readers.read_gold(spark, str(gold), log).first()["sql"] == "S1"


def test_sinks(spark, tmp_path):
    log = literal_rows(spark, "query_id string, dataset string, sql string", [
        ("b", "parcels", "SELECT route_code FROM parcels"),
        ("a", "parcels", "SELECT 1 FROM parcels WHERE route_code = 1")])
    changes = literal_rows(spark, CHANGES, [("c", "parcels", "rename", "route_code", "lane")])
    run = rehearse(changes, log)
    sinks.write_findings_json(run.findings, str(tmp_path / "f"))
    ids = [r["query_id"] for r in spark.read.json(str(tmp_path / "f")).collect()]
    assert ids == ["a", "b"]
    sinks.write_report(run.report(), str(tmp_path / "r"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "r" / "change_id=c")).collect()]
    assert lines == [
        "Schema rehearsal: route_code → rename to lane", "", "Impact Analysis baseline: 0 downstream dependents", "",
        "HARD (1)", "- a — [WHERE] `SELECT 1 FROM parcels WHERE route_code = 1`", "",
        "SOFT (1)", "- b — [SELECT] `SELECT route_code FROM parcels`", "",
        "UNKNOWN / needs human (0)", "- (none)", "", report.CLEARED_HEADING + " (0)", "- (none)", "",
        "No query evidence of `route_code` on subject: 0",
    ]
    sinks.write_patches(run.repairs, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    with pytest.raises(sinks.WriteBackDisabled):
        sinks.write_back(log, log, log, str(tmp_path / "w"))


def test_best_dataset_prefers_platform_then_path(spark):
    wanted = literal_rows(spark, "change_id string, dataset string, table_name string", [
        ("c", URN.format("parcels"), "Handoffs"), ("c", URN.format("parcels"), "nowhere")])
    datasets = literal_rows(spark, "urn string", [
        (URN.format("handoffs"),), (URN.format("handoffs").replace("snowflake", "dbt"),),
        (URN.format("handoffs").replace("depot", "other"),), (URN.format("xhandoffs"),)])
    rows = catalog.best_datasets(wanted, datasets).collect()
    assert [tuple(r) for r in rows] == [("c", "handoffs", URN.format("handoffs"), 16)]


def _best_by_pairs(wanted, datasets):
    """Every change beside every dataset of the same base name."""
    def parts(urn):
        platform, name, _ = urn.split("dataPlatform:", 1)[1].lower().split(",", 2)
        return platform, name

    best = {}
    for change, dataset, table in wanted:
        platform, path = parts(dataset)
        parent = path.rsplit(".", 1)[0]
        for urn in datasets:
            own, name = parts(urn)
            if name.rsplit(".", 1)[-1] == table.lower():
                score = 10 * (own == platform) + 5 * name.startswith(parent) + ("." in name)
                best[change, table.lower()] = min(best.get((change, table.lower()), (1, "")), (-score, urn))
    return {(change, table, urn, -order) for (change, table), (order, urn) in best.items()}


def test_best_datasets_equal_scoring_of_pairs(spark):
    draw = random.Random(3)
    urn = lambda: "urn:li:dataset:(urn:li:dataPlatform:{},{},PROD)".format(
        draw.choice(["dbt", "Snowflake", "hive"]),
        ".".join([*draw.choices(["a", "ab", "A", "b", "abc"], k=draw.randrange(4)), draw.choice(["t", "T2", "u"])]),
    )
    datasets = sorted({urn() for _ in range(120)})
    wanted = [(f"c{i}", urn(), draw.choice(["t", "t2", "U", "none"])) for i in range(150)]
    rows = catalog.best_datasets(
        literal_rows(spark, "change_id string, dataset string, table_name string", wanted + wanted[:9]),
        literal_rows(spark, "urn string", [(u,) for u in datasets]),
    ).collect()
    assert len(rows) == len({tuple(r) for r in rows}) and {tuple(r) for r in rows} == _best_by_pairs(wanted, datasets)
    none = catalog.best_datasets(
        literal_rows(spark, "change_id string, dataset string, table_name string", [("c", None, "t"), ("d", "odd", "t"), ("e", None, None)]),
        literal_rows(spark, "urn string", [(datasets[0].replace(",", ",x."),), (None,)]),
    )
    assert none.count() <= 2


def test_catalog_rehearsal(spark):
    log = literal_rows(spark, "seq int, query_id string, dataset string, sql string", [
        (1, "narrow", URN.format("parcels"), "SELECT p.id FROM parcels p JOIN senders s ON p.id = s.id WHERE route_code = 1"),
        (2, "again", URN.format("parcels"), "select p.id from PARCELS p  join senders s ON p.id = s.id WHERE route_code = 1"),
        (3, "ghost", URN.format("parcels"), "SELECT p.id FROM parcels p JOIN ghosts g ON p.id = g.id WHERE route_code = 1")])
    fields = literal_rows(spark, "urn string, field_path string", [
        (URN.format("parcels"), "rec.route_code"), (URN.format("parcels"), "id"), (URN.format("senders"), "id"), (URN.format("senders"), None)])
    edges = literal_rows(spark, "upstream string, downstream string", [
        (URN.format("parcels"), URN.format("parcels")), (URN.format("parcels"), "down")])
    changes = literal_rows(spark, CHANGES, [
        ("ok", URN.format("parcels"), "rename", "ROUTE_CODE", "lane"), ("bad", URN.format("parcels"), "rename", "nope", "x"),
        ("none", URN.format("senders"), "drop", "id", None)])
    run, rejected, unresolved = rehearse_from_catalog(changes, log, fields.select("urn").distinct(), fields, edges)
    assert {r[0]: r[1].split(" for ")[0] for r in rejected.collect()} == {
        "bad": "column `nope` not in schema", "none": "no queries"}
    assert [tuple(r) for r in unresolved.collect()] == [("ok", "ghosts")]
    got = {r["query_id"]: (r["severity"], r["unknown_kind"]) for r in run.findings.collect()}
    assert got == {"narrow": ("hard", None), "ghost": ("unknown", "unresolved_table")}
    summary = run.summary.first()
    assert (summary["n_queries"], summary["lineage_dependent_count"]) == (2, 1)
    owners = literal_rows(spark, "urn string, owner string", [("down", "urn:li:corpuser:kim")])
    lines = [r["line"] for r in report.notify_lines(run.notify(owners)).orderBy("block", "place", "urn").collect()]
    assert lines == [
        "HARD priority", "- `down` (downstream) → kim (`urn:li:corpuser:kim`)", "", "no owners recorded",
        f"- `{URN.format('parcels')}` (subject, worst=hard)"]


def test_prefer_log_and_pull(spark):
    rows = literal_rows(spark, "urn string, name string, sql string, dataset string", [
        ("u1", None, "S", "d"), ("u2", "n2", "S", "d"), (None, None, "S", "d"), ("u4", "n4", "", "d")])
    log = catalog.pull_log(rows)
    assert {r["query_id"] for r in log.collect()} == {"u1", "n2", "query"}
    seed = literal_rows(spark, "query_id string, sql string, dataset string", [("s1", "S", "d"), ("s2", "S", "e")])
    assert {r["query_id"] for r in catalog.prefer_log(log, seed).collect()} == {"u1", "n2", "query", "s2"}
    assert {r["query_id"] for r in catalog.prefer_log(log, seed, True).collect()} == {"s1", "s2"}


def test_description(spark):
    rows = literal_rows(spark, "urn string, editable string, properties string", [
        ("a", "mine", "src"), ("b", "", "src"), ("c", None, None)])
    assert {r[0]: r[1] for r in catalog.description_of(rows).collect()} == {"a": "mine", "b": "src", "c": ""}
