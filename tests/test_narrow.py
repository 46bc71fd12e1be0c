"""Shapes that keep only what can matter to the changed names give what whole shapes give."""

import pytest
from pyspark.sql import functions as F

from changeimpact.functions import lexicon
from changeimpact.operators import extract, repair
from changeimpact.plans import fixtures as fx
from changeimpact.plans.rehearse import kept_names, rehearse
from changeimpact.session import literal_rows

CHANGED = "change_id string, dataset string, kind string, column string, new_column string"
SCHEMA = {"bay.crates": "crate_id seal dock_id", "bay.docks": "dock_id dock_name", "bay.labels": "crate_id seal stamp"}

ODD = [
    "SELECT a.b.c, a.b.seal, a.seal.c, seal.a.b, x.y.z.seal.q.w FROM a.b.crates",
    "SELECT c.*, a.b.* FROM \"A b\".\"q\".crates c",
    "SELECT `x`.`y`.`z` FROM `p.q`.r.crates WHERE \"a\".\"seal\" = 1",
    "SELECT SEAL.x FROM s1.SEAL.crates e WHERE s1.crates.Seal.y > 2",
    "SELECT 1a.b.c, 1.5.d.e, $x.y.z, seal FROM q . w . crates",
    "SELECT \"AND OR\".x, seal FROM a.\"un terminated.b",
    "SELECT é.ü.seal, sealed.x FROM ñ.ö.crates",
    "SELECT by.x.y, 2, seal FROM s.t.crates ORDER BY 3, 2",
    "SELECT stamp FROM a.stamp.crates x JOIN q.labels p ON x.stamp.a.b = p.w.seal",
    "SELECT e.seal FROM tenant_1.crates e JOIN tenant_2.seal seal ON seal.seal.seal = e.seal",
    "SELECT \"x.seal\".y, t.\"x.seal\".z, u.v.\"x.y\" FROM a.b.crates t",
    "INSERT INTO a.b.crates (a.seal, q.w.seal) SELECT natural.x.y, 1 FROM z.y.w",
    "WITH w.x.y AS (SELECT * FROM a.crates) SELECT seal FROM y",
    "SELECT dock_id FROM a.b.natural NATURAL JOIN c.crates",
    "SELECT a.\"b\"\"c\".d FROM t.u.crates WHERE x.y.seal = 1",
    "MERGE INTO a.b.crates t USING c.d.labels s ON s.x.crate_id = t.crate_id WHEN MATCHED THEN UPDATE SET t.seal = s.q.seal",
    "SELECT a.b.crates.stamp.x FROM a.b.crates WHERE a.b.crates.seal.x = 1; DROP TABLE q.w.e",
]


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def inputs(spark):
    changes = literal_rows(spark, CHANGED, [("r", "bay.crates", "rename", "Seal", "stamp"), ("d", "bay.crates", "drop", "dock_id", None)])
    schema = literal_rows(spark, "table_name string, column_name string", [(t, c) for t, cs in SCHEMA.items() for c in cs.split()])
    log = spark.createDataFrame([(f"q{i}", sql, "bay.crates") for i, sql in enumerate(ODD)], "query_id string, sql string, dataset string")
    return changes, log, schema


def test_verdicts_and_repairs_are_those_of_whole_shapes(spark, inputs):
    changes, log, schema = inputs
    narrow, whole = rehearse(changes, log, schema), rehearse(changes, log, schema, names=None)
    assert narrow.names == ["dock_id", "seal", "stamp"]
    assert narrow.findings.count() >= len(ODD)
    assert _rows(narrow.findings) == _rows(whole.findings)
    assert _rows(narrow.repairs) == _rows(whole.repairs)
    trips = [repair.round_trip_summary(repair.round_trip(r.decisions, changes, schema, r.columns)) for r in (narrow, whole)]
    assert _rows(trips[0]) == _rows(trips[1])
    bare = [rehearse(changes, log, None, use_subject=False, **more).findings for more in ({}, {"names": None})]
    assert _rows(bare[0]) == _rows(bare[1])


def test_shapes_do_not_grow_with_the_schemas_that_statements_name(spark):
    def log(tenants):
        rows = [
            (f"q{i}t{t}", x.sql.replace("{t}", str(t)).replace("{v}", "7").replace("{e}", "9"), x.dataset)
            for i, x in enumerate(fx.TEMPLATES) for t in range(tenants)
        ]
        return rehearse(fx.changes(spark), spark.createDataFrame(rows, "query_id string, sql string, dataset string"), fx.schema_columns(spark))

    one, many = log(1), log(30)
    assert one.shapes.count() == many.shapes.count() <= fx.N
    assert one.verdicts.count() == many.verdicts.count()
    assert many.findings.count() == 30 * one.findings.count()
    assert many.decisions.count() == one.decisions.count()


def test_plugins_are_asked_about_whole_shapes(spark, inputs):
    changes, _, schema = inputs
    rows = [(f"q{i}", f"SELECT crate_id FROM t{i}.crates c JOIN t{i}.labels l ON l.crate_id = c.crate_id WHERE seal = 1", "bay.crates") for i in (1, 2, 3)]
    log = spark.createDataFrame(rows * 2, "query_id string, sql string, dataset string")

    def plugin(asked):
        return "hard", asked["shape"]

    run = rehearse(changes, log, schema, plugin=plugin)
    assert run.verdicts.count() == 1 and run.shape_verdicts.count() == 3
    assert {r["n_statements"] for r in run.shape_verdicts.collect()} == {2}
    assert {(r["query_id"], r["agent_note"][21:30]) for r in run.findings.collect()} == {(f"q{i}", f"t{i}.crates") for i in (1, 2, 3)}


def test_names_whose_case_is_not_folded_alike_keep_shapes_whole(spark, inputs):
    log = extract.fingerprint_log(inputs[1])
    assert extract.narrow_shapes(log, ["straße"]) is log and extract.narrow_shapes(log, None) is log
    named = kept_names(literal_rows(spark, CHANGED, [("r", "bay.crates", "rename", "B", "a"), ("d", "bay.crates", "drop", "c", None)]))
    assert named == ["a", "b", "c"]


def test_narrowing_touches_few_places_and_reads_names_one_by_one(spark):
    """Plain words are passed over with the name before them; the result is that of a match per name."""
    letter, taken = r"[\p{L}\p{N}_$]", "dock_id|seal|stamp"
    free = "|".join(
        [rf"(?!(?iu:{taken})(?!{letter}))[\p{{L}}_]{letter}*+"]
        + [rf'{quote}(?!(?iu:{taken}){quote})[^"`.\s]++{quote}' for quote in '"`']
    )
    name = rf"{lexicon.PIECE}(?:{lexicon.DOT}{lexicon.PIECE})*+"
    each = rf"(?:{free})(?=(?:{lexicon.DOT}({free}))++)|({name})"
    odd = ODD + ["a b.c", "0a.b $a.b a$.b", "a . b\n.c d", "x \"a.b\" c.d", "a.", "a .", ".a.b", "a b `c", "é.b ü é.seal", ""]
    rows = spark.createDataFrame([(t,) for t in odd], "shape string")
    pattern = lexicon.leading_parts(["dock_id", "seal", "stamp"])
    got = rows.select(F.regexp_replace("shape", pattern, "$1$2"), F.regexp_replace("shape", each, "$1$2")).collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    plain = rows.limit(1).select(F.regexp_count(F.lit("SELECT a, b FROM t.crates c WHERE c.a > 0 AND b < 0 ORDER BY a"), F.lit(pattern)))
    assert plain.first()[0] <= 5  # the words in front, and two for each of the dotted names
