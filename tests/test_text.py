"""Text scalars against plain Python on awkward input."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from changeimpact.functions import lexicon, text
from changeimpact.session import literal_rows

AWKWARD = [
    "SELECT 1",
    "  a \t b\n\nc  ",
    "x '' y 'it''s (' z",
    r"SELECT 'it\'s' AS q",
    "-- line\nSELECT /* block ' */ \"Quoted \"\" id\" FROM `a.b`",
    "SELECT 'open",
    "/* open",
    'SELECT "open',
    "$$ body ' $$ SELECT 1",
    "é ü 名前 SELECT route_code",
    "1e10 a1 1a .5 t.1",
    "",
    "''" * 50_000,
    r"\'" * 20_000,
    "(" * 5_000,
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(AWKWARD)), "i int, s string")


@pytest.mark.parametrize("dialect", list(lexicon.DIALECTS))
def test_lossless_tokens(rows, dialect):
    tokens = F.regexp_extract_all("s", F.lit(lexicon.lossless_pattern(dialect)), F.lit(0))
    assert rows.where(F.array_join(tokens, "") != F.col("s")).count() == 0


def test_shape_masks_literals_numbers_and_comments(spark):
    cases = {
        "SELECT a1, 'x''y' FROM t -- c\nWHERE b > 1.5": "SELECT a1, '' '' FROM t WHERE b > 0",
        'SELECT "fiscal 2024" FROM t WHERE a = 5': 'SELECT "fiscal 2024" FROM t WHERE a = 5',
        'SELECT "k2" FROM t WHERE a = 5': 'SELECT "k2" FROM t WHERE a = 0',
        "SELECT 'open": "SELECT '",
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r[0]: r[1] for r in df.select("s", text.statement_shape(F.col("s"))).collect()}
    assert got == cases


def test_normalize_snippet_inline(rows):
    got = rows.select(
        "i", text.normalize_sql(F.col("s")), text.snippet(F.col("s")), text.safe_inline(F.col("s"), 10)
    ).collect()
    for i, normal, snippet, inline in got:
        s = AWKWARD[i]
        assert normal == " ".join(s.split()).lower()
        assert snippet == s.strip()[:200]
        assert inline == " ".join(s.split())[:10].replace("`", "")


def test_safe_file_id_cannot_escape_or_collide(spark):
    ids = ["a/b", "a_b", "../../etc/passwd", "..", "", "._x_.", "q" * 300]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r[0]: r[1] for r in df.select("id", text.safe_file_id(F.col("id"))).collect()}
    for raw, name in got.items():
        assert re.fullmatch(r"[A-Za-z0-9._-]{1,109}", name) and ".." not in name
        assert name.endswith("-" + hashlib.sha1(raw.encode()).hexdigest()[:8])
    assert len(set(got.values())) == len(ids)
    assert got["../../etc/passwd"].startswith("etc_passwd-") or got["../../etc/passwd"].startswith("query-")


def test_section_merge_is_idempotent_and_keeps_curated_text(spark):
    start, end = text.SECTION_START, text.SECTION_END
    cases = {
        "none": None,
        "plain": "Team runbook.\n",
        "old": f"Before.\n{start}\nold\n{end}\nAfter.",
        "forged": f"Before.\n{start}\nold {end} sneaky {end}",
        "open": f"Before.\n{start}\nold",
    }
    df = spark.createDataFrame(list(cases.items()), "k string, d string")
    section = F.lit(f"## T\n{end}\nbody\n")
    once = df.withColumn("m", text.merge_section(F.col("d"), section))
    twice = once.withColumn("m2", text.merge_section(F.col("m"), section))
    for row in twice.collect():
        assert row["m"].count(start) == 1 and row["m"].count(end) == 1
        assert row["m2"] == row["m"] and "old" not in row["m"] and "sneaky" not in row["m"]
        if row["d"]:
            assert row["m"].startswith("Team runbook." if row["k"] == "plain" else "Before.")


def test_urn_parts(spark):
    urn = "urn:li:dataset:(urn:li:dataPlatform:snowflake,a.b.Orders,PROD)"
    df = literal_rows(spark, "u string", [(urn,), ("plain",), ("a,b.c",)])
    got = df.select(text.urn_platform(F.col("u")), text.urn_name(F.col("u")), text.urn_env(F.col("u")),
                    text.subject_table(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [
        ("snowflake", "a.b.Orders", "PROD", "Orders"), (None, None, None, None), (None, None, None, "c")]


def test_cache_key_ignores_order_and_case_of_column(spark):
    def key(column, tables):
        made = F.array(*[
            F.struct(F.lit(t).alias("table"), F.array(*[F.lit(c) for c in cols]).alias("columns"))
            for t, cols in tables
        ])
        return text.cache_key(F.lit(" SELECT 1 "), F.lit(column), made)

    row = spark.range(1).select(
        key("A", [("t", ["x", "y"]), ("s", ["z"])]), key("a", [("s", ["z"]), ("t", ["y", "x"])]),
        key("b", [("s", ["z"]), ("t", ["y", "x"])]),
    ).first()
    assert row[0] == row[1] != row[2]


def test_unknown_bucket(spark):
    cases = [("parse", "unparseable"), ("star", "star"), ("unresolved_table", "unresolvable_qualifier"), ("ambiguous_bare", "unresolvable"),
             ("unexplained", "unexplained"), ("alias_shadowed", "other_unknown"), (None, "other_unknown")]
    df = spark.createDataFrame(cases, "k string, want string")
    assert df.where(text.unknown_bucket(F.col("k")) != F.col("want")).count() == 0


def test_masking_leaves_single_blanks_alone(spark):
    """Only white space that is more than one blank is replaced, with the result of replacing all of it."""
    texts = ["a b c", "a  b", "a \t b\x0bc\n", "\t\ta", " a", "a\r\nb  \fc ", "", "a\u00a0 b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    wide = F.lit(lexicon.WIDE_SPACE)
    got = rows.select(F.regexp_replace("t", wide, F.lit(" ")), F.regexp_replace("t", F.lit(text.WS), F.lit(" ")), F.regexp_count("t", wide)).collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    assert got[0][2] == 0
