"""Registered queries over the given tables, with the SQL each one is checked against.

The SQL side never runs the binder: verdicts, tables and rewrites in it come from
the hand labels of the templates, joined to the events.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from changeimpact.functions import lexicon, predicates, text
from changeimpact.operators import (
    adjudicate, bind, catalog, extract, findings, quality, ranking, repair, report,
)
from changeimpact.plans import fixtures as fx
from changeimpact.plans.rehearse import Rehearsal, rehearse, rehearse_from_catalog
from changeimpact.session import literal_rows, shared_folder
from changeimpact.sources import runs, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query under ``name`` with its check SQL."""

    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_runs: dict[tuple, Rehearsal] = {}


def rehearsal(spark: SparkSession, sf_dir: str) -> Rehearsal:
    """The event log's rehearsal. Its verdicts are written once per session and then
    read by every report on it, as a job would that keeps verdict and findings tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _runs:
        _runs[key] = fresh_rehearsal(spark, sf_dir)
    return _runs[key]


def fresh_rehearsal(spark: SparkSession, sf_dir: str) -> Rehearsal:
    return rehearse(fx.changes(spark), fx.query_log(spark, sf_dir), fx.schema_columns(spark))


# --- SQL building blocks -------------------------------------------------------------------


def _values(rows: list[tuple]) -> str:
    def written(v) -> str:
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(written(v) for v in row) + ")" for row in rows)


def _verdict_rows(no_subject: bool = False) -> list[tuple]:
    rows, kinds = [], {c[0]: c[2] for c in fx.CHANGES}
    for i, t in enumerate(fx.TEMPLATES):
        verdicts = dict(t.verdicts, **(fx.NO_SUBJECT.get(i, {}) if no_subject else {}))
        for change_id, verdict in verdicts.items():
            rename = kinds[change_id] == "rename"
            rows.append((i, change_id, *verdict, t.rewritten if rename else None, t.refusal))
    return rows


_FILL = (
    "replace(replace(replace({0}, '{{t}}', CAST(user_id AS VARCHAR)), '{{v}}', "
    "CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)), '{{e}}', CAST(event_id AS VARCHAR))"
)


def _base(no_subject: bool = False) -> str:
    templates = [
        (i, t.dataset, t.stratum, t.sql, t.gold or t.verdicts.get("c1", ("unaffected",))[0])
        for i, t in enumerate(fx.TEMPLATES)
    ]
    pairs = [(i, c[0]) for i, t in enumerate(fx.TEMPLATES) for c in fx.CHANGES if c[1] == t.dataset]
    schema = [(t, c) for t, cols in fx.SCHEMA.items() for c in cols.split()]
    tables = [(i, name) for name, ids in fx.TABLES.items() for i in ids]
    return f"""WITH tpl(tid, ds, stratum, tsql, gold) AS (VALUES {_values(templates)}),
changes(change_id, dataset, kind, col, new_column) AS (VALUES {_values(fx.CHANGES)}),
pairs(tid, change_id) AS (VALUES {_values(pairs)}),
known(table_name, column_name) AS (VALUES {_values(schema)}),
named(tid, table_name) AS (VALUES {_values(tables)}),
gold(tid, change_id, severity, evidence, unknown_kind, unknown_reason, trewritten, refusal)
  AS (VALUES {_values(_verdict_rows(no_subject))}),
log AS (SELECT 'q' || CAST(event_id AS VARCHAR) AS query_id, event_id, tid, ds, stratum, gold,
  {_FILL.format('tsql')} AS sql, user_id, value,
  CASE WHEN event_type <> 'error' THEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) END AS exec_count
  FROM events JOIN tpl ON tid = event_id % {fx.N}),
f AS (SELECT l.*, g.change_id, g.severity, g.evidence, g.unknown_kind, g.unknown_reason, c.col,
  {_FILL.format('trewritten')} AS rewritten, refusal, new_column,
  substr(regexp_replace(sql, '^[ \\t\\n]+|[ \\t\\n]+\\z', '', 'g'), 1, 200) AS sql_snippet,
  CASE severity WHEN 'hard' THEN 0 WHEN 'soft' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END AS tier,
  CASE WHEN severity = 'unaffected' THEN 'cleared' ELSE severity END AS label
  FROM log l JOIN gold g ON l.tid = g.tid JOIN changes c ON c.change_id = g.change_id),
n AS (SELECT p.change_id, count(*) AS n_queries FROM log l JOIN pairs p ON l.tid = p.tid GROUP BY 1),
cnt AS (SELECT change_id,
  count(*) FILTER (severity = 'hard') AS n_hard, count(*) FILTER (severity = 'soft') AS n_soft,
  count(*) FILTER (severity = 'unknown') AS n_unknown, count(*) FILTER (severity = 'unaffected') AS n_unaffected,
  count(*) FILTER (severity = 'unaffected') AS n_cleared, count(*) FILTER (evidence = 'PARSE') AS n_unparseable,
  count(*) AS n_listed FROM f GROUP BY 1)
"""


BASE = _base()
COLLAPSE = r"regexp_replace(regexp_replace({0}, '[ \t\n\r\f\x0b]+', ' ', 'g'), '^ | \z', '', 'g')"
STRIP = r"regexp_replace({0}, '^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+\z', '', 'g')"
COUNT_COLUMNS = "n_hard, n_soft, n_unknown, n_unaffected, n_cleared, n_unparseable"


# --- text scalars --------------------------------------------------------------------------


@register("normalize_text", f"""
SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, md5(lower({COLLAPSE.format('text')})) AS digest FROM documents
UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), md5(lower({COLLAPSE.format('html')})) FROM pages""")
def normalize_text(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    return documents.unionByName(pages).select("id", F.md5(text.normalize_sql(F.col("text"))).alias("digest"))


@register("dedupe_keep_first", f"""
SELECT doc_id, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY lang, lower({COLLAPSE.format('text')}) ORDER BY doc_id) = 1""")
def dedupe_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("sql"))
    return ranking.dedupe_statements(rows, "doc_id", ("lang",)).select("doc_id", "lang")


@register("snippet_safe_inline", f"""
SELECT doc_id, substr({STRIP.format('text')}, 1, 200) AS snippet,
  replace(substr({COLLAPSE.format("replace(text, 'a', '`')")}, 1, 120), '`', '') AS inline_text FROM documents""")
def snippet_safe_inline(spark, sf_dir):
    ticked = F.replace("text", F.lit("a"), F.lit("`"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.snippet(F.col("text")).alias("snippet"), text.safe_inline(ticked).alias("inline_text"))


@register("base_name_urn_parts", """
WITH u AS (SELECT s_suppkey, 'urn:li:dataset:(urn:li:dataPlatform:' || lower(n_name) || ',wh.' || s_name || ',PROD)' AS urn,
  s_name || '.Tbl' || CAST(s_suppkey AS VARCHAR) AS nm FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, 'tbl' || CAST(s_suppkey AS VARCHAR) AS base,
  regexp_extract(urn, 'dataPlatform:([^,]+),', 1) AS platform, split_part(urn, ',', 2) AS urn_table, 'PROD' AS env,
  split_part(split_part(urn, ',', 2), '.', 2) AS subject, nm || ' (`urn:li:corpuser:' || nm || '`)' AS owner,
  'a,k' || CAST(s_suppkey AS VARCHAR) AS fields FROM u""")
def base_name_urn_parts(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey").cast("string")
    urn = F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:"), F.lower("n_name"), F.lit(",wh."), "s_name", F.lit(",PROD)"))
    name = F.concat("s_name", F.lit(".Tbl"), key)
    fields = F.array(F.concat(F.lit("x.k"), key), F.lit("a"), F.concat(F.lit("k"), key))
    return rows.select(
        "s_suppkey", text.base_name(name).alias("base"), text.urn_platform(urn).alias("platform"),
        text.urn_name(urn).alias("urn_table"), text.urn_env(urn).alias("env"),
        text.subject_table(urn).alias("subject"),
        text.owner_label(F.concat(F.lit("urn:li:corpuser:"), name)).alias("owner"),
        F.array_join(text.bare_fields(fields), ",").alias("fields"))


@register("strip_templates", r"""
WITH t AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN text || '{{ a' || chr(10) || 'b }} x {% if y %}' || chr(27) || '[4mz'
  ELSE text END AS raw FROM conversations)
SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(raw, '(?s)\{\{.*?\}\}', ' __JINJA__ ', 'g'),
  '(?s)\{%.*?%\}', ' ', 'g'), '\x1b\[[0-9;]*m', '', 'g')) AS digest, turn % 2 = 0 AS had_templates FROM t""")
def strip_templates(spark, sf_dir):
    tail = "{{ a\nb }} x {% if y %}\x1b[4mz"
    rows = table(spark, sf_dir, "conversations").withColumn(
        "raw", F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(tail))).otherwise(F.col("text")))
    clean = text.strip_ansi(text.strip_templates(F.col("raw")))
    return rows.select("conv_id", "turn", F.md5(clean).alias("digest"), text.has_templates(F.col("raw")).alias("had_templates"))


@register("safe_file_id", r"""
WITH i AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '../' || c_name WHEN 1 THEN '._' || c_name || '..' || c_mktsegment
  WHEN 2 THEN repeat(c_name, 9) ELSE '..' END AS id FROM customer),
k AS (SELECT c_custkey, id, trim(regexp_replace(id, '[^A-Za-z0-9._-]', '_', 'g'), '._') AS kept FROM i)
SELECT c_custkey, CASE WHEN kept = '' OR contains(kept, '..') THEN 'query' ELSE substr(kept, 1, 100) END
  || '-' || substr(sha1(id), 1, 8) AS file_id FROM k""")
def safe_file_id(spark, sf_dir):
    kind = F.col("c_custkey") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit("../"), "c_name"))
        .when(kind == 1, F.concat(F.lit("._"), "c_name", F.lit(".."), "c_mktsegment"))
        .when(kind == 2, F.repeat("c_name", 9))
        .otherwise("..")
    )
    return table(spark, sf_dir, "customer").select("c_custkey", text.safe_file_id(raw).alias("file_id"))


@register("cache_key", """
SELECT c_custkey, sha256('{"column":"c_name","sql":"' || c_name || ' x","tables":[{"table":"a","columns":["' || c_mktsegment ||
  '","Z"]},{"table":"b","columns":["k"]}]}') AS cache_key FROM customer""")
def cache_key(spark, sf_dir):
    tables = F.array(
        F.struct(F.lit("b").alias("table"), F.array(F.lit("k")).alias("columns")),
        F.struct(F.lit("a").alias("table"), F.array(F.lit("Z"), F.col("c_mktsegment")).alias("columns")),
    )
    sql = F.concat(F.lit(" "), "c_name", F.lit(" x\n"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.cache_key(sql, F.lit("C_NAME"), tables).alias("cache_key"))


_START, _END = text.SECTION_START, text.SECTION_END
_OLD = f"""CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || '{_START} x {_END} y {_END}' || chr(10) || lang
  WHEN 2 THEN text || '{_START}' || lang ELSE '{_START} a {_END}' END"""


@register("managed_section_merge", f"""
WITH b AS (SELECT doc_id, {STRIP.format(f"regexp_replace(regexp_replace({_OLD}, '(?s){_START}.*{_END}', ''), '(?s){_START}.*', '')")} AS base,
  '{_START}' || chr(10) || '## ' || source || chr(10) || chr(10) || 'body ' || lang || chr(10) || chr(10)
  || '---' || chr(10) || '_Schema rehearsal (hard / soft / unknown / cleared). Tag: {text.FORECAST_TAG}._' || chr(10) || '{_END}' AS block
  FROM documents)
SELECT doc_id, md5(CASE WHEN base = '' THEN block ELSE base || chr(10) || chr(10) || block || chr(10) END) AS digest FROM b""")
def managed_section_merge(spark, sf_dir):
    kind = F.col("doc_id") % 4
    old = (
        F.when(kind == 0, F.col("text"))
        .when(kind == 1, F.concat("text", F.lit(f"\n{_START} x {_END} y {_END}\n"), "lang"))
        .when(kind == 2, F.concat("text", F.lit(_START), "lang"))
        .otherwise(f"{_START} a {_END}")
    )
    section = text.section_text(F.col("source"), F.concat(F.lit("body "), "lang", F.lit(f"{_END}\n")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.merge_section(old, section)).alias("digest"))


@register("mention_filters", r"""
SELECT doc_id, CASE WHEN contains(lower(text), 'est') THEN 'hard' ELSE 'unaffected' END AS substring_prediction,
  contains(lower(text), 'the') AND regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])est([^\p{L}\p{N}_]|\z)') AS mentions FROM documents""")
def mention_filters(spark, sf_dir):
    sql = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", predicates.substring_prediction(sql, F.lit("EST")).alias("substring_prediction"),
        predicates.mentions_table_and_column(sql, "The", "est").alias("mentions"))


# --- extraction and binding ----------------------------------------------------------------

_FINDING = "change_id, query_id, sql_snippet, severity, col AS column, evidence, exec_count, unknown_reason, unknown_kind"


@register("classify_log", BASE + f"SELECT {_FINDING} FROM f")
def classify_log(spark, sf_dir):
    return fresh_rehearsal(spark, sf_dir).findings.drop("agent_note")


@register("classify_log_no_subject", _base(True) + "SELECT change_id, query_id, severity, evidence, unknown_reason, unknown_kind FROM f")
def classify_log_no_subject(spark, sf_dir):
    run = rehearse(fx.changes(spark), fx.query_log(spark, sf_dir), None, use_subject=False)
    return run.findings.select("change_id", "query_id", "severity", "evidence", "unknown_reason", "unknown_kind")


@register("physical_tables", BASE + "SELECT query_id, table_name FROM log JOIN named ON log.tid = named.tid")
def physical_tables(spark, sf_dir):
    return extract.physical_tables(fx.query_log(spark, sf_dir))


_NOT_TABLES = "(" + ", ".join(f"'{w}'" for w in lexicon.RESERVED) + ")"
_NAMED = r"regexp_extract_all(sql, '(?i)\b(?:FROM|JOIN)\s+`?([\w\-]+(?:\.[\w\-]+)*)`?', 1)"


@register("regex_tables", BASE + f"""
, m AS (SELECT query_id, unnest({_NAMED}) AS name FROM log)
SELECT query_id, lower(split_part(name, '.', -1)) AS table_name FROM m WHERE upper(split_part(name, '.', -1)) NOT IN {_NOT_TABLES}""")
def regex_tables(spark, sf_dir):
    return extract.regex_tables(fx.query_log(spark, sf_dir))


@register("statement_with_text", BASE + "SELECT change_id, query_id, md5(sql) AS digest, false AS duplicate_id FROM f")
def statement_with_text(spark, sf_dir):
    run = rehearsal(spark, sf_dir)
    texts = bind.with_statement_text(run.stored_findings, run.log)
    return texts.select("change_id", "query_id", F.md5("sql").alias("digest"), "duplicate_id")


# --- counts, gates, order ------------------------------------------------------------------


@register("forecast_summary", BASE + f"""
SELECT n.change_id, n_queries, CAST(0 AS BIGINT) AS lineage_dependent_count, {COUNT_COLUMNS}, n_queries - n_listed AS no_reference_count
FROM n JOIN cnt ON n.change_id = cnt.change_id""")
def forecast_summary(spark, sf_dir):
    return rehearsal(spark, sf_dir).summary


@register("severity_counts", BASE + f"SELECT change_id, {COUNT_COLUMNS} FROM cnt")
def severity_counts(spark, sf_dir):
    return findings.severity_counts(rehearsal(spark, sf_dir).stored_findings)


def _gate_sql(levels: list[str]) -> str:
    n = " + ".join(f"n_{level}" for level in levels)
    unread = "false" if "unknown" in levels else "n_unparseable > 0"
    told = "CAST(n_unparseable AS VARCHAR) || ' statements could not be read and UNKNOWN is no threshold"
    return BASE + f"""
SELECT change_id, '{",".join(levels)}' AS fail_on, ({n}) = 0 AND NOT ({unread}) AS clean, {COUNT_COLUMNS}, {n} AS n_triggered,
  CAST(CASE WHEN ({n}) > 0 THEN 1 WHEN {unread} THEN 2 ELSE 0 END AS INTEGER) AS exit_code,
  CASE WHEN ({unread}) AND ({n}) = 0 THEN {told}; not clean' WHEN {unread} THEN {told}' END AS note FROM cnt"""


@register("gate", _gate_sql(["hard", "unknown"]))
def gate(spark, sf_dir):
    return rehearsal(spark, sf_dir).gate()


@register("gate_hard_only", _gate_sql(["hard"]))
def gate_hard_only(spark, sf_dir):
    return rehearsal(spark, sf_dir).gate("hard")


@register("gate_no_statements", """
SELECT 'p' || CAST(p_partkey AS VARCHAR) AS change_id, p_partkey % 40 >= 30 AND false AS clean,
  CAST(CASE WHEN p_partkey % 40 >= 30 THEN 2 ELSE 0 END AS INTEGER) AS exit_code FROM part WHERE p_partkey % 40 >= 30
UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), true, 0 FROM part WHERE p_partkey % 40 < 30""")
def gate_no_statements(spark, sf_dir):
    """One change per part; the last of forty datasets have no statements, and no finding makes them clean."""
    place = F.concat(F.lit("ds"), (F.col("p_partkey") % 40).cast("string"))
    changes = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("change_id"), place.alias("dataset"))
    log = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("ds"), (F.col("o_orderkey") % 30).cast("string")).alias("dataset"))
    none = literal_rows(spark, "change_id string, severity string, evidence string, unknown_kind string", [])
    gates = findings.gate(changes, none, totals=findings.statement_totals(log))
    return gates.select("change_id", "clean", "exit_code")


@register("gate_triggered", BASE + "SELECT change_id, query_id, severity, evidence FROM f WHERE severity IN ('hard', 'unknown')")
def gate_triggered(spark, sf_dir):
    return findings.gate_triggered(rehearsal(spark, sf_dir).stored_findings)


@register("worst_severity", BASE + "SELECT change_id, CASE min(tier) WHEN 0 THEN 'hard' WHEN 1 THEN 'soft' WHEN 2 THEN 'unknown' END AS worst_severity FROM f GROUP BY 1")
def worst_severity(spark, sf_dir):
    return rehearsal(spark, sf_dir).worst


_RANK = "SELECT change_id, query_id, severity, row_number() OVER (PARTITION BY change_id ORDER BY {0}) AS position FROM f"


@register("rank_findings", BASE + _RANK.format("tier, query_id"))
def rank_findings(spark, sf_dir):
    found = rehearsal(spark, sf_dir).stored_findings
    return ranking.with_position(found).select("change_id", "query_id", "severity", "position")


@register("rank_by_exec_count", BASE + _RANK.format("tier, exec_count DESC NULLS LAST, query_id"))
def rank_by_exec_count(spark, sf_dir):
    found = rehearsal(spark, sf_dir).stored_findings
    return ranking.with_position(found, True).select("change_id", "query_id", "severity", "position")


@register("verdict_distribution", BASE + """
, r AS (SELECT change_id, label, count(*) AS n FROM f GROUP BY 1, 2
  UNION ALL SELECT n.change_id, 'unaffected', n_queries - n_listed FROM n JOIN cnt ON n.change_id = cnt.change_id)
SELECT r.change_id, label, n, round(n / n_queries, 6) AS share FROM r JOIN n ON r.change_id = n.change_id WHERE n > 0""")
def verdict_distribution(spark, sf_dir):
    return findings.verdict_distribution(rehearsal(spark, sf_dir).summary)


@register("unknown_breakdown", BASE + """
SELECT change_id, CASE unknown_kind WHEN 'parse' THEN 'unparseable' WHEN 'star' THEN 'star' WHEN 'ambiguous_bare' THEN 'unresolvable'
  WHEN 'alias_shadowed' THEN 'other_unknown' WHEN 'unexplained' THEN 'unexplained' WHEN 'place' THEN 'place' ELSE 'unresolvable_qualifier' END AS bucket, count(*) AS n
FROM f WHERE severity = 'unknown' GROUP BY 1, 2""")
def unknown_breakdown(spark, sf_dir):
    return findings.unknown_breakdown(rehearsal(spark, sf_dir).verdicts)


@register("parse_rate", BASE + """
SELECT n.change_id, n_queries, n_unparseable, round((n_queries - n_unparseable) / n_queries, 6) AS parse_rate
FROM n JOIN cnt ON n.change_id = cnt.change_id""")
def parse_rate(spark, sf_dir):
    return findings.parse_rate(rehearsal(spark, sf_dir).summary)


@register("table_resolution_rate", BASE + f"""
, m AS (SELECT DISTINCT lower(split_part(unnest({_NAMED}), '.', -1)) AS t FROM log),
k AS (SELECT DISTINCT split_part(table_name, '.', -1) AS t FROM known)
SELECT count(k.t) AS n_with_schema, count(*) - count(k.t) AS n_without_schema, round(count(k.t) / count(*), 6) AS resolution_rate
FROM m LEFT JOIN k ON m.t = k.t WHERE upper(m.t) NOT IN {_NOT_TABLES}""")
def table_resolution_rate(spark, sf_dir):
    return findings.table_resolution_rate(fx.query_log(spark, sf_dir), fx.schema_columns(spark))


@register("alias_clears", BASE + """
SELECT change_id, count(*) AS n_cleared, count(*) FILTER (evidence = 'BOUND_ELSEWHERE:plates') AS n_bound_to_table
FROM f WHERE severity = 'unaffected' GROUP BY 1""")
def alias_clears(spark, sf_dir):
    return findings.alias_clears(rehearsal(spark, sf_dir).verdicts, "plates")


@register("first_examples", BASE + """
SELECT change_id, label, CAST(row_number() OVER w AS INTEGER) AS example_no, query_id, evidence FROM f
WINDOW w AS (PARTITION BY change_id, label ORDER BY query_id)
QUALIFY row_number() OVER w <= CASE label WHEN 'cleared' THEN 5 WHEN 'unknown' THEN 8 ELSE 1 END""")
def first_examples(spark, sf_dir):
    return findings.first_examples(rehearsal(spark, sf_dir).stored_findings)


@register("parse_failures", BASE + """
SELECT change_id, query_id, CAST(row_number() OVER w AS INTEGER) AS example_no, unknown_reason AS reason FROM f WHERE evidence = 'PARSE'
WINDOW w AS (PARTITION BY change_id ORDER BY query_id) QUALIFY row_number() OVER w <= 10""")
def parse_failures(spark, sf_dir):
    return findings.parse_failures(rehearsal(spark, sf_dir).stored_findings)


@register("defect_flags", BASE + """
, tied AS (SELECT c.change_id, query_id FROM log l JOIN changes c ON l.ds = c.dataset
  LEFT JOIN gold g ON g.tid = l.tid AND g.change_id = c.change_id
  WHERE g.tid IS NULL AND regexp_matches(substr(sql, 1, 200), '(?i)' || CASE ds WHEN '""" + fx.EXPOSURES + """' THEN 'exposures' ELSE 'mounts' END
    || '.*' || col || '|' || col || '.*' || CASE ds WHEN '""" + fx.EXPOSURES + """' THEN 'exposures' ELSE 'mounts' END)),
flags AS (SELECT change_id, query_id, 'possible miss (unaffected but snippet ties column to subject): `' || query_id || '`' AS flag FROM tied
  UNION ALL SELECT change_id, query_id, 'possible binder defect: CLEARED to non-loaded `services` in `' || query_id || '` (' || evidence || ')'
  FROM f WHERE evidence = 'BOUND_ELSEWHERE:services')
SELECT change_id, query_id, flag FROM flags WINDOW w AS (PARTITION BY change_id ORDER BY query_id) QUALIFY row_number() OVER w <= 8""")
def defect_flags(spark, sf_dir):
    run = rehearsal(spark, sf_dir)
    fewer = run.schema_columns.where(F.col("table_name") != "dome.services")
    return findings.defect_flags(run.changes, run.log, run.stored_findings, fewer)


# --- quality against gold ------------------------------------------------------------------


def _gold(spark, sf_dir):
    run = rehearsal(spark, sf_dir)
    return run, fx.gold_labels(spark, run.log), run.stored_findings


def _cache(requests: DataFrame) -> DataFrame:
    """A ruling cache for two thirds of the requests: one part binds to the subject, one elsewhere."""
    number = F.min(F.substring("query_id", 2, 20).cast("bigint")) % 3
    keyed = requests.groupBy("cache_key").agg(number.alias("part")).where(F.col("part") < 2)
    mine = F.col("part") == 0
    return keyed.select(
        "cache_key", F.when(mine, "hard").otherwise("soft").alias("severity"),
        F.when(mine, "night.Exposures").otherwise("night.plates").alias("binds_to"), F.lit("seen").alias("note"))


def _requests(run: Rehearsal) -> DataFrame:
    return adjudicate.ruling_requests(run.stored_findings, run.log, run.schema_columns)


def _rulings(run: Rehearsal) -> DataFrame:
    requests = _requests(run)
    return adjudicate.cached_rulings(requests, run.changes, _cache(requests))


def _runs_of(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    run, gold, found = _gold(spark, sf_dir)
    log = run.log.join(run.changes.select("change_id", "dataset", "column"), "dataset")
    binder = quality.predicted_labels(gold, found, "binder")
    heuristic = quality.predicted_labels(gold, adjudicate.adjudicate(found), "heuristic")
    ruled = quality.predicted_labels(gold, adjudicate.apply_rulings(found, _rulings(run)), "cached")
    predictions = (
        quality.everything_breaks(gold).unionByName(quality.substring_run(log, F.col("column")))
        .unionByName(binder).unionByName(heuristic).unionByName(ruled)
    )
    return gold, predictions, binder


_RULED = BASE + """
, c1 AS (SELECT c.change_id, l.query_id, l.stratum, CASE WHEN c.change_id = 'c1' THEN l.gold ELSE coalesce(g.severity, 'unaffected') END AS gold,
  l.sql, l.event_id, c.col, g.unknown_kind, g.evidence, coalesce(g.severity, 'unaffected') AS binder
  FROM log l JOIN changes c ON l.ds = c.dataset LEFT JOIN gold g ON l.tid = g.tid AND g.change_id = c.change_id),
part AS (SELECT change_id, sql, min(event_id) % 3 AS part FROM c1 WHERE unknown_kind = 'ambiguous_bare' GROUP BY 1, 2),
runs AS (SELECT 'everything' AS run, change_id, query_id, stratum, gold, 'hard' AS predicted FROM c1
  UNION ALL SELECT 'substring', change_id, query_id, stratum, gold, CASE WHEN contains(lower(sql), col) THEN 'hard' ELSE 'unaffected' END FROM c1
  UNION ALL SELECT 'binder', change_id, query_id, stratum, gold, binder FROM c1
  UNION ALL SELECT 'heuristic', change_id, query_id, stratum, gold, CASE WHEN binder <> 'unknown' OR evidence IN ('STAR', 'PARSE') THEN binder
    WHEN evidence = 'SELECT' THEN 'soft' ELSE 'hard' END FROM c1
  UNION ALL SELECT 'cached', c1.change_id, query_id, stratum, gold, CASE WHEN part = 0 AND c1.change_id <> 'c3' THEN 'hard' ELSE binder END
    FROM c1 LEFT JOIN part ON c1.change_id = part.change_id AND c1.sql = part.sql AND unknown_kind = 'ambiguous_bare'),
cls(class) AS (VALUES ('hard'), ('soft'), ('unknown'), ('unaffected'))
"""


@register("confusion_matrix", _RULED + """
SELECT r.change_id, r.run, a.class AS gold, b.class AS predicted, count(x.query_id) AS n FROM (SELECT DISTINCT change_id, run FROM runs) r CROSS JOIN cls a CROSS JOIN cls b
LEFT JOIN runs x ON x.change_id = r.change_id AND x.run = r.run AND x.gold = a.class AND x.predicted = b.class GROUP BY 1, 2, 3, 4""")
def confusion_matrix(spark, sf_dir):
    gold, predictions, _ = _runs_of(spark, sf_dir)
    return quality.confusion_matrix(quality.scored(gold, predictions))


@register("class_metrics", _RULED + """
SELECT change_id, run, class, round(count(*) FILTER (gold = class AND predicted = class) / nullif(count(*) FILTER (predicted = class), 0), 6) AS precision,
  round(count(*) FILTER (gold = class AND predicted = class) / nullif(count(*) FILTER (gold = class), 0), 6) AS recall
FROM runs CROSS JOIN cls GROUP BY 1, 2, 3""")
def class_metrics(spark, sf_dir):
    gold, predictions, _ = _runs_of(spark, sf_dir)
    return quality.class_metrics(quality.scored(gold, predictions))


_METRICS = """
SELECT change_id, run, count(*) AS n_cases, round(count(*) FILTER (gold = predicted) / count(*), 6) AS accuracy,
  round(count(*) FILTER (gold = 'hard' AND predicted = 'hard') / nullif(count(*) FILTER (predicted = 'hard'), 0), 6) AS hard_precision,
  round(count(*) FILTER (gold = 'hard' AND predicted = 'hard') / nullif(count(*) FILTER (gold = 'hard'), 0), 6) AS hard_recall,
  round(count(*) FILTER (predicted = 'unknown') / count(*), 6) AS unknown_rate,
  round(count(*) FILTER (stratum = 'decoy' AND predicted <> 'unaffected') / nullif(count(*) FILTER (stratum = 'decoy'), 0), 6) AS decoy_fp_rate
FROM runs GROUP BY 1, 2"""


@register("baseline_runs", _RULED + _METRICS)
def baseline_runs(spark, sf_dir):
    gold, predictions, _ = _runs_of(spark, sf_dir)
    return quality.run_metrics(quality.scored(gold, predictions))


_SHOWN = ["accuracy", "hard_precision", "hard_recall", "unknown_rate", "decoy_fp_rate"]
_CELLS = " || ' | ' || ".join(f"coalesce(CAST(CAST({name} AS DECIMAL(9, 6)) AS DECIMAL(9, 2))::VARCHAR, 'n/a')" for name in _SHOWN)


@register("metrics_text", _RULED + f"""
SELECT change_id, run, '| ' || run || ' | ' || {_CELLS} || ' |' AS line FROM ({_METRICS})""")
def metrics_text(spark, sf_dir):
    return quality.metrics_text(baseline_runs(spark, sf_dir))


@register("stratum_report", _RULED + "SELECT change_id, run, stratum, count(*) AS n, count(*) FILTER (gold = predicted) AS n_correct FROM runs GROUP BY 1, 2, 3")
def stratum_report(spark, sf_dir):
    gold, predictions, _ = _runs_of(spark, sf_dir)
    return quality.stratum_report(quality.scored(gold, predictions))


@register("misses", _RULED + "SELECT change_id, run, stratum, query_id, query_id || ':' || gold || '->' || predicted AS miss FROM runs WHERE gold <> predicted")
def misses(spark, sf_dir):
    gold, predictions, _ = _runs_of(spark, sf_dir)
    return quality.misses(quality.scored(gold, predictions))


@register("agreement", _RULED + "SELECT change_id, run, query_id, stratum, gold, predicted, gold = predicted AS agree FROM runs")
def agreement(spark, sf_dir):
    gold, predictions, _ = _runs_of(spark, sf_dir)
    return quality.agreement(quality.scored(gold, predictions))


@register("adjudicator_lift", _RULED + """
, ba AS (SELECT r.change_id, r.run, c1.gold, c1.binder, r.predicted FROM runs r JOIN c1 ON r.query_id = c1.query_id AND r.change_id = c1.change_id WHERE run IN ('heuristic', 'cached'))
SELECT change_id, run, count(*) FILTER (binder = 'unknown') AS base_unknowns, count(*) FILTER (binder = 'unknown' AND predicted <> 'unknown') AS bound,
  round(count(*) FILTER (binder = 'unknown' AND predicted <> 'unknown') / nullif(count(*) FILTER (binder = 'unknown'), 0), 6) AS bind_rate,
  round(count(*) FILTER (binder = 'unknown' AND predicted <> 'unknown' AND predicted = gold)
    / nullif(count(*) FILTER (binder = 'unknown' AND predicted <> 'unknown'), 0), 6) AS bind_accuracy FROM ba GROUP BY 1, 2""")
def adjudicator_lift(spark, sf_dir):
    gold, predictions, binder = _runs_of(spark, sf_dir)
    ruled = predictions.where(F.col("run").isin("heuristic", "cached"))
    return quality.adjudicator_lift(gold, binder, ruled)


@register("bound_cases", _RULED + """
SELECT r.change_id, r.run, r.query_id, r.predicted, c1.gold FROM runs r JOIN c1 ON r.query_id = c1.query_id AND r.change_id = c1.change_id
WHERE run IN ('heuristic', 'cached') AND binder = 'unknown' AND r.predicted <> 'unknown'""")
def bound_cases(spark, sf_dir):
    gold, predictions, binder = _runs_of(spark, sf_dir)
    return quality.bound_cases(gold, binder, predictions.where(F.col("run").isin("heuristic", "cached")))


@register("quality_labels", """
SELECT 'length' AS run, count(*) AS n_cases, round(count(*) FILTER ((quality = 1) = (n_chars >= 400)) / count(*), 6) AS accuracy
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def quality_labels(spark, sf_dir):
    name = lambda flag: F.when(flag, "hard").otherwise("unaffected")
    gold = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("query_id"), F.lit("text").alias("stratum"), name(F.col("quality") == 1).alias("gold"))
    predictions = table(spark, sf_dir, "documents").select(
        F.lit("length").alias("run"), F.col("doc_id").alias("query_id"), name(F.col("n_chars") >= 400).alias("predicted"))
    return quality.run_metrics(quality.scored(gold, predictions)).select("run", "n_cases", "accuracy")


# --- rulings -------------------------------------------------------------------------------

_HEURISTIC = """CASE WHEN evidence = 'SELECT' THEN 'bound `' || col || '` to subject schema (SELECT-only evidence); treat as SOFT pending human confirm'
  ELSE 'bound `' || col || '` to subject schema (fields include column; clause=' || evidence || '); treat as HARD pending human confirm' END"""


@register("heuristic_rulings", BASE + f"""
SELECT change_id, query_id, CASE WHEN change_id = 'c3' THEN 'unknown' WHEN evidence = 'SELECT' THEN 'soft' ELSE 'hard' END AS severity,
  CASE WHEN change_id = 'c3' THEN 'column `' || col || '` not in subject schema fields; cannot bind — leave UNKNOWN' ELSE {_HEURISTIC} END AS note
FROM f WHERE severity = 'unknown' AND (change_id = 'c3' OR evidence NOT IN ('STAR', 'PARSE'))""")
def heuristic_rulings(spark, sf_dir):
    fields = literal_rows(spark, "change_id string, field string",
                          [("c1", "Band"), ("c2", "airmass"), ("c3", "mount_id")])
    return adjudicate.heuristic_rulings(rehearsal(spark, sf_dir).stored_findings, fields)


@register("adjudicated_findings", BASE + f"""
, a AS (SELECT *, severity = 'unknown' AND evidence NOT IN ('STAR', 'PARSE') AS up FROM f)
SELECT change_id, query_id, CASE WHEN NOT up THEN severity WHEN evidence = 'SELECT' THEN 'soft' ELSE 'hard' END AS severity, evidence,
  CASE WHEN up THEN {_HEURISTIC} END AS agent_note, CASE WHEN NOT up THEN unknown_reason END AS unknown_reason, unknown_kind FROM a""")
def adjudicated_findings(spark, sf_dir):
    return adjudicate.adjudicate(rehearsal(spark, sf_dir).stored_findings).select(
        "change_id", "query_id", "severity", "evidence", "agent_note", "unknown_reason", "unknown_kind")


@register("residue", BASE + "SELECT change_id, query_id, evidence FROM f WHERE unknown_kind = 'ambiguous_bare'")
def residue(spark, sf_dir):
    return adjudicate.residue(rehearsal(spark, sf_dir).stored_findings).select("change_id", "query_id", "evidence")


@register("cached_rulings", BASE + """
, part AS (SELECT change_id, sql, min(event_id) % 3 AS part FROM f WHERE unknown_kind = 'ambiguous_bare' GROUP BY 1, 2)
SELECT f.change_id, query_id, CASE WHEN part = 0 AND f.change_id <> 'c3' THEN 'hard' ELSE 'unknown' END AS severity,
  CASE WHEN part = 2 THEN 'no cached ruling' WHEN part = 1
    THEN 'a ruling for night.plates, not the subject: seen (binds_to=night.plates)'
    WHEN f.change_id <> 'c3' THEN 'seen (binds_to=night.Exposures)'
    ELSE 'a ruling for night.Exposures, not the subject: seen (binds_to=night.Exposures)' END AS note
FROM f JOIN part ON f.change_id = part.change_id AND f.sql = part.sql WHERE unknown_kind = 'ambiguous_bare'""")
def cached_rulings(spark, sf_dir):
    return _rulings(rehearsal(spark, sf_dir))


@register("plugin_rulings", BASE + """
, a AS (SELECT *, severity = 'unknown' AND evidence <> 'STAR' AS asked, unknown_kind = 'ambiguous_bare' AS crowd FROM f)
SELECT change_id, query_id, evidence, unknown_kind, CASE WHEN asked AND crowd AND contains(evidence, 'WHERE') THEN 'hard' WHEN asked AND crowd THEN 'soft' ELSE severity END AS severity,
  CASE WHEN NOT (asked AND coalesce(crowd, false)) THEN unknown_reason END AS unknown_reason,
  CASE WHEN NOT asked THEN NULL WHEN crowd THEN 'asked about ' || col WHEN evidence = 'PARSE' THEN 'no ruling, the plug-in failed: ValueError: cannot be read'
    WHEN unknown_kind = 'unresolvable_qualifier' THEN 'no ruling, the plug-in failed: ValueError: not a ruling: (''perhaps'', None)' ELSE 'left open' END AS agent_note FROM a""")
def plugin_rulings(spark, sf_dir):
    """A Python plug-in asked once per UNKNOWN shape: it rules, leaves open, is silent, raises and answers nonsense."""

    def plugin(asked):
        if asked["evidence"] == "STAR":
            return None
        if asked["evidence"] == "PARSE":
            raise ValueError("cannot be read")
        if asked["unknown_kind"] == "unresolvable_qualifier":
            return "perhaps", None
        if asked["unknown_kind"] == "ambiguous_bare":
            return ("hard" if "WHERE" in asked["evidence"] else "soft"), "asked about " + asked["column"]
        return "unknown", "left open"

    run = rehearsal(spark, sf_dir)
    rulings = adjudicate.shape_rulings(adjudicate.shape_requests(run.shape_verdicts), plugin)
    found = bind.findings_of(run.statements, adjudicate.rule_shapes(run.shape_verdicts, rulings))
    return found.select("change_id", "query_id", "evidence", "unknown_kind", "severity", "unknown_reason", "agent_note")


# --- repairs -------------------------------------------------------------------------------

_REASON = """CASE WHEN new_column IS NULL THEN 'a dropped column has no new name to write'
  WHEN evidence = 'STAR' THEN 'a star over the subject names no column to rewrite'
  WHEN severity = 'unknown' THEN 'uncertain binding — ' || unknown_reason
  WHEN severity = 'unaffected' THEN 'bound elsewhere — ' || substr(evidence, 17)
  ELSE refusal END"""
_LINE = "split_part({0}, chr(10), {1}) || chr(10)"
_DIFF = f"""CASE WHEN rewritten IS NOT NULL THEN '--- a/' || query_id || '.sql' || chr(10) || '+++ b/' || query_id || '.sql' || chr(10) || CASE
  WHEN tid = {fx.LINES} THEN '@@ -1,4 +1,4 @@' || chr(10) || ' ' || {_LINE.format('sql', 1)} || '-' || {_LINE.format('sql', 2)}
    || '+' || {_LINE.format('rewritten', 2)} || ' ' || {_LINE.format('sql', 3)} || ' ' || {_LINE.format('sql', 4)}
  ELSE '@@ -1 +1 @@' || chr(10) || '-' || sql || chr(10) || '+' || rewritten || chr(10) END END"""


@register("repairs", BASE + f"""
SELECT change_id, query_id, CASE WHEN rewritten IS NULL THEN 'refuse' ELSE 'patch' END AS action, {_REASON} AS reason,
  CASE WHEN new_column IS NOT NULL THEN severity END AS severity, sql AS original_sql, rewritten AS rewritten_sql FROM f""")
def repairs(spark, sf_dir):
    return rehearsal(spark, sf_dir).repairs.drop("unified_diff")


@register("unified_diff", BASE + f"SELECT change_id, query_id, {_DIFF} AS unified_diff FROM f WHERE rewritten IS NOT NULL")
def unified_diff(spark, sf_dir):
    done = rehearsal(spark, sf_dir).repairs.where(F.col("action") == "patch")
    return done.select("change_id", "query_id", "unified_diff")


@register("patch_files", BASE + f"""
SELECT change_id, query_id, query_id || '-' || substr(sha1(query_id), 1, 8) AS file_name, {_DIFF} AS patch,
  CASE WHEN suffix(rewritten, chr(10)) THEN rewritten ELSE rewritten || chr(10) END AS rewritten_sql FROM f WHERE rewritten IS NOT NULL""")
def patch_files(spark, sf_dir):
    return sinks.patch_rows(rehearsal(spark, sf_dir).repairs)


@register("repair_refusals", BASE + f"""
SELECT change_id, substr(trim(split_part({_REASON}, '—', 1)), 1, 48) AS reason, count(*) AS n FROM f WHERE rewritten IS NULL GROUP BY 1, 2""")
def repair_refusals(spark, sf_dir):
    return repair.refusal_reasons(rehearsal(spark, sf_dir).decisions)


@register("repair_round_trip", BASE + "SELECT change_id, count(*) AS n_patched, count(*) AS n_passed FROM f WHERE rewritten IS NOT NULL GROUP BY 1")
def repair_round_trip(spark, sf_dir):
    run = rehearsal(spark, sf_dir)
    trips = repair.round_trip(run.decisions, run.changes, run.schema_columns, run.columns)
    return repair.round_trip_summary(trips)


# --- catalog -------------------------------------------------------------------------------

_SUPPLIER_URN = """'urn:li:dataset:(urn:li:dataPlatform:' || CASE s_suppkey % 3 WHEN 0 THEN 'snowflake' WHEN 1 THEN 'bigquery' ELSE 'dbt' END
  || ',wh.n' || CAST(s_nationkey AS VARCHAR) || '.t' || CAST(s_suppkey % 50 AS VARCHAR) || ',PROD)'"""


def supplier_datasets(spark, sf_dir) -> DataFrame:
    platform = F.when(F.col("s_suppkey") % 3 == 0, "snowflake").when(F.col("s_suppkey") % 3 == 1, "bigquery").otherwise("dbt")
    urn = F.concat(
        F.lit("urn:li:dataset:(urn:li:dataPlatform:"), platform, F.lit(",wh.n"), F.col("s_nationkey").cast("string"),
        F.lit(".t"), (F.col("s_suppkey") % 50).cast("string"), F.lit(",PROD)"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", urn.alias("urn"))


def customer_changes(spark, sf_dir) -> DataFrame:
    """One change per customer on its nation's subject table, asking for one sibling table."""
    nation = F.col("c_nationkey").cast("string")
    urn = F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:snowflake,wh.n"), nation, F.lit(".subject,PROD)"))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("change_id"), urn.alias("dataset"),
        F.concat(F.lit("T"), (F.col("c_custkey") % 60).cast("string")).alias("table_name"))


_BEST = f"""
WITH d AS (SELECT DISTINCT {_SUPPLIER_URN} AS urn, CASE s_suppkey % 3 WHEN 0 THEN 10 ELSE 0 END AS p,
  's' AS x, s_nationkey AS nk, 't' || CAST(s_suppkey % 50 AS VARCHAR) AS base FROM supplier),
w AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS change_id, c_nationkey, 't' || CAST(c_custkey % 60 AS VARCHAR) AS table_name FROM customer),
best AS (SELECT change_id, table_name, urn, CAST(p + 1 + CASE WHEN starts_with('n' || CAST(nk AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR)) THEN 5 ELSE 0 END AS INTEGER) AS score
  FROM w JOIN d ON base = table_name
  QUALIFY row_number() OVER (PARTITION BY change_id, table_name ORDER BY score DESC, urn) = 1)
"""


@register("best_dataset", _BEST + "SELECT change_id, table_name, urn, score FROM best")
def best_dataset(spark, sf_dir):
    return catalog.best_datasets(customer_changes(spark, sf_dir), supplier_datasets(spark, sf_dir).select("urn").distinct())


def supplier_fields(spark, sf_dir) -> DataFrame:
    """Fields per dataset; every fifth supplier has none."""
    rows = supplier_datasets(spark, sf_dir)
    paths = F.array(F.lit("rec.key"), F.concat(F.lit("rec.v"), (F.col("s_suppkey") % 4).cast("string")), F.lit("key"))
    return rows.select("urn", F.explode(F.when(F.col("s_suppkey") % 5 != 0, paths).otherwise(F.array(F.lit(None).cast("string")))).alias("field_path"))


def _siblings(spark, sf_dir):
    wanted = customer_changes(spark, sf_dir)
    subject_fields = wanted.select(F.col("dataset").alias("urn"), F.lit("rec.own").alias("field_path")).distinct()
    fields = supplier_fields(spark, sf_dir).unionByName(subject_fields)
    datasets = supplier_datasets(spark, sf_dir).select("urn").distinct()
    return catalog.sibling_schemas(
        wanted.select("change_id", "dataset"), wanted.select("change_id", "table_name"), datasets, fields)


_FIELDS = f"""
, fl AS (SELECT DISTINCT {_SUPPLIER_URN} AS urn, unnest(['key', 'v' || CAST(s_suppkey % 4 AS VARCHAR)]) AS column_name FROM supplier WHERE s_suppkey % 5 <> 0),
cols AS (SELECT change_id, table_name, column_name FROM best JOIN fl ON best.urn = fl.urn)
"""


@register("sibling_schemas", _BEST + _FIELDS + """
SELECT change_id, table_name, column_name FROM cols UNION ALL SELECT change_id, 'subject', 'own' FROM w""")
def sibling_schemas(spark, sf_dir):
    return _siblings(spark, sf_dir)[0]


@register("unresolved_tables", _BEST + _FIELDS + """
SELECT change_id, table_name FROM w WHERE (change_id, table_name) NOT IN (SELECT change_id, table_name FROM cols)""")
def unresolved_tables(spark, sf_dir):
    return _siblings(spark, sf_dir)[1]


def nation_changes(spark, sf_dir) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), key).alias("change_id"), F.concat(F.lit("nation:"), key).alias("dataset"), "n_nationkey")


def nation_edges(spark, sf_dir) -> DataFrame:
    """A nation's customers depend on it, and each nation lists itself."""
    customers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("upstream"),
        F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("downstream"))
    own = nation_changes(spark, sf_dir).select(F.col("dataset").alias("upstream"), F.col("dataset").alias("downstream"))
    return customers.unionByName(own)


def nation_owners(spark, sf_dir) -> DataFrame:
    """Customers have an owner or a null one; two nations in three have two owners."""
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("customer:"), key.cast("string")).alias("urn"),
        F.when(key % 5 != 0, F.concat(F.lit("urn:li:corpuser:u"), (key % 7).cast("string"))).alias("owner"))
    nations = nation_changes(spark, sf_dir).where(F.col("n_nationkey") % 3 != 0).select(
        F.col("dataset").alias("urn"), F.explode(F.array(F.lit("urn:li:corpuser:b"), F.lit("urn:li:corpgroup:a"))).alias("owner"))
    return customers.unionByName(nations)


def nation_worst(spark, sf_dir) -> DataFrame:
    kind = F.col("n_nationkey") % 4
    worst = F.when(kind == 0, "hard").when(kind == 1, "soft").when(kind == 2, "unknown")
    return nation_changes(spark, sf_dir).select("change_id", worst.alias("worst_severity"))


_TARGETS = """
WITH t AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS change_id, 'nation:' || CAST(n_nationkey AS VARCHAR) AS urn, 'subject' AS role,
    CASE WHEN n_nationkey % 3 <> 0 THEN ['urn:li:corpgroup:a', 'urn:li:corpuser:b'] ELSE [] END AS owners, n_nationkey AS nk FROM nation
  UNION ALL SELECT 'n' || CAST(c_nationkey AS VARCHAR), 'customer:' || CAST(c_custkey AS VARCHAR), 'downstream',
    CASE WHEN c_custkey % 5 <> 0 THEN ['urn:li:corpuser:u' || CAST(c_custkey % 7 AS VARCHAR)] ELSE [] END, c_nationkey FROM customer),
targets AS (SELECT change_id, urn, role, owners, CASE nk % 4 WHEN 0 THEN 'hard' WHEN 1 THEN 'soft' WHEN 2 THEN 'unknown' END AS worst_severity FROM t)
"""


@register("downstream", "SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS change_id, 'customer:' || CAST(c_custkey AS VARCHAR) AS downstream FROM customer")
def downstream(spark, sf_dir):
    return catalog.downstream(nation_changes(spark, sf_dir), nation_edges(spark, sf_dir))


@register("lineage_counts", "SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS change_id, count(*) AS lineage_dependent_count FROM customer GROUP BY 1")
def lineage_counts(spark, sf_dir):
    return catalog.lineage_counts(downstream(spark, sf_dir))


def _targets(spark, sf_dir) -> DataFrame:
    return catalog.notify_targets(
        nation_changes(spark, sf_dir), downstream(spark, sf_dir), nation_owners(spark, sf_dir), nation_worst(spark, sf_dir))


@register("notify_targets", _TARGETS + "SELECT change_id, urn, role, array_to_string(owners, ',') AS owners, worst_severity FROM targets")
def notify_targets(spark, sf_dir):
    return _targets(spark, sf_dir).withColumn("owners", F.array_join("owners", ","))


@register("owners_per_dataset", _TARGETS + "SELECT urn, array_to_string(owners, ',') AS owners FROM targets WHERE len(owners) > 0")
def owners_per_dataset(spark, sf_dir):
    return catalog.owners_of(nation_owners(spark, sf_dir)).withColumn("owners", F.array_join("owners", ","))


@register("notify_lines", _TARGETS + """
, o AS (SELECT *, len(owners) > 0 AS owned, max(CASE WHEN len(owners) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY change_id) = 1 AS has_owner,
    CASE role WHEN 'subject' THEN 0 ELSE 1 END AS place FROM targets),
c AS (SELECT DISTINCT change_id, has_owner, worst_severity FROM o)
SELECT change_id, 0 AS block, -1 AS place, '' AS urn, '- no owners recorded in the catalog — coordination list empty (record ownership to populate this section)' AS line FROM c WHERE NOT has_owner
UNION ALL SELECT change_id, 1, -1, '', upper(coalesce(worst_severity, 'unaffected')) || ' priority' FROM c WHERE has_owner
UNION ALL SELECT change_id, 1, place, urn, '- `' || urn || '` (' || role || ') → '
  || array_to_string([split_part(x, ':', -1) || ' (`' || x || '`)' FOR x IN owners], ', ') FROM o WHERE owned
UNION ALL SELECT change_id, CASE WHEN has_owner THEN 2 ELSE 0 END, place, urn, '- `' || urn || '` (' || role || ', worst=' || coalesce(worst_severity, 'n/a') || ')' FROM o WHERE NOT owned
UNION ALL SELECT DISTINCT change_id, 2, -1, '', 'no owners recorded' FROM o WHERE NOT owned AND has_owner
UNION ALL SELECT DISTINCT change_id, 2, -2, '', '' FROM o WHERE NOT owned AND has_owner""")
def notify_lines(spark, sf_dir):
    return report.notify_lines(_targets(spark, sf_dir))


@register("schema_after_change", """
SELECT DISTINCT 't' || CAST(s_nationkey AS VARCHAR) AS table_name, CASE WHEN s_suppkey % 4 = 1 THEN 'renamed' ELSE 'COL' || CAST(s_suppkey % 4 AS VARCHAR) END AS column_name FROM supplier""")
def schema_after_change(spark, sf_dir):
    schema = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("table_name"),
        F.concat(F.lit("COL"), (F.col("s_suppkey") % 4).cast("string")).alias("column_name")).distinct()
    return repair.schema_after(schema, "col1", "renamed")


@register("pull_log", """
SELECT 'ds' || CAST(o_custkey % 1000 AS VARCHAR) AS dataset, CASE WHEN o_orderkey % 3 <> 0 THEN 'name' || CAST(o_orderkey AS VARCHAR)
  WHEN o_orderkey % 2 = 0 THEN 'urn' || CAST(o_orderkey AS VARCHAR) ELSE 'query' END AS query_id, o_orderpriority AS sql FROM orders WHERE o_orderstatus <> 'F'""")
def pull_log(spark, sf_dir):
    return catalog.pull_log(_raw_log(spark, sf_dir)).select("dataset", "query_id", "sql")


def _raw_log(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("ds"), (F.col("o_custkey") % 1000).cast("string")).alias("dataset"),
        F.when(key % 3 != 0, F.concat(F.lit("name"), key.cast("string"))).otherwise("").alias("name"),
        F.when(key % 2 == 0, F.concat(F.lit("urn"), key.cast("string"))).alias("urn"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).otherwise("").alias("sql"))


@register("source_preference", """
WITH l AS (SELECT 'ds' || CAST(o_custkey % 1000 AS VARCHAR) AS dataset, 'log' AS source FROM orders WHERE o_orderstatus <> 'F')
SELECT dataset, source, count(*) AS n FROM (SELECT * FROM l
  UNION ALL SELECT 'ds' || CAST(c_custkey % 2000 AS VARCHAR), 'seed' FROM customer
    WHERE 'ds' || CAST(c_custkey % 2000 AS VARCHAR) NOT IN (SELECT dataset FROM l)) GROUP BY 1, 2""")
def source_preference(spark, sf_dir):
    seed = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("ds"), (F.col("c_custkey") % 2000).cast("string")).alias("dataset"),
        F.lit("seed").alias("query_id"), F.col("c_name").alias("sql"), F.lit("seed").alias("source"))
    log = catalog.pull_log(_raw_log(spark, sf_dir)).withColumn("source", F.lit("log"))
    return catalog.prefer_log(log, seed).groupBy("dataset", "source").agg(F.count(F.lit(1)).alias("n"))


@register("invalid_changes", """
WITH c AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS change_id, 'ds' || CAST(p_partkey % 30 AS VARCHAR) AS dataset,
    CASE p_size % 4 WHEN 0 THEN 'modify' WHEN 1 THEN 'drop' ELSE 'rename' END AS kind, 'Col' || CAST(p_partkey % 7 AS VARCHAR) AS col,
    CASE WHEN p_size % 4 = 2 THEN 'x' END AS new_column FROM part),
f AS (SELECT DISTINCT 'ds' || CAST(s_suppkey % 20 AS VARCHAR) AS dataset, 'col' || CAST(s_suppkey % 5 AS VARCHAR) AS col FROM supplier),
q AS (SELECT DISTINCT 'ds' || CAST(o_orderkey % 10 AS VARCHAR) AS dataset FROM orders),
r AS (SELECT change_id, CASE WHEN kind = 'modify' THEN 'change_kind must be ''rename'' or ''drop''' WHEN kind = 'rename' AND new_column IS NULL THEN 'new_name required for rename'
  WHEN dataset NOT IN (SELECT dataset FROM f) THEN 'no schema fields for ' || dataset
  WHEN (dataset, lower(col)) NOT IN (SELECT dataset, col FROM f) THEN 'column `' || col || '` not in schema for ' || dataset
  WHEN dataset NOT IN (SELECT dataset FROM q) THEN 'no queries for ' || dataset END AS reason FROM c)
SELECT change_id, reason FROM r WHERE reason IS NOT NULL""")
def invalid_changes(spark, sf_dir):
    ds = lambda key, n: F.concat(F.lit("ds"), (F.col(key) % n).cast("string")).alias("dataset")
    kind = F.col("p_size") % 4
    changes = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("change_id"), ds("p_partkey", 30),
        F.when(kind == 0, "modify").when(kind == 1, "drop").otherwise("rename").alias("kind"),
        F.concat(F.lit("Col"), (F.col("p_partkey") % 7).cast("string")).alias("column"),
        F.when(kind == 2, "x").alias("new_column"))
    fields = table(spark, sf_dir, "supplier").select(
        ds("s_suppkey", 20).alias("urn"), F.concat(F.lit("rec.COL"), (F.col("s_suppkey") % 5).cast("string")).alias("field_path"))
    log = table(spark, sf_dir, "orders").select(ds("o_orderkey", 10))
    return catalog.invalid_changes(changes, fields, log)


@register("description_upsert", f"""
WITH d AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS urn, CASE WHEN doc_id % 3 = 0 AND text <> '' THEN text WHEN doc_id % 3 = 1 THEN source ELSE '' END AS cur FROM documents),
s AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS urn, '{_START}' || chr(10) || '## T' || chr(10) || chr(10) || 'q' || CAST(quality AS VARCHAR) || chr(10) || chr(10)
  || '---' || chr(10) || '_Schema rehearsal (hard / soft / unknown / cleared). Tag: {text.FORECAST_TAG}._' || chr(10) || '{_END}' AS block FROM labels)
SELECT d.urn, md5(CASE WHEN block IS NULL THEN cur WHEN {STRIP.format('cur')} = '' THEN block
  ELSE {STRIP.format('cur')} || chr(10) || chr(10) || block || chr(10) END) AS digest FROM d LEFT JOIN s ON d.urn = s.urn""")
def description_upsert(spark, sf_dir):
    urn = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("urn")
    kind = F.col("doc_id") % 3
    current = table(spark, sf_dir, "documents").select(
        urn, F.when(kind == 0, F.col("text")).otherwise("").alias("editable"),
        F.when(kind == 1, F.col("source")).alias("properties"))
    sections = table(spark, sf_dir, "labels").select(
        urn, F.lit("T").alias("title"), F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("\n")).alias("body"))
    return catalog.upsert_descriptions(current, sections).select("urn", F.md5("description").alias("digest"))


@register("tag_upsert", f"""
SELECT DISTINCT 'd' || CAST(doc_id AS VARCHAR) AS urn, '{text.FORECAST_TAG}' AS tag FROM labels
UNION SELECT 'd' || CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 2 = 0 THEN '{text.FORECAST_TAG}' ELSE lang END FROM documents""")
def tag_upsert(spark, sf_dir):
    urn = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("urn")
    tags = table(spark, sf_dir, "documents").select(
        urn, F.when(F.col("doc_id") % 2 == 0, text.FORECAST_TAG).otherwise(F.col("lang")).alias("tag"))
    return catalog.upsert_tags(tags, table(spark, sf_dir, "labels").select(urn))


_catalog_runs: dict[tuple, tuple] = {}


def _catalog_run(spark, sf_dir):
    """The event log rehearsed from catalog tables, with one dataset per schema table and two for plates."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _catalog_runs:
        _catalog_runs[key] = _fresh_catalog_run(spark, sf_dir)
    return _catalog_runs[key]


def _fresh_catalog_run(spark, sf_dir):
    urn = "urn:li:dataset:(urn:li:dataPlatform:{0},obs.{1},PROD)"
    rows = [(urn.format("snowflake", t), f"rec.{c}") for t, cols in fx.SCHEMA.items() for c in cols.split()]
    rows.append((urn.format("dbt", "x.plates"), "other"))
    fields = literal_rows(spark, "urn string, field_path string", rows)
    edges = literal_rows(spark, "upstream string, downstream string",
                         [(fx.EXPOSURES, fx.EXPOSURES), (fx.EXPOSURES, "down:1"), (fx.EXPOSURES, "down:2"), (fx.MOUNTS, "down:1")])
    changes = fx.changes(spark).unionByName(
        literal_rows(spark, fx.CHANGES_SCHEMA, [("x1", fx.EXPOSURES, "modify", "band", None), ("x2", fx.MOUNTS, "rename", "nope", "n")]))
    given = literal_rows(spark, "change_id string, lineage_dependent_count bigint", [("c2", 7)])
    return rehearse_from_catalog(
        changes, fx.query_log(spark, sf_dir), fields.select("urn").distinct(), fields, edges, baseline=given)


@register("catalog_rehearsal", BASE + """
, firsts AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY ds, change_id, lower(regexp_replace(trim(sql, chr(10)), '[ \\n]+', ' ', 'g')) ORDER BY event_id) = 1)
SELECT change_id, query_id, severity, evidence, unknown_reason FROM firsts""")
def catalog_rehearsal(spark, sf_dir):
    run, _, _ = _catalog_run(spark, sf_dir)
    return run.findings.select("change_id", "query_id", "severity", "evidence", "unknown_reason")


@register("catalog_baseline", BASE + """
SELECT change_id, 'rejected' AS kind, reason AS told FROM (VALUES ('x1', 'change_kind must be ''rename'' or ''drop'''),
  ('x2', 'column `nope` not in schema for ' || (SELECT dataset FROM changes WHERE change_id = 'c3'))) r(change_id, reason)
UNION ALL SELECT change_id, 'baseline', 'Impact Analysis baseline: ' || CASE change_id WHEN 'c2' THEN '7 downstream dependents (baseline: user-supplied)'
  WHEN 'c1' THEN '2 downstream dependents' ELSE '1 downstream dependents' END FROM changes""")
def catalog_baseline(spark, sf_dir):
    """Changes the catalog refuses, and the baseline of the others: given by the user for one, counted for the rest."""
    run, rejected, _ = _catalog_run(spark, sf_dir)
    told = run.report().where((F.col("section") == 0) & (F.col("part") == 2))
    return rejected.select("change_id", F.lit("rejected").alias("kind"), F.col("reason").alias("told")).unionByName(
        told.select("change_id", F.lit("baseline").alias("kind"), F.col("line").alias("told")))


# --- reports -------------------------------------------------------------------------------

_INLINE = r"replace(substr(regexp_replace(regexp_replace({0}, '[ \n]+', ' ', 'g'), '^ | \z', '', 'g'), 1, {1}), '`', '')"


@register("report_lines", BASE + f"""
, s AS (SELECT c.*, n_hard, n_soft, n_unknown, n_cleared, n_queries - n_listed AS none FROM changes c JOIN n ON n.change_id = c.change_id JOIN cnt ON cnt.change_id = c.change_id),
h(section, label) AS (VALUES (1, 'HARD'), (2, 'SOFT'), (3, 'UNKNOWN / needs human'), (4, '{report.CLEARED_HEADING}')),
hc AS (SELECT change_id, section, label, CASE section WHEN 1 THEN n_hard WHEN 2 THEN n_soft WHEN 3 THEN n_unknown ELSE n_cleared END AS n FROM s CROSS JOIN h)
SELECT change_id, 0 AS section, 0 AS part, '' AS query_id, 'Schema rehearsal: ' || CASE kind WHEN 'rename' THEN col || ' → rename to ' || new_column ELSE 'drop ' || col END AS line FROM s
UNION ALL SELECT change_id, 0, 1, '', '' FROM s UNION ALL SELECT change_id, 0, 3, '', '' FROM s
UNION ALL SELECT change_id, 0, 2, '', 'Impact Analysis baseline: 0 downstream dependents (baseline: user-supplied)' FROM s
UNION ALL SELECT change_id, section, 0, '', label || ' (' || CAST(n AS VARCHAR) || ')' FROM hc
UNION ALL SELECT change_id, section, 1, '', '- (none)' FROM hc WHERE n = 0 UNION ALL SELECT change_id, section, 2, '', '' FROM hc
UNION ALL SELECT change_id, tier + 1, 1, query_id, CASE WHEN tier = 3 THEN '- ' || query_id || ' — binds to `' || substr(evidence, 17) || '` — `' || {_INLINE.format('sql_snippet', 120)} || '`'
  || CASE WHEN exec_count IS NOT NULL THEN '  (exec×' || CAST(exec_count AS VARCHAR) || ')' ELSE '' END
  ELSE '- ' || query_id || ' — [' || evidence || '] `' || {_INLINE.format('sql_snippet', 120)} || '`'
  || CASE WHEN exec_count IS NOT NULL THEN '  (exec×' || CAST(exec_count AS VARCHAR) || ')' ELSE '' END
  || CASE WHEN unknown_reason IS NOT NULL THEN ' — ' || {_INLINE.format('unknown_reason', 200)} ELSE '' END END FROM f
UNION ALL SELECT change_id, 6, 0, '', 'No query evidence of `' || col || '` on subject: ' || CAST(none AS VARCHAR) FROM s""")
def report_lines(spark, sf_dir):
    lines = rehearsal(spark, sf_dir).report(use_exec_count=True, user_supplied_baseline=True)
    return lines.select("change_id", "section", "part", "query_id", "line")


@register("write_payload", BASE + f"""
, s AS (SELECT c.*, 'HARD=' || CAST(n_hard AS VARCHAR) || ' SOFT=' || CAST(n_soft AS VARCHAR) || ' UNKNOWN=' || CAST(n_unknown AS VARCHAR)
  || ' CLEARED=' || CAST(n_cleared AS VARCHAR) AS told, 'Schema rehearsal: ' || CASE WHEN new_column IS NOT NULL THEN 'rename ' || col || ' → ' || new_column ELSE 'drop ' || col END AS title
  FROM changes c JOIN cnt ON cnt.change_id = c.change_id),
b AS (SELECT *, '{_START}' || chr(10) || '## ' || title || chr(10) || chr(10) || told || chr(10) || chr(10)
  || 'Impact Analysis baseline: 0 downstream.' || chr(10) || '{_END}' AS block FROM s)
SELECT change_id, dataset AS entity_urn, title, title || '. ' || told || '. Impact Analysis baseline: 0 downstream. Column: `' || col || '`.' AS assertion_description,
  'FAILURE' AS report_result, CAST(NULL AS VARCHAR) AS external_url, '{text.FORECAST_TAG}' AS tag,
  CASE WHEN dataset = '{fx.EXPOSURES}' THEN 'Curated.' || chr(10) || chr(10) || block || chr(10) ELSE block END AS description_markdown FROM b""")
def write_payload(spark, sf_dir):
    run = rehearsal(spark, sf_dir)
    curated = literal_rows(spark, "urn string, description string", [(fx.EXPOSURES, "Curated.")])
    return report.write_payload(run.changes, run.summary, curated)


@register("finding_projection", BASE + """
SELECT change_id, query_id, severity, evidence, sql_snippet, unknown_reason, unknown_kind, severity = 'unaffected' AS cleared FROM f""")
def finding_projection(spark, sf_dir):
    return report.project_findings(rehearsal(spark, sf_dir).stored_findings).drop("agent_note")


@register("explain_findings", BASE + """
, asked AS (SELECT query_id, change_id FROM log JOIN changes ON ds = dataset)
SELECT a.change_id, a.query_id, severity, evidence, sql_snippet, unknown_reason, unknown_kind, CASE WHEN severity IS NOT NULL THEN severity = 'unaffected' END AS cleared,
  CASE WHEN severity IS NULL THEN 'query_id not in latest rehearsal findings (may be NO_REFERENCE / no query evidence)' END AS note
FROM asked a LEFT JOIN f ON a.query_id = f.query_id AND a.change_id = f.change_id""")
def explain_findings(spark, sf_dir):
    run = rehearsal(spark, sf_dir)
    asked = run.log.join(run.changes.select("change_id", "dataset"), "dataset").select("query_id", "change_id")
    return report.explain_findings(asked, run.stored_findings).drop("agent_note")



@register("run_record", BASE + """
, h AS (SELECT change_id, n_listed, 13 + (n_hard = 0)::INT + (n_soft = 0)::INT + (n_unknown = 0)::INT + (n_cleared = 0)::INT AS n_fixed FROM cnt)
SELECT change_id, table_name, CAST(CASE table_name WHEN 'findings' THEN n_listed WHEN 'repairs' THEN n_listed WHEN 'report' THEN n_listed + n_fixed ELSE 1 END AS BIGINT) AS n_rows
FROM h CROSS JOIN (VALUES ('changes'), ('summary'), ('gate'), ('findings'), ('repairs'), ('report')) t(table_name)""")
def run_record(spark, sf_dir):
    """The whole run written under one id with its manifest last, and each of its tables read back."""
    run, run_id = rehearsal(spark, sf_dir), f"r{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/runs"
    tables = run.tables()
    runs.write_run(tables, path, run_id)
    back = [
        runs.read_table(spark, path, name, run_id).groupBy("change_id").agg(F.count(F.lit(1)).alias("n_rows"))
        .select("change_id", F.lit(name).alias("table_name"), "n_rows") for name in tables
    ]
    read = back[0]
    for table_rows in back[1:]:
        read = read.unionByName(table_rows)
    return read
