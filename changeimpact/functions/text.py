"""Text scalars: pure Column expressions, no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from changeimpact.functions import lexicon

# The blanks that separate words, and the managed-section markers.
WS = r"[ \t\n\r\f\x0b]+"
SECTION_START = "<!-- changeimpact:forecast -->"
SECTION_END = "<!-- /changeimpact:forecast -->"
FORECAST_TAG = "changeimpact_forecast"
CLEARED_PREFIX = "BOUND_ELSEWHERE:"
URN_PATTERN = r"^urn:li:dataset:\(urn:li:dataPlatform:([^,]+),([^,]+),([^)]+)\)"


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def base_name(name: Column) -> Column:
    """Lower-cased last dotted part; null gives ''."""
    return last_part(F.lower(F.coalesce(name, F.lit(""))))


def unquoted_base_name(name: Column) -> Column:
    return base_name(F.translate(name, '`"', ""))


def collapse(text: Column) -> Column:
    """Runs of blanks to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, WS, " "), r"^ | \z", "")


def normalize_sql(sql: Column) -> Column:
    return F.lower(collapse(sql))


def strip_blanks(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}|{WS}\z", "")


def strip_end(text: Column) -> Column:
    return F.regexp_replace(text, rf"{WS}\z", "")


def snippet(sql: Column, limit: int = 200) -> Column:
    return F.substring(strip_blanks(sql), 1, limit)


def safe_inline(text: Column, limit: int = 120) -> Column:
    """One line of at most ``limit`` characters; backticks go after the cut."""
    return F.translate(F.substring(collapse(text), 1, limit), "`", "")


def urn_platform(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, URN_PATTERN, 1), F.lit(""))


def urn_name(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, URN_PATTERN, 2), F.lit(""))


def urn_env(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, URN_PATTERN, 3), F.lit(""))


def subject_table(urn: Column) -> Column:
    """Last dotted part of the text between the first and the last comma of a URN.

    With a single comma the text runs to the end. No comma or no text: null.
    """
    tail = F.regexp_replace(urn, "^[^,]*,", "")
    middle = strip_blanks(F.regexp_replace(tail, ",[^,]*$", ""))
    return F.when(F.contains(urn, F.lit(",")), F.nullif(last_part(middle), F.lit("")))


def bare_fields(fields: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(fields, last_part)))


def owner_label(urn: Column) -> Column:
    return F.concat(F.substring_index(urn, ":", -1), F.lit(" (`"), urn, F.lit("`)"))


def is_cleared(evidence: Column) -> Column:
    return F.startswith(evidence, F.lit(CLEARED_PREFIX))


def cleared_tables(evidence: Column) -> Column:
    rest = F.substring(evidence, len(CLEARED_PREFIX) + 1, 2147483647)
    return F.when(is_cleared(evidence), F.nullif(rest, F.lit("")))


def strip_templates(sql: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(sql, r"(?s)\{\{.*?\}\}", " __JINJA__ "), r"(?s)\{%.*?%\}", " "
    )


def has_templates(sql: Column) -> Column:
    return F.contains(sql, F.lit("{{")) | F.contains(sql, F.lit("{%"))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1b\[[0-9;]*m", "")


def safe_file_id(query_id: Column) -> Column:
    """A file name that cannot leave its folder and cannot collide."""
    kept = F.btrim(F.regexp_replace(query_id, "[^A-Za-z0-9._-]", "_"), F.lit("._"))
    unsafe = (kept == "") | F.contains(kept, F.lit(".."))
    stem = F.when(unsafe, F.lit("query")).otherwise(F.substring(kept, 1, 100))
    return F.concat(stem, F.lit("-"), F.substring(F.sha1(query_id), 1, 8))


def cache_key(sql: Column, column: Column, tables: Column) -> Column:
    """Digest of a ruling request; ``tables`` is array<struct<table,columns>>."""
    ordered = F.array_sort(
        F.transform(
            tables,
            lambda t: F.struct(
                t["table"].alias("table"), F.array_sort(t["columns"]).alias("columns")
            ),
        )
    )
    request = F.struct(
        F.lower(column).alias("column"), strip_blanks(sql).alias("sql"), ordered.alias("tables")
    )
    return F.sha2(F.to_json(request), 256)


#: Coarse cause of each kind of UNKNOWN.
BUCKETS = {
    "parse": "unparseable", "star": "star", "ambiguous_bare": "unresolvable", "unbound": "unresolvable",
    "unresolvable_qualifier": "unresolvable_qualifier", "unresolved_table": "unresolvable_qualifier",
    "unexplained": "unexplained", "place": "place",
}


def unknown_bucket(kind: Column) -> Column:
    """Coarse cause of an UNKNOWN by its kind; kinds without a bucket are other_unknown."""
    named = F.create_map(*[F.lit(x) for pair in BUCKETS.items() for x in pair])
    return F.coalesce(F.element_at(named, F.coalesce(kind, F.lit(""))), F.lit("other_unknown"))


def report_change_text(kind: Column, column: Column, new_column: Column) -> Column:
    return F.when(
        kind == "rename", F.concat(column, F.lit(" → rename to "), new_column)
    ).otherwise(F.concat(F.lit("drop "), column))


def payload_change_text(kind: Column, column: Column, new_column: Column) -> Column:
    named = (kind == "rename") & (F.coalesce(new_column, F.lit("")) != "")
    return F.when(
        named, F.concat(F.lit("rename "), column, F.lit(" → "), new_column)
    ).otherwise(F.concat(F.lit("drop "), column))


def baseline_text(count: Column, user_supplied: Column) -> Column:
    text = F.concat(
        F.lit("Impact Analysis baseline: "), count.cast("string"), F.lit(" downstream dependents")
    )
    mark = F.lit(" (baseline: user-supplied)")
    return F.when(user_supplied, F.concat(text, mark)).otherwise(text)


def neutralize_markers(text: Column) -> Column:
    return F.replace(
        F.replace(text, F.lit(SECTION_START), F.lit("")), F.lit(SECTION_END), F.lit("")
    )


def strip_section(text: Column) -> Column:
    """Drop the managed block: first start marker to last end marker, else to the end."""
    closed = F.regexp_replace(text, f"(?s){SECTION_START}.*{SECTION_END}", "")
    return strip_blanks(F.regexp_replace(closed, rf"(?s){SECTION_START}.*\z", ""))


def merge_section(existing: Column, section: Column) -> Column:
    """Keep the curated text, replace only the managed block."""
    base = strip_section(F.coalesce(existing, F.lit("")))
    body = strip_end(neutralize_markers(section))
    block = F.concat(F.lit(SECTION_START + "\n"), body, F.lit("\n" + SECTION_END))
    return F.when(base == "", block).otherwise(
        F.concat(base, F.lit("\n\n"), block, F.lit("\n"))
    )


def section_text(title: Column, body: Column) -> Column:
    footer = (
        "---\n_Schema rehearsal (hard / soft / unknown / cleared). "
        f"Tag: {FORECAST_TAG}._"
    )
    return F.concat(F.lit("## "), title, F.lit("\n\n"), strip_end(body), F.lit("\n\n" + footer))


def statement_shape(sql: Column, dialect: str = "snowflake") -> Column:
    """The statement with literals, numbers and comments masked.

    Statements that differ only there have the same verdict, so extraction runs
    once per shape. Numbers stay when a quoted name has one that would be hit, and
    where they name an item of the select list (``GROUP BY 2``).
    """
    pattern, replacement = lexicon.mask_pattern(dialect)

    def numbers_masked(masked: Column) -> Column:
        quoted = F.regexp_extract_all(masked, F.lit(r'"[^"]*+"?+|`[^`]*+`?+'), F.lit(0))
        protected = F.rlike(masked, F.lit('["`]')) & F.exists(
            quoted, lambda name: F.rlike(name, F.lit(lexicon.LOOSE_NUMBER))
        )
        return F.when(protected, masked).otherwise(
            F.regexp_replace(masked, lexicon.MASKED_NUMBER, "0")
        )

    # The edges are blanks by now, so a plain trim ends the job.
    single = F.btrim(F.regexp_replace(F.regexp_replace(sql, pattern, replacement), lexicon.WIDE_SPACE, " "), F.lit(" "))
    return let(single, numbers_masked)


def shape_tokens(shape: Column) -> Column:
    return F.regexp_extract_all(shape, F.lit(lexicon.SHAPE_TOKEN), F.lit(0))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rename_pieces(sql: Column, piece_numbers: Column, new_name: Column, dialect: str) -> Column:
    """Replace the name pieces with the given 1-based numbers; keep every other byte."""
    piece = F.lit(r'^[\p{L}_"`]')

    def hits(tokens: Column) -> Column:
        places = F.transform(tokens, lambda t, i: F.when(F.rlike(t, piece), i))
        return let(
            F.filter(places, lambda i: i.isNotNull()),
            lambda named: F.transform(piece_numbers, lambda n: F.get(named, n - 1)),
        )

    def renamed(token: Column) -> Column:
        first = F.substring(token, 1, 1)
        quote = F.when(first.isin('"', "`"), first).otherwise("")
        return F.concat(quote, new_name, quote)

    def edited(tokens: Column) -> Column:
        return let(
            hits(tokens),
            lambda at: F.array_join(
                F.transform(
                    tokens, lambda t, i: F.when(F.array_contains(at, i), renamed(t)).otherwise(t)
                ),
                "",
            ),
        )

    tokens = F.regexp_extract_all(sql, F.lit(lexicon.lossless_pattern(dialect)), F.lit(0))
    return let(tokens, edited)
