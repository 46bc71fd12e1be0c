"""Fixed word lists and the lexical patterns the statement jobs share."""

from __future__ import annotations

import re

# Clauses in which a use of the column changes results.
HARD_CLAUSES = [
    "WHERE", "JOIN", "GROUP", "ORDER", "HAVING", "PARTITION", "QUALIFY", "SET", "UPDATE",
]

# Also hard: the statement changes the column itself.
CHANGING_CLAUSES = ["ALTER"]

# Functions that fold the rows of a group, so GROUP BY ALL does not group by their arguments.
AGGREGATES = """
ANY_VALUE APPROX_COUNT_DISTINCT ARRAY_AGG AVG BOOL_AND BOOL_OR COUNT COUNTIF COUNT_IF FIRST LAST LISTAGG MAX MAX_BY MEDIAN MIN MIN_BY
STDDEV STRING_AGG SUM VARIANCE
""".split()

# Words that are never a column, a table or an alias.
RESERVED = """
ALL ALTER AND ANTI ANY AS ASC ASOF AT BEFORE BETWEEN BY CASE CLUSTER COLLATE COLUMN CONNECT
CREATE CROSS CUBE CURRENT DELETE DESC DESCRIBE DISTINCT DISTRIBUTE DIV DROP ELSE END ESCAPE
EXCEPT EXCLUDE EXISTS EXPLAIN FALSE FETCH FILTER FOLLOWING FOR FROM FULL GLOB GRANT GROUP
GROUPING HAVING IF IGNORE ILIKE IN INNER INSERT INTERSECT INTERVAL INTO IS ISNULL JOIN LATERAL
LEFT LIKE LIMIT MATCHED MATERIALIZED MERGE MINUS NATURAL NOT NOTNULL NULL NULLS OFFSET ON OR
ORDER OUTER OVER OVERLAPS OVERWRITE PARTITION PIVOT PRECEDING QUALIFY RANGE RECURSIVE REGEXP
RENAME REPLACE RESPECT RETURNING REVOKE RIGHT RLIKE ROLLUP ROWS SELECT SEMI SET SETS SIMILAR
SOME SORT START STRAIGHT_JOIN TABLE TABLESAMPLE THEN TO TRUE TRUNCATE UNBOUNDED UNION UNNEST
UNPIVOT UPDATE USING VALUES VIEW WHEN WHERE WINDOW WITH WITHIN XOR
""".split()

# Of these, words that name a column where they stand as an operand, as most dialects allow.
MAY_NAME = """
ANTI ASOF AT BEFORE CLUSTER COLUMN CONNECT CUBE CURRENT DESCRIBE DIV ESCAPE EXCLUDE EXPLAIN FETCH FILTER FOLLOWING GLOB
GROUPING IF IGNORE INTERVAL ISNULL MATCHED MATERIALIZED MINUS NOTNULL NULLS OFFSET OVER OVERLAPS OVERWRITE PARTITION PIVOT
PRECEDING RANGE RECURSIVE REGEXP RENAME REPLACE RESPECT RETURNING RLIKE ROLLUP ROWS SEMI SETS SIMILAR SOME SORT START
TABLE TABLESAMPLE TO TRUNCATE UNBOUNDED UNNEST UNPIVOT VALUES VIEW WINDOW WITHIN XOR
""".split()
BEFORE_OPERAND = """
SELECT DISTINCT , ( WHERE AND OR NOT ON BY HAVING QUALIFY WHEN THEN ELSE CASE SET LIKE ILIKE BETWEEN IN
= <> != < > <= >= + - * / % ||
""".split()
AFTER_OPERAND = """
, ) = <> != < > <= >= + - * / % || :: IS IN LIKE ILIKE BETWEEN NOT AND OR FROM AS ASC DESC THEN ELSE END WHEN GROUP ORDER HAVING
QUALIFY LIMIT UNION EXCEPT INTERSECT
""".split() + [""]

# Words a statement may begin with; anything else is taken as unreadable.
STATEMENT_STARTS = """
ALTER ANALYZE BEGIN CALL COMMENT COMMIT COPY CREATE DECLARE DELETE DESC DESCRIBE DROP EXECUTE
EXPLAIN FROM GET GRANT INSERT LIST MERGE PUT REFRESH REPLACE REVOKE ROLLBACK SELECT SET SHOW
TRUNCATE UNSET UPDATE USE VALUES WITH (
""".split()

# A statement may not end with one of these, nor have one in front of a NEEDS_OPERAND follower.
NEEDS_OPERAND = """
= <> != < > <= >= || AND OR NOT WHERE HAVING QUALIFY ON FROM JOIN BY IN LIKE ILIKE BETWEEN INTO
WHEN THEN ELSE
""".split()
NO_OPERAND = """
) , = <> != <= >= WHERE GROUP ORDER HAVING QUALIFY LIMIT UNION INTERSECT JOIN FROM AND OR THEN END
""".split()
DANGLING = NEEDS_OPERAND + ", + - / . CASE SET AS USING".split()

PIECE = r'(?:"[^"]*+"?+|`[^`]*+`?+|[\p{L}_][\p{L}\p{N}_$]*+)'
NUMBER = r"[0-9][0-9.]*+"
# A statement with literals and comments masked, cut into words, dotted names and operators.
SHAPE_TOKEN = (
    r"''?+"
    rf"|{PIECE}(?:\s*+\.\s*+{PIECE})*+(?:\s*+\.\s*+\*)?+"
    rf"|{NUMBER}"
    r"|\{\{|\{%|\$\{|#\{|<>|<=|>=|!=|\|\||::|=>|->|:="
    r"|\S"
)
# Start of a number that is not the tail of a word.
LOOSE_NUMBER = rf"(?<![\p{{L}}\p{{N}}_$.]){NUMBER}"
# What may follow a number that names an item of the select list by its place.
AFTER_PLACE = ["", ",", ")", "ASC", "DESC", "NULLS", "HAVING", "ORDER", "LIMIT", "OFFSET", "FETCH", "QUALIFY", "WINDOW", "UNION", "EXCEPT", "INTERSECT"]
HAS_PLACES = r"(?i)\bBY\b.*?(?:\bBY|,) ?[0-9]|\bBY [0-9]"
# Such a number after BY, in text whose blanks are single. It stays in the shape where no parenthesis stands between; elsewhere
# it is masked like others, and what it names counts as not readable.
_PLACE = (
    rf"(?<=BY |,|, )(?=[0-9]{{1,3}} ?(?:[,)]|\z|(?:{'|'.join(w for w in AFTER_PLACE if w.isalpha())})\b))"
    r"(?<=\bBY [^()';]{0,300})"
)
# The digit is looked for first: it is the cheapest test, and most places fail it.
MASKED_NUMBER = rf"(?i)(?=[0-9])(?<![\p{{L}}\p{{N}}_$.])(?!{_PLACE}){NUMBER}"

# White space that is more than one blank.
WIDE_SPACE = r"[\t\n\r\f\x0b][ \t\n\r\f\x0b]*+| [ \t\n\r\f\x0b]++"

DOT = r"\s*+\.\s*+"


def leading_parts(names: list[str]) -> str | None:
    """Pattern of the parts of dotted names that have another part behind them, with none of ``names`` up to there;
    group 1 is the last such part. Other names, and the rest of a dotted one, match whole as group 2, with the plain
    words that follow, so that a statement has few matches. Null where a name has letters beyond ASCII, whose case is not
    folded alike everywhere.
    """
    if not all(name.isascii() for name in names):
        return None
    taken = "|".join(re.escape(name) for name in names if name) or "(?!)"
    letter = r"[\p{L}\p{N}_$]"
    free = [rf"(?!(?iu:{taken})(?!{letter}))[\p{{L}}_]{letter}*+"]
    free += [rf'{quote}(?!(?iu:{taken}){quote})[^"`.\s]++{quote}' for quote in '"`']
    part = "|".join(free)
    plain = rf'[^\p{{L}}_"`]++[\p{{L}}_]{letter}*+(?!\s*+\.)'
    return rf"(?:{part})(?=(?:{DOT}({part}))++)|({PIECE}(?:{DOT}{PIECE})*+(?:{plain})*+)"


DIALECTS = {
    # dialect: (backslash escapes inside literals, extra line-comment openers, dollar-quoted text)
    "snowflake": (True, ["//"], True),
    "bigquery": (True, ["#"], False),
    "databricks": (True, [], False),
    "mysql": (True, ["#"], False),
    "postgres": (False, [], True),
    "ansi": (False, [], False),
}


def _literal(dialect: str, capture: bool) -> str:
    backslash, _, _ = DIALECTS[dialect]
    body = r"(?:[^'\\]++|\\[\s\S])*+" if backslash else r"[^']*+"
    return rf"('){body}('?+)" if capture else rf"'{body}'?+"


def _skipped(dialect: str) -> str:
    _, openers, _ = DIALECTS[dialect]
    line = "|".join(rf"{opener}[^\n]*+" for opener in ["--", *openers])
    return rf"{line}|/\*[\s\S]*?(?:\*/|\z)"


def _dollar(dialect: str, capture: bool) -> str:
    if not DIALECTS[dialect][2]:
        return ""
    first = r"(\$)\$" if capture else r"\$\$"
    return rf"|{first}[\s\S]*?(?:\$\$|\z)"


def mask_pattern(dialect: str) -> tuple[str, str]:
    """Pattern and replacement that blank literals and comments but keep quoted names.

    Repetitions are possessive, so a literal of any length is matched in a loop
    and not by recursion, and a lone quote runs to the end of the text once. The
    first character is tested before the alternatives, which most places fail.
    """
    pattern = (
        rf"""(?=['"`/$#-])(?:{_literal(dialect, True)}|("[^"]*+"?+|`[^`]*+`?+)|{_skipped(dialect)}"""
        rf"{_dollar(dialect, True)})"
    )
    return pattern, " $1$2$3$4 " if DIALECTS[dialect][2] else " $1$2$3 "


def lossless_pattern(dialect: str) -> str:
    """Pattern whose matches, joined, give the statement back byte for byte."""
    return (
        rf"{_literal(dialect, False)}|{PIECE}|{_skipped(dialect)}{_dollar(dialect, False)}"
        rf"|{NUMBER}|\s++|[\s\S]"
    )
