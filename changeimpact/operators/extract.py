"""Column usage of statements as rows: distinct shapes -> tokens -> one fact row per shape.

Only distinct shapes that can matter are cut into tokens. All token windows are
partitioned by statement, so after the one shuffle that spreads the shapes there
is no other: a statement's tokens are bounded by the statement's length, however
often the log repeats it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from changeimpact.functions import lexicon, text
from changeimpact.functions.text import let

WORD_START = r'^[\p{L}_"`]'
NO_PAREN = -1
NO_END = 2147483647
PREFILTER_LIMIT = 200
ALL_ITEMS, UNREAD_ITEM = -1, 0  # places of GROUP BY ALL, and of a number that was masked


def fingerprint_log(log: DataFrame, dialect: str = "snowflake") -> DataFrame:
    """Add the shape id of every statement; store it to skip this step in later runs."""
    if "sid" in log.columns:
        return log
    return _with_shape(log, text.statement_shape(F.col("sql"), dialect))


def _with_shape(rows: DataFrame, shape: Column) -> DataFrame:
    def marked(shape: Column) -> Column:
        return F.struct(shape.alias("shape"), shape_id(F.col("dataset"), shape).alias("sid"))

    # inline() keeps null checks on the join key from repeating the masking.
    others = [c for c in rows.columns if c not in ("shape", "sid")]
    return rows.select(*[F.col(f"`{c}`") for c in others], F.inline(F.array(let(shape, marked))))


def narrow_shapes(fingerprinted: DataFrame, names: list[str] | None) -> DataFrame:
    """The same statements, with shapes that tell only apart what can matter to the column names ``names``.

    Tables are known by their base name, so of a dotted name only the last part is read, and from the first of ``names`` in
    it on also what follows and the part before. Parts further in front become the next one that is read: one statement
    over the schemas of many tenants is one shape, with as many name pieces. Such shapes hold for ``names`` alone: store
    those of ``fingerprint_log()``.
    """
    if names is None or len(names) > PREFILTER_LIMIT:
        return fingerprinted
    pattern = lexicon.leading_parts(names)
    if pattern is None:
        return fingerprinted
    return _with_shape(fingerprinted, F.regexp_replace("shape", pattern, "$1$2"))


def shape_id(dataset: Column, shape: Column) -> Column:
    """128 bits of a SHA-256 of dataset and shape, as binary: short to sort and shuffle by."""
    digest = F.sha2(F.concat_ws("\x1f", F.coalesce(dataset, F.lit("")), shape), 256)
    return F.substring(F.unhex(digest), 1, 16)


def distinct_shapes(fingerprinted: DataFrame) -> DataFrame:
    """One row per (dataset, shape) with the number of statements behind it.

    Grouping by the text itself keeps this a hash aggregate with map-side
    combine, so a shape that fills a third of the log leaves each task as one row.
    """
    return (
        fingerprinted.groupBy("dataset", "shape")
        .agg(F.count(F.lit(1)).alias("n_statements"))
        .withColumn("sid", shape_id(F.col("dataset"), F.col("shape")))
    )


def unreadable_reason(tokens: Column) -> Column:
    """Why a statement cannot be read, or null."""
    return let(F.transform(tokens, F.upper), lambda upper: _unreadable(tokens, upper))


def _unreadable(tokens: Column, upper: Column) -> Column:
    depth = F.aggregate(
        tokens,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")),
        lambda acc, t: F.struct(
            _after(acc, t).alias("now"), F.least(acc["low"], _after(acc, t)).alias("low")
        ),
    )
    joined = F.concat(F.lit(" "), F.array_join(upper, " "), F.lit(" "))
    before = "|".join(_escaped(lexicon.NEEDS_OPERAND))
    after = "|".join(_escaped(lexicon.NO_OPERAND))
    last = F.get(upper, F.size(upper) - 1)
    dynamic = F.rlike(joined, F.lit(r" EXECUTE (?:IMMEDIATE|\(|'') ?"))
    template = F.exists(tokens, lambda t: t.isin("{{", "{%", "${", "#{"))
    lone_quote = F.exists(
        tokens, lambda t: (t == "'") | F.rlike(t, F.lit('^"[^"]*$|^`[^`]*$'))
    )
    unbalanced = let(depth, lambda d: (d["now"] != 0) | (d["low"] < 0))
    no_start = ~F.coalesce(F.get(upper, F.lit(0)), F.lit("")).isin(lexicon.STATEMENT_STARTS)
    return (
        F.when(F.size(tokens) == 0, "empty statement")
        .when(template, "template markup")
        .when(lone_quote, "unterminated quote")
        .when(unbalanced, "unbalanced parentheses")
        .when(dynamic, "statement built at run time")
        .when(no_start, "no statement keyword at the start")
        .when(last.isin(lexicon.DANGLING), "statement breaks off")
        .when(F.rlike(joined, F.lit(rf" (?:{before}) (?:{after}) ")), "operand missing")
    )


def _after(acc: Column, token: Column) -> Column:
    return acc["now"] + F.when(token == "(", 1).when(token == ")", -1).otherwise(0)


def _escaped(words: list[str]) -> list[str]:
    return [w if w.isalpha() else "".join("\\" + c for c in w) for w in words]


def _pieces(token: Column) -> Column:
    """Number of the names that a dotted name or word holds."""
    return F.when(F.rlike(token, F.lit(WORD_START)), F.regexp_count(token, F.lit(lexicon.PIECE))).otherwise(0)


def _statements(tokens: Column) -> Column:
    """The statements of a text, cut at its semicolons: (at, tokens, pieces before). Empty ones are
    left out; a text of none but empty ones is one empty statement."""
    marks = F.filter(F.transform(tokens, lambda t, i: F.when(t == ";", i)), lambda i: i.isNotNull())
    bounds = F.concat(F.array(F.lit(-1)), marks, F.array(F.size(tokens)))

    def cut_at(bounds: Column) -> Column:
        def part(k: Column) -> Column:
            start = F.get(bounds, k) + 1
            before = F.aggregate(F.slice(tokens, F.lit(1), start), F.lit(0), lambda n, t: n + _pieces(t))
            return F.struct(
                k.cast("int").alias("at"), F.slice(tokens, start + 1, F.get(bounds, k + 1) - start).alias("tokens"),
                before.alias("before"),
            )

        return F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), part)

    whole = F.array(F.struct(F.lit(0).alias("at"), tokens.alias("tokens"), F.lit(0).alias("before")))
    filled = F.filter(let(bounds, cut_at), lambda p: F.size(p["tokens"]) > 0)
    several = let(filled, lambda parts: F.when(F.size(parts) > 0, parts).otherwise(F.slice(whole, 1, 1)))
    return F.when(F.array_contains(tokens, ";"), several).otherwise(whole)


def read_tokens(shapes: DataFrame) -> DataFrame:
    """One row per statement of each text, with its tokens and why it is unreadable.

    ``text_sid`` is the id of the text; the statements of a text have ids of their own in ``sid``.
    """

    def read(part: Column) -> Column:
        return F.struct(
            part["at"].alias("part"), part["before"].alias("pieces_before"), part["tokens"].alias("tokens"),
            unreadable_reason(part["tokens"]).alias("unreadable"),
        )

    parts = let(text.shape_tokens(F.col("shape")), lambda tokens: F.transform(_statements(tokens), read))
    # inline() keeps later filters from being rewritten into a second copy of this work.
    own = F.when(F.col("part") == 0, F.col("sid")).otherwise(
        F.concat("sid", F.unhex(F.lpad(F.hex("part"), 8, "0")))
    )
    return shapes.select("*", F.inline(parts)).withColumns({"text_sid": F.col("sid"), "sid": own})


def may_matter(columns: list[str] | None) -> Column:
    """Cheap test that keeps shapes which can yield a finding for one of ``columns``."""
    if columns is None or len(columns) > PREFILTER_LIMIT:
        return F.lit(True)
    names = [F.contains(F.lower("shape"), F.lit(c.lower())) for c in columns]
    named = reduce(lambda a, b: a | b, names, F.lit(False))
    implied = F.contains("shape", F.lit("*")) | F.rlike("shape", F.lit(r"(?i)\bnatural\b"))
    return named | implied | F.col("unreadable").isNotNull()


def _innermost(df: DataFrame, **flags: str) -> DataFrame:
    """For each ``out=flag``: the innermost flagged parenthesis around a token, itself included."""
    run = W.partitionBy("sid").orderBy("pos")
    opens, closes = F.col("up") == "(", F.col("up") == ")"
    df = df.withColumns(
        {
            f"_{out}": F.sum(
                F.when(F.col(flag) & opens, 1).when(F.col(flag) & closes, -1).otherwise(0)
            ).over(run)
            + F.when(F.col(flag) & closes, 1).otherwise(0)
            for out, flag in flags.items()
        }
    )
    return df.withColumns(
        {
            out: F.coalesce(
                F.last(F.when(F.col(flag) & opens, F.col("pos")), ignorenulls=True).over(
                    W.partitionBy("sid", f"_{out}").orderBy("pos")
                ),
                F.lit(NO_PAREN),
            )
            for out, flag in flags.items()
        }
    )


def _yes(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def lexemes(shapes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per token of each readable shape, in order, with its neighbours.

    An unreadable shape gives one row without a token, so it stays in the result.
    The partition count is set, because the work here is large for its bytes and
    adaptive coalescing goes by bytes.
    """
    width = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = W.partitionBy("sid").orderBy("pos")
    readable = F.when(F.col("unreadable").isNull(), F.col("tokens"))
    head = F.struct("dataset", "shape", "n_statements", "unreadable", "text_sid")
    places = F.rlike("shape", F.lit(lexicon.HAS_PLACES))
    rows = shapes.repartition(width, "sid").select(
        "sid", head.alias("head"), "pieces_before", places.alias("places"), F.posexplode_outer(readable).alias("pos", "tok")
    )
    # The statement's own columns stay on its first row, so the windows move narrow rows.
    rows = rows.withColumn("head", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("head")))
    plain = F.regexp_replace(
        F.translate(F.regexp_replace("tok", r"\s*\.\s*", "."), '"`', ""), r"\.\*$", ""
    )
    word = F.rlike("tok", F.lit(WORD_START))
    star = F.rlike("tok", F.lit(r"\.\s*\*$"))
    parts = F.split(F.lower(plain), r"\.")
    upper = F.upper("tok")
    rows = rows.withColumns({"_before": F.lag(upper, 1).over(run), "_after": F.lead(upper, 1).over(run)})
    # Some words of the language may name a column: where only an operand can stand, they do.
    frame = (F.col("_before") == "(") & (F.col("_after") == "BETWEEN")
    operand = (
        upper.isin(lexicon.MAY_NAME) & F.col("_before").isin(lexicon.BEFORE_OPERAND)
        & F.coalesce(F.col("_after"), F.lit("")).isin(lexicon.AFTER_OPERAND) & ~frame
    )
    ident = word & (~upper.isin(lexicon.RESERVED) | _yes(operand)) & ~star
    rows = rows.withColumns(
        {
            # Only words of the language and operators are compared later on.
            "up": F.when(ident & ~_yes(upper.isin(lexicon.AGGREGATES) & (F.col("_after") == "(")), "")
            .when(star, ".*").otherwise(upper),
            "parts": F.when(word, parts),
            "star": star,
            "ident": ident,
            "pieces": _pieces(F.col("tok")),
            # A number that may name an item of the select list by its place.
            "place": F.when(
                F.col("places") & F.rlike("tok", F.lit("^[0-9]+$")) & F.col("_before").isin("BY", ",")
                & F.coalesce(F.col("_after"), F.lit("")).isin(lexicon.AFTER_PLACE), F.col("tok")
            ).try_cast("int"),
        }
    ).drop("_before", "_after", "places")
    rows = rows.withColumns(
        {
            "name": F.when(F.col("ident"), F.get("parts", F.size("parts") - 1)),
            "qual": F.when(F.col("ident"), F.get("parts", F.size("parts") - 2)),
            "path": F.when(F.col("ident") & _has_field(F.col("parts"), columns), F.col("parts")),
        }
    )

    def near(column: str, offset: int) -> Column:
        return F.coalesce(F.lag(column, offset).over(run), F.lit(""))

    rows = rows.drop("parts", "tok").withColumns(
        {
            "piece_no": F.sum("pieces").over(run) + F.col("pieces_before"),
            "p1": near("up", 1),
            "p2": near("up", 2),
            "n1": near("up", -1),
            "n2": near("up", -2),
            "_n1_name": F.lead("name", 1).over(run),
            "_n2_name": F.lead("name", 2).over(run),
            "p1_ident": _yes(F.lag("ident", 1).over(run)),
            "n1_ident": _yes(F.lead("ident", 1).over(run)),
            "p2_ident": _yes(F.lag("ident", 2).over(run)),
        }
    )
    # The alias a table mention would have here.
    alias = F.when(F.col("n1") == "AS", F.col("_n2_name")).otherwise(F.col("_n1_name"))
    return rows.withColumn("alias", alias).drop("_n1_name", "_n2_name", "pieces", "pieces_before")


def _has_field(parts: Column, columns: list[str] | None) -> Column:
    """Whether a dotted name may have a column of interest before its last part."""
    if columns is None:
        return F.size(parts) > 1
    owners = F.slice(parts, F.lit(1), F.size(parts) - 1)
    wanted = F.array(*[F.lit(c.lower()) for c in columns]).cast("array<string>")
    return F.when(F.size(parts) > 1, F.arrays_overlap(owners, wanted)).otherwise(False)


def parentheses(tokens: DataFrame) -> DataFrame:
    """Enclosing parenthesis, enclosing query, and clause-like parentheses (windows, filters)."""
    pair = W.partitionBy("sid", "paren")
    opens = F.col("up") == "("
    df = _innermost(tokens.withColumn("any", F.lit(True)), paren="any")
    starts_query = F.max(opens & F.col("n1").isin("SELECT", "WITH")).over(pair)
    df = df.withColumns(
        {
            "call": F.max(F.when(opens, F.col("p1"))).over(pair),
            "is_query": _yes(starts_query) & (F.col("paren") != NO_PAREN),
            "_ordered": F.max((F.col("up") == "ORDER") & (F.col("n1") == "BY")).over(pair),
            "_after": F.max(F.when(F.col("up") == ")", F.col("n1"))).over(pair),
            "_within": F.max(opens & (F.col("p2") == "WITHIN")).over(pair),
            "_one_of": F.max(opens & (F.col("p1") == "ON") & (F.col("p2") == "DISTINCT")).over(pair),
        }
    )
    area = (
        F.when((F.col("paren") == NO_PAREN) | F.col("is_query"), None)
        .when(F.col("call") == "OVER", "OVER")
        .when(F.col("call") == "FILTER", "WHERE")
        .when(F.col("_one_of"), "GROUP")  # DISTINCT ON keeps one row of each group
        .when(F.col("_within") | (F.col("_ordered") & (F.col("call") != "AS")), "ORDER")
        .when(F.col("_ordered"), "OVER")
        .when(F.col("_after").isin("OVER", "IGNORE", "RESPECT"), "PARTITION")
    )
    df = df.withColumns({"area": area, "is_scoping": F.col("is_query") | area.isNotNull()})
    return _innermost(df, query="is_query", scoping="is_scoping")


def _clause_keyword(in_select: Column) -> Column:
    """Clause a word opens at its query's own level, or null."""
    up, p1, n1, n2 = (F.col(c) for c in ("up", "p1", "n1", "n2"))
    return (
        F.when((up == "WITH") & ((n1 == "RECURSIVE") | n2.isin("AS", "(")) & ~in_select, "WITH")
        .when(up == "SELECT", "SELECT")
        .when((up == "FROM") & (p1 != "DISTINCT"), "FROM")
        .when(up.isin("JOIN", "PIVOT", "UNPIVOT"), "JOIN")
        .when((up == "ON") & (p1 != "DISTINCT"), F.when(in_select, "JOIN").otherwise("OTHER"))
        .when(up.isin("WHERE", "HAVING", "QUALIFY"), up)
        .when((up == "GROUP") & n1.isin("BY", "ALL"), "GROUP")
        .when((up == "ORDER") & n1.isin("BY", "SIBLINGS"), "ORDER")
        .when(up.isin("CLUSTER", "DISTRIBUTE", "SORT") & (n1 == "BY"), "ORDER")
        .when((up == "WINDOW") & (n2 == "AS"), "PARTITION")
        .when(up.isin("USING", "INTO") & ~in_select, "INTO")
        .when((up == "SET") & ~in_select, "SET")
        .when((up == "WHEN") & ((n1 == "MATCHED") | ((n1 == "NOT") & (n2 == "MATCHED"))), "OTHER")
        .when((up == "ALTER") & (n1 == "TABLE") & ~in_select, "ALTER")
        .when((up == "INSERT") & (n1 == "("), "OTHER")
        .when(up.isin("VALUES", "RETURNING") & ~in_select, "OTHER")
        .when(up.isin("LIMIT", "OFFSET", "FETCH", "CONNECT", "START") & in_select, "SELECT")
    )


def clauses(tokens: DataFrame) -> DataFrame:
    """The SELECT each token belongs to, where that SELECT ends, and its clause."""
    whole = W.partitionBy("sid", "query")
    run = whole.orderBy("pos")
    back = whole.orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)
    area = W.partitionBy("sid", "scoping")
    own = F.col("paren") == F.col("query")
    pos, up = F.col("pos"), F.col("up")
    select = F.when(own & (up == "SELECT"), pos)

    def latest(flag: Column) -> Column:
        return F.last(F.when(flag, pos), ignorenulls=True).over(run)

    df = tokens.withColumn("sel", F.last(select, ignorenulls=True).over(run))
    df = df.withColumn("kw", F.when(own, _clause_keyword(F.col("sel").isNotNull())))
    ends = select.isNotNull() | ((F.col("up") == ")") & own)
    df = df.withColumn("raw_clause", F.last("kw", ignorenulls=True).over(run))
    in_items = F.col("raw_clause") == "SELECT"
    item = W.partitionBy("sid", "query", "sel").orderBy("pos")
    df = df.withColumns(
        {
            # Place of an item in its select list; none where a star stands before it.
            "item": F.when(
                F.count(F.when(in_items & own & (F.col("star") | ((up == "*") & F.col("p1").isin("SELECT", "DISTINCT", "ALL", ","))), 1)).over(item) == 0,
                F.count(F.when(in_items & own & (up == ","), 1)).over(item).cast("int") + 1,
            ),
            "_from_at": latest(F.col("kw") == "FROM"),
            "_comma_at": latest(own & (F.col("up") == ",")),
            "n_selects": F.count(select).over(whole),
            "sel_end": F.coalesce(
                F.last(F.when(ends, pos), ignorenulls=True).over(back), F.lit(NO_END)
            ),
            # ORDER inside an OVER(...) stands at that parenthesis' own level.
            "_inner_order": F.last(
                F.when((F.col("paren") == F.col("scoping")) & (up == "ORDER"), pos), ignorenulls=True
            ).over(area.orderBy("pos")),
            "_area": F.max(F.when(pos == F.col("scoping"), F.col("area"))).over(area),
        }
    )
    after_comma = F.col("_comma_at") > F.col("_from_at")
    main = (
        F.when(F.col("raw_clause") == "FROM", F.when(after_comma, "JOIN").otherwise("SELECT"))
        .when(F.col("raw_clause").isin("WITH", "INTO"), "OTHER")
        .otherwise(F.coalesce("raw_clause", F.lit("OTHER")))
    )
    inside = F.col("scoping") != F.col("query")
    in_window = F.when(F.col("_inner_order") < pos, "ORDER").otherwise("PARTITION")
    # The ORDER BY after a set operation belongs to no single SELECT.
    unowned = (F.col("n_selects") > 1) & (F.col("raw_clause") == "ORDER") & ~inside
    return df.withColumns(
        {
            "clause": F.when(inside & (F.col("_area") == "OVER"), in_window)
            .when(inside & F.col("_area").isNotNull(), F.col("_area"))
            .otherwise(main),
            "scope": F.when(~unowned, F.col("sel")),
        }
    )


def roles(tokens: DataFrame) -> DataFrame:
    """What each name token is: table mention, alias, CTE name, written column or reference."""
    run = W.partitionBy("sid").orderBy("pos")
    pair = W.partitionBy("sid", "paren")
    ident, p1, p2, n1 = (F.col(c) for c in ("ident", "p1", "p2", "n1"))
    own = F.col("paren") == F.col("query")
    opens, closes = F.col("up") == "(", F.col("up") == ")"

    def before(value: Column, offset: int = 1) -> Column:
        return F.lag(value, offset).over(run)

    df = tokens.withColumns(
        {
            "p1_kw": F.coalesce(before(F.col("kw")), F.lit("")),
            "_p_name": before(F.col("name")),
            "_p_clause": F.coalesce(before(F.col("raw_clause")), F.lit("")),
            "_last_call": F.last(F.when(closes, F.col("call")), ignorenulls=True).over(run),
            "_last_query": F.last(F.when(closes, F.col("is_query")), ignorenulls=True).over(run),
        }
    )
    # The parenthesis that closed just before this token, or before an AS in front of it.
    closed = (p1 == ")") | ((p1 == "AS") & (p2 == ")"))
    last_call = F.coalesce("_last_call", F.lit(""))
    # From here on only names, parentheses and stars matter; of a statement's rows
    # the first stays too, because it has the statement's own columns.
    df = df.where(
        ident | opens | closes | F.col("star") | (F.col("up") == "*")
        | F.col("head").isNotNull() | F.col("up").isin("RECURSIVE", "NATURAL") | F.col("place").isNotNull()
        | ((F.col("up") == "ALL") & (p1 == "BY"))
    )
    mentioned = (
        ((p1 == "FROM") & (F.col("p1_kw") == "FROM"))
        | p1.isin("JOIN", "UPDATE", "TABLE", "VIEW")
        | (p1.isin("INTO", "USING") & (F.col("p1_kw") == "INTO"))
        | ((p1 == "EXISTS") & p2.isin("IF", "NOT") & F.col("sel").isNull())
        | ((p1 == ",") & own & F.col("raw_clause").isin("FROM", "JOIN"))
        | ((p1 == "(") & p2.isin("FROM", "JOIN"))
    )
    listed = (p1 == "INTO") | ((p1 == "TABLE") & p2.isin("INTO", "OVERWRITE"))
    cte_name = ident & own & (F.col("raw_clause") == "WITH") & p1.isin("WITH", "RECURSIVE", ",")
    df = df.withColumns(
        {
            "is_cte_name": cte_name,
            "is_mention": ident & mentioned & ((n1 != "(") | listed),
            "is_unnest_alias": ident & closed & (last_call == "UNNEST"),
            "is_derived_alias": ident & closed & _yes(F.col("_last_query")),
        }
    )
    df = df.withColumns(
        {
            "_p_mention": F.col("p1_ident") & before(F.col("is_mention")),
            "_p_unnest": F.col("p1_ident") & before(F.col("is_unnest_alias")),
            "_cte_name": F.last(F.when(cte_name, F.col("name")), ignorenulls=True).over(run),
        }
    )
    cte_opens = opens & p1.isin("AS", "MATERIALIZED") & (F.col("_p_clause") == "WITH")
    derived_opens = opens & F.col("_p_clause").isin("FROM", "JOIN", "INTO")
    df = df.withColumns(
        {
            "list_of": F.max(F.when(opens & F.col("_p_mention"), F.col("_p_name"))).over(pair),
            "unnest_list": _yes(F.max(F.when(opens, F.col("_p_unnest"))).over(pair)),
            "is_cte_body": F.col("is_query") & F.max(cte_opens).over(pair),
            "cte_name": F.max(F.when(opens, F.col("_cte_name"))).over(pair),
            "is_barrier": F.col("is_query") & ~F.max(derived_opens).over(pair),
        }
    )
    df = _innermost(df, barrier="is_barrier", cte_body="is_cte_body")
    operand_before = (
        F.col("p1_ident")
        | p1.isin("''", "END", "]")
        | (F.rlike(p1, F.lit("^[0-9]")) & (p2 != "TOP"))
        | ((p1 == ")") & ~last_call.isin("ON", "TOP"))
    )
    in_list = (F.col("paren") != NO_PAREN) & (F.col("list_of").isNotNull() | F.col("unnest_list"))
    df = df.withColumns(
        {
            "in_list": in_list,
            "is_ref": ident
            & ~F.col("is_mention")
            & ~F.col("is_cte_name")
            & ~in_list
            & ~operand_before
            & ~n1.isin("(", "=>")
            & ~p1.isin("AS", "::", ":", "@", "->"),
        }
    )
    # A name after an operand is an alias where an alias may stand: at the end of an item of a select list
    # or after a table. Elsewhere nothing explains it.
    second = F.col("p2_ident") | p2.isin("''", "END", "]", ")") | F.rlike(p2, F.lit("^[0-9]"))
    item_end = n1.isin(ITEM_ENDS) & ~F.col("n1_ident") & ~(F.col("p1_ident") & second)
    after_table = F.col("raw_clause").isin("FROM", "JOIN", "INTO", "WITH") | F.col("raw_clause").isNull()
    is_alias = F.when(F.col("raw_clause") == "SELECT", item_end).otherwise(after_table)
    explained = (
        F.col("is_ref") | F.col("is_mention") | F.col("is_cte_name") | in_list
        | n1.isin("(", "=>") | p1.isin("AS", "::", ":", "@", "->")
        | F.col("is_derived_alias") | F.col("is_unnest_alias") | _yes(is_alias)
    )
    return df.withColumn("is_stray", ident & ~explained)


# What may follow an item of a select list; an empty text is the end of the statement.
ITEM_ENDS = ["", ",", ")", "FROM", "INTO", "WHERE", "UNION", "EXCEPT", "INTERSECT", "MINUS", "LIMIT", "ORDER", "GROUP", "QUALIFY"]
# Words that open or bound a clause; names after NAMING may be tables, aliases or CTE names.
STRUCTURE = """
( ) , * .* SELECT WITH RECURSIVE FROM JOIN PIVOT UNPIVOT ON WHERE HAVING QUALIFY GROUP ORDER CLUSTER
DISTRIBUTE SORT WINDOW USING SET INTO WHEN INSERT VALUES RETURNING LIMIT OFFSET FETCH CONNECT START
NATURAL ALTER ALL
""".split()
NAMING = "FROM JOIN INTO UPDATE TABLE VIEW USING EXISTS WITH RECURSIVE AS , ( )".split()


def structural(tokens: DataFrame, columns: list[str] | None) -> DataFrame:
    """Drop tokens that neither shape the statement nor name anything that can matter.

    Neighbours are columns by now, so what is dropped is still seen by its neighbours.
    """
    if columns is None:
        wanted = F.lit(True)
    else:
        wanted = F.col("name").isin([c.lower() for c in columns]) | F.col("path").isNotNull() | F.col("p1").isin(NAMING)
    shaping = F.col("up").isin(STRUCTURE) | F.col("place").isNotNull()
    return tokens.where(F.when(F.col("ident"), wanted).otherwise(shaping) | F.col("head").isNotNull())


def annotated_tokens(shapes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return roles(clauses(parentheses(structural(lexemes(shapes, columns), columns))))


def _collected(flag: Column, *fields: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(flag, F.struct(*fields))))


def statement_facts(
    shapes: DataFrame, columns: list[str] | None = None, every_shape: bool = False
) -> DataFrame:
    """One row per shape with its table mentions, CTEs, aliases, references and stars.

    ``columns`` limits references, and unless ``every_shape`` is set also the shapes
    read, to names that can matter.
    """
    read = read_tokens(shapes).where(may_matter(None if every_shape else columns))
    df = annotated_tokens(read, columns)
    wanted = F.lit(True)
    if columns is not None:
        wanted = F.col("name").isin([c.lower() for c in columns]) | F.col("path").isNotNull()
    pos, own = F.col("pos"), F.col("paren") == F.col("query")
    alias = F.coalesce("alias", "name")
    star = (
        (F.col("up") == "*") & own & F.col("p1").isin("SELECT", "DISTINCT", "ALL", ",")
        & (F.col("raw_clause") == "SELECT")
    ) | (F.col("star") & (F.col("raw_clause") == "SELECT"))
    scope = [F.col("scope"), F.col("sel_end"), F.col("barrier")]
    closes_cte = (F.col("up") == ")") & F.col("is_cte_body")
    placed = F.col("place").isNotNull() | ((F.col("up") == "ALL") & (F.col("p1") == "BY"))
    return df.groupBy("sid").agg(
        F.first("head", ignorenulls=True).alias("head"),
        _collected(F.col("is_mention"), pos, F.col("name").alias("raw"), alias.alias("alias"),
                   F.col("barrier"), F.col("cte_body")).alias("mentions"),
        _collected(closes_cte, pos, F.col("paren").alias("body"), F.col("cte_name").alias("name"),
                   ).alias("ctes"),
        F.collect_set(F.when(F.col("is_derived_alias"), F.col("name"))).alias("derived"),
        F.collect_set(
            F.when(F.col("is_unnest_alias") | (F.col("ident") & F.col("unnest_list")), F.col("name"))
        ).alias("unnested"),
        _collected(F.col("is_ref") & wanted, pos, F.col("name"), F.col("qual"), F.col("clause"),
                   *scope, F.col("piece_no"), _yes((F.col("call") == "USING") & F.col("sel").isNotNull()).alias("using"),
                   F.col("path"), F.when((F.col("clause") == "SELECT") & (F.col("raw_clause") == "SELECT"), F.coalesce("item", F.lit(0))).alias("item"),
                   _yes(F.col("call").isin(lexicon.AGGREGATES)).alias("folded"),
                   ).alias("refs"),
        _collected(placed & own & F.col("clause").isin("GROUP", "ORDER"), pos, F.col("clause"), F.col("scope"), F.col("barrier"),
                   F.coalesce("place", F.lit(ALL_ITEMS)).alias("item")).alias("places"),
        _collected(F.col("up") == "NATURAL", pos, F.col("piece_no"), *scope).alias("naturals"),
        _collected(F.col("is_stray") & wanted, pos, F.col("name"), F.col("clause"), F.col("path")).alias("strays"),
        _collected(star, pos, *scope).alias("stars"),
        F.collect_set(
            F.when(F.col("ident") & F.col("in_list") & F.col("list_of").isNotNull() & wanted,
                   F.struct(F.col("list_of").alias("target"), F.col("name")))
        ).alias("writes"),
        F.max(F.col("up") == "RECURSIVE").alias("recursive"),
    ).select("head.*", "*").drop("head")


def expand_ctes(facts: DataFrame) -> DataFrame:
    """Replace CTE names by the base tables behind them, and build the alias map.

    CTEs are taken innermost and first to last, so one pass over them resolves
    chains of any depth. A recursive CTE's mention of itself is dropped.
    """
    empty = F.array().cast("array<struct<name:string,tables:array<string>>>")

    def resolved(acc: Column, cte: Column) -> Column:
        inside = F.filter("mentions", lambda m: m["cte_body"] == cte["body"])
        return F.array_distinct(F.flatten(F.transform(inside, lambda m: _sources(acc, m["raw"]))))

    def without_self(tables: Column, cte: Column) -> Column:
        others = F.filter(tables, lambda t: t != cte["name"])
        return F.when(F.col("recursive") & (F.size(others) > 0), others).otherwise(tables)

    def step(acc: Column, cte: Column) -> Column:
        kept = let(resolved(acc, cte), lambda tables: without_self(tables, cte))
        fresh = F.filter(acc, lambda c: c["name"] != cte["name"])
        return F.concat(fresh, F.array(F.struct(cte["name"].alias("name"), kept.alias("tables"))))

    def expanded(sources: Column) -> Column:
        mentions = F.transform(
            "mentions",
            lambda m: F.struct(
                m["pos"].alias("pos"),
                m["raw"].alias("raw"),
                m["alias"].alias("alias"),
                m["barrier"].alias("barrier"),
                F.array_sort(_sources(sources, m["raw"])).alias("tables"),
            ),
        )
        return F.struct(sources.alias("sources"), mentions.alias("mentions"))

    df = facts.withColumn("_x", let(F.aggregate("ctes", empty, step), expanded))

    def entry(key: Column, tables: Column) -> Column:
        return F.struct(key.alias("key"), tables.alias("tables"))

    def alias_map(entries: Column) -> Column:
        def merged(key: Column, same: Column) -> Column:
            tables = F.array_distinct(F.flatten(F.transform(same, lambda e: e["tables"])))
            return F.struct(
                key.alias("key"), tables.alias("tables"), (F.size(same) > 1).alias("shadowed")
            )

        keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        return F.transform(
            keys,
            lambda k: let(F.filter(entries, lambda e: e["key"] == k), lambda same: merged(k, same)),
        )

    sources, mentions = F.col("_x.sources"), F.col("_x.mentions")
    entries = F.array_distinct(
        F.concat(
            F.transform(sources, lambda c: entry(c["name"], F.array_sort(c["tables"]))),
            F.transform(mentions, lambda m: entry(m["alias"], m["tables"])),
            F.transform(mentions, lambda m: entry(m["raw"], m["tables"])),
        )
    )
    tables = F.flatten(F.transform(mentions, lambda m: m["tables"]))
    return df.withColumns(
        {
            "mentions": mentions,
            "aliases": let(entries, alias_map),
            "tables": F.array_sort(F.array_distinct(tables)),
        }
    ).drop("_x", "recursive", "ctes")


def _sources(sources: Column, name: Column) -> Column:
    hit = F.get(F.filter(sources, lambda c: c["name"] == name), F.lit(0))
    return F.coalesce(hit["tables"], F.array(name))


def physical_tables(log: DataFrame, dialect: str = "snowflake") -> DataFrame:
    """Distinct base tables of each statement; an unreadable statement has none."""
    marked = narrow_shapes(fingerprint_log(log, dialect), [])
    facts = expand_ctes(statement_facts(distinct_shapes(marked), [], every_shape=True))
    tables = facts.select(F.col("text_sid").alias("sid"), F.explode("tables").alias("table_name")).distinct()
    return marked.select("query_id", "sid").join(tables, "sid").select("query_id", "table_name")


def regex_tables(log: DataFrame) -> DataFrame:
    """Rough table mentions without reading the statement: the name after each FROM or JOIN, if it is one.

    Names are taken from the words of the raw text, comments and literals included; words that only open a
    subquery or a table function are none.
    """
    name = r"`?([\w\-]+(?:\.[\w\-]+)*)`?"
    found = F.explode(F.regexp_extract_all("sql", F.lit(rf"(?i)\b(?:FROM|JOIN)\s+{name}"), F.lit(1)))
    return (
        log.select("query_id", found.alias("mention"))
        .select("query_id", text.unquoted_base_name(F.col("mention")).alias("table_name"))
        .where(~F.upper("table_name").isin(lexicon.RESERVED))
    )
