"""Personal data: fixed patterns, and bootstrapped contextual extraction of identifiers they miss.

The fixed patterns give the seed entities. Every seed and every other identifier-like token or run of digit
groups ("(555) 123-4567") is a mention with the words around it; the words form lexical patterns ("write to _",
"call _ now", and of one word "email: _", "_ mobile"). Patterns and
values form a graph, which is scored in rounds: a pattern is as sure of a kind as the share of its distinct
values that are known to be of that kind, given enough of them; an unknown value is as sure as its
patterns together, 1 - prod(1 - sureness), those of one word and the longer ones each by themselves. Values above the bar become known for the next round, until a round learns nothing; ``rounds`` only bounds
that loudly. Mentions
of values learned so are added as spans; spans of the fixed patterns stay as they are.

Only SQL functions are used. One pass over the texts gives spans and mentions; all later work is on mentions.
Distinct pattern-value pairs are formed first, so a pattern or value that fills the corpus is combined
before the shuffle; known values are joined to pairs, never broadcast by force.

Defined results: null and empty texts have no spans; repeated rows get equal results; null ids are
ordinary rows; input columns named like a result column are replaced. Spans are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeimpact.llm.common import row_key, stage, without

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns, written so that each match is tried once and where a maximal one can start.
_LOCAL = "[A-Za-z0-9._%+\\-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # 13 to 19 digits with at most one space or hyphen between two, not part of a longer run
    "card": r"(?<![0-9])(?<![0-9][\x20\-])[0-9](?:[\x20\-]?[0-9]){12,18}(?![\x20\-]?[0-9])",
    # 9 to 15 digits, up to the last one that the run of phone characters holds
    "phone": r"\+[0-9](?:[\x20().\-]*+[0-9]){8,14}(?![\x20().\-]*[0-9])",
}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IP_VALID = rf"^{PART}(?:\.{PART}){{3}}$"
#: Identifier-like: eight or more characters of which one is a digit or an @.
TOKEN = r"(?<![^\s\"'(<\[,;:=])(?=[A-Za-z._%+/\-]*[0-9@])[A-Za-z0-9][A-Za-z0-9@._%+/\-]{6,}[A-Za-z0-9]"
#: Groups of digits with spaces, parentheses, hyphens, dots or slashes between, 7 to 34 digits in at most 12 groups, or the
#: groups of an account number that starts with a country's letters. Longer runs of groups are tables, not identifiers.
GROUPED = (
    r"(?<![^\s\"'(<\[,;:=])(?<![0-9][\x20().\-/]{1,3})(?:"
    r"(?=(?:[\x20().\-/+]{0,4}[0-9]){7})(?:\+?\([0-9]{1,12}\)|\+?[0-9]{1,12}+)(?:[\x20().\-/]{1,3}[0-9]{1,12}+){1,11}+"
    r"|[A-Z]{2}[0-9]{2}(?:\x20[A-Z]{4})?(?:\x20(?=[A-Z]{0,3}[0-9])[A-Z0-9]{1,4}+){2,8}+"
    r")(?![A-Za-z0-9@_%+]|[\x20().\-/]{1,3}[0-9]|[.\-/][A-Za-z])"
)
CONTEXT_CHARS = 60
RESULT = ("base_spans", "added_spans")
SPAN = "array<struct<kind:int,start:int,end:int>>"
HIT = "array<struct<v:string,s:int,e:int>>"


def located(text: Column, pattern: str) -> Column:
    """Matches with their places: the pieces between matches give the places, in one walk."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    rows = F.zip_with(
        gaps, values, lambda g, v: F.struct(F.length(g).alias("g"), F.length(v).alias("n"), v.alias("v"))
    )
    walk = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), F.array().cast(HIT).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x.g + F.coalesce(x.n, F.lit(0))).alias("at"),
            F.when(
                x.n.isNotNull(),
                F.array_append(acc.out, F.struct(x.v.alias("v"), (acc["at"] + x.g).alias("s"), (acc["at"] + x.g + x.n).alias("e"))),
            ).otherwise(acc.out).alias("out"),
        ),
        lambda acc: acc.out,
    )
    return F.when(F.size(values) > 0, walk).otherwise(F.array().cast(HIT))


def luhn(value: Column) -> Column:
    digits = F.regexp_replace(value, r"[\x20\-]", "")
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + part(i)) % 10 == 0


def base_hits(text: Column) -> dict[str, Column]:
    hits = {kind: located(text, pattern) for kind, pattern in PATTERNS.items()}
    hits["ip"] = F.filter(hits["ip"], lambda h: h.v.rlike(IP_VALID))
    hits["card"] = F.filter(hits["card"], lambda h: luhn(h.v))
    return hits


def mention(text: Column, kind: Column, hit: Column) -> Column:
    """A place with its value and the words around it, digits in them as 0."""
    def plain(words: Column) -> Column:
        return F.regexp_replace(F.lower(words), "[0-9]", "0")

    before = F.substr(text, F.greatest(hit.s - CONTEXT_CHARS, F.lit(0)) + 1, F.least(hit.s, F.lit(CONTEXT_CHARS)))
    after = F.substr(text, hit.e + 1, F.lit(CONTEXT_CHARS))
    return F.struct(
        kind.alias("kind"), hit.s.alias("start"), hit.e.alias("end"), F.lower(hit.v).alias("value"),
        plain(F.regexp_extract(before, r"(\S+\s+\S+)\W*$", 1)).alias("left"),
        plain(F.regexp_extract(before, r"(\S+)\W*$", 1)).alias("near"),
        plain(F.regexp_extract(after, r"^\W*(\S+)", 1)).alias("right"),
    )


def mentions(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base_spans`` and ``__mentions``: base spans (kind 0..3) and other tokens (kind -1)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = without(docs, *RESULT, "__mentions").withColumns({f"__{k}": h for k, h in base_hits(text).items()})

    def span(kind: int):
        return lambda h: F.struct(F.lit(kind).alias("kind"), h.s.alias("start"), h.e.alias("end"))

    def seen(kind: int):
        return lambda h: mention(text, F.lit(kind), h)

    spans = F.concat(*[F.transform(f"__{k}", span(i)) for i, k in enumerate(KINDS)])
    df = df.withColumns({"base_spans": spans.cast(SPAN), "__tokens": located(text, TOKEN), "__groups": located(text, GROUPED)})

    def apart(hits: str):
        return F.filter(hits, lambda t: ~F.exists("base_spans", lambda b: (b.start < t.e) & (t.s < b.end)))

    df = df.withColumns({"__tokens": apart("__tokens"), "__groups": apart("__groups")})
    alone = F.filter("__tokens", lambda t: ~F.exists("__groups", lambda g: (g.s < t.e) & (t.s < g.e)))
    free = F.concat("__groups", alone)
    places = [F.transform(f"__{k}", seen(i)) for i, k in enumerate(KINDS)]
    df = df.withColumn("__mentions", F.concat(*places, F.transform(free, seen(-1))))
    return df.drop("__tokens", "__groups", *[f"__{k}" for k in KINDS])


def learned(found: DataFrame, rounds: int, support: int, sure_pattern: float, sure_value: float) -> DataFrame:
    """Values outside the fixed patterns that the graph takes for personal data: (value, kind)."""
    edges = found.select(
        "value", "kind",
        F.explode(
            F.array(
                F.concat(F.lit("l "), "left"), F.concat(F.lit("b "), "near", F.lit(" _ "), "right"),
                F.concat(F.lit("n "), "near"), F.concat(F.lit("r "), "right"),
            )
        ).alias("pattern"),
        (F.length("left") > 0).alias("whole"), (F.length("near") > 0).alias("led"), (F.length("right") > 0).alias("followed"),
    ).filter(
        "(pattern LIKE 'l %' AND whole) OR (pattern LIKE 'n %' AND led) OR ((pattern LIKE 'b %' OR pattern LIKE 'r %') AND followed)"
    )
    graph = stage(edges.groupBy("pattern", "value").agg(F.max("kind").alias("seed")), "graph")
    known = graph.filter("seed >= 0").select("value", F.col("seed").alias("kind")).distinct()
    for _ in range(rounds):
        held = graph.join(known, "value", "left")
        per_kind = held.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"))
        total = per_kind.groupBy("pattern").agg(F.sum("n").alias("n_all"))
        sure = (
            per_kind.filter("kind IS NOT NULL").join(total, "pattern")
            .withColumn("sure", F.col("n") / F.col("n_all"))
            .filter((F.col("n") >= support) & (F.col("sure") >= sure_pattern))
            .select("pattern", "kind", F.least("sure", F.lit(0.99)).alias("sure"))
        )
        unseen = graph.join(known.select("value"), "value", "left_anti").join(sure, "pattern")
        score = 1 - F.exp(F.sum(F.log1p(-F.col("sure"))))
        # A longer pattern holds a one-word one: they are not two witnesses.
        short = F.substring("pattern", 1, 1).isin("n", "r").alias("short")
        fresh = unseen.groupBy("value", "kind", short).agg(score.alias("score")).filter(F.col("score") >= sure_value)
        best = fresh.groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
        best = stage(best, "learned")
        if best.isEmpty():
            break
        known = stage(known.unionByName(best), "known")
    else:
        raise RuntimeError("values were still being learned in the last round; raise rounds")
    seeds = graph.filter("seed >= 0").select("value").distinct()
    return known.join(seeds, "value", "left_anti")


def personal_data(
    docs: DataFrame, rounds: int = 100, support: int = 5, sure_pattern: float = 0.8, sure_value: float = 0.9
) -> DataFrame:
    """doc_id, row key, base_spans and added_spans (arrays of kind index, start, end) of every row of ``docs``."""
    keyed = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("__row"))
    spotted = stage(mentions(keyed).drop("text"), "mentions")
    found = spotted.select("__row", F.inline("__mentions")).distinct()
    values = learned(found, rounds, support, sure_pattern, sure_value).withColumnRenamed("kind", "learned")
    added = found.filter("kind < 0").join(values, "value").groupBy("__row").agg(
        F.sort_array(F.collect_set(F.struct(F.col("learned").alias("kind"), "start", "end"))).cast(SPAN).alias("added_spans")
    )
    out = spotted.drop("__mentions").join(added, "__row", "left")
    return out.withColumn("added_spans", F.coalesce("added_spans", F.array().cast(SPAN)))


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each span of the text as <kind>, and n_chars, where there is one, of the new text."""
    spans = personal_data(docs, **options).filter("size(base_spans) + size(added_spans) > 0")
    spans = spans.drop("doc_id").dropDuplicates(["__row"])
    met = without(docs, *RESULT).withColumn("__row", row_key(F.col("doc_id"), F.col("text"))).join(spans, "__row", "left")
    out = met.withColumn("text", F.when(F.col("base_spans").isNull(), F.col("text")).otherwise(redacted()))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("base_spans").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c in out.columns])


def written(spans: Column) -> Column:
    """kind:start:end by kind and start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ","
    )


def redacted() -> Column:
    """The text with each span, or run of overlapping spans, as <kind> of its first one."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    spans = F.sort_array(
        F.transform(F.concat("base_spans", "added_spans"), lambda s: F.struct(s.start.alias("s"), s.end.alias("e"), s.kind.alias("k")))
    )
    text = F.col("text")
    walk = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x.e).alias("at"),
            F.when(x.s >= acc["at"], F.concat(acc.out, F.substr(text, acc["at"] + 1, x.s - acc["at"]), F.get(names, x.k)))
            .otherwise(acc.out).alias("out"),
        ),
        lambda acc: F.concat(acc.out, F.substr(text, acc["at"] + 1)),
    )
    return walk
