"""Quality rules whose cutoffs are chosen on labelled documents under a bound on false rejections.

A rule is a measure of a text (symbols per word, share of repeated words, ...) with a fixed list of
cutoffs; step i of all lists together is one joint rule, which rejects a text above any of its cutoffs. Steps
go from lenient to strict. In each stratum (language) the labelled good documents are the holdout: they neither
define the measures nor the lists. A step is certified if the exact binomial (Clopper-Pearson) upper bound on
its false-rejection rate is at most ``risk``. Steps are tested in their fixed order and testing stops at the
first one that fails, which needs no further correction; the level is divided by the strata (Bonferroni). So
with probability ``1 - delta``, in no stratum more than ``risk`` of good documents are rejected, whatever the
number of rules. A stratum with too few labels (with four strata, fewer than 217 without a rejection) rejects
nothing by the method.

Only SQL functions are used. Measures are rows of their own text: no shuffle. They are stored once, the
labels meet the narrow measures, and the certified cutoffs are one row per stratum.

Defined results: null and empty texts have no words (base_failed); a null language is the stratum ''; a
document labelled more than once is good if all its labels are; labels without quality or document count
for nothing; repeated rows get equal results; input columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeimpact.llm.common import SPACE, split_words, stage, without

#: Cutoffs of each rule, one for each step from lenient to strict; a text above the cutoff is rejected.
CUTOFFS = {
    "symbols": [3.0, 2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02],
    "marks": [3.0, 2.0, 1.5, 1.0, 0.8, 0.5, 0.3, 0.2, 0.1],
    "repeats": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "same_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "capitals": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
}
STEPS = len(CUTOFFS["symbols"])
RISK, DELTA = 0.02, 0.05
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULT = (*BASE, "base_failed", "failed_rules", "kept")


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts and the measures of the rules, each from the row's own text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = without(docs, *RESULT, *(f"m_{r}" for r in CUTOFFS)).withColumn("__ws", split_words(text, SPACE))
    n = F.size("__ws")
    tri = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get("__ws", i), F.get("__ws", i + 1), F.get("__ws", i + 2)).alias("h"), i.alias("p")),
    )
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    df = df.withColumn("__tri", F.sort_array(F.when(n >= 3, tri).otherwise(none)))
    # Equal windows stand side by side after the sort.
    twice = F.filter(
        "__tri", lambda x, i: (x.h == F.get("__tri", i - 1).h) | (x.h == F.get("__tri", i + 1).h)
    )
    df = df.withColumn("__at", F.sort_array(F.transform(twice, lambda x: x.p)))
    covered = F.aggregate(
        "__at",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc.n + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc.n,
    )
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) > 0)
    df = df.withColumns({"__lines": lines, "__chars": F.length(F.array_join("__ws", ""))})
    words = F.greatest(n, F.lit(1)).cast("double")
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")
    same = (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")
    df = df.withColumns(
        {
            "n_words": n.cast("long"), "word_chars": F.col("__chars").cast("long"), "n_symbols": symbols,
            "n_dup_lines": same, "n_repeat_words": covered,
        }
    )
    df = df.withColumns(
        {
            "m_symbols": F.col("n_symbols") / words,
            "m_marks": F.regexp_count(text, F.lit("[!?]")) / words,
            "m_repeats": F.col("n_repeat_words") / words,
            "m_same_lines": F.col("n_dup_lines") / F.greatest(F.size("__lines"), F.lit(1)),
            "m_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")) / F.greatest(F.col("__chars"), F.lit(1)),
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.drop("__ws", "__tri", "__at", "__lines", "__chars").withColumn("base_failed", failed)


def log_factorial(n: Column) -> Column:
    """ln(n!): exact factorials up to 20, beyond them Stirling's series, whose error is below 1e-12."""
    x = n.cast("double")
    series = (
        (x + 0.5) * F.log(x) - x + 0.9189385332046727
        + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    )
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), for k below n * p (1 above it: no bound can hold there).

    The terms fall from k downwards; those left out after 40 standard deviations are below any double.
    """
    top = (
        log_factorial(n) - log_factorial(k) - log_factorial(n - k)
        + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    )
    steps = F.least(k, (F.sqrt(n * p) * 40 + 100).cast("long"))
    ratio = (1 - p) / p
    total = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0).cast("long"), steps - 1)).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda acc, i: F.struct(
            (acc.term * (k - i) * ratio / (n - k + i + 1)).alias("term"),
            (acc["sum"] + acc.term * (k - i) * ratio / (n - k + i + 1)).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(top) * total)


def above(step: int) -> dict[str, Column]:
    """Of each rule, whether a text's measure is above the cutoff of a step."""
    return {r: F.col(f"m_{r}") > cuts[step] for r, cuts in CUTOFFS.items()}


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Certified steps: (stratum, step, n_good, n_rejected, tail), the strictest of each stratum."""
    good = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    )
    held = measured.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), *[f"m_{r}" for r in CUTOFFS]
    ).join(good, "doc_id", "left_semi")
    # One narrow pass: per stratum, how many good documents each step would reject.
    any_of = lambda step: F.array_contains(F.array(*above(step).values()), True)
    counts = held.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_good"), *[F.count_if(any_of(i)).alias(f"k_{i}") for i in range(STEPS)]
    )
    each = [F.struct(F.lit(i).alias("step"), F.col(f"k_{i}").alias("n_rejected")) for i in range(STEPS)]
    # One row per stratum is counted; in one select with inline() it would be one per step.
    counts = counts.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy()))
    tests = counts.select("stratum", "n_good", "strata", F.inline(F.array(*each)))
    tests = tests.withColumn("tail", binomial_tail(F.col("n_good"), F.col("n_rejected"), risk))
    passed = (F.col("tail") <= delta / F.col("strata")).cast("int")
    order = Window.partitionBy("stratum").orderBy("step")
    certified = tests.withColumn("passed", F.min(passed).over(order)).filter("passed = 1")
    last = F.max(F.struct("step", "n_good", "n_rejected", "tail"))
    return certified.groupBy("stratum").agg(last.alias("x")).select("stratum", "x.*")


def judge(measured: DataFrame, certified: DataFrame) -> DataFrame:
    """Adds failed_rules and kept: base rules passed and no measure above the cutoffs of its stratum's certified step."""
    steps = certified.select(F.col("stratum").alias("__stratum"), F.col("step").alias("__step"))
    df = measured.withColumn("__stratum", F.coalesce("lang", F.lit(""))).join(steps, "__stratum", "left")

    def over(rule: str) -> Column:
        cuts = F.array(*[F.lit(c) for c in CUTOFFS[rule]])
        return F.col(f"m_{rule}") > F.get(cuts, F.col("__step"))

    failed = F.array_compact(F.array(*[F.when(over(r), F.lit(r)) for r in CUTOFFS]))
    df = df.withColumn("failed_rules", failed)
    df = df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return df.drop("__stratum", "__step")


def quality_of(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Rows of ``measures()`` with failed_rules and kept; they are stored once and read twice."""
    measured = stage(measured, "measures")
    return judge(measured, calibrate(measured, labels, risk, delta))


def quality(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``docs`` with base counts, measures, failed_rules and kept."""
    return quality_of(measures(docs), labels, risk, delta)
