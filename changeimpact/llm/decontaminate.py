"""Benchmark decontamination: windows of benchmark words looked up in training texts.

The distinct benchmark windows form a hash set. Its size is measured; within ``broadcast_bytes`` it is
broadcast, and the texts are scanned where they lie: every word starts one row (position, word array),
the hash of its window probes the set, and a hit counts only if the words themselves are equal. Beyond
that size hashes are shuffled and joined, and a text's candidates are checked on its words. Only hits leave the scan.

Defined results: null and word-free texts have no words and no hits; null item texts have no windows; a
null item_id counts as one item written as an empty string; repeated rows get equal results; input columns
that bear the name of a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeimpact.llm.common import ascii_lower, row_key, split_words, without

#: Fixed values of the contract.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13

RESULT = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")


def benchmark_words(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def window_hash(words: Column, start: Column, length: int) -> Column:
    """Hash of the words from ``start``; words beyond the end are skipped and fail the later check of the words."""
    return F.xxhash64(*[F.get(words, start + i) for i in range(length)])


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: (length, hash, phrase, items). An item shorter than a window is one window."""
    split = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), benchmark_words(F.col("text")).alias("ws")
    ).filter(F.size("ws") > 0)
    starts = split.select(
        "item", "ws", F.explode(F.sequence(F.lit(0), F.greatest(F.size("ws") - window, F.lit(0)))).alias("i")
    )
    phrases = starts.select("item", F.slice("ws", F.col("i") + 1, window).alias("part")).select(
        "item", F.size("part").alias("length"), F.array_join("part", " ").alias("phrase"), "part"
    )
    return phrases.groupBy("phrase", "length").agg(F.collect_set("item").alias("items"), F.first("part").alias("part")).select(
        "length", window_hash(F.col("part"), F.lit(0), window).alias("hash"), "phrase", "items"
    )


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Occurrences of benchmark windows: (key, start, end, items), word positions, end exclusive."""
    windows = benchmark_windows(items, window)
    told = windows.agg(
        F.collect_set("length").alias("lengths"),  # at most `window` numbers
        F.sum(F.octet_length("phrase") + 100 + 24 * F.size("items")).alias("bytes"),
    ).first()
    lengths, size = sorted(told.lengths), told.bytes or 0
    split = docs.select(
        row_key(F.col("doc_id"), F.col("text")).alias("key"), benchmark_words(F.col("text")).alias("ws")
    ).filter(F.size("ws") > 0)
    starts = split.select("key", "ws", F.posexplode("ws").alias("i", "word"))
    if len(lengths) <= 1:
        probe = starts.select("key", "ws", "i", window_hash(F.col("ws"), F.col("i"), (lengths or [window])[0]).alias("hash"))
    else:
        each = F.array(*[window_hash(F.col("ws"), F.col("i"), n) for n in lengths])
        probe = starts.select("key", "ws", "i", F.explode(each).alias("hash"))
    equal = F.array_join(F.slice(F.col("ws"), F.col("i") + 1, F.col("length")), " ") == F.col("phrase")
    if size <= broadcast_bytes:
        small = F.broadcast(windows)
        met = probe.join(small, (probe["hash"] == small["hash"]) & equal)
    else:
        # Too large a set to broadcast: hashes alone are shuffled, and a text's candidates meet its words once.
        near = probe.select("key", "i", "hash").join(windows, "hash").groupBy("key").agg(
            F.collect_list(F.struct("i", "length", "phrase", "items")).alias("near")
        )
        met = split.dropDuplicates(["key"]).join(near, "key").select("key", "ws", F.inline("near")).filter(equal)
    return met.select("key", F.col("i").alias("start"), (F.col("i") + F.col("length")).alias("end"), "items").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, **options) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside a window), n_items, items, spans and contaminated.

    ``spans`` are the merged word ranges that were hit; contaminated means ``n_hit * share >= n_words``
    with at least one hit.
    """
    one = Window.partitionBy("key").orderBy("start", "end")
    before = F.max("end").over(one.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        hits(docs, items, window, **options)
        .withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("start")).cast("int"))
        .withColumn("island", F.sum("new").over(one))
    )
    spans = islands.groupBy("key", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("its")
    )
    per_key = spans.groupBy("key").agg(
        F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("its")))).alias("items"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
    )
    kept = without(docs, *RESULT).withColumns(
        {
            "__key": row_key(F.col("doc_id"), F.col("text")),
            "n_words": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        }
    )
    joined = kept.join(per_key.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")
    none = F.array().cast("array<string>")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.withColumns(
        {
            "n_hit": n_hit,
            "items": F.coalesce("items", none),
            "n_items": F.coalesce(F.size("items"), F.lit(0)).cast("long"),
            "spans": F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")),
            "contaminated": (n_hit > 0) & (n_hit * share >= F.col("n_words")),
        }
    )


def remove_spans(judged: DataFrame) -> DataFrame:
    """The texts of ``contamination()`` without the hit words and what follows each up to the next word."""
    head = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    units = F.regexp_extract_all("text", F.lit(f"{WORD}[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"), 0)
    left = F.filter(units, lambda u, i: ~F.exists("spans", lambda s: (s.start <= i) & (i < s.end)))
    return judged.withColumn("text", F.when(F.size("spans") == 0, F.col("text")).otherwise(F.concat(head, F.array_join(left, ""))))


def remove_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns and texts."""
    judged = contamination(docs.select("doc_id", "text"), items, **options)
    dirty = judged.filter("contaminated").select(row_key(F.col("doc_id"), F.col("text")).alias("__key")).distinct()
    return docs.withColumn("__key", row_key(F.col("doc_id"), F.col("text"))).join(dirty, "__key", "left_anti").drop("__key")
