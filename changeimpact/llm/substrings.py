"""Exact repeated passages across documents, by level-wise doubling of repeated windows.

A passage of ``length`` words (50) is removed where its word sequence also starts in a document with a
smaller doc_id. Windows grow in levels of 13, 26 and 50 words; only those repeated in two documents at one
level are extended to twice the length, until none is left or the length asked for is reached.

Level 1. Of the 38 windows of 13 words inside a passage, the one with the smallest hash is its anchor. The
choice depends on the passage's words alone, so equal passages share it, and only anchors (about one in 20
words) are counted instead of every window. Anchors of equal hash that stand in equal surroundings (all the
words of the passages they are the anchor of) form a context: in it, every document but the smallest has all
those passages in the smallest one, and loses them without further work. A group of thousands of copies thus
costs one row per anchor.
Level 2. Where an anchor has several contexts, the smallest document of each stands for it, and the anchor is
extended to 26 words, to the right and to the left. Level 3. Repeated extensions give the passages of 50 words
around them, which are compared by hash with the smallest document that has them.

Equality is that of 64-bit hashes of word sequences. Texts are shuffled by id twice: to meet the anchors to extend,
and the words to remove. The words of a document, never those of a group, are together in one task.

Defined results: null texts have no words; a null doc_id is larger than any other; rows that repeat a doc_id
are one document and don't repeat each other; shorter texts lose nothing; input columns named like a result
column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeimpact.llm.common import ship, stage, without

LENGTH, START = 50, 13
RESULT = ("n_words", "n_removed", "removed", "kept")
LAST = 2**63 - 1  # stands for a null doc_id
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses
INVERSE = pow(BASE, -1, 2**64)


class Hashes:
    """Hashes of any word window of one text, from running sums of word hashes times powers."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        self.back = powers(INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * powers(BASE, n), out=self.sums[1:])
        self.n = n

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        x = (self.sums[start + length] - self.sums[start]) * self.back[start]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 4096), base, np.uint64)
        kept[0] = 1
        kept = _powers[base] = np.cumprod(kept, dtype=np.uint64)
    return kept[:n]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # on bytes: the six white-space characters of ASCII


def anchored(hashes: Hashes, start: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places, and the first and last passage that each is the anchor of; the windows' hashes."""
    grams = hashes.of(np.arange(hashes.n - start + 1), start)
    around = np.lib.stride_tricks.sliding_window_view(grams, length - start + 1)
    best = np.concatenate([around[i : i + 20_000].argmin(axis=1) for i in range(0, len(around), 20_000)]) + np.arange(len(around))
    first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    return best[first], first, np.r_[first[1:], len(best)] - 1, grams


def anchors(docs: DataFrame, length: int, start: int) -> DataFrame:
    """Level 1 of ``docs(d, t, text)``: (gram, context, d, t, p, lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(7)]
            ids, marks, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).cast(pa.binary())
            for i in range(batch.num_rows):
                words = words_of(texts[i].as_py())
                if len(words) < length:
                    continue
                hashes = Hashes(words)
                p, lo, hi, grams = anchored(hashes, start, length)
                context = hashes.of(lo, hi - lo + length) ^ ((p - lo) * 1_000_003 + (hi - lo) * 7919)
                for part, x in zip(parts, (grams[p], context, np.full(len(p), ids[i]), np.full(len(p), marks[i]), p, lo, hi)):
                    part.append(x)
            kinds = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).astype(k) if x else np.empty(0, k)) for x, k in zip(parts, kinds)],
                names=["gram", "context", "d", "t", "p", "lo", "hi"],
            )

    return docs.mapInArrow(run, "gram long, context long, d long, t long, p int, lo int, hi int")


def extended(found: DataFrame, length: int, start: int) -> DataFrame:
    """Levels 2 and 3 of ``found(d, t, text, at)``, ``at`` being p, lo, hi of each anchor in turn:
    (d, t, p, lo, right, left, passages); right and left are null where the text ends before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for d, t, text, at in zip(*(batch.column(i).to_pylist() for i in range(4))):
                hashes = Hashes(words_of(text.encode("utf-8")))
                for p, lo, hi in np.array(at, np.int64).reshape(-1, 3):
                    right = int(hashes.of(np.array([p]), 2 * start)[0]) if p + 2 * start <= hashes.n else None
                    left = int(hashes.of(np.array([p - start]), 2 * start)[0]) if p >= start else None
                    rows.append((d, t, int(p), int(lo), right, left, hashes.of(np.arange(lo, hi + 1), length)))
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["d", "t", "p", "lo", "right", "left", "passages"]
            )

    return found.mapInArrow(run, "d long, t long, p int, lo int, right long, left long, passages array<long>")


def repeats(docs: DataFrame, length: int, start: int) -> DataFrame:
    """Passages to remove from ``docs(d, t, text)``: (d, t, lo, hi) as words, end exclusive."""
    found = stage(anchors(docs, length, start), "anchors")
    groups = found.groupBy("gram").agg(
        F.min("d").alias("d0"), F.max("d").alias("d1"), F.min("context").alias("c0"), F.max("context").alias("c1")
    )
    # Stored, so that both sides of the joins below are shuffled anew and a hot gram is split over tasks.
    groups = stage(groups.filter("d0 <> d1").select("gram", (F.col("c0") != F.col("c1")).alias("several")), "grams")
    again = stage(found.join(groups, "gram"), "repeated")
    firsts = stage(again.groupBy("gram", "context").agg(F.min("d").alias("first")), "firsts")
    known = again.join(firsts, ["gram", "context"])
    same = known.filter("d > first").select("d", "t", "lo", (F.col("hi") + length).alias("hi"))

    stand = known.filter("d = first AND several").groupBy("d", "t").agg(
        F.flatten(F.collect_set(F.array("p", "lo", "hi"))).alias("at")
    )
    wider = stage(extended(docs.join(stand, ["d", "t"]).select("d", "t", "text", "at"), length, start), "extended")
    sides = wider.select(
        "d", "t", "p", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("right").alias("h")), F.struct(F.lit(1).alias("side"), F.col("left").alias("h"))))
    ).filter("h IS NOT NULL")
    two = sides.groupBy("side", "h").agg(F.min("d").alias("d0"), F.max("d").alias("d1")).filter("d0 <> d1").select("side", "h")
    alive = sides.join(two, ["side", "h"], "left_semi").groupBy("d", "t", "p").agg(
        F.max(F.col("side") == 0).alias("by_right"), F.max(F.col("side") == 1).alias("by_left")
    )
    passages = (
        wider.join(alive, ["d", "t", "p"])
        .select("d", "t", "p", "lo", "by_right", "by_left", F.posexplode("passages").alias("i", "h"))
        .withColumn("s", F.col("lo") + F.col("i"))
        # The extension that survived lies inside the passage.
        .filter((F.col("by_right") & (F.col("s") + length >= F.col("p") + 2 * start)) | (F.col("by_left") & (F.col("s") <= F.col("p") - start)))
        .select("d", "t", "s", "h")
    )
    passages = stage(passages, "passages")
    smallest = passages.groupBy("h").agg(F.min("d").alias("first"))
    mixed = passages.join(smallest, "h").filter("d > first").select("d", "t", F.col("s").alias("lo"), (F.col("s") + length).alias("hi"))
    return same.unionByName(mixed)


def remove_repeats(docs: DataFrame, length: int = LENGTH, start: int = START) -> DataFrame:
    """``docs`` with n_words, n_removed, removed (word ranges from, to, ... ) and kept (words left, one space between)."""
    if not start < length <= 4 * start:
        raise ValueError("three levels reach at most four times the first length")
    ship(docs.sparkSession)
    ids = {"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "t": F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8"))}
    narrow = docs.select(*[c.alias(n) for n, c in ids.items()], "text").filter("text IS NOT NULL")
    gone = repeats(narrow, length, start)
    gone = gone.groupBy("d", "t").agg(F.flatten(F.sort_array(F.collect_set(F.array("lo", "hi")))).alias("removed"))
    base = without(docs, *RESULT, "d", "t") if {"d", "t"} & {c.lower() for c in docs.columns} else without(docs, *RESULT)
    met = base.withColumns(ids).join(gone, ["d", "t"], "left").drop("d", "t")
    return applied(met)


def applied(met: DataFrame) -> DataFrame:
    """Adds n_words, n_removed and kept; ``removed`` holds ranges in order, which may overlap."""
    at, gone = met.columns.index("text"), met.columns.index("removed")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in met.schema)}, n_words long, n_removed long, kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, ranges in zip(batch.column(at).cast(pa.binary()), batch.column(gone)):
                words = words_of(text.as_py())
                counts.append(len(words))
                left, end = [], 0
                cuts = ranges.as_py() or []
                for lo, hi in zip(cuts[::2], cuts[1::2]):
                    left.extend(words[end:lo])
                    end = max(end, hi)
                left.extend(words[end:])
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8"))
            added = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "n_words", "n_removed", "kept"])

    return met.mapInArrow(run, schema)
