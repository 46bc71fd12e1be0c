"""Shuffled shards by a two-pass external shuffle.

Pass 1 scatters rows over buckets by a seeded hash of the row; the number of buckets follows from the
measured bytes, so a bucket fits in a task's memory. Pass 2 puts each bucket in a fixed order, shuffles
it (the SQL function ``shuffle`` is a Fisher-Yates shuffle; it draws from one seeded stream per partition) and writes
it. Buckets are dealt to partitions, and ordered in them, by the data alone, so the order depends on the rows and the
seed and on nothing else: not on files, partitions read or cores. A row's place
in the whole order is its place in the bucket plus the rows of the buckets before it; dealt round over
the shards, counts differ by one at most and slots have no gaps. The running sum is over one row per bucket
(some six million at 100 TB), never over rows.

The shuffled buckets are written before anything reads them, so a lost executor cannot mix two orders.
Equal texts, even a third of all rows, are scattered by their ids. Rows that are equal in all columns are told apart by a
number: their keys are counted, the copies become one row with its count by a map-side combine, and the copies are dealt
out again from it, block by block.

Defined results: null texts have size 8 and checksum 0; null ids are ordinary rows; an empty table gives an
empty result; input columns named like a result column are replaced; all other columns must be comparable (no maps).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeimpact.llm.common import stage, without

SHARDS, SEED, BUCKET_BYTES = 24, 20_24, 16 << 20
BLOCK = 1 << 16  # copies of a row that are dealt out by one task
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def numbered(rows: DataFrame) -> DataFrame:
    """(row, key, number) of (row, key): equal rows get the numbers 0, 1, ... in place of each other.

    Keys of unlike rows may be equal; such rows are counted apart.
    """
    repeated = stage(rows.groupBy("key").count().filter("count > 1").select("key"), "repeated")
    single = rows.join(repeated, "key", "left_anti").select("row", "key", F.lit(0).cast("long").alias("number"))
    copies = rows.join(repeated, "key", "left_semi").groupBy("key", "row").count()
    blocks = copies.select("key", "row", "count", F.explode(F.expr(f"sequence(0, (count - 1) div {BLOCK})")).alias("block"))
    last = F.least(F.col("count") - 1, (F.col("block") + 1) * BLOCK - 1)
    dealt = blocks.repartition("key", "block").select(
        "row", "key", F.explode(F.sequence(F.col("block") * BLOCK, last)).alias("number")
    )
    return single.unionByName(dealt)


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard; rows keep all their columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = without(docs, *RESULT)
    own = sized.columns
    total = sized.agg(F.sum(F.octet_length(text) + 8).alias("b")).first().b or 0
    buckets = max(1, -(-total // bucket_bytes))
    sized = sized.withColumns(
        {"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(F.encode(text, "utf-8"))}
    )
    rows = sized.select(F.struct(*sized.columns).alias("row"), F.xxhash64(*[F.col(f"`{c}`") for c in own]).alias("key"))
    scattered = numbered(rows).withColumn("draw", F.xxhash64(F.lit(seed), "key", "number")).select(
        "row", "number", "draw", F.pmod(F.xxhash64("draw"), F.lit(buckets)).alias("bucket")
    )
    full = scattered.repartition(min(2 * buckets, 100_000), "bucket").groupBy("bucket").agg(
        F.sort_array(F.collect_list(F.struct("draw", "number", "row"))).alias("rows")
    )
    ordered = full.sortWithinPartitions("bucket")
    placed = ordered.select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("place", "x")).select(
        "bucket", "place", "x.row.*"
    )
    placed = stage(placed, "shuffled")
    before = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("place")
    return placed.join(before, "bucket").select(
        *[F.col(f"`{c}`") for c in own], "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod(rank, F.lit(shards)).cast("int").alias("shard"), F.floor(rank / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder per shard, rows in slot order within each file."""
    out = shuffled(docs, **options)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
