"""What the training-data operators share: word rules, row keys, stored stages, components."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contract: white space between words, and what is not a benchmark word.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. The plain ``lower`` is the same on ASCII texts, and faster."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, separators: str) -> Column:
    """Array of the pieces between separators, without empty ones; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def row_key(*columns: Column) -> Column:
    """One key for the rows whose given columns are all equal, nulls included.

    Operators that judge a row by its own text join their result back on this key, so repeated ids
    with unlike texts are told apart and repeated rows get equal results.
    """
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.to_json(F.array(*parts)), 256)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, one of this machine in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="changeimpact-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: later plans start from the files."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.cache
def _shipped(application: str) -> str:
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="changeimpact-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    return str(path)


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once a session, for the functions that run in Arrow batches."""
    spark.sparkContext.addPyFile(_shipped(spark.sparkContext.applicationId))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, whatever their case: an operator's own columns replace them."""
    lower = {n.lower() for n in names}
    return df.drop(*[F.col(f"`{c}`") for c in df.columns if c.lower() in lower])


def grouped(df: DataFrame, keys: list[str], judge: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``judge`` of each group of rows with equal keys, for many groups: those of a task lie one after the other in its batches.

    A group is held whole by its task, so callers bound it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).dictionary_encode().indices.to_numpy() for k in keys]
            ends = np.zeros(batch.num_rows, bool)
            for own in columns:
                ends[1:] |= own[1:] != own[:-1]
            starts = [0, *np.flatnonzero(ends).tolist()]
            for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
                part = batch.slice(start, stop - start)
                first = tuple(part.column(part.schema.get_field_index(k))[0].as_py() for k in keys)
                if held and first != last:
                    yield judge(pa.Table.from_batches(held))
                    held = []
                held.append(part)
                last = first
        if held:
            yield judge(pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as (node, component): the smallest node that is reachable.

    Each round hooks every node's label to the smallest label next to it, then jumps to the label's own
    label; the number of rounds grows with the logarithm of the longest path. Labels are stored each
    round, and a round moves one row per edge end, combined before the shuffle.
    """
    both = edges.select("a", "b").filter("a <> b").distinct()
    both = stage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(rounds):
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        hooked = labels.join(near, "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("hooked")
        )
        up = labels.select(F.col("node").alias("hooked"), F.col("component").alias("up"))
        new = stage(
            hooked.join(up, "hooked", "left").select("node", "old", F.least("hooked", "up").alias("component")), "labels"
        )
        labels = new.select("node", "component")
        if new.filter("old <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle; raise rounds")
