"""Near-duplicate vectors by a subspace pigeonhole join: exact, no index to train.

Unit vectors u, v of cosine c are at squared distance 2 - 2c. A rotation keeps distances, and the squared distance is
the sum of those inside disjoint blocks of dimensions. So a pair within the squared distance asked for is, in one
block at least, within that block's share of it, in proportion to its dimensions.

1. Equal vectors of one label become one row with a count (map-side combine), so copies never meet each other.
2. Vectors are rotated (random signs and Walsh-Hadamard steps, padded with zeros to a power of two; additions only,
   so a vector has the same rotated coordinates to the last bit wherever they are computed) and split into blocks.
3. Each block is range-joined: a vector lives in a cell of the first ``AXES`` coordinates of the block, cells being two
   radii wide, and is a guest of the lower cells its radius reaches. Every pair within the radius meets in exactly one cell.
4. A cell of more than ``TILE_BYTES`` of vectors is cut into chunks by a hash; each pair of chunks is a tile of bounded size, so
   a hot cell is spread over as many tasks as it needs. Inside a tile pairs beyond the block's share go first;
   a pair that an earlier block has too is left to that block, so the union needs no pairs in a shuffle; what remains
   is verified by the cosine of the given vectors in double precision.
5. A tile gives, for each of its vectors, the number of links and one linked vector that stands for its part of the
   tile: rows by vector, never by pair. Counts are added up, the edges go to connected components.

All pairs that lie in one cell are compared, so a dense group of n different vectors costs n^2 comparisons spread
over tiles (their links must be counted), and on data without structure cells prune little. Nothing is capped or missed.

Defined results: a vector that is null, empty, zero or has null or non-finite entries, a null label and a null vec_id
link with nothing: no links, component_id = vec_id, kept. Vectors of different lengths are never linked. Rows that repeat
a vec_id are vectors of their own with the links of their own, in one component. Columns other than ``vec_id``,
``embedding`` and ``label`` are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeimpact.llm.common import components, grouped, ship, stage

BLOCK, AXES, SEED = 16, 2, 11
#: Bytes of the vectors of a chunk: a task holds two chunks, given and rotated.
TILE_BYTES = 2 << 20
#: Room for rounding: in squared distances, and relative to a radius.
ROUNDING = 1e-9
STRIP = 512


def summed(squares: np.ndarray) -> np.ndarray:
    """Row sums in a fixed order of additions."""
    total = np.zeros(len(squares))
    for k in range(squares.shape[1]):
        total += squares[:, k]
    return total


def rotated(vectors: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Unit vectors, rotated. Elementwise, so a row's result does not depend on the rows beside it."""
    biggest = np.abs(vectors).max(axis=1, keepdims=True)
    x = vectors / biggest  # no overflow in the squares
    x = x / np.sqrt(summed(x * x))[:, None]
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.concatenate([x, np.zeros((len(x), width - x.shape[1]))], axis=1)
    draw = np.random.default_rng(seed)
    for _ in range(2):
        x = x * draw.choice([-1.0, 1.0], width)
        step = 1
        while step < width:
            y = x.reshape(len(x), -1, 2, step)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), width)
            step *= 2
        x = x / np.sqrt(width)
    return x


def blocks(width: int, block: int) -> list[slice]:
    return [slice(i, min(i + block, width)) for i in range(0, width, block)]


def share(width: int, part: slice, distance2: float) -> float:
    """A block's part of the squared distance, in proportion to its dimensions."""
    return distance2 * (part.stop - part.start) / width + ROUNDING


def within(x: np.ndarray, y: np.ndarray, part: slice) -> np.ndarray:
    """Squared distances of rows in one block, the same to the last bit for the same two vectors."""
    gap = x[:, part] - y[:, part]
    return summed(gap * gap)


def as_matrix(cells: pa.Array) -> np.ndarray:
    """Rows of doubles from a binary column whose values have one length."""
    values = cells.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def placed(vectors: DataFrame, distance2: float, block: int, tile_bytes: int) -> DataFrame:
    """A row for each block and each cell that a vector lives in or is a guest of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(4).to_numpy()
            runs = ((n, np.flatnonzero(lengths == n)) for n in np.unique(lengths))
            for length, rows in ((n, r[i : i + step]) for n, r in runs for step in [max(1, tile_bytes // (8 * int(n)))] for i in range(0, len(r), step)):
                flat = batch.column(3).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                raw = flat.reshape(len(rows), length)
                turned = rotated(raw)
                width = turned.shape[1]
                for b, part in enumerate(blocks(width, block)):
                    radius = np.sqrt(share(width, part, distance2)) * (1 + ROUNDING)
                    axes = min(AXES, part.stop - part.start)
                    near = turned[:, part.start : part.start + axes]
                    home = np.floor(near / (2 * radius)).astype(np.int64)
                    for step in itertools.product((-1, 0, 1), repeat=axes):
                        if step > (0,) * axes:
                            continue
                        cell = home + np.array(step)
                        gap = np.maximum(0, np.maximum(cell * 2 * radius - near, near - (cell + 1) * 2 * radius))
                        here = summed(gap * gap) <= radius * radius
                        kept = np.flatnonzero(here)
                        own = batch.take(pa.array(rows[kept]))
                        spot = np.zeros((len(kept), AXES), np.int64)
                        spot[:, :axes] = cell[kept]
                        bytes_of = raw[kept].tobytes()
                        size = int(length) * 8
                        yield pa.RecordBatch.from_arrays(
                            [own.column(5), own.column(4), pa.array(np.full(len(kept), b, np.int32)),
                             *[pa.array(spot[:, k].astype(np.int32)) for k in range(AXES)],
                             pa.array(np.full(len(kept), any(step))), own.column(0), own.column(1), own.column(2),
                             pa.array([bytes_of[i : i + size] for i in range(0, len(bytes_of), size)], pa.binary())],
                            names=["label", "length", "block", *[f"c{k}" for k in range(AXES)], "guest", "node", "twins", "key", "raw"],
                        )

    rows = vectors.select("node", "twins", "key", "embedding", F.size("embedding").alias("length"), "label")
    cells = ", ".join(f"c{k} int" for k in range(AXES))
    return rows.mapInArrow(
        run, f"label string, length int, block int, {cells}, guest boolean, node long, twins long, key binary, raw binary"
    )


class Tile:
    """Links found so far among the rows of a tile, and which rows they join."""

    def __init__(self, twins: np.ndarray):
        self.twins, self.links, self.root = twins, np.zeros(len(twins), np.int64), np.arange(len(twins))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.links, i, self.twins[j])
        np.add.at(self.links, j, self.twins[i])
        while len(i):
            i, j = self.root[i], self.root[j]
            low, high = np.minimum(i, j), np.maximum(i, j)
            apart = low != high
            i, j = low[apart], high[apart]
            np.minimum.at(self.root, j, i)
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def matched(raw: np.ndarray, guest: np.ndarray, chunk: np.ndarray, two: bool, b: int, block: int, distance2: float, at_least: float, tile: Tile) -> None:
    """Links of a tile: pairs of ``two`` chunks, or of one with itself, that this block is the first to hold."""
    turned = rotated(raw)
    width = turned.shape[1]
    parts = blocks(width, block)
    near = turned[:, parts[b]]
    size = (near * near).sum(axis=1)
    reach = share(width, parts[b], distance2)
    biggest = np.abs(raw).max(axis=1, keepdims=True)
    unit = raw / biggest
    norm = np.sqrt((unit * unit).sum(axis=1))
    order = np.arange(len(raw))
    for start in range(0, len(raw), STRIP):
        rows = order[start : start + STRIP]
        apart = size[rows, None] + size[None, :] - 2 * (near[rows] @ near.T)
        meet = (apart <= reach + 1e-6) & (order[None, :] > rows[:, None]) & ~(guest[rows, None] & guest[None, :])
        if two:
            meet &= chunk[rows, None] != chunk[None, :]
        i, j = np.nonzero(meet)
        for k in range(0, len(i), 1 << 16):
            x, y = rows[i[k : k + (1 << 16)]], j[k : k + (1 << 16)]
            found = within(turned[x], turned[y], parts[b]) <= reach
            for earlier in range(b):
                x, y = x[found], y[found]
                found = within(turned[x], turned[y], parts[earlier]) > share(width, parts[earlier], distance2)
            x, y = x[found], y[found]
            linked = np.einsum("ij,ij->i", unit[x], unit[y]) / (norm[x] * norm[y]) >= at_least
            tile.add(x[linked], y[linked])


def tiled(tiles: DataFrame, block: int, distance2: float, at_least: float) -> DataFrame:
    """(key, links, node, root) of every vector with links in a tile; the rows of a tile lie together, in order."""
    names = ["label", "length", "block", *[f"c{k}" for k in range(AXES)], "x", "y"]

    def judged(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        column = {n: rows.column(n).combine_chunks() if isinstance(rows.column(n), pa.ChunkedArray) else rows.column(n) for n in rows.column_names}
        tile = Tile(column["twins"].to_numpy())
        matched(
            as_matrix(column["raw"]), column["guest"].to_numpy(zero_copy_only=False), column["chunk"].to_numpy(),
            column["x"][0].as_py() != column["y"][0].as_py(), column["block"][0].as_py(), block, distance2, at_least, tile,
        )
        kept = np.flatnonzero(tile.links)
        node = column["node"].to_numpy()
        return pa.RecordBatch.from_arrays(
            [column["key"].take(pa.array(kept)), pa.array(tile.links[kept]), pa.array(node[kept]), pa.array(node[tile.root[kept]])],
            names=["key", "links", "node", "root"],
        )

    return grouped(tiles, names, judged, "key binary, links long, node long, root long")


def near_duplicates(vectors: DataFrame, at_least: float, block: int = BLOCK, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: vec_id, label, n_links, component_id, kept.

    Links vectors of one label whose cosine is ``at_least`` or more.
    """
    ship(vectors.sparkSession)
    distance2 = 2 - 2 * at_least
    values = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), values.alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    written = F.array_join(F.col("embedding").cast("array<string>"), ",")
    key = F.when(F.coalesce(usable, F.lit(False)), F.unhex(F.md5(F.concat_ws(":", F.col("label"), written))))
    rows = stage(rows.withColumn("key", key), "vectors")
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("twins"))
    classes = stage(classes, "classes")
    firsts = rows.join(classes, "key").filter("vec_id = node").dropDuplicates(["key"])
    homes = stage(placed(firsts, distance2, block, tile_bytes), "cells")
    cell = ["label", "length", "block", *[f"c{k}" for k in range(AXES)]]
    chunks = homes.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) * F.col("length") * 8 / tile_bytes).cast("int").alias("chunks"), F.min("guest").alias("idle"))
    placed_in = homes.join(chunks.filter("NOT idle"), cell)  # cells with guests alone have no pairs
    chunk = F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")
    partner = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    tiles = placed_in.withColumn("chunk", chunk).withColumn("partner", partner).select(
        *cell, "guest", "node", "twins", "key", "raw", "chunk",
        F.least("chunk", "partner").alias("x"), F.greatest("chunk", "partner").alias("y"),
    )
    found = stage(tiled(tiles, block, distance2, at_least), "found")
    counted = found.groupBy("key").agg(F.sum("links").alias("links"))
    edges = found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    owned = rows.select("vec_id", "label", "key").join(classes, "key", "left").join(counted, "key", "left")
    # One vec_id on several vectors joins their classes.
    several = rows.join(classes, "key").groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).filter("a <> most")
    shared = rows.join(classes, "key").join(several, "vec_id").select("a", F.col("node").alias("b")).filter("a <> b")
    labels = components(edges.unionByName(shared))
    whole = F.coalesce("component", "node", "vec_id")
    links = F.coalesce(F.col("twins") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    out = owned.join(labels, "node", "left").select(
        "vec_id", "label", links.cast("long").alias("n_links"), whole.alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
