"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Each text gives its shingle-set size, a 128-bit digest of the set and a MinHash signature of 64
   coordinates (Arrow batches, one pass). Texts with equal sets are one class; only one of them goes on.
2. Every class is posted under each (coordinate, value) pair. Sets of similarity s agree in 64 * s
   coordinates on average; pairs with ``match`` or more agreements are retained.
3. Prefix: two signatures that agree ``match`` times share one of the ``64 - match + 1`` rarest
   coordinates of each. Pairs seen once can't collide, so only the rarest shared ones are posted, with
   frequencies counted over all classes. Skip: long lists are those left out; what collides in a short
   list is compared on the whole signature instead of being merged from the long ones.
4. In each list every class first meets one class of the list, drawn by a hash; what is retained is confirmed
   on the full shingle sets of the texts, and linked classes get a common label. This is done three times, the
   later times with a draw of each list's own and only between classes that bear different labels. So a list of
   thousands of copies gives a row for each copy, and for the few not linked yet some more, instead of one
   for each pair.
5. Lists that still hold classes with different labels are cut into chunks by a hash; each pair of chunks is a tile of
   bounded size. In a tile signatures are compared side by side, each pair in the first list only that both post, so
   no pair that could join two groups goes unseen and none is a row: a class comes out with its partners in the tile.
   Shingle sets are sent once a tile, and pairs of classes that the tile has joined already are left out.
6. Connected components of the links give each document its class.

MinHash is a random test: a pair exactly at the similarity asked for is missed with a chance of about
2 in 100,000 (64 coordinates, 38 agreements); more similar ones with less.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; rows that
repeat a doc_id are one document (linked by it); rows with a null doc_id are linked with nothing and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeimpact.llm.common import components, grouped, ship, stage

COORDINATES, MATCH, DRAWS, SEED = 64, 38, 3, 7
#: Classes and shingles of a chunk of a list; a task holds two chunks.
CHUNK, CHUNK_SHINGLES = 256, 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, an empty one none."""
    words = (text or b"").lower().split()  # on bytes: A-Z, and the six white-space characters of ASCII
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(shingle, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        out = mixed(out + h[i : i + len(out)] + np.uint64(i))
    return np.unique(out)


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 2048):
        low = np.minimum(low, (a[:, None] * found[None, i : i + 2048] + b[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def fingerprints(docs: DataFrame, shingle: int, coordinates: int = COORDINATES, seed: int = SEED) -> DataFrame:
    """(doc_id, n, hi, lo, sig) of every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(seed)
        a = draw.integers(0, 2**63, coordinates, np.uint64) * np.uint64(2) + np.uint64(1)
        b = draw.integers(0, 2**63, coordinates, np.uint64)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            n, hi, lo, sig = [], [], [], []
            for text in texts:
                found = shingle_set(text.as_py(), shingle)
                digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
                n.append(len(found))
                hi.append(int(digest[0]))
                lo.append(int(digest[1]))
                sig.append(signature(found, a, b) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.list_(pa.int32()))],
                names=["doc_id", "n", "hi", "lo", "sig"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, hi long, lo long, sig array<int>")


def posted(reps: DataFrame, coordinates: int, match: int) -> DataFrame:
    """Posting rows (k, v, node, n): for each class the rarest coordinates that others share, within the prefix."""
    posts = reps.select("node", "n", F.posexplode("sig").alias("k", "v"))
    shared = posts.groupBy("k", "v").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    mine = (
        posts.join(shared, ["k", "v"])
        .groupBy("node", "n")
        .agg(F.sort_array(F.collect_list(F.struct("f", "k", "v"))).alias("own"))  # at most 64
    )
    prefix = coordinates - match + 1
    left = F.greatest(F.lit(0), prefix - (F.lit(coordinates) - F.size("own")))
    return mine.select("node", "n", F.inline(F.slice("own", F.lit(1), left))).select("k", "v", "node", "n")


def unlinked(posts: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The postings, with their component as ``c``, of lists that hold more than one component."""
    if labels is None:
        own = posts.withColumn("c", F.col("node"))
    else:
        own = posts.join(labels, "node", "left").select("k", "v", "node", "n", F.coalesce("component", "node").alias("c"))
    lists = own.groupBy("k", "v").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("k", "v")
    return own.join(lists, ["k", "v"], "left_semi")


def pairs_of(x: DataFrame, y: DataFrame, close) -> DataFrame:
    """Distinct pairs (a < b) of rows that share a list, differ in component and are near in size."""
    other = y.select("k", "v", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "c")])
    met = x.join(other, ["k", "v"]).filter((F.col("c") != F.col("c2")) & close(F.col("n"), F.col("n2")))
    return met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after new links: every label next to a smaller one gives way to it, one step for each call.

    Equal labels always mean linked classes; that linked ones may still differ costs comparisons, not links.
    """
    if labels is None:
        labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    else:
        new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
        labels = labels.unionByName(new.withColumn("component", F.col("node")))
    named = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(named, "b")
    lower = ends.filter("ca <> cb").groupBy(F.greatest("ca", "cb").alias("component")).agg(F.min(F.least("ca", "cb")).alias("lower"))
    return stage(labels.join(lower, "component", "left").select("node", F.coalesce("lower", "component").alias("component")), "labels")


def led(posts: DataFrame, labels: DataFrame | None, draw: int, close) -> DataFrame:
    """Pairs of every class with one class of each of its lists."""
    own = unlinked(posts, labels)
    # The first draw is the same in lists of the same classes, the later ones differ from list to list.
    drawn = F.xxhash64("node", F.lit(draw), F.when(F.lit(draw > 0), F.col("k")))
    first = F.min(F.struct(drawn.alias("h"), "node", "n", "c"))
    leaders = own.groupBy("k", "v").agg(first.alias("x")).select("k", "v", "x.node", "x.n", "x.c")
    return pairs_of(leaders, own, close)


def adjacent(posts: DataFrame, labels: DataFrame, reps: DataFrame, match: int, percent: int) -> DataFrame:
    """(tile, a, partners): classes of one list in different components that agree often enough and are near in size.

    Every class that a tile asks for has a row of its own too, without partners.
    """
    own = stage(unlinked(posts, labels), "lists")
    size = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int")
    lists = stage(own.groupBy("k", "v").agg(size.alias("chunks"), F.count(F.lit(1)).alias("rows")), "list_sizes")
    few = max(1, (lists.agg(F.sum("rows")).first()[0] or 0) // CHUNK)
    bits = posts.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("bits"))
    # Short lists share tiles; what they cost is to be sent the sets of both.
    tile = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("k", "v"), F.lit(few))).otherwise(F.xxhash64("k", "v", "x", "y"))
    chunked = own.join(lists, ["k", "v"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    full = chunked.join(reps.select("node", "sig"), "node").join(bits, "node")
    tiles = full.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns(
        {"x": F.least("chunk", "partner"), "y": F.greatest("chunk", "partner")}
    ).select("k", "v", "x", "y", tile.alias("tile"), "chunk", "node", "n", "c", "sig", "bits")

    def met(rows: pa.Table) -> pa.RecordBatch:
        get = lambda name: rows.column(name).to_numpy()
        k, apart = get("k")[0], get("x")[0] != get("y")[0]
        node, n, c, chunk = get("node"), get("n").astype(np.int64), get("c"), get("chunk")
        sig = rows.column("sig").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        posted_in = (get("bits")[:, None] >> np.arange(sig.shape[1], dtype=np.int64)) & 1 == 1
        starts, partners = [0], []
        for i in range(len(node)):
            j = np.arange(i + 1, len(node))
            j = j[(c[j] != c[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])) & (~apart | (chunk[j] != chunk[i]))]
            same = sig[j] == sig[i]
            first = (same & posted_in[j] & posted_in[i]).argmax(axis=1) if len(j) else j
            partners.append(node[j[(same.sum(axis=1) >= match) & (first == k)]])
            starts.append(starts[-1] + len(partners[-1]))
        kept = np.flatnonzero(np.diff(starts))
        asked = np.unique(np.concatenate([node[kept], *partners]))
        lists = pa.ListArray.from_arrays(pa.array(np.array(starts, np.int32)), pa.array(np.concatenate([*partners, np.empty(0, np.int64)])))
        tile = pa.array(np.full(len(kept) + len(asked), get("tile")[0]))
        return pa.RecordBatch.from_arrays(
            [tile, pa.concat_arrays([pa.array(node[kept]), pa.array(asked)]),
             pa.concat_arrays([lists.take(pa.array(kept)), pa.nulls(len(asked), lists.type)])],
            names=["tile", "a", "partners"],
        )

    return grouped(tiles, ["k", "v", "x", "y"], met, "tile long, a long, partners array<long>")


def dealt(near: DataFrame) -> DataFrame:
    """(tile, a, partners) of pairs (a, b), about ``CHUNK`` pairs in a tile; a class with many partners is in several."""
    few = max(1, near.count() // CHUNK)
    many = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    tile = F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))), F.lit(few))
    placed = stage(near.join(many, "a").select(tile.alias("tile"), "a", "b"), "placed")
    asked = placed.select("tile", "a").unionByName(placed.select("tile", F.col("b").alias("a"))).distinct()
    listed = placed.groupBy("tile", "a").agg(F.collect_list("b").alias("partners"))
    return listed.unionByName(asked.withColumn("partners", F.lit(None).cast("array<long>")))


def agreements(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b, agree): equal coordinates of the signatures, on one byte each, so never fewer than there are."""
    short = reps.select("node", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            same = (x == y).sum(axis=1).astype(np.int32) if batch.num_rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same)], names=["a", "b", "agree"])

    met = pairs.join(short.toDF("a", "ma"), "a").join(short.toDF("b", "mb"), "b").select("a", "b", "ma", "mb")
    return met.mapInArrow(run, "a long, b long, agree int")


def joined(sets: list[np.ndarray], labels: np.ndarray, pairs: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of sets that reach the similarity, without those that labels and earlier pairs have joined already."""
    sizes = np.array([len(x) for x in sets], np.int64)
    group = {c: i for i, c in enumerate(dict.fromkeys(labels.tolist()))}
    root = list(range(len(group)))
    of = [group[c] for c in labels.tolist()]

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    both = None
    each = int((sizes[pairs[:, 0]] + sizes[pairs[:, 1]]).sum()) if len(pairs) else 0
    if len(pairs) > 8 * len(sets):
        words, place = np.unique(np.concatenate(sets), return_inverse=True)
        if len(sets) ** 2 * len(words) < 1000 * each:  # many pairs over few shingles: one product for all
            both, owner = np.zeros((len(sets), len(sets))), np.repeat(np.arange(len(sets)), sizes)
            for start in range(0, len(words), 8192):
                inside = (place >= start) & (place < start + 8192)
                has = np.zeros((len(sets), 8192), np.float32)
                has[owner[inside], place[inside] - start] = 1
                both += has @ has.T
            both = both.astype(np.int64)
    out = []
    for n, (i, j) in enumerate(pairs.tolist()):
        x, y = top(of[i]), top(of[j])
        if x != y:
            met = both[i, j] if both is not None else len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if met and 100 * met >= percent * (sizes[i] + sizes[j] - met):
                root[max(x, y)] = min(x, y)
                out.append(n)
    return np.array(out, np.int64)


def confirmed(tiles: DataFrame, docs: DataFrame, labels: DataFrame | None, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) among the partners of ``tiles(tile, a, partners)``: enough of them to join all that full shingle sets link.

    A set is computed once and sent once to each tile that asks for it.
    """
    asked = stage(tiles.filter("partners IS NULL").select("tile", F.col("a").alias("node")).distinct(), "asked")
    tiles = tiles.filter("partners IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [shingle_set(texts[start + i].as_py(), shingle).tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "found"])

    texts = docs.select(F.col("doc_id").alias("node"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    wanted = texts.join(asked.select("node").distinct(), "node", "left_semi")
    sets = wanted.mapInArrow(run, "node long, found binary").distinct()
    named = asked.withColumn("c", F.col("node")) if labels is None else (
        asked.join(labels, "node", "left").select("tile", "node", F.coalesce("component", "node").alias("c"))
    )
    filled = named.join(sets, "node").select(F.col("tile").alias("of"), "node", "c", "found")

    def judged(left: pa.Table, right: pa.Table) -> pa.Table:
        nodes, labels_of = left.column("node").to_numpy(), left.column("c").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in left.column("found").to_pylist()]
        places: dict[int, list[int]] = {}
        for i, node in enumerate(nodes.tolist()):  # an id that repeats has several sets
            places.setdefault(node, []).append(i)
        pairs = [
            (i, j) for a, others in zip(right.column("a").to_pylist(), right.column("partners").to_pylist())
            for i in places.get(a, ()) for b in others for j in places.get(b, ())
        ]
        pairs = np.array(pairs, np.int64).reshape(-1, 2)
        kept = pairs[joined(sets, labels_of, pairs, percent)] if len(pairs) else pairs
        return pa.table({"a": pa.array(nodes[kept[:, 0]]), "b": pa.array(nodes[kept[:, 1]])})

    links = filled.groupBy("of").cogroup(tiles.groupBy("tile")).applyInArrow(judged, "a long, b long")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = COORDINATES, match: int = MATCH,
    draws: int = DRAWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, set_hi, set_lo, component_id, kept."""
    ship(docs.sparkSession)
    prints = stage(fingerprints(docs, shingle, coordinates), "prints")
    filled = prints.filter("n > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"))
    classes = stage(classes, "classes")
    mark = F.unhex(F.array_join(F.transform("sig", lambda v: F.lpad(F.hex(F.pmod(v, F.lit(256))), 2, "0")), ""))
    reps = filled.join(classes, ["hi", "lo"]).filter("doc_id = node")
    reps = stage(reps.select("node", "n", "sig", mark.alias("mark")).dropDuplicates(["node", "n", "mark"]), "reps")
    posts = stage(posted(reps, coordinates, match), "posts")

    def close(x, y):
        return (100 * F.least(x, y) >= percent * F.greatest(x, y))

    labels, links, seen = None, None, None
    for draw in range(draws + 1):
        if draw == draws:
            tiles = stage(adjacent(posts, labels, reps, match, percent), "tiles")
        else:
            pairs = led(posts, labels, draw, close)
            if seen is not None:
                pairs = pairs.join(seen, ["a", "b"], "left_anti")
            near = stage(agreements(pairs, reps).filter(F.col("agree") >= match).select("a", "b"), "near")
            seen = near if seen is None else seen.unionByName(near)
            tiles = stage(dealt(near), "tiles")
        new = stage(confirmed(tiles, docs, labels, shingle, percent), "links")
        links = new if links is None else links.unionByName(new)
        labels = relabelled(labels, new) if draw < draws else labels
    owned = prints.select("doc_id", "n", "hi", "lo").join(classes, ["hi", "lo"], "left")
    # One id on several classes links each of them to the smallest; its texts without shingles go with them.
    ids = owned.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("node").alias("a"), F.max("node").alias("most"), F.max(F.col("node").isNull()).alias("blank")
    )
    repeated = stage(ids.filter("a <> most OR (a IS NOT NULL AND blank)").select("doc_id", "a"), "repeated")
    several = owned.join(repeated, "doc_id").filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    owned = owned.join(repeated, "doc_id", "left").withColumn("node", F.coalesce("node", "a")).drop("a")
    labels = components(links.unionByName(several))
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    out = owned.join(labels, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("hi").alias("set_hi"), F.col("lo").alias("set_lo"),
        whole.alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, **options) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id (of several such rows, one)."""
    judged = near_duplicates(docs.select("doc_id", "text"), shingle, percent, **options)
    stay = judged.filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct()
    found = docs.join(stay, docs["doc_id"] == F.col("__id"))
    order = Window.partitionBy("__id").orderBy(F.length("text"), F.xxhash64("text"))
    found = found.withColumn("__row", F.row_number().over(order)).filter("__row = 1").drop("__row", "__id")
    return found.unionByName(docs.filter("doc_id IS NULL"))
