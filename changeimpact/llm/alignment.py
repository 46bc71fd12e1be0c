"""Cross-tokenizer alignment: where two tokenizers cut a text at the same bytes, and which of their tokens overlap.

A document is read by a byte-level tokenizer (A) as space+text and by a SentencePiece vocabulary (B), which puts
that space itself. Every token points to its farthest-right overlapping token of the other side: the one that
covers its last byte. A B token that ends where an A token ends points to itself: there a group ends. Successor
doubling (each token takes the pointer of its pointer, all tokens of many texts at once) converges to every
component's terminal token, which labels the groups.

1. Encoding, pointers and links run in Arrow batches. Before a space after a character that is no white space both
   tokenizers start a new token whatever follows, so a group ends there too: texts are cut there, and each distinct unit of a
   batch (bounded in rows and bytes) is encoded and aligned once. Where a tokenizer gives no such promise (see ``cuts_at_spaces``)
   the cut is left out and texts are units. A batch keeps a table of its distinct id pairs; a document keeps places in that
   table, not tokens.
2. Id pairs are counted corpus-wide by one aggregation with map-side combine; a B id's highest count follows.
3. The counts come back to each batch's table by a join on the pair, and the table to its documents by a co-group
   on the batch. No table of pairs is broadcast, none passes the driver. (The highest counts have one row for each
   id of the vocabulary; that bound lets Spark broadcast them.)

Defined results: a null or empty text, and one whose joined A or B bytes differ from space+text (a tokenizer that
normalises), has no tokens: zeros, ``groups`` ''. Strings of special tokens inside texts are plain text. Rows are
judged one by one, so repeated rows and ids (null too) each give a row and each count; columns other than
``doc_id`` and ``text`` are not looked at. An empty table gives an empty result. One text must fit a task.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeimpact.llm.common import ship, stage

#: Units encoded at once, documents and bytes of text that share a table of pairs.
SLICE_BYTES, BATCH_ROWS, BATCH_BYTES = 1 << 19, 1000, 8 << 20
JOINED = 64  # units read as one text
#: A unit ends where a space follows what is neither white space nor the space mark; the last space of a text is no unit.
CUT = re.compile(r"(?<=[^\s\u180e\u2581])(?= .)", re.DOTALL)
#: Where a text without one of these has a space, a unit ends.
UNCUT = re.compile(r"[\s\u180e\u2581] | \Z")
B_IDS = 1 << 24  # a pair of ids as one number: a * B_IDS + b


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def cuts_at_spaces(a: dict, pieces: list[str]) -> bool:
    """Whether a token of either side never crosses, and never depends on what lies across, a space after a visible character.

    True of a byte-level tokenizer without normalizer that splits by the usual pattern (a space is the first character of what
    it splits off, or in a run of white space) and has no added tokens but special ones, which are plain text here; and of
    pieces that hold the space mark in front only.
    """
    split = a.get("pre_tokenizer") or {}
    return (
        all(a.get(c) is None for c in ("normalizer", "truncation", "padding")) and split.get("type") == "ByteLevel" and split.get("use_regex", True)
        and not split.get("add_prefix_space", True) and all(t["special"] for t in a["added_tokens"])
        and a["model"].get("type") == "BPE" and not a["model"].get("dropout") and not any("▁" in p.lstrip("▁") for p in pieces)
    )


class Sides:
    """Both vocabularies: encoders, the bytes of every id, and ids as text with what may follow them."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        written_a = json.loads(self.a.to_str())
        special = {t["id"] for t in written_a["added_tokens"]}
        byte = byte_of_character()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.raw_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for entry, i in vocabulary.items():
            self.raw_a[i] = entry.encode() if i in special else bytes(byte[c] for c in entry)
        self.raw_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.raw_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.separable = cuts_at_spaces(written_a, [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())])
        self.bytes_a, self.bytes_b = (np.fromiter(map(len, raw), np.int64, len(raw)) for raw in (self.raw_a, self.raw_b))
        # Every id inside a group and as its last of a side.
        self.written = [f"{i}{after}" for raw, ends in ((self.raw_a, ",|"), (self.raw_b, ",;")) for i in range(len(raw)) for after in ends]

    def units(self, text: str) -> list[str]:
        """The units of a text, each without the space that both sides read before it; an empty text has none."""
        if not text or not self.separable:
            return [text] if text else []
        if UNCUT.search(" " + text) is None:
            return text.split(" ")
        return [unit[1:] for unit in CUT.split(" " + text)]

    def read(self, texts: list[str]) -> list[tuple[list[int], list[int], bool]]:
        """Ids of both sides, and whether both give the text back byte for byte."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        ids_b = self.b.encode(texts, num_threads=1)
        out = []
        for text, a, b in zip(texts, ids_a, ids_b):
            whole = (" " + text).encode() if text else b""
            same = b"".join(map(self.raw_a.__getitem__, a)) == whole == b"".join(map(self.raw_b.__getitem__, b))
            out.append((a, b, same and text != ""))
        return out

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of all units, and how many each unit has of both; none where a side does not give it back.

        Units that may stand side by side are read as one text; the bytes tell which ids are whose.
        """
        groups: list[list[str]] = [[]]
        for unit in units:
            loose = not self.separable or unit == "" or unit[-1].isspace() or unit[-1] in "\u180e▁"
            if loose or len(groups[-1]) >= JOINED:
                groups.append([])
            groups[-1].append(unit)
            if loose:
                groups.append([])
        groups = list(filter(None, groups))
        parts = []
        for group, found in zip(groups, self.read([" ".join(g) for g in groups])):
            if found[2] or len(group) == 1:
                parts.append((group, *found))
            else:
                parts.extend(([unit], *own) for unit, own in zip(group, self.read(group)))
        held = [(group, a, b) if same else (group, [], []) for group, a, b, same in parts]
        same = np.repeat([p[3] for p in parts], [len(p[0]) for p in parts])
        until = np.cumsum(np.where(same, [len(u.encode()) + 1 for u in units], 0)) if units else np.zeros(0, np.int64)
        out = []
        for side, size in ((1, self.bytes_a), (2, self.bytes_b)):
            ids = np.fromiter(chain.from_iterable(p[side] for p in held), np.int64)
            ends = np.concatenate([[0], np.cumsum(size[ids])])
            at = np.searchsorted(ends, until)
            if not np.array_equal(ends[at], until):
                raise ValueError("a token crosses the end of a unit")
            out += [ids, np.diff(at, prepend=0)]
        return tuple(out)


@functools.cache
def sides(a_file: str, b_file: str) -> Sides:
    return Sides(a_file, b_file)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of all A and of all B tokens, given the byte offsets where they end; both sides end at the same last byte."""
    n = len(ends_a)
    meets = np.searchsorted(ends_a, ends_b)  # the A token that covers a B token's last byte
    closing = ends_a[meets] == ends_b if n else np.zeros(len(ends_b), bool)
    own = n + np.arange(len(ends_b))
    pointer = np.concatenate([n + np.searchsorted(ends_b, ends_a), np.where(closing, own, meets)])
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            break
        pointer = further
    number = np.cumsum(closing) - 1
    groups = number[pointer - n]
    return groups[:n], groups[n:]


class Aligned:
    """Alignment of some texts, all at once."""

    def __init__(self, own: Sides, texts: list[str]):
        a, self.n_a, b, self.n_b = own.encode(texts)
        ends_a, ends_b = np.cumsum(own.bytes_a[a]), np.cumsum(own.bytes_b[b])
        doc_a, doc_b = np.repeat(np.arange(len(texts)), self.n_a), np.repeat(np.arange(len(texts)), self.n_b)
        group_a, group_b = terminals(ends_a, ends_b)
        last_a = np.append(group_a[1:] != group_a[:-1], True)[: len(a)]
        last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
        self.n_groups = np.bincount(doc_b[last_b], minlength=len(texts))
        # Each stretch between neighbouring ends of either side is the overlap of one A and one B token.
        cuts = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # two sorted runs
        cuts = cuts[np.append(cuts[1:] != cuts[:-1], True)[: len(cuts)]]
        at = np.searchsorted(ends_a, cuts)
        docs = doc_a[at]
        self.n_links = np.bincount(docs, minlength=len(texts))
        place, self.pairs = pd.factorize(a[at] * B_IDS + b[np.searchsorted(ends_b, cuts)])
        # (document, pair) with how often; documents stay in order
        width = max(len(self.pairs), 1)
        place, mine = pd.factorize(docs * width + place)
        self.times = np.bincount(place, minlength=len(mine))
        self.doc, self.place = np.divmod(mine, width)
        # Groups in order, the A tokens of a group before its B tokens.
        written = np.empty(len(a) + len(b), np.int64)
        until_a, until_b = np.flatnonzero(last_a) + 1, np.append(0, np.flatnonzero(last_b) + 1)
        written[np.arange(len(a)) + until_b[group_a]] = 2 * a + last_a
        written[np.arange(len(b)) + until_a[group_b]] = 2 * (b + len(own.raw_a)) + last_b
        words = list(map(own.written.__getitem__, written.tolist()))
        until = np.cumsum(self.n_a + self.n_b).tolist()
        self.groups = ["".join(words[i:j])[:-1] for i, j in zip([0, *until], until)]


class Batch:
    """Alignment of the texts of a batch, from that of their distinct units."""

    def __init__(self, own: Sides, texts: list[str]):
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__  # a new unit gets the next number
        rows = [np.fromiter(map(number.__getitem__, own.units(t)), np.int64) for t in texts]
        parts = [Aligned(own, part) for part in slices(list(number))]
        whole = np.concatenate([np.zeros(0, bool), *[x.n_a > 0 for x in parts]])
        of = np.concatenate([np.zeros(0, np.int64), *rows])
        until = np.cumsum([0, *map(len, rows)])
        # A text that has a unit without tokens has no tokens.
        wrong = np.concatenate([[0], np.cumsum(~whole[of])])
        good = wrong[until[1:]] == wrong[until[:-1]]
        docs = np.repeat(np.arange(len(texts)), np.where(good, np.diff(until), 0))
        of = of[np.repeat(good, np.diff(until))]

        def summed(name: str) -> np.ndarray:
            each = np.concatenate([np.zeros(0, np.int64), *[getattr(x, name) for x in parts]])
            return np.diff(np.concatenate([[0], np.cumsum(each[of])])[np.searchsorted(docs, np.arange(len(texts) + 1))])

        self.n_a, self.n_b, self.n_groups, self.n_links = map(summed, ("n_a", "n_b", "n_groups", "n_links"))
        groups = list(chain.from_iterable(x.groups for x in parts))
        self.groups = [";".join(map(groups.__getitem__, row.tolist())) if ok else "" for row, ok in zip(rows, good.tolist())]
        # (document, unit) with how often, then the pairs of that unit
        width = max(len(number), 1)
        place, mine = pd.factorize(docs * width + of)
        often = np.bincount(place, minlength=len(mine))
        doc, unit = np.divmod(mine, width)
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *[x.pairs for x in parts]]))
        pair = np.concatenate([np.zeros(0, np.int64), *[np.searchsorted(pairs, x.pairs)[x.place] for x in parts]])
        times = np.concatenate([np.zeros(0, np.int64), *[x.times for x in parts]])
        n_pairs = np.concatenate([np.zeros(0, np.int64), *[np.bincount(x.doc, minlength=len(x.n_a)) for x in parts]])
        first = np.cumsum(n_pairs) - n_pairs
        n = n_pairs[unit]
        at = np.repeat(first[unit] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        # (document, pair) with how often; documents stay in order
        width = max(len(pairs), 1)
        place, mine = pd.factorize(np.repeat(doc, n) * width + pair[at])
        self.times = np.zeros(len(mine), np.int64)
        np.add.at(self.times, place, np.repeat(often, n) * times[at])
        self.doc, place = np.divmod(mine, width)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, place, self.times)
        # Units of texts without tokens have left pairs that nothing links.
        linked = total > 0
        self.pairs, self.total, self.place = pairs[linked], total[linked], (np.cumsum(linked) - 1)[place]


def slices(units: list[str]) -> Iterator[list[str]]:
    """Runs of units of bounded size, one unit at least."""
    start, held = 0, 0
    for i, unit in enumerate(units):
        held += 4 * len(unit) + 1
        if held >= SLICE_BYTES or i + 1 == len(units):
            yield units[start : i + 1]
            start, held = i + 1, 0


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Runs of (doc_id, text) rows of bounded size, one row at least."""
    ids: list[pa.Array] = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        start = 0
        for i, text in enumerate(batch.column(1).to_pylist()):
            texts.append(text or "")
            held += len(texts[-1])
            if held >= BATCH_BYTES or len(texts) >= BATCH_ROWS:
                yield pa.concat_arrays([*ids, batch.column(0).slice(start, i + 1 - start)]), texts
                ids, texts, held, start = [], [], 0, i + 1
        if start < batch.num_rows:
            ids.append(batch.column(0).slice(start))
    if texts:
        yield pa.concat_arrays(ids), texts


def encoded(docs: DataFrame, a_file: str, b_file: str, digest: bool) -> DataFrame:
    """A row for each document, with places in the table of pairs of its batch, and a row for each batch with that table."""
    ship(docs.sparkSession)
    base = docs.select("doc_id", "text")
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    lists = {"place": T.IntegerType(), "times": T.IntegerType(), "pairs": T.LongType(), "counts": T.LongType()}
    schema = T.StructType(
        [T.StructField("batch", T.LongType()), base.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in counts],
         T.StructField("groups", T.StringType()), *[T.StructField(c, T.ArrayType(t)) for c, t in lists.items()]]
    )

    def listed(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sides(a_file, b_file)
        for number, (ids, texts) in enumerate(runs(batches), TaskContext.get().partitionId() << 32):
            x = Batch(own, texts)
            n = len(ids)
            groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in x.groups] if digest else x.groups
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number)), ids, *[pa.array(getattr(x, c)) for c in counts], pa.array(groups, pa.string()),
                 listed(x.place, x.doc, n, pa.int32()), listed(x.times, x.doc, n, pa.int32()),
                 pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))],
                names=schema.names,
            )
            if len(x.pairs):
                one = np.zeros(len(x.total), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.nulls(1, ids.type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()),
                     *[pa.nulls(1, pa.list_(pa.int32()))] * 2, listed(x.pairs, one, 1, pa.int64()), listed(x.total, one, 1, pa.int64())],
                    names=schema.names,
                )

    return stage(base.mapInArrow(run, schema), "encoded")


def id_pairs(tables: DataFrame) -> DataFrame:
    """(pair, count, best): corpus-wide links of every id pair, and whether its B id has no pair with more."""
    counted = tables.select("pair", "n").groupBy("pair").agg(F.sum("n").alias("count"))
    counted = stage(counted.withColumn("b_id", F.col("pair") % B_IDS), "pair_counts")
    most = counted.groupBy("b_id").agg(F.max("count").alias("most"))  # a row for each id of B at most
    return counted.join(most, "b_id").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_file: str, b_file: str, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents and id pairs.

    The first has a row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups``, the
    aligned groups as ids in order (``a1,a2|b1;a3|b2,b3``), or with ``digest`` their SHA-256 in hexadecimal ('' without tokens).
    The second has a row for each pair of ids that overlap anywhere: a_id, b_id, count, best.
    """
    stored = encoded(docs, a_file, b_file, digest)
    tables = stored.filter("pairs IS NOT NULL").select(
        "batch", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "x")
    ).select("batch", "at", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    values = stage(id_pairs(tables), "pair_values")
    looked_up = tables.select("batch", "at", "pair").join(values, "pair").select("batch", "at", "count", "best")
    rows = stored.filter("pairs IS NULL").drop("pairs", "counts").withColumnRenamed("batch", "of")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("n_best", T.LongType()),
                           T.StructField("count_sum", T.LongType()), rows.schema["groups"]])

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
        at = right.column("at").to_numpy()
        count[at], best[at] = right.column("count").to_numpy(), right.column("best").to_numpy()
        left = left.combine_chunks()
        place, times = (left.column(c).combine_chunks() for c in ("place", "times"))
        of = np.repeat(np.arange(left.num_rows), place.value_lengths().to_numpy(zero_copy_only=False))
        place, times = place.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        n_best, count_sum = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows, np.int64)
        np.add.at(n_best, of, times * best[place])
        np.add.at(count_sum, of, times * count[place])
        return pa.Table.from_arrays(
            [*[left.column(c) for c in kept], pa.array(n_best), pa.array(count_sum), left.column("groups")], names=schema.names
        )

    out = rows.groupBy("of").cogroup(looked_up.groupBy("batch")).applyInArrow(summed, schema)
    pairs = values.select(F.floor(F.col("pair") / B_IDS).alias("a_id"), (F.col("pair") % B_IDS).alias("b_id"), "count", "best")
    return out, pairs
