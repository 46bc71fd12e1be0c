"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Encoding follows the merge rule of such vocabularies: all adjacent symbol pairs whose join is a piece
wait in an agenda ordered by score (ties: the left one first); the best pair is merged, its neighbours
form new pairs, until none is left. Symbols without a piece become their UTF-8 byte pieces.

No piece of the vocabulary holds the space mark after another character, so no merge crosses from a word
to the space before the next one. Texts are cut there, and the distinct units of an Arrow batch that are
not in a table of bounded size are merged side by side: the agendas of many short units are rows of one
matrix, of which each round takes every row's best pair; long units have a heap each. All units merged
are checked against the sentencepiece library in the same batch; a difference is an error. Where a
vocabulary breaks the rule about space marks, the cut is left out: whole texts are merged and checked.
A decoded text that is not the text itself (space marks in it, say) is compared with the library's.

Work is row-local: no shuffle, memory bounded by a batch and the table. Defined results: a null text is
encoded as an empty one (no ids, decoded to ''); repeated rows get equal results; input columns named
like a result column are replaced.
"""

from __future__ import annotations

import ctypes
import functools
import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeimpact.llm.common import ship, without

MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
TABLE_ROWS, KEPT_ROWS, LEARNED, SHORT = 400_000, 100_000, 32_768, 32
NONE = np.iinfo(np.int32).max


class Merger:
    """One vocabulary, and the agendas over it."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        if any(self.library.is_unused(i) for i in range(size)):
            raise ValueError("vocabularies with unused pieces are not supported")
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        for b, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([b])
        self.separable = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.forget()
        self._pairs()

    def forget(self, but: int = 0) -> None:
        """A table of the units met first, ``but`` of them: a number for each unit, and by number its ids as the bytes of 32-bit integers."""
        first = [(unit, self.known[n]) for unit, n in islice(self.table.items(), but)] if but else []
        self.table: defaultdict[str, int] = defaultdict(count().__next__)
        self.table.update((unit, self.table.default_factory()) for unit, _ in first)
        self.known: list[bytes] = [ids for _, ids in first]

    def rest(self) -> None:
        """After a task: workers wait for tasks of any stage, so they keep the units met first alone, mostly frequent ones."""
        if len(self.known) > KEPT_ROWS:
            self.forget(KEPT_ROWS)
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:  # glibc keeps what is freed otherwise
                trim(0)

    def _pairs(self) -> None:
        """Symbols are pieces (their ids) and further characters of pieces; pairs that join to a piece, as sorted keys."""
        symbols = dict(self.ids)
        for p in self.ids:
            for c in p:
                symbols.setdefault(c, len(self.raw) + len(symbols))
        self.chars = {i: s for s, i in symbols.items() if i >= len(self.raw)}
        self.span = max(symbols.values(), default=0) + 2
        self.of_char = np.full(0x110000, -1, np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        ranks = {s: r for r, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        rows = [
            (symbols[p[:i]] * self.span + symbols[p[i:]], ranks[self.scores[p]], self.ids[p])
            for p in self.ids for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols
        ]
        rows.sort()
        self.keys = np.array([r[0] for r in rows] or [-1], np.int64)
        self.ranks = np.array([r[1] for r in rows] or [NONE], np.int32)
        self.joined = np.array([r[2] for r in rows] or [-1], np.int64)

    def found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the keys, -1 where the two don't join."""
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), at, -1)

    def rank(self, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.ranks[at], NONE)

    def merge_rows(self, units: list[str]) -> list[list[int]]:
        """Ids of short units: one row each, all rows merge their best pair in each round."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        width = int(lengths.max())
        inside = np.arange(width) < lengths[:, None]
        symbols = np.full((len(units), width), -1, np.int64)
        own = self.of_char[codes]
        symbols[inside] = np.where(own >= 0, own, -2 - codes.astype(np.int64))  # no pair has a negative symbol
        at = np.full((len(units), width), -1, np.int64)
        at[:, :-1] = self.found(symbols[:, :-1], symbols[:, 1:])
        ranks, rows = self.rank(at), np.arange(len(units))
        out, count = symbols.copy(), lengths.copy()
        place = np.arange(width)
        while len(rows):
            best = ranks.argmin(axis=1)
            local = np.arange(len(rows))
            live = ranks[local, best] < NONE
            if not live.all():
                done = ~live
                out[rows[done]] = symbols[done]
                rows, symbols, at, ranks, best = rows[live], symbols[live], at[live], ranks[live], best[live]
                local = np.arange(len(rows))
                if not len(rows):
                    break
            symbols[local, best] = self.joined[at[local, best]]
            source = np.minimum(place + (place > best[:, None]), width - 1)
            symbols = np.take_along_axis(symbols, source, 1)
            at = np.take_along_axis(at, source, 1)
            ranks = np.take_along_axis(ranks, source, 1)
            symbols[:, -1], at[:, -1], ranks[:, -1] = -1, -1, NONE
            count[rows] -= 1
            following = symbols[local, np.minimum(best + 1, width - 1)]
            at[local, best] = x = self.found(symbols[local, best], np.where(best + 1 < width, following, -1))
            ranks[local, best] = self.rank(x)
            before = np.maximum(best - 1, 0)
            x = np.where(best > 0, self.found(symbols[local, before], symbols[local, best]), at[local, before])
            at[local, before] = x
            ranks[local, before] = self.rank(x)
        plain = ((out >= -1) & (out < len(self.raw))).all(axis=1).tolist()
        lists = [row[:n] for row, n in zip(out.tolist(), count.tolist())]
        return [row if ok else self.spelled(row) for row, ok in zip(lists, plain)]

    def spelled(self, row: list[int]) -> list[int]:
        """Symbols that are no pieces give way to the byte pieces of their character."""
        out: list[int] = []
        for s in row:
            char = chr(-2 - s) if s < 0 else self.chars.get(s)
            out.extend([s] if char is None else [self.byte_ids[b] for b in char.encode("utf-8")])
        return out

    def merge(self, text: str) -> list[int]:
        """Ids of any normalised text: the agenda is a heap."""
        symbols: list[str | None] = list(text)
        before = list(range(-1, len(symbols) - 1))
        after = [*range(1, len(symbols)), -1]
        scores = self.scores
        agenda = [(-scores[text[i : i + 2]], i, i + 1, 2) for i in range(len(text) - 1) if text[i : i + 2] in scores]
        heapq.heapify(agenda)

        def offer(left: int, right: int) -> None:
            pair = symbols[left] + symbols[right]
            if pair in scores:
                heapq.heappush(agenda, (-scores[pair], left, right, len(pair)))

        while agenda:
            _, left, right, length = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or len(a) + len(b) != length:
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = a + b, None
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        out: list[int] = []
        for symbol in filter(None, symbols):
            own = self.ids.get(symbol)
            out.extend([own] if own is not None else [self.byte_ids[b] for b in symbol.encode("utf-8")])
        return out

    def learn(self, units: list[str]) -> dict[str, list[int]]:
        """Ids of units, each of which starts with a space mark, checked against the library."""
        short = [u for u in units if len(u) <= SHORT]
        ids: dict[str, list[int]] = {}
        # Rows of like length share a matrix.
        short.sort(key=len)
        for i in range(0, len(short), 4096):
            part = short[i : i + 4096]
            ids.update(zip(part, self.merge_rows(part)))
        ids.update((u, self.merge(u)) for u in units if len(u) > SHORT)
        # The library itself puts the first space mark; a mark alone would be an empty text to it.
        names = list(ids)
        theirs = self.library.encode([u[1:].replace(MARK, " ") for u in names], num_threads=1)
        for name, own in zip(names, theirs):
            if ids[name] != own and name != MARK:
                raise ValueError(f"agenda and library differ on {name[:200]!r}: {ids[name][:50]} {own[:50]}")
        return ids

    def coded(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text. While a batch is read its units are numbers: as strings and lists they outweigh the texts many times."""
        if len(self.known) > TABLE_ROWS:
            self.forget(KEPT_ROWS)
        table, known = self.table, self.known
        kept, rows = len(table), []
        for text in texts:
            marked = MARK + text.replace(" ", MARK) if text else ""
            units = UNIT.findall(marked) if self.separable else [marked] if marked else []
            rows.append(np.fromiter(map(table.__getitem__, units), np.int32, len(units)))
        fresh = list(islice(table, kept, None))
        try:
            for i in range(0, len(fresh), LEARNED):
                own = self.learn(part := fresh[i : i + LEARNED])
                known.extend([array("i", own[unit]).tobytes() for unit in part])
        except BaseException:
            self.forget()  # numbers without ids would be left
            raise
        out = [np.frombuffer(b"".join(map(known.__getitem__, row.tolist())), np.int32) for row in rows]
        for unit in fresh:
            if len(unit) > SHORT:
                known[table.pop(unit)] = b""
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids in self.coded(texts)]

    def decode(self, ids: list[int], text: str) -> str:
        """Pieces and bytes joined, without the space that encoding put first; ``text`` is what was encoded."""
        joined = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")
        if joined != text and joined != (theirs := self.library.decode(ids)):
            raise ValueError(f"own decoding and the library's differ: {joined[:200]!r} {theirs[:200]!r}")
        return joined


@functools.cache
def merger(model_file: str) -> Merger:
    return Merger(model_file)


def per_batch(
    docs: DataFrame, columns: dict[str, T.DataType], fill: Callable[[list[str]], list[pa.Array]], done: Callable[[], None]
) -> DataFrame:
    """``docs`` with columns that ``fill`` gives for the texts of up to 2,000 rows at a time; ``done`` is called after a task that had some."""
    ship(docs.sparkSession)
    base = without(docs, *columns)
    at = base.columns.index("text")
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, t) for n, t in columns.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = added = None
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 2000):
                    part = batch.slice(start, 2000)
                    added = fill([t or "" for t in part.column(at).to_pylist()])
                    yield pa.RecordBatch.from_arrays([*part.columns, *added], names=schema.names)
        finally:
            if added is not None:
                batch = part = added = None
                done()

    return base.mapInArrow(run, schema)


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """``docs`` with ``ids`` (array of piece ids) and ``decoded`` (the text that the ids give back)."""

    def fill(texts: list[str]) -> list[pa.Array]:
        own = merger(model_file)
        ids = own.coded(texts)
        flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        decoded = (own.decode(row.tolist(), text) for row, text in zip(ids, texts))
        return [pa.ListArray.from_arrays(ends, flat), pa.array(decoded, pa.string())]

    return per_batch(docs, {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}, fill, lambda: merger(model_file).rest())


def digests(coded: DataFrame) -> DataFrame:
    """What tells results of ``encode()`` apart: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
