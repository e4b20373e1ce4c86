"""Best-fit packing improved by swap-based local search.

A document's ids (its text's, then the end id) are cut into pieces of the sequence length, the first possibly shorter.
Pieces are dealt evenly to groups and packed within their group: best fit from the longest piece down, then local search
over underfull sequences, which moves a piece, or exchanges one for one or two for one, whenever that raises the sum of
squared fills, until the emptiest sequences have none left.  A group leaves about one sequence underfull, one in some ten thousand.

Only pieces' numbers are shuffled, never texts or ids; sequences() joins the ids of packed pieces back in.

Defined results: a null or empty text is its end id alone; a null doc_id stays null; repeated rows are packed each; no rows,
no result rows.  Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_bytes
from .tokens import ByteBpe, loaded

CAPACITY = 1024
END = 2
GROUP_BYTES = 64 << 20
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_IDS = _PIECE + ", ids binary"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: tuple, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        encoder = loaded(ByteBpe, *tokenizer)
        for b in batches:
            rows = []
            for doc, raw in zip(b["doc_id"].to_pylist(), encoder.encode_batch([t or "" for t in b["text"].to_pylist()]), strict=True):
                raw += tail
                for i, (s, n) in enumerate(cuts(len(raw) // 4, capacity)):
                    part = raw[4 * s : 4 * (s + n)]
                    rows.append((doc, i, s, n, zlib.crc32(part), part))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([r[5] for r in rows], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, _PIECE_IDS if with_ids else _PIECE)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: the longest first, each into the fullest bin that holds it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        left = room - n
        if left:
            by_room[left].append(at)
            rooms |= 1 << left
    return bins


class LocalSearch:
    """Raises the sum of squared fills over underfull bins by taking from the emptiest bin what fuller ones can hold.

    Every underfull bin is a target and every pair of a bin's pieces is tried, as lengths: a bin has at most some 45 different ones.
    Targets are found by an index: for a piece's length m (0 for none) and a room r, the open bins that have both.  A bin gains from a
    length n of the source if it can give m < n <= m + r for it.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins = [sorted(b, key=lengths.__getitem__) for b in bins]
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.held: list[dict[int, dict[int, None]]] = [{} for _ in range(capacity)]
        self.rooms = [0] * capacity

    def _keys(self, at: int) -> set[int]:
        return {0} | {self.lengths[i] for i in self.bins[at]}

    def _open(self, at: int) -> None:
        room = self.capacity - self.fill[at]
        if room:
            for m in self._keys(at):
                self.held[m].setdefault(room, {})[at] = None
                self.rooms[m] |= 1 << room

    def _close(self, at: int) -> None:
        room = self.capacity - self.fill[at]
        for m in self._keys(at) if room else ():
            some = self.held[m][room]
            del some[at]
            if not some:
                del self.held[m][room]
                self.rooms[m] &= ~(1 << room)

    def _put(self, at: int, out: list[int], into: list[int]) -> None:
        items = [i for i in self.bins[at] if i not in out] + into
        self.bins[at] = sorted(items, key=self.lengths.__getitem__)
        self.fill[at] = sum(self.lengths[i] for i in items)

    def _offers(self, source: int) -> tuple[dict[int, tuple], dict[int, tuple]]:
        """Pieces of the source by length, and pairs by the sum of their lengths."""
        one: dict[int, tuple] = {}
        twice: dict[int, tuple] = {}
        for i in self.bins[source]:
            n = self.lengths[i]
            if n in one:
                twice.setdefault(n, (one[n][0], i))
            else:
                one[n] = (i,)
        two, seen = {2 * n: pair for n, pair in twice.items()}, []
        for n, (i,) in one.items():
            for m, j in seen:
                two.setdefault(n + m, (i, j))
            seen.append((n, i))
        return one, two

    def _target(self, one: dict[int, tuple], two: dict[int, tuple]) -> int | None:
        """The fullest open bin that can gain, or None."""
        single, every = sum(1 << n for n in one), 0
        for n in (*one, *two):
            if n <= self.capacity:
                every |= 1 << n
        best = None
        for m, rooms in enumerate(self.rooms):
            larger = (every if m else single) >> (m + 1)
            if rooms and larger:
                least = (larger & -larger).bit_length()  # the room that the next larger offer needs
                fitting = rooms >> least
                if fitting:
                    room = least + (fitting & -fitting).bit_length() - 1
                    if best is None or room < best[0]:
                        best = (room, m)
        return None if best is None else next(iter(self.held[best[1]][best[0]]))

    def _improve(self, source: int) -> int | None:
        """The fullest open bin that gained from source by its best move or exchange, or None."""
        one, two = self._offers(source)
        at = self._target(one, two)
        if at is None:
            return None
        room = self.capacity - self.fill[at]
        theirs = [self.lengths[i] for i in self.bins[at]]
        best: tuple[int, tuple, list[int]] | None = None
        for n, items in one.items():
            if n <= room and (best is None or n > best[0]):
                best = (n, items, [])
        for n, items in (*one.items(), *two.items()):
            lo, hi = bisect_left(theirs, n - room), bisect_right(theirs, n - 1)
            if lo < hi and (best is None or n - theirs[lo] > best[0]):
                best = (n - theirs[lo], items, [self.bins[at][lo]])
        _, items, back = best
        self._close(at)
        self._put(at, back, list(items))
        self._put(source, list(items), back)
        self._open(at)
        return at

    def run(self) -> list[list[int]]:
        order = sorted((i for i, f in enumerate(self.fill) if f < self.capacity), key=lambda i: self.fill[i])
        for at in reversed(order):
            self._open(at)
        for source in order:
            if self.fill[source] < self.capacity:
                self._close(source)  # a source is no target any more
                while self.bins[source] and self._improve(source) is not None:
                    pass
        return [b for b in self.bins if b]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return LocalSearch(best_fit(lengths, capacity), lengths, capacity).run()


def pack(docs: DataFrame, tokenizer: tuple, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    cut = pieces(docs, tokenizer, capacity, end)
    groups = max(1, round((input_bytes(docs) or 0) / GROUP_BYTES))

    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        lengths = table["length"].to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        first = TaskContext.get().partitionId() << 32
        for number, items in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = first + number, at
                at += lengths[i]
        yield from table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches()

    return cut.repartition(groups).mapInArrow(run, _PIECE + ", sequence_id long, offset long")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: tuple, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """sequence_id and its ids (binary, little-endian uint32) in order of offset, for distinct doc_ids."""
    ids = pieces(docs, tokenizer, capacity, end, with_ids=True).select("doc_id", "piece", "ids")
    parts = packed.join(ids, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
