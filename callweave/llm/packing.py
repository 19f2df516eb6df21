"""Best-fit packing of token pieces into sequences of fixed length, improved by exchanges between underfull sequences.

Lengths are bounded by the sequence length, so how many pieces there are of each length is a table of at most that many rows
however large the corpus is. Best fit by decreasing length and the local search work on groups of equally filled sequences
with the number of them in each group; an exchange between two groups is made for as many pairs as there are. The pieces
themselves never leave the executors: each gets its number among those of its length and looks up its place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm import arrays, tokens
from callweave.llm.tables import documents, in_tables

SEQUENCE = 1024

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

Group = tuple[int, ...]  # lengths in a sequence, longest first


def pieces(docs: DataFrame, size: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """Pieces of ``(doc_id, text)``: a document's ids and the end id, cut only where there are more than ``size``.

    The first piece of a longer document takes the remainder, all others are full. ``nth`` counts the pieces of one length
    within a task (``part``). A null text is empty, so its document is the end id.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), tokens.encoder(vocabulary)
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, bounds in arrays.text_slices(batch.column(1)):
                ids, ends = tokens.with_end(*encoder.encode(data, bounds))
                total = np.diff(ends)
                n = -(-total // size)
                doc = np.repeat(np.arange(len(total)), n)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = total - (n - 1) * size
                start = np.where(number == 0, 0, head[doc] + (number - 1) * size)
                length = np.where(number == 0, head[doc], size)
                at = ends[:-1][doc] + start
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                by_length = length[order]
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(order)) - np.searchsorted(by_length, by_length) + seen[by_length]
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[row + doc]), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                     pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return documents(docs).mapInArrow(cut, PIECES)


def best_fit(counts: dict[int, int], size: int) -> Counter[Group]:
    """Best fit by decreasing length on numbers of equal pieces: groups of equal sequences and how many there are."""
    done: Counter[Group] = Counter()
    open_: dict[int, Counter[Group]] = {}  # by room left
    rooms: list[int] = []

    def put(group: Group, n: int) -> None:
        room = size - sum(group)
        if room == 0:
            done[group] += n
            return
        if room not in open_:
            open_[room] = Counter()
            insort(rooms, room)
        open_[room][group] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                fits, group, there = size // length, (), -(-left // (size // length))
            else:
                room = rooms[i]
                group, there = open_[room].popitem()
                if not open_[room]:
                    del open_[room], rooms[i]
                fits = room // length
            full = min(there, left // fits)
            if full:
                put(group + (length,) * fits, full)
            left -= full * fits
            if there > full and left:
                put(group + (length,) * left, 1)
                left, full = 0, full + 1
            if group and there > full:
                put(group, there - full)
    for groups in open_.values():
        done.update(groups)
    return done


def _better(a: Group, b: Group, size: int) -> tuple[Group, Group] | None:
    """The best exchange that fills ``b``, the fuller one, from ``a``: a move, one for one, or two for one."""
    room = size - sum(b)
    gain, best = 0, None
    for x in set(a):
        if gain < x <= room:
            gain, best = x, ((x,), ())
    for y in set(b):
        for x in set(a):
            if gain < x - y <= room:
                gain, best = x - y, ((x,), (y,))
        ordered = sorted(a)
        for i, first in enumerate(ordered):
            for second in ordered[i + 1:]:
                if gain < first + second - y <= room:
                    gain, best = first + second - y, ((first, second), (y,))
    for x in set(a):  # one for two
        ordered = sorted(b)
        for i, first in enumerate(ordered):
            for second in ordered[i + 1:]:
                if gain < x - first - second <= room:
                    gain, best = x - first - second, ((x,), (first, second))
    if best is None:
        return None
    out, back = Counter(best[0]), Counter(best[1])
    new_a = tuple(sorted((Counter(a) - out + back).elements(), reverse=True))
    new_b = tuple(sorted((Counter(b) - back + out).elements(), reverse=True))
    return new_a, new_b


def _sums(group: Group) -> tuple[set[int], set[int]]:
    """The lengths of single pieces and of pairs of pieces."""
    number = Counter(group)
    lengths = sorted(number)
    return set(lengths), {x + y for i, x in enumerate(lengths) for y in lengths[i:] if x < y or number[x] > 1}


class _Partners:
    """Underfull groups by the room they have, with sets (as bits) of what they give and what would fill them.

    A room's set is that of all its groups, so rooms without a partner are passed over at once. A group that goes leaves the
    room's set as it is until the set misleads.
    """

    def __init__(self, size: int) -> None:
        self.size = size
        self.gives: dict[Group, tuple[int, int]] = {}
        self.wants: dict[Group, tuple[int, int]] = {}
        self.rooms: dict[int, list[Group]] = {}
        self.any: dict[int, tuple[int, int]] = {}

    def add(self, group: Group) -> None:
        room = self.size - sum(group)
        one, two = _sums(group)
        run = (1 << room) - 1
        single = pair = 0
        for y in one:
            pair |= run << (y + 1)
        for y in two:
            single |= run << (y + 1)
        single |= pair | run << 1
        self.gives[group] = sum(1 << x for x in one), sum(1 << x for x in two)
        self.wants[group] = single, pair
        insort(self.rooms.setdefault(room, []), group)
        had = self.any.get(room, (0, 0))
        self.any[room] = had[0] | single, had[1] | pair

    def remove(self, group: Group) -> None:
        own = self.rooms[self.size - sum(group)]
        del own[bisect_left(own, group)], self.gives[group], self.wants[group]

    def fits(self, donor: Group, other: Group) -> bool:
        """Whether ``_better`` finds an exchange."""
        (one, two), (single, pair) = self.gives[donor], self.wants[other]
        return bool(one & single or two & pair)

    def find(self, donor: Group, number: int) -> Group | None:
        """The fullest group that ``donor``, of which there are ``number``, can fill."""
        one, two = self.gives[donor]
        last = self.size - sum(donor)
        for room in sorted(r for r, (single, pair) in self.any.items() if r <= last and (one & single or two & pair)):
            own = self.rooms[room]
            for other in reversed(own):
                if room == last and (other < donor or other == donor and number < 2):
                    break
                if self.fits(donor, other):
                    return other
            else:
                single = pair = 0
                for other in own:
                    single, pair = single | self.wants[other][0], pair | self.wants[other][1]
                self.any[room] = single, pair
        return None


def exchange(groups: Counter[Group], size: int) -> Counter[Group]:
    """Exchange pieces between underfull sequences while the sum of squared fills grows, until no pair has an exchange.

    The emptiest group gives to the fuller ones, fullest first. Every step makes the fuller sequence fuller by as much as the
    other one loses, so the sum of squares rises and the search ends. A group without a partner rests until one comes up.
    """
    groups = Counter(groups)
    partners = _Partners(size)
    for g in groups:
        if sum(g) < size:
            partners.add(g)
    under = sorted((sum(g), g) for g in partners.gives)
    resting: set[Group] = set()
    while under:
        donor = under[0][1]
        other = partners.find(donor, groups[donor])
        if other is None:
            under.pop(0)
            resting.add(donor)
            continue
        found = _better(donor, other, size)
        assert found is not None
        more, less = found[1], found[0]
        times = groups[donor] // 2 if other == donor else min(groups[donor], groups[other])
        for g, n in ((donor, -times), (other, -times), (more, times), *(((less, times),) if less else ())):
            groups[g] += n
        for g in {donor, other, more, less} - {()}:
            at = sum(g), g
            if not groups[g]:
                del groups[g]
                if g in partners.gives:
                    partners.remove(g)
                    resting.discard(g)
                    i = bisect_left(under, at)
                    if i < len(under) and under[i] == at:
                        del under[i]
                continue
            if at[0] == size:
                continue
            if g not in partners.gives:
                partners.add(g)
                insort(under, at)
                awake = [r for r in resting if (sum(r), r) < at and partners.fits(r, g)]
            else:
                awake = [g] if g in resting and groups[g] > 1 and partners.fits(g, g) else []
            for r in awake:
                resting.remove(r)
                insort(under, (sum(r), r))
    return groups


def places(groups: Counter[Group]) -> dict[int, np.ndarray]:
    """For each length the columns: first number among its pieces, first sequence, offset there."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter[int] = Counter()
    sequence = 0
    for group, n in sorted(groups.items(), reverse=True):
        offset = 0
        for length in group:
            rows.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pack(docs: DataFrame, size: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence and its offset there; sequences have no gaps and start at 0."""
    cut = in_tables(pieces(docs, size, vocabulary))
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    table = cut.sparkSession.sparkContext.broadcast(places(exchange(best_fit(total, size), size)))
    before = counts.select(F.col("part").alias("p"), F.col("length").alias("l"),
                           (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for value in np.unique(length):
                own = length == value
                rows = table.value[int(value)]
                at = np.searchsorted(rows[:, 0], number[own], "right") - 1
                sequence[own] = rows[at, 1] + number[own] - rows[at, 0]
                offset[own] = rows[at, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = cut.join(before, (cut["part"] == before["p"]) & (cut["length"] == before["l"])).select(
        "doc_id", "piece", "start", cut["length"], "ids_crc32", (F.col("nth") + F.col("before")).alias("number"))
    return numbered.mapInArrow(place, PLACED)
