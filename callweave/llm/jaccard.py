"""Exact n-gram Jaccard join: classes of texts that links of similarity 0.8 and more connect.

Equal shingle sets are one node, named by a hash of the set, before anything is compared. Nodes that are similar share one of
the shingles at the front of a common order, rarest first. How common shingles are is counted exactly, over all texts, and kept
as a table of fixed size of the commonest in each cell of the hash range: any table gives an order in which no pair is lost, and
this one leaves passages that many texts share out of the fronts of all texts that hold enough else. Lists of the nodes that
share a front shingle give candidates:

* rounds with leaders: each list that holds more than one class has a leader, and every node meets a few leaders, of the lists of
  which it is a member. That is a few pairs for each node, however large a group of near copies is. There is another round as long
  as seven of ten pairs are similar;
* rounds for crowded lists, those that still hold very many classes: a node meets a fixed number of leaders of one of its crowded
  lists, so pairs grow with the nodes. There is another one as long as there is a link for one of ten nodes of these lists;
* a last round with all pairs of nodes of a list that are still in different classes.

Pairs only meet at a shingle that can be the first that they share, by their sizes and its places in both orders. A pair of similar
nodes meets at its first one or is in one class already, so no link between classes is lost. Candidates then have to pass
a bound: of the numbers of their shingles in 128 parts of the hash range, the smaller ones add up to at least what they can share.
Only nodes of pairs that pass need their shingles. A test is a T-occurrence search: the query's shingles have inverted lists over
its candidates, the long ones are set aside, the short ones are merged by a heap, and candidates that may still reach their
overlap are looked up in the long lists by binary search (DivideSkip). Tables of a round are dropped when the next has its own.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from itertools import count as count_up
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm import arrays
from callweave.llm.tables import by_slices, documents, drop, in_tables

SHINGLE = 5
WORTH = 0.7  # of the pairs tested in a round with leaders that are similar, for another such round
MET = 4  # leaders that a node meets in a round with leaders
CROWD = 64  # classes of a list that make it crowded
LEADERS = 32  # of a crowded list, for each of its nodes
CROWD_WORTH = 0.1  # links of a crowded round for each node of its lists, for another such round
CELLS = 1 << 24  # of the hash range, a byte each, for how common shingles are
RANGE = 1 << 19  # shingles that are counted together
RUN = 1 << 20  # shingles of a sorted run
KEY = 48  # bits of a shingle's hash by which it is counted
MARKS = 1 << 23  # bits that tell which texts may be wanted
BLOCK = 256  # candidates of one query that are searched together
PARTS = 128  # of the hash range, for the bound
WEIGHT = 0.0085  # of a long list's length, for how many lists are set aside

Pairs = DataFrame


def required(a: int | np.ndarray, b: int | np.ndarray) -> int | np.ndarray:
    """Shared shingles that sets of these sizes need: 100 * shared >= 80 * (a + b - shared)."""
    return -(-4 * (a + b) // 9)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)``: the distinct shingles of each text, ascending. Fewer words are one shingle, no words none."""
    low = arrays.LOWER[data]
    starts, ends, of_text = arrays.words(low, bounds, arrays.NOT_SPACE)
    n = np.diff(of_text)
    sums = arrays.prefix_hash(arrays.word_hashes(low, starts, ends))
    at = arrays.gram_starts(of_text, size)
    few = np.flatnonzero((n > 0) & (n < size))
    hashes = np.concatenate([arrays.span_hash(sums, at, at + size), arrays.span_hash(sums, of_text[few], of_text[few + 1])])
    text = np.concatenate([np.searchsorted(of_text, at, "right") - 1, few])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(bounds)))


def set_names(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set and its size."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(arrays.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return arrays.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def spread(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row per set: how many of its elements lie in each part of the hash range."""
    n = len(bounds) - 1
    text = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.bincount(text * PARTS + ((hashes >> np.uint64(20)) % np.uint64(PARTS)).astype(np.int64), minlength=n * PARTS)
    return np.minimum(counts, 65535).astype("<u2").reshape(n, PARTS)


def may_be_similar(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the bound leaves room for the overlap that sets of sizes ``n`` and ``m`` need. Full counters bound nothing."""
    full = (a == 65535).any(1) | (b == 65535).any(1)
    return full | (np.minimum(a, b).astype(np.int64).sum(1) >= required(n, m))


def packed(numbers: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of unsigned numbers, first all lowest ones: bytes that are alike stand together, so Spark packs them."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def shingle_levels(docs: DataFrame, cells: int = CELLS) -> np.ndarray:
    """How common shingles are: for each cell of the hash range the level of its commonest shingle, 0 if all stand in one text.

    A shingle in n texts has the level floor(log2 n). Counts cover all texts: tasks write sorted runs of distinct
    shingles with their counts, dealt by ranges of the hash, and the runs of a range are counted together. There are so many
    ranges that each has about a million shingles. A run holds the differences of the first ``KEY`` bits of its hashes; shingles that
    agree in these are counted as one, so no count is too low. The driver gets the ``cells`` bytes.
    """
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    radix = min(cells, max(16, 1 << (size // 6 // RANGE).bit_length()))
    shift = KEY - (radix.bit_length() - 1)
    rest = np.uint64(64 - KEY)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held) >> rest, return_counts=True)
            held.clear()
            edges = np.searchsorted(found >> np.uint64(shift), np.arange(radix + 1, dtype=np.uint64)).tolist()
            own = [k for k in range(radix) if edges[k] < edges[k + 1]]
            slices = [slice(edges[k], edges[k + 1]) for k in own]
            return pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), pa.array([packed(np.diff(found[s], prepend=np.uint64(0)), KEY // 8) for s in slices], pa.binary()),
                 pa.array([packed(n[s], 4) for s in slices], pa.binary())], names=["part", "found", "n"])

        for batch in batches:
            for _, data, bounds in arrays.text_slices(batch.column(0)):
                held.append(shingle_sets(data, bounds)[0])
                if sum(map(len, held)) >= RUN:
                    yield rows()
        if sum(map(len, held)):
            yield rows()

    def count(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        found = np.concatenate([np.cumsum(unpacked(raw, KEY // 8), dtype=np.uint64) for raw in table.column("found").to_pylist()])
        n = np.concatenate([unpacked(raw, 4) for raw in table.column("n").to_pylist()]).astype(np.int64)
        order = np.argsort(found, kind="stable")
        found, n = found[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        level = np.floor(np.log2(np.add.reduceat(n, first))).astype(np.uint8)
        cell = (found[first] >> np.uint64(KEY - (cells.bit_length() - 1))).astype(np.int64) - part * (cells // radix)
        out = np.zeros(cells // radix, np.uint8)
        np.maximum.at(out, cell, level)
        return pa.table({"part": pa.array([part], pa.int32()), "levels": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

    levels = np.zeros((radix, cells // radix), np.uint8)
    counted = docs.select("text").mapInArrow(runs, "part int, found binary, n binary").groupBy("part").applyInArrow(count, "part int, levels binary")
    for r in counted.toLocalIterator():  # `cells` bytes in all
        levels[r["part"]] = np.frombuffer(zlib.decompress(r["levels"]), np.uint8)
    return levels.ravel()


def named_sets(docs: DataFrame) -> DataFrame:
    """``(doc_id, node, n, spread)`` of all texts."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, data, bounds in arrays.text_slices(batch.column(1)):
            hashes, of_text = shingle_sets(data, bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, len(bounds) - 1), pa.array(set_names(hashes, of_text)), pa.array(np.diff(of_text)),
                 pa.array([v.tobytes() for v in spread(hashes, of_text)], pa.binary())], names=["doc_id", "node", "n", "spread"])

    return docs.mapInArrow(by_slices(work), "doc_id long, node long, n long, spread binary")


def fronts(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """``(token, node, n, place)``: the shingles at the front of each set, rarest first. Sets with similarity 0.8 and more share
    one. Shingles that stand in one text only are left out, as they are shared with nobody."""
    level = docs.sparkSession.sparkContext.broadcast(levels)
    shift = np.uint64(64 - (len(levels).bit_length() - 1))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, data, bounds in arrays.text_slices(batch.column(1)):
            hashes, of_text = shingle_sets(data, bounds)
            n = np.diff(of_text)
            text = np.repeat(np.arange(len(n)), n)
            common = level.value[(hashes >> shift).astype(np.int64)].astype(np.uint64)
            order = np.lexsort(((common << np.uint64(58)) | (hashes >> np.uint64(6)), text))
            place = np.arange(len(hashes)) - of_text[:-1][text]
            taken = (place < (n + (-4 * n // 5) + 1)[text]) & (common[order] > 0)
            node = set_names(hashes, of_text)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[order][taken].view(np.int64)), pa.array(node[text[taken]]), pa.array(n[text[taken]]),
                                              pa.array(place[taken])], names=["token", "node", "n", "place"])

    return docs.mapInArrow(by_slices(work), "token long, node long, n long, place long")


def divide_skip(query: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Which of ``sets`` share as many elements with ``query`` as they need."""
    sizes = np.array([len(s) for s in sets])
    need = required(len(query), sizes)
    possible = (need <= sizes) & (need <= len(query))
    if not possible.any():
        return possible
    members = np.repeat(np.arange(len(sets)), sizes)
    elements = np.concatenate(sets)
    place = np.minimum(np.searchsorted(query, elements), len(query) - 1)
    shared = (query[place] == elements) & possible[members]
    place, members = place[shared], members[shared]
    order = np.lexsort((members, place))
    place, members = place[order], members[order]  # inverted lists, one after the other
    starts = np.searchsorted(place, np.arange(len(query) + 1))
    lengths = np.diff(starts)
    threshold = int(need[possible].min())
    longest = int(lengths.max(initial=0))
    aside = min(threshold - 1, int(threshold / (WEIGHT * math.log2(max(2, longest)) + 1)))
    by_length = np.argsort(-lengths, kind="stable")
    long_, short = by_length[:aside], by_length[aside:]
    lists = [members[starts[k]:starts[k + 1]].tolist() for k in short.tolist() if lengths[k]]
    count = np.zeros(len(sets), np.int64)
    for member, run in groupby(heapq.merge(*lists)):
        count[member] = sum(1 for _ in run)
    alive = np.flatnonzero(possible & (count >= need - aside))
    if len(alive) and len(long_):
        keys = place * len(sets) + members  # ascending
        probes = long_[:, None] * len(sets) + alive[None, :]
        found = np.searchsorted(keys, probes)
        hit = (found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] == probes) if len(keys) else np.zeros(probes.shape, bool)
        count[alive] += hit.sum(0)
    out = np.zeros(len(sets), bool)
    out[alive] = count[alive] >= need[alive]
    return out


def possible(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """The pairs ``(q, c)`` that the bound does not exclude. ``shapes`` is ``(node, n, spread)``, one row per node."""
    side = lambda k: shapes.select(F.col("node").alias(f"{k}_node"), F.col("n").alias(f"{k}_n"), F.col("spread").alias(f"{k}_spread"))
    q, c = side("q"), side("c")
    both = pairs.join(q, pairs["q"] == q["q_node"]).join(c, F.col("c") == c["c_node"]).select("q", "c", "q_n", "c_n", "q_spread", "c_spread")

    def check(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, PARTS) for k in ("q_spread", "c_spread"))
        ok = pa.array(may_be_similar(a, b, batch.column("q_n").to_numpy(), batch.column("c_n").to_numpy()))
        yield batch.select(["q", "c"]).filter(ok)

    return both.mapInArrow(by_slices(check), "q long, c long")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(q, c)`` that are similar. Candidates of one query are dealt to blocks of a bounded size."""
    sizes = pairs.groupBy(F.col("q").alias("w")).agg(F.count("*").alias("m"))
    dealt = pairs.join(sizes, pairs["q"] == sizes["w"]).select(
        "q", "c", F.pmod(F.xxhash64("c"), 1 + F.floor(F.col("m") / BLOCK)).alias("block"))
    found = dealt.join(sets, dealt["c"] == sets["node"]).select("q", "block", "c", "items")
    asked = dealt.select("q", "block").distinct().join(sets, F.col("q") == sets["node"]).select("q", "block", F.lit(None).cast("long").alias("c"), "items")

    def search(table: pa.Table) -> pa.Table:
        c, items, q = table.column("c").to_pylist(), table.column("items").to_pylist(), table.column("q")[0].as_py()
        query = next(np.frombuffer(s, np.uint64) for i, s in zip(c, items, strict=True) if i is None)
        others = [(i, np.frombuffer(s, np.uint64)) for i, s in zip(c, items, strict=True) if i is not None]
        ok = divide_skip(query, [s for _, s in others])
        good = [i for (i, _), k in zip(others, ok, strict=True) if k]
        return pa.table({"a": pa.array([q] * len(good), pa.int64()), "b": pa.array(good, pa.int64())})

    return found.unionByName(asked).groupBy("q", "block").applyInArrow(search, "a long, b long")


def joined_classes(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, label)`` after the classes that new links connect have become one, named by the smallest label.

    Works on labels, of which the new links touch few: neighbours' labels and jumps, until nothing changes.
    """
    small = lambda df: in_tables(df, free=False)
    side = lambda k: labels.select(F.col("node").alias(f"n_{k}"), F.col("label").alias(k))
    edges = links.join(side("x"), F.col("a") == F.col("n_x")).join(side("y"), F.col("b") == F.col("n_y")).where("x <> y").select("x", "y")
    both = small(edges.union(edges.select("y", "x")).distinct())
    found = small(both.groupBy(F.col("x").alias("was")).agg(F.min("y").alias("near")).select("was", F.least("was", "near").alias("now")))
    moved = True
    while moved:
        near = both.join(found, both["y"] == found["was"]).groupBy("x").agg(F.min("now").alias("near"))
        step = small(found.join(near, found["was"] == near["x"]).select("was", F.col("now").alias("old"), F.least("now", "near").alias("now")))
        ahead = step.select(F.col("was").alias("w"), F.col("now").alias("jump"))
        after = small(step.join(ahead, step["now"] == ahead["w"]).select("was", F.least("now", "jump").alias("now"), (F.least("now", "jump") < F.col("old")).alias("moved")))
        drop(found, step)
        found, moved = after, not after.where("moved").isEmpty()
    out = in_tables(labels.join(found, labels["label"] == found["was"], "left").select("node", F.coalesce("now", "label").alias("label")))
    drop(both, found, labels)
    return out


def marked(rows: DataFrame, column: str) -> np.ndarray:
    """Bits at the places, modulo a fixed number, of the values of a column: what has no bit is not among them.

    The table is the same size however many values there are; it spares texts that nobody asks for a shuffle.
    """
    place = F.pmod(column, F.lit(MARKS)) + 1  # these functions count from 1
    parts = rows.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(MARKS // 8, np.uint8)
    for r in parts.collect():  # MARKS bits in all
        at = (r["part"] - 1) * 4096
        out[at:at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _fits(n: str, m: str, i: str, j: str) -> str:
    """Whether sets of these sizes can be similar if the shingle at places ``i`` and ``j`` is the first that they share."""
    return f"5 * least({n}, {m}) >= 4 * greatest({n}, {m}) and 9 * least({n} - {i}, {m} - {j}) >= 4 * ({n} + {m})"


def similar_classes(docs: DataFrame, worth: float = WORTH, cells: int = CELLS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: every text with the smallest id of its class.

    Null texts and texts without words have no shingles and are linked with nothing. Rows with one id are rows of their own.
    Shingles and sets are told apart by hashes of 64 bits. ``worth`` is the share of tested pairs that have to be similar for one
    more round with leaders; it and ``cells`` change the plan, never the classes.
    """
    docs = documents(docs)
    front = in_tables(fronts(docs, shingle_levels(docs, cells)))
    named = in_tables(named_sets(docs))
    shared = front.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select(F.col("token").alias("t"))
    lists = in_tables(front.join(shared, front["token"] == shared["t"], "left_semi").groupBy("token", "node", "n", "place").agg(F.lit(1)).select(*front.columns))
    drop(front)
    nodes = in_tables(lists.select("node").distinct())

    by_node = named.groupBy("node").agg(F.min("doc_id").alias("holder"), F.first("n").alias("n"), F.first("spread").alias("spread"))
    shapes = in_tables(by_node.join(nodes.select(F.col("node").alias("x")), F.col("node") == F.col("x"), "left_semi"))

    def sets_of(pairs: DataFrame) -> DataFrame:
        """``(node, items)`` of the nodes of the pairs, from one text of each."""
        wanted = pairs.select(F.explode(F.array("q", "c")).alias("w")).distinct()
        holders = in_tables(shapes.join(wanted, shapes["node"] == wanted["w"], "left_semi").select(F.col("node").alias("wanted"), "holder").distinct(), free=False)
        bits = docs.sparkSession.sparkContext.broadcast(marked(holders, "holder"))

        def items(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            keys = batch.column(0).to_numpy()
            batch = batch.filter(pa.array((bits.value[keys % MARKS >> 3] >> (keys % MARKS & 7) & 1).astype(bool)))
            for row, data, bounds in arrays.text_slices(batch.column(1)):
                hashes, of_text = shingle_sets(data, bounds)
                raw = hashes.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(bounds) - 1), pa.array(set_names(hashes, of_text)),
                     pa.array([raw[8 * a:8 * b] for a, b in zip(of_text[:-1].tolist(), of_text[1:].tolist(), strict=True)], pa.binary())],
                    names=["doc_id", "node", "items"])

        found = docs.mapInArrow(by_slices(items), "doc_id long, node long, items binary")
        return found.join(holders, (found["doc_id"] == holders["holder"]) & (found["node"] == holders["wanted"]), "left_semi").select("node", "items")

    def links_of(pairs: DataFrame) -> DataFrame:
        near = in_tables(possible(pairs, shapes))
        sets = in_tables(sets_of(near))
        found = in_tables(similar(near, sets))
        drop(near, sets)
        return found

    labels, tested, asked, found, last = in_tables(nodes.select("node", F.col("node").alias("label"))), 0, 0, 1, False
    crowding = False
    for turn in count_up():
        own = labels.select(F.col("node").alias("x"), "label")
        members = in_tables(lists.join(own, lists["node"] == own["x"]).select(*lists.columns, "label"))
        by_token = members.groupBy(F.col("token").alias("t"))
        ends = [F.min("label").alias("lo"), F.max("label").alias("hi")]
        leads = not crowding and found > worth * tested
        if not leads:
            classes = members.groupBy(F.col("token").alias("t"), "label").agg(F.lit(1).alias("one")).groupBy("t").agg(F.count("*").alias("classes"))
            crowded = in_tables(classes.where(F.col("classes") > CROWD).select("t"))
            last = crowding and found <= CROWD_WORTH * asked or crowded.isEmpty()
            crowding = True
        if leads:
            order = F.xxhash64("node", F.lit(turn))
            heads = by_token.agg(*ends, *[F.min_by(c, order).alias(f"l_{c}") for c in ("node", "n", "place", "label")]).where("lo < hi")
            met = members.join(heads, members["token"] == heads["t"]).where("label <> l_label and " + _fits("n", "l_n", "place", "l_place"))
            nth = F.row_number().over(Window.partitionBy("c").orderBy(F.xxhash64("q", F.lit(turn)), "q"))
            pairs = met.select(F.col("l_node").alias("q"), F.col("node").alias("c")).distinct().withColumn("nth", nth).where(F.col("nth") <= MET).select("q", "c")
        elif not last:
            # Sets of one size can be similar by a shingle only if its place is within a ninth of them.
            inside = in_tables(members.where("9 * place <= n").join(crowded, members["token"] == crowded["t"], "left_semi"))
            asked = inside.select("node").distinct().count()
            order = F.xxhash64("node", F.lit(turn))
            heads = inside.groupBy(F.col("token").alias("t"), F.pmod(order, F.lit(LEADERS)).alias("nth")).agg(
                *[F.min_by(c, order).alias(f"l_{c}") for c in ("node", "n", "place", "label")])
            one = inside.groupBy("node", "n", "label").agg(F.min_by(F.struct("token", "place"), F.xxhash64("token", F.lit(turn))).alias("own")).select(
                "node", "n", "label", "own.*")
            met = one.join(heads, one["token"] == heads["t"]).where("label <> l_label and " + _fits("n", "l_n", "place", "l_place"))
            pairs = met.select(F.col("l_node").alias("q"), F.col("node").alias("c")).distinct()
        else:
            mixed = by_token.agg(*ends).where("lo < hi").select("t")
            left = in_tables(members.join(mixed, members["token"] == mixed["t"], "left_semi"))
            right = left.select(F.col("token").alias("t2"), *[F.col(c).alias(f"{c}2") for c in ("node", "n", "place", "label")])
            met = left.join(right, left["token"] == right["t2"]).where("node < node2 and label <> label2 and " + _fits("n", "n2", "place", "place2"))
            pairs = met.select(F.col("node").alias("q"), F.col("node2").alias("c")).distinct()
        pairs = in_tables(pairs)
        tested = pairs.count()
        links = links_of(pairs)
        found = links.count()
        drop(members, pairs)
        labels = joined_classes(labels, links)
        drop(links)
        if last:
            break

    own = labels.select(F.col("node").alias("x"), "label")
    classed = in_tables(named.join(own, named["node"] == own["x"], "left").select("doc_id", "n", "node", F.coalesce("label", "node").alias("label")))
    drop(named, lists, shapes)
    first = classed.where("n > 0").groupBy(F.col("label").alias("y")).agg(F.min("doc_id").alias("first"))
    return classed.join(first, (classed["label"] == first["y"]) & (classed["n"] > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))
