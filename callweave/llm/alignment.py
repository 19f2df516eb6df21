"""Alignment of two tokenizers over a corpus: which tokens of one stand where tokens of the other do, and how often.

A document is read by tokenizer A (byte-level BPE, with a space before the text) and by B (sentence pieces, which adds that
space itself). Places where tokens of both end cut the text into groups; each token of A in a group is linked with each of B in
it. The number of a pair of ids is that of the documents that hold it linked.

Neither tokenizer joins what stands on the two sides of a space that follows a character that is no white space: A's splitting
pattern ends there, and no piece of B holds a space behind another character (checked when it is loaded). So both tokenizers are
asked once for each unit between such places that a worker meets, and groups never leave a unit.

Counting is external and never has an unbounded list in one place:

1. a task gathers records (pair, document, links) up to a bound, deals them by the low bits of A's id to buckets, sorts each and
   writes it as a compressed run: the pairs with their numbers of documents apart from the documents. One more row holds the
   documents of the run;
2. runs of a bucket are merged by a heap, `FAN` at a time, until one is left for each bucket: pairs and their numbers, in the
   order of A's ids, so all pairs of an id are in one bucket, one after the other, and its highest number is known when its
   last pair has passed. A merge holds numbers only, never documents; a bucket's pairs are bounded by the vocabularies;
3. the numbers stream back the way the runs came: each merge is walked again by its heap, next to its own totals, and hands every
   run those of its pairs. In the lowest merges each run adds up what its documents get;
4. a run's documents meet these sums, one row for each bucket.

Results where input is unusual: a null or empty text, or one that a tokenizer does not give back byte by byte (such as one with
U+2581), has no tokens: zeros and an empty text of groups. Special tokens in a text are plain text. Repeated rows are documents
of their own and count each. Ties of the highest number are all highest. A very long text is held whole by its task, and is more than
one run's records where it has more. Other columns are not read; an empty table gives no rows. Rows without an id are left out.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm import arrays, tokens
from callweave.llm.tables import by_slices, documents, in_tables

SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BUCKETS = 128
RECORDS = 1 << 21  # of a run
DOCUMENTS = 1 << 14  # of a run
FAN = 8  # runs that are merged at once
WIDE = 4096  # links of a group, beyond which it is counted by its distinct ids
MEMORY = 1 << 18  # remembered units; beyond it they are forgotten, which changes time only

RUNS = ("run long, bucket int, pairs binary, found binary, "
        "doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>")
_FIELDS = ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests")
_RUNS = pa.schema([("run", pa.int64()), ("bucket", pa.int32()), ("pairs", pa.binary()), ("found", pa.binary()),
                   *((f, pa.list_(pa.string() if f == "digests" else pa.int64())) for f in _FIELDS)])
_MERGED = "bucket int, run long, pairs binary"
_TOTALS = "bucket int, run long, totals binary"
_SUMS = "run long, sums binary"
_RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


# --- columns of whole numbers as compressed bytes -------------------------------------------------------------------------

def packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length; bytes of equal weight lie together, which is what compresses."""
    import zstandard

    n = len(columns[0])
    planes = [np.ascontiguousarray(c, "<u8").view(np.uint8).reshape(n, 8).T.tobytes() for c in columns]
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(data: bytes) -> list[np.ndarray]:
    import zstandard

    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8)
    return [np.ascontiguousarray(c.T).view("<u8").ravel().astype(np.int64) for c in raw.reshape(-1, 8, n)] if n else [np.empty(0, np.int64)] * 3


# --- units ----------------------------------------------------------------------------------------------------------------

class Pool:
    """A numpy array that grows at its end."""

    def __init__(self) -> None:
        self.held, self.n = np.empty(1 << 16, np.int64), 0

    def extend(self, more: np.ndarray) -> None:
        while self.n + len(more) > len(self.held):
            self.held = np.concatenate([self.held, np.empty(len(self.held), np.int64)])
        self.held[self.n:self.n + len(more)] = more
        self.n += len(more)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.held[at]


class Aligner:
    """Both tokenizers, with a memory of units: stretches of text that begin with a space.

    A unit has a number. ``text`` are its groups, ``counts`` its numbers of tokens of A and of B, groups and links (four each),
    ``valid`` whether both sides give its bytes back, and ``pairs`` and ``links`` up to ``ends`` its distinct pairs.
    """

    def __init__(self, side_a: str | None = None, side_b: str | None = None) -> None:
        from sentencepiece import SentencePieceProcessor

        self.coder = tokens.Encoder(side_a or tokens.vocabulary_path(SIDE_A))
        self.coder.special = []
        self.a = self.coder.model
        self.a.encode_special_tokens = True
        byte_of = {chr(b): b for b in tokens._SHOWN} | {chr(c): b for b, c in tokens._AS_TEXT.items()}
        names = self.a.get_vocab()
        # What is no byte's sign (only a special token has such) is no byte either: its length then differs from the text's.
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for t, i in names.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in t if c in byte_of)
        self.b = SentencePieceProcessor(model_file=side_b or tokens.vocabulary_path(SIDE_B))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a space behind another character, so units cannot be read by themselves")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.decimal = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        self._empty()

    def _empty(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.text: list[str] = []
        self.counts, self.valid, self.ends, self.pairs, self.links = (Pool() for _ in range(5))
        self.ends.extend(np.zeros(1, np.int64))

    def _b_ids(self, units: list[str]) -> list[list[int]]:
        """B's ids. It adds a space to what it is given; units that are nothing but spaces stand behind a letter."""
        asked = ["x" + u if not u.strip(" ") else u[1:] for u in units]
        return [ids[1:] if len(t) > len(u) else ids for ids, t, u in zip(self.b.encode(asked, num_threads=1), asked, units, strict=True)]

    def learn(self, units: list[bytes]) -> None:
        raw = b"".join(units)
        n = len(units)
        bounds = np.cumsum([0, *map(len, units)])
        a, a_first = self.coder.encode(np.frombuffer(raw, np.uint8), bounds)
        b_lists = self._b_ids([u.decode() for u in units])
        b_first = np.cumsum([0, *map(len, b_lists)])
        b = np.fromiter(chain.from_iterable(b_lists), np.int64, int(b_first[-1]))
        a = a.astype(np.int64)
        valid = self._gives_back(units, bounds, a, a_first, b, b_first)
        # Places in the joined units, at which tokens end; those of units that are not valid count for nothing.
        unit_a, unit_b = np.repeat(np.arange(n), np.diff(a_first)), np.repeat(np.arange(n), np.diff(b_first))
        good_a, good_b = valid[unit_a], valid[unit_b]
        a, unit_a, b, unit_b = a[good_a], unit_a[good_a], b[good_b], unit_b[good_b]
        length = np.diff(bounds) * valid
        base = np.cumsum(length) - length
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common = np.intersect1d(a_end, b_end)
        unit_g = np.searchsorted(base + length, common)  # the unit that a group lies in: the first that ends there or later
        a_edge = np.concatenate([[0], np.searchsorted(a_end, common, "right")])
        b_edge = np.concatenate([[0], np.searchsorted(b_end, common, "right")])
        pairs, links, unit_p = self._links(a, b, a_edge, b_edge, unit_g)
        dec = self.decimal
        shown_a, shown_b = [dec[i] for i in a.tolist()], [dec[i] for i in b.tolist()]
        ea, eb = a_edge.tolist(), b_edge.tolist()
        texts = [",".join(shown_a[ea[k]:ea[k + 1]]) + "|" + ",".join(shown_b[eb[k]:eb[k + 1]]) for k in range(len(common))]
        g_edge = np.searchsorted(unit_g, np.arange(n + 1)).tolist()
        self.slot.update(zip(units, range(len(self.text), len(self.text) + n), strict=True))
        self.text += [texts[s] if e == s + 1 else ";".join(texts[s:e]) for s, e in zip(g_edge[:-1], g_edge[1:], strict=True)]
        count = lambda of, weight=None: np.bincount(of, weight, n).astype(np.int64)
        total = np.zeros(n, np.int64)
        np.add.at(total, unit_p, links)
        self.counts.extend(np.column_stack([count(unit_a), count(unit_b), count(unit_g), total]).ravel())
        self.valid.extend(valid.astype(np.int64))
        self.ends.extend(self.pairs.n + np.cumsum(count(unit_p)))
        self.pairs.extend(pairs)
        self.links.extend(links)

    def _gives_back(self, units: list[bytes], bounds: np.ndarray, a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray) -> np.ndarray:
        """Which units both sides give back byte by byte."""
        ok = np.ones(len(units), bool)
        for ids, first, table in ((a.tolist(), a_first.tolist(), self.a_bytes), (b.tolist(), b_first.tolist(), self.b_bytes)):
            back = [table[i] for i in ids]
            if b"".join(back) == b"".join(units) and np.array_equal(np.concatenate([[0], np.cumsum([len(x) for x in back])])[first], bounds):
                continue
            ok &= [b"".join(back[s:e]) == u for s, e, u in zip(first[:-1], first[1:], units, strict=True)]
        return ok

    def _links(self, a: np.ndarray, b: np.ndarray, a_edge: np.ndarray, b_edge: np.ndarray, unit_g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each unit with their numbers of links, and their units. Groups with very many tokens on both sides are
        counted by their distinct ids."""
        na, nb = np.diff(a_edge), np.diff(b_edge)
        wide = np.flatnonzero(na * nb > WIDE)
        plain = np.flatnonzero(na * nb <= WIDE)
        size = (na * nb)[plain]
        group = np.repeat(plain, size)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
        x, y = a[a_edge[group] + nth // nb[group]], b[b_edge[group] + nth % nb[group]]
        unit, pair, n = [unit_g[group]], [x << 32 | y], [np.ones(len(group), np.int64)]
        for g in wide.tolist():
            ids_a, n_a = np.unique(a[a_edge[g]:a_edge[g + 1]], return_counts=True)
            ids_b, n_b = np.unique(b[b_edge[g]:b_edge[g + 1]], return_counts=True)
            unit.append(np.full(len(ids_a) * len(ids_b), unit_g[g]))
            pair.append((ids_a[:, None] << 32 | ids_b).ravel())
            n.append((n_a[:, None] * n_b).ravel())
        unit, pair, n = np.concatenate(unit), np.concatenate(pair), np.concatenate(n)
        order = np.lexsort((pair, unit))
        unit, pair, n = unit[order], pair[order], n[order]
        first = np.flatnonzero((np.diff(unit, prepend=-1) != 0) | (np.diff(pair, prepend=-1) != 0))
        return pair[first], np.add.reduceat(n, first) if len(first) else n, unit[first]

    def units(self, raw: bytes, starts: np.ndarray) -> np.ndarray:
        """Numbers of the units of a slice, valid until the next call."""
        ends = [*starts[1:].tolist(), len(raw)]
        names = [raw[s:e] for s, e in zip(starts.tolist(), ends, strict=True)]
        if len(self.text) >= MEMORY:
            self._empty()
        if new := list(set(names).difference(self.slot)):
            self.learn(new)
        return np.fromiter(map(self.slot.__getitem__, names), np.int64, len(names))


@lru_cache(maxsize=1)
def aligner(side_a: str | None = None, side_b: str | None = None) -> Aligner:
    """This worker's aligner."""
    return Aligner(side_a, side_b)


# --- runs -----------------------------------------------------------------------------------------------------------------

class Gathered:
    """Records of a run until there are enough."""

    def __init__(self, run: int, buckets: int) -> None:
        self.run, self.buckets = run, buckets
        self.records: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs: list[list] = [[] for _ in _FIELDS]
        self.n = 0

    def add(self, doc: np.ndarray, pair: np.ndarray, links: np.ndarray) -> None:
        self.records.append((doc, pair, links))
        self.n += len(doc)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row for the documents, and a sorted run for each bucket."""
        none = [None] * len(_FIELDS)
        rows: list[list] = [[self.run, None, None, None, *self.docs]]
        if self.records:
            doc, pair, links = (np.concatenate(c) for c in zip(*self.records, strict=True))
            bucket = (pair >> 32) % self.buckets
            order = np.lexsort((pair, bucket))  # documents stay in order
            doc, pair, links, bucket = doc[order], pair[order], links[order], bucket[order]
            first = np.ones(len(doc), bool)
            first[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
            at = np.flatnonzero(first)
            doc, pair, bucket, links = doc[at], pair[at], bucket[at], np.add.reduceat(links, at)
            edges = np.searchsorted(bucket, np.arange(self.buckets + 1))
            for b, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                if e > s:
                    pairs, n = np.unique(pair[s:e], return_counts=True)
                    rows.append([self.run, b, packed(pairs, n), packed(doc[s:e], links[s:e]), *none])
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _RUNS, strict=True)], schema=_RUNS)


def runs(docs: DataFrame, side_a: str | None = None, side_b: str | None = None, buckets: int = BUCKETS, records: int = RECORDS) -> DataFrame:
    """Sorted runs of the records of ``(doc_id, text)``, as a stored table."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = aligner(side_a, side_b), TaskContext.get().partitionId() << 32, 0
        held = Gathered(part, buckets)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for row, data, bounds in arrays.text_slices(batch.column(1), rows=DOCUMENTS // 4):
                data, starts, bounds = spaced(data, bounds)
                units = coder.units(data.tobytes(), starts)
                _described(held, keys[row:row + len(bounds) - 1], coder, units, np.searchsorted(starts, bounds))
                if held.n >= records or len(held.docs[0]) >= DOCUMENTS // 2:
                    yield from held.rows()
                    number += 1
                    held = Gathered(part | number, buckets)
        if held.docs[0]:
            yield from held.rows()

    return in_tables(documents(docs).mapInArrow(work, RUNS))


def group_texts(coder: Aligner, units: np.ndarray, of_doc: np.ndarray) -> list[str]:
    """The groups of each document, which has the units ``of_doc[i] .. of_doc[i + 1]``; without tokens an empty text."""
    texts = [coder.text[u] for u in units.tolist()]
    bad = np.concatenate([[0], np.cumsum(coder.valid[units] == 0)])[of_doc]
    return [";".join(texts[s:e]) if good else "" for s, e, good in zip(of_doc[:-1].tolist(), of_doc[1:].tolist(), (bad[1:] == bad[:-1]).tolist(), strict=True)]


def groups(docs: DataFrame, side_a: str | None = None, side_b: str | None = None) -> DataFrame:
    """``(doc_id, groups)``: the groups of every document as text, `a1,a2|b1;a3|b2,b3`."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, data, bounds in arrays.text_slices(batch.column(1)):
            data, starts, bounds = spaced(data, bounds)
            coder = aligner(side_a, side_b)
            texts = group_texts(coder, coder.units(data.tobytes(), starts), np.searchsorted(starts, bounds))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), pa.array(texts, pa.string())], names=["doc_id", "groups"])

    return documents(docs).mapInArrow(by_slices(work), "doc_id long, groups string")


def spaced(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a space before each that is not empty: ``(bytes, where units start, bounds)``."""
    sizes = np.diff(bounds)
    data = np.insert(data, bounds[:-1][sizes > 0], 32)
    bounds = np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])
    starts = tokens.unit_starts(data, bounds, letters=False)
    return data, starts[data[starts] == 32], bounds


def _described(held: Gathered, keys: list[int], coder: Aligner, units: np.ndarray, of_doc: np.ndarray) -> None:
    """Add some documents with their units to a run."""
    first = len(held.docs[0])
    doc = np.repeat(np.arange(len(keys)), np.diff(of_doc))
    valid = np.ones(len(keys), bool)
    valid[doc[coder.valid[units] == 0]] = False
    counts = np.zeros((len(keys), 4), np.int64)
    np.add.at(counts, doc, coder.counts[units[:, None] * 4 + np.arange(4)])
    counts[~valid] = 0
    held.docs[0] += keys
    for k in range(4):
        held.docs[k + 1] += counts[:, k].tolist()
    held.docs[5] += [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in group_texts(coder, units, of_doc)]
    keep = valid[doc]
    key, times = np.unique(doc[keep] * len(coder.text) + units[keep], return_counts=True)
    doc, unit = key // max(1, len(coder.text)), key % max(1, len(coder.text))
    start = coder.ends[unit]
    n = coder.ends[unit + 1] - start
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    held.add(np.repeat(doc, n) + first, coder.pairs[at], coder.links[at] * np.repeat(times, n))


# --- merges ---------------------------------------------------------------------------------------------------------------

def walk(children: list[np.ndarray]) -> Iterator[tuple[int, list[int]]]:
    """Each pair in ascending order with the runs that hold it, by a heap over the heads of the runs."""
    heads = heapq.merge(*(zip(c.tolist(), repeat(i)) for i, c in enumerate(children)))
    for pair, own in groupby(heads, itemgetter(0)):
        yield pair, [i for _, i in own]


def merged(children: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One run of pairs and numbers from several."""
    numbers = [c[1].tolist() for c in children]
    at = [0] * len(children)
    pairs, out = [], []
    for pair, own in walk([c[0] for c in children]):
        total = 0
        for i in own:
            total += numbers[i][at[i]]
            at[i] += 1
        pairs.append(pair)
        out.append(total)
    return np.array(pairs, np.int64), np.array(out, np.int64)


def streamed_back(children: list[list[np.ndarray]], above: list[np.ndarray] | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each run the corpus-wide number of each of its pairs and whether it is the highest of A's id.

    ``above`` has both for the pairs of all these runs together, in order; None where these are all runs of the bucket, so that
    numbers are added up here and the highest is known at the last pair of an id.
    """
    back: list[tuple[list[int], list[int]]] = [([], []) for _ in children]

    def hand(total: int, best: int, own: list[int]) -> None:
        for i in own:
            back[i][0].append(total)
            back[i][1].append(best)

    if above is not None:
        for (_, own), total, best in zip(walk([c[0] for c in children]), above[0].tolist(), above[1].tolist(), strict=True):
            hand(total, best, own)
    else:
        numbers, at = [c[1].tolist() for c in children], [0] * len(children)
        for _, pairs in groupby(walk([c[0] for c in children]), lambda p: p[0] >> 32):
            waiting = []
            for _, own in pairs:
                total = 0
                for i in own:
                    total += numbers[i][at[i]]
                    at[i] += 1
                waiting.append((total, own))
            most = max(t for t, _ in waiting)
            for total, own in waiting:
                hand(total, int(total == most), own)
    return [(np.array(t, np.int64), np.array(b, np.int64)) for t, b in back]


def _children(table: pa.Table) -> list[list[np.ndarray]]:
    return [unpacked(p) for p in table.column("pairs").to_pylist()]


def merge_up(level: DataFrame, groups: int) -> DataFrame:
    """Runs ``(bucket, run, pairs)`` merged to ``groups`` for each bucket; a merged run is named by its group."""
    def up(table: pa.Table) -> pa.Table:
        run = table.column("grp")[0].as_py()
        return pa.table({"bucket": table.column("bucket")[:1], "run": pa.array([run], pa.int64()), "pairs": pa.array([packed(*merged(_children(table)))], pa.binary())})

    return level.select("bucket", "run", "pairs", _group(groups)).groupBy("bucket", "grp").applyInArrow(up, _MERGED)


def _group(groups: int) -> F.Column:
    return F.pmod(F.xxhash64("run"), F.lit(groups)).alias("grp")


def _sums(table: pa.Table, back: list[tuple[np.ndarray, np.ndarray]], children: list[list[np.ndarray]]) -> pa.Table:
    """What the documents of each run get from a bucket: links with the highest number, and numbers added up over links."""
    out = []
    for found, (totals, best), child in zip(table.column("found").to_pylist(), back, children, strict=True):
        doc, links = unpacked(found)
        ids, which = np.unique(doc, return_inverse=True)
        n = child[1]
        sums = np.zeros((2, len(ids)), np.int64)
        np.add.at(sums[0], which, links * np.repeat(best, n))
        np.add.at(sums[1], which, links * np.repeat(totals, n))
        out.append(packed(ids, sums[0], sums[1]))
    return pa.table({"run": table.column("run"), "sums": pa.array(out, pa.binary())})


def stream_down(level: DataFrame, groups: int, above: DataFrame | None) -> DataFrame:
    """Totals for runs; for runs that carry documents (a column ``found``) what their documents get of them."""
    leaf = "found" in level.columns

    def down(table: pa.Table, totals: list[np.ndarray] | None) -> pa.Table:
        children = _children(table)
        back = streamed_back(children, totals)
        if leaf:
            return _sums(table, back, children)
        return pa.table({"bucket": table.column("bucket"), "run": table.column("run"), "totals": pa.array([packed(*b) for b in back], pa.binary())})

    schema = _SUMS if leaf else _TOTALS
    own = level.select(*level.columns, _group(groups)).groupBy("bucket", "grp")
    if above is None:
        return own.applyInArrow(lambda table: down(table, None), schema)
    return own.cogroup(above.withColumn("grp", F.col("run")).groupBy("bucket", "grp")).applyInArrow(
        lambda table, totals: down(table, unpacked(totals.column("totals")[0].as_py())), schema)


def fan_in(n: int, fan: int) -> list[int]:
    """How many groups the runs of a bucket have at each level, the last one 1."""
    out = []
    while not out or out[-1] > 1:
        n = -(-n // fan)
        out.append(max(n, 1))
    return out


def counted(stored: DataFrame, fan: int = FAN) -> DataFrame:
    """``(run, sums)`` for the runs of :func:`runs`."""
    sorted_runs = stored.where("bucket is not null").select("bucket", "run", "pairs", "found")
    steps = fan_in(stored.where("bucket is null").count(), fan)
    levels = [sorted_runs]
    for groups in steps[:-1]:
        levels.append(merge_up(levels[-1].select("bucket", "run", "pairs"), groups))
    above = None
    for level, groups in zip(reversed(levels), reversed(steps), strict=True):
        above = stream_down(level, groups, above)
    return above


def pair_counts(docs: DataFrame, side_a: str | None = None, side_b: str | None = None, buckets: int = BUCKETS, records: int = RECORDS, fan: int = FAN) -> DataFrame:
    """``(a_id, b_id, n_docs)``: in how many documents each pair of ids is linked."""
    stored = runs(docs, side_a, side_b, buckets, records)
    level = stored.where("bucket is not null").select("bucket", "run", "pairs")
    for groups in fan_in(stored.where("bucket is null").count(), fan):
        level = merge_up(level, groups)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                pair, n = unpacked(raw)
                yield pa.RecordBatch.from_arrays([pa.array(pair >> 32), pa.array(pair & 0xFFFFFFFF), pa.array(n)], names=["a_id", "b_id", "n_docs"])

    return level.select("pairs").mapInArrow(rows, "a_id long, b_id long, n_docs long")


def aligned(docs: DataFrame, side_a: str | None = None, side_b: str | None = None, buckets: int = BUCKETS, records: int = RECORDS, fan: int = FAN) -> DataFrame:
    """Every document with its tokens, groups and links, how many links are the commonest of A's id, and their numbers added up."""
    stored = runs(docs, side_a, side_b, buckets, records)
    sums = counted(stored, fan)
    held = stored.where("bucket is null").select("run", *_FIELDS)

    def finish(own: pa.Table, got: pa.Table) -> pa.Table:
        cols = [own.column(f)[0].values for f in _FIELDS]
        total = np.zeros((2, len(cols[0])), np.int64)
        for raw in got.column("sums").to_pylist():
            ids, best, sums = unpacked(raw)
            total[0, ids] += best
            total[1, ids] += sums
        return pa.table([*cols[:5], pa.array(total[0]), pa.array(total[1]), cols[5]],
                        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return held.groupBy("run").cogroup(sums.groupBy("run")).applyInArrow(finish, _RESULT)


__all__ = ["Aligner", "aligned", "counted", "groups", "merged", "pair_counts", "runs", "streamed_back"]
