"""Byte-level BPE by backtracking: token ids of whole texts from a table of ranks, and bytes back from ids.

A text is cut by the splitting pattern and each piece is encoded by itself. The bytes of a piece, read as Latin-1, go through an
Aho-Corasick automaton of all tokens, which gives the longest token from every byte on in one pass. Merging by rank has one
result, and a row of tokens is that result exactly when each two neighbours could stand side by side in it (Antweiler and
Neubeck's observation for BPE: whether two tokens are compatible depends on the two alone). So the encoder takes the longest
token, falls back to its next shorter prefix where the neighbour does not allow it, steps back where no prefix is left, and
never tries a byte again from which no way leads on. That is linear in the piece; what is known about pairs of tokens is
remembered, and so are pieces.

* A null text is empty and has no tokens; repeated rows stay rows of their own.
* No special tokens: their strings are ordinary text.
* A text is read in stretches of about a megabyte that end before a space after a letter or digit, where the pattern always
  ends a match, so a very long text is not held as a list of pieces. A single piece as long as a text is encoded as one.
* Other columns are not read and may have any names. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
from array import array
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm import arrays
from callweave.llm.tables import by_slices, documents

RANKS = "byte_bpe_50k.tiktoken"
STRETCH = 1 << 20  # characters of a text that are cut into pieces together
MEMORY = 1 << 19  # remembered pieces and pairs; beyond it they are forgotten, which changes time only
PARTED = "\u0100"
SHORT = 256  # bytes of a piece that is worth remembering

ENCODED = "doc_id long, ids array<int>"
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of base64 and number a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """What the ranks alone determine: prefixes, how each token was merged, and which tokens can be neighbours."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick

        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.size = [len(b) for b in self.bytes_of]
        self.longest_size = max(self.size, default=0)
        self.shorter = [next((ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in ranks), -1) for b in self.bytes_of]
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int] | None] = [None] * len(self.bytes_of)
        self.known: dict[int, bool] = {}
        for rank, token in enumerate(self.bytes_of):
            left = self.shorter[rank]
            while left >= 0:
                right = ranks.get(token[self.size[left]:], rank)
                if left < rank and right < rank and self._compatible(left, right):
                    self.halves[rank] = left, right
                    self.merged[left, right] = rank
                    break
                left = self.shorter[left]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank can leave the two side by side.

        Undo their merges from the last one on. Where the tokens at the border would have been merged before the merge that
        was undone last, they cannot. Equal ranks are merged from the left.
        """
        before = len(self.bytes_of) + 1  # a merge across the border of a rank below this came first
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            parts_left, parts_right = self.halves[left], self.halves[right]
            if parts_left is None and parts_right is None:
                return True
            if parts_right is None or parts_left is not None and left > right:
                before, left = left, parts_left[1]
            else:
                before, right = right + 1, parts_right[0]

    def neighbours(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            found = self.known[key] = self._compatible(left, right)
        return found

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        return self.encode_all([piece])[0]

    def encode_all(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces. They go through the automaton in one row, parted by a character that is no byte and so in no token.

        That gives the longest tokens from left to right, each from where the one before ends. Where a shorter one is taken, the
        automaton goes on from its end when it is asked.
        """
        text = PARTED.join([p.decode("latin-1") for p in pieces])
        longest = array("i", [-1]) * len(text)
        for end, (rank, size) in self.automaton.iter_long(text):
            longest[end - size + 1] = rank
        out, first = [], 0
        for piece in pieces:
            whole = self.ranks.get(piece)
            out.append(self._backtracked(text, longest, first, len(piece)) if whole is None else [whole])
            first += len(piece) + 1
        return out

    def _longest(self, text: str, at: int, end: int) -> int:
        """The longest token from ``at`` on."""
        return next(self.automaton.iter_long(text[at:min(end, at + self.longest_size)]), (0, (-1, 0)))[1][0]

    def _backtracked(self, text: str, longest: array, first: int, n: int) -> list[int]:
        """Ids of the piece of ``n`` bytes from ``first`` on."""
        size, shorter, known, neighbours = self.size, self.shorter, self.known, self.neighbours
        open_ = bytearray(b"\1") * (n + 1)  # ends from which there may be a way on
        out: list[int] = []
        at, last = 0, -1
        token = longest[first] if n else -1
        while at < n:
            while token >= 0:
                end = at + size[token]
                if open_[end] and (last < 0 or (ok if (ok := known.get(last << 32 | token)) is not None else neighbours(last, token))):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = longest[first + at] if at < n else -1
                if token < 0 and at < n:
                    token = longest[first + at] = self._longest(text, first + at, first + n)
            else:
                if not out:
                    raise ValueError("the table of ranks lacks single bytes")
                open_[at] = 0
                token = shorter[out.pop()]
                at -= size[last]
                last = out[-1] if out else -1
        return out


class Encoder:
    """Ids of texts, with a memory of pieces."""

    def __init__(self, path: str | None = None, pattern: str | None = None) -> None:
        import public_tokenizers
        import regex

        self.merges = Merges(read_ranks(path or public_tokenizers.path(RANKS)))
        self.pieces = regex.compile(pattern or public_tokenizers.PATTERN)
        self.border = regex.compile(r"(?<=[0-9A-Za-z]) ")
        self.memory: dict[str, bytes] = {}  # ids of pieces, four bytes each

    def stretches(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > STRETCH:
            cut = self.border.search(text, at + STRETCH)
            if cut is None:
                break
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> np.ndarray:
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        parts = []
        for stretch in self.stretches(text):
            pieces = self.pieces.findall(stretch)
            memory = self.memory
            if new := list(set(pieces).difference(memory)):
                learned = {p: array("i", ids).tobytes() for p, ids in zip(new, self.merges.encode_all([p.encode() for p in new]), strict=True)}
                if max(map(len, new)) <= SHORT:
                    memory.update(learned)
                else:
                    memory.update((p, ids) for p, ids in learned.items() if len(p) <= SHORT)
                    memory = ChainMap(learned, memory)
            parts.append(b"".join([memory[p] for p in pieces]))
        return np.frombuffer(b"".join(parts), np.int32)


@lru_cache(maxsize=2)
def encoder(path: str | None = None, pattern: str | None = None) -> Encoder:
    """This worker's encoder."""
    return Encoder(path, pattern)


@lru_cache(maxsize=2)
def token_bytes(path: str | None = None) -> list[bytes]:
    """The bytes of each id, empty for ids that are none."""
    import public_tokenizers

    ranks = read_ranks(path or public_tokenizers.path(RANKS))
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` of every row of ``(doc_id, text)``. Rows without an id cannot be reported and are left out.

    ``path`` is the file of ranks on the workers; ``pattern`` cuts texts into pieces and has to match every character.
    """
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for row, data, bounds in arrays.text_slices(batch.column(1)):
            n = len(bounds) - 1
            raw = data.tobytes()
            ids = [coder.encode(raw[a:b].decode()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), lists], schema=_ENCODED)

    return documents(docs).mapInArrow(by_slices(work), ENCODED)


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids, bytes)``: the bytes that the ids of each row stand for. A null list has no ids; an unknown id is an error."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bytes_of = token_bytes(path)
        lists = batch.column(1)
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
        if len(flat) and (flat.min() < 0 or flat.max() >= len(bytes_of)):
            raise ValueError("an id that is not in the table of ranks")
        text = [b"".join(map(bytes_of.__getitem__, flat[e - n:e].tolist())) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(text, pa.binary())], names=["doc_id", "ids", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(by_slices(work), f"{ENCODED}, bytes binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of a round trip from texts to ids and back to bytes."""
    back = decoded(encoded(docs, path, pattern), path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("bytes", 256).alias("decoded_sha256"))


__all__ = ["Encoder", "Merges", "decoded", "digests", "encoded", "read_ranks"]
