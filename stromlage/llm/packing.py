"""Packing documents into windows by multiway Karmarkar-Karp differencing.

A document's ids are cut into whole windows, which are sequences as they are,
and pieces of the rest. Pieces are gathered into blocks of a fixed number of
tokens. In a block every piece starts as a partition of its own, one window
holding it and all others empty; again and again the two partitions with the
largest imbalance are merged, the fullest windows of the one with the emptiest
of the other. What remains is one partition into near-equal windows. If one of
them exceeds the capacity, the block is partitioned anew into one window more.

Blocks are formed within a task, from its own documents: nothing is shuffled,
and a task holds the piece lengths of one block, never a group of documents.
"""

import base64
import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stromlage.llm.common import worker_cache
from stromlage.llm.token_counts import LONGEST_REMEMBERED, cuts_before_spaces, pieces

CAPACITY = 2048
#: Closes every document.
END_ID = 1
#: Windows of a block, and tokens a block leaves free so that its windows need not be equal to the token.
BLOCK_WINDOWS = 128
BLOCK_SLACK = 128
#: Longest piece of what remains of a document after its whole windows.
LONGEST_PIECE = 512
#: The last piece of a document is its length modulo this.
LEVELLING = 64
#: Encoded pieces that a worker remembers.
REMEMBERED = 800_000

# Beyond these, libraries may disagree on what a letter is; such texts go to the named tokenizer.
_settled = re.compile("[\x00-ɏ‐-‧‰-⁞€]*").fullmatch


def id_encoder(path: str, ranks: str | None, pattern: str | None) -> Callable[[str], np.ndarray]:
    """Text to ids as by the tokenizer file ``path``, added special tokens apart.

    ``ranks``, the same vocabulary as a rank file, and its split ``pattern``
    serve the texts that both treat alike; they are faster.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def exact(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    encode = exact
    if ranks is not None:
        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        quick = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})

        def encode(text: str) -> bytes:
            if _settled(text) and not any(s in text for s in special):
                return np.array(quick.encode_ordinary(text), "<u4").tobytes()
            return exact(text)

    if not cuts_before_spaces(path):
        return lambda text: np.frombuffer(encode(text), "<u4")
    return PieceIds(encode).ids


class PieceIds(dict):
    """Ids by piece (with a space before it); each worker remembers the latest pieces."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        found = self.encode(" " + piece)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                for old in list(self)[::2]:
                    del self[old]
            self[piece] = found
        return found

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        first, *rest = pieces(text)
        return np.frombuffer(self.encode(first) + b"".join(map(self.__getitem__, rest)), "<u4")


def difference(lengths: np.ndarray, windows: int) -> np.ndarray:
    """The window of each length: Karmarkar-Karp differencing into ``windows`` sums."""
    n = len(lengths)
    if windows == 1 or not n:
        return np.zeros(n, np.int64)
    sums: dict[int, np.ndarray] = {}
    for i, x in enumerate(lengths):
        sums[i] = np.zeros(windows, np.int64)
        sums[i][-1] = x
    heap = [(-int(x), i) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    merges = []
    for node in range(n, 2 * n - 1):
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(both, kind="stable")
        both = both[order]
        sums[node] = both - both[0]
        heapq.heappush(heap, (-int(sums[node][-1]), node))
        merges.append((a, b, order))
    window_of = {2 * n - 2: np.arange(windows)}
    out = np.zeros(n, np.int64)
    for node in range(2 * n - 2, -1, -1):
        at = window_of.pop(node)
        if node < n:
            out[node] = at[-1]
            continue
        a, b, order = merges[node - n]
        places = np.empty(windows, np.int64)
        places[order] = at
        window_of[a] = places
        window_of[b] = places[::-1]
    return out


def pack_block(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """The window of each length, and the number of windows: the first that keeps all within ``capacity``."""
    windows = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        at = difference(lengths, windows)
        if np.bincount(at, weights=lengths, minlength=windows).max(initial=0) <= capacity:
            return at, windows
        windows += 1


def cut(tokens: int, capacity: int = CAPACITY) -> tuple[int, list[int]]:
    """Whole windows of a document, and the lengths of the pieces of its rest.

    They are near equal, but for a short one at the end: short pieces level the windows.
    """
    whole, rest = divmod(tokens, capacity)
    short = rest % LEVELLING
    rest -= short
    parts = -(-rest // LONGEST_PIECE)
    even = [rest * (k + 1) // parts - rest * k // parts for k in range(parts)]
    return whole, [*even, short] if short else even


PIECE_COLUMNS = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long"
)


class Packer:
    """Gathers pieces of one task, and hands them out with their places."""

    def __init__(self, first_sequence: int, with_ids: bool):
        self.next_sequence = first_sequence
        self.with_ids = with_ids
        self.waiting: list[tuple] = []
        self.tokens = 0
        self.full = BLOCK_WINDOWS * CAPACITY - BLOCK_SLACK

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        whole, parts = cut(len(ids))
        for k in range(whole):
            yield (*self._piece(doc_id, ids, k * CAPACITY, CAPACITY), self.next_sequence, 0, CAPACITY)
            self.next_sequence += 1
        start = whole * CAPACITY
        for length in parts:
            over = self.tokens + length - self.full
            if over >= 0:  # cut where the block is full
                self._hold(doc_id, ids, start, length - over)
                yield from self.close()
                start, length = start + length - over, over
            self._hold(doc_id, ids, start, length)
            start += length

    def _piece(self, doc_id, ids: np.ndarray, start: int, length: int) -> tuple:
        data = ids[start : start + length].astype("<u4").tobytes()
        return (doc_id, start, length, zlib.crc32(data), len(ids), *([data] if self.with_ids else []))

    def _hold(self, doc_id, ids: np.ndarray, start: int, length: int) -> None:
        if length:
            self.waiting.append(self._piece(doc_id, ids, start, length))
            self.tokens += length

    def close(self) -> Iterator[tuple]:
        """Pack what waits."""
        at, windows = pack_block(np.array([p[2] for p in self.waiting], np.int64))
        load = [0] * windows
        offsets = []
        for p, w in zip(self.waiting, at, strict=True):
            offsets.append(load[w])
            load[w] += p[2]
        number = {w: i for i, w in enumerate(w for w in range(windows) if load[w])}
        for p, w, offset in zip(self.waiting, at, offsets, strict=True):
            yield (*p, self.next_sequence + number[w], offset, load[w])
        self.next_sequence += len(number)
        self.waiting, self.tokens = [], 0


def pack(
    docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None,
    doc_id: str = "doc_id", text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length).

    A document is the ids of its text, without added special tokens, and
    ``END_ID``; null and empty texts are ``END_ID`` alone. Every id lies in one
    piece. Repeated rows are documents of their own. ``with_ids`` adds the ids
    of each piece as little-endian 32-bit numbers. An empty table gives none.
    """
    columns = PIECE_COLUMNS.replace("doc_tokens long,", "doc_tokens long, ids binary,") if with_ids else PIECE_COLUMNS
    kinds = [
        pa.binary() if c.endswith(" binary") else pa.int64() for c in columns.split(", ")
    ]
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_cache(("ids", path, ranks), lambda: id_encoder(path, ranks, pattern))
        packer = Packer(TaskContext.get().partitionId() << 40, with_ids)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
            )

        for batch in batches:
            rows = []
            for key, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows.extend(packer.add(key, np.append(encode(body), np.uint32(END_ID))))
            if rows:
                yield batch_of(rows)
        rows = list(packer.close())
        if rows:
            yield batch_of(rows)

    source = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    return source.mapInArrow(run, columns)
