"""Stupid-backoff language-model scores of documents, by count tables that are dealt by key.

The counts behind a document's score are those of all other documents: what
only it says is unseen, however often it says it. A word is scored by the
longest n-gram ending in it that another document holds: c(n-gram) / c(its
context), times 0.4 for every order given up. A word that no other document has
counts as if seen once, of all words of the others. Contexts before the first
word are filled with a start sign.

Documents are written down once as blocks of word numbers. Every block sends
the distinct n-grams of each order to the count table, once, as sorted 64-bit
keys of which only the differences travel; a gram that is also a context has
both counts in one place. A part of the table adds up the counts of all blocks
and answers each with a bit per key, whether another block holds it, and the
sums of those that do: what a block holds alone it counts itself. The answers
meet their blocks, whose words are scored there. One order is counted at a time.
"""

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stromlage.llm.common import words_of
from stromlage.session import stage

ORDER = 3
BACKOFF = 0.4
#: Stands before the first word.
START = 0
#: A block ends with the document that fills it.
BLOCK_WORDS = 1 << 20
#: Words for each part of a count table; an order has no more keys than words and documents.
PART_WORDS = 1 << 19

BLOCKS = "block long, n_words long, ids binary, sizes binary, hashes binary, words binary"
ASKED = "part int, block long, keys binary, grams binary, contexts binary"
ANSWERS = "block long, order int, part int, shared binary, grams binary, contexts binary"
SCORES = "doc_id long, n_words long, n_unseen long, n_alone long, sum double"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _batch(schema: str, columns: list[list]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    held = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(held, _names(schema))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time: blocks are large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: the high ones are mostly equal, which compression takes away."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _joined(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit key of an n-gram, from that of its context and its last word."""
    x = before * np.uint64(0x9E3779B97F4A7C15) + (word ^ (word >> np.uint64(32)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks (``BLOCKS``) of the rows with words: ids, numbers of words, and the words by their number in ``hashes``. Staged."""

    def block(number: int, ids: list, sizes: list[int], words: list[int], numbers: dict[str, int]) -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
        # An id is followed by whether it is there at all.
        keys = np.array([(0, 0) if i is None else (i, 1) for i in ids], np.int64)
        held = [keys.tobytes(), np.array(sizes, np.int64).tobytes(), hashes.tobytes(), _packed(np.array(words, np.uint32))]
        return _batch(BLOCKS, [[(TaskContext.get().partitionId() << 32) + number], [len(words)], *([x] for x in held)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, sizes, words = 0, [], [], []
        numbers = defaultdict(lambda: len(numbers))
        for batch in batches:
            for key, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = words_of(body)
                if found:
                    ids.append(key)
                    sizes.append(len(found))
                    words.extend(map(numbers.__getitem__, found))
                if len(words) >= BLOCK_WORDS:
                    yield block(number, ids, sizes, words, numbers)
                    number, ids, sizes, words = number + 1, [], [], []
                    numbers.clear()
        if ids:
            yield block(number, ids, sizes, words, numbers)

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return stage(source.where(F.col("text").isNotNull()).mapInArrow(cut, BLOCKS), "blocks")


class _Block:
    """The n-grams of a block. Its documents stand in a row, each behind the start signs of the highest order."""

    def __init__(self, sizes: bytes, hashes: bytes, words: bytes, order: int) -> None:
        self.order = order
        self.sizes = np.frombuffer(sizes, np.int64)
        pads = order - 1
        #: Past the last place of each document.
        self.ends = np.cumsum(self.sizes + pads)
        first = self.ends - self.sizes
        self.is_word = np.ones(self.ends[-1], bool)
        for k in range(1, pads + 1):
            self.is_word[first - k] = False
        self.padded = np.full(len(self.is_word), START, np.uint64)
        self.padded[self.is_word] = np.frombuffer(hashes, np.uint64)[_unpacked(words, np.uint32)]
        #: Places where an n-gram below the highest order ends: the words, and before the first.
        self.is_context = self.is_word.copy()
        self.is_context[first - 1] = True

    def keys(self, k: int) -> np.ndarray:
        """The key of the n-gram of order ``k`` that ends at each place; of those that reach out of a document it means nothing."""
        keys = self.padded
        for _ in range(k - 1):
            keys = np.concatenate([keys[:1], _joined(keys[:-1], self.padded[1:])])
        return keys

    def ending(self, k: int) -> np.ndarray:
        """Whether an n-gram of the order ends at a place."""
        return self.is_word if k == self.order else self.is_context

    def counts(self, k: int, keys: np.ndarray, held: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each of the distinct keys ``held``, ``n`` times at a place, ends in a word, and is followed by one."""
        if k == self.order:
            return n, np.zeros_like(n)
        grams, contexts = n.copy(), n.copy()
        before, last = self.ends - self.sizes - 1, self.ends - 1
        np.subtract.at(grams, np.searchsorted(held, keys[before]), 1)
        np.subtract.at(contexts, np.searchsorted(held, keys[last]), 1)
        return grams, contexts


def _bounds(held: np.ndarray, parts: int) -> np.ndarray:
    """Where the parts of sorted keys begin and end: each has an equal share of the range of keys."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(held, edges), [len(held)]])


def asked_counts(blocks: DataFrame, order: int, k: int, parts: int) -> DataFrame:
    """(``ASKED``): of every block the distinct n-grams of order ``k``, sorted, with how often they are grams and contexts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block = _Block(row["sizes"], row["hashes"], row["words"], order)
                keys = block.keys(k)
                held, n = np.unique(keys[block.ending(k)], return_counts=True)
                grams, contexts = (x.astype(np.uint32) for x in block.counts(k, keys, held, n))
                edges = _bounds(held, parts)
                some = np.flatnonzero(np.diff(edges))
                at = [slice(edges[part], edges[part + 1]) for part in some]
                yield _batch(ASKED, [
                    some, [row["block"]] * len(some), [_packed(np.diff(held[x], prepend=np.uint64(0))) for x in at],
                    *([_packed(counts[x]) for x in at] for counts in (grams, contexts)),
                ])

    return blocks.mapInArrow(ask, ASKED)


def answered_counts(asked: DataFrame, k: int) -> DataFrame:
    """(``ANSWERS``): for every block a bit for each of its keys, whether another block has it too, and the sums of those."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [np.cumsum(_unpacked(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
        sizes = np.cumsum([len(x) for x in keys])[:-1]
        every = np.concatenate(keys)
        del table, keys
        by_key = np.argsort(every)
        new = np.concatenate([[True], np.diff(every[by_key]) != 0])
        first = np.flatnonzero(new)
        run = np.empty(len(every), np.int64)
        run[by_key] = np.cumsum(new) - 1
        # A block has a key once.
        shared = np.split((np.diff(first, append=len(every)) > 1)[run], sizes)
        sums = []
        for name in ("grams", "contexts"):
            counts = np.concatenate([_unpacked(r[name], np.uint32) for r in rows]).astype(np.int64)
            sums.append(np.split(np.add.reduceat(counts[by_key], first)[run], sizes))
        columns = [
            [r["block"] for r in rows], [k] * len(rows), [r["part"] for r in rows],
            [np.packbits(x).tobytes() for x in shared],
            *([_packed(s[x]) for s, x in zip(found, shared)] for found in sums),
        ]
        return pa.Table.from_batches([_batch(ANSWERS, columns)])

    return asked.groupBy("part").applyInArrow(add, ANSWERS)


def _totals(held: np.ndarray, grams: np.ndarray, contexts: np.ndarray, answers: list[dict], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of all blocks for the keys of this one, which knows its own."""
    totals, edges = (grams.astype(np.int64), contexts.astype(np.int64)), _bounds(held, parts)
    for answer in answers:
        begin, end = edges[answer["part"]], edges[answer["part"] + 1]
        shared = np.unpackbits(np.frombuffer(answer["shared"], np.uint8), count=end - begin).astype(bool)
        for total, name in zip(totals, ("grams", "contexts")):
            total[begin:end][shared] = _unpacked(answer[name], np.int64)
    return totals


def _others(block: _Block, k: int, keys: np.ndarray, answers: list[dict], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """At every place how often other documents have the n-gram that ends there, and have it as a context."""
    places = np.flatnonzero(block.ending(k))
    doc = np.repeat(np.arange(len(block.sizes)), block.sizes + block.order - 1)[places]
    at = keys[places]
    by_key = np.argsort(at, kind="stable")  # by document within a key, as they stand
    new_key = np.concatenate([[True], np.diff(at[by_key]) != 0])
    first = np.flatnonzero(new_key)
    held, n = at[by_key[first]], np.diff(first, append=len(at))
    totals = _totals(held, *block.counts(k, keys, held, n), answers, parts)
    new_doc = np.flatnonzero(new_key | np.concatenate([[True], np.diff(doc[by_key]) != 0]))
    lengths = np.diff(new_doc, append=len(at))
    own, key = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    own[by_key], key[by_key] = np.repeat(lengths, lengths), np.cumsum(new_key) - 1
    others = [np.zeros(len(keys), np.int64) for _ in totals]
    if k == block.order:
        others[0][places] = totals[0][key] - own
    else:
        before, last = (block.ends - block.sizes - 1)[doc], (block.ends - 1)[doc]
        others[0][places] = totals[0][key] - own + (at == keys[before])
        others[1][places] = totals[1][key] - own + (at == keys[last])
    return others[0], others[1]


def _scored(row: dict, answers: list[dict], order: int, parts: int) -> pa.RecordBatch:
    """(``SCORES``) of the documents of a block; what lone words are divided by is left out."""
    block = _Block(row["sizes"], row["hashes"], row["words"], order)
    places = np.flatnonzero(block.is_word)
    by_order = defaultdict(list)
    for answer in answers:
        by_order[answer["order"]].append(answer)
    score, contexts = np.zeros(len(places)), None
    # The order that a word is scored by: the highest whose n-gram another document holds.
    best = np.ones(len(places), np.int8)
    for k in range(1, order + 1):
        grams, followed = _others(block, k, block.keys(k), by_order[k], parts)
        seen = grams[places]
        given_up = (order - k) * math.log(BACKOFF)
        if k == 1:
            score[:] = given_up + np.log(np.maximum(seen, 1))
        else:
            found = np.flatnonzero(seen > 0)
            score[found] = given_up + np.log(seen[found]) - np.log(contexts[places[found] - 1])
            best[found] = k
        contexts = followed
    starts = np.cumsum(block.sizes) - block.sizes
    ids = np.frombuffer(row["ids"], np.int64).reshape(-1, 2)
    sums = [np.add.reduceat(x, starts) for x in ((best < order).astype(np.int64), (best == 1).astype(np.int64), score)]
    return _batch(SCORES, [
        pa.array(ids[:, 0], pa.int64(), mask=ids[:, 1] == 0), block.sizes, *sums,
    ])


def block_scores(blocks: DataFrame, answers: DataFrame, order: int, parts: int) -> DataFrame:
    """(``SCORES``) of every row with words: each block with the answers it got."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        held = right.to_pylist()
        return pa.Table.from_batches([_scored(row, held, order, parts) for row in left.to_pylist()])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)


def backoff_scores(docs: DataFrame, order: int = ORDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_unseen, n_alone, log_score), one row for each doc_id.

    ``log_score`` is the sum of the natural logarithms of its words' scores,
    ``n_unseen`` the number of words that back off at all, ``n_alone`` of those
    that are scored without any context. Null, empty and white texts have no
    words and the score 0. Ids should be unique; rows that share one (or have
    none) are counted row by row and added up. ``order`` is 2 or more.
    """
    if order < 2:
        raise ValueError("the order must be 2 at least")
    blocks = word_blocks(docs, doc_id, text)
    total = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("total")).head()["total"]
    parts = -(-total // PART_WORDS) or 1
    # One order at a time: what one has moved is gone before the next.
    answers = [stage(answered_counts(asked_counts(blocks, order, k, parts), k), "answers") for k in range(order, 0, -1)]
    scored = block_scores(blocks, reduce(DataFrame.unionByName, answers), order, parts)
    sums = scored.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in _names(SCORES)[1:]])
    # What a lone word's count is divided by, the words of all other documents, is one number for each document.
    words = F.log(F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)).cast("double"))
    scores = sums.withColumn("log_score", F.col("sum") - F.col("n_alone") * words)
    ids = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id")).distinct()
    return ids.alias("i").join(scores.alias("s"), F.col("i.doc_id").eqNullSafe(F.col("s.doc_id")), "left").select(
        "i.doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_words", "n_unseen", "n_alone")],
        F.coalesce("log_score", F.lit(0.0)).alias("log_score"),
    )
