"""Threshold-scaled sketches of documents.

A sketch holds every distinct shingle hash below a fixed fraction of the hash
range. What is retained depends on the shingle alone, so sketches of parts
merge into the sketch of the whole (union), and the shared share of two
sketches estimates how much of a short text lies in a very long one. The
smallest hash is always kept, so that no text with words has an empty sketch.

Shingles are five words; a shorter text is one shingle. A text without words
has the empty sketch.
"""

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stromlage.llm.common import stats_partitions, words_of

SHINGLE_WORDS = 5
#: One of so many hashes is retained.
SCALE = 8
#: Bytes of text that a task of the neighbour search should hold.
TASK_BYTES = 24_000_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                         0xA0761D6478BD642F], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: list[str], size: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes of the shingles of ``size`` words, in order of value."""
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = _mixed(total + one[k : k + n] * _MULTIPLIERS[k])
    return np.unique(total)


def sketch(text: str, scale: int = SCALE) -> np.ndarray:
    hashes = shingle_hashes(words_of(text))
    below = int(np.searchsorted(hashes, np.uint64((1 << 64) // scale)))
    return hashes[: max(below, min(1, len(hashes)))]


def merge(sketches: Iterable[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """The sketch of all shingles behind ``sketches``."""
    together = np.unique(np.concatenate([np.zeros(0, np.uint64), *sketches]))
    below = int(np.searchsorted(together, np.uint64((1 << 64) // scale)))
    return together[: max(below, min(1, len(together)))]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; two empty sketches are alike."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of ``a`` that lie in ``b``; 1 for an empty sketch."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scale: int = SCALE) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row; a null text counts as empty."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [as_text(sketch(t, scale)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_chars"), pa.array(made, pa.string())],
                ["doc_id", "n_chars", "fingerprint"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    filled = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), filled.alias("text"), F.char_length(filled).cast("long").alias("n_chars")
    ).mapInArrow(make, f"doc_id {kind}, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbour_slices(docs: DataFrame) -> DataFrame:
    """(slice, own, doc_id, text), each slice in order: own rows by descending doc_id, then one row more.

    That one is a copy of the first row of the next slice (after the last: of
    the very first), so that every row meets its successor in its own task and
    each text is shuffled once. The bounds are ids that occur; as many of them
    as there are slices come to the driver. Rows without an id come last.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).head()["bytes"] or 0
    slices = stats_partitions(spark, total, TASK_BYTES)
    wanted = [k / slices for k in range(1, slices)] or [0.5]
    marks = docs.agg(
        F.max("doc_id").alias("top"), F.percentile_approx("doc_id", wanted, 20 * slices).alias("cuts")
    ).head()
    top = -1 if marks["top"] is None else marks["top"]
    heads = np.array(sorted({top, *((marks["cuts"] or []) if slices > 1 else [])}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            at = np.searchsorted(heads, ids)
            is_head = (at < len(heads)) & (heads[np.minimum(at, len(heads) - 1)] == ids)
            own = np.concatenate([np.ones(len(ids), bool), np.zeros(int(is_head.sum()), bool)])
            take = pa.array(np.concatenate([np.arange(len(ids)), np.flatnonzero(is_head)]))
            number = len(heads) - 1 - np.minimum(at, len(heads) - 1)
            number = np.concatenate([number, (number[is_head] - 1) % len(heads)])
            rows = batch.take(take)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int64()), pa.array(own), rows.column("doc_id"), rows.column("text")],
                ["slice", "own", "doc_id", "text"],
            )

    return (
        docs.mapInArrow(deal, "slice long, own boolean, doc_id long, text string")
        .repartition(slices, "slice")
        .sortWithinPartitions("slice", F.desc("own"), F.desc_nulls_last("doc_id"), "text")
    )


NEIGHBOUR_COLUMNS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, contained_in_next double"
)


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scale: int = SCALE) -> DataFrame:
    """Each document's sketch beside that of its edited text and that of the next document.

    The next document is the one with the next lower id (after the last: the
    first). A null text counts as empty; a single row is its own successor;
    rows that share an id follow each other in the order of their texts; rows
    without an id come last. Two texts without words have likeness 1.
    """
    filled = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
            ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
            ("near_next", pa.float64()), ("contained_in_next", pa.float64()),
        ])
        waiting = None  # the last own row, whose successor has not come yet
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("slice", "own", "doc_id", "text"))
            for at, own, key, body in zip(*columns, strict=True):
                hashes = sketch(body, scale) if own or waiting else None
                if waiting and waiting[0] == at:
                    _, before, old, old_hashes = waiting
                    new = edited(old, body)
                    new_hashes = sketch(new, scale)
                    out.append((
                        before, len(old), hashlib.sha256(new.encode()).hexdigest(), as_text(old_hashes),
                        as_text(new_hashes), likeness(old_hashes, new_hashes), likeness(old_hashes, hashes),
                        containment(old_hashes, hashes),
                    ))
                waiting = (at, key, body, hashes) if own else None
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema
                )

    return neighbour_slices(filled).mapInArrow(scan, NEIGHBOUR_COLUMNS)
