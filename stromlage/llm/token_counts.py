"""Token counts without shuffling words: a map-side lookup of two tiers.

A text is cut before single spaces between characters that are no white space.
The tokenizer's own pre-tokenizer cuts there as well, whatever stands around,
so the tokens of a text are the tokens of its pieces. Most pieces are frequent
ones: their lengths lie in a table of bounded size that every worker gets. The
others are encoded by the tokenizer itself, and each worker remembers the
latest of them.

The table only saves time. Counts are exact whatever it holds.
"""

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stromlage.llm.common import worker_cache

#: Entries of the broadcast table, and the longest piece in it: 1.2 MB at most.
TABLE_SIZE = 16_384
LONGEST_IN_TABLE = 24
#: Pieces that each task of the counting pass reports, and those it holds meanwhile.
REPORTED_BY_TASK = 4_096
HELD_BY_TASK = 200_000
#: Pieces that a worker remembers beyond the table, none longer than this.
REMEMBERED = 400_000
LONGEST_REMEMBERED = 64

_odd_space_wide = re.compile(r" \s|\s |^\s|\s$").search
_before_single_space = re.compile(r"(?<=\S)(?= \S)").split


def pieces(text: str) -> list[str]:
    """Pieces of ``text``, each but the first without the one space before it."""
    if not _odd_space_wide(text):
        return text.split(" ")
    first, *rest = _before_single_space(text)
    return [first, *[p[1:] for p in rest]]


class PieceLengths(dict):
    """Tokens by piece (with a space before it); unknown pieces are encoded."""

    def __init__(self, known: dict[str, int], encode):
        super().__init__(known)
        self.encode = encode
        self.known = len(self)

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(" " + piece))
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) - self.known >= REMEMBERED:
                for old in list(self)[self.known :: 2]:
                    del self[old]
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = pieces(text)
        return len(self.encode(first)) + sum(map(self.__getitem__, rest))


def encoder(path: str):
    """The tokenizer's ids of a text: no special tokens added, those in the text as by default."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: tokenizer.encode(text, add_special_tokens=False)


def cuts_before_spaces(path: str) -> bool:
    """Whether the file's pre-tokenizer cuts before single spaces (plain byte-level BPE)."""
    if path.endswith(".model"):
        return False
    import json

    from tokenizers import Tokenizer

    made = json.loads(Tokenizer.from_file(path).to_str())
    kind = made["pre_tokenizer"] or {}
    return (
        kind.get("type") == "ByteLevel"
        and kind.get("use_regex", True)
        and not kind.get("add_prefix_space")
        and made["normalizer"] is None
        and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in made["added_tokens"])
    )


def frequent_pieces(docs: DataFrame, text: str = "text", size: int = TABLE_SIZE) -> list[str]:
    """The most frequent pieces of all documents, ``size`` at most.

    Each task counts its own pieces in bounded memory and reports its most
    frequent ones; only these reports are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update(t.split(" "))
                if len(held) > 2 * HELD_BY_TASK:
                    held = Counter(dict(held.most_common(HELD_BY_TASK)))
        top = [
            (p, n) for p, n in held.most_common(REPORTED_BY_TASK)
            if p and len(p) <= LONGEST_IN_TABLE and not _odd_space_wide(p)
        ]
        yield pa.RecordBatch.from_pydict({"piece": [p for p, _ in top], "n": [n for _, n in top]},
                                         schema=pa.schema([("piece", pa.string()), ("n", pa.int64())]))

    found = (
        docs.select(F.col(f"`{text}`")).where(F.col(f"`{text}`").isNotNull())
        .mapInArrow(count, "piece string, n long")
        .groupBy("piece").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece").limit(size)
    )
    return [r.piece for r in found.collect()]


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs``, with the tokenizer file ``path``.

    A null text counts as empty: 0 bytes, 0 tokens. Equal rows give equal
    results, one for each row; other columns are not looked at. A text of
    spaces only, or with runs of white space, is cut only where a single space
    stands alone; a text without such a place is encoded as one piece.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    by_piece = cuts_before_spaces(path)
    known: dict[str, int] = {}
    if by_piece:
        encode = encoder(path)
        known = {p: len(encode(" " + p)) for p in frequent_pieces(docs, text)}
    table = spark.sparkContext.broadcast(known)
    key = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_cache(("encoder", path), lambda: encoder(path))
        lengths = worker_cache(("lengths", path, key), lambda: PieceLengths(table.value, encode))
        of = lengths.count if by_piece else lambda t: len(encode(t))
        for batch in batches:
            n = pa.array([of(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"]
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_tokens long"
    )
