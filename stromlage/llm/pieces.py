"""Encoding into SentencePiece vocabularies and back: Viterbi over a trie of words.

The segmentation of a text is the one whose pieces have the greatest sum of
scores; among equals, the one with the longest last piece. It never crosses a
word mark if no piece does, so it is that of its marked words, each by itself.
The distinct marked words of a block of texts are sorted, which puts them in the order
of a depth-first walk of their trie; the forward scores and back pointers of a
word's first characters are those of the word before, as far as both agree.

Characters outside the vocabulary become byte pieces, or else unknown.
"""

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stromlage.llm.common import worker_cache

MARK = "▁"
#: An unknown character scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: The score of what is no piece by itself.
NEVER = float("-inf")

#: Text whose words make one trie.
BLOCK_BYTES = 4_000_000
#: Words whose ids a worker keeps from trie to trie, none longer than this.
REMEMBERED = 300_000
LONGEST_REMEMBERED = 64

_marked_words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall


def _raw(i: int) -> bytes:
    return i.to_bytes(4, "little")


class Vocabulary:
    """Pieces of a model file, their scores, and how its texts are marked."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.piece_size()
        names = [self.model.id_to_piece(i) for i in range(size)]
        special = [
            self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)
            for i in range(size)
        ]
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        self.scores = {p: self.model.get_score(i) for p, i in self.ids.items()}
        #: Scores of the pieces and, as never chosen, of all their ends: longer strings are no ends of pieces either.
        self.ends = {p[i:]: NEVER for p in self.ids for i in range(1, len(p))} | self.scores
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.unk_id = self.model.unk_id()
        self.raw = {p: _raw(i) for p, i in self.ids.items()}
        bytes_of = {int(names[i][1:-1], 16): i for i in range(size) if self.model.is_byte(i)}
        self.byte_ids = [bytes_of[b] for b in range(256)] if len(bytes_of) == 256 else None
        self.crosses = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.bytes_of_id = [
            bytes([int(names[i][1:-1], 16)]) if self.model.is_byte(i)
            else " ⁇ ".encode() if self.model.is_unknown(i)
            else b"" if self.model.is_control(i)
            else names[i].replace(MARK, " ").encode()
            for i in range(size)
        ]

    def words(self, text: str) -> list[str]:
        """Marked words of a text; the whole text if some piece holds an inner mark."""
        marked = self.model.normalize(text)
        return ([marked] if marked else []) if self.crosses else _marked_words(marked)

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Word -> its ids as little-endian 32-bit numbers, by one walk over the sorted distinct words."""
        score_of, unknown = self.ends.get, self.unknown
        best, back = [0.0], [0]
        before, out = "", {}
        for word in sorted(set(words)):
            same = 0
            for x, y in zip(before, word):  # noqa: B905
                if x != y:
                    break
                same += 1
            del best[same + 1 :], back[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                at = end - 1
                score = score_of(word[at])
                top = best[at] + (unknown if score is None or score == NEVER else score)
                if score is not None:
                    for start in range(at - 1, -1, -1):
                        score = score_of(word[start:end])
                        if score is None:
                            break
                        score += best[start]
                        if score >= top:
                            top, at = score, start
                best.append(top)
                back.append(at)
            found: list[bytes] = []
            end = len(word)
            while end:
                found.append(self._bytes_of(word[back[end] : end]))
                end = back[end]
            out[word] = b"".join(reversed(found))
            before = word
        return out

    def _bytes_of(self, piece: str) -> bytes:
        """The ids of a piece or an unknown character, as little-endian 32-bit numbers."""
        found = self.raw.get(piece)
        if found is not None:
            return found
        return b"".join(_raw(self.byte_ids[b]) for b in piece.encode()) if self.byte_ids else _raw(self.unk_id)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, without the mark put before it."""
        return b"".join(map(self.bytes_of_id.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about BLOCK_BYTES of text, one row at least."""
    sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
    number = np.cumsum(sizes) // BLOCK_BYTES
    starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(sizes) else []
    for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True):
        yield batch.slice(a, b - a)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row. Null and empty texts have no ids; repeated rows equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = worker_cache(("pieces", path), lambda: Vocabulary(path))
        known = worker_cache(("words", path), dict)
        for batch in batches:
            for block in _blocks(batch):
                cut = [vocabulary.words(t) for t in block.column("text").to_pylist()]
                if len(known) > REMEMBERED:
                    known.clear()
                new = vocabulary.encode_words({w for words in cut for w in words if w not in known})
                known.update(new)
                data = [b"".join(map(known.__getitem__, words)) for words in cut]
                for word in new:
                    if len(word) > LONGEST_REMEMBERED:
                        del known[word]
                ends = np.cumsum([0, *[len(d) // 4 for d in data]]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(data), "<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"]
                )

    source = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    return source.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, text) of every row of ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = worker_cache(("pieces", path), lambda: Vocabulary(path))
        for batch in batches:
            rows = [np.asarray(x.values, np.int32) if x.is_valid else np.zeros(0, np.int32) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(x) for x in rows], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in rows], pa.int64()),
                    pa.array([vocabulary.decode(x.tolist()) for x in rows], pa.string()),
                ],
                ["doc_id", "n_ids", "ids_crc32", "text"],
            )

    source = encoded.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{ids}`").alias("ids"))
    return source.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text string")
