"""Ranked lexical search by scanning documents with one automaton of all query terms.

The distinct terms of the items, each between two boundary signs, make one
Aho-Corasick automaton, which is broadcast and run over every whole text: no
index of documents is made. A first scan counts documents, terms and document
frequencies, a second one scores. Items come in groups whose automata have a
bounded size; each group is one pair of scans.
"""

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stromlage.llm.common import worker_cache
from stromlage.session import scratch_path

#: A term is a run of these characters: ASCII letters and digits, and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: UTF-8 bytes: A-Z lower-cased, every other ASCII sign that is in no term becomes the boundary.
_PLAIN = bytes(
    b if b > 127 or chr(b).isalnum() else 32 for b in range(256)
).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))

#: Text of the items of one automaton. An automaton takes some 100 bytes for each byte of its terms.
GROUP_BYTES = 2 << 20
#: Scores worked out at once (documents times items), and parts into which an item's candidates are dealt.
BLOCK = 1 << 21
PARTS = 64

SCHEMA = "item_id long, rank int, doc_id long, score long"


class Terms(NamedTuple):
    """The terms of a group of items, and which items hold each."""

    terms: list[str]
    starts: np.ndarray  # of a term's items in ``holders``
    holders: np.ndarray  # places in ``items``
    items: list  # ids


def plain(text: str) -> str:
    """Terms lower-cased, with boundaries around them."""
    return f" {text.encode().translate(_PLAIN).decode()} "


def _terms_of(items: DataFrame) -> Terms:
    """Of a group of items that is small by its bytes."""
    rows = items.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
    rows = sorted(((r.item_id, r.terms) for r in rows.collect() if r.terms), key=itemgetter(0))
    holders: dict[str, list[int]] = {}
    for place, (_, terms) in enumerate(rows):
        for term in terms:
            holders.setdefault(term, []).append(place)
    counts = [len(x) for x in holders.values()]
    return Terms(
        list(holders), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64),
        np.array([p for x in holders.values() for p in x], np.int64), [r[0] for r in rows],
    )


class Scanner:
    """Counts the terms of a group in texts."""

    def __init__(self, terms: list[str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for number, term in enumerate(terms):
            self.automaton.add_word(f" {term} ", number)
        self.automaton.make_automaton()

    def counts(self, text: str) -> tuple[int, Counter]:
        """How many terms the text has in all, and how often each term of the group stands in it."""
        signs = plain(text)
        words = signs.split(" ")
        return len(words) - words.count(""), Counter(map(itemgetter(1), self.automaton.iter(signs)))


def _frequencies(docs: DataFrame, scanner, size: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms in all, documents that hold each term): every task reports its sums once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size + 2, np.int64)
        scan = scanner()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n, found = scan.counts(text)
                held[list(found)] += 1
                held[-2] += n > 0
                held[-1] += n
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"term": at, "n": held[at]})

    sums = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(size + 2, np.int64)
    for r in sums.collect():
        out[r.term] = r.n
    return int(out[-2]), int(out[-1]), out[:-2]


class Best:
    """The highest scores of each item in one task; ties to the smaller document."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.held: list[list[tuple]] = [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)

    def add(self, docs: list, scores: np.ndarray) -> None:
        for d, item in zip(*(x.tolist() for x in np.nonzero(scores >= self.least))):
            held, entry = self.held[item], (int(scores[d, item]), -docs[d])
            if len(held) < self.k:
                heapq.heappush(held, entry)
            elif entry > held[0]:
                heapq.heapreplace(held, entry)
            if len(held) == self.k:
                self.least[item] = held[0][0]


def _scored(docs: DataFrame, scanner, sent, totals: tuple[int, int], k: int) -> DataFrame:
    """(item, doc_id, score): the best ``k`` documents of each item in each task."""
    n_docs, n_terms = totals

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights = sent.value
        scan, items = scanner(), len(terms.items)
        best = Best(items, k)
        sizes = np.diff(terms.starts)
        wide = max(1, BLOCK // items)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), wide):
                scores = np.zeros((min(wide, len(ids) - at), items), np.int64)
                for row, text in enumerate(texts[at : at + wide]):
                    n, found = scan.counts(text)
                    if not found:
                        continue
                    term = np.fromiter(found, np.int64, len(found))
                    tf = np.fromiter(found.values(), np.int64, len(found))
                    m = 50 + 50 * n * n_docs // n_terms
                    part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
                    size = sizes[term]
                    first = np.repeat(terms.starts[term] - np.cumsum(size) + size, size)
                    np.add.at(scores[row], terms.holders[first + np.arange(len(first))], np.repeat(part, size))
                best.add(ids[at : at + wide], scores)
        rows = [(i, -d, s) for i, held in enumerate(best.held) for s, d in held]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item", "doc_id", "score"]
        )

    return docs.mapInArrow(score, "item long, doc_id long, score long")


def best_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``k`` documents with the highest scores above 0.

    Terms are runs of ``TERM`` with A-Z lower-cased; an item counts each of its
    terms once, rows with one item id are one item. A null or empty text has no
    terms: such items give no rows, such documents are found by none. Rows
    without an id take no part as results or items, though their texts count in
    the statistics of the documents. Repeated documents rank one by one. Equal
    scores go by ascending doc_id. Other columns are not looked at.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = items.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"),
        F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0)).alias("terms"),
        F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"),
    )
    size = wanted.agg(F.sum("bytes")).head()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    path = scratch_path(spark, "ranked")
    for group in range(groups):
        _search_group(spark, texts, wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group), k, path)
    return spark.read.schema(SCHEMA).parquet(path)


def _search_group(spark: SparkSession, texts: DataFrame, items: DataFrame, k: int, path: str) -> None:
    """Append the results of one group of items to ``path``."""
    terms = _terms_of(items)
    if not terms.terms:
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(path)
        return
    key = uuid.uuid4().hex
    words = spark.sparkContext.broadcast(terms.terms)

    def scanner() -> Scanner:
        held = worker_cache("scanner", dict)  # of one group at a time
        if key not in held:
            held.clear()
            held[key] = Scanner(words.value)
        return held[key]

    n_docs, n_terms, df = _frequencies(texts, scanner, len(terms.terms))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    sent = spark.sparkContext.broadcast((terms, weights))
    named = spark.createDataFrame(list(enumerate(terms.items)), "item long, item_id long")
    order = [F.desc("score"), "doc_id"]
    # An item's candidates grow with the tasks: first the best of each part, then the best of all.
    in_part = Window.partitionBy("item", "_part").orderBy(*order)
    found = (
        _scored(texts.where(F.col("doc_id").isNotNull()), scanner, sent, (n_docs, max(n_terms, 1)), k)
        .withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
        .withColumn("_place", F.row_number().over(in_part)).where(F.col("_place") <= k)
        .withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        .join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
    )
    found.write.mode("append").parquet(path)
    sent.destroy()
    words.destroy()
