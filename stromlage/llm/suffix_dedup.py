"""Long repeated byte strings, by a Burrows-Wheeler transform of many strings built column by column.

Every string of ``SPAN`` bytes that starts in two places is to be found, over
all documents. The strings are dealt out first: the anchor of a span is the
least hash among its ``ANCHOR``-byte strings, so equal spans have equal anchors.
Neighbouring spans with one anchor at one place form a unit, a short stretch of
text; within a unit no span repeats. Spans
whose anchor stands in one unit only are unique; units that are equal as a
whole are counted; the different units of one anchor go into a collection, unless
none of its others has the same ``ANCHOR`` bytes before or behind the anchor: a
span reaches so far beyond it on one side at least. Units are cut to the stretch
where spans may lie that another unit shares, to some bytes.

The transform of a collection is built as for very many short documents: each
round puts one more symbol before every unit, from its last to its first, and
merges the new suffixes into the sorted ones in one sequential sweep over the
transform, the common prefixes and the places, which are read and written anew.
Where a new suffix goes follows from the place of the one before and the counts
of the transform; common prefixes follow from the least ones between. At the end,
neighbouring suffixes with ``SPAN`` bytes in common are repeats.

A collection holds a bounded number of units, as many rounds as the longest
unit has bytes, and is held in memory: executors are to keep no files of their
own. An anchor with more units than a collection holds has its spans
counted by hash instead, in partial aggregations.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stromlage.session import stage

SPAN = 200
ANCHOR = 64
#: Spans that share an anchor's place, and so the spans of a unit, at most.
WIDTH = SPAN - ANCHOR + 1
#: Units that leave a task in one batch.
UNITS_AT_ONCE = 1 << 16
#: Units are cut to where they may repeat in so many bytes.
STEP = 8
#: Units of a collection, or the units of one anchor, if they are more; and the most that one anchor may have.
COLLECTION = 1024
LARGEST = 4096

_MULTIPLIERS = [np.uint64(0x9E3779B97F4A7C15 * (2 * t + 1) & (1 << 64) - 1) for t in range(ANCHOR // 8)]


def _hashes(data: bytes) -> np.ndarray:
    """Of the string of ``ANCHOR`` bytes at each place of ``data``, which is no shorter."""
    n = len(data)
    raw = np.frombuffer(data, np.uint8)
    words = np.lib.stride_tricks.as_strided(raw, (n - 7, 8), (1, 1)).copy().view("<u8").ravel()
    count = n - ANCHOR + 1
    h = np.zeros(count, np.uint64)
    for t, by in enumerate(_MULTIPLIERS):
        h += words[8 * t : 8 * t + count] * by
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the span at each place of ``data`` (none if it is shorter than a span), and all hashes."""
    n = len(data)
    if n < SPAN:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = _hashes(data)
    count = len(h)
    # Least of every WIDTH neighbours: least from the left and from the right within blocks of WIDTH.
    blocks = -(-count // WIDTH)
    padded = np.full(blocks * WIDTH, np.uint64((1 << 64) - 1))
    padded[:count] = h
    padded = padded.reshape(blocks, WIDTH)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    places = n - SPAN + 1
    return np.minimum(right[:places], left[WIDTH - 1 : WIDTH - 1 + places]), h


def units(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, spans) of the units of ``data``: the spans that have one anchor at one place, its first in each."""
    of, h = anchors(data)
    if not len(of):
        return of.view(np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    end = np.append(begin[1:], len(of))
    starts, spans = [], []
    near = np.arange(WIDTH)
    while len(begin):
        # Where the anchor stands; what begins behind that place has it at a later one.
        first = begin + (h[begin[:, None] + near] == of[begin][:, None]).argmax(axis=1) + 1
        starts.append(begin)
        spans.append(np.minimum(end, first) - begin)
        more = first < end
        begin, end = first[more], end[more]
    start, n = np.concatenate(starts), np.concatenate(spans)
    return of[start].view(np.int64), start, n


def sharing(anchor: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Whether another unit of the same anchor has the same ANCHOR bytes before or behind the anchor.

    Equal spans of two units have the anchor at the same place, the first in
    either unit. Hashes stand for bytes: units may be taken needlessly, none is missed.
    """
    of = anchor.view(np.uint64)
    sizes = np.array([len(x) for x in strings])
    begin = np.cumsum(sizes) - sizes
    h = _hashes(b"".join(strings))
    # The first place with the anchor, unit by unit; places from the next unit's begin on come after all of its own.
    hit = np.flatnonzero(h == np.repeat(of, sizes)[: len(h)])
    at = hit[np.searchsorted(hit, begin)]
    shared = np.zeros(len(strings), bool)
    for place, inside in ((at - ANCHOR, at - ANCHOR >= begin), (at + ANCHOR, at + 2 * ANCHOR <= begin + sizes)):
        which = np.flatnonzero(inside)
        near = h[place[which]]
        order = np.lexsort((near, of[which]))
        same = (np.diff(near[order]) == 0) & (np.diff(of[which][order]) == 0)
        shared[which[order[1:][same]]] = shared[which[order[:-1][same]]] = True
    return shared


def stretches(anchor: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each unit, from where to where (0, 0: nowhere) a span may lie that another unit of its anchor has.

    A span that begins up to STEP bytes before a place, with the anchor's distance to it a multiple of STEP, holds the
    SPAN - STEP bytes from there on. What lies outside such stretches that two units share cannot repeat.
    """
    of = anchor.view(np.uint64)
    sizes = np.array([len(x) for x in strings])
    begin = np.cumsum(sizes) - sizes
    h = _hashes(b"".join(strings))
    hit = np.flatnonzero(h == np.repeat(of, sizes)[: len(h)])
    at = hit[np.searchsorted(hit, begin)]
    low, high = sizes.copy(), np.zeros(len(strings), np.int64)
    for back in range(0, WIDTH, STEP):
        start = at - begin - back
        which = np.flatnonzero((start >= 0) & (start + SPAN - STEP <= sizes))
        near = of[which]
        # Hashes of ANCHOR bytes, side by side and the last one at the end.
        for ahead in [*range(0, SPAN - STEP - ANCHOR, ANCHOR), SPAN - STEP - ANCHOR]:
            near = near * _MULTIPLIERS[0] ^ (near >> np.uint64(31)) ^ h[begin[which] + start[which] + ahead]
        order = np.argsort(near)
        same = np.diff(near[order]) == 0
        shared = which[order[np.append(same, False) | np.append(False, same)]] if len(which) else which
        low[shared] = np.minimum(low[shared], np.maximum(start[shared] - STEP + 1, 0))
        high[shared] = np.maximum(high[shared], np.minimum(start[shared] + SPAN, sizes[shared]))
    none = high - low < SPAN
    return np.where(none, 0, low), np.where(none, 0, high)


#: Stands before a whole unit; no byte of UTF-8.
_WHOLE = 255


def repeats(strings: list[bytes]) -> list[np.ndarray]:
    """For each string of UTF-8, the places where a span starts that starts elsewhere in ``strings`` as well.

    The transform by columns. Of each sorted suffix a row holds the symbol
    before it, the prefix it shares with the suffix above, up to SPAN, and its
    place, string and length, in one number: a sweep moves them together.
    """
    m = len(strings)
    sizes = np.array([len(s) for s in strings])
    text = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(sizes)
    longest = int(sizes.max(initial=0))
    bits = longest.bit_length()
    rows = text[ends - 1].astype(np.int64) | np.arange(m, dtype=np.int64) << (32 + bits)
    at = np.arange(m)
    for length in range(1, longest + 1):
        active = np.flatnonzero(sizes >= length)
        n, q = len(rows), len(active)
        symbol, common = _bytes(rows, 0).copy(), np.append(_bytes(rows, 1), np.uint8(0))
        # Equal symbols stand in runs, which are sorted in place of the rows.
        begin = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        order = np.argsort(symbol[begin], kind="stable")
        size = np.diff(np.append(begin, n))[order]
        sorted_begin = np.cumsum(size) - size
        to = np.empty(len(begin), np.int64)
        to[order] = sorted_begin
        # Among suffixes with the same symbol before them, a new suffix keeps the order of the one before it.
        run = np.searchsorted(begin, at[active], "right") - 1
        k = to[run] + at[active] - begin[run]
        # Common prefixes of the new suffixes with those above, and of those below with the new ones.
        touched = np.zeros(n + 1, bool)
        touched[k] = touched[k + 1] = True
        touched = np.flatnonzero(touched[:n])
        run = np.searchsorted(sorted_begin, touched, "right") - 1
        here = begin[order[run]] + touched - sorted_begin[run]
        run -= (touched == sorted_begin[run]) & (touched > 0)
        above = begin[order[run]] + touched - 1 - sorted_begin[run]
        same = (touched > 0) & (symbol[above] == symbol[here])
        least = np.zeros(len(touched), np.uint8)
        if same.any():
            first, last = above[same] + 1, here[same]
            down = np.argsort(-first, kind="stable")  # so that reduceat takes the stretches alone
            cuts = np.empty(2 * len(first), np.int64)
            cuts[0::2], cuts[1::2] = first[down], last[down] + 1
            lows = np.empty(len(first), np.int64)
            lows[down] = np.minimum.reduceat(common, cuts)[0::2]
            least[same] = np.minimum(lows + 1, SPAN)
        new = m + k
        old = np.ones(n + q, bool)
        old[new] = False
        merged = np.empty(n + q, np.int64)
        merged[old] = rows
        before = np.where(sizes[active] > length, text[ends[active] - length - 1], _WHOLE).astype(np.int64)
        merged[new] = before | ((active.astype(np.int64) << bits) + length) << 32
        inside = m + touched < n + q
        _bytes(merged, 1)[m + touched[inside]] = least[inside]
        rows = merged
        at[active] = new
    long = _bytes(rows, 1) >= SPAN
    long[:-1] |= long[1:]
    found = rows[long] >> 32
    owner = found >> bits
    start = sizes[owner] - (found & (1 << bits) - 1)
    by = np.argsort(owner, kind="stable")
    return [np.sort(x) for x in np.split(start[by], np.searchsorted(owner[by], np.arange(1, m)))]


def _bytes(rows: np.ndarray, k: int) -> np.ndarray:
    """Byte ``k`` of every row, as a view: 0 is the symbol, 1 the common prefix."""
    return rows.view(np.uint8)[k::8]


def _ranges(places: np.ndarray) -> list[dict]:
    """Half-open ranges of the given rising numbers."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return [
        {"a": int(a), "b": int(b) + 1}
        for a, b in zip(places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)], strict=True)
    ]


RANGES = "array<struct<a: int, b: int>>"


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, th, text): a document is its id and 32 bits of its text's hash."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.hash(body).alias("th"), body.alias("text"))


def _anchors(source: DataFrame) -> DataFrame:
    """Anchors that stand in more than one unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [units(t.encode())[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["anchor"])

    return source.select("text").mapInArrow(run, "anchor long").groupBy("anchor").count().where("count > 1").select("anchor")


def _units(source: DataFrame) -> DataFrame:
    """(anchor, digest, doc_id, th, start, spans) of all units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held = 0

        def joined() -> pa.RecordBatch:
            columns = [pa.concat_arrays(c) for c in zip(*parts, strict=True)]
            parts.clear()
            return pa.RecordBatch.from_arrays(columns, ["anchor", "digest", "doc_id", "th", "start", "spans"])

        for batch in batches:
            hashes, texts = (batch.column(c).to_pylist() for c in ("th", "text"))
            for row, (th, body) in enumerate(zip(hashes, texts, strict=True)):
                data = body.encode()
                anchor, start, spans = units(data)
                n = len(anchor)
                digest = np.fromiter(
                    (xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start.tolist(), (start + spans + SPAN - 1).tolist(), strict=True)),
                    np.uint64, n,
                ).view(np.int64)
                key = pa.repeat(batch.column("doc_id")[row], n)
                parts.append((pa.array(anchor), pa.array(digest), key, pa.repeat(pa.scalar(th, pa.int32()), n), pa.array(start), pa.array(spans.astype(np.int32))))
                held += n
                if held >= UNITS_AT_ONCE:
                    yield joined()
                    held = 0
        if parts:
            yield joined()

    return source.mapInArrow(run, "anchor long, digest long, doc_id long, th int, start long, spans int")


def _with_strings(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, digest, n, string) of the wanted units (anchor, digest, n, doc_id, th, start, spans)."""
    lists = wanted.groupBy("doc_id", "th").agg(
        F.collect_list(F.struct("anchor", "digest", "n", "start", "spans")).alias("units")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for body, cut in zip(batch.column("text").to_pylist(), batch.column("units").to_pylist(), strict=True):
                data = body.encode()
                out += [(u["anchor"], u["digest"], u["n"], data[u["start"] : u["start"] + u["spans"] + SPAN - 1]) for u in cut]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["anchor", "digest", "n", "string"]
                )

    joined = source.alias("s").join(
        lists.alias("w"), (F.col("s.th") == F.col("w.th")) & F.col("s.doc_id").eqNullSafe(F.col("w.doc_id"))
    )
    return joined.select("text", "units").mapInArrow(run, "anchor long, digest long, n long, string binary").dropDuplicates(
        ["anchor", "digest"]
    )


def _collected(strings: DataFrame) -> DataFrame:
    """(anchor, digest, ranges): the repeated spans of the units of each anchor, anchor by anchor in collections."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        taken: list[tuple] = []

        def take() -> None:
            shared = sharing(np.array([r[0] for r in held], np.int64), [r[2] for r in held])
            some = [r for r, x in zip(held, shared.tolist(), strict=True) if x]
            held.clear()
            if some:
                low, high = stretches(np.array([r[0] for r in some], np.int64), [r[2] for r in some])
                cut = zip(some, low.tolist(), high.tolist(), strict=True)
                taken.extend((anchor, digest, data[a:b], a) for (anchor, digest, data), a, b in cut if b)

        def solve() -> pd.DataFrame:
            found = repeats([r[2] for r in taken])
            out = pd.DataFrame({
                "anchor": [r[0] for r in taken], "digest": [r[1] for r in taken],
                "ranges": [_ranges(x + r[3]) for r, x in zip(taken, found, strict=True)],
            })
            taken.clear()
            return out

        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                if len(held) >= COLLECTION and row[0] != held[-1][0]:
                    take()
                    if len(taken) >= COLLECTION:
                        yield solve()
                held.append((row[0], row[1], bytes(row[2])))
        if held:
            take()
        if taken:
            yield solve()

    dealt = strings.select("anchor", "digest", "string").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInPandas(run, f"anchor long, digest long, ranges {RANGES}")


def _counted(strings: DataFrame) -> DataFrame:
    """The same for anchors with more units than a collection holds: spans counted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("anchor", "digest", "string"))
            for anchor, digest, data in zip(*columns, strict=True):
                n = len(data) - SPAN + 1
                spans = [xxhash.xxh3_128_digest(data[i : i + SPAN]) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * n), pa.array([digest] * n), pa.array(range(n), pa.int32()), pa.array(spans, pa.binary())],
                    ["anchor", "digest", "i", "span"],
                )

    spans = stage(strings.mapInArrow(run, "anchor long, digest long, i int, span binary"), "spans")
    often = spans.groupBy("span").count().where("count > 1").select("span")
    return spans.join(often, "span").groupBy("anchor", "digest").agg(
        F.collect_list(F.struct(F.col("i").alias("a"), (F.col("i") + 1).alias("b"))).alias("ranges")
    )


def _repeated(source: DataFrame) -> DataFrame:
    """(doc_id, th, found): the byte ranges of each document that repeated spans cover, not yet merged."""
    shared = stage(_units(source).join(_anchors(source), "anchor"), "units")
    kinds = stage(
        shared.groupBy("anchor", "digest").agg(
            F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "start", "spans")).alias("one")
        ).select("anchor", "digest", "n", "one.*"), "kinds",
    )
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    mixed = kinds.join(several, "anchor")
    strings = stage(_with_strings(source, mixed).join(several, "anchor"), "strings")
    found = _collected(strings.where(F.col("kinds") <= LARGEST)).unionByName(
        _counted(strings.where(F.col("kinds") > LARGEST))
    )
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("spans").alias("b")))
    inside = found.where(F.size("ranges") > 0).join(kinds.where("n = 1").select("anchor", "digest"), ["anchor", "digest"])
    # A unit with an equal one is repeated as a whole.
    ranges = kinds.where("n > 1").select("anchor", "digest", whole.alias("ranges")).unionByName(inside)
    hits = shared.join(stage(ranges, "ranges"), ["anchor", "digest"]).select(
        "doc_id", "th", F.transform("ranges", lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] - 1 + SPAN).alias("b"))).alias("r")
    )
    return hits.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("r")).alias("found"))


def merge(found: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal ranges of bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in found or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, removed) of every row of ``docs``.

    ``kept`` holds the remaining bytes, ``removed`` the ranges that were taken
    out. Null texts count as empty; texts shorter than a span keep all. Rows
    that repeat in full repeat each other: from 200 bytes on they lose all.
    """
    source = _source(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "found"))
            for key, body, found in zip(*columns, strict=True):
                data, gone = body.encode(), merge(found)
                edges = [0, *[x for r in gone for x in r], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((
                    key, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept,
                    [{"a": a, "b": b} for a, b in gone],
                ))
            if out:
                kinds = (pa.int64(),) * 4 + (pa.string(), pa.binary(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    joined = source.alias("s").join(
        _repeated(source).alias("r"), (F.col("s.th") == F.col("r.th")) & F.col("s.doc_id").eqNullSafe(F.col("r.doc_id")), "left"
    ).select("s.doc_id", "text", "found")
    return joined.mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<a: long, b: long>>"
    )
