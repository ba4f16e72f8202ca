"""Documents linked by n-gram Jaccard similarity: a blocked sparse matrix product with size bounds.

The matrix has a row for each different text and a column for each word n-gram.
Its product with its own transpose holds the overlap of every two documents;
only entries that can reach the threshold are computed:

* A document with n n-grams can only link to others that hold at least
  ``n - slack`` of them, where ``slack`` is the largest number it may have
  alone. A first product over a fixed part of the columns (hashes below a
  threshold) counts the n-grams that no other document has; a document with too
  many of them is done. The others get all their columns.
* Columns are ordered by rarity. Two linked documents share a column among the
  first ``slack + 1`` of each, so only these take part in the product.
* Overlaps accumulated over these columns, and the sizes of what lies behind
  them, bound the whole overlap. Pairs below it are discarded, the others
  counted exactly.

Blocks are the hash partitions of the columns. Of the pairs in a column not all
are made: at first each document meets the first and the previous one of the
column under several orders; what these links leave in different components
then meets in full. A component needs no more links between its own members.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stromlage.llm.components import components
from stromlage.llm.fingerprints import shingle_hashes
from stromlage.session import stage

NGRAM = 4
#: Linked when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Turns of star links before all remaining pairs meet; fewer if one brings nothing new.
STAR_TURNS = 4
#: Share of the columns that the first product takes: above the share a
#: document may have alone, or it would rule out nothing.
FIRST_COLUMNS = 0.25


def ngrams(text: str | None, size: int = NGRAM) -> np.ndarray:
    """Hashes of the distinct n-grams, A-Z in lower case; a shorter text is one, without words none."""
    return shingle_hashes(text.encode().lower().split(), size) if text else np.zeros(0, np.uint64)


def slack(n: Column, percent: int) -> Column:
    """So many n-grams of ``n`` may be missing in a linked document."""
    return n - F.ceil(F.lit(percent) * n / F.lit(100)).cast("long")


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, th, n, sig, some): size and hash of every document's set, and the n-grams of the first columns. Staged."""
    below = np.uint64(int(FIRST_COLUMNS * (1 << 64)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig, some = [], [], []
            for text in batch.column("text").to_pylist():
                grams = ngrams(text, size)
                n.append(len(grams))
                sig.append(int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64)))
                some.append(grams[: np.searchsorted(grams, below)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(sig, pa.int64()),
                 pa.array(some, pa.list_(pa.int64()))],
                ["doc_id", "th", "n", "sig", "some"],
            )

    return stage(docs.mapInArrow(make, "doc_id long, th long, n long, sig long, some array<long>"), "ngrams")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(sig, n, gram): all n-grams of ``docs`` (sig, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sig, text in zip(batch.column("sig").to_pylist(), batch.column("text").to_pylist(), strict=True):
                grams = ngrams(text, size).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(grams), sig)), pa.array(np.full(len(grams), len(grams))), pa.array(grams)],
                    ["sig", "n", "gram"],
                )

    sets = docs.select("sig", "text").mapInArrow(make, "sig long, n long, gram long")
    return sets.repartition("gram").distinct()  # a row may be repeated


def _may_link(signed: DataFrame, percent: int) -> DataFrame:
    """(sig, doc_id, th) of the different sets that share enough of the first columns, each with one document."""
    sets = signed.where(F.col("n") > 0).groupBy("sig", "n").agg(
        F.min(F.struct("doc_id", "th")).alias("one"), F.max(F.size("some")).alias("some")
    )
    postings = signed.where(F.col("n") > 0).select("sig", F.explode("some").alias("gram")).repartition("gram").distinct()
    column = Window.partitionBy("gram").orderBy("sig")
    shared = (
        postings.withColumns({"_a": F.lag("sig").over(column), "_b": F.lead("sig").over(column)})
        .where(F.col("_a").isNotNull() | F.col("_b").isNotNull())
        .groupBy("sig").agg(F.count("*").alias("shared"))
    )
    alone = F.col("some") - F.coalesce("shared", F.lit(0))
    return sets.join(shared, "sig", "left").where(alone <= slack(F.col("n"), percent)).select("sig", "one.*")


def _rows(sets: DataFrame, percent: int) -> DataFrame:
    """(sig, n, m, p, grams): the m n-grams that other documents have too, rarest first; p of them are the prefix. Staged."""
    counted = sets.withColumn("df", F.count("*").over(Window.partitionBy("gram")))
    rows = (
        counted.where(F.col("df") > 1).groupBy("sig", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("s"))
        .select("sig", "n", F.size("s").cast("long").alias("m"), F.col("s.gram").alias("grams"))
    )
    return stage(
        rows.withColumn("p", slack(F.col("n"), percent) + 1 - (F.col("n") - F.col("m"))).where(F.col("p") > 0), "rows"
    )


def _enough(overlap: Column, na: Column, nb: Column, percent: int) -> Column:
    return (100 + percent) * overlap >= percent * (na + nb)


def _exact(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked."""
    left = rows.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = rows.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    overlap = F.size(F.array_intersect("ga", "gb"))
    sizes = _enough(F.least(F.size("ga"), F.size("gb")), F.col("na"), F.col("nb"), percent)
    joined = pairs.join(left, "a").join(right, "b").where(sizes)
    return joined.where(_enough(overlap, F.col("na"), F.col("nb"), percent)).select("a", "b")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _star(postings: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of documents with the first of a column and with the one before, under two orders."""
    found, names = postings, []
    orders = [[F.col("n") - F.col("m"), F.xxhash64(F.lit(turn), "sig")], [F.xxhash64(F.lit(-1 - turn), "sig")]]
    for k, order in enumerate(orders):
        column = Window.partitionBy("gram").orderBy(*order, "sig")
        other = F.struct("sig", "n", "m", "component")
        so_far = column.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = found.withColumns({f"_f{k}": F.first(other).over(so_far), f"_p{k}": F.lag(other).over(column)})
        names += [f"_f{k}", f"_p{k}"]
    o = F.col("o")
    return (
        found.select("sig", "n", "m", "component", F.explode(F.array(*names)).alias("o"))
        .where(
            o.isNotNull() & (o["component"] != F.col("component"))
            & _enough(F.least("m", o["m"]), F.col("n"), o["n"], percent)
        )
        .select(*_ordered(F.col("sig"), o["sig"])).distinct()
    )


def _product(postings: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components whose overlap in the prefixes leaves the threshold within reach.

    A pair is made in the first column that both have, where its whole overlap in the prefixes is known.
    """
    prefix = F.slice("grams", F.lit(1), F.col("p").cast("int")).alias("prefix")
    full = postings.join(rows.select("sig", prefix), "sig")
    side = lambda x: full.select("gram", *[F.col(c).alias(c + x) for c in ("sig", "n", "m", "p", "component", "prefix")])
    shared = F.array_intersect("prefixa", "prefixb")
    behind = F.greatest(F.col("ma") - F.col("pa"), F.col("mb") - F.col("pb"))
    meet = (
        (F.col("siga") < F.col("sigb")) & (F.col("componenta") != F.col("componentb"))
        & _enough(F.least("ma", "mb"), F.col("na"), F.col("nb"), percent)
        & (F.element_at(shared, 1) == F.col("l.gram"))
        & _enough(F.size(shared) + behind, F.col("na"), F.col("nb"), percent)
    )
    met = side("a").alias("l").join(side("b").alias("r"), (F.col("l.gram") == F.col("r.gram")) & meet)
    return met.select(F.col("siga").alias("a"), F.col("sigb").alias("b"))


def _components(rows: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets that link to another set."""
    prefixes = stage(
        rows.select("sig", "n", "m", "p", F.explode(F.slice("grams", F.lit(1), F.col("p").cast("int"))).alias("gram")),
        "prefixes",
    )
    links, found, turn, whole = None, None, 0, False
    while True:
        if found is None:
            postings = prefixes.withColumn("component", F.col("sig"))
        else:
            labelled = prefixes.join(found.withColumnRenamed("node", "sig"), "sig", "left").withColumn(
                "component", F.coalesce("component", "sig")
            )
            mixed = labelled.groupBy("gram").agg(F.min("component").alias("_a"), F.max("component").alias("_b"))
            postings = labelled.join(mixed.where(F.col("_a") != F.col("_b")).select("gram"), "gram", "left_semi")
        postings = stage(postings, "postings")
        pairs = _product(postings, rows, percent) if whole else _star(postings, turn, percent)
        new = stage(_exact(pairs, rows, percent), "pairs")
        some = bool(new.limit(1).count())
        if some or links is None:
            links = new if links is None else links.unionByName(new)
            found = components(links)
        if whole:
            return found
        turn += 1
        whole = not some or turn == STAR_TURNS


def _labelled(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n, sig) of every row, and (sig, component) of every set of n-grams."""
    body = F.col(f"`{text}`")
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("text"))
    signed = _signed(source, size)
    few = stage(_may_link(signed, percent), "candidates").alias("f")
    # Whatever the number of candidates, the same join: a plan that changes with the size would hide its cost.
    texts = source.alias("s").join(
        few.hint("merge"), (F.col("s.th") == F.col("f.th")) & F.col("s.doc_id").eqNullSafe(F.col("f.doc_id"))
    ).select("sig", "text")
    found = _components(_rows(_sets(texts, size), percent), percent)
    named = signed.where(F.col("n") > 0).select("sig").distinct()
    labels = named.join(found.withColumnRenamed("node", "sig"), "sig", "left").withColumn(
        "component", F.coalesce("component", "sig")
    )
    return signed.drop("some"), labels


def linked_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = NGRAM, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    A component is named by its smallest doc_id. Null and empty texts, and
    those of white space, have no n-grams and link to nothing; equal texts with
    words always link. Rows that share an id with different texts are separate
    documents of one name. Rows without an id form components as others do, and
    are named null if nothing in them has an id. N-grams and sets are told
    apart by 64-bit hashes.
    """
    signed, labels = _labelled(docs, doc_id, text, size, percent)
    words = signed.where(F.col("n") > 0).join(labels, "sig")
    least = words.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    empty = signed.where(F.col("n") == 0).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return (
        words.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)
    )


def keep_one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = NGRAM, percent: int = PERCENT
) -> DataFrame:
    """``docs`` without all but the first document of each component, with all their columns.

    First is the lowest (doc_id, hash of the text), rows without an id last.
    Rows with the same id and text are one document: they stay or go together.
    Texts without words link to nothing and stay.
    """
    signed, labels = _labelled(docs, doc_id, text, size, percent)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    words = signed.where(F.col("n") > 0).join(labels, "sig")
    first = words.groupBy("component").agg(F.min(order).alias("first"))
    gone = words.join(first, "component").where(order != F.col("first")).select("doc_id", "th").distinct()
    return docs.alias("d").join(
        gone.alias("g"),
        F.col(f"d.`{doc_id}`").cast("long").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("g.th")),
        "left_anti",
    )
