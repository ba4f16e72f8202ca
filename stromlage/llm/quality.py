"""Quality rules: base rules, and robust multivariate outliers by language and source.

Each document gives four transformed statistics. For every language and source
the minimum-covariance-determinant estimate of centre and scatter is sought
over all its documents: from two fixed starts, concentration steps keep the
three quarters of the documents nearest to the present estimate and estimate
anew from them; the start that ends with the smaller determinant is used. A
document too far from it by Mahalanobis distance is rejected.

One concentration step is one pass of built-in aggregations: per group, sums
by bin of distance, of which the nearest bins are added up. A group of any
size is summed in its own tasks first, and only sums are shuffled.

Groups with few documents are pooled by language, and small pools together.
"""

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stromlage.llm.common import words_of
from stromlage.session import stage

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW_WORDS = 5
SYMBOLS = "#*$%&|<>"

#: Share of a group's documents in the subset, and passes of concentration.
SUBSET = 0.5
STEPS = 6
#: Groups smaller than this are pooled; a last pool smaller than this rejects nothing.
MIN_GROUP = 60
#: A clean document is rejected once in so many, were the statistics normal.
REJECTED_OF_CLEAN = 1e-3
#: Least standard deviation of each transformed statistic: most clean documents
#: have no symbols and no repeats at all, and no scatter to judge others by.
LEAST_SPREAD = {"x0": 0.1, "x1": 0.6, "x2": 0.7, "x3": 0.15}

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
X = list(LEAST_SPREAD)
P = len(X)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_BINS_PER_LOG = 24

_word = re.compile(r"[^\x20\x09-\x0D]").search


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """The five base statistics, in the order of ``STATS``; a null text has none of anything."""
    if not text:
        return (0, 0, 0, 0, 0)
    words = words_of(text)
    lines = text.split("\n")
    repeats = 0
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                repeats += _word(line) is not None
            else:
                seen.add(line)
    first: dict[tuple, int] = {}
    covered = bytearray(len(words))
    mark = b"\1" * WINDOW_WORDS
    for i, window in enumerate(zip(*[words[k:] for k in range(WINDOW_WORDS)], strict=False)):
        j = first.setdefault(window, i)
        if j != i:
            covered[i : i + WINDOW_WORDS] = mark
            covered[j : j + WINDOW_WORDS] = mark
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeats, covered.count(1))


def with_stats(docs: DataFrame, text: str, out: str = "_q_") -> DataFrame:
    """``docs`` and the statistics of its texts, under their names after ``out``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([text_stats(t) for t in batch.column(text).to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(made[:, k]) for k in range(len(STATS))]],
                [*batch.schema.names, *[out + s for s in STATS]],
            )

    added = [T.StructField(out + s, T.LongType()) for s in STATS]
    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, *added]))


def base_failed(out: str = "") -> Column:
    words, repeated = F.col(f"{out}n_words"), F.col(f"{out}n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)


def transformed(out: str = "") -> list[Column]:
    """Log word length; log symbols a hundred words; log repeated lines; arcsine root share of repeats."""
    words = F.greatest(F.col(f"{out}n_words"), F.lit(1)).cast("double")
    return [
        F.log(F.greatest(F.col(f"{out}word_chars"), F.lit(1)) / words).alias("x0"),
        F.log1p(100 * F.col(f"{out}n_symbols") / words).alias("x1"),
        F.log1p(F.col(f"{out}n_dup_lines").cast("double")).alias("x2"),
        F.asin(F.sqrt(F.least(F.col(f"{out}n_repeat_words") / words, F.lit(1.0)))).alias("x3"),
    ]


def _tail(x: float, p: int) -> float:
    """P(chi-squared > x) for an even number ``p`` of degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def _quantile(tail: float, p: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _tail(mid, p) > tail else (low, mid)
    return high


CUTOFF = _quantile(REJECTED_OF_CLEAN, P)
#: The scatter of the nearest share of normal data is too small by this factor.
CONSISTENCY = SUBSET / (1 - _tail(_quantile(1 - SUBSET, P), P + 2))


def grouped(vectors: DataFrame) -> DataFrame:
    """(lang, source, level, pool): the group that documents of a language and source are judged in."""
    counts = vectors.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.col("n") < MIN_GROUP
    by_lang = F.sum(F.when(small, F.col("n")).otherwise(0)).over(Window.partitionBy("lang"))
    return counts.withColumn("_pool", by_lang).select(
        "lang", "source",
        F.when(~small, F.struct(F.lit(2).alias("level"), "lang", "source"))
        .when(F.col("_pool") >= MIN_GROUP, F.struct(F.lit(1).alias("level"), "lang", F.lit("").alias("source")))
        .otherwise(F.struct(F.lit(0).alias("level"), F.lit("").alias("lang"), F.lit("").alias("source")))
        .alias("grp"),
    )


def _sums() -> list[Column]:
    return [
        F.count("*").alias("m"),
        *[F.sum(x).alias(f"s_{x}") for x in X],
        *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s_{i}_{j}") for i, j in PAIRS],
    ]


def _estimates(sums: DataFrame, factor: float) -> DataFrame:
    """Centre, inverse scatter and log determinant of each row of sums."""
    floors = np.array([LEAST_SPREAD[x] ** 2 for x in X])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                m = row["m"]
                centre = np.array([row[f"s_{x}"] for x in X]) / m
                scatter = np.zeros((P, P))
                for i, j in PAIRS:
                    scatter[i, j] = scatter[j, i] = row[f"s_{i}_{j}"] / m - centre[i] * centre[j]
                scatter = factor * scatter
                scatter += np.diag(np.maximum(floors - np.diag(scatter), 0))
                out.append([*centre, *[np.linalg.inv(scatter)[i, j] for i, j in PAIRS], np.linalg.slogdet(scatter)[1]])
            made = pd.DataFrame(out, columns=[*[f"c_{x}" for x in X], *[f"i_{i}_{j}" for i, j in PAIRS], "logdet"])
            yield pd.concat([frame[["start", "n"]].reset_index(drop=True), made], axis=1).assign(
                **{k: frame[k].to_numpy() for k in ("g_level", "g_lang", "g_source")}
            )

    flat = sums.select("start", "n", "m", *[F.col(f"grp.{k}").alias(f"g_{k}") for k in ("level", "lang", "source")],
                       *[c for c in sums.columns if c.startswith("s_")])
    numbers = ", ".join(f"{c} double" for c in [*[f"c_{x}" for x in X], *[f"i_{i}_{j}" for i, j in PAIRS], "logdet"])
    solved = flat.mapInPandas(
        solve, f"start int, n long, {numbers}, g_level int, g_lang string, g_source string"
    )
    key = F.struct(F.col("g_level").alias("level"), F.col("g_lang").alias("lang"), F.col("g_source").alias("source"))
    return solved.withColumn("grp", key).drop("g_level", "g_lang", "g_source")


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. from the centre c_x0.. by the inverse scatter i_0_0.."""
    terms = [
        (1 if i == j else 2) * F.col(f"i_{i}_{j}")
        * (F.col(X[i]) - F.col(f"c_{X[i]}")) * (F.col(X[j]) - F.col(f"c_{X[j]}"))
        for i, j in PAIRS
    ]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


def estimate(vectors: DataFrame) -> DataFrame:
    """One row per group (grp): its size n, centre and inverse scatter. ``vectors``: grp, x0.., all judged rows."""
    plain = vectors.groupBy("grp").agg(*_sums())
    first = plain.withColumns({"start": F.lit(0), "n": F.col("m")})
    # The second start tames far values: hyperbolic tangents of standardised statistics.
    shape = vectors.groupBy("grp").agg(
        *[F.avg(x).alias(f"a_{x}") for x in X],
        *[F.greatest(F.stddev_pop(x), F.lit(LEAST_SPREAD[x])).alias(f"d_{x}") for x in X],
    )
    tamed = vectors.join(shape, "grp").select(
        "grp", *[(F.col(f"a_{x}") + F.col(f"d_{x}") * F.tanh((F.col(x) - F.col(f"a_{x}")) / F.col(f"d_{x}"))).alias(x) for x in X]
    )
    second = tamed.groupBy("grp").agg(*_sums()).withColumns({"start": F.lit(1), "n": F.col("m")})
    params = stage(_estimates(first.unionByName(second), 1.0), "mcd")
    nearest = Window.partitionBy("grp", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(STEPS):
        binned = vectors.join(params, "grp").withColumn(
            "bin", F.floor(F.log1p(F.least(distance(), F.lit(1e12))) * _BINS_PER_LOG).cast("int")
        )
        sums = binned.groupBy("grp", "start", "n", "bin").agg(*_sums())
        inside = sums.withColumn("_before", F.coalesce(F.sum("m").over(nearest), F.lit(0))).where(
            F.col("_before") < F.ceil(F.lit(SUBSET) * F.col("n"))
        )
        names = ["m", *[f"s_{x}" for x in X], *[f"s_{i}_{j}" for i, j in PAIRS]]
        params = stage(
            _estimates(inside.groupBy("grp", "start", "n").agg(*[F.sum(c).alias(c) for c in names]), CONSISTENCY), "mcd"
        )
    best = F.min_by(F.struct(*[c for c in params.columns if c != "grp"]), F.struct("logdet", "start"))
    return stage(params.groupBy("grp").agg(best.alias("best")).select("grp", "best.*"), "mcd")


def _vectors(docs: DataFrame, text: str, lang: str, source: str, keep: list[str]) -> DataFrame:
    """Statistics, statistics' transforms and group keys of every row, staged; texts are left behind."""
    plain = docs.select(
        *keep,
        F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("_q_lang"),
        F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("_q_source"),
        F.col(f"`{text}`").alias("_q_text"),
    )
    counted = with_stats(plain, "_q_text").select(
        *keep, F.col("_q_lang").alias("lang"), F.col("_q_source").alias("source"),
        *[F.col(f"_q_{s}").alias(s) for s in STATS],
    )
    return stage(counted.withColumn("base_failed", base_failed()), "quality")


def models(stats: DataFrame) -> DataFrame:
    """(lang, source) and the estimate its documents are judged by."""
    groups = stage(grouped(stats), "groups")
    rows = stats.where(~F.col("base_failed")).select("lang", "source", *transformed()).join(groups, ["lang", "source"])
    return groups.join(estimate(stage(rows.select("grp", *X), "vectors")), "grp").drop("grp")


def _kept() -> Column:
    """Outliers of a group large enough to judge by go, as do documents that fail the base rules."""
    far = (F.coalesce(F.col("n"), F.lit(0)) >= MIN_GROUP) & (F.coalesce(F.col("distance"), F.lit(0.0)) > CUTOFF)
    return ~F.col("base_failed") & ~far


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, the base statistics, base_failed, kept, distance) of every row of ``docs``.

    Null or empty texts have no words and fail the base rules; null languages
    and sources count as empty names. Equal rows get equal verdicts. ``distance`` is
    null for rows that fail the base rules.
    """
    stats = _vectors(docs.withColumn("_q_id", F.col(f"`{doc_id}`")), text, lang, source, ["_q_id"])
    judged = (
        stats.select("*", *transformed()).join(models(stats), ["lang", "source"], "left")
        .withColumn("distance", F.when(~F.col("base_failed"), distance()))
    )
    return judged.select(
        F.col("_q_id").alias("doc_id"), *STATS, "base_failed", _kept().alias("kept"), "distance"
    )


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns; repeated rows are judged alike."""
    found = models(_vectors(docs, text, lang, source, [])).select(
        F.col("lang").alias("_q_lang"), F.col("source").alias("_q_source"), F.struct("*").alias("_q_model")
    )
    counted = with_stats(docs, text).withColumns({
        "_q_lang": F.coalesce(F.col(f"`{lang}`"), F.lit("")), "_q_source": F.coalesce(F.col(f"`{source}`"), F.lit("")),
    })
    judged = counted.where(~base_failed("_q_")).join(found, ["_q_lang", "_q_source"], "left")
    moved = judged.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_q_row"), "_q_model.*", *transformed("_q_"),
    )
    far = (F.coalesce(F.col("n"), F.lit(0)) >= MIN_GROUP) & (F.coalesce(distance(), F.lit(0.0)) > CUTOFF)
    return moved.where(~far).select("_q_row.*")
