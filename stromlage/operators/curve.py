"""Precision-recall curve, best threshold, classification report."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stromlage.operators.ordering import running_sums

#: Bins of scores whose F1 is bounded before any score is sorted.
BINS = 4096


def _ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(empty))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def pr_curve(
    df: DataFrame, score: str = "score", label: str = "label", slices: int | None = None
) -> DataFrame:
    """Precision, recall and F1 at every distinct score taken as threshold.

    Rows collapse to one per score within each task first; the running sums
    then go over distinct scores, in range slices. Without any positive label
    recall is 1 everywhere.
    """
    per_score = df.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n")
    )
    sums = running_sums(
        per_score, [F.col("threshold").desc()], {"pos": "tp", "n": "predicted"}, slices
    )
    precision = _ratio(F.col("tp"), F.col("predicted"))
    recall = _ratio(F.col("tp"), F.col("tp_total"), empty=1.0)
    curve = sums.select(
        "threshold", "tp", (F.col("predicted") - F.col("tp")).alias("fp"),
        precision.alias("precision"), recall.alias("recall"),
    )
    return curve.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def _bin(score: Column) -> Column:
    """One of BINS even parts of 0 to 1 in the order of scores; what lies outside joins the outer ones, NULL is last."""
    even = F.floor(score.cast("double") * BINS)
    inside = F.greatest(F.least(even, F.lit(BINS - 1)), F.lit(0))
    return F.when(score.isNull(), -1).when(F.isnan(score.cast("double")), BINS).otherwise(inside).cast("int")


def threshold_bins(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(_bin, pos, n, above_pos, above_n, whole_pos, upper, lower, live) of every bin that holds a score.

    ``lower`` is the F1 at the bin's lowest score; no score in it does better
    than ``upper``, where its positives all come first. Only a ``live`` bin can
    hold the best threshold. Without positives every F1 is 0, and the lowest
    score is the answer. At most BINS + 2 rows meet in the window.
    """
    bins = df.groupBy(_bin(F.col(score)).alias("_bin")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n")
    ).fillna(0, ["pos"])
    order = Window.orderBy(F.col("_bin").desc())
    above, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = bins.select(
        "*", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"above_{c}") for c in ("pos", "n")],
        F.sum("pos").over(whole).alias("whole_pos"), F.min("_bin").over(whole).alias("_last"),
    )

    def f1(tp: Column, predicted: Column) -> Column:
        return F.lit(2.0) * tp / (predicted + F.col("whole_pos"))

    pos = F.col("pos")
    first = F.greatest(pos, F.lit(1))
    bounds = sums.select(
        "*", f1(F.col("above_pos") + pos, F.col("above_n") + first).alias("upper"),
        f1(F.col("above_pos") + pos, F.col("above_n") + F.col("n")).alias("lower"),
    )
    # A little below the best, so that rounding rules out nothing.
    able = F.col("upper") >= F.max("lower").over(whole) * F.lit(1 - 1e-9)
    live = F.when(F.col("whole_pos") > 0, able).otherwise(F.col("_bin") == F.col("_last"))
    return bounds.withColumn("live", live).drop("_last")


def best_threshold(
    df: DataFrame, score: str = "score", label: str = "label", slices: int | None = None
) -> DataFrame:
    """The threshold of the largest F1, the lowest one on ties; one row.

    Branch and bound: a partial aggregation into bins bounds the F1 of each;
    only scores of bins that can hold the best are sorted and counted exactly.
    """
    live = threshold_bins(df, score, label).filter("live")
    before = Window.orderBy(F.col("_bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # What lies above a live bin, less what the sums over live rows count anyway.
    shifts = {c: (F.col(f"above_{c}") - F.coalesce(F.sum(c).over(before), F.lit(0))) for c in ("pos", "n")}
    offsets = live.select("_bin", "whole_pos", *[c.alias(f"_shift_{k}") for k, c in shifts.items()])
    rows = df.select(F.col(score).alias("threshold"), F.col(label).cast("long").alias("pos"), _bin(F.col(score)).alias("_bin"))
    carried = ["whole_pos", "_shift_pos", "_shift_n"]
    per_score = rows.join(F.broadcast(offsets), "_bin").groupBy("threshold", *carried).agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"), F.count("*").alias("n")
    )
    sums = running_sums(
        per_score, [F.col("threshold").desc()], {"pos": "tp", "n": "predicted"}, slices
    )
    tp, predicted = F.col("tp") + F.col("_shift_pos"), F.col("predicted") + F.col("_shift_n")
    f1 = _f1(_ratio(tp, predicted), _ratio(tp, F.col("whole_pos"), empty=1.0))
    return sums.select("threshold", f1.alias("f1")).orderBy(
        F.col("f1").desc(), F.col("threshold").asc()
    ).limit(1)


def classification_report(
    df: DataFrame,
    threshold: float = 0.5,
    score: str = "score",
    label: str = "label",
    names: tuple[str, str] = ("Normal", "Failure"),
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy and both averages.

    One pass counts the confusion matrix; the rest is arithmetic on its one row.
    """
    y, p = F.col(label) == 1, F.col(score) >= F.lit(threshold)
    cells = df.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    classes = cells.select(
        "*",
        _ratio(tn, tn + fn).alias("p0"), _ratio(tn, tn + fp).alias("r0"),
        _ratio(tp, tp + fp).alias("p1"), _ratio(tp, tp + fn).alias("r1"),
        (tn + fp).alias("n0"), (tp + fn).alias("n1"),
    ).withColumns(
        {
            "f0": _f1(F.col("p0"), F.col("r0")),
            "f1": _f1(F.col("p1"), F.col("r1")),
            "n": F.col("n0") + F.col("n1"),
            "acc": _ratio(tp + tn, F.col("n0") + F.col("n1")),
        }
    )

    def macro(m: str) -> Column:
        return (F.col(f"{m}0") + F.col(f"{m}1")) / F.lit(2.0)

    def weighted(m: str) -> Column:
        total = F.col(f"{m}0") * F.col("n0") + F.col(f"{m}1") * F.col("n1")
        return _ratio(total, F.col("n"))

    def line(name: str, p: Column, r: Column, f: Column, n: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
            f.alias("f1"), n.alias("support"),
        )

    none = F.lit(None).cast("double")
    lines = [
        line(names[k], F.col(f"p{k}"), F.col(f"r{k}"), F.col(f"f{k}"), F.col(f"n{k}"))
        for k in (0, 1)
    ]
    lines.append(line("accuracy", none, none, F.col("acc"), F.col("n")))
    for name, mean in (("macro avg", macro), ("weighted avg", weighted)):
        lines.append(line(name, mean("p"), mean("r"), mean("f"), F.col("n")))
    return classes.select(F.inline(F.array(*lines)))


def known_failures(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Scores of the rows that did fail."""
    return df.filter(F.col(label) == 1).select(
        "corridor_id", "corridor_name", "timestamp", F.col(score).alias("failure_proba")
    )
