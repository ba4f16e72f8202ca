"""Histogram boosting beside a plain version that looks at every split of every node."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stromlage.operators import boosting
from stromlage.operators.boosting import BoostedModel, Growth, even_cuts, fit
from stromlage.sources import artifacts

COLUMNS = ["a", "b", "c"]
SCHEMA = "a DOUBLE, b DOUBLE, c INT, y DOUBLE, w DOUBLE, row STRING"
ALL = {"row_share": 1.0, "column_share": 1.0}


def data(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        a, b, c = rnd.choice([None, math.nan, rnd.random(), rnd.random()]), rnd.gauss(0, 1), rnd.randrange(5)
        y = 0.9 if a is None or a != a else 0.28 if b > 0.3 and c > 2 else 0.05
        out.append((a, b, c, rnd.choice([y, y, 1.0, None]), rnd.choice([1.0, 2.5]), "clash"))
    return out


def brute(rows, growth, edges):
    """node -> (feature, cut, missing_left, gain) or value, of the first tree."""
    kept = [([None if x is None or x != x else float(x) for x in r[:3]], r[4] * (0.5 - r[3]), r[4] * 0.25) for r in rows if r[3] is not None]

    def worth(part):
        return sum(g for _, g, _ in part) ** 2 / (sum(h for *_, h in part) + growth.penalty)

    nodes, found = {0: kept}, {}
    for i in range(2 ** (growth.depth + 1) - 1):
        if i not in nodes:
            continue
        part, best = nodes[i], None
        if i < 2**growth.depth - 1:
            for f, cuts in enumerate(edges):
                for cut in cuts:
                    for missing_left in (False, True):
                        left = [r for r in part if (missing_left if r[0][f] is None else r[0][f] <= cut)]
                        right = [r for r in part if not (missing_left if r[0][f] is None else r[0][f] <= cut)]
                        if min(sum(h for *_, h in x) for x in (left, right)) < growth.least_hessian:
                            continue
                        gain = round(worth(left) + worth(right) - worth(part), 6)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = gain, f, cut, missing_left, left, right
        if best:
            gain, f, cut, missing_left, nodes[2 * i + 1], nodes[2 * i + 2] = best
            found[i] = (COLUMNS[f], pytest.approx(cut), missing_left, pytest.approx(gain, abs=1e-5))
        else:
            g, h = (sum(r[k] for r in part) for k in (1, 2))
            found[i] = pytest.approx(-growth.rate * g / (h + growth.penalty))
    return found


def test_first_tree_same_as_all_splits(spark):
    rows = data(300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    growth = Growth(rounds=1, depth=3, bins=7, **ALL)
    model = fit(df, COLUMNS, "y", F.col("w"), growth, even_cuts)
    got = {
        r.node: (r.feature, r.cut, r.missing_left, r.gain) if r.feature else r.value for r in model.nodes(spark).collect()
    }
    assert got == brute(rows, growth, even_cuts(df.where("y IS NOT NULL"), COLUMNS, 7))
    assert sum(isinstance(v, tuple) for v in got.values()) >= 4


def test_margins_written_down_in_between_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(data(400, 2), SCHEMA).repartition(3)
    growth = Growth(rounds=6, depth=2, bins=16)
    scored = []
    for held in (100, 2):
        monkeypatch.setattr(boosting, "TREES_IN_FLIGHT", held)
        model = fit(df, COLUMNS, "y", growth=growth)
        scored.append(sorted(r.probability for r in model.with_probability(df).collect()))
    assert scored[0] == pytest.approx(scored[1])


def test_missing_values_are_learnt_and_fractions_recovered(spark):
    df = spark.createDataFrame(data(3000, 3), SCHEMA).where("y < 1")
    model = fit(df, COLUMNS, "y", growth=Growth(rounds=40, depth=3, rate=0.3, **ALL))
    found = model.with_probability(df).groupBy("y").agg(F.avg("probability").alias("mean")).collect()
    assert {r.y: r.mean for r in found} == pytest.approx({r.y: r.y for r in found}, abs=0.02)
    later = spark.createDataFrame(data(500, 9), SCHEMA).where("y < 1")
    miss = model.with_probability(later).agg(F.avg(F.abs(F.col("probability") - F.col("y")))).head()[0]
    assert miss < 0.04


def test_saved_and_loaded_gives_the_same(spark, tmp_path):
    df = spark.createDataFrame(data(200, 4), SCHEMA)
    model = fit(df, COLUMNS, "y", growth=Growth(rounds=5))
    artifacts.save_model(spark, model, str(tmp_path / "m"))
    again = artifacts.load_model(spark, str(tmp_path / "m"), COLUMNS)
    assert isinstance(again, BoostedModel) and len(again.trees) == 5
    one, two = ([r.probability for r in m.with_probability(df).collect()] for m in (model, again))
    assert one == pytest.approx(two, abs=1e-12)


def test_rows_and_columns_are_drawn_for_each_tree(spark):
    kept = [boosting._drawn(np.arange(20000), 0.8, 42, n) for n in (0, 1)]
    assert all(abs(k.mean() - 0.8) < 0.02 for k in kept) and (kept[0] != kept[1]).mean() > 0.2
    df = spark.createDataFrame(data(300, 5), SCHEMA)
    nodes = fit(df, COLUMNS, "y", growth=Growth(rounds=8, column_share=0.34)).nodes(spark)
    assert nodes.groupBy("tree").agg(F.count_distinct("feature").alias("n")).agg(F.max("n")).head()[0] == 1


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = fit(empty, COLUMNS, "y", growth=Growth(rounds=2))
    one = spark.createDataFrame([(1.0, None, 2, None, 1.0, "x")], SCHEMA)
    assert [r.probability for r in model.with_probability(one).collect()] == [0.5]
    constant = fit(spark.createDataFrame([(1.0, 1.0, 1, 0.0, 1.0, "x")] * 50, SCHEMA), COLUMNS, "y", growth=Growth(rounds=40))
    assert constant.with_probability(one).head().probability < 0.3


def test_sums_straight_to_the_driver_or_by_a_shuffle_are_the_same(spark, monkeypatch):
    df = spark.createDataFrame(data(400, 6), SCHEMA).repartition(3)
    scored = []
    for cores in (boosting.FEW_CORES, 0):
        monkeypatch.setattr(boosting, "FEW_CORES", cores)
        model = fit(df, COLUMNS, "y", growth=Growth(rounds=3, depth=2, bins=16))
        scored.append(sorted(r.probability for r in model.with_probability(df).collect()))
    assert scored[0] == pytest.approx(scored[1])


def test_the_heavier_side_is_what_the_lighter_leaves_of_a_node(spark):
    df = spark.createDataFrame(data(500, 7), SCHEMA).repartition(3)
    growth = Growth(depth=3, bins=16)
    edges = even_cuts(df, COLUMNS, 16)
    rows = boosting._binned(df, COLUMNS, edges, "y", F.col("w"))
    chosen, tree = [0, 2], boosting.Tree(3)
    drawn = boosting._seen(rows, chosen, 3, growth, 1).cache()
    sums, counted = None, [0]
    for level in range(3):
        sums = boosting._completed(boosting._sums(drawn, tree, level, counted, chosen, growth), counted, sums)
        every = boosting._sums(drawn, tree, level, list(range(2**level)), chosen, growth)
        assert sums == pytest.approx(every, abs=1e-9)
        assert len(counted) <= max(1, 2 ** (level - 1))
        # The lighter sides hold half of the hessians at most.
        assert level == 0 or 2 * every[1, counted, 0].sum() <= every[1, :, 0].sum()
        counted = boosting._split(tree, level, sums, chosen, edges, growth)
        assert counted


def test_rows_end_where_their_values_lead_them():
    rnd = np.random.default_rng(3)
    tree = boosting.Tree(3)
    tree.feature[[0, 1, 2, 4, 5]], tree.bin[[0, 1, 2, 4, 5]] = [1, 0, 2, 2, 1], [4, 2, 7, 3, 250]
    tree.missing_left[[1, 5]], tree.cut[:] = True, tree.bin
    bins = rnd.choice(np.array([0, 1, 2, 3, 4, 7, 8, 250, 255], np.uint8), (3, 400))

    def walk(x):
        i = 0
        while tree.feature[i] >= 0:
            v = x[tree.feature[i]]
            i = 2 * i + 2 - int(tree.missing_left[i] if v == 0 else v <= tree.bin[i])
        return i

    want = [walk(x) for x in bins.T]
    assert tree.nodes_of_bins(bins, 3).tolist() == want
    assert tree.nodes_of([np.where(b == 0, np.nan, b.astype(float)) for b in bins], tree.cut).tolist() == want
    assert tree.nodes_of_bins(bins[[2, 1, 0]], 3, {2: 0, 1: 1, 0: 2}).tolist() == want
