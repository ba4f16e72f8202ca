"""Second-order boosted trees on fractional labels, grown level by level from histograms (M1, M2, M5).

Features are cut into bins once, at quantiles from one mergeable sketch pass.
Each level of a tree is one aggregation: tasks add up gradients and hessians by
(node, feature, bin) over their rows, and the driver picks the splits from at most
``2 ** (depth - 1) * features * (bins + 1)`` sums, whatever the number of rows. The rows
a tree sees are drawn once, with their gradients; of the two sides of a split only the
lighter is counted, the other is the rest of the node. With few cores the sums of each task reach it as they are, one small job a level; with
many they are shuffled and added first. Rows travel as blocks of plain arrays, and
margins are carried on in memory from tree to tree. A missing value has a bin of
its own and goes to the side where it gains more: nothing is filled in.
"""

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stromlage.session import stage

#: Trees whose values are carried on in memory; then the margins are written down.
TREES_IN_FLIGHT = 20
#: With more cores than this the sums of tasks are added by a shuffle before they reach the driver.
FEW_CORES = 64
#: Gains are compared to this many decimals: equal splits go by feature and cut, whatever the order of the sums.
GAIN_PLACES = 6

NODES = "tree int, node int, feature string, cut double, missing_left boolean, gain double, value double"


@dataclass(frozen=True)
class Growth:
    """How trees grow; ``penalty`` is added to hessians, ``least_hessian`` is asked of both sides of a split."""

    rounds: int = 300
    depth: int = 4
    rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    bins: int = 64
    penalty: float = 1.0
    least_hessian: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number; the children of ``i`` are ``2 i + 1`` and ``2 i + 2``. Feature -1 is a leaf."""

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    missing_left: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = 2 ** (self.depth + 1) - 1
        self.feature, self.bin = np.full(n, -1), np.zeros(n, int)
        self.missing_left = np.zeros(n, bool)
        self.cut, self.gain, self.value = np.zeros(n), np.zeros(n), np.zeros(n)

    def _walk(self, n: int, steps: int, left: Callable[[int], np.ndarray]) -> np.ndarray:
        """The node of each of ``n`` rows after so many steps down; ``left`` tells which rows would go left at a node.

        All rows are held against one node at a time: plain passes over columns, far cheaper than a look-up for each row.
        """
        at = np.zeros(n, np.min_scalar_type(len(self.feature)))
        for level in range(steps):
            below = at.copy()
            for i in range(2**level - 1, 2 ** (level + 1) - 1):
                if self.feature[i] >= 0:
                    np.copyto(below, at.dtype.type(2 * i + 2) - left(i), where=at == i)
            at = below
        return at

    def nodes_of_bins(self, bins: np.ndarray, steps: int, place: dict[int, int] | None = None) -> np.ndarray:
        """The node of each row after so many steps down; ``bins`` is by feature (or by its ``place``), and 0 is a missing value."""

        def left(i: int) -> np.ndarray:
            x, last = bins[self.feature[i] if place is None else place[self.feature[i]]], np.uint8(self.bin[i])
            # Less by one, a missing value is the highest byte.
            return (x <= last if self.missing_left[i] else x - np.uint8(1) < last).view(np.uint8)

        return self._walk(bins.shape[1], steps, left)

    def nodes_of(self, values: list[np.ndarray], limit: np.ndarray) -> np.ndarray:
        """The node where each row ends; ``values`` is by feature, and ``limit`` what a value is held against at each node."""

        def left(i: int) -> np.ndarray:
            x = values[self.feature[i]]
            # A missing value compares as false.
            return (~(x > limit[i]) if self.missing_left[i] else x <= limit[i]).view(np.uint8)

        return self._walk(len(values[0]), self.depth, left)

    def values_of_bins(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes_of_bins(bins, self.depth)]


@dataclass(frozen=True)
class BoostedModel:
    """Trees over named columns; a row's margin is the sum of its leaves."""

    columns: list[str]
    trees: list[Tree]

    def margin(self) -> Column:
        trees = self.trees

        @F.pandas_udf("double")
        def of(*columns: pd.Series) -> pd.Series:
            values = [c.to_numpy(float, na_value=np.nan) for c in columns]
            total = np.zeros(len(values[0]))
            for tree in trees:
                total += tree.value[tree.nodes_of(values, tree.cut)]
            return pd.Series(total)

        return of(*(F.col(c).cast("double") for c in self.columns))

    def with_probability(self, df: DataFrame) -> DataFrame:
        return df.withColumn("probability", 1 / (1 + F.exp(-self.margin())))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The model as a table (``NODES``): only nodes that are reached. A leaf has no feature."""
        rows = []
        for number, t in enumerate(self.trees):
            reached = {0}
            for i in range(len(t.feature)):
                if i in reached:
                    inner = t.feature[i] >= 0
                    reached |= {2 * i + 1, 2 * i + 2} if inner else set()
                    rows.append((
                        number, i, self.columns[t.feature[i]] if inner else None, float(t.cut[i]) if inner else None,
                        bool(t.missing_left[i]) if inner else None, float(t.gain[i]) if inner else None,
                        None if inner else float(t.value[i]),
                    ))
        return spark.createDataFrame(rows, NODES)

    @classmethod
    def from_nodes(cls, nodes: DataFrame, columns: list[str]) -> "BoostedModel":
        held = nodes.collect()
        depth = max((int(r.node + 1).bit_length() - 1 for r in held), default=0)
        trees = [Tree(depth) for _ in range(1 + max((r.tree for r in held), default=-1))]
        for r in held:
            t = trees[r.tree]
            if r.feature is None:
                t.value[r.node] = r.value
            else:
                t.feature[r.node], t.cut[r.node] = columns.index(r.feature), r.cut
                t.missing_left[r.node], t.gain[r.node] = r.missing_left, r.gain
        return cls(columns, trees)


def _plain(column: str) -> Column:
    """A feature as a double; NaN is missing."""
    return F.nullif(F.col(column).cast("double"), F.lit(float("nan")))


def quantile_cuts(df: DataFrame, columns: list[str], bins: int = 64) -> list[np.ndarray]:
    """Up to ``bins - 1`` cuts of each column at its quantiles; all columns in one pass of mergeable sketches."""
    shares = [i / bins for i in range(1, bins)]
    one = df.agg(*(F.percentile_approx(_plain(c), shares, 20 * bins).alias(f"_{i}") for i, c in enumerate(columns))).head()
    return [np.unique(np.array(x or [], float)) for x in one]


def even_cuts(df: DataFrame, columns: list[str], bins: int = 64) -> list[np.ndarray]:
    """``bins - 1`` cuts of each column, evenly from its least to its greatest value."""
    ends = [f(_plain(c)).alias(f"_{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]
    one = df.agg(*ends).head()
    pairs = [(one[f"_lo{i}"], one[f"_hi{i}"]) for i in range(len(columns))]
    return [np.array([] if lo is None else [lo + (hi - lo) * i / bins for i in range(1, bins)]) for lo, hi in pairs]


#: A block of rows: an array of each, as bytes.
BLOCKS = "row binary, bins binary, y binary, w binary, margin binary"
_KINDS = (np.int64, np.uint8, np.float64, np.float64, np.float64)


def _block(*arrays: np.ndarray) -> pa.RecordBatch:
    held = [pa.array([np.ascontiguousarray(x, t).tobytes()], pa.binary()) for x, t in zip(arrays, _KINDS)]
    return pa.RecordBatch.from_arrays(held, ["row", "bins", "y", "w", "margin"])


def _blocks(batches: Iterator[pa.RecordBatch], n_features: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, bins by feature, y, w, margin) of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            row, bins, y, w, margin = (np.frombuffer(c[k].as_buffer(), t) for c, t in zip(batch.columns, _KINDS))
            yield row, bins.reshape(n_features, len(row)), y, w, margin


def _binned(df: DataFrame, columns: list[str], cuts: list[np.ndarray], label: str, weight: Column) -> DataFrame:
    """Blocks (``BLOCKS``) with a byte for each row and feature: 0 if missing, else one more than the cuts below the value."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            held = np.zeros((len(columns), n), np.uint8)
            for i, edges in enumerate(cuts):
                x = batch.column(i + 3).to_numpy(zero_copy_only=False).astype(float)
                held[i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(edges, x, side="left"))
            row, y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            yield _block(row, held, y, w, np.zeros(n))

    return df.select(
        F.monotonically_increasing_id().alias("_row"), F.col(label).cast("double").alias("_y"), weight.cast("double").alias("_w"),
        *(_plain(c).alias(f"_f{i}") for i, c in enumerate(columns)),
    ).where(F.col("_y").isNotNull()).mapInArrow(cut, BLOCKS)


def _drawn(row: np.ndarray, share: float, seed: int, number: int) -> np.ndarray:
    """Which rows a tree sees: by a hash of row, seed and tree, the same whenever a task is run again."""
    x = row.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + number) & (2**63 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53 < share


#: The rows that a tree sees: bytes of its columns, gradients and hessians.
DRAWN = "bins binary, g binary, h binary"


def _seen(rows: DataFrame, columns: list[int], n_features: int, growth: Growth, number: int) -> DataFrame:
    """Blocks (``DRAWN``) of the rows drawn for a tree: made once, and read at each of its levels."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, bins, y, w, margin in _blocks(batches, n_features):
            seen = w > 0
            if growth.row_share < 1:
                seen &= _drawn(row, growth.row_share, growth.seed, number)
            at = np.flatnonzero(seen)
            if len(at):
                p, weight = 1 / (1 + np.exp(-margin.take(at))), w.take(at)
                held = np.stack([bins[c].take(at) for c in columns]), weight * (p - y.take(at)), weight * p * (1 - p)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in held], ["bins", "g", "h"])

    return rows.mapInArrow(draw, DRAWN)


def _sums(drawn: DataFrame, tree: Tree, level: int, counted: list[int], columns: list[int], growth: Growth) -> np.ndarray:
    """(gradients, hessians) by counted node of the level, chosen column and bin: one aggregation over all rows drawn."""
    width = growth.bins + 1
    shape = (len(counted), len(columns), width)
    size = len(counted) * len(columns) * width
    place = {c: k for k, c in enumerate(columns)}
    start_of = np.full(len(tree.feature), -1)
    start_of[np.array(counted) + 2**level - 1] = np.arange(len(counted)) * width

    def added(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros((2, *shape))
        for batch in batches:
            for k in range(batch.num_rows):
                g, h = (np.frombuffer(batch.column(i)[k].as_buffer()) for i in (1, 2))
                bins = np.frombuffer(batch.column(0)[k].as_buffer(), np.uint8).reshape(len(columns), len(g))
                start, at = 0, slice(None)
                if level:
                    start = start_of.take(tree.nodes_of_bins(bins, level, place))
                    at = np.flatnonzero(start >= 0)
                    start, g, h = start.take(at), g.take(at), h.take(at)
                for c in range(len(columns)):
                    cell = start + bins[c][at].astype(np.int64)
                    for i, x in enumerate((g, h)):
                        sums[i, :, c] += np.bincount(cell, x, len(counted) * width).reshape(-1, width)
        return sums.reshape(2, size)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([added(batches).tobytes()], pa.binary())], ["sums"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = added(batches)
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], ["cell", "g", "h"])

    out = np.zeros((2, size))
    cores = drawn.sparkSession.sparkContext.defaultParallelism
    if cores <= FEW_CORES:
        for r in drawn.coalesce(cores).mapInArrow(whole, "sums binary").collect():
            out += np.frombuffer(r.sums).reshape(2, size)
    else:
        found = drawn.mapInArrow(cells, "cell long, g double, h double").groupBy("cell").agg(
            F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        out[:, found["cell"].to_numpy()] = found["g"].to_numpy(), found["h"].to_numpy()
    return out.reshape(2, *shape)


def _completed(sums: np.ndarray, counted: list[int], above: np.ndarray | None) -> np.ndarray:
    """The sums of all nodes of a level: one child of each split node was counted, the other is what is left of the node."""
    if above is None:
        return sums
    out = np.zeros((2, 2 * above.shape[1], *above.shape[2:]))
    for k, node in enumerate(counted):
        out[:, node] = sums[:, k]
        out[:, node ^ 1] = above[:, node // 2] - sums[:, k]
    return out


def _split(tree: Tree, level: int, sums: np.ndarray, columns: list[int], cuts: list[np.ndarray], growth: Growth) -> list[int]:
    """The best split of every node of a level, and the values of its two sides; the lighter side of each, by its place below."""

    def worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + growth.penalty)

    total = sums[:, :, 0].sum(axis=2)  # every column sees all rows of a node
    below = np.cumsum(sums[:, :, :, 1:], axis=3)[:, :, :, :-1]
    # Missing values on the right, or on the left.
    left = np.stack([below, below + sums[:, :, :, :1]], axis=4)
    right = total[:, :, None, None, None] - left
    gain = worth(*left) + worth(*right) - worth(*total)[:, None, None, None]
    allowed = (left[1] >= growth.least_hessian) & (right[1] >= growth.least_hessian)
    n_cuts = np.array([len(cuts[c]) for c in columns])
    allowed &= (np.arange(gain.shape[2]) < n_cuts[:, None])[None, :, :, None]
    gain = np.where(allowed, np.round(gain, GAIN_PLACES), 0.0)
    first, lighter = 2**level - 1, []
    for node in range(2**level):
        if not total[1, node]:
            continue
        best = int(gain[node].argmax())
        c, b, side = np.unravel_index(best, gain[node].shape)
        if gain[node, c, b, side] <= 0:
            continue
        i = first + node
        tree.feature[i], tree.bin[i], tree.missing_left[i] = columns[c], b + 1, bool(side)
        tree.cut[i], tree.gain[i] = cuts[columns[c]][b], gain[node, c, b, side]
        for child, (g, h) in ((2 * i + 1, left[:, node, c, b, side]), (2 * i + 2, right[:, node, c, b, side])):
            tree.value[child] = -growth.rate * g / (h + growth.penalty)
        lighter.append(2 * node + int(left[1, node, c, b, side] > right[1, node, c, b, side]))
    return lighter


def fit(
    df: DataFrame, columns: list[str], label: str, weight: Column | None = None, growth: Growth = Growth(), cuts=quantile_cuts
) -> BoostedModel:
    """Boosted trees for the fractional label (0 to 1): loss -y log p - (1 - y) log(1 - p), rows weighted.

    Rows without a label are left out; a missing feature is a value of its own.
    A table without labelled rows gives a model without splits: margin 0.
    """
    if not 1 < growth.bins < 256:
        raise ValueError("a bin is one byte")
    labelled = df.where(F.col(label).isNotNull())
    edges = cuts(labelled, columns, growth.bins)
    rows = stage(_binned(labelled, columns, edges, label, F.lit(1.0) if weight is None else weight), "binned")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    trees: list[Tree] = []
    before = None
    for number in range(growth.rounds):
        chosen = sorted(random.Random(growth.seed + number).sample(
            range(len(columns)), max(1, round(growth.column_share * len(columns)))))
        tree = Tree(growth.depth)
        drawn = _seen(rows, chosen, len(columns), growth, number).persist(StorageLevel.MEMORY_AND_DISK)
        sums, counted = None, [0]
        for level in range(growth.depth):
            sums = _completed(_sums(drawn, tree, level, counted, chosen, growth), counted, sums)
            if level == 0:
                if before is not None:  # the pass has put the new margins in its place
                    before.unpersist()
                if sums[1].any():
                    g, h = sums[:, 0, 0].sum(axis=1)
                    tree.value[0] = -growth.rate * g / (h + growth.penalty)
            counted = _split(tree, level, sums, chosen, edges, growth)
            if not counted:
                break
        drawn.unpersist()
        trees.append(tree)
        if number + 1 < growth.rounds:
            added = _with_margins(rows, tree, len(columns))
            if len(trees) % TREES_IN_FLIGHT == 0:
                added = stage(added, "margins")
            before, rows = rows, added.persist(StorageLevel.MEMORY_AND_DISK)
    rows.unpersist()
    return BoostedModel(columns, trees)


def _with_margins(rows: DataFrame, tree: Tree, n_features: int) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, bins, y, w, margin in _blocks(batches, n_features):
            yield _block(row, bins, y, w, margin + tree.values_of_bins(bins))

    return rows.mapInArrow(add, BLOCKS)
