"""Nearest neighbours by a hierarchical navigable small-world graph in each shard.

Equal vectors are indexed once, with the few smallest ids that a result may
hold. The distinct vectors are dealt by hash into shards of bounded bytes. One
task builds the graph of one shard; the index is a table with a row per shard:
ids, vectors and, for each level, one flat array of neighbours. A search sends
queries, in groups of bounded bytes, to every shard and merges the shards' best.

Graphs are built and walked for many vectors in step, so that the work is array
work: nodes are ordered by their highest level, level ``l`` consists of the
first rows, and a batch of nodes is inserted at once, with its own members
among the candidates.
"""

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stromlage.session import scratch_path, stage

#: Links of a node on the upper levels; the lowest level has twice as many.
LINKS = 16
#: Candidates held while a node is inserted, and while a query is answered.
EF_BUILD = 64
EF_SEARCH = 128
#: Nodes expanded in one step of a walk, and nodes inserted at once.
WIDE = 4
BATCH = 256
#: Vectors of one shard, and queries sent out at once, in bytes of doubles.
SHARD_BYTES = 4 << 20
QUERY_BYTES = 16 << 20

NONE = np.float32(-np.inf)


class Graph(NamedTuple):
    vectors: np.ndarray  # unit length, float32, nodes of the highest level first
    levels: list[np.ndarray]  # neighbours by row, lowest level first; -1 is free


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _highest_levels(ids: np.ndarray) -> np.ndarray:
    """A node's highest level, from a hash of its id: the same whenever a task is run again."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    share = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
    return (-np.log(1.0 - share) / math.log(LINKS)).astype(int)


def walk(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, ef: int):
    """(ids, similarities) of the ``ef`` nearest nodes met from ``entries`` on one level, nearest first."""
    b, n = len(queries), len(links)
    each = np.arange(b)[:, None]
    seen = np.zeros((b, n), bool)
    seen[each[:, 0], entries] = True
    ids = np.full((b, ef), -1, np.int64)
    sims = np.full((b, ef), NONE, np.float32)
    fresh = np.zeros((b, ef), bool)
    ids[:, 0], fresh[:, 0] = entries, True
    sims[:, 0] = np.einsum("ij,ij->i", vectors[entries], queries)
    wide = min(WIDE, ef)
    while True:
        at = np.flatnonzero(fresh.any(axis=1))
        if not at.size:
            break
        open_sims = np.where(fresh[at], sims[at], NONE)
        first = np.argpartition(-open_sims, wide - 1, axis=1)[:, :wide]
        usable = np.take_along_axis(open_sims, first, 1) > NONE
        nodes = np.take_along_axis(ids[at], first, 1)
        fresh[at[:, None], first] = False
        near = np.where(usable[:, :, None], links[nodes], -1).reshape(len(at), -1)
        r, c = np.nonzero((near >= 0) & ~seen[at[:, None], near])
        keys = np.sort(r * n + near[r, c])
        keys = keys[np.diff(keys, prepend=-1) > 0]
        r, found = keys // n, keys % n
        seen[at[r], found] = True
        start = np.searchsorted(r, np.arange(len(at)))
        column = np.arange(len(r)) - start[r]
        more = np.full((len(at), int(column.max(initial=-1)) + 1), -1, np.int64)
        more_sims = np.full(more.shape, NONE, np.float32)
        more[r, column] = found
        more_sims[r, column] = np.einsum("ij,ij->i", vectors[found], queries[at[r]])
        all_ids, all_sims = np.hstack([ids[at], more]), np.hstack([sims[at], more_sims])
        all_fresh = np.hstack([fresh[at], more >= 0])
        kept = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        ids[at], sims[at] = np.take_along_axis(all_ids, kept, 1), np.take_along_axis(all_sims, kept, 1)
        fresh[at] = np.take_along_axis(all_fresh, kept, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _entries(vectors: np.ndarray, upper: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Where to enter a level: the nearest node found on the levels above (lowest of them first)."""
    at = np.zeros(len(queries), np.int64)
    for links in reversed(upper):
        at = walk(vectors, links, queries, at, WIDE)[0][:, 0]
    return at


def _spread(vectors: np.ndarray, candidates: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """``m`` of the candidates (nearest first): those nearer to the node than to one chosen before, then the nearest others."""
    between = vectors[candidates]
    between = between @ between.transpose(0, 2, 1)
    there = candidates >= 0
    nearest_chosen = np.full(sims.shape, NONE, np.float32)
    chosen = np.zeros(sims.shape, bool)
    room = np.full(len(sims), m)
    for c in range(sims.shape[1]):
        take = there[:, c] & (room > 0) & (sims[:, c] > nearest_chosen[:, c])
        chosen[:, c] = take
        room -= take
        nearest_chosen[take] = np.maximum(nearest_chosen[take], between[take, c])
    order = np.argsort(np.where(chosen, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :m]
    return np.take_along_axis(candidates, order, 1)


def _thin(vectors: np.ndarray, links: np.ndarray, used: np.ndarray, nodes: np.ndarray, m: int) -> None:
    """Cut the lists of ``nodes`` to ``m`` links."""
    for part in np.array_split(nodes, -(-len(nodes) // BATCH)) if len(nodes) else []:
        near = links[part]
        sims = np.where(near >= 0, np.einsum("ijk,ik->ij", vectors[near], vectors[part]), NONE)
        order = np.argsort(-sims, axis=1, kind="stable")
        kept = _spread(vectors, np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1), m)
        links[part] = -1
        links[part, : kept.shape[1]] = kept
        used[part] = (kept >= 0).sum(axis=1)


def _link_back(vectors: np.ndarray, links: np.ndarray, used: np.ndarray, of: np.ndarray, to: np.ndarray, m: int) -> None:
    """Add the links ``of`` -> ``to``; a list that is full is thinned first."""
    order = np.argsort(of, kind="stable")
    of, to = of[order], to[order]
    while of.size:
        place = used[of] + np.arange(len(of)) - np.searchsorted(of, of)
        fits = place < links.shape[1]
        links[of[fits], place[fits]] = to[fits]
        np.add.at(used, of[fits], 1)
        of, to = of[~fits], to[~fits]
        _thin(vectors, links, used, np.unique(of), m)


def _level(vectors: np.ndarray, upper: list[np.ndarray], n: int, m: int) -> np.ndarray:
    """Neighbours on one level of the first ``n`` nodes, at most ``m`` of each."""
    links = np.full((n, 2 * m), -1, np.int32)
    used = np.zeros(n, np.int64)
    at = 0
    while at < n:
        new = np.arange(at, min(n, at + min(BATCH, max(at, LINKS))))
        own = vectors[new]
        sims = own @ own.T
        np.fill_diagonal(sims, NONE)
        ids = np.where(sims > NONE, new[None, :], -1)
        if at:
            entries = _entries(vectors, upper, own)
            found = walk(vectors, links[:at], own, np.where(entries < at, entries, 0), EF_BUILD)
            ids, sims = np.hstack([ids, found[0]]), np.hstack([sims, found[1]])
        order = np.argsort(-sims, axis=1, kind="stable")[:, :EF_BUILD]
        chosen = _spread(vectors, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), m)
        links[new, : chosen.shape[1]] = chosen
        used[new] = (chosen >= 0).sum(axis=1)
        row, column = np.nonzero(chosen >= 0)
        of, to = chosen[row, column], new[row]
        known = (links[of] == to[:, None]).any(axis=1)
        _link_back(vectors, links, used, of[~known], to[~known], m)
        at += len(new)
    _thin(vectors, links, used, np.flatnonzero(used > m), m)
    return links[:, :m].copy()


def build(vectors: np.ndarray, ids: np.ndarray) -> tuple[Graph, np.ndarray]:
    """The graph over ``vectors``, and the order in which it holds them."""
    highest = _highest_levels(ids)
    order = np.argsort(-highest, kind="stable")
    held = unit(vectors[order]).astype(np.float32)
    upper: list[np.ndarray] = []
    for level in range(int(highest.max()), -1, -1):
        n = int((highest >= level).sum())
        upper.insert(0, _level(held, upper, n, LINKS if level else 2 * LINKS))
    return Graph(held, upper), order


def search(graph: Graph, queries: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
    """Rows of the ``ef`` nearest nodes found for each unit query, nearest first; -1 where there are fewer."""
    entries = _entries(graph.vectors, graph.levels[1:], queries)
    return walk(graph.vectors, graph.levels[0], queries, entries, ef)[0]


def _usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    return vectors.select(
        F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")
    ).where(
        F.col("id").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)) & ~F.isnan(x))
        & F.exists("vector", lambda x: x != 0)
    )


INDEX = "dim int, shard int, n int, ids array<array<bigint>>, vectors binary, levels array<binary>"


def build_index(vectors: DataFrame, k: int = 5, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per shard (``INDEX``), staged: fit for searches of up to ``k`` neighbours.

    Rows without an id, and vectors that are null, empty, zero or hold null or
    non-finite components, are left out. Equal vectors are one node with their
    ``k + 1`` smallest ids: more are never returned. A repeated id with an equal
    vector counts once. Other columns are not looked at.
    """
    usable = _usable(vectors, id_column, vector)
    smallest = Window.partitionBy("vector").orderBy("id")
    nodes = stage(
        usable.withColumn("_place", F.row_number().over(smallest)).where(F.col("_place") <= 2 * (k + 1))
        .groupBy("vector").agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids")),
        "vectors",
    )
    size = nodes.agg(F.sum(F.size("vector") * 8)).head()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(first=[x[0] for x in rows["ids"]])
        rows = rows.sort_values("first", kind="stable")
        held = np.stack(rows["vector"].to_list())
        graph, order = build(held, rows["first"].to_numpy())
        return pd.DataFrame({
            "dim": [key[0]], "shard": [key[1]], "n": [len(rows)],
            "ids": [[[int(i) for i in rows["ids"].iloc[o]] for o in order]],
            "vectors": [held[order].astype("<f8").tobytes()],
            "levels": [[x.astype("<i4").tobytes() for x in graph.levels]],
        })

    return stage(
        nodes.withColumn("dim", F.size("vector"))
        .withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int"))
        .groupBy("dim", "shard").applyInPandas(make, INDEX),
        "hnsw",
    )


def _links_of(flat: bytes, level: int) -> np.ndarray:
    return np.frombuffer(flat, "<i4").reshape(-1, LINKS if level else 2 * LINKS)


def _answers(shard: dict, numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple]:
    """(query's number, its id, id, score): each query's ``k`` nearest of one shard, scored on the original vectors."""
    exact = unit(np.frombuffer(shard["vectors"], "<f8").reshape(shard["n"], shard["dim"]))
    graph = Graph(exact.astype(np.float32), [_links_of(x, level) for level, x in enumerate(shard["levels"])])
    ef = max(EF_SEARCH, 4 * (k + 1))
    for at in range(0, len(ids), BATCH):
        asked = unit(vectors[at : at + BATCH])
        found = search(graph, asked.astype(np.float32), ef)[:, : 4 * (k + 1)]
        scores = np.einsum("ijk,ik->ij", exact[found], asked)
        for q in range(len(asked)):
            own = int(ids[at + q])
            best = sorted(
                (-s, i) for f, s in zip(found[q].tolist(), scores[q].tolist()) if f >= 0 for i in shard["ids"][f] if i != own
            )[:k]
            for score, i in best:
                yield int(numbers[at + q]), own, i, -score


def nearest(
    index: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest of ``index`` by cosine, its own id left out.

    Nearest first, ties to the smaller id; the score is computed in doubles on
    the original vectors. A query meets vectors of its own length. Queries that
    may take no part (see ``build_index``) give no rows; repeated queries give
    theirs once.
    """
    spark = index.sparkSession
    asked = stage(_usable(queries, id_column, vector).distinct().select("id", "vector", F.size("vector").alias("dim")), "queries")
    size = asked.agg(F.sum(F.size("vector") * 8)).head()[0] or 0
    groups = max(1, -(-size // QUERY_BYTES))
    path = scratch_path(spark, "nearest")
    schema = "query_row long, query_id long, vec_id long, score double"
    for group in range(groups):
        part = asked.where(F.pmod(F.xxhash64("id", "vector"), F.lit(groups)) == group).toArrow()
        by_dim, before = {}, 0
        for dim in part["dim"].unique().to_pylist():
            rows = part.filter(pa.compute.equal(part["dim"], dim)).combine_chunks()
            flat = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            by_dim[dim] = ((before + np.arange(len(flat))) * groups + group, rows["id"].to_numpy(), flat)
            before += len(flat)
        sent = spark.sparkContext.broadcast(by_dim)

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.to_pylist():
                    asked = sent.value.get(shard["dim"])
                    rows = list(_answers(shard, *asked, k)) if asked else []
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[c] for r in rows], t) for c, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.float64()])],
                        ["query_row", "query_id", "vec_id", "score"],
                    )

        index.mapInArrow(look, schema).write.mode("append").parquet(path)
        sent.destroy()
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (
        spark.read.schema(schema).parquet(path)
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def nearest_neighbours(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Rows of ``vectors`` (vec_id, embedding) whose id is divisible by ``every``, searched among all rows."""
    queries = vectors.where(F.col("vec_id") % every == 0)
    return nearest(build_index(vectors, k), queries, k)
