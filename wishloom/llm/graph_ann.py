"""Approximate nearest neighbours by a robust-pruned directed graph per shard.

Equal vectors are one point: a point keeps the k + 1 least ids of its vector
(chosen by a ranked limit that Spark applies before the shuffle), which is
enough for exact answers however often a vector occurs. Points are dealt into
shards of about `shard_rows` by a hash. One task builds the graph of a shard:
points enter in random order in batches, a greedy search from a few random entry points
proposes neighbours, and pruning goes through them by distance and drops a
candidate that some kept neighbour is closer to by the factor `alpha`, so that
edges of all directions survive. Reverse edges are added and pruned alike. The
graph and its vectors are written to the shared folder.

Query vectors are dealt in blocks; a task maps one shard after the other and
runs a beam search for all its queries together, then scores what the beam
holds exactly, in double precision on the original vectors. Partial results
are merged per query by rank.

Nearness is the inner product. For graph search vectors get one more
component that makes all lengths equal, which turns the largest inner product
into the least distance.

Index bounds: every point is indexed; `beam`, `degree` and `alpha` trade recall
for time, recall is measured in the tests against brute force.

Defined cases: vectors that are null, zero or hold null or non-finite
components, and vectors of another length than most, take no part; null ids take
no part; ties go to the smaller id; an id given twice with one vector counts
once, with different vectors once per vector; fewer than k candidates give
fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wishloom.llm.blobs import mapped, put
from wishloom.plans.scale import scratch_folder, settle


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def beam_search(points: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray,
                beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam search of many queries in step; ids (-1: none) and squared distances, nearest first."""
    n = len(queries)
    length = (points**2).sum(axis=1)
    own = (queries**2).sum(axis=1)
    start = length[entries] + own[:, None] - 2 * queries @ points[entries].T
    ids = np.full((n, max(beam, len(entries))), -1)
    near = np.full(ids.shape, np.inf, start.dtype)
    ids[:, :len(entries)], near[:, :len(entries)] = entries, start
    seen = ids < 0
    rows = np.arange(n)
    while len(rows):
        at = np.where(seen[rows], np.inf, near[rows]).argmin(axis=1)
        live = ~seen[rows, at]
        rows, at = rows[live], at[live]
        if not len(rows):
            break
        seen[rows, at] = True
        following = edges[ids[rows, at]]
        target = np.maximum(following, 0)
        away = length[target] + own[rows][:, None] - 2 * np.matmul(points[target], queries[rows][:, :, None])[:, :, 0]
        known = (following[:, :, None] == ids[rows][:, None, :]).any(axis=2)
        away = np.where((following < 0) | known, np.inf, away)
        all_ids = np.concatenate((ids[rows], following), axis=1)
        all_near = np.concatenate((near[rows], away), axis=1)
        all_seen = np.concatenate((seen[rows], ~np.isfinite(away)), axis=1)
        best = np.argpartition(all_near, ids.shape[1] - 1, axis=1)[:, :ids.shape[1]]
        ids[rows], near[rows], seen[rows] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_near, all_seen))
    order = np.argsort(near, axis=1, kind="stable")
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    return np.where(np.isfinite(near), ids, -1), near


def robust_prune(points: np.ndarray, at: np.ndarray, candidates: np.ndarray, near: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Diverse neighbours of the points `at`, each from its row of candidates (-1: none)."""
    near = np.where((candidates < 0) | (candidates == at[:, None]), np.inf, near)
    order = np.argsort(candidates, axis=1, kind="stable")
    candidates, near = np.take_along_axis(candidates, order, 1), np.take_along_axis(near, order, 1)
    near[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = np.inf
    order = np.argsort(near, axis=1, kind="stable")
    candidates, near = np.take_along_axis(candidates, order, 1), np.take_along_axis(near, order, 1)
    alive = np.isfinite(near)
    pool = points[np.maximum(candidates, 0)]
    length = (pool**2).sum(axis=2)
    gaps = length[:, :, None] + length[:, None, :] - 2 * np.matmul(pool, pool.transpose(0, 2, 1))
    out = np.full((len(at), degree), -1)
    rows = np.arange(len(at))
    for k in range(degree):
        pick = np.where(alive, near, np.inf).argmin(axis=1)
        some = alive[rows, pick]
        if not some.any():
            break
        out[:, k] = np.where(some, candidates[rows, pick], -1)
        alive &= (alpha**2 * gaps[rows, pick] > near) & some[:, None]
        alive[rows, pick] = False
    return out


def build_graph(points: np.ndarray, degree: int, beam: int, alpha: float, entries: int = 32,
                batch: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n x degree, -1: none) and the entry points, which no edge need lead to."""
    n = len(points)
    edges = np.full((n, degree), -1)
    order = np.random.default_rng(7).permutation(n)
    inserted = 1
    entry = order[:entries]
    while inserted < n:
        size = min(batch, max(1, inserted))
        new = order[inserted:inserted + size]
        ids, near = beam_search(points, edges, entry[:inserted], points[new], beam)
        edges[new] = robust_prune(points, new, ids, near, alpha, degree)
        source, target = np.repeat(new, degree), edges[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        hit, first, count = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(hit), 1000):
            part = slice(lo, lo + 1000)
            room = int(count[part].max())
            extra = np.full((len(hit[part]), room), -1)
            row = np.repeat(np.arange(len(hit[part])), count[part])
            inside = np.arange(len(row)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
            extra[row, inside] = source[first[part][0]:first[part][0] + len(row)]
            every = np.concatenate((edges[hit[part]], extra), axis=1)
            full = (every >= 0).sum(axis=1) > degree
            easy = np.argsort(every < 0, axis=1, kind="stable")[:, :degree]
            edges[hit[part]] = np.take_along_axis(every, easy, 1)
            if full.any():
                at = hit[part][full]
                gap = ((points[np.maximum(every[full], 0)] - points[at][:, None, :])**2).sum(axis=2)
                edges[at] = robust_prune(points, at, every[full], gap, alpha, degree)
        inserted += len(new)
    return edges, entry


def _raise(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest - (vectors**2).sum(axis=1), 0))
    return np.column_stack([vectors, rest])


def index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, shard_rows: int = 20_000,
          degree: int = 32, beam: int = 64, alpha: float = 1.1) -> dict:
    """Build one graph per shard; returns the addresses."""
    folder = scratch_folder(vectors.sparkSession, "graphs")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.withColumns({"h": F.xxhash64("v"), "d": F.size("v")})
    sizes = rows.groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return {"shards": [], "k": k, "d": 0}
    d, count = sizes[0]
    by_id = Window.partitionBy("v").orderBy("id")
    points = (
        rows.where(F.col("d") == d).distinct()
        .withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
        .groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )
    shards = max(1, -(-count // shard_rows))
    longest = rows.where(F.col("d") == d).agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]

    def build(group: pd.DataFrame) -> pd.DataFrame:
        raw = np.stack(group["v"].to_numpy()).astype(np.float64)
        order = np.lexsort(raw.T[::-1])
        raw = raw[order]
        ids = [group["ids"].iloc[i] for i in order]
        edges, entry = build_graph(_raise(raw, longest).astype(np.float32), degree, beam, alpha)
        arrays = {"vectors": raw, "edges": edges.astype(np.int32), "ids": np.array([i for x in ids for i in x], np.int64),
                  "cuts": np.cumsum([0, *map(len, ids)]).astype(np.int64)}
        return pd.DataFrame({"entry": [entry.tolist()]} | {n: [put(folder, n, a)] for n, a in arrays.items()})

    made = points.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(
        build, "entry array<bigint>, vectors string, edges string, ids string, cuts string").collect()
    return {"shards": [r.asDict() for r in made], "k": k, "d": d, "longest": longest}


def search(queries: DataFrame, book: dict, key: str = "vec_id", vector: str = "embedding", beam: int = 128,
           block_rows: int = 500) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every query row, itself left out."""
    k, d, shards = book["k"], book["d"], book["shards"]
    asked = queries.select(F.col(f"`{key}`").cast("long").alias("query_id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(
        F.col("query_id").isNotNull() & usable(F.col("v")) & (F.size("v") == d)).distinct()
    fields = "query_id bigint, rank int, vec_id bigint, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, block_rows):
                part = batch.slice(lo, block_rows)
                ids = part.column(0).to_numpy()
                raw = part.column(1).flatten().to_numpy().reshape(-1, d)
                found: list[list[tuple]] = [[] for _ in ids]
                for s in shards:
                    vectors, edges, members, cuts = (np.asarray(mapped(s[n])) for n in ("vectors", "edges", "ids", "cuts"))
                    raised = _raise(vectors, book["longest"]).astype(np.float32)
                    flat = np.column_stack([raw, np.zeros(len(raw))]).astype(np.float32)
                    hits, _ = beam_search(raised, edges, np.array(s["entry"]), flat, max(beam, 2 * k))
                    for i, row in enumerate(hits):
                        at = row[row >= 0]
                        score = (vectors[at] * raw[i]).sum(axis=1)
                        for p, x in zip(at.tolist(), score.tolist(), strict=True):
                            found[i] += [(-x, m) for m in members[cuts[p]:cuts[p + 1]].tolist() if m != ids[i]]
                    found = [sorted(set(f))[:k] for f in found]
                out = [(q, r + 1, m, -x) for q, f in zip(ids.tolist(), found, strict=True) for r, (x, m) in enumerate(f)]
                columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
                     pa.array(columns[3], pa.float64())], names=["query_id", "rank", "vec_id", "score"])

    if not shards:
        return asked.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    parts = asked.sparkSession.sparkContext.defaultParallelism
    return settle(asked).repartition(parts).mapInArrow(run, fields)
