"""Scoring utterance vectors against option vectors.

Options are written once to the shared folder as tiles of about `tile_bytes`,
options of like direction together. Every tile has a centre and a radius: by
Cauchy and Schwarz no option of it scores further from the centre's score than the
radius, so a tile whose bound cannot change an answer is not read. Utterances stay
where they are: a task takes many of them at once, goes through the tiles
with the most promising first, reads each at most once for all of them and keeps
running answers (target score, top two, kept options). Memory is the utterances
of a step and one tile, and nothing is shuffled. What leaves a task is the
answer per utterance, never all pairs. Ties go to the earlier option by (order, id);
scores are equal if they agree to DIGITS decimals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import (PURITY_MARGIN, PURITY_MIN_SCORE, SEMANTIC_THRESHOLD,
                                      SEMANTIC_TOP_K)
from ..plans.scale import global_position, scratch_folder

TILE_BYTES = 8_000_000
STEP_BYTES = 32_000_000
PIVOTS = 256
SAMPLE = 8
DIGITS = 12
SLACK = 1e-9

_ANSWER = ("target_score double, target_sum double, target_hits int, target_rank long, top_option string, top_score double, "
           "runner_up double, best_non_target double")


def _unit_rows(column) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype="float64") for v in column])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _table(file: str, columns: list[str]):
    if re.match(r"file:/|/", file):
        return pq.read_table(re.sub(r"^file:/+", "/", file), columns=columns)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(file)
    return pq.read_table(path, filesystem=store, columns=columns)


class Tiles:
    """Tiles with their bounds; `reads` counts how many were read."""

    def __init__(self, files: list[str], centres: np.ndarray, radii: np.ndarray, sizes: np.ndarray):
        self.files, self.centres, self.radii, self.sizes = files, centres, radii, sizes
        self.reads = 0
        self.named: dict[str, int] | None = None

    def read(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, places and unit vectors of a tile, in order of place."""
        self.reads += 1
        table = _table(self.files[number], ["id", "place", "vector"]).sort_by("place")
        return (np.array(table["id"].to_pylist(), dtype=object), table["place"].to_numpy().astype(np.int64),
                _unit_rows(table["vector"].to_pylist()))

    def holding(self, wanted: set[str]) -> dict[int, list[str]]:
        """Tiles that hold wanted options; only ids are read for it, once per worker."""
        if self.named is None:
            self.named = {x: i for i, file in enumerate(self.files) for x in _table(file, ["id"])["id"].to_pylist()}
        held: dict[int, list[str]] = {}
        for x in wanted & self.named.keys():
            held.setdefault(self.named[x], []).append(x)
        return held

    def middle(self, units: np.ndarray, number: int) -> np.ndarray:
        """Scores of a tile's centre; those of its options lie within the radius."""
        return units @ self.centres[number]

    def promising(self, units: np.ndarray) -> list[int]:
        """Tiles by the greatest score that any utterance can have in them, greatest first."""
        best = [float(self.middle(units, i).max()) + r for i, r in enumerate(self.radii)] if len(units) else [0.0] * len(self.files)
        return np.argsort(-np.array(best), kind="stable").tolist()


def write_tiles(options: DataFrame, option: str, vector: str, order: str, tile_bytes: int = TILE_BYTES) -> Tiles:
    """Options as files of bounded size, those nearest to the same one of some options together.

    These are at most PIVOTS, spread out over a sample of SAMPLE times as many;
    they decide which tiles can be skipped and never an answer.
    """
    spark = options.sparkSession
    folder = scratch_folder(spark, "tiles")
    rows = options.select(F.col(option).cast("string").alias("id"), F.col(order).alias("ord"),
                          F.col(vector).cast("array<double>").alias("vector"))
    placed = global_position(rows, ["ord", "id"], name="place").select("id", "place", "vector")
    width, count = placed.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    tile_rows = max(1, tile_bytes // (8 * max(width or 1, 1)))
    wanted = min(PIVOTS, -(-count // tile_rows))
    schema = "id string, place bigint, vector array<double>"
    if wanted > 1:
        chosen = _spread(_unit_rows([r.vector for r in placed.orderBy(F.xxhash64("id", "place"), "place").limit(SAMPLE * wanted).collect()]), wanted)

        def assign(batches):
            for batch in batches:
                yield batch.assign(near=(_unit_rows(batch["vector"]) @ chosen.T).argmax(axis=1)) if len(batch) else batch.assign(near=[])

        placed = placed.mapInPandas(assign, f"{schema}, near int").repartitionByRange("near", "place").sortWithinPartitions("near", "place")
    else:
        placed = placed.withColumn("near", F.lit(0)).coalesce(1)  # one tile's worth of options
    placed.write.partitionBy("near").option("maxRecordsPerFile", tile_rows).parquet(folder)
    files = sorted(spark.read.schema(schema).parquet(folder).inputFiles())

    def bounds(batches):
        for batch in batches:
            found = []
            for file in batch["file"]:
                units = _unit_rows(held) if (held := _table(file, ["vector"])["vector"].to_pylist()) else np.zeros((0, 1))
                centre = units.mean(axis=0) if len(units) else np.zeros(1)
                found.append((file, centre.tolist(), float(np.sqrt(((units - centre) ** 2).sum(axis=1)).max(initial=0.0)), len(units)))
            yield pd.DataFrame(found, columns=["file", "centre", "radius", "size"])

    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 64)))
    known = sorted((r for r in listed.mapInPandas(bounds, "file string, centre array<double>, radius double, size bigint").collect() if r["size"]), key=lambda r: r.file)
    return Tiles([r.file for r in known], np.array([r.centre for r in known]) if known else np.zeros((0, 1)), np.array([r.radius for r in known]),
                 np.array([r["size"] for r in known], np.int64))


def _spread(units: np.ndarray, wanted: int) -> np.ndarray:
    """Some of the rows, each the one that lies furthest from those before it."""
    picked, nearest = [0], units @ units[0]
    while len(picked) < min(wanted, len(units)):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[picked[-1]])
    return units[picked]


def _steps(batches: Iterator[pd.DataFrame], vector: str) -> Iterator[pd.DataFrame]:
    """Utterances of several batches together, up to STEP_BYTES of vectors."""
    held, size = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += 8 * sum(map(len, batch[vector]))
        if size >= STEP_BYTES:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _scores(units: np.ndarray, tile: np.ndarray) -> np.ndarray:
    return np.round(units @ tile.T, DIGITS)


def target_answers(units: np.ndarray, wanted: list[set], tiles: Tiles) -> pd.DataFrame:
    """Target score, sum and hits, rank, top two and best non-target of every utterance."""
    n = len(units)
    best, at = np.full(n, -np.inf), np.full(n, -1)
    total, hits = np.zeros(n), np.zeros(n, int)
    for number, names in sorted(tiles.holding(set().union(*wanted)).items()):
        ids, place, tile = tiles.read(number)
        where = {x: i for i, x in enumerate(ids)}
        own = [(i, where[x]) for i, mine in enumerate(wanted) for x in mine.intersection(names)]
        scored = np.round(np.einsum("ij,ij->i", units[[i for i, _ in own]], tile[[j for _, j in own]]), DIGITS) if own else []
        for (i, j), score in zip(own, scored, strict=True):
            total[i] += score
            hits[i] += 1
            if score > best[i] or score == best[i] and place[j] < at[i]:
                best[i], at[i] = score, place[j]
    top, top_id, top_at = np.full(n, -np.inf), np.full(n, None, object), np.full(n, np.iinfo(np.int64).max)
    second, other, better = np.full(n, -np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)
    found = hits > 0
    for number in tiles.promising(units):
        middle, radius = tiles.middle(units, number), tiles.radii[number] + SLACK
        all_better = found & (middle - radius > best)
        lists = middle + radius >= np.minimum(second, other)
        ranks = found & ~all_better & (middle + radius >= best)
        better[all_better & ~lists] += tiles.sizes[number]
        rows = np.flatnonzero(lists | ranks)
        if not len(rows):
            continue
        ids, place, tile = tiles.read(number)
        scores = _scores(units[rows], tile)
        rest = scores.copy()
        where = {x: i for i, x in enumerate(ids)}
        for k, i in enumerate(rows.tolist()):
            for x in wanted[i]:
                if x in where:
                    rest[k, where[x]] = -np.inf
        b, a = best[rows][:, None], at[rows][:, None]  # no target scores above the best of them
        better[rows] += np.where(found[rows], ((rest > b) | ((rest == b) & (place < a))).sum(axis=1), 0)
        other[rows] = np.maximum(other[rows], rest.max(axis=1))
        some = np.arange(len(rows))
        lead = scores.argmax(axis=1)
        one = scores[some, lead].copy()
        scores[some, lead] = -np.inf
        two = scores.max(axis=1)
        ahead = (one > top[rows]) | ((one == top[rows]) & (place[lead] < top_at[rows]))
        second[rows] = np.where(ahead, np.maximum(top[rows], two), np.maximum(second[rows], one))
        top_id[rows] = np.where(ahead, ids[lead], top_id[rows])
        top_at[rows] = np.where(ahead, place[lead], top_at[rows])
        top[rows] = np.where(ahead, one, top[rows])
    return pd.DataFrame({
        "target_score": np.where(found, best, np.nan), "target_sum": total, "target_hits": hits,
        "target_rank": pd.Series(better + 1).where(found).astype("Int64"), "top_option": top_id, "top_score": top,
        "runner_up": np.where(np.isfinite(second), second, -1.0), "best_non_target": np.where(np.isfinite(other), other, -1.0)})


def kept_options(units: np.ndarray, threshold: float, top_k: int, tiles: Tiles) -> list[list[tuple]]:
    """Options over the threshold, or the best top_k where none is, as (-score, place, id) in order."""
    passed: list[list] = [[] for _ in range(len(units))]
    nearest: list[list] = [[] for _ in range(len(units))]
    # what an option must reach to matter: the worst of the top_k so far, or the threshold once it was reached
    bar = np.full(len(units), -np.inf if top_k else threshold)
    for number in tiles.promising(units):
        rows = np.flatnonzero(tiles.middle(units, number) + tiles.radii[number] + SLACK >= bar)
        if not len(rows):
            continue
        ids, place, tile = tiles.read(number)
        scores = _scores(units[rows], tile)
        for k, j in zip(*np.nonzero(scores >= threshold), strict=True):
            passed[rows[k]].append((-scores[k, j], place[j], ids[j]))
        size = min(top_k, len(ids))
        for k, i in enumerate(rows.tolist()):
            if passed[i]:
                bar[i] = threshold
            elif size:
                cut = np.partition(scores[k], len(ids) - size)[len(ids) - size]
                nearest[i] = sorted(nearest[i] + [(-scores[k, j], place[j], ids[j]) for j in np.flatnonzero(scores[k] >= cut)])[:top_k]
                if len(nearest[i]) == top_k:
                    bar[i] = min(-nearest[i][-1][0], threshold)
    return [sorted(p) if p else q for p, q in zip(passed, nearest, strict=True)]


def score_targets(
    utterances: DataFrame, options: DataFrame, key: str, targets: Column,
    vector: str = "embedding", option: str = "option_id", option_vector: str = "centroid",
    order: str = "option_ord", tile_bytes: int = TILE_BYTES, keep: Sequence[str] = (),
) -> DataFrame:
    """Per utterance: target score, sum and hits, rank, top, runner-up, best non-target; `keep` names columns to carry."""
    carried = [key, *keep]
    left = utterances.select(*carried, F.col(vector).alias("_vec"), targets.cast("array<string>").alias("_targets"))
    tiles = write_tiles(options, option, option_vector, order, tile_bytes)
    types = ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches):
        for step in _steps(batches, "_vec") if tiles.files else ():
            answers = target_answers(_unit_rows(step["_vec"]), [set(t) for t in step["_targets"]], tiles)
            yield pd.concat([step[carried], answers], axis=1)

    return left.mapInPandas(run, f"{types}, {_ANSWER}")


def keep_or_top_k(
    utterances: DataFrame, options: DataFrame, key: str,
    threshold: float = SEMANTIC_THRESHOLD, top_k: int = SEMANTIC_TOP_K,
    vector: str = "embedding", option: str = "option_id", option_vector: str = "centroid",
    order: str = "option_ord", tile_bytes: int = TILE_BYTES, keep: Sequence[str] = (),
) -> DataFrame:
    """Options with similarity >= threshold, or the best top_k where none reaches it.

    Returns key, kept columns, option_id, similarity, similarity_rank (1-based, ties in option order).
    """
    carried = [key, *keep]
    left = utterances.select(*carried, F.col(vector).alias("_vec"))
    tiles = write_tiles(options, option, option_vector, order, tile_bytes)
    types = ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches):
        for step in _steps(batches, "_vec") if tiles.files else ():
            picked = kept_options(_unit_rows(step["_vec"]), threshold, top_k, tiles)
            lengths = [len(p) for p in picked]
            flat = [x for p in picked for x in p]
            if flat:
                rows = step[carried].iloc[np.repeat(np.arange(len(step)), lengths)].reset_index(drop=True)
                yield pd.concat([rows, pd.DataFrame({
                    "option_id": [x[2] for x in flat], "similarity": [-x[0] for x in flat],
                    "similarity_rank": [r + 1 for n in lengths for r in range(n)]})], axis=1)

    return left.mapInPandas(run, f"{types}, option_id string, similarity double, similarity_rank int")


def purity_gate(scored: DataFrame, target: Column, min_score: float = PURITY_MIN_SCORE,
                margin: float = PURITY_MARGIN) -> DataFrame:
    gap = F.col("top_score") - F.col("runner_up")
    reason = (
        F.when(F.col("top_option") != target, "target_not_top_match")
        .when(F.col("top_score") < min_score, "score_below_threshold")
        .when(gap < margin, "insufficient_margin")
        .otherwise("accepted")
    )
    return scored.withColumns({"margin": gap, "reason": reason, "accepted": reason == "accepted"})


def coverage_separation(scored: DataFrame, coverage_flag: float, separation_flag: float) -> DataFrame:
    coverage = F.col("target_sum") / F.greatest(F.col("target_hits"), F.lit(1))
    separation = F.coalesce("target_score", F.lit(0.0)) - F.col("best_non_target")
    return scored.withColumns({
        "coverage": coverage, "separation": separation,
        "flag_low_coverage": coverage < coverage_flag,
        "flag_low_separation": separation < separation_flag,
    })
