"""Sharding by a k-d tree over document metadata.

The table is cut into parts of nearly equal bytes: `shards` of them, or as many
as it takes for leaves to hold `target_bytes` at most on average. A node with m
leaves takes the dimension in which its documents spread widest and cuts it at
the weighted median (for uneven m at the matching quantile), until a node is one
shard. All nodes of a level are cut together.

A median is found by distributed refinement: bytes are summed per node and bin
(`BINS` bins at most), the driver picks the bin that holds the quantile, and only
that bin is looked at more finely, until it weighs less than `tolerance` of a
shard. The driver sees sums of bins, never rows.

The order in a dimension is (value, hash of the text, hash of the row). So equal
texts are neighbours and stay in one shard, except a group that weighs more than
the tolerance and straddles a cut: it is split there. A group that holds a third
of all rows thus spreads over as many shards as its bytes need.

Only a narrow table (id, size, checksum, dimensions) is written and read again;
texts are read once and not shuffled. Slots count rows inside small blocks of
a shard and add the sizes of the blocks before.

Defined cases: a null text has size 8 and counts as its own text, apart from the
empty one; null dimension values count as the least; null ids are ids; repeated
rows are rows of their own, each with its own slot; an empty table stays empty;
fewer rows than shards, or a document
heavier than a shard, leave shards empty; other columns pass through, a column
named like the result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wishloom.plans.scale import scratch_folder, settle

BINS = 4096
STEPS = (1 << 20) - 1  # values of a dimension after scaling; with 43 bits of text hash they make a 63-bit key
BLOCK_ROWS = 50_000
LAST = (1 << 62) - 1  # ties have 62 bits


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def _small(rows: DataFrame, data: list[tuple], schema: str) -> DataFrame:
    """A table with a row per tree node; never more rows than shards."""
    names = [field.split(" ") for field in schema.split(", ")]
    values = ", ".join("(" + ", ".join(f"CAST({v} AS {kind})" for v, (_, kind) in zip(row, names, strict=True)) + ")" for row in data)
    return F.broadcast(rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(n for n, _ in names)})"))


def _descend(rows: DataFrame, cuts: dict[int, tuple]) -> DataFrame:
    """Rows one level further down: `node` becomes the child they are in."""
    table = _small(rows, [(n, *c) for n, c in cuts.items()], "node int, _dim int, _key long, _tie long")
    key = F.get("k", F.col("_dim"))
    right = (key > F.col("_key")) | ((key == F.col("_key")) & (F.col("tie") > F.col("_tie")))
    return rows.join(table, "node", "left").withColumn("node", F.when(F.col("_dim").isNull(), F.col("node")).otherwise(
        2 * F.col("node") + F.when(right, 2).otherwise(1)).cast("int")).drop("_dim", "_key", "_tie")


def _histogram(rows: DataFrame, column: str, ranges: dict[int, tuple[int, int]]) -> dict[int, list[tuple[int, int, int]]]:
    """Per node the bins (low, high, bytes) of its range, in order, without empty ones."""
    if not ranges:
        return {}
    step = {n: max(1, -(-(hi - lo + 1) // BINS)) for n, (lo, hi) in ranges.items()}
    table = _small(rows, [(n, lo, hi, step[n]) for n, (lo, hi) in ranges.items()], "node int, _low long, _high long, _step long")
    ranged = rows.join(table, "node").where(F.col(column).between(F.col("_low"), F.col("_high")))
    sums = ranged.groupBy("node", F.expr(f"({column} - _low) div _step").alias("bin")).agg(F.sum("size").alias("bytes")).collect()
    out: dict = {n: [] for n in ranges}
    for r in sorted(sums, key=lambda r: (r["node"], r["bin"])):
        lo, hi = ranges[r["node"]]
        first = lo + r["bin"] * step[r["node"]]
        out[r["node"]].append((first, min(hi, first + step[r["node"]] - 1), r["bytes"]))
    return out


def _cut(rows: DataFrame, column: str, open_nodes: dict[int, list], small: float) -> dict[int, tuple[int, int, int, int]]:
    """Narrow every node's quantile down: {node: (low, high, bytes before, bytes inside)} of the bin that holds it.

    open_nodes: node -> [low, high, bytes before, bytes wanted on the left].
    """
    done: dict = {}
    asked = {n: tuple(v) for n, v in open_nodes.items()}
    while asked:
        found = _histogram(rows, column, {n: (v[0], v[1]) for n, v in asked.items()})
        following = {}
        for n, (lo, hi, before, wanted) in asked.items():
            inside = (lo, hi, before, 0)
            for first, last, weight in found[n]:
                inside = (first, last, before, weight)
                if before + weight >= wanted:
                    break
                before += weight
            if inside[0] == inside[1] or inside[3] <= small:
                done[n] = inside
            else:
                following[n] = (inside[0], inside[1], inside[2], wanted)
        asked = following
    return done


def _grow(compact: DataFrame, dims: int, shards: int, tolerance: float) -> tuple[list[dict], dict]:
    """Cuts (dimension, key, tie) of every level, and the first shard of every leaf."""
    levels: list[dict] = []
    leaves = {0: (0, shards)}  # node -> first shard, number of shards
    placed = compact
    while wide := {n: v for n, v in leaves.items() if v[1] > 1}:
        stats = {r["node"]: r for r in placed.groupBy("node").agg(
            F.sum("size").alias("bytes"),
            *[F.min(F.get("k", F.lit(d))).alias(f"lo{d}") for d in range(dims)],
            *[F.max(F.get("k", F.lit(d))).alias(f"hi{d}") for d in range(dims)]).collect() if r["node"] in wide}
        widest = {n: max(range(dims), key=lambda d, r=r: ((r[f"hi{d}"] >> 43) - (r[f"lo{d}"] >> 43), -d)) for n, r in stats.items()}
        if not stats:
            break
        rows = placed.join(_small(placed, list(widest.items()), "node int, _dim int"), "node").select(
            "node", "size", "tie", F.get("k", F.col("_dim")).alias("key"))
        small = tolerance * sum(r["bytes"] for r in stats.values()) / max(1, sum(wide[n][1] for n in stats))
        asked = {n: [r[f"lo{widest[n]}"], r[f"hi{widest[n]}"], 0, r["bytes"] * (wide[n][1] // 2) / wide[n][1]] for n, r in stats.items()}
        ends, split = {n: (0, LAST) for n in wide}, {}
        found = _cut(rows, "key", asked, small)
        for n, (lo, hi, before, weight) in found.items():
            if weight <= small:  # the nearer edge of a light bin
                ends[n] = (hi if before + weight - asked[n][3] <= asked[n][3] - before else lo - 1, LAST)
            else:  # one heavy group of equal texts: cut inside
                split[n] = [0, LAST, before, asked[n][3]]
        if split:
            group = rows.join(_small(rows, [(n, found[n][0]) for n in split], "node int, _group long"), "node").where("key = _group")
            for n, (lo, hi, before, weight) in _cut(group, "tie", split, small).items():
                ends[n] = (found[n][0], lo - 1 if before + weight - asked[n][3] > asked[n][3] - before else hi)
        for n, (first, m) in wide.items():
            del leaves[n]
            leaves[2 * n + 1], leaves[2 * n + 2] = (first, m // 2), (first + m // 2, m - m // 2)
        levels.append({n: (widest.get(n, 0), *ends[n]) for n in wide})
        placed = settle(_descend(placed, levels[-1]))
    return levels, {n: first for n, (first, _) in leaves.items()}


def assign(documents: DataFrame, dims: dict[str, Column], shards: int = 24, key: str = "doc_id", text: str = "text",
           keep: list[str] | None = None, tolerance: float = 0.005, target_bytes: int | None = None) -> DataFrame:
    """Kept columns with size, text_crc32, shard and slot. dims: name -> numeric column.

    With target_bytes, nodes are split until leaves reach it, and `shards` is not read.
    """
    spark = documents.sparkSession
    new = ("size", "text_crc32", "shard", "slot")
    kept = [c for c in (documents.columns if keep is None else keep) if c not in new]
    content = F.col(f"`{text}`")
    folder = scratch_folder(spark, "kd")
    documents.select(
        F.struct(*[f"`{c}`" for c in kept]).alias("row"), text_size(content).alias("size"),
        F.crc32(F.coalesce(content, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(content, content.isNull()).alias("h"), F.lit(0).alias("node"),
        F.shiftrightunsigned(F.xxhash64(F.col(f"`{key}`"), F.monotonically_increasing_id()), 2).alias("tie"),
        *[v.cast("double").alias(f"d{i}") for i, v in enumerate(dims.values())]).write.parquet(folder)
    table = spark.read.parquet(folder)
    bounds = table.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), *[F.min(f"d{i}").alias(f"a{i}") for i in range(len(dims))],
                       *[F.max(f"d{i}").alias(f"b{i}") for i in range(len(dims))]).first()
    if target_bytes is not None:
        shards = max(1, -(-(bounds["bytes"] or 0) // target_bytes))
    keys = []
    for i in range(len(dims)):
        a, b = bounds[f"a{i}"] or 0.0, bounds[f"b{i}"] or 0.0
        part = F.coalesce((F.col(f"d{i}") - a) * (STEPS / (b - a) if b > a else 0.0), F.lit(0.0)).cast("long")
        keys.append(F.shiftleft(part, 43).bitwiseOR(F.shiftrightunsigned("h", 21)))
    compact = table.withColumn("k", F.array(*keys))
    levels, first = _grow(compact.select("node", "size", "tie", "k"), len(dims), shards, tolerance)
    blocks = max(1, -(-bounds["n"] // (shards * BLOCK_ROWS)))
    for cuts in levels:
        compact = _descend(compact, cuts)
    placed = compact.join(_small(table, list(first.items()), "node int, shard int"), "node").withColumn(
        "block", F.pmod("tie", F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("tie", "h"))
    return placed.withColumn("place", inside).join(offsets, ["shard", "block"]).select(
        "row.*", "size", "text_crc32", "shard", (F.col("offset") + F.col("place") - 1).alias("slot"))


def metadata(text: Column) -> dict[str, Column]:
    """Dimensions that depend on the text alone, so that equal texts lie at one point."""
    size, chars = F.coalesce(F.octet_length(text), F.lit(0)), F.coalesce(F.length(text), F.lit(0))
    return {
        "log_bytes": F.log1p(size),
        "beyond_ascii": (size - chars) / F.greatest(size, F.lit(1)),
        "log_lines": F.log1p(F.coalesce(F.length(text) - F.length(F.translate(text, "\n", "")), F.lit(0))),
        "word_length": F.log1p(chars / (F.coalesce(F.length(text) - F.length(F.translate(text, " ", "")), F.lit(0)) + 1)),
    }
