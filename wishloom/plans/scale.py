"""Plan building blocks that stay safe when one key holds most of the rows.

`settle` cuts lineage with a reliable checkpoint so a derived lookup table
is computed once. `lookup_join` leaves the join to adaptive execution. `running` and
`exact_percentiles` replace one-task windows and one-task value maps.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


PARTS = 4096


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; make a local one only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="wishloom-ckpt-"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """Rows written once as Parquet to the shared scratch folder and read from there.

    Unlike a checkpoint the files are compressed, a reader takes only its
    columns, and the optimizer knows their size, so a small table is broadcast
    without a shuffle of the other side. The order and the partitions of df are not kept.

    Spark keeps the shuffle files of a finished plan until the driver's garbage
    collector meets it, so what earlier steps left is collected before more is written.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    spark.sparkContext._jvm.System.gc()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unnest(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Fields of a computed array of structs, one row per element.

    A plain explode of a column makes the optimizer infer a size filter and
    push it below every projection, which computes the array a second time
    with nothing shared. The outer form infers none.
    """
    return df.select(*keep, F.explode_outer(column).alias("_u")).where("_u is not null").select(*keep, "_u.*")


def lookup_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join rows to a reference table and leave the strategy to the optimizer.

    Adaptive execution broadcasts the table if its measured bytes allow, and
    splits a key that owns a large share of the rows. Joins that would keep
    unmatched rows of the table are refused, because those cannot be split.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join keeps rows of the big side only, not {how}")
    return big.join(small, [on] if isinstance(on, str) else list(on), how)


def _placed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in ranges of `order`, sorted inside, read and written once; `_id` holds the range and the place in it.

    Spark samples the bounds of the ranges, so a value that owns most rows of
    the first columns is cut by the later ones.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(ranged.withColumn("_id", F.monotonically_increasing_id()))


def _carried(placed: DataFrame, spark: SparkSession) -> DataFrame:
    """Rows before each range: one row per range, a prefix sum over their counts."""
    part = F.shiftright("_id", 33).alias("_range")
    before, total = [], 0
    for number, count in sorted((r["_range"], r["n"]) for r in placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()):
        before.append((number, total))
        total += count
    return spark.createDataFrame(before, "_range bigint, _before bigint")


def global_position(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Adds the place of every row in `order`, from 0, within the group that `by` names.

    Without a window: the place is that in the row's range plus the rows of
    earlier ranges, less the place of the group's first row. One range holds a
    share of the rows whatever the groups are, so a group of all rows is as
    good as many, and the input is read once. Equal rows get places in any order.
    """
    by, spark = list(by), df.sparkSession
    placed = _placed(df, [*by, *order])
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = lookup_join(placed.withColumn("_range", F.shiftright("_id", 33)), _carried(placed, spark), "_range").withColumn(
        name, F.col("_before") + inside)
    if by:
        first = numbered.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.min(name).alias("_first"))
        same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
        numbered = numbered.join(first, same).withColumn(name, F.col(name) - F.col("_first"))
    return numbered.select(*df.columns, name)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
) -> DataFrame:
    """Running sums and last-non-null values without one task per key.

    Rows are windowed inside (keys, range of the order), ranges being
    sampled as in `global_position`. The windowed rows are settled, and the
    last of each range gives the totals that later ranges of a key carry, so the
    input is read once and only one row per key and range reaches the second window.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    keys = list(keys)
    ranged = df.withColumns({f"_v_{n}": c for n, c in (sums | lasts).items()}).repartitionByRange(*keys, *order).withColumn(
        "_range", F.spark_partition_id()).withColumn("_tie", F.monotonically_increasing_id())
    inside = Window.partitionBy(*keys, "_range").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    local = settle(ranged.withColumns(
        {f"_s_{n}": F.sum(f"_v_{n}").over(inside) for n in sums} | {f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in lasts}))
    names = [*[f"_s_{n}" for n in sums], *[f"_l_{n}" for n in lasts]]
    totals = local.groupBy(*keys, "_range").agg(F.max_by(F.struct(*names), F.struct(*order, "_tie")).alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_k_range"),
        *[F.sum(f"_t._s_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_t._l_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_range") == F.col("_k_range")]
    out = local.join(carry, same).withColumns(
        {n: F.coalesce(F.col(f"_s_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums}
        | {n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in lasts})
    return out.select(*[c for c in df.columns if c not in sums and c not in lasts], *sums, *lasts)


def value_bucket(value: Column) -> Column:
    """Monotone coarse bucket of a number: 256 per power of two."""
    return F.signum(value) * F.floor(F.log2(F.abs(value) + 1.0) * 256)


def exact_percentiles(
    df: DataFrame,
    value: str,
    points: dict[str, float | Callable[[Column], Column]],
    by: Sequence[str] = (),
    weight: str | None = None,
    positions: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Exact linearly interpolated percentiles per group, distributed.

    The built-in `percentile` keeps every distinct value of a group in one
    task. Here values are counted first and counts are summed per coarse bucket;
    a bucket that holds a wanted rank is cut into PARTS, and only the part with
    the rank is ordered, so values within a percent of each other spread too. A point is a
    fraction or a function of the group size. `weight` names a column of
    counts for values that are already counted. Returns by + n + points.
    """
    by = list(by)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
        .withColumn("_b", value_bucket(F.col("_v")))
    )
    group = Window.partitionBy(*by)
    buckets = counted.groupBy(*by, "_b").agg(F.sum("_c").alias("_t"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).select(
        *by, "_b", "_t", "_lo", "_hi",
        F.sum("_t").over(group).alias("_n"),
        F.coalesce(
            F.sum("_t").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    n = F.col("_n")
    asked = [F.struct(F.lit(name).alias("p"), at(n).alias("r"), F.lit(1.0).alias("w")) for name, at in (positions or {}).items()]
    for name, q in points.items():
        fraction = q(n) if callable(q) else F.lit(float(q))
        position = fraction * (n - 1)
        weight = position - F.floor(position)
        asked.append(F.struct(F.lit(name).alias("p"), F.floor(position).alias("r"), (1 - weight).alias("w")))
        asked.append(F.struct(F.lit(name).alias("p"), F.ceil(position).alias("r"), weight.alias("w")))
    wanted = (
        buckets.withColumn("_a", F.explode(F.array(*asked)))
        .where((F.col("_a.r") >= F.col("_before")) & (F.col("_a.r") < F.col("_before") + F.col("_t")))
        .groupBy(*by, "_b", "_n", "_before", "_lo", "_hi", F.col("_a.r").alias("_r"))
        .agg(F.collect_list(F.struct("_a.p", "_a.w")).alias("_uses"))
    )
    # the bucket of a rank is cut into equal parts between its least and largest value
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    parts = counted.join(wanted, by + ["_b"]).withColumn("_part", F.least(F.floor(share * PARTS), F.lit(PARTS - 1)))
    ahead = Window.partitionBy(*by, "_r").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    chosen = parts.groupBy(*by, "_r", "_before", "_part").agg(F.sum("_c").alias("_t")).withColumn(
        "_end", F.col("_before") + F.sum("_t").over(ahead)).where(
        (F.col("_r") < F.col("_end")) & (F.col("_r") >= F.col("_end") - F.col("_t"))).select(
        *by, "_r", "_part", (F.col("_end") - F.col("_t")).alias("_start"))
    inside = Window.partitionBy(*by, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        parts.join(chosen, by + ["_r", "_part"])
        .withColumn("_upto", F.col("_start") + F.sum("_c").over(inside))
        .where((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_c")))
        .select(*by, "_n", "_v", F.explode("_uses").alias("_u"))
    )
    return found.groupBy(*by).agg(
        F.max("_n").alias("n"),
        *[F.sum(F.when(F.col("_u.p") == name, F.col("_v") * F.col("_u.w"))).alias(name) for name in [*points, *(positions or {})]],
    )
