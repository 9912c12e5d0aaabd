import numpy as np
import pytest
from pyspark.sql import functions as F

from wishloom.plans import scale


def test_lookup_join_keeps_the_big_side(spark):
    big = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"))
    small = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "k long, v string")
    known = big.where("k < 5").count()
    rows = {how: scale.lookup_join(big, small, "k", how).count() for how in ("inner", "left", "left_semi", "left_anti")}
    assert rows == {"inner": known, "left": 5000, "left_semi": known, "left_anti": 5000 - known}
    with pytest.raises(ValueError):
        scale.lookup_join(big, small, "k", "full")


def test_running_equals_plain_window(spark):
    rows = [(k, i, (i * 37) % 11 - 4 if i % 3 else None) for k, n in (("a", 600), ("b", 60), (None, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    got = scale.running(df, ["k"], ["i"], {"s": F.col("v")}, {"l": F.col("v")})
    assert got.columns == ["k", "i", "v", "s", "l"]
    state = {}
    want = {}
    for k, i, v in rows:
        total, last = state.get(k, (0, None))
        state[k] = (total + (v or 0), last if v is None else v)
        want[k, i] = state[k]
    assert {(r["k"], r["i"]): (r["s"], r["l"]) for r in got.collect()} == want


def test_running_sums_with_equal_order(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("at"), F.when(F.col("id") % 2 == 0, 5).otherwise(-3).alias("v"))
    got = scale.running(df, [], ["at"], {"n": F.lit(1), "s": F.col("v")}).collect()
    assert sorted(r.n for r in got) == list(range(1, 3001)) and {r.s for r in got if r.n == 3000} == {3000}


@pytest.mark.parametrize("groups", [1, 7])
def test_global_position(spark, groups):
    rows = [((i * 7919) % 5003, f"g{i % groups}" if i % 11 else None) for i in range(5000)]
    df = spark.createDataFrame(rows, "v long, g string").repartition(6)
    want = {}
    for v, g in sorted(rows, key=lambda r: (str(r[1]), r[0])):
        want[g, v] = sum(1 for k in want if k[0] == g)
    assert {(r.g, r.v): r.position for r in scale.global_position(df, ["v"], ["g"]).collect()} == want
    everywhere = scale.global_position(df.drop("g"), ["v"], name="at")
    assert [r["at"] for r in everywhere.orderBy("v").collect()] == list(range(5000))
    plan = everywhere._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert scale.global_position(df.limit(0), ["v"], ["g"]).collect() == []


def test_equal_rows_get_places_of_their_own(spark):
    df = spark.createDataFrame([(1,)] * 2000 + [(0,)] * 5, "v int").repartition(4)
    got = scale.global_position(df, ["v"]).collect()
    assert sorted(r.position for r in got) == list(range(2005)) and {r.position for r in got if r.v == 0} == set(range(5))


def test_percentiles_of_values_within_a_percent(spark):
    values = 1000 + np.arange(40_000) / 5000.0
    df = spark.range(40_000).select((1000 + F.col("id") / 5000.0).alias("v"))
    got = scale.exact_percentiles(df, "v", {"a": 0.5, "b": 0.95}).first()
    assert (got["a"], got["b"]) == (pytest.approx(np.quantile(values, 0.5)), pytest.approx(np.quantile(values, 0.95)))


def test_exact_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {"normal": rng.normal(0, 50, 999), "ties": rng.integers(0, 4, 500) * 1.0, "one": np.array([7.5]),
              "hot": np.concatenate([np.full(3000, 12.25), rng.exponential(900, 50)])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    qs = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}
    for r in scale.exact_percentiles(df, "v", qs, ["g"]).collect():
        assert r["n"] == len(groups[r["g"]])
        for name, q in qs.items():
            assert r[name] == pytest.approx(np.quantile(groups[r["g"]], q), abs=1e-9)


def test_stored_keeps_rows_and_leaves_nothing_wide(spark):
    import datetime as dt

    schema = "k long, `a b` array<struct<id:string,at:timestamp>>, m map<string,string>, s struct<x:int,y:array<string>>, d date, t string"
    old = dt.datetime(200, 3, 1, 12)
    rows = [(1, [("x", old), (None, None)], {"a": None}, (1, ["é", None]), dt.date(1200, 2, 28), ""), (None, None, None, None, None, None), (1, [], {}, (None, []), dt.date(9999, 12, 31), "z"),
            (1, [], {}, (None, []), dt.date(9999, 12, 31), "z")]
    df = spark.createDataFrame(rows, schema).repartition(3)
    kept = scale.stored(df)
    assert kept.schema == df.schema and sorted(map(repr, kept.collect())) == sorted(map(repr, df.collect()))
    assert scale.stored(df.where("false")).schema == df.schema and scale.stored(df.where("false")).count() == 0
    # the optimizer knows how small it is, so the other side is not shuffled
    big = spark.range(1000).selectExpr("id", "id % 3 as k")
    plan = big.join(scale.stored(spark.range(3).toDF("k").groupBy("k").count()), "k", "left")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "ExistingRDD" not in plan
