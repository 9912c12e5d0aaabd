import pytest
from pyspark.sql import functions as F

from wishloom.functions import expected as xp
from wishloom.operators import datasets as ds
from wishloom.operators import replay as rp


def test_value_mismatches_literal(spark):
    df = spark.createDataFrame([(1, "From: Amsterdam | To: Spain | Duration: 7 nights")], "i long, raw string").withColumns({
        "expected": xp.parse_values(F.col("raw")), "actual": xp.parse_values(F.lit("From: Amsterdam | To: Italy | Duration: 10 nights"))})
    assert sorted(r["label"] for r in rp.value_mismatches(df, "actual", "expected").select(F.inline("mismatches")).collect()) == ["Duration", "To"]


def test_preference_replay(spark):
    rows = [(1, 'Filter: "Board"; Options: "Half Board"', "success"), (2, 'Filter: board; Options: half board, x', "success"),
            (3, "", "success"), (4, 'Filter: "Board"; Options: "Half Board"', None)]
    df = spark.createDataFrame(rows, "i int, raw string, status string").withColumn(
        "actual", F.array(F.struct(F.lit("BOARD").alias("filter_label"), F.array(F.lit("half BOARD")).alias("options"))))
    got = {r["i"]: (r["replay_status"], r["mismatch_count"]) for r in rp.replay(df, "actual", "raw", preferences=True).collect()}
    assert got == {1: ("success", 0), 2: ("failed", 1), 3: ("success", 0), 4: ("error", 0)}


def test_sanitise(spark):
    raw = ["Pool", " pool ", None, "", "KLM hub", "AI", "sea", "late"]
    df = spark.createDataFrame([("CARRIER", raw), ("other", raw)], "f string, s array<string>")
    a, b = [r[0] for r in df.select(ds.sanitise_synonyms(F.col("f"), F.col("s"), 3)).collect()]
    assert (a["kept"], a["empties"], a["codes"], a["duplicates"]) == (["pool", "ai", "sea"], 2, 1, 1)
    assert b["kept"] == ["pool", "klm hub", "ai"]
    note = df.select(ds.sanitise_note(ds.sanitise_synonyms(F.col("f"), F.col("s"), 3))).first()[0]
    assert note == "removed=4 (duplicates=1, codes=1, empties=2)"


@pytest.mark.parametrize("same", [False, True])
def test_combinations(spark, same):
    options = spark.createDataFrame([(f"o{i}", f"f{i % 4}") for i in range(30)], "option_id string, filter_id string")
    filters = {r[0]: r[1] for r in options.collect()}
    got = ds.option_combinations(options, 60, allow_same_filter=same, single_option_filters=["f1"]).collect()
    assert len({r["combo_key"] for r in got}) == len(got)
    sizes = [r["size"] for r in got]
    assert (sizes.count(2), sizes.count(3), sizes.count(4)) == (30, 18, 12)
    for r in got:
        used = [filters[o] for o in r["option_ids"]]
        assert len(set(r["option_ids"])) == r["size"]
        assert used.count("f1") <= 1
        assert same or len(set(used)) == len(used)


@pytest.mark.parametrize("n,total,filters", [(30, 2000, 30), (6, 40, 6)])
def test_combinations_are_complete(spark, n, total, filters):
    options = spark.createDataFrame([(f"o{i}", f"f{i % filters}") for i in range(n)], "option_id string, filter_id string")
    got = ds.option_combinations(options, total).collect()
    assert len(got) == len({r["combo_key"] for r in got}) == total


def test_combinations_that_cannot_exist(spark):
    options = spark.createDataFrame([(f"o{i}", f"f{i % 2}") for i in range(20)], "option_id string, filter_id string")
    assert ds.option_combinations(options, 100).count() == 100  # only pairs exist, and there are 100


def test_capped_batches_are_greedy(spark):
    items = [(i, "ab"[i % 2] if i % 7 else None, [f"o{i % 5}", f"o{(i * 7) % 11}"]) for i in range(200)] + [(200, "a", [])]
    rows = spark.createDataFrame(items, "ord long, grp string, ids array<string>")
    want, state = {}, {}
    for o, g, ids in items:
        if ids:
            held, number = state.get(g, (set(), 0))
            if held and len(held | set(ids)) > 4:
                held, number = set(), number + 1
            state[g] = (held | set(ids), number)
            want[o] = number
    for parts in (1, 9):
        out = ds.batches_by_distinct_options(rows.repartition(parts), "ord", "ids", 4, ["grp"]).collect()
        assert {r["ord"]: r["batch"] for r in out} == want


def test_samples(spark):
    df = spark.range(50)
    assert ds.sample_rows(df, 0, 1, "id").count() == 0
    assert ds.sample_rows(df, 99, 1, "id").count() == 50
    assert ds.sample_rows(df, 7, 1, "id").collect() == ds.sample_rows(df.repartition(7), 7, 1, "id").collect()


def test_batch_numbers(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    got = ds.batches(df, "id", 4, ["k"])
    for k in range(3):
        assert [r["batch"] for r in got.where(F.col("k") == k).orderBy("id").collect()] == [i // 4 for i in range(got.where(F.col("k") == k).count())]
