from collections import Counter

from pyspark.sql import functions as F

from wishloom.operators import imputation as im
from wishloom.operators import popularity as pop

ROWS = [(0, 7, 0, 2, 0, 0, "2026-02-01", "2026-02-01", "BRU", ["Spain", "Peru"]), (1, 7, None, 1, 1, 0, "2026-02-01", "2026-02-01", None, ["Spain"]),
        (2, 9, None, 2, 0, 0, "2026-03-01", None, "AMS", ["Peru", "Spain", "Peru"]), (3, None, 2, 2, 0, 0, "2026-04-01", "2026-04-02", "AMS", [])]
SCHEMA = ("ord long, duration int, rooms int, adults int, children int, infants int, start_date string, end_date string, "
          "airport string, destinations array<string>")


def test_global_ties_by_first_occurrence(spark):
    g = pop.global_statistics(spark.createDataFrame(ROWS, SCHEMA))
    top = {(r["metric"], r["rank"]): r for r in g.collect()}
    assert (top["duration", 1]["value"], top["duration", 1]["count"], top["duration", 1]["total"]) == ("7", 2, 3)
    assert top["rooms", 1]["value"] is None and top["rooms", 1]["unique_values"] == 3
    assert top["departure_airport", 1]["value"] == "AMS"
    assert top["destination", 1]["value"] == "Spain" and top["destination", 1]["count"] == 3
    assert top["party", 1]["value"] == "2/0/0"
    t = pop.totals(spark.createDataFrame(ROWS, SCHEMA)).first()
    assert (t["rows"], t["destination_mentions"]) == (4, 5)


def test_summaries_equal_counter(spark):
    values = [(i, i % 3, (i * i) % 7) for i in range(500)]
    df = spark.createDataFrame(values, "o long, k long, v long")
    got = {}
    for r in pop.summarize(pop.value_counts(df, ["k"], "v", F.col("o")), ["k"]).orderBy("k", "rank").collect():
        got.setdefault(r["k"], []).append((r["value"], r["count"]))
    for k in range(3):
        assert got[k] == Counter(v for _o, kk, v in values if kk == k).most_common(5)


def test_intersections_and_imputation(spark):
    stats = pop.statistics_table(spark.createDataFrame(ROWS, SCHEMA))
    assert [r["scope_key"] for r in stats.where("scope = 'intersection'").collect()] == ["Peru||Spain"]
    req = spark.createDataFrame(
        [(1, [], [], [], None, None, None, None), (2, ["spain:COUNTRY", "PERU"], ["X"], [], "2010", 1, 0, 3), (3, ["Mars"], [], [], " ", None, None, 0)],
        "request_id long, to array<string>, from array<string>, departure array<string>, duration_id string, adults int, non_adults int, rooms int")
    got = {r["request_id"]: r for r in im.impute(req, stats, auto_rooms=False).collect()}
    assert got[1]["unpopulated"] and got[1]["to"] == ["Spain"] and got[1]["to_source"] == "popularity"
    assert got[1]["departure"] == ["2026-02-01"] and got[1]["departure_source"] == "destination:Spain"
    assert got[2]["departure_source"] == "intersection:Peru||Spain" and got[2]["duration_id"] == "2010" and got[2]["rooms"] == 3
    assert list(got[3]["missing"]) == ["Mars"] and got[3]["duration_source"] == "global" and got[3]["rooms_source"] == "configuration"
    assert im.duration_ids()[14] == "2099"


def test_most_popular_without_global_mode(spark):
    stats = pop.statistics_table(spark.createDataFrame(ROWS, SCHEMA)).where("metric <> 'destination'")
    assert pop.most_popular_destination(stats).first()["destination"] == "Spain"


def test_merged_names_take_one_pass(spark):
    from wishloom.operators import imputation as im

    places = "id string, name string, type string, available boolean"
    airports = spark.createDataFrame([("nl", "Holland", "AIRPORT", True)], places)
    goals = spark.createDataFrame([("R1", "Asia", "country", True), ("R1", "East", "", True), ("R2", "asia ", "", True)], places)
    none = "array()"
    filled = spark.createDataFrame(
        [(1, [" asia", "Mars", "ASIA", ""], ["holland", "x", "X"], "2003"), (2, None, [], None), (2, ["East"], None, None), (None, ["Asia"], ["y"], None)],
        "request_id int, to array<string>, from array<string>, duration_id string").selectExpr(
        "*", "array('2026-01-02', 'soon') departure", "2 adults", "1 non_adults", "'1' rooms")
    own = spark.createDataFrame([(1,), (2,), (3,), (None,)], "request_id int").selectExpr(
        "request_id", f"cast({none} as array<string>) to_ids", f"cast({none} as array<string>) from_codes", f"cast({none} as array<string>) departure_dates",
        "'' duration_id", "cast(null as int) adults", "cast(null as int) non_adults", "cast(null as int) rooms")
    merged = im.merge_imputed(own, filled, airports, goals)
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
    got = [(r["request_id"], r["to_ids"], r["from_codes"], r["departure_dates"], r["duration_id"], r["rooms"]) for r in merged.collect()]
    day = ["2026-01-02"]
    assert sorted(got, key=str) == sorted([
        (1, ["R1", "R2", "Mars"], ["NL", "X"], day, "2003", 1), (2, ["R1"], None, day, None, 1), (2, ["R1"], None, day, None, 1),
        (3, None, None, None, None, None), (None, None, None, None, None, None)], key=str)
