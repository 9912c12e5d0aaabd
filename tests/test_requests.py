import datetime as dt
import random

from pyspark.sql import functions as F

from wishloom.functions import messages as ms
from wishloom.operators import catalogue as ct
from wishloom.operators import cascade as cs
from wishloom.operators import extraction as ex
from wishloom.operators import normalisation as nm


def days(spark, *iso):
    return spark.createDataFrame([(dt.date.fromisoformat(d),) for d in iso], "d date")


def test_departure_window_literals(spark):
    start = dt.date(2025, 10, 9)
    cal = days(spark, *[(start + dt.timedelta(n)).isoformat() for n in range(387)])
    df = spark.createDataFrame([(1, dt.date(2025, 10, 12), "3"), (2, dt.date(2024, 1, 1), "3"), (3, None, "3"), (4, dt.date(2025, 10, 12), "0")],
                               "request_id long, base_date date, flex_id string")
    got = {r["request_id"]: r["departure_dates"] for r in nm.departure_window(df, cal).collect()}
    assert got == {1: ["2025-10-09", "2025-10-15"], 2: [], 3: [], 4: ["2025-10-12"]}


def test_departure_window_brute_force(spark):
    rng = random.Random(8)
    zero = dt.date(2026, 1, 1)
    opened = sorted(rng.sample(range(0, 200), 25))
    cal = days(spark, *[(zero + dt.timedelta(n)).isoformat() for n in opened])
    rows = [(i, zero + dt.timedelta(rng.randint(-40, 240)), str(rng.choice([0, 1, 3, 7, 14, 100]))) for i in range(400)]
    df = spark.createDataFrame(rows, "request_id long, base_date date, flex_id string")
    got = {r["request_id"]: r["departure_dates"] for r in nm.departure_window(df, cal).collect()}
    for i, base, flex in rows:
        offset = (base - zero).days
        inside = [n for n in opened if abs(n - offset) <= int(flex)]
        want = [(zero + dt.timedelta(n)).isoformat() for n in ([inside[0], inside[-1]] if inside else [])]
        assert got[i] == list(dict.fromkeys(want))


def test_off_calendar(spark):
    cal = days(spark, "2026-01-01", "2026-01-03")
    df = spark.createDataFrame([(1, ["2026-01-01", "2026-01-02"]), (2, ["2026-01-03"]), (3, [])], "request_id long, departure_dates array<string>")
    want = {1: "2026-01-02", 2: None, 3: None}
    assert {r[0]: r["off_calendar"] for r in nm.first_off_calendar(df, cal).collect()} == want
    long = spark.sql("SELECT explode(sequence(date'1990-01-01', date'2030-01-01')) AS d")
    assert {r[0]: r["off_calendar"] for r in nm.first_off_calendar(df, long).collect()} == {1: None, 2: None, 3: None}


def test_entities_respect_word_boundaries_aliases_and_languages(spark):
    base = spark.createDataFrame([("A1", "Spa", 0), ("A2", "Spain", 1), ("A3", "Nieuw-Zeeland", 2)], "id string, name string, ord long")
    aliases = spark.createDataFrame([("nl", "spanje", "A2", 10), ("nl", "spa", "A3", 11)], "lang string, alias string, target_id string, ord long")
    lookup = ct.lookup_table(base, aliases, ["en", "nl"])
    req = spark.createDataFrame([(1, "en", "Spain, spanje"), (2, "nl", "Spanje and SPAIN"), (3, "xx", "a spa-day in nieuw-zeeland"), (4, "nl", "spa"),
                                 (5, "en", "nieuw zeeland")], "request_id long, lang string, text string")
    got = {}
    for r in ex.match_entities(req, lookup, languages=["en", "nl"]).orderBy("request_id", "ord").collect():
        got.setdefault(r["request_id"], []).append(r["id"])
    assert got == {1: ["A2"], 2: ["A2"], 3: ["A1", "A3"], 4: ["A3"]}


def test_duration_substring_and_dates(spark):
    df = spark.createDataFrame([("17 nights",), ("a week",), ("nothing",)], "t string")
    assert [r[0] for r in df.select(ex.duration_id(F.col("t"))).collect()] == ["2007", "2007", None]
    d = spark.createDataFrame([("on 2026-02-03 or 04-05-2026, March 7, 2026 and 8 apr 2026 not 2026-13-45 or 12",)], "t string").select(ex.dates(F.col("t"))).first()[0]
    assert [x["at"].date().isoformat() for x in d] == ["2026-02-03", "2026-05-04", "2026-03-07", "2026-04-08"]


def test_messages(spark):
    df = spark.createDataFrame([("Departure date is required",), ("Destination 'X' is unavailable",), ("odd",), ("",)], "m string")
    got = [(r[0], r[1]) for r in df.select(ms.choose_prompt(F.array("m"))["parameter"], F.array_join(ms.invalid_fields(F.array("m")), ",")).collect()]
    assert got == [("departureDate", ""), ("from", "to"), ("general", ""), (None, "")]


def test_cascade_runs_each_row_once_per_method(spark):
    calls = []

    def stage(name, ok):
        def evaluate(df):
            calls.append(name)
            return df.withColumns({"status": F.when(ok, "success").otherwise("failed"), "detail": F.when(~ok, F.lit(name))})
        return name, "rules", evaluate

    req = spark.range(10).withColumnRenamed("id", "request_id")
    out = cs.run_cascade(req, [stage("a", F.col("request_id") < 3), stage("b", F.col("request_id") < 6)], stage("a", F.lit(True)))
    assert calls == ["a", "b"]
    got = {r["request_id"]: (r["status"], len(r["attempts"])) for r in out.collect()}
    assert len(got) == 10 and got[0] == ("success", 1) and got[4] == ("success", 2) and got[9] == ("failed", 2)


def test_no_bound_on_languages(spark):
    names = [f"l{i}" for i in range(260)]
    lookup = spark.createDataFrame([(n, f"place{n}", n, i) for i, n in enumerate(names)], "lang string, name string, id string, ord long")
    asked = spark.createDataFrame([(i, n, f"to place{n} please") for i, n in enumerate(names)], "request_id long, lang string, text string")
    assert ex.match_entities(asked, lookup).count() == 260


def test_whole_words_equal_a_pattern(spark):
    import re

    rng = random.Random(5)
    parts = ["spa", "new", "york", "st.", "o'hare", "(x", "é", "a1", "-", " ", " ", ",", "_"]
    names = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))).strip() for _ in range(60)} - {""})
    names = [n for n in names if re.match(r"\w", n)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    lookup = spark.createDataFrame([("en", n, f"i{i}", i) for i, n in enumerate(names)], "lang string, name string, id string, ord long")
    asked = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "request_id long, lang string, text string")
    got = {(r.request_id, r.id) for r in ex.match_entities(asked, lookup).collect()}
    assert got == {(i, f"i{j}") for i, t in enumerate(texts) for j, n in enumerate(names) if re.search(rf"\b{re.escape(n)}\b", t)}


PLACES = "array<struct<id:string,name:string,type:string,available:boolean>>"
EXTRACTION = f"request_id long, airports {PLACES}, destinations {PLACES}, dates array<struct<phrase:string,at:timestamp>>, duration_id string, flex_id string"


def found(i, *, port=True, open_port=True, place=True, date="2026-01-05", duration=None):
    at = dt.datetime.fromisoformat(date) if date else None
    return (i, [("AMS", "Amsterdam", "", open_port)] if port else [], [("R1", "Rome", "city", True)] if place else [], [(date, at)] if at else [], duration, "0")


def test_staged_cascade(spark):
    cal = days(spark, "2026-01-05", "2026-01-06")
    rules = spark.createDataFrame([found(1), found(2, date=None), found(3, open_port=False), found(4, place=False), found(5, date=None, place=False), found(6, date="2026-01-09")], EXTRACTION)
    model = spark.createDataFrame([(*found(1, date=None), None), (*found(2), None), (*found(3, date="2026-01-07"), None), (4, [], [], [], None, None, "Model response must be an object")],
                                  EXTRACTION + ", response_error string")
    prepared = {"rules": cs.prepare(rules, cal), "llm": cs.prepare(model, cal)}
    attempts, outcome = cs.staged_cascade(rules, prepared, [cs.Stage("r", "rules"), cs.Stage("m", "llm")], cs.Stage("p", "rules", ["availability", "destination"]))
    tried = {(r.request_id, r.position): (r.method, r.type, r.status, r.detail, r.fallback) for r in attempts.collect()}
    date, place = nm.MSG["date_required"], nm.MSG["destination_required"]
    assert tried == {
        (1, 0): ("r", "rules", "success", None, False), (2, 0): ("r", "rules", "failed", date, False), (2, 1): ("m", "llm", "success", None, False),
        (3, 0): ("r", "rules", "failed", "Departure airport 'Amsterdam' is unavailable", False), (3, 1): ("m", "llm", "failed", date, False),
        (3, 2): ("p", "rules", "failed", "Departure airport 'Amsterdam' is unavailable", True), (4, 0): ("r", "rules", "failed", place, False),
        (4, 1): ("m", "llm", "error", "Model response must be an object", False), (4, 2): ("p", "rules", "failed", place, True),
        (5, 0): ("r", "rules", "failed", date, False), (5, 1): ("m", "llm", "error", "Nothing was extracted", False), (5, 2): ("p", "rules", "failed", place, True),
        (6, 0): ("r", "rules", "failed", date, False), (6, 1): ("m", "llm", "error", "Nothing was extracted", False), (6, 2): ("p", "rules", "success", None, True)}
    ended = {r.request_id: (r.status, r.selected_stage, r.fallback_triggered) for r in outcome.collect()}
    assert ended == {1: ("success", "r", False), 2: ("success", "m", False), 3: ("failed", None, True), 4: ("failed", None, True), 5: ("failed", None, True), 6: ("success", "p", True)}
    attempts, outcome = cs.staged_cascade(rules, prepared, [cs.Stage("r", "rules")], cs.Stage("r", "rules"))
    assert attempts.count() == 6 and outcome.where("fallback_triggered").count() == 0


def test_revalidation_fills_six_fields_and_asks_touched_rules(spark):
    cal = days(spark, "2026-01-05", "2026-01-06")
    rows = [(*found(1), None, None, None), (*found(2, port=False, place=False, date=None), None, None, None), (*found(3, date=None, open_port=False), 2, 0, 1),
            (*found(4, date=None), 2, 0, 0), (*found(5, date=None, duration="2010"), None, 1, None), (*found(6, date=None), None, None, None)]
    ext = spark.createDataFrame(rows, EXTRACTION + ", adults int, non_adults int, rooms int")
    given = [(i, ["rome ", "ROME", "Elsewhere"], "popularity", ["amsterdam", "Own port"], "global", ["2026-01-06"] if i != 6 else ["soon"], "global",
              "2003", "configuration", 3, 1, "destination:Rome", 2, "global") for i in range(1, 7)]
    imputed = spark.createDataFrame(given, "request_id long, `to` array<string>, to_source string, `from` array<string>, from_source string, departure array<string>, departure_source string, "
                                    "duration_id string, duration_source string, adults int, non_adults int, party_source string, rooms int, rooms_source string")
    ports = spark.createDataFrame([("ams", "Amsterdam", "AIRPORT", True)], "id string, name string, type string, available boolean")
    cities = spark.createDataFrame([("R1", "Rome", "city", None), ("R9", "Closed", "", False)], "id string, name string, type string, available boolean")
    out = {r.request_id: r for r in cs.revalidate_imputed(cs.prepare(ext, cal), imputed, ports, cities, cal).collect()}
    assert (out[1].status, out[1].origins) == ("success", {})  # a success is left alone
    assert out[2].status == "success" and set(out[2].origins) == {"to", "from", "departure", "duration", "party", "rooms"}
    assert (out[2].payload.to_ids, out[2].payload.from_codes, out[2].payload.departure_dates) == (["R1:CITY", "Elsewhere"], ["AMS", "OWN PORT"], ["2026-01-06"])
    assert (out[2].payload.duration_id, out[2].payload.party.adults, out[2].payload.party.nonAdults, out[2].payload.rooms) == ("2003", 3, 1, 2)
    assert out[3].origins == {"departure": "global", "duration": "configuration"} and out[3].detail == "Departure airport 'Amsterdam' is unavailable"
    assert out[4].detail == nm.MSG["rooms_min"] and out[4].rule_errors.date is None  # the rooms rule was not asked again and still holds
    assert "party" not in out[5].origins and out[5].payload.duration_id == "2010" and out[5].status == "success"
    assert out[6].detail == nm.MSG["date_required"] and "departure" not in out[6].origins


def test_revalidation_shuffles_requests_once(spark):
    cal = days(spark, "2026-01-05", "2026-01-06")
    ext = spark.createDataFrame([found(i, date=None if i % 2 else "2026-01-06") for i in range(1, 40)], EXTRACTION)
    ready = cs.prepare(ext, cal)
    plan = ready._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "LogicalRDD" not in plan  # stored by column and compressed, not as a checkpoint
    columns = "request_id long, `to` array<string>, to_source string, `from` array<string>, from_source string, departure array<string>, departure_source string, duration_id string, duration_source string, adults int, non_adults int, party_source string, rooms int, rooms_source string"
    given = spark.createDataFrame([(i, ["Rome"], "popularity", ["Ams"], "global", ["2026-01-05"], "global", "2003", "global", 2, 0, "global", 1, "global") for i in range(1, 40)], columns)
    place = "id string, name string, type string, available boolean"
    ports, cities = spark.createDataFrame([("ams", "Ams", "AIRPORT", True)], place), spark.createDataFrame([("R1", "Rome", "city", True)], place)
    out = cs.revalidate_imputed(ready, given, ports, cities, cal)
    assert "Exchange hashpartitioning(request_id" not in out._jdf.queryExecution().executedPlan().toString()  # what is off the calendar is few and comes by broadcast
    assert {r.request_id: r.status for r in out.collect()} == {i: "success" for i in range(1, 40)}


def test_model_responses_are_read_once(spark):
    from wishloom.operators import cascade as cs
    from wishloom.operators import extraction as ex

    def body(content):
        return '{"choices":[{"message":{"content":%s}}]}' % content

    rows = [(1, body('{"airports":["a","zz"],"destinations":["d"],"dates":["2026-01-02"]}')), (2, body('{"airports":["a"],"destinations":["d","e"],"dates":["2026-01-03"]}')),
            (3, "not json"), (2, body('{"airports":["a"],"destinations":["d","e"],"dates":["2026-01-03"]}')), (4, body('{"airports":["a"],"destinations":["e"]}'))]
    df = spark.createDataFrame(rows, "request_id int, body string")
    places = spark.createDataFrame([("A", "a", "AIRPORT", True)], "id string, name string, type string, available boolean")
    goals = spark.createDataFrame([("d", "d", "", True), ("e", "e", "", False)], "id string, name string, type string, available boolean")
    model = ex.model_extraction(ex.read_model_responses(df), places, goals)
    assert "body" not in model._jdf.queryExecution().optimizedPlan().toString()  # no join goes back to the responses
    got = {r["request_id"]: r for r in model.collect()}
    assert got[1]["response_error"] == "Unknown departure airport 'zz' returned by model" and [p["id"] for p in got[4]["destinations"]] == ["e"]
    assert [p["id"] for p in got[2]["destinations"]] == ["d", "d", "e", "e"] and got[3]["response_error"] == "Model response must be an object"
    days = spark.sql("select date'2026-01-02' as d")
    ready = cs.prepare(model, days)
    assert ready.columns == [*model.columns, "extraction_error", "payload", "rule_errors", "detail", "status"] and ready.count() == 5
    done = {r["request_id"]: r for r in ready.collect()}
    assert done[4]["status"] == "failed" and done[4]["duration_id"] is None and done[4]["payload"]["duration_id"] is not None


def test_date_shapes(spark):
    from pyspark.sql import functions as F

    from wishloom.operators import extraction as ex

    said = ["2026-01-05", "05-01-2026", "5 January 2026", "5 jan 2026", "january 5, 2026", "Jan 5 2026", "5 Janvier 2026", "2026-13-01", "", None]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    assert [r[0] and str(r[0])[:10] for r in df.select(ex.parse_date(F.col("s"))).collect()] == ["2026-01-05"] * 6 + [None] * 4
