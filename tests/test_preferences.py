import random
from collections import Counter

import pytest
from wishloom.operators import preferences as pf


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [("facilities", "Facilities", 0, "wifi", "Wi-Fi", 0, ["wifi", "free wifi", "wireless internet"]),
            ("facilities", "Facilities", 0, "scuba", "Scuba", 1, ["scuba diving"]),
            ("boards", "Boards", 1, "room_only", "Room Only", 0, ["room only", "catering"])]
    return spark.createDataFrame(rows, "filter_id string, filter_label string, filter_ord int, option_id string, "
                                       "option_label string, option_ord int, synonyms array<string>")


def mapped(spark, catalogue, texts, **params):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {(r["doc_id"], r["option_id"]): r for r in pf.map_by_rules(df, catalogue, "doc_id", **params).collect()}


def test_scoring_cases(spark, catalogue):
    got = mapped(spark, catalogue, ["wifi", "wifi wifi", "no catering but scuba required", "no wifi", "no strong wifi"], threshold=0.65)
    assert not got[0, "wifi"]["selected"] and got[1, "wifi"]["selected"]
    assert got[2, "room_only"]["negated_hits"] == 1 and (2, "scuba") in got
    assert got[3, "wifi"]["blocked"] and not got[3, "wifi"]["selected"]
    assert not got[4, "wifi"]["blocked"]


def test_penalty_unselects(spark, catalogue):
    text = ["no catering"]
    free = mapped(spark, catalogue, text, penalty=0.0)[0, "room_only"]["confidence"]
    low = mapped(spark, catalogue, text, penalty=0.5)[0, "room_only"]
    assert low["confidence"] == pytest.approx(free - 0.5) and not low["selected"]


def test_hits_equal_brute_force_with_a_hot_word(spark):
    rng = random.Random(9)
    words = ["the"] * 6 + ["pool", "sea", "view"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    synonyms = ["the", "the the", "the pool", "sea view the", "pool sea view the"]
    index = spark.createDataFrame([(s,) for s in synonyms], "synonym string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = Counter()
    for i, text in enumerate(texts):
        t = text.split()
        for n in (1, 2, 3):
            for p in range(len(t) - n + 1):
                gram = " ".join(t[p:p + n])
                if gram in synonyms:
                    want[i, gram] += 1
    got = {(r["doc_id"], r["synonym"]): r["hits"] for r in pf.synonym_hits(df, index, "doc_id").collect()}
    assert got == dict(want)


def test_nested_payload(spark, catalogue):
    df = spark.createDataFrame([(1, "free wifi and scuba diving, room only")], "doc_id int, text string")
    nested = pf.nest_selections(pf.map_by_rules(df, catalogue, "doc_id"), catalogue, "doc_id").first()["filters"]
    assert [f["filter_id"] for f in nested] == ["facilities", "boards"]
    assert [o["option_id"] for o in nested[0]["options"]] == ["wifi", "scuba"]
    assert all(0 <= o["confidence"] <= 1 for f in nested for o in f["options"])


def test_run_statuses(spark, catalogue):
    df = spark.createDataFrame([(1, "the wifi"), (2, "the beach"), (3, "je cherche des vacances"), (4, "?")], "doc_id int, text string")
    got = {r["doc_id"]: r["status"] for r in pf.run_preferences(df, catalogue, "doc_id").collect()}
    assert got == {1: "success", 2: "no-preferences-detected", 3: "error", 4: "error"}
