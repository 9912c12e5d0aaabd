import numpy as np
import pytest
from pyspark.sql import functions as F

from wishloom.functions import vectors as vx
from wishloom.operators import similarity as sm


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    options = [(f"o{i}", i, [float(x) for x in rng.normal(size=5)]) for i in range(11)]
    options.append(("o11", 11, options[3][2]))  # a tie with o3
    utterances = [(i, f"o{i % 13}", [float(x) for x in rng.normal(size=5)]) for i in range(40)]
    return (spark.createDataFrame(utterances, "vec_id long, target string, embedding array<double>"),
            spark.createDataFrame(options, "option_id string, option_ord long, centroid array<double>"))


def test_tiles_equal_one_tile(data):
    u, o = data
    targets = F.array("target")
    whole = sm.score_targets(u, o, "vec_id", targets).orderBy("vec_id").collect()
    parts = sm.score_targets(u, o, "vec_id", targets, tile_bytes=160).orderBy("vec_id").collect()
    for a, b in zip(whole, parts):
        for name in a.asDict():
            assert a[name] == (pytest.approx(b[name]) if isinstance(a[name], float) else b[name]), name


def test_rank_equals_brute_force(data):
    u, o = data
    options = {r["option_id"]: (r["option_ord"], np.array(r["centroid"])) for r in o.collect()}
    vectors = {r["vec_id"]: np.array(r["embedding"]) for r in u.collect()}
    for r in sm.score_targets(u, o, "vec_id", F.array("target")).join(u.select("vec_id", "target"), "vec_id").collect():
        v = vectors[r["vec_id"]]
        cos = {k: v @ c / np.linalg.norm(v) / np.linalg.norm(c) for k, (_i, c) in options.items()}
        order = sorted(cos, key=lambda k: (-round(cos[k], 12), options[k][0]))
        assert r["top_option"] == order[0]
        assert r["target_rank"] == (order.index(r["target"]) + 1 if r["target"] in order else None)
        rest = [c for k, c in cos.items() if k != r["target"]]
        assert r["best_non_target"] == pytest.approx(max(rest))


def test_keep_or_top_k_tiles_equal_one_tile(data):
    u, o = data
    for threshold in (0.4, 0.99):
        a = sm.keep_or_top_k(u, o, "vec_id", threshold, 3).select("vec_id", "option_id", "similarity_rank")
        b = sm.keep_or_top_k(u, o, "vec_id", threshold, 3, tile_bytes=160).select("vec_id", "option_id", "similarity_rank")
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_purity_and_centroid_literals(spark):
    o = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [0.0, 1.0])], "option_id string, option_ord long, centroid array<double>")
    u = spark.createDataFrame([(1, [0.9, 0.0]), (2, [0.5, 0.49]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    s = sm.purity_gate(sm.score_targets(u, o, "vec_id", F.array(F.lit("a"))), F.lit("a"))
    assert {r["vec_id"]: r["reason"] for r in s.collect()} == {
        1: "accepted", 2: "insufficient_margin", 3: "score_below_threshold"}
    v = spark.createDataFrame([("k", [1.0, 0.0]), ("k", [0.0, 1.0]), ("k", [0.5, 0.5])], "k string, embedding array<double>")
    assert vx.centroids(v, "k").first()["centroid"] == [0.5, 0.5]
    ragged = spark.createDataFrame([("k", [1.0]), ("k", [0.0, 1.0])], "k string, embedding array<double>")
    assert vx.centroids(ragged, "k").first()["consistent"] is False


def test_bounds_skip_tiles_and_change_nothing(spark):
    rng = np.random.default_rng(4)
    groups = rng.normal(size=(20, 16))
    vectors = np.repeat(groups, 50, axis=0) + 0.05 * rng.normal(size=(1000, 16))
    vectors[700] = vectors[20]  # equal options far apart in order
    options = spark.createDataFrame([(f"o{i}", i, v.tolist()) for i, v in enumerate(vectors)], "option_id string, option_ord long, centroid array<double>")
    unit = sm._unit_rows(vectors)
    asked = sm._unit_rows(groups[:3] + 0.05 * rng.normal(size=(3, 16)))
    asked[2] = unit[20]
    wanted = [{"o3", "missing"}, {"o60", "o70"}, {"o700"}]
    small, whole = sm.write_tiles(options, "option_id", "centroid", "option_ord", 50 * 16 * 8), sm.write_tiles(options, "option_id", "centroid", "option_ord")
    assert len(small.files) >= 20 and len(whole.files) == 1 and small.sizes.sum() == 1000
    a, b = sm.target_answers(asked, wanted, small), sm.target_answers(asked, wanted, whole)
    for name in a.columns:
        assert all(x == pytest.approx(y, abs=1e-9) if isinstance(x, float) else x == y for x, y in zip(a[name], b[name], strict=True)), name
    assert small.reads < len(small.files) / 2
    scores = asked @ unit.T
    assert a["top_option"].tolist()[2] == "o20" and a["target_rank"].tolist()[2] == 2
    assert a["target_rank"].tolist()[0] == 1 + (scores[0] > scores[0][3]).sum()
    before = small.reads
    for threshold in (0.95, 0.9999999, 2.0):
        one, other = sm.kept_options(asked, threshold, 5, small), sm.kept_options(asked, threshold, 5, whole)
        assert [[x[2] for x in p] for p in one] == [[x[2] for x in p] for p in other]
    assert small.reads - before < 3 * len(small.files) / 2
    empty = sm.write_tiles(options.limit(0), "option_id", "centroid", "option_ord")
    assert empty.files == [] and sm.score_targets(spark.createDataFrame([(1, [1.0] * 16)], "vec_id long, embedding array<double>"), options.limit(0), "vec_id", F.array(F.lit("a"))).collect() == []


def test_hashed_words_are_hashed_once(spark):
    import hashlib
    import time

    texts = [None, "", "One two, two", " ".join(f"w{i % 977}" for i in range(20000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")

    def counted(text, dimension):
        found = [0.0] * dimension
        for word in text.replace(",", " ").lower().split():
            found[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimension] += 1
        return found

    for dimension in (1, 16, 64):
        got = {r["i"]: r["v"] for r in df.select("i", vx.hashed_bag_of_words(F.col("text"), dimension).alias("v")).collect()}
        assert got[0] == [None] * dimension
        assert all(got[i] == counted(texts[i], dimension) for i in (1, 2, 3))

    def seconds(dimension):
        at = time.time()
        df.where("i = 3").select(F.explode(F.array_repeat("text", 5)).alias("text")).select(
            F.max(vx.hashed_bag_of_words(F.col("text"), dimension))).collect()
        return time.time() - at

    assert seconds(4) and seconds(200) < 15 * seconds(4)
