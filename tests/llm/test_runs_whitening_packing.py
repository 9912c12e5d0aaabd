"""Periodic runs, whitening and packing against brute force; their queries on the smallest tables."""

import collections
import hashlib
import random
import re
import zlib
from bisect import bisect_left, insort
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wishloom.llm import packing, periodic_runs, queries, whitening

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def runs_by_hand(w, min_words=24, min_repeats=3):
    found = {}
    for q in range(1, len(w) // min_repeats + 1):
        i = 0
        while i < len(w) - q:
            begin = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i > begin and i - begin + q >= max(min_words, min_repeats * q):
                found.setdefault((begin, i - begin + q), q)
            i += i == begin
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed_by_hand(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts(seed=5, n=150):
    rng = random.Random(seed)
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice([1, 2, 3, 5, 8, 15, 16, 17, 18, 24, 25, 26, 37, 38, 39, 50, 70, 101])
            unit = [f"w{rng.randrange(rng.choice([2, 3, 4, 1000]))}" for _ in range(p)]
            w += [unit[i % p] for i in range(rng.randrange(p * 5 + 30))] if rng.random() < 0.8 else [f"é{rng.randrange(50)}" for _ in range(rng.randrange(60))]
            if w and rng.random() < 0.2:
                w[rng.randrange(len(w))] = "edit"
        yield rng.choice([" ", "\n", "\t "]).join(w)


def test_periodic_runs(spark):
    texts = [None, "", " \n", "one", *periodic_texts(), "a b " * 12, "a b " * 12, "tick " * 40_000 + "end", "x " * 23, "x " * 24,
             " ".join(f"{i % 9000}" for i in range(30_000)), "a\x0bb\x0cc\x85d\xa0e " * 30]
    frame = spark.createDataFrame([(i, t, "mine", 4) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, extra int").repartition(3)
    got = periodic_runs.find(frame)
    assert got.columns == ["doc_id", "text", "extra", "n_words", "runs", "strongest", "collapsed"]
    rows = got.collect()
    assert len(rows) == len(texts) and sum(len(r.runs) for r in rows) > 100
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        if len(w) > 3000:
            continue
        want = runs_by_hand(w)
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(w)
        assert r.collapsed == collapsed_by_hand(w, want)
        best = max(want, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (r.strongest and tuple(r.strongest)) == best
    long = {r.doc_id: r for r in rows if r.n_words > 3000}
    assert sorted([tuple(x) for x in r.runs] for r in long.values()) == [[(0, 30_000, 9000)], [(0, 40_000, 1)]]
    assert periodic_runs.find(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.runs_of(np.zeros(3, np.int64), np.zeros(3, np.int64), min_repeats=2)


def test_minimizers():
    rng = np.random.default_rng(2)
    for n, width in [(1, 1), (5, 9), (40, 7), (1000, 13), (64, 1)]:
        keys = rng.integers(1, 50, n).astype(np.uint64)
        want = sorted({i for x in range(n - width + 1) for i in range(x, x + width) if keys[i] == keys[x:x + width].min()}) if n >= width else list(range(n))
        assert periodic_runs.minimizers(keys, width).tolist() == want


def test_periodic_runs_query(spark):
    rows = {r.doc_id: r for r in queries.op11_periodic_runs(spark, FOLDER).collect()}
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(rows) == len(documents) and sum(r.n_runs for r in rows.values()) > 5
    for d in documents:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        if n > 4000:
            continue
        runs, r = runs_by_hand(w), rows[d.doc_id]
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (best[1] and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed_by_hand(w, runs).encode()).hexdigest()


def exact_whitening(vectors, scale=256):
    """Fit list, size, sums and covariance as fractions."""
    x = sorted({tuple(int(np.floor(scale * float(c))) for c in v) for v in vectors})
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    centred = [[n * c - s for c, s in zip(r, sums, strict=True)] for r in x]
    return n, sums, [[Fraction(sum(r[i] * r[j] for r in centred), n ** 3) for j in range(d)] for i in range(d)]


def test_whitening(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7)) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(400 + i, base[5].tolist()) for i in range(200)] + [(None, base[6].tolist()), (5, base[7].tolist())]
    bad = [(900, None), (901, []), (902, [1.0, None] + [0.0] * 5), (903, [float("nan")] * 7), (904, [float("inf")] + [0.0] * 6)]
    frame = spark.createDataFrame([(*r, "s", 1) for r in rows + bad], "vec_id long, embedding array<double>, whitened string, deviation int").repartition(5)
    n, sums, v = exact_whitening([r[1] for r in rows])
    model = whitening.fit(frame)
    assert (model["n"], model["sums"]) == (n, sums)
    full = np.array([[float(c) for c in r] for r in v])
    values = np.linalg.eigvalsh(full)[::-1]
    assert np.allclose(model["values"], values[:4], rtol=1e-12) and np.allclose(model["explained"], values[:4] / np.trace(full), rtol=1e-12)
    assert np.abs(full @ model["vectors"] - model["vectors"] * model["values"]).max() < 1e-9 * values[0]
    assert model["identity_error"] < 1e-10
    made = whitening.whiten(frame, model)
    assert made.columns == ["vec_id", "embedding", "deviation", "whitened"]
    made = made.collect()
    assert sorted(str(r.vec_id) for r in made) == sorted(str(r[0]) for r in rows)
    for r in made:
        x = [int(np.floor(256 * c)) for c in r.embedding]
        assert int(r.deviation) == sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        want = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)]) @ model["vectors"] / np.sqrt(model["values"])
        assert np.allclose(r.whitened, want, rtol=0, atol=1e-12)


def test_whitening_cases(spark):
    def fit(rows):
        frame = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
        model = whitening.fit(frame)
        return model, whitening.whiten(frame, model).collect()

    assert fit([]) == (None, []) and fit([None, [], [float("nan")]]) == (None, [])
    model, made = fit([[1.0, 2.0]] * 5)
    assert model["n"] == 1 and len(model["values"]) == 0 and model["identity_error"] == 0 and [r.whitened for r in made] == [[]] * 5
    model, made = fit([[1e300, 2.0], [-1e300, 2.0], [1.0, -5.0]])  # integers of 64 bits and sums beyond
    assert model["n"] == 3 and abs(model["explained"][0] - 1) < 1e-12 and made[0].deviation is None and made[2].deviation is not None
    model, _ = fit([[float(i), 2.0 * i, 1.0] for i in range(50)])  # one direction only
    assert len(model["values"]) == 1 and abs(model["explained"][0] - 1) < 1e-12
    with pytest.raises(Exception, match="different lengths"):
        fit([[1.0, 2.0], [1.0]])


def test_whitening_query(spark):
    got = queries.op12_whitening(spark, FOLDER)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = got.collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
               if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)}
    n, sums, v = exact_whitening(list(vectors.values()))
    full = np.array([[float(c) for c in r] for r in v])
    values = np.linalg.eigvalsh(full)[::-1]
    assert collections.Counter(r.vec_id for r in rows) == {i: 4 for i in vectors}
    table = {(r.vec_id, r.component): r for r in rows}
    for i, e in vectors.items():
        x = [int(np.floor(256 * float(c))) for c in e]
        assert {table[i, k].deviation for k in (1, 2, 3, 4)} == {sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))}
    for k in (1, 2, 3, 4):
        assert {r.n for r in rows} == {n} and abs(table[next(iter(vectors)), k].explained - values[k - 1] / np.trace(full)) < 1e-9
    assert max(r.identity_error for r in rows) < 1e-9


def best_fit_by_hand(histogram, capacity):
    rooms, opened = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            at = bisect_left(rooms, length)
            opened += at == len(rooms)
            insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - length)
    return opened


def test_plan_is_best_fit():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([7, 50, 2048])
        histogram = {rng.randrange(1, capacity + 1): rng.randrange(200) for _ in range(rng.randrange(30))}
        segments, spans, ranks = packing.plan(histogram, capacity), collections.defaultdict(list), collections.defaultdict(list)
        for length, first, end, sequence, per, offset in segments:
            for r in range(first, end):
                spans[sequence + (r - first) // per].append((offset + (r - first) % per * length, length))
                ranks[length].append(r)
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in histogram.items() if v}
        assert sorted(spans) == list(range(best_fit_by_hand(histogram, capacity)))
        for placed in spans.values():
            at = 0
            for offset, length in sorted(placed):
                assert offset == at
                at += length
            assert at <= capacity
    assert len(packing.plan({k: 10 ** 9 + k for k in range(1, 2049)})) < 20_000


def test_words_tokenize_like_whole_texts():
    words, whole = packing.Words(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    assert words.apart
    rng = random.Random(3)
    parts = ["a", "B", "é", "É", "ß", "İ", "ı", "ſ", "K", "Å", "'s", "'LL", "'", "1", "٣", "½", " ", "\n", "́", "\xa0", "\x85", "\x1c", " ", ".", "!", "_",
             "<|endoftext|>", "<|STARTOFTEXT|>", "ǅ", "ǰ", "ŉ", "中", "한", "ﬁ", "Σ", "ς", "H̱", "T̈", "\x00", "😀"]
    texts = ["", " ", "it's we'll IT'S ..'s"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500)]
    ids, begins = words.encode([t.encode() for t in texts], 0)
    for i, t in enumerate(texts):
        assert ids[begins[i]:begins[i + 1]].tolist() == [*whole.encode(t, add_special_tokens=False).ids, 0], t
    words.apart = False
    again, ends = words.encode([t.encode() for t in texts], 0)
    assert again.tolist() == ids.tolist() and ends.tolist() == begins.tolist()


def test_packing(spark):
    whole = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(4)
    texts = [None, "", "same text here"] + ["same text here"] * 300 + ["w1 " * 3000, "long word " * 900] + ["b " * rng.randrange(1, 150) for _ in range(200)]
    frame = spark.createDataFrame([(i % 400, t, "old", 3) for i, t in enumerate(texts)], "doc_id long, text string, piece string, extra int").repartition(6)
    packed = packing.pack(packing.pieces(frame, VOCABULARY, keep=["doc_id", "text", "piece", "extra"], capacity=100), capacity=100)
    assert packed.columns == ["doc_id", "text", "extra", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    rows = packed.collect()
    lengths = collections.Counter()
    for t in texts:
        n = len(whole.encode(t or "", add_special_tokens=False).ids) + 1
        lengths.update([100] * (n // 100) + [n % 100] * (n % 100 > 0))
    assert collections.Counter(r.length for r in rows) == lengths
    held = collections.defaultdict(list)
    for r in rows:
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert r.start == 100 * r.piece and r.ids == ids[r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        held[r.sequence_id].append(r)
    assert len(held) == best_fit_by_hand(lengths, 100)
    whole_ids = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for s, parts in held.items():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
        assert whole_ids[s] == [i for p in parts for i in p.ids] and len(whole_ids[s]) <= 100
    assert packing.pack(packing.pieces(frame.limit(0), VOCABULARY)).collect() == []


def test_packing_query(spark):
    got = queries.op13_best_fit_packing(spark, FOLDER)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    size = collections.Counter()
    for r in rows:
        size[r.sequence_id] += r.length
    assert max(size.values()) <= 2048 and len(size) <= -(-sum(size.values()) // 2048) + 1
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert {r.doc_id for r in rows} == {r.doc_id for r in documents.collect()}
    assert got.where(F.col("piece") > 0).count() == sum(r.piece > 0 for r in rows)
