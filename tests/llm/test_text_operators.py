"""Row-local and corpus text operators against brute force on small hostile tables."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wishloom.llm import byte_bpe, decontaminate, jaccard_join, language_id, line_templates, quality, repeats
from wishloom.llm.components import components
from wishloom.plans.scale import settle

FOLDER = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, row string, n_words int, doc string"


def hostile(seed=3, n=60):
    """Nulls, empty and blank texts, repeated rows, a very long text, near copies, all in one table."""
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "delta,", "é", "ñandú", "zeta9", "a-b", "Straße", "it's", "中文", "x"]
    make = lambda k: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(k))
    base = make(70)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (5, "one two three"), (6, "One TWO three"), (None, base)]
    rows += [(100 + i, make(rng.randrange(1, 90))) for i in range(n)]
    for i in range(12):
        part = base.split(" ")
        part[rng.randrange(len(part))] = f"edit{i}"
        rows.append((300 + i, " ".join(part)))
    rows += [(400, base), (401, base), (402, base + "\n" + make(40)), (500, "tick " * 9000 + make(50)), (501, "tick " * 9000 + make(50))]
    return [(*r, "keep", 7, "me") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hostile(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_join(spark, docs, empty):
    rows = hostile()
    want, parent = {}, {}
    for d, t, *_ in rows:
        if d is not None:
            want.setdefault(d, shingles(t))
            parent[d] = d

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in want:
        for b in want:
            both = len(want[a] & want[b])
            if a < b and both and 100 * both >= 75 * len(want[a] | want[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = jaccard_join.join(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(want[r.doc_id]), root(r.doc_id))
    assert jaccard_join.join(empty).collect() == []


def test_jaccard_cells_and_salts(spark, docs, monkeypatch):
    want = sorted(map(tuple, jaccard_join.join(docs).fillna(-1).collect()))
    monkeypatch.setattr(jaccard_join, "GROUP", 2)
    monkeypatch.setattr(jaccard_join, "CELL", 2)
    assert sorted(map(tuple, jaccard_join.join(docs).fillna(-1).collect())) == want


def test_segments_cover_every_pair():
    bands = jaccard_join.Bands(3, 4)
    for n in range(1, 400):
        for least in range(-(-3 * n // 4), n + 1):
            band = int(bands.of(least))
            bound = int(bands.bound(n, min(n, int(bands.high[band]))))
            assert bound >= (n + least) // 7
            assert (2 if bands.small[band] else 1) * int(bands.segments[band]) > bound


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(160, 101), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 161)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def covered(rows, length, keep):
    seen, order = {}, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    coded = [(i, (t or "").encode()) for i, (_, t, *_) in enumerate(order)]
    for i, x in coded:
        for p in range(len(x) - length + 1):
            seen.setdefault(x[p:p + length], []).append((i, p))
    marks = [bytearray(len(x)) for _, x in coded]
    for places in seen.values():
        for i, p in places if keep == "none" and len(places) > 1 else places[1:]:
            marks[i][p:p + length] = b"\1" * length
    return [(order[i][0], bytes(b for b, m in zip(x, marks[i], strict=True) if not m)) for i, x in coded]


@pytest.mark.parametrize("limit", [None, 700])
def test_repeats(spark, docs, empty, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(repeats, "GROUP_BYTES", limit)
    found = repeats.find(docs, length=60, keep="none", gram=24)
    got = repeats.remove(docs, found)
    assert got.columns == [*docs.columns, "n_bytes", "n_removed", "n_spans", "kept"]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, bytes(r.kept)) for r in got.collect()), key=key) == sorted(covered(hostile(), 60, "none"), key=key)
    assert repeats.remove(empty, repeats.find(empty, length=60)).collect() == []


def test_repeats_keep_first(spark):
    rows = [(i, t) for i, (_, t, *_) in enumerate(hostile(9, 10))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.remove(frame, repeats.find(frame, length=60, keep="first", gram=24))
    assert sorted((r.doc_id, bytes(r.kept)) for r in got.collect()) == sorted(covered(rows, 60, "first"))


def test_previous_factors():
    import numpy as np

    text = np.frombuffer(b"abracadabra-abracadabra", np.uint8)
    for length in (8, 9, 11):
        at = np.arange(len(text) - length + 1)
        earlier, elsewhere = repeats.previous_factors(repeats.suffix_ranks(text, length), at)
        parts = [bytes(text[p:p + length]) for p in at]
        assert earlier.tolist() == [x in parts[:i] for i, x in enumerate(parts)]
        assert elsewhere.tolist() == [parts.count(x) > 1 for x in parts]


BENCH = [(1, "beta1 x2 short"), (2, None), (None, "no id"), (3, ""), (4, " ".join(f"w{i}" for i in range(14))), (4, "tick tick"),
         (5, " ".join(["tick"] * 12)), (6, "Straße")]


def test_decontaminate(spark, docs, empty):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    rows = [*hostile(), (900, "say w0 W1 w2 w3 w4 w5-w6 w7 w8 w9 w10 end", "k", 1, "d"), (901, "beta1 X2, SHORT! straße", "k", 1, "d")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    want = []
    for d, t, *_ in rows:
        w, hit, items = split(t), set(), set()
        for item, text in BENCH:
            v = split(text) if item is not None else []
            k = min(len(v), 10)
            windows = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)} if v else set()
            for i in range(len(w) - k + 1) if k else ():
                if tuple(w[i:i + k]) in windows:
                    hit.update(range(i, i + k))
                    items.add(str(item))
        want.append((d, len(w), len(hit), sorted(items)))
    for slice_bytes in (1 << 20, 20):
        got = decontaminate.find(frame, decontaminate.index(bench, slice_bytes=slice_bytes))
        assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()))) == sorted(map(repr, want))
        assert all(sum(s.end - s.start for s in r.spans) == r.n_hit and r.longest == max((s.end - s.start for s in r.spans), default=0)
                   for r in got.collect())
    clean = decontaminate.remove(frame, decontaminate.index(bench))
    assert clean.columns == frame.columns and clean.count() == sum(1 for w in want if not w[2])
    assert decontaminate.find(empty, decontaminate.index(bench)).collect() == []
    assert decontaminate.remove(docs, decontaminate.index(bench.limit(0))).count() == len(hostile())


@pytest.fixture(scope="module")
def pieces():
    tokenizers = pytest.importorskip("public_tokenizers")
    return byte_bpe.load_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken")), tokenizers


def test_byte_bpe_equals_library(spark, docs, empty, pieces):
    import tiktoken

    pieces, tokenizers = pieces
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks={p: r for r, p in enumerate(pieces)}, special_tokens={})
    rng = random.Random(5)
    odd = ["'", "s", "'ll", " '", "re", "  ", "\n", "\t ", "\u00a0", "12", "½", "é", "中", "!", "\U0001F600", "\u0301", "\x1c", "\x85", "Abc"]
    rows = [*hostile(), *[(1000 + i, "".join(rng.choices(odd, k=rng.randrange(30))), "", 0, "") for i in range(200)],
            (2000, "z" * 3000, "", 0, ""), (2001, "ab" * 150 + " " + "!" * 400, "", 0, "")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    book = byte_bpe.dictionary(frame, pieces, shards=3)
    got = byte_bpe.decode(byte_bpe.encode(frame, book), pieces, name="back").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()
    assert byte_bpe.encode(empty, byte_bpe.dictionary(empty, pieces)).collect() == []
    few = spark.createDataFrame([(1, None, 2), (2, [], 3), (3, [5, 50_255, 5], 4), (4, None, 5)], "decoded long, ids array<int>, n int")
    assert {r.n: bytes(r.decoded) for r in byte_bpe.decode(few, pieces).collect()} == {2: b"", 3: b"", 4: pieces[5] + pieces[50_255] + pieces[5], 5: b""}
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([([50_256],)], "ids array<int>"), pieces).collect()


def test_bpe_segments_are_bounded_and_one_file_each(spark, pieces, tmp_path):
    import glob

    import numpy as np

    from wishloom.llm import blobs

    pieces, _ = pieces
    texts = ["the cat sat on the mat", "ünïcödé 中文 \U0001F600 x" * 3, "z" * 700 + " " + "ab" * 200, "", None, " ".join(f"w{i}" for i in range(200))]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    book = byte_bpe.dictionary(frame, pieces, shards=2, segment_words=20)
    assert list(book["first"]) == sorted(book["first"]) and len(book["at"]) == len(set(book["at"])) > 2
    sizes = [len(byte_bpe._segment(at)[0]) for at in book["at"]]
    assert sum(sizes) > 200 and all((np.diff(byte_bpe._segment(at)[0]) >= 0).all() for at in book["at"])
    folder = book["at"][0].removeprefix("file:").rsplit("/", 1)[0]
    assert len(glob.glob(f"{folder}/*.npy")) == len(book["at"])
    whole = byte_bpe.dictionary(frame, pieces, shards=1)
    ids = [{r.doc_id: r.ids for r in byte_bpe.encode(frame, b).collect()} for b in (book, whole)]
    assert ids[0] == ids[1] and ids[0][3] == [] == ids[0][4]
    assert b"".join(pieces[i] for i in ids[0][2]).decode() == texts[2]
    # two words of one key: the characters decide, wherever the segment has them
    key, words, code = np.array([-5, 7, 7, 9]), ["aa", "bcd", "中", "e"], [[1], [2, 3], [4], [5, 6, 7]]
    raw = lambda ws: np.frombuffer("".join(ws).encode("utf-32-le"), np.uint32)
    held = byte_bpe._packed(key, raw(words), np.array([2, 3, 1, 1]), np.array([i for c in code for i in c]), np.array([1, 2, 1, 3]))
    own = {"first": key[:1], "at": [blobs.put(str(tmp_path), "words", held)]}
    out, number = byte_bpe._ids_of(own, np.array([9, 7, -5]), raw(["e", "中", "aa"]), np.array([0, 1, 2]), np.array([1, 1, 2]))
    assert out.tolist() == [5, 6, 7, 4, 1] and number.tolist() == [3, 1, 1]
    for k, w in ((7, "bce"), (8, "e"), (-6, "a"), (10, "e")):
        with pytest.raises(KeyError):
            byte_bpe._ids_of(own, np.array([k]), raw([w]), np.array([0]), np.array([len(w)]))


def test_mapped_arrays_keep_no_file_open(tmp_path):
    import os

    import numpy as np

    from wishloom.llm import blobs

    arrays = [np.arange(i, dtype=np.int32).reshape(1, -1) for i in range(60)] + [np.array(["a", "bcd"])]
    addresses = [blobs.put(str(tmp_path), "a", a) for a in arrays]
    before = len(os.listdir("/proc/self/fd"))
    held = [blobs.mapped(a) for a in addresses]
    assert len(os.listdir("/proc/self/fd")) - before < 5
    for have, want in zip(held, arrays, strict=True):
        assert have.shape == want.shape and have.dtype == want.dtype and (have == want).all() and not have.flags.writeable


def test_append_sends_a_column_once(spark):
    from wishloom.llm import arrowmap

    frame = spark.createDataFrame([(1, "a", 2), (2, None, 3)], "n long, text string, m int")
    both = lambda m, t: [[f"{x}{y}" for x, y in zip(m.to_pylist(), t.to_pylist(), strict=True)]]
    kept = arrowmap.append(frame, ["m", "text"], None, "s string", both)
    assert sorted(map(tuple, kept.collect())) == [(1, "a", 2, "2a"), (2, None, 3, "3None")]
    replaced = arrowmap.append(frame, ["m", "text"], ["m"], "text string", both)
    assert sorted(map(tuple, replaced.collect())) == [(2, "2a"), (3, "3None")]
    plan = kept._jdf.queryExecution().optimizedPlan()
    assert plan.children().apply(0).output().size() == 3


def test_stages_send_a_text_once_and_keep_named_columns(spark):
    frame = spark.createDataFrame([(1, "the cat sat on the mat and the dog ran", "en", 0.5, "x"), (2, "der Hund und die Katze sind im Haus", "de", 0.1, "y"), (3, None, "en", 0.2, "z")],
                                  "doc_id long, text string, lang string, score double, n_hit string")
    models = language_id.train(frame.where("text is not null"))
    from wishloom.llm.arrowmap import neutral

    plain, text = neutral(frame, "Text")
    assert (plain.columns[1], text) == ("_c1", "_c1")
    found = language_id.predict(plain, models, text)
    assert found._jdf.queryExecution().optimizedPlan().children().apply(0).output().size() == 5  # not the text twice
    bench = decontaminate.index(spark.createDataFrame([(1, "der Hund und die Katze sind im Haus")], "item_id long, text string"))
    left = decontaminate.remove(frame, bench)
    assert left.schema == frame.schema and sorted(map(tuple, left.collect())) == [tuple(r) for r in frame.collect() if r.doc_id != 2]


def test_fold_equals_heap(spark, pieces):
    pieces, _ = pieces
    ranks = {p: r for r, p in enumerate(pieces)}
    words = [" hello", "aaaaaaaa", "Ünïcödé", "x", "ionization", "1234567"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", byte_bpe.fold_merges(F.col("w").cast("binary"), pieces).alias("ids"))
    assert {r.w: r.ids for r in got.collect()} == {w: byte_bpe.heap_merges(w.encode(), ranks) for w in words}
    assert base64.b64encode(pieces[0]) == b"IQ=="


def test_line_templates(spark, docs, empty):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(12):
        rows.append((i, "\n".join([f"{word()} {word()} {word()} {word()}", f"Posted on day {i} by user{i} at noon today exactly",
                                   f"{word()} {word()} {word()}", "All rights are reserved"])))
    copy = "\n".join(["first line of copy", "second line of copy", "third line of copy"])
    rows += [(100 + i, copy) for i in range(20)] + [(200, None), (201, ""), (202, "\n\n"), (None, "All rights are reserved")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n_lines string, h int")
    got = line_templates.dedup(frame)
    assert got.columns == ["doc_id", "text", "h", "n_lines", "n_dropped"]
    got = {(r.doc_id): r for r in got.collect()}
    for i in range(12):
        lines = rows[i][1].split("\n")
        assert got[i].text == lines[0] + "\n" + lines[2] and (got[i].n_lines, got[i].n_dropped) == (4, 2)
    assert all(got[100 + i].text == copy and got[100 + i].n_dropped == 0 for i in range(20))
    assert got[200].text is None and got[201].text == "" and got[202].text == "\n\n" and got[None].text == ""
    assert line_templates.dedup(empty).collect() == []
    templates = {r.template for r in line_templates.recurring(frame).collect()}
    assert templates == {"Posted on day <*> by <*> at noon today exactly", "All rights are reserved"}
    assert line_templates.dedup(docs).count() == len(hostile())


def made_up(rng, lines, words=7):
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    return [" ".join(word() for _ in range(words)) for _ in range(lines)]


def test_line_templates_keep_edited_copies(spark):
    rng = random.Random(6)
    base, rows, footer = made_up(rng, 20), [], "All rights are reserved here"
    for i in range(300):
        lines = list(base)
        for j, at in enumerate(rng.sample(range(20), 2)):
            words = lines[at].split(" ")
            words[rng.randrange(7)] = f"edit{'abc'[j]}{''.join(rng.choice('qrstuvwxyz') for _ in range(5))}"
            lines[at] = " ".join(words)
        rows.append((i, "\n".join([*lines, footer])))
    rows += [(1000 + i, "\n".join([*made_up(rng, 4), footer])) for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = settle(line_templates.dedup(frame))
    want = {i: t.removesuffix("\n" + footer) for i, t in rows}
    assert {r.doc_id: r.text for r in got.collect()} == want
    joined = jaccard_join.join(got.select("doc_id", "text")).collect()
    assert {r.component_id for r in joined if r.doc_id < 1000} == {0}


@pytest.mark.parametrize("size", [2, 3, 10])
def test_line_templates_drop_blocks(spark, size):
    rng = random.Random(size)
    rows, want = [], {}
    for p, place in enumerate((0, 3, 6)):
        block = made_up(rng, size)
        for i in range(30):
            own = made_up(rng, 6)
            rows.append((100 * p + i, "\n".join(own[:place] + block + own[place:])))
            want[100 * p + i] = "\n".join(own)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.text for r in line_templates.dedup(frame).collect()} == want


def test_line_templates_of_short_lines_with_fields(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for i in range(12):
        own = made_up(rng, 3)
        short = [f"Posted on {i}.4.2024 by user{i}", f"Page {i} of {i + 9}", f"Posted on {i}.5.2024 by {own[0][:6]}"]
        kept = [f"They have seen {own[1][:6]}", f"{i} {i + 1} {i + 2}"]
        rows.append((i, "\n".join([own[0], *short, own[1], *kept, own[2]])))
        want[i] = "\n".join([own[0], own[1], *kept, own[2]])
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in line_templates.dedup(frame).collect()} == want


def test_automaton_holds_exactly_the_substrings():
    rng = random.Random(1)
    text = [rng.randrange(1, 4) for _ in range(60)]
    table = language_id.automaton(text, 4)
    have = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, min(60, i + 6) + 1)}
    for _ in range(3000):
        word = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))]
        state = 0
        for c in word:
            state = table[state + c] if state >= 0 else -1
        assert (state >= 0) == (tuple(word) in have)


def test_language_id(spark, docs, empty):
    en = "the quick brown fox jumps over the lazy dog and then the other thing with that "
    de = "der schnelle braune fuchs springt über den faulen hund und dann noch ein ding mit der "
    rows = [(i, (en if i % 2 else de) * 3, "en" if i % 2 else "de", "c") for i in range(40)] + [(90, None, "en", "c"), (None, en, "en", "c"), (91, "x", None, "c")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    models = language_id.train(labelled)
    ask = spark.createDataFrame([(1, "the dog and the fox", 0.0), (2, "der hund und der fuchs", 0.0), (3, None, 0.0), (4, "123 !!", 0.0), (5, "", 0.0),
                                 (6, "the thing " * 30000, 0.0), (7, "中文", 0.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in language_id.predict(ask, models).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6)] == ["en", "de", "und", "und", "und", "en"]
    assert got[7].lang_pred in ("de", "en") and all(0 <= r.score <= 1 for r in got.values()) and got[3].score == 0
    kept = {r.doc_id for r in language_id.accepted(language_id.predict(ask, models)).collect()}
    assert kept == {1, 2, 6}
    assert language_id.predict(empty, models).collect() == []
    assert {r.lang_pred for r in language_id.predict(ask, language_id.train(labelled.limit(0))).collect()} == {"und"}


def test_quality(spark, empty):
    rng = random.Random(4)
    good = lambda: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 80))) + "."
    rows = [(i, good() if i % 3 else "BUY!! NOW!! " * rng.randrange(3, 30), int(i % 3 > 0)) for i in range(300)] + [(900, None, 1), (901, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    measured = quality.settle_features(frame, ["doc_id", "quality"])
    model = quality.fit(measured.where("doc_id % 5 <> 0"))
    got = quality.score(measured, model).where("doc_id % 5 = 0 and doc_id < 900").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(measured, model).count() == 302
    one_class = quality.fit(measured.where("quality = 1"))
    assert quality.score(measured, one_class).agg(F.min("score")).first()[0] == 1.0
    assert quality.score(measured, quality.fit(measured.limit(0))).agg(F.max("score")).first()[0] == 0.5
    assert quality.features(empty).collect() == []


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_word_groups_and_held_powers():
    import numpy as np

    from wishloom.llm import bytetext

    rng = np.random.default_rng(4)
    few = rng.integers(-2**63, 2**63, 300, dtype=np.int64)
    few[:100] = few[100:200] ^ 1  # agree in all upper bits
    key = few[rng.integers(0, 300, 5000)]
    at, group = byte_bpe._groups(key)
    assert (key[at][group] == key).all() and set(key[at].tolist()) == set(key.tolist())
    base = bytetext.BASE
    held = bytetext.powers(1000, base)
    assert np.shares_memory(held, bytetext.powers(10, base))
    assert bytetext.powers(50, base).tolist() == [pow(int(base), i, 1 << 64) for i in range(51)]


def test_parity_bounds_the_difference_and_folds():
    import numpy as np

    rng = np.random.default_rng(8)
    for n in (1, 5, 300, 1020, 1030, 5000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate((a[: n - n // 9], rng.integers(0, 2**63, n // 5).astype(np.uint64)))
        x, y = jaccard_join.parity(a), jaccard_join.parity(b)
        while len(x) > len(y):
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        while len(y) > len(x):
            y = y[:len(y) // 2] ^ y[len(y) // 2:]
        apart = int(np.bitwise_count(x ^ y).sum())
        assert apart <= len(np.setxor1d(a, b)) and len(jaccard_join.parity(a)) * 64 >= 4 * n


def test_pairs_ruled_out_hold_no_link():
    import numpy as np

    rng = np.random.default_rng(9)
    sets = []
    for n in (3, 40, 255, 1020, 1030, 1100):
        first = rng.integers(0, 2**63, n).astype(np.uint64)
        sets += [np.unique(np.concatenate((first[n // part:], rng.integers(0, 2**63, n // part).astype(np.uint64)))) for part in (4, 8, 12, 40, n + 1)]
    bits = [jaccard_join.parity(x) for x in sets]
    length = np.array([len(b) for b in bits])
    size = np.array([len(x) for x in sets])
    size[2] = -1  # several texts under one id
    a, b = np.triu_indices(len(sets), 1)
    possible = jaccard_join._possible((size, np.concatenate(bits), np.cumsum(length) - length, length), a, b, 3, 4)
    linked = np.array([jaccard_join._linked(sets[i], sets[j], 3, 4) for i, j in zip(a, b, strict=True)])
    assert linked.any() and not (linked & ~possible).any()
    assert possible[(a == 2) | (b == 2)].all() and possible.sum() < len(a) // 2


def parsed_by_hand(text, sample):
    """Phrases of a greedy parse: the longest stretches of the sample, an unknown symbol alone."""
    count = at = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at, count = max(at + 1, end - 1), count + 1
    return count


@pytest.mark.parametrize("symbols", [2, 8, 700])
def test_cross_parse_equals_greedy_parse(symbols):
    rng = random.Random(symbols)
    for _ in range(12):
        sample = [rng.randrange(1, symbols + 1) for _ in range(rng.choice([0, 1, 30, 400, 3000]))] * rng.choice([1, 2])
        table = language_id.states(sample)
        table[0][0] = len(table)
        table.append({})
        known, texts = set(sample), []
        for size in (0, 1, 127, 128, 129, 1500):
            text = []
            while len(text) < size:
                at = rng.randrange(max(1, len(sample)))
                text += sample[at:at + rng.randrange(1, 400)] + [rng.randrange(symbols + 1) for _ in range(rng.randrange(1, 6))]
            texts.append([c if c in known else 0 for c in text])
        spelled = ["".join(chr(1000 + c) for c in t) for t in texts]
        want = [parsed_by_hand(t, "".join(chr(1000 + c) for c in sample)) for t in spelled]
        off = np.cumsum([0, *map(len, texts)])
        code = np.array([c for t in texts for c in t], np.int64)
        for flat in (language_id._dense(table, symbols + 1), language_id._sparse(table, symbols + 1)):
            assert language_id.cross_parse(code, off, flat).tolist() == want


def test_language_of_many_symbols_and_ties(spark):
    rng = random.Random(6)
    letters = [chr(0x4E00 + i) for i in range(1500)]
    words = ["".join(rng.choice(letters) for _ in range(3)) for _ in range(500)]
    latin = "some words in plain letters that come again and again in every text of this language".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(150)), "zh") for i in range(200)]
    rows += [(1000 + i, " ".join(rng.choice(latin) for _ in range(150)), "en") for i in range(200)]
    rows += [(2000, rows[0][1], "zh"), (2000, rows[0][1], "zh"), (2001, "", None), (None, rows[1][1], "zh")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, score int, lang_pred string").repartition(4)
    models = language_id.train(frame.where("doc_id % 5 <> 0"), sample_documents=400)
    assert [m["size"] > 256 for m in models] == [False, True]
    got = language_id.predict(frame, models).collect()
    assert len(got) == len(rows) and all(r.lang_pred == (r.lang or "und") for r in got)
    assert language_id.accepted(language_id.predict(frame, models)).count() == len(rows) - 1
    twice = language_id.train(frame.where("lang = 'en'").withColumn("lang", F.explode(F.array(F.lit("b"), F.lit("a")))), sample_documents=400)
    tied = language_id.predict(frame.where("lang = 'en'"), twice).collect()
    assert {r.lang_pred for r in tied} == {"a"} and all(abs(r.score - 0.5) < 1e-9 for r in tied)


STAGED = "doc_id long, text string, lang string, n_lines int, n_dropped int, _gone int, _again string, n_chars int"


def test_stages_keep_clashing_columns_and_shared_ids(spark):
    from wishloom.llm import stages

    rng = random.Random(9)
    prose = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(60))
    one, two, three = prose(), prose(), prose()
    rows = [(1, one), (2, one), (2, one), (5, two), (5, three), (5, three), (7, three), (8, None), (9, ""), (None, two), (None, two)]
    docs = spark.createDataFrame([(i, t, "en", 77, 88, n % 2, "mine", 0) for n, (i, t) in enumerate(rows)], STAGED).repartition(3)
    lines = stages.drop_lines(spark, docs, FOLDER)
    assert lines.columns == docs.columns and lines.count() == len(rows)
    assert {(r.n_lines, r.n_dropped, r._again) for r in lines.collect()} == {(77, 88, "mine")}
    kept = stages.one_per_group(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r._gone) for r in kept.collect()), key=str)
    texts = [(i, t) for i, t, _ in got]
    assert sorted(texts, key=str) == sorted([(1, one), (5, two), (5, three), (8, None), (9, ""), (None, two), (None, two)], key=str)
    assert (5, three, 0) in got  # of the equal rows, the one that comes first
    assert stages.identify_language(spark, docs.limit(0), FOLDER).collect() == []
    for stage in (stages.drop_lines, stages.one_per_group, stages.drop_benchmark):
        empty_out = stage(spark, docs.limit(0), FOLDER)
        assert empty_out.columns == docs.columns and empty_out.collect() == []
