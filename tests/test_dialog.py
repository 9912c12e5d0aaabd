import pytest

from wishloom.operators import dialog as dg
from wishloom.plans.scale import scratch_folder
from wishloom.streaming import feeds, sessions

SCHEMA = ("session string, turn long, role string, text string, language string, from_codes array<string>, to_ids array<string>, "
          "departure_dates array<string>, duration_id string, adults int, non_adults int, rooms int")
ROWS = [("s", 0, "user", "a", "en", ["AMS"], [], [], "2010", None, None, 2), ("s", 1, "user", "b", None, ["AMS", "BRU"], ["d1"], [], None, 3, 1, None),
        ("s", 2, "user", "c", "nl", [], ["d2", "d1"], ["2026-01-02"], "", None, None, None), ("u", 0, "user", "x", "en", [], [], [], None, None, None, None)]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_fold_and_outcome(turns):
    got = {r["session"]: r for r in dg.outcome(dg.fold(turns)).collect()}
    s = got["s"]
    assert (list(s["from_codes"]), list(s["to_ids"]), list(s["departure_dates"])) == (["AMS", "BRU"], ["d1", "d2"], ["2026-01-02"])
    assert (s["duration_id"], s["party"]["adults"], s["rooms"], s["language"], s["status"]) == ("2010", 3, 2, "nl", "success")
    assert got["u"]["status"] == "clarification" and got["u"]["prompt"]["parameter"] == "departureDate"


def test_defaults_override(turns):
    s = {r["session"]: r for r in dg.fold(turns, defaults_override=True).collect()}["s"]
    assert (s["duration_id"], s["party"]["adults"], s["rooms"]) == ("2007", 2, 1)


def test_stream_equals_batch_and_rejects_gaps(spark, turns):
    folder, out, state = (scratch_folder(spark, n) for n in ("turns", "out", "state"))
    extra = spark.createDataFrame([("u", 2, "user", "late", None, ["ZZZ"], [], [], None, None, None, None)], SCHEMA)
    turns.unionByName(extra).coalesce(1).write.parquet(folder)
    feed = feeds.request_feed(spark, folder, turns.schema)
    feeds.append_log(sessions.fold_stream(feed, ttl=None), out, state).awaitTermination()
    rows = {(r["session"], r["turn"]): r for r in spark.read.parquet(out).collect()}
    batch = {r["session"]: r for r in dg.fold(turns).collect()}["s"]
    final = rows["s", 2]
    assert final["to_ids"] == ",".join(batch["to_ids"]) and final["duration_id"] == batch["duration_id"] and final["rooms"] == batch["rooms"]
    assert rows["u", 2]["accepted"] is False and "expected turn 1" in rows["u", 2]["reason"]


def test_turn_metadata(turns):
    got = {(r["session"], r["turn"]): (r["user_turn"], r["transcript_length"], list(r["missing_parameters"])) for r in dg.turn_metadata(turns).collect()}
    assert got["s", 2] == (3, 3, []) and got["s", 0][2] == ["departureDate", "to"]


@pytest.mark.parametrize("chunk_turns", [1, 7, 1000])
def test_transcript_of_any_turn(spark, chunk_turns):
    rows = [(s, n * 2, "user" if n % 3 else "system", f"{s} says {n}") for s, size in (("long", 300), ("one", 1), ("few", 8)) for n in range(size)]
    df = spark.createDataFrame(rows, "session string, turn long, role string, text string").repartition(5)
    chunks, pointers = dg.transcripts(df, chunk_turns)
    assert chunks.selectExpr("sum(size(entries))").first()[0] == len(rows) == pointers.count()  # linear: every turn is kept once
    assert chunks.selectExpr("max(size(entries))").first()[0] <= chunk_turns
    asked = pointers.where("turn in (0, 6, 14, 298, 598)")
    got = {}
    for r in dg.transcript_entries(chunks, asked).collect():
        got.setdefault((r.session, r.turn), []).append((r.said, r.role, r.text))
    assert len(got) == 9
    for (session, turn), said in got.items():
        assert sorted(said) == [(n, role, text) for s, n, role, text in rows if s == session and n <= turn]


def _until(ready, seconds=60):
    import time

    for _ in range(seconds * 4):
        if ready():
            return True
        time.sleep(0.25)
    return False


def test_early_turns_wait_across_batches_and_end_with_the_session(spark, turns):
    def turn(session, n):
        return (session, n, "user", "t", "en", [f"A{n}"], [], [], None, None, None, None)
    folder, out, state = (scratch_folder(spark, n) for n in ("early", "early-out", "early-state"))
    for batch in ([turn("z", 2), turn("z", 3), turn("lost", 5)], [turn("z", 1), turn("z", 3)], [turn("z", 0)]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    feed = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    running = sessions.fold_stream(feed, ttl="4 seconds").writeStream.option("checkpointLocation", state).format("parquet").option("path", out).start()

    def rows():
        return [(r.session, r.turn, r.accepted, r.from_codes, r.reason) for r in spark.read.schema(sessions.OUTPUT).parquet(out).collect()]

    try:
        assert _until(lambda: any(r[0] == "lost" for r in rows()) and sum(r[0] == "z" for r in rows()) >= 5)
    finally:
        running.stop()
    got = rows()
    assert sorted(r[:4] for r in got if r[0] == "z" and r[2]) == [("z", n, True, ",".join(f"A{i}" for i in range(n + 1))) for n in range(4)]
    assert [r[4] for r in got if r[0] == "lost"] == ["expected turn 0"] and ("z", 3, False, None, "expected turn 0") in got


@pytest.mark.parametrize("chunk", ["2", "10000"])
def test_stream_does_not_depend_on_arrival(spark, turns, chunk):
    def turn(n):
        return ("z", n, "user", "t", "en", [f"A{n}"], [], [], None, None, None, None)
    folder, out, state = (scratch_folder(spark, n) for n in ("arrival", "arrival-out", "arrival-state"))
    spark.createDataFrame([turn(n) for n in (2, 3, 0, 1, 4, 5, 5)], SCHEMA).coalesce(1).write.parquet(folder)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", chunk)
    try:
        feed = spark.readStream.schema(turns.schema).parquet(folder)
        feeds.append_log(sessions.fold_stream(feed, ttl=None), out, state).awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = sorted((r.turn, r.accepted, r.from_codes) for r in spark.read.parquet(out).collect() if r.accepted)
    assert got == [(n, True, ",".join(f"A{i}" for i in range(n + 1))) for n in range(6)]
    assert spark.read.parquet(out).where("not accepted").count() == 1


@pytest.fixture(scope="module")
def many_files(spark):
    """A conversations table of 130 files, later turns in earlier files, more files than one trigger takes."""
    from pathlib import Path

    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = Path(scratch_folder(spark, "tables").removeprefix("file:"))
    rows = [(c, n) for n in reversed(range(13)) for c in range(10) if (c, n) != (4, 5)]
    (folder / "conversations.parquet").mkdir(parents=True)
    for i, (c, n) in enumerate(rows):
        pq.write_table(pa.table({"conv_id": pa.array([c], "int64"), "turn": pa.array([n], "int64"), "role": ["user" if n % 2 else "system"],
                                 "text": [f" says {n} "]}), folder / "conversations.parquet" / f"part-{i:04d}.parquet")
    return str(folder), rows


def test_session_stream_of_a_folder(spark, many_files):
    from workload.registry import QUERIES

    folder, rows = many_files
    got = {(r["session"], r["turn"]): r for r in QUERIES["d1_session_stream"](spark, folder).collect()}
    assert sorted(got) == sorted((str(c), n) for c, n in rows)
    for c, n in rows:
        r = got[str(c), n]
        assert r["accepted"] == (c != 4 or n < 5)
        assert r["reason"] == (None if r["accepted"] else "expected turn 5")
    assert got["1", 12]["from_codes"] == "A1" and got["1", 12]["duration_id"] == "20" + str(10 + 10)


def test_feeds_of_folders_and_files(spark, many_files, tmp_path):
    from workload.registry import QUERIES

    folder, rows = many_files
    (tmp_path / "conversations.parquet").write_bytes(open(f"{folder}/conversations.parquet/part-0003.parquet", "rb").read())
    for at, wanted in ((folder, rows), (str(tmp_path), rows[3:4])):
        got = [(r["conv_id"], r["turn"], r["letters"]) for r in QUERIES["d5_request_feed"](spark, at).collect()]
        assert sorted(got) == sorted((c, n, len(f"says {n}")) for c, n in wanted)
    spark.createDataFrame(
        [(1, 2, "2026-01-01 00:00:00", "view", 1.5, '{"k": 3}'), (3, 2, "2026-01-01 00:00:01", "error", 2.5, "{}")],
        "event_id long, user_id long, ts string, event_type string, value double, props string").repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(map(tuple, QUERIES["d3_request_log"](spark, str(tmp_path)).collect())) == [(1, "view", "success", 30.0), (3, "error", "error", 50.0)]
    assert sum(r["n"] for r in QUERIES["d4_live_counters"](spark, str(tmp_path)).collect()) == 2
