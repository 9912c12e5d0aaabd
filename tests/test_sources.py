import json

import pytest

from wishloom.functions import fixed_values as fv
from wishloom.sources import logs
from wishloom.sources import readers as rd
from wishloom.sources import sinks as sk


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_catalogue_with_bom_alias_and_newline(spark, tmp_path):
    path = put(tmp_path, "c.csv", "﻿filterId,filterName,optionId,optionName,synonyms\nf,Fac,wifi, Wi-Fi ,\"wifi|\n free wifi ||\"\nf,Other,pool,Pool,\n")
    rows = rd.read_catalogue(spark, path).orderBy("option_ord").collect()
    assert [(r["option_id"], r["option_label"], r["filter_label"], list(r["synonyms"])) for r in rows] == [
        ("wifi", "Wi-Fi", "Fac", ["wifi", "free wifi"]), ("pool", "Pool", "Fac", [])]


@pytest.mark.parametrize("body,message", [
    ("filterId,filterLabel,optionId\na,b,c\n", "missing required columns: optionLabel"),
    ("filterId,filterLabel,optionId,optionLabel\n", "empty"),
    ("filterId,filterLabel,optionId,optionLabel\na,b,c,d\na,b,C,e\n", "Duplicate option identifier"),
    ("filterId,filterLabel,optionId,optionLabel\na, ,c,d\n", "must not be empty")])
def test_catalogue_rejections(spark, tmp_path, body, message):
    with pytest.raises(Exception, match=message):
        rd.read_catalogue(spark, put(tmp_path, "bad.csv", body)).collect()


def test_bookings(spark, tmp_path):
    path = put(tmp_path, "b.csv", "﻿timestamp,duration,adults,children,infants,startDepartureDate,endDepartureDate,from,rooms,to\n"
               "t,11,2,1,1,2/19/2026,2/19/26,Charleroi,0,\"Kenya, Costa\nRica,, \"\nt,x,,,,2026-3-1,never,,1,\n")
    a, b = rd.read_bookings(spark, path).orderBy("ord").collect()
    assert (a["duration"], a["adults"], a["start_date"], a["end_date"], list(a["destinations"])) == (11, 2, "2026-02-19", "2026-02-19", ["Kenya", "Costa Rica"])
    assert (b["duration"], b["adults"], b["start_date"], b["end_date"], b["airport"], b["rooms"]) == (None, 0, "2026-03-01", None, None, 1)


def test_json_sources(spark, tmp_path):
    entities = put(tmp_path, "e.json", json.dumps({"data": {"airports": [{"id": " AMS", "name": "Amsterdam ", "available": True}]}}))
    assert rd.read_entities(spark, entities, "airports").first()["id"] == "AMS"
    for name, entries, said in [("e1", [{"id": "A", "name": " "}], "required fields: name"), ("e3", [{"id": "A", "name": "x"}, {"id": "A ", "name": "y"}], "Duplicate identifier 'A'"),
                                ("e4", [{"id": "A", "name": "x"}, {"id": "B", "name": "X "}], "Duplicate name 'x'")]:
        with pytest.raises(ValueError, match=said):
            rd.read_entities(spark, put(tmp_path, f"{name}.json", json.dumps({"data": {"airports": entries}})), "airports")
    cal = put(tmp_path, "d.json", json.dumps({"data": {"checkIns": [{"date": "10-01-2026"}, {"date": "09-10-2025"}]}}))
    assert [str(r["d"]) for r in rd.read_calendar(spark, cal).collect()] == ["2025-10-09", "2026-01-10"]
    bad = put(tmp_path, "bad.json", json.dumps({"data": {"checkIns": [{"date": "2026-01-10"}]}}))
    with pytest.raises(Exception, match="DD-MM-YYYY"):
        rd.read_calendar(spark, bad).collect()
    batch = put(tmp_path, "r.json", json.dumps(["  a trip ", {"text": "b", "mode": "preferences"}, {"method": "x"}]))
    rows = rd.read_request_batch(spark, batch, default_method="rules").orderBy("pos").collect()
    assert [(r["text"], r["mode"], r["method"]) for r in rows[:2]] == [("a trip", None, "rules"), ("b", "preferences", "rules")]
    assert rows[2]["request_error"] == "Batch entries must include a 'text' field"
    lexicon = put(tmp_path, "l.json", json.dumps([{"id": "x", "filterId": "f", "filterName": "F", "optionId": "o", "optionName": "O", "synonyms": [" a ", ""]}]))
    r = rd.read_lexicon(spark, lexicon).first()
    assert (r["record_id"], list(r["synonyms"])) == ("x", ["a"])
    vectors = put(tmp_path, "v.jsonl", '{"embedding":[1,2],"option_ids":["a"]}\n\n{"option_ids":["b"]}\n{"embedding":[]}\n')
    assert rd.read_embeddings(spark, vectors).count() == 1


def test_audit_log_header(spark, tmp_path):
    df = spark.sql("select timestamp'2026-01-02 03:04:05' ts, 'hi, \"you\"' text, 'Text' request_type, 'm' method, 'x' mode, 'success' status, "
                   "map('languageMs', 1.5D, 'total', 20D) timings, 'en' language, 0.93D confidence, named_struct('a', 1) output")
    out = str(tmp_path / "log")
    sk.write_audit_log(sk.audit_rows(df), out)
    lines = "".join(p.read_text() for p in sorted((tmp_path / "log").glob("*.csv"))).splitlines()
    assert lines[0].split(",") == fv.AUDIT_LOG_HEADER
    assert "en (0.93)" in lines[1] and ",20.00," in lines[1] and "Success" in lines[1]


def test_file_digest(spark, tmp_path):
    import hashlib

    path = put(tmp_path, "x.txt", "abc")
    assert tuple(logs.file_digest(spark, path).first()) == (path, hashlib.sha256(b"abc").hexdigest(), 3)
    folder = tmp_path / "many"
    (folder / "k=a").mkdir(parents=True)
    big = bytes(range(256)) * 40_000  # more than one chunk
    for name, content in (("k=a/x", big), ("y", b""), ("_hidden", b"h"), ("k=a/.x.crc", b"c")):
        (folder / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.sha256, r.length) for r in logs.file_digest(spark, str(folder)).collect()}
    assert got == {"x": (hashlib.sha256(big).hexdigest(), len(big)), "y": (hashlib.sha256(b"").hexdigest(), 0)}


def test_log_appends_whole_files_under_one_header(spark, tmp_path):
    out, header = str(tmp_path / "log"), ["a", "b", "a"]
    rows = [(f"x{i}", 'say "hi",\nthen' if i % 3 else None, str(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "p string, q string, r string").repartition(3)
    for _ in range(2):
        logs.append_log(df, out, header)
    assert logs.log_header(out) == header
    back = logs.read_log(spark, out, ["p", "q", "r"]).collect()
    assert sorted(map(tuple, back)) == sorted([(p, q or "", r) for p, q, r in rows] * 2)
    whole = "".join(p.read_text() for p in sorted((tmp_path / "log").glob("*.csv")))
    assert whole.count("a,b,a\n") == 1 and whole.startswith("a,b,a\n")
    assert not list((tmp_path / "log").glob("_staged*"))
    logs.append_log(df.limit(0), out, header)
    assert logs.read_log(spark, out, ["p", "q", "r"]).count() == 100
    with pytest.raises(Exception, match="header has 2 names"):
        logs.append_log(df, out, ["a", "b"])


def test_log_of_a_failed_job_shows_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    out = str(tmp_path / "log")
    logs.append_log(spark.createDataFrame([("kept",)], "p string"), out, ["p"])
    bad = spark.range(40, numPartitions=4).select(F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("p"))
    with pytest.raises(Exception, match="lost"):
        logs.append_log(bad, out, ["p"])
    assert [r.p for r in logs.read_log(spark, out, ["p"]).collect()] == ["kept"]


def test_streamed_log_takes_a_batch_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    df = spark.createDataFrame([(str(i),) for i in range(20)], "p string")
    df.repartition(2).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        logs.stream_log(spark.readStream.schema("p string").parquet(source), out, ["p"], state).awaitTermination()
    assert sorted(int(r.p) for r in logs.read_log(spark, out, ["p"]).collect()) == list(range(20))
    df.limit(1).write.mode("append").parquet(source)
    logs.stream_log(spark.readStream.schema("p string").parquet(source), out, ["p"], state).awaitTermination()
    assert logs.read_log(spark, out, ["p"]).count() == 21 and logs.log_header(out) == ["p"]


def test_operations_of_many_runs_take_few_folders(spark, tmp_path):
    out = str(tmp_path / "operations")
    rows = [(i, f"{i % 300:04d}" if i % 301 else None, "success") for i in range(1500)] + [(9000 + i, "0007", "failed") for i in range(50)] + [(9999, "", "error")] * 2
    df = spark.createDataFrame(rows, "op_id long, run_id string, status string").repartition(5)
    sk.persist_operations(df, out)
    folders = [p for p in (tmp_path / "operations").iterdir() if p.is_dir()]
    assert len(folders) <= sk.OPERATION_BUCKETS < 300  # not one for every run
    assert len(list((tmp_path / "operations").rglob("*.parquet"))) <= 2 * sk.OPERATION_BUCKETS
    back = rd.read_operations(spark, out)
    assert back.schema["run_id"].dataType == df.schema["run_id"].dataType  # a run named 0007 stays text, an empty one stays empty
    order = lambda r: tuple(map(str, r))
    assert sorted(((r.op_id, r.run_id, r.status) for r in back.collect()), key=order) == sorted(rows, key=order)
    one = rd.read_operations(spark, out, "0007")
    assert sorted(r.op_id for r in one.collect()) == sorted(r[0] for r in rows if r[1] == "0007")
    assert len({r[0].rsplit("/", 2)[1] for r in one.selectExpr("_metadata.file_path").collect()}) == 1
    # a second submission is appended
    sk.persist_operations(df.where("run_id = '0007'"), out)
    assert rd.read_operations(spark, out).count() == len(rows) + 55
    numbers = str(tmp_path / "numbers")
    sk.persist_operations(spark.range(500).selectExpr("id as op_id", "id % 100 as run_id", "'success' as status"), numbers)
    assert rd.read_operations(spark, numbers, 7).count() == 5 and spark.read.parquet(numbers).schema["run_id"].dataType.typeName() == "long"
