import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import manifest
from corpusloom.sources import manifests, reports, settings
from corpusloom.streaming import streams

HEAD = ",".join(manifest.COLUMNS)


def write(tmp_path, *lines, head=HEAD):
    p = tmp_path / "manifest.csv"
    p.write_text("\n".join([head, *lines]) + "\n", encoding="utf-8-sig")
    return str(p)


GOOD = "guide-a,a.pdf,Guide A,,1.10,R2024x,,all,true,installation,10/8/2026,"


def test_load_manifest(spark, tmp_path):
    got = manifests.load(spark, write(tmp_path, GOOD, ",,,,,,,,,,,", "guide-b,b.pdf,Guide B,guide-a,1.9,,,internal;x,no,upgrade,,")).orderBy("line").collect()
    assert [(r.line, r.doc_id, r.is_latest, r.added) for r in got] == [(2, "guide-a", True, "2026-10-08"), (4, "guide-b", False, "")]


def test_all_problems_are_raised_at_once(spark, tmp_path):
    with pytest.raises(manifests.ManifestError) as e:
        manifests.load(spark, write(tmp_path, GOOD, GOOD, "x,b.txt,,,one,,,,maybe,none,,"))
    assert len(e.value.problems) >= 6 and "duplicate doc_id 'guide-a' (first on line 2)" in str(e.value)


def test_header_must_match(spark, tmp_path):
    with pytest.raises(manifests.ManifestError):
        manifests.read_rows(spark, write(tmp_path, "a,b", head="doc_id,other"))
    legacy = manifests.read_rows(spark, write(tmp_path, "g,a.pdf,T,,1.0,,,all,true,upgrade", head=",".join(manifest.LEGACY_COLUMNS)))
    assert legacy.first().review == ""


def test_folder_and_hashes(spark, tmp_path):
    for name, data in {"a.pdf": b"1", "sub/b.DOCX": b"1", "c.txt": b"2"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = manifests.folder(spark, str(tmp_path), hashes=True).orderBy("path").collect()
    assert [r.path for r in rows] == ["a.pdf", "sub/b.DOCX"] and rows[0].content_hash == rows[1].content_hash


def test_work_left_to_parse(spark):
    docs = spark.createDataFrame([("a", "h1"), ("b", "h2")], "doc_id string, content_hash string")
    done = spark.createDataFrame([("a", "h1", 2), ("b", "old", 2)], "doc_id string, content_hash string, parser_version int")
    assert [r.doc_id for r in manifests.to_parse(docs, done, 2).collect()] == ["b"]
    assert manifests.to_parse(docs, done, 3).count() == 2


def test_reports_are_scored_by_todays_questions(spark, tmp_path):
    g = tmp_path / "golden.json"
    g.write_text(json.dumps([{"id": "q1", "type": "lookup", "must_include": ["Port 80"], "status": "reviewed", "sources": []}, {"id": "q2", "type": "unanswerable", "status": "draft"}]))
    for name, model, llm in (("answers-1.json", None, "m"), ("answers-2.json", "profile", "m")):
        (tmp_path / name).write_text(json.dumps({"config": {"answer_model": model, "llm_model": llm, "not_found_score": 0.2}, "questions": [{"qid": "q1", "status": "answered", "answer": "It is **port 80**", "top_score": 0.5}]}))
    golden = reports.golden(spark, str(g))
    out = reports.reports(spark, str(tmp_path / "answers-*.json"), golden)
    assert [(r.good, r.threshold) for r in out.collect()] == [(True, 0.2)] * 2
    assert [r.model for r in reports.latest(out, golden).collect()] == ["profile"]
    assert reports.golden(spark, str(g), ["q2"]).count() == 1


def test_settings_report_all_problems(spark):
    with pytest.raises(settings.SettingsError) as e:
        settings.domain({"boilerplate": ["("], "other": []})
    assert len(e.value.problems) == 2
    with pytest.raises(settings.SettingsError):
        settings.catalogue({"models": {"a": {"external": True, "fallback": "a"}}})
    c = settings.catalogue({"models": {"big": {"external": True, "api_key": "K", "fallback": "small"}, "small": {}}})
    assert [p.name for p in c.chain("big")] == ["big", "small"] and c.frame(spark).where("ready").count() == 1
    u = settings.users(spark, {"users": {"ann": {"groups": ["internal", "all"]}, "bo": {}}, "default_user": "bo"})
    got = settings.resolve_user(u, spark.createDataFrame([("1", "ann"), ("2", None), ("3", "who")], "qid string, user_id string"))
    assert {r.qid: r.groups for r in got.collect()} == {"1": ["internal", "all"], "2": ["all"]}


def test_stream_windows_equal_the_batch(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet")
    want = {(r.event_type, r.start, r.n) for r in streams.window_metrics(e).collect()}
    src = tmp_path / "in"
    e.select("event_type", "ts", "value").orderBy("ts").coalesce(1).write.parquet(str(src))
    s = spark.readStream.schema("event_type string, ts timestamp, value double").parquet(str(src))
    q = streams.window_metrics(s).writeStream.format("memory").queryName("m").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.event_type, r.start, r.n) for r in spark.table("m").collect()} == want


def test_sessions_of_events(spark):
    e = spark.sql("SELECT 1 user_id, timestamp'2024-01-01 00:00:00' ts UNION ALL SELECT 1, timestamp'2024-01-01 00:30:00' UNION ALL SELECT 1, timestamp'2024-01-01 03:00:00'")
    assert sorted(r.n for r in streams.session_metrics(e).collect()) == [1, 2]


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, seen = tmp_path / "src", []
    for i in range(2):
        spark.range(i * 10, i * 10 + 10).write.mode("append").parquet(str(src))
        streams.ingest(spark, str(src), "id long", str(tmp_path / "cp"), lambda df, b: seen.append(df.count())).awaitTermination(120)
    assert sum(seen) == 20


def test_sticky_release_as_state(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, "on R2025x"), ("s", 2, "and?"), ("s", 3, "any release"), ("t", 1, "R2024x or R2026x")], "session_id string, turn long, content string")
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "t"))
    q = streams.sticky_release(s).writeStream.format("memory").queryName("st").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.session_id, r.turn): r.release for r in spark.table("st").collect()}
    assert got == {("s", 1): 2025, ("s", 2): 2025, ("s", 3): None, ("t", 1): None}


def test_appended_rows_keep_the_header(spark, tmp_path):
    a = manifests.read_rows(spark, write(tmp_path, GOOD))
    manifests.append_rows(a, a.withColumn("doc_id", F.lit("guide-z")), str(tmp_path / "out"))
    again = spark.read.csv(str(tmp_path / "out"), header=True)
    assert tuple(again.columns) == manifest.COLUMNS and again.count() == 2
