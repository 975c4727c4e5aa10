import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from talkmill.operators import joins as J
from talkmill.operators import ordered as O
from talkmill.sources import conversations as C
from talkmill.sources import stores as S
from talkmill.streaming.ledger import append_stream


def test_locomo(spark):
    talk = {"speaker_a": "A", "session_1_date_time": "1:56 pm on 8 May, 2023", "session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "hi", "blip_caption": "a cat"}], "session_2_date_time": "1:00 pm on 9 May, 2023", "session_10": [{"speaker": "B", "dia_id": "D10:1", "text": "yes"}], "session_10_date_time": "never"}
    rows = C.locomo_turns(spark.createDataFrame([("s", json.dumps(talk))], "sample_id string, conversation string")).orderBy("turn_id").collect()
    assert [(r["session_no"], r["turn_id"], r["text"]) for r in rows] == [(1, 1, "hi (image description: a cat)"), (10, 2, "yes")]
    assert (rows[0]["session_time"], rows[0]["weekday"], rows[1]["session_time"]) == ("2023-05-08T13:56:00.000", "Mon", "never")


def test_longmemeval(spark):
    schema = "question_id string, question_type string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<struct<role:string,content:string>>>"
    r = spark.createDataFrame([("q_abs", "temporal-reasoning", ["x"], ["2023/05/20 (Sat) 02:21"], [[("user", "a"), ("assistant", "b")]])], schema)
    got = C.longmemeval_turns(r).orderBy("turn_id").collect()
    assert [(t["turn_id"], t["role"], t["session_time"], t["weekday"]) for t in got] == [(1, "user", "2023-05-20T02:21:00.000", "Sat"), (2, "assistant", "2023-05-20T02:21:00.000", "Sat")]
    assert C.questions(r).first()["is_unanswerable"]


def test_reading_wrapped_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"records": [{"x": 1}, {"x": 2}]}')
    (tmp_path / "b.json").write_text('[{"x": 3}]')
    (tmp_path / "c.jsonl").write_text('{"x": 4}\n\n[1]\n{"x": 5}\n')
    read = lambda n: sorted(r["x"] for r in C.read_records(spark, str(tmp_path / n), "x int").collect())
    assert read("a.json") == [1, 2] and read("b.json") == [3] and read("c.jsonl") == [4, 5]


def test_chat_text_and_split(spark):
    sse = 'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: {"choices":[{"delta":{"content":"b"}}]}\ndata: [DONE]'
    d = spark.createDataFrame([(sse, "x/my_valid-1.jsonl"), ('{"choices":[{"message":{"content":"c"}}]}', "contest.json")], "r string, p string")
    got = d.select(C.chat_text(d.r).alias("t"), C.split_of(d.p).alias("s")).collect()
    assert [tuple(r) for r in got] == [("ab", "val"), ("c", None)]


def test_tables_and_stream(spark, tmp_path):
    t = spark.createDataFrame([("a", 1, 0, "x"), ("a", 2, 0, "y"), ("b", 1, 0, "z")], "sample_id string, session_no int, offset int, text string")
    assert tuple(C.write_tables(C.with_running_ids(t), str(tmp_path / "out")).first()) == (2, 3, 3)
    C.write_csv(t, str(tmp_path / "csv"))
    source = str(tmp_path / "in")
    for _ in range(2):
        t.write.mode("append").parquet(source)
        append_stream(spark.readStream.schema(t.schema).parquet(source), str(tmp_path / "ledger"), str(tmp_path / "cp"), ["sample_id", "session_no"], ["offset"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 3


def test_an_assembly_is_stored_whole_or_not_at_all(spark, tmp_path):
    routes = spark.createDataFrame([("s1", "small"), ("s2", "large"), ("s3", "small")], "segment_id string, tier string")
    points = spark.createDataFrame([("s1", "small", "p1", "r"), ("s1", "large", "p2", "r"), ("s2", "large", "p3", None)], "segment_id string, tier string, point_id string, extraction_run_id string")
    made = J.stamped(routes, points, "segment_id", "point_id", "asm", "ep", "v1")
    rows = {r.source_point_id: r for r in made.collect()}
    assert set(rows) == {"p1", "p3"} and rows["p3"].source_extraction_run_id == ""
    assert rows["p1"].point_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "asm:small:p1"))
    ledger = S.store_assembly(routes, made, str(tmp_path / "good"), "segment_id").collect()
    assert {(r.segment_id, r.status, r.point_count) for r in ledger} == {(s, "ready", 2) for s in ("s1", "s2", "s3")}
    wrong = made.withColumn("source_collection_tier", F.lit("small"))
    ledger = S.store_assembly(routes, wrong, str(tmp_path / "bad"), "segment_id").collect()
    assert {r.status for r in ledger} == {"failed"} and (tmp_path / "good").exists() and not (tmp_path / "bad").exists()
    assert S.store_assembly(routes, made.limit(0), str(tmp_path / "none"), "segment_id").first().status == "ready"


def test_upserts_keep_tiers_apart(spark):
    fact = lambda *rows: spark.createDataFrame(rows, "fact_id string, memory_tier string, text string")
    store = fact(("a", "small", "old"), ("b", "small", "kept"))
    got = S.upserted(store, fact(("a", "small", "new"), ("c", "small", "more")), "small")
    assert sorted((r.fact_id, r.text) for r in got.collect()) == [("a", "new"), ("b", "kept"), ("c", "more")]
    for bad in (fact(("a", "large", "x")), fact(("a", "small", "x"), ("a", "small", "y"))):
        with pytest.raises(Exception, match="fact"):
            S.upserted(store, bad, "small").collect()
    with pytest.raises(ValueError, match="frozen"):
        S.upserted(store, store, "small", frozen=True)


def test_a_split_has_a_manifest(spark, tmp_path):
    raw = tmp_path / "raw.json"
    raw.write_text("[]")
    turns = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "sample_id string, session_no int, text string")
    questions = C.questions_of(spark.createDataFrame([("a", '["why?", "who?"]')], "id string, items string"), "id", "items")
    m = C.write_split(turns, questions, str(tmp_path / "out"), "d", "test", [str(raw)], {"by": "hand"}).first()
    assert (m.num_samples, m.num_questions, m.num_sessions, m.num_turns, m.layout_version, m.metadata.by) == (1, 2, 2, 2, 3, "hand")
    assert [f.sha256 for f in m.source_file_hashes] == [hashlib.sha256(b"[]").hexdigest()]
    assert spark.read.parquet(m.tables.questions).count() == 2


def test_a_run_with_an_item_twice_raises(spark):
    rows = spark.createDataFrame([(1, "r", 0, 1), (1, "r", 0, 2)], "scope int, run string, item int, seq int")
    with pytest.raises(Exception, match="repeated"):
        O.latest_run(rows, "scope", "run", ["item"], "seq", rows).collect()
