import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmill.operators import experiments as X
from talkmill.operators import learned as L

PROPOSAL = "segment_id string, proposal_order int, text string, sources array<int>, fact_type string, state_status string"


def decide(reject=()):
    def ground(facts):
        return facts.where(F.col("text") != "no answer").select("segment_id", "proposal_order", F.when(F.col("text").isin(*reject, "-"), "REJECT").otherwise("ACCEPT").alias("decision"), F.lit(True).alias("entailed"), F.lit(True).alias("atomic"), F.lit(True).alias("sufficient"), F.lit(False).alias("external"), F.lit(None).cast("string").alias("duplicate_of"))

    return ground


def test_reference_facts_are_grounded_completed_deduplicated_and_ranked(spark):
    segments = spark.createDataFrame([("s", [1, 2, 3]), ("t", [4])], "segment_id string, turns array<int>")
    first = spark.createDataFrame([("s", 0, "Likes tea.", [2], "preference", "current"), ("s", 1, "likes  TEA", [2], "preference", "current"), ("s", 2, "Outside", [9], "event", "current"), ("s", 3, "bad", [1], "event", "current"), ("s", 4, "no answer", [1], "event", "current"), ("t", 0, "Left", [4], "odd", None)], PROPOSAL)
    more = spark.createDataFrame([("s", 0, "Went home", [3, 1], "event", "historical"), ("s", 1, "likes tea", [2], "preference", "current")], PROPOSAL)
    got = X.reference_facts(segments, lambda s: first, decide(["bad"]), lambda kept: more, ["event", "preference"]).orderBy("segment_id", "rank").collect()
    assert [(r["segment_id"], r["text"], r["fact_type"], r["state_status"], r["origin"], r["rank"]) for r in got] == [("s", "Went home", "event", "historical", "coverage", 1), ("s", "Likes tea.", "preference", "current", "initial", 2), ("t", "Left", "other", "unspecified", "initial", 1)]
    assert got[0]["sources"] == [1, 3] and len({r["reference_fact_id"] for r in got}) == 3


def corpus(spark, manifests=(("c", "a", "r1", "complete", True), ("c", "b", "r2", "complete", True)), facts=(("f1", "r1", "m", "s", [1], "h"), ("f2", "r2", "m", "s", [2], "h"))):
    return X.corpus(
        spark.createDataFrame(list(manifests), "campaign_id string, sample_id string, run_id string, status string, reconciled boolean"), spark.createDataFrame(list(facts), "fact_id string, run_id string, model_id string, segment_id string, sources array<int>, content_hash string"),
        spark.createDataFrame([("s", [1, 2], "h")], "segment_id string, turns array<int>, segment_hash string"), spark.createDataFrame([("a",), ("b",)], "sample_id string"),
    )


def test_a_corpus_is_whole_or_raises(spark):
    assert corpus(spark).count() == 2
    a, b = ("c", "a", "r1", "complete", True), ("c", "b", "r2", "complete", True)
    f, g = ("f1", "r1", "m", "s", [1], "h"), ("f2", "r2", "m", "s", [2], "h")
    for kw, why in (({"manifests": [a, ("c", "b", "r2", "running", True)]}, "not complete"), ({"manifests": [a]}, "lacks samples|missing"), ({"manifests": [a, b, ("d", "a", "r3", "complete", True), ("d", "b", "r4", "complete", True)], "facts": [f, ("f3", "r3", "m", "s", [1], "h")]}, "several campaigns"),
                    ({"facts": [f, f]}, "repeated"), ({"facts": [f, (*g[:4], [7], "h")]}, "outside"), ({"facts": [(*f[:5], "other")]}, "outside")):
        with pytest.raises(Exception, match=why):
            corpus(spark, **kw).collect()


def test_questions_are_answered_once(spark):
    q = spark.createDataFrame([(1, "a", "who", [1.0, 0.0]), (2, "a", "what", [0.0, 1.0]), (3, "b", "none", [1.0, 0.0])], "question_id int, sample_id string, question string, q array<double>")
    p = spark.createDataFrame([(1, "a", [1.0, 0.1], "Ann"), (2, "a", [0.1, 1.0], "tea")], "point_id int, sample_id string, v array<double>, line string")
    reader = lambda d: d.select("question_id", F.col("memories").alias("answer"))
    judge = lambda d: d.select("question_id", F.when(F.col("answer") == "Ann", '{"label": "CORRECT"}').when(F.col("answer") == "tea", '{"label": "WRONG"}').alias("label"))
    done = X.answered(q, p, reader, judge, 1)
    assert {r["question_id"]: (r["answer"], r["correct"]) for r in done.collect()} == {1: ("Ann", True), 2: ("tea", False), 3: ("(no retrieved memories)", None)}
    never = lambda d: d.select("question_id", F.raise_error(F.lit("asked again")).cast("string").alias("answer"))
    assert X.answered(q, p, never, judge, 1, done).count() == 3


def test_memories_by_speaker(spark):
    m = spark.createDataFrame([(1, 2, "t", "", "x", "Bob", "Ann", "Bob"), (1, 1, None, None, "y", "", "Ann", "Bob"), (2, 1, "t", "Mon", "Bob ran", None, "Ann", "Bob")], "question_id int, rank int, ts string, weekday string, fact string, source string, a string, b string")
    assert {r["question_id"]: (r["first"], r["second"]) for r in X.speaker_memories(m, "a", "b").collect()} == {1: ("y", "[t] x"), 2: ("(none)", "[t, Mon] Bob ran")}


def test_judging_asks_again_only_what_failed(spark):
    tasks = spark.createDataFrame([("s", [("A", [])], []), ("t", [("A", [])], [])], "segment_id string, sets array<struct<set_id:string,candidate_ids:array<string>>>, gold array<string>")
    say = lambda name: json.dumps({"segment_id": name, "candidate_set_results": [{"set_id": "A", "candidate_assessments": [], "gold_fact_assessments": []}]})
    first = X.judged(tasks, lambda d: d.select("segment_id", F.lit(say("s")).alias("content")))
    assert {r["segment_id"]: r["error"] for r in first.collect()} == {"s": None, "t": "segment_id mismatch"}
    again = X.judged(tasks, lambda d: d.select("segment_id", F.when(F.col("segment_id") == "t", say("t")).alias("content")), first)
    assert {r["segment_id"]: r["error"] for r in again.collect()} == {"s": None, "t": None}


def test_training_rows(spark):
    labels = spark.createDataFrame([("a", "s", "m", 0.5), ("b", "t", "m", 1.0)], "sample_id string, segment_id string, model_id string, quality double")
    features = spark.createDataFrame([("a", "s", [1.0]), ("b", "t", [2.0])], "sample_id string, segment_id string, vector array<float>")
    profiles, held = spark.createDataFrame([("m", [0.1, 0.2])], "model_id string, dimensions array<double>"), spark.createDataFrame([("b",)], "sample_id string")
    key = ["sample_id", "segment_id"]
    got = X.training_rows(labels, features, profiles, key, "sample_id", held).orderBy("sample_id").collect()
    assert [(r["features"], r["held_out"]) for r in got] == [([1.0, 0.1, 0.2], False), ([2.0, 0.1, 0.2], True)]
    with pytest.raises(Exception, match="profile"):
        X.training_rows(labels, features, profiles.where("false"), key, "sample_id", held).collect()


def test_policy_training_keeps_the_best_epoch_within_the_budget():
    told = iter([(0.9, 3.0), (0.5, 1.0), (0.5, 0.5), (0.6, 2.5), (0.4, 0.1), (0.4, 0.1)])
    trainer = L.ActorCritic(L.Network.new([2, 4]), budget=2.0)
    net, history = X.trained_policy(trainer, [(np.ones((3, 2)), lambda t: (0.5, 1.0))], lambda n: next(told), 10, 3)
    assert [h["best"] for h in history] == [False, True, True, False, False, False] and net is not None


def test_folds_of_an_experiment(spark):
    folds = spark.createDataFrame([(0, "a", "test"), (0, "b", "train"), (1, "a", "train"), (1, "b", "test")], "fold int, sample_id string, part string")
    run = lambda i, m: m.where("part = 'test'").select("sample_id", F.lit(i == 0).alias("correct"), F.lit("m1").alias("model"))
    row = X.cross_validated(folds, 2, run, "e", ["model"]).first()
    assert (row["n_folds"], row["mean"]) == (2, 0.5)
    with pytest.raises(Exception, match="not held out"):
        X.cross_validated(folds, 2, lambda i, m: m.select("sample_id", F.lit(True).alias("correct"), F.lit("m1").alias("model")), "e", ["model"]).collect()
