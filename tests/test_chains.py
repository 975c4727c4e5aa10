import itertools
import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmill.functions import records as P
from talkmill.operators import chains as C
from talkmill.operators import learned as L
from talkmill.operators import replies as R
from talkmill.operators import splits as S
from talkmill.sources import conversations as V
from talkmill.sources import stores as ST


def reply(data, ids=("a", "b")):
    return json.dumps({"processed_segment_ids": list(ids), "data": data})


def fact(segment="a", sources=(1,), text="x"):
    return {"segment_id": segment, "source_ids": list(sources), "fact": text}


ALLOWED = {"a": [1, 2], "b": [3]}


def test_facts_that_repeat_become_one_with_all_sources():
    got = R.fact_batch(reply([fact(sources=[2]), fact("b", [3], "y"), fact(sources=[1], text=" x ")]), ALLOWED, 5)
    assert [(f["segment_id"], f["source_ids"], f["fact"]) for f in got] == [("a", [1, 2], "x"), ("b", [3], "y")]


@pytest.mark.parametrize("content, why", [
    (None, "not valid JSON"), ("[]", "object of"), (reply([], ["b", "a"]), "processed_segment_ids must be"), (reply([1]), "data[0]"), (reply([{**fact(), "more": 1}]), "data[0]"),
    (reply([fact("z")]), "unknown segment_id"), (reply([fact(sources=[])]), "non-empty"), (reply([fact(sources=[True])]), "invalid source_id"), (reply([fact(sources=[-1])]), "invalid source_id"),
    (reply([fact(sources=[3])]), "does not belong to segment"), (reply([fact(text=" ")]), "empty fact"), (reply([fact(text=str(i)) for i in range(3)]), "exceeds max_facts_per_segment"), (reply([fact(sources=[9])]), "read-only"),
])
def test_bad_replies_tell_why(content, why):
    with pytest.raises(R.Fault) as e:
        R.fact_batch(content, ALLOWED, 2, [9])
    assert why in str(e.value)


def test_a_reply_for_one_segment_may_name_it_wrongly_once():
    assert R.fact_batch(reply([fact("z")], ["a"]), {"a": [1]}, 2, adopt=True)[0]["segment_id"] == "a"
    with pytest.raises(R.Fault, match="several unknown"):
        R.fact_batch(reply([fact("z"), fact("y")], ["a"]), {"a": [1]}, 2, adopt=True)


def judged(status="SUPPORTED", coverage="FULL", time="PASS", cover=("c1",), gold=True):
    g = [{"gold_fact_id": "g1", "coverage_status": coverage, "time_status": time, "covering_candidate_ids": list(cover), "covered_content": [], "missing_or_incorrect_content": []}]
    c = [{"candidate_id": "c1", "semantic_status": status, "supported_content": [], "unsupported_or_incorrect_content": []}]
    return json.dumps({"segment_id": "s", "candidate_set_results": [{"set_id": "A", "candidate_assessments": c, "gold_fact_assessments": g if gold else []}]})


def test_judgments_tell_all_faults():
    assert R.judgment("```json\n" + judged() + "\n```", "s", {"A": ["c1"]}, ["g1"])[0]["set_id"] == "A"
    for bad, why in ((judged("GOOD", cover=()), "2 faults"), (judged(time="MISSING_REQUIRED_EXACT_TIME"), "exact time"), (judged(cover=("c9",)), "invalid covering"), (judged(gold=False), "missing")):
        with pytest.raises(R.Fault, match=why):
            R.judgment(bad, "s", {"A": ["c1"]}, ["g1"])
    assert R.judgment(judged(), "s", {"A": ["c1"]}, [])[0]["gold_fact_assessments"] == []


def test_judgments_over_rows(spark):
    rows = spark.createDataFrame([("s", judged(), [("A", ["c1"])], ["g1"]), ("t", judged(), [("A", ["c1"])], ["g1"]), ("s", None, [("A", ["c1"])], None)], "segment_id string, content string, sets array<struct<set_id:string,candidate_ids:array<string>>>, gold array<string>")
    got = [(r["results"] is None, r["error"]) for r in R.judgments(rows).collect()]
    assert got[0] == (False, None) and got[1] == (True, "segment_id mismatch") and "JSON" in got[2][1]


def test_corrected_facts_in_json_and_plain_text():
    plain = "1. [event/current] Went home\n来源 Turn: 3，1\n[state/past] Was away\n来源Turn：2\n"
    types, states = ["event", "state"], ["current", "past"]
    got = R.corrected(plain, types, states)
    assert [(g["fact_text"], g["source_turn_ids"], g["fact_type"], g["state_status"]) for g in got] == [("Went home", [1, 3], "event", "current"), ("Was away", [2], "state", "past")]
    assert R.corrected(json.dumps(got), types, states) == got and R.corrected(" [] ", types, states) == R.corrected(None, types, states) == []
    for bad in (plain + "more", "{}", "[1]", '[{"fact_text": "x", "source_turn_ids": [], "fact_type": "event", "state_status": "past"}]', '[{"fact_text": "x", "source_turn_ids": ["q"]}]', plain.replace("event", "other")):
        with pytest.raises(R.Fault):
            R.corrected(bad, types, states)


def test_annotated_text_keeps_numbered_lines_inside_a_turn(spark):
    text = "[t1] 0.Ann: list\n1. one\n[x] 7.Bob: quoted\n[t2, Mon] 1.Bob : yes\n"
    rows = spark.createDataFrame([(text, [1, 2]), (text, [1, 3]), ("no", [1]), (None, None)], "text string, turn_ids array<int>")
    got = [(r["annotated"], r["error"]) for r in R.with_sources(rows).collect()]
    assert got[0] == ("<SOURCE_TURN_ID=1> [t1] Ann: list\n1. one\n[x] 7.Bob: quoted\n<SOURCE_TURN_ID=2> [t2, Mon] Bob: yes", None)
    assert all(a is None and e for a, e in got[1:])


def segments(spark, n=6):
    return spark.createDataFrame([(1, i, f"s{i}", f"text {i}", [i], 10) for i in range(n)], "sample int, segment_order long, segment_id string, text string, ids array<int>, tokens int")


def model(answer):
    """A hook whose answers come from a Python function of the segments' names."""

    def call(prompts):
        def run(batches):
            for pdf in batches:
                names = pdf["prompt"].str.extract(r"exact output order: \[(.*?)\]")[0].str.replace('"', "").str.split(", ")
                told = [answer(n) for n in names]
                yield pdf[["batch_id"]].assign(content=[t[0] for t in told], input_tokens=100, output_tokens=10, truncated=[t[1] for t in told])

        return prompts.mapInPandas(run, "batch_id string, content string, input_tokens long, output_tokens long, truncated boolean")

    return call


def good(names):
    return reply([fact(n, [int(n[1:])], "f " + n) for n in names], names), False


def by_segments(df):
    return {tuple(s["segment_id"] for s in r["segments"]): r for r in df.collect()}


def test_extraction_falls_back_and_recovers_only_as_a_whole(spark):
    def answer(names):
        if len(names) > 1 and "s0" in names:
            return "", True  # cut: each segment is asked alone
        if "s3" in names:
            return (reply([fact("s3", [99])], names), False) if len(names) == 1 else ("no JSON", False)
        return good(names)

    todo = C.batches(segments(spark), ["sample"], 2, 1000)
    got = by_segments(C.extracted(todo, model(answer), None, 5))
    assert {k: r["status"] for k, r in got.items()} == {("s0", "s1"): "recovered_by_fallback", ("s2", "s3"): "failed_terminal", ("s4", "s5"): "committed"}
    assert got["s0", "s1"]["input_tokens"] == 300 and [f["fact"] for f in got["s0", "s1"]["facts"]] == ["f s0", "f s1"]
    assert got["s2", "s3"]["facts"] is None and "does not belong" in got["s2", "s3"]["error"]


def test_faults_of_form_are_repaired_and_costs_conserved(spark):
    todo = C.batches(segments(spark, 3), ["sample"], 3, 1000)
    repair = lambda rows: rows.select("batch_id", F.lit(good(["s0", "s1", "s2"])[0]).alias("content"), F.lit(7).alias("input_tokens"), F.lit(1).alias("output_tokens"), F.lit(False).alias("truncated"))
    done = C.extracted(todo, model(lambda n: ("broken", False)), repair, 5)
    row = done.first()
    assert (row["status"], row["input_tokens"], row["output_tokens"], len(row["facts"])) == ("repaired", 107, 11, 3)
    led = C.segment_ledger(done, 1.0, 2.0).collect()
    assert sum(r["input_tokens"] for r in led) == 107 and sum(r["output_tokens"] for r in led) == 11


def test_compared_and_baseline(spark):
    c = spark.createDataFrame([(1, 1, "A b.", [1]), (1, 2, "a  b", [1]), (1, 3, "z", [2])], "segment int, candidate_id int, text string, sources array<int>")
    r = spark.createDataFrame([(1, 1, "a b", [1, 2]), (2, 2, "q", [1])], "segment int, reference_id int, text string, sources array<int>")
    got = {x["segment"]: x for x in C.compared(c, r, "segment").collect()}
    assert round(got[1]["precision"], 6) == round(1 / 3, 6) and got[1]["recall"] == 1 and got[2]["recall"] == 0
    with pytest.raises(ValueError):
        C.baseline(c, c, "all", "segment")


def test_rounded_targets_keep_both_sums():
    r = np.random.default_rng(3)
    for _ in range(40):
        counts = {f"t{i}": int(n) for i, n in enumerate(r.integers(0, 30, 4))}
        a, b = r.random(2) * 0.5
        n = sum(counts.values())
        sizes = {"x": int(n * a), "y": int(n * b)}
        sizes["z"] = n - sum(sizes.values())
        got = S.rounded_targets(counts, sizes, 1)
        assert all(sum(got[p].values()) == sizes[p] for p in sizes) and all(sum(got[p][t] for p in sizes) == counts[t] for t in counts)
        assert all(v >= 0 for p in got.values() for v in p.values())
    with pytest.raises(ValueError):
        S.rounded_targets({"a": 1}, {"x": 2}, 1)


def test_swaps_reach_what_no_single_swap_betters():
    import pandas as pd

    r = np.random.default_rng(5)
    pdf = pd.DataFrame({"sample_id": range(24), "group_id": [f"g{i // 2}" for i in range(24)], "question_type": "t", "is_unanswerable": r.random(24) < 0.2, "segment_bin": r.choice(["a", "b", "c"], 24)})
    part = S.place(pdf, {"x": 14, "y": 10}, None, 1)
    pdf["part"] = pdf["group_id"].map(part)
    assert pdf.groupby("part").size().to_dict() == {"x": 14, "y": 10} and pdf.groupby("group_id")["part"].nunique().max() == 1

    weights, _ = S.strata(pdf.assign(__g=pd.factorize(pdf["group_id"])[0]))
    share = np.array([14, 10])[:, None] / 24 * weights.sum(0)
    cost = lambda at: sum((((weights[at == p].sum(0) - share[p]) ** 2) / np.maximum(share[p], 1)).sum() for p in (0, 1))
    names = list(dict.fromkeys(pdf["group_id"]))
    at = np.array([int(part[n] == "y") for n in names])
    hard = pdf.groupby("group_id", sort=False)["is_unanswerable"].sum().to_numpy()
    for g, h in itertools.combinations(range(len(names)), 2):
        if at[g] != at[h] and hard[g] == hard[h]:
            other = at.copy()
            other[g], other[h] = at[h], at[g]
            assert cost(other) >= cost(at) - 1e-9
    with pytest.raises(ValueError):
        S.place(pdf, {"x": 13, "y": 11}, None, 1)


def test_swaps_of_many_groups_weigh_profiles():
    """30,000 groups of four profiles: comparing all their pairs took minutes."""
    import time

    r = np.random.default_rng(3)
    weights = np.eye(4)[r.integers(0, 4, 30_000)]
    part_of = (r.random(30_000) < 0.5).astype(int)
    part_of[:200] = weights[:200, 0] > 0  # the first profile is too often in the second part
    total = weights.sum(0)
    held = np.array([weights[part_of == p].sum(0) for p in (0, 1)])
    target = total * (np.bincount(part_of) / len(part_of))[:, None]
    error, before = held - target, np.abs(held - target).sum()
    began = time.time()
    S.swap(part_of, weights, np.ones(len(weights), int), error, target, [f"g{i}" for i in range(len(weights))], 1)
    assert time.time() - began < 30
    now = np.array([weights[part_of == p].sum(0) for p in (0, 1)])
    assert np.abs(now - target).sum() < before and np.allclose(now - target, error) and (now.sum(1) == held.sum(1)).all()


def test_nested_folds_hold_each_sample_out_once(spark):
    rows = spark.range(60).select(F.col("id").alias("sample_id"), F.concat(F.lit("g"), F.expr("id div 2")).alias("group_id"), F.concat(F.lit("t"), F.expr("(id div 2) % 2")).alias("question_type"), (F.col("id") % 15 == 0).alias("is_unanswerable"), F.concat(F.lit("q"), F.col("id") % 3).alias("segment_bin"), F.lit("own").alias("part"))
    got = S.nested_folds(rows, 3, 0.1).toPandas()
    assert len(got) == 180 and (got[got["part"] == "test"]["sample_id"].value_counts() == 1).all() and got[got["part"] == "test"]["sample_id"].nunique() == 60
    assert got.groupby(["fold", "group_id"])["part"].nunique().max() == 1
    assert got.groupby("fold")["part"].value_counts().unstack().to_dict("list") == {"test": [20] * 3, "train": [36] * 3, "validation": [4] * 3}


def test_gradients_match_differences():
    net, r = L.Network.new([3, 5, 2], 1), np.random.default_rng(2)
    x, g = r.normal(size=(4, 3)), r.normal(size=(4, 2))
    z, trace = net.forward(x)
    grads = net.backward(trace, g)
    for i, (w, _) in enumerate(net.layers):
        for at in [(0, 0), (2, 1)]:
            old = w[at]
            w[at] = old + 1e-5
            up = (net.forward(x)[0] * g).sum()
            w[at] = old - 1e-5
            down = (net.forward(x)[0] * g).sum()
            w[at] = old
            assert abs((up - down) / 2e-5 - grads[i][0][at]) < 5e-3
    assert abs(L.erf(np.array([0.5]))[0] - 0.5204998778) < 3e-7


def test_scorer_learns_and_policy_learns_its_budget():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 4))
    y = L.sigmoid(2 * x[:, 0] - x[:, 1])
    fit = L.fit_scorer(x[:500], y[:500], x[500:], y[500:], [16], epochs=40, rate=5e-3, drop=0.0)
    assert fit.error < 0.05 and fit.error == min(e for _, e in fit.history)
    with pytest.raises(ValueError):
        L.fit_scorer(x, y + 1, x, y, [4])
    price, worth = dict(zip(L.TIERS, (1.0, 2.0, 4.0), strict=True)), dict(zip(L.TIERS, (0.2, 0.9, 0.95), strict=True))
    trainer = L.ActorCritic(L.Network.new([4, 8, 4], 3), budget=2.2, rate=2e-2)
    told = [trainer.step(x[:64], lambda t: (float(np.mean([worth[k] for k in t])), float(np.mean([price[k] for k in t])))) for _ in range(150)]
    assert all(t["multiplier"] >= 0 for t in told) and np.mean([t["reward"] for t in told[-20:]]) > np.mean([t["reward"] for t in told[:20]])


def test_inference_keeps_nulls_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, [0.1, 0.2], "old"), (2, None, "old")], "id int, x array<float>, tier string")
    net = L.Network.new([2, 4, 4])
    got = L.with_tier(rows, net, "x").orderBy("id").collect()
    assert got[0]["tier"] in L.TIERS and got[1]["tier"] is None
    assert [r["predicted_quality"] is None for r in L.with_scores(rows, L.Network.new([2, 3, 1]), "x").orderBy("id").collect()] == [False, True]


def test_sqlite_ledger_and_points(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "l.db")
    con.execute("CREATE TABLE runs (sequence INTEGER PRIMARY KEY, dedupe_key TEXT, row_json TEXT)")
    con.executemany("INSERT INTO runs VALUES (?, ?, ?)", [(2, "b", '{"x": 2}'), (1, "a", '{"x": 1}')])
    con.commit()
    con.close()
    assert [tuple(r) for r in ST.sqlite_ledger(spark, f"file://{tmp_path}/l.db", "runs", "x int").orderBy("sequence").collect()] == [(1, 1), (2, 2)]
    with pytest.raises(ValueError):
        ST.sqlite_ledger(spark, f"file://{tmp_path}/l.db", "runs; drop", "x int")
    points = spark.createDataFrame([("d", "test", "small", "s1", "g1", [1.0, 2.0])], "dataset_name string, split string, memory_tier string, sample_id string, segment_id string, vector array<float>")
    ST.write_points(points, f"{tmp_path}/points", 2)
    assert spark.read.parquet(f"{tmp_path}/points").where("memory_tier = 'small'").count() == 1
    with pytest.raises(Exception, match="length is not 3"):
        ST.write_points(points, f"{tmp_path}/bad", 3)


def test_splits_are_listed_and_loaded(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "manifest.json").write_text('{"files": {"samples": "samples.jsonl"}}')
    (tmp_path / "train" / "samples.jsonl").write_text('{"sample_id": "a"}\n\n{"sample_id": "b"}\n')
    root = f"file://{tmp_path}"
    assert V.splits(spark, root) == ["train"] and V.splits(spark, root + "/none") == []
    assert V.load_split(spark, root, "train", "samples", "sample_id string", ["b"]).count() == 1
    with pytest.raises(ValueError):
        V.load_split(spark, root, "train", "turns", "sample_id string")


def test_names_and_payloads(spark):
    assert [P.alpha_token(a) for a in ("0.50", 0, "-0", 1.25, "10")] == ["0p5", "0", "0", "1p25", "10"]
    assert P.artifact_name(" NSP ", 0.5) == "nsp_alpha_0p5"
    for bad in (-1, "x", "inf"):
        with pytest.raises((ValueError, ArithmeticError)):
            P.alpha_token(bad)
    rows = spark.createDataFrame([("0.50",), ("2",), ("x",), (None,)], "a string").select(P.alpha_column(F.col("a")))
    assert [r[0] for r in rows.collect()] == ["0p5", "2", None, None]
    p = spark.createDataFrame([('{"fact_id": "f", "source_content_hash": "h", "more": "1", "schema_version": "v"}',)], "p string")
    row = ST.from_payload(p, "p", {"fact_id": "string", "segment_hash": "string"}, ["fact_id", "segment_hash"]).first()
    assert (row["fact_id"], row["segment_hash"], row["extra"]) == ("f", "h", {"more": "1"})
    with pytest.raises(Exception, match="lacks fact_text"):
        ST.from_payload(p, "p", {"fact_id": "string", "fact_text": "string"}, ["fact_text"]).collect()


def test_segments_are_found_by_sample(spark, tmp_path):
    for s, own in (("a", "a"), ("b", "b"), ("c", "a")):
        (tmp_path / "samples" / s).mkdir(parents=True)
        (tmp_path / "samples" / s / "segments.jsonl").write_text(json.dumps({"sample_id": own, "segment_id": "seg_1"}) + "\n")
    root, schema = f"file://{tmp_path}", "sample_id string, segment_id string"
    assert sorted(r["sample_id"] for r in ST.segments_of(spark, root, schema, ["a", "b"]).collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="z"):
        ST.segments_of(spark, root, schema, ["a", "z"])
    with pytest.raises(Exception, match="another sample"):
        ST.segments_of(spark, root, schema).collect()
