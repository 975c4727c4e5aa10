"""Queries of chains around a model, strict readers, splits, scorers and stores, with the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talkmill.functions import records as P
from talkmill.operators import chains as C
from talkmill.operators import experiments as X
from talkmill.operators import learned as L
from talkmill.operators import replies as R
from talkmill.operators import splits as S
from talkmill.plans.registry import query
from talkmill.plans.tables import table
from talkmill.session import ship
from talkmill.sources import conversations as V
from talkmill.sources import stores as ST


@query("""SELECT conv_id AS sample_id, conv_id || '_q' || lpad(row_number() OVER (PARTITION BY conv_id ORDER BY turn)::VARCHAR, 3, '0') AS question_id, coalesce(text, '') AS question, role AS answer, len(CASE WHEN turn % 2 = 0 THEN [turn] ELSE [] END)::INT AS n_evidence, turn % 3 = 0 AS is_unanswerable FROM conversations""")
def p2_questions(spark, sf):
    item = F.to_json(F.struct(F.col("text").alias("query"), F.col("role").alias("gold_answer"), F.array(F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).otherwise("D1")).alias("evidence_turn_ids"), F.when(F.col("turn") % 3 == 0, "x_abs").otherwise("x").alias("question_id")))
    items = F.array_sort(F.collect_list(F.struct("turn", item.alias("i"))))
    r = table(spark, sf, "conversations").groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["i"]), ","), F.lit("]")).alias("qa"))
    return V.questions_of(r, "conv_id", "qa").select("sample_id", "question_id", "question", "answer", F.size("evidence_turn_ids").alias("n_evidence"), "is_unanswerable")


@query("SELECT conv_id AS sample_id, turn // 3 AS session_id, turn, role, text FROM conversations")
def p10_flattened(spark, sf):
    s = table(spark, sf, "conversations").groupBy("conv_id", F.expr("turn div 3").alias("session_id")).agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    return V.flattened(s.groupBy(F.col("conv_id").alias("sample_id")).agg(F.collect_list(F.struct("session_id", "turns")).alias("sessions")))


@query("SELECT DISTINCT l_discount AS alpha, replace(rtrim(rtrim(l_discount::VARCHAR, '0'), '.'), '.', 'p') AS token FROM lineitem")
def p14_alpha_tokens(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_discount").alias("alpha")).distinct().withColumn("token", P.alpha_column(F.col("alpha")))


@query("SELECT event_id AS fact_id, event_type AS fact_text, sha256(user_id::VARCHAR) AS segment_hash, (user_id % 5) || ',' || (user_id % 7) AS source_turn_ids, round(value, 4)::DECIMAL(18, 4)::VARCHAR AS note FROM events")
def p19_payload(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("fact_id"), F.col("event_type").alias("fact_text"), F.sha2(F.col("user_id").cast("string"), 256).alias("segment_hash"), F.array(F.col("user_id") % 5, F.col("user_id") % 7).alias("source_turn_ids"), F.create_map(F.lit("note"), F.round("value", 4).cast("decimal(18,4)").cast("string")).alias("extra"))
    p = e.select(ST.to_payload(e, "fact_v1").alias("payload"))
    back = ST.from_payload(p, "payload", {"fact_id": "long", "fact_text": "string", "segment_hash": "string", "source_turn_ids": "array<long>"}, ["fact_id", "fact_text", "segment_hash"])
    return back.select("fact_id", "fact_text", "segment_hash", F.array_join(F.col("source_turn_ids").cast("array<string>"), ",").alias("source_turn_ids"), F.try_element_at("extra", F.lit("note")).alias("note"))


@query(r"""SELECT conv_id, string_agg('<SOURCE_TURN_ID=' || turn || '> [2024-01-01] ' || role || ': ' || rtrim(ltrim(coalesce(text, ''), E' \t\r\n'), E'\r\n'), chr(10) ORDER BY turn) AS annotated, NULL::VARCHAR AS error FROM conversations GROUP BY 1""")
def p12_annotated(spark, sf):
    ship(spark)
    line = F.concat(F.lit("[2024-01-01] "), (F.col("turn") - 1).cast("string"), F.lit("."), "role", F.lit(": "), F.coalesce("text", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("l"))))
    s = table(spark, sf, "conversations").groupBy("conv_id").agg(lines.alias("x")).select("conv_id", F.array_join(F.transform("x", lambda x: x["l"]), "\n").alias("text"), F.transform("x", lambda x: x["turn"].cast("int")).alias("turn_ids"))
    return R.with_sources(s).select("conv_id", "annotated", "error")


@query("""SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 0 ELSE count(DISTINCT event_type) END::INT AS n_facts, CASE WHEN user_id % 4 = 0 THEN 'source_id 99 does not belong to segment s' || user_id END AS error, user_id % 4 = 0 AS terminal FROM events GROUP BY 1""")
def p23_fact_batches(spark, sf):
    ship(spark)
    name = F.concat(F.lit("s"), F.col("user_id").cast("string"))
    item = F.struct(name.alias("segment_id"), F.array(F.when(F.col("user_id") % 4 == 0, 99).otherwise((F.col("event_id") % 5).cast("int"))).alias("source_ids"), F.col("event_type").alias("fact"))
    r = table(spark, sf, "events").groupBy("user_id").agg(F.collect_list(item).alias("data")).select("user_id", F.to_json(F.struct(F.array(name).alias("processed_segment_ids"), "data")).alias("content"), F.array(F.struct(name.alias("segment_id"), F.array(*map(F.lit, range(5))).alias("ids"))).alias("segments"), F.array().cast("array<int>").alias("forbidden"))
    got = R.fact_batches(r, 15)
    return got.select("user_id", F.coalesce(F.array_size("facts"), F.lit(0)).alias("n_facts"), "error", F.coalesce(~P.repairable(F.col("error")) & F.col("error").isNotNull(), F.lit(False)).alias("terminal"))


def echo(prompts):
    """A model of fixed answers: a fact for each topic, from its first source. It cuts batches of several topics short whose id begins with 0 or 1."""
    ids = F.regexp_extract("prompt", r"(?s)exact output order: \[(.*?)\]", 1)
    names = F.transform(F.split(ids, ", "), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    first = F.regexp_extract_all("prompt", F.lit(r"for this topic only: \[(\d+)"), F.lit(1))
    data = F.transform(F.arrays_zip(names.alias("n"), first.alias("f")), lambda x: F.struct(x["n"].alias("segment_id"), F.array(x["f"].cast("int")).alias("source_ids"), F.concat(F.lit("fact of "), x["n"]).alias("fact")))
    cut = F.col("batch_id").rlike("^[01]") & (F.size(names) > 1)
    return prompts.select("batch_id", F.to_json(F.struct(names.alias("processed_segment_ids"), data.alias("data"))).alias("content"), F.length("prompt").alias("input_tokens"), (10 * F.size(names)).alias("output_tokens"), cut.alias("truncated"))


@query("SELECT 't' || conv_id || '.' || turn AS segment_id, 1::INT AS n_facts, 'stored' AS status FROM conversations")
def c1_c3_extraction(spark, sf):
    ship(spark)
    s = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("segment_order"), F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("segment_id"), "text", F.array(F.col("turn").cast("int")).alias("ids"), F.length(F.coalesce("text", F.lit(""))).alias("tokens"))
    done = C.extracted(C.batches(s.fillna("", ["text"]), ["conv_id"], 4, 100_000), echo, None, 15)
    return C.segment_ledger(done, 0.287, 0.861).select("segment_id", "n_facts", "status")


ATTEMPTS = "a AS (SELECT user_id AS batch_id, event_type AS tier, event_id AS attempt, CASE WHEN value > 40 THEN 'succeeded' ELSE 'failed' END AS status FROM events), b AS (SELECT *, max(CASE WHEN status = 'succeeded' THEN attempt END) OVER (PARTITION BY batch_id, tier) AS last FROM a)"


@query(f"WITH {ATTEMPTS} SELECT batch_id, attempt, CASE WHEN status = 'succeeded' AND attempt = last THEN round((100 * CASE tier WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.25 END + 50 * CASE tier WHEN 'click' THEN 2.0 WHEN 'view' THEN 1.0 END) / 1e6, 9) END AS cost, CASE WHEN status = 'succeeded' AND attempt = last THEN 'known' ELSE 'unknown' END AS cost_status FROM b")
def c4_attempts(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("batch_id"), F.col("event_type").alias("call_index"), F.col("event_type").alias("tier"), F.col("event_id").alias("attempt"), F.when(F.col("value") > 40, "succeeded").otherwise("failed").alias("status"), F.lit(100).alias("input_tokens"), F.lit(50).alias("output_tokens"), F.lit("provider").alias("usage_source"))
    return C.attempts(e, {"click": (0.5, 2.0), "view": (0.25, 1.0)}).select("batch_id", "attempt", F.round("cost", 9).alias("cost"), "cost_status")


@query("SELECT count(*) AS n_calls, sum(n_chars)::BIGINT AS input_tokens, sum(least(8000, greatest(2048, 260 * (doc_id % 40 + 2))))::BIGINT AS reserved_tokens, max(n_chars)::BIGINT AS largest_prompt, round(sum(n_chars) * 0.5 / 1e6, 6) AS input_cost_bound, round(sum(least(8000, greatest(2048, 260 * (doc_id % 40 + 2)))) * 2.0 / 1e6, 6) AS output_cost_bound FROM documents")
def a24_judge_plan(spark, sf):
    d = table(spark, sf, "documents").select(F.col("n_chars").alias("prompt_tokens"), (F.col("doc_id") % 40).alias("n_candidates"), F.lit(2).alias("n_gold"))
    return C.judge_plan(d, 10**9, 8000, 0.5, 2.0).withColumns({c: F.round(c, 6) for c in ("input_cost_bound", "output_cost_bound")})


@query("SELECT user_id, sum(event_id % 100)::BIGINT AS input_tokens, sum(event_id % 7)::BIGINT AS output_tokens, sum(event_id % 100 + event_id % 7)::BIGINT AS tokens, round(sum(value), 4) AS cost, sum((event_type = 'click')::INT)::BIGINT AS n_provider, sum((event_type <> 'click')::INT)::BIGINT AS n_estimated, sum((event_type = 'error')::INT)::BIGINT AS n_unknown_cost, sum((event_type = 'error')::INT) = 0 AS cost_complete FROM events GROUP BY 1")
def a23_stage_usage(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"), F.col("value").alias("total_cost"), F.when(F.col("event_type") == "click", "provider").otherwise("estimate").alias("usage_source"), F.when(F.col("event_type") == "error", "unknown").otherwise("known").alias("cost_status"))
    return C.stage_usage(e, ["user_id"]).withColumn("cost", F.round("cost", 4))


@query("WITH j AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT l_orderkey AS segment_id, l_linenumber AS model_id, o_orderstatus AS reference_set_hash, 'p' || l_linenumber AS profile_id, CASE WHEN l_linenumber <= 3 THEN 'run' || l_linenumber ELSE 'unknown' END AS extraction_run_id FROM j JOIN orders ON l_orderkey = o_orderkey")
def j15_label_inputs(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("segment_id"), F.col("o_orderstatus").alias("reference_set_hash"))
    j = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("segment_id"), F.col("l_linenumber").alias("model_id")).distinct().join(o.select("segment_id"), "segment_id", "left_semi")
    profiles = j.select("model_id").distinct().withColumn("profile_id", F.concat(F.lit("p"), F.col("model_id").cast("string")))
    runs = j.where("model_id <= 3").withColumn("extraction_run_id", F.concat(F.lit("run"), F.col("model_id").cast("string")))
    return C.label_inputs(j, o, profiles, runs)


@query("SELECT user_id AS segment_id, event_type AS model_id, 'u' || user_id AS segment_text, (SELECT count(*) FROM events g WHERE g.user_id = e.user_id AND g.event_id % 2 = 0)::INT AS n_gold, sum((event_id % 3 = 0)::INT)::INT AS n_candidates, '' AS review_status FROM events e WHERE user_id IN (SELECT user_id FROM events WHERE event_id % 2 = 0) GROUP BY 1, 2")
def j16_review_sheet(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("segment_id"), F.col("event_type").alias("model_id"), "event_id")
    gold = e.where("event_id % 2 = 0").select("segment_id", F.col("event_id").alias("gold_fact_id"), F.col("model_id").alias("gold_text"))
    told = e.where("event_id % 3 = 0").select("segment_id", "model_id", F.col("event_id").alias("candidate_id"), F.col("model_id").alias("candidate_text"))
    judged = e.select("segment_id", "model_id").distinct().join(gold.select("segment_id").distinct(), "segment_id", "left_semi")
    s = C.review_sheet(judged, e.select("segment_id").distinct().withColumn("text", F.concat(F.lit("u"), F.col("segment_id").cast("string"))), gold, told)
    return s.select("segment_id", "model_id", "segment_text", F.size("gold_facts").alias("n_gold"), F.size("candidate_facts").alias("n_candidates"), "review_status")


def samples(spark, sf):
    """Customers as samples: four neighbours of one segment are a group, the segment is the type, a tenth can't be answered."""
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("sample_id"), F.concat_ws("/", "c_mktsegment", F.expr("c_custkey div 4").cast("string")).alias("group_id"), F.col("c_mktsegment").alias("question_type"), (F.col("c_custkey") % 10 == 0).alias("is_unanswerable"), F.concat(F.lit("q"), (F.col("c_nationkey") % 4).cast("string")).alias("segment_bin"))


@query()
def g3_g4_fixed_split(spark, sf):
    ship(spark)
    n = table(spark, sf, "customer").count()
    return S.fixed_split(samples(spark, sf), {"train": n - 2 * (n // 10), "validation": n // 10, "test": n // 10}).select("sample_id", "group_id", "part")


@query("""WITH n AS (SELECT count(*) AS n FROM customer), f AS (SELECT fold, n // 3 + (fold < n % 3)::INT AS test, n FROM n, (SELECT unnest([0, 1, 2]) AS fold)), h AS (SELECT *, round_even((n - test) * 0.1, 0)::BIGINT AS held FROM f)
SELECT fold::INT AS fold, 'test' AS part, test::BIGINT AS n, n::BIGINT AS n_all FROM h UNION ALL SELECT fold::INT, 'validation', held, n FROM h UNION ALL SELECT fold::INT, 'train', n - test - held, n FROM h""")
def g5_g6_nested_folds(spark, sf):
    ship(spark)
    folds = S.nested_folds(samples(spark, sf), 3, 0.1)
    return S.manifest(folds).withColumn("n_all", F.sum("n").over(W.partitionBy("fold"))).select("fold", "part", "n", "n_all")


def scored_rows(spark, sf):
    """Embeddings with a quality that their first numbers tell."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 4 == 0).alias("held_out"))
    return e.withColumn("quality", 1 / (1 + F.exp(-4 * (F.get("embedding", F.lit(0)) + F.get("embedding", F.lit(1))))))


@query()
def g11_g12_scorer(spark, sf):
    ship(spark)
    rows = scored_rows(spark, sf)
    fit = L.fit_rows(rows, "embedding", "quality", "held_out", "vec_id", [16], epochs=30, drop=0.0, rate=5e-3)
    return L.with_scores(rows, fit.network, "embedding").select("vec_id", F.round("predicted_quality", 6).alias("predicted_quality"), F.round("quality", 6).alias("quality"))


@query()
def g10_policy(spark, sf):
    ship(spark)
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    width = e.select(F.max(F.size("embedding"))).first()[0]
    return L.with_tier(e, L.Network.new([width, 16, len(L.TIERS) + 1]), "embedding").select("vec_id", "tier")


@query("SELECT label % 3 AS segment_id, vec_id, 'medium' AS tier FROM embeddings WHERE vec_id % 3 = 1")
def c14_baseline(spark, sf):
    p = table(spark, sf, "embeddings").select((F.col("label") % 3).alias("segment_id"), "vec_id", F.element_at(F.array(*map(F.lit, L.TIERS)), (F.col("vec_id") % 3 + 1).cast("int")).alias("tier"))
    return C.baseline(p, p, "all-medium", "segment_id").select("segment_id", "vec_id", "tier")


@query("""SELECT event_id AS fact_id, user_id AS segment_id, CASE WHEN event_id % 2 = 0 THEN 'c0' ELSE 'c1' END AS campaign_id, 'm' || (event_id % 2) || (event_id % 6 // 2) AS model_id FROM events""")
def c7_corpus(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("fact_id"), F.col("user_id").alias("segment_id"), F.concat(F.lit("c"), F.col("event_id") % 2).alias("campaign"), F.expr("event_id % 6 div 2").alias("k"))
    samples = e.select((F.col("segment_id") % 5).alias("sample_id")).distinct()
    both = samples.withColumn("campaign_id", F.explode(F.array(F.lit("c0"), F.lit("c1"))))
    runs = both.select("campaign_id", "sample_id", F.concat_ws("/", "campaign_id", F.col("sample_id").cast("string")).alias("run_id"), F.lit("complete").alias("status"), F.lit(True).alias("reconciled"))
    facts = e.select("fact_id", "segment_id", F.concat_ws("/", "campaign", (F.col("segment_id") % 5).cast("string")).alias("run_id"), F.concat(F.lit("m"), F.substring("campaign", 2, 1), F.col("k")).alias("model_id"), F.array(F.lit(1)).alias("sources"), F.lit("h").alias("content_hash"))
    segments = e.select("segment_id", F.array(F.lit(1), F.lit(2)).alias("turns"), F.lit("h").alias("segment_hash")).distinct()
    return X.corpus(runs, facts, segments, samples).select("fact_id", "segment_id", "campaign_id", "model_id")


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS q, p.vec_id AS p, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) AS score FROM q JOIN embeddings p ON p.label = q.label),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, p) AS rank FROM s), m AS (SELECT q, string_agg('fact ' || p, chr(10) ORDER BY rank) AS answer FROM k WHERE rank <= 3 GROUP BY 1)
SELECT vec_id AS question_id, coalesce(answer, '(no retrieved memories)') AS answer, vec_id % 200 = 0 AS correct FROM q LEFT JOIN m ON m.q = q.vec_id""")
def c8_answers(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("label").alias("sample_id"), F.lit("?").alias("question"), F.col("embedding").alias("q"))
    p = e.select(F.col("vec_id").alias("point_id"), F.col("label").alias("sample_id"), F.col("embedding").alias("v"), F.concat(F.lit("fact "), F.col("vec_id").cast("string")).alias("line"))
    judge = lambda d: d.select("question_id", F.when(F.col("question_id") % 200 == 0, '{"label": "CORRECT"}').otherwise('{"label": "WRONG"}').alias("label"))
    return X.answered(q, p, lambda d: d.select("question_id", F.col("memories").alias("answer")), judge, 3).select("question_id", "answer", "correct")


@query("""SELECT conv_id AS question_id, coalesce(string_agg(CASE WHEN role = 'user' THEN trim('[t] ' || trim(coalesce(text, ''), ' ')) END, chr(10) ORDER BY turn), '(none)') AS first, coalesce(string_agg(CASE WHEN role <> 'user' THEN trim('[t] ' || trim(coalesce(text, ''), ' ')) END, chr(10) ORDER BY turn), '(none)') AS second FROM conversations GROUP BY 1""")
def c9_memories(spark, sf):
    m = table(spark, sf, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("rank"), F.lit("t").alias("ts"), F.lit("").alias("weekday"), F.col("text").alias("fact"), F.when(F.col("role") == "user", "user").otherwise("other").alias("source"), F.lit("user").alias("a"), F.lit("other").alias("b"))
    return X.speaker_memories(m, "a", "b")


@query("SELECT l_orderkey AS segment_id, l_linenumber AS model_id, max(l_discount) AS quality, l_orderkey % 5 = 0 AS held_out, 3::INT AS width, round(o_totalprice + l_linenumber + 0.5, 4) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, o_totalprice")
def c10_training_rows(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("segment_id"), F.array("o_totalprice").alias("vector"))
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("segment_id"), F.col("l_linenumber").alias("model_id")).agg(F.max("l_discount").alias("quality")).join(o.select("segment_id"), "segment_id", "left_semi").withColumn("sample_id", F.col("segment_id") % 5)
    p = l.select("model_id").distinct().withColumn("dimensions", F.array(F.col("model_id").cast("double"), F.lit(0.5)))
    rows = X.training_rows(l, o, p, ["segment_id"], "sample_id", l.where("sample_id = 0"))
    return rows.select("segment_id", "model_id", "quality", "held_out", F.size("features").alias("width"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("WITH f AS (SELECT user_id % 3 AS fold, avg((value > 50)::INT) AS a FROM events GROUP BY 1) SELECT 'cv' AS experiment, count(*) AS n_folds, round(avg(a), 6) AS mean, round(coalesce(stddev_samp(a), 0), 6) AS deviation FROM f")
def c13_folds(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("sample_id"), (F.col("value") > 50).alias("correct"), F.lit("m1").alias("model"))
    folds = e.select("sample_id").distinct().withColumn("fold", F.explode(F.array(*map(F.lit, range(3))))).withColumn("part", F.when(F.col("sample_id") % 3 == F.col("fold"), "test").otherwise("train"))
    out = X.cross_validated(folds, 3, lambda i, m: e.where(F.col("sample_id") % 3 == i), "cv", ["model"])
    return out.select("experiment", "n_folds", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))
