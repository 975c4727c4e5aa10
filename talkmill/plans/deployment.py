"""Queries of checked joins, roll-ups, allocation, records and batch states, with the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talkmill.functions import records as P
from talkmill.functions import text as X
from talkmill.operators import evaluation as E
from talkmill.operators import joins as J
from talkmill.operators import ordered as O
from talkmill.plans.registry import PACK, STOP, TOKENS, query
from talkmill.plans.tables import OBSERVATIONS, curve, observations, table


def literals(pairs: dict[str, str]) -> str:
    return " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items())


def events(spark, sf):
    return table(spark, sf, "events")


@query(rf"""WITH w AS (SELECT unnest({TOKENS}) AS tok FROM conversations),
k AS (SELECT tok, count(*) AS n FROM w WHERE tok NOT IN ({STOP}) AND NOT regexp_full_match(tok, '[a-z]') AND regexp_matches(tok, '[a-z0-9_\x{{4e00}}-\x{{9fff}}]') GROUP BY 1),
b AS (SELECT n, regexp_replace(tok, '^[._+/-]+|[._+/-]+$', '', 'g') AS b FROM k),
g AS (SELECT n, b, left(b, greatest(length(b) - 3, 0)) AS c3, left(b, greatest(length(b) - 2, 0)) AS c2, left(b, greatest(length(b) - 1, 0)) AS c1 FROM b),
s AS (SELECT n, CASE WHEN b IN ({", ".join(f"'{x}'" for x in X.IRREGULAR)}) THEN CASE b {literals(X.IRREGULAR)} END WHEN NOT regexp_full_match(b, '[a-z][a-z0-9_./+-]*') THEN b
  WHEN length(b) > 5 AND suffix(b, 'ies') THEN c3 || 'y' WHEN length(b) > 5 AND suffix(b, 'ing') THEN CASE WHEN length(c3) > 2 AND c3[-1:] = c3[-2:-2] THEN left(c3, length(c3) - 1) ELSE c3 END
  WHEN length(b) > 4 AND suffix(b, 'ied') THEN c3 || 'y' WHEN length(b) > 4 AND suffix(b, 'ed') THEN c2
  WHEN length(b) > 4 AND (suffix(b, 'ches') OR suffix(b, 'shes') OR suffix(b, 'sses') OR suffix(b, 'xes') OR suffix(b, 'zes')) THEN c2
  WHEN length(b) > 3 AND suffix(b, 's') AND NOT suffix(b, 'ss') AND NOT suffix(b, 'us') AND NOT suffix(b, 'is') THEN c1 ELSE b END AS s FROM g),
c AS (SELECT n, CASE s {literals(X.ALIASES)} ELSE s END AS concept FROM s)
SELECT concept, sum(n)::BIGINT AS n FROM c WHERE concept <> '' AND concept NOT IN ({STOP}) GROUP BY 1""")
def t6_t8_concepts(spark, sf):
    return table(spark, sf, "conversations").select(F.explode(X.content_terms(F.col("text"))).alias("concept")).groupBy("concept").agg(F.count("*").alias("n"))


@query()
def t9_idea_units(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.idea_units(F.col("text")).alias("units"))


@query("""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[。！？!?;\\n]+'), lambda s: trim(s, ' ')), lambda s: s <> '') AS s FROM conversations)
SELECT conv_id, turn, len(list_filter(s, lambda x: contains(lower(x), 'prefer') OR contains(x, '喜欢') OR contains(x, '希望')))::INT AS n_preferences FROM s""")
def t14_preferences(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(X.preferences(F.col("text"))).alias("n_preferences"))


@query("SELECT conv_id, turn, turn::INT AS source_id, role AS speaker, 'Mon' AS weekday FROM conversations")
def p11_source_lines(spark, sf):
    line = F.concat(F.lit("[2024-01-01, Mon] "), F.col("turn").cast("string"), F.lit("."), "role", F.lit(": "), F.coalesce("text", F.lit("")))
    first = F.get(P.source_lines(line), F.lit(0))
    return table(spark, sf, "conversations").select("conv_id", "turn", first["source_id"].alias("source_id"), first["speaker"].alias("speaker"), first["weekday"].alias("weekday"))


@query("SELECT conv_id, string_agg('--- Topic ' || turn || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY 1")
def p13_batch_prompt(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.col("turn").cast("string").alias("segment_id"), "text")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(P.batch_prompt(turns).alias("prompt"))


@query("SELECT doc_id, regexp_replace(regexp_replace(lower(trim(source)), '[^a-z0-9_-]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') || '_' || left(sha256(doc_id::VARCHAR), 12) AS namespace FROM documents")
def p15_namespace(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat(P.slug(F.col("source")), F.lit("_"), F.left(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(12))).alias("namespace"))


@query("SELECT event_id, 'rf_' || left(sha256('[\"' || user_id || '\",\"' || event_type || '\",[' || event_id || ']]'), 20) AS fact_id FROM events")
def p18_fact_id(spark, sf):
    return events(spark, sf).select("event_id", P.fact_id(F.col("user_id"), F.col("event_type"), F.array("event_id")).alias("fact_id"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS fact_type, event_type = 'click' AND value > 10 AND value > 20 AND value > 30 AND NOT value > 90 AND event_id % 7 <> 0 AS accepted FROM events")
def p21_p22_facts(spark, sf):
    v = F.col("value")
    decision, duplicate = F.when(F.col("event_type") == "click", "ACCEPT").otherwise("REJECT"), F.when(F.col("event_id") % 7 == 0, "other_fact")
    return events(spark, sf).select("event_id", P.coerced(F.upper("event_type"), ["click", "view"], "other").alias("fact_type"), P.accepted(decision, v > 10, v > 20, v > 30, v > 90, duplicate).alias("accepted"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'true' WHEN 'view' THEN 'false' ELSE 'invalid' END AS by_json, CASE event_type WHEN 'click' THEN 'true' WHEN 'view' THEN 'false' ELSE 'invalid' END AS by_line, event_type <> 'error' AS repairable FROM events")
def p24_p25_answers(spark, sf):
    kind = F.col("event_type")
    name = lambda label: F.coalesce(label.cast("string"), F.lit("invalid"))
    said = lambda yes, no, other: F.when(kind == "click", yes).when(kind == "view", no).otherwise(other)
    return events(spark, sf).select(
        "event_id", name(P.json_label(said('{"label": "correct"}', '{"label": " Wrong "}', "none"))).alias("by_json"), name(P.yes_no(said("Yes.\nIt does", "INCORRECT!", "perhaps"))).alias("by_line"),
        P.repairable(F.when(kind == "error", "row 3: empty fact").otherwise("bad JSON")).alias("repairable"),
    )


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN '[T' || turn || ', Mon] ' ELSE '[T' || turn || '] ' END || role AS line, CASE WHEN role = 'assistant' THEN 2 ELSE 1 END AS side FROM conversations")
def p29_memory_lines(spark, sf):
    n = F.col("turn") % 3
    ts, day = F.when(n > 0, F.concat(F.lit("T"), F.col("turn").cast("string"))), F.when(n == 1, "Mon")
    return table(spark, sf, "conversations").select("conv_id", "turn", P.memory_line(ts, day, F.col("role")).alias("line"), P.speaker_side(F.lit(None).cast("string"), F.concat(F.lit("the "), "role", F.lit(" said")), F.lit("User"), F.lit("Assistant")).alias("side"))


@query("SELECT user_id, event_id, event_type FROM events WHERE event_type <> 'error' AND user_id IN (SELECT user_id FROM events WHERE event_type <> 'error')")
def p30_kept_questions(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", "event_type")
    some = e.where("event_type <> 'error'").select("user_id").distinct()
    return E.kept_questions(e.join(some, "user_id", "left_semi"), "user_id", "event_type", ["error"])


@query(f"WITH {OBSERVATIONS} SELECT segment_id, model_id, 'base' AS profile_id, predicted_quality, actual_quality, cost FROM obs")
def j1_observations(spark, sf):
    o, key = observations(spark, sf), ["segment_id", "model_id"]
    profile = F.lit("base").alias("profile_id")
    return J.observations(o.select(*key, profile, "predicted_quality"), o.select(*key, profile, "actual_quality"), o.select(*key, "cost"), key)


@query("""WITH s AS (SELECT conv_id, unnest(['assistant', 'system', 'user']) AS model_id FROM (SELECT DISTINCT conv_id FROM conversations)),
r AS (SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn::VARCHAR) AS refs FROM conversations WHERE turn % 2 = 0 GROUP BY 1), c AS (SELECT conv_id, role AS model_id, string_agg(turn::VARCHAR, ',' ORDER BY turn::VARCHAR) AS cands FROM conversations GROUP BY 1, 2)
SELECT conv_id, model_id, coalesce(cands, '') AS candidate_ids, coalesce(refs, '') AS reference_ids FROM s LEFT JOIN r USING (conv_id) LEFT JOIN c USING (conv_id, model_id)""")
def j2_judge_tasks(spark, sf):
    t = table(spark, sf, "conversations")
    turn = F.col("turn").cast("string")
    tasks = J.judge_tasks(t.select("conv_id").distinct(), t.where("turn % 2 = 0").select("conv_id", turn.alias("reference_id")), t.select("conv_id", F.col("role").alias("model_id"), turn.alias("candidate_id")), ["assistant", "system", "user"], "conv_id")
    return tasks.select("conv_id", "model_id", F.array_join("candidate_ids", ",").alias("candidate_ids"), F.array_join("reference_ids", ",").alias("reference_ids"))


@query("SELECT event_id, event_type, n FROM events JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) USING (event_type)")
def j3_j4_profiles(spark, sf):
    e = events(spark, sf)
    return J.covered(e.select("event_id", "event_type"), e.groupBy("event_type").agg(F.count("*").alias("n")), ["event_type"], "profile")


@query("SELECT user_id FROM events WHERE event_id % 2 = 0 INTERSECT SELECT user_id FROM events WHERE event_id % 2 = 1")
def j5_leakage(spark, sf):
    return J.leaked(events(spark, sf).where("event_id % 2 = 0"), events(spark, sf).where("event_id % 2 = 1"), ["user_id"])


@query("SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY 1")
def j6_j7_exact_cover(spark, sf):
    e = events(spark, sf)
    return J.exact(e.groupBy("user_id").agg(F.count("*").alias("n")), e.groupBy("user_id").agg(F.max("value").alias("top")), ["user_id"], "evaluation")


@query("SELECT user_id, event_type AS tier, event_id FROM events JOIN (SELECT user_id, min(event_type) AS event_type FROM events GROUP BY 1) USING (user_id, event_type)")
def j8_v5_assembly(spark, sf):
    e = events(spark, sf).select("user_id", F.col("event_type").alias("tier"), "event_id")
    return J.assembly(e.groupBy("user_id").agg(F.min("tier").alias("tier")), e, "user_id")


@query("""WITH a AS (SELECT user_id, event_type AS tier, event_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('asm-1:' || event_type || ':' || event_id)) AS h FROM events JOIN (SELECT user_id, min(event_type) AS event_type FROM events GROUP BY 1) USING (user_id, event_type))
SELECT user_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS event_id, tier AS source_collection_tier, event_id::VARCHAR AS source_point_id, '' AS source_extraction_run_id, 'asm-1' AS assembly_id, 'ep-1' AS episode_id, 'v1' AS policy_version FROM a""")
def v5_stamped(spark, sf):
    e = events(spark, sf).select("user_id", F.col("event_type").alias("tier"), "event_id")
    return J.stamped(e.groupBy("user_id").agg(F.min("tier").alias("tier")), e, "user_id", "event_id", "asm-1", "ep-1", "v1")


@query("SELECT user_id, kind FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(['click', 'error', 'refund']) AS kind) EXCEPT SELECT user_id, event_type FROM events")
def j9_gaps(spark, sf):
    e = events(spark, sf).select("user_id", F.col("event_type").alias("kind"))
    return J.gaps(e.select("user_id").distinct().withColumn("kind", F.explode(F.array(*map(F.lit, ["click", "error", "refund"])))), e, ["user_id", "kind"])


@query("SELECT conv_id, turn, EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1) AS in_segment FROM conversations a")
def j10_grounded(spark, sf):
    t, h = table(spark, sf, "conversations"), F.sha2(F.col("conv_id").cast("string"), 256)
    facts = t.select("conv_id", "turn", F.array(F.col("turn"), F.col("turn") + 1).alias("sources"), h.alias("content_hash"))
    segments = t.groupBy("conv_id").agg(F.collect_set("turn").alias("turns")).withColumn("segment_hash", h)
    return J.grounded(facts, segments, ["conv_id"]).select("conv_id", "turn", "in_segment")


@query("""WITH l AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), s AS (SELECT user_id, event_type, CASE WHEN max(value) > 50 THEN 'committed' ELSE 'failed' END AS status FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2),
b AS (SELECT coalesce(l.user_id, s.user_id) AS user_id, coalesce(l.event_type, s.event_type) AS event_type, CASE WHEN status IS NULL THEN 'no_state' WHEN status = 'committed' AND l.user_id IS NULL THEN 'committed_without_cost' WHEN status <> 'committed' AND l.user_id IS NOT NULL THEN 'cost_without_commit' END AS problem
FROM l FULL JOIN s ON l.user_id = s.user_id AND l.event_type = s.event_type) SELECT * FROM b WHERE problem IS NOT NULL""")
def j18_q8_reconcile(spark, sf):
    e, key = events(spark, sf), ["user_id", "event_type"]
    state = e.where("event_id % 3 <> 0").groupBy(*key).agg(F.when(F.max("value") > 50, "committed").otherwise("failed").alias("status"))
    return J.reconcile(e.where("event_id % 2 = 0").select(*key).distinct(), state, key)


@query("SELECT user_id, sum(event_id % 100)::BIGINT AS input_tokens, sum(event_id % 7)::BIGINT AS output_tokens, CASE WHEN bool_or(value > 95) THEN 'mixed_estimate' ELSE 'provider' END AS usage_source, max(event_id) AS request_id FROM events GROUP BY 1")
def a12_batch_usage(spark, sf):
    e = events(spark, sf).select("user_id", (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"), (F.col("value") > 95).alias("estimated"), F.col("event_id").alias("request_id"), "event_id")
    return E.batch_usage(e, ["user_id"], "event_id")


@query("SELECT event_type, count(*) AS n_calls, count(DISTINCT user_id) AS n_samples, sum(event_id % 100)::BIGINT AS input_tokens, sum(event_id % 7)::BIGINT AS output_tokens, round(sum(value), 4) AS cost, round(sum(value) / count(DISTINCT user_id), 4) AS cost_per_sample, round(sum(value) / count(*), 4) AS cost_per_call FROM events GROUP BY 1")
def a13_deployment_cost(spark, sf):
    e = events(spark, sf).select("event_type", F.col("user_id").alias("sample_id"), (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"), F.col("value").alias("cost"))
    return E.deployment_cost(e, ["event_type"]).withColumns({c: F.round(c, 4) for c in ("cost", "cost_per_sample", "cost_per_call")})


@query("WITH s AS (SELECT user_id, count(*) AS n, sum((value > 50)::INT) AS ok FROM events GROUP BY 1) SELECT count(*) AS n_samples, sum(n)::BIGINT AS n_questions, round(sum(ok) / sum(n), 6) AS micro, round(avg(ok / n), 6) AS macro FROM s")
def a17_micro_macro(spark, sf):
    return E.micro_macro(events(spark, sf), "user_id", F.col("value") > 50).withColumns({c: F.round(c, 6) for c in ("micro", "macro")})


@query("SELECT event_type, 'reader' AS role, sum(event_id % 3)::BIGINT AS calls, sum(event_id % 10)::BIGINT AS tokens FROM events GROUP BY 1 UNION ALL SELECT event_type, 'judge', sum(event_id % 2)::BIGINT, sum(event_id % 5)::BIGINT FROM events GROUP BY 1")
def a14_a18_role_usage(spark, sf):
    n = lambda m, name: (F.col("event_id") % m).alias(name)
    return E.role_usage(events(spark, sf).select("event_type", n(3, "reader_calls"), n(10, "reader_tokens"), n(2, "judge_calls"), n(5, "judge_tokens")), ["reader", "judge"], "event_type")


@query("WITH f AS (SELECT event_type, user_id % 5 AS fold, avg(value) AS score FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS n_folds, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS deviation FROM f GROUP BY 1")
def a19_folds(spark, sf):
    f = events(spark, sf).groupBy("event_type", (F.col("user_id") % 5).alias("fold")).agg(F.avg("value").alias("score")).withColumn("scope", F.lit("all"))
    return E.folds(f, "event_type", ["scope"], "score").withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


@query("SELECT 'lang' AS feature, coalesce(lang, 'null') AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'null'), count(*) FROM documents GROUP BY 2")
def a20_a22_histogram(spark, sf):
    return E.histogram(table(spark, sf, "documents"), ["lang", "source"])


@query("SELECT event_type, sum(event_id % 10)::BIGINT AS weight, round(sum(value * (event_id % 10)) / sum(event_id % 10), 6) AS score FROM events GROUP BY 1")
def a28_weighted_score(spark, sf):
    return E.weighted_score(events(spark, sf).withColumn("w", F.col("event_id") % 10), "event_type", "value", "w").withColumn("score", F.round("score", 6))


@query()
def w4_prune_dense(spark, sf):
    d = O.depths(curve(spark, sf).where("score IS NOT NULL"), "conv_id", "turn", "score")
    return E.prune_dense(d.where("depth > 0.1"), "conv_id", "turn", "depth", 2)


@query("""WITH n AS (SELECT conv_id, turn // 3 AS session, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, row_number() OVER (PARTITION BY conv_id, turn // 3 ORDER BY turn) AS k FROM conversations)
SELECT conv_id, turn, format('seg_{:06d}', n) AS segment_id, conv_id || ':' || format('seg_{:06d}', n) AS qualified_id, sha256(coalesce(text, '')) AS content_hash, CASE WHEN k = 1 AND n > 1 THEN 'session_boundary' ELSE 'topic_shift' END AS reason FROM n""")
def w8_reindex(spark, sf):
    s = table(spark, sf, "conversations").select("conv_id", F.expr("turn div 3").alias("session"), "turn", "text")
    return E.reindex(s, "conv_id", "session", "turn", "text").drop("session", "text")


DEALT = "s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('seed7|' || doc_id), doc_id)::INT AS turn FROM documents), sel AS (SELECT * FROM s ORDER BY turn, source LIMIT 100)"


@query(f"WITH {DEALT} SELECT * FROM sel")
def w15_stratified(spark, sf):
    return E.stratified(table(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id", "seed7", 100)


@query(f"WITH {DEALT} SELECT doc_id FROM sel WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def w16_still_open(spark, sf):
    chosen = E.stratified(table(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id", "seed7", 100)
    return E.still_open(chosen.select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), s AS (SELECT *, 1000 * q / sum(q) OVER w AS a, 100.0 * l_linenumber / sum(l_linenumber) OVER w AS b FROM r WINDOW w AS (PARTITION BY l_orderkey)),
k AS (SELECT *, 1000 - sum(floor(a)) OVER w AS ra, 100 - sum(floor(b)) OVER w AS rb, row_number() OVER (PARTITION BY l_orderkey ORDER BY a - floor(a) DESC, l_linenumber) AS na, row_number() OVER (PARTITION BY l_orderkey ORDER BY b - floor(b) DESC, l_linenumber) AS nb FROM s WINDOW w AS (PARTITION BY l_orderkey)),
o AS (SELECT l_orderkey, l_linenumber, (floor(a) + (na <= ra)::INT)::BIGINT AS input_tokens, (floor(b) + (nb <= rb)::INT)::BIGINT AS output_tokens FROM k) SELECT *, round((input_tokens * 0.287 + output_tokens * 0.861) / 1e6, 9) AS cost FROM o""")
def w18_allocate_cost(spark, sf):
    r = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("w_in")).withColumns({"w_out": F.col("l_linenumber"), "total_in": F.lit(1000), "total_out": F.lit(100)})
    return E.allocate_cost(r, "l_orderkey", "l_linenumber", 0.287, 0.861).select("l_orderkey", "l_linenumber", "input_tokens", "output_tokens", F.round("cost", 9).alias("cost"))


@query("WITH r AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_tax) AS t FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, round(t + 10 * q / sum(q) OVER (PARTITION BY l_orderkey), 6) AS cost FROM r")
def w19_allocate_fallback(spark, sf):
    r = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_tax").alias("t")).withColumn("parent", F.lit(10.0))
    return E.allocate_fallback(r, "l_orderkey", "q", "parent", "t").select("l_orderkey", "l_linenumber", F.round("cost", 6).alias("cost"))


@query("SELECT event_id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 1e-12), 6) AS cost FROM events WINDOW w AS (PARTITION BY event_type)")
def w22_normalized_cost(spark, sf):
    e = events(spark, sf)
    ends = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.join(ends, "event_type").select("event_id", F.round(E.normalized_cost(F.col("value"), F.col("lo"), F.col("hi")), 6).alias("cost"))


@query(PACK + ", b AS (SELECT source, batch_no, sum(t) AS t FROM p GROUP BY 1, 2) SELECT source, count(*) AS n_batches, sum(t)::BIGINT AS input_tokens, max(t)::BIGINT AS largest, round((sum(t) * 0.287 + count(*) * 1024 * 0.861) / 1e6, 9) AS cost_bound FROM b GROUP BY 1")
def w24_plan_estimate(spark, sf):
    p = O.pack(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id", "n_chars", 8, 12000, 100)
    return E.plan_estimate(p.withColumnRenamed("n_chars", "tokens"), ["source"], 1024, 0.287, 0.861).withColumn("cost_bound", F.round("cost_bound", 9))


@query("WITH g AS (SELECT event_type, round(avg(value), 6) AS mean, count(*) AS cost FROM events GROUP BY 1) SELECT *, row_number() OVER (ORDER BY mean DESC, cost, event_type)::INT AS rank FROM g")
def w26_sweep_ranking(spark, sf):
    g = events(spark, sf).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("cost"))
    return E.ranked(g, [F.desc("mean"), F.col("cost"), F.col("event_type")])


@query("WITH h AS (SELECT DISTINCT event_type, sha256(user_id::VARCHAR) AS h FROM events) SELECT event_type, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS scope_hash FROM h GROUP BY 1")
def q9_scope_hash(spark, sf):
    return E.scope_hash(events(spark, sf), ["event_type"], "user_id")


STATUS = {"signup": "planned", "view": "requesting", "click": "api_succeeded", "purchase": "parsed", "error": "failed"}


@query(f"""WITH s AS (SELECT user_id, event_id, CASE event_type {literals(STATUS)} END AS s FROM events), b AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM s),
k AS (SELECT *, CASE WHEN b IS NULL THEN s = 'planned' ELSE {" OR ".join(f"(b = '{a}' AND s IN ({', '.join(repr(x) for x in n)}))" for a, n in E.NEXT.items())} END AS ok FROM b)
SELECT user_id, max_by(s, event_id) AS status, count(*) AS n_events, sum((NOT ok)::INT)::BIGINT AS illegal FROM k GROUP BY 1""")
def q12_batch_states(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", F.try_element_at(X.literal_map(STATUS), F.col("event_type")).alias("status"))
    return E.batch_states(e, "user_id", "event_id", "status")


@query("""WITH f AS (SELECT user_id, event_id, event_type AS t, event_id % 4 AS a, event_id % 3 AS b FROM events) SELECT c.user_id, c.event_id AS candidate_id, r.event_id AS reference_id FROM f c JOIN f r ON c.user_id = r.user_id AND c.t = r.t AND (c.a = r.b OR c.a = r.a) WHERE c.event_id % 2 = 0 AND r.event_id % 2 = 1""")
def j11_same_facts(spark, sf):
    e = events(spark, sf)
    c = e.where("event_id % 2 = 0").select("user_id", F.col("event_id").alias("candidate_id"), F.concat(F.upper("event_type"), F.lit("!")).alias("text"), F.array(F.col("event_id") % 4).alias("sources"))
    r = e.where("event_id % 2 = 1").select("user_id", F.col("event_id").alias("reference_id"), F.concat(F.lit(" "), "event_type").alias("text"), F.array(F.col("event_id") % 3, F.col("event_id") % 4).alias("sources"))
    return J.same_facts(c, r, "user_id")


@query("SELECT conv_id AS sample_id, turn AS question_id, CASE WHEN EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 2) THEN 2 ELSE 1 END::INT AS n_turns FROM conversations a")
def j14_evidence_turns(spark, sf):
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("sample_id"), "turn", F.concat(F.lit("D"), F.col("turn").cast("string")).alias("dia_id"), F.col("turn").cast("int").alias("turn_id"))
    q = t.select("sample_id", F.col("turn").alias("question_id"), F.array("dia_id", F.concat(F.lit("D"), (F.col("turn") + 2).cast("string"))).alias("evidence"))
    return J.evidence_turns(q, t).select("sample_id", "question_id", F.size("turn_ids").alias("n_turns"))
