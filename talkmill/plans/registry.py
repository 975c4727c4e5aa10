"""All registered queries of the library, and the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talkmill.functions import text as X
from talkmill.operators import aggregates as A
from talkmill.operators import decisions as D
from talkmill.operators import ordered as O
from talkmill.operators import routing as R
from talkmill.operators import stores as S
from talkmill.plans.tables import CURVE, OBSERVATIONS, curve, observations, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
TOKENS = "list_transform(regexp_extract_all(text, '[A-Za-z0-9_./+-]+|[\\x{4e00}-\\x{9fff}]'), lambda x: lower(x))"


@query(f"SELECT conv_id, turn, len({TOKENS})::INT AS n_tokens, len(list_filter({TOKENS}, lambda x: NOT list_contains([{STOP}], x)))::INT AS n_content, len(list_filter(list_transform(regexp_split_to_array(text, '[。！？!?;\\n]+'), lambda s: regexp_replace(s, '^[\\s\\x{{a0}}\\x{{3000}}]+|[\\s\\x{{a0}}\\x{{3000}}]+$', '', 'g')), lambda s: s <> ''))::INT AS n_sentences FROM conversations")
def t2_t5_tokens(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", X.count_tokens(t).alias("n_tokens"), F.size(X.content_tokens(t)).alias("n_content"), F.size(X.sentences(t)).alias("n_sentences"))


@query(f"""WITH w AS (SELECT conv_id, turn, unnest({TOKENS}) AS tok FROM conversations), c AS (SELECT conv_id, turn, tok, count(*) AS n FROM w GROUP BY ALL),
e AS (SELECT conv_id, turn, sum(n) AS total, count(*) AS kinds, -sum(n / s * log2(n / s)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id, turn)::DOUBLE AS s FROM c) GROUP BY 1, 2)
SELECT v.conv_id, v.turn, round(CASE WHEN coalesce(kinds, 0) <= 1 THEN 0.0 ELSE least(1.0, h / log2(kinds)) END, 6) AS entropy FROM conversations v LEFT JOIN e USING (conv_id, turn)""")
def t10_normalized_entropy(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(X.normalized_entropy(X.tokens(F.col("text"))), 6).alias("entropy"))


@query(f"""WITH w AS (SELECT conv_id, turn, unnest({TOKENS}) AS tok FROM conversations), c AS (SELECT conv_id, turn, tok, count(*) AS n FROM w WHERE tok NOT IN ({STOP}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, length(tok) DESC, tok) AS k FROM c)
SELECT v.conv_id, v.turn, coalesce(tok, 'general') AS topic FROM conversations v LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (conv_id, turn)""")
def t13_topic(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.topic(F.col("text")).alias("topic"))


@query("""WITH s AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM conversations)
SELECT conv_id, turn, CASE WHEN length(c) <= 96 THEN c ELSE rtrim(substr(c, 1, 95)) || '…' END AS summary FROM s""")
def t12_summary(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.summary(F.col("text")).alias("summary"))


@query()
def t11_entities(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.entities(F.col("text")).alias("entities"))


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(trim(replace(lower(text), 'ß', 'ss')), '[。.!！?]+$', ''), '\\s+', ' ', 'g')) AS fact_key FROM conversations")
def p16_fact_key(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.fact_key(F.col("text")).alias("fact_key"))


@query("""SELECT conv_id, turn, length(text)::INT AS n_chars, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS n_lines, len(regexp_extract_all(text, '[0-9]'))::INT AS n_digits,
len(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')))::INT AS n_words FROM conversations""")
def v8_structure(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", *[c.cast("int").alias(n) for n, c in X.structure(F.col("text")).items()])


@query("SELECT conv_id, turn, '[' || lpad(turn::VARCHAR, 3, '0') || '] ' || (turn - 1)::VARCHAR || '.' || role || ': ' || text AS line FROM conversations")
def p9_render_turn(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("["), F.lpad(F.col("turn").cast("string"), 3, "0"), F.lit("] "), (F.col("turn") - 1).cast("string"), F.lit("."), "role", F.lit(": "), "text").alias("line"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS content_hash FROM conversations GROUP BY 1")
def w7_segment_build(spark, sf):
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("l"))))
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("text"), F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))
    return g.select("conv_id", "text", "n_turns", "n_chars", F.sha2("text", 256).alias("content_hash"))


@query("""WITH o AS (SELECT *, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS ch FROM events)
SELECT user_id, event_id, coalesce(sum(ch::INT) OVER (PARTITION BY user_id ORDER BY event_id), 0)::BIGINT AS slice_no FROM o""")
def w1_session_slices(spark, sf):
    return O.slices(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type").select("user_id", "event_id", "slice_no")


@query(f"""WITH {CURVE}, p AS (SELECT v.conv_id, v.turn, v.turn // 3 AS part, v.role || ': ' || v.text AS line, len(string_split(v.text, ' ')) AS tokens, score, row_number() OVER (PARTITION BY v.conv_id, v.turn // 3 ORDER BY v.turn) AS k FROM conversations v LEFT JOIN curve USING (conv_id, turn))
SELECT conv_id, part::INT AS part, sha256(string_agg(line, chr(10) ORDER BY turn)) AS content_hash, count(*) AS n_turns, sum(tokens)::BIGINT AS n_tokens, round(CASE WHEN count(*) > 1 THEN avg(CASE WHEN k > 1 THEN score END) ELSE 1.0 END, 6) AS mean_coherence FROM p GROUP BY 1, 2""")
def w7_built_segments(spark, sf):
    roles = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    turns = curve(spark, sf).join(roles, ["conv_id", "turn"]).select("conv_id", F.floor(F.col("turn") / 3).cast("int").alias("part"), "turn", F.concat("role", F.lit(": "), "text").alias("line"), F.size(F.split("text", " ")).alias("tokens"), "score")
    return O.built(turns, ["conv_id", "part"], "turn", "line", "tokens", "score").select("conv_id", "part", F.sha2("text", 256).alias("content_hash"), "n_turns", "n_tokens", F.round("mean_coherence", 6).alias("mean_coherence"))


DEPTH = f"""WITH {CURVE}, a AS (SELECT *, coalesce((lag(score) OVER w < score)::INT, 0) AS l, coalesce((lead(score) OVER w < score)::INT, 0) AS r FROM curve WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT *, sum(l) OVER (PARTITION BY conv_id ORDER BY turn) AS lg, sum(r) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rg FROM a),
d AS (SELECT conv_id, turn, (max(score) OVER (PARTITION BY conv_id, lg ORDER BY turn) + max(score) OVER (PARTITION BY conv_id, rg ORDER BY turn DESC) - 2 * score) / 2 AS depth FROM b)"""


@query(DEPTH + " SELECT conv_id, turn, round(depth, 9) AS depth FROM d")
def w2_texttiling_depth(spark, sf):
    return O.depths(curve(spark, sf).where("score IS NOT NULL"), "conv_id", "turn", "score").select("conv_id", "turn", F.round("depth", 9).alias("depth"))


@query(DEPTH + " SELECT conv_id, turn, depth > avg(depth) OVER (PARTITION BY conv_id) + 0.5 * stddev_pop(depth) OVER (PARTITION BY conv_id) AS is_boundary FROM d")
def w3_boundaries(spark, sf):
    return O.boundaries(curve(spark, sf).where("score IS NOT NULL"), "conv_id", "turn", "score", 0.5).select("conv_id", "turn", "is_boundary")


@query()
def w5_w6_segments(spark, sf):
    turns = curve(spark, sf).select("conv_id", "turn", "score", F.size(F.split("text", " ")).alias("tokens"))
    return O.segments(turns, "conv_id", "turn", min_tokens=12, max_tokens=400)


GAP = f"""WITH {OBSERVATIONS}, g AS (SELECT *, max(predicted_quality) OVER (PARTITION BY segment_id) AS best_quality FROM obs),
e AS (SELECT *, greatest(0.0, best_quality - predicted_quality) AS gap, greatest(0.0, best_quality - predicted_quality) + 0.01 <= 0.10 + 1e-12 AS eligible, abs(predicted_quality - best_quality) <= 1e-12 AS is_best, segment_id % 97 = 3 AS ood FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY CASE WHEN is_best THEN 0 ELSE 1 END, cost, model_id) AS rb, row_number() OVER (PARTITION BY segment_id ORDER BY CASE WHEN eligible THEN 0 ELSE 1 END, cost, -predicted_quality, model_id) AS re FROM e),
d0 AS (SELECT segment_id, max(best_quality) AS best_quality, bool_or(ood) AS segment_ood, max(CASE WHEN rb = 1 THEN model_id END) AS best_model, max(CASE WHEN rb = 1 THEN cost END) AS best_cost, max(CASE WHEN re = 1 AND eligible THEN model_id END) AS cheap, max(CASE WHEN re = 1 AND eligible THEN cost END) AS cheap_cost,
  string_agg(CASE WHEN eligible THEN model_id::VARCHAR END, ',' ORDER BY model_id::VARCHAR) AS ids, string_agg(model_id || ':' || round(gap * 1000)::BIGINT, ',' ORDER BY model_id) AS gaps, string_agg(model_id || ':' || round((gap + 0.01) * 1000)::BIGINT, ',' ORDER BY model_id) AS upper_bounds FROM r GROUP BY 1),
d1 AS (SELECT *, CASE WHEN segment_ood THEN 'ood_predicted_best' WHEN best_quality < 0.2 THEN 'below_quality_floor_predicted_best' WHEN cheap IS NULL THEN 'no_robust_candidate_predicted_best' ELSE 'cheapest_model_within_quality_tolerance' END AS reason FROM d0),
dec AS (SELECT segment_id, best_quality, best_model, segment_ood, reason, gaps, upper_bounds, CASE WHEN reason LIKE 'cheapest%' THEN cheap ELSE best_model END AS selected_model, CASE WHEN reason LIKE 'cheapest%' THEN cheap_cost ELSE best_cost END AS selected_cost, CASE WHEN reason LIKE 'cheapest%' THEN ids ELSE best_model::VARCHAR END AS eligible_models FROM d1)"""


def gap_decisions(spark, sf):
    """Observations, and decisions on them where every 97th segment is out of distribution."""
    o = D.checked(observations(spark, sf))
    return o, D.gap_decision(o, 0.10, 0.01, 0.2, o.where("segment_id % 97 = 3").select("segment_id"))


def listed(gaps: str):
    """A map of gaps as model:thousandths, in order of the model."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(gaps)), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), F.round(x["value"] * 1000).cast("long").cast("string"))), ",").alias(gaps)


@query(GAP + " SELECT * FROM dec")
def w10_gap_decision(spark, sf):
    d = gap_decisions(spark, sf)[1]
    return d.select(*[listed(c) if c in ("gaps", "upper_bounds") else c for c in d.columns])


OUTCOMES = """, top AS (SELECT segment_id, max(actual_quality) AS top, max(cost) AS dearest FROM obs GROUP BY 1),
orc AS (SELECT segment_id, model_id AS oracle_model FROM (SELECT obs.*, row_number() OVER (PARTITION BY obs.segment_id ORDER BY cost, -actual_quality, model_id) AS k FROM obs JOIN top USING (segment_id) WHERE top - actual_quality <= {epsilon} + 1e-12) WHERE k = 1),
x AS (SELECT greatest(0.0, top - actual_quality) AS regret, actual_quality AS quality, top, cost, dearest, selected_model = oracle_model AS agrees FROM dec JOIN obs ON obs.segment_id = dec.segment_id AND obs.model_id = selected_model JOIN top ON top.segment_id = dec.segment_id JOIN orc ON orc.segment_id = dec.segment_id)"""
METRICS = """count(*) AS n, round(avg(quality), 6) AS mean_selected_quality, round(avg(top), 6) AS mean_oracle_quality, round(avg(regret), 6) AS mean_regret, round(avg((regret > 0.05 + 1e-12)::INT), 6) AS violation_rate,
round(sum(cost), 2) AS total_selected_cost, round(sum(dearest), 2) AS total_highest_cost, round(1 - sum(cost) / sum(dearest), 6) AS cost_saving, round(avg(agrees::INT), 6) AS oracle_agreement"""


@query(GAP + OUTCOMES.format(epsilon="0.10") + f" SELECT {METRICS}, round(quantile_cont(regret, 0.5), 6) AS median_regret, round(quantile_cont(regret, 0.9), 6) AS p90_regret, round(quantile_cont(regret, 0.95), 6) AS p95_regret FROM x")
def a5_gap_evaluation(spark, sf):
    return D.evaluate(*gap_decisions(spark, sf), 0.05, 0.10)


@query(GAP + " SELECT 'model' AS kind, selected_model::VARCHAR AS value, count(*) AS n FROM dec GROUP BY 2 UNION ALL SELECT 'reason', reason, count(*) FROM dec GROUP BY 2")
def a5_decision_counts(spark, sf):
    return D.decision_counts(gap_decisions(spark, sf)[1])


@query(f"""WITH {OBSERVATIONS}, r AS (SELECT greatest(0.0, max(actual_quality) OVER w - actual_quality) - greatest(0.0, max(predicted_quality) OVER w - predicted_quality) AS r FROM obs WINDOW w AS (PARTITION BY segment_id)),
n AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS k, count(*) OVER () AS n FROM r) SELECT round(greatest(0.0, min(r)), 9) AS residual_bound FROM n WHERE k >= ceil(0.95 * (n - 1))""")
def a6_residual_bound(spark, sf):
    return D.residual_bound(observations(spark, sf), 0.95).select(F.round("residual_bound", 9).alias("residual_bound"))


@query(f"""WITH {OBSERVATIONS}, top AS (SELECT segment_id, max(actual_quality) AS top, max(cost) AS dearest, max(predicted_quality) AS best FROM obs GROUP BY 1), grid AS (SELECT unnest([0.0, 0.05, 0.1, 0.2]) AS epsilon),
g AS (SELECT epsilon::DOUBLE AS epsilon, obs.*, top, dearest, greatest(0.0, best - predicted_quality) + 0.01 <= epsilon + 1e-12 AND best >= 0.2 AS eligible, abs(best - predicted_quality) <= 1e-12 AS is_best FROM obs JOIN top USING (segment_id), grid),
s AS (SELECT *, row_number() OVER (PARTITION BY epsilon, segment_id ORDER BY CASE WHEN eligible THEN 0 ELSE 1 END, CASE WHEN eligible THEN 0 WHEN is_best THEN 1 ELSE 2 END, cost, CASE WHEN eligible THEN -predicted_quality ELSE 0 END, model_id) AS k, row_number() OVER (PARTITION BY epsilon, segment_id ORDER BY CASE WHEN top - actual_quality <= epsilon + 1e-12 THEN 0 ELSE 1 END, cost, -actual_quality, model_id) AS o FROM g),
x AS (SELECT s.epsilon, greatest(0.0, s.top - s.actual_quality) AS regret, s.actual_quality AS quality, s.top, s.cost, s.dearest, s.model_id = t.model_id AS agrees FROM s JOIN s t ON s.epsilon = t.epsilon AND s.segment_id = t.segment_id AND t.o = 1 WHERE s.k = 1),
m AS (SELECT epsilon, {METRICS} FROM x GROUP BY 1), f AS (SELECT *, mean_regret <= 0.4 + 1e-12 AND violation_rate <= 0.9 + 1e-12 AS feasible FROM m)
SELECT *, feasible AND epsilon = (SELECT max(epsilon) FROM f WHERE feasible) AS chosen FROM f""")
def a7_calibration_sweep(spark, sf):
    return D.calibrate(D.checked(observations(spark, sf)), [0.0, 0.05, 0.1, 0.2], 0.05, 0.4, 0.9, 0.01, 0.2)


@query(f"WITH {OBSERVATIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY cost, -actual_quality, model_id) AS k FROM (SELECT *, max(actual_quality) OVER (PARTITION BY segment_id) AS top FROM obs) WHERE top - actual_quality <= 0.05 + 1e-12) SELECT segment_id, model_id AS oracle_model, cost AS oracle_cost FROM r WHERE k = 1")
def w11_epsilon_oracle(spark, sf):
    o = observations(spark, sf).withColumn("predicted_quality", F.col("actual_quality"))
    return D.gap_decision(o, 0.05).select("segment_id", F.col("selected_model").alias("oracle_model"), F.col("selected_cost").alias("oracle_cost"))


@query()
def g1_budget(spark, sf):
    o = observations(spark, sf).withColumn("sample_id", F.floor(F.col("segment_id") / 40))
    return D.budget(o.withColumn("cost", F.ceil(F.col("cost") / 10000.0).cast("double")), "sample_id", 200.0)


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS w FROM lineitem GROUP BY 1, 2), s AS (SELECT *, 1000 * w / sum(w) OVER (PARTITION BY l_orderkey) AS share FROM r),
k AS (SELECT *, 1000 - sum(floor(share)) OVER (PARTITION BY l_orderkey) AS rest, row_number() OVER (PARTITION BY l_orderkey ORDER BY share - floor(share) DESC, l_linenumber) AS n FROM s)
SELECT l_orderkey, l_linenumber, (floor(share) + CASE WHEN n <= rest THEN 1 ELSE 0 END)::BIGINT AS allocated FROM k""")
def w17_largest_remainder(spark, sf):
    r = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("w")).withColumn("total", F.lit(1000))
    return O.largest_remainder(r, "l_orderkey", "l_linenumber", "w", "total").select("l_orderkey", "l_linenumber", "allocated")


PACK = """WITH RECURSIVE o AS (SELECT source, doc_id, n_chars AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
p AS (SELECT source, doc_id, t, k, 0::BIGINT AS batch_no, 1 AS n, t AS s, t + 100 > 12000 AS closed FROM o WHERE k = 1 UNION ALL
SELECT o.source, o.doc_id, o.t, o.k, p.batch_no + (p.closed OR o.t + 100 > 12000 OR p.n >= 8 OR p.s + o.t + 100 > 12000)::INT, CASE WHEN p.closed OR o.t + 100 > 12000 OR p.n >= 8 OR p.s + o.t + 100 > 12000 THEN 1 ELSE p.n + 1 END,
CASE WHEN p.closed OR o.t + 100 > 12000 OR p.n >= 8 OR p.s + o.t + 100 > 12000 THEN o.t ELSE p.s + o.t END, o.t + 100 > 12000 FROM p JOIN o ON o.source = p.source AND o.k = p.k + 1)"""


@query(PACK + " SELECT source, doc_id, batch_no FROM p")
def w20_buffer_packing(spark, sf):
    return O.pack(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id", "n_chars", 8, 12000, 100).select("source", "doc_id", "batch_no")


SMALL = "least(n_chars, 6000)"
TWO_LIMITS = PACK.replace("n_chars AS t", f"{SMALL} AS t")
for _old, _new in (("o.t + 100 > 12000", "o.t + 100 > 5000"), ("p.n >= 8 OR p.s + o.t + 100 > 5000", "p.n >= 8 OR p.s + o.t + 100 > 5000 OR p.s + o.t + 100 + (p.n + 1) * 700 > 7000"), ("t + 100 > 12000 AS closed", "t + 100 > 5000 AS closed")):
    TWO_LIMITS = TWO_LIMITS.replace(_old, _new)


@query(TWO_LIMITS + " SELECT source, doc_id, batch_no FROM p")
def w20_two_limits(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.least("n_chars", F.lit(6000)).alias("n_chars"))
    return O.pack(d, ["source"], "doc_id", "n_chars", 8, 5000, 100, reserve=700, max_total=7000).select("source", "doc_id", "batch_no")


@query(PACK + " SELECT source, count(DISTINCT batch_no) AS n_batches, (sum(t) + 100 * count(DISTINCT batch_no))::BIGINT AS input_tokens, round((sum(t) + 100 * count(DISTINCT batch_no)) * 0.287 / 1000000, 9) AS input_cost FROM p GROUP BY 1")
def w21_cost_replay(spark, sf):
    p = O.pack(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id", "n_chars", 8, 12000, 100)
    tokens = F.sum("n_chars") + 100 * F.count_distinct("batch_no")
    return p.groupBy("source").agg(F.count_distinct("batch_no").alias("n_batches"), tokens.alias("input_tokens"), F.round(tokens * 0.287 / 1000000, 9).alias("input_cost"))


@query("""WITH r AS (SELECT user_id, event_type AS run, count(DISTINCT event_id % 3) AS n_items, min(event_id) AS f FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f DESC) AS k FROM r WHERE n_items >= 2) SELECT user_id, run, n_items FROM k WHERE k = 1""")
def w23_latest_complete_run(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("run"), (F.col("event_id") % 3).alias("item"), "event_id")
    return O.latest_complete(e, "user_id", "run", "item", "event_id", 2)


@query("""WITH e AS (SELECT user_id, event_type AS run, event_id % 4 AS item, min(event_id) AS seq FROM events GROUP BY ALL), x AS (SELECT DISTINCT user_id, event_id % 4 AS item FROM events WHERE event_id % 4 < 2),
c AS (SELECT user_id, run, min(seq) AS began FROM e GROUP BY 1, 2), h AS (SELECT user_id, run, count(*) AS n FROM e JOIN x USING (user_id, item) GROUP BY 1, 2), w AS (SELECT user_id, count(*) AS n FROM x GROUP BY 1),
b AS (SELECT user_id, arg_max(run, began) AS run FROM h JOIN w USING (user_id, n) JOIN c USING (user_id, run) GROUP BY 1)
SELECT user_id, run, item, seq FROM e JOIN x USING (user_id, item) JOIN b USING (user_id, run)""")
def w23_latest_run(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("run"), (F.col("event_id") % 4).alias("item"), "event_id")
    return O.latest_run(e.groupBy("user_id", "run", "item").agg(F.min("event_id").alias("seq")), "user_id", "run", ["item"], "seq", e.where("item < 2"))


@query("""WITH o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type, value::BIGINT ORDER BY event_id) AS d, value::BIGINT AS v FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS rank FROM o WHERE d = 1) SELECT user_id, event_id, rank::INT AS rank FROM k WHERE rank <= 15""")
def w12_w13_dedup_rank(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.rint("value").cast("bigint").alias("v"))
    return O.dedup_rank(e, "user_id", ["event_type", "v"], ["event_type", "event_id"], 15).select("user_id", "event_id", "rank")


@query("SELECT source, doc_id, turn::INT AS turn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 150")
def w14_round_robin(spark, sf):
    return O.round_robin(table(spark, sf, "documents").select("source", "doc_id"), "source", ["doc_id"], 150)


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY sha256('seed42|' || l_orderkey || '|' || l_linenumber))::INT AS position FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def w28_anonymous_order(spark, sf):
    return O.shuffled(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber", "seed42")


LABELS = """c AS (SELECT l_orderkey AS k, l_linenumber AS m, count(*) AS n, sum((l_returnflag = 'A')::INT) AS s, sum((l_returnflag = 'N')::INT) AS p,
sum(((l_linestatus = 'O' OR l_tax >= 0.04) AND l_quantity >= 30)::INT) AS f, sum(((l_linestatus = 'O' OR l_tax >= 0.04) AND l_quantity < 30)::INT) AS pt, sum((l_linestatus <> 'O' AND l_tax >= 0.04)::INT) AS it, sum((l_linestatus <> 'O')::INT) AS tt FROM lineitem GROUP BY 1, 2),
x AS (SELECT k, m, s / n::DOUBLE AS sp, (s + 0.5 * p) / n AS fp, f / n::DOUBLE AS sr, (f + 0.5 * pt) / n AS pr, CASE WHEN tt = 0 THEN NULL ELSE it / tt::DOUBLE END AS tr FROM c)"""


@query(f"WITH {LABELS} SELECT k AS l_orderkey, m AS l_linenumber, sp AS strict_precision, fp AS soft_precision, sr AS strict_recall, pr AS partial_recall, tr AS temporal_recall, round(CASE WHEN sp + sr = 0 THEN 0.0 ELSE 2 * sp * sr / (sp + sr) END, 9) AS f1, round(CASE WHEN 4 * fp + pr = 0 THEN 0.0 ELSE 5 * fp * pr / (4 * fp + pr) END, 9) AS f2 FROM x")
def a1_quality_label(spark, sf):
    l, key = table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]
    c = l.select(*key, F.when(F.col("l_returnflag") == "A", "SUPPORTED").when(F.col("l_returnflag") == "N", "PARTIALLY_SUPPORTED").otherwise("UNSUPPORTED").alias("semantic_status"))
    g = l.select(*key, F.when(F.col("l_quantity") >= 30, "FULL").otherwise("PARTIAL").alias("coverage_status"), F.when(F.col("l_linestatus") == "O", "NOT_APPLICABLE").when(F.col("l_tax") >= 0.04, "PASS").otherwise("FAIL").alias("time_status"))
    return A.quality_label(c, g, key).withColumns({"f1": F.round("f1", 9), "f2": F.round("f2", 9)})


@query("""WITH c AS (SELECT l_suppkey, sum((l_returnflag = 'A')::INT)::BIGINT AS tp, sum((l_returnflag = 'N')::INT)::BIGINT AS fp, sum((l_returnflag = 'R')::INT)::BIGINT AS fn FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn)::DOUBLE END AS recall, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1,
CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 5.0 * tp / (5.0 * tp + 4.0 * fn + fp)::DOUBLE END AS f_beta, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE tp / (tp + fp + fn)::DOUBLE END AS jaccard, CASE WHEN tp + fp = 0 THEN 0.0 ELSE fp / (tp + fp)::DOUBLE END AS false_discovery_rate, CASE WHEN tp + fn = 0 THEN 0.0 ELSE fn / (tp + fn)::DOUBLE END AS false_negative_rate, (fp = 0 AND fn = 0)::INT::DOUBLE AS exact_match FROM c""")
def a2_set_metrics(spark, sf):
    flag = F.col("l_returnflag")
    c = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(flag == "A").alias("tp"), F.count_if(flag == "N").alias("fp"), F.count_if(flag == "R").alias("fn"))
    return A.set_metrics(c, ["l_suppkey"], 2.0)


@query("WITH o AS (SELECT event_type AS grp, user_id AS segment, event_id % 200 AS question, max((value > 50)::INT) AS ok FROM events GROUP BY 1, 2, 3) SELECT grp, segment, count(*) AS n_questions, round(avg(ok), 6) AS accuracy FROM o GROUP BY 1, 2")
def a3_segment_usage(spark, sf):
    return A.usage(table(spark, sf, "events").withColumn("q", F.col("event_id") % 200), "event_type", "user_id", "q", F.col("value") > 50)


@query("""WITH p AS (SELECT c_acctbal0 AS x, y FROM (SELECT o_custkey, round(avg(o_totalprice) - 150000, 0) AS c_acctbal0, count(*) - 10 AS y FROM orders GROUP BY 1)),
r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p)
SELECT round(coalesce(avg(CASE WHEN x <> 0 AND y <> 0 THEN (sign(x) = sign(y))::INT END), 0), 6) AS sign_agreement, round(coalesce(corr(rx, ry), 0), 6) AS spearman FROM r""")
def a4_consistency(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.avg("o_totalprice") - 150000, 0).alias("x"), (F.count("*") - 10).alias("y"))
    return A.consistency(o, "x", "y")


@query("""WITH e AS (SELECT value > 50 AS correct, event_type AS category, (user_id % 4)::VARCHAR AS kind FROM events), g AS (SELECT grouping(category) AS gc, grouping(kind) AS gk, category, kind, count(*) AS n, avg(correct::INT) AS a FROM e GROUP BY GROUPING SETS ((), (category), (kind)))
SELECT CASE WHEN gc = 0 THEN 'category' WHEN gk = 0 THEN 'kind' ELSE 'overall' END AS grouping, CASE WHEN gc = 0 THEN category WHEN gk = 0 THEN kind ELSE 'all' END AS value, n AS n_questions, round(a, 6) AS accuracy, round(sqrt(a * (1 - a)), 6) AS deviation FROM g""")
def a15_outcome_summary(spark, sf):
    e = table(spark, sf, "events").select((F.col("value") > 50).alias("correct"), F.col("event_type").alias("category"), (F.col("user_id") % 4).cast("string").alias("kind"))
    return A.outcome_summary(e, "category", "kind")


@query("WITH f AS (SELECT user_id % 5 AS fold, avg((value > 50)::INT) AS a FROM events GROUP BY 1) SELECT round(avg(a), 6) AS mean, round(coalesce(stddev_samp(a), 0), 6) AS deviation, round(coalesce(stddev_samp(a), 0) / sqrt(count(*)), 6) AS error, round(min(a), 6) AS lowest, round(max(a), 6) AS highest FROM f")
def a16_fold_accuracy(spark, sf):
    f = table(spark, sf, "events").groupBy(F.col("user_id") % 5).agg(F.avg((F.col("value") > 50).cast("int")).alias("a"))
    s = F.coalesce(F.stddev_samp("a"), F.lit(0.0))
    return f.agg(F.round(F.avg("a"), 6).alias("mean"), F.round(s, 6).alias("deviation"), F.round(s / F.sqrt(F.count("*")), 6).alias("error"), F.round(F.min("a"), 6).alias("lowest"), F.round(F.max("a"), 6).alias("highest"))


@query("""SELECT 'l_discount' AS feature, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS scale FROM lineitem UNION ALL SELECT 'l_quantity', round(avg(l_quantity), 6), round(stddev_pop(l_quantity), 6) FROM lineitem UNION ALL SELECT 'l_tax', round(avg(l_tax), 6), round(stddev_pop(l_tax), 6) FROM lineitem""")
def a26_scaler(spark, sf):
    return A.scaler(table(spark, sf, "lineitem"), ["l_discount", "l_quantity", "l_tax"])


#: Line items as attempts: an order is a batch, a line a call; and the same in SQL.
ATTEMPTS = """att AS (SELECT l_returnflag AS tier, l_orderkey AS batch_id, l_linenumber % 3 AS idx, CASE l_linenumber WHEN 2 THEN 'schema_repair' WHEN 3 THEN 'fallback_singleton' WHEN 4 THEN 'terminal_recovery_singleton' ELSE 'primary' END AS kind, CASE WHEN l_linestatus = 'F' THEN 'failed' ELSE 'succeeded' END AS status,
CASE WHEN l_linenumber = 5 THEN 'unknown' WHEN l_linenumber = 6 THEN 'estimated' ELSE 'known' END AS cost_status, CASE WHEN l_linenumber <> 7 THEN l_quantity::BIGINT END AS tin, (l_quantity::BIGINT * 2) AS tout, l_extendedprice AS ci, l_tax AS co FROM lineitem)"""


def attempts(spark, sf):
    n = F.col("l_linenumber")
    kind = F.when(n == 2, "schema_repair").when(n == 3, "fallback_singleton").when(n == 4, "terminal_recovery_singleton").otherwise("primary")
    cost = F.when(n == 5, "unknown").when(n == 6, "estimated").otherwise("known")
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("tier"), F.col("l_orderkey").alias("batch_id"), (n % 3).alias("logical_call_index"), kind.alias("call_type"), F.when(F.col("l_linestatus") == "F", "failed").otherwise("succeeded").alias("status"), cost.alias("cost_status"), F.when(n != 7, F.round("l_quantity").cast("long")).alias("input_tokens"), (F.round("l_quantity").cast("long") * 2).alias("output_tokens"), F.col("l_extendedprice").alias("input_cost"), F.col("l_tax").alias("output_cost"))


@query(f"""WITH {ATTEMPTS}, k AS (SELECT *, CASE WHEN cost_status <> 'unknown' THEN ci + co ELSE 0 END AS known, kind IN ('fallback_singleton', 'terminal_recovery_singleton') AS fb, status = 'succeeded' AND tin IS NOT NULL AS done FROM att),
r AS (SELECT coalesce(tier, 'total') AS tier, count(DISTINCT batch_id * 10 + idx) AS logical_api_calls, sum((status = 'succeeded')::INT)::BIGINT AS successful_attempts, sum((status = 'failed')::INT)::BIGINT AS failed_attempts, sum((cost_status = 'unknown')::INT)::BIGINT AS unknown_cost_attempts, coalesce(sum(CASE WHEN done THEN tin END), 0)::BIGINT AS input_tokens, coalesce(sum(CASE WHEN done THEN tout END), 0)::BIGINT AS output_tokens, sum(known) AS known_cost,
count(DISTINCT CASE WHEN fb THEN batch_id * 10 + idx END) AS fallback_calls, sum(CASE WHEN fb THEN known ELSE 0 END) AS fallback_cost, count(DISTINCT CASE WHEN kind LIKE 'terminal%' THEN batch_id * 10 + idx END) AS terminal_recovery_calls, sum(CASE WHEN kind LIKE 'terminal%' THEN known ELSE 0 END) AS terminal_recovery_cost, count(DISTINCT CASE WHEN kind = 'schema_repair' THEN batch_id * 10 + idx END) AS repair_calls, sum(CASE WHEN kind = 'schema_repair' THEN known ELSE 0 END) AS schema_repair_cost FROM k GROUP BY ROLLUP (tier))
SELECT * REPLACE (round(known_cost, 2) AS known_cost, round(fallback_cost, 2) AS fallback_cost, round(terminal_recovery_cost, 2) AS terminal_recovery_cost, round(schema_repair_cost, 2) AS schema_repair_cost), input_tokens + output_tokens AS total_tokens, round(known_cost - fallback_cost, 2) AS primary_cost FROM r""")
def a11_cost_rollup(spark, sf):
    got = A.attempt_costs(attempts(spark, sf))
    return got.select(*[F.round(c, 2).alias(c) if c.endswith("_cost") else c for c in got.columns])


@query(f"""WITH {ATTEMPTS}, s AS (SELECT count(*) AS total_segment_results, sum((l_suppkey % 7 = 2)::INT)::BIGINT AS empty_fact_segments, sum((l_quantity >= CASE l_returnflag WHEN 'A' THEN 40 WHEN 'N' THEN 45 ELSE 50 END)::INT)::BIGINT AS saturated_segments FROM lineitem),
b AS (SELECT count(*) AS total_batches, sum((o_orderstatus NOT IN ('F', 'O'))::INT)::BIGINT AS failed_batches, sum((o_orderstatus = 'O')::INT)::BIGINT AS recovered_batches FROM orders), a AS (SELECT count(DISTINCT batch_id) AS repair_batches FROM att WHERE kind = 'schema_repair'),
x AS (SELECT *, round(empty_fact_segments / total_segment_results, 6) AS empty_fact_segment_rate, round(saturated_segments / total_segment_results, 6) AS saturated_segment_rate, round(repair_batches / total_batches, 6) AS repair_batch_rate, round(failed_batches / total_batches, 6) AS failed_batch_rate, round(recovered_batches / total_batches, 6) AS fallback_recovery_rate FROM s, b, a)
SELECT *, concat_ws(',', CASE WHEN empty_fact_segment_rate > 0.05 THEN 'empty_fact_segment_rate' END, CASE WHEN failed_batch_rate > 0 THEN 'failed_batch_rate' END, CASE WHEN repair_batch_rate > 1 THEN 'repair_batch_rate' END, CASE WHEN saturated_segment_rate > 1 THEN 'saturated_segment_rate' END) AS violations, empty_fact_segment_rate <= 0.05 AND failed_batch_rate <= 0 AND repair_batch_rate <= 1 AND saturated_segment_rate <= 1 AS passed FROM x""")
def a10_extraction_quality(spark, sf):
    segments = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("tier"), F.when(F.col("l_suppkey") % 7 == 2, "no_fact").otherwise("committed").alias("status"), F.col("l_quantity").alias("fact_count"))
    status = F.when(F.col("o_orderstatus") == "F", "committed").when(F.col("o_orderstatus") == "O", "recovered_by_fallback").otherwise("failed")
    return A.extraction_quality(segments, table(spark, sf, "orders").select(status.alias("status")), attempts(spark, sf), {"A": 40, "N": 45, "R": 50}, {"empty_fact_segment_rate": 0.05})


@query("SELECT conv_id, turn, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS match_key FROM conversations")
def p17_match_key(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.match_key(F.col("text")).alias("match_key"))


@query("SELECT user_id, sum((event_type = 'click')::INT)::BIGINT AS click, sum((event_type = 'error')::INT)::BIGINT AS error, sum((event_type = 'purchase')::INT)::BIGINT AS purchase FROM events GROUP BY 1")
def a25_state_summary(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase"]).count().fillna(0)


@query("""WITH old AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), new AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.user_id = new.user_id AND old.event_type = new.event_type)""")
def k5_append_ledger(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    old = e.where("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return S.append_new(old, e, ["user_id", "event_type"], ["event_id"])


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def k6_upsert_ledger(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return S.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query("SELECT * FROM (SELECT user_id, event_type, event_id FROM events WHERE event_id % 3 <> 0) a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.event_id % 3 = 0 AND b.user_id = a.user_id) UNION ALL SELECT user_id, event_type, event_id FROM events WHERE event_id % 3 = 0")
def k8_replace_scope(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return S.replace_scope(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0"), ["user_id"])


@query("WITH a AS (SELECT user_id, event_type, count(*) AS n_a FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT user_id, event_type, count(*) AS n_b FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) SELECT user_id, event_type, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b USING (user_id, event_type) WHERE coalesce(n_a, 0) <> coalesce(n_b, 0)")
def o4_multiset_difference(spark, sf):
    e = table(spark, sf, "events")
    return S.multiset_difference(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"])


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, p.vec_id AS point_id, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) AS score FROM q JOIN embeddings p ON p.label = q.label),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM s) SELECT query_id, point_id, round(score, 6) AS score, rank::INT AS rank FROM k WHERE rank <= 20""")
def v3_filtered_knn(spark, sf):
    e = table(spark, sf, "embeddings")
    found = S.knn(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("point_id"), "label", F.col("embedding").alias("v")), "label", 20)
    return found.select("query_id", "point_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3")
def j12_close_pairs(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("point_id"), F.col("embedding").alias("v"))
    return S.close_pairs(e, "label", 0.3).withColumn("score", F.round("score", 6))


@query("SELECT label, count(*) AS n FROM embeddings WHERE label % 2 = 0 GROUP BY 1")
def v4_filtered_count(spark, sf):
    return table(spark, sf, "embeddings").where("label % 2 = 0").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS preceding FROM conversations")
def j19_preceding_turn(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")), F.lit("")).alias("preceding"))


@query("""WITH s AS (SELECT DISTINCT user_id % 3 AS part, event_type || (event_id % 50)::VARCHAR AS session FROM events) SELECT a.part AS a, b.part AS b, count(*) AS n_shared FROM s a JOIN s b ON a.session = b.session AND a.part < b.part GROUP BY 1, 2""")
def j13_partition_overlap(spark, sf):
    s = table(spark, sf, "events").select((F.col("user_id") % 3).alias("part"), F.concat("event_type", (F.col("event_id") % 50).cast("string")).alias("session")).distinct()
    return s.select(F.col("part").alias("a"), "session").join(s.select(F.col("part").alias("b"), "session"), "session").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_shared"))


@query("""WITH RECURSIVE l AS (SELECT 'd' || doc_id AS u, 'p' || md5(text) AS v FROM documents UNION SELECT 'd' || doc_id, 's' || length(text) FROM documents), e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT DISTINCT u AS node, u AS g FROM e UNION SELECT e.v, r.g FROM r JOIN e ON e.u = r.node) SELECT node, min(g) AS group_id FROM r GROUP BY 1""")
def g2_evidence_groups(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("u"), "text")
    links = d.select("u", F.concat(F.lit("p"), F.md5("text")).alias("v")).union(d.select("u", F.concat(F.lit("s"), F.length("text").cast("string")).alias("v")))
    return S.evidence_groups(links)


@query("""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), q AS (SELECT quantile_disc(n, 0.25) AS a, quantile_disc(n, 0.5) AS b, quantile_disc(n, 0.75) AS c FROM n) SELECT o_custkey, CASE WHEN n <= a THEN 0 WHEN n <= b THEN 1 WHEN n <= c THEN 2 ELSE 3 END AS bin FROM n, q""")
def w27_quartile_bins(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    q = n.agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n)").alias(c) for p, c in ((0.25, "a"), (0.5, "b"), (0.75, "c"))])
    return n.crossJoin(F.broadcast(q)).select("o_custkey", F.when(F.col("n") <= F.col("a"), 0).when(F.col("n") <= F.col("b"), 1).when(F.col("n") <= F.col("c"), 2).otherwise(3).alias("bin"))


@query("""SELECT 'missing_customer' AS code, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'duplicate_line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'bad_discount', count(*) FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 1 UNION ALL SELECT 'order_without_lines', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def q1_audit(spark, sf):
    o, l, c = (table(spark, sf, n) for n in ("orders", "lineitem", "customer"))
    rules = {
        "missing_customer": o.join(c, o.o_custkey == c.c_custkey, "left_anti"), "duplicate_line": l.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
        "bad_discount": l.where("l_discount < 0 OR l_discount > 1"), "order_without_lines": o.join(l, o.o_orderkey == l.l_orderkey, "left_anti"),
    }
    out = None
    for code, rows in rules.items():
        one = rows.agg(F.lit(code).alias("code"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT DISTINCT substr(sha256('review|' || doc_id || '|' || source), 1, 20) AS review_id, doc_id FROM documents WHERE n_chars > 3000")
def q5_review_queue(spark, sf):
    return table(spark, sf, "documents").where("n_chars > 3000").select(F.substring(F.sha2(F.concat_ws("|", F.lit("review"), F.col("doc_id").cast("string"), "source"), 256), 1, 20).alias("review_id"), "doc_id").dropDuplicates(["review_id"])


@query("SELECT l_orderkey, CASE WHEN sum(l_quantity) < 50 THEN 'small' WHEN sum(l_quantity) < 120 THEN 'medium' ELSE 'large' END AS tier FROM lineitem GROUP BY 1")
def g9_length_router(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(R.length_router(F.sum("l_quantity"), 50, 120).alias("tier"))


@query()
def g8_matching(spark, sf):
    l = table(spark, sf, "lineitem").select("l_partkey", "l_linenumber", F.pmod("l_suppkey", F.lit(7)).alias("fact"))
    return R.matching(l, "l_partkey", "l_linenumber", "fact")


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), p AS (SELECT user_id, k, greatest(0.0, 0.01 * (value - 50)) AS m FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, greatest(0.0, p.m + 0.01 * (o.value - 50)) FROM p JOIN o ON o.user_id = p.user_id AND o.k = p.k + 1)
SELECT user_id, round(arg_max(m, k), 6) AS multiplier FROM p GROUP BY 1""")
def g14_multiplier(spark, sf):
    costs = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"])
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(R.multiplier(costs, 50.0, 0.01), 6).alias("multiplier"))


@query("SELECT user_id, event_type, event_id AS epoch FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(value) DESC, event_id % 10, event_id) AS n FROM events WHERE event_id % 10 <= 7) WHERE n = 1")
def g14a_checkpoint_choice(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("epoch"), F.round("value").alias("score"), (F.col("event_id") % 10).alias("cost"))
    best = R.checkpoint_choice(e, "user_id", 7)
    return best.join(e.select("user_id", "epoch", "event_type"), ["user_id", "epoch"]).select("user_id", "event_type", "epoch")


@query("""WITH r AS (SELECT source, count(*) AS n, sum((n_chars < 200)::INT)::BIGINT AS n_empty, sum((n_chars > 8000)::INT)::BIGINT AS n_failed FROM documents GROUP BY 1)
SELECT source, n, n_empty, n_failed, round(n_empty / n, 6) AS empty_rate, round(n_failed / n, 6) AS failed_rate, CASE WHEN round(n_empty / n, 6) > 0.1 OR round(n_failed / n, 6) > 0.05 THEN 'quality_failed' ELSE 'complete' END AS state FROM r""")
def a9_campaign(spark, sf):
    d = table(spark, sf, "documents").select("source", (F.col("n_chars") < 200).alias("is_empty"), (F.col("n_chars") > 8000).alias("is_failed"), F.lit(True).alias("is_done"))
    return R.campaign(d, "source", 0.1, 0.05)


@query(f"SELECT conv_id, turn, CASE WHEN len({TOKENS}) <= 20 THEN text ELSE regexp_extract(text, '^(?:(?s:.*?)(?:[A-Za-z0-9_./+-]+|[\\x{{4e00}}-\\x{{9fff}}])){{20}}') END AS head FROM conversations")
def w25_truncate(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", R.truncate_tokens(F.col("text"), 20).alias("head"))


@query("SELECT event_id, event_type AS kind, upper(event_type) AS label, (json_extract_string(props, '$') IS NOT NULL) AS is_json FROM events")
def p26_json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"), F.upper("event_type").alias("label"), F.get_json_object("props", "$").isNotNull().alias("is_json"))


@query("""WITH a AS (SELECT DISTINCT l_orderkey FROM lineitem), b AS (SELECT o_orderkey FROM orders) SELECT coalesce(l_orderkey, o_orderkey) AS orderkey, CASE WHEN o_orderkey IS NULL THEN 'missing' ELSE 'extra' END AS state FROM a FULL JOIN b ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL OR o_orderkey IS NULL""")
def o1_missing_extra(spark, sf):
    a, b = table(spark, sf, "lineitem").select("l_orderkey").distinct(), table(spark, sf, "orders").select("o_orderkey")
    j = a.join(b, a.l_orderkey == b.o_orderkey, "full_outer").where("l_orderkey IS NULL OR o_orderkey IS NULL")
    return j.select(F.coalesce("l_orderkey", "o_orderkey").alias("orderkey"), F.when(F.col("o_orderkey").isNull(), "missing").otherwise("extra").alias("state"))


@query("SELECT conv_id, turn, CASE WHEN len(list_filter(regexp_split_to_array(text, '[。！？!?;\\n]+'), lambda s: contains(s, '必须') OR contains(s, '不要') OR contains(s, '不得') OR contains(s, 'only') OR contains(s, 'must') OR contains(s, 'should not'))) > 0 THEN true ELSE false END AS has_constraint FROM conversations")
def t14_constraints(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", (F.size(X.constraints(F.col("text"))) > 0).alias("has_constraint"))


@query("""SELECT p_type, p.p_partkey, sum(l_quantity * 0.287)::DOUBLE AS cost FROM lineitem JOIN (SELECT p_partkey, p_partkey % 3 AS p_type FROM part) p ON l_partkey = p.p_partkey GROUP BY 1, 2""")
def j17_price_join(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 3).alias("p_type"))
    return table(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "p_partkey").agg(F.sum(F.col("l_quantity") * 0.287).alias("cost"))


from talkmill.plans import audits, chains, deployment  # noqa: E402, F401  (they register their queries with the decorator above)
