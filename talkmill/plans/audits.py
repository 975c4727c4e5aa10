"""Queries of audits, splits, chunks and pooled vectors, with the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkmill.functions import records as P
from talkmill.functions import text as X
from talkmill.operators import audits as A
from talkmill.operators import reference_audit as RA
from talkmill.plans.registry import query
from talkmill.plans.tables import table
from talkmill.sources import stores as S


@query("""WITH a AS (SELECT user_id, count(*) AS n, min(event_type) AS first FROM events WHERE event_id % 3 > 0 GROUP BY 1), b AS (SELECT user_id, count(*) AS n, min(event_type) AS first FROM events WHERE event_id % 3 < 2 GROUP BY 1),
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, a.user_id AS ka, b.user_id AS kb, a.n AS an, b.n AS bn, a.first AS af, b.first AS bf FROM a FULL JOIN b ON a.user_id = b.user_id)
SELECT user_id, 'unknown_segment' AS problem FROM j WHERE kb IS NULL UNION ALL SELECT user_id, 'missing_segment' FROM j WHERE ka IS NULL UNION ALL SELECT user_id, 'n_differs' FROM j WHERE an <> bn UNION ALL SELECT user_id, 'first_differs' FROM j WHERE af <> bf""")
def q2_metadata(spark, sf):
    part = lambda where: table(spark, sf, "events").where(where).groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_type").alias("first"))
    return A.metadata_problems(part("event_id % 3 > 0"), part("event_id % 3 < 2"), ["user_id"], ["n", "first"])


@query("WITH g AS (SELECT user_id, count(DISTINCT event_type) AS n_stages, count(*) AS n_attempts FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT user_id, coalesce(n_stages, 0) AS n_stages, coalesce(n_attempts, 0) AS n_attempts, coalesce(n_attempts > n_stages, false) AS repaired FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN g USING (user_id)")
def q3_archive(spark, sf):
    e = table(spark, sf, "events")
    return A.archive_counts(e.where("event_id % 2 = 0"), e, "user_id", "event_type")


@query("SELECT event_type, count(*) AS n_rows, sum((value > 50)::INT)::BIGINT AS n_failed, round(avg((value > 50)::INT), 6) AS failure_rate FROM events GROUP BY 1")
def q4_ledger_audit(spark, sf):
    return A.ledger_audit(table(spark, sf, "events"), F.col("value") > 50, ["event_type"]).withColumn("failure_rate", F.round("failure_rate", 6))


@query("SELECT doc_id, n::INT AS n FROM (SELECT doc_id, len(regexp_extract_all(text, '(?i)(api[_-]?key|secret|token|password)\\s*[:=]\\s*[''\"]?[A-Za-z0-9_\\-]{12,}')) AS n FROM documents) WHERE n > 0")
def q11_secrets(spark, sf):
    return A.secrets(table(spark, sf, "documents"), "doc_id", "text")


@query("""WITH m AS (SELECT user_id, count(DISTINCT event_type) AS n FROM events WHERE event_id % 5 = 0 GROUP BY 1), p AS (SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 0),
j AS (SELECT coalesce(m.user_id, p.user_id) AS user_id, CASE WHEN n IS NULL THEN 'uncovered' WHEN p.user_id IS NULL THEN 'unknown' WHEN n > 1 THEN 'overlap' END AS problem FROM m FULL JOIN p ON m.user_id = p.user_id) SELECT * FROM j WHERE problem IS NOT NULL""")
def g7_split_problems(spark, sf):
    e = table(spark, sf, "events")
    return A.split_problems(e.where("event_id % 5 = 0"), e.where("event_id % 2 = 0"), "user_id", "event_type")


@query("""WITH m AS (SELECT label, pos, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2)
SELECT label, pos::INT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""")
def v6_pooled(spark, sf):
    return A.pooled(table(spark, sf, "embeddings"), "label", "embedding").select("label", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("SELECT vec_id, 68::INT AS width, round(embedding[1]::DOUBLE + label + 1 + 2 + 3, 6) AS total FROM embeddings")
def v9_features(spark, sf):
    f = A.features(F.col("embedding"), [F.col("label"), F.lit(1)], [F.lit(2), F.lit(3)])
    tail = F.aggregate(F.slice(f, 65, 4), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf, "embeddings").select("vec_id", F.size(f).alias("width"), F.round(F.get(f, F.lit(0)) + tail, 6).alias("total"))


@query()
def v6_chunks(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.explode(A.chunks(X.tokens(F.col("text")), 32, 24)).alias("chunk"))


@query("SELECT event_type, count(*) AS n, '[' || string_agg('{\"event_id\":' || event_id || ',\"user_id\":' || user_id || '}', ',' ORDER BY event_id) || ']' AS points FROM events GROUP BY 1")
def k10_export(spark, sf):
    return S.export(table(spark, sf, "events"), ["event_type"], ["event_id", "user_id"], "event_id")


@query("SELECT event_id, user_id AS sample_id, event_type FROM events WHERE user_id = 1 AND event_type = 'click'")
def s15_v2_scroll(spark, sf):
    return S.scroll(table(spark, sf, "events").select("event_id", F.col("user_id").alias("sample_id"), "event_type"), 1, event_type="click")


def frozen(spark, sf):
    """Reference rows and segments made of conversations, a fact for each turn; places that follow from the ids break a rule each."""
    h, g = (F.col("conv_id") * 8 + F.col("turn")) % 29, F.col("conv_id") % 19
    body = F.when(h == 1, "").otherwise(F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))))
    source = F.when(h == 4, 999).otherwise(F.col("turn")).cast("long")
    facts = table(spark, sf, "conversations").select("conv_id", "turn", F.struct(
        F.col("turn").alias("at"), body.alias("text"), F.array(source).alias("sources"), F.when(h == 7, "dup").otherwise(P.fact_id(F.col("conv_id"), X.fact_key(body), F.array(source))).alias("id"),
        F.when(h == 2, "other").otherwise(body).alias("alias"), F.when(h == 3, " ").otherwise("said").alias("why"), F.when(h == 5, "x").otherwise("event").alias("type"),
        F.when(h == 6, "x").otherwise("current").alias("state"), F.when(h == 9, None).otherwise("o").alias("origin"), (h == 8).alias("misplaced"),
    ).alias("f"))
    convs = facts.groupBy("conv_id").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    n = F.size("fs")
    out = F.transform("fs", lambda f, i: F.struct(
        f["id"].alias("reference_fact_id"), f["text"].alias("fact_text"), f["alias"].alias("text"), f["sources"].alias("source_turn_ids"), f["type"].alias("fact_type"), f["state"].alias("state_status"),
        f["origin"].alias("origin"), f["why"].alias("grounding_reason"), F.when(f["misplaced"], 99).otherwise(i + 1).alias("selection_rank"),
    ))
    name, turns = F.col("conv_id").cast("string"), F.transform("fs", lambda f: f["at"].cast("long"))
    meta = [F.lit("d").alias("dataset_name"), F.lit("s").alias("split"), F.lit("p").alias("sample_id"), F.lit("q").alias("session_id"), name.alias("segment_id"), F.lit(1).alias("segment_order"), F.lit("m").alias("segmentation_method"), F.lit("v").alias("segmentation_version"), F.lit("h").alias("source_content_hash"), turns.alias("segment_turn_ids")]
    own = {"split": F.when(g == 4, "z").otherwise("s"), "segment_id": F.when(g != 11, name)}
    fields = F.struct(
        F.lit("1").alias("schema_version"), *[own.get(c, m).alias(c) for c, m in zip(RA.SEGMENT_FIELDS, meta, strict=True)], F.when(g == 5, "x").otherwise(RA.set_hash(F.col("fs"))).alias("reference_set_hash"),
        (n - (g == 3).cast("int")).alias("raw_proposal_count"), (n - (g == 2).cast("int")).alias("grounded_accept_count"), (n + (g == 1).cast("int")).alias("frozen_fact_count"),
        F.lit(False).alias("truncated_to_k"), F.lit("r").alias("run_id"), F.when(g != 10, "p").alias("prompt_version"), F.lit("c").alias("config_hash"),
    )
    convs, head = convs.withColumn("head", F.to_json(fields)), F.col("head")
    value = F.concat(F.left(head, F.length(head) - 1), F.lit(',"reference_facts":'), F.when(g == 6, '"no"').otherwise(F.to_json(out)), F.lit("}"))
    copies = F.when(g == 7, F.array().cast("array<long>")).when(g == 9, F.array(F.col("conv_id") * 2, F.col("conv_id") * 2 + 1)).otherwise(F.array(F.col("conv_id") * 2))
    return convs.select(value.alias("value"), F.explode(copies).alias("row")), convs.where(g != 8).select(*meta)


@query("""WITH t AS (SELECT conv_id, turn, conv_id % 19 AS g, (conv_id * 8 + turn) % 29 AS h, CASE WHEN (conv_id * 8 + turn) % 29 = 1 THEN '' ELSE role || ': ' || coalesce(text, '') END AS text FROM conversations),
f AS (SELECT *, CASE WHEN h = 4 THEN 999 ELSE turn END AS source, trim(regexp_replace(regexp_replace(trim(replace(lower(text), 'ß', 'ss')), '[。.!！?]+$', ''), '\\s+', ' ', 'g')) AS key FROM t WHERE g NOT IN (6, 7, 8, 11)),
c AS (SELECT DISTINCT conv_id, conv_id % 19 AS g FROM conversations),
ids AS (SELECT conv_id, CASE WHEN h = 7 THEN 'dup' ELSE conv_id || '/' || key || '/' || source END AS id FROM f),
i AS (SELECT CASE g WHEN 1 THEN 'frozen_fact_count_mismatch' WHEN 2 THEN 'accepted_count_less_than_frozen' WHEN 3 THEN 'proposal_count_less_than_accepted' WHEN 4 THEN 'segment_metadata_mismatch' WHEN 5 THEN 'reference_set_hash_mismatch'
    WHEN 6 THEN 'reference_facts_not_list' WHEN 7 THEN 'missing_reference_row' WHEN 8 THEN 'missing_source_segment' WHEN 9 THEN 'duplicate_reference_segment' WHEN 10 THEN 'missing_row_fields' WHEN 11 THEN 'missing_segment_id' END AS code FROM c WHERE g BETWEEN 1 AND 11
  UNION ALL SELECT unnest(CASE g WHEN 8 THEN ['extra_reference_row'] ELSE ['missing_row_fields', 'missing_reference_row'] END) FROM c WHERE g IN (8, 11)
  UNION ALL SELECT CASE h WHEN 1 THEN 'empty_required_fact_value' WHEN 2 THEN 'fact_text_alias_mismatch' WHEN 3 THEN 'empty_grounding_reason' WHEN 4 THEN 'invalid_source_turn_ids' WHEN 5 THEN 'invalid_fact_type' WHEN 6 THEN 'invalid_state_status' WHEN 7 THEN 'reference_fact_id_hash_mismatch' ELSE 'missing_fact_fields' END FROM f WHERE h BETWEEN 1 AND 7 OR h = 9
  UNION ALL SELECT 'noncontiguous_selection_rank' FROM (SELECT DISTINCT conv_id FROM f WHERE h = 8)
  UNION ALL SELECT 'duplicate_fact_id_within_segment' FROM (SELECT row_number() OVER (PARTITION BY conv_id, id) AS n FROM ids) WHERE n > 1
  UNION ALL SELECT 'duplicate_fact_id_globally' FROM (SELECT row_number() OVER (PARTITION BY id) AS n FROM ids) WHERE n > 1
  UNION ALL SELECT 'exact_duplicate_same_source' FROM (SELECT row_number() OVER (PARTITION BY conv_id, key, source) AS n FROM f) WHERE n > 1
  UNION ALL SELECT 'exact_duplicate_different_source' FROM (SELECT row_number() OVER (PARTITION BY conv_id, key) AS n FROM f) WHERE n > 1
  UNION ALL SELECT unnest(['manifest_run_incomplete', 'manifest_segment_count_mismatch', 'manifest_fact_count_mismatch', 'mixed_or_manifest_mismatched_run_id', 'ledger_reference_set_count_mismatch'])
  UNION ALL SELECT 'mixed_prompt_versions' WHERE EXISTS (SELECT 1 FROM c WHERE g = 10))
SELECT 'error' AS severity, code, count(*) AS n FROM i GROUP BY 2 UNION ALL SELECT 'warning', 'incomplete_cost_accounting', 1 UNION ALL SELECT 'warning', unnest(['invalid_raw_archive_json', 'segments_missing_raw_archive']), 1 WHERE EXISTS (SELECT 1 FROM c WHERE g = 12)""")
def q1_reference_audit(spark, sf):
    references, segments = frozen(spark, sf)
    archive = segments.select(F.when(F.col("segment_id").cast("long") % 19 == 12, "{").otherwise(F.to_json(F.struct("segment_id"))).alias("value"))
    manifest = {"unresolved_failure_count": 0, "segment_count": 0, "fact_count": 0, "config_hash": "c", "run_id": "other"}
    ledger = {"sets": spark.range(0), "failures": spark.range(0), "quick_check": ["ok"]}
    found = RA.audit(spark, RA.checked_rows(references, segments), segments, manifest, archive, ledger)
    return found.groupBy("severity", "code").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id % 19 NOT IN (6, 7, 8, 11) GROUP BY 1),
r AS (SELECT 'fact_cap_reached' AS category, conv_id::VARCHAR AS segment_id, n AS n_facts FROM c WHERE n >= 5 UNION ALL SELECT DISTINCT 'json_repair_used', conv_id::VARCHAR, 0 FROM conversations WHERE conv_id % 3 = 0 AND conv_id % 19 NOT IN (8, 11)) SELECT * FROM r""")
def q5_reference_review(spark, sf):
    references, segments = frozen(spark, sf)
    archive = segments.where(F.col("segment_id").cast("long") % 3 == 0).select(F.to_json(F.struct("segment_id", F.lit("extract_json_repair").alias("stage"))).alias("value"))
    queue = RA.review_queue(RA.checked_rows(references, segments.where(F.col("segment_id").cast("long") % 19 != 11)), archive, limit=5, sample=0)
    return queue.select("category", "segment_id", F.size("fact_ids").cast("long").alias("n_facts"))
