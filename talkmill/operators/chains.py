"""Chains of operators around a model call: candidate extraction with repair and fallback, attempts, judging plans, labels, baselines.

A model is a hook from DataFrame to DataFrame. What it returns is kept (`keep`, a checkpoint by default) before anything reads it
twice, so no call is made again for a lost task downstream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talkmill.functions.records import constrained_prompt, repairable
from talkmill.operators import aggregates, joins, ordered, replies, routing
from talkmill.session import checkpointed

Hook = Callable[[DataFrame], DataFrame]


def batches(segments: DataFrame, scope: list[str], max_segments: int, max_tokens: int, base: int = 0) -> DataFrame:
    """(scope, batch_id, segments, forbidden): packed batches. segments: scope, segment_order, segment_id, text, ids, tokens."""
    packed = ordered.pack(segments, scope, "segment_order", "tokens", max_segments, max_tokens, base).drop("tokens").join(segments, [*scope, "segment_order"])
    item = F.struct("segment_order", "segment_id", "text", "ids", "tokens")
    grouped = packed.groupBy(*scope, "batch_no").agg(F.array_sort(F.collect_list(item)).alias("segments"))
    name = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in scope], F.array_join(F.transform("segments", lambda s: s["segment_id"]), "|")), 256)
    return grouped.select(*scope, F.substring(name, 1, 32).alias("batch_id"), "segments", F.array().cast("array<int>").alias("forbidden"))


def asked(todo: DataFrame, call: Hook, limit: int, keep: Hook, adopt: bool = False) -> DataFrame:
    """todo with content, input_tokens, output_tokens, truncated, facts and error: the model's answers, read. An answer cut at its length is an error."""
    prompts = todo.select("batch_id", constrained_prompt(F.col("segments")).alias("prompt"))
    told = keep(call(prompts).select("batch_id", "content", "input_tokens", "output_tokens", "truncated"))
    read = replies.fact_batches(todo.join(told, "batch_id"), limit, adopt)
    return keep(read.withColumn("error", F.when(F.col("truncated"), "the answer was cut at its length").otherwise(F.col("error"))).withColumn("facts", F.when(F.col("error").isNull(), F.col("facts"))))


def extracted(todo: DataFrame, call: Hook, repair: Hook | None, limit: int, attempts: int = 1, keep: Hook = checkpointed) -> DataFrame:
    """(batch_id, segments, status, facts, error, input_tokens, output_tokens): every batch of todo, with all its tokens.

    A batch whose reply has a fault of form is repaired up to `attempts` times (repair: batch_id, content, error to the
    columns of a call). One that still fails and holds several segments is asked again segment by segment; it is recovered
    if every segment's reply is good, and terminal, with no facts, if one is not. Statuses: committed, repaired,
    recovered_by_fallback, failed_terminal. todo: batch_id, segments, forbidden.
    """
    columns = ["batch_id", "segments", "forbidden"]
    state = asked(todo.select(*columns), call, limit, keep).withColumn("status", F.when(F.col("error").isNull(), "committed"))
    for _ in range(attempts if repair else 0):
        open_ = state.where(F.col("status").isNull() & ~F.col("truncated") & repairable(F.col("error")))
        mended = keep(repair(open_.select("batch_id", "content", "error")).select("batch_id", "content", "input_tokens", "output_tokens", "truncated"))
        before = open_.select(*columns, F.col("input_tokens").alias("__i"), F.col("output_tokens").alias("__o"))
        again = replies.fact_batches(before.join(mended, "batch_id"), limit)
        again = again.withColumns({"input_tokens": F.col("input_tokens") + F.col("__i"), "output_tokens": F.col("output_tokens") + F.col("__o")}).drop("__i", "__o")
        again = keep(again.withColumn("status", F.when(F.col("error").isNull(), "repaired")))
        state = state.join(again.select("batch_id"), "batch_id", "left_anti").unionByName(again)
    failed = state.where(F.col("status").isNull())
    single = failed.where(F.size("segments") > 1).select(F.col("batch_id").alias("parent"), F.explode("segments").alias("s"), "forbidden")
    single = single.select("parent", F.concat_ws("/", "parent", "s.segment_id").alias("batch_id"), F.array("s").alias("segments"), "forbidden")
    children = asked(single, call, limit, keep, adopt=True)
    whole = children.groupBy("parent").agg(
        F.bool_and(F.col("error").isNull()).alias("good"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("segments")[0]["segment_order"].alias("k"), "facts"))), lambda c: c["facts"])).alias("__facts"),
        F.max("error").alias("__error"), F.sum("input_tokens").alias("__i"), F.sum("output_tokens").alias("__o"),
    ).withColumnRenamed("parent", "batch_id")
    good = F.coalesce("good", F.lit(False))
    done = failed.drop("status", "facts").join(whole, "batch_id", "left").select(
        "batch_id", "segments", F.when(good, "recovered_by_fallback").otherwise("failed_terminal").alias("status"), F.when(good, F.col("__facts")).alias("facts"), F.when(~good, F.coalesce("__error", "error")).alias("error"),
        (F.col("input_tokens") + F.coalesce("__i", F.lit(0))).alias("input_tokens"), (F.col("output_tokens") + F.coalesce("__o", F.lit(0))).alias("output_tokens"),
    )
    return state.where(F.col("status").isNotNull()).select(*done.columns).unionByName(done)


def segment_ledger(results: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """(batch_id, segment_id, n_facts, input_tokens, output_tokens, cost, status): each segment's share of its batch.

    Input goes by the segments' tokens, output by the characters of their facts, in largest remainders; a segment without
    facts has a row too (`no_fact`). Failed batches have no rows.
    """
    rows = results.where(F.col("status") != "failed_terminal").select("batch_id", F.col("input_tokens").cast("long").alias("total_in"), F.col("output_tokens").cast("long").alias("total_out"), "facts", F.explode("segments").alias("s"))
    own = F.filter("facts", lambda f: f["segment_id"] == F.col("s.segment_id"))
    rows = rows.select("batch_id", "total_in", "total_out", F.col("s.segment_order").alias("index"), F.col("s.segment_id").alias("segment_id"), F.col("s.tokens").cast("double").alias("w_in"), F.size(own).alias("n_facts"), F.coalesce(F.aggregate(F.transform(own, lambda f: F.length(f["fact"])), F.lit(0), lambda a, n: a + n), F.lit(0)).cast("double").alias("w_out"))
    from talkmill.operators.evaluation import allocate_cost

    shared = allocate_cost(rows, "batch_id", "index", price_in, price_out)
    return shared.select("batch_id", "segment_id", "n_facts", "input_tokens", "output_tokens", "cost", F.when(F.col("n_facts") == 0, "no_fact").otherwise("stored").alias("status"))


def attempts(calls: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Transport attempts with their tokens and costs: only a call's last success has any; the others' costs are unknown.

    calls: batch_id, call_index, attempt, tier, status, input_tokens, output_tokens, usage_source (of the answered call).
    """
    w = W.partitionBy("batch_id", "call_index")
    told = (F.col("status") == "succeeded") & (F.col("attempt") == F.max(F.when(F.col("status") == "succeeded", F.col("attempt"))).over(w))
    price = lambda i: F.coalesce(*[F.when(F.col("tier") == t, F.lit(float(p[i]))) for t, p in prices.items()])
    rows = calls.withColumn("__told", told).withColumns({"__in": price(0), "__out": price(1)})
    own = lambda c: F.when(F.col("__told"), c)
    return rows.withColumns({
        "cost": own((F.col("input_tokens") * F.col("__in") + F.col("output_tokens") * F.col("__out")) / 1e6),
        "cost_status": F.when(~F.col("__told"), "unknown").when(F.col("usage_source") == "provider", "known").otherwise("estimated"),
        "input_tokens": own(F.col("input_tokens")), "output_tokens": own(F.col("output_tokens")),
    }).drop("__told", "__in", "__out")


def judge_plan(tasks: DataFrame, most_input: int, most_output: int, price_in: float, price_out: float) -> DataFrame:
    """One row: calls, input tokens, reserved output tokens, the largest prompt and the costs' upper bounds.

    tasks: prompt_tokens, n_candidates, n_gold. A prompt over most_input raises. Without tasks all numbers are 0.
    """
    fits = joins.must(tasks, F.col("prompt_tokens") <= most_input, "a prompt exceeds the model's input", ["prompt_tokens"])
    reserve = F.least(F.lit(most_output), F.greatest(F.lit(2048), 260 * (F.col("n_candidates") + F.col("n_gold"))))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    got = fits.agg(F.count("*").alias("n_calls"), n(F.sum("prompt_tokens")).alias("input_tokens"), n(F.sum(reserve)).alias("reserved_tokens"), n(F.max("prompt_tokens")).alias("largest_prompt"))
    return got.withColumns({"input_cost_bound": F.col("input_tokens") * price_in / 1e6, "output_cost_bound": F.col("reserved_tokens") * price_out / 1e6})


def stage_usage(stages: DataFrame, by: list[str]) -> DataFrame:
    """(by, tokens, cost, n_provider, n_estimated, n_unknown_cost, cost_complete) over stage usages: input_tokens, output_tokens, total_cost, usage_source, cost_status."""
    got = stages.groupBy(*by).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("total_cost").alias("cost"), F.count_if(F.col("usage_source") == "provider").alias("n_provider"), F.count_if(F.col("usage_source") != "provider").alias("n_estimated"), F.count_if(F.col("cost_status") != "known").alias("n_unknown_cost"))
    return got.withColumns({"tokens": F.col("input_tokens") + F.col("output_tokens"), "cost_complete": F.col("n_unknown_cost") == 0})


def label_inputs(judged: DataFrame, references: DataFrame, profiles: DataFrame, runs: DataFrame) -> DataFrame:
    """judged (segment_id, model_id, ...) with reference_set_hash, profile_id and extraction_run_id (`unknown` without one).

    A judgment of a segment without reference, of a model without profile, or that repeats, raises.
    """
    once = joins.unique(judged, ["segment_id", "model_id"], "judgment")
    named = joins.covered(once, references.select("segment_id", F.coalesce("reference_set_hash", F.lit("unknown")).alias("reference_set_hash")), ["segment_id"], "reference")
    known = joins.covered(named, profiles.select("model_id", "profile_id"), ["model_id"], "profile")
    return known.join(runs.select("segment_id", "model_id", "extraction_run_id"), ["segment_id", "model_id"], "left").withColumn("extraction_run_id", F.coalesce("extraction_run_id", F.lit("unknown")))


def review_sheet(judged: DataFrame, segments: DataFrame, references: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row for each judged set: its segment's text, gold facts and candidate facts (sorted), and empty review columns.

    segments: segment_id, text; references: segment_id, gold_fact_id, gold_text; candidates: segment_id, model_id, candidate_id, candidate_text.
    """
    gold = references.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("gold_fact_id", "gold_text"))).alias("gold_facts"))
    told = candidates.groupBy("segment_id", "model_id").agg(F.array_sort(F.collect_list(F.struct("candidate_id", "candidate_text"))).alias("candidate_facts"))
    rows = joins.covered(judged, segments.select("segment_id", F.col("text").alias("segment_text")), ["segment_id"], "segment")
    rows = joins.covered(rows, gold, ["segment_id"], "reference").join(told, ["segment_id", "model_id"], "left")
    none = F.array().cast(told.schema["candidate_facts"].dataType)
    return rows.withColumns({"candidate_facts": F.coalesce("candidate_facts", none), "review_status": F.lit(""), "review_notes": F.lit("")})


def baseline(segments: DataFrame, points: DataFrame, policy: str, key: str, seed: int = 42) -> DataFrame:
    """The assembly that a fixed tier (`all-small`, `all-medium`, `all-large`) or a random one makes of stored points."""
    if policy not in ("all-small", "all-medium", "all-large", "random"):
        raise ValueError(f"unknown policy {policy}")
    tier: Column = routing.random_router(F.col(key), seed) if policy == "random" else F.lit(policy.removeprefix("all-"))
    return joins.assembly(segments.select(key).distinct().withColumn("tier", tier), points, key)


def compared(candidates: DataFrame, references: DataFrame, key: str, beta: float = 2.0) -> DataFrame:
    """Set metrics of each segment: candidates and references that are equal after normalising and share a source are matched one to one."""
    pairs = joins.same_facts(candidates, references, key).select(key, F.col("candidate_id").cast("string").alias("candidate_id"), F.col("reference_id").cast("string").alias("reference_id"))
    tp = routing.matching(pairs, key, "candidate_id", "reference_id").groupBy(key).agg(F.count("*").alias("tp"))
    n = candidates.groupBy(key).agg(F.count("*").alias("nc")).join(references.groupBy(key).agg(F.count("*").alias("nr")), key, "full_outer").join(tp, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return aggregates.set_metrics(n.select(key, zero("tp").alias("tp"), (zero("nc") - zero("tp")).alias("fp"), (zero("nr") - zero("tp")).alias("fn")), [key], beta)
