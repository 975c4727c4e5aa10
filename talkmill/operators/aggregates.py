"""Labels, metrics and summaries as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    return F.when(b == 0, F.lit(otherwise)).otherwise(a / b)


def fbeta(p: Column, r: Column, beta: float) -> Column:
    return ratio((1 + beta * beta) * p * r, beta * beta * p + r)


def quality_label(candidates: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """Precision (strict, partial), recall (strict, partial, only where the time is right), F1, F2 and temporal recall of each set.

    candidates: key, semantic_status; gold: key, coverage_status, time_status. A set without candidates has precision 1, one
    without gold facts recall 1; temporal recall is null where no fact has a time.
    """
    status = F.col("semantic_status")
    c = candidates.groupBy(*key).agg(F.count("*").alias("n_candidates"), F.count_if(status == "SUPPORTED").alias("supported"), F.count_if(status == "PARTIALLY_SUPPORTED").alias("partial"))
    right = F.col("time_status").isin("PASS", "NOT_APPLICABLE")
    g = gold.groupBy(*key).agg(F.count("*").alias("n_gold"), F.count_if(right & (F.col("coverage_status") == "FULL")).alias("full"), F.count_if(right & (F.col("coverage_status") == "PARTIAL")).alias("part"), F.count_if(F.col("time_status") == "PASS").alias("in_time"), F.count_if(F.col("time_status") != "NOT_APPLICABLE").alias("timed"))
    j = c.join(g, key, "full_outer").fillna(0)
    j = j.withColumns({"strict_precision": ratio(F.col("supported"), F.col("n_candidates"), 1.0), "soft_precision": ratio(F.col("supported") + 0.5 * F.col("partial"), F.col("n_candidates"), 1.0), "strict_recall": ratio(F.col("full"), F.col("n_gold"), 1.0), "partial_recall": ratio(F.col("full") + 0.5 * F.col("part"), F.col("n_gold"), 1.0), "temporal_recall": ratio(F.col("in_time"), F.col("timed"), None)})
    return j.select(*key, "strict_precision", "soft_precision", "strict_recall", "partial_recall", "temporal_recall", fbeta(F.col("strict_precision"), F.col("strict_recall"), 1.0).alias("f1"), fbeta(F.col("soft_precision"), F.col("partial_recall"), 2.0).alias("f2"))


def set_metrics(counts: DataFrame, key: list[str], beta: float = 2.0) -> DataFrame:
    """Precision, recall, F1, F-beta, Jaccard, false discovery and negative rates and exact match from tp, fp and fn."""
    tp, fp, fn, b = F.col("tp"), F.col("fp"), F.col("fn"), beta * beta
    empty = tp + fp + fn == 0
    one = lambda c: F.when(empty, 1.0).otherwise(c)
    return counts.select(*key, one(ratio(tp, tp + fp)).alias("precision"), one(ratio(tp, tp + fn, 1.0)).alias("recall"), one(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"), one(ratio((1 + b) * tp, (1 + b) * tp + b * fn + fp)).alias("f_beta"), one(ratio(tp, tp + fp + fn)).alias("jaccard"), ratio(fp, tp + fp).alias("false_discovery_rate"), ratio(fn, tp + fn).alias("false_negative_rate"), ((fp == 0) & (fn == 0)).cast("double").alias("exact_match"))


#: Ranges that a running sum is cut into: their sums meet in one task, the values of each range in a task of its own.
RANGES = 4096


def running(rows: DataFrame, value: str) -> DataFrame:
    """(value, n, upto): each distinct value of a numeric column, its rows, and the rows up to it. Nulls take no part.

    No task sorts everything: values are cut into RANGES equal ranges, whose sums are added up apart from the sums within each.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
    width = F.greatest((F.col("__hi") - F.col("__lo")) / RANGES, F.lit(1e-300))
    cut = counts.crossJoin(F.broadcast(ends)).withColumn("__range", F.floor((F.col(value).cast("double") - F.col("__lo")) / width)).drop("__lo", "__hi")
    sums = cut.groupBy("__range").agg(F.sum("n").alias("__all"))
    before = sums.select("__range", (F.sum("__all").over(W.orderBy("__range")) - F.col("__all")).alias("__before"))
    within = F.sum("n").over(W.partitionBy("__range").orderBy(value))
    return cut.join(F.broadcast(before), "__range").select(value, "n", (F.col("__before") + within).alias("upto"))


def consistency(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One row: share of equal signs where neither is 0, and Spearman's correlation of average ranks (0 where either is constant).

    Pairs with a null take no part.
    """
    known = pairs.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    ranks = lambda c: running(known, c).select(c, (F.col("upto") - (F.col("n") - 1) / 2).alias(f"r{c}"))
    r = known.join(ranks("x"), "x").join(ranks("y"), "y")
    both = (F.col("x") != 0) & (F.col("y") != 0)
    return r.agg(F.round(F.coalesce(F.avg(F.when(both, (F.signum("x") == F.signum("y")).cast("double"))), F.lit(0.0)), 6).alias("sign_agreement"), F.round(F.coalesce(F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")), F.lit(0.0)), 6).alias("spearman"))


def outcome_summary(outcomes: DataFrame, category: str, kind: str) -> DataFrame:
    """Overall, by category and by kind, in one pass: questions, accuracy, population deviation. outcomes: correct (boolean)."""
    rows = outcomes.withColumn("g", F.explode(F.array(F.struct(F.lit("overall").alias("grouping"), F.lit("all").alias("value")), F.struct(F.lit("category").alias("grouping"), F.col(category).alias("value")), F.struct(F.lit("kind").alias("grouping"), F.col(kind).alias("value")))))
    a = F.avg(F.col("correct").cast("double"))
    return rows.groupBy("g.grouping", "g.value").agg(F.count("*").alias("n_questions"), F.round(a, 6).alias("accuracy"), F.round(F.sqrt(a * (1 - a)), 6).alias("deviation"))


def scaler(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, scale): population deviation; a feature that hardly varies has scale 1."""
    one = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    stacked = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("s")) for c in columns])).alias("f")).select("f.*")
    return stacked.select("feature", F.round("mean", 6).alias("mean"), F.round(F.when(F.col("s") < 1e-8, 1.0).otherwise(F.col("s")), 6).alias("scale"))


def usage(events: DataFrame, group: str, segment: str, question: str, correct: Column) -> DataFrame:
    """(segment, n_questions, accuracy): a question counts once for each segment that it used."""
    once = events.select(F.col(segment).alias("segment"), F.col(group).alias("grp"), F.col(question).alias("question"), correct.cast("int").alias("ok")).groupBy("grp", "segment", "question").agg(F.max("ok").alias("ok"))
    return once.groupBy("grp", "segment").agg(F.count("*").alias("n_questions"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("accuracy"))


#: Call types that count as fallback, by default.
FALLBACK = ("fallback_singleton", "fallback_tier", "terminal_recovery_singleton")


def attempt_costs(attempts: DataFrame, fallback: tuple[str, ...] = FALLBACK, terminal: str = "terminal_recovery_singleton", repair: str = "schema_repair") -> DataFrame:
    """A row for each tier and one for all (tier `total`): calls, attempts, tokens and costs, apart for fallback, last recovery and repair.

    attempts: tier, batch_id, logical_call_index, call_type, status, cost_status, input_tokens, output_tokens, input_cost, output_cost.
    A call is a batch and its index, however many attempts it took. Costs that are neither known nor estimated don't count;
    tokens are those of attempts that succeeded and have input tokens. Primary cost is what is known without fallback.
    """
    kind, zero = F.col("call_type"), F.lit(0.0)
    known = F.when(F.col("cost_status").isin("known", "estimated"), F.coalesce("input_cost", zero) + F.coalesce("output_cost", zero)).otherwise(zero)
    call = F.struct("batch_id", "logical_call_index")
    done = (F.col("status") == "succeeded") & F.col("input_tokens").isNotNull()
    calls = lambda c: F.count_distinct(F.when(c, call))
    cost = lambda c: F.coalesce(F.sum(F.when(c, known)), zero)
    token = lambda c: F.coalesce(F.sum(F.when(done, F.coalesce(c, F.lit(0)))), F.lit(0)).cast("long")
    out = attempts.rollup("tier").agg(
        F.grouping("tier").alias("__all"), calls(F.lit(True)).alias("logical_api_calls"), F.count_if(F.col("status") == "succeeded").alias("successful_attempts"), F.count_if(F.col("status") == "failed").alias("failed_attempts"),
        F.count_if(F.col("cost_status") == "unknown").alias("unknown_cost_attempts"), token("input_tokens").alias("input_tokens"), token("output_tokens").alias("output_tokens"), cost(F.lit(True)).alias("known_cost"),
        calls(kind.isin(*fallback)).alias("fallback_calls"), cost(kind.isin(*fallback)).alias("fallback_cost"), calls(kind == terminal).alias("terminal_recovery_calls"), cost(kind == terminal).alias("terminal_recovery_cost"),
        calls(kind == repair).alias("repair_calls"), cost(kind == repair).alias("schema_repair_cost"),
    )
    out = out.withColumn("tier", F.when(F.col("__all") == 1, "total").otherwise(F.col("tier"))).drop("__all")
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).withColumn("primary_cost", F.col("known_cost") - F.col("fallback_cost"))


def extraction_quality(segments: DataFrame, batches: DataFrame, attempts: DataFrame, most_facts: dict[str, int], gates: dict[str, float] | None = None) -> DataFrame:
    """One row: counts and rates of empty and saturated segments, repaired, failed and recovered batches; violations: gates exceeded.

    segments: tier, status, fact_count; batches: status; attempts: batch_id, call_type. most_facts: the facts at which a tier's segment is
    full. Rates of nothing are 0. A gate not given is 1, and 0 for failed batches.
    """
    full = F.try_element_at(F.create_map(*[F.lit(x) for p in sorted(most_facts.items()) for x in p]), F.col("tier"))
    one = segments.agg(F.count("*").alias("total_segment_results"), F.count_if(F.col("status") == "no_fact").alias("empty_fact_segments"), F.count_if(F.coalesce("fact_count", F.lit(0)) >= full).alias("saturated_segments"))
    two = batches.agg(F.count("*").alias("total_batches"), F.count_if(~F.col("status").isin("committed", "recovered_by_fallback")).alias("failed_batches"), F.count_if(F.col("status") == "recovered_by_fallback").alias("recovered_batches"))
    three = attempts.agg(F.count_distinct(F.when(F.col("call_type") == "schema_repair", F.col("batch_id"))).alias("repair_batches"))
    rate = lambda a, b: F.round(ratio(F.col(a), F.col(b)), 6)
    rates = {"empty_fact_segment_rate": rate("empty_fact_segments", "total_segment_results"), "saturated_segment_rate": rate("saturated_segments", "total_segment_results"), "repair_batch_rate": rate("repair_batches", "total_batches"), "failed_batch_rate": rate("failed_batches", "total_batches"), "fallback_recovery_rate": rate("recovered_batches", "total_batches")}
    most = {"empty_fact_segment_rate": 1.0, "saturated_segment_rate": 1.0, "repair_batch_rate": 1.0, "failed_batch_rate": 0.0} | (gates or {})
    out = one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(three)).withColumns(rates)  # one row each
    over = F.concat_ws(",", *[F.when(F.col(c) > m, F.lit(c)) for c, m in sorted(most.items())])
    return out.withColumn("violations", over).withColumn("passed", over == "")
