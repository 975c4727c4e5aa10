"""Roll-ups of deployments and experiments, cost allocation, selection and ordering of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talkmill.operators.joins import must
from talkmill.operators.ordered import largest_remainder


def grid(start: float, end: float, step: float) -> list[float]:
    """The values from start to end, both included, rounded to ten places."""
    if step <= 0 or end < start:
        raise ValueError("a grid needs a positive step and an end not before its start")
    return [round(start + i * step, 10) for i in range(int((end - start) / step + 1e-9) + 1)]


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom; null where bottom is zero or null."""
    return F.when(bottom != 0, top / bottom)


def batch_usage(attempts: DataFrame, batch: list[str], sequence: str) -> DataFrame:
    """A batch's tokens, the source of its numbers and its last request. attempts: input_tokens, output_tokens, estimated, request_id."""
    return attempts.groupBy(*batch).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.when(F.bool_or("estimated"), "mixed_estimate").otherwise("provider").alias("usage_source"), F.max_by("request_id", sequence).alias("request_id"),
    )


def deployment_cost(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls, tokens and cost, over all or by columns; per sample and per call, null without any. calls: sample_id, input_tokens, output_tokens, cost."""
    n, samples, cost = F.count("*"), F.count_distinct("sample_id"), F.sum("cost")
    return calls.groupBy(*(by or [])).agg(
        n.alias("n_calls"), samples.alias("n_samples"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(cost, F.lit(0.0)).alias("cost"), ratio(cost, samples).alias("cost_per_sample"), ratio(cost, n).alias("cost_per_call"),
    )


def role_usage(samples: DataFrame, roles: list[str], key: str) -> DataFrame:
    """(key, role, calls, tokens): the columns <role>_calls and <role>_tokens as rows, summed."""
    each = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_calls").alias("calls"), F.col(f"{r}_tokens").alias("tokens")) for r in roles])
    return samples.select(key, F.explode(each).alias("e")).groupBy(key, "e.role").agg(F.sum("e.calls").alias("calls"), F.sum("e.tokens").alias("tokens"))


def micro_macro(outcomes: DataFrame, sample: str, correct: Column) -> DataFrame:
    """Accuracy over questions, and the mean of samples' accuracies: partial sums for each sample, then one row."""
    each = outcomes.groupBy(sample).agg(F.count("*").alias("n"), F.sum(correct.cast("int")).alias("ok"))
    return each.agg(F.count("*").alias("n_samples"), F.sum("n").alias("n_questions"), ratio(F.sum("ok"), F.sum("n")).alias("micro"), F.avg(F.col("ok") / F.col("n")).alias("macro"))


def folds(results: DataFrame, experiment: str, consistent: list[str], metric: str) -> DataFrame:
    """Mean and sample deviation of a metric over an experiment's folds. A column of consistent with two values in it raises."""
    kinds = [F.count_distinct(c).alias(f"__{c}") for c in consistent]
    g = results.groupBy(experiment).agg(F.count("*").alias("n_folds"), F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("deviation"), *kinds)
    for c in consistent:
        g = must(g, F.col(f"__{c}") <= 1, f"{c} differs among folds", [experiment])
    return g.drop(*[f"__{c}" for c in consistent])


def histogram(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, n): how often each value of each column occurs, all columns in one pass."""
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("value")) for c in columns])
    return rows.select(F.explode(each).alias("e")).groupBy("e.feature", "e.value").agg(F.count("*").alias("n"))


def weighted_score(folds: DataFrame, group: str, score: str, weight: str) -> DataFrame:
    """The mean score of a group, weighted; null if the weights sum to zero."""
    return folds.groupBy(group).agg(F.sum(weight).alias("weight"), ratio(F.sum(F.col(score) * F.col(weight)), F.sum(weight)).alias("score"))


def prune_dense(points: DataFrame, key: str, order: str, depth: str, gap: int) -> DataFrame:
    """Boundaries of a session that stay: from left to right, of two nearer than gap the deeper (ties: the one before).

    The walk is a fold over a session's ordered boundaries, which are few beside its turns.
    """
    row = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(depth).alias("d")))).alias("p"))
    none = F.filter("p", lambda x: F.lit(False))

    def step(kept, x):
        last = F.try_element_at(kept, F.lit(-1))
        near = F.coalesce(x["o"] - last["o"] < gap, F.lit(False))
        return F.when(~near, F.concat(kept, F.array(x))).when(x["d"] > last["d"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(x))).otherwise(kept)

    return row.select(key, F.explode(F.aggregate("p", none, step)).alias("e")).select(key, F.col("e.o").alias(order), F.col("e.d").alias(depth))


def reindex(segments: DataFrame, sample: str, session: str, order: str, text: str) -> DataFrame:
    """segments with segment_id in the sample's order, qualified_id, content_hash and reason: a later session's first is a boundary."""
    whole, own = W.partitionBy(sample).orderBy(session, order), W.partitionBy(sample, session).orderBy(order)
    named = segments.withColumns({"__n": F.row_number().over(whole), "__k": F.row_number().over(own)})
    ident = F.format_string("seg_%06d", F.col("__n"))
    reason = F.when((F.col("__k") == 1) & (F.col("__n") > 1), "session_boundary").otherwise("topic_shift")
    return named.select(*segments.columns, ident.alias("segment_id"), F.concat_ws(":", F.col(sample).cast("string"), ident).alias("qualified_id"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("content_hash"), reason.alias("reason")).drop("__n", "__k")


def stratified(rows: DataFrame, strata: list[str], ident: str, seed: str, n: int) -> DataFrame:
    """n rows, a stratum in turn, each stratum in the order of a seeded hash of its ids."""
    mark = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(ident).cast("string")), 256)
    dealt = rows.withColumn("turn", F.row_number().over(W.partitionBy(*strata).orderBy(mark, ident)))
    return dealt.where(F.col("turn") <= n).orderBy("turn", *strata).limit(n)


def still_open(selected: DataFrame, completed: DataFrame, key: list[str]) -> DataFrame:
    """What of a frozen selection is not done. The selection comes first: done rows leave no room for others."""
    return selected.join(completed.select(*key).distinct(), key, "left_anti")


def allocate_cost(parts: DataFrame, batch: str, index: str, price_in: float, price_out: float) -> DataFrame:
    """A batch's tokens given to its parts by largest remainder, and their cost. parts: w_in, w_out, total_in, total_out."""
    taken = largest_remainder(parts, batch, index, "w_in", "total_in").withColumnRenamed("allocated", "input_tokens")
    given = largest_remainder(taken, batch, index, "w_out", "total_out").withColumnRenamed("allocated", "output_tokens")
    return given.withColumn("cost", (F.col("input_tokens") * price_in + F.col("output_tokens") * price_out) / 1e6)


def allocate_fallback(children: DataFrame, parent: str, weight: str, parent_cost: str, own_cost: str) -> DataFrame:
    """children with `cost`: their own and their share, by weight, of the failed parent's; without weights the shares are equal."""
    w = W.partitionBy(parent)
    total, n = F.sum(weight).over(w), F.count(F.lit(1)).over(w)
    return children.withColumn("cost", F.col(own_cost) + F.col(parent_cost) * F.when(total > 0, F.col(weight) / total).otherwise(1.0 / n))


def normalized_cost(cost: Column, least: Column, most: Column) -> Column:
    """0 at the least cost and 1 at the most, which has to be larger."""
    return F.when(most > least, (cost - least) / (most - least + 1e-12)).otherwise(F.raise_error(F.lit("the largest cost is not above the least")))


def plan_estimate(batches: DataFrame, by: list[str], reserve: int, price_in: float, price_out: float) -> DataFrame:
    """The upper bound of packed batches' cost, with reserve output tokens each. batches: batch_no, tokens (of a part)."""
    each = batches.groupBy(*by, "batch_no").agg(F.sum("tokens").alias("tokens"))
    cost = (F.sum("tokens") * price_in + F.count("*") * reserve * price_out) / 1e6
    return each.groupBy(*by).agg(F.count("*").alias("n_batches"), F.sum("tokens").alias("input_tokens"), F.max("tokens").alias("largest"), cost.alias("cost_bound"))


def ranked(results: DataFrame, order: list[Column], limit: int | None = None) -> DataFrame:
    """A report: results with `rank` by a total order. One row an experiment, so one task sorts them."""
    out = results.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return out if limit is None else out.where(F.col("rank") <= limit)


def kept_questions(questions: DataFrame, sample: str, category: str, excluded: list[str]) -> DataFrame:
    """Questions of no excluded category; a null category stays. A sample that loses all its questions raises."""
    kept = ~F.coalesce(F.col(category).isin(excluded), F.lit(False))
    counted = questions.withColumn("__k", F.count_if(kept).over(W.partitionBy(sample)))
    return must(counted, F.col("__k") > 0, "no question left", [sample]).where(kept).drop("__k")


def scope_hash(rows: DataFrame, scope: list[str], items: str) -> DataFrame:
    """(scope, n, scope_hash): a digest of the scope's sorted distinct items, the same in whatever order rows come.

    Items are hashed before they are gathered, so a gathered row is 64 bytes however long the item is.
    """
    return rows.groupBy(*scope).agg(F.count_distinct(items).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_set(F.sha2(F.col(items).cast("string"), 256))), ""), 256).alias("scope_hash"))


#: States of a batch, and which may follow which: a final state has no entry, and one `failed` stands for all failures.
NEXT = {"planned": ["requesting"], "requesting": ["api_succeeded", "failed", "planned"], "api_succeeded": ["parsed", "failed", "recovered_by_fallback"], "parsed": ["embedded", "failed"], "embedded": ["committed", "failed"]}


def batch_states(events: DataFrame, batch: str, sequence: str, status: str) -> DataFrame:
    """(batch, status, n_events, illegal): each batch's latest status, and how many of its steps no rule allows."""
    w = W.partitionBy(batch).orderBy(sequence)
    allowed = F.create_map(*[x for a, b in NEXT.items() for x in (F.lit(a), F.array(*map(F.lit, b)))])
    before = F.lag(status).over(w)
    legal = F.when(before.isNull(), F.col(status) == "planned").otherwise(F.coalesce(F.array_contains(F.try_element_at(allowed, before), F.col(status)), F.lit(False)))
    return events.withColumn("__ok", legal).groupBy(batch).agg(F.max_by(status, sequence).alias("status"), F.count("*").alias("n_events"), F.count_if(~F.col("__ok")).alias("illegal"))
