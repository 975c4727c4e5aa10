"""Baseline routers, bipartite matching, multipliers and campaign states."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def length_router(tokens: Column, small: int, large: int) -> Column:
    """small below a token count, large from another on, medium between."""
    return F.when(tokens < small, "small").when(tokens < large, "medium").otherwise("large")


def random_router(key: Column, seed: int) -> Column:
    """A tier drawn by a hash of seed and key."""
    return F.element_at(F.array(*map(F.lit, ("small", "medium", "large"))), (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(3)) + 1).cast("int"))


def matching(pairs: DataFrame, scope: str, left: str, right: str) -> DataFrame:
    """(scope, left, right) of a maximum matching in each scope, found by augmenting paths in sorted order.

    A scope is one segment's facts, so it is one pandas group.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in sorted(set(zip(pdf[left], pdf[right], strict=True))):
            near.setdefault(a, []).append(b)
        owner: dict = {}
        for start in sorted(near):
            # A stack of (node, its remaining neighbours, the neighbour by which it was left).
            seen, stack = set(), [[start, iter(near[start]), None]]
            while stack:
                node, rest, _ = stack[-1]
                to = next((b for b in rest if b not in seen), None)
                if to is None:
                    stack.pop()
                    continue
                seen.add(to)
                stack[-1][2] = to
                if to not in owner:
                    for node, _, by in stack:
                        owner[by] = node
                    break
                stack.append([owner[to], iter(near[owner[to]]), None])
        return pd.DataFrame([(pdf[scope].iloc[0], a, b) for b, a in sorted(owner.items())], columns=[scope, left, right])

    kinds = dict(pairs.dtypes)
    spread = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, long work: not to be merged into one task
    return pairs.select(scope, left, right).repartition(spread, scope).groupBy(scope).applyInPandas(solve, f"{scope} {kinds[scope]}, {left} {kinds[left]}, {right} {kinds[right]}")


def multiplier(costs: Column, budget: float, rate: float) -> Column:
    """The multiplier after an ordered array of episode costs: grows by rate * (cost - budget), never below 0."""
    return F.aggregate(costs, F.lit(0.0), lambda a, c: F.greatest(F.lit(0.0), a + rate * (c - budget)))


def checkpoint_choice(epochs: DataFrame, scope: str, budget: float) -> DataFrame:
    """(scope, epoch): the epoch with the best score, then the lower cost, among those within budget; the first of equals."""
    ok = epochs.where(F.col("cost") <= budget)
    return ok.withColumn("n", F.row_number().over(W.partitionBy(scope).orderBy(F.desc("score"), "cost", "epoch"))).where("n = 1").select(scope, "epoch")


def campaign(results: DataFrame, scope: str, most_empty: float, most_failed: float) -> DataFrame:
    """Totals, rates and state of each campaign. results: is_empty, is_failed, is_done."""
    r = results.groupBy(scope).agg(F.count("*").alias("n"), F.count_if("is_empty").alias("n_empty"), F.count_if("is_failed").alias("n_failed"), F.every("is_done").alias("all_done"))
    r = r.withColumns({"empty_rate": F.round(F.col("n_empty") / F.col("n"), 6), "failed_rate": F.round(F.col("n_failed") / F.col("n"), 6)})
    return r.withColumn("state", F.when(~F.col("all_done"), "incomplete").when((F.col("empty_rate") > most_empty) | (F.col("failed_rate") > most_failed), "quality_failed").otherwise("complete")).drop("all_done")


def truncate_tokens(text: Column, limit: int) -> Column:
    """The longest prefix of a text that has at most limit tokens; a text with fewer stays as it is."""
    from talkmill.functions.text import TOKEN

    head = F.regexp_extract(text, rf"(?s)^(?:.*?(?:{TOKEN})){{0,{limit}}}", 0)
    return F.when(F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))) <= limit, text).otherwise(head)
