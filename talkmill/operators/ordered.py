"""Operators over ordered rows: topics from a coherence curve, packing, allocation, latest runs and stratified picks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talkmill.operators.joins import unique
from talkmill.operators.packing import pack  # noqa: F401


def slices(rows: DataFrame, scope: str, order: str, value: str) -> DataFrame:
    """rows and slice_no: a new number whenever value changes within scope; null and blank values are one value."""
    w = W.partitionBy(scope).orderBy(order)
    v = F.when(F.trim(F.coalesce(value, F.lit(""))) == "", "__unscoped__").otherwise(F.col(value))
    return rows.withColumn("__v", v).withColumn("__new", (F.col("__v") != F.lag("__v").over(w)).cast("int")).withColumn("slice_no", F.sum(F.coalesce("__new", F.lit(0))).over(w).cast("long")).drop("__v", "__new")


def depths(curve: DataFrame, scope: str, order: str, score: str) -> DataFrame:
    """curve and depth: how far each score lies below the peaks that are reached by climbing left and right from it.

    Climbing goes on while the next score is not smaller. A climb is a run of rows, so both peaks are window maxima.
    """
    w = W.partitionBy(scope).orderBy(order)
    s = F.col(score)
    left = curve.withColumn("__l", F.sum(F.coalesce((F.lag(score).over(w) < s).cast("int"), F.lit(0))).over(w)).withColumn("__r", F.sum(F.coalesce((F.lead(score).over(w) < s).cast("int"), F.lit(0))).over(W.partitionBy(scope).orderBy(F.desc(order))))
    up = F.max(score).over(W.partitionBy(scope, "__l").orderBy(order))
    down = F.max(score).over(W.partitionBy(scope, "__r").orderBy(F.desc(order)))
    return left.withColumn("depth", (up + down - 2 * s) / 2).drop("__l", "__r")


def boundaries(curve: DataFrame, scope: str, order: str, score: str, alpha: float) -> DataFrame:
    """curve with depth, threshold (mean and alpha population deviations of the scope's depths) and is_boundary."""
    w = W.partitionBy(scope)
    d = depths(curve, scope, order, score)
    return d.withColumn("threshold", F.avg("depth").over(w) + alpha * F.stddev_pop("depth").over(w)).withColumn("is_boundary", F.col("depth") > F.col("threshold"))


def merge_short(parts: list[list], score: list[float], tokens: list[int], min_turns: int, min_tokens: int, max_turns: int) -> list[list]:
    """parts (first, end, reason) where each short one, from the first on, has joined the neighbour to which it coheres more, the left
    one of equals. A part whose joint length would be too large stays as it is; every merge begins the search anew."""
    upto = np.concatenate(([0], np.cumsum(tokens)))
    i = 0
    while i < len(parts) and len(parts) > 1:
        a, b, _ = parts[i]
        i += 1
        if b - a >= min_turns and upto[b] - upto[a] >= min_tokens:
            continue
        left = score[a] if a else -np.inf
        right = score[b] if b < len(score) else -np.inf
        j = i - 2 if left >= right else i  # the neighbour's place
        low, high = sorted((i - 1, j))
        if parts[high][1] - parts[low][0] <= max_turns:
            parts[low : high + 1] = [[parts[low][0], parts[high][1], "merged_short"]]
            i = 0
    return parts


def split_long(parts: list[list], score: list[float], tokens: list[int], max_turns: int, max_tokens: float) -> list[list]:
    """parts where each long one is split at its lowest score, of equal ones where both sides' tokens differ least, then first."""
    upto = np.concatenate(([0], np.cumsum(tokens)))
    todo, done = parts[::-1], []
    while todo:
        a, b, why = todo.pop()
        if b - a <= 1 or (b - a <= max_turns and upto[b] - upto[a] <= max_tokens):
            done.append([a, b, why])
            continue
        k = min(range(a + 1, b), key=lambda i: (score[i], abs(upto[i] - upto[a] - (upto[b] - upto[i])), i))
        todo += [[k, b, "forced_split"], [a, k, "forced_split"]]
    return done


def segments(turns: DataFrame, scope: str, order: str, alpha: float = 0.5, min_turns: int = 2, max_turns: int = 8, min_tokens: int = 0, max_tokens: float = float("inf")) -> DataFrame:
    """(scope, segment_no, first_turn, last_turn, n_turns, n_tokens, reason): boundaries, short ones merged, then long ones split.

    turns: scope, order, score (with the turn before; null at the start) and tokens. A segment is short below min_turns or
    min_tokens, and long above max_turns or max_tokens (see merge_short, split_long). Both rescan a scope's segments, so a
    scope (a session) is one pandas group.
    """
    marked = boundaries(turns.where(F.col("score").isNotNull()), scope, order, "score", alpha).select(scope, order, "is_boundary")
    rows = turns.join(marked, [scope, order], "left").select(scope, order, "score", "tokens", F.coalesce("is_boundary", F.lit(False)).alias("cut"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        score, at, tokens = pdf["score"].tolist(), pdf[order].tolist(), pdf["tokens"].fillna(0).astype(int).tolist()
        cuts = [i for i, c in enumerate(pdf["cut"]) if c and i]
        parts = [[a, b, "boundary" if a else "start"] for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True)]
        done = split_long(merge_short(parts, score, tokens, min_turns, min_tokens, max_turns), score, tokens, max_turns, max_tokens)
        return pd.DataFrame([(pdf[scope].iloc[0], n, at[a], at[b - 1], b - a, sum(tokens[a:b]), why) for n, (a, b, why) in enumerate(done)], columns=[scope, "segment_no", "first_turn", "last_turn", "n_turns", "n_tokens", "reason"])

    kinds = dict(turns.dtypes)
    spread = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, long work: not to be merged into one task
    return rows.repartition(spread, scope).groupBy(scope).applyInPandas(build, f"{scope} {kinds[scope]}, segment_no long, first_turn {kinds[order]}, last_turn {kinds[order]}, n_turns long, n_tokens long, reason string")


def largest_remainder(rows: DataFrame, batch: str, index: str, weight: str, total: str) -> DataFrame:
    """rows and allocated: total in whole units by weight, what is left to the largest fractions, ties to the smaller index.

    Batches without any weight are shared equally.
    """
    w = W.partitionBy(batch)
    share = F.when(F.sum(weight).over(w) == 0, F.col(total) / F.count("*").over(w)).otherwise(F.col(total) * F.col(weight) / F.sum(weight).over(w))
    r = rows.withColumn("__s", share.cast("double")).withColumn("__f", F.floor("__s"))
    r = r.withColumn("__left", F.col(total) - F.sum("__f").over(w)).withColumn("__n", F.row_number().over(w.orderBy(F.desc(F.col("__s") - F.col("__f")), index)))
    return r.withColumn("allocated", F.col("__f") + (F.col("__n") <= F.col("__left")).cast("long")).drop("__s", "__f", "__left", "__n")


def dedup_rank(facts: DataFrame, scope: str, key: list[str], order: list, limit: int) -> DataFrame:
    """The first fact of each key in a scope, ranked by order, limit at most."""
    once = facts.withColumn("__n", F.row_number().over(W.partitionBy(scope, *key).orderBy(*order))).where("__n = 1").drop("__n")
    return once.withColumn("rank", F.row_number().over(W.partitionBy(scope).orderBy(*order))).where(F.col("rank") <= limit)


def ranked_within(rows: DataFrame, scope: list[str], order: list, limit: int, name: str | None = None) -> DataFrame:
    """The first `limit` rows of each scope by order, with their rank under a name if one is given."""
    kept = rows.withColumn(name or "__rank", F.row_number().over(W.partitionBy(*scope).orderBy(*order))).where(F.col(name or "__rank") <= limit)
    return kept if name else kept.drop("__rank")


def round_robin(rows: DataFrame, stratum: str, order: list, limit: int) -> DataFrame:
    """limit rows: the first of each stratum, then the second of each, and so on; strata in order."""
    dealt = rows.withColumn("turn", F.row_number().over(W.partitionBy(stratum).orderBy(*order)))
    return dealt.where(F.col("turn") <= limit).orderBy("turn", stratum).limit(limit)


def shuffled(rows: DataFrame, scope: str, item: str, seed: str) -> DataFrame:
    """rows and position: a seeded order of a scope's items, by a hash."""
    return rows.withColumn("position", F.row_number().over(W.partitionBy(scope).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(scope).cast("string"), F.col(item).cast("string")), 256))))


def latest_complete(runs: DataFrame, scope: str, run: str, item: str, order: str, expected: int) -> DataFrame:
    """(scope, run, n_items): the last run, by its first row, that has all the expected items."""
    each = runs.groupBy(scope, run).agg(F.count_distinct(item).alias("n_items"), F.min(order).alias("first")).where(F.col("n_items") >= expected)
    best = each.groupBy(scope).agg(F.max(F.struct("first", run, "n_items")).alias("b"))
    return best.select(scope, f"b.{run}", "b.n_items")


def latest_run(rows: DataFrame, scope: str, run: str, items: list[str], order: str, expected: DataFrame) -> DataFrame:
    """(scope, run, items, and the other columns of rows): of each scope, the expected rows of its last complete run.

    expected: scope and items. A run is complete if it has all of its scope's expected items, and others may be there; the last
    one is that whose first row by `order` comes last. A run that has an item twice raises. A scope without a complete run has no rows.
    """
    pairs = expected.select(scope, *items).distinct()
    need = pairs.groupBy(scope).agg(F.count("*").alias("__need"))
    once = unique(rows, [scope, run, *items], "a run's item")
    began = once.groupBy(scope, run).agg(F.min(order).alias("__began"))
    useful = once.join(pairs, [scope, *items], "left_semi")
    runs = useful.groupBy(scope, run).agg(F.count("*").alias("__n")).join(need, scope).where("__n = __need").join(began, [scope, run])
    last = runs.groupBy(scope).agg(F.max(F.struct("__began", run)).alias("b")).select(scope, F.col(f"b.{run}").alias(run))
    return useful.join(last, [scope, run])


def built(turns: DataFrame, scope: list[str], order: str, line: str, tokens: str, score: str) -> DataFrame:
    """(scope, text, n_turns, n_tokens, mean_coherence): a segment's lines in order, its tokens, and the mean of the scores of its
    turns but the first, which tells of the turn before the segment; 1 for a single turn. One shuffle; a segment is short."""
    kept = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l"), F.col(score).alias("s"))))
    g = turns.groupBy(*scope).agg(kept.alias("k"), F.count("*").alias("n_turns"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("n_tokens"))
    inner = F.transform(F.slice("k", 2, F.greatest(F.size("k") - 1, F.lit(0))), lambda x: x["s"].cast("double"))
    mean = F.aggregate(inner, F.lit(0.0), lambda a, x: a + x) / F.size(inner)
    return g.select(*scope, F.array_join(F.transform("k", lambda x: x["l"]), "\n").alias("text"), "n_turns", "n_tokens", F.when(F.col("n_turns") > 1, mean).otherwise(1.0).alias("mean_coherence"))
