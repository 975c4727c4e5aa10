"""Experiments put together from operators and hooks: reference facts, fact corpora, judging, question answering, training rows, policy training, folds.

A hook is a model behind a function from DataFrame to DataFrame; its answers are kept before they are read twice (see chains).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.functions import records as P
from talkmill.functions.text import fact_key
from talkmill.operators import evaluation, joins, ordered, replies, stores
from talkmill.operators.chains import Hook
from talkmill.operators.learned import ActorCritic, Network
from talkmill.session import checkpointed

# Words that results depend on, states in the order of their rank.
FACT_TYPES = ["identity", "relationship", "event", "state", "plan", "goal", "preference", "decision", "constraint", "health", "knowledge", "assistant_answer", "negative", "other"]
STATES = ["current", "timeless", "historical", "unspecified"]


def proposed(facts: DataFrame, segments: DataFrame, origin: str, limit: int) -> DataFrame:
    """A model's proposals as facts: types and states made valid, at most limit a segment, in their order; those that cite a turn
    outside their segment, or none, or have no text, go. facts: segment_id, proposal_order, text, sources, fact_type, state_status."""
    known = facts.join(segments.select("segment_id", "turns"), "segment_id")
    good = known.where((F.size("sources") > 0) & (F.size(F.array_except("sources", "turns")) == 0) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    kept = ordered.ranked_within(good, ["segment_id"], ["proposal_order"], limit)
    return kept.select("segment_id", "proposal_order", F.trim("text").alias("text"), F.array_sort(F.array_distinct("sources")).alias("sources"), P.coerced(F.col("fact_type"), FACT_TYPES, "other").alias("fact_type"), P.coerced(F.col("state_status"), STATES, "unspecified").alias("state_status"), F.lit(origin).alias("origin"))


def grounded(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Facts that their decision accepts; a fact without decision is rejected. decisions: segment_id, proposal_order and six answers."""
    answers = ["decision", "entailed", "atomic", "sufficient", "external", "duplicate_of"]
    told = facts.join(joins.unique(decisions.select("segment_id", "proposal_order", *answers), ["segment_id", "proposal_order"], "decision"), ["segment_id", "proposal_order"])
    return told.where(P.accepted(*[F.col(a) for a in answers])).drop(*answers)


def reference_facts(segments: DataFrame, extract: Hook, ground: Hook, cover: Hook, priority: list[str], most: int = 30, limit: int = 15, keep: Hook = checkpointed) -> DataFrame:
    """(segment_id, reference_fact_id, text, sources, fact_type, state_status, origin, rank): the frozen facts of each segment.

    Facts are proposed, grounded, completed by a second look at what was accepted, grounded again; those equal in normalised
    text and sources become the first one, and the best `limit` by type, state, first source, order and text stay.
    extract: segments to proposals; ground: facts to decisions; cover: accepted facts to proposals, whose order goes on from 1000.
    """
    first = keep(proposed(keep(extract(segments)), segments, "initial", most))
    kept = keep(grounded(first, keep(ground(first))))
    room = first.groupBy("segment_id").agg(F.count("*").alias("__used"))
    more = proposed(keep(cover(kept)).withColumn("proposal_order", F.col("proposal_order") + 1000), segments, "coverage", most).join(room, "segment_id", "left")
    more = keep(ordered.ranked_within(more, ["segment_id"], ["proposal_order"], most, "__n").where(F.col("__n") + F.coalesce("__used", F.lit(0)) <= most).drop("__n", "__used"))
    both = kept.unionByName(grounded(more, keep(ground(more)))).withColumn("key", fact_key(F.col("text")))
    place = lambda c, names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(c)), F.lit(0)), F.lit(len(names) + 1))
    once = ordered.ranked_within(both, ["segment_id", "key", "sources"], ["proposal_order"], 1)
    best = ordered.ranked_within(once, ["segment_id"], [place("fact_type", priority), place("state_status", STATES), F.array_min("sources"), "proposal_order", "key"], limit, "rank")
    return best.select("segment_id", P.fact_id(F.col("segment_id"), F.col("key"), F.col("sources")).alias("reference_fact_id"), "text", "sources", "fact_type", "state_status", "origin", "rank")


def corpus(manifests: DataFrame, facts: DataFrame, segments: DataFrame, samples: DataFrame) -> DataFrame:
    """The facts of complete, reconciled runs. Raises for: a run that is not, a campaign that lacks a sample, a model in two
    campaigns, a fact id that repeats, and a fact outside its segment.

    manifests: campaign_id, sample_id, run_id, status, reconciled; facts: fact_id, run_id, model_id, segment_id, sources,
    content_hash; segments: segment_id, turns, segment_hash; samples: sample_id.
    """
    runs = joins.must(manifests, (F.col("status") == "complete") & F.col("reconciled"), "run not complete", ["run_id"])
    runs = joins.unique(runs, ["campaign_id", "sample_id"], "run")
    # A campaign lacks a sample if it has fewer of the samples than there are: counts say so without pairing campaigns and samples.
    counted = runs.join(samples.select("sample_id").distinct(), "sample_id", "left_semi").groupBy("campaign_id").agg(F.count_distinct("sample_id").alias("__n"))
    whole = samples.agg(F.count_distinct("sample_id").alias("__all"))
    complete = joins.must(runs.join(counted, "campaign_id", "left").crossJoin(F.broadcast(whole)), F.coalesce("__n", F.lit(0)) == F.col("__all"), "campaign lacks samples", ["campaign_id"])
    told = joins.covered(facts, complete.select("run_id", "campaign_id", "sample_id"), ["run_id"], "run of a fact")
    told = joins.unique(told, ["fact_id"], "fact")
    homes = told.groupBy("model_id").agg(F.count_distinct("campaign_id").alias("__c"))
    told = joins.must(told.join(homes, "model_id"), F.col("__c") == 1, "model in several campaigns", ["model_id"]).drop("__c")
    return joins.must(joins.grounded(told, segments, ["segment_id"]), F.col("in_segment"), "fact outside its segment", ["fact_id"]).drop("in_segment")


def answered(questions: DataFrame, points: DataFrame, reader: Hook, judge: Hook, k: int = 20, done: DataFrame | None = None, keep: Hook = checkpointed) -> DataFrame:
    """(question_id, sample_id, answer, label, correct): questions answered from their sample's k nearest facts, and judged.

    questions: question_id, sample_id, question, q (vector); points: point_id, sample_id, v, line (the fact as a line). A label
    that is neither right nor wrong gives a null `correct`. done: rows of an earlier run, which are not asked again and are returned too.
    reader: question_id, question, memories to question_id, answer; judge: question_id, question, answer to question_id, label (JSON).
    """
    open_ = questions if done is None else questions.join(done.select("question_id"), "question_id", "left_anti")
    near = stores.knn(open_.select("question_id", "sample_id", "q").withColumnRenamed("question_id", "query_id"), points.select("point_id", "sample_id", "v"), "sample_id", k)
    lines = near.join(points.select("point_id", "line"), "point_id").groupBy(F.col("query_id").alias("question_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("m"))
    memories = F.coalesce(F.array_join(F.transform("m", lambda x: x["line"]), "\n"), F.lit("(no retrieved memories)"))
    asked = open_.join(lines, "question_id", "left").select("question_id", "question", memories.alias("memories"))
    told = keep(reader(asked).select("question_id", "answer"))
    labels = keep(judge(open_.select("question_id", "question").join(told, "question_id")).select("question_id", "label"))
    new = open_.select("question_id", "sample_id").join(told, "question_id", "left").join(labels, "question_id", "left").select("question_id", "sample_id", "answer", "label", P.json_label(F.col("label")).alias("correct"))
    return new if done is None else new.unionByName(done.select(*new.columns))


def speaker_memories(memories: DataFrame, first: str, second: str) -> DataFrame:
    """(question_id, first, second): each question's lines by whose memory they are, in order of rank; `(none)` without any.

    memories: question_id, rank, ts, weekday, fact, source, and the speakers' names in columns first and second.
    """
    side = P.speaker_side(F.col("source"), F.col("fact"), F.col(first), F.col(second))
    rows = memories.select("question_id", "rank", side.alias("s"), P.memory_line(F.col("ts"), F.col("weekday"), F.col("fact")).alias("l"))
    of = lambda n: F.coalesce(F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("s") == n, F.struct("rank", "l")))), lambda x: x["l"]), "\n"), F.lit("")), F.lit("(none)"))
    return rows.groupBy("question_id").agg(of(1).alias("first"), of(2).alias("second"))


def judged(tasks: DataFrame, call: Hook, done: DataFrame | None = None, keep: Hook = checkpointed) -> DataFrame:
    """(segment_id, content, results, error): judgments of tasks (segment_id, sets, gold), read strictly. done: earlier rows; the good ones are not asked for again."""
    good = None if done is None else done.where("error IS NULL")
    open_ = tasks if good is None else tasks.join(good.select("segment_id"), "segment_id", "left_anti")
    told = keep(call(open_).select("segment_id", "content"))
    new = replies.judgments(open_.join(told, "segment_id", "left")).select("segment_id", "content", "results", "error")
    return new if good is None else new.unionByName(good.select(*new.columns))


def training_rows(labels: DataFrame, features: DataFrame, profiles: DataFrame, key: list[str], sample: str, held: DataFrame) -> DataFrame:
    """key, model_id, features (segment's and model's in one array), quality, held_out: what a scorer is trained on.

    labels: key, model_id, quality; features: key, vector; profiles: model_id, dimensions (array); held: samples of the validation.
    A label without its segment or profile, or a repeated one, raises.
    """
    rows = joins.covered(joins.unique(labels, [*key, "model_id"], "label"), features.select(*key, "vector"), key, "segment of a label")
    rows = joins.covered(rows, profiles.select("model_id", "dimensions"), ["model_id"], "profile")
    apart = held.select(sample).distinct().withColumn("held_out", F.lit(True))
    return rows.join(apart, sample, "left").select(*key, "model_id", F.concat(F.col("vector").cast("array<double>"), F.col("dimensions").cast("array<double>")).alias("features"), "quality", F.coalesce("held_out", F.lit(False)).alias("held_out"))


def trained_policy(trainer: ActorCritic, episodes: list[tuple[np.ndarray, Callable]], validate: Callable[[Network], tuple[float, float]], epochs: int, patience: int) -> tuple[Network | None, list[dict]]:
    """(best network, history): the epoch with the best (quality, least cost) on validation among those within the budget, or None.

    An epoch runs all episodes (features, evaluate). Training stops after `patience` epochs that bring nothing better.
    """
    best, kept, since, history = None, None, 0, []
    for epoch in range(1, epochs + 1):
        for x, evaluate in episodes:
            trainer.step(x, evaluate)
        quality, cost = validate(trainer.network)
        better = cost <= trainer.budget and (best is None or (quality, -cost) > best)
        if better:
            best, kept = (quality, -cost), trainer.network.copy()
        since = 0 if better else since + 1
        history.append({"epoch": epoch, "quality": quality, "cost": cost, "best": better})
        if since >= patience:
            break
    return kept, history


def cross_validated(folds: DataFrame, n: int, run: Callable[[int, DataFrame], DataFrame], experiment: str, consistent: list[str]) -> DataFrame:
    """One row: an experiment's accuracy over its folds. run: a fold's number and its members (sample_id, part) to outcomes
    (sample_id, correct, and columns of consistent). An outcome of a sample that is not held out in its fold raises."""
    out = None
    for i in range(n):
        members = folds.where(F.col("fold") == i).select("sample_id", "part")
        tested = joins.covered(run(i, members), members.where("part = 'test'"), ["sample_id"], "sample not held out").drop("part")
        one = evaluation.micro_macro(tested, "sample_id", F.col("correct")).crossJoin(tested.groupBy().agg(*[F.max(c).alias(c) for c in consistent], *[F.count_distinct(c).alias(f"__{c}") for c in consistent]))
        for c in consistent:
            one = joins.must(one, F.col(f"__{c}") <= 1, f"{c} differs in a fold", [c]).drop(f"__{c}")
        one = one.withColumn("experiment", F.lit(experiment))
        out = one if out is None else out.unionByName(one)
    return evaluation.folds(out, "experiment", consistent, "micro")
