"""Joins whose keys are checked: a row without its partner is an error of the input, not a row to lose.

A check is a filter on the joined rows that raises on the first bad one. It costs no job and no shuffle of its own, and
column pruning cannot take it away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talkmill.functions.text import match_key


def must(df: DataFrame, good: Column, what: str, key: list[str]) -> DataFrame:
    """df; the first row that isn't good raises an error with what and the row's key. Null counts as bad."""
    name = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key])
    return df.where(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), name))))


def unique(df: DataFrame, key: list[str], what: str) -> DataFrame:
    """df; a key that two rows have raises. The shuffle is by key, so a join on the key that follows needs none."""
    return must(df.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*key))), F.col("__n") == 1, f"{what}, repeated", key).drop("__n")


def exact(left: DataFrame, right: DataFrame, key: list[str], what: str) -> DataFrame:
    """left and right joined on key; a key that only one of them has raises."""
    both = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), key, "full_outer")
    return must(both, F.col("__l").isNotNull() & F.col("__r").isNotNull(), f"{what}, on one side only", key).drop("__l", "__r")


def covered(left: DataFrame, right: DataFrame, key: list[str], what: str) -> DataFrame:
    """Each row of left with its partner; a row without one raises. right may have more."""
    both = left.join(right.withColumn("__r", F.lit(True)), key, "left")
    return must(both, F.col("__r").isNotNull(), f"{what}, missing", key).drop("__r")


def observations(predictions: DataFrame, labels: DataFrame, costs: DataFrame, key: list[str]) -> DataFrame:
    """Predictions, labels and costs of one key set each; costs may have more keys. A profile that differs raises.

    predictions and labels: key and profile_id; the label's profile is dropped after the check.
    """
    told = exact(unique(predictions, key, "prediction"), unique(labels.withColumnRenamed("profile_id", "__p"), key, "label"), key, "prediction and label")
    same = must(told, F.col("profile_id").eqNullSafe(F.col("__p")), "profiles differ", key).drop("__p")
    return covered(same, unique(costs, key, "cost"), key, "cost")


def judge_tasks(segments: DataFrame, references: DataFrame, candidates: DataFrame, models: list[str], key: str) -> DataFrame:
    """(key, model_id, candidate_ids, reference_ids): a task for each segment and model; a model without candidates has none.

    The models are a short given list, so they are an array in each segment's row, and not a join.
    """
    refs = references.groupBy(key).agg(F.array_sort(F.collect_set("reference_id")).alias("reference_ids"))
    cands = candidates.groupBy(key, "model_id").agg(F.array_sort(F.collect_set("candidate_id")).alias("candidate_ids"))
    tasks = segments.select(key).join(refs, key, "left").withColumn("model_id", F.explode(F.array(*[F.lit(m) for m in models])))
    none = F.array().cast("array<string>")
    return tasks.join(cands, [key, "model_id"], "left").select(key, "model_id", F.coalesce("candidate_ids", none).alias("candidate_ids"), F.coalesce("reference_ids", none).alias("reference_ids"))


def leaked(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys that both parts hold: none, if training and validation are apart."""
    return a.select(*key).intersect(b.select(*key))


def gaps(wanted: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """Wanted keys that are not present."""
    return wanted.select(*key).distinct().join(present.select(*key).distinct(), key, "left_anti")


def grounded(facts: DataFrame, segments: DataFrame, key: list[str]) -> DataFrame:
    """facts with in_segment: all source turns are among the segment's, and the content hashes agree. Unknown segment: false.

    facts: key, sources (array), content_hash; segments: key, turns (array), segment_hash.
    """
    inside = (F.size(F.array_except("sources", "turns")) == 0) & (F.col("content_hash") == F.col("segment_hash"))
    return facts.join(segments.select(*key, "turns", "segment_hash"), key, "left").withColumn("in_segment", F.coalesce(inside, F.lit(False))).drop("turns", "segment_hash")


def shared(members: DataFrame, part: str, item: str) -> DataFrame:
    """(a, b, n): how many items two parts share, a < b. An item's parts are gathered once: parts are few, items many."""
    parts = members.select(part, item).distinct().groupBy(item).agg(F.array_sort(F.collect_set(part)).alias("p")).where("size(p) > 1")
    pairs = F.flatten(F.transform("p", lambda x, i: F.transform(F.filter("p", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return parts.select(F.explode(pairs).alias("e")).groupBy("e.a", "e.b").agg(F.count("*").alias("n"))


def reconcile(ledger: DataFrame, state: DataFrame, key: list[str], done: str = "committed") -> DataFrame:
    """(key, problem): keys where ledger (cost) and state (status) don't agree; agreeing keys give no row."""
    both = ledger.select(*key, F.lit(True).alias("__l")).join(state.select(*key, "status"), key, "full_outer")
    problem = (
        F.when(F.col("status").isNull(), "no_state").when((F.col("status") == done) & F.col("__l").isNull(), "committed_without_cost")
        .when((F.col("status") != done) & F.col("__l").isNotNull(), "cost_without_commit")
    )
    return both.select(*key, problem.alias("problem")).where("problem is not null")


def preceding(segments: DataFrame, session: list[str], order: str, text: str) -> DataFrame:
    """segments with `preceding`: the last non-blank line of the session's segment before, or an empty text."""
    lines = F.filter(F.split(F.lag(text).over(W.partitionBy(*session).orderBy(order)), "\n"), lambda x: F.trim(x) != "")
    return segments.withColumn("preceding", F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")))


def assembly(routes: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Points of the tier that a segment is routed to; a segment routed to two tiers raises. A segment may have no points."""
    return unique(routes.select(key, "tier"), [key], "route").join(points, [key, "tier"])


#: Fixed value: the name space of ids made of URLs and other names.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def named_uuid(name: Column) -> Column:
    """The version 5 UUID of a name in NAMESPACE_URL."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def stamped(routes: DataFrame, points: DataFrame, key: str, point: str, assembly_id: str, episode_id: str, policy_version: str) -> DataFrame:
    """The points of an assembly, each with a new id that follows from the assembly, the tier and the old id, and with its origin.

    routes: key, tier, one row a segment. points: key, tier, point (the old id) and others; its tier and point become
    source_collection_tier and source_point_id, its extraction_run_id (empty if it has none) source_extraction_run_id.
    """
    run = F.coalesce("extraction_run_id", F.lit("")) if "extraction_run_id" in points.columns else F.lit("")
    made = named_uuid(F.concat_ws(":", F.lit(assembly_id), "tier", F.col(point).cast("string")))
    old = F.col(point).cast("string").alias("source_point_id")
    marks = [F.lit(v).alias(k) for k, v in {"assembly_id": assembly_id, "episode_id": episode_id, "policy_version": policy_version}.items()]
    rest = [c for c in points.columns if c not in (key, "tier", point, "assembly_id", "episode_id", "policy_version")]
    return assembly(routes, points, key).select(key, made.alias(point), *rest, F.col("tier").alias("source_collection_tier"), old, run.alias("source_extraction_run_id"), *marks)


def priced(usage: DataFrame, prices: dict[str, tuple[float, float]], tier: str = "tier") -> DataFrame:
    """usage with `cost`: tokens in and out at a tier's price for a million. Prices are a literal map; an unknown tier raises."""
    table = F.create_map(*[x for t, (i, o) in prices.items() for x in (F.lit(t), F.struct(F.lit(float(i)).alias("i"), F.lit(float(o)).alias("o")))])
    rows = must(usage.withColumn("__p", F.try_element_at(table, F.col(tier))), F.col("__p").isNotNull(), "no price", [tier])
    return rows.withColumn("cost", (F.col("input_tokens") * F.col("__p.i") + F.col("output_tokens") * F.col("__p.o")) / 1e6).drop("__p")


def same_facts(candidates: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """(key, candidate_id, reference_id): facts of a segment with one text, as match_key sees it, and a source in common.

    Both: key, an id, text, sources (array). The text is part of the join's key; the sources are checked on what meets.
    """
    c = candidates.select(key, "candidate_id", match_key(F.col("text")).alias("__t"), F.col("sources").alias("__c"))
    r = references.select(key, "reference_id", match_key(F.col("text")).alias("__t"), F.col("sources").alias("__r"))
    return c.join(r, [key, "__t"]).where(F.arrays_overlap("__c", "__r")).select(key, "candidate_id", "reference_id")


def evidence_turns(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """questions with turn_ids: the turns that their evidence names, sorted; names of no turn are left out.

    questions: sample_id, question_id, evidence (array of turn names); turns: sample_id, dia_id, turn_id.
    """
    named = questions.select("sample_id", "question_id", F.explode("evidence").alias("dia_id"))
    found = named.join(turns.select("sample_id", "dia_id", "turn_id"), ["sample_id", "dia_id"]).groupBy("sample_id", "question_id").agg(F.array_sort(F.collect_set("turn_id")).alias("turn_ids"))
    return questions.join(found, ["sample_id", "question_id"], "left").withColumn("turn_ids", F.coalesce("turn_ids", F.array().cast("array<int>")))
