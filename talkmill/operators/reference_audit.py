"""The audit of a frozen collection of reference facts: every broken rule as a row, and the queue of what people have to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.records import fact_id
from talkmill.functions.text import fact_key, stripped
from talkmill.operators.experiments import FACT_TYPES, STATES
from talkmill.operators.joins import unique
from talkmill.operators.ordered import round_robin
from talkmill.session import checkpointed

# The fields that rows, segments and facts have to have.
SEGMENT_FIELDS = ["dataset_name", "split", "sample_id", "session_id", "segment_id", "segment_order", "segmentation_method", "segmentation_version", "source_content_hash", "segment_turn_ids"]
ROW_FIELDS = ["schema_version", *SEGMENT_FIELDS, "reference_set_hash", "reference_facts", "raw_proposal_count", "grounded_accept_count", "frozen_fact_count", "truncated_to_k", "run_id", "prompt_version", "config_hash"]
FACT_FIELDS = ["reference_fact_id", "fact_text", "text", "source_turn_ids", "fact_type", "state_status", "origin", "grounding_reason", "selection_rank"]

#: What stands for an archive or a ledger that was named and isn't there; None is one that isn't asked for.
MISSING = "missing"
ISSUE = "severity string, code string, segment_id string, fact_id string, detail string"


def set_hash(facts: Column) -> Column:
    """The digest of a list of facts (id, text, sources): their compact JSON, [[id, text, [sources]], ...]."""

    def one(f: Column) -> Column:
        head = F.to_json(F.array(f["id"], f["text"]))
        return F.concat(F.left(head, F.length(head) - 1), F.lit(","), F.to_json(f["sources"]), F.lit("]"))

    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(facts, one), ","), F.lit("]")), 256)


def _integers(value: Column) -> Column:
    """A JSON list as integers; an empty one for anything else."""
    numbers = F.transform(F.try_variant_get(value, "$.source_turn_ids", "array<string>"), lambda x: x.try_cast("bigint"))
    return F.coalesce(F.when(~F.exists(numbers, lambda x: x.isNull()), numbers), F.array().cast("array<bigint>"))


def _fact(f: Column) -> Column:
    def text(name):
        return F.try_variant_get(f, f"$.{name}", "string")

    body = F.coalesce(text("fact_text"), F.lit(""))
    return F.struct(
        F.coalesce(text("reference_fact_id"), F.lit("")).alias("id"), body.alias("text"), fact_key(body).alias("key"), text("text").alias("alias"), _integers(f).alias("sources"),
        text("fact_type").alias("type"), text("state_status").alias("state"), text("origin").alias("origin"), text("grounding_reason").alias("why"),
        F.try_variant_get(f, "$.selection_rank", "int").alias("rank"), F.array_except(_names(FACT_FIELDS), F.json_object_keys(F.to_json(f))).alias("missing"),
    )


def _names(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _issue(bad: Column, code: str, fact: Column | None = None, detail: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.when(bad, F.struct(F.lit(code).alias("code"), (none if fact is None else fact).alias("fact_id"), (none if detail is None else detail.cast("string")).alias("detail")))


def _fact_issues(f: Column, i: Column) -> Column:
    """What is wrong with the i-th fact (from 0) by itself or beside those before it."""
    one = lambda bad, code, detail=None: _issue(bad, code, f["id"], detail)
    before = F.slice("facts", 1, i)
    return F.array_compact(F.array(
        one(F.size(f["missing"]) > 0, "missing_fact_fields", F.array_join(F.array_sort(f["missing"]), ",")),
        one((f["id"] == "") | (f["text"] == "") | (F.size(f["sources"]) == 0), "empty_required_fact_value"),
        one(~f["alias"].eqNullSafe(f["text"]), "fact_text_alias_mismatch"),
        one(F.coalesce(stripped(f["why"]), F.lit("")) == "", "empty_grounding_reason"),
        one(F.size(F.array_except(f["sources"], F.col("turn_ids"))) > 0, "invalid_source_turn_ids", F.to_json(f["sources"])),
        one(~F.coalesce(f["type"].isin(FACT_TYPES), F.lit(False)), "invalid_fact_type", f["type"]),
        one(~F.coalesce(f["state"].isin(STATES), F.lit(False)), "invalid_state_status", f["state"]),
        one(f["id"] != fact_id(F.col("segment_id"), f["key"], f["sources"]), "reference_fact_id_hash_mismatch"),
        one(F.exists(before, lambda g: g["id"] == f["id"]), "duplicate_fact_id_within_segment"),
        one(F.exists(before, lambda g: (g["key"] == f["key"]) & (g["sources"] == f["sources"])), "exact_duplicate_same_source"),
        one(F.exists(before, lambda g: g["key"] == f["key"]), "exact_duplicate_different_source"),
    ))


def checked_rows(references: DataFrame, segments: DataFrame, keep=checkpointed) -> DataFrame:
    """(row, segment_id, facts, found, is_known, n_facts, cap, config_hash, run_id, prompt_version) of each reference row, and of each
    segment that has none (row null). found: its broken rules. facts and n_facts are null where the row's facts are not judged.

    references: row (any order), value (a JSON object). segments: SEGMENT_FIELDS, with segment_turn_ids as an array of integers,
    one row a segment. Only a segment's first row is judged. Rows meet segments and first rows in one join.
    """
    v = F.col("v")
    text = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    number = lambda name, other: F.coalesce(F.try_variant_get(v, f"$.{name}", "int"), F.lit(other))
    rows = references.select("row", "value", F.parse_json("value").alias("v")).withColumn("segment_id", F.coalesce(text("segment_id"), F.lit("")))
    expected = F.to_json(F.struct(*SEGMENT_FIELDS), {"ignoreNullFields": "false"})
    known = unique(segments, ["segment_id"], "segment").select(F.col("segment_id").cast("string"), F.col("segment_turn_ids").cast("array<bigint>").alias("turn_ids"), F.parse_json(expected).alias("expected"))
    first = rows.where("segment_id <> ''").groupBy("segment_id").agg(F.min("row").alias("first"))
    both = rows.join(first.join(known, "segment_id", "full_outer"), "segment_id", "full_outer")

    facts = F.transform(F.try_variant_get(v, "$.reference_facts", "array<variant>"), _fact)
    judged = (F.col("row") == F.col("first")) & F.col("turn_ids").isNotNull()
    both = both.withColumn("judged", F.coalesce(judged, F.lit(False))).withColumn("facts", F.when(F.col("judged"), facts))
    n = F.size("facts")
    ranks = F.transform("facts", lambda f: f["rank"])

    def differs(name: str) -> Column:
        mine, theirs = (F.nullif(F.to_json(F.variant_get(x, f"$.{name}", "variant")), F.lit("null")) for x in (v, F.col("expected")))
        return _issue(~mine.eqNullSafe(theirs), "segment_metadata_mismatch", detail=F.lit(name))

    missing = F.array_except(_names(ROW_FIELDS), F.json_object_keys("value"))
    of_set = [
        _issue(number("frozen_fact_count", -1) != n, "frozen_fact_count_mismatch", detail=text("frozen_fact_count")),
        _issue(number("grounded_accept_count", -1) < n, "accepted_count_less_than_frozen"),
        _issue(number("raw_proposal_count", -1) < number("grounded_accept_count", 0), "proposal_count_less_than_accepted"),
        _issue(~ranks.eqNullSafe(F.transform("facts", lambda f, i: i + 1)), "noncontiguous_selection_rank"),
        _issue(~text("reference_set_hash").eqNullSafe(set_hash(F.col("facts"))), "reference_set_hash_mismatch"),
    ]
    none = F.array().cast("array<struct<code: string, fact_id: string, detail: string>>")
    found = F.when(F.col("row").isNull(), F.array(_issue(F.lit(True), "missing_reference_row"))).otherwise(F.concat(
        F.array_compact(F.array(
            _issue(F.size(missing) > 0, "missing_row_fields", detail=F.array_join(F.array_sort(missing), ",")),
            _issue(F.col("segment_id") == "", "missing_segment_id"),
            _issue(F.col("row") != F.col("first"), "duplicate_reference_segment"),
            _issue((F.col("row") == F.col("first")) & F.col("turn_ids").isNull(), "missing_source_segment"),
            _issue((F.col("row") == F.col("first")) & F.col("turn_ids").isNull(), "extra_reference_row"),
            _issue(F.col("judged") & F.col("facts").isNull(), "reference_facts_not_list"),
        )),
        F.when(F.col("judged"), F.array_compact(F.array(*[differs(name) for name in SEGMENT_FIELDS]))).otherwise(none),
        F.when(F.col("facts").isNotNull(), F.concat(F.array_compact(F.array(*of_set)), F.flatten(F.transform("facts", _fact_issues)))).otherwise(none),
    ))
    slim = F.transform("facts", lambda f: F.struct(*[f[c].alias(c) for c in ("id", "type", "state", "origin")]))
    named = [F.coalesce(text(c), F.lit("None")).alias(c) for c in ("config_hash", "run_id", "prompt_version")]
    capped = F.coalesce(F.try_variant_get(v, "$.truncated_to_k", "boolean"), F.lit(False)).alias("cap")
    both = both.withColumn("found", found)  # first: beside a new `facts`, it would read that one
    return keep(both.select("row", "segment_id", slim.alias("facts"), "found", F.col("turn_ids").isNotNull().alias("is_known"), F.when(F.col("facts").isNotNull(), n).alias("n_facts"), capped, *named))


def _facts(checked: DataFrame) -> DataFrame:
    return checked.select("row", "segment_id", F.posexplode("facts").alias("pos", "f")).select("row", "segment_id", "pos", "f.*")


def _twice(checked: DataFrame) -> DataFrame:
    """Facts whose id an earlier fact of the collection has. Ids are counted before they meet the facts again."""
    facts = _facts(checked).select("row", "segment_id", "pos", "id")
    often = facts.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("first")).where("n > 1").select("id", "first")
    return facts.join(often, "id").where(F.struct("row", "pos") != F.col("first"))


def _manifest_issues(totals: DataFrame, manifest: dict) -> Column:
    """Of the one row of totals: what the manifest tells otherwise."""
    number = lambda name: F.lit(int(manifest.get(name, -1)))

    def mixed(name: str) -> Column:
        alone = (F.col("n_rows") > 0) & F.col(f"min_{name}").eqNullSafe(F.col(f"max_{name}"))
        return ~(alone & F.col(f"min_{name}").eqNullSafe(F.lit(manifest.get(name))))

    return F.array_compact(F.array(
        _issue(F.lit(not manifest.get("run_complete")), "manifest_run_incomplete"),
        _issue(number("unresolved_failure_count") != 0, "manifest_has_unresolved_failures", detail=number("unresolved_failure_count")),
        _issue(number("segment_count") != F.col("n_rows"), "manifest_segment_count_mismatch"),
        _issue(number("fact_count") != F.col("n_facts"), "manifest_fact_count_mismatch"),
        _issue(mixed("config_hash"), "mixed_or_manifest_mismatched_config_hash"),
        _issue(mixed("run_id"), "mixed_or_manifest_mismatched_run_id"),
        _issue(~F.coalesce(F.col("min_prompt_version") == F.col("max_prompt_version"), F.lit(False)), "mixed_prompt_versions"),
    ))


def archived(archive: DataFrame) -> DataFrame:
    """(segment_id, stage, is_json) of archived replies (value: a text). Texts that are no JSON object have neither."""
    v = F.try_parse_json("value")
    return archive.select(*[F.coalesce(F.try_variant_get(v, f"$.{c}", "string"), F.lit(other)).alias(c) for c, other in (("segment_id", ""), ("stage", "unknown"))], v.isNotNull().alias("is_json"))


def audit(spark: SparkSession, checked: DataFrame, segments: DataFrame, manifest: dict, archive: DataFrame | str | None = None, ledger: dict | str | None = None) -> DataFrame:
    """(severity, code, segment_id, fact_id, detail): a row for each broken rule; a collection without an `error` row passes.

    checked: of `checked_rows`. manifest: the collection's. archive: replies (value); ledger: sets and failures (tables) and
    quick_check (what SQLite says, ["ok"] for a sound file). MISSING for either tells that it should be there. An empty
    collection breaks the rules of single config, run and prompt version, as it has none.
    """
    own = checked.select("segment_id", F.explode("found").alias("i")).select(F.lit("error").alias("severity"), "i.code", "segment_id", "i.fact_id", "i.detail")
    again = _twice(checked).select(F.lit("error"), F.lit("duplicate_fact_id_globally"), "segment_id", F.col("id"), F.lit(None).cast("string"))
    kinds = ["config_hash", "run_id", "prompt_version"]
    totals = checked.where("row IS NOT NULL").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("n_facts"), F.lit(0)).alias("n_facts"), *[f(c).alias(f"{f.__name__}_{c}") for c in kinds for f in (F.min, F.max)])

    def whole(df: DataFrame, issues: Column, severity: str) -> DataFrame:
        return df.select(F.explode(issues).alias("i")).select(F.lit(severity), "i.code", F.lit(None).cast("string"), "i.fact_id", "i.detail")

    def told(severity: str, code: str, detail: str | None = None) -> DataFrame:
        return spark.createDataFrame([(severity, code, None, None, detail)], ISSUE)

    out = own.union(again).union(whole(totals, _manifest_issues(totals, manifest), "error"))
    if not manifest.get("cost_complete"):
        out = out.union(told("warning", "incomplete_cost_accounting"))
    if isinstance(archive, str):
        out = out.union(told("warning", "raw_archive_missing"))
    elif archive is not None:
        a = archived(archive)
        bad = a.agg(F.count_if(~F.col("is_json")).alias("n"))
        lost = segments.select(F.col("segment_id").cast("string")).join(a.select("segment_id").distinct(), "segment_id", "left_anti").agg(F.count("*").alias("n"))
        for df, code in ((bad, "invalid_raw_archive_json"), (lost, "segments_missing_raw_archive")):
            out = out.union(whole(df, F.array_compact(F.array(_issue(F.col("n") > 0, code, detail=F.col("n")))), "warning"))
    if isinstance(ledger, str):
        out = out.union(told("error", "ledger_missing"))
    elif ledger is not None:
        if list(ledger["quick_check"]) != ["ok"]:
            out = out.union(told("error", "ledger_quick_check_failed", ",".join(ledger["quick_check"])))
        count = lambda df, name: df.agg(F.count("*").alias(name))
        sizes = count(checked.where("row IS NOT NULL"), "n_rows").crossJoin(F.broadcast(count(ledger["sets"], "n_sets"))).crossJoin(F.broadcast(count(ledger["failures"], "n_failures")))
        out = out.union(whole(sizes, F.array_compact(F.array(
            _issue(F.col("n_sets") != F.col("n_rows"), "ledger_reference_set_count_mismatch", detail=F.col("n_sets")),
            _issue(F.col("n_failures") > 0, "ledger_contains_failures", detail=F.col("n_failures")),
        )), "error"))
    return out


def review_id(category: Column, segment: Column, facts: Column) -> Column:
    """A review's stable id: a digest of its category, segment and fact ids as compact JSON."""
    head = F.to_json(F.array(category, segment))
    return F.concat(F.lit("review_"), F.left(F.sha2(F.concat(F.left(head, F.length(head) - 1), F.lit(","), F.to_json(facts), F.lit("]")), 256), F.lit(16)))


def review_queue(checked: DataFrame, archive: DataFrame | None = None, vectors: DataFrame | None = None, limit: int = 15, sample: int = 120, similar: float = 0.9, seed: str = "42") -> DataFrame:
    """(review_id, category, segment_id, fact_ids, detail): what people have to look at, each once.

    Segments without facts, with limit facts or more (or cut to a limit), with a repaired reply in the archive; pairs of a
    segment's facts whose unit vectors (segment_id, id, vector) have an inner product of `similar` or more; and `sample`
    facts, dealt in turn from each combination of type, state and origin, in an order that the seed gives.
    """
    none = F.array().cast("array<string>")
    ids = F.transform("facts", lambda f: f["id"])
    item = lambda df, category, facts, detail=None: df.select(F.lit(category).alias("category"), "segment_id", facts.alias("fact_ids"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))
    judged = checked.where("n_facts IS NOT NULL")
    out = item(judged.where("n_facts = 0"), "zero_reference_set", none).union(item(judged.where(F.col("cap") | (F.col("n_facts") >= limit)), "fact_cap_reached", ids))
    if archive is not None:
        repaired = archived(archive).where(F.col("stage").endswith("_json_repair")).select("segment_id").distinct()
        out = out.union(item(checked.where("is_known").select("segment_id").distinct().join(repaired, "segment_id", "left_semi"), "json_repair_used", none))
    facts = _facts(checked)
    if vectors is not None:
        v = facts.join(vectors, ["segment_id", "id"]).select("segment_id", "pos", "id", "vector")
        a, b = (v.select("segment_id", *[F.col(c).alias(f"{c}_{s}") for c in ("pos", "id", "vector")]) for s in "ab")
        dot = F.aggregate(F.zip_with("vector_a", "vector_b", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        near = a.join(b, "segment_id").where("pos_a < pos_b").withColumn("dot", dot).where(F.col("dot") >= similar)
        out = out.union(item(near, "near_duplicate_pair", F.array("id_a", "id_b"), F.format_number("dot", 4)))
    stratum = F.to_json(F.array(*[F.coalesce(c, F.lit("None")) for c in ("type", "state", "origin")]))
    order = F.sha2(F.concat_ws("|", F.lit(seed), "segment_id", F.col("pos").cast("string")), 256)
    dealt = round_robin(facts.withColumn("stratum", stratum).withColumn("__order", order), "stratum", ["__order"], sample)
    out = out.union(item(dealt, "stratified_quality_sample", F.array("id"), F.col("stratum")))
    return out.select(review_id(F.col("category"), F.col("segment_id"), F.col("fact_ids")).alias("review_id"), "*").dropDuplicates(["review_id"])
