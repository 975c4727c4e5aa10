import copy
import hashlib
import json

from talkmill.operators import reference_audit as A

COMPACT = {"ensure_ascii": False, "separators": (",", ":")}
SEGMENTS = "dataset_name string, split string, sample_id string, session_id string, segment_id string, segment_order int, segmentation_method string, segmentation_version string, source_content_hash string, segment_turn_ids array<int>"
MANIFEST = {"run_complete": True, "unresolved_failure_count": 0, "segment_count": 3, "fact_count": 5, "config_hash": "c", "run_id": "r", "cost_complete": True}


def digest(value):
    return hashlib.sha256(json.dumps(value, **COMPACT).encode()).hexdigest()


def segment(name):
    return dict(zip(A.SEGMENT_FIELDS, ["d", "s", "p", "q", name, 1, "m", "v", "h", [1, 2, 3]], strict=True))


def fact(name, text, sources, rank):
    key = " ".join(text.lower().strip().rstrip(".!").split())
    return {"reference_fact_id": "rf_" + digest([name, key, sources])[:20], "fact_text": text, "text": text, "source_turn_ids": sources, "fact_type": "event", "state_status": "current", "origin": "o", "grounding_reason": "said", "selection_rank": rank}


def rehashed(row):
    facts = row["reference_facts"]
    row["reference_set_hash"] = digest([[f["reference_fact_id"], f["fact_text"], f["source_turn_ids"]] for f in facts])
    return row


def reference(name, texts):
    facts = [fact(name, t, [i + 1], i + 1) for i, t in enumerate(texts)]
    counts = dict.fromkeys(["raw_proposal_count", "grounded_accept_count", "frozen_fact_count"], len(facts))
    return rehashed({"schema_version": "1", **segment(name), "reference_facts": facts, **counts, "truncated_to_k": False, "run_id": "r", "prompt_version": "p", "config_hash": "c"})


def collection(start=""):
    texts = {"a": ["Ann  said \"hi\".", "Bob left!\n"], "b": ["Zoë 好。x", "A\\b"], "c": ["C"]}
    return [reference(start + name, t) for name, t in texts.items()]


def issues(spark, rows, manifest=MANIFEST, segments="abc", **more):
    refs = spark.createDataFrame([(i, json.dumps(r, **COMPACT)) for i, r in enumerate(rows)], "row long, value string")
    segs = spark.createDataFrame([segment(s) for s in segments], SEGMENTS)
    found = A.audit(spark, A.checked_rows(refs, segs), segs, manifest, **more).collect()
    return sorted((i.code, i.segment_id) if i.segment_id is not None else (i.code,) for i in found)


def in_fact(**changes):
    def change(rows):
        rows[0]["reference_facts"][0].update(changes)
        rehashed(rows[0])

    return change


def in_row(**changes):
    return lambda rows: rows[0].update(changes)


def repeat(same_id, same_source):
    def change(rows):
        one, two = rows[0]["reference_facts"]
        text, sources = (one["fact_text"], one["source_turn_ids"] if same_source else [3])
        two.update(fact(rows[0]["segment_id"], text + "!", sources, 2))
        if not same_id:
            two["reference_fact_id"] = "rf_x"
        rehashed(rows[0])

    return change


def swap(**more):
    return {**MANIFEST, **more}


BAD_ID = "reference_fact_id_hash_mismatch"
CASES = {
    "clean": (lambda rows: None, []),
    "row fields": (lambda rows: rows[0].pop("schema_version"), ["missing_row_fields"]),
    "no list": (in_row(reference_facts="no"), ["reference_facts_not_list"]),
    "frozen": (in_row(frozen_fact_count=1), ["frozen_fact_count_mismatch"]),
    "accepted": (in_row(grounded_accept_count=1), ["accepted_count_less_than_frozen"]),
    "proposed": (in_row(raw_proposal_count=1), ["proposal_count_less_than_accepted"]),
    "rank": (in_fact(selection_rank=7), ["noncontiguous_selection_rank"]),
    "set hash": (in_row(reference_set_hash="x"), ["reference_set_hash_mismatch"]),
    "metadata": (in_row(split="z", segment_turn_ids=[1]), ["segment_metadata_mismatch"] * 2),
    "null metadata": (in_row(session_id=None), ["segment_metadata_mismatch"]),
    "fact fields": (lambda rows: rows[0]["reference_facts"][0].pop("origin"), ["missing_fact_fields"]),
    "empty": (in_fact(reference_fact_id=""), ["empty_required_fact_value", BAD_ID]),
    "alias": (in_fact(text="other"), ["fact_text_alias_mismatch"]),
    "reason": (in_fact(grounding_reason=" \n"), ["empty_grounding_reason"]),
    "sources": (lambda rows: (rows[0]["reference_facts"].__setitem__(0, fact(rows[0]["segment_id"], "Ann", [9], 1)), rehashed(rows[0])), ["invalid_source_turn_ids"]),
    "type": (in_fact(fact_type="x"), ["invalid_fact_type"]),
    "state": (in_fact(state_status=None), ["invalid_state_status"]),
    "id": (in_fact(reference_fact_id="rf_1"), [BAD_ID]),
    "same": (repeat(True, True), ["duplicate_fact_id_within_segment", "duplicate_fact_id_globally", "exact_duplicate_same_source", "exact_duplicate_different_source"]),
    "same text": (repeat(False, False), [BAD_ID, "exact_duplicate_different_source"]),
}


def test_each_broken_rule_of_a_row_is_found_alone(spark):
    """Each case breaks a collection of its own, told by the first part of its segments' names; all are audited at once."""
    rows = []
    for name, (change, _) in CASES.items():
        mine = collection(f"{name}/")
        change(mine)
        rows += mine
    facts = sum(len(r["reference_facts"]) for r in rows if isinstance(r["reference_facts"], list))
    got = issues(spark, rows, swap(segment_count=len(rows), fact_count=facts), [f"{name}/{s}" for name in CASES for s in "abc"])
    found = {name: sorted(i[0] for i in got if i[1].startswith(f"{name}/")) for name in CASES}
    assert found == {name: sorted(codes) for name, (_, codes) in CASES.items()}


def test_rules_of_segments_and_collection(spark):
    rows = collection()
    twice = copy.deepcopy(rows[0])
    no_id, stray = copy.deepcopy(rows[0]), reference("z", ["Z"])
    no_id["segment_id"] = ""
    rows[1]["reference_facts"][1]["reference_fact_id"] = rows[0]["reference_facts"][0]["reference_fact_id"]
    rehashed(rows[1])
    rows[2].update(config_hash="d", run_id="s", prompt_version="q")
    got = issues(spark, [*rows, twice, no_id, stray], swap(run_complete=False, unresolved_failure_count=2, cost_complete=False), segments="abcn", archive=A.MISSING, ledger=A.MISSING)
    assert got == sorted([
        ("duplicate_reference_segment", "a"), ("missing_segment_id", ""), ("missing_source_segment", "z"), ("extra_reference_row", "z"), ("missing_reference_row", "n"),
        ("duplicate_fact_id_globally", "b"), (BAD_ID, "b"), ("manifest_run_incomplete",), ("manifest_has_unresolved_failures",), ("manifest_segment_count_mismatch",),
        ("mixed_or_manifest_mismatched_config_hash",), ("mixed_or_manifest_mismatched_run_id",), ("mixed_prompt_versions",), ("incomplete_cost_accounting",), ("raw_archive_missing",), ("ledger_missing",),
    ])


def test_archive_ledger_and_an_empty_collection(spark):
    archive = spark.createDataFrame([('{"segment_id":"a","stage":"x_json_repair"}',), ("{no",)], "value string")
    ledger = {"sets": spark.range(2), "failures": spark.range(1), "quick_check": ["bad page"]}
    got = issues(spark, collection(), archive=archive, ledger=ledger)
    assert got == [("invalid_raw_archive_json",), ("ledger_contains_failures",), ("ledger_quick_check_failed",), ("ledger_reference_set_count_mismatch",), ("segments_missing_raw_archive",)]
    none = issues(spark, [], swap(segment_count=0, fact_count=0), segments="")
    assert none == [("mixed_or_manifest_mismatched_config_hash",), ("mixed_or_manifest_mismatched_run_id",), ("mixed_prompt_versions",)]


def test_review_queue(spark):
    rows = collection()
    rows[2]["reference_facts"] = []
    refs = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "row long, value string")
    segs = spark.createDataFrame([segment(s) for s in "abc"], SEGMENTS)
    archive = spark.createDataFrame([('{"segment_id":"b","stage":"x_json_repair"}',), ('{"segment_id":"z","stage":"x_json_repair"}',)], "value string")
    ids = [[f["reference_fact_id"] for f in r["reference_facts"]] for r in rows]
    vectors = spark.createDataFrame([("a", i, [1.0, 0.0]) for i in ids[0]] + [("b", ids[1][0], [1.0, 0.0]), ("b", ids[1][1], [0.0, 1.0])], "segment_id string, id string, vector array<double>")
    queue = A.review_queue(A.checked_rows(refs, segs), archive, vectors, limit=2, sample=3).collect()
    expected = [("zero_reference_set", "c", []), ("fact_cap_reached", "a", ids[0]), ("fact_cap_reached", "b", ids[1]), ("json_repair_used", "b", []), ("near_duplicate_pair", "a", ids[0])]
    rest = [q for q in queue if q.category != "stratified_quality_sample"]
    assert sorted((q.category, q.segment_id, q.fact_ids) for q in rest) == sorted(expected)
    assert len(queue) - len(rest) == 3 and len({q.review_id for q in queue}) == len(queue)
    assert all(q.review_id == "review_" + digest([q.category, q.segment_id, q.fact_ids])[:16] for q in queue)
