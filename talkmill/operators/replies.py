"""Model replies read strictly: fact batches, judgments and corrected facts; and segment texts rendered with source ids.

Each reader is a function of one reply that returns rows or raises Fault, and an operator that runs it over a column in Arrow
batches and gives the rows beside the error's text, so that one bad reply stops nothing.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Words and formats that results depend on.
SEMANTIC = ["SUPPORTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED", "CONTRADICTED"]
COVERAGE = ["FULL", "PARTIAL", "NONE", "CONTRADICTED"]
TIME = ["PASS", "MISSING_REQUIRED_EXACT_TIME", "CONTRADICTED_TIME", "NOT_APPLICABLE"]
PLAIN_FACT = r"(?im)^\s*(?:\d+\.\s*)?\[([a-z_]+)/([a-z_]+)\]\s*([^\r\n]+)\r?\n来源\s*Turn\s*[:：]?\s*([0-9,，\s]+)\s*$"


def record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


FACT = record(segment_id=T.StringType(), source_ids=T.ArrayType(T.IntegerType()), fact=T.StringType(), model_segment_id=T.StringType())
CORRECTED = record(fact_text=T.StringType(), source_turn_ids=T.ArrayType(T.IntegerType()), fact_type=T.StringType(), state_status=T.StringType())


class Fault(ValueError):
    """Why a reply can't be used."""


def demand(good: object, why: str) -> None:
    if not good:
        raise Fault(why)


def loaded(text: str | None) -> object:
    try:
        return json.loads(text or "")
    except json.JSONDecodeError as e:
        raise Fault(f"the reply is not valid JSON: {e.msg}") from None


def fact_batch(reply: str | None, allowed: dict[str, list[int]], limit: int, forbidden: list[int] = (), adopt: bool = False) -> list[dict]:
    """The facts of a reply, in order: segment_id, source_ids (sorted), fact, model_segment_id (the reply's own).

    allowed: the source ids of each segment that was asked for, in the order asked. Facts that repeat in a segment become
    one with all sources. adopt: a reply for one segment may name it wrongly, if its sources all lie in it and it uses one name.
    """
    root = loaded(reply)
    demand(isinstance(root, dict) and root.keys() == {"processed_segment_ids", "data"}, "a reply must be an object of processed_segment_ids and data only")
    demand(root["processed_segment_ids"] == list(allowed), f"processed_segment_ids must be {list(allowed)}, not {root['processed_segment_ids']}")
    demand(isinstance(root["data"], list), "data must be an array")
    strangers, facts = set(), {}
    for at, item in enumerate(root["data"]):
        demand(isinstance(item, dict) and item.keys() in ({"segment_id", "source_ids", "fact"}, {"segment_id", "source_id", "fact"}), f"data[{at}] must hold segment_id, source_ids and fact only")
        told = item["segment_id"]
        segment = told if isinstance(told, str) and told in allowed else next(iter(allowed)) if adopt and isinstance(told, str) and len(allowed) == 1 else None
        demand(segment is not None, f"unknown segment_id in model output: {told!r}")
        sources = item["source_ids"] if "source_ids" in item else [item["source_id"]]
        demand(isinstance(sources, list) and sources, f"source_ids for {told} must be a non-empty array")
        for s in sources:
            demand(type(s) is int and s >= 0, f"invalid source_id for {told}: {s!r}")
            demand(s not in forbidden, f"source_id {s} is read-only context and cannot be cited")
            demand(s in allowed[segment], f"source_id {s} does not belong to segment {segment}")
        if told != segment:
            strangers.add(told)
            demand(len(strangers) < 2, f"several unknown segment_ids in one reply: {sorted(strangers)}")
        fact = item["fact"].strip() if isinstance(item["fact"], str) else ""
        demand(fact, f"empty fact for {segment}")
        known = facts.setdefault((segment, fact), {"segment_id": segment, "source_ids": [], "fact": fact, "model_segment_id": told})
        known["source_ids"] = sorted({*known["source_ids"], *sources})
    for segment, n in Counter(s for s, _ in facts).items():
        demand(n <= limit, f"{segment} exceeds max_facts_per_segment={limit}")
    return list(facts.values())


def same_ids(items: object, field: str, wanted: list[str], what: str) -> None:
    """Every wanted id once and no other, in any order."""
    demand(isinstance(items, list) and all(isinstance(x, dict) for x in items), f"{what} entries must be objects")
    got = Counter(str(x.get(field) or "") for x in items)
    lost, more, twice = sorted(set(wanted) - set(got)), sorted(set(got) - set(wanted)), sorted(i for i, n in got.items() if n > 1)
    demand(not lost and not more and not twice, f"{what} ids: missing {lost[:8]}, extra {more[:8]}, repeated {twice[:8]}")


def judgment(reply: str | None, segment: str, sets: dict[str, list[str]], gold: list[str]) -> list[dict]:
    """The results of a judge's reply, by set id. Ids that don't match raise at once; all faults of content are told together.

    sets: the candidate ids of each set that was judged; gold: the gold facts' ids. Without gold facts, what the reply says of any is dropped.
    """
    root = loaded(re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", reply or ""))
    demand(isinstance(root, dict) and root.get("segment_id") == segment, "segment_id mismatch")
    results, faults = root.get("candidate_set_results"), []
    same_ids(results, "set_id", list(sets), "set")

    def note(good: object, why: str) -> bool:
        if not good:
            faults.append(why)
        return bool(good)

    def texts(item: dict, names: tuple[str, ...], where: str) -> None:
        for n in names:
            note(isinstance(item.get(n), list) and all(isinstance(x, str) for x in item[n]), f"{where}: {n} must be a list of texts")

    for result in results:
        ident = str(result["set_id"])
        ids = [str(i) for i in sets[ident]]
        judged = result.get("candidate_assessments")
        same_ids(judged, "candidate_id", ids, f"{ident} candidate")
        status = {}
        for item in judged:
            where = f"{ident}/{item['candidate_id']}"
            status[str(item["candidate_id"])] = item.get("semantic_status")
            note(item.get("semantic_status") in SEMANTIC, f"{where}: invalid semantic_status")
            texts(item, ("supported_content", "unsupported_or_incorrect_content"), where)
        if not gold:
            result["gold_fact_assessments"] = []
        same_ids(result.get("gold_fact_assessments"), "gold_fact_id", gold, f"{ident} gold fact")
        for item in result["gold_fact_assessments"]:
            where, cover = f"{ident}/{item['gold_fact_id']}", item.get("covering_candidate_ids")
            note(item.get("coverage_status") in COVERAGE, f"{where}: invalid coverage_status")
            note(item.get("time_status") in TIME, f"{where}: invalid time_status")
            if note(isinstance(cover, list) and {str(c) for c in cover} <= set(ids), f"{where}: invalid covering_candidate_ids"):
                note(cover or item.get("coverage_status") not in COVERAGE[:2], f"{where}: a covered fact needs candidate ids")
                full = [str(c) for c in cover if status[str(c)] == "SUPPORTED"]
                note(not full or item.get("time_status") != "MISSING_REQUIRED_EXACT_TIME", f"{where}: candidates without the exact time can't be SUPPORTED: {full}")
            texts(item, ("covered_content", "missing_or_incorrect_content"), where)
    demand(not faults, f"{len(faults)} faults: " + "; ".join(faults))
    return sorted(results, key=lambda r: r["set_id"])


def corrected(text: str | None, types: list[str], states: list[str]) -> list[dict]:
    """A reviewer's facts: a JSON array, or `[type/state] fact` lines each with a line of source turns; nothing else may be left."""
    text = (text or "").strip()
    if text in ("", "[]"):
        return []
    try:
        items = json.loads(text)
    except json.JSONDecodeError:
        found = re.findall(PLAIN_FACT, text)
        demand(found and not re.sub(PLAIN_FACT, "", text).strip(), "corrected facts are neither JSON nor recognised text")
        items = [{"fact_type": a, "state_status": b, "fact_text": c, "source_turn_ids": re.findall("[0-9]+", d)} for a, b, c, d in found]
    demand(isinstance(items, list) and all(isinstance(x, dict) for x in items), "corrected facts must be an array of objects")
    out = []
    for item in items:
        fact = str(item.get("fact_text") or item.get("text") or "").strip()
        try:
            turns = sorted({int(x) for x in item.get("source_turn_ids") or []})
        except (TypeError, ValueError):
            raise Fault("source turns must be numbers") from None
        kind, state = (str(item.get(n) or "").strip().lower() for n in ("fact_type", "state_status"))
        demand(fact and turns, "a corrected fact lacks its text or source turns")
        demand(kind in types, f"invalid fact_type {kind!r}")
        demand(state in states, f"invalid state_status {state!r}")
        out.append({"fact_text": fact, "source_turn_ids": turns, "fact_type": kind, "state_status": state})
    return out


def annotated(text: str, turns: list[int]) -> str:
    """A segment's text with `<SOURCE_TURN_ID=n>` lines. Headers `[time] n-1.speaker:` are looked for in the order of the turns,
    so numbered lines inside a turn are no headers. A turn without its header, or text before the first, raises."""
    demand(turns, "a segment without turns")
    heads, at = [], 0
    for turn in turns:
        m = re.compile(rf"^\[([^\]\r\n]+)\]\s+{turn - 1}\.([^:\r\n]+):\s*", re.M).search(text, at)
        demand(m, f"source turn {turn} has no header in the text")
        heads.append(m)
        at = m.end()
    demand(heads[0].start() == 0, "text before the first turn")
    ends = [m.start() for m in heads[1:]] + [len(text)]
    return "\n".join(f"<SOURCE_TURN_ID={n}> [{m[1]}] {m[2].strip()}: " + text[m.end() : end].rstrip("\r\n") for n, m, end in zip(turns, heads, ends, strict=True))


def read_each(rows: DataFrame, name: str, kind: T.DataType, read: Callable[[dict], object], columns: list[str]) -> DataFrame:
    """rows with what read makes of their columns as `name` (null if it raised), and `error` (null if not). Columns of those names give way."""
    kept = rows.select(*[c for c in rows.columns if c not in (name, "error") or c in columns])
    out_names = [c for c in kept.columns if c not in (name, "error")]
    schema = T.StructType([kept.schema[c] for c in out_names] + [T.StructField(name, kind), T.StructField("error", T.StringType())])

    def run(batches):
        for pdf in batches:
            values, errors = [], []
            for record in pdf[columns].to_dict("records"):
                try:
                    values.append(read(record))
                    errors.append(None)
                except Fault as e:
                    values.append(None)
                    errors.append(str(e))
            yield pdf[out_names].assign(**{name: pd.Series(values, index=pdf.index, dtype=object), "error": pd.Series(errors, index=pdf.index, dtype=object)})

    return kept.mapInPandas(run, schema)


def fact_batches(replies: DataFrame, limit: int, adopt: bool = False) -> DataFrame:
    """replies (batch_id, content, segments: array of (segment_id, ids), forbidden: array) with facts and error."""
    ids = lambda s: {x["segment_id"]: [int(i) for i in x["ids"]] for x in s}
    none = lambda x: [] if x is None else [int(i) for i in x]
    return read_each(replies, "facts", T.ArrayType(FACT), lambda r: fact_batch(r["content"], ids(r["segments"]), limit, none(r["forbidden"]), adopt), ["content", "segments", "forbidden"])


def judgments(replies: DataFrame) -> DataFrame:
    """replies (segment_id, content, sets: array of (set_id, candidate_ids), gold: array of ids) with results (JSON) and error."""

    def read(r: dict) -> str:
        sets = {x["set_id"]: list(x["candidate_ids"]) for x in r["sets"]}
        return json.dumps(judgment(r["content"], r["segment_id"], sets, [str(g) for g in (r["gold"] if r["gold"] is not None else ())]), ensure_ascii=False)

    return read_each(replies, "results", T.StringType(), read, ["content", "segment_id", "sets", "gold"])


def corrections(reviews: DataFrame, types: list[str], states: list[str], text: str = "corrected") -> DataFrame:
    """reviews with the facts of their corrected text, and error."""
    return read_each(reviews, "facts", T.ArrayType(CORRECTED), lambda r: corrected(r[text], types, states), [text])


def with_sources(segments: DataFrame) -> DataFrame:
    """segments (text, turn_ids) with the text annotated by source ids, and error."""
    return read_each(segments, "annotated", T.StringType(), lambda r: annotated(r["text"] or "", [int(t) for t in (r["turn_ids"] if r["turn_ids"] is not None else ())]), ["text", "turn_ids"])
