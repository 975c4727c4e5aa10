"""Record functions as column expressions: rendered lines, prompts, ids, labels and acceptance of facts."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and words that results depend on.
SOURCE_LINE = r"^\[([^,\]]+)(?:,\s*([^\]]+))?\]\s+(\d+)\.([^:]+):"
TERMINAL_ERRORS = ["unknown segment_id", "does not belong to segment", "exceeds max_facts_per_segment", "empty fact"]
YES, NO = ["yes", "correct"], ["no", "wrong", "incorrect"]


def source_lines(text: Column) -> Column:
    """(ts, weekday, source_id, speaker) of each line that is a rendered turn; none for null."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.trim), lambda x: x.rlike(SOURCE_LINE))
    part = lambda x, i: F.regexp_extract(x, SOURCE_LINE, i)
    return F.transform(lines, lambda x: F.struct(part(x, 1).alias("ts"), part(x, 2).alias("weekday"), part(x, 3).cast("int").alias("source_id"), part(x, 4).alias("speaker")))


def visible_ids(text: Column) -> Column:
    """Source ids that a text shows, once each, in order."""
    return F.array_distinct(F.transform(source_lines(text), lambda x: x["source_id"]))


def batch_prompt(segments: Column) -> Column:
    """Topics of a batch, in order. segments: array of (segment_id, text)."""
    return F.array_join(F.transform(segments, lambda s: F.concat(F.lit("--- Topic "), s["segment_id"], F.lit(" ---\n"), s["text"])), "\n\n")


def constrained_prompt(segments: Column) -> Column:
    """Topics with the source ids that each may cite, after the ids that have to come back. segments: array of (segment_id, text, ids)."""
    ids = F.array_join(F.transform(segments, lambda s: F.concat(F.lit('"'), s["segment_id"], F.lit('"'))), ", ")
    topic = lambda s: F.concat(F.lit("--- Topic "), s["segment_id"], F.lit(" ---\nAllowed source_ids for this topic only: ["), F.array_join(s["ids"].cast("array<string>"), ", "), F.lit("]\n"), s["text"])
    return F.concat(F.lit("Required processed_segment_ids in exact output order: ["), ids, F.lit("]\n\n"), F.array_join(F.transform(segments, topic), "\n\n"))


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with each {name} replaced literally; other braces stay. A name that it lacks is an error."""
    lacking = [n for n in values if f"{{{n}}}" not in template]
    if lacking:
        raise ValueError(f"the template lacks {lacking}")
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    return out


def slug(name: Column) -> Column:
    """A name for stores: lower case, other characters than a-z, 0-9, _ and - as one -, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_-]+", "-"), "^[-_]+|[-_]+$", "")


def fact_id(segment: Column, key: Column, sources: Column) -> Column:
    """A fact's stable id: a digest of its segment, normalised text and sources as compact JSON."""
    head = F.to_json(F.array(segment.cast("string"), key))
    payload = F.concat(F.left(head, F.length(head) - 1), F.lit(","), F.coalesce(F.to_json(sources), F.lit("[]")), F.lit("]"))
    return F.concat(F.lit("rf_"), F.left(F.sha2(payload, 256), F.lit(20)))


def coerced(value: Column, allowed: list[str], other: str) -> Column:
    """A value in lower case if it is allowed, and other if not or null."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(other))))
    return F.when(v.isin(allowed), v).otherwise(other)


def accepted(decision: Column, entailed: Column, atomic: Column, sufficient: Column, external: Column, duplicate_of: Column) -> Column:
    """Whether a fact is grounded: all six hold. A missing answer is a rejection."""
    return F.coalesce((decision == "ACCEPT") & entailed & atomic & sufficient & ~external & (F.coalesce(duplicate_of, F.lit("")) == ""), F.lit(False))


def repairable(error: Column) -> Column:
    """Whether an error is of form, which a repair can mend, and not of content."""
    return ~F.coalesce(F.greatest(*[error.contains(m) for m in TERMINAL_ERRORS]), F.lit(False))


def json_label(answer: Column) -> Column:
    """The label of a JSON answer: CORRECT is true, WRONG is false; else null."""
    label = F.upper(F.trim(F.get_json_object(answer, "$.label")))
    return F.when(label == "CORRECT", True).when(label == "WRONG", False)


def yes_no(answer: Column) -> Column:
    """The first line's letters as yes or no; else null."""
    word = F.regexp_replace(F.lower(F.split_part(F.trim(answer), F.lit("\n"), F.lit(1))), "[^a-z]", "")
    return F.when(word.isin(YES), True).when(word.isin(NO), False)


def memory_line(ts: Column, weekday: Column, fact: Column) -> Column:
    """`[ts, weekday] fact`; without a weekday `[ts] fact`; without a time the fact."""
    t, d = F.trim(F.coalesce(ts, F.lit(""))), F.trim(F.coalesce(weekday, F.lit("")))
    head = F.when((t != "") & (d != ""), F.concat(F.lit("["), t, F.lit(", "), d, F.lit("]"))).when(t != "", F.concat(F.lit("["), t, F.lit("]"))).otherwise("")
    return F.trim(F.concat(head, F.lit(" "), F.trim(F.coalesce(fact, F.lit("")))))


def mentions(text: Column, name: Column) -> Column:
    """Whether a text holds a name as a word of its own, in any case; no for an empty or null name or text."""
    quoted = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace(name, F.lit(r"\E"), F.lit("")), F.lit(r"\E(?!\w)"))
    return F.coalesce((name != "") & F.regexp_like(text, quoted), F.lit(False))


def speaker_side(source: Column, fact: Column, first: Column, second: Column) -> Column:
    """1 or 2: whose memory a fact is, by its source, else by whom alone it mentions, else the first's."""
    who = F.lower(F.coalesce(source, F.lit("")))
    return F.when(who == F.lower(second), 2).when(who == F.lower(first), 1).when(mentions(fact, second) & ~mentions(fact, first), 2).otherwise(1)


def alpha_token(alpha: str | float) -> str:
    """A threshold's factor as a name: plain digits without trailing zeros, `p` for the point. Negative and infinite ones raise."""
    value = Decimal(str(alpha))
    if not value.is_finite() or value < 0:
        raise ValueError(f"alpha must be finite and not negative: {alpha!r}")
    return f"{abs(value).normalize():f}".replace(".", "p")


def alpha_column(alpha: Column) -> Column:
    """alpha_token of a decimal or text column; null for text that is no number, and for negative ones."""
    value = alpha.cast("string").try_cast("decimal(38,18)")
    plain = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(value >= 0, F.replace(plain, F.lit("."), F.lit("p")))


def artifact_name(method: str, alpha: str | float) -> str:
    """A segmentation's name: its method and its alpha."""
    name = method.strip().lower()
    if not re.fullmatch("[a-z0-9][a-z0-9_-]*", name):
        raise ValueError(f"not a method's name: {method!r}")
    return f"{name}_alpha_{alpha_token(alpha)}"
