"""Text functions as column expressions: they stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
TOKEN = r"[A-Za-z0-9_./+-]+|[\x{4e00}-\x{9fff}]"
ENTITY = r"\b[A-Z][A-Za-z0-9_.-]{1,}\b"
SENTENCE_END = r"[。！？!?;\n]+"
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "for", "from", "i", "in", "is", "it", "of", "on", "or", "our", "the", "to", "we", "with", "了", "个", "们", "在", "是", "有", "和", "就", "也", "都", "我", "把", "的"]
CLAUSE_END = r"[。！？!?;；,，:：.\n]+"
VERBS = ["build", "define", "design", "extract", "implement", "plan", "run", "study", "use", "做", "写", "实现", "开发", "构建", "测试", "研究", "设计"]
PREDICATES = VERBS + ["add", "analyze", "call", "change", "choose", "compare", "compute", "control", "create", "decide", "detect", "evaluate", "filter", "generate", "include", "measure", "need", "output", "record", "route", "save", "score", "select", "store", "update", "want"]
ALIASES = {"ai": "artificial_intelligence", "avg": "average", "bert": "language_model", "chatgpt": "language_model", "costs": "cost", "gpt": "language_model", "llm": "language_model", "llms": "language_model", "model": "language_model", "models": "language_model", "qa": "question_answering", "score": "scoring", "scores": "scoring", "thresholds": "threshold"}
IRREGULAR = {"built": "build", "ran": "run", "running": "run", "stored": "store", "using": "use", "used": "use"}
#: (a word longer than this, with this ending, loses so many letters, and gains these); the first that fits.
ENDINGS = [(5, "ies$", 3, "y"), (5, "ing$", 3, ""), (4, "ied$", 3, "y"), (4, "ed$", 2, ""), (4, "(ches|shes|sses|xes|zes)$", 2, ""), (3, "[^sui]s$", 1, "")]
PREFERENCE_MARKS = ["喜欢", "希望"]
CONSTRAINT_MARKS = ["必须", "不要", "不得", "only", "must", "should not"]


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def tokens(text: Column) -> Column:
    """Lower-cased tokens: runs of ASCII word characters, or one CJK character. None for null."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def count_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def stripped(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), stripped), lambda s: s != "")


def match_key(text: Column) -> Column:
    """What two texts that say the same have in common: letters, digits and underscores in lower case, one blank for all between."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}_]+", " "))


def content_tokens(text: Column) -> Column:
    """Tokens that aren't stopwords, repeats included."""
    return F.filter(tokens(text), lambda t: ~t.isin(STOPWORDS))


def counts(words: Column) -> Column:
    """(n, word) of each distinct word: one sort, then runs."""
    return F.transform(F.array_distinct(words), lambda w: F.struct(F.size(F.filter(words, lambda x: x == w)).alias("n"), w.alias("word")))


def normalized_entropy(words: Column) -> Column:
    """Shannon's entropy over its maximum; 0 for one distinct word or fewer. Distinct words are few beside all in practice."""
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    total = F.aggregate(counts(words), F.lit(0.0), lambda a, c: a - c["n"] / n * F.log2(c["n"] / n))
    return F.when((n <= 1) | (kinds <= 1), 0.0).otherwise(clamp01(total / F.log2(kinds.cast("double"))))


def topic(text: Column) -> Column:
    """The commonest content token; ties: longer, then first in order; `general` without any."""
    best = F.aggregate(
        counts(content_tokens(text)), F.struct(F.lit(0).alias("n"), F.lit("general").alias("word")),
        lambda a, c: F.when((c["n"] > a["n"]) | ((c["n"] == a["n"]) & ((F.length(c["word"]) > F.length(a["word"])) | ((F.length(c["word"]) == F.length(a["word"])) & (c["word"] < a["word"])))), c).otherwise(a),
    )
    return best["word"]


def summary(text: Column, limit: int = 96) -> Column:
    """White space squeezed; beyond limit characters the first limit - 1, trimmed, and an ellipsis."""
    compact = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(compact) <= limit, compact).otherwise(F.concat(F.rtrim(F.substring(compact, 1, limit - 1)), F.lit("…")))


def entities(text: Column) -> Column:
    """Capitalised words, once each whatever their case, first seen first; then tokens with a digit, of two characters or more."""
    names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITY), F.lit(0))
    first = F.filter(names, lambda x, i: F.array_position(F.transform(names, F.lower), F.lower(x)) == i + 1)
    numbers = F.filter(F.array_distinct(tokens(text)), lambda t: t.rlike("[0-9]") & (F.length(t) > 1) & ~F.array_contains(F.transform(names, F.lower), t))
    return F.concat(first, numbers)


def constraints(text: Column) -> Column:
    """Sentences that hold a mark of obligation, summarised."""
    held = F.filter(sentences(text), lambda s: F.greatest(*[s.contains(m) for m in CONSTRAINT_MARKS]))
    return F.transform(held, lambda s: summary(s, 72))


def fact_key(text: Column) -> Column:
    """A fact's text for comparison: lower case, without white space at its ends and closing marks, white space squeezed."""
    bare = F.regexp_replace(stripped(F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))), r"[。.!！?]+$", "")
    return F.trim(F.regexp_replace(bare, r"(?U)[\s\x1c-\x1f]+", " "))


def structure(text: Column) -> dict[str, Column]:
    """Counts that a router looks at: characters, lines, digits, distinct lower-case words."""
    return {"n_chars": F.length(text), "n_lines": F.regexp_count(text, F.lit("\n")) + 1, "n_digits": F.regexp_count(text, F.lit("[0-9]")), "n_words": F.size(F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")))}


def preferences(text: Column) -> Column:
    """Sentences that tell a liking, summarised."""
    held = F.filter(sentences(text), lambda s: F.greatest(F.lower(s).contains("prefer"), *[s.contains(m) for m in PREFERENCE_MARKS]))
    return F.transform(held, lambda s: summary(s, 48))


def event_clauses(text: Column) -> Column:
    """Sentences that hold a verb of doing, summarised; without any, the whole text, if it isn't blank."""
    held = F.transform(F.filter(sentences(text), lambda s: F.greatest(*[F.lower(s).contains(v) for v in VERBS])), lambda s: summary(s, 88))
    whole = F.coalesce(text, F.lit(""))
    return F.when((F.size(held) > 0) | (F.trim(whole) == ""), held).otherwise(F.array(summary(whole, 88)))


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def is_content(token: Column) -> Column:
    """Not a stopword, not one Latin letter, and with a letter, digit or CJK character."""
    return ~token.isin(STOPWORDS) & ~token.rlike("^[a-z]$") & token.rlike(r"[a-z0-9_\x{4e00}-\x{9fff}]")


def stem(word: Column) -> Column:
    """A stripped lower-case word without its ending."""
    out = F.when(F.try_element_at(literal_map(IRREGULAR), word).isNotNull(), F.try_element_at(literal_map(IRREGULAR), word)).when(~word.rlike("^[a-z][a-z0-9_./+-]*$"), word)
    for longer, ending, lost, gained in ENDINGS:
        left = F.concat(F.left(word, F.length(word) - lost), F.lit(gained))
        if ending == "ing$":
            left = F.when(F.length(left) > 2, F.regexp_replace(left, r"(.)\1$", "$1")).otherwise(left)
        out = out.when((F.length(word) > longer) & word.rlike(ending), left)
    return out.otherwise(word)


def concepts(words: Column) -> Column:
    """Each token's concept: marks stripped, ending off, synonyms folded. Steps are arrays, so none is worked out twice."""
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[._+/-]+|[._+/-]+$", ""))
    return F.transform(F.transform(bare, stem), lambda w: F.coalesce(F.try_element_at(literal_map(ALIASES), w), w))


def content_terms(text: Column) -> Column:
    """Concepts of the content tokens, repeats included."""
    return F.filter(concepts(F.filter(tokens(text), is_content)), lambda w: (w != "") & ~w.isin(STOPWORDS))


def clause_units(terms: Column) -> Column:
    """A clause's units: subject::predicate::object of each predicate (three terms after it); else pairs of neighbours; else that one exists."""
    name = lambda *x: F.concat_ws("::", *x)
    implicit = F.lit("implicit")
    at = F.filter(F.transform(terms, lambda w, i: F.when(w.isin(PREDICATES) | w.rlike("i[sz]e$"), i)), lambda i: i.isNotNull())

    def around(i):
        after = F.slice(terms, i + 2, F.lit(3))
        objects = F.when(F.size(after) > 0, after).otherwise(F.array(implicit))
        return F.transform(F.filter(objects, lambda o: o != F.get(terms, i)), lambda o: name(F.when(i > 0, F.get(terms, i - 1)).otherwise(implicit), F.get(terms, i), o))

    pairs = F.filter(F.transform(terms, lambda w, i: F.when(F.get(terms, i + 1) != w, name(w, F.lit("rel"), F.get(terms, i + 1)))), lambda u: u.isNotNull())
    return F.when(F.size(at) > 0, F.flatten(F.transform(at, around))).when(F.size(terms) == 1, F.array(name(F.get(terms, F.lit(0)), F.lit("exists")))).otherwise(pairs)


def idea_units(text: Column) -> Column:
    """Distinct units of all clauses, sorted."""
    clauses = F.transform(F.split(F.coalesce(text, F.lit("")), CLAUSE_END), content_terms)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(clauses, clause_units))))
