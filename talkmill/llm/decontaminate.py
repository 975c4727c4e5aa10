"""Benchmark decontamination with a distributed positional inverted index of the training text, in DataFrame operations only.

The index holds a posting (term, key, position) of each use of a test term in the training texts. It is written in segments, one
for each task's documents and sorted by term within, so that no term's list, however long, has to pass through one task. A pattern
is a sequence of terms. Its lists are moved by each term's offset and intersected: first those of the two rarest terms, which
leaves few places, then those of all other terms at these places. What is left is exactly the places of the phrase. Proximity
queries start from the rarest term's list too, and meet the others' by blocks of positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import written

#: What is between words: ASCII but digits and letters, after A-Z have become a-z; and a word, before.
BETWEEN, WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A side is broadcast below so many rows. Above, it is joined by a shuffle, with SALTS copies of each of its rows.
BROADCAST_ROWS, SALTS = 200_000, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def looked_up(rows: DataFrame, table: DataFrame, on: str, salt: list[str]) -> DataFrame:
    """rows joined with a table that is small beside them, counted first: broadcast, or by a shuffle in which the rows of a value
    go to SALTS tasks by the columns salt, so that a value which many rows hold fills no task."""
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), on)
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*salt), SALTS).cast("int")).join(copies, [on, "__salt"]).drop("__salt")


def vocabulary(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, term): a number for each distinct word of texts, written."""
    return written(texts.select(F.explode(words(F.col(text))).alias("word")).distinct().withColumn("term", F.monotonically_increasing_id()))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, key, pos), written: the postings of the vocabulary's terms in docs (key, text), in segments sorted by term, key and pos."""
    uses = docs.select("key", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return written(looked_up(uses, terms, "word", ["key", "pos"]).select("term", "key", "pos").sortWithinPartitions("term", "key", "pos"))


def windows(items: DataFrame, size: int, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, offset, term) of each distinct window of size words, or all words of a shorter item; and (pattern, item_id). Written."""
    tokens = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    each = tokens.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))), lambda i: F.slice(F.col("w"), i, size))).alias("words"))
    distinct = written(each.select("words").distinct().withColumn("pattern", F.monotonically_increasing_id()))
    owners = written(each.join(distinct, "words").select("pattern", "item_id").distinct())
    patterns = distinct.select("pattern", F.posexplode("words").alias("offset", "word")).join(terms, "word").select("pattern", "offset", "term")
    return written(patterns), owners


def by_rarity(index: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, size, t), written: each pattern's (n, term, offset), rarest term first; patterns with a term of no use are left out."""
    frequency = index.groupBy("term").agg(F.count("*").alias("n"))
    rated = patterns.join(frequency, "term", "left").select("pattern", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset").alias("t"))
    return written(rated.groupBy("pattern").agg(F.sort_array(F.collect_list("t")).alias("t")).where("t[0].n > 0").select("pattern", F.size("t").alias("size"), "t"))


def phrases(index: DataFrame, patterns: DataFrame, first: int = 2) -> DataFrame:
    """(key, pattern, start, size), written: every exact occurrence of each pattern (pattern, offset, term; offsets from 0 on).

    first: lists that are intersected for all their postings; the others' are looked at where these meet.
    """
    rated = by_rarity(index, patterns)
    rare = rated.select("pattern", "size", F.least(F.size("t"), F.lit(first)).alias("lists"), F.inline(F.slice("t", 1, first)))
    moved = looked_up(index, written(rare.drop("n")), "term", ["key", "pos"]).select("key", "pattern", "size", "lists", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    # A pattern's terms have different offsets, so each list gives a place once.
    places = written(moved.groupBy("key", "pattern", "start", "size", "lists").agg(F.count("*").alias("met")).where("met = lists").select("key", "pattern", "start", "size"))
    rest = written(rated.where(F.col("size") > first).select("pattern", F.inline(F.slice("t", first + 1, 1 << 30))).drop("n"))
    asked = looked_up(places.where(F.col("size") > first), rest, "pattern", ["key", "start"]).select("key", "pattern", "start", "size", (F.col("start") + F.col("offset")).alias("pos"), "term")
    keys = written(places.where(F.col("size") > first).select("key").distinct())
    met = asked.join(looked_up(index, keys, "key", ["pos"]), ["key", "pos", "term"]).groupBy("key", "pattern", "start", "size").agg(F.count("*").alias("met"))
    return written(met.where(F.col("met") == F.col("size") - first).drop("met").unionByName(places.where(F.col("size") <= first)))


def proximity(index: DataFrame, patterns: DataFrame, distance: int) -> DataFrame:
    """(key, pattern, at, start, end): every use `at` of a pattern's rarest term that has all its other terms, in any order, at most
    distance words away; start and end span the nearest ones. patterns: pattern, term; a term counts once.

    Lists meet in blocks of distance positions, so a posting meets three blocks of each other list, whatever its length.
    """
    rated = by_rarity(index, patterns.select("pattern", "term", F.lit(0).alias("offset")).distinct())
    n_terms = rated.select("pattern", "size")
    anchors = looked_up(index, written(rated.select("pattern", F.col("t")[0]["term"].alias("term"))), "term", ["key", "pos"]).select("key", "pattern", F.col("pos").alias("at"))
    others = looked_up(index, written(rated.select("pattern", F.inline(F.slice("t", 2, 1 << 30))).select("pattern", "term")), "term", ["key", "pos"])
    others = others.select("key", "pattern", "term", "pos", F.floor(F.col("pos") / distance).alias("block"))
    spread = anchors.withColumn("block", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: d + F.floor(F.col("at") / distance))))
    near = spread.join(others, ["key", "pattern", "block"]).where(F.abs(F.col("pos") - F.col("at")) <= distance)
    nearest = near.groupBy("key", "pattern", "at", "term").agg(F.min(F.struct(F.abs(F.col("pos") - F.col("at")).alias("d"), "pos"))["pos"].alias("pos"))
    spans = nearest.groupBy("key", "pattern", "at").agg(F.count("*").alias("met"), F.min("pos").alias("low"), F.max("pos").alias("high")).join(n_terms, "pattern").where("met = size - 1")
    alone = looked_up(anchors, written(n_terms.where("size = 1").select("pattern")), "pattern", ["key", "at"])
    return spans.select("key", "pattern", "at", F.least("low", "at").alias("start"), F.greatest("high", "at").alias("end")).unionByName(alone.select("key", "pattern", "at", F.col("at").alias("start"), F.col("at").alias("end")))


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """docs and n_words, n_hit, n_items, items_sha256, contaminated; columns of docs with those names give way.

    A window is size consecutive words of an item, or all words of a shorter one; items without words have none. n_hit
    counts document words inside an occurrence of any window, once each. Null and empty texts have no words and no hits.
    Repeated rows get the same answer each. Without items nothing is hit. items_sha256 of no item is that of the empty text.
    Rows are told apart by a number that is written with them, so no hash of an id or a text stands for one.
    """
    new = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    docs = docs.select(*[c for c in docs.columns if c not in new])
    rows = written(docs.select("*", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), F.monotonically_increasing_id().alias("__key")))
    terms = vocabulary(items)
    patterns, owners = windows(items, size, terms)
    found = phrases(build_index(rows.select(F.col("__key").alias("key"), "text"), terms), patterns)
    hit = found.select("key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    owned = looked_up(found.select("key", "pattern").distinct(), owners, "pattern", ["key"]).select("key", "item_id").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    facts = written(hit.join(owned, "key").select(F.col("key").alias("__key"), "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")))
    facts = F.broadcast(facts) if facts.count() <= BROADCAST_ROWS else facts
    return rows.join(facts, "__key", "left").select(
        *docs.columns, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
