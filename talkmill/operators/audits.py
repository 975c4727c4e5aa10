"""Audits of facts, archives, ledgers and splits; manual reviews applied; vectors pooled and joined to features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talkmill.operators.joins import exact, must

#: What a review may decide.
DECISIONS = ["NO_CHANGE", "REVISE", "MERGE", "DUPLICATE", "REJECT", "MISSING_FACTS", "REPLACE_LOW_VALUE"]
SECRET = r"(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{12,}"


def metadata_problems(rows: DataFrame, segments: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key, problem): rows whose segment is unknown, segments without a row, and columns in which the two differ."""
    both = rows.select(*key, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("__a")).join(segments.select(*key, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("__b")), key, "full_outer")
    there = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    found = [F.when(F.col("__b").isNull(), "unknown_segment"), F.when(F.col("__a").isNull(), "missing_segment"), *[F.when(there & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), f"{c}_differs") for c in columns]]
    return both.select(*key, F.explode(F.array_compact(F.array(*found))).alias("problem"))


def archive_counts(archive: DataFrame, expected: DataFrame, key: str, stage: str) -> DataFrame:
    """(key, n_stages, n_attempts, repaired): what is archived of each expected key; a key without archive has zeros."""
    got = archive.groupBy(key).agg(F.count_distinct(stage).alias("n_stages"), F.count("*").alias("n_attempts"))
    both = expected.select(key).distinct().join(got, key, "left").fillna(0, ["n_stages", "n_attempts"])
    return both.withColumn("repaired", F.col("n_attempts") > F.col("n_stages"))


def ledger_audit(ledger: DataFrame, failed: Column, by: list[str]) -> DataFrame:
    """Rows, failures and the rate of failures."""
    n, bad = F.count("*"), F.count_if(failed)
    return ledger.groupBy(*by).agg(n.alias("n_rows"), bad.alias("n_failed"), (bad / n).alias("failure_rate"))


def secrets(texts: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, n): texts that give a key, token or password a value, and how often."""
    return texts.select(ident, F.regexp_count(text, F.lit(SECRET)).alias("n")).where("n > 0")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def split_problems(members: DataFrame, population: DataFrame, item: str, part: str, protocol: str | None = None) -> DataFrame:
    """(item, problem): items in two parts (of one fold), in none, or not of the population. One aggregation and one join."""
    fold = [protocol] if protocol else []
    held = members.groupBy(item, *fold).agg(F.count_distinct(part).alias("n")).groupBy(item).agg(F.max("n").alias("n"))
    both = population.select(item, F.lit(True).alias("__p")).distinct().join(held, item, "full_outer")
    return both.select(item, F.when(F.col("n").isNull(), "uncovered").when(F.col("__p").isNull(), "unknown").when(F.col("n") > 1, "overlap").alias("problem")).where("problem is not null")


def apply_review(facts: DataFrame, decisions: DataFrame, limit: int = 15) -> DataFrame:
    """The facts of reviewed segments: segment_id, text, sources, rank (from 1).

    facts: segment_id, fact_id, text, sources (array), rank. decisions: segment_id, decision, fact_ids (array), text, sources.
    REJECT drops its facts, REVISE replaces a fact's text, and its sources if given; MERGE and DUPLICATE make one fact of at
    least two: the longest text, all sources, the first rank; MISSING_FACTS adds one at the end; REPLACE_LOW_VALUE gives the
    segment's whole new set. Raises: another decision, a merge of fewer than two, two equal texts with equal sources after it
    all, and a segment with more than limit facts.
    """
    many = F.col("decision").isin("MERGE", "DUPLICATE")
    good = F.col("decision").isin(DECISIONS) & (~many | (F.size(F.coalesce("fact_ids", F.array().cast("array<string>"))) >= 2))
    d = must(decisions, good, "review decision", ["segment_id", "decision"])
    columns = ["segment_id", "text", "sources", "rank"]
    named = d.where(F.col("decision").isin("REVISE", "MERGE", "DUPLICATE", "REJECT")).select("segment_id", "decision", "fact_ids", F.col("text").alias("new_text"), F.col("sources").alias("new_sources"), F.explode("fact_ids").alias("fact_id"))
    new_set = d.where("decision = 'REPLACE_LOW_VALUE'")
    replaced = new_set.select("segment_id").distinct()
    old = facts.join(replaced, "segment_id", "left_anti")
    kept = old.join(named.select("segment_id", "fact_id"), ["segment_id", "fact_id"], "left_anti").select(*columns)
    touched = old.join(named, ["segment_id", "fact_id"])
    revised = touched.where("decision = 'REVISE'").select("segment_id", F.coalesce("new_text", "text").alias("text"), F.coalesce("new_sources", "sources").alias("sources"), "rank")
    merged = touched.where(many).groupBy("segment_id", "fact_ids").agg(F.max_by("text", F.struct(F.length("text"), -F.col("rank"))).alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.min("rank").alias("rank")).select(*columns)
    added = d.where("decision = 'MISSING_FACTS'").join(replaced, "segment_id", "left_anti").unionByName(new_set).select("segment_id", "text", "sources", F.lit(1 << 30).alias("rank"))
    out = kept.unionByName(revised).unionByName(merged).unionByName(added)
    w = W.partitionBy("segment_id")
    ranked = out.withColumn("rank", F.row_number().over(w.orderBy("rank", "text", "sources")))
    same = F.count(F.lit(1)).over(W.partitionBy("segment_id", "text", "sources"))
    checked = must(ranked.withColumn("__same", same), (F.col("__same") == 1) & (F.col("rank") <= limit), "review leaves equal or too many facts", ["segment_id"])
    return checked.select(*columns)


def carried_forward(reviews: DataFrame, audit: DataFrame, key: str) -> DataFrame:
    """audit with `reviewed`: whether a queued item has a decision. A decision on an item that isn't queued raises."""
    both = audit.withColumn("__q", F.lit(True)).join(reviews.select(key, "decision"), key, "full_outer")
    return must(both, F.col("__q").isNotNull(), "decision on an unknown item", [key]).withColumn("reviewed", F.col("decision").isNotNull()).drop("__q")


def chunks(tokens: Column, size: int, step: int) -> Column:
    """Overlapping runs of at most size tokens, a new one every step; one for an empty list."""
    if not 0 < step <= size:
        raise ValueError("a step has to be positive and not above the size")
    last = F.greatest(F.ceil((F.size(tokens) - size) / F.lit(step)).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i * step + 1, F.lit(size)))


def pooled(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): the mean of a key's vectors, made one long; a zero mean stays zero. Dimensions are summed before the shuffle."""
    mean = vectors.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return whole.withColumn("n", norm).select(key, F.when(F.col("n") > 0, F.transform("v", lambda x: x / F.col("n"))).otherwise(F.col("v")).alias(vector))


def features(vector: Column, structure: list[Column], profile: list[Column]) -> Column:
    """A router's input: the embedding, the structure counts and the model's profile, as one array of doubles."""
    tail = F.array(*[c.cast("double") for c in [*structure, *profile]])
    return F.concat(F.transform(vector, lambda x: x.cast("double")), tail)


def reembedded(points: DataFrame, encode, key: str, schema: str) -> DataFrame:
    """points through an encoder (an iterator of pandas frames to the same with a vector); a point that it loses or invents raises."""
    made = points.mapInPandas(encode, schema)
    return exact(made, points.select(key), [key], "embedded point")
