"""A corpus pipeline: language, quality, near duplicates, benchmark passages, pieces. Each stage works on what is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.llm import decontaminate, language_id, near_copies, pieces, quality
from talkmill.llm.common import written
from talkmill.session import ship

#: A document whose best language holds a smaller share of its n-grams is in none of the languages.
MIN_LANGUAGE_SHARE = 0.5


def apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with doc_id, text and numbered names for its other columns, which so clash with none of an operator's; and the way back."""
    names = {c: c if c in ("doc_id", "text") else f"__{i}" for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or in no language of the corpus, go.

    Languages are learned from all rows with a text and a lang. Repeated rows share their fate; an empty table stays empty.
    """
    ship(spark)
    mine, back = apart(docs)
    judged = language_id.with_language(mine, language_id.fit(docs), lang="__lang", score="__share")
    return back(judged.where((F.col("__lang") != "und") & (F.col("__share") >= MIN_LANGUAGE_SHARE)))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling does not draw go, texts without a word or mark among them.

    Rows that repeat id and text share their fate, as do rows that tie with the last one drawn. Without usable labels all
    other documents stay; an empty table stays empty.
    """
    ship(spark)
    mine, back = apart(docs)
    return back(quality.resample(mine, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("selected"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts stays: the one with the smallest id (null last), of equal ids the first stored.

    Rows are told apart by their place and not by their id, so two unlike texts of one id both stay. Texts without words
    (null and empty ones too) are alike. An empty table stays empty.
    """
    ship(spark)
    mine, back = apart(docs)
    rows, labels = near_copies.labelled(mine, carry=("doc_id",))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    first = written(labels.groupBy("component").agg(best).select(F.col("best.row").alias("row")))
    return back(rows.join(first, "row", "left_semi"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; null and empty texts hold none. Repeated rows share their fate."""
    ship(spark)
    mine, back = apart(docs)
    return back(decontaminate.contamination(mine, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(~F.col("contaminated")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with token_ids, n_pieces, n_bytes and round_trip: piece ids, which decode to the text.

    A null text has null token_ids, an empty one none. Columns of docs with one of those names give way, as the result's are new.
    """
    ship(spark)
    new = ["token_ids", "n_pieces", "n_bytes", "round_trip"]
    mine, _ = apart(docs.drop(*new))
    encoded = pieces.with_pieces(mine)
    return encoded.select(*[F.col(n).alias(c) for n, c in zip(mine.columns, docs.drop(*new).columns, strict=True)], *new)


STAGES = [("language", language), ("quality", quality_classifier), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("pieces", encoding)]

#: SQL has no counterpart of the language, quality, near-duplicate and piece stages; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written, and read by the next."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
