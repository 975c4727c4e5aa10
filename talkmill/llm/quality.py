"""Quality by importance resampling: hashed n-gram models of good and of all text, and a Gumbel top-k of their ratio.

The weight of a text is the log ratio of its words and word pairs under two bag models over hashed buckets: one of texts
labelled good, one of all texts; a long text has that of an average stretch of STRETCH n-grams, as sums over whole texts differ
by hundreds and no draw could change their order. Adding a Gumbel variable to each log weight and taking the k largest sums
draws k texts without replacement in proportion to their weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.llm.common import raw, steps, table, tokens, with_columns, written

#: Runs of letters, digits and bytes beyond ASCII; runs of marks; white space is between.
WORDS = table(2, ((0, 32), 0), ((48, 57), 1), ((65, 90), 1), ((97, 122), 1), ("_", 1), ((127, 127), 0), ((128, 255), 1))
BUCKETS = 1 << 14
#: n-grams that the log weight of a text stands for at most.
STRETCH = 8
#: Labelled rows used at most, for the good model and for the number that is kept: those whose ids hash lowest.
LABELLED = 20_000


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word and word pair, the text of each). A word after itself is one kind of pair, whichever word it is: what
    tells raw text from good is that a word is repeated, and not which."""
    words, before = tokens(data, offsets, WORDS)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    pair = words[1:] + np.uint64(3) * words[:-1]
    pair[words[1:] == words[:-1]] = 1
    inside = owner[1:] == owner[:-1]
    both = np.concatenate([words, pair[inside] * np.uint64(0x9E3779B97F4A7C15)])
    return (both >> np.uint64(50)).astype(np.int64), np.concatenate([owner, owner[1:][inside]])


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", quality: str = "quality") -> np.ndarray:
    """The log ratio of each bucket's share in good texts to its share in all texts; zeros if no good text is there.

    labels: rows of ident and quality, 1 for good; null ids and labels are skipped. The counts of all text are over all
    docs; the good model is from at most LABELLED labelled rows. Both get half a count in each bucket.
    """
    good = F.broadcast(sample_of(labels, ident, quality).where("label = 1").select("id", F.lit(True).alias("good")).distinct())
    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).where("text is not null").join(good, "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batches):
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            data, offsets = raw(batch.column(0))
            mark = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in steps(offsets):
                bucket, owner = buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sums[0] += np.bincount(bucket, minlength=BUCKETS)
                sums[1] += np.bincount(bucket[mark[i:j][owner]], minlength=BUCKETS)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["bucket", "n", "good"])

    got = rows.mapInArrow(count, "bucket long, n long, good long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).toPandas()
    sums = np.full((2, BUCKETS), 0.5)
    sums[:, got["bucket"].to_numpy(np.int64)] += got[["n", "good"]].to_numpy(float).T
    if sums[1].sum() == BUCKETS / 2:
        return np.zeros(BUCKETS)
    return np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())


def sample_of(labels: DataFrame, ident: str, quality: str) -> DataFrame:
    """(id, label) of at most LABELLED labelled rows: a bounded sample, the same in each run."""
    rows = labels.select(F.col(ident).alias("id"), F.col(quality).cast("int").alias("label")).where("id is not null and label is not null")
    return rows.orderBy(F.xxhash64("id"), "id", "label").limit(LABELLED)


def with_weights(docs: DataFrame, ratio: np.ndarray, text: str = "text", name: str = "log_weight") -> DataFrame:
    """docs and the log importance weight of each whole text, of STRETCH n-grams at most; null for a text without any."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def make():
        ratio = held.value

        def weigh(column):
            data, offsets = raw(column)
            out, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
            for i, j in steps(offsets):
                bucket, owner = buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out[i:j], n[i:j] = np.bincount(owner, ratio[bucket], j - i), np.bincount(owner, minlength=j - i)
            return [pa.array(out * np.minimum(1, STRETCH / np.maximum(n, 1)), mask=n == 0)]

        return weigh

    return with_columns(docs, text, [(name, pa.float64(), T.DoubleType())], make)


def cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight that parts good from bad best (mean of both rates), in the middle of the gap; -inf without both kinds."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    below = np.arange(len(w) + 1)
    good_below = np.concatenate(([0], np.cumsum(g)))
    rate = (below - good_below) / (~g).sum() + (g.sum() - good_below) / g.sum()
    edge = np.concatenate(([True], w[1:] != w[:-1], [True]))
    rate[~edge] = -1
    best = int(rate.argmax())
    return (w[max(best - 1, 0)] + w[min(best, len(w) - 1)]) / 2


def threshold(keys: DataFrame, key: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a finite column, exactly, over written rows: a histogram, refined where the k-th falls."""
    low, high, n = keys.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n or k >= n:
        return -np.inf
    if k <= 0:
        return np.inf
    while True:
        within = keys.where((F.col(key) >= low) & (F.col(key) <= high))
        if low == high:
            return low
        place = F.floor((F.col(key) - low) / ((high - low) / bins))
        rows = within.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy(F.desc("bin")).collect()
        if len(rows) == 1:  # too close for bins: the few values that are left
            values = within.groupBy(key).count().orderBy(F.desc(key)).collect()
            rows = [{"n": r["count"], "low": r[key], "high": r[key]} for r in values]
        for r in rows:
            if k <= r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]


def with_keys(docs: DataFrame, ratio: np.ndarray, ident: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """docs with log_weight and gumbel_key, the log weight and a Gumbel variable, which comes from a hash of seed, id and text."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(ident), F.col(text)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = with_weights(docs.withColumn("__gumbel", -F.log(-F.log(uniform))), ratio, text, "log_weight")
    return rows.withColumn("gumbel_key", F.col("log_weight") + F.col("__gumbel")).drop("__gumbel")


def usual_k(rows: DataFrame, labels: DataFrame, ident: str, quality: str = "quality") -> int:
    """How many rows have a weight above the cut, which parts the labelled sample's good from its bad texts (see cut).

    rows: written, with log_weight. One weight an id, the smallest, so at most LABELLED rows come to the driver.
    """
    known = rows.where("log_weight is not null").select(F.col(ident).alias("id"), "log_weight").join(F.broadcast(sample_of(labels, ident, quality)), "id")
    known = known.groupBy("id", "label").agg(F.min("log_weight").alias("w")).toPandas()
    least = cut(known["w"].to_numpy(float), known["label"].to_numpy() == 1)
    return rows.where(F.col("log_weight") >= float(least)).count()


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, ident: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """docs with log_weight, gumbel_key and selected: whether the row is drawn, i.e. among the k largest keys.

    k: rows to draw; by default the number whose weight is above the cut between the labelled sample's good and bad texts. The
    draw decides near the cut: a text far above it is all but sure to be drawn. Repeated rows share their fate, and rows that
    tie with the k-th are all drawn. Texts without a word or mark (null, empty, blank) have null log_weight and gumbel_key
    and are never drawn. Without labels of both kinds, or with k beyond the rows, all others are drawn. An empty table gives
    none. Columns of docs with those three names give way.
    """
    mine = ["log_weight", "gumbel_key", "selected"]
    docs = docs.select(*[c for c in docs.columns if c not in mine])
    rows = written(with_keys(docs, fit(docs, labels, ident, text), ident, text, seed))
    k = usual_k(rows, labels, ident) if k is None else k
    return rows.withColumn("selected", F.coalesce(F.col("gumbel_key") >= F.lit(float(threshold(rows, "gumbel_key", k))), F.lit(False)))
