"""Language identification with bit-sliced Bloom filters of byte n-grams.

Slot i of the filter is a bit mask with one bit a language: the languages' Bloom filters, side by side. Probing the slots of
an n-gram and taking the AND gives all languages that contain it at once. A text's popcount for a language is the number of
its n-grams whose mask has the language's bit; less the false positives to be expected from the filter's filling, it decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.llm.common import fold, mix, raw, steps, summed, with_columns

#: Letters' bytes in lower case; all others are 0x20. Bytes of characters beyond ASCII count as letters.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)

MAX_LANGUAGES = 64


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(3- and 4-byte n-grams, the text of each): within a word, or with the blank before or after it."""
    n = len(offsets) - 1
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    text = np.repeat(np.arange(n), np.diff(offsets))
    padded[np.arange(len(data)) + 2 * text + 1] = LETTERS[data]
    text = np.repeat(np.arange(n), np.diff(offsets) + 2)
    blank = padded == 32
    out, owner = [], []
    for size in (3, 4):
        end = len(padded) - size + 1
        if end <= 0:
            continue
        good = text[:end] == text[size - 1 :]
        for i in range(1, size - 1):
            good &= ~blank[i : end + i]
        at = np.flatnonzero(good)
        code = np.full(len(at), size, np.uint64)
        for i in range(size):
            code = (code << np.uint64(8)) | padded[at + i].astype(np.uint64)
        out.append(code)
        owner.append(text[at])
    return (np.concatenate(out), np.concatenate(owner)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


@dataclass
class LanguageFilter:
    """The languages, sorted, and the slots: a power of two of them, each a mask of languages."""

    languages: list[str]
    slots: np.ndarray
    probes: int

    def masks(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), ~np.uint64(0), np.uint64)
        for place in places(codes, len(self.slots), self.probes):
            out &= self.slots[place]
        return out

    def false_positives(self) -> np.ndarray:
        bits = np.array([((self.slots >> np.uint64(i)) & np.uint64(1)).mean() for i in range(len(self.languages))])
        return bits**self.probes

    def judge(self, data: np.ndarray, offsets: np.ndarray, wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the best language for each text, and the share of the text's n-grams that it holds."""
        n = len(offsets) - 1
        codes, owner = grams(data, offsets)
        masks = self.masks(codes)
        total = np.bincount(owner, minlength=n)
        found = np.stack([np.bincount(owner[((masks >> np.uint64(i)) & np.uint64(1)) == 1], minlength=n) for i in range(len(self.languages))], axis=1)
        corrected = (found - total[:, None] * wrong) / (1 - wrong)
        best = corrected.argmax(1)
        return best, np.clip(corrected[np.arange(n), best] / np.maximum(total, 1), 0, 1)


def places(codes: np.ndarray, slots: int, probes: int) -> list[np.ndarray]:
    h = mix(codes)
    step = mix(h) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(slots - 1)).astype(np.int64) for i in range(probes)]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", min_rate: float = 2e-6, min_share: float = 0.1, probes: int = 4, bits: int = 8) -> LanguageFilter | None:
    """The filter of docs' texts by their languages; null texts and languages teach nothing; None if no language is left.

    All texts are counted. A language contains an n-gram that makes up min_rate of its n-grams, and min_share of the rate
    that it has in the language where it is commonest. So no language contains more than 1 / min_rate n-grams, at any
    size of input, and that many are gathered on the driver at most. More than 64 languages raise an error.
    """
    docs = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    languages = sorted(r[0] for r in docs.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return None
    number = {x: i for i, x in enumerate(languages)}

    def count(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            data, offsets = raw(batch.column(0))
            which = np.array([number.get(x, 0) for x in batch.column(1).to_pylist()], np.uint64)
            for i, j in steps(offsets):
                codes, owner = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                k, c = summed(codes | (which[i:j][owner] << np.uint64(40)))
                keys, counts = summed(np.concatenate([keys, k]), np.concatenate([counts, c]))
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)].view(np.int64)), pa.array(counts[i : i + (1 << 16)])], names=["key", "n"])

    sums = docs.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    sums = sums.select(F.expr(f"key & {2**40 - 1}").alias("gram"), F.shiftright("key", 40).alias("lang"), "n")
    totals = sums.groupBy("lang").agg(F.sum("n").alias("total"))  # a row a language
    rates = sums.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= min_rate)
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("lang", "rate")).alias("each"))
    held = best.select("gram", F.transform(F.filter("each", lambda x: x["rate"] >= F.col("best") * min_share), lambda x: x["lang"]).alias("langs"))
    held = held.select("gram", F.aggregate("langs", F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.cast("int")))).alias("mask")).toPandas()
    codes, masks = held["gram"].to_numpy().view(np.uint64), held["mask"].to_numpy().astype(np.int64).view(np.uint64)
    most = max((int(((masks >> np.uint64(i)) & np.uint64(1)).sum()) for i in range(len(languages))), default=1)
    slots = np.zeros(1 << max(10, (most * bits - 1).bit_length()), np.uint64)
    for place in places(codes, len(slots), probes):
        np.bitwise_or.at(slots, place, masks)
    return LanguageFilter(languages, slots, probes)


def with_language(docs: DataFrame, model: LanguageFilter | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs, the language of each whole text, and the share of its n-grams which that language contains (0 to 1).

    Null texts and texts without a letter are `und` with score 0. A text whose n-grams are all unknown goes to the first
    language with score 0. Equal counts go to the language that sorts first. Only the text is looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value
        names = np.array([*(model.languages if model else []), "und"], object)
        wrong = model.false_positives() if model else None

        def judge(column):
            data, offsets = raw(column)
            n = len(offsets) - 1
            best, share = np.full(n, len(names) - 1), np.zeros(n)
            for i, j in steps(offsets) if model else []:
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                b, s = model.judge(part, at, wrong)
                letter = np.concatenate(([0], np.cumsum((LETTERS[part] != 32) & (part < 128))))
                for k in np.flatnonzero(letter[at[1:]] == letter[at[:-1]]):  # no ASCII letter: look at its characters
                    if not any(map(str.isalpha, part[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace"))):
                        b[k], s[k] = len(names) - 1, 0
                best[i:j], share[i:j] = b, s
            return [pa.array(names[best], pa.string()), pa.array(share)]

        return judge

    return with_columns(docs, text, [(lang, pa.string(), T.StringType()), (score, pa.float64(), T.DoubleType())], make)


def predict(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learns from documents outside fold 0 of crc32(doc_id) and predicts all: doc_id, held_out, lang_pred, score."""
    d = docs.select("doc_id", "text", "lang", (fold(F.col("doc_id"), folds) == 0).alias("held_out"))
    model = fit(d.where(~F.col("held_out")))
    return with_language(d.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
