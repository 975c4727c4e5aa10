"""Language-model scores from a log-frequency Bloom filter, and an exact unigram score beside them.

Counts of words and word pairs are quantised to powers of two. The filter holds, for an n-gram of level q, the q items
(n-gram, 1) to (n-gram, q); a count is read by probing levels until one is missing. Pair probabilities are smoothed towards
word probabilities, which are smoothed by half a count.

The filter holds every n-gram of the training texts, so it grows with them and is not broadcast: it is cut into ranges of the
n-grams' hashes, and each range is filled and probed by one task. Texts are numbered in chunks and written. A chunk sends each
range the sorted distinct n-grams it has there, once, with their counts in its training texts; the range adds the counts up,
fills its slice of the filter, probes it for every n-gram it was sent, and answers each chunk in the order of its n-grams:
their levels, and for words the exact counts too. With its answers a chunk scores its texts on its own. Keys and answers are
packed, a row for each chunk and range. No n-gram meets a task more than once a chunk, so frequent ones make no task larger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.llm.common import LOWER, SPACED, fold, mix, raw, steps, summed, task_count, tokens, written

PROBES, BITS_PER_ITEM = 3, 8
#: The part of a probability that comes from the pair; the rest comes from the word.
PAIR_SHARE = 0.1
END, START = np.uint64(0xE5D), np.uint64(0x57A27)
#: Bytes of text in a chunk, and of text whose n-grams one range holds; more text means more of both.
CHUNK_BYTES, RANGE_BYTES = 6 << 20, 8 << 20
#: A chunk has to be read by one task, so a file of chunks is one row group.
ROW_GROUP = str(1 << 30)


def scored_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, of each pair with the token before, the text of each): words, then one end, for each text."""
    words, before = tokens(data, offsets, SPACED, LOWER)
    n = len(offsets) - 1
    size = np.diff(before)
    owner = np.repeat(np.arange(n), size + 1)
    token = np.full(len(words) + n, END, np.uint64)
    token[np.arange(len(words)) + np.repeat(np.arange(n), size)] = words
    last = np.empty_like(token)
    last[1:] = token[:-1]
    last[before[:-1] + np.arange(n)] = START
    return token, mix(token ^ (last * np.uint64(0xD6E8FEB86659FD93))), owner


def ranges_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each key, from its upper bits: sorted keys have sorted ranges."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def pack(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as one byte each, and those of 255 or more in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype(np.int64).tobytes()


def unpack(short: bytes, full: bytes) -> np.ndarray:
    out = np.frombuffer(short, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(full, np.int64)
    return out


def batch_of(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[] for _ in fields], fields.values(), strict=True)], names=list(fields))


def levels(counts: np.ndarray) -> np.ndarray:
    """0 for a count of 0, 1 for 1, 2 from 2, 3 from 4, and so on."""
    return np.frexp(counts.astype(np.float64))[1]


def level_counts(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its counts; 0 for level 0."""
    return np.where(level > 0, (3 * np.exp2(level - 1.0) - 1) / 2, 0.0)


class FrequencyFilter:
    """A Bloom filter of (key, level): BITS_PER_ITEM bits for each level of each key, PROBES places an item."""

    def __init__(self, keys: np.ndarray, level: np.ndarray):
        self.size = int(level.sum() * BITS_PER_ITEM + 7) // 8 * 8
        bits = np.zeros(self.size, np.uint8)
        for q in range(1, int(level.max(initial=0)) + 1):
            keys = keys[level >= q]
            level = level[level >= q]
            for place in self.places(keys, q):
                bits[place] = 1
        self.bits = np.packbits(bits, bitorder="little")

    def places(self, keys: np.ndarray, level: int) -> list[np.ndarray]:
        h = mix(keys ^ np.uint64(level * 0xC2B2AE3D27D4EB4F % 2**64))
        step = mix(h ^ np.uint64(0xA5A5A5A5)) | np.uint64(1)
        return [((h + np.uint64(p) * step) % np.uint64(self.size)).astype(np.int64) for p in range(PROBES)]

    def read(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key; too high with the probability of a false positive, never too low."""
        out, at, level = np.zeros(len(keys), np.int64), np.arange(len(keys) if self.size else 0), 1
        while len(at):
            hit = np.ones(len(at), bool)
            for place in self.places(keys[at], level):
                hit &= (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            at = at[hit]
            out[at] = level
            level += 1
        return out


def chunked(docs: DataFrame) -> DataFrame:
    """docs (text and more), written, with the number of the chunk that each row is in. Rows are numbered by the task attempt that
    writes them, so a lost executor can't part a row from its number."""
    at = docs.columns.index("text")

    def number(batches):
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            if size > CHUNK_BYTES:
                chunk, size = chunk + 1, 0
            size += batch.column(at).nbytes
            yield batch.append_column("chunk", pa.array(np.full(batch.num_rows, chunk)))

    schema = T.StructType([*docs.schema, T.StructField("chunk", T.LongType())])
    return written(docs.mapInArrow(number, schema), **{"parquet.block.size": ROW_GROUP})


ASKED = {"range": pa.int32(), "chunk": pa.int64(), "words": pa.binary(), "n": pa.binary(), "n_full": pa.binary(), "pairs": pa.binary(), "m": pa.binary(), "m_full": pa.binary()}
ANSWERED = {"chunk": pa.int64(), "range": pa.int32(), "n": pa.binary(), "n_full": pa.binary(), "levels": pa.binary(), "pair_levels": pa.binary(), "tokens": pa.int64(), "distinct": pa.int64()}


def ask(rows: DataFrame, ranges: int) -> DataFrame:
    """ASKED rows of each chunk: the sorted distinct words and pairs that it has in a range, and their counts in training texts."""

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        return summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def send(chunk, held):
        (word, n), (pair, m) = merged(held[0]), merged(held[1])
        edges = [np.searchsorted(ranges_of(k, ranges), np.arange(ranges + 1)) for k in (word, pair)]
        out = []
        for r in np.flatnonzero(np.diff(edges[0]) + np.diff(edges[1])):
            (a, b), (c, d) = (e[r : r + 2] for e in edges)
            out.append((int(r), chunk, word[a:b].tobytes(), *pack(n[a:b]), pair[c:d].tobytes(), *pack(m[c:d])))
        return batch_of(out, ASKED)

    def deal(batches):
        chunk, held = None, [[], []]
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low == high:
                    continue
                if numbers[low] != chunk:
                    if held[0]:
                        yield send(chunk, held)
                    chunk, held = int(numbers[low]), [[], []]
                data, offsets = raw(batch.column(1).slice(low, high - low))
                train = ~batch.column(2).slice(low, high - low).to_numpy(zero_copy_only=False).astype(bool)
                for i, j in steps(offsets):
                    word, pair, owner = scored_tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    used = train[i:j][owner]
                    for kind, keys in enumerate((word, pair)):
                        held[kind].append(summed(keys[used]))
                        other = summed(keys[~used])[0]
                        held[kind].append((other, np.zeros(len(other), np.int64)))
                    held[0].append((np.array([START]), np.array([int(train[i:j].sum())])))
                for kind in (0, 1):  # parts of parts, so that memory follows the chunk's distinct n-grams
                    if len(held[kind]) > 64:
                        held[kind] = [merged(held[kind])]
        if held[0]:
            yield send(chunk, held)

    return rows.select("chunk", "text", "held_out").mapInArrow(deal, "range int, chunk long, words binary, n binary, n_full binary, pairs binary, m binary, m_full binary")


def answer(asked: DataFrame, ranges: int) -> DataFrame:
    """ANSWERED rows, written: for each asked row its words' counts and levels and its pairs' levels, read from the range's slice of
    the filter; and a row without a chunk for each range, with its training tokens and distinct words."""

    def probe(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for r, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(r, []).append(rest)
        for r, got in held.items():
            totals = []
            for k in (1, 4):
                keys = np.frombuffer(b"".join(x[k] for x in got), np.uint64)
                totals.append(summed(keys, np.concatenate([unpack(x[k + 1], x[k + 2]) for x in got])))
            (word, n), (pair, m) = totals
            seen, seen_pair = n > 0, m > 0
            model = FrequencyFilter(np.concatenate([word[seen], pair[seen_pair]]), levels(np.concatenate([n[seen], m[seen_pair]])))
            level, pair_level = (model.read(k).astype(np.uint8) for k in (word, pair))
            real = seen & (word != START)
            out = [(None, r, *[None] * 4, int(n[real].sum()), int(real.sum()))]
            for x in got:
                a = np.searchsorted(word, np.frombuffer(x[1], np.uint64))
                b = np.searchsorted(pair, np.frombuffer(x[4], np.uint64))
                out.append((x[0], r, *pack(n[a]), level[a].tobytes(), pair_level[b].tobytes(), None, None))
                if len(out) > 500:
                    yield batch_of(out, ANSWERED)
                    out = []
            yield batch_of(out, ANSWERED)

    dealt = asked.repartitionById(ranges, F.col("range"))
    return written(dealt.mapInArrow(probe, "chunk long, range int, n binary, n_full binary, levels binary, pair_levels binary, tokens long, distinct long"))


def token_scores(word: np.ndarray, pair: np.ndarray, owner: np.ndarray, words: np.ndarray, level: np.ndarray, pairs: np.ndarray, pair_level: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """The model's log10 probability of each token. words and pairs: sorted, with their levels."""
    count = level_counts(level)
    at = np.searchsorted(words, word)
    first = np.ones(len(word), bool)
    first[1:] = owner[1:] != owner[:-1]
    before = np.where(first, count[np.searchsorted(words, START)], np.roll(count[at], 1))
    together = np.minimum(level_counts(pair_level)[np.searchsorted(pairs, pair)], np.minimum(before, count[at]))
    p = PAIR_SHARE * together / np.maximum(before, 1) + (1 - PAIR_SHARE) * (count[at] + 0.5) / (total + 0.5 * (distinct + 1))
    return np.log10(np.minimum(p, 1.0))


def score(docs: DataFrame, folds: int = 5, out: int = 1, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text).

    Learns from the texts that are not held out: those outside fold `out` of crc32(doc_id), or where held_out (a column, of
    false, true or null, which counts as false) is not true. base_score is exact, but for words of one 64-bit hash; score is
    the model's log10 probability of the text. A null or empty text is its end token alone. Rows are scored one by one:
    repeated rows and ids, null ids included, all come back. Without any training text all counts are 0 (train_tokens 0), a
    token has base probability 0.5 / 0.5 = 1, and both scores are 0. An empty table gives no rows.
    """
    held = fold(F.col("doc_id"), folds) == out if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = chunked(docs.select("doc_id", "text", held.alias("held_out")))
    # Chunk s of writing task t is number s * tasks + t, so that each task of the last step gets one chunk.
    size, tasks, deep = rows.agg(F.sum(F.octet_length("text")), F.max(F.shiftright("chunk", 32)), F.max(F.col("chunk") % (1 << 32))).first()
    tasks, deep = (tasks or 0) + 1, (deep or 0) + 1
    ranges = task_count(rows, size or 0, RANGE_BYTES)
    answers = answer(ask(rows, ranges), ranges)
    total, distinct = answers.where("chunk is null").agg(F.sum("tokens"), F.sum("distinct")).first()
    total, distinct = total or 0, distinct or 0
    replies = answers.where("chunk is not null").select("chunk", "range", "n", "n_full", "levels", "pair_levels")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("range", "int"), ("n", "binary"), ("n_full", "binary"), ("levels", "binary"), ("pair_levels", "binary"))]
    both = rows.select("chunk", *none, "doc_id", "text", "held_out").unionByName(replies, allowMissingColumns=True)
    all_half = float(np.log10(total + 0.5 * (distinct + 1)))

    def scored(texts: list[pa.RecordBatch], replies: list[tuple]):
        table = pa.Table.from_batches(texts).select(["doc_id", "text", "held_out"])
        data, offsets = raw(table.column("text"))
        parts = [scored_tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in steps(offsets)]
        words = summed(np.concatenate([np.array([START]), *[summed(p[0])[0] for p in parts]]))[0]
        pairs = summed(np.concatenate([summed(p[1])[0] for p in parts]))[0]
        replies.sort(key=lambda r: r[0])
        exact = np.concatenate([unpack(r[1], r[2]) for r in replies])
        level, pair_level = (np.frombuffer(b"".join(r[k] for r in replies), np.uint8).astype(np.int64) for k in (3, 4))
        if len(exact) != len(words) or len(pair_level) != len(pairs):
            raise ValueError("a chunk was read in parts: its answers do not match its texts")
        for (i, j), (word, pair, owner) in zip(steps(offsets), parts, strict=True):
            n, found = j - i, exact[np.searchsorted(words, word)]
            size = np.bincount(owner, minlength=n)
            base = np.bincount(owner, np.log10(found + 0.5), n) - size * all_half
            log_p = np.bincount(owner, token_scores(word, pair, owner, words, level, pairs, pair_level, total, distinct), n)
            some = table.slice(i, n).combine_chunks()
            one = lambda c: some.column(c).combine_chunks()  # noqa: B023,E731
            yield pa.RecordBatch.from_arrays([one("doc_id"), one("held_out"), pa.array(size), pa.array(np.bincount(owner, found > 0, n).astype(np.int64)), pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(log_p)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def finish(batches):
        texts: dict[int, list] = {}
        replies: dict[int, list] = {}
        for batch in batches:
            for part, chunk in parts_of(batch):
                if part.column(1).null_count:
                    texts.setdefault(chunk, []).append(part)
                else:
                    replies.setdefault(chunk, []).extend(zip(*(part.column(c).to_pylist() for c in range(1, 6)), strict=True))
        for chunk in list(texts):
            yield from scored(texts.pop(chunk), replies.pop(chunk))

    ident = docs.schema["doc_id"].dataType.simpleString()
    place = (F.col("chunk") % (1 << 32)) * tasks + F.shiftright("chunk", 32)
    return both.repartitionById(tasks * deep, place.cast("int")).mapInArrow(finish, f"doc_id {ident}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def parts_of(batch: pa.RecordBatch):
    """(rows, chunk): the rows of one chunk (column 0) and one kind (column 1 null or not), of each in the batch."""
    chunk, reply = batch.column(0).to_numpy(), np.asarray(batch.column(1).is_valid())
    order = np.lexsort((reply, chunk))
    edges = np.flatnonzero(np.concatenate(([True], (chunk[order][1:] != chunk[order][:-1]) | (reply[order][1:] != reply[order][:-1]), [True])))
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        yield batch.take(pa.array(order[i:j])), int(chunk[order[i]])
