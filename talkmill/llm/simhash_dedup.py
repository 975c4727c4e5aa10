"""SimHash near-duplicates: fingerprints, and all pairs within a Hamming distance by a self-join of binary tries.

Fingerprints are distinct before the join, so copies cost nothing there. A fingerprint is dealt to one trie for each of
radius + 1 bit blocks, together with those that share the block: two fingerprints within the radius share one at least. A trie
that is too large for that is dealt again in the same way, by blocks of the bits that its members need not share, and so on.
Each task lays its tries out as one sorted array, walks pairs of nodes level by level, adds one to a pair's error for each
differing bit, and drops the pair beyond the radius. What a task finds leaves it as a forest (a link from each fingerprint
to the smallest of its component there), so a dense cluster gives as many rows as fingerprints. Components over all tasks
come from alternating star contractions on written tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.llm.common import binary, discard, task_count, with_columns, written

#: A trie with more distinct fingerprints is dealt again.
BLOCK_ROWS = 100_000
#: Bytes of text whose words are held at once.
TEXT_STEP = 1 << 20
#: Rows of a task, and node pairs that it holds at once.
TASK_ROWS, FRONTIER = 200_000, 1 << 20


_between = re.compile(rb"[ \t-\r]")


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The 64-bit SimHash of one text: its lower-cased words' width-shingles, each with one vote, repeats included.

    A long text is taken in steps, each beginning with the last words of the one before.
    """
    text, at, n, votes, kept = text or b"", 0, 0, np.zeros(64, np.int64), []
    while at < len(text):
        end = len(text)
        if end - at > TEXT_STEP:
            found = _between.search(text, at + TEXT_STEP)
            end = found.start() if found else end
        kept += text[at:end].lower().split()
        at = end
        if len(kept) >= width:
            votes += shingle_votes(kept, width)
            n += len(kept) - width + 1
            kept = kept[len(kept) - width + 1 :]
    if not n and kept:
        votes, n = shingle_votes(kept, len(kept)), 1
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def shingle_votes(words: list[bytes], width: int) -> np.ndarray:
    """How many shingles of width words have each bit of their hash set."""
    joined, n = b" ".join(words), len(words) - width + 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    ends = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
    return votes


def with_fingerprints(docs: DataFrame, text: str = "text", width: int = 4, name: str = "fp") -> DataFrame:
    """docs and their fingerprints as a signed long. Null and wordless texts have fingerprint zero."""

    def make():
        return lambda column: [pa.array(np.array([fingerprint(x, width) for x in binary(column).to_pylist()], np.uint64).view(np.int64))]

    return with_columns(docs, text, [(name, pa.int64(), T.LongType())], make)


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes, the smallest node that links (u, v) connect it to."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            break
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def trie_links(key: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places whose keys lie in one group and differ in at most radius bits.

    key is sorted within each group. Node pairs are four bounds and an error; a node is a run of keys with one prefix.
    """
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    last = np.append(first[1:], len(group))
    start = np.stack([first, last, first, last, np.zeros_like(first)])
    counts: dict[int, np.ndarray] = {}
    todo = [(0, start)]
    while todo:
        depth, pairs = todo.pop()
        if pairs.shape[1] > FRONTIER:
            half = pairs.shape[1] // 2
            todo += [(depth, pairs[:, :half]), (depth, pairs[:, half:])]
            continue
        size = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
        small = (size <= 32) | (depth == 64)
        if small.any():
            done, size = pairs[:, small], size[small]
            for at in range(0, done.shape[1], 1 << 15):
                la, _, lb, hb, _ = done[:, at : at + (1 << 15)]
                n = size[at : at + (1 << 15)]
                number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                wide = np.repeat(hb - lb, n)
                x, y = np.repeat(la, n) + number // wide, np.repeat(lb, n) + number % wide
                near = (np.bitwise_count(key[x] ^ key[y]) <= radius) & ((x < y) | np.repeat(la != lb, n))
                if near.any():
                    yield x[near], y[near]
        pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            continue
        if depth not in counts:
            counts[depth] = np.concatenate(([0], np.cumsum((key >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int32)))
        c = counts[depth]
        la, ha, lb, hb, error = pairs
        ma, mb = ha - (c[ha] - c[la]), hb - (c[hb] - c[lb])
        own = la == lb
        below = np.concatenate([
            np.stack([la, ma, lb, mb, error]),
            np.stack([ma, ha, mb, hb, error]),
            np.stack([la, ma, mb, hb, error + 1]),
            np.stack([ma, ha, lb, mb, error + 1])[:, ~own],
        ], axis=1)
        below = below[:, (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= radius)]
        if below.shape[1]:
            todo.append((depth + 1, below))


def blocks_of(used: int, radius: int) -> list[int]:
    """The bits that aren't in used, in radius + 1 blocks at most: a mask for each. Two fingerprints that agree in the used bits and
    differ in at most radius others agree in one block."""
    free = [i for i in range(64) if not used >> i & 1]
    size = [len(free) // (radius + 1) + (i < len(free) % (radius + 1)) for i in range(radius + 1)]
    return [sum(1 << i for i in free[sum(size[:j]) : sum(size[: j + 1])]) for j in range(radius + 1) if size[j]]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def tries(fps: DataFrame, radius: int) -> DataFrame:
    """(mask, shared, fp): fingerprints in groups that agree in the bits of mask, such that any two within the radius meet in one.

    Groups above BLOCK_ROWS are dealt again until none is left, radius + 1 copies a level and never more than BLOCK_ROWS in
    a group but where all bits are used. Only groups' sizes are looked at, level by level, on written tables.
    """
    rows, masks, done = fps.select(F.lit(0).cast("long").alias("mask"), "fp"), [0], []
    while masks:
        below = {m: [m | b for b in blocks_of(m, radius)] for m in masks}
        each = F.coalesce(*[F.when(F.col("mask") == signed(m), F.array(*[F.lit(signed(x)).cast("long") for x in sorted(new)])) for m, new in below.items()])
        dealt = rows.select(F.explode(each).alias("mask"), "fp").withColumn("shared", F.col("fp").bitwiseAND(F.col("mask"))).distinct()
        large = written(dealt.groupBy("mask", "shared").count().where((F.col("count") > BLOCK_ROWS) & (F.col("mask") != -1)).select("mask", "shared"))
        again = [r["mask"] % (1 << 64) for r in large.select("mask").distinct().collect()]  # masks, not groups: (radius + 1)**level at most
        if not again:
            return reduce(DataFrame.unionByName, done, dealt)
        dealt = written(dealt)
        done.append(dealt.join(large, ["mask", "shared"], "left_anti"))
        rows, masks = dealt.join(large, ["mask", "shared"], "left_semi").select("mask", "fp"), again
    raise AssertionError


def near_links(fps: DataFrame, radius: int) -> DataFrame:
    """A spanning forest of the links between distinct fingerprints fp: columns u > v. fps may be of any size."""
    rows = written(tries(fps, radius).select("mask", "shared", "fp"))
    n = task_count(fps, rows.count(), TASK_ROWS)

    def join(batches):
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        mask, shared, fp = (np.concatenate(c) for c in zip(*got, strict=True))
        group = mix_groups(mask, shared)
        order = np.lexsort((fp.view(np.uint64), group))
        fp, group = fp[order], group[order]
        ids, place = np.unique(fp, return_inverse=True)
        label = np.arange(len(ids))
        for x, y in trie_links(fp.view(np.uint64), group, radius):
            x, y = label[place[x]], label[place[y]]
            label = roots(len(ids), x, y)[label]
        at = np.flatnonzero(label != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[label[at]])], names=["u", "v"])

    return rows.repartition(n, "mask", "shared").mapInArrow(join, "u long, v long")


def direct_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links within the radius between distinct fingerprints fp, written: columns u > v. Each u has one to the least v that it has one
    to at all, and may have others: a link a trie at most, so a dense cluster gives no more than its fingerprints' copies."""
    rows = written(tries(fps, radius).select("mask", "shared", "fp"))
    n = task_count(fps, rows.count(), TASK_ROWS)

    def join(batches):
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        mask, shared, fp = (np.concatenate(c) for c in zip(*got, strict=True))
        group = mix_groups(mask, shared)
        order = np.lexsort((fp.view(np.uint64), group))
        fp, group = fp[order], group[order]
        ids, place = np.unique(fp, return_inverse=True)
        least = np.arange(len(ids))
        for x, y in trie_links(fp.view(np.uint64), group, radius):
            x, y = place[x], place[y]
            np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        at = np.flatnonzero(least != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[least[at]])], names=["u", "v"])

    links = written(rows.repartition(n, "mask", "shared").mapInArrow(join, "u long, v long").distinct())
    discard(rows)
    return links


def mix_groups(*columns: np.ndarray) -> np.ndarray:
    """A number for each distinct combination."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        values, place = np.unique(c, return_inverse=True)
        out = np.unique(out * len(values) + place, return_inverse=True)[1]
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u > v): alternating large and small stars until nothing changes.

    root is the smallest node of the component. The rounds grow with the logarithm of a component's length.
    """
    edges, before = written(links.select("u", "v").distinct()), None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v")
        edges = written(small.distinct())


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """One row per document: its id, fingerprint (16 hex digits) and component_id, the smallest id that links reach.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Repeated rows stay. A null id is
    kept and never is the smallest; a component of null ids only has a null component_id. An empty table gives none.
    """
    prints = written(with_fingerprints(docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")), "text", width).select("doc_id", "fp"))
    ids = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots_of = components(near_links(ids.select("fp"), radius))
    # Each side of a join is a written table, so that Spark can split a hot root's or fingerprint's rows over tasks.
    labelled = written(ids.join(roots_of, ids.fp == roots_of.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    component = written(labelled.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = written(labelled.join(component, "root").select("fp", "component_id"))
    return prints.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
