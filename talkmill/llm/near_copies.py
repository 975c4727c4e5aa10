"""Near copies by SimHash and the Jaccard similarity of word shingles: all pairs at PART / WHOLE or more.

Texts with one shingle set are one node. Nodes whose SimHash fingerprints meet in the trie join, within RADIUS bits, are compared
first, by their whole sets. That misses many similar pairs (at 0.8 about ten bits differ), so an exact prefix-filtered self-join
finds all others between what SimHash left apart. Two sets that are similar enough share one of their first shingles in any common
order, so each node is dealt by these alone, and only shingles that two nodes hold are kept. The order puts shingles last
that a sample of texts often holds, which changes the work and not the result. Pairs in a group pass two exact filters (the
sizes, and the parities of the shingles in BITS classes, which differ in no more places than the sets do), then their whole sets
are compared. First neighbours within a group are compared, then nodes that are further apart, so that a dense group becomes one
component without all its pairs; last every pair that is still in two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.llm.common import LOWER, SPACED, discard, mix, raw, steps, task_count, tokens, with_columns, written
from talkmill.llm.simhash_dedup import components, direct_links

WIDTH = 5
#: The least similarity, as a fraction.
PART, WHOLE = 4, 5
#: Bits in which the fingerprints of nodes differ at most that the trie join meets.
RADIUS = 4
#: Classes of shingles whose parities are compared, in a group and for each pair that is left; the second grows to a
#: power of two not below the set's size, as parities of few classes say nothing of long texts. It folds to the first.
BITS, WIDE = 1024, 1024
#: Rows that the order is taken from, and how many of them hold a shingle that comes late.
SAMPLE, OFTEN = 50_000, 10
#: Nodes of a group that are compared in one task.
BLOCK = 4096
#: How far apart, in order of size, nodes of a group are compared before all that are still in two components are.
REACHES = (1, 8, 64)
#: First shingles that a task gathers before it packs them; bytes of text that one task gets them from; pairs held at once.
HELD, TASK_BYTES, HELD_PAIRS = 1 << 20, 16 << 20, 1 << 20


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, sorted within each text; where each text's begin and end). Fewer words than width are one shingle."""
    words, before = tokens(data, offsets, SPACED, LOWER)
    size = np.diff(before)
    owner = np.repeat(np.arange(len(size)), size)
    start = np.flatnonzero(np.arange(len(words)) - before[owner] < np.maximum(size - width + 1, 1)[owner])
    owner = owner[start]
    h = np.zeros(len(start), np.uint64)
    for j in range(width):
        inside = start + j < before[owner + 1]
        word = words[np.minimum(start + j, max(len(words) - 1, 0))]
        h = np.where(inside, mix((h + np.uint64(j + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ word), h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        keep = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))
        h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(len(size) + 1))


def nodes_of(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; of the empty set too."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)))
    return mix(sums[edge[1:]] - sums[edge[:-1]] + np.diff(edge).astype(np.uint64)).view(np.int64)


def prints_of(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each set: a bit is 1 if it is set in over half the shingles; zero for the empty set."""
    size = np.diff(edge)
    owner, votes = np.repeat(np.arange(len(size)), size), np.zeros((len(size), 64), np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        some = owner[i : i + (1 << 16)]
        at = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1])))
        votes[some[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    return np.packbits(votes * 2 > size[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def sets(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, shingles, edges) of a text column, step by step."""
    data, offsets = raw(column)
    for i, j in steps(offsets):
        yield i, j, *shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def with_nodes(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with node, n (the set's size), fp (its SimHash), bits and wide (its parities)."""

    def make():
        def describe(column):
            got = [(nodes_of(h, edge), np.diff(edge), prints_of(h, edge), parities(h, edge)) for _, _, h, edge in sets(column)]
            node, n, fp = (np.concatenate([x[k] for x in got] or [np.zeros(0, np.int64)]) for k in (0, 1, 2))
            wide = [x for _, _, _, some in got for x in some]
            return [pa.array(node), pa.array(n), pa.array(fp), *(pa.array([x.tobytes() for x in m], pa.binary()) for m in (map(folded, wide, [BITS] * len(wide)), wide))]

        return describe

    return with_columns(docs, text, [("node", pa.int64(), T.LongType()), ("n", pa.int64(), T.LongType()), ("fp", pa.int64(), T.LongType()), ("bits", pa.binary(), T.BinaryType()), ("wide", pa.binary(), T.BinaryType())], make)


def often_held(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least OFTEN of the sampled texts hold, sorted, and how many do: SAMPLE * texts' length / OFTEN at most."""

    def each(batches):
        for batch in batches:
            for _, _, h, _ in sets(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["key"])

    found = texts.mapInArrow(each, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).toPandas()
    key, n = found["key"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(key)
    return key[order], n[order]


def first_shingles(h: np.ndarray, edge: np.ndarray, common: np.ndarray, common_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, owner): each set's first ones in the order; a set that is similar enough has one of them among its own first."""
    size = np.diff(edge)
    owner = np.repeat(np.arange(len(size)), size)
    late = np.zeros(len(h), np.int64)
    if len(common):
        place = np.minimum(np.searchsorted(common, h), len(common) - 1)
        late = np.where(common[place] == h, common_n[place], 0)
    order = np.lexsort((h, late, owner))
    rank = np.arange(len(h)) - edge[owner]
    keep = rank < (size + (-PART * size // WHOLE) + 1)[owner]
    return h[order][keep], owner[keep]


def parities(h: np.ndarray, edge: np.ndarray) -> list[np.ndarray]:
    """The parities of each set's shingles in its classes, as bytes."""
    n, size = len(edge) - 1, np.diff(edge)
    owner = np.repeat(np.arange(n), size)
    odd = np.bincount(owner * WIDE + (mix(h) % np.uint64(WIDE)).astype(np.int64), minlength=n * WIDE) & 1
    out = list(np.packbits(odd.reshape(n, WIDE).astype(np.uint8), axis=1))
    for i in np.flatnonzero(size > WIDE):
        wide = 1 << int(size[i] - 1).bit_length()
        odd = np.bincount((mix(h[edge[i] : edge[i + 1]]) % np.uint64(wide)).astype(np.int64), minlength=wide) & 1
        out[i] = np.packbits(odd.astype(np.uint8))
    return out


def folded(parity: np.ndarray, classes: int) -> np.ndarray:
    """The parities in fewer classes."""
    return np.bitwise_xor.reduce(parity.reshape(-1, classes // 8), axis=0)


def groups(firsts: DataFrame, tasks: int) -> DataFrame:
    """(key, node, m, a, b): the nodes of each first shingle that m > 1 nodes hold; a and b are hashes of that set of nodes.
    firsts: range, keys, nodes (packed)."""

    def shared(batches):
        got = [(r, k, v) for batch in batches for r, k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        for r in {r for r, _, _ in got}:
            key = np.frombuffer(b"".join(k for s, k, _ in got if s == r), np.int64)
            node = np.frombuffer(b"".join(v for s, _, v in got if s == r), np.int64)
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            keep = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
            key, node = key[keep], node[keep]
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            m = np.diff(at, append=len(key))
            marks = [np.repeat(np.add.reduceat(mix(node.view(np.uint64) ^ np.uint64(salt)), at).view(np.int64), m) if len(at) else m for salt in (0x5EED, 0xBEAD)]
            m = np.repeat(m, m)
            for i in range(0, len(key), HELD):
                some = m[i : i + HELD] > 1
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + HELD][some]) for x in (key, node, m, *marks)], names=["key", "node", "m", "a", "b"])

    return firsts.repartitionById(tasks, F.col("range")).mapInArrow(shared, "key long, node long, m long, a long, b long")


def once(grouped: DataFrame) -> DataFrame:
    """The groups of one shingle for each set of nodes, written: a passage's shingles are held by the same texts, and give the same pairs."""
    first = written(grouped.groupBy("a", "b", "m").agg(F.min("key").alias("key")).select("key"))
    kept = written(grouped.join(first, "key", "left_semi").select("key", "node", "m"))
    discard(grouped, first)
    return kept


def possible(key: np.ndarray, node: np.ndarray, n: np.ndarray, bits: np.ndarray, own: np.ndarray, root: np.ndarray, reach: int | None) -> Iterator[np.ndarray]:
    """Pairs (u, v), u > v, of a key's nodes of different roots that the filters leave: those next to each other up to reach, or all.

    own: the part of its key that a row is from; pairs from one part are left out where it is 0 or more.
    """
    order = np.lexsort((node, n, key))
    key, node, n, bits, own, root = (x[order] for x in (key, node, n, bits, own, root))
    at, d, held, size = np.arange(len(key)), 1, [], 0
    while len(at) and (reach is None or d <= reach):
        at = at[at + d < len(key)]
        at = at[(key[at] == key[at + d]) & (n[at] * WHOLE >= n[at + d] * PART)]  # in order of size: no later one fits either
        some = at[(root[at] != root[at + d]) & ((own[at] < 0) | (own[at] != own[at + d]))]
        for i in range(0, len(some), HELD_PAIRS):
            x = some[i : i + HELD_PAIRS]
            differ = np.bitwise_count(bits[x] ^ bits[x + d]).sum(1, dtype=np.int64)
            # J >= PART / WHOLE means that the sets differ in (WHOLE - PART) / (WHOLE + PART) of both sizes at most.
            x = x[differ * (WHOLE + PART) <= (n[x] + n[x + d]) * (WHOLE - PART)]
            held.append(np.stack([np.maximum(node[x], node[x + d]), np.minimum(node[x], node[x + d])]))
            size += len(x)
        if size > HELD_PAIRS:
            yield np.unique(np.concatenate(held, axis=1), axis=1)
            held, size = [], 0
        d += 1
    if size:
        yield np.unique(np.concatenate(held, axis=1), axis=1)


def pairs(members: DataFrame, tasks: int, parts: list[str], reach: int | None) -> DataFrame:
    """(u, v) of members (key, node, n, bits, own, root and parts), compared within a key and its parts."""

    def join(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        key, node, n, own, root = (t.column(c).to_numpy() for c in ("key", "node", "n", "own", "root"))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(key), -1)
        for p in parts:
            key = np.unique(np.stack([key, t.column(p).to_numpy()]), axis=1, return_inverse=True)[1].ravel()
        for u, v in possible(key, node, n, bits, own, root, reach):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return members.repartition(tasks, "key", *parts).mapInArrow(join, "u long, v long").distinct()


def unlike_left_out(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """The candidates whose wide parities differ in no more places than the sets of similar texts may."""

    def keep(batches):
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            differ = np.zeros(len(n), np.int64)
            for i, (a, b) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                classes = 8 * min(len(a), len(b))
                a, b = (folded(np.frombuffer(x, np.uint8), classes).view(np.uint64) for x in (a, b))
                differ[i] = np.bitwise_count(a ^ b).sum(dtype=np.int64)
            at = pa.array(np.flatnonzero(differ * (WHOLE + PART) <= n * (WHOLE - PART)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["u", "v"])

    sides = [facts.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("wide").alias(f"wide_{k}")) for k in ("u", "v")]
    both = candidates.join(sides[0], "u").join(sides[1], "v").select("u", "v", "n_u", "wide_u", "n_v", "wide_v")
    return both.mapInArrow(keep, "u long, v long")


def similar(candidates: DataFrame, facts: DataFrame, rows: DataFrame) -> DataFrame:
    """The candidates (u, v) whose sets have the similarity, written. rows: row, node, text; the texts of a node's first row count."""
    candidates = written(unlike_left_out(candidates, facts))
    asked = candidates.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    first = rows.select("row", "node").join(asked, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    texts = written(rows.select("row", "text").join(first, "row").select("node", "text"))

    def compare(batches):
        for batch in batches:
            at = 0
            keep = np.zeros(batch.num_rows, bool)
            both = pa.concat_arrays([batch.column(2), batch.column(3)])
            each = pa.array(np.arange(2 * batch.num_rows).reshape(2, -1).T.ravel())
            for i in range(0, len(each), 200):  # pairs side by side, a hundred at once
                data, offsets = raw(both.take(each[i : i + 200]))
                h, edge = shingles(data, offsets)
                for x, y, z in zip(edge[:-2:2].tolist(), edge[1:-1:2].tolist(), edge[2::2].tolist(), strict=True):
                    pair = np.sort(h[x:z])
                    shared = int((pair[1:] == pair[:-1]).sum())
                    keep[at] = shared * (WHOLE + PART) >= PART * (z - x)
                    at += 1
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["u", "v"])

    left = candidates.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    found = written(left.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b").mapInArrow(compare, "u long, v long"))
    discard(candidates, texts)
    return found


def by_simhash(facts: DataFrame) -> DataFrame:
    """Candidates (u, v), u > v, that SimHash gives, written: each node with the least node of its fingerprint, and the least nodes of
    fingerprints that the trie join links."""
    least = written(facts.groupBy("fp").agg(F.min("node").alias("least")))
    links = direct_links(least.select("fp"), RADIUS)
    same = facts.join(least, "fp").select(F.col("node").alias("u"), F.col("least").alias("v"))
    ends = links.join(least.select(F.col("fp").alias("u"), F.col("least").alias("a")), "u").join(least.select(F.col("fp").alias("v"), F.col("least").alias("b")), "v")
    out = written(same.where("u > v").unionAll(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).distinct())
    discard(least, links)
    return out


def linked(rows: DataFrame) -> DataFrame:
    """(node, root) of every node that is similar to another one. rows: row, node, n, fp, bits, wide, text."""
    size, count = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    tasks = task_count(rows, size or 0, TASK_BYTES)
    chosen = rows.where(F.pmod(F.xxhash64("node", "row"), max(1, count // SAMPLE)) == 0)
    held = rows.sparkSession.sparkContext.broadcast(often_held(chosen.select("text")))

    def deal(batches):
        parts, count = [], 0

        def packed():
            key, node = (np.concatenate(x) for x in zip(*parts, strict=True))
            to = ((mix(key) >> np.uint64(32)) * np.uint64(tasks) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            edge = np.searchsorted(to[order], np.arange(tasks + 1))
            at = np.flatnonzero(np.diff(edge))
            rows = [(key[order[edge[t] : edge[t + 1]]].tobytes(), node[order[edge[t] : edge[t + 1]]].tobytes()) for t in at]
            return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([k for k, _ in rows], pa.binary()), pa.array([v for _, v in rows], pa.binary())], names=["range", "keys", "nodes"])

        for batch in batches:
            node = batch.column(0).to_numpy()
            for i, _, h, edge in sets(batch.column(1)):
                key, owner = first_shingles(h, edge, *held.value)
                parts.append((key, node[i + owner]))
                count += len(key)
                if count > HELD:
                    yield packed()
                    parts, count = [], 0
        if count:
            yield packed()

    grouped = once(written(groups(rows.select("node", "text").mapInArrow(deal, "range int, keys binary, nodes binary"), tasks)))
    facts = written(rows.select("node", "n", "fp", "bits", "wide").join(grouped.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    parts = F.ceil(F.col("m") / BLOCK)
    part, alone = F.pmod(F.xxhash64("node"), parts).alias("part"), F.lit(-1).cast("long").alias("own")
    met = by_simhash(facts.select("node", "fp"))
    root_of = joined(None, similar(met, facts, rows))
    discard(met)
    for reach in REACHES:
        some = unsettled(grouped, root_of).join(facts.drop("wide"), "node").select("key", "node", "n", "bits", part, alone, "root")
        root_of = joined(root_of, similar(pairs(some, tasks, ["part"], reach), facts, rows))
    rest = unsettled(grouped, root_of).join(facts.drop("wide"), "node").select("key", "node", "n", "bits", "root", part, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    low, high = F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")
    rest = rest.select("key", "node", "n", "bits", "root", low, high, F.when(F.col("part") == F.col("other"), F.lit(-1).cast("long")).otherwise(F.col("part")).alias("own"))
    root_of = joined(root_of, similar(pairs(rest, tasks, ["low", "high"], None), facts, rows))
    discard(grouped, facts)
    return root_of


def unsettled(grouped: DataFrame, root_of: DataFrame) -> DataFrame:
    """The groups whose nodes are in two components or more, with each node's root."""
    rooted = grouped.join(root_of, "node", "left").select("key", "node", "m", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("key")
    return rooted.join(mixed, "key", "left_semi")


def joined(root_of: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of what was known and of more links, which are spent."""
    out = components(links if root_of is None else links.union(root_of.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u > v")))
    discard(links)
    return out


def labelled(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(docs, written, with row: a number of its own; row, component and the columns carry of each). Rows that links of similar
    texts connect have one component. Texts without words are alike."""
    rows = written(with_nodes(docs, text).withColumn("row", F.monotonically_increasing_id()))
    root_of = linked(rows.select("row", "node", "n", "fp", "bits", "wide", F.col(text).alias("text")))
    return rows.select(*docs.columns, "row"), rows.select("row", "node", *carry).join(root_of, "node", "left").select("row", F.coalesce("root", "node").alias("component"), *carry)


def with_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with row and component (see labelled)."""
    rows, labels = labelled(docs, text)
    return rows.join(labels, "row").select(*docs.columns, "row", "component")
