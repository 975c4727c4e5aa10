"""Approximate nearest neighbours by inner product: graphs built by NN-descent, and greedy search on them.

Equal vectors are one node, so a group of copies can't fill its own neighbour lists; its rows come back at the end. Nodes are dealt
to shards by hash. A shard's task builds its graph: the first one compares neighbours in several orders of the nodes, each by the
signs of random projections; a round of NN-descent joins each node's list with the lists that hold it, compares neighbours that
haven't met (one of them new in a list), and gives each the better ones; rounds end when few entries change. Then each query is
searched in every shard's graph, which expands the best unexpanded nodes of its beam until none is left, and the shards' best are merged.

Rows between tasks are whole nodes, whole queries and packed lists, never single entries of lists. Final scores are in double
precision, from the vectors as given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talkmill.llm.common import given_back, written

#: Neighbours of a node in the graph; new entries of a list, and lists that hold a node, that take part in a round.
DEGREE, SAMPLED = 40, 20
#: Orders of the first graph, signs in an order, nodes that are compared in one run, nodes whose lists are joined in one step.
ORDERS, SIGNS, RUN, BLOCK = 4, 48, 512, 512
#: NN-descent ends when a smaller share of the list entries is new.
STILL = 0.005
#: Nodes in a query's beam; nodes of it that a step expands; nodes that a search begins with; queries searched at once.
BEAM, EXPANDED, STARTS, ASKED = 64, 8, 64, 256
#: Numbers of a shard's vectors at most, nodes of one of several shards at least; found entries that are held before lists take them in.
SHARD, SMALL, HELD = 6_400_000, 1024, 1 << 20
#: Numbers that one step gathers of vectors; queries that meet all nodes in one pass.
GATHERED, PASS = 1 << 22, 4096


def doubles(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def firsts(owner: np.ndarray, n: int) -> np.ndarray:
    """Each row's place among those of its owner; owners are sorted."""
    return np.arange(len(owner)) - np.searchsorted(owner, np.arange(n))[owner]


def taken_in(ids: np.ndarray, sims: np.ndarray, state: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct entries of each row, best first; of equal ids the first. ids -1 (sims -inf) are none."""
    out = []
    for i in range(0, max(len(ids), 1), 8192):
        some = (ids[i : i + 8192], sims[i : i + 8192], state[i : i + 8192])
        order = np.argsort(some[0], axis=1, kind="stable")
        d, s, t = (np.take_along_axis(x, order, 1) for x in some)
        s[:, 1:][d[:, 1:] == d[:, :-1]] = -np.inf
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        d, s, t = (np.take_along_axis(x, order, 1) for x in (d, s, t))
        out.append((np.where(np.isfinite(s), d, -1), s, np.where(np.isfinite(s), t, 0)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


#: States of an entry: none or old, new, new and in the round that runs, added by it.
OLD, NEW, USED, ADDED = 0, 1, 2, 3


def first_graph(x: np.ndarray, k: int, run: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sims, states): the k best of each node among those in a run with it, in any of the orders."""
    n = len(x)
    ids, sims, state = np.full((n, k), -1, np.int32), np.full((n, k), -np.inf, np.float32), np.zeros((n, k), np.int8)
    origin = x.mean(0)
    for _ in range(ORDERS):
        code = ((x - origin) @ rng.normal(size=(x.shape[1], SIGNS)).astype(np.float32) > 0) @ (1 << np.arange(SIGNS)[::-1])
        order = np.argsort(code, kind="stable")
        found, value = np.full((n, k), -1, np.int32), np.full((n, k), -np.inf, np.float32)
        for at in range(0, n, run):
            some = order[at : at + run]
            sim = x[some] @ x[some].T
            np.fill_diagonal(sim, -np.inf)
            m = min(k, len(some) - 1)
            if m > 0:
                top = np.argpartition(sim, len(some) - m, axis=1)[:, len(some) - m :]
                found[some, :m], value[some, :m] = some[top], np.take_along_axis(sim, top, 1)
        ids, sims, state = taken_in(np.hstack([ids, found]), np.hstack([sims, value]), np.hstack([state, np.full((n, k), NEW, np.int8)]), k)
    return ids, sims, state


def holders(ids: np.ndarray, which: np.ndarray, cap: int, rng: np.random.Generator) -> np.ndarray:
    """For each node, cap of the nodes that hold it in an entry of which, drawn at random; -1 where they are fewer."""
    a, c = np.nonzero(which)
    b = ids[a, c]
    order = rng.permutation(len(a))
    order = order[np.argsort(b[order], kind="stable")]
    a, b = a[order], b[order]
    place = firsts(b, len(ids))
    out = np.full((len(ids), cap), -1, np.int32)
    out[b[place < cap], place[place < cap]] = a[place < cap]
    return out


def descend(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, state: np.ndarray, block: int, rng: np.random.Generator) -> int:
    """One round of NN-descent, in place; how many entries it added."""
    n, k = ids.shape
    fresh = state == NEW
    used, old = fresh & (np.cumsum(fresh, axis=1) <= SAMPLED), (state == OLD) & (ids >= 0)
    state[used] = USED
    own = np.where(used, ids, -1)
    own = np.take_along_axis(own, np.argsort(own < 0, axis=1, kind="stable")[:, :SAMPLED], 1)
    new = np.hstack([own, holders(ids, used, SAMPLED, rng)])
    all_ = np.hstack([new, np.where(old, ids, -1), holders(ids, old, SAMPLED, rng)])
    held, count = [], 0

    def take() -> None:
        u, v, s = (np.concatenate(y) for y in zip(*held, strict=True))
        _, at = np.unique(u.astype(np.int64) * n + v, return_index=True)
        at = at[np.lexsort((-s[at], u[at]))]
        u, v, s = u[at], v[at], s[at]
        place = firsts(u, n)
        u, v, s, place = (y[place < k] for y in (u, v, s, place))
        who, row = np.unique(u, return_inverse=True)
        found, value = np.full((len(who), k), -1, np.int32), np.full((len(who), k), -np.inf, np.float32)
        found[row, place], value[row, place] = v, s
        ids[who], sims[who], state[who] = taken_in(np.hstack([ids[who], found]), np.hstack([sims[who], value]), np.hstack([state[who], np.full(found.shape, ADDED, np.int8)]), k)

    step = max(1, min(block, GATHERED // (all_.shape[1] * x.shape[1])))
    for i in range(0, n, step):
        p, q = new[i : i + step], all_[i : i + step]
        sim = np.matmul(x[p], x[q].transpose(0, 2, 1))
        floor = sims[:, -1]
        low = np.minimum(np.where(p >= 0, floor[p], np.inf)[:, :, None], np.where(q >= 0, floor[q], np.inf)[:, None, :])
        hub, a, b = np.nonzero((sim > low) & (p >= 0)[:, :, None] & (q >= 0)[:, None, :] & (p[:, :, None] != q[:, None, :]))
        u, v, s = p[hub, a], q[hub, b], sim[hub, a, b]
        for y, z in ((u, v), (v, u)):
            better = s > floor[y]
            held.append((y[better], z[better], s[better]))
            count += int(better.sum())
        if count > HELD:
            take()
            held, count = [], 0
    if count:
        take()
    added = state == ADDED
    state[state == USED], state[added] = OLD, NEW
    return int(added.sum())


def build(x: np.ndarray, k: int, run: int, block: int) -> np.ndarray:
    """Each node's neighbours, and as many of the nodes that hold it; -1 is none. Rounds of NN-descent until fewer than STILL of the
    entries are new. Each entry of a list only gets better, so they end."""
    rng = np.random.default_rng(x.shape[1])
    ids, sims, state = first_graph(x, k, run, rng)
    while descend(x, ids, sims, state, block, rng) > STILL * ids.size:
        pass
    return np.hstack([ids, holders(ids, ids >= 0, k, rng)])


def search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sims): the beam of each query that greedy search ends with; -1 where it holds fewer."""
    n, m = len(x), len(queries)
    seen = np.zeros((m, n), bool)
    start = np.unique(np.linspace(0, n - 1, min(n, STARTS)).astype(np.int64))
    ids, sims, open_ = np.full((m, beam), -1, np.int64), np.full((m, beam), -np.inf, np.float32), np.zeros((m, beam), bool)
    row, to = np.repeat(np.arange(m), len(start)), np.tile(start, m)
    while True:
        seen[row, to] = True
        step = max(1, GATHERED // x.shape[1])
        sim = np.concatenate([np.einsum("ij,ij->i", queries[row[i : i + step]], x[to[i : i + step]]) for i in range(0, max(len(row), 1), step)])
        better = sim > sims[row, -1]
        row, to, sim = row[better], to[better], sim[better]
        if len(row):
            place = firsts(row, m)
            more = (m, int(place.max()) + 1)
            found, value = np.full(more, -1, np.int64), np.full(more, -np.inf, np.float32)
            found[row, place], value[row, place] = to, sim
            order = np.argsort(-np.hstack([sims, value]), axis=1, kind="stable")[:, :beam]
            ids, sims, open_ = (np.take_along_axis(np.hstack(y), order, 1) for y in ((ids, found), (sims, value), (open_, found >= 0)))
        chosen = open_ & (np.cumsum(open_, axis=1) <= EXPANDED)
        if not chosen.any():
            return ids, sims
        open_ &= ~chosen
        row, at = np.nonzero(chosen)
        to = links[ids[row, at]]
        row = np.repeat(row, to.shape[1])[to.ravel() >= 0]
        to = to.ravel()[to.ravel() >= 0]
        unseen = ~seen[row, to]
        pair = np.unique(row[unseen] * n + to[unseen])
        row, to = pair // n, pair % n


def searched(nodes: DataFrame, asked: DataFrame, shards: int, k: int) -> DataFrame:
    """(a, b, sim), written: for each node a of asked, itself and the k best other nodes that were found, with those that
    tie with the last; sim in double precision."""
    queries = nodes.join(asked.select("node").distinct(), "node", "left_semi")
    dealt = nodes.select(F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "node", "v")
    dealt = dealt.unionAll(queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "node", "v"))
    degree, run, block, beam = DEGREE, RUN, BLOCK, BEAM

    def work(batches) -> Iterator[pa.RecordBatch]:
        """A shard's nodes come first, then queries."""
        ids, vectors, graph = [], [], None
        for rows in given_back(batches):
            asks = rows.column(1).to_numpy() == 1
            node, v = rows.column(2).to_numpy(), rows.column(3).to_pylist()
            if not asks.all():
                ids.append(node[~asks])
                vectors += [y for y, z in zip(v, asks, strict=True) if not z]
            if asks.any() and vectors:
                if graph is None:
                    ids, exact = np.concatenate(ids), doubles(vectors)
                    vectors, scale = [True], np.abs(exact).max()
                    x = (exact / scale).astype(np.float32)
                    graph = build(x, degree, run, block)
                node, matrix = node[asks], doubles([y for y, z in zip(v, asks, strict=True) if z])
                for i in range(0, len(node), ASKED):
                    mine, some = node[i : i + ASKED], matrix[i : i + ASKED]
                    at, sim = search(x, graph, (some / np.abs(some).max(1)[:, None]).astype(np.float32), beam)
                    sim = np.stack([np.einsum("ij,j->i", exact[p], q) for p, q in zip(at, some, strict=True)])
                    sim[(at < 0) | (ids[at] == mine[:, None])] = -np.inf
                    last = -np.partition(-sim, min(k, sim.shape[1]) - 1, axis=1)[:, min(k, sim.shape[1]) - 1]
                    keep = (sim >= last[:, None]) & np.isfinite(sim)  # and those that tie with the last
                    found = [(ids[p[t]].tobytes(), s[t].tobytes()) for p, s, t in zip(at, sim, keep, strict=True)]
                    yield batch(a=mine, own=np.einsum("ij,ij->i", some, some), b=[y for y, _ in found], sim=[y for _, y in found])

    lists = dealt.repartitionById(shards, "shard").sortWithinPartitions("asks").mapInArrow(work, "a long, own double, b binary, sim binary")

    def best(batches) -> Iterator[pa.RecordBatch]:
        got = [rows for rows in given_back(batches) if rows.num_rows]
        if not got:
            return
        a, own, b, sim = pa.Table.from_batches(got).columns
        b, sim = b.to_pylist(), sim.to_pylist()
        owner, itself = np.unique(a.to_numpy(), return_index=True)
        row = np.repeat(a.to_numpy(), [len(y) // 8 for y in b])
        b, sim = np.frombuffer(b"".join(b), np.int64), np.frombuffer(b"".join(sim), np.float64)
        order = np.lexsort((-sim, row))
        row, b, sim = row[order], b[order], sim[order]
        at = np.searchsorted(owner, row)
        place, last = firsts(at, len(owner)), np.full(len(owner), -np.inf)
        last[at[place == k - 1]] = sim[place == k - 1]
        keep = sim >= last[at]
        yield batch(a=np.concatenate([owner, row[keep]]), b=np.concatenate([owner, b[keep]]), sim=np.concatenate([own.to_numpy()[itself], sim[keep]]))

    return written(lists.repartition(shards, "a").mapInArrow(best, "a long, b long, sim double"))


def compared_with_all(nodes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(a, b, sim) of the k best nodes b of each node a of asked, itself too, by comparing with all, PASS queries a pass."""
    rows = written(nodes.join(asked.select("node").distinct(), "node", "left_semi").select("node", "v"))
    out, parts = None, -(-rows.count() // PASS)
    for part in range(parts):  # by hash, so a pass has about PASS distinct nodes
        got = rows.where(F.pmod(F.xxhash64("node"), parts) == part).collect()
        if not got:
            continue
        held = nodes.sparkSession.sparkContext.broadcast((np.array([r["node"] for r in got]), doubles([bytes(r["v"]) for r in got])))

        def compare(batches, held=held):
            query, matrix = held.value
            for some in given_back(batches):
                if some.num_rows:
                    ids, sim = some.column(0).to_numpy(), matrix @ doubles(some.column(1).to_pylist()).T
                    top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                    yield batch(a=np.repeat(query, top.shape[1]), b=ids[top].ravel(), sim=np.take_along_axis(sim, top, 1).ravel())

        found = nodes.select("node", "v").mapInArrow(compare, "a long, b long, sim double")
        best = found.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("r") <= k).drop("r")
        out = best if out is None else out.unionAll(best)
    return out


def nearest(rows: DataFrame, every: int = 20, k: int = 20, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, the k nearest other rows that were found.

    Nearness is the inner product in double precision; ties go to the smaller id. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do rows without an id. Vectors of unlike lengths have no inner product: each length
    is searched by itself. Equal vectors are all found. A query gets k rows, or all others of its length if they are fewer: one that
    the graph leaves short is compared with all. Rows that repeat an id and a vector count once for each row. An empty table
    gives no rows.
    """
    some = rows.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    some = some.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))

    def pack(batches):
        for rows in batches:
            if rows.num_rows:
                at = rows.column(1).offsets.to_numpy()
                data = rows.column(1).values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zero
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([data[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["vec_id", "v"])

    packed = written(some.mapInArrow(pack, "vec_id long, v binary"))
    sizes = [r["n"] for r in packed.select(F.octet_length("v").alias("n")).distinct().collect()]
    if not sizes:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    each = [of_one_length(packed.where(F.octet_length("v") == n) if len(sizes) > 1 else packed, n // 8, every, k) for n in sorted(sizes)]
    out = each[0]
    for more in each[1:]:
        out = out.unionAll(more)
    return out


def of_one_length(packed: DataFrame, width: int, every: int, k: int) -> DataFrame:
    """nearest, of vectors (vec_id, v) of one length, as bytes of doubles."""
    nodes = written(packed.select("v").distinct().withColumn("node", F.monotonically_increasing_id()))
    members = written(packed.join(nodes, "v").select("node", "vec_id"))
    n, total = nodes.count(), members.count()
    asked = members.where(F.col("vec_id") % every == 0)
    # As many shards as the session has partitions, but none that is very small; more where one would be too large for a task.
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = searched(nodes, asked, max(1, min(tasks, n // SMALL), -(-n * width // SHARD)), k + 1)
    # A query can see k + 1 rows of a node at most: k, and itself.
    first = written(members.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= k + 1).select(F.col("node").alias("b"), F.col("vec_id").alias("found_id")))
    order = [F.desc("sim"), "found_id"]

    def listed(found: DataFrame) -> DataFrame:
        return written(found.join(first, "b").withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(*order))).where(F.col("r") <= k + 1).select("a", "found_id", "sim"))

    lists = listed(found)
    short = written(asked.select(F.col("node").alias("a")).distinct().join(lists.groupBy("a").count(), "a", "left").where(F.coalesce("count", F.lit(0)) < min(k + 1, total)).select(F.col("a").alias("node")))
    if not short.isEmpty():
        lists = lists.join(short.select(F.col("node").alias("a")), "a", "left_anti").unionAll(listed(compared_with_all(nodes, short, k + 1)))
    # A row leaves itself out, once: of rows that repeat id and vector, the others count.
    each = asked.withColumn("row", F.monotonically_increasing_id()).join(lists, F.col("node") == F.col("a")).where("found_id != vec_id")
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("vec_id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("vec_id"), F.col("sim").alias("score"))
