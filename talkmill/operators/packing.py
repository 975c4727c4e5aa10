"""Packing of ordered rows into batches, in parallel over ranges of rows.

Where a batch that begins at a row ends depends on the next max_rows rows only, so a block of sorted rows can be packed for each
of the few places where the first batch of its own may begin. Two short summaries a block, put together in order, say which of
these places holds and what number its batch has; then every block numbers its rows. A scope may spread over any number of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.operators.joins import must
from talkmill.session import checkpointed

#: Rows of a block, about.
BLOCK_ROWS = 1_000_000


#: Room for tokens that has no bound.
ANY = 1 << 62


def ends(t: np.ndarray, new: np.ndarray, max_rows: int, room: int, reserve: int = 0, all_room: int = ANY) -> list[int]:
    """For each row, the row after a batch that begins there. t: tokens; new: where scopes begin; room: tokens of a batch at most;
    all_room: the same when each row also takes reserve."""
    n = len(t)
    upto = np.concatenate(([0], np.cumsum(t)))
    by_tokens = np.searchsorted(upto, upto[:-1] + room, "right") - 1
    if all_room < ANY:
        upto = upto + reserve * np.arange(n + 1)
        by_tokens = np.minimum(by_tokens, np.searchsorted(upto, upto[:-1] + all_room, "right") - 1)
    limits = np.append(new[1:], n)
    scope_end = limits[np.searchsorted(new, np.arange(n), "right") - 1]
    return np.minimum(np.minimum(np.maximum(by_tokens, np.arange(n) + 1), np.arange(n) + max_rows), scope_end).tolist()


def chain(next_: list[int], at: int, end: int) -> list[int]:
    """The rows where batches begin, from `at` on, before `end`."""
    out = []
    while at < end:
        out.append(at)
        at = next_[at]
    return out


def gathered(batches) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def beginnings(keys: pa.ChunkedArray) -> np.ndarray:
    """Where runs of one key begin."""
    k = keys.to_numpy()
    return np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))


def summaries(blocks: DataFrame, max_rows: int, room: int, reserve: int = 0, all_room: int = ANY) -> list[dict]:
    """Of each block's first and last scope: its key, rows, first tokens, and for each first place of a batch of its own the number of
    batches, and rows and tokens of the last one. Two rows a block."""

    def run(batches):
        table = gathered(batches)
        if table is None:
            return
        t, new = table.column("__t").to_numpy(), beginnings(table.column("__key"))
        next_, rows = ends(t, new, max_rows, room, reserve, all_room), []
        for begin, end in {(0, int(new[1]) if len(new) > 1 else len(t)), (int(new[-1]), len(t))}:
            found = []
            for a in range(begin, min(begin + max_rows, end)):
                starts = chain(next_, a, end)
                found.append((len(starts), end - starts[-1], int(t[starts[-1] : end].sum())))
            rows.append((table.column("__block")[0].as_py(), begin, table.column("__key")[begin].as_py(), end - begin, t[begin : min(begin + max_rows, end)].tolist(), *([f[i] for f in found] for i in range(3))))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 4), strict=True)], names=["block", "begin", "key", "n", "head", "batches", "rows", "tokens"])

    lists = "head array<long>, batches array<long>, rows array<long>, tokens array<long>"
    got = blocks.select("__block", "__key", "__t").mapInArrow(run, f"block int, begin long, key string, n long, {lists}").collect()
    return sorted((r.asDict() for r in got), key=lambda r: (r["block"], r["begin"]))


def entries(found: list[dict], max_rows: int, room: int, reserve: int = 0, all_room: int = ANY) -> dict[int, tuple[int, int]]:
    """For each block whose first scope goes on from the block before: how many of its rows the open batch takes, and that batch's number."""
    out, key, number, n, s = {}, None, -1, 0, 0
    for r in found:
        taken = 0
        if r["key"] == key and not r["begin"]:
            for t in r["head"]:
                if n >= max_rows or s + t > room or s + t + (n + 1) * reserve > all_room:
                    break
                n, s, taken = n + 1, s + t, taken + 1
            out[r["block"]] = (taken, number)
        else:
            key, number = r["key"], -1
        if taken < r["n"]:
            number, n, s = number + r["batches"][taken], r["rows"][taken], r["tokens"][taken]
    return out


def pack(rows: DataFrame, scope: list[str], order: str, tokens: str, max_rows: int, max_tokens: int, base: int = 0, reserve: int = 0, max_total: int | None = None, oversize: bool = True) -> DataFrame:
    """(scope, order, tokens, batch_no): rows in order fill a batch until the next would be one too many or too large.

    base: tokens that each batch has anyway. A batch has at most max_tokens with them, and at most max_total with the reserve of each
    row too. A row that is larger than max_tokens alone closes the open batch and is one of its own; it raises where oversize is
    false, and any row that is larger than max_total alone raises. Rows that tie in order go by tokens. Null and negative
    tokens count as 0. Sorted rows are checkpointed, so that blocks are the same in both passes.
    """
    room, all_room = max_tokens - base, ANY if max_total is None else max_total - base
    lean = rows.select(*scope, order, F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)).alias(tokens))
    most = min(all_room - reserve, ANY if oversize else room)
    if most < ANY // 2:
        lean = must(lean, F.col(tokens) <= most, "a row too large for any batch", [*scope, order])
    # A block has so many rows at most that a task can hold them, whatever the session's number of partitions.
    blocks_wanted = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lean.count() // BLOCK_ROWS))
    cut = lean.repartitionByRange(blocks_wanted, *scope, order, tokens).sortWithinPartitions(*scope, order, tokens)
    blocks = checkpointed(cut.select("*", F.to_json(F.struct(*scope)).alias("__key"), F.col(tokens).alias("__t"), F.spark_partition_id().alias("__block")))
    limits = (max_rows, room, reserve, all_room)
    known = entries(summaries(blocks, *limits), *limits)
    names = [*scope, order, tokens]

    def number(batches):
        table = gathered(batches)
        if table is None:
            return
        t, new = table.column("__t").to_numpy(), beginnings(table.column("__key"))
        taken, before = known.get(table.column("__block")[0].as_py(), (0, -1))
        begins = np.zeros(len(t), np.int64)
        begins[chain(ends(t, new, *limits), taken, len(t))] = 1
        total = np.cumsum(begins)
        less = total[new] - begins[new]
        less[0] = -before - 1
        # Numbers start from 0 in each scope, and go on from the block before in the first.
        no = total - 1 - np.repeat(less, np.diff(np.append(new, len(t))))
        for batch in table.select(names).append_column("batch_no", pa.array(no)).to_batches(max_chunksize=10_000):
            yield batch

    return blocks.mapInArrow(number, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lean.schema) + ", batch_no long")
