"""What the operators share: scratch tables in the cluster's folder, Arrow text access and vectorised token hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step takes at once; a longer text is a step of its own.
STEP_BYTES = 256 << 10

_MULTIPLIER = 0x9E3779B97F4A7C15


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written tables: spark.checkpoint.dir. Where none is set, a local session gets a temporary one;
    a cluster has no folder that all machines see unless it names one, so there the call raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='talkmill-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Frees a job's shuffle files when it ends; a written table needs them no more.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, *, like: T.StructType | None = None, **options: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/talkmill-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(like or df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fold(ident: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % modulus


def task_count(df: DataFrame, rows: int, per_task: int) -> int:
    """Partitions for rows at per_task each, and not fewer than the session's own number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def binary(column: pa.Array | pa.ChunkedArray) -> pa.LargeBinaryArray:
    """The column as one binary array with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.cast(pa.large_binary())


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column, without a copy; a null is an empty text. Offsets begin at 0."""
    array = binary(column)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None or not len(array) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together hold about limit bytes; every row is in exactly one range."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, on an array of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Tokens of more bytes are hashed one by one.
LONG_TOKEN = 64


def hashes(body: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte strings that lie one after another, none empty: a chain of mixed 8-byte blocks, or XXH64 of a long one.

    Each block goes through the mixer with what came before it, so strings of a pattern don't collide more often than others.
    """
    blocks = (lengths + 7) >> 3
    at = np.cumsum(lengths) - lengths
    long = lengths > LONG_TOKEN
    blocks[long] = 0
    first = np.cumsum(blocks) - blocks
    padded = np.zeros(8 * int(blocks.sum()), np.uint8)
    if long.any():
        short = np.repeat(~long, lengths)
        place = np.arange(len(body)) + np.repeat(8 * first - at, lengths)
        padded[place[short]] = body[short]
    else:
        padded[np.arange(len(body)) + np.repeat(8 * first - at, lengths)] = body
    words = padded.view("<u8")
    out = lengths.astype(np.uint64) * np.uint64(_MULTIPLIER)
    alive = np.flatnonzero(blocks > 0)
    for k in range(LONG_TOKEN // 8):
        if not len(alive):
            break
        out[alive] = mix((out[alive] ^ words[first[alive] + k]) + np.uint64(_MULTIPLIER))
        alive = alive[blocks[alive] > k + 1]
    for i in np.flatnonzero(long):
        out[i] = xxhash.xxh64_intdigest(body[at[i] : at[i] + lengths[i]], 42)
    return out


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, fold_case: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, tokens before each text: len(offsets) numbers).

    classes: 256 numbers, 0 for bytes between tokens. A token is a longest run of bytes of one other class within one text.
    fold_case: 256 bytes that replace the text's, before hashing. The hash is of the token's bytes, 64 bits.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = classes[data]
    begins = np.empty(len(data), bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    runs = np.flatnonzero(begins)
    lengths = np.diff(runs, append=len(data))
    used = kind[runs] != 0
    runs, lengths = runs[used], lengths[used]
    before = np.searchsorted(runs, offsets)
    if not len(runs):
        return np.zeros(0, np.uint64), before
    body = data[kind != 0]
    return hashes(body if fold_case is None else fold_case[body], lengths), before


def table(default: int, *ranges: tuple[str | tuple[int, int], int]) -> np.ndarray:
    """256 classes: default, but for bytes in a text or from one number to another."""
    out = np.full(256, default, np.uint8)
    for what, kind in ranges:
        if isinstance(what, str):
            out[list(what.encode())] = kind
        else:
            out[what[0] : what[1] + 1] = kind
    return out


#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between ASCII white space.
SPACED = table(1, (" \t\n\v\f\r", 0))


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of their counts (1 each by default)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.diff(at, append=len(keys)) if counts is None else np.add.reduceat(counts.astype(np.int64), at)


def given_back(batches):
    """batches; when they end, memory that this worker has freed goes back to the system, as the next task's worker may be another."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not in this C library
        pass


def with_columns(df: DataFrame, source: str, fields: list[tuple[str, pa.DataType, T.DataType]], make: Callable[[], Callable[[pa.Array], list]]) -> DataFrame:
    """df and further columns, made from column source batch by batch in Arrow; columns of df with those names give way.

    make() runs once a task and returns the function from a batch's column to the new columns.
    """
    names = {n for n, _, _ in fields}
    kept = df.select(*[c for c in df.columns if c not in names or c == source])
    clash = source in names
    kinds = [pa.field(n, a) for n, a, _ in fields]

    def run(batches):
        f = make()
        for batch in given_back(batches):
            new = f(batch.column(batch.schema.get_field_index(source)))
            old = [i for i in range(batch.num_columns) if not (clash and batch.schema.field(i).name == source)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in old], *new], schema=pa.schema([*[batch.schema.field(i) for i in old], *kinds]))

    schema = T.StructType([f for f in kept.schema if not (clash and f.name == source)] + [T.StructField(n, t) for n, _, t in fields])
    return kept.mapInArrow(run, schema)
