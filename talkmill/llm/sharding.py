"""Minimax contiguous partition of ordered atomic groups into shards, in DataFrame operations only.

Groups of equal texts are laid out one after another, so each begins at the sum of the sizes before it. The smallest feasible
capacity is found by binary search; a capacity is checked greedily: from where a shard begins, the furthest group beginning
that is within the capacity begins the next. The driver holds only cells: stretches of that line with the first and the last
beginning in each. They tell most steps exactly; where a step falls between, the capacity is bounded from both sides, and the
cells in question are split by one more job until all steps are exact. So the line itself never leaves the executors.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talkmill.llm.common import written

CELLS = 1 << 12
#: Rows of one text are numbered in so many parts, by a hash of their id.
PARTS = 64
#: Groups that share one of the line's buckets, about.
BUCKET_GROUPS = 200_000


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, group): size is the text's UTF-8 bytes (none for null) plus 16; group tells texts apart.

    The null text is a group of its own, apart from the empty one; its text_crc32 is that of the empty text.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.coalesce(F.sha2("text", 256), F.lit("00"))).alias("group"))


def line(rows: DataFrame) -> DataFrame:
    """(group, weight, n, begin): the groups of rows in order of their hash; begin is the weight of all before."""
    groups = written(rows.groupBy("group").agg(F.sum("size").alias("weight"), F.count("*").alias("n")))
    bits = max(6, (groups.count() // BUCKET_GROUPS).bit_length() + 1)
    groups = groups.withColumn("bucket", F.shiftrightunsigned(F.xxhash64("group"), 64 - bits))
    # One row a bucket: few, as their number follows from BUCKET_GROUPS.
    sums = groups.groupBy("bucket").agg(F.sum("weight").alias("all")).withColumn("base", F.sum("all").over(W.orderBy("bucket")) - F.col("all"))
    within = F.sum("weight").over(W.partitionBy("bucket").orderBy("group").rowsBetween(W.unboundedPreceding, -1))
    return written(groups.join(F.broadcast(sums.select("bucket", "base")), "bucket").select("group", "weight", "n", (F.col("base") + F.coalesce(within, F.lit(0))).alias("begin")))


class Cells:
    """Stretches of the line, in order: where each begins, its first and last group beginning, and how many there are."""

    def __init__(self, total: int):
        self.total = total
        self.cells: dict[int, tuple[int, int, int, int]] = {}
        self.order: list[int] = []

    def put(self, cells: list[tuple[int, int, int, int, int]], drop: set[int] = frozenset()) -> None:
        """cells: (begin, width, first, last, n)."""
        for at in drop:
            del self.cells[at]
        self.cells.update({c[0]: c[1:] for c in cells})
        self.order = sorted(self.cells)

    def before(self, target: int) -> tuple[int, int, int | None]:
        """(least, most, cell) that the last beginning at or before target can be; cell is None if both are exact."""
        if target >= self.total:
            return self.total, self.total, None
        i = bisect_right(self.order, target) - 1
        while True:
            _, first, last, n = self.cells[self.order[i]]
            if target >= last:
                return last, last, None
            if target < first:
                i -= 1
                continue
            if n <= 2:
                return first, first, None
            return first, min(target, last), self.order[i]

    def reach(self, capacity: int, shards: int) -> tuple[bool, bool, set[int]]:
        """Whether shards of the capacity surely hold all, whether they may, and the cells that leave it open."""
        low = high = 0
        unsure: set[int] = set()
        for _ in range(shards):
            least, _, a = self.before(low + capacity)
            _, most, b = self.before(high + capacity)
            unsure |= {x for x in (a, b) if x is not None}
            low, high = max(low, least), max(high, most)
        return low >= self.total, high >= self.total, unsure


def split(groups: DataFrame, cells: Cells, at: set[int] | None) -> None:
    """Splits the cells at (all of the line if None) by one job."""
    if at is None:
        width = max(1, -(-cells.total // CELLS))
        cut, old = groups.withColumn("cell", (F.floor(F.col("begin") / width) * width).cast("long")).withColumn("width", F.lit(width).cast("long")), set()
    else:
        spark = groups.sparkSession
        parts = max(2, CELLS // len(at))
        rows = [(c, c + cells.cells[c][0], max(1, -(-cells.cells[c][0] // parts))) for c in sorted(at)]
        some = F.broadcast(spark.createDataFrame(rows, "low long, high long, width long"))
        cut = groups.join(some, (F.col("begin") >= F.col("low")) & (F.col("begin") < F.col("high"))).withColumn("cell", (F.col("low") + F.floor((F.col("begin") - F.col("low")) / F.col("width")) * F.col("width")).cast("long"))
        old = at
    got = cut.groupBy("cell", "width").agg(F.min("begin").alias("first"), F.max("begin").alias("last"), F.count("*").alias("n")).collect()
    cells.put([(r["cell"], r["width"], r["first"], r["last"], r["n"]) for r in got], old)


def cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(smallest feasible capacity, where shards begin on the line). groups: weight, begin. All weights are above 0."""
    total, largest = groups.agg(F.sum("weight"), F.max("weight")).first()
    if not total:
        return 0, [0]
    cells = Cells(total)
    split(groups, cells, None)
    low, high = max(largest, -(-total // shards)), max(largest, -(-total // shards)) + largest
    while low < high:
        middle = (low + high) // 2
        surely, maybe, unsure = cells.reach(middle, shards)
        if surely:
            high = middle
        elif not maybe:
            low = middle + 1
        else:
            split(groups, cells, unsure)
    begins = [0]
    while begins[-1] < total:
        least, _, unsure = cells.before(begins[-1] + low)
        if unsure is None:
            begins.append(least)
        else:
            split(groups, cells, {unsure})
    return low, begins[:-1]


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot and grown_shard (null) of every row of docs (doc_id, text).

    Equal texts share a shard: the largest shard is as small as contiguous shards of whole groups can be, so it is at least
    the largest group. Null and empty texts have size 16 and are a group each. Repeated rows get slots of their own. With
    few groups the last shards are empty; an empty table gives no rows.
    """
    rows = written(digests(docs))
    groups = line(rows)
    _, begins = cuts(groups, shards)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    number = F.lit(-1)
    for b in begins:  # one a shard
        number = number + (F.col("begin") >= b).cast("int")
    placed = groups.select("group", "n", number.alias("shard"), F.shiftrightunsigned(F.xxhash64("group"), 54).alias("bucket"))
    # A slot is: rows of the shard's earlier buckets, of the bucket's earlier groups, of the group's earlier parts, and in the part.
    per_bucket = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("all"))
    per_bucket = per_bucket.select("shard", "bucket", (F.sum("all").over(W.partitionBy("shard").orderBy("bucket")) - F.col("all")).alias("base"))
    group_slot = F.coalesce(F.sum("n").over(W.partitionBy("shard", "bucket").orderBy("group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = placed.join(F.broadcast(per_bucket), ["shard", "bucket"]).select("group", "shard", (F.col("base") + group_slot).alias("group_slot"))
    parted = rows.withColumn("part", part)
    per_part = parted.groupBy("group", "part").agg(F.count("*").alias("all"))
    per_part = per_part.select("group", "part", (F.sum("all").over(W.partitionBy("group").orderBy("part")) - F.col("all")).alias("part_slot"))
    offsets = per_part.join(placed, "group").select("group", "part", "shard", (F.col("group_slot") + F.col("part_slot")).alias("base"))
    numbered = parted.withColumn("at", F.row_number().over(W.partitionBy("group", "part").orderBy("doc_id")) - 1)
    return numbered.join(offsets, ["group", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
