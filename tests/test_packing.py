import numpy as np
import pytest
from pyspark.sql import functions as F

from talkmill.operators import packing


def one_by_one(tokens, max_rows, room):
    """The rule, row by row."""
    out, number, n, s = [], -1, max_rows, 0
    for t in tokens:
        if n >= max_rows or s + t > room:
            number, n, s = number + 1, 0, 0
        n, s = n + 1, s + t
        out.append(number)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_packing_over_many_blocks_is_as_row_by_row(spark, seed):
    r = np.random.default_rng(seed)
    # One scope holds most rows, so that it spans blocks; others are short, and one is null.
    scopes = ["hot"] * 700 + [f"s{i}" for i in r.integers(0, 40, 200)] + [None] * 30
    rows = [(s, int(i), int(t)) for (i, s), t in zip(enumerate(scopes), r.choice([0, 1, 5, 9, 30, 60, 101], len(scopes)), strict=True)]
    max_rows, most = int(r.integers(1, 9)), 110
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = packing.pack(spark.createDataFrame(rows, "scope string, at long, tokens long").withColumn("other", F.lit(1)), ["scope", "other"], "at", "tokens", max_rows, most, 10).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for s in set(scopes):
        mine = sorted(x for x in rows if x[0] == s) if s else [x for x in rows if x[0] is None]
        want |= {x[1]: n for x, n in zip(mine, one_by_one([x[2] for x in mine], max_rows, most - 10), strict=True)}
    assert {x["at"]: x["batch_no"] for x in got} == want and len(got) == len(rows)


def test_blocks_shorter_than_a_batch():
    found = [{"block": b, "begin": 0, "key": "k", "n": 1, "head": [3], "batches": [1], "rows": [1], "tokens": [3]} for b in range(7)]
    got = packing.entries(found, 3, 100)
    assert got == {1: (1, 0), 2: (1, 0), 3: (0, 0), 4: (1, 1), 5: (1, 1), 6: (0, 1)}


def test_empty_null_and_tied_rows(spark):
    schema = "scope string, at long, tokens long"
    assert packing.pack(spark.createDataFrame([], schema), ["scope"], "at", "tokens", 2, 10).count() == 0
    got = packing.pack(spark.createDataFrame([("a", 1, None), ("a", 1, -5), ("a", 1, 11)], schema), ["scope"], "at", "tokens", 5, 10).collect()
    assert sorted((x["tokens"], x["batch_no"]) for x in got) == [(0, 0), (0, 0), (11, 1)]
