import math

import duckdb
import pytest

from talkmill.plans.registry import ORACLES, QUERIES
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    one = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(ORACLES[name]).df())


def test_budget_is_kept_and_best(spark):
    from talkmill.operators.decisions import budget

    p = spark.createDataFrame([(1, s, m, q, c) for s in (1, 2) for m, q, c in ((1, 0.1, 1.0), (2, 0.5, 2.0), (3, 0.9, 3.0))], "sample_id int, segment_id int, model_id int, predicted_quality double, cost double")
    got = {r["segment_id"]: r["model_id"] for r in budget(p, "sample_id", 4.0).collect()}
    assert sorted(got.values()) in ([1, 3], [2, 2]) and len(got) == 2


def test_matching_is_maximum(spark):
    from talkmill.operators.routing import matching

    p = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (2, "a", "x"), (2, "b", "x")], "s int, l string, r string")
    got = matching(p, "s", "l", "r").groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {1: 2, 2: 1}


def test_depth_of_known_curve(spark):
    from talkmill.operators.ordered import depths

    curve = [0.90, 0.82, 0.20, 0.84, 0.88, 0.25, 0.86]
    d = depths(spark.createDataFrame([(1, i, s) for i, s in enumerate(curve)], "c int, i int, s double"), "c", "i", "s").orderBy("i").collect()
    assert [round(r["depth"], 6) for r in d] == [0, 0.04, 0.69, 0.02, 0, 0.62, 0]


def test_segments_cover_all_turns(spark):
    got = QUERIES["w5_w6_segments"](spark, DATA).collect()
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").count()
    assert sum(r["n_turns"] for r in got) == turns and max(r["n_turns"] for r in got) <= 8


def test_short_and_long_segments_follow_the_rule():
    from talkmill.operators.ordered import merge_short, split_long

    score = [None, 0.1, 0.9, 0.2, 0.8, 0.3, 0.5]
    ten = [10] * 7
    # Turn 3 coheres more with the right, whose part would grow to 4 turns: it stays, and does not go left instead.
    parts = [[0, 3, "start"], [3, 4, "boundary"], [4, 7, "boundary"]]
    assert merge_short([list(p) for p in parts], score, ten, 2, 0, 3) == parts
    assert merge_short([list(p) for p in parts], score, ten, 2, 0, 4) == [[0, 3, "start"], [3, 7, "merged_short"]]
    # Equal scores on both sides: the left. Enough turns but too few tokens is short too.
    assert merge_short([[0, 2, "start"], [2, 4, "boundary"], [4, 6, "boundary"]], [None, 0, 0.5, 0, 0.5, 0], [9, 9, 1, 1, 9, 9], 2, 5, 9) == [[0, 4, "merged_short"], [4, 6, "boundary"]]
    # Of equal scores the split whose sides' tokens differ least, and not the one in the middle.
    assert split_long([[0, 4, "start"]], [None, 0.2, 0.2, 0.2], [90, 10, 10, 10], 3, float("inf")) == [[0, 1, "forced_split"], [1, 4, "forced_split"]]
    assert split_long([[0, 3, "start"]], [None, 0.5, 0.4], [10, 10, 50], 9, 60) == [[0, 2, "forced_split"], [2, 3, "forced_split"]]
    assert split_long([[0, 1, "start"]], [None], [500], 9, 60) == [[0, 1, "start"]]


def test_decisions_reject_bad_predictions(spark):
    from talkmill.operators import decisions as D

    names = "segment_id int, model_id string, predicted_quality double, cost double, actual_quality double"
    for bad in ((1, "a", 0.5, 1.0, 0.5), (1, "b", 1.5, 1.0, 0.5), (1, "b", 0.5, -1.0, 0.5), (1, "b", float("nan"), 1.0, 0.5), (1, "b", 0.5, float("inf"), 0.5)):
        with pytest.raises(Exception, match="two predictions|quality outside|finite cost"):
            D.checked(spark.createDataFrame([(1, "a", 0.5, 1.0, 0.5), bad], names)).collect()
    good = spark.createDataFrame([(1, "a", 0.9, 5.0, 0.9), (1, "b", 0.85, 1.0, 0.2), (2, "a", 0.9, 5.0, 0.9), (2, "b", 0.85, 1.0, 0.9)], names)
    got = {r["segment_id"]: r for r in D.gap_decision(D.checked(good), 0.1, 0.02, 0.0, spark.createDataFrame([(2,)], "segment_id int")).collect()}
    assert got[1]["selected_model"] == "b" and got[2]["selected_model"] == "a" and got[2]["reason"] == "ood_predicted_best" and got[2]["eligible_models"] == "a"
    assert {m: round(g, 6) for m, g in got[1]["upper_bounds"].items()} == {"a": 0.02, "b": 0.07}
    with pytest.raises(Exception, match="no epsilon meets"):
        D.calibrate(good, [0.1], 0.05, 0.0, 0.0).collect()
    assert [r["chosen"] for r in D.calibrate(good, [0.1, 0.0], 0.05, 0.0, 0.0).orderBy("epsilon").collect()] == [True, False]


def test_packing_with_two_limits(spark):
    from talkmill.operators.packing import pack

    def brute(sizes, most_rows, most, base, reserve, total):
        out, n, s = [], 0, 0
        no = -1
        for t in sizes:
            alone = base + t > most
            if no < 0 or alone or n >= most_rows or base + s + t > most or base + s + t + (n + 1) * reserve > total:
                no, n, s = no + 1, 0, 0
            out.append(no)
            n, s = (most_rows, s) if alone else (n + 1, s + t)
        return out

    import random

    r = random.Random(2)
    sizes = [r.choice([5, 20, 40, 70, 130]) for _ in range(300)]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(sizes)], "scope string, at long, tokens long")
    got = [x["batch_no"] for x in pack(df, ["scope"], "at", "tokens", 4, 110, 10, reserve=15, max_total=160).orderBy("at").collect()]
    assert got == brute(sizes, 4, 110, 10, 15, 160)
    for arguments in ({"max_total": 150, "reserve": 15}, {"oversize": False}):
        with pytest.raises(Exception, match="too large for any batch"):
            pack(df, ["scope"], "at", "tokens", 4, 110, 10, **arguments).collect()
