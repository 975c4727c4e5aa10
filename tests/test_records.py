import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from talkmill.functions import records as P
from talkmill.functions import text as X
from talkmill.operators import audits as A
from talkmill.operators import evaluation as E
from talkmill.operators import joins as J
from talkmill.sources import stores as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_concepts(spark):
    words = "running stories planning tried needed boxes models class status a.i. GPT stopped".split()
    assert value(spark, X.concepts(F.array(*map(F.lit, words)))) == ["run", "story", "plan", "try", "need", "box", "language_model", "class", "status", "a.i", "language_model", "stopp"]


def test_idea_units(spark):
    assert value(spark, X.idea_units(F.lit("Robots build large walls. Cats; red house"))) == ["cat::exists", "red::rel::house", "robot::build::large", "robot::build::wall"]
    assert value(spark, X.idea_units(F.lit("build"))) == ["implicit::build::implicit"]
    assert value(spark, X.idea_units(F.lit(None).cast("string"))) == []


def test_preferences_and_events(spark):
    assert value(spark, X.preferences(F.lit("I Prefer tea. No? none; 喜欢 x"))) == ["I Prefer tea. No", "喜欢 x"]
    assert value(spark, X.event_clauses(F.lit("hello there"))) == ["hello there"] and value(spark, X.event_clauses(F.lit(" "))) == []


def test_prompts_and_lines(spark):
    seg = F.array(F.struct(F.lit("s1").alias("segment_id"), F.lit("t").alias("text"), F.array(F.lit(1), F.lit(2)).alias("ids")))
    assert value(spark, P.constrained_prompt(seg)) == 'Required processed_segment_ids in exact output order: ["s1"]\n\n--- Topic s1 ---\nAllowed source_ids for this topic only: [1, 2]\nt'
    assert value(spark, P.visible_ids(F.lit("[d, Mon] 3.A: x\nno\n[d] 3.A: y\n[d] 7.B: z"))) == [3, 7]
    assert value(spark, P.filled('{"a": {x}}', {"x": F.lit("{y}")})) == '{"a": {y}}'
    assert [value(spark, P.mentions(F.lit(t), F.lit("Ann"))) for t in ("ANN said", "Anna said", "", "x.ann")] == [True, False, False, True]


def test_checked_joins(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 5), (3, 6)], "k int, v int")
    for bad in (J.exact(a, b, ["k"], "x"), J.covered(a, b, ["k"], "x"), J.unique(a.union(a), ["k"], "x")):
        with pytest.raises(Exception, match="x"):
            bad.count()
    assert J.covered(a.where("k = 1"), b, ["k"], "x").collect()[0]["v"] == 5
    usage = spark.createDataFrame([("small", 1_000_000, 2_000_000)], "tier string, input_tokens long, output_tokens long")
    assert J.priced(usage, {"small": (0.5, 1.0)}).first()["cost"] == 2.5
    with pytest.raises(Exception, match="no price"):
        J.priced(usage, {"large": (0.5, 1.0)}).collect()
    s = spark.createDataFrame([(1, 1, "a\nb\n \n"), (1, 2, "c"), (2, 3, "d")], "session int, o int, text string")
    assert [r["preceding"] for r in J.preceding(s, ["session"], "o", "text").orderBy("o").collect()] == ["", "b", ""]
    m = spark.createDataFrame([("p", 1), ("q", 1), ("q", 2), ("r", 2), ("p", 2)], "part string, item int")
    assert sorted(map(tuple, J.shared(m, "part", "item").collect())) == [("p", "q", 2), ("p", "r", 1), ("q", "r", 1)]


def test_prune_dense(spark):
    dice = random.Random(5)
    rows = [(c, t, dice.randrange(4) / 4) for c in range(40) for t in sorted(dice.sample(range(30), 9))]
    want = []
    for c in range(40):
        kept = []
        for _, t, d in (r for r in rows if r[0] == c):
            if kept and t - kept[-1][1] < 4:
                kept = [*kept[:-1], (c, t, d)] if d > kept[-1][2] else kept
            else:
                kept.append((c, t, d))
        want += kept
    got = E.prune_dense(spark.createDataFrame(rows, "c int, t int, d double"), "c", "t", "d", 4).collect()
    assert sorted(map(tuple, got)) == want


def test_grid_and_normalized_cost(spark):
    assert E.grid(0, 0.3, 0.1) == [0.0, 0.1, 0.2, 0.3]
    assert abs(value(spark, E.normalized_cost(F.lit(3.0), F.lit(1.0), F.lit(3.0))) - 1) < 1e-9
    with pytest.raises(Exception, match="not above"):
        value(spark, E.normalized_cost(F.lit(1.0), F.lit(1.0), F.lit(1.0)))


def test_kept_questions(spark):
    q = spark.createDataFrame([(1, "a"), (1, "x"), (2, None)], "s int, c string")
    assert sorted(map(tuple, E.kept_questions(q, "s", "c", ["x"]).collect())) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="no question left"):
        E.kept_questions(q, "s", "c", ["a", "x"]).count()


def test_review(spark):
    facts = spark.createDataFrame([(1, "a", "one", [1], 1), (1, "b", "two long", [2], 2), (1, "c", "three", [3], 3), (1, "d", "four", [4], 4), (2, "a", "old", [1], 1), (3, "a", "as is", [1], 1)], "segment_id int, fact_id string, text string, sources array<int>, rank int")
    schema = "segment_id int, decision string, fact_ids array<string>, text string, sources array<int>"
    d = spark.createDataFrame([(1, "MERGE", ["a", "b"], None, None), (1, "REJECT", ["c"], None, None), (1, "REVISE", ["d"], "4", None), (1, "MISSING_FACTS", [], "new", [9]), (2, "REPLACE_LOW_VALUE", [], "better", [2])], schema)
    got = A.apply_review(facts, d).orderBy("segment_id", "rank").collect()
    assert [tuple(r) for r in got] == [(1, "two long", [1, 2], 1), (1, "4", [4], 2), (1, "new", [9], 3), (2, "better", [2], 1), (3, "as is", [1], 1)]
    with pytest.raises(Exception, match="review"):
        A.apply_review(facts, spark.createDataFrame([(1, "TRUNCATION_LOSS", ["a"], None, None)], schema)).collect()


def test_chunks(spark):
    for n, want in ((0, 1), (4, 1), (5, 2), (9, 4)):
        got = value(spark, A.chunks(F.expr(f"slice(sequence(1, 99), 1, {n})"), 4, 2))
        assert len(got) == want and sorted({x for c in got for x in c}) == list(range(1, n + 1))


def test_scan_and_segments(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.jsonl").write_text("\n".join(json.dumps(x) for x in ({"k": 1, "cost": 2.0}, {"other": 1}, {"k": 2, "cost": 3.0})))
    schema = "k int, cost double, other int"
    assert S.scan(spark, str(tmp_path / "in"), schema, ["k"], ["k"], {"cost": F.col("cost") >= 0}).count() == 2
    with pytest.raises(Exception, match="too dear"):
        S.scan(spark, str(tmp_path / "in"), schema, ["k"], ["k"], {"too dear": F.col("cost") < 3}).count()
    made = S.write_segments(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "sample_id int, text string"), str(tmp_path / "out"), {"method": "depth"}).first()
    assert (made["segments"], made["samples"], made["method"]) == (3, 2, "depth")
    assert S.ood_flags(spark.createDataFrame([(True,), (None,)], "is_ood boolean")).where("ood").count() == 1
    assert S.report(spark.range(1), "T", 5) == "# T\n\n| id |\n| --- |\n| 0 |\n"


def test_worksheet(spark, tmp_path):
    book = '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>'
    cells = '<worksheet xmlns="m"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AA1" t="inlineStr"><is><t>b</t></is></c></row><row/><row><c r="A2"><v>1.5</v></c><c r="AA2" t="b"><v>1</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", book)
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="rId1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>a</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", cells)
    got = S.worksheet(spark, str(tmp_path / "x.xlsx"), "S", ["b", "a"]).collect()
    assert [tuple(r) for r in got] == [("true", "1.5")]


def test_running_sums_in_ranges(spark):
    import numpy as np

    from talkmill.operators.aggregates import consistency, running

    r = np.random.default_rng(1)
    for values in (r.integers(0, 30, 300).astype(float), r.normal(size=300) * 10.0 ** r.integers(-6, 6, 300), np.full(50, 3.0)):
        rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        got = {x["v"]: (x["n"], x["upto"]) for x in running(rows, "v").collect()}
        assert got == {v: ((values == v).sum(), (values <= v).sum()) for v in set(values.tolist())}
    none = spark.createDataFrame([], "x double, y double")
    assert running(none, "x").count() == 0 and tuple(consistency(none, "x", "y").first()) == (0.0, 0.0)
