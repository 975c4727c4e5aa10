import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from talkmill.llm import ann, decontaminate, html_extract, language_id, lm_score, pieces, quality, sharding, simhash_dedup, url_filter
from talkmill.llm.queries import QUERIES, RULES
from tests.conftest import DATA

LONG = "word " * 40_000
#: Nulls in any column, empty, wordless, very long, repeated and tied rows; extra columns whose names operators use themselves.
ODD = [(1, None, "en", "s"), (2, "", "en", None), (3, "  \n ", None, "s"), (4, LONG, "en", "s"), (5, "the same text is here twice", "en", "s"), (5, "the same text is here twice", "en", "s"), (6, "the same text is here twice", "de", "s"), (None, "no id at all", "de", "s"), (7, "日本語の文", "ja", "s"), (8, "12 !! 34", "en", "s"), (9, "x", "de", "s")]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ["score", "fp", "n_words", "token_ids", "log_weight", "lang_pred", "size", "group", "row", "key"]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit("mine").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language(docs, odd, none):
    got = language_id.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 20 and (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    rows = {r["doc_id"]: r for r in language_id.predict(odd).collect()}
    assert language_id.predict(odd).count() == len(ODD)
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 3, 8)) and rows[7]["lang_pred"] != "und"
    assert language_id.predict(none).count() == 0


def fingerprint(text):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    fps = np.array(fps, np.uint64)
    u, v = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)
    label = simhash_dedup.roots(len(fps), u, v)
    least = {}
    for i, root in zip(ids, label, strict=True):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    return [least.get(r) for r in label]


def test_simhash(docs, odd, none):
    for d in (docs, odd):
        texts = d.select("doc_id", "text").collect()
        want = collections.Counter(zip([r[0] for r in texts], [f"{fingerprint(r[1]):016x}" for r in texts], brute_components([r[0] for r in texts], [fingerprint(r[1]) for r in texts]), strict=True))
        assert collections.Counter(map(tuple, simhash_dedup.near_duplicates(d).collect())) == want
    assert simhash_dedup.near_duplicates(none).count() == 0


def jaccard_groups(texts):
    """The partition of texts by links of 5-word Jaccard similarity 0.8 or more, by brute force."""
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    u, v = np.array(near, np.int64).reshape(-1, 2).T
    return simhash_dedup.roots(len(sets), u, v)


def test_near_copies_are_all_pairs_of_the_similarity(spark, docs, odd, monkeypatch):
    import corpus_pipeline
    from talkmill.llm import near_copies

    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(400)])
    made = []
    for n in (3, 12, 30, 60, 200, 500):
        base = rng.choice(words, n).tolist()
        for _ in range(12):
            edited = list(base)
            for _ in range(int(rng.integers(0, 2 + n // 25))):
                edited[int(rng.integers(0, n))] = str(rng.integers(1 << 40))
            made.append(" ".join(edited))
    edits = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for block, often in ((near_copies.BLOCK, near_copies.OFTEN), (3, 2)):  # whole groups, then groups in parts
        monkeypatch.setattr(near_copies, "BLOCK", block)
        monkeypatch.setattr(near_copies, "OFTEN", often)
        for d in (edits, docs, odd) if block > 3 else (edits,):
            rows = near_copies.with_components(d.select("doc_id", "text")).collect()
            want, mine = jaccard_groups([r["text"] for r in rows]), [r["component"] for r in rows]
            assert len(rows) == d.count() and len(set(zip(want.tolist(), mine, strict=True))) == len(set(mine)) == len(set(want.tolist()))
    want = jaccard_groups(made)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, edits, DATA).collect()} == set(want.tolist()) != set(range(len(made)))
    fps = [fingerprint(t) for t in made]
    assert len(set(brute_components(list(range(len(made))), fps))) > len(set(want.tolist()))  # the distance of op3 misses some


def test_near_copies_meet_by_simhash_first(spark, docs, monkeypatch):
    """The stage's first candidates come from fingerprints of the shingle sets and the trie join; the rest from the exact join."""
    import pyarrow as pa

    import corpus_pipeline
    from talkmill.llm import near_copies

    texts = [r["text"] for r in docs.select("text").limit(60).collect()] + [None, "", "a b c", " ".join(f"w{i % 997}" for i in range(200_000))]
    prints = near_copies.with_nodes(spark.createDataFrame([(t,) for t in texts], "text string")).select("text", "fp", "n").collect()
    for r in prints:
        h, edge = near_copies.shingles(*near_copies.raw(pa.array([r["text"]], pa.string())))
        want = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
        assert r["fp"] % (1 << 64) == want and r["n"] == len(h) == edge[-1]

    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 40, np.uint64).tolist()
    fps = sorted({b ^ sum(1 << int(x) for x in rng.integers(0, 64, rng.integers(0, 6))) for b in base for _ in range(20)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = {(r["u"], r["v"]) for r in simhash_dedup.direct_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4).collect()}
    within = {u: [v for v in signed if v < u and ((u ^ v) & (2**64 - 1)).bit_count() <= 4] for u in signed}
    assert all(v in within[u] for u, v in links) and {(u, min(v)) for u, v in within.items() if v} <= links

    words = [f"w{i}" for i in rng.integers(0, 1000, 400)]
    copies = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in range(0, 400, 40)] + [" ".join(words[::-1])]
    met = []
    keep = near_copies.by_simhash
    monkeypatch.setattr(near_copies, "by_simhash", lambda d: met.append((out := keep(d)).count()) or out)
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string"), DATA)
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 10] and met[0] > 0


def test_trie_join_finds_all_pairs_of_dense_and_split_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, np.uint64)
    fps = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(40):
            fps.add(b ^ sum(1 << int(x) for x in rng.integers(0, 64, rng.integers(1, 7))))
    fps = sorted(fps)
    rows = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    want = brute_components(list(range(len(fps))), fps)
    for limit in (100_000, 15):  # whole tries, then tries that are dealt again
        monkeypatch.setattr(simhash_dedup, "BLOCK_ROWS", limit)
        if limit == 15:
            dealt = simhash_dedup.tries(rows, 4).groupBy("mask", "shared").count().toPandas()
            assert dealt["count"].max() <= limit and dealt["mask"].nunique() > 5
        roots = {r["node"]: r["root"] for r in simhash_dedup.components(simhash_dedup.near_links(rows, 4)).collect()}
        mine = [roots.get(int(np.uint64(f).astype(np.int64)), int(np.uint64(f).astype(np.int64))) for f in fps]
        pairs = lambda labels: {tuple(sorted(i for i, x in enumerate(labels) if x == y)) for y in set(labels)}
        assert pairs(mine) == pairs(want)


def test_fingerprints_of_long_texts_come_in_steps(monkeypatch):
    text = " ".join(f"Word{i % 97}\t{i % 31}" for i in range(3000)).encode()
    want = fingerprint(text.decode())
    for size in (7, 100, 1 << 20):
        monkeypatch.setattr(simhash_dedup, "TEXT_STEP", size)
        assert simhash_dedup.fingerprint(text) == want
        assert simhash_dedup.fingerprint(b"one two") == fingerprint("one two") and simhash_dedup.fingerprint(b"  ") == 0


def word_hash(word):
    """The hash of a word, byte by byte in plain numbers."""
    import xxhash

    full = 2**64 - 1

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & full
        return x ^ x >> 31

    if len(word) > 64:
        return xxhash.xxh64_intdigest(word, 42)
    h = len(word) * 0x9E3779B97F4A7C15 & full
    for k in range(0, len(word), 8):
        h = mix(((h ^ int.from_bytes(word[k : k + 8], "little")) + 0x9E3779B97F4A7C15) & full)
    return h


def brute_buckets(text):
    full = 2**64 - 1
    words = [word_hash(w) for w in re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^\x00-\x20\x7f0-9A-Za-z_\x80-\xff]+", (text or "").encode())]
    pairs = [(1 if a == b else (b + 3 * a) & full) * 0x9E3779B97F4A7C15 & full for a, b in zip(words, words[1:], strict=False)]
    return [x >> 50 for x in (*words, *pairs)]


def test_quality(spark, docs, odd, none):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    texts, mark = docs.select("doc_id", "text").collect(), {r["doc_id"]: r["quality"] for r in labels.collect()}
    sums = np.full((2, quality.BUCKETS), 0.5)
    for i, t in texts:
        b = np.bincount(brute_buckets(t), minlength=quality.BUCKETS)
        sums[0] += b
        if mark.get(i) == 1:
            sums[1] += b
    ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    assert np.allclose(quality.fit(docs, labels), ratio)
    rows = quality.resample(docs, labels).collect()
    for r in rows:
        b = brute_buckets(r["text"])
        assert r["log_weight"] is None if not b else math.isclose(r["log_weight"], ratio[b].sum() * min(1, quality.STRETCH / len(b)), abs_tol=1e-9)
    good, bad = ([r["selected"] for r in rows if mark.get(r["doc_id"]) == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2
    got = quality.resample(odd, labels)
    assert got.count() == len(ODD) and quality.resample(none, labels).count() == 0 and quality.resample(docs, labels, k=7).where("selected").count() == 7
    assert got.where("selected and (text is null or trim(text) = '') ").count() == 0
    assert {r["doc_id"] for r in got.where("not selected").select("doc_id").collect()} >= {1, 2, 3}
    assert quality.resample(docs, labels.limit(0)).where("selected").count() == docs.count() == quality.resample(docs, labels.withColumn("quality", F.lit(1))).where("selected").count()
    assert quality.resample(docs, labels.withColumn("quality", F.lit(None).cast("int"))).where("not selected").count() == 0


def test_the_draw_follows_the_weights(spark):
    """How often a text is drawn first is its share of all weights (Plackett and Luce's rule), and not 1 for the best."""
    ratio = np.zeros(quality.BUCKETS)
    words = ["alpha", "beta", "gamma", "delta"]
    want = np.array([0.4, 0.3, 0.2, 0.1])
    for w, p in zip(words, want, strict=True):
        ratio[brute_buckets(w)] = math.log(p)
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string").coalesce(1)
    from pyspark.sql import functions as F

    many = docs.join(spark.range(4000).select(F.col("id").alias("seed")))
    rows = quality.with_keys(many.withColumn("twin", F.col("seed") * 10 + F.col("doc_id")), ratio, "twin", "text").collect()
    draws = collections.defaultdict(dict)
    for r in rows:
        draws[r["seed"]][r["doc_id"]] = r["gumbel_key"]
    first = np.bincount([max(d, key=d.get) for d in draws.values()], minlength=4) / len(draws)
    assert np.abs(first - want).max() < 0.03


def test_threshold_is_the_kth(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=500), np.full(300, 0.25), rng.normal(size=200) * 1e-9])
    df = spark.createDataFrame([(float(v),) for v in values], "k double")
    for k in (1, 7, 400, 600, 999):
        assert quality.threshold(df, "k", k, bins=16) == np.sort(values)[::-1][k - 1]


def test_main_text(spark):
    held = html_extract.labelled_pages(150, 77)
    model, wrong, n = html_extract.fit(html_extract.labelled_pages()), 0, 0
    for page, main in held:
        found = html_extract.blocks(page)
        for b, keep in zip(found, model.decode(found), strict=True):
            wrong, n = wrong + (keep != (b.text in set(main))), n + 1
    assert wrong / n < 0.02
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<article><p>a&amp;b \n c<p>d<br>e", "x"), (3, "u", "<article><p>a&amp;b \n c<p>d<br>e", "x"), (4, "u", "<nav><a href=x>menu</a></nav><article><p>t<a>x</a>y</p></article><footer>&copy; z</footer>", "x"), (5, "u", "<" * 5000 + "<div " + "a" * 100_000, "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()}
    assert got[1] == got[2] == ("", 0) and got[3] == ("a&b c d e", 9) and got[4] == ("txy", 3)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_field_against_brute_force():
    """Viterbi's labels have the largest score of all labellings, and path sums equal those over written-out paths."""
    import itertools

    model = html_extract.fit(html_extract.labelled_pages(40))
    for page, _ in html_extract.labelled_pages(25, 9):
        found = html_extract.blocks(page)[:9]
        scores = [sum(model.weights.get(f, 0.0) for f in [*html_extract.path_features(b.element), *html_extract.text_features(b)]) for b in found]

        def total(labels, scores=scores):
            return model.first[labels[0]] + sum(s for s, x in zip(scores, labels, strict=True) if x) + sum(model.between[a, b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(map(total, itertools.product((0, 1), repeat=len(found))))
        assert math.isclose(total([int(x) for x in model.decode(found)]), best, abs_tol=1e-9)


def test_hostile_pages_take_linear_time():
    import time
    import tracemalloc

    model = html_extract.fit(html_extract.labelled_pages(20), rounds=5)
    for page in ("<div>x" * 50_000, "<a " * 100_000 + ">", '<a ">' * 50_001, "<!--" * 50_000, "<li><ul>" + "<b>" * 50_000 + "<li></li>x" * 50_000, "<table>" + "<td><b>x" * 50_000):
        began = time.time()
        tracemalloc.start()
        model.decode(html_extract.blocks(page))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert time.time() - began < 20 and peak < 100 << 20
    (one,) = html_extract.blocks('<div data-id="comment" data-grid=nav title="x class=ad">t</div>')
    assert not any(f.startswith("named") for f in html_extract.path_features(one.element))
    (one,) = html_extract.blocks('<div title=a CLASS = "Big-ad" id=x1>t')
    assert {"named big", "named ad", "named x"} <= set(html_extract.path_features(one.element))




def test_url_filter(spark):
    from pyspark.sql import functions as F

    model = url_filter.UrlFilter.fit(url_filter.seed_urls(spark))
    urls = [None, "", "nothing", "http://a.NET", "http://a.net/x", "https://m.example.net/en/1", "http://example.com/de/", "http://x.org/fr/2?q", "http://spam-casino.example.com/en/3", "http://river.example.com/en/4", "http://river.example.com/en/4", "http://" + "a" * 300_000 + "/" + "b" * 300_000]
    got = url_filter.judge(spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string"), model, RULES).orderBy("page_id").collect()
    assert [(r["host"], r["path"]) for r in got[:5]] == [("", ""), ("", ""), ("", ""), ("a.net", ""), ("a.net", "/x")]
    assert [r["rule"] for r in got[:11]] == [None, None, None, None, "net/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None]
    assert [r["verdict"] for r in got[4:11]] == ["block", "allow", "block", "allow", "block", "allow", "allow"] and len(got) == len(urls)
    held = url_filter.seed_urls(spark, 3000, 99).withColumn("page_id", F.monotonically_increasing_id())

    def right(urls):
        judged = url_filter.judge(urls, model, []).join(urls.select("page_id", "blocked"), "page_id")
        return judged.agg(F.avg(((F.col("score") > 0).cast("int") == F.col("blocked")).cast("double"))).first()[0]

    assert right(held) > 0.9 and right(held.withColumn("url", F.replace("url", F.lit("-"), F.lit("")))) > 0.85  # no one trait decides
    host, path, query = url_filter.parts(F.col("url"))
    rows = url_filter.lexical(held.select("page_id", host.alias("h"), path.alias("p"), query.alias("q")), "h", "p", "q", model.rates, model.ends, model.usual)
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=[f"__{x}" for x in url_filter.FEATURES], outputCol="features").transform(rows.withColumn("mine", model.score()))
    assert model.model.transform(vectors).where((F.col("prediction") == 1) != (F.col("mine") > 0)).count() == 0
    assert sum(x > 0.01 for x in model.model.featureImportances) >= 7
    for rows, verdict in (([], "allow"), ([("http://a.b", 0), (None, None)], "allow"), ([("http://a.b", 1)], "block")):
        one = url_filter.UrlFilter.fit(spark.createDataFrame(rows, "url string, blocked int"))
        assert {r["verdict"] for r in url_filter.judge(held, one, []).collect()} == {verdict}
    assert url_filter.judge(held.limit(0), model, RULES).count() == 0


def test_sharding(docs, odd, none):
    for d, shards in ((docs, 40), (odd, 3)):
        got = sharding.shard(d, shards).toPandas()
        assert len(got) == d.count() and (got["shard"] < shards).all()
        assert (got.groupby("shard").slot.agg(["min", "max", "nunique", "count"]).apply(lambda r: r["min"] == 0 and r["max"] + 1 == r["nunique"] == r["count"], axis=1)).all()
        weights = sharding.line(sharding.digests(d)).orderBy("begin").toPandas().weight.tolist()

        def fits(capacity, weights=weights, shards=shards):
            used, room = 1, capacity
            for w in weights:
                if w > capacity:
                    return False
                if w > room:
                    used, room = used + 1, capacity
                room -= w
            return used <= shards

        assert fits(got.groupby("shard")["size"].sum().max()) and not fits(got.groupby("shard")["size"].sum().max() - 1)
    assert sharding.shard(none).count() == 0


def recall_of(got, ids, m, every, k=20):
    """(share of the k nearest by brute force that were found, rows of each query)."""
    hits = n = 0
    for q in np.flatnonzero(ids % every == 0):
        s = m @ m[q]
        s[q] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:k]].tolist())
        hits, n = hits + len(want & got[ids[q]]), n + len(want)
    return hits / n


def test_nearest(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    ids, m = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    found = QUERIES["op7_nearest_neighbours"](spark, DATA).toPandas()
    assert recall_of(found.groupby("query_id").vec_id.apply(set), ids, m, 20) >= 0.9
    place = {int(i): k for k, i in enumerate(ids)}
    assert all(math.isclose(r.score, float(m[place[r.query_id]] @ m[place[r.vec_id]]), rel_tol=1e-12, abs_tol=1e-12) for r in found.head(500).itertuples())
    odd = [(20, [1.0, 0.0]), (40, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.5, 0.5]), (7, [1.0]), (None, [1.0, 1.0]), (60, [2.0]), (8, [])]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 1.0), (20, 2, 40, 1.0), (20, 3, 6, 0.5), (40, 1, 1, 1.0), (40, 2, 20, 1.0), (40, 3, 6, 0.5), (60, 1, 7, 2.0)]
    assert ann.nearest(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, ann.nearest(twice).collect())) == [(20, 1, 3, 1.0), (20, 1, 3, 1.0), (20, 2, 3, 1.0), (20, 2, 3, 1.0)]


def test_the_graph_is_searched_beyond_its_runs(spark, monkeypatch):
    """With runs of 32 nodes the first graph is poor; descent and search find what it lacks."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=(3000, 24)) @ rng.normal(size=(24, 24)) / 5 + 0.3
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "RUN", 32)
    monkeypatch.setattr(ann, "BLOCK", 100)
    found = ann.nearest(df).toPandas()
    assert (found.groupby("query_id").size() == 20).all() and found.query_id.nunique() == 150
    assert recall_of(found.groupby("query_id").vec_id.apply(set), np.arange(3000), m, 20) >= 0.9


def test_shards_are_searched_with_rows_of_whole_lists(spark, monkeypatch):
    """Several shards together find what one graph would, and tasks exchange nodes, queries and lists: the old joins wrote a row for each entry."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(6000, 32))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    rows = []
    keep = ann.written
    monkeypatch.setattr(ann, "written", lambda d: rows.append((out := keep(d)).count()) or out)
    found = ann.nearest(df).toPandas()
    assert (found.groupby("query_id").size() == 20).all() and found.query_id.nunique() == 300
    assert recall_of(found.groupby("query_id").vec_id.apply(set), np.arange(6000), m, 20) >= 0.9
    assert max(rows) <= 300 * 22 + 6000


def test_a_search_gives_each_node_once():
    x = np.random.default_rng(6).normal(size=(500, 8)).astype(np.float32)
    ids, sims = ann.search(x, ann.build(x, 10, 64, 64), x[:50], 30)
    assert all(len(set(r.tolist())) == 30 for r in ids) and np.allclose(sims, np.take_along_axis(x[:50] @ x.T, ids, 1), atol=1e-5)
    ids, _ = ann.search(x[:3], ann.build(x[:3], 10, 64, 64), x[:1], 30)
    assert sorted(ids[0].tolist())[-3:] == [0, 1, 2] and (ids[0] == -1).sum() == 27


def test_short_queries_meet_all_nodes(spark, monkeypatch):
    """Where the graph gives too few, queries are compared with all, pass by pass."""
    rng = np.random.default_rng(9)
    m = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "DEGREE", 2)
    monkeypatch.setattr(ann, "BEAM", 3)
    monkeypatch.setattr(ann, "PASS", 4)
    found = ann.nearest(df).toPandas()
    assert (found.groupby("query_id").size() == 20).all() and recall_of(found.groupby("query_id").vec_id.apply(set), np.arange(300), m, 20) == 1


def test_pieces(docs, odd, none):
    import sentencepiece

    p = pieces.Pieces.load()
    score = dict(zip(p.ids.tolist(), p.scores.tolist(), strict=True))
    names = [x for x, _, _ in pieces.read_model(pieces.DEFAULT_MODEL)]
    vocabulary = {names[i].replace(pieces.MARK, b" "): s for i, s in score.items()}

    def best(word):
        top = [0.0] + [-math.inf] * len(word)
        for i in range(len(word)):
            if top[i] > -math.inf:
                size = 1 if word[i] < 0xC0 else 2 if word[i] < 0xE0 else 3 if word[i] < 0xF0 else 4
                top[i + size] = max(top[i + size], top[i] + p.unknown)
                for j in range(i + 1, min(len(word), i + 60) + 1):
                    if word[i:j] in vocabulary:
                        top[j] = max(top[j], top[i] + vocabulary[word[i:j]])
        return top[-1]

    words = [w.encode() for w in (" the", " hello", " $$$", "  two", " Éa", " 日本", " x\ny", " \U0001f600!")]
    ids, size = p.best(words)
    at = np.cumsum(size) - size
    for w, a, n in zip(words, at, size, strict=True):
        each = ids[a : a + n].tolist()
        byte = [i for i in each if p.is_byte[i]]
        lost = len(bytes(int(names[i][3:5], 16) for i in byte).decode())
        assert math.isclose(sum(score.get(i, 0.0) for i in each) + lost * p.unknown, best(w), rel_tol=1e-9), w
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    got = pieces.with_pieces(docs.select("doc_id", "text").limit(60)).collect()
    assert all(r["round_trip"] and r["decoded"] == r["text"] == library.decode(list(r["token_ids"])) for r in got)
    rows = pieces.with_pieces(odd).collect()
    assert len(rows) == len(ODD) and all(r["round_trip"] and r["decoded"] == r["text"] for r in rows)
    assert pieces.with_pieces(none).count() == 0


def test_long_texts_without_blanks(monkeypatch):
    import random
    import time

    p = pieces.Pieces.load()
    score = dict(zip(p.ids.tolist(), p.scores.tolist(), strict=True))
    worth = lambda ids: sum(score.get(i, 0.0) for i in ids)
    r = random.Random(4)
    japanese = "".join(chr(r.choice([r.randint(0x3041, 0x3096), r.randint(0x30A1, 0x30F6), r.randint(0x4E00, 0x9FA5)])) for _ in range(350_000)).encode()
    letters = "".join(r.choices("abcdefghijklmnopqrstuvwxyzé", k=500_000)).encode()
    for text in (japanese, letters, b"ab" * 200_000, b" " * 100_000):
        began = time.time()
        ids, at = pieces.encoder(p)([text])
        assert time.time() - began < 10 * len(text) / 1e6 + 2
        assert p.decode(ids, at)[0].tobytes() == text
        some = text[:900].decode("utf-8", "ignore").encode()
        whole = p._solve([some])[0].tolist()
        assert math.isclose(worth(p._solve_one(some)[0].tolist()), worth(whole), rel_tol=1e-9)
        assert math.isclose(worth([i for part in p.cut([some])[0] for i in p.best([part])[0].tolist()]), worth(whole), rel_tol=1e-9)
    assert p.blank_first and pieces.puts_blank_first(pieces.DEFAULT_MODEL)


WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def test_decontamination(spark, docs, odd, none):
    items = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "the same text"), (3, None), (4, "!!"), (10, "X"), (11, "same text is here")]
    small = spark.createDataFrame(items, "item_id long, text string")
    for d, b in ((docs, spark.read.parquet(f"{DATA}/benchmark.parquet")), (odd, small)):
        patterns = collections.defaultdict(set)
        for i, t in b.collect():
            w = WORD.findall((t or "").translate(LOWER))
            for k in range(max(1, len(w) - 9) if w else 0):
                patterns[tuple(w[k : k + 10])].add(str(i))
        want = collections.Counter()
        for i, t in d.select("doc_id", "text").collect():
            w, hit, own = WORD.findall((t or "").translate(LOWER)), set(), set()
            for n in {len(p) for p in patterns}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in patterns:
                        hit |= set(range(k, k + n))
                        own |= patterns[tuple(w[k : k + n])]
            want[i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)] += 1
        got = decontaminate.contamination(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert collections.Counter(map(tuple, got.collect())) == want
    assert decontaminate.contamination(none, small).count() == 0
    assert decontaminate.contamination(odd, small.limit(0)).where("contaminated").count() == 0
def test_decontamination_beyond_the_broadcast_size(spark, docs, monkeypatch):
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
    want = collections.Counter(map(tuple, decontaminate.contamination(docs, benchmark).select(columns).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 3)
    assert collections.Counter(map(tuple, decontaminate.contamination(docs, benchmark).select(columns).collect())) == want


def test_proximity(spark, docs, monkeypatch):
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").limit(40).collect()] + [(10**6, "a b c a d"), (10**6 + 1, None), (10**6 + 2, "")]
    tokens = {i: WORD.findall((t or "").translate(LOWER)) for i, t in texts}
    common = [w for w, _ in collections.Counter(w for t in tokens.values() for w in t).most_common(40)]
    items = [(1, "a c"), (2, "a"), (3, "a nowhere"), (4, " ".join(common[:3])), (5, f"{common[5]} {common[30]}"), (6, " ".join(common[10:14]))]
    items = spark.createDataFrame(items, "item_id long, text string")
    for broadcast in (200_000, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
        terms = decontaminate.vocabulary(items)
        index = decontaminate.build_index(spark.createDataFrame(texts, "key long, text string"), terms)
        patterns = items.select(items.item_id.alias("pattern"), decontaminate.F.explode(decontaminate.words(items.text)).alias("word")).join(terms, "word")
        for distance in (1, 2, 7):
            want = collections.Counter()
            for item, text in items.collect():
                each = set(WORD.findall(text))
                n = {w: sum(t.count(w) for t in tokens.values()) for w in each}
                if not min(n.values()):
                    continue
                number = {r["word"]: r["term"] for r in terms.collect()}
                anchor = min(each, key=lambda w: (n[w], number[w]))
                for key, t in tokens.items():
                    for at in [k for k, w in enumerate(t) if w == anchor]:
                        near = [min(((abs(k - at), k) for k, w in enumerate(t) if w == o and abs(k - at) <= distance), default=None) for o in each - {anchor}]
                        if None not in near:
                            places = [at, *(k for _, k in near)]
                            want[key, item, at, min(places), max(places)] += 1
            assert collections.Counter(map(tuple, decontaminate.proximity(index, patterns, distance).collect())) == want


def test_lm_scores(docs, odd, none):
    for d in (docs, odd):
        texts, counts = d.select("doc_id", "text").collect(), collections.Counter()
        tokens = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None] for _, t in texts]
        out = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in texts]
        for w, held in zip(tokens, out, strict=True):
            if not held:
                counts.update(w)
        total, half = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
        want = sorted((str(i), held, len(w), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 0.5) / half) for x in w), 4)) for (i, _), w, held in zip(texts, tokens, out, strict=True))
        got = lm_score.score(d).collect()
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
        assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    assert lm_score.score(none).count() == 0


def exact_model(tokens, train):
    """(score of each text, by the model's formula with exact counts for n-grams, quantised but without false positives)."""
    words, pairs = collections.Counter(), collections.Counter()
    for w, used in zip(tokens, train, strict=True):
        if used:
            words.update(w)
            pairs.update(zip(["start", *w[:-1]], w, strict=True))
    begins = sum(train)
    total, distinct = sum(words.values()), len(words)
    level = lambda n: 0.0 if not n else (3 * 2 ** (n.bit_length() - 1) - 1) / 2
    out = []
    for w in tokens:
        at = 0.0
        for a, b in zip(["start", *w[:-1]], w, strict=True):
            before, n = level(begins if a == "start" else words[a]), level(words[b])
            p = 0.1 * min(level(pairs[a, b]), before, n) / max(before, 1) + 0.9 * (n + 0.5) / (total + 0.5 * (distinct + 1))
            at += math.log10(min(p, 1.0))
        out.append(at)
    return out


def test_lm_scores_follow_the_counts_of_all_ngrams(spark, docs, odd, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 200_000)  # several chunks
    for d in (docs, odd):
        texts = d.select("doc_id", "text").collect()
        tokens = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None] for _, t in texts]
        train = [zlib.crc32(str("" if i is None else i).encode()) % 5 != 1 for i, _ in texts]
        want = sorted(exact_model(tokens, train))
        got = sorted(r["score"] for r in lm_score.score(d).collect())
        assert len(got) == len(want) and np.allclose(got, want, rtol=0.03, atol=0.5)
        assert np.mean(np.abs(np.array(got) / np.minimum(want, -1e-9) - 1)) < 0.01


def test_words_of_a_pattern_are_told_apart(spark):
    from talkmill.llm import common

    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rows = [(2, a), (3, f"{a} {b}"), (4, "x" * 64), (5, "x" * 65), (6, "x" * 63)]
    got = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), held_out=None).collect()}
    known = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in t.split())
    assert all(got[i]["n_known"] == sum(known[w] > 0 for w in t.split()) + 1 for i, t in rows)
    many = [bytes(x) for n in range(1, 130, 3) for x in np.random.default_rng(n).integers(97, 99, (200, n), np.uint8)] + [a.encode(), b.encode()]
    many = sorted(set(many))
    h = common.hashes(np.frombuffer(b"".join(many), np.uint8), np.array([len(w) for w in many]))
    assert len(set(h.tolist())) == len(many)


def test_filter_reads_what_it_holds():
    keys = np.arange(1, 3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    level = lm_score.levels(np.arange(1, 3000) % 40 + 1)
    model = lm_score.FrequencyFilter(keys, level)
    read = model.read(keys)
    assert (read >= level).all() and (read > level).mean() < 0.1
    assert (model.read(keys + np.uint64(1)) > 0).mean() < 0.1
    assert not lm_score.FrequencyFilter(keys[:0], level[:0]).read(keys).any()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0").select("doc_id")
    got = corpus_pipeline.run(spark, DATA).cache()
    assert 0.5 * docs.count() < got.count() < docs.count() and got.where("NOT round_trip").count() == 0
    assert got.join(labels, "doc_id").count() <= 0.2 * labels.count()
    assert set(docs.columns) < set(got.columns)


def test_pipeline_stages_on_odd_tables(spark, odd, none):
    """Nulls, empty, long, repeated and tied rows, empty tables, and columns named like those that operators make."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    clash = odd.select("*", *[F.lit("own").alias(c) for c in ("selected", "gumbel_key", "component", "node", "wide", "bits", "n", "contaminated", "n_hit", "n_pieces", "__1", "__row", "__lang")])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, clash, DATA)
        new = ["token_ids", "n_pieces", "n_bytes", "round_trip"] if name == "pieces" else []
        assert got.columns == [c for c in clash.columns if c not in new] + new
        rows = got.collect()
        assert all(r["selected"] == "own" and r["contaminated"] == "own" and r["n"] == "own" for r in rows), name
        assert stage(spark, clash.limit(0), DATA).count() == 0
        if name in ("decontamination", "pieces"):
            assert len(rows) == len(ODD)
        if name in ("language", "quality"):
            assert not {1, 2, 3} & {r["doc_id"] for r in rows}
    apart = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (1, "quite other words are in this one"), (2, "x y z"), (None, "x y z"), (3, "X y z"), (None, "alone in here"), (4, None), (5, "")], "doc_id long, text string")
    kept = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, apart, DATA).collect())
    assert kept == collections.Counter([(1, "alpha beta gamma delta epsilon zeta"), (1, "quite other words are in this one"), (2, "x y z"), (None, "alone in here"), (4, None)])
