"""URL filters: prefix rules, and gradient-boosted trees over lexical features for the URLs that no rule fits.

The trees are trained from labelled URLs and become plain column expressions, so judging is one projection.
"""

from __future__ import annotations

import json
import random

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path) and verdict; hosts in lower case.
Rule = tuple[str, str, str]
#: Labelled URLs that the trees are trained on at most.
LABELLED = 20_000
FEATURES = ["length", "host_length", "labels", "depth", "digit_ratio", "host_entropy", "parameters", "query_length", "hyphens", "longest_label", "suffix_rate", "ending_rate"]
#: Endings of host words whose blocked share is learned, the commonest ones; letters of an ending.
ENDINGS, ENDING = 200, 3


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) of a URL; empty for null and where `://` is missing. Only the host's A-Z is lower-cased."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, pattern, 2), F.regexp_extract(url, pattern, 3)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does. Equal lengths: the first one listed."""
    rule = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, says in reversed(sorted(rules, key=lambda r: -len(r[0] + r[1]))):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def suffix(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def endings(host: Column) -> Column:
    """The last letters of each word of a host, a word being what is between dots and hyphens."""
    return F.transform(F.filter(F.split(host, r"[.\-]"), lambda w: w != ""), lambda w: F.right(w, F.lit(ENDING)))


def lexical(df: DataFrame, host: str, path: str, query: str, rates: dict[str, float], ends: dict[str, float], usual: float) -> DataFrame:
    """df and its FEATURES. rates and ends: the blocked share of each suffix and of each ending in the labelled URLs; usual: of all."""
    h, p, q = F.col(host), F.col(path), F.col(query)
    whole = F.concat(h, p, q)
    labels = F.split(h, r"\.")
    share = F.transform(F.array_distinct(F.split(h, "")), lambda c: F.when(c == "", 0.0).otherwise((F.length(h) - F.length(F.replace(h, c, F.lit("")))) / F.length(h)))
    rate = F.lit(usual)
    for name, value in sorted(rates.items()):
        rate = F.when(suffix(h) == name, value).otherwise(rate)
    known = F.create_map(*[F.lit(x) for pair in sorted(ends.items()) for x in pair]) if ends else F.create_map().cast("map<string,double>")
    ending_rate = F.coalesce(F.array_max(F.transform(endings(h), lambda e: F.coalesce(F.try_element_at(known, e), F.lit(usual)))), F.lit(usual))
    made = {
        "length": F.length(whole), "host_length": F.length(h), "labels": F.size(labels), "depth": F.size(F.filter(F.split(p, "/"), lambda x: x != "")),
        "digit_ratio": F.length(F.regexp_replace(whole, "[^0-9]", "")) / F.greatest(F.length(whole), F.lit(1)),
        "host_entropy": F.aggregate(share, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log2(x)).otherwise(0.0)),
        "parameters": F.when(F.startswith(q, F.lit("?")), F.size(F.split(F.substring_index(q, "#", 1), "&"))).otherwise(0), "query_length": F.length(q),
        "hyphens": F.length(h) - F.length(F.replace(h, F.lit("-"), F.lit(""))), "longest_label": F.array_max(F.transform(labels, F.length)), "suffix_rate": rate, "ending_rate": ending_rate,
    }
    return df.withColumns({f"__{n}": c.cast("double") for n, c in made.items()})


def tree(node, names: list[str]) -> Column:
    """A trained tree as an expression."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.col(names[split.featureIndex()]) <= float(split.threshold()), tree(node.leftChild(), names)).otherwise(tree(node.rightChild(), names))


class UrlFilter:
    """Boosted trees; `score` of a URL is above 0 if it is to be blocked. `model` is what they were compiled from, None without trees."""

    def __init__(self, trees: list[Column], weights: list[float], rates: dict[str, float], ends: dict[str, float], usual: float, constant: float = 0.0, model=None):
        self.trees, self.weights, self.rates, self.ends, self.usual, self.constant, self.model = trees, weights, rates, ends, usual, constant, model

    @classmethod
    def fit(cls, labelled: DataFrame, trees: int = 20, depth: int = 5) -> UrlFilter:
        """labelled: url, blocked (0 or 1); at most LABELLED rows are used, those whose URLs hash lowest. Nulls in blocked are skipped.

        With one class alone there are no trees: all URLs are judged as that class. Without rows none is blocked.
        """
        host, path, query = parts(F.col("url"))
        rows = labelled.select("url", F.col("blocked").cast("double").alias("label")).where("label is not null").orderBy(F.xxhash64("url"), "url", "label").limit(LABELLED)
        rows = rows.select("label", host.alias("h"), path.alias("p"), query.alias("q"))
        n, blocked = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        if not 0 < blocked < n:
            return cls([], [], {}, {}, 0.5, 1.0 if blocked else -1.0)
        usual = (blocked + 1) / (n + 2)

        def shares(names: Column, most: int) -> dict[str, float]:
            each = rows.select("label", F.explode(F.array_distinct(names)).alias("s")).groupBy("s").agg(F.sum("label").alias("b"), F.count("*").alias("n"))
            return {r["s"]: (r["b"] + 10 * usual) / (r["n"] + 10) for r in each.orderBy(F.desc("n"), "s").limit(most).collect()}

        rates, ends = shares(F.array(suffix(F.col("h"))), 100), shares(endings(F.col("h")), ENDINGS)
        names = [f"__{x}" for x in FEATURES]
        vectors = VectorAssembler(inputCols=names, outputCol="features").transform(lexical(rows, "h", "p", "q", rates, ends, usual)).select("label", "features")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(vectors.coalesce(1))
        return cls([tree(t._java_obj.rootNode(), names) for t in model.trees], list(model.treeWeights), rates, ends, usual, 0.0, model)

    def score(self) -> Column:
        return sum((t * w for t, w in zip(self.trees, self.weights, strict=True)), F.lit(self.constant))


def made_urls(n: int, seed: int) -> list[tuple[str, int]]:
    """(url, blocked) of n URLs made by rule, half of them blocked; two in a hundred labels are turned round.

    Blocked ones have bait words, random or numeric hosts, long chains of labels, many parameters, or are no URLs; no one trait
    parts the classes: bait words stand together with and without a hyphen, and a third of the other hosts have one.
    """
    r = random.Random(seed)
    syllables = "ar be con da el fi gra ho in jo ka lu ma ne or pa qui ra so ti ul ve wa th st sh er an on re ed nd ha".split()
    plain = "news city garden river school music travel museum science weather library forum market health sports kitchen history nature cinema letters union times village harbour college".split()
    bait = "free cheap win best casino bets pills loans adult spam ads track click deal prize hot sex vip poker credit bonus viagra slots jackpot x farm".split()
    languages = ["en", "de", "fr", "es", "it"]

    def word():
        return r.choice(plain) if r.random() < 0.45 else "".join(r.choices(syllables, k=r.randint(2, 4)))

    def slug():
        return "-".join(word() for _ in range(r.randint(2, 6)))

    def good_host():
        name = word() + ("" if r.random() < 0.5 else r.choice(["-", "", "-"]) + word())
        name += str(r.randint(1, 99)) if r.random() < 0.06 else ""
        return r.choice(["", "", "www.", "m.", "blog."]) + name + "." + r.choices(["com", "org", "net", "info", "example.com", "example.net", "example.org"], [30, 18, 18, 4, 10, 10, 10])[0]

    def path():
        return r.choice([f"/{r.choice(languages)}/{r.randint(1, 9999)}", f"/{r.choice(languages)}/{r.randint(1, 9999)}", f"/{r.randint(1999, 2025)}/{r.randint(1, 12)}/{slug()}", f"/{word()}/{slug()}", "/", ""]) + r.choice(["", "", "/", ".html", "#top", "?page=2&ref=x", "?utm_source=feed", f"?q={word()}"])

    def bad_host(kind):
        end = "." + r.choices(["com", "net", "org", "info", "xyz", "top", "example.com", "example.net", "example.org"], [26, 12, 6, 10, 8, 8, 10, 10, 10])[0]
        if kind == "bait":
            return r.choice(["", "", "www.", "m.", "blog."]) + r.choice(bait) + r.choice(["-", "-", "", str(r.randint(1, 999))]) + r.choice([r.choice(bait), r.choice(bait), word()]) + end
        if kind == "random":
            return "".join(r.choices("bcdfghjklmnpqrstvwxz0123456789aeiou", k=r.randint(10, 20))) + end
        if kind == "numeric":
            return ".".join(str(r.randint(1, 254)) for _ in range(4))
        return ".".join(r.choice(["login", "secure", "account", "verify", "update", word(), "pay"]) + (r.choice(["-", ""]) + word() if r.random() < 0.5 else "") for _ in range(r.randint(3, 5))) + end

    out = []
    for i in range(n):
        if i % 2 == 0:
            url = f"{r.choice(['http', 'https'])}://{good_host()}{path()}"
        else:
            kind = r.choices(["bait", "random", "numeric", "chain", "parameters", "none"], [45, 14, 8, 12, 13, 8])[0]
            if kind == "none":
                url = f"{word()} {r.choice(bait)}"
            else:
                tail = path()
                if kind == "parameters":
                    tail = f"/{r.choice(['c', 'go', 'out', word()])}?" + "&".join(f"{r.choice('abcdefgkuvz')}{j}={r.randint(1, 10**6)}" for j in range(r.randint(4, 14)))
                url = f"{r.choice(['http', 'https'])}://{good_host() if kind == 'parameters' else bad_host(kind)}{tail}"
        out.append((url, (i % 2) ^ (r.random() < 0.02)))
    return out


def seed_urls(spark: SparkSession, n: int = 6000, seed: int = 3) -> DataFrame:
    """made_urls as a table of url and blocked."""
    rows = json.dumps([{"url": u, "blocked": int(b)} for u, b in made_urls(n, seed)])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<url string, blocked int>>")))


def judge(pages: DataFrame, model: UrlFilter, rules: list[Rule], ident: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (above 0: the trees block) of every row.

    A null URL, an empty one and one without `://` have empty host and path, no rule, and the trees' verdict on that. Rows
    that repeat stay. Other columns are not read.
    """
    host, path, query = parts(F.col("url"))
    rows = pages.select(F.col(ident).alias("page_id"), F.col(url).alias("url")).select("page_id", host.alias("host"), path.alias("path"), query.alias("query"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = lexical(rows, "host", "path", "query", model.rates, model.ends, model.usual).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("says"), model.score().alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
