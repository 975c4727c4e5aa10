"""Splits of samples into parts of exact sizes that keep evidence groups whole: rounded targets, assignment and swaps, fold manifests.

A question type's groups are placed by one task, as each placement depends on those before it; types run side by side. Swaps
weigh pairs of profiles (groups of equal weights), not of groups. Targets and quotas are a number for each type and part, so they are the driver's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.session import checkpointed

# What an error in each kind of stratum weighs, and how often groups are swapped at most.
JOINT, TYPE, UNANSWERABLE, ANSWERABLE, BIN = 2.0, 12.0, 12.0, 1.0, 2.0
SWAPS = 30
#: Pairs of groups whose swaps gain the same, up to which each pair has a digest.
TIED = 1 << 17

Targets = dict[str, dict[str, int]]


def tie(seed: int, *names: str) -> str:
    """A digest that orders equals: the same in each run."""
    return hashlib.sha256("|".join([str(seed), *names]).encode()).hexdigest()


def rounded_targets(counts: dict[str, int], sizes: dict[str, int], seed: int) -> Targets:
    """Whole numbers for each part and type whose sums are the sizes and the counts: shares are cut, then the cells with the
    largest fractions, ties by digest, get what their type and their part have left."""
    total = sum(counts.values())
    if total != sum(sizes.values()):
        raise ValueError("counts and sizes differ in their sums")
    types, parts = list(counts), list(sizes)
    share = np.outer([sizes[p] for p in parts], [counts[t] for t in types])
    cells = share // max(total, 1)
    fraction = share / max(total, 1) - cells
    rows, columns = np.array([sizes[p] for p in parts]) - cells.sum(1), np.array([counts[t] for t in types]) - cells.sum(0)
    for i, j in sorted(np.ndindex(cells.shape), key=lambda c: (-fraction[c], tie(seed, types[c[1]], parts[c[0]], "rounding"))):
        more = min(rows[i], columns[j])
        cells[i, j] += more
        rows[i] -= more
        columns[j] -= more
    return {p: {t: int(cells[i, j]) for j, t in enumerate(types)} for i, p in enumerate(parts)}


def strata(samples: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each stratum in each group, rarity of each group); samples are sorted by group, whose number is in __g."""
    answer = samples["is_unanswerable"].to_numpy(bool)
    joint = samples["question_type"].astype(str) + "|" + samples["is_unanswerable"].astype(str) + "|" + samples["segment_bin"].astype(str)
    group, blocks = samples["__g"].to_numpy(), []
    for names, weight in ((joint, JOINT), (samples["question_type"], TYPE), (samples["is_unanswerable"], np.where(answer, UNANSWERABLE, ANSWERABLE)), (samples["segment_bin"], BIN)):
        code, kinds = pd.factorize(names)
        block = np.zeros((group[-1] + 1, len(kinds)))
        np.add.at(block, (group, code), weight)
        blocks.append(block)
    rarity = np.bincount(group, 1 / joint.map(joint.value_counts()).to_numpy(float))
    return np.hstack(blocks), rarity


def place(samples: pd.DataFrame, sizes: dict[str, int], quotas: dict[str, int] | None, seed: int) -> dict[str, str]:
    """The part of each group: large and rare groups first, each where the weighted squared error of the strata grows least.

    A part is open to a group if its size and its quota of unanswerable samples allow it, and leave room for the rest of the
    quota. Parts that can't be filled exactly raise.
    """
    samples = samples.sort_values(["group_id", "sample_id"], kind="stable")
    number, names = pd.factorize(samples["group_id"])
    samples = samples.assign(__g=number)
    weights, rarity = strata(samples)
    size, hard = np.bincount(number), np.bincount(number, samples["is_unanswerable"].to_numpy(float)).astype(int)
    parts = list(sizes)
    room = np.array([sizes[p] for p in parts])
    if room.sum() != len(samples):
        raise ValueError(f"sizes of the parts sum to {room.sum()}, and the samples are {len(samples)}")
    left = None if quotas is None else np.array([quotas[p] for p in parts])
    target = weights.sum(0) * (room / max(1, len(samples)))[:, None]
    scale, error = np.maximum(target, 1.0), -target
    part_of = np.full(len(names), -1)
    for g in sorted(range(len(names)), key=lambda g: (-size[g], -rarity[g], tie(seed, str(names[g]), "order"))):
        fits = room >= size[g]
        if left is not None:
            fits &= (left >= hard[g]) & (room - size[g] >= left - hard[g])
        if not fits.any():
            raise ValueError(f"group {names[g]} fits in no part")
        growth = (weights[g] * (2 * error + weights[g]) / scale).sum(1)
        least = np.flatnonzero(fits & (growth == growth[fits].min()))
        p = least[0] if len(least) == 1 else min(least, key=lambda p: tie(seed, str(names[g]), parts[p]))
        part_of[g], room[p] = p, room[p] - size[g]
        error[p] += weights[g]
        if left is not None:
            left[p] -= hard[g]
    if room.any() or (left is not None and left.any()):
        raise ValueError("a part is not full")
    swap(part_of, weights, size * (hard.max() + 1) + hard, error, scale, [str(n) for n in names], seed)
    return {names[g]: parts[p] for g, p in enumerate(part_of)}


def swap(part_of: np.ndarray, weights: np.ndarray, kind: np.ndarray, error: np.ndarray, scale: np.ndarray, names: list[str], seed: int) -> None:
    """Swaps groups of one kind (size and unanswerable samples) between parts while that lowers the error, the best swap first.

    Groups of one kind and equal weights are one profile: their swaps gain the same, so pairs of profiles are weighed.
    """
    _, first, profile = np.unique(np.column_stack([kind, weights]), axis=0, return_index=True, return_inverse=True)
    profile, kinds, weights = profile.ravel(), kind[first], weights[first]
    held = np.zeros((len(error), len(first)), np.int64)
    np.add.at(held, (part_of, profile), 1)
    for turn in range(SWAPS):
        least, found = -1e-9, []
        for a in range(len(error)):
            for b in range(a + 1, len(error)):
                for k in np.intersect1d(kinds[held[a] > 0], kinds[held[b] > 0]):
                    of_a, of_b = (np.flatnonzero((held[p] > 0) & (kinds == k)) for p in (a, b))
                    for g in of_a:
                        d = weights[of_b] - weights[g]
                        gain = (d * (2 * error[a] + d) / scale[a] + d * (d - 2 * error[b]) / scale[b]).sum(1)
                        low = gain.min()
                        if low < least or (found and low == least):
                            found = [] if low < least else found
                            least = low
                            found += [(a, b, g, h) for h in of_b[gain == low]]
        if not found:
            return
        g, h = first_pair(part_of, profile, found, names, seed + turn)
        a, b, p, q = part_of[g], part_of[h], profile[g], profile[h]
        part_of[g], part_of[h] = b, a
        held[[a, b], [p, q]] -= 1
        held[[b, a], [p, q]] += 1
        error[a] += weights[q] - weights[p]
        error[b] -= weights[q] - weights[p]


def first_pair(part_of: np.ndarray, profile: np.ndarray, found: list[tuple[int, int, int, int]], names: list[str], seed: int) -> tuple[int, int]:
    """Of all pairs of groups in found (part, part, profile, profile), the one with the first digest.

    All of them change the error alike. Beyond TIED pairs, the group with the first digest of its own is taken, then its partner by
    the pair's digest: that takes a digest for each group, and not for each pair.
    """
    sides = [(np.flatnonzero((part_of == a) & (profile == p)), np.flatnonzero((part_of == b) & (profile == q))) for a, b, p, q in found]
    if sum(len(g) * len(h) for g, h in sides) > TIED:
        first, i = min(((g, i) for i, (gs, _) in enumerate(sides) for g in gs), key=lambda x: (tie(seed, names[x[0]], "swap"), x[1]))
        sides = [(np.array([first]), sides[i][1])]
    return min(((g, h) for gs, hs in sides for g in gs for h in hs), key=lambda x: tie(seed, names[x[0]], names[x[1]], "swap"))


def type_counts(samples: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """Samples, and unanswerable ones, of each question type (a few)."""
    rows = samples.groupBy("question_type").agg(F.count("*").alias("n"), F.count_if("is_unanswerable").alias("u")).orderBy("question_type").collect()
    return {r["question_type"]: r["n"] for r in rows}, {r["question_type"]: r["u"] for r in rows}


def assigned(samples: DataFrame, targets: Targets, quotas: Targets | None, seed: int) -> DataFrame:
    """samples and their part. samples: sample_id, group_id, question_type, is_unanswerable, segment_bin.

    targets: how many samples of each type go to each part; quotas: how many of those that can't be answered. A group of
    several types raises, as does one that fits nowhere. Groups are never parted.
    """
    names = [f.name for f in samples.schema if f.name not in ("part", "__kinds")]
    kinds = samples.groupBy("group_id").agg(F.count_distinct("question_type").alias("__kinds"))
    whole = samples.select(*names).join(kinds, "group_id")
    checked = whole.withColumn("question_type", F.when(F.col("__kinds") == 1, F.col("question_type")).otherwise(F.raise_error(F.concat(F.lit("mixed question types in group "), F.col("group_id").cast("string"))))).select(*names)

    def one_type(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["question_type"].iloc[0]
        own = seed + int(tie(seed, str(kind), "typed")[:8], 16)
        part = place(pdf, {p: t.get(kind, 0) for p, t in targets.items()}, None if quotas is None else {p: t.get(kind, 0) for p, t in quotas.items()}, own)
        return pdf.assign(part=pdf["group_id"].map(part))

    schema = checked.select("*", F.lit("").alias("part")).schema
    # By range, so that each type has a task of its own: placing takes long for few bytes.
    tasks = max(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), len({k for t in targets.values() for k in t}))
    return checked.repartitionByRange(tasks, "question_type").groupBy("question_type").applyInPandas(one_type, schema)


def fixed_split(samples: DataFrame, sizes: dict[str, int], seed: int = 42, targets: Targets | None = None) -> DataFrame:
    """samples and their part: parts of exact sizes, with rounded shares of each type (or given targets) and of the unanswerable."""
    counts, hard = type_counts(samples)
    quotas = rounded_targets(hard, shares(sum(hard.values()), sizes), seed)
    return assigned(samples, targets or rounded_targets(counts, sizes, seed), quotas, seed)


def shares(total: int, sizes: dict[str, int]) -> dict[str, int]:
    """total dealt to the parts by their sizes: floors, then the largest remainders, first parts first."""
    whole = sum(sizes.values())
    floors = {p: total * n // max(whole, 1) for p, n in sizes.items()}
    for p in sorted(sizes, key=lambda p: -(total * sizes[p] % max(whole, 1)))[: total - sum(floors.values())]:
        floors[p] += 1
    return floors


def nested_folds(samples: DataFrame, folds: int, validation: float, seed: int = 42) -> DataFrame:
    """(fold, sample_id, group_id, question_type, ..., part): each fold's test part, and the rest dealt to train and validation.

    Every sample is held out once. A fold's inner seed is seed + fold + 1. The outer split is placed once, and stored.
    """
    n = samples.count()
    sizes = {f"outer_{i}": n // folds + (i < n % folds) for i in range(folds)}
    outer = checkpointed(fixed_split(samples, sizes, seed).withColumnRenamed("part", "__outer"))
    out = None
    for i in range(folds):
        test, rest = outer.where(F.col("__outer") == f"outer_{i}").drop("__outer"), outer.where(F.col("__outer") != f"outer_{i}").drop("__outer")
        held = round((n - sizes[f"outer_{i}"]) * validation)
        inner = fixed_split(rest, {"train": n - sizes[f"outer_{i}"] - held, "validation": held}, seed + i + 1)
        one = inner.unionByName(test.withColumn("part", F.lit("test"))).withColumn("fold", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def statistics(split: DataFrame, by: Iterable[str] = ("part",)) -> DataFrame:
    """(by..., field, value, n): a part's samples by type, by answerability and by bin, in one pass."""
    fields = ["question_type", "is_unanswerable", "segment_bin"]
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return split.select(*by, pairs.alias("p")).groupBy(*by, "p.field", "p.value").agg(F.count("*").alias("n"))


def manifest(split: DataFrame, by: Iterable[str] = ("fold",)) -> DataFrame:
    """(by..., part, n, digest): the size of each part and a digest of its ids, in order; ids are gathered as digests of 64 bits."""
    return split.groupBy(*by, "part").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.col("sample_id").cast("string"))).alias("digest"))
