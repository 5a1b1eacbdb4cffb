"""Search for recodings of letters into classes, and a plane on which recodings can be compared.

What the search needs of an alignment are counts of letters: by sequence, and of
pairs that share a site. They are summed by Spark; a search from one random
start is a small task, starts are spread over the cluster, and the best is
chosen by its criterion and then its number, so partitions don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is added to counts, and by how much a step must improve.
PSEUDOCOUNT, EPS = 1e-12, 1e-8


def letter_counts(residues: DataFrame) -> DataFrame:
    """seq_id, letter, n of an alignment (seq_id, site, letter)."""
    return residues.groupBy("seq_id", "letter").agg(F.count(F.lit(1)).cast("double").alias("n"))


def pair_counts(residues: DataFrame) -> DataFrame:
    """a, d, n: ordered pairs of sequences in which letters a and d meet at a site; sites are summed up before they are paired."""
    at = residues.groupBy("site", "letter").agg(F.count(F.lit(1)).cast("double").alias("k"))
    x, y = at.select("site", F.col("letter").alias("a"), F.col("k").alias("ka")), at.select("site", F.col("letter").alias("d"), F.col("k").alias("kd"))
    return x.join(y, "site").groupBy("a", "d").agg(F.sum(F.col("ka") * F.col("kd")).alias("n"))


def random_classes(items: int, classes: int, rng: np.random.Generator) -> np.ndarray:
    """Classes from merging two random ones until there are so many; numbered by their first member."""
    of = list(range(items))
    while len(names := sorted(set(of))) > classes:
        a, b = sorted(rng.choice(len(names), 2, replace=False))
        of = [names[a] if c == names[b] else c for c in of]
    return np.unique(of, return_inverse=True)[1]


def climb(of: np.ndarray, classes: int, criterion: Callable[[np.ndarray], float]) -> tuple[np.ndarray, float]:
    """Moves single items, in order, to the first class that improves the criterion, until none does; no class is emptied."""
    best, moved = criterion(of), True
    while moved:
        moved = False
        for item, to in ((i, c) for i in range(len(of)) for c in range(classes)):
            if to != of[item] and (of == of[item]).sum() > 1:
                new = of.copy()
                new[item] = to
                value = criterion(new)
                if value < best - EPS:
                    of, best, moved = new, value, True
                    break
    return of, best


def chi_squared(shares: np.ndarray, overall: np.ndarray, sites: np.ndarray, classes: int) -> Callable[[np.ndarray], float]:
    """Largest chi-squared of a sequence's class shares against the overall ones."""

    def value(of: np.ndarray) -> float:
        member = np.eye(classes)[of]
        whole, own = overall @ member, shares @ member
        return float(((((own - whole) ** 2) / whole).sum(axis=1) * sites).max())

    return value


def conductance(overall: np.ndarray, flow: np.ndarray, classes: int) -> Callable[[np.ndarray], float]:
    """Sum over classes of the flow that leaves one, as a share of its mass."""

    def value(of: np.ndarray) -> float:
        member = np.eye(classes)[of]
        inside = member.T @ flow @ member
        return float(((inside.sum(axis=1) - np.diag(inside)) / (overall @ member)).sum())

    return value


def transition_shares(counts: np.ndarray) -> np.ndarray:
    """Row shares of pair counts without their diagonal, a pseudocount added."""
    q = counts.copy()
    np.fill_diagonal(q, 0)
    q += PSEUDOCOUNT
    np.fill_diagonal(q, 0)
    return q / q.sum(axis=1, keepdims=True)


def search(residues: DataFrame, letters: Sequence[str], classes: int, method: str, starts: int = 100, seed: int = 1) -> tuple[list[str], float, DataFrame]:
    """The best classes (letters joined, in the order of ``letters``), their criterion, and start, criterion, classes of all searches.

    residues: seq_id, site, letter; other letters are left out. method:
    'chi_squared' (sequences should have alike class shares) or 'conductance'
    (changes should stay within classes). What comes to the driver and goes to
    the tasks is a row of counts a sequence, or of a letter for conductance.
    """
    spark, at = residues.sparkSession, {x: i for i, x in enumerate(letters)}
    if not 2 <= classes <= len(letters):
        raise ValueError("classes: two at least, and no more than letters")
    own = residues.where(F.col("letter").isin(list(letters)))
    counts = letter_counts(own).toPandas()
    if not len(counts):
        raise ValueError("no letters in the alignment")
    table = np.zeros((counts.seq_id.nunique(), len(letters)))
    np.add.at(table, (pd.factorize(counts.seq_id, sort=True)[0], counts.letter.map(at)), counts.n)
    overall = table.sum(axis=0) + PSEUDOCOUNT
    overall, sites = overall / overall.sum(), table.sum(axis=1)
    if method == "chi_squared":
        criterion = chi_squared(table / sites[:, None], overall, sites, classes)
    elif method == "conductance":
        pairs = np.zeros((len(letters), len(letters)))
        for r in pair_counts(own).collect():
            pairs[at[r.a], at[r.d]] = r.n
        criterion = conductance(overall, overall[:, None] * transition_shares(pairs), classes)
    else:
        raise ValueError(f"unknown method {method}")

    def run(batches):
        for pdf in batches:
            for start in pdf["id"]:
                of, value = climb(random_classes(len(letters), classes, np.random.default_rng([seed, int(start)])), classes, criterion)
                names = ["".join(x for x, c in zip(letters, of, strict=True) if c == k) for k in range(classes)]
                yield pd.DataFrame({"start": [start], "criterion": [value], "classes": [sorted(names, key=lambda n: at[n[0]])]})

    tried = spark.range(0, starts, 1, min(starts, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "start long, criterion double, classes array<string>")
    best = tried.agg(F.min_by(F.struct("criterion", "classes"), F.struct(F.round("criterion", 8), F.col("start"))).alias("b")).first().b
    return list(best.classes), best.criterion, tried


def plane(schemes: DataFrame) -> tuple[DataFrame, tuple[float, float]]:
    """scheme, x, y: principal components of recodings (scheme, letter, class), and the share of variance of each.

    A recoding's features are the pairs of letters that it puts together. Their
    inner products are counted by a join on the pair; the matrix of recodings
    by recodings, which is small, is centred and decomposed on the driver. A
    component's largest coordinate is positive.
    """
    x, y = schemes.select("scheme", "class", F.col("letter").alias("a")), schemes.select("scheme", "class", F.col("letter").alias("b"))
    pairs = x.join(y, ["scheme", "class"]).where("a < b").select("scheme", "a", "b")
    other = pairs.withColumnRenamed("scheme", "other")
    names = sorted(r.scheme for r in schemes.select("scheme").distinct().collect())
    at = {n: i for i, n in enumerate(names)}
    gram = np.zeros((len(names), len(names)))
    for r in pairs.join(other, ["a", "b"]).groupBy("scheme", "other").count().collect():
        gram[at[r.scheme], at[r.other]] = r["count"]
    out, share = np.zeros((len(names), 2)), np.zeros(2)
    if len(names):
        centre = np.eye(len(names)) - 1 / len(names)
        value, vector = np.linalg.eigh(centre @ gram @ centre)
        value = np.maximum(value[::-1], 0)
        for k in range(min(2, len(names))):
            v = vector[:, ::-1][:, k]
            out[:, k] = np.sqrt(value[k]) * v * (1 if v[np.abs(v).round(9).argmax()] >= 0 else -1)
            share[k] = value[k] / value.sum() if value.sum() > 0 else 0
    rows = [(n, float(a), float(b)) for n, (a, b) in zip(names, out, strict=True)]
    return schemes.sparkSession.createDataFrame(rows, "scheme string, x double, y double"), (float(share[0]), float(share[1]))
