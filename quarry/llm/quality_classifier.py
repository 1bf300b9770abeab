"""Quality classifier by a sparse ensemble of rules.

Small boosted trees over text statistics are grown on labelled documents; every path from a root becomes a conjunctive
rule; a lasso logistic regression over the rules keeps the few that matter; and these compile into one Spark column, so
that scoring all documents is plain column arithmetic.

The fit uses at most SAMPLE labelled documents, those of least hash of doc_id among the rows that are not held out; only
their statistics come to the driver. Labels, language, source and doc_id are no inputs of a score.

Null texts are empty and are scored as such. Labels that are null are passed over. Without labels of both kinds the score
is the share of label 1, or 0.5 without any. Rows with a null doc_id aren't held out. Rows may repeat; texts of any length
are read whole; extra columns are ignored; an empty table gives an empty result. Nothing is shuffled but the labels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, n_of
from .quality_rules import statistics

SAMPLE, CUTS = 6_000, 48
TREES, DEPTH, SHRINK, LEAF = 30, 3, 0.3, 15
GOOD = 0.7
FEATURES = {
    "words": "ln(1.0D + n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "bars": "n_bars / greatest(n_words, 1)",
    "shouts": "n_shouts / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def featured(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns f_* that rules read."""
    counted = statistics(docs).withColumn("n_shouts", n_of(F.coalesce(F.col("text"), F.lit("")), "!?"))
    return counted.withColumns({f"f_{k}": F.round(F.expr(x).cast("double"), 6) for k, x in FEATURES.items()})


Rule = tuple[tuple[int, bool, float], ...]  # feature, above the cut, cut


def grow(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, path: Rule, out: list[Rule], step: np.ndarray) -> None:
    """One regression tree by Newton gain; adds the rule of every node to ``out`` and its step to ``step``."""
    g, h = gradient[rows].sum(), weight[rows].sum()
    best, choice = 1e-6, None
    if len(path) < DEPTH and len(rows) >= 2 * LEAF:
        for j, own in enumerate(cuts):
            if not len(own):
                continue
            bins = np.searchsorted(own, x[rows, j], "left")  # bin k: above the first k cuts
            gs, hs, ns = (np.bincount(bins, w, len(own) + 1).cumsum()[:-1] for w in (gradient[rows], weight[rows], None))
            ok = (ns >= LEAF) & (len(rows) - ns >= LEAF)
            gain = np.where(ok, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), 0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, choice = gain[k], (j, float(own[k]))
    if choice is None:
        step[rows] = g / (h + 1)
        return
    j, cut = choice
    above = x[rows, j] > cut
    for side in (False, True):
        rule = (*path, (j, side, cut))
        out.append(tuple(sorted(rule)))
        grow(x, cuts, gradient, weight, rows[above == side], rule, out, step)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, above, cut in rule:
        ok &= (x[:, j] > cut) == above
    return ok


def lasso(r: np.ndarray, y: np.ndarray, strength: float, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient."""
    w, b = np.zeros(r.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    v, c, t = w.copy(), b, 1.0
    rate = 4 * len(y) / max(1e-9, np.linalg.norm(np.c_[r, np.ones(len(y))], 2) ** 2)
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-(r @ v + c))) - y
        w2 = v - rate * (r.T @ e) / len(y)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * strength, 0)
        b2, t2 = c - rate * e.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b, w


class Ensemble:
    """Weighted rules over the features, in the order of FEATURES."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.rules: list[tuple[Rule, float]] = []
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.bias = float(np.log(share / (1 - share)))
        if not 0 < y.mean() < 1 if len(y) else True:
            return
        rng = np.random.default_rng(5)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, CUTS))) for j in range(x.shape[1])]
        found: list[Rule] = []
        score = np.full(len(y), self.bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            step, rows = np.zeros(len(y)), np.flatnonzero(rng.random(len(y)) < 0.7)
            some = [c if rng.random() < 0.7 else c[:0] for c in cuts]
            new: list[Rule] = []
            grow(x, some, y - p, p * (1 - p), rows, (), new, step)
            score += SHRINK * step
            found += new
        rules = list(dict.fromkeys(found))
        matrix = np.stack([holds(r, x) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
        _, first = np.unique(matrix, axis=1, return_index=True)
        rules, matrix = [rules[i] for i in sorted(first)], matrix[:, sorted(first)]
        if not rules:
            return
        inner = rng.random(len(y)) < 0.75
        best = None
        for strength in (0.01, 0.003, 0.001, 0.0003):
            b, w = lasso(matrix[inner], y[inner], strength)
            z = np.clip(matrix[~inner] @ w + b, -30, 30)
            loss = np.mean(np.log1p(np.exp(z)) - y[~inner] * z) if (~inner).any() else 0
            if best is None or loss < best[0] - 1e-4:
                best = (loss, strength)
        self.bias, w = lasso(matrix, y, best[1])
        self.rules = [(r, float(k)) for r, k in zip(rules, w, strict=True) if abs(k) > 1e-6]

    def column(self) -> Column:
        names, total = list(FEATURES), F.lit(float(self.bias))
        for rule, weight in self.rules:
            parts = [F.col(f"f_{names[j]}") > cut if above else F.col(f"f_{names[j]}") <= cut for j, above, cut in rule]
            test = parts[0]
            for p in parts[1:]:
                test = test & p
            total = total + F.when(test, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Ensemble:
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = usable.select("doc_id", F.col("quality").alias("_y")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(SAMPLE)
    rows = featured(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))  # ``sample`` has SAMPLE rows at most
    # of documents that share a doc_id the one of least statistics, so that at most SAMPLE rows come to the driver
    least = rows.groupBy("doc_id", "_y").agg(F.min(F.struct(*[f"f_{k}" for k in FEATURES])).alias("f"))
    data = np.array(sorted(tuple(r) for r in least.select("f.*", "_y").collect()), float).reshape(-1, len(FEATURES) + 1)
    return Ensemble(data[:, :-1], data[:, -1])


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """doc_id and ``score`` of every row."""
    rows = featured(docs.select("doc_id", "text")).select("doc_id", *[f"f_{k}" for k in FEATURES])
    return rows.select("doc_id", model.column().alias("score"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, fit(docs, documents(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))
