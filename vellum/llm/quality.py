"""A quality classifier as a sparse rule ensemble.

Statistics of every whole text are Spark column expressions. Boosted shallow trees over a bounded
sample of labelled rows give conjunctive rules (every path from a root to a node), a lasso-
penalised logistic regression keeps few of them, and what it keeps is compiled back into one column
expression, so that scoring all rows runs no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.text import WORD
from vellum.session import checkpoint

#: Labelled rows that the fit takes, about: those whose hash lies below the share that this makes.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, SEED, LEAF_ROWS = 40, 3, 24, 3, 15
PENALTIES = (0.06, 0.03, 0.015, 0.008, 0.004, 0.002)


def text_statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text; those of null are those of the empty text."""
    t = F.coalesce(text, F.lit(""))
    size, words = F.greatest(F.length(t), F.lit(1)).cast("double"), F.regexp_count(t, F.lit(WORD)).cast("double")
    least_one = F.greatest(words, F.lit(1.0))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    removed = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("double")
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    split = F.split(t, r"\s+")
    return {
        "words": words,
        "chars_per_word": size / least_one,
        "distinct_words": F.size(F.array_distinct(split)) / least_one,
        "adjacent_repeats": count(r"(?<!\S)(\S+)\s\1(?!\S)") / least_one,
        "symbols": removed("#$%&*+<=>@\\^_`{|}~/[]") / size,
        "bars": removed("|") / least_one,
        "points": removed(".,;:!?") / least_one,
        "upper": removed(upper) / least_one,
        "digits": removed(digits) / size,
        "lines": (removed("\n") + 1) / least_one,
        "distinct_lines": F.size(F.array_distinct(F.split(t, "\n"))) / (removed("\n") + 1),
        "short_words": count(r"(?<!\S)\S{1,3}(?!\S)") / least_one,
        "long_words": count(r"\S{14,}") / least_one,
    }


Condition = tuple[str, bool, float]  # a statistic, whether it must be above, and the threshold


@dataclass
class RuleModel:
    """A logistic model over conjunctions of thresholds."""

    bias: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def column(self, at: Callable[[str], Column] = F.col) -> Column:
        """The score, 0 to 1, as a column expression."""
        total = F.lit(float(self.bias))
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for name, above, threshold in conditions:
                holds = holds & ((at(name) > threshold) if above else (at(name) <= threshold))
            total = total + F.when(holds, float(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _tree(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, path: tuple, names: Sequence[str], out: list, value: np.ndarray) -> None:
    """Grows one tree by the gain of squared gradients; every node below the root adds its path."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    value[rows] = g / (h + 1.0)
    if path:
        out.append(path)
    least = max(2, min(LEAF_ROWS, len(value) // 32))  # of a leaf; few labels ask for small leaves
    if depth == 0 or len(rows) < 2 * least:
        return
    best = None
    for j, cut in enumerate(cuts):
        if not len(cut):
            continue
        sums = [np.cumsum(np.bincount(binned[rows, j], w, len(cut) + 1))[:-1] for w in (gradient[rows], hessian[rows], np.ones(len(rows)))]
        gl, hl, nl = sums
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1)
        gain[(nl < least) | (len(rows) - nl < least)] = -1
        k = int(gain.argmax())
        if gain[k] > g**2 / (h + 1) + 1e-6 and (best is None or gain[k] > best[0]):
            best = (gain[k], j, k)
    if best is None:
        return
    _, j, k = best
    low = binned[rows, j] <= k
    for part, above in ((rows[low], False), (rows[~low], True)):
        _tree(x, cuts, binned, gradient, hessian, part, depth - 1, (*path, (names[j], above, float(cuts[j][k]))), names, out, value)


def _simplify(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """One threshold for each statistic and direction."""
    kept: dict[tuple[str, bool], float] = {}
    for name, above, threshold in path:
        old = kept.get((name, above))
        kept[name, above] = threshold if old is None else (max if above else min)(old, threshold)
    return tuple(sorted((n, a, t) for (n, a), t in kept.items()))


def _holds(rule: tuple[Condition, ...], x: np.ndarray, names: Sequence[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, threshold in rule:
        column = x[:, names.index(name)]
        out &= column > threshold if above else column <= threshold
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated proximal gradient steps on standardised columns."""
    mean, scale = z.mean(0), z.std(0) + 1e-9
    z = (z - mean) / scale
    n, d = z.shape
    size = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1.0) if d else 1.0
    w, b, v, c, t = np.zeros(d), 0.0, np.zeros(d), 0.0, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30)))
        step = v - size * (z.T @ (p - y) / n)
        new, bias = np.sign(step) * np.maximum(np.abs(step) - size * penalty, 0), c - size * float((p - y).mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), bias + (t - 1) / t2 * (bias - b)
        w, b, t = new, bias, t2
    return b - float((w * mean / scale).sum()), w / scale


def fit_rules(x: np.ndarray, y: np.ndarray, names: Sequence[str], trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> RuleModel:
    """Rules from boosted trees, weighed by lasso at the penalty that a fifth of the rows likes best."""
    if not len(y) or y.min() == y.max():
        rate = (float(y.sum()) + 1.0) / (len(y) + 2.0)
        return RuleModel(float(np.log(rate / (1 - rate))), [])
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(cut, c, "left") for cut, c in zip(cuts, x.T)], axis=1)
    margin, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        value = np.zeros(len(y))
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        _tree(x, cuts, binned, y - p, p * (1 - p), rows, depth, (), names, paths, value)
        margin[rows] += 0.3 * value[rows]
    rules = list(dict.fromkeys(_simplify(p) for p in paths))
    if not rules:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), [])
    z = np.stack([_holds(r, x, names) for r in rules], axis=1).astype(np.float64)
    _, first = np.unique(z, axis=1, return_index=True)  # rules that hold on the same rows are one
    rules, z = [rules[i] for i in sorted(first)], z[:, sorted(first)]
    held = rng.random(len(y)) < 0.2
    if held.sum() < 10:  # too few to choose by
        held[:] = True
    tried = []
    for penalty in PENALTIES:
        b, w = lasso_logistic(z[~held], y[~held], penalty) if not held.all() else lasso_logistic(z, y, penalty)
        s = np.clip(z[held] @ w + b, -30, 30)
        loss = np.logaddexp(0, s) - y[held] * s
        tried.append((float(loss.mean()), float(loss.std() / np.sqrt(max(1, len(loss)))), penalty))
    # the sparsest model whose loss lies within a standard error of the least
    least, error, _ = min(tried)
    b, w = lasso_logistic(z, y, max(p for loss, _, p in tried if loss <= least + error))
    return RuleModel(b, [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, RuleModel]:
    """(doc_id, held_out, score, predicted) for every row, and the model.

    Rows whose crc32(id as text) mod 3 is 1 are held out of the fit. Labels other than 0 and 1 are
    no labels; an id that repeats among the labels counts once if they agree and else not at all.
    Null and empty texts have the statistics of the empty text; a null id is not held out and has
    no label; without labels every score is the same.
    """
    stats = text_statistics(F.col(text_col))
    names = list(stats)
    rows = checkpoint(docs.select(F.col(id_col).alias("doc_id"), *(c.alias(n) for n, c in stats.items())))
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("low"), F.max(label_col).alias("y")).where("low = y")
    # a hash of the id says which rows the sample has, so no sort and no more than the sample moves
    share = min(1.0, sample_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = rows.where(~fold).join(known, "doc_id").select("doc_id", "y", *names).toPandas().sort_values(["doc_id", *names])
    model = fit_rules(sample[names].to_numpy(np.float64), sample["y"].to_numpy(np.float64), names)
    score = model.column()
    out = rows.select("doc_id", fold.alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), model
