"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Counts of a whole text and their shares are Spark column expressions.  On a bounded sample of labelled documents, shallow
trees are boosted; every path from a root to a node becomes a rule (a conjunction of comparisons of
statistics), a lasso logistic regression weighs the rules, and the few rules with a weight are compiled back
into Spark column expressions.  Scoring is one scan without a shuffle and without Python.

Defined cases: null and empty texts have all statistics 0 and are scored like any other; with no labelled row
or with one class only, every score is the class's share (0.5 without labels); labels that are null are left
out; a doc_id with several labels or several texts is learnt from each distinct pair; an empty table gives no rows;
extra columns, also those named like statistics or results, have no effect.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import crc_bucket, fresh_names, hashed_sample
from weftgraph.llm.trees import Tree, fit_boosted

#: Distinct labelled rows that a model is fitted on at most: those with the smallest hash of their id.
SAMPLE_ROWS = 8_000
THRESHOLD = 0.3

Rule = tuple[tuple[str, str, float], ...]


#: Counts that are made of a text; the statistics are their shares of characters or of words.
COUNTS = ("chars", "spaces", "upper", "marks", "symbols", "bars", "digits", "stops", "repeats", "lines")


def counts(text: Column) -> Column:
    """What is counted in a whole text, as one struct."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    one = lambda c: (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double")
    made = (
        F.length(t).cast("double"), one(" ") + one("\n") + one("\t") + one("\r"), count(r"\p{Lu}"), count("[!?]"), count(r"[#$%&*+=<>@^_~|\\/{}\[\]]"), one("|"), count("[0-9]"), one("."),
        count(r"(?<!\S)(\S{1,64}) (?=\1(?!\S))"), one("\n"),
    )
    return F.struct(*[c.alias(n) for n, c in zip(COUNTS, made, strict=True)])


def statistics(counted: Column) -> dict[str, Column]:
    """Statistics by name from a struct of counts; shares of nothing are 0."""
    c = {n: counted[n] for n in COUNTS}
    words = F.when(c["chars"] > 0, c["spaces"] + 1).otherwise(0.0)
    by_char = lambda n: F.when(c["chars"] > 0, n / c["chars"]).otherwise(0.0)
    by_word = lambda n: F.when(c["chars"] > 0, n / (c["spaces"] + 1)).otherwise(0.0)
    return {
        "n_chars": c["chars"], "n_words": words, "word_length": by_word(c["chars"]), "upper": by_char(c["upper"]), "marks": by_char(c["marks"]), "symbols": by_char(c["symbols"]),
        "bars": by_word(c["bars"]), "digits": by_char(c["digits"]), "stops": by_word(c["stops"]), "repeats": by_word(c["repeats"]), "lines": by_word(c["lines"]),
    }


STATISTICS = ("n_chars", "n_words", "word_length", "upper", "marks", "symbols", "bars", "digits", "stops", "repeats", "lines")


@dataclass
class RuleModel:
    """sigmoid(intercept + sum of the weights of the rules that hold)."""

    intercept: float
    rules: list[tuple[Rule, float]]

    def column(self, stats: dict[str, Column]) -> Column:
        """The probability of label 1 as a Spark column over columns of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, op, value in rule:
                holds &= (stats[name] <= value) if op == "<=" else (stats[name] > value)
            total += F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def extract_rules(trees: list[Tree], names: tuple[str, ...]) -> list[Rule]:
    """Every distinct path from a root to a node below it, as a conjunction with one bound a side and statistic."""
    found: dict[Rule, None] = {}
    for tree in trees:
        stack: list[tuple[int, dict[tuple[str, str], float]]] = [(0, {})]
        while stack:
            at, bounds = stack.pop()
            if bounds:
                found[tuple((n, op, v) for (n, op), v in sorted(bounds.items()))] = None
            if tree.feature[at] >= 0:
                name, cut = names[tree.feature[at]], tree.threshold[at]
                up, down = bounds.get((name, "<="), math.inf), bounds.get((name, ">"), -math.inf)
                stack.append((tree.left[at], bounds | {(name, "<="): min(up, cut)}))
                stack.append((tree.right[at], bounds | {(name, ">"): max(down, cut)}))
    return list(found)


def _holds(rules: list[Rule], x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for name, op, value in rule:
            v = x[:, names.index(name)]
            out[:, j] *= (v <= value) if op == "<=" else (v > value)
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for mean logistic loss + penalty * |w|_1; the intercept is free."""
    n, m = z.shape
    mean = z.mean(axis=0)
    zc = z - mean
    step = 4.0 / (np.linalg.norm(np.concatenate([zc, np.ones((n, 1))], axis=1), 2) ** 2 / n + 1e-9)
    w, b, p = np.zeros(m), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), 1.0
    vw, vb = w, b
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(zc @ vw + vb, -30, 30))) - y
        nw = vw - step * (zc.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * r.mean()
        q = (1 + math.sqrt(1 + 4 * p * p)) / 2
        vw, vb = nw + (p - 1) / q * (nw - w), nb + (p - 1) / q * (nb - b)
        w, b, p = nw, nb, q
    return float(b - mean @ w), w


def fit_rules(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = STATISTICS, *, trees: int = 24, depth: int = 3, penalty: float = 5e-4, seed: int = 7) -> RuleModel:
    """Rules from boosted trees, weighed by lasso logistic regression."""
    share = float(y.mean()) if len(y) else 0.5
    flat = RuleModel(float(np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))), [])
    if not len(y) or y.min() == y.max():
        return flat
    boosted = fit_boosted(x, y, trees=trees, depth=depth, rate=0.2, least=max(5, len(y) // 500), features=0.6, rows=0.6, seed=seed)
    rules = extract_rules(boosted.trees, names)
    if not rules:
        return flat
    z = _holds(rules, x, names)
    kept, seen = [], set()
    for j in range(len(rules)):
        key = z[:, j].tobytes()
        if key not in seen and 0 < z[:, j].sum() < len(y):
            seen.add(key)
            kept.append(j)
    if not kept:
        return flat
    intercept, w = lasso_logistic(z[:, kept], y.astype(float), penalty)
    return RuleModel(intercept, [(rules[j], float(v)) for j, v in zip(kept, w, strict=True) if abs(v) > 1e-6])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 5, held_out: int = 0, sample: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most ``sample`` labelled rows whose crc32 bucket is not the held-out one."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & (crc_bucket("_id", modulus) != held_out))
    chosen = hashed_sample(known, "_id", sample)
    stats = statistics(F.col("_counts"))
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
        .join(F.broadcast(chosen), "_id")  # at most ``sample`` ids
        .select("_y", "_id", _kept_apart(counts(F.col("_t"))).alias("_counts"))
        .select("_y", "_id", *[stats[n].alias(n) for n in STATISTICS])
        .distinct()  # an id that repeats, however often, is learnt from once a text
        .orderBy(F.xxhash64("_id"), "_id", "_y", *STATISTICS)
        .limit(sample)
        .toPandas()
    )
    return fit_rules(rows[list(STATISTICS)].to_numpy(float), (rows["_y"].to_numpy() > 0).astype(float))


def _kept_apart(column: Column) -> Column:
    """The column as a generator's only row, so that the optimizer computes it once and copies it into no rule or filter."""
    return F.explode(F.array(column))


def score(docs: DataFrame, model: RuleModel, *, text_col: str = "text", out: str = "score", threshold: float = THRESHOLD, flag: str = "predicted") -> DataFrame:
    """All columns of ``docs`` plus the score and 0 or 1; columns of these names are replaced."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (out, flag)]
    (inside,) = fresh_names(docs, "_counts")
    inner = docs.select(*kept, _kept_apart(counts(F.col(text_col))).alias(inside))
    scored = inner.select(*kept, model.column(statistics(F.col(inside))).alias(out))
    return scored.withColumn(flag, (F.col(out) >= threshold).cast("int"))
