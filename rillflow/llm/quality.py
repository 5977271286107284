"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees of small depth are grown over statistics of a bounded sample of labelled documents. Every
path from a root becomes a conjunctive rule; a logistic regression with an L1 penalty keeps few of
them. The rules that remain are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm.common import bounded_batches, forget, fresh

#: Learning takes at most so many labelled rows, those with the smallest hashes of their ids.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, LEAF = 60, 3, 48, 20
PENALTIES = (1e-2, 3e-3, 1e-3, 3e-4, 1e-4)
CUTOFF = 0.3

#: Statistics of a text, in order; all are 0 for an empty text.
STATISTICS = (
    "bytes_log", "words_log", "word_length", "longest_word_log", "upper_words", "title_words", "capital_letters", "digits", "non_ascii",
    "spaces", "exclamations", "bars", "symbols", "symbol_runs", "full_stops", "commas", "brackets", "links", "distinct_words", "commonest_word",
    "distinct_pairs", "doubled_words", "lines_log", "distinct_lines", "short_lines", "bar_lines", "line_words", "entropy",
)

_SYMBOLS = np.frombuffer(b"#$%&*+=^~<>@_\\", np.uint8)
_RUNS = ("###", "***", "%%%", "$$$", "&&&", "!!", "???", "===", "---")


def statistics(text: str | None) -> list[float]:
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = count[count > 0] / n
    words = text.split()
    lines = text.split("\n")
    w, nl = max(len(words), 1), len(lines)
    common = Counter(words)
    own = Counter(map(len, words))
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), sum(k * c for k, c in own.items()) / w, float(np.log1p(max(own, default=0))),
        sum(map(str.isupper, words)) / w, sum(map(str.istitle, words)) / w, count[65:91].sum() / n, count[48:58].sum() / n, count[128:].sum() / n,
        (count[32] + count[9]) / n, count[33] / n, count[124] / n, count[_SYMBOLS].sum() / n, sum(map(text.count, _RUNS)) / w, count[46] / w, count[44] / w,
        (count[40] + count[41] + count[91] + count[93] + count[123] + count[125]) / n, (text.count("http") + text.count("www.")) / w,
        len(common) / w, max(common.values(), default=0) / w, len(set(zip(words, words[1:]))) / max(len(words) - 1, 1), sum(map(operator.eq, words, words[1:])) / w,
        float(np.log1p(nl)), len(set(lines)) / nl, sum(len(x) < 30 for x in lines) / nl, sum("|" in x for x in lines) / nl, len(words) / nl, float(-(share * np.log2(share)).sum()),
    ]


def _measured(name: str, df: DataFrame, text: str) -> DataFrame:
    kinds = [(s, pa.float64()) for s in STATISTICS]

    def measure(texts: pa.Array) -> pa.Array:
        forget()
        rows = np.array([statistics(t) for t in texts.to_pylist()], np.float64).reshape(len(texts), len(STATISTICS))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], fields=[pa.field(*k) for k in kinds])

    return df.withColumn(name, F.arrow_udf(measure, T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]))(F.col(text).cast("string")))


#: Conditions of a rule: statistic -> (above, at most); None is no bound.
Rule = tuple[tuple[int, float | None, float | None], ...]


@dataclass
class Rules:
    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.stack([_holds(r, x) for r in self.rules], 1).astype(float) if self.rules else np.zeros((len(x), 0))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.intercept + self.holds(x) @ np.array(self.weights))

    def column(self, measured: Column) -> Column:
        """The score as an expression over the struct of statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            terms = []
            for s, low, high in rule:
                c = measured[STATISTICS[s]]
                terms += ([c > F.lit(low)] if low is not None else []) + ([c <= F.lit(high)] if high is not None else [])
            both = terms[0]
            for t in terms[1:]:
                both = both & t
            total = total + F.when(both, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for s, low, high in rule:
        if low is not None:
            out &= x[:, s] > low
        if high is not None:
            out &= x[:, s] <= high
    return out


def _tree(binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rate: float) -> tuple[list[Rule], np.ndarray]:
    """A boosted regression tree: the rules of all its nodes below the root, and its step for each row."""
    rules: list[Rule] = []
    step = np.zeros(len(grad))

    def grow(rows: np.ndarray, bounds: dict, depth: int) -> None:
        g, h = grad[rows], hess[rows]
        best = (1e-6, -1, -1)
        if depth < DEPTH and len(rows) >= 2 * LEAF:
            for s in range(binned.shape[1]):
                b = binned[rows, s]
                width = len(cuts[s]) + 1
                if width < 2:
                    continue
                gl, hl, nl = (np.cumsum(np.bincount(b, v, width))[:-1] for v in (g, h, None))
                gr, hr = g.sum() - gl, h.sum() - hl
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
                gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), s, k)
        if best[1] < 0:
            step[rows] = rate * g.sum() / (h.sum() + 1)
            return
        _, s, k = best
        cut, left = float(cuts[s][k]), binned[rows, s] <= k
        for side, part in ((0, rows[left]), (1, rows[~left])):
            low, high = bounds.get(s, (None, None))
            own = bounds | {s: (low, cut) if side == 0 else (cut, high)}
            rules.append(tuple((f, *b) for f, b in sorted(own.items())))
            grow(part, own, depth + 1)

    grow(np.arange(len(grad)), {}, 0)
    return rules, step


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Logistic regression with an L1 penalty by accelerated proximal steps; column 0 is the intercept and isn't penalised."""
    n = len(y)
    v = np.ones(z.shape[1])
    for _ in range(12):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / float(v @ (z.T @ (z @ v)) * 1.02)
    w, ahead, t = start.copy(), start.copy(), 1.0
    for _ in range(rounds):
        new = ahead - rate * (z.T @ (_sigmoid(z @ ahead) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (before - 1) / t * (new - w)
        if np.abs(new - w).max() < 1e-5:
            w = new
            break
        w = new
    return w


def _loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(x: np.ndarray, y: np.ndarray) -> Rules:
    """Rules learnt from statistics `x` and labels `y` (0 or 1); without both labels, a constant."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Rules(float(np.log(p / (1 - p))))
    cuts = []
    for c in x.T:
        distinct = np.unique(c)
        at = np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        cuts.append(at[at < distinct[-1]])
    binned = np.stack([np.searchsorted(cut, c, side="left") for cut, c in zip(cuts, x.T)], 1)
    p = y.mean()
    margin, rules = np.full(len(y), np.log(p / (1 - p))), {}
    for _ in range(TREES):
        s = _sigmoid(margin)
        found, step = _tree(binned, cuts, y - s, s * (1 - s), 0.3)
        rules |= dict.fromkeys(found)
        margin += step
    ensemble = Rules(0.0, list(rules))
    z = ensemble.holds(x).astype(np.float64)
    _, keep = np.unique(z, axis=1, return_index=True)
    keep = np.sort(keep)
    ensemble.rules = [ensemble.rules[k] for k in keep]
    z = np.hstack([np.ones((len(y), 1)), z[:, keep]])
    # A fifth of the rows chooses the penalty.
    part = np.arange(len(y)) % 5 == 0
    start = np.zeros(z.shape[1])
    start[0] = np.log(p / (1 - p))
    best, w = (np.inf, PENALTIES[0]), start
    for penalty in PENALTIES:
        w = _lasso(z[~part], y[~part], penalty, w)
        best = min(best, (_loss(_sigmoid(z[part] @ w), y[part]), penalty))
    w = _lasso(z, y, best[1], w)
    kept = [k for k in range(len(ensemble.rules)) if w[k + 1]]
    return Rules(float(w[0]), [ensemble.rules[k] for k in kept], [float(w[k + 1]) for k in kept])


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Rules:
    """Rules from the labelled documents, at most `rows` of them; labels other than 0 and 1 and null keys don't count."""
    bounded_batches(docs.sparkSession)
    y = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    some = y.orderBy(F.xxhash64("k"), "k", "y").limit(rows)
    joined = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(some), "k")
    found = _measured("m", joined, "t").select("k", "y", "m.*").toPandas().sort_values(["k", "y", *STATISTICS])
    return fit(found[list(STATISTICS)].to_numpy(np.float64), found["y"].to_numpy(np.float64))


def scored(docs: DataFrame, rules: Rules, text: str = "text", into: str = "score") -> DataFrame:
    """`docs` with the score of each text in column `into` (renamed if taken). A null text counts as empty, whose statistics are all 0. No shuffle."""
    bounded_batches(docs.sparkSession)
    into, name = fresh(docs, into), fresh(docs, "measured")
    return _measured(name, docs, text).withColumn(into, rules.column(F.col(name))).drop(name)


def accepted(docs: DataFrame, rules: Rules, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of `docs` whose score is at least `cutoff`."""
    into = fresh(docs, "score")
    return scored(docs, rules, text, into).where(F.col(into) >= cutoff).select(*[f"`{c}`" for c in docs.columns])
