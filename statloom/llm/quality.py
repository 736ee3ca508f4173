"""Quality classifier: a sparse rule ensemble compiled to column expressions.

Boosted shallow trees over text statistics give candidate rules: every path
from a root to a node is a conjunction of comparisons. A lasso logistic
regression keeps few of them. The kept rules become one Spark column, so
scoring is a projection over the scan.

Only the fit is on the driver, over at most ``MOST_LABELS`` labelled rows of
about twenty numbers each; the choice of these rows is by hash and the same at
every size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit takes at most.
MOST_LABELS = 8_000
#: Trees, their depth, the least rows of a leaf, and thresholds tried per statistic.
TREES, DEPTH, LEAF, STEPS = 25, 3, 10, 24

# Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in is it that was for on with as be at by this from are not have has you he his they were which or an a "
    "der die das und ist von zu den mit des im ein eine nicht auf für sich dem als auch "
    "le la les de des et en un une est que qui dans pour pas sur au du ce il elle "
    "el los las y que en un una es por con para no se del al lo su como"
).split()


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a whole text, all native expressions; null counts as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.length(t)
    count = lambda cls: n - F.length(F.regexp_replace(t, f"[{cls}]+", ""))
    words = F.split(F.regexp_replace(F.lower(t), r"[\x20\x09-\x0D]+", " "), " ")
    lines = F.split(t, "\n")
    chars, n_words = F.greatest(n, F.lit(1)), F.greatest(F.size(words), F.lit(1))
    n_lines = F.greatest(F.size(lines), F.lit(1))
    stops = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    distinct = F.array_distinct(words)
    return {
        "log_chars": F.log1p(n.cast("double")),
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": n / n_words,
        "upper": count(r"\p{Lu}") / chars,
        "letters": count(r"\p{L}") / chars,
        "digits": count(r"0-9") / chars,
        "space": count(r"\x20\x09-\x0D") / chars,
        "stops_dots": count(r".,;:?") / chars,
        "signs": count(r"#$%&*+<=>@\\^_`|~{}\[\]/") / chars,
        "bangs": count(r"!") / chars,
        "distinct_words": F.size(distinct) / n_words,
        "stop_kinds": F.size(F.array_intersect(distinct, stops)) / F.greatest(F.sqrt(F.size(words).cast("double")), F.lit(1.0)),
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_words": F.log1p(n_words / n_lines),
        "log_lines": F.log1p(n_lines.cast("double")),
    }


def _tree(x: np.ndarray, steps: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: tuple, found: list, value: np.ndarray) -> None:
    """Grow one tree on a gradient; ``found`` gets the path of every node, ``value`` the leaf values."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None)
    if len(path) < DEPTH:
        for j, cut in enumerate(steps):
            at = np.searchsorted(cut, x[rows, j], side="left")  # at <= c: x <= cut[c]
            gs = np.cumsum(np.bincount(at, grad[rows], len(cut) + 1))[:-1]
            hs = np.cumsum(np.bincount(at, hess[rows], len(cut) + 1))[:-1]
            ns = np.cumsum(np.bincount(at, minlength=len(cut) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < LEAF) | (len(rows) - ns < LEAF)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (j, float(cut[int(gain.argmax())])))
    if path:
        found.append(path)
    if best[1] is None:
        value[rows] = -g / (h + 1)
        return
    j, c = best[1]
    low = x[rows, j] <= c
    _tree(x, steps, grad, hess, rows[low], (*path, (j, True, c)), found, value)
    _tree(x, steps, grad, hess, rows[~low], (*path, (j, False, c)), found, value)


def _holds(path: tuple, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] <= c) == low for j, low, c in path])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _step(r: np.ndarray) -> float:
    """A safe gradient step: four over the largest curvature, by power iteration."""
    v = np.ones(r.shape[1] + 1)
    for _ in range(30):
        z = r @ v[:-1] + v[-1]
        v = np.append(r.T @ z, z.sum()) / len(r)
        most = np.linalg.norm(v)
        v /= most
    return 3.6 / most


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, w: np.ndarray, b: float, step: float, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient."""
    n = len(y)
    u, v, t = w.copy(), b, 1.0
    for _ in range(rounds):
        e = (_sigmoid(r @ u + v) - y) / n
        z = u - step * (r.T @ e)
        nw, nb = np.sign(z) * np.maximum(np.abs(z) - step * penalty, 0), v - step * e.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, v = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


@dataclass
class RuleModel:
    """``score = sigmoid(bias + sum of weights of the rules that hold)``."""

    names: list[str]
    rules: list[tuple] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    def score(self, stats: dict[str, Column]) -> Column:
        """The compiled score over columns of the named statistics."""
        total = F.lit(float(self.bias))
        for path, w in zip(self.rules, self.weights):
            test = None
            for j, low, c in path:
                one = stats[self.names[j]] <= F.lit(c) if low else stats[self.names[j]] > F.lit(c)
                test = one if test is None else test & one
            total = total + F.when(test, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The same score over a matrix of statistics."""
        z = np.full(len(x), self.bias)
        for path, w in zip(self.rules, self.weights):
            z += w * _holds(path, x)
        return _sigmoid(z)


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    """Fit on a matrix of statistics and 0/1 labels. One class or no rows: a constant score."""
    p = float((y.sum() + 0.5) / (len(y) + 1))
    if len(set(y.tolist())) < 2:
        return RuleModel(names, bias=float(np.log(p / (1 - p))))
    steps = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, STEPS + 2)[1:-1])) for j in range(x.shape[1])]
    z, paths = np.full(len(y), np.log(p / (1 - p))), []
    for _ in range(TREES):
        q = _sigmoid(z)
        value = np.zeros(len(y))
        _tree(x, steps, q - y, q * (1 - q), np.arange(len(y)), (), paths, value)
        z = z + 0.3 * value
    kinds: dict[bytes, tuple] = {}
    for path in paths:
        held = np.packbits(_holds(path, x)).tobytes()
        if held not in kinds or len(path) < len(kinds[held]):
            kinds[held] = path
    rules = list(kinds.values())
    r = np.stack([_holds(path, x) for path in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    test = np.arange(len(y)) % 5 == 0
    top = float(np.abs(r.T @ (y - p)).max() / len(y)) if rules else 0.0
    step = _step(r) if rules else 1.0
    tried, w, b = [], np.zeros(len(rules)), float(np.log(p / (1 - p)))
    for penalty in top * np.geomspace(0.3, 0.002, 8):
        w, b = _lasso(r[~test], y[~test], penalty, w, b, step)
        q = np.clip(_sigmoid(r[test] @ w + b), 1e-9, 1 - 1e-9)
        each = -(y[test] * np.log(q) + (1 - y[test]) * np.log(1 - q))
        tried.append((each.mean(), each.std() / np.sqrt(max(len(each), 1)), penalty))
    # the sparsest rules within one standard error of the best
    bar = sum(min(tried)[:2]) if tried else 0.0
    best = max((p for loss, _, p in tried if loss <= bar), default=0.0)
    w, b = _lasso(r, y, best, np.zeros(len(rules)), b, step)
    kept = [i for i in range(len(rules)) if abs(w[i]) > 1e-3]
    # the chosen rules once more with little shrinkage, so that scores reach 0 and 1
    w, b = _lasso(r[:, kept], y, 0.002 * top, w[kept], b, step, 400)
    chosen = [(rules[i], round(float(v), 6)) for i, v in zip(kept, w) if abs(v) > 1e-3]
    return RuleModel(names, [path for path, _ in chosen], [v for _, v in chosen], round(float(b), 6))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from every fit."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> RuleModel:
    """Learn from labelled rows that are not held out.

    Takes the ``most`` labelled doc_ids of least hash. Rows without a label or
    doc_id, and labels that contradict each other for a doc_id, are left out.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
        .select(F.col("doc_id").alias("label_id"), "quality").orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    )
    stats = statistics(F.col("text"))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    got = rows.select("label_id", F.xxhash64("text").alias("tag"), F.col("quality").cast("double"), *[c.cast("double").alias(k) for k, c in stats.items()]).collect()
    one = {r[0]: r for r in sorted(got, key=lambda r: r[:2], reverse=True)}  # the least tag of a repeated doc_id
    x = np.array([r[1:] for r in sorted(one.values(), key=lambda r: (r[1], r[0]))], dtype=float).reshape(-1, len(stats) + 2)
    return fit_rules(x[:, 2:], x[:, 1], list(stats))


def score(docs: DataFrame, model: RuleModel, at: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 if score >= ``at``).

    Every row keeps its columns; null and empty texts get the score of an empty
    text. Columns of these two names are replaced.
    """
    stats = statistics(F.col("text"))
    own = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    row = "__row"
    while row in docs.columns:
        row += "_"
    # the row number keeps the optimizer from copying the statistics into every rule of a later filter
    inner = docs.select(*own, F.monotonically_increasing_id().alias(row), *[c.cast("double").alias(f"__stat_{k}") for k, c in stats.items()])
    value = model.score({k: F.col(f"__stat_{k}") for k in stats})
    scored = inner.select(*own, F.when(F.col(row) >= 0, value).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= at).cast("int"))
