"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a few numbers, each cut into bins.  Boosting goes round the
features again and again and fits a shallow tree on one feature at a time, which
is added to that feature's lookup table; then the pairs of features that explain
most of what is left get tables of their own, learned likewise.  A text's score
is the logistic of the sum of its bins' entries.

Labels come from a bounded sample of documents that are not held out.  Their
features, not their texts, reach the driver, where the tables are fitted.

Null and empty texts have all features 0 and are scored like any text.  Repeated
rows score alike; repeated labels of a document count once, the highest.  Ties
between trees go to the first feature and the lowest cut.  Without labels of both
kinds the score is the share of good ones, one half without any.  An empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from itertools import combinations, groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.batches import CONTINUATION, WHITE_SPACE, Texts, bounded_sample, quoted, remainder, with_struct
from threatloom.llm.quality_rules import SYMBOLS, repeated_words

HELD_OUT_OF, HELD_OUT_IS = 3, 1
FEATURES = (
    "log_words",
    "word_length",
    "symbols",
    "upper_case",
    "digits",
    "stops",
    "exclamations",
    "beyond_ascii",
    "repeated_words",
    "repeated_lines",
    "distinct_words",
    "longest_run",
    "line_length",
    "open_lines",
    "compressed",
)
# fixed values: classes of bytes
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_STOPS = b".,;:?"
_ASCII = bytes(range(128))


@dataclass(frozen=True)
class GamParams:
    """``rows`` bounds the labelled sample; ``rounds`` and ``rate`` are those of boosting."""

    rows: int = 8192
    bins: int = 32
    pair_bins: int = 8
    pairs: int = 6
    rounds: int = 150
    pair_rounds: int = 60
    rate: float = 0.1
    ridge: float = 2.0


def features(text: bytes) -> list[float]:
    """One number for each name in FEATURES."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    lines = [line for line in text.split(b"\n") if line.strip(WHITE_SPACE)]

    def share(of: bytes) -> float:
        return (size - len(text.translate(None, of))) / size

    letters = len(text.translate(None, WHITE_SPACE + CONTINUATION))
    run = max(sum(1 for _ in same) for _, same in groupby(words))
    return [
        float(np.log1p(n)),
        letters / n,
        share(SYMBOLS),
        share(_UPPER),
        share(_DIGITS),
        share(_STOPS),
        share(b"!"),
        1 - share(_ASCII),
        repeated_words(words) / n,
        1 - len(set(lines)) / len(lines),
        len(set(words)) / n,
        run / n,
        float(np.log1p(letters / len(lines))),
        sum(not line.rstrip(WHITE_SPACE).endswith((b".", b"!", b"?")) for line in lines) / len(lines),
        len(zlib.compress(text, 1)) / size,
    ]


@dataclass
class Gam:
    """Lookup tables: one per feature, one per chosen pair, and a constant."""

    params: GamParams
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    constant: float = 0.0

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray, params: GamParams) -> Gam:
        model = cls(params)
        if not len(labels):
            return model
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        model.constant = float(np.log(share / (1 - share)))
        if not 0 < labels.sum() < len(labels):
            return model
        model.cuts = [_cuts(column, params.bins) for column in rows.T]
        model.pair_cuts = [_cuts(column, params.pair_bins) for column in rows.T]
        model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
        binned = model._binned(rows, model.cuts)
        margin = np.full(len(labels), model.constant)
        for _ in range(params.rounds):
            for table, place in zip(model.tables, binned, strict=True):
                gradient, weight = _slopes(margin, labels)
                size = len(table)
                step = params.rate * best_step(np.bincount(place, gradient, size), np.bincount(place, weight, size), params.ridge)
                table += step
                margin += step[place]
        coarse = model._binned(rows, model.pair_cuts)
        model.pairs = _strongest_pairs(coarse, *_slopes(margin, labels), params)
        model.pair_tables = [np.zeros((len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1)) for i, j in model.pairs]
        for _ in range(params.pair_rounds):
            for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
                g, h = (_grid(coarse[i], coarse[j], v, table.shape) for v in _slopes(margin, labels))
                step = params.rate * best_quadrants(g, h, params.ridge)[0]
                table += step
                margin += step[coarse[i], coarse[j]]
        return model

    @staticmethod
    def _binned(rows: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, column, side="right") for c, column in zip(cuts, rows.T, strict=True)]

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Sums of table entries, all rows at once."""
        total = np.full(len(rows), self.constant)
        for table, place in zip(self.tables, self._binned(rows, self.cuts) if self.tables else [], strict=True):
            total += table[place]
        coarse = self._binned(rows, self.pair_cuts) if self.pairs else []
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[i], coarse[j]]
        return total

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -40, 40)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Borders of bins that hold about as many rows each; fewer where values repeat."""
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _slopes(margin: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the log-likelihood."""
    p = 1 / (1 + np.exp(-margin))
    return labels - p, p * (1 - p)


def best_step(gradient: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """The tree of two cuts over bins that gains most, as a value for each bin."""
    step, pieces = np.zeros(len(gradient)), [(0, len(gradient))]
    for _ in range(2):
        options = []
        for low, high in pieces:
            if high - low > 1:
                g, h = np.cumsum(gradient[low:high]), np.cumsum(weight[low:high])
                gain = g[:-1] ** 2 / (h[:-1] + ridge) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge)
                gain -= g[-1] ** 2 / (h[-1] + ridge)
                options.append((float(gain.max()), -low, low + 1 + int(gain.argmax()), high))
        if not options:
            break
        _, low, cut, high = max(options)
        pieces.remove((-low, high))
        pieces += [(-low, cut), (cut, high)]
    for low, high in pieces:
        step[low:high] = gradient[low:high].sum() / (weight[low:high].sum() + ridge)
    return step


def _grid(one: np.ndarray, two: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return np.bincount(one * shape[1] + two, values, shape[0] * shape[1]).reshape(shape)


def best_quadrants(gradient: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The cut of both features into four quadrants that gains most: a value for each cell, and the gain."""
    step = np.zeros_like(gradient)
    if min(gradient.shape) < 2:
        return step, 0.0

    def quadrants(cells: np.ndarray) -> np.ndarray:
        run = cells.cumsum(0).cumsum(1)
        corner, right, below = run[:-1, :-1], run[:-1, -1:], run[-1:, :-1]
        return np.stack([corner, right - corner, below - corner, run[-1, -1] - right - below + corner])

    g, h = quadrants(gradient), quadrants(weight)
    gain = (g**2 / (h + ridge)).sum(0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = g[:, i, j] / (h[:, i, j] + ridge)
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = values
    return step, float(gain.max() - gradient.sum() ** 2 / (weight.sum() + ridge))


def _strongest_pairs(coarse: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, params: GamParams) -> list[tuple[int, int]]:
    """The pairs of features with the largest gain left."""
    sizes = [int(c.max()) + 1 for c in coarse]
    gains = []
    for i, j in combinations(range(len(coarse)), 2):
        shape = (sizes[i], sizes[j])
        cells = (_grid(coarse[i], coarse[j], v, shape) for v in (gradient, weight))
        gains.append((-best_quadrants(*cells, params.ridge)[1], i, j))
    return [(i, j) for gain, i, j in sorted(gains)[: params.pairs] if gain < 0]


def labelled_sample(labels: DataFrame, params: GamParams) -> DataFrame:
    """(doc_id, quality) of at most ``rows`` documents that may be learned from."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    rows = rows.where(remainder(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT_IS)
    rows = rows.groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    return bounded_sample(rows, "doc_id", params.rows)


def fit_gam(docs: DataFrame, labels: DataFrame, params: GamParams = GamParams()) -> Gam:
    sample = F.broadcast(labelled_sample(labels, params))
    rows = docs.select("doc_id", "text").join(sample, "doc_id")

    def make():
        return lambda texts: [[features(t) for t in texts]]

    found, name = with_struct(rows, "text", "values array<double>", make, ["doc_id", "quality"])
    read = found.select("doc_id", "quality", f"{name}.values").dropDuplicates(["doc_id"]).collect()
    read.sort(key=lambda r: r[0])
    values = np.array([r[2] for r in read], float).reshape(len(read), len(FEATURES))
    return Gam.fit(values, np.array([r[1] for r in read], float), params)


def score_quality(docs: DataFrame, model: Gam, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """Columns ``keep`` (all by default) and a struct with the score; its name."""

    def make():
        def score(texts: Texts) -> list:
            rows = np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            return [model.scores(rows)]

        return score

    return with_struct(docs, "text", "score double", make, docs.columns if keep is None else keep)


def quality_report(docs: DataFrame, labels: DataFrame, params: GamParams = GamParams()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    scored, name = score_quality(docs, fit_gam(docs, labels, params), ["doc_id"])
    held_out = F.coalesce(remainder(F.col(quoted("doc_id")), HELD_OUT_OF) == HELD_OUT_IS, F.lit(False))
    score = F.col(f"{name}.score")
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
