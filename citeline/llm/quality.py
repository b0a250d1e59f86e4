"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins by its quantiles. Boosting goes round the features
in turn; a step fits a tree of a few leaves to the gradient over one feature's
bins and adds a small part of it to that feature's lookup table. Then the pairs
that explain most of what is left get tables over two coarser binnings, boosted
in the same way. A score is the logistic of a sum of table entries.

Features of all documents are made by Spark. The model is fitted on the driver
on a bounded sample of the labelled rows: at most about ``TRAIN_ROWS``, chosen
by a hash of the id, all of them where there are fewer.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.llm import features as fe
from citeline.llm.columns import add_struct
from citeline.llm.tables import store
from citeline.llm.words import bounded_batches

#: Labelled rows that the model is fitted on, about, at most.
TRAIN_ROWS = 20_000
#: Score from which a text counts as good.
THRESHOLD = 0.3
FOLDS = 5

BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST = 60, 30, 0.15, 3, 5.0
RESULT = "struct<score:double,predicted:int>"


@dataclass
class Model:
    """Cuts and lookup tables; ``pairs`` are (feature, feature, table)."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = _binned(x, self.cuts)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[bins[j]]
        rough = _binned(x, self.coarse)
        for i, j, table in self.pairs:
            total += table[rough[i], rough[j]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    at = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(column, at)) for column in x.T]


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
    return [np.searchsorted(cut, column, side="left") for cut, column in zip(cuts, x.T, strict=True)]


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Step by bin of a tree with at most LEAVES leaves over ordered bins, where
    g and h are sums of gradients and curvatures by bin."""
    leaves = [(0, len(g))]

    def gain(a, b):
        left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        all_g, all_h = g[a:b].sum(), h[a:b].sum()
        right_g, right_h = all_g - left_g, all_h - left_h
        won = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - all_g**2 / (all_h + 1)
        won[(left_h < LEAST / 8) | (right_h < LEAST / 8)] = 0
        return (won.max(), a + 1 + int(won.argmax())) if len(won) else (0.0, a)

    while len(leaves) < LEAVES:
        best = max((*gain(a, b), a, b) for a, b in leaves)
        if best[0] <= 1e-9:
            break
        leaves.remove(best[2:])
        leaves += [(best[2], best[1]), (best[1], best[3])]
    step = np.zeros(len(g))
    for a, b in leaves:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return step


def _cell_step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Step of a tree of depth two over a grid: a cut of each axis."""
    best, step = 0.0, np.zeros_like(g)
    left = np.cumsum(np.cumsum(np.stack([g, h]), axis=1), axis=2)
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            top, side, corner, whole = (
                left[:, a - 1, -1], left[:, -1, b - 1], left[:, a - 1, b - 1], left[:, -1, -1]
            )
            four = np.stack([corner, top - corner, side - corner, whole - top - side + corner])
            won = (four[:, 0] ** 2 / (four[:, 1] + 1)).sum()
            if won > best:
                best = won
                values = four[:, 0] / (four[:, 1] + 1)
                step = np.zeros_like(g)
                step[:a, :b], step[:a, b:], step[a:, :b], step[a:, b:] = values
    return step


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on features ``x`` (a row each) and labels ``y`` (0 or 1). Without
    rows of both kinds the model gives the share of label 1 to every text,
    and 0.5 without rows."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    width = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        empty = [np.empty(0)] * width
        return Model(base, empty, [np.zeros(1)] * width, empty, [])
    cuts, coarse = _cuts(x, BINS), _cuts(x, PAIR_BINS)
    bins, rough = _binned(x, cuts), _binned(x, coarse)
    tables = [np.zeros(len(cut) + 1) for cut in cuts]
    total = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = slopes()
            size = len(tables[j])
            step = RATE * _tree(
                np.bincount(bins[j], g, minlength=size), np.bincount(bins[j], h, minlength=size)
            )
            tables[j] += step
            total += step[bins[j]]

    def grid(i, j, values):
        n, m = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(rough[i] * m + rough[j], values, minlength=n * m).reshape(n, m)

    g, h = slopes()
    worth = []
    for i in range(width):
        for j in range(i + 1, width):
            gg, hh = grid(i, j, g), grid(i, j, h)
            worth.append((float((gg**2 / (hh + 1)).sum()), i, j))
    pairs = [
        (i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)))
        for _, i, j in sorted(worth, reverse=True)[:PAIRS]
    ]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            g, h = slopes()
            step = RATE * _cell_step(grid(i, j, g), grid(i, j, h))
            table += step
            total += step[rough[i], rough[j]]
    return Model(base, cuts, tables, coarse, pairs)


def held_out(doc_id: str) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, mod 5, is 0.
    A null id is never trained on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(True))


def add_features(docs: DataFrame, text: str = "text", into: str = "counts") -> DataFrame:
    return add_struct(docs, text, into, fe.COUNTS_KIND, lambda: fe.counts_array)


def train(
    featured: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    label: str = "quality",
    rows: int = TRAIN_ROWS,
    into: str = "counts",
) -> Model:
    """The model fitted on the labelled rows of ``featured`` (see add_features)
    that are not held out. A document labelled more than once counts with its
    largest label; null labels are left out."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .where(~held_out(doc_id))
        .groupBy(F.col(doc_id).alias("id"))
        .agg(F.max(label).cast("int").alias("y"))
    )
    size = known.count()
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / max(1, size)))
    features = featured.select(F.col(doc_id).alias("id"), F.col(f"`{into}`.*"))
    sample = known.where(part).join(features, "id").toPandas().sort_values(["id", *fe.COUNTS])
    x = fe.rates({name: sample[name].to_numpy(dtype=np.int64) for name in fe.COUNTS})
    return fit(x, sample["y"].to_numpy(dtype=np.float64))


def _result(model: Model, counted: dict[str, np.ndarray], threshold: float) -> pa.Array:
    score = model.score(fe.rates(counted))
    return pa.StructArray.from_arrays(
        [pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["score", "predicted"]
    )


def add_score(
    docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, into: str = "quality"
) -> DataFrame:
    """``docs`` with a struct ``into``: score (0 to 1, higher is better) and
    predicted (1 from ``threshold``), straight from the texts.

    Null and empty texts have the features of no words, and a score like any
    other. Copies get equal scores. A column called ``into`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda data, offsets: _result(sent.value, fe.counts(data, offsets), threshold)

    return add_struct(docs, text, into, RESULT, make)


def score_features(featured: DataFrame, model: Model, doc_id: str = "doc_id", into: str = "counts") -> DataFrame:
    """(doc_id, score, predicted) from features already made."""
    sent = featured.sparkSession.sparkContext.broadcast(model)
    narrow = featured.select(doc_id, into)
    kind = narrow.select(doc_id).schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        for batch in batches:
            result = _result(sent.value, fe.counts_of(batch.column(1)), THRESHOLD)
            yield pa.RecordBatch.from_arrays([batch.column(0), *result.flatten()], schema=None, names=kind.names)

    return bounded_batches(narrow).mapInArrow(run, kind)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    featured = store(add_features(docs.select(doc_id, text), text).drop(text))
    scored = score_features(featured, train(featured, labels, doc_id), doc_id)
    return scored.select(doc_id, held_out(doc_id).alias("held_out"), "score", "predicted")
