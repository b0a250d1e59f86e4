"""Quality rules, with an isolation forest over their statistics.

Hard rules come first. Beyond them a forest of random trees, grown on small
samples of all documents, isolates unusual combinations of rule statistics: the
shorter the mean path to a text, the more anomalous it is. The threshold is
calibrated from all labelled rows: the one with the least sum of the share of
good texts rejected and the share of bad texts kept.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeline.llm import features as fe
from citeline.llm.columns import add_struct
from citeline.llm.tables import store
from citeline.llm.words import bounded_batches

TREES, SAMPLE = 100, 256
#: Steps of the score that the calibration tells apart.
STEPS = 2000
#: Threshold where there are no labels of both kinds.
FALLBACK = 0.65
LEAST_WORDS, REPEAT_PERCENT = 10, 20

#: Rates that do not grow with the length of a text and that good texts share:
#: the more inputs a forest has on which good texts differ among themselves, the
#: more of them it takes for anomalies. Repeated lines are among them as the hard
#: rules only see those of five words or more.
USED = ("word_length", "symbols", "dup_lines", "repeats", "bangs", "bars", "twins")


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays of (tree, node); a leaf has feature -1 and its path length."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly, 0 to 1: towards 1 for short paths."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = self.feature[t][node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= self.cut[t][node]
                node = np.where(inner, self.left[t][node] + right, node)
            total += self.path[t][node]
        return np.exp2(-total / (max(1, len(self.feature)) * max(self.scale, 1e-9)))


def grow(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> Forest:
    """Grow a forest on ``sample`` rows per tree, drawn from ``x``. Without rows
    every text scores alike."""
    random = np.random.default_rng(seed)
    size = min(sample, len(x))
    depth = int(np.ceil(np.log2(max(2, size))))
    found = []
    for _ in range(trees if size else 0):
        nodes = []

        def build(rows, level, nodes=nodes):
            at = len(nodes)
            nodes.append([-1, 0.0, 0, level + _expected(len(rows))])
            return at, rows, level

        pending = [build(x[random.choice(len(x), size, replace=False)], 0)]
        while pending:
            at, rows, level = pending.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if level >= depth or len(rows) <= 1 or not len(open_):
                continue
            f = int(random.choice(open_))
            cut = random.uniform(low[f], high[f])
            side = rows[:, f] >= cut
            first = build(rows[~side], level + 1)
            second = build(rows[side], level + 1)
            nodes[at][:3] = [f, cut, first[0]]
            pending += [first, second]
        found.append(nodes)
    width = max((len(n) for n in found), default=1)
    table = np.zeros((len(found), width, 4))
    table[:, :, 0] = -1
    for i, nodes in enumerate(found):
        table[i, : len(nodes)] = nodes
    return Forest(
        table[:, :, 0].astype(np.int64), table[:, :, 1], table[:, :, 2].astype(np.int64),
        table[:, :, 3], _expected(size),
    )


def _inputs(counted: dict[str, np.ndarray]) -> np.ndarray:
    return fe.rates(counted)[:, [fe.RATES.index(name) for name in USED]]


def sample_rows(counted: DataFrame, rows: int, into: str = "counts") -> np.ndarray:
    """Inputs of about ``rows`` documents, chosen from all by a hash."""
    size = counted.count()
    key = F.xxhash64(*[F.col(f"`{c}`") for c in counted.columns])
    part = F.pmod(key, F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / max(1, size)))
    held = counted.where(part).select(F.col(f"`{into}`.*")).toPandas().sort_values(list(fe.COUNTS))
    return _inputs({name: held[name].to_numpy(dtype=np.int64) for name in fe.COUNTS})


def add_anomaly(counted: DataFrame, forest: Forest, into: str = "counts") -> DataFrame:
    """``counted`` with a column anomaly."""
    sent = counted.sparkSession.sparkContext.broadcast(forest)
    names = counted.columns
    schema = T.StructType([*counted.schema.fields, T.StructField("anomaly", T.DoubleType())])

    def run(batches):
        for batch in batches:
            x = _inputs(fe.counts_of(batch.column(into)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sent.value.score(x))], names=[*names, "anomaly"]
            )

    return bounded_batches(counted).mapInArrow(run, schema)


def calibrate(scored: DataFrame, labels: DataFrame, doc_id: str, label: str) -> float:
    """Anomaly above which a text is rejected, from all labelled rows."""
    known = (
        labels.where(F.col(label).isNotNull())
        .groupBy(F.col(doc_id).alias("id"))
        .agg(F.max(label).cast("int").alias("y"))
    )
    step = F.least(F.floor(F.col("anomaly") * STEPS), F.lit(STEPS - 1)).cast("int").alias("step")
    rows = (
        scored.select(F.col(doc_id).alias("id"), step).join(known, "id").groupBy("step", "y").count().collect()
    )
    held = np.zeros((2, STEPS + 1))
    for r in rows:
        held[int(r["y"] > 0), r["step"]] += r["count"]
    above = np.cumsum(held[:, ::-1], axis=1)[:, ::-1]  # rows with at least this step
    if not above[0, 0] or not above[1, 0]:
        return FALLBACK
    cost = above[1] / above[1, 0] + 1 - above[0] / above[0, 0]
    return float(np.flatnonzero(cost <= cost.min() + 1e-12)[-1]) / STEPS


def judge(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> DataFrame:
    """One row per document: doc_id, a struct counts, anomaly, base_failed, kept.

    base_failed: fewer than 10 words, or over 20 % of the words in runs of five
    that occur twice or more. kept: false for those, else whether the anomaly is
    below the threshold. A null or empty text has no words and fails. Copies are
    judged alike; without labels of both kinds a fixed threshold holds.
    """
    counted = store(
        add_struct(docs.select(doc_id, text), text, "counts", fe.COUNTS_KIND, lambda: fe.counts_array).drop(text)
    )
    forest = grow(sample_rows(counted, TREES * SAMPLE))
    scored = store(add_anomaly(counted, forest))
    limit = calibrate(scored, labels, doc_id, label)
    words, again = F.col("counts.n_words"), F.col("counts.n_repeat_words")
    failed = (words < LEAST_WORDS) | (again * 100 > words * REPEAT_PERCENT)
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("anomaly") < limit)
    )


def digest(judged: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document with the counts of the hard rules and the verdicts."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        doc_id, *[F.col(f"counts.{n}").alias(n) for n in names], "base_failed", "kept", "anomaly"
    )
