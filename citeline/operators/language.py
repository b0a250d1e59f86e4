"""Language detection: character trigrams and naive Bayes, from MLlib or as a table
of weights that is fitted and applied by joins and aggregates."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import StringIndexer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeline.config import DEFAULTS
from citeline.functions.arrow import bounded_batches, pieces
from citeline.functions.trigrams import FEATURES, hashed_trigrams
from citeline.session import settle

# Bytes of text whose trigrams are taken at a time, by eight.
_TEXTS = 125_000


@dataclass(frozen=True)
class Detector:
    """A fitted naive Bayes model: one weight per language and feature."""

    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray

    def best(self, texts: pa.Array) -> np.ndarray:
        """Number of the likeliest language of each lower-cased text; the first of equals."""
        scores = np.repeat(self.prior[:, None], len(texts), axis=1)
        for rows, feature in hashed_trigrams(texts):
            for own, weights in zip(scores, self.weights, strict=True):
                own += np.bincount(rows, weights=weights[feature], minlength=len(texts))
        return scores.argmax(axis=0)


def _counted(labelled: DataFrame, languages: int) -> DataFrame:
    """(label, feature, n): how often the texts of a label show each feature; the
    feature behind the last one counts the texts. A task sends one row for each."""
    width = FEATURES + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(languages * width, dtype=np.int64)
        for batch in (piece for whole in batches for piece in pieces(whole, "__text", _TEXTS)):
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(held, label * width + FEATURES, 1)
            for rows, feature in hashed_trigrams(batch.column("__text")):
                cells, n = np.unique(label[rows] * width + feature, return_counts=True)
                held[cells] += n
        cells = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells // width), pa.array(cells % width), pa.array(held[cells])], names=["label", "feature", "n"]
        )

    found = bounded_batches(labelled).mapInArrow(count, "label long, feature long, n long")
    return found.groupBy("label", "feature").agg(F.sum("n").alias("n"))


def train_detector(texts: DataFrame, text: str = "text", language: str = "language") -> Detector:
    """Fit a detector on texts of known language. The model holds one weight
    per language and feature, whatever the size of the corpus.

    Naive Bayes needs no more of the texts than their number and the sums of their
    features, by language: these are counted in one pass and stand for the texts.
    """
    rows = texts.select(F.lower(F.col(text)).alias("__text"), F.col(language).alias("__known"))
    labels = StringIndexer(inputCol="__known", outputCol="label").fit(rows)
    known = labels.transform(rows).select("label", "__text")
    counts: dict[int, dict[int, int]] = {}
    for r in _counted(known, len(labels.labels)).collect():
        counts.setdefault(r["label"], {})[r["feature"]] = r["n"]
    sums = []
    for label, shown in sorted(counts.items()):
        # one row with all features, the others of the label without any
        number = shown.pop(FEATURES)
        sums.append((float(label), 1.0, Vectors.sparse(FEATURES, {f: float(n) for f, n in shown.items()})))
        if number > 1:
            sums.append((float(label), float(number - 1), Vectors.sparse(FEATURES, {})))
    fields = [T.StructField(n, T.DoubleType()) for n in ("label", "weight")]
    held = texts.sparkSession.createDataFrame(sums, T.StructType([*fields, T.StructField("features", VectorUDT())]))
    bayes = NaiveBayes(featuresCol="features", labelCol="label", weightCol="weight").fit(held)
    return Detector(list(labels.labels), bayes.pi.toArray(), bayes.theta.toArray())


def detect(
    df: DataFrame, model: Detector, text: str = "text", s=DEFAULTS
) -> DataFrame:
    """Add ``language``, judged by the first characters of the text, which are
    plenty and keep long pages cheap."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def judge(texts: pa.Array) -> pa.Array:
        languages = pa.array(sent.value.languages, pa.string())
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        found = [sent.value.best(piece.column("text")) for piece in pieces(batch, "text", _TEXTS)]
        return languages.take(pa.array(np.concatenate(found)))

    head = F.lower(F.left(F.col(text), F.lit(s.detection_chars)))
    return bounded_batches(df).withColumn("language", F.arrow_udf(judge, "string")(head))


#: Trigrams whose weights are sent to every task; they are tens of thousands in
#: alphabets, and more only in scripts of many characters.
SENT = 1_000_000
#: Weights are whole millionths of a natural logarithm, so that a sum does not
#: depend on its order.
WEIGHT_STEPS = 1_000_000


def _log(share: Column) -> Column:
    return F.round(F.log(share) * WEIGHT_STEPS).cast("long")


def trigrams(df: DataFrame, keep: list[str], text: str = "text", s=DEFAULTS) -> DataFrame:
    """``keep`` and ``gram``: one row per three characters in a row of the first
    characters of the text; a shorter text has none."""
    head = F.left(F.col(text), F.lit(s.detection_chars))
    # one character is taken at a time, and the two behind it are looked at
    return df.select(*keep, F.explode(F.regexp_extract_all(head, F.lit("(?s)(?=(...))."), F.lit(1))).alias("gram"))


def fit_weights(texts: DataFrame, text: str = "text", language: str = "language", s=DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(languages, weights) of texts of known language; rows without one are left out.

    languages: language, prior, unseen (the weight of a trigram that the language
    never showed), one row each. weights: gram, language, gain (what a trigram that
    it did show weighs above that). Counts combine before the shuffle, so both grow
    with the trigrams that exist, not with the texts.
    """
    known = texts.where(F.col(language).isNotNull()).select(F.col(language).alias("language"), F.col(text).alias("text"))
    counts = settle(trigrams(known, ["language"], s=s).groupBy("gram", "language").agg(F.count("*").alias("n")))
    vocabulary = counts.agg(F.count_distinct("gram").alias("v")).first()["v"]
    shown = counts.groupBy("language").agg(F.sum("n").alias("shown"))
    docs = known.groupBy("language").agg(F.count("*").alias("docs"))
    mass = F.coalesce("shown", F.lit(0)) + F.lit(vocabulary + 1)
    # one row per language, so the window over all of them is small
    share = F.col("docs") / F.sum("docs").over(Window.partitionBy())
    sizes = docs.join(shown, "language", "left").withColumn("mass", mass)
    languages = settle(sizes.select("language", "mass", _log(share).alias("prior"), _log(1 / F.col("mass")).alias("unseen")))
    gain = _log((F.col("n") + 1) / F.col("mass")) - F.col("unseen")
    weights = settle(counts.join(languages, "language").select("gram", "language", gain.alias("gain")))
    return languages.drop("mass"), weights


def detect_by_weights(
    df: DataFrame, key: str, languages: DataFrame, weights: DataFrame, text: str = "text", s=DEFAULTS
) -> DataFrame:
    """(key, language): the likeliest language of each text; among equals the first
    by name. A text without trigrams, null included, gets the most frequent language.

    ``key`` should be unique: texts of one key count as one. The languages, one row each, are collected; where none is
    known, no text has one. A trigram's gains are one row with a column per language.
    Up to ``SENT`` such rows are sent to the tasks, so that the trigrams of a text meet
    them where they are cut, and a text is one row before it is shuffled. More of them
    are joined by trigram, which each text then sends once.
    """
    known = sorted(languages.collect(), key=lambda r: r["language"])
    if not known:
        return df.select(key, F.lit(None).cast("string").alias("language"))
    gains = [
        F.coalesce(F.sum(F.when(F.col("language") == r["language"], F.col("gain"))), F.lit(0)).alias(f"__g{i}")
        for i, r in enumerate(known)
    ]
    by_gram = settle(weights.groupBy("gram").agg(*gains))
    grams = trigrams(df, [key], text, s)
    if by_gram.count() <= SENT:
        grams, by_gram = grams.withColumn("n", F.lit(1).cast("long")), F.broadcast(by_gram)
    else:
        grams = grams.groupBy(key, "gram").agg(F.count("*").alias("n"))
    total = [F.sum(F.col("n") * F.coalesce(f"__g{i}", F.lit(0))).alias(f"__g{i}") for i in range(len(known))]
    held = grams.join(by_gram, "gram", "left").groupBy(key).agg(F.sum("n").alias("n"), *total)
    n = F.coalesce("n", F.lit(0))
    costs = [
        F.struct(
            (-(F.lit(r["prior"]) + n * F.lit(r["unseen"]) + F.coalesce(f"__g{i}", F.lit(0)))).alias("cost"),
            F.lit(r["language"]).alias("language"),
        )
        for i, r in enumerate(known)
    ]
    # the least cost, among equals the first by name
    best = F.array_min(F.array(*costs))["language"]
    return df.select(key).distinct().join(held, key, "left").select(key, best.alias("language"))
