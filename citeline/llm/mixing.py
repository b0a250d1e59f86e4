"""Mixing sources to target weights by Poisson replication.

Every row is repeated a random number of times with a mean that brings its
source to its target share: a Poisson variable, drawn by inverting the
distribution at a uniform number that a hash of the seed and the row's id gives.
The draw of a row depends on nothing but its id and its source's mean, so it is
the same on every run, and rows need no counter or order. Means above
``STEP_MEAN`` are drawn as sums of independent smaller ones, which keeps the
inversion short. The repeated rows are then dealt out in the order of another
hash, which mixes all sources everywhere.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.llm.columns import fresh
from citeline.llm.tables import store

SEED = 20
#: Exponent that flattens the sources' shares: 1 keeps them, 0 makes them equal.
FLATTEN = 0.5
#: Rows out per row in, on average.
EPOCHS = 1.0
#: Largest mean that is inverted in one go, and the values tried; the chance of
#: a larger one is below 1e-18.
STEP_MEAN, STEP_VALUES = 4.0, 40
#: Copies of a row that are listed at once, and rows out per partition on average.
COPY_BLOCK, PART_ROWS = 1024, 100_000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the seed and the parts."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    digits = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double")
    return (digits + 0.5) / F.lit(float(1 << 52))


def poisson(mean: Column, u: Column) -> Column:
    """The least k whose distribution function exceeds ``u``, for a small mean:
    the number of k whose distribution function does not."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.lit(0).alias("k"))

    def step(held, i):
        below = held["sum"] <= u
        p = F.when(below, held["p"] * mean / i).otherwise(held["p"])
        return F.struct(
            p.alias("p"),
            F.when(below, held["sum"] + p).otherwise(held["sum"]).alias("sum"),
            F.when(below, held["k"] + 1).otherwise(held["k"]).alias("k"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEP_VALUES)), start, step, lambda held: held["k"])


def copies(mean: Column, seed: int, row_id: Column) -> Column:
    """Poisson number of copies of a row, as a sum of draws of small mean."""
    draws = F.greatest(F.lit(1), F.ceil(mean / STEP_MEAN).cast("int"))
    total = F.aggregate(
        F.sequence(F.lit(1), draws),
        F.lit(0),
        lambda n, j: n + poisson(mean / draws, uniform(seed, row_id, j)),
    )
    return F.when(mean > 0, total).otherwise(0)


def means(
    docs: DataFrame,
    source: str = "source",
    weights: DataFrame | None = None,
    epochs: float = EPOCHS,
    flatten: float = FLATTEN,
) -> DataFrame:
    """(source, n, mean): rows of each source and how often one is repeated on average.

    ``weights`` (source, weight) names the target shares, up to a factor; a
    source that it does not list has weight 0, a negative or null weight is 0.
    Without it a source of n rows has weight n ** flatten.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        target = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(flatten))))
    else:
        listed = weights.groupBy(F.col("source").alias("of")).agg(
            F.sum(F.greatest(F.lit(0.0), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)))).alias("w")
        )
        target = sizes.join(listed, F.col("source").eqNullSafe(F.col("of")), "left").select(
            "source", "n", F.coalesce("w", F.lit(0.0)).alias("w")
        )
    # sums in a fixed order and as decimals: the same on every run
    sums = target.agg(
        F.sum("n").alias("rows"), F.sum(F.col("w").cast("decimal(38,9)")).cast("double").alias("weight")
    )
    mean = F.lit(float(epochs)) * F.col("rows") * F.col("w") / F.nullif("weight", F.lit(0.0)) / F.col("n")
    one = target.join(F.broadcast(sums))  # a single row of sums
    return one.select("source", "n", F.coalesce(mean, F.lit(0.0)).alias("mean"))


def mix(
    docs: DataFrame,
    source: str = "source",
    doc_id: str = "doc_id",
    weights: DataFrame | None = None,
    epochs: float = EPOCHS,
    flatten: float = FLATTEN,
    seed: int = SEED,
    copy: str = "copy",
    order: str = "order_key",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """``docs``, each row repeated by its draw, in a global random order.

    Adds ``copy`` (0, 1, ... of the row) and ``order``, a hash: partitions hold
    rising ranges of it and are sorted by it; ties are in the order of the id. Rows
    without a source are a source of their own; rows that share an id share the
    draw; a null id draws as the text "null". An empty table gives no rows.
    Columns that have the added names already are replaced.
    """
    rest = docs.drop(copy, order)
    rate, number = fresh(rest, "__mean"), fresh(rest, "__of")
    # a table, so that Spark knows its size: few sources are broadcast, and with
    # many the join can split a source that holds a large share of the rows
    rates = store(means(rest, source, weights, epochs, flatten))
    expected = rates.agg(F.sum(F.col("n") * F.col("mean")).alias("rows")).first()["rows"] or 0.0
    named = rates.select(F.col("source").alias(number), F.col("mean").alias(rate))
    row_id = F.col(doc_id)
    drawn = rest.join(named, F.col(source).eqNullSafe(F.col(number)), "left")
    times = copies(F.coalesce(F.col(rate), F.lit(0.0)), seed, row_id)
    count, block = fresh(drawn, "__times"), fresh(drawn, "__block")
    first = F.col(block) * COPY_BLOCK
    size = F.least(F.lit(COPY_BLOCK), F.col(count) - first)
    repeated = (
        drawn.withColumn(count, times)
        .where(F.col(count) > 0)
        .withColumn(block, F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / COPY_BLOCK).cast("int"))))
        .withColumn(copy, F.explode(F.sequence(first, first + size - 1)))
        .drop(rate, number, count, block)
    )
    key = F.md5(
        F.concat_ws(
            ":", F.lit(f"{seed} order"), F.coalesce(row_id.cast("string"), F.lit("null")), F.col(copy).cast("string")
        ).cast("binary")
    )
    # the key is uniform, so equal ranges of its leading digits are equal shares of
    # the rows: no sample of the rows is needed to find the borders
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, math.ceil(expected / part_rows))
    lead = F.conv(F.left(F.col(order), F.lit(8)), 16, 10).cast("long")
    place = F.floor(lead * parts / (1 << 32)).cast("int")
    return repeated.withColumn(order, key).repartitionById(parts, place).sortWithinPartitions(order, doc_id)
