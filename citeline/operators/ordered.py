"""Ordered computations within groups of any size.

A plain window puts a whole group into one task. Here a group is first cut
into buckets of its order key (``bucket``: at most ``order_bucket`` positions
when the key is a dense integer such as a page number), the windows run per
(group, bucket), and only one small row per bucket travels on to link the
buckets: a running sum, or the few rows next to the border. A document that
holds a third of all pages therefore spreads over all tasks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeline.config import DEFAULTS

BUCKET = "__bucket"


def int_bucket(order: Column, s=DEFAULTS) -> Column:
    """Bucket of a dense integer order key."""
    return F.floor(order / s.order_bucket).cast("long")


def _summaries(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys, BUCKET).agg(*aggs)


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    sums: dict[str, Column],
    inclusive: bool = False,
) -> DataFrame:
    """Add running sums over ``keys`` in ``order``, one column per entry of
    ``sums``; exclusive of the row itself unless ``inclusive``."""
    df = df.withColumns({BUCKET: bucket} | {f"__v_{n}": e for n, e in sums.items()})
    base = _summaries(
        df, keys, *[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums]
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy(BUCKET)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    base = base.select(
        *keys,
        BUCKET,
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums],
    )
    inner = (
        Window.partitionBy(*keys, BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    joined = df.join(base, [*keys, BUCKET])
    return joined.withColumns(
        {
            n: F.col(f"__b_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inner), F.lit(0))
            for n in sums
        }
    ).drop(BUCKET, *[f"__v_{n}" for n in sums], *[f"__b_{n}" for n in sums])


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str
) -> DataFrame:
    """Add a dense 0-based position of each row within ``keys``."""
    return running_sums(df, keys, order, bucket, {name: F.lit(1).cast("long")})


def neighbours(
    df: DataFrame,
    keys: list[str],
    order: str,
    bucket: Column,
    value: str,
    reach: int,
    name: str,
) -> DataFrame:
    """Add ``name``: array of ``value`` over the rows -reach..+reach, clipped at
    the group's ends, and ``name``_before: how many of them precede the row."""
    df = df.withColumn(BUCKET, bucket)
    rows = F.sort_array(F.collect_list(F.struct(order, value)))
    ends = _summaries(df, keys, rows.alias("__rows")).select(
        *keys,
        BUCKET,
        F.slice(F.col("__rows")[value], 1, reach).alias("__head"),
        F.reverse(F.slice(F.reverse(F.col("__rows")[value]), 1, reach)).alias("__tail"),
    )
    # A bucket holds at least one row, so `reach` buckets to either side hold
    # every neighbour; trim to the nearest `reach` values.
    w = Window.partitionBy(*keys).orderBy(BUCKET)
    empty = F.slice(F.col("__head"), 1, 0)
    earlier = F.concat(
        *[F.coalesce(F.lag("__tail", i).over(w), empty) for i in range(reach, 0, -1)]
    )
    later = F.concat(
        *[F.coalesce(F.lead("__head", i).over(w), empty) for i in range(1, reach + 1)]
    )
    ends = ends.select(
        *keys,
        BUCKET,
        F.reverse(F.slice(F.reverse(earlier), 1, reach)).alias("__prev"),
        F.slice(later, 1, reach).alias("__next"),
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy(order)
    joined = df.join(ends, [*keys, BUCKET]).withColumns(
        {
            "__mine_before": F.collect_list(value).over(inside.rowsBetween(-reach, -1)),
            "__mine_after": F.collect_list(value).over(inside.rowsBetween(0, reach)),
        }
    )
    def last(array: Column, n: Column) -> Column:
        return F.reverse(F.slice(F.reverse(array), F.lit(1), n))

    before = F.concat(
        last(F.col("__prev"), reach - F.size("__mine_before")), F.col("__mine_before")
    )
    after = F.concat(
        F.col("__mine_after"),
        F.slice(F.col("__next"), F.lit(1), reach + 1 - F.size("__mine_after")),
    )
    return joined.withColumns(
        {name: F.concat(before, after), f"{name}_before": F.size(before)}
    ).drop(BUCKET, "__prev", "__next", "__mine_before", "__mine_after")
