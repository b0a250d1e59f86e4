"""Running sums within groups, over the ranges of one global sort.

The rows are sorted by group and order into ranges of about equal size, whatever
the groups are: a group that holds a third of all rows, or whose rows all compare
equal, takes several ranges. Sums are made within each range. What a group has
gathered before a range matters only where a group goes on from one range to the
next, so at most two small rows per range are sent to all tasks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeline.llm.columns import fresh
from citeline.llm.tables import place, store
from citeline.session import scratch


def running_sums(df: DataFrame, key: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with one column per entry of ``sums``: the sum of its expression (whole
    numbers) over the rows of the same ``key`` that come before the row in ``order``.

    Nulls sort first, a null ``key`` is a group and a null number counts as 0. Rows that compare equal
    come in any order, one after the other. The result is a table. Columns of ``df`` that have the names of
    the sums are replaced; an empty table gives no rows.
    """
    rest = df.drop(*[n for n in sums if n in df.columns])
    part, row = fresh(rest, "__part"), fresh(rest, "__row")
    value = {n: fresh(rest, f"__value_{n}") for n in sums}
    before = {n: fresh(rest, f"__before_{n}") for n in sums}
    numbers = {value[n]: F.coalesce(e.cast("long"), F.lit(0).cast("long")) for n, e in sums.items()}
    spark = df.sparkSession
    result = place(spark)
    with scratch(spark):  # the ranges are removed once the sums are written
        # the number of a row parts those that compare equal; a table, as ranges are
        # borders of a sample and every later step must see the same ones
        ranged = store(
            rest.withColumns(numbers)
            .withColumn(row, F.monotonically_increasing_id())
            .repartitionByRange(key, *order, row)
            .withColumn(part, F.spark_partition_id())
        )
        totals = ranged.groupBy(key, part).agg(*[F.sum(value[n]).alias(value[n]) for n in sums])
        # only the first group of a range goes on from earlier ranges, and it is the last of those
        group = F.struct(F.col(key).alias("of"))
        held = F.struct(F.col(key).alias("of"), *[F.col(value[n]).alias(f"n{i}") for i, n in enumerate(sums)])
        ends = totals.groupBy(part).agg(
            F.array_distinct(F.array(F.min_by(held, group), F.max_by(held, group))).alias("ends")
        )
        since = Window.partitionBy("end.of").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        offsets = ends.select(part, F.explode("ends").alias("end")).withColumns(
            {before[n]: F.sum(f"end.n{i}").over(since) for i, n in enumerate(sums)}
        )
        of, at = fresh(rest, "__of"), fresh(rest, "__at")
        offsets = offsets.select(F.col("end.of").alias(of), F.col(part).alias(at), *before.values())
        joined = ranged.join(
            F.broadcast(offsets), F.col(key).eqNullSafe(F.col(of)) & (F.col(part) == F.col(at)), "left"
        )
        inner = (
            Window.partitionBy(part, key).orderBy(*order, row).rowsBetween(Window.unboundedPreceding, -1)
        )
        none = F.lit(0).cast("long")
        placed = {
            n: F.coalesce(F.col(before[n]), none) + F.coalesce(F.sum(value[n]).over(inner), none) for n in sums
        }
        return store(joined.withColumns(placed).select(*rest.columns, *sums), result)
