"""Array expressions that stay linear in the length of the array."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 128


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column) -> Column:
    """Sums of the elements up to and with each, in blocks: linear in the length
    but for the block size. ``values`` must be a column or a bound variable."""
    size = F.size(values)
    none = F.array().cast("array<int>")

    def add(held, v):
        return F.concat(held, F.array(F.coalesce(F.try_element_at(held, F.lit(-1)), F.lit(0)) + v))

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((size - 1) / _BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)), none, add),
    )

    def joined(blocks):
        before = F.aggregate(
            blocks,
            F.array(F.lit(0)),
            lambda held, b: F.concat(held, F.array(F.element_at(held, -1) + F.element_at(b, -1))),
        )
        return F.flatten(
            F.zip_with(
                blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, t: F.transform(b, lambda v: v + t)
            )
        )

    return F.when(size > 0, let(blocks, joined)).otherwise(none)


def running_most(values: Column) -> Column:
    """The largest of the elements up to and with each, in blocks as
    ``running_sums``. ``values`` must be a column or a bound variable of ints."""
    size = F.size(values)
    none = F.array().cast("array<int>")

    def more(held, v):
        return F.concat(held, F.array(F.greatest(F.try_element_at(held, F.lit(-1)), v)))

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((size - 1) / _BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)), none, more),
    )

    def joined(blocks):
        upto = F.aggregate(F.transform(blocks, lambda b: F.element_at(b, -1)), none, more)
        raised = lambda upto: F.transform(
            blocks, lambda b, i: let(F.get(upto, i - 1), lambda t: F.transform(b, lambda v: F.greatest(v, t)))
        )
        return F.flatten(let(upto, raised))

    return F.when(size > 0, let(blocks, joined)).otherwise(none)
