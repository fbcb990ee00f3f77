"""Per-row counting over arrays, so that counting inside one text needs no shuffle."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, which may use it many times."""
    return F.transform(F.array(value), body)[0]


def histogram(items: Column) -> Column:
    """Array of ``(item, n)`` structs, ordered by item: sort, find where runs start, measure the runs."""

    def runs(ordered: Column) -> Column:
        size = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(0), size),
            lambda i: (i < size) & ((i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))),
        )
        return bind(
            starts,
            lambda s: F.transform(
                s,
                lambda start, k: F.struct(
                    F.get(ordered, start).alias("item"),
                    (F.coalesce(F.get(s, k + 1), size) - start).alias("n"),
                ),
            ),
        )

    return bind(F.sort_array(items), runs)


def fill_gaps(entries: Column, size: Column | int, default: Column) -> Column:
    """``entries`` ``(at, value)``, ordered by ``at``, as an array of ``size`` values with ``default`` where there is none."""

    def filled(e: Column) -> Column:
        def at(i: Column) -> Column:
            return F.coalesce(F.get(e, i)["at"], F.lit(-1)).cast("int")

        stretches = F.transform(e, lambda x, i: F.concat(F.array_repeat(default, at(i) - at(i - 1) - 1), F.array(x["value"])))
        end = F.array_repeat(default, (F.lit(size) if isinstance(size, int) else size).cast("int") - 1 - at(F.size(e) - 1))
        return F.concat(F.flatten(stretches), end)

    return bind(entries, filled)
