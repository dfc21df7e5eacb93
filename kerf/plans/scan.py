"""Two levels of a scan: rows in order within ranges, and what ranges leave behind in order within a group.

Rows are exchanged once, by group and range. From that one exchange come the windows
over ranges and one row for the end of each range; only these rows are put in order over
the whole group, and what a range starts with is joined back to its rows. So no task
holds more than a range, and what stands before, reading and parsing included, is done once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def two_level(
    rows: DataFrame, group: str, span: str, order: str, local: Callable[[WindowSpec], dict[str, Column]], ends: list[Column], before: Callable[[WindowSpec], list[Column]]
) -> DataFrame:
    """``rows`` with the columns of ``local`` and ``before``.

    ``local`` makes columns over the window of a range, in ``order``. ``ends`` sum up a
    range, and ``before`` makes of them, over the window of the ranges before (by
    ``span``) in the group, what a range starts with. Rows without a group start with
    nothing. Spark must be free to reuse exchanges, as it is unless told otherwise.
    """
    key, rest = [group, span], [c for c in rows.columns if c not in (group, span)]
    # Rows go through the exchange whole: only as both uses need the same of it, Spark makes both from one.
    rows = rows.select(*key, F.struct(*rest).alias("_row")).repartition(*key).select(*key, F.inline(F.array("_row")))
    w = Window.partitionBy(group).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    start = rows.groupBy(*key).agg(*ends).select(F.col(group).alias("_g"), F.col(span).alias("_s"), *before(w))
    # Behind a generator, what the join asks of its keys can't be asked below the exchange of one use only.
    start = start.select(F.inline(F.array(F.struct(*start.columns))))
    # The window comes first: its order is the one in which Spark would merge.
    known = rows.withColumns(local(Window.partitionBy(*key).orderBy(order)))
    return known.join(start, (F.col(group) == F.col("_g")) & (F.col(span) == F.col("_s")), "left").drop("_g", "_s")


def last_known(n: str, order: str = "seq") -> Column:
    """The last value of a range that isn't null, as an end."""
    return F.max_by(n, F.when(F.col(n).isNotNull(), F.col(order))).alias(f"_end_{n}")


def carried(n: str, w: WindowSpec) -> Column:
    """What the ranges before have as their last value that isn't null: ``_from_`` and the name."""
    return F.last(f"_end_{n}", ignorenulls=True).over(w).alias(f"_from_{n}")


def onward(n: str, w: WindowSpec, upto: int = Window.currentRow) -> Column:
    """The last value that isn't null up to a row of the range."""
    return F.last(n, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, upto))
