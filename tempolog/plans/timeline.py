"""Ordered per-key computations that stay balanced when one key holds a large part of all rows.

A plain ``Window.partitionBy(key).orderBy(...)`` sorts a whole key inside one task. Here a key with more rows
than a task should hold is cut into consecutive slices of its order, windows run per (key, slice), and what a
slice needs to know about earlier or later slices of its key travels in a table with one row per slice.
Keys of ordinary size take the plain window, with no extra columns, joins or shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tempolog.plans.joins import broadcast_hot, match_all, spread
from tempolog.session import durable

SLICE = "_slice"

MAX_ROWS_SETTING = "spark.tempolog.maxRowsPerWindow"
MAX_ROWS = 5_000_000     # rows a single task may have to sort
MAX_HOT_KEYS = 100_000   # a key is hot above total/MAX_HOT_KEYS rows, so there are never more hot keys than this


def rows_per_window(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(MAX_ROWS_SETTING, str(MAX_ROWS)))


def group_sizes(df: DataFrame, keys: Iterable[str]) -> tuple[int, int, int, DataFrame]:
    """(all rows, groups, rows of the largest group, table of counts per group). One scan of the key columns."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total, groups, largest = counts.agg(F.sum("_rows"), F.count("_rows"), F.max("_rows")).first()
    return total or 0, groups, largest or 0, counts


def hot_limit(df: DataFrame, total: int) -> int:
    return max(rows_per_window(df), total // MAX_HOT_KEYS)


@dataclass(frozen=True)
class Scan:
    """One ordered computation: what a row sees inside its slice, and what it needs from the slices around it."""

    local: Callable[[WindowSpec], Column]          # value from the rows of the same window partition
    summary: Column | None = None                  # one value per slice; may use the local value by name
    across: Callable[[Column, WindowSpec], Column] | None = None   # summaries of earlier (later) slices -> carried value
    merge: Callable[[Column, Column], Column] | None = None        # (carried, local) -> value
    whole: Callable[[WindowSpec], Column] | None = None            # the final value where the key is not cut, if not `local`


@dataclass(frozen=True)
class Timeline:
    """Rows with a total order inside each key. Build it with :func:`timeline`."""

    plain: DataFrame               # rows of keys of ordinary size
    cut: DataFrame | None          # rows of the keys that were cut, with their slice number
    keys: tuple[str, ...]
    order: tuple[str, ...]
    base: tuple[str, ...]          # the keys it was built on; `keys` may be finer
    total: int | None              # upper bound of all rows, if known
    groups: int | None             # number of base keys, if known
    largest: int                   # upper bound of the rows of one key
    hot: DataFrame | None = None   # the keys that were cut, at most MAX_HOT_KEYS of them

    @property
    def rows(self) -> DataFrame:
        return self.plain if self.cut is None else self.plain.unionByName(self.cut.drop(SLICE))

    def apply(self, change: Callable[[DataFrame], DataFrame]) -> Timeline:
        """Add columns or drop rows; ``change`` must work row by row."""
        return replace(self, plain=change(self.plain), cut=None if self.cut is None else change(self.cut))

    def map(self, **columns: Column) -> Timeline:
        return self.apply(lambda rows: rows.withColumns(columns))

    def drop(self, *columns: str) -> Timeline:
        return self.apply(lambda rows: rows.drop(*columns))

    def store(self, *columns: str) -> Timeline:
        """Write these columns (or all) once, so that several passes do not repeat the shuffle behind them."""
        def written(rows: DataFrame, *more: str) -> DataFrame:
            return durable(rows.select(*columns, *more) if columns else rows)
        return replace(self, plain=written(self.plain), cut=None if self.cut is None else written(self.cut, SLICE))

    def within(self, *keys: str) -> Timeline:
        """Timelines of a finer key, e.g. sessions inside users. The slices of the coarse key still hold."""
        return replace(self, keys=tuple(keys))

    def backwards(self, *order: str) -> Timeline:
        """The same rows read from the end; ``order`` names columns that sort them the other way round."""
        cut = None if self.cut is None else self.cut.withColumn(SLICE, -F.col(SLICE))
        return replace(self, cut=cut, order=tuple(order))

    # --- ordered computations -----------------------------------------------------------------------------

    def previous(self, **columns: str) -> Timeline:
        """Add ``new=source`` columns holding the value of the preceding row, null on the first row of a key."""
        return self.scan(**self.neighbours(F.lag, columns))

    def following(self, **columns: str) -> Timeline:
        """Add ``new=source`` columns holding the value of the next row, null on the last row of a key."""
        return self.scan(**self.neighbours(F.lead, columns))

    def running(self, kind: str, name: str, value: str | Column, inclusive: bool = True) -> Timeline:
        """Add a running value, see :meth:`fold`."""
        return self.scan(**{name: self.fold(kind, value, inclusive)})

    def position(self, name: str) -> Timeline:
        """Add the row's number inside its key, from 1."""
        return self.scan(**{name: self.fold("sum", F.lit(1).cast("bigint"))})

    def history(self, name: str, column: str, length: int) -> Timeline:
        """Add an array of the (at most ``length``) preceding values, oldest first."""
        newest = lambda a: F.slice(a, F.greatest(F.size(a) - length + 1, F.lit(1)), length)
        nothing = F.slice(F.array(column), 1, 0)
        # Every slice has a row, so the last `length` slices hold the last `length` values.
        return self.scan(**{name: Scan(
            local=lambda w: F.collect_list(column).over(w.rowsBetween(-length, -1)),
            summary=F.max_by(newest(F.concat(F.col(name), F.array(column))), F.struct(*self.order)),
            across=lambda s, w: newest(F.flatten(F.collect_list(s).over(w.rowsBetween(-length, -1)))),
            merge=lambda early, late: newest(F.concat(F.coalesce(early, nothing), late)))})

    def neighbours(self, shift: Callable, columns: dict[str, str]) -> dict[str, Scan]:
        edge = F.max_by if shift is F.lag else F.min_by
        # Values travel in a struct, so that a null value is not taken for a missing neighbour.
        def one(source: str) -> Scan:
            boxed = F.struct(F.col(source).alias("v"))
            return Scan(
                whole=lambda w: shift(source).over(w),
                local=lambda w: shift(boxed).over(w),
                summary=edge(boxed, F.struct(*self.order)),
                across=lambda s, w: shift(s).over(w),
                merge=lambda carried, local: F.coalesce(local, carried)["v"])
        return {new: one(old) for new, old in columns.items()}

    def fold(self, kind: str, value: str | Column, inclusive: bool = True) -> Scan:
        """Running ``sum``, ``product``, ``max`` or ``last`` (last non-null) from the start of the key.

        Without ``inclusive`` the row itself is left out; a first row then gets 0, 1, null or null.
        """
        value = F.col(value) if isinstance(value, str) else value
        add, summary, join, empty = {
            "sum": (F.sum, F.sum(value), lambda a, b: a + b, F.lit(0)),
            "product": (F.product, F.product(value), lambda a, b: a * b, F.lit(1.0)),
            "max": (F.max, F.max(value), F.greatest, None),
            "last": (lambda v: F.last(v, ignorenulls=True),
                     F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order))),
                     lambda early, late: F.coalesce(late, early), None),
        }[kind]
        filled = (lambda c: c) if empty is None else (lambda c: F.coalesce(c, empty))
        here, before = Window.currentRow if inclusive else -1, -1
        return Scan(
            local=lambda w: filled(add(value).over(w.rowsBetween(Window.unboundedPreceding, here))),
            summary=summary,
            across=lambda s, w: add(s).over(w.rowsBetween(Window.unboundedPreceding, before)),
            merge=lambda early, late: join(filled(early), late))

    def scan(self, **scans: Scan) -> Timeline:
        """Add several ordered columns in one pass; none of them may use another."""
        w = Window.partitionBy(*self.keys).orderBy(*self.order)
        plain = self.plain.withColumns({name: (s.whole or s.local)(w) for name, s in scans.items()})
        if self.cut is None:
            return replace(self, plain=plain)
        w = Window.partitionBy(*self.keys, SLICE).orderBy(*self.order)
        local = self.cut.withColumns({name: s.local(w) for name, s in scans.items()})
        slices = Window.partitionBy(*self.keys).orderBy(SLICE)
        carried = (
            local.groupBy(*self.keys, SLICE).agg(*[s.summary.alias(name) for name, s in scans.items()])
            .select(*self.keys, SLICE, *[s.across(F.col(name), slices).alias(f"_carry_{name}") for name, s in scans.items()])
        )
        # The rows are already spread by (keys, slice) for the window, so this join does not move them again.
        joined = match_all(local, carried, [*self.keys, SLICE], "left")
        cut = joined.withColumns({name: s.merge(F.col(f"_carry_{name}"), F.col(name)) for name, s in scans.items()})
        # Stored, because the next scan needs these rows twice: a chain of scans must not double its plan each time.
        return replace(self, plain=plain, cut=durable(cut.drop(*[f"_carry_{name}" for name in scans])))

    # --- look-up by key -----------------------------------------------------------------------------------

    def attach(self, table: DataFrame) -> Timeline:
        """Left join a table with one row per ``base`` key; cut keys meet it by broadcast, so none piles up.

        A null key matches nothing, however many rows have it.
        """
        keys = list(self.base)
        table = table.dropna(subset=keys)
        plain = self.plain.join(table, keys, "left")
        if self.cut is None:
            return replace(self, plain=plain)
        few = match_all(table, self.hot, keys, "left_semi", broadcast=True)
        return replace(self, plain=plain, cut=match_all(self.cut, few, keys, "left", broadcast=True))


def timeline(df: DataFrame, keys: Iterable[str], order: Iterable[str], largest: int | None = None) -> Timeline:
    """Order the rows of each key by ``order``, which must be unique inside a key.

    Runs one counting job over the key columns, unless the caller knows an upper bound ``largest`` of the rows
    of one key and that is small enough. Only when some key is too large for one task are its rows
    sorted into slices (range partitioning, so any distribution in time gives even slices) and written once
    to the shared folder: slice bounds are sampled, and every later use has to see the same ones.
    """
    keys, order = tuple(keys), tuple(order)
    if largest is not None and largest <= rows_per_window(df):
        return Timeline(df, None, keys, order, keys, None, None, largest)
    total, groups, largest, counts = group_sizes(df, keys)
    limit = hot_limit(df, total)
    if largest <= limit:
        dealt = spread(df, total, keys) if keys else df
        return Timeline(dealt, None, keys, order, keys, total, groups, largest)

    hot = durable(counts.filter(F.col("_rows") > limit))
    slices = math.ceil(hot.agg(F.sum("_rows")).first()[0] / rows_per_window(df))
    hot = hot.drop("_rows")
    plain, rest = broadcast_hot(df, hot, keys) if keys else (df.limit(0), df)
    cut = durable(rest.repartitionByRange(slices, *keys, *order).withColumn(SLICE, F.spark_partition_id()))
    return Timeline(plain, cut, keys, order, keys, total, groups, largest, hot)
