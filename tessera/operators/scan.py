"""Running values along an order, by ranges of it.

A window function orders a whole group in one task. Here the rows of all groups are laid out in one order, group by group, and dealt out
by ranges of it, so that a group of any size spans as many ranges as it needs. Each range runs on its own; what a range starts from is
carried over from the ranges before it (or behind it) by the associative totals of each group's part of a range, of which there are as many as groups
and ranges together. A line is laid out once and may carry several times, each on what the last one added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.work import stored


@dataclass(frozen=True)
class Carried:
    """how: sum, min, max, count (of values that are not NULL), last (such value), or next (the value of the following row, NULL or not).
    own: whether the own row counts."""

    how: str
    value: Column
    own: bool = True


_START = Window.unboundedPreceding


def _total(how: str, value: Column) -> Column:
    return {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[how](value)


def _joined(how: str, before: Column, here: Column) -> Column:
    if how in ("sum", "count"):
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)
    return {"min": F.least, "max": F.greatest}[how](before, here) if how != "last" else F.coalesce(here, before)


class Line:
    """df's rows in the order of `by`, then `order`; ranges: into how many the line is cut (1: plain windows). Rows that tie in all of
    `order` stand in some order, the same for all that is carried."""

    def __init__(self, df: DataFrame, by: list[str], order: list[str], ranges: int = 1):
        self.by, self.order, self.ranges, self.names = by, order, ranges, df.columns
        if ranges > 1:
            keys = [F.col(c).asc_nulls_last() for c in (*by, *order)]
            at = F.monotonically_increasing_id()
            df = stored(df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_at", at).withColumn("_range", F.shiftright(at, 33)))
        self.rows = df

    def _window(self, *more: str):
        keys = ["_at"] if self.ranges > 1 else [F.col(c).asc_nulls_last() for c in self.order]
        return Window.partitionBy(*self.by, *more).orderBy(*keys)

    def _running(self, c: Carried, w) -> Column:
        if c.how == "next":
            return F.lead(c.value).over(w)
        w = w.rowsBetween(_START, 0 if c.own else -1)
        return F.last(c.value, ignorenulls=True).over(w) if c.how == "last" else _total(c.how, c.value).over(w)

    def carry(self, **columns: Carried) -> Line:
        """Adds a column for each; NULL where nothing counts yet (0 for count)."""
        if self.ranges <= 1:
            self.rows = self.rows.withColumns({n: self._running(c, self._window()) for n, c in columns.items()})
        else:
            self.rows = self._carried(columns)
        self.names = [*(n for n in self.names if n not in columns), *columns]
        return self

    def _carried(self, columns: dict[str, Carried]) -> DataFrame:
        totals = []
        for n, c in columns.items():
            if c.how == "next":
                totals.append(F.min_by(F.struct(c.value.alias("v")), F.col("_at")).alias(f"_t_{n}"))
            elif c.how == "last":
                totals.append(F.max_by(c.value, F.when(c.value.isNotNull(), F.col("_at"))).alias(f"_t_{n}"))
            else:
                totals.append(_total(c.how, c.value).alias(f"_t_{n}"))
        parts = self.rows.groupBy(*self.by, "_range").agg(*totals, F.max("_at").alias("_end"))
        order = Window.partitionBy(*self.by).orderBy("_range")
        before = order.rowsBetween(_START, -1)
        start = {}
        for n, c in columns.items():
            t = F.col(f"_t_{n}")
            start[n] = F.lead(t).over(order) if c.how == "next" else F.last(t, ignorenulls=True).over(before) if c.how == "last" else _total("sum" if c.how == "count" else c.how, t).over(before)
        keys = {k: f"_by_{k}" for k in self.by}
        # Stored, so that the planner knows how small it is; else the rows would move for the join.
        starts = stored(parts.select(*(F.col(k).alias(a) for k, a in keys.items()), F.col("_range").alias("_of"), "_end", *(v.alias(f"_s_{n}") for n, v in start.items())))
        here = self._window("_range")
        rows = self.rows.withColumns({f"_h_{n}": self._running(c, here) for n, c in columns.items()})
        rows = rows.join(starts, [F.col("_range") == F.col("_of"), *(F.col(k).eqNullSafe(F.col(a)) for k, a in keys.items())])
        kept = [c for c in self.rows.columns if c not in columns]
        out = []
        for n, c in columns.items():
            s, h = F.col(f"_s_{n}"), F.col(f"_h_{n}")
            out.append((F.when(F.col("_at") == F.col("_end"), s["v"]).otherwise(h) if c.how == "next" else _joined(c.how, s, h)).alias(n))
        return rows.select(*kept, *out)

    def numbered(self, name: str) -> Line:
        """Adds a place that rises by one from row to row of a group; it need not begin at one."""
        if self.ranges <= 1:
            self.rows = self.rows.withColumn(name, F.row_number().over(self._window()).cast("long"))
        else:
            counts = self.rows.groupBy("_range").agg(F.count("*").alias("_n"))
            starts = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(_START, -1)), F.lit(0)).alias("_start"))
            rows = self.rows.join(F.broadcast(starts), "_range")  # a row for each range
            self.rows = rows.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_start")
        self.names = [*(n for n in self.names if n != name), name]
        return self

    def done(self) -> DataFrame:
        return self.rows.select(*self.names)
