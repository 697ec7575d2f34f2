"""Running values of long series: each series is cut into segments of time, and what came before is carried into each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = "series_id"
#: Rows that a segment holds about.
ROWS = 1_000_000
#: Cells that rows are counted in, for each segment that a series needs.
CELLS = 16


def position(df: DataFrame, col: str) -> Column:
    """A number that grows with the column: a time as seconds, whatever the session's time zone."""
    kind = dict(df.dtypes)[col]
    c = F.col(col)
    if kind == "timestamp":
        return F.unix_micros(c) / 1e6
    if kind in ("timestamp_ntz", "date"):
        return (F.datediff(c, F.lit("1970-01-01").cast("date")) * 86400 + (F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c) if kind != "date" else 0)).cast("double")
    return c.cast("double")


def _merged(kind: str, before: Column, here: Column) -> Column:
    """Of what came before a segment and what its rows give so far; either may be NULL."""
    if kind == "last":
        return F.coalesce(here, before)
    if kind in ("max", "min"):
        return (F.greatest if kind == "max" else F.least)(before, here)
    return F.coalesce(before + here, here, before)


def scan(df: DataFrame, running: dict[str, tuple[str, Column]], order: str = "ts", ties: tuple[str, ...] = (), by: str = KEY, rows: int = ROWS, centre: str | None = None) -> DataFrame:
    """Adds running values of all rows so far in the order of a column, a series being spread over tasks.

    running: name: (kind, value); the kinds are sum, count, max, min, last (the last known value) and rows (the row's number from 1).
    Values may use ``centre_``, the series' mean of the column ``centre``, which keeps sums of squares small.

    Rows are counted and added up in equal cells of the order's range first; neighbouring cells make segments of about ``rows`` rows,
    each segment gets what all cells before it give, and windows run within segments alone. What is carried has one row a
    cell. Rows of equal order stay together, and a cell that a burst fills is not cut. NULLs of the order come first.
    """
    ends = df.groupBy(F.col(by).alias("g_")).agg(
        F.count("*").alias("n_"), F.min(position(df, order)).alias("lo_"), F.max(position(df, order)).alias("hi_"), *([F.avg(centre).alias("centre_")] if centre else [])
    )
    parts = F.ceil(F.col("n_") / rows) * CELLS
    share = F.coalesce(F.try_divide(position(df, order) - F.col("lo_"), F.col("hi_") - F.col("lo_")), F.lit(0.0))
    cell = F.when(parts == CELLS, 0).when(F.col(order).isNull(), -1).otherwise(F.least(F.floor(share * parts), parts - 1))  # a series of one segment has one cell
    placed = df.join(ends, F.col(by).eqNullSafe(F.col("g_"))).withColumn("cell_", cell.cast("long")).drop("g_", "n_", "lo_", "hi_")

    pos = position(df, order)
    total = {
        "sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "rows": lambda v: F.count("*"),
        "last": lambda v: F.max_by(v, F.when(v.isNotNull(), F.struct(pos, order, *ties))),
    }
    cells = placed.groupBy(F.col(by).alias("g_"), F.col("cell_").alias("c_")).agg(F.count("*").alias("n_"), *(total[k](v).alias(f"{n}_t") for n, (k, v) in running.items()))
    so_far = W.partitionBy("g_").orderBy("c_").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("seg_", F.floor(F.coalesce(F.sum("n_").over(so_far), F.lit(0)) / rows))
    before = W.partitionBy("g_").orderBy("seg_").rangeBetween(W.unboundedPreceding, -1)
    prefix = {"sum": F.sum, "count": F.sum, "rows": F.sum, "max": F.max, "min": F.min}
    latest = W.partitionBy("g_").orderBy("seg_", "c_")
    carried = {}
    for n, (k, _) in running.items():
        if k == "last":
            cells = cells.withColumn(f"{n}_l", F.last(f"{n}_t", ignorenulls=True).over(latest.rowsBetween(W.unboundedPreceding, 0)))
            carried[f"{n}_b"] = F.last(f"{n}_l").over(before)
        else:
            carried[f"{n}_b"] = prefix[k](f"{n}_t").over(before)
    cells = cells.withColumns(carried).select("g_", "c_", "seg_", *carried)

    w = W.partitionBy(by, "seg_").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, 0)
    here = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "rows": lambda v: F.count("*"), "last": lambda v: F.last(v, ignorenulls=True)}
    both = placed.join(cells, F.col(by).eqNullSafe(F.col("g_")) & (F.col("cell_") == F.col("c_")))
    return both.withColumns({n: _merged(k, F.col(f"{n}_b"), here[k](v).over(w)) for n, (k, v) in running.items()}).drop("g_", "c_", "cell_", "seg_", *carried)


def forward_fill(df: DataFrame, col: str = "y", by: str = KEY, rows: int = ROWS) -> DataFrame:
    """Each NULL takes the last known value before it."""
    return scan(df, {"filled_": ("last", F.col(col))}, by=by, rows=rows).withColumn(col, F.col("filled_")).drop("filled_")


def cumulated(df: DataFrame, col: str, name: str = "total", by: str = KEY, rows: int = ROWS) -> DataFrame:
    return scan(df, {name: ("sum", F.col(col))}, by=by, rows=rows)


def compounded(df: DataFrame, col: str, name: str = "product", by: str = KEY, rows: int = ROWS) -> DataFrame:
    """Running product of positive factors, as the exponential of a sum of logarithms."""
    return scan(df, {name: ("sum", F.log(col))}, by=by, rows=rows).withColumn(name, F.exp(name))


def expanding(df: DataFrame, col: str = "y", by: str = KEY, rows: int = ROWS) -> DataFrame:
    """Mean, sample deviation (the first one is 0) and number of all values so far."""
    z = F.col(col) - F.col("centre_")
    d = scan(df, {"n": ("count", F.col(col)), "s_": ("sum", z), "q_": ("sum", z * z)}, by=by, rows=rows, centre=col)
    spread = F.greatest(F.col("q_") - F.col("s_") * F.col("s_") / F.col("n"), F.lit(0.0)) / (F.col("n") - 1)
    return d.withColumns({"mean": F.when(F.col("n") > 0, F.col("centre_") + F.col("s_") / F.col("n")), "std": F.when(F.col("n") > 1, F.sqrt(spread)).otherwise(0.0)}).drop("s_", "q_", "centre_")


def variance_about_mean(df: DataFrame, col: str = "y", by: str = KEY, rows: int = ROWS) -> DataFrame:
    """The mean squared distance of the values so far from the mean of all."""
    z = F.col(col) - F.col("centre_")
    d = scan(df, {"n_so_far_": ("count", F.col(col)), "q_": ("sum", z * z)}, by=by, rows=rows, centre=col)
    return d.withColumn("running_var", F.col("q_") / F.col("n_so_far_")).drop("q_", "n_so_far_", "centre_")


def ranked(df: DataFrame, col: str, ties: tuple[str, ...], name: str = "place", by: str = KEY, rows: int = ROWS) -> DataFrame:
    """The place of each row, from 1, in ascending order of a column; NULLs come first."""
    return scan(df, {name: ("rows", F.lit(1))}, order=col, ties=ties, by=by, rows=rows)
