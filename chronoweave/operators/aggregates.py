"""Summaries: moments, percentiles, histograms, control charts, runs, hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = "series_id"


def moments(df: DataFrame, by: str = KEY, col: str = "y") -> DataFrame:
    """n, mean, sample and population deviation, variance and range in one pass."""
    return df.groupBy(by).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.stddev_pop(col).alias("std_pop"), F.var_samp(col).alias("var"),
        F.min(col).alias("low"), F.max(col).alias("high"),
    )


def summary(df: DataFrame, by: str = KEY, col: str = "y") -> DataFrame:
    """The moments with the exact median and interquartile range."""
    q = percentiles(df, {"median": 0.5, "q1_": 0.25, "q3_": 0.75}, by, col).withColumnRenamed(by, "by_")
    both = moments(df, by, col).join(q, F.col(by).eqNullSafe(F.col("by_")))
    return both.withColumn("iqr", F.col("q3_") - F.col("q1_")).drop("by_", "q1_", "q3_")


def first_last(df: DataFrame, by: str = KEY, col: str = "y") -> DataFrame:
    return df.groupBy(by).agg(F.min_by(col, "ts").alias("first"), F.max_by(col, "ts").alias("last"))


def percentiles(df: DataFrame, qs: dict[str, float], by: str = KEY, col: str = "y", exact: bool = True, near: float = 1e-3) -> DataFrame:
    """Interpolated percentiles of each group, NULL where it holds no value; exact=False gives the sketch's alone.

    Exact without a task that holds a group: a sketch marks the values just below and
    above each quantile (``near`` of the rows to either side), rows are counted
    between the marks, and only the stretches that hold a wanted rank are looked at
    value by value, each with its count. The sketch's error moves rows between the
    stretches and never changes the result.
    """
    if not exact:
        return df.groupBy(by).agg(*(F.percentile_approx(col, q, 10_000).alias(n) for n, q in qs.items()))
    cuts = sorted({min(max(q + s, 0.0), 1.0) for q in qs.values() for s in (-near, near)})
    v = df.select(F.col(by).alias("g_"), F.col(col).cast("double").alias("v_"))
    marks = v.groupBy(F.col("g_").alias("h_")).agg(F.percentile_approx("v_", cuts, 10_000).alias("m_"), F.count("v_").alias("n_"))
    above = sum(((F.col("v_") > F.col("m_")[i]).cast("int") for i in range(len(cuts))), F.lit(0))
    placed = v.where("v_ IS NOT NULL").join(marks, F.col("g_").eqNullSafe(F.col("h_"))).select("g_", above.alias("bin_"), "v_")

    so_far = W.partitionBy("g_").orderBy("bin_").rowsBetween(W.unboundedPreceding, 0)
    ends = placed.groupBy("g_", "bin_").agg(F.count("*").alias("c_")).withColumn("to_", F.sum("c_").over(so_far)).select("g_", "bin_", (F.col("to_") - F.col("c_")).alias("from_"), "to_")
    asked = F.explode(F.array(*(F.struct(F.lit(i).alias("q_"), (F.lit(q) * (F.col("n_") - 1)).alias("at_")) for i, q in enumerate(qs.values()))))
    wanted = marks.where("n_ > 0").select("h_", asked.alias("a_")).select("h_", "a_.q_", "a_.at_", F.explode(F.array(F.floor("a_.at_"), F.ceil("a_.at_"))).alias("rank_")).distinct()
    hit = wanted.join(ends, F.col("h_").eqNullSafe(F.col("g_")) & (F.col("rank_") >= F.col("from_")) & (F.col("rank_") < F.col("to_")))
    hit = hit.select(F.col("h_"), F.col("bin_").alias("b_"), "q_", "at_", "rank_", "from_")

    same = F.col("h_").eqNullSafe(F.col("g_")) & (F.col("b_") == F.col("bin_"))
    values = placed.join(hit.select("h_", "b_").distinct(), same, "left_semi").groupBy("g_", "bin_", "v_").agg(F.count("*").alias("c_"))
    upto = F.sum("c_").over(W.partitionBy("g_", "bin_").orderBy("v_").rowsBetween(W.unboundedPreceding, 0))
    rank = F.col("rank_") - F.col("from_")
    found = values.withColumn("upto_", upto).join(hit, same & (rank >= F.col("upto_") - F.col("c_")) & (rank < F.col("upto_")))
    low, high = F.min_by("v_", "rank_"), F.max_by("v_", "rank_")
    each = found.groupBy("g_", "q_", "at_").agg((low + (F.col("at_") - F.floor("at_")) * (high - low)).alias("p_"))
    wide = each.groupBy("g_").agg(*(F.max(F.when(F.col("q_") == i, F.col("p_"))).alias(n) for i, n in enumerate(qs)))
    return marks.join(wide, F.col("h_").eqNullSafe(F.col("g_")), "left").select(F.col("h_").alias(by), *qs)


def histogram(df: DataFrame, bins: int, by: str = KEY, col: str = "y", low: float | None = None, high: float | None = None, snap: int | None = None) -> DataFrame:
    """Counts and density of equal bins over each group's range, or over [low, high] with values outside left out.

    snap rounds a value's place among the bins to so many digits first, so that computed
    values on an edge fall into the upper bin whatever their last bits are.
    """
    ends = df.groupBy(by).agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(col).alias("n"))
    if low is not None:
        df = df.where(F.col(col).between(low, high))
        ends = df.groupBy(by).agg(F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"), F.count(col).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = (F.col(col) - F.col("lo")) / width
    bin_ = F.least(F.floor(F.round(place, snap) if snap else place), F.lit(bins - 1)).cast("long")
    counted = df.where(F.col(col).isNotNull()).join(ends, by).where("hi > lo").groupBy(by, bin_.alias("bin"), "lo", "hi", "n").agg(F.count("*").alias("c"))
    return counted.select(by, "bin", "c", (F.col("c") / (F.col("n") * width)).alias("density"))


def tabulate(df: DataFrame, number: Column, name: str = "k") -> DataFrame:
    """How often each whole number occurs from the least to the largest, zeros included."""
    counts = df.select(F.floor(number).cast("long").alias(name)).groupBy(name).count()
    ends = counts.agg(F.min(name).alias("lo"), F.max(name).alias("hi")).where("lo IS NOT NULL")
    every = ends.select(F.explode(F.sequence("lo", "hi")).alias(name))
    return every.join(counts, name, "left").select(name, F.coalesce("count", F.lit(0)).alias("n"))


def control_chart(df: DataFrame, sigmas: float = 3.0, by: str = KEY, col: str = "y") -> DataFrame:
    """Centre line, limits at mean plus and minus sigmas deviations of the whole series, and whether a row is outside."""
    line = df.groupBy(by).agg(F.avg(col).alias("centre"), F.stddev_samp(col).alias("s_"))
    out = df.join(line, by).withColumns({"lcl": F.col("centre") - sigmas * F.col("s_"), "ucl": F.col("centre") + sigmas * F.col("s_")}).drop("s_")
    return out.withColumn("outside", (F.col(col) > F.col("ucl")) | (F.col(col) < F.col("lcl")))


def runs(df: DataFrame, flag: str, by: str = KEY) -> DataFrame:
    """Runs of neighbouring rows for which the flag holds: first and last time and length."""
    w = W.partitionBy(by).orderBy("ts")
    d = df.withColumn("start_", (F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))).cast("int")).withColumn("run", F.sum("start_").over(w))
    return d.where(flag).groupBy(by, "run").agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.count("*").alias("n"))


def t_quantile(z: float, degrees: Column) -> Column:
    """The quantile of Student's t where the normal one is z, by the published expansion in 1 / degrees (to 1e-4 from 6 degrees on)."""
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    return sum((F.lit(c) / F.pow(degrees, F.lit(i + 1)) for i, c in enumerate(terms)), F.lit(z))


def mean_interval(df: DataFrame, z: float = 1.959963984540054, by: str = KEY, col: str = "y") -> DataFrame:
    """Mean with its standard error and t interval of each group's own degrees of freedom; z is the normal quantile of the level."""
    out = df.groupBy(by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), (F.stddev_samp(col) / F.sqrt(F.count(col))).alias("se"))
    t = F.when(F.col("n") > 1, t_quantile(z, F.col("n") - 1))
    return out.withColumns({"t": t, "lower": F.col("mean") - t * F.col("se"), "upper": F.col("mean") + t * F.col("se")})


def interval_coverage(intervals: DataFrame, truth: DataFrame, by: str = KEY) -> DataFrame:
    """Of intervals (by, lower, upper) and a true value a group (by, truth): number, the share that holds the truth, and mean width; without bounds an interval doesn't count."""
    hit = F.col("truth").between(F.col("lower"), F.col("upper"))
    known = intervals.where("lower IS NOT NULL AND upper IS NOT NULL").join(truth, by)
    return known.groupBy(by).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("coverage"), F.avg(F.col("upper") - F.col("lower")).alias("width"))


def rollup_sum(df: DataFrame, levels: list[str], col: str = "y", keep: tuple[str, ...] = ()) -> DataFrame:
    """Sums of a hierarchy's levels, from all down to the leaves, in one aggregate; level is the number of keys that are set."""
    sets = [levels[:i] for i in range(len(levels) + 1)]
    names = ", ".join([*keep, *levels])
    groups = ", ".join(f"({', '.join([*keep, *s])})" for s in sets)
    depth = " + ".join(f"(1 - grouping({c}))" for c in levels)
    return df.sparkSession.sql(f"SELECT {names}, CAST({depth} AS BIGINT) AS level, sum({col}) AS {col} FROM {{df}} GROUP BY GROUPING SETS ({groups})", df=df)


def best_column(df: DataFrame, cols: list[str], keep: list[str], name: str = "best", largest: bool = False) -> DataFrame:
    """The name of the column with the least (or largest) value of each row; of equals the first."""
    sign = -1 if largest else 1
    parts = F.array(*(F.struct((sign * F.col(c)).alias("v"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(cols)))
    return df.select(*keep, F.array_min(F.filter(parts, lambda p: p["v"].isNotNull()))["c"].alias(name))


def top_k(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps only k rows a group and task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns in one pass: (a, b, r)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*(F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs))
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    return one.selectExpr(f"stack({len(pairs)}, {stack}) AS (a, b, r)")


def variance_about_mean(df: DataFrame, by: str = KEY, col: str = "y") -> DataFrame:
    """The mean squared distance of the rows so far from the mean of all rows."""
    mean = F.avg(col).over(W.partitionBy(by))
    d = df.withColumn("m_", mean)
    w = W.partitionBy(by).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn("running_var", F.avg(F.pow(F.col(col) - F.col("m_"), 2)).over(w)).drop("m_")


def sigma_bands(df: DataFrame, by: str = KEY, col: str = "y") -> DataFrame:
    """Of each series the bands of 1, 2 and 3 deviations, the normal share and the share of rows inside."""
    line = df.groupBy(by).agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("s"))
    k = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("k"), F.lit(p).alias("normal")) for i, p in ((1, 0.6827), (2, 0.9545), (3, 0.9973)))))
    d = df.join(line, by).withColumn("b", k)
    lo, hi = F.col("m") - F.col("b.k") * F.col("s"), F.col("m") + F.col("b.k") * F.col("s")
    inside = F.avg(F.col(col).between(lo, hi).cast("double"))
    return d.groupBy(by, F.col("b.k").alias("k"), F.col("b.normal").alias("normal")).agg(F.first(lo).alias("lower"), F.first(hi).alias("upper"), inside.alias("inside"))
