"""Queries on decomposition, splits, metrics and forecasting models."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from chronoweave.catalogue import query
from chronoweave.operators import aggregates as A
from chronoweave.operators import decompose as D
from chronoweave.operators import diagnostics as G
from chronoweave.operators import evaluate as V
from chronoweave.operators import models as M
from chronoweave.operators import recurrences as R
from chronoweave.operators import trend as K
from chronoweave.operators import tuning
from chronoweave.operators import windows as X
from chronoweave.plans.basics import SEGMENT
from chronoweave.plans.panels import DAILY, FULL, SHIPPED, daily, hourly_full, rounded, shipped, table
from chronoweave.plans.science import _CROSS, _SWEEP

_PART = "q AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS r FROM p), train AS (SELECT * FROM q WHERE r > 24), test AS (SELECT series_id, ts, y, 25 - r AS h FROM q WHERE r <= 24)"
_METRICS = (
    "count(*) AS n, round(avg((y - f) ** 2), 6) AS mse, round(sqrt(avg((y - f) ** 2)), 6) AS rmse, round(avg(abs(y - f)), 6) AS mae, round(avg(abs((y - f) / nullif(y, 0))), 6) AS mape, "
    "round(avg(2 * abs(y - f) / nullif(abs(y) + abs(f), 0)), 6) AS smape, round(1 - sum((y - f) ** 2) / (var_pop(y) * count(*)), 6) AS r2"
)


def _split(spark, d):
    parts = V.holdout(hourly_full(spark, d), 24)
    return parts.where("part = 'train'").drop("part"), X.numbered(parts.where("part = 'test'").drop("part"), "h").withColumn("h", F.col("h") + 1)


def _seasonal_naive(train, m: int):
    """The last season's values by their place in it; no Python."""
    last = X.numbered(V.tail(train, m), "k").withColumn("h", F.col("k") + 1)
    return last.select("series_id", "h", F.col("y").alias("yhat"))


@query(f"WITH {FULL}, {_PART}, s AS (SELECT series_id, y AS f, 49 - r AS h FROM q WHERE r BETWEEN 25 AND 48) SELECT series_id, {_METRICS} FROM test JOIN s USING (series_id, h) GROUP BY 1")
def forecast_slice(spark, d):
    """Typing, hourly grid, filling, last-day hold-out, seasonal-naive forecast, metrics: the whole way in built-ins."""
    train, test = _split(spark, d)
    return rounded(V.score(test.join(_seasonal_naive(train, 24), ["series_id", "h"]), ["series_id"]))


@query(f"WITH {FULL}, {_PART} SELECT series_id, 49 - r AS h, round(y, 6) AS yhat FROM q WHERE r BETWEEN 25 AND 48")
def seasonal_naive(spark, d):
    return rounded(_seasonal_naive(_split(spark, d)[0], 24))


@query(f"WITH {FULL}, {_PART}, m AS (SELECT series_id, avg(y) AS f FROM train GROUP BY 1) SELECT series_id, h, round(f, 6) AS yhat FROM m, (SELECT unnest(range(1, 25)) AS h)")
def historic_average(spark, d):
    mean = _split(spark, d)[0].groupBy("series_id").agg(F.avg("y").alias("yhat"))
    return rounded(mean.select("series_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(24).cast("long"))).alias("h"), "yhat"))


@query(f"WITH {FULL}, {_PART}, s AS (SELECT series_id, y AS f, 49 - r AS h FROM q WHERE r BETWEEN 25 AND 48), m AS (SELECT series_id, avg(y) AS f FROM train GROUP BY 1), b AS (SELECT t.series_id, avg((t.y - s.f) ** 2) AS snaive, avg((t.y - m.f) ** 2) AS mean FROM test t JOIN s USING (series_id, h) JOIN m USING (series_id) GROUP BY 1) SELECT series_id, CASE WHEN snaive <= mean THEN 'snaive' ELSE 'mean' END AS best FROM b")
def best_model_per_series(spark, d):
    train, test = _split(spark, d)
    mean = train.groupBy("series_id").agg(F.avg("y").alias("m"))
    both = test.join(_seasonal_naive(train, 24), ["series_id", "h"]).join(mean, "series_id")
    err = both.groupBy("series_id").agg(F.avg(F.pow(F.col("y") - F.col("yhat"), 2)).alias("snaive"), F.avg(F.pow(F.col("y") - F.col("m"), 2)).alias("mean"))
    return A.best_column(err, ["snaive", "mean"], ["series_id"])


@query(f"WITH {FULL}, q AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) - 1 AS r FROM p), c AS (SELECT unnest([0, 1, 2]) AS cutoff), t AS (SELECT q.series_id, cutoff, y, 24 - (r - 24 * cutoff) AS h FROM q, c WHERE r >= 24 * cutoff AND r < 24 * cutoff + 24), s AS (SELECT q.series_id, cutoff, y AS f, 48 - (r - 24 * cutoff) AS h FROM q, c WHERE r >= 24 * cutoff + 24 AND r < 24 * cutoff + 48) SELECT series_id, cutoff::BIGINT AS cutoff, {_METRICS} FROM t JOIN s USING (series_id, cutoff, h) GROUP BY 1, 2")
def naive_cv(spark, d):
    return rounded(V.score(V.naive_backtest(hourly_full(spark, d), 24, 3), ["series_id", "cutoff"]))


@query(f"WITH {FULL}, f AS (SELECT series_id, list_reduce(list(y ORDER BY ts), lambda a, x: 0.5 * x + 0.5 * a) AS level FROM p GROUP BY 1) SELECT series_id, round(level, 6) AS level FROM f")
def ses_fixed(spark, d):
    return rounded(D.ses_level(hourly_full(spark, d), 0.5))


@query(f"WITH RECURSIVE {FULL}, n AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM p), r AS (SELECT series_id, i, y AS l, 0.0::DOUBLE AS b FROM n WHERE i = 1 UNION ALL SELECT r.series_id, n.i, 0.5 * n.y + 0.5 * (r.l + r.b), 0.5 * (0.5 * n.y + 0.5 * (r.l + r.b) - r.l) + 0.5 * r.b FROM r JOIN n ON n.series_id = r.series_id AND n.i = r.i + 1) SELECT series_id, round(l, 6) AS level, round(b, 6) AS slope FROM r QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY i DESC) = 1")
def holt_fixed(spark, d):
    return rounded(D.holt_state(hourly_full(spark, d), 0.5, 0.5))


@query(f"WITH RECURSIVE {FULL}, n AS (SELECT series_id, CASE WHEN y > 60 THEN y ELSE 0 END AS y, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM p), r AS (SELECT series_id, i, CASE WHEN y > 0 THEN y END AS z, CASE WHEN y > 0 THEN 1.0::DOUBLE END AS p, CASE WHEN y > 0 THEN 1.0::DOUBLE ELSE 2.0 END AS q FROM n WHERE i = 1 UNION ALL SELECT r.series_id, n.i, CASE WHEN n.y <= 0 THEN z WHEN z IS NULL THEN n.y ELSE 0.1 * n.y + 0.9 * z END, CASE WHEN n.y <= 0 THEN p WHEN p IS NULL THEN q ELSE 0.1 * q + 0.9 * p END, CASE WHEN n.y > 0 THEN 1.0 ELSE q + 1 END FROM r JOIN n ON n.series_id = r.series_id AND n.i = r.i + 1) SELECT series_id, round(z / p, 6) AS forecast FROM r QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY i DESC) = 1")
def croston(spark, d):
    p = hourly_full(spark, d).withColumn("y", F.when(F.col("y") > 60, F.col("y")).otherwise(0.0))
    return rounded(D.croston(p))


def _decompose(table_: str, k: int, times: bool) -> str:
    h, op = k // 2, "/" if times else "-"
    back = "y / (trend * seasonal)" if times else "y - trend - seasonal"
    w = "OVER (PARTITION BY series_id ORDER BY ts"
    n = 2 * h + 1
    trend = f"CASE WHEN count(y) {w} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) = {n} THEN (sum(y) {w} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)" + (
        f" - (lag(y, {h}) {w}) + lead(y, {h}) {w})) / 2) / {k} END" if k % 2 == 0 else f") / {k} END"
    )
    return (
        f"t AS (SELECT series_id, ts, y, {trend} AS trend, (row_number() {w}) - 1) % {k} AS slot FROM {table_}), m AS (SELECT series_id, slot, avg(y {op} trend) AS m FROM t GROUP BY 1, 2), "
        f"s AS (SELECT series_id, slot, m {op} avg(m) OVER (PARTITION BY series_id) AS seasonal FROM m), dec AS (SELECT series_id, ts, y, trend, seasonal, {back} AS resid FROM t JOIN s USING (series_id, slot))"
    )


_DEC = "SELECT series_id, ts, round(y, 8) AS y, round(trend, 8) AS trend, round(seasonal, 8) AS seasonal, round(resid, 8) AS resid FROM dec"


@query(f"WITH {FULL}, {_decompose('p', 24, False)} {_DEC}")
def decompose_additive(spark, d):
    return rounded(D.seasonal(hourly_full(spark, d), 24), 8)


@query(f"WITH {DAILY}, {_decompose('d', 7, True)} {_DEC}")
def decompose_multiplicative(spark, d):
    return rounded(D.seasonal(daily(spark, d), 7, "multiplicative"), 8)


@query(f"WITH {FULL}, {_decompose('p', 24, False)} SELECT series_id, CASE WHEN arg_max(trend, ts) FILTER (trend IS NOT NULL) > arg_min(trend, ts) FILTER (trend IS NOT NULL) THEN 'up' ELSE 'down' END AS direction, round(abs(arg_max(trend, ts) FILTER (trend IS NOT NULL) - arg_min(trend, ts) FILTER (trend IS NOT NULL)) / count(trend), 6) AS strength, round(max(seasonal) - min(seasonal), 6) AS amplitude, round(var_samp(resid), 6) AS resid_var FROM dec GROUP BY 1")
def component_summary(spark, d):
    return rounded(D.component_summary(D.seasonal(hourly_full(spark, d), 24)))


@query(f"WITH {FULL} SELECT series_id, ts, round((y - min(y) OVER s) / (max(y) OVER s - min(y) OVER s), 6) AS scaled, round(y, 6) AS back FROM p WINDOW s AS (PARTITION BY series_id)")
def minmax_scale(spark, d):
    return rounded(D.unminmax(D.minmax(hourly_full(spark, d)), name="back").select("series_id", "ts", "scaled", "back"))


@query(f"WITH {FULL} SELECT series_id, ts, round((y - avg(y) OVER s) / stddev_pop(y) OVER s, 6) AS scaled, round(y, 6) AS back FROM p WINDOW s AS (PARTITION BY series_id)")
def standard_scale(spark, d):
    return rounded(D.unstandard(D.standard(hourly_full(spark, d)), name="back").select("series_id", "ts", "scaled", "back"))


@query(f"WITH {FULL} SELECT series_id, part, count(*) AS n FROM (SELECT series_id, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY ts) <= floor(count(*) OVER (PARTITION BY series_id) * 0.8) THEN 'train' ELSE 'test' END AS part FROM p) GROUP BY 1, 2")
def fraction_split(spark, d):
    return V.fraction(hourly_full(spark, d), 0.8).groupBy("series_id", "part").agg(F.count("*").alias("n"))


def _folded(spark, d, scheme, **how):
    both = V.with_folds(X.numbered(daily(spark, d)), scheme, **how)
    return rounded(both.groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("i").alias("first"), F.max("i").alias("last"), F.avg("y").alias("mean")))


_N = f"WITH {DAILY}, i AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i FROM d), c AS (SELECT count(*) AS n FROM d)"
_FOLD = "SELECT fold, part, count(*) AS n, min(i) AS first, max(i) AS last, round(avg(y), 6) AS mean FROM (SELECT i.*, fold, CASE WHEN i >= c_ AND i < d_ THEN 'test' WHEN i >= a_ AND i < b_ THEN 'train' END AS part FROM i, b) WHERE part IS NOT NULL GROUP BY 1, 2"


@query(f"{_N}, b AS (SELECT f AS fold, 0 AS a_, (f + 1) * (n // 6) AS b_, (f + 1) * (n // 6) AS c_, (f + 2) * (n // 6) AS d_ FROM c, (SELECT unnest(range(5)) AS f)) {_FOLD}")
def expanding_folds(spark, d):
    return _folded(spark, d, "expanding", k=5)


@query(f"{_N}, b AS (SELECT f AS fold, f * 100 AS a_, f * 100 + 400 AS b_, f * 100 + 400 AS c_, f * 100 + 500 AS d_ FROM c, (SELECT unnest(range(100)) AS f) WHERE f * 100 + 500 <= n) {_FOLD}")
def rolling_folds(spark, d):
    return _folded(spark, d, "rolling", window=400, step=100)


@query(f"{_N}, b AS (SELECT f AS fold, f * 30 AS a_, f * 30 + 365 AS b_, f * 30 + 365 AS c_, f * 30 + 395 AS d_ FROM c, (SELECT unnest(range(200)) AS f) WHERE f * 30 + 395 <= n) {_FOLD}")
def sliding_folds(spark, d):
    return _folded(spark, d, "sliding", window=365, step=30)


@query(f"{_N}, b AS (SELECT f AS fold, 0 AS a_, 5 * (n // 5) AS b_, f * (n // 5) AS c_, (f + 1) * (n // 5) AS d_ FROM c, (SELECT unnest(range(5)) AS f)) {_FOLD}")
def blocked_folds(spark, d):
    return _folded(spark, d, "blocked", k=5)


@query(f"{_N}, b AS (SELECT f AS fold, 0 AS a_, n - (5 - f) * (n // 6) AS b_, n - (5 - f) * (n // 6) AS c_, n - (4 - f) * (n // 6) AS d_ FROM c, (SELECT unnest(range(5)) AS f)), e AS (SELECT i, y, fold, CASE WHEN i >= c_ AND i < d_ THEN 'test' WHEN i < b_ THEN 'train' END AS part FROM i, b), m AS (SELECT fold, regr_slope(y, i) AS s, regr_intercept(y, i) AS o FROM e WHERE part = 'train' GROUP BY 1) SELECT fold, count(*) AS n, round(avg((y - o - s * i) ** 2) / 1e6, 4) AS mse FROM e JOIN m USING (fold) WHERE part = 'test' GROUP BY 1")
def ts_split_cv_mse(spark, d):
    both = V.with_folds(X.numbered(daily(spark, d)), "ts_split", k=5)
    line = both.where("part = 'train'").groupBy("fold").agg(F.regr_slope("y", "i").alias("s"), F.regr_intercept("y", "i").alias("o"))
    err = F.pow(F.col("y") - F.col("o") - F.col("s") * F.col("i"), 2)
    return both.where("part = 'test'").join(line, "fold").groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg(err) / 1e6, 4).alias("mse"))


@query(f"{_N}, m AS (SELECT regr_slope(y, i) AS s, regr_intercept(y, i) AS o FROM i) SELECT h, round(o + s * (n - 1 + h), 4) AS yhat FROM m, c, (SELECT unnest(range(1, 31)) AS h)")
def linear_trend_forecast(spark, d):
    line = X.numbered(daily(spark, d)).agg(F.regr_slope("y", "i").alias("s"), F.regr_intercept("y", "i").alias("o"), F.count("*").alias("n"))
    h = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(30).cast("long")))
    return line.select("*", h.alias("h")).select("h", F.round(F.col("o") + F.col("s") * (F.col("n") - 1 + F.col("h")), 4).alias("yhat"))


@query(f"WITH {DAILY}, {SHIPPED}, j AS (SELECT ts, d.y AS y, l.y AS x FROM d JOIN l USING (ts)), r AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM j), e AS (SELECT ts, y, x, y - a - b * x AS e FROM j, r), g AS (SELECT y - lag(y) OVER w AS dy, x - lag(x) OVER w AS dx, lag(e) OVER w AS e1 FROM e WINDOW w AS (ORDER BY ts)), k AS (SELECT * FROM g WHERE dy IS NOT NULL), m AS (SELECT var_pop(dx) AS xx, var_pop(e1) AS ee, covar_pop(dx, e1) AS xe, covar_pop(dx, dy) AS xy, covar_pop(e1, dy) AS ey, avg(dy) AS my, avg(dx) AS mx, avg(e1) AS me FROM k) SELECT round((xy * ee - ey * xe) / (xx * ee - xe * xe), 6) AS beta, round((ey * xx - xy * xe) / (xx * ee - xe * xe), 6) AS gamma FROM m")
def ecm_two_stage(spark, d):
    """Level regression, then the changes on the other series' changes and the last level error, by covariances."""
    j = daily(spark, d).select("ts", "y").join(shipped(spark, d).select("ts", F.col("y").alias("x")), "ts").withColumn("series_id", F.lit("all"))
    line = j.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a")).first()
    e = j.withColumn("e", F.col("y") - line["a"] - line["b"] * F.col("x"))
    w = X.ordered()
    g = e.select((F.col("y") - F.lag("y").over(w)).alias("dy"), (F.col("x") - F.lag("x").over(w)).alias("dx"), F.lag("e").over(w).alias("e1")).where("dy IS NOT NULL")
    m = g.agg(F.var_pop("dx").alias("xx"), F.var_pop("e1").alias("ee"), F.covar_pop("dx", "e1").alias("xe"), F.covar_pop("dx", "dy").alias("xy"), F.covar_pop("e1", "dy").alias("ey"))
    return m.selectExpr("round((xy * ee - ey * xe) / (xx * ee - xe * xe), 6) AS beta", "round((ey * xx - xy * xe) / (xx * ee - xe * xe), 6) AS gamma")


@query("WITH c AS (SELECT o_custkey, o_totalprice AS y, epoch(o_orderdate) / 86400.0 AS x FROM orders), w AS (SELECT y - avg(y) OVER (PARTITION BY o_custkey) AS y, x - avg(x) OVER (PARTITION BY o_custkey) AS x FROM c) SELECT round(sum(x * y) / sum(x * x), 4) AS slope FROM w")
def panel_fe(spark, d):
    """Fixed effects: slope of the values about their entity's means, from each entity's sums in one aggregate."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_totalprice").alias("y"), (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400.0).alias("x"))
    s = o.groupBy("o_custkey").agg(F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.count("*").alias("n"))
    return s.agg(F.round(F.sum(F.col("xy") * F.col("n")) / F.sum(F.col("xx") * F.col("n")), 4).alias("slope"))


@query("WITH m AS (SELECT n_regionkey, n_nationkey, avg(o_totalprice) AS f FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT n_regionkey, (1 - grouping(n_regionkey))::BIGINT AS level, round(sum(f), 4) AS y FROM m GROUP BY GROUPING SETS ((), (n_regionkey))")
def bottom_up_naive(spark, d):
    """Leaf forecasts (means by nation) added up to their regions and the total."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    leaf = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.avg("o_totalprice").alias("y")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(A.rollup_sum(leaf.select("n_regionkey", "y"), ["n_regionkey"]), 4)


def _models(*names: str):
    def run(spark, d):
        return M.forecast(hourly_full(spark, d), {n: M.MODELS[n]() for n in names}, 24, fallback=M.naive())

    return run


@query()
def arima_forecast(spark, d):
    return _models("arima_111", "arima_212", "sparse_ar", "sarima")(spark, d)


@query()
def auto_arima(spark, d):
    return M.auto_arima_rows(hourly_full(spark, d), 24, fallback=M.naive())


@query()
def holt_winters(spark, d):
    return _models("ets", "damped_trend", "theta", "fft")(spark, d)


@query()
def smoothing_choice(spark, d):
    """Of six forms of smoothing the one with the least corrected AIC for each hourly series, a day ahead."""
    return K.smoothing_choice(hourly_full(spark, d), 24)


@query()
def mlp_forecast(spark, d):
    return _models("mlp")(spark, d)


@query()
def leaderboard(spark, d):
    """Models compared over backtest windows, with the average of the three best as one more."""
    models = {n: M.MODELS[n]() for n in ("naive", "seasonal_naive", "average", "sparse_ar", "theta", "ets")}
    out = M.backtest(hourly_full(spark, d), models, 24, 24, 2)
    board = V.score(out, ["series_id", "model"])
    best = A.top_k(board.select("series_id", "model", "rmse"), "series_id", [F.col("rmse"), F.col("model")], 3).select("series_id", "model")
    stacked = out.join(best, ["series_id", "model"]).groupBy("series_id", "cutoff", "h").agg(F.first("y").alias("y"), F.avg("yhat").alias("yhat"))
    return board.unionByName(V.score(stacked.withColumn("model", F.lit("top3_mean")), ["series_id", "model"]))


#: Candidates of tuned_models: what SQL can say too.
_CANDIDATES = [*(("naive", {"season": m}) for m in (1, 2, 12, 24, 48)), *(("average", {"last": m}) for m in (6, 24, 72))]


@query(
    f"WITH {FULL}, r AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) - 1 AS r FROM p), l AS (SELECT series_id, list(y ORDER BY r) AS x FROM r GROUP BY 1), "
    "c(candidate, model, m) AS (VALUES " + ", ".join(f"({i}, '{n}', {next(iter(p.values()))})" for i, (n, p) in enumerate(_CANDIDATES)) + "), "
    "e AS (SELECT series_id, candidate, model, m, k, CASE WHEN len(x) >= 24 * k + 24 + m THEN list_avg(list_transform(range(1, 25), lambda h: (x[24 * k + 25 - h] - CASE WHEN model = 'naive' THEN x[24 * k + 24 + m - (h - 1) % m] ELSE list_avg(x[24 * k + 25:24 * k + 24 + m]) END) ** 2)) END AS e "
    "FROM l, c, (SELECT unnest(range(4)) AS k)), "
    + ", ".join(
        f"s{i} AS (SELECT series_id, candidate, model, m, CASE WHEN count(e) = {n} THEN sqrt(avg(e)) END AS rmse FROM e WHERE k < {n}{f' AND (series_id, candidate) IN (SELECT (series_id, candidate) FROM s{i - 1})' if i else ''} GROUP BY series_id, candidate, model, m QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(rmse, 9) NULLS LAST, candidate) <= {left})"
        for i, (n, left) in enumerate(((1, 4), (2, 2), (4, 1)))
    )
    + " SELECT series_id, candidate::BIGINT AS candidate, model, CASE WHEN model = 'naive' THEN '{\"season\": ' ELSE '{\"last\": ' END || m || '}' AS params, 4::BIGINT AS cutoffs, round(rmse, 6) AS rmse FROM s2"
)
def tuned_models(spark, d):
    """Of eight models the best a day ahead for each hourly series: all from one cutoff, the best four from two, the best two from four."""
    return rounded(tuning.successive_halving(hourly_full(spark, d), _CANDIDATES, 24))


def _features(spark, d):
    p = M.calendar_lags(hourly_full(spark, d), {k: F.lag("y", k).over(X.ordered()) for k in (1, 2, 24)}).dropna()
    return VectorAssembler(inputCols=M.feature_names((1, 2, 24)), outputCol="features").transform(V.holdout(p, 24))


def _fitted(spark, d, model):
    """One-step scores: the lags of a held-out hour are true values, also those within the held-out day."""
    f = _features(spark, d)
    out = model.fit(f.where("part = 'train'")).transform(f.where("part = 'test'"))
    return V.score(out.withColumnRenamed("prediction", "yhat"), ["series_id"])


@query()
def rf_forecast(spark, d):
    from pyspark.ml.regression import RandomForestRegressor

    return _fitted(spark, d, RandomForestRegressor(labelCol="y", numTrees=20, seed=42))


@query()
def gbt_lags(spark, d):
    from pyspark.ml.regression import GBTRegressor

    return _fitted(spark, d, GBTRegressor(labelCol="y", maxIter=10, seed=42))


@query()
def gbt_recursive(spark, d):
    """The same trees over the held-out day from their own forecasts: no true value of that day is a feature."""
    from pyspark.ml.regression import GBTRegressor

    model = GBTRegressor(labelCol="y", maxIter=10, seed=42).fit(_features(spark, d).where("part = 'train'"))
    train, test = _split(spark, d)
    return rounded(V.score(test.join(M.recursive_forecast(model, train, (1, 2, 24), 24), ["series_id", "h"]), ["series_id"]))


_I = "n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n, lag(y) OVER (PARTITION BY series_id ORDER BY ts) AS l FROM p)"


@query(
    f"WITH {FULL}, {_I}, m AS (SELECT series_id, regr_slope(y, l) AS b, regr_intercept(y, l) AS a FROM n WHERE i < floor(n * 0.8) GROUP BY 1), o AS (SELECT series_id, i, y AS last FROM n WHERE i >= floor(n * 0.8) - 1 AND i + 12 < n), k AS (SELECT unnest(range(1, 13)) AS h) "
    "SELECT series_id, n.ts, h, round(n.y, 6) AS y, round(a * (1 - b ** h) / (1 - b) + b ** h * last, 6) AS yhat FROM o JOIN m USING (series_id), k JOIN n ON n.series_id = o.series_id AND n.i = o.i + h"
)
def historical_forecasts(spark, d):
    """An autoregression of one lag fitted on the first four fifths, twelve hours ahead from every later hour."""
    return rounded(M.historical_forecasts(hourly_full(spark, d), (1,), 0.8, 12))


@query(
    f"WITH {FULL}, q AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) - 1 AS r FROM p), c AS (SELECT unnest(range(4)) AS cutoff), f AS (SELECT series_id, cutoff, avg(y) AS yhat FROM q, c WHERE r >= 12 * cutoff + 12 AND r < 12 * cutoff + 112 GROUP BY 1, 2) "
    "SELECT series_id, cutoff::BIGINT AS cutoff, 12 * cutoff + 12 - r AS h, round(y, 6) AS y, round(yhat, 6) AS yhat FROM q JOIN f USING (series_id) WHERE r >= 12 * cutoff AND r < 12 * cutoff + 12"
)
def rolling_refit(spark, d):
    """A mean refitted on the last 100 hours before each of four cutoffs."""
    out = M.backtest(hourly_full(spark, d), {"average": M.average()}, 12, 12, 4, window=100)
    return rounded(out.select("series_id", "cutoff", "h", "y", "yhat"))


@query(f"WITH RECURSIVE {FULL}, n AS (SELECT series_id, ts, y, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM p), r AS (SELECT series_id, i, ts, y, NULL::DOUBLE AS fitted, y AS l FROM n WHERE i = 1 UNION ALL SELECT r.series_id, n.i, n.ts, n.y, l, 0.5 * n.y + 0.5 * l FROM r JOIN n ON n.series_id = r.series_id AND n.i = r.i + 1) SELECT series_id, ts, round(y, 6) AS y, round(fitted, 6) AS fitted FROM r")
def ses_path(spark, d):
    return rounded(R.run_affine(hourly_full(spark, d), R.smoothing(0.5), 2, ["fitted"], SEGMENT).drop("t"))


@query(
    f"WITH RECURSIVE {FULL}, n AS (SELECT series_id, ts, y, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM p), r AS (SELECT series_id, i, ts, y, NULL::DOUBLE AS fitted, y AS l, 0.0::DOUBLE AS b FROM n WHERE i = 1 UNION ALL SELECT r.series_id, n.i, n.ts, n.y, l + b, 0.5 * n.y + 0.5 * (l + b), 0.5 * (0.5 * n.y + 0.5 * (l + b) - l) + 0.5 * b FROM r JOIN n ON n.series_id = r.series_id AND n.i = r.i + 1) "
    "SELECT series_id, ts, round(y, 6) AS y, round(fitted, 6) AS fitted FROM r"
)
def holt_path(spark, d):
    return rounded(R.run_affine(hourly_full(spark, d), R.smoothing(0.5, 0.5), 2, ["fitted"], SEGMENT).drop("t"))


_PANEL = "c AS (SELECT o_custkey AS e, o_totalprice AS y, (epoch(o_orderdate) / 86400.0 - 9000) / 365 AS x FROM orders)"


@query(
    f"WITH {_PANEL}, w AS (SELECT e, y, x, avg(y) OVER g AS my, avg(x) OVER g AS mx, count(*) OVER g AS t FROM c WINDOW g AS (PARTITION BY e)), b AS (SELECT sum((x - mx) * (y - my)) / sum((x - mx) ** 2) AS b, count(*) AS n FROM w), "
    "m AS (SELECT e, any_value(my) AS my, any_value(mx) AS mx, any_value(t) AS t FROM w GROUP BY 1), g AS (SELECT count(*) AS g, avg(1.0 / t) AS inv, regr_slope(my, mx) AS s, regr_intercept(my, mx) AS o FROM m), "
    "v AS (SELECT sum((y - my - b * (x - mx)) ** 2) / (any_value(n) - any_value(g) - 1) AS vw FROM w, b, g), u AS (SELECT vw, greatest(0, (SELECT sum((my - o - s * mx) ** 2) / (any_value(g) - 2) FROM m, g) - vw * (SELECT inv FROM g)) AS ve FROM v), "
    "q AS (SELECT e, 1 - sqrt(vw / (vw + t * ve)) AS th, y, x, my, mx, vw, ve FROM w, u), z AS (SELECT 1 - th AS k, y - th * my AS y, x - th * mx AS x FROM q), "
    "n AS (SELECT sum(k * k) AS kk, sum(k * x) AS kx, sum(k * y) AS ky, sum(x * x) AS xx, sum(x * y) AS xy FROM z), r AS (SELECT (kk * xy - kx * ky) / (kk * xx - kx * kx) AS slope, kk, kx, ky FROM n) "
    "SELECT round(slope, 3) AS slope, round((ky - slope * kx) / kk, 3) AS intercept, round((SELECT avg(th) FROM (SELECT e, any_value(th) AS th FROM q GROUP BY 1)), 6) AS theta, round(vw / 1e6, 3) AS var_within, round(ve / 1e6, 3) AS var_entity FROM r, u"
)
def panel_re(spark, d):
    """Random effects of customers on their orders' prices over time; variances in millions."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_totalprice").alias("y"), ((F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400.0 - 9000) / 365).alias("x"))
    r = G.random_effects(o, "o_custkey", "x", "y")
    return r.selectExpr("round(slope, 3) AS slope", "round(intercept, 3) AS intercept", "round(theta, 6) AS theta", "round(var_within / 1e6, 3) AS var_within", "round(var_entity / 1e6, 3) AS var_entity")


@query(
    f"WITH RECURSIVE {FULL}, r AS (SELECT series_id, ts, y, [lag(y) OVER w, lag(y, 2) OVER w, lag(y, 24) OVER w, hour(ts), isodow(ts) - 1, y] AS xs FROM p WINDOW w AS (PARTITION BY series_id ORDER BY ts)), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) > 24 AS train, row_number() OVER (ORDER BY series_id, ts) AS t FROM r WHERE xs[3] IS NOT NULL), "
    "v AS (SELECT 'all' AS series_id, t, 6 AS d, unnest(range(6)) AS j, unnest(xs)::DOUBLE AS x FROM f WHERE train), " + _CROSS + ", " + _SWEEP + ", "
    "b AS (SELECT list_transform(range(5), lambda i: a[i * 6 + 6]) AS b FROM w WHERE k = 5), means AS (SELECT list(x ORDER BY j) AS m FROM (SELECT j, avg(x) AS x FROM v GROUP BY j)), "
    "g AS (SELECT series_id, y, m[6] + list_sum(list_transform(range(1, 6), lambda i: b[i] * (xs[i] - m[i]))) AS yhat FROM f, b, means WHERE NOT train) "
    "SELECT series_id, count(*) AS n, round(avg((y - yhat) ** 2), 4) AS mse, round(sqrt(avg((y - yhat) ** 2)), 4) AS rmse, round(avg(abs(y - yhat)), 4) AS mae, round(avg(abs((y - yhat) / nullif(y, 0))), 4) AS mape, "
    "round(avg(2 * abs(y - yhat) / nullif(abs(y) + abs(yhat), 0)), 4) AS smape, round(1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)), 4) AS r2 FROM g GROUP BY 1"
)
def calendar_regression(spark, d):
    from pyspark.ml.regression import LinearRegression

    return rounded(_fitted(spark, d, LinearRegression(labelCol="y", solver="normal")), 4)
