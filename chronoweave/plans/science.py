"""Queries on diagnostics, dynamics, signals, simulation and text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chronoweave.catalogue import query
from chronoweave.operators import aggregates as A
from chronoweave.operators import diagnostics as G
from chronoweave.operators import dynamics as N
from chronoweave.operators import manifold as M
from chronoweave.operators import multivariate as V
from chronoweave.operators import recurrences as R
from chronoweave.operators import sampled as P
from chronoweave.operators import signal as S
from chronoweave.operators import text as T
from chronoweave.operators import trend as K
from chronoweave.operators import windows as X
from chronoweave.plans.basics import SEGMENT
from chronoweave.plans.panels import DAILY, FULL, SHIPPED, daily, hourly_full, rounded, shipped, table
from chronoweave.session import intermediate, materialise


#: Each series' transform at frequencies 0 to n / 2 from p, as sums over its n values i.
_DFT = (
    "n AS (SELECT series_id, ts, y, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM p), "
    "k AS (SELECT series_id, n, unnest(range(n // 2 + 1)) AS k FROM (SELECT DISTINCT series_id, n FROM n)), "
    "f AS (SELECT series_id, n, k, sum(y * cos(-2 * pi() * ((k * i) % n) / n)) AS re, sum(y * sin(-2 * pi() * ((k * i) % n) / n)) AS im FROM n JOIN k USING (series_id, n) GROUP BY ALL)"
)

#: Lists a of d * d covariances, the last row the one to explain; each step of w sweeps one more regressor out of the rest.
_SWEEP = (
    "w AS (SELECT series_id, 0::BIGINT AS k, d, rows, a FROM m UNION ALL SELECT series_id, k + 1, d, rows, list_transform(range(d * d), lambda t: CASE "
    "WHEN t // d = k AND t % d = k THEN 1 / a[t + 1] WHEN t // d = k THEN a[t + 1] / a[k * d + k + 1] WHEN t % d = k THEN -a[t + 1] / a[k * d + k + 1] "
    "ELSE a[t + 1] - a[(t // d) * d + k + 1] * a[k * d + t % d + 1] / a[k * d + k + 1] END) FROM w WHERE k < d - 1)"
)
_CROSS = (
    "c AS (SELECT series_id, t, j, d, x - avg(x) OVER (PARTITION BY series_id, j) AS z FROM v), "
    "s AS (SELECT p.series_id, p.d, p.j AS i, q.j, count(*) AS rows, sum(p.z * q.z) AS s FROM c p JOIN c q ON p.series_id = q.series_id AND p.t = q.t GROUP BY ALL), "
    "m AS (SELECT series_id, d::BIGINT AS d, rows, list(s ORDER BY i, j) AS a FROM s GROUP BY ALL)"
)
#: Statistic t, its lags and rows of the Dickey-Fuller regressions on e (series_id, ts, y), the number of lags by AIC on common rows.
_ADF = (
    "l AS (SELECT series_id, y, row_number() OVER g - 1 AS t, lead(y) OVER g - y AS dy, count(*) OVER (PARTITION BY series_id) AS n FROM e WINDOW g AS (PARTITION BY series_id ORDER BY ts)), "
    "top AS (SELECT *, least(floor(12 * (n / 100) ** 0.25)::BIGINT, greatest(0, n // 2 - 3)) AS top FROM l), "
    "u AS (SELECT *, unnest(range(top + 2)) AS j FROM top WHERE t >= top AND dy IS NOT NULL), "
    "v AS (SELECT u.series_id, u.t, j, top + 2 AS d, CASE WHEN j = 0 THEN u.y WHEN j <= top THEN b.dy ELSE u.dy END AS x FROM u JOIN l b ON b.series_id = u.series_id AND b.t = u.t - CASE WHEN j <= top THEN j ELSE 0 END), "
    f"{_CROSS}, {_SWEEP}, "
    "o AS (SELECT series_id, k - 1 AS lags, rows, a[d] / sqrt(a[d * d] / (rows - k - 1) * a[1]) AS t, rows * ln(a[d * d] / rows) + 2 * (k + 1) AS aic FROM w WHERE k > 0), "
    "best AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY aic, lags) = 1)"
)

_ACF = (
    "c AS (SELECT series_id, ts, y - avg(y) OVER (PARTITION BY series_id) AS x FROM p), k AS (SELECT unnest(range(25)) AS lag), n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM c), v AS (SELECT series_id, sum(x * x) AS v FROM c GROUP BY 1), acf AS (SELECT a.series_id, lag, sum(a.x * b.x) / any_value(v) AS r FROM n a, k JOIN n b ON b.series_id = a.series_id AND b.i = a.i - lag JOIN v ON v.series_id = a.series_id GROUP BY 1, 2)"
)


def _p_sql(t: str, table: tuple) -> str:
    """unit_root_p() in SQL."""
    low, high, split, small, large = table
    polynomial = lambda cs: " + ".join(f"({c}) * ({t}) ** {i}" for i, c in enumerate(cs))
    z = f"(CASE WHEN {t} <= {split} THEN {polynomial(small)} ELSE {polynomial(large)} END)"
    x = f"(abs({z}) / sqrt(2))"
    tail = f"(0.5 * (" + " + ".join(f"({c}) / (1 + 0.3275911 * {x}) ** {i + 1}" for i, c in enumerate(G.ERF)) + f") * exp(-{x} * {x}))"
    return f"round(CASE WHEN {t} > {high} THEN 1 WHEN {t} < {low} THEN 0 WHEN {z} < 0 THEN {tail} ELSE 1 - {tail} END, 6)"


@query(f"WITH {FULL}, {_ACF} SELECT series_id, lag, round(r, 6) AS r FROM acf")
def acf_24(spark, d):
    return rounded(G.acf(hourly_full(spark, d), 24))


@query(f"WITH {FULL}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM p), k AS (SELECT unnest(range(6)) AS lag) SELECT a.series_id, lag, round(sum(a.y * b.y), 4) AS r FROM n a, k JOIN n b ON b.series_id = a.series_id AND b.i = a.i - lag GROUP BY 1, 2")
def raw_autocorrelation(spark, d):
    return rounded(G.acf(hourly_full(spark, d), 5, centred=False), 4)


@query(f"WITH {FULL}, e AS (SELECT series_id, ts, y - avg(y) OVER (PARTITION BY series_id) AS e FROM p), s AS (SELECT *, e - lag(e) OVER (PARTITION BY series_id ORDER BY ts) AS s FROM e) SELECT series_id, round(sum(s * s) / sum(e * e), 6) AS dw FROM s GROUP BY 1")
def durbin_watson(spark, d):
    p = hourly_full(spark, d)
    mean = p.groupBy("series_id").agg(F.avg("y").alias("m"))
    return rounded(G.durbin_watson(p.join(mean, "series_id").withColumn("e", F.col("y") - F.col("m"))))


@query(f"WITH {FULL}, e AS (SELECT series_id, ts, y - avg(y) OVER (PARTITION BY series_id) AS e FROM p) SELECT series_id, ts, round(sum(e) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) / (stddev_samp(e) OVER (PARTITION BY series_id) * sqrt(count(e) OVER (PARTITION BY series_id))), 6) + 0.0 AS cusum FROM e")
def cusum_path(spark, d):
    p = hourly_full(spark, d)
    mean = p.groupBy("series_id").agg(F.avg("y").alias("m"))
    out = G.cusum(p.join(mean, "series_id").withColumn("e", F.col("y") - F.col("m")))
    return rounded(out.select("series_id", "ts", "cusum"))


@query(f"WITH {FULL}, s AS (SELECT series_id, row_number() OVER w AS k, sum(y) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS a, count(*) OVER z AS n, sum(y) OVER z AS t, var_pop(y) OVER z AS v FROM p WINDOW w AS (PARTITION BY series_id ORDER BY ts), z AS (PARTITION BY series_id)), g AS (SELECT *, a * a / k + (t - a) ** 2 / (n - k) - t * t / n AS gain FROM s WHERE k < n) SELECT series_id, k, round(gain, 3) AS gain, gain > 3 * ln(n) * v AS change FROM g QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(gain, 6) DESC, k) = 1")
def amoc_changepoint(spark, d):
    return rounded(G.amoc(hourly_full(spark, d)), 3)


@query(f"WITH {FULL}, n AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i FROM p), k AS (SELECT unnest(range(33)) AS k), f AS (SELECT series_id, i // 64 AS block, k, sum(y * cos(-2 * pi() * k * (i % 64) / 64)) AS re, sum(y * sin(-2 * pi() * k * (i % 64) / 64)) AS im FROM n, k GROUP BY ALL) SELECT series_id, block, k, round(sqrt(re * re + im * im), 4) AS magnitude FROM f")
def dft_spectrum(spark, d):
    """The transform of every 64 hours of each series in built-ins; full_spectrum takes whole series at once."""
    return rounded(S.dft(hourly_full(spark, d), 64).select("series_id", "block", "k", "magnitude"), 4)


@query(f"WITH {FULL}, {_DFT}, r AS (SELECT series_id, k, k / n AS frequency, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im, sqrt(re * re + im * im) AS magnitude FROM f) SELECT series_id, k, round(frequency, 6) AS frequency, re, im, round(magnitude, 5) AS magnitude, round(atan2(im, re), 4) + 0.0 AS phase FROM r")
def full_spectrum(spark, d):
    """The spectrum of every whole series; frequencies in cycles an hour, the phase that of the rounded parts."""
    f = lambda y: S.spectrum(y).rename_axis("k").reset_index()
    out = N.per_series(hourly_full(spark, d), f, "k long, frequency double, re double, im double, magnitude double, phase double")
    out = out.select("series_id", "k", F.round("frequency", 6).alias("frequency"), *((F.round(c, 5) + 0.0).alias(c) for c in ("re", "im", "magnitude")))
    return out.withColumn("phase", F.round(F.atan2("im", "re"), 4) + 0.0)


@query(f"WITH {DAILY}, {SHIPPED}, j AS (SELECT d.y AS a, l.y AS b FROM d JOIN l USING (ts)), k AS (SELECT unnest(range(50)) / 49.0::DOUBLE AS a_) SELECT round(a_, 6) AS a, round(avg((a * (1 - a_) + b * a_ - b) ** 2) / 1e6, 4) AS mse FROM j, k GROUP BY a_")
def domain_blend(spark, d):
    j = daily(spark, d).select("ts", F.col("y").alias("s")).join(shipped(spark, d).select("ts", F.col("y").alias("t")), "ts")
    return S.blend(j, "s", "t").select(F.round("a", 6).alias("a"), F.round(F.col("mse") / 1e6, 4).alias("mse"))


@query(
    f"WITH {DAILY}, n AS (SELECT ts, y - lag(y) OVER (ORDER BY ts) AS step, row_number() OVER (ORDER BY ts) AS i FROM d), c AS (SELECT unnest(range(50)) AS t) "
    "SELECT n.ts, round(sum(m.step * exp(-0.1 * t) * sin(2 * pi() * t / 10)), 4) + 0.0 AS response FROM n, c JOIN n m ON m.i = n.i - t WHERE n.i > 50 GROUP BY n.ts"
)
def impulse_curve(spark, d):
    """What each day's change of the mean order price leaves behind: changes convolved with a damped wave over 50 days."""
    steps = X.changes(daily(spark, d)).select("series_id", "ts", "diff")
    return X.convolved(steps, S.damped_wave(50), "response", "diff").select("ts", (F.round("response", 4) + 0.0).alias("response"))


@query(f"WITH {FULL}, c AS (SELECT series_id, ts, y, stddev_samp(y) OVER (PARTITION BY series_id) AS s FROM p) SELECT series_id, ts, round(y - 1.96 * s, 6) AS lo, round(y + 1.96 * s, 6) AS hi FROM c")
def confidence_ribbon(spark, d):
    p = hourly_full(spark, d)
    w = p.groupBy("series_id").agg((1.96 * F.stddev_samp("y")).alias("w"))
    return rounded(S.ribbon(p.join(w, "series_id"), "y", "w").select("series_id", "ts", "lo", "hi"))


_STATS = "(SELECT event_type AS series_id, avg(value) AS mx, avg(user_id) AS my, var_samp(value) + 1e-6 AS a, covar_samp(value, user_id) AS b, var_samp(user_id) + 1e-6 AS c FROM events GROUP BY 1)"


@query(f"WITH e AS (SELECT *, sqrt((a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b)) AS r1, sqrt(greatest((a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b), 0)) AS r2, atan2(2 * b, a - c) / 2 AS tilt FROM {_STATS}), g AS (SELECT e.*, i, 2 * pi() * i / 99 AS t FROM e, (SELECT unnest(range(100)) AS i)) SELECT series_id, i, round(mx + r1 * cos(t) * cos(tilt) - r2 * sin(t) * sin(tilt), 4) AS x, round(my + r1 * cos(t) * sin(tilt) + r2 * sin(t) * cos(tilt), 4) AS y FROM g")
def covariance_ellipse(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("series_id"), F.col("value").alias("a1"), F.col("user_id").cast("double").alias("b1"))
    return rounded(S.ellipse(e, "a1", "b1"), 4)


@query(f"WITH {DAILY}, n AS (SELECT ts, y, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n, lag(y) OVER (ORDER BY ts) AS before FROM d) SELECT ts, CASE WHEN i < n / 2 THEN 'pre' ELSE 'post' END AS period, round(y, 6) AS y, round(before, 6) AS before FROM n")
def pre_post_lag(spark, d):
    p = X.numbered(X.lags(daily(spark, d), 1))
    n = p.count()
    return rounded(p.select("ts", F.when(F.col("i") < n / 2, "pre").otherwise("post").alias("period"), "y", F.col("lag_1").alias("before")))


_WORDS = ("the", "and", "der", "que", "les")


@query("WITH c AS (SELECT lang, lower(regexp_replace(text, '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS c FROM documents) SELECT lang, " + ", ".join(f"sum((length(c) - length(replace(c, '{w}', ''))) // {len(w)})::BIGINT AS {w}" for w in _WORDS) + " FROM c GROUP BY 1")
def keyword_trend(spark, d):
    return T.keyword_trend(table(spark, d, "documents"), ["lang"], _WORDS)


@query("WITH t AS (SELECT unnest(string_split(lower(regexp_replace(text, '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' ')) AS term FROM documents) SELECT term, count(*) AS n FROM t WHERE length(term) > 1 GROUP BY 1 ORDER BY n DESC, term LIMIT 1000")
def term_counts_top(spark, d):
    return T.term_counts(table(spark, d, "documents")).orderBy(F.col("n").desc(), "term").limit(1000)


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def page_links(spark, d):
    return T.links(table(spark, d, "pages"))


@query("SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS place, value FROM (SELECT page_id, unnest(regexp_extract_all(n, '<li><a href=\"([^\"]*)\"', 1)) AS value, unnest(range(len(regexp_extract_all(n, '<li><a href=\"([^\"]*)\"', 1)))) AS k FROM (SELECT page_id, regexp_extract(html, '<nav>.*?</nav>', 0, 's') AS n FROM pages))")
def selected_links(spark, d):
    """Links of the pages' navigation, by a selector."""
    return T.selected(table(spark, d, "pages"), "nav li > a[href]")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query()
def page_records(spark, d):
    r = T.records(table(spark, d, "pages"))
    return r.select("page_id", "title", F.length("text").alias("n_chars"), F.size("fields").alias("n_fields"))


@query()
def lda_topics(spark, d):
    return T.topics(table(spark, d, "documents"), k=4)[0]


@query(
    f"WITH RECURSIVE {FULL}, {_ACF}, "
    "r AS (SELECT series_id, list(r ORDER BY lag) AS r FROM acf GROUP BY 1), "
    "f AS (SELECT series_id, r, 0::BIGINT AS k, []::DOUBLE[] AS phi, 1.0::DOUBLE AS v, 1.0::DOUBLE AS p FROM r UNION ALL "
    "SELECT series_id, r, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - g * phi[k + 1 - j]), g), v * (1 - g * g), g FROM ("
    "SELECT *, (r[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])), 0)) / v AS g FROM f WHERE k < 24)) "
    "SELECT series_id, k AS lag, round(p, 6) AS r FROM f"
)
def pacf_24(spark, d):
    return rounded(G.pacf(hourly_full(spark, d), 24))


@query(
    f"WITH RECURSIVE {FULL}, e AS (SELECT * FROM p), {_ADF} SELECT series_id, round(t, 6) AS statistic, lags, {_p_sql('t', G.ADF_P)} AS p, round(-3.43035 - 6.5393 / rows - 16.786 / rows ** 2, 6) AS crit_1, "
    "round(-2.86154 - 2.8903 / rows - 4.234 / rows ** 2, 6) AS crit_5, round(-2.56677 - 1.5384 / rows - 2.809 / rows ** 2, 6) AS crit_10, t < -2.86154 - 2.8903 / rows - 4.234 / rows ** 2 AS stationary FROM best"
)
def adf_test(spark, d):
    return rounded(G.adf(hourly_full(spark, d)))


def _pairs(spark, d):
    a, b = daily(spark, d).select("ts", "y"), shipped(spark, d).select("ts", F.col("y").alias("x"))
    return a.join(b, "ts").select(F.lit("orders~lines").alias("series_id"), "ts", "y", "x")


_PAIRS = f"{DAILY}, {SHIPPED}, q AS (SELECT 'orders~lines' AS series_id, ts, d.y, l.y AS x FROM d JOIN l USING (ts))"


@query(
    f"WITH RECURSIVE {_PAIRS}, g AS (SELECT series_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM q GROUP BY 1), e AS (SELECT series_id, ts, y - a - b * x AS y FROM q JOIN g USING (series_id)), "
    f"{_ADF.replace('l AS (SELECT', 'lv AS (SELECT').replace('FROM l)', 'FROM lv)').replace('JOIN l b', 'JOIN lv b')} "
    f"SELECT series_id, round(t, 6) AS statistic, lags, {_p_sql('t', G.EG_P)} AS p, round(-3.33613 - 6.1101 / rows - 6.823 / rows ** 2, 6) AS crit_5, t < -3.33613 - 6.1101 / rows - 6.823 / rows ** 2 AS cointegrated FROM best"
)
def cointegration_test(spark, d):
    return rounded(G.cointegration(_pairs(spark, d)))


@query(
    f"WITH RECURSIVE {_PAIRS}, lagged AS (SELECT series_id, row_number() OVER g AS t, [lag(y) OVER g, lag(y, 2) OVER g, lag(x) OVER g, lag(x, 2) OVER g, y] AS xs FROM q WINDOW g AS (PARTITION BY series_id ORDER BY ts)), "
    f"v AS (SELECT series_id, t, 5 AS d, unnest(range(5)) AS j, unnest(xs) AS x FROM lagged WHERE t > 2), {_CROSS}, {_SWEEP}, "
    "o AS (SELECT series_id, max(rows) - 5 AS df, max(a[25]) FILTER (k = 2) AS short, max(a[25]) FILTER (k = 4) AS long FROM w GROUP BY 1), "
    "b AS (SELECT series_id, df, (short - long) / 2 / (long / df) AS f FROM o) "
    "SELECT series_id, round(f, 6) AS f, round((1 + 2 * f / df) ** (-df / 2), 6) AS p, (1 + 2 * f / df) ** (-df / 2) < 0.05 AS causes FROM b"
)
def granger_test(spark, d):
    return rounded(G.granger(_pairs(spark, d)))


#: Values at the times at which every series has one.
_COMMON = "u AS (SELECT series_id, ts, y FROM p WHERE y IS NOT NULL QUALIFY count(*) OVER (PARTITION BY ts) = (SELECT count(DISTINCT series_id) FROM p))"


@query(
    f"WITH {FULL}, {_COMMON}, v AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM u), "
    "z AS (SELECT series_id, i, y AS t0, lead(y, 10) OVER g AS t1, lead(y, 20) OVER g AS t2 FROM v WINDOW g AS (PARTITION BY series_id ORDER BY i)), z_ AS (SELECT * FROM z WHERE t2 IS NOT NULL), "
    "near AS (SELECT a.series_id AS target, a.i, b.i AS j, 1 / (sqrt((a.t0 - b.t0) ** 2 + (a.t1 - b.t1) ** 2 + (a.t2 - b.t2) ** 2) + 1e-9) AS w FROM z_ a JOIN z_ b ON a.series_id = b.series_id AND a.i <> b.i QUALIFY row_number() OVER (PARTITION BY a.series_id, a.i ORDER BY w DESC, b.i) <= 4), "
    "g AS (SELECT v.series_id AS source, target, near.i, sum(w * v.y) / sum(w) AS guess FROM near JOIN v ON v.i = near.j AND v.series_id <> target GROUP BY ALL) "
    "SELECT source, target, round(corr(v.y, guess), 6) AS r FROM g JOIN v ON v.series_id = source AND v.i = g.i GROUP BY ALL"
)
def ccm_hourly(spark, d):
    """Cross mapping of every ordered pair of event types, over the hours that all of them have."""
    p = hourly_full(spark, d).where("y is not null")
    types = p.select("series_id").distinct().count()
    whole = p.groupBy("ts").agg(F.count("*").alias("n")).where(F.col("n") == types).select("ts")
    return rounded(M.cross_maps(p.join(whole, "ts"), block=128))


@query(f"WITH {FULL}, l AS (SELECT series_id, list(y ORDER BY ts) AS x FROM p GROUP BY 1), k AS (SELECT unnest(range(1, 6)) AS k), i AS (SELECT series_id, x, k, len(x) - k AS n, unnest(range(1, len(x) - k + 1)) AS i FROM l, k), ij AS (SELECT *, unnest(range(1, n + 1)) AS j FROM i), r AS (SELECT series_id, k, n, list_distance(x[i + 1:i + k], x[j + 1:j + k]) / (list_distance(x[i:i + k - 1], x[j:j + k - 1]) + 1e-10) > 10 AS hit FROM ij) SELECT series_id, k AS dims, round(count_if(hit) / any_value(n), 6) AS ratio FROM r GROUP BY 1, 2")
def fnn_ratio(spark, d):
    return rounded(M.false_neighbour_ratios(hourly_full(spark, d), 5, block=256))


_KALMAN = (
    "n AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS t FROM p), "
    "f AS (SELECT series_id, (-1)::BIGINT AS t, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS p, 0.0::DOUBLE AS q, 1.0::DOUBLE AS s FROM n WHERE t = 0 UNION ALL "
    "SELECT series_id, t, a + p / (p + 1) * (z - a), b + q / (p + 1) * (z - a), p - p / (p + 1) * p, q - p / (p + 1) * q, s - q / (p + 1) * q FROM ("
    "SELECT f.series_id, n.t, n.y AS z, a + 0.1 * b AS a, b, p + 0.2 * q + 0.01 * s + 0.1 AS p, q + 0.1 * s AS q, s + 0.1 AS s FROM f JOIN n ON n.series_id = f.series_id AND n.t = f.t + 1))"
)


@query(f"WITH RECURSIVE {FULL}, {_KALMAN} SELECT series_id, t, round(a, 6) AS position, round(b, 6) AS velocity FROM f WHERE t >= 0")
def kalman_track(spark, d):
    return rounded(R.run_affine(hourly_full(spark, d), R.kalman(), 2, ["position", "velocity"], SEGMENT).select("series_id", "t", "position", "velocity"))


@query(f"WITH {FULL}, c AS (SELECT series_id, ts, y AS x, lead(y) OVER (PARTITION BY series_id ORDER BY ts) - y AS dy FROM p), r AS (SELECT series_id, count(dy) AS n, regr_slope(dy, x) AS b, regr_sxx(dy, x) AS xx, regr_syy(dy, x) AS yy FROM c WHERE dy IS NOT NULL GROUP BY 1), t AS (SELECT series_id, n, b / sqrt((yy - b * b * xx) / (n - 2) / xx) AS t FROM r) SELECT series_id, round(t, 6) AS statistic, 0 AS lags, {_p_sql('t', G.ADF_P)} AS p, round(-3.43035 - 6.5393 / n - 16.786 / n ** 2, 6) AS crit_1, round(-2.86154 - 2.8903 / n - 4.234 / n ** 2, 6) AS crit_5, round(-2.56677 - 1.5384 / n - 2.809 / n ** 2, 6) AS crit_10, t < -2.86154 - 2.8903 / n - 4.234 / n ** 2 AS stationary FROM t")
def dickey_fuller(spark, d):
    """The test without lags of differences; adf_test chooses their number."""
    return rounded(G.adf(hourly_full(spark, d), 0))


@query(f"WITH {FULL}, e AS (SELECT series_id, ts, y - avg(y) OVER (PARTITION BY series_id) AS e FROM p), c AS (SELECT series_id, abs(sum(e) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) / (stddev_samp(e) OVER (PARTITION BY series_id) * sqrt(count(e) OVER (PARTITION BY series_id)))) AS c FROM e), m AS (SELECT series_id, max(c) AS sup FROM c GROUP BY 1) SELECT series_id, round(any_value(sup), 6) AS sup, round(least(1, greatest(0, sum(2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * sup * sup)))), 6) AS p FROM m, (SELECT unnest(range(1, 101)) AS k) GROUP BY series_id")
def cusum_test(spark, d):
    """The largest cumulated residual and its p by the distribution of a Brownian bridge's largest value."""
    p = hourly_full(spark, d)
    mean = p.groupBy("series_id").agg(F.avg("y").alias("m"))
    return rounded(G.cusum_test(p.join(mean, "series_id").withColumn("e", F.col("y") - F.col("m"))))


@query(
    f"WITH RECURSIVE {FULL}, h AS (SELECT series_id, hour(ts) AS h, avg(y) AS y FROM p GROUP BY ALL), r AS (SELECT series_id, list(y ORDER BY h) AS v FROM h GROUP BY 1), "
    "f AS (SELECT a.series_id, b.series_id AS other, a.v, b.v AS w, []::DOUBLE[] AS l, 0::BIGINT AS c, len(b.v) AS m FROM r a JOIN r b ON a.series_id < b.series_id UNION ALL "
    "SELECT series_id, other, v, w, list_append(l, (v[c // m + 1] - w[c % m + 1]) ** 2 + CASE WHEN c = 0 THEN 0 ELSE "
    "least(CASE WHEN c >= m THEN l[c - m + 1] END, CASE WHEN c % m > 0 THEN l[c] END, CASE WHEN c >= m AND c % m > 0 THEN l[c - m] END) END), c + 1, m FROM f WHERE c < len(v) * m) "
    "SELECT series_id, other, round(l[c], 6) AS dtw FROM f WHERE c = len(v) * m"
)
def dtw_pairs(spark, d):
    """Distances of every two daily profiles of event types: a few series of 24 values."""
    prof = hourly_full(spark, d).groupBy("series_id", F.hour("ts").alias("h")).agg(F.avg("y").alias("y")).groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "y"))), lambda s: s["y"]).alias("v"))

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([N.dtw(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(a, b)])

    other = prof.select(F.col("series_id").alias("other"), F.col("v").alias("w"))
    return prof.join(other, F.col("series_id") < F.col("other")).select("series_id", "other", F.round(distance("v", "w"), 6).alias("dtw"))


@query()
def var_forecast(spark, d):
    """A day ahead for every pair of event types, by vector autoregressions with and without a moving average."""
    with intermediate(spark) as keep:
        both = materialise(V.pairs(hourly_full(spark, d)), "pairs")
        mixed = V.varma_forecast(both, ["a", "b"], 24).select("series_id", "h", F.col("a").alias("a_varma"), F.col("b").alias("b_varma"))
        return keep(V.var_forecast(both, ["a", "b"], 24).join(mixed, ["series_id", "h"]))


@query()
def impulse_response(spark, d):
    return V.impulse_responses(V.pairs(hourly_full(spark, d)), ["a", "b"], 2, 20, np.array([[1.0, 0.0], [-0.5, 1.0]]))


@query()
def garch_vol(spark, d):
    """Ten hours ahead for every event type."""

    def f(y):
        r = np.diff(np.log(y[y > 0]))
        w = N.garch(r)
        return pd.DataFrame({"h": np.arange(1, 11), "omega": w[0], "alpha": w[1], "beta": w[2], "variance": N.variance_path(r, w, 10)})

    return N.per_series(hourly_full(spark, d), f, "h long, omega double, alpha double, beta double, variance double")


@query()
def gibbs_changepoint(spark, d):
    """A change of each market segment's monthly number of orders."""
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts")
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = orders.groupBy(F.col("c_mktsegment").alias("series_id"), month).agg(F.count("*").cast("double").alias("y"))
    return N.per_series(n, N.gibbs_change, "change_at double, rate_before double, rate_after double")


@query()
def bayes_ar(spark, d):
    return N.per_series(hourly_full(spark, d), N.bayes_ar, "parameter string, mean double, lo double, hi double")


@query()
def bayes_rw(spark, d):
    return N.per_series(hourly_full(spark, d), N.random_walk_posterior, "t long, mean double, lo double, hi double")


@query()
def monte_carlo(spark, d):
    paths = N.monte_carlo(spark, daily(spark, d), "2001-12-31", 200)
    last = paths.agg(F.max("step")).first()[0]
    end = paths.where(F.col("step") == last)
    return end.agg(F.avg("price").alias("mean"), F.stddev_pop("price").alias("sd"), F.percentile("price", F.lit(0.05)).alias("p5"), F.percentile("price", F.lit(0.95)).alias("p95"), F.count("*").alias("paths"))


@query()
def bootstrap_ci(spark, d):
    return N.per_series(hourly_full(spark, d), lambda y: N.bootstrap_band(y, 24), "h long, mean double, lo double, hi double")


@query()
def robust_decomposition(spark, d):
    return N.per_series(hourly_full(spark, d), lambda y: N.robust_decompose(y, 24), "t long, trend double, seasonal double, resid double")


@query(
    f"WITH {FULL}, {_DFT}, g AS (SELECT *, CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END / n::DOUBLE AS c, k * (1::DOUBLE / n) <= 0.1 AS low, row_number() OVER (PARTITION BY series_id ORDER BY re * re + im * im DESC, k) <= 5 AS top FROM f) "
    "SELECT series_id, i AS t, round(coalesce(sum(x) FILTER (low), 0), 4) + 0.0 AS low, round(coalesce(sum(x) FILTER (top), 0), 4) + 0.0 AS top FROM ("
    "SELECT series_id, i, low, top, c * (re * cos(2 * pi() * ((k * i) % n) / n) - im * sin(2 * pi() * ((k * i) % n) / n)) AS x FROM n JOIN g USING (series_id, n) WHERE low OR top) GROUP BY ALL"
)
def fft_filter(spark, d):
    f = lambda y: pd.DataFrame({"t": np.arange(len(y)), "low": S.low_pass(y), "top": S.strongest(y, 5)})
    return rounded(N.per_series(hourly_full(spark, d), f, "t long, low double, top double"), 4)


@query(
    f"WITH {FULL}, n AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM p), "
    "s AS (SELECT series_id, least(256, n) AS size, unnest(range((n - least(256, n)) // 64 + 1)) AS frame FROM (SELECT DISTINCT series_id, n FROM n)), "
    "x AS (SELECT s.series_id, size, frame, i - 64 * frame AS j, y * CASE WHEN size = 1 THEN 1 ELSE 0.5 - 0.5 * cos(2 * pi() * (i - 64 * frame) / (size - 1)) END AS y FROM s JOIN n ON n.series_id = s.series_id AND i >= 64 * frame AND i < 64 * frame + size), "
    "b AS (SELECT DISTINCT size, unnest(range(size // 2 + 1)) AS bin FROM s), "
    "f AS (SELECT series_id, frame, bin, sqrt(sum(y * cos(2 * pi() * ((bin * j) % size) / size)) ** 2 + sum(y * sin(2 * pi() * ((bin * j) % size) / size)) ** 2) AS mag FROM x JOIN b USING (size) GROUP BY ALL) "
    "SELECT series_id, frame, bin, round(greatest(20 * log10(greatest(mag, 1e-10) / greatest(max(mag) OVER (PARTITION BY series_id), 1e-10)), -80), 4) + 0.0 AS db FROM f"
)
def stft_frames(spark, d):
    return rounded(S.stft_db(hourly_full(spark, d)), 4)


@query()
def latent_factors(spark, d):
    return S.latent_factors(hourly_full(spark, d), 3)


@query()
def imputation(spark, d):
    """Every seventh value is taken away; the mean fill with draws and a cubic spline put values back."""

    def f(y):
        hole = np.where(np.arange(len(y)) % 7 == 3, np.nan, y)
        return pd.DataFrame({"t": np.arange(len(y)), "y": y, "drawn": N.impute(hole), "cubic": N.cubic_fill(hole)})

    return N.per_series(hourly_full(spark, d), f, "t long, y double, drawn double, cubic double")


@query(
    f"WITH {DAILY}, e AS (SELECT min(y) AS lo, max(y) AS hi, stddev_samp(y) AS s, count(y) AS n FROM d) "
    "SELECT 'synthetic' AS series_id, TIMESTAMP '2020-01-01' + to_days(i::INT) AS ts, round(lo + (hi - lo) * i / (n - 1) + s * sin(2 * pi() * i / 30), 4) AS y FROM (SELECT *, unnest(range(n)) AS i FROM e)"
)
def synthetic_series(spark, d):
    """A trend and a wave as long, as high and as wide as the daily mean order prices."""
    e = daily(spark, d).agg(F.min("y").alias("low"), F.max("y").alias("high"), F.stddev_samp("y").alias("amplitude"), F.count("y").alias("n")).first()
    return rounded(N.synthetic(spark, e["n"], e["low"], e["high"], e["amplitude"]), 4)


@query(
    f"WITH {FULL}, {_ACF}, z AS (SELECT series_id, (y - avg(y) OVER s) / stddev_samp(y) OVER s AS z FROM p WINDOW s AS (PARTITION BY series_id)), e AS (SELECT series_id, min(z) AS lo, max(z) AS hi, count(*) AS n FROM z GROUP BY 1), "
    "b AS (SELECT series_id, least(floor(round((z - lo) / ((hi - lo) / 20), 6)), 19) AS k, any_value(n * (hi - lo) / 20) AS w, count(*) AS c FROM z JOIN e USING (series_id) GROUP BY 1, 2), "
    "q AS (SELECT series_id, unnest(range(1, 20)) AS k, unnest(quantile_cont(z, [" + ", ".join(str(k / 20) for k in range(1, 20)) + "])) AS v FROM z GROUP BY 1) "
    "SELECT series_id, 'density' AS kind, k::BIGINT AS k, round(c / w, 6) AS value FROM b UNION ALL SELECT series_id, 'acf', lag, round(r, 6) + 0.0 FROM acf WHERE lag <= 10 UNION ALL SELECT series_id, 'quantile', k, round(v, 6) + 0.0 FROM q"
)
def residual_panel(spark, d):
    """Residuals of hourly values from their series' mean."""
    p = hourly_full(spark, d)
    mean = p.groupBy("series_id").agg(F.avg("y").alias("m"))
    return rounded(G.residual_panel(p.join(mean, "series_id").withColumn("e", F.col("y") - F.col("m"))))


_SAMPLED = (
    "l AS (SELECT series_id, ts, y, lag(y) OVER w AS x1, lag(y, 2) OVER w AS x2 FROM p WINDOW w AS (PARTITION BY series_id ORDER BY ts)), "
    "c AS (SELECT series_id, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, covar_pop(y, y) AS syy FROM l WHERE x2 IS NOT NULL GROUP BY 1), "
    "b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM c), "
    "fit AS (SELECT series_id, my - b1 * m1 - b2 * m2 AS b0, b1, b2, sqrt(n * (syy - b1 * s1y - b2 * s2y) / (n - 3)) AS sigma FROM b), "
    "last AS (SELECT series_id, max_by(y, ts) AS y, max_by(x1, ts) AS x FROM l GROUP BY 1), "
    "walk AS (SELECT series_id, draw, 0::BIGINT AS step, y, x FROM last, (SELECT unnest(range(200)) AS draw) UNION ALL "
    "SELECT series_id, draw, step + 1, b0 + b1 * y + b2 * x + sigma * sqrt(-2 * ln((('0x' || substr(m, 1, 8))::BIGINT + 0.5) / 4294967296)) * cos(2 * pi() * (('0x' || substr(m, 9, 8))::BIGINT + 0.5) / 4294967296), y "
    "FROM (SELECT walk.*, fit.* EXCLUDE (series_id), md5(concat_ws(':', series_id, draw, step + 1, '0')) AS m FROM walk JOIN fit USING (series_id) WHERE step < 24))"
)


def _paths(spark, d):
    return P.sampled_paths(P.autoregression(hourly_full(spark, d), 2), 24, draws=200)


@query(f"WITH RECURSIVE {FULL}, {_SAMPLED} SELECT series_id, step, round(avg(y), 5) AS mean, round(quantile_cont(y, 0.05), 5) AS p5, round(quantile_cont(y, 0.5), 5) AS p50, round(quantile_cont(y, 0.95), 5) AS p95 FROM walk WHERE step > 0 GROUP BY 1, 2")
def sampled_forecast(spark, d):
    """Bands of 200 sampled paths of each hourly series' autoregression, a day ahead."""
    with intermediate(spark) as keep:
        return keep(rounded(P.bands(materialise(_paths(spark, d), "paths"), {"p5": 0.05, "p50": 0.5, "p95": 0.95}), 5))


@query(
    f"WITH RECURSIVE {FULL}, {_SAMPLED}, e AS (SELECT series_id, y FROM walk WHERE step = 24), m AS (SELECT series_id, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS sd FROM e GROUP BY 1) "
    "SELECT series_id, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(mean - 0.67 * sd, 4) AS lower, round(mean + 0.67 * sd, 4) AS upper, round((SELECT avg((y BETWEEN mean - 0.67 * sd AND mean + 0.67 * sd)::INT) FROM e WHERE e.series_id = m.series_id), 4) AS inside FROM m"
)
def terminal_distribution(spark, d):
    """Bands of the sampled paths' ends."""
    return rounded(P.terminal_bands(_paths(spark, d).where("step = 24")), 4)


@query(
    f"WITH RECURSIVE {FULL}, {_SAMPLED}, e AS (SELECT series_id, y FROM walk WHERE step = 24), r AS (SELECT series_id, min(y) AS lo, max(y) AS hi, count(*) AS n FROM e GROUP BY 1) "
    "SELECT series_id, least(floor(round((y - lo) / ((hi - lo) / 20), 6)), 19)::BIGINT AS bin, count(*) AS c, round(count(*) / (any_value(n) * any_value((hi - lo) / 20)), 6) AS density FROM e JOIN r USING (series_id) GROUP BY 1, 2"
)
def terminal_histogram(spark, d):
    return rounded(A.histogram(_paths(spark, d).where("step = 24"), 20, snap=6))


_KERNEL = (
    "placed AS (SELECT series_id, ts, y, (row_number() OVER w - 1) / (count(*) OVER (PARTITION BY series_id) - 1) AS a FROM p WINDOW w AS (PARTITION BY series_id ORDER BY ts)), "
    "rw AS (SELECT *, list_transform(range(6), lambda j: exp(-(((a - j / 5) / 0.15) ** 2) / 2)) AS r FROM placed), kw AS (SELECT *, list_transform(r, lambda v: v / list_sum(r)) AS k FROM rw), "
    "v AS (SELECT series_id, ts AS t, unnest(range(7)) AS j, unnest(list_append(k, y)) AS x FROM kw), "
    "s AS (SELECT p.series_id, p.j AS i, q.j, count(*) AS rows, sum(p.x * q.x) AS s FROM v p JOIN v q ON p.series_id = q.series_id AND p.t = q.t GROUP BY ALL), m AS (SELECT series_id, 7::BIGINT AS d, rows, list(s ORDER BY i, j) AS a FROM s GROUP BY ALL), "
)


@query(
    f"WITH RECURSIVE {FULL}, {_KERNEL}{_SWEEP}, b AS (SELECT series_id, list_transform(range(6), lambda i: a[i * 7 + 7]) AS b FROM w WHERE k = 6) "
    "SELECT series_id, ts, round(list_dot_product(kw.k, b), 4) AS trend FROM kw JOIN b USING (series_id)"
)
def kernel_trend(spark, d):
    """A trend of six knots through each hourly series."""
    return rounded(K.kernel_trend(hourly_full(spark, d))[0].select("series_id", "ts", "trend"), 4)


@query()
def kernel_forecast(spark, d):
    return K.kernel_forecast(K.kernel_trend(hourly_full(spark, d))[1], 24)


@query(f"WITH {DAILY}, m AS (SELECT count(y) AS n, avg(y) AS mean, stddev_pop(y) AS sd FROM d) SELECT n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(mean - 0.67 * sd, 4) AS lower, round(mean + 0.67 * sd, 4) AS upper, round((SELECT avg((y BETWEEN mean - 0.67 * sd AND mean + 0.67 * sd)::INT) FROM d), 4) AS inside FROM m")
def terminal_bands(spark, d):
    """The daily mean order prices as final values, so that SQL can say the result too."""
    return rounded(N.terminal(daily(spark, d), "y"), 4)


@query()
def topic_trend(spark, d):
    """Documents by dominant topic and language."""
    return T.topics(table(spark, d, "documents"), k=4)[1].groupBy("lang", "topic").agg(F.count("*").alias("n"))


@query()
def classify_days(spark, d):
    """Event types told from a day's hourly values: a forest on the summary of each day; accuracy by type, one day in five held out."""
    p = hourly_full(spark, d).withColumn("day", F.date_trunc("day", "ts"))
    features = {"mean": F.avg("y"), "sd": F.stddev_samp("y"), "low": F.min("y"), "high": F.max("y"), "first": F.min_by("y", "ts"), "last": F.max_by("y", "ts"), "skew": F.skewness("y"), "kurtosis": F.kurtosis("y")}
    days = p.groupBy("series_id", "day").agg(F.count("y").alias("n_"), *(c.alias(n) for n, c in features.items())).where("n_ = 24")
    test = F.pmod(F.datediff(F.col("day"), F.lit("2000-01-01")), F.lit(5)) == 0
    return rounded(T.classify(days, list(features), "series_id", test))
