"""Queries on typing, grids, windows, aggregates and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.catalogue import query
from chronoweave.operators import aggregates as A
from chronoweave.operators import clean, evaluate, grid, hierarchy, reshape, segments, text
from chronoweave.operators import windows as X
from chronoweave.plans.panels import DAILY, FULL, HOURLY, RAW, SHIPPED, SPINE, daily, hourly, hourly_full, raw_events, rounded, shipped, table

SET = ["series_id", "ts"]
#: Rows of a segment here, so few that the test tables' series are cut too.
SEGMENT = 300


@query(f"WITH {SPINE} SELECT series_id, ts, round(y, 6) AS y FROM gaps")
def resample_hourly_grid(spark, d):
    return rounded(grid.on_grid(hourly(spark, d), "hour"))


@query(f"WITH {DAILY} SELECT series_id, ts, round(y, 6) AS y FROM d")
def resample_daily(spark, d):
    return rounded(daily(spark, d))


@query(f"WITH {RAW} SELECT series_id, (date_trunc('week', ts)::DATE + 6)::TIMESTAMP AS ts, round(sum(y), 6) AS y FROM raw GROUP BY ALL")
def resample_weekly_sunday(spark, d):
    return rounded(grid.resample(raw_events(spark, d), "week", "sum"))


@query(f"WITH {DAILY} SELECT series_id, last_day(ts)::TIMESTAMP AS ts, round(avg(y), 6) AS y FROM d GROUP BY ALL")
def resample_month_end(spark, d):
    return rounded(grid.resample(daily(spark, d), "month_end"))


@query(
    f"WITH {RAW}, q AS (SELECT series_id, time_bucket(INTERVAL 15 MINUTES, ts) AS ts, avg(y) AS y FROM raw GROUP BY ALL), "
    "s AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 15 MINUTES)) AS ts FROM q GROUP BY series_id) "
    "SELECT series_id, ts, round(y, 6) AS y FROM s LEFT JOIN q USING (series_id, ts)"
)
def asfreq_15min(spark, d):
    return rounded(grid.on_grid(grid.resample(raw_events(spark, d), "15min"), "15min"))


@query("SELECT strftime(d, '%Y-%m-%d') AS d FROM (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE, INTERVAL 1 DAY)) AS d FROM orders) WHERE isodow(d) < 6")
def business_days(spark, d):
    """Business days from the first order's day to the last one's."""
    ends = table(spark, d, "orders").agg(*(f(F.col("o_orderdate").cast("date")).cast("string").alias(n) for f, n in ((F.min, "first"), (F.max, "last")))).first()
    return grid.date_range(spark, ends["first"], ends["last"], "B").select(F.date_format("d", "yyyy-MM-dd").alias("d"))


@query("SELECT strftime(d, '%Y-%m-%d') AS d FROM (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE + 60, INTERVAL 1 DAY)) AS d FROM events) WHERE d = last_day(d)")
def month_ends(spark, d):
    """Month ends from the first event's day to 60 days after the last one's."""
    ends = table(spark, d, "events").agg(F.min("ts").cast("date").cast("string").alias("first"), F.date_add(F.max("ts").cast("date"), 60).cast("string").alias("last")).first()
    return grid.date_range(spark, ends["first"], ends["last"], "ME").select(F.date_format("d", "yyyy-MM-dd").alias("d"))


@query(f"WITH {FULL} SELECT series_id, ts, round(y, 6) AS y FROM p")
def ffill_grid(spark, d):
    return rounded(segments.forward_fill(grid.on_grid(hourly(spark, d), "hour"), rows=SEGMENT))


_KNOWN = "CASE WHEN y IS NOT NULL THEN i END"
_LINEAR = (
    ", n AS (SELECT *, row_number() OVER w AS i FROM gaps WINDOW w AS (PARTITION BY series_id ORDER BY ts))"
    f", k AS (SELECT *, last_value(y IGNORE NULLS) OVER a AS p, last_value({_KNOWN} IGNORE NULLS) OVER a AS ip, first_value(y IGNORE NULLS) OVER b AS q, first_value({_KNOWN} IGNORE NULLS) OVER b AS iq FROM n "
    "WINDOW a AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
)


@query(f"WITH {SPINE}{_LINEAR} SELECT series_id, ts, round(CASE WHEN y IS NOT NULL THEN y WHEN q IS NULL THEN p ELSE p + (q - p) * (i - ip) / (iq - ip) END, 6) AS y FROM k")
def linear_interp_grid(spark, d):
    return rounded(grid.linear_fill(grid.on_grid(hourly(spark, d), "hour")))


@query(f"WITH {SPINE} SELECT series_id, ts, round(coalesce(y, avg(y) OVER (PARTITION BY series_id)), 6) AS y FROM gaps")
def mean_fill(spark, d):
    return rounded(grid.mean_fill(grid.on_grid(hourly(spark, d), "hour")))


@query(
    f"WITH {DAILY}, w AS (SELECT series_id, (date_trunc('week', ts)::DATE + 6)::TIMESTAMP AS ts, avg(y) AS y FROM d GROUP BY ALL), "
    "s AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM w GROUP BY series_id), gaps AS (SELECT s.series_id, s.ts, w.y FROM s LEFT JOIN w USING (series_id, ts))"
    f"{_LINEAR} SELECT series_id, ts, round(CASE WHEN y IS NOT NULL THEN y WHEN q IS NULL THEN p ELSE p + (q - p) * (i - ip) / (iq - ip) END, 6) AS y FROM k"
)
def upsample_week_to_day(spark, d):
    return rounded(grid.linear_fill(grid.on_grid(grid.resample(daily(spark, d), "week"), "day")))


@query(f"WITH {DAILY} SELECT ts, hour(ts) AS hour, day(ts) AS day, isodow(ts) - 1 AS dayofweek, dayofyear(ts) AS dayofyear, quarter(ts) AS quarter, month(ts) AS month, year(ts) AS year FROM d")
def calendar_features(spark, d):
    return grid.calendar(daily(spark, d).select("ts"))


_W = "WINDOW w AS (PARTITION BY series_id ORDER BY ts)"


@query(f"WITH {FULL} SELECT series_id, ts, round(y, 6) AS y, round(lag(y, 1) OVER w, 6) AS lag_1, round(lag(y, 7) OVER w, 6) AS lag_7, round(lag(y, 24) OVER w, 6) AS lag_24 FROM p {_W}")
def lag_features(spark, d):
    return rounded(X.lags(hourly_full(spark, d), 1, 7, 24))


def _frame(k: int) -> str:
    return f"OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


_ROLL = ", ".join(f"CASE WHEN count(y) {_frame(k)} = {k} THEN round(avg(y) {_frame(k)}, 6) END AS mean_{k}, CASE WHEN count(y) {_frame(k)} = {k} THEN round(stddev_samp(y) {_frame(k)}, 6) END AS std_{k}" for k in (7, 14))


@query(f"WITH {FULL} SELECT series_id, ts, round(y, 6) AS y, {_ROLL} FROM p")
def rolling_mean_std_7_14(spark, d):
    return rounded(X.rolling(hourly_full(spark, d), 7, 14))


@query(
    f"WITH {FULL}, f AS (SELECT series_id, ts, y, avg(y) {_frame(20)} AS m, stddev_samp(y) {_frame(20)} AS s, count(y) {_frame(20)} AS n, quantile_cont(y, 0.25) {_frame(20)} AS a, quantile_cont(y, 0.75) {_frame(20)} AS b FROM p) "
    "SELECT series_id, ts, round(y, 8) AS y, CASE WHEN n = 20 THEN round(m, 8) END AS mean, CASE WHEN n = 20 THEN round(m - 2 * s, 8) END AS lower, CASE WHEN n = 20 THEN round(m + 2 * s, 8) END AS upper, "
    "CASE WHEN n = 20 THEN round(a, 8) END AS q25, CASE WHEN n = 20 THEN round(b, 8) END AS q75 FROM f"
)
def rolling_bands(spark, d):
    return rounded(X.rolling_band(hourly_full(spark, d), 20, 2.0), 8)


_SOFAR = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"WITH {FULL} SELECT series_id, ts, round(y, 6) AS y, round(avg(y) {_SOFAR}, 6) AS mean, round(coalesce(stddev_samp(y) {_SOFAR}, 0), 6) AS std, count(y) {_SOFAR} AS n FROM p")
def expanding_stats(spark, d):
    return rounded(segments.expanding(hourly_full(spark, d), rows=SEGMENT).select("series_id", "ts", "y", "mean", "std", "n"))


@query(f"WITH {DAILY} SELECT series_id, ts, round(y, 6) AS y, round(y - lag(y) OVER w, 6) AS diff, round((y - lag(y) OVER w) / lag(y) OVER w, 6) AS pct, round(ln(y / lag(y) OVER w), 6) AS logret FROM d {_W}")
def diff_pct_logret(spark, d):
    return rounded(X.changes(daily(spark, d)))


@query(f"WITH {DAILY} SELECT series_id, ts, round(y, 6) AS back FROM d")
def cumsum_undiff(spark, d):
    """Differences summed up again onto the first value give the series back."""
    diff = X.changes(daily(spark, d)).withColumn("step", F.coalesce("diff", "y"))
    return segments.cumulated(diff, "step", "back", rows=SEGMENT).select("series_id", "ts", F.round("back", 6).alias("back"))


@query(f"WITH {DAILY} SELECT series_id, ts, round(exp(sum(ln(1 + 1 / (100 + abs(y)))) {_SOFAR}), 6) AS product FROM d")
def compound_growth(spark, d):
    factor = daily(spark, d).withColumn("f", 1 + 1 / (100 + F.abs("y")))
    return rounded(segments.compounded(factor, "f", rows=SEGMENT).select("series_id", "ts", "product"))


@query(f"WITH {FULL}, g AS (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM p {_W}) SELECT series_id, ts, round(y, 6) AS y, round(CASE WHEN a IS NULL THEN b - y WHEN b IS NULL THEN y - a ELSE (b - a) / 2 END, 6) AS grad FROM g")
def numeric_gradient(spark, d):
    return rounded(X.gradient(hourly_full(spark, d)))


@query(f"WITH {FULL}, g AS (SELECT series_id, ts, (row_number() OVER w - 1) * (2 * pi() / 24) AS a FROM p {_W}) SELECT series_id, ts, round(sin(a), 6) + 0.0 AS sin_24_1, round(cos(a), 6) + 0.0 AS cos_24_1 FROM g")
def fourier_features(spark, d):
    out = X.fourier(hourly_full(spark, d), 24)
    return out.select("series_id", "ts", *((F.round(c, 6) + 0.0).alias(c) for c in ("sin_24_1", "cos_24_1")))


@query(f"WITH {FULL}, g AS (SELECT series_id, ts, y, list(y) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS x FROM p) SELECT series_id, ts, round(y, 6) AS y, round(list_sum(x), 6) AS total, round(x[1], 6) AS oldest FROM g WHERE len(x) = 5")
def supervised_windows(spark, d):
    out = X.supervised(hourly_full(spark, d), 5)
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return rounded(out.select("series_id", "ts", "y", total.alias("total"), F.col("x")[0].alias("oldest")))


@query(f"WITH {FULL}, g AS (SELECT series_id, ts, y AS e0, lead(y, 10) OVER w AS e1, lead(y, 20) OVER w AS e2 FROM p {_W}) SELECT series_id, ts, round(e0, 6) AS e0, round(e1, 6) AS e1, round(e2, 6) AS e2 FROM g WHERE e2 IS NOT NULL")
def delay_embedding(spark, d):
    return rounded(X.delay_embedding(hourly_full(spark, d), 3, 10).select(*SET, "e0", "e1", "e2"))


@query(f"WITH {FULL} SELECT series_id, ts, round(y, 6) AS y FROM p WHERE y >= 60")
def threshold_filter(spark, d):
    return rounded(hourly_full(spark, d).where("y >= 60"))


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' AND event_type <> 'view'")
def time_range_filter(spark, d):
    e = table(spark, d, "events")
    return e.where("ts >= TIMESTAMP_NTZ'2024-01-10' AND ts < TIMESTAMP_NTZ'2024-01-12' AND NOT event_type = 'view'").select("event_id", "ts", "event_type")


@query(f"WITH {FULL} SELECT series_id, ts, round(y, 6) AS y FROM p QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 24")
def tail_per_series(spark, d):
    return rounded(evaluate.tail(hourly_full(spark, d), 24))


@query("SELECT event_type, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 10")
def head_topk(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", "value")
    return A.top_k(e, "event_type", [F.col("value").desc_nulls_last(), F.col("event_id")], 10)


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def distinct_types(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS place FROM events")
def sorted_values(spark, d):
    """Every row with its place in ascending order."""
    e = table(spark, d, "events").select("event_type", "event_id", "value")
    return segments.ranked(e, "value", ("event_id",), by="event_type", rows=SEGMENT)


@query("SELECT o_orderkey AS order_id, o_totalprice AS y FROM orders")
def renamed_columns(spark, d):
    return table(spark, d, "orders").withColumnsRenamed({"o_orderkey": "order_id", "o_totalprice": "y"}).select("order_id", "y")


@query(f"WITH {SPINE} SELECT series_id, ts, round(y, 6) AS y FROM gaps WHERE y IS NOT NULL")
def drop_missing(spark, d):
    """The grid's empty hours are NULL rows, which are dropped again."""
    return rounded(grid.on_grid(hourly(spark, d), "hour").dropna(subset=["y"]))


@query("WITH s AS (SELECT event_type AS series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 15 MINUTES)) AS ts FROM events GROUP BY 1) SELECT s.series_id, s.ts, round(value, 6) AS y FROM s LEFT JOIN events e ON e.event_type = s.series_id AND e.ts = s.ts")
def asfreq_raw_15min(spark, d):
    """Raw rows put on a grid from the first one on: all that are off the grid are lost."""
    return rounded(grid.on_grid(raw_events(spark, d), "15min"))


@query("SELECT CASE WHEN ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 100 < 80 THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1")
def random_split(spark, d):
    """A split by a hash of the key: random, and the same whatever the partitions."""
    o = evaluate.hashed_split(table(spark, d, "orders"), "o_orderkey", 80)
    return o.groupBy("part").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query(f"WITH {DAILY} SELECT CASE WHEN ts < TIMESTAMP '1997-01-01' THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(ts) AS first, max(ts) AS last FROM d GROUP BY 1")
def split_at_time(spark, d):
    p = evaluate.split_at(daily(spark, d), "1997-01-01")
    return p.groupBy("part").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(f"WITH {FULL}, s AS (SELECT series_id, ts, y - lag(y) OVER w > 0 AS up FROM p WINDOW w AS (PARTITION BY series_id ORDER BY ts)), g AS (SELECT series_id, up, lag(up) OVER (PARTITION BY series_id ORDER BY ts) AS guess FROM s) SELECT series_id, round(avg((up = guess)::INT), 6) AS accuracy FROM g GROUP BY 1")
def direction_accuracy(spark, d):
    """How often an hour moves as the one before it did."""
    w = X.ordered()
    s = hourly_full(spark, d).withColumn("up", F.col("y") - F.lag("y").over(w) > 0)
    return rounded(evaluate.accuracy(s.withColumn("guess", F.lag("up").over(w)), ["series_id"], "up", "guess"))


@query("WITH l AS (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS x FROM pages) SELECT page_id, k - 1 AS place, x[k] AS link FROM (SELECT page_id, x, unnest(range(1, least(len(x), 3) + 1)) AS k FROM l)")
def first_links(spark, d):
    """The first three links of each page in their order."""
    return text.first_links(table(spark, d, "pages"), 3)


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def dedup_rows(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderstatus").dropDuplicates()


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_prop_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


#: Orders as an untidy file would show them: thousands commas, a missing word, times with AM and PM, counts in K and M.
_DIRTY = (
    "t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 3 = 0 THEN (o_orderkey * 1000)::VARCHAR ELSE (o_custkey // 1000)::VARCHAR || ',' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') || CASE WHEN o_orderkey % 2 = 0 THEN '.5' ELSE '' END END AS a, "
    "CASE WHEN o_orderkey % 5 = 0 THEN 'no date' ELSE strftime(o_orderdate + to_minutes((o_orderkey % 1440)::INT), '%-m/%-d/%Y %-I:%M %p') END AS b, (o_custkey % 90)::VARCHAR || CASE WHEN o_orderkey % 4 = 0 THEN '.5K' WHEN o_orderkey % 4 = 1 THEN 'M' ELSE '' END AS c FROM orders)"
)


@query(f"WITH {_DIRTY} SELECT k, a, TRY_CAST(replace(a, ',', '') AS DOUBLE) AS x, TRY_CAST(replace(a, ',', '') AS DOUBLE) IS NOT NULL AND strpos(a, '.') = 0 AS whole, try_strptime(b, '%m/%d/%Y %I:%M %p') AS t, round(TRY_CAST(regexp_replace(c, '[KM]$', '') AS DOUBLE) * CASE WHEN c LIKE '%K' THEN 1000 WHEN c LIKE '%M' THEN 1000000 ELSE 1 END, 2) AS n FROM t")
def parse_coerce(spark, d):
    """Orders' keys, days and customers, written untidily and read back."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = F.concat(F.floor(c / 1000), F.lit(","), F.lpad((c % 1000).cast("string"), 3, "0"), F.when(k % 2 == 0, ".5").otherwise(""))
    a = F.when(k % 7 == 0, "n/a").when(k % 3 == 0, (k * 1000).cast("string")).otherwise(number)
    at = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + k % 1440 * 60)
    b = F.when(k % 5 == 0, "no date").otherwise(F.date_format(at, "M/d/yyyy h:mm a"))
    n = F.concat(c % 90, F.when(k % 4 == 0, ".5K").when(k % 4 == 1, "M").otherwise(""))
    t = table(spark, d, "orders").select(k.alias("k"), a.alias("a"), b.alias("b"), n.alias("c"))
    return t.select("k", "a", clean.to_number("a").alias("x"), clean.to_whole("a").isNotNull().alias("whole"), clean.to_time("b", "M/d/yyyy h:mm a").alias("t"), F.round(clean.suffixed_number("c"), 2).alias("n"))


@query("SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code, count(*) AS n FROM events GROUP BY event_type")
def category_codes(spark, d):
    return clean.codes(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type")


@query("SELECT DISTINCT o_orderdate::DATE AS day, datediff('day', DATE '0001-01-01', o_orderdate::DATE) + 1 AS ordinal FROM orders")
def ordinal_dates(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct().withColumn("ordinal", clean.ordinal_date("day"))


@query(f"WITH {DAILY}, n AS (SELECT ts, y, row_number() OVER (ORDER BY ts) - 1 AS i FROM d) SELECT ts, CASE WHEN i % 12 < 3 THEN 1 ELSE 0 END AS flag FROM n")
def recession_flag(spark, d):
    return X.numbered(daily(spark, d)).select("ts", F.when(F.pmod("i", F.lit(12)) < 3, 1).otherwise(0).alias("flag"))


_CHART = "c AS (SELECT series_id, avg(y) AS m, stddev_samp(y) AS s FROM p GROUP BY 1), o AS (SELECT p.series_id, p.ts, p.y, m, m - 3 * s AS lcl, m + 3 * s AS ucl, coalesce(y > m + 3 * s OR y < m - 3 * s, false) AS outside FROM p JOIN c USING (series_id))"


@query(f"WITH {FULL}, {_CHART} SELECT series_id, ts, round(y, 6) AS y, round(m, 6) AS centre, round(lcl, 6) AS lcl, round(ucl, 6) AS ucl, outside FROM o")
def control_chart(spark, d):
    return rounded(A.control_chart(hourly_full(spark, d)))


@query(f"WITH {FULL}, f AS (SELECT series_id, ts, y > avg(y) OVER (PARTITION BY series_id) AS hit FROM p), g AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - row_number() OVER (PARTITION BY series_id, hit ORDER BY ts) AS k FROM f) SELECT series_id, min(ts) AS from_ts, max(ts) AS to_ts, count(*) AS n FROM g WHERE hit GROUP BY series_id, k")
def flagged_runs(spark, d):
    p = hourly_full(spark, d)
    mean = p.groupBy("series_id").agg(F.avg("y").alias("m"))
    return A.runs(p.join(mean, "series_id").withColumn("hit", F.col("y") > F.col("m")), "hit").drop("run")


@query(f"WITH {FULL}, c AS (SELECT series_id, avg(y) AS m, stddev_samp(y) AS s FROM p GROUP BY 1), k(k, normal) AS (VALUES (1, 0.6827), (2, 0.9545), (3, 0.9973)) SELECT series_id, k::BIGINT AS k, normal::DOUBLE AS normal, round(any_value(m - k * s), 6) AS lower, round(any_value(m + k * s), 6) AS upper, round(avg((y BETWEEN m - k * s AND m + k * s)::INT), 6) AS inside FROM p JOIN c USING (series_id), k GROUP BY series_id, k, normal")
def sigma_bands(spark, d):
    return rounded(A.sigma_bands(hourly_full(spark, d)))


@query(f"WITH {FULL}, v AS (SELECT series_id, ts, y, avg(y) OVER (PARTITION BY series_id) AS m FROM p) SELECT series_id, ts, round(y, 6) AS y, round(avg((y - m) ** 2) {_SOFAR}, 6) AS running_var FROM v")
def running_variance(spark, d):
    return rounded(segments.variance_about_mean(hourly_full(spark, d), rows=SEGMENT))


@query(
    "WITH r AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, event_type AS series_id FROM events GROUP BY 4) "
    "SELECT series_id, least(floor((value - lo) / ((hi - lo) / 30)), 29)::BIGINT AS bin, count(*) AS c, round(count(*) / (any_value(n) * any_value((hi - lo) / 30)), 6) AS density FROM events JOIN r ON event_type = series_id GROUP BY 1, 2"
)
def histogram_30(spark, d):
    return rounded(A.histogram(raw_events(spark, d), 30))


_QS = {"p2_5": 0.025, "p5": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95, "p97_5": 0.975, "p99": 0.99}


@query("SELECT event_type AS series_id, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS {n}" for n, q in _QS.items()) + " FROM events GROUP BY 1")
def percentile_bands(spark, d):
    return rounded(A.percentiles(raw_events(spark, d), _QS))


@query("SELECT event_type AS series_id, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(stddev_pop(value), 6) AS std_pop, round(var_samp(value), 6) AS var, round(min(value), 6) AS low, round(max(value), 6) AS high, round(median(value), 6) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM events GROUP BY 1")
def iqr_features(spark, d):
    return rounded(A.summary(raw_events(spark, d)))


@query(f"WITH {FULL} SELECT series_id, round(arg_min(y, ts), 6) AS first, round(arg_max(y, ts), 6) AS last FROM p GROUP BY 1")
def first_last(spark, d):
    return rounded(A.first_last(hourly_full(spark, d)))


@query("WITH c AS (SELECT year(o_orderdate) AS k, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT unnest(generate_series(min(k), max(k))) AS k FROM c) SELECT k, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (k)")
def tabulate_by_year(spark, d):
    return A.tabulate(table(spark, d, "orders"), F.year("o_orderdate").cast("double"))


_Z = 1.959963984540054  # the 0.975 quantile of the normal distribution
_T = f"{_Z} + {(_Z**3 + _Z) / 4} / (n - 1) + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96} / (n - 1) ** 2 + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384} / (n - 1) ** 3 + {(79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160} / (n - 1) ** 4"


@query(f"WITH m AS (SELECT event_type AS series_id, count(value) AS n, avg(value) AS mean, stddev_samp(value) / sqrt(count(value)) AS se FROM events GROUP BY 1), q AS (SELECT *, {_T} AS t FROM m) SELECT series_id, n, round(mean, 6) AS mean, round(se, 6) AS se, round(t, 6) AS t, round(mean - t * se, 6) AS lower, round(mean + t * se, 6) AS upper FROM q")
def mean_t_interval(spark, d):
    return rounded(A.mean_interval(raw_events(spark, d)))


@query(
    f"WITH m AS (SELECT event_type AS series_id, ts::DATE AS day, count(value) AS n, avg(value) AS mean, stddev_samp(value) / sqrt(count(value)) AS se FROM events GROUP BY ALL), "
    f"q AS (SELECT series_id, mean, se * ({_T}) AS w FROM m WHERE n > 1), t AS (SELECT event_type AS series_id, avg(value) AS truth FROM events GROUP BY 1) "
    "SELECT series_id, count(*) AS n, round(avg((truth BETWEEN mean - w AND mean + w)::INT), 6) AS coverage, round(avg(2 * w), 6) AS width FROM q JOIN t USING (series_id) GROUP BY 1"
)
def interval_coverage(spark, d):
    """How many of the days' intervals of the mean hold the mean of all days."""
    e = raw_events(spark, d)
    days = A.mean_interval(e.withColumn("g", F.struct("series_id", F.col("ts").cast("date").alias("day"))), by="g").select("g.series_id", "lower", "upper")
    return rounded(A.interval_coverage(days, e.groupBy("series_id").agg(F.avg("y").alias("truth"))))


@query("SELECT date_trunc('day', ts)::DATE AS day, nullif(count(*) FILTER (event_type = 'click'), 0) AS click, nullif(count(*) FILTER (event_type = 'purchase'), 0) AS purchase, nullif(count(*) FILTER (event_type = 'view'), 0) AS view FROM events GROUP BY 1")
def pivot_type_by_day(spark, d):
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return reshape.spread(e, ["day"], "event_type", ["click", "purchase", "view"], F.count(F.lit(1)))


@query("SELECT series_id, metric, round(v, 6) AS v FROM (SELECT event_type AS series_id, avg(value) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1) UNPIVOT (v FOR metric IN (mean, low, high))")
def melt_metrics(spark, d):
    wide = A.moments(raw_events(spark, d)).select("series_id", "mean", "low", "high")
    return rounded(reshape.melt(wide, ["series_id"], ["mean", "low", "high"], "metric", "v"))


@query(f"WITH {DAILY}, {SHIPPED} SELECT ts, round(y, 6) AS y, 'orders' AS source, NULL::BIGINT AS extra FROM d UNION ALL SELECT ts, round(y, 6), 'lines', 1 FROM l")
def union_sources(spark, d):
    out = reshape.union_by_name({"orders": daily(spark, d).drop("series_id"), "lines": shipped(spark, d).drop("series_id").withColumn("extra", F.lit(1).cast("long"))})
    return rounded(out)


@query(f"WITH {DAILY}, w AS (SELECT (date_trunc('week', ts)::DATE + 6)::TIMESTAMP AS ts, sum(y) AS week FROM d GROUP BY 1) SELECT d.ts, round(y, 6) AS y, round(week, 6) AS week FROM d LEFT JOIN w USING (ts)")
def index_join_weekly(spark, d):
    p = daily(spark, d)
    week = grid.resample(p, "week", "sum").select("ts", F.round("y", 6).alias("week"))
    return rounded(p.join(week, "ts", "left").select("ts", "y", "week"))


@query(f"WITH {DAILY}, {SHIPPED} SELECT ts, round(d.y, 6) AS a, round(l.y, 6) AS b FROM d FULL JOIN l USING (ts)")
def full_outer_series(spark, d):
    return rounded(reshape.align({"a": daily(spark, d), "b": shipped(spark, d)}))


@query("SELECT c.event_id, c.ts, round(v.value, 6) AS latest FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT ts, value FROM events WHERE event_type = 'view') v ON c.ts >= v.ts")
def asof_last_view(spark, d):
    e = table(spark, d, "events").withColumn("series_id", F.lit("all"))
    left = e.where("event_type = 'click'").select("series_id", "event_id", "ts")
    right = e.where("event_type = 'view'").select("series_id", "ts", F.col("value").alias("latest"))
    return rounded(grid.asof_join(left, right, "latest", within="day").select("event_id", "ts", "latest"))


_EDGES = (
    "e(child, parent) AS (SELECT 'customer ' || c_custkey, 'nation ' || c_nationkey FROM customer UNION ALL SELECT 'supplier ' || s_suppkey, 'nation ' || s_nationkey FROM supplier "
    "UNION ALL SELECT 'nation ' || n_nationkey, 'region ' || n_regionkey FROM nation UNION ALL SELECT 'region ' || r_regionkey, 'all' FROM region), "
    "up(node, ancestor, level) AS (SELECT child, parent, 1::BIGINT FROM e UNION ALL SELECT node, parent, level + 1 FROM up JOIN e ON child = ancestor)"
)


def _edges(spark, d):
    t = {n: table(spark, d, n) for n in ("customer", "supplier", "nation", "region")}
    name = lambda kind, col: F.concat(F.lit(f"{kind} "), F.col(col))
    edge = lambda df, c, p: df.select(c.alias("child"), p.alias("parent"))
    parts = [
        edge(t["customer"], name("customer", "c_custkey"), name("nation", "c_nationkey")), edge(t["supplier"], name("supplier", "s_suppkey"), name("nation", "s_nationkey")),
        edge(t["nation"], name("nation", "n_nationkey"), name("region", "n_regionkey")), edge(t["region"], name("region", "r_regionkey"), F.lit("all")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"WITH RECURSIVE {_EDGES} SELECT node, ancestor, level FROM up WHERE node NOT IN (SELECT parent FROM e)")
def hierarchy_closure(spark, d):
    """Every leaf with each of its ancestors, from a table of children and parents alone."""
    return hierarchy.leaves(hierarchy.closure(_edges(spark, d)))


@query(f"WITH RECURSIVE {_EDGES}, v AS (SELECT 'customer ' || o_custkey AS node, sum(o_totalprice) AS y FROM orders GROUP BY 1) SELECT node, round(sum(y), 3) AS y FROM (SELECT node, y FROM v UNION ALL SELECT ancestor, y FROM v JOIN up USING (node)) GROUP BY 1")
def closure_sums(spark, d):
    """Orders added up at each customer and at all above it."""
    orders = table(spark, d, "orders").select(F.concat(F.lit("customer "), F.col("o_custkey")).alias("node"), F.col("o_totalprice").alias("y"))
    return rounded(hierarchy.rolled_up(orders, hierarchy.closure(_edges(spark, d))), 3)


_LAST7 = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


@query(
    f"WITH {FULL}, h AS (SELECT series_id, ts, list(y) {_LAST7} AS x FROM p), s AS (SELECT *, list_sort(x) AS o, list_avg(x) AS m FROM h) "
    "SELECT series_id, ts, CASE WHEN len(x) = 7 THEN round(list_avg(o[2:6]), 6) END AS trimmed, CASE WHEN len(x) = 7 THEN round(list_avg(list_transform(x, lambda v: abs(v - m))), 6) END AS deviation, "
    "CASE WHEN len(x) = 7 THEN round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / 7), 6) END AS rms FROM s"
)
def rolling_any(spark, d):
    """A trimmed mean and a mean deviation as expressions over each window, a root mean square in numpy."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    p = X.rolling_apply(hourly_full(spark, d), 7, "trimmed", lambda x: mean(F.slice(F.array_sort(x), 2, 5)))
    p = X.rolling_apply(p, 7, "deviation", lambda x: mean(F.transform(x, lambda v: F.abs(v - mean(x)))))
    return rounded(X.rolling_apply_numpy(p, 7, "rms", lambda m: (m * m).mean(axis=1) ** 0.5).drop("y"))


@query(f"WITH {FULL}, c AS (SELECT series_id, ts, 0.5 * y + 0.3 * lag(y) OVER w + 0.2 * lag(y, 2) OVER w AS v FROM p WINDOW w AS (PARTITION BY series_id ORDER BY ts)) SELECT series_id, ts, round(v, 6) AS convolved FROM c WHERE v IS NOT NULL")
def convolution_valid(spark, d):
    return rounded(X.convolved(hourly_full(spark, d), [0.5, 0.3, 0.2]).drop("y"))


_H = "customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey JOIN orders o ON o.o_custkey = c.c_custkey"


@query(f"SELECT r_name, n_name, (1 - grouping(r_name)) + (1 - grouping(n_name)) AS level, round(sum(o_totalprice), 3) AS y FROM {_H} GROUP BY GROUPING SETS ((), (r_name), (r_name, n_name))")
def hierarchy_rollup(spark, d):
    """Customers' orders are added up by nation key first, so that only a few rows meet the names."""
    t = {n: table(spark, d, n) for n in ("orders", "customer", "nation", "region")}
    by_key = t["orders"].groupBy("o_custkey").agg(F.sum("o_totalprice").alias("y")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("y").alias("y"))
    named = by_key.join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return rounded(A.rollup_sum(named.select("r_name", "n_name", "y"), ["r_name", "n_name"]), 3)


@query("SELECT a, b, round(r, 6) AS r FROM (SELECT 'qty' AS a, 'price' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'qty', 'disc', corr(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 'price', 'disc', corr(l_extendedprice, l_discount) FROM lineitem UNION ALL SELECT x, x, 1.0 FROM (VALUES ('qty'), ('price'), ('disc')) AS t(x))")
def corr_matrix(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"))  # noqa: E741
    return rounded(A.correlations(l, ["qty", "price", "disc"]))


@query("SELECT query, neighbour, rank FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5")
def knn_embeddings(spark, d):
    e = table(spark, d, "embeddings")
    return reshape.nearest(e.where("vec_id % 50 = 0"), e, 5, "vec_id", "embedding").select("query", "neighbour", "rank")
