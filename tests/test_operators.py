"""Operators on small frames whose results are worked out by hand or by numpy."""

import datetime as dt
import json
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import aggregates, clean, decompose, diagnostics, dynamics, evaluate, grid, models, reshape, signal, text, windows
from chronoweave.sources import files
from chronoweave.sources.rest import ObservationSource
from chronoweave.streaming import streams


def day(i):
    return dt.datetime(2023, 1, 1) + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def primer(spark):
    return spark.createDataFrame([("a", day(i), float(i)) for i in range(10)], "series_id string, ts timestamp_ntz, y double")


def values(df, col, order="ts"):
    return [r[0] for r in df.orderBy(order).select(col).collect()]


def test_weekly_sums_end_on_sunday(primer):
    out = grid.resample(primer, "week", "sum")
    assert values(out, "y") == [0.0, 28.0, 17.0]
    assert values(out, "ts") == [day(0), day(7), day(14)]


def test_gaps_are_filled(spark):
    d = spark.createDataFrame([("a", day(0), 1.0), ("a", day(3), 4.0)], "series_id string, ts timestamp_ntz, y double")
    full = grid.on_grid(d, "day")
    assert values(full, "y") == [1.0, None, None, 4.0]
    assert values(grid.forward_fill(full), "y") == [1.0, 1.0, 1.0, 4.0]
    assert values(grid.linear_fill(full), "y") == [1.0, 2.0, 3.0, 4.0]
    assert values(grid.mean_fill(full), "y") == [1.0, 2.5, 2.5, 4.0]


def test_linear_fill_leaves_the_start_open(spark):
    d = spark.createDataFrame([("a", day(i), v) for i, v in enumerate([None, 2.0, None])], "series_id string, ts timestamp_ntz, y double")
    assert values(grid.linear_fill(d), "y") == [None, 2.0, 2.0]


def test_rolling_waits_for_a_full_window(primer):
    out = windows.rolling(primer, 3)
    assert values(out, "mean_3") == [None, None, *map(float, range(1, 9))]


def test_gradient_and_differences(primer):
    assert values(windows.gradient(primer), "grad") == [1.0] * 10
    assert values(windows.changes(primer), "diff") == [None] + [1.0] * 9


def test_supervised_windows_and_embedding(primer):
    assert values(windows.supervised(primer, 3), "x")[0] == [0.0, 1.0, 2.0]
    assert windows.supervised(primer, 3).count() == 7
    assert windows.delay_embedding(primer, 3, 2).count() == 6


def test_empty_panels_stay_empty(spark):
    none = spark.createDataFrame([], "series_id string, ts timestamp_ntz, y double")
    for f in (lambda x: grid.on_grid(x, "day"), grid.linear_fill, lambda x: windows.rolling(x, 3), aggregates.control_chart, lambda x: decompose.seasonal(x, 3)):
        assert f(none).count() == 0


def test_cleaning(spark):
    d = spark.createDataFrame([("1,234", "1.2K"), ("abc", "3M"), (None, None)], "a string, b string")
    assert [r[0] for r in d.select(clean.to_number("a")).collect()] == [1234.0, None, None]
    assert [r[0] for r in d.select(clean.suffixed_number("b")).collect()] == [1200.0, 3e6, None]
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "y double")
    assert clean.nan_to_null(nan, "y").agg(F.avg("y")).first()[0] == 1.0


def test_histogram_counts_every_value(primer):
    assert aggregates.histogram(primer, 4).agg(F.sum("c")).first()[0] == 10


def test_runs(spark):
    d = spark.createDataFrame([("a", day(i), f) for i, f in enumerate([True, True, False, True])], "series_id string, ts timestamp_ntz, hit boolean")
    assert sorted(r["n"] for r in aggregates.runs(d, "hit").collect()) == [1, 2]


def test_scaling_turns_back(primer):
    back = decompose.unminmax(decompose.minmax(primer), name="back")
    assert values(back, "back") == pytest.approx(list(range(10)))
    back = decompose.unstandard(decompose.standard(primer), name="back")
    assert values(back, "back") == pytest.approx(list(range(10)))


def test_decomposition_adds_up(primer):
    out = decompose.seasonal(primer, 4).where("trend IS NOT NULL")
    assert out.where(F.abs(F.col("trend") + F.col("seasonal") + F.col("resid") - F.col("y")) > 1e-9).count() == 0


def test_folds():
    assert evaluate.folds(100, "ts_split", 5)[0] == (0, 0, 20, 20, 36)
    assert evaluate.folds(60, "expanding", 5)[1] == (1, 0, 20, 20, 30)
    assert evaluate.folds(10, "rolling", window=4, step=2) == [(0, 0, 4, 4, 6), (1, 2, 6, 6, 8), (2, 4, 8, 8, 10)]


def test_topics_split_words_with_built_ins(spark):
    """The words of a tokenizer and a stop word remover, but not their functions: each copies all words out of Spark's rows and back."""
    from pyspark.ml.feature import RegexTokenizer, StopWordsRemover

    rows = ["The economy, THE war", "  a b\u00e9 \u0130stanbul -- x_1 and don't", "", "... !", "\u03a3\u0391\u03a3 is rights rights"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows * 4)], "doc_id long, text string")
    plain = StopWordsRemover(inputCol="w", outputCol="k").transform(RegexTokenizer(inputCol="c", outputCol="w", pattern=" ").transform(docs.withColumn("c", text.cleaned("text"))))
    want = {w for r in plain.select("k").collect() for w in r["k"]}
    top, out = text.topics(docs, k=2, words=50)
    assert {r["term"] for r in top.collect()} == want and {"rights", "economy"} < want
    assert out.columns == ["doc_id", "text", "topic"] and out.count() == len(rows) * 4
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan


def test_sliding_folds_reach_the_last_whole_one(spark):
    assert evaluate.folds(10, "sliding", window=4, step=2) == [(0, 0, 4, 4, 6), (1, 2, 6, 6, 8), (2, 4, 8, 8, 10)]
    d = spark.createDataFrame([(f"n{n}", i) for n in (5, 6, 7, 11, 12) for i in range(n)], "series_id string, i long")
    got = evaluate.with_folds(d, "sliding", window=4, step=2).where("part = 'test'").groupBy("series_id").agg({"fold": "max", "i": "max"}).collect()
    assert {tuple(r)[:1] + (r["max(fold)"], r["max(i)"]) for r in got} == {("n6", 0, 5), ("n7", 0, 5), ("n11", 2, 9), ("n12", 3, 11)}


@pytest.mark.parametrize("how", [{"scheme": "ts_split", "k": 5}, {"scheme": "expanding", "k": 4}, {"scheme": "blocked", "k": 3}, {"scheme": "rolling", "window": 4, "step": 3}, {"scheme": "sliding", "window": 30, "step": 5}])
def test_rows_find_their_folds(spark, how):
    sizes = {"a": 23, "b": 40, "c": 3}
    d = spark.createDataFrame([(s, i) for s, n in sizes.items() for i in range(n)], "series_id string, i long")
    got = {tuple(r) for r in evaluate.with_folds(d, **how).select("series_id", "i", "fold", "part").collect()}
    want = set()
    for s, n in sizes.items():
        for fold, a, b, c, e in evaluate.folds(n, **how):
            want |= {(s, i, fold, "test") for i in range(c, e)} | {(s, i, fold, "train") for i in range(a, b) if not c <= i < e}
    assert got == want


@pytest.mark.parametrize("near", [1e-3, 0.2])
def test_percentiles_are_exact(spark, near):
    rng = np.random.default_rng(4)
    groups = {"even": rng.standard_normal(5000), "tied": np.r_[np.full(900, 3.0), rng.integers(0, 9, 100)], "one": np.array([7.0]), "tail": np.exp(6 * rng.standard_normal(3000)), None: np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("even", None), ("none", None)]
    qs = {"low": 0.0, "a": 0.025, "mid": 0.5, "b": 0.99, "top": 1.0}
    got = {r[0]: r[1:] for r in aggregates.percentiles(spark.createDataFrame(rows, "series_id string, y double"), qs, near=near).collect()}
    assert got.pop("none") == (None,) * 5
    assert got.keys() == groups.keys()
    for g, x in groups.items():
        assert got[g] == pytest.approx(np.quantile(x, list(qs.values())), rel=1e-12)
    assert aggregates.percentiles(spark.createDataFrame([], "series_id string, y double"), qs).count() == 0


def test_metrics(spark):
    d = spark.createDataFrame([("a", 2.0, 1.0), ("a", 4.0, 5.0)], "series_id string, y double, yhat double")
    r = evaluate.score(d, ["series_id"]).first()
    assert (r["mse"], r["mae"], r["mape"], r["r2"]) == (1.0, 1.0, 0.375, 0.0)


def test_asof(spark):
    a = spark.createDataFrame([("s", day(2))], "series_id string, ts timestamp_ntz")
    b = spark.createDataFrame([("s", day(0), 1.0), ("s", day(2), 2.0), ("s", day(3), 3.0)], "series_id string, ts timestamp_ntz, v double")
    assert grid.asof_join(a, b, "v").first()["v"] == 2.0


def test_nearest_leaves_itself_out(spark):
    d = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "id long, v array<double>")
    got = reshape.nearest(d.where("id = 0"), d, 2, "id", "v").orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == [1, 2]


def test_nearest_in_blocks(spark):
    x = np.random.default_rng(5).integers(0, 3, (60, 4)).astype(float)  # many equal distances and equal vectors
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, v array<double>")
    got = {(r["query"], r["rank"]): r["neighbour"] for r in reshape.nearest(d.where("id % 3 = 0"), d, 4, "id", "v", query_block=7, point_block=11).collect()}
    want = {}
    for i in range(0, 60, 3):
        best = sorted((float(np.linalg.norm(x[i] - x[j])), j) for j in range(60) if j != i)[:4]
        want |= {(i, k + 1): j for k, (_, j) in enumerate(best)}
    assert got == want


def test_arima_recovers_a_coefficient():
    rng = np.random.default_rng(0)
    z = np.zeros(1500)
    for t in range(1, 1500):
        z[t] = 0.7 * z[t - 1] + rng.standard_normal()
    assert models.arima_fit(z, 1, 0, 0)["phi"][0] == pytest.approx(0.7, abs=0.06)
    assert models.arima_fit(z, 1, 0, 1)["phi"][0] == pytest.approx(0.7, abs=0.1)


@pytest.mark.parametrize("name", sorted(models.MODELS))
def test_models_follow_a_seasonal_series(name):
    t = np.arange(240)
    y = 50 + 10 * np.sin(2 * np.pi * t / 24) + 0.01 * np.random.default_rng(1).standard_normal(240)
    mean, sd = models.MODELS[name]()(y, 24)
    assert mean.shape == (24,) and np.isfinite(mean).all() and (np.asarray(sd) >= 0).all()
    if name in ("seasonal_naive", "ets", "theta", "sarima"):
        want = 50 + 10 * np.sin(2 * np.pi * np.arange(240, 264) / 24)
        assert np.abs(mean - want).max() < 1.5


def test_polynomial_division_equals_the_recursion():
    rng = np.random.default_rng(4)
    x, w = rng.standard_normal((150, 2)), np.array([0.5, -0.2, 0.1])
    for step in (1, 7):
        e = np.zeros(x.shape)
        for t in range(150):
            e[t] = x[t] - sum(w[k - 1] * e[t - k * step] for k in (1, 2, 3) if t >= k * step)
        assert models.divide(x, w, step) == pytest.approx(e) and models.divide(x[:, 0], w, step) == pytest.approx(e[:, 0])


def test_auto_arima_searches_walks_and_high_orders():
    rng = np.random.default_rng(6)
    assert {(1, 2, 0), (4, 0, 1), (7, 1, 1), (24, 2, 0), (24, 0, 1)} <= set(models.arima_specs())
    walk = np.cumsum(rng.standard_normal(200))
    m = models.arima_search(walk, (1, 1, 0), 7, 0, 0)
    assert models.arima_search(walk, (1, 1, 0), 7)["aicc"] <= m["aicc"]
    assert m["order"] == (0, 1, 0) and models.sarima_path(walk, m, 5)[0] == pytest.approx(walk[-1] + m["c"] * np.arange(1, 6))
    z = np.zeros(600)
    for t in range(4, 600):
        z[t] = -0.8 * z[t - 4] + rng.standard_normal()
    m = models.arima_search(z, (1, 0, 0), 7)
    assert m["order"][0] >= 4 and m["ar"][4] == pytest.approx(0.8, abs=0.15)


def test_auto_arima_deals_out_seasons(spark):
    rng = np.random.default_rng(7)
    y = np.tile([10.0, 30.0, 5.0, 22.0], 30) + 0.2 * rng.standard_normal(120)
    rows = [("a", i, float(v)) for i, v in enumerate(y)] + [("short", i, float(i + 2)) for i in range(3)]
    panel = spark.createDataFrame(rows, "series_id string, ts long, y double")
    out = models.auto_arima_rows(panel, 8, models.naive(), 1, 1, 1, (4,)).orderBy("series_id", "h").collect()
    assert [r["h"] for r in out] == [*range(1, 9)] * 2
    assert {r["status"] for r in out[:8]} == {"ok"} and {(r["yhat"], r["status"]) for r in out[8:]} == {(4.0, "ValueError: no order fits")}
    assert [r["yhat"] for r in out[:8]] == pytest.approx([10, 30, 5, 22] * 2, abs=1)
    assert [r["yhat"] for r in out[:8]] == pytest.approx(models.auto_arima(1, 1, 1, (4,))(y, 8)[0])


def test_failing_models_fall_back(primer):
    def bad(y, h):
        raise ValueError("no")

    out = models.forecast(primer, {"bad": bad}, 2, fallback=models.naive()).collect()
    assert {r["yhat"] for r in out} == {9.0} and out[0]["status"].startswith("ValueError")
    assert {r["yhat"] for r in models.forecast(primer, {"bad": bad}, 2).collect()} == {None}


def plain_adf(y, top):
    """The regressions one by one on common rows."""
    y = y - y.mean()
    dy, best = np.diff(y), None
    for p in range(top + 1):
        at = np.arange(top, len(dy))
        x = np.column_stack([np.ones(len(at)), y[at], *(dy[at - k] for k in range(1, p + 1))])
        b = np.linalg.lstsq(x, dy[at], rcond=None)[0]
        e = dy[at] - x @ b
        aic = len(at) * math.log(e @ e / len(at)) + 2 * x.shape[1]
        t = b[1] / math.sqrt(e @ e / (len(at) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
        if best is None or aic < best[0]:
            best = (aic, t, p)
    return best[1:]


def test_adf_tells_noise_from_a_walk(spark):
    rng = np.random.default_rng(1)
    series = {"noise": 1e5 + rng.standard_normal(400), "walk": np.cumsum(rng.standard_normal(400)), "short": rng.standard_normal(60), "tiny": np.array([1.0, 2.0])}
    rows = [(s, day(i), float(v)) for s, y in series.items() for i, v in enumerate(y)]
    got = {r["series_id"]: r for r in diagnostics.adf(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")).collect()}
    for s, y in series.items():
        if s == "tiny":
            assert got[s]["statistic"] is None and got[s]["p"] is None
            continue
        t, lags = plain_adf(y, min(int(12 * (len(y) / 100) ** 0.25), max(0, len(y) // 2 - 3)))
        assert got[s]["statistic"] == pytest.approx(t, rel=1e-6) and got[s]["lags"] == lags
    assert got["noise"]["stationary"] and got["noise"]["p"] < 0.01 and not got["walk"]["stationary"] and got["walk"]["p"] > 0.05


def test_p_values_agree_with_the_published_points(spark):
    tables = ((diagnostics.ADF_P, diagnostics.ADF_POINTS), (diagnostics.EG_P, diagnostics.EG_POINTS))
    for table, points in tables:
        rows = [(level, c[0]) for level, c in points.items()] + [(0.0, -30.0), (1.0, 5.0)]
        out = spark.createDataFrame(rows, "level double, t double").select("level", diagnostics.unit_root_p(F.col("t"), table).alias("p")).collect()
        assert all(r["p"] == pytest.approx(r["level"], abs=0.002) for r in out)
    z = [-4.0, -1.0, 0.0, 0.5, 3.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select(diagnostics.normal_cdf_column(F.col("z"))).collect()
    assert [r[0] for r in got] == pytest.approx([0.5 * (1 + math.erf(v / 2**0.5)) for v in z], abs=2e-7)


def test_f_tail():
    assert diagnostics.f_tail(4.0, 2, 10) == pytest.approx((1 + 2 * 4 / 10) ** -5, rel=1e-9)


def test_dtw_and_spline():
    a = np.array([0.0, 1.0, 2.0])
    assert dynamics.dtw(a, np.array([0.0, 0.0, 1.0, 2.0])) == 0.0
    y = np.arange(12.0) ** 2
    hole = y.copy()
    hole[5] = np.nan
    assert dynamics.cubic_fill(hole)[5] == pytest.approx(25, abs=0.6)
    assert dynamics.savgol(y, 5) == pytest.approx(y)


def test_gibbs():
    rng = np.random.default_rng(2)
    n = np.concatenate([rng.poisson(3, 40), rng.poisson(12, 60)]).astype(float)
    assert dynamics.gibbs_change(n)["change_at"][0] == pytest.approx(40, abs=3)


def test_spectra():
    t = np.arange(100)
    y = np.sin(2 * np.pi * t / 10)
    assert signal.strongest(y, 1) == pytest.approx(y, abs=1e-9)
    assert np.abs(signal.low_pass(y, 0.05)).max() < 1e-9


def test_monte_carlo_is_anchored(spark):
    p = spark.createDataFrame([("a", day(i), 100.0 + i % 3) for i in range(20)], "series_id string, ts timestamp_ntz, y double")
    out = dynamics.monte_carlo(spark, p, "2023-02-10", 10)
    assert {r["price"] for r in out.where("step = 0").collect()} == {101.0}
    with pytest.raises(ValueError):
        dynamics.monte_carlo(spark, p, "2023-01-20", 10)


def test_text(spark):
    d = spark.createDataFrame([("en", "War\n\ntoward peace; WAR!"), ("en", None)], "lang string, text string")
    assert text.keyword_trend(d, ["lang"], ("war",)).first()["war"] == 3
    pages = spark.createDataFrame([(1, "<title>T 1990</title><p>a</p><dl><dt>K</dt><dd>v</dd></dl>"), (2, None)], "page_id long, html string")
    rows = {r["page_id"]: r for r in text.records(pages).collect()}
    assert rows[1]["title"] == "T 1990" and rows[1]["fields"] == {"K": "v"} and rows[2]["fields"] == {}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,value\n2025-01-07 00:00:14,1.5\n2025-01-07 00:15:10,x\n")
    assert [r["y"] for r in files.read_series(spark, str(tmp_path / "a.csv")).collect()] == [1.5]
    (tmp_path / "b.csv").write_text("date,other\n2025-01-08,2\n")
    both = files.read_folder(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert both.count() == 3 and set(both.columns) == {"date", "value", "other", "source_file"}
    (tmp_path / "c.csv").write_text("date,value\n2025-01-09,7\n")
    three = files.read_folder(spark, [str(tmp_path / f"{n}.csv") for n in "abc"])
    assert {(r["source_file"], r["value"], r["other"]) for r in three.collect()} >= {("c.csv", "7", None), ("b.csv", None, "2")}
    body = {"series_id": "s", "observations": [{"date": "2020-01-01", "value": "1.0"}, {"date": "2020-01-02", "value": "."}]}
    (tmp_path / "o.json").write_text(json.dumps(body))
    assert files.read_observations(spark, str(tmp_path / "o.json")).count() == 1
    spark.dataSource.register(ObservationSource)
    assert spark.read.format("observations").option("urls", (tmp_path / "o.json").as_uri()).load().count() == 2
    with wave.open(str(tmp_path / "s.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(np.zeros(80, np.int16).tobytes())
    assert len(files.read_wave(spark, str(tmp_path / "s.wav")).first()["samples"]) == 80
    files.write_parquet(both, str(tmp_path / "out"), ["source_file"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_streams(spark, tmp_path):
    rows = [("a", day(0) + dt.timedelta(minutes=20 * i), float(i)) for i in range(6)]
    spark.createDataFrame(rows, "series_id string, ts timestamp, y double").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("series_id string, ts timestamp, y double").parquet(str(tmp_path / "in"))
    for name, df, mode in (("w", streams.windowed(read()), "complete"), ("s", streams.smoothed(read()), "append")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("w").collect()) == [3, 3]
    assert [r["level"] for r in spark.table("s").orderBy("ts").collect()][:3] == [0.0, 0.5, 1.25]


def test_historical_forecasts_of_two_lags(spark):
    rng = np.random.default_rng(6)
    y = [0.0, 0.0]
    for _ in range(60):
        y.append(0.5 * y[-1] - 0.3 * y[-2] + rng.standard_normal())
    d = spark.createDataFrame([("a", day(i), v) for i, v in enumerate(y)] + [("short", day(i), 1.0) for i in range(4)], "series_id string, ts timestamp_ntz, y double")
    got = {(r["ts"], r["h"]): r["yhat"] for r in models.historical_forecasts(d, (1, 2), 0.8, 3, stride=2).collect()}
    m = int(len(y) * 0.8)
    b = np.linalg.lstsq(np.array([[1, y[t - 1], y[t - 2]] for t in range(2, m)]), np.array(y[2:m]), rcond=None)[0]
    want = {}
    for o in range(m - 1, len(y) - 3, 2):
        past = y[: o + 1]
        for h in range(1, 4):
            past = [*past, b[0] + b[1] * past[-1] + b[2] * past[-2]]
            want[(day(o + h), h)] = past[-1]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_recursive_forecast_and_saved_models(spark, tmp_path):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    d = spark.createDataFrame([(s, day(i), float((i * 7 + len(s)) % 11)) for s in ("a", "bb") for i in range(40)], "series_id string, ts timestamp_ntz, y double")
    f = models.calendar_lags(d, {k: F.lag("y", k).over(windows.ordered()) for k in (1, 3)}).dropna()
    fitted = LinearRegression(labelCol="y", solver="normal").fit(VectorAssembler(inputCols=models.feature_names((1, 3)), outputCol="features").transform(f))
    files.save_model(fitted, str(tmp_path / "model"))
    kept = files.load_model(str(tmp_path / "model"))
    for model in (fitted, kept):
        got = {(r["series_id"], r["h"]): r["yhat"] for r in models.recursive_forecast(model, d, (1, 3), 4, "1 day").collect()}
        for s in ("a", "bb"):
            past = [float((i * 7 + len(s)) % 11) for i in range(40)]
            for h in range(1, 5):
                x = [past[-1], past[-3], 0, day(39 + h).weekday()]
                past.append(float(np.dot(fitted.coefficients.toArray(), x)) + fitted.intercept)
                assert got[(s, h)] == pytest.approx(past[-1])


def test_backtest_on_a_window(primer):
    out = models.backtest(primer, {"average": models.average()}, 2, 2, 2, window=3).collect()
    assert {(r["cutoff"], r["h"], r["y"], r["yhat"]) for r in out} == {(0, 1, 8.0, 6.0), (0, 2, 9.0, 6.0), (1, 1, 6.0, 4.0), (1, 2, 7.0, 4.0)}


def test_random_effects_of_odd_panels(spark):
    schema = "e long, x double, y double"
    assert diagnostics.random_effects(spark.createDataFrame([], schema), "e", "x", "y").first()["slope"] is None
    flat = spark.createDataFrame([(i, float(j), 2.0 * j + 1) for i in range(4) for j in range(5)] + [(9, None, 1.0)], schema)
    r = diagnostics.random_effects(flat, "e", "x", "y").first()
    assert (r["slope"], r["intercept"], r["var_entity"]) == pytest.approx((2.0, 1.0, 0.0))
