"""Vector autoregressions, tuning, sampled paths, hierarchies and the streaming filter against plain computations."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import dynamics, hierarchy, models, multivariate, recurrences, sampled, signal, text, trend, tuning, windows
from chronoweave.sources import files
from chronoweave.streaming import streams


def day(i):
    return dt.datetime(2023, 1, 1) + dt.timedelta(days=i)


def frame(spark, series, cols=("y",)):
    rows = [(s, day(i), *map(float, np.atleast_1d(v))) for s, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in cols))


def plain_filter(y: np.ndarray, dt: float = 0.1, q: float = 0.1, r: float = 1.0) -> pd.DataFrame:
    """Position and velocity by a constant-velocity filter from x = 0, P = I on."""
    f, h = np.array([[1, dt], [0, 1]]), np.array([1.0, 0.0])
    x, p, out = np.zeros(2), np.eye(2), []
    for z in y:
        x, p = f @ x, f @ p @ f.T + q * np.eye(2)
        k = p @ h / (h @ p @ h + r)
        x = x + k * (z - h @ x)
        p = p - np.outer(k, h @ p)
        out.append(x)
    out = np.array(out).reshape(-1, 2)
    return pd.DataFrame({"t": np.arange(len(y)), "position": out[:, 0], "velocity": out[:, 1]})


def plain_var(y, p, top):
    """Coefficients on the rows from top on, of values less their means, and what is left."""
    z = y - y.mean(axis=0)
    x = np.column_stack([np.ones(len(z) - top)] + [z[top - k : len(z) - k] for k in range(1, p + 1)])
    b = np.linalg.lstsq(x, z[top:], rcond=None)[0]
    return b, z[top:] - x @ b, z


def test_vector_autoregressions(spark):
    rng = np.random.default_rng(2)
    series = {"long": 1000 + dynamics.simulate_var(400, np.array([[0.5, 0.2], [0.0, 0.4]])), "other": rng.standard_normal((60, 2)), "tiny": rng.standard_normal((4, 2))}
    d = frame(spark, series, ("a", "b"))
    got = {r["series_id"]: r for r in multivariate.var_fit(d, ["a", "b"], most=6).collect()}
    assert got["tiny"]["order"] is None
    ahead = {(r["series_id"], r["h"]): (r["a"], r["b"]) for r in multivariate.var_forecast(d, ["a", "b"], 5, most=6).collect()}
    for s in ("long", "other"):
        y = series[s]
        top = min(6, len(y) // 6)
        aic = []
        for p in range(1, top + 1):
            _, e, _ = plain_var(y, p, top)
            aic.append(np.linalg.slogdet(e.T @ e / len(e))[1] + 2 * p * 4 / len(e))
        p = int(np.argmin(aic)) + 1
        b, _, z = plain_var(y, p, top)
        assert got[s]["order"] == p and np.array(got[s]["coefficients"]) == pytest.approx(b, abs=1e-6)
        past = list(z)
        for h in range(1, 6):
            past.append(b[0] + sum(past[-k] @ b[1 + 2 * (k - 1) : 1 + 2 * k] for k in range(1, p + 1)))
            assert ahead[s, h] == pytest.approx(tuple(past[-1] + y.mean(axis=0)), abs=1e-5)


def test_varma_and_impulses(spark):
    y = 5 + dynamics.simulate_var(300, np.array([[0.6, 0.0], [0.3, 0.2]]), seed=3)
    d = frame(spark, {"s": y}, ("a", "b"))
    _, e, z = plain_var(y, 5, 5)
    z = z[5:]
    x = np.column_stack([np.ones(len(z) - 1), z[:-1], e[:-1]])
    b = np.linalg.lstsq(x, z[1:], rcond=None)[0]
    want, last, shock = [], z[-1], e[-1]
    for _ in range(4):
        last = b[0] + last @ b[1:3] + shock @ b[3:]
        shock = np.zeros(2)
        want.append(last + y.mean(axis=0))
    got = multivariate.varma_forecast(d, ["a", "b"], 4).orderBy("h").collect()
    assert np.array([(r["a"], r["b"]) for r in got]) == pytest.approx(np.array(want), abs=1e-6)
    b, _, _ = plain_var(y, 1, 1)
    a = np.array([[1.0, 0.0], [-0.5, 1.0]])
    got = {(r["t"], r["of"], r["shock"]): r for r in multivariate.impulse_responses(d, ["a", "b"], 1, 4, a).collect()}
    psi = [np.linalg.matrix_power(b[1:].T, t) @ np.linalg.inv(a) for t in range(4)]
    for (t, i, j), r in got.items():
        total = sum(p**2 for p in psi[: t + 1])
        assert r["response"] == pytest.approx(psi[t][i, j], abs=1e-6) and r["share"] == pytest.approx(total[i, j] / total[i].sum(), abs=1e-6)
    p = frame(spark, {"x": [1, 2, 3], "y": [4, 5], "z": [6]})
    assert sorted(r["series_id"] for r in multivariate.pairs(p).collect()) == ["x~y", "x~y", "x~z", "y~z"]


def test_successive_halving(spark, tmp_path):
    rng = np.random.default_rng(5)
    season = np.tile([1.0, 5.0, 2.0, 8.0], 20)
    series = {"season": season + 0.1 * rng.standard_normal(80), "level": 10 + rng.standard_normal(80), "walk": np.cumsum(rng.standard_normal(80)), "short": np.arange(5.0)}
    candidates = [("naive", {"season": 1}), ("naive", {"season": 4}), ("average", {}), ("average", {"last": 40}), ("theta", {"season": 4})]
    d = frame(spark, series)
    got = {r["series_id"]: r for r in tuning.successive_halving(d, candidates, 4).collect()}

    def rmse(y, c, cutoffs):
        name, given = candidates[c]
        errors = []
        for k in range(cutoffs):
            cut = len(y) - 4 * (k + 1)
            ahead = tuning.TUNABLE[name](**given)(y[:cut], 4)[0]
            errors.append(((ahead - y[cut : cut + 4]) ** 2).mean())
        return float(np.sqrt(np.mean(errors)))

    assert got["short"]["rmse"] is None
    for s in ("season", "level", "walk"):
        y, left, cutoffs = series[s], list(range(5)), 1
        for keep in (3, 2, 1):
            left = sorted(left, key=lambda c: (round(rmse(y, c, cutoffs), 9), c))[:keep]
            cutoffs *= 2
        assert got[s]["candidate"] == left[0] and got[s]["rmse"] == pytest.approx(rmse(y, left[0], 4)) and got[s]["cutoffs"] == 4
    assert got["season"]["params"] == '{"season": 4}'
    files.write_parquet(tuning.successive_halving(d, candidates, 4), str(tmp_path / "winners"))
    ahead = tuning.forecast_tuned(d, spark.read.parquet(str(tmp_path / "winners")), 4).where("series_id = 'season'").orderBy("h").collect()
    best = candidates[got["season"]["candidate"]]
    assert [r["yhat"] for r in ahead] == pytest.approx(tuning.TUNABLE[best[0]](**best[1])(series["season"], 4)[0].tolist())
    assert tuning.successive_halving(d.limit(0), candidates, 4).count() == 0


def test_sampled_paths(spark):
    rng = np.random.default_rng(6)
    y = [0.0, 0.0]
    for _ in range(300):
        y.append(3 + 0.5 * y[-1] - 0.3 * y[-2] + rng.standard_normal())
    fits = sampled.autoregression(frame(spark, {"a": y, "short": [1.0, 2.0, 3.0]}), 2)
    r = {f["series_id"]: f for f in fits.collect()}
    x = np.column_stack([np.ones(300), y[1:-1], y[:-2]])
    b = np.linalg.lstsq(x, np.array(y[2:]), rcond=None)[0]
    e = np.array(y[2:]) - x @ b
    assert r["short"]["coefficients"] is None and r["a"]["coefficients"] == pytest.approx(b.tolist())
    assert r["a"]["sigma"] == pytest.approx(np.sqrt(e @ e / 297)) and r["a"]["last"] == pytest.approx(y[-2:])
    paths = sampled.sampled_paths(fits, 6, draws=1000).cache()
    again = {tuple(p) for p in sampled.sampled_paths(fits.repartition(3), 6, draws=1000).collect()}
    assert again == {tuple(p) for p in paths.collect()} and paths.count() == 6000
    quiet = sampled.sampled_paths(fits.withColumn("sigma", F.lit(0.0)), 6, draws=1).orderBy("step").collect()
    past = list(y)
    for p in quiet:
        past.append(b[0] + b[1] * past[-1] + b[2] * past[-2])
        assert p["y"] == pytest.approx(past[-1])
    band = {p["step"]: p for p in sampled.bands(paths, {"lo": 0.1, "hi": 0.9}).collect()}
    ends = np.array([p["y"] for p in paths.where("step = 6").collect()])
    assert (band[6]["lo"], band[6]["hi"]) == pytest.approx(tuple(np.percentile(ends, [10, 90]))) and band[6]["mean"] == pytest.approx(ends.mean())
    assert ends.mean() == pytest.approx(past[-1], abs=0.2) and 0.8 < band[1]["hi"] - band[1]["mean"] < 1.8
    t = sampled.terminal_bands(paths.where("step = 6")).first()
    assert t["inside"] == pytest.approx(np.mean(np.abs(ends - ends.mean()) <= 0.67 * ends.std()), abs=1e-9)


def test_closure_of_a_hierarchy(spark):
    edges = [(f"n{i}", f"n{i // 2}") for i in range(2, 130)] + [("x", "n5"), ("x", "n9"), ("n5", "n2"), (None, "n1"), ("n1", None)]
    df = spark.createDataFrame(edges, "child string, parent string")
    above = {}
    for c, p in edges:
        if c and p:
            above.setdefault(c, set()).add(p)
    want, level, reached = set(), 1, {(c, p) for c, ps in above.items() for p in ps}
    while reached:
        want |= {(n, a, level) for n, a in reached}
        reached, level = {(n, b) for n, a in reached for b in above.get(a, ())}, level + 1
    paths = hierarchy.closure(df)
    assert sorted(map(tuple, paths.collect())) == sorted(want)
    ancestors = {a for _, a, _ in want}
    assert {r["node"] for r in hierarchy.leaves(paths).collect()} == {n for n, _, _ in want if n not in ancestors}
    values = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("n64", 5.0), ("lone", 7.0)], "node string, y double")
    sums = {r["node"]: r["y"] for r in hierarchy.rolled_up(values, paths).collect()}
    assert sums["n1"] == 8.0 and sums["n2"] == 8.0 and sums["x"] == 3.0 and sums["lone"] == 7.0 and sums["n9"] == 3.0
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b")], "child string, parent string"))
    assert hierarchy.closure(df.limit(0)).count() == 0


@pytest.mark.parametrize("shape", [(40, 200, 3), (5, 30, 2), (5000, 6, 3)])
def test_latent_factors_of_many_series(spark, shape):
    n, times, rank = shape
    rng = np.random.default_rng(7)
    m = rng.standard_normal((n, rank)) @ (rng.standard_normal((rank, times)) * np.arange(1, rank + 1)[:, None] * 10) + 0.1 * rng.standard_normal((n, times))
    pdf = pd.DataFrame({"series_id": np.repeat([f"s{i}" for i in range(n)], times), "t": np.tile(np.arange(times), n), "y": m.ravel()})
    d = spark.createDataFrame(pdf).withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(CAST(t AS INT))")).drop("t")
    u, s, v = np.linalg.svd(m, full_matrices=False)
    want = ((m - u[:, :rank] * s[:rank] @ v[:rank]) ** 2).mean(axis=0)
    got = [r["error"] for r in signal.latent_factors(d, rank).orderBy("ts").collect()]
    assert got == pytest.approx(want.tolist(), rel=1e-4, abs=1e-9)


def test_rolling_aggregates_and_convolution(spark):
    y = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0]
    d = frame(spark, {"a": y, "b": [2.0]})
    out = windows.rolling_apply_numpy(windows.rolling_apply(d, 3, "spread", lambda x: F.array_max(x) - F.array_min(x)), 3, "median", lambda m: np.median(m, axis=1))
    rows = out.orderBy("series_id", "ts").collect()
    assert [r["spread"] for r in rows] == [None, None, 3.0, 3.0, 4.0, 8.0, None] and [r["median"] for r in rows] == [None, None, 3.0, 1.0, 4.0, 5.0, None]
    got = [r["convolved"] for r in windows.convolved(d, [0.5, 2.0, -1.0]).orderBy("ts").collect()]
    assert got == pytest.approx(np.convolve(y, [0.5, 2.0, -1.0], mode="valid").tolist())


@pytest.mark.parametrize("rows", [7, 10**6])
def test_recurrences_over_segments(spark, rows):
    rng = np.random.default_rng(10)
    series = {"a": 100 + np.cumsum(rng.standard_normal(90)), "b": rng.standard_normal(8), "c": np.array([3.0])}
    d = frame(spark, series)

    def found(run, names):
        out = recurrences.run_affine(d, run, 2, names, rows)
        return {s: out.where(f"series_id = '{s}'").orderBy("t").collect() for s in series}

    for s, got in found(recurrences.kalman(), ["position", "velocity"]).items():
        want = plain_filter(series[s])
        assert [r["position"] for r in got] == pytest.approx(want["position"].tolist()) and [r["velocity"] for r in got] == pytest.approx(want["velocity"].tolist())
        assert [r["ts"] for r in got] == [day(i) for i in range(len(series[s]))]
    for beta in (None, 0.3):
        for s, got in found(recurrences.smoothing(0.4, beta), ["fitted"]).items():
            y, level, slope, want = series[s], series[s][0], 0.0, [None]
            for v in y[1:]:
                ahead = level + slope
                new = 0.4 * v + 0.6 * ahead
                level, slope = new, beta * (new - level) + (1 - beta) * slope if beta else 0.0
                want.append(ahead)
            assert got[0]["fitted"] is None and [r["fitted"] for r in got[1:]] == pytest.approx(want[1:])
    assert recurrences.run_affine(d.limit(0), recurrences.kalman(), 2, ["p", "v"]).count() == 0


def test_streamed_filter_is_the_batch_filter(spark, tmp_path):
    rng = np.random.default_rng(8)
    y = {"a": rng.standard_normal(30), "b": 5 + rng.standard_normal(20)}
    schema, folder = "series_id string, ts timestamp, y double", tmp_path / "in"
    for part in range(3):  # three files, three batches
        rows = [(s, day(0) + dt.timedelta(minutes=i), float(v)) for s, v in y.items() for i, v in enumerate(y[s]) if i % 30 // 10 == part]
        if part == 2:
            rows.append(("a", day(0) + dt.timedelta(minutes=3), 99.0))  # behind what the filter has seen
        spark.createDataFrame(rows[::-1], schema).coalesce(1).write.mode("append").parquet(str(folder))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        q = streams.tracked(read).writeStream.outputMode("append").format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
    finally:
        spark.conf.set(key, before)
    for s, v in y.items():
        want = plain_filter(v)
        got = spark.table("tracked").where(f"series_id = '{s}'").orderBy("ts").collect()
        assert [r["position"] for r in got] == pytest.approx(want["position"].tolist()) and [r["velocity"] for r in got] == pytest.approx(want["velocity"].tolist())


def test_average_of_the_last_values():
    assert models.average(2)(np.array([1.0, 2.0, 4.0]), 2)[0].tolist() == [3.0, 3.0]


def test_selectors(spark):
    page = (
        '<html><body><nav class="top main"><ul><li><a href="/a?x=1&amp;y=2">A</a><li><a href=\'/b\' id=two>B</a></ul></nav><!-- <a href="/no"> --><div class="main"><p><a href=/c>C</a><img src="i.png"><br>'
        '<span><a href="http://x.org/d.pdf" rel="next">D</a></span></p></div><script>var s = \'<a href="/no2">\';</script><a name="none">E</a></body></html>'
    )
    d = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")

    def found(selector, attribute="href"):
        return [r["value"] for r in text.selected(d, selector, attribute).orderBy("place").collect()]

    assert found("a") == ["/a?x=1&y=2", "/b", "/c", "http://x.org/d.pdf"]
    assert found("nav li > a") == ["/a?x=1&y=2", "/b"] and found("nav > a") == [] and found(".main.top a[href]") == ["/a?x=1&y=2", "/b"]
    assert found("div.main p > a") == ["/c"] and found("div a") == ["/c", "http://x.org/d.pdf"] and found("#two") == ["/b"]
    assert found("a[href^=http]") == ["http://x.org/d.pdf"] and found('a[href$=".pdf"]') == ["http://x.org/d.pdf"] and found("a[rel='next'][href*=org]") == ["http://x.org/d.pdf"]
    assert found("div *", "src") == ["i.png"]
    with pytest.raises(ValueError, match="selector"):
        text.selected(d, "a:hover")


def test_kernel_trend(spark):
    y = np.array([3 + np.sin(i / 8) + 0.1 * (i % 3) for i in range(60)])
    d = frame(spark, {"a": y, "short": [1.0, 2.0]})
    at = np.arange(60) / 59
    w = np.exp(-(((at[:, None] - np.arange(5) / 4) / 0.2) ** 2) / 2)
    w /= w.sum(axis=1, keepdims=True)
    b = np.linalg.lstsq(w, y, rcond=None)[0]
    rows, levels = trend.kernel_trend(d, 5, 0.2)
    got = [r["trend"] for r in rows.where("series_id = 'a'").orderBy("ts").collect()]
    assert got == pytest.approx((w @ b).tolist(), abs=1e-6)
    found = {r["series_id"]: r for r in levels.collect()}
    rest = y - w @ b
    assert found["a"]["level"] == pytest.approx(b.tolist(), abs=1e-5) and found["a"]["sigma"] == pytest.approx(np.sqrt(rest @ rest / 55)) and found["short"]["level"] is None
    ahead = trend.kernel_forecast(levels, 12, draws=400).orderBy("h").collect()
    assert len(ahead) == 12 and all(r["lo"] < r["yhat"] < r["hi"] for r in ahead) and ahead[-1]["hi"] - ahead[-1]["lo"] > ahead[0]["hi"] - ahead[0]["lo"]


def test_smoothing_choice(spark):
    rng = np.random.default_rng(9)
    season = np.tile([0.0, 10.0, -5.0, 3.0], 20)
    series = {"season": season + 0.2 * rng.standard_normal(80), "trend": np.arange(80) * 2.0 + 0.5 * rng.standard_normal(80), "noise": rng.standard_normal(80), "short": np.arange(3.0)}
    got = {}
    for r in trend.smoothing_choice(frame(spark, series), 4, season=4).orderBy("h").collect():
        got.setdefault(r["series_id"], []).append(r)
    assert set(got) == {"season", "trend", "noise"}
    assert got["season"][0]["seasonal"] and [r["yhat"] for r in got["season"]] == pytest.approx([0.0, 10.0, -5.0, 3.0], abs=0.6)
    assert got["trend"][0]["trend"] != "none" and got["trend"][3]["yhat"] == pytest.approx(2 * 83, abs=3)
    assert got["noise"][0]["trend"] == "none" and not got["noise"][0]["seasonal"]
