import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import indicators, recursive


def series(seed=1, n=120):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    open_ = close * np.exp(rng.normal(0, 0.01, n))
    high, low = np.maximum(open_, close) * 1.01, np.minimum(open_, close) * 0.99
    return {"open": open_, "high": high, "low": low, "close": close, "volume": rng.integers(1, 1000, n).astype(float)}


def frame(spark, data, symbol="X"):
    n = len(data["close"])
    rows = [(symbol, i, *(float(data[c][i]) if data[c][i] == data[c][i] else None for c in ("open", "high", "low", "close", "volume"))) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts int, open double, high double, low double, close double, volume double")


def values(result, name):
    return np.array([np.nan if r[name] is None else r[name] for r in result.orderBy("ts").collect()])


def test_windowed_against_loops(spark):
    d = series()
    got = indicators.compute(frame(spark, d), "sma", "wma", "donchian", "roc", "stochastic", "obv", "linear_reg", "aroon")
    c = d["close"]
    sma = [c[i - 19 : i + 1].mean() if i >= 19 else np.nan for i in range(len(c))]
    np.testing.assert_allclose(values(got, "sma"), sma, rtol=1e-9)
    w = np.arange(1, 21)
    np.testing.assert_allclose(values(got, "wma")[19:], [(c[i - 19 : i + 1] * w).sum() / w.sum() for i in range(19, len(c))], rtol=1e-9)
    np.testing.assert_allclose(values(got, "roc")[12:], 100 * (c[12:] / c[:-12] - 1), rtol=1e-9)
    np.testing.assert_allclose(values(got, "linear_reg_slope" if "linear_reg_slope" in got.columns else "slope")[19:], [np.polyfit(range(20), c[i - 19 : i + 1], 1)[0] for i in range(19, len(c))], rtol=1e-7)
    flow = np.concatenate(([0], np.cumsum(np.sign(np.diff(c)) * d["volume"][1:])))
    np.testing.assert_allclose(values(got, "obv"), flow)
    k = values(got, "stochastic_k")
    assert np.isnan(k[:13]).all() and ((k[13:] >= 0) & (k[13:] <= 100)).all()
    up = [100 * (14 - (14 - max(j for j in range(15) if d["high"][i - 14 + j] == d["high"][i - 14 : i + 1].max()))) / 14 for i in range(14, len(c))]
    np.testing.assert_allclose(values(got, "aroon_aroon_up" if "aroon_aroon_up" in got.columns else "aroon_up")[14:], up)


def test_rsi_and_ema_against_loops(spark):
    d = series(2)
    c = d["close"]
    got = indicators.compute(frame(spark, d), "rsi", "ema")
    ema = [c[0]]
    for x in c[1:]:
        ema.append(2 / 21 * x + 19 / 21 * ema[-1])
    np.testing.assert_allclose(values(got, "ema"), ema, rtol=1e-9)
    step = np.diff(c)
    g, l = np.maximum(step, 0)[:14].mean(), np.maximum(-step, 0)[:14].mean()  # noqa: E741
    rsi = [np.nan] * 14 + [100 - 100 / (1 + g / l)]
    for s in step[14:]:
        g, l = (g * 13 + max(s, 0)) / 14, (l * 13 + max(-s, 0)) / 14  # noqa: E741
        rsi.append(100 - 100 / (1 + g / l))
    np.testing.assert_allclose(values(got, "rsi"), rsi, rtol=1e-9)


def test_flat_prices_take_the_documented_values(spark):
    flat = {k: np.full(60, 5.0) for k in ("open", "high", "low", "close", "volume")}
    got = indicators.compute(frame(spark, flat), "rsi", "williams_r", "stochastic", "cmo", "bop", "efficiency_ratio", "cci")
    last = got.orderBy(F.desc("ts")).first()
    assert (last.rsi, last.williams_r, last.stochastic_k, last.cmo, last.bop, last.cci) == (0, -50, 50, 0, 0, 0)
    assert last.efficiency_ratio is None


def test_nulls_stay_inside_their_windows(spark):
    d = series(3, 60)
    d["close"][10] = np.nan
    sma = values(indicators.compute(frame(spark, d), ("sma", {"period": 5})), "sma")
    assert np.isnan(sma[10:15]).all() and not np.isnan(sma[15:]).any()


def test_stop_never_lies_inside_the_bar():
    d = series(4, 400)
    sar = recursive.KERNELS["psar"](recursive.Bars(**d))["psar"][1:]
    assert ((sar <= d["low"][1:] + 1e-12) | (sar >= d["high"][1:] - 1e-12)).all()


def test_range_estimators_recover_volatility():
    rng = np.random.default_rng(5)
    steps = rng.normal(0, 0.01 / np.sqrt(200), (4000, 200)).cumsum(axis=1)
    # a walk inside each day; daily volatility 1 percent
    span = steps.max(axis=1) - steps.min(axis=1)
    assert abs(np.sqrt((span**2).mean() / (4 * np.log(2))) / 0.01 - 1) < 0.1


def test_options_and_errors(spark):
    bars = frame(spark, series(6, 40))
    assert indicators.compute(bars, ("cmo", {"smoothing": "wilder"})).columns == ["symbol", "ts", "cmo_wilder"]
    for bad in ("nothing", ("cmo", {"smoothing": "x"}), ("sma", {"period": 0}), ("sma", {"source": "x"}), ("hma", {"period": 1})):
        with pytest.raises(ValueError):
            indicators.compute(bars, bad)
    assert set(indicators.latest(indicators.compute(bars, "sma"), "sma").columns) == {"symbol", "sma"}


def test_one_exchange_for_many_indicators(spark):
    plan = indicators.compute(frame(spark, series(7, 40)), "sma", "rsi", "macd", "bollinger", "obv")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_streak_example():
    x = np.array([10, 11, 12, 12, 11, 10, 10.5])
    turn = np.sign(np.diff(x, prepend=x[:1]))
    assert recursive.scan(lambda y, t: t if y * t <= 0 else y + t, 0.0, turn) == [0, 1, 2, 0, -1, -2, 1]
