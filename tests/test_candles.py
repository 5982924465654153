import numpy as np
import pytest

from tickloom.operators import candles

QUIET = [(100, 101, 99, 100.5)] * 12


def signals(spark, bars, pattern, **options):
    rows = [("X", i, *(None if v is None else float(v) for v in b)) for i, b in enumerate(bars)]
    frame = spark.createDataFrame(rows, "symbol string, ts int, open double, high double, low double, close double")
    return [r.signal for r in candles.candle_pattern(frame, pattern, **options).orderBy("ts").collect()]


@pytest.mark.parametrize(
    "pattern, bars, signal",
    [
        ("doji", [(100, 102, 98, 100.05)], 100),
        ("marubozu", [(100, 104.05, 99.95, 104)], 100),
        ("engulfing", [(101, 101.5, 99.5, 100), (99.5, 102, 99, 101.5)], 100),
        ("engulfing", [(100, 101.5, 99.5, 101), (101, 102, 99, 99.5)], -80),
        ("harami", [(104, 104.5, 99.5, 100), (101, 101.6, 100.9, 101.3)], 100),
        ("dragonfly_doji", [(100, 100.05, 96, 100)], 100),
        ("piercing", [(104, 104.5, 99.5, 100), (99, 103.5, 98.5, 103)], 100),
        ("three_outside", [(101, 101.5, 99.5, 100), (99.5, 102, 99, 101.5), (101.5, 103, 101, 102.5)], 100),
    ],
)
def test_textbook_bars(spark, pattern, bars, signal):
    assert signals(spark, QUIET + bars, pattern)[-1] == signal


def test_rows_before_the_lookback_are_zero(spark):
    assert signals(spark, [(100, 102, 98, 100)] * 10, "doji") == [0] * 10
    assert signals(spark, [(100, 102, 98, 100)] * 11, "doji")[-1] == 100


def test_missing_prices_delay_the_lookback(spark):
    bars = [(None, 102, 98, 100)] * 3 + [(100, 102, 98, 100)] * 11
    assert signals(spark, bars, "doji") == [0] * 13 + [100]


def test_penetration(spark):
    bars = QUIET + [(100, 104.5, 99.5, 104), (105, 105.5, 101, 102.5)]
    assert signals(spark, bars, "dark_cloud_cover", penetration=0.2)[-1] == -100
    assert signals(spark, bars, "dark_cloud_cover")[-1] == 0
    with pytest.raises(TypeError):
        signals(spark, bars, "doji", penetration=0.2)
    with pytest.raises(ValueError):
        signals(spark, bars, "dark_cloud_cover", penetration=-1)


def test_hikkake_confirms_once(spark):
    bars = QUIET + [(100, 110, 90, 100), (100, 108, 92, 100), (100, 107, 91, 100), (100, 112, 95, 109), (100, 115, 95, 114)]
    assert signals(spark, bars, "hikkake")[-3:] == [100, 200, 0]


def test_every_pattern_occurs_in_one_pass(spark):
    rng = np.random.default_rng(3)
    n = 20_000
    close = 100 + np.cumsum(rng.choice([-2, -1, 0, 0, 1, 2], n) * rng.choice([0.2, 1, 2], n))
    open_ = np.roll(close, 1) + rng.choice([0, 0, -0.5, 0.5, 1.5, -1.5], n)
    high = np.maximum(open_, close) + rng.choice([0, 0, 0.1, 1, 3], n)
    low = np.minimum(open_, close) - rng.choice([0, 0, 0.1, 1, 3], n)
    rows = [("X", i, float(a), float(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(open_, high, low, close))]
    frame = spark.createDataFrame(rows, "symbol string, ts int, open double, high double, low double, close double")
    found = {r.pattern for r in candles.candle_hits(frame).select("pattern").distinct().collect()}
    assert len(candles.NAMES) == 61 and len(found) >= 50
