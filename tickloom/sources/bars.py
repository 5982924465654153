"""Bars and return panels from trade-like records, and adapters for small in-memory inputs.

Each table has a DataFrame builder and, beside it, the same definition as SQL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

PANEL_ASSETS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlcv(records: DataFrame, symbol: Column, ts: Column, price: Column, volume: Column, order: Sequence[str]) -> DataFrame:
    """Bars of the records of each (symbol, ts); open and close by ``order``, a total order of the records.

    All five columns are aggregates with map-side combine: one exchange, whatever
    the number of records in a bar.
    """
    prepared = records.select(symbol.alias("symbol"), ts.alias("ts"), price.alias("_p"), volume.alias("_v"), F.struct(*order).alias("_k"))
    return prepared.groupBy("symbol", "ts").agg(
        F.min_by("_p", "_k").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_k").alias("close"), F.sum("_v").cast("double").alias("volume")
    )


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return ohlcv(items, F.col("l_returnflag"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


DAILY_SQL = """
SELECT l_returnflag AS symbol, l_shipdate AS ts,
       arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS open,
       max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
       arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS close,
       sum(l_quantity)::DOUBLE AS volume
FROM lineitem GROUP BY 1, 2
"""


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("_hour", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"))
    return ohlcv(events, F.col("event_type"), F.col("_hour"), F.col("value"), F.lit(1), ("ts", "event_id"))


HOURLY_SQL = """
SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
       arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
       count(*)::DOUBLE AS volume
FROM events GROUP BY 1, 2
"""


def _period_returns(items: DataFrame, period: Column, name: str) -> DataFrame:
    """Relative change of a supplier group's turnover from one period to the next, periods numbered from 1."""
    sums = items.groupBy(period.alias("_p"), (F.col("l_suppkey") % PANEL_ASSETS).cast("int").alias(name)).agg(F.sum("l_extendedprice").alias("_v"))
    w = Window.partitionBy(name).orderBy("_p")
    prev = F.lag("_v").over(w)
    out = sums.withColumns({"_i": F.row_number().over(w) - 1, "ret": F.col("_v") / prev - 1})
    return out.where("_i > 0")


def panel_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, asset, ret): 75 monthly returns of 8 assets."""
    items = table(spark, sf_dir, "lineitem").where("l_shipdate >= '1995-04-01' and l_shipdate < '2001-08-01'")
    out = _period_returns(items, F.date_format("l_shipdate", "yyyy-MM"), "asset")
    return out.select(F.col("_i").cast("int").alias("obs_id"), "asset", "ret")


PANEL_SQL = f"""
SELECT (i - 1)::INT AS obs_id, asset, v / prev - 1 AS ret FROM (
  SELECT asset, v, lag(v) OVER w AS prev, row_number() OVER w AS i FROM (
    SELECT strftime(l_shipdate, '%Y-%m') AS p, (l_suppkey % {PANEL_ASSETS})::INT AS asset, sum(l_extendedprice) AS v
    FROM lineitem WHERE l_shipdate >= '1995-04-01' AND l_shipdate < '2001-08-01' GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY asset ORDER BY p)) WHERE i > 1
"""


def trials_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, trial, ret): weekly returns of 8 trials."""
    out = _period_returns(table(spark, sf_dir, "lineitem"), F.date_trunc("week", "l_shipdate").cast("timestamp_ntz"), "trial")
    return out.select(F.col("_i").cast("int").alias("t"), "trial", "ret")


TRIALS_SQL = f"""
SELECT (i - 1)::INT AS t, trial, v / prev - 1 AS ret FROM (
  SELECT trial, v, lag(v) OVER w AS prev, row_number() OVER w AS i FROM (
    SELECT date_trunc('week', l_shipdate) AS p, (l_suppkey % {PANEL_ASSETS})::INT AS trial, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY trial ORDER BY p)) WHERE i > 1
"""


def equity_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(strategy, obs_id, equity): growth of 100 in each asset of the panel."""
    panel = panel_monthly(spark, sf_dir)
    w = Window.partitionBy("asset").orderBy("obs_id").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.aggregate(F.collect_list(1 + F.col("ret")).over(w), F.lit(100.0), lambda a, x: a * x)
    return panel.select(F.col("asset").alias("strategy"), "obs_id", grown.alias("equity"))


EQUITY_SQL = f"""
SELECT asset AS strategy, obs_id, 100 * product(1 + ret) OVER (PARTITION BY asset ORDER BY obs_id ROWS UNBOUNDED PRECEDING) AS equity
FROM ({PANEL_SQL})
"""


# ---- adapters -------------------------------------------------------------


def long_returns(frame: DataFrame, order: str) -> DataFrame:
    """(obs_id, asset, ret) from a wide table: every numeric column but ``order`` is an asset.

    ``obs_id`` is the rank of a row by ``order``, from 1, per asset over its
    non-null returns; ValueError if no column is numeric.
    """
    assets = [f.name for f in frame.schema.fields if isinstance(f.dataType, NumericType) and f.name != order]
    if not assets:
        raise ValueError("no numeric column")
    cast = frame.select(order, *[F.col(f"`{a}`").cast("double").alias(a) for a in assets])
    tall = cast.unpivot(order, assets, "asset", "ret").where("ret is not null and not isnan(ret)")
    return tall.select(F.row_number().over(Window.partitionBy("asset").orderBy(order)).alias("obs_id"), "asset", "ret")


def returns_from_mapping(spark: SparkSession, returns: Mapping[str, Sequence[float]]) -> DataFrame:
    """(obs_id, asset, ret) from {asset: returns}."""
    rows = [(k + 1, str(a), float(x)) for a, xs in returns.items() for k, x in enumerate(xs)]
    return spark.createDataFrame(rows, "obs_id int, asset string, ret double")


def tail_aligned(returns: DataFrame) -> DataFrame:
    """The last observations of every asset, as many as the shortest has, numbered from 1."""
    per_asset = Window.partitionBy("asset")
    back = F.row_number().over(per_asset.orderBy(F.desc("obs_id")))
    shortest = returns.groupBy("asset").agg(F.count("ret").alias("n")).agg(F.min("n").alias("_n"))
    numbered = returns.where("ret is not null").withColumn("_back", back).join(F.broadcast(shortest)).where("_back <= _n")
    return numbered.select((F.col("_n") - F.col("_back") + 1).cast("int").alias("obs_id"), "asset", "ret")
