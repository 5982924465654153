"""Panels, covariances, risk, allocation, attribution, cross-validation and certification queries."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import allocation, certification, covariance, estimators, indicators, panel, portfolio, risk, scenarios
from tickloom.plans import matrix_sql as mx
from tickloom.sources import bars
from tickloom.sources.bars import EQUITY_SQL, PANEL_SQL, TRIALS_SQL
from tickloom.streaming.bars import stream_bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _six(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


def _panel(f: Callable[[DataFrame], DataFrame], digits: int = 6) -> Query:
    return lambda spark, sf: _six(f(bars.panel_monthly(spark, sf)), digits)


# ---- sources

query("src_bars_daily", f"SELECT symbol, ts, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, volume FROM ({bars.DAILY_SQL})")(lambda s, d: _six(bars.bars_daily(s, d), 8))
query("src_bars_hourly", f"SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM ({bars.HOURLY_SQL})")(lambda s, d: _six(bars.bars_hourly(s, d)))
query("src_panel_monthly", f"SELECT obs_id, asset, round(ret, 6) AS ret FROM ({PANEL_SQL})")(lambda s, d: _six(bars.panel_monthly(s, d)))
query("src_trials_weekly", f"SELECT t, trial, round(ret, 6) AS ret FROM ({TRIALS_SQL})")(lambda s, d: _six(bars.trials_weekly(s, d)))
query("src_equity_monthly", f"SELECT strategy, obs_id, round(equity, 6) AS equity FROM ({EQUITY_SQL})")(lambda s, d: _six(bars.equity_monthly(s, d)))


@query("src_long_returns", f"SELECT (row_number() OVER (PARTITION BY asset ORDER BY obs_id))::INT AS obs_id, 'asset_' || asset AS asset, round(ret, 6) AS ret FROM ({PANEL_SQL})")
def long_returns(spark: SparkSession, sf: str) -> DataFrame:
    wide = bars.panel_monthly(spark, sf).groupBy("obs_id").pivot("asset", list(range(bars.PANEL_ASSETS))).agg(F.first("ret"))
    return _six(bars.long_returns(wide.select("obs_id", *[F.col(str(k)).alias(f"asset_{k}") for k in range(bars.PANEL_ASSETS)]), "obs_id"))


# ---- covariance

_P = f"p AS MATERIALIZED ({PANEL_SQL}), pairs AS (SELECT x.asset AS a, y.asset AS b, x.obs_id AS t, x.ret AS xa, y.ret AS xb FROM p x JOIN p y USING (obs_id))"
query("cov_sample", f"WITH {_P} SELECT a::VARCHAR AS i, b::VARCHAR AS j, round(covar_samp(xa, xb) * 252, 6) AS value FROM pairs GROUP BY a, b")(_panel(covariance.sample_cov))
query(
    "cov_ewma",
    f"""WITH {_P}, m AS (SELECT asset, avg(ret) AS m FROM p GROUP BY asset), n AS (SELECT max(obs_id) AS n FROM p)
SELECT a::VARCHAR AS i, b::VARCHAR AS j, round(252 * sum({math.log(2) / 60!r} * pow({1 - math.log(2) / 60!r}, n - t) * (xa - ma.m) * (xb - mb.m)), 6) AS value
FROM pairs JOIN m ma ON ma.asset = a JOIN m mb ON mb.asset = b, n GROUP BY a, b""",
)(_panel(covariance.ewma_cov))
query(
    "cov_gerber",
    f"""WITH {_P}, d AS (SELECT asset, stddev_samp(ret) AS d FROM p GROUP BY asset),
s AS (SELECT a, b, da.d AS da, db.d AS db, CASE WHEN xa > da.d / 2 THEN 1 WHEN xa < -da.d / 2 THEN -1 ELSE 0 END * CASE WHEN xb > db.d / 2 THEN 1 WHEN xb < -db.d / 2 THEN -1 ELSE 0 END AS k
      FROM pairs JOIN d da ON da.asset = a JOIN d db ON db.asset = b)
SELECT a::VARCHAR AS i, b::VARCHAR AS j, round(252 * any_value(da * db) * CASE WHEN a = b THEN 1.0 WHEN sum(abs(k)) > 0 THEN sum(k)::DOUBLE / sum(abs(k)) ELSE 0 END, 6) AS value FROM s GROUP BY a, b""",
)(_panel(covariance.gerber_cov))
query(
    "cov_ledoit_wolf",
    f"""WITH {_P}, m AS (SELECT asset, avg(ret) AS m FROM p GROUP BY asset),
c AS (SELECT a, b, count(*) AS t, covar_samp(xa, xb) AS s, avg((xa - ma.m) * (xb - mb.m)) AS s2, sum(pow((xa - ma.m) * (xb - mb.m), 2)) AS q FROM pairs JOIN m ma ON ma.asset = a JOIN m mb ON mb.asset = b GROUP BY a, b),
v AS (SELECT a, sqrt(s) AS sd FROM c WHERE a = b), r AS (SELECT (sum(s / (va.sd * vb.sd + 1e-15)) - 8) / 56 AS rho FROM c JOIN v va ON va.a = c.a JOIN v vb ON vb.a = c.b),
f AS (SELECT c.*, CASE WHEN c.a = c.b THEN s ELSE rho * va.sd * vb.sd END AS f FROM c JOIN v va ON va.a = c.a JOIN v vb ON vb.a = c.b, r),
k AS (SELECT sum(pow(s - f, 2)) / 8 AS d2, sum(q - t * s2 * s2) / 8 / pow(any_value(t), 2) AS b2 FROM f),
w AS (SELECT greatest(0, least(1, least(b2, d2) / greatest(d2, 1e-15))) AS w FROM k)
SELECT a::VARCHAR AS i, b::VARCHAR AS j, round(252 * (w * f + (1 - w) * s), 6) AS value, round(w, 6) AS shrinkage FROM f, w""",
)(_panel(covariance.ledoit_wolf))
_CELLS = "SELECT (i - 1)::VARCHAR AS i, (j - 1)::VARCHAR AS j, round({v}, 6) AS value FROM (SELECT *, unnest(range(1, 9)) AS i FROM {t}), range(1, 9) AS cells(j)"
_LIT = f"list_transform({mx.EACH}, lambda i: list_transform({mx.EACH}, lambda j: {{}}))"
query(  # eigenvalues l / (1 - n/t + n/t l / mean) are those of c (1 - n/t + n/t c / mean)^-1
    "cov_oracle_approximating",
    f"""WITH RECURSIVE {mx.MOMENTS}, given AS (SELECT 0 AS id, c, {_LIT.format(f"CASE WHEN i = j THEN 1 - 8.0 / t ELSE 0 END + 8.0 / t * c[i][j] / ({mx.trace('c')} / 8)")} AS below FROM moments), {mx.inverse('given', 'below')},
result AS (SELECT {mx.times('c', 'x')} AS f FROM given, inverted) {_CELLS.format(v='f[i][j]', t='result')}""",
)(_panel(covariance.oracle_approximating))
query(  # the projector on the band is half of one plus the sign of (r - low)(high - r)
    "cov_denoise_mp",
    f"""WITH RECURSIVE {mx.MOMENTS}, edges AS (SELECT *, pow(1 - sqrt(8.0 / t), 2) AS low, pow(1 + sqrt(8.0 / t), 2) AS high, {mx.times('r', 'r')} AS rr FROM moments),
given AS MATERIALIZED (SELECT *, {_LIT.format("(low + high) * r[i][j] - rr[i][j] - CASE WHEN i = j THEN low * high ELSE 0 END")} AS band FROM edges), {mx.sign('given', 'band')},
projected AS (SELECT c, r, {_LIT.format("((i = j)::INT + x[i][j]) / 2")} AS proj FROM given, signs),
result AS (SELECT *, {mx.times('r', 'proj')} AS noise, {mx.trace(mx.times('r', 'proj'))} / {mx.trace('proj')} AS mean FROM projected)
{_CELLS.format(v='(r[i][j] - noise[i][j] + mean * proj[i][j]) * sqrt(c[i][i] * c[j][j])', t='result')}""",
)(_panel(covariance.denoise_mp))
query(
    "cov_detone",
    f"""WITH RECURSIVE {mx.MOMENTS}, {mx.leading('moments', 'r', 1)}, result AS (SELECT c, {mx.mix('1', 'r', '-value', 'projector')} AS rest FROM moments, leads)
{_CELLS.format(v='rest[i][j] / sqrt(rest[i][i] * rest[j][j]) * sqrt(c[i][i] * c[j][j])', t='result')}""",
)(_panel(covariance.detone_cov))
query(  # what the leading projectors keep, and the diagonal of what is left
    "cov_factor_model",
    f"""WITH RECURSIVE {mx.MOMENTS}, {mx.leading('moments', 'c', 5)}, kept AS (SELECT i, j, sum(value * projector[i][j]) AS v FROM leads, range(1, 9) AS a(i), range(1, 9) AS b(j) GROUP BY i, j)
SELECT (i - 1)::VARCHAR AS i, (j - 1)::VARCHAR AS j, round(CASE WHEN i = j THEN c[i][j] ELSE v END, 6) AS value FROM kept, moments""",
)(_panel(covariance.factor_model_cov))

# ---- risk measures

query(
    "risk_all",
    f"""WITH p AS ({PANEL_SQL}),
w AS (SELECT asset, obs_id, ret AS r, product(1 + ret) OVER (PARTITION BY asset ORDER BY obs_id ROWS UNBOUNDED PRECEDING) AS wealth FROM p),
d AS (SELECT asset, r, 1 - wealth / max(wealth) OVER (PARTITION BY asset ORDER BY obs_id ROWS UNBOUNDED PRECEDING) AS dd FROM w),
q AS (SELECT *, avg(r) OVER o AS m, row_number() OVER (PARTITION BY asset ORDER BY r) AS k, count(*) OVER o AS n, quantile_cont(r, 0.05) OVER o AS q, quantile_cont(dd, 0.95) OVER o AS dq FROM d WINDOW o AS (PARTITION BY asset))
SELECT asset AS strategy, round(var_samp(r), 6) AS variance, round(stddev_samp(r), 6) AS std, round(avg(pow(least(r - m, 0), 2)), 6) AS semi_variance, round(avg(abs(r - m)), 6) AS mad,
  round(avg(greatest(-r, 0)), 6) AS flpm, round(2 * sum((2 * k - n - 1) * r) / any_value(n) / any_value(n), 6) AS gini_md, round(-any_value(q), 6) AS var, round(-avg(r) FILTER (WHERE r <= q), 6) AS cvar,
  round(-min(r), 6) AS worst, round(ln(avg(exp(-r))), 6) AS entropic, round(max(dd), 6) AS mdd, round(avg(dd), 6) AS avg_drawdown, round(any_value(dq), 6) AS dar, round(avg(dd) FILTER (WHERE dd >= dq), 6) AS cdar, round(sqrt(avg(dd * dd)), 6) AS ulcer
FROM q GROUP BY asset""",
)(lambda s, d: _six(risk.all_risk_measures(bars.panel_monthly(s, d).withColumnRenamed("asset", "strategy"), measures=[*risk.PLAIN, *risk.PATH])))
_TAIL = "exp({x}) * (top / exp({x}) + ln(list_avg(list_transform(losses, lambda l: exp((l - top) / exp({x}))))) - ln(0.05))"
query(  # thirds of the interval of ln z instead of golden sections
    "risk_entropic_tails",
    f"""WITH RECURSIVE p AS MATERIALIZED ({PANEL_SQL}),
w AS (SELECT asset, obs_id, ret AS r, product(1 + ret) OVER (PARTITION BY asset ORDER BY obs_id ROWS UNBOUNDED PRECEDING) AS wealth FROM p),
d AS (SELECT asset, r, 1 - wealth / max(wealth) OVER (PARTITION BY asset ORDER BY obs_id ROWS UNBOUNDED PRECEDING) AS dd FROM w),
losses AS MATERIALIZED (SELECT asset, 'evar' AS kind, list(-r) AS losses, max(-r) AS top FROM d GROUP BY asset UNION ALL SELECT asset, 'edar', list(dd), max(dd) FROM d GROUP BY asset),
steps AS (
  SELECT *, 0 AS k, -20.0::DOUBLE AS lo, 20.0::DOUBLE AS hi FROM losses
  UNION ALL SELECT asset, kind, losses, top, k + 1, CASE WHEN fa < fb THEN lo ELSE lo + (hi - lo) / 3 END, CASE WHEN fa < fb THEN hi - (hi - lo) / 3 ELSE hi END
  FROM (SELECT *, {_TAIL.format(x='(lo + (hi - lo) / 3)')} AS fa, {_TAIL.format(x='(hi - (hi - lo) / 3)')} AS fb FROM steps WHERE k < 70)),
found AS (SELECT asset, max({_TAIL.format(x='lo')}) FILTER (WHERE kind = 'evar') AS evar, max({_TAIL.format(x='lo')}) FILTER (WHERE kind = 'edar') AS edar FROM steps WHERE k = 70 GROUP BY asset),
q AS (SELECT *, quantile_cont(r, 0.05) OVER (PARTITION BY asset) AS q, quantile_cont(dd, 0.95) OVER (PARTITION BY asset) AS dq FROM d)
SELECT asset AS strategy, round(-avg(r) FILTER (WHERE r <= q), 6) AS cvar, round(any_value(evar), 6) AS evar, round(-min(r), 6) AS worst, round(avg(dd) FILTER (WHERE dd >= dq), 6) AS cdar, round(any_value(edar), 6) AS edar, round(max(dd), 6) AS mdd
FROM q JOIN found USING (asset) GROUP BY asset""",
)(lambda s, d: _six(risk.all_risk_measures(bars.panel_monthly(s, d).withColumnRenamed("asset", "strategy"), measures=["cvar", "evar", "worst", "cdar", "edar", "mdd"])))


@query("risk_monte_carlo_var")
def monte_carlo(spark: SparkSession, sf: str) -> DataFrame:
    """Normal paths of an equal-weight book with the panel's moments."""
    m = panel.moments(bars.panel_monthly(spark, sf))
    return _six(risk.monte_carlo_var(spark, [1 / len(m.ids)] * len(m.ids), m.mean, m.cov))


query("risk_mean_risk_cvar")(_panel(lambda p: risk.mean_risk_optimize(p, risk_measure="cvar")))

# ---- allocation

query("alloc_equal_weight", f"WITH a AS (SELECT DISTINCT asset FROM ({PANEL_SQL})) SELECT asset::VARCHAR AS asset, round(1.0 / count(*) OVER (), 6) AS weight, 'equal_weight' AS method FROM a")(_panel(allocation.equal_weight))
_LOSS = f"list_transform({mx.EACH}, lambda x: -mu[x])"
_DISTANCE = f"list_transform({mx.EACH}, lambda i: list_transform({mx.EACH}, lambda j: sqrt(greatest(0.5 * (1 - r[i][j]), 0))))"
_SDS = f"list_transform({mx.EACH}, lambda x: sqrt(c[x][x]))"


def _inverse_risk(a: int, b: int) -> str:
    """Volatility of the inverse-variance portfolio of the leaves from place a to b."""
    own = f"list_slice(leaf_order, {a}, {b})"
    return f"sqrt(list_sum(flatten(list_transform({own}, lambda i: list_transform({own}, lambda j: c[i][j] / c[i][i] / c[j][j])))) / pow(list_sum(list_transform({own}, lambda i: 1 / c[i][i])), 2))"


def _bisection(place: int) -> str:
    """Product of the shares of the three halves of eight leaves that hold a place."""
    shares, a, b = [], 1, 8
    while a < b:
        middle = (a + b) // 2
        left, right = _inverse_risk(a, middle), _inverse_risk(middle + 1, b)
        shares.append(f"({right} / ({left} + {right}))" if place <= middle else f"({left} / ({left} + {right}))")
        a, b = (a, middle) if place <= middle else (middle + 1, b)
    return " * ".join(shares)


# coordinate descent on half x'cx - sum(ln x) / n, whose optimum is proportional to the weights
_PARITY = f"""parity_steps AS (
  SELECT 0 AS k, c, list_transform({mx.EACH}, lambda x: 1 / sqrt(c[x][x])) AS x FROM moments
  UNION ALL SELECT k + 1, c, list_transform({mx.EACH}, lambda y: CASE WHEN y = i THEN (-other + sqrt(other * other + 4 * c[i][i] / 8)) / (2 * c[i][i]) ELSE x[y] END)
  FROM (SELECT *, list_dot_product(c[i], x) - c[i][i] * x[i] AS other FROM (SELECT *, k % 8 + 1 AS i FROM parity_steps WHERE k < 1600))),
parity AS (SELECT c, mu, list_transform({mx.EACH}, lambda y: x[y] / list_sum(x)) AS w FROM (SELECT s.x, m.c, m.mu FROM parity_steps s, moments m WHERE k = 1600))"""


def _hierarchical(digits: int = 4) -> str:
    return f"""WITH RECURSIVE {mx.MOMENTS}, {mx.single_linkage(_DISTANCE)}, shared AS (SELECT c, mu, leaf_order, [{', '.join(map(_bisection, range(1, 9)))}] AS s FROM moments, leaves),
result AS (SELECT c, mu, list_transform({mx.EACH}, lambda x: s[list_position(leaf_order, x)]) AS w FROM shared) {mx.spread_weights('result', 'hierarchical_risk_parity', digits)}"""


#: Places from and to of the two sides of each split of eight leaves.
_SPLITS = [(1, 4, 5, 8), (1, 2, 3, 4), (5, 6, 7, 8), (1, 1, 2, 2), (3, 3, 4, 4), (5, 5, 6, 6), (7, 7, 8, 8)]
_SPLIT_ROWS = ", ".join(f"({k}, {s}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for k, (w, x, y, z) in enumerate(_SPLITS) for s, a, b in ((0, (w, x), (y, z)), (1, (y, z), (w, x))))
_SCHUR = f"""WITH RECURSIVE {mx.MOMENTS}, {mx.single_linkage(_DISTANCE)}, sides AS (SELECT 2 * k + s AS id, k, s, list_slice(leaf_order, a, b) AS own, list_slice(leaf_order, x, y) AS other, c FROM (VALUES {_SPLIT_ROWS}) AS v(k, s, a, b, x, y), leaves, moments),
given AS MATERIALIZED (SELECT *, {mx.sub('c', 'other')} AS m FROM sides), {mx.inverse('given', 'm', n='range(1, len(m) + 1)')},
cut AS (SELECT id, k, s, own, list_transform(own, lambda i: list_transform(own, lambda j: c[i][j] - 0.5 * list_sum(list_transform(range(1, len(other) + 1), lambda p: c[i][other[p]] * list_dot_product(x[p], list_transform(other, lambda o: c[o][j])))))) AS block FROM given JOIN inverted USING (id)),
risks AS (SELECT k, s, own, sqrt({mx.inverse_variance('block', 'range(1, len(own) + 1)')}) AS risk FROM cut),
shares AS (SELECT a.own, b.risk / (a.risk + b.risk) AS share FROM risks a JOIN risks b ON a.k = b.k AND a.s <> b.s),
result AS (SELECT (SELECT list(w ORDER BY i) FROM (SELECT i, product(share) AS w FROM shares, range(1, 9) AS r(i) WHERE list_contains(own, i) GROUP BY i)) AS w, c, mu FROM moments)
{mx.spread_weights('result', 'schur_complementary_allocation')}"""


def _clustered(method: str, inner: str, outer: str, digits: int = 4) -> str:
    """Weights inside Ward clusters times those of the clusters.  ``inner``: tables up to parts (id, own, v); ``outer``: tables up to heads (id, share) from the reduced covariances."""
    distance = _DISTANCE
    return f"""WITH RECURSIVE {mx.MOMENTS}, {mx.ward_linkage(distance)}, clusters AS MATERIALIZED (SELECT unnest(range(1, len(clusters) + 1)) AS id, unnest(clusters) AS own, len(clusters) AS n FROM ward),
{inner},
full_parts AS (SELECT id, n, list_transform({mx.EACH}, lambda i: coalesce(v[list_position(own, i)], 0)) AS v FROM parts),
reduced AS MATERIALIZED (SELECT 0 AS id, list(row ORDER BY i) AS m FROM (SELECT a.id AS i, list(list_dot_product(a.v, {mx.on('c', 'b.v')}) ORDER BY b.id) AS row FROM full_parts a, full_parts b, moments GROUP BY a.id)),
{outer},
result AS (SELECT c, mu, n, list_transform(w, lambda x: x / list_sum(w)) AS w FROM (SELECT any_value(n) AS n, (SELECT list(w ORDER BY i) FROM (SELECT i, sum(v[i] * share) AS w FROM full_parts JOIN heads USING (id), range(1, 9) AS r(i) GROUP BY i)) AS w FROM full_parts), moments)
{mx.spread_weights('result', method, digits, more=', n::DOUBLE AS clusters')}"""


def _herc(digits: int = 4) -> str:
    inner = "parts AS (SELECT id, n, own, list_transform(own, lambda i: (1 / c[i][i]) / list_sum(list_transform(own, lambda j: 1 / c[j][j]))) AS v FROM clusters, moments)"
    left, right = (mx.inverse_variance("m", f"range({a}, {b})") for a, b in (("lo", "lo + (hi - lo + 1) // 2"), ("lo + (hi - lo + 1) // 2", "hi + 1")))
    outer = f"""halves AS (
  SELECT 1::BIGINT AS lo, len(m) AS hi, 1.0::DOUBLE AS share, m FROM reduced
  UNION ALL SELECT CASE WHEN side = 0 THEN lo ELSE lo + (hi - lo + 1) // 2 END, CASE WHEN side = 0 THEN lo + (hi - lo + 1) // 2 - 1 ELSE hi END, share * CASE WHEN side = 0 THEN r / (l + r) ELSE l / (l + r) END, m
  FROM (SELECT *, {left} AS l, {right} AS r, unnest([0, 1]) AS side FROM halves WHERE hi > lo)),
heads AS (SELECT lo AS id, share FROM halves WHERE lo = hi)"""
    return _clustered("hierarchical_equal_risk_contribution", inner, outer, digits)


def _nested(digits: int = 4) -> str:
    inner = f"""blocks AS MATERIALIZED (SELECT id, n, own, {mx.sub('c', 'own')} AS m FROM clusters, moments), {mx.inverse('blocks', 'm', name='within', n='range(1, len(m) + 1)')},
parts AS (SELECT id, n, own, list_transform(x, lambda row: list_sum(row) / list_sum(flatten(x))) AS v FROM blocks JOIN within USING (id))"""
    outer = f"{mx.inverse('reduced', 'm', name='across', n='range(1, len(m) + 1)')}, heads AS (SELECT unnest(range(1, len(x) + 1)) AS id, unnest(list_transform(x, lambda row: list_sum(row) / list_sum(flatten(x)))) AS share FROM across)"
    return _clustered("nested_clustered_optimization", inner, outer, digits)


_COUPLING = "list_avg(flatten(list_transform(list_slice(own, 1, k), lambda i: list_transform(list_slice(own, k + 1, len(own)), lambda j: abs(r[i][j])))))"
_QUANTUM = f"""WITH RECURSIVE {mx.MOMENTS}, cuts AS (
  SELECT list_reverse({mx.EACH}) AS own, 1.0::DOUBLE AS share, c, r FROM moments
  UNION ALL SELECT CASE WHEN side = 0 THEN a ELSE b END, share * CASE WHEN side = 0 THEN rb / (ra + rb) ELSE ra / (ra + rb) END, c, r
  FROM (SELECT *, sqrt({mx.inverse_variance('c', 'a')}) AS ra, sqrt({mx.inverse_variance('c', 'b')}) AS rb, unnest([0, 1]) AS side
    FROM (SELECT *, list_slice(own, 1, best.k) AS a, list_slice(own, best.k + 1, len(own)) AS b FROM (SELECT *, list_min(list_transform(range(1, len(own)), lambda k: {{'v': {_COUPLING}, 'k': k}})) AS best FROM cuts WHERE len(own) > 1)))),
result AS (SELECT (SELECT list(share ORDER BY own[1]) FROM cuts WHERE len(own) = 1) AS w, c, mu FROM moments)
{mx.spread_weights('result', 'quantum_inspired_hrp')}"""
_ALLOC_SQL = {
    "schur_complementary_allocation": _SCHUR,
    "hierarchical_equal_risk_contribution": _herc(),
    "nested_clustered_optimization": _nested(),
    "quantum_inspired_hrp": _QUANTUM,
    "mean_variance": mx.program("mean_variance"),
    "min_variance": mx.program("min_variance"),
    "max_sharpe": mx.best_ratio("max_sharpe", "mu"),
    "max_diversification": mx.best_ratio("max_diversification", _SDS, more=f", round(list_dot_product(w, {_SDS}) / sqrt(list_dot_product(w, {mx.on('c', 'w')})), 4) AS diversification_ratio"),
    "robust_mvo": mx.program("robust_mvo", q=_LOSS, b="0.1"),
    "mean_variance_cvx": mx.program("mean_variance_cvx", q=_LOSS, a="2"),
    "robust_mean_variance_cvx": mx.program("robust_mean_variance_cvx", q=_LOSS, a="2", b="1 / sqrt(t)"),
    "risk_parity": f"WITH RECURSIVE {mx.MOMENTS}, {_PARITY} {mx.spread_weights('parity', 'risk_parity')}",
    "hierarchical_risk_parity": _hierarchical(),
    "qubo_portfolio_selection": f"""WITH RECURSIVE {mx.MOMENTS}, masks AS (SELECT k, list_transform({mx.EACH}, lambda x: (k >> (x - 1) & 1)::DOUBLE) AS x FROM range(256) AS masks(k)),
costs AS (SELECT k, x, c, mu, 0.5 * list_dot_product(x, {mx.on('c', 'x')}) - list_dot_product(mu, x) + 10 * (pow(list_sum(x) - 5, 2) - 25) AS cost FROM masks, moments),
result AS (SELECT c, mu, cost, list_transform({mx.EACH}, lambda y: x[y] / list_sum(x)) AS w FROM costs ORDER BY cost, k LIMIT 1) {mx.spread_weights('result', 'qubo_portfolio_selection', more=', round(cost, 4) AS objective_value')}""",
}
for _name, _f in allocation.ALLOCATORS.items():
    if _name != "equal_weight":
        query(f"alloc_{_name}", _ALLOC_SQL.get(_name))(_panel(lambda p, f=_f: f(p), 4))
_HELD = {str(k): 1 / 8 for k in range(8)}
query(
    "alloc_min_tracking_error",
    mx.program("min_tracking_error", q=f"list_transform({mx.on('c', f'list_transform({mx.EACH}, lambda x: 0.125::DOUBLE)')}, lambda x: -x)", high="0.13", more=f", round(100 * sqrt(greatest(list_dot_product(list_transform({mx.EACH}, lambda x: w[x] - 0.125), {mx.on('c', f'list_transform({mx.EACH}, lambda x: w[x] - 0.125)')}), 0)), 4) AS tracking_error_pct"),
)(_panel(lambda p: allocation.min_tracking_error(p, _HELD, constraints=allocation.Constraints(max_weight=0.12 + 0.01)), 4))
query(
    "alloc_turnover_penalized", mx.program("turnover_penalized", q=_LOSS, t="0.001", held="0.125", more=f", round(list_sum(list_transform({mx.EACH}, lambda x: abs(w[x] - 0.125))), 4) AS turnover")
)(_panel(lambda p: allocation.turnover_penalized(p, _HELD), 4))
query(  # every subset of at most three assets is a program of its own
    "alloc_cardinality",
    f"""WITH RECURSIVE {mx.MOMENTS}, subsets AS (SELECT k AS id, list_transform({mx.EACH}, lambda x: k >> (x - 1) & 1) AS own FROM range(256) AS masks(k) WHERE bit_count(k) BETWEEN 1 AND 3),
given AS MATERIALIZED (SELECT id, c, {_LOSS} AS q, list_transform(own, lambda x: 0.01 * x) AS lo, list_transform(own, lambda x: x::DOUBLE) AS hi, list_transform(own, lambda x: 1e9::DOUBLE) AS held, 2.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS t, list_transform(own, lambda x: x::DOUBLE / list_sum(own)) AS w FROM subsets, moments),
{mx.descent('given')},
result AS (SELECT c, mu, w, len(list_filter(w, lambda x: x > 0)) AS n FROM (SELECT s.w, m.c, m.mu, list_dot_product(s.w, {mx.on('m.c', 's.w')}) - list_dot_product(m.mu, s.w) AS loss FROM solved s, moments m) ORDER BY loss LIMIT 1)
{mx.spread_weights('result', 'cardinality_constrained', more=', n::DOUBLE AS positions')}""",
)(_panel(lambda p: allocation.cardinality_constrained(p, max_assets=3), 4))


@query(
    "alloc_black_litterman",
    f"""WITH RECURSIVE {mx.MOMENTS}, given AS MATERIALIZED (SELECT 0 AS id, c, list_transform({mx.EACH}, lambda x: x / 36) AS market FROM moments), {mx.inverse('given', 'c')},
prior AS (SELECT c, x, market, list_transform({mx.on('c', 'market')}, lambda e: 2.5 * e) AS prior FROM given, inverted),
seen AS (SELECT *, list_transform({mx.EACH}, lambda k: prior[k] + 0.05 * c[k][2] / (0.05 * c[2][2] + (1 - 0.6) / 0.6 * 0.05 * c[2][2]) * (2.0 - prior[2])) AS posterior FROM prior),
raw AS (SELECT *, {mx.on('x', 'posterior')} AS y FROM seen),
result AS (SELECT *, list_transform(y, lambda e: e / list_sum(list_transform(y, lambda f: abs(f)))) AS w FROM raw)
{mx.spread_weights('result', 'black_litterman', means='posterior', more=', round(posterior[k], 4) AS posterior_return, round(w[k] - market[k], 4) AS tilt')}""",
)
def black_litterman(spark: SparkSession, sf: str) -> DataFrame:
    """The panel's covariances, capitalisations that grow with the asset, and one view."""
    m = panel.moments(bars.panel_monthly(spark, sf))
    caps = {str(a): float(a + 1) for a in m.ids}
    return _six(allocation.black_litterman(spark, caps, m.annual[1], {"1": 2.0}, {"1": 0.6}), 4)


@query(
    "alloc_alpha_risk_cost",
    f"""WITH RECURSIVE {mx.MOMENTS}, free AS (SELECT 0 AS id, {_LIT.format('2 * c[i][j]')} AS below FROM moments), {mx.inverse('free', 'below')},
given AS MATERIALIZED (SELECT 0 AS id, c, {_LOSS} AS q, list_transform({mx.EACH}, lambda x: 0.0::DOUBLE) AS lo, list_transform({mx.EACH}, lambda x: 1.0::DOUBLE) AS hi, list_transform({mx.EACH}, lambda x: 0.125::DOUBLE) AS held, 2.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.001::DOUBLE AS t, list_transform({mx.EACH}, lambda x: 0.125::DOUBLE) AS w FROM moments),
{mx.descent('given')},
result AS (SELECT m.c, m.mu, s.w, {mx.on('i.x', 'm.mu')} AS y FROM solved s, inverted i, moments m),
places AS (SELECT mu[k] AS alpha, w[k] * mu[k] AS held, y[k] * mu[k] AS open FROM result, range(1, 9) AS places(k)),
facts AS (SELECT corr(alpha, held) / greatest(abs(corr(alpha, open)), 1e-15) AS transfer FROM places)
SELECT asset, weight, method, NULL::DOUBLE AS return_pct, NULL::DOUBLE AS volatility_pct, NULL::DOUBLE AS sharpe, round(100 * alpha, 4) AS expected_alpha_pct, round(100 * risk, 4) AS expected_risk_pct, round(moved * 0.1, 4) AS expected_cost_pct,
  round(alpha / risk, 4) AS information_ratio, round(transfer, 4) AS transfer_coefficient
FROM ({mx.spread_weights('result', 'alpha_risk_cost', more=f", list_dot_product(mu, w) AS alpha, sqrt(list_dot_product(w, {mx.on('c', 'w')})) AS risk, list_sum(list_transform(w, lambda x: abs(x - 0.125))) AS moved")}), facts""",
)
def alpha_risk_cost(spark: SparkSession, sf: str) -> DataFrame:
    """The panel's mean returns as alphas, from equal weights."""
    m = panel.moments(bars.panel_monthly(spark, sf))
    mu, cov = m.annual
    alphas = {str(a): float(x) for a, x in zip(m.ids, mu)}
    return _six(allocation.alpha_risk_cost_optimize(spark, alphas, cov, current_weights=_HELD, risk_aversion=2.0), 4)


_ON = "list_dot_product({a}, list_transform(x, lambda row: list_dot_product(row, {b})))"
query(  # every support in closed form; the feasible one of least variance is the optimum
    "alloc_frontier",
    f"""WITH RECURSIVE {mx.MOMENTS}, given AS MATERIALIZED (SELECT k AS id, own, {mx.sub('c', 'own')} AS m, list_transform(own, lambda i: mu[i]) AS g, list_transform(own, lambda i: 1.0::DOUBLE) AS one
  FROM (SELECT k, list_filter({mx.EACH}, lambda i: (k >> (i - 1) & 1) = 1) AS own FROM range(1, 256) AS masks(k)), moments),
{mx.inverse('given', 'm', n='range(1, len(m) + 1)')},
s AS MATERIALIZED (SELECT id, x, g, one, {_ON.format(a='one', b='one')} AS a, {_ON.format(a='one', b='g')} AS b, {_ON.format(a='g', b='g')} AS d FROM given JOIN inverted USING (id)),
least AS (SELECT b / a AS low FROM s WHERE list_min(list_transform(x, lambda row: list_sum(row) / a)) > -1e-12 ORDER BY 1 / a LIMIT 1),
targets AS (SELECT k, low + k / 24.0 * 1.6 * (list_max(mu) - low) AS target FROM least, moments, range(25) AS points(k)),
tried AS (SELECT k, target, (a * target * target - 2 * b * target + d) / (a * d - b * b) AS variance,
    list_min(list_transform(x, lambda row: list_sum(row) * (d - b * target) / (a * d - b * b) + list_dot_product(row, g) * (a * target - b) / (a * d - b * b))) AS lowest FROM s, targets WHERE len(x) > 1),
best AS (SELECT k, target, min(variance) AS variance FROM tried WHERE lowest > -1e-12 GROUP BY ALL)
SELECT k::INT AS point, round(100 * target, 4) AS return_pct, round(100 * sqrt(variance), 4) AS volatility_pct, round(target / sqrt(variance), 4) AS sharpe FROM best""",
)(_panel(allocation.efficient_frontier, 4))
_BITS = f"list_sum(flatten(list_transform({mx.EACH}, lambda i: list_transform({mx.EACH}, lambda j: (k >> (i - 1) & 1) * (k >> (j - 1) & 1) * CASE WHEN i = j THEN -c[i][i] ELSE c[i][j] END))))"


@query("qubo_brute_force", f"WITH {mx.MOMENTS}, e AS (SELECT k, {_BITS} AS energy FROM range(256) AS r(k), moments), b AS (SELECT k FROM e ORDER BY energy, k LIMIT 1) SELECT i::INT AS i, (k >> i & 1)::INT AS x FROM b, range(8) AS v(i)")
def qubo_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The subset of assets of least sum of covariances less variances."""
    cov = panel.moments(bars.panel_monthly(spark, sf)).annual[1]
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(allocation.brute_force_qubo(spark, cov - 2 * np.diag(np.diag(cov))))], "i int, x int")


# ---- pre-selection

_SEL = f"WITH p AS ({PANEL_SQL}), s AS (SELECT asset, avg(ret) AS m, stddev_samp(ret) AS d, var_pop(ret) AS v, count(*) AS n FROM p GROUP BY asset)"
_OUT = "SELECT obs_id, asset, round(ret, 6) AS ret FROM p WHERE asset IN"
query("sel_zero_variance", f"{_SEL} {_OUT} (SELECT asset FROM s WHERE v > 1e-12)")(_panel(portfolio.drop_zero_variance))
query("sel_complete", f"{_SEL} {_OUT} (SELECT asset FROM s WHERE n >= (SELECT max(n) FROM s))")(_panel(portfolio.select_complete_assets))
query("sel_k_extremes", f"{_SEL} {_OUT} (SELECT asset FROM s ORDER BY m / d DESC, asset LIMIT 3)")(_panel(lambda p: portfolio.select_k_extremes(p, k=3)))
query("sel_non_dominated", f"{_SEL} {_OUT} (SELECT asset FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.m >= s.m AND o.d <= s.d AND (o.m > s.m OR o.d < s.d)))")(_panel(portfolio.select_non_dominated))
query(
    "sel_uncorrelated",
    f"""WITH RECURSIVE {mx.MOMENTS}, steps AS (
  SELECT {mx.EACH} AS live, r FROM moments
  UNION ALL SELECT list_filter(live, lambda x: x <> CASE WHEN list_sum(list_transform(live, lambda y: abs(r[i][y]))) >= list_sum(list_transform(live, lambda y: abs(r[j][y]))) THEN i ELSE j END), r
  FROM (SELECT *, -worst.i AS i, -worst.j AS j FROM (SELECT *, list_max(flatten(list_transform(live, lambda a: list_transform(list_filter(live, lambda x: x > a), lambda b: {{'v': abs(r[a][b]), 'i': -a, 'j': -b}})))) AS worst FROM steps WHERE len(live) > 1)) WHERE worst.v > 0.1),
kept AS (SELECT unnest(arg_min(live, len(live))) - 1 AS asset FROM steps)
SELECT obs_id, asset, round(ret, 6) AS ret FROM p WHERE asset IN (SELECT asset FROM kept)""",
)(_panel(lambda p: portfolio.drop_highly_correlated(p, threshold=0.1)))

# ---- costs

_COST = "SELECT o_orderkey, round({e}, 6) AS bps FROM orders"
_orders = lambda f: lambda s, d: bars.table(s, d, "orders").select("o_orderkey", F.round(f(F.col("o_totalprice"), F.lit(1e6), F.lit(0.02)), 6).alias("bps"))
query("cost_linear", _COST.format(e="o_totalprice / 1e6 * 1000"))(_orders(lambda n, a, v: portfolio.linear_impact(n, a)))
query("cost_sqrt", _COST.format(e="sqrt(o_totalprice / 1e6) * 0.02 * 1000"))(_orders(lambda n, a, v: portfolio.sqrt_impact(n, a, volatility=v)))
query("cost_almgren_chriss", _COST.format(e="pow(o_totalprice / 1e6, 0.6) * 0.02 * 3140 + 0.02 * 1420 * pow(0.1, 0.6)"))(_orders(lambda n, a, v: portfolio.almgren_chriss(n, a, v)["total_cost_bps"]))
query("cost_total", _COST.format(e="2.5 + sqrt(o_totalprice / 1e6) * 0.02 * 1000 + 1.0"))(_orders(lambda n, a, v: portfolio.total_cost(n, a, v, commission_bps=1.0)["total_cost_bps"]))
_BOOK = "SELECT o_orderpriority AS symbol, sum(o_totalprice) / sum(sum(o_totalprice)) OVER () AS weight FROM orders WHERE {c} GROUP BY 1"


def _book(spark: SparkSession, sf: str, test: str) -> DataFrame:
    held = bars.table(spark, sf, "orders").where(test).groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.sum("o_totalprice").alias("v"))
    return held.select("symbol", (F.col("v") / F.sum("v").over(Window.partitionBy())).alias("weight"))  # a handful of rows


@query("cost_turnover", f"WITH a AS ({_BOOK.format(c='o_orderkey % 2 = 0')}), b AS ({_BOOK.format(c='o_orderkey % 2 = 1')}), m AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, abs(coalesce(b.weight, 0) - coalesce(a.weight, 0)) AS t FROM a FULL JOIN b ON a.symbol = b.symbol) SELECT symbol, round(t, 6) AS turnover, round(2.5 + sqrt(t * 1e6 / 1e8) * 0.02 * 1000, 6) AS cost_bps, round(t * (2.5 + sqrt(t * 1e6 / 1e8) * 0.02 * 1000), 6) AS weighted_cost_bps FROM m")
def cost_turnover(spark: SparkSession, sf: str) -> DataFrame:
    after = _book(spark, sf, "o_orderkey % 2 = 1").withColumns({"adv": F.lit(1e8), "volatility": F.lit(0.02)})
    return _six(portfolio.turnover_analysis(_book(spark, sf, "o_orderkey % 2 = 0"), after))


@query(
    "cost_capacity",
    f"WITH h AS (SELECT symbol, weight, 1e8 * (1 + weight) AS adv FROM ({_BOOK.format(c='true')})), a AS (SELECT sum(weight * sqrt(weight / adv) * 0.02 * 1000) AS k, sum(weight) AS w, min(0.1 * adv / weight) AS cap, arg_min(symbol, 0.1 * adv / weight) AS sym FROM h), "
    "e AS (SELECT *, pow((500 - 12 * 2.5 * w) / (12 * k), 2) AS even FROM a) SELECT round(least(even, cap), 2) AS capacity_usd, round(even, 2) AS alpha_decay_capacity_usd, round(cap, 2) AS participation_capacity_usd, CASE WHEN even <= cap THEN 'alpha_decay' ELSE 'participation' END AS binding_constraint, CASE WHEN even > cap THEN sym END AS bottleneck_symbol, round(500 - 12 * (2.5 * w + k * sqrt(least(even, cap))), 2) AS net_alpha_bps_at_capacity FROM e",
)
def cost_capacity(spark: SparkSession, sf: str) -> DataFrame:
    held = _book(spark, sf, "true").withColumns({"adv_usd": 1e8 * (1 + F.col("weight")), "volatility": F.lit(0.02)})
    return _six(portfolio.alpha_decay_capacity(held, 500.0, 12.0), 2)


# ---- attribution and factors



@query(
    "attr_brinson",
    f"""WITH p AS MATERIALIZED (SELECT *, 'sector_' || asset % 3 AS sector FROM ({PANEL_SQL})), x AS (SELECT obs_id, sector, sum((asset + 1) / 36.0) AS w, sum((asset + 1) / 36.0 * ret) / sum((asset + 1) / 36.0) AS r, count(*) / 8.0 AS wb, avg(ret) AS rb FROM p GROUP BY ALL),
t AS (SELECT *, sum(wb * rb) OVER (PARTITION BY obs_id) AS whole FROM x),
e AS (SELECT obs_id, sector, (w - wb) * (rb - whole) * 100 AS allocation, wb * (r - rb) * 100 AS selection, (w - wb) * (r - rb) * 100 AS interaction FROM t)
SELECT obs_id, sector, round(sum(allocation), 6) AS allocation, round(sum(selection), 6) AS selection, round(sum(interaction), 6) AS interaction, round(sum(allocation + selection + interaction), 6) AS total FROM e GROUP BY GROUPING SETS ((obs_id, sector), (obs_id))""",
)
def brinson(spark: SparkSession, sf: str) -> DataFrame:
    """Every month: weights that grow with the asset against equal ones."""
    p = bars.panel_monthly(spark, sf)
    sectors = p.select("asset").distinct().withColumn("sector", F.concat(F.lit("sector_"), F.col("asset") % 3))
    return _six(portfolio.brinson_fachler(p.withColumn("weight", (F.col("asset") + 1) / 36), p.withColumn("weight", F.lit(0.125)), sectors, ["obs_id"]))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each asset's returns beside those of asset 0."""
    p = bars.panel_monthly(spark, sf)
    return p.where("asset > 0").withColumnRenamed("asset", "strategy").join(p.where("asset = 0").select("obs_id", F.col("ret").alias("bench")), "obs_id")


_PAIR = f"p AS MATERIALIZED ({PANEL_SQL}), x AS (SELECT a.asset AS strategy, a.obs_id, a.ret AS y, b.ret AS x FROM p a JOIN p b ON b.obs_id = a.obs_id AND b.asset = 0 WHERE a.asset > 0)"
query(
    "attr_alpha_beta",
    f"WITH {_PAIR}, r AS (SELECT strategy, regr_slope(y, x) AS b, regr_intercept(y, x) * 252 AS a, regr_r2(y, x) AS r2, stddev_samp(y - x) * sqrt(252) AS te FROM x GROUP BY strategy) SELECT strategy, round(a, 6) AS alpha, round(b, 6) AS beta, round(te, 6) AS tracking_error, round(a / te, 6) AS information_ratio, round(r2, 6) AS r_squared FROM r",
)(lambda s, d: _six(portfolio.alpha_beta(_pairs(s, d), ["strategy"])))
_w60 = "OVER (PARTITION BY strategy ORDER BY obs_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
query(
    "attr_rolling",
    f"WITH {_PAIR}, r AS (SELECT strategy, obs_id, count(*) {_w60} AS n, covar_samp(y, x) {_w60} / var_samp(x) {_w60} AS b, avg(x) {_w60} AS mx, avg(y) {_w60} AS my FROM x) SELECT strategy, obs_id, round((my - b * mx) * 252, 6) AS alpha, round(b, 6) AS beta FROM r WHERE n = 60",
)(lambda s, d: _six(portfolio.rolling_attribution(_pairs(s, d))))


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    p = bars.panel_monthly(spark, sf)
    return p.groupBy("obs_id").pivot("asset", [1, 2, 3]).agg(F.first("ret")).select("obs_id", F.col("1").alias("y"), F.col("2").alias("f1"), F.col("3").alias("f2"))


_WIDE = "x AS (SELECT a.obs_id, a.ret AS y, b.ret AS f1, c.ret AS f2 FROM p a JOIN p b ON b.obs_id = a.obs_id AND b.asset = 2 JOIN p c ON c.obs_id = a.obs_id AND c.asset = 3 WHERE a.asset = 1)"
query(  # two factors in closed form, from centred sums
    "attr_factor",
    f"""WITH p AS MATERIALIZED ({PANEL_SQL}), {_WIDE},
s AS (SELECT count(*) AS n, avg(y) AS my, avg(f1) AS m1, avg(f2) AS m2, var_pop(f1) * count(*) AS a, covar_pop(f1, f2) * count(*) AS b, var_pop(f2) * count(*) AS d, covar_pop(f1, y) * count(*) AS u, covar_pop(f2, y) * count(*) AS v, var_pop(y) * count(*) AS yy FROM x),
t AS (SELECT *, a * d - b * b AS det, (d * u - b * v) / (a * d - b * b) AS b1, (a * v - b * u) / (a * d - b * b) AS b2 FROM s),
e AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, yy - b1 * u - b2 * v AS rest FROM t),
o AS (SELECT 'alpha' AS term, b0 AS c, b0 / sqrt(rest / (n - 3) * (1.0 / n + (d * m1 * m1 - 2 * b * m1 * m2 + a * m2 * m2) / det)) AS t, b0 * 252 AS k, * FROM e
      UNION ALL SELECT 'f1', b1, b1 / sqrt(rest / (n - 3) * d / det), b1 * m1 * 252, * FROM e UNION ALL SELECT 'f2', b2, b2 / sqrt(rest / (n - 3) * a / det), b2 * m2 * 252, * FROM e)
SELECT term, round(c, 6) AS coefficient, round(t, 6) AS t_stat, round(k, 6) AS contribution, round(1 - rest / yy, 6) AS r_squared, round(b0 / sqrt(rest / (n - 1)) * sqrt(252), 6) AS appraisal_ratio, n AS observations FROM o""",
)(lambda s, d: _six(portfolio.factor_attribution(_wide(s, d), "y", ["f1", "f2"])))


@query(
    "attr_risk",
    f"""WITH {mx.MOMENTS}, g AS (SELECT c, c[1][1] * c[2][2] - c[1][2] * c[1][2] AS det FROM moments),
l AS (SELECT k, c, (c[k][1] * c[2][2] - c[k][2] * c[1][2]) / det AS l1, (c[k][2] * c[1][1] - c[k][1] * c[1][2]) / det AS l2, k / 36.0 AS w FROM g, range(1, 9) AS places(k)),
s AS (SELECT sum(w * l1) AS e1, sum(w * l2) AS e2, sum(w * w * greatest(c[k][k] - l1 * c[k][1] - l2 * c[k][2], 0)) AS specific, any_value(c) AS c FROM l),
t AS (SELECT *, e1 * e1 * c[1][1] + 2 * e1 * e2 * c[1][2] + e2 * e2 * c[2][2] AS factor FROM s)
SELECT part, round(v, 6) AS variance, round(v / (factor + specific), 6) AS share FROM (SELECT *, unnest(['asset_0', 'asset_1', 'factor', 'specific', 'total']) AS part, unnest([e1 * e1 * c[1][1], e2 * e2 * c[2][2], factor, specific, factor + specific]) AS v FROM t)""",
)
def risk_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The first two assets as factors of all: loadings by regression, weights that grow with the asset."""
    m = panel.moments(bars.panel_monthly(spark, sf))
    cov = m.annual[1]
    loadings = np.linalg.solve(cov[:2, :2], cov[:2]).T
    rest = np.maximum(np.diag(cov) - np.einsum("ik,ik->i", loadings, cov[:, :2]), 0)
    return _six(portfolio.risk_attribution(spark, {str(a): (a + 1) / 36 for a in m.ids}, loadings, cov[:2, :2], rest, ["asset_0", "asset_1"]))


query(
    "factor_exposure",
    f"WITH p AS ({PANEL_SQL}), w AS (SELECT DISTINCT asset, (asset + 1) / 36.0 AS weight FROM p) SELECT 'f' || obs_id AS factor, round(sum(weight * ret), 6) AS exposure FROM p JOIN w USING (asset) GROUP BY 1",
)(lambda s, d: _six(portfolio.factor_exposure(bars.panel_monthly(s, d).select("asset").distinct().withColumn("weight", (F.col("asset") + 1) / 36), bars.panel_monthly(s, d).select("asset", F.concat(F.lit("f"), "obs_id").alias("factor"), F.col("ret").alias("loading")))))
query("factor_statistical", f"WITH RECURSIVE {mx.MOMENTS}, {mx.leading('moments', 'c', 3)} SELECT nth::INT AS factor, round(value, 6) AS variance, round(value / {mx.trace('c')}, 6) AS explained_ratio FROM leads, moments")(_panel(lambda p: portfolio.statistical_factors(p, n_factors=3)[1]))
_DOT = "list_dot_product({}, {})"
query(  # exposures made orthogonal one after another (all but the market sum to zero), then solved backwards
    "factor_fundamental",
    f"""WITH p AS MATERIALIZED ({PANEL_SQL}), recent AS (SELECT asset, ret, row_number() OVER (PARTITION BY asset ORDER BY obs_id DESC) AS k FROM p),
raw AS (SELECT asset, -(asset / 2.0) AS size, (asset % 3 + 1) * 1e5 / (exp(asset / 2.0) * 1e6) AS value, (SELECT product(1 + ret) - 1 FROM recent r WHERE r.asset = a.asset AND k > 21 AND k <= 60) AS mom FROM (SELECT DISTINCT asset FROM p) a),
b AS (SELECT list(size - s ORDER BY asset) AS x2, list(value - v ORDER BY asset) AS x3, list(mom - m ORDER BY asset) AS x4 FROM raw, (SELECT avg(size) AS s, avg(value) AS v, avg(mom) AS m FROM raw)),
u AS (SELECT *, list_transform(range(1, 9), lambda i: x3[i] - {_DOT.format('x3', 'x2')} / {_DOT.format('x2', 'x2')} * x2[i]) AS u3 FROM b),
o AS (SELECT *, list_transform(range(1, 9), lambda i: x4[i] - {_DOT.format('x4', 'x2')} / {_DOT.format('x2', 'x2')} * x2[i] - {_DOT.format('x4', 'u3')} / {_DOT.format('u3', 'u3')} * u3[i]) AS u4 FROM u),
d AS (SELECT obs_id, list(ret ORDER BY asset) AS r FROM p GROUP BY obs_id),
f4 AS (SELECT *, {_DOT.format('u4', 'r')} / {_DOT.format('u4', 'u4')} AS f4 FROM d, o),
f3 AS (SELECT *, ({_DOT.format('u3', 'r')} - f4 * {_DOT.format('u3', 'x4')}) / {_DOT.format('u3', 'u3')} AS f3 FROM f4),
f AS (SELECT *, ({_DOT.format('x2', 'r')} - f3 * {_DOT.format('x2', 'x3')} - f4 * {_DOT.format('x2', 'x4')}) / {_DOT.format('x2', 'x2')} AS f2, list_avg(r) AS f1 FROM f3),
e AS (SELECT r[i] AS ret, f1 + f2 * x2[i] + f3 * x3[i] + f4 * x4[i] AS fit FROM f, range(1, 9) AS places(i)),
r2 AS (SELECT 1 - sum(pow(ret - fit, 2)) / (var_pop(ret) * count(*)) AS r_squared FROM e),
long AS (SELECT unnest(['market', 'size', 'value', 'momentum']) AS factor, unnest([f1, f2, f3, f4]) AS f FROM f)
SELECT factor, round(avg(f) * 252, 6) AS premium, round(avg(f) / stddev_samp(f) * sqrt(count(*)), 6) AS t_stat, round(any_value(r_squared), 6) AS r_squared FROM long, r2 GROUP BY factor""",
)(lambda s, d: _six(portfolio.fundamental_factors(bars.panel_monthly(s, d), bars.panel_monthly(s, d).select("asset").distinct().withColumns({"market_cap": F.exp(F.col("asset") / 2) * 1e6, "book_value": (F.col("asset") % 3 + 1) * 1e5}), momentum_window=60)))
_w60x = "OVER (ORDER BY obs_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
query(
    "factor_rolling",
    f"""WITH p AS MATERIALIZED ({PANEL_SQL}), {_WIDE}, s AS (SELECT obs_id, count(*) {_w60x} AS n, sum(f1 * f1) {_w60x} AS a, sum(f1 * f2) {_w60x} AS b, sum(f2 * f2) {_w60x} AS d, sum(f1 * y) {_w60x} AS u, sum(f2 * y) {_w60x} AS v FROM x)
SELECT 1::INT AS asset, obs_id, round((d * u - b * v) / (a * d - b * b), 6) AS beta_f1, round((a * v - b * u) / (a * d - b * b), 6) AS beta_f2 FROM s WHERE n = 60""",
)(lambda s, d: _six(portfolio.rolling_factor_exposure(_wide(s, d).withColumn("asset", F.lit(1)), "y", ["f1", "f2"])))

# ---- cross-validation

query(
    "cv_walk_forward",
    f"WITH p AS ({PANEL_SQL}), f AS (SELECT k AS fold, 15 + 12 * k AS lo, 15 + 12 * (k + 1) AS hi FROM range(5) AS r(k)) "
    "SELECT fold::INT AS fold, CASE WHEN obs_id - 1 < lo THEN 'train' ELSE 'test' END AS role, count(*) AS n, round(sum(ret), 6) AS total FROM p JOIN f ON obs_id - 1 < hi GROUP BY 1, 2",
)(lambda s, d: _six(portfolio.fold_rows(bars.panel_monthly(s, d), portfolio.WalkForward(5, test_size=12).folds(s, 75)).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("total"))))
query(
    "cv_combinatorial",
    f"""WITH p AS ({PANEL_SQL}), t AS (SELECT obs_id, ntile(5) OVER (ORDER BY obs_id) - 1 AS g FROM (SELECT DISTINCT obs_id FROM p)),
b AS (SELECT g, min(obs_id) - 1 AS lo, max(obs_id) AS hi FROM t GROUP BY g), f AS (SELECT row_number() OVER (ORDER BY x.g, y.g) - 1 AS fold, x.g AS g1, y.g AS g2 FROM b x JOIN b y ON x.g < y.g),
r AS (SELECT fold, obs_id, g IN (g1, g2) AS test, EXISTS (SELECT 1 FROM b WHERE g IN (g1, g2) AND obs_id - 1 >= lo - 2 AND obs_id - 1 < hi + 5) AS blocked FROM f, t)
SELECT fold::INT AS fold, CASE WHEN test THEN 'test' ELSE 'train' END AS role, count(*) AS n, round(sum(ret), 6) AS total FROM r JOIN p USING (obs_id) WHERE test OR NOT blocked GROUP BY 1, 2""",
)(lambda s, d: _six(portfolio.fold_rows(bars.panel_monthly(s, d), portfolio.CombinatorialPurgedCV(5, 2, 2, 5).folds(s, 75)).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("total"))))


def _inverse_volatility(wide) -> dict:
    w = 1 / wide.std(ddof=1)
    return (w / w.sum()).to_dict()


_CV = portfolio.CombinatorialPurgedCV(5, 2, 1, 1)
_OOS = f"""p AS MATERIALIZED ({PANEL_SQL}), t AS (SELECT obs_id, ntile(5) OVER (ORDER BY obs_id) - 1 AS g FROM (SELECT DISTINCT obs_id FROM p)),
b AS (SELECT g, min(obs_id) AS lo, max(obs_id) AS hi FROM t GROUP BY g), f AS (SELECT row_number() OVER (ORDER BY x.g, y.g) - 1 AS fold, x.g AS g1, y.g AS g2 FROM b x JOIN b y ON x.g < y.g),
near AS (SELECT DISTINCT fold, obs_id FROM f JOIN b ON g IN (g1, g2) JOIN t ON obs_id BETWEEN lo - 1 AND hi + 1),
v AS (SELECT fold, asset, 1 / stddev_samp(ret) AS v FROM f, p WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.fold = f.fold AND n.obs_id = p.obs_id) GROUP BY ALL),
w AS (SELECT fold, asset, v / sum(v) OVER (PARTITION BY fold) AS w FROM v),
oos AS (SELECT fold, obs_id, g AS grp, sum(ret * w) AS ret FROM f JOIN t ON g IN (g1, g2) JOIN p USING (obs_id) JOIN w USING (fold, asset) GROUP BY ALL),
paths AS (SELECT *, dense_rank() OVER (PARTITION BY grp ORDER BY fold) - 1 AS path FROM oos)"""
_PERF = "avg(ret) * 252 AS m, stddev_samp(ret) * sqrt(252) AS s"
query("cv_cross_validate", f"WITH {_OOS} SELECT fold::INT AS fold, obs_id, grp::INT AS grp, round(ret, 6) AS ret FROM oos")(lambda s, d: _six(portfolio.cross_validate(bars.panel_monthly(s, d), _inverse_volatility, _CV)))
query("cv_paths", f"WITH {_OOS} SELECT fold::INT AS fold, obs_id, grp::INT AS grp, round(ret, 6) AS ret, path::INT AS path FROM paths")(lambda s, d: _six(portfolio.reconstruct_paths(portfolio.cross_validate(bars.panel_monthly(s, d), _inverse_volatility, _CV))))
query(
    "cv_summary",
    f"""WITH {_OOS}, a AS (SELECT path, {_PERF} FROM paths GROUP BY path), z AS (SELECT fold, {_PERF} FROM oos GROUP BY fold)
SELECT round(avg(m / s), 6) AS oos_sharpe, round(avg(m), 6) AS oos_return_ann, round(avg(s), 6) AS oos_vol_ann, count(*) AS n_paths, (SELECT round(avg((m > 0)::INT), 6) FROM z) AS stability, (SELECT count(*) FROM z) AS n_splits FROM a""",
)(lambda s, d: _six(portfolio.cv_summary(portfolio.cross_validate(bars.panel_monthly(s, d), _inverse_volatility, _CV))))
query(
    "cv_grid_search",
    f"""WITH p AS MATERIALIZED ({PANEL_SQL}), g AS (SELECT trial, params, power, fold, 21 + 18 * fold AS cut FROM (VALUES (0, '{{''power'': 0.0}}', 0), (1, '{{''power'': 1.0}}', 1), (2, '{{''power'': 2.0}}', 2)) AS v(trial, params, power), range(3) AS folds(fold)),
v AS (SELECT trial, fold, asset, pow(stddev_samp(ret), -any_value(power)) AS v FROM g JOIN p ON obs_id <= cut GROUP BY ALL), w AS (SELECT trial, fold, asset, v / sum(v) OVER (PARTITION BY trial, fold) AS w FROM v),
oos AS (SELECT trial, params, fold, obs_id, sum(ret * w) AS ret FROM g JOIN p ON obs_id > cut AND obs_id <= cut + 18 JOIN w USING (trial, fold, asset) GROUP BY ALL)
SELECT trial::INT AS trial, params, round(avg(ret) * 252 / (stddev_samp(ret) * sqrt(252)), 6) AS score FROM oos GROUP BY trial, params""",
)(lambda s, d: _six(portfolio.grid_search(bars.panel_monthly(s, d), lambda power: lambda wide: (lambda w: (w / w.sum()).to_dict())(wide.std(ddof=1) ** -power), {"power": [0.0, 1.0, 2.0]}, portfolio.WalkForward(3))))

# ---- certification

_EQ = "e AS (SELECT a.strategy, a.obs_id, a.equity, b.equity AS bench FROM eq a JOIN eq b ON b.obs_id = a.obs_id AND b.strategy = 0 WHERE a.strategy > 0)"


def _equity(spark: SparkSession, sf: str) -> DataFrame:
    e = bars.equity_monthly(spark, sf)
    return e.where("strategy > 0").join(e.where("strategy = 0").select("obs_id", F.col("equity").alias("bench")), "obs_id")


_RET = f"""eq AS MATERIALIZED ({EQUITY_SQL}), {_EQ},
r AS (SELECT strategy, obs_id - 1 AS i, equity, bench, equity / lag(equity) OVER w - 1 AS ret, bench / lag(bench) OVER w - 1 AS bret, max(equity) OVER (PARTITION BY strategy ORDER BY obs_id ROWS UNBOUNDED PRECEDING) AS peak,
  max(bench) OVER (PARTITION BY strategy ORDER BY obs_id ROWS UNBOUNDED PRECEDING) AS bpeak FROM e WINDOW w AS (PARTITION BY strategy ORDER BY obs_id)),
u AS (SELECT *, max(CASE WHEN i > 0 AND equity = peak AND ret > 0 AND equity > pp THEN i END) OVER (PARTITION BY strategy ORDER BY i ROWS UNBOUNDED PRECEDING) AS fresh FROM (SELECT *, lag(peak) OVER (PARTITION BY strategy ORDER BY i) AS pp FROM r)),
q AS (SELECT *, avg(ret) OVER o AS mu, quantile_cont(ret, 0.05) OVER o AS q05, quantile_cont(ret, 0.01) OVER o AS q01 FROM u WINDOW o AS (PARTITION BY strategy))"""
query(
    "cert_analytics",
    f"""WITH {_RET},
a AS (SELECT strategy, count(ret) AS n, any_value(mu) AS mu, stddev_samp(ret) AS sd, arg_max(equity, i) / arg_min(equity, i) AS g, sqrt(avg(CASE WHEN ret < 0 THEN ret * ret WHEN ret IS NOT NULL THEN 0 END)) AS dn, min(equity / peak - 1) AS dd, sqrt(avg(pow(100 * (equity / peak - 1), 2))) AS ul,
  max(CASE WHEN fresh IS NULL THEN i + 1 ELSE i - fresh END) AS uw, any_value(q05) AS q05, avg(ret) FILTER (WHERE ret <= q05) AS c95, avg(ret) FILTER (WHERE ret <= q01) AS c99, quantile_cont(ret, 0.95) AS q95, avg(pow(ret - mu, 3)) AS m3, avg(pow(ret - mu, 4)) AS m4,
  covar_samp(ret, bret) AS cv, stddev_samp(bret) AS bsd, product(1 + ret) FILTER (WHERE bret > 0) AS su, product(1 + bret) FILTER (WHERE bret > 0) AS bu, product(1 + ret) FILTER (WHERE bret < 0) AS sn, product(1 + bret) FILTER (WHERE bret < 0) AS bn FROM q GROUP BY strategy),
t AS (SELECT strategy, arg_min(i, (bench / bpeak - 1, i)) AS ti FROM q GROUP BY strategy),
c AS (SELECT t.strategy, x.equity / y.equity - 1 AS cr, x.bench / y.bench - 1 AS cb FROM t JOIN q x ON x.strategy = t.strategy AND x.i = t.ti JOIN q y ON y.strategy = t.strategy AND y.bench = x.bpeak AND y.i <= x.i),
m AS (SELECT *, mu / sd AS sr, m3 / pow(sd, 3) AS sk, m4 / pow(sd, 4) AS ku, pow(g, 252.0 / n) - 1 AS gr FROM a),
l AS (SELECT *, CASE WHEN sr > 0 THEN (1 + (1 - sk * sr + (ku - 1) / 4 * sr * sr) * pow(1.645 / sr, 2)) / 252 END AS trl FROM m)
SELECT l.strategy, n AS observations, round(gr, 4) AS annualized_return, round(sd * sqrt(252), 4) AS annualized_vol, round(sr * sqrt(252), 3) AS sharpe, round(mu / dn * sqrt(252), 3) AS sortino, round(gr / abs(dd), 3) AS calmar, round(dd, 4) AS max_drawdown, round(ul, 3) AS ulcer_index,
  uw AS max_time_under_water_days, round(dn * sqrt(252), 4) AS downside_deviation, round(q05, 4) AS var95, round(c95, 4) AS cvar95, round(c99, 4) AS cvar99, round(abs(q95) / abs(q05), 3) AS tail_ratio, round(sk, 3) AS skew, round(ku - 3, 3) AS excess_kurtosis, round(trl, 2) AS min_trl_years, round(n / 252.0, 2) AS track_years, n / 252.0 >= trl AS significant,
  round(cv / (bsd * bsd), 3) AS beta, round(cv / (sd * bsd), 3) AS correlation, round((su - 1) / (bu - 1), 3) AS up_capture, round((sn - 1) / (bn - 1), 3) AS down_capture, round(cr, 4) AS crisis_return, round(cb, 4) AS crisis_benchmark_return
FROM l JOIN c ON c.strategy = l.strategy""",
)(lambda s, d: certification.risk_analytics(_equity(s, d), benchmark="bench"))
_vol = "OVER (PARTITION BY strategy ORDER BY i ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)"
query(
    "cert_regime",
    f"""WITH {_RET},
v AS (SELECT *, CASE WHEN ret IS NOT NULL AND count(ret) {_vol} >= 2 THEN stddev_samp(ret) {_vol} END AS rv, bench >= avg(bench) OVER (PARTITION BY strategy ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS bull FROM q),
g AS (SELECT *, quantile_cont(rv, 1.0 / 3) OVER (PARTITION BY strategy) AS q1, quantile_cont(rv, 2.0 / 3) OVER (PARTITION BY strategy) AS q2 FROM v),
k AS (SELECT strategy, 'volatility' AS kind, CASE WHEN rv <= q1 THEN 'calm' WHEN rv <= q2 THEN 'normal' ELSE 'stressed' END AS regime, ret FROM g WHERE rv IS NOT NULL UNION ALL SELECT strategy, 'trend', CASE WHEN bull THEN 'bull' ELSE 'bear' END, ret FROM g WHERE ret IS NOT NULL),
s AS (SELECT strategy, kind, regime, count(*) AS n, avg(ret) AS mu, coalesce(stddev_samp(ret), 0) AS sd, product(1 + ret) AS g, avg((ret > 0)::INT) AS hit FROM k GROUP BY ALL)
SELECT strategy, kind, regime, round(n / sum(n) OVER (PARTITION BY strategy, kind), 4) AS share_of_days, n AS n_days, round(pow(g, 252.0 / n) - 1, 4) AS annualized_return, round(sd * sqrt(252), 4) AS annualized_vol, round(CASE WHEN sd > 0 THEN mu / sd * sqrt(252) END, 3) AS sharpe, round(hit, 4) AS hit_rate FROM s""",
)(lambda s, d: certification.regime_performance(_equity(s, d), benchmark="bench"))
query(
    "cert_regime_summary",
    f"""WITH regimes AS ({SQL['cert_regime']}), v AS (SELECT *, CASE regime WHEN 'calm' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END AS o FROM regimes WHERE kind = 'volatility' AND sharpe IS NOT NULL)
SELECT strategy, arg_min(regime, (sharpe, o)) AS worst_vol_regime, min(sharpe) > 0 AS consistent_across_regimes FROM v GROUP BY strategy""",
)(lambda s, d: certification.regime_summary(certification.regime_performance(_equity(s, d))))
query(
    "cert_pbo",
    f"""WITH x AS ({TRIALS_SQL}), b AS (SELECT t, ntile(10) OVER (ORDER BY t) - 1 AS block FROM (SELECT DISTINCT t FROM x)),
c AS (SELECT m FROM range(1024) AS r(m) WHERE bit_count(m) = 5),
s AS (SELECT m, trial, (m >> block & 1)::INT AS inside, ret FROM x JOIN b USING (t), c),
a AS (SELECT m, trial, inside, avg(ret) / stddev_samp(ret) AS sr FROM s GROUP BY ALL),
p AS (SELECT m, trial, max(sr) FILTER (WHERE inside = 1) AS fit, max(sr) FILTER (WHERE inside = 0) AS test FROM a GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY fit DESC, trial) AS best, row_number() OVER (PARTITION BY m ORDER BY test, trial) AS place FROM p),
l AS (SELECT *, ln(place / 9.0 / (1 - place / 9.0)) AS logit FROM k WHERE best = 1)
SELECT round(avg((logit <= 0)::INT), 6) AS pbo, 8::BIGINT AS n_trials, 10 AS n_splits, count(*) AS n_combinations, round(avg(logit), 6) AS mean_logit, round(regr_slope(test, fit), 6) AS performance_degradation FROM l""",
)(lambda s, d: _six(certification.backtest_overfitting(bars.trials_weekly(s, d), n_splits=10)))
_Z = NormalDist().inv_cdf
# the series x + x^3/3 + x^5/15 + ... times the density, its terms through logarithms of double factorials
_PHI = "0.5 + sign({z}) * exp(-pow({z}, 2) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 121), lambda k: CASE WHEN {z} = 0 THEN 0 ELSE exp((2 * k + 1) * ln(abs({z})) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)) END))"
def _significance(rows: str) -> str:
    """(trial, sr, probabilistic_sharpe, deflated_sharpe) of eight trials, from a table (trial, ret)."""
    return f"""WITH x AS ({rows}), c AS (SELECT *, ret - avg(ret) OVER (PARTITION BY trial) AS e FROM x),
s AS (SELECT trial, count(*) AS n, avg(ret) / stddev_samp(ret) AS sr, avg(pow(e, 3)) / pow(stddev_samp(ret), 3) AS sk, avg(pow(e, 4)) / pow(stddev_samp(ret), 4) AS ku FROM c GROUP BY trial),
t AS (SELECT stddev_samp(sr) * {(1 - 0.5772156649015329) * _Z(1 - 1 / 8) + 0.5772156649015329 * _Z(1 - 1 / (8 * math.e))!r} AS top FROM s),
z AS (SELECT trial, sr, least(7, greatest(-7, sr * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr))) AS z0, least(7, greatest(-7, (sr - top) * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr))) AS z1 FROM s, t)
SELECT trial, round(sr, 6) AS sr, round({_PHI.format(z='z0')}, 6) AS probabilistic_sharpe, round({_PHI.format(z='z1')}, 6) AS deflated_sharpe FROM z"""


query("cert_sharpe_significance", _significance(TRIALS_SQL))(lambda s, d: _six(certification.sharpe_significance(bars.trials_weekly(s, d))))


#: The bands once more as (least value, points), so that a wrong one in the operator shows.
_GRID_BANDS = {
    "deflated_sharpe": "0.95 100, 0.90 90, 0.75 75, 0.50 55, 0.25 35, else 20",
    "probabilistic_sharpe_cost": "0.95 0, 0.90 5, 0.75 12, 0.50 22, else 35",
    "oos_sharpe": "1.0 80, 0.5 60, 0.25 45, else 30",
    "oos_decay": "1.0 100, 0.9 90, 0.7 75, 0.5 55, 0.35 40, 0.2 25, else 10",
    "loss_control": "90 100, 80 80, 70 60, 60 40, 45 20, else 5",
    "independence": "0.8 100, 0.6 80, 0.4 60, 0.2 40, else 20",
    "capacity": "50000000 100, 10000000 85, 1000000 65, 250000 45, 50000 25, else 10",
    "live_ratio": "0.8 100, 0.6 85, 0.4 65, 0.2 45, 0.001 30, else 10",
    "grade": "80 'A', 70 'B', 60 'C', 50 'D', else 'Not Certified'",
}


def _band_sql(value: str, name: str) -> str:
    cases = [band.split(" ", 1) for band in _GRID_BANDS[name].split(", ")]
    return "CASE " + " ".join(f"ELSE {points}" if least == "else" else f"WHEN {value} >= {least} THEN {points}" for least, points in cases) + " END"


@query(
    "cert_grade",
    f"""WITH a AS ({SQL['cert_analytics']}), sig AS ({_significance(f'SELECT asset AS trial, ret FROM ({PANEL_SQL})').replace(', 6)', ', 14)')}),
g AS (SELECT a.*, deflated_sharpe AS dsr, probabilistic_sharpe AS psr, {_band_sql('100 - abs(100 * max_drawdown)', 'loss_control')} AS loss FROM a JOIN sig ON sig.trial = a.strategy),
s AS (SELECT *, CASE WHEN dsr > 0 THEN greatest(0, least(100, {_band_sql('dsr', 'deflated_sharpe')} - {_band_sql('psr', 'probabilistic_sharpe_cost')})) ELSE 0 END AS s1,
  greatest(0, least(100, loss + CASE WHEN sortino >= 2 THEN 5 WHEN sortino < 0.5 THEN -15 ELSE 0 END + CASE WHEN calmar >= 1 THEN 5 WHEN calmar < 0.3 THEN -10 ELSE 0 END - CASE WHEN tail_ratio < 0.8 THEN 10 ELSE 0 END - CASE WHEN excess_kurtosis > 5 THEN 5 ELSE 0 END)) AS s3,
  {_band_sql('1 - abs(beta)', 'independence')} AS s4 FROM g),
c AS (SELECT *, round((s1 * 0.25 + s3 * 0.15 + s4 * 0.15 + 40 * 0.1) / 0.85, 1) AS k FROM s)
SELECT strategy, s1::DOUBLE AS score_robustness, 0.0::DOUBLE AS score_out_of_sample, s3::DOUBLE AS score_risk, s4::DOUBLE AS score_factor_independence, 40.0::DOUBLE AS score_capacity_cost, NULL::DOUBLE AS score_live_track_record,
  true AS gate_backtest_verified, true AS gate_no_high_severity_lookahead, dsr > 0 AS gate_deflated_sharpe_positive, true AS gate_core_metrics_present, dsr > 0 AS gates_passed,
  CASE WHEN dsr > 0 THEN k END AS composite, CASE WHEN dsr > 0 THEN {_band_sql('k', 'grade')} ELSE 'Not Certified' END AS grade, true AS provisional, dsr > 0 AND {_band_sql('k', 'grade')} <> 'Not Certified' AS certified FROM c""",
)
def grade(spark: SparkSession, sf: str) -> DataFrame:
    """Grades of the monthly strategies by their analytics and significance."""
    a = certification.risk_analytics(_equity(spark, sf), benchmark="bench")
    sig = certification.sharpe_significance(bars.panel_monthly(spark, sf).withColumnRenamed("asset", "strategy"), ["strategy"])
    rows = a.join(sig, "strategy").select(
        "strategy", F.lit(True).alias("backtest_verified"), F.col("sharpe").alias("sharpe_ratio"), (F.col("max_drawdown") * 100).alias("max_drawdown"), "beta", "sortino", "calmar", "tail_ratio", "excess_kurtosis", "deflated_sharpe", "probabilistic_sharpe", F.lit(7.0).alias("num_trials")
    )
    graded = certification.certify(rows)
    return graded.select("strategy", *[c for c in graded.columns if c.startswith(("score_", "gate"))], "composite", "grade", "provisional", "certified")


_GRADE_IN = "SELECT o_orderkey AS id, (o_orderkey % 7) / 4.0 AS sharpe_ratio, -(o_orderkey % 60)::DOUBLE AS max_drawdown, (o_orderkey % 30) / 10.0 AS profit_factor, (o_orderkey % 5 - 2) / 10.0 AS alpha, (o_orderkey % 11) / 10.0 AS beta, (o_orderkey % 12 - 1) / 10.0 AS deflated_sharpe, (o_orderkey % 13) / 12.0 AS probabilistic_sharpe, (o_orderkey % 3)::DOUBLE AS num_trials, (o_orderkey % 9 - 1) / 5.0 AS oos_sharpe, (o_orderkey % 17)::DOUBLE AS turnover, pow(10, o_orderkey % 9) AS capacity, (o_orderkey % 10) / 5.0 AS live_sharpe, (o_orderkey % 50)::DOUBLE AS live_trades, (o_orderkey % 80)::DOUBLE AS live_days FROM orders"


@query(
    "cert_grade_grid",
    f"""WITH g AS ({_GRADE_IN}),
s AS (SELECT *, live_trades >= 20 AND live_days >= 30 AS live,
 CASE WHEN deflated_sharpe > 0 THEN greatest(0, least(100, least({_band_sql('deflated_sharpe', 'deflated_sharpe')} - {_band_sql('probabilistic_sharpe', 'probabilistic_sharpe_cost')}, CASE WHEN num_trials <= 1 THEN 60 ELSE 1000 END))) ELSE 0 END AS s1,
 CASE WHEN oos_sharpe <= 0 THEN 5 WHEN sharpe_ratio <= 0 THEN {_band_sql('oos_sharpe', 'oos_sharpe')} ELSE {_band_sql('least(1.2, greatest(0, oos_sharpe / nullif(sharpe_ratio, 0)))', 'oos_decay')} END AS s2,
 least(100, greatest(0, CASE WHEN profit_factor < 1 THEN least(45, {_band_sql('100 - abs(max_drawdown)', 'loss_control')}) WHEN profit_factor >= 2 THEN least(100, 5 + {_band_sql('100 - abs(max_drawdown)', 'loss_control')}) ELSE {_band_sql('100 - abs(max_drawdown)', 'loss_control')} END)) AS s3,
 CASE WHEN alpha > 0 THEN least(100, 5 + {_band_sql('1 - abs(beta)', 'independence')}) WHEN alpha < 0 THEN least(50, {_band_sql('1 - abs(beta)', 'independence')}) ELSE {_band_sql('1 - abs(beta)', 'independence')} END AS s4,
 greatest(0, {_band_sql('capacity', 'capacity')} - CASE WHEN turnover > 10 THEN 15 WHEN turnover > 5 THEN 8 ELSE 0 END) AS s5,
 {_band_sql('CASE WHEN sharpe_ratio > 0 THEN least(1.5, greatest(0, live_sharpe / sharpe_ratio)) WHEN live_sharpe > 0 THEN 1.0 ELSE 0.0 END', 'live_ratio')} AS s6 FROM g),
c AS (SELECT *, round((CASE WHEN live THEN s1 * 0.25 + s2 * 0.2 + s3 * 0.15 + s4 * 0.15 + s5 * 0.1 + s6 * 0.15 ELSE (s1 * 0.25 + s2 * 0.2 + s3 * 0.15 + s4 * 0.15 + s5 * 0.1) / 0.85 END)::DOUBLE, 1) AS k FROM s)
SELECT id, s1::DOUBLE AS s1, s2::DOUBLE AS s2, s3::DOUBLE AS s3, s4::DOUBLE AS s4, s5::DOUBLE AS s5, CASE WHEN live THEN s6::DOUBLE END AS s6, CASE WHEN deflated_sharpe > 0 THEN k END AS composite,
 CASE WHEN deflated_sharpe <= 0 THEN 'Not Certified' WHEN k >= 90 AND live THEN 'A+' ELSE {_band_sql('k', 'grade')} END AS grade FROM c""",
)
def grade_grid(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = bars.table(spark, sf, "orders").select(
        k.alias("id"), F.lit(True).alias("backtest_verified"), ((k % 7) / 4.0).alias("sharpe_ratio"), (-(k % 60)).cast("double").alias("max_drawdown"), ((k % 30) / 10.0).alias("profit_factor"), ((k % 5 - 2) / 10.0).alias("alpha"), ((k % 11) / 10.0).alias("beta"),
        ((k % 12 - 1) / 10.0).alias("deflated_sharpe"), ((k % 13) / 12.0).alias("probabilistic_sharpe"), (k % 3).cast("double").alias("num_trials"), ((k % 9 - 1) / 5.0).alias("oos_sharpe"), (k % 17).cast("double").alias("turnover"), F.pow(F.lit(10.0), k % 9).alias("capacity"),
        ((k % 10) / 5.0).alias("live_sharpe"), (k % 50).cast("double").alias("live_trades"), (k % 80).cast("double").alias("live_days"),
    )
    g = certification.certify(rows)
    names = ["robustness", "out_of_sample", "risk", "factor_independence", "capacity_cost", "live_track_record"]
    return g.select("id", *[F.col(f"score_{n}").alias(f"s{i + 1}") for i, n in enumerate(names)], "composite", "grade")


# ---- scenarios

query(
    "copula_pseudo_observations",
    f"SELECT obs_id, asset, round((rank() OVER (PARTITION BY asset ORDER BY ret) + (count(*) OVER (PARTITION BY asset, ret) - 1) / 2.0) / (count(*) OVER (PARTITION BY asset) + 1.0), 6) AS u FROM ({PANEL_SQL})",
)(_panel(scenarios.pseudo_observations))


@query(
    "copula_fit",
    f"""WITH p AS MATERIALIZED ({PANEL_SQL}), xy AS (SELECT a.obs_id, a.ret AS x, b.ret AS y FROM p a JOIN p b USING (obs_id) WHERE a.asset = 0 AND b.asset = 1),
k AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))) AS tau FROM xy a, xy b),
t AS (SELECT least(greatest(tau, 1e-6), 1 - 1e-6) AS tau FROM k)
SELECT 'clayton' AS family, round(2 * tau / (1 - tau), 6) AS theta, round(pow(2, -(1 - tau) / (2 * tau)), 6) AS lower_tail, 0.0::DOUBLE AS upper_tail FROM t
UNION ALL SELECT 'gumbel', round(1 / (1 - tau), 6), 0.0, round(2 - pow(2, 1 - tau), 6) FROM t""",
)
def copula_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The two families of one parameter, fitted to the first two assets."""
    returns = bars.panel_monthly(spark, sf).where("asset < 2")
    fits = [scenarios.fit_copula(returns, family) for family in ("clayton", "gumbel")]
    return _six(spark.createDataFrame([(f.family, float(f.theta), *map(float, f.tail_dependence)) for f in fits], "family string, theta double, lower_tail double, upper_tail double"))


query("copula_synthetic_returns")(_panel(lambda p: scenarios.synthetic_returns(p, family="gaussian")))
query("copula_student_t")(_panel(lambda p: scenarios.synthetic_returns(p)))
query("copula_clayton")(_panel(lambda p: scenarios.synthetic_returns(p.where("asset < 2"), family="clayton")))
query("copula_gumbel")(_panel(lambda p: scenarios.synthetic_returns(p.where("asset < 2"), family="gumbel")))
# one view: the tilt exp(-l x) whose mean is the view, by bisection
_POOLED = f"""p AS MATERIALIZED ({PANEL_SQL}), x AS (SELECT list(ret ORDER BY obs_id) AS x FROM p WHERE asset = 0),
steps AS (SELECT 0 AS k, x, -500.0::DOUBLE AS lo, 500.0::DOUBLE AS hi FROM x
  UNION ALL SELECT k + 1, x, CASE WHEN mean > 0.01 THEN mid ELSE lo END, CASE WHEN mean > 0.01 THEN hi ELSE mid END
  FROM (SELECT *, list_dot_product(x, w) / list_sum(w) AS mean FROM (SELECT k, x, lo, hi, mid, list_transform(x, lambda v: exp(-mid * v - shift)) AS w FROM (SELECT *, (lo + hi) / 2 AS mid, list_max(list_transform(x, lambda v: -(lo + hi) / 2 * v)) AS shift FROM steps WHERE k < 100)))),
tilted AS (SELECT list_transform(x, lambda v: exp(-lo * v - list_max(list_transform(x, lambda u: -lo * u)))) AS w FROM steps WHERE k = 100),
q AS MATERIALIZED (SELECT unnest(range(1, len(w) + 1))::INT AS obs_id, unnest(w) / list_sum(w) AS q FROM tilted)"""
query(
    "entropy_pooling",
    f"WITH RECURSIVE {_POOLED} SELECT obs_id, round(q, 6) AS probability, round(exp(-sum(q * ln(q)) OVER ()), 6) AS effective_scenarios, round(sum(q * ln(q * n)) OVER (), 6) AS relative_entropy FROM q, (SELECT count(*) AS n FROM q)",
)(_panel(lambda p: scenarios.pooled_scenarios(p, {"0": 0.01})))
query(
    "entropy_posterior_moments",
    f"WITH RECURSIVE {_POOLED}, m AS (SELECT asset, sum(q * ret) AS m FROM p JOIN q USING (obs_id) GROUP BY asset) SELECT a.asset AS i, b.asset AS j, round(any_value(x.m), 6) AS mean_i, round(sum(q * (a.ret - x.m) * (b.ret - y.m)), 6) AS cov FROM p a JOIN p b USING (obs_id) JOIN q USING (obs_id) JOIN m x ON x.asset = a.asset JOIN m y ON y.asset = b.asset GROUP BY a.asset, b.asset",
)(_panel(lambda p: scenarios.posterior_moments(p, scenarios.pooled_scenarios(p, {"0": 0.01}))))

# ---- plot data

query("plot_drawdown", f"SELECT strategy, obs_id, round(equity, 6) AS equity, round(equity / max(equity) OVER (PARTITION BY strategy ORDER BY obs_id ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM ({EQUITY_SQL})")(lambda s, d: _six(portfolio.drawdown_chart(bars.equity_monthly(s, d))))
query(
    "plot_correlation",
    f"WITH RECURSIVE {mx.MOMENTS}, {mx.single_linkage(_DISTANCE)} SELECT (a - 1)::INT AS row, (b - 1)::INT AS column, (leaf_order[a] - 1)::VARCHAR AS i, (leaf_order[b] - 1)::VARCHAR AS j, round(r[leaf_order[a]][leaf_order[b]], 6) AS correlation FROM leaves, moments, range(1, 9) AS x(a), range(1, 9) AS y(b)",
)(_panel(portfolio.correlation_chart))
query("plot_weights", f"WITH RECURSIVE {mx.MOMENTS}, {_PARITY} SELECT (k - 1)::VARCHAR AS asset, round(w[k], 6) AS weight FROM parity, range(1, 9) AS places(k)")(_panel(lambda p: portfolio.weights_chart(allocation.risk_parity(p))))

# ---- operators that other queries only use inside

query(
    "cost_model",
    "SELECT o_orderkey, round(CASE o_orderkey % 3 WHEN 0 THEN 4 + pow(o_totalprice / 1e6, 0.6) * 0.02 * 2000 + 1 WHEN 1 THEN 4 + o_totalprice / 1e6 * 2000 + 1 ELSE 4 + pow(o_totalprice / 1e6, 0.6) * 0.02 * 3140 + 0.02 * 1420 * pow(0.1, 0.6) + 1 END, 6) AS bps FROM orders",
)(lambda s, d: _cost_models(bars.table(s, d, "orders")))


def _cost_models(orders: DataFrame) -> DataFrame:
    """A model of each kind for a third of the orders."""
    kinds = [portfolio.CostModel(8.0, 0.2, 0.6, kind, 1.0).estimate(F.col("o_totalprice"), 1e6, 0.02) for kind in ("sqrt", "linear", "almgren_chriss")]
    chosen = F.col("o_orderkey") % 3
    return orders.select("o_orderkey", F.round(F.when(chosen == 0, kinds[0]).when(chosen == 1, kinds[1]).otherwise(kinds[2]), 6).alias("bps"))


@query("qubo_annealed", SQL["qubo_brute_force"])
def qubo_annealed(spark: SparkSession, sf: str) -> DataFrame:
    """The same program by annealing, which finds its optimum."""
    cov = panel.moments(bars.panel_monthly(spark, sf)).annual[1]
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(allocation.annealed_qubo(spark, cov - 2 * np.diag(np.diag(cov))))], "i int, x int")


@query(
    "qubo_permutation",
    f"""WITH {mx.MOMENTS}, x AS (SELECT i, p, j, q, r[i + 1][j + 1] AS v FROM moments, range(8) AS a(i), range(8) AS b(p), range(8) AS c(j), range(8) AS d(q))
SELECT (8 * i + p)::VARCHAR AS i, (8 * j + q)::VARCHAR AS j, round(abs(v) * (p - q) * (p - q) + CASE WHEN i = j AND p <> q THEN 10 ELSE 0 END + CASE WHEN p = q AND i <> j THEN 10 ELSE 0 END - CASE WHEN i = j AND p = q THEN 20 ELSE 0 END, 6) AS value FROM x""",
)
def qubo_permutation(spark: SparkSession, sf: str) -> DataFrame:
    """Places for the assets of the panel, alike ones side by side."""
    q = allocation.build_permutation_qubo(np.abs(panel.moments(bars.panel_monthly(spark, sf)).corr))
    return _six(panel.matrix_frame(spark, list(range(len(q))), q))


@query("src_mapping", f"SELECT obs_id, 'asset_' || asset AS asset, round(ret, 6) AS ret FROM ({PANEL_SQL})")
def mapped_returns(spark: SparkSession, sf: str) -> DataFrame:
    """The panel by way of a mapping of sequences."""
    ids, x = panel.observations(bars.panel_monthly(spark, sf))
    return _six(bars.returns_from_mapping(spark, {f"asset_{a}": x[:, k].tolist() for k, a in enumerate(ids)}))


query(
    "cert_months",
    f"""WITH b AS ({bars.DAILY_SQL}), m AS (SELECT symbol, strftime(ts, '%Y-%m') AS m, arg_max(close, ts) / arg_min(close, ts) - 1 AS r FROM b GROUP BY ALL)
SELECT symbol, round(min(r), 4) AS worst_month, round(max(r), 4) AS best_month FROM m GROUP BY symbol""",
)(lambda s, d: certification.risk_analytics(bars.bars_daily(s, d).withColumnRenamed("close", "equity"), ["symbol"], "ts", date="ts").select("symbol", "worst_month", "best_month"))

query("latest_sma", f"WITH b AS ({bars.DAILY_SQL}), m AS (SELECT symbol, ts, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS x FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT symbol, round(arg_max(x, ts) FILTER (WHERE x IS NOT NULL), 6) AS sma FROM m GROUP BY symbol")(
    lambda s, d: _six(indicators.latest(indicators.compute(bars.bars_daily(s, d), "sma"), "sma"))
)


def _fitted(make: Callable) -> Query:
    """Returns of the portfolio that an estimator fits to the panel."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        returns = bars.panel_monthly(spark, sf).withColumn("asset", F.col("asset").cast("string"))
        return _six(make().fit(returns).transform(returns), 4)

    return run


query("est_hrp", f"WITH w AS ({_hierarchical(12)}) SELECT obs_id, round(sum(ret * weight), 4) AS ret FROM ({PANEL_SQL}) x JOIN w ON w.asset = x.asset::VARCHAR GROUP BY obs_id")(_fitted(estimators.hrp_estimator))
query("est_mean_risk", f"WITH w AS ({mx.program('min_variance', digits=12)}) SELECT obs_id, round(sum(ret * weight), 4) AS ret FROM ({PANEL_SQL}) x JOIN w ON w.asset = x.asset::VARCHAR GROUP BY obs_id")(_fitted(lambda: estimators.mean_risk_estimator(risk_measure="variance")))
query("est_herc", f"WITH w AS ({_herc(12)}) SELECT obs_id, round(sum(ret * weight), 4) AS ret FROM ({PANEL_SQL}) x JOIN w ON w.asset = x.asset::VARCHAR GROUP BY obs_id")(_fitted(estimators.herc_estimator))
query("est_nco", f"WITH w AS ({_nested(12)}) SELECT obs_id, round(sum(ret * weight), 4) AS ret FROM ({PANEL_SQL}) x JOIN w ON w.asset = x.asset::VARCHAR GROUP BY obs_id")(_fitted(estimators.nco_estimator))


@query("stream_hourly", f"WITH b AS ({bars.HOURLY_SQL}), late AS (SELECT max(ts) AS last FROM events) SELECT symbol, strftime(b.ts, '%Y-%m-%d %H') AS hour, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM b, late WHERE b.ts + INTERVAL 2 HOUR <= last")
def stream_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars of the events as a stream, of the hours that the watermark has closed."""
    schema = bars.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    made = stream_bars(events, F.col("event_type"), F.col("ts"), F.col("value"), F.lit(1), F.col("event_id"))
    name = f"tickloom_hourly_{uuid.uuid4().hex}"
    made.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return _six(spark.table(name).select("symbol", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "open", "high", "low", "close", "volume"))
