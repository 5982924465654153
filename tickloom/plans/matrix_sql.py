"""Small dense matrices in DuckDB SQL: lists of lists, loops as recursive tables of one row.

The programs here are solved by other methods than those of the engine (pairwise
descent, coordinate descent, matrix powers and sign iterations), so equal results
are evidence for both.  Matrices are symmetric (iterations keep them so); places count from 1.
"""

from __future__ import annotations

from tickloom.sources.bars import PANEL_ASSETS, PANEL_SQL

N = PANEL_ASSETS
EACH = f"range(1, {N + 1})"


def times(a: str, b: str) -> str:
    """The product of two matrices, the second one symmetric."""
    return f"list_transform({a}, lambda row: list_transform({b}, lambda other: list_dot_product(row, other)))"


def on(a: str, v: str) -> str:
    return f"list_transform({a}, lambda row: list_dot_product(row, {v}))"


def mix(x: str, a: str, y: str, b: str, n: str = EACH) -> str:
    """x a + y b for matrices a and b."""
    return f"list_transform({n}, lambda i: list_transform({n}, lambda j: ({x}) * {a}[i][j] + ({y}) * {b}[i][j]))"


def trace(a: str, n: str = EACH) -> str:
    return f"list_sum(list_transform({n}, lambda i: {a}[i][i]))"


UNIT = f"list_transform({EACH}, lambda i: list_transform({EACH}, lambda j: (i = j)::INT::DOUBLE))"

#: p: the panel; moments: annual covariances c, means mu, correlations r, observations t.
MOMENTS = f"""p AS MATERIALIZED ({PANEL_SQL}),
pair AS (SELECT x.asset AS i, y.asset AS j, covar_samp(x.ret, y.ret) * 252 AS v, corr(x.ret, y.ret) AS r FROM p x JOIN p y USING (obs_id) GROUP BY ALL),
moments AS MATERIALIZED (
  SELECT (SELECT list(v ORDER BY i) FROM (SELECT i, list(v ORDER BY j) AS v FROM pair GROUP BY i)) AS c,
         (SELECT list(r ORDER BY i) FROM (SELECT i, list(r ORDER BY j) AS r FROM pair GROUP BY i)) AS r,
         (SELECT list(m ORDER BY asset) FROM (SELECT asset, avg(ret) * 252 AS m FROM p GROUP BY asset)) AS mu,
         (SELECT count(DISTINCT obs_id) FROM p) AS t)"""


def spread_weights(source: str, method: str, digits: int = 4, rf: str = "0", more: str = "", matrix: str = "c", means: str = "mu") -> str:
    """Rows of an allocation from a table of one row with weights w, covariances and means."""
    ret, vol = f"list_dot_product(w, {means})", f"sqrt(list_dot_product(w, {on(matrix, 'w')}))"
    return f"""SELECT (k - 1)::VARCHAR AS asset, round(w[k], {digits}) AS weight, '{method}' AS method, round(100 * {ret}, {digits}) AS return_pct,
  round(100 * {vol}, {digits}) AS volatility_pct, round(({ret} - {rf}) / {vol}, {digits}) AS sharpe{more} FROM (SELECT *, unnest({EACH}) AS k FROM {source})"""


def descent(given: str, name: str = "solved", rounds: int = 20_000) -> str:
    """Least a/2 w'cw + q'w + b sqrt(w'cw) + t |w - held| with sum w unchanged and lo <= w <= hi.

    ``given``: a table with id, c, q, lo, hi, held, a, b, t and a feasible w.  Each
    step moves weight from the asset that gains most by less to the one that gains
    most by more, as far as the objective falls along that line.
    """
    rate = "(a + CASE WHEN b > 0 THEN b / sqrt(list_dot_product(w, cw)) ELSE 0 END)"
    return f"""{name}_steps AS (
  SELECT id, 0 AS k, w, {on('c', 'w')} AS cw, 1.0::DOUBLE AS gap FROM {given}
  UNION ALL
  SELECT id, k + 1, list_transform({EACH}, lambda x: w[x] + CASE WHEN x = up.i THEN move WHEN x = down.i THEN -move ELSE 0 END), list_transform({EACH}, lambda x: cw[x] + move * (c[up.i][x] - c[down.i][x])), gap
  FROM (SELECT *, greatest(0, least(gap / (rate * (c[up.i][up.i] + c[down.i][down.i] - 2 * c[up.i][down.i])), hi[up.i] - w[up.i], CASE WHEN w[up.i] < held[up.i] - 1e-15 THEN held[up.i] - w[up.i] ELSE 1e9 END,
                 w[down.i] - lo[down.i], CASE WHEN w[down.i] > held[down.i] + 1e-15 THEN w[down.i] - held[down.i] ELSE 1e9 END)) AS move
    FROM (SELECT *, down.v - up.v AS gap
      FROM (SELECT *, list_min(list_transform(list_filter({EACH}, lambda x: w[x] < hi[x] - 1e-15), lambda x: {{'v': rate * cw[x] + q[x] + CASE WHEN w[x] >= held[x] - 1e-15 THEN t ELSE -t END, 'i': x}})) AS up,
                      list_max(list_transform(list_filter({EACH}, lambda x: w[x] > lo[x] + 1e-15), lambda x: {{'v': rate * cw[x] + q[x] + CASE WHEN w[x] > held[x] + 1e-15 THEN t ELSE -t END, 'i': x}})) AS down
        FROM (SELECT s.id, s.k, s.w, s.cw, g.c, g.q, g.lo, g.hi, g.held, g.t, {rate.replace('w,', 's.w,').replace('cw)', 's.cw)')} AS rate FROM {name}_steps s JOIN {given} g ON g.id = s.id WHERE s.gap > 1e-13 AND s.k < {rounds}))))),
{name} AS MATERIALIZED (SELECT id, arg_max(w, k) AS w FROM {name}_steps GROUP BY id)"""


def program(method: str, q: str = f"list_transform({EACH}, lambda x: 0.0::DOUBLE)", a: str = "1", b: str = "0", t: str = "0", held: str | None = None, high: str = "1", matrix: str = "c", more: str = "", extra: str = "", digits: int = 4) -> str:
    """An allocation with long-only weights that sum to one."""
    full = lambda v: f"list_transform({EACH}, lambda x: ({v})::DOUBLE)"
    return f"""WITH RECURSIVE {MOMENTS},
given AS MATERIALIZED (SELECT 0 AS id, {matrix} AS c, {q} AS q, {full('0')} AS lo, {full(high)} AS hi, {full(held or ('1e9'))} AS held, ({a})::DOUBLE AS a, ({b})::DOUBLE AS b, ({t})::DOUBLE AS t, {full(f'1.0 / {N}')} AS w FROM moments),
{descent('given')},
result AS (SELECT m.c, m.mu, m.t, s.w{extra} FROM solved s, moments m)
{spread_weights('result', method, digits, more=more)}"""


def best_ratio(method: str, gain: str, more: str = "") -> str:
    """Greatest gain'w / sqrt(w'cw): least variance of y / gain with sum y = 1, each y on the side of its gain."""
    return f"""WITH RECURSIVE {MOMENTS},
gains AS (SELECT *, {gain} AS gain FROM moments),
given AS MATERIALIZED (
  SELECT 0 AS id, list_transform({EACH}, lambda i: list_transform({EACH}, lambda j: c[i][j] / gain[i] / gain[j])) AS c, list_transform({EACH}, lambda x: 0.0::DOUBLE) AS q, list_transform({EACH}, lambda x: CASE WHEN gain[x] > 0 THEN 0 ELSE -1e9 END::DOUBLE) AS lo,
         list_transform({EACH}, lambda x: CASE WHEN gain[x] > 0 THEN 1e9 ELSE 0 END::DOUBLE) AS hi, list_transform({EACH}, lambda x: 1e9::DOUBLE) AS held, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS t,
         list_transform({EACH}, lambda x: CASE WHEN x = list_position(gain, list_max(gain)) THEN 1 ELSE 0 END::DOUBLE) AS w FROM gains),
{descent('given')},
scaled AS (SELECT g.c, g.mu, list_transform({EACH}, lambda x: s.w[x] / g.gain[x]) AS y FROM solved s, gains g),
result AS (SELECT c, mu, list_transform({EACH}, lambda x: y[x] / list_sum(y)) AS w FROM scaled)
{spread_weights('result', method, more=more)}"""


def inverse(given: str, column: str, name: str = "inverted", n: str = EACH, rounds: int = 60) -> str:
    """``name``: (id, x) with the inverse of a positive definite matrix, by Newton's iteration x (2 - m x)."""
    bound = f"list_max(list_transform({column}, lambda row: list_sum(list_transform(row, lambda e: abs(e)))))"
    step = f"list_transform({n}, lambda i: list_transform({n}, lambda j: x[i][j] + x[j][i] - (xmx[i][j] + xmx[j][i]) / 2))"
    return f"""{name}_steps AS (
  SELECT id, 0 AS k, {column} AS m, list_transform({n}, lambda i: list_transform({n}, lambda j: CASE WHEN i = j THEN 1 / {bound} ELSE 0 END::DOUBLE)) AS x FROM {given}
  UNION ALL
  SELECT id, k + 1, m, {step} FROM (SELECT *, {times(times('x', 'm'), 'x')} AS xmx FROM {name}_steps WHERE k < {rounds})),
{name} AS MATERIALIZED (SELECT id, x FROM {name}_steps WHERE k = {rounds})"""


def sign(given: str, column: str, name: str = "signs", rounds: int = 80) -> str:
    """``name``: (x) with the sign of a symmetric matrix: x (3 - x^2) / 2 from the matrix over its norm."""
    norm = f"sqrt(list_sum(list_transform({column}, lambda row: list_dot_product(row, row))))"
    return f"""{name}_steps AS (
  SELECT 0 AS k, list_transform({column}, lambda row: list_transform(row, lambda e: e / {norm})) AS x FROM {given}
  UNION ALL
  SELECT k + 1, list_transform({EACH}, lambda i: list_transform({EACH}, lambda j: 0.75 * (x[i][j] + x[j][i]) - 0.25 * (cube[i][j] + cube[j][i]))) FROM (SELECT *, {times(times('x', 'x'), 'x')} AS cube FROM {name}_steps WHERE k < {rounds})),
{name} AS MATERIALIZED (SELECT x FROM {name}_steps WHERE k = {rounds})"""


def leading(given: str, column: str, count: int, name: str = "leads", squarings: int = 45) -> str:
    """``name``: (nth, value, projector) of the greatest eigenvalues: a matrix squared again and again is its first projector; then that part is taken away."""
    scaled = lambda a: f"list_transform({a}, lambda row: list_transform(row, lambda e: e / {trace(a)}))"
    value = trace(times("rest", "power"))
    return f"""{name}_steps AS (
  SELECT 0 AS k, {column} AS rest, {scaled(column)} AS power, 0.0::DOUBLE AS value FROM {given}
  UNION ALL
  SELECT k + 1, CASE WHEN ends THEN later ELSE rest END, CASE WHEN ends THEN {scaled('later')} ELSE {scaled('squared')} END, value
  FROM (SELECT *, {mix('1', 'rest', '-value', 'power')} AS later, {times('power', 'power')} AS squared
    FROM (SELECT k, rest, power, (k + 1) % {squarings} = 0 AS ends, {value} AS value FROM {name}_steps WHERE k < {count * squarings}))),
{name} AS MATERIALIZED (SELECT (k + 1) // {squarings} AS nth, {value} AS value, power AS projector FROM {name}_steps WHERE (k + 1) % {squarings} = 0)"""


def single_linkage(distance: str, given: str = "moments", name: str = "leaves") -> str:
    """``name``: (leaf_order) of single linkage, ties to the lowest pair."""
    far = "list_min(flatten(list_transform(groups[x], lambda i: list_transform(groups[y], lambda j: d[i][j]))))"
    pairs = f"flatten(list_transform(range(1, len(groups)), lambda x: list_transform(range(x + 1, len(groups) + 1), lambda y: {{'d': {far}, 'x': x, 'y': y}})))"
    return f"""{name}_steps AS (
  SELECT {distance} AS d, list_transform({EACH}, lambda i: [i]) AS groups FROM {given}
  UNION ALL
  SELECT d, list_concat(list_transform(list_filter(range(1, len(groups) + 1), lambda k: k <> best.x AND k <> best.y), lambda k: groups[k]), [list_concat(groups[best.x], groups[best.y])])
  FROM (SELECT *, list_min({pairs}) AS best FROM {name}_steps WHERE len(groups) > 1)),
{name} AS MATERIALIZED (SELECT groups[1] AS leaf_order FROM {name}_steps WHERE len(groups) = 1)"""


def ward_linkage(distance: str, given: str = "moments", name: str = "ward") -> str:
    """``name``: (clusters) in leaf order, as many as the widest gap of merge heights suggests, two at least."""
    others = "list_filter(range(1, len(groups) + 1), lambda k: k <> best.x AND k <> best.y)"
    size = "len(groups[{}])"
    to_new = f"sqrt((({size.format('best.x')} + {size.format('k')}) * pow(d[best.x][k], 2) + ({size.format('best.y')} + {size.format('k')}) * pow(d[best.y][k], 2) - {size.format('k')} * pow(best.d, 2)) / ({size.format('best.x')} + {size.format('best.y')} + {size.format('k')}))"
    pairs = "flatten(list_transform(range(1, len(groups)), lambda x: list_transform(range(x + 1, len(groups) + 1), lambda y: {'d': d[x][y], 'x': x, 'y': y})))"
    return f"""{name}_steps AS (
  SELECT {distance} AS d, list_transform({EACH}, lambda i: [i]) AS groups, []::DOUBLE[] AS heights FROM {given}
  UNION ALL
  SELECT list_append(list_transform(others, lambda i: list_append(list_transform(others, lambda j: d[i][j]), fresh[list_position(others, i)])), list_append(fresh, 0.0)),
         list_append(list_transform(others, lambda k: groups[k]), list_concat(groups[best.x], groups[best.y])), list_append(heights, best.d)
  FROM (SELECT *, list_transform(others, lambda k: {to_new}) AS fresh FROM (SELECT *, {others} AS others FROM (SELECT *, list_min({pairs}) AS best FROM {name}_steps WHERE len(groups) > 1)))),
{name}_whole AS (SELECT groups[1] AS leaf_order, greatest(2, {N} - list_position(gaps, list_max(gaps))) AS wanted FROM (SELECT *, list_transform(range(1, {N - 1}), lambda k: heights[k + 1] - heights[k]) AS gaps FROM {name}_steps WHERE len(groups) = 1)),
{name} AS MATERIALIZED (SELECT list_transform(list_sort(list_transform(groups, lambda g: [list_min(list_transform(g, lambda i: list_position(leaf_order, i))), list_position(groups, g)])), lambda p: list_sort(groups[p[2]])) AS clusters
  FROM {name}_steps, {name}_whole WHERE len(groups) = wanted)"""


def sub(a: str, rows: str, columns: str | None = None) -> str:
    return f"list_transform({rows}, lambda i: list_transform({columns or rows}, lambda j: {a}[i][j]))"


def inverse_variance(a: str, own: str) -> str:
    """Variance of the inverse-variance portfolio of the places ``own``."""
    return f"abs(list_sum(flatten(list_transform({own}, lambda i: list_transform({own}, lambda j: {a}[i][j] / {a}[i][i] / {a}[j][j])))) / pow(list_sum(list_transform({own}, lambda i: 1 / {a}[i][i])), 2))"
