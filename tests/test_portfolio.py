import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import allocation, certification, covariance, portfolio, risk, scenarios, solvers
from tickloom.operators.estimators import hrp_estimator
from tickloom.sources.bars import returns_from_mapping, tail_aligned


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(1)
    f, g = rng.normal(0, 0.01, (2, 300))
    data = {"A": f, "B": f * 0.9, "C": g, "D": g * 1.1}
    return {k: (v + rng.normal(0, 0.004, 300)).tolist() for k, v in data.items()}


@pytest.fixture(scope="module")
def panel(spark, clusters):
    return returns_from_mapping(spark, clusters).cache()


def weights(frame):
    return {r.asset: r.weight for r in frame.collect()}


def assets(frame):
    return sorted(r.asset for r in frame.select("asset").distinct().collect())


def matrix(frame, ids):
    got = {(r.i, r.j): r.value for r in frame.collect()}
    return np.array([[got[a, b] for b in ids] for a in ids])


def test_tail_alignment(spark):
    rows = tail_aligned(returns_from_mapping(spark, {"A": [1.0, 2.0, 3.0], "B": [5.0, 6.0]})).orderBy("asset", "obs_id").collect()
    assert [(r.asset, r.obs_id, r.ret) for r in rows] == [("A", 1, 2.0), ("A", 2, 3.0), ("B", 1, 5.0), ("B", 2, 6.0)]


def test_covariances(spark, clusters, panel):
    x = np.array(list(clusters.values())).T
    ids = list(clusters)
    np.testing.assert_allclose(matrix(covariance.sample_cov(panel), ids), np.cov(x.T) * 252, rtol=1e-9)
    lam, c, off = 1 - math.log(2) / 60, np.zeros((4, 4)), x - x.mean(axis=0)
    for row in off:
        c = lam * c + (1 - lam) * np.outer(row, row)
    np.testing.assert_allclose(matrix(covariance.ewma_cov(panel), ids), c * 252, rtol=1e-9)
    s, t, n = np.cov(x.T), len(x), 4
    sd = np.sqrt(np.diag(s))
    rho = ((s / np.outer(sd, sd)).sum() - n) / (n * (n - 1))
    aim = rho * np.outer(sd, sd)
    np.fill_diagonal(aim, sd**2)
    s2 = off.T @ off / t
    b2 = sum(((np.outer(r, r) - s2) ** 2).sum() / n for r in off) / t**2
    d2 = ((s - aim) ** 2).sum() / n
    w = min(b2, d2) / d2
    np.testing.assert_allclose(matrix(covariance.ledoit_wolf(panel), ids), (w * aim + (1 - w) * s) * 252, rtol=1e-8)
    for f in (covariance.denoise_mp, covariance.detone_cov, covariance.oracle_approximating, covariance.factor_model_cov):
        m = matrix(f(panel), ids)
        np.testing.assert_allclose(m, m.T, atol=1e-12)
        assert np.linalg.eigvalsh(m).min() > -1e-8
    side = np.where(x >= sd / 2, 1, 0) - np.where(x <= -sd / 2, 1, 0)  # this statistic need not be positive definite
    rho = (side.T @ side) / (np.abs(side).T @ np.abs(side))
    np.testing.assert_allclose(matrix(covariance.gerber_cov(panel), ids), rho * np.outer(sd, sd) * 252, rtol=1e-9)


@pytest.mark.parametrize("name", sorted(allocation.ALLOCATORS))
def test_allocators_are_fully_invested(panel, name):
    options = {"target_k": 2} if name == "qubo_portfolio_selection" else {}
    w = weights(allocation.ALLOCATORS[name](panel, **options))
    assert abs(sum(w.values()) - 1) < 1e-5
    if "nested" not in name:
        assert min(w.values()) > -1e-9


def test_schur_without_gamma_is_hrp(panel):
    a, b = weights(allocation.hierarchical_risk_parity(panel)), weights(allocation.schur_complementary_allocation(panel, gamma=0))
    assert a == pytest.approx(b)


def test_risk_parity_shares(panel, clusters):
    w = np.array(list(weights(allocation.risk_parity(panel)).values()))
    cov = np.cov(np.array(list(clusters.values())))
    share = w * (cov @ w)
    assert np.ptp(share / share.sum()) < 1e-6


def test_target_return_and_infeasible(panel):
    row = allocation.mean_variance(panel, target_return=0.01, constraints=allocation.Constraints(long_only=False, min_weight=-2, max_weight=2)).first()
    assert row.return_pct == pytest.approx(1.0, abs=1e-5)
    with pytest.raises(solvers.Infeasible):
        allocation.mean_variance(panel, target_return=50.0)
    with pytest.raises(NotImplementedError):
        allocation.min_variance(panel, constraints=allocation.Constraints(sector_limits={"x": 1}))


def test_quadratic_program_against_closed_form():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(6, 6))
    p, q = a @ a.T + np.eye(6), rng.normal(size=6)
    x = solvers.quadratic_program(p, q, (np.ones((1, 6)), np.ones(1)))
    inverse = np.linalg.inv(p)
    nu = (-1 - np.ones(6) @ inverse @ q) / (np.ones(6) @ inverse @ np.ones(6))
    np.testing.assert_allclose(x, -inverse @ (q + nu), atol=1e-8)


def test_risk_orderings(spark, panel):
    r = risk.all_risk_measures(panel, ["asset"]).first()
    assert r["var"] <= r["cvar"] + 1e-12 <= r["evar"] + 1e-9 <= r["worst"] + 1e-6
    assert r["dar"] <= r["cdar"] + 1e-12 <= r["edar"] + 1e-9 <= r["mdd"] + 1e-6


def test_risk_frame_equals_array(spark, clusters, panel):
    row = risk.all_risk_measures(panel, ["asset"]).where("asset = 'A'").first()
    for name in risk.RISK_MEASURES:
        assert row[name] == pytest.approx(risk.risk_of(np.array(clusters["A"]), name), rel=1e-6, abs=1e-9), name


def test_fold_algebra(spark):
    cv = portfolio.CombinatorialPurgedCV(6, 2, 2, 3)
    folds = cv.folds(spark, 60).toPandas()
    assert cv.n_folds == 15 == folds.fold.nunique() and cv.n_paths == 5
    for _, f in folds.groupby("fold"):
        test = {i for r in f[f.role == "test"].itertuples() for i in range(r.lo, r.hi)}
        train = {i for r in f[f.role == "train"].itertuples() for i in range(r.lo, r.hi)}
        assert not test & train
        assert all(i + 1 not in train or i in train for i in test)
    with pytest.raises(ValueError):
        portfolio.CombinatorialPurgedCV(3, 3)


def test_paths_cover_every_observation_once(spark, panel):
    cv = portfolio.CombinatorialPurgedCV(5, 2)
    out = portfolio.cross_validate(panel, lambda wide: {c: 0.25 for c in wide.columns}, cv)
    paths = portfolio.reconstruct_paths(out).groupBy("path").agg(F.count("ret").alias("n"), F.countDistinct("obs_id").alias("d")).collect()
    assert len(paths) == 4 and all(p.n == p.d == 300 for p in paths)


def test_overfitting_of_noise_and_of_skill(spark):
    rng = np.random.default_rng(7)
    noise = rng.normal(0, 0.01, (300, 12))
    skilled = noise.copy()
    skilled[:, 3] += 0.004

    def pbo(x):
        rows = [(t, k, float(v)) for t, row in enumerate(x) for k, v in enumerate(row)]
        return certification.backtest_overfitting(spark.createDataFrame(rows, "t int, trial int, ret double"), n_splits=8).first().pbo

    assert pbo(noise) > 0.3 and pbo(skilled) < 0.1


def test_grades(spark):
    rows = [("good", True, 1.6, -8.0, 2.4, 0.06, 0.15, 0.96, 0.97, 40.0, 1.4, 2.0, 60e6, None, None, None), ("unverified", False, 1.6, -8.0, 2.4, 0.06, 0.15, 0.96, 0.97, 40.0, 1.4, 2.0, 60e6, None, None, None), ("live", True, 1.6, -8.0, 2.4, 0.06, 0.15, 0.96, 0.97, 40.0, 1.6, 2.0, 60e6, 1.5, 100.0, 90.0)]
    names = "name string, backtest_verified boolean, sharpe_ratio double, max_drawdown double, profit_factor double, alpha double, beta double, deflated_sharpe double, probabilistic_sharpe double, num_trials double, oos_sharpe double, turnover double, capacity double, live_sharpe double, live_trades double, live_days double"
    got = {r["name"]: r for r in certification.certify(spark.createDataFrame(rows, names)).collect()}
    assert got["good"].grade == "A" and got["good"].provisional
    assert got["unverified"].grade == "Not Certified" and got["unverified"].composite is None
    assert got["live"].grade == "A+" and not got["live"].provisional


def test_copulas(spark):
    rng = np.random.default_rng(0)
    z = rng.multivariate_normal([0, 0], [[1, 0.7], [0.7, 1]], 1500)
    c = scenarios.fit_copula_array(z, "gaussian")
    assert c.correlation[0, 1] == pytest.approx(0.7, abs=0.05)
    for family in ("clayton", "gumbel", "gaussian", "student-t"):
        fitted = scenarios.fit_copula_array(z[:600], family)
        u = fitted.sample(spark, 2000).toPandas()[["u_1", "u_2"]].to_numpy()
        assert ((u > 0) & (u < 1)).all() and np.corrcoef(u.T)[0, 1] > 0.4
    assert scenarios.t_cdf(2.0, 5) == pytest.approx(0.9490302605850709, abs=1e-10)


def test_entropy_pooling_meets_views():
    rng = np.random.default_rng(3)
    x = rng.normal([0.0004, 0.0006], [0.01, 0.015], (2000, 2))
    a, b = scenarios.mean_view_rows(x, {0: 0.002})
    q = scenarios.entropy_pooling(np.full(2000, 1 / 2000), a, b)
    assert q.sum() == pytest.approx(1) and q @ x[:, 0] == pytest.approx(0.002, abs=1e-9)
    same = scenarios.entropy_pooling(np.full(2000, 1 / 2000))
    np.testing.assert_allclose(same, 1 / 2000)
    with pytest.raises(solvers.Infeasible):
        scenarios.entropy_pooling(np.full(2000, 1 / 2000), a, [10.0])


def test_qubo_solvers_agree(spark):
    rng = np.random.default_rng(4)
    q = rng.normal(size=(8, 8))
    q = (q + q.T) / 2
    a, b = allocation.brute_force_qubo(spark, q), allocation.annealed_qubo(spark, q, restarts=8, sweeps=100)
    assert a @ q @ a == pytest.approx(b @ q @ b)


def test_normal_cdf(spark):
    got = spark.createDataFrame([(-2.0,), (0.0,), (1.96,), (5.0,)], "z double").select(certification.normal_cdf(F.col("z")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([0.022750131948, 0.5, 0.975002104852, 0.999999713348], abs=1e-10)


def test_estimator(panel):
    model = hrp_estimator().fit(panel)
    assert model.transform(panel).count() == 300 and math.isfinite(model.score(panel))


def test_kendall_against_all_pairs():
    rng = np.random.default_rng(11)
    for n, top in ((2, 3), (7, 3), (200, 5), (1_000, 10_000)):
        x, y = rng.integers(0, top, (2, n)).astype(float)
        a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        span = math.sqrt(np.abs(a).sum() * np.abs(b).sum())
        assert abs(scenarios.kendall_tau(x, y) - ((a * b).sum() / span if span else 0.0)) < 1e-12
        assert scenarios.inversions(x) == int((np.triu(a, 1) > 0).sum())


def test_draws_do_not_depend_on_batches(spark):
    copula = scenarios.Copula("student-t", np.array([[1.0, 0.5], [0.5, 1.0]]), dof=4.0)
    draws = copula.sample(spark, 500, seed=3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        again = copula.sample(spark, 500, seed=3).orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert draws.orderBy("id").collect() == again


def test_widest_gap_of_merges():
    assert allocation.natural_clusters([1.0, 1.1, 5.0]) == 2
    assert allocation.natural_clusters([1.0, 4.0, 4.1]) == 3
    assert allocation.natural_clusters([1.0, 2.0, 3.0]) == 3  # equal gaps: the lowest
    assert allocation.natural_clusters([1.0]) == 2


def test_cost_models_move_no_weight(spark):
    alphas, cov = {"A": 0.05, "B": 0.08, "C": 0.02}, np.diag([0.04, 0.09, 0.16])
    held = {"A": 1.0}
    plain = allocation.alpha_risk_cost_optimize(spark, alphas, cov, current_weights=held, cost_per_turnover=0.0).collect()
    model = allocation.alpha_risk_cost_optimize(spark, alphas, cov, current_weights=held, cost_model=portfolio.CostModel()).collect()
    dear = allocation.alpha_risk_cost_optimize(spark, alphas, cov, current_weights=held, cost_per_turnover=1.0).collect()
    assert [r.weight for r in plain] == [r.weight for r in model]
    moved = sum(abs(r.weight - held.get(r.asset, 0.0)) for r in model)
    assert abs(model[0].expected_cost_pct - 0.1 * moved) < 1e-9
    assert dear[0].weight > 0.999 and abs(dear[0].expected_cost_pct) < 1e-3


def test_overfitting_by_matrix_equals_joins(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(t, k, float(rng.normal(0.01 * (k == 2), 0.05))) for t in range(97) for k in range(6)]
    trials = spark.createDataFrame(rows, "t int, trial int, ret double")
    first = certification.backtest_overfitting(trials, n_splits=8).first()
    monkeypatch.setattr(certification, "MAX_BLOCK_SUMS", 0)
    second = certification.backtest_overfitting(trials, n_splits=8).first()
    assert first.asDict().keys() == second.asDict().keys()
    for name, value in first.asDict().items():
        assert abs(value - second[name]) < 1e-9, name


def test_attribution_of_each_period(spark):
    rows = [(t, a, w, r) for t in (1, 2) for a, w, r in (("A", 0.5, 0.1 * t), ("B", 0.3, -0.02), ("C", 0.2, 0.05))]
    held = spark.createDataFrame(rows, "t int, asset string, weight double, ret double")
    bench = held.withColumn("weight", F.lit(1 / 3))
    sectors = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y")], "asset string, sector string")
    every = {(r.t, r.sector): r.total for r in portfolio.brinson_fachler(held, bench, sectors, ["t"]).collect()}
    for t in (1, 2):
        one = {r.sector: r.total for r in portfolio.brinson_fachler(held.where(F.col("t") == t), bench.where(F.col("t") == t), sectors).collect()}
        assert one.keys() == {"x", "y", None} and all(abs(every[t, k] - v) < 1e-12 for k, v in one.items())


def test_rounding_decides_no_front(spark):
    f = np.random.default_rng(2).normal(0.01, 0.05, 60)
    same = {k: np.random.default_rng(n).permutation(f).tolist() for n, k in enumerate("ABCDEF")}  # equal means and risks, summed in other orders
    assert assets(portfolio.select_non_dominated(returns_from_mapping(spark, same | {"G": (f - 0.02).tolist()}))) == list("ABCDEF")


def test_rounding_drops_no_asset(spark):
    f, g = np.random.default_rng(2).normal(0.01, 0.05, (2, 60))
    scaled = {k: (f * (n + 1) / 3).tolist() for n, k in enumerate("ABCDEF")}  # correlations of one
    assert assets(portfolio.drop_highly_correlated(returns_from_mapping(spark, scaled | {"G": g.tolist()}), threshold=0.5)) == ["F", "G"]


def test_rounding_decides_no_subset(spark):
    f, g = np.random.default_rng(3).normal(0.01, 0.05, (2, 60))
    copies = {k: (f * (1 + 1e-15 * n)).tolist() for n, k in enumerate("ABCDE")}
    held = weights(allocation.cardinality_constrained(returns_from_mapping(spark, copies | {"G": g.tolist()}), max_assets=3))
    assert [k for k, w in held.items() if w > 0] == ["A", "G"] and abs(sum(held.values()) - 1) < 1e-6
