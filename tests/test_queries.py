import pytest
from parity import mismatch

from tickloom.plans import registry

SAMPLE = ["flagship", "ind_ema", "ind_supertrend", "ind_stc", "ind_dmi", "ind_cci", "ind_vwap", "ind_hurst", "cdl_engulfing", "cdl_all_long", "cov_ewma", "risk_all", "attr_brinson", "cv_combinatorial", "cert_pbo", "cert_grade_grid", "cost_capacity", "sel_non_dominated", "qubo_brute_force", "src_long_returns",
    "cov_denoise_mp", "cov_factor_model", "cov_oracle_approximating", "risk_entropic_tails", "alloc_max_sharpe", "alloc_robust_mvo", "alloc_risk_parity", "alloc_hierarchical_risk_parity", "alloc_cardinality", "alloc_alpha_risk_cost",
    "attr_factor", "factor_fundamental", "cv_summary", "cert_sharpe_significance", "entropy_pooling", "sel_uncorrelated", "est_hrp", "cost_model", "latest_sma", "stream_hourly", "ind_mcginley",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, small, name):
    assert mismatch(spark, small, registry.QUERIES[name], registry.SQL[name]) == []


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
    assert len([q for q in registry.QUERIES if q.startswith("ind_")]) == 91
    assert len([q for q in registry.QUERIES if q.startswith("cdl_")]) == 62


def test_entry_imports():
    import __spark_entry__

    assert {"flagship", "ind_rsi"} <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
