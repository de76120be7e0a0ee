import numpy as np
import pytest

from spanwright.llm import soft_mixing as sm

SCHEMA = "n_tokens long, p0 double, p1 double, p2 double, p3 double"


@pytest.mark.parametrize("pure", [True, False])
def test_targets_of_rare_domains_are_met(spark, pure):
    rng = np.random.default_rng(0)
    p = np.eye(4)[rng.choice(4, 4000, p=[0.6, 0.25, 0.14, 0.01])]
    if not pure:
        p = 0.9 * p + 0.1 * rng.dirichlet([0.3] * 4, len(p))
    tokens = rng.integers(20, 400, len(p))
    goal = np.array([0.4, 0.2, 0.2, 0.2]) * tokens.sum()
    members = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tokens, p)], SCHEMA)
    mixture = sm.fit_rates(members, tuple("abcd"), goal)
    rate = np.array([r[0] for r in members.select(mixture.rate()).collect()])
    assert (rate >= 0).all()
    assert np.abs((rate * tokens) @ p - goal).max() <= 1.01e-4 * tokens.sum()
    assert np.allclose(mixture.reached, (rate * tokens) @ p)


def test_targets_out_of_reach_are_told(spark):
    members = spark.createDataFrame([(10, 0.5, 0.5, 0.0, 0.0), (10, 0.0, 0.0, 0.5, 0.5)], SCHEMA)
    with pytest.warns(UserWarning, match="no rates meet the targets"):
        mixture = sm.fit_rates(members, tuple("abcd"), np.array([12.0, 0.0, 4.0, 4.0]))
    assert np.allclose(mixture.reached, [6, 6, 4, 4], atol=0.01)
