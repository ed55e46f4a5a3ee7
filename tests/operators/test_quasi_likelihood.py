"""Quasi-likelihood tests: normalisation factors, grids, shared variances, planted genes."""

import math

import numpy as np
import pytest

from cytolake.operators import expression
from cytolake.operators import quasi_likelihood as ql
from test_count_models import long, simulated


def test_normalisation_factors(spark):
    rng = np.random.default_rng(1)
    base = rng.uniform(20, 400, 80)
    k = np.round(np.column_stack([base, 2 * base, base, 3 * base]))
    k[:8, 3] *= 12  # a few genes swell one library; the factor makes up for them
    k[70:, 1] = 0
    counts = long(spark, k)
    share = k / k.sum(axis=0)
    upper = np.quantile(share, 0.75, axis=0)
    assert expression.reference_sample(counts) == f"s{np.abs(upper - upper.mean()).argmin()}"
    f = {r.sample: r for r in expression.normalisation_factors(counts).collect()}
    assert math.prod(r.factor for r in f.values()) == pytest.approx(1.0) and f["s3"].library == k[:, 3].sum()
    effective = np.array([f[f"s{j}"].factor * f[f"s{j}"].library for j in range(4)])
    assert effective / effective[0] == pytest.approx([1, 2, 1, 3], rel=0.02)


def test_peak_of_a_parabola_and_deviance():
    values = -((ql.POWERS - np.array([[1.3], [-4.75], [-99.0], [99.0]])) ** 2)
    assert ql.peak(values) == pytest.approx(0.1 * 2.0 ** np.array([1.3, -4.75, -10.0, 10.0]))
    k, mu = np.array([[0.0, 3.0, 9.0]]), np.array([[1.0, 3.0, 5.0]])
    a = 0.4
    want = 2 * sum((c * math.log(c / m) if c else 0) - (c + 1 / a) * math.log((1 + a * c) / (1 + a * m)) for c, m in zip(k[0], mu[0]))
    assert ql.deviance(k, mu, np.array([a]))[0] == pytest.approx(want) and ql.deviance(mu, mu, np.array([a]))[0] == pytest.approx(0, abs=1e-12)


def test_squeeze_finds_the_prior(spark):
    rng = np.random.default_rng(2)
    n, freedom, worth = 6000, 8, 12.0
    truth = 0.7 / (rng.chisquare(worth, n) / worth)
    spread = truth * rng.chisquare(freedom, n) / freedom
    fits = spark.createDataFrame([(float(s), float(v)) for s, v in zip(spread, rng.uniform(0, 9, n))], "spread double, log_cpm double")
    variance, got = ql.squeeze(fits, freedom, np.array([2.0, 5.0, 8.0]))
    assert got == pytest.approx(worth, rel=0.25) and variance == pytest.approx([0.7] * 3, rel=0.1)
    same = spark.createDataFrame([(1.0, 1.0)] * 9, "spread double, log_cpm double")
    assert ql.squeeze(same, freedom, np.array([1.0]))[1] == math.inf


@pytest.mark.parametrize("quasi", [True, False])
def test_planted_genes(spark, quasi):
    rng = np.random.default_rng(5)
    n, s = 200, 10
    group, batch = np.arange(s) % 2, np.arange(s) // 5
    mean = rng.uniform(3, 8, n)
    fold = np.zeros((n, 2))
    fold[:16, 0] = np.where(np.arange(16) % 2, 1.7, -1.7)
    fold[16:60, 1] = 0.8
    _, k = simulated(rng, n, np.column_stack([group, batch]).astype(float), np.full(n, 0.08), mean, fold)
    k[-1] = 0
    samples = spark.createDataFrame([(f"s{j}", f"c{group[j]}", f"b{batch[j]}") for j in range(s)], "sample string, group string, batch string")
    got = {r.gene: r for r in ql.tests(long(spark, k), samples, "c0", batch=True, quasi=quasi).collect()}
    assert len(got) == n - 1 and "g199" not in got
    assert sum(got[f"g{i}"].p_adj < 0.05 for i in range(16)) >= 15
    assert np.mean([abs(got[f"g{i}"].log2_fc - fold[i, 0] / math.log(2)) for i in range(16)]) < 0.5
    null = np.array([got[f"g{i}"].p_value for i in range(16, n - 1)])
    assert np.mean(null < 0.05) < 0.11 and np.mean(null < 0.5) == pytest.approx(0.5, abs=0.13)
    assert 0.5 < np.median([r.dispersion for r in got.values()]) / 0.08 < 1.6
