"""Negative-binomial models: closed forms, brute-force likelihoods, planted genes and batches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.functions import special
from cytolake.functions.order import quantiles
from cytolake.operators import count_models as cm


def test_gamma_functions_and_tails():
    x = np.array([1e-3, 0.5, 1.0, 2.5, 6.999, 7.0, 30.0, 1e5, 1e8])
    assert special.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)
    assert special.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-12) and special.trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-12)
    assert special.trigamma_inverse(special.trigamma(3.7)) == pytest.approx(3.7) and special.trigamma_inverse(0.0) == math.inf
    assert special.chi2_upper(np.array([3.841458820694124, 0.0, 1e-9]), 1.0) == pytest.approx([0.05, 1.0, math.erfc(math.sqrt(5e-10))], abs=1e-9)
    assert special.chi2_upper(np.array([9.487729036781154, 50.0]), 4.0) == pytest.approx([0.05, math.exp(-25) * 26], rel=1e-8)
    assert special.f_upper(np.array([4.964602743730711]), 1.0, np.array([10.0])) == pytest.approx([0.05], abs=1e-9)
    assert special.f_upper(np.array([3.841458820694124]), 1.0, np.array([np.inf])) == pytest.approx([0.05], abs=1e-9)


def test_quantiles(spark):
    rng = np.random.default_rng(0)
    data = {"a": rng.integers(0, 9, 300).astype(float), "b": rng.normal(size=7), "c": np.array([4.0]), "d": np.full(500, 2.0)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None), ("e", None)], "g string, v double")
    got = {r.g: (r.low, r.mid, r.high) for r in quantiles(df, ["g"], "v", {"low": 0.01, "mid": 0.5, "high": 0.98}).collect()}
    for g, vs in data.items():
        assert got[g] == pytest.approx(np.quantile(vs, [0.01, 0.5, 0.98]))
    assert quantiles(df, [], "v", {"m": 0.5}).first()[0] == pytest.approx(np.median(np.concatenate(list(data.values()))))


def simulated(rng, genes, x, alpha, log_mean, fold):
    """Counts (gene, sample): mean scale * exp(log_mean + fold x), gamma-Poisson."""
    scale = rng.uniform(0.6, 1.6, len(x))
    mu = scale * np.exp(log_mean[:, None] + fold @ x.T)
    return scale, rng.poisson(mu * rng.gamma(1 / alpha[:, None], alpha[:, None], mu.shape))


def test_poisson_limit_is_closed_form():
    rng = np.random.default_rng(1)
    g = np.repeat([0.0, 1.0], [5, 7])
    x, scale = np.column_stack([np.ones(12), g]), rng.uniform(0.5, 2, 12)
    k = rng.poisson(80, (30, 12)).astype(float)
    beta, mu, cov = cm.fit_means(k, scale, x, np.full(30, 1e-12))
    rate = lambda own: k[:, own].sum(axis=1) / scale[own].sum()
    assert beta[:, 1] == pytest.approx(np.log(rate(g == 1) / rate(g == 0)), abs=1e-5)
    assert np.sqrt(cov[:, 1, 1]) == pytest.approx(np.sqrt(1 / k[:, g == 1].sum(axis=1) + 1 / k[:, g == 0].sum(axis=1)), rel=1e-4)


def test_fit_solves_the_score_equations_and_dispersion_the_likelihood():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(10), np.arange(10) % 2, np.arange(10) // 5])
    alpha = np.array([0.02, 0.1, 0.7, 2.0])
    scale, k = simulated(rng, 4, x[:, 1:], alpha, np.full(4, 5.0), np.zeros((4, 2)))
    _, mu, _ = cm.fit_means(k.astype(float), scale, x, alpha, ridge=0.0)
    assert np.abs(((k - mu) / (1 + alpha[:, None] * mu)) @ x).max() < 1e-5

    def brute(a, row):
        own = sum(math.lgamma(c + 1 / a) - math.lgamma(1 / a) - c * math.log1p(1 / a / m) - math.log1p(a * m) / a for c, m in zip(k[row], mu[row]))
        w = 1 / (1 / mu[row] + a)
        return own - 0.5 * math.log(np.linalg.det((x * w[:, None]).T @ x))

    assert cm.adjusted(k.astype(float), mu, alpha, x) == pytest.approx([brute(a, r) for r, a in enumerate(alpha)], abs=1e-6)
    best = cm.best_dispersion(lambda a: cm.adjusted(k.astype(float), mu, a, x), 4, 10.0)
    grid = np.exp(np.linspace(math.log(1e-8), math.log(10), 4000))
    for row in range(4):
        assert brute(best[row], row) >= max(brute(a, row) for a in grid) - 1e-6


def long(spark, k, drop_zeros=True):
    return spark.createDataFrame([(f"g{i}", f"s{j}", float(v)) for (i, j), v in np.ndenumerate(k) if v or not drop_zeros], "gene string, sample string, value double")


def test_planted_genes_and_batches(spark):
    rng = np.random.default_rng(3)
    n, s = 240, 12
    group, batch = np.arange(s) % 2, np.arange(s) // 6
    x = np.column_stack([group, batch]).astype(float)
    mean = rng.uniform(3, 8, n)
    alpha = 0.05 + 2 / np.exp(mean)
    fold = np.zeros((n, 2))
    fold[:20, 0] = np.where(np.arange(20) % 2, 1.6, -1.6)
    fold[20:40, 1] = 1.6
    _, k = simulated(rng, n, x, alpha, mean, fold)
    k[-1] = 0
    counts = long(spark, k).unionByName(spark.createDataFrame([("g239", "s0", 0.0), ("g5", "unknown", 7.0)], "gene string, sample string, value double"))
    samples = spark.createDataFrame([(f"s{j}", f"c{group[j]}", f"b{batch[j]}") for j in range(s)], "sample string, group string, batch string")
    got = {r.gene: r for r in cm.differential(counts, samples, "c0", batch=True).collect()}
    assert len(got) == n and got["g239"].p_value is None and got["g239"].base_mean == 0 and got["g0"].term == "group_c1"
    assert sum(got[f"g{i}"].p_adj < 0.05 for i in range(20)) >= 19
    assert np.mean([abs(got[f"g{i}"].log2_fc - fold[i, 0] / math.log(2)) for i in range(20)]) < 0.4
    null = [got[f"g{i}"].p_value for i in range(20, n - 1)]
    assert np.mean(np.array(null) < 0.05) < 0.1 and np.mean(np.array(null) < 0.5) == pytest.approx(0.5, abs=0.12)
    truth = np.array([got[f"g{i}"].dispersion / alpha[i] for i in range(n - 1)])
    assert 0.7 < np.median(truth) < 1.4
    swapped = samples.select("sample", F.col("batch").alias("group"))
    alone = {r.gene: r.p_adj for r in cm.differential(counts, swapped, "b0", test="LRT").collect()}
    assert sum(alone[f"g{i}"] < 0.05 for i in range(20, 40)) >= 18 and sum(alone[f"g{i}"] < 0.05 for i in range(40, n - 1)) < 12


def test_three_groups_have_a_row_each(spark):
    rng = np.random.default_rng(4)
    k = rng.poisson(50, (20, 9))
    samples = spark.createDataFrame([(f"s{j}", "abc"[j % 3]) for j in range(9)], "sample string, group string")
    rows = cm.differential(long(spark, k), samples, "b").collect()
    assert sorted({r.term for r in rows}) == ["group_a", "group_c"] and len(rows) == 40


def test_designs_that_cannot_be_fitted(spark):
    counts = long(spark, np.full((3, 4), 9))
    samples = lambda groups: spark.createDataFrame([(f"s{j}", g, g) for j, g in enumerate(groups)], "sample string, group string, batch string")
    for groups, options in (("aaaa", {}), ("aabb", {"reference": "z"}), ("aabb", {"batch": True}), ("abcd", {}), ("aabb", {"test": "score"})):
        with pytest.raises(ValueError):
            cm.differential(counts, samples(groups), **options)
    with pytest.raises(Exception, match="several counts"):
        cm.differential(counts.unionByName(counts.limit(1)), samples("aabb")).collect()


def test_trend_sums_agree_in_both_places(spark, monkeypatch):
    rng = np.random.default_rng(6)
    mean = rng.uniform(1, 500, 300)
    own = (0.06 + 3 / mean) * rng.gamma(4, 0.25, 300)
    genes = spark.createDataFrame([(float(m), float(a)) for m, a in zip(mean, own)], "base_mean double, own double")
    few = cm.fit_trend(genes, 8)
    monkeypatch.setattr(cm, "FEW", 10)
    many = cm.fit_trend(genes, 8)
    assert (few.rest, few.slope, few.scatter, few.prior) == pytest.approx((many.rest, many.slope, many.scatter, many.prior))
    assert few.rest == pytest.approx(0.06, rel=0.3) and few.slope == pytest.approx(3, rel=0.3)
