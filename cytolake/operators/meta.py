"""Meta-analysis of many studies: one row per (study, gene) with a p-value and an effect."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import average_rank, minus_log, need, ratio
from ..functions.special import cauchy_upper, chi2_upper_even, normal_quantile, normal_upper, t_two_sided


def study_ranks(results: DataFrame, p: str = "p_val", effect: str = "log_fc", study: str = "study") -> DataFrame:
    """Up and down ranks within each study, over its number of rows; null where p or effect is."""
    need(results, study, p, effect)
    from pyspark.sql import Window as W

    rows = F.count(F.lit(1)).over(W.partitionBy(study))
    strength = minus_log(F.col(p)) * F.signum(effect)
    r = results.withColumn("_l", strength)
    up, down = average_rank(F.col("_l"), [study]), average_rank(-F.col("_l"), [study])
    return r.withColumn("up_rank", up / rows).withColumn("down_rank", down / rows).drop("_l")


def combine_ranks(ranked: DataFrame, method: str = "RankProd", gene: str = "gene", study: str = "study", p: str = "p_val", effect: str = "log_fc", level: float = 0.05) -> DataFrame:
    """One row per gene: direction, median effect on that side, combined and signed rank, and study counts.

    A tie of directions counts as positive; zero effects belong to neither side.
    """
    if method not in ("RankProd", "RankSum"):
        raise ValueError(f"method {method!r}")
    total = ranked.select(study).distinct().agg(F.count(F.lit(1)).alias("total_study"))
    e, pv = F.col(effect), F.col(p)
    half = lambda c: F.expr(f"percentile({c}, 0.5)")
    rank = (lambda c: F.exp(F.avg(F.ln(c)))) if method == "RankProd" else half
    g = ranked.withColumn("_pos", F.when(e > 0, e)).withColumn("_neg", F.when(e < 0, e)).groupBy(gene).agg(
        F.count("_pos").alias("_np"), F.count("_neg").alias("_nn"), F.count(effect).alias("available_study"), half("_pos").alias("_mp"), half("_neg").alias("_mn"),
        rank("up_rank").alias("_up"), rank("down_rank").alias("_down"), F.sum(F.signum(e)).alias("_s"),
        F.count(F.when((pv <= level) & (e >= 0), 1)).alias("_sp"), F.count(F.when((pv <= level) & (e <= 0), 1)).alias("_sn"),
    )
    up = F.col("_np") >= F.col("_nn")
    median = F.when(up, F.col("_mp")).otherwise(F.col("_mn"))
    combined = F.when(up, F.col("_up")).otherwise(F.col("_down"))
    sig = F.when(F.coalesce("_s", F.lit(0.0)) >= 0, F.col("_sp")).otherwise(F.col("_sn"))
    return g.crossJoin(F.broadcast(total)).select(  # total: one row
        gene, F.when(up, "positive").otherwise("negative").alias("direction"), median.alias("median_es"), combined.alias("rank"), (F.signum(median) * combined).alias("signed_rank"),
        "total_study", "available_study", sig.alias("sig_study_number"), ratio(sig, F.col("available_study")).alias("sig_study_ratio"),
    )


def combine_p(results: DataFrame, method: str = "fisher", gene: str = "gene", study: str = "study", p: str = "p_val", effect: str = "log_fc", min_num: int = 5, min_ratio: float = 0.8) -> DataFrame:
    """One row per gene: p-values of the majority side combined; 1 where too few studies agree. Ties go to the positive side.

    ``available_study`` counts studies with a p-value, ``sig_study`` those of them on the majority side. A p-value without
    an effect is available and on neither side; the mean effect is over all effects.
    """
    if method not in ("fisher", "z.transform", "logit"):
        raise ValueError(f"method {method!r}")
    total = results.select(study).distinct().agg(F.count(F.lit(1)).alias("total_study"))
    rows = results.withColumn("_log", -F.ln(p))
    if method == "z.transform":
        rows = rows.withColumn("_log", -normal_quantile(F.col(p)))
    elif method == "logit":
        rows = rows.withColumn("_log", -F.ln(F.col(p) / (1 - F.col(p))))
    known = F.col(p).isNotNull()
    up, down = known & (F.col(effect) > 0), known & (F.col(effect) < 0)
    one = lambda c, v: F.when(c, v)
    g = rows.groupBy(gene).agg(
        F.count(p).alias("available_study"), F.count(one(up, 1)).alias("_np"), F.count(one(down, 1)).alias("_nn"),
        F.sum(one(up, F.col("_log"))).alias("_lp"), F.sum(one(down, F.col("_log"))).alias("_ln"), F.avg(effect).alias("mean_es"),
    )
    side = F.col("_np") >= F.col("_nn")
    k, s = F.when(side, F.col("_np")).otherwise(F.col("_nn")), F.when(side, F.col("_lp")).otherwise(F.col("_ln"))
    g = g.withColumn("_k", k).withColumn("_sum", s)
    enough = (F.col("available_study") >= min_num) & (F.col("_k") >= F.col("available_study") * min_ratio) & (F.col("_k") > 0)
    g = g.withColumn("_ok", enough).withColumn("_kk", F.col("_k").cast("double"))
    if method == "fisher":
        value = chi2_upper_even(2 * F.col("_sum"), F.col("_k"))
    elif method == "z.transform":
        value = normal_upper(F.col("_sum") / F.sqrt("_kk"))
    else:
        t = F.col("_sum") * F.sqrt(3 * (5 * F.col("_kk") + 4) / (F.col("_kk") * F.pi() * F.pi() * (5 * F.col("_kk") + 2)))
        two = t_two_sided(t, 5 * F.col("_kk") + 4)
        value = F.when(t >= 0, two / 2).otherwise(1 - two / 2)
    return g.crossJoin(F.broadcast(total)).select(  # total: one row
        gene, "total_study", "available_study", F.col("_k").alias("sig_study"), ratio(F.col("_k"), F.col("available_study")).alias("percent_same_dir"), "mean_es",
        F.when(F.col("_ok"), value).otherwise(F.lit(1.0)).alias("combined_p"),
    )


def cauchy_statistic(p: Column) -> Column:
    return F.when(p < 1e-15, 1 / (p * F.pi())).otherwise(F.tan((0.5 - p) * F.pi()))


def acat(df: DataFrame, p: str, by: list[str], weight: str | None = None, check: bool = True) -> DataFrame:
    """Cauchy combination of the p-values of each group; null, p outside [0, 1] and both 0 and 1 in a group are errors."""
    need(df, p, *by)
    x = F.col(p)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    g = df.groupBy(*by).agg(
        F.try_divide(F.sum(w * cauchy_statistic(F.when((x > 0) & (x < 1), x))), F.sum(w)).alias("_stat"),
        F.max(F.when(x == 0, 1).otherwise(0)).alias("_zero"), F.max(F.when(x == 1, 1).otherwise(0)).alias("_one"),
        F.max(F.when(x.isNull() | F.isnan(x) | (x < 0) | (x > 1) | (w < 0), 1).otherwise(0)).alias("_bad"), F.sum(w).alias("_w"),
    )
    value = F.when(F.col("_zero") == 1, 0.0).when(F.col("_one") == 1, 1.0).otherwise(cauchy_upper(F.col("_stat")))
    if check:
        wrong = (F.col("_bad") == 1) | ((F.col("_zero") == 1) & (F.col("_one") == 1)) | (F.col("_w") <= 0)
        value = F.when(wrong, F.raise_error(F.lit("p-values must be in [0, 1] without nulls, not both 0 and 1; weights not negative, with a positive sum")).cast("double")).otherwise(value)
    return g.select(*by, value.alias("p_value"))


@dataclass(frozen=True)
class NullModel:
    """An outcome without any variant: ``rows`` has (ind, residual, _v, _x0 = 1, _x1, ...), ``_v`` each outcome's variance up to ``sigma2``."""

    binary: bool
    n: int
    coefficients: tuple[float, ...]
    sigma2: float
    inverse: tuple[tuple[float, ...], ...]  # of the sums of products of covariates, weighted by _v
    rows: DataFrame

    @property
    def width(self) -> int:
        return len(self.coefficients)

    def explained(self, products: list[Column]) -> Column:
        """What the covariates explain of a variant, from its products with them."""
        out = F.lit(0.0)
        for i, x in enumerate(products):
            for j, y in enumerate(products):
                out = out + F.lit(float(self.inverse[i][j])) * x * y
        return out


def null_model(pheno: DataFrame, covariates: list[str] | None = None, rounds: int = 50) -> NullModel:
    """Linear, or logistic where every outcome is 0 or 1, on an intercept and the covariates; rows with a null among these go.

    Both are fitted from sums over all rows: one pass of normal equations, or one for each Newton step. Only these sums,
    as many as covariates squared, reach the driver.
    """
    names = list(covariates or [])
    need(pheno, "ind", "y", *names)
    rows = pheno.select("ind", F.col("y").cast("double").alias("_y"), F.lit(1.0).alias("_x0"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names, 1)]).dropna()
    x = [F.col(f"_x{i}") for i in range(len(names) + 1)]

    def products(weight: Column, target: Column) -> tuple[np.ndarray, np.ndarray]:
        sums = rows.agg(*[F.sum(weight * a * b) for i, a in enumerate(x) for b in x[i:]], *[F.sum(target * a) for a in x]).first()
        whole, at = np.zeros((len(x), len(x))), 0
        for i in range(len(x)):
            for j in range(i, len(x)):
                whole[i, j] = whole[j, i] = sums[at] or 0.0
                at += 1
        return whole, np.array([v or 0.0 for v in sums[at:]])

    n, odd = rows.agg(F.count(F.lit(1)), F.count(F.when(~F.col("_y").isin(0.0, 1.0), 1))).first()
    if n <= len(x):
        raise ValueError(f"{n} rows for {len(x)} coefficients")
    dot = lambda b: sum((F.lit(float(w)) * a for w, a in zip(b, x, strict=True)), F.lit(0.0))
    if odd:
        whole, target = products(F.lit(1.0), F.col("_y"))
        beta = np.linalg.solve(whole, target)
        done = rows.withColumn("residual", F.col("_y") - dot(beta)).withColumn("_v", F.lit(1.0))
        sigma2 = done.agg(F.sum(F.col("residual") * F.col("residual"))).first()[0] / (n - len(x))
    else:
        beta, sigma2 = np.zeros(len(x)), 1.0
        for _ in range(rounds):
            p = 1 / (1 + F.exp(-dot(beta)))
            whole, target = products(p * (1 - p), F.col("_y") - p)
            step = np.linalg.solve(whole, target)
            beta = beta + step
            if np.abs(step).max() < 1e-10:
                break
        p = 1 / (1 + F.exp(-dot(beta)))
        whole, _ = products(p * (1 - p), F.col("_y"))
        done = rows.withColumn("residual", F.col("_y") - p).withColumn("_v", p * (1 - p))
    inverse = np.linalg.inv(whole)
    return NullModel(not odd, n, tuple(map(float, beta)), float(sigma2), tuple(tuple(map(float, r)) for r in inverse), done.select("ind", "residual", "_v", *[f"_x{i}" for i in range(len(x))]))


def _scored(geno: DataFrame, null: NullModel) -> DataFrame:
    """Per variant: minor allele count and frequency, score and its variance (up to sigma2 in the linear case)."""
    need(geno, "ind", "snp", "dosage")
    g, v = F.col("dosage").cast("double"), F.col("_v")
    sums = geno.join(null.rows, "ind").groupBy("snp").agg(
        F.sum(g).alias("_s"), F.sum(g * F.col("residual")).alias("_u"), F.sum(g * g * v).alias("_gg"), *[F.sum(g * v * F.col(f"_x{i}")).alias(f"_p{i}") for i in range(null.width)]
    )
    spread = F.col("_gg") - null.explained([F.col(f"_p{i}") for i in range(null.width)])
    return sums.select("snp", F.col("_s").cast("long").alias("mac"), (F.col("_s") / (2 * null.n)).alias("maf"), "_u", spread.alias("_var"))


def marginal_tests(geno: DataFrame, null: NullModel) -> DataFrame:
    """Score test of each variant: t with n - 1 - coefficients degrees of freedom, or the normal z of a binary outcome; with p."""
    s = _scored(geno, null)
    if null.binary:
        z = ratio(F.abs("_u"), F.sqrt(F.greatest(F.lit(0.0), F.col("_var"))))
        return s.select("snp", "mac", "maf", z.alias("statistic")).withColumn("p_value", 2 * normal_upper(F.col("statistic")))
    df, total = null.n - 1 - null.width, null.sigma2 * (null.n - null.width)
    part = F.when(F.col("_var") <= 0, 0.0).otherwise(ratio(F.col("_u") * F.col("_u"), F.col("_var")))
    t = F.sqrt(F.greatest(F.lit(0.0), ratio(part, (total - part) / df)))
    return s.select("snp", "mac", "maf", t.alias("statistic")).withColumn("p_value", t_two_sided(F.col("statistic"), F.lit(float(df))))


def _beta_weight(maf: Column, a: float, b: float) -> Column:
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return scale * F.pow(maf, F.lit(a - 1)) * F.pow(1 - maf, F.lit(b - 1))


def burden_test(geno: DataFrame, null: NullModel, weights: DataFrame | None = None, beta: tuple[float, float] = (1.0, 25.0), weighted: bool = True) -> DataFrame:
    """One row (q, p_value): the score test of the weighted sum of variants. Weights are given (snp, weight), beta densities of the frequency, or 1."""
    from ..functions.special import chi2_upper_one

    if weights is None:
        maf = geno.groupBy("snp").agg((F.sum(F.col("dosage").cast("double")) / (2 * null.n)).alias("_maf"))
        weights = maf.select("snp", (_beta_weight(F.col("_maf"), *beta) if weighted else F.lit(1.0)).alias("weight"))
    summed = geno.join(weights.select("snp", "weight"), "snp").groupBy("ind").agg(F.sum(F.col("dosage") * F.col("weight")).alias("dosage")).withColumn("snp", F.lit(0))
    s = _scored(summed, null)
    return s.select(ratio(F.col("_u") * F.col("_u"), F.lit(null.sigma2) * F.col("_var")).alias("q")).withColumn("p_value", chi2_upper_one(F.col("q")))


def acat_v_test(geno: DataFrame, null: NullModel, weights: DataFrame | None = None, beta: tuple[float, float] = (1.0, 25.0), mac_thresh: int = 10) -> DataFrame:
    """One row: Cauchy combination of the tests of variants above ``mac_thresh`` and a burden test of the others.

    Where there are both, p-values of 1 go; among common variants alone, one p-value of 1 makes the result 1.

    Without given weights (snp, weight) they are squared ratios of beta densities of the frequency; the burden test counts
    with the mean frequency, or the mean weight, of its variants.
    """
    tests = marginal_tests(geno, null).filter("mac > 0")
    if weights is None:
        tests = tests.withColumn("weight", F.lit(None).cast("double"))
    else:
        tests = tests.join(weights.select("snp", "weight"), "snp")
    density = lambda m: F.pow(_beta_weight(m, *beta) / _beta_weight(m, 0.5, 0.5), F.lit(2.0))
    common = tests.filter(F.col("mac") > mac_thresh).select("p_value", F.coalesce("weight", density(F.col("maf"))).alias("weight"))
    rare = tests.filter(F.col("mac") <= mac_thresh)
    given = None if weights is None else weights
    pooled = burden_test(geno.join(rare.select("snp"), "snp", "left_semi"), null, given, beta).select("p_value")
    mean = rare.agg(F.avg("maf").alias("_maf"), F.avg("weight").alias("_w"))
    pooled = pooled.crossJoin(F.broadcast(mean)).select("p_value", F.coalesce("_w", density(F.col("_maf"))).alias("weight"))  # one row each
    kinds = tests.agg(F.count_if(F.col("mac") > mac_thresh).alias("_common"), F.count_if(F.col("mac") <= mac_thresh).alias("_rare"))
    both = common.unionByName(pooled).crossJoin(F.broadcast(kinds)).filter("p_value IS NOT NULL AND (p_value < 1 OR _common = 0 OR _rare = 0)").withColumn("_all", F.lit(1))  # one row
    return acat(both, "p_value", ["_all"], "weight").select("p_value")
