"""Differential expression of counts by negative-binomial regression: dispersions with a shared trend, Wald and likelihood-ratio tests.

Counts come long (gene, sample, value); a sample that a gene lacks is a zero. Genes are independent but for three things:
size factors, the trend of dispersions over means and how far genes scatter about it. These are aggregates between two
passes over the genes; in a pass, a task takes the genes of an Arrow batch as one array. What reaches the driver is a row
for each sample, and the trend's coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import need
from ..functions.order import quantiles
from ..functions.padjust import adjust
from ..functions.special import _erfc, chi2_upper, log_gamma, trigamma
from ..session import written
from .expression import size_factors

#: Fixed values of the published method: the least dispersion, how far above the trend a gene keeps its own, the least
#: mean of a fit, the ridge on log2 coefficients, the least variance of the prior, and the genes that a trend is fitted on.
LEAST, OUTLIER, LEAST_MEAN, RIDGE, LEAST_PRIOR, TREND_RATIO = 1e-8, 2.0, 0.5, 1e-6, 0.25, (1e-4, 15.0)
_CELLS = 1 << 21  # of a slice of genes


@dataclass(frozen=True)
class Design:
    """Samples in order, what each one's counts are scaled by, the matrix of covariates, and their names; the first is the intercept."""

    samples: tuple[str, ...]
    scale: np.ndarray
    matrix: np.ndarray
    terms: tuple[str, ...]

    def without(self, factor: str) -> np.ndarray:
        return self.matrix[:, [not t.startswith(factor + "_") for t in self.terms]]


def design(samples: DataFrame, scale: DataFrame, reference: str | None = None, factors: tuple[str, ...] = ("group",)) -> Design:
    """Treatment contrasts of ``factors``, the first one's against ``reference``; ``scale`` has (sample, scale)."""
    need(samples, "sample", *factors)
    rows = samples.select(F.col("sample").cast("string").alias("sample"), *[F.col(f).cast("string").alias(f) for f in factors]).dropna().distinct()
    rows = sorted(rows.join(scale.select(F.col("sample").cast("string").alias("sample"), "scale"), "sample").collect())  # a row for each sample
    names = [r["sample"] for r in rows]
    if len(set(names)) < len(names):
        raise ValueError("a sample stands in two groups")
    columns, terms = [np.ones(len(rows))], ["intercept"]
    for f in factors:
        levels = sorted({r[f] for r in rows})
        base = reference if f == factors[0] and reference is not None else levels[0] if levels else None
        if levels and base not in levels:
            raise ValueError(f"no {f} {base!r}")
        for level in levels:
            if level != base:
                columns.append(np.array([float(r[f] == level) for r in rows]))
                terms.append(f"{f}_{level}")
    matrix = np.column_stack(columns)
    if len(rows) <= matrix.shape[1] or np.linalg.matrix_rank(matrix) < matrix.shape[1]:
        raise ValueError("the design has no rest: too few samples, or factors that determine each other")
    return Design(tuple(names), np.array([float(r["scale"]) for r in rows]), matrix, tuple(terms))


def profiles(counts: DataFrame, d: Design) -> DataFrame:
    """(gene, at, value): a gene's counts other than zero, by the samples' places in the design."""
    need(counts, "gene", "sample", "value")
    places = counts.sparkSession.createDataFrame(list(zip(d.samples, range(len(d.samples)))), "sample string, _at int")
    rows = counts.select("gene", F.col("sample").cast("string").alias("sample"), F.col("value").cast("double").alias("value")).join(places, "sample").dropna(subset=["value"])
    g = rows.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("_at", "value"))).alias("_v"))  # as many as samples
    return g.select("gene", F.col("_v._at").alias("at"), F.col("_v.value").alias("value"))


def dense(at: pa.Array, value: pa.Array, width: int) -> np.ndarray:
    """(gene, sample) counts of an Arrow batch; a repeated (gene, sample) is an error."""
    out = np.zeros((len(at), width))
    sizes = np.diff(at.offsets.to_numpy())
    rows, columns = np.repeat(np.arange(len(at)), sizes), at.flatten().to_numpy()
    if len(np.unique(rows * width + columns)) < len(rows):
        raise ValueError("a gene has several counts for one sample")
    out[rows, columns] = value.flatten().to_numpy()
    return out


# ---- one batch of genes ---------------------------------------------------------------------------------------------


def log_likelihood(k: np.ndarray, mu: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Of each gene, with (gene, sample) counts and means, and a dispersion for each gene; the counts' factorials are left out."""
    a = alpha[:, None]
    r = 1 / a
    return (log_gamma(k + r) - log_gamma(np.broadcast_to(r, k.shape)) - k * np.log1p(r / mu) - r * np.log1p(a * mu)).sum(axis=1)


def adjusted(k: np.ndarray, mu: np.ndarray, alpha: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cox and Reid's adjusted profile likelihood of a dispersion: less half the log determinant of the information."""
    w = 1 / (1 / mu + alpha[:, None])
    return log_likelihood(k, mu, alpha) - 0.5 * np.linalg.slogdet(_products(w, x))[1]


def _products(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    p = x.shape[1]
    return (w @ (x[:, :, None] * x[:, None, :]).reshape(len(x), p * p)).reshape(-1, p, p)


def fit_means(k: np.ndarray, scale: np.ndarray, x: np.ndarray, alpha: np.ndarray, rounds: int = 100, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (natural logs), means and covariances by iteratively reweighted least squares, all genes at once."""
    penalty = np.eye(x.shape[1]) * ridge / np.log(2) ** 2
    start = np.linalg.lstsq(x, np.log(k / scale + 0.1).T, rcond=None)[0].T
    beta, open_ = start.copy(), np.arange(len(k))
    for _ in range(rounds):
        mu = np.maximum(scale * np.exp(np.clip(beta[open_] @ x.T, -50, 50)), LEAST_MEAN)
        w = mu / (1 + alpha[open_, None] * mu)
        z = np.log(mu / scale) + (k[open_] - mu) / mu
        fresh = np.linalg.solve(_products(w, x) + penalty, ((w * z) @ x)[:, :, None])[:, :, 0]
        moved = np.abs(fresh - beta[open_]).max(axis=1)
        beta[open_] = np.clip(fresh, -30, 30)
        open_ = open_[moved > 1e-9]
        if not len(open_):
            break
    mu = np.maximum(scale * np.exp(np.clip(beta @ x.T, -50, 50)), LEAST_MEAN)
    info = _products(mu / (1 + alpha[:, None] * mu), x)
    inverse = np.linalg.inv(info + penalty)
    return beta, mu, inverse @ info @ inverse


def best_dispersion(score, n: int, most: float, steps: int = 24) -> np.ndarray:
    """The dispersion with the greatest ``score``, for each gene: a grid over logs, then golden sections about its best point."""
    grid = np.linspace(np.log(LEAST), np.log(most), steps)
    values = np.stack([score(np.full(n, np.exp(g))) for g in grid])
    at = values.argmax(axis=0)
    low, high = grid[np.maximum(at - 1, 0)], grid[np.minimum(at + 1, steps - 1)]
    golden = (np.sqrt(5) - 1) / 2
    a, b = high - golden * (high - low), low + golden * (high - low)
    fa, fb = score(np.exp(a)), score(np.exp(b))
    for _ in range(32):
        left = fa >= fb
        low, high = np.where(left, low, a), np.where(left, b, high)
        c = np.where(left, high - golden * (high - low), low + golden * (high - low))
        fc = score(np.exp(c))
        a, b, fa, fb = np.where(left, c, b), np.where(left, a, c), np.where(left, fc, fb), np.where(left, fa, fc)
    return np.exp((low + high) / 2)


def rough_dispersion(k: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """By moments of the scaled counts."""
    q = k / scale
    m = q.mean(axis=1)
    return np.clip((q.var(axis=1, ddof=1) - m * (1 / scale).mean()) / np.maximum(m * m, 1e-300), LEAST, 10.0)


def _slices(n: int, width: int) -> Iterator[slice]:
    step = max(1, _CELLS // max(1, width))
    for a in range(0, n, step):
        yield slice(a, a + step)


def _own_dispersions(d: Design):
    most = max(10.0, len(d.samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            means, found = [], []
            whole = dense(b.column("at"), b.column("value"), len(d.samples))
            for part in _slices(len(whole), len(d.samples)):
                k = whole[part]
                alpha = np.full(len(k), np.nan)
                some = k.any(axis=1)
                if some.any():
                    _, mu, _ = fit_means(k[some], d.scale, d.matrix, rough_dispersion(k[some], d.scale))
                    alpha[some] = best_dispersion(lambda a, k=k[some], mu=mu: adjusted(k, mu, a, d.matrix), int(some.sum()), most)
                means.append((k / d.scale).mean(axis=1))
                found.append(alpha)
            own = np.concatenate([np.zeros(0), *found])
            yield pa.RecordBatch.from_arrays([b.column("gene"), b.column("at"), b.column("value"), pa.array(np.concatenate([np.zeros(0), *means])), pa.array(own, mask=np.isnan(own))], names=["gene", "at", "value", "base_mean", "own"])

    return run


@dataclass(frozen=True)
class Trend:
    """dispersion = rest + slope / mean, and the variance of the prior on its log; ``scatter`` is the genes' own."""

    rest: float
    slope: float
    scatter: float
    prior: float


#: Genes whose means and dispersions, two numbers each, are summed in one place rather than by a job for every step.
FEW = 1 << 20


def _trend_sums(used: DataFrame):
    """The sums of a gamma regression's step, over genes within ``TREND_RATIO`` of a trend: by numpy for ``FEW`` genes at most, else by Spark."""
    if used.count() <= FEW:
        got = used.select("base_mean", "own").toArrow()
        x, own = 1 / got.column("base_mean").to_numpy(), got.column("own").to_numpy()

        def few(now: tuple[float, float], before: tuple[float, float]) -> list:
            off = own / (before[0] + before[1] * x)
            kept = (off > TREND_RATIO[0]) & (off < TREND_RATIO[1])
            w = 1 / (now[0] + now[1] * x[kept]) ** 2
            return [w.sum(), (w * x[kept]).sum(), (w * x[kept] ** 2).sum(), (w * own[kept]).sum(), (w * x[kept] * own[kept]).sum(), own[kept].mean()] if kept.any() else [None]

        return few

    def many(now: tuple[float, float], before: tuple[float, float]) -> list:
        x = 1 / F.col("base_mean")
        off, w = F.col("own") / (before[0] + before[1] * x), 1 / F.pow(now[0] + now[1] * x, F.lit(2.0))
        return list(used.filter((off > TREND_RATIO[0]) & (off < TREND_RATIO[1])).agg(F.sum(w), F.sum(w * x), F.sum(w * x * x), F.sum(w * F.col("own")), F.sum(w * x * F.col("own")), F.avg("own")).first())

    return many


def fit_trend(genes: DataFrame, freedom: int) -> Trend:
    """A gamma regression of dispersions on inverse means, without genes far off it, then the spread of the rest about it.

    Where the regression leaves positive values, the mean dispersion stands in.
    """
    used = genes.filter(f"base_mean > 0 AND own > {100 * LEAST}")
    sums = _trend_sums(used)
    rest, slope, flat = 0.1, 1.0, False
    for _ in range(10):  # genes that the trend leaves out, from the trend before
        before = (rest, slope)
        for _ in range(25):
            s = sums((rest, slope), before)
            if s[0] is None:
                return Trend(1.0, 0.0, LEAST_PRIOR, LEAST_PRIOR)
            det = s[0] * s[2] - s[1] * s[1]
            now = ((s[2] * s[3] - s[1] * s[4]) / det, (s[0] * s[4] - s[1] * s[3]) / det) if det > 1e-12 * s[0] * s[2] else (-1.0, 0.0)
            flat = min(now[0], now[0] + now[1]) <= 0 or now[1] < 0
            if flat:
                rest, slope = float(s[5]), 0.0
                break
            close = abs(np.log(now[0] / rest)) + abs(np.log(max(now[1], 1e-12) / max(slope, 1e-12))) < 1e-7
            rest, slope = float(now[0]), float(now[1])
            if close:
                break
        if flat or abs(np.log(rest / before[0])) + abs(np.log(max(slope, 1e-12) / max(before[1], 1e-12))) < 1e-3:
            break
    far = used.withColumn("_r", F.ln("own") - F.ln(F.lit(rest) + F.lit(slope) / F.col("base_mean")))
    middle = quantiles(far, [], "_r", {"m": 0.5}).first()[0]
    scatter = (1.4826 * quantiles(far.withColumn("_d", F.abs(F.col("_r") - middle)), [], "_d", {"m": 0.5}).first()[0]) ** 2
    return Trend(rest, slope, scatter, max(scatter - trigamma(freedom / 2), LEAST_PRIOR))


_RESULT = "gene {kind}, term string, base_mean double, dispersion double, log2_fc double, se double, statistic double, p_value double"


def _tested(d: Design, trend: Trend, test: str):
    most = max(10.0, len(d.samples))
    factor = d.terms[1].split("_")[0] if len(d.terms) > 1 else ""
    tested = [i for i, t in enumerate(d.terms) if t.startswith(factor + "_")]

    def of(k: np.ndarray, mean: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
        shared = trend.rest + trend.slope / mean
        _, mu, _ = fit_means(k, d.scale, d.matrix, np.maximum(shared, LEAST))
        pulled = best_dispersion(lambda a: adjusted(k, mu, a, d.matrix) - (np.log(a) - np.log(shared)) ** 2 / (2 * trend.prior), len(k), most)
        alpha = np.where(np.log(own) > np.log(shared) + OUTLIER * np.sqrt(trend.scatter), own, pulled)
        beta, mu, cov = fit_means(k, d.scale, d.matrix, alpha)
        fc, se = beta / np.log(2), np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0)) / np.log(2)
        if test == "Wald":
            stat = fc / se
            p = _erfc(np.abs(stat) / np.sqrt(2))
        else:
            less = d.without(factor)
            _, null, _ = fit_means(k, d.scale, less, alpha)
            gain = np.maximum(0, 2 * (log_likelihood(k, mu, alpha) - log_likelihood(k, null, alpha)))
            stat = np.repeat(gain[:, None], len(d.terms), axis=1)
            p = chi2_upper(stat, float(d.matrix.shape[1] - less.shape[1]))
        return alpha, fc, se, stat, p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.num_rows, len(tested)
            mean, own = b.column("base_mean").to_numpy(), b.column("own").to_numpy(zero_copy_only=False)
            whole = dense(b.column("at"), b.column("value"), len(d.samples))
            out = {c: np.full((n, m), np.nan) for c in ("dispersion", "log2_fc", "se", "statistic", "p_value")}
            for part in _slices(n, len(d.samples)):
                some = part.start + np.flatnonzero(~np.isnan(own[part]))
                if len(some):
                    alpha, fc, se, stat, p = of(whole[some], mean[some], own[some])
                    for c, x in (("dispersion", np.repeat(alpha[:, None], len(d.terms), axis=1)), ("log2_fc", fc), ("se", se), ("statistic", stat), ("p_value", p)):
                        out[c][some] = x[:, tested]
            column = lambda x: pa.array(x.ravel(), mask=np.isnan(x.ravel()))
            genes = b.column("gene").take(pa.array(np.repeat(np.arange(n), m)))
            yield pa.RecordBatch.from_arrays([genes, pa.array([d.terms[i] for i in tested] * n, pa.string()), pa.array(np.repeat(mean, m)), *[column(x) for x in out.values()]], names=["gene", "term", "base_mean", *out])

    return run


def differential(counts: DataFrame, samples: DataFrame, reference: str | None = None, batch: bool = False, test: str = "Wald", adjust_by: str = "bh", factors: DataFrame | None = None) -> DataFrame:
    """(gene, term, base_mean, dispersion, log2_fc, se, statistic, p_value, p_adj) for every level of ``group`` against the reference.

    ``samples`` has (sample, group) and, with ``batch``, a batch, which the design then holds beside the group. Dispersions
    are drawn to their trend by the prior, but for genes far above it; ``test`` is Wald, or LRT against the design
    without the group. Genes without any count have null results. ``factors`` (sample, size_factor) may be given; else they
    are medians of ratios. Independent filtering and Cook's cut-off, which only set p-values to null, are not applied.
    """
    if test not in ("Wald", "LRT"):
        raise ValueError(f"test {test!r}")
    counts = counts.join(samples.select("sample").distinct(), "sample", "left_semi")
    sized = (size_factors(counts) if factors is None else factors).select("sample", F.col("size_factor").alias("scale"))
    d = design(samples, sized, reference, ("group", "batch") if batch else ("group",))
    if len(d.terms) == 1 or not d.terms[1].startswith("group_"):
        raise ValueError("there is one group only")
    kind = dict(counts.dtypes)["gene"]
    genes = written(profiles(counts, d).mapInArrow(_own_dispersions(d), f"gene {kind}, at array<int>, value array<double>, base_mean double, own double"), "genes")
    trend = fit_trend(genes, len(d.samples) - len(d.terms))
    found = genes.mapInArrow(_tested(d, trend, test), _RESULT.format(kind=kind))
    return adjust(found, "p_value", adjust_by, ["term"], tie="gene") if len([t for t in d.terms if t.startswith("group_")]) > 1 else adjust(found, "p_value", adjust_by, tie="gene")
