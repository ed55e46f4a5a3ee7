"""Differential expression of counts by quasi-likelihood F tests, or likelihood-ratio tests with a dispersion for each gene.

Libraries are scaled by centred TMM factors. Every gene gives its adjusted profile likelihood on a grid of dispersions;
sums of these over ranges of abundance, smoothed over the ranges, give the trend, and together the common dispersion. The
F test fits at the trend, takes the deviance over its degrees of freedom as the gene's own variance, and draws that to
the variance of its range by the scaled-F model of Smyth. Bounds by the Poisson test and robust priors are not applied.

Genes are independent but for these sums: ``RANGES`` x ``len(GRID)`` numbers reach the driver, whatever the genes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.padjust import adjust
from ..functions.special import chi2_upper, digamma, f_upper, trigamma, trigamma_inverse
from ..session import written
from .count_models import _CELLS, Design, adjusted, dense, design, fit_means, log_likelihood, profiles
from .expression import normalisation_factors

#: Dispersions of the grid, as powers of two times 0.1; ranges of abundance, and how far their smoothing reaches.
POWERS = np.linspace(-10, 10, 21)
GRID = 0.1 * 2.0**POWERS
RANGES, REACH = 24, 4
#: Counts that are added before logs are taken, and what the shared likelihood weighs against a gene's own, in degrees of freedom.
PRIOR_COUNT, PRIOR_FREEDOM = 2.0, 10.0


def peak(values: np.ndarray) -> np.ndarray:
    """The dispersion of the greatest value of each row over the grid, by the parabola through its best three points."""
    at = np.clip(values.argmax(axis=1), 1, values.shape[1] - 2)
    row = np.arange(len(values))
    a, b, c = (values[row, at + k] for k in (-1, 0, 1))
    bend = a - 2 * b + c
    shift = np.where(bend < 0, np.clip(0.5 * (a - c) / np.where(bend < 0, bend, -1.0), -1, 1), np.where(a > c, -1.0, 1.0))
    return 0.1 * 2.0 ** (POWERS[at] + shift * (POWERS[1] - POWERS[0]))


def deviance(k: np.ndarray, mu: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    a = alpha[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.where(k > 0, k * np.log(np.where(k > 0, k, 1) / mu), 0.0)
    return np.maximum(0, 2 * (own - (k + 1 / a) * np.log((1 + a * k) / (1 + a * mu))).sum(axis=1))


def _grids(d: Design, library: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = dense(b.column("at"), b.column("value"), len(d.samples))
            likelihood = np.empty((len(k), len(GRID)))
            step = max(1, _CELLS // max(1, len(d.samples)))
            for x in range(0, len(k), step):
                part = k[x : x + step]
                for j, g in enumerate(GRID):
                    alpha = np.full(len(part), g)
                    likelihood[x : x + step, j] = adjusted(part, fit_means(part, d.scale, d.matrix, alpha, rounds=30)[1], alpha, d.matrix)
            level = np.log2(((k / d.scale).mean(axis=1) + PRIOR_COUNT) / (library + 2 * PRIOR_COUNT) * 1e6)
            yield pa.RecordBatch.from_arrays([b.column("gene"), b.column("at"), b.column("value"), pa.array(level), pa.array(list(likelihood), pa.list_(pa.float64()))], names=["gene", "at", "value", "log_cpm", "grid"])

    return run


@dataclass(frozen=True)
class Shared:
    """Ranges of abundance: their middles, and the dispersion, likelihoods and log variance that genes there share."""

    middle: np.ndarray
    likelihood: np.ndarray
    dispersion: np.ndarray
    common: float

    def at(self, level: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Values of the ranges, linear between their middles."""
        return np.interp(level, self.middle, values)


def shared_dispersions(genes: DataFrame) -> Shared:
    """Mean likelihoods of ranges of abundance, each smoothed over its neighbours by tricube weights and their numbers of genes."""
    marks = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    edges = genes.agg(F.approx_percentile("log_cpm", marks, F.lit(10_000)).alias("_edges"))
    ranged = genes.crossJoin(F.broadcast(edges)).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col("log_cpm"))))  # one row
    sums = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.avg("log_cpm").alias("m"), *[F.sum(F.get("grid", F.lit(j))).alias(f"l{j}") for j in range(len(GRID))]).orderBy("_range").collect()
    if not sums:
        raise ValueError("no gene has a count")
    n, middle = np.array([r["n"] for r in sums], float), np.array([r["m"] for r in sums])
    total = np.array([[r[f"l{j}"] for j in range(len(GRID))] for r in sums])
    apart = np.abs(np.arange(len(n))[:, None] - np.arange(len(n))) / REACH
    weight = np.where(apart < 1, (1 - np.minimum(apart, 1) ** 3) ** 3, 0.0)
    smooth = (weight @ total) / (weight @ n)[:, None]
    return Shared(middle, smooth, peak(smooth), float(peak(total.sum(axis=0)[None])[0]))


def _fitted(d: Design, shared: Shared, quasi: bool):
    freedom = len(d.samples) - d.matrix.shape[1]
    less = d.without("group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, level = dense(b.column("at"), b.column("value"), len(d.samples)), b.column("log_cpm").to_numpy()
            if quasi:
                alpha = np.exp(shared.at(level, np.log(shared.dispersion)))
            else:
                own = np.array(b.column("grid").to_pylist()).reshape(len(k), len(GRID))
                both = np.column_stack([shared.at(level, shared.likelihood[:, j]) for j in range(len(GRID))])
                alpha = peak(own + PRIOR_FREEDOM / freedom * both) if len(k) else np.zeros(0)
            out = {c: [np.zeros(0)] for c in ("fc", "gain", "spread")}
            step = max(1, _CELLS // max(1, len(d.samples)))
            for x in range(0, len(k), step):
                part, a = k[x : x + step], alpha[x : x + step]
                beta, mu, _ = fit_means(part, d.scale, d.matrix, a)
                _, null, _ = fit_means(part, d.scale, less, a)
                out["fc"].append(beta[:, 1] / math.log(2))
                out["gain"].append(np.maximum(0, 2 * (log_likelihood(part, mu, a) - log_likelihood(part, null, a))))
                out["spread"].append(deviance(part, mu, a) / freedom)
            yield pa.RecordBatch.from_arrays([b.column("gene"), b.column("log_cpm"), pa.array(alpha), *[pa.array(np.concatenate(v)) for v in out.values()]], names=["gene", "log_cpm", "dispersion", *out])

    return run


def squeeze(fits: DataFrame, freedom: int, middle: np.ndarray) -> tuple[np.ndarray, float]:
    """The variance that genes share in each range of abundance, and the degrees of freedom that it is worth: moments of log variances."""
    edges = F.array(*[F.lit(float(x)) for x in (middle[1:] + middle[:-1]) / 2]) if len(middle) > 1 else F.array().cast("array<double>")
    e = F.ln("spread") - (digamma(freedom / 2) - math.log(freedom / 2))
    rows = fits.filter("spread > 1e-12").select(F.size(F.filter(edges, lambda x: x < F.col("log_cpm"))).alias("_range"), e.alias("_e"))
    sums = {r["_range"]: r for r in rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.avg("_e").alias("m"), F.var_pop("_e").alias("v")).collect()}  # a row for each range
    known = sorted(sums)
    if not known:
        return np.ones(len(middle)), math.inf
    n = sum(sums[k]["n"] for k in known)
    within = sum(sums[k]["n"] * sums[k]["v"] for k in known) / max(1, n - len(known)) - trigamma(freedom / 2)
    worth = 2 * trigamma_inverse(within)
    mean = np.interp(np.arange(len(middle)), known, [sums[k]["m"] for k in known])
    return np.exp(mean + (digamma(worth / 2) - math.log(worth / 2) if math.isfinite(worth) and worth < 1e8 else 0.0)), worth


def tests(counts: DataFrame, samples: DataFrame, reference: str | None = None, batch: bool = False, quasi: bool = True, adjust_by: str = "bh") -> DataFrame:
    """(gene, log2_fc, log_cpm, dispersion, statistic, p_value, p_adj); the fold is that of the first level of ``group`` after the reference.

    ``statistic`` is F, or without ``quasi`` the likelihood ratio at a dispersion of each gene's own, drawn to its range's.
    Several levels are tested together. ``samples`` has (sample, group) and, with ``batch``, a batch. Genes without any
    count are left out.
    """
    counts = counts.join(samples.select("sample").distinct(), "sample", "left_semi")
    sized = normalisation_factors(counts).select("sample", (F.col("factor") * F.col("library")).alias("scale"))
    d = design(samples, sized, reference, ("group", "batch") if batch else ("group",))
    if len(d.terms) == 1 or not d.terms[1].startswith("group_"):
        raise ValueError("there is one group only")
    library = float(d.scale.mean())
    d = Design(d.samples, d.scale / library, d.matrix, d.terms)
    kind = dict(counts.dtypes)["gene"]
    genes = written(profiles(counts.filter("value > 0"), d).mapInArrow(_grids(d, library), f"gene {kind}, at array<int>, value array<double>, log_cpm double, grid array<double>"), "grids")
    shared = shared_dispersions(genes)
    fits = written(genes.mapInArrow(_fitted(d, shared, quasi), f"gene {kind}, log_cpm double, dispersion double, fc double, gain double, spread double"), "fits")
    freedom, tested = len(d.samples) - d.matrix.shape[1], sum(t.startswith("group_") for t in d.terms)
    variance, worth = squeeze(fits, freedom, shared.middle) if quasi else (np.ones(len(shared.middle)), math.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gain, level = b.column("gain").to_numpy(), b.column("log_cpm").to_numpy()
            if quasi:
                prior = np.exp(shared.at(level, np.log(variance)))
                own = prior if math.isinf(worth) else (worth * prior + freedom * b.column("spread").to_numpy()) / (worth + freedom)
                stat = gain / tested / own
                p = f_upper(stat, float(tested), np.full(len(stat), freedom + worth))
            else:
                stat, p = gain, chi2_upper(gain, float(tested))
            yield pa.RecordBatch.from_arrays([b.column("gene"), b.column("fc"), b.column("log_cpm"), b.column("dispersion"), pa.array(stat), pa.array(p)], names=["gene", "log2_fc", "log_cpm", "dispersion", "statistic", "p_value"])

    found = fits.mapInArrow(run, f"gene {kind}, log2_fc double, log_cpm double, dispersion double, statistic double, p_value double")
    return adjust(found, "p_value", adjust_by, tie="gene")
