"""Expression matrices in long form (gene, sample, value): lengths, normalisation and size factors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import need, ratio, zscore
from ..functions.order import quantiles
from ..functions.products import pair_sums


def keep_genes(counts: DataFrame, genes: DataFrame, gene: str = "gene") -> DataFrame:
    """Rows whose gene is in the list."""
    need(counts, gene)
    need(genes, gene)
    return counts.join(genes.select(gene).distinct(), gene, "left_semi")


def transcript_length(transcripts: DataFrame, gene: str = "gene", length: str = "tx_len") -> DataFrame:
    """Longest transcript of each gene."""
    need(transcripts, gene, length)
    return transcripts.groupBy(gene).agg(F.max(length).cast("long").alias("length"))


def exon_union_length(exons: DataFrame, gene: str = "gene", start: str = "start", end: str = "end") -> DataFrame:
    """Bases that the exons of a gene cover; overlapping and adjacent exons count once."""
    need(exons, gene, start, end)
    order = W.partitionBy(gene).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0)
    island = F.sum("_fresh").over(order.rowsBetween(W.unboundedPreceding, 0))
    spans = exons.dropna(subset=[start, end]).withColumn("_fresh", fresh).withColumn("_island", island).groupBy(gene, "_island").agg(F.min(start).alias("_s"), F.max(end).alias("_e"))
    return spans.groupBy(gene).agg(F.sum(F.col("_e") - F.col("_s") + 1).cast("long").alias("length"))


def tpm(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """Transcripts per million; genes without a length go before the sums are taken."""
    rates = counts.join(lengths.select("gene", "length").dropna(), "gene").withColumn("_rate", ratio(F.col("value"), F.col("length")))
    return rates.select("gene", "sample", (ratio(F.col("_rate"), F.sum("_rate").over(W.partitionBy("sample"))) * 1e6).alias("value"))


def rpkm(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """Reads per base of length per million reads (per base, as the toolbox that this follows has it)."""
    rows = counts.join(lengths.select("gene", "length").dropna(), "gene")
    return rows.select("gene", "sample", (ratio(ratio(F.col("value"), F.col("length")), F.sum("value").over(W.partitionBy("sample"))) * 1e6).alias("value"))


def normalize_counts(counts: DataFrame, intervals: DataFrame, method: str = "tpm", length_type: str = "transcript", symbols: DataFrame | None = None) -> DataFrame:
    """Lengths from transcripts or exons, given symbols where a table names them, then TPM or RPKM."""
    lengths = {"transcript": transcript_length, "exon": exon_union_length}.get(length_type)
    scale = {"tpm": tpm, "rpkm": rpkm}.get(method)
    if lengths is None or scale is None:
        raise ValueError(f"method {method!r} with length type {length_type!r}")
    if symbols is not None:
        intervals = intervals.join(symbols.select(F.col("gene_id").alias("gene"), "symbol"), "gene").drop("gene").withColumnRenamed("symbol", "gene")
    return scale(counts, lengths(intervals))


def size_factors(counts: DataFrame) -> DataFrame:
    """Median of ratios to the geometric mean, over genes with a count above 0 in every sample; a missing row is a zero.

    Logs are summed as decimals, whose sum does not hang on the order of rows: the quantiles read the ratios several
    times, and each reading has to give the same ones.
    """
    logs = counts.filter("value > 0").select("gene", "sample", F.ln("value").alias("_log"))
    all_ = counts.agg(F.countDistinct("sample").alias("_all"))
    whole = logs.groupBy("gene").agg(F.count(F.lit(1)).alias("_n"), (F.sum(F.col("_log").cast("decimal(28,18)")).cast("double") / F.count(F.lit(1))).alias("_mean")).crossJoin(F.broadcast(all_)).filter("_n = _all")  # one row
    ratios = logs.join(whole.select("gene", "_mean"), "gene").select("sample", F.exp(F.col("_log") - F.col("_mean")).alias("_ratio"))
    return quantiles(ratios, ["sample"], "_ratio", {"size_factor": 0.5})


def fold_changes(counts: DataFrame, groups: DataFrame, reference: str) -> DataFrame:
    """Base mean of size-factor-normalised counts, and log2 of group means over the reference group's."""
    need(groups, "sample", "group")
    rows = counts.join(size_factors(counts), "sample").join(groups, "sample").withColumn("_v", F.col("value") / F.col("size_factor"))
    means = rows.groupBy("gene", "group").agg(F.avg("_v").alias("_m"))
    base = rows.groupBy("gene").agg(F.avg("_v").alias("base_mean"))
    ref = means.filter(F.col("group") == reference).select("gene", F.col("_m").alias("_r"))
    fold = F.when((F.col("_m") > 0) & (F.col("_r") > 0), F.log2(F.try_divide("_m", "_r")))
    return means.filter(F.col("group") != reference).join(ref, "gene").join(base, "gene").select("gene", "group", "base_mean", fold.alias("log2_fc"))


def tmm_factors(counts: DataFrame, reference: str, trim_m: float = 0.3, trim_a: float = 0.05) -> DataFrame:
    """Trimmed mean of M-values against one sample, before the factors are centred on 1."""
    sized = counts.withColumn("_lib", F.sum("value").over(W.partitionBy("sample"))).filter("value > 0")
    ref = sized.filter(F.col("sample") == reference).select("gene", F.col("value").alias("_rv"), F.col("_lib").alias("_rl"))
    x, y = F.col("value") / F.col("_lib"), F.col("_rv") / F.col("_rl")
    rows = sized.join(ref, "gene").select(
        "gene", "sample", F.log2(x / y).alias("_m"), ((F.log2(x) + F.log2(y)) / 2).alias("_a"),
        ((F.col("_lib") - F.col("value")) / F.col("_lib") / F.col("value") + (F.col("_rl") - F.col("_rv")) / F.col("_rl") / F.col("_rv")).alias("_v"),
    )
    own = W.partitionBy("sample")
    n = F.count(F.lit(1)).over(own)
    for name in ("_m", "_a"):
        rows = rows.withColumn(name + "r", F.rank().over(own.orderBy(name)) + (F.count(F.lit(1)).over(W.partitionBy("sample", name)) - 1) / 2)
    low = lambda t: F.floor(n * t) + 1
    kept = rows.withColumn("_n", n).withColumn("_lm", low(trim_m)).withColumn("_la", low(trim_a))
    kept = kept.filter("_mr >= _lm AND _mr <= _n + 1 - _lm AND _ar >= _la AND _ar <= _n + 1 - _la")
    return kept.groupBy("sample").agg(F.pow(F.lit(2.0), F.try_divide(F.sum(F.col("_m") / F.col("_v")), F.sum(1 / F.col("_v")))).alias("factor"))


def reference_sample(counts: DataFrame) -> str:
    """The sample whose upper quartile of counts per library is nearest to the samples' mean; ties go to the first by name. One name reaches the driver.

    Genes without any count are left out, missing rows are zeros.
    """
    rows = counts.filter("value > 0").withColumn("_share", F.col("value") / F.sum("value").over(W.partitionBy("sample"))).select("sample", "_share", F.lit(1).alias("_t"))
    genes = counts.filter("value > 0").agg(F.countDistinct("gene").alias("_g"))
    zeros = rows.groupBy("sample").agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(genes)).select("sample", F.lit(0.0).alias("_share"), (F.col("_g") - F.col("_n")).cast("int").alias("_t"))  # one row
    upper = quantiles(rows.unionByName(zeros), ["sample"], "_share", {"q": 0.75}, "_t")
    near = upper.crossJoin(F.broadcast(upper.agg(F.avg("q").alias("_m")))).orderBy(F.round(F.abs(F.col("q") - F.col("_m")), 15), "sample").first()  # one row
    if near is None:
        raise ValueError("no counts above 0")
    return near["sample"]


def normalisation_factors(counts: DataFrame, reference: str | None = None) -> DataFrame:
    """(sample, factor, library): TMM factors, centred so that their geometric mean is 1, and library sizes."""
    raw = tmm_factors(counts, reference_sample(counts) if reference is None else reference)
    mean = raw.agg(F.exp(F.avg(F.ln("factor"))).alias("_g"))
    library = counts.groupBy("sample").agg(F.sum("value").cast("double").alias("library"))
    return raw.crossJoin(F.broadcast(mean)).join(library, "sample").select("sample", (F.col("factor") / F.col("_g")).alias("factor"), "library")  # one row


def sample_pca(counts: DataFrame, k: int = 2) -> DataFrame:
    """(sample, component, loading, proportion) on the first ``k`` components of the genes x samples matrix.

    log(x + 1), each sample scaled; genes that a sample lacks are 0. The sign of a component is such that its largest
    loading is positive. Products of samples come by blocks; one task holds a number for each pair of samples.
    """
    scaled = counts.select(F.col("sample").cast("string").alias("sample"), "gene", F.coalesce(zscore(F.log1p("value"), ["sample"]), F.lit(0.0)).alias("_z"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        place = {x: i for i, x in enumerate(names)}
        whole = np.zeros((len(names), len(names)))
        i, j = pdf["a"].map(place), pdf["b"].map(place)
        whole[i, j] = whole[j, i] = pdf["xy"]
        values, axes = np.linalg.eigh(whole)
        out = []
        for c in range(1, min(k, len(names)) + 1):
            axis = axes[:, -c] * (1 if axes[np.abs(axes[:, -c]).argmax(), -c] > 0 else -1)
            out += [(n, c, float(x), float(values[-c] / values.sum()) if values.sum() > 0 else None) for n, x in zip(names, axis, strict=True)]
        return pd.DataFrame(out, columns=["sample", "component", "loading", "proportion"])

    sums = pair_sums(scaled, "sample", "gene", "_z").select("a", "b", "xy", F.lit(0).alias("_all"))
    return sums.groupBy("_all").applyInPandas(lambda pdf: run(pdf), "sample string, component int, loading double, proportion double")
