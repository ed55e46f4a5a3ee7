"""Tests and summaries over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import average_rank, need, ratio, zscore
from ..functions.order import quantiles, running
from ..functions.padjust import adjust
from ..functions.products import pair_sums
from ..functions.special import conditional_odds_ratio, log_factorial, normal_two_sided, rank_sum_exact, signed_rank_exact, t_two_sided


def volcano_class(fc: Column, p: Column, fc_cut: float = 1.0, p_cut: float = 0.05) -> Column:
    """Higher, Lower or Unchanged."""
    return F.when((fc >= fc_cut) & (p <= p_cut), "Higher").when((fc <= -fc_cut) & (p <= p_cut), "Lower").otherwise("Unchanged")


def pair_correlations(long: DataFrame, item: str, key: str, value: str, method: str = "pearson", p_values: bool = False) -> DataFrame:
    """r and n for all pairs a <= b of items over their common keys; t and, if asked for, p.

    ``spearman`` ranks each item over its own non-null values, which equals pairwise ranking where none is missing.
    """
    need(long, item, key, value)
    rows = long.select(F.col(item).alias("a"), F.col(key).alias("_k"), F.col(value).cast("double").alias("_x")).dropna()
    if method == "spearman":
        rows = rows.withColumn("_x", average_rank(F.col("_x"), ["a"]))
    elif method != "pearson":
        raise ValueError(f"method {method!r}")
    # centred on each item's own mean, so that sums of products keep their digits
    rows = rows.withColumn("_x", F.col("_x") - F.avg("_x").over(W.partitionBy("a")))
    s = pair_sums(rows, "a", "_k", "_x")
    n = F.col("n")
    cov = F.col("xy") - F.col("sx") * F.col("sy") / n
    vx, vy = F.col("xx") - F.col("sx") * F.col("sx") / n, F.col("yy") - F.col("sy") * F.col("sy") / n
    r = F.when((vx > 1e-12) & (vy > 1e-12), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(cov, F.sqrt(vx * vy)))))
    out = s.select("a", "b", "n", r.alias("r"))
    out = out.withColumn("t", F.when((F.col("a") != F.col("b")) & (F.col("n") > 2) & (F.abs("r") < 1), F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))))
    return out.withColumn("p_value", t_two_sided(F.col("t"), (F.col("n") - 2).cast("double"))) if p_values else out


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both triangles of a table of pairs a <= b."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.unionByName(pairs.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), *rest))


def correlation_plot(long: DataFrame, item: str, key: str, value: str, method: str = "pearson", adjust_by: str = "bh", triangle: str = "whole") -> DataFrame:
    """Plot table: both triangles, p adjusted over all cells; the diagonal's p are 0.1; the other triangle's r are null."""
    cells = adjust(mirrored(pair_correlations(long, item, key, value, method, p_values=True)), "p_value", adjust_by)
    diagonal = F.col("a") == F.col("b")
    hidden = {"lower": F.col("a") < F.col("b"), "upper": F.col("a") > F.col("b"), "whole": F.lit(False)}[triangle]
    return cells.select("a", "b", "n", F.when(~hidden, F.col("r")).alias("r"), *[F.when(diagonal, 0.1).otherwise(F.col(c)).alias(c) for c in ("p_value", "p_adj")])


def network_edges(counts: DataFrame, gene: str = "gene", sample: str = "sample", value: str = "value", level: float = 0.05, regulators: DataFrame | None = None) -> DataFrame:
    """Gene pairs whose correlation of log2(x + 1) passes FDR over all cells of the matrix."""
    logs = counts.withColumn("_v", F.log2(F.col(value) + 1))
    pairs = adjust(mirrored(pair_correlations(logs, gene, sample, "_v", p_values=True)).filter("a <> b"), "p_value", "bh")
    if regulators is not None:
        pairs = pairs.join(regulators.select(F.col(gene).alias("a")).distinct(), "a", "left_semi")
    return pairs.filter(F.col("p_adj") <= level).select("a", "b", "r", "p_value", "p_adj")


def sample_correlation(counts: DataFrame) -> DataFrame:
    """Correlation of samples over genes, after log(x + 1) and scaling each sample."""
    scaled = counts.withColumn("_v", zscore(F.log1p("value"), ["sample"]))
    return pair_correlations(scaled, "sample", "gene", "_v")


def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    """For every level of x and of y the 2 x 2 table one against the rest; rows with a null in either go, empty cells stay."""
    need(df, x, y)
    rows = df.select(F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y")).dropna()
    cell = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n11"))
    xs, ys = cell.groupBy("x").agg(F.sum("n11").alias("_x")), cell.groupBy("y").agg(F.sum("n11").alias("_y"))
    all_ = cell.agg(F.sum("n11").alias("_n"))
    grid = xs.crossJoin(ys).crossJoin(F.broadcast(all_))  # levels x levels cells are the result itself
    n11 = F.coalesce("n11", F.lit(0)).cast("long")
    return grid.join(cell, ["x", "y"], "left").select("x", "y", n11.alias("n11"), (F.col("_y") - n11).alias("n01"), (F.col("_x") - n11).alias("n10"), (F.col("_n") - F.col("_x") - F.col("_y") + n11).alias("n00"))


#: Terms of a Fisher sum on each side of the mode; beyond, they are under 1e-16 of the largest while standard deviations are below a 40th of this.
_TERMS = 4000


def fisher_exact(cells: DataFrame, level: float = 0.05) -> DataFrame:
    """Two-sided Fisher p of each 2 x 2 table: all tables no likelier than the seen one; with conditional and sample odds ratios and ``sig``.

    The sum runs over the likelier tables outwards from the mode, 9 standard deviations to each side or the whole support;
    these are few thousand terms up to margins of hundred millions. Beyond, it runs in steps that keep their number, each
    term standing for a step: the sum is then exact to 1e-6 or so.
    """
    a, b, c, d = (F.col(k).cast("double") for k in ("n11", "n01", "n10", "n00"))
    row, col, n = a + b, a + c, a + b + c + d
    low, high = F.greatest(F.lit(0.0), row + col - n), F.least(row, col)

    def log_p(k: Column) -> Column:
        return -(log_factorial(k) + log_factorial(row - k) + log_factorial(col - k) + log_factorial(n - row - col + k))

    seen, base = log_p(a), log_factorial(row) + log_factorial(n - row) + log_factorial(col) + log_factorial(n - col) - log_factorial(n)
    mode = F.floor((row + 1) * (col + 1) / (n + 2))
    reach = F.ceil(9 * F.sqrt(row * col * (n - row) * (n - col) / F.greatest(n * n * (n - 1), F.lit(1.0)))) + 50
    first, last = F.greatest(low, mode - reach), F.least(high, mode + reach)
    step = F.greatest(F.lit(1.0), F.ceil((last - first + 1) / (2 * _TERMS)))
    places = F.transform(F.sequence(F.lit(0), F.floor((last - first) / step).cast("int")), lambda i: first + i * step)
    # the tail that is left out has a share below 1e-17
    p = F.aggregate(places, F.lit(0.0), lambda s, k: s + F.when(log_p(k) <= seen + 1e-7, step * F.exp(log_p(k) + base)).otherwise(0.0))
    # a table farther out than the reach is as rare as itself
    p = F.when((a < first) | (a > last), F.exp(seen + base)).otherwise(p)
    return cells.withColumn("p_value", F.least(F.lit(1.0), p)).withColumn("odds_ratio", conditional_odds_ratio(a, b, c, d)).withColumn("sample_odds_ratio", ratio(a * d, b * c)).withColumn("sig", F.col("p_value") <= level)


def group_matrix(df: DataFrame, group: str, variable: str, value: str, how: str = "mean") -> DataFrame:
    """Mean or median of each (group, variable), and its z-score over the groups of the variable."""
    if how not in ("mean", "median"):
        raise ValueError(f"aggregate {how!r}")
    cells = quantiles(df, [group, variable], value, {"value": 0.5}) if how == "median" else df.groupBy(group, variable).agg(F.avg(value).alias("value"))
    return cells.withColumn("z", zscore(F.col("value"), [variable]))


def group_tests(df: DataFrame, group: str, variable: str, value: str, mode: str = "ONEvsOTHER", p_values: bool = False) -> DataFrame:
    """t statistics of each group of a variable from (n, mean, variance): ONEvsOTHER and ONEvsALL are Welch, ONEvsVALUE one-sample against the overall mean."""
    v = F.col(value).cast("double")
    s = df.groupBy(group, variable).agg(F.count(v).cast("double").alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("s2"))
    w = W.partitionBy(variable)
    all_n, all_sum = F.sum("n").over(w), F.sum(F.col("n") * F.col("m")).over(w)
    all_sq = F.sum(F.coalesce(F.col("s2"), F.lit(0.0)) * (F.col("n") - 1) + F.col("n") * F.col("m") * F.col("m")).over(w)
    s = s.withColumn("_n", all_n).withColumn("_m", all_sum / all_n).withColumn("_ss", all_sq - all_sum * all_sum / all_n)
    if mode == "ONEvsVALUE":
        out = s.withColumn("t", ratio(F.col("m") - F.col("_m"), F.sqrt(F.col("s2") / F.col("n")))).withColumn("df", F.col("n") - 1)
    elif mode in ("ONEvsOTHER", "ONEvsALL"):
        if mode == "ONEvsALL":
            n2, m2, v2 = F.col("_n"), F.col("_m"), F.col("_ss") / (F.col("_n") - 1)
        else:
            n2 = F.col("_n") - F.col("n")
            m2 = ratio(F.col("_n") * F.col("_m") - F.col("n") * F.col("m"), n2)
            own = F.coalesce(F.col("s2"), F.lit(0.0)) * (F.col("n") - 1)
            between = F.col("n") * F.pow(F.col("m") - F.col("_m"), F.lit(2.0)) + n2 * F.pow(m2 - F.col("_m"), F.lit(2.0))
            v2 = ratio(F.col("_ss") - own - between, n2 - 1)
        a, b = F.col("s2") / F.col("n"), ratio(v2, n2)
        out = s.withColumn("_m2", m2).withColumn("_a", a).withColumn("_b", b).withColumn("_n2", n2)
        out = out.withColumn("t", ratio(F.col("m") - F.col("_m2"), F.sqrt(F.col("_a") + F.col("_b"))))
        out = out.withColumn("df", ratio(F.pow(F.col("_a") + F.col("_b"), F.lit(2.0)), F.col("_a") * F.col("_a") / (F.col("n") - 1) + F.col("_b") * F.col("_b") / (F.col("_n2") - 1)))
    else:
        raise ValueError(f"mode {mode!r}")
    out = out.select(group, variable, F.col("n").cast("long").alias("n"), F.col("m").alias("mean"), "t", "df")
    return out.withColumn("p_value", t_two_sided(F.col("t"), F.col("df"))) if p_values else out


def permutation_tests(df: DataFrame, group: str, variable: str, value: str, p_values: bool = False) -> DataFrame:
    """z of each group's sum against the others of its variable, over all deals of the values into two such groups."""
    v = F.col(value).cast("double")
    s = df.groupBy(group, variable).agg(F.count(v).cast("double").alias("n1"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))
    w = W.partitionBy(variable)
    s = s.withColumn("_n", F.sum("n1").over(w)).withColumn("_all", F.sum("_s").over(w)).withColumn("_sq", F.sum("_q").over(w))
    spread = F.col("_sq") - F.col("_all") * F.col("_all") / F.col("_n")
    z = ratio(F.col("_s") - F.col("n1") * F.col("_all") / F.col("_n"), F.sqrt(ratio(F.col("n1") * (F.col("_n") - F.col("n1")) * spread, F.col("_n") * (F.col("_n") - 1))))
    out = s.select(group, variable, F.col("n1").cast("long").alias("n"), z.alias("z"))
    return out.withColumn("p_value", normal_two_sided(F.col("z"))) if p_values else out


def rank_sum_tests(df: DataFrame, group: str, variable: str, value: str, p_values: bool = False, mode: str = "ONEvsOTHER", continuity: bool = True) -> DataFrame:
    """Wilcoxon rank-sum of each group against the others of its variable, or against all (ONEvsALL: the group itself included).

    W and the normal z with ties, and with continuity unless it is a permutation test's. The p-value is exact where both
    sides have fewer than 50 values and none ties, and it is no permutation test; else normal. Values are counted first; then
    running counts are taken in two steps over ranges of values, so that no task holds all values of a variable.
    """
    if mode not in ("ONEvsOTHER", "ONEvsALL"):
        raise ValueError(f"mode {mode!r}")
    v = F.col(value).cast("double")
    rows = df.select(group, variable, v.alias("_v")).dropna(subset=["_v"])
    counts = rows.groupBy(variable, group, "_v").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    ties = running(counts.groupBy(variable, "_v").agg(F.sum("_c").alias("_t")), [variable], "_v", "_t", "_before")
    both = counts.join(ties, [variable, "_v"])
    cube = lambda c: F.pow(c, F.lit(3.0)) - c
    whole = ties.groupBy(variable).agg(F.sum("_t").alias("_all"), F.sum(cube(F.col("_t"))).alias("_ties"))
    if mode == "ONEvsALL":
        own = running(counts, [variable, group], "_v", "_c", "_own").select(variable, group, "_v", "_own")
        both = both.join(own, [variable, group, "_v"])
        rank = F.col("_own") + F.col("_before") + (F.col("_t") + F.col("_c") + 1) / 2
        more = F.sum(cube(F.col("_t") + F.col("_c")) - cube(F.col("_t")))
    else:
        rank, more = F.col("_before") + (F.col("_t") + 1) / 2, F.lit(0.0)
    s = both.groupBy(variable, group).agg(F.sum("_c").alias("n1"), F.sum(F.col("_c") * rank).alias("_rs"), more.alias("_more")).join(whole, variable)
    n1 = F.col("n1")
    n2 = F.col("_all") if mode == "ONEvsALL" else F.col("_all") - n1
    n = n1 + n2
    w = F.col("_rs") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - ratio(F.col("_ties") + F.col("_more"), n * (n - 1))))
    d = w - n1 * n2 / 2
    out = s.withColumn("w", w).withColumn("z", ratio(d - F.signum(d) * (0.5 if continuity else 0.0), sigma)).withColumn("_n2", n2).withColumn("_tied", F.col("_ties") + F.col("_more") > 0)
    if not p_values:
        return out.select(group, variable, n1.cast("long").alias("n"), "w", "z")
    p = normal_two_sided(F.col("z"))
    if continuity and mode == "ONEvsOTHER":
        p = F.when(F.col("_tied"), p).otherwise(F.coalesce(rank_sum_exact(F.col("w"), n1, F.col("_n2")), p))
    return out.select(group, variable, n1.cast("long").alias("n"), "w", "z", p.alias("p_value"))


def signed_rank_tests(df: DataFrame, group: str, variable: str, value: str, p_values: bool = False) -> DataFrame:
    """Wilcoxon signed-rank of each group against the median of its variable: V and the normal z with ties and continuity; zero differences go.

    The p-value is exact for fewer than 50 values without ties and zeros, else normal.
    """
    middle = quantiles(df, [variable], value, {"_mu": 0.5})
    all_ = df.select(group, variable, F.col(value).cast("double").alias("_v")).join(middle, variable).withColumn("_d", F.col("_v") - F.col("_mu"))
    zeros = all_.filter("_d = 0").groupBy(variable, group).agg(F.count(F.lit(1)).alias("_zeros"))
    rows = all_.filter("_d <> 0")
    counts = rows.groupBy(variable, group, F.abs("_d").alias("_a")).agg(F.count(F.lit(1)).cast("double").alias("_t"), F.count(F.when(F.col("_d") > 0, 1)).alias("_up"))
    ranked = running(counts, [variable, group], "_a", "_t", "_before")
    s = ranked.groupBy(variable, group).agg(
        F.sum("_t").alias("_n"), F.sum(F.col("_up") * (F.col("_before") + (F.col("_t") + 1) / 2)).alias("v"), F.sum(F.pow("_t", F.lit(3.0)) - F.col("_t")).alias("_ties")
    )
    n = F.col("_n")
    d = F.col("v") - n * (n + 1) / 4
    z = ratio(d - F.signum(d) * 0.5, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48))
    if not p_values:
        return s.select(group, variable, n.cast("long").alias("n"), "v", z.alias("z"))
    s = s.join(zeros, [variable, group], "left").withColumn("z", z)
    normal = normal_two_sided(F.col("z"))
    p = F.when((F.col("_ties") > 0) | F.col("_zeros").isNotNull(), normal).otherwise(F.coalesce(signed_rank_exact(F.col("v"), n), normal))
    return s.select(group, variable, n.cast("long").alias("n"), "v", "z", p.alias("p_value"))


def average_and_share(df: DataFrame, group: str, variable: str, value: str) -> DataFrame:
    """Mean and share of values above 0 in each (group, variable)."""
    return df.groupBy(group, variable).agg(F.avg(value).alias("avg_value"), F.avg(F.when(F.col(value) > 0, 1.0).when(F.col(value).isNotNull(), 0.0)).alias("pct_value"))


def forest_table(coef: DataFrame, method: str | None = "bh", ratio_scale: bool = True, first_term: int = 4) -> DataFrame:
    """Coefficients from the fourth on, exponentiated for ratio models, p adjusted, models in order of their largest estimate."""
    rows = coef.filter(F.col("term_pos") >= first_term).dropna(subset=["estimate", "pvalue"])
    if ratio_scale:
        rows = rows.select("model", "term_pos", "term", *[F.exp(c).alias(c) for c in ("estimate", "lower", "upper")], "pvalue")
    rows = adjust(rows, "pvalue", method or "none", tie="model")
    best = rows.groupBy("model").agg(F.max("estimate").alias("_best"))
    order = best.withColumn("model_order", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("_best").desc(), "model")))  # a row per model
    return rows.join(order.drop("_best"), "model").select("model", "model_order", "term_pos", "term", "estimate", "lower", "upper", "pvalue", "p_adj")


def volcano_models(coef: DataFrame, method: str = "bh", cut: float = 1.0, level: float = 0.05) -> DataFrame:
    """The last coefficient of each model, exponentiated, its p adjusted over models, and its class."""
    last = coef.groupBy("model").agg(F.max_by(F.struct("term", "estimate", "pvalue"), "term_pos").alias("_l")).select("model", "_l.term", F.exp("_l.estimate").alias("estimate"), "_l.pvalue")
    return adjust(last, "pvalue", method, tie="model").withColumn("status", volcano_class(F.log2("estimate"), F.col("p_adj"), cut, level))
