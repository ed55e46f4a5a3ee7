"""All queries over the given tables, with SQL for those that it can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blocks import centred, topological_overlaps
from ..functions.numeric import average_rank, star, zscore
from ..functions.padjust import adjust
from ..operators import cluster, count_models, expression, image, meta, neighbours, networks, plots, quasi_likelihood, reshape, spatial, stats
from ..session import shared_folder
from ..sources import archive
from .inputs import Tables, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function of the tables under its name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def whole(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


# ---- expression ---------------------------------------------------------------------------------------------------


@query(sql("counts", "lens") + ", r AS (SELECT gene, sample, value / length AS rate FROM counts JOIN lens USING (gene)) SELECT gene, sample, round(rate / sum(rate) OVER (PARTITION BY sample) * 1e6, 6) AS tpm FROM r")
def n1_tpm(t):
    return r6(expression.tpm(t.counts(), expression.transcript_length(t.transcripts())).withColumnRenamed("value", "tpm"), "tpm")


@query(sql("counts", "lens") + " SELECT gene, sample, round(value / length / sum(value) OVER (PARTITION BY sample) * 1e6, 6) AS rpkm FROM counts JOIN lens USING (gene)")
def n2_rpkm(t):
    return r6(expression.rpkm(t.counts(), expression.transcript_length(t.transcripts())).withColumnRenamed("value", "rpkm"), "rpkm")


_ISLANDS = (
    "o AS (SELECT gene, s, e, max(e) OVER (PARTITION BY gene ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM exons),"
    " i AS (SELECT gene, s, e, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY gene ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o),"
    " u AS (SELECT gene, CAST(sum(w) AS BIGINT) AS length FROM (SELECT gene, k, max(e) - min(s) + 1 AS w FROM i GROUP BY 1, 2) GROUP BY 1)"
)


@query(sql("exons") + ", " + _ISLANDS + " SELECT gene, length FROM u")
def ag2_exon_union(t):
    return expression.exon_union_length(t.exons())


@query(sql("counts", "exons") + ", " + _ISLANDS + ", r AS (SELECT gene, sample, value / length AS rate FROM counts JOIN u USING (gene)) SELECT gene, sample, round(rate / sum(rate) OVER (PARTITION BY sample) * 1e6, 6) AS value FROM r")
def n3_normalize_counts(t):
    return r6(expression.normalize_counts(t.counts(), t.exons(), "tpm", "exon"), "value")


@query("SELECT p_brand AS gene, CAST(max(p_size) AS BIGINT) AS length FROM part GROUP BY 1")
def ag1_transcript_length(t):
    return expression.transcript_length(t.transcripts())


@query(sql("counts") + " SELECT gene, sample, value FROM counts WHERE gene IN (SELECT p_brand FROM part WHERE p_type = 'ECONOMY' AND p_size < 10)")
def pf1_keep_genes(t):
    return expression.keep_genes(t.counts(), t["part"].filter("p_type = 'ECONOMY' AND p_size < 10").select(F.col("p_brand").alias("gene"))).select("gene", "sample", "value")


_SF = (
    "g AS (SELECT gene, CASE WHEN count(*) FILTER (WHERE value > 0) = count(*) THEN avg(ln(value)) END AS lm FROM counts WHERE value > 0 GROUP BY 1),"
    " f AS (SELECT sample, quantile_cont(exp(ln(value) - lm), 0.5) AS size_factor FROM counts JOIN g USING (gene) WHERE lm IS NOT NULL GROUP BY 1)"
)


@query(sql("counts") + ", " + _SF + " SELECT sample, round(size_factor, 6) AS size_factor FROM f")
def st7_size_factors(t):
    return r6(expression.size_factors(t.counts()), "size_factor")


@query(
    sql("counts") + ", " + _SF + ", v AS (SELECT gene, CASE WHEN CAST(sample AS INTEGER) % 2 = 0 THEN 'even' ELSE 'odd' END AS grp, value / size_factor AS v FROM counts JOIN f USING (sample)),"
    " b AS (SELECT gene, avg(v) AS base_mean FROM v GROUP BY 1) SELECT gene, 'odd' AS \"group\", round(base_mean, 6) AS base_mean, round(log2(avg(v) FILTER (WHERE grp = 'odd') / avg(v) FILTER (WHERE grp = 'even')), 6) AS log2_fc FROM v JOIN b USING (gene) GROUP BY gene, base_mean"
)
def st7_fold_changes(t):
    c = t.counts()
    groups = c.select("sample", F.when(F.col("sample").cast("int") % 2 == 0, "even").otherwise("odd").alias("group")).distinct()
    return r6(expression.fold_changes(c, groups, "even"), "base_mean", "log2_fc")


@query(
    sql("expr") + ", n AS (SELECT count(DISTINCT sample) AS n FROM expr), g AS (SELECT gene, avg(ln(value)) AS lm FROM expr, n WHERE value > 0 GROUP BY gene HAVING count(*) = any_value(n)), f AS (SELECT sample, quantile_cont(exp(ln(value) - lm), 0.5) AS size_factor FROM expr JOIN g USING (gene) WHERE value > 0 GROUP BY 1)"
    " SELECT gene, sample, round(value / size_factor, 6) AS value FROM expr JOIN f USING (sample)"
)
def st7_scaled_counts(t):
    c = t.expression()
    return r6(c.join(expression.size_factors(c), "sample").select("gene", "sample", (F.col("value") / F.col("size_factor")).alias("value")), "value")


@query(
    sql("expr") + ", lib AS (SELECT sample, sum(value) AS lib FROM expr GROUP BY 1), p AS (SELECT sample, value / lib AS share FROM expr JOIN lib USING (sample) WHERE value > 0), z AS (SELECT l.sample, unnest(range((SELECT count(DISTINCT gene) FROM expr WHERE value > 0) - (SELECT count(*) FROM p WHERE p.sample = l.sample))) AS k FROM lib l),"
    " u AS (SELECT sample, quantile_cont(share, 0.75) AS q FROM (SELECT sample, share FROM p UNION ALL SELECT sample, 0.0 FROM z) GROUP BY 1), r AS (SELECT sample FROM u ORDER BY round(abs(q - (SELECT avg(q) FROM u)), 15), sample LIMIT 1),"
    " s AS (SELECT gene, sample, value, lib FROM expr JOIN lib USING (sample) WHERE value > 0), ref AS (SELECT gene, value AS rv, lib AS rl FROM s WHERE sample = (SELECT sample FROM r)),"
    " x AS (SELECT gene, sample, log2((value / lib) / (rv / rl)) AS m, (log2(value / lib) + log2(rv / rl)) / 2 AS a, (lib - value) / lib / value + (rl - rv) / rl / rv AS v FROM s JOIN ref USING (gene)),"
    " k AS (SELECT *, count(*) OVER (PARTITION BY sample) AS n, rank() OVER (PARTITION BY sample ORDER BY m) + (count(*) OVER (PARTITION BY sample, m) - 1) / 2.0 AS mr, rank() OVER (PARTITION BY sample ORDER BY a) + (count(*) OVER (PARTITION BY sample, a) - 1) / 2.0 AS ar FROM x),"
    " f AS (SELECT sample, pow(2, sum(m / v) / sum(1 / v)) AS factor FROM k WHERE mr >= floor(n * 0.3) + 1 AND mr <= n - floor(n * 0.3) AND ar >= floor(n * 0.05) + 1 AND ar <= n - floor(n * 0.05) GROUP BY 1)"
    " SELECT sample, round(factor / (SELECT exp(avg(ln(factor))) FROM f), 6) AS factor, CAST(lib AS DOUBLE) AS library FROM f JOIN lib USING (sample)"
)
def st8_normalisation_factors(t):
    return r6(expression.normalisation_factors(t.expression()), "factor")


@query()
def st8_quasi_likelihood(t):
    return r6(quasi_likelihood.tests(t.expression(), t.sample_groups(), "even"), "log2_fc", "log_cpm", "dispersion", "statistic", "p_value", "p_adj")


@query()
def st8_likelihood_ratio(t):
    return r6(quasi_likelihood.tests(t.expression(), t.sample_groups(), "even", batch=True, quasi=False), "log2_fc", "log_cpm", "dispersion", "statistic", "p_value", "p_adj")


_NB = ("base_mean", "dispersion", "log2_fc", "se", "statistic", "p_value", "p_adj")


@query()
def st7_negative_binomial(t):
    return r6(count_models.differential(t.expression(), t.sample_groups(), "even"), *_NB)


@query()
def st7_likelihood_ratio(t):
    return r6(count_models.differential(t.expression(), t.sample_groups(), "even", test="LRT"), *_NB)


@query()
def st10_batch(t):
    return r6(count_models.differential(t.expression(), t.sample_groups(), "even", batch=True), *_NB)


@query()
def st4_sample_pca(t):
    return r6(expression.sample_pca(t.counts(), 2), "loading", "proportion")


@query(
    sql("counts") + ", lib AS (SELECT sample, sum(value) AS lib FROM counts GROUP BY 1), s AS (SELECT gene, sample, value, lib FROM counts JOIN lib USING (sample) WHERE value > 0), ref AS (SELECT gene, value AS rv, lib AS rl FROM s WHERE sample = (SELECT min(sample) FROM counts)),"
    " x AS (SELECT gene, sample, log2((value / lib) / (rv / rl)) AS m, (log2(value / lib) + log2(rv / rl)) / 2 AS a, (lib - value) / lib / value + (rl - rv) / rl / rv AS v FROM s JOIN ref USING (gene)),"
    " k AS (SELECT *, count(*) OVER (PARTITION BY sample) AS n, rank() OVER (PARTITION BY sample ORDER BY m) + (count(*) OVER (PARTITION BY sample, m) - 1) / 2.0 AS mr, rank() OVER (PARTITION BY sample ORDER BY a) + (count(*) OVER (PARTITION BY sample, a) - 1) / 2.0 AS ar FROM x)"
    " SELECT sample, round(pow(2, sum(m / v) / sum(1 / v)), 6) AS factor FROM k WHERE mr >= floor(n * 0.3) + 1 AND mr <= n - floor(n * 0.3) AND ar >= floor(n * 0.05) + 1 AND ar <= n - floor(n * 0.05) GROUP BY 1"
)
def st8_tmm(t):
    c = t.counts()
    return r6(expression.tmm_factors(c, c.agg(F.min("sample")).first()[0]), "factor")


# ---- windows ------------------------------------------------------------------------------------------------------


@query("SELECT l_suppkey, l_quantity, round(rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0, 6) AS avg_rank, CAST(count(*) OVER (PARTITION BY l_suppkey) AS BIGINT) AS n FROM lineitem")
def w1_avg_rank(t):
    from pyspark.sql import Window as W

    return t["lineitem"].select("l_suppkey", "l_quantity", F.round(average_rank(F.col("l_quantity"), ["l_suppkey"]), 6).alias("avg_rank"), F.count(F.lit(1)).over(W.partitionBy("l_suppkey")).alias("n"))


@query(sql("counts") + " SELECT gene, sample, round((ln(value + 1) - avg(ln(value + 1)) OVER w) / stddev_samp(ln(value + 1)) OVER w, 6) AS z FROM counts WINDOW w AS (PARTITION BY sample)")
def w2_zscore(t):
    return t.counts().select("gene", "sample", F.round(zscore(F.log1p("value"), ["sample"]), 6).alias("z"))


@query("SELECT event_id, round(least((value - avg(value) OVER w) / stddev_samp(value) OVER w, 1.5), 6) AS z FROM events WINDOW w AS (PARTITION BY event_type, user_id % 4)")
def w3_zscore_by_batch(t):
    e = t["events"].withColumn("batch", F.col("user_id") % 4)
    return e.select("event_id", F.round(zscore(F.col("value"), ["event_type", "batch"], limit=1.5, constant=1.0), 6).alias("z"))


@query(
    sql("studies") + ", o AS (SELECT study, gene, p_val, row_number() OVER (PARTITION BY study ORDER BY p_val, gene) AS i, count(*) OVER (PARTITION BY study) AS n FROM studies)"
    " SELECT study, gene, round(least(1.0, min(p_val * n / i) OVER (PARTITION BY study ORDER BY i DESC ROWS UNBOUNDED PRECEDING)), 6) AS bh,"
    " round(least(1.0, max(p_val * (n - i + 1)) OVER (PARTITION BY study ORDER BY i ROWS UNBOUNDED PRECEDING)), 6) AS holm, round(least(1.0, p_val * n), 6) AS bonferroni,"
    " round(least(1.0, min(p_val * (n - i + 1)) OVER (PARTITION BY study ORDER BY i DESC ROWS UNBOUNDED PRECEDING)), 6) AS hochberg FROM o"
)
def w7_adjust(t):
    s = t.studies()
    for m in ("bh", "holm", "bonferroni", "hochberg"):
        s = adjust(s, "p_val", m, ["study"], m, "gene")
    return r6(s.select("study", "gene", "bh", "holm", "bonferroni", "hochberg"), "bh", "holm", "bonferroni", "hochberg")


@query(sql("studies") + " SELECT study, gene, CASE WHEN p_val <= 0.001 THEN '***' WHEN p_val <= 0.01 THEN '**' WHEN p_val <= 0.05 THEN '*' ELSE '' END AS label FROM studies")
def pf8_star(t):
    return t.studies().select("study", "gene", star(F.col("p_val")).alias("label"))


@query(sql("studies") + " SELECT study, gene, CASE WHEN log_fc >= 0.05 AND p_val <= 0.3 THEN 'Higher' WHEN log_fc <= -0.05 AND p_val <= 0.3 THEN 'Lower' ELSE 'Unchanged' END AS status FROM studies")
def pf7_volcano(t):
    return t.studies().select("study", "gene", stats.volcano_class(F.col("log_fc"), F.col("p_val"), 0.05, 0.3).alias("status"))


# ---- meta-analysis ------------------------------------------------------------------------------------------------

_RANKED = (
    ", l AS (SELECT *, -ln(p_val) * sign(log_fc) AS l FROM studies), k AS (SELECT *, (rank() OVER (PARTITION BY study ORDER BY l) + (count(*) OVER (PARTITION BY study, l) - 1) / 2.0) / count(*) OVER (PARTITION BY study) AS up,"
    " (rank() OVER (PARTITION BY study ORDER BY -l) + (count(*) OVER (PARTITION BY study, l) - 1) / 2.0) / count(*) OVER (PARTITION BY study) AS down FROM l)"
)


def _comb_rank_sql(agg: str) -> str:
    return (
        sql("studies") + _RANKED + ", g AS (SELECT gene, count(*) FILTER (WHERE log_fc > 0) AS np, count(*) FILTER (WHERE log_fc < 0) AS nn, count(*) AS av, quantile_cont(log_fc, 0.5) FILTER (WHERE log_fc > 0) AS mp, quantile_cont(log_fc, 0.5) FILTER (WHERE log_fc < 0) AS mn,"
        f" {agg.format('up')} AS u, {agg.format('down')} AS d, sum(sign(log_fc)) AS s, count(*) FILTER (WHERE p_val <= 0.05 AND log_fc >= 0) AS sp, count(*) FILTER (WHERE p_val <= 0.05 AND log_fc <= 0) AS sn FROM k GROUP BY 1)"
        " SELECT gene, CASE WHEN np >= nn THEN 'positive' ELSE 'negative' END AS direction, round(CASE WHEN np >= nn THEN mp ELSE mn END, 6) AS median_es, round(CASE WHEN np >= nn THEN u ELSE d END, 6) AS rank,"
        " round(sign(CASE WHEN np >= nn THEN mp ELSE mn END) * CASE WHEN np >= nn THEN u ELSE d END, 6) AS signed_rank, (SELECT count(DISTINCT study) FROM studies) AS total_study, av AS available_study,"
        " CASE WHEN s >= 0 THEN sp ELSE sn END AS sig_study_number, round(CASE WHEN s >= 0 THEN sp ELSE sn END / av, 6) AS sig_study_ratio FROM g"
    )


@query(_comb_rank_sql("exp(avg(ln({})))"))
def ag4_comb_rank_product(t):
    return r6(meta.combine_ranks(meta.study_ranks(t.studies())), "median_es", "rank", "signed_rank", "sig_study_ratio")


@query(_comb_rank_sql("quantile_cont({}, 0.5)"))
def ag3_comb_rank_median(t):
    return r6(meta.combine_ranks(meta.study_ranks(t.studies()), "RankSum"), "median_es", "rank", "signed_rank", "sig_study_ratio")


def _combine_p_sql(value: str) -> str:
    """``value``: the combined p-value from the majority side's k p-values, a list ``ps``."""
    return sql("studies") + (
        ", g AS (SELECT gene, count(p_val) AS av, avg(log_fc) AS m, coalesce(list(p_val) FILTER (WHERE log_fc > 0 AND p_val IS NOT NULL), []) AS pos, coalesce(list(p_val) FILTER (WHERE log_fc < 0 AND p_val IS NOT NULL), []) AS neg FROM studies GROUP BY 1),"
        " h AS (SELECT *, CASE WHEN len(pos) >= len(neg) THEN pos ELSE neg END AS ps, len(CASE WHEN len(pos) >= len(neg) THEN pos ELSE neg END) AS k FROM g)"
        f" SELECT gene, (SELECT count(DISTINCT study) FROM studies) AS total_study, av AS available_study, k AS sig_study, round(k / av, 6) AS percent_same_dir, round(m, 6) AS mean_es, round(CASE WHEN av >= 5 AND k >= av * 0.5 AND k > 0 THEN {value} ELSE 1.0 END, 6) AS combined_p FROM h"
    )


_MINUS_LOG = "list_sum(list_transform(ps, lambda p: -ln(p)))"


@query(_combine_p_sql(f"exp(-{_MINUS_LOG}) * list_sum(list_transform(range(k), lambda i: pow({_MINUS_LOG}, i) / gamma(i + 1)))"))
def ag6_combine_p_fisher(t):
    return r6(meta.combine_p(t.studies(), min_ratio=0.5), "percent_same_dir", "mean_es", "combined_p")


@query()
def ag6_combine_p_stouffer(t):
    return r6(meta.combine_p(t.studies(), "z.transform", min_ratio=0.5), "percent_same_dir", "mean_es", "combined_p")


@query()
def ag6_combine_p_logit(t):
    return r6(meta.combine_p(t.studies(), "logit", min_ratio=0.5), "percent_same_dir", "mean_es", "combined_p")


@query(sql("studies") + " SELECT gene, round(0.5 - atan(avg(tan((0.5 - p_val) * pi()))) / pi(), 6) AS p_value FROM studies GROUP BY 1")
def ag7_acat(t):
    return r6(meta.acat(t.studies(), "p_val", ["gene"]), "p_value")


@query(
    sql("geno", "pheno") + ", n AS (SELECT count(*)::DOUBLE AS n, avg(y) AS yb, var_pop(y) * count(*) AS sst FROM pheno), g AS (SELECT snp, sum(dosage * (y - yb)) AS u, sum(dosage)::DOUBLE AS mac, sum(dosage * dosage)::DOUBLE AS gg, any_value(n) AS n, any_value(sst) AS sst FROM geno JOIN pheno USING (ind), n GROUP BY 1),"
    " h AS (SELECT *, CASE WHEN gg - mac * mac / n <= 0 THEN 0 ELSE u * u / (gg - mac * mac / n) END AS ssr FROM g) SELECT snp, CAST(mac AS BIGINT) AS mac, round(mac / (2 * n), 6) AS maf, round(sqrt(ssr / ((sst - ssr) / (n - 2))), 6) AS t, CAST(n - 2 AS BIGINT) AS df FROM h"
)
def ag9_marginal_score(t):
    null = meta.null_model(t.pheno())
    return r6(meta.marginal_tests(t.geno(), null).select("snp", "mac", "maf", F.col("statistic").alias("t"), F.lit(null.n - 2).cast("long").alias("df")), "maf", "t")


@query(
    sql("geno", "pheno") + ", n AS (SELECT count(*)::DOUBLE AS n, avg(y) AS yb, var_samp(y) AS s2 FROM pheno), w AS (SELECT snp, 25 * pow(1 - sum(dosage) / (2 * any_value(n)), 24) AS w FROM geno, n GROUP BY 1), b AS (SELECT ind, sum(dosage * w) AS d FROM geno JOIN w USING (snp) GROUP BY 1)"
    " SELECT round(pow(sum(d * (y - yb)), 2) / (any_value(s2) * (sum(d * d) - pow(sum(d), 2) / any_value(n))), 6) AS q FROM b JOIN pheno USING (ind), n"
)
def ag8_burden(t):
    return r6(meta.burden_test(t.geno(), meta.null_model(t.pheno())).select("q"), "q")


#: Customers with their nation as a covariate: the linear null model in closed form, for one covariate.
_NULL = (
    sql("geno", "pheno") + ", z AS (SELECT c_custkey AS ind, c_acctbal AS y, CAST(c_nationkey AS DOUBLE) AS z FROM customer), f AS (SELECT count(*)::DOUBLE AS n, avg(y) AS yb, avg(z) AS zb, covar_pop(z, y) / var_pop(z) AS slope, var_pop(z) * count(*) AS szz FROM z),"
    " e AS (SELECT ind, z - zb AS c, y - yb - slope * (z - zb) AS res FROM z, f), s AS (SELECT sum(res * res) AS sst FROM e)"
)


@query(_NULL + " SELECT ind, round(res, 6) AS residual FROM e")
def st14_null_residuals(t):
    p = t["customer"].select(F.col("c_custkey").alias("ind"), F.col("c_acctbal").alias("y"), F.col("c_nationkey").alias("z"))
    return r6(meta.null_model(p, ["z"]).rows.select("ind", "residual"), "residual")


@query(
    _NULL + ", g AS (SELECT snp, sum(dosage * res) AS u, sum(dosage)::DOUBLE AS s, sum(dosage * dosage)::DOUBLE AS gg, sum(dosage * c) AS gc FROM geno JOIN e USING (ind) GROUP BY 1), h AS (SELECT snp, s, gg - s * s / n - gc * gc / szz AS sig, u, n, sst FROM g, f, s)"
    " SELECT snp, CAST(s AS BIGINT) AS mac, round(s / (2 * n), 6) AS maf, round(CASE WHEN sig <= 0 THEN 0 ELSE sqrt(u * u / sig / ((sst - u * u / sig) / (n - 3))) END, 6) AS statistic FROM h"
)
def ag9_marginal_covariate(t):
    p = t["customer"].select(F.col("c_custkey").alias("ind"), F.col("c_acctbal").alias("y"), F.col("c_nationkey").alias("z"))
    return r6(meta.marginal_tests(t.geno(), meta.null_model(p, ["z"])).select("snp", "mac", "maf", "statistic"), "maf", "statistic")


@query(
    _NULL + ", w AS (SELECT snp, 25 * pow(1 - sum(dosage) / (2 * any_value(n)), 24) AS w FROM geno, f GROUP BY 1), b AS (SELECT ind, sum(dosage * w) AS d FROM geno JOIN w USING (snp) GROUP BY 1)"
    " SELECT round(pow(sum(d * res), 2) / (any_value(sst) / (any_value(n) - 2) * (sum(d * d) - pow(sum(d), 2) / any_value(n) - pow(sum(d * c), 2) / any_value(szz))), 6) AS q FROM b JOIN e USING (ind), f, s"
)
def ag8_burden_covariate(t):
    p = t["customer"].select(F.col("c_custkey").alias("ind"), F.col("c_acctbal").alias("y"), F.col("c_nationkey").alias("z"))
    return r6(meta.burden_test(t.geno(), meta.null_model(p, ["z"])).select("q"), "q")


@query()
def ag10_acat_v_binary(t):
    p = t["customer"].select(F.col("c_custkey").alias("ind"), (F.col("c_acctbal") > 4500).cast("int").alias("y"), F.col("c_nationkey").alias("z"))
    return r6(meta.acat_v_test(t.geno(), meta.null_model(p, ["z"]), mac_thresh=500), "p_value")


@query()
def ag10_acat_v(t):
    return r6(meta.acat_v_test(t.geno(), meta.null_model(t.pheno()), mac_thresh=500), "p_value")


# ---- tests --------------------------------------------------------------------------------------------------------

_CELLS2 = (
    "WITH c AS (SELECT o_orderpriority AS x, o_orderstatus AS y, count(*) AS n FROM orders GROUP BY 1, 2), a AS (SELECT x, sum(n) AS nx FROM c GROUP BY 1), b AS (SELECT y, sum(n) AS ny FROM c GROUP BY 1), m AS (SELECT sum(n) AS nn FROM c),"
    " q AS (SELECT x, y, CAST(coalesce(n, 0) AS BIGINT) AS n11, CAST(ny - coalesce(n, 0) AS BIGINT) AS n01, CAST(nx - coalesce(n, 0) AS BIGINT) AS n10, CAST(nn - nx - ny + coalesce(n, 0) AS BIGINT) AS n00 FROM a CROSS JOIN b CROSS JOIN m LEFT JOIN c USING (x, y))"
)


@query(_CELLS2 + " SELECT * FROM q")
def ag11_contingency(t):
    return stats.contingency(t["orders"], "o_orderpriority", "o_orderstatus")


_LF = "lgamma({} + 1)"


def _hyper(k: str) -> str:
    r, c, n = "(n11 + n01)", "(n11 + n10)", "(n11 + n01 + n10 + n00)"
    return f"({_LF.format(k)} + {_LF.format(f'{r} - {k}')} + {_LF.format(f'{c} - {k}')} + {_LF.format(f'{n} - {r} - {c} + {k}')})"


@query(
    "WITH RECURSIVE c AS (SELECT CAST(quality AS VARCHAR) AS x, CAST(toxic AS VARCHAR) AS y, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2), a AS (SELECT x, sum(n) AS nx FROM c GROUP BY 1), b AS (SELECT y, sum(n) AS ny FROM c GROUP BY 1), m AS (SELECT sum(n) AS nn FROM c),"
    " q AS (SELECT x, y, CAST(coalesce(n, 0) AS BIGINT) AS n11, CAST(ny - coalesce(n, 0) AS BIGINT) AS n01, CAST(nx - coalesce(n, 0) AS BIGINT) AS n10, CAST(nn - nx - ny + coalesce(n, 0) AS BIGINT) AS n00 FROM a CROSS JOIN b CROSS JOIN m LEFT JOIN c USING (x, y)),"
    " k AS (SELECT *, unnest(range(greatest(0, n11 - n00), least(n11 + n01, n11 + n10) + 1)) AS k FROM q),"
    f" p AS (SELECT x, y, n11, n01, n10, n00, sum(CASE WHEN -{_hyper('k')} <= -{_hyper('n11')} + 1e-7 THEN exp(-{_hyper('k')} + lgamma(n11 + n01 + 1) + lgamma(n10 + n00 + 1) + lgamma(n11 + n10 + 1) + lgamma(n01 + n00 + 1) - lgamma(n11 + n01 + n10 + n00 + 1)) ELSE 0 END) AS p FROM k GROUP BY ALL)"
    ", e AS (SELECT *, list_transform(range(greatest(0, n11 - n00), least(n11 + n01, n11 + n10) + 1), lambda k: CAST(k AS DOUBLE)) AS ks, n11 + n01 AS r, n11 + n10 AS c, n11 + n01 + n10 + n00 AS n FROM p),"
    " l AS (SELECT *, list_transform(ks, lambda k: -(lgamma(k + 1) + lgamma(r - k + 1) + lgamma(c - k + 1) + lgamma(n - r - c + k + 1))) AS lw FROM e),"
    " h AS (SELECT *, -30.0::DOUBLE AS lo, 30.0::DOUBLE AS hi, 0 AS i FROM l UNION ALL SELECT * EXCLUDE (m) REPLACE (CASE WHEN m < n11 THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN m < n11 THEN hi ELSE (lo + hi) / 2 END AS hi, i + 1 AS i) FROM"
    " (SELECT *, list_sum(list_transform(range(len(ks)), lambda j: ks[j + 1] * exp(lw[j + 1] - list_max(lw) + (ks[j + 1] - n11) * (lo + hi) / 2))) / list_sum(list_transform(range(len(ks)), lambda j: exp(lw[j + 1] - list_max(lw) + (ks[j + 1] - n11) * (lo + hi) / 2))) AS m FROM h WHERE i < 70))"
    " SELECT x, y, n11, n01, n10, n00, round(least(1.0, p), 6) AS p_value, round(CASE WHEN n11 = ks[1] THEN 0.0 WHEN n11 = ks[-1] THEN 'inf'::DOUBLE ELSE exp((lo + hi) / 2) END, 6) AS odds_ratio, round(n11 * n00 / nullif(n01 * n10, 0), 6) AS sample_odds_ratio FROM h WHERE i = 70"
)
def st5_fisher(t):
    return r6(stats.fisher_exact(stats.contingency(t["labels"], "quality", "toxic")).drop("sig"), "p_value", "odds_ratio", "sample_odds_ratio")


#: Suppliers' balances by nation within their region: few enough for exact tests on small tables, and without ties.
_SMALL = (
    "WITH RECURSIVE s AS (SELECT CAST(n_regionkey AS VARCHAR) AS variable, CAST(n_nationkey AS VARCHAR) AS grp, s_acctbal AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey), o AS (SELECT *, rank() OVER (PARTITION BY variable ORDER BY v) AS rk, count(*) OVER (PARTITION BY variable, v) AS t, count(*) OVER (PARTITION BY variable) AS n FROM s),"
    " w AS (SELECT variable, grp, count(*) AS n1, any_value(n) - count(*) AS n2, sum(rk) - count(*) * (count(*) + 1) / 2 AS w, any_value(n) AS n FROM o GROUP BY 1, 2), big AS (SELECT max(n) AS n FROM w WHERE n1 < 50 AND n2 < 50), few AS (SELECT max(n1) AS k FROM w WHERE n1 < 50 AND n2 < 50),"
    " d AS (SELECT 0 AS n, 0 AS k, 0 AS s, 1.0::DOUBLE AS c UNION ALL SELECT d.n + 1, k + u, s + u * (d.n + 1), sum(c) FROM d, (SELECT unnest([0, 1]) AS u) t WHERE d.n < (SELECT n FROM big) AND k + u <= (SELECT k FROM few) GROUP BY 1, 2, 3)"
)


@query(
    _SMALL + ", p AS (SELECT variable, grp, n1, w, sum(c) AS whole, sum(c) FILTER (WHERE d.s - d.k * (d.k + 1) / 2 <= w) AS below, sum(c) FILTER (WHERE d.s - d.k * (d.k + 1) / 2 >= w) AS above, any_value(n2) AS n2 FROM w JOIN d ON d.n = w.n AND d.k = w.n1 WHERE n1 < 50 AND n2 < 50 GROUP BY 1, 2, 3, 4)"
    " SELECT grp, variable, n1 AS n, CAST(w AS DOUBLE) AS w, round(least(1.0, 2 * CASE WHEN w <= n1 * n2 / 2.0 THEN below ELSE above END / whole), 6) AS p_value FROM p"
)
def st6_exact_rank_sum(t):
    n = t["nation"].select("n_nationkey", "n_regionkey")
    rows = t["supplier"].join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("string").alias("variable"), F.col("n_nationkey").cast("string").alias("grp"), "s_acctbal")  # 25 nations
    sizes = rows.groupBy("variable").agg(F.count(F.lit(1)).alias("_all"))
    tests = stats.rank_sum_tests(rows, "grp", "variable", "s_acctbal", p_values=True).join(sizes, "variable").filter("n < 50 AND _all - n < 50")
    return r6(tests.select("grp", "variable", "n", "w", "p_value"), "p_value")


@query(sql("vals") + ", g AS (SELECT grp, variable, avg(value) AS v FROM vals GROUP BY 1, 2) SELECT grp, variable, round(v, 6) AS value, round((v - avg(v) OVER w) / stddev_samp(v) OVER w, 6) AS z FROM g WINDOW w AS (PARTITION BY variable)")
def ag12_group_matrix(t):
    return r6(stats.group_matrix(t.values(), "grp", "variable", "value"), "value", "z")


@query(sql("vals") + ", g AS (SELECT grp, variable, quantile_cont(value, 0.5) AS v FROM vals GROUP BY 1, 2) SELECT grp, variable, round(v, 6) AS value, round((v - avg(v) OVER w) / stddev_samp(v) OVER w, 6) AS z FROM g WINDOW w AS (PARTITION BY variable)")
def ag12_group_median(t):
    return r6(stats.group_matrix(t.values(), "grp", "variable", "value", "median"), "value", "z")


_WELCH = (
    " SELECT a.grp, a.variable, a.n, round(a.m, 6) AS mean, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 5) AS t, round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 4) AS df FROM a JOIN b ON a.variable = b.variable {}"
)


@query(
    sql("vals") + ", a AS (SELECT grp, variable, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM vals GROUP BY 1, 2), lv AS (SELECT DISTINCT grp FROM vals), b AS (SELECT lv.grp, variable, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM vals JOIN lv ON lv.grp <> vals.grp GROUP BY 1, 2)" + _WELCH.format("AND a.grp = b.grp")
)
def st6_welch_others(t):
    return stats.group_tests(t.values(), "grp", "variable", "value").withColumns({"mean": F.round("mean", 6), "t": F.round("t", 5), "df": F.round("df", 4)})


@query(sql("vals") + ", a AS (SELECT grp, variable, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM vals GROUP BY 1, 2), b AS (SELECT variable, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM vals GROUP BY 1)" + _WELCH.format(""))
def st6_welch_all(t):
    return stats.group_tests(t.values(), "grp", "variable", "value", "ONEvsALL").withColumns({"mean": F.round("mean", 6), "t": F.round("t", 5), "df": F.round("df", 4)})


@query(
    sql("vals") + ", a AS (SELECT grp, variable, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM vals GROUP BY 1, 2), b AS (SELECT variable, avg(value) AS m FROM vals GROUP BY 1)"
    " SELECT grp, variable, n, round(a.m, 6) AS mean, round((a.m - b.m) / sqrt(v / n), 5) AS t, round(CAST(n - 1 AS DOUBLE), 4) AS df FROM a JOIN b USING (variable)"
)
def st6_one_sample(t):
    return stats.group_tests(t.values(), "grp", "variable", "value", "ONEvsVALUE").withColumns({"mean": F.round("mean", 6), "t": F.round("t", 5), "df": F.round("df", 4)})


@query(
    sql("vals") + ", r AS (SELECT *, rank() OVER (PARTITION BY variable ORDER BY value) + (count(*) OVER (PARTITION BY variable, value) - 1) / 2.0 AS r FROM vals), ti AS (SELECT variable, sum(c * c * c - c)::DOUBLE AS ties, sum(c)::DOUBLE AS nn FROM (SELECT variable, value, count(*) AS c FROM vals GROUP BY 1, 2) GROUP BY 1),"
    " g AS (SELECT grp, variable, count(*)::DOUBLE AS n1, sum(r) AS rs FROM r GROUP BY 1, 2), h AS (SELECT grp, variable, n1, nn - n1 AS n2, nn, ties, rs - n1 * (n1 + 1) / 2 AS w FROM g JOIN ti USING (variable))"
    " SELECT grp, variable, CAST(n1 AS BIGINT) AS n, round(w, 6) AS w, round((w - n1 * n2 / 2 - sign(w - n1 * n2 / 2) * 0.5) / sqrt(n1 * n2 / 12 * ((nn + 1) - ties / (nn * (nn - 1)))), 6) AS z FROM h"
)
def st6_rank_sum(t):
    return r6(stats.rank_sum_tests(t.values(), "grp", "variable", "value"), "w", "z")


_ALL_RANKS = (
    ", lv AS (SELECT DISTINCT grp, variable FROM vals), x AS (SELECT grp, variable, value, TRUE AS own FROM vals UNION ALL SELECT lv.grp, v.variable, v.value, FALSE FROM vals v JOIN lv ON lv.variable = v.variable),"
    " r AS (SELECT *, rank() OVER (PARTITION BY grp, variable ORDER BY value) + (count(*) OVER (PARTITION BY grp, variable, value) - 1) / 2.0 AS r FROM x), ti AS (SELECT grp, variable, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT grp, variable, value, count(*)::DOUBLE AS c FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2),"
    " g AS (SELECT grp, variable, count(*) FILTER (WHERE own)::DOUBLE AS n1, count(*)::DOUBLE AS nn, sum(r) FILTER (WHERE own) AS rs FROM r GROUP BY 1, 2), h AS (SELECT *, nn - n1 AS n2, rs - n1 * (n1 + 1) / 2 AS w FROM g JOIN ti USING (grp, variable))"
    " SELECT grp, variable, CAST(n1 AS BIGINT) AS n, round(w, 6) AS w, round((w - n1 * n2 / 2 - sign(w - n1 * n2 / 2) * 0.5) / sqrt(n1 * n2 / 12 * ((nn + 1) - ties / (nn * (nn - 1)))), 6) AS z FROM h"
)


@query(sql("vals") + _ALL_RANKS)
def st6_rank_sum_all(t):
    return r6(stats.rank_sum_tests(t.values(), "grp", "variable", "value", mode="ONEvsALL"), "w", "z")


@query(
    sql("vals") + ", m AS (SELECT variable, quantile_cont(value, 0.5) AS mu FROM vals GROUP BY 1), d AS (SELECT grp, variable, value - mu AS d FROM vals JOIN m USING (variable) WHERE value <> mu),"
    " r AS (SELECT *, rank() OVER (PARTITION BY grp, variable ORDER BY abs(d)) + (count(*) OVER (PARTITION BY grp, variable, abs(d)) - 1) / 2.0 AS r FROM d), ti AS (SELECT grp, variable, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT grp, variable, abs(d) AS a, count(*)::DOUBLE AS c FROM d GROUP BY 1, 2, 3) GROUP BY 1, 2),"
    " g AS (SELECT grp, variable, count(*)::DOUBLE AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS v FROM r GROUP BY 1, 2)"
    " SELECT grp, variable, CAST(n AS BIGINT) AS n, round(v, 6) AS v, round((v - n * (n + 1) / 4 - sign(v - n * (n + 1) / 4) * 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM g JOIN ti USING (grp, variable)"
)
def st6_signed_rank(t):
    return r6(stats.signed_rank_tests(t.values(), "grp", "variable", "value"), "v", "z")


@query(
    sql("vals") + ", a AS (SELECT variable, count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) AS v FROM vals GROUP BY 1), g AS (SELECT grp, variable, count(*)::DOUBLE AS n1, sum(value) AS s FROM vals GROUP BY 1, 2)"
    " SELECT grp, variable, CAST(n1 AS BIGINT) AS n, round((s - n1 * m) / sqrt(n1 * (n - n1) * v / (n - 1)), 5) AS z FROM g JOIN a USING (variable)"
)
def st6_permutation(t):
    return stats.permutation_tests(t.values(), "grp", "variable", "value").withColumn("z", F.round("z", 5))


@query()
def st6_p_values(t):
    return r6(stats.group_tests(t.values(), "grp", "variable", "value", p_values=True).select("grp", "variable", "p_value"), "p_value")


@query("SELECT event_type, CAST(user_id % 8 AS VARCHAR) AS variable, round(avg(value - 20), 6) AS avg_value, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS pct_value FROM events GROUP BY 1, 2")
def ag14_average_and_share(t):
    e = t["events"].select("event_type", (F.col("user_id") % 8).cast("string").alias("variable"), (F.col("value") - 20).alias("v"))
    return r6(stats.average_and_share(e, "event_type", "variable", "v"), "avg_value", "pct_value")


_PAIR = "{w}, p AS (SELECT a.{i} AS a, b.{i} AS b, count(*) AS n, corr(a.v, b.v) AS r FROM x a JOIN x b ON a.{k} = b.{k} AND a.{i} <= b.{i} GROUP BY 1, 2) SELECT a, b, n, round(r, 6) AS r FROM p"


@query(_PAIR.format(w=sql("counts") + ", x AS (SELECT sample, gene, value AS v FROM counts)", i="gene", k="sample"))
def st1_pearson(t):
    return r6(stats.pair_correlations(t.counts(), "gene", "sample", "value").select("a", "b", "n", "r"), "r")


@query(_PAIR.format(w=sql("counts") + ", x AS (SELECT gene, sample, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS v FROM counts)", i="gene", k="sample"))
def st2_spearman(t):
    return r6(stats.pair_correlations(t.counts(), "gene", "sample", "value", "spearman").select("a", "b", "n", "r"), "r")


@query(_PAIR.format(w=sql("counts") + ", x AS (SELECT gene, sample, ln(value + 1) AS v FROM counts)", i="sample", k="gene"))
def st3_sample_correlation(t):
    return r6(stats.sample_correlation(t.counts()).select("a", "b", "n", "r"), "r")


_BOTH = sql("counts") + ", p AS (SELECT a.gene AS a, b.gene AS b, count(*) AS n, corr(a.value, b.value) AS r FROM counts a JOIN counts b ON a.sample = b.sample GROUP BY 1, 2)"


@query(_BOTH + " SELECT a, b, n, round(CASE WHEN a >= b THEN r END, 6) AS r FROM p")
def st1_correlation_triangle(t):
    return r6(stats.correlation_plot(t.counts(), "gene", "sample", "value", triangle="lower").select("a", "b", "n", "r"), "r")


@query()
def st1_correlation_plot(t):
    return r6(stats.correlation_plot(t.counts(), "gene", "sample", "value", triangle="lower"), "r", "p_value", "p_adj")


@query()
def st15_network(t):
    return r6(stats.network_edges(t.counts(), level=0.5), "r", "p_value", "p_adj")


def _regulators(t) -> DataFrame:
    return t.expression().select("gene").distinct().filter(F.regexp_extract("gene", "([0-9]+)", 1).cast("int") % 10 == 0)


@query()
def st16_regulators(t):
    return r6(networks.regulator_importances(t.expression(), _regulators(t), trees=10, depth=4), "weight")


_POWER = (
    sql("expr") + ", x AS (SELECT gene, sample, log2(value + 1) AS v FROM expr), p AS (SELECT a.gene AS a, b.gene AS b, corr(a.v, b.v) AS r FROM x a JOIN x b ON a.sample = b.sample AND a.gene <> b.gene GROUP BY 1, 2),"
    " j AS (SELECT a, b, sign(r) * pow(abs(r), 6) AS x FROM p), k AS (SELECT a, sum(abs(x)) AS k FROM j GROUP BY 1)"
)


@query(
    _POWER + ", s AS (SELECT u.a AS a, v.b AS b, sum(u.x * v.x) AS s FROM j u JOIN j v ON u.b = v.a AND u.a < v.b GROUP BY 1, 2)"
    " SELECT a, b, round(abs(j.x + s) / (least(ka.k, kb.k) + 1 - abs(j.x)), 6) AS overlap FROM s JOIN j USING (a, b) JOIN k ka USING (a) JOIN (SELECT a AS b, k FROM k) kb USING (b)"
)
def st17_overlap(t):
    logs = t.expression().select("gene", "sample", F.log2(F.col("value") + 1).alias("v"))
    return r6(topological_overlaps(centred(logs, "gene", "sample", "v"), 6), "overlap")


@query(
    sql("expr") + ", x AS (SELECT gene, sample, log2(value + 1) AS v FROM expr), p AS (SELECT a.gene AS a, b.gene AS b, corr(a.v, b.v) AS r FROM x a JOIN x b ON a.sample = b.sample AND a.gene <> b.gene GROUP BY 1, 2), k AS (SELECT power, a, sum(pow(abs(r), power)) AS k FROM p, (SELECT unnest(range(1, 11)) AS power) GROUP BY 1, 2),"
    " e AS (SELECT power, min(k) AS lo, max(k) AS hi, avg(k) AS av, count(*) AS n FROM k GROUP BY 1), h AS (SELECT power, least(9, greatest(0, ceil((k - lo) / (hi - lo) * 10) - 1)) AS bin, count(*) AS c, avg(k) AS k, any_value(n) AS n, any_value(av) AS av FROM k JOIN e USING (power) GROUP BY 1, 2)"
    " SELECT CAST(power AS INTEGER) AS power, round(-sign(regr_slope(log10(c / n), log10(k))) * regr_r2(log10(c / n), log10(k)), 6) AS fit, round(regr_slope(log10(c / n), log10(k)), 6) AS slope, round(any_value(av), 6) AS mean_connectivity FROM h GROUP BY 1"
)
def st17_powers(t):
    return r6(networks.power_table(t.expression()), "fit", "slope", "mean_connectivity")


@query()
def st17_modules(t):
    return networks.modules(t.expression(), power=2, least=15)


@query(
    sql("coef") + ", k AS (SELECT *, row_number() OVER (ORDER BY pvalue, model) AS i, count(*) OVER () AS n FROM coef WHERE term_pos >= 4), j AS (SELECT *, least(1.0, min(pvalue * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM k),"
    " m AS (SELECT model, row_number() OVER (ORDER BY max(exp(estimate)) DESC, model) AS model_order FROM j GROUP BY 1)"
    " SELECT model, model_order, term_pos, term, round(exp(estimate), 6) AS estimate, round(exp(lower), 6) AS lower, round(exp(upper), 6) AS upper, round(pvalue, 6) AS pvalue, round(q, 6) AS p_adj FROM j JOIN m USING (model)"
)
def st18_forest(t):
    return r6(whole(stats.forest_table(t.coefficients()), "model_order"), "estimate", "lower", "upper", "pvalue", "p_adj")


@query(
    sql("coef") + ", k AS (SELECT *, row_number() OVER (ORDER BY pvalue, model) AS i, count(*) OVER () AS n FROM coef WHERE term_pos = 6), j AS (SELECT *, least(1.0, min(pvalue * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM k)"
    " SELECT model, term, round(exp(estimate), 6) AS estimate, round(pvalue, 6) AS pvalue, round(q, 6) AS p_adj, CASE WHEN log2(exp(estimate)) >= 0.1 AND q <= 0.9 THEN 'Higher' WHEN log2(exp(estimate)) <= -0.1 AND q <= 0.9 THEN 'Lower' ELSE 'Unchanged' END AS status FROM j"
)
def st19_volcano_models(t):
    return r6(stats.volcano_models(t.coefficients(), cut=0.1, level=0.9), "estimate", "pvalue", "p_adj")


# ---- spatial ------------------------------------------------------------------------------------------------------

_D = "(SELECT a.cell_id, a.sample, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS {n} FROM cells a JOIN cells b ON {s} b.cluster = '{c}' WHERE a.cluster = '{o}' GROUP BY 1, 2)"
_D12, _D13 = (_D.format(n=n, c=c, o="0", s="a.sample = b.sample AND") for n, c in (("d12", "1"), ("d13", "2")))
_RATIO = sql("cells") + f", d AS (SELECT cell_id, sample, d12, d13, d12 / d13 AS ratio FROM {_D12} p JOIN {_D13} q USING (cell_id, sample))"


@query(sql("cells") + " SELECT cell_id, sample, round(distance, 6) AS distance FROM " + _D.format(n="distance", c="1", o="0", s="a.sample = b.sample AND") + " q")
def j6_nearest(t):
    return r6(spatial.nearest(t.cells(), "0", "1"), "distance")


@query(_RATIO + " SELECT cell_id, sample, round(d12, 6) AS d12, round(d13, 6) AS d13, round(ratio, 6) AS ratio FROM d")
def ag23_spatial_ratios(t):
    return r6(spatial.distance_ratios(t.cells(), "0", "1", "2"), "d12", "d13", "ratio")


@query(
    _RATIO + " SELECT sample, count(*) AS n_cells, round(avg(ratio), 6) AS relative_distance, count(*) FILTER (WHERE ratio > 1) AS n_above, count(*) FILTER (WHERE ratio < 1) AS n_below, round((count(*) FILTER (WHERE ratio > 1) + 1) / (count(*) FILTER (WHERE ratio < 1) + 1), 6) AS relative_number FROM d GROUP BY 1"
)
def ag21_spatial_score(t):
    return r6(spatial.spatial_score(t.cells(), "0", "1", "2"), "relative_distance", "relative_number")


_N12, _N13 = (_D.format(n=n, c=c, o="0", s="") for n, c in (("d12", "1"), ("d13", "2")))


@query(sql("cells") + f" SELECT c.cell_id, cluster, CASE WHEN d12 < d13 THEN '0_1' WHEN cluster = '0' THEN '0_2' WHEN cluster IN ('1', '2') THEN cluster END AS subtype FROM cells c LEFT JOIN {_N12} p USING (cell_id) LEFT JOIN {_N13} q USING (cell_id)")
def ag24_subtype(t):
    return spatial.assign_subtype(t.cells(), "0", "1", "2")


@query(sql("edge") + " SELECT * FROM edge")
def st13_edges(t):
    return whole(spatial.edges(t.neighbours()), "point_1", "point_2")


_EDGES = (
    ", l AS (SELECT e.sample, a.cluster AS c1, b.cluster AS c2 FROM edge e JOIN near a ON a.sample = e.sample AND a.point = point_1 JOIN near b ON b.sample = e.sample AND b.point = point_2), s AS (SELECT sample, c1, c2, count(*) AS n FROM (SELECT * FROM l UNION ALL SELECT sample, c2, c1 FROM l) GROUP BY 1, 2, 3),"
    " ty AS (SELECT DISTINCT sample, cluster FROM near), ec AS (SELECT a.sample, a.cluster AS c1, b.cluster AS c2, CAST(coalesce(n, 0) AS BIGINT) AS n FROM ty a JOIN ty b USING (sample) LEFT JOIN s ON s.sample = a.sample AND s.c1 = a.cluster AND s.c2 = b.cluster)"
)


@query(sql("edge") + _EDGES + " SELECT * FROM ec")
def ag19_edge_counts(t):
    n = t.neighbours()
    return spatial.edge_counts(spatial.edges(n), n)


@query(sql("edge") + _EDGES + ", d AS (SELECT sample, c1, sum(n) FILTER (WHERE c1 <> c2) AS d FROM ec GROUP BY 1, 2) SELECT ec.sample, ec.c1, ec.c2, round(CASE WHEN ec.c1 = ec.c2 THEN 0 ELSE n / (a.d + b.d + 1) END, 6) AS score FROM ec JOIN d a ON a.sample = ec.sample AND a.c1 = ec.c1 JOIN d b ON b.sample = ec.sample AND b.c1 = ec.c2")
def ag20_excluded_score(t):
    n = t.neighbours()
    return r6(spatial.excluded_score(spatial.edge_counts(spatial.edges(n), n)), "score")


@query()
def st12_neighbourhood_test(t):
    n = t.neighbours()
    return r6(spatial.neighbourhood_test(spatial.edges(n), n), "observed", "score")


@query()
def st11_ternary_test(t):
    return r6(spatial.ternary_test(t.cells(), "0", "1", "2"), "observed", "zscore")


# ---- images -------------------------------------------------------------------------------------------------------


@query(sql("pixels", "mask") + " SELECT image, label, channel, round(avg(v), 6) AS mean_v FROM pixels JOIN mask USING (image, row, col) WHERE label <> 0 GROUP BY 1, 2, 3")
def ag15_zonal_mean(t):
    return r6(image.zonal_mean(t.pixels(), t.mask()), "mean_v")


@query(
    sql("mask") + ", g AS (SELECT image, label, count(*) AS area, avg(row) AS cr, avg(col) AS cc, var_pop(row) AS a, var_pop(col) AS c, covar_pop(row, col) AS b FROM mask WHERE label <> 0 GROUP BY 1, 2), h AS (SELECT *, (a + c + sqrt(pow(a - c, 2) + 4 * b * b)) / 2 AS l1, greatest(0, (a + c - sqrt(pow(a - c, 2) + 4 * b * b)) / 2) AS l2 FROM g)"
    " SELECT image, label, area, round(cr, 6) AS centroid_row, round(cc, 6) AS centroid_col, round(4 * sqrt(l1), 6) AS major_axis, round(4 * sqrt(l2), 6) AS minor_axis, round(CASE WHEN l1 = 0 THEN 0 ELSE sqrt(greatest(0, 1 - l2 / l1)) END, 6) AS eccentricity FROM h"
)
def ag16_region_props(t):
    return r6(image.region_props(t.mask()), "centroid_row", "centroid_col", "major_axis", "minor_axis", "eccentricity")


@query()
def ag17_solidity(t):
    return r6(image.solidity(t.mask()), "solidity")


@query(
    sql("mask") + " SELECT m.image, m.row, m.col, m.label, m.label <> 0 AND EXISTS (SELECT 1 FROM mask o WHERE o.image = m.image AND abs(o.row - m.row) + abs(o.col - m.col) = 1 AND o.label <> m.label) AS boundary FROM mask m"
)
def n9_boundary(t):
    return image.boundary(t.mask())


@query(
    sql("pixels") + ", h AS (SELECT image, channel, round(quantile_cont(v, 0.98) FILTER (WHERE v <> 0), 9) AS hi FROM pixels GROUP BY 1, 2), c AS (SELECT image, channel, row, col, least(v, coalesce(hi, v)) AS v FROM pixels JOIN h USING (image, channel)), l AS (SELECT image, channel, round(quantile_cont(v, 0.02) FILTER (WHERE v <> 0), 9) AS lo FROM c GROUP BY 1, 2)"
    " SELECT image, channel, row, col, round(CASE WHEN v < coalesce(lo, 0) THEN 0 ELSE v END, 6) AS v FROM c JOIN l USING (image, channel)"
)
def n4_denoise(t):
    return r6(image.denoise(t.pixels()).select("image", "channel", "row", "col", "v"), "v")


#: Groups of event types that stand for marker groups.
_GROUPS = {"nuclear": [["error"]], "membrane": [["click", "view"], ["purchase"]]}


@query(
    sql("pixels") + ", s AS (SELECT image, channel, row, col, coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0) AS s FROM pixels WINDOW w AS (PARTITION BY image, channel)), m AS (SELECT * FROM (VALUES ('error', 'nuclear', 0), ('click', 'membrane', 0), ('view', 'membrane', 0), ('purchase', 'membrane', 1)) AS v(channel, \"out\", grp)),"
    " g AS (SELECT image, row, col, \"out\", grp, sum(s) AS v FROM s JOIN m USING (channel) GROUP BY 1, 2, 3, 4, 5), h AS (SELECT image, row, col, \"out\", CASE WHEN \"out\" = 'membrane' THEN coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0) ELSE v END AS v FROM g WINDOW w AS (PARTITION BY image, \"out\", grp))"
    " SELECT image, row, col, \"out\", round(sum(v), 6) AS v FROM h GROUP BY 1, 2, 3, 4"
)
def n5_two_channels(t):
    return r6(image.two_channels(t.pixels(), _GROUPS), "v")


@query(
    sql("pixels") + ", l AS (SELECT image, channel, row, col, log2(v + 1) AS v FROM pixels WHERE channel IN ('click', 'view', 'error')), h AS (SELECT image, channel, round(quantile_cont(v, 0.99) FILTER (WHERE v <> 0), 9) AS hi FROM l GROUP BY 1, 2), c AS (SELECT image, channel, row, col, least(v, coalesce(hi, v)) AS v FROM l JOIN h USING (image, channel)),"
    " o AS (SELECT image, channel, round(quantile_cont(v, 0.1) FILTER (WHERE v <> 0), 9) AS lo FROM c GROUP BY 1, 2), f AS (SELECT image, channel, row, col, CASE WHEN v <= coalesce(lo, 0) THEN 0 ELSE v END AS v FROM c JOIN o USING (image, channel)), s AS (SELECT image, channel, row, col, coalesce(v / nullif(max(v) OVER (PARTITION BY image, channel), 0), 0) * 255 AS s FROM f)"
    " SELECT image, row, col, CAST(trunc(sum(CASE WHEN channel IN ('click', 'error') THEN s ELSE 0 END)) AS INTEGER) AS r, CAST(trunc(sum(CASE WHEN channel IN ('view', 'error') THEN s ELSE 0 END)) AS INTEGER) AS g, CAST(trunc(sum(CASE WHEN channel = 'none' THEN s ELSE 0 END)) AS INTEGER) AS b FROM s GROUP BY 1, 2, 3"
)
def n6_pseudo_colour(t):
    return image.pseudo_colour(t.pixels(), {"click": "red", "view": "green", "error": "yellow"})


@query(
    sql("pixels", "mask") + ", q AS (SELECT *, quantile_cont(v, 0.99) OVER (PARTITION BY image, row, col) AS hi FROM pixels), c AS (SELECT image, channel, row, col, least(v, hi) AS v FROM q), z AS (SELECT *, (v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) AS z FROM c WINDOW w AS (PARTITION BY image, row, col)),"
    " g AS (SELECT image, channel, CASE WHEN label % 2 = 1 THEN 'nuclei' WHEN label <> 0 THEN 'cytoplasm' ELSE 'background' END AS region, avg(z) AS m FROM z JOIN mask USING (image, row, col) GROUP BY 1, 2, 3)"
    " SELECT image, channel, region, round(m, 6) AS mean_z, round((m - avg(m) OVER w) / stddev_pop(m) OVER w, 6) AS z FROM g WINDOW w AS (PARTITION BY image, channel)"
)
def ag18_compartments(t):
    m = t.mask()
    nucleus = m.withColumn("label", F.when(F.col("label") % 2 == 1, F.col("label")).otherwise(0))
    return r6(image.compartments(t.pixels(), m, nucleus), "mean_z", "z")


@query(sql("mask") + ", b AS (SELECT m.*, m.label <> 0 AND EXISTS (SELECT 1 FROM mask o WHERE o.image = m.image AND abs(o.row - m.row) + abs(o.col - m.col) = 1 AND o.label <> m.label) AS e FROM mask m) SELECT image, row, col, label, CASE WHEN e THEN 255 WHEN label = 0 THEN 0 ELSE 10 * (label % 3) + 10 END AS code FROM b")
def n8_painted(t):
    m = t.mask()
    cells = m.filter("label <> 0").select("image", "label", (F.col("label") % 3).alias("cluster")).distinct()
    colours = cells.select("cluster", (10 * F.col("cluster") + 10).cast("int").alias("code")).distinct()  # a row for each cluster
    return image.painted(m, cells, colours)


@query(sql("pixels") + " SELECT image, channel, row, col, CASE WHEN channel IN ('error') THEN 0.0 ELSE v END AS v, channel <> 'error' AS for_analysis FROM pixels")
def pf9_without_channels(t):
    return image.without_channels(t.pixels(), ["error"]).select("image", "channel", "row", "col", "v", "for_analysis")


# ---- similarity and clusters --------------------------------------------------------------------------------------

_SIM = sql("vecs") + ", s AS (SELECT a.item AS a, b.item AS b, sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)) AS sim FROM vecs a JOIN vecs b USING (key) GROUP BY 1, 2)"


@query(_SIM + " SELECT a, b, round(sim, 6) AS sim FROM s")
def hc1_cosine(t):
    return r6(cluster.similarity(t.vectors()), "sim")


@query(sql("vecs") + " SELECT a.item AS a, b.item AS b, round(-sqrt(sum((a.value - b.value) * (a.value - b.value))), 6) AS sim FROM vecs a JOIN vecs b USING (key) GROUP BY 1, 2")
def hc1_euclidean(t):
    return r6(cluster.similarity(t.vectors(), method="euclidean"), "sim").withColumn("sim", F.when(F.col("sim") == 0, 0.0).otherwise(F.col("sim")))


@query(_SIM + " SELECT CAST(a AS INTEGER) % 3 AS c1, CAST(b AS INTEGER) % 3 AS c2, round(avg(sim), 6) AS mean_sim FROM s WHERE a <> b GROUP BY 1, 2")
def ag13_block_means(t):
    v = t.vectors()
    labels = v.select("item", (F.col("item").cast("int") % 3).alias("cluster")).distinct()
    return r6(cluster.block_means(cluster.similarity(v), labels), "mean_sim")


@query()
def hc2_hierarchical(t):
    return cluster.hierarchical(cluster.similarity(t.vectors()), 3)


@query()
def so5_branch_order(t):
    return cluster.hierarchical_profiles(t.expression(), "gene", "sample", "value", 4, "weights")


@query()
def pt5_ordered_plot(t):
    rows = t["lineitem"].join(t["part"].select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return plots.ordered_plot(rows, "p_type", "p_brand", "l_extendedprice")


def _consensus(t, only=None):
    return cluster.consensus_profiles(t.expression(), "gene", "sample", "value", max_k=4, repeats=6, only=only)


@query()
def hc5_consensus_classes(t):
    return _consensus(t)[0]


@query()
def hc5_consensus_areas(t):
    return r6(_consensus(t, "areas")[1], "area", "gain")


_PAIRS = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), d AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS l, b.label AS m, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)"


@query(_PAIRS + ", r AS (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM d) SELECT i AS vec_id, CAST(k AS INTEGER) AS rank, j AS neighbour, round(d, 6) AS distance FROM r WHERE k <= 10")
def hc9_nearest_neighbours(t):
    return r6(neighbours.nearest_neighbours(t["embeddings"], "vec_id", "embedding", 10), "distance")


@query(
    _PAIRS + ", n AS (SELECT label, count(*) AS n FROM e GROUP BY 1), g AS (SELECT i, l, m, sum(d) / CASE WHEN l = m THEN any_value(n) - 1 ELSE any_value(n) END AS v FROM d JOIN n ON n.label = m GROUP BY 1, 2, 3),"
    " s AS (SELECT i, l, max(v) FILTER (WHERE l = m) AS a, min(v) FILTER (WHERE l <> m) AS b, arg_min(m, v) FILTER (WHERE l <> m) AS c FROM g GROUP BY 1, 2) SELECT i AS vec_id, l AS cluster, c AS neighbour, round((b - a) / greatest(a, b), 6) AS width FROM s"
)
def hc4_silhouettes(t):
    return r6(neighbours.silhouettes(t["embeddings"].withColumnRenamed("label", "cluster"), "vec_id", "embedding"), "width")


@query(
    _PAIRS + ", n AS (SELECT label, count(*) AS n FROM e GROUP BY 1), g AS (SELECT i, l, m, sum(d) / CASE WHEN l = m THEN any_value(n) - 1 ELSE any_value(n) END AS v FROM d JOIN n ON n.label = m GROUP BY 1, 2, 3), s AS (SELECT i, max(v) FILTER (WHERE l = m) AS a, min(v) FILTER (WHERE l <> m) AS b FROM g GROUP BY 1)"
    " SELECT round((SELECT avg((b - a) / greatest(a, b)) FROM s), 6) AS silhouette, round(min(d) FILTER (WHERE l <> m) / max(d) FILTER (WHERE l = m), 6) AS dunn FROM d"
)
def hc4_point_indices(t):
    return r6(neighbours.point_indices(t["embeddings"].withColumnRenamed("label", "cluster"), "vec_id", "embedding"), "silhouette", "dunn")


@query("WITH c AS (SELECT vec_id, label AS cluster, CASE WHEN label IN (2, 5) THEN 2 WHEN label IN (7, 1) THEN 7 ELSE label END AS g FROM embeddings) SELECT vec_id, cluster, CAST(dense_rank() OVER (ORDER BY g) AS INTEGER) AS combined FROM c")
def hc6_combine_clusters(t):
    return cluster.combine_clusters(t["embeddings"].select("vec_id", F.col("label").alias("cluster")), [[2, 5], [7, 1]]).select("vec_id", "cluster", F.col("combined").cast("int").alias("combined"))


@query(sql("counts") + ", b AS (SELECT gene, max({'v': value, 'c': sample}) AS m FROM counts GROUP BY 1) SELECT gene, m.c AS best_column, m.v AS best_value, row_number() OVER (ORDER BY m.c, m.v DESC, gene) AS position FROM b")
def hc7_reset_order(t):
    return whole(cluster.reset_order(t.counts(), "gene", "sample", "value"), "position")


@query(
    "WITH c AS (SELECT label AS a, vec_id % 5 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2), i AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT a, sum(n) AS n FROM c GROUP BY 1)), y AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT b, sum(n) AS n FROM c GROUP BY 1))"
    " SELECT round((n * (n - 1) / 2 + 2 * ij - x - y) / (n * (n - 1) / 2), 6) AS rand_index FROM i, x, y"
)
def hc8_rand_index(t):
    return r6(cluster.rand_index(t["embeddings"].withColumn("b", F.col("vec_id") % 5), "label", "b"), "rand_index")


@query(
    sql("cells") + ", c AS (SELECT cluster, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM cells GROUP BY 1), o AS (SELECT avg(x) AS ox, avg(y) AS oy FROM cells), w AS (SELECT cluster, sum(pow(x - cx, 2) + pow(y - cy, 2)) AS w, avg(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) AS s FROM cells JOIN c USING (cluster) GROUP BY 1),"
    " d AS (SELECT a.cluster, max((wa.s + wb.s) / sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2))) AS r FROM c a JOIN c b ON a.cluster <> b.cluster JOIN w wa ON wa.cluster = a.cluster JOIN w wb ON wb.cluster = b.cluster GROUP BY 1)"
    " SELECT round((sum(n * (pow(cx - ox, 2) + pow(cy - oy, 2))) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) AS calinski_harabasz, round(sum(w) / count(*), 6) AS ball, round((SELECT avg(r) FROM d), 6) AS davies_bouldin FROM c JOIN w USING (cluster), o"
)
def hc4_cluster_indices(t):
    return r6(cluster.cluster_indices(t.cells(), ["x", "y"]), "calinski_harabasz", "ball", "davies_bouldin")


@query(
    sql("cells") + ", c AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy FROM cells GROUP BY 1), w AS (SELECT sum((x - cx) * (x - cx)) AS w11, sum((x - cx) * (y - cy)) AS w12, sum((y - cy) * (y - cy)) AS w22, count(*)::DOUBLE AS n, count(DISTINCT cluster)::DOUBLE AS k FROM cells JOIN c USING (cluster)),"
    " t AS (SELECT var_pop(x) * count(*) AS t11, covar_pop(x, y) * count(*) AS t12, var_pop(y) * count(*) AS t22 FROM cells), d AS (SELECT *, w11 * w22 - w12 * w12 AS dw, t11 * t22 - t12 * t12 AS dt FROM w, t)"
    " SELECT round(w11 + w22, 6) AS trace_w, round(n * ln(dt / dw), 6) AS scott, round(k * k * dw, 2) AS marriot, round((w22 * (t11 - w11) - 2 * w12 * (t12 - w12) + w11 * (t22 - w22)) / dw, 6) AS friedman, round(dt / dw, 6) AS rubin,"
    " round((sqrt((t11 - w11) / t11) + sqrt((t22 - w22) / t22)) / 2 / sqrt(k), 6) AS ratkowsky FROM d"
)
def hc4_scatter_indices(t):
    return r6(cluster.scatter_indices(t.cells(), ["x", "y"]), "trace_w", "scott", "friedman", "rubin", "ratkowsky").withColumn("marriot", F.round("marriot", 2))


@query()
def hc8_robustness(t):
    return r6(cluster.robustness(t.cells(), "cell_id", ["x", "y"]), "lowest", "median")



# ---- plot tables --------------------------------------------------------------------------------------------------

#: Names in order of first appearance count from 0, on both sides; heights are shares of the longer side.
_LINKED = (
    "WITH k AS (SELECT c_mktsegment AS l, 'r' || n_regionkey || n_nationkey % 2 AS r, min(c_custkey) AS o FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), a AS (SELECT l, row_number() OVER (ORDER BY min(o), l) - 1 AS i FROM k GROUP BY 1), b AS (SELECT r, row_number() OVER (ORDER BY min(o), r) - 1 AS i FROM k GROUP BY 1),"
    " m AS (SELECT (SELECT count(*) FROM a) AS n1, (SELECT count(*) FROM b) AS n2, greatest((SELECT count(*) FROM a), (SELECT count(*) FROM b))::DOUBLE AS n)"
)
_POINTS = _LINKED + " SELECT 'left' AS side, l AS name, round(i / n, 6) AS y FROM a, m UNION ALL SELECT 'right', r, round(({}) / n, 6) FROM b, m"


def _links(t) -> DataFrame:
    c = t["customer"].join(F.broadcast(t["nation"]), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return c.groupBy(F.col("c_mktsegment").alias("l"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), (F.col("n_nationkey") % 2).cast("string")).alias("r")).agg(F.min("c_custkey").alias("o"))


@query(_POINTS.format("i - (n2 - 1) + (n1 - 1)"))
def pt2_linked_points(t):
    return r6(plots.linked_layout(_links(t), "l", "r", "o", "top")[0], "y")


@query(_POINTS.format("(n1 - 1) / 2.0 - (n2 - 1) / 2.0 + i"))
def pt2_linked_center(t):
    return r6(plots.linked_layout(_links(t), "l", "r", "o", "center")[0], "y")


@query(_LINKED + " SELECT l AS \"left\", r AS \"right\", 2 AS x1, 3 AS x2, round(a.i / n, 6) AS y1, round(b.i / n, 6) AS y2 FROM k JOIN a USING (l) JOIN b USING (r), m")
def pt2_linked_segments(t):
    return r6(plots.linked_layout(_links(t), "l", "r", "o")[1], "y1", "y2")


@query(
    "WITH s AS (SELECT min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.01) AS q1, quantile_cont(value, 0.99) AS q9 FROM events), v AS (SELECT 0 AS stop, lo AS value FROM s UNION ALL SELECT 1 + k, q1 + (q9 - q1) * k / 4 FROM s, (SELECT unnest(range(5)) AS k) UNION ALL SELECT 6, hi FROM s)"
    " SELECT CAST(stop AS BIGINT) AS stop, round(value, 6) AS value, round((value - lo) / (hi - lo), 6) AS scaled FROM v, s"
)
def pt4_colour_stops(t):
    return r6(plots.colour_stops(t["events"], "value"), "value", "scaled")


_SUN = (
    "WITH r AS (SELECT o_orderstatus AS a, o_orderpriority AS b, sum(cast(o_custkey % 7 AS DOUBLE)) AS v FROM orders GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (ORDER BY a, b) AS o FROM r), x AS (SELECT 1 AS ring, 'o_orderstatus' AS dim, a AS level, sum(v) AS n, min(o) AS f FROM o GROUP BY a UNION ALL SELECT 2, 'o_orderpriority', b, sum(v), min(o) FROM o GROUP BY b)"
    " SELECT ring, dim, level, round(sum(n) OVER w - n, 6) AS ymin, round(sum(n) OVER w, 6) AS ymax, CAST(ring - 1 AS DOUBLE) AS xmin, CAST(ring AS DOUBLE) AS xmax FROM x WINDOW w AS (PARTITION BY ring ORDER BY f ROWS UNBOUNDED PRECEDING)"
)


@query(_SUN)
def pt6_sunburst(t):
    return r6(plots.sunburst(t["orders"].withColumn("_v", (F.col("o_custkey") % 7).cast("double")), ["o_orderpriority", "o_orderstatus"], "_v"), "ymin", "ymax")


@query(
    "WITH n AS (SELECT vec_id, label + 1 AS community FROM embeddings), j AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY vec_id) AS j, count(*) OVER (PARTITION BY community) AS m, max(community) OVER () AS c FROM n)"
    " SELECT vec_id, community, round(20 * cos(2 * pi() * (community - 1) / c) + 0.5 * m * cos(2 * pi() * (j - 1) / m), 6) AS x, round(20 * sin(2 * pi() * (community - 1) / c) + 0.5 * m * sin(2 * pi() * (j - 1) / m), 6) AS y FROM j"
)
def pt7_circular_layout(t):
    return r6(plots.circular_layout(t["embeddings"].select("vec_id", (F.col("label") + 1).alias("community")), "vec_id", "community"), "x", "y")


@query(
    "WITH g AS (SELECT l_returnflag AS x, l_linestatus AS g, l_linenumber AS v, avg(l_discount) AS value FROM lineitem GROUP BY 1, 2, 3), l AS (SELECT x, g, row_number() OVER (ORDER BY x, g) AS row_order FROM (SELECT DISTINCT x, g FROM g)) SELECT x || '_' || g AS row_key, row_order, CAST(v AS VARCHAR) AS variable, round(value, 6) AS value FROM g JOIN l USING (x, g)"
)
def pt8_condition_matrix(t):
    return r6(plots.condition_matrix(t["lineitem"], "l_returnflag", "l_linestatus", "l_linenumber", "l_discount"), "value")


@query("SELECT l_returnflag, round(avg(l_discount) FILTER (WHERE l_linestatus = 'F'), 6) AS \"F\", round(avg(l_discount) FILTER (WHERE l_linestatus = 'O'), 6) AS \"O\" FROM lineitem GROUP BY 1")
def rs2_pivot(t):
    g = t["lineitem"].groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_discount").alias("v"))
    return r6(plots.wide(g, "l_returnflag", "l_linestatus", "v", ["F", "O"]), "F", "O")


@query("SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS position FROM supplier")
def pt3_annotated_order(t):
    return plots.annotated_order(t["supplier"], "s_suppkey", "s_nationkey")


# ---- reshaping and sets -------------------------------------------------------------------------------------------


@query("SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def rs1_melt(t):
    return reshape.melt(t["part"], ["p_partkey"], ["p_size", "p_retailprice"])


@query(sql("counts") + " SELECT gene AS sample, sample AS gene, round(value, 6) AS value FROM counts")
def rs3_transpose(t):
    return r6(reshape.transposed(t.counts(), "gene", "sample"), "value")


@query("SELECT l_orderkey, l_linenumber, CAST(unnest(range(1, l_linenumber)) AS INTEGER) AS copy FROM lineitem")
def rs4_replicate(t):
    rows = t["lineitem"].select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).alias("n"))
    return reshape.replicated(rows, "n").drop("n")


@query("SELECT c_mktsegment AS name FROM customer UNION SELECT o_orderpriority FROM orders UNION SELECT event_type FROM events")
def se1_all_names(t):
    return reshape.all_names((t["customer"], "c_mktsegment"), (t["orders"], "o_orderpriority"), (t["events"], "event_type"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS name FROM customer INTERSECT SELECT CAST(o_custkey AS VARCHAR) FROM orders INTERSECT SELECT CAST(user_id AS VARCHAR) FROM events")
def se2_common_names(t):
    return reshape.common_names((t["customer"], "c_custkey"), (t["orders"], "o_custkey"), (t["events"], "user_id"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS name FROM customer EXCEPT SELECT CAST(user_id AS VARCHAR) FROM events EXCEPT SELECT CAST(s_suppkey + 200 AS VARCHAR) FROM supplier")
def se3_names_without(t):
    return reshape.names_without((t["customer"], "c_custkey"), (t["events"], "user_id"), (t["supplier"].withColumn("moved", F.col("s_suppkey") + 200), "moved"))


@query(sql("cells") + " SELECT cell_id, cluster, row_number() OVER (ORDER BY cluster, cell_id) AS position FROM cells")
def so4_cluster_order(t):
    return reshape.ordered_by_cluster(t.cells(), "cell_id", "cluster")


@query("SELECT CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS total_bytes, count(*) AS n_rows, count(DISTINCT source) AS n_distinct FROM documents")
def ag25_totals(t):
    return reshape.totals(t["documents"], F.octet_length("text"), "source")


@query(sql("counts") + " SELECT DISTINCT gene, gene IN ('Brand#11', 'Brand#23', 'Brand#35') AS highly_variable FROM counts")
def pf13_flags(t):
    return reshape.flagged(t.counts().select("gene").distinct(), "gene", ["Brand#11", "Brand#23", "Brand#35"])


@query(sql("cells") + " SELECT cell_id, sample, cluster, cluster AS \"Idents\" FROM cells")
def cv2_metadata(t):
    c = t.cells().select("cell_id", "sample", "cluster")
    return reshape.augmented(c, c, "cluster")[0]


@query(sql("mask") + " SELECT image || '-' || row || '-' || col AS cell_id, col AS array_row, row AS array_col FROM mask")
def cv4_array_coordinates(t):
    return reshape.array_coordinates(t.mask().withColumn("cell_id", F.concat_ws("-", "image", "row", "col")))


@query(sql("cells") + " SELECT 's' || sample AS image, cell_id, round(y, 6) AS spatial_0, round(x, 6) AS spatial_1 FROM cells")
def cv6_spatial_coordinates(t):
    c = t.cells()
    return r6(reshape.spatial_coordinates({f"s{k}": c.filter(F.col("sample") == str(k)) for k in range(4)}), "spatial_0", "spatial_1")


@query(sql("pixels") + " SELECT image, round(max(v), 6) AS fiducial_diameter_fullres, round(avg(v), 6) AS tissue_hires_scalef, round(avg(v) / 4, 6) AS tissue_lowres_scalef, round(0.6196 * max(v), 6) AS spot_diameter_fullres FROM pixels GROUP BY 1")
def cv5_scale_factors(t):
    per = t.pixels().groupBy("image").agg(F.max("v").alias("fiducial"), F.avg("v").alias("hires"), (F.avg("v") / 4).alias("lowres"))
    return r6(reshape.scale_factors(per), "fiducial_diameter_fullres", "tissue_hires_scalef", "tissue_lowres_scalef", "spot_diameter_fullres")


@query(
    sql("pixels", "mask") + ", o AS (SELECT image, label, round(avg(v), 6) AS v FROM pixels JOIN mask USING (image, row, col) WHERE label <> 0 AND channel = 'click' GROUP BY 1, 2), h AS (SELECT image, round(quantile_cont(v, 0.9) FILTER (WHERE v <> 0), 9) AS hi FROM o GROUP BY 1), c AS (SELECT image, label, least(v, coalesce(hi, v)) AS v FROM o JOIN h USING (image)),"
    " l AS (SELECT image, round(quantile_cont(v, 0) FILTER (WHERE v <> 0), 9) AS lo FROM c GROUP BY 1), f AS (SELECT image, label, CASE WHEN v <= coalesce(lo, 0) THEN 0 ELSE v END AS v FROM c JOIN l USING (image))"
    " SELECT m.image, m.row, m.col, m.label, round(coalesce(f.v, 0), 6) AS value, m.label <> 0 AND EXISTS (SELECT 1 FROM mask o WHERE o.image = m.image AND abs(o.row - m.row) + abs(o.col - m.col) = 1 AND o.label <> m.label) AS boundary FROM mask m LEFT JOIN f ON f.image = m.image AND f.label = m.label"
)
def n7_cell_expression(t):
    means = r6(image.zonal_mean(t.pixels().filter("channel = 'click'"), t.mask()), "mean_v")
    return r6(image.painted_values(t.mask(), means, "mean_v", 0.9), "value")


# ---- archives -----------------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def sc4_json(t):
    return t["events"].select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1))) AS links, len(list_filter(list_distinct(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1)), lambda x: NOT regexp_matches(x, '^[/?#]') AND NOT ends_with(x, '/'))) AS n_kept FROM pages")
def sc6_links(t):
    return t["pages"].select("page_id", archive.links(F.col("html"), keep_all=True).alias("links"), F.size(archive.links(F.col("html"))).cast("long").alias("n_kept"))


@query("SELECT doc_id, md5(text) AS md5, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents")
def sk2_md5(t):
    return t["documents"].select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), F.octet_length("text").cast("long").alias("size_bytes"))


@query(
    "SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'size_mismatch' WHEN doc_id % 3 = 0 THEN 'md5_mismatch' ELSE 'verified' END AS status FROM documents"
)
def sk3_verify(t):
    d = t["documents"].select(F.col("doc_id").alias("path"), F.octet_length("text").cast("long").alias("size_bytes"), F.upper(F.md5(F.col("text").cast("binary"))).alias("md5"))
    spoiled = d.filter("path % 7 <> 0").select("path", F.when(F.col("path") % 5 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"), F.when(F.col("path") % 3 == 0, F.lit("x")).otherwise(F.col("md5")).alias("md5"))
    return archive.verify(d, spoiled)


@query("SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 200) AS BIGINT) AS batch FROM orders")
def so7_batches(t):
    return archive.batches(t["orders"], "o_orderkey")


@query("SELECT c_custkey, substr(c_name, 1, length(c_name) - 3) || 'nnn' AS prefix, regexp_full_match(upper(trim('prjna' || c_custkey)), 'PRJNA[0-9]+') AS valid FROM customer")
def pf12_series_prefix(t):
    return t["customer"].select("c_custkey", archive.series_prefix(F.col("c_name")).alias("prefix"), archive.valid_project(F.concat(F.lit("prjna"), F.col("c_custkey").cast("string"))).alias("valid"))


@query("SELECT page_id, regexp_replace(replace(url, 'https://', 'http://mirror/'), '/[^/]*$', '/') || replace(url_encode('run ' || page_id || '/é*~'), '%2F', '/') AS moved FROM pages")
def pf11_moved_urls(t):
    name = F.concat(F.lit("run "), F.col("page_id").cast("string"), F.lit("/é*~"))
    return t["pages"].select("page_id", archive.moved_url(F.col("url"), "https://", "http://mirror/", name).alias("moved"))


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/cytolake-{uuid.uuid4().hex}"


@query("SELECT p_brand AS \"gsName\", CAST(p_partkey AS VARCHAR) AS \"gsGene\", CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END AS \"gsRange\", p_type AS \"gsSource\", 'a, \"b\"' AS \"gsCitation\" FROM part")
def sc1_gene_sets(t):
    rows = t["part"].select(F.col("p_brand").alias("gsName"), F.col("p_partkey").cast("string").alias("gsGene"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).alias("gsRange"), F.col("p_type").alias("gsSource"), F.lit('a, "b"').alias("gsCitation"))
    path = _folder(t)
    rows.write.option("header", True).option("escape", '"').csv(path)
    return archive.read_gene_sets(t.spark, path)


@query("SELECT 'R' || c_custkey AS \"Run\", c_name AS \"BioSample\", 'PRJNA1' AS \"BioProject\", c_mktsegment AS \"Note\" FROM customer")
def sc2_run_info(t):
    path = _folder(t)
    t["customer"].select(F.concat(F.lit("R"), F.col("c_custkey").cast("string")).alias("Run"), F.col("c_name").alias("BioSample"), F.lit("PRJNA1").alias("BioProject"), F.col("c_mktsegment").alias("Note")).write.option("header", True).csv(path)
    return archive.read_run_info(t.spark, path, t["customer"].count())


@query("SELECT 'R' || o_orderkey AS run_accession, 'B' || o_custkey AS biosample, o_orderstatus AS sample_name, o_custkey * 1000 AS size_bytes, md5(o_orderpriority) AS md5, 'http://m/' || o_orderkey AS url FROM orders")
def sc3_manifest(t):
    key = F.col("o_orderkey").cast("string")
    rows = t["orders"].select(
        F.concat(F.lit("R"), key).alias("run_accession"), F.concat(F.lit("B"), F.col("o_custkey").cast("string")).alias("biosample"), F.col("o_orderstatus").alias("sample_name"), (F.col("o_custkey") * 1000).alias("size_bytes"),
        F.md5(F.col("o_orderpriority").cast("binary")).alias("md5"), F.concat(F.lit("http://m/"), key).alias("url"),
    )
    path = _folder(t)
    archive.write_manifest(rows, path)
    return archive.read_manifest(t.spark, path)


@query("SELECT c_custkey, TRUE AS first, FALSE AS again FROM customer")
def sk1_write_new(t):
    path, rows = _folder(t), t["customer"].select("c_custkey")
    first, again = archive.write_new(rows, path), archive.write_new(rows.limit(1), path)
    return t.spark.read.parquet(path).select("c_custkey", F.lit(first).alias("first"), F.lit(again).alias("again"))


@query("SELECT o_orderkey AS path FROM orders WHERE NOT (o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0)")
def sk4_to_fetch(t):
    files = t["orders"].select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("size_bytes"), F.md5(F.col("o_orderstatus").cast("binary")).alias("md5"))
    there = files.filter("path % 3 <> 0").withColumn("size_bytes", F.when(F.col("path") % 5 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    return archive.to_fetch(files, there).select("path")


@query("SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all('<a> GSE' || doc_id || ' </a><b>GSE7</b><c>xGSE9</c>' , '>\\s*(GSE[0-9]+)\\s*<', 1), lambda x: x))) AS ids FROM documents")
def sc5_series(t):
    xml = F.concat(F.lit("<a> GSE"), F.col("doc_id").cast("string"), F.lit(" </a><b>GSE7</b><c>xGSE9</c>"))
    return t["documents"].select("doc_id", archive.series_ids(xml).alias("ids"))


@query("SELECT p_partkey AS name, CASE WHEN p_size > 25 THEN CAST(p_size AS BIGINT) END AS size_bytes FROM part")
def sc7_listing_sizes(t):
    files = t["part"].select(F.col("p_partkey").alias("name"), F.lit(None).cast("long").alias("size_bytes"))
    listing = t["part"].select(F.col("p_partkey").alias("name"), F.col("p_size").alias("size"), F.when(F.col("p_size") > 25, "Archive").otherwise("File").alias("kind"))
    return archive.with_sizes(files, listing).select("name", "size_bytes")
