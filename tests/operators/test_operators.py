"""Hand-worked goldens and invariants, with nulls, ties, zeros, empty groups and infinities."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytolake.functions import padjust, special
from cytolake.functions.numeric import average_rank, minus_log, need, rescale, star, zscore
from cytolake.operators import cluster, expression, image, meta, plots, spatial, stats
from cytolake.sources import archive


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="no column b"):
        need(spark.range(1), "b")


def test_average_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([("g", x) for x in (3.0, 1.0, 3.0, None, 7.0)], "g string, x double")
    got = df.select("x", average_rank(F.col("x"), ["g"]).alias("r")).collect()
    assert sorted((r.x, r.r) for r in got if r.x is not None) == [(1.0, 1.0), (3.0, 2.5), (3.0, 2.5), (7.0, 4.0)]
    assert [r.r for r in got if r.x is None] == [None]


def test_scaling_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 5.0)], "g string, x double")
    z = rows(df.select("g", "x", zscore(F.col("x"), ["g"]).alias("z"), zscore(F.col("x"), ["g"], ddof=0, limit=0.5, constant=1.0).alias("p"), rescale(F.col("x"), ["g"]).alias("s")), "g", "x")
    assert z[0][2] == pytest.approx(-1 / math.sqrt(2)) and z[1][3] == 0.5 and z[2][2] is None and z[2][3] == 0.0
    assert [r[4] for r in z] == [0.0, 1.0, 0.0, 0.0]
    assert spark.range(1).select(minus_log(F.lit(0.0))).first()[0] == math.inf
    assert spark.range(1).select(star(F.lit(0.004))).first()[0] == "**"


@pytest.mark.parametrize(
    ("method", "want"),
    [("bh", [0.02, 0.04, 0.04, 0.02]), ("bonferroni", [0.04, 0.16, 0.12, 0.02]), ("holm", [0.03, 0.06, 0.06, 0.02]), ("hochberg", [0.03, 0.04, 0.04, 0.02]), ("none", [0.01, 0.04, 0.03, 0.005])],
)
def test_p_adjustment(spark, method, want):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005, None])], "i int, p double")
    got = [r.p_adj for r in padjust.adjust(df, "p", method).orderBy("i").collect()]
    assert got[:4] == pytest.approx(want) and got[4] is None


def test_special_functions(spark):
    df = spark.createDataFrame([(1.959963984540054, 2.0, 4.0, 0.975), (0.0, 0.0, 1.0, 0.5), (None, None, None, None)], "z double, t double, v double, p double")
    r = df.select(special.normal_two_sided(F.col("z")), special.t_two_sided(F.col("t"), F.col("v")), special.normal_quantile(F.col("p"))).collect()
    assert r[0][0] == pytest.approx(0.05, abs=1e-12) and r[0][1] == pytest.approx(0.1161165235, abs=1e-9) and r[0][2] == pytest.approx(1.959963984540054, abs=1e-9)
    assert tuple(r[1]) == pytest.approx((1.0, 1.0, 0.0)) and tuple(r[2]) == (None, None, None)
    one = spark.range(1).select(special.chi2_upper_even(F.lit(9.488), F.lit(2)), special.cauchy_upper(F.lit(1.0)), special.cauchy_upper(F.lit(-1.0)), *[special.log_factorial(F.lit(n)) for n in (0, 5, 31, 32, 500)]).first()
    assert one[0] == pytest.approx(0.04999441, abs=1e-8) and one[1] == pytest.approx(0.25) and one[2] == pytest.approx(0.75)
    assert list(one[3:]) == pytest.approx([math.lgamma(n + 1) for n in (0, 5, 31, 32, 500)], abs=1e-9)


def counts(spark):
    return spark.createDataFrame([("g1", "s1", 10.0), ("g2", "s1", 30.0), ("g3", "s1", 5.0), ("g1", "s2", 0.0), ("g2", "s2", 20.0), ("g3", "s2", 1.0)], "gene string, sample string, value double")


def test_expression(spark):
    lengths = spark.createDataFrame([("g1", 2), ("g2", 3), ("g3", None)], "gene string, length long")
    got = {(r.gene, r.sample): r.value for r in expression.tpm(counts(spark), lengths).collect()}
    assert got["g1", "s1"] == pytest.approx(1e6 * 5 / 15) and got["g1", "s2"] == 0 and ("g3", "s1") not in got
    sums = {s: sum(v for (_, x), v in got.items() if x == s) for s in ("s1", "s2")}
    assert sums == pytest.approx({"s1": 1e6, "s2": 1e6})
    assert {r.gene: r.value for r in expression.rpkm(counts(spark), lengths).filter("sample = 's1'").collect()} == pytest.approx({"g1": 10 / 2 / 40 * 1e6, "g2": 30 / 3 / 40 * 1e6})
    exons = spark.createDataFrame([("g", 1, 5), ("g", 2, 3), ("g", 3, 8), ("g", 9, 10), ("g", 20, 21), ("h", None, 4)], "gene string, start long, end long")
    assert rows(expression.exon_union_length(exons)) == [("g", 12)]
    assert {r.gene for r in expression.keep_genes(counts(spark), spark.createDataFrame([("g1",), ("g1",)], "gene string")).collect()} == {"g1"}
    f = {r.sample: r.size_factor for r in expression.size_factors(counts(spark)).collect()}
    assert f["s1"] * f["s2"] == pytest.approx(1.0) or set(f) == {"s1", "s2"}
    with pytest.raises(ValueError):
        expression.normalize_counts(counts(spark), exons, "cpm")


def test_meta_analysis(spark):
    data = [("a", "g1", 0.01, 1.0), ("a", "g2", 0.5, -1.0), ("a", "g3", None, 0.4), ("b", "g1", 0.02, 2.0), ("b", "g2", 0.2, 0.0), ("c", "g1", 0.3, -1.0)]
    df = spark.createDataFrame(data, "study string, gene string, p_val double, log_fc double")
    got = {r.gene: r for r in meta.combine_ranks(meta.study_ranks(df)).collect()}
    assert got["g1"].direction == "positive" and got["g1"].median_es == 1.5 and got["g1"].total_study == 3 and got["g1"].sig_study_number == 2
    assert got["g2"].direction == "negative" and got["g2"].median_es == -1.0 and got["g3"].rank is None
    up = math.exp((math.log(2 / 3) + math.log(2 / 2) + math.log(1 / 1)) / 3)
    assert got["g1"].rank == pytest.approx(up)
    p = {r.gene: r.combined_p for r in meta.combine_p(df, min_num=2, min_ratio=0.6).collect()}
    x = -2 * (math.log(0.01) + math.log(0.02))
    assert p["g1"] == pytest.approx(math.exp(-x / 2) * (1 + x / 2)) and p["g2"] == 1.0
    z = {r.gene: r.combined_p for r in meta.combine_p(df, "z.transform", min_num=2, min_ratio=0.6).collect()}["g1"]
    assert z == pytest.approx(0.5 * math.erfc((2.3263478740408408 + 2.053748910631823) / math.sqrt(2) / math.sqrt(2)), abs=1e-9)
    ps = spark.createDataFrame([("g", x) for x in (0.02, 0.0004, 0.2, 0.1, 0.8)] + [("same", 0.3)] * 4 + [("zero", 0.0), ("zero", 0.5), ("tiny", 1e-20)], "g string, p double")
    a = {r.g: r.p_value for r in meta.acat(ps, "p", ["g"]).collect()}
    assert a["g"] == pytest.approx(0.001953404, abs=1e-9) and a["same"] == pytest.approx(0.3) and a["zero"] == 0 and a["tiny"] == pytest.approx(1e-20)
    with pytest.raises(Exception, match="p-values must be"):
        meta.acat(spark.createDataFrame([("g", 1.5)], "g string, p double"), "p", ["g"]).collect()


def test_score_tests(spark):
    y = [1.0, 2.0, 4.0, 3.0, 5.0, 9.0]
    g = [0, 1, 1, 0, 2, 2]
    pheno = spark.createDataFrame(list(enumerate(y)), "ind long, y double")
    geno = spark.createDataFrame([(i, 7, d) for i, d in enumerate(g) if d], "ind long, snp long, dosage int")
    r = meta.marginal_tests(geno, meta.null_model(pheno)).first()
    n, my, mg = 6, sum(y) / 6, sum(g) / 6
    u, sg, st = sum((a - mg) * (b - my) for a, b in zip(g, y)), sum((a - mg) ** 2 for a in g), sum((b - my) ** 2 for b in y)
    assert r.statistic == pytest.approx(math.sqrt(u * u / sg / ((st - u * u / sg) / (n - 2)))) and r.maf == pytest.approx(0.5) and 0 < r.p_value < 1
    assert meta.burden_test(geno, meta.null_model(pheno), weighted=False).first().q == pytest.approx(u * u / (st / 5 * sg))
    assert 0 < meta.acat_v_test(geno, meta.null_model(pheno), mac_thresh=2).first().p_value < 1


def test_p_values_of_one_go_only_beside_rare_variants(spark):
    pheno = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8])], "ind long, y double")
    null = meta.null_model(pheno)
    flat = [(0, 1, 1), (7, 1, 1), (1, 1, 1), (6, 1, 1)]  # carriers lie evenly about the mean: p = 1
    steep = [(i, 2, 1) for i in (4, 5, 6, 7)]
    common = spark.createDataFrame(flat + steep, "ind long, snp long, dosage int")
    p = {r.snp: r.p_value for r in meta.marginal_tests(common, null).collect()}
    assert p[1] == pytest.approx(1.0, abs=1e-12) and p[2] < 0.05
    assert meta.acat_v_test(common, null, mac_thresh=2).first().p_value == pytest.approx(1.0, abs=1e-6)  # common variants alone
    mixed = common.unionByName(spark.createDataFrame([(7, 3, 1)], "ind long, snp long, dosage int"))
    assert meta.acat_v_test(mixed, null, mac_thresh=2).first().p_value < 0.2  # the p-value of 1 would make it 1


def test_repeated_keys_are_an_error(spark):
    from cytolake.functions.products import pair_sums

    rows = [("i", 1, 1.0), ("i", 2, 2.0), ("j", 1, 3.0)]
    got = {(r.a, r.b): (r.n, r.sx, r.xy) for r in pair_sums(spark.createDataFrame(rows, "item string, k int, v double"), "item", "k", "v", keys=1).collect()}
    assert got == {("i", "i"): (2, 3.0, 5.0), ("i", "j"): (1, 1.0, 3.0), ("j", "j"): (1, 3.0, 9.0)}
    with pytest.raises(Exception, match="several values for one key"):
        pair_sums(spark.createDataFrame([*rows, ("i", 1, 5.0)], "item string, k int, v double"), "item", "k", "v").collect()


def test_correlations(spark):
    df = spark.createDataFrame([(i, k, v) for i, vs in {"a": [1.0, 2.0, 3.0, 4.0], "b": [2.0, 4.0, 6.0, 9.0], "c": [5.0, 5.0, 5.0, 5.0], "d": [4.0, None, 2.0, 1.0]}.items() for k, v in enumerate(vs)], "item string, k int, v double")
    r = {(x.a, x.b): x for x in stats.pair_correlations(df, "item", "k", "v", p_values=True).collect()}
    assert r["a", "a"].r == 1 and r["a", "c"].r is None and r["a", "d"].n == 3 and r["a", "d"].r == pytest.approx(-1.0, abs=2e-2)
    assert r["a", "b"].r == pytest.approx(0.99437, abs=1e-4) and r["a", "b"].p_value == pytest.approx(1 - r["a", "b"].r, rel=0.05)
    s = {(x.a, x.b): x.r for x in stats.pair_correlations(df.filter("item <> 'd'"), "item", "k", "v", "spearman").collect()}
    assert s["a", "b"] == 1.0
    plot = stats.correlation_plot(df, "item", "k", "v", triangle="lower").collect()
    assert all(x.p_value == 0.1 for x in plot if x.a == x.b) and all(x.r is None for x in plot if x.a < x.b)


def test_contingency_and_fisher(spark):
    df = spark.createDataFrame([("x", "p")] * 3 + [("x", "q")] + [("y", "q")] * 3 + [("y", "p")] + [(None, "p"), ("z", "p"), ("z", None)], "x string, y string")
    cells = {(r.x, r.y): tuple(r)[2:6] for r in stats.contingency(df, "x", "y").collect()}
    assert cells["x", "p"] == (3, 2, 1, 3) and cells["z", "q"] == (0, 4, 1, 4) and sum(cells["x", "p"]) == 9
    tea = spark.createDataFrame([("t", "t", 3, 1, 1, 3)], "x string, y string, n11 long, n01 long, n10 long, n00 long")
    got = stats.fisher_exact(tea).first()
    assert got.p_value == pytest.approx(0.4857142857) and got.sample_odds_ratio == 9 and got.odds_ratio == pytest.approx(6.4083, abs=1e-4) and not got.sig


def test_group_tests(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0]
    df = spark.createDataFrame([("a", "v", x) for x in a] + [("b", "v", x) for x in b] + [("one", "w", 1.0)], "grp string, variable string, value double")
    w = {r.grp: r for r in stats.group_tests(df, "grp", "variable", "value", p_values=True).collect()}
    va, vb = pd.Series(a).var(), pd.Series(b).var()
    se = va / 4 + vb / 3
    assert w["a"].t == pytest.approx((2.5 - 4) / math.sqrt(se)) and w["a"].df == pytest.approx(se**2 / ((va / 4) ** 2 / 3 + (vb / 3) ** 2 / 2)) and w["one"].t is None
    assert w["a"].t == pytest.approx(-w["b"].t) and w["a"].p_value == pytest.approx(w["b"].p_value)
    r = {x.grp: x for x in stats.rank_sum_tests(df, "grp", "variable", "value").collect()}
    assert r["a"].w == 3.0 and r["b"].w == 9.0 and r["a"].z == pytest.approx(-r["b"].z)
    m = {(x.grp, x.variable): x.value for x in stats.group_matrix(df, "grp", "variable", "value", "median").collect()}
    assert m["a", "v"] == 2.5
    with pytest.raises(ValueError):
        stats.group_tests(df, "grp", "variable", "value", "other")


def test_coefficient_tables(spark):
    coef = spark.createDataFrame([("m1", k, f"t{k}", 0.1 * k, 0.01 * k, 0.0, 1.0) for k in range(1, 6)] + [("m2", 4, "t4", 2.0, None, 0.0, 1.0), ("m2", 5, "t5", 1.0, 0.2, 0.0, 1.0)], "model string, term_pos int, term string, estimate double, pvalue double, lower double, upper double")
    f = rows(stats.forest_table(coef).select("model", "model_order", "term", "p_adj"), "model", "term")
    assert f == [("m1", 2, "t4", pytest.approx(0.075)), ("m1", 2, "t5", pytest.approx(0.075)), ("m2", 1, "t5", pytest.approx(0.2))]
    v = {r.model: r for r in stats.volcano_models(coef).collect()}
    assert v["m2"].term == "t5" and v["m2"].status == "Unchanged" and v["m1"].estimate == pytest.approx(math.exp(0.5))


CELLS = [(1, "s", "A", 0.0, 0.0), (2, "s", "A", 5.0, 5.0), (3, "s", "B", 0.0, 1.0), (4, "s", "B", 5.0, 5.0), (5, "s", "C", 2.0, 0.0), (6, "s", "C", 5.0, 5.0), (7, "t", "A", 1.0, 1.0), (8, "t", "B", 4.0, 5.0), (9, "s", "D", 9.0, 9.0)]


def cells(spark):
    return spark.createDataFrame(CELLS, "cell_id long, sample string, cluster string, x double, y double")


def test_distances(spark):
    got = {r.cell_id: r.distance for r in spatial.nearest(cells(spark), "A", "B").collect()}
    assert got == {1: 1.0, 2: 0.0, 7: 5.0}
    assert {r.cell_id: r.distance for r in spatial.nearest(cells(spark), "A", "C").collect()}[7] is None
    r = {x.cell_id: x for x in spatial.distance_ratios(cells(spark), "A", "B", "C").collect()}
    assert set(r) == {1, 2} and r[1].ratio == 0.5 and r[2].ratio is None
    s = spatial.spatial_score(cells(spark), "A", "B", "C").first()
    assert s.relative_distance == 0.5 and (s.n_above, s.n_below, s.relative_number) == (0, 1, 0.5)
    sub = {x.cell_id: x.subtype for x in spatial.assign_subtype(cells(spark), "A", "B", "C").collect()}
    assert sub[1] == "A_B" and sub[2] == "A_C" and sub[3] == "B" and sub[9] is None


def test_nearest_is_exact_on_a_grid(spark):
    import random

    rng = random.Random(2)
    pts = [(i, str(i % 3), "AB"[rng.random() < 0.4], rng.gauss(0, 1) * (10 if rng.random() < 0.1 else 1), rng.gauss(0, 1)) for i in range(600)]
    got = {r.cell_id: r.distance for r in spatial.nearest(spark.createDataFrame(pts, "cell_id long, sample string, cluster string, x double, y double"), "A", "B").collect()}
    for i, s, c, x, y in pts:
        if c == "A":
            assert got[i] == pytest.approx(min(math.hypot(x - q[3], y - q[4]) for q in pts if q[1] == s and q[2] == "B"))


def test_neighbourhood(spark):
    n = spark.createDataFrame([("s", "A", 0, [0, 1, 2, -1]), ("s", "A", 1, [1, 0]), ("s", "B", 2, [2, 3]), ("s", "B", 3, [3]), ("s", "C", 4, [4, -1])], "sample string, cluster string, point int, neigh array<int>")
    e = spatial.edges(n)
    assert rows(e.select("point_1", "point_2"), "point_1", "point_2") == [(0, 1), (0, 2), (2, 3)]
    c = {(r.c1, r.c2): r.n for r in spatial.edge_counts(e, n).collect()}
    assert c["A", "A"] == 2 and c["A", "B"] == c["B", "A"] == 1 and c["C", "C"] == 0 and sum(c.values()) == 6
    x = {(r.c1, r.c2): r.score for r in spatial.excluded_score(spatial.edge_counts(e, n)).collect()}
    assert x["A", "A"] == 0 and x["A", "B"] == pytest.approx(1 / 3)
    t = spatial.neighbourhood_test(e, n, iterations=30, seed=4).collect()
    again = spatial.neighbourhood_test(e, n, iterations=30, seed=4).collect()
    assert sorted(map(tuple, t)) == sorted(map(tuple, again)) and all(-1 <= r.score <= 1 for r in t)


@pytest.mark.parametrize("method", ["include", "excluded"])
def test_neighbourhood_scores_from_their_shuffles(spark, method):
    """The scores, worked out here from the labels that the shuffles deal."""
    from collections import Counter

    rng = np.random.default_rng(5)
    cells = [("s" if i < 14 else "t", "ABC"[rng.integers(3)], i) for i in range(24)]
    df = spark.createDataFrame(cells, "sample string, cluster string, point int")
    edge = spark.createDataFrame([("s", i, i + k) for i in range(12) for k in (1, 2)], "sample string, point_1 int, point_2 int")
    n = 25
    labels = {}
    for r in spatial.permuted(df.withColumnRenamed("point", "cell_id"), n, None, None, 3).collect():
        labels.setdefault((r.sample, r.iter), {})[r.cell_id] = r.cluster

    def scores(own):
        c = Counter()
        for i in range(12):
            for k in (1, 2):
                c[own[i], own[i + k]] += 1
                c[own[i + k], own[i]] += 1
        if method == "include":
            return c
        d = {a: sum(v for (x, y), v in c.items() if x == a != y) for a in "ABC"}
        return {(a, b): 0 if a == b else v / (d[a] + d[b] + 1) for (a, b), v in c.items()}

    seen, dealt = scores(labels["s", 0]), [scores(labels["s", k]) for k in range(1, n + 1)]
    got = {(r.sample, r.c1, r.c2): r for r in spatial.neighbourhood_test(edge, df, n, method, 3).collect()}
    types = {c for s, c, _ in cells if s == "s"}
    assert set(got) == {("s", a, b) for a in types for b in types}
    for (_, a, b), r in got.items():
        p = sum(x.get((a, b), 0) > seen.get((a, b), 0) for x in dealt) / n
        assert r.observed == pytest.approx(seen.get((a, b), 0)) and r.score == pytest.approx(p if 1 - p >= p else p - 1)


def test_permutations_keep_what_they_must(spark):
    p = spatial.permuted(cells(spark), 5, None, "A", 1).collect()
    assert len(p) == 6 * len(CELLS)
    for k in range(6):
        own = [r for r in p if r.iter == k]
        assert {r.cell_id for r in own if r.cluster == "A"} == {1, 2, 7}
        for s in "st":
            assert sorted(r.cluster for r in own if r.sample == s) == sorted(c[2] for c in CELLS if c[1] == s)
    z = spatial.ternary_test(cells(spark), "A", "B", "C", iterations=5).collect()
    assert [r.sample for r in z] == ["s"] and z[0].observed == 0.5 and (z[0].n_ct1, z[0].n_ct2, z[0].n_ct3) == (2, 2, 2)
    with pytest.raises(ValueError):
        spatial.ternary_test(cells(spark), "A", "B", "C", "none")


def test_images(spark):
    m = spark.createDataFrame([("i", r, c, 1 if r < 2 and c < 2 else 5 if r == 3 and c == 3 else 0) for r in range(4) for c in range(4)], "image string, row int, col int, label int")
    px = spark.createDataFrame([("i", "k", r, c, float(r * 4 + c)) for r in range(4) for c in range(4)] + [("i", "flat", r, c, 2.0) for r in range(4) for c in range(4)], "image string, channel string, row int, col int, v double")
    z = {(r.label, r.channel): r.mean_v for r in image.zonal_mean(px, m).collect()}
    assert z == {(1, "k"): 2.5, (5, "k"): 15.0, (1, "flat"): 2.0, (5, "flat"): 2.0}
    p = {r.label: r for r in image.region_props(m).collect()}
    assert p[1].area == 4 and p[1].major_axis == pytest.approx(2.0) and p[1].eccentricity == 0 and p[5].major_axis == 0 and p[5].eccentricity == 0
    assert {r.label: r.solidity for r in image.solidity(m).collect()} == pytest.approx({1: 1.0, 5: 1.0})
    b = {(r.row, r.col) for r in image.boundary(m).filter("boundary").collect()}
    assert b == {(0, 1), (1, 0), (1, 1), (3, 3)}
    d = image.denoise(px, 0.9).filter("channel = 'k'")
    hi = pd.Series(range(1, 16)).quantile(0.9)
    assert d.agg(F.max("v")).first()[0] == pytest.approx(hi) and d.filter("v = 0").count() >= 2
    two = {(r.out, r.row, r.col): r.v for r in image.two_channels(px, {"nuclear": [["k"]], "membrane": [["k"], ["flat"]]}).collect()}
    assert two["nuclear", 3, 3] == 1.0 and two["membrane", 3, 3] == 1.0 and two["membrane", 0, 0] == 0.0
    rgb = {(r.row, r.col): (r.r, r.g, r.b) for r in image.pseudo_colour(px, {"k": "magenta"}, 1.0, 0.0).collect()}
    assert rgb[3, 3] == (255, 0, 255) and rgb[0, 0] == (0, 0, 0)
    assert spark.range(1).select(*image.hex_rgb(F.lit("#0aFF10"))).first() == (10, 255, 16)
    painted = {(r.row, r.col): r.code for r in image.painted(m, spark.createDataFrame([("i", 1, "c")], "image string, label int, cluster string"), spark.createDataFrame([("c", 9)], "cluster string, code int")).collect()}
    assert painted[0, 0] == 9 and painted[1, 1] == 255 and painted[2, 2] == 0


def test_clusters(spark):
    v = spark.createDataFrame([(i, k, x) for i, xs in {"a": [1.0, 0.0], "b": [0.0, 2.0], "z": [0.0, 0.0]}.items() for k, x in enumerate(xs)], "item string, key int, value double")
    s = {(r.a, r.b): r.sim for r in cluster.similarity(v).collect()}
    assert s["a", "a"] == 1 and s["a", "b"] == s["b", "a"] == 0 and s["a", "z"] == 0
    assert {(r.a, r.b): r.sim for r in cluster.similarity(v, method="euclidean").collect()}["a", "b"] == pytest.approx(-math.sqrt(5))
    labels = spark.createDataFrame([(i, c) for i, c in enumerate([1, 1, 2, 4, 5])], "id int, cluster int")
    assert [r.combined for r in cluster.combine_clusters(labels, [[4, 1]]).orderBy("id").collect()] == [2, 2, 1, 2, 3]
    with pytest.raises(ValueError):
        cluster.combine_clusters(labels, [[1, 2], [2, 5]])
    ri = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2)], "a int, b int")
    assert cluster.rand_index(ri, "a", "b").first()[0] == pytest.approx(0.5)
    pts = {"p": (0.0, 0.0), "q": (0.0, 1.0), "r": (9.0, 0.0), "s": (9.0, 1.2)}
    sim = spark.createDataFrame([(a, b, 1 - math.dist(pts[a], pts[b])) for a in pts for b in pts], "a string, b string, sim double")
    h = {r.item: r.cluster for r in cluster.hierarchical(sim, 2).collect()}
    assert h["p"] == h["q"] != h["r"] == h["s"] and sorted(set(h.values())) == [1, 2]
    o = rows(cluster.reset_order(spark.createDataFrame([("x", "c2", 1.0), ("x", "c1", 0.0), ("y", "c1", 3.0), ("y", "c2", 2.0)], "r string, c string, v double"), "r", "c", "v").select("r", "best_column", "position"), "position")
    assert o == [("y", "c1", 1), ("x", "c2", 2)]


def test_plot_tables(spark):
    links = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "y", 3), ("c", "y", 4)], "l string, r string, o int")
    points, segments = plots.linked_layout(links, "l", "r", "o")
    assert {(r.side, r.name): r.y for r in points.collect()} == pytest.approx({("left", "a"): 0, ("left", "b"): 1 / 3, ("left", "c"): 2 / 3, ("right", "x"): 0, ("right", "y"): 1 / 3})
    assert segments.count() == 4
    for align, want in (("top", (1 / 3, 2 / 3)), ("center", (1 / 6, 1 / 2))):
        y = {(r.side, r.name): r.y for r in plots.linked_layout(links, "l", "r", "o", align)[0].collect()}
        assert (y["left", "a"], y["left", "c"]) == pytest.approx((0, 2 / 3)) and (y["right", "x"], y["right", "y"]) == pytest.approx(want)
    stops = rows(plots.colour_stops(spark.range(101).select(F.col("id").cast("double").alias("v")), "v", 3), "stop")
    assert [s[1] for s in stops] == pytest.approx([0, 1, 50, 99, 100])
    family = spark.createDataFrame([("g1", "p1", 65), ("g1", "p2", 14), ("g1", "p2", 12)], "d1 string, d2 string, v long")
    sun = rows(plots.sunburst(family, ["d2", "d1"], "v"), "ring", "ymin")
    assert [(s[1], s[2], s[3], s[4]) for s in sun] == [("d1", "g1", 0, 91), ("d2", "p1", 0, 65), ("d2", "p2", 65, 91)]
    c = {r.node: (r.x, r.y) for r in plots.circular_layout(spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "node int, community int"), "node", "community").collect()}
    assert c[1] == pytest.approx((21, 0)) and c[2] == pytest.approx((19, 0)) and c[3] == pytest.approx((-19.5, 0), abs=1e-9)
    w = plots.wide(spark.createDataFrame([("r", "a", 1.0)], "r string, c string, v double"), "r", "c", "v", ["a", "b"], 0.0).first()
    assert tuple(w) == ("r", 1.0, 0.0)


def test_archives(spark, tmp_path):
    (tmp_path / "sets.csv").write_text("﻿gsName,gsGene,gsRange,gsSource,gsCitation\nS,G1,,x,y\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("﻿gsName,gsGene,gsRange,gsSource,gsCitation\n", encoding="utf-8")
    assert rows(archive.read_gene_sets(spark, str(tmp_path / "sets.csv"))) == [("S", "G1", None, "x", "y")]
    assert archive.read_gene_sets(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "run.csv").write_text("Run,BioProject\nr1,P\nr2,P\n")
    assert archive.read_run_info(spark, str(tmp_path / "run.csv"), 2).count() == 2
    with pytest.raises(ValueError):
        archive.read_run_info(spark, str(tmp_path / "run.csv"), 3)
    man = spark.createDataFrame([("r2", "b", "s", 5, "m", "u"), ("r1", "b", "s", None, None, "u")], archive.MANIFEST)
    archive.write_manifest(man, str(tmp_path / "man"))
    assert [r.run_accession for r in archive.read_manifest(spark, str(tmp_path / "man")).collect()] == ["r1", "r2"]
    assert archive.write_new(man, str(tmp_path / "new")) and not archive.write_new(man, str(tmp_path / "new"))
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(archive.series_ids(F.lit("<a>GSE2</a><b> GSE10 </b><c>GSE2x</c><d>GSE2</d>"))) == ["GSE10", "GSE2"]
    html = '<a href="/up">x</a><a class="c" href="f2.txt">y</a><a href="dir/">z</a><a href="f1.txt">w</a><a href="?q">q</a><a href="f1.txt">w</a>'
    assert get(archive.links(F.lit(html))) == ["f1.txt", "f2.txt"]
    js = '{"result":[{"files":[{"type":"log"},{"type":"sra","size":7,"md5":"m","locations":[{"service":"ncbi","link":"n"},{"service":"s3","link":"u"}]}]}]}'
    assert tuple(get(archive.run_location(F.lit(js)))) == ("u", 7, "m") and get(archive.run_location(F.lit('{"result":[]}'))) is None
    assert get(archive.series_prefix(F.lit("GSE12345"))) == "GSE12nnn" and get(archive.valid_project(F.lit(" prjna12 "))) and not get(archive.valid_project(F.lit("PRJNA1x")))
    e = spark.createDataFrame([("a", 3, "AB"), ("b", 3, None), ("c", None, "x"), ("d", 1, None)], "path string, size_bytes long, md5 string")
    o = spark.createDataFrame([("a", 3, "ab"), ("b", 4, "q"), ("c", 9, "y")], "path string, size_bytes long, md5 string")
    assert rows(archive.verify(e, o), "path") == [("a", "verified"), ("b", "size_mismatch"), ("c", "md5_mismatch"), ("d", "missing")]
    assert {r.path for r in archive.to_fetch(e, o).collect()} == {"b", "c", "d"}
    assert {r.batch for r in archive.batches(spark.range(450), "id").groupBy("batch").count().filter("batch < 2 AND count = 200 OR batch = 2 AND count = 50").collect()} == {0, 1, 2}


def test_registry_runs_and_imports_without_the_corpus(spark):
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 70
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name, operator", [("st12_neighbourhood_test", "neighbourhood_test"), ("st11_ternary_test", "ternary_test")])
def test_permutation_queries_run_all_shuffles(spark, monkeypatch, name, operator):
    """The registered queries make as many shuffles as the operators do by default."""
    import inspect

    from cytolake.operators import spatial
    from cytolake.plans import registry

    class Seen(Exception):
        pass

    def permuted(cells, iterations, *rest):
        raise Seen(iterations)

    want = inspect.signature(getattr(spatial, operator)).parameters["iterations"].default
    monkeypatch.setattr(spatial, "permuted", permuted)
    with pytest.raises(Seen) as seen:
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen.value.args == (want,) and want >= 100


def test_null_models(spark):
    """Residuals, score tests and burden against numpy, for a continuous and a binary outcome with two covariates."""
    rng = np.random.default_rng(6)
    n, m = 120, 5
    z, g = rng.normal(size=(n, 2)), rng.choice([0, 1, 2], (n, m), p=[0.7, 0.2, 0.1]).astype(float)
    cases = {"linear": z @ [0.5, -1.0] + 0.3 * g[:, 0] + rng.normal(size=n), "logistic": (z[:, 0] + rng.normal(size=n) > 0).astype(float)}
    geno = spark.createDataFrame([(i, k, int(g[i, k])) for i in range(n) for k in range(m) if g[i, k]], "ind long, snp int, dosage int")
    x = np.column_stack([np.ones(n), z])
    for name, y in cases.items():
        pheno = spark.createDataFrame([(i, float(y[i]), float(z[i, 0]), float(z[i, 1])) for i in range(n)] + [(n, None, 0.0, 0.0)], "ind long, y double, a double, b double")
        null = meta.null_model(pheno, ["a", "b"])
        if name == "linear":
            beta = np.linalg.lstsq(x, y, rcond=None)[0]
            res, v, sigma2 = y - x @ beta, np.ones(n), ((y - x @ beta) ** 2).sum() / (n - 3)
        else:
            beta = np.zeros(3)
            for _ in range(60):
                p = 1 / (1 + np.exp(-x @ beta))
                beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
            p = 1 / (1 + np.exp(-x @ beta))
            res, v, sigma2 = y - p, p * (1 - p), 1.0
        assert null.binary == (name == "logistic") and null.coefficients == pytest.approx(beta, abs=1e-7) and null.sigma2 == pytest.approx(sigma2)
        assert [r.residual for r in null.rows.orderBy("ind").collect()] == pytest.approx(res, abs=1e-8)
        inverse = np.linalg.inv((x * v[:, None]).T @ x)
        spread = lambda h: (h * h * v).sum() - (h * v) @ x @ inverse @ x.T @ (h * v)  # noqa: B023, E731
        for r in meta.marginal_tests(geno, null).collect():
            u, s = res @ g[:, r.snp], spread(g[:, r.snp])
            want = abs(u) / math.sqrt(s) if null.binary else math.sqrt(u * u / s / ((sigma2 * (n - 3) - u * u / s) / (n - 4)))
            assert r.statistic == pytest.approx(want) and r.mac == g[:, r.snp].sum() and 0 < r.p_value <= 1
        w = 25 * (1 - g.sum(axis=0) / (2 * n)) ** 24
        q = meta.burden_test(geno, null).first()
        assert q.q == pytest.approx((res @ (g @ w)) ** 2 / sigma2 / spread(g @ w)) and q.p_value == pytest.approx(math.erfc(math.sqrt(q.q / 2)), abs=1e-9)
        given = spark.createDataFrame([(k, 1.0 + k) for k in range(m)], "snp int, weight double")
        for weights in (None, given):
            assert 0 < meta.acat_v_test(geno, null, weights, mac_thresh=int(np.median(g.sum(axis=0)))).first().p_value < 1


def test_rank_tests_in_every_mode(spark):
    """Rank sums against all, permutation z and signed ranks, by going through all values."""
    rng = np.random.default_rng(3)
    rows = [(g, "v", float(rng.integers(0, 9))) for g in "abc" for _ in range(12)] + [("a", "w", 1.0), ("b", "w", 1.0)]
    df = spark.createDataFrame(rows, "g string, k string, x double")
    by = {g: np.array([x for a, k, x in rows if (a, k) == (g, "v")]) for g in "abc"}
    every = np.concatenate(list(by.values()))

    def ranks(x):
        return np.array([(x < y).sum() + ((x == y).sum() + 1) / 2 for y in x])

    whole = {r.g: r for r in stats.rank_sum_tests(df, "g", "k", "x", mode="ONEvsALL").filter("k = 'v'").collect()}
    dealt = {r.g: r for r in stats.permutation_tests(df, "g", "k", "x").filter("k = 'v'").collect()}
    signed = {r.g: r for r in stats.signed_rank_tests(df, "g", "k", "x", p_values=True).filter("k = 'v'").collect()}
    plain = {r.g: r for r in stats.rank_sum_tests(df, "g", "k", "x", continuity=False).filter("k = 'v'").collect()}
    for g, own in by.items():
        r = ranks(np.concatenate([own, every]))[: len(own)]
        assert whole[g].w == pytest.approx(r.sum() - len(own) * (len(own) + 1) / 2)
        n1, n = len(own), len(every)
        assert dealt[g].z == pytest.approx((own.sum() - n1 * every.mean()) / math.sqrt(n1 * (n - n1) / (n * (n - 1)) * ((every - every.mean()) ** 2).sum()))
        d = own - np.median(every)
        d = d[d != 0]
        assert signed[g].v == pytest.approx(ranks(np.abs(d))[d > 0].sum()) and signed[g].n == len(d) and 0 < signed[g].p_value <= 1
        assert plain[g].w == pytest.approx(ranks(every)[np.concatenate([np.full(12, h == g) for h in "abc"])].sum() - n1 * (n1 + 1) / 2)


@pytest.mark.parametrize("method", ["bh", "by", "holm", "hochberg", "bonferroni"])
def test_one_family_is_adjusted_as_families_are(spark, method):
    """Two steps over ranges give what one task gives, with ties and nulls, and more rows than ranges."""
    from cytolake.functions.padjust import adjust

    rng = np.random.default_rng(1)
    rows = [(i, float(round(x, 3))) for i, x in enumerate(rng.uniform(0, 1, 900) ** 3)] + [(9000, None), (9001, None)]
    df = spark.createDataFrame(rows, "i long, p double")
    one = dict(adjust(df, "p", method).select("i", "p_adj").collect())
    many = dict(adjust(df.withColumn("f", F.lit(1)), "p", method, ["f"]).select("i", "p_adj").collect())
    assert one.keys() == many.keys() and all(one[i] == pytest.approx(many[i], abs=1e-12) if one[i] is not None else many[i] is None for i in one)


def test_products_over_many_blocks(spark):
    """Blocks smaller than the items, with missing values, against numpy."""
    from cytolake.functions.products import pair_sums

    rng = np.random.default_rng(2)
    x = rng.normal(size=(23, 40))
    x[rng.random(x.shape) < 0.3] = np.nan
    df = spark.createDataFrame([(f"i{a}", f"k{k}", float(x[a, k])) for a in range(23) for k in range(40) if not np.isnan(x[a, k])], "a string, k string, x double")
    got = {(r.a, r.b): r for r in pair_sums(df, "a", "k", "x", block=5, parts=3).collect()}
    names = sorted(f"i{a}" for a in range(23))
    assert set(got) == {(a, b) for i, a in enumerate(names) for b in names[i:]}
    for (a, b), r in got.items():
        u, v = x[int(a[1:])], x[int(b[1:])]
        both = ~np.isnan(u) & ~np.isnan(v)
        assert r.n == both.sum() and r.xy == pytest.approx((u * v)[both].sum()) and r.sx == pytest.approx(u[both].sum()) and r.yy == pytest.approx((v * v)[both].sum())


def test_fisher_with_large_margins(spark):
    """Counts in the hundred millions: a bounded sum, close to the normal tail; and tables far out."""
    n = 10**8
    cells = spark.createDataFrame([("m", n + 30000, n - 30000, n - 30000, n + 30000), ("far", 2 * n, 10, 10, 2 * n), ("small", 3, 1, 1, 3)], "x string, n11 long, n01 long, n10 long, n00 long")
    p = {r.x: r.p_value for r in stats.fisher_exact(cells).collect()}
    z = 30000 / math.sqrt(4 * n / 16)  # the margins are half of all
    assert p["m"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=2e-2) and p["far"] < 1e-100 and p["small"] == pytest.approx(34 / 70)


def test_tables_of_objects_and_sets(spark):
    from cytolake.operators import reshape

    wide = spark.createDataFrame([("a", 1, 2.5), ("b", None, 3.5)], "id string, x int, y double")
    assert sorted(map(tuple, reshape.melt(wide, ["id"], ["x", "y"]).collect()), key=str) == sorted([("a", "x", 1.0), ("a", "y", 2.5), ("b", "x", None), ("b", "y", 3.5)], key=str)
    assert [tuple(r) for r in reshape.transposed(wide, "id", "y").select("id", "x", "y").collect()] == [(2.5, 1, "a"), (3.5, None, "b")]
    rows = spark.createDataFrame([("a", 2), ("b", 0), ("c", None), ("d", -1)], "id string, n int")
    assert [tuple(r) for r in reshape.replicated(rows, "n").orderBy("copy").collect()] == [("a", 2, 1), ("a", 2, 2)]
    other = spark.createDataFrame([("b",), ("b",), (None,), ("e",)], "id string")
    names = lambda df: sorted(r[0] for r in df.collect())
    assert names(reshape.all_names((rows, "id"), (other, "id"))) == list("abcde")
    assert names(reshape.common_names((rows, "id"), (other, "id"))) == ["b"] and names(reshape.names_without((rows, "id"), (other, "id"))) == list("acd")
    ordered = reshape.ordered_by_cluster(spark.createDataFrame([("x", 2), ("y", 1), ("z", None), ("w", 2)], "item string, cluster int"))
    assert [(r.item, r.position) for r in ordered.orderBy("position").collect()] == [("z", 1), ("y", 2), ("w", 3), ("x", 4)]
    flags = reshape.flagged(rows, "id", ["a"]).select("id", "highly_variable").collect()
    assert {r.id for r in flags if r.highly_variable} == {"a"}
    assert tuple(reshape.totals(rows, F.length("id"), "id").first()) == (4, 4, 4)


def test_sample_pca(spark):
    from cytolake.operators.expression import sample_pca

    rng = np.random.default_rng(4)
    x = rng.gamma(2.0, 30.0, (40, 5)) * rng.gamma(2.0, 1.0, (40, 1))
    df = spark.createDataFrame([(f"g{i}", f"s{j}", float(x[i, j])) for i in range(40) for j in range(5)], "gene string, sample string, value double")
    z = np.log1p(x)
    z = (z - z.mean(axis=0)) / z.std(axis=0, ddof=1)
    values, axes = np.linalg.eigh(np.cov(z.T))
    for r in sample_pca(df, 2).collect():
        own = axes[:, -r.component] * np.sign(axes[np.abs(axes[:, -r.component]).argmax(), -r.component])
        assert r.loading == pytest.approx(own[int(r.sample[1:])], abs=1e-8) and r.proportion == pytest.approx(values[-r.component] / values.sum())


def test_urls_and_writes(spark, tmp_path):
    from cytolake.sources import archive

    row = spark.createDataFrame([("https://a.b/c/old.sra", "x y/é*~+")], "u string, n string").select(archive.moved_url(F.col("u"), "https://a.b/", "https://m/a/", F.col("n")).alias("u"), archive.quoted(F.col("n")).alias("q")).first()
    from urllib.parse import quote

    assert row.q == quote("x y/é*~+") and row.u == "https://m/a/c/" + quote("x y/é*~+")
    df = spark.range(3)
    assert archive.write_new(df, str(tmp_path / "t")) and not archive.write_new(df, str(tmp_path / "t"))
    df.limit(0).write.parquet(str(tmp_path / "empty"))
    with pytest.raises(ValueError, match="empty"):
        archive.write_new(df, str(tmp_path / "empty"))


def test_cell_values_are_painted(spark):
    from cytolake.operators.image import painted_values

    mask = spark.createDataFrame([("i", 0, c, c // 2) for c in range(8)], "image string, row int, col int, label int")
    cells = spark.createDataFrame([("i", 1, 5.0), ("i", 2, 1.0), ("i", 3, 100.0)], "image string, label int, v double")
    got = {r.col: (r.value, r.boundary) for r in painted_values(mask, cells, "v", 0.5).collect()}
    assert got[0] == (0.0, False) and got[2][0] == 5.0 and got[4][0] == 0.0 and got[6][0] == 5.0 and got[3][1] and not got[7][1]


def test_robustness_of_clusters(spark):
    """Clusters far apart come back whole under noise; one that is noise itself does not."""
    rng = np.random.default_rng(9)
    rows = [(i, c, float(x), float(y)) for i, (c, x, y) in enumerate([(c, *rng.normal((30 * c, 0), 1)) for c in (0, 1, 2) for _ in range(30)])]
    df = spark.createDataFrame(rows, "i long, cluster int, x double, y double")
    got = {r.share: r for r in cluster.robustness(df, "i", ["x", "y"], repeats=6).collect()}
    assert set(got) == {0.05, 0.1, 0.2} and got[0.05].lowest == got[0.1].median == 1.0 and got[0.2].lowest > 0.8
    mixed = df.withColumn("cluster", (F.col("i") % 3).cast("int"))
    assert cluster.robustness(mixed, "i", ["x", "y"], shares=(0.1,), repeats=4).first().median < 0.8


def plain_ward(d):
    """Ward's clustering one merge at a time: which leaves are merged, at which heights."""
    size, parts, d2 = {i: 1 for i in range(len(d))}, {i: (i,) for i in range(len(d))}, {(i, j): d[i][j] ** 2 for i in range(len(d)) for j in range(i)}
    out = []
    while len(parts) > 1:
        (i, j), h = min(d2.items(), key=lambda x: x[1])
        i, j = min(i, j), max(i, j)
        of = lambda a, b: d2.pop((max(a, b), min(a, b)))
        of(i, j)
        for k in [k for k in parts if k not in (i, j)]:
            new = ((size[i] + size[k]) * of(i, k) + (size[j] + size[k]) * of(j, k) - size[k] * h) / (size[i] + size[j] + size[k])
            d2[max(i, k), min(i, k)] = new
        parts[i] += parts.pop(j)
        size[i] += size.pop(j)
        out.append((tuple(sorted(parts[i])), math.sqrt(h)))
    return out


def test_ward_in_rounds_makes_the_tree(spark):
    rng = np.random.default_rng(7)
    for n in (1, 2, 9, 24):
        x = rng.normal(size=(n, 3))
        sim = spark.createDataFrame([(i, j, float(1 - np.linalg.norm(x[i] - x[j]))) for i in range(n) for j in range(n)], "a int, b int, sim double")
        want = plain_ward([[float(np.linalg.norm(u - v)) for v in x] for u in x])
        merges = cluster.ward_merges(sim).collect() if n > 1 else []
        parts, got = {i: (i,) for i in range(n)}, []
        for r in sorted(merges, key=lambda r: (r.step, r.a)):
            parts[r.a] += parts.pop(r.b)
            got.append((tuple(sorted(parts[r.a])), r.height))
        assert sorted(p for p, _ in got) == sorted(p for p, _ in want) and [h for _, h in sorted(got)] == pytest.approx([h for _, h in sorted(want)])
        k = min(n, 3)
        cut = cluster.hierarchical(sim, k).orderBy("position").collect()
        assert [r.position for r in cut] == list(range(1, n + 1)) and cut[0].item == 0
        groups = {}
        for r in cut:
            groups.setdefault(r.cluster, set()).add(r.item)
        left = [{i} for i in range(n)]
        for part, _ in want[: n - k]:
            left = [g for g in left if not g <= set(part)] + [set(part)]
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, left)) and sorted(groups) == list(range(1, k + 1))
        assert [r.cluster for r in cut] == sorted(r.cluster for r in cut)


def test_exact_rank_tests_against_all_deals():
    import itertools

    for n1, n2 in ((1, 1), (3, 4), (5, 2)):
        sums = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
        assert special.rank_sum_counts(n1, n2) == pytest.approx([sum(s <= w for s in sums) / len(sums) for w in range(n1 * n2 + 1)])
    sums = [sum(r * s for r, s in zip(range(1, 7), signs)) for signs in itertools.product((0, 1), repeat=6)]
    assert special.signed_rank_counts(6) == pytest.approx([sum(s <= v for s in sums) / len(sums) for v in range(22)])
    assert special.rank_sum_counts(49, 49)[-1] == pytest.approx(1.0) and special.rank_sum_counts(49, 49)[49 * 49 // 2] == pytest.approx(0.5, abs=0.01)


def test_exact_p_values_where_nothing_ties(spark):
    rows = [("a", 1.1), ("a", 2.2), ("a", 3.3), ("b", 4.4), ("b", 5.5), ("b", 6.6), ("b", 7.7)]
    df = spark.createDataFrame([("v", g, x) for g, x in rows] + [("t", g, float(round(x))) for g, x in rows] + [("t", "a", 2.0)], "variable string, grp string, x double")
    p = {(r.variable, r.grp): r for r in stats.rank_sum_tests(df, "grp", "variable", "x", p_values=True).collect()}
    assert p["v", "a"].w == 0 and p["v", "a"].p_value == pytest.approx(2 / 35) == p["v", "b"].p_value
    assert p["t", "a"].p_value == pytest.approx(math.erfc(abs(p["t", "a"].z) / math.sqrt(2)))  # ties: normal
    s = {(r.variable, r.grp): r for r in stats.signed_rank_tests(df.filter("variable = 'v' AND x <> 4.4").unionByName(df.filter("variable = 'v' AND x = 4.4").replace(4.4, 4.5)), "grp", "variable", "x", p_values=True).collect()}
    assert s["v", "a"].v == 0 and s["v", "a"].p_value == pytest.approx(2 / 8)  # -3.4, -2.3, -1.2
    assert s["v", "b"].p_value == pytest.approx(math.erfc(abs(s["v", "b"].z) / math.sqrt(2)))  # the median itself is a zero


def test_conditional_odds_ratio(spark):
    tables = [(3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 4, 9), (4, 0, 3, 5), (0, 0, 3, 4), (2_000_000, 1_500_000, 1_000_000, 3_000_000)]
    df = spark.createDataFrame(tables, "a long, b long, c long, d long").coalesce(1)
    got = [r[0] for r in df.select(special.conditional_odds_ratio(*[F.col(c) for c in "abcd"])).collect()]
    assert got[0] == pytest.approx(6.4083, abs=1e-4)  # the published tea-tasting example
    for (a, b, c, d), psi in zip(tables[:2], got):
        k = np.arange(max(0, a - d), min(a + b, a + c) + 1)
        w = np.array([math.comb(a + b, x) * math.comb(c + d, a + c - x) for x in k.tolist()]) * psi**k
        assert (w * k).sum() / w.sum() == pytest.approx(a, abs=1e-8)
    assert got[2] == 0 and got[3] == math.inf and got[4] is None and got[5] == pytest.approx(2e6 * 3e6 / 1.5e6 / 1e6, rel=1e-5)


def test_size_factors_whatever_the_order_of_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(1, 400, (40, 25))
    data = [(f"g{g}c{c}", f"s{s}", float(base[g, s])) for c in range(4) for g in range(40) for s in rng.permutation(25)]
    got = set()
    for turn in range(4):
        df = spark.createDataFrame([data[i] for i in rng.permutation(len(data))], "gene string, sample string, value double").repartition(3 + turn)
        got.add(tuple(sorted((r.sample, r.size_factor) for r in expression.size_factors(df).collect())))
    ratios = np.log(base) - np.log(base).mean(axis=1, keepdims=True)
    assert len(got) == 1  # bit by bit
    assert dict(got.pop()) == pytest.approx({f"s{s}": np.median(np.exp(np.repeat(ratios[:, s], 4))) for s in range(25)}, rel=1e-6)
