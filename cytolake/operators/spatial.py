"""Spatial statistics over cells (cell_id, sample, cluster, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import need, ratio


def nearest(cells: DataFrame, source: str, target: str, name: str = "distance", by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Distance from every source cell to the nearest target cell of its sample; null where it has none.

    Points fall into grid squares whose side holds a few targets each; a source looks at the 3 x 3 squares around it, and
    what it finds within one side is the nearest. Only sources left over meet all targets of their sample.
    """
    need(cells, "cell_id", "cluster", "x", "y", *by)
    if not by:
        return nearest(cells.withColumn("_whole", F.lit(0)), source, target, name, ("_whole",)).drop("_whole")
    a = cells.filter(F.col("cluster") == source).select("cell_id", *by, "x", "y")
    b = cells.filter(F.col("cluster") == target).select(*by, F.col("x").alias("_x"), F.col("y").alias("_y"))
    extent = b.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), (F.max("_x") - F.min("_x")).alias("_w"), (F.max("_y") - F.min("_y")).alias("_h"))
    side = F.greatest(F.sqrt(F.col("_w") * F.col("_h") * 4 / F.col("_n")), (F.col("_w") + F.col("_h")) * 4 / F.col("_n"), F.lit(1e-9))
    extent = extent.select(*by, side.alias("_side"))
    d = F.sqrt(F.pow(F.col("x") - F.col("_x"), F.lit(2.0)) + F.pow(F.col("y") - F.col("_y"), F.lit(2.0)))
    square = lambda c: F.floor(F.col(c) / F.col("_side"))
    sized = a.join(extent, list(by), "left")
    around = sized.withColumn("_i", F.explode(F.array(*[square("x") + k for k in (-1, 0, 1)]))).withColumn("_j", F.explode(F.array(*[square("y") + k for k in (-1, 0, 1)])))
    targets = b.join(extent, list(by)).select(*by, square("_x").alias("_i"), square("_y").alias("_j"), "_x", "_y")
    close = around.join(targets, [*by, "_i", "_j"]).groupBy("cell_id", *by).agg(F.min(d).alias("_d"), F.first("_side").alias("_s")).filter("_d <= _s")
    found = a.join(close.select("cell_id", *by, "_d"), ["cell_id", *by], "left")
    far = found.filter("_d IS NULL").drop("_d").join(b, list(by), "left").groupBy("cell_id", *by).agg(F.min(d).alias("_far"))
    return found.join(far, ["cell_id", *by], "left").select("cell_id", *by, F.coalesce("_d", "_far").alias(name))


def distance_ratios(cells: DataFrame, ct1: str, ct2: str, ct3: str) -> DataFrame:
    """d12, d13 and d12 / d13 of each CT1 cell, in samples that hold all three types; 0 / 0 is null, x / 0 infinite."""
    eligible = cells.filter(F.col("cluster").isin(ct1, ct2, ct3)).groupBy("sample").agg(F.countDistinct("cluster").alias("_k")).filter("_k = 3").select("sample")
    held = cells.join(eligible, "sample", "left_semi")
    both = nearest(held, ct1, ct2, "d12").join(nearest(held, ct1, ct3, "d13"), ["cell_id", "sample"])
    r = F.when(F.col("d13") == 0, F.when(F.col("d12") > 0, F.lit(float("inf")))).otherwise(F.try_divide("d12", "d13"))
    return both.withColumn("ratio", r)


def spatial_score(cells: DataFrame, ct1: str, ct2: str, ct3: str) -> DataFrame:
    """Per sample: mean ratio (relative distance), counts above and below 1, and (above + 1) / (below + 1) (relative number)."""
    above, below = F.count(F.when(F.col("ratio") > 1, 1)), F.count(F.when(F.col("ratio") < 1, 1))
    g = distance_ratios(cells, ct1, ct2, ct3).groupBy("sample").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("ratio").alias("relative_distance"), above.alias("n_above"), below.alias("n_below"))
    return g.withColumn("relative_number", (F.col("n_above") + 1) / (F.col("n_below") + 1))


def assign_subtype(cells: DataFrame, ct1: str, ct2: str, ct3: str) -> DataFrame:
    """CT1 cells become CT1_CT2 if CT2 is strictly nearer (over the whole table), else CT1_CT3; CT2 and CT3 keep their label, others get none."""
    near = nearest(cells, ct1, ct2, "d12", ()).join(nearest(cells, ct1, ct3, "d13", ()), "cell_id")
    own = near.select("cell_id", F.when(F.col("d12") < F.col("d13"), f"{ct1}_{ct2}").otherwise(f"{ct1}_{ct3}").alias("_s"))
    kept = F.when(F.col("cluster").isin(ct2, ct3), F.col("cluster"))
    return cells.join(own, "cell_id", "left").select("cell_id", "cluster", F.coalesce("_s", kept).alias("subtype"))


def permuted(cells: DataFrame, iterations: int, pool: list[str] | None, keep: str | None, seed: int = 0) -> DataFrame:
    """Iteration 0 is as observed; in the others the labels of the pool are dealt anew within each sample, by hash order.

    ``pool`` null: all labels; ``keep``: a label that stays in place though the rest is dealt.
    """
    turns = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(iterations))).alias("iter"))
    inside = F.lit(True) if pool is None else F.col("cluster").isin(*pool)
    if keep is not None:
        inside = inside & (F.col("cluster") != keep)
    # in hash order the first n1 places of a sample get its first label, the next n2 its second, and so on
    counts = cells.filter(inside).groupBy("sample", "cluster").agg(F.count(F.lit(1)).alias("_n"))
    ends = counts.withColumn("_end", F.sum("_n").over(W.partitionBy("sample").orderBy("cluster").rowsBetween(W.unboundedPreceding, 0)))  # a row per label
    ends = ends.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("_end", "cluster"))).alias("_ends"))
    moving = turns.filter(inside & (F.col("iter") > 0))
    placed = moving.withColumn("_p", F.row_number().over(W.partitionBy("sample", "iter").orderBy(F.xxhash64(F.lit(seed), "iter", "cell_id"), "cell_id")))
    dealt = placed.drop("cluster").join(ends, "sample").withColumn("cluster", F.element_at(F.filter("_ends", lambda e: e["_end"] >= F.col("_p")), 1)["cluster"])
    return turns.filter(~(inside & (F.col("iter") > 0))).unionByName(dealt.select(*turns.columns))


#: Kinds of shuffle: the pool of types whose labels are dealt, and the type that stays.
SHUFFLES = {"shuffle_23": lambda a, b, c: ([b, c], None), "shuffle_123": lambda a, b, c: ([a, b, c], None), "shuffle_except1": lambda a, b, c: (None, a), "shuffle_all": lambda a, b, c: (None, None)}


def ternary_test(cells: DataFrame, ct1: str, ct2: str, ct3: str, shuffle: str = "shuffle_except1", measure: str = "relative_distance", iterations: int = 100, seed: int = 0) -> DataFrame:
    """Per sample: cell counts, the observed measure, and its z against label shuffles."""
    if shuffle not in SHUFFLES:
        raise ValueError(f"shuffle {shuffle!r}; there are {', '.join(SHUFFLES)}")
    pool, keep = SHUFFLES[shuffle](ct1, ct2, ct3)
    sizes = cells.groupBy("sample").agg(F.count(F.lit(1)).alias("n_cells"), *[F.count(F.when(F.col("cluster") == c, 1)).alias(f"n_ct{k}") for k, c in enumerate((ct1, ct2, ct3), 1)])
    turns = permuted(cells, iterations, pool, keep, seed)
    keyed = turns.select("cell_id", F.concat_ws("|", "iter", "sample").alias("sample"), "cluster", "x", "y")
    s = spatial_score(keyed, ct1, ct2, ct3).select(F.substring_index("sample", "|", 1).cast("int").alias("iter"), F.expr("substring(sample, instr(sample, '|') + 1)").alias("sample"), F.col(measure).alias("_v"))
    g = s.groupBy("sample").agg(F.max(F.when(F.col("iter") == 0, F.col("_v"))).alias("observed"), F.avg(F.when(F.col("iter") > 0, F.col("_v"))).alias("_m"), F.stddev_pop(F.when(F.col("iter") > 0, F.col("_v"))).alias("_s"))
    return g.join(sizes, "sample").select("sample", "n_cells", "n_ct1", "n_ct2", "n_ct3", "observed", ratio(F.col("observed") - F.col("_m"), F.col("_s")).alias("zscore"))


def edges(neighbours: DataFrame) -> DataFrame:
    """Undirected edges (sample, point_1 < point_2) from neighbour lists whose first element is the point; -1 pads."""
    need(neighbours, "sample", "neigh")
    flat = neighbours.select("sample", F.get("neigh", F.lit(0)).alias("_p"), F.explode("neigh").alias("_q")).filter("_p <> _q AND _q <> -1 AND _p <> -1")
    return flat.select("sample", F.least("_p", "_q").alias("point_1"), F.greatest("_p", "_q").alias("point_2")).distinct()


def edge_counts(edge: DataFrame, cells: DataFrame, point: str = "point") -> DataFrame:
    """Symmetric counts of edges between types of each sample; an edge within a type adds 2; empty pairs are 0."""
    label = cells.select("sample", F.col(point).alias("_p"), "cluster")
    rest = [c for c in edge.columns if c not in ("sample", "point_1", "point_2")]
    e = edge.join(label.select("sample", F.col("_p").alias("point_1"), F.col("cluster").alias("c1")), ["sample", "point_1"])
    e = e.join(label.select("sample", F.col("_p").alias("point_2"), F.col("cluster").alias("c2")), ["sample", "point_2"])
    both = e.select("sample", *rest, "c1", "c2").unionByName(e.select("sample", *rest, F.col("c2").alias("c1"), F.col("c1").alias("c2")))
    counted = both.groupBy("sample", *rest, "c1", "c2").agg(F.count(F.lit(1)).alias("n"))
    types = cells.select("sample", "cluster").distinct()
    grid = types.withColumnRenamed("cluster", "c1").join(types.withColumnRenamed("cluster", "c2"), "sample")
    if rest:
        grid = grid.join(both.select("sample", *rest).distinct(), "sample")
    return grid.join(counted, ["sample", *rest, "c1", "c2"], "left").select("sample", *rest, "c1", "c2", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def excluded_score(counts: DataFrame) -> DataFrame:
    """n_ij / (d_i + d_j + 1) with d the edges of a type to others; 0 on the diagonal."""
    d = counts.groupBy("sample", "c1").agg((F.sum("n") - F.sum(F.when(F.col("c1") == F.col("c2"), F.col("n")).otherwise(0))).alias("_d"))
    rows = counts.join(d, ["sample", "c1"]).join(d.select("sample", F.col("c1").alias("c2"), F.col("_d").alias("_e")), ["sample", "c2"])
    return rows.select("sample", "c1", "c2", F.when(F.col("c1") == F.col("c2"), 0.0).otherwise(F.col("n") / (F.col("_d") + F.col("_e") + 1)).alias("score"))


def neighbourhood_test(edge: DataFrame, cells: DataFrame, iterations: int = 1000, method: str = "include", seed: int = 0, point: str = "point") -> DataFrame:
    """Signed permutation score of each pair of types: 1 - q for attraction, -(1 - p) for avoidance."""
    turns = permuted(cells.select(F.col(point).alias("cell_id"), "sample", "cluster"), iterations, None, None, seed)
    types = cells.agg(F.array_sort(F.collect_set("cluster")).alias("_types"))  # one row, of the types there are
    coded = turns.crossJoin(F.broadcast(types)).select("sample", F.col("cell_id").alias("_p"), "iter", F.array_position("_types", F.col("cluster")).cast("int").alias("_c"))
    # each point carries its labels of all shuffles, so edges are joined once, not once a shuffle
    labels = coded.groupBy("sample", "_p").agg(F.transform(F.array_sort(F.collect_list(F.struct("iter", "_c"))), lambda x: x["_c"]).alias("_l"))
    side = lambda k: labels.select("sample", F.col("_p").alias(f"point_{k}"), F.col("_l").alias(f"_l{k}"))
    met = edge.select("sample", "point_1", "point_2").join(side(1), ["sample", "point_1"]).join(side(2), ["sample", "point_2"])
    pairs = met.select("sample", F.posexplode(F.zip_with("_l1", "_l2", lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))).alias("iter", "_e"))
    half = pairs.groupBy("sample", "iter", "_e.a", "_e.b").agg(F.count(F.lit(1)).alias("n"))
    # an edge counts for both orders of its types, so one within a type adds 2
    both = half.select("sample", "iter", F.col("a").alias("_1"), F.col("b").alias("_2"), F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n")).alias("n"))
    both = both.unionByName(half.filter("a <> b").select("sample", "iter", F.col("b").alias("_1"), F.col("a").alias("_2"), "n"))
    if method == "excluded":
        d = both.groupBy("sample", "iter", "_1").agg(F.sum(F.when(F.col("_1") == F.col("_2"), 0).otherwise(F.col("n"))).alias("_d"))
        both = both.join(d, ["sample", "iter", "_1"]).join(d.select("sample", "iter", F.col("_1").alias("_2"), F.col("_d").alias("_e")), ["sample", "iter", "_2"])
        both = both.withColumn("n", F.when(F.col("_1") == F.col("_2"), 0.0).otherwise(F.col("n") / (F.col("_d") + F.col("_e") + 1)))
    name = lambda k: F.element_at("_types", F.col(k))
    found = both.crossJoin(F.broadcast(types)).select("sample", "iter", name("_1").alias("c1"), name("_2").alias("c2"), F.col("n").alias("score"))
    seen = edge_counts(edge, cells, point).join(edge.select("sample").distinct(), "sample", "left_semi")
    seen = (excluded_score(seen) if method == "excluded" else seen.withColumnRenamed("n", "score")).withColumnRenamed("score", "observed")
    # a pair without an edge in a shuffle has score 0, which no observed score is below
    above = found.filter("iter > 0").join(seen, ["sample", "c1", "c2"]).filter("score > observed").groupBy("sample", "c1", "c2").agg((F.count(F.lit(1)) / iterations).alias("p"))
    p = seen.join(above, ["sample", "c1", "c2"], "left").withColumn("p", F.coalesce("p", F.lit(0.0))).withColumn("q", 1 - F.col("p"))
    return p.select("sample", "c1", "c2", "observed", F.when(F.col("q") >= F.col("p"), F.col("p")).otherwise(-F.col("q")).alias("score"))
