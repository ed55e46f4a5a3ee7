"""Exact nearest neighbours in any dimension, and indices of a clustering that compare points."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import need, ratio
from ..session import spent, written

#: Cells are as many as the root of the points, within these; points and queries of a task, and queries of it at once.
CELLS, BLOCK, SLICE = 2048, 8192, 512


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy().astype(float).reshape(n, -1) if n else np.zeros((0, 1))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows, through products."""
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T))


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for b in batches:
            d = _apart(_matrix(b.column("v")), pivots)
            cell = d.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[*b.schema.names, "cell", "d"])

    return run


def _nearest(k: int):
    """Of a cell's points (left) and the queries that visit it (right): each query's ``k`` nearest ids, by distance, then id."""

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        key_type = points.schema.field("ids").type.value_type if points.num_rows else pa.int64()
        key, names, distance = [], [], []
        if points.num_rows and queries.num_rows:
            p, asked = _matrix(points.column("v")), _matrix(queries.column("w"))
            ids = points.column("ids").combine_chunks()
            first, size = ids.offsets.to_numpy()[:-1], np.diff(ids.offsets.to_numpy())
            bound, keys = queries.column("bound").to_numpy(), queries.column("key").combine_chunks()
            for x in range(0, len(asked), SLICE):
                q = asked[x : x + SLICE]
                d = _apart(q, p)
                slack = 1e-6 * (1 + np.abs(d).max(initial=0))  # products lose digits: near misses are measured anew
                reach = np.minimum(np.partition(d, k - 1, axis=1)[:, k - 1] if len(p) >= k else np.inf, bound[x : x + SLICE]) + slack
                row, at = np.nonzero(d <= np.broadcast_to(reach, (len(q),))[:, None])
                exact, often = np.sqrt(((q[row] - p[at]) ** 2).sum(axis=1)), size[at]
                pick = np.repeat(first[at] - np.cumsum(often) + often, often) + np.arange(often.sum())
                row, exact, own = np.repeat(row, often), np.repeat(exact, often), ids.values.take(pa.array(pick))
                text = pa.types.is_string(key_type)
                order = np.lexsort((np.unique(np.array(own.to_pylist(), dtype=object), return_inverse=True)[1] if text else own.to_numpy(), exact, row))
                ranked = row[order]
                kept = order[np.arange(len(ranked)) - np.searchsorted(ranked, ranked) < k]
                key.append(keys.take(pa.array(row[kept] + x)))
                names.append(own.take(pa.array(kept)))
                distance.append(exact[kept])
        return pa.table({"key": pa.chunked_array(key, pa.int64()), "id": pa.chunked_array(names, key_type), "distance": np.concatenate([np.zeros(0), *distance])})

    return run


def _visits(shared):
    """The blocks other than its own that a query must visit: those with a cell that pivots, radii and bisectors leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, inner, outer, between, block = shared.value
        member = np.zeros((len(block), block.max() + 1), np.float32)
        member[np.arange(len(block)), block] = 1
        for b in batches:
            for x in range(0, b.num_rows, SLICE):
                part = b.slice(x, SLICE)
                d, own, bound = _apart(_matrix(part.column("v")), pivots), part.column("cell").to_numpy(), part.column("bound").to_numpy()
                mine = d[np.arange(len(d)), own]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d * d - (mine * mine)[:, None]) / (2 * between[own])
                low = np.maximum(np.maximum(d - outer, inner - d), np.where(np.isfinite(plane), plane, 0.0))
                open_ = (low <= bound[:, None] + 1e-6 * (1 + np.abs(d).max(initial=0))) & (outer >= 0)
                visited = open_.astype(np.float32) @ member > 0
                visited[np.arange(len(d)), block[own]] = False
                row, at = np.nonzero(visited)
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row)), part.column("v").take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(bound[row])], names=["key", "v", "block", "bound"])

    return run


def _blocks(pivots: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """A block for each cell, ``most`` points at most unless one cell has more: halves by points along the widest dimension."""
    out, todo, n = np.zeros(len(pivots), np.int64), [np.arange(len(pivots))], 0
    while todo:
        own = todo.pop()
        if len(own) == 1 or sizes[own].sum() <= most:
            out[own], n = n, n + 1
            continue
        wide = np.ptp(pivots[own], axis=0).argmax()
        own = own[np.argsort(pivots[own, wide], kind="stable")]
        at = int(np.clip(np.searchsorted(np.cumsum(sizes[own]), sizes[own].sum() / 2) + 1, 1, len(own) - 1))
        todo += [own[:at], own[at:]]
    return out


def _met(points: DataFrame, queries: DataFrame, k: int, kind: str) -> DataFrame:
    """Queries meet the points of their blocks in tasks of about ``BLOCK`` points and ``BLOCK`` queries."""
    parts = lambda df, key: df.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(key))
    sizes = written(parts(points, "_np").join(parts(queries, "_nq"), "block"), "blocks")  # a row for each block
    own = points.join(F.broadcast(sizes), "block").withColumn("_p", F.pmod(F.xxhash64("key"), F.col("_np")).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
    asked = queries.join(F.broadcast(sizes), "block").withColumn("_q", F.pmod(F.xxhash64("key", F.lit(1)), F.col("_nq")).cast("int")).withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_np") - 1)))
    left, right = own.select("block", "_p", "_q", "v", "ids"), asked.select("block", "_p", "_q", "key", "v", "bound")
    right = right.toDF("_block", "_p2", "_q2", "key", "w", "bound")  # points may be asking themselves
    return left.groupBy("block", "_p", "_q").cogroup(right.groupBy("_block", "_p2", "_q2")).applyInArrow(_nearest(k), f"key long, id {kind}, distance double")


def nearest_neighbours(points: DataFrame, item: str, vector: str, k: int = 10) -> DataFrame:
    """(item, rank, neighbour, distance): the ``k`` nearest other items of every item, by Euclidean distance, then by item.

    Exact. A hashed sample of points, the root of their number and ``CELLS`` at most, are pivots; every point goes to its
    nearest pivot's cell, and neighbouring cells make up blocks of ``BLOCK`` points. Queries first meet their own block,
    which bounds how far their neighbours are, then the blocks of cells that the triangle inequality leaves open: by the
    cell's inner and outer radius, and by the bisector between the two pivots. Equal vectors are one point, with its first
    ``k`` + 1 items, so copies never meet each other. How many cells are left open depends on the data: where distances
    hardly differ, as in noise of many dimensions, it is most, and the work grows with the square of the points.
    """
    need(points, item, vector)
    spark = points.sparkSession
    kind, number = dict(points.dtypes)[item], dict(points.dtypes)[vector]
    number = number if number in ("array<float>", "array<double>") else "array<double>"
    rows = points.select(F.col(item).alias("_id"), F.col(vector).cast(number).alias("v")).dropna(subset=["_id", "v"])
    keyed = written(rows.withColumn("key", F.xxhash64("v")), "points")
    # the k + 1 smallest items of each vector: within tasks first, however often it stands
    first = keyed.groupBy("key", "v").agg(F.min("_id").alias("_min"), F.count(F.lit(1)).alias("_n"))
    lone = first.filter("_n = 1").select("key", "v", F.array("_min").alias("ids"))
    many = keyed.join(first.filter("_n > 1").select("key", "v"), ["key", "v"], "left_semi")
    salted = many.groupBy("key", "v", F.pmod(F.xxhash64("_id"), F.lit(256)).alias("_salt")).agg(F.slice(F.sort_array(F.collect_set("_id")), 1, k + 1).alias("_ids"))
    few = salted.groupBy("key", "v").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("_ids")))), 1, k + 1).alias("ids"))  # 256 x (k + 1)
    distinct = written(lone.unionByName(few), "vectors")
    n = distinct.count()
    pivots = [r["v"] for r in distinct.orderBy(F.xxhash64("key", F.lit(7)), "key").limit(min(CELLS, max(1, math.isqrt(n)))).select("v").collect()]  # CELLS at most
    if not pivots:
        return points.select(F.col(item), F.lit(1).alias("rank"), F.col(item).alias("neighbour"), F.lit(0.0).alias("distance")).filter(F.lit(False))
    centres = np.array(pivots, float)
    celled = written(distinct.mapInArrow(_placed(spark.sparkContext.broadcast(centres)), f"key long, v {number}, ids array<{kind}>, cell int, d double"), "celled")
    cells = {r["cell"]: r for r in celled.groupBy("cell").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("n")).collect()}  # a row for each pivot
    of = lambda c, name, none: cells[c][name] if c in cells else none
    inner, outer, size = (np.array([of(c, name, none) for c in range(len(centres))]) for name, none in (("lo", 0.0), ("hi", -1.0), ("n", 0)))
    block = _blocks(centres, size, BLOCK)
    places = F.array(*[F.lit(int(x)) for x in block])  # CELLS at most
    placed = written(celled.withColumn("block", F.get(places, F.col("cell"))), "placed")
    home = placed.select("key", "v", "block", F.lit(math.inf).alias("bound"))
    near = written(_met(placed, home, k + 1, kind), "near")
    bound = near.groupBy("key").agg(F.count(F.lit(1)).alias("_c"), F.sort_array(F.collect_list("distance")).alias("_d"))  # k + 1 for each part that its block has
    bound = bound.select("key", F.when(F.col("_c") > k, F.get("_d", F.lit(k))).otherwise(math.inf).alias("bound"))
    asking = placed.select("key", "v", "cell").join(bound, "key")
    shared = spark.sparkContext.broadcast((centres, inner, outer, _apart(centres, centres), block))  # CELLS squared numbers
    far = _met(placed, written(asking.select("key", "v", "cell", "bound").mapInArrow(_visits(shared), f"key long, v {number}, block int, bound double"), "visits"), k + 1, kind)
    both = near.unionByName(far).groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, k + 1).alias("_all"))  # k + 1 for each block met
    own = keyed.select("key", "_id").join(both, "key")
    others = F.slice(F.filter("_all", lambda x: x["id"] != F.col("_id")), 1, k)
    out = own.select(F.col("_id").alias(item), F.posexplode(others).alias("_r", "_x"))
    out = written(out.select(item, (F.col("_r") + 1).cast("int").alias("rank"), F.col("_x.id").alias("neighbour"), F.col("_x.distance").alias("distance")), "neighbours")
    spent(keyed, distinct, celled, placed, near)
    return out


def _compared(n_clusters: int):
    """Two blocks' points: each one's sum of distances to every cluster, and the least and the largest."""

    def run(table: pa.Table) -> pa.Table:
        block, code = table.column("_b").to_numpy(), table.column("code").to_numpy()
        i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
        x = _matrix(table.column("v"))
        total, low, high = np.zeros((len(x), n_clusters)), np.full((len(x), n_clusters), np.inf), np.full((len(x), n_clusters), -np.inf)
        sides = [(i, j)] if i == j else [(i, j), (j, i)]
        for p, q in sides:
            mine, other = np.flatnonzero(block == p), np.flatnonzero(block == q)
            other = other[np.argsort(code[other], kind="stable")]
            there, starts = np.unique(code[other], return_index=True)
            for a in range(0, len(mine), SLICE):
                own = mine[a : a + SLICE]
                d = _apart(x[own], x[other])
                if p == q:
                    d[own[:, None] == other] = 0.0
                if len(other):
                    total[own[:, None], there] = np.add.reduceat(d, starts, axis=1)
                    low[own[:, None], there] = np.minimum.reduceat(d, starts, axis=1)
                    high[own[:, None], there] = np.maximum.reduceat(d, starts, axis=1)
        lists = lambda v: pa.array(list(v), pa.list_(pa.float64()))
        return pa.table({"item": table.column("item"), "code": table.column("code"), "part": table.column("_part"), "total": lists(total), "low": lists(low), "high": lists(high)})

    return run


def _joined(table: pa.Table) -> pa.Table:
    """A part's items, each from all blocks that it met."""
    item, code = table.column("item").combine_chunks().dictionary_encode(), table.column("code").to_numpy()
    at, n = item.indices.to_numpy(), len(item.dictionary)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(n))
    lists = lambda c, f: pa.array(list(f.reduceat(_matrix(table.column(c))[order], starts, axis=0)), pa.list_(pa.float64()))
    return pa.table({"item": item.dictionary, "code": pa.array(code[order][starts]), "total": lists("total", np.add), "low": lists("low", np.minimum), "high": lists("high", np.maximum)})


def _distances(points: DataFrame, item: str, vector: str, label: str) -> tuple[DataFrame, list, list[int]]:
    """(item, code, total, low, high): each point's sums and extremes of distances to the clusters; and these, with their sizes.

    Blocks of points meet in tasks of their own; a row for each cluster reaches the driver.
    """
    need(points, item, vector, label)
    rows = points.select(F.col(item).alias("item"), F.col(label).alias("cluster"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")).dropna()
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy("cluster").collect()
    names, many = [r["cluster"] for r in sizes], [r["n"] for r in sizes]
    n_blocks = max(1, math.ceil(sum(many) / BLOCK))
    code = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("cluster")) - 1 if names else F.lit(0)
    own = rows.select("item", code.cast("int").alias("code"), "v", F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int").alias("_b"), F.pmod(F.xxhash64("item", F.lit(1)), F.lit(n_blocks * n_blocks)).cast("int").alias("_part"))
    met = F.transform(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda o: F.struct(F.least(o, F.col("_b")).alias("_i"), F.greatest(o, F.col("_b")).alias("_j")))
    dealt = own.withColumn("_m", F.explode(met)).select("_m._i", "_m._j", "_b", "_part", "item", "code", "v")
    kind, lists = dict(rows.dtypes)["item"], "total array<double>, low array<double>, high array<double>"
    parts = dealt.groupBy("_i", "_j").applyInArrow(_compared(len(names)), f"item {kind}, code int, part int, {lists}")
    return parts.groupBy("part").applyInArrow(_joined, f"item {kind}, code int, {lists}"), names, many


def _widths(known: tuple[DataFrame, list, list[int]], item: str) -> DataFrame:
    d, names, many = known
    if len(names) < 2:
        return d.select(F.col("item").alias(item), F.lit(None).alias("cluster"), F.lit(None).alias("neighbour"), F.lit(0.0).alias("width")).filter(F.lit(False))
    sizes, labels = F.array(*[F.lit(n).cast("double") for n in many]), F.array(*[F.lit(x) for x in names])
    own = F.col("code")
    means = F.transform("total", lambda t, c: F.struct((t / F.get(sizes, c)).alias("b"), c.alias("c")))
    rows = d.select("item", "code", ratio(F.get("total", own), F.get(sizes, own) - 1).alias("_a"), F.array_min(F.filter(means, lambda x: x["c"] != own)).alias("_o"))
    width = F.when(F.get(sizes, own) == 1, 0.0).otherwise(F.coalesce(ratio(F.col("_o.b") - F.col("_a"), F.greatest("_o.b", "_a")), F.lit(0.0)))
    return rows.select(F.col("item").alias(item), F.get(labels, own).alias("cluster"), F.get(labels, F.col("_o.c")).alias("neighbour"), width.alias("width"))


def silhouettes(points: DataFrame, item: str, vector: str, label: str = "cluster") -> DataFrame:
    """(item, cluster, neighbour, width): (b - a) / max(a, b), from the mean distance a to the own cluster's others and b to the nearest other cluster.

    Alone in its cluster a point has width 0; with one cluster there is no row. All pairs of points are compared, by blocks.
    """
    return _widths(_distances(points, item, vector, label), item)


def point_indices(points: DataFrame, item: str, vector: str, label: str = "cluster") -> DataFrame:
    """One row: the mean silhouette width, and Dunn's index, the least distance between clusters over the largest within one."""
    d, names, many = _distances(points, item, vector, label)
    known = written(d, "distances")
    s = _widths((known, names, many), item).agg(F.avg("width").alias("silhouette"))
    apart = F.array_min(F.filter("low", lambda x, c: (c != F.col("code")) & (x < math.inf)))
    ends = known.agg(F.min(apart).alias("_low"), F.max(F.get("high", F.col("code"))).alias("_high"))
    return s.crossJoin(ends).select("silhouette", ratio(F.col("_low"), F.col("_high")).alias("dunn"))  # one row each
