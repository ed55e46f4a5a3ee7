"""Nearest neighbours and point indices against brute force."""

import math

import numpy as np
import pytest

from cytolake.operators import expression, neighbours


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i if ids is None else ids[i]), [float(v) for v in row]) for i, row in enumerate(x)], "item long, v array<double>")


@pytest.mark.parametrize("kind", ["noise", "clusters", "copies", "line"])
def test_nearest_neighbours(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    seen = []
    monkeypatch.setattr(neighbours, "_blocks", lambda *a, of=neighbours._blocks: seen.append(of(*a)) or seen[-1])
    rng = np.random.default_rng(1)
    x = {
        "noise": rng.normal(size=(160, 6)), "clusters": rng.normal(size=(200, 3)) * 0.1 + rng.integers(0, 5, (200, 1)) * 10, "line": np.arange(90.0)[:, None] * [[1.0]],
        "copies": np.concatenate([np.zeros((60, 2)), np.ones((5, 2)), rng.integers(-3, 4, (30, 2)).astype(float)])  # ties go by item,
    }[kind]
    k = 4
    got: dict = {}
    for r in neighbours.nearest_neighbours(frame(spark, x), "item", "v", k).collect():
        got.setdefault(r["item"], []).append((r["rank"], round(r["distance"], 9), r["neighbour"]))
    for i, row in enumerate(x):
        want = sorted((round(float(math.dist(row, other)), 9), j) for j, other in enumerate(x) if j != i)[:k]
        assert sorted(got[i]) == [(n, d, j) for n, (d, j) in enumerate(want, 1)]
    assert len(set(seen[0])) > 1 or kind == "copies"  # blocks met each other; copies are few points


def test_few_points_and_names(spark):
    few = spark.createDataFrame([("a", [0.0]), ("b", [1.0]), ("c", [5.0]), (None, [2.0]), ("d", None)], "item string, v array<double>")
    got = sorted((r["item"], r["rank"], r["neighbour"], r["distance"]) for r in neighbours.nearest_neighbours(few, "item", "v", 9).collect())
    assert got == [("a", 1, "b", 1.0), ("a", 2, "c", 5.0), ("b", 1, "a", 1.0), ("b", 2, "c", 4.0), ("c", 1, "b", 4.0), ("c", 2, "a", 5.0)]
    assert neighbours.nearest_neighbours(few.limit(0), "item", "v").count() == 0


@pytest.mark.parametrize("width", [2, 7])
def test_point_indices(spark, monkeypatch, width):
    monkeypatch.setattr(neighbours, "BLOCK", 30)
    rng = np.random.default_rng(2)
    label = rng.integers(0, 3, 80)
    label[0] = 9  # alone
    x = rng.normal(size=(80, width)) + label[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, label))], "item long, v array<double>, cluster int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {}
    for i in range(80):
        mean = {c: d[i, label == c].sum() / max(1, (label == c).sum() - (c == label[i])) for c in set(label)}
        b, c = min((m, c) for c, m in mean.items() if c != label[i])
        a = mean[label[i]]
        want[i] = (label[i], c, 0.0 if (label == label[i]).sum() == 1 else (b - a) / max(a, b))
    got = {r["item"]: (r.cluster, r.neighbour, r.width) for r in neighbours.silhouettes(df, "item", "v").collect()}
    assert set(got) == set(want)
    for i in want:
        assert got[i][:2] == want[i][:2] and got[i][2] == pytest.approx(want[i][2], abs=1e-6)
    same = label[:, None] == label
    one = neighbours.point_indices(df, "item", "v").first()
    assert one.silhouette == pytest.approx(np.mean([w for _, _, w in want.values()]), abs=1e-6) and one.dunn == pytest.approx(d[~same].min() / d[same].max(), abs=1e-6)


def test_sample_pca(spark):
    rng = np.random.default_rng(3)
    k = rng.poisson(30, (40, 6)) * np.outer(rng.uniform(0.5, 2, 40), np.ones(6)) + np.outer(rng.uniform(0, 30, 40), [1, 1, 1, 0, 0, 0])
    counts = spark.createDataFrame([(f"g{i}", f"s{j}", float(v)) for (i, j), v in np.ndenumerate(k)], "gene string, sample string, value double")
    z = np.log1p(k)
    z = (z - z.mean(axis=0)) / z.std(axis=0, ddof=1)
    values, axes = np.linalg.eigh(np.cov(z.T))
    got = {(r["sample"], r.component): (r.loading, r.proportion) for r in expression.sample_pca(counts, 2).collect()}
    for c in (1, 2):
        axis = axes[:, -c] * np.sign(axes[np.abs(axes[:, -c]).argmax(), -c])
        assert [got[f"s{j}", c][0] for j in range(6)] == pytest.approx(axis, abs=1e-8) and got["s0", c][1] == pytest.approx(values[-c] / values.sum())
