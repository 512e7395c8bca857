import numpy as np
import pytest

from labelq.operators.plane import nearest_in_plane


@pytest.mark.parametrize("kind", ["even", "clustered", "line", "ties"])
def test_tiles_lose_no_neighbour(spark, kind):
    g = np.random.default_rng(3)
    n = 240
    xy = {"even": g.uniform(0, 10, (n, 2)), "clustered": np.concatenate([g.normal(0, 0.01, (n // 2, 2)), g.normal(9, 3, (n // 2, 2))]),
          "line": np.stack([np.arange(n) * 0.5, np.zeros(n)], 1), "ties": g.integers(0, 6, (n, 2)).astype(float)}[kind]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")
    d = np.round(np.linalg.norm(xy[:, None] - xy[None], axis=2), 12)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), r + 1) for i in range(n) for r, j in enumerate(np.lexsort((np.arange(n), d[i]))[:5])}
    assert {(r.id, r.nbr, r["rank"]) for r in nearest_in_plane(df, 5, tile=15).collect()} == want


def test_fewer_points_than_neighbours(spark):
    df = spark.createDataFrame([(i, float(i), 0.0) for i in range(4)], "id long, x double, y double")
    assert nearest_in_plane(df, 9, tile=1).count() == 12
    assert nearest_in_plane(df.limit(0), 3).count() == 0
