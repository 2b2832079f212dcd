import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import neighbours


def brute(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for i, v in ok:
        if i % 5 == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in ok if j != i and len(w) == len(v))[:k]
            out += [(i, r, j, d) for r, (d, j) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("n,block", [(300, 64), (12, 4096)])
def test_matches_brute_force(spark, monkeypatch, n, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(6) * 10.0 ** rng.integers(-2, 3)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(20)]  # ties
    rows += [(2000, None), (2005, []), (2010, [0.0] * 6), (2015, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2020, [float("nan")] * 6), (2025, [float("inf")] * 6), (None, [1.0] * 6), (2030, [1.0, 2.0]), (2031, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double").repartition(3)
    got = neighbours.nearest(df, F.col("vec_id") % 5 == 0, 10).collect()
    got, want = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got), brute(rows, 10)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], rel=1e-12)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(df, F.col("vec_id") % 5 == 0).count() == 0
