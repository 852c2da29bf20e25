import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import exact_topk


def brute(rows, k=10, every=100):
    ok = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % every == 0:
            found = sorted((-int(q @ v), j) for b, (j, v) in enumerate(ok) if a != b and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("block", F.lit(2))


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_topk(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)]) for i in range(350)]
    rows += [(i, rows[5][1]) for i in range(1000, 1060)]  # ties
    rows += [(2000, None), (2001, []), (2100, [1.0, float("nan")]), (2002, [float("inf")] * 8), (2003, [None] + [0.5] * 7), (2200, [1.0, 2.0]), (2201, [-3.0, 2.0]), (None, [1.0] * 8), (2300, [0.0] * 8)]
    rows += [(300, rows[300][1]), (300, [0.25] * 8), (301, rows[301][1]), (2400, []), (2400, [])]  # repeated ids, empty vectors
    got = sorted(map(tuple, exact_topk.search(table(spark, rows).repartition(5), F.col("vec_id") % 100 == 0).collect()))
    assert got == brute(rows)


def wide(spark, rows, k=2):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(map(tuple, exact_topk.search(docs, F.col("vec_id") % 100 == 0, k=k).collect()))


def test_scores_are_exact_or_an_error(spark):
    # sums beyond 64 bits on the way, but not in what is returned
    rows = [(0, [3e6, 3e6]), (1, [3e6, -3e6]), (2, [2.9e6, -2.9e6]), (3, [-3e6, -3e6]), (4, [-3e6, 1.0])]
    exact = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    score = lambda i: sum(a * b for a, b in zip(exact[0], exact[i], strict=True))
    assert wide(spark, rows) == [(0, 1, 1, score(1)), (0, 2, 2, score(2))]
    # the best one is beyond 64 bits, and so is one of a few
    with pytest.raises(Exception, match="beyond 64 bits"):
        wide(spark, [*rows, (5, [3e6, 3e6])])
    with pytest.raises(Exception, match="beyond 64 bits"):
        wide(spark, rows, k=5)
    with pytest.raises(Exception, match="beyond 64 bits"):
        wide(spark, [(0, [1.0]), (1, [1e300])])
    # components that are further apart than 64 signed bits tell
    assert wide(spark, [(0, [1 / 1024]), (1, [8e15]), (2, [-8e15])]) == [(0, 1, 1, 1024 * 8 * 10**15), (0, 2, 2, -1024 * 8 * 10**15)]


def test_query_blocks_and_empty(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-1.0, 0.0, 0.5, 2.5)) for _ in range(5)]) for i in range(40)]
    small = exact_topk.search(table(spark, rows), F.col("vec_id") % 4 == 0, k=3, block_rows=7, query_rows=3)
    assert sorted(map(tuple, small.collect())) == brute(rows, 3, 4)
    assert exact_topk.search(table(spark, rows).limit(0), F.col("vec_id") % 4 == 0).count() == 0


def test_parts_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "PARTS", 2)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 4)]) for i in range(300)]
    found = exact_topk.search(table(spark, rows), F.col("vec_id") % 20 == 0, k=4, block_rows=16, query_rows=5)
    assert sorted(map(tuple, found.collect())) == brute(rows, 4, 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_index_blocks(spark):
    rng = np.random.default_rng(7)
    u = rng.integers(0, 1000, (130, 3))
    q = np.array([3, -5, 0])
    slices = exact_topk.score_slices(q, exact_topk._slices(u))
    full = (1 << exact_topk._slices(u).shape[0]) - 1
    want = u[:, 0] * 3 + (full - u[:, 1]) * 5
    assert (exact_topk._values(slices, np.arange(130)) == want).all()
