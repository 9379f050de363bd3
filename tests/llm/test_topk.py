import math

import numpy as np
from pyspark.sql import functions as F

from recollect.llm import queries, topk


MOST = (1 << 63) - 1


def brute(rows, k=10):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 100 == 0:
            s = sorted(((-max(-MOST, min(MOST, sum(x * y for x, y in zip(a, b)))), i) for i, b in ok if i != q and len(b) == len(a)))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(s, 1)]
    return out


def test_oracle(spark, sf, oracle):
    got = sorted(tuple(r) for r in queries.op3_exact_topk(spark, sf).collect())
    want = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in oracle(queries.oracle_sql()["op3_exact_topk"]))
    assert got == want


def test_ties_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-2, 3, 6)]) for i in range(1500)]  # many equal scores
    rows += [(2000, None), (2100, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2200, [float("nan")] * 6), (2300, [float("inf")] + [0.0] * 5), (2400, [1.0, 2.0]), (2401, [0.5, 0.5]), (None, [1.0] * 6), (2500, []), (2600, [1e30, 1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 100 == 0).collect())
    want = sorted(brute([(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None) for i, v in rows]))
    assert got == want and any(abs(r[3]) > 1 << 53 for r in got)


def test_scores_beyond_53_bits(spark):
    rows = [(100, [2.0**31, 2.0**31]), (1, [2.0**31, 2.0**30]), (2, [2.0**31, 2.0**30 - 1]), (3, [1.0, 0.0]), (4, [-(2.0**31), -(2.0**30)]), (5, [2.0**31, 2.0**31 - 1]), (200, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 100 == 0, scale=1.0).collect())
    exact = lambda q, v: sum(int(a) * int(b) for a, b in zip(q, v))
    want = []
    for q, a in rows:
        if q % 100 == 0:
            best = sorted((-min(exact(a, v), (1 << 63) - 1), i) for i, v in rows if i != q)
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best[:10], 1)]
    assert got == sorted(want) and (100, 2, 1, 6917529027641081856) in got


def test_few_rows(spark):
    df = spark.createDataFrame([(100, [1.0]), (1, [2.0]), (2, [3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()] == [(100, 1, 2, 1024 * 3072), (100, 2, 1, 1024 * 2048)]
    assert topk.exact_topk(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_near_copies_below_a_few_higher_scores(spark):
    # one long vector coarsens the bins; five scores lie just above the bin that holds the near copies
    rows = [(0, [1.0]), (1, [-1_000_000.0])]
    rows += [(10 + i, [565_000.0 + i % 50]) for i in range(2000)]
    rows += [(5000 + i, [570_412.0 + i]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") == 0, scale=1.0).collect())
    best = sorted((-int(v[0]), i) for i, v in rows if i)[:10]
    assert got == [(0, r, i, -s) for r, (s, i) in enumerate(best, 1)]
