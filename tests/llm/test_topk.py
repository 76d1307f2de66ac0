"""A query's own row that repeats, in top-k."""

import numpy as np
from lathe.llm import topk


def test_repeated_query_rows_take_no_places(spark):
    rng = np.random.default_rng(3)
    rows = [(0, [3.0, 4.0, 0.0])] * 12 + [(i, (np.array([3.0, 4.0, 0.0]) * 0.9 + rng.normal(size=3) * 0.1).tolist()) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = [(r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 0").limit(1)).orderBy("rank").collect()]
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    want = sorted((-sum(a * b for a, b in zip(whole[0], v, strict=True)), i) for i, v in whole.items() if i)[:10]
    assert got == [(i, -s) for s, i in want]
