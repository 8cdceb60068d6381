"""Vector search with many queries."""

from __future__ import annotations

import numpy as np

from lodestack.operators import vectors


def test_nearest_takes_any_number_of_queries(spark):
    angles = np.linspace(0, 3, 30)
    v = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)], "id long, embedding array<double>")
    n = 10_001
    q = spark.createDataFrame([(str(i), [float(2 * np.cos(angles[i % 30])), float(2 * np.sin(angles[i % 30]))]) for i in range(n)], "query_id string, embedding array<double>")
    got = vectors.nearest(v, q, 1).collect()
    assert len(got) == n and all(r["id"] == int(r["query_id"]) % 30 for r in got)
