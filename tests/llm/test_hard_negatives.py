"""Hard-negative mining against all inner products, and its edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcgraph.llm import hard_negatives as hn


def brute(rows, anchor, positives=5, negatives=5, least=80, most=100):
    order = lambda r: (r[0] is None, r[0] or 0)
    dim = max((len(r[2]) for r in rows), default=0)
    full = [np.array(list(r[2]) + [0] * (dim - len(r[2])), dtype=object) for r in rows]
    out = []
    for i, row in enumerate(rows):
        if row[0] is None or not anchor(row[0]):
            continue
        scored = [(int(full[i] @ full[j]), j) for j in range(len(rows)) if j != i]
        scored.sort(key=lambda s: (-s[0], *order(rows[s[1]])))
        best = [s for s in scored if rows[s[1]][1] == row[1]][:positives]
        for ps, p in best:
            fits = [s for s in scored if rows[s[1]][1] != row[1] and least * ps <= 100 * s[0] <= most * ps][:negatives]
            out += [(row[0], rows[p][0], k, rows[n][0], ps, ns) for k, (ns, n) in enumerate(fits, 1)]
    return sorted(out, key=str)


def answer(spark, rows, every, **how):
    frame = spark.createDataFrame(rows, "id long, label int, vec array<long>").withColumn("cell", F.lit(1)).withColumn("row", F.lit("x"))
    found = hn.hard_negatives(frame, F.coalesce(F.col("id") % every == 0, F.lit(False)), **how)
    return sorted([tuple(r) for r in found.collect()], key=str)


def clustered(n, dim, seed):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(12, dim)) * 200
    kind = random.integers(0, 12, n)
    return [(i, int(random.integers(0, 3)), [int(v) for v in centres[kind[i]] + random.normal(size=dim) * 30]) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"positives": 3, "negatives": 7, "least": 50, "most": 95}])
def test_equals_all_products(spark, how):
    rows = clustered(1_200, 7, 1)
    assert answer(spark, rows, 60, **how) == brute(rows, lambda i: i % 60 == 0, **how)


def test_rounds_are_certified(spark, monkeypatch):
    """Small quotas and blocks: several rounds, several blocks of a cell, several batches of anchors."""
    for name, value in (("FIRST", 20), ("MORE", 2), ("BLOCK", 16), ("ANCHORS", 7)):
        monkeypatch.setattr(hn, name, value)
    rows = clustered(300, 6, 2)
    assert answer(spark, rows, 10) == brute(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    same = [5, 5, 5, 5]
    rows = [(i, i % 2, same) for i in range(40)] + [(0, 0, same), (0, 1, same), (None, 1, same), (None, 0, [9, 9]), (100, 0, []), (120, 1, [-5, -5]), (140, 7, [40_000, -3, 1, 70_000])]
    assert answer(spark, rows, 20) == brute(rows, lambda i: i % 20 == 0)


def test_without_rows_anchors_or_negatives(spark):
    assert answer(spark, [], 10) == []
    assert answer(spark, [(1, 1, [1, 2]), (2, 2, [1, 2])], 10) == []
    assert answer(spark, [(10, 1, [1, 2]), (20, 1, [1, 2]), (3, 1, [0, 0])], 10) == []


def test_cells_come_in_falling_order_and_bound_their_rows():
    random = np.random.default_rng(3)
    x = random.normal(size=(400, 6)) * 100
    words = hn.codebook(x[:, :3], 7), hn.codebook(x[:, 3:], 5)
    near = [hn._nearest(x[:, :3], words[0]), hn._nearest(x[:, 3:], words[1])]
    far = [np.linalg.norm(x[:, 3 * k : 3 * k + 3] - words[k][near[k]], axis=1) for k in (0, 1)]
    radii = [np.array([far[k][near[k] == c].max(initial=-np.inf) for c in range(len(words[k]))]) for k in (0, 1)]
    cell = near[0] * 5 + near[1]
    counts = np.bincount(cell, minlength=35)
    for q in x[:20]:
        seen = list(hn.cells_in_order((q[:3], q[3:]), words, radii, counts))
        assert sorted(c for _, c in seen) == sorted(set(cell.tolist()))
        assert all(a[0] >= b[0] for a, b in zip(seen, seen[1:]))
        assert all((x[cell == c] @ q <= bound).all() for bound, c in seen)


def test_query_filters_and_relabels(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(np.cos(i)), float(np.sin(i))], i % 3) for i in range(300)]
    rows += [(700, None, 1), (701, [nan, 1.0], 1), (702, [inf, 1.0], 1), (703, [None, 1.0], 1), (704, [1.0, 1.0], None), (None, [1.0, 0.5], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    clean = [
        (i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [int(np.floor(256 * float(np.float32(v)))) for v in vec])
        for i, vec, lab in rows
        if lab is not None and vec is not None and all(v is not None and np.isfinite(v) for v in vec)
    ]
    assert sorted([tuple(r) for r in hn.op12(spark, str(tmp_path)).collect()], key=str) == brute(clean, lambda i: i % 100 == 0)
