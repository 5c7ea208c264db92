"""What round 4 of the review found."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from capshare.operators import allocation as A, boosting as B, search


def _tree(rng, inner, width, bins):
    """feature, border, left and right by node of a random tree."""
    rows = [[-1, 0, 0, 0]]
    for _ in range(inner):
        at = rng.choice([i for i, r in enumerate(rows) if r[0] < 0])
        rows[at] = [int(rng.integers(width)), int(rng.integers(bins)), len(rows), len(rows) + 1]
        rows += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
    return np.array(rows)


def _leaf(tree, row):
    node = 0
    while tree[node, 0] >= 0:
        node = tree[node, 2 if row[tree[node, 0]] <= tree[node, 1] else 3]
    return node


def test_passes_count_what_a_plain_loop_counts(spark):
    """Only along the paths to the wanted leaves, only the rarer side at the root, from bins and one bit a level."""
    rng = np.random.default_rng(0)
    levels, width = np.array([0.05, 0.5, 0.9]), 4
    for bins in (16, 200):
        blocks = []
        for n in (3000, 700, 1):
            x, resid = rng.integers(0, bins, (width, n), dtype=np.uint8), rng.standard_normal((3, n)) - np.array([[1.6], [0.0], [-1.3]])
            resid[:, ::7] = 0.0                         # at the prediction: counts as below
            blocks.append(((x, resid), (x[:, :n // 3], resid[:, :n // 3])))
        state = spark.sparkContext.parallelize(blocks, 2)
        signs = state.map(B._signs(levels))
        assert max(len(bits) * bits.shape[1] + x.nbytes for x, bits, _ in signs.collect()) == 3000 * (width + 1)
        x, resid = (np.concatenate(c, axis=1) for c in zip(*[fit for fit, _ in blocks]))

        def plain(rows):
            return np.stack([np.bincount(c[rows], minlength=bins) for c in x])

        roots = B._roots(signs, [0, 1, 2], levels, bins, True)
        assert (roots["n"] == plain(slice(None))).all()
        for k, a in enumerate(levels):
            assert (roots[k] == plain(resid[k] <= 0 if a <= .5 else resid[k] > 0)).all()
            out = np.concatenate([held[1][k] for _, held in blocks])
            assert np.allclose(roots["losses"][k], [np.maximum(a * out, (a - 1) * out).sum(), len(out)])
        trees = {k: _tree(rng, 6, width, bins) for k in (0, 2)}
        leaves = {k: np.array([_leaf(t, row) for row in x.T]) for k, t in trees.items()}
        wanted = {k: [int(i) for i in np.flatnonzero(t[:, 0] < 0)[::2]] for k, t in trees.items()}
        found = B._counts(signs, trees, wanted, bins)
        for k, nodes in wanted.items():
            for node in nodes:
                at = leaves[k] == node
                assert (found[k, node] == [plain(at), plain(at & (resid[k] <= 0))]).all()
        values = B._leaf_values(state, trees, levels)
        for k in trees:
            assert {i for j, i in values if j == k} == set(leaves[k].tolist())
            for i in set(leaves[k].tolist()):
                v = np.sort(resid[k][leaves[k] == i])
                assert values[k, i] == v[int(np.ceil(levels[k] * len(v) - 1e-9)) - 1]


def test_rows_are_dealt_evenly_and_none_is_lost(spark):
    n = 30_000
    df = spark.range(n, numPartitions=3).select((F.col("id") % 13).cast("double").alias("f0"), F.col("id").cast("double").alias("y"))
    rows = B._packed(df, ["f0"], "y", np.arange(12.0)[None], F.col("y") % 10 == 0, 3)
    parts = rows.glom().collect()
    assert [sum(len(y) + len(out) for (_, y), (_, out) in p) for p in parts] == [n // 3] * 3
    fit, held = (np.concatenate([block[side][1] for p in parts for block in p]) for side in (0, 1))
    assert sorted(fit) == [i for i in range(n) if i % 10] and sorted(held) == list(range(0, n, 10))
    for p in parts:
        for block in p:
            assert all((x[0] == y % 13).all() for x, y in block)


def test_scores_add_up_as_before_bit_by_bit():
    rng = np.random.default_rng(1)
    models, x = [], rng.random((500, 5))
    x[::9, 2] = np.nan
    for level in (0.1, 0.5):
        trees = []
        for _ in range(20):
            t = _tree(rng, 14, 5, 100)
            trees.append([{"feature": int(f), "threshold": b / 100, "left": int(left), "right": int(right)} if f >= 0 else {"value": float(rng.standard_normal())} for f, b, left, right in t])
        models.append({"level": level, "base": 0.3, "trees": trees})
    want = np.stack([m["base"] + sum((B._values(t, x) for t in m["trees"]), np.zeros(len(x))) for m in models], axis=1)
    assert (B._scores(models, x) == np.sort(np.maximum(want, 0.0), axis=1)).all()


def test_class_level_costs_are_those_of_the_rule(spark):
    """Groups of one to eleven cells, scarce and ample capacity, equal ratios, nulls; blocks end inside no group; no row is copied for a point."""
    rng = np.random.default_rng(2)
    rows = []
    for g in range(700):
        capacity = float(rng.choice([40.0, 150.0, 900.0]))
        for c in range(int(rng.integers(1, 12))):
            q = None if rng.random() < .03 else [float(v) for v in np.sort(rng.gamma(2, 10, 6))]
            rows.append((g % 50, g // 50, c, int(rng.choice([4, 8, 20, 40])), float(rng.choice([.5, 1., 3.])), float(rng.choice([10., 30., 30., 100.])), capacity,
                         None if rng.random() < .03 else float(rng.choice([0., 5., 25.])), None if rng.random() < .03 else float(rng.gamma(1, 30)), q))
    df = spark.createDataFrame(rows, "link_id long, epoch long, cell_id long, deadline int, priority double, cap double, capacity double, backlog double, label double, q array<double>")
    points = [(0.05, 0.995, 0.5), (0.97, 0.3, 3.0), (0.25, 0.5, 20.0), (0.6, 0.02, 1.0)]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "candidate int, p_ll double, p_embb double, w_ll double")
    want = search.score(A.class_levels(search.tried(df, table), 22, "p_ll", "p_embb", "w_ll", [*search.GROUP, "candidate"]), 22, ["candidate"])
    want = {r.candidate: r.cost for r in want.collect()}
    most, batch = search.BLOCK_ROWS, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for search.BLOCK_ROWS, size in ((most, batch), (50, "7")):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            blocks = search.packed(df).checkpoint()
            assert sum(r.size * (len(r.data) // (12 * 8 * r.size)) for r in blocks.collect()) == len(rows)
            costs = search.class_level_costs(blocks, points, 22)
            assert {r.candidate: r.cost for r in costs.collect()} == pytest.approx(want, rel=1e-12)
    finally:
        search.BLOCK_ROWS = most
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    plan = search.class_level_costs(blocks, points, 22)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("hashpartitioning") == 1
