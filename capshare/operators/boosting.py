"""Quantile gradient boosting on Spark and scoring of tree ensembles.

Trees grow leaf by leaf: a priority queue on the driver splits the leaf of the highest gain until ``max_leaves`` are reached. Gains come from merged
histograms (level, node, feature, bin) of integer counts, to which every task adds its rows; rows never move. One pass over the rows serves all levels and
all leaves that the queue may still split, counts only the smaller child of each, and gets the sibling by subtraction. So a tree costs about
as many passes as it is deep. Tasks merge the histograms and the residuals of a leaf; the driver receives one message a pass.

A pass touches few rows: it follows the paths to the leaves it counts and no others, and at the root counts the rows on the rarer side of their
prediction only (all rows, whatever their side, are counted once). It reads their bins and one bit a level, not their residuals.

Rows are packed once into blocks of bin numbers (a byte a feature) and residuals, dealt evenly to the cores. Residuals advance once per round, and blocks are written
to the checkpoint folder every ``checkpoint_every`` rounds: a lost executor repeats at most so many rounds of its own rows.
"""
from __future__ import annotations

import heapq
import pickle
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..constants import QUANTILE_LEVELS
from ..session import shared_dir

Tree = list[dict]          # nodes: {"feature", "threshold", "left", "right"} or {"value"}
PIECE_ROWS, BLOCK_ROWS = 10_000, 50_000        # what is dealt to the tasks, and what they work on at a time
LEAST_ROWS, TASK_ROWS = 50_000, 500_000         # of a task: fewer are not worth one while cores are idle, more outweigh its histograms and what it reports
MERGE = 16                 # parts that one task merges
SUMMARY = 2048             # points that stand for the residuals of a leaf, at the least; exact up to so many rows a task
SCORE_ROWS = 20_000        # rows that are scored at a time


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> np.ndarray:
    """Approximate quantile edges per feature from one aggregate of mergeable sketches; a feature without values gets edges at 0."""
    probs = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    row = df.agg(*[F.percentile_approx(f, probs, 10 * bins).alias(str(i)) for i, f in enumerate(features)]).first()
    return np.array([row[i] or [0.0] * (bins - 1) for i in range(len(features))], dtype=float)


def _leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), dtype=np.int64)
    while True:
        inner = np.array(["feature" in n for n in tree])[node]
        if not inner.any():
            break
        f = np.array([n.get("feature", 0) for n in tree])[node]
        t = np.array([n.get("threshold", 0.0) for n in tree])[node]
        go = np.where(x[np.arange(len(x)), f] <= t, np.array([n.get("left", 0) for n in tree])[node], np.array([n.get("right", 0) for n in tree])[node])
        node = np.where(inner, go, node)
    return node


def _values(tree: Tree, x: np.ndarray) -> np.ndarray:
    return np.array([n.get("value", 0.0) for n in tree])[_leaf_of(tree, x)]


class _Grown:
    """A tree of one level while it grows: every node that has been counted, with its histogram and best split."""

    def __init__(self, shape: tuple[int, int], min_leaf: int, l2: float, level: float):
        self.shape, self.min_leaf, self.l2, self.level = shape, min_leaf, l2, level
        self.split, self.kids, self.gain, self.hist, self.size = [], [], [], [], []

    def add(self, hist: np.ndarray) -> int:
        """``hist``: rows and rows at or below their prediction, by (feature, bin)."""
        n, under = hist.astype(np.float64)
        g = under - self.level * n          # the gradient is 1 - level at or below the prediction, else -level
        nl, gl = n.cumsum(1)[:, :-1], g.cumsum(1)[:, :-1]
        n, g = n[0].sum(), g[0].sum()
        gain = gl ** 2 / (nl + self.l2) + (g - gl) ** 2 / (n - nl + self.l2) - g ** 2 / (n + self.l2)
        gain[(nl < self.min_leaf) | (n - nl < self.min_leaf)] = -np.inf
        f, b = np.unravel_index(int(gain.argmax()), gain.shape) if gain.size else (0, 0)
        best = float(gain[f, b]) if gain.size else -np.inf
        self.split.append((int(f), int(b)))
        self.gain.append(best if best > 1e-12 else -np.inf)
        self.kids.append(None)
        self.hist.append(hist if best > 1e-12 else None)
        self.size.append(int(n))
        return len(self.kids) - 1

    def grow(self, leaves: int) -> tuple[list[int], list[int]]:
        """Splits in the order of the queue as far as children are known, and the leaves to be counted before it can go on."""
        queue, done, total = [(-self.gain[0], 0)], [], 1
        blocked = []
        while queue and total < leaves:
            gain, node = heapq.heappop(queue)
            if gain == np.inf:
                break
            if self.kids[node] is None:
                # this leaf is split for certain, and of those behind it no more than splits are left
                blocked = [node] + [k for g, k in sorted(queue) if g < np.inf and self.kids[k] is None]
                return done, blocked[:leaves - total]
            done.append(node)
            total += 1
            for k in self.kids[node]:
                heapq.heappush(queue, (-self.gain[k], k))
        return done, []

    def arrays(self, nodes: Sequence[int] | None = None) -> np.ndarray:
        """feature, bin, left, right by node; nodes that are not split (or not in ``nodes``) have feature -1."""
        keep = None if nodes is None else set(nodes)
        return np.array([[*self.split[i], *k] if (k := self.kids[i]) and (keep is None or i in keep) else [-1, 0, 0, 0] for i in range(len(self.kids))], np.int64)


def _dealt(tree: Sequence[Sequence], x: np.ndarray, wanted: Sequence[int] | None = None) -> Iterator[tuple[int, np.ndarray | slice]]:
    """The leaves (or the ``wanted`` ones) and the numbers of their rows. ``tree``: feature, border, left and right by node, feature -1 in leaves; ``x`` by
    (feature, row). Rows are dealt from node to node, and only along paths that lead to wanted leaves; children have higher numbers than their parents then."""
    feature, border, left, right = tree
    if wanted is None:
        path = range(len(feature))
    else:
        path = set(wanted)
        for node in reversed(range(len(feature))):
            if feature[node] >= 0 and (left[node] in path or right[node] in path):
                path.add(node)
    todo: list = [(0, slice(None))]
    while todo:
        node, rows = todo.pop()
        if feature[node] < 0:
            yield node, rows
            continue
        go = x[feature[node]][rows] <= border[node]
        for kid, side in ((right[node], False), (left[node], True)):
            if kid in path:
                at = np.flatnonzero(go if side else ~go)
                todo.append((kid, at if isinstance(rows, slice) else rows.take(at)))


def _walks(trees: dict[int, np.ndarray]) -> dict[int, list[list[int]]]:
    return {k: tree.T.tolist() for k, tree in trees.items()}


def _packed(df: DataFrame, names: list[str], label: str, edges: np.ndarray, holdout: Column, tasks: int) -> RDD:
    """Blocks (fitting rows, held-out rows), each of bin numbers by (feature, row) and labels."""
    cols = df.select(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in names]).alias("x"), F.col(label).cast("double").alias("y"),
                     F.coalesce(holdout, F.lit(False)).alias("out")).where(F.col("y").isNotNull() & ~F.isnan("y"))
    width = len(names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, width)
            at = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)]).astype(np.uint8)      # NaN: behind all edges
            out = [at.tobytes(), b.column("y").to_numpy().tobytes(), b.column("out").to_numpy(zero_copy_only=False).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in out], ["x", "y", "out"])

    def gather(parts, most):
        held, n = [], 0
        for p in parts:
            held.append(p)
            n += len(p[1])
            if n >= most:
                yield tuple(np.concatenate(c, axis=-1) for c in zip(*held, strict=True))
                held, n = [], 0
        if held:
            yield tuple(np.concatenate(c, axis=-1) for c in zip(*held, strict=True))

    def numbered(i, rows):
        parts = ((np.frombuffer(r.x, np.uint8).reshape(width, -1), np.frombuffer(r.y), np.frombuffer(r.out, bool)) for r in rows)
        return ((i + j, (i, j, piece)) for j, piece in enumerate(gather(parts, PIECE_ROWS)))

    def blocks(pieces):
        for x, y, out in gather((p for *_, p in sorted(pieces, key=lambda p: p[:2])), BLOCK_ROWS):
            yield tuple((np.ascontiguousarray(x[:, side]), y[side]) for side in (~out, out))

    return cols.mapInArrow(pack, "x binary, y binary, out binary").rdd.mapPartitionsWithIndex(numbered).partitionBy(tasks, int).values().mapPartitions(blocks)


def _merged(parts: RDD, join, finish=lambda total: total):
    """``finish`` of the ``join`` over the partitions. Tasks join groups of ``MERGE`` parts, in their order, until one is left: whatever number of tasks
    counted, the driver receives one message."""

    def whole(batch):
        yield join([part for _, part in sorted(batch, key=lambda p: p[0])])

    while (n := parts.getNumPartitions()) > 1:
        numbered = parts.mapPartitionsWithIndex(lambda i, it: [(i // MERGE, (i, part)) for part in it])
        parts = numbered.partitionBy(-(-n // MERGE), int).values().mapPartitions(whole)
    return pickle.loads(zlib.decompress(parts.map(lambda total: zlib.compress(pickle.dumps(finish(total)), 1)).collect()[0]))


def _narrow(found: dict) -> dict:
    """Counts in the fewest bytes that hold them; sums of doubles as they are."""
    return {k: v if v.dtype.kind == "f" else v.astype(np.min_scalar_type(int(v.max(initial=0)))) for k, v in found.items()}


def _wide(found: dict) -> dict:
    return {k: v if v.dtype.kind == "f" else v.astype(np.int64) for k, v in found.items()}


def _add(a: dict, b: dict) -> dict:
    for k, v in b.items():
        a[k] = a[k] + v if k in a else v
    return a


def _sum(parts: list[dict]) -> dict:
    return _narrow(reduce(_add, parts[1:], _wide(parts[0])))


def _histogram(codes: np.ndarray, size: int) -> np.ndarray:
    """Rows by (feature, code); ``codes`` by (feature, row)."""
    if codes.shape[1] < 2 * size:           # one call instead of one a feature
        return np.bincount((codes + np.arange(len(codes))[:, None] * size).ravel(), minlength=len(codes) * size).reshape(-1, size)
    return np.stack([np.bincount(c, minlength=size) for c in codes])


def _signs(levels: np.ndarray):
    """Blocks (bins, bits, losses) of a round: bits by (level, row) of the fitting rows at or below their prediction, eight levels a byte; pinball sum and
    number of the held-out rows by level."""

    def of(block):
        (x, resid), (_, out) = block
        a = levels[:, None]
        return x, np.packbits(resid <= 0, axis=0), np.stack([np.maximum(a * out, (a - 1) * out).sum(1), np.full(len(levels), out.shape[1], float)], axis=1)

    return of


def _roots(signs: RDD, active: Sequence[int], levels: np.ndarray, bins: int, every: bool) -> dict:
    """By level's number: rows on the rarer side of their prediction by (feature, bin); under "losses" pinball sum and number of the held-out rows by level;
    with ``every`` under "n" all rows by (feature, bin)."""

    def part(blocks):
        acc: dict = {}
        for x, bits, losses in blocks:
            _add(acc, {"losses": losses})
            if every:
                _add(acc, {"n": _histogram(x, bins)})
            under = np.unpackbits(bits, axis=0, count=len(levels)).view(bool)
            for k in active:
                _add(acc, {k: _histogram(x[:, np.flatnonzero(under[k] if levels[k] <= 0.5 else ~under[k])], bins)})
        yield _narrow(acc)

    return _wide(_merged(signs.mapPartitions(part), _sum))


def _counts(signs: RDD, trees: dict[int, np.ndarray], wanted: dict[int, list[int]], bins: int) -> dict:
    """(level number, node) -> rows, and rows at or below their prediction, by (feature, bin), of the wanted leaves of each level."""
    code, walks = np.uint8 if bins <= 128 else np.uint16, _walks(trees)

    def part(blocks):
        acc: dict = {}
        for x, bits, _ in blocks:
            under = np.unpackbits(bits, axis=0, count=max(wanted) + 1)
            for k, nodes in wanted.items():
                for node, rows in _dealt(walks[k], x, nodes):
                    codes = x[:, rows].astype(code, copy=False) << 1 | under[k][rows]
                    above, below = _histogram(codes, 2 * bins).reshape(len(x), bins, 2).transpose(2, 0, 1)
                    _add(acc, {(k, node): np.stack([above + below, below])})
        yield _narrow(acc)

    return _wide(_merged(signs.mapPartitions(part), _sum))


def _summary(v: np.ndarray, w: np.ndarray, most: int = SUMMARY) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` sorted values of equal weight that stand for (v, w): ranks move by at most 1 / ``most`` of the weight."""
    order = np.argsort(v, kind="stable")
    v, w = v[order], w[order]
    if len(v) <= most:
        return v, w
    upto, total = np.cumsum(w), w.sum()
    return v[np.searchsorted(upto, (np.arange(most) + 0.5) / most * total)], np.full(most, total / most)


def _points(v: np.ndarray, most: int) -> tuple[np.ndarray, float]:
    """The same for values of weight one, and the weight of each point."""
    v, n = np.sort(v), len(v)
    return (v, 1.0) if n <= most else (v[np.ceil((np.arange(most) + 0.5) / most * n).astype(np.int64) - 1], n / most)


def _leaf_values(state: RDD, trees: dict[int, np.ndarray], levels: np.ndarray) -> dict:
    """(level number, leaf) -> quantile of the residuals at the level."""
    walks, most = _walks(trees), max(SUMMARY, 4 * SUMMARY // state.getNumPartitions())

    def join(parts: list[dict]) -> dict:
        found: dict = {}
        for p in parts:
            for key, (v, w) in p.items():
                found.setdefault(key, []).append((v, np.broadcast_to(w, len(v))))
        return {key: _summary(*map(np.concatenate, zip(*vw, strict=True)), 4 * SUMMARY) for key, vw in found.items()}

    def part(blocks):
        held: dict = {}
        for (x, resid), _ in blocks:
            for k, walk in walks.items():
                for node, rows in _dealt(walk, x):
                    held.setdefault((k, node), []).append(resid[k][rows])
        yield {key: _points(np.concatenate(vs), most) for key, vs in held.items()}

    def quantile(v, w, level):
        order = np.argsort(v, kind="stable")
        upto = np.cumsum(np.broadcast_to(w, len(v))[order])
        return float(v[order][min(np.searchsorted(upto, level * upto[-1] - 1e-9), len(v) - 1)])

    # a leaf that has no row in any task has no value
    return _merged(state.mapPartitions(part), join, lambda total: {k: quantile(v, w, levels[k[0]]) for k, (v, w) in total.items() if len(v)})


def fit(df: DataFrame, features: Sequence[str], label: str = "y", levels=QUANTILE_LEVELS, rounds: int = 300, rate: float = 0.05, max_leaves: int = 15, bins: int = 128,
        min_leaf: int = 40, l2: float = 1.0, holdout: Column | None = None, patience: int = 10, tolerance: float = 1e-7, checkpoint_every: int = 20) -> list[dict]:
    """One ensemble per level: ``[{"level", "base", "trees": [Tree], "losses"}]``.

    Rows where ``holdout`` holds (default: a tenth, by hash of features and label) fit nothing; a level ends when their pinball loss has not
    become better by ``tolerance`` for ``patience`` rounds, and keeps its trees up to the best round. ``losses`` are those of the held-out rows before each
    round. No held-out rows: all rounds. Null features count as larger than all values, rows with a null label take no part, no row: no ensemble.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins must be 2 to 256")
    shared_dir(df.sparkSession)
    names = list(features)
    if holdout is None:
        holdout = F.pmod(F.xxhash64(*[F.col(c).cast("double") for c in names], F.col(label)), F.lit(10)) == 0
    fitting = df.where(~F.coalesce(holdout, F.lit(False)))
    edges = bin_edges(fitting, names, bins)
    base, size = fitting.agg(F.percentile_approx(label, F.array(*[F.lit(float(a)) for a in levels]), 10000).alias("b"), F.count("*").alias("n")).first()
    if base is None:
        return []
    lv, shape = np.array(levels, float), (len(names), bins)
    models = [{"level": a, "base": float(b), "trees": [], "losses": []} for a, b in zip(levels, base, strict=True)]
    # passes are many and short: every core has a share, but no more tasks than rows keep busy
    tasks = max(1, -(-size // TASK_ROWS), min(df.sparkSession.sparkContext.defaultParallelism, size // LEAST_ROWS))
    start, kept = np.array(base, float)[:, None], StorageLevel.MEMORY_AND_DISK_DESER
    rows = _packed(df, names, label, edges, holdout, tasks)
    state = rows.map(lambda block: tuple((x, y - start) for x, y in block)).persist(kept)
    active, before, every = list(range(len(lv))), None, None
    for number in range(rounds + 1):
        signs = state.map(_signs(lv)).persist(kept)
        roots = _roots(signs, active, lv, bins, every is None)
        every = roots.get("n") if every is None else every
        if every is None:
            break               # no row with a label
        if before is not None:
            before.unpersist()
        for k in active:
            total, n = roots["losses"][k]
            if n:
                models[k]["losses"].append(float(total / n))
        active = [k for k in active if len(ls := models[k]["losses"]) <= patience or min(ls[-patience:]) < min(ls[:-patience]) - tolerance]
        if not active or number == rounds:
            break
        trees = {k: _Grown(shape, min_leaf, l2, lv[k]) for k in active}
        for k in active:
            trees[k].add(np.stack([every, roots[k] if lv[k] <= 0.5 else every - roots[k]]))
        active = [k for k in active if trees[k].gain[0] > -np.inf]
        if not active:
            break
        chosen: dict[int, list[int]] = {}
        while True:
            asked, wanted = {}, {}
            for k in active:
                chosen[k], asked[k] = trees[k].grow(max_leaves)
                t = trees[k]
                for node in asked[k]:
                    f, b = t.split[node]
                    small_left = 2 * t.hist[node][0, f, :b + 1].sum() <= t.size[node]
                    at = len(t.kids) + 2 * len(wanted.get(k, ()))
                    t.kids[node] = (at, at + 1)
                    wanted.setdefault(k, []).append(at if small_left else at + 1)
            if not wanted:
                break
            grown = {k: np.concatenate([trees[k].arrays(), np.full((2 * len(wanted[k]), 4), [-1, 0, 0, 0])]) for k in wanted}
            found = _counts(signs, grown, wanted, bins)
            for k, nodes in wanted.items():
                t = trees[k]
                for node, small in zip(asked[k], nodes, strict=True):
                    one = found[k, small]
                    for kid in t.kids[node]:
                        t.add(one if kid == small else t.hist[node] - one)
                    t.hist[node] = None
        final = {k: trees[k].arrays(chosen[k]) for k in active}
        values = _leaf_values(state, final, lv)
        steps = {}
        for k in active:
            step = np.array([rate * values.get((k, i), 0.0) for i in range(len(final[k]))])
            steps[k] = (final[k].T.tolist(), step)
            models[k]["trees"].append(_as_tree(final[k], step, edges))

        def advance(block, steps=steps):
            def ahead(x, resid):
                resid = resid.copy()
                for k, (walk, step) in steps.items():
                    for node, rows in _dealt(walk, x):
                        resid[k][rows] -= step[node]
                return x, resid
            return tuple(ahead(*side) for side in block)

        before, state = state, state.map(advance).persist(kept)
        signs.unpersist()
        if (number + 1) % checkpoint_every == 0:
            state.checkpoint()
    for rdd in (state, signs):
        rdd.unpersist()
    for m in models:
        if m["losses"]:
            m["trees"] = m["trees"][:int(np.argmin(m["losses"]))]
    return models


def _as_tree(nodes: np.ndarray, values: np.ndarray, edges: np.ndarray) -> Tree:
    """The reachable nodes, root first."""
    order, place = [0], {}
    for i in order:
        place[i] = len(place)
        if nodes[i, 0] >= 0:
            order += [int(nodes[i, 2]), int(nodes[i, 3])]
    return [{"feature": int(nodes[i, 0]), "threshold": float(edges[nodes[i, 0], nodes[i, 1]]), "left": place[int(nodes[i, 2])], "right": place[int(nodes[i, 3])]}
            if nodes[i, 0] >= 0 else {"value": float(values[i])} for i in order]


def tree_column(tree: Tree, features: Sequence[str], node: int = 0) -> Column:
    """A tree as nested conditionals, compiled by Spark together with the rest of the projection."""
    n = tree[node]
    if "value" in n:
        return F.lit(float(n["value"]))
    return F.when(F.col(features[n["feature"]]) <= F.lit(n["threshold"]), tree_column(tree, features, n["left"])).otherwise(
        tree_column(tree, features, n["right"]))


def score_columns(df: DataFrame, models: Sequence[dict], features: Sequence[str], out: str = "q") -> DataFrame:
    """Quantiles by compiled conditionals; right for small ensembles. Not negative, not crossing."""
    cols = []
    for m in models:
        total = F.lit(float(m["base"]))
        for t in m["trees"]:
            total = total + tree_column(t, features)
        cols.append(F.greatest(total, F.lit(0.0)))
    return df.withColumn(out, F.sort_array(F.array(*cols)))


def _scores(models: Sequence[dict], x: np.ndarray) -> np.ndarray:
    """Quantiles by (row, level); ``x`` by (row, feature)."""
    x, q = np.ascontiguousarray(x.T), np.zeros((len(models), len(x)))
    for m, total in zip(models, q, strict=True):
        for t in m["trees"]:
            for node, rows in _dealt([[n.get(c, -1) for n in t] for c in ("feature", "threshold", "left", "right")], x):
                total[rows] += t[node]["value"]
        total += m["base"]
    return np.sort(np.maximum(q.T, 0.0), axis=1)


def score_arrow(df: DataFrame, models: Sequence[dict], features: Sequence[str], out: str = "q") -> DataFrame:
    """Same result for large ensembles: rows are dealt down the trees, many at a time; the trees travel with the task."""
    models = list(models)

    def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held, n = [], 0
        for x in batches:
            if len(x):
                held.append(np.stack(x.to_numpy()))
                n += len(x)
            if n >= SCORE_ROWS:
                yield pd.Series(list(_scores(models, np.concatenate(held))))
                held, n = [], 0
        if held:
            yield pd.Series(list(_scores(models, np.concatenate(held))))

    return df.withColumn(out, F.pandas_udf(kernel, "array<double>")(F.array(*[F.col(c).cast("double") for c in features])))


def trees_table(spark, models: Sequence[dict]) -> DataFrame:
    """Ensembles as rows (level, tree, node, feature, threshold, left, right, value)."""
    rows = [(m["level"], i, k, n.get("feature"), n.get("threshold"), n.get("left"), n.get("right"), n.get("value"))
            for m in models for i, t in enumerate(m["trees"]) for k, n in enumerate(t)]
    return spark.createDataFrame(rows, "level double, tree int, node int, feature int, threshold double, left int, right int, value double")
