"""Bagged trees and random forests (B1, B2) whose state never passes through the driver.

The predictors are binned once and packed with the outcome into one compact table in the
shared folder.  The bootstrap is a Poisson weight per (row, tree) and the features tried at a
node are a draw per (tree, node); both are hashes, so any partitioning grows the same trees.

*Upper nodes.*  While a node holds more than ``LOCAL_ROWS`` drawn rows, its histograms (draws and
outcome per feature and bin) are summed by Spark: one pass counts a whole batch of
(tree, node), its splits come back.  *Lower nodes.*  Then one shuffle takes each node's rows
to a task, which grows the rest of its subtree and writes it to the shared folder.  A task
holds one such node; the driver holds the upper nodes of a batch of trees
(``MAX_UPPER_NODES``) while they grow, and afterwards one node per ``LOCAL_ROWS`` rows and tree.

The packed rows lie in the order of their bins.  A pass takes rows of equal bins as one, with the sums of their draws and drawn
outcomes for each tree; without equal rows it takes them one by one.  Where all rows have at most ``TASK_KINDS`` different
bins, a tree has no upper nodes: one task grows it whole.

The outcome is an integer (centred, ``BITS`` bits of its range), so sums are exact in any
order: the trees do not depend on partitions nor on ``LOCAL_ROWS``.

Scoring meets rows and subtrees by (tree, lower node) in a cogroup; nothing is broadcast.  Rows of equal
(binned) predictors are scored once, and a row that ends in an upper leaf has its value where it is read.

A NULL predictor goes right; rows without an outcome are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import poisson_thresholds
from ..session import snapshot
from .hist import Bins, make_bins
from .ranking import number_rows, shuffled

LOCAL_ROWS = 200_000
TASK_KINDS = 1_500_000  # rows of different bins that a task holds to grow a whole tree
MAX_UPPER_NODES = 200_000
MAX_CELLS = 4_000_000   # histogram cells of one pass, and of one step inside a task
BLOB_BYTES = 8_000_000  # blobs handed to Arrow at once
CHUNK_ROWS = 100_000    # packed rows that a pass takes at a time
BITS = 30
MAX_DRAWS = 20
JOINT_BITS = 4
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambler of 64-bit words."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass(frozen=True)
class Plan:
    """What a tree is grown with."""
    features: int
    bins: int
    mtry: int
    min_node: int = 5        # a node with at most so many drawn rows is a leaf
    min_child: int = 1
    max_depth: int = 10_000
    seed: int = 1
    sample_frac: float = 1.0
    bootstrap: bool = True
    per_round: int = 0       # shadow rounds: so many trees share a round's copies; features are real ones, then shadows
    widths: tuple = ()       # bins of every feature, at most ``bins``

    def width(self, f: int) -> int:
        return self.widths[f] if self.widths else self.bins

    def view(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The packed features that ``tree`` uses."""
        if not self.per_round:
            return x
        p, r = self.features // 2, tree // self.per_round
        return np.concatenate([x[:p], x[p * (r + 1):p * (r + 2)]])

    def draws(self, h: np.ndarray, tree: int) -> np.ndarray:
        """How often each row (by its hash) is drawn for ``tree``."""
        if not self.bootstrap:
            return np.ones(len(h), np.uint8)
        u = (_mix(h + np.array([tree + 1], np.uint64) * GOLDEN) >> np.uint64(11)).astype(float) * 2.0 ** -53
        return np.searchsorted(np.array(poisson_thresholds(self.sample_frac, MAX_DRAWS)), u, side="right").astype(np.uint8)

    def tried(self, ids: np.ndarray, tree: int) -> np.ndarray:
        """Features tried at the nodes ``ids`` (heap numbers) as a boolean matrix."""
        out = np.ones((len(ids), self.features), bool)
        if self.mtry < self.features:
            h = _mix(ids + _mix(np.array([self.seed * 1_000_003 + tree], np.uint64)))
            r = _mix(h[:, None] + GOLDEN * np.arange(1, self.features + 1, dtype=np.uint64)[None, :])
            out[:] = False
            np.put_along_axis(out, np.argpartition(r, self.mtry - 1, axis=1)[:, :self.mtry], True, 1)
        return out


def best_cuts(n: np.ndarray, s: np.ndarray, min_child: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row of the histograms ``n`` and ``s``: gain (-inf without a cut), bin, left count, left sum."""
    cn, cs = n.cumsum(1), s.cumsum(1)
    total, sums = cn[:, -1:], cs[:, -1:]
    ok = (cn >= max(1, min_child)) & (total - cn >= max(1, min_child)) & (n > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, cs * cs / cn + (sums - cs) ** 2 / (total - cn) - sums * sums / total, -np.inf)
    b = gain.argmax(1)
    r = np.arange(len(b))
    return gain[r, b], b, cn[r, b], cs[r, b]


# ------------------------------------------------------------ one subtree in a task

class Grown:
    """Node arrays; the right child follows the left one."""

    def __init__(self):
        self.feature, self.cut, self.left, self.value, self.gain, self.n = [], [], [], [], [], []

    def pack(self, p: int) -> dict:
        f = np.concatenate(self.feature)
        gain = np.concatenate(self.gain)
        return {"nodes": len(f), "feature": f.astype(np.int16).tobytes(), "cut": np.concatenate(self.cut).astype(np.uint8).tobytes(),
                "left": np.concatenate(self.left).astype(np.int32).tobytes(),
                "value": np.concatenate(self.value).astype(np.float64).tobytes(), "n": np.concatenate(self.n).astype(np.int64).tobytes(),
                "gains": np.bincount(f[f >= 0], gain[f >= 0], minlength=p).tolist()}


def _together(x: np.ndarray, plan: Plan):
    """Features of two bins packed ``JOINT_BITS`` to a byte: columns, wide features, groups, and per feature column, shift and mask."""
    wide = [f for f in range(plan.features) if plan.width(f) > 2]
    two = [f for f in range(plan.features) if plan.width(f) == 2]
    groups = [two[k:k + JOINT_BITS] for k in range(0, len(two), JOINT_BITS)]
    column, shift, mask = np.zeros(plan.features, np.int64), np.zeros(plan.features, np.uint8), np.full(plan.features, 255, np.uint8)
    out = np.zeros((len(wide) + len(groups), x.shape[1]), np.uint8)
    for k, f in enumerate(wide):
        out[k], column[f] = x[f], k
    for k, g in enumerate(groups, len(wide)):
        for j, f in enumerate(g):
            out[k] |= x[f] << np.uint8(j)
            column[f], shift[f], mask[f] = k, j, 1
    return out, wide, groups, column, shift, mask


def grow_local(x: np.ndarray, y: np.ndarray | None, w: np.ndarray, tree: int, heap: int, depth: int, plan: Plan,
               wy: np.ndarray | None = None) -> Grown:
    """All nodes below ``heap`` from the rows drawn into it, level by level.

    ``x`` is (features, rows) of bins, ``y`` the integer outcome, ``w`` the draws (``wy``: sums of the drawn outcomes, where a
    row stands for many).  Rows of nodes that stay leaves are let go at once; those of a node that may split lie together.
    """
    out, ids = Grown(), np.array([heap], np.uint64)
    w = w.astype(float)
    wy = w * y if wy is None else wy.astype(float)
    n, s = np.array([w.sum()]), np.array([wy.sum()])
    x, wide, groups, column, shift, mask = _together(x, plan)
    slot = np.zeros(len(w), np.int64)  # place among the nodes that may split
    made = 1
    while len(ids):
        k = len(ids)
        gain, feature = np.zeros(k), np.full(k, -1)
        cut = np.zeros(k, np.int64)
        open_ = np.flatnonzero(n > plan.min_node) if depth < plan.max_depth else np.zeros(0, int)
        bound = np.r_[0, np.cumsum(np.bincount(slot, minlength=len(open_)))] if len(open_) else np.zeros(1, int)
        step = max(1, MAX_CELLS // plan.bins)
        for lo in range(0, len(open_), step):
            some = open_[lo:lo + step]
            a, b = bound[lo], bound[lo + len(some)]
            ws, wys, at = w[a:b], wy[a:b], slot[a:b] - lo
            tried = plan.tried(ids[some], tree)
            gains, cuts = np.full((len(some), plan.features), -np.inf), np.zeros((len(some), plan.features), np.uint8)
            for q, f in enumerate(wide):
                width, has = plan.width(f), np.flatnonzero(tried[:, f])
                if len(has) == len(some):
                    t, xf, wf, wyf = at, x[q, a:b], ws, wys
                else:
                    to = np.full(len(some), -1)
                    to[has] = np.arange(len(has))
                    t = to[at]
                    rows = np.flatnonzero(t >= 0)
                    t, xf, wf, wyf = t[rows], x[q, a:b][rows], ws[rows], wys[rows]
                cell = t * width + xf
                size = len(has) * width
                if size:
                    gains[has, f], cuts[has, f], _, _ = best_cuts(np.bincount(cell, wf, size).reshape(len(has), -1),
                                                                  np.bincount(cell, wyf, size).reshape(len(has), -1), plan.min_child)
            for q, g in enumerate(groups, len(wide)):
                states = 1 << len(g)
                zero = (np.arange(states)[:, None] >> np.arange(len(g)) & 1 == 0).astype(float)
                cell = at * states + x[q, a:b]
                cn, cs = (np.bincount(cell, v, len(some) * states).reshape(-1, states) @ zero for v in (ws, wys))
                all_n, all_s = n[some, None], s[some, None]
                ok = tried[:, g] & (cn >= max(1, plan.min_child)) & (all_n - cn >= max(1, plan.min_child))
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains[:, g] = np.where(ok, cs * cs / cn + (all_s - cs) ** 2 / (all_n - cn) - all_s * all_s / all_n, -np.inf)
            f = gains.argmax(1)  # the first of equal ones
            r = np.arange(len(some))
            hit = gains[r, f] > 0
            gain[some[hit]], feature[some[hit]], cut[some[hit]] = gains[r, f][hit], f[hit], cuts[r, f][hit]
        split = np.flatnonzero(feature >= 0)
        left = np.zeros(k, np.int64)
        left[split] = made + 2 * np.arange(len(split))
        made += 2 * len(split)
        for to, v in zip((out.feature, out.cut, out.left, out.value, out.gain, out.n), (feature, cut, left, s / np.maximum(n, 1), gain, n)):
            to.append(v)
        ids = (ids[split, None] * np.uint64(2) + np.arange(2, dtype=np.uint64)[None, :]).ravel()
        depth += 1
        if not len(split):
            break
        child = np.full(k, -1)
        child[split] = 2 * np.arange(len(split))
        node = open_[slot]
        keep = np.flatnonzero(child[node] >= 0)
        node = node[keep]
        f = feature[node]
        go = child[node] + (x[column[f], keep] >> shift[f] & mask[f] > cut[node])
        n, s = np.bincount(go, w[keep], 2 * len(split)), np.bincount(go, wy[keep], 2 * len(split))
        opened = (n > plan.min_node) & (depth < plan.max_depth)
        go, keep = (v[opened[go]] for v in (go, keep))
        go = (np.cumsum(opened) - 1)[go]
        order = np.argsort(go.astype(np.uint16) if opened.sum() <= 65_536 else go, kind="stable")
        slot, keep = go[order], keep[order]
        x, w, wy = x[:, keep], w[keep], wy[keep]
    return out


# ------------------------------------------------------------ upper nodes

@dataclass
class Upper:
    """The upper nodes of one tree: node 0 is the root; ``state`` 0 split, 1 lower node (grown in a task), 2 leaf, 3 open."""
    heap: list = field(default_factory=lambda: [1])
    depth: list = field(default_factory=lambda: [0])
    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [0])
    state: list = field(default_factory=lambda: [1])
    value: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])
    n: list = field(default_factory=lambda: [0])

    def split(self, i: int, f: int, cut: int, gain: float, kids: list[tuple[int, float]], local_rows: int) -> None:
        self.feature[i], self.cut[i], self.gain[i], self.left[i], self.state[i] = f, cut, gain, len(self.heap), 0
        for side, (n, s) in enumerate(kids):
            self.heap.append((self.heap[i] * 2 + side) & (2 ** 64 - 1))
            self.depth.append(self.depth[i] + 1)
            for to, v in zip((self.feature, self.cut, self.left, self.state, self.value, self.gain, self.n),
                             (-1, 0, 0, 3 if n > local_rows else 1, s / n, 0.0, n)):
                to.append(v)

    def frozen(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature, np.int64), np.array(self.cut, np.int64), np.array(self.left, np.int64),
                np.array(self.state, np.int8), np.array(self.heap, np.uint64), np.array(self.depth, np.int64))


def walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Last node of every row of ``x`` (features, rows)."""
    at = np.zeros(x.shape[1], np.int64)
    live = np.flatnonzero(feature[at] >= 0)
    while len(live):
        f = feature[at[live]]
        at[live] = left[at[live]] + (x[f, live] > cut[at[live]])
        live = live[feature[at[live]] >= 0]
    return at


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (or row number), outcome and bins (features, rows) of packed rows."""
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    return (batch.column("h").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64),
            batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64), np.ascontiguousarray(x.T))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``_columns`` of at least ``CHUNK_ROWS`` rows at a time (the last: fewer)."""
    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(_columns(b))
            rows += b.num_rows
        if rows >= CHUNK_ROWS:
            yield tuple(np.concatenate(v, axis=-1) for v in zip(*held))
            held, rows = [], 0
    if held:
        yield tuple(np.concatenate(v, axis=-1) for v in zip(*held))


def _runs(packed: np.ndarray, plan: Plan) -> np.ndarray | None:
    """First row of every run of equal bins; None where the rows are taken one by one."""
    if plan.per_round or not packed.shape[1]:
        return None
    first = np.flatnonzero(np.r_[True, (packed[:, 1:] != packed[:, :-1]).any(0)])
    return first if len(first) < packed.shape[1] else None


def _drawn(plan: Plan, tree: int, h: np.ndarray, y: np.ndarray, first: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Draws, and sums of the drawn outcomes, of every row or run of equal rows."""
    w = plan.draws(h, tree).astype(np.int64)
    return (w, w * y) if first is None else (np.add.reduceat(w, first), np.add.reduceat(w * y, first))


def _pack(df: DataFrame, features: list[str], bins: Bins, h, y) -> DataFrame:
    """``h bigint, y bigint, x binary``: one byte per feature."""
    cuts = [np.asarray(bins.cuts[f], float) for f in features]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.empty((b.num_rows, len(cuts)), np.uint8)
            for i, c in enumerate(cuts):
                x[:, i] = np.searchsorted(c, b.column(i + 2).to_numpy(zero_copy_only=False).astype(float), side="left")
            ends = pa.py_buffer(np.arange(b.num_rows + 1, dtype=np.int32) * np.int32(len(cuts)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, ends, pa.py_buffer(x)])],
                                             ["h", "y", "x"])

    cols = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    return df.select(h.alias("h"), y.cast("bigint").alias("y"), *cols).mapInArrow(fold, "h bigint, y bigint, x binary")


def _histograms(base: DataFrame, trees: list[int], frozen: list, where: dict, plan: Plan) -> DataFrame:
    """Summed histograms ``(slot, f, b, n, s)`` of the open nodes ``where[(tree, node)] = slot``."""
    p, nb, k = plan.features, plan.bins, len(where)
    slots = []
    for t, fr in zip(trees, frozen):
        to = np.full(len(fr[0]), -1)
        for (u, i), slot in where.items():
            if u == t:
                to[i] = slot
        slots.append(to)
    tried = np.zeros((k, p), bool)
    for (u, i), slot in where.items():
        tried[slot] = plan.tried(frozen[trees.index(u)][4][[i]], u)[0]

    def fold(batches):
        n, s = np.zeros((p, k * nb), np.int64), np.zeros((p, k * nb), np.int64)
        for h, y, packed in _chunks(batches):
            first = _runs(packed, plan)
            packed = packed if first is None else packed[:, first]
            for t, fr, to in zip(trees, frozen, slots):
                mine = to[to >= 0]
                if not len(mine):
                    continue
                lo, hi = int(mine.min()), int(mine.max()) + 1  # a tree's slots lie together
                x = plan.view(packed, t)
                slot, (w, wy) = to[walk(x, *fr[:3])], _drawn(plan, t, h, y, first)
                use = np.flatnonzero((slot >= 0) & (w > 0))
                slot, w, wy = slot[use], w[use].astype(float), wy[use].astype(float)
                for f in range(p):
                    some = tried[lo:hi, f]
                    if not some.any():
                        continue
                    r = slice(None) if some.all() else np.flatnonzero(some[slot - lo])
                    cell = (slot[r] - lo) * nb + x[f, use[r]]
                    n[f, lo * nb:hi * nb] += np.bincount(cell, w[r], (hi - lo) * nb).astype(np.int64)
                    s[f, lo * nb:hi * nb] += np.bincount(cell, wy[r], (hi - lo) * nb).astype(np.int64)
        f, c = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (c // nb, f, c % nb, n[f, c], s[f, c])], ["slot", "f", "b", "n", "s"])

    return (base.mapInArrow(fold, "slot bigint, f bigint, b bigint, n bigint, s bigint")
            .groupBy("slot", "f", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))


def _choose(plan: Plan):
    """Best split of a node from its summed histogram rows."""

    def fn(key, table):
        f, b = table["f"].to_numpy(), table["b"].to_numpy()
        have = np.unique(f)
        row = np.searchsorted(have, f)
        n, s = np.zeros((len(have), plan.bins)), np.zeros((len(have), plan.bins))
        n[row, b], s[row, b] = table["n"].to_numpy(), table["s"].to_numpy()
        g, c, nl, sl = best_cuts(n, s, plan.min_child)
        k = int(g.argmax())
        return pa.table({"slot": [key[0].as_py()], "f": [int(have[k]) if g[k] > 0 else -1], "cut": [int(c[k])], "gain": [float(max(g[k], 0))],
                         "nl": [int(nl[k])], "sl": [float(sl[k])], "n": [int(n[0].sum())], "s": [float(s[0].sum())]})

    return fn


def _grow_upper(base: DataFrame, trees: list[int], plan: Plan, rows: int, local_rows: int, whole: bool = False) -> list[Upper]:
    """Upper nodes of a batch of trees: one pass of ``base`` per level and ``MAX_CELLS``; none where a task takes a ``whole`` tree."""
    ups = [Upper() for _ in trees]
    drawn = rows * (plan.sample_frac if plan.bootstrap else 1.0)
    if whole or drawn <= local_rows:
        return ups
    for u in ups:
        u.state[0] = 3
    step = max(1, MAX_CELLS // (plan.bins * plan.features))
    while True:
        todo = [(t, i) for t, u in zip(trees, ups) for i, st in enumerate(u.state) if st == 3]
        if not todo:
            return ups
        frozen = [u.frozen() for u in ups]
        for lo in range(0, len(todo), step):
            where = {ti: slot for slot, ti in enumerate(todo[lo:lo + step])}
            got = _histograms(base, trees, frozen, where, plan).groupBy("slot").applyInArrow(
                _choose(plan), "slot bigint, f bigint, cut bigint, gain double, nl bigint, sl double, n bigint, s double").collect()
            splits = {r["slot"]: r for r in got}
            for (t, i), slot in where.items():
                u, r = ups[trees.index(t)], splits.get(slot)
                if r is not None and not i:
                    u.n[0], u.value[0] = r["n"], r["s"] / r["n"]
                if r is None or r["f"] < 0 or r["n"] <= plan.min_node or u.depth[i] >= plan.max_depth:
                    u.state[i] = 2
                else:
                    u.split(i, r["f"], r["cut"], r["gain"], [(r["nl"], r["sl"]), (r["n"] - r["nl"], r["s"] - r["sl"])], local_rows)


def _deal(trees: list[int], frozen: list, plan: Plan, train: bool, salts: int = 1):
    """Rows of packed batches to their lower nodes: one blob per (tree, node) and batch."""

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "node", "salt", "h", "y", "w", "x"]
        out: dict = {c: [] for c in names}
        size = 0
        for k, (h, y, packed) in enumerate(_chunks(batches)):
            runs, view = _runs(packed, plan) if train else None, None
            packed = packed if runs is None else packed[:, runs]
            for t, fr in zip(trees, frozen):
                if view is None or (plan.per_round and t // plan.per_round != view):
                    view, x = t // plan.per_round if plan.per_round else 0, plan.view(packed, t)
                    xt = np.ascontiguousarray(x.T)
                if train:
                    w, wy = _drawn(plan, t, h, y, runs)
                    use = np.flatnonzero(w > 0)
                else:
                    use = np.arange(len(h))
                if len(fr[0]) > 1:
                    at = walk(x if len(use) == x.shape[1] else x[:, use], *fr[:3])
                    local = fr[3][at] == 1
                    use, at = use[local], at[local]
                    order = np.argsort(at, kind="stable")
                    use, at = use[order], at[order]
                else:
                    use, at = use[:len(use) if fr[3][0] == 1 else 0], np.zeros(len(use), np.int64)
                if not len(use):
                    continue
                nodes, first = np.unique(at, return_index=True)
                for i, r in zip(nodes.tolist(), np.split(use, first[1:])):
                    out["tree"].append(t)
                    out["node"].append(i)
                    out["salt"].append(k % salts)
                    out["h"].append(b"" if train else h[r].tobytes())
                    out["y"].append(wy[r].tobytes() if train else b"")
                    out["w"].append(w[r].astype(np.uint32).tobytes() if train else b"")
                    out["x"].append(xt[r].tobytes())
                size += len(use) * (len(x) + 12)
                if size >= BLOB_BYTES:
                    yield _blob_batch(out, names)
                    out, size = {c: [] for c in names}, 0
        if out["tree"]:
            yield _blob_batch(out, names)

    return blobs


def _upper_values(frozen: list, values: list, plan: Plan):
    """Rows of packed batches with the sum ``v`` over the trees whose upper leaf they end in."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, _, x in _chunks(batches):
            v = np.zeros(len(h))
            for fr, value in zip(frozen, values):
                at = walk(x, *fr[:3])
                v += np.where(fr[3][at] == 2, value[at], 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(v)], ["_row", "v"])

    return fn


def _deal_grid(trees: list[int], frozen: list, values: list, f: int, codes: list[int], salts: int, upper: bool):
    """Rows (``h``: how many are equal) to the lower nodes that they reach with feature ``f`` at ``codes``.

    A row goes to a node once, with a bit (in ``w``) per code that leads there.  With ``upper`` instead the sums
    ``(code number, v)`` of the values of the upper leaves.
    """
    names = ["tree", "node", "salt", "h", "y", "w", "x"]
    bits = np.uint64(1) << np.arange(len(codes), dtype=np.uint64)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict = {c: [] for c in names}
        size, sums = 0, np.zeros(len(codes))
        for k, (h, _, x) in enumerate(_chunks(batches)):
            count, x = h.view(np.int64), x.copy()
            for t, fr, value in zip(trees, frozen, values):
                at = np.empty((len(codes), len(count)), np.int64)
                for j, c in enumerate(codes):
                    x[f] = c
                    at[j] = walk(x, *fr[:3])
                if upper:
                    sums += (np.where(fr[3][at] == 2, value[at], 0.0) * count).sum(1)
                    continue
                for i in np.unique(at):
                    if fr[3][i] != 1:
                        continue
                    mask = ((at == i) * bits[:, None]).sum(0, dtype=np.uint64)
                    use = np.flatnonzero(mask)
                    out["tree"].append(t)
                    out["node"].append(int(i))
                    out["salt"].append(k % salts)
                    out["h"].append(count[use].tobytes())
                    out["y"].append(b"")
                    out["w"].append(mask[use].tobytes())
                    out["x"].append(x[:, use].T.tobytes())
                    size += len(use) * (len(x) + 16)
                if size >= BLOB_BYTES:
                    yield _blob_batch(out, names)
                    out, size = {c: [] for c in names}, 0
        if upper:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(codes)), pa.int32()), pa.array(sums)], ["j", "v"])
        elif out["tree"]:
            yield _blob_batch(out, names)

    return fn


def _score_grid(p: int, f: int, codes: list[int]):
    def fn(key, rows, tree):
        sums = np.zeros(len(codes))
        if rows.num_rows and tree.num_rows:
            feature, cut, left, value = _subtree(tree)
            for k in range(rows.num_rows):
                x = np.ascontiguousarray(np.frombuffer(rows["x"][k].as_py(), np.uint8).reshape(-1, p).T)
                count, mask = np.frombuffer(rows["h"][k].as_py(), np.int64), np.frombuffer(rows["w"][k].as_py(), np.uint64)
                for j, c in enumerate(codes):
                    use = np.flatnonzero(mask >> np.uint64(j) & np.uint64(1))
                    if len(use):
                        at = x[:, use]
                        at[f] = c
                        sums[j] += (value[walk(at, feature, cut, left)] * count[use]).sum()
        return pa.table({"j": pa.array(np.arange(len(codes)), pa.int32()), "v": pa.array(sums)})

    return fn


def _subtree(tree) -> tuple[np.ndarray, ...]:
    feature, cut, left, value = (np.frombuffer(tree[c][0].as_py(), k)
                                 for c, k in (("feature", np.int16), ("cut", np.uint8), ("left", np.int32), ("value", np.float64)))
    return feature.astype(np.int64), cut, left.astype(np.int64), value


def _blob_batch(out: dict, names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(names, kinds)], names)


BLOB = "tree int, node bigint, salt int, h binary, y binary, w binary, x binary"
SUBTREE = ("tree int, node bigint, nodes int, feature binary, cut binary, left binary, value binary, n binary, gains array<double>")


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _grow_group(trees: list[int], frozen: list, plan: Plan):
    where = dict(zip(trees, frozen))

    def fn(key, table):
        tree, node = key[0].as_py(), key[1].as_py()
        fr = where[tree]
        x = np.ascontiguousarray(_joined(table["x"], np.uint8).reshape(-1, plan.features).T)
        wy, w = _joined(table["y"], np.int64), _joined(table["w"], np.uint32)
        got = grow_local(x, None, w, tree, int(fr[4][node]), int(fr[5][node]), plan, wy).pack(plan.features)
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int64()), "nodes": pa.array([got["nodes"]], pa.int32()),
                         **{c: pa.array([got[c]], pa.binary()) for c in ("feature", "cut", "left", "value", "n")},
                         "gains": pa.array([got["gains"]], pa.list_(pa.float64()))})

    return fn


def _leaf_rows(spark: SparkSession, trees: list[int], ups: list[Upper], p: int) -> DataFrame | None:
    """Upper leaves as subtrees of one node (nodes of many rows that no feature splits)."""
    rows = [(t, i, 1, np.int16([-1]).tobytes(), b"\0", np.int32([0]).tobytes(), np.float64([u.value[i]]).tobytes(),
             np.int64([u.n[i]]).tobytes(), [0.0] * p)
            for t, u in zip(trees, ups) for i, st in enumerate(u.state) if st == 2]
    return spark.createDataFrame(rows, SUBTREE) if rows else None


# ------------------------------------------------------------ the model

@dataclass
class Forest:
    """A fitted forest: upper nodes here, subtrees (``SUBTREE``) in the shared folder."""
    features: list[str]
    bins: Bins
    plan: Plan
    trees: int
    batches: list            # (tree numbers, upper nodes, subtrees table)
    center: float
    scale: float
    rows: int

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the mean of the trees; rows are numbered in a written copy, so no key is needed.

        Rows of equal binned predictors are scored once.
        """
        d = snapshot(df.withColumn("_row", F.monotonically_increasing_id()))
        packed = snapshot(_pack(d, self.features, self.bins, F.col("_row"), F.lit(0)))
        kinds = snapshot(packed.select("x").distinct().select(F.monotonically_increasing_id().alias("h"), F.lit(0).cast("bigint").alias("y"), "x"))
        salts = max(1, math.ceil(kinds.count() / max(1, self.rows)))
        total = None
        for trees, ups, subtrees in self.batches:
            frozen = [u.frozen() for u in ups]
            rows = kinds.mapInArrow(_deal(trees, frozen, self.plan, False, salts), BLOB)
            part = (rows.groupBy("tree", "node", "salt").cogroup(_salted(subtrees, salts).groupBy("tree", "node", "salt"))
                    .applyInArrow(_score(self.plan.features), "rows array<bigint>, v array<double>"))
            part = part.select(F.explode(F.arrays_zip("rows", "v")).alias("z")).select(F.col("z.rows").alias("_row"), "z.v")
            if any(st == 2 for u in ups for st in u.state):
                part = part.unionByName(kinds.mapInArrow(_upper_values(frozen, [np.array(u.value) for u in ups], self.plan), "_row bigint, v double"))
            total = part if total is None else total.unionByName(part)
        mean = total.groupBy("_row").agg((F.sum("v") / F.lit(float(self.trees))).alias("_v"))
        mean = kinds.join(mean.withColumnRenamed("_row", "h"), "h").select("x", "_v")
        mean = packed.join(mean, "x").select(F.col("h").alias("_row"), "_v")
        value = F.lit(self.center) + F.col("_v") / F.lit(self.scale)
        return d.join(mean, "_row").withColumn(out, value).drop("_row", "_v")

    def partial_means(self, df: DataFrame, var: str, grid: list[float]) -> DataFrame:
        """Mean prediction ``(value, yhat)`` with ``var`` at each value of ``grid`` for every row.

        Rows whose other predictors are equal are one row with a count.  It goes once to every lower node that some
        value of the grid leads to; what comes back are sums per value, not predictions.
        """
        spark, f, n_all = df.sparkSession, self.features.index(var), df.count()
        values = sorted({float(v) for v in grid})
        if not n_all:
            return spark.createDataFrame([], "value double, yhat double")
        at = np.searchsorted(np.asarray(self.bins.cuts[var], float), values, side="left").tolist()
        codes, sums = sorted(set(at)), {}
        same = _pack(df.withColumn(var, F.lit(values[0])), self.features, self.bins, F.lit(0).cast("bigint"), F.lit(0))
        kinds = snapshot(same.groupBy("x").agg(F.count(F.lit(1)).alias("h")).select("h", F.lit(0).cast("bigint").alias("y"), "x"))
        salts = max(1, math.ceil(kinds.count() * len(codes) / max(1, self.rows)))
        for lo in range(0, len(codes), 64):
            some = codes[lo:lo + 64]
            for trees, ups, subtrees in self.batches:
                frozen, held = [u.frozen() for u in ups], [np.array(u.value) for u in ups]
                rows = kinds.mapInArrow(_deal_grid(trees, frozen, held, f, some, salts, False), BLOB)
                part = (rows.groupBy("tree", "node", "salt").cogroup(_salted(subtrees, salts).groupBy("tree", "node", "salt"))
                        .applyInArrow(_score_grid(self.plan.features, f, some), "j int, v double"))
                if any(st == 2 for u in ups for st in u.state):
                    part = part.unionByName(kinds.mapInArrow(_deal_grid(trees, frozen, held, f, some, salts, True), "j int, v double"))
                for r in part.groupBy("j").agg(F.sum("v").alias("v")).collect():
                    sums[some[r["j"]]] = sums.get(some[r["j"]], 0.0) + r["v"]
        rows = [(v, float(self.center + sums.get(c, 0.0) / self.trees / n_all / self.scale)) for v, c in zip(values, at)]
        return spark.createDataFrame(rows, "value double, yhat double")

    def importances(self, spark: SparkSession) -> DataFrame:
        """Mean drop of the residual sum of squares per tree and feature."""
        gains = self.gains()
        return spark.createDataFrame([(f, float(g)) for f, g in zip(self.features, gains)], "feature string, importance double")

    def gains(self) -> np.ndarray:
        return _tree_gains(self.batches, self.trees, len(self.features)).mean(0) / self.scale ** 2

    def size(self) -> int:
        """Number of nodes."""
        return sum(sum(st == 0 for u in ups for st in u.state) + (sub.agg(F.sum("nodes")).first()[0] or 0) for _, ups, sub in self.batches)

    def leaves(self) -> DataFrame:
        """Every leaf: ``tree, n, value``."""
        spark = self.batches[0][2].sparkSession

        def fn(batches):
            for b in batches:
                for k in range(b.num_rows):
                    f = np.frombuffer(b.column("feature")[k].as_py(), np.int16) < 0
                    n, v = (np.frombuffer(b.column(c)[k].as_py(), t)[f] for c, t in (("n", np.int64), ("value", np.float64)))
                    yield pa.RecordBatch.from_arrays([pa.array([b.column("tree")[k].as_py()] * len(n), pa.int32()), pa.array(n), pa.array(v)], ["tree", "n", "v"])

        parts = [sub.mapInArrow(fn, "tree int, n bigint, v double") for _, _, sub in self.batches]
        out = parts[0]
        for q in parts[1:]:
            out = out.unionByName(q)
        assert out.sparkSession is spark
        return out.select("tree", "n", (F.lit(self.center) + F.col("v") / F.lit(self.scale)).alias("value"))


def _salted(subtrees: DataFrame, salts: int) -> DataFrame:
    return subtrees.select("*", F.explode(F.array(*[F.lit(s) for s in range(salts)])).alias("salt"))


def _score(p: int):
    def fn(key, rows, tree):
        if not rows.num_rows or not tree.num_rows:
            return pa.table({"rows": pa.array([], pa.list_(pa.int64())), "v": pa.array([], pa.list_(pa.float64()))})
        x = np.ascontiguousarray(_joined(rows["x"], np.uint8).reshape(-1, p).T)
        feature, cut, left, value = _subtree(tree)
        at = walk(x, feature, cut, left)
        ids = _joined(rows["h"], np.int64)
        step = 10_000
        cuts = range(0, len(ids), step)
        return pa.table({"rows": pa.array([ids[k:k + step] for k in cuts], pa.list_(pa.int64())),
                         "v": pa.array([value[at[k:k + step]] for k in cuts], pa.list_(pa.float64()))})

    return fn


def fit_forest(df: DataFrame, y: str, features: list[str], key, trees: int = 100, mtry: int | None = None, min_node: int = 5,
               min_child: int = 1, sample_frac: float = 1.0, max_depth: int = 10_000, max_bins: int = 64, seed: int = 1,
               bootstrap: bool = True, bins: Bins | None = None, local_rows: int = LOCAL_ROWS) -> Forest:
    """A forest of ``trees`` trees on ``sample_frac`` draws per row; ``key`` (column or list) seeds the draws.

    A node of at most ``min_node`` drawn rows is a leaf; ``mtry`` features are tried at a node (all by default).
    """
    if max_bins > 256:
        raise ValueError("bins are bytes: at most 256")
    base, bins, center, scale, rows = _integer_table(df, y, features, key, max_bins, seed, bins, True)
    p = len(features)
    plan = Plan(p, _width(bins), min(p, mtry or p), min_node, min_child, max_depth, seed, sample_frac, bootstrap, widths=_widths(bins, features))
    few = local_rows >= LOCAL_ROWS and rows > local_rows and base.select("x").distinct().count() <= TASK_KINDS
    return Forest(features, bins, plan, trees, _grow(base, plan, trees, rows, local_rows, few), center, scale, rows)


def _width(bins: Bins) -> int:
    return max(2, max((len(c) + 1 for c in bins.cuts.values()), default=2))


def _widths(bins: Bins, features: list[str]) -> tuple:
    return tuple(len(bins.cuts[f]) + 1 for f in features)


def _integer_table(df: DataFrame, y: str, features: list[str], key, max_bins: int, seed: int, bins: Bins | None = None, together: bool = False):
    """The packed table (``together``: rows of equal bins side by side), its bins, the outcome's centre and units, and the number of rows."""
    bins = bins or make_bins(df, features, max_bins)
    d = df.filter(F.col(y).isNotNull())
    lo, hi, rows = d.agg(F.min(F.col(y).cast("double")), F.max(F.col(y).cast("double")), F.count(F.lit(1))).first()
    if not rows:
        raise ValueError("no row with an outcome")
    # a power of two per unit, so that sums over all rows fit 63 bits (53 where a task may hold all of them)
    bits = min(BITS, (52 if together else 62) - math.ceil(math.log2(rows + 1)))
    center, scale = (lo + hi) / 2, 2.0 ** math.floor(bits - 1 - math.log2(hi - lo)) if hi > lo else 1.0
    keys = [key] if isinstance(key, str) else list(key)
    h = F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])
    base = _pack(d, features, bins, h, F.round((F.col(y).cast("double") - F.lit(center)) * F.lit(scale)))
    if together:
        # by hash too, so that frequent bins do not fill one partition
        parts = max(math.ceil(rows / 1_000_000), min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / 20_000)))
        base = base.repartitionByRange(parts, "x", "h").sortWithinPartitions("x", "h")
    return snapshot(base), bins, center, scale, rows


def _grow(base: DataFrame, plan: Plan, trees: int, rows: int, local_rows: int, whole: bool = False) -> list:
    """All trees, a batch at a time: ``(tree numbers, upper nodes, written subtrees)``."""
    each = max(1, MAX_UPPER_NODES // max(1, math.ceil(4 * rows * plan.sample_frac / local_rows)))
    batches = []
    for first in range(0, trees, each):
        some = list(range(first, min(trees, first + each)))
        ups = _grow_upper(base, some, plan, rows, local_rows, whole)
        frozen = [u.frozen() for u in ups]
        grown = (base.mapInArrow(_deal(some, frozen, plan, True), BLOB).groupBy("tree", "node")
                 .applyInArrow(_grow_group(some, frozen, plan), SUBTREE))
        extra = _leaf_rows(base.sparkSession, some, ups, plan.features)
        batches.append((some, ups, snapshot(grown if extra is None else grown.unionByName(extra))))
    return batches


def _tree_gains(batches: list, trees: int, p: int) -> np.ndarray:
    """Drop of the residual sum of squares by tree and feature, in squared integer units (trees x features numbers)."""
    out = np.zeros((trees, p))
    for some, ups, subtrees in batches:
        for t, u in zip(some, ups):
            f = np.array(u.feature)
            out[t] += np.bincount(f[f >= 0], np.array(u.gain)[f >= 0], minlength=p)
        for r in subtrees.select("tree", F.posexplode("gains").alias("f", "g")).groupBy("tree", "f").agg(F.sum("g").alias("g")).collect():
            out[r["tree"], r["f"]] += r["g"]
    return out


def shadow_gains(df: DataFrame, y: str, features: list[str], key, rounds: int, trees: int = 30, mtry: int | None = None,
                 min_node: int = 5, max_bins: int = 64, seed: int = 1, local_rows: int = LOCAL_ROWS) -> np.ndarray:
    """Importances of real and shadow features by round: ``rounds x 2p``, each the sum over a forest of ``trees`` trees.

    A round's shadows are the features of the row that a permutation of all rows gives.  All rounds are
    one batch: a row sends its features to its ``rounds`` partners in one shuffle, and the trees of all
    rounds grow together.
    """
    base, bins, _, scale, rows = _integer_table(df, y, features, key, max_bins, seed)
    numbered = number_rows(base, ["h", "y", "x"])
    to = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), shuffled(rows, seed * 1009 + r, F.col("pos")).alias("to")) for r in range(rounds)]))
    sent = numbered.select("x", to.alias("m")).select(F.col("m.to").alias("pos"), "m.r", "x")
    got = sent.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("r", "x"))).alias("it"))
    copies = F.aggregate("it", F.lit(b""), lambda a, s: F.concat(a, s["x"]))
    wide = snapshot(numbered.join(got, "pos").select("h", "y", F.concat("x", copies).alias("x")))
    p = 2 * len(features)
    plan = Plan(p, _width(bins), min(p, mtry or max(1, p // 3)), min_node, 1, 10_000, seed, 1.0, True, trees, 2 * _widths(bins, features))
    batches = _grow(wide, plan, rounds * trees, rows, local_rows)
    return _tree_gains(batches, rounds * trees, p).reshape(rounds, trees, p).sum(1) / scale ** 2
