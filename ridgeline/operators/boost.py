"""Second-order boosting of many models at once (B7, B8, B10) with native categories.

Rows are binned once.  Rows of equal bins have the same margins in every model, so they are one entry: bins, number
of training rows, sum of their outcomes, the same of the validation rows, and, where models draw rows, hash and outcome of each.
Blocks of entries are written to the shared folder.  Without equal rows an entry is a row.

*Up to ``TASK_ROWS`` entries:* a task holds all of them and grows all trees of a model; models that differ in
a depth that no tree has reached yet are grown once.

*More entries:* each block also has the running margins of all models.  In a round every model grows one tree.  A node with more
than ``LOCAL_ROWS`` entries is counted by Spark: one pass sums the histograms of all such open nodes of
all models, best splits come back.  A smaller node's entries go to one task, which splits it
best-first, at most as often as its model has leaves.  The tree is then put together from
these splits, largest gain first, which is what growing leaf by leaf gives.  Both ways give the same trees.

Gradients are integers (``BITS`` bits of the outcome's range), so sums, splits and models are
the same on any partitioning.  The trees of up to ``WRITE_EVERY`` rounds are added to the margins while
reading; then the blocks are written anew and the version before is deleted.

A category is a bin.  At a node the categories are ordered by gradient per row and cut
like numbers, so a split is a set of categories (for squared loss the best of
all sets, as Fisher showed).  A NULL, or a category that was not seen, goes right.

Models that end early (``patience``) leave the round.  The driver holds the trees.
"""

from __future__ import annotations

import heapq
import math
import pickle
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .forest import GOLDEN, _mix
from .hist import BoostModel, HNode, HTree, _feature_draw, make_bins

LOCAL_ROWS = 200_000
TASK_ROWS = 2_000_000    # entries (and drawn rows) that a task holds to grow whole models
BLOCK_ROWS = 65_536
BLOCK_BYTES = 32_000_000  # margins of one block
BITS = 36                # gradients; their sums are taken exactly (``exact_parts``)
SHARED_DEPTH = 32        # models that differ in a depth from here on are grown once while no tree is that deep
WRITE_EVERY = 4
MAX_CELLS = 2_000_000   # histogram cells of one pass
MAX_LEVELS = 255
JOINT_BINS = 1024       # features are counted by joint bins, then summed by feature
SMALL_ROWS = 2048       # fewer rows are counted feature by feature at once


@dataclass(frozen=True)
class Spec:
    """One model.  ``num_leaves`` 0: as many as ``max_depth`` allows; ``max_depth`` below 1: any depth."""
    num_leaves: int = 31
    max_depth: int = -1
    eta: float = 0.1
    lam: float = 0.0
    gamma: float = 0.0
    min_child: float = 20.0       # rows (the hessian of squared loss) of a child at least
    subsample: float = 1.0
    colsample: float = 1.0
    cat_smooth: float = 10.0
    cat_l2: float = 10.0

    def splits(self) -> int:
        return self.num_leaves - 1 if self.num_leaves > 0 else 1 << 30

    def deepest(self) -> int:
        return self.max_depth if self.max_depth > 0 else 1 << 30


def bundled(sizes: list[int]) -> list[list[int]]:
    """Features whose bins are counted together: as many as have at most ``JOINT_BINS`` joint bins."""
    out, held = [], []
    for f, k in enumerate(sizes):
        for i, n in enumerate(held):
            if n * k <= JOINT_BINS:
                out[i].append(f)
                held[i] *= k
                break
        else:
            out.append([f])
            held.append(k)
    return out


class Coder:
    """Bins of the features: cuts of numbers, sorted levels of categories (one more bin for NULL and unseen ones)."""

    def __init__(self, features: list[str], cuts: dict, levels: dict):
        self.features, self.cuts, self.levels = list(features), cuts, levels
        self.width = max(2, *[len(cuts[f]) + 1 if f in cuts else len(levels[f]) + 1 for f in features])
        self.sizes = [len(cuts[f]) + 1 if f in cuts else len(levels[f]) + 1 for f in features]
        self.bundles = bundled(self.sizes)
        self.is_cat = np.array([f in levels for f in features])
        self.nulls = np.array([len(levels[f]) if f in levels else -1 for f in features])

    def code(self, i: int, v: np.ndarray) -> np.ndarray:
        f = self.features[i]
        if f in self.cuts:
            return np.searchsorted(np.asarray(self.cuts[f], float), v, side="left").astype(np.uint8)
        known = np.asarray(self.levels[f], float)
        at = np.minimum(np.searchsorted(known, v), len(known) - 1) if len(known) else np.zeros(len(v), int)
        return np.where((known[at] == v) if len(known) else np.zeros(len(v), bool), at, len(known)).astype(np.uint8)


def make_coder(df: DataFrame, features: list[str], max_bins: int, categorical=()) -> Coder:
    """Cut points of the numeric features and the levels of the categorical ones (numeric codes, at most ``MAX_LEVELS``)."""
    numeric = [f for f in features if f not in categorical]
    cuts = make_bins(df, numeric, max_bins).cuts if numeric else {}
    levels = {}
    for f in features:
        if f in categorical:
            got = [r[0] for r in df.select(F.col(f).cast("double")).where(F.col(f).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()]
            if len(got) > MAX_LEVELS:
                raise ValueError(f"{f} has more than {MAX_LEVELS} categories")
            levels[f] = sorted(got)
    return Coder(features, cuts, levels)


# ------------------------------------------------------------ splits

def best_splits(n: np.ndarray, s: np.ndarray, spec: Spec, unit: float, coder: Coder, cols: np.ndarray) -> list:
    """``(gain, feature, left bins, left count, left sum)``, or None, of each node's histograms in ``n``, ``s`` (nodes x features x bins).

    The feature named first wins ties, then the lower cut.
    """
    k, p, width = n.shape
    cat = np.flatnonzero(coder.is_cat)
    if len(cat):
        # the levels of a category by their rate; the bin of NULL and unseen ones, and empty bins, come last
        past = max(coder.sizes[f] for f in cat)
        nc, sc = n[:, cat, :past], s[:, cat, :past]
        with np.errstate(divide="ignore", invalid="ignore"):
            rate = np.where((nc > 0) & (np.arange(past) < coder.nulls[cat, None]), sc / unit / (nc + spec.cat_smooth), np.inf)
        order = rate.argsort(2, kind="stable")
        n, s = n.copy(), s.copy()
        at = np.arange(k)[:, None, None], np.arange(len(cat))[None, :, None], order
        n[:, cat, :past], s[:, cat, :past] = nc[at], sc[at]
    cn, cs = n.cumsum(2), s.cumsum(2)
    tn, ts = cn[:, :, -1:], cs[:, :, -1:]
    rn = tn - cn
    lam = (spec.lam + np.where(coder.is_cat, spec.cat_l2, 0.0))[:, None]
    least = max(1, spec.min_child)
    may = cols[:, None] & (~coder.is_cat[:, None] | (np.arange(width)[None, :] < coder.nulls[:, None]))
    gl, g = cs / unit, ts / unit
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 0.5 * (gl ** 2 / (cn + lam) + (g - gl) ** 2 / (rn + lam) - g ** 2 / (tn + lam)) - spec.gamma
    gain = np.where((cn >= least) & (rn >= least) & may, gain, -np.inf).reshape(k, -1)
    out = []
    for i, j in enumerate(gain.argmax(1).tolist()):
        if not gain[i, j] > 0:
            out.append(None)
            continue
        f, b = divmod(j, width)
        left = np.zeros(width, bool)
        if coder.is_cat[f]:
            left[order[i, np.searchsorted(cat, f), :b + 1]] = True
        else:
            left[:b + 1] = True
        out.append((float(gain[i, j]), f, left, int(cn[i, f, b]), int(cs[i, f, b])))
    return out


def best_split(n: np.ndarray, s: np.ndarray, spec: Spec, unit: float, coder: Coder, cols: np.ndarray):
    """``best_splits`` of one node."""
    return best_splits(n[None], s[None], spec, unit, coder, cols)[0]


def exact_parts(g: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """``g`` as doubles whose sums are exact: itself, or high and low digits ``(part, shift)`` where its sum could pass 53 bits."""
    if np.abs(g).sum(dtype=float) < 2.0 ** 53:
        return [(g.astype(float), 0)]
    return [((g >> 26).astype(float), 26), ((g & (1 << 26) - 1).astype(float), 0)]


def summed(at, parts: list, size: int) -> np.ndarray:
    """Integer sums of ``exact_parts`` per cell."""
    return sum(np.rint(np.bincount(at, w, size)).astype(np.int64) << k for w, k in parts)


def histograms(cells: np.ndarray, g, p: int, width: int, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and gradient sums per (feature, bin); ``cells`` is entries x features, ``n`` the rows of each entry (one by default)."""
    flat = cells.ravel()
    parts = [(np.repeat(w, p), k) for w, k in (g if isinstance(g, list) else exact_parts(g))]
    rows = np.bincount(flat, None if n is None else np.repeat(n, p), p * width)
    return np.rint(rows).astype(np.int64).reshape(p, width), summed(flat, parts, p * width).reshape(p, width)


def joint_codes(x: np.ndarray, coder: Coder) -> list[np.ndarray]:
    """Joint bin of every row in each bundle of features; ``x`` is (features, rows)."""
    out = []
    for fs in coder.bundles:
        c = x[fs[0]].astype(np.int32)
        for f in fs[1:]:
            c = c * np.int32(coder.sizes[f]) + x[f]
        out.append(c)
    return out


def joint_counts(code: np.ndarray, g, slot, k: int, bins: int, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and gradient sums per (slot, joint bin) of one bundle; ``slot`` None: all entries in slot 0; ``n`` as in ``histograms``."""
    at = code if slot is None else slot * bins + code
    return np.rint(np.bincount(at, n, k * bins)).astype(np.int64), summed(at, g if isinstance(g, list) else exact_parts(g), k * bins)


def by_feature(joint: list, k: int, coder: Coder) -> np.ndarray:
    """Sums (k, features, bins) of the sums per (slot, joint bin) of all bundles."""
    out = np.zeros((k, len(coder.features), coder.width), np.int64)
    for fs, v in zip(coder.bundles, joint):
        v = v.reshape(k, *[coder.sizes[f] for f in fs])
        for i, f in enumerate(fs):
            out[:, f, :coder.sizes[f]] = v.sum(tuple(j + 1 for j in range(len(fs)) if j != i))
    return out


def joint_bins(coder: Coder) -> list[int]:
    return [math.prod(coder.sizes[f] for f in fs) for fs in coder.bundles]


def grow_best_first(x: np.ndarray, g: np.ndarray, depth: int, spec: Spec, unit: float, coder: Coder, cols: np.ndarray,
                    n: np.ndarray | None = None, codes: list | None = None, ends: list | None = None) -> list:
    """Splits below a node in the order of their gains: ``[gain, feature, left bins, n, sum, left child, depth]`` per node.

    ``x`` is (features, entries), ``g`` the gradient sum and ``n`` the rows of each entry (one by default; none: it
    only goes along).  A node without a split has gain None; ``ends`` gets ``(node, its entries)``.
    The smaller child is counted, its sibling is the rest.
    """
    p, width = x.shape[0], coder.width
    n = np.ones(len(g)) if n is None else n.astype(float)
    parts = exact_parts(g)
    if codes is None and len(g) >= SMALL_ROWS:
        codes = joint_codes(x, coder)
    bins, offset = joint_bins(coder), np.arange(p, dtype=np.int32) * width
    nodes, held, heap = [], {}, []

    def count(rows):
        of, some = n.take(rows), [(w.take(rows), k) for w, k in parts]
        if len(rows) < SMALL_ROWS:
            return histograms(x[:, rows].T + offset, some, p, width, of)
        hn, hs = zip(*[joint_counts(c.take(rows), some, None, 1, b, of) for c, b in zip(codes, bins)])
        return by_feature(hn, 1, coder)[0], by_feature(hs, 1, coder)[0]

    def add(rows, d, kn, ks, hist=None, got=None):
        i = len(nodes)
        nodes.append([None, -1, None, kn, ks, -1, d])
        if got:
            held[i] = rows, hist, got
            heapq.heappush(heap, (-got[0], i))
        elif ends is not None:
            ends.append((i, rows))

    every = np.arange(len(g))
    kn, ks = int(n.sum()), int(g.sum())
    root = (count(every),) if depth < spec.deepest() and kn >= 2 * spec.min_child and spec.splits() else ()
    add(every, depth, kn, ks, *root, *[best_split(*h, spec, unit, coder, cols) for h in root])
    made = 0
    while heap:
        _, i = heapq.heappop(heap)
        rows, hist, (gain, f, left, nl, sl) = held.pop(i)
        go = left.take(x[f].take(rows))
        a, b = rows[go], rows[~go]
        nodes[i][:3], nodes[i][5] = [gain, f, np.packbits(left).tobytes()], len(nodes)
        made += 1
        d, sides = nodes[i][6] + 1, [(a, nl, sl), (b, nodes[i][3] - nl, nodes[i][4] - sl)]
        more = [made < spec.splits() and d < spec.deepest() and kn >= 2 * spec.min_child for _, kn, _ in sides]
        hists, found = [None, None], [None, None]
        if any(more):  # else the sums that the split names are all there is to know
            small = int(len(a) > len(b))
            hists[small] = count(sides[small][0])
            hists[1 - small] = hist[0] - hists[small][0], hist[1] - hists[small][1]
            which = [j for j in (0, 1) if more[j]]
            got = best_splits(*(np.stack([hists[j][c] for j in which]) for c in (0, 1)), spec, unit, coder, cols)
            for j, v in zip(which, got):
                found[j] = v
        for (part, kn, ks), h, v in zip(sides, hists, found):
            add(part, d, kn, ks, h, v)
        if made >= spec.splits():
            break
    if ends is not None:
        ends.extend((i, rows) for i, (rows, _, _) in held.items())
    return nodes


class Plant:
    """Candidate nodes of one tree: those counted by Spark and the lists that came from tasks."""

    def __init__(self, spec: Spec, nodes: list | None = None):
        self.spec = spec
        self.node = nodes or [[None, -1, None, -1, 0, -1, 0]]   # gain, feature, left bins (packed), n, sum, left child, depth
        self.state = ["done" if nodes else "open"] * len(self.node)   # open: to be counted; local: for a task; done

    def set_split(self, i: int, got, n: int, s: int, local_rows: int, entries: tuple = ()) -> None:
        """``entries``: those of the left and of the right child."""
        self.node[i][3:5] = [n, s]
        self.state[i] = "done"
        if got is None:
            return
        gain, f, left, nl, sl = got
        self.node[i][:3], self.node[i][5] = [gain, f, np.packbits(left).tobytes()], len(self.node)
        for kn, ks, held in ((nl, sl, entries[0]), (n - nl, s - sl, entries[1])):
            self.node.append([None, -1, None, kn, ks, -1, self.node[i][6] + 1])
            deep = self.node[-1][6] >= self.spec.deepest() or kn < 2 * self.spec.min_child
            self.state.append("done" if deep else "open" if held > local_rows else "local")

    def graft(self, i: int, nodes: list) -> None:
        """Put a task's list below node ``i``."""
        at = {0: i}
        for k, nd in enumerate(nodes):
            if k:
                at[k] = len(self.node)
                self.node.append(None)
                self.state.append("done")
        for k, nd in enumerate(nodes):
            self.node[at[k]] = [*nd[:5], at[nd[5]] if nd[5] >= 0 else -1, nd[6]]
        self.state[i] = "done"

    def wanted(self) -> list[int]:
        """Nodes that the largest gains known so far would reach, and that are not known themselves."""
        out, heap, made = [], [], 0

        def push(i):
            if self.state[i] != "done":
                out.append(i)
            elif self.node[i][0] is not None:
                heapq.heappush(heap, (-self.node[i][0], i))

        push(0)
        while heap and made < self.spec.splits():
            _, i = heapq.heappop(heap)
            made += 1
            push(self.node[i][5])
            push(self.node[i][5] + 1)
        return out

    def frozen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node arrays of the counted part: feature, left child, left bins."""
        width = max((len(nd[2]) for nd in self.node if nd[2]), default=1) * 8
        mask = np.zeros((len(self.node), width), bool)
        for i, nd in enumerate(self.node):
            if nd[2]:
                mask[i] = np.unpackbits(np.frombuffer(nd[2], np.uint8)).astype(bool)
        return np.array([nd[1] for nd in self.node]), np.array([nd[5] for nd in self.node]), mask

    def tree(self, unit: float, coder: Coder) -> HTree:
        """The tree of the largest gains; node numbers by the order of the splits."""
        lam = self.spec.lam
        t = HTree()

        def make(j, i):
            _, _, _, n, s, _, d = self.node[i]
            t.nodes[j] = HNode(j, d, -(s / unit) / (n + lam) if n + lam > 0 else 0.0, float(n))
            if self.node[i][0] is not None:
                heapq.heappush(heap, (-self.node[i][0], j, i))

        heap, made = [], 0
        make(1, 0)
        while heap and made < self.spec.splits():
            _, j, i = heapq.heappop(heap)
            gain, f, left, *_, kid, _ = self.node[i]
            nd, name = t.nodes[j], coder.features[f]
            bins = np.flatnonzero(np.unpackbits(np.frombuffer(left, np.uint8)))
            nd.feature, nd.gain = name, gain
            if coder.is_cat[f]:
                nd.stat["left"] = [coder.levels[name][b] for b in bins if b < len(coder.levels[name])]
            else:
                nd.cut = float(coder.cuts[name][bins.max()])
            nd.left, nd.right = len(t.nodes) + 1, len(t.nodes) + 2
            make(nd.left, kid)
            make(nd.right, kid + 1)
            made += 1
        return t


def arrays(trees: list[HTree], coder: Coder) -> list[tuple]:
    """Per tree: feature, left child, left bins, value (the right child follows the left one)."""
    out = []
    for t in trees:
        ids = sorted(t.nodes)
        feature, left, value = np.full(len(ids), -1), np.zeros(len(ids), int), np.zeros(len(ids))
        mask = np.zeros((len(ids), coder.width), bool)
        for k, i in enumerate(ids):
            nd = t.nodes[i]
            value[k] = nd.value
            if nd.is_leaf:
                continue
            f = feature[k] = coder.features.index(nd.feature)
            left[k] = nd.left - 1  # ids are 1, 2, ... without gaps
            if coder.is_cat[f]:
                mask[k, np.searchsorted(coder.levels[nd.feature], nd.stat["left"])] = True
            else:
                mask[k, :int(np.searchsorted(coder.cuts[nd.feature], nd.cut)) + 1] = True
        out.append((feature, left, mask, value))
    return out


def walk(x: np.ndarray, feature: np.ndarray, left: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Last node of every row: rows are parted node by node, or step level by level where they are few for the nodes."""
    at = np.zeros(x.shape[1], np.int64)
    if x.shape[1] < 32 * len(feature):
        live = np.flatnonzero(feature[at] >= 0)
        while len(live):
            i = at[live]
            at[live] = left[i] + ~mask[i, x[feature[i], live]]
            live = live[feature[at[live]] >= 0]
        return at
    todo = [(0, None)]
    while todo:
        i, rows = todo.pop()
        if feature[i] < 0:
            if i:
                at[rows] = i
            continue
        v = x[feature[i]]
        go = mask[i].take(v if rows is None else v.take(rows))
        kid = int(left[i])
        todo.append((kid, np.flatnonzero(go) if rows is None else rows[go]))
        np.logical_not(go, out=go)
        todo.append((kid + 1, np.flatnonzero(go) if rows is None else rows[go]))
    return at


BLOCK = "k int, x binary, n binary, s binary, vn binary, vs binary, vq binary, h binary, y binary, f binary"
SUMS = {"n": np.int64, "s": np.int64, "vn": np.int64, "vs": np.float64, "vq": np.float64}


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of the same width as a matrix."""
    if not width or not len(column):
        return np.zeros((len(column), width), np.uint8)
    lo = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], np.uint8)[lo:lo + len(column) * width].reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    """A matrix of bytes as one binary value per row."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _coded(df: DataFrame, y: str, key, coder: Coder, seed: int, valid, base: float, unit: float) -> DataFrame:
    """Rows with an outcome: bins ``x``, hash ``h``, in the validation part ``v``, outcome about ``base`` in units ``y`` and as it is ``d``."""
    names, kinds = ["x", "h", "v", "y", "d"], [pa.int64(), pa.int8(), pa.int64(), pa.float64()]

    def fold(batches):
        for b in batches:
            x = np.empty((b.num_rows, len(coder.features)), np.uint8)
            for i in range(x.shape[1]):
                x[:, i] = coder.code(i, b.column(4 + i).to_numpy(zero_copy_only=False).astype(float))
            yield pa.RecordBatch.from_arrays([_binary(x), *[b.column(i).cast(k) for i, k in enumerate(kinds)]], names)

    keys = [key] if isinstance(key, str) else list(key)
    d = F.col(y).cast("double") - F.lit(base)
    sel = df.where(F.col(y).isNotNull()).select(
        F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]).alias("h"), valid.cast("tinyint").alias("v"),
        F.rint(d * F.lit(unit)).cast("bigint").alias("y"), d.alias("d"),
        *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(coder.features)])
    return sel.mapInArrow(fold, "x binary, h bigint, v tinyint, y bigint, d double")


def _block(x: np.ndarray, sums: dict, h: np.ndarray, y: np.ndarray, bases: np.ndarray) -> pa.RecordBatch:
    """One block; ``x`` is (entries, features), ``h`` and ``y`` the training rows in the order of the entries."""
    held = [np.ascontiguousarray(x.T), *[sums[c].astype(t) for c, t in SUMS.items()], h, y, np.repeat(bases[:, None], len(x), 1)]
    return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in held]],
                                      [c.split()[0] for c in BLOCK.split(", ")])


def _block_rows(models: int) -> int:
    return max(1024, min(BLOCK_ROWS, BLOCK_BYTES // (8 * models)))


def _together(batches, size: int):
    """The batches' columns ``size`` rows at a time."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        while rows >= size:
            t = pa.Table.from_batches(held)
            yield t.slice(0, size).combine_chunks()
            held, rows = t.slice(size).to_batches(), rows - size
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _pack_entries(coded: DataFrame, p: int, parts: int, bases: np.ndarray, merge: bool = True) -> DataFrame:
    """Blocks of entries; no model draws rows, so that sums are all they need.  Without ``merge`` every row is an entry, where it is read."""
    v, none = F.col("v") == 1, np.zeros(0, np.int64)
    of = lambda c, when: F.coalesce(F.sum(F.when(when, c)) if merge else F.when(when, c), F.lit(0))
    one = F.lit(1).cast("bigint")
    sums = [of(one, ~v).alias("n"), of(F.col("y"), ~v).alias("s"), of(one, v).alias("vn"),
            of(F.col("d"), v).cast("double").alias("vs"), of(F.col("d") * F.col("d"), v).cast("double").alias("vq")]
    entries = coded.groupBy("x").agg(*sums).repartition(parts) if merge else coded.select("x", *sums)

    def fold(batches):
        for t in _together(batches, _block_rows(len(bases))):
            yield _block(_fixed(t["x"].combine_chunks(), p), {c: t[c].to_numpy() for c in SUMS}, none, none, bases)

    return entries.mapInArrow(fold, BLOCK)


def _pack_rows(coded: DataFrame, p: int, parts: int, bases: np.ndarray) -> DataFrame:
    """Blocks of entries with the hash and outcome of every training row; equal bins of a block are one entry."""

    def fold(batches):
        for t in _together(batches, _block_rows(len(bases))):
            x = _fixed(t["x"].combine_chunks(), p)
            first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(1)])
            v, y, d = t["v"].to_numpy().astype(bool), t["y"].to_numpy(), t["d"].to_numpy()
            of = lambda a: np.add.reduceat(a, first)
            sums = {"n": of((~v).astype(np.int64)), "s": of(np.where(v, 0, y)), "vn": of(v.astype(np.int64)),
                    "vs": of(np.where(v, d, 0.0)), "vq": of(np.where(v, d * d, 0.0))}
            yield _block(x[first], sums, t["h"].to_numpy()[~v], y[~v], bases)

    # by hash too, so that a frequent entry does not fill one partition
    return coded.repartitionByRange(parts, "x", "h").sortWithinPartitions("x", "h").mapInArrow(fold, BLOCK)


class Entries:
    """Entries of one block, or of many put together (``BLOCK`` without the margins)."""

    def __init__(self, p: int, blocks: pa.RecordBatch | pa.Table):
        get = lambda c, t: np.frombuffer(b"".join(blocks[c].to_pylist()), t)
        self.x = np.concatenate([np.frombuffer(v, np.uint8).reshape(p, k) for v, k in zip(blocks["x"].to_pylist(), blocks["k"].to_pylist())], 1)
        self.n, self.s, self.vn, self.vs, self.vq = (get(c, t) for c, t in SUMS.items())
        self.h, self.y = get("h", np.uint64), get("y", np.int64)
        self.held: dict = {}

    def drawn(self, seed: int, r: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Training rows of every entry that round ``r`` draws, and the sum of their outcomes."""
        if share >= 1.0:
            return self.n, self.s
        if (r, share) not in self.held:
            use = _drawn(self.h, seed, r, share)
            self.held = {k: v for k, v in self.held.items() if k[0] == r}
            ends = np.cumsum(self.n)
            self.held[r, share] = tuple(np.diff(np.r_[0, np.cumsum(a)][np.r_[0, ends]]) for a in (use.astype(np.int64), np.where(use, self.y, 0)))
        return self.held[r, share]

    def squares(self, d: np.ndarray) -> float:
        """Sum of squared errors of the validation rows for the margins ``d`` about the base."""
        return float((self.vn * d * d - 2.0 * d * self.vs + self.vq).sum())


class _Blocks:
    """Reads blocks with the pending trees added to the margins (picklable, for tasks)."""

    def __init__(self, p: int, models: int, etas: list[float], pending: list, base: float, unit: float):
        self.p, self.models, self.etas, self.pending = p, models, etas, pending  # pending[m]: tree arrays
        self.base, self.unit = base, unit

    def rows(self, batches):
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                yield one, Entries(self.p, one), np.frombuffer(one["f"][0].as_py(), float).reshape(self.models, -1)

    def margins(self, m: int, x: np.ndarray, f: np.ndarray):
        """Margins after each of the pending trees."""
        out = f[m]
        for feature, left, mask, value in self.pending[m]:
            out = out + self.etas[m] * value[walk(x, feature, left, mask)]
            yield out

    def margin(self, m: int, x: np.ndarray, f: np.ndarray) -> np.ndarray:
        out = f[m]
        for out in self.margins(m, x, f):
            pass
        return out

    def gradient(self, f: np.ndarray, n: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Gradient sums in units for the margins ``f``, ``n`` rows each and their outcomes' sums ``s``."""
        return n * np.rint((f - self.base) * self.unit).astype(np.int64) - s


def _spread(spark, n: int) -> list[int]:
    """``n`` numbers that ``repartition(n)`` deals to as many partitions, in their order."""
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    found = spark.range(0, 40 * n + 40, 1, 1).groupBy(at.alias("p")).agg(F.min("id").alias("id")).collect() if n > 1 else []
    held = {r["p"]: r["id"] for r in found}
    return [held[k] for k in range(n)] if len(held) == n else list(range(n))


def _drawn(h: np.ndarray, seed: int, r: int, share: float) -> np.ndarray:
    if share >= 1.0:
        return np.ones(len(h), bool)
    u = (_mix(h + np.array([seed * 1_000_003 + r + 1], np.uint64) * GOLDEN) >> np.uint64(11)).astype(float) * 2.0 ** -53
    return u < share


class GridBoost:
    """Boosting of the models ``specs`` on one table."""

    def __init__(self, df: DataFrame, y: str, features: list[str], key, specs: list[Spec], seed: int = 1, max_bins: int = 64,
                 valid_col: str | None = None, categorical=(), local_rows: int = LOCAL_ROWS, coder: Coder | None = None, merge: bool = True):
        self.spark, self.specs, self.seed, self.local_rows = df.sparkSession, specs, seed, local_rows
        self.task_rows = TASK_ROWS if local_rows >= LOCAL_ROWS else local_rows
        self.valid = valid_col is not None
        self.coder = coder or make_coder(df, features, max_bins, categorical)
        valid = F.coalesce(F.col(valid_col).cast("boolean"), F.lit(False)) if valid_col else F.lit(False)
        yd = F.col(y).cast("double")
        r = df.where(F.col(y).isNotNull()).agg(F.avg(F.when(~valid, yd)).alias("m"), F.min(yd).alias("lo"), F.max(yd).alias("hi"),
                                                 F.count(F.lit(1)).alias("n"), F.var_pop(yd).alias("var")).first()
        if r["m"] is None:
            raise ValueError("no training row with an outcome")
        self.base, self.rows, self.dev = float(r["m"]), r["n"], r["n"] * float(r["var"])
        bits = min(BITS, 62 - math.ceil(math.log2(r["n"] + 1)))  # sums over all rows fit 63 bits
        self.unit = 2.0 ** math.floor(bits - 2 - math.log2(r["hi"] - r["lo"])) if r["hi"] > r["lo"] else 1.0
        self.path = scratch_path(self.spark, "blocks")
        coded = _coded(df, y, key, self.coder, seed, valid, self.base, self.unit)
        parts = max(math.ceil(self.rows / 1_000_000), min(self.spark.sparkContext.defaultParallelism, math.ceil(self.rows / 20_000)))
        self.draws = any(s.subsample < 1.0 for s in specs)
        shape = coded, len(self.coder.features), parts, np.full(len(specs), self.base)
        (_pack_rows(*shape) if self.draws else _pack_entries(*shape, merge)).write.parquet(self.path)
        self.entries = self._table().agg(F.sum("k")).first()[0] if merge or self.draws else self.rows
        self.pending: list[list] = [[] for _ in specs]
        self.live = list(range(len(specs)))
        self.grown: dict = {}   # model: (trees, errors) of tasks that grew it whole
        self.since: list[int] = []  # rounds since the last errors

    def _table(self) -> DataFrame:
        return self.spark.read.schema(BLOCK).parquet(self.path)

    def _reader(self) -> _Blocks:
        return _Blocks(len(self.coder.features), len(self.specs), [s.eta for s in self.specs], self.pending, self.base, self.unit)

    def _columns(self, r: int, share: float) -> np.ndarray:
        out = np.array([share >= 1.0 or _feature_draw(self.seed, r, f) < share for f in self.coder.features])
        if not out.any():
            out[0] = True
        return out

    def _count(self, r: int, plants: dict[int, Plant], todo: list[tuple[int, int]]) -> None:
        """Best splits of the nodes ``todo`` from summed histograms, one pass for as many as ``MAX_CELLS`` allows."""
        coder, unit, seed, specs, reader = self.coder, self.unit, self.seed, self.specs, self._reader()
        p, width = len(coder.features), coder.width
        step = max(1, MAX_CELLS // max(p * width, sum(joint_bins(coder))))
        todo = sorted(todo)
        for lo in range(0, len(todo), step):
            some = todo[lo:lo + step]
            slot = {mi: k for k, mi in enumerate(some)}
            frozen = {m: plants[m].frozen() for m, _ in some}

            place, first = {}, {}
            for m, (feature, _, _) in frozen.items():
                place[m] = np.full(len(feature), -1)
                mine = [(i, k) for (q, i), k in slot.items() if q == m]  # consecutive slots
                place[m][[i for i, _ in mine]] = np.arange(len(mine))
                first[m] = mine[0][1], len(mine)

            def fold(batches):
                bins = joint_bins(coder)
                n, s, e = ([np.zeros((len(some), b), np.int64) for b in bins] for _ in range(3))
                for _, block, f in reader.rows(batches):
                    codes = joint_codes(block.x, coder)
                    for m, (feature, left, mask) in frozen.items():
                        hn, hs = block.drawn(seed, r, specs[m].subsample)
                        to = place[m][walk(block.x, feature, left, mask)]
                        rows = np.flatnonzero((to >= 0) & (hn > 0))
                        if not len(rows):
                            continue
                        every = slice(None) if len(rows) == len(hn) else rows
                        g = exact_parts(reader.gradient(reader.margin(m, block.x[:, every], f[:, every]), hn[every], hs[every]))
                        w = hn[every].astype(float)
                        k0, k = first[m]
                        for j, (code, b) in enumerate(zip(codes, bins)):
                            at = to[every] * b + code[every] if k > 1 else code[every]
                            for out, v in zip((n, s, e), (*joint_counts(at, g, None, 1, k * b, w), np.bincount(at, minlength=k * b))):
                                out[j][k0:k0 + k] += v.reshape(k, b)
                n, s, e = (by_feature(v, len(some), coder) for v in (n, s, e))
                hit = np.flatnonzero(n.any((1, 2)))
                for k in range(0, len(hit), 64):
                    part = hit[k:k + 64]
                    yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array([v[q].tobytes() for q in part], pa.binary()) for v in (n, s, e)]],
                                                     ["slot", "n", "s", "e"])

            cols = {m: self._columns(r, specs[m].colsample) for m in frozen}

            def choose(key, table):
                m, _ = some[key[0].as_py()]
                n, s, e = (sum(np.frombuffer(v, np.int64).reshape(p, width) for v in table[c].to_pylist()) for c in ("n", "s", "e"))
                got, sides = best_split(n, s, specs[m], unit, coder, cols[m]), ()
                if got:
                    sides = int(e[got[1], got[2]].sum()), int(e[got[1], ~got[2]].sum())
                return pa.table({"slot": [key[0].as_py()], "split": pa.array([pickle.dumps((got, int(n[0].sum()), int(s[0].sum()), sides))], pa.binary())})

            found = (self._table().mapInArrow(fold, "slot bigint, n binary, s binary, e binary").groupBy("slot")
                     .applyInArrow(choose, "slot bigint, split binary").collect())
            done = {row["slot"]: pickle.loads(row["split"]) for row in found}
            for (m, i), k in slot.items():
                got, n, s, sides = done.get(k, (None, 0, 0, ()))
                plants[m].set_split(i, got, n, s, self.local_rows, sides)

    def _grow_in_tasks(self, r: int, plants: dict[int, Plant], todo: list[tuple[int, int]]) -> None:
        """Split lists of the nodes ``todo``, each from its rows in one task."""
        coder, unit, seed, specs, reader = self.coder, self.unit, self.seed, self.specs, self._reader()
        p = len(coder.features)
        frozen = {m: plants[m].frozen() for m, _ in todo}
        want, wanted = set(todo), {m: np.zeros(len(fr[0]), bool) for m, fr in frozen.items()}
        for m, i in todo:
            wanted[m][i] = True
        depth = {(m, i): plants[m].node[i][6] for m, i in todo}
        cols = {m: self._columns(r, specs[m].colsample) for m in frozen}

        def deal(batches):
            for _, block, f in reader.rows(batches):
                out, x = [], block.x
                xt = np.ascontiguousarray(x.T)
                for m, (feature, left, mask) in frozen.items():
                    hn, hs = block.drawn(seed, r, specs[m].subsample)
                    at = walk(x, feature, left, mask)
                    use = np.flatnonzero(wanted[m][at] & (hn > 0))
                    if not len(use):
                        continue
                    at = at[use]
                    order = np.argsort(at, kind="stable")
                    use, at = use[order], at[order]
                    g = reader.gradient(reader.margin(m, x[:, use], f[:, use]), hn[use], hs[use])
                    nodes, cut = np.unique(at, return_index=True)
                    for i, lo, hi in zip(nodes.tolist(), cut.tolist(), [*cut[1:].tolist(), len(at)]):
                        out.append((m, i, g[lo:hi].tobytes(), hn[use[lo:hi]].tobytes(), xt[use[lo:hi]].tobytes()))
                for k in range(0, len(out), 16):
                    cols_ = list(zip(*out[k:k + 16]))
                    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols_, kinds)], ["m", "i", "g", "n", "x"])

        def grow(key, table):
            m, i = key[0].as_py(), key[1].as_py()
            g, n = (np.frombuffer(b"".join(table[c].to_pylist()), np.int64) for c in ("g", "n"))
            x = np.ascontiguousarray(np.frombuffer(b"".join(table["x"].to_pylist()), np.uint8).reshape(-1, p).T)
            nodes = grow_best_first(x, g, depth[m, i], specs[m], unit, coder, cols[m], n)
            return pa.table({"m": pa.array([m], pa.int32()), "i": pa.array([i], pa.int32()), "nodes": pa.array([pickle.dumps(nodes)], pa.binary())})

        rows = (self._table().mapInArrow(deal, "m int, i int, g binary, n binary, x binary").groupBy("m", "i")
                .applyInArrow(grow, "m int, i int, nodes binary").collect())
        for row in rows:
            plants[row["m"]].graft(row["i"], pickle.loads(row["nodes"]))
        for m, i in want - {(row["m"], row["i"]) for row in rows}:  # no row was drawn
            plants[m].set_split(i, None, 0, 0, self.local_rows)

    def _round(self, r: int) -> dict[int, HTree]:
        plants = {m: Plant(self.specs[m]) for m in self.live}
        for q in plants.values():
            q.state[0] = "open" if self.entries > self.local_rows else "local"
        while True:
            wanted = [(m, i) for m, q in plants.items() for i in q.wanted()]
            upper = [(m, i) for m, i in wanted if plants[m].state[i] == "open"]
            if upper:
                self._count(r, plants, upper)
            elif wanted:
                self._grow_in_tasks(r, plants, wanted)
            else:
                return {m: q.tree(self.unit, self.coder) for m, q in plants.items()}

    def grow_tree(self) -> HTree:
        """One tree of the first model on the outcome itself (no boosting)."""
        return self._round(0)[0]

    def _write(self) -> None:
        """The blocks with the pending trees in their margins, in place of the version before."""
        reader = self._reader()

        def add(batches):
            for row, block, f in reader.rows(batches):
                new = np.stack([reader.margin(m, block.x, f) for m in range(reader.models)])
                yield pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([new.tobytes()], pa.binary())], row.schema.names)

        path, old = scratch_path(self.spark, "blocks"), self.path
        self._table().mapInArrow(add, BLOCK).write.parquet(path)
        self.path, self.pending = path, [[] for _ in self.specs]
        gone = self.spark._jvm.org.apache.hadoop.fs.Path(old)
        gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)

    def _errors(self) -> list[dict[int, float]]:
        """Root mean squared error of the live models on the validation rows, after every round since the last errors."""
        if self.grown:
            return [{m: errors[r] for m, (_, errors) in self.grown.items() if r < len(errors)} for r in self.since]
        reader, live, base = self._reader(), list(self.live), self.base
        stages = len(self.pending[live[0]])  # the live models have grown the same rounds

        def fold(batches):
            sse, k = np.zeros((stages, len(live))), 0
            for _, block, f in reader.rows(batches):
                k += int(block.vn.sum())
                for j, m in enumerate(live):
                    for e, margin in enumerate(reader.margins(m, block.x, f)):
                        sse[e, j] += block.squares(margin - base)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(stages, dtype=np.int32), len(live))), pa.array(live * stages, pa.int32()),
                                              pa.array(sse.ravel()), pa.array([k] * sse.size, pa.int64())], ["e", "m", "sse", "k"])

        got = (self._table().mapInArrow(fold, "e int, m int, sse double, k bigint").groupBy("e", "m")
               .agg(F.sum("sse").alias("s"), F.sum("k").alias("k")).collect())
        out: list[dict[int, float]] = [{} for _ in range(stages)]
        for r in got:
            out[r["e"]][r["m"]] = math.sqrt(max(r["s"], 0.0) / r["k"]) if r["k"] else math.nan
        return out

    def _whole_models(self, rounds: int, patience: int | None, trees: bool) -> dict:
        """``model: (splits of its trees, errors)``, each grown by one task from all entries.

        Models that differ in a depth alone are one model until a tree reaches it.
        """
        coder, unit, seed, specs, base, valid = self.coder, self.unit, self.seed, self.specs, self.base, self.valid
        p, reader, columns = len(coder.features), self._reader(), self._columns
        shares = {s.colsample for s in specs}
        cols = {(r, c): columns(r, c) for r in range(rounds) for c in shares}
        families: dict = {}
        for m, s in enumerate(specs):
            families.setdefault(replace(s, max_depth=min(s.deepest(), SHARED_DEPTH)), []).append(m)
        # the longest work first
        order = sorted(families.values(), key=lambda ms: -min(specs[ms[0]].splits(), 2.0 ** min(specs[ms[0]].deepest(), 60)))
        team = dict(zip(_spread(self.spark, len(order)), order))

        def grow(key, table):
            e, members = Entries(p, table), team[key[0].as_py()]
            codes = joint_codes(e.x, coder)
            same = [(members, np.full(e.x.shape[1], base))]  # models of the same trees so far, and their margins
            kept, errors = {m: [] for m in members}, {m: [] for m in members}
            best, total = {m: (math.inf, 0) for m in members}, int(e.vn.sum())
            for r in range(rounds):
                after = []
                for ms, f in same:
                    while ms:
                        spec = specs[max(ms, key=lambda m: specs[m].deepest())]
                        n, s = e.drawn(seed, r, spec.subsample)
                        ends: list = []
                        nodes = grow_best_first(e.x, reader.gradient(f, n, s), 0, spec, unit, coder, cols[r, spec.colsample], n, codes, ends)
                        deep = max(nd[6] for nd in nodes)
                        to = f.copy()
                        for i, rows in ends:
                            kn, ks = nodes[i][3:5]
                            to[rows] += spec.eta * (-(ks / unit) / (kn + spec.lam) if kn + spec.lam > 0 else 0.0)
                        alike = [m for m in ms if specs[m].deepest() >= deep]
                        ms = [m for m in ms if specs[m].deepest() < deep]
                        error = math.sqrt(max(e.squares(to - base), 0.0) / total) if total else math.nan
                        for m in alike:
                            if trees:
                                kept[m].append(nodes)
                            errors[m].append(error)
                            if error < best[m][0] - 1e-12:
                                best[m] = error, r + 1
                        go = [m for m in alike if not valid or patience is None or r + 1 - best[m][1] < patience]
                        if go:
                            after.append((go, to))
                same = after
            return pa.table({"m": pa.array(members, pa.int32()), "trees": pa.array([pickle.dumps(kept[m]) for m in members], pa.binary()),
                             "errors": pa.array([errors[m] for m in members], pa.list_(pa.float64()))})

        table = self._table().drop("f").withColumn("team", F.explode(F.array(*[F.lit(k) for k in team])))
        got = table.repartition(len(team), "team").groupBy("team").applyInArrow(grow, "m int, trees binary, errors array<double>").collect()
        return {r["m"]: (pickle.loads(r["trees"]), r["errors"]) for r in got}

    def fit(self, rounds: int, patience: int | None = None, models: bool = True) -> list[tuple[BoostModel | None, list[float], int]]:
        """``(model, validation curve, best round)`` per model; trees after the best round go where ``patience`` is set.

        Without ``models`` the trees are let go where they grew.
        """
        k = len(self.specs)
        trees, curves, best = [[] for _ in range(k)], [[] for _ in range(k)], [(math.inf, 0)] * k
        if max(self.entries, self.rows if self.draws else 0) <= self.task_rows:
            self.grown = self._whole_models(rounds, patience, models)
        self.since = []
        for r in range(rounds):
            self.since.append(r)
            if self.grown:
                for m in self.live if models else []:
                    trees[m].extend(Plant(self.specs[m], t).tree(self.unit, self.coder) for t in self.grown[m][0][r:r + 1])
            else:
                grown = self._round(r)
                for (m, t), a in zip(grown.items(), arrays(list(grown.values()), self.coder)):
                    if models:
                        trees[m].append(t)
                    self.pending[m].append(a)
            full = len(self.since) >= WRITE_EVERY
            if self.valid and (full or r + 1 == rounds):
                # one pass for the rounds since the last one; what a model grew after its end goes
                for errors in self._errors():
                    for m in list(self.live):
                        curves[m].append(errors[m])
                        if errors[m] < best[m][0] - 1e-12:
                            best[m] = errors[m], len(curves[m])
                        elif patience is not None and len(curves[m]) - best[m][1] >= patience:
                            self.live.remove(m)
                if not self.live:
                    break
            if full:
                self.since = []
                if r + 1 < rounds and not self.grown:
                    self._write()
        out = []
        for m in range(k):
            keep = trees[m][:best[m][1]] if self.valid and patience is not None else trees[m]
            out.append((SetBoost(self.base, keep, self.specs[m].eta, self.coder) if models else None, curves[m], best[m][1]))
        return out


class SetBoost(BoostModel):
    """A boosted model whose splits may be sets of categories."""

    def __init__(self, base: float, trees: list, eta: float, coder: Coder):
        super().__init__(base, trees, eta)
        self.coder = coder

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        coder, base, eta = self.coder, self.base, self.eta
        flat = arrays(self.trees, coder)

        @F.pandas_udf("double")
        def score(*cols: pd.Series) -> pd.Series:
            x = np.stack([coder.code(i, c.to_numpy(dtype=float)) for i, c in enumerate(cols)])
            f = np.full(x.shape[1], base)
            for feature, left, mask, value in flat:
                f = f + eta * value[walk(x, feature, left, mask)]
            return pd.Series(f)

        return df.withColumn(out, score(*[F.col(f).cast("double") for f in coder.features]))
