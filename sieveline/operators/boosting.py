"""Second-order boosted trees from gradient histograms, many models in the same passes.

Rows are binned once and staged. Each level of a tree is one aggregate over them: gradient and hessian sums
per model, node, feature and bin. Sums are integers in fixed point, so a model doesn't depend on the
partitioning, on the order of partial results or on retried tasks. Models that are fitted together (folds,
presets, settings of a search) share every pass. The histograms of a node meet in one task, which finds its
best split; the driver gets one row per open node and holds the trees. A table of one block needs no passes:
tasks that hold it whole grow the same trees, a model after the other.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.settings import BoostParams
from sieveline.sources.staging import spread, stage, unstage

#: Bins per feature; a feature of fewer different values has one for each.
MAX_BINS = 256
#: Gradients and hessians are rounded to multiples of 1 / UNIT and summed exactly.
UNIT = float(2**24)
#: Trees after which the margins are staged anew; the trees since then are applied in passing.
STAGE_TREES = 10
#: Models fitted in the same passes; each costs 8 bytes a row and its share of the histograms.
AT_ONCE = 128
#: Bytes of partial histograms that one task of a pass merges.
MERGE_BYTES = 4_000_000
#: Sparse cells a task holds before it merges them.
HELD_CELLS = 4_000_000
#: Rows times models that are worth a task of their own in a pass.
TASK_ROWS = 20_000
#: Rows and margins of a block that a task works on at once; a table of no more rows is fitted without passes.
BLOCK_ROWS, BLOCK_MARGINS = 2**17, 2**22
#: Trees whose masks are kept together, and rows they are looked up for at once.
MASKED, MASKED_ROWS = 100, 256
#: Gain below which a split is rounding.
LEAST_GAIN = 1e-6
TRAIN, VALIDATE = 1, 2


@dataclass(frozen=True)
class Tree:
    """Nodes in order of creation; ``feature`` is -1 at a leaf. G and H are sums over the sampled rows."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gradient: np.ndarray
    hessian: np.ndarray
    gain: np.ndarray

    @cached_property
    def steps(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Feature of every node, its right and left child, and the depth; a leaf is its own child."""
        inner, here = self.feature >= 0, np.arange(len(self.feature))
        child = np.stack([np.where(inner, self.right, here), np.where(inner, self.left, here)], axis=1)
        depth = np.zeros(len(inner), dtype=int)
        # Children come after their parent, so depths follow in order.
        for n in np.flatnonzero(inner):
            depth[child[n]] = depth[n] + 1
        return np.maximum(self.feature, 0), child.ravel(), int(depth.max())

    def leaf_of(self, x: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The leaf of every row of x, going left where x is ``cut`` of the node or less."""
        feature, child, depth = self.steps
        at = np.zeros(len(x), dtype=np.int64)
        flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        for _ in range(depth):
            at = child.take(2 * at + (flat.take(first + feature.take(at)) <= cut.take(at)))
        return at


@dataclass(frozen=True)
class Masks:
    """Trees of 64 leaves or fewer: per feature the cuts and, for every number of cuts below a value, the leaves still open.

    Bits are leaves from left to right. A value above a node's cut closes the leaves on its left; of the
    leaves that no feature closes the leftmost is the row's.
    """

    cuts: tuple[np.ndarray, ...]
    open: tuple[np.ndarray, ...]
    value: np.ndarray

    def added(self, margin: np.ndarray, x: np.ndarray) -> np.ndarray:
        """``margin`` plus the leaf values of the rows of x, one tree after the other."""
        trees, kind = len(self.value), self.open[0].dtype
        left, part = np.full((len(x), trees), ~kind.type(0)), np.empty((len(x), trees), dtype=kind)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.open)):
            if len(cuts):
                left &= table.take(np.searchsorted(cuts, x[:, j], side="left"), axis=0, out=part, mode="clip")
        first = left & (~left + kind.type(1))
        # A power of two, so the exponent is its place.
        leaf = (first.astype(float).view(np.int64) >> 52) - 1023
        values = np.empty((len(x), trees + 1))
        values[:, 0] = margin
        values[:, 1:] = self.value.take(leaf + 64 * np.arange(trees))
        return np.cumsum(values, axis=1)[:, -1]


def leaf_masks(trees: Sequence[Tree], d: int) -> Masks:
    value = np.zeros((len(trees), 64))
    closed: list[list[tuple[float, int, int]]] = [[] for _ in range(d)]
    for t, tree in enumerate(trees):
        leaves = 0

        def number(n: int) -> None:
            nonlocal leaves
            if tree.feature[n] < 0:
                value[t, leaves] = tree.value[n]
                leaves += 1
                return
            before = leaves
            number(int(tree.left[n]))
            closed[tree.feature[n]].append((float(tree.threshold[n]), t, 2**leaves - 2**before))
            number(int(tree.right[n]))

        number(0)
    cuts = tuple(np.unique(np.array([c for c, _, _ in nodes], dtype=float)) for nodes in closed)
    small = all((t.feature < 0).sum() <= 32 for t in trees)
    kind, full = (np.uint32, 2**32 - 1) if small else (np.uint64, 2**64 - 1)
    opened = []
    for j, nodes in enumerate(closed):
        table = np.full((len(cuts[j]) + 1, len(trees)), full, dtype=kind)
        for cut, t, mask in nodes:
            table[np.searchsorted(cuts[j], cut) + 1 :, t] &= kind(full - mask)
        opened.append(table)
    return Masks(cuts, tuple(opened), value)


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted model. ``losses`` has the training and validation loss before the first tree and after each."""

    features: tuple[str, ...]
    params: BoostParams
    trees: tuple[Tree, ...]
    losses: tuple[tuple[float, float | None], ...] = ()
    best_round: int | None = None

    @cached_property
    def masks(self) -> list[Masks] | None:
        """The trees in masks, where none has more leaves than a mask has bits."""
        if any((t.feature < 0).sum() > 64 for t in self.trees):
            return None
        return [leaf_masks(self.trees[at : at + MASKED], len(self.features)) for at in range(0, len(self.trees), MASKED)]

    def __getstate__(self) -> dict:
        """Masks are made where rows are scored; they aren't sent there."""
        return {n: v for n, v in self.__dict__.items() if n != "masks"}

    def margins(self, x: np.ndarray) -> np.ndarray:
        if self.masks is None:
            return sum((t.value[t.leaf_of(x, t.threshold)] for t in self.trees), np.zeros(len(x)))
        out = np.zeros(len(x))
        for made in self.masks:
            for at in range(0, len(x), MASKED_ROWS):
                out[at : at + MASKED_ROWS] = made.added(out[at : at + MASKED_ROWS], x[at : at + MASKED_ROWS])
        return out

    def importances(self) -> np.ndarray:
        """Mean gain of a feature's splits, as shares of the sum."""
        total, n = np.zeros(len(self.features)), np.zeros(len(self.features))
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(total, t.feature[inner], t.gain[inner])
            np.add.at(n, t.feature[inner], 1)
        mean = np.divide(total, n, out=np.zeros_like(total), where=n > 0)
        return mean / (mean.sum() or 1.0)


@dataclass(frozen=True)
class Fit:
    """Settings and the rows they are fitted to: SQL conditions on the training rows."""

    params: BoostParams
    where: str = "true"
    validate: str | None = None
    patience: int | None = None


# --- bins --------------------------------------------------------------------------


def cut_points(rows: DataFrame, features: Sequence[str], bins: int = MAX_BINS) -> list[np.ndarray]:
    """Ascending values per feature; a row's bin is the number of them below its value.

    A feature with few different values is cut at each of them, another one at
    its quantiles. Values come from the table, so splits name values that occur.
    """
    # Sketches keep few values as they are, so the count is exact where it decides.
    number = lambda f: F.when(F.col(f).isNotNull(), F.xxhash64(F.col(f).cast("double")))
    few = rows.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(number(f))).alias(f) for f in features]).first()
    short = [f for f in features if few[f] <= bins * 0.9]
    shares = [i / bins for i in range(1, bins)] + [1.0]
    wanted = [
        (F.array_sort(F.collect_set(F.col(f).cast("double"))) if f in short else F.percentile_approx(F.col(f).cast("double"), shares, 40 * bins)).alias(f)
        for f in features
    ]
    got = rows.agg(*wanted).first()
    # The largest value separates nothing.
    return [np.unique(np.array(got[f] or [0.0], dtype=float))[:-1] for f in features]


def binned(rows: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray], roles: Sequence[Column], key: str, label: str) -> DataFrame:
    """(key, label, salt, roles, bins): two bytes per feature, one per role."""
    narrow = spread(rows).select(
        key,
        F.col(label).cast("double").alias("label"),
        F.xxhash64(F.col(key).cast("string")).alias("salt"),
        F.array(*roles).alias("roles"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
    )
    kind = dict(narrow.dtypes)[key]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            at = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
            r = b.column("roles").flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(b.num_rows, -1)
            cells = [pa.array([row.tobytes() for row in m], pa.binary()) for m in (r, at.astype("<u2"))]
            yield pa.record_batch([b.column(key), b.column("label"), b.column("salt"), *cells], [key, "label", "salt", "roles", "bins"])

    return narrow.mapInArrow(pack, f"{key} {kind}, label double, salt long, roles binary, bins binary")


# --- one pass ----------------------------------------------------------------------


@dataclass
class _Growing:
    """A tree being grown and the trees its model got since margins were staged."""

    fit: Fit
    role: int
    columns: np.ndarray
    round: int
    recent: list[Tree] = field(default_factory=list)
    nodes: list[list] = field(default_factory=list)  # feature, bin, left, right, g, h, gain
    open: list[int] = field(default_factory=list)

    def so_far(self) -> Tree:
        part = [np.array(c) for c in zip(*[(n[0], n[1], n[2], n[3]) for n in self.nodes])]
        none = np.zeros(0)
        return Tree(part[0], part[1], none, part[2], part[3], none, none, none, none)


def _fixed(values: np.ndarray) -> np.ndarray:
    return np.rint(values * UNIT)


def _sampled(salt: np.ndarray, params: BoostParams, at: int) -> np.ndarray:
    """Rows drawn for a tree, by a hash of their key."""
    seed = (params.seed * 0x9E3779B97F4A7C15 + (at + 1) * 0xD1B54A32D192ED03) % 2**64
    z = (salt.astype(np.uint64) ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(29))) < np.uint64(min(params.row_sample, 1.0) * (2**64 - 1))


def _columns(params: BoostParams, at: int, d: int) -> np.ndarray:
    """The features a tree may use."""
    n = max(1, int(params.column_sample * d))
    return np.sort(np.random.default_rng([params.seed, at]).permutation(d)[:n]) if n < d else np.arange(d)


def _bytes(column: pa.Array, kind: str) -> np.ndarray:
    """The bytes of a binary column of cells of one size, a row each."""
    place = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], dtype=place)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[1]].view(kind).reshape(len(column), -1)


def _block(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    margins = b.column("margins").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
    return _bytes(b.column("bins"), "<u2"), _bytes(b.column("roles"), "u1"), margins, b.column("label").to_numpy(), b.column("salt").to_numpy()


def _blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The rows in blocks of ``least`` or more, the last one smaller."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(_block(b))
            n += b.num_rows
        if n >= least:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _margin(g: _Growing, base: np.ndarray, bins: np.ndarray) -> np.ndarray:
    for t in g.recent:
        base = base + t.value[t.leaf_of(bins, t.bin)]
    return base


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """Sums of (cell, g, h) columns by cell, ascending."""
    whole = np.concatenate(parts, axis=1)
    whole = whole[:, np.argsort(whole[0], kind="stable")]
    starts = np.flatnonzero(np.r_[True, whole[0, 1:] != whole[0, :-1]]) if whole.shape[1] else np.zeros(0, dtype=int)
    return np.stack([whole[0, starts], *[np.add.reduceat(c, starts) for c in whole[1:]]]) if len(starts) else whole


def _counted(m: int, g: _Growing, block: Sequence[np.ndarray], d: int, width: int, stride: int, with_loss: bool) -> Iterator[np.ndarray]:
    """(cell, g, h) columns of one model in a block of bins, roles, margins, labels and salts.

    A cell is numbered by model, node (``stride`` to a model), feature and bin (``width`` to a feature);
    losses are cells below zero.
    """
    bins, role, margin, y, salt = block
    weight = np.where(y == 1, g.fit.params.positive_weight, 1.0)
    if with_loss:
        loss = _fixed(weight * (np.logaddexp(0, margin) - y * margin))
        for part in (TRAIN, VALIDATE):
            in_part = role == part
            yield np.array([[-2 * m - part], [int(loss[in_part].sum())], [int(_fixed(weight[in_part]).sum())]], dtype=np.int64)
    if not g.open:
        return
    used = role == TRAIN
    if g.fit.params.row_sample < 1:
        used &= _sampled(salt, g.fit.params, g.round)
    if len(g.nodes) > 1:
        tree = g.so_far()
        at = tree.leaf_of(bins, tree.bin)
        place = np.full(len(g.nodes), -1)
        place[g.open] = np.arange(len(g.open))
        slot = place[at]
        used &= slot >= 0
        slot = slot[used]
    else:
        slot = np.zeros(int(used.sum()), dtype=np.int64)
    p = 1 / (1 + np.exp(-margin[used]))
    w = weight[used]
    # At least one unit of curvature, so no occupied bin looks empty.
    grad, curve = _fixed(w * (p - y[used])), np.maximum(_fixed(w * p * (1 - p)), 1.0)
    x = bins[used]
    slot *= width
    for j in g.columns:
        cell = slot + x[:, j]
        h = np.bincount(cell, curve)
        full = np.flatnonzero(h)
        s = np.bincount(cell, grad)[full]
        first = (m * stride + np.array(g.open)[full // width]) * d + j
        yield np.stack([first * width + full % width, s.astype(np.int64), h[full].astype(np.int64)])


def _cells(growing: dict[int, _Growing], d: int, width: int, stride: int, with_loss: bool):
    """The task side of a pass: sparse histograms, one row per node, and losses, of node -1."""
    least = min(BLOCK_ROWS, BLOCK_MARGINS // max(len(growing), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for bins, roles, margins, y, salt in _blocks(batches, least):
            for m, g in growing.items():
                block = bins, roles[:, g.role], _margin(g, margins[:, m], bins), y, salt
                made = list(_counted(m, g, block, d, width, stride, with_loss))
                held += made
                size += sum(c.shape[1] for c in made)
            if size > HELD_CELLS:
                held = [_merged(held)]
                size = held[0].shape[1]
        if held:
            yield from _by_node(_merged(held), d * width)

    return run


def _by_node(cells: np.ndarray, node_cells: int) -> Iterator[pa.RecordBatch]:
    """Merged cells in rows (node, part), batches of bounded size; losses are of node -1."""
    node = np.where(cells[0] < 0, -1, cells[0] // node_cells)
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, dtype=int)
    ends = np.r_[starts[1:], len(node)]
    step = max(1, MERGE_BYTES // (24 * node_cells))
    for at in range(0, len(starts), step):
        blobs = [cells[:, i:j].tobytes() for i, j in zip(starts[at : at + step], ends[at : at + step])]
        yield pa.record_batch([pa.array(node[starts[at : at + step]]), pa.array(blobs, pa.binary())], ["node", "part"])


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.int64).reshape(3, -1)


FOUND = "node long, gain double, feature long, bin long, gl long, hl long, g long, h long"


def _decided(params: dict[int, BoostParams], d: int, width: int, stride: int):
    """The best split of every node whose parts a task holds; losses come out as rows of their cells (in g and h)."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        losses: list[np.ndarray] = []
        for b in batches:
            for node, blob in zip(b.column("node").to_pylist(), b.column("part")):
                cell, *values = part = _unpacked(blob.as_buffer())
                if node < 0:
                    losses.append(part)
                    continue
                mine = sums.setdefault(node, np.zeros((2, d * width), dtype=np.int64))
                for s, v in zip(mine, values):
                    s[cell - node * d * width] += v
        rows = [(int(c), 0.0, -1, 0, 0, 0, int(a), int(w)) for c, a, w in _merged(losses).T] if losses else []
        for node, (g, h) in sums.items():
            full = np.flatnonzero(h)
            cells = np.stack([node * d * width + full, g[full], h[full]])
            rows += [(node, *split) for split in _best_splits(cells, width, d, stride, params[node // stride]).values()]
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], names)

    return run


def _pass(state: DataFrame, parts: int, asked: dict[int, _Growing], d: int, width: int, stride: int, with_loss: bool) -> list:
    """Rows of the best splits of all open nodes, and of the losses."""
    cells = state.mapInArrow(_cells(asked, d, width, stride, with_loss), "node long, part binary")
    if parts > 1:
        # Tasks for a bounded share of the parts each, a node at least.
        nodes = sum(len(g.open) for g in asked.values()) + with_loss
        cells = cells.repartition(min(nodes, -(-parts * nodes * d * width * 24 // MERGE_BYTES)), "node")
    return cells.mapInArrow(_decided({m: g.fit.params for m, g in asked.items()}, d, width, stride), FOUND).collect()


# --- splits ------------------------------------------------------------------------


def _pull(g: np.ndarray | float, params: BoostParams) -> np.ndarray:
    """A gradient sum after the L1 term."""
    return np.sign(g) * np.maximum(np.abs(g) - params.l1, 0)


def _score(g, h, params: BoostParams):
    return _pull(g, params) ** 2 / (h + params.l2)


def leaf_value(g: float, h: float, params: BoostParams) -> float:
    return float(-params.learning_rate * _pull(g, params) / (h + params.l2))


def _best_splits(cells: np.ndarray, width: int, d: int, stride: int, params: BoostParams) -> dict[int, tuple]:
    """Per node of one model the split of largest gain: (gain, feature, bin, gl, hl, g, h); the first of equal ones."""
    cell, g, h = cells
    segment, at = cell // width, cell % width
    start = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    count = np.diff(np.r_[start, len(segment)])
    total = [np.repeat(np.add.reduceat(c, start), count) for c in (g, h)]
    before = [np.repeat(np.cumsum(c)[start] - c[start], count) for c in (g, h)]
    gl, hl = np.cumsum(g) - before[0], np.cumsum(h) - before[1]
    gf, hf, glf, hlf = total[0] / UNIT, total[1] / UNIT, gl / UNIT, hl / UNIT
    gain = _score(glf, hlf, params) + _score(gf - glf, hf - hlf, params) - _score(gf, hf, params)
    last = np.r_[start[1:], len(segment)] - 1
    allowed = (hlf >= params.min_child_weight) & (hf - hlf >= params.min_child_weight)
    allowed[last] = False
    gain = np.where(allowed, gain, -np.inf)
    out = {}
    node = segment // d % stride
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    for a, b in zip(first, np.r_[first[1:], len(node)]):
        n, best = node[a], a + int(np.argmax(gain[a:b]))
        out[int(n)] = (gain[best], int(segment[best] % d), int(at[best]), int(gl[best]), int(hl[best]), int(total[0][best]), int(total[1][best]))
    return out


def _grow(g: _Growing, found: dict[int, tuple]) -> None:
    """Split the open nodes whose best gain is real; their children are open next."""
    opened = []
    for n in g.open:
        gain, feature, at, gl, hl, total_g, total_h = found[n]
        node = g.nodes[n]
        node[4], node[5] = total_g, total_h
        if not gain > LEAST_GAIN:
            continue
        left = len(g.nodes)
        g.nodes.append([-1, 0, -1, -1, gl, hl, 0.0])
        g.nodes.append([-1, 0, -1, -1, total_g - gl, total_h - hl, 0.0])
        node[0], node[1], node[2], node[3], node[6] = feature, at, left, left + 1, float(gain)
        opened += [left, left + 1]
    g.open = opened


def _finished(g: _Growing, cuts: Sequence[np.ndarray]) -> Tree:
    """The tree, with splits of leaves that gain less than ``loss_reduction`` taken back from below."""
    params = g.fit.params

    def settle(n: int) -> None:
        node = g.nodes[n]
        if node[0] < 0:
            return
        settle(node[2])
        settle(node[3])
        if g.nodes[node[2]][0] < 0 and g.nodes[node[3]][0] < 0 and node[6] < params.loss_reduction:
            node[0], node[6] = -1, 0.0

    settle(0)
    order, at = [], [0]
    while at:
        n = at.pop(0)
        order.append(n)
        if g.nodes[n][0] >= 0:
            at += [g.nodes[n][2], g.nodes[n][3]]
    place = {n: i for i, n in enumerate(order)}
    rows = [g.nodes[n] for n in order]
    inner = [r[0] >= 0 for r in rows]
    grad, curve = [np.array([r[i] for r in rows], dtype=float) / UNIT for i in (4, 5)]
    return Tree(
        np.array([r[0] for r in rows], dtype=np.int64),
        np.array([r[1] if i else 0 for r, i in zip(rows, inner)], dtype=np.int64),
        np.array([cuts[r[0]][r[1]] if i else np.nan for r, i in zip(rows, inner)]),
        np.array([place[r[2]] if i else -1 for r, i in zip(rows, inner)], dtype=np.int64),
        np.array([place[r[3]] if i else -1 for r, i in zip(rows, inner)], dtype=np.int64),
        np.array([0.0 if i else leaf_value(a, b, params) for i, a, b in zip(inner, grad, curve)]),
        grad,
        curve,
        np.array([r[6] for r in rows], dtype=float),
    )


# --- fitting -----------------------------------------------------------------------


def _advanced(state: DataFrame, growing: dict[int, _Growing]) -> DataFrame:
    """The state with the recent trees added to its margins."""
    trees = {m: g for m, g in growing.items() if g.recent}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bins, _, margins, _, _ = _block(b)
            margins = margins.copy()
            for m, g in trees.items():
                margins[:, m] = _margin(g, margins[:, m], bins)
            made = pa.FixedSizeListArray.from_arrays(pa.array(margins.ravel()), margins.shape[1]).cast(pa.list_(pa.float64()))
            yield b.set_column(b.schema.get_field_index("margins"), "margins", made)

    return state.mapInArrow(run, state.schema)


def fit_many(rows: DataFrame, features: Sequence[str], fits: Sequence[Fit], key: str, label: str = "label", bins: int = MAX_BINS) -> list[BoostedTrees]:
    """One model per fit. ``rows`` should be stored or staged: they are read twice, then only their bins.

    Cut points come from all ``rows``, whatever part of them a fit trains on;
    labels take no part in them. Rows without label must be left out before.
    """
    cuts = cut_points(rows, features, bins)
    roles = list(dict.fromkeys((f.where, f.validate) for f in fits))
    made = [F.when(F.expr(w), TRAIN).when(F.expr(v or "false"), VALIDATE).otherwise(0) for w, v in roles]
    table = stage(binned(rows, features, cuts, made, key, label), "binned")
    out: list[BoostedTrees] = []
    for at in range(0, len(fits), AT_ONCE):
        out += _fit_group(table, features, fits[at : at + AT_ONCE], [roles.index((f.where, f.validate)) for f in fits[at : at + AT_ONCE]], cuts)
    return out


def _fit_group(table: DataFrame, features: Sequence[str], fits: Sequence[Fit], roles: Sequence[int], cuts: Sequence[np.ndarray]) -> list[BoostedTrees]:
    n = table.count()
    fit = _fit_held if 0 < n <= BLOCK_ROWS else _fit_in_passes
    return fit(table, n, tuple(features), fits, roles, cuts)


def _sizes(fits: Sequence[Fit], cuts: Sequence[np.ndarray]) -> tuple[int, int, int]:
    """Features, bins of a feature and nodes of a tree, as cells are numbered."""
    return len(cuts), max(len(c) for c in cuts) + 1, 2 ** (max(f.params.depth for f in fits) + 1)


def _fit_in_passes(table: DataFrame, n: int, features: tuple[str, ...], fits: Sequence[Fit], roles: Sequence[int], cuts: Sequence[np.ndarray]) -> list[BoostedTrees]:
    """All models in the same passes, a job for every level of a tree."""
    d, width, stride = _sizes(fits, cuts)
    zero = F.array_repeat(F.lit(0.0), len(fits)).alias("margins")
    # Passes are many, so a small table is read by few tasks.
    parts = min(table.rdd.getNumPartitions(), n * len(fits) // TASK_ROWS + 1)
    state, after = table.select("label", "salt", "roles", "bins", zero).coalesce(parts).persist(), None

    def ask(asked: dict[int, _Growing], with_loss: bool) -> list[tuple]:
        return _pass(state, parts, asked, d, width, stride, with_loss)

    def settle(t: int, growing: dict[int, _Growing]) -> None:
        nonlocal state, after
        if (t + 1) % STAGE_TREES == 0 and any(t + 1 < g.fit.params.trees for g in growing.values()):
            before, after = after, stage(_advanced(state, growing), "margins")
            state.unpersist()
            unstage(before)
            state = after.coalesce(parts).persist()
            for g in growing.values():
                g.recent = []

    made = _boost(features, fits, roles, cuts, ask, settle)
    state.unpersist()
    unstage(after)
    return made


def _fit_held(table: DataFrame, n: int, features: tuple[str, ...], fits: Sequence[Fit], roles: Sequence[int], cuts: Sequence[np.ndarray]) -> list[BoostedTrees]:
    """Models dealt to tasks that hold the ``n`` rows each, so no level waits for a job; the driver gets the trees."""
    sizes = _sizes(fits, cuts)
    tasks = min(len(fits), table.sparkSession.sparkContext.defaultParallelism)
    dealt: list[list[int]] = [[] for _ in range(tasks)]
    work = [f.params.trees * f.params.depth for f in fits]
    for m in sorted(range(len(fits)), key=lambda m: -work[m]):
        min(dealt, key=lambda own: sum(work[o] for o in own)).append(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            at = b.column("task").to_numpy()
            for t in np.unique(at).tolist():
                held.setdefault(t, []).append(b.filter(pa.array(at == t)))
        for t, own in held.items():
            block = next(_blocks(iter(own), n))
            for m in dealt[t]:
                blob = pickle.dumps(_held_model(block, features, fits[m], roles[m], cuts, sizes))
                yield pa.record_batch([pa.array([m], pa.int32()), pa.array([blob], pa.binary())], ["model", "blob"])

    rows = table.select("label", "salt", "roles", "bins", F.array(F.lit(0.0)).alias("margins"))
    copies = rows.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, F.col("task"))
    made = {r.model: pickle.loads(r.blob) for r in copies.mapInArrow(run, "model int, blob binary").collect()}
    return [made[m] for m in range(len(fits))]


def _held_model(block: Sequence[np.ndarray], features: tuple[str, ...], fit: Fit, role: int, cuts: Sequence[np.ndarray], sizes: tuple[int, int, int]) -> BoostedTrees:
    """One model from all rows of a table."""
    bins, roles, margins, y, salt = block
    margin, (d, width, stride) = margins[:, 0], sizes

    def ask(asked: dict[int, _Growing], with_loss: bool) -> list[tuple]:
        cells = _merged(list(_counted(0, asked[0], (bins, roles[:, role], margin, y, salt), d, width, stride, with_loss)))
        lost = int(np.searchsorted(cells[0], 0))
        found = [(int(c), 0.0, -1, 0, 0, 0, int(a), int(w)) for c, a, w in cells[:, :lost].T]
        if lost < cells.shape[1]:
            found += [(node, *split) for node, split in _best_splits(cells[:, lost:], width, d, stride, fit.params).items()]
        return found

    def settle(t: int, growing: dict[int, _Growing]) -> None:
        nonlocal margin
        for g in growing.values():
            margin = _margin(g, margin, bins)
            g.recent = []

    return _boost(features, [fit], [role], cuts, ask, settle)[0]


def _boost(features: tuple[str, ...], fits: Sequence[Fit], roles: Sequence[int], cuts: Sequence[np.ndarray], ask: Callable, settle: Callable) -> list[BoostedTrees]:
    """Models that grow together, level by level.

    ``ask`` has rows of ``FOUND``: the best split of every open node and, where told, the losses. ``settle`` is
    called after each round and may take the recent trees into the margins.
    """
    stride = _sizes(fits, cuts)[2]
    trees: list[list[Tree]] = [[] for _ in fits]
    losses: list[list] = [[] for _ in fits]
    best: list[int | None] = [None] * len(fits)
    growing = {m: _Growing(f, r, np.zeros(0, dtype=int), 0) for m, (f, r) in enumerate(zip(fits, roles))}
    for t in range(max(f.params.trees for f in fits) + 1):
        live = {}
        for m, g in growing.items():
            p = g.fit.params
            if t < p.trees:
                g.columns, g.round, g.nodes, g.open = _columns(p, t, len(cuts)), t, [[-1, 0, -1, -1, 0, 0, 0.0]], [0]
                live[m] = g
            elif t == p.trees:
                g.nodes, g.open = [[-1, 0, -1, -1, 0, 0, 0.0]], []
                live[m] = g
        level = 0
        while live and (level == 0 or any(g.open for g in live.values())):
            asked = {m: g for m, g in live.items() if level == 0 or g.open}
            found = ask(asked, level == 0)
            if level == 0:
                sums = {node: (g, h) for node, *_, g, h in found if node < 0}
                for m in list(live):
                    pair = [sums.get(-2 * m - part, (0, 0)) for part in (TRAIN, VALIDATE)]
                    losses[m].append(tuple(a / b if b else None for a, b in pair))
                    if _stops(losses[m], fits[m].patience):
                        best[m] = _best_round(losses[m])
                        growing.pop(m)
                        live.pop(m)
            splits: dict[int, dict[int, tuple]] = {}
            for node, *split in found:
                if node >= 0:
                    splits.setdefault(node // stride, {})[node % stride] = tuple(split)
            for m, g in live.items():
                if not g.open:
                    continue
                if m in splits:
                    _grow(g, splits[m])
                else:
                    g.open = []
            level += 1
            for g in live.values():
                if level >= g.fit.params.depth:
                    g.open = []
        for m, g in live.items():
            if t < g.fit.params.trees:
                tree = _finished(g, cuts)
                trees[m].append(tree)
                g.recent.append(tree)
        settle(t, growing)
    out = []
    for m, f in enumerate(fits):
        if f.patience is not None and best[m] is None:
            best[m] = _best_round(losses[m])
        kept = trees[m] if best[m] is None else trees[m][: best[m]]
        out.append(BoostedTrees(features, f.params, tuple(kept), tuple(losses[m]), best[m]))
    return out


def _best_round(losses: Sequence[tuple]) -> int:
    """The number of trees with the smallest validation loss, the first of equal ones."""
    seen = [v if v is not None else float("inf") for _, v in losses[1:]]
    return int(np.argmin(seen)) + 1 if seen else 0


def _stops(losses: Sequence[tuple], patience: int | None) -> bool:
    return patience is not None and len(losses) > 1 and len(losses) - 1 - _best_round(losses) >= patience


# --- scores and storage ------------------------------------------------------------


def probability_column(models: Sequence[BoostedTrees]) -> Column:
    """An array with P(1) of every model, of a row that has all their features."""
    features = list(dict.fromkeys(f for m in models for f in m.features))
    places = [[features.index(f) for f in m.features] for m in models]

    @F.pandas_udf("array<double>")
    def scored(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            x = np.stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns], axis=1)
            made = [1 / (1 + np.exp(-m.margins(x[:, at]))) for m, at in zip(models, places)]
            yield pd.Series(list(np.stack(made, axis=1)))

    return scored(*[F.col(f).cast("double") for f in features])


def leaf_column(model: BoostedTrees, tree: int) -> Column:
    """The node of the leaf that a row reaches in one tree."""
    made = model.trees[tree]

    @F.pandas_udf("int")
    def reached(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            x = np.stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns], axis=1)
            yield pd.Series(made.leaf_of(x, made.threshold).astype("int32"))

    return reached(*[F.col(f).cast("double") for f in model.features])


def node_table(spark: SparkSession, model: BoostedTrees) -> DataFrame:
    """(tree, node, feature, threshold, left, right, value, gradient, hessian, gain), one row per node."""
    rows = [
        (t, n, model.features[f] if f >= 0 else None, None if f < 0 else float(tree.threshold[n]), int(tree.bin[n]), int(tree.left[n]),
         int(tree.right[n]), float(tree.value[n]), float(tree.gradient[n]), float(tree.hessian[n]), float(tree.gain[n]))
        for t, tree in enumerate(model.trees)
        for n, f in enumerate(tree.feature.tolist())
    ]
    schema = "tree int, node int, feature string, threshold double, bin int, `left` int, `right` int, value double, gradient double, hessian double, gain double"
    return spark.createDataFrame(rows, schema)


def save(spark: SparkSession, model: BoostedTrees, path: str) -> None:
    head = {"features": model.features, "params": asdict(model.params), "losses": model.losses, "best_round": model.best_round, "trees": len(model.trees)}
    node_table(spark, model).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(json.dumps(head),)], "head string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def load(spark: SparkSession, path: str) -> BoostedTrees:
    head = json.loads(spark.read.text(f"{path}/head").first()[0])
    features = tuple(head["features"])
    nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
    parts = dict(list(nodes.groupby("tree")))
    trees = []
    for t in range(head["trees"]):
        n = parts[t]
        number = n.feature.map({f: i for i, f in enumerate(features)}).fillna(-1).astype(int)
        trees.append(Tree(number.to_numpy(), *[n[c].to_numpy() for c in ("bin", "threshold", "left", "right", "value", "gradient", "hessian", "gain")]))
    losses = tuple(tuple(x) for x in head["losses"])
    return BoostedTrees(features, BoostParams(**head["params"]), tuple(trees), losses, head["best_round"])
