"""Boosted trees and forests on histograms, many fits in the same passes.

Rows are binned once and kept as blocks of small integers. A large table is grown level by level: one pass over the
blocks sums gradients, Hessians and rows by (node, feature, bin) for the next level of the current trees of every fit,
over those features only that a node may split on. The sums are shuffled by groups of nodes, and the task that gets a
group finds its best splits: what reaches the driver is one split a node, never a histogram. All grid points and
folds grow side by side, so a search takes as many passes as its longest fit. A table of few blocks
(`BLOCKS_AT_ONCE * BLOCK_ROWS` rows at most) goes to the tasks as a whole and the fits are dealt to them instead. A
table of up to `STORED_ROWS` rows is written once to the shared folder, as one block of joint codes (`StoredBlock`), and read from there. Gradients
count as whole multiples of 2^-20, so sums are exact up to 8 * 10^9 rows: all ways, and any order of rows or tasks, give
the same trees. Grown trees travel and are kept packed (`packed_tree`).

Trees grow level by level to their depth. Where a fit has a leaf budget, the best-first order is then followed
over the grown tree: a node's split does not depend on the order, so this gives the tree that best-first growth gives.
For the same reason a tree of a forest that is cut at a depth, or at nodes of too few rows to be split, is the tree grown with that
bound, and the first trees of a fit are the fit of fewer rounds: such grid points share a fit.

Grown trees are written to the shared folder (`StoredTrees`) by the tasks that grow them, or batch by batch; those that score
read them there. So a model's trees, whose size grows with the rows where their depth is free, do not pass through the driver.

Blocks with their scores are persisted from one round to the next and checkpointed to the shared folder every
`CHECKPOINT_ROUNDS` rounds; a lost executor costs at most these rounds.
"""

from __future__ import annotations

import base64
import heapq
import io
import json
import pickle
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark import RDD, Broadcast, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.config import RANDOM_SEED, ROLES
from ebbline.session import shared_folder

#: Bins of a feature at most, rows of a block at most, blocks of a table that tasks may take as a whole (some 20 MB at 50
#: features), trees of a forest that share passes, rounds between checkpoints.
MAX_BINS = 64
BLOCK_ROWS = 65_536
BLOCKS_AT_ONCE = 4
TREES_AT_ONCE = 64
CHECKPOINT_ROUNDS = 25
#: Rows of a table that tasks read as a whole from a file in the shared folder; larger ones grow level by level in shared passes.
STORED_ROWS = 1 << 23
#: Bytes of packed trees that wait on the driver to be stored, files of a stored model.
WAITING_BYTES = 1 << 24
TREE_FILES = 8
#: Gradients, Hessians and weights are whole multiples of 1 / UNIT.
UNIT = float(1 << 20)
#: Cells counted at once, cells of a group of nodes.
CELLS = 1 << 17
GROUP_CELLS = 1 << 17
#: Codes of a column of joint features at most; for levels of few nodes, so many codes.
JOINT_CODES = 256
COARSE_CODES = 4096
COARSE_NODES = 4
#: Rows of a part of a block, and nodes from which on parts of a forest's tree have nodes of their own.
PART_ROWS = 1 << 16
DEALT_NODES = 32
#: Rows whose weights are drawn at once.
DRAWN_ROWS = 1 << 14
#: Rows a node, on average, from which on a forest's tree counts all features by joint codes rather than those of each node.
JOINT_ROWS = 128
#: Weights, rows and Hessians (in multiples of 1 / UNIT times 1 / TWICE) of a part are summed up in one number.
TWICE_BITS = 17
TWICE = 1 << TWICE_BITS
#: Chances of a Poisson variable of mean 1 to be at most 0, 1, 2, ...
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))


@dataclass(frozen=True)
class Fit:
    """Settings of one ensemble.

    `rounds` trees of `depth` levels (0: no bound). Boosted: learning `rate`, share of rows and features a tree, `penalty`
    on leaf values. Forest: bootstrap weights a tree, share of features a node. `leaves` bounds the leaves of a tree,
    `least_rows` and `least_weight` hold for leaves, `least_split` for split nodes. `fold` names the rows held out, -1 none; `columns` the features that may be used, None all.
    """

    rounds: int = 100
    depth: int = 6
    rate: float = 0.3
    rows_share: float = 1.0
    features_share: float = 1.0
    leaves: int | None = None
    least_rows: int = 1
    least_split: int = 2
    least_weight: float = 1.0
    penalty: float = 1.0
    forest: bool = False
    fold: int = -1
    columns: tuple[int, ...] | None = None


#: A tree to grow: the place of its fit in the list of fits, the fit, and the number of the tree, from 1.
Job = tuple[int, Fit, int]


@dataclass
class Layout:
    """Borders between the bins of all features, and the number of bins of each."""

    borders: list[list[float]]
    sizes: np.ndarray = field(init=False)

    def __post_init__(self):
        self.sizes = np.array([len(b) + 1 for b in self.borders])


@dataclass
class Trees:
    """Nodes of many trees side by side: split feature and bin, first child (the second follows), value, gain, cover.

    The cover is the sum of Hessians for boosted trees, the number of rows for forests.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @classmethod
    def roots(cls, n: int) -> Trees:
        return cls(np.zeros(n, np.int32), np.zeros(n, np.int32), np.full(n, -1, np.int32), np.zeros(n), np.zeros(n), np.zeros(n))

    def extended(self, n: int) -> Trees:
        more = Trees.roots(n)
        return Trees(*(np.concatenate((getattr(self, c), getattr(more, c))) for c in ("feature", "cut", "left", "value", "gain", "cover")))


def picked(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """values.take(places) for places that are known to be in range: checks of them cost more than the rest."""
    return values.take(places, mode="wrap")


def leaves_of(trees: Trees, bins: np.ndarray, node: np.ndarray, depth: int = 0) -> np.ndarray:
    """Node in which each row (column of bins) ends, one line a tree; with a depth, after so many levels at most.

    node has the nodes to start from: one a line, or one a line and row.
    """
    flat, width = bins.ravel(), np.intp(bins.shape[1])
    places = np.arange(width)
    if node.ndim == 1:
        node = np.repeat(node[:, None], width, axis=1)
    level = 0
    while True:
        first = picked(trees.left, node)
        inner = first >= 0
        if not inner.any() or (depth and level == depth):
            return node
        right = picked(flat, picked(trees.feature, node) * width + places) > picked(trees.cut, node)
        node = np.where(inner, first + right, node)
        level += 1


def feature_borders(encoded: DataFrame, features_col: str, width: int, max_bins: int = MAX_BINS) -> list[list[float]]:
    """Cuts between bins of every feature: a row is in bin k if k cuts lie below its value. One pass."""
    shares = F.array(*[F.lit(i / max_bins) for i in range(max_bins + 1)])
    values = encoded.select(F.posexplode(vector_to_array(features_col)).alias("i", "x"))
    found = values.groupBy("i").agg(F.percentile_approx("x", shares, F.lit(10_000)).alias("q")).collect()
    known = {r["i"]: sorted(set(r["q"])) for r in found}
    return [[(a + b) / 2 for a, b in zip(known.get(i, []), known.get(i, [])[1:])] for i in range(width)]


def binned_blocks(encoded: DataFrame, borders: Sequence[Sequence[float]], features_col: str, key: str | None, fold_col: str | None) -> DataFrame:
    """Blocks of rows: `bins` by feature, `label`, `fold` and `hash` as the bytes of arrays."""
    identity = F.col(key) if key else F.col(features_col).cast("string")
    fold = F.col(fold_col).cast("int") if fold_col else F.lit(-2)
    rows = encoded.select(F.xxhash64(identity).alias("hash"), F.col("label").cast("double").alias("label"), fold.alias("fold"), vector_to_array(features_col).alias("x"))

    def pack(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = slice(at, at + BLOCK_ROWS)
                bins = np.stack([np.searchsorted(b, x[part, i], "left") for i, b in enumerate(borders)]).astype(np.uint8)
                arrays = (bins, batch.column("label").to_numpy()[part], batch.column("fold").to_numpy()[part].astype(np.int32), batch.column("hash").to_numpy()[part])
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=["bins", "label", "fold", "hash"])

    return rows.mapInArrow(pack, "bins binary, label binary, fold binary, hash binary")


def unpacked(row: Mapping) -> dict:
    label = np.frombuffer(row["label"], np.float64)
    return {
        "bins": np.frombuffer(row["bins"], np.uint8).reshape(-1, len(label)), "label": label,
        "fold": np.frombuffer(row["fold"], np.int32), "hash": np.frombuffer(row["hash"], np.uint64),
    }


def _ordered(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Columns in an order, one line after the other: no second copy of all lines."""
    for line in values if values.ndim > 1 else [values]:
        line[:] = line.take(order)
    return values


def joined(blocks: Sequence[dict]) -> dict:
    """One block of many, which are emptied on the way."""
    return {c: np.concatenate([b.pop(c) for b in blocks], axis=-1) for c in ("bins", "label", "fold", "hash")}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _draw(hashes: np.ndarray, number: int) -> np.ndarray:
    """A value in [0, 1) for each row, fixed by its hash and the number."""
    x = _mixed(hashes ^ np.uint64((number * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def row_weights(block: Mapping, job: Job, seed: int) -> np.ndarray:
    """How often a tree takes each row."""
    _, f, number = job
    weights = (block["fold"] != f.fold).astype(np.float64)
    if f.forest or f.rows_share < 1:
        for at in range(0, len(weights), DRAWN_ROWS):
            part = slice(at, at + DRAWN_ROWS)
            u = _draw(block["hash"][part], number + 1_000_003 * seed)
            weights[part] *= np.searchsorted(POISSON, u, "right") if f.forest else u < f.rows_share
    return weights


@dataclass
class Drawn:
    """What a tree sees of a block: the rows that it takes, their values, and the nodes where they stand so far."""

    rows: np.ndarray
    values: np.ndarray
    node: np.ndarray

    def move(self, trees: Trees, bins: np.ndarray, kept: np.ndarray) -> None:
        """Rows go on to the nodes where they end now; those that end elsewhere than in kept nodes leave."""
        flat, width, open_ = bins.ravel(), bins.shape[1], None
        while True:
            first = trees.left.take(self.node if open_ is None else self.node[open_])
            inner = np.flatnonzero(first >= 0)
            if not len(inner):
                break
            open_ = inner if open_ is None else open_[inner]
            at = self.node[open_]
            right = flat.take(trees.feature.take(at) * np.intp(width) + self.rows[open_]) > trees.cut.take(at)
            self.node[open_] = first[inner] + right
        wanted = np.zeros(len(trees.left), bool)
        wanted[kept] = True
        stay = wanted[self.node]
        if not stay.all():
            self.rows, self.values, self.node = self.rows[stay], self.values[:, stay], self.node[stay]


def drawn_rows(block: Mapping, job: Job, counted: bool, seed: int, root: int = 0) -> Drawn:
    """values are gradients and Hessians, for a forest positive weights and weights, and with counted the rows."""
    weights = row_weights(block, job, seed)
    rows = np.flatnonzero(weights)
    weights, labels = weights[rows], block["label"][rows]
    if job[1].forest:
        g, h = weights * labels * UNIT, weights * UNIT
    else:
        p = 1.0 / (1.0 + np.exp(-block["scores"][job[0]][rows]))
        g, h = np.rint((p - labels) * UNIT), np.rint(p * (1.0 - p) * UNIT)
    return Drawn(rows, np.stack([g, h, np.ones_like(g)] if counted else [g, h]), np.full(len(rows), root))


def counts_rows(jobs: Sequence[Job]) -> bool:
    return any(f.forest or f.least_rows > 1 or f.least_split > 2 for _, f, _ in jobs)


@dataclass
class Choice:
    """Features that nodes may split on: pairs of a node and a feature in this order, and the first cell of each pair."""

    node: np.ndarray
    feature: np.ndarray
    at: np.ndarray
    first: np.ndarray
    cells: int


def choice_of(allowed: np.ndarray, layout: Layout) -> Choice:
    node, feature = np.nonzero(allowed)
    ends = np.cumsum(layout.sizes[feature])
    first = np.concatenate(([0], np.cumsum(allowed.sum(axis=1))))
    return Choice(node, feature, ends - layout.sizes[feature], first, int(ends[-1]) if len(ends) else 0)


def chosen_histograms(bins: np.ndarray, drawn: Drawn, slot: np.ndarray, choice: Choice) -> np.ndarray:
    """Sums of the values by the cells of a choice; slot is the place of each row's node."""
    found = np.zeros((len(drawn.values), choice.cells))
    width = np.diff(choice.first)
    most, even = int(width.max(initial=0)), bool((width == width[:1]).all())
    step = max(1, CELLS // max(len(slot), 1))
    for low in range(0, most, step):
        places = np.arange(low, min(low + step, most))[:, None]
        pair = choice.first[slot] + places
        if even:
            index = (choice.at[pair] + bins[choice.feature[pair], drawn.rows]).ravel()
            values = np.broadcast_to(drawn.values[:, None, :], (len(drawn.values), *pair.shape))
        else:
            line, row = np.nonzero(places < width[slot])
            pair = pair[line, row]
            index, values = choice.at[pair] + bins[choice.feature[pair], drawn.rows[row]], drawn.values[:, row]
        for k in range(len(found)):
            found[k] += np.bincount(index, values[k].ravel(), choice.cells)
    return found


@dataclass
class Joint:
    """Several features as one column: the code that each row has, and by code the bins of the features (codes x features)."""

    features: np.ndarray
    codes: np.ndarray | None
    bins: np.ndarray
    #: By code, 1 for the cells (those of the features side by side) that it stands for.
    cells: np.ndarray | None = None


def joint_codes(bins: np.ndarray, sizes: np.ndarray, most: int | None = None) -> list[Joint]:
    """All features of a block, as few columns of `most` codes at most: levels of a column exclude each other, so many features have few patterns."""
    found, open_, codes, table = [], [], None, None
    most = most or JOINT_CODES

    def close() -> None:
        if open_:
            found.append(Joint(np.array(open_), codes, table))

    for f, size in enumerate(sizes.tolist()):
        own = bins[f].astype(np.intp)
        if open_:
            pair = codes * np.intp(size) + own
            known = np.flatnonzero(np.bincount(pair, minlength=len(table) * size))
            if len(known) <= most:
                place = np.zeros(len(table) * size, np.intp)
                place[known] = np.arange(len(known))
                open_, codes = [*open_, f], place[pair]
                table = np.column_stack((table[known // size], known % size))
                continue
        close()
        open_, codes, table = [f], own, np.arange(size)[:, None]
    close()
    return [Joint(j.features, j.codes.astype(np.uint8 if len(j.bins) <= 256 else np.uint16), j.bins) for j in found]


def with_cells(joint: Sequence[Joint], sizes: np.ndarray) -> list[Joint]:
    found = []
    for j in joint:
        ends = np.cumsum(sizes[j.features])
        cells = np.zeros((len(j.bins), int(ends[-1])))
        cells[np.arange(len(j.bins))[:, None], ends - sizes[j.features] + j.bins] = 1.0
        found.append(replace(j, cells=cells))
    return found


def prepared_block(block: Mapping, layout: Layout) -> dict:
    """What trees need that grow over a block alone: joint codes, coarse and fine, in place of the bins.

    Column `column` of the fine codes holds a feature, and `table` has the bin that each of them stands for.
    """
    coarse, fine = (joint_codes(block["bins"], layout.sizes, most) for most in (COARSE_CODES, JOINT_CODES))
    codes, column = np.stack([j.codes for j in fine]), np.zeros(len(layout.sizes), np.intp)
    table = np.zeros((len(layout.sizes), 256), np.uint8)
    for k, j in enumerate(fine):
        column[j.features] = k
        table[j.features, : len(j.bins)] = j.bins.T
    own = {"codes": codes, "column": column, "table": table, "joint": [[replace(j, codes=None) for j in joint] for joint in (coarse, fine)]}
    own |= {f"coarse{k}": j.codes for k, j in enumerate(coarse)}
    return {c: block[c] for c in ("label", "fold", "hash")} | own


def ready_block(block: Mapping, layout: Layout) -> dict:
    """A prepared block as tasks use it: the tables of joint codes with their cells."""
    coarse, fine = (with_cells(own, layout.sizes) for own in block["joint"])
    codes = [[block[f"coarse{k}"] for k in range(len(coarse))], list(block["codes"])]
    return dict(block) | {"joint": [coarse, fine], "columns": codes}


@dataclass(frozen=True)
class StoredBlock:
    """A prepared block in a folder that driver and tasks share; each process opens it once."""

    folder: str

    #: Arrays of rows; the rest is small.
    ROWS = ("label", "fold", "hash", "codes")

    @classmethod
    def write(cls, folder: str, block: Mapping) -> StoredBlock:
        system, path = FileSystem.from_uri(folder)
        system.create_dir(path)
        rest = {}
        for name, own in block.items():
            if name in cls.ROWS or name.startswith("coarse"):
                with system.open_output_stream(f"{path}/{name}.npy") as out:
                    np.lib.format.write_array(out, np.ascontiguousarray(own))
            else:
                rest[name] = own
        with system.open_output_stream(f"{path}/rest") as out:
            out.write(pickle.dumps(rest))
        return cls(folder)

    @property
    def value(self) -> dict:
        if self.folder not in _opened:
            system, path = FileSystem.from_uri(self.folder)
            with system.open_input_stream(f"{path}/rest") as file:
                block = pickle.loads(file.read())
            for name in (*self.ROWS, *(f"coarse{k}" for k in range(len(block["joint"][0])))):
                if isinstance(system, LocalFileSystem):
                    # Pages of the file are shared by the tasks of a machine.
                    block[name] = np.load(f"{path}/{name}.npy", mmap_mode="r").view(np.ndarray)
                else:
                    with system.open_input_stream(f"{path}/{name}.npy") as file:
                        block[name] = np.lib.format.read_array(io.BytesIO(file.read()))
            _opened.clear()
            _opened[self.folder] = block
        return _opened[self.folder]


_opened: dict[str, dict] = {}


def shared_histograms(joint: Sequence[Joint], drawn: Drawn, slot: np.ndarray, nodes: int, columns: np.ndarray, layout: Layout) -> np.ndarray:
    """Sums of the values (first axis) by node and cell, where all nodes share their features; rows of slot -1 are left out.

    Rows are counted by the codes of joint features; a cell has the sum of the codes that hold its bin. Sums of whole numbers
    are exact in any order.
    """
    sizes = layout.sizes[columns]
    start = np.full(len(layout.sizes), -1)
    start[columns] = np.cumsum(sizes) - sizes
    found = np.empty((len(drawn.values), nodes, int(sizes.sum())))
    kept = np.flatnonzero(slot >= 0)
    rows, own, values = drawn.rows[kept], slot[kept], drawn.values[:, kept]
    for j in joint:
        wanted = np.flatnonzero(start[j.features] >= 0)
        if not len(wanted):
            continue
        n = len(j.bins)
        index = own * n
        index += j.codes.take(rows)
        widths = layout.sizes[j.features[wanted]]
        ends = np.cumsum(widths)
        cells = np.concatenate([start[f] + np.arange(w) for f, w in zip(j.features[wanted], widths)])
        holds = np.zeros((n, int(ends[-1])))
        holds[np.arange(n)[:, None], ends - widths + j.bins[:, wanted]] = 1.0
        for k, v in enumerate(values):
            found[k][:, cells] = np.bincount(index, v, nodes * n).reshape(nodes, n) @ holds
    return found


def _score(sums: np.ndarray, penalty: np.ndarray | float) -> np.ndarray:
    """Square of the first sum over the second one with the penalty, 0 where that is not positive; sums and penalty in multiples of 1 / UNIT, as the score."""
    over = sums[1] + penalty
    over[over <= 0] = np.inf
    up = sums[0] * sums[0]
    up /= over
    return up


def _sums_up_to(sums: np.ndarray, choice: Choice, sizes: np.ndarray) -> np.ndarray:
    """By cell of a choice: sums of the cells of its pair up to this one."""
    if np.abs(sums).sum(axis=1).max(initial=0.0) < 1 << 53:
        # Whole numbers, so one sum over all cells is exact.
        found = sums.cumsum(axis=1)
        found -= np.repeat(found[:, choice.at] - sums[:, choice.at], sizes, axis=1)
        return found
    found = np.empty_like(sums)
    for size in np.unique(sizes):
        cells = choice.at[sizes == size][:, None] + np.arange(size)
        found[:, cells] = sums[:, cells].cumsum(axis=2)
    return found


def _by_node(limit: np.ndarray, own: np.ndarray) -> np.ndarray | float:
    return float(limit[0]) if (limit == limit[0]).all() else limit[own]


def best_splits(sums: np.ndarray, choice: Choice, layout: Layout, limits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per node: gain, feature, bin, and the sums of both sides of its best split; gain 0 if there is none.

    limits has the penalty, least weight and least rows of each node. Of equal gains the first feature and the lowest bin
    win.
    """
    sizes, nodes = layout.sizes[choice.feature], len(choice.first) - 1
    start = choice.at[choice.first[:-1]]
    below = _sums_up_to(sums, choice, sizes)
    total = below[:, start + sizes[choice.first[:-1]] - 1]
    own = np.repeat(np.arange(nodes), np.diff(np.append(start, choice.cells)))
    good = None
    for k, limit in ((1, limits[1]), (2, limits[2]))[: len(sums) - 1]:
        if not limit.any():
            continue
        least = _by_node(limit, own)
        fine = below[k] >= least
        fine &= picked(total[k], own) - below[k] >= least
        good = fine if good is None else good & fine
    cells = np.arange(choice.cells) if good is None else np.flatnonzero(good)
    own = picked(own, cells)
    low, whole = np.stack([picked(v, cells) for v in below[:2]]), np.stack([picked(v, own) for v in total[:2]])
    penalty = limits[0] * UNIT
    each = _by_node(penalty, own) if len(own) else 0.0
    gains = _score(low, each) + _score(whole - low, each)
    gains -= picked(_score(total, penalty), own)
    gains /= UNIT
    some = np.flatnonzero(gains > 1e-12)
    cells, own, gains = picked(cells, some), picked(own, some), picked(gains, some)
    gain, feature, cut = np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    left, right = total.copy(), np.zeros_like(total)
    if len(own):
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        split, top = own[first], np.maximum.reduceat(gains, first)
        gain[split] = top
        equal = np.flatnonzero(gains == picked(gain, own))
        best = cells[equal[np.concatenate(([True], own[equal][1:] != own[equal][:-1]))]]
        pair = np.searchsorted(choice.at, best, "right") - 1
        feature[split], cut[split] = choice.feature[pair], best - choice.at[pair]
        left[:, split] = below[:, best]
        right = total - left
    return gain, feature, cut, left, right


def best_first(trees: Trees, root: int, leaves: int) -> list[int]:
    """Nodes that are split when the leaf of largest gain is split first, until there are so many leaves."""
    split, open_ = [], []

    def offer(node: int) -> None:
        if trees.left[node] >= 0:
            heapq.heappush(open_, (-trees.gain[node], node))

    offer(root)
    while open_ and len(split) + 1 < leaves:
        node = heapq.heappop(open_)[1]
        split.append(node)
        offer(int(trees.left[node]))
        offer(int(trees.left[node]) + 1)
    return split


def _allowed(jobs: Sequence[Job], owner: np.ndarray, names: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Features that each node may split on: drawn once a tree for boosted trees, once a node for forests.

    names are hashes of the paths to the nodes.
    """
    chosen = np.ones((len(owner), width), bool)
    for i in np.unique(owner):
        _, f, number = jobs[i]
        own, columns = np.flatnonzero(owner == i), np.arange(width) if f.columns is None else np.array(f.columns)
        n = max(1, round(f.features_share * len(columns)))
        if n == width:
            continue
        base = names[own] if f.forest else np.zeros(len(own), np.uint64)
        start = base ^ _mixed(np.array([number + 1_000_003 * seed], np.uint64))
        draws = _mixed(start[:, None] + (columns + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        drawn = np.zeros((len(own), width), bool)
        np.put_along_axis(drawn, columns[draws.argpartition(n - 1, axis=1)[:, :n]], True, axis=1)
        chosen[own] = drawn
    return chosen


@dataclass
class Level:
    """Nodes to split: those of the same tree stand together. limits are those of best_splits, weight that of every node."""

    trees: Trees
    active: np.ndarray
    owner: np.ndarray
    allowed: np.ndarray
    limits: np.ndarray
    parent: np.ndarray
    weight: np.ndarray


def grow(find: Callable[[Level], tuple[np.ndarray, ...]], jobs: Sequence[Job], layout: Layout, seed: int, whole: Callable[[np.ndarray], None] | None = None) -> Trees:
    """One tree a job; root i belongs to jobs[i]. find gives the best splits of a level. Values hold the learning rate.

    whole gets the first children of all nodes before leaf budgets cut them.
    """
    n, width = len(jobs), len(layout.borders)
    fits = [f for _, f, _ in jobs]
    trees, owner, names, parent = Trees.roots(n), np.arange(n), np.ones(n, np.uint64), np.full(n, -1)
    forest = np.array([f.forest for f in fits])
    depth, rows, weight = (np.array([float(value(f)) for f in fits]) for value in (
        lambda f: f.depth or np.inf, lambda f: max(2 * f.least_rows, f.least_split), lambda f: 2 * f.least_weight * UNIT,
    ))
    limits = np.array([[f.penalty, f.least_weight * UNIT, f.least_rows] for f in fits]).T
    level, active, sums = 0, np.arange(n), None
    # Best-first order splits the nodes of largest `reach`, the least gain on their paths: what lies below so many of them as a leaf budget has splits is not grown.
    reach, budgets = np.full(n, np.inf), [i for i, f in enumerate(fits) if f.leaves is not None]
    tops, least_reach = {i: np.zeros(0) for i in budgets}, np.full(n, -np.inf)
    while len(active):
        own = owner[active]
        allowed = _allowed(jobs, own, names[active], width, seed)
        known = np.zeros(n) if sums is None else sums[1]
        gain, feature, cut, left, right = find(Level(trees, active, own, allowed, limits[:, own], parent, known))
        if sums is None:
            sums = left + right
        split = np.flatnonzero(gain > 0)
        if not len(split):
            break
        parents = active[split]
        children = len(trees.left) + np.arange(2 * len(split))
        trees.feature[parents], trees.cut[parents], trees.left[parents], trees.gain[parents] = feature[split], cut[split], children[::2], gain[split]
        trees = trees.extended(2 * len(split))
        owner, parent = np.concatenate((owner, np.repeat(owner[parents], 2))), np.concatenate((parent, np.repeat(parents, 2)))
        names = np.concatenate((names, _mixed(np.repeat(names[parents], 2) * np.uint64(2) + np.arange(2 * len(split), dtype=np.uint64) % np.uint64(2))))
        sums = np.concatenate((sums, np.stack((left[:, split], right[:, split]), axis=2).reshape(len(sums), -1)), axis=1)
        level += 1
        keys = np.minimum(reach[parents], gain[split])
        reach = np.concatenate((reach, np.repeat(keys, 2)))
        for i in budgets:
            splits = max(fits[i].leaves - 1, 0)
            tops[i] = np.sort(np.concatenate((tops[i], keys[owner[parents] == i])))[::-1][:splits]
            if len(tops[i]) == splits:
                least_reach[i] = tops[i][-1] if splits else np.inf
        # Children that may be split again: by depth, rows and weight; a forest's node of one class is done.
        fit, mine = owner[children], sums[:, children]
        pure = forest[fit] & ((mine[0] == 0) | (mine[0] == mine[1]))
        open_ = (level < depth[fit]) & (mine[1] >= weight[fit]) & ~pure & (reach[children] >= least_reach[fit])
        if len(mine) > 2:
            open_ &= mine[2] >= rows[fit]
        active = children[open_]
    if whole is not None:
        whole(trees.left.copy())
    for i, f in enumerate(fits):
        if f.leaves is not None:
            kept = set(best_first(trees, i, f.leaves))
            trees.left[[v for v in np.flatnonzero(owner == i) if v not in kept]] = -1
    penalty, rate = np.array([f.penalty for f in fits])[owner], np.array([f.rate for f in fits])[owner]
    weight = sums[1] / UNIT + penalty
    value = np.divide(sums[0] / UNIT, weight, out=np.zeros(len(weight)), where=weight > 0)
    trees.value = np.where(forest[owner], value, -rate * value)
    trees.cover = np.where(forest[owner], sums[-1], sums[1] / UNIT)
    return trees


@dataclass
class Part:
    """Rows that stand in some of the nodes of a level, `low` to `high` of them at most.

    flat has the columns of fine codes one after the other, `step` rows each, columns the coarse and the fine ones; base is the place of each row there, slot
    that of its node in the level. Of the values some hold two or three sums (`Growing.apart`).
    """

    flat: np.ndarray
    step: int
    columns: list[list[np.ndarray]]
    base: np.ndarray
    slot: np.ndarray
    values: list[np.ndarray]
    low: int = 0
    high: int = 1

    def take(self, places: np.ndarray) -> Part:
        return replace(self, base=picked(self.base, places), slot=picked(self.slot, places), values=[picked(v, places) for v in self.values])


def bins_of(flat: np.ndarray, base: np.ndarray, table: np.ndarray, column: np.ndarray, feature: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Bin of a feature for each row: column has by slot where its codes start, table 256 bins a feature."""
    at = picked(column, slot)
    at += base
    code = picked(flat, at)
    at = picked(feature * 256, slot)
    at += code
    return picked(table, at)


class Growing:
    """One tree over one block, level by level: rows stand in parts of `PART_ROWS`, so that what a pass needs stays near the processor."""

    def __init__(self, block: Mapping, layout: Layout, values: int):
        self.block, self.layout, self.n_values = block, layout, values
        self.joints, self.rows = block["joint"], len(block["label"])
        self.flat, self.column, self.table = block["codes"].ravel(), block["column"], block["table"].ravel()
        self.parts: list[Part] = []
        self.nodes = np.zeros(1, np.int64)

    def add(self, rows: np.ndarray, values: list[np.ndarray]) -> None:
        self.parts.append(Part(self.flat, self.rows, self.block["columns"], rows, np.zeros(len(rows), np.intp), values))

    def moved(self, trees: Trees, kept: np.ndarray) -> None:
        """Rows go on to the children of their nodes; those that end elsewhere than in kept nodes leave."""
        first = trees.left[self.nodes].astype(np.intp)
        place = np.full(len(trees.left), -1, np.intp)
        place[kept] = np.arange(len(kept))
        ends = np.where(first[:, None] < 0, self.nodes[:, None], first[:, None] + np.arange(2))
        slots = np.where(first[:, None] < 0, -1, place[ends]).ravel()
        feature, cut = trees.feature[self.nodes].astype(np.intp), trees.cut[self.nodes].astype(np.uint8)
        found = []
        for part in self.parts:
            right = bins_of(part.flat, part.base, self.table, self.column[feature] * part.step, feature, part.slot) > picked(cut, part.slot)
            at = part.slot * 2
            at += right
            slot = picked(slots, at)
            stay = np.flatnonzero(slot >= 0)
            if len(stay) < len(slot):
                self.left_behind(part, at, slot, ends)
            # Children keep the order of their parents.
            own = slots[2 * part.low : 2 * part.high]
            own = own[own >= 0]
            part.slot = slot
            if len(stay):
                part = part.take(stay) if len(stay) < len(slot) else part
                part.low, part.high = int(own[0]), int(own[-1]) + 1
                found.append(part)
        self.parts, self.nodes = found, kept

    def left_behind(self, part: Part, at: np.ndarray, slot: np.ndarray, ends: np.ndarray) -> None:
        pass

    def apart(self, sums: list[np.ndarray]) -> Sequence[np.ndarray]:
        """The sums of all values from those that are held together."""
        raise NotImplementedError

    def joint_sums(self, parts: Sequence[Part], low: int, nodes: int, wanted: np.ndarray) -> np.ndarray:
        """Sums of the values (first axis) by node, from `low` on, and cell of the wanted features; exact, as values are whole numbers."""
        sizes, coarse = self.layout.sizes, 0 if nodes <= COARSE_NODES else -1
        cell = np.concatenate(([0], np.cumsum(np.where(wanted, sizes, 0))))
        found = np.empty((self.n_values, nodes, cell[-1]))
        for k, j in enumerate(self.joints[coarse]):
            if not wanted[j.features].any():
                continue
            n = len(j.bins)
            # Features of a column stand together, and so do their cells.
            held = np.repeat(wanted[j.features], sizes[j.features])
            cells = j.cells if held.all() else j.cells[:, held]
            own = found[:, :, cell[j.features[0]] : cell[j.features[-1] + 1]]
            sums = np.zeros((self.n_values, nodes * n)) if len(parts) != 1 else None
            for part in parts:
                index = picked(part.columns[coarse][k], part.base).astype(np.intp)
                if nodes > 1:
                    index += (part.slot - low if low else part.slot) * n
                counted = [np.bincount(index, v, nodes * n) for v in part.values]
                if sums is None:
                    for v, more in zip(own, self.apart([v.reshape(nodes, n) @ cells for v in counted])):
                        v[:] = more
                else:
                    for v, more in zip(sums, self.apart(counted)):
                        v += more
            if sums is not None:
                own[:] = (sums.reshape(-1, n) @ cells).reshape(own.shape)
        return found


class ForestTree(Growing):
    """Each node has features of its own."""

    def __init__(self, block: Mapping, job: Job, layout: Layout, seed: int):
        super().__init__(block, layout, 3)
        weights = row_weights(block, job, seed)
        rows = np.flatnonzero(weights)
        weights, labels = picked(weights, rows), picked(block["label"], rows)
        # A row, its weight and its weighted label in one number; sums of them are below 2^51 where labels are 0 or 1.
        self.packed = bool(((labels == 0) | (labels == 1)).all())
        values = [(weights * labels * TWICE + weights) * TWICE + 1] if self.packed else [weights * labels, weights, np.ones_like(weights)]
        cuts = [0, len(rows)]
        if len(rows):
            share = np.cumsum(weights)
            cuts[1:1] = np.unique(np.searchsorted(share, np.arange(PART_ROWS, share[-1], PART_ROWS))).tolist()
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                self.add(rows[a:b], [v[a:b] for v in values])
        self.first, self.dealt = True, len(self.parts) < 2

    def apart(self, sums: list[np.ndarray]) -> Sequence[np.ndarray]:
        if not self.packed:
            return sums
        whole = sums[0].astype(np.int64)
        return whole >> (2 * TWICE_BITS), (whole >> TWICE_BITS) & (TWICE - 1), whole & (TWICE - 1)

    def _by_nodes(self, nodes: int) -> None:
        """Parts get the rows of neighbouring nodes: what they read and sum up are ranges of their own."""
        slot = np.concatenate([p.slot for p in self.parts])
        order = np.argsort(slot.astype(np.uint16) if nodes < 1 << 16 else slot, kind="stable")
        slot, base = picked(slot, order), picked(np.concatenate([p.base for p in self.parts]), order)
        values = [picked(np.concatenate(v), order) for v in zip(*(p.values for p in self.parts))]
        share = np.cumsum((values[0] // TWICE) % TWICE if self.packed else values[1])
        before = np.concatenate(([0.0], share))
        cuts = [0]
        for end in np.searchsorted(slot, np.arange(nodes), "right").tolist():
            # A node of many rows has several parts.
            while before[end] - before[cuts[-1]] > 1.5 * PART_ROWS:
                cuts.append(int(np.searchsorted(share, before[cuts[-1]] + PART_ROWS)))
            if before[end] - before[cuts[-1]] > 0.75 * PART_ROWS:
                cuts.append(end)
        self.parts = []
        for a, b in zip(cuts, [*cuts[1:], len(slot)]):
            if b > a:
                rows = base[a:b]
                columns = [[picked(c, rows) for c in own] for own in self.block["columns"]]
                self.parts.append(Part(np.concatenate(columns[-1]), b - a, columns, np.arange(b - a), slot[a:b], [v[a:b] for v in values], int(slot[a]), int(slot[b - 1]) + 1))
        self.dealt = True

    def __call__(self, level: Level) -> tuple[np.ndarray, ...]:
        if not self.first:
            self.moved(level.trees, level.active)
        self.first = False
        if not self.dealt and len(level.active) >= DEALT_NODES:
            self._by_nodes(len(level.active))
        sizes, choice = self.layout.sizes, choice_of(level.allowed, self.layout)
        first = np.append(choice.at[choice.first[:-1]], choice.cells)
        sums = np.zeros((3, choice.cells))
        jointly = sum(len(p.slot) for p in self.parts) >= JOINT_ROWS * len(level.active)
        if jointly:
            # By cell of the choice, its place among the cells of all features of all nodes.
            of_pair = (np.cumsum(sizes) - sizes)[choice.feature] - choice.at + choice.node * int(sizes.sum())
            cells, every = np.repeat(of_pair, sizes[choice.feature]) + np.arange(choice.cells), np.ones(len(sizes), bool)
        for parts in [[p] for p in self.parts] if self.dealt else [self.parts]:
            low, high = parts[0].low, max(p.high for p in parts)
            own = sums[:, first[low] : first[high]]
            if jointly:
                found = self.joint_sums(parts, low, high - low, every).reshape(3, -1)
                place = cells[first[low] : first[high]] - low * int(sizes.sum())
                for v, more in zip(own, found):
                    v += picked(more, place)
            else:
                for part in parts:
                    for v, more in zip(own, self.apart(self._chosen(part, choice, first[low], first[high], low))):
                        v += more
        sums[:2] *= UNIT
        return best_splits(sums, choice, self.layout, level.limits)

    def _chosen(self, part: Part, choice: Choice, first: int, last: int, low: int) -> list[np.ndarray]:
        each = len(choice.node) // (len(choice.first) - 1)
        at, feature = (np.ascontiguousarray(v.reshape(-1, each)[low : part.high].T) for v in (choice.at - first, choice.feature))
        column = self.column[feature] * part.step
        slot = part.slot - low if low else part.slot
        index = np.empty((each, len(slot)), np.intp)
        for k in range(each):
            np.add(bins_of(part.flat, part.base, self.table, column[k], feature[k], slot), picked(at[k], slot), out=index[k])
        return [np.bincount(index.ravel(), np.broadcast_to(v, index.shape).ravel(), last - first) for v in part.values]


class BoostedTree(Growing):
    """All nodes have the same features: of two children the lighter one is counted, the other one has what is left of the parent."""

    def __init__(self, block: Mapping, job: Job, layout: Layout, seed: int):
        self.counted = counts_rows([job])
        super().__init__(block, layout, 3 if self.counted else 2)
        _, f, _ = job
        rows = np.flatnonzero(block["fold"] != f.fold if f.rows_share >= 1 else row_weights(block, job, seed))
        labels, scores = block["label"], block["scores"][job[0]]
        for a in range(0, len(rows), PART_ROWS):
            own = rows[a : a + PART_ROWS]
            p = 1.0 / (1.0 + np.exp(-picked(scores, own)))
            g, h = np.rint((p - picked(labels, own)) * UNIT), np.rint(p * (1.0 - p) * UNIT)
            # Hessians are at most UNIT / 4, so the sums of those of a part and of its rows fit into one number.
            self.add(own, [g, h * TWICE + 1 if self.counted else h])
        #: Nodes where the rows end that the tree has seen; -1 for others.
        self.ended = np.full(self.rows, -1, np.int64)
        self.last = None

    def apart(self, sums: list[np.ndarray]) -> Sequence[np.ndarray]:
        if not self.counted:
            return sums
        h = np.floor(sums[1] / TWICE)
        return sums[0], h, sums[1] - h * TWICE

    def left_behind(self, part: Part, at: np.ndarray, slot: np.ndarray, ends: np.ndarray) -> None:
        gone = np.flatnonzero(slot < 0)
        self.ended[picked(part.base, gone)] = picked(ends.ravel(), picked(at, gone))

    def __call__(self, level: Level) -> tuple[np.ndarray, ...]:
        trees, active = level.trees, level.active
        subsets, counted = self.parts, active
        if self.last is not None:
            up, which = np.unique(level.parent[active], return_inverse=True)
            first = trees.left[up].astype(np.int64)
            lighter = (level.weight[first + 1] < level.weight[first]).astype(np.int64)
            counted = first + lighter
            held = np.unique(np.concatenate((active, counted)))
            self.moved(trees, held)
            slot_of = np.full(len(held), -1, np.intp)
            slot_of[np.searchsorted(held, counted)] = np.arange(len(counted))
            subsets = []
            for part in self.parts:
                slot = picked(slot_of, part.slot)
                subsets.append(replace(part, slot=slot).take(np.flatnonzero(slot >= 0)))
        found = self.joint_sums(subsets, 0, len(counted), level.allowed[0])
        if self.last is not None:
            both, each = np.empty((len(found), len(up), 2, found.shape[2])), np.arange(len(up))
            both[:, each, lighter] = found
            both[:, each, 1 - lighter] = self.last[:, np.searchsorted(self.last_nodes, up)] - found
            found = both[:, which, active - first[which]]
        self.last, self.last_nodes = found, active
        return best_splits(found.reshape(len(found), -1), choice_of(level.allowed, self.layout), self.layout, level.limits)

    def leaves(self, trees: Trees, grown: np.ndarray) -> np.ndarray:
        """Leaf of every row of the block. grown has the first children as they were before leaves were bounded."""
        self.moved(replace(trees, left=grown), np.zeros(0, np.int64))
        ended, rest = self.ended, np.flatnonzero(self.ended < 0)
        if (grown != trees.left).any():
            # Rows that the tree has seen ended further down.
            parent = np.full(len(grown), -1)
            inner = np.flatnonzero(grown >= 0)
            parent[grown[inner]], parent[grown[inner] + 1] = inner, inner
            top = np.arange(len(grown))
            for node in range(1, len(grown)):
                up = parent[node]
                if top[up] != up or trees.left[up] < 0:
                    top[node] = top[up]
            ended = picked(top, np.maximum(ended, 0))
        ended[rest] = walked(trees, self.block, rest)[0]
        return ended


def walked(trees: Trees, block: Mapping, base: np.ndarray, depths: Sequence[int] = (0,)) -> list[np.ndarray]:
    """For each depth (0: no bound), the node of the first tree in which each of some rows of a block ends after so many levels."""
    first, feature, cut = trees.left.astype(np.intp), trees.feature.astype(np.intp), trees.cut.astype(np.uint8)
    flat, table, column = block["codes"].ravel(), block["table"].ravel(), block["column"][feature] * len(block["label"])
    whole, stops = np.zeros(len(base), np.intp), {}
    open_, node, level = None, whole, 0
    while True:
        if level and level in depths:
            stops[level] = whole.copy()
        below = picked(first, node)
        inner = np.flatnonzero(below >= 0)
        if not len(inner):
            return [stops.get(d, whole) for d in depths]
        if len(inner) < len(node):
            open_ = inner if open_ is None else picked(open_, inner)
            base, node, below = picked(base, inner), picked(node, inner), picked(below, inner)
        node = below + (bins_of(flat, base, table, column, feature, node) > picked(cut, node))
        if open_ is None:
            whole = node
        else:
            whole[open_] = node
        level += 1


#: A tree as a table of nodes in order of their levels: feature, threshold, first child, value, gain, cover; -1 as first child marks a leaf.
COLUMNS = ((0, "<i2"), (1, "<f8"), (2, "<i4"), (3, "<f8"), (4, "<f8"), (5, "<f8"))


def tree_table(trees: Trees, root: int, borders: Sequence[Sequence[float]]) -> np.ndarray:
    levels, node = [], np.array([root])
    while len(node):
        levels.append(node)
        first = trees.left[node]
        node = (first[first >= 0][:, None] + np.arange(2)).ravel()
    order = np.concatenate(levels)
    inner = trees.left[order] >= 0
    table = np.zeros((len(order), 6))
    # The children of the k-th inner node follow those of the inner nodes before it.
    table[:, 0], table[:, 2] = -1.0, np.where(inner, 2 * np.cumsum(inner) - 1, -1)
    table[:, 3], table[:, 5] = trees.value[order], trees.cover[order]
    split = order[inner]
    table[inner, 0], table[inner, 4] = trees.feature[split], trees.gain[split]
    starts = np.concatenate(([0], np.cumsum([len(b) for b in borders])))
    table[inner, 1] = np.concatenate([np.asarray(b, np.float64) for b in borders] or [np.zeros(0)])[starts[trees.feature[split]] + trees.cut[split]]
    return table


def packed_tree(table: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(table[:, i]).astype(kind).tobytes() for i, kind in COLUMNS), 1)


def unpacked_tree(packed: bytes) -> np.ndarray:
    held, at = zlib.decompress(packed), 0
    n = len(held) // sum(np.dtype(kind).itemsize for _, kind in COLUMNS)
    table = np.empty((n, 6))
    for i, kind in COLUMNS:
        table[:, i] = np.frombuffer(held, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return table


@dataclass(frozen=True)
class StoredTrees:
    """The first `rounds` trees of a fit, packed, in files of the shared folder with rows (`number`, `tree`)."""

    files: tuple[str, ...]
    rounds: int

    def first(self, rounds: int) -> StoredTrees:
        return replace(self, rounds=min(rounds, self.rounds))

    def numbered(self, files: Iterable[str] | None = None) -> Iterator[tuple[int, bytes]]:
        for file in self.files if files is None else files:
            system, path = FileSystem.from_uri(file)
            with system.open_input_file(path) as f:
                table = pq.read_table(f)
            for number, tree in zip(table["number"].to_pylist(), table["tree"].to_pylist()):
                if number <= self.rounds:
                    yield number, tree

    def __iter__(self) -> Iterator[bytes]:
        return (tree for _, tree in sorted(self.numbered()))

    def at_hand(self) -> StoredTrees | list[bytes]:
        """Itself where tasks can open the files; on file systems that only Spark reads, the packed trees."""
        try:
            FileSystem.from_uri(self.files[0])
            return self
        except (pa.ArrowException, OSError):
            rows = SparkSession.active().read.parquet(*self.files).where(F.col("number") <= self.rounds).orderBy("number").collect()
            return [bytes(r["tree"]) for r in rows]


_TREES = "place int, number int, tree binary"


def _store_trees(trees: DataFrame, folder: str) -> None:
    trees.coalesce(TREE_FILES).write.mode("append").partitionBy("place").parquet(folder)


def _stored(spark: SparkSession, folder: str, place: int, rounds: int) -> StoredTrees:
    return StoredTrees(tuple(sorted(spark.read.parquet(f"{folder}/place={place}").inputFiles())), rounds)


#: Wanted scores of a fit: (rounds, depth, least rows of a node that is split).
Reports = Mapping[int, Sequence[tuple[int, int, int]]]


def limited(trees: Trees, least: int, roots: int) -> Trees:
    """The trees that nodes of fewer rows do not split; the first nodes are the roots, which always do."""
    small = trees.cover < least
    small[:roots] = False
    return replace(trees, left=np.where(small, -1, trees.left)) if small.any() else trees


def _grown_alone(block: Mapping, fit: Fit, number: int, layout: Layout, seed: int) -> tuple[Trees, np.ndarray | None]:
    """One tree over one block, and for boosted trees the leaf of every row."""
    job = (0, fit, number)
    growing = (ForestTree if fit.forest else BoostedTree)(block, job, layout, seed)
    grown = []
    trees = grow(growing, [job], layout, seed, grown.append)
    return trees, None if fit.forest else growing.leaves(trees, grown[0])


def _run_alone(block: Mapping, place: int, fit: Fit, base: float, layout: Layout, wanted: Sequence[tuple[int, int, int]], seed: int, of_tree: Callable) -> Iterator[tuple]:
    """A whole fit over one block: what of_tree makes of its trees, by place and number, and by place and wanted scores the labels and scores of held-out rows."""
    own = dict(block, scores=np.full((1, len(block["label"])), base))
    held = np.flatnonzero(block["fold"] == fit.fold) if fit.fold >= 0 else np.zeros(0, np.int64)
    views = sorted({w[1:] for w in wanted}) if fit.forest else [(fit.depth, 0)]
    totals = {v: np.zeros(len(held if fit.forest else block["label"])) for v in views}
    for number in range(1, fit.rounds + 1):
        trees, leaf = _grown_alone(own, fit, number, layout, seed)
        if fit.forest:
            for least in {least for _, least in views}:
                depths = [d for d, l in views if l == least]
                for d, ends in zip(depths, walked(limited(trees, least, 1), block, held, depths)):
                    totals[d, least] += picked(trees.value, ends)
        else:
            totals[views[0]] += picked(trees.value, leaf)
            own["scores"] = (base + totals[views[0]])[None, :]
        if fit.fold < 0:
            yield "tree", place, number, of_tree(tree_table(trees, 0, layout.borders))
        for rounds, *view in wanted:
            if rounds == number and fit.fold >= 0:
                found = totals[tuple(view)] / number if fit.forest else base + totals[views[0]][held]
                yield "scores", place, (rounds, *view), (block["label"][held].tobytes(), found.tobytes())


_SCORES = "place int, rounds int, depth int, least int, label double, score double"


def _unpacked_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            label, score = (pa.array(np.frombuffer(row[c])) for c in ("label", "score"))
            names = [pa.array(np.full(len(label), row[c], np.int32)) for c in ("place", "rounds", "depth", "least")]
            yield pa.RecordBatch.from_arrays([*names, label, score], names=["place", "rounds", "depth", "least", "label", "score"])


class BinnedTable:
    """An encoded table, binned once for any number of fits. A context manager: leaving it frees its blocks."""

    def __init__(self, encoded: DataFrame, features_col: str, width: int, key: str | None = None, fold_col: str | None = None, max_bins: int = MAX_BINS):
        self.spark = encoded.sparkSession
        self.layout = Layout(feature_borders(encoded, features_col, width, max_bins))
        self.packed = binned_blocks(encoded, self.layout.borders, features_col, key, fold_col).persist(StorageLevel.MEMORY_AND_DISK)
        fold = (F.col(fold_col) if fold_col else F.lit(-2)).alias("fold")
        self.by_fold = encoded.groupBy(fold).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("positive")).collect()
        self.rows = sum(r["n"] for r in self.by_fold)
        self._sent = None

    def __enter__(self) -> BinnedTable:
        return self

    def __exit__(self, *_) -> None:
        self.packed.unpersist()
        if isinstance(self._sent, Broadcast):
            self._sent.unpersist()

    def base(self, fit: Fit) -> float:
        """Log-odds of the rows that the fit learns from; 0 for forests."""
        n, positive = (sum(r[c] or 0 for r in self.by_fold if r["fold"] != fit.fold) for c in ("n", "positive"))
        share = min(max(positive / n if n else 0.5, 1e-6), 1 - 1e-6)
        return 0.0 if fit.forest else float(np.log(share / (1 - share)))

    def one_block(self):
        """All rows as one prepared block: a broadcast for tables of `BLOCKS_AT_ONCE` blocks at most, above that a file that a task writes."""
        if self._sent is None:
            layout = self.layout

            def whole(blocks: Iterable[Mapping]) -> dict:
                block = joined(list(blocks))
                # An order of their own, whatever partition the rows came from.
                order = np.lexsort((block["label"], block["hash"]))
                return prepared_block({c: _ordered(block.pop(c), order) for c in list(block)}, layout)

            if self.rows <= BLOCKS_AT_ONCE * BLOCK_ROWS:
                self._sent = self.spark.sparkContext.broadcast(whole(unpacked(r) for r in self.packed.collect()))
            else:
                folder = shared_folder(self.spark)
                written = self.packed.rdd.coalesce(1).mapPartitions(lambda rows: [StoredBlock.write(f"{folder}/{uuid.uuid4().hex}", whole(unpacked(r) for r in rows)).folder])
                self._sent = StoredBlock(written.collect()[0])
        return self._sent

    def opened_by_tasks(self) -> bool:
        """Whether the shared folder can be opened without Spark."""
        try:
            FileSystem.from_uri(shared_folder(self.spark))
            return True
        except (pa.ArrowException, OSError):
            return False

    def fit(self, fits: Sequence[Fit], reports: Reports | None = None, seed: int = RANDOM_SEED) -> tuple[dict[int, tuple[float, StoredTrees | list]], DataFrame | None]:
        """Base and stored trees of the fits without held-out rows by place, and the scores that reports asks for.

        fits are all boosted or all forests. Scores are rows (`place`, `rounds`, `depth`, `least`, `label`, `score`) of the rows that the
        fit held out; they are persisted. An empty table gives no trees.
        """
        bases, reports = [self.base(f) for f in fits], reports or {}
        if not self.rows:
            return {i: (bases[i], []) for i, f in enumerate(fits) if f.fold < 0}, None
        return self._run()(self, fits, bases, reports, seed)

    def _run(self) -> Callable:
        few = self.rows <= BLOCKS_AT_ONCE * BLOCK_ROWS or self.rows <= STORED_ROWS and self.opened_by_tasks()
        return _dealt if few else _side_by_side

    def gain_shares(self, fit: Fit, width: int, seed: int = RANDOM_SEED) -> np.ndarray:
        """gain_shares of the trees of a fit without held-out rows, which are not kept: a tree is its gains here."""
        if not self.rows:
            return np.zeros(width)
        grown, _ = self._run()(self, [fit], [self.base(fit)], {}, seed, lambda table: tree_gains(table, width, fit.forest))
        return shares_of(grown[0][1], width)


def _dealt(table: BinnedTable, fits: Sequence[Fit], bases: Sequence[float], reports: Reports, seed: int, of_tree: Callable | None = None):
    """Every task takes the one block and runs whole fits.

    Trees are stored; where of_tree is given, the driver gets what it makes of each.
    """
    context, sent, layout = table.spark.sparkContext, table.one_block(), table.layout
    # Longest fits first. The trees of a forest do not wait for each other: without scores it is cut in parts.
    order = sorted(range(len(fits)), key=lambda i: -fits[i].rounds * (fits[i].depth or 20))
    part = max(1, -(-sum(f.rounds for f in fits) // (4 * context.defaultParallelism)))
    tasks = [(i, a, min(a + part, fits[i].rounds)) if fits[i].forest and i not in reports else (i, 0, fits[i].rounds) for i in order
             for a in (range(0, fits[i].rounds, part) if fits[i].forest and i not in reports else [0])]

    make = of_tree or packed_tree

    def run(task):
        i, first, last = task
        block = ready_block(sent.value, layout)
        if not fits[i].forest or i in reports:
            return list(_run_alone(block, i, fits[i], bases[i], layout, reports.get(i, ()), seed, make))
        return [("tree", i, k, make(tree_table(_grown_alone(block, fits[i], k, layout, seed)[0], 0, layout.borders))) for k in range(first + 1, last + 1)]

    done = context.parallelize(tasks, len(tasks)).flatMap(run).persist(StorageLevel.MEMORY_AND_DISK)
    trees, whole = done.filter(lambda r: r[0] == "tree").map(lambda r: r[1:]), [i for i, f in enumerate(fits) if f.fold < 0]
    if of_tree:
        found = sorted(trees.collect(), key=lambda r: r[:2])
        kept = {i: (bases[i], [made for place, _, made in found if place == i]) for i in whole}
    else:
        # Grown by all tasks before few of them write.
        done.count()
        folder = shared_folder(table.spark)
        if any(fits[i].rounds for i in whole):
            _store_trees(table.spark.createDataFrame(trees.map(lambda r: (*r[:2], bytearray(r[2]))), _TREES), folder)
        kept = {i: (bases[i], _stored(table.spark, folder, i, fits[i].rounds) if fits[i].rounds else []) for i in whole}
    scores = None
    if reports:
        packed = done.filter(lambda r: r[0] == "scores").map(lambda r: (r[1], *r[2], *map(bytearray, r[3])))
        names = _SCORES.split(", ")
        packed = table.spark.createDataFrame(packed.coalesce(context.defaultParallelism), ", ".join([*names[:4], "label binary", "score binary"]))
        scores = packed.mapInArrow(_unpacked_scores, _SCORES).persist(StorageLevel.MEMORY_AND_DISK)
        scores.count()
    done.unpersist()
    return kept, scores


def _groups(owner: np.ndarray, cells: np.ndarray) -> list[tuple[int, int, int]]:
    """(tree, first node, node after the last) of groups of nodes of the same tree, with `GROUP_CELLS` cells or a single node."""
    groups, start = [], 0
    for at in range(len(owner)):
        if at == start:
            held = 0
        held += int(cells[at])
        if at + 1 == len(owner) or owner[at + 1] != owner[start] or held + cells[at + 1] > GROUP_CELLS:
            groups.append((int(owner[start]), start, at + 1))
            start = at + 1
    return groups


def _found_by_tasks(state: RDD, level: Level, jobs: Sequence[Job], layout: Layout, seed: int) -> tuple[np.ndarray, ...]:
    """Best splits of a level over all blocks: sums are shuffled by groups of nodes, and splits are found where they meet."""
    trees, active, width = level.trees, level.active, level.allowed.shape[1]
    chosen, limits, counted = np.packbits(level.allowed, axis=1), level.limits, counts_rows(jobs)
    groups = _groups(level.owner, level.allowed @ layout.sizes)

    def choice(first: int, last: int) -> Choice:
        return choice_of(np.unpackbits(chosen[first:last], axis=1, count=width).astype(bool), layout)

    def of_blocks(blocks):
        for block in blocks:
            tree = -1
            for g, (owner, first, last) in enumerate(groups):
                if owner != tree:
                    tree, drawn = owner, drawn_rows(block, jobs[owner], counted, seed, owner)
                    end = next((a for o, a, _ in groups[g:] if o != owner), len(active))
                    drawn.move(trees, block["bins"], active[first:end])
                mine = (drawn.node >= active[first]) & (drawn.node <= active[last - 1])
                some = drawn if mine.all() else Drawn(drawn.rows[mine], drawn.values[:, mine], drawn.node[mine])
                if len(some.rows):
                    slot = np.searchsorted(active[first:last], some.node)
                    if jobs[owner][1].forest:
                        yield g, chosen_histograms(block["bins"], some, slot, choice(first, last))
                    else:
                        columns = choice(first, first + 1).feature
                        yield g, shared_histograms(block["joint"], some, slot, last - first, columns, layout).reshape(len(some.values), -1)

    def split(item):
        g, sums = item
        _, first, last = groups[g]
        return g, best_splits(sums, choice(first, last), layout, limits[:, first:last])

    tasks = min(len(groups), state.context.defaultParallelism)
    met = state.mapPartitions(of_blocks).reduceByKey(lambda a, b: a + b, tasks).map(split).collect()
    values = 3 if counted else 2
    gain, feature, cut = np.zeros(len(active)), np.zeros(len(active), np.int64), np.zeros(len(active), np.int64)
    left, right = np.zeros((2, values, len(active)))
    for g, found in met:
        _, first, last = groups[g]
        gain[first:last], feature[first:last], cut[first:last], left[:, first:last], right[:, first:last] = found
    return gain, feature, cut, left, right


def _side_by_side(table: BinnedTable, fits: Sequence[Fit], bases: Sequence[float], reports: Reports, seed: int, of_tree: Callable | None = None):
    """All fits grow over all blocks in shared passes, a level a pass. Trees are stored, or kept as what of_tree makes of each."""
    spark, packed, layout = table.spark, table.packed, table.layout
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    forest = fits[0].forest
    # A line of scores for each fit; for forests one for each depth and least rows that are wanted.
    lines = [(i, *view) for i, f in enumerate(fits) for view in (sorted({w[1:] for w in reports.get(i, ())}) or [(f.depth, 0)] if forest else [(f.depth, 0)])]
    start = np.array([bases[line[0]] for line in lines])
    joint = (lambda b: {}) if forest else (lambda b: {"joint": joint_codes(b["bins"], layout.sizes)})
    state = packed.rdd.map(unpacked).map(lambda b: b | joint(b) | {"scores": np.repeat(start[:, None], len(b["label"]), axis=1)}).persist(StorageLevel.MEMORY_AND_DISK)
    older = None
    kept = {i: [] for i, f in enumerate(fits) if f.fold < 0}
    folder, waiting = shared_folder(spark), []

    def store() -> None:
        if waiting:
            _store_trees(spark.createDataFrame(spark.sparkContext.parallelize(waiting, min(len(waiting), TREE_FILES)), _TREES), folder)
            waiting.clear()

    wanted = sorted({r for own in reports.values() for r, *_ in own})
    parts = []
    number, last = 1, max(f.rounds for f in fits)
    while number <= last:
        live = [i for i, f in enumerate(fits) if f.rounds >= number]
        stop = number
        if forest:
            ends = [r for r in [*wanted, *(f.rounds for f in fits)] if r >= number]
            stop = min([number + max(1, TREES_AT_ONCE // len(live)) - 1, *ends])
        jobs = [(i, fits[i], k) for k in range(number, stop + 1) for i in live]

        trees = grow(lambda level, state=state, jobs=jobs: _found_by_tasks(state, level, jobs, layout, seed), jobs, layout, seed)

        def add(block, trees=trees, jobs=jobs):
            scores = block["scores"].copy()
            for line, (i, depth, least) in enumerate(lines):
                own = np.array([k for k, job in enumerate(jobs) if job[0] == i])
                if len(own):
                    cut = limited(trees, least, len(jobs)) if least else trees
                    scores[line] += trees.value[leaves_of(cut, block["bins"], own, depth if forest else 0)].sum(axis=0)
            return block | {"scores": scores}

        # The trees of a forest do not wait for scores that nothing asks for.
        if reports or not forest:
            if older is not None:
                older.unpersist()
            older, state = state, state.map(add).persist(StorageLevel.MEMORY_AND_DISK)
            if number // CHECKPOINT_ROUNDS != (stop + 1) // CHECKPOINT_ROUNDS:
                state.checkpoint()
                state.count()
        for k, (i, _, grown) in enumerate(jobs):
            if i in kept and of_tree:
                kept[i].append(of_tree(tree_table(trees, k, layout.borders)))
            elif i in kept:
                waiting.append((i, grown, bytearray(packed_tree(tree_table(trees, k, layout.borders)))))
        if sum(len(tree) for _, _, tree in waiting) > WAITING_BYTES:
            store()
        if stop in wanted:
            due = [(i, stop, *view, lines.index((i, *view))) for i, own in reports.items() for r, *view in own if r == stop and fits[i].fold >= 0]
            over = stop if forest else 1

            def held(block, due=due, over=over):
                for *names, line in due:
                    rows = np.flatnonzero(block["fold"] == fits[names[0]].fold)
                    yield from ((*names, a, b) for a, b in zip(block["label"][rows].tolist(), (block["scores"][line, rows] / over).tolist()))

            part = spark.createDataFrame(state.flatMap(held), _SCORES).persist(StorageLevel.MEMORY_AND_DISK)
            part.count()
            parts.append(part)
        number = stop + 1
    for rdd in (state, older):
        if rdd is not None:
            rdd.unpersist()
    scores = None
    for part in parts:
        scores = part if scores is None else scores.unionByName(part)
    store()
    if not of_tree:
        kept = {i: _stored(spark, folder, i, fits[i].rounds) if fits[i].rounds else [] for i in kept}
    return {i: (bases[i], trees) for i, trees in kept.items()}, scores


def score_rows(x: np.ndarray, trees: Iterable[np.ndarray]) -> np.ndarray:
    """Sum of the leaf values of all trees for the rows of x."""
    out, flat, width = np.zeros(len(x)), np.ascontiguousarray(x, np.float64).ravel(), x.shape[1]
    start = np.arange(0, len(x) * width, max(width, 1), dtype=np.intp)
    for table in trees:
        feature, first = table[:, 0].astype(np.intp), table[:, 2].astype(np.intp)
        threshold, value = np.ascontiguousarray(table[:, 1]), np.ascontiguousarray(table[:, 3])
        node, base, open_ = np.zeros(len(x), np.intp), start, None
        whole = node
        while True:
            below = picked(first, node)
            inner = np.flatnonzero(below >= 0)
            if not len(inner):
                break
            if len(inner) < len(node):
                open_ = inner if open_ is None else picked(open_, inner)
                base, node, below = picked(base, inner), picked(node, inner), picked(below, inner)
            node = below + (picked(flat, base + picked(feature, node)) > picked(threshold, node))
            if open_ is None:
                whole = node
            else:
                whole[open_] = node
        out += picked(value, whole)
    return out


def tree_gains(table: np.ndarray, width: int, forest: bool) -> np.ndarray:
    """Gain of the splits of a tree by feature; for forests its shares."""
    inner = table[:, 2] >= 0
    gains = np.bincount(table[inner, 0].astype(np.int64), table[inner, 4], width)
    return gains / gains.sum() if forest and gains.sum() else gains


def shares_of(gains: Iterable[np.ndarray], width: int) -> np.ndarray:
    total = np.zeros(width)
    for own in gains:
        total += own
    return total / total.sum() if total.sum() else total


def gain_shares(trees: Iterable[np.ndarray], width: int, forest: bool) -> np.ndarray:
    """Share of each feature in the gain of all splits; for forests the mean of the shares in each tree."""
    return shares_of((tree_gains(table, width, forest) for table in trees), width)


class _TreesWriter(DefaultParamsWriter):
    """Copies stored trees beside the parameters, so that a saved model stands by itself."""

    def saveImpl(self, path: str) -> None:
        model = self.instance
        held = json.loads(model.getOrDefault(model.trees))
        if "files" in held:
            SparkSession.active().read.parquet(*held["files"]).write.parquet(f"{path}/trees")
            model = model.copy({model.trees: json.dumps(held | {"files": None})})
        DefaultParamsWriter.saveMetadata(model, path, self.sparkSession)


class _TreesReader(DefaultParamsReader):
    def load(self, path: str) -> TreesModel:
        model = super().load(path)
        held = json.loads(model.getOrDefault(model.trees))
        if "files" in held:
            files = sorted(SparkSession.active().read.parquet(f"{path}/trees").inputFiles())
            model._set(trees=json.dumps(held | {"files": files}))
        return model


class _Columns(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "column that names a row, for sampling", TypeConverters.toString)


class TreesModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted ensemble; adds rawPrediction, probability and prediction. Trees are a parameter, so it is saved as a pipeline stage."""

    trees = Param(Params._dummy(), "trees", "kind, base score, number of features, and packed trees or the files that hold them, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees: str | None = None, featuresCol: str = "features"):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", keyCol=ROLES.key)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def write(self) -> _TreesWriter:
        return _TreesWriter(self)

    @classmethod
    def read(cls) -> _TreesReader:
        return _TreesReader(cls)

    def _source(self) -> tuple[dict, StoredTrees | list[bytes]]:
        """`forest`, `base`, `features`, and where the packed trees are."""
        held = json.loads(self.getOrDefault(self.trees))
        facts = {k: held[k] for k in ("forest", "base", "features")}
        if "files" in held:
            return facts, StoredTrees(tuple(held["files"]), held["rounds"]).at_hand()
        # Models saved before trees were packed hold them as lists.
        return facts, [base64.b64decode(t) if isinstance(t, str) else packed_tree(np.array(t, np.float64)) for t in held["trees"]]

    @property
    def held(self) -> dict:
        """`forest`, `base`, `features`, and `trees` as packed bytes."""
        facts, trees = self._source()
        return facts | {"trees": list(trees)}

    @property
    def ensemble(self) -> dict:
        """`forest`, `base`, `features`, and `trees` as lists of nodes."""
        held = self.held
        whole = lambda node: [int(node[0]), node[1], int(node[2]), *node[3:]]
        return held | {"trees": [[whole(n) for n in unpacked_tree(t).tolist()] for t in held["trees"]]}

    @property
    def featureImportances(self) -> DenseVector:
        """Share of each feature in the gain of all splits; for forests the mean of the shares in each tree."""
        facts, trees = self._source()
        width, forest = facts["features"], facts["forest"]
        if isinstance(trees, list):
            return DenseVector(gain_shares(map(unpacked_tree, trees), width, forest))

        # The gains of a tree reach the driver, one number a feature.
        def gains(file: str) -> list[tuple]:
            return [(number, tree_gains(unpacked_tree(tree), width, forest)) for number, tree in trees.numbered([file])]

        found = SparkSession.active().sparkContext.parallelize(trees.files, len(trees.files)).flatMap(gains).collect()
        return DenseVector(shares_of((own for _, own in sorted(found, key=lambda r: r[0])), width))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held, trees = self._source()
        base, rounds = held["base"], trees.rounds if isinstance(trees, StoredTrees) else len(trees)

        @F.pandas_udf("double")
        def total(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = None
            for x in parts:
                own = list(trees) if own is None else own
                yield pd.Series(score_rows(np.stack(x.to_numpy()), map(unpacked_tree, own))) if len(x) else pd.Series([], dtype="float64")

        s = F.col("_sum")
        scored = dataset.withColumn("_sum", total(vector_to_array(self.getOrDefault(self.featuresCol))))
        if held["forest"]:
            p = s / F.lit(float(rounds))
            raw = F.array(1 - p, p)
        else:
            margin = s + F.lit(base)
            p, raw = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)), F.array(-margin, margin)
        return scored.withColumns(
            {"rawPrediction": array_to_vector(raw), "probability": array_to_vector(F.array(1 - p, p)), "prediction": (p > 0.5).cast("double")}
        ).drop("_sum")


class _Trees(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    numLeaves = Param(Params._dummy(), "numLeaves", "leaves of a tree at most, 0 for no bound", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree, 0 for no bound", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "fewest rows of a leaf", TypeConverters.toInt)
    minInstancesPerSplit = Param(Params._dummy(), "minInstancesPerSplit", "fewest rows of a node that is split", TypeConverters.toInt)
    featureShare = Param(Params._dummy(), "featureShare", "share of features a tree, or a node of a forest", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the samples", TypeConverters.toInt)

    def _started(self, **defaults) -> None:
        defaults = {"numLeaves": 0, "minInstancesPerNode": 1, "minInstancesPerSplit": 2, "seed": RANDOM_SEED, "featuresCol": "features", "labelCol": "label", "keyCol": ROLES.key, **defaults}
        self._setDefault(**defaults)
        self._set(**self._input_kwargs)

    def settings(self, width: int, point: Mapping | None = None) -> Fit:
        """The Fit of these parameters, with those of a grid point over them."""
        raise NotImplementedError

    def _data(self, dataset: DataFrame) -> tuple[DataFrame, int, str | None]:
        label, features, key = (self.getOrDefault(p) for p in (self.labelCol, self.featuresCol, self.keyCol))
        data = dataset.withColumn("label", F.col(label)) if label != "label" else dataset
        first = data.select(F.size(vector_to_array(features)).alias("n")).first()
        return data, first["n"] if first else 0, key if key in dataset.columns else None

    def model(self, base: float, width: int, trees: StoredTrees | list, forest: bool) -> TreesModel:
        """trees are stored, packed or lists of nodes."""
        facts = {"forest": forest, "base": base, "features": width}
        if isinstance(trees, StoredTrees):
            return TreesModel(trees=json.dumps(facts | {"files": trees.files, "rounds": trees.rounds}), featuresCol=self.getOrDefault(self.featuresCol))
        texts = [base64.b64encode(t if isinstance(t, bytes) else packed_tree(np.array(t, np.float64))).decode() for t in trees]
        return TreesModel(trees=json.dumps(facts | {"trees": texts}), featuresCol=self.getOrDefault(self.featuresCol))

    def _fit(self, dataset: DataFrame) -> TreesModel:
        data, width, key = self._data(dataset)
        fit = self.settings(width)
        with BinnedTable(data, self.getOrDefault(self.featuresCol), width, key) as table:
            grown, _ = table.fit([fit], seed=self.getOrDefault(self.seed))
        return self.model(grown[0][0], width, grown[0][1], fit.forest)

    def search(self, train: DataFrame, points: Sequence[Mapping], folds: int, fold_col: str = "fold") -> tuple[int, list[list[float]], TreesModel]:
        """Best point by mean AUC over the folds, the AUC of every point and fold, and the refit of the best.

        Points that differ only in rounds, or for forests in depth and the fewest rows of a split node, share a fit, and so do
        those with more leaves than their depth allows. The refits of boosted trees run with the fits of the folds, as their rounds share passes; a forest is
        refitted once the best point is known.
        """
        data, width, key = self._data(train)
        wanted = [self.settings(width, p) for p in points]

        def whole(f: Fit) -> Fit:
            free = f.leaves is not None and f.depth and f.leaves >= 1 << f.depth
            return replace(f, rounds=0, depth=0 if f.forest else f.depth, leaves=None if free else f.leaves, least_split=2 if f.forest else f.least_split)

        def report(f: Fit) -> tuple[int, int, int]:
            return f.rounds, f.depth, max(2 * f.least_rows, f.least_split) if f.forest else 0

        longest: dict[Fit, int] = {}
        for f in wanted:
            longest[whole(f)] = max(longest.get(whole(f), 0), f.rounds)
        deepest = {w: 0 if any(not f.depth for f in wanted if whole(f) == w) else max(f.depth for f in wanted if whole(f) == w) for w in longest}
        forest = wanted[0].forest
        held_out = [*range(folds)] if forest else [*range(folds), -1]
        grown = [replace(w, rounds=r, depth=deepest[w] if w.forest else w.depth, fold=k) for w, r in longest.items() for k in held_out]
        place = {(w, k): i for i, (w, k) in enumerate((w, k) for w in longest for k in held_out)}
        reports = {place[w, k]: sorted({report(f) for f in wanted if whole(f) == w}) for w in longest for k in range(folds)}
        with BinnedTable(data, self.getOrDefault(self.featuresCol), width, key, fold_col) as table:
            kept, scores = table.fit(grown, reports, self.getOrDefault(self.seed))
            areas = self._areas(scores, wanted, folds, lambda f, k: (place[whole(f), k], *report(f)))
            means = [sum(a) / folds for a in areas]
            best = max(range(len(points)), key=lambda i: (means[i], -i))
            f = wanted[best]
            if forest:
                kept, _ = table.fit([f], seed=self.getOrDefault(self.seed))
            base, trees = kept[0 if forest else place[whole(f), -1]]
        return best, areas, self.model(base, width, trees.first(f.rounds) if isinstance(trees, StoredTrees) else trees, f.forest)

    @staticmethod
    def _areas(scores: DataFrame | None, wanted: Sequence[Fit], folds: int, place: Callable[[Fit, int], tuple[int, int, int, int]]) -> list[list[float]]:
        """AUC of every point and fold; 0.5 where there is none."""
        from ebbline.operators.evaluate import roc_auc

        areas = [[0.5] * folds for _ in wanted]
        if scores is not None:
            model = F.concat_ws(":", "place", "rounds", "depth", "least").alias("model")
            held = scores.select(model, F.col("label").cast("int").alias("label"), F.col("score").alias("probability"), F.lit(0).alias("prediction"))
            found = {r["model"]: r["roc_auc"] for r in roc_auc(held, "model").collect()}
            scores.unpersist()
            for i, f in enumerate(wanted):
                for k in range(folds):
                    area = found.get(":".join(map(str, place(f, k))))
                    areas[i][k] = 0.5 if area is None else area
        return areas


class BoostedTrees(_Trees):
    """Boosted trees with logistic loss, regularised leaf values and, with numLeaves, best-first trees."""

    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of rows a round", TypeConverters.toFloat)
    minWeight = Param(Params._dummy(), "minWeight", "least sum of Hessians in a leaf", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "added to the Hessians of a leaf", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, maxIter=100, maxDepth=6, stepSize=0.3, subsamplingRate=1.0, featureShare=1.0, numLeaves=0, minInstancesPerNode=1,
                 minWeight=1.0, penalty=1.0, seed=RANDOM_SEED, featuresCol="features", labelCol="label"):
        super().__init__()
        self._started(maxIter=100, maxDepth=6, stepSize=0.3, subsamplingRate=1.0, featureShare=1.0, minWeight=1.0, penalty=1.0)

    def settings(self, width: int, point: Mapping | None = None) -> Fit:
        v = {p.name: self.getOrDefault(p) for p in self.params} | dict(point or {})
        return Fit(
            rounds=v["maxIter"], depth=v["maxDepth"], rate=v["stepSize"], rows_share=v["subsamplingRate"], features_share=v["featureShare"],
            leaves=v["numLeaves"] or None, least_rows=v["minInstancesPerNode"], least_split=v["minInstancesPerSplit"], least_weight=v["minWeight"], penalty=v["penalty"],
        )


class Forest(_Trees):
    """Random forest: bootstrap weights a tree, the root of the number of features a node, Gini splits, mean leaf shares."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, numTrees=100, maxDepth=0, numLeaves=0, minInstancesPerNode=1, minInstancesPerSplit=2, featureShare=0.0, seed=RANDOM_SEED,
                 featuresCol="features", labelCol="label"):
        super().__init__()
        self._started(numTrees=100, maxDepth=0, featureShare=0.0)

    def settings(self, width: int, point: Mapping | None = None) -> Fit:
        v = {p.name: self.getOrDefault(p) for p in self.params} | dict(point or {})
        return Fit(
            rounds=v["numTrees"], depth=v["maxDepth"], features_share=v["featureShare"] or max(width, 1) ** 0.5 / max(width, 1), leaves=v["numLeaves"] or None,
            least_rows=v["minInstancesPerNode"], least_split=v["minInstancesPerSplit"], least_weight=0.0, penalty=0.0, forest=True,
        )
