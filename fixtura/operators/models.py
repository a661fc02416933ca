"""Outcome models: multinomial logistic regression, histogram boosting, sigmoid calibration, blending.

Models are fitted on all labelled rows of their training window. The rows are split over the tasks that
run at the same time; these fit a model together, by sums that go straight between executors, and find
the same trees as one task with all rows. A grid on few rows (`MOST_ROWS`) is fitted a configuration a
task instead. Fitted models go to the executors and score every row of the validation window.
"""

from __future__ import annotations

import os
import pickle
import secrets
import socket
from collections.abc import Callable, Generator, Iterator
from functools import reduce
from multiprocessing.connection import Client, Listener

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtura.operators.gold import chronological_partition
from fixtura.session import cut_lineage

#: Labelled rows up to which a task fits models alone; it bounds no fit (see `fit_groups`).
MOST_ROWS = 200_000
#: Rows whose bins stay in a processor's cache while all trees score them.
SCORED_AT_ONCE = 8192
#: Rows whose products of features are in memory at once.
MULTIPLIED_AT_ONCE = 2048
PROBABILITIES = ("probability_away_win", "probability_draw", "probability_home_win")
C_VALUES = (0.001, 0.01, 0.1, 0.5, 1.0, 2.0, 10.0, 100.0)
#: Iterations, learning rate, leaves, least rows of a leaf, penalty.
BOOSTING = ((200, 0.03, 7, 20, 1.0), (200, 0.05, 7, 20, 1.0), (300, 0.05, 15, 20, 1.0), (300, 0.05, 15, 30, 5.0), (400, 0.03, 31, 30, 5.0), (500, 0.02, 15, 40, 10.0))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def log_loss(p: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(np.clip(p[np.arange(len(y)), y], 2.220446049250313e-16, 1)).mean())


class _Alone:
    """The holder of all rows: what all have together is its own."""

    number, many = 0, 1

    def all(self, own: object) -> list:
        return [own]

    def at_first(self, own: np.ndarray, work: Callable[[np.ndarray], object]) -> object:
        return work(own)

    def total(self, own: np.ndarray) -> np.ndarray:
        return own


ALONE = _Alone()


class _Peers(_Alone):
    """The tasks of one job, each of which holds a share of the rows. What they have together goes by way
    of the first one, straight between executors."""

    def __init__(self, context: BarrierTaskContext, key: bytes) -> None:
        self.number, tasks = context.partitionId(), context.getTaskInfos()
        self.many = len(tasks)
        if self.number:
            port = int(context.allGather("")[0])
            self.links = [Client((tasks[0].address.rsplit(":", 1)[0], port), authkey=key)]
            self.links[0].send(self.number)
        else:
            with Listener(("0.0.0.0", 0), backlog=self.many, authkey=key) as listener:  # noqa: S104
                context.allGather(str(listener.address[1]))
                came = [listener.accept() for _ in range(self.many - 1)]
            self.links = [link for _, link in sorted(((link.recv(), link) for link in came), key=lambda c: c[0])]
        for link in self.links:
            with socket.socket(fileno=os.dup(link.fileno())) as own:
                own.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def all(self, own: object) -> list:
        """What each task has, in order of tasks."""
        if self.number:
            self.links[0].send(own)
            return self.links[0].recv()
        found = [own, *(link.recv() for link in self.links)]
        for link in self.links:
            link.send(found)
        return found

    def at_first(self, own: np.ndarray, work: Callable[[np.ndarray], object]) -> object:
        """What the first task makes of the values of all."""
        if self.number:
            self.links[0].send(own)
            return self.links[0].recv()
        found = work(np.concatenate([own, *(link.recv() for link in self.links)]))
        for link in self.links:
            link.send(found)
        return found

    def total(self, own: np.ndarray) -> np.ndarray:
        """The sum over tasks of arrays of the same shape."""
        if self.number:
            self.links[0].send_bytes(own.tobytes())
            return np.frombuffer(self.links[0].recv_bytes(), own.dtype).reshape(own.shape)
        whole = own.copy()
        for link in self.links:
            whole += np.frombuffer(link.recv_bytes(), own.dtype).reshape(own.shape)
        for link in self.links:
            link.send_bytes(whole.tobytes())
        return whole


class Logistic:
    """Standardised multinomial logistic regression, C times the loss plus half the squared weights,
    by Newton steps; constant columns count as 0."""

    def __init__(self, c: float = 0.1, balanced: bool = False) -> None:
        if not (np.isfinite(c) and c > 0):
            raise ValueError("c must be positive")
        self.c, self.balanced = c, balanced

    def _prepare(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.scale * (self.scale < np.inf), np.ones(len(x))]

    def fit(self, x: np.ndarray, y: np.ndarray, peers: _Alone = ALONE) -> Logistic:
        if peers.many > 1:
            return fit_logistics(lambda work: peers.all(work(_few_at_once(x, y))), x.shape[1], [self])[0]
        if set(np.unique(y)) != {0, 1, 2}:
            raise ValueError("training needs all three classes")
        self.mean, sd = x.mean(0), x.std(0)
        self.scale = np.where(sd > 0, sd, np.inf)
        z = self._prepare(x)
        n, k = z.shape
        weight = (n / (3 * np.bincount(y, minlength=3)))[y] if self.balanced else np.ones(n)
        ridge = np.r_[np.ones(k - 1), 1e-8]
        w, hot = np.zeros((k, 3)), np.eye(3)[y]
        for _ in range(100):
            p = _softmax(z @ w)
            slope = self.c * z.T @ (weight[:, None] * (p - hot)) + ridge[:, None] * w
            curve = np.zeros((3 * k, 3 * k))
            for a in range(3):
                for b in range(3):
                    v = weight * p[:, a] * ((a == b) - p[:, b])
                    curve[a * k : (a + 1) * k, b * k : (b + 1) * k] = self.c * (z * v[:, None]).T @ z + (a == b) * np.diag(ridge)
            step = np.linalg.solve(curve + 1e-9 * np.eye(3 * k), slope.T.ravel()).reshape(3, k).T
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.w = w
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self._prepare(x) @ self.w)


def _fixed(v: np.ndarray) -> np.ndarray:
    """Values in [-1, 1] as multiples of 2**-30: the sums of four million of them are exact in any order."""
    return np.round(v * 2.0**30) * 2.0**-30


class _Packs:
    """Sums per feature and bin out of sums over packs of features: features that depend on each other
    have few combinations of bins, so one pass over the rows counts for all of a pack."""

    def __init__(self, codes: np.ndarray, bins: int, most: int = 1024) -> None:
        self.shape, self.joint = (3, len(codes), bins + 1), []
        if not codes.shape[1]:
            return
        packs: list = []  # combination of each row, number of combinations, features
        for j, own in enumerate(codes):
            single, fit = np.unique(own, return_inverse=True)[1], []
            width = int(single.max()) + 1
            for k, (joint, n, _) in enumerate(packs):
                both = np.bincount(joint * width + single, minlength=n * width) > 0
                if (m := int(both.sum())) <= most:
                    fit.append((m / n, m, k, both))
            if fit and min(fit)[0] < width:
                _, m, k, both = min(fit, key=lambda f: f[:3])
                packs[k] = ((np.cumsum(both) - 1)[packs[k][0] * width + single], m, [*packs[k][2], j])
            else:
                packs.append((single, width, [j]))
        self.counts, cell, at, low = [p[1] for p in packs], [], [], 0
        for joint, n, features in packs:
            example = np.empty(n, int)
            example[joint] = np.arange(len(joint))
            self.joint.append(joint.astype(np.intp))
            for j in features:
                cell.append(low + np.arange(n))
                at.append(j * (bins + 1) + codes[j].take(example).astype(int))
            low += n
        self.cell, self.at = np.concatenate(cell), np.concatenate(at)
        self.rows = self._spread(np.concatenate([np.bincount(c, minlength=n) for c, n in zip(self.joint, self.counts, strict=True)]))

    def _spread(self, sums: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, sums.take(self.cell), self.shape[1] * self.shape[2])

    def sums(self, g: np.ndarray, h: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
        """(3, features, bins): gradients, curvatures and number of `rows` (None: all)."""
        if not self.joint:
            return np.zeros(self.shape)
        if rows is not None:
            g, h = g.take(rows), h.take(rows)
        found: list = [[], [], []]
        for joint, n in zip(self.joint, self.counts, strict=True):
            c = joint if rows is None else joint.take(rows)
            found[0].append(np.bincount(c, g, n))
            found[1].append(np.bincount(c, h, n))
            if rows is not None:
                found[2].append(np.bincount(c, minlength=n))
        return np.stack([self._spread(np.concatenate(f)) if f else self.rows for f in found]).reshape(self.shape)


def _in_step(growing: list[Generator], peers: _Alone) -> list:
    """What generators return that yield sums over their own rows and are sent those over all."""
    found: list = [None] * len(growing)
    asked = {k: next(g) for k, g in enumerate(growing)}
    while asked:
        whole = peers.total(np.concatenate([a.ravel() for a in asked.values()]))
        for k, part in zip(list(asked), np.split(whole, np.cumsum([a.size for a in asked.values()])[:-1]), strict=True):
            try:
                asked[k] = growing[k].send(part.reshape(asked[k].shape))
            except StopIteration as end:
                found[k] = end.value
                del asked[k]
    return found


class Boosting:
    """Multinomial gradient boosting on histograms with leaf-wise trees (Friedman 2001)."""

    def __init__(self, iterations: int = 60, rate: float = 0.1, leaves: int = 15, least: int = 20, penalty: float = 1.0, bins: int = 64) -> None:
        if min(iterations, leaves - 1, least) < 1 or rate <= 0 or penalty < 0:
            raise ValueError("boosting parameters out of range")
        self.iterations, self.rate, self.leaves, self.least, self.penalty, self.bins = iterations, rate, leaves, least, penalty, bins

    def _codes(self, x: np.ndarray) -> np.ndarray:
        """One row per feature, of the bins of its values."""
        small = np.min_scalar_type(self.bins)
        return np.stack([np.searchsorted(e, x[:, j], side="right").astype(small) for j, e in enumerate(self.edges)])

    def _best(self, table: np.ndarray) -> tuple[float, int, int]:
        """(gain, feature, last bin on the left) of the best split, by (3, features, bins) sums of gradients, curvatures and rows."""
        gs, hs, ns = np.cumsum(table, 2)[:, :, :-1]
        gt, ht, nt = table[:, 0].sum(1)
        ok = (ns >= self.least) & (nt - ns >= self.least)
        if not ok.any():
            return 1e-12, -1, -1
        penalty = self.penalty + 1e-9
        gain = np.where(ok, gs**2 / (hs + penalty) + (gt - gs) ** 2 / (ht - hs + penalty) - gt**2 / (ht + penalty), -1)
        j, at = divmod(int(gain.argmax()), gain.shape[1])
        return (float(gain[j, at]), j, at) if gain[j, at] > 1e-12 else (1e-12, -1, -1)

    def _tree(self, codes: np.ndarray, packs: _Packs, g: np.ndarray, h: np.ndarray) -> Generator[np.ndarray, np.ndarray, tuple[list, np.ndarray]]:
        """Yields sums over its own rows, is sent those over all, and returns (nodes, value of each of its
        rows); of two parts only the smaller one is counted, the other is the rest."""
        nodes: list = [[-1, -1, -1, -1, 0.0]]
        table = yield packs.sums(g, h, None)
        open_ = {0: (np.arange(len(g)), table, self._best(table))}
        leaves = 1
        done = {}
        while open_ and leaves < self.leaves:
            node = max(open_, key=lambda k: open_[k][2][0])
            rows, table, (_, j, at) = open_.pop(node)
            if j < 0:
                done[node] = rows
                continue
            left = codes[j].take(rows) <= at
            nodes[node][:4] = j, at, len(nodes), len(nodes) + 1
            parts = [rows[left], rows[~left]]
            leaves += 1
            if leaves < self.leaves:
                less = int(2 * table[2, j, : at + 1].sum() > table[2, j].sum())
                tables = [(yield packs.sums(g, h, parts[less]))]
                tables.insert(1 - less, table - tables[0])
            for k, part in enumerate(parts):
                open_[len(nodes)] = (part, tables[k], self._best(tables[k])) if leaves < self.leaves else (part,)
                nodes.append([-1, -1, -1, -1, 0.0])
        value, ends = np.empty(len(g)), {**done, **{k: v[0] for k, v in open_.items()}}
        sums = yield np.array([(g.take(rows).sum(), h.take(rows).sum()) for rows in ends.values()])
        for (node, rows), (slope, curve) in zip(ends.items(), sums, strict=True):
            nodes[node][4] = value[rows] = -slope / (curve + self.penalty + 1e-9)
        return nodes, value

    @staticmethod
    def _walk(nodes: list, codes: np.ndarray) -> np.ndarray:
        """The value of the leaf of each row; which rows are in a node is known when its turn comes, as
        children stand behind their parents."""
        small = np.min_scalar_type(len(nodes))
        leaf, inside = np.zeros(codes.shape[1], small), {0: np.ones(codes.shape[1], bool)}
        for k, (j, at, left, right, _) in enumerate(nodes):
            own = inside.pop(k)
            if j >= 0:
                inside[left] = own & (codes[j] <= at)
                inside[right] = own ^ inside[left]
            else:
                leaf |= own * small.type(k)
        return np.array([n[4] for n in nodes]).take(leaf)

    def fit(self, x: np.ndarray, y: np.ndarray, peers: _Alone = ALONE) -> Boosting:
        """The same on whatever shares the rows are: edges come of whole columns, sums are exact in any order."""
        classes = peers.total(np.bincount(y, minlength=3))
        if len(classes) != 3 or not classes.all():
            raise ValueError("training needs all three classes")
        within = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [peers.at_first(x[:, j], lambda column: np.unique(np.quantile(column, within))) for j in range(x.shape[1])]
        codes, hot = self._codes(x), np.eye(3)[y].T
        packs = _Packs(codes, self.bins)
        self.start = np.log(np.clip(classes / classes.sum(), 1e-9, 1))
        raw, self.trees = np.tile(self.start[:, None], (1, len(y))), []
        for _ in range(self.iterations):
            p = _softmax(raw.T).T
            grown = _in_step([self._tree(codes, packs, _fixed(p[k] - hot[k]), _fixed(p[k] * (1 - p[k]))) for k in range(3)], peers)
            for k, (_, value) in enumerate(grown):
                raw[k] += self.rate * value
            self.trees.append([nodes for nodes, _ in grown])
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.start, (len(x), 1))
        for low in range(0, len(x), SCORED_AT_ONCE):
            codes = self._codes(x[low : low + SCORED_AT_ONCE])
            part = np.zeros((3, codes.shape[1]))
            for round_ in self.trees:
                for k, nodes in enumerate(round_):
                    part[k] += self._walk(nodes, codes)
            out[low : low + SCORED_AT_ONCE] += self.rate * part.T
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.raw(x))


class Sigmoid:
    """One-vs-rest sigmoid calibration (Platt 1999) of raw scores, made to sum to one."""

    def fit(self, raw: np.ndarray, y: np.ndarray, peers: _Alone = ALONE) -> Sigmoid:
        self.ab = []
        for k in range(3):
            f, (pos, n) = raw[:, k], peers.total(np.array([(y == k).sum(), len(y)]))
            t = np.where(y == k, (pos + 1) / (pos + 2), 1 / (n - pos + 2))
            a, b = 1.0, 0.0
            for _ in range(100):
                p = 1 / (1 + np.exp(-(a * f + b)))
                v = np.maximum(p * (1 - p), 1e-12)
                sums = peers.total(np.array([(f * (p - t)).sum(), (p - t).sum(), (f * f * v).sum(), (f * v).sum(), v.sum()]))
                step = np.linalg.solve(sums[[2, 3, 3, 4]].reshape(2, 2) + 1e-9 * np.eye(2), sums[:2])
                a, b = a - step[0], b - step[1]
                if np.abs(step).max() < 1e-10:
                    break
            self.ab.append((a, b))
        return self

    def predict(self, raw: np.ndarray) -> np.ndarray:
        p = np.stack([1 / (1 + np.exp(-(a * raw[:, k] + b))) for k, (a, b) in enumerate(self.ab)], 1)
        return p / p.sum(1, keepdims=True)


def permutation_importance(predict: Callable[[np.ndarray], np.ndarray], x: np.ndarray, y: np.ndarray, repeats: int = 20, seed: int = 42, columns: list[int] | None = None) -> np.ndarray:
    """(columns, 2): mean and deviation of how much log loss a shuffled column adds."""
    rng, base = np.random.default_rng(seed), log_loss(predict(x), y)
    columns = list(range(x.shape[1])) if columns is None else columns
    out = np.zeros((len(columns), repeats))
    for k, j in enumerate(columns):
        for r in range(repeats):
            z = x.copy()
            z[:, j] = rng.permutation(z[:, j])
            out[k, r] = log_loss(predict(z), y) - base
    return np.c_[out.mean(1), out.std(1)]


def _block(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def kept_rows(df: DataFrame, features: list[str], *others: str) -> DataFrame:
    """(split, rows): the labelled rows of training and validation, as `kept_labelled`."""
    return kept_labelled(df.filter("split in ('train', 'validation')"), "split", features, *others)


def kept_labelled(df: DataFrame, by: str | Column, features: list[str], *others: str) -> DataFrame:
    """(split, rows): the labelled rows as compressed blocks, each of one value of `by`, of targets,
    features and other columns, kept: what makes them (the ratings are one long task) runs once."""
    rows = df.filter("target is not null").select((F.col(by) if isinstance(by, str) else by).alias("split"), F.col("target").cast("int").alias("target"), *[F.col(c).cast("double").alias(c) for c in features], *others)

    def packed(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            splits = batch.column("split")
            for split in splits.unique().to_pylist():
                own = batch.filter(pc.equal(splits, split))
                yield pa.RecordBatch.from_arrays([pa.array([split]), pa.array([_block(own.select(own.schema.names[1:]))])], ["split", "rows"])

    return cut_lineage(rows.mapInArrow(packed, "split string, rows binary"))


def _unpacked(kept: DataFrame, like: DataFrame, columns: list[str], *splits: str) -> DataFrame:
    """The rows of some splits out of `kept_labelled`, their columns typed as in `like`."""

    def unpacked(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for rows in batch.column("rows"):
                yield from (b.select(columns) for b in pa.ipc.open_stream(rows.as_py()))

    return kept.filter(F.col("split").isin(*splits)).select("rows").mapInArrow(unpacked, like.select(*columns).schema)


def _rows(df: DataFrame, features: list[str]) -> DataFrame:
    """Kickoff micros, targets and features of the labelled rows."""
    return df.filter("target is not null").select(F.unix_micros(F.col("kickoff_utc").cast("timestamp")).alias("_at"), F.col("target").cast("int").alias("target"), *[F.col(c).cast("double").alias(c) for c in features])


def latest_rows(df: DataFrame, features: list[str], most_rows: float = np.inf) -> DataFrame:
    """(part, number, rows): the latest labelled rows (infinite: all), the last first, as compressed
    blocks of kickoff micros, targets and features."""
    latest = df.filter("target is not null").orderBy(F.desc("kickoff_utc"), F.desc("match_key"))
    latest = latest if most_rows == np.inf else latest.limit(most_rows)

    def packed(batches):  # noqa: ANN001, ANN202
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([k]), pa.array([_block(batch)])], ["part", "number", "rows"])

    return _rows(latest, features).mapInArrow(packed, "part long, number long, rows binary")


def _matrix(blocks: list, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, targets, kickoff micros), in order of time, of the blocks of `latest_rows`."""
    read = [pa.ipc.open_stream(rows).read_all() for _, _, rows in sorted(blocks)]
    if not read:
        return np.zeros((0, width)), np.zeros(0, int), np.zeros(0, int)
    whole = pa.concat_tables(read)
    x = np.empty((len(whole), width))
    for j in range(width):
        x[:, j] = whole.column(2 + j).to_numpy()[::-1]
    return x, whole.column(1).to_numpy()[::-1].astype(int), whole.column(0).to_numpy()[::-1]


def _share(blocks: Iterator[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `_matrix`, of blocks in any order; columns are freed as they are copied."""
    read = [pa.ipc.open_stream(rows).read_all() for rows in blocks]
    if not read:
        return np.zeros((0, width), order="F"), np.zeros(0, int), np.zeros(0, "int64")
    columns = pa.concat_tables(read).columns[::-1]
    read.clear()
    at, y = columns.pop().to_numpy(), columns.pop().to_numpy().astype(int)
    order = np.argsort(at, kind="stable")
    x = np.empty((len(at), width), order="F")
    for j in range(width):
        x[:, j] = columns.pop().to_numpy()[order]
    return x, y[order], at[order]


def _shares(spark: SparkSession) -> int:
    """How many tasks can run at the same time; one where executors come and go, as tasks that talk to each other cannot."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 1
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def fit_groups(groups: list[tuple[DataFrame, list]], features: list[str]) -> list[list]:
    """What the models of each group give when fitted on all labelled rows of its frame. The rows are
    split over as many tasks as run at the same time, which fit each model together. Of at most
    `MOST_ROWS` rows for no fewer models than tasks, each task gets all rows and fits models of its own."""
    return [_fit_group(df, models, features) for df, models in groups]


def _fit_group(df: DataFrame, models: list, features: list[str]) -> list:
    spark = df.sparkSession
    many, width, key, most = _shares(spark), len(features), secrets.token_bytes(32), MOST_ROWS
    every = spark.sparkContext.broadcast(pickle.dumps(models))

    def packed(batches):  # noqa: ANN001, ANN202
        return (pa.RecordBatch.from_arrays([pa.array([_block(batch)])], ["rows"]) for batch in batches)

    def fit(rows):  # noqa: ANN001, ANN202
        own = _share((bytes(r[0]) for r in rows), width)
        peers = _Peers(BarrierTaskContext.get(), key) if many > 1 else ALONE
        models = pickle.loads(every.value)  # noqa: S301
        apart = many <= len(models) and peers.total(np.array([len(own[1])]))[0] <= most
        if apart:
            x, y, at = (np.concatenate(a) for a in zip(*peers.all(own), strict=True))
            order = np.argsort(at, kind="stable")
            own = x[order], y[order], at[order]
        for k in range(peers.number if apart else 0, len(models), many if apart else 1):
            with_whom, model = ALONE if apart else peers, models[k]
            fitted = model.fit_in_time(*own, with_whom) if hasattr(model, "fit_in_time") else model.fit(*own[:2], with_whom)
            if apart or not peers.number:
                yield k, pickle.dumps(fitted)

    shares = _rows(df, features).mapInArrow(packed, "rows binary").repartition(many).rdd
    fitted = dict((shares.barrier() if many > 1 else shares).mapPartitions(fit).collect())
    every.destroy()
    return [pickle.loads(fitted[k]) for k in range(len(models))]  # noqa: S301


def fit_all(df: DataFrame, features: list[str], models: list) -> list:
    """The models fitted on all labelled rows of `df`."""
    return fit_groups([(df, models)], features)[0]


def _apart(df: DataFrame, features: list[str], works: list, most_rows: float) -> list:
    """What each of `works` makes of the latest rows of `df`, in tasks that each get all of them; rows go
    from executor to executor."""
    context = df.sparkSession.sparkContext
    own, width = min(len(works), context.defaultParallelism), len(features)
    tasks = F.explode(F.array(*[F.lit(t) for t in range(own)])).alias("task")
    every = context.broadcast(pickle.dumps(works))

    def work(task, rows):  # noqa: ANN001, ANN202
        x, y, _ = _matrix([r for _, r in rows], width)
        works = pickle.loads(every.value)  # noqa: S301
        return [(k, pickle.dumps(works[k].fit(x, y))) for k in range(task, len(works), own)]

    rows = latest_rows(df, features, most_rows).select(tasks, "part", "number", "rows").rdd.map(lambda r: (r["task"], (r["part"], r["number"], bytes(r["rows"]))))
    found = dict(rows.partitionBy(own, int).mapPartitionsWithIndex(work).collect())
    every.destroy()
    return [pickle.loads(found[k]) for k in range(len(works))]  # noqa: S301


def score_with(df: DataFrame, features: list[str], models: dict[str, object], kept: list[str]) -> DataFrame:
    """Rows of `df` with the probabilities of each model, one row per model."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps(models))
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "model string", *(f"{p} double" for p in PROBABILITIES)])

    def score(batches):  # noqa: ANN001, ANN202
        ready = pickle.loads(shared.value)  # noqa: S301
        for b in batches:
            for name, model in ready.items():
                p = model.predict(b[features].to_numpy(float)) if len(b) else np.zeros((0, 3))
                yield b[kept].assign(model=name, **{c: p[:, k] for k, c in enumerate(PROBABILITIES)})

    return df.select(*kept, *[c for c in features if c not in kept]).mapInPandas(score, schema)


def _xy(frame: pd.DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return frame[features].to_numpy(float), frame["target"].to_numpy(int)


def _grid_losses(df: DataFrame, features: list[str], models: list, valid: DataFrame) -> DataFrame:
    """(configuration, log_loss, brier_score) over all rows of `valid`, of unfitted models fitted on the training rows."""
    fitted = fit_all(df.filter("split = 'train'"), features, models)
    spark = df.sparkSession
    configurations = spark.createDataFrame([(k,) for k in range(len(models))], "configuration int")
    shared = spark.sparkContext.broadcast(fitted)

    def score(batches):  # noqa: ANN001, ANN202
        for b in batches:
            x, y = _xy(b, features)
            rows = [(k, len(y), log_loss(p := m.predict(x), y) * len(y), float(((p - np.eye(3)[y]) ** 2).sum())) for k, m in enumerate(shared.value) if len(y)]
            yield pd.DataFrame(rows, columns=["configuration", "n", "loss", "brier"])

    scored = valid.filter("target is not null").select(F.col("target").cast("int").alias("target"), *features).mapInPandas(score, "configuration int, n long, loss double, brier double")
    summed = scored.groupBy("configuration").agg((F.sum("loss") / F.sum("n")).alias("log_loss"), (F.sum("brier") / F.sum("n")).alias("brier_score"))
    return configurations.join(summed, "configuration", "left")


def _listed(grid: list[tuple], schema: str, losses: DataFrame) -> DataFrame:
    listed = losses.sparkSession.createDataFrame([(k, *g) for k, g in enumerate(grid)], f"configuration int, {schema}")
    return listed.join(F.broadcast(losses), "configuration")


def _few_at_once(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return ((x[low : low + MULTIPLIED_AT_ONCE], y[low : low + MULTIPLIED_AT_ONCE]) for low in range(0, len(y), MULTIPLIED_AT_ONCE))


def _over_blocks(blocks: DataFrame, width: int, work: Callable) -> list:
    """What `work` makes of the rows of each task, as (features, targets) a few at a time; as many tasks as cores."""

    def parts(blocks):  # noqa: ANN001, ANN202
        for (rows,) in blocks:
            table = pa.ipc.open_stream(bytes(rows)).read_all()
            x, y = np.stack([table.column(1 + j).to_numpy() for j in range(width)], 1), table.column(0).to_numpy().astype(int)
            yield from _few_at_once(x, y)

    return blocks.select("rows").rdd.coalesce(blocks.sparkSession.sparkContext.defaultParallelism).mapPartitions(lambda b: [work(parts(b))]).collect()


def _moments(parts) -> list:  # noqa: ANN001
    """[(rows by class, mean, squares about it, least, greatest)] of the parts together; none of no rows."""
    found = None
    for x, y in parts:
        mean = x.mean(0)
        found = _together(found, (np.bincount(y, minlength=3), mean, ((x - mean) ** 2).sum(0), x.min(0), x.max(0)))
    return [found] if found else []


def _together(a: tuple | None, b: tuple) -> tuple:
    if a is None:
        return b
    m, n = a[0].sum(), b[0].sum()
    gap = b[1] - a[1]
    return a[0] + b[0], a[1] + gap * (n / (m + n)), a[2] + b[2] + gap**2 * (m * n / (m + n)), np.minimum(a[3], b[3]), np.maximum(a[4], b[4])


def fit_logistics(over: Callable[[Callable], list], width: int, models: list[Logistic]) -> list[Logistic]:
    """The models fitted on all rows, by the Newton steps of `Logistic`: a pass over the rows sums up the
    slopes of all models, and their curvatures until steps are short. `over` gives what a function makes
    of each share of the rows."""
    found = reduce(_together, (f for own in over(_moments) for f in own), None)
    if found is None or not found[0].all():
        raise ValueError("training needs all three classes")
    n, many, k = found[0].sum(), len(models), width + 1
    for model in models:
        model.mean, model.scale = found[1], np.where((found[4] > found[3]) & (found[2] > 0), np.sqrt(found[2] / n), np.inf)
    weights = np.stack([n / (3 * found[0]) if m.balanced else np.ones(3) for m in models], 1)  # by class and model
    c, ridge, w = np.array([m.c for m in models]), np.r_[np.ones(width), 1e-8], np.zeros((k, many, 3))
    one, other = np.triu_indices(k)
    hot, pairs = np.eye(3), ((0, 1), (0, 2), (1, 2))

    def sums(parts, w, curved):  # noqa: ANN001, ANN202
        slope, curve = np.zeros((k, 3 * many)), np.zeros((3 * many, len(one)))
        for x, y in parts:
            z = models[0]._prepare(x)
            p = _softmax((z @ w.reshape(k, -1)).reshape(-1, 3)).reshape(-1, many, 3)
            weight = weights.take(y, 0)[:, :, None]
            slope += z.T @ (weight * (p - hot.take(y, 0)[:, None])).reshape(len(y), -1)
            if curved:
                v = np.stack([p[:, :, a] * p[:, :, b] for a, b in pairs], 2) * weight
                curve += v.reshape(len(y), -1).T @ (z.take(one, 1) * z.take(other, 1))
        return slope, curve if curved else None

    last, curved, curves = np.full(many, np.inf), True, None
    for _ in range(100):
        got = over(lambda parts, w=w.copy(), curved=curved: sums(parts, w, curved))
        slope = c[None, :, None] * sum(g[0] for g in got).reshape(k, many, 3) + ridge[:, None, None] * w
        slope -= slope.mean(2, keepdims=True)  # the same for all classes is rounding: it changes no probability
        if curved:
            curves = np.zeros((many, 3, k, 3, k))
            for (a, b), s in zip(pairs, np.moveaxis(sum(g[1] for g in got).reshape(many, 3, -1), 1, 0), strict=True):
                whole = np.zeros((many, k, k))
                whole[:, one, other] = whole[:, other, one] = c[:, None] * s
                for i, j, sign in ((a, a, 1), (b, b, 1), (a, b, -1), (b, a, -1)):
                    curves[:, i, :, j] += sign * whole
            curves = curves.reshape(many, 3 * k, 3 * k) + np.diag(np.tile(ridge, 3) + 1e-9)
        step = np.stack([np.linalg.solve(curves[m], slope[:, m].T.ravel()).reshape(3, k).T for m in range(many)], 1)
        w -= step - step.mean(2, keepdims=True)
        size = np.abs(step - step.mean(2, keepdims=True)).max((0, 2))
        # short of 1e-8, steps that no longer shrink are rounding
        if ((size < 1e-8) | (size < 1e-6) & (size > last / 2)).all():
            break
        curved = bool((size > 0.05).any() or ((size > last / 4) & (size >= 1e-6)).any())
        last = size
    for m, model in enumerate(models):
        model.w = w[:, m]
    return models


def logistic_grid(df: DataFrame, features: list[str], c_values: tuple[float, ...] = C_VALUES) -> DataFrame:
    """Validation log loss of each C and class weight, fitted on all training rows."""
    grid = [(c, b) for c in c_values for b in (False, True)]
    kept, width = kept_rows(df, features), len(features)
    train = kept.filter("split = 'train'")
    fitted = fit_logistics(lambda work: _over_blocks(train, width, work), width, [Logistic(c, b) for c, b in grid])

    def score(parts):  # noqa: ANN001, ANN202
        total = np.zeros((len(fitted), 3))
        for x, y in parts:
            for m, model in enumerate(fitted):
                p = model.predict(x)
                total[m] += len(y), log_loss(p, y) * len(y), ((p - np.eye(3)[y]) ** 2).sum()
        return total

    total = sum(_over_blocks(kept.filter("split = 'validation'"), width, score), np.zeros((len(grid), 3)))
    rows = [(m, *(float(v / n) if n else None for v in (loss, brier))) for m, (n, loss, brier) in enumerate(total)]
    losses = df.sparkSession.createDataFrame(rows, "configuration int, log_loss double, brier_score double")
    return _listed([(float(c), "balanced" if b else "none") for c, b in grid], "c double, class_weight string", losses).drop("configuration")


def logistic_coefficients(df: DataFrame, features: list[str], c: float = 0.1, balanced: bool = False) -> DataFrame:
    """Coefficients of the final fit, on all labelled rows, by class, the greatest first."""
    blocks, width = kept_labelled(df, F.lit("all"), features), len(features)
    w = fit_logistics(lambda work: _over_blocks(blocks, width, work), width, [Logistic(c, balanced)])[0].w
    rows = [(name, f, round(float(w[j, k]), 5), round(abs(float(w[j, k])), 5)) for k, name in enumerate(("away_win", "draw", "home_win")) for j, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "class_label string, feature string, coefficient double, absolute double").orderBy("class_label", F.desc("absolute"), "feature")


def boosting_grid(df: DataFrame, features: list[str], grid: tuple = BOOSTING) -> DataFrame:
    """Tuning-window log loss of each configuration."""
    valid = chronological_partition(df.filter("split = 'validation' and target is not null"), 0.6).filter("part = 'tuning'")
    losses = _grid_losses(df, features, [Boosting(*g) for g in grid], valid)
    listed = _listed(list(grid), "iterations int, rate double, leaves int, least int, penalty double", losses)
    return listed.withColumn("log_loss", F.round("log_loss", 5))


def boosting_importance(df: DataFrame, features: list[str], boosting: tuple = BOOSTING[0], repeats: int = 20, most_rows: float = np.inf) -> DataFrame:
    """(feature, mean, deviation): how much log loss on the tuning window a shuffled feature adds, the
    greatest first. Features are the parallel axis; of the window, the latest `most_rows` rows count."""
    kept, columns = kept_rows(df, features, "kickoff_utc", "match_key"), ["kickoff_utc", "match_key", "target", *features]
    like = df.select("kickoff_utc", "match_key", F.col("target").cast("int").alias("target"), *[F.col(c).cast("double").alias(c) for c in features])
    model = fit_all(_unpacked(kept, like, columns, "train"), features, [Boosting(*boosting)])[0]
    window = chronological_partition(_unpacked(kept, like, columns, "validation"), 0.6).filter("part = 'tuning'")
    own = min(len(features), df.sparkSession.sparkContext.defaultParallelism)
    shares = [list(range(t, len(features), own)) for t in range(own)]
    found = _apart(window, features, [_Importance(model, share, repeats) for share in shares], most_rows)
    rows = [(features[j], float(mean), float(sd)) for share, part in zip(shares, found, strict=True) for j, (mean, sd) in zip(share, part, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance_mean double, importance_std double").orderBy(F.desc("importance_mean"), "feature")


class _Importance:
    """What shuffling each of some features adds to the loss of a fitted model, which stays as it is."""

    def __init__(self, model: Boosting, columns: list[int], repeats: int) -> None:
        self.model, self.columns, self.repeats = model, columns, repeats

    def fit(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """(columns, 2), as `permutation_importance` with a seed for each column. A shuffled column only
        changes the trees that ask for it: what each row gets of them for each bin of the column is found
        once, whatever it is shuffled to."""
        codes = self.model._codes(x)
        shuffled = []
        for j in self.columns:
            rng = np.random.default_rng(42 + j)
            shuffled.append([rng.permutation(codes[j]) for _ in range(self.repeats)])
        base, losses = 0.0, np.zeros((len(self.columns), self.repeats))
        lost = lambda raw, y: -np.log(np.clip(_softmax(raw)[np.arange(len(y)), y], 2.220446049250313e-16, 1)).sum()
        for low in range(0, len(y), SCORED_AT_ONCE):
            part = slice(low, low + SCORED_AT_ONCE)
            raw, ys, rows = self.model.raw(x[part]), y[part], np.arange(len(y[part]))
            base += lost(raw, ys)
            for k, j in enumerate(self.columns):
                level, given = self._by_bin(codes[:, part], j)
                rest = raw - given[level[codes[j, part]], :, rows]
                for r, own in enumerate(shuffled[k]):
                    losses[k, r] += lost(rest + given[level[own[part]], :, rows], ys)
        added = (losses - base) / max(len(y), 1)
        return np.c_[added.mean(1), added.std(1)]

    def _by_bin(self, codes: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(level of each bin, (levels, 3, rows) sums of the trees that ask for column j): bins that no tree tells apart are one level."""
        asking = [(c, nodes, sorted({n[1] for n in nodes if n[0] == j})) for round_ in self.model.trees for c, nodes in enumerate(round_) if any(n[0] == j for n in nodes)]
        cuts = sorted({at for _, _, own in asking for at in own})
        given, codes = np.zeros((len(cuts) + 1, 3, codes.shape[1])), codes.copy()
        for c, nodes, own in asking:
            before = 0.0
            for first, bin_ in zip((0, *(cuts.index(at) + 1 for at in own)), (0, *(at + 1 for at in own)), strict=True):
                codes[j] = bin_
                value = self.model._walk(nodes, codes)
                given[first, c] += value - before
                before = value
        return np.searchsorted(cuts, np.arange(self.model.bins + 1)), self.model.rate * given.cumsum(0)


class Calibrated:
    """Boosting with the sigmoid that calibrates its raw scores."""

    def __init__(self, model: Boosting, sigmoid: Sigmoid) -> None:
        self.model, self.sigmoid = model, sigmoid

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.sigmoid.predict(self.model.raw(x))


class SigmoidOf:
    """Fits the sigmoid of a fitted model, which stays as it is, on rows of their own."""

    def __init__(self, model: Boosting) -> None:
        self.model = model

    def fit(self, x: np.ndarray, y: np.ndarray, peers: _Alone = ALONE) -> Sigmoid:
        return Sigmoid().fit(self.model.raw(x), y, peers)


class Blend:
    """Two fitted models and the weight of the first."""

    def __init__(self, first: object, second: object, weight: float) -> None:
        self.first, self.second, self.weight = first, second, weight

    def predict(self, x: np.ndarray) -> np.ndarray:
        p = self.weight * self.first.predict(x) + (1 - self.weight) * self.second.predict(x)
        return p / p.sum(1, keepdims=True)


class _Production:
    """A production fit and what it was fitted on."""

    def __init__(self, weight: float, c: float, balanced: bool, boosting: tuple, fraction: float, least: int) -> None:
        self.weight, self.c, self.balanced, self.boosting, self.fraction, self.least = weight, c, balanced, boosting, fraction, least

    def fit_in_time(self, x: np.ndarray, y: np.ndarray, at: np.ndarray, peers: _Alone = ALONE) -> tuple[Blend | None, dict]:
        n = int(peers.total(np.array([len(y)]))[0])
        if n <= self.least:
            return None, {}
        first = n - max(self.least, int(np.ceil(n * self.fraction)))
        since, last = peers.at_first(at, lambda all_: (np.partition(all_, first)[first], all_.max()))
        early = int(np.searchsorted(at, since))  # own rows are in order of time
        before = int(peers.total(np.array([early]))[0])
        model = Boosting(*self.boosting).fit(x[:early], y[:early], peers)
        sigmoid = Sigmoid().fit(model.raw(x[early:]), y[early:], peers)
        blend = Blend(Logistic(self.c, self.balanced).fit(x, y, peers), Calibrated(model, sigmoid), self.weight)
        return blend, {"labelled_rows": n, "hgb_fit_rows": before, "calibration_rows": n - before, "training_cutoff": str(np.datetime64(int(last), "us"))}


def fit_production(df: DataFrame, features: list[str], weight: float = 0.5, c: float = 0.1, balanced: bool = False, boosting: tuple = BOOSTING[1], fraction: float = 0.15, least: int = 30) -> tuple[Blend, dict]:
    """(model, what it was fitted on): logistic regression on all labelled rows and boosting on the
    early ones, calibrated on the late ones (whole kickoff times), fitted on an executor."""
    model, details = fit_all(df, features, [_Production(weight, c, balanced, boosting, fraction, least)])[0]
    if model is None:
        raise ValueError(f"no more than {least} labelled rows")
    return model, details


def production_predict(df: DataFrame, features: list[str], weight: float = 0.5, c: float = 0.1, boosting: tuple = BOOSTING[1], fraction: float = 0.15) -> DataFrame:
    """Probabilities of the unlabelled rows by a production fit on the labelled ones."""
    model, _ = fit_production(df, features, weight, c, False, boosting, fraction)
    return score_with(df.filter("target is null"), features, {"production": model}, ["match_key"]).drop("model")


def backtest(folds: DataFrame, features: list[str], c: float = 0.1, boosting: tuple = BOOSTING[0]) -> DataFrame:
    """Scored evaluation rows of every fold by logistic regression and boosting fitted on all of the fold's
    training rows; `folds` has fold_number, evaluation_season, role and season (see `evaluation.folds_of`).
    Rows are made and kept once, by season, whatever number of folds they are in."""
    season = F.col("season").cast("string")
    parts = folds.select("fold_number", "evaluation_season", "role", season.alias("season")).distinct().orderBy("fold_number", "season").collect()
    first = {p.season: p for p in reversed(parts)}.values()
    once = reduce(Column.__or__, [(season == p.season) & (F.col("fold_number") == p.fold_number) & (F.col("role") == p.role) for p in first])
    columns, types = ["kickoff_utc", "match_key", "target", *features], dict(folds.dtypes)
    kept = kept_labelled(folds.filter(once), season, features, "kickoff_utc", "match_key")
    like = folds.select("kickoff_utc", "match_key", F.col("target").cast("int").alias("target"), *[F.col(c).cast("double").alias(c) for c in features])
    rows = lambda role, n: _unpacked(kept, like, columns, *[p.season for p in parts if (p.role, p.fold_number) == (role, n)])
    evaluated = {p.fold_number: p.evaluation_season for p in parts}
    fitted = fit_groups([(rows("training", n), [Logistic(c), Boosting(*boosting)]) for n in evaluated], features)
    scored = []
    for (n, name), (line, trees) in zip(evaluated.items(), fitted, strict=True):
        own = rows("evaluation", n).select(F.lit(n).cast(types["fold_number"]).alias("fold_number"), F.lit(name).cast(types["evaluation_season"]).alias("evaluation_season"), "match_key", F.col("target").cast(types["target"]).alias("target"), *features)
        scored.append(score_with(own, features, {"logistic_regression": line, "hist_gradient_boosting": trees}, ["fold_number", "evaluation_season", "match_key", "target"]))
    return reduce(DataFrame.unionByName, scored)
