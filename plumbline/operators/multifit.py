"""Many logistic fits over one table at once.

Leave-one-source-out folds, permuted labels, folds inside a source and nested training sets all train on parts of the same rows.
Here such a part is a task. One pass over the rows gives the losses and gradients of all tasks as matrix products in each
Arrow batch; sums travel as one row a task and partition and are added by Spark. The minimiser (limited-memory quasi-Newton)
steps all tasks together, so an iteration is one job whatever their number.

The driver and each Python worker hold coefficients, never rows: about 25 (D + 1) doubles a task, 13 MB for 1,000 tasks over 64 features.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from plumbline.session import settle

ROW_COLUMNS = ("__x", "__ys", "__scope", "__bars", "__level")
SUMS = "task int, sums array<double>"
CELLS_PER_PRODUCT = 2_000_000
PRODUCTS_PER_PARTITION = 100_000_000
MEMORY = 8


@dataclass(frozen=True)
class Tasks:
    """One entry a fit. A task trains on the rows of its `scope` (-1: all rows) whose `bars` do not hold `without` (-1: none
    left out) and whose level is at most `level`, against the label number `variant`."""

    scope: np.ndarray
    without: np.ndarray
    level: np.ndarray
    variant: np.ndarray

    @staticmethod
    def of(rows: Sequence[tuple[int, int, int, int]]) -> Tasks:
        table = np.array(rows, dtype=np.int64).reshape(-1, 4)
        return Tasks(table[:, 0], table[:, 1], table[:, 2], table[:, 3])

    def __len__(self) -> int:
        return len(self.scope)

    def only(self, index: np.ndarray) -> Tasks:
        return Tasks(self.scope[index], self.without[index], self.level[index], self.variant[index])


def task_rows(
    df: DataFrame, vector: str = "v", labels: Sequence[str] = ("label",), scope: Column | None = None,
    bars: Column | None = None, level: Column | None = None,
) -> DataFrame:
    """Add the columns that `fit_many` reads. The first of `bars` is the row's own cell, whose tasks score it as held out.

    Rows whose vector is null or has a null or non-finite component, or with a null label, take no part.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    some = F.col(vector).isNotNull() & finite
    for name in labels:
        some = some & F.col(name).isNotNull()
    return df.filter(some).select(
        "*",
        F.transform(vector, lambda x: x.cast("double")).alias("__x"),
        F.array(*[F.col(c).cast("double") for c in labels]).alias("__ys"),
        (F.lit(-1) if scope is None else scope).cast("int").alias("__scope"),
        (F.array(F.lit(-2)) if bars is None else bars).cast("array<int>").alias("__bars"),
        (F.lit(0) if level is None else level).cast("int").alias("__level"),
    )


class _Block:
    """The numbers of one Arrow batch."""

    def __init__(self, batch: pa.RecordBatch, shift: np.ndarray):
        n = batch.num_rows
        self.x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1) - shift
        self.ys = batch.column("__ys").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        self.scope = batch.column("__scope").to_numpy(zero_copy_only=False)
        self.level = batch.column("__level").to_numpy(zero_copy_only=False)
        bars = batch.column("__bars")
        lengths = bars.value_lengths().to_numpy(zero_copy_only=False)
        self.bars, self.bar_row = bars.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), lengths)
        self.own = self.bars[np.concatenate([[0], np.cumsum(lengths)[:-1]])]

    def trains(self, rows: np.ndarray, tasks: Tasks) -> np.ndarray:
        """1 where a row (in `rows`, ascending) trains a task, else 0; all are known to share the scope."""
        cells, column = np.unique(tasks.without, return_inverse=True)
        at = np.searchsorted(rows, self.bar_row)
        near = np.minimum(at, len(rows) - 1)
        cell = np.minimum(np.searchsorted(cells, self.bars), len(cells) - 1)
        hit = (rows[near] == self.bar_row) & (cells[cell] == self.bars) & (self.bars >= 0)
        barred = np.zeros((len(rows), len(cells)), dtype=bool)
        barred[near[hit], cell[hit]] = True
        return ~barred[:, column] & (self.level[rows][:, None] <= tasks.level[None, :])

    def parts(self, tasks: Tasks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, task numbers) that belong together, in pieces of bounded size."""
        for scope in np.unique(tasks.scope):
            members = np.flatnonzero(tasks.scope == scope)
            rows = np.arange(len(self.x)) if scope < 0 else np.flatnonzero(self.scope == scope)
            step = max(1, CELLS_PER_PRODUCT // len(members))
            for start in range(0, len(rows), step):
                yield rows[start : start + step], members


def _moments(block: _Block, rows: np.ndarray, tasks: Tasks, _: tuple) -> np.ndarray:
    """Per task: rows, positives, sums and sums of squares of the training rows."""
    used = block.trains(rows, tasks).astype(float)
    y = block.ys[rows][:, tasks.variant]
    x = block.x[rows]
    return np.vstack([used.sum(0), (used * y).sum(0), x.T @ used, (x * x).T @ used])


def _slopes(block: _Block, rows: np.ndarray, tasks: Tasks, at: tuple) -> np.ndarray:
    """Per task: weighted log loss and its gradient by intercept and coefficients of the shifted vector."""
    coef, intercept, weight_pos, weight_neg = at
    x, y = block.x[rows], block.ys[rows][:, tasks.variant]
    z = x @ coef + intercept
    w = np.where(y == 1, weight_pos, weight_neg) * block.trains(rows, tasks)
    e = np.exp(-np.abs(z))
    p = np.where(z >= 0, 1.0, e) / (1.0 + e)
    r = w * (p - y)
    return np.vstack([(w * (np.maximum(z, 0.0) + np.log1p(e) - y * z)).sum(0), r.sum(0), x.T @ r])


def _totals(rows: DataFrame, tasks: Tasks, shift: np.ndarray, kernel: Callable, at: tuple, width: int, single: bool) -> np.ndarray:
    """The kernel summed over all rows: one column a task. `single`: the rows are one partition, whose sums are whole."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((width, len(tasks))), np.zeros(len(tasks), dtype=bool)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            block = _Block(batch, shift)
            for part, members in block.parts(tasks):
                cut = tuple(a[..., members] for a in at)
                sums[:, members] += kernel(block, part, tasks.only(members), cut)
                seen[members] = True
        yield _task_sums(sums, seen)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((width, len(tasks))), np.zeros(len(tasks), dtype=bool)
        for batch in batches:
            task = batch.column("task").to_numpy(zero_copy_only=False)
            np.add.at(sums.T, task, batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            seen[task] = True
        yield _task_sums(sums, seen)

    each = rows.select(*ROW_COLUMNS).mapInArrow(partial, SUMS)
    added = each if single else each.repartition("task").mapInArrow(add, SUMS)
    out = np.zeros((width, len(tasks)))
    for row in added.collect():
        out[:, row.task] = row.sums
    return out


def _task_sums(sums: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    found = np.flatnonzero(seen)
    flat = pa.array(sums[:, found].T.ravel())
    offsets = pa.array(np.arange(0, len(flat) + 1, len(sums), dtype=np.int32))
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.ListArray.from_arrays(offsets, flat)], names=["task", "sums"])


def _descend(evaluate: Callable, x: np.ndarray, idle: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """Minimise all columns of x together; evaluate(columns, numbers) gives (values, gradients) of the tasks asked for."""
    size, count = x.shape
    done = idle.copy()
    f, g = evaluate(x, np.arange(count))
    s_hist, y_hist = np.zeros((MEMORY, size, count)), np.zeros((MEMORY, size, count))
    rho, scale = np.zeros((MEMORY, count)), np.ones(count)
    d = -g / np.maximum(1.0, np.linalg.norm(g, axis=0))
    step = np.ones(count)
    for _ in range(max_iter):
        done |= np.abs(g).max(axis=0) <= tol
        live = np.flatnonzero(~done)
        if not len(live):
            break
        trial = x[:, live] + step[live] * d[:, live]
        ft, gt = evaluate(trial, live)
        slope = (g[:, live] * d[:, live]).sum(0)
        ok = ft <= f[live] + 1e-4 * step[live] * slope + 1e-13 * np.abs(f[live])
        back = live[~ok]
        curve = ft[~ok] - f[back] - step[back] * slope[~ok]
        guess = -slope[~ok] * step[back] ** 2 / (2.0 * np.where(curve > 0, curve, np.inf))
        step[back] = np.clip(guess, 0.1 * step[back], 0.5 * step[back])
        done[back[step[back] < 1e-10]] = True
        took = live[ok]
        s, y = trial[:, ok] - x[:, took], gt[:, ok] - g[:, took]
        x[:, took], f[took], g[:, took] = trial[:, ok], ft[ok], gt[:, ok]
        sy, yy = (s * y).sum(0), (y * y).sum(0)
        bends = sy > 1e-300
        for hist, new in ((s_hist, s), (y_hist, y)):
            hist[1:, :, took] = hist[:-1, :, took]
            hist[0][:, took] = new
        rho[1:, took] = rho[:-1, took]
        rho[0, took] = np.where(bends, 1.0 / np.where(bends, sy, 1.0), 0.0)
        scale[took] = np.where(bends, sy / np.where(bends, yy, 1.0), scale[took])
        q, a = g[:, took].copy(), np.zeros((MEMORY, len(took)))
        for i in range(MEMORY):
            a[i] = rho[i, took] * (s_hist[i][:, took] * q).sum(0)
            q -= a[i] * y_hist[i][:, took]
        q *= scale[took]
        for i in reversed(range(MEMORY)):
            q += (a[i] - rho[i, took] * (y_hist[i][:, took] * q).sum(0)) * s_hist[i][:, took]
        d[:, took], step[took] = -q, 1.0
    return x


class Fits:
    """Fitted tasks: decision value = x . coef + intercept. `fitted` is false where a task met fewer than two classes."""

    def __init__(self, tasks: Tasks, coef: np.ndarray, intercept: np.ndarray, n: np.ndarray, n_pos: np.ndarray):
        self.tasks, self.coef, self.intercept, self.n, self.n_pos = tasks, coef, intercept, n, n_pos
        self.fitted = (n_pos > 0) & (n_pos < n)

    def score(self, rows: DataFrame, keep: Sequence[str], held_out: bool = True) -> DataFrame:
        """(keep..., variant, level, score), one row for each row and task that judges it.

        held_out: tasks that left the row's own cell out; else tasks that left nothing out. Tasks of one class judge nothing.
        """
        tasks, coef, intercept, fitted, names = self.tasks, self.coef, self.intercept, self.fitted, list(keep)
        shift = np.zeros(len(coef))

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                block = _Block(batch, shift)
                cell = block.own if held_out else np.full(batch.num_rows, -1)
                for scope, without in np.unique(np.column_stack([block.scope, cell]), axis=0):
                    rows_here = np.flatnonzero((block.scope == scope) & (cell == without))
                    here = np.flatnonzero(fitted & (tasks.without == without) & ((tasks.scope < 0) | (tasks.scope == scope)))
                    for t in here:
                        values = block.x[rows_here] @ coef[:, t] + intercept[t]
                        kept = batch.select(names).take(pa.array(rows_here))
                        marks = [np.full(len(rows_here), m[t], dtype=np.int32) for m in (tasks.variant, tasks.level)]
                        yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, marks), pa.array(values)], names=[*names, "variant", "level", "score"])

        schema = StructType([rows.schema[c] for c in names]).add("variant", IntegerType()).add("level", IntegerType()).add("score", DoubleType())
        return rows.select(*names, *ROW_COLUMNS).mapInArrow(judge, schema)


def fit_many(rows: DataFrame, tasks: Tasks, c: float = 1.0, balanced: bool = False, max_iter: int = 300, tol: float = 1e-6) -> Fits:
    """Fit every task on the rows of `task_rows`: features scaled by the task's own mean and deviation, L2 penalty.

    The penalty is that of `linear_probe`, (n - 1) / (c n^2) on the mean loss; balanced weights are n / (2 n_c). A feature that
    is constant in a task has no coefficient there. No rows, or a single class, leave a task unfitted.
    """
    # Every iteration plans a query over these rows: the checkpoint keeps that plan short, whatever made the rows.
    rows = settle(rows.select(*ROW_COLUMNS)).persist()
    try:
        n_rows = rows.count()
        if n_rows == 0 or len(tasks) == 0:
            none = np.zeros(len(tasks))
            return Fits(tasks, np.zeros((0, len(tasks))), none, none, none)
        shift = np.array(rows.select("__x").first()[0])
        size = len(shift)
        # An iteration is one job: its tasks are sized by rows and responses, not by the cluster.
        parts = max(1, math.ceil(n_rows * len(tasks) * size / PRODUCTS_PER_PARTITION))
        ready, single = rows.coalesce(parts), parts == 1
        sums = _totals(ready, tasks, shift, _moments, (), 2 + 2 * size, single)
        n, n_pos, total = sums[0], sums[1], np.maximum(sums[0], 1.0)
        mean = sums[2 : 2 + size] / total
        spread = np.maximum(sums[2 + size :] - total * mean * mean, 0.0) / np.maximum(total - 1.0, 1.0)
        flat = spread <= 1e-18 * np.maximum(sums[2 + size :] / total, 1e-300)
        per_dev = np.where(flat, 0.0, 1.0 / np.sqrt(np.where(flat, 1.0, spread)))
        idle = (n_pos <= 0) | (n_pos >= n)
        weight_pos = n / (2.0 * np.maximum(n_pos, 1.0)) if balanced else np.ones(len(tasks))
        weight_neg = n / (2.0 * np.maximum(n - n_pos, 1.0)) if balanced else np.ones(len(tasks))
        penalty = np.maximum(total - 1.0, 0.0) / (c * total * total)

        def evaluate(x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            coef = x[:-1] * per_dev[:, live]
            at = (coef, x[-1] - (coef * mean[:, live]).sum(0), weight_pos[live], weight_neg[live])
            out = _totals(ready, tasks.only(live), shift, _slopes, at, 2 + size, single) / total[live]
            value = out[0] + 0.5 * penalty[live] * (x[:-1] ** 2).sum(0)
            slope = (out[2:] - mean[:, live] * out[1]) * per_dev[:, live] + penalty[live] * x[:-1]
            return value, np.vstack([slope, out[1]])

        best = _descend(evaluate, np.zeros((size + 1, len(tasks))), idle, max_iter, tol)
        coef = best[:-1] * per_dev
        intercept = best[-1] - (coef * mean).sum(0) - shift @ coef
        return Fits(tasks, coef, intercept, n, n_pos)
    finally:
        rows.unpersist()
