"""A sample that matches target proportions, by calibration and the pivotal method.

Rows are counted per cell (the crossing of the plans' categories; everything else is one category). The cells are all
that calibration needs: Newton steps on the dual of exponential tilting give each cell its probability, rounded to a
number of rows so that the sample has the plan's size and its categories their goals, floors included. The pivotal method
draws that many rows of each cell: within a task first, then among the one undecided row that each task has left of the
cell. The report counts the sample and tells which targets it is short of.

The number of cells is at most the product of the numbers of target categories plus one, whatever the number of rows;
only cells, and of each cell one row per task, meet in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import cut_lineage

DIMENSIONS = ("judge_bucket", "target_jurisdiction", "model")
OTHER = "\u0001other"
SEED = 11


def folded(c: Column) -> Column:
    """A category without case and outer blanks; null and blank ones are null."""
    s = F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""))
    return F.when(s != "", s)


def distinct_rows(rows: DataFrame, key: str, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """key and folded categories, each key once (of rows that differ the least); null keys are left out."""
    first = F.min(F.struct(*[folded(F.col(d)).alias(d) for d in dims])).alias("r")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(first).select(key, *[F.col(f"r.{d}").alias(d) for d in dims])


@dataclass(frozen=True)
class Target:
    plan: str
    permille: int
    dimension: str
    category: str
    target_permille: int
    min_rows: int


def read_targets(targets: DataFrame) -> list[Target]:
    """The target table, a plan of a few rows each; repeated rows count once, rows with a null are left out."""
    cols = ["plan_name", "sample_permille", "dimension", "category", "target_permille", "min_rows"]
    rows = targets.select(*cols).dropna().distinct().orderBy(*cols).collect()
    return [Target(r[0], int(r[1]), r[2], r[3], int(r[4]), int(r[5])) for r in rows]


def fold_category(category: str) -> str:
    return category.strip().lower()


def sample_size(total: int, permille: int) -> int:
    return total * permille // 1000


def needed(t: Target, total: int) -> int:
    return max(t.min_rows, sample_size(total, t.permille) * t.target_permille // 1000)


def cells(unique: DataFrame, targets: list[Target], dims: tuple[str, ...] = DIMENSIONS) -> list[tuple[tuple[str, ...], int]]:
    """The rows of each cell: the categories in the order of ``dims``, OTHER for those no target names; and their number."""
    named = cell_columns(unique, targets, dims)
    return [(tuple(r[:-1]), r[-1]) for r in named.groupBy(*[f"c_{d}" for d in dims]).agg(F.count("*").alias("n")).orderBy(*[f"c_{d}" for d in dims]).collect()]


def cell_columns(unique: DataFrame, targets: list[Target], dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """``unique`` with its cell as c_<dimension>."""
    out = unique
    for d in dims:
        known = sorted({fold_category(t.category) for t in targets if t.dimension == d})
        out = out.withColumn(f"c_{d}", F.when(F.col(d).isin(known), F.col(d)).otherwise(OTHER) if known else F.lit(OTHER))
    return out


def available(cell_rows: list[tuple[tuple[str, ...], int]], dimension: str, category: str, dims: tuple[str, ...] = DIMENSIONS) -> int:
    if dimension not in dims:
        return 0
    i = dims.index(dimension)
    return sum(n for c, n in cell_rows if c[i] == fold_category(category))


def dimension_goals(stock: dict[str, int], plan: list[Target], total: int) -> dict[str, int]:
    """Rows that a sample of fixed size should hold of each category of one dimension (``stock``: what there is of each,
    OTHER included); they sum up to the size.

    A category gets what it needs or, if there are fewer, all it has. What is left falls to OTHER, and only when that is
    used up to the named categories, in proportion to that. If floors make the needs exceed the size, the parts above the floors
    shrink in proportion.
    """
    size = min(sample_size(total, plan[0].permille), sum(stock.values()))
    want, floor = {}, {}
    for t in plan:
        c = fold_category(t.category)
        want[c] = min(needed(t, total), stock.get(c, 0))
        floor[c] = min(t.min_rows, stock.get(c, 0))
    over = sum(want.values()) - size
    if over > 0:
        if sum(floor.values()) > size:
            floor = dict.fromkeys(floor, 0)
        return want | _share({c: want[c] - floor[c] for c in want}, sum(want.values()) - sum(floor.values()) - over, floor) | {OTHER: 0}
    rest = min(stock.get(OTHER, 0), -over)
    left = -over - rest
    if left > 0:
        want = _share({c: stock.get(c, 0) - want[c] for c in want}, left, want)
    return want | {OTHER: rest}


def _share(room: dict[str, int], amount: int, base: dict[str, int]) -> dict[str, int]:
    """``base`` with ``amount`` more, spread in proportion to ``base`` and never beyond ``room``."""
    out, left = dict(base), min(amount, sum(room.values()))
    while left > 0:
        free = {c: out[c] + 1 for c in sorted(out) if out[c] - base[c] < room[c]}
        whole, spent = sum(free.values()), 0
        for c, weight in free.items():
            more = min(max(1, left * weight // whole), base[c] + room[c] - out[c], left - spent)
            out[c] += more
            spent += more
        left -= spent
    return out


@dataclass(frozen=True)
class Margins:
    """The marginal goals of a plan over its cells: ``x`` (cells x categories, 0 or 1), ``goal`` and ``floor`` per category,
    ``open`` cells, ``counts`` of rows, and the sample's size."""

    x: np.ndarray
    goal: np.ndarray
    floor: np.ndarray
    open: np.ndarray
    counts: np.ndarray
    size: int


def margins(cell_rows: list[tuple[tuple[str, ...], int]], plan: list[Target], dims: tuple[str, ...] = DIMENSIONS) -> Margins:
    counts = np.array([n for _, n in cell_rows], float)
    total = int(counts.sum())
    size = min(sample_size(total, plan[0].permille), total) if plan else 0
    columns, goals, floors, closed = [], [], [], np.zeros(len(cell_rows), bool)
    for d in sorted({t.dimension for t in plan if t.dimension in dims}):
        i, mine = dims.index(d), [t for t in plan if t.dimension == d]
        floor = {fold_category(t.category): t.min_rows for t in mine}
        label = [c[i] if c[i] in floor else OTHER for c, _ in cell_rows]
        stock: dict[str, int] = {}
        for name, n in zip(label, counts):
            stock[name] = stock.get(name, 0) + int(n)
        for category, goal in sorted(dimension_goals(stock, mine, total).items()):
            x = np.array([name == category for name in label], float)
            if goal <= 0:
                closed |= x > 0
            else:
                columns.append(x)
                goals.append(float(goal))
                floors.append(float(min(floor.get(category, 0), goal)))
    x = np.array(columns).T if columns else np.zeros((len(cell_rows), 0))
    return Margins(x, np.array(goals), np.array(floors), ~closed, counts, size)


class NotConverged(RuntimeError):
    """Newton's iterations ended with a gradient that isn't small."""


def calibrate(cell_rows: list[tuple[tuple[str, ...], int]], plan: list[Target], dims: tuple[str, ...] = DIMENSIONS) -> dict[tuple[str, ...], float]:
    """Inclusion probability per cell: the exponential tilting of a uniform draw whose expected sample has the plan's
    marginal goals (``dimension_goals``).

    Each row is in the sample or not, so what is tilted is a Bernoulli draw and its probability the logistic function of
    the dual: it never leaves [0, 1]. Every dimension's goals sum up to the size, so one equation of each further dimension
    is redundant, and several dimensions may contradict each other in what their cells hold. A ridge relative to each
    goal makes the dual strictly convex: where the goals can be met, they are met to a few parts in 10,000; where not, the
    deviations are spread in proportion. Raises NotConverged if the gradient stays large.
    """
    m = margins(cell_rows, plan, dims)
    if not m.size:
        return {c: 0.0 for c, _ in cell_rows}
    if not m.goal.size:
        return {c: m.size / m.counts.sum() for c, _ in cell_rows}
    counts = np.where(m.open, m.counts, 0.0)
    ridge = 1e-5 * (1.0 + m.goal)
    rate = min(0.999, m.size / max(counts.sum(), 1.0))
    start, dual = np.log(rate / (1 - rate)), np.zeros(len(m.goal))

    def tilt(v: np.ndarray) -> tuple[np.ndarray, float]:
        eta = start + m.x @ v
        p = np.exp(-np.logaddexp(0.0, -eta))
        return p, float((counts * np.logaddexp(0.0, eta)).sum() - m.goal @ v + (ridge * v * v).sum() / 2)

    p, value = tilt(dual)
    for _ in range(500):
        gradient = m.x.T @ (counts * p) - m.goal + ridge * dual
        if np.abs(gradient).max() < 1e-6 * max(1.0, m.size):
            return {c: float(p[i]) if m.open[i] else 0.0 for i, (c, _) in enumerate(cell_rows)}
        hessian = (m.x.T * (counts * p * (1 - p))) @ m.x + np.diag(ridge)
        step, slope, scale = np.linalg.solve(hessian, -gradient), 0.0, 1.0
        slope = float(gradient @ step)
        trial = tilt(dual + step)
        while trial[1] > value + 1e-4 * scale * slope + 1e-9 * abs(value) and scale > 1e-12:
            scale /= 2
            trial = tilt(dual + scale * step)
        dual = dual + scale * step
        p, value = trial
    raise NotConverged(f"plan {plan[0].plan}: gradient {np.abs(gradient).max():.3g} after 500 steps")


def quotas(cell_rows: list[tuple[tuple[str, ...], int]], plan: list[Target], dims: tuple[str, ...] = DIMENSIONS) -> dict[tuple[str, ...], int]:
    """Rows to draw from each cell; they sum up to the sample's size.

    The expected numbers are rounded by the pivotal method over the cells, then single rows move between cells as long as
    that brings the categories nearer to their goals, floors first."""
    m = margins(cell_rows, plan, dims)
    p = calibrate(cell_rows, plan, dims)
    expected = np.array([n * p[c] for c, n in cell_rows])
    q = np.floor(expected + 1e-9)
    drawn, held = pivot(enumerate((expected - q).clip(0, 1).tolist()), (SEED, plan[0].plan if plan else "", "cells"))
    q[drawn] += 1
    if held and held[1] >= 0.5:
        q[held[0]] += 1
    q = np.minimum(q, m.counts)

    def price(got: np.ndarray) -> np.ndarray:
        return (got - m.goal) ** 2 + 1000 * np.maximum(0.0, m.floor - got) ** 2

    for _ in range(20 * len(cell_rows) + 1000):
        got = m.x.T @ q
        now = price(got)
        up, down = price(got + 1) - now, price(got - 1) - now
        more = np.where((q < m.counts) & m.open, m.x @ up, np.inf)
        less = np.where(q > 0, m.x @ down, np.inf)
        off = m.size - q.sum()
        if off > 0:
            if not np.isfinite(more).any():
                more = np.where(q < m.counts, m.x @ up, np.inf)
            q[int(more.argmin())] += 1
            continue
        if off < 0:
            q[int(less.argmin())] -= 1
            continue
        b, a = np.argsort(more, kind="stable")[:64], np.argsort(less, kind="stable")[:64]
        with np.errstate(invalid="ignore"):
            change = more[b][:, None] + less[a][None, :] - (m.x[b] * (up + down)) @ m.x[a].T
        change = np.where(np.isfinite(change), change, np.inf)
        i, j = np.unravel_index(int(change.argmin()), change.shape) if change.size else (0, 0)
        if not change.size or change[i, j] >= -1e-9:
            break
        q[b[i]] += 1
        q[a[j]] -= 1
    return {c: int(q[i]) for i, (c, _) in enumerate(cell_rows)}


def _uniform(*what) -> float:
    """A number in [0, 1) that depends on its arguments alone, so that a task run again draws the same."""
    return int.from_bytes(hashlib.blake2b("|".join(map(str, what)).encode(), digest_size=7).digest(), "big") / (1 << 56)


def pivot(units: list[tuple[int, float]] | Iterator[tuple[int, float]], salt) -> tuple[list[int], tuple[int, float] | None]:
    """The pivotal method over (key, probability) in order: keys drawn, and the one unit left undecided with the
    probability it has now. Each step settles one of two units and keeps both expectations."""
    drawn: list[int] = []
    held: tuple[int, float] | None = None
    for key, p in units:
        if p <= 0:
            continue
        if p >= 1:
            drawn.append(key)
            continue
        if held is None:
            held = (key, p)
            continue
        other, q = held
        u, both = _uniform(salt, other, key), p + q
        if both < 1:
            held = (key, both) if u * both < p else (other, both)
        elif both > 1:
            if u * (2 - both) < 1 - q:
                drawn.append(key)
                held = (other, both - 1)
            else:
                drawn.append(other)
                held = (key, both - 1)
        else:
            drawn.append(key if u < p else other)
            held = None
        if held and not 1e-9 < held[1] < 1 - 1e-9:
            if held[1] > 0.5:
                drawn.append(held[0])
            held = None
    return drawn, held


def _first_round(plans: dict[str, dict[tuple[str, ...], float]], dims: int):
    """Rows (key, dimensions..., cell...), sorted by cell -> (plan, key, p, dimensions..., cell): p is 1 for drawn rows, less
    for the one of each cell that a task leaves undecided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def settle() -> pa.RecordBatch:
            out: list[tuple] = []
            for plan, probabilities in plans.items():
                p = probabilities.get(cell, 0.0)
                if p > 0:
                    order = sorted(rows, key=lambda r: _uniform(SEED, plan, r[0])) if p < 1 else rows
                    drawn, held = pivot(((r, p) for r in order), (SEED, plan))
                    out += [(plan, r[0], 1.0, *r[1:]) for r in drawn]
                    if held:
                        out.append((plan, held[0][0], held[1], *held[0][1:]))
            types = [pa.string(), pa.int64(), pa.float64(), *[pa.string()] * dims]
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(["|".join(cell)] * len(out), pa.string())], names=["plan_name", "key", "p", *[f"d{i}" for i in range(dims)], "cell"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                if row[dims + 1 :] != cell or len(rows) >= 100_000:
                    if rows:
                        yield settle()
                    cell, rows = row[dims + 1 :], []
                rows.append(row[: dims + 1])
        if rows:
            yield settle()

    return run


def _second_round(pdf):
    """The undecided rows of one plan and cell, at most one of each task -> the drawn ones."""
    import pandas as pd

    plan, cell = pdf["plan_name"].iloc[0], pdf["cell"].iloc[0]
    pdf = pdf.sort_values("key").reset_index(drop=True)
    drawn, held = pivot(zip(pdf.index.tolist(), pdf["p"].tolist()), (SEED, plan, cell))
    if held and held[1] >= 0.5:
        drawn.append(held[0])
    return pd.DataFrame(pdf.loc[drawn].drop(columns=["p"]))


def draw(rows: DataFrame, targets: DataFrame, key: str = "eval_id", dims: tuple[str, ...] = DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """The sample (plan_name, key, dims...) and the report (plan_name, dimension, category, needed, available, drawn, short).

    Each key is drawn at most once per plan; null categories belong to no target. ``drawn`` counts the sample itself and
    ``short`` is what it lacks of ``needed``. A plan's sample has its size exactly. Without rows or targets the sample is
    empty.
    """
    spark = rows.sparkSession
    unique = distinct_rows(rows, key, dims)
    wanted = read_targets(targets)
    counted = cells(unique, wanted, dims)
    stock = dict(counted)
    plans = {p: {c: q / stock[c] for c, q in quotas(counted, [t for t in wanted if t.plan == p], dims).items() if q} for p in sorted({t.plan for t in wanted})}
    named = cell_columns(unique, wanted, dims)
    c = [f"c_{d}" for d in dims]
    shape = ", ".join(f"d{i} string" for i in range(len(dims)))
    # Rows stand by cell within each task, a cell in as many tasks as its rows fill: no cell is one task's alone.
    first = named.select(F.col(key).cast("long").alias("key"), *dims, *c).sortWithinPartitions(*c, "key")
    first = cut_lineage(first.mapInArrow(_first_round(plans, len(dims)), f"plan_name string, key long, p double, {shape}, cell string"))
    second = first.where("p < 1").groupBy("plan_name", "cell").applyInPandas(_second_round, f"plan_name string, key long, {shape}, cell string")
    sample = cut_lineage(first.where("p >= 1").drop("p").unionByName(second))
    got = {(r[0], r[1]): r[2] for r in sample.groupBy("plan_name", "cell").count().collect()}
    return sample.select("plan_name", F.col("key").alias(key), *[F.col(f"d{i}").alias(d) for i, d in enumerate(dims)]), _report(spark, wanted, counted, dims, got)


def _report(spark, wanted: list[Target], counted, dims: tuple[str, ...], got: dict[tuple[str, str], int]) -> DataFrame:
    total, rows = sum(n for _, n in counted), []
    for t in wanted:
        drawn = [(c, got.get((t.plan, "|".join(c)), 0)) for c, _ in counted]
        need, have = needed(t, total), available(drawn, t.dimension, t.category, dims)
        rows.append((t.plan, t.dimension, t.category, need, available(counted, t.dimension, t.category, dims), have, max(0, need - have)))
    return spark.createDataFrame(rows, "plan_name string, dimension string, category string, needed long, available long, drawn long, short long")


def shortfalls(rows: DataFrame, targets: DataFrame, key: str = "eval_id", dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """plan_name, dimension, category of the targets that the sample drawn is short of since fewer rows exist than needed."""
    return draw(rows, targets, key, dims)[1].where("short > 0 AND available < needed").select("plan_name", "dimension", "category")
