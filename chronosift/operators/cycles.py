"""Positions over a cycle of slots, such as the hours of a week, that pay for their own trades.

Each slot has an edge and a cost of moving; the position of a slot earns edge * f - gamma / 2 * f^2 and pays cost * |change|, for ever round
the cycle. Values of a grid of positions are iterated backwards round the cycle until they and the policy settle. The best move from every position is the upper
envelope of values less the cost of the way there, which two running maxima give, so a slot takes time in proportion to the grid. All series
of a batch go round together; a series is as many numbers as the cycle has slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID, SWEEPS, CYCLES = 81, 400, 50
#: How little relative values may still change, so that a policy that only pauses isn't taken for the last one.
SETTLED = 1e-10
#: What a smaller position, and staying, are preferred by where values are equal.
SMALL, STAY = 1e-12, 1e-15


def envelope(value: np.ndarray, grid: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of values over the grid: the best of value[j] - cost * |grid[j] - grid[i]| over j for each i, and that j."""
    k = cost[:, None] * grid[None, :]
    at = np.arange(len(grid))

    def running(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = np.maximum.accumulate(x, axis=1)
        return best, np.maximum.accumulate(np.where(x == best, at, 0), axis=1)

    up, from_up = running(value + k)
    down, from_down = running((value - k)[:, ::-1])
    left, right = up - k, down[:, ::-1] + k
    return np.maximum(left, right), np.where(left >= right, from_up, len(grid) - 1 - from_down[:, ::-1])


def solve(edge: np.ndarray, cost: np.ndarray, gamma: np.ndarray, points: int = GRID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(series x slots) positions, sweeps taken, and whether values and policy settled; from flat at the first slot."""
    grid = np.linspace(-1.0, 1.0, points)
    flat = points // 2
    n, slots = edge.shape
    value, policy = np.zeros((n, points)), np.full((slots, n, points), -1, np.int32)
    sweeps, done = np.zeros(n, int), np.zeros(n, bool)
    for _ in range(SWEEPS):
        go = np.flatnonzero(~done)
        if not len(go):
            break
        before, v = policy[:, go].copy(), value[go]
        for b in range(slots - 1, -1, -1):
            here = edge[go, b, None] * grid - 0.5 * gamma[go, None] * grid**2 - SMALL * np.abs(grid)
            v, move = envelope(here + v, grid, cost[go, b] + STAY)
            policy[b, go] = move
        v = v - v[:, [flat]]
        moved = np.abs(v - value[go]).max(axis=1)
        value[go] = v
        sweeps[go] += 1
        done[go] = (policy[:, go] == before).all(axis=(0, 2)) & (moved < SETTLED)
    at, orbit, last, rows = np.full(n, flat), np.zeros((n, slots), int), None, np.arange(n)
    for _ in range(CYCLES):
        for b in range(slots):
            at = policy[b, rows, at]
            orbit[:, b] = at
        if last is not None and (orbit == last).all():
            break
        last = orbit.copy()
    return grid[orbit], sweeps, done


def cycle_positions(table: DataFrame, keys: list[str], *, slot: str = "slot", edge: str = "edge", cost: str = "cost", gamma: str = "gamma", points: int = GRID) -> DataFrame:
    """(keys, slot, position, sweeps, converged) of tables with a row a slot; gamma is a series' own (its mean).

    A null edge is 0, a null cost counts as one that nothing is worth (position held).
    """
    if points % 2 == 0:
        raise ValueError("the grid needs a middle")
    cell = F.struct(F.col(slot).alias("slot"), F.coalesce(F.col(edge).cast("double"), F.lit(0.0)).alias("edge"), F.coalesce(F.col(cost).cast("double"), F.lit(1e6)).alias("cost"))
    rings = table.groupBy(*keys).agg(F.sort_array(F.collect_list(cell)).alias("ring"), F.avg(gamma).alias("__gamma"))
    sent = rings.select(*keys, "__gamma", "ring", F.transform("ring", lambda c: c["edge"]).alias("__edge"), F.transform("ring", lambda c: c["cost"]).alias("__cost"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[*keys, "slots"]].copy()
            found = [None] * len(batch)
            size = batch["__edge"].map(len).to_numpy()
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                for s in range(0, len(rows), 64):
                    some = rows[s : s + 64]
                    edges, costs = (np.vstack(batch[c].iloc[some].to_list()).astype(float) for c in ("__edge", "__cost"))
                    f, sweeps, done = solve(edges, costs, batch["__gamma"].to_numpy(float)[some], points)
                    for i, r in enumerate(some):
                        found[r] = (f[i].tolist(), int(sweeps[i]), bool(done[i]))
            out["f"], out["sweeps"], out["converged"] = ([x[j] for x in found] for j in range(3))
            yield out

    kinds = ", ".join(f"`{k}` {table.schema[k].dataType.simpleString()}" for k in keys)
    of = table.schema[slot].dataType.simpleString()
    solved = sent.select(*keys, F.transform("ring", lambda c: c["slot"]).alias("slots"), "__gamma", "__edge", "__cost").mapInPandas(run, f"{kinds}, slots array<{of}>, f array<double>, sweeps int, converged boolean")
    return solved.select(*keys, F.explode(F.arrays_zip("slots", "f")).alias("z"), "sweeps", "converged").select(*keys, F.col("z.slots").alias("slot"), F.col("z.f").alias("position"), "sweeps", "converged")
