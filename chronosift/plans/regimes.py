"""Hidden Markov regimes in several dimensions: all series and restarts of a batch go through the recursions together, in logarithms.

A model has a start, moves and, for each state and dimension, a mean and a variance. Values that are missing say nothing about the
state. Every series starts from its own quantiles and from `restarts` further draws; the likeliest model stays. Steps of the recursions are the only loop;
each handles (series x restarts x states) numbers at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from chronosift.functions.ewm import by_series, spans, whole_series

LEAST = 30


@dataclass
class Models:
    """Parameters of a batch: logs of start (B, K) and move (B, K, K), mean and var (B, K, D), and the log likelihood (B)."""

    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    score: np.ndarray

    def take(self, at: np.ndarray) -> Models:
        return Models(self.start[at], self.move[at], self.mean[at], self.var[at], self.score[at])


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def densities(x: np.ndarray, m: Models) -> np.ndarray:
    """(B, T, K) log densities of values (B, T, D)."""
    gap = x[:, :, None, :] - m.mean[:, None]
    each = -0.5 * (gap**2 / m.var[:, None] + np.log(2 * np.pi * m.var[:, None]))
    return np.where(np.isfinite(x)[:, :, None, :], each, 0.0).sum(axis=3)


def forward(d: np.ndarray, m: Models) -> tuple[np.ndarray, np.ndarray]:
    """Log filtered probabilities (B, T, K), and the log likelihood (B) of all rows."""
    out, score, prior = np.empty_like(d), np.zeros(len(d)), m.start
    for t in range(d.shape[1]):
        joint = prior + d[:, t]
        level = _logsum(joint, 1)
        out[:, t] = joint - level[:, None]
        score += level
        prior = _logsum(out[:, t][:, :, None] + m.move, 1)
    return out, score


def expectation(x: np.ndarray, m: Models) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of states (B, T, K), expected moves (B, K, K) and the log likelihood."""
    d = densities(x, m)
    ahead, score = forward(d, m)
    back = np.zeros_like(d)
    pairs = np.zeros_like(m.move)
    for t in range(d.shape[1] - 2, -1, -1):
        then = d[:, t + 1] + back[:, t + 1]
        joint = ahead[:, t][:, :, None] + m.move + then[:, None, :]
        pairs += np.exp(joint - _logsum(joint.reshape(len(d), -1), 1)[:, None, None])
        back[:, t] = _logsum(m.move + then[:, None, :], 2)
        back[:, t] -= back[:, t].max(axis=1, keepdims=True)
    both = ahead + back
    return np.exp(both - _logsum(both, 2)[:, :, None]), pairs, score


def fit(x: np.ndarray, states: int = 2, restarts: int = 4, rounds: int = 40, seed: int = 0, history: list | None = None) -> Models:
    """The likeliest of several models for each series of x (B, T, D), of states in the order of their first variance.

    history, if given, gets the log likelihoods (B, starts) before each round.
    """
    n, steps, dims = x.shape
    starts, rng = restarts + 1, np.random.default_rng(seed)
    with np.errstate(invalid="ignore"):
        centre, spread = np.nanmean(x, axis=1), np.nanvar(x, axis=1)
    centre, spread = np.nan_to_num(centre), np.where(spread > 0, spread, 1.0)
    floor = 1e-6 * spread
    scale = np.geomspace(0.25, 2.0, states) if states > 1 else np.ones(1)
    mean = np.repeat(centre[:, None, None, :], states, axis=2) + np.zeros((1, starts, 1, 1))
    var = spread[:, None, None, :] * scale[None, None, :, None] * np.ones((1, starts, 1, 1))
    # further starts: rows drawn as means, variances drawn about the whole
    for s in range(1, starts):
        drawn = x[:, rng.integers(0, steps, states)]
        mean[:, s] = np.where(np.isfinite(drawn), drawn, mean[:, s])
        var[:, s] *= np.exp(rng.normal(0, 0.7, (n, states, dims)))
    stay = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(stay, 0.9 if states > 1 else 1.0)
    whole = np.repeat(x, starts, axis=0)
    m = Models(np.full((n * starts, states), -np.log(states)), np.tile(np.log(stay), (n * starts, 1, 1)), mean.reshape(-1, states, dims), var.reshape(-1, states, dims), np.full(n * starts, -np.inf))
    known = np.isfinite(whole)
    filled, floor = np.where(known, whole, 0.0), np.repeat(floor, starts, axis=0)[:, None, :]
    for _ in range(rounds):
        gamma, pairs, m.score = expectation(whole, m)
        if history is not None:
            history.append(m.score.reshape(n, starts).copy())
        weight = np.einsum("btk,btd->bkd", gamma, known)
        safe = np.maximum(weight, 1e-300)
        mean = np.einsum("btk,btd->bkd", gamma, filled) / safe
        gaps = np.einsum("btk,btkd->bkd", gamma, (filled[:, :, None, :] - mean[:, None]) ** 2 * known[:, :, None, :]) / safe
        some = weight > 1e-8
        m.mean, m.var = np.where(some, mean, m.mean), np.where(some, np.maximum(gaps, floor), m.var)
        with np.errstate(divide="ignore"):
            m.start = np.log(gamma[:, 0])
            total = pairs.sum(axis=2, keepdims=True)
            m.move = np.where(total > 1e-12, np.log(pairs / np.maximum(total, 1e-300)), m.move)
    m.score = forward(densities(whole, m), m)[1]
    best = m.take(np.arange(n) * starts + m.score.reshape(n, starts).argmax(axis=1))
    order = np.argsort(best.var[:, :, 0], axis=1)
    rows = np.arange(n)[:, None]
    return Models(best.start[rows, order], best.move[rows[:, :, None], order[:, :, None], order[:, None, :]], best.mean[rows, order], best.var[rows, order], best.score)


def regime_probabilities(rows: DataFrame, columns: list[str], train_to: str, *, states: int = 2, restarts: int = 4, rounds: int = 40, batch: int = 64) -> DataFrame:
    """(series_id, time, p, state, score): filtered probabilities of the states by models of each series' rows before train_to.

    state is the likeliest one, score the training rows' log likelihood. Series with fewer than LEAST training rows that have all columns get nulls.
    """
    cut = pd.Timestamp(train_to)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_series(batches, "series_id"):
            x, time = whole[columns].to_numpy(float), pd.to_datetime(whole["time"]).to_numpy()
            bounds = [(s, e, s + int((time[s:e] < cut.to_datetime64()).sum())) for s, e in spans(whole["series_id"].to_numpy())]
            able = [b for b in bounds if np.isfinite(x[b[0] : b[2]]).all(axis=1).sum() >= LEAST]
            p, score = np.full((len(whole), states), np.nan), np.full(len(whole), np.nan)
            for i in range(0, len(able), batch):
                some = able[i : i + batch]

                def padded(ends: list[int], some=some) -> np.ndarray:
                    out = np.full((len(some), max(e - b[0] for b, e in zip(some, ends, strict=True)), len(columns)), np.nan)
                    for k, (b, e) in enumerate(zip(some, ends, strict=True)):
                        out[k, : e - b[0]] = x[b[0] : e]
                    return out

                # rows behind a series' end say nothing, so they change no likelihood
                models = fit(padded([b[2] for b in some]), states, restarts, rounds)
                every = padded([b[1] for b in some])
                filtered = np.exp(forward(densities(every, models), models)[0])
                for k, (s, e, _) in enumerate(some):
                    p[s:e], score[s:e] = filtered[k, : e - s], models.score[k]
            found = np.isfinite(p[:, 0])
            yield pd.DataFrame({"series_id": whole["series_id"], "time": whole["time"], "p": pd.Series([v.tolist() if f else None for v, f in zip(p, found, strict=True)], dtype=object), "state": pd.array(np.where(found, np.nan_to_num(p).argmax(axis=1), -1), "int32"), "score": score})

    needed = rows.select("series_id", "time", *columns)
    return by_series(needed, "series_id", "time").mapInPandas(run, "series_id long, time timestamp_ntz, p array<double>, state int, score double").selectExpr("series_id", "time", "p", "nullif(state, -1) AS state", "nullif(score, double('nan')) AS score")
