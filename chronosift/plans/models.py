"""Models fitted per series: GARCH(1,1), hidden Markov regimes, realised-variance regressions, boosted trees."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosift.functions.scalars import normal_cdf_of
from chronosift.operators.positions import auc


def garch_filter(r: np.ndarray, omega: float, alpha: float, beta: float, start: float) -> np.ndarray:
    """Variance of each return given those before it; a missing return is replaced by its variance."""
    out, v = np.empty(len(r)), start
    for i, x in enumerate(r):
        out[i] = v
        v = omega + alpha * (x * x if np.isfinite(x) else v) + beta * v
    return out


def fit_garch(r: np.ndarray, least: int = 250) -> dict | None:
    """Gaussian quasi-likelihood by Nelder-Mead on (log variance, logit persistence, logit alpha share)."""
    x = r[np.isfinite(r)]
    if len(x) < least or x.var() <= 0:
        return None
    mu = x.mean()
    e = (x - mu) / x.std()

    def unpack(p):
        level, persistence, share = math.exp(p[0]), 1 / (1 + math.exp(-p[1])), 1 / (1 + math.exp(-p[2]))
        persistence = min(persistence, 0.9995)
        return level * (1 - persistence), persistence * share, persistence * (1 - share)

    def loss(p):
        if abs(p[0]) > 6 or abs(p[1]) > 12 or abs(p[2]) > 12:
            return 1e12
        v = garch_filter(e, *unpack(p), 1.0)
        return 0.5 * float((np.log(v) + e * e / v).mean())

    best = min((_nelder_mead(loss, np.array([0.0, p, s])) for p, s in ((3.0, -2.0), (1.0, -1.0))), key=lambda b: b[1])
    omega, alpha, beta = unpack(best[0])
    return {"mu": mu, "omega": omega * x.var(), "alpha": alpha, "beta": beta, "loss": best[1], "n": len(x)}


def _nelder_mead(f, x0: np.ndarray, rounds: int = 120) -> tuple[np.ndarray, float]:
    points = [x0] + [x0 + 0.5 * np.eye(len(x0))[i] for i in range(len(x0))]
    simplex = [(f(p), p) for p in points]
    for _ in range(rounds):
        simplex.sort(key=lambda s: s[0])
        centre = np.mean([p for _, p in simplex[:-1]], axis=0)
        worst = simplex[-1]
        away = centre + (centre - worst[1])
        fa = f(away)
        if fa < simplex[0][0]:
            far = centre + 2 * (centre - worst[1])
            ff = f(far)
            simplex[-1] = (ff, far) if ff < fa else (fa, away)
        elif fa < simplex[-2][0]:
            simplex[-1] = (fa, away)
        else:
            near = centre + 0.5 * (worst[1] - centre)
            fn = f(near)
            if fn < worst[0]:
                simplex[-1] = (fn, near)
            else:
                simplex = [simplex[0]] + [(f(q), q) for q in (simplex[0][1] + 0.5 * (p - simplex[0][1]) for _, p in simplex[1:])]
    simplex.sort(key=lambda s: s[0])
    return simplex[0][1], simplex[0][0]


def garch(returns: DataFrame, ret: str = "r", least: int = 250) -> DataFrame:
    """(series_id, mu, omega, alpha, beta, loss, n) of each series that is long enough."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = fit_garch(pdf.sort_values("time")[ret].to_numpy(float), least)
        return pd.DataFrame([] if m is None else [{"series_id": pdf["series_id"].iloc[0], **m}], columns=["series_id", "mu", "omega", "alpha", "beta", "loss", "n"])

    return returns.groupBy("series_id").applyInPandas(run, "series_id long, mu double, omega double, alpha double, beta double, loss double, n long")


def garch_forecast(returns: np.ndarray, model: dict, horizon: int = 1) -> float:
    """The mean variance of the next `horizon` returns after the (possibly missing) returns given."""
    level = model["omega"] / max(1 - model["alpha"] - model["beta"], 1e-12)
    v = level
    for x in returns - model["mu"]:
        v = model["omega"] + model["alpha"] * (x * x if np.isfinite(x) else v) + model["beta"] * v
    k = model["alpha"] + model["beta"]
    return level + (v - level) * ((1 - k**horizon) / (horizon * (1 - k)) if k < 1 else 1.0)


def simulate_garch(n: int, omega: float, alpha: float, beta: float, *, mu: float = 0.0, seed: int = 0, burn: int = 500) -> np.ndarray:
    """n returns of a process that has run for `burn` steps before."""
    z = np.random.default_rng(seed).standard_normal(n + burn)
    v, out = omega / (1 - alpha - beta), np.empty(n + burn)
    for i, e in enumerate(z):
        out[i] = math.sqrt(v) * e
        v = omega + alpha * out[i] ** 2 + beta * v
    return mu + out[burn:]


class GaussianHmm:
    """Diagonal Gaussian regimes in one dimension, sorted by variance; missing values say nothing."""

    def __init__(self, states: int = 2, rounds: int = 40) -> None:
        self.k, self.rounds = states, rounds

    def _density(self, x: np.ndarray) -> np.ndarray:
        d = np.exp(-0.5 * (x[:, None] - self.mean) ** 2 / self.var) / np.sqrt(2 * math.pi * self.var)
        return np.where(np.isfinite(x)[:, None], d, 1.0) + 1e-300

    def filter(self, x: np.ndarray) -> np.ndarray:
        """P(state | values so far)."""
        d, p, out = self._density(x), self.start, np.empty((len(x), self.k))
        for i in range(len(x)):
            q = p * d[i]
            out[i] = q / q.sum()
            p = out[i] @ self.move
        return out

    def following(self, x: np.ndarray) -> np.ndarray:
        """P(next state | values so far)."""
        return self.filter(x) @ self.move

    def states(self, x: np.ndarray) -> np.ndarray:
        """The likeliest state given the values so far."""
        return self.filter(x).argmax(axis=1)

    def score(self, x: np.ndarray) -> float:
        """The log likelihood of the values."""
        d, p, total = self._density(x), self.start, 0.0
        for row in d:
            q = p * row
            total += math.log(q.sum())
            p = q / q.sum() @ self.move
        return total

    def stationary(self) -> np.ndarray:
        """The distribution of states in the long run."""
        a = np.vstack([self.move.T - np.eye(self.k), np.ones(self.k)])
        return np.linalg.lstsq(a, np.append(np.zeros(self.k), 1.0), rcond=None)[0]

    def durations(self) -> np.ndarray:
        """How many steps a state is expected to last."""
        return 1 / (1 - np.diag(self.move))

    def fit(self, x: np.ndarray) -> GaussianHmm:
        good = x[np.isfinite(x)]
        self.mean, self.var = np.full(self.k, good.mean()), good.var() * np.geomspace(0.5, 2.0, self.k)
        self.move = np.full((self.k, self.k), 0.05 / max(self.k - 1, 1)) + np.eye(self.k) * (0.95 - 0.05 / max(self.k - 1, 1))
        self.start = np.full(self.k, 1 / self.k)
        seen = np.isfinite(x)
        for _ in range(self.rounds):
            a, d = self.filter(x), self._density(x)
            b = np.ones((len(x), self.k))
            pairs = np.zeros((self.k, self.k))
            for i in range(len(x) - 2, -1, -1):
                u = d[i + 1] * b[i + 1]
                joint = a[i][:, None] * self.move * u[None, :]
                pairs += joint / joint.sum()
                b[i] = self.move @ u
                b[i] /= b[i].sum()
            g = a * b
            g /= g.sum(axis=1, keepdims=True)
            w = g[seen]
            self.start, self.move = g[0], pairs / pairs.sum(axis=1, keepdims=True)
            self.mean = (w * good[:, None]).sum(axis=0) / w.sum(axis=0)
            self.var = np.maximum((w * (good[:, None] - self.mean) ** 2).sum(axis=0) / w.sum(axis=0), 1e-6 * good.var())
        order = np.argsort(self.var)
        self.mean, self.var, self.start, self.move = self.mean[order], self.var[order], self.start[order], self.move[np.ix_(order, order)]
        return self


def regimes(returns: DataFrame, train_to: str, ret: str = "r", states: int = 2) -> DataFrame:
    """(series_id, time, p_calm): filtered with a model of the rows before train_to only."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time")
        x = pdf[ret].to_numpy(float)
        head = x[(pdf["time"] < pd.Timestamp(train_to)).to_numpy()]
        if np.isfinite(head).sum() < 30:
            return pd.DataFrame({"series_id": pdf["series_id"], "time": pdf["time"], "p_calm": np.nan})
        return pd.DataFrame({"series_id": pdf["series_id"], "time": pdf["time"], "p_calm": GaussianHmm(states).fit(head).filter(x)[:, 0]})

    return returns.select("series_id", "time", ret).groupBy("series_id").applyInPandas(run, "series_id long, time timestamp_ntz, p_calm double")


def daily_realised_variance(bars: DataFrame) -> DataFrame:
    """(series_id, date, rv, n): squared log returns by the day of a bar's close; weekends count to Monday."""
    w = Window.partitionBy("series_id").orderBy("time")
    r = F.ln(F.col("close") / F.lag("close").over(w))
    close = F.to_date(F.col("available_at") - F.expr("INTERVAL '0.000001' SECOND"))
    day = F.when(F.weekday(close) >= 5, F.next_day(close, "Mon")).otherwise(close)
    return bars.select("series_id", day.alias("date"), (r * r).alias("r2")).filter("r2 IS NOT NULL").groupBy("series_id", "date").agg(F.sum("r2").alias("rv"), F.count(F.lit(1)).alias("n"))


def har(daily: DataFrame, train_to: str) -> DataFrame:
    """Adds har: next day's variance by least squares on means of 1, 5 and 22 days, fitted before train_to."""
    w = Window.partitionBy("series_id").orderBy("date")
    full = lambda n: F.when(F.count("rv").over(w.rowsBetween(-(n - 1), 0)) == n, F.avg("rv").over(w.rowsBetween(-(n - 1), 0)))
    rows = daily.withColumns({"x1": F.col("rv"), "x5": full(5), "x22": full(22), "y": F.lead("rv").over(w), "ydate": F.lead("date").over(w)})
    names = ["one", "x1", "x5", "x22"]
    train = rows.filter((F.col("ydate") < F.lit(train_to).cast("date")) & F.col("x22").isNotNull()).withColumn("one", F.lit(1.0))
    sums = train.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in [*names[i:], "y"]]).head()
    if sums["one_one"] is None:
        return rows.withColumn("har", F.lit(None).cast("double")).drop("y", "ydate")
    xx = np.array([[sums[f"{a}_{b}" if i <= j else f"{b}_{a}"] for j, b in enumerate(names)] for i, a in enumerate(names)])
    beta = np.linalg.lstsq(xx, np.array([sums[f"{a}_y"] for a in names]), rcond=None)[0]
    fit = F.lit(float(beta[0])) + sum((F.col(n) * float(b) for n, b in zip(names[1:], beta[1:], strict=True)), F.lit(0.0))
    return rows.withColumn("har", F.greatest(fit, F.lit(0.0))).drop("y", "ydate")


def har_walk(daily: DataFrame, *, least: int = 100, every: int = 21, window: int | None = None, log: bool = False) -> DataFrame:
    """Adds har: as har(), but refitted every so many days on all days before, or on the last `window` of them.

    A series is one task's work: a few thousand days with three regressors.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        rv = pdf["rv"].astype(float)
        base = np.log(rv.clip(lower=1e-12)) if log else rv
        x = np.column_stack([np.ones(len(rv)), *[base.rolling(k).mean() for k in (1, 5, 22)]])
        y, out, beta, noise = base.shift(-1).to_numpy(), np.full(len(rv), np.nan), None, 0.0
        ok = np.isfinite(x).all(axis=1)
        for i in range(len(rv)):
            if not ok[i]:
                continue
            # the last pair known at i is (i - 1, i)
            known = np.flatnonzero(ok[:i])
            known = known[known >= i - window] if window else known
            if len(known) >= least and (beta is None or (i - first) % every == 0):
                first = i if beta is None else first
                beta = np.linalg.lstsq(x[known], y[known], rcond=None)[0]
                noise = float(np.var(y[known] - x[known] @ beta))
            if beta is not None:
                got = float(x[i] @ beta)
                out[i] = math.exp(got + noise / 2) if log else max(got, 0.0)
        return pdf.assign(har=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in daily.schema.fields)
    return daily.groupBy("series_id").applyInPandas(run, fields + ", har double")


def weighted_losses(rows: DataFrame, p: str = "p", y: str = "y", weight: str | None = None) -> DataFrame:
    """One row: logloss and auc of probabilities, weighted. Ties count half."""
    w = F.col(weight) if weight else F.lit(1.0)
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-15)), F.lit(1e-15))
    loss = rows.agg((-F.sum(w * F.when(F.col(y) > 0, F.ln(q)).otherwise(F.ln(1 - q))) / F.sum(w)).alias("logloss"))
    return loss.crossJoin(auc(rows, p, y, weight))


def boosted_probability(rows: DataFrame, features: list[str], label: str, train: Column, *, weight: str | None = None, rounds: int = 20) -> DataFrame:
    """Adds p: boosted trees on the training rows, calibrated by a logistic on their log odds."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep").transform(rows.fillna(0.0, subset=features).withColumn("__y", F.col(label).cast("double")))
    some = ready.filter(train & F.col("__y").isNotNull())
    trees = GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=rounds, maxDepth=3, seed=1, **({"weightCol": weight} if weight else {})).fit(some)
    odds = lambda df: VectorAssembler(inputCols=["__o"], outputCol="__z").transform(df.withColumn("__o", vector_to_array("rawPrediction")[1]))
    platt = LogisticRegression(featuresCol="__z", labelCol="__y").fit(odds(trees.transform(some)).select("__z", "__y"))
    scored = odds(trees.transform(ready)).drop("rawPrediction", "probability", "prediction")
    return platt.transform(scored).withColumn("p", vector_to_array("probability")[1]).drop("__x", "__y", "__o", "__z", "rawPrediction", "probability", "prediction")


def bet_size(p: Column, classes: int = 2) -> Column:
    """2 Phi(z) - 1 with z = (p - 1 / classes) / sqrt(p (1 - p))."""
    z = F.try_divide(p - 1.0 / classes, F.sqrt(p * (1 - p)))
    return 2 * normal_cdf_of(z) - 1
