"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Every whole text becomes a vector of transformed statistics (logarithms of counts, logits of
shares). Each class has a mean and a covariance, shrunk towards the pooled covariance and then
towards a multiple of the identity; Cholesky factors are computed once and sent along. The score is the
logistic of the difference in Mahalanobis log density plus the log prior odds, divided by a
temperature that is fitted to the learning rows.

Learning needs the counts, sums and outer products of each class only; tasks add them up and the
driver sees one short row a task, whatever the corpus. Statistics cover whole texts.

Defined results: a null text counts as empty; an empty text has statistics of zeros and is scored
like any other; labels that are null or neither 0 nor 1 aren't learned from, nor are rows with a null
id; a document with several labels is learned from as often; with no labels of one class the score is
0.5; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

POOL, RIDGE = 0.1, 0.02
STATISTICS = ("log_chars", "log_words", "word_length", "letters", "upper", "digits", "marks", "odd_marks", "blanks", "distinct", "repeated", "lines_repeated", "line_length", "title_words", "ends")
#: Kinds of characters: other, blank, upper-case letter, letter, digit, common mark, other mark.
OTHER, BLANK, UPPER, LETTER, DIGIT, MARK, ODD = range(7)
_CACHE: dict = {}


def _kinds() -> np.ndarray:
    if "kinds" not in _CACHE:
        out = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))
            out[c] = BLANK if k[0] == "Z" else UPPER if k in ("Lu", "Lt") else LETTER if k[0] == "L" else DIGIT if k[0] == "N" else ODD if k[0] in "PS" else OTHER
        out[[ord(c) for c in "\t\n\r\v\f"]] = BLANK
        out[[ord(c) for c in ".,;:!?'\"-()"]] = MARK
        _CACHE["kinds"] = out
    return _CACHE["kinds"]


def _logit(share: float, n: float) -> float:
    """Of a share of n, kept finite."""
    p = (share * n + 0.5) / (n + 1)
    return float(np.log(p / (1 - p)))


def statistics(text: str | None) -> list[float]:
    text = text or ""
    words, lines = text.split(), text.split("\n")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    count = np.bincount(_kinds()[points], minlength=7) if len(points) else np.zeros(7)
    n, w = len(text), len(words)
    letters = count[UPPER] + count[LETTER]
    full = [x for x in lines if x.strip()]
    share = lambda k, of: k / of if of else 0.0
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log1p(n),
        np.log1p(w),
        np.log1p(share(n - count[BLANK], w)),
        _logit(share(letters, n), min(n, 200)),
        _logit(share(count[UPPER], letters), min(letters, 200)),
        _logit(share(count[DIGIT], n), min(n, 200)),
        _logit(share(count[MARK], n), min(n, 200)),
        _logit(share(count[ODD], n), min(n, 200)),
        _logit(share(count[BLANK], n), min(n, 200)),
        np.log((len(set(words)) + 1) / (w + 1)) / np.log(w + 2.0),
        _logit(share(again, max(w - 1, 0)), min(w, 200)),
        _logit(share(len(full) - len(set(full)), len(full)), min(len(full), 50)),
        np.log1p(share(n, len(full))),
        _logit(share(sum(x[:1].isupper() for x in words), w), min(w, 200)),
        _logit(share(sum(x[-1] in ".!?" for x in full), len(full)), min(len(full), 50)),
    ]


def with_statistics(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and the statistics of each text."""

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in small_batches(batches, "__text"):
            x = pa.array([statistics(t) for t in batch.column("__text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, x], names=[*keep, "x"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(measure, f"{kinds}, x array<double>")


def _moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and outer products of each class; a row a task and class reaches the driver."""
    d = len(STATISTICS)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for y, part in batch.groupby("y"):
                x = np.column_stack([np.ones(len(part)), np.vstack(part["x"].to_list())])
                total[int(y)] = total.get(int(y), 0) + x.T @ x
        if total:
            yield pd.DataFrame({"y": list(total), "s": [m.ravel() for m in total.values()]})

    out: dict[int, np.ndarray] = {}
    parts = rows.select("y", "x").mapInPandas(add, "y int, s array<double>")
    summed = parts.groupBy("y").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range((d + 1) ** 2)])
    for r in summed.collect():
        out[r["y"]] = np.array(r[1:]).reshape(d + 1, d + 1)
    return {y: (m[0, 0], m[0, 1:], m[1:, 1:]) for y, m in out.items()}


def fit(rows: DataFrame, *, pool: float = POOL, ridge: float = RIDGE) -> dict | None:
    """Means, Cholesky factors, log determinants and log priors of both classes (y 0 and 1)."""
    sums = _moments(rows)
    if set(sums) != {0, 1}:
        return None
    d, total = len(STATISTICS), sum(s[0] for s in sums.values())
    mean = {y: s[1] / s[0] for y, s in sums.items()}
    cov = {y: s[2] / s[0] - np.outer(mean[y], mean[y]) for y, s in sums.items()}
    pooled = sum(sums[y][0] / total * cov[y] for y in sums)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    model: dict = {"scale": scale, "temperature": 1.0}
    for y in sums:
        shrunk = ((1 - pool) * cov[y] + pool * pooled) / np.outer(scale, scale)
        shrunk = (1 - ridge) * shrunk + ridge * np.trace(shrunk) / d * np.eye(d) + 1e-9 * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        model[y] = (mean[y] / scale, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(sums[y][0] / total))
    return model


def odds(model: dict, x: np.ndarray) -> np.ndarray:
    """Log odds of class 1, before the temperature."""
    z = x / model["scale"]
    log = {}
    for y in (0, 1):
        mean, inverse, determinant, prior = model[y]
        log[y] = prior - 0.5 * determinant - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1)
    return log[1] - log[0]


def _temperature(model: dict, rows: DataFrame) -> float:
    """The divisor of the log odds with the least log loss on the learning rows, from a fixed grid."""
    grid = np.geomspace(1, 64, 25)

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(grid))
        for batch in batches:
            if len(batch):
                o = odds(model, np.vstack(batch["x"].to_list())) * np.where(batch["y"].to_numpy() == 1, -1, 1)
                total += np.logaddexp(0, o[:, None] / grid[None, :]).sum(axis=0)
        yield pd.DataFrame({"g": np.arange(len(grid)), "l": total})

    got = rows.select("y", "x").mapInPandas(losses, "g int, l double").groupBy("g").agg(F.sum("l").alias("l")).collect()
    return float(grid[min(got, key=lambda r: (r["l"], r["g"]))["g"]]) if got else 1.0


def score(docs: DataFrame, labels: DataFrame, *, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", keep: list[str] | None = None, scratch=lambda df: df) -> DataFrame:
    """The columns `keep` of docs (its id by default) and score, from 0 to 1.

    learn: which labels (by their id) are learned from. scratch: stores the statistics, which are read
    three times.
    """
    keep = keep or [doc_id]
    measured = scratch(with_statistics(docs, text, keep))
    y = labels.filter(learn & F.col(label).isin(0, 1)).select(doc_id, F.col(label).cast("int").alias("y"))
    rows = scratch(measured.select(doc_id, "x").join(y, doc_id).select("y", "x"))
    model = fit(rows)
    if model is None:
        return measured.drop("x").withColumn("score", F.lit(0.5))
    model["temperature"] = _temperature(model, rows)

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = batch.column("x")
            z = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(STATISTICS))
            p = 1 / (1 + np.exp(-np.clip(odds(model, z) / model["temperature"], -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(p)], names=[*keep, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return measured.mapInArrow(apply, f"{kinds}, score double")
