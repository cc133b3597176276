"""Walk-forward, purged k-fold and combinatorial splits as tables."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def walk_forward(n: int, train: int, test: int, *, step: int | None = None, anchored: bool = False, purge: int = 0, embargo: int = 0, min_test: int = 1) -> list[dict]:
    """Folds of positions: train [a, b), test [c, d) behind purge and embargo."""
    out, start = [], train
    while start + purge + embargo < n:
        c = start + purge + embargo
        d = min(c + test, n)
        if d - c < min_test:
            break
        out.append({"fold": len(out), "train_from": 0 if anchored else start - train, "train_to": start, "test_from": c, "test_to": d})
        start += step or test
    return out


def folds_frame(spark: SparkSession, folds: list[dict]) -> DataFrame:
    return spark.createDataFrame(folds, "fold int, train_from long, train_to long, test_from long, test_to long")


def membership(positions: DataFrame, folds: DataFrame, pos: str = "pos") -> DataFrame:
    """(fold, part, pos): the few folds are exploded to ranges on each row's side by a broadcast range join."""
    p = F.col(pos)
    part = F.when((p >= F.col("train_from")) & (p < F.col("train_to")), "train").when((p >= F.col("test_from")) & (p < F.col("test_to")), "test")
    spans = F.broadcast(folds)
    return positions.join(spans, (p >= F.col("train_from")) & (p < F.col("test_to"))).withColumn("part", part).filter("part IS NOT NULL").select("fold", "part", pos)


def purged_kfold(labels: DataFrame, n: int, k: int, *, embargo: int = 0, pos: str = "t_idx", end: str = "t1_idx") -> DataFrame:
    """(fold, pos) of the training rows: labels that neither start in nor reach into fold +- embargo."""
    spark = labels.sparkSession
    edges = [i * (n // k) + min(i, n % k) for i in range(k + 1)]
    tests = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(k)], "fold int, a long, b long")
    overlap = (F.col(pos) < F.col("b") + embargo) & (F.coalesce(end, pos) >= F.col("a"))
    return labels.select(pos, end).join(F.broadcast(tests), ~overlap).select("fold", F.col(pos).alias("pos"))


def cpcv(n: int, groups: int, k: int) -> list[dict]:
    """Combinations of test groups with their bounds."""
    edges = [i * (n // groups) + min(i, n % groups) for i in range(groups + 1)]
    return [{"combo": c, "groups": list(g), "spans": [(edges[i], edges[i + 1]) for i in g]} for c, g in enumerate(itertools.combinations(range(groups), k))]


def cpcv_paths(groups: int, k: int) -> list[list[int]]:
    """For each path the combination that predicts each group."""
    combos = list(itertools.combinations(range(groups), k))
    queues = {g: [c for c, x in enumerate(combos) if g in x] for g in range(groups)}
    return [[queues[g][p] for g in range(groups)] for p in range(len(queues[0]))]


def group_of(pos: Column, n: int, groups: int) -> Column:
    """The number of the contiguous group that a position of n is in; the first n % groups are one longer."""
    size, longer = divmod(n, groups)
    head = longer * (size + 1)
    return F.when(pos < head, F.floor(pos / (size + 1))).otherwise(longer + F.floor((pos - head) / max(size, 1))).cast("int")


def path_segments(spark: SparkSession, groups: int, k: int) -> DataFrame:
    """(path, grp, split): the split that predicts each group on each path, which is the path-th, in order, of those that test it.

    A row a (split, tested group); groups and k bound it.
    """
    rows = [(c, g) for c, x in enumerate(itertools.combinations(range(groups), k)) for g in x]
    nth = F.row_number().over(Window.partitionBy("grp").orderBy("split")) - 1
    return spark.createDataFrame(rows, "split int, grp int").select(nth.alias("path"), "grp", "split")


def assemble_paths(predictions: DataFrame, n: int, groups: int, k: int, keys: list[str] = (), *, split: str = "split", pos: str = "pos") -> DataFrame:
    """The predictions (keys, split, pos, ..) of test rows with the path that each belongs to.

    Every path has each position once. Rows of a split that doesn't test their group belong to none.
    """
    segments = F.broadcast(path_segments(predictions.sparkSession, groups, k).withColumnsRenamed({"split": "__split", "grp": "__grp"}))
    placed = predictions.withColumn("__g", group_of(F.col(pos), n, groups))
    return placed.join(segments, (F.col("__g") == F.col("__grp")) & (F.col(split) == F.col("__split"))).select("path", *keys, split, pos, *[c for c in predictions.columns if c not in (*keys, split, pos)])


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """The product of a few short parameter lists, by explosion of literals."""
    out = spark.range(1).drop("id")
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out


def parse_axis(spec: str) -> tuple[str, list[float]]:
    """'a=1,2,5' or 'a=1:10:3' (end included)."""
    name, _, values = spec.partition("=")
    if ":" in values:
        a, b, c = map(float, values.split(":"))
        count = int(round((b - a) / c + 1e-9)) + 1
        return name.strip(), [a + i * c for i in range(count) if a + i * c <= b + 1e-9]
    return name.strip(), [float(v) for v in values.split(",")]
